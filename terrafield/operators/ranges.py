"""Places and running totals in an order over all rows, without a window that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafield.session import cut

#: Rows of a block of prefixes().
BLOCK = 4096
_PLACE = (1 << 33) - 1  # monotonically_increasing_id holds the partition above 33 bits, the row's place in it below


def numbered(df: DataFrame, order: list[Column], sums: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """df with `rank`, a row's place from 0 in the order, and before_<c>: the total of c over earlier rows.

    Rows are dealt to ranges of the order (as many as shuffles have partitions; small ones are put together by AQE), sorted there and written once; the driver gets one row per range (its count and totals), and
    a row's place in its range follows from where it was written. Rows that tie in the whole order lie in one range, in any order.
    An empty table gives an empty one.
    """
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    dealt = cut(dealt.sortWithinPartitions(*order)).withColumn("_at", F.monotonically_increasing_id())
    dealt = dealt.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit(_PLACE))})
    per = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums]).orderBy("_range").collect()
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    of = {c: "double" if kinds[c] in ("double", "float") else "long" for c in sums}
    totals = [0, *[0.0 if of[c] == "double" else 0 for c in sums]]
    starts = [list(totals) for _ in range(1 + max((x["_range"] for x in per), default=0))]  # by range: rows and sums before it
    for x in per:
        starts[x["_range"]] = totals
        totals = [t + (v or 0) for t, v in zip(totals, (x["n"], *[x[c] for c in sums]))]

    def before(k: int, kind: str) -> Column:  # as one literal, so that no join is needed
        return F.get(F.split(F.lit(",".join(repr(t[k]) for t in starts)), ",").cast(f"array<{kind}>"), F.col("_range").cast("int"))

    inner = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    new = {"rank": before(0, "long") + F.col("_at")}
    new |= {f"before_{c}": before(k + 1, of[c]) + F.coalesce(F.sum(c).over(inner), F.lit(0).cast(of[c])) for k, c in enumerate(sums)}
    return dealt.withColumns(new).drop("_range", "_at")


def prefixes(df: DataFrame, by: list[str], i: str, sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """df with running totals, up to and with each row, of the columns `sums` within groups whose rows `i` numbers from 1.

    A group is cut into blocks of its numbers: totals by block first, then within blocks, so no task holds a group of any length.
    """
    rows = df.withColumns(sums).withColumn("_block", F.floor((F.col(i) - 1) / block).cast("long"))
    tops = rows.groupBy(*by, "_block").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_block").alias("_of"), *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0.0)).alias(f"_t_{c}") for c in sums])
    inner = Window.partitionBy(*by, "_block").orderBy(i).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.sum(c).over(inner) for c in sums})
    rows = rows.join(tops, [*[F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col("_block") == F.col("_of")])
    return rows.withColumns({c: F.col(c) + F.col(f"_t_{c}") for c in sums}).drop("_block", "_of", *[f"_by_{c}" for c in by], *[f"_t_{c}" for c in sums])
