"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mix has the van der Corput point v(i); the sources' shares, laid end to end on [0, 1), tell which source
a point means. The first 2^k points are the grid j / 2^k in another order, so a source gets its share of the slots to
within one, at every scale of the schedule evenly. A slot's rank among its source's slots follows in closed form
from its digits, so no slots are shuffled or sorted to be ranked. Rank r takes block r mod n of the source's n
equal-token blocks, whose documents were shuffled by a hash.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafield.llm.common import cut, n_words, pack_rows, running_sums
from terrafield.operators.ranges import numbered

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more often.
MAX_EPOCHS = 3
#: Slots that a source gets at least, unless its blocks are single words: its words miss the target by half a block at most, so by under 1 %.
LEAST_SLOTS = 64
#: Words of a block, at most, and slots of a whole mix, at least.
BLOCK_WORDS, MIX_SLOTS = 4096, 1 << 16
#: Slots that one row of the schedule's input stands for.
CHUNK = 4096
#: Source tables of at most this many rows and bytes of names are sent to all tasks; larger ones are joined.
SMALL_ROWS, SMALL_BYTES = 100_000, 16 << 20


def with_targets(per: DataFrame, cap: float = MAX_EPOCHS) -> DataFrame:
    """per(size, weight, ...) with `target`: shares of all sizes by weight, none above cap times its size; the excess goes to the
    others by weight. Each round caps the sources that the last level overfills, by one sum over the table; it ends when none is new."""
    left = total = per.agg(F.sum("size")).first()[0] or 0
    free = per.agg(F.sum("weight")).first()[0] or 0
    capped, n = F.lit(False), 0
    while free:
        share = F.lit(float(left)) * F.col("weight") / F.lit(float(free))
        capped = cap * F.col("size") < share
        got = per.agg(F.count_if(capped).alias("n"), F.sum(F.when(capped, F.col("size"))).alias("size"), F.sum(F.when(~capped, F.col("weight"))).alias("weight")).first()
        if got.n == n:
            return per.withColumn("target", F.when(capped, cap * F.col("size")).otherwise(share).cast("double"))
        n, left, free = got.n, total - cap * (got["size"] or 0), got.weight or 0
    return per.withColumn("target", F.lit(float(cap)) * F.col("size"))


def plan(per: DataFrame, block_words: int = BLOCK_WORDS, least_slots: int = MIX_SLOTS) -> DataFrame:
    """per(source_no, size, weight, ...) with target, blocks, lo, hi and bits.

    A source has `blocks` equal blocks and the grid points lo..hi-1 of the 2^bits points j / 2^bits; the rest of the slots stay idle. A small
    source has smaller blocks, so that every source misses its target by a small share of its own.
    """
    per = with_targets(per)
    total = per.agg(F.sum("size")).first()[0] or 0
    block = max(1, min(block_words, total // least_slots))
    size, target = F.col("size"), F.col("target")
    small = F.when(target > 0, LEAST_SLOTS * size / target).otherwise(0.0)
    per = per.withColumn("blocks", F.least(F.ceil(F.greatest(size / F.lit(float(block)), small)).cast("long"), size))
    per = per.withColumn("slots", F.when(size > 0, F.rint(target * F.col("blocks") / size)).otherwise(0.0).cast("long"))
    per = numbered(per, [F.col("source_no").asc()], ("slots",)).drop("rank")
    bits = int(max(1, per.agg(F.sum("slots")).first()[0] or 0) - 1).bit_length()
    return per.select("*", F.col("before_slots").alias("lo"), (F.col("before_slots") + F.col("slots")).alias("hi"), F.lit(bits).alias("bits")).drop("before_slots", "slots")


def reverse_bits(i: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(i), np.int64)
    for m in range(bits):
        out |= ((i >> m) & 1) << (bits - 1 - m)
    return out


def slots_below(i: np.ndarray, x: np.ndarray, bits: int) -> np.ndarray:
    """How many of the slots 0..i-1 have a point below x / 2^bits."""
    out = np.zeros(len(i), np.int64)
    base = np.zeros(len(i), np.int64)  # the reversed digits of i that are fixed so far
    for m in range(bits - 1, -1, -1):
        on = (i >> m) & 1 == 1
        # slots with i's higher digits, a 0 here and any lower digits: points base + t * 2^(bits - m), t < 2^m
        step = np.int64(1) << (bits - m)
        t = np.clip(-(-(x - base) // step), 0, np.int64(1) << m)
        out += np.where(on, t, 0)
        base += np.where(on, np.int64(1) << (bits - 1 - m), 0)
    return out


def _schedule(batches):
    for b in batches:
        for row in b.to_pylist():
            # a slot's point is its bits reversed, and so is a point's slot
            i = reverse_bits(np.arange(row["at"], min(row["at"] + CHUNK, row["hi"])), row["bits"])
            rank = slots_below(i, np.full(len(i), row["hi"]), row["bits"]) - slots_below(i, np.full(len(i), row["lo"]), row["bits"])
            n = row["blocks"]
            ok = rank < MAX_EPOCHS * n
            i, rank = i[ok], rank[ok]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (i, np.full(len(i), row["source_no"]), rank % n, rank // n)], ["slot", "source_no", "block", "epoch"])


def schedule(sources: DataFrame) -> DataFrame:
    """The mix of a plan: (slot, source_no, block, epoch), a row per busy slot; in the order of `slot` it is the mix's own. A source
    with many slots is cut into chunks of them, dealt evenly to as many tasks as shuffles have partitions."""
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = sources.where("hi > lo").select("source_no", "blocks", "lo", "hi", "bits", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(CHUNK).cast("long"))).alias("at"))
    return chunks.repartition(tasks).mapInArrow(_schedule, "slot long, source_no long, block long, epoch long")


def prepare(docs: DataFrame, id_col: str, text_col: str, source_col: str, **how) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): every row's doc_id, size and place in its shuffled source, with its source's columns; the plan of the mix."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    rows = cut(rows)
    per = numbered(rows.groupBy("source").agg(F.sum("size").alias("size")), [F.col("source").asc_nulls_last()]).withColumnRenamed("rank", "source_no")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("source_no") % len(WEIGHTS)).cast("int") + 1)
    sources = cut(plan(cut(per.withColumn("weight", weight)), **how))
    numbers = sources.select(F.col("source").alias("_source"), "source_no", F.col("size").alias("source_size"), "target", "blocks")
    held = numbers.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("_source")).alias("bytes")).first()
    if held.n <= SMALL_ROWS and (held.bytes or 0) <= SMALL_BYTES:
        numbers = F.broadcast(numbers)
    rows = rows.join(numbers, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    rows = rows.withColumn("_h", F.xxhash64("doc_id", F.lit("mix")))
    return running_sums(rows, "source_no", ["_h", "doc_id", "size"], "size").drop("slot"), sources


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: words of it that the mix takes, repeats counted.

    Sources weigh 5, 2, 1 in code point order, null last, and share all words; a target stops at three times its
    source. Taken is within half a block of the target, and a block is 1 / LEAST_SLOTS of the target or a single word at
    most, however many sources there are: they are numbered, weighed and scheduled as a table on the cluster. A block is the words from
    floor(b S / n) to floor((b + 1) S / n) of its source, so a document may lie
    in several blocks, and none is taken more than three times. Null and empty texts have size 0 and taken 0. Equal
    inputs give equal results; rows that repeat a doc_id are rows of their own. A hot source is summed
    and numbered in ranges of its hash. An empty table gives an empty one.
    """
    rows, sources = prepare(docs, id_col, text_col, source_col, **how)
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    times = schedule(sources).groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    start, end = F.col("before"), F.col("before") + F.col("size")

    def block_of(at):  # the block whose floor(b S / n) <= at < floor((b + 1) S / n)
        return F.expr(f"((cast({at} as decimal(19, 0)) + 1) * blocks - 1) div source_size")

    pieces = rows.where("size > 0").select(
        "row", "source_no", "source_size", "blocks", start.alias("s"), end.alias("e"),
        F.explode(F.sequence(block_of("before"), block_of("(before + size - 1)"))).alias("block"),
    )
    pieces = pieces.join(times, ["source_no", "block"])
    low, high = F.expr("(cast(block as decimal(19, 0)) * source_size) div blocks"), F.expr("(cast(block + 1 as decimal(19, 0)) * source_size) div blocks")
    taken = pieces.groupBy("row").agg(F.sum((F.least("e", high) - F.greatest("s", low)) * F.col("times")).alias("taken"))
    return rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: each row as often as its share taken / size, rounded up or down by a hash of its id.

    Every id stays that the mix takes wholly at least once; a row without words is in no mix and stays once.
    Repeated rows share the mean of their shares. The columns are those of docs, so the schedule's order isn't kept: schedule()
    has it, by source and block.
    """
    share = mix(docs, id_col, text_col, source_col).groupBy("doc_id").agg(F.try_divide(F.sum("taken"), F.sum("size")).alias("share"))
    share = cut(share.select(F.col("doc_id").alias("own"), "share"))
    dither = F.shiftrightunsigned(F.xxhash64("own", F.lit("copies")), 11).cast("double") / F.lit(2.0**53)
    copies = F.coalesce(F.floor(F.col("share") + dither), F.lit(1)).cast("int")
    rows = pack_rows(docs, id_col).join(share, F.col("id").eqNullSafe(F.col("own")))
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), copies))).select("row.*")
