"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafield.llm.common import running_sums


def rendezvous(key, weights: Mapping[int, float]) -> F.Column:
    """The shard with the best score for the key, as an int column.

    A shard's score is -ln(u) / weight with u in (0, 1) from XXH64 of key and shard, so each shard wins its
    weight's share of the keys, and a new shard or a larger weight draws rows only to itself. Ties go to the smaller
    shard. A null key hashes to the seed and so has a shard as well. Shards of weight 0 or less get nothing.
    """
    live = {s: w for s, w in weights.items() if w > 0}
    if not live:
        raise ValueError("no shard has a positive weight")
    same = len(set(live.values())) == 1

    def score(s: int, w: float) -> F.Column:
        h = F.xxhash64(key, F.lit(int(s)))
        if same:  # the order of the scores is that of the hashes
            return h
        u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(2.0**53)
        return F.log(u) / F.lit(float(w))

    return F.greatest(*[F.struct(score(s, w).alias("score"), F.lit(-int(s)).alias("neg")) for s, w in sorted(live.items())] * (2 if len(live) == 1 else 1))["neg"] * F.lit(-1)


def shard(docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float] | None = None, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = 4096) -> DataFrame:
    """Placement of every row: doc_id, size, text_crc32, law `key`, shard, slot, and its shard among `grown`.

    slot numbers a shard's rows from 0 without gaps in the order of a second hash of the key, i.e. shuffled.
    Texts are read for size and checksum only and never shuffled; a shard is numbered in ranges of its hash, so a
    shard of any size stays out of any one task. Null texts have size 8 and the checksum of nothing, 0. Rows with equal
    or null keys share a shard and have slots of their own. An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col).cast("long")
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).cast("int").alias("shard"),
        (rendezvous(key, grown).cast("int") if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.xxhash64(key, F.lit("slot")).alias("_h"),
    )
    out = running_sums(rows, "shard", ["_h", "doc_id", "size", "text_crc32"], "size", per_bucket)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def expected_moves(old: int, new: int) -> float:
    """Share of rows that move when `old` equal shards become `new`: 1 - old/new, the least possible."""
    return 1 - old / new if new > old else 1 - new / old if new < old else math.nan if not old else 0.0
