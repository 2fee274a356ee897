"""SimHash near-duplicate detection with vantage-point trees over Hamming space.

Fingerprints are partitioned by a vantage-point tree: at a node, points go inside or outside by their Hamming
distance to the vantage point. The triangle bound says that two fingerprints at distance r or less differ by
at most r in that distance, so a point within a band of the threshold also goes to the other side
(a boundary-overlapping shard), and every pair at distance r or less meets in one shard at least. In a shard
a local tree prunes the same way down to small blocks, which are compared exactly. Shards report the star of
each local group, not its pairs; connected components joins them.

Every row takes part. Only the tree is fitted on a bounded sample (see links), and the tree decides where pairs meet, never whether.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafield.llm.common import LocalUnion, components, cut, pack_rows, words_of

SEED = 42
#: MinHash bands and MinHashes a band: a pair at Jaccard similarity J shares no band with probability (1 - J^5)^32, 3e-6 at 0.8.
BANDS, BAND_ROWS = 32, 5
#: Pairs of a bucket are verified unless their MinHashes agree in a share this much below the similarity: under 5e-6 of the pairs at 0.8.
SLACK = 0.15


def _shingle_hashes(words: list[bytes], k: int, block: int = 1 << 16):
    """uint64 arrays of the XXH64 of the k-word shingles, in blocks so that a very long text stays small."""
    if not words:
        return
    h = xxhash.xxh64_intdigest
    if len(words) < k:
        yield np.array([h(b" ".join(words), SEED)], np.uint64)
        return
    buf = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    for i in range(0, len(starts), block):
        yield np.array([h(buf[s:e], SEED) for s, e in zip(starts[i : i + block], ends[i : i + block])], np.uint64)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the values have each bit, from bit 0; columns of a 2-D array follow one another."""
    return np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, k: int = 3) -> int:
    """64-bit SimHash over k-word shingles, repeats included: a bit is set if it is in over half of the hashes."""
    n, counts = 0, np.zeros(64, np.int64)
    for h in _shingle_hashes(words_of(text), k):
        n += len(h)
        counts += _bit_counts(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0]) if n else 0


def _finish(z: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _mix(h: np.ndarray, n: int) -> np.ndarray:
    """n further 64-bit hashes of each value, over stepped seeds."""
    with np.errstate(over="ignore"):
        return _finish(h[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct hashes of a text's k-word shingles, sorted."""
    words = words_of(text)
    return np.unique(np.concatenate(list(_shingle_hashes(words, k)))) if words else np.empty(0, np.uint64)


def min_hashes(h: np.ndarray, n: int, block: int = 1 << 10) -> np.ndarray:
    """n (even) MinHashes of 32 bits of a set of hashes: each agrees for two sets with the probability of their Jaccard similarity."""
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), block):
        out = np.minimum(out, _mix(h[i : i + block], n // 2).view(np.uint32).min(axis=0))
    return out


def band_keys(m: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of MinHashes; no two bands share keys."""
    z = np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(32)
    for column in m.reshape(bands, -1).T:
        z = _finish(z ^ column)
    return z.view(np.int64)


# ----------------------------------------------------------------------------- vantage-point trees


class Tree:
    """A vantage-point tree as flat arrays; child >= 0 is a node, child < 0 the shard -child - 1."""

    def __init__(self, sample: np.ndarray, radius: int, leaf: int):
        self.radius, self.vantage, self.mu, self.kids, self.shards = radius, [], [], [], 0
        self.root = self._grow(np.unique(sample), leaf, np.random.default_rng(7))

    def _shard(self) -> int:
        self.shards += 1
        return -self.shards

    def _grow(self, pts: np.ndarray, leaf: int, rng) -> int:
        if len(pts) <= leaf or not (found := _split(pts, self.radius, rng)):
            return self._shard()
        v, mu = found
        at = len(self.vantage)
        self.vantage.append(v)
        self.mu.append(mu)
        self.kids.append(None)
        d = np.bitwise_count(pts ^ v)
        inner, outer = _sides(d, mu, self.radius)
        self.kids[at] = (self._grow(pts[inner], leaf, rng), self._grow(pts[outer], leaf, rng))
        return at

    def route(self, pts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, row) for every shard that a point belongs to."""
        out, todo = [], [(self.root, np.arange(len(pts)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out.append((-node - 1, rows))
                continue
            d = np.bitwise_count(pts[rows] ^ self.vantage[node])
            for side, kid in zip(_sides(d, self.mu[node], self.radius), self.kids[node]):
                if side.any():
                    todo.append((kid, rows[side]))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([np.full(len(r), s, np.int64) for s, r in out]), np.concatenate([r for _, r in out])


def _sides(d: np.ndarray, mu: int, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Inside: d <= mu, and the band of r // 2 above it. Outside: d > mu, and the band of the rest below. Distances to
    the vantage point of a pair at distance r or less differ by r at most, so one side holds both."""
    return d <= mu + r // 2, d > mu - (r - r // 2)


def _split(pts: np.ndarray, r: int, rng) -> tuple[np.uint64, int] | None:
    """Of some vantage points, the one with the threshold that puts the fewest points on both sides, near the median."""
    best = None
    few = pts if len(pts) <= 4096 else pts[rng.choice(len(pts), 4096, replace=False)]
    for v in pts[rng.choice(len(pts), min(8, len(pts)), replace=False)]:
        n = np.bincount(np.bitwise_count(few ^ v), minlength=65)
        upto = np.cumsum(n)
        for mu in np.unique(np.searchsorted(upto, np.array([0.35, 0.45, 0.5, 0.55, 0.65]) * len(few))):
            inner = upto[min(64, mu + r // 2)]
            outer = len(few) - (upto[mu - (r - r // 2)] if mu >= r - r // 2 else 0)
            worst, total = max(inner, outer), inner + outer
            if worst <= 0.85 * len(few) and (best is None or total * worst < best[0]):
                best = (total * worst, v, int(mu))
    return best and best[1:]


def near_pairs(pts: np.ndarray, r: int, block: int = 256):
    """Arrays (i, j) of all pairs at distance r or less, some of them twice: a local vantage-point tree."""
    rng = np.random.default_rng(3)
    todo = [np.arange(len(pts))]
    while todo:
        rows = todo.pop()
        p = pts[rows]
        found = _split(p, r, rng) if len(rows) > 2 * block else None
        if found:
            todo += [rows[s] for s in _sides(np.bitwise_count(p ^ found[0]), found[1], r)]
            continue
        for i in range(0, len(rows), block):
            a, b = np.nonzero(np.bitwise_count(p[i : i + block, None] ^ p[None, i:]) <= r)
            keep = b > a
            yield rows[i + a[keep]], rows[i + b[keep]]


def _star(table: pa.Table, r: int) -> pa.Table:
    """Of one shard (or pair of blocks of a large one), the links from each row to the smallest id of its local group."""
    table = table.select(["id", "point"]).combine_chunks().sort_by("id")
    ids = table.column("id").to_numpy()
    pts = table.column("point").to_numpy().view(np.uint64)
    sets = LocalUnion(len(ids))
    for i, j in near_pairs(pts, r):
        sets.add(i, j)
    root = sets.all_roots()
    own = np.nonzero(root != np.arange(len(ids)))[0]
    return pa.table({"a": pa.array(ids[own], pa.int64()), "b": pa.array(ids[root[own]], pa.int64())})


def _routed(batches, trees):
    for b in batches:
        shard, row = trees.value.route(b.column("point").to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *b.take(pa.array(row)).columns], ["shard", *b.schema.names])


def links(points: DataFrame, radius: int, sample_rows: int | None = None, shard_rows: int = 2048, task_rows: int = 1 << 20) -> DataFrame:
    """Links (a, b) between ids whose points lie within `radius`, enough to connect all that are.

    points: view int, id long (unique in its view), point long. One tree
    serves all views; a shard holds rows of one view only. The tree is fitted on sample_rows points, by default 65,536 or a
    65,536th of all, 1,048,576 at most and never over a quarter. Shards larger than shard_rows are searched by their own local
    tree; one over task_rows is compared in pairs of hashed blocks, so a task's memory stays bounded and no pair is lost.
    """
    spark = points.sparkSession
    total = points.count()
    sample_rows = sample_rows or min(1 << 20, max(1 << 16, total >> 16))
    share = min(0.25, sample_rows / max(1, total))
    pick = (F.pmod(F.xxhash64("id", "view"), F.lit(1 << 20)) < int(share * (1 << 20))) if total else F.lit(False)
    sample = points.where(pick).select("point").toArrow().column("point").to_numpy().view(np.uint64)
    views = points.agg(F.max("view")).first()[0] or 0
    tree = Tree(sample, radius, max(8, int(shard_rows * share * (views + 1))))
    trees = spark.sparkContext.broadcast(tree)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    rows = points.mapInArrow(partial(_routed, trees=trees), f"shard long, {fields}")
    rows = rows.withColumn("shard", F.col("shard") * (views + 1) + F.col("view")).drop("view")
    # shards are as many as the tree has, so this table is bounded by sample_rows
    heavy = {x.shard: x.n for x in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > task_rows).collect()}
    if heavy:
        k = F.create_map(*[F.lit(x) for s, n in heavy.items() for x in (s, math.ceil(2 * n / task_rows))])
        rows = rows.withColumn("k", F.coalesce(k[F.col("shard")], F.lit(1)))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        rows = rows.select(F.expr("shard"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *[c for c in points.columns if c != "view"])
    else:
        rows = rows.withColumns({"i": F.lit(0), "j": F.lit(0)})
    return rows.groupBy("shard", "i", "j").applyInArrow(_star_fn(radius), "a long, b long")


def _star_fn(r: int):
    def run(table: pa.Table) -> pa.Table:
        return _star(table, r)

    return run


def _fingerprints(batches, k):
    for b in batches:
        got = np.fromiter((fingerprint(t, k) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got.view(np.int64))], ["id", "point"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: fingerprints of k-word shingles, linked at `radius` bits or fewer.

    Equal fingerprints are one point, whatever their number. Null and wordless texts have the fingerprint zero,
    which links like any other. A row with a null id gets the component of its fingerprint, and null if no id
    has that. Repeated rows come back as often as they came. An empty table gives an empty one. Other columns
    are not read, so their names cannot clash.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = cut(rows.mapInArrow(partial(_fingerprints, k=k), "id long, point long"))
    points = cut(rows.groupBy("point").agg(F.min("id").alias("id")).where("id is not null"))
    found = links(points.select(F.lit(0).alias("view"), "id", "point"), radius)
    parts = components(found)
    of = points.join(parts, points.id == parts.node, "left").select(F.col("point").alias("p"), F.coalesce("component", "id").alias("component_id"))
    return rows.join(of, rows.point == of.p, "left").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _banded(batches, k, bands, band_rows):
    for b in batches:
        sets = [shingle_set(t, k) for t in b.column("text").to_pylist()]
        mins = [min_hashes(h, bands * band_rows) for h in sets]
        flat = pa.array(np.concatenate([band_keys(m, bands) for m in mins]) if mins else [], pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * bands, pa.int32()), flat)
        digests = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary())
        signs = pa.array([m.astype(np.uint8).tobytes() for m in mins], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("id"), digests, lists, signs], ["id", "digest", "keys", "sign"])


def _sets(batches, k):
    """Sets of the texts whose digest is the wanted one: an id may have other texts."""
    for b in batches:
        sets = [shingle_set(t, k) for t in b.column("text").to_pylist()]
        right = [xxhash.xxh3_128_digest(h.tobytes()) == d for h, d in zip(sets, b.column("digest").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("num"), pa.array([h.tobytes() for h in sets], pa.binary())], ["num", "set"]).filter(pa.array(right, pa.bool_()))


def jaccard(x: bytes, y: bytes) -> float:
    """Similarity of two sets of hashes, given as the bytes of sorted uint64."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) else 0
    return both / max(1, len(x) + len(y) - both)


def _near(x: bytes, y: bytes, similarity: float) -> bool:
    return min(len(x), len(y)) >= similarity * max(len(x), len(y)) and jaccard(x, y) >= similarity


def _verified(batches, similarity):
    for b in batches:
        near = [_near(x, y, similarity) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
        yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _linked(table: pa.Table, similarity: float) -> pa.Table:
    """Of one bucket (or pair of blocks of a large one), verified links that join the components of its members.

    A pair is verified on its sets unless it is connected already, its MinHashes agree too seldom, it met in an earlier band's bucket, or
    it has the bucket's smallest number, as those pairs have been verified before. A link joins its components at once, so there are
    fewer links than members, however many pairs are near.
    """
    table = table.filter(pc.not_equal(table.column("num"), table.column("rep"))).combine_chunks()
    links = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if table.num_rows:
        num, part = (table.column(c).to_numpy() for c in ("num", "part"))
        sign = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint8).reshape(len(num), -1)
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(num), -1)
        band = int(np.nonzero(keys[0] == table.column("key")[0].as_py())[0][0])
        sets, size = table.column("set"), pc.binary_length(table.column("set")).to_numpy()
        names, of = np.unique(part, return_inverse=True)
        joined = LocalUnion(len(names))
        few = np.nonzero(of != np.bincount(of).argmax())[0]  # one of a pair is outside the largest component
        step = max(1, (1 << 18) // len(num))
        for s in range(0, len(few), step):
            i = few[s : s + step]
            root = joined.roots(of)
            near = (sign[i, None] == sign[None]).sum(axis=2) >= (similarity - SLACK) * sign.shape[1]
            a, b = np.nonzero(near & (root[i, None] != root[None]))
            a = i[a]
            ok = (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])) & ~((keys[a, :band] == keys[b, :band]).any(axis=1))
            for x, y in zip(a[ok].tolist(), b[ok].tolist()):
                u, v = joined.roots(of[[x, y]]).tolist()
                if u != v and jaccard(sets[x].as_py(), sets[y].as_py()) >= similarity:
                    joined.add(np.array([u]), np.array([v]))
                    links[0].append(num[[x]])
                    links[1].append(num[[y]])
    a, b = (np.concatenate(x) for x in links)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _linked_fn(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        return _linked(table, similarity)

    return run


def duplicate_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, task_rows: int = 4096, task_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, component_id) of the rows that another row of smaller id makes superfluous, once per id.

    Linked are texts whose sets of k-word shingles have the given Jaccard similarity or more, verified on the sets. Equal sets
    are one point, whatever their number. Candidates are pairs that share one of BANDS MinHash bands. First every member of a
    bucket is compared with the bucket's first; then, in buckets that these links leave in several components,
    members of different components whose MinHashes agree often enough, each pair in one bucket only. Buckets of more than task_rows rows or
    task_bytes of sets meet in pairs of hashed blocks. Pairs that are connected already need no link. Texts without words are never
    duplicates, nor are rows with a null id. An id with several texts goes if any of them is superfluous.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    texts = texts.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    rows = cut(texts.mapInArrow(partial(_banded, k=k, bands=BANDS, band_rows=BAND_ROWS), "id long, digest binary, keys array<long>, sign binary"))
    # equal sets have equal keys, so any row's will do; whole is written, so its numbers stay
    whole = cut(rows.groupBy("digest").agg(F.min("id").alias("first"), F.first("keys").alias("keys"), F.first("sign").alias("sign"))).withColumn("num", F.monotonically_increasing_id())
    points = whole.select("num", F.explode("keys").alias("key"))
    buckets = points.groupBy("key").agg(F.min("num").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(points.join(buckets, "key"))
    # of the texts only those that have a candidate are read again
    asked = members.select("num").distinct().join(whole.select("num", F.col("first").alias("id"), "digest"), "num")
    sets = cut(texts.join(asked, "id").mapInArrow(partial(_sets, k=k), "num long, set binary"))
    if sets.count() > asked.count():  # rows that repeat an id and its text
        sets = cut(sets.dropDuplicates(["num"]))

    pairs = members.where("num <> rep").select(F.col("rep").alias("a"), F.col("num").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("num").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("num").alias("b"), F.col("set").alias("y")), "b")
    found = cut(both.select("a", "b", "x", "y").mapInArrow(partial(_verified, similarity=similarity), "a long, b long"))
    parts = components(found)
    left = members.where("n > 2").join(parts.withColumnRenamed("node", "num"), "num", "left").withColumn("part", F.coalesce("component", "num")).drop("component")
    left = left.join(sets.select("num", F.length("set").alias("bytes")), "num")
    split = left.where("num <> rep").groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.sum("bytes").alias("all_bytes")).where("low < high")
    # as many blocks as half a task's rows, or bytes, ask for
    blocks = F.greatest(F.when(F.col("n") > task_rows, F.ceil(2 * F.col("n") / task_rows)).otherwise(1), F.when(F.col("all_bytes") > task_bytes, F.ceil(2 * F.col("all_bytes") / task_bytes)).otherwise(1))
    left = left.join(split.select("key", "all_bytes"), "key").withColumn("k", blocks.cast("int"))
    left = left.select("key", "num", "rep", "part", "k").join(whole.select("num", "sign", "keys"), "num").join(sets, "num")
    left = left.withColumn("own", F.pmod(F.xxhash64("num"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    left = left.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "num", "rep", "part", "sign", "keys", "set")
    more = cut(left.groupBy("key", "i", "j").applyInArrow(_linked_fn(similarity), "a long, b long"))
    if not more.isEmpty():
        parts = components(found.unionByName(more))
    low = parts.join(whole.select(F.col("num").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("low"))
    low = parts.join(low, "component").select(F.col("node").alias("num"), "low")
    same = rows.select("id", "digest").join(whole.select("digest", "num", "first"), "digest").select("id", "num", "first")
    of = same.join(low, "num", "left").select("id", F.coalesce("low", "first").alias("component_id"))
    return of.where("id <> component_id").groupBy("id").agg(F.min("component_id").alias("component_id")).withColumnRenamed("id", "doc_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the near duplicates: the smallest id of each group stays. Rows that share an id share its fate;
    rows with a null id or no words stay."""
    gone = duplicate_ids(docs, id_col, text_col, **how).select(F.col("doc_id").alias("id"))
    return pack_rows(docs, id_col).join(gone, "id", "left_anti").select("row.*")
