"""Toxicity by classifier chains: linear models in sequence, each fed with the earlier categories' probabilities.

The models are trained on a bounded sample of labelled rows. Later models see out-of-fold probabilities of the earlier
ones, so they learn from what those say on unseen texts. Equal texts share a fold.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafield.llm.common import cut, map_whole

#: Labelled rows that the chain is fitted on, at most: those of the smallest hashes of their id.
TRAIN_ROWS = 10_000
#: Columns of the models: the features that tell the labels apart best in that sample.
FEATURES = 1024
FOLDS = 3
#: Words without columns that a task remembers while it scores.
REMEMBERED = 200_000
#: Lengths of the word beginnings that are features beside whole words; inflected forms share them.
PREFIXES = (4, 5, 6)
_TOKEN = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_TOKEN.findall((text or "").lower()))


def word_features(w: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    h = xxhash.xxh3_64_intdigest
    return [h(w), *[h(w[:n] + "~") for n in PREFIXES if len(w) > n]]


def features(text: str | None) -> set[int]:
    """Hashed features of a whole text."""
    return {f for w in words(text) for f in word_features(w)}


@dataclass
class Linear:
    weights: np.ndarray
    bias: float
    chain: np.ndarray  # weights of the earlier probabilities

    def margin(self, rows: np.ndarray, cols: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        return np.bincount(rows, self.weights[cols], n) + self.bias + earlier @ self.chain


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train_linear(rows, cols, n, width, earlier, y, l2: float = 1e-3, rounds: int = 80) -> Linear:
    """Logistic regression on binary sparse features and dense earlier probabilities; Adam on the whole sample, classes balanced."""
    w, b, c = np.zeros(width), 0.0, np.zeros(earlier.shape[1])
    pos = max(1.0, float(y.sum()))
    weight = np.where(y > 0, 0.5 / pos, 0.5 / max(1.0, n - pos))
    m = [np.zeros(width), 0.0, np.zeros_like(c)]
    v = [np.zeros(width), 0.0, np.zeros_like(c)]
    for t in range(1, rounds + 1):
        g = (_sigmoid(np.bincount(rows, w[cols], n) + b + earlier @ c) - y) * weight
        grads = [np.bincount(cols, g[rows], width) + l2 * w, g.sum(), earlier.T @ g + l2 * c]
        steps = []
        for k in range(3):
            m[k] = 0.9 * m[k] + 0.1 * grads[k]
            v[k] = 0.99 * v[k] + 0.01 * grads[k] ** 2
            steps.append(0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-9))
        w, b, c = w - steps[0], b - steps[1], c - steps[2]
    return Linear(w, float(b), c)


@dataclass
class Chain:
    """categories in order; vocab: feature hash -> column; thresholds on the probabilities."""

    categories: list[str]
    vocab: dict[int, int] = field(default_factory=dict)
    models: list[Linear | float] = field(default_factory=list)  # a number: the share of a label that doesn't vary
    thresholds: list[float] = field(default_factory=list)
    plain: set[str] = field(default_factory=set, repr=False)  # words without columns that a task has met

    def columns(self, text: str | None) -> set[int]:
        """The model's columns that a text has; most words have none, which is remembered for a bounded number of them."""
        out: set[int] = set()
        for w in words(text) - self.plain:
            if got := [self.vocab[f] for f in word_features(w) if f in self.vocab]:
                out.update(got)
            elif len(self.plain) < REMEMBERED:
                self.plain.add(w)
        return out

    def matrix(self, sets) -> tuple[np.ndarray, np.ndarray]:
        rows, cols = [], []
        for i, s in enumerate(sets):
            got = [self.vocab[f] for f in s if f in self.vocab]
            rows += [i] * len(got)
            cols += got
        return np.array(rows, np.int64), np.array(cols, np.int64)

    def score_texts(self, texts) -> np.ndarray:
        """Probabilities of whole texts: texts x categories."""
        each = [self.columns(t) for t in texts]
        rows = np.repeat(np.arange(len(each)), [len(e) for e in each])
        return self._chained(rows, np.array([c for e in each for c in e], np.int64), len(each))

    def probabilities(self, sets) -> np.ndarray:
        return self._chained(*self.matrix(sets), len(sets))

    def _chained(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, 0))
        for model in self.models:
            p = np.full(n, model) if isinstance(model, float) else _sigmoid(model.margin(rows, cols, n, out))
            out = np.column_stack([out, p])
        return out


def select(sets, y: np.ndarray, most: int) -> set[int]:
    """The features whose presence tells the classes apart best, see score(); for a sample that fits in memory."""
    pos, neg = Counter(), Counter()
    for s, v in zip(sets, y):
        (pos if v else neg).update(s)
    p, n = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    score = {f: abs(pos[f] / p - neg[f] / n) / np.sqrt((pos[f] + neg[f] + 2) / (p + n)) for f in set(pos) | set(neg) if pos[f] + neg[f] >= 3}
    return set(sorted(score, key=lambda f: (-score[f], f))[:most])


def fit(sets: list[set[int]], labels: np.ndarray, groups: np.ndarray, categories: list[str], folds: int = FOLDS, most: int = FEATURES) -> Chain:
    """The chain on feature sets, labels (rows x categories of 0/1) and groups (equal texts share a number)."""
    keep: set[int] = set()
    for k in range(labels.shape[1]):
        keep |= select(sets, labels[:, k], most // labels.shape[1])
    chain = Chain(list(categories), {f: i for i, f in enumerate(sorted(keep))})
    return fit_matrix(chain, *chain.matrix(sets), labels, groups, folds)


def fit_matrix(chain: Chain, rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, groups: np.ndarray, folds: int = FOLDS) -> Chain:
    """Fits the models of a chain whose vocabulary is chosen; row rows[i] has the feature of column cols[i]."""
    n, width = len(labels), max(1, len(chain.vocab))
    fold = groups % folds
    held = np.zeros((n, 0))
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        oof = np.full(n, y.mean() if n else 0.0)
        if 0 < y.sum() < n:
            for f in range(folds):
                out = fold == f
                if not out.any() or not 0 < y[~out].sum() < (~out).sum():
                    continue
                new = np.cumsum(~out) - 1
                inside = ~out[rows]
                model = train_linear(new[rows[inside]], cols[inside], int((~out).sum()), width, held[~out], y[~out])
                oof[out] = _sigmoid(model.margin(rows, cols, n, held))[out]
            chain.models.append(train_linear(rows, cols, n, width, held, y))
        else:
            chain.models.append(float(oof[0]) if n else 0.0)
        chain.thresholds.append(_threshold(oof, y))
        held = np.column_stack([held, oof])
    return chain


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of the out-of-fold probabilities with the best F1; of equal ones the middle."""
    if not 0 < y.sum() < len(y):
        return 0.5 if not len(y) or y.mean() < 1 else 0.0
    best = [(2 * ((hit := p >= t) & (y > 0)).sum() / (hit.sum() + y.sum()), t) for t in np.linspace(0.2, 0.95, 76)]
    top = max(b[0] for b in best)
    same = [t for s, t in best if s >= top - 1e-12]
    return float(same[len(same) // 2])


def _feature_rows(batches):
    for b in batches:
        texts = b.column("text").to_pylist()
        packed = pa.array([np.array(sorted(features(t)), np.uint64).tobytes() for t in texts], pa.binary())
        group = pa.array([xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) >> 1 for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("id"), packed, group], ["id", "features", "grp"])


def _counted(batches, k):
    """Of a task's rows, how many have each feature: in all, and with each label."""
    for b in batches:
        each = [np.frombuffer(x, np.uint64) for x in b.column("features").to_pylist()]
        names, at = np.unique(np.concatenate(each) if each else np.empty(0, np.uint64), return_inverse=True)
        rows = np.repeat(np.arange(len(each)), [len(e) for e in each])
        cols = [pa.array(names.view(np.int64)), pa.array(np.bincount(at, minlength=len(names)), pa.int64())]
        cols += [pa.array(np.bincount(at, b.column(f"y{j}").to_numpy()[rows], len(names)).astype(np.int64)) for j in range(k)]
        yield pa.RecordBatch.from_arrays(cols, ["feature", "n", *[f"pos{j}" for j in range(k)]])


def _columns(batches, vocab):
    v = vocab.value
    for b in batches:
        got = []
        for x in b.column("features").to_pylist():
            f = np.frombuffer(x, np.uint64)
            at = np.minimum(np.searchsorted(v, f), max(0, len(v) - 1))
            got.append(at[v[at] == f].astype(np.int32).tobytes() if len(v) else b"")
        at = b.schema.get_field_index("features")
        yield b.set_column(at, b.schema.field(at), pa.array(got, pa.binary()))


def score(pos, n, p_all: int, n_all: int) -> F.Column:
    """How well a feature tells a label apart: the difference of its shares among the label's rows and the others,
    over the root of its share in all (the signed root of a chi-square, with a prior for rare features)."""
    share = pos / F.lit(float(max(1, p_all))) - (n - pos) / F.lit(float(max(1, n_all - p_all)))
    return F.abs(share) / F.sqrt((n + 2) / F.lit(float(max(1, n_all))))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, most: int = FEATURES) -> Chain:
    """Fits the chain; categories: name -> SQL condition on a row of `labels`, in the order of the chain.

    Trained on at most train_rows labelled rows, those whose ids have the smallest hashes; rows that repeat an id and its text count
    once. Executors hash their texts' features and count them;
    the driver gets the `most` features that score() finds best and, of the sample's rows, which of these they have.
    Rows without an id, a label or a text are left out. Without labelled rows every probability is 0.
    """
    spark, k = docs.sparkSession, len(categories)
    ys = [f"y{j}" for j in range(k)]
    marks = labels.select(F.col(id_col).cast("long").alias("id"), *[F.expr(c).cast("int").alias(y) for y, c in zip(ys, categories.values())])
    marks = marks.dropna().groupBy("id").agg(*[F.max(y).alias(y) for y in ys])
    marks = marks.orderBy(F.xxhash64("id", F.lit("train")), "id").limit(train_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    texts = texts.join(F.broadcast(marks.select("id")), "id", "left_semi")  # train_rows ids at most
    sample = texts.mapInArrow(_feature_rows, "id long, features binary, grp long").dropDuplicates(["id", "grp"])
    sample = sample.orderBy(F.xxhash64("id", F.lit("train")), "id", "grp").limit(train_rows)
    sample = cut(sample.join(F.broadcast(marks), "id"))
    total = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in ys]).first()
    fields = ", ".join(f"pos{j} long" for j in range(k))
    counts = sample.mapInArrow(partial(_counted, k=k), f"feature long, n long, {fields}")
    counts = cut(counts.groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(f"pos{j}").alias(f"pos{j}") for j in range(k)]).where("n >= 3"))
    best: set[int] = set()
    for j, y in enumerate(ys):
        by = score(F.col(f"pos{j}"), F.col("n"), int(total[y] or 0), int(total.n))
        best |= {x.feature for x in counts.orderBy(by.desc(), "feature").select("feature").limit(most // k).collect()}
    vocab = np.sort(np.array(sorted(best), np.int64).view(np.uint64))
    got = sample.mapInArrow(partial(_columns, vocab=spark.sparkContext.broadcast(vocab)), sample.schema)
    got = got.orderBy("id", "grp").toArrow()
    chain = Chain(list(categories), {f: i for i, f in enumerate(vocab.tolist())})
    each = [np.frombuffer(x, np.int32) for x in got.column("features").to_pylist()]
    if not each:
        return fit_matrix(chain, *[np.empty(0, np.int64)] * 2, np.zeros((0, k)), np.zeros(0, np.int64))
    rows = np.repeat(np.arange(len(each)), [len(e) for e in each])
    y = np.column_stack([got.column(c).to_numpy() for c in ys])
    return fit_matrix(chain, rows, np.concatenate(each).astype(np.int64), y, got.column("grp").to_numpy())


def _scored(batches, chain):
    c = chain.value
    for b in batches:
        texts = b.column("text")
        probs = []
        for s in range(0, b.num_rows, 512):
            probs.append(c.score_texts(texts.slice(s, 512).to_pylist()))
        p = np.concatenate(probs) if probs else np.zeros((0, len(c.categories)))
        cols = [b.column("id")] + [pa.array(p[:, k]) for k in range(p.shape[1])]
        yield pa.RecordBatch.from_arrays(cols, ["id", *[f"p_{x}" for x in c.categories]])


def predict(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category>..., <last category> boolean) of every row, over whole texts, without a shuffle.

    The last category's threshold is the one with the best F1 out of fold. Null and empty texts have no features and get the
    bias of the models. Repeated rows are scored alike; an empty table gives an empty one; other columns aren't read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    fields = ", ".join(f"p_{c} double" for c in chain.categories)
    out = rows.mapInArrow(partial(_scored, chain=docs.sparkSession.sparkContext.broadcast(chain)), f"id long, {fields}")
    last = chain.categories[-1]
    return out.withColumnRenamed("id", "doc_id").withColumn(last, F.col(f"p_{last}") >= F.lit(chain.thresholds[-1]))


def _judged(batches, chain, text_at):
    c = chain.value
    for b in batches:
        texts = b.column(text_at)
        for s in range(0, b.num_rows, 512):
            part = b.slice(s, 512)
            p = c.score_texts(texts.slice(s, 512).to_pylist())[:, -1]
            yield part.filter(pa.array(p < c.thresholds[-1]))


def drop_toxic(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """docs without the rows that the chain's last category rejects; columns stay, whatever their names.

    Whole texts are judged where they are read, without a shuffle. Null and empty texts have no features: they stay unless the
    model's bias alone rejects them. Repeated rows share their fate; an empty table stays empty; an id isn't needed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    return map_whole(docs, partial(_judged, chain=shared, text_at=docs.columns.index(text_col)))
