"""Spelling variants against brute force: counts, near words, forms, roots; hash collisions; odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from terrafield.llm import spelling

LONG = "x" * 30_000


def _words(docs):
    out = Counter()
    for i, text in docs:
        for run in __import__("re").findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def _is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _expected(words):
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and _is_near(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(4, 8))) for _ in range(250)] + ["Straße", "naïveté", "×÷xyz", "aaaaa", "aaaaaa", "aaaaaaa", LONG, LONG + "x", LONG[:-1] + "y"]
    out = []
    for i in range(120):
        picked = [w for w in rng.sample(words[:-3], 60) for _ in range(rng.choice([1, 1, 2, 5]))]
        rng.shuffle(picked)
        out.append((i, rng.choice([" ", ", ", "1", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in picked)))
    out += [(500 + k, f"{LONG} {LONG}x {LONG[:-1]}y") for k in range(3)] + [(500, f"{LONG}x"), (None, "abbab " * 50), (7, None), (8, ""), (9, "1234 !")]
    return out


def _frame(spark, docs):
    rows = [(i, t, "x", "y", "z") for i, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, n string, `a.b` string")


def test_variants_equal_brute_force(spark, docs):
    got = [tuple(r) for r in spelling.variants(_frame(spark, docs)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = _expected(_words(docs))
    assert len(got) == len(set(got)) == len(want) and set(got) == want
    assert sum(r[1] is not None and r[2] != r[1] for r in got) > 0  # roots beyond forms


def test_empty_tables(spark, docs):
    assert spelling.variants(_frame(spark, docs).where("false")).count() == 0
    assert spelling.variants(_frame(spark, [(1, None), (2, "ab cd")])).count() == 0


def test_slices_cut_no_run(monkeypatch):
    text = "Wörter und Wörter, " * 50 + "z" * 500
    whole = [r for part in spelling._runs(text) for r in part]
    monkeypatch.setattr(spelling, "_SLICE", 7)
    assert [r for part in spelling._runs(text) for r in part] == whole


def test_keys_are_those_of_the_shorter_word():
    rng = np.random.default_rng(1)
    codes = rng.integers(97, 356, (200, 9))
    keys = spelling.deletion_keys(codes)
    for i in range(9):
        assert np.array_equal(keys[:, i], spelling.deletion_keys(np.delete(codes, i, axis=1))[:, -1])


def test_colliding_keys_are_told_apart_by_strings(monkeypatch, docs):
    """With hashes of a few values nearly all keys collide; the words found stay the same."""
    words = {w: n for w, n in _words(docs).items() if len(w) < 9}
    monkeypatch.setattr(spelling, "_HASHES", ((31, 5), (29, 7)))
    names, ns = list(words), list(words.values())
    keys = pa.Table.from_batches(spelling._keys([pa.RecordBatch.from_arrays([pa.array(range(len(names))), pa.array(names)], ["wid", "word"])]))
    order = [("key", "ascending"), ("place", "ascending")]
    shared = pa.Table.from_batches(spelling._shared(keys.sort_by(order).to_batches(max_chunksize=37)))
    wid = shared.column("wid").to_numpy()
    found = shared.append_column("word", pa.array([names[i] for i in wid])).append_column("n", pa.array([ns[i] for i in wid]))
    rows = pa.Table.from_batches(spelling._verified(found.sort_by(order).to_batches(max_chunksize=41))).to_pylist()
    near = Counter()
    for r in rows:
        near[names[r["wid"]]] += r["near"]
    assert {(r[0], r[4]) for r in _expected(words)} == {(w, near[w]) for w in words}
