"""Spelling variants: words that differ by one inserted, deleted or replaced character, found by hashes of their deletions.

The polynomial hashes of a word's prefixes and suffixes give the hash of the word without its i-th character in a few vectorised steps. Two
words differ by a replacement if they agree without the character at one place, and by an insertion if one of them is the other without a
character, so equal keys are candidates. Keys travel without words: they are dealt by their leading digit, sorted, and those that no other word
shares are dropped. What is left gets its words, and strings decide. A group of equal strings has at most (length + 1) members per letter of
the alphabet, and its members are summed up (how many others, the best of them), so no pairs are written.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafield.llm.common import cut

RUN = re.compile("[a-zÀ-ÿ]+")
#: Shortest word, fewest occurrences, and how many times as frequent as a word its form is.
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: One run in so many of a document loses a character, as a check of the method.
DROP = 97
#: Moduli and bases of the two hashes; a key has 31 bits of each.
_HASHES = (((1 << 31) - 1, 911_382_323), ((1 << 31) - 19, 972_663_749))
_SLICE = 1 << 20  # characters of a text that are cut into runs at once
_HELD = 1 << 18  # counts that a task holds
_CHARS = 1 << 20  # characters of words whose keys are made at once
_DIGITS = 1 << 16  # values of a key's leading digit
FULL = -1  # the place of a whole word among its deletions


def _runs(text: str):
    """Lists of the runs of a text whose A-Z are lower-cased, slice by slice; a slice ends where a run does."""
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    at = 0
    while at < len(text):
        end = min(len(text), at + _SLICE)
        if end < len(text) and (m := RUN.match(text, end)):
            end = m.end()
        yield RUN.findall(text, at, end)
        at = end


def word_counts(doc_id, text: str | None) -> Counter:
    """How often each word results from a document: its runs, some without a character as the rule of DROP says; short ones are left out."""
    runs = Counter()
    for part in _runs(text or ""):
        runs.update(part)
    out = Counter()
    name = b"%d:" % doc_id if doc_id is not None else b":"
    for run, n in runs.items():
        h = zlib.crc32(name + run.encode())
        if h % DROP == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        if len(run) >= LEAST_LENGTH:
            out[run] += n
    return out


def _counted(batches):
    held = Counter()

    def flush():
        words, n = list(held), list(held.values())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    for b in batches:
        for i, text in zip(b.column("id").to_pylist(), b.column("text")):
            held.update(word_counts(i, text.as_py()))
            if len(held) >= _HELD:
                yield flush()
    yield flush()


def deletion_keys(codes: np.ndarray) -> np.ndarray:
    """words x (length + 1) keys of equally long words (codes: words x length): that of the word without its i-th character, the whole word's last."""
    m, size = codes.shape
    out = np.zeros((m, size + 1), np.int64)
    for p, base in _HASHES:
        before = np.zeros((m, size + 1), np.int64)  # of the first i characters
        after = np.zeros((m, size + 1), np.int64)  # of the characters from i on
        power = np.ones(size + 1, np.int64)
        for i in range(size):
            before[:, i + 1] = (before[:, i] * base + codes[:, i]) % p
            power[i + 1] = power[i] * base % p
        for i in range(size - 1, -1, -1):
            after[:, i] = (codes[:, i] * power[size - 1 - i] + after[:, i + 1]) % p
        own = (before[:, :size] * power[size - 1 :: -1][None] + after[:, 1:]) % p if size else np.zeros((m, 0), np.int64)
        out = (out << 31) | np.concatenate([own, before[:, size:]], axis=1)
    return out


def _keys(batches):
    names = ["key", "place", "first", "wid"]
    for b in batches:
        words, ids = np.array(b.column("word").to_pylist(), object), b.column("wid").to_numpy()
        sizes = np.array([len(w) for w in words], np.int64)
        for size in np.unique(sizes):
            same = np.nonzero(sizes == size)[0]
            step = max(1, _CHARS // int(size))
            for s in range(0, len(same), step):
                rows = same[s : s + step]
                codes = np.frombuffer("".join(words[rows]).encode("utf-32-le"), np.uint32).reshape(len(rows), size).astype(np.int64)
                keys = deletion_keys(codes)
                first = np.ones(keys.shape, bool)  # of several places whose deletions are one string, the first
                first[:, 1:size] = codes[:, 1:] != codes[:, :-1]
                place = np.tile(np.append(np.arange(size, dtype=np.int32), np.int32(FULL)), len(rows))
                cols = [pa.array(keys.ravel()), pa.array(place), pa.array(first.ravel()), pa.array(np.repeat(ids[rows], size + 1))]
                yield pa.RecordBatch.from_arrays(cols, names)


def _by_key(batches):
    """The batches of a partition sorted by key, cut so that no key lies in two."""
    kept = None
    for b in batches:
        t = pa.Table.from_batches([b])
        kept = t if kept is None else pa.concat_tables([kept, t])
        key = kept.column("key").to_numpy()
        if len(key) == 0 or key[0] == key[-1]:
            continue
        at = int(np.searchsorted(key, key[-1]))
        yield kept.slice(0, at).combine_chunks()
        kept = kept.slice(at).combine_chunks()
    if kept is not None and kept.num_rows:
        yield kept.combine_chunks()


def _shared(batches):
    """Rows whose key another word has, too: at their place, or where one of both is a whole word."""
    for t in _by_key(batches):
        key, place, first, wid = (t.column(c).to_numpy() for c in ("key", "place", "first", "wid"))
        if not len(key):
            continue
        # rows come by key and place, whole words first; ids that follow one another in a group tell whether it has several
        new_key = np.append(True, key[1:] != key[:-1])
        new_place = new_key | np.append(True, place[1:] != place[:-1])
        g, h = np.cumsum(new_key) - 1, np.cumsum(new_place) - 1

        def several(new, of):
            edges = np.nonzero(new)[0]
            return (np.minimum.reduceat(wid, edges) < np.maximum.reduceat(wid, edges))[of]

        whole = np.zeros(g[-1] + 1, bool)
        whole[g[place == FULL]] = True
        keep = ((place != FULL) & several(new_place, h)) | (whole[g] & first & several(new_key, g))
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (key, place, first, wid)], ["key", "place", "first", "wid"])


def _verified(batches):
    """Per word and group of equal strings: how many near words it has there, and the best of them."""
    for t in _by_key(batches):
        out = []
        key = t.column("key").to_numpy()
        edges = np.append(np.nonzero(np.append(True, key[1:] != key[:-1]))[0], len(key)) if len(key) else [0]
        place, wid, word, n = (t.column(c).to_pylist() for c in ("place", "wid", "word", "n"))
        for a, z in zip(edges[:-1], edges[1:]):
            groups: dict = {}
            for r in range(a, z):
                w, i = word[r], place[r]
                groups.setdefault(w if i == FULL else w[:i] + w[i + 1 :], []).append(r)
            for rows in groups.values():
                if len(rows) > 1:
                    out += _near(rows, place, wid, word, n)
        names = ["wid", "near", "form", "form_n"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, kinds)], names)


def _near(rows, place, wid, word, n):
    """Near words among rows whose strings are one: those of one place are replacements, a whole word and the rest insertions."""
    best = lambda r: (-n[r], word[r])
    whole = next((r for r in rows if place[r] == FULL), None)
    out, at = [], {}
    for r in rows:
        if place[r] != FULL:
            at.setdefault(place[r], []).append(r)
    for same in at.values():
        if len(same) > 1:
            top = sorted(same, key=best)[:2]
            for r in same:
                other = top[1] if r == top[0] else top[0]
                out.append((wid[r], len(same) - 1, word[other], n[other]))
    if whole is not None:
        longer = list({wid[r]: r for r in rows if place[r] != FULL}.values())
        if longer:
            top = min(longer, key=best)
            out.append((wid[whole], len(longer), word[top], n[top]))
            out += [(wid[r], 1, word[whole], n[whole]) for r in longer]
    return out


def words_of_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of LEAST_LENGTH characters and LEAST_COUNT occurrences at least; counted in the tasks before they are shuffled."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): forms are followed to the last one by doubling; a form is more frequent, so there are no rings."""
    at = cut(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("above"))
        new = cut(at.join(up, "root").select("word", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
        at = new.select("word", "root")
        if new.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus, see words_of_corpus.

    Near words differ by one inserted, deleted or replaced character. A word's form is the most frequent near word (ties: the smallest by code
    points) if that is TIMES as frequent at least, else null; root follows forms to the last.
    Null texts have no words; a null id counts as an empty one in the rule of DROP; rows that repeat an id are documents of their own; other columns aren't
    read; an empty table gives an empty one. Very long texts are cut into runs slice by slice; a very long word gives a key per character, and
    travels with those alone that another word shares.
    """
    words = cut(words_of_corpus(docs, id_col, text_col)).withColumn("wid", F.monotonically_increasing_id())
    fields = "key long, place int, first boolean, wid long"
    dealt = lambda rows: rows.repartition(F.pmod("key", F.lit(_DIGITS))).sortWithinPartitions("key", "place")
    shared = dealt(words.select("wid", "word").mapInArrow(_keys, fields)).mapInArrow(_shared, fields)
    found = shared.join(words, "wid").select("key", "place", "wid", "word", "n")
    near = dealt(found).mapInArrow(_verified, "wid long, near long, form string, form_n long")
    per = near.groupBy("wid").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    best_n = -F.col("best.less")
    far = F.coalesce(best_n >= TIMES * F.col("n"), F.lit(False))
    every = words.join(per, "wid", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.form")).alias("form"), F.when(far, best_n).alias("form_n")
    )
    every = cut(every)
    return every.join(roots(every), "word").select("word", "form", "root", "n", "n_near", "form_n")
