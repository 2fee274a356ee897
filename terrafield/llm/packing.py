"""Hierarchical multi-length packing of documents into context windows.

Full windows are cut off long documents; what remains is routed to the tier of the smallest context size that holds it.
Tiers are packed from the longest: a window starts with a document of its own tier, its gap is filled from shorter
tiers, the best fit first, and what no whole document fits is filled with a piece cut from a shorter one. With nothing
left to cut from, the window itself is cut into full windows of shorter tiers. Each task packs the documents it
reads, so no token is shuffled, and a lost task is simply run again. Windows of a tier are numbered over all tasks, so that
step groups are full ones, whatever the tasks: of each tier only the last is short.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafield.llm.common import cut

#: Context sizes. All are powers of two, so a full window of any tier needs no padding.
TIERS = (1024, 512, 256, 128, 64)
END = 0
#: Tokens of a training step: every step group holds windows of one tier with this many tokens.
STEP_TOKENS = 8192
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, task int, number long"
#: How texts are cut before merges. Fixed value: the tokenizer file names this rule ("ByteLevel", without a leading space) and doesn't spell it out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space as the rule of PATTERN takes it, and how much of it the engine's rule isn't given: it backs up over a run, character by character.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_BLANK = re.compile(f"[{_BLANK}]{{4096,}}")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The ids that the tokenizer file at `path` gives, from a faster engine for its vocabulary and rules.

    The file's merges are read into ranks; that both engines agree on every code point is tested. A file with other rules
    (a normalizer, another way to cut texts, another kind of model) is refused.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain_rules = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback") if model.get(k)]
    if spec.get("normalizer") or not plain_rules or model.get("type") != "BPE" or odd:
        raise ValueError(f"{path}: not a byte-level BPE of the plain rules")
    # byte-level alphabet: printable bytes stand for themselves, the rest follow from U+0100
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("terrafield", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of a text and the end id; null is an empty text."""
    engine = encoder(path)
    if not text:
        ids = []
    elif _LONG_BLANK.search(text):
        ids = _ids_around_blanks(engine, text)
    else:
        ids = engine.encode(text, allowed_special="all")
    ids.append(END)
    return np.array(ids, np.uint32)


def _ids_around_blanks(engine, text: str) -> list[int]:
    """Ids of a text with long runs of white space. By the rule a run is one piece but for its last character, if more text follows; so it
    is cut off there and merged by itself. Special tokens end a text as its end does."""
    special = sorted(engine.special_tokens_set, key=len, reverse=True)
    parts = re.split("(" + "|".join(map(re.escape, special)) + ")", text) if special else [text]
    ids = []
    for k, part in enumerate(parts):
        if k % 2:
            ids.append(engine.encode_single_token(part))
            continue
        at = 0
        for m in _LONG_BLANK.finditer(part):
            end = m.end() - (m.end() < len(part))
            ids += engine.encode(part[at : m.start()], disallowed_special=())
            ids += engine._encode_single_piece(part[m.start() : end])
            at = end
        ids += engine.encode(part[at:], disallowed_special=())
    return ids


class Packer:
    """Packs pieces (doc, ids from, ids to) into windows; keeps unfinished shorter pieces between batches."""

    def __init__(self, emit, tiers=TIERS):
        self.tiers, self.top, self.emit = tiers, tiers[0], emit
        self.free = defaultdict(list)  # length -> pieces
        self.mask = 0  # bit n: pieces of length n are there

    def put(self, piece) -> None:
        n = piece[2] - piece[1]
        if n:
            self.free[n].append(piece)
            self.mask |= 1 << n

    def take(self, most: int, least: int = 1):
        """The longest piece of least..most ids, or None."""
        n = (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1
        if n < least:
            return None
        got = self.free[n].pop()
        if not self.free[n]:
            self.mask ^= 1 << n
        return got

    def add(self, doc, n: int, rest=None) -> None:
        """A document of n ids; what doesn't fill windows waits under the name rest(first id), `doc` if there is none."""
        whole = n - n % self.top
        for s in range(0, whole, self.top):
            self.emit(self.top, [(doc, s, s + self.top)])
        if whole < n:
            self.put((rest(whole) if rest else doc, whole, n))

    def pack(self, last: bool) -> None:
        """Packs every tier; before the last call the shortest tier is kept as filling for later windows."""
        for k, size in enumerate(self.tiers):
            below = self.tiers[k + 1] if k + 1 < len(self.tiers) else 0
            if not below and not last:
                return
            while first := self.take(size, below + 1):
                window, gap = [first], size - (first[2] - first[1])
                while gap and (more := self.take(gap)):
                    window.append(more)
                    gap -= more[2] - more[1]
                if gap and (more := self.take(below or size)):  # longer than the gap: cut it
                    window.append((more[0], more[1], more[1] + gap))
                    self.put((more[0], more[1] + gap, more[2]))
                    gap = 0
                if not gap:
                    self.emit(size, window)
                elif below:  # nothing shorter is left: cut this window down
                    self._cut_down(window, below)
                else:
                    self.emit(size, window)  # the last, padded window of the task

    def _cut_down(self, window, below: int) -> None:
        part, room = [], below
        for doc, s, e in window:
            n = min(room, e - s)
            if n:
                part.append((doc, s, s + n))
            self.put((doc, s + n, e))
            room -= n
        if room:
            for p in part:
                self.put(p)
        else:
            self.emit(below, part)


def _packed(batches, path, text_at_once=4 << 20):
    task = TaskContext.get().partitionId()
    base = task << 40
    count = [0]
    per_tier = defaultdict(int)
    out = []

    def emit(size, window):
        seq = base + count[0]
        count[0] += 1
        number = per_tier[size]  # of the window among those of its tier in this task
        per_tier[size] += 1
        at = 0
        for (i, ids, n, first), s, e in window:
            out.append((i, s, e - s, zlib.crc32(ids[s - first : e - first].tobytes()), n, seq, at, size, task, number))
            at += e - s

    packer = Packer(emit)

    def flush():
        cols = list(zip(*out)) if out else [[]] * 10
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int32(), pa.int64()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    for b in batches:
        size = 0
        for i, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
            text = text.as_py()
            ids = token_ids(text, path).astype("<u4")
            # what waits is a copy of its own ids, so that no long document is kept for a short rest
            packer.add((i, ids, len(ids), 0), len(ids), lambda s, i=i, ids=ids: (i, ids[s:].copy(), len(ids), s))
            size += len(ids)
            if size >= text_at_once or len(out) > 200_000:
                packer.pack(False)
                yield flush()
                size = 0
        packer.pack(False)
        yield flush()
    packer.pack(True)
    yield flush()


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every row's ids (END included), a row each: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and the window's tier and step group.

    A sequence holds tier ids, but for the last of a task, which is padded to 1024. A step group holds STEP_TOKENS tokens of one tier;
    the last group of each tier may be short. Null and empty texts are the END id
    alone. Rows with equal or null ids are documents of their own. Memory: the ids of one Arrow batch and the pieces
    of the shortest tier that wait for a gap; a very long text is cut at once. An empty table gives no pieces. Other
    columns aren't read. The pieces (not the texts) are written once, to number the windows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = cut(rows.mapInArrow(partial(_packed, path=tokenizer_path), SCHEMA))
    # windows of each tier in each task: a row per task and tier
    earlier = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tops = pieces.groupBy("tier", "task").agg((F.max("number") + 1).alias("n"))
    tops = tops.select("tier", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    step = F.floor((F.col("before") + F.col("number")) * F.col("tier") / STEP_TOKENS)
    tier_no = F.element_at(F.create_map(*[F.lit(x) for k, t in enumerate(TIERS) for x in (t, k)]), F.col("tier"))
    return pieces.join(tops, ["tier", "task"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", (F.shiftleft(tier_no.cast("long"), 56) + step).alias("step_group")
    )
