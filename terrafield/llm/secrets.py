"""Secret scans: wide candidate patterns, then a random forest that removes the false positives.

The forest sees a candidate's length, its character transitions, how much of it dictionary words cover, whether it
looks like a path, and the words beside it. It is trained from labelled findings: (text, start, end, secret?) rows. A
labelled set is generated here from public key formats and from what scanners take for keys by mistake.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafield.llm.common import map_whole

#: Labelled findings that a forest is trained on, at most.
TRAIN_FINDINGS = 20_000
BESIDE = 48
#: Characters of a value that is assigned to a telling name, at least.
LEAST_ASSIGNED = 6

# Public formats of keys, words that stand beside secrets and beside harmless tokens, and placeholders.
FORMATS = {
    "aws_access_key": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack_token": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "google_api_key": r"AIza[A-Za-z0-9_\-]{35}",
    "jwt": r"(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}",
    # a whole block, its headers included; without an end its headers and its lines of 16 characters or more
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----(?:(?:(?!-----BEGIN)[\s\S])*?-----END [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----|(?:\s*(?:Proc-Type|DEK-Info|Version|Comment):[^\r\n]*)*(?:\s*[A-Za-z0-9+/=]{16,})*)",
}
SECRET_WORDS = "password passwd pwd pass secret token key apikey auth bearer credential credentials private signature".split()
HARMLESS_WORDS = "sha sha1 sha256 md5 commit checksum hash digest uuid guid etag revision example sample id ref isbn order invoice version".split()
PLACEHOLDERS = "your example sample changeme placeholder dummy test xxxx todo none null foo bar".split()
DICTIONARY = (
    "the and for that with this from have not are was you your all can has but what when time there which their will would about "
    "into other than then them these some like could people only over know just first year good work name file path user home data "
    "page image index main test value class function return string number service client server config default public static method "
    "object model table column error message request response content system local cache access account order report "
    "nicht eine einer auch sich oder werden wurde haben durch nach über unter zwischen seite datei name jahr "
    "dans pour avec cette sont plus elle nous vous leur entre sans fichier page année nom "
    "para como pero este esta entre sobre desde hasta cuando archivo página nombre año todos"
).split()

#: Beginnings of the formats: a text without any of them needs no search for formats.
MARKS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "eyJ", "PRIVATE KEY")
NAMES = ("pass", "pwd", "secret", "token", "key", "credential")

_FORMAT = re.compile("|".join(f"(?P<{k}>{v})" for k, v in FORMATS.items()))
# a quoted value goes to its quote on the same line, another one to white space, but for what closes a sentence or a call and for a query's next field
_ASSIGNED = re.compile(
    r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|access_?key|auth_?key|private_?key|secret_?key|credentials?)[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}"
    r"(?:\"([^\"\r\n]+)\"|'([^'\r\n]+)'|`([^`\r\n]+)`|[\"'`]?([^\s\"'`]\S*))"
)
_NEXT_FIELD = re.compile(r"&(?:amp;)?[A-Za-z_][A-Za-z0-9_.\-]*=")
_CLOSERS = "\"'`.,;:)]}>"
# the last @ before the host's end closes a password; one that holds / ? or # goes on to an @ with a host behind it, unless a port stands there
_IN_URL = re.compile(
    r"(?<![A-Za-z0-9+.\-])[A-Za-z][A-Za-z0-9+.\-]*://[^\s/:@?#]*:"
    r"(?:([^\s/?#\"'<>]+)@(?=[A-Za-z0-9\[])|(?!\d{1,5}[/?#])((?:(?!://)[^\s@\"'<>])+)@(?=[A-Za-z0-9\[]))"
)
_BARE = re.compile(r"(?<![A-Za-z0-9_+/=\-.])[A-Za-z0-9_+/=\-]{16,}(?![A-Za-z0-9_+/=\-])")
_DIGIT = re.compile("[0-9]")
_WORDS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])")


def candidates(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of everything that might be a secret, in the order of the text, without overlaps.

    Known formats come first, then passwords within urls, then values of LEAST_ASSIGNED characters or more that are assigned to a telling name, then bare
    runs of 16 characters or more with a digit; what overlaps an earlier find is left out. Shorter values are too like words to be told apart.
    Cheap tests tell which searches a text needs; each takes time in proportion to the text.
    """
    if not text:
        return []
    out = []
    if any(m in text for m in MARKS):
        out.append([(*m.span(), m.lastgroup) for m in _FORMAT.finditer(text)])
    if "://" in text and "@" in text:
        out.append([(*m.span(m.lastindex), "in_url") for m in _IN_URL.finditer(text)])
    low = text.lower()
    if any(n in low for n in NAMES):
        out.append([x for m in _ASSIGNED.finditer(text) if (x := _assigned(text, m))])
    if _DIGIT.search(text):
        out.append([(*m.span(), "bare") for m in _BARE.finditer(text) if _DIGIT.search(m.group())])
    kept = []
    for found in out:
        kept = _with(kept, found)
    return kept


def _assigned(text: str, m: re.Match) -> tuple[int, int, str] | None:
    s, e = m.span(m.lastindex)
    if m.lastindex == 4:
        if cut := _NEXT_FIELD.search(text, s, e):
            e = cut.start()
        bare = text[s:e].rstrip(_CLOSERS)
        e = s + len(bare)
    return (s, e, "assigned") if e - s >= LEAST_ASSIGNED else None


def _with(kept, found):
    """Two lists of intervals, each in order and without overlaps, as one: what overlaps one of `kept` is left out."""
    out, k = [], 0
    for f in found:
        while k < len(kept) and kept[k][1] <= f[0]:
            out.append(kept[k])
            k += 1
        if k == len(kept) or kept[k][0] >= f[1]:
            out.append(f)
    return out + kept[k:]


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


@lru_cache(maxsize=1)
def _dictionary() -> re.Pattern:
    return re.compile("|".join(sorted({w for w in DICTIONARY if len(w) > 3}, key=len, reverse=True)))


#: Names of the features of a candidate, in order.
FEATURES = (
    "length transitions digits upper lower other entropy hex all_digits dictionary longest_word path separators "
    "known_format assigned secret_word harmless_word placeholder dashes_as_uuid equals_end repeats"
).split()


def describe(text: str, start: int, end: int, kind: str) -> list[float]:
    """The features of a candidate in its text."""
    v = text[start:end]
    n = max(1, len(v))
    kinds = [_kind(c) for c in v]
    counts = Counter(v)
    low = v.lower()
    before = text[max(0, start - BESIDE) : start].lower()
    after = text[end : end + BESIDE].lower()
    beside = re.findall(r"[a-z0-9]+", before)[-4:] + re.findall(r"[a-z0-9]+", after)[:2]
    covered = sum(len(m) for m in _dictionary().findall(low))
    words = [len(w) for w in _WORDS.findall(v)]
    return [
        n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        kinds.count(2) / n,
        kinds.count(1) / n,
        kinds.count(0) / n,
        kinds.count(3) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        float(all(c in "0123456789abcdef" for c in low)),
        float(v.isdigit()),
        covered / n,
        max(words, default=0) / n,
        float(bool(re.search(r"^(?:https?:|\.{0,2}/|[A-Za-z]:\\)|\.(?:html?|png|jpe?g|js|css|py|txt|json)$", low)) or v.count("/") >= 3),
        sum(v.count(c) for c in "/-_."),
        float(kind in FORMATS),
        float(kind in ("assigned", "in_url")),
        float(any(w in SECRET_WORDS for w in beside)),
        float(any(w in HARMLESS_WORDS for w in beside)),
        float(any(p in low for p in PLACEHOLDERS)),
        float(bool(re.fullmatch(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", low))),
        float(v.endswith("=")),
        max(counts.values()) / n,
    ]


# ----------------------------------------------------------------------------- random forest


class Forest:
    """Trees as arrays; a leaf's feature is -1 and its value the share of secrets among its training rows."""

    def __init__(self, trees):
        self.trees = trees

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, kids, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                i = np.nonzero(inner)[0]
                right = x[i, feature[at[i]]] > cut[at[i]]
                at[i] = kids[at[i], right.astype(int)]
            out += value[at]
        return out / max(1, len(self.trees))


def train_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, least: int = 3, seed: int = 5) -> Forest:
    """CART trees on bootstrap samples, each split among sqrt(features) of them by the Gini impurity."""
    rng = np.random.default_rng(seed)
    few = max(1, round(math.sqrt(x.shape[1])))
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(x), len(x))
        feature, cut, kids, value = [], [], [], []
        todo = [(rows, 0, -1, 0)]
        while todo:
            r, level, parent, side = todo.pop()
            at = len(feature)
            feature.append(-1)
            cut.append(0.0)
            kids.append([0, 0])
            value.append(float(y[r].mean()))
            if parent >= 0:
                kids[parent][side] = at
            if level == depth or len(r) < 2 * least or value[at] in (0.0, 1.0):
                continue
            best = (1e-12, -1, 0.0)
            total = value[at] * (1 - value[at]) * len(r)
            for f in rng.choice(x.shape[1], few, replace=False):
                order = np.argsort(x[r, f], kind="stable")
                xs, ys = x[r[order], f], np.cumsum(y[r[order]])
                k = np.arange(least, len(r) - least + 1)
                k = k[xs[k - 1] < xs[np.minimum(k, len(r) - 1)]]
                if not len(k):
                    continue
                left = ys[k - 1]
                gini = left * (1 - left / k) + (ys[-1] - left) * (1 - (ys[-1] - left) / (len(r) - k))
                j = int(gini.argmin())
                if total - gini[j] > best[0]:
                    best = (total - gini[j], int(f), (xs[k[j] - 1] + xs[k[j]]) / 2)
            if best[1] >= 0:
                feature[at], cut[at] = best[1], best[2]
                go = x[r, best[1]] > best[2]
                todo += [(r[go], level + 1, at, 1), (r[~go], level + 1, at, 0)]
        out.append((np.array(feature), np.array(cut), np.array(kids), np.array(value)))
    return Forest(out)


def labelled_findings(n: int = 6000, seed: int = 17) -> list[tuple[str, bool]]:
    """(text with one finding, secret?) rows made from public formats and usual mistakes; drawn with a fixed seed."""
    r = random.Random(seed)
    pick = lambda abc, k: "".join(r.choice(abc) for _ in range(k))
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    weak, schemes = "hunter letmein dragon monkey qwerty welcome summer winter iloveu".split(), ["https", "http", "ftp", "postgres", "redis", "amqp", "mongodb+srv"]
    prose = lambda: " ".join(r.choice(DICTIONARY) for _ in range(r.randint(0, 6)))
    name = lambda: r.choice(["password", "passwd", "token", "api_key", "secret", "access_key", "db_password", "auth_key", "client_secret", "apikey", "private_key", "SECRET_KEY"])

    def assign(value):
        q = r.choice(["", '"', "'"])
        return f"{name()}{r.choice(['=', ' = ', ': ', ':'])}{q}{value}{q}"

    secrets = [
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        lambda: "ghp_" + pick(alnum, 36),
        lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24),
        lambda: "AIza" + pick(alnum + "_-", 35),
        lambda: "eyJ" + pick(alnum, 20) + ".eyJ" + pick(alnum, 30) + "." + pick(alnum, 30),
        lambda: assign(pick(hexa, r.choice([16, 18, 20, 24, 32, 40, 64]))),
        lambda: assign(pick(alnum, r.randint(10, 44))),
        lambda: assign(pick(alnum + "!@#$%^&*", r.randint(8, 24))),
        lambda: assign(pick(string.ascii_lowercase, r.randint(3, 6)) + pick(string.digits + "!_", r.randint(3, 8))),
        lambda: assign(r.choice(DICTIONARY + weak) + pick(string.digits + "!", r.randint(1, 4))),
        lambda: assign(pick(string.ascii_lowercase, r.randint(5, 8)) + pick(string.digits, 1) + r.choice(["", "!", "#"])),
        lambda: f"{r.choice(schemes)}://{r.choice(DICTIONARY)}:{pick(alnum, r.randint(6, 24))}@{r.choice(DICTIONARY)}.example.com/{r.choice(DICTIONARY)}",
        lambda: f"{r.choice(schemes)}://{r.choice(DICTIONARY)}:{r.choice(DICTIONARY + weak)}{pick(string.digits, r.randint(1, 3))}@{r.choice(DICTIONARY)}",
        lambda: f"{r.choice(schemes)}://{r.choice(DICTIONARY)[0]}:{pick(alnum + '/@#?', r.randint(6, 16))}{pick(string.digits, 1)}@{r.choice(DICTIONARY)}",
        lambda: f'{name()} = "{" ".join(r.choice(DICTIONARY) for _ in range(r.randint(2, 4)))} {pick(string.digits, r.randint(1, 3))} {pick(alnum, r.randint(1, 3))}"',
        lambda: assign(pick(alnum, r.randint(3, 9)) + r.choice(",;&<>") + pick(alnum + ",;", r.randint(4, 12)) + pick(string.digits, 1)),
        lambda: r.choice(SECRET_WORDS) + " " + pick(alnum + "+/", 40),
        lambda: pick(alnum + "+/", r.randint(32, 60)) + r.choice(["", "="]),
    ]
    harmless = [
        lambda: r.choice(["sha256", "md5", "commit", "checksum", "revision", "etag"]) + r.choice([" ", ": ", "="]) + pick(hexa, r.choice([32, 40, 64])),
        lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)),
        lambda: pick(string.digits, r.randint(16, 22)),
        lambda: "/" + "/".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 6))) + "/" + pick(string.digits, 4) + r.choice([".html", ".png", ""]),
        lambda: r.choice("-_").join(r.choice(DICTIONARY) for _ in range(r.randint(3, 6))) + r.choice("-_") + pick(string.digits, r.randint(1, 4)),
        lambda: assign(r.choice(["changeme123", "your_api_key_here", "YOUR-TOKEN-HERE", "xxxxxxxxxxxx", "example_password", "<placeholder>", "********", "test1234", "${SECRET}", "os.environ", "None", "null"])),
        lambda: f"{r.choice(schemes)}://{r.choice(['user', 'username', 'name'])}:{r.choice(['password', 'pass', '${PASS}', '****', '<password>', 'your_password', '$TOKEN', '{token}'])}@{r.choice(DICTIONARY)}",
        lambda: assign(r.choice(DICTIONARY) + r.choice(DICTIONARY) + r.choice(["()", ".get", "[0]", ""])),
        lambda: f'{name()}: "{" ".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 7)))}"',
        lambda: f"{name()}: " + r.choice(["string", "required", "optional", "strings", "function", "default"]),
        lambda: r.choice(["order", "invoice", "ref", "id", "isbn"]) + " " + pick(string.digits, r.randint(4, 8)) + "-" + pick(string.digits, r.randint(8, 12)),
        lambda: "20" + pick("0123", 2) + "-" + pick("0123456789", 2) + "-" + pick("0123", 2) + "T" + pick("012345", 2) + pick("012345", 4) + "-" + pick("0", 4),
        lambda: r.choice(DICTIONARY).title() + r.choice(DICTIONARY).title() + r.choice(DICTIONARY).title() + r.choice(DICTIONARY).title() + pick(string.digits, 2),
        lambda: "=" * r.randint(16, 40) + pick(string.digits, 1) + "-" * r.randint(4, 20),
    ]
    rows = []
    for k in range(n):
        good = k % 2 == 0
        rows.append((f"{prose()} {r.choice(secrets if good else harmless)()} {prose()}", good))
    return rows


def training_matrix(rows) -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for text, secret in rows:
        for c in candidates(text):
            x.append(describe(text, *c))
            y.append(float(secret))
    return np.array(x[:TRAIN_FINDINGS]), np.array(y[:TRAIN_FINDINGS])


def forest_of(findings: DataFrame) -> Forest:
    """A forest from labelled findings(text, start, length, is_secret), at most TRAIN_FINDINGS of them, by a hash of the text."""
    rows = findings.where("text is not null and start is not null and length is not null and is_secret is not null")
    rows = rows.orderBy(F.xxhash64("text", "start"), "start").limit(TRAIN_FINDINGS)
    x, y = [], []
    for r in rows.select("text", "start", "length", "is_secret").toLocalIterator():
        kind = next((k for s, e, k in candidates(r.text) if s < r.start + r.length and e > r.start), "bare")
        x.append(describe(r.text, r.start, r.start + r.length, kind))
        y.append(float(r.is_secret))
    if not x:
        raise ValueError("no labelled findings")
    return train_forest(np.array(x), np.array(y))


def default_forest() -> Forest:
    return train_forest(*training_matrix(labelled_findings()))


# ----------------------------------------------------------------------------- scans


def judged(text: str | None, forest: Forest, threshold: float) -> list[tuple[int, int, str, float, bool]]:
    found = candidates(text)
    if not found:
        return []
    p = forest.score(np.array([describe(text, *c) for c in found]))
    return [(s, e, k, float(q), bool(q >= threshold)) for (s, e, k), q in zip(found, p)]


def value_hash(value: str, key: bytes) -> str:
    """A keyed digest of a finding: equal ones agree, and a short one can't be guessed without the key."""
    return hashlib.blake2b(value.encode("utf-8", "surrogatepass"), key=key, digest_size=16).hexdigest()


def _scan(batches, forest, threshold, key):
    for b in batches:
        rows = []
        for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
            rows += [(i, s, e - s, k, value_hash(t[s:e], key), q, ok) for s, e, k, q, ok in judged(t, forest.value, threshold)]
        cols = list(zip(*rows)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "start", "length", "kind", "value_hash", "score", "is_secret"])


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", key: bytes = b"") -> DataFrame:
    """Every candidate of every text with its verdict: (doc_id, start, length, kind, value_hash, score, is_secret).

    start and length count characters. The value itself isn't returned, its digest under `key` tells equal ones. False positives are rows
    with is_secret false. Null and empty texts have no candidates; rows with a null id are scanned like others; repeated rows
    give repeated findings; an empty table gives none. Texts are scanned whole, where they are read: no shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(forest or default_forest())
    return rows.mapInArrow(partial(_scan, forest=shared, threshold=threshold, key=key), "doc_id long, start long, length long, kind string, value_hash string, score double, is_secret boolean")


def _masked(batches, forest, threshold, text_at, length_at):
    for b in batches:
        texts = []
        for t in b.column(text_at).to_pylist():
            for s, e, k, _, ok in reversed(judged(t, forest.value, threshold)):
                if ok:
                    t = f"{t[:s]}[{k.upper()}]{t[e:]}"
            texts.append(t)
        b = b.set_column(text_at, b.schema.field(text_at), pa.array(texts, b.schema.field(text_at).type))
        if length_at is not None:
            n = pa.array([None if t is None else len(t) for t in texts], b.schema.field(length_at).type)
            b = b.set_column(length_at, b.schema.field(length_at), n)
        yield b


def mask_secrets(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with every secret replaced by [KIND]; all rows and columns stay, the length column follows the text.

    Secrets of any length go whole. Null and empty texts stay as they are; repeated rows are masked alike; rows with a null id are
    masked like others; an empty table stays empty; other columns pass through, whatever their names. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest or default_forest())
    at = {c: k for k, c in enumerate(docs.columns)}
    return map_whole(docs, partial(_masked, forest=shared, threshold=threshold, text_at=at[text_col], length_at=at.get(length_col)))
