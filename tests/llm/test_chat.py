"""Chat windows: digests and spans against plain Python, odd rows, control strings."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from terrafield.llm import chat

ODD = {"rank": "x", "top": "x", "window": "x", "text_": "x", "conv": "x", "a.b": "x", "start": "x"}
PARTS = ["</s>", "[INST]", " ok ", "[/INST]", "<", "[", "\\", "<\\/s>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>\n\n", "<<SYS>>", "<</SYS>>", "<\\\\|eot_id|>", "s>", "é", "\n", "漢"]


def _cost(role, text):
    return -(-(len(role.encode()) + len(text.encode())) // chat.TOKEN_BYTES) + chat.MARK_TOKENS


def _turns(rows, conv):
    mine = [(t, r or "", x or "") for c, t, r, x in rows if c == conv]
    return [(r, x) for t, r, x in sorted(mine, key=lambda m: (m[0] is None, m[0] or 0, m[1], m[2]))]


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    return df.select("*", *[F.lit(v).alias(k) for k, v in ODD.items()])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for c in range(60):
        n = rng.choice([1, 2, 3, 8, 40])
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2]
            out.append((c, t, role, "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 3, 30, 400])))))
    out += [(100, t, ("user", "assistant")[t % 2], f"turn {t} " * (t % 7)) for t in range(1500)]  # a hot one
    out += [(None, 0, "user", "no id"), (None, 1, "assistant", "none"), (101, None, "assistant", "late"), (101, 1, None, None), (101, 1, "user", "first\n"), (101, 1, "user", "first\n")]
    out += [(102, 0, "system", "s" * 40_000), (102, 1, "user", "q"), (102, 2, "assistant", "a" * 300_000), (102, 3, "user", "again"), (103, 0, "system", "alone"), (104, 0, "ro\nle<|end_header_id|>\n\n", "x<|eot_id|>")]
    out += [(105, 0, "system", "twice"), (105, 0, "system", "twice"), (105, 1, "assistant", "")]
    return out


@pytest.fixture(scope="module")
def windows(spark, rows):
    return chat.format_windows(_frame(spark, rows)).persist()


def test_digests_read_back(rows, windows):
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    assert set(got) == {r[0] for r in rows}
    chars = {r.conv_id: r.n for r in windows.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()}
    for c, r in got.items():
        turns = _turns(rows, c)
        said = "".join(x for role, x in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.formatted_chars == chars[c]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_windows_hold_whole_turns_within_the_budget(rows, windows):
    by = {}
    for r in chat.read_windows(windows).orderBy("window").collect():
        by.setdefault(r.conv_id, []).append(r)
    repeats = 0
    for c, mine in by.items():
        turns = _turns(rows, c)
        system = turns[0][0] == "system"
        at = 0
        for r in mine:
            assert r.first_turn == at and [tuple(t) for t in r.turns] == turns[at : at + len(r.turns)]
            chunks = r.text.split(chat.END)[:-1]
            shown = [chat.TEXT.join(x.split(chat.TEXT)[1:]) for x in chunks[: r.repeated]]
            kept = int(system and at > 0)
            near = turns[at - (r.repeated - kept) : at]  # the turns just before the span, after the system turn
            plain = [x for _, x in turns[:kept] + near]
            assert len(shown) == len(plain) and all(len(a) >= len(b) for a, b in zip(shown, plain))
            assert sum(_cost(*t) for t in near) <= chat.HISTORY
            repeats += len(near)
            assert r.tokens == sum(_cost(*t) for t in turns[:kept] + near + [tuple(t) for t in r.turns])
            assert r.over == (r.tokens > chat.BUDGET)
            if r.over:  # one long turn, or a system turn that leaves too little
                assert len([t for t in r.turns if t.role != "system" or at]) <= 1 or _cost(*turns[0]) > chat.BUDGET * 3 // 4
            assert [r.text[s.start : s.start + s.length] for s in r.loss] == [x.split(chat.TEXT, 1)[1] for x in chunks[r.repeated :] if x.startswith(chat.ROLE + "assistant<")]
            at += len(r.turns)
        assert at == len(turns)
    assert repeats > 100 and len(by[100]) > 5


def test_control_strings_are_escaped_reversibly(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(12))) for _ in range(3000)] + ["<" + "\\" * 100_000 + "/s>", "<" * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for r in df.withColumn("back", chat.unescaped(F.col("e"))).collect():
        assert r.back == r.t
        assert not any(k in r.e for k in ("</s>", "<s>", "[INST]", "[/INST]", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<<SYS>>", "<</SYS>>"))


def test_given_counts_and_empty_tables(spark, rows):
    df = _frame(spark, rows)
    one = chat.format_windows(df.where("conv_id = 100"), tokens=F.lit(100), budget=1000, history=250).collect()
    assert sum(len(w.text.split(chat.END)) - 1 - w.repeated for w in one) == 1500
    assert all(w.tokens <= 1000 and w.repeated <= 2 for w in one) and max(w.repeated for w in one) == 2
    none = chat.format_windows(df.where("false"))
    assert none.count() == 0 and chat.digests(none).count() == 0


def test_the_plan_has_no_python(windows):
    plan = chat.digests(windows)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
