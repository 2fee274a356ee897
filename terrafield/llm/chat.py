"""Chat formatting into windows of a token budget, with DataFrame functions alone.

Prefix sums of the turns' tokens choose spans of whole turns: span b holds the turns that begin in [b S, (b + 1) S) of their conversation,
where S is three quarters of a window's room. The one turn that reaches beyond the room, if any, is a span of its own. A window is
the conversation's system turn, as much of the turns before the span as a limited history allows, and the span. Only the span's assistant
turns are targets: what history repeats is masked, so every target is learned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafield.operators.ranges import numbered

#: Tokens of a window, and of the turns that it repeats, at most.
BUDGET, HISTORY = 2048, 512
#: UTF-8 bytes that count as a token where no count is given, and tokens of a turn's marks.
TOKEN_BYTES, MARK_TOKENS = 4, 8
SYSTEM, TARGET = "system", "assistant"
# The marks of a public chat template: a turn's role stands between the first two, the third ends the turn.
ROLE, TEXT, END = "<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>"
# What common chat templates use as control strings, as a first character and what may follow it.
CONTROL = r"(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|</?SYS>>)"


def escaped(text: Column) -> Column:
    r"""Text without control strings: each gets a backslash behind its first character, one more if it had some there already."""
    return F.regexp_replace(text, rf"([<\[])(\\*){CONTROL}", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    """The inverse of escaped()."""
    return F.regexp_replace(text, rf"([<\[])\\(\\*){CONTROL}", r"$1$2$3")


def estimated_tokens(role: Column, text: Column) -> Column:
    return (F.ceil((F.octet_length(role) + F.octet_length(text)) / TOKEN_BYTES) + MARK_TOKENS).cast("long")


def format_windows(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens: Column | None = None, budget: int = BUDGET, history: int = HISTORY
) -> DataFrame:
    """A row per window: conv_id, window, first_turn (place from 0 of the span's first turn), repeated (turns before the span), text, loss
    (array of start and length in characters, from 0), tokens, over (whether they are more than the budget).

    tokens: a column of exact counts per turn, marks included; where it is null, and without it, they are estimated from bytes. A conversation's first turn is kept in all windows if its role is
    system; if it takes over three quarters of the budget, windows have a quarter of the budget for the rest. A turn is never cut: one that is longer than a window's room has a window of its own,
    and `over` says so. A conversation of a system turn alone is one window. Null texts and roles are empty ones; null turns come last; turns that tie go by
    role, then by text, and repeated rows are turns of their own. Rows without an id form one conversation. Other columns aren't read. An empty table gives an
    empty one. Turns are numbered and summed in ranges of the order of all rows, so a task holds no conversation, only windows.
    """
    rows = turns.select(
        F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        (F.lit(None).cast("long") if tokens is None else tokens.cast("long")).alias("given"),
    )
    rows = rows.withColumn("cost", F.greatest(F.lit(0), F.coalesce("given", estimated_tokens(F.col("role"), F.col("text"))))).drop("given")
    rows = numbered(rows, [F.col("conv").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc(), F.col("text").asc()])
    texts = rows.select("rank", "role", "text", "cost")
    # running sums over rows without texts
    rows = numbered(rows.select("conv", F.col("rank").alias("at"), "cost", "role"), [F.col("at").asc()], ("cost",)).drop("at")
    heads = rows.groupBy("conv").agg(F.min("rank").alias("top"), F.min(F.struct("rank", "before_cost", "cost", "role")).alias("first"))
    system = F.col("first.role") == SYSTEM
    heads = heads.select(
        F.col("conv").alias("_conv"), "top", system.alias("system"), F.col("first.before_cost").alias("base"), F.when(system, F.col("first.cost")).otherwise(0).alias("kept")
    ).withColumn("room", F.greatest(F.lit(budget) - F.col("kept"), F.lit(budget // 4)))
    heads = heads.withColumns({"step": F.greatest(F.lit(1), F.floor(F.col("room") * 0.75)).cast("long"), "base": F.col("base") + F.col("kept")})
    p = rows.select("conv", "rank", "cost", "before_cost").join(heads, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    # the system turn itself takes no room of its span
    own = F.col("system") & (F.col("rank") == F.col("top"))
    p = p.withColumns({"at": F.when(own, 0).otherwise(F.col("before_cost") - F.col("base")), "cost": F.when(own, 0).otherwise(F.col("cost")), "head": own})
    p = p.withColumn("span", F.floor(F.col("at") / F.col("step")).cast("long"))
    alone = F.col("at") + F.col("cost") - F.col("span") * F.col("step") > F.col("room")
    p = p.withColumn("window", 2 * F.col("span") + alone.cast("long"))
    spans = p.groupBy("top", "window").agg(
        F.min("rank").alias("from"), F.min("at").alias("from_at"), F.max(F.col("at") + F.col("cost")).alias("to_at"),
        F.any_value("conv").alias("conv"), F.max("room").alias("room"), F.max("system").alias("system"), F.max("step").alias("step"),
    )
    spans = spans.withColumn("reach", F.least(F.lit(history), F.col("step"), F.greatest(F.lit(0), F.col("room") - (F.col("to_at") - F.col("from_at")))))
    # a turn may be history of spans that begin within `history` tokens after it
    near = p.where("not head").select("top", "rank", "at", F.explode(F.sequence("span", F.floor((F.col("at") + F.least(F.lit(history), F.col("step"))) / F.col("step")).cast("long"))).alias("span"))
    near = near.select("top", "rank", "at", F.explode(F.array(2 * F.col("span"), 2 * F.col("span") + 1)).alias("window"))
    near = near.join(spans, ["top", "window"]).where((F.col("rank") < F.col("from")) & (F.col("at") >= F.col("from_at") - F.col("reach")))
    columns = ["top", "window", "conv", "from", "rank", "repeats"]
    system_again = spans.where(F.col("system") & (F.col("from") > F.col("top")))
    members = (
        p.select("top", "window", "rank").join(spans.select("top", "window", "conv", "from"), ["top", "window"]).withColumn("repeats", F.lit(False)).select(*columns)
        .unionByName(near.withColumn("repeats", F.lit(True)).select(*columns))
        .unionByName(system_again.withColumn("rank", F.col("top")).withColumn("repeats", F.lit(True)).select(*columns))
    )
    pieces = members.join(texts, "rank")
    head, body = F.concat(F.lit(ROLE), escaped(F.col("role")), F.lit(TEXT)), escaped(F.col("text"))
    pieces = pieces.withColumns({"head": head, "body": body}).drop("text")
    pieces = pieces.withColumns({"length": F.length("body"), "piece": F.concat("head", "body", F.lit(END))})
    earlier = Window.partitionBy("top", "window").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(earlier), F.lit(0)) + F.length("head"))
    target = (F.col("role") == TARGET) & ~F.col("repeats")
    out = pieces.groupBy("top", "window").agg(
        F.any_value("conv").alias("conv_id"), (F.any_value("from") - F.col("top")).alias("first_turn"), F.count_if("repeats").cast("int").alias("repeated"), F.sum("cost").alias("tokens"),
        F.array_sort(F.collect_list(F.struct("rank", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(target, F.struct(F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"))))).alias("loss"),
    )
    return out.select("conv_id", "window", "first_turn", "repeated", F.array_join(F.col("pieces.piece"), "").alias("text"), "loss", "tokens", (F.col("tokens") > budget).alias("over"))


def read_windows(windows: DataFrame) -> DataFrame:
    """Adds to format_windows' rows what their texts say: turns (array of role and text of the span's turns, unescaped) and targets (array of the texts under the loss mask, unescaped)."""
    chunks = F.split(F.col("text"), F.lit(END.replace("|", r"\|")), -1)
    chunks = F.slice(chunks, F.col("repeated") + 1, F.size(chunks) - 1 - F.col("repeated"))

    def turn(c: Column) -> Column:
        role = F.substring_index(c, TEXT, 1)
        text = F.substr(c, F.length(role) + len(TEXT) + 1)
        return F.struct(unescaped(F.substr(role, F.lit(len(ROLE) + 1))).alias("role"), unescaped(text).alias("text"))

    targets = F.transform("loss", lambda s: unescaped(F.substr(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return windows.withColumns({"turns": F.transform(chunks, turn), "targets": targets})


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows' texts: conv_id, n_turns, turns_sha256 (role, line feed, text, line feed per turn), loss_chars,
    loss_sha256, formatted_chars.

    A digest of a whole conversation needs its text in one value: 2 GB at most. That holds for the digests, not for format_windows.
    """
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    per = read_windows(windows).select("conv_id", "window", F.length("text").alias("chars"), F.size("turns").alias("n"), F.array_join(lines, "").alias("lines"), F.array_join("targets", "").alias("loss"))
    per = per.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("window", "lines", "loss"))).alias("all"))
    per = per.select("conv_id", "n_turns", "formatted_chars", F.array_join("all.lines", "").alias("lines"), F.array_join("all.loss", "").alias("loss"))
    return per.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2("lines", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
