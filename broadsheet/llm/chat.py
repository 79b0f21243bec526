"""Chat formatting in budgeted windows.

A conversation is cut into windows of whole turns by prefix sums of its turns'
tokens. Every window starts with the leading system turn, repeats at most
`history` tokens of the turns before it, and then goes on with turns of its
own. Only the assistant turns of its own are under the loss mask, so each
assistant text is trained on once however often it is repeated.

    <|im_start|>role\\ntext<|im_end|>\\n

Inside texts and roles a backslash is put between `<` and `|` (one more if
some are there), so no control string can arise and `unescape` restores them;
in roles line feeds and backslashes are escaped too.

Turns are ordered by turn (null first), then role and text; repeated rows are
turns each. Null role and text count as empty. Rows without conv_id form one
conversation. A turn longer than a window gets a window of its own, whole.
Extra columns are ignored. Only DataFrame functions are used: prefix sums and
history are window functions that stream over sorted rows, and what is
gathered is one window's turns, bounded by the budget.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from broadsheet.llm.common import SPACE

START, STOP = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 512, 128
#: Tokens a turn has besides those of its text.
MARKUP = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    role = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.replace(role, F.lit("<"), F.lit("\\l"))


def _unescape_role(role: Column) -> Column:
    # A doubled backslash becomes a stand-in first, so that it cannot pair with what follows.
    out = F.replace(role, F.lit("\\\\"), F.lit("\\0"))
    out = F.replace(F.replace(out, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\0"), F.lit("\\"))


def tokens_of(text: Column) -> Column:
    """Tokens a text is counted as: its words, and one more per eight characters of it."""
    words = F.size(F.array_remove(F.split(text, SPACE), ""))
    return words + F.floor(F.length(text) / 8).cast("int") + F.lit(MARKUP)


def _markup(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(STOP + "\n"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, formatted, fresh_from, loss.

    fresh_from is the offset in code points where the window's own turns
    begin (0 in a conversation's first window, which owns the system turn);
    loss lists (start, size) of the spans under the loss mask. budget bounds
    a window's own turns, the system turn and the history come on top.
    """
    if budget < 2 or history < 0:
        raise ValueError("budget must be 2 or more and history 0 or more")
    conv = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("ord", F.row_number().over(conv))
        .withColumn("system", (F.col("ord") == 1) & (F.col("role") == "system"))
        .withColumn("own", F.when(F.col("system"), 0).otherwise(tokens_of(F.col("text"))))
    )
    by_ord = Window.partitionBy("conv_id").orderBy("ord")
    half = budget // 2
    # Turns whose prefix sum starts in one half budget stand together: less than a
    # half, and the last turn, which is a half at most unless it stands alone.
    rows = rows.withColumn("begin", F.sum("own").over(by_ord.rowsBetween(Window.unboundedPreceding, 0)) - F.col("own"))
    rows = rows.withColumns({"slot": F.floor(F.col("begin") / half), "wide": F.col("own") > half})
    rows = rows.withColumn(
        "cut",
        (
            (F.col("ord") > 1)
            & ~F.lag("system", 1, False).over(by_ord)
            & ((F.col("slot") != F.lag("slot").over(by_ord)) | F.col("wide") | F.lag("wide").over(by_ord))
        ).cast("int"),
    )
    turn = F.struct(_escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    before = Window.partitionBy("conv_id").orderBy("begin").rangeBetween(-history, -1)
    rows = rows.select(
        "conv_id",
        "ord",
        "begin",
        "system",
        "cut",
        F.sum("cut").over(by_ord.rowsBetween(Window.unboundedPreceding, 0)).alias("window"),
        turn.alias("t"),
        (F.col("role") == "assistant").alias("trained"),
    )
    rows = rows.select(
        "*",
        F.first(F.when(F.col("system"), F.col("t"))).over(by_ord.rowsBetween(Window.unboundedPreceding, 0)).alias("head"),
        F.collect_list(F.when(~F.col("system"), F.col("t"))).over(before).alias("past"),
    )
    grouped = rows.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("ord", "t", "trained"))).alias("own"),
        F.min_by("head", "ord").alias("head"),
        F.min_by("past", "ord").alias("past"),
    )
    lead = F.when(
        F.col("window") > 0,
        F.concat(
            F.coalesce(_markup(F.col("head.role"), F.col("head.text")), F.lit("")),
            F.array_join(F.transform("past", lambda t: _markup(t["role"], t["text"])), ""),
        ),
    ).otherwise(F.lit(""))
    parts = grouped.select("conv_id", "window", lead.alias("lead"), "own")
    spelled = parts.select("*", F.transform("own", lambda x: _markup(x["t"]["role"], x["t"]["text"])).alias("texts"))
    ends = F.aggregate(
        "texts",
        F.struct(F.length("lead").alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
    )
    spelled = spelled.withColumn("starts", ends["starts"])
    span = F.transform(
        "own",
        lambda x, k: F.when(
            x["trained"],
            F.struct(
                (F.get(F.col("starts"), k) + F.length(x["t"]["role"]) + F.lit(len(START) + 1)).alias("start"),
                F.length(x["t"]["text"]).alias("size"),
            ),
        ),
    )
    return spelled.select(
        "conv_id",
        F.col("window").cast("long").alias("window"),
        F.concat("lead", F.array_join("texts", "")).alias("formatted"),
        F.length("lead").alias("fresh_from"),
        F.filter(span, lambda s: s.isNotNull()).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per window: its own turns (role, text), unescaped, and the texts under its loss mask."""
    fresh = F.expr("substring(formatted, fresh_from + 1)")
    segments = F.filter(F.split(fresh, START.replace("|", "\\|")), lambda s: s != "")
    turn = lambda s: F.struct(
        _unescape_role(F.substring_index(s, "\n", 1)).alias("role"),
        unescape(F.regexp_replace(F.regexp_replace(s, r"^[^\n]*\n", ""), r"<\|im_end\|>\n$", "")).alias("text"),
    )
    return formatted.select(
        "conv_id",
        "window",
        F.length("formatted").alias("chars"),
        F.transform(segments, turn).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["size"]))).alias("targets"),
    )


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted windows alone: turns, loss text and their digests."""
    back = read_back(formatted).select(
        "conv_id",
        "window",
        "chars",
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("targets", "").alias("targets"),
    )
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("window", c))), lambda x: x[c]), "")
    whole = back.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), joined("turns").alias("turns"), joined("targets").alias("targets"),
        F.sum("chars").cast("long").alias("formatted_chars"), F.count("*").alias("n_windows"),
    )
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("targets").cast("long").alias("loss_chars"),
        F.sha2("targets", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
