"""Chat formatting in windows of a token budget.

A turn is an opening mark, its escaped text and a closing mark. Prefix sums of the turns'
tokens and characters are taken over each conversation. A window repeats the system turn
and at most HISTORY turns from before, as many as fit the budget beside its first new turn,
and takes new turns as long as they fit. Only where the first new turn and the system turn
pass the budget by themselves is a window longer, and then it has no other turn. The loss
mask covers each assistant text in the one window where it is new; repeated turns are masked.

Escaping puts one `&` behind the first character of whatever is or looks like an
escaped mark; unescaping takes one away. So no mark occurs within a text.

Only DataFrame functions run. A conversation is one row of windows, as its digests are
over all its turns; conversations are dealt out by id. Work is linear in the turns.

Cases: a null text is empty; a null turn comes first; equal turn numbers are ordered by
role and text, repeated rows are kept; a null role is written as an empty one; roles
other than system, user and assistant carry their name; a null id is a conversation
like any other; an empty table gives only the added conversation; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _shared as S

MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[BOT]", "[/BOT]")}
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")
BEGIN, END = "<s>", "</s>"
#: What escaping looks for: a mark, perhaps escaped already.
CONTROL = r"([<\[])(&*/?(?:s>|(?:SYS|INST|BOT|ROLE|TURN)\]))"
ESCAPED = r"([<\[])&(&*/?(?:s>|(?:SYS|INST|BOT|ROLE|TURN)\]))"
TURN = r"(?s)\[SYS\].*?\[/SYS\]|\[INST\].*?\[/INST\]|\[BOT\].*?\[/BOT\]|\[ROLE\].*?\[/TURN\]"
#: Tokens (words and marks) of a window, and turns repeated before its new ones.
BUDGET, HISTORY = 512, 2
ADDED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "$1&$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def marked(role: Column, text: Column) -> Column:
    """A turn of the template."""
    safe = escape(text)
    out = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]), safe, F.lit(OTHER[2]))
    for name, (a, b) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(a), safe, F.lit(b))).otherwise(out)
    return out


def _starts(turns: Column, lead: Column, system: Column, budget: int, history: int) -> Column:
    """(first, back) of each window: its first new turn and its first repeated one; lead: tokens of the system turn."""
    start = F.struct(
        F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("back"))).alias("starts"),
        F.lit(0).cast("long").alias("base"),  # the last window holds a turn's prefix sum less this
    )

    def step(a: Column, t: Column) -> Column:
        i = t["i"] - 1
        before = lambda at: F.get(turns, at)["tokens_to"] - F.get(turns, at)["tokens"]
        fits = (i == F.element_at(a["starts"], -1)["first"]) | (t["tokens_to"] - a["base"] <= budget)
        back = F.coalesce(*[F.when((i - h >= system) & (lead + t["tokens_to"] - before(i - h) <= budget), i - h) for h in range(history, 0, -1)], i)
        return F.when(fits, a).otherwise(F.struct(F.concat(a["starts"], F.array(F.struct(i.alias("first"), back.alias("back")))).alias("starts"), (before(back) - lead).alias("base")))

    return F.aggregate(turns, start, step)["starts"]


def windows(turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id and windows: an array of (text, repeated, tokens, loss), loss being spans (start from 0, length) of text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), S.text_of()
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"marked": marked(F.col("role"), F.col("text")), "tokens": F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 2})
    rows = rows.withColumn("chars", F.char_length("marked").cast("long"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"i": F.row_number().over(order), "tokens_to": F.sum("tokens").over(upto), "chars_to": F.sum("chars").over(upto)})
    own = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "role", "marked", "tokens", "chars", "tokens_to", "chars_to"))).alias("turns"))
    first = F.get("turns", F.lit(0))
    own = own.withColumn("system", F.when(first["role"] == "system", 1).otherwise(0))
    own = own.withColumn("lead", F.when(F.col("system") == 1, first["tokens"]).otherwise(F.lit(0).cast("long")))
    own = own.withColumn("starts", _starts(F.col("turns"), F.col("lead"), F.col("system"), budget, history))

    def window(s: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1)["first"], F.size("turns"))
        front = F.when((F.col("system") == 1) & (s["first"] > 0), F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0))
        has = lambda c: F.when(F.size(front) > 0, first[c]).otherwise(F.lit(0).cast("long"))
        gone = lambda c: F.get("turns", s["back"])[f"{c}_to"] - F.get("turns", s["back"])[c]
        return F.struct(
            F.concat(front, F.slice("turns", s["back"] + 1, end - s["back"])).alias("turns"), (F.size(front) + s["first"] - s["back"]).alias("repeated"),
            (has("tokens") + F.get("turns", end - 1)["tokens_to"] - gone("tokens")).alias("tokens"), (has("chars") - gone("chars")).alias("shift"),
        )

    own = own.withColumn("cut", F.transform("starts", window))

    def render(w: Column) -> Column:
        text = F.concat(F.lit(BEGIN), F.array_join(F.transform(w["turns"], lambda t: t["marked"]), ""), F.lit(END))
        new = F.filter(w["turns"], lambda t, i: (i >= w["repeated"]) & (t["role"] == "assistant"))
        opening, marks = len(BEGIN) + len(MARKS["assistant"][0]), len("".join(MARKS["assistant"]))
        loss = F.transform(new, lambda t: F.struct((t["chars_to"] - t["chars"] + w["shift"] + opening).cast("int").alias("start"), (t["chars"] - marks).cast("int").alias("length")))
        return F.struct(text.alias("text"), w["repeated"].alias("repeated"), w["tokens"].alias("tokens"), loss.alias("loss"))

    return own.select("conv_id", F.transform("cut", render).alias("windows"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of what the loss mask covers, from the formatted windows alone."""
    new = F.flatten(F.transform("windows", lambda w: F.slice(F.regexp_extract_all(w["text"], F.lit(TURN), 0), w["repeated"] + 1, F.lit(1 << 30))))

    def plain(t: Column) -> Column:
        body = F.regexp_replace(t, r"(?s)^\[ROLE\].*?\[/ROLE\]", "")
        out = F.concat(unescape(F.regexp_extract(t, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1)), F.lit("\n"), unescape(F.substring(body, F.lit(1), F.char_length(body) - len(OTHER[2]))), F.lit("\n"))
        for name, (a, b) in MARKS.items():
            inner = F.substring(t, F.lit(len(a) + 1), F.char_length(t) - len(a) - len(b))
            out = F.when(F.startswith(t, F.lit(a)), F.concat(F.lit(f"{name}\n"), unescape(inner), F.lit("\n"))).otherwise(out)
        return out

    loss = F.flatten(F.transform("windows", lambda w: F.transform(w["loss"], lambda s: unescape(F.substring(w["text"], s["start"] + 1, s["length"])))))
    out = formatted.select("conv_id", "windows", new.alias("new"), F.array_join(loss, "").alias("loss"))
    return out.select(
        "conv_id", F.size("new").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("new", plain), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.aggregate("windows", F.lit(0).cast("long"), lambda s, w: s + F.char_length(w["text"])).alias("formatted_chars"),
        F.size("windows").cast("long").alias("n_windows"),
    )


def _added(spark: SparkSession) -> DataFrame:
    """The rows of ADDED, made without a Python task."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("conv_id", "turn", "role", "text"), row, strict=True)]) for row in ADDED])
    return spark.range(1).select(F.explode(rows).alias("x")).select(F.col("x.conv_id").cast("long").alias("conv_id"), F.col("x.turn").cast("long").alias("turn"), "x.role", "x.text")


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted, stored and read back."""
    rows = S.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_back(S.stored(windows(rows.unionByName(_added(spark))), "chat"))
