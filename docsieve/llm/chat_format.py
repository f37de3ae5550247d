"""Chat formatting in budgeted windows, in DataFrame operations only.

Each turn is rendered between markers, with every control string inside its text escaped. Prefix sums of the
turns' tokens choose turn-aligned windows: a window starts where the tokens since the last start would
exceed the budget that the system turn and the history leave. Later windows repeat the system turn and the
last few turns before them; what is repeated is never under the loss mask, so each assistant text is learned
once. A turn above the budget stands alone in its window, whole.

Defined cases: a null text or role is empty; turns are ordered by turn (null first), role and text, so
repeated rows are repeated turns; rows of a null conv_id are one conversation; no rows give no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BUDGET = 1024
HISTORY_TOKENS = 128
HISTORY_TURNS = 4
#: Openings of control strings, of this template and of other common ones.
_ANGLE = r"<(?=\||/?s>|</?SYS>>)"
_SQUARE = r"\[(?=/?INST\])"
_TOKEN = r"\w+|[^\w\s]"


def escaped(text: Column, line_ends: bool = False) -> Column:
    """No control string is left; ``unescaped`` restores the text. Other text stays as it is."""
    text = F.regexp_replace(text, r"\\(?=[slbn])", r"\\s")
    text = F.regexp_replace(text, _ANGLE, r"\\l")
    text = F.regexp_replace(text, _SQUARE, r"\\b")
    return F.replace(text, F.lit("\n"), F.lit("\\n")) if line_ends else text


def unescaped(text: Column, line_ends: bool = False) -> Column:
    if line_ends:
        text = F.replace(text, F.lit("\\n"), F.lit("\n"))
    for code, char in (("\\l", "<"), ("\\b", "["), ("\\s", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def _turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: its order, rendered text, tokens, characters, and their prefix sums."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(START), escaped(F.col("role"), True), F.lit("\n"))
    body = escaped(F.col("text"))
    rows = rows.withColumn("head", head).withColumn("body", body).withColumn(
        "tokens", F.regexp_count("text", F.lit(_TOKEN)) + 4)
    rows = rows.withColumn("chars", F.length("head") + F.length("body") + len(END) + 1)
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    return rows.select(
        "conv_id", F.row_number().over(order).alias("at"), "role", "head", "body", "tokens", "chars",
        F.sum("tokens").over(so_far).alias("tokens_to"), F.sum("chars").over(so_far).alias("chars_to"))


def format_windows(conversations: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS,
                   history_turns: int = HISTORY_TURNS) -> DataFrame:
    """One row per window: conv_id, window (from 0), formatted, n_tokens, n_repeated (turns repeated at its
    head) and loss (array of start, stop: character positions in ``formatted`` under the loss mask)."""
    turn = F.struct("at", "role", "head", "body", "tokens", "chars", "tokens_to", "chars_to")
    conv = _turns(conversations).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    first = F.col("turns")[0]
    conv = conv.withColumn("has_system", first["role"] == "system")
    conv = conv.withColumn("system_tokens", F.when(F.col("has_system"), first["tokens"]).otherwise(F.lit(0)))
    room = F.greatest(F.lit(budget - history_tokens) - F.col("system_tokens"), F.lit(1)).cast("long")
    conv = conv.withColumn("room", room)
    begin = F.struct(F.lit(0).cast("long").alias("base"), F.array(F.lit(1)).alias("starts"))
    starts = F.aggregate("turns", begin, lambda state, t: F.when(
        (t["tokens_to"] - state["base"] > F.col("room")) & (t["at"] > F.element_at(state["starts"], -1)),
        F.struct((t["tokens_to"] - t["tokens"]).alias("base"),
                 F.concat(state["starts"], F.array(t["at"])).alias("starts"))).otherwise(state))
    conv = conv.withColumn("starts", starts["starts"])
    turns, n = F.col("turns"), F.size("turns")

    def window(start: Column, i: Column) -> Column:
        stop = F.when(i + 1 < F.size("starts"), F.get("starts", i + 1)).otherwise(n + 1)
        fresh = F.slice(turns, start, stop - start)
        since = F.element_at(turns, start)["tokens_to"] - F.element_at(turns, start)["tokens"]
        low = F.greatest(start - history_turns, F.when(F.col("has_system"), F.lit(2)).otherwise(F.lit(1)))
        near = F.when(start > low, F.slice(turns, low, start - low)).otherwise(F.slice(turns, 1, 0))
        history = F.filter(near, lambda t: t["tokens_to"] - t["tokens"] >= since - history_tokens)
        system = F.when(F.col("has_system") & (start > 1), F.slice(turns, 1, 1)).otherwise(F.slice(turns, 1, 0))
        return F.struct(i.alias("window"), F.concat(system, history).alias("repeated"), fresh.alias("fresh"))

    rows = conv.select("conv_id", F.explode(F.transform("starts", window)).alias("w")).select("conv_id", "w.*")
    both = F.concat("repeated", "fresh")
    lead = F.aggregate("repeated", F.lit(0).cast("long"), lambda a, t: a + t["chars"])
    rows = rows.withColumn("lead", lead).withColumn(
        "before", F.col("fresh")[0]["chars_to"] - F.col("fresh")[0]["chars"])
    loss = F.transform(F.filter("fresh", lambda t: t["role"] == "assistant"), lambda t: F.struct(
        (F.col("lead") + t["chars_to"] - t["chars"] - F.col("before") + F.length(t["head"])).alias("start"),
        (F.col("lead") + t["chars_to"] - F.col("before") - (len(END) + 1)).alias("stop")))
    return rows.select(
        "conv_id", "window",
        F.array_join(F.transform(both, lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "").alias(
            "formatted"),
        F.aggregate(both, F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("n_tokens"),
        F.size("repeated").alias("n_repeated"), loss.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (role, text: the new ones), learned (text under the mask), chars (formatted)."""
    parts = F.split("formatted", F.lit(END.replace("|", r"\|") + "\n"))
    own = F.slice(parts, F.col("n_repeated") + 1, F.size(parts) - 1 - F.col("n_repeated"))

    def turn(part: Column) -> Column:
        line = F.instr(part, "\n")
        return F.struct(
            unescaped(F.substring(part, F.lit(len(START) + 1), line - len(START) - 1), True).alias("role"),
            unescaped(F.substring(part, line + 1, F.length(part))).alias("text"))

    learned = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(
        F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")
    return windows.select("conv_id", "window", F.transform(own, turn).alias("turns"), learned.alias("learned"),
                          F.length("formatted").cast("long").alias("chars"))


def formatted_conversations(conversations: DataFrame, **options) -> DataFrame:
    """Per conversation, from its windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    n_windows. The digests cover a whole conversation, so its text must meet in one place here."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = read_back(format_windows(conversations, **options)).select(
        "conv_id", F.struct("window", F.size("turns").alias("n"), said.alias("said"), "learned", "chars").alias("w"))
    whole = back.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    text, loss = F.array_join("w.said", ""), F.array_join("w.learned", "")

    def total(field: str) -> Column:
        return F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + w[field])

    return whole.select(
        "conv_id", total("n").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"), F.size("w").alias("n_windows"))
