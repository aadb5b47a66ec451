"""Chat formatting in budgeted windows (operator 3); DataFrame functions only.

Prefix sums of turn tokens cut a conversation into windows of whole turns: a turn belongs to the window of the stride in
which it starts, and a turn longer than a stride is a window of its own. With a stride of half the budget the new turns
of a window fit the budget (unless it is one such long turn). Each window starts with the conversation's system turn and
with the turns just before it, up to ``history`` tokens; both are context only, so each assistant text is a target once.

Template: ``<|turn|>`` role ``<|text|>`` text ``<|end|>``. In roles and texts the backslash, ``<`` and ``[`` are written
``\\b``, ``\\l`` and ``\\o``, so that no control string of this or a similar template can occur inside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .registry import llm_query

BUDGET, HISTORY = 512, 128
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Turn numbers that share a chunk of the prefix sums.
CHUNK = 256
_WORD = r"[^\x20\x09-\x0D]+"


def escape(c: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("[", "\\o")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in (("<", "\\l"), ("[", "\\o"), ("\\", "\\b")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def numbered(turns: DataFrame) -> DataFrame:
    """Turns with idx, start (tokens before) and tokens; chunks of turn numbers keep a long conversation out of one task."""
    t = turns.select(
        "conv_id", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("ck"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.expr(f"cast(turn as bigint) div {CHUNK}"), F.lit(-(1 << 40))).alias("chunk"),
    ).withColumn("tokens", F.regexp_count("text", F.lit(_WORD)).cast("long") + 1)
    sums = t.groupBy("ck", "chunk").agg(F.sum("tokens").alias("all_tokens"), F.count("*").alias("all_rows"))
    before = Window.partitionBy("ck").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("ck", "chunk", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("all_tokens", "base"), ("all_rows", "rows_before"))])
    inside = Window.partitionBy("ck", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.join(sums, ["ck", "chunk"])
    return t.select(
        "conv_id", "ck", "role", "text", "tokens",
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("idx"),
        (F.col("base") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).alias("start"),
    )


def format_chat(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, n_repeated, formatted, loss_spans (start and length in code points).

    Input columns conv_id, turn, role, text; others are not read. Turns are taken by number, then role, then text; equal
    turns are all kept. A null role or text is empty, a null conv_id is a conversation of its own, a null turn comes
    first. An empty table gives no windows. A system turn longer than half the budget widens the stride to its own
    length, so that repeating it at most doubles the output.
    """
    t = numbered(turns)
    system = t.where("idx = 0 AND role = 'system'").select("ck", F.col("tokens").alias("sys_tokens"), F.col("text").alias("sys_text"))
    t = t.join(system.select("ck", "sys_tokens"), "ck", "left").withColumn("stride", F.greatest(F.lit(max(budget // 2, 1)), F.coalesce("sys_tokens", F.lit(0))))
    t = t.withColumn("wid", F.expr("2 * (start div stride) + if(tokens > stride, 1, 0)"))
    windows = t.groupBy("ck", "wid", "stride").agg(F.min("start").alias("first_start"), F.min("idx").alias("first_idx"), F.first("conv_id").alias("conv_id"))
    windows = windows.withColumn("near", F.expr("first_start div stride"))
    new = t.select("conv_id", "ck", "wid", F.col("idx").alias("ord"), "role", "text", F.lit(False).alias("again"))
    earlier = t.where("NOT (idx = 0 AND role = 'system')").select("ck", "idx", "start", "role", "text", F.explode(F.expr("array(start div stride, start div stride + 1)")).alias("near"))
    reach = F.least(F.lit(history), F.col("stride"))
    old = earlier.join(windows, ["ck", "near"]).where((F.col("idx") < F.col("first_idx")) & (F.col("start") >= F.col("first_start") - reach))
    old = old.select("conv_id", "ck", "wid", F.col("idx").alias("ord"), "role", "text", F.lit(True).alias("again"))
    kept = windows.where("first_idx > 0").join(system, "ck").select("conv_id", "ck", "wid", F.lit(-1).cast("long").alias("ord"), F.lit("system").alias("role"), F.col("sys_text").alias("text"), F.lit(True).alias("again"))
    rows = new.unionByName(old).unionByName(kept)
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    rows = rows.withColumn("head", head).withColumn("body", escape(F.col("text"))).withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("ck", "wid").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.char_length("head"))
    target = (F.col("role") == "assistant") & ~F.col("again")
    span = F.when(target, F.struct(F.col("at").alias("start"), F.char_length("body").cast("long").alias("length")))
    return rows.groupBy("ck", "wid").agg(
        F.first("conv_id").alias("conv_id"), F.sum(F.col("again").cast("int")).cast("int").alias("n_repeated"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "piece"))), lambda x: x["piece"]), "").alias("formatted"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"),
    ).select("conv_id", F.col("wid").alias("window"), "n_repeated", "formatted", "loss_spans")


def read_chat(windows: DataFrame) -> DataFrame:
    """Turns and targets read back from formatted windows: one row per conversation with counts and digests.

    The digests are of whole conversations, so a conversation's text meets in one row here; formatting never needs that.
    """
    parts = F.split("formatted", F.lit(END.replace("|", r"\|")), -1)
    fresh = F.slice(parts, F.col("n_repeated") + 1, F.greatest(F.size(parts) - 1 - F.col("n_repeated"), F.lit(0)))

    def turn(p: Column) -> Column:
        at = F.split(F.replace(p, F.lit(TURN), F.lit("")), F.lit(TEXT.replace("|", r"\|")), -1)
        return F.concat(unescape(F.get(at, 0)), F.lit("\n"), unescape(F.get(at, 1)), F.lit("\n"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))), "")
    rows = windows.select(
        "conv_id", "window", F.size(fresh).cast("long").alias("n"), F.array_join(F.transform(fresh, turn), "").alias("turns"),
        loss.alias("loss"), F.char_length("formatted").cast("long").alias("chars"),
    )
    whole = rows.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"),
    )
    loss_text = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.transform("w", lambda x: x["turns"]), ""), 256).alias("turns_sha256"),
        F.char_length(loss_text).cast("long").alias("loss_chars"), F.sha2(loss_text, 256).alias("loss_sha256"), "formatted_chars",
    )


@llm_query("op3_chat_windows")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    extra = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    return read_chat(format_chat(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))
