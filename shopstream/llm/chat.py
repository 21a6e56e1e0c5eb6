"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, adjacent turns of one
role are merged into one block, and blocks are concatenated:

    <|im_start|>role\\n text <|im_sep|> text <|im_end|>\\n  <|im_start|>role\\n ...

Inside roles and texts ``&``, ``<`` and ``[`` are written ``&amp;``, ``&lt;`` and
``&lb;`` (and a line break of a role ``&nl;``), so no text can hold a control string
of this template or of the ``[INST]`` / ``</s>`` family, and the output can be read
back exactly.  The loss mask is a list of character spans of the formatted string
that cover the assistant's texts, without separators.

Defined results: null text or role = empty; rows with a null conversation id form
one conversation with a null id; null turns sort first; equal turns are ordered by
role, then text; repeated rows are kept as turns of their own; an empty table gives
no rows; other columns of the input are ignored.

A conversation becomes one row of the output, so its turns meet in one row by the
nature of the result; only (turn, role, text) are shuffled, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
ASSISTANT = "assistant"


def escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    # the ampersand last: after escaping, every '&' begins an entity
    for raw, safe in (("\n", "&nl;"), ("[", "&lb;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def let(value: Column, body) -> Column:
    """``body`` of ``value`` computed once, also where body uses it inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_total(values: Column) -> Column:
    """Inclusive prefix sums of an int array.

    Two levels of about sqrt(n), so n^1.5 additions and no array that grows by copying.
    """
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def chunked(v: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        return let(step, lambda st: F.when(F.size(v) > 0, F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / st).cast("int")), lambda k: F.slice(v, k * st + 1, st))))

    def sums(chunks: Column) -> Column:
        return let(F.transform(chunks, total), lambda t: F.transform(chunks, lambda ch, k: F.struct(
            total(F.slice(t, F.lit(1), k)).alias("base"), ch.alias("part"))))

    return let(let(values, chunked), lambda chunks: F.flatten(F.transform(sums(chunks), lambda b: F.transform(
        b["part"], lambda _, i: b["base"] + total(F.slice(b["part"], F.lit(1), i + 1))))))


def format_chats(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """One row per conversation: ``conv``, ``n_turns``, ``formatted``, ``loss_spans``.

    ``loss_spans``: array<struct<start, length>>, zero-based code points of ``formatted``.
    """
    rows = df.select(
        F.col(conv).alias("_conv"), F.col(turn).alias("turn"),
        F.replace(escape(F.coalesce(F.col(role).cast("string"), F.lit(""))), F.lit("\n"), F.lit("&nl;")).alias("role"),
        escape(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"))
    convs = rows.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    n = F.size("turns")
    at = lambda i: F.get(F.col("turns"), i)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (at(i)["role"] != at(i - 1)["role"]))
    blocks = F.transform(F.col("starts"), lambda s, j: F.struct(
        at(s)["role"].alias("role"),
        F.transform(F.slice("turns", s + 1, F.coalesce(F.get(F.col("starts"), j + 1), n) - s), lambda t: t["text"]).alias("texts")))

    def piece(s: Column, loss: Column) -> Column:
        return F.struct(s.alias("s"), loss.alias("loss"))

    no = F.lit(False)
    pieces = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.array(piece(F.concat(F.lit(START), b["role"], F.lit("\n")), no)),
        F.flatten(F.transform(b["texts"], lambda t, i: F.array(
            piece(F.when(i == 0, F.lit("")).otherwise(F.lit(SEP)), no),
            piece(t, b["role"] == ASSISTANT)))),
        F.array(piece(F.lit(END), no)))))
    return (
        convs.withColumn("starts", starts).withColumn("blocks", blocks).withColumn("pieces", pieces)
        .withColumn("ends", running_total(F.transform("pieces", lambda p: F.length(p["s"]))))
        .select(
            F.col("_conv").alias(conv), n.cast("long").alias("n_turns"),
            F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
            F.transform(
                F.filter(F.arrays_zip("pieces", "ends"), lambda z: z["pieces"]["loss"]),
                lambda z: F.struct((z["ends"] - F.length(z["pieces"]["s"])).cast("int").alias("start"),
                                   F.length(z["pieces"]["s"]).alias("length"))).alias("loss_spans")))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: array<struct<role, text>> in order."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)
    blocks = F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0)))

    def turns(b: Column) -> Column:
        head = F.substring_index(b, "\n", 1)
        body = F.substr(b, F.length(head) + 2)
        who = unescape(F.substr(head, F.lit(len(START) + 1)))
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(who.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def with_probe(df: DataFrame) -> DataFrame:
    """``df`` plus conversation -1, whose texts hold control strings of another template."""
    probe = "</s>[INST] ok [/INST]"
    rows = df.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(probe).alias("text"))
    return df.select("conv_id", "turn", "role", "text").unionByName(rows)


def digest(chats: DataFrame) -> DataFrame:
    """Columns read back from the output of ``format_chats``."""
    back = chats.withColumn("back", read_back(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans")))
    lines = F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    return digest(format_chats(with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
safe AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lb;') AS t,
         replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'), chr(10), '&nl;') AS r FROM rows),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t) IS DISTINCT FROM role AS first FROM safe)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(t) + CASE WHEN first THEN 12 + length(r) + 1 + 11 ELSE 10 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
