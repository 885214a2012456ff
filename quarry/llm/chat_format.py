"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A conversation is rendered once, turn by turn::

    <s>role\\ntext</s>

Inside roles and texts ``&``, ``<`` and ``[`` become ``&amp;``, ``&lt;`` and
``&lsqb;`` (in roles a line feed becomes ``&nl;`` too), so no control string
(``<s>``, ``</s>``, ``[INST]`` ...) can occur there, and the rendering reads
back without loss.

Every assistant turn is an example of its own: its context is everything
rendered before it, its trainable span is its own text. All examples of a
conversation are prefixes of one rendering, so ``expand`` stores each piece
once, with its character offset, and an example as the offsets
(``example_end``, ``loss_start``, ``loss_end``) into that rendering: the size
stays linear in the input, however long a conversation is. ``example_texts``
explodes them: a row per assistant turn with its whole context, its reply and
its mask. ``digests`` reads turns and trainable texts back from these rows.
A conversation's rendering is one value of a row, so it is bounded by 2 GB.

Defined cases: a null role or text is an empty one; turns are ordered by
(turn, role, text), a null turn first; repeated rows are turns of their own;
a null conv_id is a conversation like any other; a conversation without an
assistant turn has no example; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BOS, EOS = "<s>", "</s>"
#: Order matters: ``&`` is escaped first and restored last.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&nl;"))


def escape(c: Column, escapes=ESCAPES) -> Column:
    for plain, coded in escapes:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column, escapes=ESCAPES) -> Column:
    for plain, coded in reversed(escapes):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def expand(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """One row per turn: ``conv_id, position, start, piece, is_target,
    loss_start, loss_end, example_end`` (offsets in characters of the
    conversation's rendering; the last three are null for context turns)."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    head = F.concat(F.lit(BOS), escape(F.col("role"), ROLE_ESCAPES), F.lit("\n"))
    rows = rows.select("*", head.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(EOS)))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "conv_id", F.row_number().over(w).alias("position"),
        F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("long").alias("start"),
        "piece", (F.col("role") == target_role).alias("is_target"),
        F.length("head").alias("head_chars"), F.length("body").alias("body_chars"))
    loss_start = F.col("start") + F.col("head_chars")
    when = lambda c: F.when(F.col("is_target"), c)
    return rows.select(
        "conv_id", "position", "start", "piece", "is_target", when(loss_start).alias("loss_start"),
        when(loss_start + F.col("body_chars")).alias("loss_end"),
        when(loss_start + F.col("body_chars") + len(EOS)).alias("example_end"))


def example_texts(pieces: DataFrame) -> DataFrame:
    """The formatted output, a row per example: ``conv_id, position, text,
    loss_start, loss_end``. An example's text is its whole context and its
    reply; offsets are those of its loss mask. The turns after a conversation's
    last assistant turn belong to no example: they come as one more row with no
    mask and no position. ``is_tail`` marks the rows that, put together, hold
    every turn once: the last example and the row without a mask.

    Written out, its size is that of all prefixes; a reader that takes the
    masked part of each row alone gets it from one rendering per conversation."""
    whole = pieces.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "piece"))), lambda x: x["piece"]),
                     "").alias("rendered"),
        F.max(F.when(F.col("is_target"), F.col("position"))).alias("last"),
        F.coalesce(F.max("example_end"), F.lit(0).cast("long")).alias("rest"),
        F.array_sort(F.collect_list(F.when(F.col("is_target"), F.struct(
            "position", "example_end", "loss_start", "loss_end")))).alias("examples"))
    no = F.lit(None).cast("long")
    rest = F.array(F.struct(no.cast("int").alias("position"), no.alias("example_end"),
                            no.alias("loss_start"), no.alias("loss_end")))
    e = whole.select("conv_id", "rendered", "last", "rest", F.explode(F.concat("examples", rest)).alias("e"))
    return e.select(
        "conv_id", "e.position",
        F.expr("CASE WHEN e.position IS NULL THEN substring(rendered, cast(rest + 1 as int)) "
               "ELSE substring(rendered, 1, cast(e.example_end as int)) END").alias("text"),
        "e.loss_start", "e.loss_end", F.expr("e.position IS NULL OR e.position = last").alias("is_tail"))


def turns_of(text: Column) -> Column:
    """An array of (role, text) read from a rendering: no control string can
    occur inside a turn, so the end marks tell the turns apart."""
    def turn(x):
        inner = F.substr(x, F.lit(len(BOS) + 1))
        cut = F.instr(inner, "\n")
        return F.struct(unescape(F.substr(inner, F.lit(1), cut - 1), ROLE_ESCAPES).alias("role"),
                        unescape(F.substr(inner, cut + 1)).alias("text"))
    return F.transform(F.filter(F.split(text, EOS, -1), lambda x: x != ""), turn)


def read_back(examples: DataFrame) -> DataFrame:
    """What each row of ``example_texts`` holds: ``conv_id, position, loss_text``
    (what its mask covers, null without one) and ``rendered`` (its text, null
    where a later row repeats it)."""
    masked = F.expr("substring(text, cast(loss_start + 1 as int), cast(loss_end - loss_start as int))")
    return examples.select(
        "conv_id", "position", F.when(F.col("loss_start").isNotNull(), unescape(masked)).alias("loss_text"),
        F.when(F.col("is_tail"), F.col("text")).alias("rendered"))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, what its formatted output (``example_texts``) holds
    (one row of text per conversation, as the digests ask for)."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("position").isNull().alias("after"), "position", "loss_text", "rendered")))
    g = read_back(examples).groupBy("conv_id").agg(rows.alias("r"), F.count("loss_text").alias("n_examples"))

    def joined(field):
        return F.array_join(F.transform(F.filter("r", lambda x: x[field].isNotNull()), lambda x: x[field]), "")
    g = g.select("conv_id", "n_examples", joined("loss_text").alias("loss"), joined("rendered").alias("rendered"))
    g = g.withColumn("turns", turns_of(F.col("rendered")))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return g.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("rendered").cast("long").alias("formatted_chars"), "n_examples")


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def with_control_case(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """``conversations`` plus conversation -7, whose texts are control strings."""
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(example_texts(expand(with_control_case(spark, table(spark, sf_dir, "conversations")))))


SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'),
e AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') AS body,
    replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), chr(10), '&nl;') AS head
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(body) + length(head) + 8)::BIGINT AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant') AS n_examples
FROM e GROUP BY conv_id
"""
