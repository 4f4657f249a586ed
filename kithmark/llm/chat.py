"""Chat formatting by perspective rotation: each speaker of a dialogue in turn is the assistant.

A dialogue is rendered once for every speaker: that speaker's turns become assistant turns and
carry the loss mask, the others become named users, system turns stay as they are. A rendering is one text. Where a
dialogue has more than ``span`` turns it comes in consecutive pieces of that many, which joined in order are
the whole: ``start`` and ``mask`` count through all of it. So no row or group grows with a dialogue's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Turns of a piece.
SPAN = 1024


def cleaned(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, tie with nulls replaced, and markers and, in roles, line ends made harmless; tie orders turns of one number and role."""
    plain = lambda c: F.replace(c, F.lit("<|im_"), F.lit("< |im_"))
    role = plain(F.translate(F.coalesce("role", F.lit("unknown")), "\r\n", "  "))
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long"))
    return turns.select("conv_id", turn.alias("turn"), role.alias("role"), plain(F.coalesce("text", F.lit(""))).alias("text")).withColumn("tie", F.md5("text"))


def ranked(rows: DataFrame) -> DataFrame:
    """rows with at, their place in the dialogue from 0: by range partitions, counted inside each and over them, so no dialogue is in one task."""
    order = ["conv_id", "turn", "role", "tie"]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, "row").withColumn("part", F.spark_partition_id())
    dealt = written(dealt.drop("row"), "chat-turns")
    counts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before).filter("before > 0").select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "before")
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "role", "tie")) - 1
    got = dealt.withColumn("own", local).join(small(written(counts, "chat-counts")), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    return got.withColumn("at", F.col("own") + F.coalesce("before", F.lit(0))).select(*rows.columns, "at")


def _head(role: Column) -> Column:
    """A turn's opening as all but its own speaker see it."""
    return F.concat(F.lit(OPEN), F.when(role == "system", "system").otherwise(F.concat(F.lit("user name="), role)), F.lit("\n"))


def perspectives(turns: DataFrame, span: int = SPAN) -> DataFrame:
    """conv_id, participant, segment, start, n_turns, n_masked, rendered, mask for each dialogue, speaker and piece.

    rendered: the piece's turns in order of (turn, role, MD5 of the text); start: the code point of the dialogue's rendering
    that it begins at; mask: the code points to learn from, as start:end (end exclusive), comma-joined: the text and
    end marker of the speaker's turns. Speakers are the roles but system; a null role is the speaker "unknown". Null text is empty;
    a null turn counts as turn -1, so it comes first. Repeated rows are rendered again. Markers inside
    a text or role are broken by a space so that they can't open or end a turn, and line ends in a role are spaces. Dialogues
    without a speaker have no perspective and give no rows, nor does an empty table. Other columns of turns are ignored.
    """
    rows = ranked(cleaned(turns)).withColumn("segment", F.floor(F.col("at") / span).cast("long"))
    # How long each piece is and who talks in it, without the texts: tells where each speaker's piece starts.
    length = F.char_length(_head(F.col("role"))) + F.char_length("text") + len(CLOSE)
    tally = written(rows.groupBy("conv_id", "segment", "role").agg(F.count("*").alias("n"), F.sum(length).alias("chars")), "chat-tally")
    pieces = tally.groupBy("conv_id", "segment").agg(F.sum("chars").alias("chars"))
    speakers = tally.filter("role <> 'system'").select(F.col("conv_id").alias("c"), F.col("role").alias("participant")).distinct()
    grid = pieces.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c").alias("g").join(tally.select("conv_id", "segment", "role", "n").alias("t"), F.col("g.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("g.segment") == F.col("t.segment")) & (F.col("participant") == F.col("role")), "left")
    own = F.coalesce("n", F.lit(0)) * (len("assistant") - len("user name=") - F.char_length("participant"))
    earlier = Window.partitionBy("g.conv_id", "participant").orderBy("g.segment").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("chars") + own).over(earlier), F.lit(0))
    grid = grid.select(F.col("g.conv_id").alias("c"), F.col("g.segment").alias("s"), "participant", start.cast("long").alias("start"))
    grid = grid.groupBy("c", "s").agg(F.collect_list(F.struct("participant", "start")).alias("views"))

    whole = rows.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))
    rotated = whole.join(grid, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s"))).select("conv_id", "segment", "turns", F.explode("views").alias("view")).select("conv_id", "segment", "turns", "view.*")
    head = lambda t: F.when(t["role"] == F.col("participant"), F.lit(f"{OPEN}assistant\n")).otherwise(_head(t["role"]))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), ((t["role"] == F.col("participant")) & (t["role"] != "system")).alias("own")))
    rotated = rotated.withColumn("parts", parts)

    def place(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.char_length(p["head"])
        end = begin + F.char_length(p["body"])
        span_ = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(span_))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("parts", F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("spans")), place)["spans"]
    rotated = rotated.withColumn("spans", spans)
    return rotated.select(
        "conv_id", "participant", "segment", "start", F.size("turns").cast("long").alias("n_turns"), F.size("spans").cast("long").alias("n_masked"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"), F.array_join("spans", ",").alias("mask"),
    )


def op3(spark, sf_dir: str) -> DataFrame:
    return perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP3_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(turn, -1) AS turn, replace(translate(coalesce(role, 'unknown'), chr(13) || chr(10), '  '), '<|im_', '< |im_') AS role, replace(coalesce(text, ''), '<|im_', '< |im_') AS text FROM conversations),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) - 1 AS pos FROM t),
p AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'),
r AS (SELECT s.conv_id, participant, pos // {SPAN} AS segment, pos, role = participant AS own, text || '<|im_end|>' || chr(10) AS body,
  '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = participant THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head
  FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, CAST(coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, participant ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin FROM r)
SELECT conv_id, participant, segment, min(begin) AS start, count(*) AS n_turns, CAST(count(*) FILTER (own) AS BIGINT) AS n_masked,
  string_agg(head || body, '' ORDER BY pos) AS rendered,
  coalesce(string_agg((begin + length(head)) || ':' || (begin + length(head) + length(body)), ',' ORDER BY pos) FILTER (own), '') AS mask
FROM o GROUP BY conv_id, participant, segment
"""
