"""Chat formatting from every speaker's side (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>"
PART_TURNS = 256


def _escaped(text: Column) -> Column:
    """Markers inside a text lose their meaning: "<|" becomes "<\\|"."""
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def rotate(
    turns: DataFrame, part_turns: int = PART_TURNS, narrators: tuple[str, ...] = ("system",),
    conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """Every dialogue as seen by each of its participants.

    One row per conversation, participant and part: conv_id, speaker, part,
    n_turns, n_own, rendered, masks. In ``rendered`` the participant's turns are
    the assistant's, the others' are of a user with a name, and the turns of
    ``narrators`` stay what they are; narrators are no participants. ``masks``
    lists, as "start:end" in code points of ``rendered`` joined by commas, the
    participant's texts with their end marker: what a model is trained on.

    A part holds the turns whose number div ``part_turns`` is the same. The parts
    of a conversation in order are the whole dialogue; a conversation of any
    length is therefore many small groups, and its participants are found by a
    distinct that is combined before the shuffle.

    Turns go by number, then speaker, then text. Rows that are equal in all four
    columns are one turn (``n_rows`` counts them). Null texts are empty; a null
    speaker is "unknown"; a null turn comes first, in part -1; a null conv_id is a
    conversation of its own. A conversation of narrators alone has no row. Extra
    columns are ignored. An empty table gives no rows.
    """
    number = F.col(turn).cast("long")
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        number.alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long")
    message = F.struct("turn", "role", "text", "n")
    parts = once.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(message)).alias("messages"))
    speakers = stored(
        rows.where(~F.col("role").isin(*narrators)).select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct(),
        "speakers",
    )
    sided = stored(parts, "chat-parts").join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")

    def own(m: Column) -> Column:
        return m["role"] == F.col("speaker")

    def head(m: Column) -> Column:
        name = F.regexp_replace(_escaped(m["role"]), r"[\s]+", "_")
        who = F.when(own(m), F.lit("assistant")).when(m["role"].isin(*narrators), name).otherwise(F.concat(F.lit("user name="), name))
        return F.concat(F.lit(START), who, F.lit("\n"))

    segments = F.transform(
        "messages", lambda m: F.struct(head(m).alias("head"), F.concat(_escaped(m["text"]), F.lit(END + "\n")).alias("body"), own(m).alias("own"))
    )
    # explode and regroup would shuffle the texts again; a part is small, so its offsets are summed in the row
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))
    newline = 1

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + F.length(s["head"])
        end = begin + F.length(s["body"])
        span = F.concat_ws(":", begin.cast("string"), (end - newline).cast("string"))
        return F.struct(end.cast("long").alias("at"), F.when(s["own"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    shown = sided.withColumn("segments", segments)
    return shown.select(
        "conv_id",
        "speaker",
        "part",
        F.size("segments").cast("long").alias("n_turns"),
        F.size(F.filter("segments", lambda s: s["own"])).cast("long").alias("n_own"),
        F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + m["n"]).alias("n_rows"),
        F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"])), "").alias("rendered"),
        F.array_join(F.aggregate("segments", zero, step)["spans"], ",").alias("masks"),
    )


ORACLE_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
once AS (SELECT *, count(*) AS n FROM rows GROUP BY ALL),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM rows WHERE role <> 'system'),
sided AS (
  SELECT o.conv_id, s.speaker, coalesce(floor(o.turn / {PART_TURNS}.0), -1)::BIGINT AS part, o.turn, o.role, o.text, o.n,
         o.role = s.speaker AS own,
         '{START}' || CASE WHEN o.role = s.speaker THEN 'assistant' WHEN o.role = 'system' THEN 'system'
                      ELSE 'user name=' || regexp_replace(replace(o.role, '<|', '<\|'), '\s+', '_', 'g') END || chr(10) AS head,
         replace(o.text, '<|', '<\|') || '{END}' || chr(10) AS body
  FROM once o JOIN speakers s ON o.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (
    PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS ends
  FROM sided)
SELECT conv_id, speaker, part, count(*) AS n_turns, count(*) FILTER (own) AS n_own, sum(n)::BIGINT AS n_rows,
       string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
       coalesce(string_agg((ends - length(body)) || ':' || (ends - 1), ',' ORDER BY turn NULLS FIRST, role, text) FILTER (own), '') AS masks
FROM placed GROUP BY conv_id, speaker, part
"""
