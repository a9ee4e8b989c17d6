"""Problem 4: one ordered conversation per session, and the sessions to drop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.positions import dense_position
from ..session import checkpointed
from ..tables import Tables
from .conversations import ASSISTANT, USER, walks

#: A character other than white space.
_VISIBLE = r"(?U)[^\s\x1C-\x1F]"


def turn_rows(t: Tables) -> DataFrame:
    """The current row of each entry with the turn it makes, in one shuffle of entries and speaking fragments."""
    e = t.entries.filter("session_id IS NOT NULL AND entry_id IS NOT NULL")
    e = e.select("session_id", "entry_id", F.struct("ingested_at", "append_seq", "parent_id", F.col("entry_role").alias("role")).alias("row"), F.lit(False).alias("u"), F.lit(False).alias("a"))
    f = t.fragments.filter(F.col("semantic_kind").isin("user.text", "assistant.text") & F.col("frag_text").rlike(_VISIBLE))
    user = F.col("semantic_kind") == "user.text"
    f = f.select("session_id", "entry_id", F.lit(None).cast(e.schema["row"].dataType).alias("row"), user.alias("u"), (~user).alias("a"))
    g = e.unionByName(f).groupBy("session_id", "entry_id").agg(F.max("row").alias("row"), F.max("u").alias("u"), F.max("a").alias("a")).filter("row IS NOT NULL")
    role = F.coalesce(F.col("row.role"), F.when(F.col("u"), "user").when(F.col("a"), "assistant"))
    turn = F.when((role == "user") & F.col("u"), USER).when((role == "assistant") & F.col("a"), ASSISTANT).otherwise(0)
    return g.select("session_id", "entry_id", "row.parent_id", "row.append_seq", turn.alias("turn"))


def _walks(t: Tables) -> DataFrame:
    return walks(turn_rows(t), "session_id", "entry_id", "parent_id", "append_seq", "turn")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    faults = _walks(t).filter("v IS NULL").select(F.col("k").alias("session_id"), F.coalesce("fault", F.lit("")).alias("fault"))
    known = t.sessions.select("session_id").filter("session_id IS NOT NULL").distinct()
    return known.join(faults, "session_id", "left").select("session_id", F.coalesce("fault", F.lit("empty")).alias("fault")).filter("fault <> ''")


def p4_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """The turns of the sessions that are kept: session_id, turn_no (from 0), role, entry_id, turn_text (the turn's
    speaking fragments in order, joined by line ends)."""
    t = Tables(spark, folder)
    w = checkpointed(_walks(t))
    good = w.filter("v IS NULL AND fault IS NULL").select("k").join(t.sessions.select(F.col("session_id").alias("k")).distinct(), "k", "left_semi")
    turns = w.filter("v IS NOT NULL").join(good, "k", "left_semi").select(F.col("k").alias("session_id"), F.col("v").alias("entry_id"), "back", "turn")
    f = t.fragments.filter(F.col("semantic_kind").isin("user.text", "assistant.text") & F.col("frag_text").rlike(_VISIBLE))
    f = f.select("session_id", "entry_id", "fragment_id", F.when(F.col("semantic_kind") == "user.text", USER).otherwise(ASSISTANT).alias("turn"), "frag_text").distinct()
    place = F.regexp_extract("fragment_id", r"::(\d+)$", 1).cast("long")
    texts = turns.join(f, ["session_id", "entry_id", "turn"]).groupBy("session_id", "entry_id", "back", "turn").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("i"), "fragment_id", "frag_text"))), lambda x: x["frag_text"]), "\n").alias("turn_text")
    )
    role = F.when(F.col("turn") == USER, "user").otherwise("assistant")
    order = turns.select("session_id", "entry_id", (-F.col("back")).alias("forth"))  # numbered without the texts, and in stretches
    order = dense_position(order, "session_id", "forth", "entry_id", "turn_no").select("session_id", "entry_id", "turn_no")
    return texts.join(order, ["session_id", "entry_id"]).select("session_id", "turn_no", role.alias("role"), "entry_id", "turn_text")


QUERIES = {f.__name__: f for f in (p4_found, p4_conversations)}
_SQL = r"""
WITH RECURSIVE cur AS (
  SELECT session_id, entry_id, parent_id, append_seq, entry_role FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id, entry_id ORDER BY ingested_at DESC) AS rn FROM entries) WHERE rn = 1),
speech AS (
  SELECT session_id, entry_id, max(semantic_kind = 'user.text') AS u, max(semantic_kind = 'assistant.text') AS a FROM fragments
  WHERE semantic_kind IN ('user.text', 'assistant.text')
    AND regexp_matches(frag_text, '[^\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')
  GROUP BY ALL),
roled AS (
  SELECT c.*, coalesce(s.u, false) AS u, coalesce(s.a, false) AS a,
         coalesce(c.entry_role, CASE WHEN s.u THEN 'user' WHEN s.a THEN 'assistant' END) AS r
  FROM cur c LEFT JOIN speech s USING (session_id, entry_id)),
e AS (SELECT *, CASE WHEN r = 'user' AND u THEN 1 WHEN r = 'assistant' AND a THEN 2 ELSE 0 END AS turn FROM roled),
sizes AS (SELECT session_id, count(*) AS n, arg_max(entry_id, append_seq) AS leaf FROM e GROUP BY 1),
walk AS (
  SELECT e.session_id, e.entry_id, e.parent_id, e.turn, 0 AS back FROM e JOIN sizes s ON s.session_id = e.session_id AND s.leaf = e.entry_id
  UNION ALL
  SELECT e.session_id, e.entry_id, e.parent_id, e.turn, w.back + 1
  FROM walk w JOIN e ON e.session_id = w.session_id AND e.entry_id = w.parent_id JOIN sizes s ON s.session_id = e.session_id WHERE w.back <= s.n),
ok AS (SELECT DISTINCT session_id FROM walk WHERE parent_id IS NULL),
turns AS (SELECT session_id, entry_id, turn, back, lag(turn) OVER (PARTITION BY session_id ORDER BY back) AS after_it FROM walk JOIN ok USING (session_id) WHERE turn > 0),
checked AS (SELECT session_id, max(turn = 1 AND coalesce(after_it, 1) = 1) AS bad FROM turns GROUP BY 1),
verdict AS (
  SELECT s.session_id, CASE WHEN z.n IS NULL THEN 'empty' WHEN o.session_id IS NULL THEN 'broken' WHEN c.bad IS NULL THEN 'empty' WHEN c.bad THEN 'no_reply' END AS fault
  FROM (SELECT DISTINCT session_id FROM sessions WHERE session_id IS NOT NULL) s LEFT JOIN sizes z USING (session_id) LEFT JOIN ok o USING (session_id) LEFT JOIN checked c USING (session_id))
"""
SQL = {
    "p4_found": _SQL + "SELECT session_id, fault FROM verdict WHERE fault IS NOT NULL",
    "p4_conversations": _SQL + r"""
, said AS (
  SELECT session_id, entry_id, k, string_agg(frag_text, chr(10) ORDER BY i, fragment_id) AS turn_text FROM (
    SELECT DISTINCT session_id, entry_id, fragment_id, CASE WHEN semantic_kind = 'user.text' THEN 1 ELSE 2 END AS k, frag_text, regexp_extract(fragment_id, '::(\d+)$', 1)::BIGINT AS i FROM fragments
    WHERE semantic_kind IN ('user.text', 'assistant.text')
      AND regexp_matches(frag_text, '[^\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'))
  GROUP BY ALL)
SELECT t.session_id, row_number() OVER (PARTITION BY t.session_id ORDER BY back DESC) - 1 AS turn_no,
       CASE WHEN turn = 1 THEN 'user' ELSE 'assistant' END AS role, t.entry_id, d.turn_text
FROM turns t JOIN verdict v ON v.session_id = t.session_id AND v.fault IS NULL JOIN said d ON d.session_id = t.session_id AND d.entry_id = t.entry_id AND d.k = t.turn""",
}
