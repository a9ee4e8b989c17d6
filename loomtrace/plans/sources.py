"""Queries that parse and project raw session lines as they were written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.project import project, recorded_links, role_columns, to_store
from ..operators.relations import relationships
from ..operators.search import Request, search
from ..session import checkpointed
from ..sources.jsonl import Parsed, parse, source_info
from ..tables import Tables


def _parsed(spark: SparkSession, folder: str) -> Parsed:
    return parse(Tables(spark, folder).raw_lines)


def parsed_headers(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).headers


def parsed_entries(spark: SparkSession, folder: str) -> DataFrame:
    e = _parsed(spark, folder).entries
    return e.select("file_path", "session_id", "line_no", "append_seq", "entry_id", "parent_id", "entry_ts", "entry_type")


def parse_errors(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).errors


def source_infos(spark: SparkSession, folder: str) -> DataFrame:
    s = source_info(_parsed(spark, folder))
    return s.select("file_path", "session_id", "entry_count", "first_entry_id", "last_entry_id", F.array_join("entry_hashes", ",").alias("hashes"))


def entry_roles(spark: SparkSession, folder: str) -> DataFrame:
    e = _parsed(spark, folder).entries
    return e.select("session_id", "entry_id", *role_columns(F.col("v")))


def project_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """All fragments of the raw entries, with their full texts."""
    f = project(_parsed(spark, folder).entries)
    return f.withColumn("file_paths", F.array_join("file_paths", "\n"))


def projected_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments other than calls."""
    f = project(_parsed(spark, folder).entries).filter("semantic_kind <> 'tool.call'")
    return f.select("session_id", "entry_id", "fragment_id", "semantic_kind", "frag_text", "tool_name", "tool_call_id", "custom_type")


def projected_calls(spark: SparkSession, folder: str) -> DataFrame:
    f = project(_parsed(spark, folder).entries).filter("semantic_kind = 'tool.call'")
    return f.select("session_id", "entry_id", "fragment_id", "tool_name", "tool_call_id")


def recorded_relationships(spark: SparkSession, folder: str) -> DataFrame:
    return recorded_links(_parsed(spark, folder).entries).select("session_id", "source_id", "target_id", "type", "ord")


def relationships_of_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All relationships of the raw sessions, in their groups."""
    return relationships(to_store(_parsed(spark, folder))).groupBy("session_id", "type", "grp").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("n_sources"))


def search_lines(spark: SparkSession, folder: str) -> DataFrame:
    """From raw lines to ranked hits."""
    s = to_store(_parsed(spark, folder))
    s.fragments = checkpointed(s.fragments)
    hits = search(s, Request("allocator"), limit=None)
    return hits.select("session_id", "entry_id", "fragment_id", "n_fragments", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (parsed_headers, parsed_entries, parse_errors, source_infos, entry_roles, project_fragments, projected_texts, projected_calls, recorded_relationships, relationships_of_lines, search_lines)}
_STR = "CASE WHEN json_type(j, '$.{0}') = 'VARCHAR' THEN nullif(json_extract_string(j, '$.{0}'), '') END"
_LINES = f"""
r AS (SELECT DISTINCT file_path, line_no, raw_text FROM raw_lines WHERE file_path IS NOT NULL AND raw_text IS NOT NULL),
n AS (SELECT *, CASE WHEN json_valid(raw_text) THEN raw_text::JSON END AS j, min(line_no) OVER (PARTITION BY file_path) AS first FROM r WHERE NOT regexp_full_match(raw_text, '[\\s\\x{{FEFF}}\\x{{A0}}\\x{{3000}}]*')),
m AS (SELECT *, {_STR.format('sessionId')} AS h1, {_STR.format('id')} AS h2, {_STR.format('createdAt')} AS h3, CASE WHEN json_type(j, '$.timestamp') = 'VARCHAR' THEN json_extract_string(j, '$.timestamp') END AS h4,
  {_STR.format('cwd')} AS h5, {_STR.format('type')} AS h6, json_type(j, '$.parentId') AS h7, {_STR.format('parentSession')} AS h8 FROM n),
x AS (SELECT *, CASE WHEN j IS NULL THEN 'invalid JSON' WHEN json_type(j) <> 'OBJECT' THEN 'no JSON object'
  WHEN line_no = first THEN CASE WHEN coalesce(h1, h2) IS NULL THEN 'header without session id' WHEN coalesce(h3, nullif(h4, '')) IS NULL THEN 'header without creation time' WHEN h5 IS NULL THEN 'header without cwd' END
  ELSE CASE WHEN h2 IS NULL THEN 'entry without id' WHEN h4 IS NULL THEN 'entry without timestamp' WHEN h6 IS NULL THEN 'entry without type' WHEN h7 NOT IN ('VARCHAR', 'NULL') THEN 'entry with a parent that is no string' END END AS error FROM m),
w AS (SELECT file_path, min(line_no) AS line_no, arg_min(error, line_no) AS error FROM x WHERE error IS NOT NULL GROUP BY 1),
d AS (SELECT file_path, min(line_no) AS line_no FROM (SELECT file_path, line_no, row_number() OVER (PARTITION BY file_path, h2 ORDER BY line_no) AS rn FROM x WHERE error IS NULL AND line_no <> first) WHERE rn = 2 GROUP BY 1),
bad AS (SELECT * FROM w UNION ALL SELECT file_path, line_no, 'repeated entry id' FROM d WHERE file_path NOT IN (SELECT file_path FROM w)
  UNION ALL SELECT file_path, min(line_no), 'no header' FROM r WHERE file_path NOT IN (SELECT file_path FROM n) GROUP BY 1),
hd AS (SELECT file_path, coalesce(h1, h2) AS session_id, coalesce(h3, nullif(h4, '')) AS created_at, h5 AS cwd, h8 AS parent_session FROM x WHERE line_no = first AND file_path NOT IN (SELECT file_path FROM bad)),
en AS (SELECT x.file_path, hd.session_id, line_no, row_number() OVER (PARTITION BY x.file_path ORDER BY line_no) - 1 AS append_seq, h2 AS entry_id,
  CASE WHEN h7 = 'VARCHAR' THEN json_extract_string(j, '$.parentId') END AS parent_id, h4 AS entry_ts, h6 AS entry_type, raw_text, j FROM x JOIN hd ON hd.file_path = x.file_path WHERE line_no <> first)"""
_ROLE = """
CASE entry_type WHEN 'message' THEN CASE json_extract_string(j, '$.message.role') WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'toolResult' THEN 'tool' WHEN 'bashExecution' THEN 'tool' ELSE 'metadata' END
  WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'tool_result' THEN 'tool' WHEN 'bash' THEN 'tool' WHEN 'compaction' THEN 'summary' WHEN 'branch_summary' THEN 'summary'
  WHEN 'custom' THEN 'custom' WHEN 'custom_message' THEN 'custom' ELSE 'metadata' END AS entry_role,
CASE WHEN entry_type = 'message' AND json_extract_string(j, '$.message.role') = 'bashExecution' AND json_extract(j, '$.message.excludeFromContext')::VARCHAR = 'true' THEN 'control'
  WHEN entry_type IN ('message', 'user', 'assistant', 'tool_result', 'bash', 'custom', 'custom_message') THEN 'conversation'
  WHEN entry_type IN ('compaction', 'branch_summary') THEN 'summary' WHEN entry_type IN ('session_info', 'label') THEN 'metadata' ELSE 'control' END AS context_role"""
SQL = {
    "parsed_headers": f"WITH {_LINES} SELECT * FROM hd",
    "parsed_entries": f"WITH {_LINES} SELECT file_path, session_id, line_no, append_seq, entry_id, parent_id, entry_ts, entry_type FROM en",
    "parse_errors": f"WITH {_LINES} SELECT file_path, line_no, error FROM bad",
    "source_infos": f"""
WITH {_LINES} SELECT hd.file_path, hd.session_id, count(en.entry_id) AS entry_count, arg_min(entry_id, append_seq) AS first_entry_id, arg_max(entry_id, append_seq) AS last_entry_id,
  coalesce(string_agg(substr(sha256(raw_text), 1, 8), ',' ORDER BY append_seq), '') AS hashes FROM hd LEFT JOIN en USING (file_path) GROUP BY ALL""",
    "entry_roles": f"WITH {_LINES} SELECT session_id, entry_id, {_ROLE} FROM en",
    "projected_texts": f"""
WITH {_LINES} SELECT DISTINCT f.session_id, f.entry_id, replace(fragment_id, '::bash.output::0', '::bash.output::1') AS fragment_id, semantic_kind, frag_text, tool_name, tool_call_id, custom_type
FROM fragments f JOIN en ON en.session_id = f.session_id AND en.entry_id = f.entry_id WHERE semantic_kind <> 'tool.call'""",
    "projected_calls": f"""
WITH {_LINES} SELECT DISTINCT f.session_id, f.entry_id, fragment_id, tool_name, tool_call_id
FROM fragments f JOIN en ON en.session_id = f.session_id AND en.entry_id = f.entry_id WHERE semantic_kind = 'tool.call'""",
    "recorded_relationships": f"""
WITH {_LINES}, t AS (SELECT session_id, entry_id AS source_id, entry_type, CASE entry_type
    WHEN 'compaction' THEN coalesce(json_extract_string(j, '$.compactedUpToId'), json_extract_string(j, '$.firstKeptEntryId'), json_extract_string(j, '$.fromId'))
    WHEN 'branch_summary' THEN json_extract_string(j, '$.fromId') WHEN 'label' THEN json_extract_string(j, '$.targetId') END AS target_id FROM en)
SELECT session_id, source_id, target_id, CASE entry_type WHEN 'compaction' THEN 'compacts' WHEN 'branch_summary' THEN 'branch-summary-from' ELSE 'labels' END AS type, 0::BIGINT AS ord FROM t WHERE target_id IS NOT NULL""",
}
