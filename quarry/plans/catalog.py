"""Registered queries: one per operator of the inventory.

``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, oracle_sql or None)``.
Every query reads the whole test tables (through the ``FX_*`` views), so its
work grows with the scale factor. Oracle SQL is DuckDB over the same parquet
files; column names and types match the Spark output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import rules as nrules
from quarry.functions import text as ntext
from quarry.functions.redact import redact_json
from quarry.operators import checks, entity, intake, ledger, raw, schema_rules, tables, tenancy
from quarry.operators import profile as prof
from quarry.plans import fixtures as fx
from quarry.plans import pipeline as pl
from quarry.plans.oracle_fixtures import WS, js_trim, utf16_len, with_fx
from quarry.sources import delimited, split, workbook_stream
from quarry.sources.dispatch import parse_files, parse_partitions, split_parsed

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = (fn, oracle)
        return fn
    return deco


# ====================================================================== I
def _policy_sql(n: str, size: str, mime: str) -> str:
    ext = f"lower(regexp_extract({n}, '(\\.[^.]*)$', 1))"
    allowed = f"""CASE {ext}
      WHEN '.csv' THEN {mime} IN ('text/csv','application/csv','application/octet-stream')
      WHEN '.tsv' THEN {mime} IN ('text/tab-separated-values','text/tsv','application/octet-stream')
      WHEN '.json' THEN {mime} IN ('application/json','text/json','application/octet-stream')
      WHEN '.xlsx' THEN {mime} IN ('application/vnd.openxmlformats-officedocument.spreadsheetml.sheet','application/octet-stream')
      WHEN '.xlsm' THEN {mime} IN ('application/vnd.ms-excel.sheet.macroEnabled.12','application/vnd.openxmlformats-officedocument.spreadsheetml.sheet','application/octet-stream')
      WHEN '.pdf' THEN {mime} IN ('application/pdf','application/octet-stream') END"""
    return f"""CASE WHEN {n} = '' THEN 'Filename is required'
      WHEN {utf16_len(n)} > 255 THEN 'Filename is too long'
      WHEN contains({n}, '\\') OR contains({n}, '/') THEN 'Filename must not contain path separators'
      WHEN {n} IN ('.', '..') THEN 'Invalid filename'
      WHEN regexp_matches({n}, '[\\x00-\\x1F\\x7F]') THEN 'Filename contains control characters'
      WHEN {ext} NOT IN ('.csv','.tsv','.json','.xlsx','.xlsm','.pdf')
        THEN 'Unsupported file extension: ' || CASE WHEN {ext} = '' THEN '(none)' ELSE {ext} END
      WHEN {size} IS NULL OR {size} < 0 OR {size} > 26214400 THEN 'File exceeds configured size limit'
      WHEN {mime} IS NULL OR {mime} = '' THEN 'MIME type is required'
      WHEN NOT ({allowed}) AND {mime} <> 'application/octet-stream' THEN 'MIME type does not match extension: ' || {mime}
      WHEN contains({n}, '..') THEN 'Invalid storage key' END"""


@query("file_policy", with_fx(["fx_uploads"], f"""
SELECT seq, tenant_id, n AS clean_filename, lower(regexp_extract(n, '(\\.[^.]*)$', 1)) AS extension,
  {_policy_sql('n', 'size_bytes', 'mime_type')} AS reject_reason
FROM (SELECT *, {js_trim("coalesce(filename, '')")} AS n FROM fx_uploads)"""))
def q_file_policy(spark, sf):
    return intake.file_policy(fx.uploads(spark, sf), intake.MAX_BYTES).select(
        "seq", "tenant_id", "clean_filename", "extension", "reject_reason")


@query("content_checksum", "SELECT doc_id, sha256(text) AS checksum_sha256 FROM documents")
def q_content_checksum(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return intake.checksum(d).select("doc_id", "checksum_sha256")


@query("checksum_dedup", """
SELECT doc_id, lang AS tenant_id, cs AS checksum_sha256, first_doc_id,
  (doc_id <> first_doc_id) AS duplicate
FROM (SELECT doc_id, lang, sha256(text) AS cs,
        min(doc_id) OVER (PARTITION BY lang, sha256(text)) AS first_doc_id FROM documents)""")
def q_checksum_dedup(spark, sf):
    d = fx.table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("tenant_id"), F.col("text").alias("content"))
    return intake.dedup_by_checksum(intake.checksum(d).drop("content"), "doc_id").select(
        "doc_id", "tenant_id", "checksum_sha256", F.col("first_seq").alias("first_doc_id"), "duplicate")


_RESOLVE_CTES = f"""
WITH r AS (
  SELECT u.seq, u.tenant_id, u.source_id, u.mime_type, u.size_bytes, sha256(u.content) AS cs,
    CASE WHEN u.idempotency_key IS NOT NULL THEN {js_trim('u.idempotency_key')} END AS idem_key,
    u.idempotency_key AS key_raw,
    {js_trim("coalesce(u.filename, '')")} AS n,
    EXISTS (SELECT 1 FROM fx_sources s WHERE s.tenant_id = u.tenant_id AND s.id = u.source_id) AS source_ok
  FROM fx_uploads u),
r2 AS (SELECT *, (key_raw IS NULL OR (idem_key <> '' AND {utf16_len('idem_key')} <= 255)) AS key_ok,
         {_policy_sql('n', 'size_bytes', 'mime_type')} AS policy FROM r),
r3 AS (SELECT *, key_ok AND source_ok AND policy IS NULL AS valid FROM r2),
kf AS (SELECT tenant_id, idem_key, min(seq) AS key_seq FROM r3 WHERE valid AND idem_key IS NOT NULL GROUP BY ALL),
r4 AS (SELECT r3.*, kf.key_seq,
         CASE WHEN NOT key_ok THEN 'REJECTED'
              WHEN r3.idem_key IS NOT NULL AND kf.key_seq IS NOT NULL AND seq > kf.key_seq THEN 'REPLAY'
              WHEN NOT source_ok THEN 'REJECTED' WHEN policy IS NOT NULL THEN 'REJECTED' END AS status0,
         CASE WHEN NOT key_ok THEN 'Invalid Idempotency-Key' WHEN NOT source_ok THEN 'Source not found'
              ELSE policy END AS why
       FROM r3 LEFT JOIN kf ON r3.tenant_id = kf.tenant_id AND r3.idem_key = kf.idem_key),
cf AS (SELECT tenant_id, cs, min(seq) AS first_seq FROM r4 WHERE status0 IS NULL GROUP BY ALL),
c AS (SELECT r4.*, CASE WHEN r4.seq = cf.first_seq THEN 'NEW' ELSE 'DUPLICATE' END AS status,
         sha256('file|' || r4.tenant_id || '|' || r4.cs) AS file_id
      FROM r4 JOIN cf ON r4.tenant_id = cf.tenant_id AND r4.cs = cf.cs WHERE r4.status0 IS NULL)
"""

_RESOLVE_SQL = _RESOLVE_CTES + """
SELECT seq, tenant_id, status, CAST(NULL AS VARCHAR) AS reason, file_id, status = 'DUPLICATE' AS duplicate,
  false AS idempotent_replay, cs AS checksum_sha256 FROM c
UNION ALL
SELECT r4.seq, r4.tenant_id, 'REPLAY', NULL, c.file_id, c.status = 'DUPLICATE', true, r4.cs
FROM r4 JOIN c ON r4.tenant_id = c.tenant_id AND r4.key_seq = c.seq WHERE r4.status0 = 'REPLAY'
UNION ALL
SELECT seq, tenant_id, 'REJECTED', why, NULL, NULL, false, cs FROM r4 WHERE status0 = 'REJECTED'
"""


@query("intake_resolve", with_fx(["fx_uploads", "fx_sources"], _RESOLVE_SQL))
def q_intake_resolve(spark, sf):
    res = intake.resolve_uploads(fx.uploads(spark, sf), fx.sources(spark, sf), max_bytes=intake.MAX_BYTES)
    return res.select("seq", "tenant_id", "status", "reason", "file_id", "duplicate",
                      "idempotent_replay", "checksum_sha256")


@query("intake_history", with_fx(["fx_uploads", "fx_sources"], _RESOLVE_SQL))
def q_intake_history(spark, sf):
    """Three batches in turn give what one sequence of all uploads does."""
    u = fx.uploads(spark, sf)
    third = (u.agg(F.max("seq")).first()[0] or 0) // 3
    parts = [u.where(F.col("seq") <= third), u.where((F.col("seq") > third) & (F.col("seq") <= 2 * third)),
             u.where(F.col("seq") > 2 * third)]
    out = None
    for res in intake.resolve_in_turn(parts, fx.sources(spark, sf), intake.MAX_BYTES):
        res = res.select("seq", "tenant_id", "status", "reason", "file_id", "duplicate", "idempotent_replay", "checksum_sha256")
        out = res if out is None else out.unionByName(res)
    return out


@query("intake_replay_history", with_fx(["fx_uploads", "fx_sources"], _RESOLVE_CTES + """,
again AS (
  SELECT r3.*, kf.key_seq,
    CASE WHEN NOT key_ok THEN 'REJECTED' WHEN r3.idem_key IS NOT NULL AND kf.key_seq IS NOT NULL THEN 'REPLAY'
         WHEN NOT source_ok OR policy IS NOT NULL THEN 'REJECTED' ELSE 'DUPLICATE' END AS status,
    CASE WHEN NOT key_ok THEN 'Invalid Idempotency-Key' WHEN NOT source_ok THEN 'Source not found' ELSE policy END AS why
  FROM r3 LEFT JOIN kf ON r3.tenant_id = kf.tenant_id AND r3.idem_key = kf.idem_key)
SELECT a.seq, a.tenant_id, a.status, CASE WHEN a.status = 'REJECTED' THEN a.why END AS reason,
  CASE a.status WHEN 'REPLAY' THEN c.file_id WHEN 'DUPLICATE' THEN sha256('file|' || a.tenant_id || '|' || a.cs) END AS file_id,
  CASE a.status WHEN 'REPLAY' THEN c.status = 'DUPLICATE' WHEN 'DUPLICATE' THEN true END AS duplicate,
  a.status = 'REPLAY' AS idempotent_replay
FROM again a LEFT JOIN c ON a.status = 'REPLAY' AND a.tenant_id = c.tenant_id AND a.key_seq = c.seq"""))
def q_intake_replay_history(spark, sf):
    """The same uploads once more: keys replay, other files are duplicates."""
    u = fx.uploads(spark, sf)
    again = intake.resolve_in_turn([u, u], fx.sources(spark, sf), intake.MAX_BYTES)[1]
    return again.select("seq", "tenant_id", "status", "reason", "file_id", "duplicate", "idempotent_replay")


@query("ingest_manifest", with_fx(["fx_uploads", "fx_sources"], _RESOLVE_CTES + """
SELECT file_id, tenant_id, source_id, n AS original_name, lower(regexp_extract(n, '(\\.[^.]*)$', 1)) AS extension,
  size_bytes, cs AS checksum_sha256, 'VERIFIED' AS status,
  tenant_id || '/sources/' || file_id || '/' || replace(n, '/', '_') AS storage_key, 1 AS version
FROM c WHERE status = 'NEW'"""))
def q_ingest_manifest(spark, sf):
    res = intake.resolve_uploads(fx.uploads(spark, sf), fx.sources(spark, sf), max_bytes=intake.MAX_BYTES)
    files, artifacts = intake.ingest_manifest(res)
    return files.join(artifacts.select(F.col("source_file_id").alias("id"), "storage_key", "version"), "id").select(
        F.col("id").alias("file_id"), "tenant_id", "source_id", "original_name", "extension",
        "size_bytes", "checksum_sha256", "status", "storage_key", "version")


@query("source_gate", with_fx(["fx_uploads", "fx_sources"], """
SELECT seq, tenant_id, source_id,
  EXISTS (SELECT 1 FROM fx_sources s WHERE s.tenant_id = u.tenant_id AND s.id = u.source_id) AS source_ok
FROM fx_uploads u"""))
def q_source_gate(spark, sf):
    return intake.source_gate(fx.uploads(spark, sf).select("seq", "tenant_id", "source_id"),
                              fx.sources(spark, sf)).select("seq", "tenant_id", "source_id", "source_ok")


# ====================================================================== I7-I12


def _records_of(files: DataFrame) -> DataFrame:
    # the generated files come out of an aggregation: spread them over all cores
    recs, _ = split_parsed(parse_files(files, partitions=parse_partitions(files.sparkSession)))
    return recs.select(F.col("file_id").cast("long").alias("file_id"), "record_number", "payload")


@query("detect_delimiter", with_fx(["fx_csv"], """
SELECT file_id, CASE WHEN c >= t AND c >= s THEN ',' WHEN t >= s THEN chr(9) ELSE ';' END AS delimiter
FROM (SELECT file_id, length(l) - length(replace(l, ',', '')) AS c,
        length(l) - length(replace(l, chr(9), '')) AS t, length(l) - length(replace(l, ';', '')) AS s
      FROM (SELECT file_id, regexp_extract(content, '^([^\\n]*?)(\\r?\\n|$)', 1) AS l FROM fx_csv))"""))
def q_detect_delimiter(spark, sf):
    return fx.csv_files(spark, sf).select("file_id", delimited.detect_delimiter(F.col("content")).alias("delimiter"))


_ORDERS_RECORDS_SQL = """
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY o_orderkey)::BIGINT AS record_number,
  json_object('o_orderkey', t_orderkey, 'o_custkey', t_custkey, 'o_orderstatus', t_orderstatus,
              'o_totalprice', t_totalprice, 'o_orderdate', t_orderdate,
              'o_orderpriority', CASE WHEN o_orderkey % 7 = 0 THEN t_orderpriority || '"x' ELSE t_orderpriority END
  )::VARCHAR AS payload
FROM fx_order_text"""

_EVENTS_RECORDS_SQL = """
SELECT event_id // 100 AS file_id, row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id)::BIGINT AS record_number,
  CASE WHEN event_id % 10 = 0 THEN '{"value":' || event_id::VARCHAR || '}'
       ELSE json_object('event_id', event_id, 'event_type', event_type)::VARCHAR END AS payload
FROM events"""


@query("parse_delimited", with_fx(["fx_order_text"], _ORDERS_RECORDS_SQL))
def q_parse_delimited(spark, sf):
    return _records_of(fx.csv_files(spark, sf))


@query("parse_json", _EVENTS_RECORDS_SQL)
def q_parse_json(spark, sf):
    return _records_of(fx.json_files(spark, sf))


def _split_records(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("file_id").cast("long").alias("file_id"), "record_number", "payload", F.substring_index("error", ":", 1).alias("error"))


@query("parse_delimited_split", with_fx(["fx_order_text"], f"""
SELECT file_id % 6 AS file_id, row_number() OVER (PARTITION BY file_id % 6 ORDER BY key)::BIGINT AS record_number, payload, NULL::VARCHAR AS error
FROM ({_ORDERS_RECORDS_SQL.replace("SELECT file_id,", "SELECT file_id, o_orderkey AS key,")})
UNION ALL SELECT 100, NULL, NULL, 'Unclosed quoted field'"""))
def q_parse_delimited_split(spark, sf):
    return _split_records(split.parse_delimited_split(fx.csv_ranges(spark, sf)))


@query("parse_json_split", f"""
SELECT file_id % 4 AS file_id, (1 + row_number() OVER (PARTITION BY file_id % 4 ORDER BY key))::BIGINT AS record_number, payload, NULL::VARCHAR AS error
FROM ({_EVENTS_RECORDS_SQL.replace("AS file_id,", "AS file_id, event_id AS key,", 1)})
UNION ALL SELECT DISTINCT event_id // 100 % 4, 1, '{{"value":0}}', NULL FROM events
UNION ALL SELECT 100, NULL, NULL, 'Invalid JSON'""")
def q_parse_json_split(spark, sf):
    return _split_records(split.parse_json_split(fx.json_ranges(spark, sf)))


_WORKBOOK_SQL = """
SELECT s_suppkey // 100 AS file_id, row_number() OVER (PARTITION BY s_suppkey // 100 ORDER BY s_suppkey)::BIGINT AS record_number,
  json_object('s_suppkey', s_suppkey::VARCHAR, 's_name', s_name, 's_nationkey', s_nationkey::VARCHAR,
              's_acctbal', CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal::DECIMAL(18,2)::VARCHAR END)::VARCHAR AS payload
FROM supplier"""


@query("workbook_rows", _WORKBOOK_SQL)
def q_workbook_rows(spark, sf):
    return _records_of(fx.workbook_files(spark, sf))


@query("workbook_rows_streamed", _WORKBOOK_SQL)
def q_workbook_rows_streamed(spark, sf):
    parsed = workbook_stream.parse_workbooks(fx.workbook_files(spark, sf))
    return parsed.select(F.col("file_id").cast("long").alias("file_id"), "record_number", "payload")


def _doc_files(spark, sf):
    d = fx.table(spark, sf, "documents")
    ext = F.when(F.col("doc_id") % 4 == 0, F.lit(".pdf")).otherwise(F.lit(".txt"))
    return d.select(F.col("doc_id").alias("file_id"),
                    F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), ext).alias("filename"),
                    F.col("text").cast("binary").alias("content"))


@query("text_artifact", """
SELECT doc_id AS file_id, 1::BIGINT AS record_number,
  json_object('extracted_text', regexp_replace(text, '^\\x{FEFF}', ''))::VARCHAR AS payload
FROM documents""")
def q_text_artifact(spark, sf):
    d = fx.table(spark, sf, "documents")
    files = d.select(F.col("doc_id").alias("file_id"),
                     F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
                     F.col("text").cast("binary").alias("content"))
    return _records_of(files)


@query("parse_dispatch", with_fx(["fx_order_text"], f"""
SELECT 'csv' AS lane, file_id, record_number, payload, NULL::VARCHAR AS error FROM ({_ORDERS_RECORDS_SQL})
UNION ALL SELECT 'json', file_id, record_number, payload, NULL FROM ({_EVENTS_RECORDS_SQL})
UNION ALL SELECT 'doc', doc_id, CASE WHEN doc_id % 4 = 0 THEN 1 END,
  CASE WHEN doc_id % 4 = 0 THEN json_object('extracted_text', regexp_replace(text, '^\\x{{FEFF}}', ''))::VARCHAR END,
  CASE WHEN doc_id % 4 <> 0 THEN 'Unsupported parser: .txt' END
FROM documents"""))
def q_parse_dispatch(spark, sf):
    files = (fx.csv_files(spark, sf).select(F.lit("csv").alias("lane"), "file_id", "filename", F.col("content").cast("binary").alias("content"))
             .unionByName(fx.json_files(spark, sf).select(F.lit("json").alias("lane"), "file_id", "filename", F.col("content").cast("binary").alias("content")))
             .unionByName(_doc_files(spark, sf).select(F.lit("doc").alias("lane"), "file_id", "filename", "content")))
    keyed = files.withColumn("file_id", F.concat_ws(":", "lane", F.col("file_id").cast("string")))
    parsed = parse_files(keyed)
    parts = F.split(F.col("file_id"), ":")
    return parsed.select(parts[0].alias("lane"), parts[1].cast("long").alias("file_id"),
                         "record_number", "payload", "error")


# ====================================================================== R
@query("snapshot_versions", with_fx(["fx_snap"], """
SELECT b.tenant_id, b.source_file_id, b.seq,
  (coalesce(p.n, 0) + row_number() OVER (PARTITION BY b.source_file_id ORDER BY b.seq))::BIGINT AS snapshot_version
FROM (SELECT * FROM fx_snap WHERE seq % 4 <> 0) b
LEFT JOIN (SELECT source_file_id, count(*) AS n FROM fx_snap WHERE seq % 4 = 0 GROUP BY ALL) p
  ON b.source_file_id = p.source_file_id"""))
def q_snapshot_versions(spark, sf):
    s = fx.snapshots(spark, sf)
    out = raw.snapshot_versions(s.filter(F.col("seq") % 4 != 0), s.filter(F.col("seq") % 4 == 0))
    return out.select("tenant_id", "source_file_id", "seq", "snapshot_version")


_KEYS_SQL = "(SELECT snapshot_id, list_sort(list(DISTINCT k)) AS cols FROM (SELECT snapshot_id, unnest(json_keys(payload)) AS k FROM fx_records) GROUP BY ALL)"


@query("schema_hash", with_fx(["fx_records"], f"""
SELECT snapshot_id, to_json(cols)::VARCHAR AS columns_json, sha256(to_json(cols)::VARCHAR) AS schema_hash FROM {_KEYS_SQL}"""))
def q_schema_hash(spark, sf):
    return raw.column_union(fx.records(spark, sf)).select("snapshot_id", "columns_json", "schema_hash")


@query("raw_snapshot", with_fx(["fx_records"], f"""
SELECT r.snapshot_id, r.record_count, sha256(to_json(k.cols)::VARCHAR) AS schema_hash,
  'parser-1' AS parser_version, 'COMPLETE' AS status
FROM (SELECT snapshot_id, count(*) AS record_count FROM fx_records GROUP BY ALL) r JOIN {_KEYS_SQL} k USING (snapshot_id)"""))
def q_raw_snapshot(spark, sf):
    return raw.build_snapshots(fx.records(spark, sf))


@query("record_limit", with_fx(["fx_records"], """
SELECT snapshot_id, count(*) AS record_count,
  CASE WHEN count(*) > 25 THEN 'REJECTED' ELSE 'ACCEPTED' END AS status,
  CASE WHEN count(*) > 25 THEN 'RAW record limit exceeded' END AS reason,
  CASE WHEN count(*) > 25 THEN 'INGESTION_ERROR' END AS error_code
FROM fx_records GROUP BY snapshot_id"""))
def q_record_limit(spark, sf):
    _, verdicts = raw.record_limit(fx.records(spark, sf), 25)
    return verdicts


@query("latest_snapshot", with_fx(["fx_snap"], """
SELECT tenant_id, source_file_id, max(seq) AS seq, count(*)::BIGINT AS snapshot_version
FROM fx_snap GROUP BY ALL"""))
def q_latest_snapshot(spark, sf):
    s = raw.snapshot_versions(fx.snapshots(spark, sf))
    return raw.latest_snapshot(s.select("tenant_id", "source_file_id", "seq", "snapshot_version"))


@query("ordered_records", with_fx(["fx_records"], """
SELECT record_number, payload FROM fx_records WHERE tenant_id = 't0' AND snapshot_id = 'Brand#1/0'"""))
def q_ordered_records(spark, sf):
    return raw.ordered_records(fx.records(spark, sf), "t0", "Brand#1/0").select("record_number", "payload")


# ====================================================================== P
_CELLS_SQL = """
keys AS (SELECT snapshot_id, record_number, unnest(json_keys(payload)) AS k,
           generate_subscripts(json_keys(payload), 1) AS pos FROM fx_records),
ord AS (SELECT snapshot_id, k AS column_name,
          row_number() OVER (PARTITION BY snapshot_id ORDER BY min(record_number * 100000 + pos))::BIGINT AS position
        FROM keys GROUP BY snapshot_id, k),
cells AS (SELECT r.snapshot_id, r.record_number, o.column_name,
            list_contains(json_keys(r.payload), o.column_name) AS present,
            json_extract(r.payload, '$."' || o.column_name || '"') AS v
          FROM fx_records r JOIN ord o USING (snapshot_id)),
cells2 AS (SELECT *, json_type(v) AS t,
             NOT (present AND (json_type(v) = 'NULL' OR (json_type(v) = 'VARCHAR' AND json_extract_string(v, '$') = ''))) AS inc
           FROM cells)"""


@query("column_order", with_fx(["fx_records"], "WITH " + _CELLS_SQL.split("cells AS")[0].rstrip().rstrip(",") + """
SELECT snapshot_id, column_name, position FROM ord"""))
def q_column_order(spark, sf):
    return prof.column_order(fx.records(spark, sf))


@query("column_stats", with_fx(["fx_records"], "WITH " + _CELLS_SQL + """
SELECT snapshot_id, column_name, count(*)::BIGINT AS row_count, count(*) FILTER (WHERE inc)::BIGINT AS non_null,
  count(DISTINCT CASE WHEN inc THEN CASE WHEN NOT present THEN 'undefined' WHEN t = 'VARCHAR' THEN json_extract_string(v, '$')
                                        WHEN t = 'OBJECT' THEN '[object Object]' ELSE v::VARCHAR END END)::BIGINT AS distinct_count,
  1 - count(*) FILTER (WHERE inc) / count(*) AS null_rate
FROM cells2 GROUP BY ALL"""))
def q_column_stats(spark, sf):
    return prof.sparse_stats(fx.records(spark, sf))


@query("column_examples", with_fx(["fx_records"], "WITH " + _CELLS_SQL + """
SELECT snapshot_id, column_name, example_rank, example_json FROM (
  SELECT snapshot_id, column_name,
    row_number() OVER (PARTITION BY snapshot_id, column_name ORDER BY record_number)::BIGINT AS example_rank,
    CASE WHEN present THEN v::VARCHAR ELSE 'null' END AS example_json
  FROM cells2 WHERE inc) WHERE example_rank <= 3"""))
def q_column_examples(spark, sf):
    return prof.sparse_examples(fx.records(spark, sf), 3)


_SCORES_SQL = """
scores AS (SELECT snapshot_id,
  count(*) FILTER (WHERE regexp_matches(column_name, '(?i)article|sku|reference|designation|barcode|ean'))::BIGINT AS article,
  count(*) FILTER (WHERE regexp_matches(column_name, '(?i)client|customer|siren|siret|vat'))::BIGINT AS customer,
  count(*) FILTER (WHERE regexp_matches(column_name, '(?i)supplier|fournisseur|siren|siret'))::BIGINT AS supplier
  FROM {src} GROUP BY snapshot_id),
dec AS (SELECT *, greatest(article, customer, supplier) AS top,
  CASE WHEN greatest(article, customer, supplier) = article THEN greatest(customer, supplier)
       WHEN greatest(article, customer, supplier) = customer THEN greatest(article, supplier)
       ELSE greatest(article, customer) END AS second FROM scores),
dec2 AS (SELECT snapshot_id, article, customer, supplier,
  CASE WHEN top >= 2 AND top > second THEN CASE WHEN top = article THEN 'ARTICLE' WHEN top = customer THEN 'CUSTOMER' ELSE 'SUPPLIER' END
       ELSE 'UNKNOWN' END AS domain,
  CASE WHEN top >= 3 AND top > second THEN 'HIGH' WHEN top >= 2 AND top > second THEN 'MEDIUM' ELSE 'LOW' END AS confidence
  FROM dec)"""


@query("domain_scores", with_fx(["fx_columns"], "WITH " + _SCORES_SQL.format(src="fx_columns").split("dec AS")[0].rstrip().rstrip(",") + """
SELECT * FROM scores"""))
def q_domain_scores(spark, sf):
    return prof.domain_scores(fx.columns(spark, sf))


@query("domain_decision", with_fx(["fx_columns"], "WITH " + _SCORES_SQL.format(src="fx_columns") + """
SELECT * FROM dec2"""))
def q_domain_decision(spark, sf):
    return prof.domain_decision(prof.domain_scores(fx.columns(spark, sf)))


@query("profile_report", with_fx(["fx_records"], "WITH " + _CELLS_SQL.split("cells AS")[0].rstrip().rstrip(",") + ",\n"
       + _SCORES_SQL.format(src="ord") + """
SELECT r.snapshot_id, d.domain, d.confidence, r.row_count, l.column_count, l.columns,
  '{"ARTICLE":' || d.article::VARCHAR || ',"CUSTOMER":' || d.customer::VARCHAR || ',"SUPPLIER":' || d.supplier::VARCHAR || '}' AS candidates
FROM (SELECT snapshot_id, count(*)::BIGINT AS row_count FROM fx_records GROUP BY ALL) r
JOIN (SELECT snapshot_id, count(*)::BIGINT AS column_count, to_json(list(column_name ORDER BY position))::VARCHAR AS columns
      FROM ord GROUP BY ALL) l USING (snapshot_id)
JOIN dec2 d USING (snapshot_id)"""))
def q_profile_report(spark, sf):
    return prof.profile_report(fx.records(spark, sf))


# ====================================================================== N


def _docs(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", "text")


def _norm_query(name: str, fn, sql_expr: str):
    @query(name, f"SELECT doc_id, {sql_expr} AS value FROM documents")
    def q(spark, sf):
        return _docs(spark, sf).select("doc_id", fn(F.col("text")).alias("value"))
    return q


def _collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


_norm_query("norm_trim", ntext.js_trim, js_trim("text"))
_norm_query("norm_lowercase", ntext.lowercase, "lower(text)")
_norm_query("norm_uppercase", ntext.uppercase, "upper(replace(text, 'ß', 'SS'))")
_norm_query("norm_collapse", ntext.collapse_whitespace, _collapse_sql("text"))
_norm_query("norm_strip_diacritics", ntext.strip_diacritics, "strip_accents(text)")
_norm_query("norm_identifier", ntext.identifier_compact, "upper(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))")

CHAIN = ["collapse_whitespace", "strip_diacritics", "uppercase", "trim"]


@query("norm_chain", f"""
SELECT p_partkey, {js_trim("upper(strip_accents(" + _collapse_sql("p_name") + "))")} AS value FROM part""")
def q_norm_chain(spark, sf):
    p = fx.table(spark, sf, "part")
    return p.select("p_partkey", nrules.chain(F.col("p_name"), CHAIN).alias("value"))


FIELD_RULES = {"reference": ["trim", "uppercase"], "designation": ["collapse_whitespace"],
               "ean": ["identifier_compact"]}


def _explode_payload(df: DataFrame, col: str) -> DataFrame:
    m = nrules.payload_map(F.col(col))
    return df.select("snapshot_id", "record_number", F.explode(m).alias("field", "v")).select(
        "snapshot_id", "record_number", "field", F.to_json("v").alias("value_json"))


@query("norm_payload", with_fx(["fx_records"], f"""
SELECT snapshot_id, record_number, 'reference' AS field, to_json(upper({js_trim('ref')}))::VARCHAR AS value_json FROM fx_records
UNION ALL SELECT snapshot_id, record_number, 'designation', to_json({_collapse_sql('des')})::VARCHAR FROM fx_records
UNION ALL SELECT snapshot_id, record_number, 'ean',
  CASE WHEN p_partkey % 5 = 0 THEN 'null' WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR
       ELSE to_json(upper(regexp_replace(p_size::VARCHAR, '[^A-Za-z0-9]', '', 'g')))::VARCHAR END
FROM fx_records WHERE p_partkey % 3 <> 0"""))
def q_norm_payload(spark, sf):
    n = nrules.normalize_payload(fx.records(spark, sf), FIELD_RULES)
    return _explode_payload(n, "normalized_payload")


# ====================================================================== E

IDENTITY_FIELDS = ["reference", "ean"]


@query("identity_projection", with_fx(["fx_records"], """
SELECT snapshot_id, record_number, 'reference' AS field, to_json(ref)::VARCHAR AS value_json FROM fx_records
UNION ALL SELECT snapshot_id, record_number, 'ean',
  CASE WHEN p_partkey % 5 = 0 THEN 'null' WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE '"' || p_size::VARCHAR || '"' END
FROM fx_records WHERE p_partkey % 3 <> 0"""))
def q_identity_projection(spark, sf):
    ids = entity.identity_projection(fx.records(spark, sf), IDENTITY_FIELDS)
    return _explode_payload(ids, "identity_payload")


# ---------------------------------------------------------------- E2-E6

PIPELINE_CONFIG = {"identity_fields": ["reference"], "field_rules": FIELD_RULES}
_CFG = ledger.config_snapshot(PIPELINE_CONFIG)


def _enriched_records(spark, sf):
    r = fx.records(spark, sf)
    return (r.withColumn("source_record_id", entity.record_id(F.col("snapshot_id"), F.col("record_number")))
             .withColumn("run_id", pl.run_id_col(_CFG["configuration_hash"])))


def _entities(spark, sf):
    r = _enriched_records(spark, sf)
    rep = prof.profile_report(r.select("snapshot_id", "record_number", "payload"))
    return entity.build_entities(r.join(rep.select("snapshot_id", "domain"), "snapshot_id"), PIPELINE_CONFIG)


_IDS_SQL = f"""
ids AS (SELECT *, sha256('record|' || snapshot_id || '|' || record_number::VARCHAR) AS source_record_id,
          sha256('run|' || tenant_id || '|' || source_file_id || '|' || snapshot_id || '|{_CFG['configuration_hash']}') AS run_id
        FROM fx_records),
ents AS (SELECT ids.*, d.domain, sha256('entity|' || run_id || '|' || source_record_id || '|1') AS entity_id,
  '{{"reference":' || to_json(upper({js_trim('ref')}))::VARCHAR || ',"designation":' || to_json({_collapse_sql('des')})::VARCHAR ||
  CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN ',"ean":null'
       WHEN p_partkey % 2 = 0 THEN ',"ean":' || p_size::VARCHAR
       ELSE ',"ean":' || to_json(upper(regexp_replace(p_size::VARCHAR, '[^A-Za-z0-9]', '', 'g')))::VARCHAR END || '}}' AS normalized_payload,
  '{{"reference":' || to_json(ref)::VARCHAR || '}}' AS identity_payload
  FROM ids JOIN dec2 d USING (snapshot_id))"""

_ENT_SQL = ("WITH " + _CELLS_SQL.split("cells AS")[0].rstrip().rstrip(",") + ",\n" + _SCORES_SQL.format(src="ord")
            + "," + _IDS_SQL)


@query("entity_build", with_fx(["fx_records"], _ENT_SQL + """
SELECT entity_id, tenant_id, domain AS entity_type, source_id, source_file_id, source_record_id, run_id,
  normalized_payload, identity_payload, 1 AS version, 'ACTIVE' AS status FROM ents"""))
def q_entity_build(spark, sf):
    return _entities(spark, sf)


@query("entity_insert_if_absent", with_fx(["fx_records"], _ENT_SQL + """
SELECT entity_id, source_record_id FROM ents WHERE record_number % 2 = 1"""))
def q_entity_insert_if_absent(spark, sf):
    ents = _entities(spark, sf)
    r = _enriched_records(spark, sf).filter(F.col("record_number") % 2 == 0)
    existing = r.select("tenant_id", "run_id", "source_record_id", F.lit(1).alias("version"))
    return entity.insert_if_absent(ents, existing).select("entity_id", "source_record_id")


@query("entity_create_checked", with_fx(["fx_records"], "WITH " + _IDS_SQL.split("ents AS")[0].rstrip().rstrip(",") + """,
inp AS (SELECT snapshot_id || '#' || record_number::VARCHAR AS input_id,
          CASE WHEN record_number % 19 = 0 THEN 'tX' ELSE tenant_id END AS tenant_id,
          CASE WHEN record_number % 7 = 0 THEN NULL ELSE source_id END AS source_id,
          CASE WHEN record_number % 11 = 0 THEN '' ELSE source_file_id END AS source_file_id,
          CASE WHEN record_number % 17 = 0 THEN 'missing-' || source_record_id ELSE source_record_id END AS source_record_id,
          run_id,
          CASE WHEN record_number % 13 = 0 THEN NULL ELSE 'ARTICLE' END AS entity_type
        FROM ids),
runs AS (SELECT DISTINCT run_id AS id, tenant_id FROM ids)
SELECT input_id,
  CASE WHEN source_id IS NULL OR source_id = '' THEN 'source_id required'
       WHEN source_file_id IS NULL OR source_file_id = '' THEN 'source_file_id required'
       WHEN source_record_id IS NULL OR source_record_id = '' THEN 'source_record_id required'
       WHEN run_id IS NULL OR run_id = '' THEN 'run_id required'
       WHEN entity_type IS NULL OR entity_type = '' THEN 'entity_type required'
       WHEN NOT EXISTS (SELECT 1 FROM ids r WHERE r.source_record_id = inp.source_record_id AND r.tenant_id = inp.tenant_id)
         OR NOT EXISTS (SELECT 1 FROM runs u WHERE u.id = inp.run_id AND u.tenant_id = inp.tenant_id)
         THEN 'Entity provenance context invalid' END AS reason
FROM inp"""))
def q_entity_create_checked(spark, sf):
    r = _enriched_records(spark, sf)
    n = F.col("record_number")
    inputs = r.select(
        F.concat(F.col("snapshot_id"), F.lit("#"), n.cast("string")).alias("input_id"),
        F.when(n % 19 == 0, F.lit("tX")).otherwise(F.col("tenant_id")).alias("tenant_id"),
        F.when(n % 7 == 0, F.lit(None)).otherwise(F.col("source_id")).alias("source_id"),
        F.when(n % 11 == 0, F.lit("")).otherwise(F.col("source_file_id")).alias("source_file_id"),
        F.when(n % 17 == 0, F.concat(F.lit("missing-"), F.col("source_record_id")))
         .otherwise(F.col("source_record_id")).alias("source_record_id"),
        "run_id", F.when(n % 13 == 0, F.lit(None)).otherwise(F.lit("ARTICLE")).alias("entity_type"))
    raw_records = r.select(F.col("source_record_id").alias("id"), "tenant_id")
    runs = r.select(F.col("run_id").alias("id"), "tenant_id").distinct()
    return entity.create_checked(inputs, raw_records, runs).select("input_id", "reason")


@query("entity_lineage", with_fx(["fx_records"], _ENT_SQL + """
SELECT tenant_id, source_id, count(*)::BIGINT AS entities, count(DISTINCT source_record_id)::BIGINT AS records,
  count(DISTINCT snapshot_id)::BIGINT AS snapshots, count(DISTINCT source_file_id)::BIGINT AS files
FROM ents GROUP BY ALL"""))
def q_entity_lineage(spark, sf):
    ents = _entities(spark, sf)
    r = _enriched_records(spark, sf)
    records = r.select(F.col("source_record_id").alias("id"), "tenant_id", "snapshot_id")
    snaps = r.select(F.col("snapshot_id").alias("id"), "tenant_id", "source_file_id").distinct()
    files = r.select(F.col("source_file_id").alias("id"), "tenant_id", "source_id").distinct()
    sources = r.select(F.col("source_id").alias("id"), "tenant_id").distinct()
    return entity.lineage(ents, records, snaps, files, sources)


@query("entity_pipeline", with_fx(["fx_records"], _ENT_SQL + f"""
SELECT run_id, tenant_id, source_file_id, snapshot_id, count(*)::BIGINT AS raw_records, count(*)::BIGINT AS entities,
  any_value(d.domain) AS profiling_domain, any_value(d.confidence) AS confidence,
  '{_CFG['configuration_version']}' AS configuration_version, '{_CFG['configuration_hash']}' AS configuration_hash,
  'COMPLETED' AS status, 100 AS progress, 'local' AS worker
FROM ents JOIN dec2 d USING (snapshot_id) GROUP BY run_id, tenant_id, source_file_id, snapshot_id"""))
def q_pipeline(spark, sf):
    return pl.run_pipeline(fx.records(spark, sf), PIPELINE_CONFIG)["runs"]


# ====================================================================== L, C
@query("run_create", with_fx(["fx_ledger"], """
WITH pj AS (SELECT tenant_id, idempotency_key, max(CASE WHEN seq % 2 = 1 THEN 'old-' || seq::VARCHAR END) AS p_run
       FROM fx_ledger WHERE seq % 97 = 0 GROUP BY ALL),
er AS (SELECT DISTINCT execution_id FROM fx_ledger WHERE seq % 89 = 0),
r AS (SELECT l.*, p_run, pj.tenant_id IS NOT NULL AS p_job,
        row_number() OVER (PARTITION BY l.tenant_id, l.idempotency_key ORDER BY seq) AS k
      FROM fx_ledger l LEFT JOIN pj USING (tenant_id, idempotency_key)),
o AS (SELECT * FROM r WHERE k = 1 AND NOT p_job),
e AS (SELECT execution_id, min(seq) AS first_seq FROM o GROUP BY ALL),
made AS (SELECT s.execution_id, s.seq, o.execution_id AS o_exec, o.seq AS o_seq
         FROM r s LEFT JOIN o USING (tenant_id, idempotency_key)
         WHERE (s.k = 2 AND NOT s.p_job) OR (s.k = 1 AND s.p_job AND s.p_run IS NULL)),
x AS (SELECT m.execution_id, m.o_exec, m.o_seq IS NULL OR m.o_seq > eo.first_seq AS sure
      FROM made m JOIN e ON e.execution_id = m.execution_id AND m.seq < e.first_seq LEFT JOIN e eo ON eo.execution_id = m.o_exec),
u AS (SELECT execution_id FROM er UNION SELECT execution_id FROM x WHERE sure
      UNION SELECT x.execution_id FROM x JOIN u ON x.o_exec = u.execution_id WHERE NOT x.sure),
w AS (SELECT o.tenant_id, o.idempotency_key, o.seq = e.first_seq AND u.execution_id IS NULL AS won
      FROM o JOIN e USING (execution_id) LEFT JOIN (SELECT DISTINCT execution_id FROM u) u USING (execution_id)),
f AS (SELECT r.*, CASE WHEN p_job OR won THEN 1 ELSE 2 END AS maker FROM r LEFT JOIN w USING (tenant_id, idempotency_key))
SELECT seq, tenant_id, idempotency_key, execution_id,
  CASE WHEN p_run IS NOT NULL THEN 'REPLAY' WHEN k = maker THEN 'CREATED' WHEN k = 1 THEN 'CONFLICT' ELSE 'REPLAY' END AS status,
  sha256('job|' || tenant_id || '|' || idempotency_key) AS job_id,
  coalesce(p_run, CASE WHEN k >= maker THEN sha256('run|' || tenant_id || '|' || idempotency_key) END) AS run_id
FROM f""").replace("WITH ", "WITH RECURSIVE ", 1))
def q_run_create(spark, sf):
    r = fx.ledger(spark, sf)
    old = F.max(F.when(F.col("seq") % 2 == 1, F.concat(F.lit("old-"), F.col("seq").cast("string")))).alias("run_id")
    jobs = r.where("seq % 97 = 0").groupBy("tenant_id", "idempotency_key").agg(old)
    return ledger.create_runs(r, jobs, r.where("seq % 89 = 0").select("execution_id").distinct())


def _steps(spark, sf):
    e = fx.table(spark, sf, "events")
    seqn = (F.col("event_id") % 7 + 1).cast("long")
    return e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"),
                    seqn.alias("sequence"), F.concat(F.lit("step-"), seqn.cast("string")).alias("idempotency_key"))


@query("step_create", """
SELECT user_id::VARCHAR AS run_id, event_id AS seq, (event_id % 7 + 1)::BIGINT AS sequence,
  CASE WHEN event_id = min(event_id) OVER w THEN 'CREATED' ELSE 'EXISTING' END AS status,
  min(event_id) OVER w AS step_seq
FROM events WINDOW w AS (PARTITION BY user_id, event_id % 7)""")
def q_step_create(spark, sf):
    return ledger.create_steps(_steps(spark, sf))


@query("step_conflicts", """
WITH RECURSIVE e AS (
  SELECT user_id::VARCHAR AS run_id, event_id AS seq, (event_id % 7 + 1)::BIGINT AS sequence, 'k' || (event_id % 5)::VARCHAR AS k,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w AS (
  SELECT run_id, n, seq, sequence, k, seq AS step_seq, [seq] AS made, [sequence] AS sequences, [k] AS ks FROM e WHERE n = 1
  UNION ALL
  SELECT e.run_id, e.n, e.seq, e.sequence, e.k,
    coalesce(list_min([made[i] FOR i IN range(1, len(made) + 1) IF sequences[i] = e.sequence OR ks[i] = e.k]), e.seq) AS step_seq,
    CASE WHEN list_contains(sequences, e.sequence) OR list_contains(ks, e.k) THEN made ELSE list_append(made, e.seq) END,
    CASE WHEN list_contains(sequences, e.sequence) OR list_contains(ks, e.k) THEN sequences ELSE list_append(sequences, e.sequence) END,
    CASE WHEN list_contains(sequences, e.sequence) OR list_contains(ks, e.k) THEN ks ELSE list_append(ks, e.k) END
  FROM w JOIN e ON e.run_id = w.run_id AND e.n = w.n + 1)
SELECT run_id, seq, sequence, CASE WHEN step_seq = seq THEN 'CREATED' ELSE 'EXISTING' END AS status, step_seq FROM w""")
def q_step_conflicts(spark, sf):
    """Requests that share a key with one step and a sequence with another."""
    key = F.concat(F.lit("k"), (F.col("seq") % 5).cast("string"))
    return ledger.create_steps(_steps(spark, sf).withColumn("idempotency_key", key))


@query("run_state", with_fx(["fx_transitions"], """
SELECT run_id, arg_max(status, seq) AS status,
  arg_max(ts, seq) FILTER (WHERE status = 'RUNNING') AS started_at,
  arg_max(ts, seq) FILTER (WHERE status = 'RUNNING') AS heartbeat_at,
  arg_max(ts, seq) FILTER (WHERE status IN ('COMPLETED', 'FAILED', 'CANCELLED')) AS finished_at,
  arg_max(progress, seq) FILTER (WHERE progress IS NOT NULL) AS progress,
  count(*)::BIGINT AS transitions
FROM fx_transitions WHERE status IN ('PENDING','RUNNING','COMPLETED','FAILED','CANCELLED') GROUP BY run_id"""))
def q_run_state(spark, sf):
    state, _ = ledger.run_state(fx.transitions(spark, sf))
    return state


def _step_transitions(spark, sf):
    e = fx.table(spark, sf, "events")
    st = (F.when(F.col("event_id") % 17 == 0, F.lit("BOGUS"))
           .when(F.col("event_type") == "signup", F.lit("SKIPPED"))
           .otherwise(F.create_map(*[x for kv in fx.EVENT_STATUS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])[F.col("event_type")]))
    tenant = F.concat(F.lit("t"), F.when(F.col("event_id") % 13 == 0, (F.col("user_id") + 1) % 7)
                      .otherwise(F.col("user_id") % 7).cast("string"))
    return e.select(F.concat(F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 3).cast("string")).alias("step_id"),
                    F.col("user_id").cast("string").alias("run_id"), tenant.alias("tenant_id"),
                    F.col("event_id").alias("seq"), st.alias("status"), "ts",
                    F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 100).cast("int")).alias("progress"))


@query("step_state", """
WITH t AS (SELECT user_id::VARCHAR || '-' || (event_id % 3)::VARCHAR AS step_id, event_id AS seq, ts,
  CASE WHEN event_id % 17 = 0 THEN 'BOGUS' WHEN event_type = 'signup' THEN 'SKIPPED'
       WHEN event_type = 'view' THEN 'RUNNING' WHEN event_type = 'click' THEN 'PENDING'
       WHEN event_type = 'purchase' THEN 'COMPLETED' WHEN event_type = 'error' THEN 'FAILED' END AS status,
  CASE WHEN event_id % 4 = 0 THEN (event_id % 100)::INT END AS progress
  FROM events WHERE event_id % 13 <> 0)
SELECT step_id, arg_max(status, seq) AS status,
  arg_max(ts, seq) FILTER (WHERE status = 'RUNNING') AS started_at,
  arg_max(ts, seq) FILTER (WHERE status = 'RUNNING') AS heartbeat_at,
  arg_max(ts, seq) FILTER (WHERE status IN ('COMPLETED', 'FAILED', 'CANCELLED')) AS finished_at,
  arg_max(progress, seq) FILTER (WHERE progress IS NOT NULL) AS progress,
  count(*)::BIGINT AS transitions
FROM t WHERE status IN ('PENDING','RUNNING','COMPLETED','FAILED','SKIPPED','CANCELLED') GROUP BY step_id""")
def q_step_state(spark, sf):
    t = _step_transitions(spark, sf)
    runs = (fx.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("run_id"),
                                                  F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")).alias("tenant_id"))
            .distinct())
    state, _ = ledger.step_state(t, runs)
    return state


@query("config_version", with_fx(["fx_config"], """
SELECT profile_id, version, 'cfg-' || substr(sha256(configuration), 1, 16) AS configuration_version,
  sha256('{"profile_version_id":' || coalesce(to_json(profile_version_id)::VARCHAR, 'null')
         || ',"rule_version_id":' || coalesce(to_json(rule_version_id)::VARCHAR, 'null')
         || ',"configuration":' || configuration || '}') AS configuration_hash
FROM fx_config"""))
def q_config_version(spark, sf):
    return ledger.config_versions(fx.configs(spark, sf)).select(
        "profile_id", "version", "configuration_version", "configuration_hash")


@query("profiles_list", with_fx(["fx_config"], """
SELECT profile_id, max(version) AS latest_version, count(*)::BIGINT AS versions FROM fx_config GROUP BY ALL"""))
def q_profiles_list(spark, sf):
    return ledger.profiles_list(fx.configs(spark, sf))


@query("profiles_get", with_fx(["fx_config"], """
SELECT profile_id, version, configuration FROM fx_config WHERE profile_id = 'prof-7'"""))
def q_profiles_get(spark, sf):
    return ledger.profile_get(fx.configs(spark, sf), "prof-7").select("profile_id", "version", "configuration")


# ====================================================================== T


@query("memberships", with_fx(["fx_memberships"], """
SELECT id, tenant_id, user_id, role_id, status FROM fx_memberships WHERE user_id = 'u-7'"""))
def q_memberships(spark, sf):
    return tenancy.memberships_of_user(fx.memberships(spark, sf), "u-7")


@query("membership_context", with_fx(["fx_memberships", "fx_tenants", "fx_roles"], """
SELECT m.user_id, m.tenant_id, t.name AS tenant_name, t.slug AS tenant_slug, t.status AS tenant_status,
  m.role_id, r.code AS role_code, r.name AS role_name, m.status
FROM fx_memberships m LEFT JOIN fx_tenants t ON t.id = m.tenant_id LEFT JOIN fx_roles r ON r.id = m.role_id"""))
def q_membership_context(spark, sf):
    return tenancy.membership_context(fx.memberships(spark, sf), fx.tenants(spark, sf), fx.roles(spark))


def _requests(spark, sf):
    o = fx.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("request_id"),
                    F.concat(F.lit("u-"), (F.col("o_custkey") % 200).cast("string")).alias("user_id"),
                    F.concat(F.lit("n-"), (F.col("o_orderkey") % 25).cast("string")).alias("tenant_id"))


@query("active_gate", with_fx(["fx_memberships"], """
SELECT o_orderkey AS request_id, 'u-' || (o_custkey % 200)::VARCHAR AS user_id, 'n-' || (o_orderkey % 25)::VARCHAR AS tenant_id,
  EXISTS (SELECT 1 FROM fx_memberships m WHERE m.user_id = 'u-' || (o_custkey % 200)::VARCHAR
          AND m.tenant_id = 'n-' || (o_orderkey % 25)::VARCHAR AND m.status = 'ACTIVE') AS allowed
FROM orders"""))
def q_active_gate(spark, sf):
    return tenancy.gated(_requests(spark, sf), fx.memberships(spark, sf))


@query("org_lists", with_fx(["fx_memberships", "fx_bases", "fx_companies", "fx_groups"], """
WITH a AS (SELECT DISTINCT tenant_id FROM fx_memberships WHERE user_id = 'u-8' AND status = 'ACTIVE')
SELECT 'base' AS kind, id, tenant_id, name, status FROM fx_bases WHERE tenant_id IN (SELECT tenant_id FROM a)
UNION ALL SELECT 'company', id, tenant_id, name, status FROM fx_companies WHERE tenant_id IN (SELECT tenant_id FROM a)
UNION ALL SELECT 'group', id, tenant_id, name, status FROM fx_groups WHERE tenant_id IN (SELECT tenant_id FROM a)"""))
def q_org_lists(spark, sf):
    return tenancy.org_lists("u-8", fx.memberships(spark, sf), fx.bases(spark, sf),
                             fx.companies(spark, sf), fx.groups(spark, sf))


@query("scoped_reads", with_fx(["fx_snap"], """
SELECT source_file_id, seq FROM fx_snap WHERE tenant_id = '3'
UNION ALL SELECT source_file_id, seq FROM fx_snap WHERE tenant_id = '4' AND source_file_id = '13'"""))
def q_scoped_reads(spark, sf):
    s = fx.snapshots(spark, sf)
    own = tenancy.scoped_list(s, "3").select("source_file_id", "seq")
    other = tenancy.scoped_get(s, "4", "source_file_id", "13").select("source_file_id", "seq")  # file 13 is tenant 3
    return own.unionByName(other)


# ====================================================================== G, Q5
def _customers(spark, sf):
    c = fx.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), "c_name", "c_acctbal", "c_mktsegment",
                    F.lit(0).cast("long").alias("write_seq"))


@query("upsert", """
SELECT id, c_name, c_acctbal, c_mktsegment, write_seq FROM (
  SELECT c_custkey AS id, c_name, c_acctbal, c_mktsegment, 0::BIGINT AS write_seq FROM customer
  UNION ALL SELECT c_custkey, c_name, c_acctbal + 1, c_mktsegment, 1::BIGINT FROM customer WHERE c_custkey % 7 = 0)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY write_seq DESC) = 1""")
def q_upsert(spark, sf):
    base = _customers(spark, sf)
    new = base.filter(F.col("id") % 7 == 0).withColumn("c_acctbal", F.col("c_acctbal") + 1).withColumn(
        "write_seq", F.lit(1).cast("long"))
    return tables.upsert(base, new)


@query("find", "SELECT c_custkey AS id, c_name, c_acctbal, c_mktsegment, 0::BIGINT AS write_seq FROM customer WHERE c_custkey = 42")
def q_find(spark, sf):
    return tables.find(_customers(spark, sf), "id", 42)


@query("filter_rows", """
SELECT c_custkey AS id, c_name, c_acctbal, c_mktsegment, 0::BIGINT AS write_seq FROM customer
WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0""")
def q_filter_rows(spark, sf):
    return tables.filter_rows(_customers(spark, sf), "c_mktsegment = 'BUILDING' AND c_acctbal > 0")


@query("patch", """
SELECT c_custkey AS id, c_name,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment,
  0::BIGINT AS write_seq, c_custkey % 5 = 0 AS patched, NULL::VARCHAR AS error FROM customer
UNION ALL SELECT c_custkey + 1000000, NULL, NULL, NULL, NULL, NULL, 'Not found' FROM customer WHERE c_custkey % 50 = 0""")
def q_patch(spark, sf):
    base = _customers(spark, sf)
    k = F.col("id")
    p1 = base.filter(k % 5 == 0).select("id", F.lit(1).alias("seq"),
                                        F.concat(F.lit('{"c_mktsegment":"'), F.lower("c_mktsegment"), F.lit('"}')).alias("patch"))
    p2 = base.filter(k % 10 == 0).select("id", F.lit(2).alias("seq"), F.lit('{"c_acctbal":null}').alias("patch"))
    p3 = base.filter(k % 50 == 0).select((k + 1000000).alias("id"), F.lit(1).alias("seq"), F.lit('{"c_name":"x"}').alias("patch"))
    patched, errors = tables.patch(base, p1.unionByName(p2).unionByName(p3), "id",
                                   ["c_name", "c_acctbal", "c_mktsegment"])
    err = errors.select("id", F.lit(None).cast("string").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"),
                        F.lit(None).cast("string").alias("c_mktsegment"), F.lit(None).cast("long").alias("write_seq"),
                        F.lit(None).cast("boolean").alias("patched"), "error")
    return patched.withColumn("error", F.lit(None).cast("string")).unionByName(err)


@query("insert_ignore", """
SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'NEW ' || c_name FROM customer WHERE c_custkey % 2 <> 0""")
def q_insert_ignore(spark, sf):
    # existing rows: even keys; incoming: every customer twice (a first and a
    # later copy), so the conflict rule, the in-batch dedup and the append all run
    c = fx.table(spark, sf, "customer")
    existing = c.filter(F.col("c_custkey") % 2 == 0).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    inc = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("NEW "), F.col("c_name")).alias("name"))
    incoming = inc.withColumn("seq", F.lit(1)).unionByName(
        inc.withColumn("name", F.concat(F.lit("LATE "), F.col("name"))).withColumn("seq", F.lit(2)))
    return tables.insert_ignore(existing, incoming, ["id"])


# ====================================================================== Q
def _company_rows(spark, sf):
    c = fx.table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("id"),
                    F.when(k % 13 == 0, F.lit("BOGUS")).otherwise(F.lit("ACTIVE")).alias("status"),
                    F.when(k % 17 == 0, F.lit("  ")).otherwise(F.col("c_name")).alias("name"),
                    F.when(k % 19 == 0, F.upper(F.col("c_mktsegment"))).otherwise(
                        F.concat(F.lower(F.col("c_mktsegment")), F.lit("-"), k.cast("string"))).alias("slug"),
                    F.col("c_acctbal").alias("size_bytes"))


@query("check_rules", """
WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN 'BOGUS' ELSE 'ACTIVE' END AS status,
  CASE WHEN c_custkey % 17 = 0 THEN '  ' ELSE c_name END AS name,
  CASE WHEN c_custkey % 19 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) || '-' || c_custkey::VARCHAR END AS slug,
  c_acctbal AS size_bytes FROM customer)
SELECT 'companies' AS "table", 'status_enum' AS rule, id::VARCHAR AS key FROM c WHERE status NOT IN ('ACTIVE','INACTIVE','ARCHIVED')
UNION ALL SELECT 'companies', 'name_not_blank', id::VARCHAR FROM c WHERE length(trim(name)) = 0
UNION ALL SELECT 'companies', 'slug_shape', id::VARCHAR FROM c WHERE NOT regexp_full_match(slug, '[a-z0-9][a-z0-9-]{1,62}')
UNION ALL SELECT 'companies', 'size_non_negative', id::VARCHAR FROM c WHERE size_bytes < 0""")
def q_check_rules(spark, sf):
    df = _company_rows(spark, sf)
    rules = {"status_enum": F.col("status").isin(*checks.SOURCE_STATUS),
             "name_not_blank": checks.non_blank(F.col("name")),
             "slug_shape": F.col("slug").rlike(checks.SLUG_SHAPE),
             "size_non_negative": F.col("size_bytes") >= 0}
    return checks.check_rules(df, "companies", "id", rules)


@query("unique_violations", with_fx(["fx_memberships"], """
SELECT tenant_id, user_id, count(*)::BIGINT AS n FROM fx_memberships GROUP BY ALL HAVING count(*) > 1"""))
def q_unique_violations(spark, sf):
    return checks.unique_violations(fx.memberships(spark, sf), ["tenant_id", "user_id"])


@query("partial_unique", with_fx(["fx_companies"], """
SELECT tenant_id, external_reference, count(*)::BIGINT AS n FROM fx_companies
WHERE external_reference IS NOT NULL GROUP BY ALL HAVING count(*) > 1"""))
def q_partial_unique(spark, sf):
    return checks.partial_unique(fx.companies(spark, sf), ["tenant_id", "external_reference"],
                                 F.col("external_reference").isNotNull())


@query("tenant_fk", """
SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
  'n-' || (o_custkey % 25)::VARCHAR AS tenant_id
FROM orders o WHERE o_orderkey % 97 <> 0 AND NOT EXISTS (
  SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND 'n-' || c.c_nationkey::VARCHAR = 'n-' || (o.o_custkey % 25)::VARCHAR)""")
def q_tenant_fk(spark, sf):
    o = fx.table(spark, sf, "orders")
    child = o.select("o_orderkey", F.when(F.col("o_orderkey") % 97 == 0, F.lit(None)).otherwise(F.col("o_custkey")).alias("o_custkey"),
                     F.concat(F.lit("n-"), (F.col("o_custkey") % 25).cast("string")).alias("tenant_id"))
    parent = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"),
                                                    F.concat(F.lit("n-"), F.col("c_nationkey").cast("string")).alias("tenant_id"))
    return checks.tenant_fk(child, parent, "o_custkey")


@query("uuid_shape", """
SELECT c_custkey, v AS value, regexp_full_match(v, '(?i)[0-9a-f-]{36}') AS valid FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN replace(u, 'a', 'g') WHEN c_custkey % 11 = 0 THEN substr(u, 1, 35)
                         WHEN c_custkey % 5 = 0 THEN upper(u) ELSE u END AS v
  FROM (SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4)
          || '-' || substr(h, 21, 12) AS u FROM (SELECT c_custkey, sha256(c_name) AS h FROM customer)))""")
def q_uuid_shape(spark, sf):
    c = fx.table(spark, sf, "customer")
    h = F.sha2(F.col("c_name"), 256)
    u = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                    F.substring(h, 17, 4), F.substring(h, 21, 12))
    k = F.col("c_custkey")
    v = (F.when(k % 7 == 0, F.replace(u, F.lit("a"), F.lit("g"))).when(k % 11 == 0, F.substring(u, 1, 35))
          .when(k % 5 == 0, F.upper(u)).otherwise(u))
    return c.select("c_custkey", v.alias("value")).withColumn("valid", checks.uuid_shape(F.col("value")))


# ====================================================================== S
def _log_fields(e):
    return F.concat(
        F.lit('{"token":"t'), F.col("event_id").cast("string"), F.lit('","user":{"Password":"p'),
        F.col("user_id").cast("string"), F.lit('","name":"u'), F.col("user_id").cast("string"),
        F.lit('"},"props":'), F.col("props"), F.lit(',"items":[{"secret":'), F.col("event_id").cast("string"),
        F.lit('},{"x":2}],"Cookie":"c","event":"'), F.col("event_type"), F.lit('"}'))


@query("redact_keys", """
SELECT event_id, '{"token":"[REDACTED]","user":{"Password":"[REDACTED]","name":"u' || user_id::VARCHAR
  || '"},"props":' || json(props)::VARCHAR || ',"items":[{"secret":"[REDACTED]"},{"x":2}],"Cookie":"[REDACTED]","event":"'
  || event_type || '"}' AS redacted FROM events""")
def q_redact_keys(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select("event_id", redact_json(_log_fields(e)).alias("redacted"))


# ====================================================================== extra coverage
@query("source_create", """
SELECT sha256('source|' || lang || '|' || doc_id::VARCHAR) AS id, lang AS tenant_id, source AS name,
  'FILE' AS source_type, 'ACTIVE' AS status, '{}' AS metadata, NULL::VARCHAR AS reason FROM documents WHERE doc_id % 9 <> 0
UNION ALL SELECT NULL, lang, NULL, NULL, NULL, NULL, 'Source name required' FROM documents WHERE doc_id % 9 = 0""")
def q_source_create(spark, sf):
    d = fx.table(spark, sf, "documents")
    req = d.select(F.col("doc_id").alias("request_id"), F.col("lang").alias("tenant_id"),
                   F.when(F.col("doc_id") % 9 == 0, F.lit("")).otherwise(F.col("source")).alias("name"))
    ok, bad = intake.create_sources(req)
    null = F.lit(None).cast("string")
    return ok.withColumn("reason", null).unionByName(
        bad.select(null.alias("id"), "tenant_id", null.alias("name"), null.alias("source_type"),
                   null.alias("status"), null.alias("metadata"), "reason"))


@query("run_steps", """
WITH s AS (SELECT user_id::VARCHAR AS run_id, event_id AS seq, (event_id % 7 + 1)::BIGINT AS sequence,
             CASE WHEN event_id = min(event_id) OVER w THEN 'CREATED' ELSE 'EXISTING' END AS status,
             min(event_id) OVER w AS step_seq
           FROM events WINDOW w AS (PARTITION BY user_id, event_id % 7))
SELECT run_id, seq, sequence, status, step_seq FROM s
WHERE status = 'CREATED' AND run_id IN (SELECT user_id::VARCHAR FROM events WHERE user_id % 7 = 3)""")
def q_run_steps(spark, sf):
    steps = ledger.create_steps(_steps(spark, sf)).filter(F.col("status") == "CREATED")
    runs = (fx.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("run_id"),
                                                  F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")).alias("tenant_id"))
            .distinct())
    return tenancy.tenant_steps(runs, steps, "t3")


@query("pipeline_steps", with_fx(["fx_records"], _ENT_SQL + """,
runs AS (SELECT run_id, snapshot_id, count(*) AS n FROM ents GROUP BY ALL)
SELECT r.run_id, 'RAW' AS step_type, 1::BIGINT AS sequence, 'COMPLETED' AS status, 100 AS progress,
  '{"snapshot_id":' || to_json(r.snapshot_id)::VARCHAR || ',"record_count":' || r.n::VARCHAR || '}' AS output FROM runs r
UNION ALL SELECT r.run_id, 'PROFILING', 2, 'COMPLETED', 100,
  '{"profiling_result_id":"' || sha256('profile|' || r.run_id) || '","domain":"' || d.domain || '","confidence":"' || d.confidence || '"}'
FROM runs r JOIN dec2 d USING (snapshot_id)
UNION ALL SELECT r.run_id, 'NORMALIZATION', 3, 'COMPLETED', 100, '{"entity_count":' || r.n::VARCHAR || '}' FROM runs r"""))
def q_pipeline_steps(spark, sf):
    return pl.pipeline_steps(pl.run_pipeline(fx.records(spark, sf), PIPELINE_CONFIG)["runs"])


FILE_CONFIG = {"field_rules": {"o_orderpriority": ["collapse_whitespace", "uppercase"]},
               "identity_fields": ["o_orderkey"]}
_FCFG = ledger.config_snapshot(FILE_CONFIG)


def _csv_uploads(spark, sf):
    f = fx.csv_files(spark, sf)
    return f.select(F.col("file_id").alias("seq"), F.concat(F.lit("t"), (F.col("file_id") % 4).cast("string")).alias("tenant_id"),
                    F.lit("orders").alias("source_id"), "filename",
                    F.when(F.col("filename").endswith(".tsv"), F.lit("text/tab-separated-values"))
                     .otherwise(F.lit("text/csv")).alias("mime_type"),
                    "content", F.lit(None).cast("string").alias("idempotency_key"))


@query("file_pipeline", with_fx(["fx_csv"], f"""
WITH f AS (SELECT file_id, 't' || (file_id % 4)::VARCHAR AS tenant_id,
             sha256('file|' || 't' || (file_id % 4)::VARCHAR || '|' || sha256(content)) AS source_file_id FROM fx_csv),
s AS (SELECT *, sha256('snapshot|' || source_file_id || '|1') AS snapshot_id FROM f),
n AS (SELECT o_orderkey // 100 AS file_id, count(*)::BIGINT AS n FROM orders GROUP BY ALL)
SELECT sha256('run|' || tenant_id || '|' || source_file_id || '|' || snapshot_id || '|{_FCFG['configuration_hash']}') AS run_id,
  tenant_id, source_file_id, snapshot_id, n AS raw_records, n AS entities, 'UNKNOWN' AS profiling_domain, 'LOW' AS confidence,
  '{_FCFG['configuration_version']}' AS configuration_version, '{_FCFG['configuration_hash']}' AS configuration_hash,
  'COMPLETED' AS status, 100 AS progress, 'local' AS worker
FROM s JOIN n USING (file_id)"""))
def q_file_pipeline(spark, sf):
    src = spark.createDataFrame([(f"t{i}", "orders") for i in range(4)], "tenant_id string, id string")
    return pl.ingest_and_process(_csv_uploads(spark, sf), src, FILE_CONFIG)["runs"]


_RATE_SQL = "CASE WHEN r = 0 THEN '0' ELSE regexp_replace(r::VARCHAR, '\\.0$', '') END"


@query("profile_result", with_fx(["fx_records"], "WITH " + _CELLS_SQL + ",\n" + _SCORES_SQL.format(src="ord") + f""",
st AS (SELECT snapshot_id, column_name, count(*) FILTER (WHERE inc) AS nn, count(*) AS rc,
         count(DISTINCT CASE WHEN inc THEN CASE WHEN NOT present THEN 'undefined' WHEN t = 'VARCHAR' THEN json_extract_string(v, '$')
                                                WHEN t = 'OBJECT' THEN '[object Object]' ELSE v::VARCHAR END END) AS d
       FROM cells2 GROUP BY ALL),
ex AS (SELECT snapshot_id, column_name, string_agg(ej, ',' ORDER BY rk) AS exs FROM (
         SELECT snapshot_id, column_name, row_number() OVER (PARTITION BY snapshot_id, column_name ORDER BY record_number) AS rk,
                CASE WHEN present THEN v::VARCHAR ELSE 'null' END AS ej
         FROM cells2 WHERE inc) WHERE rk <= 3 GROUP BY ALL),
per_col AS (SELECT st.snapshot_id, o.position, to_json(st.column_name)::VARCHAR || ':' || '{{"non_null":' || st.nn::VARCHAR
              || ',"null_rate":' || (SELECT {_RATE_SQL} FROM (SELECT 1 - st.nn / st.rc AS r)) || ',"distinct":' || st.d::VARCHAR
              || ',"examples":[' || coalesce(ex.exs, '') || ']}}' AS stat
            FROM st JOIN ord o USING (snapshot_id, column_name) LEFT JOIN ex USING (snapshot_id, column_name)),
rc AS (SELECT snapshot_id, count(*) AS n FROM fx_records GROUP BY ALL)
SELECT p.snapshot_id, '{{"domain":"' || d.domain || '","confidence":"' || d.confidence || '","row_count":' || rc.n::VARCHAR
  || ',"column_count":' || count(*)::VARCHAR
  || ',"columns":' || to_json(list(c.column_name ORDER BY c.position))::VARCHAR
  || ',"statistics":{{' || string_agg(p.stat, ',' ORDER BY p.position) || '}}'
  || ',"candidates":{{"ARTICLE":' || d.article::VARCHAR || ',"CUSTOMER":' || d.customer::VARCHAR
  || ',"SUPPLIER":' || d.supplier::VARCHAR || '}}}}' AS result
FROM per_col p JOIN ord c ON c.snapshot_id = p.snapshot_id AND c.position = p.position
JOIN dec2 d ON d.snapshot_id = p.snapshot_id JOIN rc ON rc.snapshot_id = p.snapshot_id
GROUP BY p.snapshot_id, d.domain, d.confidence, rc.n, d.article, d.customer, d.supplier"""))
def q_profile_result(spark, sf):
    return prof.profile_report(fx.records(spark, sf), with_result=True).select("snapshot_id", "result")


@query("schema_checks", with_fx(["fx_tenants", "fx_memberships", "fx_bases", "fx_companies", "fx_groups"], """
SELECT 'tenants' AS "table", 'status' AS rule, count(*) FILTER (WHERE status NOT IN ('ACTIVE','SUSPENDED','ARCHIVED'))::BIGINT AS violations FROM fx_tenants
UNION ALL SELECT 'tenants', 'name_nonempty', count(*) FILTER (WHERE length(trim(name)) = 0) FROM fx_tenants
UNION ALL SELECT 'tenants', 'slug_format', count(*) FILTER (WHERE NOT regexp_full_match(slug, '[a-z0-9][a-z0-9-]{1,62}')) FROM fx_tenants
UNION ALL SELECT 'memberships', 'status', count(*) FILTER (WHERE status NOT IN ('ACTIVE','SUSPENDED','INVITED','REMOVED')) FROM fx_memberships
UNION ALL SELECT 'bases', 'status', count(*) FILTER (WHERE status NOT IN ('ACTIVE','ARCHIVED')) FROM fx_bases
UNION ALL SELECT 'bases', 'name_nonempty', count(*) FILTER (WHERE length(trim(name)) = 0) FROM fx_bases
UNION ALL SELECT 'bases', 'slug_format', count(*) FILTER (WHERE NOT regexp_full_match(slug, '[a-z0-9][a-z0-9-]{1,62}')) FROM fx_bases
UNION ALL SELECT 'companies', 'status', count(*) FILTER (WHERE status NOT IN ('ACTIVE','ARCHIVED')) FROM fx_companies
UNION ALL SELECT 'companies', 'name_nonempty', count(*) FILTER (WHERE length(trim(name)) = 0) FROM fx_companies
UNION ALL SELECT 'groups', 'status', count(*) FILTER (WHERE status NOT IN ('ACTIVE','ARCHIVED')) FROM fx_groups
UNION ALL SELECT 'groups', 'name_nonempty', count(*) FILTER (WHERE length(trim(name)) = 0) FROM fx_groups"""))
def q_schema_checks(spark, sf):
    tables_ = {"tenants": fx.tenants(spark, sf), "memberships": fx.memberships(spark, sf),
               "bases": fx.bases(spark, sf), "companies": fx.companies(spark, sf), "groups": fx.groups(spark, sf)}
    out = None
    for name, df in tables_.items():
        part = schema_rules.rule_counts(df, name, skip_missing=True)
        out = part if out is None else out.unionByName(part)
    return out


# ====================================================================== gates, many users, ids
_GATE_SQL = """
WITH runs AS (SELECT DISTINCT user_id::VARCHAR AS run_id, 't' || (user_id % 7)::VARCHAR AS tenant_id FROM events WHERE user_id % 11 <> 3),
t AS (SELECT user_id::VARCHAR AS run_id, event_id AS seq, ts,
  't' || (CASE WHEN event_id % 13 = 0 THEN (user_id + 1) % 7 ELSE user_id % 7 END)::VARCHAR AS tenant_id,
  CASE WHEN event_id % 17 = 0 THEN 'BOGUS' WHEN event_type = 'view' THEN 'RUNNING' WHEN event_type = 'click' THEN 'PENDING'
       WHEN event_type = 'purchase' THEN 'COMPLETED' WHEN event_type = 'error' THEN 'FAILED' ELSE 'CANCELLED' END AS status,
  CASE WHEN event_id % 4 = 0 THEN (event_id % 100)::INT END AS progress,
  CASE WHEN event_id % 5 = 0 THEN 'w' || (event_id % 9)::VARCHAR END AS worker,
  CASE WHEN event_id % 6 = 0 THEN '{"n":' || event_id::VARCHAR || '}' END AS statistics FROM events)
"""


def _gate_runs(spark, sf):
    e = fx.table(spark, sf, "events").where("user_id % 11 <> 3")
    return e.select(F.col("user_id").cast("string").alias("run_id"),
                    F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")).alias("tenant_id")).distinct()


def _gate_transitions(spark, sf):
    return fx.table(spark, sf, "events").selectExpr(
        "cast(user_id AS string) AS run_id", "event_id AS seq", "ts",
        "concat('t', cast(CASE WHEN event_id % 13 = 0 THEN (user_id + 1) % 7 ELSE user_id % 7 END AS string)) AS tenant_id",
        "CASE WHEN event_id % 17 = 0 THEN 'BOGUS' WHEN event_type = 'view' THEN 'RUNNING' WHEN event_type = 'click' THEN 'PENDING' "
        "WHEN event_type = 'purchase' THEN 'COMPLETED' WHEN event_type = 'error' THEN 'FAILED' ELSE 'CANCELLED' END AS status",
        "CASE WHEN event_id % 4 = 0 THEN cast(event_id % 100 AS int) END AS progress",
        "CASE WHEN event_id % 5 = 0 THEN concat('w', cast(event_id % 9 AS string)) END AS worker",
        "CASE WHEN event_id % 6 = 0 THEN concat('{\"n\":', cast(event_id AS string), '}') END AS statistics")


@query("step_gate", _GATE_SQL + """
SELECT t.run_id, seq, t.tenant_id, CASE WHEN runs.run_id IS NULL THEN 'Run not found' END AS reason
FROM t LEFT JOIN runs ON runs.run_id = t.run_id AND runs.tenant_id = t.tenant_id""")
def q_step_gate(spark, sf):
    steps = _gate_transitions(spark, sf).select("run_id", "seq", "tenant_id")
    ok, bad = ledger.steps_of_tenant(steps, _gate_runs(spark, sf))
    return (ok.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)
            .select("run_id", "seq", "tenant_id", "reason"))


@query("run_state_gated", _GATE_SQL + """
SELECT t.run_id, arg_max(status, seq) AS status, arg_max(progress, seq) FILTER (WHERE progress IS NOT NULL) AS progress,
  arg_max(worker, seq) FILTER (WHERE worker IS NOT NULL) AS worker,
  arg_max(statistics, seq) FILTER (WHERE statistics IS NOT NULL) AS statistics, count(*)::BIGINT AS transitions
FROM t JOIN runs ON runs.run_id = t.run_id AND runs.tenant_id = t.tenant_id WHERE status <> 'BOGUS' GROUP BY t.run_id""")
def q_run_state_gated(spark, sf):
    state, _ = ledger.run_state(_gate_transitions(spark, sf), _gate_runs(spark, sf))
    return state.select("run_id", "status", "progress", "worker", "statistics", "transitions")


@query("run_state_refused", _GATE_SQL + """
SELECT t.run_id, seq, CASE WHEN status = 'BOGUS' THEN 'Invalid RUN state' ELSE 'Run not found' END AS reason
FROM t LEFT JOIN runs ON runs.run_id = t.run_id AND runs.tenant_id = t.tenant_id WHERE status = 'BOGUS' OR runs.run_id IS NULL""")
def q_run_state_refused(spark, sf):
    _, refused = ledger.run_state(_gate_transitions(spark, sf), _gate_runs(spark, sf))
    return refused.select("run_id", "seq", "reason")


@query("org_lists_of_users", with_fx(["fx_memberships", "fx_bases", "fx_companies", "fx_groups"], """
WITH a AS (SELECT DISTINCT user_id, tenant_id FROM fx_memberships WHERE status = 'ACTIVE')
SELECT user_id, 'base' AS kind, id, tenant_id, name, status FROM fx_bases JOIN a USING (tenant_id)
UNION ALL SELECT user_id, 'company', id, tenant_id, name, status FROM fx_companies JOIN a USING (tenant_id)
UNION ALL SELECT user_id, 'group', id, tenant_id, name, status FROM fx_groups JOIN a USING (tenant_id)"""))
def q_org_lists_of_users(spark, sf):
    return tenancy.org_lists_of_users(fx.memberships(spark, sf), fx.bases(spark, sf), fx.companies(spark, sf), fx.groups(spark, sf))


@query("with_ids", """
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'given-' || o_orderkey::VARCHAR
            ELSE sha256('{"o_orderkey":' || o_orderkey::VARCHAR || ',"o_custkey":' || o_custkey::VARCHAR || '}') END AS id,
  o_orderkey, o_custkey FROM orders""")
def q_with_ids(spark, sf):
    o = fx.table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("given-"), F.col("o_orderkey").cast("string"))).alias("id"),
        "o_orderkey", "o_custkey")
    return tables.with_ids(o)


# ====================================================================== reads of every table, keys of every table
_ITEMS_SQL = """
items AS (
  SELECT 'sources' AS kind, 'n-' || s_nationkey::VARCHAR AS tenant_id, 's-' || s_suppkey::VARCHAR AS id,
    '{"name":' || to_json(s_name)::VARCHAR || '}' AS body FROM supplier
  UNION ALL SELECT 'source-files', 'n-' || c_nationkey::VARCHAR, 'f-' || c_custkey::VARCHAR, '{"name":' || to_json(c_name)::VARCHAR || '}' FROM customer
  UNION ALL SELECT 'raw', 'n-' || (o_custkey % 25)::VARCHAR, o_orderkey::VARCHAR, '{"state":' || to_json(o_orderstatus)::VARCHAR || '}' FROM orders
  UNION ALL SELECT 'runs', 'n-' || (user_id % 25)::VARCHAR, user_id::VARCHAR, '{"events":' || count(*)::VARCHAR || '}' FROM events GROUP BY user_id
  UNION ALL SELECT 'profiling', 'n-' || (user_id % 25)::VARCHAR, user_id::VARCHAR, '{"first":' || min(event_id)::VARCHAR || '}' FROM events WHERE user_id % 3 > 0 GROUP BY user_id
  UNION ALL SELECT 'entities', 'n-' || (p_partkey % 25)::VARCHAR, p_partkey::VARCHAR, '{"name":' || to_json(p_name)::VARCHAR || '}' FROM part),
requests AS (
  SELECT event_id AS request_id, 'u-' || (user_id % 200)::VARCHAR AS user_id,
    CASE WHEN event_id % 31 <> 0 THEN 'n-' || ((user_id + event_id % 2) % 25)::VARCHAR END AS tenant_id,
    ['sources','source-files','raw','profiling','runs','entities','unknown'][(event_id % 7 + 1)::INT] AS kind, user_id::VARCHAR AS id
  FROM events)
"""


def _items(spark, sf):
    t = lambda n: fx.table(spark, sf, n)
    tenant = lambda c: F.concat(F.lit("n-"), c.cast("string"))

    def rows(df, kind, owner, id_, field, value):
        body = F.concat(F.lit(f'{{"{field}":'), value, F.lit("}"))
        return df.select(F.lit(kind).alias("kind"), tenant(owner).alias("tenant_id"), id_.cast("string").alias("id"), body.alias("body"))
    e = t("events").groupBy("user_id").agg(F.count(F.lit(1)).cast("string").alias("n"), F.min("event_id").cast("string").alias("first"))
    c = F.col
    parts = [rows(t("supplier"), "sources", c("s_nationkey"), F.concat(F.lit("s-"), c("s_suppkey").cast("string")), "name", fx.json_string(c("s_name"))),
             rows(t("customer"), "source-files", c("c_nationkey"), F.concat(F.lit("f-"), c("c_custkey").cast("string")), "name", fx.json_string(c("c_name"))),
             rows(t("orders"), "raw", c("o_custkey") % 25, c("o_orderkey"), "state", fx.json_string(c("o_orderstatus"))),
             rows(e, "runs", c("user_id") % 25, c("user_id"), "events", c("n")),
             rows(e.where("user_id % 3 > 0"), "profiling", c("user_id") % 25, c("user_id"), "first", c("first")),
             rows(t("part"), "entities", c("p_partkey") % 25, c("p_partkey"), "name", fx.json_string(c("p_name")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("read_requests", with_fx(["fx_memberships"], "WITH " + _ITEMS_SQL + """,
live AS (SELECT DISTINCT user_id, tenant_id FROM fx_memberships WHERE status = 'ACTIVE'),
counts AS (SELECT kind, tenant_id, count(*) AS n FROM items GROUP BY ALL),
r AS (SELECT q.*, l.user_id IS NOT NULL AS allowed, q.kind IN ('sources','source-files') AS is_list
      FROM requests q LEFT JOIN live l ON q.user_id = l.user_id AND q.tenant_id = l.tenant_id)
SELECT request_id,
  CASE WHEN is_list AND r.tenant_id IS NULL THEN 'VALIDATION_ERROR' WHEN NOT allowed THEN 'TENANT_ACCESS_ERROR'
       WHEN is_list OR i.id IS NOT NULL THEN 'OK' ELSE 'NOT_FOUND' END AS status,
  CASE WHEN NOT allowed THEN 0 WHEN is_list THEN coalesce(k.n, 0) WHEN i.id IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS n_items,
  CASE WHEN allowed THEN i.body END AS body
FROM r LEFT JOIN counts k ON is_list AND r.kind = k.kind AND r.tenant_id = k.tenant_id
  LEFT JOIN items i ON NOT is_list AND r.kind = i.kind AND r.tenant_id = i.tenant_id AND r.id = i.id"""))
def q_read_requests(spark, sf):
    e = fx.table(spark, sf, "events")
    i, u = F.col("event_id"), F.col("user_id")
    kinds = F.array(*[F.lit(k) for k in (*tenancy.LIST_KINDS, *tenancy.GET_KINDS, "unknown")])
    requests = e.select(
        i.alias("request_id"), F.concat(F.lit("u-"), (u % 200).cast("string")).alias("user_id"),
        F.when(i % 31 != 0, F.concat(F.lit("n-"), ((u + i % 2) % 25).cast("string"))).alias("tenant_id"),
        F.element_at(kinds, (i % 7 + 1).cast("int")).alias("kind"), u.cast("string").alias("id"))
    return tenancy.read_requests(requests, fx.memberships(spark, sf), _items(spark, sf))


_PERMISSIONS_SQL = """
permissions AS (
  SELECT 'p-' || p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 50 = 0 THEN '  ' ELSE p_brand END AS resource,
    CASE WHEN p_partkey % 70 = 0 THEN '' ELSE 'act-' || (p_partkey % 97)::VARCHAR END AS action,
    CASE WHEN p_partkey % 90 = 0 THEN 'OLD' ELSE 'ACTIVE' END AS status FROM part)
"""


def _permissions(spark, sf):
    k = F.col("p_partkey")
    return fx.table(spark, sf, "part").select(
        F.concat(F.lit("p-"), k.cast("string")).alias("id"),
        F.when(k % 50 == 0, F.lit("  ")).otherwise(F.col("p_brand")).alias("resource"),
        F.when(k % 70 == 0, F.lit("")).otherwise(F.concat(F.lit("act-"), (k % 97).cast("string"))).alias("action"),
        F.when(k % 90 == 0, F.lit("OLD")).otherwise(F.lit("ACTIVE")).alias("status"))


@query("permission_checks", "WITH " + _PERMISSIONS_SQL + """
SELECT 'permissions' AS "table", 'status' AS rule, count(*) FILTER (WHERE status NOT IN ('ACTIVE','INACTIVE'))::BIGINT AS violations FROM permissions
UNION ALL SELECT 'permissions', 'resource_nonempty', count(*) FILTER (WHERE length(trim(resource)) = 0) FROM permissions
UNION ALL SELECT 'permissions', 'action_nonempty', count(*) FILTER (WHERE length(trim(action)) = 0) FROM permissions""")
def q_permission_checks(spark, sf):
    return schema_rules.rule_counts(_permissions(spark, sf), "permissions")


@query("schema_uniques", with_fx(["fx_memberships", "fx_tenants", "fx_bases", "fx_groups", "fx_config"], "WITH " + _PERMISSIONS_SQL + """,
found AS (
  SELECT 'memberships' AS "table", 'tenant_id,user_id' AS "constraint", to_json({'tenant_id': tenant_id, 'user_id': user_id})::VARCHAR AS key FROM fx_memberships
  UNION ALL SELECT 'tenants', 'slug', to_json({'slug': slug})::VARCHAR FROM fx_tenants
  UNION ALL SELECT 'bases', 'tenant_id,slug', to_json({'tenant_id': tenant_id, 'slug': slug})::VARCHAR FROM fx_bases
  UNION ALL SELECT 'groups', 'tenant_id,name', to_json({'tenant_id': tenant_id, 'name': name})::VARCHAR FROM fx_groups
  UNION ALL SELECT 'permissions', 'resource,action', to_json({'resource': resource, 'action': action})::VARCHAR FROM permissions
  UNION ALL SELECT 'role_permissions', 'role_id,permission_id',
    to_json({'role_id': 'r-' || (l_suppkey % 4)::VARCHAR, 'permission_id': 'p-' || l_partkey::VARCHAR})::VARCHAR FROM lineitem
  UNION ALL SELECT 'profiles', 'code', to_json({'code': profile_id})::VARCHAR FROM fx_config
  UNION ALL SELECT 'rules', 'code', to_json({'code': rule_version_id})::VARCHAR FROM fx_config WHERE rule_version_id IS NOT NULL
  UNION ALL SELECT 'sources', 'tenant_id,id', to_json({'tenant_id': lang, 'id': source})::VARCHAR FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
SELECT "table", "constraint", key, count(*)::BIGINT AS n FROM found GROUP BY ALL HAVING count(*) > 1"""))
def q_schema_uniques(spark, sf):
    cfg, lines, docs = fx.configs(spark, sf), fx.table(spark, sf, "lineitem"), fx.table(spark, sf, "documents")
    tables_ = {
        "memberships": fx.memberships(spark, sf), "tenants": fx.tenants(spark, sf), "bases": fx.bases(spark, sf),
        "groups": fx.groups(spark, sf), "permissions": _permissions(spark, sf),
        "role_permissions": lines.select(F.concat(F.lit("r-"), (F.col("l_suppkey") % 4).cast("string")).alias("role_id"),
                                         F.concat(F.lit("p-"), F.col("l_partkey").cast("string")).alias("permission_id")),
        "profiles": cfg.select(F.col("profile_id").alias("code")), "rules": cfg.select(F.col("rule_version_id").alias("code")),
        "sources": docs.select(F.col("lang").alias("tenant_id"), F.col("source").alias("id"))}
    out = None
    for name, df in tables_.items():
        part = schema_rules.unique_table(df, name)
        out = part if out is None else out.unionByName(part)
    return out
