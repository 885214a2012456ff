"""DuckDB SQL for the ``FX_*`` views of ``quarry.plans.fixtures``.

Each entry is the body of a CTE over the pre-registered table views
(``documents``, ``orders``, ...). ``with_fx(names, sql)`` prefixes a query
with the CTEs it needs.
"""

from __future__ import annotations

# The JavaScript whitespace class, in RE2 syntax.
WS = r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def utf16_len(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


FX = {
    "fx_uploads": """
SELECT doc_id AS seq, lang AS tenant_id, source AS source_id,
  CASE WHEN doc_id % 29 = 0 THEN '   '
       WHEN doc_id % 23 = 0 THEN 'dir/' || base
       WHEN doc_id % 31 = 0 THEN 'doc_' || doc_id::VARCHAR || '..json'
       WHEN doc_id % 13 = 0 THEN '  ' || base || ' '
       ELSE base END AS filename,
  CASE WHEN doc_id % 37 = 0 THEN 'application/pdf'
       WHEN doc_id % 41 = 0 THEN 'application/octet-stream'
       WHEN ext = '.CSV' THEN 'text/csv' ELSE 'application/json' END AS mime_type,
  strlen(text)::BIGINT AS size_bytes, text AS content,
  CASE WHEN doc_id % 43 = 0 THEN '   ' WHEN doc_id % 5 = 0 THEN 'k' || (doc_id % 40)::VARCHAR END AS idempotency_key
FROM (SELECT *, 'doc_' || doc_id::VARCHAR || ext AS base
      FROM (SELECT *, CASE WHEN doc_id % 11 = 0 THEN '.exe' WHEN doc_id % 3 = 0 THEN '.CSV' ELSE '.json' END AS ext
            FROM documents))""",
    "fx_sources": """
SELECT DISTINCT lang AS tenant_id, source AS id, 'ACTIVE' AS status FROM documents WHERE source <> 'src13'""",
    "fx_order_text": """
SELECT o_orderkey, o_orderkey // 100 AS file_id, o_orderkey::VARCHAR AS t_orderkey,
  o_custkey::VARCHAR AS t_custkey, o_orderstatus AS t_orderstatus,
  o_totalprice::DECIMAL(18,2)::VARCHAR AS t_totalprice, o_orderdate::VARCHAR AS t_orderdate,
  o_orderpriority AS t_orderpriority
FROM orders""",
    "fx_csv": """
SELECT 'orders_' || file_id::VARCHAR || CASE WHEN file_id % 6 = 1 THEN '.tsv' ELSE '.csv' END AS filename,
  file_id,
  'o_orderkey' || d || 'o_custkey' || d || 'o_orderstatus' || d || 'o_totalprice' || d || 'o_orderdate' || d
  || 'o_orderpriority' || eol
  || array_to_string(list(line ORDER BY o_orderkey), '') AS content
FROM (SELECT file_id, d, eol, o_orderkey,
        t_orderkey || d || t_custkey || d || t_orderstatus || d || t_totalprice || d || t_orderdate || d
        || CASE WHEN o_orderkey % 7 = 0 THEN '"' || t_orderpriority || '""x"' ELSE '"' || t_orderpriority || '"' END
        || eol || CASE WHEN o_orderkey % 9 = 0 THEN eol ELSE '' END AS line
      FROM (SELECT *, CASE file_id % 3 WHEN 0 THEN ',' WHEN 1 THEN chr(9) ELSE ';' END AS d,
                   CASE WHEN file_id % 2 = 1 THEN chr(13) || chr(10) ELSE chr(10) END AS eol
            FROM fx_order_text))
GROUP BY file_id, d, eol""",
    "fx_records": """
SELECT 't' || ((p_partkey // 500) % 3)::VARCHAR AS tenant_id,
  p_brand || '/' || (p_partkey // 500)::VARCHAR AS snapshot_id,
  row_number() OVER (PARTITION BY p_brand, p_partkey // 500 ORDER BY p_partkey)::BIGINT AS record_number,
  '{"reference":' || to_json(ref)::VARCHAR || ',"designation":' || to_json(des)::VARCHAR ||
  CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN ',"ean":null'
       WHEN p_partkey % 2 = 0 THEN ',"ean":' || p_size::VARCHAR
       ELSE ',"ean":"' || p_size::VARCHAR || '"' END || '}' AS payload,
  'src-' || p_brand AS source_id,
  'file-' || p_brand || '/' || (p_partkey // 500)::VARCHAR AS source_file_id,
  p_partkey, p_name, p_size, ref, des
FROM (SELECT *,
        CASE WHEN p_partkey % 4 = 0 THEN ' a-' || p_partkey::VARCHAR || '  ' ELSE 'A-' || p_partkey::VARCHAR END AS ref,
        CASE WHEN p_partkey % 6 = 0 THEN '  ' || replace(p_name, ' ', '   ') || chr(9) ELSE p_name END AS des
      FROM part)""",
    "fx_snap": """
SELECT (o_custkey % 10)::VARCHAR AS tenant_id, o_custkey::VARCHAR AS source_file_id,
  o_orderkey AS seq, o_orderdate AS created_at FROM orders""",
    "fx_columns": """
SELECT 'cols-' || (c_custkey // 7)::VARCHAR AS snapshot_id,
  (['sku','ean13','client_id','siren','siret','vat_no','fournisseur','clean_flag','private','designation',
    'barcode','customer_name','supplier_ref','article','city','amount','reference','notes'])[((c_custkey * 5) % 18 + 1)::INT]
   || '_' || (c_custkey // 18)::VARCHAR AS column_name,
  (c_custkey % 7)::BIGINT AS position
FROM customer""",
    "fx_ledger": """
SELECT (o_custkey % 10)::VARCHAR AS tenant_id, o_orderkey AS seq,
  o_orderdate::DATE::VARCHAR AS idempotency_key, (o_orderkey % 5000)::VARCHAR AS execution_id FROM orders""",
    "fx_transitions": """
SELECT user_id::VARCHAR AS run_id, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'PENDING' WHEN 'purchase' THEN 'COMPLETED'
                  WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'BOGUS' END AS status,
  ts, CASE WHEN event_id % 3 = 0 THEN (event_id % 101)::INT END AS progress
FROM events""",
    "fx_config": """
SELECT 'prof-' || (p_partkey % 50)::VARCHAR AS profile_id, (p_partkey // 50 + 1)::BIGINT AS version,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'pv-' || p_partkey::VARCHAR END AS profile_version_id,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'rv-' || (p_partkey % 7)::VARCHAR END AS rule_version_id,
  '{"entity_type":"ARTICLE","identity_fields":["reference"],"field_rules":{"designation":["'
   || CASE WHEN p_partkey % 2 = 0 THEN 'trim' ELSE 'collapse_whitespace' END || '"]},"label":'
   || to_json(p_name)::VARCHAR || ',"size":' || p_size::VARCHAR || '}' AS configuration
FROM part""",
    "fx_memberships": """
SELECT 'm-' || c_custkey::VARCHAR AS id, 'u-' || (c_custkey % 200)::VARCHAR AS user_id,
  'n-' || c_nationkey::VARCHAR AS tenant_id, 'r-' || ((c_custkey // 4) % 4)::VARCHAR AS role_id,
  (['ACTIVE','SUSPENDED','INVITED','REMOVED'])[(c_custkey % 4 + 1)::INT] AS status
FROM customer""",
    "fx_tenants": """
SELECT 'n-' || n_nationkey::VARCHAR AS id, n_name AS name, lower(replace(n_name, '_', '-')) AS slug,
  CASE WHEN n_nationkey % 5 = 4 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS status FROM nation""",
    "fx_roles": """
SELECT * FROM (VALUES ('r-0','OWNER','Owner'), ('r-1','ADMIN','Admin'), ('r-2','REVIEWER','Reviewer'),
  ('r-3','USER','User')) t(id, code, name)""",
    "fx_bases": """
SELECT 'b-' || s_suppkey::VARCHAR AS id, 'n-' || s_nationkey::VARCHAR AS tenant_id, s_name AS name,
  lower(replace(s_name, '#', '-')) AS slug, 'ACTIVE' AS status FROM supplier""",
    "fx_companies": """
SELECT 'c-' || c_custkey::VARCHAR AS id, 'n-' || c_nationkey::VARCHAR AS tenant_id, c_name AS name,
  CASE WHEN c_custkey % 3 <> 0 THEN 'EXT-' || (c_custkey % 300)::VARCHAR END AS external_reference,
  'ACTIVE' AS status FROM customer""",
    "fx_groups": """
SELECT 'g-' || n_nationkey::VARCHAR || '-' || r_regionkey::VARCHAR AS id, 'n-' || n_nationkey::VARCHAR AS tenant_id,
  r_name AS name, 'ACTIVE' AS status FROM nation JOIN region ON n_regionkey = r_regionkey""",
}

# dependencies between fixture CTEs
DEPS = {"fx_csv": ["fx_order_text"]}


def with_fx(names: list[str], sql: str) -> str:
    ordered: list[str] = []

    def add(n: str) -> None:
        for d in DEPS.get(n, []):
            add(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({FX[n]})" for n in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
