"""Input views derived from the test tables (``FX_*``), built with Spark.

Each view is a pure function of the parquet tables, so its size grows with
the scale factor. Where a view assembles file contents, the rows of one file
come from a fixed-width key range (at most ``BLOCK`` rows), never from a
natural group such as one customer, so a hot key cannot make one file (and
one task) unbounded. The same views are written in DuckDB SQL in
``quarry.plans.oracle_fixtures``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 100          # rows per generated CSV/JSON/XLSX file
RECORD_BLOCK = 500   # parts per brand block in FX_RECORDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_string(col: Column) -> Column:
    """A string as a JSON string literal (quoted and escaped)."""
    text = F.to_json(F.array(col))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _block(col: str, width: int = BLOCK) -> Column:
    return F.floor(F.col(col) / F.lit(width)).cast("long")


# ---------------------------------------------------------------- uploads
def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX_UPLOADS: one upload per document (tenant = lang, source = source)."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    ext = (F.when(i % 11 == 0, F.lit(".exe")).when(i % 3 == 0, F.lit(".CSV"))
            .otherwise(F.lit(".json")))
    base = F.concat(F.lit("doc_"), i.cast("string"), ext)
    name = (F.when(i % 29 == 0, F.lit("   "))
             .when(i % 23 == 0, F.concat(F.lit("dir/"), base))
             .when(i % 31 == 0, F.concat(F.lit("doc_"), i.cast("string"), F.lit("..json")))
             .when(i % 13 == 0, F.concat(F.lit("  "), base, F.lit(" ")))
             .otherwise(base))
    mime = (F.when(i % 37 == 0, F.lit("application/pdf"))
             .when(i % 41 == 0, F.lit("application/octet-stream"))
             .when(ext == ".CSV", F.lit("text/csv"))
             .otherwise(F.lit("application/json")))
    key = (F.when(i % 43 == 0, F.lit("   "))
            .when(i % 5 == 0, F.concat(F.lit("k"), (i % 40).cast("string"))))
    return d.select(
        i.alias("seq"), F.col("lang").alias("tenant_id"), F.col("source").alias("source_id"),
        name.alias("filename"), mime.alias("mime_type"),
        F.octet_length(F.col("text")).cast("long").alias("size_bytes"),
        F.col("text").alias("content"), key.alias("idempotency_key"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX_SOURCES: every (lang, source) pair except source ``src13``."""
    d = table(spark, sf_dir, "documents")
    return (d.filter(F.col("source") != "src13")
            .select(F.col("lang").alias("tenant_id"), F.col("source").alias("id"))
            .distinct().withColumn("status", F.lit("ACTIVE")))


# ---------------------------------------------------------------- files
def _csv_line(cells: list[Column], delim: Column) -> Column:
    return F.concat_ws("", *[x for c in cells for x in (c, delim)][:-1])


ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
              "o_orderpriority"]


def order_texts(o: DataFrame) -> DataFrame:
    """Order columns as the text a CSV writer would print."""
    return o.select(
        F.col("o_orderkey"),
        _block("o_orderkey").alias("file_id"),
        F.col("o_orderkey").cast("string").alias("t_orderkey"),
        F.col("o_custkey").cast("string").alias("t_custkey"),
        F.col("o_orderstatus").alias("t_orderstatus"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("t_totalprice"),
        F.col("o_orderdate").cast("string").alias("t_orderdate"),
        F.col("o_orderpriority").alias("t_orderpriority"))


def _csv_delim(fid: Column) -> Column:
    return F.when(fid % 3 == 0, F.lit(",")).when(fid % 3 == 1, F.lit("\t")).otherwise(F.lit(";"))


def _csv_eol(fid: Column) -> Column:
    return F.when(fid % 2 == 1, F.lit("\r\n")).otherwise(F.lit("\n"))


def _csv_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_id, body``: the lines of ``BLOCK`` order keys (see ``csv_files``)."""
    t = order_texts(table(spark, sf_dir, "orders"))
    delim, eol = _csv_delim(F.col("file_id")), _csv_eol(F.col("file_id"))
    prio = F.when(F.col("o_orderkey") % 7 == 0,
                  F.concat(F.lit('"'), F.col("t_orderpriority"), F.lit('""x"')))\
        .otherwise(F.concat(F.lit('"'), F.col("t_orderpriority"), F.lit('"')))
    cells = [F.col("t_orderkey"), F.col("t_custkey"), F.col("t_orderstatus"),
             F.col("t_totalprice"), F.col("t_orderdate"), prio]
    line = F.concat(_csv_line(cells, delim), eol,
                    F.when(F.col("o_orderkey") % 9 == 0, eol).otherwise(F.lit("")))
    body = t.select("file_id", "o_orderkey", line.alias("line")).groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))).alias("ls"))
    return body.select("file_id", F.array_join(F.transform("ls", lambda s: s["line"]), "").alias("body"))


def _csv_header(fid: Column) -> Column:
    return F.concat(_csv_line([F.lit(c) for c in ORDER_COLS], _csv_delim(fid)), _csv_eol(fid))


def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX_CSV: orders in files of ``BLOCK`` order keys.

    Delimiter by file_id % 3 (``,`` TAB ``;``); files with file_id % 6 == 1
    are named ``.tsv``; odd files end lines with CRLF; the priority is quoted
    (with a doubled quote when the order key % 7 == 0) and a blank line follows
    every order key % 9 == 0.
    """
    fid = F.col("file_id")
    ext = F.when(fid % 6 == 1, F.lit(".tsv")).otherwise(F.lit(".csv"))
    return _csv_bodies(spark, sf_dir).select(
        F.concat(F.lit("orders_"), fid.cast("string"), ext).alias("filename"), fid.alias("file_id"),
        F.concat(_csv_header(fid), F.col("body")).alias("content"))


RANGE = 997  # bytes of a generated range: cuts fall anywhere in a row


def _in_ranges(pieces: DataFrame) -> DataFrame:
    """``file_id, pos, data`` of text pieces ``file_id, nth, text``, cut every ``RANGE`` bytes."""
    data = F.col("text").cast("binary")
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(data) - 1, F.lit(0)), F.lit(RANGE))
    p = pieces.select(F.col("file_id").cast("string").alias("file_id"), "nth", data.alias("data"), F.explode(starts).alias("at"))
    return p.select("file_id", (F.shiftleft(F.col("nth").cast("long"), 30) + F.col("at")).alias("pos"),
                    F.expr(f"substring(data, at + 1, {RANGE})").alias("data"))


def csv_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX_CSV_RANGES: all orders in six files (block of the order key % 6),
    each in byte ranges, and a file 100 of nations whose last quote is open."""
    b = _csv_bodies(spark, sf_dir)
    fid = (F.col("file_id") % 6).alias("file_id")
    bodies = b.select(fid, (F.col("file_id") + 1).alias("nth"), F.col("body").alias("text"))
    heads = b.select(fid).distinct().select("file_id", F.lit(0).cast("long").alias("nth"), _csv_header(F.col("file_id")).alias("text"))
    n = table(spark, sf_dir, "nation")
    bad = n.select(F.lit(100).cast("long").alias("file_id"), F.col("n_nationkey").cast("long").alias("nth"),
                   F.concat(F.lit('"'), F.col("n_name"), F.lit('"\nx,"')).alias("text"))
    return _in_ranges(bodies.unionByName(heads).unionByName(bad))


def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX_JSON: events in JSON-array files of ``BLOCK`` event ids; every
    event id % 10 == 0 is a bare number element."""
    e = table(spark, sf_dir, "events")
    elem = F.when(F.col("event_id") % 10 == 0, F.col("event_id").cast("string")).otherwise(
        F.to_json(F.struct("event_id", "event_type")))
    g = (e.select(_block("event_id").alias("file_id"), "event_id", elem.alias("elem"))
         .groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "elem"))).alias("es")))
    return g.select(
        F.concat(F.lit("events_"), F.col("file_id").cast("string"), F.lit(".json")).alias("filename"),
        "file_id",
        F.concat(F.lit("["), F.array_join(F.transform("es", lambda s: s["elem"]), ","), F.lit("]")).alias("content"))


def json_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX_JSON_RANGES: all events in four array files (block of the event id %
    4) in byte ranges, each with a first element 0, and a file 100 of nations
    whose array never ends."""
    b = json_files(spark, sf_dir)
    fid = (F.col("file_id") % 4).alias("file_id")
    inner = F.expr("substring(content, 2, length(content) - 2)")
    bodies = b.select(fid, (F.col("file_id") + 1).alias("nth"), F.concat(F.lit(",\n"), inner).alias("text"))
    files = b.select(fid).distinct()
    heads = files.select("file_id", F.lit(0).cast("long").alias("nth"), F.lit("[0").alias("text"))
    ends = files.select("file_id", F.lit((1 << 32) - 1).cast("long").alias("nth"), F.lit(" ]\n").alias("text"))
    bad = table(spark, sf_dir, "nation").select(
        F.lit(100).cast("long").alias("file_id"), F.col("n_nationkey").cast("long").alias("nth"),
        F.concat(F.when(F.col("n_nationkey") == 0, "[").otherwise(","), json_string(F.col("n_name"))).alias("text"))
    return _in_ranges(bodies.unionByName(heads).unionByName(ends).unionByName(bad))


SUPPLIER_COLS = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]


def workbook_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX_XLSX: suppliers written as workbooks of ``BLOCK`` rows each;
    ``s_acctbal`` is left out (a sparse cell) when s_suppkey % 4 == 0."""
    from quarry.sources.workbook import build_workbook

    s = table(spark, sf_dir, "supplier")
    rows = s.select(
        _block("s_suppkey").alias("file_id"), F.col("s_suppkey"),
        F.col("s_suppkey").cast("string").alias("c0"), F.col("s_name").alias("c1"),
        F.col("s_nationkey").cast("string").alias("c2"),
        F.when(F.col("s_suppkey") % 4 != 0,
               F.col("s_acctbal").cast("decimal(18,2)").cast("string")).alias("c3"))

    def build(pdf):
        import pandas as pd
        pdf = pdf.sort_values("s_suppkey")
        data = build_workbook(SUPPLIER_COLS, pdf[["c0", "c1", "c2", "c3"]].astype(object)
                              .where(pdf[["c0", "c1", "c2", "c3"]].notna(), None).values.tolist())
        fid = int(pdf["file_id"].iloc[0])
        return pd.DataFrame({"filename": [f"suppliers_{fid}.xlsx"], "file_id": [fid], "content": [data]})

    return rows.groupBy("file_id").applyInPandas(build, "filename string, file_id long, content binary")


# ---------------------------------------------------------------- records
def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX_RECORDS: parsed article records from ``part``.

    snapshot = brand + block of ``RECORD_BLOCK`` part keys; record number by
    part key inside the snapshot (windows bounded by the block). Payload keys
    ``reference`` (padded/lower-case variants), ``designation`` (p_name with
    extra spaces), ``ean``: absent if p_partkey % 3 == 0, JSON null if % 5 == 0,
    a number if % 2 == 0, else text.
    """
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    snap = F.concat(F.col("p_brand"), F.lit("/"), F.floor(k / RECORD_BLOCK).cast("long").cast("string"))
    ref = (F.when(k % 4 == 0, F.concat(F.lit(" a-"), k.cast("string"), F.lit("  ")))
            .otherwise(F.concat(F.lit("A-"), k.cast("string"))))
    des = F.when(k % 6 == 0, F.concat(F.lit("  "), F.replace(F.col("p_name"), F.lit(" "), F.lit("   ")), F.lit("\t")))\
        .otherwise(F.col("p_name"))
    head = F.concat(F.lit('{"reference":'), json_string(ref), F.lit(',"designation":'), json_string(des))
    ean = (F.when(k % 3 == 0, F.lit(""))
            .when(k % 5 == 0, F.lit(',"ean":null'))
            .when(k % 2 == 0, F.concat(F.lit(',"ean":'), F.col("p_size").cast("string")))
            .otherwise(F.concat(F.lit(',"ean":"'), F.col("p_size").cast("string"), F.lit('"'))))
    w = Window.partitionBy("p_brand", F.floor(k / RECORD_BLOCK)).orderBy(k)
    return p.select(
        F.concat(F.lit("t"), (F.floor(k / RECORD_BLOCK) % 3).cast("string")).alias("tenant_id"),
        snap.alias("snapshot_id"),
        F.row_number().over(w).cast("long").alias("record_number"),
        F.concat(head, ean, F.lit("}")).alias("payload"),
        F.concat(F.lit("src-"), F.col("p_brand")).alias("source_id"),
        F.concat(F.lit("file-"), snap).alias("source_file_id"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX_SNAP: snapshot arrivals from ``orders`` (file = customer)."""
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 10).cast("string").alias("tenant_id"),
                    F.col("o_custkey").cast("string").alias("source_file_id"),
                    F.col("o_orderkey").alias("seq"),
                    F.col("o_orderdate").alias("created_at"))


# Column-name vocabulary for the domain fixture.
COLUMN_WORDS = ["sku", "ean13", "client_id", "siren", "siret", "vat_no", "fournisseur",
                "clean_flag", "private", "designation", "barcode", "customer_name",
                "supplier_ref", "article", "city", "amount", "reference", "notes"]


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX_COLUMNS: (snapshot, column) pairs from ``customer``: seven customers
    per snapshot, the column word chosen by c_custkey % 18 and made unique by
    a numeric suffix."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    words = F.array(*[F.lit(w) for w in COLUMN_WORDS])
    word = F.element_at(words, ((k * 5) % len(COLUMN_WORDS) + 1).cast("int"))
    return c.select(F.concat(F.lit("cols-"), F.floor(k / 7).cast("long").cast("string")).alias("snapshot_id"),
                    F.concat(word, F.lit("_"), F.floor(k / len(COLUMN_WORDS)).cast("long").cast("string")).alias("column_name"),
                    (k % 7).cast("long").alias("position"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX_LEDGER: run requests from ``orders``."""
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 10).cast("string").alias("tenant_id"),
                    F.col("o_orderkey").alias("seq"),
                    F.col("o_orderdate").cast("date").cast("string").alias("idempotency_key"),
                    (F.col("o_orderkey") % 5000).cast("string").alias("execution_id"))


# Event type -> status for the transition fixture.
EVENT_STATUS = {"view": "RUNNING", "click": "PENDING", "purchase": "COMPLETED",
                "error": "FAILED", "signup": "BOGUS"}


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX_TRANSITIONS: run status changes from ``events`` (run = user)."""
    e = table(spark, sf_dir, "events")
    m = F.create_map(*[x for kv in EVENT_STATUS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"),
                    m[F.col("event_type")].alias("status"), F.col("ts"),
                    F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 101).cast("int")).alias("progress"))


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX_CONFIG: profile configurations from ``part`` (50 profiles, one
    version per part)."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    cfg = F.concat(F.lit('{"entity_type":"ARTICLE","identity_fields":["reference"],"field_rules":{"designation":["'),
                   F.when(k % 2 == 0, F.lit("trim")).otherwise(F.lit("collapse_whitespace")),
                   F.lit('"]},"label":'), json_string(F.col("p_name")),
                   F.lit(',"size":'), F.col("p_size").cast("string"), F.lit("}"))
    return p.select(F.concat(F.lit("prof-"), (k % 50).cast("string")).alias("profile_id"),
                    (F.floor(k / 50) + 1).cast("long").alias("version"),
                    F.when(k % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("pv-"), k.cast("string"))).alias("profile_version_id"),
                    F.when(k % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("rv-"), (k % 7).cast("string"))).alias("rule_version_id"),
                    cfg.alias("configuration"))


# ---------------------------------------------------------------- identity
# Role codes and membership states.
ROLE_CODES = ["OWNER", "ADMIN", "REVIEWER", "USER"]
MEMBER_STATES = ["ACTIVE", "SUSPENDED", "INVITED", "REMOVED"]


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    states = F.array(*[F.lit(s) for s in MEMBER_STATES])
    return c.select(F.concat(F.lit("m-"), k.cast("string")).alias("id"),
                    F.concat(F.lit("u-"), (k % 200).cast("string")).alias("user_id"),
                    F.concat(F.lit("n-"), F.col("c_nationkey").cast("string")).alias("tenant_id"),
                    F.concat(F.lit("r-"), (F.floor(k / 4) % 4).cast("string")).alias("role_id"),
                    F.element_at(states, ((k % 4) + 1).cast("int")).alias("status"))


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")).alias("id"),
                    F.col("n_name").alias("name"),
                    F.lower(F.replace(F.col("n_name"), F.lit("_"), F.lit("-"))).alias("slug"),
                    F.when(F.col("n_nationkey") % 5 == 4, F.lit("SUSPENDED")).otherwise(F.lit("ACTIVE")).alias("status"))


def roles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"r-{i}", c, c.title()) for i, c in enumerate(ROLE_CODES)],
                                 "id string, code string, name string")


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("b-"), F.col("s_suppkey").cast("string")).alias("id"),
                    F.concat(F.lit("n-"), F.col("s_nationkey").cast("string")).alias("tenant_id"),
                    F.col("s_name").alias("name"),
                    F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("-"))).alias("slug"),
                    F.lit("ACTIVE").alias("status"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(F.concat(F.lit("c-"), k.cast("string")).alias("id"),
                    F.concat(F.lit("n-"), F.col("c_nationkey").cast("string")).alias("tenant_id"),
                    F.col("c_name").alias("name"),
                    F.when(k % 3 != 0, F.concat(F.lit("EXT-"), (k % 300).cast("string"))).alias("external_reference"),
                    F.lit("ACTIVE").alias("status"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.concat(F.lit("g-"), F.col("n_nationkey").cast("string"), F.lit("-"), F.col("r_regionkey").cast("string")).alias("id"),
        F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")).alias("tenant_id"),
        F.col("r_name").alias("name"), F.lit("ACTIVE").alias("status"))
