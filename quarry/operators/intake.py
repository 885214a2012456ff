"""Intake (I1-I6): file policy, checksum, tenant dedup, idempotent replay,
source gate and the ingest manifest, set-at-a-time over a batch of uploads.

Upload rows: ``seq`` (arrival order: any type with an order, unique), ``tenant_id``, ``source_id``,
``filename``, ``mime_type``, ``content`` (binary or string), optional
``size_bytes`` and ``idempotency_key``.

Resolution (same outcome as handling the uploads one by one in ``seq`` order):

1. ``key_ok``: key null, or 1..255 UTF-16 units after trim; ``valid`` =
   key_ok and source exists in tenant and the file policy passes.
2. ``key_seq`` = min(seq) of valid keyed rows per (tenant, key), including
   keys registered by earlier batches.
3. bad key -> REJECTED; keyed row after ``key_seq`` -> REPLAY (wins even if
   the row is otherwise invalid); other invalid rows -> REJECTED.
4. Among the remaining candidates, the first per (tenant, checksum) is NEW
   unless an earlier batch already stored that checksum; the others are
   DUPLICATE of the stored/first file.
5. A REPLAY copies the result of row ``key_seq``.

Shuffles are keyed by (tenant, key), (tenant, checksum) and (tenant, seq),
never by tenant alone, and the file content is dropped right after hashing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.grouping import first_by, materialize
from quarry.functions.text import js_trim, utf16_length

# Size limit (bytes, inclusive), allowed MIME types per
# extension, and the storage provider name written on artifacts.
MAX_BYTES = 25 * 1024 * 1024
MAX_NAME = 255
MAX_KEY = 255
OCTET = "application/octet-stream"
ALLOWED_MIME = {
    ".csv": ["text/csv", "application/csv", "application/octet-stream"],
    ".tsv": ["text/tab-separated-values", "text/tsv", "application/octet-stream"],
    ".json": ["application/json", "text/json", "application/octet-stream"],
    ".xlsx": ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
              "application/octet-stream"],
    ".xlsm": ["application/vnd.ms-excel.sheet.macroEnabled.12",
              "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
              "application/octet-stream"],
    ".pdf": ["application/pdf", "application/octet-stream"],
}
STORAGE_PROVIDER = "local-private"

NEW, DUPLICATE, REPLAY, REJECTED = "NEW", "DUPLICATE", "REPLAY", "REJECTED"


def _allowed_map() -> Column:
    kv = []
    for ext, mimes in ALLOWED_MIME.items():
        kv += [F.lit(ext), F.array(*[F.lit(m) for m in mimes])]
    return F.create_map(*kv)


def clean_name(name: Column) -> Column:
    return js_trim(F.coalesce(name.cast("string"), F.lit("")))


def extension(name: Column) -> Column:
    """Lower-cased text from the last dot, else ``""``."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)\z", 1))


def policy_reason(name: Column, size: Column, mime: Column,
                  max_bytes: int | None = None) -> Column:
    """The first failing rule's message, or null when the file passes.

    ``name`` must already be the cleaned name (see ``clean_name``); callers
    materialize it as a column so the trim runs once per row.
    """
    n = name
    ext = extension(n)
    allowed = _allowed_map()[ext]
    size_bad = size.isNull() | (size < 0)
    if max_bytes is not None:
        size_bad = size_bad | (size > F.lit(max_bytes))
    mime_s = mime.cast("string")
    return (F.when(n == "", F.lit("Filename is required"))
             .when(utf16_length(n) > MAX_NAME, F.lit("Filename is too long"))
             .when(n.contains("\\") | n.contains("/"), F.lit("Filename must not contain path separators"))
             .when(n.isin(".", ".."), F.lit("Invalid filename"))
             .when(n.rlike(r"[\x00-\x1F\x7F]"), F.lit("Filename contains control characters"))
             .when(allowed.isNull(), F.concat(F.lit("Unsupported file extension: "),
                                               F.when(ext == "", F.lit("(none)")).otherwise(ext)))
             .when(size_bad, F.lit("File exceeds configured size limit"))
             .when(mime_s.isNull() | (mime_s == ""), F.lit("MIME type is required"))
             .when(~F.array_contains(allowed, mime_s) & (mime_s != OCTET),
                   F.concat(F.lit("MIME type does not match extension: "), mime_s))
             # deliberate difference: a key with ".." would be refused by storage later
             .when(n.contains(".."), F.lit("Invalid storage key")))


def file_policy(uploads: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """I1 over a table: adds ``clean_filename``, ``extension``, ``reject_reason``."""
    size = _size_col(uploads)
    named = uploads.withColumn("clean_filename", clean_name(F.col("filename")))
    n = F.col("clean_filename")
    return named.select(
        "*", extension(n).alias("extension"),
        policy_reason(n, size, F.col("mime_type"), max_bytes).alias("reject_reason"))


def _content_bytes(df: DataFrame) -> Column:
    c = F.col("content")
    return c if dict(df.dtypes).get("content") == "binary" else c.cast("binary")


def _size_col(df: DataFrame) -> Column:
    if "size_bytes" in df.columns:
        return F.col("size_bytes").cast("long")
    return F.octet_length(_content_bytes(df)).cast("long")


def checksum(df: DataFrame, out: str = "checksum_sha256") -> DataFrame:
    """SHA-256 hex of the file bytes."""
    return df.withColumn(out, F.sha2(_content_bytes(df), 256))


def dedup_by_checksum(df: DataFrame, seq: str = "seq", tenant: str = "tenant_id",
                      digest: str = "checksum_sha256") -> DataFrame:
    """I3 alone: first row per (tenant, checksum); adds ``first_seq``, ``duplicate``.

    The first seq per key is an aggregate (combined map-side) joined back on
    the same key, so even a checksum repeated by a third of the rows is
    spread by AQE's skew-join split rather than sorted in one window task.
    """
    firsts = df.groupBy(tenant, digest).agg(F.min(seq).alias("first_seq"))
    return (df.join(firsts, [tenant, digest])
            .withColumn("duplicate", F.col(seq) != F.col("first_seq")))


def file_id(tenant: Column, digest: Column) -> Column:
    """Deterministic source-file id: one per (tenant, checksum)."""
    return F.sha2(F.concat_ws("|", F.lit("file"), tenant, digest), 256)


def source_gate(uploads: DataFrame, sources: DataFrame) -> DataFrame:
    """I6 gate: adds ``source_ok`` (the source exists in the upload's tenant)."""
    known = (sources.select("tenant_id", F.col("id").alias("source_id"))
             .dropDuplicates(["tenant_id", "source_id"])
             .withColumn("source_ok", F.lit(True)))
    return (uploads.join(known, ["tenant_id", "source_id"], "left")
            .withColumn("source_ok", F.coalesce(F.col("source_ok"), F.lit(False))))


def create_sources(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I6 registration: name required; type FILE and status ACTIVE by default.

    Returns (sources, rejected). Ids derive from (tenant, request id).
    """
    cols = requests.columns
    name = F.col("name").cast("string")
    ok = name.isNotNull() & (name != "")
    src = requests.filter(ok).select(
        F.sha2(F.concat_ws("|", F.lit("source"), F.col("tenant_id"), F.col("request_id").cast("string")), 256).alias("id"),
        "tenant_id", name.alias("name"),
        (F.coalesce(F.col("source_type"), F.lit("FILE")) if "source_type" in cols else F.lit("FILE")).alias("source_type"),
        F.lit("ACTIVE").alias("status"),
        (F.coalesce(F.col("metadata"), F.lit("{}")) if "metadata" in cols else F.lit("{}")).alias("metadata"))
    rejected = requests.filter(~ok).select("request_id", "tenant_id",
                                           F.lit("Source name required").alias("reason"))
    return src, rejected


def resolve_uploads(uploads: DataFrame, sources: DataFrame,
                    prior_files: DataFrame | None = None,
                    prior_keys: DataFrame | None = None,
                    max_bytes: int | None = None) -> DataFrame:
    """I3+I4+I6 (+I1, I2): one result row per upload.

    ``prior_files``: (tenant_id, checksum_sha256, file_id) already stored.
    ``prior_keys``: (tenant_id, idempotency_key, file_id, duplicate) already
    registered. Both count as earlier than every row of the batch.

    Output: seq, tenant_id, source_id, clean_filename, extension, mime_type,
    size_bytes, checksum_sha256, status, reason, error_code (VALIDATION_ERROR
    or NOT_FOUND for refusals), file_id, duplicate, idempotent_replay.
    """
    key_raw = F.col("idempotency_key") if "idempotency_key" in uploads.columns else F.lit(None).cast("string")
    size = _size_col(uploads)
    base = uploads.select(
        "seq", "tenant_id", "source_id",
        F.col("filename"), F.col("mime_type").cast("string").alias("mime_type"),
        size.alias("size_bytes"), key_raw.cast("string").alias("key_raw"),
        F.sha2(_content_bytes(uploads), 256).alias("checksum_sha256"))
    named = base.withColumns({
        "idem_key": F.when(F.col("key_raw").isNotNull(), js_trim(F.col("key_raw"))),
        "clean_filename": clean_name(F.col("filename"))})
    rows = named.select(
        "seq", "tenant_id", "source_id", "mime_type", "size_bytes", "checksum_sha256", "idem_key",
        "clean_filename",
        (F.col("key_raw").isNull()
         | ((F.col("idem_key") != "") & (utf16_length(F.col("idem_key")) <= MAX_KEY))).alias("key_ok"),
        extension(F.col("clean_filename")).alias("extension"),
        policy_reason(F.col("clean_filename"), F.col("size_bytes"), F.col("mime_type"), max_bytes).alias("policy"),
        F.col("checksum_sha256").isNotNull().alias("has_buffer"))
    rows = source_gate(rows, sources)
    # the narrow per-upload rows (no content) feed five branches below: read
    # and hash the file bytes once
    rows = materialize(rows)
    rows = rows.withColumn("valid", F.col("has_buffer") & F.col("key_ok") & F.col("source_ok")
                           & F.col("policy").isNull())

    # step 2: first valid keyed row per (tenant, key); earlier batches win
    keyed = rows.filter(F.col("valid") & F.col("idem_key").isNotNull())
    firsts = keyed.groupBy("tenant_id", "idem_key").agg(F.min("seq").alias("key_seq"))
    if prior_keys is not None:
        # only history rows whose key occurs in this batch matter: a semi-join
        # against the batch's distinct keys, not an aggregation of all history
        batch_keys = rows.filter(F.col("idem_key").isNotNull()).select("tenant_id", "idem_key").distinct()
        pk = (prior_keys.select("tenant_id", F.col("idempotency_key").alias("idem_key"))
              .join(batch_keys, ["tenant_id", "idem_key"], "left_semi")
              .distinct().withColumn("key_prior", F.lit(True)))
        firsts = firsts.join(pk, ["tenant_id", "idem_key"], "full")
    else:
        firsts = firsts.withColumn("key_prior", F.lit(None).cast("boolean"))
    # only keyed rows take part in the join: null keys would all hash to one reducer
    keyed_rows = rows.filter(F.col("idem_key").isNotNull()).join(firsts, ["tenant_id", "idem_key"], "left")
    plain_rows = rows.filter(F.col("idem_key").isNull()).withColumns({
        "key_seq": F.lit(None).cast(rows.schema["seq"].dataType), "key_prior": F.lit(None).cast("boolean")})
    rows = keyed_rows.unionByName(plain_rows).withColumn("key_prior", F.coalesce("key_prior", F.lit(False)))

    status0 = (F.when(~F.col("has_buffer"), F.lit(REJECTED))
                .when(~F.col("key_ok"), F.lit(REJECTED))
                .when(F.col("idem_key").isNotNull()
                      & (F.col("key_prior") | F.coalesce(F.col("seq") > F.col("key_seq"), F.lit(False))), F.lit(REPLAY))
                .when(~F.col("source_ok"), F.lit(REJECTED))
                .when(F.col("policy").isNotNull(), F.lit(REJECTED)))
    reason = (F.when(~F.col("has_buffer"), F.lit("File buffer is required"))
               .when(~F.col("key_ok"), F.lit("Invalid Idempotency-Key"))
               .when(~F.col("source_ok"), F.lit("Source not found"))
               .otherwise(F.col("policy")))
    code = F.when(F.col("source_ok") | ~F.col("key_ok") | ~F.col("has_buffer"),
                  F.lit("VALIDATION_ERROR")).otherwise(F.lit("NOT_FOUND"))
    rows = rows.withColumn("status0", status0).withColumns({
        "reason": F.when(F.col("status0") == REJECTED, reason),
        "error_code": F.when(F.col("status0") == REJECTED, code)})

    # step 4: first candidate per (tenant, checksum); stored files come first
    cand = rows.filter(F.col("status0").isNull())
    first_cs = cand.groupBy("tenant_id", "checksum_sha256").agg(F.min("seq").alias("first_seq"))
    if prior_files is not None:
        batch_cs = cand.select("tenant_id", "checksum_sha256").distinct()
        pf = (prior_files.select("tenant_id", "checksum_sha256")
              .join(batch_cs, ["tenant_id", "checksum_sha256"], "left_semi")
              .distinct().withColumn("cs_prior", F.lit(True)))
        first_cs = first_cs.join(pf, ["tenant_id", "checksum_sha256"], "left")
    else:
        first_cs = first_cs.withColumn("cs_prior", F.lit(None).cast("boolean"))
    is_new = (F.col("seq") == F.col("first_seq")) & F.col("cs_prior").isNull()
    cand = cand.join(first_cs, ["tenant_id", "checksum_sha256"], "left").withColumns({
        "status": F.when(is_new, F.lit(NEW)).otherwise(F.lit(DUPLICATE)),
        "file_id": file_id(F.col("tenant_id"), F.col("checksum_sha256")),
        "duplicate": ~is_new,
        "idempotent_replay": F.lit(False)})

    out_cols = ["seq", "tenant_id", "source_id", "clean_filename", "extension", "mime_type",
                "size_bytes", "checksum_sha256", "idem_key", "status", "reason", "error_code", "file_id",
                "duplicate", "idempotent_replay"]
    cand = cand.select(*out_cols)

    # step 5: a replay copies the result of row key_seq (this batch or an earlier one)
    replay = rows.filter(F.col("status0") == REPLAY)
    winners = cand.filter(F.col("idem_key").isNotNull()).select(
        "tenant_id", F.col("seq").alias("key_seq"), F.col("file_id").alias("w_file"),
        F.col("duplicate").alias("w_dup"))
    replay = replay.join(winners, ["tenant_id", "key_seq"], "left")
    if prior_keys is not None:
        pk = first_by(prior_keys.select("tenant_id", F.col("idempotency_key").alias("idem_key"),
                                        F.col("file_id").alias("p_file"), F.col("duplicate").alias("p_dup"))
                      .join(replay.select("tenant_id", "idem_key").distinct(), ["tenant_id", "idem_key"], "left_semi"),
                      ["tenant_id", "idem_key"], F.col("p_file"))
        replay = replay.join(pk, ["tenant_id", "idem_key"], "left")
        w_file = F.when(F.col("key_prior"), F.col("p_file")).otherwise(F.col("w_file"))
        w_dup = F.when(F.col("key_prior"), F.col("p_dup")).otherwise(F.col("w_dup"))
    else:
        w_file, w_dup = F.col("w_file"), F.col("w_dup")
    replay = replay.select(
        "seq", "tenant_id", "source_id", "clean_filename", "extension", "mime_type", "size_bytes",
        "checksum_sha256", "idem_key", F.lit(REPLAY).alias("status"),
        F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("error_code"),
        w_file.alias("file_id"),
        w_dup.alias("duplicate"), F.lit(True).alias("idempotent_replay"))

    rejected = rows.filter(F.col("status0") == REJECTED).select(
        "seq", "tenant_id", "source_id", "clean_filename", "extension", "mime_type", "size_bytes",
        "checksum_sha256", "idem_key", F.lit(REJECTED).alias("status"), "reason", "error_code",
        F.lit(None).cast("string").alias("file_id"), F.lit(None).cast("boolean").alias("duplicate"),
        F.lit(False).alias("idempotent_replay"))
    return (cand.unionByName(replay).unionByName(rejected)
            .withColumnRenamed("idem_key", "idempotency_key"))


def ingest_manifest(resolved: DataFrame, created_at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows for ``source_files`` (VERIFIED) and ``artifacts`` (version 1) of NEW files."""
    new = resolved.filter(F.col("status") == NEW)
    ts = F.lit(created_at).cast("timestamp") if created_at else F.lit(None).cast("timestamp")
    files = new.select(
        F.col("file_id").alias("id"), "tenant_id", "source_id",
        F.col("clean_filename").alias("original_name"), "size_bytes", "mime_type", "extension",
        "checksum_sha256", F.lit("VERIFIED").alias("status"), ts.alias("created_at"))
    key = F.concat(F.col("tenant_id"), F.lit("/sources/"), F.col("file_id"), F.lit("/"),
                   F.replace(F.col("clean_filename"), F.lit("/"), F.lit("_")))
    artifacts = new.select(
        F.sha2(F.concat_ws("|", F.lit("artifact"), F.col("file_id")), 256).alias("id"),
        "tenant_id", F.col("file_id").alias("source_file_id"),
        F.lit(STORAGE_PROVIDER).alias("storage_provider"), key.alias("storage_key"),
        "mime_type", "size_bytes", "checksum_sha256", F.lit(1).alias("version"), ts.alias("created_at"))
    return files, artifacts


def registered_keys(resolved: DataFrame) -> DataFrame:
    """Keys registered by NEW and DUPLICATE rows (to seed the next batch)."""
    return (resolved.filter(F.col("status").isin(NEW, DUPLICATE) & F.col("idempotency_key").isNotNull())
            .select("tenant_id", "idempotency_key", "file_id", "duplicate"))


def stored_files(resolved: DataFrame) -> DataFrame:
    """Files stored by NEW rows (to seed the next batch)."""
    return resolved.filter(F.col("status") == NEW).select("tenant_id", "checksum_sha256", "file_id")


def resolve_in_turn(batches: list[DataFrame], sources: DataFrame, max_bytes: int | None = None) -> list[DataFrame]:
    """I3-I5 over batches that arrive one after another: each one sees the
    files and keys that all earlier ones stored. Results are materialized (the
    stored history); a batch's ``seq`` numbers may repeat those of another."""
    done: list[DataFrame] = []
    files = keys = None
    for batch in batches:
        got = materialize(resolve_uploads(batch, sources, files, keys, max_bytes))
        done.append(got)
        new_files, new_keys = stored_files(got), registered_keys(got)
        files = new_files if files is None else files.unionByName(new_files)
        keys = new_keys if keys is None else keys.unionByName(new_keys)
    return done
