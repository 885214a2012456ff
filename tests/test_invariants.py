"""Invariants on the sf0.01 tables: NEW checksums are unique per tenant,
every REPLAY points at a NEW/DUPLICATE file, entities = records, and the
lineage walk entity -> record -> snapshot -> file -> source loses no row."""

from pyspark.sql import functions as F

from quarry.operators import entity, intake
from quarry.plans import catalog as c
from quarry.plans import fixtures as fx

SF = "/root/testdata/sf0.01"


def test_intake_invariants(spark):
    res = intake.resolve_uploads(fx.uploads(spark, SF), fx.sources(spark, SF))
    new = res.filter(F.col("status") == "NEW")
    assert new.count() == new.select("tenant_id", "checksum_sha256").distinct().count()
    files = new.select("file_id").distinct()
    pointed = res.filter(F.col("status").isin("DUPLICATE", "REPLAY")).select("file_id").distinct()
    assert pointed.join(files, "file_id", "left_anti").count() == 0
    assert res.filter((F.col("status") == "REJECTED") & F.col("reason").isNull()).count() == 0
    assert res.count() == fx.uploads(spark, SF).count()


def test_entity_and_lineage_invariants(spark):
    r = c._enriched_records(spark, SF)
    ents = c._entities(spark, SF)
    assert ents.count() == r.count()
    assert ents.select("entity_id").distinct().count() == ents.count()
    records = r.select(F.col("source_record_id").alias("id"), "tenant_id", "snapshot_id")
    snaps = r.select(F.col("snapshot_id").alias("id"), "tenant_id", "source_file_id").distinct()
    files = r.select(F.col("source_file_id").alias("id"), "tenant_id", "source_id").distinct()
    sources = r.select(F.col("source_id").alias("id"), "tenant_id").distinct()
    total = entity.lineage(ents, records, snaps, files, sources).agg(F.sum("entities")).first()[0]
    assert total == ents.count()
