import corpus_pipeline as c
import pytest

from quarry.llm import decontaminate, jaccard_join, packing, pii, quality
from quarry.llm.common import new_folder, table
from quarry.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, edge_rows, make_docs):
    """The small tables, with edge cases among the documents."""
    path = new_folder(spark, "pipeline-test")
    docs = table(spark, SF, "documents")
    more = make_docs([(None if i is None else i + 10_000, t) for i, t in edge_rows]).select(docs.columns)
    docs.unionByName(more).unionByName(docs.limit(5)).selectExpr("*", "1 AS k1", "'x' AS __h").write.parquet(f"{path}/documents.parquet")
    for t in ("labels", "benchmark"):
        table(spark, SF, t).write.parquet(f"{path}/{t}.parquet")
    return path


def rows(df):
    return sorted(str(tuple(r)) for r in df.select(sorted(df.columns)).collect())


def test_every_stage_equals_its_operator(spark, folder):
    docs = table(spark, folder, "documents")
    assert [n for n, _ in c.STAGES] == ["quality", "near_duplicates", "decontaminate", "pii", "pack"]
    for name, stage in c.STAGES:
        out = stage(spark, docs, folder)
        before = docs.select(*c.COLUMNS)
        if name == "quality":
            keep = quality.classify(before, table(spark, folder, "labels"))
            assert out.count() == keep.where("keep").count() < before.count()
        elif name == "near_duplicates":
            found = jaccard_join.joined(before)
            assert out.where("doc_id IS NOT NULL").count() == found.where("n_shingles > 0 AND doc_id IS NOT NULL").select(
                "component_class").distinct().count()
            assert jaccard_join.joined(out).where("n_shingles > 0").groupBy("component_class").count().where("count > 1").isEmpty()
        elif name == "decontaminate":
            bench = table(spark, folder, "benchmark")
            bad = {(r["doc_id"]) for r in decontaminate.overlaps(before, bench).collect()}
            assert bad and {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in out.collect()} == bad
        elif name == "pii":
            assert out.count() == before.count()
            model = pii.Model(pii.fit(before))
            want = {(r["doc_id"], pii.mask(r["text"], model.spans(r["text"], pii.base_spans(r["text"])))) for r in before.collect()}
            assert {(r["doc_id"], r["text"]) for r in out.collect()} == want
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        else:
            assert rows(out.select("doc_id", "piece", "start", "length", "ids_crc32", "ids")) == rows(
                packing.token_pieces(before, tokenizer_path(), keep_ids=True))
            assert all(len(r["ids"]) == 4 * r["length"] for r in out.collect())
        if name != "pack":
            assert out.columns == c.COLUMNS
            path = new_folder(spark, "stage")
            out.write.parquet(path)
            docs = spark.read.parquet(path)


def test_run_and_empty_table(spark, folder):
    assert c.run(spark, folder).count() > 0
    empty = table(spark, folder, "documents").limit(0)
    for _, stage in c.STAGES:
        assert stage(spark, empty, folder).count() == 0
