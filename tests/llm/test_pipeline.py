import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from chromafold.llm.simhash import one_of_each
from tests.llm.test_resemblance import survivors

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_of_each_keeps_the_smallest_id(spark):
    rows = [(5, "a b c d e f", 1), (3, "a b c d e f", 2), (None, "a b c d e f", 3), (7, "z", 4), (7, "z", 5), (None, "lonely words here", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int").withColumnRenamed("_row", "fp")
    out = one_of_each(df)
    assert out.columns == ["doc_id", "text", "fp"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == [(3, "a b c d e f"), (7, "z"), (None, "lonely words here")]
    assert one_of_each(df.limit(0)).collect() == []


def test_stages_keep_columns_and_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(path := str(tmp_path / f"{i}-{name}"))
        after = spark.read.parquet(path)
        if name != "pack":
            assert after.columns == docs.columns
        if name in ("substring_dedup", "private_data"):
            assert after.count() == docs.count()
        if name == "near_dedup":  # pairs by brute force: similarity 0.8 of five-word shingles
            assert sorted(r.doc_id for r in after.collect()) == survivors([tuple(r) for r in docs.collect()])
        if name == "pack":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in docs.collect()}
        docs = after
    ran = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, ran.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "start", "length", "ids_crc32").collect()))


NAMES = ["_email", "_ip", "_secret", "_id", "_hash", "_removed", "_of", "_at", "_name", "_i", "_h", "_asked", "_text", "row", "at", "name", "of", "id", "host", "removed", "of_id",
         "of_hash", "of_host", "fp", "h", "t", "u", "w", "g", "lines", "doc.id", "n_words", "n_removed", "kept_sha256", "kept", "_t", "_u", "_kept", "_c0", "total", "lost", "spans", "copies"]


@pytest.mark.parametrize("stage", [s for n, s in corpus_pipeline.STAGES if n != "pack"])
def test_stages_leave_columns_of_any_name_alone(spark, stage):
    base = spark.createDataFrame([(i, f"document {i} of ten or more words that nobody else wrote, number {i}, mail a{i}@b.co", "en", "h", 1) for i in range(3)], DOCS)
    docs = base.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES))
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    for r in out.collect():
        assert all(r[n] == f"{n}{r.doc_id}" for n in NAMES)
    assert out.count() == 3


def test_stages_take_empty_and_null_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None)] * 2):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).collect()
