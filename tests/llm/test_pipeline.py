import corpus_pipeline
import plain
import pytest
from pyspark.sql import functions as F

from textloom.llm import packing


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{path}/documents.parquet")
    clean = [r for r in docs.collect() if r.doc_id == 20][0].text
    items = [(1, " ".join(clean.split(" ")[5:20])), (2, "nowhere to be found at all in any of these texts")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_one_by_one(spark, docs, folder):
    at = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in at.collect()}
        at = stage(spark, at, folder)
        rows = at.collect()
        if name == "best_fit_packing":
            assert {r.doc_id for r in rows} == set(before)
            break
        assert at.columns == docs.columns
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        seen[name] = after
        if name == "quality_rules":
            assert set(after) == {i for i, r in before.items() if plain.quality(r.text)[-1]}
        if name == "simhash_near_dedup":
            assert set(before) - set(after) >= set(before) & set(range(25, 38))
            assert set(range(25)) & set(before) <= set(after)
        if name == "substring_dedup":
            ids = sorted(before)
            for i, (n, removed, digest) in zip(ids, plain.substring([before[i].text for i in ids])):
                assert plain.hashlib.sha256(" ".join(plain.words(after[i].text)).encode()).hexdigest() == digest
                assert after[i].n_chars == len(after[i].text)
        if name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert set(after) == {i for i, r in before.items() if not plain.contaminated(r.text, items)[-1]}
            assert 20 in before and 20 not in after
    again = corpus_pipeline.run(spark, folder)
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in again.collect()} == {(r.doc_id, r.piece, r.ids_crc32) for r in rows}


def test_pipeline_over_an_empty_table(spark, empty, folder, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered_with_all_operators():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and [n for n in names if n.startswith("op")].__len__() == 13
    assert set(e.oracle_sql()) <= set(names)
    assert packing.CAPACITY == 2048 and F.lit(1) is not None
