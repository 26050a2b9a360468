"""The pipeline, stage by stage, against brute-force versions of the stages' decisions."""

import corpus_pipeline
import pyarrow as pa
from conftest import SF
from pyspark.sql import functions as F
from test_operators import WORD, brute_components, brute_secrets

from lexilake.llm import decontaminate, nbsvm
from lexilake.llm.shared import BATCH, BATCH_BYTES


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        a, b = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(b) <= set(a) and len(b) == out.count()
        if k < 4:
            assert out.columns == columns, name
        if k == 0:
            model = nbsvm.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(b) == {r.doc_id for r in nbsvm.score(before, model).collect() if r.score >= 0.3}
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert all(d in b for d in a if labels.get(d) == 1)
        elif k == 1:
            want = brute_components([(d, r.text) for d, r in a.items()], 5)
            assert set(b) == {d for d, (_, _, kept) in want.items() if kept}
        elif k == 2:
            found = decontaminate.overlaps(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert set(b) == set(a) - {r.doc_id for r in found.collect()}
        elif k == 3:
            assert set(b) == set(a)
            for d, r in b.items():
                assert r.n_chars == len(r.text or "") and not brute_secrets(r.text or "")
                if not brute_secrets(a[d].text or ""):
                    assert r.text == a[d].text or "[secret]" in r.text
        else:
            assert set(b) == set(a) and all(r["size"] == len(WORD.findall(a[d].text or "")) for d, r in b.items())
            assert out.columns == [*columns, "size", "source_size", "target", "taken"] and all(b[d].text == a[d].text for d in b)
        before = out
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, before.collect()))


def test_hard_rows(spark):
    """Nulls, repeated ids and further columns pass through the filtering stages."""
    rows = [(1, "a b c d e f g", "en", "s", 13, 1), (1, "a b c d e f g", "en", "s", 13, 2), (2, None, None, None, None, 3), (None, "x y z", "en", "s", 5, 4), (3, "a b c d e f g", "en", "s", 13, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gone_id int")
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.decontamination, corpus_pipeline.secrets):
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "gone_id"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect()) == [(False, 1), (False, 2), (True, 0)]
    assert corpus_pipeline.mixture(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES and corpus_pipeline.ORACLE_SQL is None


def test_rows_of_one_id_are_decided_by_text(spark):
    """Rows without an id stay whether or not an id repeats; a text of its own stays whatever its id's other rows are."""
    alike, near = [" ".join(f"w{i}" for i in range(k)) for k in (100, 102)]
    own, other = [" ".join(f"{c}{i}" for i in range(40)) for c in "xy"]
    rows = [(1, alike, 1), (5, alike, 2), (5, own, 3), (5, own, 4), (7, near, 5), (7, None, 6), (7, None, 7), (8, other, 8), (8, other.upper(), 9), (None, own, 10), (None, own, 11), (None, None, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag int")
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, (r.text or "").lower()) for r in out.collect())
    assert got == sorted([(1, alike), (5, own), (7, ""), (8, other), (0, own), (0, own), (0, "")])
    clash = docs.withColumnsRenamed({"tag": "_id"}).withColumn("_hash", F.lit(1)).withColumn("_row", F.lit("x"))
    out = corpus_pipeline.near_duplicates(spark, clash, SF)
    assert out.columns == clash.columns and sorted((r.doc_id or 0, (r.text or "").lower()) for r in out.collect()) == got
    assert sorted(r["_id"] for r in out.collect() if r.doc_id == 7) == [6]
    single = docs.where("tag IN (1, 5, 6, 10, 11, 12)").where("tag != 6")
    assert sorted(r.tag for r in corpus_pipeline.near_duplicates(spark, single, SF).collect()) == [1, 10, 11, 12]


def test_texts_go_to_python_in_bounded_batches(spark):
    """Each stage with Python bounds the bytes that a worker gets at once, whatever the number of rows; no row is lost by it."""

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.concat("id", F.repeat(F.lit(" word"), 400)).alias("text"))
    few = spark.createDataFrame([(1, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        for _, stage in corpus_pipeline.STAGES[:4]:
            spark.conf.unset(BATCH)
            stage(spark, few, SF)
            got = docs.mapInArrow(sizes, "n long, bytes long").collect()
            assert max(r.bytes for r in got) <= 1.25 * BATCH_BYTES < sum(r.bytes for r in got) / 4
            assert sum(r.n for r in got) == 6000
        spark.conf.set(BATCH, "1m")
        corpus_pipeline.secrets(spark, few, SF)
        assert spark.conf.get(BATCH) == "1m"
    finally:
        spark.conf.unset(BATCH)
