"""The pipeline's stages against plain versions, and its queries' contract."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quoin.llm import mixing, queries, toxicity
from quoin.lineage import cut


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "pii", "mixing", "sentencepiece"]
    numbers = sorted(int(m[1]) for k in queries.QUERIES if (m := re.match(r"op([0-9]+)_", k)))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    model = toxicity.fit(cut(toxicity.labelled(docs, spark.read.parquet(f"{folder}/labels.parquet"))))
    bad = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    clean = cut(corpus_pipeline.drop_toxic(spark, docs, folder))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad and clean.columns == columns
    single = cut(corpus_pipeline.drop_near_copies(spark, clean, folder))
    ids = [r.doc_id for r in single.collect()]
    assert len(ids) == len(set(ids)) and single.columns == columns
    masked = cut(corpus_pipeline.mask_personal_data(spark, single, folder))
    assert masked.count() == single.count() and masked.where("n_chars <> length(text)").count() == 0
    mixed = cut(corpus_pipeline.mix_sources(spark, masked, folder))
    assert mixed.columns == columns
    sizes = {r.source: r.n for r in masked.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()}
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()}
    for source, goal in mixing.targets(sizes).items():
        assert abs(got.get(source, 0) - goal) <= 1
    whole = {r.text for r in masked.collect()}
    assert sum(r.text not in whole for r in mixed.collect()) <= len(sizes)
    out = corpus_pipeline.encode_pieces(spark, mixed, folder)
    assert out.count() == mixed.count()


def test_run_writes_to_the_shared_folder(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "n_tokens", "ids"]


def test_stages_on_odd_rows(spark, tmp_path):
    rows = [(1, "one two three four five six", "en", "a", 1), (1, "one two three four five six", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "text without an id", "en", None, 3), (4, "x", "en", "c", 1), (5, "word " * 30_000, "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.withColumns({c: F.lit(1) for c in ("id", "node", "component", "key", "index", "words", "size", "place", "group", "n", "epoch", "draw", "label")})
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, clash, docs.limit(0), clash.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            if name != "sentencepiece":
                assert out.columns == table.columns
            n = out.count()
            assert n <= 3 * table.count() and (n > 0) == (table.count() > 0)
