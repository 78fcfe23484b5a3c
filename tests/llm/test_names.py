"""Columns of the caller whose names are an operator's own stay as they are."""

from pyspark.sql import functions as F

from quoin.llm import mixing, pii, simhash

NAMES = ("token", "node", "nd_node", "nd_key", "nd_group", "nd_wins", "pii_email", "pii_loose", "pii_all", "mix_size", "mix_row", "mix_text", "given_0", "best")


def test_clashing_names(spark):
    rows = [(1, "write to jo@example.com or to al@example.com today please"), (2, "write to jo@example.com or to al@example.com today please"), (2, "write to jo@example.com or to al@example.com today please"), (3, "another text of some words without any address"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in NAMES}).withColumn("source", F.lit("a"))
    kept = simhash.one_of_each(docs, words=5, least=0.8)
    masked = pii.mask(kept)
    mixed = mixing.shuffled(mixing.mix(masked), docs.columns)
    for out in (kept, masked, mixed):
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[n] == f"{n} of {r.doc_id}" for n in NAMES)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert texts == {1: "write to [EMAIL] or to [EMAIL] today please", 3: rows[3][1], 4: None}
