"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from quoin.lineage import cut
from quoin.llm import htmltext, matroska, mixing, pieces, pii, quotes, simhash, toxicity, urlfilter, vectors

CLASH = ("id", "key", "fp", "component", "node", "n", "score", "label", "block", "index", "size", "url2", "spans")


def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(1) for c in CLASH})


ROWS = [
    (1, "Some plain words in a row here", "en", "a", 1),
    (1, "Some plain words in a row here", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (None, "orphan text without an id", "en", None, 3),
    (4, "   \n\t ", "en", "b", 1),
    (5, "very long " * 30_000, "en", "a", 300_000),
    (6, "x", "en", "c", 1),
]
OPERATORS = {
    "matroska": matroska.digests,
    "simhash": simhash.near_duplicates,
    "pii": pii.find,
    "mixing": lambda d: mixing.taken(mixing.mix(d.select("doc_id", "source", "text"))),
    "pieces": lambda d: pieces.encode(d, decoded=True),
    "one_of_each": simhash.one_of_each,
    "mask": pii.mask,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_in_rows_out(spark, name):
    out = OPERATORS[name](docs(spark, ROWS))
    n = out.count()
    assert n == (len(ROWS) - 3 if name == "one_of_each" else len(ROWS))
    assert OPERATORS[name](docs(spark, ROWS).limit(0)).count() == 0


def test_equal_texts_equal_values(spark):
    got = matroska.digests(docs(spark, ROWS)).collect()
    by = {}
    for r in got:
        by.setdefault(r.payload_sha256, set()).add(r[1:])
    assert all(len(v) == 1 for v in by.values())
    empty = [r for r in got if r.doc_id in (2, 3)]
    assert {r.n_bytes for r in empty} == {0} and {r.payload_bytes for r in empty} == {576}


def test_simhash_of_nothing_is_zero_and_linked(spark):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, ROWS)).collect()}
    assert {(d, "0" * 16, 2) for d in (2, 3, 4)} <= got
    assert any(d is None for d, _, _ in got)


def test_toxicity_edges(spark):
    rows = [(i, ("vile rotten words " if i % 3 == 0 else "calm kind words ") + f"number{i}", "en", "a", 1) for i in range(200)] + ROWS
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)] + [(None, 1, 1), (3, None, None), (0, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(cut(toxicity.labelled(docs(spark, rows), labels)))
    out = toxicity.score(docs(spark, rows), model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.predicted for r in out}
    assert by[9] == 1 and by[10] == 0 and by[2] == 0
    none = toxicity.fit(cut(toxicity.labelled(docs(spark, rows), labels.limit(0))))
    assert {r.predicted for r in toxicity.score(docs(spark, rows), none).collect()} == {0}
    assert toxicity.without_toxic(docs(spark, rows).limit(0), model).count() == 0


def test_pages(spark):
    rows = [(1, "http://A.example.com/x", "<article><p>One<p>Two</article>"), (2, None, None), (None, "", ""), (1, "http://A.example.com/x", "<p>cut &am"), (3, "no scheme", "<" * 2000), (4, "x://h?://b", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in CLASH})
    out = htmltext.main_texts(df).collect()
    assert len(out) == len(rows) and out[0].text == "One\nTwo" and out[0].n_chars == 7 and out[1].text == ""
    judged = urlfilter.judge(df).collect()
    assert len(judged) == len(rows)
    by = {(r.page_id, r.host): r for r in judged}
    assert by[1, "a.example.com"].rule == "com/" and by[2, ""].verdict == "block" and by[4, "h"].path == ""
    assert htmltext.main_texts(df.limit(0)).count() == 0 and urlfilter.judge(df.limit(0)).count() == 0


def test_vectors_edges(spark):
    v = [0.1 * i for i in range(1, 9)]
    rows = [(1, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0] * 8, 1), (7, [float("nan")] + v[1:], 1), (8, [None] + v[1:], 1), (9, [], 1), (None, v, 1), (2, v, 1), (10, v[:4], 1), (11, [-x for x in v], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)).withColumn("rid", F.lit(1))
    out = {}
    for r in vectors.near_duplicates(df).collect():
        out.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert out[1] == [(2, 1, True)] and out[2] == [(2, 1, False)] * 2
    assert all(out[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert out[None] == [(0, None, False)]
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_conversations_edges(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi there"), (1, 1, "assistant", "> hi  there\nHello"), (None, None, None, None), (1, 1, "assistant", "> hi  there\nHello")], "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in CLASH})
    out = quotes.link(df).collect()
    assert len(out) == 4 and [(r.reply_to, r.content, r.depth) for r in out if r.turn == 1] == [(0, "Hello", 1)] * 2
    assert quotes.link(df.limit(0)).count() == 0
