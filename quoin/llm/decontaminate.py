"""Benchmark decontamination by a prefix-filtered join of shingles. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.lineage import cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, BETWEEN), "")


def _shingles(words: str, k: int) -> Column:
    """The hash of the k words from each place on."""
    here = lambda i: F.xxhash64(*(F.get(F.col(words), i + j) for j in range(k)))
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), here)).otherwise(F.array().cast("array<long>"))


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(window, words, k, items): each distinct window of the items, the words of its shingles, and the ids of the items that hold it.

    A window is window consecutive words; an item of fewer, but not none, is one window, and of
    fewer than shingle words is one shingle. Repeated windows are one row. Null ids aren't among items.
    """
    own = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    spread = own.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, window))).alias("words"))
    # a window that very many items share is first reduced in its own tasks
    grouped = spread.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return grouped.select(F.xxhash64("words").alias("window"), "words", F.least(F.size("words"), F.lit(shingle)).alias("k"), "items")


def _in_parts(rows: DataFrame, size: Column, key: str, most: int) -> list[DataFrame]:
    """rows, to be broadcast: in parts of about most bytes each, dealt by key."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    n = -(-int(total) // most)
    return [rows.where(F.pmod(F.hash(key), F.lit(n)) == i) for i in range(n)]


def _places(docs: DataFrame, keys: list[str], k: int, *kept: str) -> DataFrame:
    """Each shingle of k words of docs as (keys, place, shingle), and kept columns."""
    return docs.select(*keys, *kept, F.posexplode(_shingles("words", k)).alias("place", "shingle"))


def prefixes(docs: DataFrame, windows: DataFrame, least: float = 1.0, most: int = BROADCAST_BYTES) -> DataFrame:
    """windows by the shingles that a text with share least of a window's shingles can't all lack: (window, words, k, need, offset, shingle).

    The shingles of a window are ordered by how often the texts have them, rarest first (ties by
    hash and place). Of n, ceil(least n) are needed, so one of the first n - needed + 1 must be there.
    """
    apart = windows.withColumn("shingles", F.when(F.col("k") == 1, _shingles("words", 1)).when(F.col("k") == 2, _shingles("words", 2)).otherwise(_shingles("words", SHINGLE)))
    known = cut(apart.select("k", F.explode("shingles").alias("shingle")).distinct())
    counts = None
    for row in known.select("k").distinct().orderBy("k").collect():  # at most SHINGLE rows
        for part in _in_parts(known.where(F.col("k") == row["k"]).select("shingle"), F.lit(16), "shingle", most):
            met = _places(docs, [], row["k"]).join(F.broadcast(part), "shingle").groupBy("shingle").agg(F.count("*").alias("n")).withColumn("k", F.lit(row["k"]))
            counts = met if counts is None else counts.unionByName(met)
    if counts is None:
        return apart.select("window", "words", "k", F.lit(0).alias("need"), F.lit(0).alias("offset"), F.lit(0).cast("long").alias("shingle")).limit(0)
    single = apart.select("window", "words", "k", F.size("shingles").alias("size"), F.posexplode("shingles").alias("offset", "shingle"))
    # a shingle that no text has is the rarest: such a window is left out by the join below
    ranked = single.join(counts, ["k", "shingle"], "left").groupBy("window", "words", "k", "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset"))).alias("order"))
    need = F.ceil(F.col("size") * F.lit(float(least)) - 1e-9).cast("int")
    first = ranked.withColumn("need", F.greatest(need, F.lit(1))).withColumn("first", F.slice("order", 1, F.col("size") - F.col("need") + 1))
    return first.select("window", "words", "k", "need", F.explode("first").alias("p")).where("p.n > 0").select("window", "words", "k", "need", F.col("p.offset").alias("offset"), F.col("p.shingle").alias("shingle"))


def occurrences(docs: DataFrame, keys: list[str], windows: DataFrame, least: float = 1.0, most: int = BROADCAST_BYTES) -> DataFrame:
    """(keys, window, start, length): where docs (keys, words) hold a window, or the share least of its shingles in their places.

    The texts' shingles meet the windows' prefixes in the texts' own tasks; a window's place in the
    text follows from the shingle's in both, it must lie within the text's first and last word, and its words
    are compared there, hashes only find them. Prefixes are broadcast in parts of at most about
    most bytes, a pass over the texts each, so texts are never moved.
    """
    first = cut(prefixes(docs, windows, least, most))
    out = None
    for row in first.select("k").distinct().orderBy("k").collect():  # at most SHINGLE rows
        k = row["k"]
        own = first.where(F.col("k") == k).select(F.col("words").alias("own"), "window", "need", "offset", "shingle")
        for part in _in_parts(own, F.length(F.array_join("own", " ")) + 100, "window", most):
            within = "place >= offset and place - offset + size(own) <= size(words)"
            if least >= 1:
                same = "slice(words, place - offset + 1, size(own)) = own"
            else:
                each = " and ".join(f"get(words, place - offset + i + {j}) = get(own, i + {j})" for j in range(k))
                same = f"size(filter(sequence(0, size(own) - {k}), i -> {each})) >= need"
            met = _places(docs, keys, k, "words").join(F.broadcast(part), "shingle").where(within).where(same).select(*keys, "window", (F.col("place") - F.col("offset")).alias("start"), F.size("own").alias("length"))
            out = met if out is None else out.unionByName(met)
    if out is None:
        out = docs.select(*keys, F.lit(0).cast("long").alias("window"), F.lit(0).alias("start"), F.lit(0).alias("length")).limit(0)
    # with several prefixes a window is met once by each that it has
    return out if least >= 1 else out.distinct()


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = 1.0, window: int = WINDOW, most: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of docs: its id, n_words, n_hit (words inside an occurrence of a window), n_items (items with one), items_sha256, contaminated, and items.

    An occurrence of a window of an item has all of its shingles in their places; with least below 1
    that share of them. Ids of items are written as strings, sorted and joined by commas.

    Null and empty texts have no words and are clean; null items and items without words hit nothing;
    words hit by an item without an id count, but it isn't listed. Rows of equal id and text get equal
    results, each its own row; ids may be null or repeat. A window that stands in one text very often, and a text
    of any length, is met place by place. Empty tables give no rows, or rows without hits. Other columns
    are ignored, whatever their names.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = own.select("id", F.xxhash64(F.lit(1), "id", "text").alias("k1"), F.xxhash64(F.lit(2), "text", "id").alias("k2"), "text")
    every = cut(windows_of(items, item_col, item_text, window))
    met = occurrences(own.select("k1", "k2", words_of(F.col("text")).alias("words")), ["k1", "k2"], every, least, most)
    # per text and window first, in the tasks that found them; a place is one number: start and length
    spans = met.groupBy("k1", "k2", "window").agg(F.collect_set(F.col("start").cast("long") * (window + 1) + F.col("length")).alias("spans"))
    named = spans.join(every.select("window", "items"), "window")
    end = lambda x: F.floor(x / (window + 1)) + x % (window + 1)
    begin = lambda x: F.floor(x / (window + 1))
    zero = F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["to"], end(x)).alias("to"), (s["n"] + F.greatest(F.lit(0).cast("long"), end(x) - F.greatest(s["to"], begin(x)))).alias("n"))
    per = named.groupBy("k1", "k2").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hit = per.select("k1", "k2", F.aggregate("spans", zero, step, lambda s: s["n"]).alias("hit"), "items")
    light = own.select("id", "k1", "k2", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return light.join(hit, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), listed.alias("items")
    )


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
w AS (SELECT DISTINCT item, array_to_string(ws[s:s + {WINDOW - 1}], ' ') AS grams, least(len(ws), {WINDOW}) AS size FROM i, LATERAL unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS u(s) WHERE len(ws) > 0),
p AS (SELECT r, s, z.size, array_to_string(ws[s:s + z.size - 1], ' ') AS grams FROM d, (SELECT DISTINCT size FROM w) AS z, LATERAL unnest(range(1, len(ws) - z.size + 2)) AS u(s)),
o AS (SELECT p.r, p.s, p.size, w.item FROM p JOIN w ON p.grams = w.grams AND p.size = w.size),
h AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT DISTINCT r, s, size FROM o), LATERAL unnest(range(s, s + size)) AS u(x) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM o WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
