"""The registered queries opN_<name>: each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.lineage import cut, small_batches
from quoin.llm import codes, decontaminate, htmltext, matroska, merkle, mixing, pieces, pii, quotes, simhash, toxicity, urlfilter, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.packed(cut(toxicity.labelled(docs, table(spark, folder, "labels"))))
    return toxicity.score(docs, model)


def op2_matroska(spark: SparkSession, folder: str) -> DataFrame:
    return matroska.digests(table(spark, folder, "documents"))


def op3_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), words=3, radius=3)


def op5_html(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.main_texts(table(spark, folder, "pages"))


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents"))


def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    back = pieces.encode(table(spark, folder, "documents"), decoded=True)
    return back.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.lower(F.hex(F.xxhash64("ids"))).alias("ids_hash"), F.sha2("text", 256).alias("decoded_sha256"))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urlfilter.judge(table(spark, folder, "pages"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, folder, "documents").select("doc_id", "source", "text")))


def op10_quotes(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.link(table(spark, folder, "conversations"))


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.document_manifest(table(spark, folder, "documents"))


def op12_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("items")


def op13_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.compressed(table(spark, folder, "embeddings"))


def quoted_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """op10's linking over conversations whose messages quote those before them; the given ones hold no quoted line."""
    return quotes.link(quotes.with_quotations(table(spark, folder, "conversations")))


def built_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """The same, put together: the conversations in the order of replies, without quotes."""
    return quotes.built(quoted_conversations(spark, folder))


QUERIES["op1_toxicity"] = op1_toxicity
QUERIES["op2_matroska"] = op2_matroska
QUERIES["op3_vectors"] = op3_vectors
QUERIES["op4_simhash"] = op4_simhash
QUERIES["op5_html"] = op5_html
QUERIES["op6_pii"] = op6_pii
QUERIES["op7_sentencepiece"] = op7_sentencepiece
QUERIES["op8_url_filter"] = op8_url_filter
QUERIES["op9_mixing"] = op9_mixing
QUERIES["op10_quotes"] = op10_quotes
ORACLES["op10_quotes"] = quotes.ORACLE
QUERIES["op11_merkle"] = op11_merkle
ORACLES["op11_merkle"] = merkle.oracle()
QUERIES["op12_decontaminate"] = op12_decontaminate
ORACLES["op12_decontaminate"] = decontaminate.ORACLE
QUERIES["op13_codes"] = op13_codes
ORACLES["op13_codes"] = codes.oracle()
QUERIES["quoted_conversations"] = quoted_conversations
ORACLES["quoted_conversations"] = quotes.quoted_oracle()
QUERIES["built_conversations"] = built_conversations
ORACLES["built_conversations"] = f"WITH linked AS ({quotes.quoted_oracle()}), own AS (SELECT DISTINCT conv_id, position // 1000 AS part, position, rendered FROM linked WHERE position IS NOT NULL AND content <> '') SELECT conv_id, part, min(position) AS first, CAST(count(*) AS INTEGER) AS messages, string_agg(rendered, '' ORDER BY position, rendered) AS text FROM own GROUP BY conv_id, part"


# What of the operators above SQL can express, as queries of their own with oracles.


def payload_digests(spark: SparkSession, folder: str) -> DataFrame:
    """op2's lengths and digests of what is read back from the stored form."""
    return op2_matroska(spark, folder).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def personal_counts(spark: SparkSession, folder: str) -> DataFrame:
    """op6's counts of base spans."""
    return op6_pii(spark, folder).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """op8's hosts, paths and rules, and the verdicts of URLs that a rule judges."""
    return op8_url_filter(spark, folder).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def mix_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """op9's sizes of documents and sources, and whether a source's words taken are its target to a word."""
    return op9_mixing(spark, folder).select("doc_id", "size", "source_size", (F.col("taken") <= 3 * F.col("size")).alias("within"))


def mix_totals(spark: SparkSession, folder: str) -> DataFrame:
    """op9's words taken by source size and target: the target rounded."""
    taken_ = op9_mixing(spark, folder).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("rows"))
    return taken_.select("source_size", "rows", (F.abs(F.col("taken") - F.col("target")) <= 1).alias("met"))


QUERIES |= {"payload_digests": payload_digests, "personal_counts": personal_counts, "url_rules": url_rules, "mix_sizes": mix_sizes, "mix_totals": mix_totals}
_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
_MATCHES = lambda pattern: f"regexp_extract_all(t, '{pattern}')"
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_DIGIT = f"CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER)"
ORACLES |= {
    "payload_digests": "WITH e AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), p AS (SELECT doc_id, b, octet_length(b) AS n, greatest(576, (octet_length(b) + 575) // 576 * 576) AS m FROM e) SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(m AS BIGINT) AS payload_bytes, sha256(b || unhex(repeat('FF', CAST(m - n AS BIGINT)))) AS payload_sha256 FROM p",
    "personal_counts": "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, CAST(len("
    + _MATCHES(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    + ") AS BIGINT) AS n_email, CAST(len(list_filter("
    + _MATCHES(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
    + r", lambda x: regexp_full_match(x, '0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}'))) AS BIGINT) AS n_ip, CAST(len(list_filter("
    + _MATCHES(r"[0-9](?:[\x20-]?[0-9])+")
    + f", lambda x: length({_DIGITS}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {_DIGIT} WHEN {_DIGIT} > 4 THEN 2 * {_DIGIT} - 9 ELSE 2 * {_DIGIT} END)) % 10 = 0)) AS BIGINT) AS n_card, CAST(len(list_filter("
    + _MATCHES(r"\+[0-9][\x20().0-9-]+[0-9]")
    + f", lambda x: length({_DIGITS}) BETWEEN 8 AND 15)) AS BIGINT) AS n_phone FROM d",
    "url_rules": "WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages), h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r), q AS (SELECT *, CASE "
    + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(urlfilter.RULES, key=lambda r: -len(r[0]) - len(r[1])))
    + " END AS rule FROM h) SELECT page_id, host, path, rule, CASE rule "
    + " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in urlfilter.RULES)
    + " END AS ruled FROM q",
    "mix_sizes": f"SELECT doc_id, CAST({_WORDS} AS BIGINT) AS size, CAST(sum({_WORDS}) OVER (PARTITION BY source) AS BIGINT) AS source_size, true AS within FROM documents",
    "mix_totals": f"SELECT CAST(sum({_WORDS}) AS BIGINT) AS source_size, count(*) AS rows, true AS met FROM documents GROUP BY source",
}
