"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.lineage import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 8192
BLOCKS_PER_BUCKET = 64
ROWS_PER_BUCKET = 250_000
GROUP = 4096
STRETCH = 1024
WIDTH = 4096
SHARDS = 64
SLICE_DRAWS = 2048
MOST_SOURCES = 10_000
_URN = 10**9


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Each source's target: weights repeat over the sources by code point, null last, and share all words.

    A target stops at most times its source's size; the excess is shared anew by weight until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, open_, out = float(sum(sizes.values())), list(order), {}
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            rest -= out[s]
        open_ = [s for s in open_ if s not in set(over)]
    return out


def _drawn(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good ones: a hypergeometric number.

    The library draws from fewer than 10^9 things. For larger urns the same law is inverted: chances
    relative to the mode's follow from the ratios of neighbouring ones, twelve standard deviations to
    each side (what lies beyond is less than a double can tell from nothing).
    """
    if n == 0 or good == 0 or bad == 0:
        return n if bad == 0 else 0
    total = good + bad
    if total < _URN:
        return int(rng.hypergeometric(good, bad, n))
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = 20 + int(12 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1))))
    k = np.arange(max(0, n - bad, mode - reach), min(good, n, mode + reach) + 1, dtype=np.int64)
    x = k[:-1].astype(np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log((good - x) / (x + 1)) + np.log((n - x) / (float(bad - n) + x + 1)))])
    chance = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(len(k) - 1, int(np.searchsorted(chance, rng.random() * chance[-1], side="right")))])


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Draw counts (source, shard) whose sums are the quotas and whose shards are equal to within one draw.

    The root holds all quotas; each node deals a multivariate-hypergeometric share to its left half
    of the shards, source by source, and the rest to its right half. No quotas give no rows.
    """
    out = np.zeros((len(quotas), shards), object)
    rng = np.random.Generator(np.random.PCG64(seed))

    def split(counts: list[int], first: int, width: int) -> None:
        if width == 1:
            out[:, first] = counts
            return
        left, rest = width // 2, sum(counts)
        n, mine = rest * left // width, []
        for c in counts:
            rest -= c
            mine.append(_drawn(rng, c, rest, n))
            n -= mine[-1]
        split(mine, first, left)
        split([c - m for c, m in zip(counts, mine, strict=True)], first + left, width - left)

    if len(quotas):
        split([int(q) for q in quotas], 0, shards)
    return out.astype(np.int64)


@dataclass
class Mix:
    """plan: a row per source; quotas: a row per source and epoch, with the blocks of each shard; draws: a row per block drawn; laid: a row per input row, with its keys, block and words; docs: the input in one column, with its keys."""

    plan: DataFrame
    quotas: DataFrame
    draws: DataFrame
    laid: DataFrame
    docs: DataFrame
    shards: int
    slices: int


def _running(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """rows (one per keys and order) with the sum of value over the rows of smaller order of the same keys.

    In two steps, over stretches of WIDTH orders and within each, so that no task holds all rows of a key.
    """
    rows = rows.withColumn("mix_stretch", F.floor(F.col(order) / F.lit(WIDTH)).cast("long"))
    whole = Window.partitionBy(*keys).orderBy("mix_stretch")
    part = Window.partitionBy(*keys, "mix_stretch").orderBy(order)
    before = rows.groupBy(*keys, "mix_stretch").agg(F.sum(value).alias("mix_all")).withColumn("mix_ahead", F.sum("mix_all").over(whole) - F.col("mix_all")).drop("mix_all")
    return rows.withColumn(name, F.sum(value).over(part) - F.col(value)).join(before, [*keys, "mix_stretch"]).withColumn(name, F.col(name) + F.col("mix_ahead")).drop("mix_stretch", "mix_ahead")


def _epochs(sizes: list[int], goals: list[float], counts: list[int], shards: int, seed: int) -> list[tuple]:
    """(source, epoch, blocks, words wanted, pool ends by shard, quotas by shard) of each epoch of each source.

    A source's epochs draw all its blocks, but for the last, which draws as many as its words are in
    proportion. One splitting tree deals the quotas of all epochs to the shards; a second deals the
    blocks that an epoch leaves over, so that each shard has a pool of its own to draw from.
    """
    epochs = []
    for i, (size, goal, n) in enumerate(zip(sizes, goals, counts, strict=True)):
        for e in range(MOST if n else 0):
            wanted = min(int(round(goal)) - e * size, size)
            if wanted > 0:
                epochs.append((i, e, n, wanted, n if wanted == size else min(n, max(1, round(n * wanted / size)))))
    quotas = splitting_tree([q for *_, q in epochs], shards, seed)
    spare = splitting_tree([n - q for _, _, n, _, q in epochs], shards, seed + 1)
    return [(i, e, n, wanted, np.cumsum(quotas[j] + spare[j]).tolist(), quotas[j].tolist()) for j, (i, e, n, wanted, _) in enumerate(epochs)]


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17, shards: int = SHARDS, block_words: int = BLOCK_WORDS) -> Mix:
    """Plan a mix of all rows of docs.

    Each source's documents are put in hashed order into blocks of about block_words words (a block
    ends at a document's end), each block belonging to a hashed bucket of its source so that a hot
    source, or one of many empty texts, is spread over many tasks. A source is drawn in epochs, whole
    ones and a last one of a part of its blocks. A splitting tree deals the block quotas of all
    epochs to the output shards. An epoch's blocks are permuted and lie in disjoint pools, one per
    shard, and each shard draws the first blocks of its pool, as many as its quota. As blocks differ
    in words, the last epoch's draws are then cut, or extended by further blocks of the pools
    (mix_extra), in turns over the shards, until the words are the target rounded to a word; one
    document at most loses a part. Inside a shard the order is by hash.
    The order is by a hash of the whole row (columns of maps aside), so reruns give the same draws
    whatever ids repeat; rows equal in all columns are interchangeable.

    Null texts have no words, sources may be null (last in order), null and repeated ids are
    allowed, rows without words are never drawn, and an empty table gives empty results; columns
    may have any names. The driver holds a row per source and shard: over MOST_SOURCES sources are
    an error. Texts are read once to count words and not moved.
    """
    spark = docs.sparkSession
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"), F.xxhash64(F.lit(seed).cast("long"), *hashed).alias("mix_k1"), F.xxhash64(F.lit(-seed - 1).cast("long"), *hashed).alias("mix_k2"))
    field = F.col("mix_row").getField
    size = F.coalesce(F.regexp_count(field(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    light = cut(docs.select(field(id_col).alias("mix_id"), field(source_col).alias("mix_name"), size.alias("mix_size"), "mix_k1", "mix_k2"))
    found = light.groupBy("mix_name").agg(F.sum("mix_size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources: mix by a coarser column")
    sizes = {r["mix_name"]: r["size"] for r in found}
    goals = targets(sizes)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    many = {r["mix_name"]: max(1, -(-r["size"] // (block_words * BLOCKS_PER_BUCKET)), -(-r["n"] // ROWS_PER_BUCKET)) for r in found}
    rows = [(i, s, sizes[s], goals[s], many[s]) for i, s in enumerate(order)]
    plan = spark.createDataFrame(rows, "mix_source int, source string, source_size long, target double, mix_buckets long")
    # a row per source, which the driver holds already
    own = F.broadcast(plan.select("mix_source", F.col("source").alias("mix_of"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), "mix_buckets"))
    by_bucket = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_k1", "mix_k2", "mix_size")
    laid = (
        light.join(own, F.col("mix_name").eqNullSafe(F.col("mix_of")))
        .withColumn("mix_bucket", F.pmod(F.xxhash64("mix_k1"), "mix_buckets"))
        .withColumn("mix_start", F.coalesce(F.sum("mix_size").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("mix_block", F.floor(F.col("mix_start") / block_words))
        .drop("mix_name", "mix_of", "mix_buckets")
    )
    laid = cut(laid.withColumn("mix_offset", F.col("mix_start") - F.min("mix_start").over(Window.partitionBy("mix_source", "mix_bucket", "mix_block"))))
    blocks = cut(laid.where("mix_size > 0").groupBy("mix_source", "mix_bucket", "mix_block").agg(F.sum("mix_size").alias("words")))
    counts = {r["mix_source"]: r["n"] for r in blocks.groupBy("mix_source").agg(F.count("*").alias("n")).collect()}
    epochs = _epochs([r[2] for r in rows], [r[3] for r in rows], [counts.get(r[0], 0) for r in rows], shards, seed)
    quotas = spark.createDataFrame(epochs, "mix_source int, mix_epoch int, n long, wanted long, upto array<long>, quota array<long>")

    key = ["mix_source", "mix_epoch"]
    permuted = (
        blocks.join(F.broadcast(quotas), "mix_source")  # at most three rows per source
        .withColumn("h", F.xxhash64(F.lit(seed).cast("long"), *key, "mix_bucket", "mix_block"))
        .withColumn("stretch", F.expr(f"shiftright(shiftrightunsigned(h, 32) * ((n + {STRETCH - 1}) div {STRETCH}), 32)"))
    )
    sizes_before = _running(permuted.groupBy(*key, "stretch").agg(F.count("*").alias("in_stretch")), key, "stretch", "in_stretch", "stretch_before").drop("in_stretch")
    in_stretch = Window.partitionBy(*key, "stretch").orderBy("h", "mix_bucket", "mix_block")
    pooled = (
        permuted.withColumn("rank", F.row_number().over(in_stretch) - 1)
        .join(sizes_before, [*key, "stretch"])
        .withColumn("place", F.col("stretch_before") + F.col("rank"))
        .withColumn("mix_shard", F.expr("cast(size(filter(upto, x -> x <= place)) as int)"))
        .withColumn("turn", F.expr("place - if(mix_shard = 0, 0, upto[mix_shard - 1])"))
        .withColumn("own", F.expr("quota[mix_shard]"))
        .withColumn("mix_extra", F.expr("turn >= own"))
        .withColumn("turn", F.expr("if(mix_extra, turn - own, turn)"))
        .withColumn("group", F.expr(f"if(mix_extra, 1L << 40, 0L) + turn div {max(1, GROUP // shards)}"))
        .select(*key, "mix_bucket", "mix_block", "mix_shard", "mix_extra", "turn", "group", "wanted", "words")
    )
    pooled = cut(pooled)
    sums = _running(pooled.groupBy(*key, "group").agg(F.sum("words").alias("w")), key, "group", "w", "group_before").drop("w")
    in_group = Window.partitionBy(*key, "group").orderBy("turn", "mix_shard")
    draws = (
        pooled.join(sums, [*key, "group"])
        .withColumn("rest", F.col("wanted") - F.col("group_before") - (F.sum("words").over(in_group) - F.col("words")))
        .where("not mix_extra or rest > 0")
        .withColumn("mix_words", F.expr("greatest(0L, least(words, rest))"))
        .withColumn("mix_order", F.xxhash64(F.lit(seed).cast("long"), "mix_shard", *key, "mix_bucket", "mix_block"))
        .select(*key, "mix_bucket", "mix_block", "mix_shard", "mix_extra", F.col("words").alias("mix_block_words"), "mix_words", "mix_order")
    )
    slices = max(1, -(-sum(sum(q) for *_, q in epochs) // (shards * SLICE_DRAWS)))
    return Mix(plan.drop("mix_buckets", "mix_source"), quotas, cut(draws), laid, docs, shards, slices)


def _with_draws(m: Mix) -> DataFrame:
    """laid, each row with its block's draws; a bucket's few blocks travel as one array, so rows are not dealt out again."""
    per_bucket = m.draws.where("mix_words > 0").groupBy("mix_source", "mix_bucket").agg(F.collect_list(F.struct("mix_block", "mix_epoch", "mix_shard", "mix_order", "mix_words")).alias("mix_all"))
    mine = F.expr("filter(coalesce(mix_all, array()), d -> d.mix_block = mix_block and mix_size > 0 and d.mix_words > mix_offset)")
    return m.laid.join(per_bucket, ["mix_source", "mix_bucket"], "left").withColumn("mix_mine", mine).drop("mix_all")


def taken(m: Mix, id_col: str = "doc_id") -> DataFrame:
    """Per input row: id, size, source_size, target, taken (the words of it that the mix draws, repeats counted) and shards (those that draw it, ascending, comma-joined, repeats counted).

    Null and repeated ids stay, rows without words have taken 0 and no shards, and no rows give none.
    """
    words = F.expr("aggregate(mix_mine, 0L, (s, d) -> s + least(mix_size, d.mix_words - mix_offset))")
    shards = F.expr("array_join(array_sort(transform(mix_mine, d -> d.mix_shard)), ',')")
    return _with_draws(m).select(F.col("mix_id").alias(id_col), F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), words.alias("taken"), shards.alias("shards"))


def _drawn_rows(m: Mix, text_col: str) -> DataFrame:
    """mix_row once per draw, its text (cut, in the one document a source that the last draw cuts), mix_shard and mix_order."""
    key = ["mix_k1", "mix_k2"]
    repeated = cut(m.laid.groupBy(*key).agg(F.count("*").alias("mix_n")).where("mix_n > 1").select(*key))
    once = m.docs
    if not repeated.isEmpty():
        once = m.docs.join(repeated, key, "left_anti").select(*m.docs.columns).unionByName(m.docs.join(repeated, key, "left_semi").dropDuplicates(key).select(*m.docs.columns))
    rows = once.join(_with_draws(m).select(*key, "mix_size", "mix_offset", F.explode("mix_mine").alias("mix_d")), key).withColumn("mix_text", F.col("mix_row").getField(text_col))
    part = F.col("mix_d.mix_words") - F.col("mix_offset")
    cut_text = F.expr("array_join(slice(regexp_extract_all(mix_text, '[\\\\x20\\\\x09-\\\\x0D]*[^\\\\x20\\\\x09-\\\\x0D]+', 0), 1, cast(mix_d.mix_words - mix_offset as int)), '')")
    text = F.when(part < F.col("mix_size"), cut_text).otherwise(F.col("mix_text"))
    return rows.select("mix_row", text.alias("mix_text"), F.col("mix_d.mix_shard").alias("mix_shard"), F.xxhash64("mix_d.mix_order", *key).alias("mix_order"))


def _named(columns: list[str], text_col: str) -> list:
    return [(F.col("mix_text") if c == text_col else F.col("mix_row").getField(c)).alias(c) for c in columns]


def mixed_rows(m: Mix, columns: list[str], text_col: str = "text", shard: str = "mix_shard", order: str = "mix_order") -> DataFrame:
    """The mix itself: columns of docs once per draw, with the shard that draws the row and its place there; the one document of a source that the last draw cuts keeps its first words.

    Texts move once, to meet their draws by the row's two hashes. Rows equal in all columns count as
    often as they occur, null and repeated ids stay, rows without words are left out, and no rows give
    none. Columns may have any names; those of the shard and the order are parameters.
    """
    return _drawn_rows(m, text_col).select(*_named(columns, text_col), F.col("mix_shard").alias(shard), F.col("mix_order").alias(order))


def shuffled(m: Mix, columns: list[str], text_col: str = "text") -> DataFrame:
    """columns of mixed_rows in the mix's order: each partition holds whole slices of shards, sorted by shard and place, so files written from it are in that order.

    A shard has as many slices as it has thousands of blocks, so no task holds more than one whatever
    the table's size. Nulls, repeats and empty tables are as in mixed_rows.
    """
    rows = _drawn_rows(m, text_col).withColumn("mix_slice", F.expr(f"shiftright((shiftright(mix_order, 40) + {1 << 23}) * {m.slices}L, 24)"))
    return rows.repartition("mix_shard", "mix_slice").sortWithinPartitions("mix_shard", "mix_order").select(*_named(columns, text_col))
