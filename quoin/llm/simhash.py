"""SimHash near-duplicates: exact tiled comparison of fingerprints."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.lineage import cut
from quoin.llm.columns import renamed
from quoin.operators.graph import components

SEED = 42
TILE = 4096
SEGMENTS = 4
_AT_ONCE = 255 * 1024


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (uint64) have each bit, the highest bit first."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    whole = len(bits) // 255 * 255
    out = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        out += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64 majority bits over the XXH64 hashes (seed 42) of a text's word shingles.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are joined by one space
    and count as often as they occur. A text with fewer words is one shingle; one without words (or
    null) has fingerprint 0. A bit is 1 if over half the hashes have it. Very long texts are hashed
    in slices of bounded size.
    """
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    line, take = b" ".join(parts), min(words, len(parts))
    ends = list(itertools.accumulate(len(p) + 1 for p in parts))
    total, sums, digest = len(parts) - take + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    starts = [0, *ends[:-1]]
    for at in range(0, total, _AT_ONCE):
        upto = min(total, at + _AT_ONCE)
        some = [digest(line[s : e - 1], SEED) for s, e in zip(starts[at:upto], ends[at + take - 1 : upto + take - 1], strict=True)]
        sums += _bit_sums(np.array(some, np.uint64))
    return int.from_bytes(np.packbits(sums * 2 > total).tobytes(), "big")


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The distinct XXH64 hashes of a text's word shingles, made as for fingerprint(); none without words."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    take = min(words, len(parts))
    line, ends = b" ".join(parts), list(itertools.accumulate(len(p) + 1 for p in parts))
    digest = xxhash.xxh64_intdigest
    some = [digest(line[s : e - 1], SEED) for s, e in zip([0, *ends[:-1]], ends[max(0, take - 1) :], strict=False)]
    return np.unique(np.array(some, np.uint64))


def _wide(hashes: np.ndarray) -> tuple[int, int]:
    """128 majority bits of distinct hashes, as two signed longs: of the hashes and of the hashes mixed again."""
    out = []
    for own in (hashes, (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)):
        sums = sum((_bit_sums(own[at : at + _AT_ONCE]) for at in range(0, len(own), _AT_ONCE)), np.zeros(64, np.int64))
        out.append(int.from_bytes(np.packbits(sums * 2 > max(1, len(own))).tobytes(), "big", signed=True))
    return out[0], out[1]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): each row's fingerprint as a signed long. Null and empty texts have 0; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the same components as left-right, at most one for each node."""
    nodes, flat = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = flat[: len(left)], flat[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _tile_edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, same = batch.column(0), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            v1, o1 = one.values.to_numpy().view(np.uint64), one.offsets.to_numpy()
            v2, o2 = two.values.to_numpy().view(np.uint64), two.offsets.to_numpy()
            lefts, rights = [], []
            for i in range(len(one)):
                x, y = v1[o1[i] : o1[i + 1]], v2[o2[i] : o2[i + 1]]
                found = []
                for at in range(0, len(x), 512):
                    p, q = np.nonzero(np.bitwise_count(x[at : at + 512, None] ^ y[None, :]) <= radius)
                    if same[i]:
                        keep = p + at < q
                        p, q = p[keep], q[keep]
                    if len(p):
                        found.append(_forest(x[at + p], y[q]))
                if found:
                    a, b = (np.concatenate(z) for z in zip(*found, strict=True))
                    a, b = _forest(a, b) if len(found) > 1 else (a, b)
                    lefts.append(a), rights.append(b)
            if lefts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (lefts, rights)], ["a", "b"])

    return run


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of segment population counts a pair within the radius can have, one of each two opposite ones."""
    span = range(-radius, radius + 1)
    zero = (0,) * SEGMENTS
    return [d for d in itertools.product(span, repeat=SEGMENTS) if sum(map(abs, d)) <= radius and d >= zero]


def fingerprint_edges(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) that connect exactly those distinct fingerprints fps.fp that a chain of pairs within radius bits connects.

    Fingerprints are laid in tiles by the population counts of their four 16-bit segments. The sum
    of the differences of these counts is a lower bound of the differing bits, so only tile pairs
    whose sum is at most the radius are compared (exclusive-or and bit counts); all others are
    skipped. A count vector with many fingerprints is cut into tiles of about 4,096 by a hash, so no
    task holds more than two such tiles at a time, and a tile pair yields a spanning forest of its
    links rather than all pairs. Null fingerprints take no part, repeated ones count once, an empty
    table gives no edges; other columns are ignored.
    """
    segment = [F.bit_count(F.shiftrightunsigned("fp", 16 * (SEGMENTS - 1 - k)).bitwiseAND(F.lit(0xFFFF))).cast("int") for k in range(SEGMENTS)]
    keyed = fps.where("fp is not null").select("fp").distinct().select("fp", F.array(*segment).alias("counts"))
    # at most 17^4 count vectors exist, so this table is bounded however many fingerprints there are
    sizes = keyed.groupBy("counts").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("n"))
    tiles = cut(
        keyed.join(F.broadcast(sizes), "counts")
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        .groupBy("counts", "chunk")
        .agg(F.collect_list("fp").alias("fps"))
    )
    offsets = F.array(*[F.array(*map(F.lit, d)) for d in _offsets(radius)])
    near = tiles.select(
        F.col("counts").alias("c1"),
        F.col("chunk").alias("k1"),
        F.col("fps").alias("one"),
        F.explode(F.transform(offsets, lambda d: F.zip_with("counts", d, lambda x, y: x + y))).alias("counts"),
    ).where(F.forall("counts", lambda x: x.between(0, 16)))
    pairs = near.join(tiles, "counts").where("c1 <> counts or k1 <= chunk")
    # the commonest count vectors have most tile pairs, so these are dealt out singly before they are compared
    dealt = pairs.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "c1", "k1", "counts", "chunk")
    lists = dealt.select("one", F.col("fps").alias("two"), (F.col("c1") == F.col("counts")) & (F.col("k1") == F.col("chunk")))
    return lists.mapInArrow(_tile_edges(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per row of docs.

    Fingerprints that differ in at most radius bits are linked; component_id is the smallest id
    reachable. Equal fingerprints are compared once, however many rows have them. Null and empty
    texts have fingerprint zero and are linked like any other. Rows with a null id keep a null id and
    take part; repeated ids give repeated rows; an empty table gives no rows; other columns of docs
    are ignored.
    """
    rows = cut(fingerprints(docs, id_col, text_col, words))
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("low")))
    found = components(fingerprint_edges(distinct, radius), "a", "b")
    group = distinct.join(found, distinct.fp == found.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    least = group.groupBy("component").agg(F.min("low").alias("component_id"))
    named = group.join(least, "component").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


WIDE_RADIUS = 20
HALF_RADIUS = 16
BLOCK = 512
BLOCK_SHINGLES = 500_000


def _wide_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [batch.column(i) for i in range(6)]
        values = [(x.values.to_numpy(), x.offsets.to_numpy()) for x in lists]
        same = batch.column(6).to_numpy(zero_copy_only=False)
        lefts, rights = [], []
        for i in range(batch.num_rows):
            n1, a1, b1, n2, a2, b2 = (v[o[i] : o[i + 1]] for v, o in values)
            a1, b1, a2, b2 = (x.view(np.uint64) for x in (a1, b1, a2, b2))
            found = []
            for at in range(0, len(a1), 512):
                p, q = np.nonzero(np.bitwise_count(a1[at : at + 512, None] ^ a2[None, :]) <= HALF_RADIUS)
                if same[i]:
                    keep = p + at < q
                    p, q = p[keep], q[keep]
                p = p + at
                close = np.bitwise_count(a1[p] ^ a2[q]) + np.bitwise_count(b1[p] ^ b2[q]) <= WIDE_RADIUS
                if close.any():
                    found.append(_forest(n1[p[close]], n2[q[close]]))
            if found:
                a, b = (np.concatenate(z) for z in zip(*found, strict=True))
                a, b = _forest(a, b) if len(found) > 1 else (a, b)
                lefts.append(a), rights.append(b)
        if lefts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (lefts, rights)], ["a", "b"])


def _similar(words: int, least: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        nodes, block = frame.node.to_numpy(), frame.block.to_numpy()
        hashes = [shingle_hashes(x, words) for x in frame.text]
        sizes = np.array([len(x) for x in hashes])
        flat = np.concatenate(hashes)
        owner = np.repeat(np.arange(len(frame)), sizes)
        _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        # rows of the first block against those of the second (all, where the tile is one block with itself)
        p, q = frame.p.iloc[0], frame.q.iloc[0]
        one, two = np.nonzero(block == p)[0], np.nonzero(block == q)[0]
        place = np.full((2, len(frame)), -1)
        place[0, one], place[1, two] = np.arange(len(one)), np.arange(len(two))
        both = np.zeros((len(one), len(two)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = int(column[-1]) + 1 if len(column) else 0
        for at in range(0, width, 4096):
            lo, hi = np.searchsorted(column, [at, at + 4096])
            parts = []
            for k, n in ((0, len(one)), (1, len(two))):
                mine = place[k, owner[lo:hi]] >= 0
                part = np.zeros((n, min(4096, width - at)), np.float32)
                part[place[k, owner[lo:hi][mine]], column[lo:hi][mine] - at] = 1
                parts.append(part)
            both += parts[0] @ parts[1].T
        linked = both >= least * (sizes[one][:, None] + sizes[two][None, :] - both)
        a, b = np.nonzero(linked)
        a, b = one[a], two[b]
        a, b = a[a != b], b[a != b]
        a, b = _forest(nodes[a], nodes[b]) if len(a) else (nodes[:0], nodes[:0])
        return pd.DataFrame({"a": a, "b": b})

    return run


SHARE = 8
STEPS = (2, 16, 128, 1024)
MOST_BITS = 27
SENT = 200_000
LIST = 4096
UNSKETCHED = 30_000
_SHORT = (1 << 40) - 1


def _common(texts: DataFrame, words: int) -> list[np.ndarray]:
    """Bit tables of the shingles that occur in over 2, 16, 128 and 1,024 of an eighth of the texts.

    They only order shingles, so a share of the texts does, and so does a table that false bits fill;
    the share is one of all texts, so lists of texts that share a rare shingle don't grow with the input.
    """
    some = texts.where(F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(SHARE)) == 0).dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(x.as_py(), words).view(np.int64))], ["token"])

    counted = cut(some.select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > STEPS[0]))
    return [_bit_table(counted.where(F.col("n") > step).select("token")) for step in STEPS]


def _set(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Whether each token's bit is set."""
    at = tokens.view(np.int64) & (len(bits) * 64 - 1)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def _rarest(hashes: np.ndarray, common: list[np.ndarray], least: float) -> np.ndarray:
    """The first of the hashes, in one order for all texts (rare ones first), so many that a text similar by least shares one of its own first."""
    level = sum((_set(bits, hashes).astype(np.int64) for bits in common), np.zeros(len(hashes), np.int64))
    return hashes[np.lexsort((hashes, level))[: len(hashes) - math.ceil(least * len(hashes) - 1e-9) + 1]]


def _sketch(hashes: np.ndarray) -> bytes:
    """How many of the distinct hashes fall in each bucket of their first bits, up to 255: 64 buckets, 128 from 256 hashes on, 256 from 1,024.

    Two texts share at most the sum of the smaller counts; buckets next to each other add up to those of a coarser sketch.
    """
    bits = 6 + (len(hashes) >= 256) + (len(hashes) >= 1024)
    return np.minimum(255, np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)).astype(np.uint8).tobytes()


def _levels(sketches: list[bytes]) -> dict[int, np.ndarray]:
    """Counts of each sketch in 64, 128 and 256 buckets; rows of sketches coarser than that are zero."""
    out = {}
    for width in (64, 128, 256):
        rows = np.zeros((len(sketches), width), np.int16)
        for finer in (64, 128, 256):
            own = [i for i, x in enumerate(sketches) if len(x) == finer >= width]
            if own:
                counts = np.frombuffer(b"".join([sketches[i] for i in own]), np.uint8).reshape(len(own), width, finer // width)
                rows[own] = counts.sum(axis=2, dtype=np.int16)
        out[width] = rows
    return out


def _meetings(least: float):
    """Edges (a, b) that connect the members of each shingle's list that sizes and sketches allow to be similar, where they are of different groups.

    Of a list cut into blocks a row holds two of them, whose members meet across. Edges are a
    spanning forest of each batch, so there are never more than members.
    """
    share = least / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [(batch.column(k).values.to_numpy(), batch.column(k).offsets.to_numpy()) for k in range(4)]
            sketches = batch.column(4).flatten().to_pylist()
            starts, same = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(4)).to_numpy())]), batch.column(5).to_numpy(zero_copy_only=False)
            lefts, rights = [], []
            for i in range(batch.num_rows):
                node, group, size, block = (v[o[i] : o[i + 1]] for v, o in columns)
                order = np.argsort(size, kind="stable")
                sketch = [sketches[starts[i] + k] for k in order]
                levels = _levels(sketch)
                node, group, size, block = node[order], group[order], size[order], block[order]
                ends = np.searchsorted(size, size / least + 1e-6, side="right")
                found = []
                for x in range(len(node) - 1):
                    y = np.arange(x + 1, ends[x])
                    y = y[(group[y] != group[x]) & (same[i] | (block[y] != block[x]))]
                    if len(y):
                        counts = levels[len(sketch[x])]  # a larger text's sketch is at least as fine
                        both = np.minimum(counts[x], counts[y]).sum(axis=1, dtype=np.int64)
                        y = y[(both >= share * (size[x] + size[y]) - 1e-6) | (size[y] > UNSKETCHED)]
                        if len(y):
                            found.append((np.broadcast_to(node[x], len(y)), node[y]))
                if found:
                    a, b = _forest(*(np.concatenate(z) for z in zip(*found, strict=True)))
                    lefts.append(a), rights.append(b)
            if lefts:
                a, b = _forest(np.concatenate(lefts), np.concatenate(rights))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _bit_table(tokens: DataFrame) -> np.ndarray:
    """A table of bits (uint64 words), set at least at the low bits of every token: 2^27 bits at most, sixteen a token if that is less."""
    size = 1 << min(MOST_BITS, max(10, math.ceil(math.log2(16 * max(1, tokens.count())))))
    at = F.col("token").bitwiseAND(F.lit(size - 1))
    words = tokens.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(token & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _flagged(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows with nd_maybe: false only where column key (a long) is certainly not in keys(token). Spares rows a shuffle."""
    bits = _bit_table(keys)
    at = rows.columns.index(key)
    schema = T.StructType([*rows.schema.fields, T.StructField("nd_maybe", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_set(bits, batch.column(at).to_numpy()))], [*batch.schema.names, "nd_maybe"])

    return rows.mapInArrow(run, schema)


def _texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes, with one text each; only texts that may be among them are moved."""
    own = texts.select("node", "text")
    if nodes.count() <= SENT:
        some = own.join(F.broadcast(nodes.select("node")), "node", "left_semi")
    else:
        some = _flagged(own, "node", nodes.select(F.col("node").alias("token"))).where("nd_maybe")
    return some.groupBy("node").agg(F.first("text").alias("text")).join(nodes, "node")


def _thinned(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """rows with only those shingles in the array column first whose bits are set, and only rows with any left."""
    at = rows.columns.index("first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = batch.column(at).flatten(), np.cumsum(pc.list_value_length(batch.column(at)).to_numpy())
            stays = _set(bits, flat.to_numpy() & _SHORT)
            n = np.concatenate([[0], np.cumsum(stays)])[np.concatenate([[0], ends]).astype(np.int64)]
            first = pa.ListArray.from_arrays(pa.array(n.astype(np.int32)), flat.filter(pa.array(stays)))
            out = pa.RecordBatch.from_arrays([first if k == at else batch.column(k) for k in range(batch.num_columns)], batch.schema.names)
            yield out.filter(pa.array(np.diff(n) > 0))

    return rows.mapInArrow(run, rows.schema)


def _tiles() -> Column:
    """The tiles (p, q) a row of column block meets others in, of its list's or family's number of blocks."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("p"), F.greatest("block", k).alias("q"))))


def _remaining(marks: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) that connect all pairs of similar texts in different groups, by shared shingles: none is missed, some are not similar.

    In an order common to all texts, two texts similar by least share one of their first (1 - least) n + 1
    shingles, so they meet in that shingle's list. There a pair is dropped if its sizes or sketches (see
    _sketch) rule the similarity out.
    """
    short = F.col("x").bitwiseAND(F.lit(_SHORT))
    # equal hashes stay equal when cut to 40 bits, so every shared one is counted more than once
    shared = marks.select(F.explode("first").alias("x")).groupBy(short.alias("token")).agg(F.count("*").alias("times")).where("times > 1").select("token")
    few = _thinned(marks.select("node", "size", "first", "sketch"), _bit_table(cut(shared)))
    left = cut(few.join(groups, "node", "left").select("node", "size", "first", "sketch", F.coalesce("component", "node").alias("group")))
    # only the lists of shingles that texts of different groups share are built, as their rows hold sketches
    held = left.select(F.explode("first").alias("x"), "group").groupBy("x").agg(F.count("*").alias("times"), F.min("group").alias("low"), F.max("group").alias("high"))
    mixed = cut(held.where("low < high").select("x", "times"))
    placed = _thinned(left, _bit_table(mixed.select(F.col("x").alias("token")))).select(F.explode("first").alias("x"), "node", "size", "sketch", "group")
    # the list of a common shingle is cut into blocks of which each two meet
    long = cut(mixed.where(F.col("times") > LIST).select("x", F.ceil(F.col("times") / F.lit(LIST)).cast("int").alias("blocks")))
    placed = placed.join(F.broadcast(long) if long.count() <= SENT else long, "x", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    lists = placed.withColumn("tile", _tiles()).groupBy("x", "tile.p", "tile.q").agg(F.collect_list(F.struct("node", "group", "size", "block", "sketch")).alias("all"), F.min("group").alias("low"), F.max("group").alias("high")).where("low < high")
    return lists.select("all.node", "all.group", "all.size", "all.block", "all.sketch", (F.col("p") == F.col("q")).alias("same")).mapInArrow(_meetings(least), "a long, b long")


def similar_groups(docs: DataFrame, text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """(node, component): of the distinct texts linked to others by shingle similarity (Jaccard) of at least least, their group.

    node is xxhash64 of the text (null as empty). 128-bit fingerprints of the distinct shingles are
    laid in tiles by shingle count (bands of ratio 1/least, so only neighbouring bands can hold
    similar texts) and, in a band, by population count; tile pairs whose population counts differ
    beyond the radius of 20 are skipped, the others compared exactly. Fingerprints of similar texts
    may differ by more than the radius; texts of different groups that may be similar all the same
    are joined on shared shingles, which misses none (see _remaining). The families that result are
    verified by exact similarity, in blocks of bounded size of which each two meet, so no pair beyond
    a spanning forest leaves a task, none below least links, and every pair of least or more counts.
    Repeated rows are one text, an empty table gives no rows, other columns are ignored.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))

    common = _common(texts, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, first, sketches = [], [], []
            for x in batch.column(1):
                hashes = shingle_hashes(x.as_py(), words)
                made.append((len(hashes), *_wide(hashes)))
                first.append(_rarest(hashes, common, least).view(np.int64))
                sketches.append(_sketch(hashes))
            columns = list(zip(*made, strict=True)) if made else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(first, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["node", "size", "fa", "fb", "first", "sketch"])

    hashed_once = texts.select("node", "text").mapInArrow(run, "node long, size long, fa long, fb long, first array<long>, sketch binary")
    marks = cut(hashed_once.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "fa", "fb", "first", "sketch")]))
    band = F.when(F.col("size") > 0, F.floor(F.log(F.col("size").cast("double")) / math.log(1 / least) + 1e-9).cast("int")).otherwise(F.lit(-9))
    banded = marks.drop("first", "sketch").withColumn("band", band).withColumn("ones", F.bit_count("fa") + F.bit_count("fb"))
    # at most 129 population counts in each of some hundred bands
    counts = cut(banded.groupBy("band", "ones").agg(F.count("*").alias("n")))
    upto = F.sum("n").over(Window.partitionBy("band").orderBy("ones"))
    place = counts.withColumn("before", upto - F.col("n"))
    spread = (F.col("before") + F.pmod(F.xxhash64("node"), F.col("n"))) / F.lit(TILE)
    tiles = cut(
        banded.join(F.broadcast(place), ["band", "ones"])
        .withColumn("tile", F.floor(spread).cast("int"))
        .groupBy("band", "tile")
        .agg(F.sort_array(F.collect_list(F.struct("node", "fa", "fb"))).alias("all"), F.min("ones").alias("least_ones"), F.max("ones").alias("most_ones"))
    )
    left = tiles.select(F.col("band").alias("band1"), F.col("tile").alias("tile1"), F.col("all").alias("all1"), F.col("least_ones").alias("l1"), F.col("most_ones").alias("m1"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    pairs = left.join(tiles, "band").where("band1 <> band or tile1 <= tile").where(f"l1 - most_ones <= {WIDE_RADIUS} and least_ones - m1 <= {WIDE_RADIUS}")
    wide = pairs.select("all1.node", "all1.fa", "all1.fb", F.col("all.node").alias("node2"), F.col("all.fa").alias("fa2"), F.col("all.fb").alias("fb2"), (F.col("band1") == F.col("band")) & (F.col("tile1") == F.col("tile")))
    loose = cut(components(wide.mapInArrow(_wide_edges, "a long, b long"), "a", "b"))
    more = _remaining(marks, loose, least)
    family = cut(components(loose.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "a", "b"))
    own = family.join(marks.select("node", "size"), "node")
    extent = own.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("size") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    members = own.select("node", "component").join(extent, "component").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))

    # texts are moved rather than their hashes, which are larger and don't compress
    met = _texts_of(texts, cut(members)).withColumn("tile", _tiles()).select("component", "tile.p", "tile.q", "node", "block", "text")
    linked = cut(met.groupBy("component", "p", "q").applyInPandas(_similar(words, least), "a long, b long"))
    return components(linked, "a", "b")


def _with_group(rows: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """rows with the columns of groups (a row per nd_group, nd_size its rows); groups of over most rows, of which few can exist, are met by broadcast."""
    large = F.broadcast(groups.where(F.col("nd_size") > most).select("nd_group", F.col("best").alias("nd_first")))
    marked = rows.join(large, "nd_group", "left")
    rest = marked.where("nd_first is null").drop("nd_first").join(groups.select("nd_group", "best"), "nd_group")
    return rest.unionByName(marked.where("nd_first is not null").withColumnRenamed("nd_first", "best"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row of each group of similar texts: the one of the smallest id (null last), then of the smallest text hash.

    Groups are the components of texts linked by similarity (see similar_groups), and equal texts;
    null texts count as empty ones, and all texts without words are one group. Rows of one id and
    text are one. Only rows that may go are moved. An empty table gives no rows; columns may have any
    names and stay as they are.
    """
    own, (own_id, own_text) = renamed(docs, id_col, text_col)
    return _one_of_each(own, own_id, own_text, words, least).toDF(*docs.columns)


def _one_of_each(docs: DataFrame, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    marked = docs.withColumn("nd_node", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).withColumn("nd_key", F.xxhash64("nd_node", F.col(id_col)))
    groups = cut(similar_groups(docs, text_col, words, least))
    ids = marked.groupBy("nd_node", F.col(id_col).alias("nd_id"), "nd_key").agg(F.count("*").alias("nd_rows"))
    named = cut(ids.join(groups, F.col("nd_node") == F.col("node"), "left").withColumn("nd_group", F.coalesce("component", "nd_node")).withColumn("nd_null", F.col("nd_id").isNull()).select("nd_node", "nd_id", "nd_key", "nd_rows", "nd_group", "nd_null"))
    best = cut(named.groupBy("nd_group").agg(F.min(F.struct("nd_null", "nd_id", "nd_node")).alias("best"), F.count("*").alias("nd_size")))
    judged = _with_group(named, best, max(256, named.count() // 1000)).withColumn("nd_wins", (F.col("best.nd_node") == F.col("nd_node")) & F.col("best.nd_id").eqNullSafe(F.col("nd_id")))
    touched = cut(judged.where("not nd_wins or nd_rows > 1").select(F.col("nd_key").alias("token"), F.col("nd_node").alias("nd_other"), F.col("nd_id").alias("nd_own"), "nd_wins"))
    same = (F.col("nd_key") == F.col("token")) & (F.col("nd_node") == F.col("nd_other")) & F.col(id_col).eqNullSafe(F.col("nd_own"))
    if touched.count() <= SENT:
        sure, few = None, marked.join(F.broadcast(touched), same, "left")
    else:
        flagged = _flagged(marked, "nd_key", touched.select("token"))
        sure, few = flagged.where("not nd_maybe").select(*docs.columns), flagged.where("nd_maybe").drop("nd_maybe").join(touched, same, "left")
    alone = few.where("nd_wins is null").select(*docs.columns)
    again = few.where("nd_wins").dropDuplicates(["nd_key", "nd_node"]).select(*docs.columns)
    return (alone if sure is None else sure.unionByName(alone)).unionByName(again)
