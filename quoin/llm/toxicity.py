"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.lineage import cut
from quoin.llm.simhash import shingle_hashes

SAMPLE = 4096
NEIGHBOURS = 15
BLOCK = 64
FREQUENT = 256
AT_ONCE = 64
THRESHOLD = 0.3
_WORD = re.compile(r"\w+")
_EPS = 0.05


def counts(text: str | None) -> Counter[str]:
    """How often each lower-cased word occurs in a text."""
    return Counter(_WORD.findall((text or "").lower()))


class Examples:
    """Labelled texts as arrays: words (all that occur, sorted), and a row (member, term, times) for each word of each text; marks are the texts' hashes."""

    def __init__(self, ids: list[int | None], labels: np.ndarray, marks: list[str], words: pa.ListArray, times: pa.ListArray):
        self.ids, self.labels, self.marks = ids, np.asarray(labels, np.int64), marks
        coded = words.values.dictionary_encode()
        spelled = np.array(coded.dictionary.to_pylist(), object)
        order = np.argsort(spelled) if len(spelled) else np.zeros(0, np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.words = spelled[order].tolist()
        self.term = place[coded.indices.to_numpy(zero_copy_only=False)]
        self.times = times.values.to_numpy(zero_copy_only=False)
        self.member = np.repeat(np.arange(len(ids)), np.diff(words.offsets.to_numpy()))

    @staticmethod
    def of(rows: list[tuple[int | None, int, dict[str, int]]]) -> Examples:
        """Examples of (id, label, counts)."""
        words, times = pa.array([list(c) for _, _, c in rows], pa.list_(pa.string())), pa.array([list(c.values()) for _, _, c in rows], pa.list_(pa.int32()))
        return Examples([k for k, _, _ in rows], np.array([y for _, y, _ in rows]), [str(sorted(c.items())) for _, _, c in rows], words, times)


def term_weights(own: Examples) -> np.ndarray:
    """Every word's inverse document frequency times one plus ten times its association with the labels.

    The association is the likelihood ratio over the value that about half a word reaches by chance
    among all words. Without it the rare words of any text outweigh what toxic examples share.
    """
    n, n1, many = len(own.ids), int(own.labels.sum()), len(own.words)
    df = np.bincount(own.term, minlength=many).astype(float)
    o11 = np.bincount(own.term, own.labels[own.member], minlength=many)
    ratio = np.zeros(many)
    if 0 < n1 < n:
        for o, e in ((o11, df * n1 / n), (df - o11, df * (n - n1) / n), (n1 - o11, (n - df) * n1 / n), (n - n1 - df + o11, (n - df) * (n - n1) / n)):
            ratio += 2 * np.where(o > 0, o * np.log(np.maximum(o, 1) / np.maximum(e, 1e-12)), 0.0)
    return (np.log((1 + n) / (1 + df)) + 1) * (1 + 10 * np.maximum(0.0, ratio) / (2 * math.log(max(2, 2 * many))))


def _short(x: np.ndarray) -> np.ndarray:
    """x rounded to single precision: half the bytes to send; sums are in double."""
    return x.astype(np.float32).astype(np.float64)


class Index:
    """Unit TF-IDF vectors of all examples, over all their words, in posting lists cut into blocks of examples.

    Words rarer than the FREQUENT most frequent ones have plain postings. The postings of frequent
    words lie dense by block, and each block has the largest weight of every frequent word, which
    bounds what any of its examples can add. Examples are laid out so that those sharing their
    heaviest words are neighbours, which keeps most blocks' bounds low for any one query; the layout,
    and so the order of ties, depends on words and texts alone. Examples without words are left out.
    """

    def __init__(self, own: Examples):
        self.words = "\n".join(own.words)
        self._hash(own.words)
        self.idf = _short(term_weights(own))
        weight = (1 + np.log(own.times)) * self.idf[own.term] if len(own.term) else np.zeros(0)
        norm = np.sqrt(np.bincount(own.member, weight * weight, minlength=len(own.ids)))
        weight = weight / norm[own.member]
        by = np.lexsort((own.term, -weight, own.member))
        starts = np.searchsorted(own.member[by], np.arange(len(own.ids) + 1))
        tops = [tuple(own.term[by[a : min(b, a + 3)]].tolist()) for a, b in zip(starts, starts[1:], strict=False)]
        layout = sorted((i for i in range(len(own.ids)) if tops[i]), key=lambda i: (tops[i], own.marks[i], int(own.labels[i])))
        place = np.full(len(own.ids), -1, np.int64)
        place[layout] = np.arange(len(layout))
        self.ids, self.labels, self.examples = [own.ids[i] for i in layout], own.labels[layout].astype(np.float64), len(layout)
        by = np.lexsort((own.term, place[own.member]))
        self.flat = (own.term[by].astype(np.int32), _short(weight[by]), place[own.member][by].astype(np.int32))
        self._lists()

    @property
    def terms(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.words.split("\n"))} if len(self.idf) else {}

    def _hash(self, words: list[str]) -> None:
        """Words are looked up by 64-bit hashes in sorted order, in a tenth of the room of a table of strings."""
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
        self.order = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.order]

    def _lists(self) -> None:
        """Posting lists and block maxima."""
        term, weight, member = self.flat
        many = len(self.idf)
        times = np.bincount(term, minlength=many)
        self.blocks = -(-self.examples // BLOCK)
        common = np.argsort(-times, kind="stable")[:FREQUENT]
        self.column = np.full(many, -1, np.int32)
        self.column[common] = np.arange(len(common))
        column = self.column[term]
        dense = np.zeros((self.blocks * BLOCK, len(common)))
        often = column >= 0
        dense[member[often], column[often]] = weight[often]
        self.dense = dense.reshape(self.blocks, BLOCK, len(common))
        self.most = self.dense.max(axis=1)
        rare = np.nonzero(~often)[0]
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.members, self.weights = member[rare], weight[rare].astype(np.float32)
        self.starts = np.searchsorted(term[rare], np.arange(many + 1)).astype(np.int32)

    def plain(self) -> dict:
        """The index as arrays and built-in types, weights in single precision, which is what they are rounded to."""
        term, weight, member = self.flat
        return {"words": self.words, "hashes": self.hashes, "order": self.order, "idf": self.idf.astype(np.float32), "ids": self.ids, "labels": self.labels.astype(np.int8), "flat": (term, weight.astype(np.float32), member)}

    @classmethod
    def of(cls, plain: dict) -> Index:
        own = cls.__new__(cls)
        term, weight, member = plain["flat"]
        own.words, own.hashes, own.order = plain["words"], plain["hashes"], plain["order"]
        own.idf, own.ids, own.labels = plain["idf"].astype(np.float64), plain["ids"], plain["labels"].astype(np.float64)
        own.flat, own.examples = (term, weight, member), len(plain["ids"])
        own._lists()
        own.flat = None  # a search needs the lists alone
        return own

    def vector(self, tf: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """A text's known words and their weights, of length one."""
        if not tf or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0)
        asked = np.fromiter((xxhash.xxh64_intdigest(t) for t in tf), np.uint64, len(tf))
        spot = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        known = self.hashes[spot] == asked
        if not known.any():
            return np.zeros(0, np.int64), np.zeros(0)
        at = self.order[spot[known]].astype(np.int64)
        w = (1 + np.log(np.fromiter(tf.values(), np.float64, len(tf))[known])) * self.idf[at]
        order = np.argsort(at)
        at, w = at[order], w[order]
        return at, w / math.sqrt(float((w * w).sum()))

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the k examples of largest cosine, ties by layout: (positions, cosines), position -1 where fewer have a cosine above 0.

        A query's rare words give each example a partial score; with the block maxima of its frequent
        words that bounds each block. Blocks are scored from the highest bounds down, each for those
        queries only whose k-th best cosine its bound reaches, so the result is exact. without: an
        example for each query that doesn't count.
        """
        found_i, found_s = np.full((len(vectors), k), -1, np.int64), np.zeros((len(vectors), k))
        for at in range(0, len(vectors) if self.examples else 0, AT_ONCE):
            some = vectors[at : at + AT_ONCE]
            m, n = len(some), self.blocks * BLOCK
            term = np.concatenate([v[0] for v in some])
            weight = np.concatenate([v[1] for v in some])
            row = np.repeat(np.arange(m), [len(v[0]) for v in some])
            often = self.column[term] >= 0
            query = np.zeros((m, self.most.shape[1]))
            query[row[often], self.column[term[often]]] = weight[often]
            term, weight, row = term[~often], weight[~often], row[~often]
            size = self.starts[term + 1] - self.starts[term]
            spot = np.repeat(self.starts[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
            part = np.bincount(np.repeat(row, size) * n + self.members[spot], np.repeat(weight, size) * self.weights[spot], minlength=m * n).reshape(m, n)
            if without is not None:
                part[np.arange(m), without[at : at + m]] = -2
            bound = part.reshape(m, self.blocks, BLOCK).max(axis=2) + query @ self.most.T
            top = min(k, n)
            least = np.maximum(0, np.partition(part, n - top, axis=1)[:, n - top]) if n >= k else np.zeros(m)
            best_i, best_s = np.full((m, k), n, np.int64), np.zeros((m, k))
            for b in np.argsort(-bound.sum(axis=0), kind="stable"):
                act = np.nonzero((bound[:, b] > 0) & (bound[:, b] >= least - 1e-9))[0]
                if not len(act):
                    continue
                score = np.round(part[act, b * BLOCK : (b + 1) * BLOCK] + query[act] @ self.dense[b].T, 12)
                s = np.concatenate([best_s[act], np.maximum(0, score)], axis=1)
                i = np.concatenate([best_i[act], np.broadcast_to(np.arange(b * BLOCK, (b + 1) * BLOCK), score.shape)], axis=1)
                order = np.lexsort((i, -s), axis=1)[:, :k]
                best_s[act], best_i[act] = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)
                least[act] = np.maximum(least[act], best_s[act, k - 1])
            found_i[at : at + m], found_s[at : at + m] = np.where(best_s > 0, best_i, -1), best_s
        return found_i, found_s


class Model:
    """An index, the rate of toxic texts, and a monotone calibration of the vote; body is the model packed, if it came so."""

    body: bytes | None = None

    def __init__(self, index: Index, rate: float, neighbours: int = NEIGHBOURS, wordless: tuple[int, int] = (0, 0)):
        """wordless: how many examples have no word, and how many of these are toxic."""
        self.index, self.rate, self.neighbours = index, rate, neighbours
        self.empty = (wordless[1] + rate) / (wordless[0] + 2)
        self.x, self.y = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def plain(self) -> dict:
        """The model as arrays and built-in types, for a broadcast."""
        return self.__dict__ | {"index": self.index.plain()}

    @classmethod
    def of(cls, plain: dict) -> Model:
        own = cls.__new__(cls)
        own.__dict__.update(plain | {"index": Index.of(plain["index"])})
        return own

    def votes(self, near: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Neighbours' labels weighted by closeness, with one far vote for the overall rate."""
        w = np.where(near >= 0, 1 / (1 - np.minimum(cosine, 1.0) + _EPS), 0.0)
        labels = self.index.labels[np.maximum(near, 0)] if self.index.examples else np.zeros(near.shape)
        return ((w * labels).sum(axis=1) + self.rate) / (w.sum(axis=1) + 1)

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Isotonic regression (pool adjacent violators) of labels on votes, joined by straight lines."""
        order = np.argsort(votes, kind="stable")
        blocks: list[list[float]] = []
        for v, y in zip(votes[order], labels[order], strict=True):
            blocks.append([y, 1.0, v])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                y2, n2, v2 = blocks.pop()
                y1, n1, v1 = blocks[-1]
                blocks[-1] = [y1 + y2, n1 + n2, (v1 * n1 + v2 * n2) / (n1 + n2)]
        if blocks:
            self.x = np.array([b[2] for b in blocks])
            self.y = np.array([(b[0] + self.rate) / (b[1] + 1) for b in blocks])

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The calibrated chances that texts are toxic, and their neighbours and cosines.

        A text without a known word has the share of toxic ones among examples without words and two
        invented ones, of which the overall rate is toxic.
        """
        near, cosine = self.index.nearest([self.index.vector(counts(t)) for t in texts], self.neighbours)
        return np.where((near >= 0).any(axis=1), np.interp(self.votes(near, cosine), self.x, self.y), self.empty), near, cosine


def without_copies(examples: DataFrame, least: float = 0.8) -> DataFrame:
    """examples(id, text, toxic), a bounded table, with one of each group of equal or similar texts of a label.

    Texts that share their smallest hash of five-word shingles are compared, and one whose shingles
    are similar by least (Jaccard) to those of one kept before it is left out; else the words of a
    text copied a thousand times would look like evidence. Texts that only share a passage stay.
    Texts without words are one. The order is by the texts' hash, equal texts keep the smallest id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(x.as_py(), 5).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([int(h[0]) if len(h) else 0 for h in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "text", "toxic", "least", "hashes"])

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(known=frame.id.isna(), mark=[hashlib.sha256((x or "").encode("utf-8", "replace")).digest() for x in frame.text]).sort_values(["mark", "known", "id"])
        sets, chosen = [], []
        for i, h in enumerate(frame.hashes):
            h = np.asarray(h, np.int64)
            if all((both := len(np.intersect1d(h, o, assume_unique=True))) < least * (len(h) + len(o) - both) for o in sets):
                sets.append(h)
                chosen.append(i)
        return frame.iloc[chosen][["id", "text", "toxic"]]

    keyed = examples.select("id", "text", "toxic").mapInArrow(run, "id long, text string, toxic int, least long, hashes array<long>")
    return keyed.groupBy("least", "toxic").applyInPandas(keep, "id long, text string, toxic int")


def _built(table: pa.Table, neighbours: int) -> Model:
    """A model from a table of ids, labels, marks, words and times."""
    table = table.combine_chunks()
    n = table.num_rows
    labels = table.column("toxic").to_numpy() if n else np.zeros(0, np.int64)
    n1 = int(labels.sum())
    rate = (n1 + 0.5) / (n + 1) if n else 0.0
    if not 0 < n1 < n:
        return Model(Index(Examples.of([])), rate, neighbours)
    one = lambda name: table.column(name).chunk(0)
    own = Examples(one("id").to_pylist(), labels, one("mark").to_pylist(), one("words"), one("times"))
    bare = np.bincount(own.member, minlength=n) == 0
    index = Index(own)
    model = Model(index, rate, neighbours, (int(bare.sum()), int(own.labels[bare].sum())))
    term, weight, member = index.flat
    ends = np.searchsorted(member, np.arange(index.examples + 1))
    vectors = [(term[a:b].astype(np.int64), weight[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    model.calibrate(model.votes(*index.nearest(vectors, neighbours, np.arange(index.examples))), index.labels)
    return model


def _bytes(model: Model) -> bytes:
    return zlib.compress(pickle.dumps(model.plain()), 1)


def _model(body: bytes) -> Model:
    return Model.of(pickle.loads(zlib.decompress(body)))


def packed(examples: DataFrame, neighbours: int = NEIGHBOURS) -> bytes:
    """fit(), pickled as arrays and built-in types: one task builds it, so the driver holds its bytes alone."""
    names = ["id", "toxic", "mark", "words", "times"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(x.as_py()) for x in batch.column(1)]
            marks = [hashlib.sha256((x.as_py() or "").encode("utf-8", "replace")).hexdigest() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(marks, pa.string()), pa.array([list(f) for f in found], kinds[3]), pa.array([list(f.values()) for f in found], kinds[4])], names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        table = pa.Table.from_batches([b.cast(schema) for b in batches], schema)
        yield pa.RecordBatch.from_arrays([pa.array([_bytes(_built(table, neighbours))], pa.binary())], ["model"])

    single = without_copies(examples.select("id", "text", F.coalesce(F.col("toxic").cast("int"), F.lit(0)).alias("toxic")))
    counted = cut(single.mapInArrow(count, "id long, toxic int, mark string, words array<string>, times array<int>"))
    # at most the sample's examples
    made = counted.repartition(1).mapInArrow(build, "model binary").collect()
    return bytes(made[0]["model"]) if made else _bytes(Model(Index(Examples.of([])), 0.0, neighbours))


def fit(examples: DataFrame, neighbours: int = NEIGHBOURS) -> Model:
    """A model from examples(id, text, toxic), a table bounded by the sample: all its examples that have words, over all their words.

    Executors count words; one task gets each example's counts, weighs words (see term_weights) and
    calibrates on leave-one-out votes. No examples, or none of a label, give a model that scores
    every text alike. Null texts and labels count as empty texts and label 0; of equal and similar
    texts one is learned from (see without_copies).
    """
    body = packed(examples, neighbours)
    model = _model(body)
    model.body = body
    return model


def _shared(docs: DataFrame, model: Model | bytes):
    """A broadcast of a model's bytes, bounded by the sample."""
    return docs.sparkSession.sparkContext.broadcast(model if isinstance(model, bytes) else model.body or _bytes(model))


def _own(shared) -> Model:
    """The model of a broadcast, unpacked once in a worker process: there a broadcast is one object for all tasks, and goes with it."""
    if not hasattr(shared, "model"):
        shared.model = _model(shared.value)
    return shared.model


def held_out(key: Column) -> Column:
    """crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """examples(id, text, toxic): the documents of at most sample labelled ids not held out, the first by a hash of the id.

    An id labelled more than once counts as toxic if any label says so; null labels and ids are left
    out. Of an id's different texts one is the example: the one of the smallest hash among those not empty.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most sample rows of two numbers
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")
    return rows.groupBy("id", "toxic").agg(F.min_by("text", F.struct(F.length(F.coalesce("text", F.lit(""))) == 0, F.xxhash64("text"))).alias("text")).select("id", "text", "toxic")


SCORES = "doc_id long, score double, neighbours array<struct<doc_id:long,toxic:int,cosine:double>>"


def score(docs: DataFrame, model: Model | bytes, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, neighbours) per row of docs, from the whole text alone.

    Null and empty texts, and texts without a word of the examples, get one score (see
    Model.score); equal texts get equal scores; null and repeated ids stay; an empty table gives no rows; other
    columns are ignored.
    """
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _own(shared)
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
        for whole in batches:
            for batch in (whole.slice(i, AT_ONCE) for i in range(0, whole.num_rows, AT_ONCE)):
                chance, near, cosine = own.score([x.as_py() for x in batch.column(1)])
                evidence = [[{"doc_id": own.index.ids[i], "toxic": int(own.index.labels[i]), "cosine": s} for i, s in zip(n, c, strict=True) if i >= 0] for n, c in zip(near.tolist(), cosine.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chance, pa.float64()), pa.array(evidence, kind)], ["doc_id", "score", "neighbours"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCORES)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "neighbours")


def without_toxic(docs: DataFrame, model: Model | bytes, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores below threshold, with all their columns.

    Null and empty texts score as in score(), equal texts stay or go together, a score equal to the
    threshold goes, repeated rows stay, and an empty table gives no rows.
    """
    shared = _shared(docs, model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _own(shared)
        for whole in batches:
            for batch in (whole.slice(i, AT_ONCE) for i in range(0, whole.num_rows, AT_ONCE)):
                yield batch.filter(pa.array(own.score([x.as_py() for x in batch.column(at)])[0] < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
