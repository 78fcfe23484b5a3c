"""SentencePiece encoding and decoding; giant texts by a max-plus scan over chunks."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.lineage import cut

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT = 65_536
CHUNK = 16_384
RUN = 64
CACHE = 100_000
SPACE = "▁"
_UNIT = re.compile(" +[^ ]*")
_NEVER = -np.inf


class Pieces:
    """A byte-pair model: the library's processor, and the tables of the chunked encoder.

    Byte-pair encoding is no sum of scores, so the scan runs in the max-plus algebra of 0 (allowed)
    and minus infinity: a sequence of pieces is the encoding of its text exactly if each two
    neighbours are the encoding of their joint text, because merges follow one global order (score,
    then place) and none crosses a boundary that stays. The best path, the only one not minus
    infinity, is the encoding.
    """

    def __init__(self, proto: bytes):
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.lib.vocab_size()
        self.rank = {}
        for i in range(n):
            if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i)):
                self.rank[self.lib.id_to_piece(i)] = (-self.lib.get_score(i), i)
        self.longest = max(map(len, self.rank), default=1)
        self.bytes = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.falls_back = all(self.lib.is_byte(i) for i in self.bytes)
        self.splits = all(SPACE not in p.lstrip(SPACE) for p in self.rank)
        self.cache: dict[str, bytes] = {}
        self.spelling = [bytes([self.bytes.index(i)]) if self.lib.is_byte(i) else b"" if self.lib.is_control(i) else self.lib.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.known: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short normalised text (or its single characters) after all merges."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[a + b][0], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether two pieces are the encoding of their joint text; kept in a plain table, so that nothing outlives its model."""
        known = self.known.get((a, b))
        if known is None:
            if len(self.known) >= 1_000_000:
                self.known.clear()
            known = self.known[a, b] = self.merged(a + b) == [a, b]
        return known

    def ids_of(self, piece: str) -> list[int]:
        if piece in self.rank:
            return [self.rank[piece][1]]
        return [self.bytes[b] for b in piece.encode("utf-8", "replace")] if self.falls_back else [self.lib.unk_id()]

    # a token is (start, end) in the text; a state at a cut is the token that holds the character before it

    def tokens_ending(self, s: str, end: int) -> list[tuple[int, int]]:
        own = [(i, end) for i in range(max(0, end - self.longest), end - 1) if s[i:end] in self.rank]
        return [*own, (end - 1, end)]

    def states(self, s: str, cut: int, last: bool = False) -> list[tuple[int, int]]:
        """Every token that holds the character before cut, in one order; at the text's end those that end there."""
        ends = [cut] if last else range(cut, min(len(s), cut + self.longest - 1) + 1)
        return [t for e in ends for t in self.tokens_ending(s, e) if t[0] < cut]

    def reach(self, s: str, entries: list[tuple[int, int]], exits: list[tuple[int, int]]) -> tuple[np.ndarray, dict]:
        """Transfer matrix between entry and exit tokens (0 or minus infinity), and each token's predecessor on an allowed path.

        Rows are carried as bit masks through one pass over the text between the cuts.
        """
        low, high = min(e for _, e in entries), max(e for _, e in exits)
        at: dict[int, list[tuple[tuple[int, int], int]]] = {}
        for k, t in enumerate(entries):
            at.setdefault(t[1], []).append((t, 1 << k))
        before: dict[tuple[int, int], tuple[int, int]] = {}
        masks: dict[tuple[int, int], int] = {}
        for end in range(low + 1, high + 1):
            for t in self.tokens_ending(s, end):
                mask = 0
                for u, m in at.get(t[0], ()):
                    if m & ~mask and (u[1] == 0 or self.fits(s[u[0] : u[1]], s[t[0] : t[1]])):
                        mask |= m
                        before.setdefault(t, u)
                if mask:
                    masks[t] = masks.get(t, 0) | mask
                    at.setdefault(end, []).append((t, mask))
        matrix = np.full((len(entries), len(exits)), _NEVER)
        for j, t in enumerate(exits):
            for k, a in enumerate(entries):
                if masks.get(t, 0) >> k & 1:
                    matrix[k, j] = 0.0
        return matrix, before

    def resets(self, s: str, low: int, high: int) -> tuple[int, int] | None:
        """First and last place in the span that no piece crosses (a space mark after another character)."""
        if not self.splits:
            return None
        first = low
        while True:
            first = s.find(SPACE, max(first, 1), high)
            if first < 0:
                return None
            if s[first - 1] != SPACE:
                break
            first += 1
        last = high
        while True:
            last = s.rfind(SPACE, 1, last)
            if s[last - 1] != SPACE:
                return first, last

    def transfer(self, s: str, entries: list[tuple[int, int]], exits: list[tuple[int, int]]) -> np.ndarray:
        """A chunk's matrix. Between two resets the path is free of both ends, so only head and tail are walked."""
        spot = self.resets(s, max(e for _, e in entries) + 1, min(b for b, _ in exits))
        if spot is None:
            return self.reach(s, entries, exits)[0]
        head = self.reach(s, entries, self.tokens_ending(s, spot[0]))[0].max(axis=1)
        tail = self.reach(s, self.tokens_ending(s, spot[1]), exits)[0].max(axis=0)
        return head[:, None] + tail[None, :]

    def walk(self, s: str, entry: tuple[int, int], exit_: tuple[int, int]) -> list[tuple[int, int]]:
        """The tokens after entry up to and with exit on the one allowed path."""
        _, before = self.reach(s, [entry], [exit_])
        out = [exit_]
        while out[-1] != entry:
            out.append(before[out[-1]])
        return out[-2::-1]

    def back(self, s: str, entry: tuple[int, int], exit_: tuple[int, int]) -> list[int]:
        """A chunk's piece ids after its entry state up to and with its exit state."""
        spell = lambda tokens: [i for a, b in tokens for i in self.ids_of(s[a:b])]
        if entry == exit_:
            return []
        spot = self.resets(s, entry[1] + 1, exit_[0])
        if spot is None:
            return spell(self.walk(s, entry, exit_))
        head = next(self.walk(s, entry, t) for t in self.tokens_ending(s, spot[0]) if self.reach(s, [entry], [t])[0][0, 0] == 0)
        before = next(t for t in self.tokens_ending(s, spot[1]) if self.reach(s, [t], [exit_])[0][0, 0] == 0)
        middle = np.frombuffer(self.units(s[spot[0] : spot[1]].replace(SPACE, " ")), np.int32).tolist()
        return spell(head) + middle + spell(self.walk(s, before, exit_))

    def units(self, line: str) -> bytes:
        """Ids (32-bit) of a text of whole units, each some spaces and what follows up to the next space; no piece crosses units."""
        cache = self.cache
        parts = _UNIT.findall(line)
        new = [u for u in set(parts) if u not in cache]
        if new:
            if len(cache) > CACHE:
                cache.clear()
                new = list(set(parts))
            for u, ids in zip(new, self.lib.encode([u[1:] for u in new], num_threads=1), strict=True):
                cache[u] = array("i", ids or self.ids_of(SPACE)).tobytes()
        return b"".join([cache[u] for u in parts])

    def encode(self, text: str | None) -> np.ndarray:
        """Piece ids of a whole text, as the library gives them; null and empty texts have none."""
        if not text:
            return np.zeros(0, np.int32)
        text = text.encode("utf-8", "replace").decode()
        return np.frombuffer(self.units(" " + text.replace(SPACE, " ")), np.int32) if self.splits else np.array(self.lib.encode(text), np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids: their spellings joined, without the space put in front."""
        spelling = self.spelling
        return b"".join([spelling[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


def normalised(text: str) -> str:
    """A text as pieces see it: a space mark in front, and for each space."""
    return SPACE + text.encode("utf-8", "replace").decode().replace(" ", SPACE)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product; associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The max-plus product of matrices in order."""
    out = matrices[0]
    for m in matrices[1:]:
        out = times(out, m)
    return out


def path(matrices: list[np.ndarray], entry: int | None = None, exit_: int | None = None) -> list[int]:
    """The state at each cut of the best path through all matrices, from forward and backward products; from entry and to exit_ if given."""
    start, end = np.zeros((1, len(matrices[0]))), np.zeros((matrices[-1].shape[1], 1))
    if entry is not None:
        start[0, np.arange(start.shape[1]) != entry] = _NEVER
    if exit_ is not None:
        end[np.arange(len(end)) != exit_, 0] = _NEVER
    ahead, behind = [start], [end]
    for m in matrices:
        ahead.append(times(ahead[-1], m))
    for m in reversed(matrices):
        behind.append(times(m, behind[-1]))
    return [int(np.argmax(a[0] + b[:, 0])) for a, b in zip(ahead, reversed(behind), strict=True)]


def _own(shared) -> Pieces:
    """The model of a broadcast, made once in a worker process: there a broadcast is one object for all tasks, and goes with it."""
    if not hasattr(shared, "pieces"):
        shared.pieces = Pieces(shared.value)
    return shared.pieces


def _model_bytes(spark: SparkSession, model: str):
    with open(model, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _span(s_length: int, k: int, chunk: int, longest: int) -> tuple[int, int, int, int]:
    """Cuts of chunk k and the slice of text that shows every state at both."""
    a, b = k * chunk, min(s_length, (k + 1) * chunk)
    return a, b, max(0, a - longest), min(s_length, b + longest)


def _chunk_states(p: Pieces, s: str, begin: int, a: int, b: int, last: bool) -> tuple[list, list]:
    """Entry and exit tokens of a chunk, in the slice's own places; a document's first entry is the empty token at 0."""
    entries = [(0, 0)] if a == 0 else p.states(s, a - begin)
    return entries, p.states(s, b - begin, last)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK, decoded: bool = False) -> DataFrame:
    """(id, ids): the piece ids of each row's whole text; with decoded, also text: what the ids decode to.

    Texts of up to giant characters are encoded in one go. Longer ones are cut into chunks at fixed
    places; each chunk yields the matrix of which boundary states (the token over the cut) can
    follow which; the matrices are combined by the associative max-plus product in a parallel scan of
    two levels (runs of 64 chunks, then a text's runs), forward and backward, which fixes the state at
    each cut; then each chunk spells its pieces on its own.
    A text given many times is cut and scanned once.

    Null and empty texts have no pieces; a text's U+2581 is a space to the model; null and repeated
    ids stay; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    proto = _model_bytes(spark, model)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _own(proto)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                made = [p.encode(x.as_py()) for x in part.column(1)]
                ends = np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int32)
                flat = np.concatenate(made) if made else np.zeros(0, np.int32)
                out = {"id": part.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}
                if decoded:
                    out["text"] = pa.array([p.decode(m.tolist()) for m in made], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    small = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= giant).mapInArrow(whole, "id long, ids array<int>" + ", text string" * decoded)
    large = rows.where(F.length("text") > giant).withColumn("key", F.sha2("text", 256))
    distinct = large.groupBy("key").agg(F.first("text").alias("text"))

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        longest = _own(proto).longest
        for batch in batches:
            for key, text in zip(batch.key, batch.text, strict=True):
                s = normalised(text)
                count = -(-len(s) // chunk)
                if count > 1 and len(s) - (count - 1) * chunk <= 2 * longest:
                    count -= 1
                spans = [_span(len(s), k, chunk, longest) for k in range(count)]
                spans[-1] = (spans[-1][0], len(s), spans[-1][2], len(s))
                yield pd.DataFrame({"key": key, "k": range(count), "a": [x[0] for x in spans], "b": [x[1] for x in spans], "begin": [x[2] for x in spans], "last": [k == count - 1 for k in range(count)], "s": [s[x[2] : x[3]] for x in spans]})

    pieces = distinct.mapInPandas(slices, "key string, k int, a long, b long, begin long, last boolean, s string").repartition("key", "k")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = _own(proto)
        for batch in batches:
            made = [p.transfer(r.s, *_chunk_states(p, r.s, r.begin, r.a, r.b, r.last)) for r in batch.itertuples()]
            yield pd.DataFrame({"key": batch.key, "k": batch.k, "n": [m.shape[0] for m in made], "matrix": [(m == 0).tobytes() for m in made]})

    def dense(frame: pd.DataFrame) -> list[np.ndarray]:
        return [np.where(np.frombuffer(m, bool).reshape(n, -1), 0.0, _NEVER) for n, m in zip(frame.n, frame.matrix, strict=True)]

    def combined(frame: pd.DataFrame) -> pd.DataFrame:
        m = product(dense(frame.sort_values("k")))
        return pd.DataFrame({"key": [frame.key.iloc[0]], "g": [frame.g.iloc[0]], "n": [m.shape[0]], "matrix": [(m == 0).tobytes()]})

    def outer(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("g")
        at = path(dense(frame))
        return pd.DataFrame({"key": frame.key, "g": frame.g, "first": at[:-1], "last": at[1:]})

    def inner(frame: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k")
        at = path(dense(frame), int(ends["first"].iloc[0]), int(ends["last"].iloc[0]))
        return pd.DataFrame({"key": frame.key, "k": frame.k, "entry": at[:-1], "exit": at[1:]})

    # a parallel scan in two levels: products of RUN chunks each, the path over a text's products, the path inside each run
    made = cut(pieces.mapInPandas(matrices, "key string, k int, n int, matrix binary").withColumn("g", F.floor(F.col("k") / F.lit(RUN)).cast("int")))
    runs = made.groupBy("key", "g").applyInPandas(combined, "key string, g int, n int, matrix binary")
    ends = runs.groupBy("key").applyInPandas(outer, "key string, g int, first int, last int")
    found = made.groupBy("key", "g").cogroup(ends.groupBy("key", "g")).applyInPandas(inner, "key string, k int, entry int, exit int")

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = _own(proto)
        for batch in batches:
            ids = []
            for r in batch.itertuples():
                entries, exits = _chunk_states(p, r.s, r.begin, r.a, r.b, r.last)
                ids.append(p.back(r.s, entries[r.entry], exits[r.exit]))
            yield pd.DataFrame({"key": batch.key, "k": batch.k, "ids": ids})

    spelled = pieces.join(found, ["key", "k"]).mapInPandas(spell, "key string, k int, ids array<int>")
    joined = spelled.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    long = large.select("id", "key").join(joined, "key").select("id", "ids")
    return small.unionByName(decode(long, model=model) if decoded else long)


def decode(encoded: DataFrame, id_col: str = "id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """encoded with a column text: the ids' text. Null and empty lists give an empty text; ids outside the vocabulary raise."""
    proto = _model_bytes(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _own(proto)
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            texts = [p.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "ids", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, ids array<int>, text string")
