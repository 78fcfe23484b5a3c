"""Manifest, codes and decontamination against plain versions, and on odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.lineage import cut
from quoin.llm import codes, decontaminate, merkle

CLASH = ("id", "tree", "place", "block", "digest", "path", "root", "words", "window", "shingle", "start", "k1", "spans", "items", "n", "label2", "v", "code", "error", "entry", "part")


def clashing(df):
    return df.withColumns({c: F.lit("mine") for c in CLASH if c not in df.columns})


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """All levels of a tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def slow_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of (doc_id, source, lang, n_chars, text), by the definition."""
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H([f(v) for v in r])
    low = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {}
    for s in names:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        levels[s] = climb([leaf(r) for r in trees[s]])
    top = climb([levels[s][-1][0] for s in names])
    out = []
    for n, s in enumerate(names):
        for i, r in enumerate(trees[s]):
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node, proof = leaf((*r[:4], low(r[4]))) if touched else leaf(r), ""
            for at, tree in ((i, levels[s]), (n, top)):
                for level in tree[:-1]:
                    run = level[at // 16 * 16 : at // 16 * 16 + 16]
                    proof += "".join(run[: at % 16] + run[at % 16 + 1 :])
                    node = H(run[: at % 16] + [node] + run[at % 16 + 1 :])
                    at //= 16
            out.append((r[0], leaf(r), levels[s][-1][0], top[-1][0], H([proof]), node))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string"
KEY = lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r)


def manifests(df):
    got = merkle.document_manifest(df).collect()
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    return sorted((tuple(r[:-1]) for r in got), key=KEY)


def test_manifest_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = manifests(docs)
    assert got == sorted(slow_manifest(rows), key=KEY)
    assert 0 < sum(r[3] != r[5] for r in got) < len(got)


@pytest.mark.parametrize("n", [1, 15, 16, 17, 256, 257, 4096, 4097, 4113])
def test_manifest_at_the_edges_of_runs_and_blocks(spark, n):
    rows = [(i, "s", None, i % 3, f"Text {i}") for i in range(n)] + [(5, None, "en", None, "A"), (2**60 + 1, "", "en", 0, ""), (None, "", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    assert manifests(df) == sorted(slow_manifest(rows), key=KEY)


def test_manifest_of_many_sources_and_odd_rows(spark):
    rows = [(i, f"s{i % 40}", "x", 1, "Word " * (i % 5)) for i in range(300)] + [(7, "s1", "x", 1, "Z" * 200_000)] * 3 + [(None, None, None, None, None)] * 2 + [(1, "É", "ü", 2, "ß\n")]
    df = clashing(spark.createDataFrame(rows, DOCS))
    assert manifests(df) == sorted(slow_manifest(rows), key=KEY)
    assert merkle.document_manifest(df.limit(0)).count() == 0


def test_traversal_holds_little_more_than_its_path():
    leaves = [H([str(i)]) for i in range(3000)]
    want = climb(leaves)
    for i, path in enumerate(merkle.paths(leaves, 3)):
        for level, (at, run) in enumerate(path):
            first = i // 16 ** (level + 1) * 16
            assert at == i // 16**level % 16 and run == want[level][first : first + 16]
    hashed = merkle.Treehash(3)
    for leaf in leaves:
        hashed.push(leaf)
        assert sum(map(len, hashed.open)) < 16 * 3


# Codes


def slow_codes(rows, parts=4, entries=256, rounds=4):
    """(id, code, error) and the codebooks, in Python's whole numbers."""
    kept = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v], lab) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut_ = lambda v: [v[p * w : p * w + w] for p in range(parts)]
    books = [[cut_(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(cut_(v)[p], books[p])[1], []).append(cut_(v)[p])
            books[p] = [[sum(c) // len(own[n]) for c in zip(*own[n], strict=True)] if n in own else e for n, e in enumerate(books[p])]
    found = [(i, [near(x, b) for x, b in zip(cut_(v), books, strict=True)], lab) for i, v, lab in kept]
    rows = [(i, "".join(f"{n:02x}" for _, n in f), sum(d for d, _ in f), lab) for i, f, lab in found]
    total = {}
    for _, _, e, lab in rows:
        total[lab] = total.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[lab], digest) for i, c, e, lab in rows), key=KEY)


VECTORS = "vec_id long, embedding array<float>, label int"


def test_codes_on_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-3, 3)) / 1024 for _ in range(8)], i % 3 or None) for i in range(120)]
    rows += [(200, [0.5] * 8, 1), (200, [0.25] * 8, 1), (201, [-0.0001] * 8, 2), (None, [1.0] * 8, 2)] + [(202, [0.1 * j for j in range(8)], 1)] * 3
    bad = [(300, None, 1), (301, [], 1), (302, [float("nan")] + [0.0] * 7, 1), (303, [None] + [0.0] * 7, 1), (304, [float("inf")] + [0.0] * 7, 1), (305, [0.0] * 4, 1), (306, [0.0] * 7, 1)]
    df = clashing(spark.createDataFrame(rows + bad, VECTORS))
    got = codes.compressed(df, entries=16)
    assert sorted((tuple(r) for r in got.collect()), key=KEY) == slow_codes(rows, entries=16)
    assert codes.compressed(df.limit(0)).count() == 0 and codes.compressed(df.limit(0)).columns == got.columns
    few = spark.createDataFrame(rows[:3], VECTORS)
    assert sorted((tuple(r) for r in codes.compressed(few).collect()), key=KEY) == slow_codes(rows[:3])


def test_nearest_entry_of_equally_near_ones_is_the_first():
    rng = np.random.default_rng(1)
    for scale, leaf in ((2, 2), (2, 32), (40, 4), (2**24, 3)):
        entries = rng.integers(-scale, scale + 1, (100, 4))
        entries[50:60] = entries[0]
        points = rng.integers(-scale, scale + 1, (500, 4))
        d = ((points[:, None] - entries) ** 2).sum(axis=2)
        index, best = codes.nearest(points, codes.kd_tree(entries, leaf))
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_codes_are_near_their_vectors(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    vectors, size = codes.whole(rows, "vec_id", "embedding", "label", 4)
    first = codes.first_codebooks(vectors, size)
    last = codes.refined(vectors, size, first)
    loss = lambda books: codes.encoded(vectors, size, books).agg(F.sum("error")).first()[0]
    assert loss(last) < loss(first)
    back = {r.id: r.vector for r in codes.decoded(codes.encoded(vectors, size, last), last).collect()}
    for r in codes.encoded(vectors, size, last).join(vectors, "id").select("id", "v", "error").limit(20).collect():
        assert sum((a - round(b * 1024)) ** 2 for a, b in zip(r.v, back[r.id], strict=True)) == r.error


# Decontamination


def slow_leaks(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    found = {}
    for name, text in items:
        own = words(text)
        for s in range(max(1, len(own) - window + 1) if own else 0):
            found.setdefault(tuple(own[s : s + window]), set()).add(name)
    sizes, out = {len(k) for k in found}, []
    for i, text in docs:
        own, hit, names = words(text), set(), set()
        for s in range(len(own)):
            for n in sizes:
                if s + n <= len(own) and (got := found.get(tuple(own[s : s + n]))):
                    hit |= set(range(s, s + n))
                    names |= {str(x) for x in got if x is not None}
        out.append((i, len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=KEY)


def test_leaks_on_odd_rows(spark):
    a = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [(1, a), (2, "Two words"), (3, "single"), (4, ""), (5, None), (None, "no id here at all"), (6, "repeat " * 12), (10, a), (7, "one two three four five six seven eight nine"), (7, "É é ß"), (8, "...")]
    docs = [(1, a.upper()), (2, "x " + a.replace(" ", ", ") + " y"), (3, a[: a.rindex(" ")]), (4, "two-words, single; TWO  words"), (5, None), (6, ""), (None, "no id here at all"), (7, "repeat " * 500), (7, "repeat " * 500), (8, "nothing"), (9, "É é ß é É É é ß"), (10, "alpha beta gamma delta epsilon zeta eta theta iota"), (11, "one two three four five six seven eight nine ten"), (12, ("filler words " * 40_000) + a)]
    left = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    right = clashing(spark.createDataFrame(items, "item_id long, text string"))
    want = slow_leaks(docs, items)
    for most in (decontaminate.BROADCAST_BYTES, 300):  # one part, and many
        got = decontaminate.contaminated(left, right, most=most)
        assert sorted((tuple(r) for r in got.drop("items").collect()), key=KEY) == want
    assert decontaminate.contaminated(left.limit(0), right).count() == 0
    clean = decontaminate.contaminated(left, right.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r.contaminated or r.n_hit or r.n_items for r in clean)


def test_share_of_a_window(spark):
    a = [f"w{i}" for i in range(10)]
    near, far = a[:9] + ["other"], a[:5] + ["other"] + a[6:]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, "x y " + " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(a))], "item_id long, text string")
    hit = lambda least: {r.doc_id: r.n_hit for r in decontaminate.contaminated(docs, items, least=least).collect()}
    assert hit(1.0) == {1: 10, 2: 0, 3: 0}
    assert hit(0.8) == {1: 10, 2: 10, 3: 0}  # 7 of 8 shingles; 5 of 8
    assert hit(0.6) == {1: 10, 2: 10, 3: 10}


def test_main_path_has_no_python(spark, folder):
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    plan = decontaminate.contaminated(read("documents"), read("benchmark"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_oracles_agree(spark, folder):
    with duckdb.connect() as db:
        for name in ("documents", "benchmark", "embeddings"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
        for df, sql in ((merkle.document_manifest(read("documents")), merkle.oracle()), (codes.compressed(read("embeddings")), codes.oracle()), (decontaminate.contaminated(read("documents"), read("benchmark")).drop("items"), decontaminate.ORACLE)):
            own = cut(df)
            want = db.execute(f"SELECT {', '.join(own.columns)} FROM ({sql})").fetchall()
            assert sorted((tuple(r) for r in own.collect()), key=KEY) == sorted(want, key=KEY)
