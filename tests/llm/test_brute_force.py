"""Operators held against plain versions on whole small tables."""

import hashlib
import random
import re
import string
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quoin.lineage import cut
from quoin.llm import htmltext, matroska, mixing, pieces, pii, quotes, simhash, toxicity, urlfilter, vectors


@pytest.fixture(scope="module")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def groups(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(documents):
    rows = documents.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    root = groups(len(rows), links)
    least = {}
    for r, g in zip(rows, root, strict=True):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    want = sorted((r.doc_id, f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, root, strict=True))
    assert sorted(tuple(r) for r in simhash.near_duplicates(documents).collect()) == want


def test_offsets_cover_every_pair():
    rng = random.Random(1)
    offsets = set(simhash._offsets(3))
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        d = tuple(bin(a >> 16 * (3 - k) & 0xFFFF).count("1") - bin(b >> 16 * (3 - k) & 0xFFFF).count("1") for k in range(4))
        assert d in offsets or tuple(-x for x in d) in offsets


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_similar_texts(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([3, 12, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(own)))
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = set(groups(len(rows), links))
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == want


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_near_copies_of_the_given_documents(spark, folder, name):
    """The stage keeps the smallest id of each component of all pairs of similarity 0.8 or more."""
    docs = spark.read.parquet(f"{folder.replace('sf0.001', name)}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = [shingles(t) for _, t in rows]
    by = {}
    for i, own in enumerate(sets):
        for x in own:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for own in by.values() for k, a in enumerate(own) for b in own[k + 1 :]}
    links = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    bare = [i for i, own in enumerate(sets) if not own]
    root = groups(len(rows), links + [(bare[0], i) for i in bare[1:]])
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [rows[i][0] for i in sorted(set(root))]


def test_families_in_blocks_and_long_lists(spark, monkeypatch):
    """Small blocks, lists and broadcasts change nothing."""
    rng = random.Random(8)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([12, 40, 300, 1500]))]
        for _ in range(30):
            own = list(base)
            for _ in range(rng.choice([0, 1, len(base) // 60, len(base) // 30])):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id for r in simhash.one_of_each(df).collect()}
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert want == set(groups(len(rows), links))
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "LIST", 5)
    monkeypatch.setattr(simhash, "SENT", 0)
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == want


def test_similar_short_texts_are_all_found(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([8, 8, 8, 9, 12, 16, 20]))]
        other = rng.choice([[*words, "end"], ["start", *words], words[:-1] if len(words) > 8 else [*words, "more"]])
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {2 * i for i in range(1500)}
    sets = [shingles(t) for _, t in rows]
    want |= {2 * i + 1 for i in range(1500) if len(sets[2 * i] & sets[2 * i + 1]) < 0.8 * len(sets[2 * i] | sets[2 * i + 1])}
    assert got == want


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_pii_base(spark, documents):
    odd = ["a@b.c+d@e.f x", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255 1.2.3.256", "4111 1111 1111 1111 41111111111111112", "é🙂 x@y.com 🙂 1.1.1.1", "@@ a@@b.c", "+1+1 2345678 9+", "token = \"0123456789abcdef0123456789abcdef01234567\" mail joe (at) example dot com", "4111-1111-1111-1111", None, ""]
    both = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(10**7 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    source = {r.doc_id: r.text or "" for r in both.collect()}
    added = set()
    for r in pii.find(both).collect():
        spans = base_spans(source[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert hashlib.sha256(line.encode()).hexdigest() == r.base_sha256
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == q for q, _, _ in spans) for k in ("email", "ip", "card", "phone"))
        every = r.spans.split(",") if r.spans else []
        assert set(line.split(",")) - {""} <= set(every)
        added |= {source[r.doc_id][int(a) : int(b)] for k, a, b in (x.split(":") for x in every) if k == "secret"}
    assert "0123456789abcdef0123456789abcdef01234567" in added


def test_pii_sweeps_equal_all_pairs(spark):
    """Candidates that overlap a base span or one of an earlier kind are left out; held against every pair."""
    rng = random.Random(6)
    rows = []
    for i in range(30):
        parts = [rng.choice(["a.b@c.de", "10.2.3.4", "4111111111111111", "+49 170 1234567", "joe [at] web dot com", "(212) 555-1234", "212 555 1234", "078-05-1120", "DE89370400440532013000", "Ab3dEf6hIj9lMn2pQr5t", "plain", "x7y@z.org.uk/Ab3dEf6hIj9lMn2pQr5t"]) for _ in range(rng.choice([0, 3, 40, 700]))]
        rows.append((i, rng.choice([" ", "", "-"]).join(parts)))
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    plain = {k: re.compile(v) for k, v in pii.LOOSE.items()}
    for i, t in rows:
        base = [(a, b) for _, a, b in base_spans(t)]
        loose = {k: [m.span() for m in p.finditer(t) if k != "secret" or re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])] if re.search(pii.HINT[k], t) else [] for k, p in plain.items()}
        want, before = set(), list(base)
        for k, spans in loose.items():
            want |= {(k, a, b) for a, b in spans if not any(x < b and a < y for x, y in before)}
            before += spans
        assert {(c.kind, c.start, c.end) for c in got[i].pii_loose} == want
        assert sorted((x.start, x.end) for k in pii.KINDS[:4] for x in got[i][f"pii_{k}"]) == sorted(base)


def test_pii_many_matches_in_one_text(spark):
    import time

    many = " ".join(f"u{i}@h{i}.example.org 10.{i % 256}.3.4 token=Ab{i}Ef6hIj9lMn2pQr5t" for i in range(33_000))
    df = spark.createDataFrame([(1, many), (2, many[:5000])], "doc_id long, text string")
    begun = time.time()
    got = {r.doc_id: r for r in pii.find(df).collect()}
    masked = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert got[1].n_email == got[1].n_ip == 33_000 and masked[1].count("[EMAIL]") == masked[1].count("[IP]") == 33_000 and len(masked[1]) < len(many)
    assert time.time() - begun < 120


def test_mask_equals_plain_replacement(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(10**6, "é🙂" * 700 + " a@b.cd " + "🙂" * 1500 + "1.2.3.4")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find(df).collect()}
    for r in pii.mask(df).collect():
        text, out, at = dict(rows)[r.doc_id], "", 0
        every = sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in spans[r.doc_id].split(","))) if spans[r.doc_id] else []
        for a, b, k in every:
            if a >= at:
                out += text[at:a] + f"[{k.upper()}]"
            at = max(at, -b)
        assert r.text == (None if text is None else out + text[at:])


def test_mask_leaves_no_base_span(documents):
    for r in pii.mask(documents).collect():
        assert not base_spans(r.text or "")


def test_added_spans_are_secrets(spark):
    """Random keys said to be such are added, hashes said to be commits and dated names aren't."""
    rng = random.Random(9)
    key = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n)) + "9aZ"
    rows, secret = [], {}
    for i in range(300):
        if i % 3 == 0:
            secret[i] = rng.choice(["AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=16)), key(30), "ghp_" + key(33)])
            rows.append((i, f"some words api_key = {secret[i]} and more words"))
        elif i % 3 == 1:
            rows.append((i, f"see the release-notes-of-version-{rng.randint(1, 99)} page and build-{rng.randint(2000, 2030)}-name-of-branch here"))
        else:
            rows.append((i, "plain words without anything in them at all"))
    got = {r.doc_id: [x.split(":") for x in r.spans.split(",")] if r.spans else [] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    found = {(i, text[i][int(a) : int(b)]) for i, spans in got.items() for k, a, b in spans if k == "secret"}
    assert len(found & set(secret.items())) >= 0.95 * len(secret) and len(found - set(secret.items())) <= 5


def test_long_secrets_are_masked_whole(spark):
    token = "".join(random.Random(7).choices(string.ascii_letters + string.digits, k=300))
    rows = [(0, f"api_key = {token} and more"), (1, f"token: {token[:199]}9"), (2, f"secret={token}9x==")]
    got = {r.doc_id: r.text for r in pii.mask(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "api_key = [SECRET] and more", 1: "token: [SECRET]", 2: "secret=[SECRET]"}


def test_matroska_lacings_and_damage():
    payload = bytes(range(256)) * 40
    for lacing in ("none", "fixed", "xiph", "ebml"):
        for size in (0, 1, 576, 5000, len(payload)):
            stored = matroska.write(payload[:size], lacing)
            media = matroska.parse(stored)
            assert media.error is None and b"".join(stored[p.offset : p.offset + p.length] for p in media.packets) == payload[:size]
            assert [p.timestamp_ns for p in media.packets] == [i * 72_000_000 for i in range(len(media.packets))]
            assert all(stored[at : at + 4] == b"\x1f\x43\xb6\x75" for _, _, at in media.cues)
        assert matroska.parse(stored[:-2000]).error
    assert matroska.parse(None).packets == [] and matroska.parse(b"\x00\x01").error


def test_matroska_digests(documents):
    source = {r.doc_id: r.text for r in documents.collect()}
    for r in matroska.digests(documents).collect():
        raw = (source[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        level = [x - 128 for x in payload]
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(level, level[1:], strict=False))
        assert r.feature == f"{len(payload) // 576}:{sum(level) * 1000 // len(payload)}:{sum(x * x for x in level) * 1000 // len(payload)}:{crossings}"
    stored = {r.id: r for r in matroska.files(documents).collect()}
    for r in matroska.digests(documents).collect():
        media = bytes(stored[r.doc_id].media)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_matroska_sizes():
    payload = bytes(range(256)) * 900
    for frame, laced in ((8, 256), (576, 1), (8000, 200), (80_000, 3), (16, 7)):
        media = matroska.parse(matroska.write(payload, "xiph", frame, laced))
        assert media.error is None and [p.timestamp_ns for p in media.packets] == [i * frame * 125_000 for i in range(len(media.packets))]
    for frame, laced in ((0, 8), (577, 8), (576, 0), (576, 257)):
        with pytest.raises(ValueError):
            matroska.write(payload, "fixed", frame, laced)


def vector_rows(dims=16, many=150):
    rng = np.random.default_rng(3)
    rows = []
    for label in range(3):
        for c in rng.normal(size=(many, dims)):
            for _ in range(rng.integers(1, 5)):
                rows.append((len(rows), [float(x) for x in c + rng.normal(size=dims) * rng.choice([0.0, 0.05, 0.2])], label))
    return rows


def links_of(rows):
    """Per row (links, component) by all cosines."""
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    close = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(close, False)
    root = np.array(groups(len(rows), list(zip(*np.nonzero(close), strict=True))))
    least = {g: min(r[0] for r, h in zip(rows, root, strict=True) if h == g) for g in set(root.tolist())}
    return close.sum(axis=1), [least[g] for g in root.tolist()]


@pytest.mark.parametrize(("shard", "most"), [(120, 90), (20, 30), (500, 2000)])
def test_vectors(spark, shard, most):
    rows = vector_rows()
    out = vectors.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=shard, most=most)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.rows.collect()}
    true, root = links_of(rows)
    found = np.array([got[i][0] for i in range(len(rows))])
    assert out.recall >= 0.95 and (found <= true).all() and found.sum() >= 0.95 * true.sum()
    assert np.mean([got[i][1] == root[i] and got[i][2] == (root[i] == i) for i in range(len(rows))]) > 0.97


def test_vectors_with_repeated_ids(spark):
    """Ids repeat within and across labels; every row is a vector of its own."""
    rows = [(i % 40, v, y) for i, v, y in vector_rows()]
    e0, e1, e2 = ([1.0 if i == k else 0.0 for i in range(16)] for k in range(3))
    rows += [(1, e0, 8), (1, e1, 8), (2, [1.0, 0.01, *e0[2:]], 8), (3, [0.01, 1.0, *e1[2:]], 8), (1, [0.01, 0.0, 1.0, *e2[3:]], 9), (5, e2, 9)]
    true, root = links_of(rows)
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted((r[0], int(n), c, r[0] == c) for r, n, c in zip(rows, true, root, strict=True))


def test_vectors_dense_cells_stay_whole(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.ones(8) + rng.normal(size=8) * 0.08], 0) for i in range(600)]
    out = vectors.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=60, most=100)
    true, root = links_of(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in out.rows.collect()}
    assert sum(got[i][0] for i in got) >= 0.95 * true.sum() and all(got[i][0] <= true[i] for i in got) and np.mean([got[i][1] == root[i] for i in got]) > 0.97


def test_toxicity_nearest_is_exact(spark, folder, documents):
    rows = documents.collect()
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    model = toxicity.fit(cut(toxicity.labelled(documents, spark.read.parquet(f"{folder}/labels.parquet"))))
    examples = [(r.doc_id, known[r.doc_id], toxicity.counts(r.text)) for r in rows if known.get(r.doc_id) is not None] * 3
    rng = random.Random(4)
    invented = [(i, rng.randint(0, 1), {f"t{j}": rng.randint(1, 4) for j in rng.sample(range(9000), 40)}) for i in range(700)]
    for own in (examples, invented):
        index = toxicity.Index(toxicity.Examples.of(own))
        term, weight, member = index.flat  # as built, before it is packed
        dense = np.zeros((index.examples, len(index.terms)))
        dense[member, term] = weight
        queries = [index.vector(c) for _, _, c in rng.sample(own, 90)] + [index.vector(toxicity.counts(r.text)) for r in rows[:200]]
        near, cosine = index.nearest(queries)
        for (at, w), n, c in zip(queries, near, cosine, strict=True):
            s = np.sort(np.round(dense[:, at] @ w, 10))[::-1][: toxicity.NEIGHBOURS]
            assert np.allclose(s, c, atol=1e-9) and np.allclose([dense[i, at] @ w for i in n if i >= 0], c[n >= 0], atol=1e-9)
    assert model.index.examples == len({r.text for r in rows if known.get(r.doc_id) is not None and toxicity.counts(r.text)}) or model.index.examples < len(examples) / 3


def test_toxicity_indexes_all_words_and_ignores_ids(spark):
    rows = [(i, f"word{i} common and plain {'vile rotten' if i % 4 == 0 else 'kind'} number{i % 7}", int(i % 4 == 0)) for i in range(300)]
    frame = lambda shift: spark.createDataFrame([((i * 7919 + shift) % 10007, t, y) for i, t, y in rows], "id long, text string, toxic int")
    models = [toxicity.fit(frame(s)) for s in (0, 5000)]
    assert models[0].index.examples == 300 and set(models[0].index.terms) == {w for _, t, _ in rows for w in t.split()}
    texts = [t for _, t, _ in rows] + ["vile", "kind plain", "nothing known", "", None]
    assert (models[0].score(texts)[0] == models[1].score(texts)[0]).all()


def test_copies_are_verified(spark):
    shared = "this licence line is in every text of the table and holds the smallest hash"
    rows = [(i, " ".join([f"w{i}x{j}" for j in range(30)]) + " " + shared, 0) for i in range(20)]
    rows += [(100 + i, " ".join([f"c{j}" for j in range(60)] + [f"end{i}"]), 1) for i in range(10)] + [(200, rows[0][1], 0), (201, None, 0), (202, "", 0)]
    got = {r.id for r in toxicity.without_copies(spark.createDataFrame(rows, "id long, text string, toxic int")).collect()}
    assert set(range(20)) <= got and 200 not in got and len(got & set(range(100, 110))) == 1 and len(got & {201, 202}) == 1


@pytest.mark.parametrize(("name", "recall", "precision"), [("sf0.01", 0.7, 0.6), ("sf0.1", 0.85, 0.9)])
def test_toxicity_on_held_out_rows(spark, folder, name, recall, precision):
    """Figures of the given tables, in which a part of the rows labelled toxic holds no telling word."""
    own = folder.replace("sf0.001", name)
    docs, labels = spark.read.parquet(f"{own}/documents.parquet"), spark.read.parquet(f"{own}/labels.parquet")
    known = {r.doc_id: r.toxic for r in labels.collect()}
    got = [(r.predicted, known[r.doc_id]) for r in toxicity.score(docs, toxicity.fit(cut(toxicity.labelled(docs, labels)))).where("held_out").collect() if r.doc_id in known]
    hits = sum(p == y == 1 for p, y in got)
    assert hits >= recall * sum(y for _, y in got) and hits >= precision * sum(p for p, _ in got)


def test_html_equals_the_articles_of_the_pages(spark, folder):
    """The given pages have one layout: headings and paragraphs in an article; read here with a plain split."""
    own = folder.replace("sf0.001", "sf0.1")
    source = {r.page_id: r.html for r in spark.read.parquet(f"{own}/pages.parquet").collect()}
    space = lambda x: re.sub(r"[ \t\n\r\f\v]+", " ", x).strip(" ")
    for r in htmltext.main_texts(spark.read.parquet(f"{own}/pages.parquet")).collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", source[r.page_id], re.S)[1]
        parts = [space(htmltext.html.unescape(re.sub("</?b>", "", x).replace("<br>", " "))) for x in re.split("</?(?:h1|p)>", body)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_html_adverts_inside_paragraphs():
    model = htmltext.train()
    text = "Real text goes on for a while here."
    for advert in ('<span class="advert">Buy now</span>', '<a class="ad" href="/x">Sponsored link</a>', '<em class="promo">Only today</em>'):
        assert htmltext.extract(f"<article><h1>Title</h1><p>{text} {advert} More.</p><p>{text}</p></article>", model) == f"Title\n{text} More.\n{text}"
    kept = "An <em>important</em> and <a href='/x'>linked</a> word, <code>x=1</code>, <b>bold</b><sup>2</sup>."
    assert htmltext.extract(f"<article><h1>Title</h1><p>{kept}</p><p>{text}</p></article>", model) == f"Title\nAn important and linked word, x=1, bold2.\n{text}"


@pytest.mark.parametrize("page", ["<a x " * 200_000 + '"', '<a x="' + "<a x " * 200_000, "<div>" * 20_000 + "deep", "<b>" + "<div>" * 2000 + "</b>" * 100_000, "<a " + "a" * 10**6 + ">x", "<" * 10**6, "<!--" * 200_000, "<script>" + "</script " * 200_000, "<p>&#" + "9" * 100_000 + ";", "<p " + "a='" * 200_000])
def test_html_broken_markup_is_linear(page):
    import time

    begun = time.time()
    htmltext.extract(page, htmltext.Model())
    assert time.time() - begun < 10


def test_html_tokens():
    text = lambda page: "".join(n.text for n in htmltext._nodes(htmltext.tree(page)))
    assert text("a<b c=\"x>y\">d</b> e<!-- f > g -->h<?i?>j<![CDATA[k>]]>l") == "ad ehjl"
    assert text("1 < 2 <3 a<b \">c") == "1 < 2 <3 ac" and text("a<script>if (a<b) '</p>'</SCRIPT x>b") == "ab"
    assert text("&#99999999999; &#0000000065; &amp;lt;") == "\ufffd A &lt;" and text("a<b c") == "a" and text("a</") == "a"


def test_html_on_held_out_layouts():
    model = htmltext.train()
    wrong = 0
    for page, mark in htmltext.labelled_pages(100, seed=77):
        root = htmltext.tree(page)
        nodes = htmltext._nodes(root)
        want = {n: float(mark in n.attrs or n.tag in ("#root", "html", "body")) for n in nodes if n.tag != "#"}
        for n in nodes:
            n.attrs = n.attrs.replace(mark, "")
        wrong += htmltext.blocks(root, want) != htmltext.blocks(root, model.marginals(nodes))
    assert wrong <= 3


def test_html_marginals_are_exact():
    import itertools
    import math

    model = htmltext.train()
    root = htmltext.tree("<body><nav><a>x</a></nav><article><p>Some text here.</p></article></body>")
    nodes = [n for n in htmltext._nodes(root) if n.tag != "#"]
    every = htmltext._nodes(root)
    names = dict(zip(every, htmltext.features(every), strict=True))
    total, mass = 0.0, dict.fromkeys(nodes, 0.0)
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        y = dict(zip(nodes, labels, strict=True))
        e = sum(y[n] * sum(model.weights.get(f, 0) for f in names[n]) for n in nodes) + sum((model.edges.get(n.tag) or model.edges["*"])[y[n.parent]][y[n]] for n in nodes if n.parent)
        p = math.exp(e)
        total += p
        for n in nodes:
            mass[n] += p * y[n]
    got = model.marginals(every)
    assert all(abs(got[n] - mass[n] / total) < 1e-9 for n in nodes)


@pytest.mark.parametrize("chunk", [40, 100])
def test_pieces_scan_equals_library(chunk):
    with open(pieces.MODEL, "rb") as f:
        p = pieces.Pieces(f.read())
    rng = random.Random(chunk)
    for _ in range(60):
        s = "".join(rng.choice("abcdeéthing \n日本☃19."[: rng.choice([4, 8, 14, 18])]) for _ in range(rng.randint(60, 600)))
        s = s.replace(" ", "") if rng.random() < 0.3 else s
        line = pieces.normalised(s)
        count = -(-len(line) // chunk)
        if count > 1 and len(line) - (count - 1) * chunk <= 2 * p.longest:
            count -= 1
        cuts = [0, *[k * chunk for k in range(1, count)], len(line)]
        states = [[(0, 0)], *[p.states(line, c) for c in cuts[1:-1]], p.states(line, len(line), True)]
        at = pieces.path([p.transfer(line, states[k], states[k + 1]) for k in range(count)])
        ids = [i for k in range(count) for i in p.back(line, states[k][at[k]], states[k + 1][at[k + 1]])]
        assert ids == p.lib.encode(s) == p.encode(s).tolist()
        assert p.decode(ids) == p.lib.decode(ids) == s


def test_max_plus_product_is_associative():
    rng = np.random.default_rng(5)
    a, b, c = (np.where(rng.random((4, 4)) < 0.5, rng.random((4, 4)), -np.inf) for _ in range(3))
    left, right = pieces.times(pieces.times(a, b), c), pieces.times(a, pieces.times(b, c))
    assert np.allclose(np.nan_to_num(left, neginf=-9), np.nan_to_num(right, neginf=-9))


def test_encode_round_trip(spark, documents):
    giant = spark.createDataFrame([(10**6, "x yz" * 50_000), (10**6, "x yz" * 50_000), (10**6 + 1, "q1w2e3r4t5" * 9000)], "doc_id long, text string")
    both = documents.select("doc_id", "text").unionByName(giant)
    got = sorted((r.id, r.text) for r in pieces.encode(both, decoded=True).collect())
    assert got == sorted((r.doc_id, r.text or "") for r in both.collect())


@pytest.mark.parametrize("run", [2, 64])
def test_giant_texts_have_the_ids_of_the_library(spark, monkeypatch, run):
    """Chunks combined in a scan of two levels, with runs of two chunks and of the given length."""
    monkeypatch.setattr(pieces, "RUN", run)
    rng = random.Random(run)
    texts = ["".join(rng.choice("abcdeéthing \n日本☃19.") for _ in range(3000)), "x yz" * 900, "nospacesatall" * 300, "é🙂 " * 1000, "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with open(pieces.MODEL, "rb") as f:
        library = pieces.Pieces(f.read()).lib
    got = {r.id: list(r.ids) for r in pieces.encode(df, giant=500, chunk=200).collect()}
    assert got == {i: library.encode(t) for i, t in enumerate(texts)}


def test_targets():
    got = mixing.targets({"a": 10, "b": 1000, "c": 10, None: 80})
    assert got["a"] == 30 and abs(sum(got.values()) - 1100) < 1e-9 and all(got[s] <= 3 * n + 1e-9 for s, n in {"a": 10, "b": 1000, "c": 10, None: 80}.items())
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_splitting_tree_keeps_quotas():
    q = [17, 0, 100, 3]
    dealt = mixing.splitting_tree(q, 8, 1)
    assert dealt.sum(axis=1).tolist() == q and set(dealt.sum(axis=0).tolist()) <= {15, 15} and (dealt >= 0).all()
    assert (dealt == mixing.splitting_tree(q, 8, 1)).all()


def test_large_urns_follow_the_same_law(monkeypatch):
    rng = np.random.default_rng(1)
    exact = [mixing._drawn(rng, 300, 700, 200) for _ in range(4000)]
    monkeypatch.setattr(mixing, "_URN", 1)
    own = [mixing._drawn(rng, 300, 700, 200) for _ in range(4000)]
    assert abs(np.mean(own) - 60) < 0.4 and abs(np.std(own) - np.std(exact)) < 0.4 and abs(np.mean(exact) - np.mean(own)) < 0.6
    assert mixing._drawn(rng, 5, 0, 3) == 3 and mixing._drawn(rng, 0, 5, 3) == 0 and mixing._drawn(rng, 2, 3, 5) == 2
    big = mixing.splitting_tree([3 * 10**9, 10**9, 7], 4, 2)
    assert big.sum(axis=1).tolist() == [3 * 10**9, 10**9, 7] and np.ptp(big.sum(axis=0)) <= 1 and abs(big[1] - 25 * 10**7).max() < 10**6


def test_mix_is_stable_on_repeated_ids(spark):
    rows = [(7 if i % 3 else None, f"s{i % 3}", " ".join(f"w{i}x{j}" for j in range(i % 40)), "en") for i in range(3000)]
    mixes = []
    for seed, parts in ((1, 3), (2, 11)):
        own = rows.copy()
        random.Random(seed).shuffle(own)
        docs = spark.createDataFrame(own, "doc_id long, source string, text string, lang string").repartition(parts)
        m = mixing.mix(docs, block_words=100)
        mixes.append(sorted((tuple(r) for r in mixing.mixed_rows(m, docs.columns).collect()), key=repr))
        got, words = {}, {}
        for r in mixes[-1]:
            got[r[1]] = got.get(r[1], 0) + len(r[2].split())
        for r in mixing.taken(m).collect():
            words[r.target] = words.get(r.target, 0) + r.taken
        assert sorted(got.values()) == sorted(words.values())
    assert mixes[0] == mixes[1]


def test_mix_counts_equal_rows(spark):
    rows = [(1, "a", "one two three")] * 30 + [(2, "b", "x y")] * 5
    m = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block_words=4)
    out = mixing.mixed_rows(m, ["source", "text"]).collect()
    assert sum(len(r.text.split()) for r in out) == sum(r.taken for r in mixing.taken(m).collect()) == 100


def test_mix_meets_targets(documents):
    m = mixing.mix(documents.select("doc_id", "source", "text"), block_words=200)
    rows = mixing.taken(m).toPandas().merge(documents.select("doc_id", "source", "text").toPandas(), on="doc_id")
    words = rows.text.fillna("").map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    assert (words == rows["size"]).all() and (rows.taken <= 3 * rows["size"]).all()
    for _, own in rows.groupby("source"):
        assert abs(own.taken.sum() - own.target.max()) <= 1
        assert own["size"].sum() == own.source_size.max()
    mixed = mixing.mixed_rows(m, ["doc_id", "source", "text"]).toPandas()
    assert mixed.text.map(lambda t: len(t.split())).groupby(mixed.source).sum().to_dict() == rows.groupby("source").taken.sum().to_dict()
    assert sorted(map(tuple, mixing.taken(m).collect())) == sorted(map(tuple, mixing.taken(mixing.mix(documents.select("doc_id", "source", "text"), block_words=200)).collect()))


def test_mix_draws_come_through_the_tree(spark, documents, monkeypatch):
    docs = documents.select("doc_id", "source", "text")
    plan = lambda shards: mixing.mix(docs, shards=shards, block_words=60)
    m = plan(8)
    draws, quotas = m.draws.toPandas(), m.quotas.toPandas()
    assert not draws.duplicated(["mix_source", "mix_epoch", "mix_bucket", "mix_block"]).any()
    got = draws[~draws.mix_extra].groupby(["mix_source", "mix_epoch", "mix_shard"]).size()
    per_shard = np.zeros(8, int)
    for r in quotas.itertuples():
        assert [got.get((r.mix_source, r.mix_epoch, k), 0) for k in range(8)] == list(r.quota) and r.upto[-1] == r.n
        assert draws[(draws.mix_source == r.mix_source) & (draws.mix_epoch == r.mix_epoch)].mix_words.sum() == r.wanted
        per_shard += np.array(r.quota)
    assert np.ptp(per_shard) <= 1
    words = lambda m: {r.doc_id: r.taken for r in mixing.taken(m).collect()}
    one, other = words(m), words(plan(5))
    assert one != other and sum(one.values()) == sum(other.values()) and one == words(plan(8))
    order = [r.doc_id for r in mixing.shuffled(m, ["doc_id"]).coalesce(1).collect()]
    assert sorted(order) == sorted(r.doc_id for r in mixing.mixed_rows(m, ["doc_id"]).collect()) and order != sorted(order)
    tree = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda q, s, seed: np.array([[n] + [0] * (s - 1) for n in q]).reshape(len(q), s))
    assert words(plan(8)) != one and set(plan(8).draws.toPandas().mix_shard) == {0}
    monkeypatch.setattr(mixing, "splitting_tree", lambda q, s, seed: 0 * tree(q, s, seed))
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):  # no shard has a pool
        plan(8)


def test_mix_keeps_columns_of_any_name(spark):
    rows = [(i, f"s{i % 2}", f"w{i} x", 7, "mine", 1.5) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_size int, mix_shard string, `mix.k1` double")
    m = mixing.mix(docs, block_words=4)
    out = mixing.shuffled(m, docs.columns)
    assert out.columns == docs.columns and {tuple(r)[3:] for r in out.collect()} == {(7, "mine", 1.5)}
    assert {tuple(r)[2:] for r in mixing.mixed_rows(m, ["doc_id", "mix_shard"], shard="s", order="o").select("s", "o", "mix_shard").collect()} == {("mine",)}


def test_empty_texts_of_a_source_are_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 50)
    m = mixing.mix(spark.range(1000).selectExpr("id as doc_id", "'a' as source", "'' as text"))
    assert m.laid.select("mix_bucket").distinct().count() == 20 and mixing.taken(m).where("taken = 0 and shards = ''").count() == 1000


def test_url_rules(spark):
    rows = ["http://a.com/x", "http://x.example.com/en/1", "http://www.example.com/en/1", "http://sub.www.example.com/en/1", "http://notexample.com/en/1", "http://a.NET/es/2?q", "http://a.net/fr/2#f", "http://a.net/de/", "ftp://com", "http://com/"]
    got = {r.host + r.path: (r.rule, r.verdict) for r in urlfilter.judge(spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")).collect()}
    assert got["a.com/x"] == ("com/", "allow") and got["x.example.com/en/1"] == ("example.com/en/", "block")
    assert got["www.example.com/en/1"] == got["sub.www.example.com/en/1"] == ("www.example.com/en/", "allow")
    assert got["notexample.com/en/1"] == ("com/", "allow") and got["a.net/es/2"] == ("net/es/", "block") and got["a.net/fr/2"] == ("net/fr/", "block")
    assert got["a.net/de/"][0] is None and got["com"][0] is None and got["com/"] == ("com/", "allow")


def test_url_tails_count_where_lower_case_is_longer(spark):
    rows = [(i, f"http://h{i}.{'com' if i % 2 else 'net'}/{'es' if i % 4 == 0 else 'fr'}/{'good' if i % 2 else 'bad'}") for i in range(400)]
    rows += [(1000, "http://x.org/" + "İ" * 5 + "bad"), (1001, "http://x.org/" + "İ" * 5 + "good"), (1002, "http://x.org/" + "İ" * 5)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r.score for r in urlfilter.judge(df).collect()}
    assert len({got[1000], got[1001], got[1002]}) == 3 and got[1000] < got[1001]
    line = df.where("page_id = 1000").select(urlfilter._grams(F.col("url"), urlfilter.ORDER).alias("g")).first().g
    assert line[-1].endswith("bad\x03") and len(line) == len(("http://x.org/" + "İ" * 5 + "bad").lower()) + 1


def test_url_scores_are_the_same_without_a_broadcast(spark, folder, monkeypatch):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    want = sorted(tuple(r) for r in urlfilter.judge(pages).collect())
    plain = urlfilter._gains
    monkeypatch.setattr(urlfilter, "_gains", lambda chars, model: plain(chars, model, most=10))
    assert sorted(tuple(r) for r in urlfilter.judge(pages).collect()) == want


def test_url_model_equals_plain_version(spark, folder):
    import math
    from collections import Counter

    pages = spark.read.parquet(f"{folder}/pages.parquet")
    out = urlfilter.judge(pages).collect()
    urls = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    halves = {r.url: r.h for r in pages.selectExpr("url", "pmod(xxhash64(5, url), 2) as h").collect()}
    k = urlfilter.ORDER
    verdict = {urls[r.page_id]: r.verdict for r in out if r.rule is not None}
    count = {"allow": Counter(), "block": Counter()}
    for u, v in verdict.items():
        if halves[u] == 0:
            line = "\x02" * k + u.lower() + "\x03"
            for i in range(k, len(line)):
                for n in range(k + 1):
                    count[v][line[i - n : i + 1]] += 1
    context = {c: Counter() for c in count}
    for c in count:
        for gram, n in count[c].items():
            context[c][len(gram), gram[:-1]] += n

    def p(c, gram):
        n = context[c][len(gram), gram[:-1]]
        if len(gram) == 1:
            return (count[c][gram] + 1) / (n + urlfilter.ALPHABET)
        lower = p(c, gram[1:])
        return lower if n < urlfilter.LEAST_CONTEXT else (count[c][gram] + urlfilter.PRIOR * lower) / (n + urlfilter.PRIOR)

    for r in out:
        u = urls[r.page_id]
        if r.score is not None:
            line = "\x02" * k + u.lower() + "\x03"
            want = sum(math.log(p("allow", line[i - k : i + 1]) / p("block", line[i - k : i + 1])) for i in range(k, len(line))) / (len(u) + 1)
            assert abs(want - r.score) < 3e-6
    # the cut: the bin with the largest difference of the shares of accepted and rejected URLs at or above it
    held = {u: (v, next(r.score for r in out if urls[r.page_id] == u)) for u, v in verdict.items() if halves[u] == 1}
    at = lambda s: max(-urlfilter.BINS, min(urlfilter.BINS, math.floor(round(s * urlfilter.UNIT) / (urlfilter.UNIT // 100))))
    good, bad = ([at(s) for v, s in held.values() if v == kind] for kind in ("allow", "block"))
    share = lambda own, b: sum(x >= b for x in own) / len(own) if own else 0.0
    best = max({*good, *bad}, key=lambda b: (share(good, b) - share(bad, b), b)) * (urlfilter.UNIT // 100) if good or bad else 0
    for r in out:
        if r.rule is None:
            assert r.verdict == ("allow" if r.score is not None and round(r.score * urlfilter.UNIT) >= best else "block")


def test_quotes_equal_sql(spark):
    rows = [(1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "> Hello there\n> How are  you?\nFine, thanks."), (1, 2, "user", "Something else"), (1, 3, "assistant", "On Monday, A wrote:\n> > hello there\n> > how are you?\n> fine, thanks.\nGreat!"), (1, 4, "user", "> great!\nok"), (1, 5, "user", "> unknown\nx"), (2, 0, "user", "> self\nself"), (None, 0, "user", "> Hello there"), (1, None, "user", "> Hello there"), (3, 0, None, None), (3, 1, "a", ""), (3, 1, "a", ""), (4, 0, "u", "rewrapped text that goes on\nand on"), (4, 1, "a", "> rewrapped text\n> that goes on and on\nyes"), (4, 2, "u", "> yes\n>> rewrapped text\ntwice"), (4, 1, "a", "a > b is no quote")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = quotes.link(df)
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(quotes.ORACLE).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in out.collect())
    linked = {(r.conv_id, r.turn): (r.reply_to, r.root_turn, r.depth) for r in out.collect() if r.reply_to is not None}
    assert linked == {(1, 1): (0, 0, 1), (1, 3): (1, 0, 2), (1, 4): (3, 0, 3), (4, 1): (0, 0, 1), (4, 2): (1, 0, 2)}


def test_conversations_in_the_order_of_replies(spark, folder):
    messages = quotes.with_quotations(spark.read.parquet(f"{folder}/conversations.parquet"))
    rows = quotes.link(messages).collect()
    asked = {(r.conv_id, r.turn): r for r in rows}
    odd = [r for r in rows if r.turn % 2 == 1 and (r.conv_id, r.turn - 1) in asked and r.n_quotes]
    assert odd and np.mean([r.reply_to == r.turn - 1 for r in odd]) > 0.8 and all(r.reply_to < r.turn for r in odd if r.reply_to is not None)
    assert all(asked[r.conv_id, r.reply_to].position < r.position for r in rows if r.reply_to is not None)
    for conv in {r.conv_id for r in rows}:
        own = sorted((r for r in rows if r.conv_id == conv), key=lambda r: (r.root_turn, r.depth, r.turn))
        assert [r.position for r in own] == list(range(len(own)))
    whole = quotes.built(quotes.link(messages))
    small = quotes.built(quotes.link(messages), most=2)
    joined = {}
    for r in sorted(small.collect(), key=lambda r: (r.conv_id, r.part)):
        joined[r.conv_id] = joined.get(r.conv_id, "") + r.text
    assert joined == {r.conv_id: r.text for r in whole.collect()} and "\n>" not in "".join(joined.values())
    assert quotes.built(quotes.link(messages.limit(0))).count() == 0
