"""SimHash links, vector codes and whitening against plain versions, and their edge cases."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from jobgrain.llm import codes, queries, simhash, whitening
from jobgrain.llm.codes import Orchard
from tests.llm.test_edges import CLASHES, LONG, ROWS, SCHEMA

SF = "/root/testdata/sf0.001"


# --- fingerprints ---------------------------------------------------------------------------------------------------

def plain_print(text, n=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i:i + n]) for i in range(max(len(words) - n, 0) + 1)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(prints, tau):
    """Smallest member of the component of each fingerprint, by comparing all pairs."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    ordered = np.array(sorted(prints), np.uint64)
    for i, p in enumerate(ordered):
        for q in ordered[i + 1:][np.bitwise_count(ordered[i + 1:] ^ p) <= tau]:
            low, high = sorted((find(int(p)), find(int(q))))
            root[high] = low
    return {p: find(p) for p in prints}


def plain_components(rows, tau=2):
    prints = [(doc, plain_print(text)) for doc, text in rows]
    roots = plain_roots({p for _, p in prints}, tau)
    lowest = {}
    for doc, p in prints:
        if doc is not None:
            lowest[roots[p]] = min(lowest.get(roots[p], doc), doc)
    return [(doc, f"{p:016x}", lowest.get(roots[p])) for doc, p in prints]


def sort(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_simhash_query_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert sort(queries.op11_simhash_gph(spark, SF).collect()) == sort(plain_components([tuple(r) for r in docs.collect()]))


def test_simhash_hash_is_that_of_spark(spark):
    text = "Ärger Mit dem\tCafé  und"
    shingles = ["Ärger mit dem", "mit dem café", "dem café und"]
    want = spark.range(1).select(*[F.xxhash64(F.lit(s)) for s in shingles]).first()
    assert simhash.shingle_hashes(text).view(np.int64).tolist() == list(want)


def near(rng, base, most):
    out = base
    for b in rng.sample(range(64), rng.randint(0, most)):
        out ^= 1 << b
    return out


def signed(p):
    return p - (1 << 64) if p >> 63 else p


@pytest.mark.parametrize("crowd", [1, 4, simhash.CROWD, 10**9])
@pytest.mark.parametrize("tau", [0, 1, 2, 3])
def test_links_give_all_components(spark, tau, crowd):
    """Clusters, chains and one large group of copies with correlated bits; crowded values or not."""
    rng = random.Random(tau)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for base in list(prints)[:12]:
        prints |= {near(rng, base, 4) for _ in range(12)}
    hub = rng.getrandbits(64)
    prints |= {hub ^ (1 << a) ^ (1 << b) for a, b in combinations(range(0, 64, 3), 2)} | {0, 1, 3, (1 << 64) - 1}
    prints |= {rng.getrandbits(12) * 0x0010010010010010 % (1 << 64) for _ in range(60)}
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = simhash.links(df, tau, crowd).collect()
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= tau and a < b for a, b in found)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in found:
        low, high = sorted((find(a & (1 << 64) - 1), find(b & (1 << 64) - 1)))
        root[high] = low
    assert {p: find(p) for p in prints} == plain_roots(prints, tau)


def test_thresholds_are_the_cheapest_that_cover(spark):
    """The chosen thresholds add up to TAU - m + 1 and no other choice of that sum is cheaper by the same estimates."""
    rng = random.Random(5)
    prints = [rng.getrandbits(40) for _ in range(300)] + [rng.getrandbits(64) for _ in range(300)]
    df = spark.createDataFrame([(signed(p),) for p in set(prints)], "fp long")
    for m in (2, 3, 4):
        plan = simhash.allocate(df, 2, (m,))
        assert sorted(b for g in plan.groups for b in g) == list(range(64))
        bits = simhash._bits(df.toPandas()["fp"])[:40]
        chosen, cost = plan.thresholds(bits)
        assert (chosen.sum(0) == 2 - m + 1).all() and chosen.min() >= -1
        prices = [[np.zeros(len(bits))] + [len(simhash.ball(len(g), t)) + plan.candidates(bits, i)[t] for t in range(3)] for i, g in enumerate(plan.groups)]
        every = [sum(prices[i][t + 1] for i, t in enumerate(ts)) for ts in np.ndindex(*[4] * m) for ts in [tuple(t - 1 for t in ts)] if sum(ts) == 3 - m]
        assert np.allclose(cost, np.min(every, axis=0))


def test_correlated_bits_share_a_group(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(400):
        p, twin = rng.getrandbits(64), rng.getrandbits(1)
        for b in (0, 17, 33, 60):
            p = p & ~(1 << b) | twin << b
        rows.append((signed(p),))
    _, related = simhash.correlation(spark.createDataFrame(rows, "fp long"))
    assert related[0, 17] > 0.99 and any({0, 17, 33, 60} <= set(g) for g in simhash.grouped(related, 4))


def test_simhash_edges(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(f"clash {c}") for c in [*CLASHES, "fp", "low", "value", "part", "crowded", "component"]})
    assert sort(simhash.near_copies(docs).select("doc_id", "fingerprint", "component_id").collect()) == sort(plain_components([r[:2] for r in ROWS]))
    assert simhash.near_copies(docs.where("false")).collect() == []
    unnamed = simhash.near_copies(docs.where("doc_id is null")).collect()
    assert len(unnamed) == 2 and all(r.component_id is None for r in unnamed)


def test_simhash_large_group_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr("jobgrain.llm.common.BROADCAST_ROWS", 1)
    rows = [(i, "one two three four") for i in range(50)] + [(100 + i, f"other {i} text of words") for i in range(20)] + [(None, "one two three four")]
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "fingerprint", "component_id").collect()
    assert sort(got) == sort(plain_components(rows))


# --- codes ----------------------------------------------------------------------------------------------------------

def plain_codes(rows, parts=16, entries=64, rounds=2):
    """rows of (id, label, whole vector), in order of id."""
    width = len(rows[0][2]) // parts
    cut = [[tuple(v[p * width:(p + 1) * width]) for p in range(parts)] for _, _, v in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assigned(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), i) for i, entry in enumerate(books[p]))

    for _ in range(rounds):
        moved = []
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(assigned(p, c[p])[1], []).append(c[p])
            moved.append([tuple(sum(x) // len(groups[i]) for x in zip(*groups[i])) if i in groups else e for i, e in enumerate(books[p])])
        books = moved
    final = [[assigned(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in final]
    sums = {}
    for (_, label, _), e in zip(rows, errors):
        sums[label] = sums.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, label, "".join(f"{x:02x}" for _, x in f), e, sums[label], sha) for (i, label, _), f, e in zip(rows, final, errors)]


def whole_rows(df, scale=256):
    return [(r.vec_id, r.label, [int(np.floor(scale * float(x))) for x in r.embedding]) for r in df.orderBy("vec_id").collect()]


def test_codes_query_equals_plain_version(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert sort(queries.op12_orchard_codes(spark, SF).collect()) == sort(plain_codes(whole_rows(df)))


@pytest.mark.parametrize("kind", [np.int64, object])
def test_orchard_finds_the_nearest_with_ties(kind):
    rng = np.random.default_rng(1)
    entries = rng.integers(-6, 7, (64, 3)).astype(kind)  # a small grid: many equal distances and equal entries
    parts = rng.integers(-9, 10, (700, 3)).astype(kind)
    best, near_, measured = Orchard(entries).nearest(parts)
    gaps = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
    assert (best == np.argmin(gaps, 1)).all() and (near_ == gaps.min(1)).all()
    spread = rng.integers(-1000, 1000, (64, 3)).astype(kind)
    assert Orchard(spread).nearest(rng.integers(-1000, 1000, (700, 3)).astype(kind))[2] < 0.7 * 64 * 700


VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows(spark, more=()):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], rng.choice([0, 1, None])) for i in range(90)]
    rows += [(3, rows[4][1], 1), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2]), *more]
    rows += [(200, None, 1), (201, [None] + [0.0] * 7, 1), (202, [float("nan")] * 8, 0), (203, [float("inf")] * 8, 0)]
    return spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(f"clash {c}") for c in ("x", "c", "code", "error", "id", "unique", "n", "part", "_salt", "m")})


def test_codes_edges(spark, monkeypatch):
    df = vector_rows(spark)
    kept = df.where("vec_id < 200")
    rows = sorted(((r.vec_id, r.label, [int(np.floor(256 * x)) for x in r.embedding]) for r in kept.collect()), key=lambda r: (r[0], r[2]))
    want = plain_codes(rows, 4, 64)
    assert sort(codes.compress(df, parts=4).collect()) == sort(want)
    monkeypatch.setattr("jobgrain.llm.common.BROADCAST_ROWS", 0)
    assert sort(codes.compress(df, parts=4).collect()) == sort(want)
    few = kept.where("vec_id in (7, 8)")
    assert [r.error for r in codes.compress(few, parts=2).collect()] == [0, 0]
    assert codes.compress(df.where("false"), parts=4).collect() == []
    with pytest.raises(ValueError):
        codes.compress(df, parts=3)
    with pytest.raises(ValueError):
        codes.compress(df.union(df.limit(1).withColumn("embedding", F.array(F.lit(1.0).cast("float")))), parts=1)


def test_codes_of_very_large_numbers(spark):
    big = [(300 + i, [float((-1) ** i * 1e15 * (i + 1))] * 8, 2) for i in range(6)] + [(None, [0.5] * 8, 2)]
    df = vector_rows(spark, big)
    rows = [(r.vec_id, r.label, [int(np.floor(256 * x)) for x in r.embedding]) for r in df.where("vec_id < 200 or vec_id >= 300 or vec_id is null").collect()]
    want = {r[:3] + (r[3] if r[3] < 1 << 63 else None,) for r in plain_codes(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2])), 4, 16)}
    assert {tuple(r)[:4] for r in codes.compress(df, parts=4, entries=16).collect()} == want


# --- whitening ------------------------------------------------------------------------------------------------------

def plain_whitening(rows):
    """Whitened values (up to sign), eigenvalue shares and exact deviations by a dense symmetric solver."""
    x = np.array([v for _, v in rows], object)
    distinct = np.array(sorted({tuple(v) for v in x.tolist()}), object)
    n, sums = len(distinct), distinct.sum(0)
    about = (n * distinct - sums).astype(np.float64) / n
    values, vectors = np.linalg.eigh(about.T @ about / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = ((n * x - sums).astype(np.float64) / n) @ vectors / np.sqrt(np.maximum(values, 1e-300))
    return n, white, values / values.sum(), [int(d) for d in ((n * x - sums) ** 2).sum(1)]


def test_whitening_query_equals_dense_solution(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, [int(np.floor(64 * float(c))) + 1_000_000 for c in r.embedding]) for r in df.orderBy("vec_id").collect()]
    n, white, shares, deviations = plain_whitening(rows)
    got = queries.op13_embedding_whitening(spark, SF).orderBy("vec_id", "component").collect()
    assert len(got) == 16 * len(rows) and {r.n for r in got} == {n}
    assert [r.deviation for r in got[::16]] == deviations
    mine = np.array([r.whitened for r in got]).reshape(-1, 16)
    signs = np.sign((mine * white[:, :16]).sum(0))
    assert np.abs(mine * signs - white[:, :16]).max() < 1e-7
    assert np.allclose([r.explained for r in got[:16]], shares[:16], rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_jacobi_on_hard_matrices():
    rng = np.random.default_rng(2)
    for d, rank in ((1, 1), (2, 2), (5, 3), (16, 16), (33, 7)):
        scales = np.logspace(0, -5, rank)
        b = rng.normal(size=(d, rank)) * scales
        a = b @ b.T
        factor = whitening.pivoted_cholesky(a)
        assert factor.shape[1] == rank and np.abs(factor @ factor.T - a).max() < 1e-12 * np.abs(a).max()
        values, vectors = whitening.one_sided_jacobi(factor)
        assert np.abs(vectors.T @ vectors - np.eye(rank)).max() < 1e-15
        assert np.abs(a @ vectors - vectors * values).max() < 1e-14 * values[0]
        # The dense solver is right to about eps of the largest eigenvalue.
        assert np.allclose(values.astype(float), np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-12, atol=1e-14 * float(values[0]))
    assert whitening.pivoted_cholesky(np.zeros((4, 4))).shape == (4, 0)
    equal = whitening.one_sided_jacobi(whitening.pivoted_cholesky(np.eye(6)))[0]  # one eigenvalue, six times
    assert np.allclose(equal.astype(float), 1.0)


def test_whitening_edges(spark):
    df = vector_rows(spark, [(None, [0.25] * 8, 1)])
    kept = [(r.vec_id, [int(np.floor(64 * x)) + 1_000_000 for x in r.embedding]) for r in df.where("vec_id < 200 or vec_id is null").collect()]
    n, white, shares, deviations = plain_whitening(kept)
    got = whitening.whiten(df).collect()
    assert len(got) == 8 * len(kept) and {r.n for r in got} == {n} and n < len(kept)
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviations)
    assert np.allclose([r.explained for r in got[:8]], shares, rtol=1e-9)
    ordered = sorted(abs(w) for w in white[:, 7])
    assert np.allclose(sorted(abs(r.whitened) for r in got if r.component == 8), ordered, atol=1e-8)
    assert whitening.whiten(df.where("false")).collect() == []
    assert whitening.whiten(df.where("vec_id = 5")).collect() == []  # one distinct vector has no spread
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0) for i in range(5)], VECTORS)
    assert {r.component for r in whitening.whiten(line).collect()} == {1} and len(whitening.whiten(line).collect()) == 5


def test_whitening_of_large_numbers_is_centred(spark):
    """A mean far above the spread, and products beyond a double's digits: nothing is lost before centring."""
    rows = [(i, [1e13 + (i * 7 % 11), -1e13 + (i * i % 13), 3e13 + 3e4 * (i % 5)], 0) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = [(i, [int(np.floor(64 * x)) + 1_000_000 for x in v]) for i, v, _ in rows]
    n, _, shares, deviations = plain_whitening(whole)
    got = whitening.whiten(df).orderBy("vec_id", "component").collect()
    assert [r.deviation for r in got[::3]] == [d if d < 1 << 63 else None for d in deviations]
    assert got[0].identity_error < 1e-6 and len(got) == 120
