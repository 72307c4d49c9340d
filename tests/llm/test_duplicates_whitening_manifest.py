"""Circulant MinHash, whitening and the hash tree against brute force and SQL, with nulls, ties, repeats and empty tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest import SF
from oracle import same
from pyspark.sql import functions as F

from tesserine.llm import merkle, minhash, registry, whitening

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sid string, leaf string, g long, i long, band long"


@pytest.mark.parametrize("name", ["op11_minhash_duplicates", "op13_merkle_manifest"])
def test_query_equals_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.SQL[name], SF)


def table_of(spark, rows):
    """rows of (doc_id, text, source); the other columns clash with names used inside."""
    return spark.createDataFrame([(k, t, None if (k or 0) % 3 else "en", s, (k or 0) * 7, "x", "y", 1, 2, 3) for k, t, s in rows], DOCS)


# ---- near duplicates ----


def shingles(text, size):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def clustered(rows, size, percent):
    """(doc_id, set size, smallest doc_id that links reach, kept) by comparing all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[top(a)] = top(b)
    least = collections.defaultdict(lambda: None)
    for i, (k, _) in enumerate(rows):
        if k is not None and (least[top(i)] is None or k < least[top(i)]):
            least[top(i)] = k
    found = [least[top(i)] if sets[i] else k for i, (k, _) in enumerate(rows)]
    return sorted(((k, len(s), c, k == c) for (k, _), s, c in zip(rows, sets, found, strict=True)), key=str)


def got(df, **options):
    return sorted((tuple(r) for r in minhash.near_duplicates(df, **options).drop("k1", "k2").collect()), key=str)


def test_near_duplicates_of_edge_cases(spark):
    long = " ".join(f"w{i * i % 3001}" for i in range(6000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "one", "a"), (None, "ONE", "b"), (6, "one", "a"), (7, "One Two", "b"), (7, "one two", "b"), (None, None, None)]
    rows += [(8, long, "a"), (9, "x " + long, "a"), (9, "x " + long, "a"), (10, long[: len(long) // 2], None), (None, "lonely words stand here alone", "c"), (11, "é ü é ü", "a"), (12, "É ü É ü", "a")]
    for size in (2, 5):
        assert got(table_of(spark, rows), size=size) == clustered([r[:2] for r in rows], size, 80)
    assert got(table_of(spark, rows[:0])) == []


def chains(n, words, seed):
    """Texts that change by a few words from one to the next, shuffled: many lie just around the threshold."""
    rng, out = np.random.default_rng(seed), []
    now = [f"v{x}" for x in rng.integers(0, 5000, words)]
    for i in range(n):
        if i % 12 == 0:
            now = [f"v{x}" for x in rng.integers(0, 5000, words)]
        for at in rng.integers(0, words, int(rng.integers(1, 1 + words // 12))):
            now[at] = f"v{rng.integers(0, 5000)}"
        out.append(" ".join(now))
    return [(int(k), t) for k, t in zip(rng.permutation(n), out, strict=True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_around_the_threshold(spark, seed, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4000)
    monkeypatch.setattr(minhash, "ASKING", 2000)
    monkeypatch.setattr(minhash, "PARTNERS", 3000)
    rows = chains(240, 60, seed)
    want = clustered(rows, 2, 80)
    assert 20 < len({r[2] for r in want}) < 220
    assert got(table_of(spark, [(*r, "s") for r in rows]), size=2) == want


def test_texts_of_common_sentences(spark):
    """Many texts out of the same few sentences: bands hold sets that no link connects, and all are told apart."""
    rng = np.random.default_rng(5)
    sentences = [" ".join(f"s{i}w{j}" for j in range(8)) for i in range(40)]
    rows = [(i, " ".join(sentences[j] for j in sorted(rng.choice(40, 22, replace=False)))) for i in range(300)]
    assert got(table_of(spark, [(*r, "s") for r in rows]), size=2) == clustered(rows, 2, 80)


@pytest.mark.parametrize(("changed", "blocks"), [(9, None), (7, None), (7, 20000)])
def test_alike_but_unlinked_texts_make_no_table_of_pairs(spark, changed, blocks, monkeypatch):
    """A large group whose pairs are all alike, below 80 percent (9 words changed) or right around it (7): no table has
    more rows than the sets have bands, although every pair is decided."""
    rng, base = np.random.default_rng(changed), [f"b{i}" for i in range(200)]
    rows = []
    for k in range(170):
        words = list(base)
        for at in rng.choice(200, changed, replace=False):
            words[at] = f"own{k}at{at}"
        rows.append((k, " ".join(words)))
    counts, real = collections.defaultdict(int), minhash.settle

    def counted(df, name):
        out = real(df, name)
        counts[name] = max(counts[name], out.count())
        return out

    monkeypatch.setattr(minhash, "settle", counted)
    if blocks:
        monkeypatch.setattr(minhash, "BLOCK", blocks)
        monkeypatch.setattr(minhash, "ASKING", blocks)
    want = clustered(rows, 2, 80)
    assert len({r[2] for r in want}) > 60
    assert got(table_of(spark, [(*r, "s") for r in rows]), size=2) == want
    assert blocks or max(counts.values()) <= minhash.BANDS * len(rows) < len(rows) * (len(rows) - 1) // 2, dict(counts)
    assert counts["minhash-across"] < len(rows) * minhash.BANDS


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
    for share in (0.5, 0.8, 0.95):
        cut = int(len(base) * 2 * share / (1 + share))
        step = len(base) - cut
        a, b = base[: len(base) - step // 2 - step % 2], base[step // 2 :]
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = minhash.signatures_of([a, b], 260)
        assert abs(np.mean(x == y) - truth) < 0.1
    x = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(minhash.permute(x, minhash.RANK))) == len(x)


# ---- whitening ----

VECTORS = "vec_id long, embedding array<double>, component int, x string, n long"


def whitened(vectors, most=16):
    """vec_id -> deviation, whitened values; and the shares of variance; eigenvectors up to their sign."""
    x = {k: [int(np.floor(64 * c)) + 1000000 for c in v] for k, v in vectors.items()}
    fit = np.array(sorted({tuple(v) for v in x.values()}), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = ((fit * n - s) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = int((values[:most] > 1e-9 * values[0]).sum())
    rows = {}
    for key, v in x.items():
        d = np.array(v, object) * n - s
        rows[key] = int((d**2).sum()), np.abs((d / n).astype(float) @ axes[:, :k] / np.sqrt(values[:k]))
    return n, rows, values[:k] / values.sum()


def check_whitening(df, vectors, **options):
    n, rows, shares = whitened(vectors)
    found = collections.defaultdict(dict)
    for r in whitening.whiten(df, **options).collect():
        found[r["vec_id"]][r["component"]] = r
    assert set(found) == set(vectors)
    for key, (deviation, values) in rows.items():
        assert sorted(found[key]) == list(range(1, len(shares) + 1))
        for c, r in found[key].items():
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert abs(abs(r["whitened"]) - values[c - 1]) < 1e-6
            assert abs(r["explained"] / shares[c - 1] - 1) < 1e-4
            assert r["identity_error"] < 1e-4


def test_whitening_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in df.collect()}
    vectors = {k: v for k, v in vectors.items() if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    check_whitening(df, vectors)
    signs = whitening.whiten(df).filter("component <= 2").groupBy("component").agg(F.sum("whitened").alias("s"), F.max("whitened").alias("m")).collect()
    assert all(r["m"] > 0 for r in signs)


def test_whitening_drops_unusable_vectors(spark):
    rng = np.random.default_rng(0)
    good = {i: rng.normal(size=5) * [9, 5, 3, 2, 1] for i in range(40)}
    good[40] = good[3]  # repeated vectors count once in the fit
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0, 3.0, 4.0]), (53, [1.0, float("nan"), 2.0, 3.0, 4.0]), (54, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (55, [1.0, 2.0]), (56, [1e300, 0.0, 0.0, 0.0, 0.0])]
    rows = [*good.items(), *bad, (7, good[7])]
    df = spark.createDataFrame([(k, None if v is None else [None if c is None else float(c) for c in v], 9, "z", 1) for k, v in rows], VECTORS)
    check_whitening(df, good)
    assert whitening.whiten(df).filter("vec_id = 7").count() == 10
    assert whitening.whiten(df.filter("vec_id >= 50 AND vec_id <> 55")).count() == 0
    one = df.filter("vec_id IN (3, 40)")  # a single distinct vector has no variance
    assert whitening.whiten(one).collect() == [] and whitening.whiten(df.limit(0)).collect() == []


def test_whitening_of_few_directions_and_large_numbers(spark):
    """Vectors on a plane have two components; far entries keep exact deviations."""
    rng = np.random.default_rng(1)
    plane = {i: (np.array([a, b, a + b, a - b]) + 2.0**30).tolist() for i, (a, b) in enumerate(rng.integers(-1000, 1000, (60, 2)).tolist())}
    df = spark.createDataFrame([(k, v, 0, "", 0) for k, v in plane.items()], VECTORS)
    check_whitening(df, plane)
    assert whitening.whiten(df).select(F.max("component")).first()[0] == 2
    far = spark.createDataFrame([(1, [1e12, 0.0], 0, "", 0), (2, [-1e12, 1.0], 0, "", 0), (None, [3.0, 1.0], 0, "", 0)], VECTORS)
    # (n * x - S)**2 summed is beyond 64 bits for the two far ones
    assert {r["vec_id"]: r["deviation"] for r in whitening.whiten(far).collect()}[None] < 10**6
    assert {r["deviation"] for r in whitening.whiten(far).filter("vec_id IS NOT NULL").collect()} == {None}


# ---- hash tree ----


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def packed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(level):
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, path in enumerate(paths):
            first, place = at[k] // 3 * 3, at[k] % 3
            run = level[first : first + 3]
            path.append(("".join(run[:place]), "".join(run[place + 1 :])))
            at[k] //= 3
        level = [h("".join(level[j : j + 3])) for j in range(0, len(level), 3)]
    return level[0] if level else None, paths


def manifested(docs):
    """(doc_id, leaf, subroot, root, proof digest, folded root) of each row."""
    leaf = lambda d, t: h("".join(map(packed, (d["doc_id"], d["source"], d["lang"], d["n_chars"], t))))
    groups = collections.defaultdict(list)
    for d in docs:
        groups[d["source"]].append((d, leaf(d, d["text"])))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in sources:
        groups[s].sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        built[s] = tree([x for _, x in groups[s]])
    root, tops = tree([built[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for (d, own), path in zip(groups[s], built[s][1], strict=True):
            text = d["text"]
            if text is not None and d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now, path = leaf(d, text), [*path, *top]
            for left, right in path:
                now = h(left + now + right)
            out.append((d["doc_id"], own, built[s][0], root, h("".join(a + b for a, b in path)), now, now == root))
    return sorted(out, key=str)


def op13_of(df, monkeypatch):
    monkeypatch.setattr(merkle, "table", lambda *_: df)
    return sorted((tuple(r) for r in merkle.op13(df.sparkSession, "").collect()), key=str)


@pytest.mark.parametrize(("levels", "held"), [(10, 1 << 15), (1, 3), (2, 1)])
def test_manifest(spark, monkeypatch, levels, held):
    """Sizes around powers of three, null and odd sources, repeated rows, null ids; trees in one round and in many."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "HELD", held)
    rows, k = [], 0
    for source, n in ((None, 10), ("", 1), ("a", 27), ("é", 28), ("z", 2), ("Z", 82), ("𝄞", 3), ("￿", 4)):
        for _ in range(n):
            rows.append((k, None if k % 11 == 0 else f"text {k}\nmore\n" * (k % 5), source))
            k += 1
    rows += [(5, "text", "a"), (5, "text", "a"), (None, "no\nid", "a"), (None, None, None), (k + 1, "\n" * 100000 + "x" * 300000, "Z")]
    df = table_of(spark, rows)
    assert op13_of(df, monkeypatch) == manifested([r.asDict() for r in df.collect()])


def test_manifest_of_few_rows(spark, monkeypatch):
    for rows in ([], [(1, "a\nb", "s")], [(1, "a", "s"), (2, "b\n", "s")], [(1, "a", None), (2, "b\n", "s")]):
        df = table_of(spark, rows)
        assert op13_of(df, monkeypatch) == manifested([r.asDict() for r in df.collect()])
