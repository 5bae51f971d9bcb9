"""Embedding near-dedup, prefix trie and centroid clustering against brute force and DuckDB."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.compare import duck_rows, rows_of
from tierwise.llm import centroid_clustering, embedding_dedup, prefix_trie

VECTORS = "vec_id bigint, embedding array<double>, label int, extra string"


# embedding near-dedup


def _links(rows, limit):
    """vec_id -> (n_links, component_id) of rows of distinct ids, by all pairs."""
    good = [(i, np.array(v, float), y) for i, v, y, *_ in rows if v and y is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = defaultdict(set)
    for a, (i, v, y) in enumerate(good):
        for j, w, z in good[:a]:
            if y == z and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= limit:
                near[i].add(j)
                near[j].add(i)
    out = {}
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(near[i]), min(seen))
    return out


def _groups(seed, groups, each, d, noise, labels=2):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = rng.standard_normal(d)
        for _ in range(each):
            v = base + noise * rng.standard_normal(d)
            out.append((len(out), (v * rng.uniform(0.5, 2)).tolist(), g % labels, "x"))
    return out


@pytest.mark.parametrize("d, noise, block", [(64, 0.13, 16), (8, 0.1, 256), (200, 0.12, 256)])
def test_links_are_found(spark, d, noise, block):
    rows = _groups(d, 12, 40, d, noise)
    rows += [(len(rows) + i, v, y, "far") for i, (_, v, y, _) in enumerate(_groups(d + 1, 300, 1, d, noise))]
    expected = _links(rows, 0.98)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, VECTORS).repartition(5), block=block).collect()}
    assert set(got) == set(expected)
    assert all(got[i][0] <= n for i, (n, _) in expected.items())
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in expected.values())
    assert sum(got[i][1] == c for i, (_, c) in expected.items()) >= 0.99 * len(rows)


def test_hot_vector_of_copies_and_near_copies(spark):
    """A third of all rows are copies of one vector, and another third near copies, all in blocks of 16."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal(64)
    rows = [(i, base.tolist(), 1, "") for i in range(150)]
    rows += [(150 + i, (base + 0.02 * rng.standard_normal(64)).tolist(), 1, "") for i in range(150)]
    rows += [(300 + i, rng.standard_normal(64).tolist(), 1, "") for i in range(150)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, VECTORS), block=16).collect()}
    assert {i: x[:2] for i, x in got.items()} == _links(rows, 0.98)
    assert [i for i, x in got.items() if x[2]].count(0) == 1 and sum(x[2] for x in got.values()) == 151


def test_unusable_vectors_stand_alone(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0], 1, ""), (2, [2.0, 0.0, 0.0], 1, ""), (3, [1.0, 0.0, 0.0], 2, ""), (4, [1.0, 0.0, 0.0], None, ""), (5, [1.0, 0.0, 0.0], None, ""), (6, None, 1, ""), (7, [0.0, 0.0, 0.0], 1, ""),
        (8, [0.0, 0.0, 0.0], 1, ""), (9, [1.0, None, 0.0], 1, ""), (10, [nan, 0.0, 0.0], 1, ""), (11, [inf, 0.0, 0.0], 1, ""), (12, [], 1, ""), (13, [1.0, 0.0], 1, ""), (14, [1e200, 0.0, 0.0], 1, ""), (15, [1e-200, 0.0, 0.0], 1, ""), (16, [-1.0, 0.0, 0.0], 1, ""),
    ]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == {i: (3, 1, i == 1) if i in (1, 2, 14, 15) else (0, i, True) for i in range(1, 17)}


def test_vectors_repeated_rows_and_null_ids(spark):
    rows = [(1, [1.0, 2.0], 1, ""), (1, [1.0, 2.0], 1, ""), (None, [1.0, 2.0], 1, ""), (None, [5.0, -2.0], 1, "")]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()), key=repr)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (None, 0, None, True), (None, 2, 1, False)]


def test_vectors_empty_table_and_clashing_columns(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    rows = spark.createDataFrame([(1, [1.0, 2.0], 1, 9, 9), (2, [1.0, 2.0], 1, 9, 9)], "vec_id bigint, embedding array<float>, label int, node int, n_links int")
    assert sorted(map(tuple, embedding_dedup.near_vectors(rows).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_recall_on_all_vectors(spark, data):
    """The near copies of a table's own vectors, and its links, are found."""
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label % 3, "") for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    rng = np.random.default_rng(1)
    rows += [(1_000_000 + i, (np.array(v) + 0.023 * rng.standard_normal(len(v))).tolist(), y, "") for i, v, y, _ in rows]
    expected = _links(rows, 0.98)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    assert sum(n for n, _ in expected.values()) > 100
    assert sum(got.values()) >= 0.97 * sum(n for n, _ in expected.values())


# prefix trie


def _trie(rows):
    """The trie by brute force: rows of (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    plain = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    made = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = plain.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, v in sorted(made.items()):
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []

    def sums(p):
        leaves, saved = (0 if kids[p] else 1), (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        for k in kids[p]:
            a, b = sums(k)
            leaves, saved = leaves + a, saved + b
        ends = ",".join(str(c) for c in members[p] if len(made[c]) == len(p))
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if made:
        sums(())
    return sorted(out, key=repr)


def _got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[x] for x in names) for r in df.select(*names).collect()), key=repr)


TURNS = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("seed, most, piece", [(1, 6, 4096), (2, 30, 4), (3, 3, 1)])
def test_trie_of_random_conversations(spark, monkeypatch, seed, most, piece):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.permutation(400)[:120].tolist():
        n = int(rng.integers(1, most + 1))
        # few different texts, so that prefixes are shared beyond the borrowed turns
        words = [("user", "aé"[: int(rng.integers(0, 3))]) for _ in range(n)]
        rows += [(c, k, r, t) for k, (r, t) in enumerate(words)]
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], TURNS).repartition(6)
    assert _got(prefix_trie.trie(df)) == _trie(rows)


def test_trie_nested_chains(spark):
    """Each conversation goes one turn further than the one before it: chains hang on chains, and many copies end in one node."""
    rows = [(c * 5, k, "user", f"t{k}" if k < 15 else f"own{c}") for c in range(24) for k in range(min(c, 15) + 2)]
    rows += [(1000 + 5 * c, k, "user", f"t{k}") for c in range(60) for k in range(4)]
    assert _got(prefix_trie.trie(spark.createDataFrame(rows, TURNS))) == _trie(rows)


def test_trie_odd_rows(spark):
    rows = [
        (5, None, None, "first"), (5, 3, "user", None), (5, 1, "user", ""), (5, 1, "user", ""), (6, 0, "a", "b"), (7, 0, "ab", ""), (None, 1, "user", "none"), (8, 9, "user", "x" * 100_000),
        (10, 0, "user", "same"), (12, 0, "user", "same"), (23, 0, "user", "q"), (24, 0, None, None),
    ]
    assert _got(prefix_trie.trie(spark.createDataFrame(rows, TURNS))) == _trie(rows)
    assert _got(prefix_trie.trie(spark.createDataFrame([], TURNS))) == []
    wide = spark.createDataFrame([(5, 0, "user", "a", 1, 2), (9, 0, "user", "a", 1, 2)], TURNS + ", depth int, owner int")
    assert _got(prefix_trie.trie(wide)) == _trie([(5, 0, "user", "a"), (9, 0, "user", "a")])


def test_trie_against_duckdb(spark, data):
    assert rows_of(prefix_trie.op12_prefix_trie(spark, data)) == duck_rows(prefix_trie.ORACLE, data)


# centroid clustering


def _clusters(rows, k, rounds, width):
    """vec_id -> (cluster, distance) and centroids, by measuring every distance."""
    kept = [(i, [math.floor(64 * float(x)) if abs(x) < 1e300 else int(x) * 64 for x in v]) for i, v, *_ in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((x for x in kept if x[0] is not None), key=lambda x: hashlib.sha256(f"1:{x[0]}".encode()).hexdigest())[:k]
    cents = [q for _, q in first]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda q: min(range(len(cents)), key=lambda c: (dist(q, cents[c]), c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, q in kept:
            own[pick(q)].append(q)
        cents = [[sum(x) // len(own[c]) for x in zip(*own[c], strict=True)] if own[c] else cents[c] for c in range(len(cents))]
    return sorted(((i, pick(q), min(dist(q, cents[pick(q)]), 2**63 - 1)) for i, q in kept), key=repr), cents


@pytest.mark.parametrize("seed, k, spread", [(1, 16, 1.0), (2, 5, 0.02), (3, 12, 0.1)])
def test_clusters_are_exact(spark, seed, k, spread):
    """Small spreads make whole numbers with many ties and centroids that are equal."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 4)) * 5 * spread
    rows = [(i, (centres[i % 6] + spread * rng.standard_normal(4)).tolist()) for i in range(400)]
    found, cents = centroid_clustering.clustered(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5), k=k, components=4)
    expected, expected_cents = _clusters(rows, k, 3, 4)
    assert sorted(map(tuple, found.collect()), key=repr) == expected
    assert cents.tolist() == expected_cents


def test_exponion_measures_fewer_distances():
    rng = np.random.default_rng(4)
    centres = rng.integers(-2000, 2000, (32, 8))
    q = np.concatenate([c + rng.integers(-60, 60, (200, 8)) for c in centres])
    first = centroid_clustering.Neighbours(centres, None)
    a, upper, lower, n = centroid_clustering.assigned(q, centres, first, np.full(len(q), -1), np.zeros(len(q)), np.zeros(len(q)))
    assert n == len(q) * 32
    moved = centres + rng.integers(-40, 40, centres.shape)
    near = centroid_clustering.Neighbours(moved, centres)
    b, _, _, n = centroid_clustering.assigned(q, moved, near, a, upper, lower)
    assert (b == centroid_clustering.squared(q, moved).argmin(axis=1)).all()
    assert n < len(q) * 8


def test_clusters_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (2, None), (3, [1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [-0.001, 0.0]), (None, [9.0, 9.0]), (1, [0.5, 1.0]), (8, [1e25, -1e25]), (9, [1e25, -1e25]), (10, [3e4, 7.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, cluster int")
    for k in (2, 4, 50):
        found, cents = centroid_clustering.clustered(df, k=k, components=2)
        expected, expected_cents = _clusters(rows, k, 3, 2)
        assert sorted(map(tuple, found.collect()), key=repr) == expected
        assert [[int(x) for x in c] for c in cents] == expected_cents
    assert centroid_clustering.clustered(df.limit(0), components=2)[0].count() == 0


def test_clusters_against_duckdb(spark, data):
    assert rows_of(centroid_clustering.op13_centroid_clustering(spark, data)) == duck_rows(centroid_clustering.ORACLE, data)
