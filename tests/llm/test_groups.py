"""Operators 7 and 10 and the components they share, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicgauge.llm import near_duplicates, vector_links
from civicgauge.llm.components import components
from civicgauge.llm.queries import ORACLES, QUERIES
from civicgauge.llm.tasks import map_groups
from tests.llm.cases import AWKWARD, documents
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


def roots_of(nodes, pairs):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("name", ["op7_vector_links", "op10_near_duplicates"])
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), ORACLES[name], connect(FOLDER)) == []


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    pairs += [(rng.randint(300, 340), rng.randint(300, 340)) for _ in range(20)]
    rng.shuffle(pairs)
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    nodes = {n for a, b in pairs for n in (a, b) if a != b}
    assert found | {r: r for r in found.values()} == {n: r for n, r in roots_of(nodes, pairs).items()}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_components_of_links_whose_marks_add_up_past_64_bits(spark):
    """Links that are all hashed to large numbers stand in for the hundreds of thousands of a large table."""
    pairs = spark.range(8_000).select((2 * F.col("id") + 1).alias("a"), (2 * F.col("id")).alias("b"))
    pairs = pairs.filter(F.shiftright(F.xxhash64("a", "b"), 8) > 1 << 54)
    assert sum(r[0] for r in pairs.select(F.shiftright(F.xxhash64("a", "b"), 8)).collect()) >= 1 << 63
    nodes = sorted(r.a for r in pairs.collect())
    assert sorted((r.node, r.root) for r in components(pairs).collect()) == [(a, a - 1) for a in nodes]


# ---- vectors ----

def test_decoding_finds_all_filters_over_the_threshold():
    rng = np.random.default_rng(0)
    units = rng.standard_normal((20, 12))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    words = 5
    rotation, code = vector_links.product_code(12, words)
    every = np.array([np.concatenate([code[b, k] for b, k in enumerate(ks)]) for ks in np.ndindex(*[words] * 4)]) / 2
    scores = units @ rotation @ every.T
    from statistics import NormalDist
    threshold = NormalDist().inv_cdf(1 - 16 / words ** 4) / np.sqrt(12)
    for row, found in zip(scores, vector_links.decode(units, words)):
        over = min(threshold, row.max() - vector_links.MARGIN)
        near = np.abs(row - over) < 1e-9
        assert set(np.flatnonzero((row >= over) & ~near)) <= set(found.tolist()) <= set(np.flatnonzero((row >= over) | near))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, size string, filter int")


def test_links_of_a_hot_group_in_tiles(spark):
    """A label with a large group of near copies, cut into tiles of a few, against all pairs."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    rows = [centre + 0.09 * rng.standard_normal(16) for _ in range(90)] + [rng.standard_normal(16) for _ in range(30)]
    rows += [rows[0], rows[0], rows[95]]
    rows = [np.float32(r) for r in rows]
    labels = [1] * 110 + [2] * 10 + [1, 1, 2]
    df = vectors(spark, [(i, r.tolist(), b, "s", 0) for i, (r, b) in enumerate(zip(rows, labels))])
    unit = np.array(rows, dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (np.array(labels)[:, None] == labels) & ~np.eye(len(rows), dtype=bool)
    roots = roots_of(range(len(rows)), zip(*map(list, np.nonzero(linked))))
    found = {r.vec_id: r for r in vector_links.near_vectors(df, tile=8).collect()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in found.items()} == {
        i: (int(linked[i].sum()), roots[i], roots[i] == i) for i in range(len(rows))}


def test_vectors_that_link_with_nothing(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, None, 1, "", 0), (1, [], 1, "", 0), (2, [0.0, 0.0], 1, "", 0), (3, [1.0, None], 1, "", 0), (4, [1.0, nan], 1, "", 0),
            (5, [inf, 1.0], 1, "", 0), (6, [1.0, 2.0], None, "", 0), (7, [1.0, 2.0], 1, "", 0), (8, [1.0, 2.0, 0.0], 1, "", 0),
            (9, [1.0, 2.0], 2, "", 0), (10, [2.0, 4.0], 1, "", 0), (7, [1.0, 2.0], 1, "", 0), (4, [1.0, nan], 1, "", 0)]
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_links.near_vectors(vectors(spark, rows)).collect())
    assert found == sorted([(i, 0, i, True) for i in (0, 1, 2, 3, 4, 4, 5, 6, 8, 9)] + [(7, 2, 7, True)] * 2 + [(10, 2, 7, False)])
    assert vector_links.near_vectors(vectors(spark, rows).limit(0)).count() == 0


# ---- texts ----

def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def brute_force(texts, size, per_cent):
    sets = [shingle_set(t, size) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b])]
    roots = roots_of(range(len(sets)), pairs)
    return {i: (len(sets[i]), roots[i], roots[i] == i) for i in range(len(sets))}


def varied(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(words)


@pytest.mark.parametrize("size, per_cent, bands, rows", [(3, 85, 20, 5), (5, 80, 25, 4)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, size, per_cent, bands, rows):
    """Copies, chains of edits around the threshold, shared passages, and tiles of a few sets each."""
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", 2000)
    rng = random.Random(size)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    texts = [varied(rng, base, rng.randrange(9)) for _ in range(80)] + [" ".join(base)] * 5
    chain = base[::-1]
    for _ in range(15):
        chain = varied(rng, chain, 1).split()
        texts.append(" ".join(chain))
    texts += [" ".join(base[:50] + [f"x{rng.randrange(10 ** 6)}" for _ in range(100)]) for _ in range(20)]
    texts += ["One two", "one TWO", "One", *AWKWARD, *AWKWARD]
    rng.shuffle(texts)
    found = near_duplicates.near_duplicates(documents(spark, texts, extra=True), size, per_cent, bands, rows).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute_force(texts, size, per_cent)


def test_tiles_of_a_large_component_grow_with_its_size(spark, monkeypatch):
    """Classes that are joined already do not meet again, however many blocks their bands have."""
    rows_in_tiles = []
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", 1000)
    monkeypatch.setattr(near_duplicates, "map_groups", lambda df, *rest: rows_in_tiles.append(df.count()) or map_groups(df, *rest))
    rng = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    texts = [varied(rng, base, 2) for _ in range(200)] + [varied(rng, base, 12) for _ in range(12)]
    found = near_duplicates.near_duplicates(documents(spark, texts), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute_force(texts, 3, 85)
    assert 0 < rows_in_tiles[0] < 3 * len(texts) * near_duplicates.BANDS, rows_in_tiles


def test_repeated_rows_and_rows_without_id(spark):
    docs = documents(spark, ["a b c d", "a b c d", "a b c d", None], ids=[5, 5, None, None])
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(docs, 3).collect()), key=str)
    assert found == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 0, None, False)], key=str)
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(7)
    errors = []
    for _ in range(60):
        both, one, two = (rng.integers(0, 2 ** 63, n).astype(np.uint64) for n in (160, 20, 20))
        a, b = np.concatenate((both, one)), np.concatenate((both, two))
        found = near_duplicates.signatures(np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)]), 2, 100)
        errors.append((found[0] == found[1]).mean() - 160 / 200)
        assert np.isfinite(found).all()
        merged = near_duplicates.signatures(np.union1d(a, b), np.zeros(200, dtype=int), 1, 100)
        assert (merged[0] == np.minimum(found[0], found[1])).all()  # a union's signature is the smaller value of each place
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < np.sqrt(0.8 * 0.2 / 100)  # less than that of independent hashes
