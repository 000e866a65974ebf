"""Operators 2, 5 and 6 against brute force in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from civicgauge.llm import mixing, quality_classifier, quality_rules
from civicgauge.llm.grams import gram_buckets, with_word_hashes
from tests.llm.cases import AWKWARD, documents, labels

WHITE = " \t\n\x0b\x0c\r"


def words(text):
    for c in WHITE:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def signed(x):
    return x - 2 ** 64 if x >= 2 ** 63 else x


def word_hash(word):
    return signed(xxhash.xxh64_intdigest(word.encode(), seed=42))


def pair_hash(a, b):
    first = xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), seed=42)
    return signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), seed=first))


def grams(text, buckets):
    hashes = [word_hash(w) for w in words(text)]
    return [h % buckets for h in hashes] + [pair_hash(a, b) % buckets for a, b in zip(hashes, hashes[1:])]


def base_counts(text):
    text = text or ""
    w = words(text)
    seen, repeated = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2)), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i:i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


def made_texts():
    rng = random.Random(5)
    good = [" ".join(rng.choice("the of and river stone house tree green walk light".split()) for _ in range(rng.randint(40, 90))) for _ in range(30)]
    bad = [" ".join(rng.choice("BUY!! NOW!! ### $$$ CLICK!! FREE!!".split()) for _ in range(rng.randint(40, 90))) for _ in range(20)]
    mixed = ["one two three one two three four\nsame line\nsame line\n" + "one two three " * 5, "a b c a b c a b c"]
    return good + bad + mixed


def test_quality_rules_against_brute_force(spark):
    texts = [*made_texts(), *AWKWARD]
    buckets = 4096
    known = [(i, 1, 0) for i in range(15)] + [(i, 0, 0) for i in range(30, 40)] + [(3, None, 0), (None, 1, 0)]
    found = {r.doc_id: r for r in quality_rules.judge(documents(spark, texts, extra=True), labels(spark, known), buckets=buckets).collect()}
    raw = Counter(g for t in texts for g in grams(t, buckets))
    good = Counter(g for t in texts[:15] for g in grams(t, buckets))
    n_raw, n_good = sum(raw.values()), sum(good.values())
    ratio = {b: math.log((good[b] + quality_rules.SHRINK) / (raw[b] * n_good / n_raw + quality_rules.SHRINK)) for b in raw}
    for i, text in enumerate(texts):
        r, g = found[i], grams(text, buckets)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(text)
        mean = sum(ratio[b] for b in g) / len(g) if g else 0.0
        assert r.log_ratio == pytest.approx(mean, abs=1e-9)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and mean >= quality_rules.THRESHOLD)
    assert not any(found[i].kept for i in range(30, 50))


def test_lists_of_grams_are_taken_apart_in_compiled_code(spark):
    docs, quality = documents(spark, ["a b c", None]), spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    settings = "spark.sql.adaptive.enabled"
    before = spark.conf.get(settings)
    spark.conf.set(settings, "false")
    try:
        plan = quality_rules.judge(docs, quality)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(settings, before)
    assert re.search(r"\*\(\d+\) Generate explode", plan)


def test_quality_rules_without_labels_or_rows(spark):
    docs = documents(spark, made_texts()[:3])
    assert [r.log_ratio for r in quality_rules.judge(docs, labels(spark)).collect()] == [0.0] * 3
    assert quality_rules.judge(docs.limit(0), labels(spark)).count() == 0


def test_repeated_rows_are_judged_apart_and_kept_whole(spark):
    texts = made_texts()
    docs = documents(spark, [texts[0], texts[0], texts[30], None], ids=[1, 1, 1, None])
    verdicts = quality_rules.judge(docs, labels(spark), threshold=-1.0)
    assert verdicts.count() == 4
    kept = quality_rules.keep_good(docs, verdicts)
    assert kept.columns == docs.columns
    expected = sorted(t for t in (texts[0], texts[0], texts[30]) if not (len(words(t)) < 50 or 2 * base_counts(t)[4] > len(words(t))))
    assert sorted(r.text for r in kept.collect()) == expected


def test_classifier_learns_and_holds_out(spark):
    texts = made_texts()[:50] * 4
    docs = documents(spark, [*texts, *AWKWARD], extra=True)
    known = labels(spark, [(i, int(i % 50 < 30), 0) for i in range(200)] + [(0, None, None)])
    found = {r.doc_id: r for r in quality_classifier.classify(docs, known, buckets=1 << 12).collect()}
    assert len(found) == 200 + len(AWKWARD)
    import zlib
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(i % 50 < 30) == bool(found[i].predicted) for i in range(200) if found[i].held_out]
    assert sum(held) / len(held) >= 0.95


def test_the_model_does_not_follow_the_partitions(spark):
    """Weights from 1, 7 and 40 partitions, and from rows in another order with repeated ids, equal those of updates in a loop."""
    texts = made_texts()[:50] * 2
    rows = [(i, int(i % 50 < 30), 0) for i in range(100)]
    docs = documents(spark, texts)
    found = []
    for partitions in (1, 7, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            trained = quality_classifier.train(docs.repartition(partitions).union(docs.limit(20)), labels(spark, rows).repartition(partitions), 512)
            found.append({r.bucket: r.weight for r in trained.collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found[0] == found[1] == found[2]

    import zlib
    model, order = quality_classifier.Leader(513), np.random.default_rng(0)
    learnt = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2]
    bucketed = with_word_hashes(docs).select("doc_id", gram_buckets(F.col("word_hashes"), 512, doubled=True).alias("found")).collect()
    buckets = {r.doc_id: np.array(r.found) for r in bucketed}
    for _ in range(quality_classifier.EPOCHS):
        for k in order.permutation(len(learnt)):
            model.update(*quality_classifier.sparse(buckets[learnt[k]], 512), int(learnt[k] % 50 < 30))
    weights = model.weights()
    assert found[0] == pytest.approx({(-1 if b == 512 else int(b)): weights[b] for b in np.flatnonzero(weights)})


def test_held_out_labels_do_not_count(spark):
    docs = documents(spark, made_texts()[:50] * 2)
    rows = [(i, int(i % 50 < 30), 0) for i in range(100)]
    import zlib
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, 0) for i, q, _ in rows]
    one, two = ({r.doc_id: r.score for r in quality_classifier.classify(docs, labels(spark, x), buckets=256).collect()} for x in (rows, flipped))
    assert one == pytest.approx(two)
    untrained = quality_classifier.classify(docs, labels(spark), buckets=256).collect()
    assert {r.score for r in untrained} == {0.5}


def test_scores_are_sparse_dot_products(spark):
    text = "the river the river the the"
    docs = documents(spark, [text, None])
    weights = spark.createDataFrame([(quality_classifier.BIAS, 0.3)] + [(b, b / 100) for b in range(64)], "bucket int, weight double")
    found = {r.doc_id: r.score for r in quality_classifier.score(docs, weights, buckets=64).collect()}
    hashes = [word_hash(w) for w in text.split()]
    same = signed(xxhash.xxh64_intdigest((0).to_bytes(4, "little"), seed=xxhash.xxh64_intdigest((0).to_bytes(4, "little"), seed=42)))
    g = [h % 64 for h in hashes] + [(same if a == b else pair_hash(a, b)) % 64 for a, b in zip(hashes, hashes[1:])]
    margin = 0.3 + sum(b / 100 for b in g) / math.sqrt(len(g))
    assert found[0] == pytest.approx(1 / (1 + math.exp(-margin)))
    assert found[1] == pytest.approx(1 / (1 + math.exp(-0.3)))


def test_updates_follow_the_leader():
    """The weights are the minimum of the summed linearised losses with both penalties, on a grid."""
    model = quality_classifier.Leader(1, rate=0.5, smooth=1.0, l1=0.1, l2=0.2)
    for x, y in [(1.0, 1), (0.5, 0), (2.0, 1), (1.0, 1)]:
        model.update(np.array([0]), np.array([x]), y)
    grid = np.linspace(-3, 3, 60001)
    cost = model.sums[0] * grid + 0.1 * abs(grid) + (0.2 + (1.0 + math.sqrt(model.squares[0])) / 0.5) * grid ** 2 / 2
    assert model.weights()[0] == pytest.approx(grid[cost.argmin()], abs=1e-3)


def domain_labels(spark, rows):
    return labels(spark, rows).withColumn("domain", mixing.domain_of_labels())


def test_mixing_meets_targets(spark):
    texts = made_texts()[:50]
    docs = documents(spark, [*texts, *AWKWARD], extra=True)
    known = domain_labels(spark, [(i, int(i < 30), int(20 <= i < 30)) for i in range(0, 50, 2)])
    targets = {"clean": 0.5, "toxic": 0.2, "low": 0.3}
    rows = mixing.mix(docs, known, targets, keep=()).collect()
    assert len(rows) == len(texts) + len(AWKWARD)
    total = sum(r.n_tokens for r in rows)
    for d, share in targets.items():
        assert sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) == pytest.approx(share * total, rel=2e-3, abs=1e-3 * total)
    assert all(r.rate >= 0 and math.floor(r.rate) <= r.copies <= math.floor(r.rate) + 1 for r in rows)
    assert all(sum(r[f"p_{d}"] for d in targets) == pytest.approx(1) for r in rows)


def test_rates_are_nonnegative_least_squares(spark):
    """Targets that can be met are met; each rate is the start moved along its posteriors, or 0."""
    rng = np.random.default_rng(1)
    p, n = rng.dirichlet([0.3, 0.3, 0.3], 200), rng.integers(1, 500, 200)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    for least, targets in ((0.0, {"a": 0.7, "b": 0.25, "c": 0.05}), (1.0, {"a": 0.4, "b": 0.33, "c": 0.27})):
        steps = mixing.fit_rates(members, list(targets), targets, keep=tuple(targets) if least else (), least=least)
        rates = np.array([r[0] for r in members.select(mixing.rate_of(steps, least)).collect()])
        plain = np.ones(len(n))
        for step in steps:
            plain = np.maximum(least, plain - p @ np.array(step))
        assert rates == pytest.approx(plain, abs=1e-9) and rates.min() >= least
        found = (p * (n * rates)[:, None]).sum(0)
        # With a bound of 1 few rows are free to move, so the last steps are short.
        assert found / found.sum() == pytest.approx([*targets.values()], abs=5e-3 if least else 1e-3)


def test_no_document_goes_with_a_least_rate(spark):
    texts = made_texts()[:50]
    docs = documents(spark, [*texts, texts[0]], ids=[*range(50), 0])
    known = domain_labels(spark, [(i, int(i < 30), 0) for i in range(50)])
    targets = {"clean": 0.7, "low": 0.3}
    mixed = mixing.mix(docs, known, targets, keep=("clean", "low"), least=1.0)
    out = mixing.repeat(docs, mixed)
    assert out.columns == docs.columns
    counts = Counter(r.doc_id for r in out.collect())
    assert set(counts) == set(range(50))
    copies = {r.doc_id: r.copies for r in mixed.collect()}
    assert all(counts[i] == copies[i] * (2 if i == 0 else 1) for i in counts)


def test_mixing_without_labels_or_rows(spark):
    docs = documents(spark, ["a b", None])
    rows = mixing.mix(docs, domain_labels(spark, []), {"clean": 0.5, "low": 0.5}).collect()
    assert all(r.p_clean == pytest.approx(0.5) for r in rows) and len(rows) == 2
    assert mixing.mix(docs.limit(0), domain_labels(spark, [])).count() == 0


def test_solve():
    a = [[4.0, 1.0, 0.0], [1.0, 3.0, 0.0], [0.0, 0.0, 0.0]]
    assert mixing.solve(a, [1.0, 2.0, 0.0]) == pytest.approx([*np.linalg.solve(np.array(a)[:2, :2], [1.0, 2.0]), 0.0])
