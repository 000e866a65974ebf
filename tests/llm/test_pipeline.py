"""The pipeline's stages against brute force on a small corpus."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from civicgauge.llm import bpe, personal_data, quality_rules
from tests.llm.cases import AWKWARD
from tests.llm.test_groups import brute_force
from tests.llm.test_quality import base_counts

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = "the of and river stone house tree green walk light year town".split()
    clean = [" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(80)) for _ in range(40)]
    near = [c.rsplit(" ", 1)[0] + " changed" for c in clean[:10]]
    junk = [" ".join(rng.choice("BUY!! NOW!! ### $$$ CLICK!!".split()) for _ in range(70)) for _ in range(20)]
    private = [c + f" write to user{i}@mail.example.com now" for i, c in enumerate(clean[10:14])]
    texts = [*clean, *near, *junk, *private, *clean[:3], *AWKWARD]
    root = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENT).write.parquet(f"{root}/documents.parquet")
    labels = [(i, 1, int(i % 9 == 0)) for i in range(30)] + [(i, 0, 0) for i in range(50, 65)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_stages_one_by_one(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            after = docs.collect()
        if name == "quality rules":
            verdicts = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(before, DOCUMENT), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
            assert {r.doc_id for r in after} == {i for i, r in verdicts.items() if r.kept}
            for r in before:
                n, *_, repeated = base_counts(r.text)
                assert verdicts[r.doc_id].base_failed == (n < 50 or 100 * repeated > 50 * n)
            assert {*range(40)} <= {r.doc_id for r in after} and not {r.doc_id for r in after} & {*range(50, 70)}
        elif name == "near duplicates":
            rows = sorted(before)
            kept = brute_force([r.text for r in rows], 5, 80)
            assert sorted(r.doc_id for r in after) == [r.doc_id for i, r in enumerate(rows) if kept[i][2]]
        elif name == "personal data":
            old = {r.doc_id: r for r in before}
            for r in after:
                found = personal_data.base_spans(old[r.doc_id].text)
                assert personal_data.base_spans(r.text) == [] and r.n_chars == len(r.text)
                assert r.text == old[r.doc_id].text if not found else "[email]" in r.text
        elif name == "mixing":
            counts, old = Counter(r.doc_id for r in after), {r.doc_id: r for r in before}
            assert set(counts) == set(old) and all(r == old[r.doc_id] for r in after)
        else:
            work = bpe.Encoder(bpe.default_path())
            found = sorted((r.doc_id, r.n_tokens, tuple(r.ids)) for r in out.collect())
            packed = [(r.doc_id, work.encode([r.text])[0]) for r in before]
            assert found == sorted((i, len(p) // 4, tuple(int.from_bytes(p[k:k + 4], "little") for k in range(0, len(p), 4))) for i, p in packed)


def test_one_row_stays_of_repeated_ones(spark, folder):
    texts = ["one two three four five six seven", "quite another text of seven words here", "one two three four five six seven", None]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[1]), (2, texts[2]), (3, texts[3]), (3, texts[3]), (1, texts[0])]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)], DOCUMENT)
    kept = corpus_pipeline.one_of_each_group(spark, docs, folder)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, texts[0]), (1, texts[1]), (3, "")]


def expected_shares(members):
    """Share of each domain in the expected tokens."""
    rows = members.collect()
    mass = {d: sum(r.n_tokens * r.rate * r[f"p_{d}"] for r in rows) for d in corpus_pipeline.TARGETS}
    assert all(r.rate >= 1 and r.copies >= 1 for r in rows)
    return {d: m / sum(mass.values()) for d, m in mass.items()}


def test_mixing_meets_its_targets(spark, tmp_path):
    """Toxic texts hold more than their share and none is dropped."""
    rng = random.Random(5)
    mild, rude = "river stone house tree green walk light year town".split(), "idiot stupid moron trash loser creep".split()
    texts = [" ".join(rng.choice(rude if i % 5 < 2 else mild) for _ in range(60)) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCUMENT)
    spark.createDataFrame([(i, 1, int(i % 5 < 2)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert expected_shares(corpus_pipeline.rates(spark, docs, str(tmp_path))) == pytest.approx(corpus_pipeline.TARGETS, abs=0.002)
    assert {r.doc_id for r in corpus_pipeline.mix(spark, docs, str(tmp_path)).select("doc_id").collect()} == {*range(200)}


def test_run_is_the_stages_in_order(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "ids", "n_tokens"} <= set(out.columns)
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert {*range(40)} - ids == set() and not ids & {*range(40, 70)}


def test_an_empty_table_goes_through(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
