"""Operators 1 and 3 against the tokenizers library."""

import hashlib
import random
import sys

import numpy as np
import pytest
import regex
from tokenizers import Tokenizer

from civicgauge.llm import bpe, token_counts
from tests.llm.cases import AWKWARD, documents


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(bpe.default_path())


def random_texts():
    rng = random.Random(3)
    letters = "abcdefg   \n\t'.,!0123éèßяц日<|>"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 120))) for _ in range(400)]


def test_ids_and_round_trip(reference):
    work = bpe.Encoder(bpe.default_path())
    for text in [*filter(None, AWKWARD), "it's we'll I'M   x", "foo\n ", " \n bar", "<|endoftext|>", *random_texts()]:
        ids = reference.encode(text, add_special_tokens=False).ids
        packed = work.encode([text])[0]
        assert packed == b"".join(i.to_bytes(4, "little") for i in ids)
        assert work.decode(packed) == reference.decode(ids, skip_special_tokens=False) == text


def test_full_store_changes_nothing(reference):
    small = bpe.Encoder(bpe.default_path(), kept_words=40, kept_nodes=60)
    texts = random_texts()
    for at in range(0, len(texts), 7):
        for text, packed in zip(texts[at:at + 7], small.encode(texts[at:at + 7])):
            assert packed == b"".join(i.to_bytes(4, "little") for i in reference.encode(text, add_special_tokens=False).ids)


def test_shared_prefixes_are_worked_out_once():
    trie = bpe.WordTrie(bpe.vocabulary(bpe.default_path()))
    trie.encode([b"interest", b"interested", b"interesting"])
    assert len(trie.last) == 1 + len("interest") + len("ed") + len("ing")


def test_few_suffixes_of_a_prefix_are_looked_up():
    voc = bpe.vocabulary(bpe.default_path())
    looked_up = []

    class Ids(dict):
        def get(self, text):
            looked_up.append(text)
            return dict.get(self, text)

        def __contains__(self, text):
            looked_up.append(text)
            return dict.__contains__(self, text)

    chance = random.Random(3)
    words = [bytes(chance.choices(b"bcdfghjklmnpqrstvwxz", k=12)) for _ in range(200)]
    trie = bpe.WordTrie(voc)
    found = trie.encode(words)
    ids = voc.ids
    voc.ids = Ids(ids)
    try:
        assert bpe.WordTrie(voc).encode(words) == found
    finally:
        voc.ids = ids
    assert len(looked_up) < 3 * len(trie.last)


def invented_texts():
    """Texts of words that are mostly new, as ``known`` words cost little."""
    chance = random.Random(5)
    syllables = ["tion", "er", "an", "th", "eou", "ble", "on", "ed", "sh", "ing"]
    return [" ".join("".join(chance.choices(syllables, k=chance.randint(2, 5))) + chance.choice(["", ",", ".\n"]) for _ in range(200))
            for _ in range(60)]


def lines_run(work, *given):
    """Result of the work, and how many lines of Python it ran in the two operators."""
    lines, files = 0, (bpe.__file__, token_counts.__file__)

    def trace(frame, event, arg):
        nonlocal lines
        if frame.f_code.co_filename not in files:
            return None
        lines += event == "line"
        return trace

    held = sys.gettrace()
    sys.settrace(trace)
    try:
        return work(*given), lines
    finally:
        sys.settrace(held)


def test_new_words_are_encoded_level_by_level(reference):
    texts, work = invented_texts(), bpe.Encoder(bpe.default_path())
    work.encode(texts[:1])
    found, lines = lines_run(work.encode, texts)
    assert found == [b"".join(i.to_bytes(4, "little") for i in reference.encode(t, add_special_tokens=False).ids) for t in texts]
    assert lines < 2 * sum(map(len, texts))  # ten to a character when each letter of a new word takes its own steps


def test_words_of_many_texts_are_those_of_the_pattern():
    chance = random.Random(7)
    letters = ["a", "The", "é", "ß", "日本", "٣", "½", "12", ".", "—", "🙂", "\u0301", "\u200b", "\0", " ", " ", "  ", "\n", "\t", "\r\n", "\u00a0",
               "\u3000", "\x85", "\x1c", "'", "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'l", "'S", "𝒳"]
    texts = ["".join(chance.choices(letters, k=chance.randint(0, 30))) for _ in range(2000)]
    data = [t.encode() for t in texts]
    borders = np.cumsum([0, *map(len, data)])
    starts = bpe.word_starts(b"".join(data), borders)
    wanted = [w.encode() for t in texts for w in regex.findall(bpe.WORD, t)]
    assert starts.tolist() == np.cumsum([0, *map(len, wanted)])[:-1].tolist()
    assert not len(bpe.word_starts(b"", np.array([0]))) and not len(bpe.word_starts(b"", np.array([0, 0, 0])))


def test_long_words_and_small_groups(reference, monkeypatch):
    chance = random.Random(11)
    texts = ["=" * n for n in (62, 63, 64, 65, 130, 500)] + ["x" * 63, "ab" * 200, "ab" * 200 + "c", "日本語" * 40, "", "0" * 64 + " " * 70 + "-"]
    texts += ["".join(chance.choices("etaonr", k=chance.randint(50, 90))) for _ in range(30)]
    wanted = [b"".join(i.to_bytes(4, "little") for i in reference.encode(t, add_special_tokens=False).ids) for t in texts]
    assert bpe.Encoder(bpe.default_path()).encode(texts) == wanted
    monkeypatch.setattr(bpe, "CHARACTERS_AT_ONCE", 100)
    small = bpe.Encoder(bpe.default_path(), kept_words=10, kept_nodes=1)
    assert small.encode(texts) == wanted == small.encode(texts) and small.encode([]) == []


def test_digests_of_rows(spark, reference):
    docs = documents(spark, [*AWKWARD, "a"], ids=[0, 1, 2, 3, 4, 5, 6, 7, 8, None, 4], extra=True)
    found = bpe.round_trip_digests(docs).collect()
    assert len(found) == 11 and all(r.lossless for r in found)
    by_id = {r.doc_id: r for r in found}
    assert by_id[0].n_tokens == 0 and by_id[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    ids = reference.encode(AWKWARD[6], add_special_tokens=False).ids
    assert by_id[6].ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    assert by_id[6].decoded_sha256 == hashlib.sha256(AWKWARD[6].encode()).hexdigest()
    assert bpe.round_trip_digests(docs.limit(0)).count() == 0


def test_encode_then_decode(spark):
    docs = documents(spark, AWKWARD)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {i: t or "" for i, t in enumerate(AWKWARD)}


def brute_force_lines(reference, text):
    """Tokens of each line by the library's own offsets; a token counts where its first character is."""
    ends, counts = [], []
    for line in text.split("\n"):
        ends.append((ends[-1] if ends else 0) + len(line) + 1)
        counts.append(0)
    if text.endswith("\n"):
        ends.pop(), counts.pop()
    # The library trims blanks off the offsets it reports, so spans come from decoding byte by byte.
    spans, at = [], 0
    voc = bpe.vocabulary(bpe.default_path())
    data = text.encode()
    for token in reference.encode(text, add_special_tokens=False).ids:
        character = len(data[:at].decode("utf-8", "ignore"))
        spans.append(character)
        at += len(voc.texts[token])
    for start in spans:
        counts[next(i for i, e in enumerate(ends) if start < e)] += 1
    return counts


def test_lines_of_new_words_are_counted_without_steps_for_each_letter(reference, monkeypatch):
    made = []
    monkeypatch.setattr(token_counts, "map_rows", lambda df, columns, schema, make, *rest: made.append(make))
    monkeypatch.setattr(token_counts, "encoder", bpe.Encoder)  # one that has met nothing yet

    class Docs:
        dtypes = [("doc_id", "bigint"), ("text", "string")]

    monkeypatch.setattr(token_counts, "text_or_empty", lambda name: name)
    token_counts.line_token_counts(Docs())
    texts, run = invented_texts(), made[0]()
    run([0], ["a b"])
    (ids, sections, *_, counts), lines = lines_run(run, list(range(len(texts))), texts)
    assert lines < 2 * sum(map(len, texts))
    for i in (0, 17, 59):
        own = [k for k, doc in enumerate(ids) if doc == i]
        assert [sections[k] for k in own] == list(range(len(own)))
        assert [counts[k] for k in own] == brute_force_lines(reference, texts[i])


@pytest.mark.parametrize("text", ["one\ntwo three\n\nfour", "\n\n\nx\n", "é\n🙂🙂\nnaïve", "a\n" * 50, "no break"])
def test_line_counts(spark, reference, text):
    rows = token_counts.line_token_counts(documents(spark, [text])).orderBy("section").collect()
    assert [r.n_tokens for r in rows] == brute_force_lines(reference, text)
    assert [r.start for r in rows][1:] == [r.end for r in rows][:-1] and rows[-1].end == len(text)
    assert sum(r.n_tokens for r in rows) == len(reference.encode(text, add_special_tokens=False).ids)


def test_rules_for_crossing_tokens(spark):
    rows = spark.createDataFrame([(1, "inter", "esting", None)], "doc_id long, a string, b string, c string")
    counts = {r: token_counts.field_token_counts(rows, ["a", "b", "c"], rule=r).first() for r in token_counts.RULES}
    whole = sum(counts["first"][1:])
    for rule in token_counts.RULES:
        assert sum(counts[rule][1:]) == pytest.approx(whole) and counts[rule].tokens_c == 0
    assert counts["first"].tokens_a == whole  # the one token begins in the first field
    assert counts["largest"].tokens_b == 1 and counts["split"].tokens_a == pytest.approx(5 / 11)
    with pytest.raises(ValueError):
        token_counts.field_token_counts(rows, ["a"], rule="none")


def test_awkward_rows_have_sections(spark):
    found = token_counts.line_token_counts(documents(spark, AWKWARD, extra=True)).collect()
    assert {r.doc_id for r in found} == set(range(len(AWKWARD)))
    assert [(r.start, r.end, r.n_tokens) for r in found if r.doc_id == 0] == [(0, 0, 0.0)]
    assert token_counts.line_token_counts(documents(spark, ["x"]).limit(0)).count() == 0
