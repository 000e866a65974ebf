"""Operators 11 to 13: fingerprints, manifest and prefix trie, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicgauge.llm import fingerprints, manifest, prefix_trie
from civicgauge.llm.queries import ORACLES, QUERIES
from tests.llm.cases import AWKWARD, documents
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_manifest", "op13_prefix_trie"])
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), ORACLES[name], connect(FOLDER)) == []


# ---- fingerprints ----

def polynomial(text, lane):
    """Hash of a text by its definition."""
    p, base = fingerprints.PRIME, fingerprints.BASES[lane]
    return sum((ord(c) + 1) * pow(base, i, p) for i, c in enumerate(text)) % p


def test_prefixes_answer_spans_and_extensions():
    rng = random.Random(1)
    a = "".join(rng.choice("ab🙂é") for _ in range(300))
    b = a[40:200] + "x" + a[100:]
    one, two = fingerprints.Prefixes(a), fingerprints.Prefixes(b)
    for width in (1, 2, 7, 32):
        want = [polynomial(a[i:i + width], 1) << 31 | polynomial(a[i:i + width], 0) for i in range(len(a) - width + 1)]
        assert one.spans(width).tolist() == want
    for _ in range(300):
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert one.extension(i, two, j) == n
        n = 0
        while n < min(i, j) and a[i - n - 1] == b[j - n - 1]:
            n += 1
        assert one.extension_back(i, two, j) == n
        assert (one.span(0, i) == two.span(0, i)) == (i <= len(b) and a[:i] == b[:i])


def test_likeness_follows_the_share_of_common_spans():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    text = " ".join(words)
    mark = fingerprints.fingerprint(fingerprints.Prefixes(text))
    for share in (0.0, 0.2, 0.5, 0.8, 1.0):
        moved = " ".join(["new"] * 20 + words[:int(share * len(words))] + ["".join(rng.choice("klmnop") for _ in range(6)) for _ in range(int((1 - share) * len(words)))])
        a, b = ({t[i:i + 32] for i in range(len(t) - 31)} for t in (text, moved))
        found = fingerprints.likeness(mark, fingerprints.fingerprint(fingerprints.Prefixes(moved)))
        assert abs(found - len(a & b) / len(a | b)) < 0.2
    assert fingerprints.likeness(mark, mark) == 1.0


def following(texts, ids):
    """Texts in descending order of ids, each with the next one."""
    rows = sorted(zip(ids, texts), key=lambda r: (r[0] is None, -(r[0] or 0)))
    return [(i, t or "", rows[(k + 1) % len(rows)][1] or "") for k, (i, t) in enumerate(rows)]


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_each_document_meets_the_next_one(spark, partitions):
    texts = [*AWKWARD, *[f"text number {i} " * (i + 1) for i in range(30)]]
    ids = [*range(5, 5 + len(texts) - 1), None]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.doc_id: r for r in fingerprints.with_following(documents(spark, texts, ids, extra=True)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(found) == len(texts)
    for i, text, following_text in following(texts, ids):
        half, row = len(text) // 2, found[i]
        edited = text[:len(text) - half] + following_text[:half]
        marks = [fingerprints.fingerprint(fingerprints.Prefixes(t)) for t in (text, edited, following_text)]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (row.fingerprint, row.edited_fingerprint) == tuple(marks[:2])
        assert (row.near_edited, row.near_next) == (fingerprints.likeness(*marks[:2]), fingerprints.likeness(marks[0], marks[2]))
        assert text[:row.common_start] == edited[:row.common_start] and text[row.common_start:row.common_start + 1] != edited[row.common_start:row.common_start + 1] or text == edited


def test_fingerprints_of_few_and_repeated_rows(spark):
    assert fingerprints.with_following(documents(spark, [])).count() == 0
    one = fingerprints.with_following(documents(spark, ["abcdef"])).collect()
    assert [(r.edited_sha256, r.near_next) for r in one] == [(hashlib.sha256(b"abcabc").hexdigest(), 1.0)]
    same = fingerprints.with_following(documents(spark, ["abc", "abc", "abc"], [7, 7, 7])).collect()
    assert len(same) == 3 and {r.near_next for r in same} == {1.0}
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(documents(spark, [None, "", "abc"])).collect()}
    assert plain[0] == plain[1] != plain[2]
    assert fingerprints.likeness(plain[0], plain[2]) == 0.0


# ---- manifest ----

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def siblings(levels, at, fanout):
    found = []
    for nodes in levels[:-1]:
        run = at - at % fanout
        found += [n for i, n in enumerate(nodes[run:run + fanout], run) if i != at]
        at //= fanout
    return found


@pytest.mark.parametrize("fanout, block_levels, sizes", [
    (2, 1, [1, 2, 3, 5, 8, 13]), (3, 1, [40, 1, 1, 7]), (3, 2, [9, 10, 81, 82, 1]), (16, 3, [20, 1]), (2, 1, [33]), (4, 1, [1] * 18)])
def test_manifest_equals_whole_trees(spark, fanout, block_levels, sizes):
    rows = []
    for s, size in enumerate(sizes):
        rows += [(1000 * s + 7 * i, f"t{i}", None if s == 2 else "en", None if s == 0 else f"s{s}", i) for i in range(size)]
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    altered = F.when(F.col("doc_id") % 5 == 0, F.lit("changed")).otherwise(F.col("text"))
    found = {r.doc_id: r for r in manifest.verify(
        manifest.manifest(docs, altered={"text": altered}, fanout=fanout, block_levels=block_levels).withColumn("proof", manifest.path_digest(F.col("path"))),
        "altered_leaf").collect()}
    assert len(found) == len(rows)

    def leaf(r, text=None):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text or r[1])])

    trees = {s: tree([leaf(r) for r in sorted(r for r in rows if r[3] == s)], fanout) for s in {r[3] for r in rows}}
    order = sorted(trees, key=lambda s: (s is not None, s))
    top = tree([trees[s][-1][0] for s in order], fanout)
    for r in rows:
        row, at = found[r[0]], sorted(x[0] for x in rows if x[3] == r[3]).index(r[0])
        proof = siblings(trees[r[3]], at, fanout) + siblings(top, order.index(r[3]), fanout)
        assert (row.leaf, row.subroot, row.root, row.proof) == (leaf(r), trees[r[3]][-1][0], top[-1][0], h(*proof))
        assert row.verified == (r[0] % 5 != 0)


def test_manifest_of_awkward_rows(spark):
    docs = documents(spark, [*AWKWARD, "same", "same"], [None, None, *range(len(AWKWARD) - 2), 3, 3], extra=True)
    found = manifest.verify(manifest.manifest(docs)).collect()
    assert len(found) == len(AWKWARD) + 2 and all(r.verified for r in found) and len({r.root for r in found}) == 1
    assert manifest.manifest(documents(spark, [])).count() == 0
    alone = manifest.verify(manifest.manifest(documents(spark, ["x"]))).collect()[0]
    assert alone.leaf == alone.subroot == alone.root == alone.folded_root and alone.path == []


# ---- prefix trie ----

def test_parentheses_against_a_stack():
    rng = random.Random(5)
    bits, depth = [], 0
    while len(bits) < 3000 or depth:
        step = 1 if depth == 0 else 0 if len(bits) >= 3000 else rng.random() < 0.5 + 0.4 * (len(bits) < 900)
        bits.append(int(step))
        depth += 1 if step else -1
    tree, stack = prefix_trie.Parens(np.array(bits, dtype=np.uint8)), []
    pairs = 0
    for i, b in enumerate(bits):
        if b:
            stack.append((i, pairs))
            pairs += bits[i + 1] == 0
        else:
            at, before = stack.pop()
            assert tree.close(at) == i and tree.leaves(at, i) == (before, pairs)


def brute_trie(rebuilt):
    """Nodes of the trie by their definition: {prefix: (conv, depth, parent, convs, children, leaves, saved, ends)}."""
    members, ends = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
        ends.setdefault(turns, []).append(c)
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[:-1] == p] for p in members}
    own = {p: (len(m) - 1) * len((p[-1][1] if p else "").split()) for p, m in members.items()}

    def below(p):
        return [p, *[x for q in children[p] for x in below(q)]]

    return sorted((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), sum(not children[q] for q in below(p)),
                   sum(own[q] for q in below(p)), hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p in members)


def rebuild(conversations):
    own = {}
    for c, turn, role, text in sorted(conversations, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: tuple(own.get(c - c % 20, [])[:heads[c]] + turns[heads[c]:]) for c, turns in own.items()}


@pytest.mark.parametrize("seed, partitions", [(0, 1), (1, 7), (2, 29)])
def test_trie_equals_its_definition(spark, seed, partitions):
    rng = random.Random(seed)
    conversations = []
    for c in rng.sample(range(200), 90):
        if c in (40, 45):
            continue
        length = 60 if c in (7, 47) else rng.randint(1, 6)  # copies of a long conversation, and many short ones
        conversations += [(c, t if t else None, rng.choice(["user", None]) if length < 60 else "user", rng.choice(["a b", "c", None, ""]) if length < 60 else f"long {t}") for t in range(length)]
    conversations += [(c, t, "user", f"long {t} of many words") for c in (301, 302, 303) for t in range(40)]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, 1, "x") for r in conversations] + [(None, 1, "user", "no id", 1, "x")], "conv_id long, turn long, role string, text string, depth int, key string")
        turns = prefix_trie.share_heads(prefix_trie.turns_of(df), F.col("conv") - F.col("conv") % 20, F.crc32(F.col("conv").cast("string")) % 4)
        found = sorted((tuple(r) for r in prefix_trie.trie(turns).collect()), key=lambda r: (r[0], r[1]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found == sorted(brute_trie(rebuild(conversations)), key=lambda r: (r[0], r[1]))


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"

    def run(rows):
        turns = prefix_trie.turns_of(spark.createDataFrame(rows, schema))
        return sorted(tuple(r) for r in prefix_trie.trie(prefix_trie.share_heads(turns, F.col("conv") - F.col("conv") % 20, F.lit(3).cast("bigint"))).collect())

    assert run([]) == []
    ends = hashlib.sha256(b"25,26").hexdigest()
    assert run([(25, 1, "user", "x"), (26, 1, None, None)]) == [(25, 0, None, 2, 0, 1, 0, ends)]
