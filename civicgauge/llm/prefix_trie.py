"""Operator 13: prefix trie of conversations, its subtrees measured on balanced parentheses.

Each distinct sequence of first turns is a node. A node's key is an exclusive or of hashes of (depth, turn), 128 bits, so the
keys of a conversation's prefixes are running values in order of its turns, and a node's parent is its key without the last
turn. Counts of members, children and ends are aggregates by key.

What needs whole subtrees (childless nodes, saved tokens) is worked out on the nodes where something happens: the root, and
the nodes with two or more members where some end or the ways part. Below a node with one member nothing is shared, and along
a way on which nothing happens the values follow from the next such node and from running word counts, so that copies of very
long conversations are no deep tree.

The remaining nodes, in depth-first order, are dealt to ranges (shards). A shard writes its part of the trie as balanced
parentheses, with the ancestors of its first node, the spine it shares with earlier shards, around them. Blocks of the excess
with their minima, and minima over blocks of blocks, find the closing parenthesis of a node; the rank of leaf pairs ``()``
before both ends of a node tells which entries of the cumulative array of leaf counts are its own, and its positions which of
the cumulative savings. A spine node's parts from several shards are added: each node's own values are in one shard only.

Hashes of 64 bits would meet by chance in a table of some thousand million turns; of 128 bits they do with odds of one in
10**18 for 10**10 turns.

Defined results: null roles and texts are empty; turns come in order, null first, of equal turns the smaller role, then
the smaller hash of the text first, and repeated rows are turns of their own; rows without an id belong to no conversation; an empty table has no root and gives
an empty table. Only the four named columns are read, so other columns do not clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicgauge.llm.grams import words_of
from civicgauge.llm.tasks import workers_find_package
from civicgauge.operators.ordered import PART, number_rows, running
from civicgauge.session import durable

BLOCK = 256
OPEN, CLOSE = 1, 0


class Parens:
    """Balanced parentheses with excess blocks: the smallest excess of each block, and of each ``BLOCK`` blocks, and so on."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.excess = np.cumsum(bits.astype(np.int64) * 2 - 1)
        self.minima = [self.excess]
        while len(self.minima[-1]) > 1:
            self.minima.append(np.minimum.reduceat(self.minima[-1], np.arange(0, len(self.minima[-1]), BLOCK)))
        pairs = np.zeros(len(bits), dtype=bool)
        if len(bits):
            pairs[:-1] = (bits[:-1] == OPEN) & (bits[1:] == CLOSE)
        #: Leaf pairs that open before each position.
        self.pairs = np.concatenate([[0], np.cumsum(pairs)])

    def close(self, at: int) -> int:
        """The closing parenthesis of the one that opens at ``at``: the next position with an excess below its own."""
        limit, level, begin = self.excess[at], 0, at + 1
        # Up, as long as the rest of a block holds none; then down into the first block that does.
        while True:
            values = self.minima[level]
            end = min(len(values), -(-begin // BLOCK) * BLOCK) if begin % BLOCK else min(len(values), begin + BLOCK)
            hits = np.flatnonzero(values[begin:end] < limit)
            if len(hits):
                found = begin + int(hits[0])
                break
            if end >= len(values):
                raise ValueError("parentheses are not balanced")
            level, begin = level + 1, end // BLOCK
        while level:
            level -= 1
            begin = found * BLOCK
            found = begin + int(np.flatnonzero(self.minima[level][begin:begin + BLOCK] < limit)[0])
        return found

    def leaves(self, at: int, close: int) -> tuple[int, int]:
        """First leaf pair within the parentheses and the first one after them."""
        return int(self.pairs[at]), int(self.pairs[close])


def subtree_sums(paths: list[tuple[bytes, ...]], leaves: list[int], saved: list[int], way_saved: list[int]) -> list[tuple[bytes, int, int]]:
    """Key, leaves and savings of each subtree of nodes in depth-first order, ancestors of the first one included.

    ``leaves`` are the childless nodes that stand for a node itself or hang below it outside of ``paths``. ``saved`` is what a
    node itself saves, ``way_saved`` what the nodes between it and the one above in its path save.
    """
    bits, keys, opened, own_leaves, own_saved, outside = [], [], [], [], [], []
    stack: list[bytes] = []

    def enter(key: bytes, n: int, s: int, above: int) -> None:
        stack.append(key)
        opened.append(len(bits))
        keys.append(key)
        bits.append(OPEN)
        own_saved.append(s + above)
        outside.append(above)
        # A leaf pair of its own holds what hangs at the node.
        bits.extend((OPEN, CLOSE))
        own_leaves.append(n)

    for path, n, s, above in zip(paths, leaves, saved, way_saved):
        shared = 0
        while shared < len(stack) and shared < len(path) and stack[shared] == path[shared]:
            shared += 1
        bits.extend([CLOSE] * (len(stack) - shared))
        del stack[shared:]
        for key in path[shared:-1]:  # the spine of the first node
            enter(key, 0, 0, 0)
        enter(path[-1], n, s, above)
    bits.extend([CLOSE] * len(stack))
    tree = Parens(np.array(bits, dtype=np.uint8))
    up_to_leaf = np.concatenate([[0], np.cumsum(np.array(own_leaves, dtype=np.int64))])
    up_to_node = np.concatenate([[0], np.cumsum(np.array(own_saved, dtype=np.int64))])
    found = []
    for i, (key, at) in enumerate(zip(keys, opened)):
        close = tree.close(at)
        first, after = tree.leaves(at, close)
        # Every node has one leaf pair, so pairs within are nodes within.
        found.append((key, int(up_to_leaf[after] - up_to_leaf[first]), int(up_to_node[i + after - first] - up_to_node[i]) - outside[i]))
    return found


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Numbered turns: ``conv``, ``depth`` from 1, two hashes of role and text, and the words of the text."""
    said = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in (role, text)]
    rows = conversations.filter(F.col(conv).isNotNull()).select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), *said).select(
        "conv", "turn", F.col(role).alias("role"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"),
        F.size(words_of(F.col(text))).cast("bigint").alias("words"))
    return number_rows(rows, ["conv"], ["turn", "role", "a", "b"], "depth").select("conv", "depth", "a", "b", "words")


def share_heads(turns: DataFrame, base: Column, head: Column) -> DataFrame:
    """Every conversation anew: the first ``head`` turns of conversation ``base``, then its own after its first ``head``.

    Both are columns of ``conv``. ``n_turns`` of the result is 0, with null turns, for a conversation without any.
    """
    convs = turns.groupBy("conv").agg(F.max("depth").alias("own")).withColumns({"base": base, "head": head})
    given = convs.select(F.col("conv").alias("b_conv"), F.col("own").alias("b_own"))
    convs = durable(convs.join(given, F.col("base") == F.col("b_conv"), "left").withColumn(
        "led", F.least(F.col("head"), F.coalesce(F.col("b_own"), F.lit(0)))).drop("b_conv", "b_own"), "conversations")
    own = turns.join(convs.select(F.col("conv").alias("c_conv"), "head", "led"), F.col("conv") == F.col("c_conv")).filter("depth > head").select(
        "conv", (F.col("depth") - F.col("head") + F.col("led")).alias("depth"), "a", "b", "words")
    heads = convs.filter("led > 0").select("conv", "base", "led").join(
        turns.select(F.col("conv").alias("t_conv"), "depth", "a", "b", "words"), (F.col("base") == F.col("t_conv")) & (F.col("depth") <= F.col("led")))
    empty = convs.filter("led = 0 and own <= head").select("conv", F.lit(0).cast("bigint").alias("depth"), *(F.lit(None).cast("bigint").alias(c) for c in ("a", "b", "words")))
    return own.unionByName(heads.select(own.columns)).unionByName(empty)


def _key(high: Column, low: Column) -> Column:
    """Sixteen bytes that sort as any two keys do, for paths in depth-first order."""
    return F.unhex(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def nodes_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (``key``, ``parent``, ``depth``, ``n_convs``, ``conv``, ``words``, ``words_above``), and a row for each prefix of each conversation.

    ``turns`` are ``conv``, ``depth``, ``a``, ``b``, ``words``; a conversation without turns has one row of depth 0.
    """
    high, low = F.xxhash64("depth", "a", "b"), F.xxhash64(F.lit(1), "depth", "a", "b")
    terms = turns.withColumns({"high": F.when(F.col("depth") > 0, high).otherwise(0), "low": F.when(F.col("depth") > 0, low).otherwise(0)})
    summed = running(terms, ["conv"], ["depth"], {
        "to_high": ("bit_xor", F.col("high")), "to_low": ("bit_xor", F.col("low")), "words_to": ("sum", F.coalesce("words", F.lit(0)))})
    prefixes = summed.select(
        "conv", "depth", _key(F.col("to_high"), F.col("to_low")).alias("key"),
        _key(F.col("to_high").bitwiseXOR(F.col("high")), F.col("to_low").bitwiseXOR(F.col("low"))).alias("parent"),
        F.coalesce("words", F.lit(0)).alias("words"), (F.col("words_to") - F.coalesce("words", F.lit(0))).alias("words_above"))
    root = prefixes.groupBy("conv").agg(F.max("depth").alias("n_turns"))
    start = root.select("conv", F.lit(0).cast("bigint").alias("depth"), _key(F.lit(0), F.lit(0)).alias("key"), F.lit(None).cast("binary").alias("parent"),
                        F.lit(0).cast("bigint").alias("words"), F.lit(0).cast("bigint").alias("words_above"))
    prefixes = prefixes.filter("depth > 0").unionByName(start)
    prefixes = prefixes.join(root.withColumnRenamed("conv", "r_conv"), F.col("conv") == F.col("r_conv")).withColumn(
        "ends", F.col("depth") == F.col("n_turns")).drop("r_conv", "n_turns")
    prefixes = durable(prefixes, "prefixes")
    nodes = prefixes.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv"), F.min("depth").alias("depth"), F.min("parent").alias("parent"),
        F.min("words").alias("words"), F.min("words_above").alias("words_above"), F.sum(F.col("ends").cast("bigint")).alias("n_ends"))
    # Once by its key for its own row, once by its parent's for the parent's: one aggregate counts children and keeps the node.
    tagged = nodes.withColumn("node", F.struct(*[c for c in nodes.columns if c != "key"])).select(
        F.col("key"), "node", F.lit(0).cast("bigint").alias("child"), F.lit(0).cast("bigint").alias("alone"))
    below = nodes.filter(F.col("parent").isNotNull()).select(
        F.col("parent").alias("key"), F.lit(None).cast(dict(tagged.dtypes)["node"]).alias("node"), F.lit(1).cast("bigint").alias("child"),
        (F.col("n_convs") == 1).cast("bigint").alias("alone"))
    counted = tagged.unionByName(below).groupBy("key").agg(
        F.max("node").alias("node"), F.sum("child").alias("n_children"), F.sum("alone").alias("n_alone"))
    return durable(counted.select("key", "node.*", "n_children", "n_alone"), "nodes"), prefixes


def end_digests(prefixes: DataFrame) -> DataFrame:
    """``key`` of each node where conversations end, and ``ends_sha256`` of their ids, ascending, joined by commas.

    Ids are sorted over ranges and joined to texts of a range each, so a node where very many end comes to its task in pieces
    of many ids, which are hashed one after another and not held together.
    """
    workers_find_package(prefixes.sparkSession)
    ids = prefixes.filter("ends").select("key", "conv")
    ranged = ids.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").select("key", F.col("conv").cast("string").alias("conv"), F.spark_partition_id().alias(PART))
    piece_type = pa.schema([("key", pa.binary()), (PART, pa.int32()), ("piece", pa.int32()), ("text", pa.string())])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = 0
        for batch in batches:
            found: list[tuple[bytes, list[str]]] = []
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not found or found[-1][0] != key:
                    found.append((key, []))
                found[-1][1].append(conv)
            if found:
                part = batch.column(2)[0].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in found], pa.binary()), pa.array([part] * len(found), pa.int32()), pa.array(range(piece, piece + len(found)), pa.int32()),
                     pa.array([",".join(c) for _, c in found], pa.string())], schema=piece_type)
                piece += len(found)

    pieces = ranged.mapInArrow(join, f"key binary, {PART} int, piece int, text string")
    sorted_pieces = pieces.repartition("key").sortWithinPartitions("key", PART, "piece")

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if k != key:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield digests(done)
            done = []
        if state:
            yield digests([(key, state.hexdigest())])

    def digests(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.string())], names=["key", "ends_sha256"])

    return sorted_pieces.mapInArrow(digest, "key binary, ends_sha256 string")


def shard_sums(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``key``, ``n_leaves`` and ``saved`` of the whole subtree of each node that is marked ``kept``."""
    workers_find_package(nodes.sparkSession)
    kept = nodes.filter("kept").select(
        F.col("key").alias("k_key"), F.col("conv").alias("k_conv"),
        (F.col("n_alone") + (F.col("n_children") == 0).cast("bigint")).alias("leaves"), (F.col("n_convs") - 1).alias("others"), F.col("words").alias("k_words"), "words_above")
    # The ways to kept nodes, as the smallest member of each goes: its prefixes that are kept nodes.
    guides = kept.select(F.col("k_conv").alias("g_conv")).distinct()
    steps = prefixes.select("conv", "depth", "key").join(guides, F.col("conv") == F.col("g_conv"), "left_semi")
    steps = steps.join(kept, F.col("key") == F.col("k_key")).select(
        "conv", F.struct("depth", "key", (F.col("k_conv") == F.col("conv")).alias("own"), "leaves", "others", "k_words", "words_above").alias("step"))
    ways = steps.groupBy("conv").agg(F.array_sort(F.collect_list("step")).alias("way"))
    ways = ways.select("way", F.posexplode("way").alias("at", "step")).filter("step.own")
    above = F.get("way", F.col("at") - 1)
    between = F.coalesce(F.col("step.words_above") - above["words_above"] - above["k_words"], F.lit(0))
    ordered = ways.select(
        F.transform(F.slice("way", F.lit(1), F.col("at") + 1), lambda s: s["key"]).alias("path"), "step.leaves",
        (F.col("step.others") * F.col("step.k_words")).alias("saved"), (F.col("step.others") * between).alias("way_saved"))
    ordered = ordered.repartitionByRange("path").sortWithinPartitions("path")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, values = [], ([], [], [])
        for batch in batches:
            paths += map(tuple, batch.column(0).to_pylist())
            for i, held in enumerate(values):
                held += batch.column(i + 1).to_pylist()
        if paths:
            found = subtree_sums(paths, *values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())],
                names=["key", "n_leaves", "saved"])

    parts = ordered.mapInArrow(run, "key binary, n_leaves bigint, saved bigint")
    return parts.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))


def trie(turns: DataFrame) -> DataFrame:
    """Nodes of the trie of ``turns`` (see ``nodes_of``): smallest member, depth, parent's smallest member, counts, savings, ends."""
    nodes, prefixes = nodes_of(turns)
    kept = (F.col("depth") == 0) | ((F.col("n_convs") > 1) & ((F.col("n_ends") > 0) | (F.col("n_children") > 1)))
    nodes = nodes.withColumn("kept", kept)
    sums = durable(shard_sums(nodes, prefixes), "shard-sums").select(F.col("key").alias("s_key"), F.col("n_leaves").alias("s_leaves"), F.col("saved").alias("s_saved"))
    # A shared node where nothing happens has all members of the next kept node below, so both name the same smallest one.
    rows = nodes.withColumn("up", -F.col("depth")).join(sums, F.col("key") == F.col("s_key"), "left").drop("s_key")
    rows = running(rows, ["conv"], ["up"], {"next_depth": ("min", F.when(F.col("kept"), F.col("depth")))})
    held = nodes.filter("kept").join(sums, F.col("key") == F.col("s_key")).select(
        F.col("conv").alias("n_conv"), F.col("depth").alias("n_depth"), F.col("s_leaves").alias("n_s_leaves"), F.col("s_saved").alias("n_s_saved"),
        F.col("words_above").alias("n_words_above"))
    rows = rows.join(held, (F.col("conv") == F.col("n_conv")) & (F.col("next_depth") == F.col("n_depth")) & ~F.col("kept") & (F.col("n_convs") > 1), "left")
    others = F.col("n_convs") - 1
    rows = rows.withColumns({
        "n_leaves": F.when(F.col("kept"), F.col("s_leaves")).when(F.col("n_convs") == 1, 1).otherwise(F.col("n_s_leaves")),
        "saved_tokens": F.when(F.col("kept"), F.col("s_saved")).when(F.col("n_convs") == 1, 0).otherwise(
            F.col("n_s_saved") + others * (F.col("n_words_above") - F.col("words_above")))})
    above = nodes.select(F.col("key").alias("p_key"), F.col("conv").alias("parent_conv"))
    ends = end_digests(prefixes).withColumnRenamed("key", "e_key")
    none = hashlib.sha256(b"").hexdigest()
    found = rows.join(above, F.col("parent") == F.col("p_key"), "left").join(ends, F.col("key") == F.col("e_key"), "left")
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
