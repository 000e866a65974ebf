"""Operator 12: Merkle manifest of a dataset, with proofs gathered by a butterfly exchange.

A leaf is the SHA-256 of a row's fields; within its group (source) leaves ascend by id. While a group has more than one node,
each run of ``fanout`` nodes becomes the hash of their digests; what remains is the group's subroot, and the subroots, in
order of their groups, make the root the same way. A path lists, from the leaf up, what stands before and after its node in
each run, so that anyone can fold a leaf to the root.

- Leaves are numbered within their groups over ranges (``operators.ordered``), so a group of any size is spread, and dealt to
  blocks of ``fanout ** 3`` consecutive ones. A block's own subtree is hashed in one task, a few thousand rows at a time.
- Upper levels are exchanged among blocks. In each round the nodes of a run swap digests: every block below a node holds the
  node's digest, and block number j of one node meets block j of each other (a node with fewer blocks serves several, j
  modulo their number). So each block gets all digests of the run, hashes the parent itself, and is one of the parent's blocks
  in the next round. There is no way down: when the last round is over, every block has its whole upper path. Rounds go over
  the levels of all groups at once, then over the levels of subroots; rows are one a block and neighbour, a few digests wide,
  and each round is written, so that a lost executor repeats one round at most.

Defined results: null fields are ``-``; null groups are a group, before all others; rows without an id are the first ones of
their group; of equal ids the smaller leaf is first; equal rows are leaves of their own. A single leaf is subroot and root,
with an empty path. An empty table gives an empty table. Only the named columns are read, so other columns do not clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicgauge.llm.tasks import map_groups
from civicgauge.operators.ordered import number_rows
from civicgauge.session import durable

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: string, after: string>>"
#: Rounds a million million blocks of a group cannot reach; a tree that would need more is a fault.
MOST_ROUNDS = 12


def leaf_digest(fields: Sequence[Column | str]) -> Column:
    """Each field as its byte count, a colon and itself; a null is ``-``."""
    def piece(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[piece(F.col(c) if isinstance(c, str) else c) for c in fields]), 256)


def _hash(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def climb(digests: list[str], fanout: int = FANOUT, levels: int | None = None) -> list[list[str]]:
    """Levels of a tree from its leaves up: until one node remains, or just as many levels above the leaves."""
    found = [digests]
    while len(found[-1]) > 1 if levels is None else len(found) <= levels:
        found.append([_hash(found[-1][i:i + fanout]) for i in range(0, len(found[-1]), fanout)])
    return found


def path_in(tree: list[list[str]], at: int, fanout: int = FANOUT) -> list[dict[str, str]]:
    """What stands before and after the node of leaf ``at`` in each of its runs below the top of ``tree``."""
    found = []
    for nodes in tree[:-1]:
        run = at - at % fanout
        found.append({"before": "".join(nodes[run:at]), "after": "".join(nodes[at + 1:run + fanout])})
        at //= fanout
    return found


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, digest, lambda d, run: F.sha2(F.concat(run["before"], d, run["after"]), 256))


def path_digest(path: Column) -> Column:
    """Hash of all digests of a path, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda run: F.concat(run["before"], run["after"]))), 256)


def exchange(blocks: DataFrame, keys: Sequence[str], run: Column, place: Column, label: str) -> DataFrame:
    """One round. ``blocks`` has a row for each block: ``keys`` name the tree it is in, ``node`` its node at this level,

    ``lane`` its number among the ``size`` blocks of the node, ``digest`` the node's hash, ``path`` the path so far.

    The result has the parent as each block's node. ``run`` numbers the parents, ``place`` the nodes below one.
    """
    rows = blocks.withColumns({"run": run, "place": place})
    nodes = rows.filter("lane = 0").select(*keys, "run", "place", "size")
    # At most `fanout` nodes a run: what each block must know of the others is how many blocks they are.
    sizes = nodes.groupBy(*[F.col(k).alias(f"s_{k}") for k in keys], F.col("run").alias("s_run")).agg(
        F.array_sort(F.collect_list(F.struct("place", "size"))).alias("sizes"))
    rows = rows.join(sizes, _same(keys, "s", F.col("run") == F.col("s_run"))).drop("s_run", *[f"s_{k}" for k in keys])
    lanes = F.array_max(F.transform("sizes", lambda s: s["size"]))
    sent = rows.select(
        *[F.col(k).alias(f"h_{k}") for k in keys], F.col("run").alias("h_run"), F.struct("place", "digest").alias("node"),
        F.explode(F.sequence(F.col("lane"), lanes - 1, F.col("size"))).alias("to"))
    heard = sent.groupBy(*[f"h_{k}" for k in keys], "h_run", "to").agg(F.array_sort(F.collect_list("node")).alias("heard"))

    def digests(keep: Callable[[Column], Column]) -> Column:
        return F.concat_ws("", F.transform(F.filter("heard", keep), lambda n: n["digest"]))

    step = F.struct(
        digests(lambda n: n["place"] < F.col("place")).alias("before"), digests(lambda n: n["place"] > F.col("place")).alias("after"))
    earlier = F.aggregate(F.filter("sizes", lambda s: s["place"] < F.col("place")), F.lit(0).cast("bigint"), lambda n, s: n + s["size"])
    whole = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda n, s: n + s["size"])
    risen = rows.join(heard, _same(keys, "h", F.col("run") == F.col("h_run"), F.col("lane") == F.col("to"))).withColumns({
        "new_digest": F.sha2(digests(lambda n: F.lit(True)), 256), "new_path": F.concat("path", F.array(step)), "new_lane": earlier + F.col("lane"), "new_size": whole})
    return durable(risen.select(
        *[c for c in blocks.columns if c not in ("node", "lane", "size", "digest", "path")], F.col("run").alias("node"),
        F.col("new_lane").alias("lane"), F.col("new_size").alias("size"), F.col("new_digest").alias("digest"), F.col("new_path").alias("path")), label)


def _rounds(blocks: DataFrame, keys: Sequence[str], fanout: int, label: str) -> DataFrame:
    """Rounds until every tree is one node. Trees that are done wait for the others."""
    done = []
    for _ in range(MOST_ROUNDS + 1):
        left = durable(_with_last(blocks, keys), label)
        done.append(left.filter("last_node = 0").drop("last_node"))
        blocks = left.filter("last_node > 0").drop("last_node")
        if blocks.isEmpty():
            return reduce(DataFrame.unionByName, done)
        blocks = exchange(blocks, keys, F.floor(F.col("node") / fanout), F.col("node") % fanout, label)
    raise RuntimeError("more levels than a tree of rows can have")


def _with_last(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the number of the last node of each block's tree: 0 when the tree is one node."""
    if not keys:
        return blocks.withColumn("last_node", F.lit(blocks.agg(F.max("node")).first()[0]).cast("bigint"))
    last = blocks.groupBy(*[F.col(k).alias(f"m_{k}") for k in keys]).agg(F.max("node").alias("last_node"))
    return blocks.join(last, _same(keys, "m")).drop(*[f"m_{k}" for k in keys])


def _same(keys: Sequence[str], prefix: str, *more: Column) -> Column:
    return reduce(Column.__and__, [*(F.col(k).eqNullSafe(F.col(f"{prefix}_{k}")) for k in keys), *more])


def prove(leaves: DataFrame, group: str, order: str, digest: str, fanout: int = FANOUT, block_levels: int = 3) -> DataFrame:
    """The rows of ``leaves`` with ``path`` (from leaf to root), ``subroot`` and ``root``.

    ``digest`` names the column of leaf hashes, ``order`` the column they ascend by within ``group``.
    """
    per_block = fanout ** block_levels
    kept = [c for c in leaves.columns if c not in (group, digest)]
    rows = leaves.select(F.col(group).alias("tree"), F.col(digest).alias("digest"), F.struct(*kept).alias("carried"), F.col(order).alias("place"))
    numbered = number_rows(rows, ["tree"], ["place", "digest"], "at").withColumn("at", F.col("at") - 1)
    numbered = durable(numbered.select("tree", "digest", "carried", "at", F.floor(F.col("at") / per_block).alias("block")), "leaves")
    sizes = numbered.groupBy("tree").agg((F.max("at") + 1).alias("n"))

    def top(rows: pa.Table) -> list:
        table = rows.sort_by("at")
        whole = climb(table.column("digest").to_pylist(), fanout, None if table.column("single")[0].as_py() else block_levels)
        return [[table.column("tree_name")[0].as_py()], [table.column("block_number")[0].as_py()], [whole[-1][0]]]

    # A tree of one block goes up to its only node; a block of more goes up all its levels, also where it is the last, short one.
    single = F.col("n") <= per_block
    named = numbered.join(sizes.select(F.col("tree").alias("s_tree"), "n"), F.col("tree").eqNullSafe(F.col("s_tree"))).withColumns({
        "single": single, "tree_name": F.col("tree"), "block_number": F.col("block"), "tree_key": F.coalesce(F.concat(F.lit("="), F.col("tree")), F.lit("-"))})
    kind = dict(rows.dtypes)["tree"]
    tops = map_groups(
        named.select("tree_key", "block", "tree_name", "block_number", "single", "digest", "at"), ["tree_key", "block"],
        f"tree {kind}, block long, digest string", top)
    blocks = tops.select(
        "tree", "block", F.col("block").alias("node"), F.lit(0).cast("bigint").alias("lane"), F.lit(1).cast("bigint").alias("size"), "digest",
        F.array().cast(PATH).alias("path"))
    within = _rounds(durable(blocks, "blocks"), ["tree"], fanout, "round").withColumn("subroot", F.col("digest"))
    # The trees become the nodes of one tree: numbered in order, each held by all its blocks.
    trees = number_rows(sizes.select("tree"), [], ["tree"], "node").select(F.col("tree").alias("t_tree"), (F.col("node") - 1).alias("t_node"))
    upper = within.drop("node").join(trees, F.col("tree").eqNullSafe(F.col("t_tree"))).withColumn("node", F.col("t_node")).drop("t_tree", "t_node")
    upper = durable(_rounds(upper, [], fanout, "upper-round"), "upper")

    state = upper.select(
        F.coalesce(F.concat(F.lit("="), F.col("tree")), F.lit("-")).alias("tree_key"), "block", F.lit(None).cast(kind).alias("tree_name"), F.lit(None).cast("boolean").alias("single"),
        F.lit(None).cast("string").alias("digest"), F.lit(-1).cast("bigint").alias("at"), F.lit(None).cast(dict(numbered.dtypes)["carried"]).alias("carried"), "path", "subroot",
        F.col("digest").alias("root"))
    members = named.select(
        "tree_key", "block", "tree_name", "single", "digest", "at", "carried", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"),
        F.lit(None).cast("string").alias("root"))

    def paths(rows: pa.Table) -> list:
        table = rows.sort_by("at")
        above, table = table.slice(0, 1), table.slice(1)
        digests = table.column("digest").to_pylist()
        tree = climb(digests, fanout, None if table.column("single")[0].as_py() else block_levels)
        rest, n = above.column("path")[0].as_py(), len(digests)
        return [table.column("tree_name").to_pylist(), digests, table.column("carried").to_pylist(), [path_in(tree, i, fanout) + rest for i in range(n)],
                above.column("subroot").to_pylist() * n, above.column("root").to_pylist() * n]

    found = map_groups(
        members.unionByName(state), ["tree_key", "block"],
        f"`{group}` {kind}, `{digest}` string, carried {dict(numbered.dtypes)['carried']}, path {PATH}, subroot string, root string", paths)
    return found.select("carried.*", group, digest, "path", "subroot", "root")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id", altered: dict[str, Column] | None = None,
             fanout: int = FANOUT, block_levels: int = 3) -> DataFrame:
    """Of each row: ``order``, ``altered_leaf``, ``group``, ``leaf``, ``path``, ``subroot`` and ``root``.

    ``altered_leaf`` is the leaf of the row with the fields that ``altered`` gives; null without any.
    """
    leaves = docs.select(
        F.col(order), F.col(group).alias("__group"), leaf_digest(fields).alias("leaf"),
        (leaf_digest([altered.get(f, F.col(f)) for f in fields]) if altered else F.lit(None).cast("string")).alias("altered_leaf"))
    return prove(leaves, "__group", order, "leaf", fanout, block_levels).withColumnRenamed("__group", group)


def verify(proven: DataFrame, leaf: str = "leaf") -> DataFrame:
    """Adds ``folded_root``, the root that the leaf and the path lead to, and ``verified``, whether it is the root."""
    return proven.withColumn("folded_root", fold(F.col(leaf), F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))
