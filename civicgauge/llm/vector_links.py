"""Operator 7: near-duplicate vectors by spherical-cap filters from structured random product codes.

A filter is a direction of the unit sphere; a vector falls in its cap if their inner product reaches a threshold. The
directions are a product code: after a random rotation the space is cut into blocks, each with its own random unit words,
and a direction is one word of each block. So the inner product with any direction is a sum of block terms, and a vector is
list-decoded to *all* directions over the threshold from the blocks' sorted terms, without going through the code. Two
vectors that share a filter are candidates; they are verified by their cosine in double precision.

The number of directions follows the number of vectors, and the threshold follows from it so that a vector of random
direction falls in about ``lists`` caps, whatever the input's size. A vector far from all directions also takes those within
``margin`` of its best one, so none is without filters. Vectors at the cosine of 0.98 share about three of four filters.

Equal vectors with equal labels are one class with a size. A filter's classes meet in tiles of at most ``block`` by ``block``,
each tile in a task of its own, so that a filter with a third of all vectors is split. A pair counts in the smallest filter
that both have, so it is counted once however many they share, and pairs are not written out: a tile returns a row for
each class with its number of links there and a class it is connected with.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and vectors without a label
link with nothing; vectors of different lengths are not compared; repeated rows are vectors of their own that link with each
other; a row with a null id takes part and is named after the smallest other id it reaches; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicgauge.llm.components import components
from civicgauge.llm.tasks import list_column, map_groups, map_rows
from civicgauge.session import durable

BLOCKS, LISTS, MARGIN, TILE = 4, 16, 0.06, 1024


@lru_cache(maxsize=8)
def product_code(size: int, words: int, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """Random rotation (padded to whole blocks) and the blocks' unit words, the same in every task."""
    order = np.random.default_rng([size, words, blocks])
    width = -(-size // blocks)
    rotation, _ = np.linalg.qr(order.standard_normal((width * blocks, width * blocks)))
    code = order.standard_normal((blocks, words, width))
    return rotation[:size], code / np.linalg.norm(code, axis=2, keepdims=True)


def decode(units: np.ndarray, words: int, lists: float = LISTS, margin: float = MARGIN) -> list[np.ndarray]:
    """Numbers of all filter directions over the threshold for each unit vector, in ascending order."""
    rotation, code = product_code(units.shape[1], words)
    blocks, _, width = code.shape
    parts = (units @ rotation).reshape(len(units), blocks, width)
    terms = np.einsum("nbw,bkw->nbk", parts, code) / np.sqrt(blocks)
    # Halves of the code: all sums of the first blocks against the sorted sums of the last ones.
    half = blocks // 2
    threshold = NormalDist().inv_cdf(1 - min(0.5, lists / float(words) ** blocks)) / np.sqrt(units.shape[1])
    out = []
    for row in terms:
        left, right = row[0], row[half]
        for term in row[1:half]:
            left = (left[:, None] + term).ravel()
        for term in row[half + 1:]:
            right = (right[:, None] + term).ravel()
        order = np.argsort(right)
        ascending = right[order]
        over = min(threshold, left.max() + ascending[-1] - margin)
        first = np.searchsorted(ascending, over - left, side="left")
        counts = len(ascending) - first
        hits = np.flatnonzero(counts)
        lengths = counts[hits]
        at = np.repeat(first[hits] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        out.append(np.sort(np.repeat(hits, lengths) * len(ascending) + order[at]))
    return out


def classes_of(vectors: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """Usable vectors with the class of their equals: ``class_id``, ``label`` and ``vector`` of each usable row."""
    values = F.col(vector).cast("array<double>")
    usable = F.col(label).isNotNull() & (F.size(values) > 0) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable &= F.exists(values, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).alias("id"), F.when(F.coalesce(usable, F.lit(False)), class_id(vector, label)).alias("class_id"),
                          F.col(label).alias("label"), F.col(vector).alias("vector"))
    return rows.filter(F.col("class_id").isNotNull())


def class_id(vector: str, label: str):
    return F.unhex(F.md5(F.concat_ws("|", F.col(label).cast("string"), F.col(vector).cast("array<double>").cast("string"))))


def tile_links(rows: pa.Table, cosine: float) -> list | None:
    """Links inside one tile (of its block 0 with block 1, or of a block with itself) that count in this filter.

    For each class with links: its id, the id of a class it is connected with, and its number of links.
    """
    values, at = list_column(rows, "vector")
    matrix = values.reshape(rows.num_rows, -1).astype(np.float64)
    matrix /= np.abs(matrix).max(axis=1, keepdims=True)
    matrix /= np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    block = rows.column("block").to_numpy()
    two = bool(block.any())
    left = np.flatnonzero(block == 0)
    right = np.flatnonzero(block) if two else left
    linked = matrix[left] @ matrix[right].T >= cosine
    if not two:
        linked &= np.arange(len(left))[:, None] < np.arange(len(left))
    if not linked.any():
        return None
    at_left, at_right = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    # A smaller filter that both have makes a pair count there.
    here, (numbers, at) = rows.column("here")[0].as_py(), list_column(rows, "filters")
    lists = [x[x < here] for x in (numbers[at[k]:at[k + 1]] for k in np.concatenate((left[at_left], right[at_right])))]
    _, number = np.unique(np.concatenate(lists), return_inverse=True)
    has = np.zeros((len(lists), number.max(initial=-1) + 1), dtype=np.float32)
    has[np.repeat(np.arange(len(lists)), [len(x) for x in lists]), number] = 1
    own = linked[np.ix_(at_left, at_right)] & (has[:len(at_left)] @ has[len(at_left):].T == 0)
    i, j = np.nonzero(own)
    if not len(i):
        return None
    i, j = left[at_left[i]], right[at_right[j]]
    sizes, n = rows.column("size").to_numpy(), rows.num_rows
    counts = np.bincount(i, weights=sizes[j], minlength=n) + np.bincount(j, weights=sizes[i], minlength=n)
    root = np.arange(n)
    while True:  # smallest position reachable inside the tile
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = least[least]
        if (least == root).all():
            break
        root = least
    members, ids = np.flatnonzero(counts), rows.column("class_id").to_pylist()
    return [[ids[m] for m in members], [ids[root[m]] for m in members], [int(counts[m]) for m in members]]


def near_vectors(vectors: DataFrame, cosine: float = 0.98, lists: float = LISTS, margin: float = MARGIN, tile: int = TILE,
                 id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Id, ``n_links``, ``component_id`` and ``kept`` of each row."""
    usable = classes_of(vectors, id_column, vector, label)
    classes = durable(usable.groupBy("class_id").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("size"), F.min("id").alias("least")), "vector-classes")
    # Filters in proportion to the vectors: the code's words are that number's root.
    words = max(16, round(classes.count() ** (1 / BLOCKS)))

    def make():
        def run(ids, rows):
            out: list = [None] * len(ids)
            sizes = np.array([len(r) for r in rows])
            for size in sorted(set(sizes.tolist())):
                at = np.flatnonzero(sizes == size)
                matrix = np.array([rows[k] for k in at], dtype=np.float64)
                matrix /= np.abs(matrix).max(axis=1, keepdims=True)
                for k, found in zip(at, decode(matrix / np.linalg.norm(matrix, axis=1, keepdims=True), words, lists, margin)):
                    out[k] = found
            return [ids, out]

        return run

    filters = map_rows(classes, ["class_id", "vector"], "class_id binary, filters array<long>", make, rows=2048)
    listed = durable(classes.join(filters.withColumnRenamed("class_id", "listed"), F.col("class_id") == F.col("listed")).select(
        "class_id", "label", "vector", "size", "filters"), "vector-filters")
    caps = listed.select("class_id", "label", F.size("vector").alias("length"), F.explode("filters").alias("filter"))
    full = caps.groupBy("label", "length", "filter").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    tiles = caps.join(full, ["label", "length", "filter"])
    tiles = tiles.withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    tiles = tiles.withColumn("beside", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("class_id", "label", "length", "filter", F.least("own", "beside").alias("low"), F.greatest("own", "beside").alias("high"),
                         (F.col("own") > F.col("beside")).cast("int").alias("block"))
    tiles = tiles.join(listed.select("class_id", "vector", "size", "filters"), "class_id")
    tiles = tiles.withColumn("here", F.col("filter"))
    found = durable(map_groups(tiles, ["label", "length", "filter", "low", "high"], "class_id binary, other binary, links long",
                               lambda rows: tile_links(rows, cosine)), "vector-links")
    roots = components(found.select(F.col("class_id").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    named = classes.select("class_id", "size", "least").join(links, "class_id", "left").join(roots, F.col("class_id") == F.col("node"), "left").select(
        "class_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), "least", F.coalesce("root", "class_id").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(names, "root").select(F.col("class_id").alias("named"), "links", "component")
    # The hash of a vector that is not usable is no class's.
    rows = vectors.select(F.col(id_column).alias("id"), class_id(vector, label).alias("class_id"))
    rows = rows.join(named, F.col("class_id") == F.col("named"), "left")
    component = F.coalesce("component", "id")
    return rows.select(F.col("id").alias(id_column), F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                       F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
