"""Operator 10: near-duplicate texts by SuperMinHash signatures, banding, verification on full sets, and components.

A text's set holds the 64-bit hashes of its distinct word shingles. SuperMinHash gives each element one random place in a
permutation of the signature's positions at each level, and a value that grows with the level; so positions are correlated,
their estimate varies less than with independent hashes, and the walk stops at the first level that can change nothing.
Levels are worked through for all elements of many texts at once.

Texts with one and the same set are one class from then on, whatever their number. Signatures are cut into bands, and
classes that share a band are candidates:

1. each class is compared with the smallest class of its bands (as many pairs as band rows, not all pairs of a group);
2. links found join classes into components; bands whose classes are all in one component are done;
3. in the other bands classes of different components are compared, in tiles of bounded size: a band over that size is cut
   into blocks by its volume, those of its largest component apart. Each two blocks meet in a task of their own, but for
   two of the largest component, whose classes are joined already; so a large group costs its size times what is left
   outside of it. A task returns the links that join components only.

So each candidate pair is decided by links on full sets, and none is dropped for the size of its group. With 20 bands of
5 positions a pair at the threshold of 0.85 misses all bands with a probability of 8 in a million.

Defined results: null or empty texts and texts without words have an empty set and link with nothing; texts with fewer
words than a shingle have their whole word sequence as one element; repeated rows are each in their class; a row with a
null id is returned with its own set's component and not kept; an empty table gives an empty table; other columns are not
read. The smallest id of a component is its name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicgauge.llm.components import components
from civicgauge.llm.tasks import list_column, map_groups, map_rows, text_or_empty
from civicgauge.session import durable

SHINGLE, PER_CENT = 5, 80
BANDS, BAND_ROWS = 20, 5
#: Elements signed at once, and shingles of a block in a tile.
ELEMENTS_AT_ONCE, BLOCK_SHINGLES = 60_000, 300_000
SLOTS = 1 << 18
KEPT_WORDS = 400_000
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hash of each word met; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str, words_in_one: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; letters A-Z are lowered, words end at ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, dtype=_U)
    values = np.fromiter(map(hashes.__getitem__, words), dtype=_U, count=len(words))
    n = max(1, len(values) - words_in_one + 1)
    whole = np.full(n, min(len(values), words_in_one), dtype=_U)
    for k in range(min(len(values), words_in_one)):
        whole = mixed(whole * _U(0x9E3779B97F4A7C15) + values[k:k + n])
    return np.unique(whole)


def signatures(elements: np.ndarray, owners: np.ndarray, n_owners: int, length: int) -> np.ndarray:
    """SuperMinHash signature of each owner's elements (infinite where it has none)."""
    found = np.full(n_owners * length, np.inf)
    for at in range(0, len(elements), ELEMENTS_AT_ONCE):
        seeds, own = mixed(elements[at:at + ELEMENTS_AT_ONCE]), owners[at:at + ELEMENTS_AT_ONCE]
        places = np.tile(np.arange(length, dtype=np.uint16), (len(seeds), 1))
        rows = np.arange(len(seeds))
        for level in range(length):
            value = level + (mixed(seeds + _U(2 * level + 1)) >> _U(11)) * 2.0 ** -53
            swap = level + ((mixed(seeds + _U(2 * level + 2)) >> _U(32)) * _U(length - level) >> _U(32)).astype(np.int64)
            place = places[rows, swap]
            places[rows, swap] = places[rows, level]
            np.minimum.at(found, own * length + place, value)
            # Later values are at least level + 1: owners whose largest value is below need no more.
            open_owners = found.reshape(n_owners, length).max(axis=1) >= level + 1
            if not open_owners[own].all():
                still = open_owners[own]
                seeds, own, places = seeds[still], own[still], places[still]
                rows = np.arange(len(seeds))
                if not len(seeds):
                    break
    return found.reshape(n_owners, length)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each signature; the bands' numbers are part of it."""
    parts = np.ascontiguousarray(signature).view(_U).reshape(len(signature), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), parts.shape[:2]).copy()
    for k in range(rows):
        keys = mixed(keys * _U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys.view(np.int64)


def sketch(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, band_rows: int = BAND_ROWS, text: str = "text",
           id_column: str = "doc_id") -> DataFrame:
    """``id``, ``n_shingles``, ``set_id`` (128-bit hash of the set) and ``bands`` (keys; none for an empty set) of each row."""
    length = bands * band_rows

    def make():
        hashes = WordHashes()

        def run(keys, texts):
            sets = [shingles(t, shingle, hashes) for t in texts]
            sizes = np.array([len(s) for s in sets])
            filled = np.flatnonzero(sizes)
            packed = np.concatenate([sets[i] for i in filled]) if len(filled) else np.empty(0, dtype=_U)
            owners = np.repeat(np.arange(len(filled)), sizes[filled])
            keyed = band_keys(signatures(packed, owners, len(filled), length), bands, band_rows) if len(filled) else []
            of = dict(zip(filled.tolist(), keyed))
            return [keys, sizes.tolist(), [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [of.get(i, np.empty(0, np.int64)) for i in range(len(sets))]]

        return run

    kind = dict(docs.dtypes)[id_column]
    return map_rows(docs, [F.col(id_column).alias("id"), text_or_empty(text)], f"id {kind}, n_shingles long, set_id binary, bands array<long>", make)


def full_sets(docs: DataFrame, shingle: int, text: str = "text") -> DataFrame:
    """``set_id`` and ``elements`` of each row."""
    def make():
        hashes = WordHashes()

        def run(texts):
            sets = [shingles(t, shingle, hashes) for t in texts]
            return [[xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [s.view(np.int64) for s in sets]]

        return run

    return map_rows(docs, [text_or_empty(text)], "set_id binary, elements array<long>", make)


def tile_links(rows: pa.Table, per_cent: int) -> list | None:
    """Links that join components among the sets of one tile. ``block`` 0 or 1 tells the two blocks of a tile apart;

    sets of one block are compared with each other only in the tile of that block with itself (where all are 0). There the
    sets of the component with the most of them are compared with the others only.
    """
    elements, at = list_column(rows, "elements")
    ids, sizes, block = rows.column("set_id").to_pylist(), np.diff(at), rows.column("block").to_numpy()
    roots = rows.column("root").to_pylist()
    name = {c: i for i, c in enumerate(dict.fromkeys(roots))}
    root, parent = [name[c] for c in roots], list(range(len(name)))
    if len(name) == 1:
        return None

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    two_blocks = bool(block.any())
    ones = np.array(root)
    last = block == 1 if two_blocks else ones == np.argmax(np.bincount(ones))
    distinct, number = np.unique(elements, return_inverse=True)
    owner, held = np.repeat(np.arange(len(ids)), sizes), number
    if two_blocks:
        owner, held = owner[last[owner]], number[last[owner]]
    owner_of = owner[np.argsort(held, kind="stable")]
    starts = np.concatenate(([0], np.cumsum(np.bincount(held, minlength=len(distinct)))))
    out: list = [[], []]
    for u in np.flatnonzero(~last).tolist():
        mine = number[at[u]:at[u + 1]]
        # Sets that hold u's elements (in a tile of two blocks, those of the other one), one entry for each element shared.
        lengths = starts[mine + 1] - starts[mine]
        spots = np.repeat(starts[mine] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        common = np.bincount(owner_of[spots], minlength=len(ids))
        fits = 100 * common >= per_cent * (sizes[u] + sizes - common)
        fits &= last if two_blocks else last | (np.arange(len(ids)) > u)
        for v in np.flatnonzero(fits).tolist():
            a, b = top(root[u]), top(root[v])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out[0].append(ids[u])
                out[1].append(ids[v])
    return out if out[0] else None


def links(docs: DataFrame, sketches: DataFrame, shingle: int = SHINGLE, per_cent: int = PER_CENT, text: str = "text",
          id_column: str = "doc_id") -> DataFrame:
    """Pairs ``a``, ``b`` of set ids whose components are those of all links between candidate sets."""
    classes = sketches.filter("n_shingles > 0").groupBy("set_id").agg(
        F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.min("id").alias("id"))
    keyed = classes.select("set_id", "n", "id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("set_id", "n")).alias("lead")).filter("size > 1")
    members = durable(keyed.join(shared, "key").select("key", "set_id", "n", "id", F.col("lead.set_id").alias("lead"), F.col("lead.n").alias("lead_n")), "band-members")
    # The full sets of candidate classes, from one row of each: ids are narrow, texts are read again. Most texts are no
    # candidates and stay where they are: the slots that the candidates' ids hash to, at most `SLOTS`, are known to all tasks.
    wanted = members.select(F.col("id").alias("wanted_id")).distinct()
    slots = wanted.select(F.pmod(F.xxhash64("wanted_id"), F.lit(SLOTS)).alias("slot")).distinct()
    texts = docs.select(F.col(id_column).alias("row_id"), F.col(text).alias("text"))
    texts = texts.join(F.broadcast(slots), F.pmod(F.xxhash64("row_id"), F.lit(SLOTS)) == F.col("slot"), "left_semi").join(
        wanted, F.col("row_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    sets = durable(full_sets(texts, shingle).dropDuplicates(["set_id"]), "full-sets")
    near = (100 * F.least("n", "lead_n") >= per_cent * F.greatest("n", "lead_n")) & (F.col("set_id") != F.col("lead"))
    pairs = members.filter(near).select(F.col("set_id").alias("a"), F.col("lead").alias("b")).distinct()
    first, second = (sets.select(F.col("set_id").alias(c), F.col("elements").alias(f"{c}_elements")) for c in "ab")
    met = pairs.join(first, "a").join(second, "b")
    common = F.size(F.array_intersect("a_elements", "b_elements"))
    either = F.size("a_elements") + F.size("b_elements") - F.col("common")
    starred = durable(met.withColumn("common", common).filter(100 * F.col("common") >= per_cent * either).select("a", "b"), "star-links")

    roots = components(starred)
    placed = members.join(roots, F.col("set_id") == F.col("node"), "left").select(
        "key", "set_id", "n", F.coalesce("root", "set_id").alias("root"))
    # Bands whose sets are still in several components; of bands with the same sets, told by 128 bits, one is enough.
    undone = placed.groupBy("key", "root").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("volume"),
        F.bit_xor(F.xxhash64("set_id")).alias("mark"), F.bit_xor(F.xxhash64(F.lit(1), "set_id")).alias("other_mark"))
    undone = undone.groupBy("key").agg(
        F.count(F.lit(1)).alias("roots"), F.sum("size").alias("size"), F.sum("volume").alias("volume"), F.max(F.struct("volume", "root")).alias("main"),
        F.bit_xor("mark").alias("mark"), F.bit_xor("other_mark").alias("other_mark")).filter("roots > 1")
    undone = undone.groupBy("size", "volume", "mark", "other_mark").agg(F.min(F.struct("key", "main")).alias("one")).select("one.*", "volume")
    # A band of more than one block: blocks of its largest component, after those of the others.
    whole, main = F.col("volume") <= BLOCK_SHINGLES, F.col("main.volume")
    undone = undone.select(
        "key", F.col("main.root").alias("main"), F.when(whole, 1).otherwise(F.ceil((F.col("volume") - main) / BLOCK_SHINGLES)).cast("int").alias("blocks"),
        F.when(whole, 0).otherwise(F.ceil(main / BLOCK_SHINGLES)).cast("int").alias("main_blocks"))
    mark, in_main = F.xxhash64("set_id"), (F.col("main_blocks") > 0) & (F.col("root") == F.col("main"))
    block = F.when(in_main, F.col("blocks") + F.pmod(mark, F.greatest("main_blocks", F.lit(1)))).otherwise(F.pmod(mark, F.col("blocks"))).cast("int")
    met_blocks = F.col("blocks") + F.when(in_main, 0).otherwise(F.col("main_blocks"))
    tiled = placed.join(undone, "key").withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), met_blocks - 1)))
    tiled = tiled.select("key", "set_id", "root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                         (F.col("own") > F.col("other")).cast("int").alias("block"))
    tiled = tiled.join(sets, "set_id")
    rest = map_groups(tiled, ["key", "low", "high"], "a binary, b binary", lambda rows: tile_links(rows, per_cent))
    return starred.unionAll(rest)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, per_cent: int = PER_CENT, bands: int = BANDS, band_rows: int = BAND_ROWS,
                    text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Id, ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``kept`` (whether it is that one) of each row."""
    sketches = durable(sketch(docs, shingle, bands, band_rows, text, id_column), "sketches")
    roots = components(links(docs, sketches, shingle, per_cent, text, id_column))
    classes = sketches.filter("n_shingles > 0").groupBy("set_id").agg(F.min("id").alias("least"))
    classes = classes.join(roots, F.col("set_id") == F.col("node"), "left").select("set_id", "least", F.coalesce("root", "set_id").alias("root"))
    names = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(names, "root").select(F.col("set_id").alias("class_id"), "component_id")
    found = sketches.drop("bands").join(named, F.col("set_id") == F.col("class_id"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_column), "n_shingles", component.alias("component_id"),
                        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
