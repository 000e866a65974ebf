"""Operator 11: document fingerprints by prefix polynomial hashes.

``Prefixes`` holds, for each place of a text, the hash of all before it: the code points as coefficients of a polynomial at
each of two bases, modulo a prime. The hash of any span is then a difference of two entries, brought to a common power, so two
spans are compared in constant time, and the longest common extension of two places is found by binary search.

A fingerprint has the hash of the whole text, and for each of a few widths (2 to 32 characters, as far as the text has
eight times as many) the smallest span hash in each of ``SLOTS`` classes of the spans of that width. Two texts are compared
at the largest width both have: the share of equal slots among those filled in either estimates the share of their
distinct spans that they have in common (about a third for a text whose second half is replaced). Moved or repeated
passages count as much as ones in place.

``with_following`` hands each document the next one in descending order of ids. Ids are dealt to ranges first, which gives
the bounds; then documents are dealt to these ranges with their texts, once, the first one of each range also to the range
before. A task reads its ranges in order and holds two texts at a time. Equal ids may fill many ranges.

Defined results: a null text is empty; an empty text has an empty list of slots, is like another empty text (1) and unlike any
other (0); a text of one character is its own edited text. Of rows with equal ids the one with the larger text hash comes
first; rows without an id come last. A single row follows itself. Repeated rows are one row each; an empty table gives an
empty table; only id and text are read, so other columns do not clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicgauge.llm.tasks import map_rows, pieces, text_or_empty, workers_find_package
from civicgauge.session import durable

#: A prime whose products fit 64 bits, and two bases: a hash is one of each, 62 bits.
PRIME = (1 << 31) - 1
BASES = (911_382_323, 972_663_749)
WIDTHS = (2, 4, 8, 16, 32)
SPANS_PER_WIDTH = 8
SLOTS = 64
EMPTY = "---"


_P = np.uint64(PRIME)
_POWERS = [np.ones((len(BASES), 1), dtype=np.uint64)] * 2
_HEX = [f"{m:03x}" for m in range(1 << 12)]


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``size`` powers of the bases and of their inverses, from the zeroth on; made once and doubled when too few."""
    if _POWERS[0].shape[1] < size:
        size = 1 << max(12, size.bit_length())
        for k, bases in enumerate((BASES, [pow(b, -1, PRIME) for b in BASES])):
            powers, known = np.ones((len(BASES), size), dtype=np.uint64), 1
            while known < size:
                step = np.array([[pow(b, known, PRIME)] for b in bases], dtype=np.uint64)
                powers[:, known:2 * known] = powers[:, :known] * step % _P
                known *= 2
            _POWERS[k] = powers
    return _POWERS[0], _POWERS[1]


class Prefixes:
    """Hashes of all prefixes of a text. Spans are (start, end), ends exclusive."""

    def __init__(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.size = n = len(codes)
        up, self.down = _powers(n + 1)
        # Terms are below 2**31, so a sum of 2**33 of them fits.
        self.sums = np.zeros((len(BASES), n + 1), dtype=np.uint64)
        np.cumsum((codes + np.uint64(1)) * up[:, :n] % _P, axis=1, out=self.sums[:, 1:])
        self.sums %= _P

    def spans(self, width: int) -> np.ndarray:
        """Hash of every span of that width, in order: 62 bits."""
        n = self.size - width + 1
        if n < 1:
            return np.empty(0, dtype=np.uint64)
        differences = self.sums[:, width:] + _P
        differences -= self.sums[:, :n]
        differences *= self.down[:, :n]  # below 2**32 times below 2**31
        differences %= _P
        return differences[1] << np.uint64(31) | differences[0]

    def span(self, start: int, end: int) -> int:
        low, high = ((int(s[end]) - int(s[start])) * int(d[start]) % PRIME for s, d in zip(self.sums, self.down))
        return high << 31 | low

    def extension(self, start: int, other: Prefixes, at: int) -> int:
        """How many characters from ``start`` on equal those of the other text from ``at`` on."""
        return _largest(min(self.size - start, other.size - at), lambda n: self.span(start, start + n) == other.span(at, at + n))

    def extension_back(self, end: int, other: Prefixes, at: int) -> int:
        """How many characters before ``end`` equal those of the other text before ``at``."""
        return _largest(min(end, at), lambda n: self.span(end - n, end) == other.span(at - n, at))


def _largest(most: int, holds) -> int:
    """The largest n up to ``most`` that holds, where all smaller ones hold too."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if holds(middle) else (low, middle - 1)
    return low


def slots_of(prefixes: Prefixes) -> list[list[str]]:
    """The slots of each width, smallest width first."""
    found = []
    for k, width in enumerate(WIDTHS if prefixes.size else ()):
        if k and prefixes.size < SPANS_PER_WIDTH * width:
            break
        mixed = prefixes.spans(min(width, prefixes.size))
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        slot = (mixed >> np.uint64(58)).view(np.int64)
        mixed <<= np.uint64(6)  # ends in zeros, so no value is as large as an empty slot's
        least = np.full(SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
        np.minimum.at(least, slot, mixed)
        filled = least != np.iinfo(np.uint64).max
        # Twelve middle bits tell the smallest ones apart; their first bits are zeros in long texts.
        marks = (least >> np.uint64(20) & np.uint64(0xFFF)).tolist()
        found.append([_HEX[m] for m in marks] if filled.all() else [_HEX[m] if f else EMPTY for m, f in zip(marks, filled.tolist())])
    return found


def _name(prefixes: Prefixes, slots: list[list[str]]) -> str:
    return ".".join([f"{prefixes.span(0, prefixes.size):016x}{prefixes.size:x}", *map("".join, slots)])


def fingerprint(prefixes: Prefixes) -> str:
    """``hash.slots.slots...``: the whole text's hash and length, then the slots of each width, smallest width first."""
    return _name(prefixes, slots_of(prefixes))


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1: 1 for equal ones."""
    return 1.0 if a == b else _likeness(*([[p[i:i + 3] for i in range(0, 3 * SLOTS, 3)] for p in mark.split(".")[1:]] for mark in (a, b)))


def _likeness(a: list[list[str]], b: list[list[str]]) -> float:
    level = min(len(a), len(b)) - 1
    if level < 0:
        return 0.0
    one, two = a[level], b[level]
    equal = sum(map(str.__eq__, one, two))
    both_empty = sum(x == y == EMPTY for x, y in zip(one, two)) if EMPTY in one and EMPTY in two else 0
    return (equal - both_empty) / (SLOTS - both_empty)


class Reading:
    """What the comparison of neighbours needs of a text."""

    def __init__(self, text: str) -> None:
        self.text, self.prefixes = text, Prefixes(text)
        self.slots = slots_of(self.prefixes)
        self.mark = _name(self.prefixes, self.slots)

    def near(self, other: Reading) -> float:
        return 1.0 if self.mark == other.mark else _likeness(self.slots, other.slots)

    def edited(self, following: str) -> str:
        """The last half of the characters (rounded down) replaced by the first as many of the following text."""
        half = len(self.text) // 2
        return self.text[:len(self.text) - half] + following[:half]

    def beside(self, following: Reading) -> tuple:
        """The columns of ``FOUND`` but the id."""
        edited = Reading(self.edited(following.text))
        start = self.prefixes.extension(0, edited.prefixes, 0)
        return (len(self.text), hashlib.sha256(edited.text.encode()).hexdigest(), self.mark, edited.mark, self.near(edited), self.near(following), start)


FOUND = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_start long"


def fingerprints(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Id and ``fingerprint`` of each row, in the task that reads it."""
    def make():
        return lambda keys, texts: [keys, [fingerprint(Prefixes(t)) for t in texts]]

    return map_rows(docs, [id_column, text_or_empty(text)], f"`{id_column}` {dict(docs.dtypes)[id_column]}, fingerprint string", make)


def with_following(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Of each row: id, ``n_chars``, the edited text's hash, both fingerprints, their likeness, the likeness to the next

    document's fingerprint, and how many characters the text and the edited text have in common at the start.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"`{id_column}` {dict(docs.dtypes)[id_column]}, {FOUND}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    workers_find_package(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text).alias("text")).select(
        F.struct(F.col("id"), F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("row")).alias("place"), "text")
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = first_places(rows, parts)
    part = _part_of(F.col("place"), F.col("bounds"))
    placed = rows.withColumn("bounds", bounds).withColumn("part", part).withColumn(
        "first", F.col("place") == _get(F.col("bounds"), F.col("part"))).withColumn("parts", _count(F.col("bounds")))
    # The first row of a part goes to the part before as well, as the one that follows its last row.
    here = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("part") - 1, F.col("parts")).alias("part"), F.lit(True).alias("guest"))
    dealt = placed.select("place", "text", F.explode(F.when(F.col("first"), F.array(here, before)).otherwise(F.array(here))).alias("to"))
    ordered = dealt.select(F.col("to.part").alias("part"), F.col("to.guest").alias("guest"), "place", "text").repartition(parts, "part").sortWithinPartitions(
        "part", "guest", F.col("place").desc())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            for piece in pieces(batch):
                found = []
                for part, guest, key, value in zip(*(piece.column(i).to_pylist() for i in range(4))):
                    now = Reading(value)
                    if last and last[0] != part:
                        raise RuntimeError("a range of documents has no end")
                    if last:
                        found.append((last[1], *last[2].beside(now)))
                    last = None if guest else (part, key, now)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], field.type) for i, field in enumerate(arrow)], schema=arrow)
        if last:
            raise RuntimeError("a range of documents has no end")

    return ordered.select("part", "guest", F.col("place.id").alias("id"), "text").mapInArrow(run, schema)


# ---- ranges that all know: the first places of each, in blocks of about as many as there are blocks ----

def first_places(rows: DataFrame, parts: int) -> Column:
    """The places, from the largest on, at which ranges of about equal size begin: a constant for every row.

    Spark deals the places alone to ranges; the first of each is a bound. Two levels of lists make the search short.
    """
    placed = durable(rows.select("place").repartitionByRange(parts, F.col("place").desc()).withColumn("part", F.spark_partition_id()), "places")
    firsts = placed.groupBy("part").agg(F.max("place").alias("place"))
    blocks = firsts.agg(F.array_sort(F.collect_list("place")).alias("up")).select(F.reverse("up").alias("all"))
    size = F.ceil(F.sqrt(F.size("all"))).cast("int")
    starts = F.when(F.size("all") > 0, F.sequence(F.lit(1), F.size("all"), size)).otherwise(F.array().cast("array<int>"))
    return blocks.select(F.transform(starts, lambda at: F.slice("all", at, size)).alias("bounds")).scalar()


def _part_of(place: Column, bounds: Column) -> Column:
    """Number of the range of a place: the last one that begins at the place or before it."""
    block = F.size(F.filter(bounds, lambda b: b[0] >= place)) - 1
    size = F.size(bounds[0])
    return block * size + F.size(F.filter(bounds[block], lambda first: first >= place)) - 1


def _get(bounds: Column, part: Column) -> Column:
    size = F.size(bounds[0])
    return bounds[F.floor(part / size).cast("int")][part % size]


def _count(bounds: Column) -> Column:
    return (F.size(bounds) - 1) * F.size(bounds[0]) + F.size(F.element_at(bounds, -1))
