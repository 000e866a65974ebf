"""Operator 9: secrets by base patterns and by the guess cost of values in credential contexts.

Base patterns find assignments to credential names, access keys and long hexadecimal strings, leftmost and non-overlapping
for each kind; a match that fails its length is dropped. The method adds values that stand in a wider credential context
(more names, ``is`` or ``->`` for the equals sign, sign-in parts of addresses, bearer tokens) and are hard to guess: the
cheapest way to build the value from common words, dates, repeats, keyboard walks and brute-force characters is found by
dynamic programming, and the value counts as a secret from ``least_guesses`` (as a power of ten) on. So ``hunter22`` in
prose about passwords is left alone where ``xK9#vQ2m`` is not. Added spans overlap no base span.

Common words are a fixed list of what passwords are built of, and the words of the table itself by the number of texts that
have them: ``learn_words`` counts every text in its task, and the ``TABLE_WORDS`` most usual go to the tasks. A word that
stands in credential contexts as often as outside them is no word of the language and is not taken.

A step of the programme looks back over one word, date, walk or repeat; brute force goes character by character. A walk or a
repeat may begin anywhere within its run: of the starts only those that can still be the cheapest are held (``Starts``), so a
value of any length is priced in time about in proportion to it.

Defined results: a null or empty text has no spans and no cost; texts of any length are searched whole; repeated rows are
searched each on their own; an empty table gives an empty table; other columns are not read. Positions are characters, ends
exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicgauge.llm.tasks import map_rows, text_or_empty
from civicgauge.operators.ordered import number_rows

KINDS = ("assign", "access", "hex")
ADDED = "guess"
LEAST_GUESSES = 8.0
#: Words learnt from a table: how many, and the least number of texts that have one.
TABLE_WORDS, LEAST_TEXTS = 50_000, 5
LONGEST_WORD = 24
Span = tuple[str, int, int]

# Words that passwords are built of, most usual first, and rows of a keyboard.
COMMON_WORDS = (
    "password pass admin welcome letmein login master secret monkey dragon football baseball princess sunshine shadow love hello "
    "summer winter spring autumn qwerty abc test guest user root default change changeme example sample token key demo public private "
    "access account server system company london paris berlin monday friday january december michael daniel thomas jordan charlie "
    "computer internet superman batman starwars freedom whatever trust hunter killer soccer hockey tigger buster flower cheese pepper "
    "ginger cookie silver orange purple yellow black white green blue red none null true false your here placeholder").split()
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "azertyuiop", "abcdefghijklmnopqrstuvwxyz")
CREDENTIAL_NAMES = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|api[ _-]?key|(?:private|access|client|auth)[ _-]?key|credentials?|bearer|pin"

_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # of a run, all or nothing: a shorter run is a match that fails
_CONTEXT = re.compile(rf"(?<![A-Za-z])(?:{CREDENTIAL_NAMES})[\"'`]?\s{{0,3}}(?:[:=]|->|=>|\bis\b|\bwas\b)\s{{0,3}}[\"'`]?([^\s\"'`,;<>]+)|://[^\s/:@]+:([^\s/@]+)@|\bbearer\s+([^\s\"'`,;<>]+)", re.I | re.A)
_CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "pin", "://")
_WORD = re.compile(rf"\b[^\W\d_]{{3,{LONGEST_WORD}}}\b")  # letters only: no piece of a longer mix of characters
_PLAIN = str.maketrans("@$01345!", "asoieasi")
_NEXT = {row[i:i + 2] for row in KEY_ROWS for i in range(len(row) - 1)} | {row[i + 1] + row[i] for row in KEY_ROWS for i in range(len(row) - 1)}
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")


class Words:
    """Ranks of common words: the fixed ones and those of a table, most usual first; a word on both has the lower rank."""

    def __init__(self, learnt: Iterable[str] = ()):
        self.rank = {w: i + 1 for i, w in enumerate(learnt)}
        for i, w in enumerate(COMMON_WORDS):
            self.rank[w] = min(i + 1, self.rank.get(w, i + 1))
        self.longest = max(map(len, self.rank))


FIXED = Words()


PERIODS = (1, 2, 3, 4)
#: A walk is one of so many: a row to start on, a place, a direction; its length comes on top.
WALK_CHOICES = len(KEY_ROWS) * 10 * 2


class Starts:
    """The cheapest ``best[start] + log10(end - start)`` over the starts of a run that grows at its end.

    Of two starts the one with the larger ``best`` loses for good if it is also the earlier one; if it is the later one, it
    loses for good at the first end where it costs as much, as the lengths draw near each other. So few stay in the list.
    """

    def __init__(self, best: list[float]) -> None:
        self.best, self.added, self.held = best, 0, []

    def clear(self, begin: int) -> None:
        """No run that ends here or later begins before ``begin``."""
        self.added, self.held = begin, []

    def add_up_to(self, last: int) -> None:
        while self.added <= last:
            while self.held and self.best[self.held[-1]] >= self.best[self.added]:
                self.held.pop()
            self.held.append(self.added)
            self.added += 1

    def cheapest(self, end: int) -> float:
        least, kept = math.inf, []
        for start in self.held:
            cost = self.best[start] + math.log10(end - start)
            if cost < least:
                least = cost
                kept.append(start)
        self.held = kept
        return least


def guess_cost(value: str, words: Words = FIXED) -> float:
    """Decimal power of the guesses needed for the cheapest segmentation of ``value``."""
    n, lower = len(value), value.lower()
    lower = lower if len(lower) == n else value
    plain = lower.translate(_PLAIN)
    kinds = (any("a" <= c <= "z" for c in value) * 26 + any("A" <= c <= "Z" for c in value) * 26 + any("0" <= c <= "9" for c in value) * 10
             + any(not (c.isascii() and c.isalnum()) for c in value) * 33)
    brute = math.log10(max(kinds, 10))
    dates: dict[int, list[int]] = {}
    for at in range(n):
        if value[at].isdigit() and (m := _DATE.match(value, at)):
            dates.setdefault(m.end(), []).append(at)
            dates.setdefault(at + 4, []).append(at) if value[at:at + 2] in ("19", "20") and value[at:at + 4].isdigit() else None
    best = [0.0] + [math.inf] * n
    # The starts that a walk, or a repeat of each period, which ends here may have.
    walk, repeats = Starts(best), [Starts(best) for _ in PERIODS]
    for end in range(1, n + 1):
        cost = best[end - 1] + brute
        if end > 1 and plain[end - 2:end] not in _NEXT and lower[end - 2:end] not in _NEXT:
            walk.clear(end - 1)
        walk.add_up_to(end - 3)
        cost = min(cost, walk.cheapest(end) + math.log10(WALK_CHOICES))
        for period, starts in zip(PERIODS, repeats):
            if end <= period or value[end - 1] != value[end - 1 - period]:
                starts.clear(end)
            starts.add_up_to(end - max(2, period))
            cost = min(cost, starts.cheapest(end) + math.log10(period))
        for size in range(3, min(words.longest, end) + 1):
            rank = words.rank.get(lower[end - size:end]) or words.rank.get(plain[end - size:end])
            if rank:
                word = value[end - size:end]
                changed = (word != word.lower()) + (word.lower() not in words.rank)
                cost = min(cost, best[end - size] + math.log10(rank * 10 ** changed + 1))
        for start in dates.get(end, ()):
            cost = min(cost, best[start] + math.log10(365 * 100 if end - start > 4 else 100))
        best[end] = cost
    return best[n]


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by start, then kind."""
    found = []
    lower = text.lower()
    if any(h in lower for h in _HINTS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def context_values(text: str) -> list[tuple[int, int]]:
    """Spans of values in credential contexts."""
    lower = text.lower()
    if not any(h in lower for h in _CONTEXT_HINTS):
        return []
    found = []
    for m in _CONTEXT.finditer(text):
        start, end = m.span(m.lastindex)
        while end > start and text[end - 1] in ".!?)]}":
            end -= 1
        if end > start:
            found.append((start, end))
    return found


def added_spans(text: str, base: list[Span], least_guesses: float = LEAST_GUESSES, words: Words = FIXED) -> list[Span]:
    return [(ADDED, a, b) for a, b in context_values(text)
            if all(b <= start or a >= end for _, start, end in base) and guess_cost(text[a:b], words) >= least_guesses]


def words_of(text: str) -> tuple[set[str], set[str]]:
    """Words outside the values in credential contexts, and words of these values."""
    outside, inside, at = set(), set(), 0
    for a, b in sorted(context_values(text)):
        outside.update(_WORD.findall(text[at:a].lower()))
        inside.update(_WORD.findall(text[a:b].lower()))
        at = b
    outside.update(_WORD.findall(text[at:].lower()))
    return outside, inside


def learn_words(docs: DataFrame, text: str = "text", size: int = TABLE_WORDS, least_texts: int = LEAST_TEXTS) -> list[str]:
    """The most usual words of all texts by the number of texts that have them, ties by the word."""
    def make():
        def run(texts):
            outside, inside = Counter(), Counter()
            for value in texts:
                here, there = words_of(value)
                outside.update(here)
                inside.update(there)
            found = outside.keys() | inside.keys()
            return [list(found), [outside[w] for w in found], [inside[w] for w in found]]

        return run

    counts = map_rows(docs, [text_or_empty(text)], "word string, outside long, inside long", make).groupBy("word").agg(
        F.sum("outside").alias("outside"), F.sum("inside").alias("inside"))
    usual = counts.filter((F.col("outside") >= least_texts) & (F.col("outside") > F.col("inside")))
    # Numbered over ranges, so that no more than `size` rows leave the tasks.
    ranked = number_rows(usual.select("word", "outside"), [], [F.desc("outside"), "word"], "rank").filter(F.col("rank") <= size)
    return [r.word for r in sorted(ranked.select("word", "rank").collect(), key=lambda r: r.rank)]


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, least_guesses: float = LEAST_GUESSES, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Of each row: id, base counts, ``base_sha256``, all spans, and the largest guess cost of a value in a credential context."""
    learnt = learn_words(docs, text)
    order = {k: i for i, k in enumerate((*KINDS, ADDED))}

    def make():
        words = Words(learnt)

        def run(keys, texts):
            counts, digests, spans, costs = {k: [] for k in KINDS}, [], [], []
            for value in texts:
                base = base_spans(value)
                every = sorted(base + added_spans(value, base, least_guesses, words), key=lambda s: (s[1], order[s[0]]))
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(as_text(base).encode()).hexdigest())
                spans.append(as_text(every))
                costs.append(max((round(guess_cost(value[a:b], words), 6) for a, b in context_values(value)), default=None))
            return [keys, *counts.values(), digests, spans, costs]

        return run

    kind = dict(docs.dtypes)[id_column]
    return map_rows(docs, [id_column, text_or_empty(text)],
                    f"`{id_column}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, max_guess_cost double", make)
