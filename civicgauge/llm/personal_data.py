"""Operator 8: personal data by candidate generation and gradient-boosted trees.

Base patterns find e-mail addresses, internet addresses, card and phone numbers, leftmost and non-overlapping for each
kind; a match that fails its check is dropped. That misses what stands beside something else: a phone number followed by a
card number is one match of both patterns, and fails. So high-recall generators propose every stretch of digit groups that
could be a number of some kind, and every token around an at sign, as overlapping spans. Boosted trees score them by their
format (digits, groups, separators, check digit) and context (neighbouring characters, cue words), thresholds calibrated
for each kind select, and selected spans that overlap no base span and no better one are added.

The trees learn from base spans themselves: windows around them, in half of which another base span is put beside the
first, so the truth is known where the patterns fail; and from what is none: spoiled values (wrong check digit, part over
255, domain without a dot) and proposals of texts without base spans. What is learnt from is bounded, once: at most
``train_texts`` of all ids whose texts hold three digits or an at sign, and of these texts' base spans and proposals at most
``WINDOWS_PER_TEXT`` times as many, both those with the smallest hashes. A window is cut ``WINDOW`` characters beside its span.
Thresholds are the lowest that reach ``precision`` on windows not learnt from.

Defined results: a null or empty text has no spans; texts of any length are searched whole; a corpus without base spans
gets no model and no added spans; repeated rows are searched each on their own; an empty table gives an empty table; other
columns are not read. Positions are characters, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicgauge.llm.grams import hash_share
from civicgauge.llm.tasks import map_rows, text_or_empty
from civicgauge.operators.ordered import number_rows
from civicgauge.session import durable

KINDS = ("email", "ip", "card", "phone")
TRAIN_TEXTS, PRECISION = 4000, 0.99
WINDOW, WINDOWS_PER_TEXT = 40, 4
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match cannot begin inside a run of digits, so that is not tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_GROUPS = re.compile("[0-9]+")
_RUN = re.compile(r"[+(]{0,2}[0-9](?:[ ().+-]{0,3}[0-9])*")
#: From the beginning of a token only, so that a long one is read once.
_TOKEN = re.compile(r"(?<![^\s<>,;:\"()])[^\s<>,;:\"()]+@[^\s<>,;:\"()]+")
_CUE = re.compile(r"(?i)\b(?:e-?mail|mail|contact|phone|tel|call|mobile|fax|card|visa|credit|pay|ip|host|server|address)\b")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def small_part(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def emails(text: str) -> list[Span]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind and start."""
    found = emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(map(small_part, m.group().split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(len, _GROUPS.findall(m.group()))) <= 15:
                found.append(("phone", *m.span()))
    return found


def proposals(text: str) -> list[Span]:
    """Overlapping spans that could be personal data, sorted and distinct."""
    found: set[Span] = set()
    if "@" in text:
        for m in _TOKEN.finditer(text):
            start, end = m.span()
            while end > start and text[end - 1] in ".!?'":
                end -= 1
            found.add(("email", start, end))
    if _DIGIT.search(text):
        for run in _RUN.finditer(text):
            if run.end() - run.start() < 7:
                continue
            groups = [g.span() for g in _GROUPS.finditer(text, *run.span())]
            for i, (start, _) in enumerate(groups):
                lead = start
                while lead > run.start() and text[lead - 1] in "+(":
                    lead -= 1
                digits = 0
                for j in range(i, len(groups)):
                    digits += groups[j][1] - groups[j][0]
                    end = groups[j][1]
                    if digits > 19:
                        break
                    if 7 <= digits <= 15:
                        found.add(("phone", lead, end))
                    if digits >= 13:
                        found.add(("card", start, end))
                    if j - i == 3 and digits <= 12 and text[start:end].count(".") == 3 and end - start == digits + 3:
                        found.add(("ip", start, end))
    return sorted(found)


def features(text: str, span: Span) -> list[float]:
    """Format and context of a span as numbers."""
    kind, start, end = span
    value = text[start:end]
    groups = _GROUPS.findall(value)
    digits = "".join(groups)
    before, after = text[start - 1:start], text[end:end + 1]
    local, _, domain = value.partition("@")
    last = domain.rpartition(".")[2]
    return [
        KINDS.index(kind), end - start, len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, len({len(g) for g in groups}),
        value.count(" "), value.count("-"), value.count("."), value.count("(") - 2 * value.count(")"), value.startswith("+"),
        len(digits) >= 13 and luhn(digits), all(map(small_part, groups)),
        before in ("", " ", "\n", "\t"), before.isdigit() or before in "+-.(" and before != "", before.isalpha(),
        after in ("", " ", "\n", "\t"), after.isdigit() or after in "-.(" and after != "", after.isalpha(),
        bool(_CUE.search(text, max(0, start - 30), start)), value.count("@"), len(local) if domain else 0, domain.count("."),
        len(last) if last.isalpha() else 0, bool(domain) and set(local) <= _LOCAL and domain.replace(".", "").replace("-", "").isalnum() and domain.isascii()]


class BoostedTrees:
    """Gradient boosting of the logistic loss with small trees over binned features."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start, self.grown = float(np.log(share / (1 - share))), []
        margin = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, p - y, p * (1 - p))
            self.grown.append(tree)
            margin += self._leaves(tree, binned)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(cuts, c, side="left") for cuts, c in zip(self.cuts, x.T)])

    def _grow(self, binned: np.ndarray, gradient: np.ndarray, curve: np.ndarray) -> list:
        """Nodes in the order of a full tree: (feature, bin) of a split, or a leaf's value."""
        nodes: list = [None] * (2 ** (self.depth + 1) - 1)
        place = np.zeros(len(binned), dtype=int)
        for at in range(len(nodes)):
            rows = np.flatnonzero(place == at)
            g, h = gradient[rows], curve[rows]
            value = -self.rate * g.sum() / (h.sum() + self.ridge)
            nodes[at] = float(value)
            if 2 * at + 2 >= len(nodes) or len(rows) < 4:
                continue
            best = (1e-3, 0, 0)
            for f in range(binned.shape[1]):
                size = len(self.cuts[f]) + 1
                left_g = np.cumsum(np.bincount(binned[rows, f], g, size))[:-1]
                left_h = np.cumsum(np.bincount(binned[rows, f], h, size))[:-1]
                if not len(left_g):
                    continue
                gain = left_g ** 2 / (left_h + self.ridge) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + self.ridge) - g.sum() ** 2 / (h.sum() + self.ridge)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-12:
                    best = (float(gain[k]), f, k)
            if best[0] > 1e-3:
                nodes[at] = best[1:]
                place[rows] = np.where(binned[rows, best[1]] <= best[2], 2 * at + 1, 2 * at + 2)
        return nodes

    @staticmethod
    def _leaves(tree: list, binned: np.ndarray) -> np.ndarray:
        out, waiting = np.zeros(len(binned)), [(0, np.arange(len(binned)))]
        while waiting:
            at, rows = waiting.pop()
            if not isinstance(tree[at], tuple):
                out[rows] = tree[at]
                continue
            feature, cut = tree[at]
            left = binned[rows, feature] <= cut
            waiting += [(2 * at + 1, rows[left]), (2 * at + 2, rows[~left])]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        return 1 / (1 + np.exp(-self.start - sum(self._leaves(t, binned) for t in self.grown)))


#: Values of the same form that are none: a wrong check digit, a part over 255, a domain without a dot.
SPOILED = {
    "card": lambda v: v[:-1] + str((int(v[-1]) + 1) % 10),
    "ip": lambda v: "3" + v.partition(".")[0].zfill(2)[-2:] + "." + v.partition(".")[2],
    "email": lambda v: v.replace(".", "").replace("%", ""),
}


class Model:
    """Trees and the threshold of each kind."""

    def __init__(self, windows: list[tuple[str, str, int, int]], precision: float = PRECISION) -> None:
        """``windows``: text, kind, start and end of a base span in it; kind is empty where the text has none."""
        order = np.random.default_rng(0)
        x, y, group = [], [], []
        def examples(k: int, text: str, truth: set[Span]) -> None:
            truth = truth | set(base_spans(text))
            for span in proposals(text):
                x.append(features(text, span))
                y.append(span in truth)
                group.append(k % 4 == 0)

        real = [w for w in windows if w[1]]
        for k, (text, kind, start, end) in enumerate(windows):
            if not kind:
                examples(k, text, set())
                continue
            beside, value = ("", "", 0, 0), text[start:end]
            if order.random() < 0.5:  # another base span beside the first
                beside = real[int(order.integers(len(real)))]
            spoiled = kind in SPOILED and order.random() < 0.5  # and the same place with a value that fails its check
            for value, holds in [(value, True), *([(SPOILED[kind](value), False)] if spoiled else [])]:
                stop, (other_text, other_kind, a, b) = start + len(value), beside
                after = f" {other_text[a:b]}" if other_kind else ""
                truth = {(kind, start, stop)} if holds else set()
                if other_kind:
                    truth.add((other_kind, stop + 1, stop + 1 + b - a))
                examples(k, text[:start] + value + after + text[end:], truth)
        x, y, held = np.array(x, dtype=float), np.array(y, dtype=float), np.array(group)
        self.trees = BoostedTrees().fit(x[~held], y[~held])
        scores, self.thresholds = self.trees.predict(x[held]), {}
        for i, kind in enumerate(KINDS):
            of = x[held][:, 0] == i
            ranked = np.argsort(-scores[of], kind="stable")
            hits = np.cumsum(y[held][of][ranked]) / np.arange(1, len(ranked) + 1)
            enough = np.flatnonzero(hits >= precision)
            self.thresholds[kind] = float(scores[of][ranked][enough[-1]]) if len(enough) else 2.0
            self.thresholds[kind] = max(0.5, self.thresholds[kind])

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Selected proposals, best first, that overlap neither base spans nor each other."""
        known = set(base)
        spans = [s for s in proposals(text) if s not in known]
        if not spans:
            return []
        scores = self.trees.predict(np.array([features(text, s) for s in spans], dtype=float))
        taken = Taken(base)
        chosen = []
        for k in np.argsort(-scores, kind="stable"):
            kind, start, end = spans[k]
            if scores[k] >= self.thresholds[kind] and taken.free(start, end):
                taken.add(start, end)
                chosen.append(spans[k])
        return chosen


class Taken:
    """Places that spans have taken, as intervals apart from each other, in order."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted((a, b) for _, a, b in spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def free(self, start: int, end: int) -> bool:
        after = bisect_right(self.ends, start)  # the first interval that ends behind the start
        return after == len(self.starts) or self.starts[after] >= end

    def add(self, start: int, end: int) -> None:
        at = bisect_right(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


def by_kind(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def learn(docs: DataFrame, train_texts: int = TRAIN_TEXTS, precision: float = PRECISION, text: str = "text", id_column: str = "doc_id") -> Model | None:
    """Model fitted on windows of the bounded sample; only these windows come to the driver."""
    def make():
        def run(keys, texts):
            out = [[], [], [], [], []]
            for key, value in zip(keys, texts):
                # Of a text without base spans, its proposals: what is no personal data.
                for kind, start, end in base_spans(value) or [("", a, b) for _, a, b in proposals(value)]:
                    at = max(0, start - WINDOW)
                    for column, x in zip(out, (key, value[at:end + WINDOW], kind, start - at, end - at)):
                        column.append(x)
            return out

        return run

    texts = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    # The ids of all texts that may hold something; then ids alone are chosen from and broadcast.
    some = durable(texts.filter(F.col("text").rlike("@|[0-9]{3}") & F.col("id").isNotNull()).select(F.col("id").alias("chosen")), "candidate-ids")
    some = some.filter(hash_share("chosen", train_texts, some.count())).distinct().orderBy(F.xxhash64("chosen"), "chosen").limit(train_texts)
    sample = texts.join(F.broadcast(some), F.col("id") == F.col("chosen"), "left_semi")
    kind = dict(sample.dtypes)["id"]
    windows = durable(map_rows(sample, ["id", "text"], f"id {kind}, window string, kind string, start int, end int", make), "windows")
    # Equal windows of copies teach nothing new. Numbered by their hashes, so no more than the bound leave the tasks: half of it for either sort.
    windows = windows.select("window", "kind", "start", "end").distinct().withColumn("real", F.col("kind") != "")
    windows = number_rows(windows, ["real"], [F.xxhash64("window", "kind", "start", "end")], "rank")
    rows = windows.filter(F.col("rank") <= WINDOWS_PER_TEXT // 2 * train_texts).select("window", "kind", "start", "end").collect()
    windows = sorted(map(tuple, rows))
    return Model(windows, precision) if sum(w[1] != "" for w in windows) >= 20 else None


def find(docs: DataFrame, model: Model | None, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Of each row: the id, base counts, ``base_sha256``, and all spans as text and as structs."""
    def make():
        def run(keys, texts):
            counts, digests, spans = {k: [] for k in KINDS}, [], []
            for value in texts:
                base = by_kind(base_spans(value))
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(as_text(base).encode()).hexdigest())
                spans.append(as_text(by_kind(base + model.added(value, base))) if model else as_text(base))
            return [keys, *counts.values(), digests, spans]

        return run

    kind = dict(docs.dtypes)[id_column]
    return map_rows(docs, [id_column, text_or_empty(text)], f"`{id_column}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string", make)


def masked(value: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones together, replaced by its kind in brackets."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [value[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*out, value[done:]])


def redact(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the personal data of the text replaced; null texts stay null."""
    def clean(value: str) -> str:
        base = base_spans(value)
        spans = base + (model.added(value, base) if model else [])
        return masked(value, spans) if spans else value

    @F.pandas_udf("string")
    def redacted(values):
        return values.map(clean, na_action="ignore")

    return docs.withColumn(text, redacted(F.col(text)))
