"""Operator 3: token counts of a document's sections by offset-mapped attribution.

A whole document is encoded once. The characters that each token spans are joined as intervals with the characters of
the sections, and a token that reaches over a border between sections is allocated by a stated rule:

- ``first``: to the section that holds its first character (the default; counts are whole numbers);
- ``largest``: to the section that holds most of its characters, the earlier one of equals;
- ``split``: in parts, by the share of its characters in each section.

A token that holds only some bytes of a character spans that character. So the counts of a document's sections add up
to its tokens, which sections counted on their own would not. Sections are either the lines of a text, each with the line
break that ends it, or several text columns that are encoded as one text in their order.

Defined results: a null or empty text has one empty section (number 0, no tokens); a null field is an empty section; texts
of any length are encoded whole; repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from civicgauge.llm.bpe import TEXTS_AT_ONCE, Encoder, default_path, encoder
from civicgauge.llm.tasks import map_rows, text_or_empty

RULES = ("first", "largest", "split")


def token_spans(work: Encoder, text: str, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of the characters that each token spans."""
    ends = np.cumsum(work.voc.lengths[np.frombuffer(packed, dtype="<u4")])
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    if text.isascii():
        return starts, ends
    leads = (np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80
    character = np.cumsum(leads) - 1  # of each byte
    return character[starts], character[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str = "first") -> np.ndarray:
    """Tokens of each section; section ``i`` spans the characters ``bounds[i]`` to ``bounds[i + 1]``."""
    n = len(bounds) - 1
    home = np.searchsorted(bounds, starts, side="right") - 1  # of equal bounds the last: empty sections get nothing
    if rule == "first":
        return np.bincount(home, minlength=n)[:n].astype(float)
    counts = np.zeros(n)
    crossing = ends > bounds[home + 1]
    np.add.at(counts, home[~crossing], 1.0)
    for start, end, at in zip(starts[crossing], ends[crossing], home[crossing]):
        to = int(np.searchsorted(bounds, end, side="left"))  # sections at .. to - 1 hold the token
        held = np.minimum(bounds[at + 1:to + 1], end) - np.maximum(bounds[at:to], start)
        if rule == "split":
            counts[at:to] += held / (end - start)
        else:
            counts[at + int(np.argmax(held))] += 1.0
    return counts


def _checked(rule: str) -> str:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    return rule


def line_token_counts(docs: DataFrame, tokenizer: str | None = None, rule: str = "first", text: str = "text",
                      id_column: str = "doc_id") -> DataFrame:
    """A row for each line of each text: ``section`` (from 0), ``start`` and ``end`` (characters), ``n_tokens`` (double)."""
    rule = _checked(rule)

    def make():
        work = encoder(tokenizer or default_path())

        def run(keys, texts):
            out = [[], [], [], [], []]
            for key, text, packed in zip(keys, texts, work.encode(texts)):
                breaks = [0]
                at = text.find("\n")
                while at >= 0:
                    breaks.append(at + 1)
                    at = text.find("\n", at + 1)
                if breaks[-1] < len(text) or len(breaks) == 1:
                    breaks.append(len(text))
                bounds = np.array(breaks)
                counts = attribute(*token_spans(work, text, packed), bounds, rule) if text else np.zeros(1)
                n = len(counts)
                for column, values in zip(out, ([key] * n, range(n), breaks[:-1], breaks[1:], counts.tolist())):
                    column += values
            return out

        return run

    kind = dict(docs.dtypes)[id_column]
    return map_rows(docs, [id_column, text_or_empty(text)], f"`{id_column}` {kind}, section int, start long, end long, n_tokens double", make,
                    TEXTS_AT_ONCE)


def field_token_counts(rows: DataFrame, fields: list[str], tokenizer: str | None = None, rule: str = "first",
                       id_column: str = "doc_id") -> DataFrame:
    """Each row with the tokens of each field, the fields being encoded as one text: ``tokens_<field>`` (double)."""
    rule = _checked(rule)

    def make():
        work = encoder(tokenizer or default_path())

        def run(keys, *columns):
            whole = ["".join(parts) for parts in zip(*columns)]
            counts = []
            for parts, text, packed in zip(zip(*columns), whole, work.encode(whole)):
                bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
                counts.append(attribute(*token_spans(work, text, packed), bounds, rule) if text else np.zeros(len(parts)))
            return [keys, *([c[i] for c in counts] for i in range(len(columns)))]

        return run

    kind = dict(rows.dtypes)[id_column]
    schema = ", ".join([f"`{id_column}` {kind}", *(f"`tokens_{f}` double" for f in fields)])
    return map_rows(rows, [id_column, *map(text_or_empty, fields)], schema, make, TEXTS_AT_ONCE)
