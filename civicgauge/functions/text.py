"""Text columns: case, pieces, keys, matching."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word starts at a letter or digit and may hold inner dots and apostrophes; any other character stands alone.
WORD_OR_CHARACTER = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}.'_]*|[^\p{L}\p{N}]"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def title_case(text: Column | str) -> Column:
    """``AG11-FOREST SERVICE`` -> ``Ag11-Forest Service``; ``U.S. FISH`` -> ``U.s. Fish``."""
    def capitalise(word: Column) -> Column:
        first = F.upper(word.substr(1, 1))  # may be two letters: one sharp s becomes SS, of which only one stays large
        return F.concat(first.substr(1, 1), F.lower(F.substring(first, 2, 2)), F.substr(word, F.lit(2)))

    words = F.regexp_extract_all(F.lower(as_column(text)), F.lit(WORD_OR_CHARACTER), F.lit(0))
    return F.array_join(F.transform(words, capitalise), "")


def expand_abbreviations(text: Column | str, fixes: Mapping[str, str]) -> Column:
    """Replace literal spellings, e.g. ``{"U.s.": "U.S."}``; dots are dots, not wildcards."""
    out = as_column(text)
    for wrong, right in fixes.items():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def digits_only(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), r"\D", "")


def keep_characters(text: Column | str, allowed: str) -> Column:
    """Drop every character outside the regex class body ``allowed``."""
    return F.regexp_replace(as_column(text), f"[^{allowed}]", "")


def before_first(text: Column | str, mark: str) -> Column:
    """Text before the first ``mark`` (the whole text if there is none)."""
    return F.substring_index(as_column(text), mark, 1)


def after_first(text: Column | str, mark: str) -> Column:
    """Text after the first ``mark``, null if there is none."""
    value = as_column(text)
    at = F.instr(value, mark)
    return F.when(at > 0, F.substring(value, at + len(mark), F.length(value)))


def nth_piece(text: Column | str, separator: str, n: int, missing: str | None = None) -> Column:
    """The n-th (from 1) trimmed piece of a split on the regex ``separator``."""
    piece = F.trim(F.try_element_at(F.split(as_column(text), separator), F.lit(n)))
    return piece if missing is None else F.coalesce(piece, F.lit(missing))


def make_key(*parts: Column | str, separator: str = "-", null_text: str = "NA") -> Column:
    """Join columns to one label. A null part is spelled out, so two different keys never become the same text."""
    return F.concat_ws(separator, *[F.coalesce(as_column(p).cast("string"), F.lit(null_text)) for p in parts])


def has_text(text: Column | str) -> Column:
    return F.coalesce(F.length(as_column(text)) > 0, F.lit(False))


def match_any(text: Column | str, terms: Sequence[str], ignore_case: bool = False, regex: bool = False) -> Column:
    """True when any term occurs in the text; null text is no match.

    Terms without regex characters are looked up as plain text, which is faster than a regex on long texts.
    """
    value = as_column(text)
    if not terms:
        return F.lit(False)
    if not ignore_case and all(not regex or re.escape(t) == t for t in terms):
        test = reduce(or_, [F.contains(value, F.lit(t)) for t in terms])
    else:
        test = value.rlike(("(?i)" if ignore_case else "") + "|".join(t if regex else re.escape(t) for t in terms))
    return F.coalesce(test, F.lit(False))


def hit_flags(text: Column | str, terms: Mapping[str, str], ignore_case: bool = False) -> dict[str, Column]:
    """One 0/1 column per named regex."""
    return {name: match_any(text, [term], ignore_case, regex=True).cast("int") for name, term in terms.items()}


def count_term(text: Column | str, term: str, ignore_case: bool = False) -> Column:
    """How often a literal term occurs, from the left and without overlaps."""
    value = as_column(text)
    if ignore_case:
        return F.regexp_count(value, F.lit("(?i)" + re.escape(term)))
    without = F.replace(value, F.lit(term), F.lit(""))
    return ((F.octet_length(value) - F.octet_length(without)) / len(term.encode())).cast("int")


def list_items(text: Column | str, separator: str = ", ") -> Column:
    """``"R, HTML"`` -> array; empty items are dropped."""
    return F.filter(F.split(as_column(text), re.escape(separator)), lambda item: item != "")


def join_items(items: Column | str, separator: str = ", ", distinct: bool = False, ordered: bool = False) -> Column:
    """Array of strings -> one string; null elements are skipped."""
    out = as_column(items)
    out = F.array_distinct(out) if distinct else out
    out = F.sort_array(out) if ordered else out
    return F.array_join(out, separator)
