"""Text that holds records or booleans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicgauge.functions.text import as_column


def parse_object(text: Column | str, schema: T.StructType | str) -> Column:
    """Object text -> struct of typed fields, whatever the order of its keys."""
    return F.from_json(as_column(text), schema)


def normalise_bool(text: Column | str) -> Column:
    """``"yes"``/``true``/``no``/``false`` with stray quotes or braces -> boolean, other text -> null."""
    word = F.lower(F.trim(F.regexp_replace(as_column(text).cast("string"), r'["{}]', "")))
    return F.when(word.isin("yes", "true"), True).when(word.isin("no", "false"), False)


def bool_flag(text: Column | str) -> Column:
    """1, 0 or null."""
    return normalise_bool(text).cast("int")
