"""Long, wide and nested forms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicgauge.functions.text import join_items, list_items
from civicgauge.operators.aggregate import sum_when, texts_by
from civicgauge.operators.joins import join_null_safe, keep_matching
from civicgauge.session import durable


def pivot_wide(
    df: DataFrame, keys: Sequence[str], name: str, values: Mapping[str, str] | Sequence[str], measure: str | None = None,
    other: str | None = None,
) -> DataFrame:
    """One column per listed value (``{value: column}`` to rename), missing cells 0; counts rows without a measure.

    The values are given, so no extra job looks for them and the schema is fixed. Conditional sums make it one shuffle.
    ``other`` names a column for values off the list, nulls too; without it they are left out.
    """
    columns = dict(values) if isinstance(values, Mapping) else {v: v for v in values}
    cell = F.lit(1) if measure is None else F.col(measure)
    rest = [sum_when(~F.coalesce(F.col(name).isin(list(columns)), F.lit(False)), cell).alias(other)] if other else []
    return df.groupBy(*keys).agg(*[sum_when(F.col(name) == v, cell).alias(c) for v, c in columns.items()], *rest)


def unpivot_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in columns], name, value)


def densify(df: DataFrame, keys: Sequence[str], name: str, values: Sequence[str], measure: str, other: str | None = None) -> DataFrame:
    """Every (key, listed value) pair, absent ones as 0: conditional sums, then back to long. No join.

    ``other`` adds a pair for all values off the list.
    """
    wide = pivot_wide(df, keys, name, values, measure, other)
    return unpivot_long(wide, keys, [*values, *([other] if other else [])], name, measure)


def complete_entities(df: DataFrame, entities: DataFrame, keys: Sequence[str], fill: Mapping[str, object]) -> DataFrame:
    """All entities of the list; those without data get the fill values."""
    return entities.join(df, list(keys), "left").na.fill(dict(fill))


def explode_delimited(df: DataFrame, column: str, separator: str = ", ", into: str | None = None, keep_empty: bool = False) -> DataFrame:
    """One row per item of a delimited text; blanks are dropped. ``keep_empty`` keeps rows without any item."""
    explode = F.explode_outer if keep_empty else F.explode
    return df.withColumn(into or column, explode(list_items(column, separator)))


def item_counts(df: DataFrame, entity: Sequence[str], row_key: str, column: str, separator: str = ", ", name: str = "count") -> DataFrame:
    """(entity, item, number of rows holding the item): the long form of the matrix, for any number of items."""
    items = explode_delimited(df.select(*entity, row_key, column), column, separator)
    return items.distinct().groupBy(*entity, column).agg(F.count(F.lit(1)).alias(name))


def item_matrix(df: DataFrame, entity: Sequence[str], row_key: str, column: str, items: Sequence[str], separator: str = ", ") -> DataFrame:
    """Entity x item counts with one column per listed item. A row counts once per item however often it repeats it."""
    present = list_items(column, separator)
    flags = {f"__item_{at}": F.coalesce(F.array_contains(present, item), F.lit(False)).cast("int") for at, item in enumerate(items)}
    per_row = df.groupBy(*entity, F.col(row_key).alias("__row")).agg(*[F.max(f).alias(name) for name, f in flags.items()])
    return per_row.groupBy(*entity).agg(*[F.sum(name).alias(item) for name, item in zip(flags, items)])


def unnest(df: DataFrame, column: str, prefix: str = "", keep_empty: bool = False) -> DataFrame:
    """One row per array element; struct fields become columns. Rows with an empty array go unless ``keep_empty``."""
    element = df.schema[column].dataType.elementType
    explode = F.explode_outer if keep_empty else F.explode
    rows = df.withColumn(column, explode(column))
    if not isinstance(element, T.StructType):
        return rows
    fields = [F.col(column)[f.name].alias(f"{prefix}{f.name}") for f in element.fields]
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c != column], *fields)


def split_to_columns(df: DataFrame, column: str, separator: str, into: Sequence[str]) -> DataFrame:
    """Fixed columns from a split: extra pieces go, missing ones are null. The source column stays."""
    pieces = F.split(F.col(column), separator)
    return df.withColumns({name: F.try_element_at(pieces, F.lit(i + 1)) for i, name in enumerate(into)})


def consolidate_children(
    df: DataFrame, lists: Mapping[str, tuple[str, str | None]], drop: bool = True, separator: str = ", ",
) -> DataFrame:
    """Child arrays -> sorted distinct text, within the row: ``{new: (array column, struct field or None)}``.

    Higher-order functions replace explode, group and join back, so there is no shuffle.
    """
    out = df.withColumns({
        name: F.when(F.exists(_strings(array, field), lambda v: v.isNotNull()),
                     join_items(_strings(array, field), separator, distinct=True, ordered=True))
        for name, (array, field) in lists.items()})
    return out.drop(*{array for array, _ in lists.values()}) if drop else out


def consolidate_children_by(
    df: DataFrame, keys: Sequence[str], lists: Mapping[str, tuple[str, str | None]], separator: str = ", ",
) -> DataFrame:
    """As above, but over all rows that share the keys: one row per key with the texts."""
    children = F.flatten(F.array(*[_tagged(i, array, field) for i, (array, field) in enumerate(lists.values())]))
    rows = df.select(*keys, F.explode_outer(children).alias("__t")).select(
        *keys, F.col("__t.at").alias("__at"), F.col("__t.v").alias("__v"))
    return texts_by(rows, keys, list(lists), separator)


def consolidate_children_across(
    df: DataFrame, keys: Sequence[str], lists: Mapping[str, tuple[str, str | None]], separator: str = ", ",
    more_keys: Sequence[str] = (), more_lists: Mapping[str, tuple[str, str | None]] | None = None,
) -> DataFrame:
    """Every row with the texts of all rows that share its keys; the arrays stay.

    ``more_lists`` are texts over the rows that share ``more_keys`` as well. Both come from one aggregate: rows that repeat in
    the finer keys repeat in the coarser ones, so one count tells which rows share anything.

    Most rows have keys of their own and get their texts within the row. Keys that repeat are worked out from the key and
    array columns alone and written to the shared folder: their size is then known, and Spark broadcasts them if they are
    few, so that wide rows (long duty texts) need no shuffle, and joins by shuffle if they are many.
    """
    more = dict(more_lists or {})
    every = {**lists, **more}
    narrow = df.select(*keys, *more_keys, *dict.fromkeys(array for array, _ in every.values()))
    repeated = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
    sharing = keep_matching(narrow, repeated, keys)
    if more:
        # Children of the finer lists carry the finer keys, those of the others none of them.
        values = [_tagged(i, array, field).alias(f"__c{i}") for i, (array, field) in enumerate(every.values())]
        no_key = F.lit(None).cast(T.StructType([df.schema[k] for k in more_keys]))
        sides = [F.struct((F.struct(*more_keys) if fine else no_key).alias("own"), F.lit(fine).alias("fine"), F.flatten(F.array(*[
            F.col(f"__c{i}") for i, name in enumerate(every) if (name in more) == fine])).alias("children")) for fine in (False, True)]
        rows = sharing.select(*keys, *more_keys, *values).select(*keys, F.explode(F.array(*sides)).alias("__s")).select(
            *keys, F.col("__s.own").alias("__own"), F.col("__s.fine").alias("__fine"), F.explode_outer("__s.children").alias("__t")).select(
            *keys, "__own", "__fine", F.col("__t.at").alias("__at"), F.col("__t.v").alias("__v"))
        texts = durable(texts_by(rows, [*keys, "__own", "__fine"], list(every), separator), "shared-children")
        fine = texts.filter("__fine").select(*keys, *[F.col("__own")[k].alias(k) for k in more_keys], F.struct(*more).alias("__shared_more"))
        shared = texts.filter("NOT __fine").select(*keys, F.struct(*lists).alias("__shared"))
    else:
        shared = durable(consolidate_children_by(sharing, keys, lists, separator), "shared-children").select(*keys, F.struct(*lists).alias("__shared"))
    rows = join_null_safe(consolidate_children(df, every, drop=False, separator=separator), shared, keys, "left")
    rows = join_null_safe(rows, fine, [*keys, *more_keys], "left") if more else rows
    own = {name: F.when(F.col(held).isNull(), F.col(name)).otherwise(F.col(held)[name])
           for held, names in (("__shared", lists), ("__shared_more", more)) for name in names}
    return rows.withColumns(own).drop("__shared", "__shared_more")


def _tagged(at: int, array: str, field: str | None) -> Column:
    values = F.coalesce(_strings(array, field), F.array().cast("array<string>"))
    return F.transform(values, lambda v: F.struct(F.lit(at).alias("at"), v.alias("v")))


def _strings(array: str, field: str | None) -> Column:
    value = F.col(array) if field is None else F.col(array)[field]  # a field of an array of structs is an array
    return value.cast("array<string>")


def twin_columns(columns: Sequence[str], ending: str = "count", twin: str = "per") -> dict[str, str]:
    """``*count`` columns and their existing ``*per`` twins."""
    pairs = {c: c[: -len(ending)] + twin for c in columns if c.endswith(ending)}
    return {c: t for c, t in pairs.items() if t in columns}


def unpivot_twins(df: DataFrame, ids: Sequence[str], ending: str = "count", twin: str = "per") -> DataFrame:
    """(ids, name, count, per) rows from ``<name>count`` / ``<name>per`` column pairs."""
    pairs = twin_columns(df.columns, ending, twin)
    cells = F.array(*[
        F.struct(F.lit(c[: -len(ending)].rstrip("_")).alias("name"), F.col(c).alias(ending), F.col(t).alias(twin))
        for c, t in pairs.items()])
    return df.select(*ids, F.inline(cells))


def flatten_struct(df: DataFrame, separator: str = "_") -> DataFrame:
    """Nested struct fields as prefixed columns; arrays stay as they are."""
    def leaves(column: Column, kind: T.DataType, name: str) -> list[Column]:
        if not isinstance(kind, T.StructType):
            return [column.alias(name)]
        return [leaf for f in kind.fields for leaf in leaves(column[f.name], f.dataType, f"{name}{separator}{f.name}")]

    return df.select(*[leaf for f in df.schema.fields for leaf in leaves(F.col(f"`{f.name}`"), f.dataType, f.name)])
