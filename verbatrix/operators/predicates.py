"""Predicates and ordering keys that are put together from parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unflagged(json: Column, path: str) -> Column:
    """Is a flag of a JSON text missing, 0 or 'false'? Malformed JSON has no flag."""
    return F.coalesce(F.get_json_object(json, path), F.lit("0")).isin("0", "false")


class Predicates:
    """Named conditions that queries share, each stated once."""

    def __init__(self, **named: Column) -> None:
        self.named = named

    def all_of(self, *names: str) -> Column:
        """Every named condition holds; unknown names are an error, nulls don't hold."""
        return reduce(lambda a, b: a & b, (F.coalesce(self.named[n], F.lit(False)) for n in names), F.lit(True))


def optional_filters(wanted: Mapping[str, object], builders: Mapping[str, object]) -> Column:
    """All conditions whose parameter is given: null and '' leave a condition out; builders maps a parameter to its condition."""
    given = (builders[k](v) for k, v in wanted.items() if v is not None and v != "")
    return reduce(lambda a, b: a & b, given, F.lit(True))


def peer_group(filters: Sequence[Column], id_col: Column, ids: Sequence[object] = ()) -> Column:
    """All filters hold, or the id is listed by name; a group of neither holds nothing."""
    every = reduce(lambda a, b: a & b, filters) if filters else F.lit(False)
    return F.coalesce(every, F.lit(False)) | (F.coalesce(id_col.isin(*ids), F.lit(False)) if ids else F.lit(False))


def rank_in(value: Column, order: Sequence[str]) -> Column:
    """The place of a value in a list, from 0; behind the list for others and nulls."""
    out = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        out = F.when(value == name, F.lit(i)).otherwise(out)
    return out


def ordered(df: DataFrame, keys: Sequence[Column], limit: int, place: str = "place") -> DataFrame:
    """The first `limit` rows by the keys with their places from 1: a top-k, so no more than that meets in one task."""
    named = {f"__k{i}": k for i, k in enumerate(keys)}
    top = df.withColumns(named).orderBy(*(F.asc_nulls_last(k) for k in named)).limit(limit)
    packed = top.agg(F.sort_array(F.collect_list(F.struct(*named, F.struct(*df.columns).alias("row")))).alias("rows"))
    return packed.select(F.posexplode("rows").alias("pos", "r")).select((F.col("pos") + 1).alias(place), "r.row.*")


def scalar(df: DataFrame, column: str, default: object = None) -> object:
    """The first value of a column, or the default if there is no row or it is null."""
    row = df.select(column).first()
    return default if row is None or row[0] is None else row[0]


def with_json_value(json: Column, key: str, value: Column) -> Column:
    """A JSON object of plain values with one key set; an empty or malformed text counts as an empty object."""
    held = F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(held, lambda k, _: k != key), F.create_map(F.lit(key), value.cast("string"))))
