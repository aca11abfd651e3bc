"""Relational operators: current versions, ranks with margins, upserts, set differences, distributed running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatrix.functions.urls import host_suffixes
from verbatrix.operators.sizing import join_measured, materialise


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is last by `order` (name the tie-breaks); aggregated map-side, one shuffle on the keys."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return picked.select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest)).select(*df.columns)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def _in_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """df range-partitioned by keys and order, written, with `__p`, the number of its part: a hot key lies in many parts."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(n, *keys, *order).withColumn("__p", F.spark_partition_id()))


def spread_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank", total: str | None = None) -> DataFrame:
    """df with the row's place within its key, from 1, and if named the key's rows in all; no key's rows all meet in one task.

    Rows are ranked within their part of the order, and the counts of a key's earlier parts, one row a key and part, are added.
    Order must be total. Nulls in keys equal each other.
    """
    placed = _in_order(df, keys, order)
    counts = placed.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__n"))
    w = W.partitionBy(*keys)
    sums = counts.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__p").alias("__q"), (F.sum("__n").over(w.orderBy("__p")) - F.col("__n")).alias("__before"), F.sum("__n").over(w).alias("__all"))
    local = F.row_number().over(W.partitionBy("__p", *keys).orderBy(*order))
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__p") == F.col("__q")]
    out = placed.withColumn("__i", local).join(materialise(sums), on)
    return out.select(*df.columns, (F.col("__i") + F.col("__before")).alias(name), *([F.col("__all").alias(total)] if total else []))


def with_edges(df: DataFrame, keys: Sequence[str], order: Sequence[Column], before: int, after: int) -> DataFrame:
    """df in order with `__p`, and `__ghost` copies of the rows at the edges of other parts, so that a window of `before` and `after` rows within (__p, keys) sees what a window within keys would."""
    placed = _in_order(df, keys, order).withColumn("__ghost", F.lit(False))
    # parts may be empty: neighbours are the next ones with rows, one row a part
    numbers = placed.select("__p").distinct().withColumn("__d", F.row_number().over(W.orderBy("__p")))
    placed = placed.join(F.broadcast(numbers), "__p").drop("__p").withColumnRenamed("__d", "__p")
    at = W.partitionBy("__p")
    asc = [*(F.asc(k) for k in keys), *order]
    edges = placed.withColumn("__first", F.row_number().over(at.orderBy(*asc))).withColumn("__n", F.count(F.lit(1)).over(at)).filter((F.col("__first") <= after) | (F.col("__first") > F.col("__n") - before))
    # a part has one row at least, so the rows a window needs lie no more parts away than it has rows
    forth = edges.filter(F.col("__first") > F.col("__n") - before).withColumn("__to", F.explode(F.sequence(F.lit(1), F.lit(before)))) if before else None
    back = edges.filter(F.col("__first") <= after).withColumn("__to", F.explode(F.sequence(F.lit(-after), F.lit(-1)))) if after else None
    for ghosts in (forth, back):
        if ghosts is not None:
            placed = placed.unionByName(ghosts.withColumn("__p", F.col("__p") + F.col("__to")).withColumn("__ghost", F.lit(True)).drop("__first", "__n", "__to").select(*placed.columns))
    return placed


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows of each key; Spark cuts groups map-side (WindowGroupLimit)."""
    return ranked(df, keys, order).filter(F.col("rank") <= k)


def flag_top_k(df: DataFrame, id_col: str, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "kept") -> DataFrame:
    """df with a flag of the k first rows of each key: only those are ranked, the flag comes back by id, so no key's rows all meet in one sort."""
    first = top_k(df, keys, order, k).select(id_col, F.lit(True).alias(name))
    return join_measured(df, first, [id_col], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """df with aggregates of each row's group beside it, nulls in keys equal to each other; groups are pre-aggregated, never gathered."""
    groups = df.groupBy(*keys).agg(*(c.alias(n) for n, c in stats.items())).withColumnsRenamed({k: f"__g_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__g_{k}")) for k in keys]
    return df.join(groups, on).drop(*(f"__g_{k}" for k in keys))


def best_with_margin(df: DataFrame, key: str, item: str, score: str, margin: float) -> DataFrame:
    """(key, item, score, runner_up, ambiguous): the best item of each key and if the next best is within `margin`."""
    two = top_k(df, [key], [F.col(score).desc(), F.col(item)], 2)
    best = two.groupBy(key).agg(
        F.max(F.when(F.col("rank") == 1, F.col(item))).alias(item), F.max(F.when(F.col("rank") == 1, F.col(score))).alias(score), F.max(F.when(F.col("rank") == 2, F.col(score))).alias("runner_up")
    )
    return best.withColumn("ambiguous", F.coalesce(F.col(score) - F.col("runner_up") < margin, F.lit(False)))


def running_sum(df: DataFrame, value: str, order: Sequence[str], out: str = "running", partitions: int | None = None) -> DataFrame:
    """df with the sum of `value` over all rows up to each, in `order` (a total order), without one task for all rows.

    Rows are range-partitioned and sorted, each partition is summed by itself, and the partitions' totals - one row a
    partition - carry over. Nulls add nothing.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))
    totals = placed.groupBy("__p").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("t"))
    before = totals.select("__p", (F.sum("t").over(W.orderBy("__p")) - F.col("t")).alias("__before"))
    local = F.sum(F.coalesce(F.col(value), F.lit(0))).over(W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn("__s", local).join(F.broadcast(before), "__p").withColumn(out, F.col("__s") + F.col("__before")).drop("__p", "__s", "__before")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: dict[str, str] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """old with new written over it by key.

    rules per column: 'new' (default, the new value even if null), 'keep' (the old one stays where there is one), 'max',
    'coalesce' (new unless null). Of several new rows for a key the last by `order` counts.
    """
    rules = rules or {}
    new = latest(new, keys, order) if order else new.dropDuplicates(list(keys))
    rest = [c for c in old.columns if c not in keys]
    o = old.withColumns({f"__o_{c}": F.col(c) for c in rest}).drop(*rest).withColumn("__old", F.lit(True))
    n = new.withColumns({f"__n_{c}": F.col(c) for c in rest}).drop(*rest).select(*keys, *(f"__n_{c}" for c in rest)).withColumn("__new", F.lit(True))
    both = o.join(n, list(keys), "full")
    value = {
        "new": lambda a, b: F.when(F.col("__new"), b).otherwise(a),
        "keep": lambda a, b: F.when(F.col("__old"), a).otherwise(b),
        "max": lambda a, b: F.greatest(a, b),
        "coalesce": lambda a, b: F.coalesce(b, a),
    }
    return both.select(*keys, *(value[rules.get(c, "new")](F.col(f"__o_{c}"), F.col(f"__n_{c}")).alias(c) for c in rest)).select(*old.columns)


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old and the new rows whose key it lacks, one a key."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def merge_survivors(df: DataFrame, group: str, id_col: str) -> DataFrame:
    """df with `survivor` (lowest id of the group), `active` and `merged_into`; rows without a group stay on their own."""
    low = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min(id_col).alias("survivor"))
    # rows without a group find no partner in the join and are not gathered
    return df.join(low, group, "left").select(*df.columns, F.coalesce("survivor", id_col).alias("survivor")).withColumn("active", F.col("survivor") == F.col(id_col)).withColumn("merged_into", F.when(~F.col("active"), F.col("survivor")))


def set_changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that stand on one side only, with `change` added or removed; repeated keys count once, nulls equal nulls."""
    sides = old.select(*keys, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(*keys, F.lit(0).alias("o"), F.lit(1).alias("n")))
    seen = sides.groupBy(*keys).agg(F.max("o").alias("o"), F.max("n").alias("n")).filter(F.col("o") != F.col("n"))
    return seen.select(*keys, F.when(F.col("n") == 1, F.lit("added")).otherwise(F.lit("removed")).alias("change"))


def longest_suffix_join(left: DataFrame, host_col: str, right: DataFrame, site_col: str) -> DataFrame:
    """left with the right row whose site is its host or the nearest parent of it; hosts below no site drop out.

    The theta join 'is or is below' becomes an equi-join on the host's suffixes.
    """
    order = [c for c in left.columns]
    keyed = left.withColumn("__row", F.monotonically_increasing_id())
    keyed = materialise(keyed)
    parts = keyed.select("__row", F.explode(host_suffixes(F.col(host_col))).alias(site_col))
    hit = parts.join(right, site_col).groupBy("__row").agg(F.max_by(F.struct(*right.columns), F.length(site_col)).alias("__r"))
    return keyed.join(hit, "__row").select(*order, *(F.col(f"__r.{c}").alias(c) for c in right.columns))


def overlapping_groups(df: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """df once for every group whose predicate holds (column `peer_group`): overlapping groups in one pass, not one scan each."""
    member = F.array_compact(F.array(*(F.when(p, F.lit(name)) for name, p in groups.items())))
    return df.withColumn("peer_group", F.explode(member))


def unpivot_gates(metrics: DataFrame, key: str, gates: dict[str, tuple[str, float]]) -> DataFrame:
    """(key, gate, value, threshold, passed) of a wide metrics row; gates: column -> ('>=' or '<=', threshold). Null fails."""
    pairs = F.array(*(F.struct(F.lit(c).alias("gate"), F.col(c).cast("double").alias("value"), F.lit(t).alias("threshold"), F.lit(op).alias("op")) for c, (op, t) in gates.items()))
    rows = metrics.select(key, F.explode(pairs).alias("g")).select(key, "g.gate", "g.value", "g.threshold", "g.op")
    passed = F.coalesce(F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold")), F.lit(False))
    return rows.withColumn("passed", passed).drop("op")


def round_robin(df: DataFrame, stratum: str, order: Sequence[Column], n: int) -> DataFrame:
    """n rows taken from the strata in turn: first ranks of all strata, then second ranks, and so on."""
    # no stratum can give more than n rows, so only those are ranked
    return top_k(df, [stratum], order, n).withColumnRenamed("rank", "turn").orderBy("turn", stratum).limit(n)


def evenly(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """k rows of each key at even distances from the first to the last; all rows of keys with up to k."""
    rows = spread_rank(df, keys, order, "__i", "__n").withColumn("__i", (F.col("__i") - 1).cast("int"))
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("__n") - 1) / F.lit(max(1, k - 1)), 0).cast("int"))
    return rows.filter((F.col("__n") <= k) | F.array_contains(at, F.col("__i"))).drop("__i", "__n")
