"""Streams over several micro-batches with late rows, logs of upserts, runs and hosts, measured sizes."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from verbatrix.operators import relational as R
from verbatrix.operators import runs
from verbatrix.operators.sizing import join_measured, measured_bytes
from verbatrix.streaming import incremental as M


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def stream(spark, folder, batches, schema):
    """A stream of one micro-batch a list of rows, in their order."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{folder}/b{i}")
        (part,) = (x for x in os.listdir(f"{folder}/b{i}") if x.endswith(".parquet"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{folder}/b{i}/{part}", f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 0, minute, second)


def test_upserts_over_batches_follow_their_rules(spark, tmp_path):
    batches = [[(1, 1, "a", 5, "x"), (1, 2, "b", 3, None), (2, 1, "c", 1, "y")], [(2, 2, "d", 0, None)], [(1, 3, "e", 4, "z"), (3, 1, "f", 9, "w")]]
    schema = "k int, n int, new string, top int, filled string"
    got = M.drain_upserts(stream(spark, str(tmp_path), batches, schema), ["k"], ["n"], {"top": "max", "filled": "coalesce", "n": "keep"})
    want = spark.createDataFrame([], schema)
    for b in batches:
        want = R.upsert(want, spark.createDataFrame(b, schema), ["k"], {"top": "max", "filled": "coalesce", "n": "keep"}, ["n"])
    assert rows(got) == rows(want) and len(rows(got)) == 3


def test_changes_over_batches_leave_late_rows_out(spark, tmp_path):
    batches = [[("u", 1, "a"), ("u", 3, "b")], [("u", 2, "z"), ("v", 9, "q")], [("u", 4, "b"), ("u", 5, "c"), ("v", None, "x")]]
    got = M.drain(M.changes(stream(spark, str(tmp_path), batches, "k string, n long, v string"), "k", "v", "n"))
    assert rows(got) == [("u", 3, "a", "b"), ("u", 5, "b", "c")]


def test_windows_over_batches_drop_what_is_too_late(spark, tmp_path):
    batches = [[("a", at(1)), ("a", at(2))], [("a", at(30))], [("a", at(31))], [("a", at(3)), ("a", at(59))], [("a", at(59, 30))], [("a", at(59, 40))]]
    got = M.drain(M.tumbling(stream(spark, str(tmp_path), batches, "k string, ts timestamp"), "ts", ["k"], "10 minutes", "5 minutes"))
    assert rows(got.select(F.minute("window_start"), "n")) == [(0, 2), (30, 2)]  # minute 3 came after its window had closed


def test_late_duplicates_over_batches(spark, tmp_path):
    batches = [[(1, at(1)), (2, at(2))], [(1, at(3))], [(3, at(4)), (2, at(5))]]
    got = M.drain(M.late_dedupe(stream(spark, str(tmp_path), batches, "id long, ts timestamp"), "ts", ["id"], "1 hour"))
    assert [r["id"] for r in got.orderBy("id").collect()] == [1, 2, 3]


def test_sessions_over_batches(spark, tmp_path):
    batches = [[("a", at(1))], [("a", at(4)), ("a", at(20))], [("a", at(50))]]
    got = M.drain(M.sessions(stream(spark, str(tmp_path), batches, "k string, ts timestamp"), "ts", ["k"], "5 minutes", "1 minute"))
    assert rows(got.select(F.minute("session_start"), "n")) == [(1, 2), (20, 1)]


def test_runs_and_hosts(spark):
    now = F.lit(at(10))
    beats = spark.createDataFrame([("r", at(1)), ("r", at(9, 30)), ("s", at(8)), (None, at(9)), ("t", None)], "run string, ts timestamp")
    assert rows(runs.active_runs(beats, "run", "ts", now).select("run", "active")) == [("r", True), ("s", False)]
    items = spark.createDataFrame([("r", "done", at(0)), ("r", "done", at(2)), ("r", "failed", at(4)), ("s", "done", at(1))], "run string, status string, ts timestamp")
    assert rows(runs.progress(items, "run", "status", "ts", 5)) == [("r", 2, 1, 2, 0.5, 4.0), ("s", 1, 0, 4, None, None)]
    log = [("a", at(1), True), ("a", at(2), False), ("b", at(1), False), ("b", at(2), False), ("c", at(1), False), ("c", at(9), False), ("d", at(9), None), ("d", at(9), False), ("d", at(9, 30), True), (None, at(1), False)]
    states = runs.circuits(spark.createDataFrame(log, "host string, ts timestamp, ok boolean"), "host", "ts", F.col("ok"), now, 2, 120)
    assert rows(states) == [("a", 1, "closed"), ("b", 2, "half_open"), ("c", 2, "open"), ("d", 0, "closed")]
    assert rows(runs.paced(spark.createDataFrame([("a", i) for i in range(5)], "host string, n int"), "host", [F.asc("n")], 1.5).select("n", "start")) == [(0, 0.0), (1, 0.0), (2, 1.5), (3, 1.5), (4, 3.0)]
    versions = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a"), ("v", 1, "c"), (None, 1, "d")], "url string, n int, t string")
    assert [(r["url"], r["first"]["t"], r["last"]["t"], r["versions"]) for r in runs.first_and_last(versions, "url", ["n"]).orderBy("url").collect()] == [("u", "a", "b", 2), ("v", "c", "c", 1)]
    assert rows(runs.first_seen(versions, ["url"], ["n"])) == [("u", 1, "a"), ("v", 1, "c"), (None, 1, "d")]


def test_groups_without_windows(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, None, 1), (4, None, 2), (5, "b", 0)], "id int, g string, v int")
    assert rows(R.with_group_stats(df, ["g"], low=F.min("id"), n=F.count(F.lit(1))).select("id", "low", "n")) == [(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 3, 2), (5, 5, 1)]
    assert rows(R.flag_top_k(df, "id", ["g"], [F.desc("v")], 1).select("id", "kept")) == [(1, False), (2, True), (3, False), (4, True), (5, True)]
    assert rows(R.merge_survivors(df, "g", "id").select("id", "survivor", "merged_into")) == [(1, 1, None), (2, 1, 1), (3, 3, None), (4, 4, None), (5, 5, None)]


def test_order_within_hot_keys(spark):
    import random

    from verbatrix.operators.statements import with_context

    rng = random.Random(6)
    data = [(i, rng.choice(["a", "a", "a", "b", None, None, "c"]), f"t{i}") for i in range(200)] + [(200, "d", "t200")]
    df = spark.createDataFrame(data, "id int, k string, t string").repartition(7)
    groups = {}
    for i, k, t in data:
        groups.setdefault(k, []).append((i, t))
    want = {i: (n + 1, len(g), " ".join(t for _, t in g[max(0, n - 3) : n + 3])) for g in groups.values() for n, (i, t) in enumerate(g)}
    got = {r["id"]: (r["rank"], r["n"]) for r in R.spread_rank(df, ["k"], [F.asc("id")], total="n").collect()}
    assert got == {i: v[:2] for i, v in want.items()}
    assert {r["id"]: r["context"] for r in with_context(df, "k", "id", "t", 3, 2).collect()} == {i: v[2] for i, v in want.items()}
    few = df.filter("id IN (3, 50, 120, 200)")
    spark.conf.set("spark.sql.shuffle.partitions", "16")  # more parts than rows
    try:
        assert {r["id"]: r["context"] for r in with_context(few.withColumn("k", F.lit("x")), "k", "id", "t", 2, 0).collect()} == {3: "t3", 50: "t3 t50", 120: "t3 t50 t120", 200: "t50 t120 t200"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert with_context(df.limit(0), "k", "id", "t").count() == 0 and R.spread_rank(df.limit(0), ["k"], [F.asc("id")]).count() == 0


def test_sizes_are_measured(spark):
    small = spark.createDataFrame([(1, "x")], "id int, t string")
    large = spark.createDataFrame([(1, "x" * 100_000), (2, None)], "id int, t string")
    nested = spark.createDataFrame([(1, ["x" * 1000] * 50)], "id int, t array<string>")
    assert measured_bytes(small) < 100 and measured_bytes(large) > 100_000 and measured_bytes(nested) > 50_000 and measured_bytes(small.limit(0)) == 0
    left = spark.range(3).withColumnRenamed("id", "k").select(F.col("k").cast("int").alias("id"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan(join_measured(left, large, ["id"])) and rows(join_measured(left, large, ["id"], limit=1000)) == rows(join_measured(left, large, ["id"]))


def test_only_a_missing_subpackage_is_forgiven(monkeypatch):
    import builtins
    import importlib

    import __spark_entry__

    real = builtins.__import__

    def without(name):
        def load(n, *args, **kw):
            if n.startswith("verbatrix.llm"):
                raise ModuleNotFoundError(f"No module named '{name}'", name=name)
            return real(n, *args, **kw)

        return load

    monkeypatch.setattr(builtins, "__import__", without("verbatrix.llm"))
    assert not [x for x in importlib.reload(__spark_entry__).queries() if x.startswith("p1_")]
    monkeypatch.setattr(builtins, "__import__", without("xxhash"))
    with pytest.raises(ModuleNotFoundError):
        importlib.reload(__spark_entry__)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
