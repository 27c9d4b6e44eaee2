import random
import types

import pytest
from pyspark.sql import functions as F

from folioquery import scratch


def test_a_cluster_needs_a_shared_folder(spark):
    unset = types.SimpleNamespace(get=lambda name, default: default)
    for master, is_error in (("spark://host:7077", True), ("yarn", True), ("local-cluster[2,1,1024]", True), ("local[4]", False)):
        session = types.SimpleNamespace(conf=unset, sparkContext=types.SimpleNamespace(master=master, applicationId="app"))
        if is_error:
            with pytest.raises(ValueError):
                scratch.shared_dir(session)
        else:
            assert scratch.shared_dir(session) == scratch.shared_dir(session)
    assert scratch.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_workspace_goes(spark):
    with scratch.Workspace(spark, "t") as work:
        path = work.path
        assert work.table(spark.range(5), "a").count() == 5 and scratch.exists(spark, path)
    assert not scratch.exists(spark, path)
    with pytest.raises(RuntimeError), scratch.Workspace(spark, "t") as work:
        work.table(spark.range(5), "a")
        raise RuntimeError
    assert not scratch.exists(spark, work.path)


def test_joins_by_measured_bytes(spark):
    narrow = scratch.materialize(spark.createDataFrame([(i, "x" * 1000) for i in range(50)], "id long, s string"), "t")
    assert 50_000 < scratch.measured_bytes(narrow) < 60_000
    wide = spark.range(100)
    for limit, broadcast in ((10_000, False), (100_000, True)):
        joined = scratch.join_checked(wide, narrow, "id", limit=limit)
        assert joined.count() == 50
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) is broadcast, plan
    nested = spark.createDataFrame([([1],)], "a array<int>")
    with pytest.raises(TypeError):
        scratch.measured_bytes(nested)


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "é", None, "b"]), i, rng.randint(0, 9), 1) for i in range(500)]
    df = spark.createDataFrame(rows, "s string, i long, n long, range_no int").repartition(7)
    with scratch.Workspace(spark, "t") as work:
        got = scratch.running_sums(df, ["s", F.desc("i")], {"n": "before", "range_no": "place"}, work).collect()
        assert scratch.running_sums(df.limit(0), ["s", "i"], {"n": "before"}, work).count() == 0
    want, total = {}, 0
    for k, (s, i, n, _) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), -r[1]))):
        want[s, i] = (total, k)
        total += n
    assert {(r["s"], r["i"]): (r["before"], r["place"]) for r in got} == want and all(r["range_no"] == 1 for r in got)


def test_free_names(spark):
    df = spark.range(1).withColumns({"A": F.lit(1), "a_": F.lit(1)})
    assert scratch.free_names(df, "a", "b", "b") == ["a__", "b", "b_"]


@pytest.mark.parametrize("most", [1 << 20, 60, 0])
def test_last_value_before_equals_a_window(spark, most):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.choice([None, None, None, [], [str(i)]]), "x") for i in range(500)]
    rows += [(k, 0, None, "lone") for k in range(10, 40)] + [(50, i, None, "none") for i in range(100)] + [(51, i, ["at once"] if i == 0 else None, "one") for i in range(100)]
    df = spark.createDataFrame(rows, "key long, n long, value array<string>, range_no string").repartition(7)
    got = scratch.last_before(df, "key", ["n"], "value", "known", most)
    assert got.columns == ["key", "n", "value", "range_no", "known"]
    last, want = {}, []
    for key, n, value, other in sorted(rows, key=lambda r: (r[1], repr(r[0]))):
        want.append((key, n, value, other, last.get(key)))
        if value is not None:
            last[key] = value
    shown = lambda rs: sorted(map(tuple, rs), key=repr)
    assert shown(got.collect()) == shown(want)
    assert scratch.last_before(df.limit(0), "key", ["n"], "value", "known", most).count() == 0


def test_a_long_key_is_spread_over_tasks(spark):
    rows = spark.range(1_000_000).select(F.lit(1).alias("key"), F.col("id").alias("n"), F.when(F.col("id") % 1000 == 7, F.array(F.col("id").cast("string"))).alias("value"))
    got = scratch.last_before(rows, "key", ["n"], "value", "known", 1000)
    assert got.select(F.spark_partition_id().alias("p")).groupBy("p").count().filter("count > 50000").count() > 3
    right = F.when(F.col("n") > 7, F.array((F.floor((F.col("n") - 8) / 1000) * 1000 + 7).cast("long").cast("string")))
    assert got.filter(~F.col("known").eqNullSafe(right)).count() == 0 and got.count() == 1_000_000
