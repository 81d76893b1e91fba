"""The exact quantile operator agrees with Spark's percentile."""
import random

from pyspark.sql import functions as F

from tillroll.operators.quantiles import exact_quantiles, quantile_columns


def _rows():
    rnd = random.Random(7)
    rows = [("a", float(rnd.randint(0, 50))) for _ in range(400)]          # many repeats
    rows += [("b", rnd.random() * 1000) for _ in range(301)]               # distinct values
    rows += [("c", 5.0)]                                                   # single value
    rows += [("d", None)]                                                  # only null: absent
    return rows


def test_distributed_plan_matches_percentile(spark):
    df = spark.createDataFrame(_rows(), "g string, v double")
    qs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    want = {(r.g, q): v for r in df.groupBy("g").agg(
        F.percentile("v", F.array(*[F.lit(q) for q in qs])).alias("p")).collect()
        if r.p is not None for q, v in zip(qs, r.p)}
    got = {(r.g, r.q): r.value for r in exact_quantiles(df, ["g"], "v", qs).collect()}
    assert set(got) == set(want)
    for k in want:
        assert abs(got[k] - want[k]) <= 1e-9 * max(1.0, abs(want[k])), (k, got[k], want[k])


def test_global_group(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 10]], "x double")
    cap = quantile_columns(df, [], "x", {"cap": 0.99}).first().cap
    assert abs(cap - 9.79) < 1e-12


def test_wide_groups_at_bench_scale(spark):
    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    want = lines.groupBy("l_returnflag").agg(F.percentile("l_extendedprice", F.array(F.lit(0.25), F.lit(0.99))).alias("p")).collect()
    got = {(r.l_returnflag, r.q): r.value for r in exact_quantiles(lines, ["l_returnflag"], "l_extendedprice", [0.25, 0.99]).collect()}
    assert len(got) == 2 * len(want)
    for r in want:
        for q, v in zip((0.25, 0.99), r.p):
            assert abs(got[r.l_returnflag, q] - v) <= 1e-9 * abs(v)
