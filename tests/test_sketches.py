"""Sketches merge to the bounds they promise; plot feeds keep their size."""
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001
from oracle_util import compare, duck
from tillroll.operators import segments as G
from tillroll.operators import sketches as SK

NAMES = ["distinct_sketches", "quantile_sketches", "density_customers", "density_products", "reservoir_customers"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    res = compare(E.queries()[name](spark, SF001), duck(SF001), E.oracle_sql()[name])
    assert res["spark_rows"] > 0 and res.get("exact"), res


def test_sketches_beyond_their_exact_range(spark):
    """More values than registers or a level's entries, in unequal parts that overlap; nulls, one value only, empty tables."""
    df = spark.range(300_000).selectExpr("cast(sqrt(id) / 60 as int) as part", "id % 70000 as a", "if(id % 3 = 0, null, id) as b", "1L as c")
    got = SK.merged_distinct(SK.distinct_sketches(df, F.col("part"), ["a", "b", "c"]), [F.lit(0).alias("key")]).collect()
    want = {"a": 70_000, "b": 200_000, "c": 1}
    assert {r.metric for r in got} == set(want) and all(abs(r.estimate - want[r.metric]) <= SK.DISTINCT_ERROR * want[r.metric] for r in got)
    long = df.selectExpr("part", "explode(array(named_struct('f', 'a', 'v', a * 1D), named_struct('f', 'b', 'v', b * 1D), named_struct('f', 'c', 'v', c * 1D))) as s").select("part", "s.*")
    q = SK.merged_quantiles(SK.quantile_sketches(long, ["f", "part"]), ["f"], [0.01, 0.5, 0.99])
    checked = SK.checked_quantiles(long, q, ["f"]).collect()
    assert len(checked) == 9 and all(r.within_error for r in checked) and {r.n for r in checked} == {300_000, 200_000}
    wrong = SK.checked_quantiles(long.where("f <> 'c'"), q.withColumn("value", F.col("value") * 1.1 + 1), ["f"]).collect()
    assert not any(r.within_error for r in wrong if r.q == 0.5)
    assert SK.merged_quantiles(SK.quantile_sketches(long.limit(0), ["f", "part"]), ["f"], [0.5]).count() == 0


def test_density_counts_all_points_and_reservoirs_merge(spark):
    rng = random.Random(3)
    rows = [(f"c{k}", rng.choice("xyz") if k % 7 else None, rng.gauss(0, 1), 5.0) for k in range(3000)] + [("n", "x", None, 1.0)]
    df = spark.createDataFrame(rows, "id string, Segment string, x double, y double")
    cells = G.density(df.where("id <> 'n'"), "x", "y", 10).collect()
    assert sum(r.n for r in cells) == 3000 and {r.cell_y for r in cells} == {0} and {r.cell_x for r in cells} <= set(range(10))
    assert G.density(df, "x", "y", 10).agg(F.sum("n")).first()[0] == 3000
    whole = {r.id for r in G.reservoir(df, "id", 20).collect()}
    halves = [G.reservoir(df.where(F.expr(f"hash(id) % 2 {op} 0")), "id", 20) for op in ("=", "<>")]
    assert len(whole) == 80 and {r.id for r in G.reservoir(halves[0].unionByName(halves[1]), "id", 20).collect()} == whole
    assert G.density(df.limit(0), "x", "y").count() == 0
