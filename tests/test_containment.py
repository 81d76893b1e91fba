"""Containment through the gram index against plain comparison of all pairs."""
import random

import pytest
from pyspark.sql import functions as F

from tillroll.operators import containment, rules


def pairs(df):
    return sorted((r.text, r.word) for r in df.collect())


def frames(spark, texts, words):
    return spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(w,) for w in words], "word string")


@pytest.mark.parametrize("block", [containment.BLOCK, 3])
def test_pairs_match_brute_force(spark, block):
    rng = random.Random(1)
    draw = lambda n: "".join(rng.choices("ab cé%_.\\\U0001F600", k=n))
    texts = [draw(rng.randint(0, 12)) for _ in range(200)] + ["", "aaa", "aaa", None, "a.*b", "100% x_y"]
    words = [draw(rng.randint(0, 5)) for _ in range(120)] + ["", "a", "aa", "aaaa", None, None, ".*", "%", "no such words", "a", "É"]
    got = pairs(containment.containing(*frames(spark, texts, words), block=block))
    want = sorted((t, w) for t in {x for x in texts if x is not None} for w in {x for x in words if x is not None} if w in t)
    assert got == want and len(want) > 500


def test_empty_sides(spark):
    a, b = frames(spark, ["x"], ["x"])
    assert containment.containing(a, b.where("false")).count() == 0
    assert containment.containing(a.where("false"), b).count() == 0


def test_many_antecedents_without_a_nested_loop(spark):
    """More antecedents than were allowed once, a hot gram among texts and words, products of under three characters."""
    n = 120_000
    table = spark.range(n).select(
        F.concat(F.lit("Set of "), F.hex("id"), F.when(F.col("id") % 3 == 0, F.lit(", Lamp")).otherwise(F.lit(""))).alias("antecedents_str"),
        F.concat(F.lit("item "), F.col("id") % 50).alias("consequents_str"), F.lit(0.1).alias("support"), F.lit(0.5).alias("confidence"),
        (F.pmod(F.xxhash64("id"), F.lit(100_003)) / 1000).alias("lift"))
    products = ["lamp", "LAMP", "set of 1D4C0, lamp", "of", "x", "", "1D4", "absent", "set"]
    got = rules.recommend_batch(table, spark.createDataFrame([(p,) for p in [*products, None]], "product string"), top_n=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = {}
    for r in got.collect():
        rows.setdefault(r["product"], []).append((r["rank"], r.antecedents_str, r.recommended_product, r.lift))
    local = sorted(((-r.lift, r.antecedents_str, r.consequents_str) for r in table.collect()))
    for p in products:
        want = [(k + 1, a, c, -lift) for k, (lift, a, c) in enumerate([x for x in local if p.lower() in x[1].lower()][:3])]
        assert sorted(rows.get(p, [])) == want, p
