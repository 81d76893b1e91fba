"""Frequent itemsets and rules on the 5-basket fixture, two engines."""
from pyspark.sql import functions as F

from tillroll.operators import itemsets as I
from tillroll.operators import rules as R

BASKETS = [["a", "b"], ["a", "b", "c"], ["a"], [], ["a", "b", "c"]]


def pairs(spark):
    rows = [(str(i), x) for i, b in enumerate(BASKETS) for x in b]
    return spark.createDataFrame(rows, "basket string, item string")


def supports(df):
    return {", ".join(r["items"]): r["support"] for r in df.collect()}


def test_supports(spark):
    its = I.frequent_itemsets(pairs(spark), len(BASKETS), 0.3, 3)
    s = supports(its)
    assert s == {"a": 0.8, "b": 0.6, "c": 0.4, "a, b": 0.6, "a, c": 0.4, "b, c": 0.4, "a, b, c": 0.4}


def test_fpgrowth_agrees(spark):
    arrays = spark.createDataFrame([(str(i), b) for i, b in enumerate(BASKETS)], "basket string, items array<string>")
    a = supports(I.frequent_itemsets(pairs(spark), len(BASKETS), 0.3, 3))
    b = supports(I.frequent_itemsets_fpgrowth(arrays, 0.3, 3))
    assert a == b


def test_rules_with_multi_item_consequents(spark):
    its = I.frequent_itemsets(pairs(spark), len(BASKETS), 0.3, 3)
    rules = {(r.antecedents_str, r.consequents_str): r for r in R.association_rules(its, 0.0, 0.0).collect()}
    ab = rules[("a", "b")]
    assert abs(ab.confidence - 0.75) < 1e-12 and abs(ab.lift - 1.25) < 1e-12
    cb = rules[("c", "b")]
    assert abs(cb.confidence - 1.0) < 1e-12 and abs(cb.lift - 1 / 0.6) < 1e-12
    cab = rules[("c", "a, b")]
    assert abs(cab.confidence - 1.0) < 1e-12 and abs(cab.lift - 1 / 0.6) < 1e-12
    assert len(rules) == 12  # 3 pairs x 2 + 1 triple x 6


def test_recommend_regex_and_literal(spark):
    its = I.frequent_itemsets(pairs(spark), len(BASKETS), 0.3, 3)
    rules = R.association_rules(its, 0.3, 1.0)
    rec = R.recommend(rules, "C", top_n=5).collect()
    assert rec and all("c" in r.interpretation for r in rec)
    assert [r["rank"] for r in rec] == list(range(1, len(rec) + 1))
    assert R.recommend(rules, ".", top_n=3).count() == 3          # regex wildcard
    assert R.recommend(rules, ".", top_n=3, literal=True).count() == 0


def test_prepare_keeps_rare_only_baskets_in_denominator(spark):
    from tillroll.operators.baskets import BasketSpec, prepare
    rows = [("i1", "a", 1), ("i1", "a", 2), ("i2", "a", 1), ("i2", "b", 1), ("i3", "rare", 1)]
    clean = spark.createDataFrame(rows, "InvoiceNo string, Description string, Quantity int")
    pairs, n = prepare(clean, BasketSpec(min_count=2, max_items=500))
    assert n == 3                                     # i3 has only a rare item but still counts
    got = sorted((r.basket, r.item) for r in pairs.collect())
    assert got == [("i1", "a"), ("i2", "a")]          # same item twice in i1 -> one pair


def test_item_cap_keeps_most_frequent(spark):
    from tillroll.operators.baskets import BasketSpec, kept_items
    rows = [(f"b{i}", x) for i in range(5) for x in ("x", "y")] + [("b0", "z")]
    pairs = spark.createDataFrame(rows, "basket string, item string")
    kept = [r.item for r in kept_items(pairs, BasketSpec(min_count=1, max_items=2)).collect()]
    assert sorted(kept) == ["x", "y"]


def test_no_item_is_dropped_by_default(spark):
    from tillroll.operators.baskets import BasketSpec, limited
    pairs = spark.createDataFrame([(f"b{i}", f"x{i}") for i in range(700)], "basket string, item string")
    assert limited(pairs, BasketSpec()).count() == 700


def test_batch_recommendation_matches_text(spark):
    its = I.frequent_itemsets(pairs(spark), len(BASKETS), 0.3, 3)
    rules = R.association_rules(its, 0.0, 0.0)
    got = R.recommend_batch(rules, spark.createDataFrame([("B",), ("zz",), (None,)], "product string"), 100).collect()
    assert {r.antecedents_str for r in got} == {"b", "a, b", "b, c"} and {r.product for r in got} == {"B"}


def test_grid_matches_pivot(spark):
    its = I.frequent_itemsets(pairs(spark), len(BASKETS), 0.3, 3)
    rules = R.association_rules(its, 0.0, 0.0)
    wide = {r["antecedents_str"]: r.asDict() for r in R.rule_matrix_wide(rules, 6).collect()}
    grid = R.rule_grid(rules, 6).collect()
    assert len(grid) == len(wide) * (len(next(iter(wide.values()))) - 1)
    assert all(wide[r.antecedents_str][r.consequents_str] == r.lift for r in grid)


def test_candidates_are_never_broadcast(spark):
    """Only the written table of frequent itemsets is small by proof."""
    from tillroll.operators import itemsets as M
    wide = spark.createDataFrame([(str(b), f"i{k}") for b in range(40) for k in range(12)], "basket string, item string")
    frequent = M.frequent_itemsets(wide, 40, 0.5, 3)
    assert frequent.count() == 12 + 66 + 220
    rows = spark.createDataFrame([(["a", "b"], ["a"], 0)], "items array<string>, itemset array<string>, pos int")
    plan = M._only(rows, spark.createDataFrame([(["a"],)], "itemset array<string>"), "itemset")._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
