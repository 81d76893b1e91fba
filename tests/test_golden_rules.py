"""Golden check against the published rule file: rebuild baskets with the
counts its numbers imply and recompute support, confidence and lift."""
from tillroll.operators import itemsets as I
from tillroll.operators import rules as R

# First two published rules (N = 19,960 invoices).
N = 19960
PUBLISHED = [
    ("PINK REGENCY TEACUP AND SAUCER", "GREEN REGENCY TEACUP AND SAUCER",
     0.031663326653306616, 0.8261437908496734, 16.278213292556252),
    ("GREEN REGENCY TEACUP AND SAUCER", "PINK REGENCY TEACUP AND SAUCER",
     0.031663326653306616, 0.6238894373149063, 16.27821329255625),
]


def test_published_pair(spark):
    a, c = PUBLISHED[0][0], PUBLISHED[0][1]
    both = round(PUBLISHED[0][2] * N)               # 632
    n_a = round(both / PUBLISHED[0][3])               # 765
    n_c = round(both / PUBLISHED[1][3])               # 1013
    rows = []
    for i in range(N):
        if i < both:
            rows += [(str(i), a), (str(i), c)]
        elif i < n_a:
            rows.append((str(i), a))
        elif i < n_a + (n_c - both):
            rows.append((str(i), c))
    pairs = spark.createDataFrame(rows, "basket string, item string")
    its = I.frequent_itemsets(pairs, N, 0.03, 3)
    got = {(r.antecedents_str, r.consequents_str): r for r in R.association_rules(its, 0.3, 1.0).collect()}
    for ante, cons, s, conf, lift in PUBLISHED:
        r = got[(ante, cons)]
        assert abs(r.support - s) < 1e-15
        assert abs(r.confidence - conf) < 1e-15
        assert abs(r.lift - lift) < 1e-12


def test_display_rounding_is_half_even(spark):
    from tillroll.operators.rules import round_half_even
    rows = spark.createDataFrame([(0.125,), (0.375,), (2.5,), (0.0625,), (0.3,)], "x double").select("x", round_half_even("x", 2).alias("r"), round_half_even("x", 0).alias("w")).collect()
    assert [(r.r, r.w) for r in rows] == [(round(r.x, 2), round(r.x, 0)) for r in rows]
