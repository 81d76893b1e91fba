"""Association rules (M9, F8, O1) and the rule reports / recommendations
(M10, A15, A17, A20, P6–P8, Q4, Q5, Q19–Q22).

Every non-empty proper subset of a frequent itemset is an antecedent (so rules
with several consequent items exist, unlike ``FPGrowth.associationRules``).
Subsets are enumerated per itemset with bit masks; the two support look-ups
are equi-joins on the array keys.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.text import items_text, regex_contains_ci
from tillroll.operators.containment import containing

RULE_COLS = ["antecedents_str", "consequents_str", "support", "confidence", "lift"]


def rule_order() -> list[Column]:
    """O1: lift descending; ties are real, so break them by the rule text."""
    return [F.desc("lift"), F.asc("antecedents_str"), F.asc("consequents_str")]


def association_rules(itemsets: DataFrame, min_confidence: float = 0.3,
                      min_lift: float = 1.0) -> DataFrame:
    """antecedent/consequent arrays and texts, support, confidence = s(AC)/s(A),
    lift = confidence / s(C), antecedent and consequent support."""
    splits = (itemsets.filter(F.col("length") >= 2)
              .select("items", "support",
                      F.explode(F.expr("sequence(1, shiftleft(1, length) - 2)")).alias("mask"))
              .select("support",
                      F.expr("filter(items, (x, i) -> (shiftright(mask, i) & 1) = 1)").alias("antecedent"),
                      F.expr("filter(items, (x, i) -> (shiftright(mask, i) & 1) = 0)").alias("consequent")))
    sup = itemsets.select("items", F.col("support").alias("s"))
    rules = (splits
             .join(sup.withColumnsRenamed({"items": "antecedent", "s": "antecedent_support"}), "antecedent")
             .join(sup.withColumnsRenamed({"items": "consequent", "s": "consequent_support"}), "consequent")
             .withColumn("confidence", F.col("support") / F.col("antecedent_support"))
             .withColumn("lift", F.col("confidence") / F.col("consequent_support")))
    rules = rules.filter((F.col("lift") >= min_lift) & (F.col("confidence") >= min_confidence))
    return rules.select(
        "antecedent", "consequent",
        items_text("antecedent").alias("antecedents_str"),
        items_text("consequent").alias("consequents_str"),
        "support", "confidence", "lift", "antecedent_support", "consequent_support")


def rule_counts(rules: DataFrame) -> DataFrame:
    """F8 counts: all rules, lift > 2, lift > 3."""
    return rules.agg(F.count(F.lit(1)).alias("total_rules"),
                     F.count_if(F.col("lift") > 2.0).alias("rules_lift_gt_2"),
                     F.count_if(F.col("lift") > 3.0).alias("rules_lift_gt_3"))


def itemset_length_histogram(itemsets: DataFrame) -> DataFrame:
    """A9."""
    return itemsets.groupBy("length").agg(F.count(F.lit(1)).alias("n_itemsets"))


def top_single_items(itemsets: DataFrame, n: int = 15) -> DataFrame:
    """Q20: F13 + O3 + P6 — most supported single items, support in percent."""
    return (itemsets.filter(F.col("length") == 1)
            .select(F.element_at("items", 1).alias("item"), "support",
                    (F.col("support") * 100).alias("support_pct"))
            .orderBy(F.desc("support"), F.asc("item")).limit(n))


def round_half_even(c: Column | str, digits: int) -> Column:
    """Display rounding, ties to the even digit, as plain arithmetic (identical in every engine)."""
    col = F.col(c) if isinstance(c, str) else c
    scale = 10.0 ** digits
    return F.rint(col * scale) / scale


def recommend(rules: DataFrame, product: str, top_n: int = 5, literal: bool = False) -> DataFrame:
    """Rules whose antecedent text contains ``product`` (case-insensitive
    regex by default), strongest ``top_n`` by lift, ranked, with display rounding
    and the interpretation sentence."""
    hits = (rules.filter(regex_contains_ci("antecedents_str", product, literal))
            .orderBy(*rule_order()).limit(top_n))
    rank = F.row_number().over(Window.orderBy(*rule_order()))  # over <= top_n rows
    return hits.select(
        F.lit(product).alias("product"),
        rank.alias("rank"),
        F.col("consequents_str").alias("recommended_product"),
        round_half_even("confidence", 3).alias("confidence"),
        round_half_even("lift", 3).alias("lift"),
        round_half_even("support", 4).alias("support"),
        _interpretation().alias("interpretation"))


def _interpretation() -> Column:
    return F.concat(F.lit("Customers who buy '"), F.col("antecedents_str"), F.lit("' are "),
                    round_half_even("lift", 1).cast("string"), F.lit("x more likely to also buy '"),
                    F.col("consequents_str"), F.lit("'"))


def recommend_batch(rules: DataFrame, products: DataFrame, top_n: int = 5) -> DataFrame:
    """Batch form of M10: for every product in ``products(product)``, the top_n rules
    whose antecedent text contains it (case-insensitive, as the single form does; literal text).

    The distinct lower-cased antecedents are found through an inverted index of grams, whatever their number.  Of an antecedent's rules only
    its first top_n can be among a product's, so no more are joined to the hits.  Top-k: ``WindowGroupLimit``.  Null products get no row.
    """
    key = F.lower("antecedents_str").alias("text")
    wanted = products.select("product").filter("product is not null").distinct().withColumn("word", F.lower("product"))
    own = Window.partitionBy("text").orderBy(*rule_order())
    first = rules.select(key, *RULE_COLS).withColumn("n", F.row_number().over(own)).filter(F.col("n") <= top_n).drop("n")
    hits = containing(rules.select(key), wanted.select("word"))
    w = Window.partitionBy("product").orderBy(*rule_order())
    return (hits.join(first, "text").join(wanted, "word").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
            .select("product", "rank", F.col("consequents_str").alias("recommended_product"),
                    "antecedents_str", "confidence", "lift", "support"))


def recommendable_products(rules: DataFrame) -> DataFrame:
    """Distinct antecedent texts (sorted on output) with their total."""
    distinct = rules.select(F.col("antecedents_str").alias("product")).distinct()
    total = distinct.select(F.count(F.lit(1))).scalar()
    return distinct.select("product", total.alias("total"))


def top_rules(rules: DataFrame, n: int = 20) -> DataFrame:
    """Q19: top n rules with the bar label (P8) and lift scaled to 0..1 over the
    shown rules (A20; the window runs over <= n rows)."""
    top = rules.orderBy(*rule_order()).limit(n)
    allw = Window.partitionBy()
    mn, mx = F.min("lift").over(allw), F.max("lift").over(allw)
    return top.select(
        F.row_number().over(Window.orderBy(*rule_order())).alias("position"),
        *RULE_COLS,
        F.concat(F.substring("antecedents_str", 1, 30), F.lit("  →  "),
                 F.substring("consequents_str", 1, 25)).alias("label"),
        F.concat(F.substring("antecedents_str", 1, 38), F.lit("  →  "),
                 F.substring("consequents_str", 1, 33)).alias("long_label"),
        (F.col("confidence") * 100).alias("confidence_pct"),
        ((F.col("lift") - mn) / (mx - mn + F.lit(1e-9))).alias("strength"))


def rule_matrix(rules: DataFrame, n: int = 15) -> DataFrame:
    """Q21/A15 long form: max lift per (antecedent, consequent) over the top n
    rules, with the truncated axis labels (35 / 30 characters)."""
    top = rules.orderBy(*rule_order()).limit(n)
    return (top.groupBy("antecedents_str", "consequents_str").agg(F.max("lift").alias("max_lift"))
            .select(F.substring("antecedents_str", 1, 35).alias("row_label"),
                    F.substring("consequents_str", 1, 30).alias("col_label"),
                    "antecedents_str", "consequents_str", "max_lift"))


def rule_matrix_wide(rules: DataFrame, n: int = 15) -> DataFrame:
    """A15 as the heat-map grid: one row per antecedent, one column per
    consequent of the top n rules, missing cells 0 (Spark ``pivot``)."""
    top = rules.orderBy(*rule_order()).limit(n)
    return (top.groupBy("antecedents_str").pivot("consequents_str").agg(F.max("lift")).na.fill(0.0))


def rule_grid(rules: DataFrame, n: int = 15) -> DataFrame:
    """A15 grid with its cells in one column: a row per antecedent of the top n rules with the
    lifts of all their consequents in text order, missing cells 0."""
    top = rules.orderBy(*rule_order()).limit(n)
    cells = top.groupBy("antecedents_str", "consequents_str").agg(F.max("lift").alias("lift"))
    columns = cells.agg(F.array_sort(F.collect_set("consequents_str")).alias("columns")).select("columns").scalar()  # <= n texts
    by_row = cells.groupBy("antecedents_str").agg(F.map_from_entries(F.collect_list(F.struct("consequents_str", "lift"))).alias("m"))
    return by_row.withColumn("columns", columns).select(
        F.substring("antecedents_str", 1, 35).alias("row_label"), "antecedents_str", F.array_join("columns", " | ").alias("consequents"),
        F.explode(F.transform("columns", lambda c: F.struct(c.alias("consequents_str"), F.coalesce(F.element_at("m", c), F.lit(0.0)).alias("lift")))).alias("cell")
    ).select("row_label", "antecedents_str", F.col("cell.consequents_str").alias("consequents_str"), F.col("cell.lift").alias("lift"))


def top50_export(rules: DataFrame, n: int = 50) -> DataFrame:
    """Q22: the export columns under their display names."""
    return (rules.orderBy(*rule_order()).limit(n)
            .select(F.col("antecedents_str").alias("If customer buys"),
                    F.col("consequents_str").alias("Recommend"),
                    F.col("support").alias("Support"),
                    F.col("confidence").alias("Confidence"),
                    F.col("lift").alias("Lift")))


def scatter_rules(rules: DataFrame) -> DataFrame:
    """Support / confidence / lift points."""
    return rules.select("antecedents_str", "consequents_str", "support", "confidence", "lift")
