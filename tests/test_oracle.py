"""A cross-section of registered queries against their DuckDB SQL (sf0.01)."""
import pytest

import __spark_entry__ as E
from oracle_util import compare, duck
from conftest import SF001

NAMES = ["clean_rfm", "transactions_csv", "cleaning_report", "rfm", "product_features", "basket_items", "frequent_itemsets_multi", "association_rules",
         "association_rules_multi", "recommend_basket", "recommend_batch", "top_rules", "rule_grid", "top50_export", "kmeans_fixed_customers", "kmeans_fixed_products",
         "customer_summary", "segment_boxplot", "boxplot_outliers", "campaign_targets", "dataset_health", "stream_kpis", "new_accounts"]


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    res = compare(E.queries()[name](spark, SF001), con, E.oracle_sql()[name])
    assert res["columns_match"] and res["spark_rows"] == res["oracle_rows"] and res["exact"], res


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["CustomerID", "Frequency", "Monetary", "Recency"] and df.count() > 0


def test_every_query_has_sql_or_is_rows_only():
    from tillroll.plans.catalog import QUERIES
    rows_only = {"kmeans_trained_customers", "kmeans_trained_products", "k_sweep_customers", "k_sweep_products"}
    assert set(QUERIES) - set(E.oracle_sql()) == rows_only
