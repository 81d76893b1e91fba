"""Rows dealt by keys that are mostly different: no partial map a reading task, few rows an owner, the same sums."""
import random

from pyspark.sql import functions as F

from tillroll.operators import baskets as B
from tillroll.operators import features as FE
from tillroll.session import DEAL_PARTS, dealt, input_bytes


def _lines(spark, n=4000):
    rng = random.Random(11)
    pick = lambda values: rng.choice([None, *values])
    rows = [(pick([f"i{k}" for k in range(60)]), pick(["A", "B", "C"] + ["HOT"] * 20), rng.randint(1, 9), round(rng.random() * 50, 2), pick([f"c{k}" for k in range(40)]), rng.randint(1, 99)) for _ in range(n)]
    df = spark.createDataFrame(rows, "InvoiceNo string, Description string, Quantity int, p double, CustomerID string, r int")
    return df.select("InvoiceNo", "Description", "Quantity", F.col("p").cast("decimal(18,6)").alias("UnitPrice"), "CustomerID",
                     F.col("r").cast("decimal(24,6)").alias("TotalRevenue"))


def test_product_totals_are_those_of_plain_counts(spark):
    lines = _lines(spark)
    got = {r.Description: tuple(r)[1:] for r in FE.product_aggregates(lines).collect()}
    want = lines.groupBy("Description").agg((F.sum("UnitPrice").cast("double") / F.count("UnitPrice")), F.sum("Quantity"), F.count_distinct("InvoiceNo"),
                                            F.count_distinct("CustomerID"), F.sum("TotalRevenue").cast("double"))
    assert got == {r.Description: tuple(r)[1:] for r in want.collect()} and None in got


def test_partials_of_parts_merge_to_those_of_all(spark):
    lines = _lines(spark)
    parts = FE.product_partials(lines.where("Quantity < 4")).unionByName(FE.product_partials(lines.where("Quantity >= 4")))
    assert parts.columns == ["Description", "tag", "key", "price", "prices", "quantity", "revenue"]
    assert sorted(map(str, FE.merged_product_partials(parts).collect())) == sorted(map(str, FE.product_partials(lines).collect()))


def _maps_before_shuffle(df) -> int:
    """Aggregations below the lowest exchange of the plan."""
    planned = df._jdf.queryExecution().executedPlan().toString().splitlines()
    lowest = max(i for i, line in enumerate(planned) if "Exchange hashpartitioning" in line)
    return sum("HashAggregate" in line for line in planned[lowest:])


def test_no_map_of_all_rows_before_the_shuffle(spark, tmp_path):
    _lines(spark).write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    assert _maps_before_shuffle(FE.product_partials(lines)) == 0
    assert _maps_before_shuffle(FE.merged_product_partials(FE.product_partials(lines))) == 0
    assert _maps_before_shuffle(B.basket_pairs(lines, B.BasketSpec())) == 0


def test_tasks_follow_the_files_and_a_hot_owner_is_split(spark, tmp_path, monkeypatch):
    from tillroll import session
    _lines(spark).write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    assert input_bytes(lines) == sum(f.stat().st_size for f in (tmp_path / "lines").glob("*.parquet"))
    monkeypatch.setattr(session, "DEAL_BYTES", input_bytes(lines) // 50)
    out = dealt(lines.where("Description = 'HOT'"), ["Description"], ["InvoiceNo"])
    assert out.rdd.getNumPartitions() >= 50
    used = out.select(F.spark_partition_id().alias("p"), "_part").distinct().collect()
    assert len({r["p"] for r in used}) > 2 and len(used) == DEAL_PARTS


def test_lines_and_orders_are_joined_over_tasks_by_their_files(spark, monkeypatch):
    from conftest import SF0001
    from tillroll import session
    from tillroll.sources.retail import retail_raw
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    before, small = retail_raw(spark, SF0001), plan(retail_raw(spark, SF0001))
    assert "REPARTITION_BY_NUM" not in small
    monkeypatch.setattr(session, "DEAL_BYTES", 1 << 10)
    many = retail_raw(spark, SF0001)
    tasks = session.tasks_for(sum(input_bytes(spark.read.parquet(f"{SF0001}/{t}.parquet")) for t in ("lineitem", "orders")))
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "hashpartitioning(l_orderkey" in plan(many) and f", {tasks})" in plan(many)
    assert sorted(map(repr, many.collect())) == sorted(map(repr, before.collect()))
