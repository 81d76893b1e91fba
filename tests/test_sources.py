"""Header normalisation, typed CSV reads, sinks, adapter shape."""
from pyspark.sql import functions as F

from tillroll.sources import retail, tables
from conftest import SF0001


def test_read_transactions_normalises_headers(spark, tmp_path):
    p = tmp_path / "year.csv"
    p.write_text(" Invoice ,StockCode,Description,Quantity,InvoiceDate, Price,Customer ID,Country\n"
                 "536365,85123A,WHITE HANGING HEART,6,2010-12-01 08:26:00,2.55,17850,United Kingdom\n"
                 "C536379,D,Discount,-1,2010-12-01 09:41:00,27.50,,United Kingdom\n")
    df = retail.read_transactions(spark, str(p))
    assert df.schema == retail.RETAIL_SCHEMA
    rows = df.orderBy("InvoiceNo").collect()
    assert rows[0].CustomerID == "17850" and float(rows[0].UnitPrice) == 2.55
    assert rows[1].CustomerID is None


def test_sink_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", 0.1, 0.5, 2.0)], tables.RULES_SCHEMA)
    tables.write_table(df, str(tmp_path / "rules"), fmt="csv")
    back = tables.read_csv(spark, str(tmp_path / "rules"), tables.RULES_SCHEMA)
    assert back.collect() == df.collect()


def test_adapter_shape_and_pruned_joins(spark):
    df = retail.retail_raw(spark, SF0001, with_description=False)
    assert df.schema == retail.RETAIL_SCHEMA
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "part" not in plan.lower().split("relation")[-1] or "p_name" not in plan
    cancelled = df.filter(F.col("InvoiceNo").startswith("C"))
    assert cancelled.filter(F.col("Quantity") > 0).count() == 0


def test_row_counts(spark):
    a = spark.range(3)
    b = spark.range(5)
    got = {r.table: r.rows for r in tables.row_counts({"a": a, "b": b}).collect()}
    assert got == {"a": 3, "b": 5}


def test_small_prices_survive_and_several_extracts_are_one_scan(spark, tmp_path):
    from tillroll.operators.clean import clean
    head = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
    (tmp_path / "a.csv").write_text(head + "1,A,pin,5,1/2/2010 8:26,0.001,17,UK\n")
    (tmp_path / "b.csv").write_text(head + "2,B,nail,2,11/30/2011 17:05,2.555,18,UK\n")
    df = retail.read_transactions(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], timestamp_format="M/d/yyyy H:mm")
    rows = clean(df, "rfm").orderBy("InvoiceNo").collect()
    assert [float(r.TotalPrice) for r in rows] == [0.005, 5.11]
    assert [r.InvoiceDate.isoformat() for r in rows] == ["2010-01-02T08:26:00", "2011-11-30T17:05:00"]


def test_no_expand_over_the_lines(spark):
    from tillroll.operators.clean import clean, cleaning_report
    from tillroll.operators.features import product_aggregates
    raw = retail.retail_raw(spark, SF0001, dirty=True)
    for df in (cleaning_report(raw), product_aggregates(clean(raw, "product"))):
        assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()


def test_distinct_counts_of_product_features(spark):
    from tillroll.operators.features import product_aggregates
    from tillroll.plans.catalog import clean_lines
    lines = clean_lines(spark, SF0001, "product")
    want = {r.Description: (r.i, r.c) for r in lines.groupBy("Description").agg(
        F.count_distinct("InvoiceNo").alias("i"), F.count_distinct("CustomerID").alias("c")).collect()}
    got = {r.Description: (r.num_transactions, r.num_customers) for r in product_aggregates(lines).collect()}
    assert got == want


def test_extracts_go_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n1,A,pin,5,2010-01-02 08:26:00,1.5,17,UK\n")
    (tmp_path / "b.csv").write_text("Price, Customer ID,Note,Quantity,InvoiceNo,Invoice Date\n2.5,18,x,7,2,2011-01-02 08:26:00\n")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv")]
    for rows in (retail.read_transactions(spark, paths), retail.read_extracts(spark, paths)[0]):
        assert rows.schema == retail.RETAIL_SCHEMA
        a, b = rows.orderBy("InvoiceNo").collect()
        assert (a.StockCode, a.Quantity, float(a.UnitPrice), a.CustomerID, a.Country) == ("A", 5, 1.5, "17", "UK")
        assert (b.StockCode, b.Quantity, float(b.UnitPrice), b.CustomerID, b.Country) == (None, 7, 2.5, "18", None)
        assert b.InvoiceDate.year == 2011


def test_rejected_rows_have_reason_file_and_cells(spark, tmp_path):
    head = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
    (tmp_path / "a.csv").write_text(head + "1,A,pin,5,1/2/2010 8:26,1.5,17,UK\n2,A,pin,five,1/2/2010 8:26,1.5,17,UK\n3,A,pin,,,,,\n4,A,pin,5,2010-01-02,x,17,UK\n")
    (tmp_path / "b.csv").write_text(head + "5,A,pin,5,1/2/2010 8:26\n6,A,pin,99999999999,1/2/2010 8:26,1,17,UK,more\n7,A,\"a, b\",5,13/2/2010 8:26,1,17,UK\n8,A,pin,5,3/14/2010 2:30,1,17,UK\n")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # 2:30 does not exist there on that day
    try:
        rows, rejected = retail.read_extracts(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], timestamp_format="M/d/yyyy H:mm")
        good = {r.InvoiceNo: r for r in rows.collect()}
        bad = {r.InvoiceNo: r for r in rejected.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert set(good) == {"1", "3", "8"} and good["3"].Quantity is None and good["8"].InvoiceDate.isoformat() == "2010-03-14T02:30:00"
    assert {k: r.reason for k, r in bad.items()} == {"2": "Quantity", "4": "InvoiceDate; UnitPrice", "5": "fields", "6": "fields; Quantity", "7": "InvoiceDate"}
    assert {k: r.file for k, r in bad.items()} == {"2": "a.csv", "4": "a.csv", "5": "b.csv", "6": "b.csv", "7": "b.csv"}
    assert bad["2"].Quantity == "five" and bad["7"].Description == "a, b" and bad["6"].line.endswith(",more") and bad["2"].line is None


def test_headers_that_cannot_be_told_apart_are_errors(spark, tmp_path):
    import pytest
    (tmp_path / "a.csv").write_text("Invoice,InvoiceNo\n1,2\n")
    with pytest.raises(ValueError, match="InvoiceNo"):
        retail.read_extracts(spark, str(tmp_path / "a.csv"))
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_text("Invoice,Price\n1,2\n")
    (folder / "b.csv").write_text("Price,Invoice\n1,2\n")
    with pytest.raises(Exception, match="header"):
        retail.read_extracts(spark, str(folder))[0].collect()
