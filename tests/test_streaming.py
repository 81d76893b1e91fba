import re

from tillroll.streaming import kpis as ST
from conftest import SF0001


def test_stream_kpis_windows_close_by_watermark(spark, tmp_path):
    orders = ST.order_stream(spark, SF0001, glob="events*.parquet")
    out = ST.run_to_table(ST.live_kpis(orders, "1 day", "1 hour"), "t", base=str(tmp_path / "kpis"))
    rows = out.collect()
    assert rows and all(r.orders > 0 for r in rows)
    ev = spark.read.parquet(f"{SF0001}/events.parquet").filter("event_type = 'purchase'")
    last = ev.selectExpr("max(ts)").first()[0]
    assert max(r.window_end for r in rows) <= last  # the open window is not emitted
    # a restart on the same checkpoint finds nothing new
    again = ST.run_to_table(ST.live_kpis(ST.order_stream(spark, SF0001, glob="events*.parquet"), "1 day", "1 hour"),
                            "t", base=str(tmp_path / "kpis"))
    assert again.count() == len(rows)


def test_late_and_out_of_order_batches(spark, tmp_path):
    """Rows behind the watermark of an earlier batch are dropped; rows out of order but in time count; zones don't matter."""
    import datetime as dt

    def batch(name, hours):
        rows = [(k, dt.datetime(2020, 1, 1) + dt.timedelta(hours=h), 7, "purchase", 1.0, "") for k, h in enumerate(hours)]
        spark.createDataFrame(rows, ST.EVENTS_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        kpis = ST.live_kpis(ST.order_stream(spark, str(tmp_path / "in")), "1 day", "1 hour")
        return {r.window_start.day: r.orders for r in ST.run_to_table(kpis, "late", base=str(tmp_path / "out")).collect()}

    batch("a", [30, 2, 50, 26])        # days 1, 2, 3 in disorder
    assert run() == {1: 1, 2: 2}
    batch("b", [3, 49, 80])            # day 1 is closed: its row is late; day 3 is open
    assert run() == {1: 1, 2: 2, 3: 2}
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        ev = spark.read.parquet(str(tmp_path / "in"))
        back = ev.select(ST.utc_wall(ST.utc_instant(ev.ts)).alias("b"), "ts").collect()
        assert all(r.b == r.ts for r in back)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_segments_are_spread_by_their_files_and_orders_pass_unsorted(spark, tmp_path, monkeypatch):
    """A task of the join holds a bounded part of the segments, however many there are, and none of the orders."""
    import datetime as dt

    from tillroll.functions import dims
    actions = dims.segment_dim(spark, "customer")
    segment = actions.first()["Segment"]
    at = str(tmp_path / "segments")
    spark.createDataFrame([(str(i), segment if i % 2 else None) for i in range(50)], "CustomerID string, Segment string").write.parquet(at)
    at_hour = dt.datetime(2020, 1, 1)
    rows = [(i, c, 1.0, at_hour) for i, c in enumerate(["7"] * 40 + ["8", None, "999"])]
    orders = spark.createDataFrame(rows, "order_id long, customer_id string, amount double, ts timestamp")
    monkeypatch.setattr(ST, "SEGMENT_BYTES", 16, raising=False)
    out = ST.enrich_orders(orders, spark.read.parquet(at), actions)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = {int(n) for n in re.findall(r"hashpartitioning\(customer_id\S+, _salt\S+, (\d+)\)", plan)}
    assert len(spread) == 1 and spread.pop() > tasks
    got = {r.order_id: (r.customer_id, r.customer_segment, bool(r.marketing_action)) for r in out.collect()}
    assert got == {i: (c, segment if c == "7" else "Unknown", c == "7") for i, c, *_ in rows}
