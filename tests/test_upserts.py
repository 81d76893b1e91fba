"""Micro-batches into one row a key: replay after a stop, compaction, repeats, versions, the continuous trigger."""
import datetime as dt

import pytest

from tillroll.streaming import kpis as ST
from tillroll.streaming import upserts as UP

SCHEMA = "id bigint, v bigint, at bigint"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def arrive(spark, path, data, schema=SCHEMA):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema=SCHEMA):
    return spark.readStream.schema(schema).parquet(path)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    """The driver stops after the batch was written and before the checkpoint says so: the batch comes again."""
    base = str(tmp_path)
    table = UP.UpsertTable(spark, f"{base}/t", SCHEMA, ["id"], ["at"])
    arrive(spark, f"{base}/in", [(1, 10, 1), (1, 11, 2), (2, 20, 1), (None, 5, 1)])
    written, write = [], table.write_batch

    def stop_once(batch, number):
        written.append((number, write(batch, number)))
        if len(written) == 1:
            raise RuntimeError("stopped")
        return True

    table.write_batch = stop_once
    with pytest.raises(Exception, match="stopped"):
        UP.run_upserts(stream(spark, f"{base}/in"), table, base)
    want = [(1, 11, 2), (2, 20, 1), (None, 5, 1)]
    assert rows(table.read()) == want
    assert rows(UP.run_upserts(stream(spark, f"{base}/in"), table, base)) == want
    assert written == [(0, True), (0, False)]                         # the same number again, and not written again
    arrive(spark, f"{base}/in", [(2, 21, 0), (3, 30, 1)])
    assert rows(UP.run_upserts(stream(spark, f"{base}/in"), table, base)) == [(1, 11, 2), (2, 21, 0), (3, 30, 1), (None, 5, 1)]


def test_incomplete_folders_do_not_count(spark, tmp_path):
    table = UP.UpsertTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], ["at"])
    assert table.read().count() == 0 and table.compact() == -1
    assert table.write_batch(spark.createDataFrame([(1, 1, 1)], SCHEMA), 0)
    arrive(spark, str(tmp_path / "t/batches/batch=1"), [(1, 99, 9)])
    (tmp_path / "t/batches/batch=1/_SUCCESS").unlink()               # what a lost driver leaves
    assert rows(table.read()) == [(1, 1, 1)]
    assert table.write_batch(spark.createDataFrame([(1, 2, 2)], SCHEMA), 1)
    assert rows(table.read()) == [(1, 2, 2)]


def test_compaction_keeps_the_rows_and_later_batches_win(spark, tmp_path):
    table = UP.UpsertTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], ["at"])
    for n in range(12):                                              # numbers of two digits follow those of one
        table.write_batch(spark.createDataFrame([(n % 3, n, 100 - n), (50 + n, n, 0)], SCHEMA), n)
    before = rows(table.read())
    assert table.compact() == 11 and rows(table.read()) == before and (0, 9, 91) in before
    assert not table.write_batch(spark.createDataFrame([(0, 0, 0)], SCHEMA), 4)   # folded batches are known
    table.write_batch(spark.createDataFrame([(0, 7, 0)], SCHEMA), 12)
    assert (0, 7, 0) in rows(table.read()) and len(rows(table.read())) == len(before)
    assert table.compact() == 12 and table.compact() == 12


def test_ties_and_a_batch_row_with_equal_order_are_stable(spark, tmp_path):
    data = [(1, v, 5) for v in range(20)]
    got = set()
    for k in range(3):
        table = UP.UpsertTable(spark, str(tmp_path / f"t{k}"), SCHEMA, ["id"], ["at"])
        table.write_batch(spark.createDataFrame(data[k:] + data[:k], SCHEMA).repartition(k + 1), 0)
        got.add(tuple(rows(table.read())))
    assert len(got) == 1


def orders(spark, path, ids_hours):
    data = [(i, dt.datetime(2020, 1, 1) + dt.timedelta(hours=h), 7, "purchase", float(i), "") for i, h in ids_hours]
    spark.createDataFrame(data, ST.EVENTS_SCHEMA).coalesce(1).write.mode("append").parquet(path)


KPIS = "window_start timestamp_ntz, window_end timestamp_ntz, orders bigint, amount double, avg_amount double"


def test_repeated_orders_count_once_and_open_windows_are_shown(spark, tmp_path):
    base = str(tmp_path)
    table = UP.UpsertTable(spark, f"{base}/kpis", KPIS, ["window_start"])

    def run():
        kpis = ST.open_kpis(ST.order_stream(spark, f"{base}/in"), "1 day", "2 hours")
        return {r.window_start.day: (r.orders, r.amount) for r in UP.run_upserts(kpis, table, base, output_mode="update").collect()}

    orders(spark, f"{base}/in", [(1, 2), (1, 2), (2, 30), (3, 49)])
    assert run() == {1: (1, 1.0), 2: (1, 2.0), 3: (1, 3.0)}          # day 3 is open and there; 1 came twice in a batch
    orders(spark, f"{base}/in", [(3, 49), (4, 48), (1, 2), (5, 50)])  # 3 again within the watermark, 1 long after it, 4 late but in time
    assert run() == {1: (1, 1.0), 2: (1, 2.0), 3: (3, 12.0)}
    assert run() == {1: (1, 1.0), 2: (1, 2.0), 3: (3, 12.0)}          # a restart with nothing new


def test_static_side_is_read_for_each_batch(spark, tmp_path):
    from tillroll.functions import dims
    base = str(tmp_path)
    versions = UP.Versions(spark, f"{base}/segments")
    with pytest.raises(FileNotFoundError):
        versions.latest()
    feed = UP.UpsertTable(spark, f"{base}/feed", "order_id bigint, customer_id string, ts timestamp_ntz, amount double, customer_segment string, marketing_action string", ["order_id"])
    actions = dims.segment_dim(spark, "customer")
    segment = actions.first()["Segment"]
    for n, (ids, known) in enumerate([([1, 2], []), ([3], [("7", segment)])]):
        assert versions.publish(spark.createDataFrame(known, "CustomerID string, Segment string")) == n
        orders(spark, f"{base}/in", [(i, 1) for i in ids])
        got = UP.run_upserts(ST.order_stream(spark, f"{base}/in"), feed, base, lambda batch: ST.enrich_orders(batch, versions.latest(), actions))
    assert {r.order_id: r.customer_segment for r in got.collect()} == {1: "Unknown", 2: "Unknown", 3: segment}


def test_continuous_query_goes_on_after_a_stop(spark, tmp_path):
    base = str(tmp_path)
    table = UP.UpsertTable(spark, f"{base}/t", SCHEMA, ["id"], ["at"])
    arrive(spark, f"{base}/in", [(1, 1, 1)])
    start = lambda: UP.start_upserts(stream(spark, f"{base}/in"), table, base, processing_time="1 second")
    query = start()
    query.processAllAvailable()
    arrive(spark, f"{base}/in", [(1, 2, 1), (2, 2, 1)])
    query.processAllAvailable()
    query.stop()
    assert rows(table.read()) == [(1, 2, 1), (2, 2, 1)]
    arrive(spark, f"{base}/in", [(2, 3, 1)])
    query = start()
    query.processAllAvailable()
    query.stop()
    assert rows(table.read()) == [(1, 2, 1), (2, 3, 1)]


def test_running_to_a_sink_goes_on_after_a_stop(spark, tmp_path):
    """``start_stream``, the dashboards' refresh, writes each closed window once over two runs."""
    base = str(tmp_path / "sink")
    orders(spark, str(tmp_path / "in"), [(1, 2), (2, 30)])
    start = lambda: ST.start_stream(ST.live_kpis(ST.order_stream(spark, str(tmp_path / "in"))), "closed", processing_time="1 second", base=base)
    for more in ([], [(3, 60)]):
        if more:
            orders(spark, str(tmp_path / "in"), more)
        query = start()
        query.processAllAvailable()
        query.stop()
    assert sorted(r.window_start.day for r in spark.read.parquet(f"{base}/data").collect()) == [1, 2]
