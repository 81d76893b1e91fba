"""Features refreshed by new files only."""
import os

import pytest

from conftest import SF0001
from tillroll.operators import features as FE
from tillroll.operators.clean import clean
from tillroll.sources.increments import Increments
from tillroll.sources.retail import retail_raw


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def lines(spark, tmp_path):
    raw = retail_raw(spark, SF0001, dirty=True)
    path = str(tmp_path / "lines")
    raw.write.parquet(path)
    return spark.read.schema(raw.schema).parquet(path)


def land(df, tmp_path, name, mode="append"):
    df.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"part-{name}"))
    part = next(f for f in os.listdir(tmp_path / f"part-{name}") if f.endswith(".parquet"))
    os.makedirs(tmp_path / "landing", exist_ok=True)
    os.replace(tmp_path / f"part-{name}" / part, tmp_path / "landing" / f"{name}.parquet")


def test_only_new_files_are_read_and_features_equal_the_full_run(spark, tmp_path, lines):
    seen = []

    def read(paths):
        seen.append(sorted(os.path.basename(p) for p in paths))
        return spark.read.schema(lines.schema).parquet(*paths)

    kept = Increments(spark, str(tmp_path / "landing"), str(tmp_path / "kept"), read)
    assert kept.refresh() == []
    with pytest.raises(FileNotFoundError):
        kept.rfm()
    thirds = [lines.filter(f"cast(StockCode as int) % 3 = {k}") for k in range(3)]
    parts = {"a": thirds[0], "b": thirds[1], "c": thirds[2]}

    def check(names):
        whole = [parts[n] for n in names]
        df = whole[0]
        for x in whole[1:]:
            df = df.unionByName(x)
        assert rows(kept.rfm()) == rows(FE.build_rfm(clean(df, "rfm")).select(*kept.rfm().columns))
        some = {"revenue_quantile": 0.9, "min_transactions": 2}
        assert rows(kept.product_features(**some)) == rows(FE.build_product_features(clean(df, "product"), **some))

    land(parts["a"], tmp_path, "a")
    assert kept.refresh() == ["a.parquet"]
    check("a")
    land(parts["b"], tmp_path, "b")
    land(parts["c"], tmp_path, "c")
    assert kept.refresh() == ["b.parquet", "c.parquet"] and kept.refresh() == []
    assert seen == [["a.parquet"], ["b.parquet", "c.parquet"]]
    check("abc")
    again = Increments(spark, str(tmp_path / "landing"), str(tmp_path / "kept"), read)   # another session
    assert again.refresh() == [] and rows(again.rfm()) == rows(kept.rfm())

    # A changed file: its increment goes, and the files that came with it are read again.
    parts["b"] = thirds[1].limit(50)
    land(parts["b"], tmp_path, "b")
    assert kept.refresh() == ["b.parquet", "c.parquet"]
    check("abc")
    kept.compact()
    check("abc")
    assert kept.refresh() == []
    os.remove(tmp_path / "landing" / "c.parquet")
    assert kept.refresh() == ["a.parquet", "b.parquet"]                                   # all were folded into one
    check("ab")


def test_a_refresh_that_is_cut_off_leaves_the_old_state(spark, tmp_path, lines, monkeypatch):
    read = lambda paths: spark.read.schema(lines.schema).parquet(*paths)
    kept = Increments(spark, str(tmp_path / "landing"), str(tmp_path / "kept"), read)
    land(lines.filter("cast(StockCode as int) % 2 = 0"), tmp_path, "even")
    kept.refresh()
    before = rows(kept.rfm())
    land(lines.filter("cast(StockCode as int) % 2 = 1"), tmp_path, "odd")
    publish = kept._publish
    monkeypatch.setattr(kept, "_publish", lambda known: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        kept.refresh()
    assert rows(kept.rfm()) == before
    monkeypatch.setattr(kept, "_publish", publish)
    assert kept.refresh() == ["odd.parquet"]
    assert rows(kept.rfm()) == rows(FE.build_rfm(clean(lines, "rfm")).select(*kept.rfm().columns))
