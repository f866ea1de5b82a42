import pytest
from pyspark.sql import functions as F

from hostwin.operators import splits
from hostwin.schemas import EDR_COLUMNS
from hostwin.sources import tables


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "out")


def test_read_log_pads_and_cleans(spark, tmp_path):
    (tmp_path / "dns.txt").write_text('1,C1,"a ""b"", c"\n?,C2\n3,NA,x\n')
    rows = tables.read_log(spark, "dns", str(tmp_path / "dns.txt")).collect()
    assert [tuple(r) for r in rows] == [("1", "C1", 'a "b", c'), (None, "C2", None), ("3", None, "x")]
    raw = tables.read_log(spark, "dns", str(tmp_path / "dns.txt"), clean=False)
    assert raw.collect()[1].time == "?"


def test_missing_log_is_named(spark, tmp_path):
    here = tmp_path / "there.txt"
    here.write_text("1,2\n")
    paths = dict.fromkeys(["auth", "proc", "flows", "dns", "redteam"], str(here))
    tables.check_inputs(spark, paths)
    paths["flows"] = str(tmp_path / "flows.txt")
    with pytest.raises(FileNotFoundError, match="flows.txt"):
        tables.read_logs(spark, paths)
    del paths["dns"]
    paths["flows"] = str(here)
    with pytest.raises(FileNotFoundError, match="dns"):
        tables.check_inputs(spark, paths)


def test_csv_master_keeps_types(spark, path):
    names = EDR_COLUMNS
    row = spark.range(3).select(*[
        F.lit("C1").alias(c) if c == "src_comp" else F.col("id").cast(
            "double" if c == "auth_fail_rate" else "int" if c == "label" else "bigint").alias(c)
        for c in names])
    tables.write_table(row, path, "csv")
    back = tables.read_master(spark, path, "csv", file_columns=names)
    assert back.dtypes == row.dtypes and back.exceptAll(row).count() == 0
    assert tables.read_master(spark, path, "csv", ["day"], names).columns == ["day"]
    assert tables.read_master(spark, path, "csv").dtypes == row.dtypes


def test_sorted_parts_are_in_order(spark, path):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("day"))
    tables.write_sorted(df, path, ["day"])
    rows = spark.read.parquet(path).select("day", F.col("_metadata.file_name").alias("f")).collect()
    ends = {}
    for r in rows:
        lo, hi = ends.get(r.f, (r.day, r.day))
        ends[r.f] = (min(lo, r.day), max(hi, r.day))
    limits = [x for f in sorted(ends) for x in ends[f]]
    assert len(ends) > 1 and limits == sorted(limits)


def test_writes_replace_and_split(spark, path):
    df = spark.createDataFrame([("A", d, d * 86400, 1) for d in range(10)],
                               "src_comp string, day bigint, win bigint, label int")
    for _ in range(2):
        written = splits.split_and_save({"EDR": df, "XDR": df}, path, 3)
    for target in written.values():
        back = spark.read.parquet(target)
        assert back.count() == 10 and back.filter("split = 'test'").count() == 3


def test_whole_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    row = tables.read_text(spark, str(tmp_path / "a.txt")).first()
    assert row.text == "one\ntwo" and row.path.endswith("a.txt")
