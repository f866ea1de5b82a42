import os

import pytest
from pyspark.sql import functions as F

from hostwin.operators import datasets, features
from hostwin.sources.tables import read_log
from hostwin.streaming.features import (
    compact_partials, compact_windows, read_log_stream, read_partials, read_windows, run_partials, run_stream,
    stream_features)


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(f"{t},{h},x\n" for t, h in rows))


@pytest.fixture
def folders(tmp_path):
    return tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")


def run(spark, source, out, ckpt):
    rows = read_log_stream(spark, "dns", str(source), files_per_batch=1)
    return run_stream(stream_features(rows, "dns", watermark="10 minutes"), out, ckpt)


def test_stream_equals_batch_and_resumes(spark, folders):
    source, out, ckpt = folders
    write(source, "a.txt", [(t, f"C{t % 3}") for t in range(0, 2000, 40)] + [("?", "C1")])
    run(spark, source, out, ckpt)
    write(source, "b.txt", [(t, f"C{t % 3}") for t in range(1990, 4000, 40)])
    done = run(spark, source, out, ckpt)
    batch = features.dns_features(read_log(spark, "dns", str(source)))
    got = read_windows(spark, out)
    assert done["late_rows"] == 0
    assert got.exceptAll(batch).count() == 0 and got.count() == batch.count()


def test_late_rows_change_nothing_and_are_counted(spark, folders):
    source, out, ckpt = folders
    write(source, "a.txt", [(100, "A"), (9000, "A")])
    run(spark, source, out, ckpt)
    before = {tuple(r) for r in read_windows(spark, out).collect()}
    write(source, "b.txt", [(110, "A"), (120, "B")])
    done = run(spark, source, out, ckpt)
    assert {tuple(r) for r in read_windows(spark, out).collect()} == before
    assert done["late_rows"] >= 1


def test_totals_cover_batches_that_progress_forgot(spark, folders):
    """Only three updates are remembered, of eight batches and one more without data."""
    source, out, ckpt = folders
    name = "spark.sql.streaming.numRecentProgressUpdates"
    spark.conf.set(name, "3")
    try:
        for i in range(8):
            rows = [(9000 + i, "A")] if i == 0 else [(9000 + i, "A"), (100, "B")]
            write(source, f"{i}.txt", rows)
            os.utime(source / f"{i}.txt", (1_700_000_000 + i, 1_700_000_000 + i))
        done = run(spark, source, out, ckpt)
    finally:
        spark.conf.unset(name)
    assert done["batches"] >= 8 and done["late_rows"] >= 6


def test_compacted_windows(spark, folders, tmp_path):
    source, out, ckpt = folders
    write(source, "a.txt", [(t, f"C{t % 3}") for t in range(0, 2000, 40)])
    write(source, "b.txt", [(t, f"C{t % 3}") for t in range(1000, 90_000, 900)])
    run(spark, source, out, ckpt)
    compact_windows(spark, out, str(tmp_path / "compact"))
    stored = spark.read.parquet(str(tmp_path / "compact"))
    got = read_windows(spark, out)
    assert stored.select(*got.columns).exceptAll(got).count() == 0 and stored.count() == got.count()


def partials(spark, source, out, ckpt, **options):
    rows = features.keyed_rows(read_log_stream(spark, "dns", str(source), files_per_batch=1), "dns", 300)
    return run_partials(rows, out, ckpt, **options)


def windows(df):
    return sorted((r.src_comp, r.win, r.dns_queries) for r in df.collect())


def test_late_sums_stay_apart_and_complete_the_table(spark, folders):
    source, out, ckpt = folders
    write(source, "a.txt", [(100, "A"), (200, "A"), (9000, "A"), ("?", "A")])
    assert partials(spark, source, out, ckpt) == 1
    write(source, "b.txt", [(110, "A"), (8900, "A"), (9010, "B"), (5400, "C"), (5399, "C")])
    assert partials(spark, source, out, ckpt) == 1
    # Windows that ended at 5400 or earlier are late: 9000 less 3600.
    assert windows(read_partials(spark, out, late=True)) == [("A", 0, 1), ("C", 5100, 1)]
    assert windows(read_partials(spark, out, late=False)) == [
        ("A", 0, 2), ("A", 8700, 1), ("A", 9000, 1), ("B", 9000, 1), ("C", 5400, 1)]
    batch = features.dns_features(read_log(spark, "dns", str(source)))
    assert windows(read_partials(spark, out)) == windows(batch)


def test_a_repeated_batch_replaces_itself(spark, folders):
    """Without its checkpoint the stream starts over and stores the same batches again."""
    source, out, ckpt = folders
    for i in range(3):
        write(source, f"{i}.txt", [(t, f"C{t % 3}") for t in range(1000 * i, 1000 * i + 900, 50)])
        os.utime(source / f"{i}.txt", (1_700_000_000 + i, 1_700_000_000 + i))
    partials(spark, source, out, ckpt)
    before = windows(read_partials(spark, out))
    assert partials(spark, source, out, ckpt + "2") == 3
    assert windows(read_partials(spark, out)) == before


def test_batches_without_usable_rows(spark, folders):
    source, out, ckpt = folders
    write(source, "a.txt", [("?", "A"), ("x", "B")])
    partials(spark, source, out, ckpt)
    write(source, "b.txt", [(9000, "A")])
    partials(spark, source, out, ckpt)
    write(source, "c.txt", [("?", "A")])
    partials(spark, source, out, ckpt)
    write(source, "d.txt", [(100, "A")])
    partials(spark, source, out, ckpt)
    assert windows(read_partials(spark, out, late=True)) == [("A", 0, 1)]
    assert windows(read_partials(spark, out, late=False)) == [("A", 9000, 1)]


def test_all_logs_and_labels_in_one_stream(spark, folders, tmp_path):
    _, out, ckpt = folders
    hosts = [f"C{i}" for i in range(4)]
    lines = {
        "auth": [f"{t},U1@D,U1@D,{hosts[t % 4]},C9,Kerberos,Network,LogOn,Success" for t in range(0, 3000, 70)],
        "proc": [f"{t},U{t % 2}$@D,{hosts[t % 3]},P1,Start" for t in range(0, 3000, 90)],
        "flows": [f"{t}.5,{t % 5},{hosts[t % 4]},N1,C9,80,6,3,{t}" for t in range(0, 3000, 50)],
        "dns": [f"{t},{hosts[t % 4]},C9" for t in range(0, 3000, 110)],
        "redteam": ["140,U1@D,C0,C2", "1000,U1@D,C3,C1", "?,U1@D,C1,C2"],
    }
    for kind, rows in lines.items():
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "a.txt").write_text("\n".join(rows[::2]) + "\n")
        (tmp_path / kind / "b.txt").write_text("\n".join(rows[1::2]) + "\n")
    logs = {k: read_log_stream(spark, k, str(tmp_path / k), files_per_batch=1) for k in lines}
    assert run_partials(datasets.master_rows(logs), out, ckpt, delay=86_400) == 2
    compact_partials(spark, out, str(tmp_path / "compact"), files_per_day=2)
    stored = spark.read.parquet(str(tmp_path / "compact")).withColumn("day", F.col("day").cast("bigint"))
    want = datasets.build_master({k: read_log(spark, k, str(tmp_path / k)) for k in lines})
    got = datasets.finish_master(stored)
    assert got.schema.names == want.schema.names and got.count() == want.count() == 20
    assert got.exceptAll(want).count() == 0 and got.filter("label = 1").count() > 0


def test_deliveries_are_written_by_many_tasks(spark, sf, monkeypatch):
    from hostwin.plans import catalog
    plans, write = [], catalog.write_table

    def seen(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(df, *args, **kwargs)

    monkeypatch.setattr(catalog, "write_table", seen)
    assert catalog.QUERIES["stream_many_batches"](spark, sf).count() > 0
    assert len(plans) == 4 and not any("Coalesce" in p or "get_json_object" in p for p in plans)
