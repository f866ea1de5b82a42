import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from hostwin.session import checkpoint_root, pin, scratch_path, scratch_scope

ROOT = Path(__file__).resolve().parents[1]
PROGRAM = """
import sys
sys.path.insert(0, {root!r})
from hostwin.session import get_spark
spark = get_spark("away", "local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
sys.path.pop(0)
from pyspark.sql import functions as F
from hostwin.operators.iforest import fit_iforest, score_iforest
from hostwin.operators.smote import smote
rows = spark.range(200).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"),
                               (F.col("id") % 37).cast("double").alias("a"))
print("rows", smote(rows, ["a"], "id").count(),
      score_iforest(rows, fit_iforest(rows, ["a"], "id", 5)).filter("anomaly > 0").count())
"""


def test_tasks_find_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM.format(root=str(ROOT))], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=300)
    assert "rows 70 200" in done.stdout, done.stderr[-2000:]


def test_scopes_remove_what_they_stored(spark):
    folder = spark.sparkContext.getCheckpointDir()
    with scratch_scope(spark):
        held = pin(spark.range(10))
        path = scratch_path(spark, "other")
        spark.range(3).write.parquet(path)
        assert held.count() == 10
        files = [f.removeprefix("file://") for f in held.inputFiles()]
        assert all(os.path.exists(f) for f in files)
    assert not any(os.path.exists(f) for f in files) and not os.path.exists(path)
    assert os.path.isdir(checkpoint_root(spark).removeprefix("file:"))
    assert spark.sparkContext.getCheckpointDir() == folder
    assert pin(spark.range(4)).agg(F.sum("id")).first()[0] == 6
