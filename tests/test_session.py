"""Sessions that nobody configured."""

import os
import subprocess
import sys

from tests.conftest import ROOT

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__ as E
assert E.entry(spark).count() > 0
first = spark.sparkContext.getCheckpointDir()
q = E.queries()
assert q["outlier_stats"](spark, E.SMOKE_DIR).count() > 0  # stores intermediates
assert q["garch_roll_daily_grid"](spark, E.SMOKE_DIR).count() > 0  # needs the package in Python workers
assert spark.sparkContext.getCheckpointDir() == first
from sigmaflow.session import get_spark
assert get_spark() is not None
print("done")
"""


def test_plain_session_without_any_configuration(tmp_path):
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_")} | {"SPARK_CONF_DIR": str(tmp_path)}
    ran = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], env=env, capture_output=True, text=True, timeout=600, check=False)
    assert ran.returncode == 0 and ran.stdout.strip().endswith("done"), ran.stderr[-3000:]


def test_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from sigmaflow import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    import pytest
    with pytest.raises(RuntimeError, match="share"):
        session.ensure_checkpoint_dir(Session())
