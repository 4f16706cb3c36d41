import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from tessera.plans import tables

ALONE = """
from pyspark.sql import SparkSession
from tessera.plans.tables import all_checkpointed, checkpointed
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", "") and not spark.sparkContext.getCheckpointDir()
assert checkpointed(spark.range(3)).count() == 3
folder = spark.sparkContext.getCheckpointDir()
both = all_checkpointed({"a": spark.range(2), "b": spark.range(5)})
assert (both["a"].count(), both["b"].count()) == (2, 5) and spark.sparkContext.getCheckpointDir() == folder
"""


def test_a_session_that_names_no_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    done = subprocess.run([sys.executable, "-c", ALONE], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_one(master):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables._folder(session)
