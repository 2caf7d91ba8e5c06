import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
from pyspark.sql import SparkSession
from lurescope.session import ensure_checkpoint_dir, materialize
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config(map=CONF).getOrCreate())
first = ensure_checkpoint_dir(spark)
assert ensure_checkpoint_dir(spark) == first and spark.sparkContext.getCheckpointDir()
assert materialize(spark.range(3), "t").count() == 3
print("folder", first)
"""


def folder(conf, home):
    """The folder that a plain session takes, with nothing else configured."""
    env = os.environ | {"SPARK_CONF_DIR": home, "PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", CODE.replace("CONF", repr(conf))], env=env, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout.split("folder ")[1].strip()


def test_unset_setting_gets_a_private_folder(tmpdir_path):
    assert "lurescope-ckpt-" in folder({}, tmpdir_path)


def test_the_clusters_folder_is_used(tmpdir_path):
    shared = "file://" + tmpdir_path + "/shared"
    assert folder({"spark.checkpoint.dir": shared}, tmpdir_path) == shared
