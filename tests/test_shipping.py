import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

CODE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from inkstream.sources import tables
df = tables.read_contacts(spark.createDataFrame([("Name,Email\\nAnn,a@b.c",)], "t string"), "t")
assert df.first().contacts == [{{"fn": "Ann", "email": "a@b.c"}}]
"""


def test_workers_import_the_package_from_any_folder(tmp_path):
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
