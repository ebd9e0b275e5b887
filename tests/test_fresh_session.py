"""Operators on a caller's own frames, in a session that nobody prepared, from a folder that is not the package's."""

import subprocess
import sys
import textwrap
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SETUP = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
s.sparkContext.setLogLevel("ERROR")
"""
CALLS = """
from harbormill.operators import drift, records, timestamps
lines = s.createDataFrame([(1, "1,2,http://a.b/c,x,y"), (2, 'a"b')], "id long, line string")
assert records.parse_lines(lines, "id", "line").count() == 2
assert records.parse_texts(lines, "id", "line").count() == 2
dumps = s.createDataFrame([("f", 1, "a.json", 1, '{{"stars": 4}}')], "feed_id string, file_no int, file_name string, line_no int, line string")
assert drift.infer_paths(dumps).count() == 1
clock = s.createDataFrame([("x", "UTC", True)], "source_name string, tz_name string, day_first boolean")
times = s.createDataFrame([(1, "2020-01-02", "x")], "id long, t string, s string")
assert timestamps.normalise_times(times, "id", "t", "s", clock).count() == 1
print("fine")
"""


def test_operators_ship_the_package_themselves(tmp_path):
    """The workers' own path lacks the package; it must come through Spark's file server."""
    script = textwrap.dedent(SETUP.format(root=str(ROOT)) + CALLS.replace("{{", "{").replace("}}", "}"))
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert "fine" in run.stdout, run.stderr[-2000:]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    import pytest

    from harbormill import session

    class Conf:
        def get(self, name, default=None):
            return None

        def set(self, name, value):
            raise AssertionError("no folder may be invented on a cluster")

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Session())
