"""Operators on a caller's own frames, in a session that nobody prepared, from a folder that is not the package's."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
SETUP = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
s.sparkContext.setLogLevel("ERROR")
text = "one two three four five six seven eight nine ten"
docs = s.createDataFrame([(1, "h", text)], "doc_id long, host string, text string")
"""
CALLS = {
    "leakage": """
from harbormill.llm import leakage
items = s.createDataFrame([(7, text)], "item_id long, text string")
leaks = leakage.find_leaks(docs, items)
assert leaks.count() == 1
assert leakage.remove_leaks(docs, items, leaks, "spans").first()["text"] == ""
""",
    "spans": """
from harbormill.llm import leakage
items = s.createDataFrame([(7, text)], "item_id long, text string")
leaks = s.createDataFrame([(1, 7)], "doc_id long, item_id long")
assert leakage.remove_leaks(docs, items, leaks, "spans").first()["text"] == ""
""",
    "neighbours": """
from harbormill.llm import neighbours
vecs = s.createDataFrame([(k, [float(k + j) for j in range(64)]) for k in range(3)], "vec_id long, vec array<float>")
assert neighbours.nearest(vecs).count() == 6
""",
    "pagespam": """
from harbormill.llm import pagespam
assert pagespam.score_pages(docs).count() == 1
""",
    "packing": """
from harbormill.llm import packing
from pathlib import Path
if Path(packing.VOCABULARY).exists():
    assert packing.pack(docs, 64).count() == 1
""",
    "linkage": """
from harbormill.llm import linkage
a = s.createDataFrame([("/Hotel_Review-g1-d2-Reviews-Amber_Wharf-Torelville.html", "Amber Wharf", None, "Torelville", 1.0, 2.0, "AB12 345C")], "ta_hotel_id string, ta_name string, hotel_name string, ta_city string, ta_lat double, ta_lon double, ta_postcode string")
b = s.createDataFrame([(5, "Amber Wharf", "Torelville", 1.0, 2.0, "AB12 345C")], "id long, hotel_name string, city string, latitude double, longitude double, postcode string")
assert linkage.match_hotels(a, b).count() == 1
""",
}


@pytest.mark.parametrize("name", sorted(CALLS))
def test_operators_ship_the_package_themselves(tmp_path, name):
    run = subprocess.run([sys.executable, "-c", SETUP + CALLS[name] + "\nprint('fine')\n"], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert "fine" in run.stdout, run.stderr[-3000:]
