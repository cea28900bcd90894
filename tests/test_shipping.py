"""Work on executors must not need this package there: the driver alone knows where it is."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from riskframe.operators import monitor, neighbours
from riskframe.session import local_session
spark = local_session(2, memory="1g", shuffle_partitions=2)
rows = [(i, float(i % 17), float(i % 23)) for i in range(60)]
near = neighbours.nearest_neighbours(spark.createDataFrame(rows, "id int, a double, b double"), "id", ["a", "b"], 2, block={block})
assert near.count() == 60
t = spark.createDataFrame([("x",), ("y",)], "t string")
assert monitor.drift_chi2(t, t).first()["p_value"] == 1.0
print("shipped")
"""


def run(tmp_path, block):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, block=block)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=300)
    assert "shipped" in done.stdout, done.stderr[-2000:]


def test_small_and_cut_tables_run_outside_the_repository(tmp_path):
    run(tmp_path, 2048)
    run(tmp_path, 16)
