"""Corpus operators where executors have no copy of the package."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import functions as F
from canasta.session import get_session
import __spark_entry__

spark = get_session("bare", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}})
seen = spark.range(1).mapInPandas(lambda frames: (f.assign(id=int(__import__("importlib.util").util.find_spec("canasta") is not None)) for f in frames), "id long").first()["id"]
assert seen == 0, "the workers see the package"
for name in {names!r}:
    print(name, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_operators_run(tmp_path):
    names = ["op5_toxicity", "op11_whitening", "op12_fill_in_middle", "op13_lm_scoring"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN.format(repo=REPO, names=names)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == names
