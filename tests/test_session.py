"""The shared folder of a plain local session that names none."""

import os
import subprocess
import sys

CODE = """
from cohortspark.session import cut_lineage, local_session, shared_folder, stage
spark = local_session(1, "1g")
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert sorted(r.id for r in stage(spark.range(3), "x").collect()) == [0, 1, 2]
assert cut_lineage(spark.range(3)).count() == 3 and shared_folder(spark) == shared_folder(spark)
print("fine")
"""


def test_a_session_without_a_shared_folder(folder):
    env = os.environ | {"SPARK_CONF_DIR": folder, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "TMPDIR": folder}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
