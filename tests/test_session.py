import subprocess
import sys

SCRIPT = """
from pyspark.sql import SparkSession
from retainly import session
spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()
if not spark.conf.get('spark.checkpoint.dir', None):
    print('UNSET')
a, b = session.checkpoint_dir(spark), session.scratch_path(spark, 'x')
assert b.startswith(a.rstrip('/') + '/') and session.checkpoint_dir(spark) == a, (a, b)
print('ROWS', session.materialize(spark.range(7)).count())
"""


def test_a_plain_local_session_gets_a_checkpoint_folder(tmp_path):
    """Without spark.checkpoint.dir: no configuration folder, so that the machine's defaults don't set it."""
    import os
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
    env.pop("PYSPARK_SUBMIT_ARGS", None)
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, timeout=300)
    assert "UNSET" in done.stdout and "ROWS 7" in done.stdout, done.stderr[-2000:]
