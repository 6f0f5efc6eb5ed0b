"""The base library without the folders of the text-corpus operators."""

import os
import shutil
import subprocess
import sys

SCRIPT = """
import __spark_entry__ as entry
from traceaudit.session import local_session
names = entry.queries()
assert not any(n.startswith("op") or n == "pipeline" for n in names) and set(entry.oracle_sql()) <= set(names)
print(names["p1_to_task_rows"](local_session(2, partitions=2, memory="1g"), "/root/testdata/sf0.001").count())
"""


def test_base_runs_alone(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder in ("with_pipeline", "without"):
        copy = tmp_path / folder
        shutil.copytree(os.path.join(root, "traceaudit"), copy / "traceaudit", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(os.path.join(root, "__spark_entry__.py"), copy)
        if folder == "with_pipeline":
            shutil.copy(os.path.join(root, "corpus_pipeline.py"), copy)
        done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and int(done.stdout.split()[-1]) > 0, done.stderr[-2000:]
