import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_without_optional_parts(tmp_path):
    """The library works where the subpackage for training data and the pipeline are absent."""
    target = tmp_path / "copy"
    shutil.copytree(ROOT, target, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 50 and not [n for n in q if n.startswith('op1')]; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=target, env={**os.environ, "PYTHONPATH": str(target)}, timeout=120).returncode == 0


def test_entry(spark, sf):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["doc_id", "text", "score"] and found.count() == 20
