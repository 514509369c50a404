"""The entry module, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["doc_id", "line_no", "match_no", "match"] and not found.isEmpty()


def test_names():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 60


def test_the_rest_stands_alone(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/foliospark", tmp_path / "foliospark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(f"{ROOT}/foliospark"):
        for n in names:
            if n.endswith(".py") and f"{os.sep}llm" not in folder:
                assert "foliospark.llm" not in open(f"{folder}/{n}").read(), n
