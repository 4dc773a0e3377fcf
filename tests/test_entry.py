import importlib
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_with_sql_is_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_training_data_subpackage(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("loomstone.llm", "corpus_pipeline")) else find(name, *a))
    names = __spark_entry__.queries()
    assert "vector_topk" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert "__spark_entry__" in sys.modules


def test_a_copy_without_the_training_data_folders_imports_and_registers_the_rest(tmp_path):
    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here / "loomstone", tmp_path / "loomstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 120 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
