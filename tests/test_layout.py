"""The optional subpackage is optional, and its columns are in the entry module when it is there."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_core_does_not_import_the_optional_part():
    for folder, _, names in os.walk(os.path.join(ROOT, "ordinata")):
        if os.sep + "llm" in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "ordinata.llm" not in f.read(), name


def test_the_entry_imports_without_the_optional_part(tmp_path):
    os.makedirs(tmp_path / "ordinata")
    for name in os.listdir(os.path.join(ROOT, "ordinata")):
        if name != "llm":
            os.symlink(os.path.join(ROOT, "ordinata", name), tmp_path / "ordinata" / name)
    os.symlink(os.path.join(ROOT, "__spark_entry__.py"), tmp_path / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and q.keys() == e.oracle_sql().keys() and 'pipeline' not in q"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
