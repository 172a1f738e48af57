import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_stands_without_the_text_subpackage(tmp_path):
    shutil.copytree(ROOT / "galewright", tmp_path / "galewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'p1_found' in q and 'p7_ids' not in q and set(o) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert int(out.stdout) > 100


def test_nothing_else_imports_the_text_subpackage():
    for p in (ROOT / "galewright").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"galewright\.llm|from \.+llm", p.read_text()), p


def test_every_dealt_problem_has_its_query():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    core = {f"p{n}_found" for n in range(1, 7)}
    assert core <= set(q)
