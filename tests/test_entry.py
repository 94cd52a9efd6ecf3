"""The entry must stand without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CHECK = """
import __spark_entry__ as e, packetlens.queries as q, sys
from packetlens.plans.session import local_session
assert e.__file__.startswith(sys.argv[1]), e.__file__
names = q.queries().keys()
assert set(names) <= set(e.queries()) and set(q.oracle_sql()) <= set(e.oracle_sql())
assert {"all": len(e.queries()) > len(names), "none": set(e.queries()) == set(names)}.get(sys.argv[2], "pipeline" not in e.queries())
if sys.argv[2] == "none":
    assert e.entry(local_session(2)).count() > 0
print("fine")
"""


@pytest.mark.parametrize(("gone", "left"), [((), "all"), (("corpus_pipeline.py",), "some"), (("packetlens/llm",), "none"), (("packetlens/llm", "tests/llm", "corpus_pipeline.py"), "none")])
def test_entry_without_optional_parts(tmp_path, gone, left):
    for name in ("packetlens", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    if left != "none" and not (tmp_path / "packetlens/llm").exists():
        pytest.skip("the corpus operators were taken out of this copy")
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    run = subprocess.run([sys.executable, "-c", CHECK, str(tmp_path), left], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert run.stdout.strip() == "fine", run.stderr


def test_other_missing_modules_are_errors(tmp_path):
    for name in ("packetlens", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path / name)
    (tmp_path / "corpus_pipeline.py").write_text("import packetlens_surely_missing")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert "packetlens_surely_missing" in run.stderr and run.returncode
