"""The library and the driver's entry without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_the_rest_imports_alone(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e, bench; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), any(n.startswith(('op1_', 'pipeline')) for n in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    count, inside, others = done.stdout.split()
    assert int(count) > 100 and inside == "True" and others == "False"


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "vellum").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "vellum").parts[:1]:
            assert "vellum.llm" not in path.read_text(), path
