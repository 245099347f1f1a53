"""The driver's entry works without the training-data operators, and where what they need is missing."""

import json
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIST = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def copied(tmp_path, leave_out=()):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__", ".pytest_cache") or str(Path(folder, n).relative_to(ROOT)) in leave_out])
    return tmp_path / "repo"


def listed(root, before=""):
    run = subprocess.run([sys.executable, "-c", before + LIST], cwd=root, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(root)}, capture_output=True, text=True, check=True)
    return json.loads(run.stdout.splitlines()[-1])


@pytest.mark.parametrize("leave_out", [("chronolith/llm", "tests/llm"), ("chronolith/llm", "tests/llm", "corpus_pipeline.py")])
def test_without_the_folders(tmp_path, leave_out):
    names, sql = listed(copied(tmp_path, leave_out))
    assert len(names) > 90 and names == sql and not [n for n in names if n.startswith("op") or n == "pipeline"]


def test_with_a_missing_library(tmp_path):
    names, sql = listed(copied(tmp_path), "import sys; sys.modules['xxhash'] = None; ")
    assert len(names) > 90 and "pipeline" not in names and set(sql) <= set(names)


def test_nothing_else_imports_the_operators():
    for path in [*(ROOT / "chronolith").rglob("*.py"), *(ROOT / "tests").glob("*.py")]:
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", path.read_text(), re.MULTILINE), path
