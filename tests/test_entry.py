import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [("weftgraph/llm", "tests/llm"), ("weftgraph/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_lives_without_the_llm_folders(tmp_path, gone):
    for name in ("weftgraph", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        source = REPO / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(' '.join(sorted(q)))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert run.returncode == 0, run.stderr
    names = run.stdout.split()
    assert "sect_arts_grouped" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
