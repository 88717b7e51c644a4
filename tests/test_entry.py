import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_imports_without_the_llm_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    said = "import __spark_entry__ as e; q = e.queries(); assert 'reachable_methods' in q and 'pipeline' not in q; print(len(q), len(e.oracle_sql()))"
    for extra in ((), ("corpus_pipeline.py",)):  # with and without the pipeline's file
        for name in extra:
            (copy / name).write_text("import graphloom.llm\n")
        out = subprocess.run([sys.executable, "-c", said], cwd=copy, capture_output=True, text=True, timeout=120)
        assert out.returncode == 0, out.stderr
