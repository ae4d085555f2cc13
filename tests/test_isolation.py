"""The library without the training-data subpackage: everything else still imports and is registered."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_rest_stands_without_the_training_data_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    shutil.rmtree(copy / "caseweave/llm", ignore_errors=True)
    shutil.rmtree(copy / "tests/llm", ignore_errors=True)
    code = (
        "import __spark_entry__ as e, bench\n"
        "q, s = e.queries(), e.oracle_sql()\n"
        "assert 'semantic_topk' in q and not any(n == 'pipeline' or n.startswith('op') and n[2].isdigit() for n in q), q\n"
        "assert set(s) <= set(q)\n"
        "print('whole')"
    )
    for keep_pipeline in (True, False):
        if not keep_pipeline:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
        assert done.stdout.strip() == "whole", done.stderr
