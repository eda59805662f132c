"""The library and its entry work where the training-data operators have been taken out."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).parent.parent
LOOK = "import __spark_entry__ as e; q = e.queries(); print('top_stories' in q, any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_is_imported_without_the_operators(tmp_path, pipeline):
    left_out = ["llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])]
    copy = shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(*left_out))
    done = subprocess.run([sys.executable, "-c", LOOK], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["True", "False", "False"], done.stderr
