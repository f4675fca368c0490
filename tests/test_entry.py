"""The entry point without the subpackage of corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_entry_without_the_corpus_operators(tmp_path):
    """With strandflow/llm gone, corpus_pipeline.py there or not, all other queries are listed."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "strandflow", tmp_path / "strandflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    names = said.stdout.split()
    assert "bulk_em_cpm" in names and "tag_extract" in names and "classify_exons_and_windows" in names, said.stderr
    assert not [n for n in names if n.startswith("op") and n[2].isdigit() or n == "pipeline"]
