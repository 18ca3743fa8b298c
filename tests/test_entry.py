"""The entry module with and without the subpackage for training data and its pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    shutil.copytree(REPO, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".*"))
    if not pipeline:
        (tmp_path / "copy" / "corpus_pipeline.py").unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    from folioscan import catalog

    assert set(said.stdout.split()) == set(catalog.QUERIES)


def test_local_folder_only_in_local_sessions(spark, monkeypatch):
    from folioscan import session

    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_scratch_deletes_what_is_dropped(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from folioscan.session import Scratch

    scratch = Scratch(spark, "test")
    one, two = scratch.write(spark.range(5), "one"), scratch.write(spark.range(7), "two")
    folder = Path(urlparse(scratch.base).path)
    assert len(list(folder.iterdir())) == 2 and one.count() == 5
    scratch.drop(one)
    assert len(list(folder.iterdir())) == 1 and two.count() == 7
    scratch.drop_all()
    assert not folder.exists()
