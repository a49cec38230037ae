"""The entry module with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_works_without_the_corpus_folders(tmp_path, pipeline):
    """A copy of the tree without both folders, with and without the pipeline's file, still lists and collects everything else."""
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) < set(q); assert 'depth_sweep' in q and 'pipeline' not in q and not [x for x in q if x.startswith('op')]; print(len(q))"
    # only the tree itself leaves the path: libraries may come from there too
    path = [x for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x and os.path.realpath(x) != os.path.realpath(ROOT)]
    env = os.environ | {"PYTHONPATH": os.pathsep.join(path)}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and int(done.stdout) > 60, done.stderr
    listed = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, timeout=300)
    assert listed.returncode == 0, listed.stdout
    some = [sys.executable, "-m", "pytest", "-x", "-q", "tests/test_micro.py", "tests/test_queries.py", "-k", "depth or entry"]
    done = subprocess.run(some, cwd=tmp_path / "copy", env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stdout
