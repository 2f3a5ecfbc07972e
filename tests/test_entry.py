"""The driver's entry points with and without the optional subpackage."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
NAMES = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def registered(folder):
    return json.loads(subprocess.run([sys.executable, "-c", NAMES], cwd=folder, capture_output=True, text=True, check=True).stdout.splitlines()[-1])


def of_llm(name):
    return name == "pipeline" or (name.startswith("op") and name[2].isdigit())


@pytest.mark.parametrize("pipeline", [True, False])
def test_registers_all_else_without_the_subpackage(tmp_path, pipeline):
    """A copy without the subpackage, with or without the pipeline's file, has every other query."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT / "sparsegrove", copy / "sparsegrove", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (pipeline and (ROOT / "corpus_pipeline.py").exists()):
        shutil.copy(ROOT / name, copy / name)
    queries, oracles = registered(copy)
    whole, whole_oracles = registered(ROOT)
    assert queries == [q for q in whole if not of_llm(q)] and oracles == [q for q in whole_oracles if not of_llm(q)]
