"""The library without its optional part: a copy that lacks it imports and lists its queries."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; from agorametrics.plans import catalog; print(set(e.queries()) == set(catalog.QUERIES), set(e.oracle_sql()) <= set(e.queries()))"


def _copy(to: Path) -> Path:
    shutil.copytree(HERE / "agorametrics", to / "agorametrics", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(HERE / "__spark_entry__.py", to)
    return to


def _run(folder: Path) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("leftover", [True, False])
def test_imports_without_the_optional_part(tmp_path, pipeline, leftover):
    copy = _copy(tmp_path)
    if pipeline and (HERE / "corpus_pipeline.py").exists():
        shutil.copy(HERE / "corpus_pipeline.py", copy)
    if leftover:  # a folder that only holds compiled files
        (copy / "agorametrics" / "llm" / "__pycache__").mkdir(parents=True)
    said = _run(copy)
    assert said.returncode == 0, said.stderr
    assert "True True" in said.stdout


def test_an_error_inside_the_optional_part_shows(tmp_path):
    copy = _copy(tmp_path)
    (copy / "agorametrics" / "llm").mkdir()
    (copy / "agorametrics" / "llm" / "__init__.py").write_text("")
    (copy / "agorametrics" / "llm" / "queries.py").write_text("import a_module_nobody_has\n")
    said = _run(copy)
    assert said.returncode != 0 and "a_module_nobody_has" in said.stderr
