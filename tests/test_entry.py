"""The entry module with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("deleted", [["corpusflow/llm"], ["corpusflow/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_training_data_operators(tmp_path, deleted):
    for name in ("corpusflow", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        ignore = shutil.ignore_patterns("__pycache__", *(["llm"] if "corpusflow/llm" in deleted else []))
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=ignore)
        elif os.path.exists(source) and name not in deleted:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), 'pipeline' in q)"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert said.returncode == 0, said.stderr
    count, pipeline = said.stdout.split()
    assert int(count) >= 140 and pipeline == "False"


def test_other_missing_modules_are_not_hidden(monkeypatch):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry

    assert entry.llm_absent(ModuleNotFoundError(name="corpusflow.llm.common"))
    assert not entry.llm_absent(ModuleNotFoundError(name="corpusflow.llmx")) and not entry.llm_absent(ModuleNotFoundError(name="numpy"))
