"""The driver's contract, with the optional parts and without them."""

import os
import shutil
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e, bench; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q)"


@pytest.mark.parametrize("gone", [[], ["ledgerloom/llm"], ["ledgerloom/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_the_optional_parts(tmp_path, gone):
    from ledgerloom.plans import catalogue

    keep = shutil.ignore_patterns(".git", "__pycache__", "tests")
    shutil.copytree(TOP, tmp_path / "copy", ignore=keep)
    for name in gone:
        path = tmp_path / "copy" / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    llm = os.path.isdir(f"{TOP}/ledgerloom/llm") and "ledgerloom/llm" not in gone
    pipeline = llm and os.path.isfile(f"{TOP}/corpus_pipeline.py") and "corpus_pipeline.py" not in gone
    assert out.stdout.split() == [str(len(catalogue.QUERIES) + 10 * llm + pipeline), str(10 * llm), str(pipeline)]
