"""The driver's contract, with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_does_not_import_the_training_data_operators():
    code = "import sys; import gridloom.registry; assert not [m for m in sys.modules if m.startswith('gridloom.llm')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for p in (ROOT / "gridloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p


def test_entry_without_the_training_data_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT / "gridloom", tmp_path / "gridloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'zonal_stats' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
