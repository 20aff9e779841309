"""The driver's contract, and that the core stands without the training-data package."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 80
    assert e.entry(spark).count() > 0


def test_core_imports_without_llm():
    code = "import sys; sys.modules['skylattice.llm'] = None; import __spark_entry__ as e; assert not any(k in e.queries() for k in ('p1_found', 'p8_found')) and 'p4_found' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_nothing_outside_imports_llm():
    for p in (REPO / "skylattice").rglob("*.py"):
        if "llm" not in p.parts:
            assert "skylattice.llm" not in p.read_text()
