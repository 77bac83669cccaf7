"""The driver contract, with and without the dealt operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 6


def test_sql_is_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_package_stands_without_the_dealt_operators(tmp_path):
    code = "import sys; sys.modules['leafline.llm'] = None; import __spark_entry__ as e; assert 'q1_fk_joins' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
