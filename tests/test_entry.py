import importlib
import subprocess
import sys

from tests.conftest import TOP


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_llm():
    code = "import sys; sys.modules['provlake.llm'] = None; import __spark_entry__ as e; assert e.llm_registry is None; assert 'resolver_decisions' in e.queries(); assert not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=TOP, check=True)
