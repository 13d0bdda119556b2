"""Every registered query against its SQL."""

from pathlib import Path

import oracle
import pytest

import __spark_entry__ as entry_point
from telemill.plans import catalog, oracles

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES, oracles.ORACLES

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, connection, name):
    columns, rows = oracle.actual(QUERIES[name](spark, SF_DIR))
    expected_columns, expected_rows = oracle.expected(connection, ORACLES[name])
    assert columns == expected_columns
    assert rows == expected_rows


def test_entry_point_registers_all():
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() == 20


def test_core_stands_without_text_package():
    """With the text package, the pipeline or a tokenizer library not importable, the core queries stay."""
    import subprocess
    import sys
    import textwrap
    from pathlib import Path

    repo = str(Path(entry_point.__file__).resolve().parent)
    for blocked in (("telemill.llm", "corpus_pipeline"), ("sentencepiece",)):
        code = textwrap.dedent(f"""
            import importlib.abc, sys
            class Block(importlib.abc.MetaPathFinder):
                def find_spec(self, name, path=None, target=None):
                    if any(name == b or name.startswith(b + ".") for b in {blocked!r}):
                        raise ModuleNotFoundError(name)
            sys.meta_path.insert(0, Block())
            sys.path.insert(0, {repo!r})
            import __spark_entry__ as e
            print(len(e.queries()), len(e.oracle_sql()))
        """)
        out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
        assert int(out[0]) >= len(QUERIES) and int(out[1]) >= 1
