"""Every query of the catalogue against its SQL, and the entry point with and without llm."""

import subprocess
import sys

import pytest

from millrace.plans.catalogue import ORACLES, QUERIES
from tests.oracle import SF, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_those_of_the_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_give_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and (df.count() > 0 or name == "minhash_near_dups")


def test_the_entry_point_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_broken_imports_inside_llm_are_not_hidden():
    code = "import sys; sys.modules['millrace.llm.bpe'] = None\nimport __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    llm = subprocess.run([sys.executable, "-c", "import millrace.llm"], capture_output=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert llm.returncode or ("bpe" in done.stderr and done.returncode)


def test_the_rest_works_without_llm():
    """The entry point imports, with all other queries, where the subpackage and the pipeline are gone."""
    code = (
        "import re, sys; sys.modules['millrace.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); assert 'exact_dedup' in q and not any(re.match(r'op[0-9]+_', n) for n in q), q\n"
        "assert not any('llm' in m and sys.modules[m] for m in sys.modules if m.startswith('millrace'))"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
