"""Every query of the catalogue runs, and equals its SQL in DuckDB."""

import pytest

from tarnweave import catalog

from .oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = connect(SF)
    con.execute("SET TimeZone = 'UTC'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert differences(spark, con, SF, catalog.queries()[name], catalog.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry_imports_without_the_corpus_operators():
    import subprocess
    import sys

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tarnweave.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 100 and not any(k.startswith("op") and k[2].isdigit() for k in e.queries()) and "pipeline" not in e.queries()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(__import__("pathlib").Path(__file__).parent.parent))
