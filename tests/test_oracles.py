"""Every registered query against its SQL, at the smallest scale."""

import subprocess
import sys

import pytest

from tendril.plans import registry
from tests.compare import duck, same
from tests.conftest import HERE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        same(con, df, registry.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_a_library():
    """Where a library of the training-data operators is missing, all other queries are there."""
    code = "import sys\nsys.modules['public_tokenizers'] = None\nimport __spark_entry__ as e\nfrom tendril.plans import registry\nassert set(e.queries()) == set(registry.QUERIES) and set(e.oracle_sql()) == set(registry.ORACLE_SQL)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=HERE)
