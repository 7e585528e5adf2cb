"""The partner tool from SQL, its arguments, and a company with many searches."""

import pytest

from tendril.operators import tools
from tendril.plans import registry
from tests.compare import duck, same


@pytest.fixture
def rows(spark):
    searches = spark.createDataFrame([(k, 1) for k in range(40)] + [(100, 2), (101, 3), (102, None)], "search_id long, company_id long")
    partners = spark.createDataFrame([(1, 5, "e", 0.5), (1, 3, "c", None), (1, 4, None, 1.0), (2, 9, "z", 2.0), (4, 7, "q", 1.0), (None, 8, "n", 1.0)], "company_id long, partner_id int, name string, weight double")
    tools.register(spark)
    return tools.tool_rows(searches, partners)


def test_first_partners(spark, rows):
    got = spark.sql("SELECT * FROM list_partners(TABLE({rows}), 2, 'name, weight')", rows=rows)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("search_id", "bigint"), ("partner_id", "int"), ("name", "string"), ("weight", "double")]
    want = [(k, p, n, w) for k in range(40) for p, n, w in [(3, "c", None), (4, None, 1.0)]] + [(100, 9, "z", 2.0)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert spark.sql("SELECT * FROM list_partners(TABLE({rows}), 0, '')", rows=rows).count() == 0
    assert sorted(map(tuple, spark.sql("SELECT * FROM list_partners(TABLE({rows}), 9, '') WHERE search_id >= 39", rows=rows).collect())) == [(39, 3), (39, 4), (39, 5), (100, 9)]


@pytest.mark.parametrize("call, message", [("TABLE({rows}), 2, 'none'", "has no none"), ("TABLE({rows}), -1, 'name'", "number of partners"), ("TABLE({rows}), 2, 3", "names fields"), ("1, 2, 'name'", "is a table")])
def test_arguments(spark, rows, call, message):
    with pytest.raises(Exception, match=message):
        spark.sql(f"SELECT * FROM list_partners({call})", rows=rows).collect()


def test_query(spark):
    d = "/root/testdata/sf0.01"
    same(duck(d), registry.QUERIES["partners_tool"](spark, d), registry.ORACLE_SQL["partners_tool"])
    same(duck(d), registry.QUERIES["partners_tool"](spark, d), registry.ORACLE_SQL["partners_of_search"])
