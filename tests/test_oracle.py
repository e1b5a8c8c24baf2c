"""Every query with SQL gives the rows that DuckDB does, and every other one runs."""

import pytest
from compare import duck_rows, spark_rows

from loomgraph.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = spark_rows(QUERIES[name](spark, SF))
    if name in ORACLE_SQL:
        assert found == duck_rows(ORACLE_SQL[name], SF)
    else:
        assert found[0] and found[1], "a query without SQL must show rows"
