import pytest
from oracle import database, of_spark, of_sql

from weftgraph.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert of_spark(queries.queries()[name](spark, SF)) == of_sql(database(SF), queries.oracle_sql()[name])
