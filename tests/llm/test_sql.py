"""Every registered query of the subpackage against its SQL on the small tables."""

import pytest
from compare import DATA, connect, difference

from maskloom.llm.queries import QUERIES, SQL

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], SQL[name], FOLDER) is None
