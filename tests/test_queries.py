"""Every registered query against its SQL on the small tables."""

import pytest
from compare import DATA, connect, difference

from maskloom.plans import QUERIES, SQL

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], SQL[name], FOLDER) is None


def test_entry_and_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).columns == ["decile", "blocks", "tokens", "mask_share"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries())
    assert set(QUERIES) - set(SQL) == {"topk_noise", "bpe_train_large", "bpe_encode_large"}


def test_mask_share_follows_time(spark):
    rows = QUERIES["mask_share_by_decile"](spark, FOLDER).collect()
    for row in rows:
        middle = (row["decile"] + 0.5) / 10
        assert abs(row["mask_share"] - middle) < 0.03
