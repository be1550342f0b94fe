"""Every query of the catalogue against its SQL."""

import pytest

from oracle import compare, connect
from sparkloom.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        why = compare(spark, con, SF, QUERIES[name], SQL[name])
        assert why is None, why
    else:
        assert QUERIES[name](spark, SF).count() > 0
