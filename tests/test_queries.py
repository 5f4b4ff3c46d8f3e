"""Every query of the reference's own operators against its SQL, over whole small tables."""

import os

import pytest
from conftest import same_rows

from siltstone.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    same_rows(spark, QUERIES[name], SQL[name], FOLDER)


def test_registry_names():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
