import os

import pytest

from sievekit.plans import registry
from tests.parity import FOLDER, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, registry.QUERIES[name], registry.ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    rows = registry.QUERIES[name](spark, FOLDER)
    assert rows.columns and rows.count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
