import os

import pytest

from sievekit.llm import registry
from tests.parity import FOLDER, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, registry.QUERIES[name], registry.ORACLES[name]) == []
