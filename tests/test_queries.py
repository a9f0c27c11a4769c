import sys

import pytest

sys.path.insert(0, "tools")
import compare  # noqa: E402

from tallywise.plans import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, name):
    said, ok = compare.compare(spark, compare.duck(SF), name, registry.QUERIES[name], registry.ORACLES[name], SF)
    assert ok, said
