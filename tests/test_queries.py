"""Every registered query on the smallest tables, against its SQL where there is one."""

import os

import pytest
from oracle import compare

from ledgerlight.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


#: Queries that give no rows on the smallest tables; others of the same operators do.
NO_ROWS = ("d8_statements", "o2_keyset_page")


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    n = compare(df, registry.ORACLES[name], SF) if name in registry.ORACLES else df.count()
    assert (n > 0) == (name not in NO_ROWS)
