"""Every query that SQL can express agrees with its SQL."""

import pytest

from millrace import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(name, same_as_oracle):
    same_as_oracle(name, catalog.QUERIES, catalog.ORACLE)


def test_every_query_is_named_once():
    assert len(catalog.QUERIES) == sum(len(m.QUERIES) for m in catalog.MODULES)
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
