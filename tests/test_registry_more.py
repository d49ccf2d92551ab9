"""The other half of the registered queries against their SQL twins."""

import os

import pytest
from test_registry import SF, compared, names


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", names(1))
def test_query_equals_its_twin(spark, name):
    got, want = compared(spark, name)
    assert got == want
