"""The operators' base columns against their SQL."""

import pytest

from dunecorpus.llm import queries
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_base_columns(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    assert differences(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir) is None
