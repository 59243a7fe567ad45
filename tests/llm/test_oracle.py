"""The training-data queries against their DuckDB SQL on the smallest tables."""

import pytest

from noteloom.llm import queries
from tests.conftest import SF
from tests.test_queries import oracle, plain


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_oracle(spark, name):
    found, wanted = queries.QUERIES[name](spark, SF).toPandas(), oracle(queries.ORACLE[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert plain(found.astype(object).where(found.notna(), "null")) == plain(wanted.astype(object).where(wanted.notna(), "null"))
