from __future__ import annotations

import pytest
from empty import emptied

from tomoframe.llm.queries import QUERIES


@pytest.fixture(scope="module")
def nothing(spark, data, tmp_path_factory):
    return emptied(spark, data, tmp_path_factory.mktemp("empty"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() == 0
