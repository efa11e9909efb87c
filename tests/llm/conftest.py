from __future__ import annotations

import pytest

from punctual.llm.storage import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    """Workers need the package wherever the tests were started from."""
    ship(spark)
