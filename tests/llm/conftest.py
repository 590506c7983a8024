"""Small tables with every awkward case."""

from __future__ import annotations

import os

import pytest
from awkward_rows import TEXTS, frame

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def awkward(spark):
    return frame(spark, TEXTS, "doc_id bigint, text string, lang string").cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [], "doc_id bigint, text string, lang string")


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    return DATA
