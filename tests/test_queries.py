"""Every registered query against its SQL check, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    # A few selective queries find nothing at this scale; `python -m tests.compare` runs the next one.
    assert compare(spark, con, name, SF) in ("", "empty on both sides")


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 10
