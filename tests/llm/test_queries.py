"""The queries of the subpackage: those with SQL give its rows, the others run."""

import pytest

from tests.oracle import DATA, canon, connect
from wavemill.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    got = Q.QUERIES[name](spark, DATA).toPandas()
    assert len(got.columns)
    if name in Q.SQL:
        assert canon(got) == canon(connect().execute(Q.SQL[name]).df())


def test_nothing_else_imports_this():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for p in (root / "wavemill").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text()
