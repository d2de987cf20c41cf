"""The registered queries against their SQL on the smallest tables."""

import glob
from pathlib import Path

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the tables aren't here")
pytest.importorskip("corpus_pipeline")

from pagemill.llm import registry  # noqa: E402


def same(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    df = registry.queries()[name](spark, SF)
    want = c.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    rows = want.fetchall()
    assert rows and sorted(tuple(same(r[k]) for k in names) for r in df.collect()) == sorted(tuple(map(same, r)) for r in rows)
