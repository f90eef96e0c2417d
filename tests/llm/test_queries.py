"""Every query of the subpackage: against its SQL where it has one."""

from pathlib import Path

import duckdb
import pytest

from compare import rows
from strandline.llm.queries import R


@pytest.mark.parametrize("name", sorted(R.queries))
def test_query(spark, sf, name):
    df = R.queries[name](spark, sf)
    got = rows(df.columns, df.collect())
    assert got
    if name in R.sql:
        db = duckdb.connect()
        for p in Path(sf).glob("*.parquet"):
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        r = db.execute(R.sql[name])
        assert got == rows([d[0] for d in r.description], r.fetchall())
