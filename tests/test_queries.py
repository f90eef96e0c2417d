"""Every query of the library's core against its SQL, on the smallest data; and its form on an empty table."""

import importlib
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from compare import rows  # noqa: E402
from strandline.plans import FAMILIES  # noqa: E402

REGISTRIES = [importlib.import_module(f"strandline.plans.{f}").R for f in FAMILIES]
QUERIES = {k: f for r in REGISTRIES for k, f in r.queries.items()}
SQL = {k: s for r in REGISTRIES for k, s in r.sql.items()}


@pytest.fixture(scope="module")
def db(sf):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return db


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name in SQL:
        r = db.execute(SQL[name])
        columns = [d[0] for d in r.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, r.fetchall())


def test_library_stands_without_the_subpackage():
    import strandline

    root = Path(strandline.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "strandline.llm" not in p.read_text(), p
