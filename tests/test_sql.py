"""Every registered query of the position domain against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from veritrack import catalog, catalog_history, catalog_runs, catalog_sources, catalog_views
from veritrack.operators import relink

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(scope="module", autouse=True)
def shared_inputs():
    """What many queries begin with is computed once; J_01, J_02, W_01, A_05 and G_06 hold these inputs against SQL themselves."""
    patch = pytest.MonkeyPatch()

    def kept(f):
        have = {}

        def run(*args):
            key = args[1:] if f is not relink.relink_window else args[2:]
            if key not in have:
                out = f(*args)
                have[key] = tuple(x.persist() for x in out) if isinstance(out, tuple) else out.persist()
            return have[key]

        return run

    for owner, name in ((catalog, "_classified"), (catalog, "_triples"), (catalog, "_episodes"), (catalog_history, "_labelled"), (catalog_views, "_pings"), (catalog_runs, "_watch_runs"), (relink, "relink_window")):
        new = kept(getattr(owner, name))
        for module in (catalog, catalog_history, catalog_runs, catalog_sources, catalog_views, relink):
            if hasattr(module, name):
                patch.setattr(module, name, new)
    yield
    patch.undo()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str(tuple(r[i] for i in order)) for r in rows)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want.fetchall(), columns)
