"""Every engine query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from snapweave.plans import queries, store_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    rows = duck.sql(f"SELECT {quoted} FROM ({queries.ORACLES[name]})").fetchall()
    assert canon(map(tuple, got.select(*columns).collect())) == canon(rows)


def test_entry_imports():
    import __spark_entry__ as e

    assert "negotiation_summary" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_manifests_are_split_and_repeated_paths_are_kept(spark):
    rows = [(f"docs/{'hot' if k % 4 else 'cold'}/d{k % 150}.txt", 420, len(t), k, bytes(32), t) for k in range(200) for t in [bytes([k]) * (k * 37 % 3000)]]
    files = spark.createDataFrame(rows, "path string, mode int, size long, mtime_ns long, digest binary, content binary")
    want = {}
    for path, _, size, *_ in rows:
        n = want.setdefault(path.split("/")[1], [0, 0, 0])
        n[:] = n[0] + 1, n[1] + size, n[2] + -(-size // queries.SIZE)
    for aim in (4 << 20, 1000):
        assert {r.dataset: [r.files, r.bytes, r.chunks] for r in queries.manifest_totals(files, aim).collect()} == want
