"""Every query of the library engine against its oracle SQL, at the smallest scale."""

import math

import duckdb
import pytest

from tonearm.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries without SQL that other tests hold against a plain program on the same tables.
PLAIN = {"density_clusters", "fuzzy_match_ratio", "impute_from_embedding", "kmeans_spherical", "leave_one_group_out", "ridge_direction", "spearman_heldout"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - PLAIN))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name not in catalogue.ORACLE:
        assert got
        return
    cursor = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in cursor.description]
    want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    assert sorted(names) == columns and len(got) == len(want)
    order = lambda r: tuple((v is None, round(v, 3) if isinstance(v, float) else 0, str(v) if not isinstance(v, float) else "") for v in r)
    for x, y in zip(sorted(got, key=order), sorted(want, key=order)):
        assert all(map(same, x, y)), (x, y)
