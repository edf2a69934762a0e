"""Every registered query of the library against its DuckDB oracle on the smallest tables."""

import math
from concurrent.futures import ThreadPoolExecutor, wait
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from massloom.plans.catalog import CATALOG

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def results(spark, request):
    """What a query returns; those with an oracle run some at a time, the others, learners among them, one by one after these."""
    wanted = [item.callspec.params["name"] for item in request.session.items if item.module is request.module]

    def run(name):
        df = CATALOG[name][0](spark, DATA)
        return df.columns, df.collect()

    with ThreadPoolExecutor(6) as pool:
        running = {name: pool.submit(run, name) for name in wanted if CATALOG[name][1]}

        def result(name):
            if name in running:
                return running[name].result()
            wait(running.values())
            return run(name)

        yield result
        pool.shutdown(cancel_futures=True)


def plain(value):
    if isinstance(value, (float, Decimal)):
        return "nan" if math.isnan(value) else float(f"{float(value):.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(results, duck, name):
    sql = CATALOG[name][1]
    found_columns, rows = results(name)
    if sql is None:
        assert found_columns
        return
    found = duck.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(found_columns)
    names = sorted(columns)
    expected = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in names) for r in rows), key=repr) == expected
