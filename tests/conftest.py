import os
import sys

import pytest

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HOME)
os.environ["PYTHONPATH"] = HOME + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from kerbline.session import session

    at = tmp_path_factory.mktemp("spark")
    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{at}/shared", "spark.sql.warehouse.dir": f"{at}/warehouse", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def plain(v):
    """A cell as both engines would print it."""
    import decimal

    import numpy as np
    import pandas as pd

    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, list | np.ndarray):
        return tuple(plain(i) for i in v)
    if isinstance(v, decimal.Decimal | float | np.floating):
        v = float(v)
        return None if v != v else int(v) if v == int(v) and abs(v) < 1e15 else round(v, 5)
    if isinstance(v, bool | np.bool_):
        return bool(v)
    return int(v) if isinstance(v, int | np.integer) else str(v)


@pytest.fixture(scope="session")
def same(spark, data, duck):
    def check(query, sql):
        a, b = query(spark, data).toPandas(), duck.sql(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        rows = lambda d: sorted((tuple(map(plain, r)) for r in d[sorted(d.columns)].itertuples(index=False)), key=repr)
        assert rows(a) == rows(b)

    return check
