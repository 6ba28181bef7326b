import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT)]


@pytest.fixture(scope="session")
def spark():
    from inkwell.session import session

    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.fixture(scope="session")
def same_rows():
    """Rows as sorted texts, columns by name, floats to six places."""

    def normal(rows, columns):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else str(r[i]) for i in order]) for r in rows)

    def check(df, relation):
        assert sorted(df.columns) == sorted(relation.columns)
        assert normal(df.collect(), df.columns) == normal(relation.fetchall(), relation.columns)

    return check
