import duckdb
import pandas as pd
import pytest

from lumenflow.plans import catalog, program  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(frame, columns):
    text = lambda x: "null" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
    return sorted(tuple(map(text, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    ours, theirs = catalog.QUERIES[name](spark, FOLDER).toPandas(), db.sql(catalog.ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows(ours, columns) == rows(theirs, columns)


def test_every_query_has_a_key_for_its_flagship():
    assert catalog.FLAGSHIP in catalog.QUERIES


def test_first_match_of_equal_lines_keeps_the_order_of_the_table(spark, tmp_path):
    part = lambda keys: pd.DataFrame([(k, "A", "F", api, 1) for k in keys for api in (9, 1, 5)], columns=["l_orderkey", "l_returnflag", "l_linestatus", "l_partkey", "l_linenumber"])
    (tmp_path / "lineitem.parquet").mkdir()
    part([0]).to_parquet(tmp_path / "lineitem.parquet" / "a.parquet")
    part(range(500)).assign(l_partkey=lambda t: t["l_partkey"] + 100).to_parquet(tmp_path / "lineitem.parquet" / "b.parquet")  # read first, being larger
    pd.DataFrame({"o_orderkey": range(500), "o_orderpriority": "1"}).to_parquet(tmp_path / "orders.parquet")
    ours = catalog.QUERIES["usage_first_match"](spark, str(tmp_path)).toPandas()
    assert dict(zip(ours["method"], ours["api"])) == {0: 9} | dict.fromkeys(range(1, 500), 109)


def test_first_match_takes_a_usage_without_line_last(spark, tmp_path):
    lines = pd.DataFrame({"l_orderkey": [1, 1, 2, 2, 3], "l_returnflag": ["A", "A", None, None, "N"], "l_linestatus": "F", "l_partkey": [7, 8, 3, 4, 5], "l_linenumber": pd.array([None, 2, None, 1, None], dtype="Int32")})
    lines.to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame({"o_orderkey": [1, 2, 3], "o_orderpriority": "1"}).to_parquet(tmp_path / "orders.parquet")
    ours = catalog.QUERIES["usage_first_match"](spark, str(tmp_path)).toPandas()
    c = duckdb.connect()
    for t in ("lineitem", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    columns = sorted(ours.columns)
    assert rows(ours, columns) == rows(c.sql(catalog.ORACLES["usage_first_match"]).df(), columns)
    assert dict(zip(ours["method"], ours["api"])) == {1: 8, 2: 4, 3: 5}
