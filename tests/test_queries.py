"""Every registered schema query against its SQL on another engine."""

import os

import duckdb
import pytest

from schemaloom import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def show(v):
    return "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v).lower() if isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equal(spark, con, name):
    rows = queries.QUERIES[name](spark, FOLDER).collect()
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(tuple(show(r[n]) for n in names) for r in rows) == sorted(tuple(map(show, r)) for r in found.fetchall())
    assert rows, "the fixture has no case for this query"


def test_both_engines_read_the_rules_alike(con):
    for name, text in queries.SAME_TEXT.items():
        stated, found = con.execute(queries.ORACLE_SQL[name]).fetchall(), con.execute(text).fetchall()
        assert sorted(stated) == sorted(found), name


def test_the_rest_does_not_need_the_optional_folder():
    for root, _, files in os.walk(os.path.join(os.path.dirname(__file__), "..", "schemaloom")):
        if os.path.basename(root) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "schemaloom.llm" not in open(os.path.join(root, f)).read()


def test_merge_of_two_profiles_gives_the_union(spark):
    got = {r.path: r.type_repr for r in queries.QUERIES["infer_merge"](spark, FOLDER).collect()}
    assert got["mixed"] == "union(array|object)" and got["lines"] == "array"
    assert not any(p.startswith("mixed") and p != "mixed" for p in got)
