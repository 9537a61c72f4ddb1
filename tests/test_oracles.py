"""Every registered review-corpus query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from foliant.functions import rules
from foliant.plans.catalog import ORACLES, QUERIES

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    found = duck.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert mine == sorted(tuple(str(r[i]) for i in at) for r in found.fetchall())


def test_regex_join_at_letters_that_are_not_ascii(spark, tmp_path):
    c = duckdb.connect()
    texts = [None, "", "les", "LES_", "les1", "lesèau", "éles", "les\u0301", "e\u0301les", "leſ", "leſx", "le\u017f\u0301x", "derß", "the٣", "ａand", " Que ", "èque ", "tales", "x\nthe\n"]
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    c.execute(f"copy documents to '{tmp_path}/documents.parquet' (format parquet)")
    mine = sorted(map(tuple, QUERIES["regex_theta_join"](spark, str(tmp_path)).select("rule", "n").collect()))
    assert mine == sorted(c.execute(ORACLES["regex_theta_join"]).fetchall())
    assert dict(mine) == {"r_les": 6, "r_der": 1, "r_the": 2, "r_and": 1, "r_que": 1}


def test_patterns_as_re2_reads_them(spark):
    texts = ["les", "leſ", "leſx", "tableK", "a bé", "éb", "b\\b", "\\bé", "aab é", "ÉTÉ", "été2", "the-end", "B\n", "", "xıy", "a_b"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for p in (r"\bles\b", r"le[a-z]\b", r"k\b", r"\bb", r"\Bb", r"b\B", r"\\b", r"\bb\b|\bété", r"é\b", r"a\b?b", r"e\b{2}", r"\b", r"(the|a)\b-", r"xi"):
        mine = [r[0] for r in rows.select(rows.text.rlike(rules.as_re2(p))).collect()]
        assert mine == [duckdb.execute("select regexp_matches(?, '(?i)' || ?)", [t, p]).fetchone()[0] for t in texts], p


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_packing_keeps_budgets(spark):
    for name in ("pack_ffd", "pack_lpt"):
        assert QUERIES[name](spark, DATA).count() == 200
    from pyspark.sql import functions as F

    bins = QUERIES["pack_ffd"](spark, DATA).groupBy("lang", "bin").agg(F.sum("n_chars").alias("s"), F.count("*").alias("n"))
    assert bins.where("s > 20000 and n > 1").count() == 0
