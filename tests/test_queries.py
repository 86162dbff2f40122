"""The engine's queries against their SQL on the smallest tables, and results that aren't empty."""

import duckdb
import pytest

from sievemark.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(frame):
    return sorted(repr(tuple(map(str, r))) for r in frame[sorted(frame)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    ours, theirs = Q.queries()[name](spark, SF).toPandas(), duck.execute(Q.oracle_sql()[name]).df()
    assert len(ours) > 1 or name == "feed_join"
    assert rows_of(ours) == rows_of(theirs)


def test_messages(spark):
    rows = Q.message_triage(spark, SF).toPandas()
    assert rows.risk.nunique() > 1 and rows.score.between(0, 100).all()


def test_sample_mails_are_dealt(spark):
    plan = Q.attachment_codes(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Repartition")  # customers go to all tasks below the join


def test_cosine_shuffles_texts_only(spark, duck):
    # a key may stand on several texts, and null keys meet nothing
    left = spark.createDataFrame([(1, "Abcabc xyz"), (1, "abca"), (2, None), (None, "abca"), (3, "ab")], "x int, t string")
    right = spark.createDataFrame([(7, "abcab"), (8, "xyz")], "y int, t string")
    rows = Q.cosine_rows(left, right, "x", "y", "t")
    assert {tuple(r[:2]) for r in rows.collect()} == {(1, 7), (1, 8)}
    # 8 has one gram; 1 has it once beside counts of its two texts: abc 3, bca 2, cab 1, bc_ c_x _xy xyz, abca 2, bcab cabc abc_ bc_x c_xy _xyz
    assert {r.y: r.cosine for r in rows.collect()}[8] == 1 / (9 + 4 + 1 + 4 + 4 + 6) ** 0.5
    plan = Q.ngram_cosine(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "p_partkey, gram" not in plan and "hashpartitioning(p_partkey" in plan


def test_link_rows_name_their_urls_once(spark):
    from pyspark.sql import functions as F

    from sievemark.plans.triage import link_rows

    rows = spark.createDataFrame([("m", ["http://a.example/x"]), ("n", []), ("o", None)], "message_id string, u array<string>")
    links = link_rows(rows.select("message_id", F.transform("u", F.upper).alias("urls")))
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(u#") == 1  # not again in a filter on the array's size
    assert [tuple(r) for r in links.select("message_id", "ordinal", "host").collect()] == [("m", 0, "a.example")]
