"""Every query with SQL gives what DuckDB gives; the others give rows of a stable schema."""

import decimal

import duckdb
import pytest

from plumbline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return float(v) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ran = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == cols
    mine = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    theirs = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in ran.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_partitioning_changes_nothing(spark):
    from plumbline.operators import rollups
    from plumbline.plans import views

    stats = views.file_stats(spark, SF)
    one = sorted(map(tuple, rollups.by_key(stats.repartition(1)).collect()))
    many = sorted(map(tuple, rollups.by_key(stats.repartition(13)).collect()))
    assert one == many
    assert rollups.partition_errors(stats).count() == 0


def test_empty_project(spark):
    from plumbline.operators import complexity, findings, ranking, rollups
    from plumbline.plans import views

    stats = views.file_stats(spark, SF).where("false")
    assert rollups.by_key(stats).count() == 0
    assert rollups.totals(stats).first()["files"] == 0
    assert rollups.basic(stats).first()["average_lines"] == 0.0
    assert rollups.quality(stats).first()["consistency"] == 100.0
    assert rollups.diversity(stats).first()["diversity"] == 0.0
    assert ranking.pie(rollups.by_key(stats), "total_lines").count() == 0
    assert findings.file_findings(stats).count() == 0
    files = views.files(spark, SF).where("false")
    rows = complexity.functions(complexity.analyze(files))
    assert rows.agg(*complexity.statistics()).first()["cyclomatic"] == 0.0
    assert complexity.project_maintainability(stats, rows).first()[0] == 100.0


def test_one_decimal_rounds_the_exact_value_to_even(spark):
    from pyspark.sql import functions as F

    from plumbline.functions import scores

    values = [0.25, 0.75, 6.25, 8.35, 281.25, 656.25, 99.95, 0.0, 1e6 + 0.25]
    rows = spark.createDataFrame([(v, int(v * 1024)) for v in values], "v double, size long")
    got = rows.select("v", "size", scores.percent(F.col("v")).alias("p"), scores.told("%d of %.1f%%", F.col("size"), F.col("v")).alias("t"), scores.human_size(F.col("size")).alias("h")).collect()
    for r in got:
        assert (r["p"], r["t"]) == (f"{r['v']:.1f}%", f"{r['size']} of {r['v']:.1f}%")
        k = sum(r["size"] >= 1024**i for i in (1, 2, 3))
        assert r["h"] == (f"{r['size'] / 1024**k:.1f} {'KMG'[k - 1]}B" if k else f"{r['size']} B")
