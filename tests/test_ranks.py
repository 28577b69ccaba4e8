"""Ranks, running sums and first rows of groups against plain Python, with one group that holds nearly all rows."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from siteloom import ranks, tables


@pytest.fixture(autouse=True)
def many_parts(spark):
    """Spark would put these few rows into one part."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [("hot", rng.randint(0, 60), k, rng.randint(-5, 50)) for k in range(3000)]
    out += [(rng.choice(["a", "b", None]), rng.randint(0, 5), 3000 + k, k) for k in range(40)]
    rng.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, score int, url long, bytes long").repartition(5)


def by_group(rows):
    key = lambda r: str(r[0])
    for g, own in itertools.groupby(sorted(rows, key=key), key):
        yield g, sorted(own, key=lambda r: (-r[1], r[2]))


def test_numbers(spark, rows):
    got = {r["url"]: (r["number"], r["n"]) for r in ranks.numbered(frame(spark, rows), "t", ["g"], [F.desc("score"), "url"], total="n").collect()}
    assert got == {r[2]: (k, len(own)) for _, own in by_group(rows) for k, r in enumerate(own, 1)}
    ordered = ranks.in_order(frame(spark, rows), "t", "g", F.desc("score"), "url").withColumn("part", F.shiftright(ranks.ORDER, ranks.PART_BITS))
    assert ordered.where("g = 'hot'").select("part").distinct().count() > 1


def test_running_sums(spark, rows):
    got = {r["url"]: (r["before"], r["seen"]) for r in ranks.running(frame(spark, rows), "t", ["g"], [F.desc("score"), "url"], {"before": F.col("bytes"), "seen": F.lit(1)}).collect()}
    want = {}
    for _, own in by_group(rows):
        for k, r in enumerate(own):
            want[r[2]] = (sum(x[3] for x in own[:k]), k)
    assert got == want


@pytest.mark.parametrize("limit", [1, 7, 2000])
def test_first_rows(spark, rows, limit):
    got = {r["url"]: r["rank"] for r in ranks.top(frame(spark, rows), ["g"], [F.desc("score"), F.asc("url")], limit, ["url"]).collect()}
    assert got == {r[2]: k for _, own in by_group(rows) for k, r in enumerate(own, 1) if k <= limit}


def test_equal_rows_and_none(spark, rows):
    same = [("x", 1, 1, 2)] * 500
    assert sorted(r["number"] for r in ranks.numbered(frame(spark, same), "t", ["g"], ["score"]).collect()) == list(range(1, 501))
    assert sorted(r["before"] for r in ranks.running(frame(spark, same), "t", [], ["score"], {"before": F.col("bytes")}).collect()) == list(range(0, 1000, 2))
    for df in (frame(spark, []), frame(spark, rows).limit(0)):
        assert ranks.numbered(df, "t", ["g"], ["url"]).collect() == [] == ranks.running(df, "t", ["g"], ["url"], {"s": F.col("bytes")}).collect() == ranks.top(df, ["g"], [F.asc("url")], 3, ["url"]).collect()


def test_tables_lie_under_one_folder(spark):
    path = tables.shared_folder(spark, "x")
    assert path.startswith(tables.application_folder(spark) + "/x-") and spark.sparkContext.applicationId in path


def test_last_values(spark, rows):
    some = F.when(F.col("bytes") % 7 == 0, F.struct("url"))
    got = {r["url"]: (r["p"]["url"] if r["p"] else None, r["b"]) for r in ranks.carried(frame(spark, rows), "t", ["g"], [F.desc("score"), "url"], {"p": some, "b": F.col("bytes")}).collect()}
    want = {}
    for _, own in by_group(rows):
        held, before = None, None
        for r in own:
            want[r[2]] = (held, before)
            held, before = (r[2] if r[3] % 7 == 0 else held), r[3]
    assert got == want


def test_released_tables_are_gone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "application_folder", lambda _: f"file://{tmp_path}/app")
    made = tables.cut(spark.range(5).toDF("x"), "t")
    assert made.count() == 5 and list((tmp_path / "app").iterdir())
    tables.release(spark)
    assert not (tmp_path / "app").exists()
    tables.release(spark)


def test_a_cluster_must_name_the_shared_folder():
    class Cluster:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "app"})  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        tables.application_folder(Cluster)
