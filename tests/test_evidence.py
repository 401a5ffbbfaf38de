"""Evidence at any size, files by their footers, and as-of joins, against plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import executed, rows, same
from creditloom.operators import evidence as E
from creditloom.operators.windows import as_of_join
from creditloom.sources.footers import file_footers
from creditloom.sources.sinks import write_parquet

CUTS = {"p25": 0.25, "median": 0.5, "p99": 0.99}


def first_at(values, cut):
    values = np.sort(values)
    return values[max(int(np.ceil(cut * len(values))), 1) - 1]


def test_percentiles_of_a_million_rows_are_exact(spark):
    tasks = spark.range(1_000_100).select(
        F.when(F.col("id") < 1_000_000, "big").when(F.col("id") % 2 == 0, "small").alias("stage"),
        F.when(F.col("id") % 7 != 3, (F.col("id") * 7919) % 1_000_003 / 4).alias("t"),
    )
    i = np.arange(1_000_100)
    value, known = (i * 7919) % 1_000_003 / 4, i % 7 != 3
    groups = {"big": i < 1_000_000, "small": (i >= 1_000_000) & (i % 2 == 0), None: (i >= 1_000_000) & (i % 2 == 1)}
    got = {r.stage: r for r in E.exact_percentiles(tasks, ["stage"], "t", CUTS).collect()}
    assert set(got) == set(groups)
    for stage, inside in groups.items():
        here = value[inside & known]
        assert got[stage]["count"] == len(here) and (got[stage]["min"], got[stage]["max"]) == (here.min(), here.max())
        for name, cut in CUTS.items():
            assert got[stage][name] == first_at(here, cut)


def test_a_group_is_spread_over_parts(spark):
    tasks = spark.range(50_000).select(F.lit(1).alias("g"), F.col("id").alias("t"))
    plan = executed(E.exact_percentiles(tasks, ["g"], "t", CUTS))
    assert "Window" in plan and "SinglePartition" not in plan


def test_percentiles_of_nulls_and_of_nothing(spark):
    tasks = spark.createDataFrame([("a", None), ("a", None), ("b", 3), ("b", 3)], "stage string, t int")
    got = E.exact_percentiles(tasks, ["stage"], "t", CUTS)
    assert rows(got) == [("a", 0, None, None, None, None, None), ("b", 2, 3, 3, 3, 3, 3)]
    assert E.exact_percentiles(tasks.where("false"), ["stage"], "t", CUTS).count() == 0


def plain_hot_keys(df, key, n):
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).collect()
    total = sum(r.n_rows for r in counts)
    best = sorted(counts, key=lambda r: (-r.n_rows, r[0] is None, r[0]))[:n]
    return [(r[0], r.n_rows, r.n_rows / total, r.n_rows / total * len(counts)) for r in best]


@pytest.mark.parametrize("kind", ["string", "bigint", "int"])
@pytest.mark.parametrize("size", [8, 64, 100_000])
def test_hot_keys_are_exact_whatever_the_sketch_holds(spark, kind, size):
    rng = random.Random(size)
    data = [(rng.choice([1, 1, 1, 2, 2, 3, None, -7, rng.randrange(-40_000, 70_000)]),) for _ in range(20_000)]
    df = spark.createDataFrame(data, "k bigint").select(F.col("k").cast(kind).alias("k")).repartition(6)
    for n in (1, 4, 30):
        got = [tuple(r) for r in E.hot_keys(df, "k", n, size).collect()]
        want = plain_hot_keys(df, "k", n)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(g == pytest.approx(w) for g, w in zip([g[2:] for g in got], [w[2:] for w in want]))


def test_sketch_is_bounded_and_bounds_its_error(spark):
    df = spark.range(60_000, numPartitions=5).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    found = E.frequent_items(df, "k", 50).collect()
    assert len(found) <= 5 * 51
    lost = sum(r.lost for r in found)
    held = sum(r.n for r in found if r.k == -1)
    assert held <= 20_000 <= held + lost and lost <= 60_000 / 50
    assert E.hot_keys(df.where("false"), "k").count() == 0


def test_distinct_counts_by_bitmaps(spark):
    for values in ([0, 0, -1, 32767, 32768, -32768, 2**40, None], [None], []):
        df = spark.createDataFrame([(v,) for v in values], "k bigint")
        assert E.distinct_count(df, "k").first().keys == len({v for v in values if v is not None})


def test_profile_from_footers_equals_a_scan(spark, tmp_path):
    path = str(tmp_path / "table")
    data = spark.range(5_000).select("id", F.when(F.col("id") % 11 != 0, F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 9 + 1).cast("string"), 2, "0"))).alias("pt"))
    write_parquet(data, path, ["pt"], 3)
    files = file_footers(spark, path, ["pt"])
    scanned = E.scanned_profile(data, "pt", "2024-01-03", "2024-01-05").first()
    profile = E.table_profile(files, "pt", "2024-01-03", "2024-01-05").first()
    assert all(profile[c] == scanned[c] for c in ("partitions", "window_partitions", "window_rows", "total_rows"))
    on_disk = [p for p in (tmp_path / "table").rglob("*.parquet")]
    assert profile.files == len(on_disk) and profile.total_bytes == sum(p.stat().st_size for p in on_disk)
    assert "FileScan" not in executed(files)
    same(files.groupBy("pt").agg(F.sum("rows").alias("n")), data.groupBy("pt").agg(F.count(F.lit(1)).alias("n")))
    got = E.small_files(files, ["pt"])
    assert {r.pt: r.files for r in got.collect()} == {r.pt: r["n"] for r in files.groupBy("pt").agg(F.count(F.lit(1)).alias("n")).collect()}
    (tmp_path / "empty").mkdir()
    assert file_footers(spark, str(tmp_path / "empty")).count() == 0


def test_partition_values_are_unescaped(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.createDataFrame([(1, "a b"), (2, "x=y/z:%")], "id int, pt string").write.partitionBy("pt").parquet(path)
    assert {r.pt for r in file_footers(spark, path, ["pt"]).collect()} == {"a b", "x=y/z:%"}


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(4)
    left = [(rng.choice(["hot", "hot", "b", "c", None]), rng.choice([None, *range(60)]), i) for i in range(1500)]
    right = [(rng.choice(["hot", "b", "d", None]), rng.choice([None, *range(5, 50)]), rng.choice([None, 1, 2, 3]), i) for i in range(300)]
    return (
        spark.createDataFrame(left, "k string, at int, id int").repartition(3),
        spark.createDataFrame(right, "k string, since int, v int, n int").repartition(3),
    )


def test_as_of_join_equals_its_definition(both):
    left, right = both
    got = {r.id: (r.v, r.n) for r in as_of_join(left, right, ["k"], "at", "since", ["v", "n"], ["n"]).collect()}
    known = [r for r in right.collect() if r.k is not None and r.since is not None]
    for r in left.collect():
        before = [x for x in known if x.k == r.k and r.at is not None and x.since <= r.at]
        best = max(before, key=lambda x: (x.since, x.n), default=None)
        assert got[r.id] == ((best.v, best.n) if best else (None, None))
    assert len(got) == 1500


def test_as_of_join_keeps_repeated_rows_and_takes_empty_sides(both):
    left, right = both
    twice = left.unionAll(left)
    assert as_of_join(twice, right, ["k"], "at", "since", ["v"]).count() == 3000
    alone = as_of_join(left, right.where("false"), ["k"], "at", "since", ["v"])
    assert alone.count() == 1500 and alone.where("v is not null").count() == 0
    assert as_of_join(left.where("false"), right, ["k"], "at", "since", ["v"]).count() == 0


def test_as_of_join_spreads_a_hot_key(spark):
    left = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("at"))
    right = spark.range(0, 20_000, 7).select(F.lit("hot").alias("k"), F.col("id").alias("since"), F.col("id").alias("v"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = as_of_join(left, right, ["k"], "at", "since", ["v"])
        per_task = joined.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in per_task) < 12_000 and len(per_task) > 1
        assert joined.where("v != at - at % 7").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
