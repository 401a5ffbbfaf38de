"""Rewritten operators give the rows of their plain forms, on random data with nulls, ties and hot keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows, same
from creditloom.functions.columns import any_in_list
from creditloom.functions.dates import month_ends
from creditloom.operators.aggregates import activity_span, distinct_per_window, pivot_months
from creditloom.operators.joins import attach_labels, attach_one, expand_validity, frequent_keys, lookup, tag_in_list, with_group_value
from creditloom.operators.windows import latest_snapshot, rank_per_day, top_ranked
from creditloom.plans.apps import app_features, app_features_stepwise
from creditloom.plans.loans import DPD_CLASSES, build_sample, client_months


@pytest.fixture(scope="module")
def daily(spark):
    """Loan days where one client holds a third of the rows and one loan many copies."""
    rng = random.Random(5)
    data = []
    for _ in range(3000):
        client = "c0" if rng.random() < 0.33 else rng.choice(["c1", "c2", "c3", None])
        loan = "hot" if rng.random() < 0.2 else rng.choice([f"l{i}" for i in range(40)] + [None])
        day = dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(0, 180))
        disb = rng.choice([None, dt.date(2024, 3, rng.randrange(1, 28)), dt.date(2024, 6, 2)])
        data.append((client, loan, rng.choice("AB"), rng.randrange(3), rng.choice([None, 10.25, 99.5]), disb, day.isoformat(),
                     rng.choice([None, 0, 1, 7, 8, 40])))
    return spark.createDataFrame(
        data,
        "client_no string, loan_no string, product_type string, tenor int, loan_disb double, loan_disbursement_date date,"
        " pt_date string, day_past_due int",
    ).cache()


def test_client_months_equals_rollup_and_pivot(spark, daily):
    months = month_ends("2024-05-31")
    monthly = daily.groupBy("client_no", "loan_no", F.last_day("pt_date").alias("m")).agg(F.max("day_past_due").alias("d"))
    labels = monthly.select(
        "client_no", "m", F.lit(1).alias("l_0dpd"),
        *[F.when(F.col("d") >= low, 1).otherwise(0).alias(f"l_{c}") for c, low in DPD_CLASSES.items()],
    )
    wide = labels.groupBy("client_no").pivot("m", months).agg(
        *[F.sum(f"l_{c}").alias(f"count_{c}") for c in ["0dpd", *DPD_CLASSES]]
    )
    loans = daily.select(
        "client_no", "loan_no", "product_type", "tenor", "loan_disb", F.last_day("loan_disbursement_date").alias("m")
    ).distinct()
    disb = loans.groupBy("client_no").pivot("m", months).agg(
        F.count("loan_no").alias("loan_disbursement_count"), F.sum("loan_disb").alias("loan_disbursement_amount")
    )
    plain = wide.withColumnRenamed("client_no", "k").join(disb, F.col("k").eqNullSafe(F.col("client_no"))).drop("k")
    got = client_months(daily, months)
    same(got.select(*[F.col(f"`{c}`") for c in plain.columns]), plain)


def test_pivot_months_equals_pivot(daily):
    months = ["2024-02-29", "2023-12-31", "2024-03-31"]
    df = daily.withColumn("m", F.last_day("pt_date"))
    value = F.col("day_past_due")
    plain = df.groupBy("client_no").pivot("m", months).agg(
        F.count(value).alias("n"), F.max(value).alias("hi"), F.sum(value).alias("s"), F.avg(value).alias("a")
    )
    got = pivot_months(
        df, ["client_no"], "m", months, {"n": ("count", value), "hi": ("max", value), "s": ("sum", value), "a": ("avg", value)}
    )
    assert got.columns == plain.columns
    same(got, plain)


def test_expand_validity_equals_calendar_join(spark):
    rng = random.Random(2)
    data = []
    for i in range(300):
        start = dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(-40, 80))
        data.append((i, start, start + dt.timedelta(days=rng.randrange(-2, 50))))
    data.append((301, dt.date(2024, 2, 1), dt.date(9999, 12, 31)))
    df = spark.createDataFrame(data, "id int, s date, e date")
    calendar = spark.sql("SELECT explode(sequence(DATE'2024-01-10', DATE'2024-03-10')) AS d")
    plain = df.join(calendar, (F.col("d") >= F.col("s")) & (F.col("d") < F.col("e")))
    same(expand_validity(df, "s", "e", "2024-01-10", "2024-03-10", "d"), plain)


def test_any_in_list_equals_explode_and_join(spark):
    rng = random.Random(3)
    data = [(i, rng.choice([None, [rng.choice(["a", "B", None, "c"]) for _ in range(rng.randrange(0, 4))]])) for i in range(200)]
    df = spark.createDataFrame(data, "id int, items array<string>")
    low = F.lower("item")
    plain = df.select("id", F.explode_outer("items").alias("item")).groupBy("id").agg(
        F.max(F.when(low.isin("b", "x"), 1).when(low.isNotNull(), 0)).alias("keep"),
        F.max(F.when(low.isin("b", "x"), 1).otherwise(0)).alias("zero"),
    )
    got = df.select(
        "id", any_in_list(F.col("items"), ["b", "x"], "keep").alias("keep"), any_in_list(F.col("items"), ["b", "x"]).alias("zero")
    )
    same(got, plain)


@pytest.fixture(scope="module")
def actions(spark):
    rng = random.Random(4)
    data = {(rng.choice(["a", "b", "c"]), f"d{rng.randrange(6)}", rng.randrange(0, 360)) for _ in range(400)}
    return spark.createDataFrame(sorted(data), "client string, device string, age int")


def test_distinct_per_window_equals_count_distinct(actions):
    got = distinct_per_window(actions, "client", "device", "age", (1, 30, 360))
    recent = {w: F.col("age") < w for w in (1, 30, 360)}
    plain = actions.groupBy("client").agg(
        *[F.countDistinct(F.when(c, F.col("device"))).alias(f"distinct_device_cnt_{w}d") for w, c in recent.items()],
        *[
            F.coalesce(
                F.try_divide(F.countDistinct(F.when(c, F.col("device"))).cast("double"), F.sum(F.when(c, 1))), F.lit(-999998.0)
            ).alias(f"distinct_device_cnt_norm_{w}d")
            for w, c in recent.items()
        ],
    )
    same(got, plain)


def test_span_equals_join_to_last_record(actions):
    last = actions.groupBy("client").agg(F.min("age").alias("last"))
    plain = actions.join(last, "client").groupBy("client").agg(F.max(F.col("age") - F.col("last")).alias("span"))
    same(activity_span(actions, "client", "age"), plain)


@pytest.mark.parametrize("hot_share", [None, 0, 0.25, 1e9])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_attach_one_equals_join(spark, daily, hot_share, how):
    side = spark.createDataFrame([("c0", 1, None), ("c2", 2, "x"), ("c9", 3, "y")], "client_no string, a int, b string")
    df = daily.select("client_no", "loan_no", "tenor")
    hot = None if hot_share is None else frequent_keys(df, ["client_no"], hot_share)
    got = attach_one(df, side, ["client_no"], how, hot)
    same(got, df.join(side, "client_no", how))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 1


def test_frequent_keys_are_bounded_and_dealt_out(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"), "id")
    hot = frequent_keys(rows, ["k"])
    assert [(r.k, r._parts) for r in hot.collect()] == [("hot", 2)]
    side = spark.createDataFrame([("hot", 1), ("1", 2)], "k string, v int")
    pinned = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in pinned}
    for k, v in pinned.items():
        spark.conf.set(k, v)
    try:
        hot = frequent_keys(rows, ["k"])
        joined = attach_one(rows, side, ["k"], hot=hot)
        same(joined, rows.join(side, "k", "left"))
        per_task = joined.groupBy(F.spark_partition_id().alias("p"), "k").count().where("k = 'hot' or k is null").collect()
        assert max(r["count"] for r in per_task) < 4_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("hot_share", [None, 0, 0.25])
def test_with_group_value_equals_window(daily, hot_share):
    df = daily.select("client_no", "loan_no", "tenor")
    plain = df.where(F.col("client_no").isNotNull()).withColumn("hi", F.max("loan_no").over(Window.partitionBy("client_no")))
    hot = None if hot_share is None else frequent_keys(df, ["client_no"], hot_share)
    same(with_group_value(df, ["client_no"], F.max("loan_no"), "hi", hot), plain)


def test_lookup_and_labels_and_tags(spark, daily):
    df = daily.select("client_no", "tenor").withColumn("id", F.monotonically_increasing_id())
    dim = spark.createDataFrame([("c0", 0, "p"), ("c1", 1, "q")], "client_no string, tenor int, name string")
    same(lookup(df, dim, ["client_no", "tenor"], ["name"]), df.join(dim, ["client_no", "tenor"], "left"))
    labels = spark.createDataFrame([("c0", 1), ("c1", None)], "client_no string, top int")
    got = attach_labels(df, labels, "client_no")
    assert got.agg(F.sum("top")).first()[0] == df.where("client_no = 'c0'").count()
    assert got.where("top IS NULL").count() == 0 and got.count() == df.count()
    items = spark.createDataFrame([("c0",), ("c0",), (None,), ("c2",)], "x string")
    same(tag_in_list(df, "client_no", items, "t"), tag_in_list(df, "client_no", ["c0", "c2"], "t"))


def test_ranks_compare_metrics_in_their_own_type(spark):
    """Neighbours beyond 2^53 are one double, so are decimals of many digits."""
    big = 1 << 60
    df = spark.range(200).selectExpr("'d' AS day", "id", f"{big} + id AS m")
    df = df.withColumn("c", F.concat(F.lit("7."), F.lpad(F.col("id").cast("string"), 20, "0")).cast("decimal(38,20)"))
    for metric in ("m", "c"):
        ranks = rank_per_day(df, "day", metric, "id").select("id", "rank").collect()
        assert all(r["rank"] == 200 - r["id"] for r in ranks) and len(ranks) == 200
    tops = top_ranked(df.withColumn("d", F.col("id").cast("double")), "day", [], {"m": ("m", None), "c": ("c", None), "d": ("d", None)}, 3, "id")
    assert sorted((r["metric"], r["rank"], r["id"]) for r in tops.collect()) == [(m, k, 200 - k) for m in "cdm" for k in (1, 2, 3)]


def test_rank_per_day_equals_window(spark):
    """Half of all metrics are equal, so whole parts hold one value; some rows have no day."""
    rng = random.Random(6)
    data = [(rng.choice(["d0", "d1", None]), i, rng.choice([None, 5.0, 5.0, 5.0, rng.random() * 10]), rng.choice([None, "p0"]))
            for i in range(3000)]
    df = spark.createDataFrame(data, "day string, id int, m double, q string")
    cls = F.when(F.col("q").isNotNull(), 1).otherwise(0)
    order = [F.coalesce("m", F.lit(0.0)).desc(), F.md5(F.col("id").cast("string")), F.col("id").cast("string")]
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("day", cls).orderBy(*order)))
    same(rank_per_day(df, "day", "m", "id", cls), plain)
    same(rank_per_day(df, "day", "m", "id", cls, top=7), plain.where("rank <= 7"))


def test_latest_snapshot_equals_window(spark):
    rng = random.Random(7)
    data = [(f"k{rng.randrange(5)}", dt.date(2024, 1, 1 + rng.randrange(4)), rng.choice(["a", "b", None])) for _ in range(100)]
    df = spark.createDataFrame(data, "k string, day date, item string")
    latest = df.withColumn("l", F.max("day").over(Window.partitionBy("k"))).where("day = l").drop("l").distinct()
    same(latest_snapshot(df, "k", "day", "item"), latest)


def test_build_sample_equals_joins(spark):
    rng = random.Random(8)
    data = [(f"c{rng.randrange(60)}", rng.choice([None, "REFUND", "OK", "OK"]), rng.choice(["101", "102", "7"]),
             rng.choice([None, dt.date(2024, rng.randrange(1, 9), 5)]), rng.choice([None, 0, 3]), rng.choice(["2024-04-30", "2024-05-31"]))
            for _ in range(300)]
    accounts = spark.createDataFrame(
        data, "client_no string, repayment_status string, sub_prod_code string, disburse_date date, dpd int, pt_date string"
    )
    kept = accounts.where("repayment_status <> 'REFUND' AND sub_prod_code IN ('101', '102', '120')")
    now = kept.where("pt_date = '2024-05-31'")
    first = now.groupBy("client_no").agg(F.min(F.last_day("disburse_date")).alias("first"))
    month = kept.groupBy("client_no", "pt_date").agg(F.max("dpd").alias("worst"))
    plain = (
        now.join(first, "client_no").join(month, ["client_no", "pt_date"], "left")
        .withColumn("mob", F.months_between(F.col("pt_date").cast("date"), F.col("first")) + 1).where("mob >= 0")
        .select("client_no", "pt_date", "mob", F.when(F.col("worst") > 0, "xdpd").otherwise("0dpd").alias("seg_obs")).distinct()
    )
    same(build_sample(accounts, "2024-05-31"), plain)
    with pytest.raises(ValueError):
        build_sample(accounts, "2024-05-30")


MESSAGES = [
    ('{"deviceId": "a", "deviceInfo": {"os": "android", "apps": ["A,x.loan", "B,-y.pay", "C"]}}', "device-security", "2024-03-10"),
    ('{"deviceId": "a", "deviceInfo": {"os": "android", "apps": ["B,-y.pay", "B,-y.pay"]}}', "device-security", "2024-03-12"),
    ('{"deviceId": "b", "deviceInfo": {"os": "ios", "apps": []}}', "device-security", "2024-03-12"),
    ('{"deviceId": "c", "deviceInfo": {"os": "ios", "apps": ["Z,ok"]}}', "device-security", "2024-03-12"),
    ('{"deviceId": "d", "deviceInfo": {"apps": ["A,x.loan"]}}', "device-security", "2024-03-12"),
    ('{"deviceId": "e", broken', "device-security", "2024-03-12"),
    ('{"deviceId": "f", "deviceInfo": {"os": "ios", "apps": ["A,x.loan"]}}', "other", "2024-03-12"),
    ('{"deviceId": "g", "deviceInfo": {"os": "ios", "apps": ["A,x.loan"]}}', "device-security", "2024-03-06"),
]


def test_app_features(spark):
    from creditloom.plans.apps import app_entries, parse_messages, scan_messages

    log = spark.createDataFrame(MESSAGES, "message string, pt_biz string, pt_date string")
    risk = ["x.loan", "com.y.pay"]
    got = app_features(log, "2024-03-20", "2024-03-20", risk)
    assert rows(got) == [("a", 1, 2), ("c", 0, 0)]
    table = spark.createDataFrame([(r,) for r in risk], "app string")
    same(app_features(log, "2024-03-20", "2024-03-20", table), got)
    entries = app_entries(parse_messages(scan_messages(log, "2024-03-20", "2024-03-20")))
    same(app_features_stepwise(entries, risk, "2022-01-01"), got)
    recent = app_features(log, "2024-03-20", "2024-03-20", risk, history_days=8)
    assert rows(recent) == [("a", 1, 1), ("c", 0, 0)]
