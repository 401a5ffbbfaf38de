"""Hand-worked values of the column functions."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from creditloom.functions import columns as C
from creditloom.functions import dates as D
from creditloom.functions import packed as P
from creditloom.functions.months import month_feature
from creditloom.plans.loans import delinquency_spec, disbursement_spec, failed_application_spec, months_on_book


def one(spark, col, **values):
    fields = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'bigint'}"
                       for k, v in values.items()) or "x int"
    df = spark.createDataFrame([tuple(values.values()) or (1,)], fields)
    return df.select(col.alias("v")).first()["v"]


def test_month_ends():
    assert D.month_ends("2024-03-31", 3) == ["2024-01-31", "2024-02-29", "2024-03-31"]
    assert D.month_ends("2023-02-10", 2) == ["2023-01-31", "2023-02-28"]
    assert D.feature_date("2024-01-31") == "2024-01-31"
    assert D.feature_date("2024-01-30") == "2023-12-31"


def test_clamp_anchor():
    assert D.clamp_anchor("2024-05-01", "2024-04-10", 30, "2024-03-20") == ("2024-03-20", "2024-04-09")
    assert D.clamp_anchor("2024-04-01", "2024-04-10", 5) == ("2024-04-05", "2024-04-01")


@pytest.mark.parametrize(
    "family,n,expected",
    [("ever", 1, 1), ("ever", 3, 1), ("max", 1, 3), ("max", 2, 3), ("max", 3, 3), ("min", 1, 3), ("min", 2, 3), ("min", 3, 2),
     ("sum", 1, 3), ("sum", 2, 3), ("sum", 3, 5), ("change", 1, 0), ("change", 2, 0), ("change", 3, 0),
     ("change_ratio", 1, 0.0), ("change_ratio", 3, 0.0)],
)
def test_month_families_with_missing_month(spark, family, n, expected):
    months = D.month_ends("2024-03-31", 4)
    df = spark.createDataFrame([(None, 2, None, 3)], ", ".join(f"`{m}_x` int" for m in months))
    assert df.select(month_feature(family, "x", n, "2024-03-31", months)).first()[0] == expected


def test_month_steps(spark):
    months = D.month_ends("2024-03-31", 4)

    def value(data, family, n, listed=months):
        df = spark.createDataFrame([data], ", ".join(f"`{m}_x` int" for m in months))
        return df.select(month_feature(family, "x", n, "2024-03-31", listed)).first()[0]

    assert value((None, 2, 1, 3), "change", 1) == 2
    assert value((None, 2, 1, 3), "change", 2) == -1
    assert value((None, 2, 1, 3), "change_ratio", 1) == 2.0
    assert value((None, 2, 1, 3), "change_ratio", 2) == -0.5
    assert value((None, 2, 0, 3), "change_ratio", 1) == 0.0
    assert value((5, 2, 1, 3), "change", 3, months[1:]) == 0
    assert value((None, None, None, None), "sum_nullable", 1) is None
    assert value((None, None, None, None), "sum", 1) == 0
    assert value((None, None, None, None), "ever", 3) == 0
    with pytest.raises(ValueError):
        month_feature("median", "x", 1, "2024-03-31", months)


def test_feature_lists():
    assert len(delinquency_spec()) == 132
    assert len(disbursement_spec()) == 24
    assert len(failed_application_spec()) == 15


def test_packed(spark):
    assert one(spark, P.version_number(F.col("a")), a="3.12.1") == pytest.approx(3.12)
    assert one(spark, P.version_number(F.col("a")), a="3") is None
    assert one(spark, P.battery_part(F.col("a"), 0), a="60%|2") == 60
    assert one(spark, P.battery_part(F.col("a"), 1), a="60%|2") == 2
    assert one(spark, P.battery_part(F.col("a"), 1), a="60%") is None
    storage = "a,b,2147483648B,1073741824B"
    assert one(spark, P.storage_gib(F.col("a"), 2), a=storage) == 2.0
    assert one(spark, P.storage_gib(F.col("a"), 3), a=storage) == 1.0
    assert one(spark, P.storage_gib(F.col("a"), 3), a="a,b") is None
    assert one(spark, P.app_package(F.col("a")), a="Foo,com.x") == "com.x"
    assert one(spark, P.app_package(F.col("a")), a="Foo,-y.z") == "com.y.z"
    assert one(spark, P.app_package(F.col("a")), a="Foo") is None
    assert one(spark, P.count_char(F.col("a"), "1"), a="0|1|1") == 2
    assert one(spark, P.screen_width(F.col("a")), a="1080,2400") == 1080


def test_null_rules(spark):
    assert one(spark, C.to_int(F.col("a")), a="3.7") == 3
    assert one(spark, C.to_int(F.col("a")), a="12a") is None
    assert one(spark, C.at_least(F.col("a"), 8), a=None) == 0
    assert one(spark, C.ratio(F.col("a"), F.col("b")), a=1, b=0) is None
    assert one(spark, C.log_odds(F.col("a")), a=0.8) == pytest.approx(1.3862943611)
    assert one(spark, C.null_where(F.col("a") == "xdpd", F.lit(1)), a="xdpd") is None
    assert one(spark, C.null_where(F.col("a") == "xdpd", F.lit(1)), a=None) == 1
    assert one(spark, C.member_flag(F.col("a"), ["x"], "keep"), a=None) is None
    assert one(spark, C.member_flag(F.col("a"), ["x"]), a=None) == 0


def test_hour_bucket(spark):
    ts = F.lit("2024-01-01 23:10:00").cast("timestamp")
    assert spark.range(1).select(D.hour_bucket(ts)).first()[0] == "[23, 24)"


def test_months_on_book(spark):
    at, first = F.lit("2024-02-29").cast("date"), F.lit("2023-12-05").cast("date")
    assert spark.range(1).select(months_on_book(at, first)).first()[0] == 3.0


def test_any_in_list(spark):
    df = spark.createDataFrame([(None,), (["x", None],), (["WIFI"],), ([None],)], "a array<string>")
    out = df.select(C.any_in_list(F.col("a"), ["wifi"], "keep"), C.any_in_list(F.col("a"), ["wifi"]))
    assert [tuple(r) for r in out.collect()] == [(None, 0), (0, 0), (1, 1), (None, 0)]


def test_classify_first_match(spark):
    df = spark.createDataFrame([("SPARK", "hive_x"), (None, "my_Hive"), (None, None)], "t string, n string")
    label = C.classify([F.col("t"), F.col("n")], [("S", ["spark"]), ("H", ["hive"])], "O")
    assert rows(df.select(label)) == [("H",), ("O",), ("S",)]


def test_exact_sum_keeps_parts_of_a_cent(spark):
    df = spark.createDataFrame([(0.004,), (0.004,), (0.004,), (None,)], "x double")
    assert float(df.agg(C.exact_sum(F.col("x"))).first()[0]) == 0.012
    cents = df.select(F.col("x").cast("decimal(18,3)").alias("x"))
    assert float(cents.agg(C.exact_sum(F.col("x"), cents.schema["x"].dataType)).first()[0]) == 0.012


@pytest.mark.parametrize("odd", [1e30, 1e18, float("nan"), float("inf")])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_exact_sum_loses_no_amount_in_silence(spark, odd, ansi):
    df = spark.createDataFrame([(5.0,), (odd,)], "x double")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="amount out of range"):
            df.agg(C.exact_sum(F.col("x"))).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
