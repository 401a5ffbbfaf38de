"""Rules on the number line, counts of what no rule matches, and interval sweeps, against plain forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from creditloom.operators.windows import running_total, valid_counts
from creditloom.plans.scoring import rule_column, unmatched_values, woe_encode


def rule(op, out, ord_, lo=None, hi=None, values=None, feature="x", stage="bin"):
    return {"feature": feature, "stage": stage, "ord": ord_, "op": op, "lo": lo, "hi": hi, "values": values, "out": out}


def random_rules(rng, n):
    made = []
    for i in range(n):
        op = rng.choice(["lt", "le", "between", "in", "is_null", "else"] if i > n - 4 else ["lt", "le", "between", "in"])
        lo, hi = sorted(rng.choice([rng.randrange(-9, 9), rng.uniform(-9, 9)]) for _ in range(2))
        values = [str(rng.choice([1, 2.0, "3", -4.5])) for _ in range(2)]
        made.append(rule(op, i, rng.randrange(50), lo, hi if rng.random() < 0.9 else lo - 1, values))
    return made


@pytest.mark.parametrize("kind", ["double", "int", "float"])
def test_search_equals_the_ladder(spark, kind):
    rng = random.Random(kind)
    values = [None, *range(-10, 11), *[rng.uniform(-10, 10) for _ in range(40)]]
    values += [float("nan"), float("inf"), float("-inf"), -0.0] if kind != "int" else []
    df = spark.createDataFrame([(v if v is None else float(v),) for v in values], "x double").select(F.col("x").cast(kind).alias("x"))
    for n in (1, 2, 3, 8, 17):
        rules = random_rules(rng, n)
        col, kind_of = F.col("x"), df.schema["x"].dataType
        both = df.select(rule_column(col, rules, kind_of, 0).alias("a"), rule_column(col, rules, None).alias("b")).collect()
        assert [r.a for r in both] == [r.b for r in both]


def test_many_rules_are_a_plan_of_constant_size(spark):
    df = spark.range(10).select((F.col("id") * 1000.5).alias("x"))

    def size(n):
        made = [rule("between", i, i, lo=float(i), hi=i + 0.75) for i in range(n)] + [rule("else", -1, n, stage="woe")]
        plan = woe_encode(df, made, ["x"])._jdf.queryExecution().logical().treeString()
        return plan.count("\n"), woe_encode(df.withColumn("k", F.col("x")), [r | {"feature": "k"} for r in made], ["x"])

    few, _ = size(50)
    many, encoded = size(10_000)
    assert few == many and len(encoded.collect()) == 10


def test_text_rules_stay_a_ladder(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    rules = [rule("in", i, i, values=[chr(97 + i)]) for i in range(20)]
    assert rows(woe_encode(df, rules + [rule("le", 5, 1, hi=0, stage="woe")], [])) == [(5.0,), (None,), (None,)]


def test_unmatched_values_are_counted_by_stage(spark):
    df = spark.createDataFrame([(1.0, 5), (7.0, None), (None, 5)], "x double, y int")
    rules = [rule("lt", 0, 1, hi=3), rule("le", 1, 1, hi=0, stage="woe"), rule("else", 2, 1, feature="y"), rule("le", 1, 1, hi=1, feature="y", stage="woe")]
    assert rows(unmatched_values(df, rules)) == [("x", "bin", 2), ("x", "woe", 2), ("y", "bin", 0), ("y", "woe", 3)]


def test_valid_counts_equal_expanded_days(spark):
    rng = random.Random(2)
    day = dt.date(2024, 1, 1)
    data = []
    for i in range(400):
        start = day + dt.timedelta(days=rng.randrange(40))
        data.append((rng.choice(["hot", "hot", "b", None]), rng.choice([start, start, None]), rng.choice([None, start + dt.timedelta(days=rng.randrange(-3, 20))])))
    df = spark.createDataFrame(data, "k string, s date, e date").repartition(4)
    got = {(r.k, r.day): r.valid for r in valid_counts(df, ["k"], "s", "e").collect()}
    good = [(k, s, e) for k, s, e in data if s and e and s < e]
    assert set(got) == {(k, x) for k, s, e in good for x in (s, e)}
    for (k, at), n in got.items():
        assert n == sum(k2 == k and s <= at < e for k2, s, e in good)
    assert valid_counts(df.where("false"), ["k"], "s", "e").count() == 0


def test_running_totals_of_one_hot_key(spark):
    df = spark.range(10_000).select(F.lit(1).alias("k"), F.col("id").alias("at"), (F.col("id") % 3).alias("n"))
    got = running_total(df, ["k"], "at", "n", "total")
    assert got.where("total != floor(at / 3) * 3 + if(at % 3 = 1, 1, if(at % 3 = 2, 3, 0))").count() == 0 and got.count() == 10_000
