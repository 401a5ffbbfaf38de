"""Rule-table WOE encoding, logistic score and the packed score table.

A rule is a mapping with ``feature``, ``stage`` (``bin`` or ``woe``), ``ord``, ``op``
(lt, le, between, in, is_null, else), ``lo``, ``hi``, ``values`` and ``out``. Rules of a feature
apply in ``ord`` order, the first match wins, and a value that matches none becomes null.

A few rules are a ladder of conditions. Many rules on a number are first laid out on the number line:
their bounds cut it into points and open stretches, each with the outcome of the first rule that holds
there, and a value finds its place by binary search in the sorted bounds. The plan then holds two
literals and one search, however many rules there are.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Model, Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType

from creditloom.functions.columns import ladder, log_odds, null_where
from creditloom.functions.dates import as_date, month_end
from creditloom.operators.joins import attach
from creditloom.operators.projections import fill_sentinels
from creditloom.plans.loans import MODEL_FEATURES, build_sample, delinquency_spec, disbursement_spec, loan_features

INTERCEPT = "(intercept)"
#: More rules than these are searched instead of tried in turn.
LADDER_RULES = 16


def _is_in(col: Column, values: list[str]) -> Column:
    """Membership by text, and by value where all listed values are numbers: 1 and 1.0 are equal."""
    try:
        numbers = [float(v) for v in values]
    except ValueError:
        return col.cast("string").isin(values)
    by_value = F.coalesce(col.cast("string").try_cast("double").isin(numbers), F.lit(False))
    return col.cast("string").isin(values) | by_value


def rule_condition(col: Column, rule: Mapping) -> Column:
    op = rule["op"]
    if op == "lt":
        return col < F.lit(rule["hi"])
    if op == "le":
        return col <= F.lit(rule["hi"])
    if op == "between":
        return col.between(F.lit(rule["lo"]), F.lit(rule["hi"]))
    if op == "in":
        return _is_in(col, list(rule["values"]))
    if op == "is_null":
        return col.isNull()
    if op == "else":
        return F.lit(True)
    raise ValueError(f"unknown rule operator {op!r}")


def _numbers(rule: Mapping) -> list[float] | None:
    """The bounds of a rule, or None if they are not all numbers."""
    given = {"lt": ["hi"], "le": ["hi"], "between": ["lo", "hi"], "is_null": [], "else": []}
    try:
        found = [float(v) for v in rule["values"]] if rule["op"] == "in" else [float(rule[k]) for k in given[rule["op"]]]
    except (KeyError, TypeError, ValueError):
        return None
    return None if any(math.isnan(v) for v in found) else found


def number_line(rules: Iterable[Mapping]) -> tuple[list[float], list[float | None], float | None] | None:
    """Sorted bounds, the outcome of every place on the line, and that of null; None if a rule is not numeric.

    Place 2i is the stretch below bound i, place 2i + 1 the bound itself.
    """
    ordered = sorted(rules, key=lambda r: r["ord"])
    numbers = [_numbers(r) for r in ordered]
    if any(n is None for n in numbers):
        return None
    bounds = sorted({v for n in numbers for v in n})
    at = {v: i for i, v in enumerate(bounds)}
    out: list[float | None] = [None] * (2 * len(bounds) + 1)
    # The next place without an outcome, so that every place is visited once.
    free = list(range(len(out) + 1))

    def next_free(i: int) -> int:
        while free[i] != i:
            free[i] = free[free[i]]
            i = free[i]
        return i

    null_out: list[float] = []
    for rule, own in zip(ordered, numbers, strict=True):
        op, value = rule["op"], float(rule["out"])
        if op in ("is_null", "else"):
            null_out.append(value)
        spans = {
            "lt": lambda: [(0, 2 * at[own[0]])],
            "le": lambda: [(0, 2 * at[own[0]] + 1)],
            "between": lambda: [(2 * at[own[0]] + 1, 2 * at[own[1]] + 1)],
            "in": lambda: [(2 * at[v] + 1, 2 * at[v] + 1) for v in own],
            "else": lambda: [(0, len(out) - 1)],
            "is_null": lambda: [],
        }[op]()
        for lo, hi in spans:
            i = next_free(lo)
            while i <= hi:
                out[i], free[i] = value, i + 1
                i = next_free(i)
    return bounds, out, null_out[0] if null_out else None


def search_column(col: Column, bounds: Sequence[float], out: Sequence[float | None], null_out: float | None) -> Column:
    """Outcome of a number's place on the line: as many steps as the number of bounds has bits."""
    value = col.cast("double")
    line = F.split(F.lit(",".join(map(repr, bounds))), ",").cast("array<double>") if bounds else F.array().cast("array<double>")
    places = F.from_json(F.lit(json.dumps(list(out))), "array<double>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))]).cast("array<int>")
    below = F.aggregate(
        steps,
        F.lit(0),
        lambda i, step: F.when((i + step <= len(bounds)) & (F.get(line, i + step - 1) <= value), i + step).otherwise(i),
    )
    at = F.aggregate(F.array(below), F.lit(0), lambda _, i: 2 * i - F.when(F.get(line, i - 1) == value, 1).otherwise(0))
    return F.when(col.isNull(), F.lit(null_out).cast("double")).otherwise(F.get(places, at))


def rule_column(col: Column, rules: Iterable[Mapping], kind: DataType | None = None, ladder_rules: int = LADDER_RULES) -> Column:
    """Outcome of the first rule that holds; ``kind`` is the column's type, if it is known."""
    ordered = sorted(rules, key=lambda r: r["ord"])
    if len(ordered) > ladder_rules and isinstance(kind, NumericType) and (line := number_line(ordered)) is not None:
        return search_column(col, *line)
    return ladder([(rule_condition(col, r), F.lit(float(r["out"]))) for r in ordered])


def _staged(df: DataFrame, rules: Sequence[Mapping], stage: str, keep: Sequence[str]) -> DataFrame:
    by_feature: dict[str, list[Mapping]] = {}
    for rule in rules:
        if rule["stage"] == stage:
            by_feature.setdefault(rule["feature"], []).append(rule)
    encoded = [
        rule_column(F.col(f.name), by_feature[f.name], f.dataType).alias(f.name)
        for f in df.schema.fields
        if f.name not in keep and f.name in by_feature
    ]
    return df.select(*keep, *encoded)


def woe_encode(df: DataFrame, rules: Sequence[Mapping], keep: Sequence[str]) -> DataFrame:
    """Value -> bin -> WOE. Features without rules are dropped, columns in ``keep`` pass through."""
    return _staged(_staged(df, rules, "bin", keep), rules, "woe", keep)


def unmatched_values(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """feature, stage, unmatched: values, nulls included, that no rule of a stage matched.

    A value without a bin is counted at the bins, and as a null at the WOE rules if these do not
    match null. The encoding is counted where it is made, without another pass over the rows.
    """
    binned = _staged(df, rules, "bin", [])
    names = binned.columns
    both = binned.select(*[F.col(c).alias(f"{c}_bin") for c in names], *names)
    both = _staged(both, rules, "woe", [f"{c}_bin" for c in names])
    counts = {(c, "bin"): f"{c}_bin" for c in names} | {(c, "woe"): c for c in both.columns if c in names}
    row = both.agg(*[F.count_if(F.col(column).isNull()).alias(f"n{i}") for i, column in enumerate(counts.values())])
    entries = [
        F.struct(F.lit(feature).alias("feature"), F.lit(stage).alias("stage"), F.col(f"n{i}").alias("unmatched"))
        for i, (feature, stage) in enumerate(counts)
    ]
    return row.select(F.inline(F.array(*entries)))


def logistic(coef: Mapping[str, float], suffix: str = "") -> Column:
    """Probability of a fitted logistic model as a column expression."""
    terms = [F.lit(float(b)) * F.col(name + suffix) for name, b in coef.items() if name != INTERCEPT]
    linear = reduce(Column.__add__, terms, F.lit(float(coef.get(INTERCEPT, 0.0))))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-linear))


def score(df: DataFrame, coef: Mapping[str, float], out: str = "pd", suffix: str = "") -> DataFrame:
    return df.withColumn(out, logistic(coef, suffix))


def score_with_model(df: DataFrame, assembler: Transformer, model: Model, out: str = "pd") -> DataFrame:
    """Score with a saved assembler and regression model."""
    predicted = model.transform(assembler.transform(df))
    return predicted.withColumnRenamed("prediction", out).drop("features")


def pack_json(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """The other columns first, then ``cols`` as one JSON object; null fields are left out of it."""
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, F.to_json(F.struct(*cols)).alias(out))


def scored_clients(
    daily: DataFrame, accounts: DataFrame, anchor: str, rules: Sequence[Mapping], coef: Mapping[str, float]
) -> DataFrame:
    """Sample with raw features, WOE values (suffix ``_woe``), ``pd`` and ``logodds``.

    Raw, encoded and scored values stay on one row, so nothing is joined back. Clients in segment
    ``xdpd`` keep their probability but get no log-odds.
    """
    every = {**delinquency_spec(), **disbursement_spec()}
    features = loan_features(daily, anchor, {f: every[f] for f in MODEL_FEATURES})
    sample = attach(build_sample(accounts, anchor), [features], ["client_no", "pt_date"])
    sample = fill_sentinels(sample, 0, None, MODEL_FEATURES)
    raw = [F.col(f).alias(f"{f}_raw") for f in MODEL_FEATURES]
    kept = ["client_no", "pt_date", "mob", "seg_obs", *[f"{f}_raw" for f in MODEL_FEATURES]]
    encoded = woe_encode(sample.select("*", *raw), rules, kept)
    scored = score(encoded, coef)
    return scored.select(
        "client_no",
        "pt_date",
        "mob",
        "seg_obs",
        "pd",
        null_where(F.col("seg_obs") == "xdpd", log_odds(F.col("pd"))).alias("logodds"),
        *[F.col(f).alias(f"{f}_woe") for f in MODEL_FEATURES if f in encoded.columns],
        *[F.col(f"{f}_raw").alias(f) for f in MODEL_FEATURES],
    )


def loan_score(
    daily: DataFrame, accounts: DataFrame, anchor: str, rules: Sequence[Mapping], coef: Mapping[str, float]
) -> DataFrame:
    """Score table of one month: keys, score, number of clients, and all features packed as JSON."""
    scored = scored_clients(daily, accounts, anchor, rules, coef)
    # The left join keeps the rows of the sample, so counting the sample is enough.
    total = build_sample(accounts, anchor).agg(F.count(F.lit(1)).alias("client_count"))
    packed = [c for c in scored.columns if c.startswith("ft_")]
    out = scored.crossJoin(F.broadcast(total)).withColumns(
        {
            "offline_score_date": F.lit(as_date(anchor).isoformat()),
            "pt_date": F.lit(month_end(anchor).isoformat()),
        }
    )
    fixed = ["client_no", "pd", "logodds", "offline_score_date", "client_count", "pt_date"]
    return pack_json(out.select(*fixed, *packed), packed, "features")
