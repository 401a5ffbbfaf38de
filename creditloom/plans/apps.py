"""Counts of risky apps from the raw device message log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.dates import as_date, clamp_anchor
from creditloom.functions.packed import app_package
from creditloom.operators.aggregates import tag_counts
from creditloom.operators.joins import tag_in_list
from creditloom.operators.windows import latest_snapshot

# First partition of the log, and the kind of message that lists apps.
LOG_START = "2024-03-07"
MESSAGE_KIND = "device-security"

# Package names of lending apps.
LENDING_APPS = [
    "com.jk.opeso.plus", "ph.lhl.pautangpeso", "com.perabag.app", "ph.cashmore.loan",
    "ooifxdso.opxosduf.oqexred", "tech.codeblock.okpeso", "com.diyi.snapera", "ph.robocash.mobile",
    "ph.loans.mobile", "com.peranyo.cash.personal.loan.credit.peso.fast.lend.easy.quick.borrow.online.ph",
    "com.PondoCash.www", "u.money.spend", "ph.zippeso.online.cash.loan", "com.lanhai.upesocash",
    "com.ncvi.cebxpress", "com.tmart.pesoq", "com.shuiyiwenhua.gl", "com.pesokuwento.ph", "com.taga.cash",
    "ph.fast.lending", "com.pesohere.phk", "com.juanhand.fast.cash.peso.loan.app", "com.peramoo",
    "com.linkcredited.ipeso", "com.yyjg.gp", "com.wow.pera", "com.honey.loan",
    "com.clearmindai.ussc.panalowallet", "com.robofinance.unacash", "com.SurityCash.hxov",
    "com.happyperatwo.app", "com.u5.e_perash", "com.myloan.pesocash", "com.plentina.app", "com.pesoloan",
    "com.andsystems.lendpinoy", "loanchamp.com.loanchamp", "com.spendcash.cash.ph",
    "org.cashbee.quasar.app", "com.hpera.app", "hb.xinxinxr.vip", "hb.xinxin.xiangrong",
    "com.linkcredited.pesoin", "ph.moneycat", "com.suncash.loan", "pppi.earth.pinoylend",
    "com.peso24h.philippine", "www.swip.pera", "ph.cashme666.android", "com.vpeso.borrow.loan.app",
    "com.finstar.loan.app", "com.qzflb.bigloan", "com.loan.yopeso.app.yopeso",
    "ph.onlineloans.mobile.android", "com.fincredit.sdthrsh", "tech.codeblock.kpeso",
    "com.abs.pesobuffet.android", "com.flb.cashbox", "com.pesoonline", "com.mocamoca",
    "com.fclc.cashcowdwd",
]

MESSAGE_SCHEMA = "deviceId string, deviceInfo struct<os: string, apps: array<string>>"


def parse_messages(log: DataFrame) -> DataFrame:
    """device_id, os, apps and pt_date of the usable messages.

    The parsed message passes through an explode of at most one element. A plain filter on its
    fields would be pushed below the projection, and every field test would parse the JSON again.
    """
    parsed = log.where(F.col("pt_biz") == MESSAGE_KIND).select(F.from_json("message", MESSAGE_SCHEMA).alias("m"), "pt_date")
    device, info = F.col("m.deviceId"), F.col("m.deviceInfo")
    usable = device.isNotNull() & info["os"].isNotNull() & info["apps"].isNotNull()
    once = parsed.select(F.explode(F.when(usable, F.array("m"))).alias("m"), "pt_date")
    return once.select(device.alias("device_id"), info["os"].alias("os"), info["apps"].alias("apps"), "pt_date")


def app_entries(messages: DataFrame) -> DataFrame:
    """One row per listed app; a device with an empty list has none."""
    entries = messages.select("device_id", F.explode("apps").alias("entry"), "pt_date")
    return entries.select("device_id", app_package(F.col("entry")).alias("app_id"), "pt_date")


def scan_messages(log: DataFrame, anchor: str, as_of: str, days: int = 360, floor: str | None = LOG_START) -> DataFrame:
    first, last = clamp_anchor(anchor, as_of, days, floor)
    return log.where((F.col("pt_date") >= first) & (F.col("pt_date") <= last))


def history_start(anchor: str, as_of: str, days: int) -> Column:
    """First day of the history window, counted back from the clamped anchor."""
    last = as_date(clamp_anchor(anchor, as_of, days)[1])
    return F.date_format(F.date_sub(F.lit(last), days), "yyyy-MM-dd")


def app_features(
    log: DataFrame,
    anchor: str,
    as_of: str,
    risk_apps: Sequence[str] | DataFrame = LENDING_APPS,
    scan_days: int = 360,
    history_days: int = 720,
    floor: str | None = LOG_START,
) -> DataFrame:
    """Per device the risky apps of its latest list and of all lists in the history window.

    Apps that are not risky matter only as proof that a list existed, so they become one null
    item per device, and map-side aggregation reduces a list to its risky apps before anything is
    shuffled. What is left are three small aggregates over fixed-width days: last day per
    (device, app), risky apps per (device, day), and both counts per device.
    """
    entries = app_entries(parse_messages(scan_messages(log, anchor, as_of, scan_days, floor)))
    tagged = tag_in_list(entries, "app_id", risk_apps, "risk_tag")
    reduced = tagged.select(
        "device_id", F.when(F.col("risk_tag") == 1, F.col("app_id")).alias("risky"), F.col("pt_date").cast("date").alias("day")
    )
    last_seen = reduced.groupBy("device_id", "risky").agg(F.max("day").alias("last_day"))
    per_day = last_seen.groupBy("device_id", "last_day").agg(F.count("risky").alias("n"))
    recent = F.col("last_day") >= history_start(anchor, as_of, history_days).cast("date")
    return per_day.groupBy("device_id").agg(
        F.max_by("n", "last_day").alias("app_latest_lending_cnt"),
        F.sum(F.when(recent, F.col("n")).otherwise(0)).alias("app_historical_lending_cnt"),
    )


def app_features_stepwise(entries: DataFrame, risk_apps: Sequence[str] | DataFrame, since: str) -> DataFrame:
    """The same counts from the separate operators; used to check ``app_features``."""
    rows = entries.withColumn("pt_date", F.col("pt_date").cast("date")).distinct()
    latest = tag_in_list(latest_snapshot(rows, "device_id", "pt_date", "app_id"), "app_id", risk_apps, "risk_tag")
    history = tag_in_list(
        rows.where(F.col("pt_date") >= since).select("device_id", "app_id").distinct(), "app_id", risk_apps, "risk_tag"
    )
    counts = tag_counts(latest, "device_id", "risk_tag", "app_latest_lending_cnt")
    past = tag_counts(history, "device_id", "risk_tag", "app_historical_lending_cnt")
    return counts.join(past, "device_id", "left").fillna(0)
