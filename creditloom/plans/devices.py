"""Device features: platform normalisation, last record, period averages, distinct devices, price."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.columns import (
    NO_CATEGORY,
    NO_VALUE,
    NOT_ON_THIS_OS,
    any_in_list,
    keep_if_le,
    map_codes,
    member_flag,
    null_count,
    ratio,
    to_int,
)
from creditloom.functions.dates import days_ago, from_epoch_ms
from creditloom.functions.packed import (
    battery_part,
    boot_date,
    bytes_to_gib,
    count_char,
    item,
    screen_width,
    storage_gib,
    version_number,
)
from creditloom.operators.aggregates import distinct_rows, entity_windows, window_totals
from creditloom.operators.joins import attach_one, lookup, onto_population
from creditloom.operators.projections import add_prefix, days_ago_window, fill_sentinels, require_keys
from creditloom.operators.windows import dedup, first_per_key

# Operating system names in the raw log.
ANDROID = ["android"]
IOS = ["iOS", "iPadOS"]

# Battery status codes by platform.
IOS_BATTERY = {1: "not_charging", 2: "charging", 3: "fully_charged"}
ANDROID_BATTERY = {2: "charging", 3: "not_charging", 4: "not_charging", 5: "fully_charged"}

# SIM states that mean a usable card.
SIM_READY = ["LOADED", "READY"]

# Scenes of logins, onboarding and drawdown in the action log.
SCENES = [1001, 1061, 1072, 1073, 1074, 1091, 1092, 1145, 1151, 1153, 1156]

#: Parts of a device's records, by collection time.
SLOTS = 16

PERIOD_COLUMNS = ["total_storage", "used_storage", "app_name", "battery_level", "battery_status"]
WINDOWS = (30, 90, 180, 360)


@dataclass(frozen=True)
class DeviceLists:
    """Value lists behind the generated flags; keys become column names."""

    app_names: Mapping[str, Sequence[str]] = field(default_factory=dict)
    networks: Mapping[str, Sequence[str]] = field(default_factory=lambda: {"network_is_wifi": ["wifi"]})
    carriers: Mapping[str, Sequence[str]] = field(default_factory=dict)
    manufacturers: Mapping[str, str] = field(default_factory=dict)


def slot_of(slots: int) -> Column:
    return F.pmod(F.xxhash64("collection_time"), F.lit(slots))


def raw_devices(raw: DataFrame, anchor: str, days: int = 360, slots: int = SLOTS) -> DataFrame:
    """Records of the last ``days`` partitions collected by the anchor, one per device and time.

    Copies share a slot of the collection time, and rows are dealt out by device and slot, so that
    ``last_and_averages`` finds them where it needs them.
    """
    first = F.date_format(F.date_sub(F.lit(anchor).cast("date"), days - 1), "yyyy-MM-dd")
    kept = raw.where(
        (F.col("pt_date") <= anchor)
        & (F.col("pt_date") >= first)
        & (F.to_date("collection_time") <= F.lit(anchor).cast("date"))
    ).drop("pt_date")
    dealt = kept.withColumn("_slot", slot_of(slots)).repartition("device_id", "_slot")
    return dedup(dealt, ["device_id", "_slot", "collection_time"], [F.xxhash64(*kept.columns)]).drop("_slot")


def normalise_devices(raw: DataFrame, anchor: str, lists: DeviceLists) -> DataFrame:
    """One schema for Android and iOS records; other systems are dropped.

    Each output column picks its rule by the row's system, so the raw records are read once and
    no halves are united. A column that a system does not have holds -999997.
    """
    rows = raw.where(F.col("os").isin(ANDROID + IOS))
    is_ios = F.col("os").isin(IOS)

    def by_os(android: Column, ios: Column) -> Column:
        return F.when(is_ios, ios).otherwise(android)

    absent = F.lit(NOT_ON_THIS_OS)
    network_list = F.split("android_network_type", ",")
    carrier_list = F.split("android_carrier", ",")
    android_total, android_used = storage_gib(F.col("android_internal_storage"), 2), storage_gib(
        F.col("android_internal_storage"), 3
    )
    ios_total, ios_free = (F.col(c).try_cast("double") for c in ("ios_total_storage", "ios_free_storage"))
    app = map_codes_by_list(F.col("app_name"), lists.app_names)
    version = version_number(by_os(F.col("android_app_ver"), F.col("ios_app_ver")))

    columns: dict[str, Column] = {
        "device_id": F.col("device_id"),
        "os": F.col("os"),
        "model": F.col("model"),
        "app_name": app,
        "collection_time": F.col("collection_time"),
        "android_os_ver": by_os(to_int(F.col("android_os_ver_int")), absent),
        "ios_os_ver": by_os(absent, to_int(item(F.col("os_ver"), r"\.", 0))),
        "is_jailbreak": by_os(
            F.coalesce(map_codes(F.col("is_jailbreak"), {"true": 1, "false": 0}), F.lit(0)),
            F.when(count_char(F.col("is_jailbreak"), "1") >= 2, 1).otherwise(0),
        ),
        "is_sim_card": by_os(
            any_in_list(F.split("android_sim_card", ","), SIM_READY, lower=False),
            F.coalesce(to_int(F.col("ios_is_sim_card")), F.lit(0)),
        ),
        "is_vpn_connected": by_os(
            F.when(F.col("android_vpn").isNull(), 0).otherwise(1),
            F.coalesce(to_int(F.col("ios_is_vpn_connected")), F.lit(0)),
        ),
        "days_from_boot": days_ago(
            by_os(from_epoch_ms(F.col("android_boot_time")), boot_date(F.col("ios_resume_boot_time"))), anchor
        ),
        "total_storage": by_os(android_total, bytes_to_gib(ios_total)),
        "used_storage": by_os(
            keep_if_le(android_used, android_total),
            bytes_to_gib(F.when(ios_free <= ios_total, ios_total - ios_free)),
        ),
        "battery_level": by_os(to_int(F.col("android_battery_level")), battery_part(F.col("ios_battery"), 0)),
        "battery_status": by_os(
            map_codes(to_int(F.col("android_battery_status")), ANDROID_BATTERY),
            map_codes(battery_part(F.col("ios_battery"), 1), IOS_BATTERY),
        ),
        "screen_width": screen_width(by_os(F.col("android_screen"), F.col("ios_screen"))),
        "brand": by_os(F.lower("android_brand"), F.lit("apple")),
        "android_cpu_count": by_os(to_int(F.col("android_cpu_count")), absent),
        "android_is_emulator": by_os(map_codes(F.col("android_is_emulator"), {"true": 1, "false": 0}), absent),
        "ios_memory": by_os(absent.cast("double"), bytes_to_gib(F.col("ios_memory"))),
    }
    for name, values in lists.networks.items():
        columns[name] = by_os(
            any_in_list(network_list, values, "keep"), member_flag(F.lower("ios_network_type"), values, "keep")
        )
    for name, values in lists.carriers.items():
        columns[name] = by_os(any_in_list(carrier_list, values), member_flag(F.lower("ios_carrier"), values))
    for name, value in lists.manufacturers.items():
        columns[name] = by_os(F.when(F.lower("android_manufacturer") == value, 1).otherwise(0), absent)
    for name in lists.app_names:
        columns[f"{name}_app_ver"] = F.when(app == name, version)
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def map_codes_by_list(col: Column, lists: Mapping[str, Sequence[str]]) -> Column:
    """Key of the first list that contains the value."""
    out: Column | None = None
    for name, values in lists.items():
        hit = col.isin(list(values))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(None).cast("string") if out is None else out


def client_devices(actions: DataFrame, anchor: str, days: int = 360, part: str | None = None) -> DataFrame:
    """Distinct (client, device, days ago) of successful actions in the look-back window."""
    ok = require_keys(actions, ["device_id", "client_no"]).where(
        F.col("scene_code").isin(SCENES) & (F.col("action_status") == "1")
    )
    recent = days_ago_window(
        ok, from_epoch_ms(F.col("action_timestamp")), anchor, days, out="days_from_operation", part=part
    )
    return distinct_rows(recent, ["client_no", "device_id", "days_from_operation"])


def latest_price(price: DataFrame) -> DataFrame:
    """Price of the latest date per model and brand; the lower price wins a tie."""
    order = [F.col("grass_date").desc_nulls_last(), F.col("price_usd_median").asc_nulls_last()]
    return first_per_key(price, ["model", "brand"], order)


def period_values(lists: DeviceLists) -> dict[str, Column]:
    """What is averaged over all records of a device; a share is the average of a 0/1 flag."""

    def among(hit: Column, known: Column) -> Column:
        return F.when(hit, 1).when(known.isNotNull(), 0)

    values = {
        "avg_used_storage": F.col("used_storage"),
        "avg_total_storage": F.col("total_storage"),
        "avg_used_storage_ratio": ratio(F.col("used_storage"), F.col("total_storage")),
        "battery_level_ge_90_ratio": among(F.col("battery_level") >= 90, F.col("battery_level")),
        "battery_charging_ratio": among(F.col("battery_status").isin("charging", "fully_charged"), F.col("battery_status")),
        "network_wifi_ratio": F.col("network_is_wifi"),
    }
    flags = {f"trigger_app_{name}_ratio": among(F.col("app_name") == name, F.col("app_name")) for name in lists.app_names}
    return values | flags


def last_and_averages(devices: DataFrame, values: Mapping[str, Column], slots: int = SLOTS) -> DataFrame:
    """The last record of each device with the device's averages of ``values``.

    The last record has the latest day, then the fewest nulls, then the latest time. Records are
    reduced to one per device and slot of the collection time, each with the sums and counts of its
    slot, and these to one per device: no task holds more than a slot of a device that fills much of
    the log, and strings ride along in the rows, so nothing is sorted to be aggregated.
    """
    nulls = null_count([F.col(c) for c in devices.columns])
    rows = devices.withColumns(
        {"_day": F.to_date("collection_time"), "_nulls": nulls, "_digest": F.xxhash64(*devices.columns), "_slot": slot_of(slots)}
    )
    newest = [F.desc("_day"), F.asc("_nulls"), F.desc("collection_time"), F.desc("_digest")]
    parts = {f"_sum_{n}": F.sum(v) for n, v in values.items()} | {f"_n_{n}": F.count(v) for n, v in values.items()}
    again = {name: F.sum(name) for name in parts}
    for keys, sums in ((["device_id", "_slot"], parts), (["device_id"], again)):
        group = Window.partitionBy(*keys)
        rank = F.row_number().over(group.orderBy(*newest))
        rows = rows.withColumns({"_rank": rank} | {n: total.over(group) for n, total in sums.items()}).where("_rank = 1")
    averages = [F.try_divide(F.col(f"_sum_{n}").cast("double"), F.col(f"_n_{n}")).alias(n) for n in values]
    return rows.select(*devices.columns, *averages)


def device_table(devices: DataFrame, price: DataFrame, anchor: str, lists: DeviceLists, period_prefix: str) -> DataFrame:
    """One row per device: last record (``last_*``), period averages and last known price."""
    values = period_values(lists)
    per_device = last_and_averages(devices, values)
    before = f"{period_prefix}_" if period_prefix else ""
    state = [c for c in devices.columns if c not in ["device_id", *PERIOD_COLUMNS]]
    kept = sorted(set(state) - {"model", "brand", "collection_time"})
    wide = per_device.select(
        "device_id",
        "model",
        "brand",
        *[F.col(c).alias(f"last_{c}") for c in kept],
        days_ago(F.col("collection_time"), anchor).alias("last_days_from_collection"),
        *[F.col(c).alias(before + c) for c in values],
    )
    prices = latest_price(price).withColumnRenamed("price_usd_median", "last_price_usd")
    return lookup(wide, prices, ["model", "brand"], ["last_price_usd"]).drop("model", "brand")


def client_activity(used: DataFrame, key: str, windows: Sequence[int]) -> DataFrame:
    """Per client: last device and its age, span of activity, distinct devices per window.

    All come from one roll-up per (client, device), so the action log is read once.
    """
    age = "days_from_operation"
    last = F.min(F.struct(F.col("youngest"), F.col("device_id"))).alias("last")
    span = (F.max("oldest") - F.min("youngest")).alias(f"operation_duration_{max(windows)}d")
    per_client = (
        entity_windows(used, key, "device_id", age, windows)
        .groupBy(key)
        .agg(last, span, *window_totals(windows, "distinct_device_cnt"))
    )
    return per_client.withColumns(
        {"device_id": F.col("last.device_id"), f"last_{age}": F.col("last.youngest")}
    ).drop("last")


def device_features(
    raw: DataFrame,
    price: DataFrame,
    anchor: str,
    lists: DeviceLists,
    key: str = "device_id",
    actions: DataFrame | None = None,
    population: DataFrame | None = None,
    windows: Sequence[int] = WINDOWS,
    part: str | None = None,
) -> DataFrame:
    """Device features by ``device_id``, or by ``client_no`` through the client's last device.

    A client has one last device, so averaging the device first and attaching the result gives
    the client's averages without repeating device records per client.
    """
    devices = normalise_devices(raw_devices(raw, anchor, max(windows)), anchor, lists)
    if key == "device_id":
        out = device_table(devices, price, anchor, lists, "")
    else:
        table = device_table(devices, price, anchor, lists, "last")
        used = client_devices(actions, anchor, max(windows), part)
        activity = client_activity(used, key, windows)
        out = attach_one(activity, table, ["device_id"]).drop("device_id")
    out = fill_sentinels(add_prefix(out, "device", [key]), NO_VALUE, None)
    out = fill_sentinels(out, None, NO_CATEGORY, ["device_last_os"])
    return out if population is None else onto_population(population, out, key)
