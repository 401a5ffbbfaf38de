"""Decoders for values packed into strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditloom.functions.columns import to_int

GIB = 1073741824.0


def item(col: Column, separator: str, index: int) -> Column:
    """Item of a separated list (``separator`` is a regex); null when the list is too short."""
    return F.get(F.split(col, separator), F.lit(index))


def version_number(col: Column) -> Column:
    """``a.b.c`` as ``a + b / 100``."""
    major, minor = (item(col, r"\.", i).try_cast("double") for i in (0, 1))
    return major + minor / F.lit(100.0)


def count_char(col: Column, char: str) -> Column:
    """Occurrences of one character."""
    return F.length(col) - F.length(F.replace(col, F.lit(char), F.lit("")))


def bytes_to_gib(col: Column) -> Column:
    return col.try_cast("double") / F.lit(GIB)


def storage_gib(col: Column, index: int) -> Column:
    """GiB of an item such as ``1073741824B`` in a comma list."""
    return bytes_to_gib(item(item(col, ",", index), "B", 0))


def battery_part(col: Column, index: int) -> Column:
    """``60%|2``: part 0 is the level, part 1 the status code."""
    return to_int(item(col, r"%\|", index))


def screen_width(col: Column) -> Column:
    return to_int(item(col, ",", 0))


def boot_date(col: Column) -> Column:
    """``x|epoch_seconds`` as a timestamp."""
    return F.timestamp_seconds(item(col, r"\|", 1).try_cast("bigint"))


def app_package(entry: Column) -> Column:
    """Package of an app entry ``name,package``; ``-x.y`` stands for ``com.x.y``."""
    package = item(entry, ",", 1)
    return F.when(package.startswith("-"), F.concat(F.lit("com."), F.substr(package, F.lit(2)))).otherwise(package)
