"""Labels of methods and noise levels, read from folder names."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

_NOISE = "noise_([0-9.]+)cm_([0-9.]+)deg"


def method_name(folder: Column) -> Column:
    """What remains of a folder name without prefix and digits, noise suffix and clean suffix."""
    name = F.regexp_replace(folder, "^[A-Za-z_]*[0-9]+_", "")
    return F.regexp_replace(F.regexp_replace(name, f"_{_NOISE}$", ""), "_clean$", "")


def _number(folder: Column, group: int) -> Column:
    return F.nullif(F.regexp_extract(folder, _NOISE, group), F.lit("")).try_cast("double")


def noise_cm(folder: Column) -> Column:
    """Position noise in cm; null for a folder without."""
    return _number(folder, 1)


def noise_deg(folder: Column) -> Column:
    return _number(folder, 2)


def folder_seconds(folder: Column) -> Column:
    """The first run of ten digits or more, as seconds; null for none (the reference then takes the present)."""
    return F.nullif(F.regexp_extract(folder, "([0-9]{10,})", 1), F.lit("")).try_cast("bigint")


def display_label(folder: Column, among: WindowSpec) -> Column:
    """Method and noise; clean ones say so only if one of the window is not clean."""
    method, cm = method_name(folder), noise_cm(folder)
    all_clean = F.bool_and(cm.isNull()).over(among)
    return F.when(cm.isNotNull(), F.concat(method, F.lit(" ("), cm.cast("string"), F.lit("cm)"))).when(all_clean, method).otherwise(F.concat(method, F.lit(" (clean)")))


def noise_tag(pos_m: Column, rot_deg: Column) -> Column:
    tag = F.format_string("noise_%.3fcm_%.3fdeg", pos_m * 100, rot_deg)
    return F.when((pos_m > 0) | (rot_deg > 0), tag).otherwise("clean")
