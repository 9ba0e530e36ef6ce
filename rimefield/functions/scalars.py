"""Scalar expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

SUMMER, WINTER = [6, 7, 8], [12, 1, 2]


def decimal_year(t: Column) -> Column:
    return (F.year(t) + (F.dayofyear(t) - 1) / F.lit(365.25)).cast("float")


def obs_sigma(rms: Column, slope: float = 0.41844, intercept: float = -0.005, floor: float = 1e-4) -> Column:
    return F.greatest(rms * slope + intercept, F.lit(floor))


def season(t: Column) -> Column:
    return F.when(F.month(t).isin(SUMMER), "summer").when(F.month(t).isin(WINTER), "winter")


def percent_of_median(value: Column, median: Column) -> Column:
    return F.when(median > 0, value / median * 100)


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:8]


def year_from_name(name: Column) -> Column:
    return F.expr("try_cast(regexp_extract({}, '(20[0-9]{{2}}|19[0-9]{{2}})', 1) as int)".format("name")) if isinstance(name, str) else F.regexp_extract(name, r"(20\d{2}|19\d{2})", 1).try_cast("int")
