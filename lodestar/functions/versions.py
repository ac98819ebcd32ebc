"""Versions and affected ranges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(version: Column) -> Column:
    """A comparable struct: numbers, whether it is a release, and the pre-release tag.  A leading v and build data don't count."""
    core = F.regexp_extract(version, r"^[vV=]?\s*(\d+(?:\.\d+)*)", 1)
    pre = F.regexp_extract(version, r"^[vV=]?\s*\d+(?:\.\d+)*-?([0-9A-Za-z.-]*)", 1)
    numbers = F.transform(F.slice(F.concat(F.split(core, r"\."), F.array(F.lit("0"), F.lit("0"), F.lit("0"))), 1, 4), lambda x: F.coalesce(x.try_cast("long"), F.lit(0)))
    return F.struct(numbers.alias("numbers"), (pre == "").alias("release"), pre.alias("pre"))


def affected(version: Column, events: Column) -> Column:
    """Is ``version`` inside: the last of the sorted events at or before it decides.

    An introduced event turns the state on at its version, fixed turns it off from its
    version on, last_affected turns it off after its version; introduced goes first on ties.
    """
    at = lambda e: F.when(e["introduced"] == "0", F.lit("0.0.0")).otherwise(F.coalesce(e["introduced"], e["fixed"], e["last_affected"]))
    keyed = F.transform(events, lambda e: F.struct(parse(at(e)).alias("v"), F.when(e["introduced"].isNotNull(), 0).when(e["fixed"].isNotNull(), 1).otherwise(2).alias("kind")))
    v = parse(version)
    step = lambda on, e: F.when((e["kind"] == 0) & (v >= e["v"]), True).when((e["kind"] == 1) & (v >= e["v"]), False).when((e["kind"] == 2) & (v > e["v"]), False).otherwise(on)
    return F.aggregate(F.array_sort(keyed), F.lit(False), step)
