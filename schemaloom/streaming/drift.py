"""A drift monitor: the profile of streamed documents per window, against a stored profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.operators import infer


def windowed_profile(stream: DataFrame, ts: str, json: str, length: str = "10 minutes", late: str = "5 minutes", depth: int = 8) -> DataFrame:
    """Counts of (window, path, atom); late documents within the watermark count, later ones do not.

    A stream cannot be unfolded again: what nests deeper than `depth` shows as
    the atoms object+ and array+ at the last level.
    """
    parsed = stream.withWatermark(ts, late).select(F.col(ts).alias("ts"), F.expr(f"try_parse_json({json})").alias("rec"))
    nodes = infer.paths_with(parsed, ["ts"], depth)
    return nodes.groupBy(F.window("ts", length).alias("window"), "path", "atom").agg(F.count(F.lit(1)).alias("n"))


def drift(profile: DataFrame, known: DataFrame) -> DataFrame:
    """Paths and atoms of a windowed profile that the stored one (path, atom) has not seen; known is metadata."""
    return profile.join(known.select("path", "atom"), ["path", "atom"], "left_anti")
