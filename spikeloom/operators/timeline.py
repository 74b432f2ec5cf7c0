"""From display frames and playlists to sections, trials and sectioned events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spikeloom.operators.joins import range_join

# Frames of padding around a movie, and the margins of its section.
PAD, PRE, POST = 180, 60, 120


def microseconds_to_samples(us: Column, rate: Column) -> Column:
    """Half-even rounding of ``us * rate / 1e6``."""
    return F.bround(us * rate / F.lit(1e6)).cast("long")


def section_frames(playlist: DataFrame, keys: list[str], position: str, length: str) -> DataFrame:
    """Running offsets over a playlist: adds ``offset, start_frame, end_frame``.

    A movie takes ``2 * PAD + length + 1`` frames; its section runs from PRE
    before the end of the padding to POST behind the movie. Movies without a
    known length are skipped, as if they weren't listed.
    """
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    known = playlist.where(F.col(length).isNotNull())
    offset = F.coalesce(F.sum(F.col(length) + (2 * PAD + 1)).over(w), F.lit(0)).cast("long")
    at = known.withColumn("offset", offset)
    return at.withColumn("start_frame", F.col("offset") + (PAD - PRE)).withColumn("end_frame", F.col("offset") + PAD + POST + F.col(length) + 1)


def trials(sections: DataFrame, start: str, repeat: Column, length: Column, first: Column, group_count: Column, gap: Column, out: str = "trial_start") -> DataFrame:
    """One row per trial: trial ``n`` starts at ``start + PRE + first + n * length + (n div repeat) * gap``; adds ``trial_idx``."""
    total = (repeat * F.coalesce(group_count, F.lit(1))).cast("int")
    each = sections.withColumn("trial_idx", F.explode(F.sequence(F.lit(0), total - 1)))
    n = F.col("trial_idx")
    return each.withColumn(out, F.col(start) + PRE + first + n * length + F.floor(n / repeat) * F.coalesce(gap, F.lit(0)))


def section_events(events: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, pre: float, post: float, width: float) -> DataFrame:
    """The interval join of events and trials with margins; a span's start isn't taken below 0. One event may lie in several trials."""
    wide = spans.withColumn("_s", F.greatest(F.lit(0.0), F.col(start) - pre)).withColumn("_e", F.col(end) + post)
    return range_join(events, wide, keys, at, "_s", "_e", width).drop("_s", "_e")


def nth(frames: DataFrame, keys: list[str], frame: str, sample: str) -> DataFrame:
    """The first and last known frame of each key, for clipping lookups."""
    return frames.groupBy(*keys).agg(F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.min(sample).alias("first_sample"), F.max(sample).alias("last_sample"))


def frame_to_sample(wanted: DataFrame, frames: DataFrame, keys: list[str], want: str, frame: str, sample: str) -> DataFrame:
    """Positional lookup of a frame's sample, clipped to the frames there are."""
    ends = nth(frames, keys, frame, sample)
    clipped = wanted.join(ends.select(*keys, "first_frame", "last_frame"), keys).withColumn("_f", F.least(F.greatest(F.col(want), F.col("first_frame")), F.col("last_frame")))
    look = frames.select(*keys, F.col(frame).alias("_f"), F.col(sample))
    return clipped.join(look, [*keys, "_f"], "left").drop("_f", "first_frame", "last_frame")


def onset_frames(signal: DataFrame, keys: list[str], idx: str, value: str, threshold: float, min_distance: int = 0) -> DataFrame:
    """Onsets of a stepped signal: local peaks of its difference above ``threshold``, reported at the sample before the step.

    Of peaks closer than ``min_distance`` the highest stays, of equal ones the
    first; that holds for peaks that aren't chained closer than it.
    """
    w = Window.partitionBy(*keys).orderBy(idx)
    d = signal.withColumn("_d", F.lead(value).over(w) - F.col(value))
    d = d.withColumn("_a", F.lag("_d").over(w)).withColumn("_b", F.lead("_d").over(w))
    peak = d.where((F.col("_d") >= threshold) & (F.coalesce(F.col("_a"), F.lit(float("-inf"))) < F.col("_d")) & (F.coalesce(F.col("_b"), F.lit(float("-inf"))) <= F.col("_d")))
    if min_distance:
        near = Window.partitionBy(*keys).orderBy(idx).rangeBetween(-min_distance + 1, min_distance - 1)
        peak = peak.withColumn("_top", F.max_by(F.col(idx), F.struct("_d", (-F.col(idx)).alias("i"))).over(near)).where(F.col("_top") == F.col(idx)).drop("_top")
    return peak.drop("_a", "_b").withColumnRenamed("_d", "rise")
