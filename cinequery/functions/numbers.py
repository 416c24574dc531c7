"""Vectors, hashes, times and shares as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """At unit length; a zero vector stays as it is."""
    values = a.cast("array<double>")
    # The length is bound by a one-element array: inside the inner lambda it would be worked out for every element.
    scaled = F.transform(F.array(norm(a)), lambda n: F.transform(values, lambda x: F.when(n > 0, x / n).otherwise(x)))
    return scaled[0]


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of up to 16 hexadecimal digits, compared as two 32-bit halves."""
    half = lambda x, at: F.conv(F.substring(F.lpad(x, 16, "0"), at, 8), 16, 10).cast("long")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def keyframe_id(video: Column, frame: Column) -> Column:
    return F.format_string("%s_%06d", video, frame)


def frame_time_ms(pts: Column, time_base: Column, frame: Column, fps: Column) -> Column:
    """Exact decimal time, half to even: from ``pts`` and ``time_base`` ("1/12800"), else from the frame number and ``fps`` ("25" or "13219/500")."""
    part = lambda x, i: F.coalesce(F.try_element_at(F.split(x, "/"), F.lit(i)), F.lit("1")).cast("decimal(18,0)")
    by_pts = pts.cast("decimal(18,0)") * part(time_base, 1) * 1000 / part(time_base, 2)
    by_rate = frame.cast("decimal(18,0)") * part(fps, 2) * 1000 / part(fps, 1)
    return F.bround(F.coalesce(by_pts, by_rate), 0).cast("long")


def rank_share(rank: Column, k: float) -> Column:
    """What a place in a ranking adds to the fused score."""
    return F.lit(1.0) / (F.lit(float(k)) + rank)


def inverse_frequency(documents: Column, holding: Column) -> Column:
    return F.log(F.lit(1.0) + (documents - holding + 0.5) / (holding + 0.5))


def term_weight(frequency: Column, length: Column, average: Column, k1: float, b: float) -> Column:
    return frequency * (k1 + 1.0) / (frequency + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length / average))


def entropy_bits(share: Column) -> Column:
    """To be summed over a histogram's non-empty bins."""
    return -share * F.log2(share)


def box_share(edge: Column, size: Column) -> Column:
    """An edge of a box as a fraction of the picture, to 4 digits."""
    return F.bround(edge / size, 4)


def segment_ms(seconds: Column, track_start_ms: Column) -> Column:
    """Seconds of an audio track as milliseconds on the file's clock, half to even."""
    return F.bround(track_start_ms + seconds * 1000, 0).cast("long")
