"""Geometry of pages and images, and progress figures, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cover(width: Column, height: Column, page_area: Column) -> Column:
    """Share of the page that an image takes; 0 for a page without area."""
    return F.when(page_area > 0, width * height / page_area).otherwise(F.lit(0.0))


def scan_to_points(pixel: Column, zoom: Column) -> Column:
    return pixel / zoom


def image_to_points(low: Column, high: Column, pixel: Column, size: Column) -> Column:
    """Place on the page of a pixel of an image that fills low..high; null where the image has no extent."""
    return F.when(low.isNotNull() & high.isNotNull() & (high != low) & (size != 0), F.bround(low + pixel / size * (high - low), 2))


def rescaled(pixel: Column, scale: Column) -> Column:
    return F.bround(pixel / scale).cast("int")


def resize_ratio(width: Column, height: Column) -> Column:
    """Large images shrink to 1800 pixels, small ones grow to 1000; others keep their size."""
    longest, shortest = F.greatest(width, height), F.least(width, height)
    return F.when((longest > 2000) & (width >= 1000), 1800 / longest).when((longest < 600) & (shortest > 50), 1000 / longest).otherwise(F.lit(1.0))


def border(size: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(size * 0.008).cast("int"))


def header_band(height: Column) -> Column:
    """struct(height, offset) of the strip at the top that is read again; null if it is under 60 pixels."""
    band = F.least(F.floor(height * 0.16).cast("int"), F.lit(380))
    return F.when(band >= 60, F.struct(band.alias("height"), F.floor(height * 0.012).cast("int").alias("offset")))


def progress(done: Column, total: Column) -> Column:
    return (15 + F.floor(65 * done / total)).cast("int")


def clamped(percent: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(percent, F.lit(0))))


def percent(confidence: Column) -> Column:
    return F.floor(confidence * 100 + 0.5).cast("int")


def pages_per_second(pages: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, F.round(pages / seconds, 2)).otherwise(F.lit(0.0))
