"""Rectangles as structs <page, x0, y0, x1, y1>, top-left origin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(page: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """A rectangle from a corner and its sides, which may be negative."""
    return F.struct(
        page.cast("int").alias("page"),
        F.least(x, x + width).alias("x0"),
        F.least(y, y + height).alias("y0"),
        F.greatest(x, x + width).alias("x1"),
        F.greatest(y, y + height).alias("y1"),
    )


def from_bottom(top: Column, page_height: Column) -> Column:
    """A vertical position measured from the bottom, as one from the top."""
    return page_height - top


def overlap(a: Column, b: Column) -> Column:
    """Whether two rectangles of a page share area; touching edges do not."""
    return (a["page"] == b["page"]) & (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def covered(a: Column, b: Column) -> Column:
    """The share of ``a``'s area that ``b`` covers; 0 for boxes without area."""
    wide = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    high = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    return F.when((a["page"] == b["page"]) & (area > 0), wide * high / area).otherwise(F.lit(0.0))


def coordinates(raw: Column) -> Column:
    """``page,x,y,w,h;...`` as an array of boxes; parts that are not five numbers are left out."""
    parts = F.transform(F.split(raw, ";"), lambda p: F.transform(F.split(p, ","), lambda n: n.try_cast("double")))
    good = F.filter(parts, lambda p: (F.size(p) == 5) & F.forall(p, lambda n: n.isNotNull()))
    return F.transform(good, lambda p: box(p[0], p[1], p[2], p[3], p[4]))
