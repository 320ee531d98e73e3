"""Features of a source element and a candidate as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column, distinct: bool = False) -> Column:
    """Of two arrays as sets; 0 where both are empty. Arrays that are `distinct`, without repeats, are compared once: what b has and a has not tells the rest."""
    if distinct:
        more = F.size(F.array_except(b, a))
        return F.coalesce(F.try_divide(F.size(b) - more, F.size(a) + more), F.lit(0.0))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def text_overlap(a: Column, b: Column) -> Column:
    return jaccard(F.split(a, " "), F.split(b, " "))


def edit_likeness(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; for short labels."""
    return F.coalesce(1 - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), F.lit(1.0))


def id_parts(a: Column) -> Column:
    """Parts of a resource id between _ / : #; splitting at one sign needs no regular expression, and replacing one no table of signs."""
    for sign in "/:#":
        a = F.replace(a, F.lit(sign), F.lit("_"))
    return F.split(a, "_")


def id_overlap(a: Column, b: Column) -> Column:
    """Of resource ids: their parts between _ / : #."""
    return jaccard(id_parts(a), id_parts(b))


def same(a: Column, b: Column) -> Column:
    """1 where equal, 0 where not or unknown; for classes and action flags."""
    return F.coalesce((a == b).cast("double"), F.lit(0.0))


def normalized(value: Column, size: Column) -> Column:
    return F.try_divide(value, size)


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (x1 - x0) * (y1 - y0)


def aspect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.try_divide(x1 - x0, y1 - y0)


def region(x0: Column, y0: Column, x1: Column, y1: Column, cells: int = 3) -> Column:
    """Number of the grid cell that holds the center of a normalized box, row by row."""
    cell = lambda a, b: F.least(F.floor((a + b) / 2 * cells), F.lit(cells - 1))
    return (cell(y0, y1) * cells + cell(x0, x1)).cast("int")


def inside(x: Column, y: Column, box: Column) -> Column:
    return x.between(box["x0"], box["x1"]) & y.between(box["y0"], box["y1"])


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes."""
    width = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    height = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    both = width * height
    each = [area(*(box[c] for c in ("x0", "y0", "x1", "y1"))) for box in (a, b)]
    return F.coalesce(F.try_divide(both, each[0] + each[1] - both), F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    """Between two points (arrays)."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: F.pow(p - q, 2)), F.lit(0.0), lambda s, v: s + v))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def visible(bounds: Column, width: Column, height: Column) -> Column:
    """Whether a box (array of corners) has an area and lies at least in part on a screen of that size."""
    x0, y0, x1, y1 = (F.get(bounds, i) for i in range(4))
    return F.coalesce((x1 > x0) & (y1 > y0) & (x0 < width) & (y0 < height) & (x1 > 0) & (y1 > 0), F.lit(False))


def actionable(clickable: Column, editable: Column, scrollable: Column) -> Column:
    """Whether any flag is set; flags that are not known are not."""
    return F.coalesce(clickable, F.lit(False)) | F.coalesce(editable, F.lit(False)) | F.coalesce(scrollable, F.lit(False))
