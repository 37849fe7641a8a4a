"""Column expressions over rectangles (structs x0, y0, x1, y1), matrices (six doubles), page boxes, paths and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x0, y0, x1, y1) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else F.lit(float(x))).cast("double").alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])


def overlaps(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def contains(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x0"]) & (a["y0"] <= b["y0"]) & (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"])


def inflate(a: Column, by: float) -> Column:
    return rect(a["x0"] - by, a["y0"] - by, a["x1"] + by, a["y1"] + by)


def union(a: Column, b: Column) -> Column:
    return rect(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def matrix_apply(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


def matrix_multiply(a: Column, b: Column) -> Column:
    """The matrix that does a first, then b."""
    return F.array(a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def matrix_invert(m: Column) -> Column:
    d = m[0] * m[3] - m[1] * m[2]
    ok = F.abs(d) > 1e-12
    return F.when(ok, F.array(m[3] / d, -m[1] / d, -m[2] / d, m[0] / d, (m[2] * m[5] - m[3] * m[4]) / d, (m[1] * m[4] - m[0] * m[5]) / d))


def turn(degrees: Column) -> Column:
    """A rotation as 0 to 359."""
    return F.pmod(degrees.cast("int"), F.lit(360))


def orientation(width: Column, height: Column) -> Column:
    return F.when(width == height, "Square").when(width > height, "Landscape").otherwise("Portrait")


def displayed_insets(rotate: Column, top: Column, right: Column, bottom: Column, left: Column) -> Column:
    """Margins as displayed, as insets of the unrotated page."""
    sides = lambda t, r, b, le: F.struct(t.alias("top"), r.alias("right"), b.alias("bottom"), le.alias("left"))
    return F.when(turn(rotate) == 90, sides(right, bottom, left, top)).when(turn(rotate) == 180, sides(bottom, left, top, right)).when(turn(rotate) == 270, sides(left, top, right, bottom)).otherwise(sides(top, right, bottom, left))


def visual_to_user(rotate: Column, box: Column, x: Column, y: Column) -> Column:
    """A point as displayed (from the lower left of the turned box) in the page's own space."""
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.when(turn(rotate) == 90, at(box["x1"] - y, box["y0"] + x)).when(turn(rotate) == 180, at(box["x1"] - x, box["y1"] - y)).when(turn(rotate) == 270, at(box["x0"] + y, box["y1"] - x)).otherwise(at(box["x0"] + x, box["y0"] + y))


def path_length(points: Column, closed: Column) -> Column:
    """Length of a path of structs (x, y); closed paths return to their start if they have over two points."""
    steps = F.zip_with(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), points, lambda b, a: F.coalesce(F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])), F.lit(0.0)))
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    back = F.sqrt((first["x"] - last["x"]) * (first["x"] - last["x"]) + (first["y"] - last["y"]) * (first["y"] - last["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda n, x: n + x) + F.when(closed & (F.size(points) > 2), back).otherwise(0.0)


def polygon_area(points: Column) -> Column:
    """Shoelace area of structs (x, y)."""
    after = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.abs(F.aggregate(F.zip_with(points, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda n, x: n + x)) / 2


def units_per_point(page_inches: Column, real_value: Column) -> Column:
    """Real units a point under a scale by which so many inches of a page stand for a real value; null unless both are positive."""
    return F.when((page_inches > 0) & (real_value > 0), real_value / (page_inches * 72))


def measurement_text(kind: Column, points: Column, page_inches: Column, real_value: Column, unit: Column) -> Column:
    """A distance, perimeter or area of a path in real units, with two decimals and its unit; null for too few points (two, for areas three)."""
    scale = units_per_point(page_inches, real_value)
    number = lambda v: F.format_number(F.round(v, 2), 2)
    area = F.when(F.size(points) >= 3, F.concat(number(polygon_area(points) * scale * scale), F.lit(" sq "), unit))
    length = F.when(F.size(points) >= 2, F.concat(number(path_length(points, kind == "perimeter") * scale), F.lit(" "), unit))
    return F.when(kind == "area", area).otherwise(length)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / size)))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def luminance(r: Column, g: Column, b: Column) -> Column:
    """BT.601."""
    return r * 0.299 + g * 0.587 + b * 0.114


def hex_rgb(text: Column) -> Column:
    part = lambda i: F.conv(F.substring(text, i, 2), 16, 10).cast("int") / F.lit(255.0)
    return F.when(text.rlike("^#[0-9a-fA-F]{6}$"), F.array(part(2), part(4), part(6)))


def rgb_cmyk(r: Column, g: Column, b: Column) -> Column:
    """Complements, with the common part as black taken out."""
    c, m, y = 1 - r, 1 - g, 1 - b
    k = F.least(c, m, y)
    return F.array(c - k, m - k, y - k, k)


def cmyk_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    return F.array(1 - F.least(F.lit(1.0), c + k), 1 - F.least(F.lit(1.0), m + k), 1 - F.least(F.lit(1.0), y + k))


def rgb_gray(r: Column, g: Column, b: Column) -> Column:
    return r * 0.3 + g * 0.59 + b * 0.11


def clamp_page(page: Column, count: Column) -> Column:
    """A page number within 1..count; anything that is no number is 1."""
    n = F.floor(F.coalesce(F.nanvl(page.cast("double"), F.lit(1.0)), F.lit(1.0)) + 0.5)
    return F.greatest(F.lit(1), F.least(count, n)).cast("int")


def clamp_zoom(zoom: Column) -> Column:
    return F.greatest(F.lit(0.25), F.least(F.lit(5.0), F.coalesce(F.nanvl(zoom.cast("double"), F.lit(1.0)), F.lit(1.0))))


def match_rect(x: Column, y: Column, width: Column, size: Column, chars: Column, start: Column, end: Column) -> Column:
    """The box of characters start..end of an upright item: their share of its width with a third of a character around, from below the baseline to above the letters."""
    step = width / F.greatest(chars, F.lit(1))
    return rect(x + step * start - step * 0.35, y - size * 0.3, x + step * end + step * 0.35, y + size * 1.1)


def crop(box: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """A crop within a visible box: an origin below the box's counts from it, the size is cut to the box; null if nothing is left."""
    left = F.when(x < box["x0"], box["x0"] + x).otherwise(x)
    low = F.when(y < box["y0"], box["y0"] + y).otherwise(y)
    right, top = F.least(left + width, box["x1"]), F.least(low + height, box["y1"])
    return F.when((right > left) & (top > low), rect(left, low, right, top))


def snap(x0: Column, y0: Column, x: Column, y: Column) -> Column:
    """The end of a line from (x0, y0) on the nearer axis."""
    flat = F.abs(x - x0) >= F.abs(y - y0)
    return F.struct(F.when(flat, x).otherwise(x0).alias("x"), F.when(flat, y0).otherwise(y).alias("y"))


def fit(width: Column, height: Column, most_width: Column, most_height: Column) -> Column:
    """A size within bounds, its shape kept, never larger than it is; to hundredths. A side of 0 bounds nothing."""
    scale = F.least(F.lit(1.0), most_width / F.nullif(width, F.lit(0.0)), most_height / F.nullif(height, F.lit(0.0)))
    return F.struct(F.round(width * scale, 2).alias("width"), F.round(height * scale, 2).alias("height"))


def padded_bounds(box: Column, pad: Column, width: Column, height: Column) -> Column:
    """A box with a margin, within an image."""
    return rect(F.greatest(box["x0"] - pad, F.lit(0.0)), F.greatest(box["y0"] - pad, F.lit(0.0)), F.least(box["x1"] + pad, width), F.least(box["y1"] + pad, height))


def print_scale(width: Column, height: Column, dpi: float, edge: float, pixels: float) -> Column:
    """The scale of a page for printing: dpi over 72, within an edge's and all pixels, a tenth at least."""
    return F.greatest(F.lit(0.1), F.least(F.lit(dpi / 72.0), F.lit(edge) / F.greatest(width, height), F.sqrt(F.lit(pixels) / (width * height))))


def unturned_box(turns: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """A normalised box (0..1, y downwards) found on a page turned clockwise by quarter turns, on the page as it was, cut to it."""
    t = F.pmod(turns.cast("int"), F.lit(4))
    at = lambda a, b, c, d: F.struct(*[F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (a, b, c, d), strict=True)])
    return F.when(t == 1, at(y, 1 - x - width, y + height, 1 - x)).when(t == 2, at(1 - x - width, 1 - y - height, 1 - x, 1 - y)).when(t == 3, at(1 - y - height, x, 1 - y, x + width)).otherwise(at(x, y, x + width, y + height))
