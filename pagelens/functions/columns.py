"""Column helpers with the number and string semantics of the web pages' own scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Nearest whole number, half towards plus infinity."""
    return F.floor(x + 0.5)


def fixed(x: Column, places: int) -> Column:
    """Rounded half up to `places`; may differ from decimal formatting only at near ties."""
    return F.floor(x * 10**places + 0.5) / 10**places


def falsy(*values: Column, text: bool = False) -> Column:
    """The first value that is neither null nor 0 (for texts: nor ''), else the last."""
    out = values[-1]
    for v in reversed(values[:-1]):
        out = F.when(v.isNotNull() & (v != ("" if text else 0)), v).otherwise(out)
    return out


def clamp(x: Column, low, high) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def cell_of(x: Column, size: int, most: int = 64) -> Column:
    """The grid cell of a coordinate; all beyond `most` cells share the last one, so no box covers many."""
    return F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(x / size)))


def squeeze(x: Column, most: int | None = None) -> Column:
    """Trimmed, runs of white space made one space, cut to `most` characters."""
    out = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.left(out, F.lit(most)) if most else out


def rolling_hash(x: Column) -> Column:
    """Eight hex digits of h = h * 33 + c over the characters, from 5381, in 32 bits."""
    folded = F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(5381).cast("long"), lambda h, c: (h * 33 + F.ascii(c)).bitwiseAND(F.lit(4294967295).cast("long")))
    return F.lower(F.lpad(F.hex(folded), 8, "0"))


def byte_size(n: Column) -> Column:
    """0 B, 512 B, 1.5 KB, 2.25 MB: two decimals at most."""
    kb, mb = F.lit(1024.0), F.lit(1048576.0)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.concat(F.call_function("format_number", n / kb, F.lit("0.##")), F.lit(" KB"))).otherwise(F.concat(F.call_function("format_number", n / mb, F.lit("0.##")), F.lit(" MB")))


# Display ratios tried in this order, within 0.035.
RATIOS = (("16:9", 16 / 9), ("16:10", 16 / 10), ("4:3", 4 / 3), ("3:2", 3 / 2), ("5:4", 5 / 4), ("1:1", 1.0), ("21:9", 21 / 9), ("32:9", 32 / 9), ("9:16", 9 / 16), ("9:21", 9 / 21))


def gcd(a: Column, b: Column, steps: int = 48) -> Column:
    """Greatest common divisor by a bounded fold of Euclid's step (enough for 32-bit sides)."""
    pair = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), pair, lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), F.expr("0L").alias("b")).withField("b", F.try_mod(p["a"], p["b"]))))
    return done["a"]


def ratio_label(width: Column, height: Column) -> Column:
    """'approximately 16:9', else a reduced fraction with sides up to 60, else 'n:1'."""
    numeric = fixed(width / F.when(height != 0, height), 4)
    label = F.when(width.isNull() | height.isNull() | (width == 0) | (height == 0), F.lit("—"))
    for name, value in RATIOS:
        label = label.when(F.abs(numeric - F.lit(value)) <= 0.035, F.lit(f"approximately {name}"))
    divisor = gcd(js_round(width), js_round(height))
    w, h = (js_round(width) / divisor).cast("long"), (js_round(height) / divisor).cast("long")
    return label.when((w <= 60) & (h <= 60), F.concat(w.cast("string"), F.lit(":"), h.cast("string"))).otherwise(F.concat(numeric.cast("string"), F.lit(":1")))


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union of two boxes, 0 where they don't meet."""
    w = F.greatest(F.lit(0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    both = w * h
    union = aw * ah + bw * bh - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))
