"""Scores, rejection reasons, review flags and colour names as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as g


@dataclass(frozen=True)
class Limits:
    """Detection and review limits with their default values."""

    min_area: float = 0.0015
    max_area: float = 0.20
    max_aspect: float = 4.0
    min_solidity: float = 0.45
    min_foreground: float = 0.35
    min_colorfulness: float = 12.0
    min_texture: float = 15.0
    min_confidence: float = 0.30
    iou: float = 0.45
    containment: float = 0.85
    size_factor: float = 2.5
    flag_aspect: float = 2.5
    similarity: float = 0.55


LIMITS = Limits()

# What each review flag means to a reader.
FLAG_TEXTS = {
    "touches_border": "Crop touches the edge of the photo - the pin may be cut off.",
    "small": "Unusually small compared with other pins on this page.",
    "large": "Unusually large - may contain more than one pin.",
    "mostly_background": "Mostly background colour - may be an empty slot or shadow.",
    "extreme_aspect": "Very long and thin shape.",
    "low_confidence": "The detector was not sure about this one.",
    "possible_duplicate": "Looks like a pin that is already in the catalog.",
}
# Reasons of rejection.
TOO_SMALL, TOO_LARGE, TOO_LONG = "too small", "too large", "too elongated"
IRREGULAR = "irregular / thin outline"
AT_EDGE = "touches photo edge (table, rings, page edge)"
ALONG_EDGE = "runs along the photo edge (table / background)"
EMPTY_SLOT = "empty slot (mostly background inside)"
GREY_SLOT = "empty slot (grey, no colour)"
PLAIN_GREY = "plain grey area (shadow, page edge)"
UNSURE = "low confidence"
# Upper bounds of hue in degrees and the colour below them.
HUES = [(20, "pink"), (45, "red"), (85, "orange"), (112, "yellow"), (175, "green"), (215, "teal"), (310, "blue"), (340, "purple"), (360, "pink")]


def ramp(v: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high on, linear between; a step if they meet."""
    if high <= low:
        return F.when(v >= high, 1.0).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - low) / (high - low)))


def _weighted(*terms: tuple[float, Column]) -> Column:
    total = F.lit(0.0)
    for weight, value in terms:
        total = total + F.lit(weight) * value
    return total


def empty_slot_likelihood(f: Column, limits: Limits = LIMITS) -> Column:
    inside, colour = limits.min_foreground, limits.min_colorfulness
    return _weighted(
        (0.4, 1 - ramp(f["foreground_ratio"], inside * 0.5, inside * 1.6)),
        (0.3, 1 - ramp(f["colorfulness"], colour * 0.5, colour * 2.5)),
        (0.15, 1 - ramp(f["hue_diversity"], 0.05, 0.3)),
        (0.15, ramp(f["extent"], 0.6, 0.9)),
    )


def confidence(f: Column, limits: Limits = LIMITS) -> Column:
    """0 to 1 from a struct of measurements."""
    score = _weighted(
        (0.35, ramp(f["foreground_ratio"], limits.min_foreground * 0.6, 0.75)),
        (0.3, ramp(f["colorfulness"], limits.min_colorfulness * 0.6, 40.0)),
        (0.2, ramp(f["solidity"], 0.35, 0.8)),
        (0.15, ramp(f["texture"], 3.0, 15.0)),
    )
    kept = 1 - F.greatest(F.lit(0.0), empty_slot_likelihood(f, limits) - 0.4)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score * kept))


def rejection(f: Column, sure: Column, limits: Limits = LIMITS) -> Column:
    """The first reason that applies, or null."""
    dull = f["colorfulness"] < limits.min_colorfulness
    not_bright = f["colorfulness"] < limits.min_colorfulness * 2
    rules = [
        (f["area_fraction"] < limits.min_area, TOO_SMALL),
        (f["area_fraction"] > limits.max_area, TOO_LARGE),
        (f["aspect_ratio"] > limits.max_aspect, TOO_LONG),
        (f["solidity"] < limits.min_solidity, IRREGULAR),
        ((f["border_distance"] <= 1) & not_bright, AT_EDGE),
        (f["border_contact"] > 0.25, ALONG_EDGE),
        ((f["foreground_ratio"] < limits.min_foreground) & not_bright, EMPTY_SLOT),
        (dull & (f["hue_diversity"] < 0.1) & (f["dark_ratio"] < 0.15), GREY_SLOT),
        (dull & (f["texture"] < limits.min_texture), PLAIN_GREY),
        (sure < limits.min_confidence, UNSURE),
    ]
    return F.coalesce(*(F.when(test, F.lit(reason)) for test, reason in rules))


def flags(box: Column, width: Column | int, height: Column | int, typical: Column, foreground: Column | None = None, sure: Column | None = None, limits: Limits = LIMITS) -> Column:
    """Review flags in fixed order; checks whose input is null or absent are skipped."""
    size, margin = g.area(box), F.greatest(F.lit(2), F.floor(F.lit(0.003) * F.greatest(g._col(width), g._col(height))).cast("int"))
    known = typical > 0
    found = [
        F.when(g.touches_border(box, width, height, margin), "touches_border"),
        F.when(known & (size < typical / limits.size_factor), "small").when(known & (size > typical * limits.size_factor), "large"),
    ]
    if foreground is not None:
        found.append(F.when(foreground < limits.min_foreground * 1.4, "mostly_background"))
    found.append(F.when(g.aspect_ratio(box) > limits.flag_aspect, "extreme_aspect"))
    if sure is not None:
        found.append(F.when(sure < 0.5, "low_confidence"))
    return F.array_compact(F.array(*found))


def flag_texts(flags: Column) -> Column:
    """Sentences for flags; unknown ones are shown as they are."""
    known = F.create_map(*(F.lit(x) for pair in FLAG_TEXTS.items() for x in pair))
    return F.transform(flags, lambda f: F.coalesce(F.try_element_at(known, f), f))


# Linear sRGB to XYZ over the D65 white point, row by row, and that white.
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def lab(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """8-bit RGB as 8-bit LAB (lightness times 2.55, a and b plus 128), by the exact formula rounded half to even; tables of libraries may differ by one."""

    def linear(c: Column) -> Column:
        v = c / 255.0
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    parts = [linear(c) for c in (red, green, blue)]
    bend = lambda v: F.when(v > 0.008856, F.pow(v, F.lit(1.0 / 3.0))).otherwise(v * 7.787 + 16.0 / 116.0)
    x, y, z = (bound((parts[0] * row[0] + parts[1] * row[1] + parts[2] * row[2]) / white, bend) for row, white in zip(XYZ, WHITE, strict=True))
    byte = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.rint(v).cast("int")))
    return byte((y * 116 - 16) * 2.55), byte((x - y) * 500 + 128), byte((y - z) * 200 + 128)


# XYZ to linear sRGB, row by row.
RGB = ((3.240479, -1.53715, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))


def rgb(lightness: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit LAB as 8-bit RGB, by the exact formula rounded half to even; tables of libraries may differ by one."""
    fy = (lightness / 2.55 + 16) / 116.0
    cubed = lambda f: F.when(f > 6.0 / 29.0, f * f * f).otherwise((f - 16.0 / 116.0) / 7.787)
    x, y, z = (bound(f, cubed) for f in (fy + (a - 128) / 500.0, fy, fy - (b - 128) / 200.0))
    bent = lambda v: F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)
    byte = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.rint(v * 255).cast("int")))
    r, g, b_ = (bound(x * (row[0] * WHITE[0]) + y * row[1] + z * (row[2] * WHITE[2]), bent) for row in RGB)
    return byte(r), byte(g), byte(b_)


def gray(red: Column, green: Column, blue: Column) -> Column:
    """8-bit grey of 8-bit RGB: weights of 0.299, 0.587 and 0.114 in parts of 2 ** 14, half up."""
    return F.shiftright(red * 4899 + green * 9617 + blue * 1868 + 8192, 14)


def rgb_color_name(red: Column, green: Column, blue: Column) -> Column:
    """Name of an 8-bit RGB colour, by way of 8-bit LAB."""
    lightness, a, b = lab(red, green, blue)
    values = F.struct((lightness * 100 / 255).alias("l"), (a - 128).alias("a"), (b - 128).alias("b"))
    return bound(values, lambda c: lab_color_name(c["l"], c["a"], c["b"]))


def lab_color_name(lightness: Column, a: Column, b: Column) -> Column:
    """Name of a colour from lightness 0-100 and centred a, b."""
    polar = F.struct(F.hypot(a, b).alias("chroma"), F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)).alias("hue"))
    return bound(polar, lambda c: _color_name(lightness, c["chroma"], c["hue"]))


def _color_name(lightness: Column, chroma: Column, hue: Column) -> Column:
    plain = F.lit(HUES[-1][1])
    for bound, name in reversed(HUES[:-1]):
        plain = F.when(hue < bound, name).otherwise(plain)
    grey = F.when(lightness < 22, "black").when(lightness < 45, "dark gray").when(lightness < 80, "gray").otherwise("white")
    return (
        F.when(chroma < 7.0, grey)
        .when((hue >= 30) & (hue < 90) & (lightness < 50), "brown")
        .when((hue >= 55) & (hue < 115) & (chroma < 26) & (lightness >= 68), "beige")
        .when((plain == "red") & (lightness >= 62), F.when(hue < 36, "pink").otherwise("orange"))
        .when((plain == "red") & (lightness < 35), "dark red")
        .when((plain == "blue") & (lightness < 25), "navy")
        .when((plain == "blue") & (lightness >= 65), F.when(hue >= 285, "lavender").otherwise("light blue"))
        .when((plain == "purple") & (lightness >= 65), "lavender")
        .when((plain == "green") & (lightness < 35), "dark green")
        .otherwise(plain)
    )
