"""Text helpers: ASCII case folding, LIKE with plain backslashes, prices, escaping, tags, codes and card styles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def nocase(c: Column) -> Column:
    """Folds A-Z only, so that accented letters keep their case."""
    return F.translate(c, _UPPER, _LOWER)


def contains_nocase(c: Column, q: str) -> Column:
    """c LIKE %q%, folding A-Z only: % and _ in q are wildcards, a backslash is a backslash."""
    return nocase(c).like("%" + q.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\") + "%")


def price(c: Column) -> Column:
    return F.when(c.isNull(), "").otherwise(F.format_string("%.2f", c))


def html_escaped(c: Column, apostrophes: bool = False) -> Column:
    for plain, escape in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), *([("'", "&#x27;")] if apostrophes else [])):
        c = F.replace(c, F.lit(plain), F.lit(escape))
    return c


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with each {{NAME}} replaced by its value, escaped for HTML, one name after the other; a null value is empty, and unknown names stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(html_escaped(value.cast("string"), apostrophes=True), F.lit("")))
    return template


# What counts as white space at the ends of texts, besides line ends and tabs.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.btrim(c, F.lit(SPACES))


def clean_tags(tags: Column, longest: int = 60) -> Column:
    """Trimmed, lower case, single spaces, cut; without empty ones and those that equal an earlier result before they are cut."""
    tidy = F.transform(tags, lambda t: F.trim(F.regexp_replace(F.lower(t), f"[{SPACES}]+", " ")))
    add = lambda out, t: F.when(F.array_contains(out, t), out).otherwise(F.array_append(out, F.substring(t, 1, longest)))
    return F.aggregate(F.filter(tidy, lambda t: t != ""), F.array().cast("array<string>"), add)


def split_tags(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), stripped), lambda t: t != "")


def item_code(n: Column, strict: bool = False) -> Column:
    """PIN-000001 and up; wider from a million on. Below 1 null or, if strict, an error."""
    code = F.when(n >= 1, F.format_string("PIN-%06d", n))
    return F.when(n < 1, F.raise_error(F.lit("numbers of codes start at 1"))).otherwise(code) if strict else code


def code_number(code: Column) -> Column:
    return F.regexp_extract(code, r"^PIN-(\d+)", 1).try_cast("long")


def blank_to_null(c: Column) -> Column:
    return F.nullif(stripped(c), F.lit(""))


def card_hash(code: Column) -> Column:
    """Unsigned 32-bit h = 31 h + code unit over an ASCII code."""
    return F.aggregate(F.split(code, ""), F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(4294967295))


def card_style(code: Column) -> tuple[Column, Column]:
    """(class 0-5, tilt in degrees); the shift is of a signed 32-bit number, so high hashes tilt by negative remainders."""
    h = card_hash(code)
    signed = F.when(h >= 2147483648, h - 4294967296).otherwise(h)
    return h % 6, ((F.shiftright(signed, 3) % 7) - 3) * F.lit(0.5)
