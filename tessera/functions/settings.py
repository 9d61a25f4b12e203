"""Settings from a TOML file: limits of detection, and what a catalogue's exports and crops go by."""

from __future__ import annotations

import dataclasses
import logging
import os
import tomllib
from dataclasses import dataclass
from typing import Any, TypeVar

from .scoring import LIMITS, Limits

S = TypeVar("S")


@dataclass(frozen=True)
class Settings:
    """What isn't a limit of detection. Defaults are fixed values; folders may be relative to the file's own."""

    data_dir: str = "data"
    publish_dir: str | None = None
    padding_percent: float = 10.0
    square_crops: bool = True
    thumbnail_size: int = 400
    transparent_feather: int = 2
    display_max_dimension: int = 2400
    similarity_threshold: float = 0.55
    export_image_max_dimension: int = 1200
    html_include_selling_price: bool = True
    html_include_purchase_price: bool = False
    html_include_notes: bool = False
    html_include_quantity: bool = True
    catalog_title: str = "Catalogue"
    catalog_subtitle: str = ""


FOLDERS = ("data_dir", "publish_dir")


def coerced(name: str, value: Any, default: Any, base: str) -> Any:
    """A raw value as the type of its default: a truth value must be one, numbers may be texts, an empty folder is none, and a relative one is below `base`."""
    if name in FOLDERS:
        return None if value in ("", None) else os.path.normpath(os.path.join(base, os.path.expanduser(str(value))))
    if isinstance(default, bool):
        if not isinstance(value, bool):
            raise ValueError(f"{name} must be true or false, not {value!r}")
        return value
    if isinstance(default, int | float):
        if isinstance(value, bool) or not isinstance(value, int | float | str):
            raise ValueError(f"{name} must be a number, not {value!r}")
        return type(default)(value)
    return value


def load(path: str | None, into: S, others: tuple[str, ...] = (), **more: Any) -> S:
    """`into` with the values of a TOML file's keys, in any section and any case, and of `more`, which come first and stay as they are.

    A missing file changes nothing; keys that are neither in `into` nor in `others` are logged and left out; a value of a wrong type is an error.
    """
    found: dict[str, Any] = {}
    if path and os.path.exists(path):
        with open(path, "rb") as f:
            for key, value in tomllib.load(f).items():
                found.update(value if isinstance(value, dict) else {key: value})
    found = {k.lower(): v for k, v in found.items()}
    defaults = {f.name: getattr(into, f.name) for f in dataclasses.fields(into)}  # type: ignore[arg-type]
    if unknown := sorted(found.keys() - defaults.keys() - set(others)):
        logging.getLogger(__name__).warning("unknown settings in %s: %s", path, ", ".join(unknown))
    base = os.path.dirname(os.path.abspath(path)) if path else os.getcwd()
    values = {k: coerced(k, v, defaults[k], base) for k, v in found.items() if k in defaults}
    return dataclasses.replace(into, **values | more)  # type: ignore[type-var]


def load_settings(path: str | None = None, **more: Any) -> Settings:
    """Settings of a file that may hold limits too."""
    return load(path, Settings(), tuple(f.name for f in dataclasses.fields(Limits)), **more)


def load_limits(path: str | None = None, **more: Any) -> Limits:
    """LIMITS with those of a file that may hold settings too."""
    return load(path, LIMITS, tuple(f.name for f in dataclasses.fields(Settings)), **{k: coerced(k, v, getattr(LIMITS, k, None), ".") for k, v in more.items()})
