"""Layered settings as map columns, and the options model."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_environment(environ: Column, prefix: str) -> Column:
    """PREFIX_SECTION_KEY entries as section.key."""
    mine = F.map_filter(environ, lambda k, _: F.startswith(k, F.lit(prefix)))
    return F.transform_keys(mine, lambda k, _: F.lower(F.regexp_replace(F.substring(k, F.lit(len(prefix) + 1), F.length(k)), "^([A-Z0-9]+)_", "$1.")))


def merge_layers(*layers: Column) -> Column:
    """The first layer that states a key wins; missing layers are null."""
    stated = [F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull()) for m in layers]
    out = stated[-1]
    for m in reversed(stated[:-1]):
        out = F.map_concat(_without(out, F.map_keys(m)), m)
    return out


def _without(layer: Column, names: Column) -> Column:
    return F.map_filter(layer, lambda k, _: ~F.array_contains(names, k))


@dataclass(frozen=True)
class Options:
    """What a run was asked for; cross-field rules are checked at once."""

    mode: str = "clean"
    target_characters: int = 1800
    max_assets: int = 200
    ocr: bool = False
    ocr_language: str = "eng"
    page_width: str = "0"

    def __post_init__(self):
        import re

        if self.mode not in ("clean", "full"):
            raise ValueError("mode is clean or full")
        if self.target_characters < 200 or self.max_assets < 0:
            raise ValueError("sizes out of range")
        if not re.fullmatch(r"0|\d+(\.\d+)?(px|in|cm|mm)", self.page_width):
            raise ValueError("page_width is 0 or a length in px, in, cm or mm")

    def ignored(self) -> list[str]:
        """Stated options that this run cannot honour."""
        out = []
        if self.ocr:
            out.append("ocr: no engine is registered")
        if self.ocr_language != "eng" and not self.ocr:
            out.append("ocr_language: without ocr")
        return out

    def resolved(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}
