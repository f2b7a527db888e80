"""Coordinate systems as EPSG numbers."""

from __future__ import annotations

import re

DEFAULT_EPSG = 32632


def resolve(crs: int | str | None = None, prj: str | None = None, default: int = DEFAULT_EPSG) -> int:
    """EPSG number of a number, "EPSG:n", digits or WKT text; the default where none can be read."""
    if crs is None and prj is None:
        return default
    if isinstance(crs, int):
        return crs
    text = (crs if crs is not None else prj).strip()
    if re.fullmatch(r"\d+", text):
        return int(text)
    if m := re.fullmatch(r"(?i)epsg:+(\d+)", text):
        return int(m[1])
    # the outermost authority of a WKT stands last
    found = re.findall(r'(?i)(?:AUTHORITY|ID)\s*\[\s*"EPSG"\s*,\s*"?(\d+)"?', text)
    if found:
        return int(found[-1])
    if m := re.search(r"(?i)WGS[ _]?(?:19)?84[ _/]+UTM[ _]zone[ _](\d+)([NS])", text):
        return (32600 if m[2].upper() == "N" else 32700) + int(m[1])
    return default
