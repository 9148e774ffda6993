"""Labels, codes and text helpers as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from fernwerk.functions.curves import num, piecewise

# Fixed values.
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
VEGETATION_CLASSES = {0: "unknown", 1: "bare", 2: "meadow", 3: "open forest", 4: "closed forest", 5: "cutblock"}
FOREST_CLASSES = {0: "no inventory", 1: "non-forest", 2: "no host", 3: "low host", 4: "host-rich", 5: "young"}
TENURE_CLASSES = {
    0: "crown_land",
    1: "woodlot",
    2: "private",
    3: "recreation_area",
    4: "provincial_park",
    5: "conservancy",
    6: "ecological_reserve",
    7: "national_park",
}
TENURE_LABELS = {
    "crown_land": "Crown land",
    "woodlot": "Woodlot licence",
    "private": "Private property",
    "recreation_area": "Recreation area",
    "provincial_park": "Provincial park",
    "conservancy": "Conservancy",
    "ecological_reserve": "Ecological reserve",
    "national_park": "National park",
}
TREE_NAMES = {
    "FD": "Douglas-fir",
    "HW": "western hemlock",
    "HM": "mountain hemlock",
    "CW": "western redcedar",
    "YC": "yellow-cedar",
    "TW": "western yew",
    "PL": "lodgepole pine",
    "PW": "western white pine",
    "PY": "ponderosa pine",
    "PA": "whitebark pine",
    "SE": "Engelmann spruce",
    "SX": "hybrid spruce",
    "SS": "Sitka spruce",
    "S": "spruce",
    "BL": "subalpine fir",
    "BG": "grand fir",
    "BA": "amabilis fir",
    "B": "true fir",
    "LW": "western larch",
    "LA": "alpine larch",
    "L": "larch",
    "AT": "trembling aspen",
    "AC": "cottonwood",
    "EP": "paper birch",
    "DR": "red alder",
    "MB": "bigleaf maple",
}
#: A tree's raster code is its place in the sorted keys, from 1; 255 is any other tree.
OTHER_TREE = 255
SCORE_STOPS = ((0, 68, 1, 84), (0.25, 59, 82, 139), (0.5, 33, 145, 140), (0.75, 94, 201, 98), (1, 253, 231, 37))
# Stops and colours of the map's other overlays.
RAMPS = {
    "suitability": SCORE_STOPS,
    "elevation": ((0, 60, 110, 70), (0.35, 150, 175, 110), (0.6, 190, 165, 120), (0.8, 160, 130, 110), (1, 250, 250, 252)),
    "slope": ((0, 255, 255, 204), (0.4, 253, 176, 74), (0.7, 227, 90, 60), (1, 128, 0, 38)),
    "ndvi": ((0, 140, 100, 60), (0.4, 220, 210, 140), (0.7, 90, 170, 70), (1, 10, 80, 30)),
    "water": ((0, 245, 235, 210), (0.4, 160, 200, 200), (0.7, 70, 140, 190), (1, 20, 60, 130)),
    "host": ((0, 245, 240, 225), (0.3, 200, 190, 110), (0.6, 120, 150, 60), (1, 30, 80, 40)),
    "aspect": ((0, 235, 90, 90), (0.25, 235, 220, 90), (0.5, 90, 200, 235), (0.75, 140, 110, 220), (1, 235, 90, 90)),
}
VEGETATION_COLOURS = {1: (170, 150, 130), 2: (120, 200, 90), 3: (60, 140, 80), 4: (25, 70, 45), 5: (198, 122, 62)}
FOREST_COLOURS = {1: (205, 195, 160), 2: (120, 120, 150), 3: (150, 175, 90), 4: (35, 110, 50), 5: (198, 122, 62)}
TENURE_COLOURS = {1: (200, 170, 90), 2: (220, 120, 120), 3: (150, 190, 120), 4: (90, 170, 110), 5: (70, 150, 140), 6: (170, 100, 180), 7: (60, 130, 90)}
HABITAT_LABELS = {"vegetation": "Vegetation", "forest": "Host trees"}


def forest_classes(forest: Mapping | None = None) -> dict[int, str]:
    """Names of the forest classes in the profile's own word for its trees (host_label, host_label_plural)."""
    f = forest or {}
    one = f.get("host_label") or "host"
    many = f.get("host_label_plural") or {"host": "hosts"}.get(one, one)
    return {0: "no inventory", 1: "non-forest", 2: f"forest, no {many}", 3: f"forest, some {many}", 4: f"{one}-rich forest", 5: "young / recently harvested"}


def habitat_label(species: Mapping, layer: str) -> str:
    """The habitat's name on the map: the profile's, else one made of its word for host trees, else the layer's."""
    host = (species.get("forest") or {}).get("host_label") if layer == "forest" else None
    return species.get("habitat_label") or (f"{host[:1].upper()}{host[1:]} stands" if host else HABITAT_LABELS.get(layer, "Habitat"))


def literal_map(values: Mapping) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def compass(bearing: Column) -> Column:
    """Sixteen winds of 22.5 degrees, half open to the right; missing is 'n/a'."""
    sector = F.pmod((F.pmod(bearing, num(360)) / num(22.5) + num(0.5)).cast("int"), F.lit(16))
    # not element_at of a missing index: over an array without NULLs Spark takes the last entry
    return F.when(bearing.isNull(), "n/a").otherwise(F.element_at(F.array(*map(F.lit, COMPASS)), F.coalesce(sector, F.lit(0)) + 1))


def longest_prefix(code: Column, table: Mapping[str, float], default: float | None) -> Column:
    """The value of the longest key that begins the code, after trimming and upper-casing; NULL code is NULL."""
    clean = F.upper(F.trim(code))
    keys = sorted(table, key=lambda k: (-len(k), k))
    out = F.when(clean.isNull(), num(None))
    for k in keys:
        out = out.when(clean.startswith(k), num(table[k]))
    return out.otherwise(num(default))


def tree_code(code: Column) -> Column:
    at = {k: i + 1 for i, k in enumerate(sorted(TREE_NAMES))}
    blank = code.isNull() | (F.trim(code) == "")
    return F.when(blank, 0).otherwise(F.coalesce(longest_prefix(code, at, None), num(OTHER_TREE)).cast("int"))


def tree_label(code: Column, pct: Column) -> Column:
    """'{name} {pct}%'; 'other' for the other trees; NULL for none."""
    names = {i + 1: TREE_NAMES[k] for i, k in enumerate(sorted(TREE_NAMES))}
    name = F.when(code == OTHER_TREE, F.lit("other")).when(code > 0, F.element_at(literal_map(names), code))
    return F.when(name.isNull(), None).when(pct.isNull(), name).otherwise(F.concat(name, F.lit(" "), F.bround(pct, 0).cast("long").cast("string"), F.lit("%")))


def tenure_of(designation: Column) -> Column:
    """Class of a protected area by its designation; anything else, or none, is a provincial park."""
    d = F.upper(F.coalesce(designation, F.lit("")))
    return F.when(d.contains("ECOLOGICAL RESERVE"), 6).when(d.contains("CONSERVANCY"), 5).when(d.contains("RECREATION AREA"), 3).otherwise(4)


def is_target(taxon: Column, target: str) -> Column:
    """The target itself or a taxon below it: the next character is a space, so Rosaceae is not Rosa."""
    return F.coalesce((taxon == target) | taxon.startswith(target + " "), F.lit(False))


def record_weight(taxon: Column, target: str, congeners: list[str], exact: float = 1.0, congener: float = 0.2, other: float = 0.5) -> Column:
    """Down-weighted names go before the target match; unnamed records count as other."""
    return F.when(taxon.isNull() | (taxon == ""), num(other)).when(taxon.isin(*congeners), num(congener)).when(is_target(taxon, target), num(exact)).otherwise(num(other))


def minutes_label(m: Column) -> Column:
    """'45 min', and from 90 minutes on '1 h 30 min'; missing is '-'. Halves round up."""
    up = lambda x: F.floor(x + 0.5).cast("long").cast("string")
    hours = F.floor(m / 60)
    return F.when(m.isNull(), "-").when(m < 90, F.concat(up(m), F.lit(" min"))).otherwise(F.concat(hours.cast("long").cast("string"), F.lit(" h "), up(m - hours * 60), F.lit(" min")))


def score_colour(s: Column) -> Column:
    """rgb() of a score on the five-stop ramp."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))
    part = lambda i: F.floor(piecewise(t, [(x[0], x[i]) for x in SCORE_STOPS]) + 0.5).cast("long").cast("string")
    return F.concat(F.lit("rgb("), part(1), F.lit(","), part(2), F.lit(","), part(3), F.lit(")"))


def pin_radius(area: Column) -> Column:
    return num(5) + F.least(F.sqrt(F.coalesce(F.nullif(area, num(0)), num(1))) * num(1.4), num(9))


def escape_xml(x: Column) -> Column:
    out = F.coalesce(x.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def request_key(*parts: Column) -> Column:
    """A cache key over all parameters of a request."""
    return F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))
