"""Membership curves and credits as column expressions. NULL in means NULL out unless a rule says otherwise."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

TINY = 1e-9


def num(x: object) -> Column:
    return x if isinstance(x, Column) else F.lit(None if x is None else float(x)).cast("double")


def finite(x: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clip(x: Column, lo: float, hi: float) -> Column:
    """NULL stays NULL; `least` and `greatest` alone would skip it."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, num(lo)), num(hi)))


def linear(x: Column, lo: float, hi: float) -> Column:
    """0 at lo, 1 at hi, clipped."""
    return clip((x - num(lo)) / num(max(hi - lo, TINY)), 0, 1)


def trapezoid(x: Column, hard_min: float | None, optimal_min: float, optimal_max: float, hard_max: float | None) -> Column:
    """1 on the closed plateau, linear on the open ramps, 0 at and beyond the hard edges; an open edge (None) keeps 1.

    One branch a zone, so that the expression names x a few times only and stays inside generated code.
    """
    out = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), num(None))
    if hard_min is not None:
        out = out.when(x <= num(hard_min), num(0)).when(x < num(optimal_min), (x - num(hard_min)) / num(max(optimal_min - hard_min, TINY)))
    if hard_max is not None:
        out = out.when(x >= num(hard_max), num(0)).when(x > num(optimal_max), (num(hard_max) - x) / num(max(hard_max - optimal_max, TINY)))
    return out.otherwise(num(1))


def ramp_down(x: Column, best: float, worst: float) -> Column:
    """1 at and below best, 0 at and above worst; infinite is missing."""
    missing = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(missing, num(None)).when(x <= num(best), num(1)).when(x >= num(worst), num(0)).otherwise((num(worst) - x) / num(max(worst - best, TINY)))


def aspect_score(aspect: Column, slope: Column, bearing: float, tolerance: float, flat: float) -> Column:
    """Cosine fall-off outside the tolerance around a bearing; ground flatter than ``flat`` counts half."""
    turn = F.pmod(aspect - num(bearing), num(360))
    off = F.least(turn, num(360) - turn)
    share = F.greatest(off - num(tolerance), num(0)) / num(max(180 - tolerance, TINY))
    credit = num(0.5) * (num(1) + F.cos(num(math.pi) * F.least(share, num(1))))
    return F.when(aspect.isNull(), num(None)).when(slope < num(flat), num(0.5)).otherwise(credit)


def weighted_mean(parts: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Mean over the parts that are present, weights renormalised in each row; all missing is missing."""
    used = [(parts[k], float(weights[k])) for k in parts if float(weights.get(k, 0)) > 0]
    if not used:
        raise ValueError("no part has a positive weight")
    total = sum((F.coalesce(c * num(w), num(0)) for c, w in used), num(0))
    weight = sum((F.when(c.isNotNull(), num(w)).otherwise(num(0)) for c, w in used), num(0))
    return F.try_divide(total, F.when(weight > 0, weight))


def piecewise(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Linear between knots, constant beyond the ends; knots must not decrease."""
    if any(b[0] < a[0] for a, b in zip(knots, knots[1:])):
        raise ValueError("knots must be in order")
    out = F.when(x.isNull(), num(None)).when(x <= num(knots[0][0]), num(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        if x1 > x0:
            out = out.when(x <= num(x1), num(y0) + (x - num(x0)) * num((y1 - y0) / (x1 - x0)))
    return out.otherwise(num(knots[-1][1]))


def age_credit(age: Column, knots: Sequence[tuple[float, float]], unknown: float) -> Column:
    return F.coalesce(piecewise(age, knots), num(unknown))


def hiking_speed(slope: Column, base: float = 5.0) -> Column:
    """Tobler's function of the absolute slope in degrees, scaled to a base speed in km/h."""
    return num(6) * F.exp(num(-3.5) * F.abs(F.tan(F.radians(slope)) + num(0.05))) * num(base) / num(5)


def cost_per_metre(slope: Column, trail: Column, road: Column, base: float = 5.0, off_trail: float = 1.6) -> Column:
    """Minutes a metre: roads are almost free, even on cliffs; cliffs (over 45 degrees or unknown slope) are all but closed."""
    speed = clip(F.coalesce(hiking_speed(slope, base), num(0.05)), 0.05, 8)
    walk = num(60) / (speed * num(1000)) * F.when(trail, num(1)).otherwise(num(off_trail))
    return F.when(road, num(1e-6)).when(slope.isNull() | (slope > 45), num(1e4)).otherwise(walk)


def moisture_credit(distance: Column, no_water: Column, tpi: Column, optimal_max: float, zero_at: float, wet_at: float, dry_at: float, water: float, topography: float, floor: float = 0.0, hard_max: float | None = None) -> Column:
    """Blend of nearness to water and topographic position; a missing position makes it missing, no water at all is no credit."""
    if water + topography <= 0:
        raise ValueError("water or topography needs a positive weight")
    near = F.when(no_water, num(0)).otherwise(ramp_down(distance, optimal_max, zero_at))
    both = num(water) * near
    if topography > 0:
        both = both + num(topography) * ramp_down(tpi, wet_at, dry_at)
    credit = num(floor) + num(1 - floor) * both / num(water + topography)
    return credit if hard_max is None else F.when(~no_water & (distance <= num(hard_max)), credit)


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); missing outside [-1, 1] or where the sum is zero."""
    nd = F.try_divide(a - b, a + b)
    return F.when(nd.between(-1, 1), nd)


def reflectance(dn: Column, baseline: Column) -> Column:
    """Digital numbers to reflectance; processing baselines from 04.00 on carry an offset of -1000."""
    return clip((dn + F.when(baseline >= "04.00", num(-1000)).otherwise(num(0))) / num(10000), 0, 1e9)


def canopy_closure(ndmi: Column, texture: Column, open_max: float, closed_min: float, texture_weight: float = 0.0, smooth_max: float = 0.0, rough_min: float = 1.0) -> Column:
    """Closure continuum from moisture, blended with smoothness if a texture weight is given."""
    closure = linear(ndmi, open_max, closed_min)
    if texture_weight > 0:
        closure = num(1 - texture_weight) * closure + num(texture_weight) * (num(1) - linear(texture, smooth_max, rough_min))
    return F.when(ndmi.isNotNull(), closure)


def vegetation_score(ndvi: Column, closure: Column, bands: Mapping[str, float | None], openness: Mapping[str, float], enforce_bare: bool = True) -> Column:
    """Greenness fit times openness credit; bare ground has a credit of its own, or is rejected."""
    bare = F.coalesce(ndvi < num(bands["hard_min"]), F.lit(False))
    credit = F.when(closure.isNull(), num(None)).when(bare, num(openness["bare"])).otherwise(piecewise(closure, [(0, openness["meadow"]), (0.5, openness["open_forest"]), (1, openness["closed_forest"])]))
    score = trapezoid(ndvi, bands["hard_min"], bands["optimal_min"], bands["optimal_max"], bands.get("hard_max")) * credit
    return F.when(~bare, score) if enforce_bare else score


def clearcut_penalty(age: Column, floor: float, recovery: float) -> Column:
    """The floor on fresh cuts, fading to 1 at recovery; 1 where never cut or where the floor is 1."""
    if floor >= 1:
        return num(1)
    return F.coalesce(num(floor) + num(1 - floor) * clip(age / num(max(recovery, TINY)), 0, 1), num(1))


def vegetation_class(ndvi: Column, closure: Column, hard_min: float, logged_age: Column, recovery: float) -> Column:
    """0 no data, 1 bare, 2 meadow, 3 open forest, 4 closed forest, 5 cutblock (only over meadow)."""
    return (
        F.when(ndvi.isNull() | closure.isNull(), 0)
        .when(ndvi < num(hard_min), 1)
        .when((closure < num(1 / 3)) & (logged_age < num(recovery)), 5)
        .when(closure < num(1 / 3), 2)
        .when(closure < num(2 / 3), 3)
        .otherwise(4)
    )


def forest_score(host: Column, age: Column, closure: Column, inventoried: Column, saturation: float, hard_min: float, knots: Sequence[tuple[float, float]], bands: Mapping[str, float | None], unknown: float = 0.5, enforce: bool = True) -> Column:
    """Host credit times age credit times crown closure credit; unknown attributes count ``unknown``."""
    credit = clip(host / num(max(saturation, TINY)), 0, 1) * age_credit(age, knots, unknown) * F.coalesce(trapezoid(closure, bands["hard_min"], bands["optimal_min"], bands["optimal_max"], bands["hard_max"]), num(unknown))
    return F.when(inventoried & (host >= num(hard_min)), credit) if enforce else F.when(inventoried, credit)


def forest_class(host: Column, treed: Column, inventoried: Column, age: Column, credit: Column, saturation: float, hard_min: float) -> Column:
    """0 no data, 1 non-forest, 2 no host, 3 low host, 4 host-rich, 5 young (hosts too young for any credit)."""
    return (
        F.when(~inventoried, 0)
        .when(~treed, 1)
        .when(host < num(hard_min), 2)
        .when(age.isNotNull() & (credit <= 0), 5)
        .when(host >= num(saturation), 4)
        .otherwise(3)
    )


def access_score(drive: Column, hike: Column, weights: Mapping[str, float], max_drive: float = 90.0, max_hike: float = 6.0, enforce_drive: bool = False, enforce_hike: bool = False) -> Column:
    """Drive credit full to a quarter of the limit, hike credit full to 0.25 km; limits reject only when enforced."""
    score = weighted_mean({"drive": ramp_down(drive, max_drive * 0.25, max_drive), "hike": ramp_down(hike, 0.25, max_hike)}, weights)
    if enforce_drive:
        score = F.when(drive <= num(max_drive), score)
    if enforce_hike:
        score = F.when(hike <= num(max_hike), score)
    return score


def observation_score(spread: Column, sigma: float, baseline: float) -> Column:
    """A lone record peaks at 1; ground without records keeps the baseline."""
    return num(baseline) + num(1 - baseline) * clip(spread * num(2 * math.pi * sigma * sigma), 0, 1)
