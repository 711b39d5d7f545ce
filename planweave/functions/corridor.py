"""Length that two routes share within a strip, as staged SQL expressions.

A route inside the strip around another is one interval, because the strip (a rectangle with a half disc at
either end) is convex: the hull of the intervals inside the rectangle and inside the two discs.
Each stage uses columns of those before it; any SQL engine can evaluate them.
"""

from __future__ import annotations

STRIP_M = 1600


def local(a: str, b: str) -> list[dict[str, str]]:
    """Metres east (x) and north (y) of the first point of ``a``: points p, q of a and r, s of b."""
    phi = f"radians(({a}_lat1 + {a}_lat2 + {b}_lat1 + {b}_lat2) / 4)"
    scale = {"ky": f"111132.954 - 559.822 * cos(2 * {phi}) + 1.175 * cos(4 * {phi})", "kx": f"111412.84 * cos({phi}) - 93.5 * cos(3 * {phi}) + 0.118 * cos(5 * {phi})"}
    ends = {"p": (a, 1), "q": (a, 2), "r": (b, 1), "s": (b, 2)}
    return [scale, {f"{n}x": f"({s}_lng{i} - {a}_lng1) * kx" for n, (s, i) in ends.items()} | {f"{n}y": f"({s}_lat{i} - {a}_lat1) * ky" for n, (s, i) in ends.items()}]


def inside(p: str, q: str, r: str, s: str, to: str, strip: float = STRIP_M) -> list[dict[str, str]]:
    """Metres of the way from p to q within the strip around r to s, as ``to``."""
    x = {f"{to}_dx": f"{q}x - {p}x", f"{to}_dy": f"{q}y - {p}y", f"{to}_l": f"nullif(sqrt(pow({s}x - {r}x, 2) + pow({s}y - {r}y, 2)), 0)"}
    y = {f"{to}_a": f"nullif({to}_dx * {to}_dx + {to}_dy * {to}_dy, 0)", f"{to}_ux": f"({s}x - {r}x) / {to}_l", f"{to}_uy": f"({s}y - {r}y) / {to}_l"}
    z = {f"{to}_s0": f"({p}x - {r}x) * {to}_ux + ({p}y - {r}y) * {to}_uy", f"{to}_ds": f"{to}_dx * {to}_ux + {to}_dy * {to}_uy", f"{to}_n0": f"{to}_ux * ({p}y - {r}y) - {to}_uy * ({p}x - {r}x)", f"{to}_dn": f"{to}_ux * {to}_dy - {to}_uy * {to}_dx"}
    lows, highs = {}, {}
    for k, c in (("1", r), ("2", s)):
        z[f"{to}_b{k}"] = f"2 * ({to}_dx * ({p}x - {c}x) + {to}_dy * ({p}y - {c}y))"
        z[f"{to}_c{k}"] = f"pow({p}x - {c}x, 2) + pow({p}y - {c}y, 2) - {strip} * {strip}"
        root = f"{to}_b{k} * {to}_b{k} - 4 * {to}_a * {to}_c{k}"
        lows[f"{to}_lo{k}"] = f"CASE WHEN {root} >= 0 THEN greatest(0.0, (-{to}_b{k} - sqrt(greatest(0.0, {root}))) / (2 * {to}_a)) END"
        highs[f"{to}_hi{k}"] = f"CASE WHEN {root} >= 0 THEN least(1.0, (-{to}_b{k} + sqrt(greatest(0.0, {root}))) / (2 * {to}_a)) END"
    slab = lambda v, d, lo, hi, f, out: f"CASE WHEN abs({d}) > 1e-9 THEN {f}(({lo} - {v}) / {d}, ({hi} - {v}) / {d}) WHEN {v} BETWEEN {lo} AND {hi} THEN {out} END"
    span = (("s", "0", f"{to}_l"), ("n", f"-{strip}", f"{strip}"))
    for v, lo, hi in span:
        lows[f"{to}_lo{v}"] = slab(f"{to}_{v}0", f"{to}_d{v}", lo, hi, "least", "0.0")
        highs[f"{to}_hi{v}"] = slab(f"{to}_{v}0", f"{to}_d{v}", lo, hi, "greatest", "1.0")
    box = {f"{to}_lo3": f"CASE WHEN {to}_los IS NOT NULL AND {to}_lon IS NOT NULL THEN greatest(0.0, {to}_los, {to}_lon) END", f"{to}_hi3": f"CASE WHEN {to}_los IS NOT NULL AND {to}_lon IS NOT NULL THEN least(1.0, {to}_his, {to}_hin) END"}
    some = lambda k: f"coalesce({to}_lo{k} <= {to}_hi{k}, false)"
    first = "least(" + ", ".join(f"CASE WHEN {some(k)} THEN {to}_lo{k} ELSE 2.0 END" for k in "123") + ")"
    last = "greatest(" + ", ".join(f"CASE WHEN {some(k)} THEN {to}_hi{k} ELSE -1.0 END" for k in "123") + ")"
    return [x, y, z, lows | highs, box, {f"{to}_first": first, f"{to}_last": last}, {to: f"greatest(0.0, {to}_last - {to}_first) * sqrt({to}_a)"}]


def with_shared_km(pairs, where):
    """Adds ``shared_km``, to 10 metres, to the pairs of routes (a_ and b_ columns) that fulfil ``where``; null for the rest."""
    from pyspark.sql import functions as F

    ends = [f"{s}_{n}{i}" for s in "ab" for n in ("lat", "lng") for i in (1, 2)]
    before = pairs.columns
    pairs = pairs.withColumns({f"c{e}": F.when(where, F.col(e)) for e in ends})
    for stage in shared_km("ca", "cb"):
        pairs = pairs.withColumns({k: F.expr(v) for k, v in stage.items()})
    return pairs.select(*before, F.round("shared_km", 2).alias("shared_km"))


def shared_km(a: str, b: str) -> list[dict[str, str]]:
    """The lesser of what each route has within the strip around the other, in kilometres."""
    return [*local(a, b), *inside("p", "q", "r", "s", "ia"), *inside("r", "s", "p", "q", "ib"), {"shared_km": "least(ia, ib) / 1000"}]
