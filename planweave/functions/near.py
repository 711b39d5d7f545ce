"""Shapes near each other within one task: rows of two sides, sorted by cell, to the pairs within a radius, by numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from . import owners

#: Rows of whole cells that are handled together at least, candidates that are tested at once.
ROWS, AT_ONCE = 20_000, 1_000_000
#: Columns of a row: its cell and part as a number, its side (0, 1), whether it is in its first band and cell, its key.
MARKS = ("in_", "side_", "first_band_", "first_cell_", "key_")
#: What pairs are judged by where rows have it, and lose: first and last day of a span, as numbers, which must meet, and what is known of the owners.
SPAN, OWNED = ("from_", "to_"), "owned_"


def metres(a: tuple, b: tuple):
    """Metres between shapes (lat1, lng1, lat2, lng2: arrays), 0 where they cross: what ``geo.distance_stages`` says, in numpy."""
    import numpy as np

    c = np.cos(np.radians((a[0] + a[2] + b[0] + b[2]) / 4))
    c2 = 2 * c * c - 1
    c3, c4 = c * (2 * c2 - 1), 2 * c2 * c2 - 1
    ky, kx = 111132.954 - 559.822 * c2 + 1.175 * c4, 111412.84 * c - 93.5 * c3 + 0.118 * (2 * c * c4 - c3)
    out = np.hypot((b[0] - a[0]) * ky, (b[1] - a[1]) * kx)
    long = np.flatnonzero(~((a[0] == a[2]) & (a[1] == a[3]) & (b[0] == b[2]) & (b[1] == b[3])))
    if not len(long):
        return out
    out[long] = segments_apart([x[long] for x in a], [x[long] for x in b], ky[long], kx[long])
    return out


def planar(a: tuple, b: tuple):
    """The way between segments (lat1, lng1, lat2, lng2: arrays) in degrees, taken as lengths in a plane, 0 where they cross."""
    import numpy as np

    return segments_apart(a, b, np.ones(len(a[0])), np.ones(len(a[0])))


def segments_apart(a: tuple, b: tuple, ky, kx):
    """The way between segments, with as much a degree of latitude and of longitude as said."""
    import numpy as np

    qx, qy, rx, ry, sx, sy = (a[3] - a[1]) * kx, (a[2] - a[0]) * ky, (b[1] - a[1]) * kx, (b[0] - a[0]) * ky, (b[3] - a[1]) * kx, (b[2] - a[0]) * ky
    vx, vy = sx - rx, sy - ry

    def away(px, py, wx, wy):
        """Square of the way from a point to the segment from 0 to w."""
        size = wx * wx + wy * wy
        t = np.where(size > 0, np.clip((px * wx + py * wy) / np.where(size > 0, size, 1.0), 0.0, 1.0), 0.0)
        return (px - t * wx) ** 2 + (py - t * wy) ** 2

    least = np.minimum(np.minimum(away(rx, ry, qx, qy), away(sx, sy, qx, qy)), np.minimum(away(-rx, -ry, vx, vy), away(qx - rx, qy - ry, vx, vy)))
    across = (qx * ry - qy * rx) * (qx * sy - qy * sx) < 0
    across &= (vx * -ry - vy * -rx) * (vx * (qy - ry) - vy * (qx - rx)) < 0
    return np.where(across, 0.0, np.sqrt(least))


def unlike_owners(x: dict, y: dict) -> bool:
    """What ``owners.different_companies`` says, of two values of ``owned_``: entities, needs_review, withheld, stem."""
    if not x["entities"] or not y["entities"] or x["withheld"] or y["withheld"] or not set(x["entities"]).isdisjoint(y["entities"]):
        return False
    if not (x["needs_review"] or y["needs_review"]):
        return True
    a, b = x["stem"], y["stem"]
    n = min(len(a), len(b))
    return a[:n] != b[:n] and (a[0] != b[0] or a[0] in owners.COMMON_FIRST)


def judge(rows) -> Callable:
    """A function of two arrays of rows: whether their owners differ, judged once for each two names."""
    import numpy as np
    import pyarrow.compute as pc

    names = pc.dictionary_encode(rows.column("utility")).indices.to_numpy(zero_copy_only=False)
    first = np.unique(names, return_index=True)[1]
    facts, known = rows.column(OWNED).take(first).to_pylist(), {}

    def differ(a, b):
        code, at = np.unique(names[a].astype(np.int64) * len(facts) + names[b], return_inverse=True)
        for c in map(int, code):
            if c not in known:
                known[c] = unlike_owners(facts[c // len(facts)], facts[c % len(facts)])
        return np.array([known[int(c)] for c in code], dtype=bool)[at]

    return differ


def apart(lat, lng, km: float) -> list[int]:
    """Of points in their order the places of those farther than ``km`` from every one kept before, as ``place.away_km`` has it.

    Kept points stand in cells of a grid through the globe, so each point is compared with the few kept ones beside it. Points
    that lack a coordinate are near no other.
    """
    import math

    import numpy as np

    radius = 6371.0
    side = max(km, 0.1) * (1 + 1e-9)
    usable = np.isfinite(lat) & np.isfinite(lng)
    y, x = np.radians(np.where(usable, lat, 0.0)), np.radians(np.where(usable, lng, 0.0))
    most = 2 * int(radius / side) + 8  # the way through the globe is never longer than the one along it
    a, b, c = (np.floor(radius * v / side).astype(np.int64) for v in (np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)))
    cells, usable, lat, lng = ((a * most + b) * most + c).tolist(), usable.tolist(), lat.tolist(), lng.tolist()
    steps = sorted(((i * most + j) * most + k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)), key=abs)
    half = lambda v: math.sin(math.radians(v) / 2) ** 2
    kept, there = [], {}
    for i, cell in enumerate(cells):
        if usable[i]:
            size = math.cos(math.radians(lat[i]))
            beside = (j for s in steps for j in there.get(cell + s, ()))
            if any(2 * radius * math.asin(math.sqrt(min(1.0, half(lat[i] - lat[j]) + math.cos(math.radians(lat[j])) * size * half(lng[i] - lng[j])))) <= km for j in beside):
                continue
            there.setdefault(cell, []).append(i)
        kept.append(i)
    return kept


def whole_cells(batches: Iterator) -> Iterator:
    """The batches put together and cut where a cell ends: no cell is in two of them."""
    import numpy as np
    import pyarrow as pa

    done, left, size, last = [], [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column("in_").to_numpy()
        changes = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        cut = int(changes[-1]) if len(changes) else 0
        if cut or (last is not None and keys[0] != last):  # the cell that was open ends in or before this batch
            done, size, left = [*done, *left, b.slice(0, cut)], size + sum(x.num_rows for x in left) + cut, []
            if size >= ROWS:
                yield pa.Table.from_batches(done).combine_chunks()
                done, size = [], 0
        left.append(b.slice(cut))
        last = keys[-1]
    if done or left:
        yield pa.Table.from_batches([*done, *left]).combine_chunks()


def candidates(g, south, north, west, east, ia, ib, reach) -> Iterator[tuple]:
    """Rows of ia and ib of one cell (g) whose boxes may meet, some at a time.

    Boxes of ib are in classes by size, and sorted by their southern end in strips, and west to east in a strip; so each box
    of ia has the rows it may meet side by side.
    """
    import numpy as np

    size = np.maximum(north[ib] - south[ib], east[ib] - west[ib])
    grade = np.ceil(np.log2(np.maximum(size / reach, 1.0))).astype(int)
    for k in np.unique(grade):
        own = ib[grade == k]
        high, wide, strip = (north[own] - south[own]).max(), (east[own] - west[own]).max(), reach * 2.0**k
        band = np.floor(south[own] / strip).astype(np.int64)
        least, most = band.min(), band.max()
        span = most - least + 1
        code = g[own] * span + band - least
        order = np.lexsort((west[own], code))
        own, code = own[order], code[order]
        codes, place = np.unique(code, return_inverse=True)
        at = lambda i, x: i * 2048.0 + np.clip(x, -1000.0, 1000.0) + 1024.0
        line = at(place, west[own])
        first = np.maximum(np.floor((south[ia] - high) / strip).astype(np.int64) - 1, least)
        n = np.maximum(np.minimum(np.floor(north[ia] / strip).astype(np.int64), most) - first + 1, 0)
        mine = np.repeat(ia, n)
        asked = g[mine] * span + np.repeat(first - least - (np.cumsum(n) - n), n) + np.arange(n.sum())
        there = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
        hit = codes[there] == asked
        mine, there = mine[hit], there[hit]
        lo, hi = np.searchsorted(line, at(there, west[mine] - wide) - 1e-5), np.searchsorted(line, at(there, east[mine]) + 1e-5, "right")
        n = hi - lo
        ends = np.cumsum(n)
        begin = 0
        while begin < len(n):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + AT_ONCE, "right")))
            part = n[begin:end]
            if total := int(part.sum()):
                yield np.repeat(mine[begin:end], part), own[np.repeat(lo[begin:end] - (np.cumsum(part) - part), part) + np.arange(total)]
            begin = end


def by_routes(ids, a, b) -> tuple:
    """Pairs of segments put in order of their routes' ids: the order, and where in it the pairs of two routes begin."""
    import numpy as np

    order = np.lexsort((ids[b], ids[a]))
    x, y = ids[a][order], ids[b][order]
    return order, np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))


def least_apart(ids, shape, a, b, apart) -> tuple:
    """Of the pairs of segments of two routes one with the least metres."""
    import numpy as np

    order, first = by_routes(ids, a, b)
    least = np.minimum.reduceat(apart[order], first)
    return a[order][first], b[order][first], least


#: Degrees by which segments may be farther apart than the closest ones, and still be as close but for rounding.
TIED = 1e-9


def closest(ids, shape, a, b, apart) -> tuple:
    """Of the pairs of segments of two routes those closest in degrees, all that may tie, each with the least metres of any."""
    import numpy as np

    order, first = by_routes(ids, a, b)
    n = np.diff([*first, len(order)])
    a, b = a[order], b[order]
    way = planar([x[a] for x in shape], [x[b] for x in shape])
    kept = way <= np.repeat(np.minimum.reduceat(way, first), n) + TIED
    return a[kept], b[kept], np.repeat(np.minimum.reduceat(apart[order], first), n)[kept]


def inside(p, q, r, s, strip: float) -> tuple:
    """Of the ways from p to q the share within the strip around r to s, first and last, and their length: ``corridor.inside`` in numpy, NaN for null."""
    import numpy as np

    (px, py), (qx, qy), (rx, ry), (sx, sy) = p, q, r, s
    with np.errstate(divide="ignore", invalid="ignore"):
        null = lambda x: np.where(x == 0, np.nan, x)
        dx, dy, way = qx - px, qy - py, null(np.sqrt((sx - rx) ** 2 + (sy - ry) ** 2))
        size, ux, uy = null(dx * dx + dy * dy), (sx - rx) / way, (sy - ry) / way
        lows, highs = [], []
        for cx, cy in (r, s):
            b, c = 2 * (dx * (px - cx) + dy * (py - cy)), (px - cx) ** 2 + (py - cy) ** 2 - strip * strip
            root = b * b - 4 * size * c
            root = np.sqrt(np.where(root >= 0, root, np.nan))
            lows.append(np.maximum(0.0, (-b - root) / (2 * size)))
            highs.append(np.minimum(1.0, (-b + root) / (2 * size)))
        low, high = [], []
        for v, d, lo, hi in (((px - rx) * ux + (py - ry) * uy, dx * ux + dy * uy, 0.0, way), (ux * (py - ry) - uy * (px - rx), ux * dy - uy * dx, -strip, strip)):
            one, two, along, within = (lo - v) / d, (hi - v) / d, np.abs(d) > 1e-9, (v >= lo) & (v <= hi)
            low.append(np.where(along, np.minimum(one, two), np.where(within, 0.0, np.nan)))
            high.append(np.where(along, np.maximum(one, two), np.where(within, 1.0, np.nan)))
        lows.append(np.maximum(0.0, np.maximum(*low)))
        highs.append(np.minimum(1.0, np.minimum(*high)))
        first, last = np.full(len(px), 2.0), np.full(len(px), -1.0)
        for lo, hi in zip(lows, highs):
            some = lo <= hi
            first, last = np.where(some, np.minimum(first, lo), first), np.where(some, np.maximum(last, hi), last)
        return first, last, np.sqrt(size)


def united(segment, first, last, valid) -> tuple:
    """Where the united intervals begin, and their ends, of intervals in order of their segment's number and their beginning; those not valid are 0 to 0 and last.

    A segment without a valid one has one of no length.
    """
    import numpy as np

    new = np.concatenate([[True], segment[1:] != segment[:-1]])
    end = np.maximum.accumulate(last + 4.0 * segment)  # so that no interval reaches into the next segment
    starts = np.flatnonzero(new | (valid & np.concatenate([[True], first[1:] + 4.0 * segment[1:] > end[:-1]])))
    return starts, np.maximum.reduceat(last, starts)


def shared(batches: Iterator) -> Iterator:
    """For ``mapInArrow``, rows of ``strips`` with the numbers of routes and segments (a_id, b_id, seg), sorted by in_, which two routes have alike: a_id, b_id, shared_km.

    Of each segment the length of its united intervals counts, of two routes the lesser sum.
    """
    import numpy as np
    import pyarrow as pa

    for table in whole_cells(batches):
        a, b, seg, side, first, last, length = (table.column(c).to_numpy() for c in ("a_id", "b_id", "seg", "side", "first", "last", "length"))
        valid = (last > first) & (length > 0)
        order = np.lexsort((first, ~valid, seg, side, b, a))
        a, b, seg, side, first, last, length, valid = (x[order] for x in (a, b, seg, side, first, last, length, valid))
        routes = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        new = routes | np.concatenate([[True], (side[1:] != side[:-1]) | (seg[1:] != seg[:-1])])
        segment = np.cumsum(new) - 1
        starts, end = united(segment, first, last, valid)
        covered = np.bincount(segment[starts], np.where(valid[starts], end - first[starts], 0.0))
        at = np.flatnonzero(new)
        metres, of, side = covered * np.maximum.reduceat(length, at), (np.cumsum(routes) - 1)[at], side[at]
        sums = [np.bincount(of[side == k], metres[side == k], minlength=int(routes.sum())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(a[routes]), pa.array(b[routes]), pa.array(np.minimum(*sums) / 1000)], ["a_id", "b_id", "shared_km"])


#: What ``strips`` says of a pair of segments: the side whose segment is in the strip around the other, from where to where (shares), and its length.
STRIPS = ("side", "first", "last", "length")


def strips(strip: float) -> Callable:
    """A ``reduced`` for ``pairs_within``: what each segment has in the strip around segments of another route, as intervals apart from each other.

    A segment without any has one row, of no length, since its two routes count.
    """

    def spans(ids, shape, a, b, apart) -> tuple:
        import numpy as np

        order, begin = by_routes(ids, a, b)
        a, b, apart = a[order], b[order], apart[order]
        routes = np.zeros(len(a), dtype=np.int64)
        routes[begin[1:]] = 1
        routes = np.cumsum(routes)
        lat1, lng1, lat2, lng2 = shape
        c = np.cos(np.radians((lat1[a] + lat2[a] + lat1[b] + lat2[b]) / 4))
        c2 = 2 * c * c - 1
        c3, c4 = c * (2 * c2 - 1), 2 * c2 * c2 - 1
        ky, kx = 111132.954 - 559.822 * c2 + 1.175 * c4, 111412.84 * c - 93.5 * c3 + 0.118 * (2 * c * c4 - c3)
        at = lambda lat, lng: ((lng - lng1[a]) * kx, (lat - lat1[a]) * ky)
        p, q, r, s = at(lat1[a], lng1[a]), at(lat2[a], lng2[a]), at(lat1[b], lng1[b]), at(lat2[b], lng2[b])
        first, last, length = (np.concatenate(x) for x in zip(inside(p, q, r, s, strip), inside(r, s, p, q, strip)))
        n = len(a)
        side, own, routes = np.repeat([0, 1], n), np.concatenate([a, b]), np.concatenate([routes, routes])
        valid = (last > first) & (length > 0)
        first, last, length = np.where(valid, first, 0.0), np.where(valid, last, 0.0), np.nan_to_num(length)
        order = np.lexsort((first, ~valid, own, side, routes))  # those of no length come last in a segment
        side, own, routes, first, last, length, valid, pair = (x[order] for x in (side, own, routes, first, last, length, valid, np.concatenate([np.arange(n), np.arange(n)])))
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (side[1:] != side[:-1]) | (routes[1:] != routes[:-1])])
        segment = np.cumsum(new) - 1
        longest = np.maximum.reduceat(length, np.flatnonzero(new))[segment]
        starts, last = united(segment, first, last, valid)
        a, b = a[pair[starts]], b[pair[starts]]
        return a, b, apart[pair[starts]], side[starts].astype(float), first[starts], last, longest[starts]

    return spans


def pairs_within(radius_m: float, sides: tuple[list[str], list[str]], ordered: bool, reduced: Callable | None = None, more: tuple[str, ...] = ()) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` over rows sorted by cell: each pair of a row of side 0 with one of side 1 of the cell, of other keys, within the radius.

    A pair that meets in several cells is kept in the first. ``sides``: the columns that a pair has of each; ``ordered``: only
    pairs with the lesser id at side 0, else all of unlike ids. ``reduced`` (``least_apart``, ``closest``) says which of the pairs
    found at once are handed on, as how far apart, and with what ``more`` (numbers).
    """

    def near(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for table in whole_cells(batches):
            rows = table.to_batches()[0]
            of = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
            keys = of("in_")
            g = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
            shape = [of(c).astype(float) for c in ("lat1", "lng1", "lat2", "lng2")]
            name = pc.dictionary_encode(rows.column("key_")).indices.fill_null(-1).to_numpy(zero_copy_only=False)
            usable = (name >= 0) & np.isfinite(np.stack(shape)).all(axis=0)
            spans = [of(c) for c in SPAN] if SPAN[0] in rows.schema.names else None
            differ = judge(rows) if OWNED in rows.schema.names else None
            side, ids, first_band, first_cell = of("side_"), of("id"), of("first_band_"), of("first_cell_")
            ia, ib = np.flatnonzero(usable & (side == 0)), np.flatnonzero(usable & (side == 1))
            if not len(ia) or not len(ib):
                continue
            south, north, west, east = np.minimum(shape[0], shape[2]), np.maximum(shape[0], shape[2]), np.minimum(shape[1], shape[3]), np.maximum(shape[1], shape[3])
            pad = radius_m / 110_000
            south[ia], north[ia] = south[ia] - pad, north[ia] + pad
            wide = pad / np.cos(np.radians(np.minimum(88.0, np.maximum(np.abs(south[ia]), np.abs(north[ia])))))
            west[ia], east[ia] = west[ia] - wide, east[ia] + wide
            for a, b in candidates(g, south, north, west, east, ia, ib, max(pad / 4, 1e-3)):
                fits = (ids[a] < ids[b] if ordered else ids[a] != ids[b]) & (name[a] != name[b])
                if spans is not None:
                    fits &= np.minimum(spans[1][a], spans[1][b]) >= np.maximum(spans[0][a], spans[0][b])
                a, b = a[fits], b[fits]
                fits = (south[b] <= north[a]) & (north[b] >= south[a]) & (west[b] <= east[a]) & (east[b] >= west[a])
                fits &= (first_band[a] | first_band[b]) & (first_cell[a] | first_cell[b])
                a, b = a[fits], b[fits]
                apart = metres([x[a] for x in shape], [x[b] for x in shape])
                fits = apart <= radius_m
                if differ is not None:
                    fits[fits] = differ(a[fits], b[fits])
                if not fits.any():
                    continue
                a, b, apart, said = a[fits], b[fits], apart[fits], []
                if reduced is not None:
                    a, b, apart, *said = reduced(ids, shape, a, b, apart)
                a, b = pa.array(a), pa.array(b)
                found = [rows.column(c).take(i) for i, names in ((a, sides[0]), (b, sides[1])) for c in names]
                out = pa.RecordBatch.from_arrays([*found, pa.array(apart), *map(pa.array, said)], [*(f"{s}_{c}" for s, names in zip("ab", sides) for c in names), "metres", *more])
                for i in range(0, out.num_rows, 65_536):
                    yield out.slice(i, 65_536)

    return near
