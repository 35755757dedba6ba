"""The rules once more, as plain loops over Python lists: what the Spark plans must equal."""

from __future__ import annotations

from collections import defaultdict
from datetime import datetime
from decimal import ROUND_HALF_EVEN, Decimal

LIMIT = 25


def java_hash(text: str) -> int:
    units = text.encode("utf-16-be")
    h = 0
    for i in range(0, len(units), 2):
        h = h * 31 + int.from_bytes(units[i : i + 2], "big")
    return int32(h)


def int32(n: int) -> int:
    n &= 0xFFFFFFFF
    return n - (1 << 32) if n >> 31 else n


def path_hash(path: str, rev: str) -> int:
    hi, lo = (path, rev) if path > rev else (rev, path)
    return int32(java_hash(hi) + 31 * java_hash(lo))


def round3(x: float) -> float:
    return float(Decimal(repr(x)).quantize(Decimal("0.001"), rounding=ROUND_HALF_EVEN))


def speed(distance: float, seconds: int) -> float | None:
    return distance * 3600 / seconds if seconds else None


def seconds(t: datetime) -> int:
    return int((t - datetime(1970, 1, 1)).total_seconds())


def multimap(edges) -> dict:
    found = defaultdict(list)
    for source, target, distance in edges:
        found[source, target].append(distance)
    return found


def by_trip(readings) -> dict:
    """readings: (reading_id, entity, type, time, place)."""
    trips = defaultdict(list)
    for r in readings:
        trips[r[1], r[3].date()].append(r)
    return {key: sorted(rows, key=lambda r: (r[3], r[0])) for key, rows in trips.items()}


def legs(rows, edges, pick="lowest"):
    """[(time, place, elapsed, distance, speed)] of one trip's ordered readings."""
    out, before = [], None
    for r in rows:
        elapsed, candidates = 0, []
        if before is not None:
            elapsed = seconds(r[3]) - seconds(before[3])
            candidates = edges.get((before[4], r[4]), [])
        best = None
        for d in candidates:
            if elapsed == 0:
                continue
            v = d * 3600 / elapsed
            rank = v if pick == "lowest" else (abs(v - LIMIT), d)
            if best is None or rank < best[0]:
                best = (rank, d, v)
        out.append((r[3], r[4], elapsed, best[1] if best else 0.0, best[2] if best else 0.0))
        before = r
    return out


def summary(readings, edges, pick="lowest") -> list[dict]:
    out = []
    for (entity, date), rows in by_trip(readings).items():
        way = legs(rows, edges, pick)
        places = [leg[1] for leg in way]
        distance = sum(leg[3] for leg in way)
        time = seconds(rows[-1][3]) - seconds(rows[0][3])
        path, rev = ":".join(places), ":".join(places[::-1])
        out.append(
            dict(
                entity_id=entity,
                entity_type=rows[-1][2],
                date=date,
                total_time=time,
                total_distance=round3(distance),
                avg_speed=speed(distance, time),
                path=path,
                path_rev=rev,
                path_hash=path_hash(path, rev),
                day_of_week=date.strftime("%A").lower(),
                start_place=places[0],
                end_place=places[-1],
                start_time=rows[0][3],
                end_time=rows[-1][3],
                legs=way,
            )
        )
    return out


def is_good(t) -> bool:
    def boundary(p):
        return p == "ranger-base" or "camping" in p or "entrance" in p

    return (
        boundary(t["start_place"])
        and boundary(t["end_place"])
        and t["start_time"] != t["end_time"]
    )


def is_candidate(t) -> bool:
    def outer(p):
        return p == "ranger-base" or "entrance" in p

    return not (outer(t["start_place"]) and outer(t["end_place"]))


def ends_stitch(t, previous) -> bool:
    end = t["end_place"]
    jumped = previous["end_place"] != t["start_place"]
    return "entrance" in end or ("ranger-base" in end and jumped)


def ends_visit(t, previous) -> bool:
    return "entrance" in t["end_place"] or "ranger-base" in t["end_place"]


def segments(trips, closes) -> list[list[dict]]:
    """Of one entity, walking in start order."""
    done, group = [], []
    for t in sorted(trips, key=lambda t: t["start_time"]):
        group.append(t)
        if len(group) > 1 and closes(t, group[-2]):
            done.append(group)
            group = []
    return done + ([group] if group else [])


def per_entity(trips) -> dict:
    out = defaultdict(list)
    for t in trips:
        out[t["entity_id"]].append(t)
    return out


def merge(group) -> dict:
    first, last = group[0], group[-1]
    time = sum(t["total_time"] for t in group)
    distance = sum(t["total_distance"] for t in group)
    path = ":".join(t["path"] for t in group)
    rev = ":".join(t["path_rev"] for t in group)
    return dict(
        entity_id=first["entity_id"],
        entity_type=first["entity_type"],
        date=first["date"],
        total_time=time,
        total_distance=round3(distance),
        avg_speed=speed(distance, time),
        path=path,
        path_rev=rev,
        path_hash=path_hash(path, rev),
        day_of_week=first["start_time"].strftime("%A").lower(),
        start_place=first["start_place"],
        end_place=last["end_place"],
        start_time=first["start_time"],
        end_time=last["end_time"],
    )


def stitched(trips) -> list[dict]:
    stranded = per_entity(t for t in trips if not is_good(t))
    return [merge(g) for own in stranded.values() for g in segments(own, ends_stitch)]


def repaired(trips) -> list[dict]:
    return stitched(trips) + [t for t in trips if is_good(t)]


def visits(repaired_trips) -> list[dict]:
    out = []
    for own in per_entity(t for t in repaired_trips if is_candidate(t)).values():
        for group in segments(own, ends_visit):
            first, last = group[0], group[-1]
            day, days, before = 0, [], None
            for t in group:
                since = (t["start_time"].date() - before).days if before else 0
                day += since
                before = t["start_time"].date()
                days.append((since, day, t["start_time"], t["path_hash"], t["total_distance"]))
            time = sum(t["total_time"] for t in group)
            distance = sum(t["total_distance"] for t in group)
            path = "||".join(t["path"] for t in group)
            rev = "||".join(t["path_rev"] for t in group)
            stops = [t["end_place"] for t in group[:-1]]
            out.append(
                dict(
                    entity_id=first["entity_id"],
                    entity_type=first["entity_type"],
                    total_days=day,
                    total_time=time,
                    total_distance=distance,
                    avg_speed=speed(distance, time),
                    days=days,
                    path=path,
                    path_hash=path_hash(path, rev),
                    start_place=first["start_place"],
                    end_place=last["end_place"],
                    start_time=first["start_time"],
                    end_time=last["end_time"],
                    destinations=stops,
                    destination_string=",".join(stops),
                )
            )
    return out


def itineraries(trips) -> list[dict]:
    out = []
    for entity, own in per_entity(trips).items():
        own = sorted(own, key=lambda t: t["start_time"])
        day, days, way, total = 0, [], [], 0
        for i, t in enumerate(own):
            since = (t["start_time"] - own[i - 1]["start_time"]).days if i else 0
            day += since
            days.append((since, day, t["start_time"], t["path_hash"]))
            ahead = (own[i + 1]["start_time"] - t["start_time"]).days if i + 1 < len(own) else 0
            way += [(*leg, ahead) for leg in t["legs"]]
            total += 31 * t["path_hash"]
        time = sum(t["total_time"] for t in own)
        distance = sum(t["total_distance"] for t in own)
        out.append(
            dict(
                entity_id=entity,
                total_days=day,
                total_time=time,
                total_distance=distance,
                avg_speed=speed(distance, time),
                days=days,
                legs=way,
                path="||".join(t["path"] for t in own),
                path_hash=int32(total),
                start_place=own[0]["start_place"],
                end_place=own[-1]["end_place"],
                start_time=own[0]["start_time"],
                end_time=own[-1]["end_time"],
            )
        )
    return out
