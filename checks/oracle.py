"""DuckDB SQL for the queries, over the supplied tables.

Statements are chains of named steps. `with_steps` puts together the steps a final SELECT needs.
"""

from __future__ import annotations

from checks.stand_in import NUMBERED, PLACE_OF, edge_values

_CASES = " ".join(f"WHEN '{e}' THEN '{p}'" for e, p in PLACE_OF.items())


def _bits(text: str) -> str:
    """Unsigned 32-bit base 31 hash of an ASCII text."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)"
    return (
        f"list_reduce(list_prepend(0::BIGINT, {codes}), "
        "lambda h, c: (h * 31 + c) & 4294967295)"
    )


def _signed(bits: str) -> str:
    low = f"(({bits}) & 4294967295)"
    return f"CASE WHEN {low} > 2147483647 THEN {low} - 4294967296 ELSE {low} END"


def _path_hash(path: str, rev: str) -> str:
    greater, lesser = f"greatest({path}, {rev})", f"least({path}, {rev})"
    return _signed(f"{_bits(greater)} + 31 * {_bits(lesser)}")


def _speed(distance: str, seconds: str) -> str:
    return f"{distance} * 3600 / nullif({seconds}, 0)"


def _sum(rounded: str) -> str:
    """Sum of rounded values, independent of their order."""
    return f"CAST(sum(CAST(round({rounded} * 1000000) AS BIGINT)) AS DOUBLE) / 1000000"


def _unix(ts: str) -> str:
    return f"CAST(epoch({ts}) AS BIGINT)"


def _day(day: str) -> str:
    return f"strftime({day}, '%Y-%m-%d')"


def _dow(day: str) -> str:
    return f"lower(dayname({day}))"


def _boundary(p: str) -> str:
    return f"(contains({p}, 'entrance') OR contains({p}, 'camping') OR {p} = 'ranger-base')"


def _outer(p: str) -> str:
    return f"(contains({p}, 'entrance') OR {p} = 'ranger-base')"


_AT_DAY = "PARTITION BY entity_id, date ORDER BY ts, reading_id"

# Segments by runs of rows that may close, and parity inside a run.


def _segments(source: str, closes: str, prefix: str) -> dict[str, str]:
    by_start = "PARTITION BY entity_id ORDER BY start_time, date"
    return {
        f"{prefix}_flag": f"""
            SELECT *, coalesce(prev_end IS NOT NULL AND ({closes}), FALSE) AS may_close
            FROM (SELECT *, lag(end_place) OVER ({by_start}) AS prev_end FROM {source})""",
        f"{prefix}_run": f"""
            SELECT *, sum(CASE WHEN may_close THEN 0 ELSE 1 END) OVER ({by_start}) AS run
            FROM {prefix}_flag""",
        f"{prefix}_close": f"""
            SELECT *, may_close AND (sum(may_close::INT) OVER
                (PARTITION BY entity_id, run ORDER BY start_time, date)) % 2 = 1 AS does_close
            FROM {prefix}_run""",
        f"{prefix}_seg": f"""
            SELECT *, coalesce(sum(does_close::INT) OVER ({by_start}
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment
            FROM {prefix}_close""",
    }


def _trips(legs: str) -> str:
    return f"""
        SELECT *, {_path_hash('path', 'path_rev')} AS path_hash, {_dow('date')} AS day_of_week,
            round_even(distance, 3) AS total_distance,
            {_speed('distance', 'total_time')} AS avg_speed
        FROM (
            SELECT entity_id, date, arg_max(entity_type, pos) AS entity_type,
                min(ts) AS start_time, max(ts) AS end_time,
                {_unix('max(ts)')} - {_unix('min(ts)')} AS total_time,
                sum(distance) AS distance,
                string_agg(place, ':' ORDER BY pos) AS path,
                string_agg(place, ':' ORDER BY pos DESC) AS path_rev,
                arg_min(place, pos) AS start_place, arg_max(place, pos) AS end_place
            FROM {legs} GROUP BY entity_id, date)"""


_GOOD = f"({_boundary('start_place')} AND {_boundary('end_place')} AND start_time <> end_time)"

_TRIP_COLS = (
    "entity_id, entity_type, date, total_time, total_distance, avg_speed, path, path_rev, "
    "path_hash, day_of_week, start_place, end_place, start_time, end_time"
)

_STEPS: dict[str, str] = {
    "readings": f"""
        SELECT event_id AS reading_id, user_id AS entity_id, 't' || (user_id % 3) AS entity_type,
            date_trunc('second', ts) AS ts, CASE event_type {_CASES} END AS place,
            CAST(ts AS DATE) AS date
        FROM events""",
    "ordered": f"""
        SELECT *, row_number() OVER ({_AT_DAY}) AS pos, lag(ts) OVER ({_AT_DAY}) AS prev_ts,
            lag(place) OVER ({_AT_DAY}) AS prev_place
        FROM readings""",
    "edges": f"SELECT * FROM (VALUES {edge_values()}) AS e(source, target, distance)",
    "lookup": """
        SELECT source, target, list(distance ORDER BY distance) AS distances,
            min(distance) AS min_distance
        FROM edges GROUP BY source, target""",
    "located": f"""
        SELECT o.*, coalesce({_unix('ts')} - {_unix('prev_ts')}, 0) AS elapsed,
            l.distances, l.min_distance
        FROM ordered o LEFT JOIN lookup l ON o.prev_place = l.source AND o.place = l.target""",
    "lowest": """
        SELECT *, CASE WHEN elapsed > 0 THEN coalesce(min_distance, 0.0) ELSE 0.0 END::DOUBLE
            AS distance
        FROM located""",
    "tried": """
        SELECT l.entity_id, l.date, l.pos, e.distance,
            row_number() OVER (PARTITION BY l.entity_id, l.date, l.pos
                ORDER BY abs(e.distance * 3600 / l.elapsed - 25), e.distance) AS choice
        FROM located l JOIN edges e ON l.prev_place = e.source AND l.place = e.target
        WHERE l.elapsed > 0""",
    "closest": """
        SELECT l.*, coalesce(t.distance, 0.0)::DOUBLE AS distance
        FROM located l LEFT JOIN tried t
            ON t.choice = 1 AND l.entity_id = t.entity_id AND l.date = t.date AND l.pos = t.pos""",
    "trips": _trips("lowest"),
    "trips_closest": _trips("closest"),
    "good": f"SELECT {_TRIP_COLS} FROM trips WHERE {_GOOD}",
    "stranded": f"SELECT {_TRIP_COLS} FROM trips WHERE NOT {_GOOD}",
    **_segments(
        "stranded",
        "contains(end_place, 'entrance') OR "
        "(contains(end_place, 'ranger-base') AND prev_end <> start_place)",
        "stitch",
    ),
    "stitched": f"""
        SELECT *, {_path_hash('path', 'path_rev')} AS path_hash,
            {_dow('start_time')} AS day_of_week,
            round_even(distance, 3) AS total_distance,
            {_speed('distance', 'total_time')} AS avg_speed
        FROM (
            SELECT entity_id, segment, arg_min(entity_type, start_time) AS entity_type,
                min(date) AS date, CAST(sum(total_time) AS BIGINT) AS total_time,
                {_sum('total_distance')} AS distance,
                string_agg(path, ':' ORDER BY start_time) AS path,
                string_agg(path_rev, ':' ORDER BY start_time) AS path_rev,
                arg_min(start_place, start_time) AS start_place,
                arg_max(end_place, start_time) AS end_place,
                min(start_time) AS start_time, arg_max(end_time, start_time) AS end_time
            FROM stitch_seg GROUP BY entity_id, segment)""",
    "repaired": f"SELECT {_TRIP_COLS} FROM good UNION ALL SELECT {_TRIP_COLS} FROM stitched",
    "candidates": f"""
        SELECT * FROM repaired WHERE NOT ({_outer('start_place')} AND {_outer('end_place')})""",
    **_segments(
        "candidates",
        "contains(end_place, 'entrance') OR contains(end_place, 'ranger-base')",
        "visit",
    ),
    "visit_rows": """
        SELECT *, row_number() OVER w AS pos, count(*) OVER v AS n,
            min(start_time) OVER v AS visit_start,
            lag(start_time) OVER w AS prev_start
        FROM visit_seg
        WINDOW w AS (PARTITION BY entity_id, segment ORDER BY start_time),
            v AS (PARTITION BY entity_id, segment)""",
    "visit_days": """
        SELECT *,
            coalesce(datediff('day', CAST(prev_start AS DATE), CAST(start_time AS DATE)), 0)
                AS days_since,
            datediff('day', CAST(visit_start AS DATE), CAST(start_time AS DATE)) AS day_in_visit
        FROM visit_rows""",
    "visits": f"""
        SELECT *, {_path_hash('path', 'path_rev')} AS path_hash,
            {_speed('total_distance', 'total_time')} AS avg_speed
        FROM (
            SELECT entity_id, segment, arg_min(entity_type, start_time) AS entity_type,
                max(day_in_visit) AS total_days, CAST(sum(total_time) AS BIGINT) AS total_time,
                {_sum('total_distance')} AS total_distance,
                string_agg(path, '||' ORDER BY pos) AS path,
                string_agg(path_rev, '||' ORDER BY pos) AS path_rev,
                arg_min(start_place, start_time) AS start_place,
                arg_max(end_place, start_time) AS end_place,
                min(start_time) AS start_time, arg_max(end_time, start_time) AS end_time,
                coalesce(string_agg(end_place, ',' ORDER BY pos) FILTER (pos < n), '')
                    AS destination_string
            FROM visit_days GROUP BY entity_id, segment)""",
    "days": """
        SELECT *,
            coalesce(datesub('day', lag(start_time) OVER w, start_time), 0) AS days_since,
            coalesce(datesub('day', start_time, lead(start_time) OVER w), 0) AS days_to_next
        FROM trips WINDOW w AS (PARTITION BY entity_id ORDER BY start_time, date)""",
    "numbered_days": """
        SELECT *, CAST(sum(days_since) OVER (PARTITION BY entity_id ORDER BY start_time, date)
            AS BIGINT) AS day_in_visit
        FROM days""",
}

_USES = {
    "ordered": ["readings"],
    "lookup": ["edges"],
    "located": ["ordered", "lookup"],
    "lowest": ["located"],
    "tried": ["located", "edges"],
    "closest": ["located", "tried"],
    "trips": ["lowest"],
    "trips_closest": ["closest"],
    "good": ["trips"],
    "stranded": ["trips"],
    "stitch_flag": ["stranded"],
    "stitch_run": ["stitch_flag"],
    "stitch_close": ["stitch_run"],
    "stitch_seg": ["stitch_close"],
    "stitched": ["stitch_seg"],
    "repaired": ["good", "stitched"],
    "candidates": ["repaired"],
    "visit_flag": ["candidates"],
    "visit_run": ["visit_flag"],
    "visit_close": ["visit_run"],
    "visit_seg": ["visit_close"],
    "visit_rows": ["visit_seg"],
    "visit_days": ["visit_rows"],
    "visits": ["visit_days"],
    "days": ["trips"],
    "numbered_days": ["days"],
}


_NAMES = "[" + ", ".join(f"'{p}'" for p in NUMBERED) + "]"
_PLACE_EDGES = f"""SELECT {_NAMES}[(p_partkey % 5)::INT + 1] AS source,
    {_NAMES}[(p_size % 5)::INT + 1] AS target, p_size / 16 AS distance FROM part"""


def with_steps(select: str, *last: str, edges: str | None = None, readings: str | None = None) -> str:
    needed: list[str] = []

    def need(step: str) -> None:
        for used in _USES.get(step, []):
            need(used)
        if step not in needed:
            needed.append(step)

    for step in last:
        need(step)
    steps = _STEPS | ({"edges": edges} if edges else {}) | ({"readings": readings} if readings else {})
    ctes = ",\n".join(f"{step} AS ({steps[step]})" for step in needed)
    return f"WITH {ctes}\n{select}"


_TRIP_OUT = (
    f"entity_id, entity_type, {_day('date')} AS date, total_time, total_distance, avg_speed, "
    "path, path_rev, path_hash, day_of_week, start_place, end_place, "
    f"{_unix('start_time')} AS start_time, {_unix('end_time')} AS end_time"
)
_TOTALS_OUT = (
    f"entity_id, entity_type, {_day('date')} AS date, total_time, total_distance, avg_speed, "
    f"path_hash, day_of_week, start_place, end_place, {_unix('start_time')} AS start_time, "
    f"{_unix('end_time')} AS end_time"
)
_ROW = f"entity_id, {_day('date')} AS date, entity_type, pos"
_TIMED = f"{_unix('ts')} AS ts, place"
_STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
_ELAPSED = f"coalesce({_unix('ts')} - {_unix('prev_ts')}, 0)"
_DAILY = (
    f"start_place, end_place, days_since, day_in_visit, {_unix('start_time')} AS start_time, "
    f"{_unix('end_time')} AS end_time, path, path_hash AS hash, total_distance, total_time, "
    "avg_speed, day_of_week"
)
_BOTH_WAYS = """
    SELECT entity_id, date, arg_max(entity_type, pos) AS entity_type,
        string_agg(place, ':' ORDER BY pos) AS path,
        string_agg(place, ':' ORDER BY pos DESC) AS path_rev
    FROM ordered GROUP BY entity_id, date"""
_PARTS = "SELECT p_brand AS source, p_type AS target, p_size / 16 AS distance FROM part"
_BROKEN = """
    SELECT *, CASE distance_text WHEN 'far' THEN 'unreadable distance' WHEN 'NaN' THEN 'distance not finite'
        WHEN 'Infinity' THEN 'distance not finite' WHEN '1e21' THEN 'distance out of range' END AS reason,
        CASE WHEN distance_text = '-2' THEN -2 ELSE p_size / 16 END AS distance
    FROM (SELECT p_brand AS source, p_type AS target, p_size,
        CASE WHEN p_partkey % 13 = 0 THEN 'NaN' WHEN p_partkey % 11 = 0 THEN 'Infinity'
            WHEN p_partkey % 7 = 0 THEN 'far' WHEN p_partkey % 5 = 0 THEN '1e21'
            WHEN p_partkey % 3 = 0 THEN '-2' END AS distance_text FROM part)"""
_PATH_RECORD = f"""
    SELECT entity_id, date, arg_max(entity_type, pos) AS entity_type,
        {_unix('max(ts)')} - {_unix('min(ts)')} AS total_time,
        string_agg(place, ':' ORDER BY pos) AS path,
        string_agg(place, ':' ORDER BY pos DESC) AS path_rev,
        string_agg(coalesce(len(distances), 0)::VARCHAR, ';' ORDER BY pos) AS candidate_counts
    FROM located GROUP BY entity_id, date"""
_PATH_RECORD_OUT = f"""entity_id, {_day('date')} AS date, entity_type, total_time, path, path_rev,
    {_path_hash('path', 'path_rev')} AS path_hash, {_dow('date')} AS day_of_week"""


#: The readings that the job's input has unbroken, as the job reads them.
_UNBROKEN = f"""SELECT * REPLACE (entity_id::VARCHAR AS entity_id) FROM ({_STEPS['readings']})
    WHERE reading_id % 3 <> 0 AND reading_id % 5 <> 0 AND reading_id % 7 <> 0"""
#: Days that the trips by date are read for.
SOME_DAYS = ("2024-01-05", "2024-01-20")
_ISO = "'%Y-%m-%dT%H:%M:%SZ'"


def statements() -> dict[str, str]:
    found = {
        "readings_normalised": with_steps(
            f"""SELECT reading_id, entity_id::VARCHAR AS entity_id, entity_type, place,
                {_day('date')} AS date, {_unix('ts')} AS unix_time, {_STAMP} AS datetime
            FROM readings""",
            "readings",
        ),
        "readings_rejected": with_steps(
            """SELECT reading_id, CASE WHEN reading_id % 5 <> 0 THEN entity_id::VARCHAR END AS entity_id,
                entity_type, CASE WHEN reading_id % 3 <> 0 THEN place END AS place,
                CASE WHEN reading_id % 7 = 0 THEN 'no time'
                    WHEN reading_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                    ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS time_text,
                CASE WHEN reading_id % 5 = 0 THEN 'no entity' WHEN reading_id % 3 = 0 THEN 'no place'
                    ELSE 'unreadable time' END AS reason
            FROM readings
            WHERE reading_id % 3 = 0 OR reading_id % 5 = 0 OR reading_id % 7 = 0""",
            "readings",
        ),
        "readings_dow": with_steps(
            f"""SELECT reading_id, entity_id, entity_type, {_TIMED}, {_day('date')} AS date,
                {_dow('ts')} AS day_of_week
            FROM readings""",
            "readings",
        ),
        "edges_usable": f"SELECT source, target, distance FROM ({_BROKEN}) WHERE reason IS NULL",
        "edges_rejected": f"SELECT source, target, distance_text, reason FROM ({_BROKEN}) WHERE reason IS NOT NULL",
        "edge_candidates": f"""
            SELECT source, target, distance, count(*) AS copies
            FROM ({_PARTS}) GROUP BY source, target, distance""",
        "edge_distances": f"""
            SELECT source, target, min(distance) OVER (PARTITION BY source, target)
                    AS min_distance,
                row_number() OVER (PARTITION BY source, target ORDER BY distance) - 1 AS pos,
                distance
            FROM ({_PARTS})""",
        "trip_timeline": with_steps(f"SELECT {_ROW}, {_TIMED} FROM ordered", "ordered"),
        "trip_timeline_records": with_steps(
            f"""SELECT entity_id, {_day('date')} AS date, arg_max(entity_type, pos) AS entity_type,
                string_agg({_STAMP} || '@' || place, ';' ORDER BY pos) AS timeline
            FROM ordered GROUP BY entity_id, date""",
            "ordered",
        ),
        "trip_timeline_elapsed": with_steps(
            f"SELECT {_ROW}, {_TIMED}, {_ELAPSED} AS elapsed FROM ordered", "ordered"
        ),
        "trip_timeline_elapsed_records": with_steps(
            f"""SELECT entity_id, {_day('date')} AS date, arg_max(entity_type, pos) AS entity_type,
                {_unix('max(ts)')} - {_unix('min(ts)')} AS total_time,
                string_agg({_STAMP} || '@' || place || '@' || {_ELAPSED}, ';' ORDER BY pos DESC)
                    AS timeline
            FROM ordered GROUP BY entity_id, date""",
            "ordered",
        ),
        "trip_path_array": with_steps(f"SELECT {_ROW}, place FROM ordered", "ordered"),
        "trip_path_string": with_steps(
            f"SELECT entity_id, {_day('date')} AS date, entity_type, path FROM ({_BOTH_WAYS})",
            "ordered",
        ),
        "path_frequency": with_steps(
            f"""SELECT greatest(path, path_rev) AS path, count(*) AS count
            FROM ({_BOTH_WAYS}) GROUP BY ALL""",
            "ordered",
        ),
        "path_frequency_rows": with_steps(
            f"""SELECT trip.entity_id AS entity_id, {_day('trip.date')} AS date, count,
                unnest(range(1, len(words) + 1)) AS pos, unnest(words) AS place
            FROM (
                SELECT string_split(greatest(path, path_rev), ':') AS words, count(*) AS count,
                    min({{'entity_id': entity_id, 'date': date}}) AS trip
                FROM ({_BOTH_WAYS}) GROUP BY words)""",
            "ordered",
        ),
        "path_signature": with_steps(
            f"""SELECT entity_id, {_day('date')} AS date, entity_type, path, path_rev,
                {_path_hash('path', 'path_rev')} AS path_hash, {_dow('date')} AS day_of_week
            FROM ({_BOTH_WAYS})""",
            "ordered",
        ),
        "trip_legs": with_steps(
            f"""SELECT {_ROW}, {_TIMED}, elapsed, coalesce(min_distance, 0.0)::DOUBLE AS distance,
                {_speed('coalesce(min_distance, 0.0)::DOUBLE', 'elapsed')} AS speed
            FROM located""",
            "located",
        ),
        "trip_legs_records": with_steps(
            f"SELECT {_PATH_RECORD_OUT} FROM ({_PATH_RECORD})", "located"
        ),
        "trip_leg_candidates": with_steps(
            f"""SELECT entity_id, {_day('date')} AS date, entity_type, pos, {_TIMED}, elapsed,
                CASE WHEN e.distance IS NOT NULL THEN row_number() OVER
                    (PARTITION BY entity_id, date, pos ORDER BY e.distance) END AS candidate,
                e.distance AS distance, {_speed('e.distance', 'elapsed')} AS speed
            FROM located l LEFT JOIN edges e ON l.prev_place = e.source AND l.place = e.target""",
            "located",
        ),
        "trip_leg_candidates_records": with_steps(
            f"SELECT {_PATH_RECORD_OUT}, candidate_counts FROM ({_PATH_RECORD})", "located"
        ),
        "trip_summary": with_steps(f"SELECT {_TRIP_OUT} FROM trips", "trips"),
        "trip_summary_closest": with_steps(
            f"SELECT {_TRIP_OUT} FROM trips_closest", "trips_closest"
        ),
        "good_trips": with_steps(f"SELECT {_TRIP_OUT} FROM good", "good"),
        "stranded_trips": with_steps(f"SELECT {_TRIP_OUT} FROM stranded", "stranded"),
        "stitched_trips": with_steps(f"SELECT {_TRIP_OUT} FROM stitched", "stitched"),
        "repaired_trips": with_steps(f"SELECT {_TRIP_OUT} FROM repaired", "repaired"),
        "visit_candidates": with_steps(f"SELECT {_TRIP_OUT} FROM candidates", "candidates"),
        "visits": with_steps(
            f"""SELECT entity_id, entity_type, total_days, total_time, total_distance, avg_speed,
                path, path_hash, start_place, end_place, {_unix('start_time')} AS start_time,
                {_unix('end_time')} AS end_time, destination_string
            FROM visits""",
            "visits",
        ),
        "visits_export": with_steps(
            """SELECT entity_id, strftime(start_time, '%Y-%m-%dT%H:%M:%SZ') AS start_time,
                strftime(end_time, '%Y-%m-%dT%H:%M:%SZ') AS end_time, destination_string
            FROM visits""",
            "visits",
        ),
        "visit_days": with_steps(
            f"SELECT entity_id, {_unix('visit_start')} AS visit_start, pos, {_DAILY} "
            "FROM visit_days",
            "visit_days",
        ),
        "visit_destinations": with_steps(
            f"""SELECT entity_id, {_unix('visit_start')} AS visit_start, pos,
                end_place AS destination
            FROM visit_days WHERE pos < n""",
            "visit_days",
        ),
        "entity_path_rollup": with_steps(
            f"""SELECT entity_id, arg_max(entity_type, date) AS entity_type,
                count(*) AS days_span, string_agg(path, '||' ORDER BY date) AS path
            FROM ({_BOTH_WAYS}) GROUP BY entity_id""",
            "ordered",
        ),
        "itinerary": with_steps(
            f"""SELECT entity_id, arg_max(entity_type, start_time) AS entity_type,
                CAST(sum(days_since) AS BIGINT) AS total_days,
                CAST(sum(total_time) AS BIGINT) AS total_time,
                {_sum('total_distance')} AS total_distance,
                {_speed('(' + _sum('total_distance') + ')', 'sum(total_time)')} AS avg_speed,
                string_agg(path, '||' ORDER BY start_time) AS path,
                {_signed('CAST(sum(path_hash * 31) AS BIGINT)')} AS path_hash,
                arg_min(start_place, start_time) AS start_place,
                arg_max(end_place, start_time) AS end_place,
                {_unix('min(start_time)')} AS start_time,
                {_unix('arg_max(end_time, start_time)')} AS end_time
            FROM days GROUP BY entity_id""",
            "days",
        ),
        "itinerary_days": with_steps(
            f"SELECT entity_id, {_day('date')} AS date, {_DAILY} FROM numbered_days",
            "numbered_days",
        ),
        "itinerary_legs": with_steps(
            f"""SELECT l.entity_id, {_day('l.date')} AS date, l.pos, {_TIMED}, l.elapsed,
                l.distance, coalesce({_speed('l.distance', 'l.elapsed')}, 0) AS speed,
                d.days_to_next
            FROM lowest l JOIN days d ON l.entity_id = d.entity_id AND l.date = d.date""",
            "lowest",
            "days",
        ),
    }
    # Totals without paths, and what the nested lists hold.
    found |= {
        "trip_totals": with_steps(f"SELECT {_TOTALS_OUT} FROM trips", "trips"),
        "repaired_totals": with_steps(f"SELECT {_TOTALS_OUT} FROM repaired", "repaired"),
        "visit_totals": with_steps(
            f"""SELECT entity_id, entity_type, total_days, total_time, total_distance, avg_speed,
                path_hash, start_place, end_place, {_unix('start_time')} AS start_time,
                {_unix('end_time')} AS end_time
            FROM visits""",
            "visits",
        ),
        "itinerary_totals": with_steps(
            f"""SELECT entity_id, arg_max(entity_type, start_time) AS entity_type,
                CAST(sum(days_since) AS BIGINT) AS total_days,
                CAST(sum(total_time) AS BIGINT) AS total_time,
                {_sum('total_distance')} AS total_distance,
                {_speed('(' + _sum('total_distance') + ')', 'sum(total_time)')} AS avg_speed,
                {_signed('CAST(sum(path_hash * 31) AS BIGINT)')} AS path_hash,
                arg_min(start_place, start_time) AS start_place,
                arg_max(end_place, start_time) AS end_place,
                {_unix('min(start_time)')} AS start_time,
                {_unix('arg_max(end_time, start_time)')} AS end_time
            FROM days GROUP BY entity_id""",
            "days",
        ),
        "entity_path_rows": with_steps(
            f"""SELECT o.entity_id, {_day('o.date')} AS date, d.days_span, d.day, o.pos, o.place
            FROM ordered o JOIN (
                SELECT entity_id, date, count(*) OVER (PARTITION BY entity_id) AS days_span,
                    row_number() OVER (PARTITION BY entity_id ORDER BY date) AS day
                FROM ordered GROUP BY entity_id, date) d
            ON o.entity_id = d.entity_id AND o.date = d.date""",
            "ordered",
        ),
        "trip_legs_list": with_steps(
            f"""SELECT entity_id, {_day('date')} AS date, pos, {_TIMED}, elapsed,
                coalesce(min_distance, 0.0)::DOUBLE AS distance,
                {_speed('coalesce(min_distance, 0.0)::DOUBLE', 'elapsed')} AS speed
            FROM located""",
            "located",
        ),
        "trip_leg_candidates_list": with_steps(
            f"""SELECT entity_id, {_day('date')} AS date, pos, {_TIMED}, elapsed,
                CASE WHEN e.distance IS NOT NULL THEN row_number() OVER
                    (PARTITION BY entity_id, date, pos ORDER BY e.distance) END AS candidate,
                e.distance AS distance, {_speed('e.distance', 'elapsed')} AS speed
            FROM located l LEFT JOIN edges e ON l.prev_place = e.source AND l.place = e.target""",
            "located",
        ),
        "itinerary_timed_path": with_steps(
            f"""SELECT l.entity_id, {_TIMED}, l.elapsed, l.distance, d.days_to_next,
                row_number() OVER (PARTITION BY l.entity_id ORDER BY l.date, l.pos) AS pos,
                coalesce({_speed('l.distance', 'l.elapsed')}, 0) AS speed
            FROM lowest l JOIN days d ON l.entity_id = d.entity_id AND l.date = d.date""",
            "lowest",
            "days",
        ),
        "itinerary_daily_records": with_steps(
            f"""SELECT entity_id, {_DAILY},
                row_number() OVER (PARTITION BY entity_id ORDER BY date) AS pos
            FROM numbered_days""",
            "numbered_days",
        ),
        "trip_summary_part_edges": with_steps(
            f"SELECT {_TRIP_OUT} FROM trips", "trips", edges=_PLACE_EDGES
        ),
    }
    found |= {
        "job_visits": with_steps(
            f"""SELECT entity_id, strftime(start_time, {_ISO}) AS start_time, strftime(end_time, {_ISO}) AS end_time,
                total_time, total_distance, path, path_hash, destination_string
            FROM visits""",
            "visits",
            readings=_UNBROKEN,
        ),
        "job_trips": with_steps(
            f"""SELECT entity_id, {_day('date')} AS date, strftime(start_time, {_ISO}) AS start_time,
                strftime(end_time, {_ISO}) AS end_time, total_time, total_distance, path, path_hash, day_of_week
            FROM repaired""",
            "repaired",
            readings=_UNBROKEN,
        ),
        "job_dated_trips": with_steps(
            f"""SELECT entity_id, {_day('date')} AS date, path, path_hash FROM repaired
            WHERE date BETWEEN DATE '{SOME_DAYS[0]}' AND DATE '{SOME_DAYS[1]}'""",
            "repaired",
            readings=_UNBROKEN,
        ),
        "job_counts": with_steps(
            """SELECT 'readings' AS what, (SELECT count(*) FROM readings) AS n
            UNION ALL SELECT 'rejected_readings', (SELECT count(*) FROM events) - (SELECT count(*) FROM readings)
            UNION ALL SELECT 'edges', (SELECT count(*) FROM edges)
            UNION ALL SELECT 'rejected_edges', 0
            UNION ALL SELECT 'repaired_trips', (SELECT count(*) FROM repaired)
            UNION ALL SELECT 'visits', (SELECT count(*) FROM visits)""",
            "visits",
            readings=_UNBROKEN,
        ),
        "itinerary_day_chunks": with_steps(
            f"""SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY date) AS pos,
                {_DAILY.replace('path, path_hash', 'path_hash')}
            FROM numbered_days""",
            "numbered_days",
        ),
    }
    # Other plans for the same results.
    found["itinerary_leg_chunks"] = found["itinerary_timed_path"]
    found["path_frequency_spread"] = found["path_frequency_rows"]
    found["trip_totals_spread"] = found["trip_totals"]
    found["trip_summary_spread"] = found["trip_summary_shuffled_lookup"] = found["trip_summary"]
    return found | {"visits_spread": found["visits"]}
