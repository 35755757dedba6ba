"""Hashes and fingerprints of paths, put together from their places: no path is held as a text or list.

The hash of a joined text is a sum over its pieces: the hash of a piece times 31 to the power of what
follows it. Modulo 2**32 the number 31 has an inverse, so that the length before a piece will do, and
the whole length is multiplied in at the end. So a path's hash, and that of its reverse, are two sums
over readings in any order, and hashes of longer paths are such sums over those of their parts.

Which of path and reverse is the greater text is told by the first place where they differ: place i of
the path stands against place n + 1 - i.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripfold.functions.expressions import (
    INVERSE_31,
    low32,
    mixed_hash,
    power31,
    text_hash,
    times32,
    utf16_length,
)
from tripfold.operators.ordering import TRIP, in_order
from tripfold.schema import STOP_SEP

#: Running sums that `in_order` has to add: lengths with separators, words between separators, places.
PATH_SUMS = {
    "units": f"{utf16_length('place')} + 1",
    "tokens": f"size(split(place, '{STOP_SEP}', -1))",
    "places": "IF(place IS NULL, 0, 1)",
}

#: A path's print: hashes of it and of its reverse, its length in UTF-16 units, and 1, 0 or -1 where
#: it is greater than its reverse, equal or less.
PRINT = ["ahead", "back", "units", "turn"]


def separator_hash(separator: str) -> tuple[int, int]:
    """Hash and length of a short ASCII separator."""
    total = 0
    for c in separator:
        total = total * 31 + ord(c)
    return total, len(separator)


_STOP = separator_hash(STOP_SEP)[0]


def with_place_terms(rows: DataFrame) -> DataFrame:
    """Adds what a reading adds to the hashes of its path and of the reverse, and where it ends in the path.

    For rows with `place` and the running sum units_before. Powers and the place's hash are columns of
    their own first, as each is used several times.
    """
    before, place = F.col("units_before"), F.col("place")
    rows = rows.withColumns(
        {
            "own_hash": low32(text_hash(place)),
            "own_units": F.expr(utf16_length("place")),
            "power": power31(before),
            "inverse": power31(-before),
        }
    )
    rows = rows.withColumn("own_inverse", power31(-F.col("own_units")))
    end, follows = times32(F.col("inverse"), F.col("own_inverse")), before > 0
    rows = rows.withColumn("end", end)
    sep_ahead = F.when(follows, low32(_STOP * F.col("inverse"))).otherwise(0)
    sep_back = F.when(follows, times32(F.col("power"), F.lit(_STOP * INVERSE_31 & 0xFFFFFFFF))).otherwise(0)
    rows = rows.withColumns(
        {
            "ahead_term": times32(F.col("own_hash"), F.col("end")) + sep_ahead,
            "back_term": times32(F.col("own_hash"), F.col("power")) + sep_back,
            "units_to": before + F.col("own_units"),
        }
    )
    return rows.drop("own_hash", "own_units", "power", "inverse", "own_inverse", "end")


def _facing() -> Column:
    """For a reading: rows that set words of the path against those of its reverse at `at`.

    Without a separator inside a place, place i meets place n + 1 - i in one row, so a reading is one
    row. Where a trip has places with a separator in them, words between separators are compared.
    """
    at = "least(tokens_before, tokens_total - 1 - tokens_before)"
    ahead = "IF(tokens_before <= tokens_total - 1 - tokens_before, place, NULL)"
    back = "IF(tokens_before >= tokens_total - 1 - tokens_before, place, NULL)"
    alone = "array(named_struct('at', -1L, 'own', true, 'ahead', CAST(NULL AS string), 'back', CAST(NULL AS string)))"
    words = f"split(place, '{STOP_SEP}', -1)"
    start = f"tokens_total - tokens_before - size({words})"
    return F.expr(f"""CASE WHEN place IS NULL THEN {alone}
        WHEN tokens_total = places_total
            THEN array(named_struct('at', {at}, 'own', true, 'ahead', {ahead}, 'back', {back}))
        ELSE concat({alone},
            transform({words}, (w, k) ->
                named_struct('at', tokens_before + k, 'own', false, 'ahead', w, 'back', CAST(NULL AS string))),
            transform({words}, (w, k) ->
                named_struct('at', {start} + k, 'own', false, 'ahead', CAST(NULL AS string), 'back', w))) END""")


def faced(rows: DataFrame) -> DataFrame:
    """rows (with PATH_SUMS), each with `face`: at, own, ahead, back. `own` marks one row a reading."""
    return rows.withColumn("face", F.explode(_facing()))


def turn(first: Column) -> Column:
    """1, 0 or -1 from the first words (ahead, back) that differ; NULL if none does."""
    # Words that differ first are never the last ones, so a separator follows both.
    ahead, back = F.concat(first["ahead"], F.lit(STOP_SEP)), F.concat(first["back"], F.lit(STOP_SEP))
    return F.when(ahead > back, 1).when(ahead < back, -1).otherwise(0)


def trip_aggregates(rows: DataFrame, pairs: list[Column], trips: list[Column]) -> DataFrame:
    """One row per trip from `faced` rows `with_place_terms`: path_print, and what `trips` makes of `pairs`.

    Words that face each other are brought together first, and a trip's pairs after that, both
    combined before any shuffle. `pairs` are aggregates over readings, `trips` over their results.
    """
    own, face = F.col("face.own"), F.col("face")
    each = rows.groupBy(*TRIP, F.col("face.at").alias("at")).agg(
        *pairs,
        F.sum(F.when(own, F.col("ahead_term"))).alias("ahead_sum"),
        F.sum(F.when(own, F.col("back_term"))).alias("back_sum"),
        F.max("units_to").alias("units"),
        F.max(face["ahead"]).alias("ahead"),
        F.max(face["back"]).alias("back"),
    )
    differs = F.col("ahead") != F.col("back")
    whole = each.groupBy(*TRIP).agg(
        *trips,
        F.sum("ahead_sum").alias("ahead_sum"),
        F.sum("back_sum").alias("back_sum"),
        F.max("units").alias("units"),
        F.min_by(F.struct("ahead", "back"), F.when(differs, F.col("at"))).alias("first"),
    )
    units = F.coalesce(F.col("units"), F.lit(0).cast("bigint"))
    path_print = F.struct(
        times32(low32(F.coalesce("ahead_sum", F.lit(0))), power31(units)).alias("ahead"),
        low32(F.coalesce("back_sum", F.lit(0))).alias("back"),
        units.alias("units"),
        turn(F.col("first")).alias("turn"),
    )
    return whole.withColumn("path_print", path_print).drop("ahead_sum", "back_sum", "units", "first")


def print_hash(path_print: Column) -> Column:
    """The path hash of a print, as `path_hash` gives it for the texts."""
    forward = path_print["turn"] >= 0
    return mixed_hash(
        F.when(forward, path_print["ahead"]).otherwise(path_print["back"]),
        F.when(forward, path_print["back"]).otherwise(path_print["ahead"]),
    )


def joined_print(rows: DataFrame, keys: list[str], order: str, separator: str) -> tuple[DataFrame, list[Column], Column]:
    """For joining the paths, and apart from them the reverses, of a group's rows in `order`.

    Gives the rows with what each adds, the aggregates for groupBy(*keys), and the group's path_print
    made of their results.
    """
    by = f"PARTITION BY {', '.join(keys)} ORDER BY {order}"
    code, length = separator_hash(separator)
    before = f"coalesce(sum(path_print.units + {length}) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"
    rows = rows.withColumn("units_before", F.expr(before))
    start, units = F.col("units_before"), F.col("path_print.units")
    rows = rows.withColumns({"inverse": power31(-start), "end": power31(-start - units)})
    sep = F.when(start > 0, low32(code * F.col("inverse"))).otherwise(0)
    rows = rows.withColumns(
        {side + "_term": times32(F.col(f"path_print.{side}"), F.col("end")) + sep for side in ("ahead", "back")}
    )
    side = F.col("path_print.turn")
    aggregates = [
        F.sum("ahead_term").alias("ahead_sum"),
        F.sum("back_term").alias("back_sum"),
        F.max(start + units).alias("units_sum"),
        F.min_by(side, F.when(side != 0, F.col(order))).alias("turn_first"),
    ]
    end = power31(F.col("units_sum"))
    joined = F.struct(
        times32(low32(F.col("ahead_sum")), end).alias("ahead"),
        times32(low32(F.col("back_sum")), end).alias("back"),
        F.col("units_sum").alias("units"),
        F.coalesce("turn_first", F.lit(0)).alias("turn"),
    )
    return rows, aggregates, joined


# Counting equal paths.


def path_words(readings: DataFrame, spread: bool = False) -> DataFrame:
    """One row per word of a path, a word being what stands between separators: mostly a place.

    Columns: the trip, word, its place `ahead_at` in the path and `back_at` in the reverse (from 0),
    the path's number of words, and whether each place is one word. A path without places is one
    empty word, as its text is empty.
    """
    words = f"""CASE WHEN place IS NOT NULL THEN split(place, '{STOP_SEP}', -1)
        WHEN places_total = 0 AND pos = 1 THEN array('') ELSE CAST(array() AS array<string>) END"""
    each = in_order(readings, spread, sums=PATH_SUMS).selectExpr(
        *TRIP,
        "coalesce(tokens_before, 0L) AS before",
        "coalesce(tokens_total, 1L) AS words",
        "coalesce(tokens_total, 1L) = greatest(places_total, 1L) AS plain",
        f"{words} AS own",
    )
    each = each.select("*", F.posexplode("own").alias("k", "word"))
    return each.selectExpr(
        *TRIP, "word", "before + k AS ahead_at", "words - before - size(own) + k AS back_at", "words", "plain"
    )


#: Sums that tell a path from another one: two hashes of 64 bits, in halves so that sums stay exact.
_FINGERPRINT = ["f0", "f1", "f2", "f3"]


def _fingerprint(at: str, salt: int) -> list[Column]:
    found = []
    for seed in (2 * salt, 2 * salt + 1):
        piece = F.xxhash64("word", at, F.lit(seed))
        found += [F.shiftrightunsigned(piece, 32), low32(piece)]
    return found


def count_paths(words: DataFrame, salt: int = 0) -> DataFrame:
    """How many trips take a path, in either direction, from `path_words`: a row per word of each path.

    Columns: count; pos (from 1) and place, the words of the greater of the two texts; entity_id and
    date of the least trip that takes it. No path is held in one value: a path is known by its length
    and a fingerprint of 128 bits, a sum over its words, and then all trips of equal fingerprints are
    compared word by word. Should two paths share one, the query fails, and another `salt` helps.
    """
    face = F.expr("""IF(plain,
        array(named_struct('at', least(ahead_at, back_at), 'own', true,
            'ahead', IF(ahead_at <= back_at, word, NULL), 'back', IF(ahead_at >= back_at, word, NULL))),
        array(named_struct('at', ahead_at, 'own', true, 'ahead', word, 'back', CAST(NULL AS string)),
            named_struct('at', back_at, 'own', false, 'ahead', CAST(NULL AS string), 'back', word)))""")
    sides = {side: [f"{side}_{f}" for f in _FINGERPRINT] for side in ("ahead", "back")}
    pieces = [
        piece.alias(name)
        for side, names in sides.items()
        for name, piece in zip(names, _fingerprint(f"{side}_at", salt), strict=True)
    ]
    names = [*sides["ahead"], *sides["back"]]
    pairs = (
        words.select("*", *pieces)
        .withColumn("face", F.explode(face))
        .groupBy(*TRIP, "words", F.col("face.at").alias("at"))
        .agg(
            *(F.sum(F.when(F.col("face.own"), F.col(n))).alias(n) for n in names),
            F.max("face.ahead").alias("ahead"),
            F.max("face.back").alias("back"),
        )
    )
    differs = F.col("ahead") != F.col("back")
    trips = pairs.groupBy(*TRIP, "words").agg(
        *(F.sum(n).alias(n) for n in names),
        F.min_by(F.struct("ahead", "back"), F.when(differs, F.col("at"))).alias("first"),
    )
    forward = turn(F.col("first")) >= 0
    # A long trip is there once for each stretch of its words, so that no task joins a whole one.
    stretches = F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright(F.col("words") - 1, 16)))
    known = trips.select(
        *TRIP,
        forward.alias("forward"),
        *(F.when(forward, F.col(a)).otherwise(F.col(b)).alias(f) for f, a, b in zip(_FINGERPRINT, *sides.values(), strict=True)),
        stretches.alias("stretch"),
    )
    rows = words.withColumn("stretch", F.shiftright("ahead_at", 16))
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (*TRIP, "stretch")]
    met = rows.alias("w").join(known.alias("t"), same).select(
        *(f"w.{c}" for c in TRIP),
        "words",
        *_FINGERPRINT,
        F.when(F.col("forward"), F.col("ahead_at")).otherwise(F.col("back_at")).alias("at"),
        "word",
    )
    paths = met.groupBy("words", *_FINGERPRINT, "at").agg(
        F.count("*").alias("count"),
        F.min(F.struct(*TRIP)).alias("trip"),
        F.min("word").alias("least"),
        F.max("word").alias("greatest"),
    )
    fails = F.raise_error(F.lit("two paths share a fingerprint; take another salt")).cast("string")
    place = F.when(F.col("least") == F.col("greatest"), F.col("least")).otherwise(fails)
    return paths.select("trip.*", (F.col("at") + 1).alias("pos"), place.alias("place"), "count")
