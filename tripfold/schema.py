"""Input schemas, and the settings that describe places and hot entities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import types as T

# Names and text forms of the input columns.
RAW_TIME, RAW_ENTITY, RAW_TYPE, RAW_PLACE = "Timestamp", "car-id", "car-type", "gate-name"
PLAIN_TIME = "yyyy-MM-dd HH:mm:ss"
ISO_TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"
DATE = "yyyy-MM-dd"

# Separators inside a trip, between trips of a visit, between destinations.
STOP_SEP, DAY_SEP, DESTINATION_SEP = ":", "||", ","

# Fixed value: the speed limit the "closest" leg choice compares with.
SPEED_LIMIT = 25.0

RAW_READINGS = T.StructType(
    [T.StructField(name, T.StringType()) for name in (RAW_TIME, RAW_ENTITY, RAW_TYPE, RAW_PLACE)]
)


@dataclass(frozen=True)
class PlaceRules:
    """Which places bound a trip or a visit.

    `entrance` and `camping` are looked for inside the name. `base` must equal the name in
    the filters, but only be contained in it where a segment is closed.
    """

    # The words in place names.
    entrance: str = "entrance"
    camping: str = "camping"
    base: str = "ranger-base"

    def is_outer(self, place: Column) -> Column:
        return place.contains(self.entrance) | (place == self.base)

    def is_boundary(self, place: Column) -> Column:
        return self.is_outer(place) | place.contains(self.camping)

    def at_entrance(self, place: Column) -> Column:
        return place.contains(self.entrance)

    def at_base(self, place: Column) -> Column:
        return place.contains(self.base)


@dataclass(frozen=True)
class HotRule:
    """When an entity counts as hot: more than `factor` times an even share of the rows.

    Rows are counted in `buckets` hash buckets, so an even share is 1/buckets of the rows and
    at most buckets/factor entities can be hot. One task deals with `min_rows` readings of an
    entity in minutes, so below that nothing is worth splitting.
    """

    buckets: int = 65_536
    factor: float = 5.0
    min_rows: int = 10_000_000
