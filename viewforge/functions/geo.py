"""Geohash as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the geohash alphabet.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"

BITS = 30


def _lookup() -> str:
    """The 32 characters ordered by (three bits of one axis, two bits of the other).

    Five interleaved bits make a character. The axis that starts gives bits
    4, 2, 0 and the other bits 3, 1, so a character is found by one substring
    at position ``three * 4 + two``.
    """
    table = []
    for three in range(8):
        for two in range(4):
            a, b, c = three >> 2 & 1, three >> 1 & 1, three & 1
            d, e = two >> 1 & 1, two & 1
            table.append(BASE32[a << 4 | d << 3 | b << 2 | e << 1 | c])
    return "".join(table)


LOOKUP = _lookup()


def cell_number(value: Column, low: float, high: float) -> Column:
    """Which of 2**30 equal slices of the axis holds the value."""
    slices = 1 << BITS
    position = F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(float(slices))).cast("long")
    inside = F.greatest(F.least(position, F.lit(slices - 1).cast("long")), F.lit(0).cast("long"))
    return F.when(value.isNotNull(), inside)  # least and greatest pass over a null


def geohash(latitude: Column, longitude: Column, precision: int = 12) -> Column:
    """Geohash of up to 12 characters; null if a coordinate is null.

    The map example hands its coordinates over in the opposite order; callers
    that need those results pass longitude as ``latitude`` on purpose.
    """
    if not 1 <= precision <= 12:
        raise ValueError("precision must lie between 1 and 12")
    lat = cell_number(latitude, -90.0, 90.0)
    lon = cell_number(longitude, -180.0, 180.0)
    characters = []
    lat_used = lon_used = 0
    for position in range(precision):
        starts, other = (lon, lat) if position % 2 == 0 else (lat, lon)
        starts_used, other_used = (lon_used, lat_used) if position % 2 == 0 else (lat_used, lon_used)
        three = F.shiftright(starts, BITS - 3 - starts_used).bitwiseAND(F.lit(7))
        two = F.shiftright(other, BITS - 2 - other_used).bitwiseAND(F.lit(3))
        index = (three * 4 + two + 1).cast("int")
        characters.append(F.substring(F.lit(LOOKUP), index, F.lit(1)))
        if position % 2 == 0:
            lon_used, lat_used = lon_used + 3, lat_used + 2
        else:
            lat_used, lon_used = lat_used + 3, lon_used + 2
    return F.concat(*characters)
