"""Plus-code grid cells and distances, as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public Open Location Code specification.
CODE_ALPHABET = "23456789CFGHJMPQRVWX"
CELL_DEGREES = 0.05  # side of a six-character cell
LAT_CELLS = 3600
LON_CELLS = 7200
LAT_UNITS_PER_DEGREE = 25_000_000
LON_UNITS_PER_DEGREE = 8_192_000

# Fixed value: kilometres per degree used for the flat-earth distance.
KM_PER_DEGREE = 111.0


def _digit(index: Column) -> Column:
    return F.substr(F.lit(CODE_ALPHABET), index.cast("int") + 1, F.lit(1))


def _cell_index(degrees: Column, origin: float, units_per_degree: int) -> Column:
    units = (degrees + F.lit(origin)) * F.lit(float(units_per_degree))
    # Whole units after rounding to six decimals, without the decimal arithmetic of ``round``: only a value within
    # half a millionth of a whole number is moved to it.
    nearest = F.rint(units)
    whole = F.when(F.abs(units - nearest) < 5e-7, nearest).otherwise(F.floor(units).cast("double"))
    return F.floor(whole / F.lit(units_per_degree * CELL_DEGREES))


def plus_code_region(lat: Column, lon: Column) -> Column:
    """First six characters of the Open Location Code; null when a coordinate is null."""
    north = _cell_index(lat, 90.0, LAT_UNITS_PER_DEGREE)
    # The pole belongs to the last row. ``least`` would skip a null, and a CASE would hide the index, which all digits
    # share, from common-subexpression elimination.
    row = north - F.floor(north / F.lit(LAT_CELLS))
    col = _cell_index(lon, 180.0, LON_UNITS_PER_DEGREE) % LON_CELLS
    return F.concat(*(_digit(F.floor(axis / F.lit(step)) % 20) for step in (400, 20, 1) for axis in (row, col)))


def _letter(code: Column, position: int) -> Column:
    return F.instr(F.lit(CODE_ALPHABET), F.substring(code, position, 1)) - 1


def cell_south_west(code: Column) -> tuple[Column, Column]:
    """South-west corner of a six-character cell; null for a string that is not such a code."""
    valid = code.rlike(f"^[{CODE_ALPHABET}]{{6}}$")
    row = _letter(code, 1) * 400 + _letter(code, 3) * 20 + _letter(code, 5)
    col = _letter(code, 2) * 400 + _letter(code, 4) * 20 + _letter(code, 6)
    return (
        F.when(valid, row * F.lit(CELL_DEGREES) - 90.0),
        F.when(valid, col * F.lit(CELL_DEGREES) - 180.0),
    )


def flat_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat-earth kilometres, longitude scaled by the cosine of the mean latitude."""
    north = (lat1 - lat2) * KM_PER_DEGREE
    east = (lon1 - lon2) * KM_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(north * north + east * east)
