"""Which types hold every value of another type unchanged."""

from __future__ import annotations

from pyspark.sql.types import DataType

WIDER: dict[str, tuple[str, ...]] = {
    "tinyint": ("smallint", "int", "bigint", "float", "double"),
    "smallint": ("int", "bigint", "float", "double"),
    "int": ("bigint", "double"),
    "float": ("double",),
    "date": ("string", "timestamp", "timestamp_ntz"),
    "timestamp": ("string",),
    "timestamp_ntz": ("string",),
}
#: The decimal digits of whole numbers.
DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}


def lossless(source: DataType, target: DataType) -> bool:
    """Whether every value of one type is, read or cast as the other, the same value."""
    a, b = source.simpleString(), target.simpleString()
    if a == b or b in WIDER.get(a, ()):
        return True
    if b.startswith("decimal"):
        whole = target.precision - target.scale
        if a in DIGITS:
            return whole >= DIGITS[a]
        return a.startswith("decimal") and target.scale >= source.scale and whole >= source.precision - source.scale
    return False


def checked(source: DataType, target: DataType) -> bool:
    """Whether a cast between the types fails for a value that it would change, and keeps all others."""
    a, b = source.simpleString(), target.simpleString()
    whole_source = a in DIGITS or (a.startswith("decimal") and source.scale == 0)
    whole_target = b in DIGITS or (b.startswith("decimal") and target.scale == 0)
    if whole_source and whole_target:
        return True
    return a.startswith("decimal") and b.startswith("decimal") and target.scale >= source.scale
