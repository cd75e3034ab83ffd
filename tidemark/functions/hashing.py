"""Reproducible pseudo-random numbers from row keys, as Spark SQL text.

The numbers depend on the seed and the keys only, so they are the same for every
partitioning and after a task is run again. The functions return text for ``selectExpr``
and ``expr``: a wide generated row is then analyzed in one go, where building it from
Column objects takes longer than running it.
"""

from __future__ import annotations

from collections.abc import Sequence


def draw(seed: int, stream: str, *keys: str) -> str:
    """A number in 0..2^60 for every named stream and combination of keys.

    The stream's name must be free of quotes. The digits come from an MD5, which any SQL
    engine has, so the numbers can be checked elsewhere.
    """
    return f"CAST(conv(left(md5(concat_ws(':', '{seed}:{stream}', {', '.join(keys)})), 15), 16, 10) AS BIGINT)"


def below(value: str, limit: int | str) -> str:
    """A draw as one of 0..limit-1; every one of them occurs for limits far beyond 2^32."""
    return f"({value} % CAST({limit} AS BIGINT))"


def between(value: str, low: int, high: int) -> str:
    """A draw scaled into low..high, both included."""
    return f"({below(value, high - low + 1)} + {low}L)"


def bits(value: str, offset: int, width: int) -> str:
    """``width`` bits of a draw, to get several small numbers out of one."""
    return f"(shiftright({value}, {offset}) & {2**width - 1}L)"


def option(position: str, options: Sequence[str]) -> str:
    """The option at a position counted from 0."""
    texts = ", ".join("'" + text.replace("'", "\\'") + "'" for text in options)
    return f"element_at(array({texts}), CAST({position} + 1L AS INT))"


def choice(value: str, options: Sequence[str]) -> str:
    """A draw as one of the options."""
    return option(below(value, len(options)), options)


def days_before(as_of: str, value: str, low: int, high: int) -> str:
    return f"date_sub(DATE'{as_of}', CAST({between(value, low, high)} AS INT))"
