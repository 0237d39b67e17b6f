"""Little-endian packets and tagged events, to and from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Message types of the tile stream.
OPEN, CLOSE, UPDATE, TILE, PROGRESS, REQUEST, RATE_LIMITED, CREATED = range(8)


def unsigned(data: Column, at: int | Column, width: int) -> Column:
    """``width`` bytes from ``at`` (from 0), lowest first, as a number (F10); null beyond the end."""
    pieces = [F.hex(F.substring(data, (F.lit(at) if isinstance(at, int) else at) + 1 + k, F.lit(1))) for k in reversed(range(width))]
    return F.when(F.octet_length(data) >= (F.lit(at) if isinstance(at, int) else at) + width, F.conv(F.concat(*pieces), 16, 10).cast("decimal(20,0)").cast("long" if width < 8 else "decimal(20,0)"))


def signed(data: Column, at: int, width: int) -> Column:
    n = unsigned(data, at, width)
    return F.when(n >= 1 << (8 * width - 1), n - (1 << (8 * width))).otherwise(n).cast("long")


def float32(data: Column, at: int) -> Column:
    """Four bytes as a single-precision number, from its sign, exponent and fraction."""
    n = unsigned(data, at, 4)
    exponent, fraction = F.shiftright(n, 23).bitwiseAND(F.lit(255).cast("long")), n.bitwiseAND(F.lit((1 << 23) - 1).cast("long"))
    size = F.when(exponent == 0, fraction / F.lit(float(1 << 23)) * 2.0**-126).otherwise((1 + fraction / F.lit(float(1 << 23))) * F.pow(F.lit(2.0), exponent - 127))
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(n >= 1 << 31, -1.0).otherwise(1.0) * F.when(exponent == 255, special).otherwise(size)


def bytes_of(value: Column, width: int) -> Column:
    """A number as ``width`` bytes, lowest first."""
    h = F.right(F.concat(F.lit("0" * 2 * width), F.hex(value.cast("long"))), F.lit(2 * width))
    return F.unhex(F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(width))]))


def message(kind: int, *fields: tuple[Column, int]) -> Column:
    """A packet: its type, then fields (column, bytes)."""
    return F.concat(bytes_of(F.lit(kind), 1), *[bytes_of(c, w) for c, w in fields])


def viewport(data: Column, at: int = 0) -> dict[str, Column]:
    """x, y, width, height, zoom of 20 bytes."""
    return {"view_x": float32(data, at), "view_y": float32(data, at + 4), "view_width": unsigned(data, at + 8, 4), "view_height": unsigned(data, at + 12, 4), "zoom": float32(data, at + 16)}


def tile_request(data: Column) -> dict[str, Column]:
    """slot, x, y, level of a request packet after its type."""
    return {"slot": unsigned(data, 1, 1), "x": unsigned(data, 2, 4), "y": unsigned(data, 6, 4), "level": unsigned(data, 10, 4)}


def event(data: Column) -> dict[str, Column]:
    """Tagged events (F11): tag 0 holds steps and total as two signed 4-byte numbers, tag 1 a JSON text; else an error."""
    tag, size = unsigned(data, 0, 1), F.octet_length(data)
    json = F.when(tag == 1, F.decode(F.substring(data, 2, 1 << 30), "utf-8"))
    return {
        "kind": F.when((tag == 0) & (size >= 9), "progress").when(tag == 1, "created").otherwise("error"),
        "steps": F.when((tag == 0) & (size >= 9), signed(data, 1, 4)),
        "total": F.when((tag == 0) & (size >= 9), signed(data, 5, 4)),
        "json": json,
    }


def subject_id(subject: Column) -> Column:
    """The part after the last dot of a subject."""
    return F.regexp_extract(subject, r"([^.]+)$", 1)
