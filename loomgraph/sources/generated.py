"""Random and clock sources as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def number(low: int = 0, high: int | None = None, seed: int | None = None) -> Column:
    """A whole number of low..high, both included."""
    high = low + 100 if high is None else high
    return (F.floor((F.rand() if seed is None else F.rand(seed)) * (high - low + 1)) + low).cast("bigint")


def real(low: float = 0.0, high: float = 1.0, seed: int | None = None) -> Column:
    return (F.rand() if seed is None else F.rand(seed)) * (high - low) + low


def string(length: int = 10, charset: str = LETTERS) -> Column:
    """So many signs of a set; each is drawn on its own."""
    return F.concat_ws("", *(F.substring(F.lit(charset), (F.floor(F.rand() * len(charset)) + 1).cast("int"), F.lit(1)) for _ in range(length)))


def alphanumeric(length: int = 8) -> Column:
    return string(length, LETTERS + "0123456789")


def hexadecimal(length: int = 8) -> Column:
    return string(length, "0123456789abcdef")


def uuid() -> Column:
    return F.uuid()


def choice(items: list, seed: int | None = None) -> Column:
    if not items:
        raise ValueError("there is nothing to choose from")
    return F.element_at(F.array(*map(F.lit, items)), (number(1, len(items), seed)).cast("int"))


def boolean(seed: int | None = None) -> Column:
    return (F.rand() if seed is None else F.rand(seed)) < 0.5


def several(make, count: int) -> Column:
    """One value for a count of 1, else an array of so many."""
    return make() if count == 1 else F.array(*(make() for _ in range(count)))


def clock(utc: bool = True) -> Column:
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()) if utc else F.current_timestamp()
