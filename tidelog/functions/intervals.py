"""Histogram interval arguments, resolved on the driver before planning."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Unit letters with their length in seconds (a month counts 30
# days and a year 365), the letters each kind of argument may use on a typed
# table, and the interval taken when an argument is missing or unusable.
UNIT_SECONDS = {
    "s": 1,
    "m": 60,
    "h": 3_600,
    "d": 86_400,
    "w": 604_800,
    "M": 2_592_000,
    "y": 31_536_000,
}
COLUMNAR_FIXED_UNITS = "smhd"
COLUMNAR_CALENDAR_UNITS = "smhdwMy"
DOCUMENT_DEFAULT = (24, "h")
COLUMNAR_DEFAULT = (1, "h")


@dataclass(frozen=True)
class Interval:
    """``count`` units.  ``calendar`` months and years have no fixed length."""

    count: int
    unit: str
    calendar: bool = False

    @property
    def seconds(self) -> int:
        return self.count * UNIT_SECONDS[self.unit]

    @property
    def micros(self) -> int:
        return self.seconds * 1_000_000

    @property
    def months(self) -> int | None:
        """Length in months for calendar months and years, else None."""
        if not self.calendar or self.unit not in ("M", "y"):
            return None
        return self.count * (12 if self.unit == "y" else 1)


def _split(text: str, units: str) -> tuple[int, str] | None:
    number, unit = text[:-1], text[-1]
    if unit not in units or not re.fullmatch(r"\+?[0-9]+", number):
        return None
    count = int(number)
    if count == 0 or count >= 2**63:
        return None
    if count * UNIT_SECONDS[unit] * 1_000_000 >= 2**63:
        raise ValueError(f"interval too long: {text}")
    return count, unit


def document_interval(fixed: str | None, calendar: str | None) -> Interval:
    """Every unit has a fixed length; ``fixed`` wins over ``calendar``."""
    text = fixed or calendar
    found = _split(text, "".join(UNIT_SECONDS)) if text else None
    return Interval(*(found or DOCUMENT_DEFAULT))


def columnar_interval(fixed: str | None, calendar: str | None) -> Interval:
    """Weeks, months and years follow the calendar."""
    if fixed:
        return Interval(*(_split(fixed, COLUMNAR_FIXED_UNITS) or COLUMNAR_DEFAULT))
    found = _split(calendar, COLUMNAR_CALENDAR_UNITS) if calendar else None
    count, unit = found or COLUMNAR_DEFAULT
    return Interval(count, unit, calendar=unit in "wMy")
