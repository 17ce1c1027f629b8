"""Linear units."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres in a unit.
FACTORS = {
    "metre": 1.0,
    "foot": 0.3048,
    "us survey foot": 1200 / 3937,
    "kilometre": 1000.0,
    "yard": 0.9144,
    "mile": 1609.344,
}
ALIASES = {
    "m": "metre", "meter": "metre", "meters": "metre", "metres": "metre",
    "ft": "foot", "feet": "foot", "international foot": "foot", "international feet": "foot",
    "us-ft": "us survey foot", "ftus": "us survey foot", "us foot": "us survey foot", "us feet": "us survey foot",
    "km": "kilometre", "kilometer": "kilometre", "yd": "yard", "mi": "mile",
}


@dataclass(frozen=True)
class LinearUnit:
    """A named factor to metres; an unknown unit has none and converts as is."""

    name: str = "unknown"
    metres: float | None = None

    @classmethod
    def named(cls, name: str | None) -> LinearUnit:
        key = (name or "").strip().lower()
        key = ALIASES.get(key, key)
        return cls(key, FACTORS[key]) if key in FACTORS else cls()

    def factor_to(self, other: LinearUnit) -> float:
        return 1.0 if self.metres is None or other.metres is None else self.metres / other.metres

    def convert(self, value: Column, to: LinearUnit) -> Column:
        factor = self.factor_to(to)
        return value if factor == 1.0 else value * F.lit(factor)

    def consistent(self, other: LinearUnit) -> bool:
        return self.metres is None or other.metres is None or abs(self.metres - other.metres) < 1e-4

    @property
    def suffix(self) -> str:
        """For file names: Meters, Feet or nothing."""
        if re.search("foot", self.name):
            return "Feet"
        return "Meters" if self.name == "metre" else ""
