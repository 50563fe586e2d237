"""Event schemas: names of four-momenta, real scalars and the weight, inferred from physical columns."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

#: The physical parts of a four-momentum and the default weight name.
PARTS = ("e", "px", "py", "pz")
WEIGHT = "weight"


class SchemaError(ValueError):
    """Columns that do not make an event schema."""


@dataclass(frozen=True)
class EventSchema:
    """Ordered names. Physically a four-momentum p is p_e, p_px, p_py, p_pz; everything is a double."""

    p4s: tuple[str, ...] = ()
    scalars: tuple[str, ...] = ()
    has_weight: bool = False
    weight: str = WEIGHT

    def __post_init__(self):
        for kind in (self.p4s, self.scalars):
            if len(set(kind)) != len(kind):
                raise SchemaError(f"repeated names in {kind}")

    def columns(self) -> list[str]:
        """Physical columns in the order of writing: momenta, scalars, weight."""
        return [f"{p}_{c}" for p in self.p4s for c in PARTS] + list(self.scalars) + ([self.weight] if self.has_weight else [])

    @classmethod
    def infer(cls, schema: T.StructType, weight: str = WEIGHT, require_weight: bool = False, incomplete_as_scalars: bool = True) -> EventSchema:
        """Floating-point columns only. Complete quadruples become momenta, sorted by name; what is left of incomplete
        ones follows the other scalars, or is an error."""
        names = [f.name for f in schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        if len(set(names)) != len(names):
            raise SchemaError("repeated column names")
        has_weight = weight in names
        if require_weight and not has_weight:
            raise SchemaError(f"no weight column {weight}")
        plain, groups = [], {}
        for n in names:
            if n == weight:
                continue
            stem, _, part = n.rpartition("_")
            if stem and part in PARTS:
                groups.setdefault(stem, []).append(n)
            else:
                plain.append(n)
        p4s = sorted(s for s, found in groups.items() if len(found) == 4)
        rest = [n for s in sorted(groups) if s not in p4s for n in groups[s]]
        if rest and not incomplete_as_scalars:
            raise SchemaError(f"incomplete four-momenta: {', '.join(rest)}")
        return cls(tuple(p4s), tuple(plain + rest), has_weight, weight)

    def check(self, schema: T.StructType) -> None:
        """All physical columns are there and floating-point."""
        kinds: dict[str, Any] = {f.name: f.dataType for f in schema}
        missing = [c for c in self.columns() if not isinstance(kinds.get(c), (T.DoubleType, T.FloatType))]
        if missing:
            raise SchemaError(f"missing columns: {', '.join(missing)}")
