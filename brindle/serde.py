"""JSON of the plain objects: dataclasses of this package, with fractions and nested objects."""

from __future__ import annotations

import dataclasses
import json
from fractions import Fraction

import numpy as np

from .functions.quantum import Isospin, PartialWave, Particle, RuleSet
from .functions.vectors import RealVec3, RealVec4
from .operators.binning import Bins
from .operators.cross_section import Ensemble, Estimate
from .operators.generate import InitialMomentum, MassProposal, PiecewiseDensity, Report, ScalarSource, TComponent, VertexProposal
from .operators.histogram import Histogram
from .plans.expr import Expr, Parameter
from .schema import EventSchema

KINDS = {k.__name__: k for k in (Isospin, PartialWave, Particle, RuleSet, RealVec3, RealVec4, Bins, Ensemble, Estimate, InitialMomentum, MassProposal, PiecewiseDensity, Report, ScalarSource, TComponent, VertexProposal, Histogram, Parameter, EventSchema)}


def _plain(x):
    if isinstance(x, Expr):
        return {"$": "Expr", "graph": json.loads(x.to_json())}
    if isinstance(x, Fraction):
        return {"$": "Fraction", "twice": int(2 * x)}
    if isinstance(x, np.ndarray):
        return {"$": "array", "values": x.tolist()}
    if isinstance(x, tuple):
        return {"$": "tuple", "items": [_plain(v) for v in x]}
    if dataclasses.is_dataclass(x):
        return {"$": type(x).__name__, **{f.name: _plain(getattr(x, f.name)) for f in dataclasses.fields(x)}}
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, list) else x


def _object(x):
    if isinstance(x, list):
        return [_object(v) for v in x]
    if not isinstance(x, dict):
        return x
    kind = x.get("$")
    if kind is None:
        return {k: _object(v) for k, v in x.items()}
    if kind == "Expr":
        return Expr.from_json(json.dumps(x["graph"]))
    if kind == "Fraction":
        return Fraction(x["twice"], 2)
    if kind == "array":
        return np.array(x["values"])
    if kind == "tuple":
        return tuple(_object(v) for v in x["items"])
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    return KINDS[kind](**{k: _object(v) for k, v in x.items() if k != "$"})


def to_json(x) -> str:
    return json.dumps(_plain(x))


def from_json(text: str):
    return _object(json.loads(text))
