"""Monte-Carlo generation: every random number comes from (seed, stream, event, object), so that events do not depend on
partitions, batches or retries. Proposals are batched NumPy over ranges of event numbers."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import ID, Dataset
from ..functions.channel import Channel, ChannelError
from ..plans.evaluate import evaluate
from ..plans.expr import Expr
from ..plans.rewrite import simplify
from ..schema import PARTS, EventSchema
from .histogram import Histogram
from .sampling import GOLDEN, MASK, splitmix64_np

# Fixed values of the numbering: multipliers of stream, event and object; objects of momenta, masses, vertices, scalars;
# streams of production, pilot and acceptance.
STREAM_KEY, INDEX_KEY, OBJECT_KEY = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
MASS_OBJECT, VERTEX_OBJECT, SCALAR_OBJECT = 1, 10_000, 20_000
PRODUCTION, PILOT, ACCEPTANCE = 0, 1, 2


def derive_seed(seed: int, stream: int, index: np.ndarray, obj: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        fixed = (seed ^ stream * STREAM_KEY ^ obj * OBJECT_KEY) & MASK if seed >= 0 else ((seed & MASK) ^ stream * STREAM_KEY ^ obj * OBJECT_KEY) & MASK
        return splitmix64_np(np.uint64(fixed) ^ np.asarray(index).astype(np.uint64) * np.uint64(INDEX_KEY))


class Rng:
    """One splitmix64 stream for each event of a batch."""

    def __init__(self, state: np.ndarray):
        self.state = np.array(state, np.uint64)

    @classmethod
    def of(cls, seed: int, stream: int, index: np.ndarray, obj: int) -> Rng:
        return cls(derive_seed(seed, stream, index, obj))

    def uniform(self, where: np.ndarray | None = None) -> np.ndarray:
        """In (0, 1); with `where` only those events' streams move on."""
        z = splitmix64_np(self.state)
        with np.errstate(over="ignore"):
            new = self.state + np.uint64(GOLDEN)
        self.state = new if where is None else np.where(where, new, self.state)
        return ((z >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def _minkowski(p: np.ndarray) -> np.ndarray:
    """Masses of (n, 4) momenta, energy first; rounding below zero is zero."""
    return np.sqrt(np.maximum(p[:, 0] ** 2 - (p[:, 1:] ** 2).sum(axis=1), 0.0))


def boost(p: np.ndarray, beta: np.ndarray) -> np.ndarray:
    g = 1 / np.sqrt(1 - (beta**2).sum(axis=1))
    bp = (beta * p[:, 1:]).sum(axis=1)
    k = g * g / (1 + g) * bp + g * p[:, 0]
    return np.column_stack([g * (p[:, 0] + bp), p[:, 1:] + beta * k[:, None]])


def breakup(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lam = (parent**2 - (a + b) ** 2) * (parent**2 - (a - b) ** 2)
    return np.where(parent >= a + b, np.sqrt(np.maximum(lam, 0.0)) / (2 * parent), np.nan)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@dataclass(frozen=True)
class PiecewiseDensity:
    """A histogram as a density, cut to an interval."""

    edges: tuple[float, ...]
    weights: tuple[float, ...]

    def __post_init__(self):
        w = np.array(self.weights, float)
        if len(w) != len(self.edges) - 1 or not np.isfinite(w).all() or (w < 0).any() or w.sum() <= 0:
            raise ValueError("weights are finite, not negative, and some are positive")

    def _cut(self, low, high) -> tuple[np.ndarray, np.ndarray]:
        """Overlapping parts' starts and weights, one row per event."""
        e, w = np.array(self.edges), np.array(self.weights)
        a, b = np.maximum(e[:-1], np.asarray(low)[..., None]), np.minimum(e[1:], np.asarray(high)[..., None])
        share = np.maximum(b - a, 0) / np.diff(e) * w
        return a, share

    def sample(self, low, high, u: np.ndarray) -> np.ndarray:
        """The inverse distribution between low and high, NaN where they miss the support."""
        n = len(u)
        a, share = self._cut(np.broadcast_to(low, n), np.broadcast_to(high, n))
        total = share.sum(axis=1)
        c = np.cumsum(share, axis=1)
        at = u * total
        i = np.minimum((c <= at[:, None]).sum(axis=1), len(self.weights) - 1)
        rows = np.arange(n)
        before = c[rows, i] - share[rows, i]
        with np.errstate(all="ignore"):
            width = np.diff(self.edges)[i] / np.array(self.weights)[i]
            return np.where(total > 0, a[rows, i] + (at - before) * width, np.nan)

    def density(self, low, high, x: np.ndarray) -> np.ndarray:
        n = len(x)
        _, share = self._cut(np.broadcast_to(low, n), np.broadcast_to(high, n))
        i = np.clip(np.searchsorted(self.edges, x, "right") - 1, 0, len(self.weights) - 1)
        with np.errstate(all="ignore"):
            return np.array(self.weights)[i] / np.diff(self.edges)[i] / share.sum(axis=1)


@dataclass(frozen=True)
class MassProposal:
    """A fixed mass, or a uniform one whose weight is the interval's width; `learned` mixes in a density from a pilot."""

    low: float
    high: float | None = None
    learned: PiecewiseDensity | None = None
    defensive: float = 0.2

    def propose(self, maximum: np.ndarray, rng: Rng) -> tuple[np.ndarray, np.ndarray]:
        n = len(maximum)
        if self.high is None:
            if (maximum < self.low).any():
                raise ValueError(f"the mass {self.low} is out of reach")
            return np.full(n, self.low), np.ones(n)
        low, high = max(self.low, 0.0), np.minimum(self.high, maximum)
        if (high <= low).any():
            raise ValueError("the mass interval is out of reach")
        if self.learned is None:
            return low + rng.uniform() * (high - low), high - low
        plain = rng.uniform() < self.defensive
        u = rng.uniform()
        m = np.where(plain, low + u * (high - low), self.learned.sample(low, high, u))
        return m, 1 / self.density(high, m)

    def density(self, high: np.ndarray, m: np.ndarray) -> np.ndarray:
        flat = 1 / (np.minimum(self.high, high) - max(self.low, 0.0))
        if self.learned is None:
            return flat
        return self.defensive * flat + (1 - self.defensive) * self.learned.density(max(self.low, 0.0), np.minimum(self.high, high), m)


def mass(low: float, high: float | None = None) -> MassProposal:
    return MassProposal(low, high)


@dataclass(frozen=True)
class ScalarSource:
    """A generated column: fixed, uniform or from a histogram; the weight is the inverse density."""

    kind: str
    low: float = 0.0
    high: float = 0.0
    shape: PiecewiseDensity | None = None

    @classmethod
    def fixed(cls, value: float) -> ScalarSource:
        return cls("fixed", value)

    @classmethod
    def uniform(cls, low: float, high: float) -> ScalarSource:
        return cls("uniform", low, high)

    @classmethod
    def histogram(cls, h: Histogram) -> ScalarSource:
        return cls("histogram", float(h.bin_edges[0]), float(h.bin_edges[-1]), PiecewiseDensity(tuple(h.bin_edges), tuple(h.counts)))

    def sample(self, rng: Rng, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "fixed":
            return np.full(n, self.low), np.ones(n)
        u = rng.uniform()
        if self.kind == "uniform":
            return self.low + u * (self.high - self.low), np.full(n, self.high - self.low)
        x = self.shape.sample(self.low, self.high, u)
        return x, 1 / self.shape.density(self.low, self.high, x)


@dataclass(frozen=True)
class InitialMomentum:
    """Where an incoming particle's momentum comes from: given, or an energy (fixed or sampled) along a direction."""

    p4: tuple[float, float, float, float] | None = None
    momentum: tuple[float, float, float] | None = None
    energy: ScalarSource | None = None
    direction: tuple[float, float, float] = (0.0, 0.0, 1.0)

    @classmethod
    def along(cls, energy: float | ScalarSource, direction=(0.0, 0.0, 1.0)) -> InitialMomentum:
        return cls(energy=energy if isinstance(energy, ScalarSource) else ScalarSource.fixed(energy), direction=tuple(direction))

    def sample(self, m: float, rng: Rng, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.p4 is not None:
            return np.tile(self.p4, (n, 1)), np.ones(n)
        if self.momentum is not None:
            p = np.array(self.momentum)
            return np.tile([math.sqrt(p @ p + m * m), *p], (n, 1)), np.ones(n)
        e, w = self.energy.sample(rng, n)
        if (e < m).any():
            raise ValueError("an energy below the mass")
        d = np.array(self.direction) / np.linalg.norm(self.direction)
        return np.column_stack([e, np.sqrt(e * e - m * m)[:, None] * d]), w


@dataclass(frozen=True)
class TComponent:
    """One part of a distribution in t: uniform, exponential (slope), pole (mass, power) or histogram."""

    kind: str = "uniform"
    slope: float = 0.0
    mass: float = 0.0
    power: float = 1.0
    shape: PiecewiseDensity | None = None

    def _flat(self) -> bool:
        return self.kind == "uniform" or self.kind == "exponential" and abs(self.slope) < 1e-10

    def sample(self, low: np.ndarray, high: np.ndarray, u: np.ndarray) -> np.ndarray:
        if self._flat():
            return low + u * (high - low)
        if self.kind == "exponential":
            return low + np.log1p(u * np.expm1(self.slope * (high - low))) / self.slope
        if self.kind == "histogram":
            return self.shape.sample(low, high, u)
        a, b = self.mass**2 - high, self.mass**2 - low
        if (a <= 0).any():
            raise ValueError("the pole lies within the physical range of t")
        k = 1 - self.power
        return self.mass**2 - (a * (b / a) ** u if abs(k) < 1e-10 else (a**k + u * (b**k - a**k)) ** (1 / k))

    def density(self, low: np.ndarray, high: np.ndarray, t: np.ndarray) -> np.ndarray:
        if self._flat():
            return 1 / (high - low)
        if self.kind == "exponential":
            return self.slope * np.exp(self.slope * (t - low)) / np.expm1(self.slope * (high - low))
        if self.kind == "histogram":
            return self.shape.density(low, high, t)
        a, b, k = self.mass**2 - high, self.mass**2 - low, 1 - self.power
        norm = np.log(b / a) if abs(k) < 1e-10 else (b**k - a**k) / k
        return (self.mass**2 - t) ** -self.power / norm

    def floor(self, width: float) -> float:
        """A density that is nowhere undercut on a range of at most this width."""
        if self._flat():
            return 1 / width
        if self.kind == "exponential" and self.slope > 0:
            return self.slope / math.expm1(self.slope * width)
        return 0.0


@dataclass(frozen=True)
class VertexProposal:
    """How a vertex's outgoing momenta are drawn: an isotropic two-body decay, or two-body scattering in t."""

    kind: str = "decay"
    pairing: tuple[str, str] = ("", "")
    components: tuple[tuple[float, TComponent], ...] = ()
    t_min: float | None = None
    t_max: float | None = None
    learned: PiecewiseDensity | None = None
    defensive: float = 0.2

    @classmethod
    def isotropic(cls) -> VertexProposal:
        return cls()

    @classmethod
    def t_exchange(cls, pairing: tuple[str, str], slope: float, uniform_fraction: float = 0.0, t_min=None, t_max=None) -> VertexProposal:
        parts = [(1 - uniform_fraction, TComponent("exponential", slope=slope))] if uniform_fraction < 1 else []
        if uniform_fraction > 0:
            parts.append((uniform_fraction, TComponent()))
        return cls("t", pairing, tuple(parts), t_min, t_max)

    @classmethod
    def t_exchange_pole(cls, pairing: tuple[str, str], mass: float, power: float = 1.0, uniform_fraction: float = 0.0) -> VertexProposal:
        parts = [(1 - uniform_fraction, TComponent("pole", mass=mass, power=power))]
        return cls("t", pairing, tuple(parts + ([(uniform_fraction, TComponent())] if uniform_fraction > 0 else [])))

    @classmethod
    def t_exchange_histogram(cls, pairing: tuple[str, str], h: Histogram) -> VertexProposal:
        return cls("t", pairing, ((1.0, TComponent("histogram", shape=PiecewiseDensity(tuple(h.bin_edges), tuple(h.counts)))),))

    def propose(self, incoming: dict[str, np.ndarray], outgoing: dict[str, np.ndarray], rng: Rng) -> tuple[dict[str, np.ndarray], np.ndarray]:
        return self._decay(incoming, outgoing, rng) if self.kind == "decay" else self._scatter(incoming, outgoing, rng)

    def _decay(self, incoming, outgoing, rng):
        if len(incoming) != 1 or len(outgoing) != 2:
            raise ValueError("a decay has one particle in and two out")
        parent = next(iter(incoming.values()))
        (na, ma), (nb, mb) = outgoing.items()
        big = _minkowski(parent)
        p = breakup(big, ma, mb)
        if np.isnan(p).any():
            raise ValueError("a decay below threshold")
        correction = 1.0
        if self.learned is None:
            c = 2 * rng.uniform() - 1
        else:
            plain = rng.uniform() < self.defensive
            u = rng.uniform()
            c = np.where(plain, 2 * u - 1, self.learned.sample(-1.0, 1.0, u))
            correction = 0.5 / (self.defensive * 0.5 + (1 - self.defensive) * self.learned.density(-1.0, 1.0, c))
        phi = 2 * math.pi * rng.uniform()
        s = np.sqrt(1 - c * c)
        d = np.column_stack([s * np.cos(phi), s * np.sin(phi), c])
        beta = parent[:, 1:] / parent[:, :1]
        out = {na: boost(_on_shell(d, p, ma), beta), nb: boost(_on_shell(-d, p, mb), beta)}
        return out, p / (4 * math.pi * big) * correction

    def _scatter(self, incoming, outgoing, rng):
        if len(incoming) != 2 or len(outgoing) != 2:
            raise ValueError("scattering has two particles in and two out")
        a, c = self.pairing
        if a not in incoming or c not in outgoing:
            raise ValueError(f"the pairing {self.pairing} is not at this vertex")
        b, d = next(k for k in incoming if k != a), next(k for k in outgoing if k != c)
        total = incoming[a] + incoming[b]
        rs, beta = _minkowski(total), total[:, 1:] / total[:, :1]
        m1, m2, m3, m4 = _minkowski(incoming[a]), _minkowski(incoming[b]), outgoing[c], outgoing[d]
        p_in, p_out = breakup(rs, m1, m2), breakup(rs, m3, m4)
        if np.isnan(p_out).any() or not (p_in > 0).all():
            raise ValueError("scattering below threshold")
        centre = m1**2 + m3**2 - 2 * np.sqrt(m1**2 + p_in**2) * np.sqrt(m3**2 + p_out**2)
        span = 2 * p_in * p_out
        low, high = centre - span, centre + span
        low = low if self.t_min is None else np.maximum(low, self.t_min)
        high = high if self.t_max is None else np.minimum(high, self.t_max)
        if (high <= low).any():
            raise ValueError("the limits of t miss the physical range")
        share = np.cumsum([w for w, _ in self.components])
        pick = np.minimum((rng.uniform()[:, None] >= share / share[-1]).sum(axis=1), len(share) - 1)
        u = rng.uniform()
        t = np.zeros(len(u))
        for k, (_, part) in enumerate(self.components):
            t = np.where(pick == k, part.sample(low, high, u), t)
        density = sum(w / share[-1] * part.density(low, high, t) for w, part in self.components)
        cos = np.clip((t - centre) / span, -1, 1)
        sin = np.sqrt(np.maximum(1 - cos * cos, 0))
        phi = 2 * math.pi * rng.uniform()
        z = _unit(boost(incoming[a], -beta)[:, 1:])
        seed = np.where(np.abs(z[:, 2:3]) < 0.9, [[0.0, 0.0, 1.0]], [[1.0, 0.0, 0.0]])
        x = _unit(np.cross(seed, z))
        y = np.cross(z, x)
        n = z * cos[:, None] + x * (sin * np.cos(phi))[:, None] + y * (sin * np.sin(phi))[:, None]
        out = {c: boost(_on_shell(n, p_out, m3), beta), d: boost(_on_shell(-n, p_out, m4), beta)}
        return out, 1 / (16 * math.pi * rs * p_in * density)


def _on_shell(direction: np.ndarray, p: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.column_stack([np.sqrt(p * p + m * m), direction * p[:, None]])


@dataclass
class Report:
    requested: int
    produced: int
    proposals: int
    seed: int
    envelope: float | None = None
    maximum_weight: float = 0.0
    minimum_weight: float = 0.0
    sum_weights: float = 0.0
    updates: int = 0

    @property
    def rejected(self) -> int:
        return self.proposals - self.produced

    @property
    def acceptance_rate(self) -> float:
        return self.produced / self.proposals if self.proposals else 0.0


class EnvelopeOverflow(ArithmeticError):
    """A proposal's weight lies above the envelope."""


@dataclass
class Generator:
    """A channel whose root edges have momenta, whose other edges have masses, and whose vertices have proposals."""

    channel: Channel
    initial: dict[str, InitialMomentum]
    masses: dict[str, MassProposal | float]
    vertices: dict[str, VertexProposal] = field(default_factory=dict)
    scalars: dict[str, ScalarSource] = field(default_factory=dict)

    def __post_init__(self):
        self.channel.validate()
        self.masses = {k: v if isinstance(v, MassProposal) else MassProposal(float(v)) for k, v in self.masses.items()}
        for e in self.channel.edges:
            root = self.channel.producer(e) is None
            if root and e not in self.initial:
                raise ChannelError(f"edge {e} needs an initial momentum")
            if e not in self.masses:
                raise ChannelError(f"edge {e} needs a mass")
            if root and self.masses[e].high is not None:
                raise ChannelError(f"the incoming edge {e} needs a fixed mass")
        self.order = self._order()

    def _order(self) -> list[str]:
        done: list[str] = []
        while len(done) < len(self.channel.vertices):
            for v in self.channel.vertices.values():
                if v.name not in done and all((p := self.channel.producer(e)) is None or p.name in done for e in v.incoming):
                    done.append(v.name)
        return done

    def with_scalar(self, name: str, source: ScalarSource) -> Generator:
        return Generator(self.channel, self.initial, self.masses, self.vertices, {**self.scalars, name: source})

    @property
    def schema(self) -> EventSchema:
        return EventSchema(tuple(e.name for e in self.channel.edges.values() if e.output), tuple(self.scalars), True)

    def propose(self, index: np.ndarray, seed: int, stream: int = PRODUCTION) -> dict[str, np.ndarray]:
        """Columns of the events with these numbers; `weight` is the proposal's inverse density."""
        index = np.asarray(index)
        n = len(index)
        p4: dict[str, np.ndarray] = {}
        weight = np.ones(n)
        rng = Rng.of(seed, stream, index, 0)
        roots = [e for e in self.channel.edges if self.channel.producer(e) is None]
        for e in roots:
            p4[e], w = self.initial[e].sample(self.masses[e].low, rng, n)
            weight = weight * w
        total = _minkowski(sum(p4[e] for e in roots))
        masses: dict[str, np.ndarray] = {}
        for k, e in enumerate(self.channel.edges):
            masses[e], w = self.masses[e].propose(total, Rng.of(seed, stream, index, MASS_OBJECT + k))
            weight = weight * w
        for k, name in enumerate(self.order):
            v = self.channel.vertices[name]
            proposal = self.vertices.get(name, VertexProposal())
            out, w = proposal.propose({e: p4[e] for e in v.incoming}, {e: masses[e] for e in v.outgoing}, Rng.of(seed, stream, index, VERTEX_OBJECT + k))
            p4.update(out)
            weight = weight * w
        cols: dict[str, np.ndarray] = {}
        for e, edge in self.channel.edges.items():
            if edge.output:
                cols |= {f"{e}_{c}": p4[e][:, i] for i, c in enumerate(PARTS)}
        for k, (name, source) in enumerate(self.scalars.items()):
            cols[name], w = source.sample(Rng.of(seed, stream, index, SCALAR_OBJECT + k), n)
            weight = weight * w
        return cols | {"weight": weight}

    def _frame(self, spark: SparkSession, start: int, count: int, seed: int, stream: int, model: Expr | None, values=None) -> DataFrame:
        root = None if model is None else simplify(model)
        names = [*self.schema.columns(), ID]

        def run(batches):
            for b in batches:
                index = b.column(0).to_numpy()
                if not len(index):
                    continue
                cols = self.propose(index, seed, stream)
                if root is not None:
                    cols["weight"] = cols["weight"] * evaluate(root, cols, values, len(index)).real
                yield pa.RecordBatch.from_arrays([*(pa.array(cols[c]) for c in names[:-1]), b.column(0)], names=names)

        return spark.range(start, start + count).mapInArrow(run, ", ".join(f"`{c}` double" for c in names[:-1]) + f", {ID} long")

    def weighted(self, spark: SparkSession, events: int, seed: int = 0, model: Expr | None = None, values=None) -> Dataset:
        """So many events, weighted by inverse proposal density times the model."""
        return Dataset(self._frame(spark, 0, events, seed, PRODUCTION, model, values), self.schema)

    def report(self, ds: Dataset, seed: int) -> Report:
        r = ds.frame.agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("hi"), F.min("weight").alias("lo"), F.sum("weight").alias("s")).first()
        return Report(r.n, r.n, r.n, seed, None, r.hi or 0.0, r.lo or 0.0, r.s or 0.0)

    def pilot(self, spark: SparkSession, events: int, seed: int, model: Expr | None = None, values=None) -> float:
        """The largest weight of a pilot sample."""
        return float(self._frame(spark, 0, events, seed, PILOT, model, values).agg(F.max("weight")).first()[0])

    def unweighted(self, spark: SparkSession, events: int, seed: int = 0, model: Expr | None = None, values=None, envelope: float | None = None, pilot: int = 10_000, safety: float = 1.2, overflow: str = "error", max_proposals: int | None = None) -> tuple[Dataset, Report]:
        """The first `events` proposals, in order, whose uniform number times the envelope is not above their weight.

        The envelope is given (strict), or the pilot's largest weight times `safety`. On a larger weight the run fails,
        or with overflow="grow" the envelope grows and acceptance is judged anew for all. Each round is one job over a range
        of proposals; only counts reach the driver.
        """
        bound = envelope if envelope is not None else safety * self.pilot(spark, pilot, seed, model, values)
        if not (bound > 0 and math.isfinite(bound)):
            raise ValueError("the envelope is finite and positive")
        limit = max_proposals or 1 << 62
        tried, updates = min(limit, max(1024, 2 * events)), 0
        while True:
            frame = self._frame(spark, 0, tried, seed, PRODUCTION, model, values)
            kept = frame.where(acceptance(seed, F.col(ID)) * bound <= F.col("weight"))
            r = frame.agg(F.max("weight").alias("hi"), F.min("weight").alias("lo"), F.sum("weight").alias("s"), F.sum((acceptance(seed, F.col(ID)) * bound <= F.col("weight")).cast("long")).alias("n")).first()
            if r.hi > bound:
                if overflow == "error":
                    raise EnvelopeOverflow(f"weight {r.hi} above the envelope {bound}")
                bound, updates = r.hi * safety, updates + 1
                continue
            if r.n >= events:
                break
            if tried >= limit:
                raise RuntimeError(f"{r.n} of {events} events accepted from {tried} proposals")
            tried = min(limit, int(tried * max(1.5, min(16.0, 1.2 * events / max(1, r.n)))))
        ranked = Dataset(kept, self.schema, dense=False).with_ids()
        frame = ranked.frame.where(F.col(ID) < events).withColumn("weight", F.lit(1.0))
        return Dataset(frame, self.schema), Report(events, events, tried, seed, bound, r.hi, r.lo, r.s, updates)

    def adapted(self, spark: SparkSession, events: int, seed: int, model: Expr | None = None, values=None, bins: int = 64) -> Generator:
        """The generator with the mass proposal learned that raises the pilot's efficiency (mean over largest weight) most,
        if by two percent; a fifth of the proposals stays as it was."""
        frame = self._frame(spark, 0, events, seed, PILOT, model, values)
        best, gain = None, 1.02
        base = frame.agg((F.avg("weight") / F.max("weight")).alias("e")).first().e
        for e, m in self.masses.items():
            if m.high is None or not self.channel.edges[e].output:
                continue
            x = F.sqrt(F.greatest(F.col(f"{e}_e") ** 2 - F.col(f"{e}_px") ** 2 - F.col(f"{e}_py") ** 2 - F.col(f"{e}_pz") ** 2, F.lit(0.0)))
            lo, hi = frame.agg(F.min(x), F.max(x)).first()
            if not hi > lo:
                continue
            slot = F.least(F.floor((x - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
            rows = {r.b: (r.w, r.m) for r in frame.groupBy(slot.alias("b")).agg(F.sum("weight").alias("w"), F.max("weight").alias("m")).collect()}
            counts = np.array([rows.get(k, (0.0, 0.0))[0] for k in range(bins)])
            if (counts > 0).sum() < 2 or not base:
                continue
            learned = PiecewiseDensity(tuple(np.linspace(lo, hi, bins + 1)), tuple(counts))
            new = MassProposal(m.low, m.high, learned)
            centre = (np.array(learned.edges[:-1]) + np.array(learned.edges[1:])) / 2
            scale = m.density(np.full(bins, m.high), centre) / new.density(np.full(bins, m.high), centre)
            top = max(rows[k][1] * scale[k] for k in rows)
            mean = sum(rows[k][0] * scale[k] for k in rows) / events
            if mean / top / base > gain:
                best, gain = (e, new), mean / top / base
        return self if best is None else Generator(self.channel, self.initial, {**self.masses, best[0]: best[1]}, self.vertices, self.scalars)

    def phase_space_envelope(self) -> float:
        """A proven upper bound of the proposal weights, from the ranges of masses and energies.

        p / M of a two-body decay grows with the parent's mass and falls with the daughters'; a scattering's weight is
        bounded by the floor of its density in t. Fails where no floor is known.
        """
        roots = [e for e in self.channel.edges if self.channel.producer(e) is None]
        lo, hi, bound = np.zeros(4), np.zeros(4), 1.0
        for e in roots:
            i, m = self.initial[e], self.masses[e].low
            if i.p4 is not None:
                a = b = np.array(i.p4, float)
            elif i.momentum is not None:
                p = np.array(i.momentum)
                a = b = np.array([math.sqrt(p @ p + m * m), *p])
            else:
                d = np.array(i.direction) / np.linalg.norm(i.direction)
                ends = [i.energy.low, i.energy.low if i.energy.kind == "fixed" else i.energy.high]
                a, b = (np.array([x, *(math.sqrt(x * x - m * m) * d)]) for x in ends)
                if i.energy.kind == "uniform":
                    bound *= i.energy.high - i.energy.low
                elif i.energy.kind == "histogram":
                    raise NotImplementedError("no bound for energies from a histogram")
            lo, hi = lo + a, hi + b
        top = max(math.sqrt(max(x[0] ** 2 - x[1:] @ x[1:], 0)) for x in (lo, hi))
        low_top = min(math.sqrt(max(x[0] ** 2 - x[1:] @ x[1:], 0)) for x in (lo, hi))
        rng: dict[str, tuple[float, float]] = {}
        for e, m in self.masses.items():
            rng[e] = (m.low, m.low) if m.high is None else (max(m.low, 0.0), min(m.high, top))
            if m.high is not None:
                if m.learned is not None:
                    bound *= (rng[e][1] - rng[e][0]) / m.defensive
                else:
                    bound *= rng[e][1] - rng[e][0]
        for s in self.scalars.values():
            if s.kind == "uniform":
                bound *= s.high - s.low
            elif s.kind == "histogram":
                raise NotImplementedError("no bound for scalars from a histogram")
        for name in self.order:
            v, p = self.channel.vertices[name], self.vertices.get(name, VertexProposal())
            a, b = (rng[e][0] for e in v.outgoing)
            if p.kind == "decay":
                big = rng[v.incoming[0]][1] if v.incoming[0] not in roots else top
                bound *= float(breakup(np.array(big), np.array(a), np.array(b))) / (4 * math.pi * big) * (1 / p.defensive if p.learned else 1)
                continue
            m1, m2 = (self.masses[e].low for e in v.incoming)
            width = 0.0
            for rs in (low_top, top):
                width = max(width, 4 * float(breakup(np.array(rs), np.array(m1), np.array(m2))) * float(breakup(np.array(rs), np.array(a), np.array(b))))
            total = sum(w for w, _ in p.components)
            floor = sum(w / total * part.floor(width) for w, part in p.components)
            p_in = float(breakup(np.array(low_top), np.array(m1), np.array(m2)))
            if not (floor > 0 and p_in > 0):
                raise NotImplementedError("no floor of the density in t is known")
            bound *= 1 / (16 * math.pi * low_top * p_in * floor)
        return bound * (1 + 1e-12)


def acceptance(seed: int, index):
    """The number in (0, 1) that decides on an event, as a column."""
    from .sampling import _signed, splitmix64, wrapping_mul

    fixed = ((seed & MASK) ^ (ACCEPTANCE * STREAM_KEY & MASK)) & MASK
    state = wrapping_mul(index.cast("long"), INDEX_KEY).bitwiseXOR(F.lit(_signed(fixed)).cast("long"))
    h = splitmix64(splitmix64(state))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def acceptance_np(seed: int, index: np.ndarray) -> np.ndarray:
    return Rng.of(seed, ACCEPTANCE, index, 0).uniform()


def two_body(parent: float, a: float, b: float, p: Sequence[float] = (0.0, 0.0, 0.0)) -> Generator:
    """A decay of one particle into two."""
    from ..functions.channel import Edge, Vertex

    ch = Channel.of([Edge("parent"), Edge("a"), Edge("b")], [Vertex("decay", ("parent",), ("a", "b"))])
    return Generator(ch, {"parent": InitialMomentum(momentum=tuple(p))}, {"parent": parent, "a": a, "b": b})
