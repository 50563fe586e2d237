"""Reaction channels: named edges (particles) and vertices, momenta by conservation, frames and angles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from ..plans.expr import Expr, atan2
from .vectors import Vec3, Vec4


class ChannelError(ValueError):
    """A topology that is not valid, or a momentum that can't be inferred."""


@dataclass(frozen=True)
class Edge:
    """A particle line; `p4` names its four-momentum column if it is measured, or gives it."""

    name: str
    p4: str | Vec4 | None = None
    particle: object = None
    output: bool = True


@dataclass(frozen=True)
class Vertex:
    name: str
    incoming: tuple[str, ...]
    outgoing: tuple[str, ...]


@dataclass
class Channel:
    """A connected, acyclic graph: every edge comes from at most one vertex and goes into at most one."""

    edges: dict[str, Edge] = field(default_factory=dict)
    vertices: dict[str, Vertex] = field(default_factory=dict)

    @classmethod
    def of(cls, edges: Sequence[Edge], vertices: Sequence[Vertex]) -> Channel:
        out = cls()
        for e in edges:
            if e.name in out.edges:
                raise ChannelError(f"edge {e.name} is there twice")
            out.edges[e.name] = e
        for v in vertices:
            if v.name in out.vertices:
                raise ChannelError(f"vertex {v.name} is there twice")
            out.vertices[v.name] = v
        out.validate()
        return out

    def validate(self) -> None:
        for v in self.vertices.values():
            for e in (*v.incoming, *v.outgoing):
                if e not in self.edges:
                    raise ChannelError(f"vertex {v.name} has an unknown edge {e}")
            if not v.incoming or not v.outgoing:
                raise ChannelError(f"vertex {v.name} needs edges in and out")
        for side in ("incoming", "outgoing"):
            seen = [e for v in self.vertices.values() for e in getattr(v, side)]
            twice = {e for e in seen if seen.count(e) > 1}
            if twice:
                raise ChannelError(f"edges {sorted(twice)} are {side} at two vertices")
        done: set[str] = set()
        while len(done) < len(self.vertices):
            ready = [v.name for v in self.vertices.values() if v.name not in done and all((p := self.producer(e)) is None or p.name in done for e in v.incoming)]
            if not ready:
                raise ChannelError("the vertices form a cycle")
            done.update(ready)

    def producer(self, edge: str) -> Vertex | None:
        return next((v for v in self.vertices.values() if edge in v.outgoing), None)

    def consumer(self, edge: str) -> Vertex | None:
        return next((v for v in self.vertices.values() if edge in v.incoming), None)

    def particle(self, edge: str):
        return self.edges[edge].particle

    # -- momenta ---------------------------------------------------------------------------------------------------

    def is_explicit(self, edge: str) -> bool:
        return self.edges[edge].p4 is not None

    def p4(self, edge: str, _open: frozenset[str] = frozenset()) -> Vec4:
        """The measured momentum; else the daughters' sum, else the parents' less the siblings', at either vertex."""
        if edge not in self.edges:
            raise ChannelError(f"no edge {edge}")
        given = self.edges[edge].p4
        if given is not None:
            return given if isinstance(given, Vec4) else Vec4.event(given)
        if edge in _open:
            raise ChannelError(f"the momentum of {edge} depends on itself")
        busy = _open | {edge}
        ways = []
        if v := self.consumer(edge):
            ways.append((v.outgoing, [e for e in v.incoming if e != edge]))
        if v := self.producer(edge):
            ways.append((v.incoming, [e for e in v.outgoing if e != edge]))
        for plus, minus in ways:
            try:
                out = self._sum([self.p4(e, busy) for e in plus])
                return out - self._sum([self.p4(e, busy) for e in minus]) if minus else out
            except ChannelError:
                continue
        raise ChannelError(f"the momentum of {edge} can't be inferred")

    @staticmethod
    def _sum(items: list[Vec4]) -> Vec4:
        out = items[0]
        for x in items[1:]:
            out = out + x
        return out

    def vec3(self, edge: str) -> Vec3:
        return self.p4(edge).vec3()

    def mass(self, edge: str) -> Expr:
        return self.p4(edge).m()

    def s(self, edge: str) -> Expr:
        """The squared mass."""
        return self.p4(edge).m2()

    def vertex(self, name: str) -> VertexFrame:
        if name not in self.vertices:
            raise ChannelError(f"no vertex {name}")
        return VertexFrame(self, name)

    def path(self, vertex: str) -> tuple[str, list[str]]:
        """The root vertex, and the edges from it down to a vertex."""
        edges: list[str] = []
        at = self.vertices[vertex]
        while True:
            up = [(e, p) for e in at.incoming if (p := self.producer(e)) is not None]
            if not up:
                return at.name, edges[::-1]
            if len(up) > 1:
                raise ChannelError(f"vertex {at.name} has several produced parents: its frame is ambiguous")
            edges.append(up[0][0])
            at = up[0][1]

    def edge_names(self) -> list[str]:
        return list(self.edges)

    def vertex_names(self) -> list[str]:
        return list(self.vertices)


@dataclass(frozen=True)
class VertexFrame:
    """Kinematics in the rest frame of what enters a vertex, reached by boosts from the root down."""

    channel: Channel
    name: str

    def p4(self, edge: str) -> Vec4:
        root, edges = self.channel.path(self.name)
        total = Channel._sum([self.channel.p4(e) for e in self.channel.vertices[root].incoming])
        boosts = [-total.beta()]
        for e in edges:
            p = self.channel.p4(e)
            for b in boosts:
                p = p.boost(b)
            boosts.append(-p.beta())
        out = self.channel.p4(edge)
        for b in boosts:
            out = out.boost(b)
        return out

    def vec3(self, edge: str) -> Vec3:
        return self.p4(edge).vec3()

    def costheta(self, edge: str, z_axis: Vec3, y_hint: Vec3 | None = None) -> Expr:
        """About the axis; the hint has no part in it."""
        p = self.vec3(edge)
        return p.dot(z_axis.unit()) / p.mag()

    def theta(self, edge: str, z_axis: Vec3, y_hint: Vec3 | None = None) -> Expr:
        return self.costheta(edge, z_axis, y_hint).acos()

    def phi(self, edge: str, z_axis: Vec3, y_hint: Vec3) -> Expr:
        """With y the hint's part across z, and x = y cross z."""
        p, z = self.vec3(edge), z_axis.unit()
        y = (y_hint - z * y_hint.dot(z)).unit()
        return atan2(p.dot(y), p.dot(y.cross(z)))

    def mandelstam(self, which: str) -> Expr:
        """s, t or u of a two-to-two vertex, from the pair of edges of which more are measured."""
        v = self.channel.vertices[self.name]
        if len(v.incoming) != 2 or len(v.outgoing) != 2:
            raise ChannelError(f"vertex {self.name} is not two to two")
        (a, b), (c, d) = v.incoming, v.outgoing
        pairs = {"s": [(a, b, 1), (c, d, 1)], "t": [(a, c, -1), (b, d, -1)], "u": [(a, d, -1), (b, c, -1)]}[which]
        best = None
        for x, y, sign in pairs:
            try:
                p, r = self.channel.p4(x), self.channel.p4(y)
            except ChannelError:
                continue
            score = self.channel.is_explicit(x) + self.channel.is_explicit(y)
            if best is None or score > best[0]:
                best = (score, (p + r if sign > 0 else p - r).m2())
        if best is None:
            raise ChannelError(f"no {which} at vertex {self.name}")
        return best[1]

    def s(self) -> Expr:
        return self.mandelstam("s")

    def t(self) -> Expr:
        return self.mandelstam("t")

    def u(self) -> Expr:
        return self.mandelstam("u")
