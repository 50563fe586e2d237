"""Three- and four-vectors: symbolic over event columns, and plain numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from ..plans.expr import Expr, atan2, p4_component, vector


class Vec3:
    """A symbolic three-vector."""

    def __init__(self, x, y, z):
        self.px, self.py, self.pz = Expr.of(x), Expr.of(y), Expr.of(z)

    @classmethod
    def event(cls, name: str) -> Vec3:
        """The spatial part of a four-momentum column."""
        return cls(*(p4_component(name, c) for c in ("px", "py", "pz")))

    @classmethod
    def zero(cls) -> Vec3:
        return cls(0.0, 0.0, 0.0)

    @classmethod
    def x_axis(cls) -> Vec3:
        return cls(1.0, 0.0, 0.0)

    @classmethod
    def y_axis(cls) -> Vec3:
        return cls(0.0, 1.0, 0.0)

    @classmethod
    def z_axis(cls) -> Vec3:
        return cls(0.0, 0.0, 1.0)

    x, y, z = x_axis, y_axis, z_axis

    def dot(self, o: Vec3) -> Expr:
        return self.px * o.px + self.py * o.py + self.pz * o.pz

    __matmul__ = dot

    def cross(self, o: Vec3) -> Vec3:
        return Vec3(self.py * o.pz - self.pz * o.py, self.pz * o.px - self.px * o.pz, self.px * o.py - self.py * o.px)

    def mag2(self) -> Expr:
        return self.px**2 + self.py**2 + self.pz**2

    def mag(self) -> Expr:
        return self.mag2().sqrt()

    def costheta(self) -> Expr:
        return self.pz / self.mag()

    def phi(self) -> Expr:
        return atan2(self.py, self.px)

    def unit(self) -> Vec3:
        return self / self.mag()

    def with_mass(self, mass) -> Vec4:
        return Vec4(self.px, self.py, self.pz, (self.mag2() + Expr.of(mass) ** 2).sqrt())

    def with_energy(self, energy) -> Vec4:
        return Vec4(self.px, self.py, self.pz, energy)

    def as_expr(self) -> Expr:
        return vector([self.px, self.py, self.pz])

    def __add__(self, o: Vec3) -> Vec3:
        return Vec3(self.px + o.px, self.py + o.py, self.pz + o.pz)

    def __sub__(self, o: Vec3) -> Vec3:
        return Vec3(self.px - o.px, self.py - o.py, self.pz - o.pz)

    def __neg__(self) -> Vec3:
        return Vec3(-self.px, -self.py, -self.pz)

    def __mul__(self, k) -> Vec3:
        return Vec3(self.px * k, self.py * k, self.pz * k)

    __rmul__ = __mul__

    def __truediv__(self, k) -> Vec3:
        return Vec3(self.px / k, self.py / k, self.pz / k)


class Vec4:
    """A symbolic four-vector; products have the signature (+, -, -, -)."""

    def __init__(self, px, py, pz, e):
        self.px, self.py, self.pz, self.e = Expr.of(px), Expr.of(py), Expr.of(pz), Expr.of(e)

    @classmethod
    def event(cls, name: str) -> Vec4:
        return cls(*(p4_component(name, c) for c in ("px", "py", "pz", "e")))

    def vec3(self) -> Vec3:
        return Vec3(self.px, self.py, self.pz)

    momentum = vec3

    def dot(self, o: Vec4) -> Expr:
        return self.e * o.e - self.vec3().dot(o.vec3())

    __matmul__ = dot

    def m2(self) -> Expr:
        return self.e**2 - self.vec3().mag2()

    mag2 = m2

    def m(self) -> Expr:
        """The invariant mass; imaginary for a spacelike vector."""
        return self.m2().sqrt()

    mass = mag = m

    def beta(self) -> Vec3:
        return self.vec3() / self.e

    def gamma(self) -> Expr:
        b2 = self.beta().mag2()
        return 1.0 / (1.0 - b2).sqrt()

    def boost(self, beta: Vec3) -> Vec4:
        """An active boost. With g = gamma, (g - 1) / beta^2 is written g^2 / (1 + g), which is finite at rest."""
        b2 = beta.mag2()
        g = 1.0 / (1.0 - b2).sqrt()
        bp = beta.dot(self.vec3())
        k = g**2 / (1.0 + g) * bp + g * self.e
        p = self.vec3() + beta * k
        return Vec4(p.px, p.py, p.pz, g * (self.e + bp))

    def as_expr(self) -> Expr:
        return vector([self.e, self.px, self.py, self.pz])

    def __add__(self, o: Vec4) -> Vec4:
        return Vec4(self.px + o.px, self.py + o.py, self.pz + o.pz, self.e + o.e)

    def __sub__(self, o: Vec4) -> Vec4:
        return Vec4(self.px - o.px, self.py - o.py, self.pz - o.pz, self.e - o.e)

    def __neg__(self) -> Vec4:
        return Vec4(-self.px, -self.py, -self.pz, -self.e)


@dataclass(frozen=True)
class RealVec3:
    """Numbers."""

    x: float
    y: float
    z: float

    def dot(self, o: RealVec3) -> float:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: RealVec3) -> RealVec3:
        return RealVec3(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def mag2(self) -> float:
        return self.dot(self)

    def mag(self) -> float:
        return math.sqrt(self.mag2())

    def unit(self) -> RealVec3:
        m = self.mag()
        if m == 0:
            raise ZeroDivisionError("a zero vector has no direction")
        return self * (1 / m)

    def costheta(self) -> float:
        return self.unit().z

    def phi(self) -> float:
        return math.atan2(self.y, self.x)

    def with_mass(self, mass: float) -> RealVec4:
        return RealVec4(math.sqrt(self.mag2() + mass * mass), self.x, self.y, self.z)

    def __add__(self, o: RealVec3) -> RealVec3:
        return RealVec3(self.x + o.x, self.y + o.y, self.z + o.z)

    def __sub__(self, o: RealVec3) -> RealVec3:
        return RealVec3(self.x - o.x, self.y - o.y, self.z - o.z)

    def __neg__(self) -> RealVec3:
        return self * -1.0

    def __mul__(self, k: float) -> RealVec3:
        return RealVec3(self.x * k, self.y * k, self.z * k)

    __rmul__ = __mul__


@dataclass(frozen=True)
class RealVec4:
    """Numbers, energy first."""

    e: float
    px: float
    py: float
    pz: float

    def vec3(self) -> RealVec3:
        return RealVec3(self.px, self.py, self.pz)

    def dot(self, o: RealVec4) -> float:
        return self.e * o.e - self.vec3().dot(o.vec3())

    def m2(self) -> float:
        return self.dot(self)

    def m(self) -> float:
        if self.m2() < 0:
            raise ValueError("a spacelike vector has no real mass")
        return math.sqrt(self.m2())

    def signed_m(self) -> float:
        """The mass, negative for a spacelike vector."""
        return math.copysign(math.sqrt(abs(self.m2())), self.m2())

    def beta(self) -> RealVec3:
        return self.vec3() * (1 / self.e)

    def gamma(self) -> float:
        return 1 / math.sqrt(1 - self.beta().mag2())

    def boost(self, beta: RealVec3) -> RealVec4:
        b2 = beta.mag2()
        if b2 >= 1:
            raise ValueError("a boost must be slower than light")
        g = 1 / math.sqrt(1 - b2)
        bp = beta.dot(self.vec3())
        p = self.vec3() + beta * (g * g / (1 + g) * bp + g * self.e)
        return RealVec4(g * (self.e + bp), p.x, p.y, p.z)

    def __add__(self, o: RealVec4) -> RealVec4:
        return RealVec4(self.e + o.e, self.px + o.px, self.py + o.py, self.pz + o.pz)

    def __sub__(self, o: RealVec4) -> RealVec4:
        return RealVec4(self.e - o.e, self.px - o.px, self.py - o.py, self.pz - o.pz)
