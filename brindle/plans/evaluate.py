"""NumPy evaluation of expressions over batches of events, with forward derivatives."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np

from .expr import Expr


class SingularMatrix(ArithmeticError):
    """A linear system of an event has no unique solution."""


def unary(op: str, z):
    with np.errstate(all="ignore"):
        z = np.asarray(z, complex)
        return {
            "neg": lambda: -z,
            "real": lambda: z.real + 0j,
            "imag": lambda: z.imag + 0j,
            "conj": lambda: z.conj(),
            "norm_sqr": lambda: z.real**2 + z.imag**2 + 0j,
            "sqrt": lambda: np.sqrt(z),
            "exp": lambda: np.exp(z),
            "sin": lambda: np.sin(z),
            "cos": lambda: np.cos(z),
            "log": lambda: np.log(z),
        }[op]()[()]


def binary(op: str, a, b):
    with np.errstate(all="ignore"):
        a, b = np.asarray(a, complex), np.asarray(b, complex)
        if op == "div":
            if not np.any(a.imag) and not np.any(b.imag):
                return (a.real / b.real + 0j)[()]
            return (a / b)[()]
        return {"add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b, "atan2": lambda: np.arctan2(a.real, b.real) + 0j}[op]()[()]


def _solve(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(m, v[..., None])[..., 0]
    except np.linalg.LinAlgError as e:
        raise SingularMatrix(str(e)) from None


def evaluate(root: Expr, columns: Mapping[str, np.ndarray], values: Mapping[str, float] | None = None, n: int | None = None) -> np.ndarray:
    """Values of shape (events, *shape). Columns are named physically (p4 parts as name_e and so on); fixed parameters
    and those with a default need no value. Parameter values may be arrays that broadcast over events."""
    values = values or {}
    n = len(next(iter(columns.values()))) if n is None else n
    done: dict[int, np.ndarray] = {}
    for e in root.nodes():
        a = [done[id(x)] for x in e.args]
        if e.op == "const":
            v = np.full((1,), e.data)
        elif e.op == "param":
            p = e.data
            x = p.value if p.fixed else values.get(p.name, p.value)
            if x is None:
                raise KeyError(f"parameter {p.name} has no value")
            v = np.atleast_1d(np.asarray(x, float)) + 0j
        elif e.op in ("scalar", "p4"):
            name = e.data if e.op == "scalar" else f"{e.data[0]}_{e.data[1]}"
            v = np.asarray(columns[name], float) + 0j
        elif e.op == "powi":
            with np.errstate(all="ignore"):
                v = a[0] ** e.data if e.data >= 0 else 1.0 / a[0] ** -e.data
        elif e.op == "complex":
            v = a[0] + 1j * a[1]
        elif e.op == "vector":
            v = np.stack(np.broadcast_arrays(*a), axis=-1)
        elif e.op == "matrix":
            v = np.stack(np.broadcast_arrays(*a), axis=-1).reshape(-1, *e.shape)
        elif e.op == "component":
            v = a[0][:, e.data]
        elif e.op == "element":
            v = a[0][:, e.data[0], e.data[1]]
        elif e.op == "matmul":
            v = a[0] @ a[1]
        elif e.op == "matvec":
            v = (a[0] @ a[1][..., None])[..., 0]
        elif e.op == "dot":
            v = (a[0] * a[1]).sum(axis=-1)
        elif e.op == "solve":
            k = max(len(a[0]), len(a[1]))
            m, r = np.broadcast_to(a[0], (k, *a[0].shape[1:])), np.broadcast_to(a[1], (k, *a[1].shape[1:]))
            v = _solve(m, r)
        elif len(a) == 1:
            v = unary(e.op, a[0])
        else:
            v = binary(e.op, a[0], a[1])
        done[id(e)] = np.asarray(v)
    out = done[id(root)]
    return np.broadcast_to(out, (n, *out.shape[1:]))
