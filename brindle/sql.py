"""Pieces of the oracle SQL: long calculations as chains of named columns, random numbers, complex linear algebra."""

from __future__ import annotations

from .operators.generate import INDEX_KEY, OBJECT_KEY, STREAM_KEY
from .operators.sampling import GOLDEN, MASK, MIX


class Steps:
    """A chain of tables, each with all columns of the one before and some more."""

    def __init__(self, first: str):
        self.tables = [f"t0 AS ({first})"]

    def add(self, **columns: str) -> Steps:
        n = len(self.tables)
        cells = ", ".join(f"{e} AS {c}" for c, e in columns.items())
        self.tables.append(f"t{n} AS (SELECT *, {cells} FROM t{n - 1})")
        return self

    def select(self, what: str) -> str:
        return "WITH " + ",\n".join(self.tables) + f"\nSELECT {what.replace('FROM _', f'FROM t{len(self.tables) - 1}')}"

    # -- splitmix64 over unsigned 64-bit columns ---------------------------------------------------------------------

    def splitmix(self, out: str, state: str) -> Steps:
        self.add(**{f"{out}_a": f"CAST((CAST({state} AS UHUGEINT) + {GOLDEN}) % 18446744073709551616 AS UBIGINT)"})
        for c, k, shift in zip("bc", MIX, (30, 27), strict=True):
            before = f"{out}_{chr(ord(c) - 1)}"
            self.add(**{f"{out}_{c}": f"CAST((CAST(xor({before}, {before} >> {shift}) AS UHUGEINT) * {k}) % 18446744073709551616 AS UBIGINT)"})
        return self.add(**{out: f"xor({out}_c, {out}_c >> 31)"})

    def stream(self, out: str, index: str, seed: int, stream: int, obj: int) -> Steps:
        """The state of an event's stream."""
        fixed = (seed ^ stream * STREAM_KEY ^ obj * OBJECT_KEY) & MASK
        self.add(**{f"{out}_x": f"xor(CAST((CAST({index} AS UHUGEINT) * {INDEX_KEY}) % 18446744073709551616 AS UBIGINT), {fixed}::UBIGINT)"})
        return self.splitmix(out, f"{out}_x")

    def uniform(self, out: str, state: str, k: int) -> Steps:
        """The k-th number of a stream, in (0, 1)."""
        self.splitmix(f"{out}_z", f"((CAST({state} AS UHUGEINT) + {k * GOLDEN}) % 18446744073709551616)")
        return self.add(**{out: f"(CAST({out}_z >> 11 AS DOUBLE) + 0.5) / 9007199254740992.0"})

    # -- four-momenta, as columns e, px, py, pz of a prefix --------------------------------------------------------

    def boost(self, out: str, p: str, bx: str, by: str, bz: str) -> Steps:
        self.add(**{f"{out}_g": f"1 / sqrt(1 - ({bx} * {bx} + {by} * {by} + {bz} * {bz}))", f"{out}_bp": f"{bx} * {p}_px + {by} * {p}_py + {bz} * {p}_pz"})
        self.add(**{f"{out}_k": f"{out}_g * {out}_g / (1 + {out}_g) * {out}_bp + {out}_g * {p}_e"})
        return self.add(**{f"{out}_e": f"{out}_g * ({p}_e + {out}_bp)", **{f"{out}_{c}": f"{p}_{c} + {b} * {out}_k" for c, b in (("px", bx), ("py", by), ("pz", bz))}})

    def decay(self, a: str, b: str, parent: str, ma: str, mb: str, state: str) -> Steps:
        """An isotropic decay; adds the columns of a and b and <a>_w, the weight."""
        self.uniform(f"{a}_u1", state, 0).uniform(f"{a}_u2", state, 1)
        self.add(**{f"{a}_m": f"sqrt(greatest({parent}_e * {parent}_e - {parent}_px * {parent}_px - {parent}_py * {parent}_py - {parent}_pz * {parent}_pz, 0))"})
        self.add(**{f"{a}_p": f"sqrt((pow({a}_m, 2) - pow({ma} + {mb}, 2)) * (pow({a}_m, 2) - pow({ma} - {mb}, 2))) / (2 * {a}_m)", f"{a}_c": f"2 * {a}_u1 - 1", f"{a}_phi": f"2 * pi() * {a}_u2"})
        self.add(**{f"{a}_s": f"sqrt(1 - {a}_c * {a}_c)", f"{a}_w": f"{a}_p / (4 * pi() * {a}_m)"})
        for out, m, sign in ((a, ma, ""), (b, mb, "-")):
            d = {"px": f"{a}_s * cos({a}_phi)", "py": f"{a}_s * sin({a}_phi)", "pz": f"{a}_c"}
            self.add(**{f"r{out}_e": f"sqrt({a}_p * {a}_p + {m} * {m})", **{f"r{out}_{c}": f"{sign}({x}) * {a}_p" for c, x in d.items()}})
            self.boost(out, f"r{out}", *(f"({parent}_{c} / {parent}_e)" for c in ("px", "py", "pz")))
        return self

    # -- complex numbers, as columns re and im ---------------------------------------------------------------------

    def loop(self, out: str, s: str, a: float, b: float) -> Steps:
        """The loop function of two masses at a positive s: <out>_re, <out>_im."""
        self.add(**{f"{out}_l": f"({s} - {(a + b) ** 2!r}) * ({s} - {(a - b) ** 2!r})", f"{out}_chi": f"1 - {(a + b) ** 2!r} / {s}"})
        self.add(**{f"{out}_r": f"sqrt(abs({out}_l)) / {s}"})
        real = f"{out}_r * ln(abs(({out}_chi + {out}_r) / ({out}_chi - {out}_r)))"
        below = f"{out}_r * (2 * pi() - 2 * atan2({out}_r, {out}_chi))"
        mass = f"{out}_chi * {(b - a) / (a + b)!r} * ln({b / a!r})"
        return self.add(**{f"{out}_re": f"(CASE WHEN {out}_l >= 0 THEN {real} ELSE {below} END - {mass}) / pi()", f"{out}_im": f"CASE WHEN {s} > {(a + b) ** 2!r} THEN -{out}_r ELSE 0 END"})

    def solve(self, a: list[list[tuple[str, str]]], y: list[tuple[str, str]], out: str) -> Steps:
        """Solves a complex system by elimination: columns <out><i>_re, <out><i>_im."""
        n = len(y)
        rows = [[*r, z] for r, z in zip(a, y, strict=True)]
        for k in range(n):
            pr, pi = rows[k][k]
            self.add(**{f"{out}n{k}": f"({pr}) * ({pr}) + ({pi}) * ({pi})"})
            new = {}
            for j in range(k, n + 1):
                x, z = rows[k][j]
                new |= {f"{out}p{k}_{j}r": f"(({x}) * ({pr}) + ({z}) * ({pi})) / {out}n{k}", f"{out}p{k}_{j}i": f"(({z}) * ({pr}) - ({x}) * ({pi})) / {out}n{k}"}
                rows[k][j] = (f"{out}p{k}_{j}r", f"{out}p{k}_{j}i")
            self.add(**new)
            new = {}
            for i in range(n):
                if i == k:
                    continue
                fr, fi = rows[i][k]
                for j in range(k + 1, n + 1):
                    (x, z), (u, v) = rows[i][j], rows[k][j]
                    new |= {f"{out}e{k}_{i}_{j}r": f"({x}) - (({fr}) * ({u}) - ({fi}) * ({v}))", f"{out}e{k}_{i}_{j}i": f"({z}) - (({fr}) * ({v}) + ({fi}) * ({u}))"}
                    rows[i][j] = (f"{out}e{k}_{i}_{j}r", f"{out}e{k}_{i}_{j}i")
            if new:
                self.add(**new)
        return self.add(**{f"{out}{i}_{c}": rows[i][n][k] for i in range(n) for k, c in enumerate(("re", "im"))})


def values(*rows: tuple) -> str:
    """A VALUES list."""
    cell = lambda v: "NULL" if v is None else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else ("TRUE" if v else "FALSE") if isinstance(v, bool) else repr(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"
