"""Expressions as text: equations, LaTeX, trees, DOT and SVG, with styles chosen by rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from html import escape

from .expr import Expr

INFIX = {"add": "+", "sub": "-", "mul": "*", "div": "/"}
LEVEL = {"add": 1, "sub": 1, "mul": 2, "div": 2, "neg": 3, "powi": 4}


def _number(z: complex) -> str:
    return f"{z.real:g}" if z.imag == 0 else f"{z.imag:g}i" if z.real == 0 else f"({z.real:g}{z.imag:+g}i)"


def _leaf(e: Expr) -> str | None:
    if e.op == "const":
        return _number(e.data)
    if e.op == "param":
        return e.data.name
    if e.op == "scalar":
        return e.data
    return f"{e.data[0]}.{e.data[1]}" if e.op == "p4" else None


def equation(root: Expr, labels: bool = True) -> str:
    """One line; named parts by their names."""
    done: dict[int, tuple[str, int]] = {}
    for e in root.nodes():
        a = [done[id(x)] for x in e.args]
        wrap = lambda i, level, a=a: a[i][0] if a[i][1] >= level else f"({a[i][0]})"
        leaf = _leaf(e)
        level = LEVEL.get(e.op, 5)
        if labels and e.label and e is not root:
            out, level = e.label, 5
        elif leaf is not None:
            out = leaf
        elif e.op in INFIX:
            out = f"{wrap(0, level)} {INFIX[e.op]} {wrap(1, level + (e.op in ('sub', 'div')))}"
        elif e.op == "neg":
            out = f"-{wrap(0, 3)}"
        elif e.op == "powi":
            out = f"{wrap(0, 5)}^{e.data}"
        elif e.op in ("component", "element"):
            out = f"{wrap(0, 5)}[{', '.join(map(str, e.data if isinstance(e.data, tuple) else (e.data,)))}]"
        elif e.op == "norm_sqr":
            out = f"|{a[0][0]}|^2"
        else:
            out = f"{e.op}({', '.join(x[0] for x in a)})"
        done[id(e)] = out, level
    return done[id(root)][0]


def latex(root: Expr) -> str:
    done: dict[int, tuple[str, int]] = {}
    functions = {"sin": r"\sin", "cos": r"\cos", "exp": r"\exp", "log": r"\log", "real": r"\operatorname{Re}", "imag": r"\operatorname{Im}", "atan2": r"\operatorname{atan2}"}
    for e in root.nodes():
        a = [done[id(x)] for x in e.args]
        wrap = lambda i, level, a=a: a[i][0] if a[i][1] >= level else rf"\left({a[i][0]}\right)"
        level = LEVEL.get(e.op, 5)
        leaf = _leaf(e)
        if leaf is not None:
            out = (e.data.latex or rf"\mathrm{{{leaf}}}") if e.op == "param" else leaf if e.op == "const" else rf"\mathrm{{{leaf}}}"
        elif e.op == "div":
            out, level = rf"\frac{{{a[0][0]}}}{{{a[1][0]}}}", 5
        elif e.op == "mul":
            out = rf"{wrap(0, 2)} {wrap(1, 2)}"
        elif e.op in INFIX:
            out = f"{wrap(0, level)} {INFIX[e.op]} {wrap(1, level + (e.op == 'sub'))}"
        elif e.op == "neg":
            out = f"-{wrap(0, 3)}"
        elif e.op == "powi":
            out = f"{{{wrap(0, 5)}}}^{{{e.data}}}"
        elif e.op == "sqrt":
            out = rf"\sqrt{{{a[0][0]}}}"
        elif e.op == "norm_sqr":
            out = rf"\left|{a[0][0]}\right|^2"
        elif e.op == "conj":
            out = rf"\overline{{{a[0][0]}}}"
        elif e.op in ("vector", "matrix"):
            cols = 1 if e.op == "vector" else e.shape[1]
            rows = [" & ".join(x[0] for x in a[i : i + cols]) for i in range(0, len(a), cols)]
            out = r"\begin{pmatrix}" + r" \\ ".join(rows) + r"\end{pmatrix}"
        elif e.op in ("component", "element"):
            out = f"{{{wrap(0, 5)}}}_{{{e.data}}}"
        else:
            name = functions.get(e.op, rf"\operatorname{{{e.op}}}")
            inner = ", ".join(x[0] for x in a)
            out = rf"{name}\left({inner}\right)"
        done[id(e)] = out, level
    return done[id(root)][0]


def _title(e: Expr) -> str:
    leaf = _leaf(e)
    text = leaf if leaf is not None else f"{e.op} {e.data}" if e.data is not None else e.op
    return text + (f" '{e.label}'" if e.label else "") + (f" #{', #'.join(sorted(e.tags))}" if e.tags else "")


def tree(root: Expr) -> str:
    """One line per use of a node, indented."""
    out: list[str] = []
    stack = [(root, "", "")]
    while stack:
        e, lead, below = stack.pop()
        out.append(lead + _title(e))
        for i, a in reversed(list(enumerate(e.args))):
            last = i == len(e.args) - 1
            stack.append((a, below + ("`- " if last else "|- "), below + ("   " if last else "|  ")))
    return "\n".join(out)


@dataclass(frozen=True)
class Style:
    """How nodes look that a rule picks: by kind, name or tag; None picks any."""

    fill: str = "white"
    line: str = "black"
    kind: str | None = None
    label: str | None = None
    tag: str | None = None

    def fits(self, e: Expr) -> bool:
        return (self.kind in (None, e.op)) and (self.label is None or e.label == self.label) and (self.tag is None or self.tag in e.tags)


#: Parameters, columns and constants apart from operations.
PRESET = (Style("lightblue", kind="param"), Style("palegreen", kind="scalar"), Style("palegreen", kind="p4"), Style("lightgray", kind="const"))


def _style(e: Expr, rules: Sequence[Style]) -> Style:
    out = Style()
    for r in rules:
        if r.fits(e):
            out = r
    return out


def dot(root: Expr, rules: Sequence[Style] = PRESET) -> str:
    """Graphviz source; equal parts are drawn once."""
    root = root.merged()
    nodes = root.nodes()
    at = {id(e): i for i, e in enumerate(nodes)}
    out = ["digraph expression {"]
    for i, e in enumerate(nodes):
        s = _style(e, rules)
        title = _title(e).replace('"', "'")
        out.append(f'  n{i} [label="{title}", style=filled, fillcolor="{s.fill}", color="{s.line}"];')
        out += [f"  n{i} -> n{at[id(a)]};" for a in e.args]
    return "\n".join([*out, "}"])


def svg(root: Expr, rules: Sequence[Style] = PRESET) -> str:
    """A picture of the graph in layers, the result on top."""
    root = root.merged()
    nodes = root.nodes()
    depth = {id(root): 0}
    for e in reversed(nodes):
        for a in e.args:
            depth[id(a)] = max(depth.get(id(a), 0), depth[id(e)] + 1)
    layers: dict[int, list[Expr]] = {}
    for e in nodes:
        layers.setdefault(depth[id(e)], []).append(e)
    wide = max(len(v) for v in layers.values())
    place = {id(e): (70 + 140 * (i + (wide - len(v)) / 2), 30 + 70 * d) for d, v in layers.items() for i, e in enumerate(v)}
    body = []
    for e in nodes:
        x, y = place[id(e)]
        body += [f'<line x1="{x}" y1="{y}" x2="{place[id(a)][0]}" y2="{place[id(a)][1]}" stroke="gray"/>' for a in e.args]
    for e in nodes:
        x, y = place[id(e)]
        s = _style(e, rules)
        body.append(f'<rect x="{x - 60}" y="{y - 15}" width="120" height="30" rx="8" fill="{s.fill}" stroke="{s.line}"/><text x="{x}" y="{y + 4}" text-anchor="middle" font-size="11">{escape(_title(e))}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{140 * wide}" height="{70 * len(layers)}">{"".join(body)}</svg>'
