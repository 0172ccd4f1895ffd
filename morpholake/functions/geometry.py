"""Plane geometry as SQL expressions over point columns x0, y0, x1, y1, ..

Fixed-size shapes are written out as arithmetic, which whole-stage code generation fuses; only polygons that must be
sorted by direction, and searches for the nearest points, use array functions. A division by zero gives NULL.
"""

from __future__ import annotations

from collections.abc import Sequence


def num(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


EPS = "CAST(1e-12 AS DOUBLE)"


def _ring(which: Sequence[int]) -> list[tuple[int, int]]:
    return list(zip(which, [*which[1:], which[0]], strict=True))


class Geometry:
    """Expressions in Spark's SQL. A subclass may write the few that are not common SQL in another dialect."""

    def ratio(self, top: str, below: str) -> str:
        return f"try_divide({top}, {below})"

    def dist(self, a: int, b: int) -> str:
        return f"sqrt((x{a} - x{b}) * (x{a} - x{b}) + (y{a} - y{b}) * (y{a} - y{b}))"

    def mean(self, parts: Sequence[str]) -> str:
        return f"(({' + '.join(parts)}) / {num(float(len(parts)))})"

    def middle(self, axis: str, a: int, b: int) -> str:
        return self.mean([f"{axis}{a}", f"{axis}{b}"])

    def angle(self, corner: int, a: int, b: int) -> str:
        """Degrees between the rays from corner to a and to b."""
        dot = f"((x{a} - x{corner}) * (x{b} - x{corner}) + (y{a} - y{corner}) * (y{b} - y{corner}))"
        cosine = f"{dot} / ({self.dist(corner, a)} * {self.dist(corner, b)} + {EPS})"
        return f"degrees(acos(greatest({num(-1.0)}, least({num(1.0)}, {cosine}))))"

    def area(self, ring: Sequence[int]) -> str:
        """Area of the polygon through ring, in that order."""
        return f"({num(0.5)} * abs({' + '.join(f'(x{a} * y{b} - x{b} * y{a})' for a, b in _ring(ring))}))"

    def perimeter(self, ring: Sequence[int]) -> str:
        return f"({' + '.join(self.dist(a, b) for a, b in _ring(ring))})"

    def points(self, which: Sequence[int]) -> str:
        """An array of structs i, x, y."""
        return "array(" + ", ".join(f"named_struct('i', {n}, 'x', x{i}, 'y', y{i})" for n, i in enumerate(which)) + ")"

    def star(self, pts: str) -> str:
        """Area of the polygon through an array of points, sorted by their direction from the mean point; 0 below three points, NULL for NULL."""
        centre = f"transform(array({pts}), v -> named_struct('v', v, 'cx', aggregate(v, {num(0.0)}, (s, p) -> s + p.x) / size(v), 'cy', aggregate(v, {num(0.0)}, (s, p) -> s + p.y) / size(v)))"
        around = f"transform({centre}, m -> array_sort(transform(m.v, (p, i) -> named_struct('a', atan2(p.y - m.cy, p.x - m.cx), 'i', i, 'x', p.x, 'y', p.y))))"
        turns = "zip_with(s, concat(slice(s, 2, size(s)), slice(s, 1, 1)), (p, q) -> p.x * q.y - q.x * p.y)"
        whole = f"transform({around}, s -> CASE WHEN s IS NULL THEN NULL WHEN size(s) < 3 THEN {num(0.0)} ELSE {num(0.5)} * abs(aggregate({turns}, {num(0.0)}, (t, v) -> t + v)) END)"
        return f"element_at({whole}, 1)"

    def by_x(self, which: Sequence[int], place: int, axis: str) -> str:
        """A coordinate of the place-th point (1: first, -1: last) of some sorted by x, ties by y."""
        pts = ", ".join(f"named_struct('x', x{i}, 'y', y{i})" for i in which)
        return f"element_at(array_sort(array({pts})), {place}).{axis}"

    def curvature(self, which: Sequence[int]) -> str:
        """Quadratic coefficient of the least-squares parabola of y on x, from power sums about the means."""
        mx, my = self.mean([f"x{i}" for i in which]), self.mean([f"y{i}" for i in which])
        u, v = [f"(x{i} - {mx})" for i in which], [f"(y{i} - {my})" for i in which]
        total = lambda *powers: "(" + " + ".join(" * ".join([a] * powers[0] + [b] * powers[1]) for a, b in zip(u, v, strict=True)) + ")"
        s2, s3, s4, t1, t2 = total(2, 0), total(3, 0), total(4, 0), total(1, 1), total(2, 1)
        return self.ratio(f"({t2} * {s2} - {t1} * {s3})", f"({s4} * {s2} - {s3} * {s3} - {s2} * {s2} * {s2} / {num(float(len(which)))})")

    def nearest(self, which: Sequence[int], side: int, to: int, count: int) -> str:
        """The count points of a side (sign of x) that are nearest to point to in y, ties by place; fewer if there are fewer."""
        kept = f"filter({self.points(which)}, p -> signum(p.x) = {side})"
        ranked = f"array_sort(transform({kept}, p -> named_struct('k', abs(p.y - y{to}), 'i', p.i, 'x', p.x, 'y', p.y)))"
        return f"slice({ranked}, 1, {count})"

    def edge_x(self, two: str, to: int) -> str:
        """x of the line through an array's two points at point to's y; NULL with fewer than two."""
        return (
            f"element_at(transform(array({two}), t -> CASE WHEN size(t) < 2 THEN NULL WHEN abs(t[0].y - t[1].y) < {num(1e-6)} THEN (t[0].x + t[1].x) / {num(2.0)}"
            f" ELSE t[0].x + (y{to} - t[0].y) * (t[1].x - t[0].x) / (t[1].y - t[0].y) END), 1)"
        )

    def and_point(self, pts: str, which: int) -> str:
        """An array of at least two points with one more at its end; NULL with fewer than two."""
        return f"element_at(transform(array({pts}), t -> CASE WHEN size(t) >= 2 THEN concat(transform(t, p -> named_struct('x', p.x, 'y', p.y)), array(named_struct('x', x{which}, 'y', y{which}))) END), 1)"
