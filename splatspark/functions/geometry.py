"""Rotations and affine maps: columns where they depend on rows, plain numbers where they are parameters."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[float]
Matrix = tuple[tuple[float, float, float], ...]
IDENTITY: Matrix = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))


def quaternion_matrix(q: Vector) -> Matrix:
    """Of a quaternion (w, x, y, z), which is normalised first."""
    n = math.sqrt(sum(v * v for v in q)) or 1.0
    w, x, y, z = (v / n for v in q)
    return (
        (1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
        (2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        (2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
    )


def axis_angle_quaternion(v: Vector) -> tuple[float, float, float, float]:
    angle = math.sqrt(sum(c * c for c in v))
    if angle < 1e-12:
        return (1.0, 0.0, 0.0, 0.0)
    s = math.sin(angle / 2) / angle
    return (math.cos(angle / 2), v[0] * s, v[1] * s, v[2] * s)


def quaternion_axis_angle(q: Vector) -> tuple[float, float, float]:
    n = math.sqrt(sum(v * v for v in q)) or 1.0
    w, *axis = (v / n for v in q)
    if w < 0:
        w, axis = -w, [-a for a in axis]
    s = math.sqrt(sum(a * a for a in axis))
    return tuple(a / s * 2 * math.atan2(s, w) if s > 1e-12 else 0.0 for a in axis)  # type: ignore[return-value]


def matrix_quaternion(m: Matrix) -> tuple[float, float, float, float]:
    """The quaternion with w >= 0, from the greatest of the four squares."""
    t = m[0][0] + m[1][1] + m[2][2]
    squares = (1 + t, 1 + 2 * m[0][0] - t, 1 + 2 * m[1][1] - t, 1 + 2 * m[2][2] - t)
    most = max(range(4), key=squares.__getitem__)
    a, b, c = m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]
    d, e, f = m[0][1] + m[1][0], m[0][2] + m[2][0], m[1][2] + m[2][1]
    rows = ((squares[0], a, b, c), (a, squares[1], d, e), (b, d, squares[2], f), (c, e, f, squares[3]))
    q = [v / (2 * math.sqrt(squares[most])) for v in rows[most]]
    return tuple(-v if q[0] < 0 else v for v in q)  # type: ignore[return-value]


def euler_quaternion(roll: float, pitch: float, yaw: float) -> tuple[float, float, float, float]:
    """Radians; roll about x first, then pitch about y, then yaw about z."""
    q = (1.0, 0.0, 0.0, 0.0)
    for axis, angle in ((2, yaw), (1, pitch), (0, roll)):
        turn = [math.cos(angle / 2), 0.0, 0.0, 0.0]
        turn[axis + 1] = math.sin(angle / 2)
        q = multiply(q, turn)
    return q


def multiply(p: Sequence, q: Sequence) -> tuple:
    """Product of quaternions of numbers or of columns."""
    (a, b, c, d), (e, f, g, h) = p, q
    return (a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e)


def xyzw(q: Vector) -> tuple[float, ...]:
    return (q[1], q[2], q[3], q[0])


def wxyz(q: Vector) -> tuple[float, ...]:
    return (q[3], q[0], q[1], q[2])


def matmul(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)) for i in range(3))  # type: ignore[return-value]


def transpose(m: Matrix) -> Matrix:
    return tuple(zip(*m))  # type: ignore[return-value]


@dataclass(frozen=True)
class Transform:
    """p' = R * ((p - centre) * scale) + centre + move."""

    move: tuple[float, float, float] = (0.0, 0.0, 0.0)
    scale: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rotation: tuple[float, float, float, float] = (1.0, 0.0, 0.0, 0.0)
    centre: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @property
    def neutral(self) -> bool:
        return self.move == (0, 0, 0) and self.scale == (1, 1, 1) and self.matrix == IDENTITY

    @property
    def uniform(self) -> bool:
        return self.scale[0] == self.scale[1] == self.scale[2]

    @property
    def matrix(self) -> Matrix:
        return quaternion_matrix(self.rotation)

    def points(self, p: Sequence) -> list:
        """Of columns or of numbers."""
        local = [(v - c) * s for v, c, s in zip(p, self.centre, self.scale)]
        return [row[0] * local[0] + row[1] * local[1] + row[2] * local[2] + c + t for row, c, t in zip(self.matrix, self.centre, self.move)]

    def inverse_points(self, p: Sequence) -> list:
        local = [v - c - t for v, c, t in zip(p, self.centre, self.move)]
        return [(row[0] * local[0] + row[1] * local[1] + row[2] * local[2]) / s + c for row, s, c in zip(transpose(self.matrix), self.scale, self.centre)]


def unit_quaternion_matrix(q: Sequence[Column]) -> list[list[Column]]:
    """Matrix columns of unit quaternion columns."""
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def squared_distance(p: Sequence[Column], q: Sequence) -> Column:
    d = [a - b for a, b in zip(p, q)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def distance(p: Sequence[Column], q: Sequence) -> Column:
    return F.sqrt(squared_distance(p, q))


def scale_parts(bounds: Vector) -> tuple[float, tuple[float, ...]]:
    """A scale per axis as its geometric mean and what is left."""
    main = math.prod(bounds) ** (1 / 3)
    return main, tuple(b / main for b in bounds)
