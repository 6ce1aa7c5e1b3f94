"""Geometry as lists of (name, expression), each of which may use the names before it.

The expressions keep to the arithmetic that Spark SQL and other SQL engines
share, so a plan can run them as columns inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import EPS, GOLDEN_ANGLE, SQRT_EPS

Steps = list[tuple[str, str]]


def with_steps(df: DataFrame, steps: Steps) -> DataFrame:
    """Add the steps' columns; later steps see earlier ones."""
    return df.selectExpr("*", *[f"{e} AS {n}" for n, e in steps])


def q6(e: str) -> str:
    """Rounded to six decimals, without minus zero."""
    return f"floor(({e}) * 1e6 + 0.5e0) / 1e6 + 0e0"


def fibonacci(k: str, n: str) -> Steps:
    """Direction k of n on the unit sphere: dx, dy, dz."""
    return [
        ("dz", f"1e0 - 2e0 * ({k} + 0.5e0) / {n}"),
        ("rho", "sqrt(greatest(1e0 - dz * dz, 0e0))"),
        ("phi", f"{k} * {GOLDEN_ANGLE}e0"),
        ("dx", "rho * cos(phi)"),
        ("dy", "rho * sin(phi)"),
    ]


def pair_circle() -> Steps:
    """The probe centres' circle of two expanded spheres (x1, y1, z1, r1), (x2, y2, z2, r2): centre c, radius rad, axis a, basis u, v."""
    return [
        ("d2", "(x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + (z2 - z1) * (z2 - z1)"),
        ("d", "sqrt(d2)"),
        ("ax", "(x2 - x1) / d"),
        ("ay", "(y2 - y1) / d"),
        ("az", "(z2 - z1) / d"),
        ("t", "(r1 * r1 - r2 * r2 + d2) / (2e0 * d)"),
        ("cx", "x1 + t * ax"),
        ("cy", "y1 + t * ay"),
        ("cz", "z1 + t * az"),
        ("rad", "sqrt(greatest(r1 * r1 - t * t, 0e0))"),
        # the axis crossed with y where it is close to z, else with z
        ("wx", "CASE WHEN abs(az) > 0.9e0 THEN -az ELSE ay END"),
        ("wy", "CASE WHEN abs(az) > 0.9e0 THEN 0e0 ELSE -ax END"),
        ("wz", "CASE WHEN abs(az) > 0.9e0 THEN ax ELSE 0e0 END"),
        ("wn", "sqrt(wx * wx + wy * wy + wz * wz)"),
        ("ux", "wx / wn"),
        ("uy", "wy / wn"),
        ("uz", "wz / wn"),
        ("vx", "ay * uz - az * uy"),
        ("vy", "az * ux - ax * uz"),
        ("vz", "ax * uy - ay * ux"),
    ]


def circle_point(angle: str) -> Steps:
    return [(f"p{c}", f"c{c} + rad * (cos({angle}) * u{c} + sin({angle}) * v{c})") for c in "xyz"]


def arc(f: str, probe: float) -> Steps:
    """At fraction f of the arc between the two contact normals seen from the probe at angle 0: alpha, and its distance rho from the axis."""
    return [
        ("n1x", "(x1 - cx - rad * ux) / r1"),
        ("n1y", "(y1 - cy - rad * uy) / r1"),
        ("n1z", "(z1 - cz - rad * uz) / r1"),
        ("n2x", "(x2 - cx - rad * ux) / r2"),
        ("n2y", "(y2 - cy - rad * uy) / r2"),
        ("n2z", "(z2 - cz - rad * uz) / r2"),
        ("alpha", "acos(greatest(-1e0, least(1e0, n1x * n2x + n1y * n2y + n1z * n2z)))"),
        ("s", "sin(alpha)"),
        ("f1", f"CASE WHEN abs(s) <= {SQRT_EPS} THEN 1e0 - {f} ELSE sin((1e0 - {f}) * alpha) / s END"),
        ("f2", f"CASE WHEN abs(s) <= {SQRT_EPS} THEN {f} ELSE sin({f} * alpha) / s END"),
        ("gx", "f1 * n1x + f2 * n2x"),
        ("gy", "f1 * n1y + f2 * n2y"),
        ("gz", "f1 * n1z + f2 * n2z"),
        ("gn", "sqrt(gx * gx + gy * gy + gz * gz)"),
        # the arc's points are seen from the probe, so they lean back towards the axis
        ("axial", f"greatest(rad + {probe}e0 * (gx * ux + gy * uy + gz * uz) / gn, 0e0)"),
    ]


def triple_centers() -> Steps:
    """The two probe centres that touch expanded spheres 1, 2 and 3: base m, height h, normal h*; ok where they exist."""
    return [
        ("d", "sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + (z2 - z1) * (z2 - z1))"),
        ("ex", "(x2 - x1) / d"),
        ("ey", "(y2 - y1) / d"),
        ("ez", "(z2 - z1) / d"),
        ("i", "ex * (x3 - x1) + ey * (y3 - y1) + ez * (z3 - z1)"),
        ("gx", "x3 - x1 - i * ex"),
        ("gy", "y3 - y1 - i * ey"),
        ("gz", "z3 - z1 - i * ez"),
        ("j", "sqrt(gx * gx + gy * gy + gz * gz)"),
        ("fx", f"gx / greatest(j, {EPS})"),
        ("fy", f"gy / greatest(j, {EPS})"),
        ("fz", f"gz / greatest(j, {EPS})"),
        ("hx", "ey * fz - ez * fy"),
        ("hy", "ez * fx - ex * fz"),
        ("hz", "ex * fy - ey * fx"),
        ("p", "(r1 * r1 - r2 * r2 + d * d) / (2e0 * d)"),
        ("q", f"(r1 * r1 - r3 * r3 + i * i + j * j - 2e0 * i * p) / (2e0 * greatest(j, {EPS}))"),
        ("h2", "r1 * r1 - p * p - q * q"),
        ("top", "greatest(r1, r2, r3, 1e0)"),
        ("ok", f"d > {EPS} AND j > {EPS} AND h2 >= -{1000 * EPS} * top * top"),
        ("h", "sqrt(greatest(h2, 0e0))"),
        ("mx", "x1 + p * ex + q * fx"),
        ("my", "y1 + p * ey + q * fy"),
        ("mz", "z1 + p * ez + q * fz"),
    ]


def inside(d2: str, r: str, scale: int = 256) -> str:
    """Strictly inside a sphere, beyond the relative tolerance."""
    return f"{d2} < {r} * {r} - {scale * EPS} * greatest({d2}, {r} * {r}, 1e0)"


def dist2(a: str, b: str) -> str:
    """Squared distance of the points whose columns end in a and in b."""
    return " + ".join(f"({c}{a} - {c}{b}) * ({c}{a} - {c}{b})" for c in "xyz")


def segment_distance2() -> Steps:
    """From the sphere's centre (x2, y2, z2) to the segment from p to e: dd."""
    return [
        ("len2", "(ex - px) * (ex - px) + (ey - py) * (ey - py) + (ez - pz) * (ez - pz)"),
        ("along", f"greatest(0e0, least(1e0, ((x2 - px) * (ex - px) + (y2 - py) * (ey - py) + (z2 - pz) * (ez - pz)) / greatest(len2, {EPS})))"),
        ("ox", "px + along * (ex - px) - x2"),
        ("oy", "py + along * (ey - py) - y2"),
        ("oz", "pz + along * (ez - pz) - z2"),
        ("dd", "ox * ox + oy * oy + oz * oz"),
    ]
