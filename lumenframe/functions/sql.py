"""Colour functions for SQL: temporary functions whose bodies are the engine's expressions, so Catalyst inlines them.

``<curve>_encode(v)`` and ``<curve>_decode(v)`` for every transfer curve, and operations on a
colour, ``<name>(r, g, b)``, that return a struct of r, g and b.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import color
from .expr import Op, ex
from .transfer import CURVES

RGB = ("r", "g", "b")
#: Operations by the names of their functions.
OPERATIONS = {
    "rgb_to_hsv": color.rgb_to_hsv, "hsv_to_rgb": color.hsv_to_rgb, "xyz_to_xyy": color.xyz_to_xyy, "xyy_to_xyz": color.xyy_to_xyz, "xyz_to_uvy": color.xyz_to_uvy,
    "uvy_to_xyz": color.uvy_to_xyz, "xyz_to_luv": color.xyz_to_luv, "luv_to_xyz": color.luv_to_xyz, "tone_mapped": color.tone_mapped, "gamut_compressed": color.gamut_compressed,
}


def _struct_of(op: Op) -> str:
    """An operation's steps as nested queries over its arguments."""
    source = "SELECT r, g, b, CAST(1 AS DOUBLE) AS a"
    for step in op.steps:
        kept = ", ".join(f"{v.spark} AS {k}" for k, v in step.items())
        source = f"SELECT * EXCEPT ({', '.join(k for k in step if k in RGB)}), {kept} FROM ({source})" if set(step) & set(RGB) else f"SELECT *, {kept} FROM ({source})"
    return f"(SELECT struct({', '.join(f'{op.out[c].spark} AS {c}' for c in RGB)}) FROM ({source}))"


def register(spark: SparkSession, only: tuple[str, ...] = (), prefix: str = "") -> list[str]:
    """Create the functions in a session, all or those named; their names."""
    found = {f"{curve}_{name}": ("v DOUBLE", "DOUBLE", f(ex("v")).spark) for curve, pair in CURVES.items() for name, f in zip(("encode", "decode"), pair, strict=True)}
    found |= {name: ("r DOUBLE, g DOUBLE, b DOUBLE", "STRUCT<r: DOUBLE, g: DOUBLE, b: DOUBLE>", _struct_of(make())) for name, make in OPERATIONS.items()}
    chosen = [n for n in found if not only or n in only]
    for name in chosen:
        arguments, kind, body = found[name]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {kind} RETURN {body}")
    return [prefix + n for n in chosen]
