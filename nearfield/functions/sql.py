"""The distances as SQL functions, so that plain SQL can use them. They are expressions that Catalyst inlines, not UDFs."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
_A, _B, _AB = _DOT.format(a="a", b="a"), _DOT.format(a="b", b="b"), _DOT.format(a="a", b="b")
FUNCTIONS = {
    "vec_dot": ("a array<double>, b array<double>", "double", _AB),
    "vec_l2": ("a array<double>, b array<double>", "double", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"),
    "vec_ip": ("a array<double>, b array<double>", "double", f"-{_AB}"),
    "vec_cosine": ("a array<double>, b array<double>", "double", f"CASE WHEN {_A} * {_B} = 0 THEN 1D ELSE 1 - {_AB} / sqrt({_A} * {_B}) END"),
    "vec_norm": ("a array<double>", "double", f"sqrt({_A})"),
    "vec_normalize": ("a array<double>", "array<double>", f"transform(a, x -> CASE WHEN {_A} > 0 THEN x / sqrt({_A}) ELSE x END)"),
    "vec_int8": ("a array<double>", "array<tinyint>", "transform(a, x -> CAST(greatest(least(round(x * 127), 127), -127) AS tinyint))"),
}


def register(spark: SparkSession) -> None:
    """Defines them as temporary functions of the session."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
