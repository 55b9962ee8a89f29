"""Small dense linear algebra over array columns (a matrix is an array of
rows), for a system of equations in each row of a table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLES, ROWS = "array<double>", "array<array<double>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _count(n: Column, start: int = 0) -> Column:
    """start, ..., n - 1 (nothing if there is none)."""
    return F.when(n > start, F.sequence(F.lit(start), n - 1)).otherwise(F.array().cast("array<int>"))


def gram(x: Column, y: Column) -> tuple[Column, Column]:
    """X'X as an array of rows and X'y, from an array of design rows."""
    width = F.size(F.get(x, 0))

    def zero_row(_: Column) -> Column:
        return F.array_repeat(F.lit(0.0), width)

    xx = F.aggregate(x, F.transform(_count(width), zero_row),
                     lambda s, r: F.zip_with(s, r, lambda row, a: F.zip_with(row, r, lambda v, b: v + a * b)))
    xy = F.aggregate(F.arrays_zip(x.alias("x"), y.alias("y")), zero_row(width),
                     lambda s, r: F.zip_with(s, r["x"], lambda v, a: v + a * r["y"]))
    return xx, xy


def add_diagonal(a: Column, d: Column) -> Column:
    """A matrix with the array ``d`` added to its diagonal."""
    return let(d, lambda d: F.transform(a, lambda row, i: F.transform(
        row, lambda v, j: F.when(i == j, v + F.get(d, i)).otherwise(v))))


def cholesky(a: Column) -> Column:
    """The lower factor of a symmetric positive definite matrix; row i has
    i + 1 numbers."""
    def row(lower: Column, i: Column) -> Column:
        def entry(r: Column, j: Column) -> Column:
            above = F.get(lower, j)
            return F.concat(r, F.array(F.when(
                j < i, (F.get(F.get(a, i), j) - dot(r, F.slice(above, F.lit(1), j))) / F.get(above, j))
                .otherwise(F.sqrt(F.get(F.get(a, i), i) - dot(r, r)))))
        return F.aggregate(F.sequence(F.lit(0), i), F.array().cast(DOUBLES), entry)
    return F.aggregate(_count(F.size(a)), F.array().cast(ROWS), lambda lower, i: F.concat(lower, F.array(row(lower, i))))


def solve(lower: Column, b: Column) -> Column:
    """x with L L' x = b, by forward and backward substitution."""
    n = F.size(b)

    def forward(z: Column, i: Column) -> Column:
        own = F.get(lower, i)
        return F.concat(z, F.array((F.get(b, i) - dot(z, F.slice(own, F.lit(1), i))) / F.get(own, i)))

    def backward(z: Column):
        def step(x: Column, back: Column) -> Column:
            i = n - 1 - back
            column = F.transform(F.slice(lower, i + 2, back), lambda r: F.get(r, i))
            return F.concat(F.array((F.get(z, i) - dot(column, x)) / F.get(F.get(lower, i), i)), x)
        return F.aggregate(_count(n), F.array().cast(DOUBLES), step)

    return let(F.aggregate(_count(n), F.array().cast(DOUBLES), forward), backward)
