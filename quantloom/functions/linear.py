"""Small linear systems as column expressions: one system per row, solved JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quantloom.functions.scalar import div


def solve_symmetric(let, a: list[list[Column]], b: list[Column]) -> list[Column]:
    """Solve A x = b for a symmetric positive definite A of fixed small size.

    `let` names intermediate columns (see `Layers`).  Elimination needs no pivoting for such matrices; a singular
    one gives nulls.
    """
    n = len(b)
    a, b = [list(r) for r in a], list(b)
    for k in range(n):
        for i in range(k + 1, n):
            m = let(div(a[i][k], a[k][k]))
            for j in range(k + 1, n):
                a[i][j] = let(a[i][j] - m * a[k][j])
            b[i] = let(b[i] - m * b[k])
    x: list[Column] = [None] * n
    for i in reversed(range(n)):
        rest = b[i]
        for j in range(i + 1, n):
            rest = rest - a[i][j] * x[j]
        x[i] = let(div(rest, a[i][i]))
    return x


def dot(xs, ys) -> Column:
    total = F.lit(0.0)
    for x, y in zip(xs, ys):
        total = total + x * y
    return total
