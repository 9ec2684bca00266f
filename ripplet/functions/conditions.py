"""Three-valued conditions: TRUE, FALSE or UNRESOLVED, which is never taken for FALSE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

T, N, U = "TRUE", "FALSE", "UNRESOLVED"


def compare(left: Column, op: str, right: Column) -> Column:
    """`==` or `!=` of two known values, without regard to case; UNRESOLVED where either is null."""
    same = F.lower(left) == F.lower(right)
    return F.when(left.isNull() | right.isNull(), U).when(same if op == "==" else ~same, T).otherwise(N)


def both(*xs: Column) -> Column:
    """FALSE if any is, TRUE if all are, else UNRESOLVED."""
    a = F.array(*xs)
    return F.when(F.array_contains(a, N), N).when(F.forall(a, lambda x: x == T), T).otherwise(U)


def either(*xs: Column) -> Column:
    a = F.array(*xs)
    return F.when(F.array_contains(a, T), T).when(F.forall(a, lambda x: x == N), N).otherwise(U)


def negate(x: Column) -> Column:
    return F.when(x == T, N).when(x == N, T).otherwise(U)


_OPERAND = r"'([^']*)'|([A-Za-z_][\w.\-]*)"


def evaluate(expression: str | Column, context: str | Column) -> Column:
    """A condition `[${{] a (==|!=) b [}}]`, `always()`, `true` or `false` over a map of known names.

    Anything else, unknown names and texts of more than 1000 characters are UNRESOLVED; an absent condition is TRUE.
    """
    e = F.col(expression) if isinstance(expression, str) else expression
    ctx = F.col(context) if isinstance(context, str) else context
    body = F.trim(F.regexp_replace(e, r"^\s*\$\{\{(.*)\}\}\s*$", "$1"))
    form = rf"^(?:{_OPERAND})\s*(==|!=)\s*(?:{_OPERAND})$"
    get = lambda k: F.regexp_extract(body, form, k)
    name = lambda k: F.try_element_at(ctx, get(k))
    left = F.when(get(2) != "", name(2)).otherwise(get(1))
    right = F.when(get(5) != "", name(5)).otherwise(get(4))
    same = F.lower(left) == F.lower(right)
    return (
        F.when(e.isNull() | (F.trim(e) == ""), T)
        .when(F.length(e) > 1000, U)
        .when(F.lower(body).isin("true", "always()", "success()"), T)
        .when(F.lower(body) == "false", N)
        .when(~body.rlike(form) | left.isNull() | right.isNull(), U)
        .when(F.when(get(3) == "==", same).otherwise(~same), T)
        .otherwise(N)
    )
