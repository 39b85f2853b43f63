"""Helpers for long column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``, also within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def span(start: Column, stop: Column) -> Column:
    """``start, start + 1, ..., stop``; empty when stop < start (``sequence`` would count down)."""
    return F.when(stop >= start, F.sequence(start, stop)).otherwise(F.array().cast("array<int>"))


def bind(value: str, name: str, body: str) -> str:
    """SQL text of ``let``: ``body`` may use ``name`` for ``value``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def sql_function(body: str, **args: Column) -> Column:
    """SQL text over named columns, each evaluated once; ``in.<name>`` stands for an argument.

    A long expression costs one parse instead of a driver round trip per operator, and the result
    is an ordinary column expression that also works inside lambdas.
    """
    packed = F.array(F.struct(*[c.alias(n) for n, c in args.items()]))
    return F.get(F.call_function("transform", packed, F.expr(f"arg -> {body.replace('in.', 'arg.')}")), F.lit(0))
