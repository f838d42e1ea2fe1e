"""Evaluating a value once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` as often as needed.

    Catalyst may inline a projected expression into a lambda, where it would be
    evaluated again for each element; a lambda variable is never inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def once(udf):
    """A Python function whose result is kept, not computed again for each use.

    Catalyst copies a deterministic expression into the filters it infers or pushes
    down, and would run the function twice per row.
    """
    return udf.asNondeterministic()
