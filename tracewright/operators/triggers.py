"""Event terms as columns over sampled state."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.columns import holds
from ..plans.events import Term
from .sampling import States


def changed(states: States, path: str) -> Column:
    """The value differs from the one before, or is the first; events: an occurrence."""
    if path in states.events:
        return states.now(path)
    now, before = states.now(path), states.before(path)
    return now.isNotNull() & ~now.eqNullSafe(before) & (F.col("t") > F.col("start_raw"))


def edge(kind: str, before: Column, now: Column) -> Column:
    """posedge, negedge or either, on the least significant bit."""
    p, c = F.right(before, F.lit(1)), F.right(now, F.lit(1))
    if kind == "edge":
        return edge("posedge", before, now) | edge("negedge", before, now)
    low, high = ("0", "1") if kind == "posedge" else ("1", "0")
    return ((p == low) & (c != low)) | (p.isin("x", "z") & (c == high))


def matched(terms: list[Term], states: States, tracked: list[str]) -> Column:
    """Whether any term fires at t; iff conditions see the state at t, x and null count as no."""
    out = []
    for term in terms:
        if term.kind == "any":
            fired = reduce(or_, (changed(states, p) for p in tracked)) if tracked else F.lit(False)
        elif term.kind == "named":
            fired = changed(states, str(term.name))
        else:
            fired = edge(term.kind, states.before(str(term.name)), states.now(str(term.name))) & (F.col("t") > F.col("start_raw"))
        if term.condition is not None:
            fired = F.when(fired, holds(term.condition, states.now)).otherwise(False)
        out.append(F.coalesce(fired, F.lit(False)))
    return reduce(or_, out)
