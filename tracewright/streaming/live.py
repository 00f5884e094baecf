"""Streams of changes: trigger matches as they arrive, with state kept for each dump.

Dumps are ordered by time, so a micro-batch only needs the last values that
earlier ones left; those are the state, keyed by dump."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans import scalar
from ..plans.binding import Bound
from ..plans.events import Term

OUT = "dump_id long, t long, sample_t long"
STATE = "names array<string>, bits array<string>, t long"


def _edge(kind: str, before: str | None, now: str | None) -> bool:
    if not before or not now:
        return False
    p, c = before[-1], now[-1]
    up = p == "0" and c != "0" or p in "xz" and c == "1"
    down = p == "1" and c != "1" or p in "xz" and c == "0"
    return up and kind != "negedge" or down and kind != "posedge"


def live_matches(changes: DataFrame, paths: dict[int, str], terms: list[Term], test: Bound) -> DataFrame:
    """Rows where an edge event finds a condition true in the state just before it.

    changes is a stream (dump_id, sig_id, t, seq, bits); paths names its
    signals. A row for a time comes out when the batch that holds it does."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, bits, last = state.get if state.exists else ([], [], -1)
        now: dict[str, str] = dict(zip(names, bits, strict=True))
        rows = sorted((int(r.t), int(r.seq), paths.get(int(r.sig_id)), r.bits) for f in frames for r in f.itertuples())
        out, k = [], 0
        while k < len(rows):
            t, before = rows[k][0], dict(now)
            while k < len(rows) and rows[k][0] == t:
                if rows[k][2] is not None:
                    now[rows[k][2]] = rows[k][3]
                k += 1
            fired = last >= 0 and any(
                _edge(term.kind, before.get(str(term.name)), now.get(str(term.name)))
                and (term.condition is None or scalar.truth(scalar.evaluate(term.condition, now), term.condition.type) == "1")
                for term in terms
            )
            if fired and scalar.truth(scalar.evaluate(test, before), test.type) == "1":
                out.append((key[0], t, t - 1))
            last = t
        state.update((list(now), list(now.values()), last))
        yield pd.DataFrame(out, columns=["dump_id", "t", "sample_t"])

    return changes.groupBy("dump_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
