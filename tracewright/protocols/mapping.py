"""Standard signals to dump signals: explicit maps first, then candidates by the words of their names."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..dump import Dump
from ..errors import Diagnostic, WaveError
from ..operators.catalog import checked_pattern

#: Words that say nothing at the end of a name.
AFFIXES = frozenset("i o in out input output d q r reg".split())


def name_words(name: str) -> list[str]:
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", name.rpartition(".")[2])]


def _runs(words: list[str], end: int, standard: str, atomic: bool) -> list[int]:
    """Starts of runs of words up to `end` that spell the standard name."""
    first = max(0, end - 1) if atomic else 0
    return [k for k in range(first, end) if "".join(words[k:end]) == standard]


def meanings(name: str, standards: list[str], atomic: tuple[str, ...] = (), runs: bool = True) -> list[str]:
    """The standards a name could stand for: those it ends in; if that is one, also those it has right before that."""
    words = name_words(name)
    while words and words[-1] in AFFIXES:
        words.pop()
    ends = {s: found[0] for s in standards if (found := _runs(words, len(words), s, s in atomic))}
    if len(ends) != 1 or not runs:
        return list(ends)
    (only, start), = ends.items()
    return [s for s in standards if s == only or _runs(words, start, s, s in atomic)]


def decoy(name: str) -> bool:
    """Names of check bits and of ready outputs."""
    words = name_words(name)
    return "hreadyout" in "".join(words) or any(w.endswith(("chk", "check", "parity")) for w in words)


def candidates(dump: Dump, includes: list[str], scope: str | None) -> list[str]:
    """Names (under a scope, its own; else paths) of the signals that any pattern finds, in order."""
    if not includes:
        return []
    tests = [checked_pattern(p) for p in includes]
    any_of = lambda c: F.greatest(*(F.col(c).rlike(p) for p in tests), F.lit(False))
    if scope is not None:
        rows = dump.signals.filter((F.col("scope_path") == scope) & any_of("name")).select(F.col("name").alias("n"))
    else:
        rows = dump.signals.filter(any_of("path") | any_of("name")).select(F.col("path").alias("n"))
    return [r["n"] for r in rows.distinct().orderBy("n").collect()]


def mapped(dump: Dump, protocol: str, standards: list[str], maps: dict[str, str], includes: list[str], scope: str | None, atomic: tuple[str, ...] = (), runs: bool = True, no_decoys: bool = False) -> tuple[dict[str, str], list[Diagnostic]]:
    """standard -> signal name, and a warning for each candidate that matches nothing."""
    if scope is not None:
        dump.require_scope(scope)
    out: dict[str, str] = {}
    for standard, name in maps.items():
        if standard not in standards:
            raise WaveError("args", f"{protocol} profile has no signal '{standard}'")
        dump.signal(dump.scoped(name, scope))
        out[standard] = name
    found: dict[str, list[str]] = {}
    notes = []
    for name in candidates(dump, includes, scope):
        if no_decoys and decoy(name):
            continue
        means = meanings(name, standards, atomic, runs)
        if len(means) > 1:
            raise WaveError("args", f"{protocol} candidate '{name}' is ambiguous: {', '.join(means)}")
        if not means:
            if name not in out.values():
                notes.append(Diagnostic("W0004", f"include candidate '{name}' matches no {protocol} signal"))
        elif means[0] not in maps:
            found.setdefault(means[0], []).append(name)
    for standard in standards:
        names = found.get(standard, [])
        if len(names) > 1:
            raise WaveError("args", f"{protocol} signal '{standard}' has several candidates: {', '.join(names)}")
        if names:
            out[standard] = names[0]
    return {s: out[s] for s in standards if s in out}, notes


def pairs_of(maps: list[str]) -> dict[str, str]:
    """`standard=waveform` arguments."""
    out: dict[str, str] = {}
    for m in maps:
        standard, eq, name = m.partition("=")
        if not eq or not standard or not name:
            raise WaveError("args", f"invalid map '{m}', expected standard=waveform")
        if standard.lower() in out:
            raise WaveError("args", f"'{standard}' is mapped twice")
        out[standard.lower()] = name
    return out
