"""Catalog queries: info, scope and signal listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dump import Dump
from ..errors import WaveError
from ..results import DEFAULT_MAX, Result, checked_limit


def checked_pattern(pattern: str) -> str:
    """A filter in the common subset of regex dialects: no look-around, no backreferences."""
    import re

    if re.search(r"\(\?[=!<]|\\[1-9]|\(\?P=", pattern):
        raise WaveError("args", "filters support neither look-around nor backreferences")
    try:
        re.compile(pattern)
    except re.error as e:
        raise WaveError("args", f"invalid regex '{pattern}': {e}") from e
    return pattern


def info(dump: Dump) -> Result:
    """Tick unit and time bounds; an empty time table counts as 0 to 0."""
    t = dump.time
    frame = dump.meta.agg(F.min("tick_value").alias("tick_value"), F.min("tick_unit").alias("unit"), F.coalesce(F.min("start_raw"), F.lit(0)).alias("start"), F.coalesce(F.max("end_raw"), F.lit(0)).alias("end"))
    return Result("info", frame, [], None, shape=lambda r: {"time_unit": f"{t.tick}{t.unit}", "time_start": t.text(r["start"]), "time_end": t.text(r["end"])}, limited=False)


def scope_rows(scopes: DataFrame, pattern: str = ".*", max_depth: int | None = 5) -> DataFrame:
    """path, parts, depth, kind in no order; orderBy(parts) is pre-order with children by name."""
    deep = scopes if max_depth is None else scopes.filter(F.col("depth") <= max_depth)
    return deep.filter(F.col("path").rlike(checked_pattern(pattern)))


def scope(dump: Dump, pattern: str = ".*", max_depth: int | None = 5, limit: int | str | None = DEFAULT_MAX) -> Result:
    """The hierarchy in pre-order; the filter is on full paths."""
    df = scope_rows(dump.scopes, pattern, max_depth)
    return Result("scope", df, ["parts", "path"], checked_limit(limit), empty="no scopes matched", shape=lambda r: {"path": r["path"], "depth": r["depth"], "kind": r["kind"]})


def signal_rows(signals: DataFrame, scope_path: str, pattern: str = ".*", max_depth: int | None = 0) -> DataFrame:
    """Signals of a scope and of scopes up to max_depth below it (None: any), filtered by their own names."""
    below = F.size(F.split(F.col("scope_path"), r"\.")) - F.lit(scope_path.count(".") + 1)
    inside = (F.col("scope_path") == scope_path) | F.col("scope_path").startswith(f"{scope_path}.")
    if max_depth is not None:
        inside = inside & (below <= max_depth)
    return signals.filter(inside & F.col("name").rlike(checked_pattern(pattern))).withColumn("scope_parts", F.split("scope_path", r"\."))


def signal(dump: Dump, scope_path: str, pattern: str = ".*", recursive: bool = False, max_depth: int | None = 5, absolute: bool = False, limit: int | str | None = DEFAULT_MAX) -> Result:
    """The signals of a scope by name; child scopes follow after a scope's own signals."""
    dump.require_scope(scope_path)
    df = signal_rows(dump.signals, scope_path, pattern, max_depth if recursive else 0)

    def shape(r) -> dict:
        return {"display": r["path"] if absolute else r["path"].removeprefix(f"{scope_path}."), "name": r["name"], "path": r["path"], "kind": r["kind"], "width": r["width"]}

    return Result("signal", df, ["scope_parts", "name", "path"], checked_limit(limit), empty="no signals matched", shape=shape)
