"""Source documents: JSON descriptions of extractions."""

from __future__ import annotations

import json

from ..errors import WaveError
from ..operators.waves import Source

KINDS = ("ahb", "apb", "atb", "axi", "axistream")
#: Fields of each kind of document beside the common ones.
EXTRA = {"ahb": ("include_stall", "include_idle", "include_busy"), "apb": ("pready_mode", "include_wait"), "axistream": ("tready_mode",)}


def load(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except OSError as e:
        raise WaveError("file", f"cannot read source '{path}': {e.strerror}") from e
    except ValueError as e:
        raise WaveError("args", f"source '{path}' is not JSON: {e}") from e
    if not isinstance(found, dict):
        raise WaveError("args", "a source document must be an object")
    return found


def generic_sources(doc: dict) -> list[Source]:
    """The sources of an `extract.generic.sources` document."""
    if doc.get("kind") != "extract.generic.sources":
        raise WaveError("args", f"unexpected source kind {doc.get('kind')!r}")
    unknown = set(doc) - {"$schema", "kind", "sources"}
    if unknown or not isinstance(doc.get("sources"), list) or not doc["sources"]:
        raise WaveError("args", f"invalid source document: {', '.join(sorted(unknown)) or 'sources must be a non-empty list'}")
    out = []
    for s in doc["sources"]:
        if not isinstance(s, dict) or set(s) - {"name", "on", "when", "payload"} or not all(isinstance(s.get(k), str) for k in ("name", "on", "when")):
            raise WaveError("args", "each source needs name, on and when, and may have a payload")
        out.append(Source(s["name"], s["on"], s["when"], list(s.get("payload", []))))
    if len({s.name for s in out}) != len(out):
        raise WaveError("args", "source names must differ")
    return out


def protocol_arguments(doc: dict, protocol: str) -> dict:
    """Keyword arguments of an extractor from an `extract.<protocol>.source` document."""
    if doc.get("kind") != f"extract.{protocol}.source":
        raise WaveError("args", f"unexpected source kind {doc.get('kind')!r}")
    known = {"$schema", "kind", "profile", "name", "includes", "maps", *EXTRA.get(protocol, ())}
    if set(doc) - known:
        raise WaveError("args", f"unknown fields: {', '.join(sorted(set(doc) - known))}")
    out = {k: doc[k] for k in ("profile", *EXTRA.get(protocol, ())) if k in doc}
    maps = doc.get("maps", {})
    out["maps"] = {k.lower(): v for k, v in maps.items()} if isinstance(maps, dict) else {}
    out["includes"] = list(doc.get("includes", []))
    return out
