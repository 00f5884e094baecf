"""Trace of a command on stderr, as JSON lines, where DEBUG=1 asks for it."""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable


class Trace:
    """Events of one command with the time since its start; details are only made when they are shown."""

    def __init__(self, command: str) -> None:
        self.command, self.enabled, self._began = command, os.environ.get("DEBUG") == "1", time.monotonic_ns()

    def event(self, message: str, details: Callable[[], dict] = dict) -> None:
        if self.enabled:
            shown = {"kind": "debug", "message": message, "timestamp_ns": time.monotonic_ns() - self._began, "details": {"command": self.command, **details()}}
            print(json.dumps(shown, ensure_ascii=False), file=sys.stderr, flush=True)
