"""The packaged manual: topics with front matter, searched, shown and exported."""

from __future__ import annotations

import json
import re
from importlib import resources
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import WaveError
from .search import search, suggestions

TOPICS = "id string, title string, description string, headings string, body string"
MANIFEST = "manifest.json"


def parse_topic(name: str, text: str) -> tuple[str, str, str, str, str]:
    """(id, title, description, headings, body) of a Markdown file with front matter."""
    m = re.match(r"---\n(.*?)\n---\n(.*)", text, re.S)
    head = dict(re.findall(r"^(\w+):\s*(.*)$", m[1] if m else "", re.M))
    body = m[2] if m else text
    return head.get("id", name), head.get("title", name), head.get("description", ""), "\n".join(re.findall(r"^#+\s+(.*)$", body, re.M)), body


def packaged() -> list[tuple[str, str, str, str, str]]:
    folder = resources.files("tracewright") / "topics"
    return sorted(parse_topic(f.name.removesuffix(".md"), f.read_text("utf-8")) for f in folder.iterdir() if f.name.endswith(".md"))


def topics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(packaged(), TOPICS)


def show(spark: SparkSession, topic: str) -> str:
    for row in packaged():
        if row[0] == topic:
            return row[4]
    near = suggestions(topics(spark), topic)
    raise WaveError("args", f"unknown topic '{topic}'" + (f"; did you mean: {', '.join(near)}" if near else ""))


def find(spark: SparkSession, query: str) -> list[dict]:
    return [r.asDict() for r in search(topics(spark), query).collect()]


def export(folder: str, force: bool = False) -> list[str]:
    """Writes all topics and a manifest; a folder that holds other files is only used with force, and only ours are replaced."""
    out = Path(folder)
    marker = out / MANIFEST
    if out.exists() and any(out.iterdir()) and not marker.exists():
        raise WaveError("file", f"'{folder}' is not empty and not a managed export")
    if marker.exists() and not force:
        raise WaveError("file", f"'{folder}' holds an export already; use --force to replace it")
    if marker.exists():
        for name in json.loads(marker.read_text())["files"]:
            (out / name).unlink(missing_ok=True)
    out.mkdir(parents=True, exist_ok=True)
    files = []
    for topic, _, _, _, body in packaged():
        name = f"{topic.replace('/', '-')}.md"
        (out / name).write_text(body, encoding="utf-8")
        files.append(name)
    marker.write_text(json.dumps({"kind": "manual", "files": files}, indent=1))
    return files
