"""Token-ranked text search over topics (id, title, description, headings, body)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import WaveError


def query_tokens(query: str) -> list[str]:
    """Distinct lower-case tokens in order; ASCII letters alone change case."""
    low = "".join(c.lower() if c.isascii() else c for c in query)
    return list(dict.fromkeys(low.split()))


def lowered(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def search(topics: DataFrame, query: str) -> DataFrame:
    """id, exact, matched, rank of topics that hold a token, best first by (exact id, tokens matched, best place, id).

    A token counts by its best place: start of the id, then title or
    description, then a heading, then the body."""
    tokens = query_tokens(query)
    if not tokens:
        raise WaveError("args", "a search needs a token")
    held = topics.select("id", lowered(F.col("id")).alias("i"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "description", "headings", "body")))

    def place(token: str) -> Column:
        literal = token.replace("\\E", "\\E\\\\E\\Q")
        at = lambda c: F.col(c).rlike(f"(?i)\\Q{literal}\\E")  # noqa: E731  # folds the case of ASCII letters alone
        return F.when(F.col("i").startswith(token), 0).when(at("title") | at("description"), 1).when(at("headings"), 2).when(at("body"), 3)

    scored = held.withColumns({f"p{k}": place(t) for k, t in enumerate(tokens)})
    places = [F.col(f"p{k}") for k in range(len(tokens))]
    matched = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in places), F.lit(0))
    best = F.array_min(F.array_compact(F.array(*places)))
    out = scored.select("id", (F.col("i") == " ".join(tokens)).alias("exact"), matched.cast("int").alias("matched"), best.cast("int").alias("rank"))
    return out.filter("matched > 0").orderBy(F.desc("exact"), F.desc("matched"), "rank", "id")


def suggestions(topics: DataFrame, wanted: str, most: int = 3) -> list[str]:
    """Ids close to one that was not found."""
    close = F.levenshtein(lowered(F.col("id")), F.lit(wanted.lower()))
    near = topics.select("id", close.alias("d")).filter((F.col("d") <= max(2, len(wanted) // 3)) | F.lower("id").contains(wanted.lower()))
    return [r["id"] for r in near.orderBy("d", "id").limit(most).collect()]
