"""Quality rules as weak supervision: rules vote or abstain, expectation
maximisation estimates how each votes on good and bad documents, and the
posterior probability of quality decides.

Everything on rows is SQL; the driver sees only the counts of vote patterns,
of which there are at most 2 to the number of rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_of, written

#: White space between words, and the symbols that count.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", "#*$%&|<>"

#: name, vote, when; a rule abstains otherwise. Each looks at one trait, so that silence says nothing of the others.
#: All are ratios, so that they hold for any length.
RULES = (
    ("symbols", -1, "10 * n_symbols > 2 * n_words"),
    ("repetition", -1, "100 * n_repeat_words > 35 * n_words"),
    ("lines", -1, "n_lines >= 3 and 100 * n_dup_lines > 40 * n_lines"),
    ("capitals", -1, "100 * n_capitals > 40 * word_chars"),
    ("word_length", -1, "10 * word_chars < 35 * n_words or 10 * word_chars > 75 * n_words"),
    ("variety", -1, "n_words >= 20 and n_distinct_words * n_distinct_words < 3 * n_words"),
    ("digits", -1, "100 * n_digits > 25 * word_chars"),
    ("prose", 1, "10 * word_chars between 40 * n_words and 68 * n_words and n_distinct_words * n_distinct_words >= 5 * n_words and 100 * n_symbols <= 2 * n_words"),
    ("calm", 1, "100 * n_capitals <= 8 * word_chars and 100 * n_repeat_words <= 12 * n_words and 100 * n_symbols <= 2 * n_words"),
)
RATES = tuple[float, list[float], list[float]]


def features(documents: DataFrame, carry: list[str]) -> DataFrame:
    """Counts of each whole text, with some columns of its row as `row`; a null text counts as one without words."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("text"), F.struct(*carry).alias("row"))
    d = d.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    grams = F.expr("transform(slice(words, 1, cast(greatest(n_words - 2, 0) as int)), (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2)))")
    d = d.withColumn("grams", grams)
    d = d.withColumn("placed", F.expr("case when size(array_distinct(grams)) < size(grams) then sort_array(transform(grams, (g, i) -> struct(g as g, i as i))) end"))
    twins = "flatten(filter(zip_with(placed, slice(placed, 2, size(placed)), (a, b) -> case when a.g = b.g then array(a.i, b.i) end), x -> x is not null))"
    d = d.withColumn("twice", F.expr(f"sort_array(array_distinct({twins}))"))
    covered = "aggregate(zip_with(twice, slice(twice, 2, size(twice)), (a, b) -> case when b is null then 3 else least(3, b - a) end), 0, (n, x) -> n + x)"

    def without(pattern: str) -> Column:
        return F.length("text") - F.length(F.regexp_replace("text", pattern, ""))

    return d.select(
        "row",
        "doc_id",
        "n_words",
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"cast(coalesce({covered}, 0) as long)").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        without(r"\p{Lu}+").cast("long").alias("n_capitals"),
        without("[0-9]+").cast("long").alias("n_digits"),
    )


def votes(counted: DataFrame) -> DataFrame:
    """vote_<rule>: 1 good, -1 bad, 0 abstains; texts without words get only abstentions."""
    return counted.withColumns({f"vote_{n}": F.expr(f"case when n_words > 0 and {when} then {vote} else 0 end") for n, vote, when in RULES})


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> RATES:
    """The share of good documents, and how often each rule speaks on good and on bad documents.

    It starts from unanimity: a pattern with a vote against it is mostly bad.
    A rule never counts for the opposite of its vote, and a silent one not at all."""
    if not patterns:
        patterns = [((0,) * len(RULES), 1)]
    good = [0.05 if -1 in p else 0.95 for p, _ in patterns]
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        share = min(0.99, max(0.01, sum(g * n for g, (_, n) in zip(good, patterns, strict=True)) / total))
        speaks: RATES = (share, [], [])
        for k in range(len(RULES)):
            for side, whole in ((1, share), (2, 1 - share)):
                heard = sum((g if side == 1 else 1 - g) * n for g, (p, n) in zip(good, patterns, strict=True) if p[k])
                speaks[side].append((heard / total + 1e-4) / (whole + 2e-4))
        new = [1 / (1 + math.exp(-max(-500.0, min(500.0, _odds(speaks, p))))) for p, _ in patterns]
        moved = max(abs(a - b) for a, b in zip(good, new, strict=True))
        good = new
        if moved < 1e-9:
            break
    return speaks


def weights(rates: RATES) -> list[float]:
    """What each rule's vote adds to the log odds of quality."""
    raw = [math.log(g / b) for g, b in zip(rates[1], rates[2], strict=True)]
    return [max(0.0, x) if vote > 0 else min(0.0, x) for x, (_, vote, _) in zip(raw, RULES, strict=True)]


def _odds(rates: RATES, pattern: tuple[int, ...]) -> float:
    return math.log(rates[0] / (1 - rates[0])) + sum(w for w, v in zip(weights(rates), pattern, strict=True) if v)


def judged(documents: DataFrame, least: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns to carry: all, if none are named), doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, p_good, kept of every row.

    Null and empty texts have no words and fail the base rule. Texts of any
    length are counted whole. A posterior of exactly `least` is kept. Repeated
    rows count as often as they occur; other columns are ignored; an empty
    table gives no rows."""
    voted = written(votes(features(documents, carry or documents.columns)))  # one pass over the texts serves the estimate and the verdicts
    names = [f"vote_{n}" for n, _, _ in RULES]
    rows = voted.groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most 2 to the number of rules
    rates = estimate(sorted((tuple(r[n] for n in names), r["n"]) for r in rows))
    odds = F.lit(math.log(rates[0] / (1 - rates[0])))
    for name, w in zip(names, weights(rates), strict=True):
        odds = odds + F.when(F.col(name) != 0, F.lit(w)).otherwise(F.lit(0.0))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    out = voted.withColumn("base_failed", failed).withColumn("p_good", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)))
    return out.select("row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_good", (~F.col("base_failed") & (F.col("p_good") >= least)).alias("kept"))


def quality_rules(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """The verdicts of judged() without the rows: the counts of the base rule, base_failed, p_good and kept."""
    return judged(documents_of(documents), least, ["doc_id"]).drop("row")
