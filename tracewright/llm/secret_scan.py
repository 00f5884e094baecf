"""Secret scans in SQL: fixed patterns, and sliding windows of Shannon entropy
over candidate strings.

A window moves by one character: the count of the one that enters goes up, of
the one that leaves down, and the sum of c * log2(c) changes by those two
terms alone. Candidates are suppressed by an allow-list of harmless shapes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of

#: The base patterns (those that need a length hold it here, where that finds the same spans).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates, their alphabet and the window.
CANDIDATE, ALPHABET, WINDOW = r"[A-Za-z0-9+/_=-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20
#: The least bits a character by character class: what 98 of 100 random windows of the class reach (of 16, 32, 36 and 62
#: characters); more for one case joined by signs, which words are as well.
BITS = {"hex": 2.94, "base32": 3.38, "lower": 3.44, "mixed": 3.68, "joined": 3.85}
#: Whole runs of one case within a candidate, which have the threshold of their own class.
RUN = r"(?<![A-Za-z0-9])(?:[a-z0-9]{20,}|[A-Z0-9]{20,})(?![A-Za-z0-9])"
CLASSES = {"hex": r"^([0-9a-f]+|[0-9A-F]+)$", "base32": r"^([a-z2-7]+|[A-Z2-7]+)$", "lower": "."}
#: Harmless shapes: identifiers of fixed form, integrity values, runs of an alphabet, paths of words, placeholders.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(sha1|sha256|sha384|sha512|md5)-",
    r"(?i)abcdefgh|12345678|qwertyui",
    r"^/?([A-Za-z_-]+[0-9]{0,4}/)+[A-Za-z_-]*[0-9]{0,4}$",
    r"(?i)example|placeholder|changeme|xxxx",
    r"^[A-Za-z]+([-_=/][A-Za-z]+)*[-_=/]?[0-9]{1,4}$",
)
KINDS = ("assign", "access", "hex", "entropy")
#: Matches of a text that are placed together.
BLOCK = 64
SPAN = "struct<start:int,kind:int,end:int,hit:string>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'" if "'" not in pattern else 'r"' + pattern.replace('"', r"\x22") + '"'


def _spans(pattern: str, kind: int) -> str:
    """SQL for the spans of a pattern: the pieces between matches give the places. Matches go in blocks, so that no long array grows one by one."""
    p = _quoted(pattern)
    pieces = f"zip_with(regexp_extract_all(text, {p}, 0), split(text, {p}, -1), (h, g) -> struct(h, length(g) as g))"
    blocks = f"transform(array({pieces}), p -> transform(sequence(0, (size(p) - 1) div {BLOCK}), b -> slice(p, b * {BLOCK} + 1, {BLOCK})))[0]"
    starts = "aggregate(blocks, array(0), (s, b) -> array_append(s, element_at(s, -1) + aggregate(b, 0, (n, x) -> n + x.g + coalesce(length(x.h), 0))))"
    each = f"""aggregate(b, struct(start as at, cast(array() as array<{SPAN}>) as found),
        (s, x) -> if(x.h is null, s, struct(s.at + x.g + length(x.h) as at,
            array_append(s.found, struct(s.at + x.g as start, {kind} as kind, s.at + x.g + length(x.h) as end, x.h as hit)) as found)),
        s -> s.found)"""
    return f"""case when text rlike {p} then flatten(transform(array({blocks}), blocks -> flatten(zip_with(blocks, slice({starts}, 1, size(blocks)), (b, start) -> {each}))))
        else cast(array() as array<{SPAN}>) end"""


def _entropy(hit: str) -> str:
    """SQL for the most bits a character in any window of a string."""
    f = "array(" + ",".join(f"{c * math.log2(c) if c else 0.0:.12f}D" for c in range(WINDOW + 1)) + ")"
    start = f"struct(array_repeat(0, {len(ALPHABET)}) as n, cast(0 as double) as s, cast(0 as double) as best)"
    gone = "w.n[greatest(x.leave, 0)]"
    s = f"(w.s + {f}[w.n[x.enter] + 1] - {f}[w.n[x.enter]] + if(x.leave < 0, 0D, {f}[greatest({gone} - 1, 0)] - {f}[{gone}]))"
    return f"""aggregate(
        transform(sequence(1, length({hit})), i -> struct(
            instr('{ALPHABET}', substr({hit}, i, 1)) - 1 as enter,
            if(i > {WINDOW}, instr('{ALPHABET}', substr({hit}, i - {WINDOW}, 1)) - 1, -1) as leave, i as i)),
        {start},
        (w, x) -> if(x.enter = x.leave, w, struct(
            transform(w.n, (c, k) -> c + if(k = x.enter, 1, 0) - if(k = x.leave, 1, 0)) as n,
            {s} as s,
            if(x.i < {WINDOW}, w.best, greatest(w.best, {math.log2(WINDOW):.12f}D - {s} / {WINDOW}D)) as best)),
        w -> w.best)"""


def secret_spans(documents: DataFrame) -> DataFrame:
    """doc_id, text, base and added: arrays of spans (start, kind as the place in KINDS, end, hit) in code points."""
    d = documents_of(documents).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "text", F.expr(_spans(ASSIGN, 0)).alias("assign"), F.expr(_spans(ACCESS, 1)).alias("access"), F.expr(_spans(HEX, 2)).alias("hex"), F.expr(_spans(CANDIDATE, 3)).alias("candidates"))
    long_enough = F.expr(f"filter(assign, x -> length(regexp_extract(x.hit, {_quoted(ASSIGN)}, 1)) >= 6)")
    d = d.withColumn("assign", long_enough).withColumn("base", F.sort_array(F.concat("assign", "access", "hex")))

    def odd(hit: str) -> str:
        return f"{hit} rlike '[0-9]' and {hit} rlike '[A-Za-z]' and not (" + " or ".join(f"{hit} rlike {_quoted(p)}" for p in ALLOWED) + ")"

    d = d.withColumn("candidates", F.expr(f"filter(candidates, x -> {odd('x.hit')} and not exists(base, b -> b.start < x.end and x.start < b.end))"))
    least = "case " + " ".join(f"when r rlike {_quoted(p)} then {BITS[k]}D" for k, p in CLASSES.items()) + " end"
    runs = f"filter(regexp_extract_all(x.hit, {_quoted(RUN)}, 0), r -> {odd('r')})"
    whole = f"if(x.hit rlike '[a-z]' and x.hit rlike '[A-Z]', {BITS['mixed']}D, {BITS['joined']}D)"
    high = f"{_entropy('x.hit')} >= {whole} or exists({runs}, r -> {_entropy('r')} >= {least})"
    return d.select("doc_id", "text", "base", F.expr(f"filter(candidates, x -> {high})").alias("added"))


def secret_scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row.

    Null and empty texts have no spans (the digest is that of the empty
    string). Texts of any length are read whole; candidates are held against
    each base span of their text. Spans that start together go by kind, then
    end. Repeated rows give repeated results; other columns are ignored; an
    empty table gives no rows."""
    kinds = "array('" + "','".join(KINDS) + "')"

    def joined(spans: str) -> str:
        return f"array_join(transform(sort_array({spans}), x -> concat(element_at({kinds}, x.kind + 1), ':', x.start, ':', x.end)), ',')"

    return secret_spans(documents).select(
        "doc_id",
        *(F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as long)").alias(f"n_{KINDS[k]}") for k in range(3)),
        F.expr(f"sha2({joined('base')}, 256)").alias("base_sha256"),
        F.expr(joined("concat(base, added)")).alias("spans"),
    )
