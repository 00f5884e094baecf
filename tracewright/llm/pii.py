"""Personal data: high-recall generators propose overlapping spans, boosted
trees weigh them by format and context, and calibrated thresholds select.

The spans of the four fixed kinds (email, ip, card, phone) are always found;
the trees decide on the looser kinds that surround them. They are trained on
examples made here from a fixed seed."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import by_batch, documents_of

BASE = ("email", "ip", "card", "phone")
LOOSE = ("email_spelled", "phone_local", "ssn", "iban", "card_like")
KINDS = BASE + LOOSE
Span = tuple[int, int, int]  # start, place in KINDS, end

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
GENERATORS = {
    "email_spelled": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[{]at[)\]}] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[{]dot[)\]}]|\.) ?[A-Za-z0-9-]{1,63}){1,4}|[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63} dot [A-Za-z]{2,10}", re.I),
    "phone_local": re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3} ?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])0[0-9]{2,4}[ /-][0-9]{5,8}(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card_like": re.compile(r"(?<![0-9])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{2,7}(?![0-9])"),
}
#: Words of context, by what they speak for.
CONTEXT = {
    "phone": ("phone", "call", "tel", "fax", "mobile", "cell", "ring"),
    "mail": ("mail", "contact", "write", "reach", "send"),
    "identity": ("ssn", "social", "security", "insurance"),
    "bank": ("iban", "account", "bank", "transfer", "card", "visa", "credit"),
    "other": ("version", "isbn", "page", "section", "order", "invoice", "part", "serial", "figure", "table", "rfc", "build"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _mod97(text: str) -> bool:
    moved = text[4:] + text[:4]
    return bool(re.fullmatch("[0-9A-Z]+", moved)) and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping spans of the fixed kinds, each in time linear in the text."""
    out: list[Span] = []
    if "@" in text:
        last = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                last = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def proposals(text: str) -> list[Span]:
    """Spans of the loose kinds; they may overlap each other and the fixed ones."""
    digits, out = bool(_DIGIT.search(text)), []
    for kind, pattern in GENERATORS.items():
        if kind == "email_spelled":
            low = text.lower() if "at" in text or "AT" in text else ""
            if not any(x in low for x in ("(at)", "[at]", "{at}", " dot ")):
                continue
        elif not digits:
            continue
        out += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text)]
    return out


def described(text: str, span: Span) -> list[float]:
    """Format and context of one proposal, as numbers."""
    start, kind, end = span
    hit, before, after = text[start:end], text[max(0, start - 40) : start].lower(), text[end : end + 24].lower()
    digits = "".join(c for c in hit if "0" <= c <= "9")
    words = re.findall(r"[a-z]+", before)[-6:]
    close = {w.removesuffix("s") for w in words[-2:]}
    words += re.findall(r"[a-z]+", after)[:2]
    return [
        *(float(kind == KINDS.index(k)) for k in LOOSE),
        len(hit), len(digits), sum(c.isalpha() for c in hit), sum(not c.isalnum() for c in hit),
        len(set(digits)) / max(1, len(digits)),
        float(bool(digits) and luhn(digits)),
        float(_mod97(hit.replace(" ", ""))),
        float(bool(digits) and digits[:3] in ("000", "666") or digits[:1] == "9"),
        float(digits[-4:] == "0000" or digits[3:5] == "00"),
        float(bool(re.search(r"[A-Za-z0-9_/.#=-]$", before))),
        float(bool(re.match(r"[A-Za-z0-9_/=-]", after))),
        float(bool(re.search(r"\b(com|org|net|edu|de|fr|es|io|gov|info)$", hit.lower()))),
        *(float(any(w.startswith(x) for w in words for x in own)) for own in CONTEXT.values()),
        float(kind == KINDS.index("phone_local") and not close.isdisjoint(CONTEXT["other"])),
    ]


def examples(n: int = 1500, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Made examples: true spans, and codes, dates, versions and prose that look like them.

    True and false local phones come from the same formats; a false one always has something
    close that speaks against a phone: a word, a sign before it or a tail after it. Such words
    stand near true ones too, but farther off or with a word that speaks for a phone. Spelled
    addresses are told apart by their ends, so they have such words as well."""
    r = np.random.RandomState(seed)

    def number(k: int) -> str:
        return "".join(map(str, r.randint(0, 10, k)))

    def word() -> str:
        return "".join(r.choice(list("abcdefghilmnoprstuv"), r.randint(3, 9)))

    def iban(true: bool) -> str:
        body = number(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        return f"DE{check if true else (check + r.randint(1, 80)) % 97:02d}{body}"

    def card(true: bool) -> str:
        d = number(15)
        d += next(c for c in "0123456789" if luhn(d + c) == true)
        return " ".join(d[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        area, a, b, long = r.randint(200, 1000), r.randint(200, 1000), number(4), number(r.randint(5, 9))
        trunk, sep, gap = "0" + number(r.randint(2, 5)), r.choice([" ", "/", "-"]), r.choice(["", " "])
        head = r.choice(["", f"+{r.randint(1, 1000)}{gap}"], p=[0.8, 0.2])
        shapes = [f"{head}({area}){gap}{a}{s}{b}" for s in " .-"] + [f"{head}{area}{s}{a}{s}{b}" for s in " .-"] + [f"{trunk}{sep}{long}"] * 3
        return shapes[r.randint(len(shapes))]

    makers = (
        lambda true: f"{word()}.{word()} [at] {word()} [dot] com" if true and r.rand() < 0.5 else f"{word()}{r.randint(99)} at {word()} dot {'com' if true else word()}",
        lambda true: phone(),
        lambda true: f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}" if true else f"{r.choice(['000', '666', '9' + number(2)])}-{number(2)}-{number(4)}",
        iban,
        card,
    )
    x, y = [], []
    families = ("mail", "phone", "identity", "bank", "bank")
    for k in range(n):
        kind, true = k % len(makers), bool(r.rand() < 0.5)
        hint = r.choice(CONTEXT[families[kind]]) if true and r.rand() < 0.75 else r.choice(CONTEXT["other"]) if not true and r.rand() < 0.75 else word()
        tail = "" if true or r.rand() < 0.6 else r.choice(["-", "/"]) + number(2)
        sign = "" if true or r.rand() < 0.7 else "#"
        if families[kind] == "phone" and not (true or tail or sign):
            hint = r.choice(CONTEXT["other"])
        first = word()
        if families[kind] in ("phone", "mail") and true and r.rand() < 0.4:
            first = f"{r.choice(CONTEXT['other'])} {word()} {word()} {word()}"
            if hint in CONTEXT["phone"] and r.rand() < 0.4:
                hint = f"{hint} {r.choice(CONTEXT['other'])}"
        text = f"{first} {hint} {word() + ' ' if r.rand() < 0.3 else ''}{sign}{makers[kind](true)}{tail} {word()}."
        for span in proposals(text):
            if span[1] == len(BASE) + kind:
                x.append(described(text, span))
                y.append(true)
    return np.array(x), np.array(y)


@lru_cache(maxsize=1)
def trained() -> tuple[Boosted, dict[int, float]]:
    """The trees, and for each loose kind the least probability at which 98 % of its held-out selections are true."""
    x, y = examples()
    model = Boosted().fit(x, y)
    p, least = model.probability(x[1::2]), {}
    for k in range(len(LOOSE)):
        own = x[1::2][:, k] == 1
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(y[1::2][own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= 0.98)
        least[len(BASE) + k] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 2.0
    return model, least


def added_spans(text: str, base: list[Span], model: Boosted, least: dict[int, float]) -> list[Span]:
    """The selected proposals, best first, that overlap neither each other nor a fixed span."""
    found = proposals(text)
    if not found:
        return []
    p = model.probability(np.array([described(text, s) for s in found]))
    out: list[Span] = []
    starts, ends = _union(base)
    for k in np.argsort(-p, kind="stable"):
        s = found[k]
        at = bisect_left(starts, s[2])  # those before it begin before the span ends
        if p[k] >= least[s[1]] and (not at or ends[at - 1] <= s[0]):
            out.append(s)
            starts.insert(at, s[0])
            ends.insert(at, s[2])
    return out


def _union(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, in order and without overlaps."""
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted of every row.

    A null text counts as empty (its redacted text stays null). Texts of any
    length are read whole. Of proposals with equal probability the first
    generator's, then the leftmost, comes first. Repeated rows give repeated
    results; other columns are ignored; an empty table gives no rows."""
    model = trained()

    def make():
        def find(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                every = base + added_spans(text or "", base, *model)
                counts = [sum(s[1] == k for s in base) for k in range(4)]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), redacted(text, every) if text and every else text))
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", *(f"n_{b}" for b in BASE), "base_sha256", "spans", "redacted"])

        return find

    return by_batch(documents_of(documents), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string", make)


def redact(documents: DataFrame) -> DataFrame:
    """The same rows and columns with personal data replaced in text (and n_chars, where it is there, counted anew)."""
    model = trained()
    columns = documents.columns
    at = columns.index("text")

    def make():
        def replace(batch: pa.RecordBatch) -> pa.RecordBatch:
            new = []
            for text in batch.column(at).to_pylist():
                base = base_spans(text or "")
                spans = base + added_spans(text or "", base, *model)
                new.append(redacted(text, spans) if text and spans else text)
            return batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

        return replace

    out = by_batch(documents, documents.schema, make)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(documents.schema["n_chars"].dataType))) if "n_chars" in columns else out
