"""Language identification by compression: a text belongs to the language
whose raw-content dictionary compresses it best.

The dictionaries are samples of labelled texts. Texts are reduced to lower-case
letters and single spaces, cut into blocks and compressed block by block, so
that a long text leans on the dictionary throughout."""

from __future__ import annotations

import math
import re

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_batch

#: Bounds of the fitted sample: languages (the most frequent), texts of each, and bytes of a dictionary.
LANGUAGES, SAMPLE_TEXTS, DICTIONARY_BYTES = 256, 400, 32_000
#: Characters compressed at once, compression level and shortest match, and the share of the size by which the best must win.
BLOCK_CHARS, LEVEL, MATCH, MARGIN = 2_000, 9, 3, 0.01
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def reduced(text: str | None) -> str:
    """The letters of a text in lower case, with one space for all else between them."""
    if not text:
        return ""
    clean = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not clean.replace(" ", "").isalpha():  # numerals that are no decimal digits
        clean = " ".join("".join(c if c.isalpha() else " " for c in clean).split())
    return clean


def learned(labelled: DataFrame, texts: int = SAMPLE_TEXTS, size: int = DICTIONARY_BYTES, languages: int = LANGUAGES) -> dict[str, bytes]:
    """A dictionary for each of the most frequent non-null langs of (key, text, lang), from about `texts` rows of it.

    Counts come from all rows; rows are then chosen by a hash of their key,
    and of each a passage at a hashed place of the whole text, so that the
    sample's size does not grow with the table: at most about 4 * size
    characters a language. Passages share the dictionary equally; where short
    ones leave room, the others go on."""
    usable = labelled.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not counts:
        return {}
    fractions, wanted = F.lit(0.0), F.lit(0)
    for lang, n in counts.items():
        fractions = F.when(F.col("lang") == lang, F.lit(min(1.0, texts / n))).otherwise(fractions)
        wanted = F.when(F.col("lang") == lang, F.lit(4 * size // min(texts, n))).otherwise(wanted)
    place = (F.pmod(F.xxhash64("key"), F.lit(2**31)) + 0.5) / 2**31
    passage = F.expr("substring(text, cast(1 + pmod(xxhash64(key, 3), greatest(1, length(text) - wanted + 1)) as int), wanted)")
    chosen = usable.filter(place < fractions).withColumn("wanted", wanted).select("lang", "key", passage.alias("text"))
    rows = sorted((tuple(r) for r in chosen.collect()), key=lambda r: (r[0], str(r[1]), r[2]))
    out: dict[str, bytes] = {}
    for lang in sorted(counts, key=lambda x: (-counts[x], x)):  # ties go to the most frequent
        own = [x for x in (reduced(r[2]) for r in rows if r[0] == lang) if x]
        if own:
            each = max(200, size // len(own))
            out[lang] = (" ".join(x[:each] for x in own) + " " + " ".join(x[each:] for x in own if x[each:])).strip().encode()[:size]
    return out


class Compared:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.languages = list(dictionaries)
        params = zstd.ZstdCompressionParameters.from_level(LEVEL, min_match=MATCH, write_content_size=0, write_checksum=0, write_dict_id=0)
        self._by = []
        for lang in self.languages:
            d = zstd.ZstdCompressionDict(dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self._by.append(zstd.ZstdCompressor(dict_data=d, compression_params=params))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language, a score from 0 to 1 and whether the margin is too narrow to believe."""
        clean = reduced(text)
        if not clean or not self._by:
            return UNKNOWN, 0.0, True
        blocks = [clean[k : k + BLOCK_CHARS].encode("utf-8", "replace") for k in range(0, len(clean), BLOCK_CHARS)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self._by]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
        margin = (rest - sizes[best]) / rest
        return self.languages[best], 1 - math.exp(-20 * margin) / 2, margin < MARGIN


def identified(documents: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """The rows of documents with lang_pred, score and lang_rejected after their own columns.

    A null text, or one without letters (numerals are none), is `und` with
    score 0 and rejected. Texts of any length are compressed whole, in blocks.
    Of equal sizes the more frequent language wins. Repeated rows give
    repeated results; columns of those names are replaced."""
    keep = documents.drop("lang_pred", "score", "lang_rejected")
    at = keep.columns.index("text")

    def make():
        compared = Compared(dictionaries)

        def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [compared.predict(t) for t in batch.column(at).to_pylist()]
            new = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            return pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "score", "lang_rejected"])

        return predict

    schema = T.StructType(list(keep.schema.fields)).add("lang_pred", "string").add("score", "double").add("lang_rejected", "boolean")
    return by_batch(keep, schema, make)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from the learner: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def language_id(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_rejected of every row; learned from the documents not held out.

    A null doc_id is not held out. An empty table gives no rows."""
    labelled = documents.filter(~held_out()).select(F.col("doc_id").alias("key"), "text", "lang")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return identified(rows, learned(labelled)).drop("text").select("doc_id", "held_out", "lang_pred", "score", "lang_rejected")
