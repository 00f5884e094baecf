"""The pipeline's stages on a small corpus, and each stage against what it should keep."""

from __future__ import annotations

import random

import corpus_pipeline as cp


def corpus(spark):
    r = random.Random(2)
    syllables = {"en": ["the", "and", "ing", "tion", "er", "of"], "de": ["der", "ung", "ich", "sch", "ein", "und"]}

    def prose(lang):
        s = syllables[lang]
        return ". ".join(" ".join("".join(r.choice(s) for _ in range(r.randint(1, 3))) for _ in range(9)).capitalize() for _ in range(12)) + "."

    rows = [(k, prose("en" if k % 2 else "de"), "en" if k % 2 else "de") for k in range(80)]
    rows += [(100, rows[3][1], "en"), (101, rows[5][1] + " extra", "en"), (102, "mail me at x.y@mail.example.com " + rows[7][1][:0] + prose("en"), "en"), (103, None, "en"), (104, "", None), (105, "12 34", "en"), (106, "### *** $$$ " * 60, "en")]
    return spark.createDataFrame([(a, b, c, "s", len(b or "")) for a, b, c in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    docs = corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    ids = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path)).cache()
        assert out.columns == docs.columns
        ids[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
        kept = out
    assert not ids["language_id"] & {103, 104, 105, 106}
    assert len(ids["language_id"]) >= 80
    assert ids["near_dedup"] == ids["quality_rules"] - {100, 101}
    assert ids["personal_data"] == ids["near_dedup"]
    assert "[EMAIL]" in kept.filter("doc_id = 102").first()["text"]
    packed = cp.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids["personal_data"]


def test_near_duplicates_by_row(spark, tmp_path):
    texts = [r["text"] for r in corpus(spark).limit(12).collect()]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[0]), (-5, texts[2]), (3, texts[2] + " extra"), (None, texts[1]), (None, texts[3]), (None, texts[3] + " extra"), (None, texts[3]), (None, texts[4]), (None, None), (None, None), (None, ""), (4, "")]
    docs = spark.createDataFrame([(a, b, "en", "s", len(b or "")) for a, b in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sorted(texts.index(t.removesuffix(" extra")) for _, t in out if t) == [0, 1, 2, 3, 4]
    assert {(1, texts[0]), (1, texts[1]), (-5, texts[2]), (None, texts[4]), (4, ""), (None, "")} <= set(out) and out.count((None, None)) == 2
    assert len(out) == 9


def test_different_texts_of_one_doc_id_stay(spark, tmp_path):
    rows = [(1, "alpha beta " * 30 + "one"), (1, " ".join(f"w{k}" for k in range(60))), (1, " ".join(f"w{k}" for k in range(60)))]
    docs = spark.createDataFrame([(a, b, "en", "s", len(b), "x", 1) for a, b in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string, id int")
    out = cp.near_duplicates(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(r["text"] for r in out.collect()) == sorted({t for _, t in rows})


def test_empty(spark, tmp_path):
    corpus(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
