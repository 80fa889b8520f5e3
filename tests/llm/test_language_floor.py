"""The pipeline's language stage rejects what no learned language knows."""

import random

import corpus_pipeline
from tests.conftest import DATA


def test_unlearned_scripts_and_random_letters_are_rejected(spark):
    rng = random.Random(7)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(40)) for _ in range(10)]
    alien = ["съешь ещё этих мягких французских булок да выпей чаю", "这是一个没有学过的语言的测试文本", *junk]
    extra = spark.createDataFrame([(10_000 + i, t, None) for i, t in enumerate(alien)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(extra), DATA).select("doc_id").collect()}
    clean = {r.doc_id for r in docs.filter("length(regexp_replace(text, '[^A-Za-z]', '')) > 100").select("doc_id").collect()}
    assert not {i for i in kept if i >= 10_000} and clean <= kept


def test_letters_are_of_letter_categories():
    """Numerals of all kinds are no letters; n-grams of a long text count once, wherever its blocks end."""
    import numpy as np

    from loomquery.llm import langid

    assert [langid.letters(x) for x in ("\u00bd \u00b2", "\u2167", "\u2460 12 \u0663", "a\u00bdb", "a \u00bd b", "\u4e2d\u6587 7", None, "")] == ["", "", "", "a b", "a b", "\u4e2d\u6587", "", ""]
    filters = langid.LanguageFilters(["de"], np.full((1, 1 << langid.SLOT_BITS), 1, np.uint64))
    assert [filters.predict(x)[0] for x in ("\u00bd \u00b2", "\u2167", "x")] == ["und", "und", "de"]
    text = "some words " * 40
    whole = filters.hits(text)
    block = langid._BLOCK
    try:
        for size in (1, 2, 3, 7, 50):
            langid._BLOCK = size
            assert filters.hits(text)[1] == whole[1] == sum(len(text) + 2 - n + 1 for n in langid.ORDERS)
    finally:
        langid._BLOCK = block


def test_all_labelled_rows_teach_the_pipeline(spark, monkeypatch):
    """filters and floors came from about 1,500 rows of a language, drawn by a hash of the key."""
    from loomquery.llm import langid

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=6)) for _ in range(3200)]
    seen, told = [], langid.identify

    def spy(df, filters, *a, **b):
        seen.append(filters.table.copy())
        return told(df, filters, *a, **b)

    monkeypatch.setattr(langid, "identify", spy)
    kept = []
    for shift in (0, 1_000_000):
        docs = spark.createDataFrame([(shift + i, t, "aa") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
        kept.append({r.doc_id - shift for r in corpus_pipeline.identify_language(spark, docs, DATA).select("doc_id").collect()})
    assert (seen[0] == seen[-1]).all() and kept[0] == kept[1] and len(kept[0]) >= 0.99 * len(texts)
