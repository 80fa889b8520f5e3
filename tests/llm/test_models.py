"""Language model, language ID, quality grades and SentencePiece."""

import collections
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomquery.llm import langid, lm, quality
from loomquery.llm import sentencepiece_scan as sp
from loomquery.llm.common import words

DOCS = "doc_id long, text string, lang string"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS)


TEXTS = [(1, "the cat sat on the mat", "en"), (2, "the cat ran", "en"), (3, None, "en"), (4, "", "en"), (5, "The  dog\tsat on the Cat", None), (None, "a " * 3000, "en"), (5, "The  dog\tsat on the Cat", None)]


def interpolated(seen, text, order):
    """(log10 probability, base scores) of a token list by plain counting, with the counts as coarse as the filter's."""
    count = collections.Counter(x for s in seen for x in s)
    n, v = sum(count.values()), len(count)
    grams = collections.Counter(tuple(([None] + s)[max(0, i + 2 - k) : i + 2]) for s in seen for i in range(len(s)) for k in range(2, order + 1) if i >= k - 2)

    def level(gram):
        return int(lm.quantise(np.array([grams[gram]]))[0]) if grams[gram] else 0

    score, base = 0.0, []
    for i, x in enumerate(text):
        base.append(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))))
        p, line = 10 ** base[-1], [None] + text
        for k in range(2, order + 1):
            if i < k - 2:
                break
            gram = tuple(line[i + 2 - k : i + 2])
            past = gram[:-1]
            held = (len(seen) if past == (None,) else count[past[0]]) if k == 2 else lm.MOST[level(past)]
            if held > 0:
                p = min(1.0, (lm.LEAST[level(gram)] + lm.PRIOR * p) / (held + lm.PRIOR))
        score += math.log10(p)
    return score, base, count, n, v


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("max_broadcast", [1 << 28, 0])
def test_language_model(spark, order, max_broadcast):
    rng = random.Random(order)
    rows = TEXTS + [(i, " ".join(rng.choices("abcdefgh", weights=[20, 9, 5, 3, 2, 1, 1, 1], k=rng.randint(1, 60))), None) for i in range(10, 300)]
    docs = table(spark, rows).repartition(3)
    train = docs.filter("doc_id is null or doc_id % 10 <> 2").withColumn("levels", F.lit(1))
    model = lm.fit(train, order=order, slice_bytes=200)
    assert model.slice_bits > 4
    tokens = [words(t) + [b"\n"] for _, t, _ in rows]
    seen = [s for s, (k, _, _) in zip(tokens, rows) if k is None or k % 10 != 2]
    got = collections.defaultdict(list)
    for r in lm.score(docs, model, extra={"twice": F.col("doc_id") * 2}, max_broadcast=max_broadcast).collect():
        got[r.doc_id].append(r)
        assert r.twice == (None if r.doc_id is None else 2 * r.doc_id)
    assert sum(map(len, got.values())) == len(rows)
    same = []
    for (k, _, _), own in zip(rows, tokens):
        score, base, count, n, v = interpolated(seen, own, order)
        assert (model.tokens, model.types, model.texts) == (n, v, len(seen))
        for r in got[k]:
            assert (r.n_tokens, r.n_known) == (len(own), sum(count[x] > 0 for x in own))
            assert r.base_score == pytest.approx(sum(base), rel=1e-9)
            same.append(abs(r.score - score) / len(own))
    # What differs are false hits of the filter, either way.
    assert max(same) < 0.5 and np.mean(same) < 0.02, (max(same), np.mean(same))


def test_counts_beyond_32_bits(spark):
    docs = table(spark, TEXTS)
    model = lm.fit(docs)
    rows = [r.asDict() | {"times": (np.frombuffer(r.times, np.uint64) * np.uint64(1 << 32) + np.uint64(3)).tobytes()} for r in model.slices.collect()]
    model.slices = spark.createDataFrame(rows, lm.SLICE)
    model.tokens = sum(int(np.frombuffer(r["times"], np.uint64).sum()) for r in rows)
    count = collections.Counter(x for _, t, _ in TEXTS for x in words(t) + [b"\n"])
    want = sorted(sum(math.log10((count[x] * 2**32 + 3.1) / (model.tokens + 0.1 * (model.types + 1))) for x in words(t) + [b"\n"]) for _, t, _ in TEXTS)
    both = [sorted((r.base_score, r.score) for r in lm.score(docs, model, max_broadcast=limit).collect()) for limit in (1 << 28, 0)]
    assert both[0] == both[1] and [b for b, _ in both[0]] == pytest.approx(want)


def test_filter_levels_are_never_underestimated(spark):
    docs = table(spark, [(i, "a b " * (i % 40 + 1), "en") for i in range(60)])
    model = lm.fit(docs)
    filter_ = lm.Filter([lm.Part(*b.value) for b in lm.broadcast_filter(model)])
    h = {w: np.array([__import__("xxhash").xxh64_intdigest(w)], np.uint64) for w in (b"a", b"b")}
    total = sum(i % 40 + 1 for i in range(60))
    assert filter_.counts(h[b"a"])[0] == total
    assert filter_.levels(lm.extend(h[b"a"], h[b"b"]), 2)[0] >= lm.quantise(np.array([total]))[0]


def test_language_model_of_nothing(spark):
    model = lm.fit(table(spark, []))
    assert lm.score(table(spark, []), model).count() == 0
    assert lm.score(table(spark, TEXTS[:2]), model).agg(F.sum("n_known")).first()[0] == 0


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    filters = langid.fit(docs.filter(~held))
    assert filters.langs == ["de", "en", "es", "fr"]
    right = docs.filter(held).select((langid.identify(docs, filters)["lang"] == F.col("lang")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert right > 0.97
    odd = table(spark, [(1, None, None), (2, "", None), (3, "123 ... ", None), (4, "the and of with " * 9000, None)]).withColumn("score", F.lit(1))
    got = [tuple(r.p) for r in odd.select("doc_id", langid.identify(odd, filters).alias("p")).orderBy("doc_id").collect()]
    assert got[:3] == [("und", 0.0)] * 3 and got[3][0] == "en" and 0 <= got[3][1] <= 1


def test_language_id_without_languages_and_with_many(spark):
    none = langid.fit(table(spark, [(1, "abc", None), (2, None, "en")]))
    assert none.predict("abc") == ("und", 0.0)
    rng = random.Random(1)
    alphabets = {f"l{i:02d}": [chr(0x4E00 + 40 * i + j) for j in range(30)] for i in range(70)}
    rows = [(100 * i + k, "".join(rng.choices(a, k=60)), name) for i, (name, a) in enumerate(alphabets.items()) for k in range(6)]
    many = langid.fit(table(spark, rows))
    assert len(many.langs) == 70 and many.table.shape[0] == 2
    assert sum(many.predict("".join(rng.choices(a, k=40)))[0] == name for name, a in alphabets.items()) >= 68


def test_quality_grades(spark):
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(60)]

    def text(kind):
        w = rng.choices(plain, k=rng.randint(20, 200))
        if kind == 0:
            w[rng.randrange(len(w))] = "stinker"
        if kind == 1:
            w = [x + "%%%" for x in w]
        return " ".join(w)

    grades = [i % 3 for i in range(600)]
    docs = table(spark, [(i, text(g), "en") for i, g in enumerate(grades)])
    rated = spark.createDataFrame([(i, g) for i, g in enumerate(grades) if i < 400] + [(None, 1), (5000, None)], "doc_id long, g int")
    model = quality.fit(docs, rated, "g", 3)
    assert (np.diff(model.thresholds) > 0).all()
    fresh = docs.filter("doc_id >= 400").withColumn("expected_grade", F.lit(0))
    got = {r.doc_id: r.g for r in fresh.select("doc_id", quality.grade_texts(fresh, model).alias("g")).collect()}
    assert sum(round(got[i].expected_grade) == grades[i] for i in got) / len(got) > 0.95
    assert all(0 <= g.top_probability <= 1 and 0 <= g.expected_grade <= 2 for g in got.values())
    odd = table(spark, [(1, None, None), (2, "", None), (3, "%%% " * 20_000, None)])
    assert odd.select(quality.grade_texts(odd, model)).count() == 3
    assert quality.fit(docs, rated.limit(0), "g", 3) is None


def test_quality_screen_equals_a_plain_count(spark):
    rng = random.Random(5)
    words_ = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words_, k=12) + (["low"] if i % 3 == 0 else ["mid"] if i % 3 == 1 and i % 2 else [])), "en") for i in range(240)]
    model = quality.fit(table(spark, rows), spark.createDataFrame([(i, i % 3) for i in range(240)], "doc_id long, g int"), "g", 3)
    sets = [{quality.bucket(f) for f in quality.features(t)} for _, t, _ in rows]
    want = set()
    for b in set().union(*sets):
        observed = np.array([[sum(b in s for i, s in enumerate(sets) if i % 3 == g), sum(b not in s for i, s in enumerate(sets) if i % 3 == g)] for g in range(3)], float)
        expected = observed.sum(axis=1, keepdims=True) * observed.sum(axis=0) / observed.sum()
        if observed[:, 0].sum() >= 8 and observed[:, 1].sum() and ((observed - expected) ** 2 / expected).sum() >= 18:
            want.add(b)
    assert set(model.weights) == want and {quality.bucket("low"), quality.bucket("mid")} <= want


def test_ordinal_fit_is_the_best_fit():
    rng = np.random.default_rng(8)
    x = rng.random((300, 4)) < 0.4
    latent = x @ np.array([2.0, -1.5, 0.5, 0.0]) + rng.logistic(size=300)
    grades = (latent > -0.5).astype(int) + (latent > 1.5)
    penalty = 1e-3
    weights, theta = quality.fit_ordinal(np.concatenate([np.flatnonzero(r) for r in x]), x.sum(axis=1), grades, 3, 4, steps=3000, rate=0.02, penalty=penalty)

    def likelihood(w, t):
        total = 0.0
        for row, g in zip(x, grades):
            tail = [1.0] + [1 / (1 + math.exp(c - row @ w)) for c in t] + [0.0]
            total += math.log(tail[g] - tail[g + 1])
        return total / len(x) - penalty / 2 * float(w @ w)

    best = likelihood(weights, theta)
    for i in range(4):
        for step in (-0.02, 0.02):
            assert likelihood(weights + step * np.eye(4)[i], theta) < best
    for i in range(2):
        for step in (-0.02, 0.02):
            assert likelihood(weights, theta + step * np.eye(2)[i]) < best


def test_quality_of_nothing_rated(spark, tmp_path):
    from loomquery.llm.queries import op4_quality_grade

    table(spark, [(1, "a b", "en"), (2, None, "en")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op4_quality_grade(spark, str(tmp_path)).collect()
    assert len(got) == 2 and all(r.selected and r.expected_grade is None and r.top_probability is None for r in got)


def test_language_filters_equal_sets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    filters = langid.fit(docs)
    rows = docs.collect()
    counts = {lang: collections.Counter() for lang in filters.langs}

    def grams(text):
        s = f" {langid.letters(text)} "
        return [s[i : i + n] for n in langid.ORDERS for i in range(len(s) - n + 1)]

    for r in rows:
        if r.lang is not None and langid.letters(r.text):
            counts[r.lang].update(grams(r.text))
    size = {lang: sum(c.values()) for lang, c in counts.items()}
    top = collections.defaultdict(float)
    for lang, c in counts.items():
        for g, n in c.items():
            top[g] = max(top[g], n / size[lang])
    sets = {lang: {g for g, n in c.items() if n >= (1 if size[lang] < langid.ENOUGH else 2) and n / size[lang] >= 0.25 * top[g]} for lang, c in counts.items()}
    same = 0
    for r in rows:
        if not langid.letters(r.text):
            continue
        found = grams(r.text)
        exact = np.array([sum(g in sets[lang] for g in found) for lang in filters.langs])
        hits, total = filters.hits(langid.letters(r.text))
        assert total == len(found) and (hits >= exact).all() and (hits - exact <= 0.1 * total + 3).all()
        same += filters.predict(r.text)[0] == filters.langs[int(np.argmax(exact))]
    assert same >= 0.98 * sum(bool(langid.letters(r.text)) for r in rows)


def test_language_draw_is_bounded_without_ids(spark):
    rows = [(None, f"text number {i}", "en") for i in range(600)] + [(7, f"texte {i}", "fr") for i in range(600)]
    sample, langs = langid.draw(table(spark, rows), "text", "lang", "doc_id", 100)
    sizes = dict(sample.groupBy("lang").count().collect())
    assert langs == ["en", "fr"] and all(50 < n < 160 for n in sizes.values())


@pytest.fixture(scope="module")
def pieces():
    if not os.path.exists(MODEL):
        pytest.skip("no tokenizer files here")
    return sp.Pieces.load(MODEL)


def chunked(model, text, chunk):
    s, side, parts = model.normal(text), 2 * model.longest, []
    for nth, low in enumerate(range(0, len(s), chunk)):
        high, left = min(low + chunk, len(s)), max(0, low - side)
        parts.append((s[left : high + side], low - left, high - left, nth == 0))
    states = sp.best_states([model.transfer(*p) for p in parts])
    return np.concatenate(model.emit_all([(t, low, high, e, q) for (t, low, high, _), (e, q) in zip(parts, states)])).tolist()


SAMPLES = ["Hello  world.\n\tTest É 漢字 ", "a" * 300, "the" * 90, " " * 70, "=" * 77, "supercalifragilistic" * 20, "x▁y z", "\x00 null"]


@pytest.mark.parametrize("chunk", [17, 33, 100])
def test_scan_equals_the_library(pieces, chunk):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(chunk)
    texts = SAMPLES + ["".join(rng.choices("abcdefgh  éß漢\n,.%", k=rng.randint(1, 200))) for _ in range(40)]
    for text in texts:
        want = library.encode(text)
        assert pieces.encode(text).tolist() == want == chunked(pieces, text, chunk)
        if "▁" not in text:
            assert pieces.decode(np.array(want, np.int32)) == text


def test_unigram_scan_finds_the_best_path():
    rng = random.Random(4)
    vocabulary = {a: -8.0 - rng.random() for a in "abc▁"} | {"".join(rng.choices("abc", k=rng.randint(2, 4))): -6 * rng.random() for _ in range(30)}
    model = sp.Pieces.of(vocabulary, ["<unk>", *vocabulary], {}, 0, False)

    def weight(ids):
        return sum(vocabulary[model.by_id[i]] for i in ids)

    for _ in range(60):
        text = "".join(rng.choices("abc ", weights=[5, 5, 5, 1], k=rng.randint(1, 120)))
        s = model.normal(text)
        best = [0.0] + [-math.inf] * len(s)
        for j in range(1, len(s) + 1):
            best[j] = max((best[i] + vocabulary[s[i:j]] for i in range(max(0, j - 4), j) if s[i:j] in vocabulary), default=-math.inf)
        for ids in (model.encode(text), chunked(model, text, 7), chunked(model, text, 30)):
            assert "".join(model.by_id[i] for i in ids) == s and weight(ids) == pytest.approx(best[-1])


def test_max_plus_product_is_associative():
    rng = np.random.default_rng(1)
    a, b, c = rng.normal(size=(2, 3)), rng.normal(size=(3, 4)), rng.normal(size=(4, 2))
    assert np.allclose(sp.combine(sp.combine(a, b), c), sp.combine(a, sp.combine(b, c)))


def test_words_merged_together_equal_words_merged_alone(pieces):
    rng = random.Random(7)
    words = ["".join(rng.choices("theandingr éß漢\n,.%" + sp.BLANK, k=rng.randint(1, 39))) for _ in range(500)] + ["▁", "漢", "a" * 70]
    ids, length = pieces.words_ids(words)
    ends = np.cumsum(length)
    for word, a, b in zip(words, ends - length, ends):
        assert ids[a:b].tolist() == [x for p in pieces.merged(word) for x in pieces.piece_ids(p)]


@pytest.mark.parametrize("fan", [2, 16])
def test_encode_and_decode_tables(spark, pieces, fan):
    giant = " ".join(random.Random(9).choices(["alpha", "Beta", "γάμμα", "\n", "x" * 50], k=3000))
    rows = [(1, "Hello world", None), (2, giant, None), (2, giant, None), (3, None, None), (4, "", None), (5, "nospace" * 3000, None), (6, "x▁y  z", None), (7, "é▁ " * 900, None)]
    encoded = sp.encode(table(spark, rows).withColumn("chunk", F.lit(9)), pieces, chunk=1000, fan=fan)
    back = sp.decode(encoded, pieces).collect()
    by_row = collections.defaultdict(list)
    for r in back:
        assert r.decoded == r.covered
        by_row[r.doc_id, r.row_no].append(r)
    texts = sorted((k[0], "".join(r.covered for r in sorted(rs, key=lambda r: r.chunk))) for k, rs in by_row.items())
    assert texts == sorted((i, (t or "").replace("▁", " ")) for i, t, _ in rows)
    for (i, _), rs in by_row.items():
        ids = [x for r in sorted(rs, key=lambda r: r.chunk) for x in r.ids]
        assert ids == pieces.encode(dict((a, b or "") for a, b, _ in rows)[i]).tolist()
    assert sp.encode(table(spark, []), pieces).count() == 0


def test_probes_do_not_grow_with_blocks_times_slices(spark, monkeypatch):
    """F1 of round 4: each 256 texts sent a row to each slice, and each row came back."""
    rows = [(i, " ".join(f"w{(i * j) % 997}" for j in range(1, 40))) for i in range(1500)] + [(None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    model = lm.fit(docs, slice_bytes=512)
    assert model.slice_bits > 8
    sent, packed = spark.sparkContext.accumulator(0), lm.packed

    def counted(h, bits):
        for row in packed(h, bits):
            sent.add(1)
            yield row

    monkeypatch.setattr(lm, "packed", counted)
    frame = lm.score(docs, model, max_broadcast=0)
    want = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score(docs, model).collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in frame.collect()) == want
    assert 0 < sent.value <= 2 * 2 ** (model.slice_bits - 4)  # one block of texts; it was 6 blocks, and all slices
    # Several blocks of a task, each with its own answers.
    monkeypatch.setattr(lm, "ASK_BYTES", 1 << 14)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score(docs, model, max_broadcast=0).collect()) == want
