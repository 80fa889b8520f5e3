"""The most similar texts against all pairs, and canonical forms."""

import glob
import random

from pyspark.sql import functions as F

from loomquery.functions import canonical
from loomquery.operators import similar
from loomquery.sources.stored import shared_dir


def test_most_similar(spark, monkeypatch):
    monkeypatch.setattr(similar, "FIRST", 2)
    rng = random.Random(2)
    texts = []
    for i in range(60):
        if i % 3 and texts:
            words = rng.choice(texts).split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice("abcdefgh")
        else:
            words = [rng.choice("abcdefgh") for _ in range(rng.choice([3, 6, 12, 25]))]
        texts.append(" ".join(words))
    rows = list(enumerate(texts)) + [(60, None), (61, ""), (62, texts[0]), (63, texts[0].upper()), (64, "?!")]

    def shingles(text):
        words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    first = {}
    for i, text in rows:
        first.setdefault(shingles(text), i)
    want = []
    for i, text in rows:
        own = shingles(text)
        if i % 4 == 0 and own:
            near = sorted((-len(own & s) / len(own | s), j) for s, j in first.items() if s and s != own and own & s)
            want += [(i, rank, j, round(-x, 9)) for rank, (x, j) in enumerate(near[:3], 1)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "key long, text string, s int").repartition(3)
    found = similar.most_similar(frame, F.col("key") % 4 == 0, 3, "key", "text")
    assert sorted((r.query_key, r.rank, r.other_key, round(r.similarity, 9)) for r in found.collect()) == sorted(want)
    assert similar.most_similar(frame.limit(0), F.col("key") % 4 == 0, 3, "key", "text").collect() == []


def test_only_shingles_of_queries_are_stored(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(100))) for i in range(200)] + [(200, " ".join(f"w0x{j}" for j in range(50))), (201, " ".join(f"w1x{j}" for j in range(50)))]
    frame = spark.createDataFrame(rows, "key long, text string")
    folder = shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/similar-sets-*"))
    found = similar.most_similar(frame, F.col("key") == 0, 3, "key", "text").collect()
    assert [(r.query_key, r.rank, r.other_key, round(r.similarity, 9)) for r in found] == [(0, 1, 200, round(46 / 96, 9))]
    (path,) = set(glob.glob(f"{folder}/similar-sets-*")) - before
    kept = {r.key: r.n for r in spark.read.parquet(path).select("key", F.size("s").alias("n")).collect()}
    # Of 19,388 shingles in all: the query's, those of its part, and the few that the bitmap passes by chance.
    assert (kept[0], kept[200]) == (96, 46) and sum(kept.values()) < 400


def test_canonical_forms(spark):
    cases = [
        ('{ "b": 1,\n "a": [ {"d":2, "c": null} ] }', ".json", '{"a":[{"c":null,"d":2}],"b":1}'),
        ('{"a":1', ".json", '{"a":1'),
        ("  x \n\n y\t\r\n", ".txt", "x\ny"),
        ("a = 1  # one\n# all\n\nb#c", ".py", "a = 1\nb#c"),
        ("k: v # w\n #z\nlist:", ".yaml", "k: v\nlist:"),
        ("let a = 1; // one\n/* two\nlines */ let u = 'http://x';", ".js", "let a = 1;\nlet u = 'http://x';"),
        ("", ".py", ""),
        (None, ".json", None),
        (None, ".py", None),
    ]
    frame = spark.createDataFrame([(i, t, e) for i, (t, e, _) in enumerate(cases)], "i long, t string, e string")
    got = {r.i: r.c for r in frame.select("i", canonical.canonical(F.col("t"), F.col("e")).alias("c")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_most_similar_makes_no_row_for_a_pair(spark, monkeypatch):
    """F4 of round 4: a line that many texts share made each query meet all of them, and both sets went along with each pair."""
    kept, sizes = similar.stored, {}

    def seen(df, label):
        out = kept(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(similar, "stored", seen)
    texts = [(f"k{i}", "this line stands in all of them " + " ".join(f"w{i * j % 101}" for j in range(i % 9))) for i in range(120)] + [("k7", None), (None, "this line stands in all of them")]
    frame = spark.createDataFrame(texts, "key string, text string").repartition(4)
    ask = F.col("key").isin([f"k{i}" for i in range(40)])
    found = sorted((r.query_key, r.rank, r.other_key, r.similarity) for r in similar.most_similar(frame, ask, 3, "key", "text").collect())
    assert found and max(sizes.values()) <= 4 * len(texts)
    # Brute force over sets; equal sets stand under the smallest key.
    shingles = {}
    for key, text in texts:
        if key and text:
            w = text.split()
            shingles[key] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    one = {}
    for key in sorted(shingles):
        one.setdefault(shingles[key], key)
    want = []
    for i in range(40):
        own = shingles[f"k{i}"]
        near = sorted((-len(own & s) / len(own | s), key) for s, key in one.items() if s != own and own & s)
        want += [(f"k{i}", place, key, -s) for place, (s, key) in enumerate(near[:3], 1)]
    assert [(q, n, o, round(s, 9)) for q, n, o, s in found] == sorted((q, n, o, round(s, 9)) for q, n, o, s in want)
    # Few counts, shingles and hits at once.
    for name, value in (("CELLS", 50), ("GROUP_SHINGLES", 40), ("FIRST", 2)):
        monkeypatch.setattr(similar, name, value)
    assert sorted((r.query_key, r.rank, r.other_key, r.similarity) for r in similar.most_similar(frame, ask, 3, "key", "text").collect()) == found
