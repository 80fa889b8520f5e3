"""Near duplicates against brute force."""

import random
import re

import pandas as pd
import pytest

from loomquery.functions.text import masked_environment
from loomquery.operators import near


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("least", [0.5, 0.8, 0.98])
def test_every_near_pair_is_found(spark, least):
    rng = random.Random(3)
    common = [f"c{i}" for i in range(40)]
    texts = ["", None, "one two", "ONE, two!"]
    for _ in range(15):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([6, 30, 80, 700]))] + rng.choice([[], common])
        texts.append(" ".join(base))
        for edits in (0, 1, 1, 2, 5):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            texts.append(" ".join(copy))
    sets = {i: shingles(t) for i, t in enumerate(texts) if shingles(t)}
    rep = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    firsts = sorted(set(rep.values()))
    want = {(a, b) for a in firsts for b in firsts if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [(r.first_key, r.second_key) for r in near.near_pairs(frame, "id", "text", least).collect()]
    assert want and sorted(got) == sorted(want)
    assert {r.key: r.representative for r in near.members(frame, "id", "text").collect()} == rep


def test_forks_that_differ_in_a_masked_url_and_a_word(spark):
    words = [f"w{i}" for i in range(1200)]
    one, other = "https://a.example " + " ".join(words), "https://b.example " + " ".join(words[:600] + ["new"] + words[601:])
    frame = spark.createDataFrame([(1, one), (2, other)], "id long, text string")
    masked = frame.select("id", masked_environment(frame["text"]).alias("m"))
    assert [(r.first_key, r.second_key) for r in near.near_pairs(masked, "id", "m", 0.98).collect()] == [(1, 2)]


def family(n, words):
    """n texts, each with two words of its own in place of others."""
    rng, base = random.Random(5), [f"w{i}" for i in range(words)]
    return [" ".join(base[:i] + [f"x{k}"] + base[i + 1 : j] + [f"y{k}"] + base[j + 1 :]) for k in range(n) for i, j in [sorted(rng.sample(range(words), 2))]]


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_sets_are_not_sent_to_each_of_their_pairs(spark):
    """two sets went along with every candidate pair."""
    texts = family(60, 5000)  # a set is longer than a block that the shuffle compresses
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = shuffled(spark)
    try:
        rows = near.near_pairs(frame, "id", "text", 0.8).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sent = shuffled(spark) - before
    sets = [shingles(t) for t in texts]
    assert {(r.first_key, r.second_key): round(r.jaccard, 9) for r in rows} == {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for b in range(60) for a in range(b)}
    assert sent < 20_000_000, sent  # 71 MB if a set of 40 kB goes with each of 1,770 pairs


def test_large_families_are_dealt_into_parts(spark, monkeypatch):
    """a row serves many pairs, and no cell holds a whole family."""
    monkeypatch.setattr(near, "SIDE", 8)
    # One family of 80, and small ones of two.
    pairs = [(a, b) for b in range(80) for a in range(b)] + [(i, i + 1) for i in range(100, 200, 2)]
    frame, own = spark.createDataFrame(pairs, "a long, b long"), spark.range(300)
    cells = near.in_cells(frame, own, lambda mine, own: pd.DataFrame({"pairs": [len(mine)], "rows": [len(own)], "right": [set(mine["a"]) | set(mine["b"]) == set(own["id"])]}), "pairs long, rows long, right boolean").collect()
    assert sum(c.pairs for c in cells) == len(pairs) and all(c.right for c in cells)
    assert max(c.rows for c in cells) < 60 and sum(c.rows for c in cells) < len(pairs) / 2
    texts = family(30, 60) + [t + " and more" for t in family(30, 300)] + ["one two three four five six"]
    frame = spark.createDataFrame([(f"k{i:02}", t) for i, t in enumerate(texts)], "id string, text string")
    sets = [shingles(t) for t in texts]
    want = {(f"k{a:02}", f"k{b:02}") for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    got = [(r.first_key, r.second_key) for r in near.near_pairs(frame, "id", "text", 0.8).collect()]
    assert len(want) > 400 and sorted(got) == sorted(want)
