"""Token ids in files: the library's ids, in order, read back from the files."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomquery.llm import token_files as tf

FILES = "/opt/tokenizers/"
ODD = ["it's. that's, 'tis' ok.'s ok'.s", "a_b_ c--d-- x.!? 9. é. ÿß; 中。 中! ա, x²! Ⅷ. <|endoftext|>. x<|endoftext|>.!", "", " ", "  a  b ", "a\n b", "a \nb", "\n", "\nfoo bar", "x  y", "don't 's  'll", "é ü 中文 字  x", "<|endoftext|> a<|endoftext|>b", "tab\t x \t y", "a " * 50, "\x1c a \x1c b", "a\u0085 b", "q" * 5000]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice([" ", "\n", "a", "b1", "'s", "é", "\t", "　", "中", ".", "\x1c", "​", "word ", "the "]) for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    with open(FILES + name, encoding="utf-8") as f:
        source = f.read()
    assert tf.cuts_at_blanks(source) == name.startswith("byte")
    units, library = tf.Units(source, 0), Tokenizer.from_str(source)
    for some in (ODD, texts(2000, 1), ODD + texts(50, 2)):
        flat, length = units.encode(some)
        for text, ids in zip(some, np.split(flat, np.cumsum(length)[:-1])):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids + [0], text


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tf, "KNOWN_UNITS", 50)
    with open(FILES + "byte_bpe_50k.json", encoding="utf-8") as f:
        units = tf.Units(f.read(), 7)
    for seed in range(6):
        some = texts(40, seed)
        assert units.encode(some)[0].tolist() == [i for t in some for i in units.tokenizer.encode(t, add_special_tokens=False).ids + [7]]
        assert units.n < 1000


@pytest.mark.parametrize("seed", range(30))
def test_packed_ids(seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(0, 12, rng.integers(1, 30))
    n[-1] += 1
    ranks = rng.integers(0, 2 ** rng.integers(1, 33, n.sum()), dtype=np.uint32)
    control, data = tf.pack_ids(ranks, n)
    assert len(control) == (-(-n // 4)).sum() and len(data) == sum(max(1, (int(r).bit_length() + 7) // 8) for r in ranks)
    assert (tf.unpack_ids(control, data, n) == ranks).all()


def test_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "BLOCK_IDS", 300)
    some = ODD + texts(300, 3) + ["again and again"] * 200
    rng = random.Random(0)
    rows = [(rng.choice([None, 5, i, -i]) if i % 9 else 5, t, "x", 1) for i, t in enumerate(some)] + [(7, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, rank int").repartition(5)
    path = f"file://{tmp_path}/files"
    found = tf.tokens_in_files(docs, FILES + "byte_bpe_50k.json", path=path).collect()
    library = Tokenizer.from_file(FILES + "byte_bpe_50k.json")
    ids = {t: library.encode(t or "", add_special_tokens=False).ids + [0] for _, t, *_ in rows}
    assert sorted((r["doc_id"] is not None, r["doc_id"], r["ids"]) for r in found if r["doc_id"] is not None) == sorted((True, d, ids[t]) for d, t, *_ in rows if d is not None)
    found.sort(key=lambda r: r["start"])
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in found]
    assert order == sorted(order) and len(found) == len(rows)
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found])[:-1].tolist()]
    again = {r["start"]: r for r in tf.read(spark, path, checksums=True).collect()}
    assert all(again[r["start"]]["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and again[r["start"]]["doc_id"] == r["doc_id"] for r in found)
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    assert [r["n"] for r in ranks] == sorted((r["n"] for r in ranks), reverse=True)
    assert spark.read.parquet(f"{path}/blocks").count() > 5
    assert tf.tokens_in_files(docs.limit(0), FILES + "byte_bpe_50k.json").collect() == []
