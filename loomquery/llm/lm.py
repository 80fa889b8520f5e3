"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.llm.common import cut, partitions, words

ORDER = 2
BASE = 1.5  # of the logarithm that quantises counts
BITS_PER_KEY = 12
PROBE_BITS = 4  # bits of a key, all in one 64-bit word of the filter
PRIOR = 300.0  # weight of the lower order in the interpolation
SLICE_BYTES = 2 << 20  # of text, for each of which there is a slice
FLUSH = 3_000_000  # tokens that a task counts before it sends them on
MAX_BROADCAST = 256 << 20  # bytes of the model that a worker holds
MAX_PART = 16 << 20  # bytes of it that the driver holds at once
BLOCK = 256  # texts handled at once in a task
ASK_BYTES = 16 << 20  # of text, whose probes go to the slices together where the model is not broadcast
RANGE_BITS = 4  # 2^4 neighbouring slices answer together
KNOWN_WORDS = 600_000  # after which a task forgets the hashes it has looked up
#: No word can contain these.
START, END = xxhash.xxh64_intdigest(b" "), xxhash.xxh64_intdigest(b"\n")
#: Odd multipliers (fixed values: fractional bits of the square roots of 7, 11 and 13).
MIX = tuple(np.uint64(x) for x in (0xA54FF53A5F1D36F1, 0x510E527FADE682D1, 0x9B05688C2B3E6C1F))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * MIX[0]
    return (h ^ h >> np.uint64(29)) * MIX[1]


def extend(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from that of its first n - 1 words and its last word's."""
    return mix(history * MIX[2] + word)


def quantise(count: np.ndarray) -> np.ndarray:
    """1 + the logarithm of the count, rounded down: how often an n-gram is put into the filter."""
    return 1 + np.floor(np.log(count) / math.log(BASE) + 1e-9).astype(np.int64)


#: The least and the largest count of a level; level 0 is an n-gram that was never put in.
LEVELS = 120
LEAST = np.array([0.0] + [math.ceil(BASE ** (q - 1) - 1e-9) for q in range(1, LEVELS)], float)
MOST = np.array([0.0] + [max(math.ceil(BASE**q - 1e-9) - 1, LEAST[q]) for q in range(1, LEVELS)], float)


def placement(h: np.ndarray, level: int | np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filter word of (n-gram, level) and the bits it sets there."""
    key = mix(h + np.asarray(level, np.uint64) * MIX[2])
    at = (key >> np.uint64(24)) % size
    bits = np.zeros(h.shape, np.uint64)
    for i in range(PROBE_BITS):
        bits |= np.uint64(1) << (key >> np.uint64(6 * i) & np.uint64(63))
    return at, bits


class Vocabulary(dict):
    """Numbers for the words met so far: 0 is the start, 1 the end of a text."""

    def __init__(self) -> None:
        self.fresh = [START, END]
        self.hashes = np.zeros(1 << 16, np.uint64)
        self.counts = np.zeros(1 << 16, np.int64)

    def __missing__(self, word: bytes) -> int:
        own = self[word] = len(self) + 2
        self.fresh.append(xxhash.xxh64_intdigest(word))
        return own

    def tokens(self, texts: pd.Series, filter_: Filter | Answers | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of all tokens of some texts, and where each text starts and how many it has.

        New words get their hash, and with a filter their count, for all texts at once.
        """
        ids = [np.fromiter(map(self.__getitem__, words(t)), np.int64) for t in texts]
        if self.fresh:
            new = np.array(self.fresh, np.uint64)
            last = len(self) + 2
            while last > len(self.hashes):
                self.hashes, self.counts = np.concatenate([self.hashes] * 2), np.concatenate([self.counts] * 2)
            self.hashes[last - len(new) : last] = new
            if filter_ is not None:
                self.counts[last - len(new) : last] = filter_.counts(new)
            self.fresh = []
        length = np.array([len(x) + 1 for x in ids])
        end = np.ones(1, np.int64)
        return np.concatenate([y for x in ids for y in (x, end)]), np.cumsum(length) - length, length


def ngrams(own: np.ndarray, start: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """The hashes of the n-grams that end at each token, from n = 2. The first token's history is the start.

    Of the order n, the first n - 2 of each text are not n-grams of that text.
    """
    grams = own
    for _ in range(2, order + 1):
        before = np.empty_like(grams)
        before[1:] = grams[:-1]
        before[start] = START
        grams = extend(before, own)
        yield grams


def packed(h: np.ndarray, slice_bits: int) -> Iterator[tuple[int, slice]]:
    """The slices that sorted hashes fall into, and where each one's stand."""
    of = (h >> np.uint64(64 - slice_bits)).astype(np.int64)
    begins = np.flatnonzero(np.diff(of, prepend=-1))
    for a, b in zip(begins, [*begins[1:], len(h)]):
        yield int(of[a]), slice(a, b)


def count_ngrams(docs: DataFrame, text_col: str, order: int, slice_bits: int) -> DataFrame:
    """slice, n (the order), grams, times: counts over whole texts, packed, a row per slice and flush of a task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary()
        held: list[list[np.ndarray]] = [[] for _ in range(order)]
        size = 0

        def flush() -> Iterator[pd.DataFrame]:
            for n, found in enumerate(held, 1):
                if found:
                    gram, times = np.unique(np.concatenate(found), return_counts=True)
                    found.clear()
                    rows = [(of, n, gram[at].tobytes(), times[at].astype(np.uint32).tobytes()) for of, at in packed(gram, slice_bits)]
                    for at in range(0, len(rows), 1024):
                        yield pd.DataFrame(rows[at : at + 1024], columns=["slice", "n", "grams", "times"])

        for batch in batches:
            for low in range(0, len(batch), BLOCK):
                flat, start, length = vocabulary.tokens(batch["text"].iloc[low : low + BLOCK])
                own = vocabulary.hashes[flat]
                place = np.arange(len(flat)) - np.repeat(start, length)
                held[0].append(own)
                for n, grams in enumerate(ngrams(own, start, order), 2):
                    held[n - 1].append(grams[place >= n - 2])
                size += len(own)
                if len(vocabulary) > KNOWN_WORDS:
                    vocabulary = Vocabulary()
                if size > FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(count, "slice long, n int, grams binary, times binary")


def added(rows: pd.DataFrame, n: np.ndarray | bool) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of packed rows, in order, and the sums of their counts."""
    grams = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(g, np.uint64) for g in rows["grams"][n]]])
    times = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(t, np.uint32) for t in rows["times"][n]]]).astype(np.uint64)
    by_hash = np.argsort(grams, kind="stable")
    grams, times = grams[by_hash], times[by_hash]
    begins = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return grams[begins], np.add.reduceat(times, begins) if len(begins) else times


@dataclass
class Model:
    """The corpus size N, its distinct tokens V, its texts, and the table of slices."""

    tokens: int
    types: int
    texts: int
    size: int  # bytes
    slice_bits: int
    order: int
    slices: DataFrame


SLICE = "slice long, grams binary, times binary, filter binary, tokens long, types long, texts long"


def fit(docs: DataFrame, text_col: str = "text", order: int = ORDER, slice_bytes: int = SLICE_BYTES) -> Model:
    """Count all n-grams up to ``order`` of whole texts and build the filter, slice by slice.

    n-grams are dealt by the top bits of their hash into slices, whose number
    follows the texts' size (one for each ``slice_bytes``), so that a slice has
    about as much to hold at every size. Tasks send packed counts; each slice is
    built in one group: exact counts of its single tokens, and a Bloom filter
    sized for its longer n-grams in which an n-gram of quantised count q stands
    q times, with the levels 1 to q.
    """
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    slice_bits = max(4, math.ceil(math.log2(max(1, n_bytes) / slice_bytes)))
    counts = count_ngrams(docs, text_col, order, slice_bits).repartition(partitions(docs.sparkSession), "slice")

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        gram, times = added(rows, rows["n"] == 1)
        filter_hashes, filter_times = (np.concatenate(x) for x in zip(*[(np.zeros(0, np.uint64), np.zeros(0, np.uint64)), *[added(rows, rows["n"] == n) for n in range(2, order + 1)]]))
        q = quantise(filter_times)
        size = max(1, math.ceil(int(q.sum()) * BITS_PER_KEY / 64))
        filter_words = np.zeros(size, np.uint64)
        h, level = filter_hashes, 1
        while len(h):
            at, bits = placement(h, level, np.uint64(size))
            np.bitwise_or.at(filter_words, at.astype(np.int64), bits)
            stay = q > level
            h, q, level = h[stay], q[stay], level + 1
        return pd.DataFrame([(key[0], gram.tobytes(), times.tobytes(), filter_words.tobytes(), int(times.sum()), len(times), int(times[gram == np.uint64(END)].sum()))], columns=["slice", "grams", "times", "filter", "tokens", "types", "texts"])

    slices = cut(counts.groupBy("slice").applyInPandas(build, SLICE), "lm-slices")
    size = F.length("grams") + F.length("times") + F.length("filter")
    total = slices.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "texts", size)]).first()
    return Model(*total, slice_bits, order, slices)


class Part:
    """Some slices as they are broadcast: sorted token hashes with their counts, and the filter's words; slices that are missing hold nothing."""

    def __init__(self, slice_bits: int, first: int, grams: np.ndarray, times: np.ndarray, size: np.ndarray, filter_words: np.ndarray) -> None:
        self.slice_bits, self.first, self.grams, self.times, self.size, self.filter = slice_bits, first, grams, times, size, filter_words
        self.offset = np.cumsum(size) - size

    @staticmethod
    def plain(slice_bits: int, first: int, last: int, rows: list) -> tuple:
        """What a part is made of, as arrays, from the rows of its slices."""
        rows = sorted(rows, key=lambda r: r["slice"])
        size = np.zeros(last - first + 1, np.uint64)
        for r in rows:
            size[r["slice"] - first] = len(r["filter"]) // 8
        return slice_bits, first, *(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r[c], np.uint64) for r in rows]]) for c in ("grams", "times")), size, np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r["filter"], np.uint64) for r in rows]])

    def own(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes belong to these slices, and the slice of each."""
        at = (h >> np.uint64(64 - self.slice_bits)).astype(np.int64) - self.first
        here = np.flatnonzero((at >= 0) & (at < len(self.size)))
        return here, at[here]

    def counts(self, h: np.ndarray, out: np.ndarray) -> None:
        """Put in the exact counts of single tokens."""
        here, _ = self.own(h)
        if len(self.grams) and len(here):
            at = np.searchsorted(self.grams, h[here])
            at[at == len(self.grams)] = 0
            out[here] = np.where(self.grams[at] == h[here], self.times[at], 0)

    def levels(self, h: np.ndarray, out: np.ndarray) -> None:
        """Put in the quantised counts of n-grams: levels are probed one after another until one is missing."""
        here, of = self.own(h)
        there = self.size[of] > 0
        here, of = here[there], of[there]
        level = 1
        while len(here) and level < LEVELS:
            word, bits = placement(h[here], level, self.size[of])
            held = self.filter[(word + self.offset[of]).astype(np.int64)] & bits == bits
            here, of = here[held], of[held]
            out[here] = level
            level += 1


class Filter:
    """All parts of a model that fits a worker."""

    def __init__(self, parts: list[Part]) -> None:
        self.parts = parts

    def counts(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        for part in self.parts:
            part.counts(h, out)
        return out

    def levels(self, h: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        for part in self.parts:
            part.levels(h, out)
        return out


def distinct(texts: pd.Series, order: int, vocabulary: Vocabulary) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The sorted hashes of the n-grams of some texts, for each n; and the tokens of each BLOCK of them."""
    held: list[list[np.ndarray]] = [[] for _ in range(order)]
    tokens = []
    for low in range(0, len(texts), BLOCK):
        flat, start, length = vocabulary.tokens(texts.iloc[low : low + BLOCK])
        tokens.append((flat.astype(np.int32), start, length))
        own = vocabulary.hashes[flat]
        for found, grams in zip(held, (own, *ngrams(own, start, order))):
            found.append(np.unique(grams))
    return [np.unique(np.concatenate(found)) for found in held], tokens


class Answers:
    """What the slices have answered to one block's probes (n, range, found), in the place of the filter."""

    def __init__(self, grams: list[np.ndarray], rows: pd.DataFrame) -> None:
        self.known = {}
        rows = rows.sort_values("range")
        for n, h in enumerate(grams, 1):
            self.known[n] = h, np.concatenate([np.frombuffer(x, np.int64 if n == 1 else np.uint8) for x in rows["found"][rows["n"] == n]])

    def levels(self, h: np.ndarray, n: int) -> np.ndarray:
        grams, found = self.known[n]
        order = np.argsort(h)  # in order they are found faster
        at = np.empty(len(h), np.int64)
        at[order] = np.minimum(np.searchsorted(grams, h[order]), len(grams) - 1)
        return np.where(grams[at] == h, found[at].astype(np.int64), 0)  # others span two texts and are not used

    def counts(self, h: np.ndarray) -> np.ndarray:
        return self.levels(h, 1)


def broadcast_filter(model: Model) -> list:
    """The model in parts, each a broadcast of its own, so the driver holds one of them at a time."""
    spark = model.slices.sparkSession
    sizes = model.slices.select("slice", (F.length("grams") + F.length("times") + F.length("filter")).alias("size")).orderBy("slice").collect()
    stretches: list[list[int]] = []
    held = MAX_PART
    for row in sizes:
        if held + row["size"] > MAX_PART:
            stretches.append([row["slice"], row["slice"]])
            held = 0
        stretches[-1][1] = row["slice"]
        held += row["size"]
    own = model.slices.select("slice", "grams", "times", "filter")
    return [spark.sparkContext.broadcast(Part.plain(model.slice_bits, a, b, own.filter(F.col("slice").between(a, b)).collect())) for a, b in stretches]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and the extra columns for every row.

    score is the log10 probability of the whole text, its end included, under
    the interpolation P(w|h) = (c(hw) + PRIOR * P(w|shorter h)) / (c(h) + PRIOR);
    the lowest order is the add-0.1 estimate of single tokens, whose sum is
    base_score. c(hw) comes out of the filter as the least count of its level
    and c(h), where it comes out of the filter, as the most, so that (false hits
    aside) the probabilities after a history never add up to more than 1.

    Null and empty texts are one end token. Texts are read whole; repeated rows
    and null ids are scored like others. A model of up to ``max_broadcast``
    bytes is broadcast. Beyond that the probes go to the slices and the answers
    come back to their texts, with the same result. Texts ask in blocks of about
    ASK_BYTES and 2^RANGE_BITS slices answer together, so that a row of probes
    holds many of them; answers are a byte each, in the order of the probes.
    """
    spark = docs.sparkSession
    denominator = model.tokens + 0.1 * (model.types + 1)
    prior_zero = math.log10(denominator)
    order, texts, slice_bits = model.order, model.texts, model.slice_bits
    extra = extra or {}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[c.alias(name) for name, c in extra.items()], F.col(text_col).cast("string").alias("text"))
    kept = rows.columns[:-1]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], "n_tokens long, n_known long, base_score double, score double"])

    def judged(flat: np.ndarray, start: np.ndarray, length: np.ndarray, vocabulary: Vocabulary, filter_: Filter | Answers) -> dict[str, np.ndarray]:
        own, counted = vocabulary.hashes[flat], vocabulary.counts[flat]
        place = np.arange(len(flat)) - np.repeat(start, length)
        logs = np.log10(counted + 0.1) - prior_zero
        p = 10.0**logs
        history = np.empty(len(flat))
        history[1:] = counted[:-1]
        history[start] = texts
        for n, grams in enumerate(ngrams(own, start, order), 2):
            found = np.where(place >= n - 2, filter_.levels(grams, n), 0)
            p = np.where(history > 0, np.minimum(1.0, (LEAST[found] + PRIOR * p) / (history + PRIOR)), p)
            history = np.empty(len(flat))
            history[1:] = MOST[found[:-1]]
            history[start] = 0
        return {"n_tokens": length, "n_known": np.add.reduceat(counted > 0, start, dtype=np.int64), "base_score": np.add.reduceat(logs, start), "score": np.add.reduceat(np.log10(p), start)}

    if model.size <= max_broadcast:
        shared = broadcast_filter(model)

        def pass_over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            filter_ = Filter([Part(*part.value) for part in shared])
            vocabulary = Vocabulary()
            for batch in batches:
                for low in range(0, len(batch), BLOCK):
                    part = batch.iloc[low : low + BLOCK]
                    yield pd.DataFrame({c: part[c].to_numpy() for c in kept} | judged(*vocabulary.tokens(part["text"], filter_), vocabulary, filter_))
                    if len(vocabulary) > KNOWN_WORDS:
                        vocabulary = Vocabulary()

        return rows.mapInPandas(pass_over, schema)

    range_bits = max(1, slice_bits - RANGE_BITS)
    own_bits = slice_bits - range_bits
    n_partitions = partitions(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """block, rows: about ASK_BYTES of texts and their other columns, compressed."""
        block, held = TaskContext.get().partitionId() << 32, []

        def row() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(low, BLOCK))
                if sum(part.nbytes for part in held) >= ASK_BYTES:
                    yield row()
                    block, held = block + 1, []
        if held:
            yield row()

    def read(rows: bytes) -> pa.Table:
        return pa.ipc.open_stream(rows).read_all()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, packed_ in zip(batch["block"], batch["rows"]):
                grams, _ = distinct(read(packed_)["text"].to_pandas(), order, Vocabulary())
                yield pd.DataFrame([(of, int(block), n, h[at].tobytes()) for n, h in enumerate(grams, 1) for of, at in packed(h, range_bits)], columns=["range", "block", "n", "grams"])

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each range the slices come first, then the probes, one after another."""
        last, rows, part = None, [], None
        for batch in batches:
            found = []
            for r in batch.to_dict("records"):
                if r["range"] != last:
                    last, rows, part = r["range"], [], None
                if r["block"] < 0:
                    rows.append(r)
                    continue
                part = part or Filter([Part(*Part.plain(slice_bits, last << own_bits, ((last + 1) << own_bits) - 1, rows))])
                h = np.frombuffer(r["grams"], np.uint64)
                found.append((r["block"], r["n"], last, (part.counts(h) if r["n"] == 1 else part.levels(h, r["n"]).astype(np.uint8)).tobytes()))
            yield pd.DataFrame(found, columns=["block", "n", "range", "found"])

    def judge(own: pa.Table, answers: pa.Table) -> pa.Table:
        own, vocabulary = read(own["rows"][0].as_py()), Vocabulary()
        grams, tokens = distinct(own["text"].to_pandas(), order, vocabulary)
        known = Answers(grams, answers.to_pandas())
        vocabulary.counts = known.counts(vocabulary.hashes)  # the hashes of words behind the last one are of no use
        parts = [judged(*own_tokens, vocabulary, known) for own_tokens in tokens]
        return pa.table({c: own[c] for c in kept} | {c: np.concatenate([part[c] for part in parts]) for c in parts[0]})

    # What is in a block is fixed by writing it.
    blocks = cut(rows.mapInArrow(pack, "block long, rows binary"), "lm-blocks")
    probes = blocks.mapInPandas(ask, "range long, block long, n int, grams binary")
    held = model.slices.select(F.shiftright("slice", own_bits).alias("range"), F.lit(-1).cast("long").alias("block"), F.lit(0).alias("n"), "grams", "slice", "times", "filter")
    both = held.unionByName(probes, allowMissingColumns=True).withColumn("slice", F.coalesce("slice", F.lit(0).cast("long")))
    answers = both.repartition(n_partitions, "range").sortWithinPartitions("range", "block").mapInPandas(answer, "block long, n int, range long, found binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, schema)
