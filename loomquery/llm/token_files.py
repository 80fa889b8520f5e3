"""Token ids in files: ranked by frequency, of one to four bytes each, with the lengths in control bytes of their own."""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomquery.llm.common import partitions
from loomquery.sources.stored import shared_dir

KNOWN_UNITS = 1_200_000  # units that a worker remembers before it begins anew: about 250 MB
LONG_UNIT = 64  # characters of a unit that is not worth remembering
JOINED = 256  # units the library gets in one string
BATCH_BYTES = 2 << 20
BLOCK_IDS = 1 << 20  # a block is closed at so many ids; a document is never divided

#: Lengths of the four ids that a control byte stands for: two bits each, lowest first, one byte less than the length.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
#: What of four bytes read at an id's place belongs to it.
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack_ids(ranks: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of documents of ``n`` ranks each: the ranks without their leading zero bytes, lowest byte first, and the lengths of four in each control byte. Each document begins with a control byte of its own."""
    used = -(-n // 4) * 4
    place = np.arange(len(ranks)) + np.repeat(np.cumsum(used - n) - (used - n), n)
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(int(used.sum()), np.uint8)
    codes[place] = length - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack_ids(control: bytes, data: bytes, n: np.ndarray) -> np.ndarray:
    """The ranks of documents of ``n`` ids each, whose control bytes and data bytes follow one another."""
    used = -(-n // 4)
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)
    whole = np.ones(len(length), bool)
    ends = np.cumsum(used) * 4
    for spare in range(3):  # a document's last control byte may stand for less than four ids
        whole[(ends - 1 - spare)[used * 4 - n > spare]] = False
    length = length[whole].astype(np.int64)
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    at = np.cumsum(length) - length
    ranks = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        some = np.flatnonzero(length > k)
        ranks[some] |= padded[at[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks & MASKS[length]


def cuts_at_blanks(source: str) -> bool:
    """Whether the tokenizer surely begins a new piece at a blank between two visible characters: byte level with its own pattern, nothing before it."""
    found = json.loads(source)
    first = found.get("pre_tokenizer") or {}
    plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
    return bool(plain and not found.get("normalizer") and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in found.get("added_tokens", [])))


class Units:
    """Ids of texts. The text between two safe blanks is a unit, which is given to the library once and then remembered."""

    def __init__(self, source: str, end_id: int) -> None:
        self.tokenizer = Tokenizer.from_str(source)
        self.by_unit = cuts_at_blanks(source)
        self.end_id = end_id
        vocabulary = self.tokenizer.get_vocab()
        self.blank = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # pieces that begin with a blank
        self.blank[[i for piece, i in vocabulary.items() if piece.startswith("\u0120")]] = True
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.full(1 << 16, self.end_id, np.uint32)
        self.start, self.length = np.zeros(1 << 14, np.int64), np.ones(1 << 14, np.int64)
        self.n = self.used = 1  # unit 0 is a text's end

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of texts, one after another, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        length = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum())), length

    def joined_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids() of units with one blank each, at their beginning: they go to the library many at a time, and a new one begins where a piece begins with a blank."""
        flat, _ = self.ids(["".join(units[i : i + JOINED]) for i in range(0, len(units), JOINED)])
        begins = np.flatnonzero(self.blank[flat])
        return (flat, np.diff(begins, append=len(flat))) if len(begins) == len(units) else self.ids(units)

    @staticmethod
    def units(text: str) -> list[str]:
        """Pieces between blanks, joined again where a blank has white space or nothing visible beside it. All but the first stand for a blank and themselves."""
        pieces = text.split(" ")
        if not ("  " in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace()) and text.replace("\n", "").isprintable():
            return pieces
        out: list[list[str]] = []
        closed = False
        for p in pieces:
            if closed and p and p[0].isprintable():
                out.append([p])
            elif out:
                out[-1].append(p)
            else:
                out.append([p])
            closed = bool(p) and p[-1].isprintable()
        return [" ".join(x) for x in out]

    def add(self, flat: np.ndarray, length: np.ndarray) -> range:
        """Numbers for new units that have these ids, one after another."""
        n, used = self.n + len(length), self.used + len(flat)
        if n > len(self.start):
            more = np.zeros(n, np.int64)
            self.start, self.length = np.concatenate([self.start, more]), np.concatenate([self.length, more])
        if used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(used, np.uint32)])
        self.flat[self.used : used] = flat
        self.start[self.n : n], self.length[self.n : n] = self.used + np.cumsum(length) - length, length
        own = range(self.n, n)
        self.n, self.used = n, used
        return own

    def learn(self, fresh: list[str]) -> dict[str, int]:
        """Numbers of new units. One that begins with a line feed is a text's first, without blank before it."""
        joined = [u for u in fresh if " " not in u and u[:1] != "\n"]
        known = dict(zip(joined, self.add(*self.joined_ids([" " + u for u in joined]))))
        alone = [u for u in fresh if u not in known]
        return known | dict(zip(alone, self.add(*self.ids([u[1:] if u[:1] == "\n" else " " + u for u in alone]))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another and each with its end id, and how many each has."""
        if not self.by_unit:
            flat, length = self.ids(texts)
            return np.insert(flat, np.cumsum(length), np.uint32(self.end_id)), length + 1
        if self.n > KNOWN_UNITS or self.used > 4 * KNOWN_UNITS:
            self.clear()
        units: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                own = self.units(text)
                own[0] = "\n" + own[0]
                units += own
                sizes[i] = len(own)
        numbers = np.fromiter(map(self.number.get, units, repeat(-1)), np.int64, len(units))
        at = np.flatnonzero(numbers < 0)
        if len(at):
            fresh = [units[i] for i in at.tolist()]
            known = self.learn(list(dict.fromkeys(fresh)))
            numbers[at] = np.fromiter(map(known.__getitem__, fresh), np.int64, len(fresh))
            self.number.update(known if max(map(len, known)) <= LONG_UNIT else {u: k for u, k in known.items() if len(u) <= LONG_UNIT})
        ends = np.cumsum(sizes)
        order = np.insert(numbers, ends, 0)
        length = self.length[order]
        after = np.cumsum(length)
        ids = self.flat[np.repeat(self.start[order] - after + length, length) + np.arange(after[-1] if len(after) else 0)]
        return ids, np.diff(after[ends + np.arange(len(texts))], prepend=0)


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])


def encode(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned integers, ``end_id`` last; of two bytes if all of the vocabulary fits, else of four) of every row, and counts.

    ``counts`` is null but in one row that each task adds at its end, which has
    nothing else: how often each id came, as little-endian 64-bit integers.

    ``tokenizer`` is the path of a file of the tokenizers library; it is read by
    the driver and sent to the tasks. Texts are taken whole, without special
    tokens around them. A null text counts as empty and has the end id only;
    null ids and repeated rows are kept; other columns are ignored; an empty
    table gives no documents.
    """
    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()
    largest = max([end_id, *Tokenizer.from_str(source).get_vocab().values()])
    # A worker keeps what it has learned in its copy of the broadcast value, for the tasks that follow.
    shared = docs.sparkSession.sparkContext.broadcast({"source": source})
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = "<u2" if largest < 1 << 16 else "<u4"

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores have tasks of their own
        kept = shared.value
        units = kept["units"] if "units" in kept else kept.setdefault("units", Units(kept["source"], end_id))
        total = np.zeros(largest + 1, "<i8")
        for batch in batches:
            size = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // BATCH_BYTES, prepend=-1)).tolist() + [len(size)]
            for low, high in zip(cuts, cuts[1:]):
                ids, length = units.encode(batch.column(1).slice(low, high - low).to_pylist())
                total += np.bincount(ids, minlength=largest + 1)
                ends = np.concatenate([[0], np.cumsum(length)]) * np.dtype(kind).itemsize
                raw = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(length), raw.cast(pa.binary()), pa.nulls(len(length), pa.binary())], schema=ENCODED)
        yield pa.RecordBatch.from_pydict({"doc_id": [None], "n_tokens": [None], "ids": [None], "counts": [total.tobytes()]}, schema=ENCODED)

    return rows.mapInArrow(tokens, "doc_id long, n_tokens long, ids binary, counts binary")


def frequency_ranks(encoded: DataFrame) -> DataFrame:
    """rank (from 0), id, n: ids by falling count, then by id; ids that don't occur are left out."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.column(0).to_pylist():
                total = np.frombuffer(own, "<i8")
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"id": seen, "n": total[seen]})

    each = encoded.select("counts").filter("counts is not null").mapInArrow(counted, "id long, n long")
    return each.groupBy("id").agg(F.sum("n").alias("n")).withColumn("rank", F.expr("row_number() over (order by n desc, id) - 1"))


def write(encoded: DataFrame, path: str) -> None:
    """Write ``encoded``, as encode() gives it, to the folder ``path`` in ascending doc_id order, null ids first.

    Rows of one id follow each other by a hash of their ids. ``path`` gets three
    parts. ``ranks``: the id of each rank, most frequent first. ``shards``: how
    many ids stand before each shard. ``blocks``: one row for each block of
    about BLOCK_IDS ids (or one longer document), with the shard, its place
    there, the documents' ids and lengths, the control bytes and the data bytes.
    Shards are ranges of (doc_id, hash, row), so that a repeated id spreads over
    as many as it needs. Parquet is only the container: its committer sees to it
    that the files of a task that was repeated are there once.

    What is broadcast is the vocabulary, whose size doesn't depend on the
    corpus. An empty table gives empty parts.
    """
    spark = encoded.sparkSession
    frequency_ranks(encoded).coalesce(1).sortWithinPartitions("rank").write.parquet(f"{path}/ranks")
    by_rank = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.int64)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)
    keys = [F.col("doc_id").asc_nulls_first(), F.col("mark"), F.col("row_no")]
    ordered = (
        encoded.filter("n_tokens is not null").select("doc_id", "n_tokens", "ids", F.xxhash64("ids").alias("mark"), F.monotonically_increasing_id().alias("row_no"))
        .repartitionByRange(partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .select(F.spark_partition_id().alias("shard"), "doc_id", "n_tokens", "ids")
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        offset = 0

        def closed(shard: int, docs: list, lengths: list, ids: list) -> pa.RecordBatch:
            nonlocal offset
            n = np.array(lengths, np.int64)
            flat = ranks[np.frombuffer(b"".join(ids), f"<u{len(ids[0]) // lengths[0]}")]
            control, data = pack_ids(flat, n)
            row = {"shard": [shard], "offset": [offset], "doc_ids": [docs], "lengths": [lengths], "control": [control], "data": [data]}
            offset += int(n.sum())
            return pa.RecordBatch.from_pydict(row, schema=BLOCK)

        docs, lengths, ids, held, shard = [], [], [], 0, 0
        for batch in batches:
            for shard, doc_id, n, own in zip(*(c.to_pylist() for c in batch.columns)):
                docs.append(doc_id)
                lengths.append(n)
                ids.append(own)
                held += n
                if held >= BLOCK_IDS:
                    yield closed(shard, docs, lengths, ids)
                    docs, lengths, ids, held = [], [], [], 0
        if docs:
            yield closed(shard, docs, lengths, ids)

    ordered.mapInArrow(blocks, BLOCK_DDL).write.option("compression", "zstd").parquet(f"{path}/blocks")
    # A row for each shard: as many as there were tasks.
    sizes = spark.read.parquet(f"{path}/blocks").select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    sizes.withColumn("start", F.expr("sum(n) over (order by shard) - n")).coalesce(1).write.parquet(f"{path}/shards")


BLOCK_DDL = "shard int, offset long, doc_ids array<long>, lengths array<long>, control binary, data binary"
BLOCK = pa.schema([("shard", pa.int32()), ("offset", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])


def read(spark: SparkSession, path: str, checksums: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document in the files of ``path``.

    With ``checksums``, ids_crc32 stands in the place of ids: the unsigned crc32
    of the ids as little-endian unsigned 32-bit integers.
    """
    by_rank = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")
    starts = {r["shard"]: r["start"] for r in spark.read.parquet(f"{path}/shards").collect()}
    shared = spark.sparkContext.broadcast((by_rank, starts))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, before = shared.value
        for batch in batches:
            for block in batch.to_pylist():
                n = np.array(block["lengths"], np.int64)
                ids = table[unpack_ids(block["control"], block["data"], n)]
                ends = np.cumsum(n)
                each = np.split(ids, ends[:-1])
                rows = {"doc_id": pa.array(block["doc_ids"], pa.int64()), "start": before[block["shard"]] + block["offset"] + ends - n, "n_tokens": n}
                if checksums:
                    rows["ids_crc32"] = pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())
                else:
                    rows["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(rows)

    return spark.read.parquet(f"{path}/blocks").mapInArrow(documents, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if checksums else "ids array<int>"))


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def tokens_in_files(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", checksums: bool = False) -> DataFrame:
    """encode(), write() to ``path`` (by default a new folder in the shared one) and read().

    Texts are tokenised once: their ids are written before they are counted and
    put in order.
    """
    spark = docs.sparkSession
    path = path or new_folder(spark, "tokens")
    encode(docs, tokenizer, end_id, id_col, text_col).write.option("compression", "zstd").parquet(step := new_folder(spark, "token-ids"))
    write(spark.read.parquet(step), path)
    return read(spark, path, checksums)
