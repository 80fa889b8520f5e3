"""The corpus operators applied to whole tables, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.llm import langid, lm, packing, quality, sentencepiece_scan, token_files
from loomquery.llm.common import id_bucket
from loomquery.llm.exact_dedup import exact_dedup
from loomquery.llm.licenses import SHINGLE, SIMILARITY, TEMPLATES, license_scan
from loomquery.llm.negatives import hard_negatives
from loomquery.llm.prefix_trie import prefix_trie
from loomquery.llm.sharding import interleave_shards
from loomquery.llm.simhash import near_dedup
from loomquery.llm.topk import top_k

#: Ratings as grades: 0 toxic, 1 junk, 2 good.
GRADE = "if(toxic = 1, 0, 1 + quality)"
N_GRADES = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_bucket(F.col("doc_id"), 10) == 0
    model = lm.fit(docs.filter(~held_out))
    scored = lm.score(docs, model, extra={"held_out": held_out})
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_interleave_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave_shards(table(spark, sf_dir, "documents"))


def op4_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade (0 to 2), top_probability, selected. Where nothing is rated, the grades are null and every row is selected."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), GRADE, N_GRADES)
    graded = docs.select("doc_id", quality.grade_texts(docs, model).alias("g"))
    return graded.select("doc_id", "g.*", F.coalesce(F.col("g.top_probability") >= 0.5, F.lit(True)).alias("selected"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: Where the public tokenizer files are; no copy of them is kept here.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model: str = TOKENIZER) -> DataFrame:
    """doc_id, row_no, chunk, n_chars, n_tokens, ids, round_trip (decoding gives the text back): a row for each document, or each chunk of a giant one."""
    pieces = sentencepiece_scan.Pieces.load(model)
    back = sentencepiece_scan.decode(sentencepiece_scan.encode(table(spark, sf_dir, "documents"), pieces), pieces)
    return back.select("doc_id", "row_no", "chunk", F.length("covered").alias("n_chars"), F.size("ids").alias("n_tokens"), "ids", (F.col("decoded") == F.col("covered")).alias("round_trip"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_bucket(F.col("doc_id"), 4) == 2
    filters = langid.fit(docs.filter(~held_out))
    named = docs.select("doc_id", held_out.alias("held_out"), langid.identify(docs, filters).alias("p"))
    return named.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is moved on by one, so that some negatives are false ones."""
    label = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation begins with turns of the first one of its hundred."""
    conv = F.col("conv")
    return prefix_trie(table(spark, sf_dir, "conversations"), conv - conv % 100, F.crc32(conv.cast("string")) % 6)


def op13_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.tokens_in_files(table(spark, sf_dir, "documents"), tokenizer, checksums=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_lm_score": op2_lm_score,
    "op3_interleave_shards": op3_interleave_shards,
    "op4_quality_grade": op4_quality_grade,
    "op5_exact_topk": op5_exact_topk,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_license_scan": op7_license_scan,
    "op8_language_id": op8_language_id,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_files": op13_token_files,
}

def _shingle_rows(name: str, rows: str, keys: str) -> str:
    """CTEs: the five-word shingles of every row, with their positions."""
    after = " || ' ' || ".join(["w", *(f"lead(w, {i}) OVER o" for i in range(1, SHINGLE))])
    return f"""
        {name}_words AS (SELECT {keys}, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS pos
            FROM (SELECT *, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words FROM ({rows}))),
        {name} AS (SELECT * FROM (SELECT {keys}, pos, {after} AS shingle FROM {name}_words WINDOW o AS (PARTITION BY {keys} ORDER BY pos)) WHERE shingle IS NOT NULL)"""


_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in TEMPLATES)
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: A CTE: the table of the CRC-32 polynomial.
_CRC_TABLE = """tbl AS MATERIALIZED (
            SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t
        )"""

ORACLE_SQL: dict[str, str] = {
    "op11_hard_negatives": """
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS row_no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS MATERIALIZED (
            SELECT a.row_no AS anchor_row, a.vec_id AS anchor_id, a.label AS anchor_label, c.row_no AS own_row, c.vec_id, c.label,
                   list_inner_product(a.e, c.e)::BIGINT AS score
            FROM v a JOIN v c ON a.row_no <> c.row_no WHERE a.vec_id % 50 = 0
        ),
        p AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_row ORDER BY score DESC, vec_id, own_row) AS nth FROM s WHERE label = anchor_label)
            WHERE nth <= 5
        )
        SELECT * FROM (
            SELECT p.anchor_id, p.vec_id AS positive_id,
                   CAST(row_number() OVER (PARTITION BY p.anchor_row, p.own_row ORDER BY s.score DESC, s.vec_id, s.own_row) AS INTEGER) AS rank,
                   s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
            FROM p JOIN s ON s.anchor_row = p.anchor_row AND s.label <> p.anchor_label
                AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
        ) WHERE rank <= 3
    """,
    "op12_prefix_trie": f"""
        WITH {_CRC_TABLE},
        n AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY i) AS turns FROM n GROUP BY conv_id),
        h AS (
            SELECT conv_id, turns, conv_id - conv_id % 100 AS base,
                   xor(list_reduce(list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda b: ('0x' || b)::BIGINT),
                                   lambda x, y: xor(t[(xor(x, y) & 255) + 1], x >> 8), 4294967295), 4294967295) % 6 AS h
            FROM c, tbl
        ),
        r AS (
            SELECT h.conv_id, CASE WHEN b.conv_id IS NULL THEN h.turns[h.h + 1:] ELSE list_concat(b.turns[1:h.h], h.turns[h.h + 1:]) END AS turns
            FROM h LEFT JOIN c b ON b.conv_id = h.base
        ),
        p AS (SELECT conv_id, d AS depth, turns[1:d] AS path, len(turns) = d AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)),
        node AS (
            SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
            FROM p GROUP BY path, depth
        ),
        child AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
        own AS (
            SELECT node.*, coalesce(n_children, 0) AS n_children, up.conv_id AS parent_conv_id,
                   CASE WHEN node.depth > 0 THEN (node.n_convs - 1) * length(node.path[node.depth].text) ELSE 0 END AS saved
            FROM node LEFT JOIN child ON child.path = node.path LEFT JOIN node up ON node.depth > 0 AND up.path = node.path[1:node.depth - 1]
        ),
        total AS (
            SELECT p.path, count(*) FILTER (own.n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
            FROM own JOIN p ON p.conv_id = own.conv_id AND p.depth <= own.depth GROUP BY p.path
        )
        SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM own JOIN total USING (path)
    """,
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               text_sha256
        FROM d WINDOW same AS (PARTITION BY text_sha256)
    """,
    "op3_interleave_shards": """
        WITH tbl AS MATERIALIZED (
            SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t
        ),
        b AS (
            SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, coalesce('=' || source, '') AS stratum,
                   list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes
            FROM documents
        ),
        c AS (
            SELECT doc_id, size, stratum,
                   xor(coalesce(list_reduce(bytes, lambda x, y: xor(t[(xor(x, y) & 255) + 1], x >> 8), 4294967295), 4294967295), 4294967295) AS text_crc32
            FROM b, tbl
        ),
        d AS (SELECT *, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32) AS draw FROM c),
        r AS (
            SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY draw, doc_id, text_crc32, size) - 1)
                      / (2 * count(*) OVER (PARTITION BY stratum)) AS fraction
            FROM d
        ),
        p AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum, draw, doc_id, text_crc32, size) AS nth, count(*) OVER () AS total FROM r),
        s AS (SELECT *, (nth * 40 - 1) // total AS shard FROM p)
        SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
               CAST(nth - 1 - shard * total // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM s
    """,
    "op7_license_scan": f"""
        WITH {_shingle_rows("doc", "SELECT row_number() OVER () AS row_no, doc_id, text FROM documents", "row_no, doc_id")},
        {_shingle_rows("template", f"SELECT row_number() OVER () AS template_no, license_id, text FROM (VALUES {_TEMPLATE_ROWS}) AS v(license_id, text)", "template_no, license_id")},
        sized AS (SELECT DISTINCT template_no, license_id, shingle, count(*) OVER (PARTITION BY template_no) AS t, count(DISTINCT shingle) OVER (PARTITION BY template_no) AS own FROM template),
        hit AS (SELECT row_no, doc_id, template_no, license_id, t, own, shingle, pos // t AS block FROM doc JOIN sized USING (shingle)),
        inside AS (SELECT *, unnest([block, greatest(block - 1, 0)]) AS k FROM hit),
        held AS (
            SELECT row_no, doc_id, template_no, license_id, t, k, count(DISTINCT shingle) / own AS containment
            FROM inside GROUP BY row_no, doc_id, template_no, license_id, t, own, k
        )
        SELECT doc_id, license_id, max(containment) AS containment, count(DISTINCT (t, k)) AS n_windows
        FROM held WHERE containment >= {SIMILARITY}
        GROUP BY row_no, doc_id, license_id
    """,
    "op5_exact_topk": """
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        p AS (
            SELECT q.row_no, q.vec_id AS query_id, c.row_no AS own_row, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.row_no <> c.row_no
            WHERE q.vec_id % 100 = 0
        )
        SELECT * FROM (
            SELECT query_id,
                   CAST(row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id, own_row) AS INTEGER) AS rank,
                   vec_id, score
            FROM p
        ) WHERE rank <= 10
    """,
}
