"""The registered queries of the training-data operators, and their SQL where SQL can tell the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recon.llm.bisectors import centroid_clusters
from recon.llm.bottomk import near_groups
from recon.llm.common import table
from recon.llm.ctw import lm_scores
from recon.llm.mixing import mix
from recon.llm.naming import exact_groups
from recon.llm.packing import pack
from recon.llm.repeats import repeated_strings
from recon.llm.runs import word_runs
from recon.llm.sharding import shard
from recon.llm.templates import drop_repeated_lines
from recon.llm.topk import top_inner_products
from recon.llm.toxicity import toxicity
from recon.llm.warc import archive_round_trip


def op1_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).drop("html")


def op2_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("row_id")


def packed(docs: DataFrame) -> DataFrame:
    """Packed by the public byte-level vocabulary of the box."""
    import public_tokenizers as public

    return pack(
        docs, public.path("byte_bpe_50k.json"), ranks=public.path("byte_bpe_50k.tiktoken"), pattern=public.PATTERN
    )


def op3_tree_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op4_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op7_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op8_hash_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("times")


def op9_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), words=2).drop("row_id", "first")


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents"))


def op11_bisectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs(table(spark, sf_dir, "documents"), plant=True)


def op13_bucket_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(table(spark, sf_dir, "documents"))


# Base32 of the SHA-1: its 160 bits in groups of five.
OP1_SQL = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), b AS (
    SELECT *, array_to_string(list_transform(string_split(sha1(body), ''),
               lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111',
                          '1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', c)]), '') AS bits,
           first_value(page_id) OVER (PARTITION BY body ORDER BY page_id NULLS LAST) AS keep
    FROM p
)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + 16 * substr(bits, (5 * i + 1)::INT, 1)::INT + 8 * substr(bits, (5 * i + 2)::INT, 1)::INT
             + 4 * substr(bits, (5 * i + 3)::INT, 1)::INT + 2 * substr(bits, (5 * i + 4)::INT, 1)::INT
             + substr(bits, (5 * i + 5)::INT, 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN keep IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keep IS NOT DISTINCT FROM page_id THEN NULL ELSE keep END AS refers_to
FROM b
"""

OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP5_SQL = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
), m AS (
    SELECT a.r, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r
), o AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM m
)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 10
"""

OP8_SQL = r"""
WITH d AS (
    SELECT doc_id, source,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || coalesce(text, '')), 1, 15))::BIGINT AS h
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
    FROM d GROUP BY source
), r AS (
    SELECT *, 2 * source_size AS lim, 2 * source_size / w AS ratio FROM s
), l AS (
    SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT
               - coalesce(sum(lim) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
              / (sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
    FROM r
), t AS (
    SELECT source, source_size,
           least(lim::DOUBLE, w * (SELECT max(level) FROM l WHERE level <= ratio)) AS target
    FROM l
), b AS (
    SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS rounds FROM t
), g AS (
    SELECT source, h, sum(size)::BIGINT AS words FROM d GROUP BY source, h
), c AS (
    SELECT source, h, words,
           sum(words) OVER (PARTITION BY source ORDER BY h) - words AS before
    FROM g
)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (d.size * least(2, b.rounds + CASE WHEN 2 * c.before + c.words < 2 * (b.target - b.rounds * b.source_size)
                                          THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d
JOIN b ON d.source IS NOT DISTINCT FROM b.source
JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""

# Sets as lists of distinct shingles; links by joining on shingles; components by spreading the smallest id.
OP9_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_transform(
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'),
               lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS t
    FROM documents
), s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(t) = 0 THEN [] WHEN len(t) = 1 THEN [t[1]]
           ELSE list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]) END) AS v
    FROM w
), e AS (
    SELECT doc_id, len(v) AS n, unnest(v) AS g FROM s
), p AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r AS (
    SELECT doc_id AS x, doc_id AS root FROM documents
    UNION
    SELECT p.y, r.root FROM r JOIN p ON r.x = p.x
), c AS (
    SELECT x, min(root) AS root FROM r GROUP BY x
)
SELECT s.doc_id, len(s.v) AS n_shingles, c.root AS component_id, s.doc_id = c.root AS kept
FROM s JOIN c ON s.doc_id = c.x
"""

# The rounds in a chain of subqueries; sums and squares of integers are exact.
_KEPT = """
WITH k AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
), c0 AS (
    SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, 'null')), v) - 1 AS c, v
    FROM k QUALIFY c < 16
)"""
_NEAREST = """, a{n} AS (
    SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
        SELECT k.r, m.c, list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
        FROM k, c{n} m
    ) GROUP BY r
)"""
_MOVED = """, c{m} AS (
    SELECT o.c, coalesce(f.v, o.v) AS v
    FROM c{n} o LEFT JOIN (
        SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v
        FROM (SELECT a.c, i, sum(k.v[i]) AS s, count(*) AS n
              FROM a{n} a JOIN k USING (r), range(1, 65) t(i) GROUP BY a.c, i)
        GROUP BY c
    ) f USING (c)
)"""
OP11_SQL = (
    _KEPT + "".join(_NEAREST.format(n=n) + _MOVED.format(n=n, m=n + 1) for n in range(3)) + _NEAREST.format(n=3) + """
SELECT k.vec_id, a.c::INT AS cluster, a.d AS distance,
       (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a3 a JOIN k USING (r) JOIN c3 m ON m.c = a.c
"""
)

# Runs hold grams of eight words that recur a period later: pairs of equal grams, then stretches of neighbouring pairs.
# CRC-32 goes bit by bit over the digits of the id.
OP12_SQL = r"""
WITH w0 AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
               lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)),
                   lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) AS h
    FROM documents
), w1 AS (
    SELECT r, doc_id, w, len(w) AS n, h, h // 10 AS g FROM w0
), w2 AS (
    SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM w1 WHERE h % 10 = 0 AND n > 0
), t AS (
    SELECT r, doc_id, w FROM w1 WHERE h % 10 <> 0 OR n = 0
    UNION ALL
    SELECT r, doc_id, list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) FROM w2
), e AS (
    SELECT r, unnest(range(len(w))) AS i, unnest(w) AS x FROM t
), g8 AS (
    SELECT r, unnest(range(len(w) - 7)) AS i, unnest(list_transform(range(len(w) - 7), lambda i: array_to_string(w[i + 1:i + 8], ' '))) AS x
    FROM t WHERE len(w) >= 24
), pairs AS (
    SELECT a.r, b.i - a.i AS q, a.i FROM g8 a JOIN g8 b ON a.r = b.r AND a.x = b.x AND a.i < b.i
), isles AS (
    SELECT r, q, min(i) AS s, max(i) - min(i) + 8 + q AS l
    FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS z FROM pairs)
    GROUP BY r, q, z HAVING max(i) - min(i) + 8 + q >= greatest(24, 3 * q)
), runs AS (
    SELECT r, s, l, min(q) AS q FROM isles GROUP BY r, s, l
), facts AS (
    SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
           first({'s': s, 'l': l, 'q': q} ORDER BY l::DOUBLE / q DESC, s, q) AS best
    FROM runs GROUP BY r
), gone AS (
    SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs
), rest AS (
    SELECT r, string_agg(x, ' ' ORDER BY i) AS text FROM e ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period,
       1000 * best.l // best.q AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(rest.text, '')) AS collapsed_sha256
FROM t LEFT JOIN facts USING (r) LEFT JOIN rest USING (r)
"""

# Bytes as pairs of hexadecimal digits; every string of 50 bytes with the smallest id that has it.
OP13_SQL = """
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(doc_id, -9223372036854775808) AS k, doc_id,
           hex(encode(coalesce(text, ''))) AS x FROM documents
), b AS (
    SELECT r, k, unnest(range(len(x) // 2)) AS i,
           unnest(list_transform(range(len(x) // 2), lambda i: substr(x, 2 * i + 1, 100))) AS s
    FROM d
), f AS (
    SELECT r, i, s[1:2] AS c, len(s) = 100 AND k > min(k) OVER (PARTITION BY s) AS hit FROM b
), m AS (
    SELECT r, i, c, coalesce(max(CASE WHEN hit THEN i END)
               OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), -1) >= 0 AS gone
    FROM f
), n AS (
    SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS opens FROM m
), s AS (
    SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
           string_agg(c, '' ORDER BY i) FILTER (NOT gone) AS kept
    FROM n GROUP BY r
)
SELECT d.doc_id, len(d.x) // 2 AS n_bytes, coalesce(s.n_removed, 0) AS n_removed, coalesce(s.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(s.kept, ''))) AS kept_sha256
FROM d LEFT JOIN s ON d.r = s.r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_capture_index": op1_capture_index,
    "op2_block_naming": op2_block_naming,
    "op3_tree_packing": op3_tree_packing,
    "op4_gru_toxicity": op4_gru_toxicity,
    "op5_ball_tree": op5_ball_tree,
    "op6_histogram_sort": op6_histogram_sort,
    "op7_context_trees": op7_context_trees,
    "op8_hash_mix": op8_hash_mix,
    "op9_bottom_k": op9_bottom_k,
    "op10_line_templates": op10_line_templates,
    "op11_bisectors": op11_bisectors,
    "op12_word_runs": op12_word_runs,
    "op13_bucket_pointers": op13_bucket_pointers,
}

SQL: dict[str, str] = {
    "op1_capture_index": OP1_SQL,
    "op2_block_naming": OP2_SQL,
    "op5_ball_tree": OP5_SQL,
    "op8_hash_mix": OP8_SQL,
    "op9_bottom_k": OP9_SQL,
    "op11_bisectors": OP11_SQL,
    "op12_word_runs": OP12_SQL,
    "op13_bucket_pointers": OP13_SQL,
}
