"""Checks: key ranges, segments, checksums."""

from __future__ import annotations

from pyspark.sql import functions as F

from recon.functions import checksum as cs
from recon.operators import segments as sg
from recon.operators.hashdiff import common_scales, compare_segments
from recon.operators.splitters import rows_segmenter
from recon.sources.side import side
from recon.suite.inputs import LINES_A, NULLKEYS_A, ORDERS_A, ORDERS_B, TURNS_A, TURNS_B, derive, sql, table
from recon.suite.matching import sides
from recon.suite.registry import check

MD5_NUMBER = "('0x' || substr(md5({t}), 21, 12))::BIGINT - 140737488355327"
ORDER_TEXT = "concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_totalprice AS VARCHAR), coalesce(o_orderstatus, '<null>'))"
PAIR = f"WITH a AS ({sql(ORDERS_A, 'orders')}), b AS ({sql(ORDERS_B, 'orders')})"
RANGE = f"""{PAIR}, u AS (SELECT 'a' AS side, o_orderkey AS k, {ORDER_TEXT} AS t FROM a
  UNION ALL SELECT 'b', o_orderkey, {ORDER_TEXT} FROM b),
  r AS (SELECT min(k) AS lo, max(k) + 1 AS hi FROM u)"""


@check(
    "C1_key_range",
    """SELECT min(conv_id) AS min_conv_id, max(conv_id) AS max_conv_id, min(turn) AS min_turn, max(turn) AS max_turn FROM conversations""",
)
def key_range(spark, sf):
    return sg.key_range(side(table(spark, sf, "conversations"), ("conv_id", "turn"), []))


@check(
    "C2_checkpoints",
    """WITH r AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) + 1 AS hi FROM orders), w AS (SELECT lo, hi, (hi - lo + 1) // 32 AS w FROM r),
    p AS (SELECT i, lo + i * w AS split FROM w, range(1, 32) t(i) WHERE lo + i * w < hi)
    SELECT i AS place, split, (SELECT count(*) FROM orders WHERE o_orderkey < split) AS rows_below FROM p""",
)
def checkpoints(spark, sf):
    s = side(table(spark, sf, "orders"), "o_orderkey", [])
    (lo, hi), *_ = sg.key_bounds(s)
    points = sg.checkpoints(lo, hi + 1, 31)
    below = s.rows().agg(*[F.count_if(F.col("o_orderkey") < p).alias(f"n{i}") for i, p in enumerate(points, start=1)])
    items = [
        F.struct(F.lit(i).cast("bigint").alias("place"), F.lit(p).cast("bigint").alias("split"), F.col(f"n{i}").alias("rows_below"))
        for i, p in enumerate(points, start=1)
    ]
    return below.select(F.explode(F.array(*items)).alias("p")).select("p.*")


@check(
    "C2_quantile_checkpoints",
    f"""{PAIR}, u AS (SELECT o_orderkey AS k FROM a UNION ALL SELECT o_orderkey FROM b),
    m AS (SELECT greatest(1, count(*) // (32 * 64)) AS m FROM u),
    s AS (SELECT k, count(*) AS n FROM u, m WHERE ('0x' || substr(md5(CAST(k AS VARCHAR)), 21, 12))::BIGINT % m = 0 GROUP BY k),
    c AS (SELECT k, sum(n) OVER (ORDER BY k) AS seen, sum(n) OVER () AS total FROM s),
    p AS (SELECT DISTINCT min(k) AS split FROM c, range(1, 32) t(i) WHERE seen * 32 > i * total GROUP BY i)
    SELECT row_number() OVER (ORDER BY split) AS place, split, (SELECT count(*) FROM u WHERE k < split) AS rows_below FROM p""",
)
def quantile_checkpoints(spark, sf):
    """Cut points of equal rows, and the rows of both sides below them."""
    a, b = sides(spark, sf)
    seg = rows_segmenter(a, b, 32)
    rows = a.rows().select("o_orderkey").unionByName(b.rows().select("o_orderkey"))
    below = rows.agg(*[F.count_if(F.col("o_orderkey") < c).alias(f"n{i}") for i, (c,) in enumerate(seg.cuts, start=1)])
    items = [
        F.struct(F.lit(i).cast("bigint").alias("place"), F.lit(c).cast("bigint").alias("split"), F.col(f"n{i}").alias("rows_below"))
        for i, (c,) in enumerate(seg.cuts, start=1)
    ]
    return below.select(F.explode(F.array(*items)).alias("p")).select("p.*")


@check(
    "C3_segment_of_row",
    RANGE
    + """, w AS (SELECT lo, hi, (hi - lo + 1) // 32 AS w FROM r)
    SELECT k AS o_orderkey, greatest(0, least((k - lo) // w, 31)) AS segment_id FROM u, w WHERE side = 'a'""",
)
def segment_of_row(spark, sf):
    a, b = sides(spark, sf)
    seg = sg.make_segmenter(a, b, 32)
    return a.rows().select("o_orderkey", seg.segment([F.col("o_orderkey")], []).alias("segment_id"))


@check(
    "C3_mesh_cell",
    f"""WITH a AS ({sql(TURNS_A, 'conversations')}), b AS ({sql(TURNS_B, 'conversations')}),
    u AS (SELECT conv_id, turn FROM a UNION ALL SELECT conv_id, turn FROM b),
    r AS (SELECT min(conv_id) l1, max(conv_id) + 1 h1, min(turn) l2, max(turn) + 1 h2 FROM u),
    c AS (SELECT *, CASE WHEN 3 >= h2 - l2 THEN 1 ELSE 3 END AS n2 FROM r),
    w AS (SELECT *, (h1 - l1 + 1) // 4 AS w1, (h2 - l2 + 1) // (n2 + 1) AS w2 FROM c)
    SELECT conv_id, turn, greatest(0, least((conv_id - l1) // w1, 3)) * (n2 + 1) + greatest(0, least((turn - l2) // w2, n2)) AS segment_id
    FROM a, w""",
)
def mesh_cell(spark, sf):
    keys = ("conv_id", "turn")
    a = side(derive(spark, sf, "conversations", TURNS_A), keys, [])
    b = side(derive(spark, sf, "conversations", TURNS_B), keys, [])
    seg = sg.make_segmenter(a, b, 16)
    return a.rows().select(*keys, seg.segment([F.col(k) for k in keys], []).alias("segment_id"))


@check(
    "C3_text_bucket",
    "SELECT c_name, ('0x' || substr(md5(c_name), 21, 12))::BIGINT % 64 AS segment_id FROM customer",
)
def text_bucket(spark, sf):
    s = side(table(spark, sf, "customer"), "c_name", [])
    seg = sg.make_segmenter(s, s, 64)
    return s.rows().select("c_name", seg.segment([F.col("c_name")], [s.text("c_name")]).alias("segment_id"))


@check(
    "C4_table_checksum",
    f"""{PAIR} SELECT 'a' AS side, count(*) AS n_rows, CAST(sum({MD5_NUMBER.format(t=ORDER_TEXT)}) AS VARCHAR) AS checksum FROM a
    UNION ALL SELECT 'b', count(*), CAST(sum({MD5_NUMBER.format(t=ORDER_TEXT)}) AS VARCHAR) FROM b
    UNION ALL SELECT 'none', 0, NULL""",
)
def table_checksum(spark, sf):
    a, b = sides(spark, sf)
    none = side(a.df, "o_orderkey", ["o_totalprice", "o_orderstatus"], where="o_orderkey < 0")
    frames = [
        sg.table_checksum(s).select(F.lit(tag).alias("side"), "n_rows", F.col("checksum").cast("string").alias("checksum"))
        for s, tag in ((a, "a"), (b, "b"), (none, "none"))
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@check(
    "C5_segment_checksums",
    RANGE
    + f""", w AS (SELECT lo, hi, (hi - lo + 1) // 64 AS w FROM r),
    s AS (SELECT side, greatest(0, least((k - lo) // w, 63)) AS segment_id, {MD5_NUMBER.format(t='t')} AS n FROM u, w),
    g AS (SELECT segment_id, count(*) FILTER (WHERE side = 'a') AS rows_a, count(*) FILTER (WHERE side = 'b') AS rows_b,
      CAST(sum(n) FILTER (WHERE side = 'a') AS VARCHAR) AS checksum_a, CAST(sum(n) FILTER (WHERE side = 'b') AS VARCHAR) AS checksum_b
      FROM s GROUP BY segment_id)
    SELECT *, checksum_a IS DISTINCT FROM checksum_b OR rows_a <> rows_b AS is_diff FROM g""",
)
def segment_checksums(spark, sf):
    a, b = sides(spark, sf)
    out = compare_segments(a, b, sg.make_segmenter(a, b, 64))
    return out.withColumns({c: F.col(c).cast("string") for c in ("checksum_a", "checksum_b")})


@check("C6_common_range", RANGE + "SELECT lo, hi FROM r")
def common_range(spark, sf):
    a, b = sides(spark, sf)
    ranges = sg.key_range(a).unionByName(sg.key_range(b))
    return ranges.agg(F.min("min_o_orderkey").alias("lo"), (F.max("max_o_orderkey") + 1).alias("hi"))


@check(
    "C7_space_size",
    "SELECT (max(conv_id) + 1 - min(conv_id)) * (max(turn) + 1 - min(turn)) AS space_size FROM conversations",
)
def space_size(spark, sf):
    r = sg.key_range(side(table(spark, sf, "conversations"), ("conv_id", "turn"), []))
    width = lambda k: F.col(f"max_{k}") + 1 - F.col(f"min_{k}")
    return r.select((width("conv_id") * width("turn")).alias("space_size"))


NULL_TEXT_SQL = "concat_ws('|', coalesce(CAST(c_custkey AS VARCHAR), '<null>'), c_name, c_mktsegment)"


@check("C8_row_text", f"WITH a AS ({sql(NULLKEYS_A, 'customer')}) SELECT {NULL_TEXT_SQL} AS row_text FROM a")
def row_text(spark, sf):
    s = side(derive(spark, sf, "customer", NULLKEYS_A), "c_custkey")
    return s.rows().select(cs.row_text([s.text(c) for c in s.columns]).alias("row_text"))


@check(
    "C9_digest_text",
    f"""WITH a AS ({sql(NULLKEYS_A, 'customer')})
    SELECT concat(md5(coalesce(CAST(c_custkey AS VARCHAR), '<null>')), md5(c_name), md5(c_mktsegment)) AS digest FROM a""",
)
def digest_text(spark, sf):
    s = side(derive(spark, sf, "customer", NULLKEYS_A), "c_custkey")
    return s.rows().select(cs.row_digest_text([s.text(c) for c in s.columns]).alias("digest"))


@check("C10_md5", "SELECT doc_id, md5(text) AS digest FROM documents")
def md5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cs.md5_hex(F.col("text")).alias("digest"))


UUID_SQL = "concat(substr(md5(c_name), 1, 8), '-', substr(md5(c_name), 9, 4), '-', substr(md5(c_name), 13, 4), '-', substr(md5(c_name), 17, 4), '-', substr(md5(c_name), 21, 12))"


@check(
    "C11_uuid_segment",
    f"SELECT {UUID_SQL} AS id, CAST(floor(('0x' || substr(md5(c_name), 1, 8))::BIGINT * 32 / 4294967296) AS BIGINT) AS segment_id FROM customer",
)
def uuid_segment(spark, sf):
    u = spark.sql(f"SELECT {UUID_SQL} AS id FROM {{t}}", t=table(spark, sf, "customer"))
    return u.select("id", sg.uuid_segment(F.col("id"), 32).alias("segment_id"))


@check(
    "C12_text_key_order",
    """WITH k AS (SELECT DISTINCT regexp_replace(url, '[^ \\-0-9A-Z_a-z]', '', 'g') AS id FROM pages)
    SELECT id, row_number() OVER (ORDER BY id COLLATE C) AS place FROM k""",
)
def text_key_order(spark, sf):
    from recon.operators.sampling import numbered

    ids = table(spark, sf, "pages").select(F.regexp_replace("url", r"[^ \-0-9A-Z_a-z]", "").alias("id"))
    return numbered(ids.distinct(), ["id"]).select("id", F.col("__place").alias("place"))


@check(
    "C15_common_scale",
    f"""WITH a AS ({sql(ORDERS_A, 'orders')}) SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR) AS as_common,
      CAST(CAST(o_totalprice AS DECIMAL(20,4)) AS VARCHAR) AS as_finer FROM a""",
)
def common_scale(spark, sf):
    coarse = side(derive(spark, sf, "orders", ORDERS_A), "o_orderkey", ["o_totalprice"])
    fine = side(coarse.df.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(20,4)")), "o_orderkey", ["o_totalprice"])
    scales, _ = common_scales(coarse, fine)
    return fine.rows().select(
        "o_orderkey",
        fine.text("o_totalprice", scale=scales["o_totalprice"]).alias("as_common"),
        fine.text("o_totalprice").alias("as_finer"),
    )
