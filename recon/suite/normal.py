"""Checks: normal forms and tolerant comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from recon.functions import normalize as nz
from recon.functions import predicates as pr
from recon.functions.predicates import CompareRules
from recon.operators.joindiff import compare_by_key
from recon.suite.differences import EVENT_PAIR, event_sides
from recon.suite.inputs import EVENTS_B, derive, sql, table
from recon.suite.registry import check


@check(
    "N1_number_text",
    """SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(38,2)) AS VARCHAR) AS two, CAST(CAST(o_custkey AS DECIMAL(38,0)) AS VARCHAR) AS whole,
    CAST(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DECIMAL(38,5)) AS VARCHAR) AS five FROM orders""",
)
def number_text(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        nz.number_text(price, 2).alias("two"),
        nz.number_text(F.col("o_custkey"), 0).alias("whole"),
        nz.number_text(price.cast("decimal(12,2)"), 5).alias("five"),
    )


STAMP = "strftime(make_timestamp({m}), '%Y-%m-%d %H:%M:%S.%f')"
US = "epoch_us(ts)"


@check(
    "N2_timestamp_text",
    f"""SELECT event_id, {STAMP.format(m=US)} AS six, {STAMP.format(m=f'{US} - {US} % 1000')} AS cut3,
    {STAMP.format(m=f'({US} + 500) - ({US} + 500) % 1000')} AS round3, {STAMP.format(m=f'{US} - {US} % 1000000')} AS cut0,
    {STAMP.format(m=f'({US} + 500000) - ({US} + 500000) % 1000000')} AS round0 FROM events""",
)
def timestamp_text(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id",
        nz.timestamp_text(ts).alias("six"),
        nz.timestamp_text(ts, 3).alias("cut3"),
        nz.timestamp_text(ts, 3, rounds=True).alias("round3"),
        nz.timestamp_text(ts, 0).alias("cut0"),
        nz.timestamp_text(ts, 0, rounds=True).alias("round0"),
    )


@check(
    "N3_date_time_text",
    "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S.%f') AS time_of_day FROM events",
)
def date_time_text(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", nz.date_text(ts.cast("date")).alias("day"), nz.time_of_day_text(ts).alias("time_of_day")
    )


@check("N4_boolean_text", "SELECT doc_id, CASE WHEN quality = 1 THEN '1' ELSE '0' END AS good FROM labels")
def boolean_text(spark, sf):
    return table(spark, sf, "labels").select("doc_id", nz.boolean_text(F.col("quality") == 1).alias("good"))


@check("N5_uuid_text", "SELECT doc_id, lower(md5(text)) AS id FROM documents")
def uuid_text(spark, sf):
    raw = F.concat(F.lit(" "), F.upper(F.md5("text")), F.lit("  "))
    return table(spark, sf, "documents").select("doc_id", nz.uuid_text(raw).alias("id"))


@check(
    "N6_json_text",
    f"WITH b AS ({sql(EVENTS_B, 'events')}) SELECT event_id, replace(props, ': ', ':') AS props FROM b",
)
def json_text(spark, sf):
    return derive(spark, sf, "events", EVENTS_B).select("event_id", nz.json_text(F.col("props")).alias("props"))


@check(
    "N7_nested_text",
    """SELECT vec_id, concat('[', array_to_string(list_transform(embedding,
      lambda x: CAST(CAST(CAST(x AS DOUBLE) AS DECIMAL(9,2)) AS VARCHAR)), ','), ']') AS embedding FROM embeddings""",
)
def nested_text(spark, sf):
    """Arrays as text; two decimals, since engines print floats differently."""
    short = F.transform("embedding", lambda x: x.cast("double").cast("decimal(9,2)"))
    return table(spark, sf, "embeddings").select("vec_id", nz.nested_text(short).alias("embedding"))


@check(
    "N7_nested_json",
    """SELECT o_orderkey, CAST(json_array(o_orderkey, o_custkey) AS VARCHAR) AS pair,
      CAST(json_object('status', o_orderstatus, 'keys', json_array(o_orderkey, o_custkey)) AS VARCHAR) AS nested FROM orders""",
)
def nested_json(spark, sf):
    pair = F.array("o_orderkey", "o_custkey")
    nested = F.struct(F.col("o_orderstatus").alias("status"), pair.alias("keys"))
    return table(spark, sf, "orders").select(
        "o_orderkey", nz.nested_text(pair).alias("pair"), nz.nested_text(nested).alias("nested")
    )


@check(
    "N8_by_type",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, CAST(user_id AS VARCHAR) AS user_id,
    event_type, CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS value, replace(props, ': ', ':') AS props FROM events""",
)
def by_type(spark, sf):
    t = table(spark, sf, "events").withColumn("value", F.col("value").cast("decimal(12,2)"))
    forms = {"props": "json"}
    return t.select(*[nz.normalize(F.col(f.name), f.dataType, form=forms.get(f.name)).alias(f.name) for f in t.schema.fields])


def differing(spark, sf, column, rules):
    """Keys present on both sides whose value differs under the rules."""
    c = compare_by_key(*event_sides(spark, sf, [column]), rules=rules)
    return c.matched.where(c.changed()).select(F.col("a0").alias("event_id"))


MATCH = EVENT_PAIR + "SELECT a.event_id FROM a JOIN b ON a.event_id = b.event_id WHERE "


@check(
    "T1_float_tolerance",
    MATCH + "CASE WHEN a.value IS NULL OR b.value IS NULL THEN a.value IS DISTINCT FROM b.value ELSE abs(a.value - b.value) > 0.05 END",
)
def float_tolerance(spark, sf):
    return differing(spark, sf, "value", CompareRules(float_tolerance=0.05))


@check(
    "T2_tolerance_digits",
    """SELECT o_orderkey, round(CAST(o_totalprice AS DECIMAL(12,2)), 1) AS rounded FROM orders""",
)
def tolerance_digits(spark, sf):
    price = F.col("o_totalprice").cast("decimal(12,2)")
    return table(spark, sf, "orders").select(
        "o_orderkey", pr.round_to_tolerance(price, 1.0).alias("rounded")
    )


for level, step in pr.PRECISION_MICROS.items():
    cut = "epoch_us({s}.ts) - epoch_us({s}.ts) % {n}"

    @check(
        f"T3_precision_{level}",
        MATCH + f"{cut.format(s='a', n=step)} <> {cut.format(s='b', n=step)}",
    )
    def precision(spark, sf, level=level):
        return differing(spark, sf, "ts", CompareRules(timestamp_precision=level))


@check("T5_json_exact", MATCH + "a.props IS DISTINCT FROM b.props")
def json_exact(spark, sf):
    return differing(spark, sf, "props", CompareRules(json_mode="exact", json_columns=frozenset({"props"})))


@check("T6_json_normalized", MATCH + "replace(a.props, ': ', ':') IS DISTINCT FROM replace(b.props, ': ', ':')")
def json_normalized(spark, sf):
    return differing(spark, sf, "props", CompareRules(json_mode="normalized", json_columns=frozenset({"props"})))


@check(
    "T7_json_semantic",
    "SELECT a.event_id FROM events a WHERE a.event_id % 43 = 0",
)
def json_semantic(spark, sf):
    """Key order and blanks change on every row, the value only where the key is a multiple of 43."""
    n = "CAST(user_id AS STRING)"
    a = spark.sql(f"SELECT event_id, concat('{{{{\"a\":', {n}, ',\"b\":[1,', {n}, ']}}}}') AS doc FROM {{t}}", t=table(spark, sf, "events"))
    b = spark.sql(
        f"SELECT event_id, concat('{{{{ \"b\": [1, ', {n}, '], \"a\" : ', "
        f"CASE WHEN event_id % 43 = 0 THEN '-1' ELSE {n} END, '}}}}') AS doc FROM {{t}}",
        t=table(spark, sf, "events"),
    )
    from recon.sources.side import side

    rules = CompareRules(json_mode="semantic", json_columns=frozenset({"doc"}))
    c = compare_by_key(side(a, "event_id"), side(b, "event_id"), rules=rules)
    return c.matched.where(c.changed()).select(F.col("a0").alias("event_id"))


@check("T8_json_keys", MATCH + "list_sort(json_keys(a.props)) IS DISTINCT FROM list_sort(json_keys(b.props))")
def json_keys(spark, sf):
    return differing(spark, sf, "props", CompareRules(json_mode="keys_only", json_columns=frozenset({"props"})))


@check("T9_ignore_case", MATCH + "lower(a.event_type) IS DISTINCT FROM lower(b.event_type)")
def ignore_case(spark, sf):
    return differing(spark, sf, "event_type", CompareRules(ignore_case=True))


@check("T9_ignore_blanks", MATCH + "trim(a.event_type) IS DISTINCT FROM trim(b.event_type)")
def ignore_blanks(spark, sf):
    return differing(spark, sf, "event_type", CompareRules(ignore_blanks=True))


@check("T9_ignore_both", MATCH + "lower(trim(a.event_type)) IS DISTINCT FROM lower(trim(b.event_type))")
def ignore_both(spark, sf):
    return differing(spark, sf, "event_type", CompareRules(ignore_case=True, ignore_blanks=True))
