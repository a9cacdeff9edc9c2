"""Reading, parsing, encoding, quality checks, set operations and writing."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from raceframe.functions import columns as C
from raceframe.functions import constants as K
from raceframe.operators import pedigree, quality
from raceframe.plans.base import ENTRIES, entries, r6, stored, table
from raceframe.plans.registry import query
from raceframe.session import work_dir
from raceframe.sources import odds as odds_source
from raceframe.sources import reports, tables, upsert

KEY = ["event", "entity"]


def round_doubles(df):
    return df.select(*[r6(n).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


# --- scans and sources --------------------------------------------------------------------


def _raw(spark, sf_dir):
    """Results and races in the reference table layout."""
    df = entries(spark, sf_dir)
    results = df.select(
        F.col("event").alias("race_id"), F.col("entity").alias("horse_id"), F.col("actor").alias("jockey_id"),
        F.col("owner").alias("trainer_id"), F.when(F.col("tax") != 7, F.col("outcome")).alias("finish_order"),
        F.when(F.col("tax") == 7, "中").otherwise("正常").alias("finish_status"), F.col("last3f").alias("last_3f"),
        F.col("weight").alias("body_weight"), F.col("tax").alias("body_weight_diff"), F.col("prize").alias("prize_money"),
        F.col("odds").alias("win_odds"), "popularity", F.col("post").alias("horse_no"),
    )
    fmt = F.col("event") % 4
    d = F.col("event_date")
    text = (
        F.when(fmt == 0, F.date_format(d, "yyyy-MM-dd")).when(fmt == 1, F.date_format(d, "yyyy/MM/dd"))
        .when(fmt == 2, F.date_format(d, "yyyyMMdd")).otherwise("n/a")
    )
    races = df.select(
        F.col("event").alias("race_id"), text.alias("date"), "place", F.col("surface").alias("course_type"),
        F.col("going").alias("track_condition"), "distance", "race_class", F.lit("G2").alias("grade"),
        F.when(F.col("event") % 3 == 0, None).otherwise((F.col("field_size") + 1)).alias("head_count"),
    ).distinct()
    return results, races


@query("results_loaded", "S2 P1 P5 P6 P7 J1",
       ENTRIES + """SELECT event, entity, outcome, event_date, CASE WHEN event % 3 = 0 THEN field_size ELSE field_size + 1 END AS field_size,
 CASE WHEN distance < 1100 THEN 1000 WHEN distance < 1300 THEN 1200 WHEN distance < 1500 THEN 1400 WHEN distance < 1700 THEN 1600 WHEN distance < 1900 THEN 1800 WHEN distance < 2100 THEN 2000 WHEN distance < 2300 THEN 2200 WHEN distance < 2500 THEN 2400 WHEN distance < 2700 THEN 2500 ELSE 3000 END AS dist_cat,
 CASE place WHEN '東京' THEN 4 WHEN '中山' THEN 5 WHEN '京都' THEN 7 WHEN '阪神' THEN 8 WHEN '小倉' THEN 9 END AS place_id, CASE surface WHEN '芝' THEN 0 WHEN 'ダ' THEN 1 ELSE 2 END AS surface_id,
 CASE going WHEN '良' THEN 0 WHEN '稍重' THEN 1 WHEN '重' THEN 2 WHEN '不良' THEN 3 END AS going_id, 1 AS grade_id,
 CASE race_class WHEN 'G1' THEN 0 WHEN 'GII' THEN 1 WHEN 'G3' THEN 2 WHEN 'オープン' THEN 3 WHEN '3勝クラス' THEN 4 WHEN '2勝クラス' THEN 5 WHEN '1勝クラス' THEN 6 WHEN '未勝利' THEN 7 ELSE 8 END AS class_id
FROM entries WHERE event % 4 <> 3 AND tax <> 7""")
def results_loaded(spark, sf_dir):
    out = tables.load_results(*_raw(spark, sf_dir))
    return out.select(*KEY, "outcome", "event_date", "field_size", "dist_cat", "place_id", "surface_id", "going_id", "grade_id", "class_id")


@query("conformed_results", "S3",
       "SELECT CAST(o_orderkey AS VARCHAR) AS race_id, NULL::VARCHAR AS date, o_orderpriority AS place, NULL::INTEGER AS distance, CAST(round(o_totalprice) AS INTEGER) AS head_count FROM orders")
def conformed_results(spark, sf_dir):
    src = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("race_id"), F.col("o_orderpriority").alias("place"), F.round("o_totalprice").alias("head_count")
    )
    return tables.conform(src, tables.schema_of("races")).select("race_id", "date", "place", "distance", "head_count")


@query("features_in_range", "S4 P15",
       ENTRIES + "SELECT event, entity, event_date, CAST(outcome = 1 AS INTEGER) AS win, CAST(outcome <= 2 AS INTEGER) AS top2, CAST(outcome <= 3 AS INTEGER) AS in3, CAST(outcome <= 3 AND odds >= 10 AS INTEGER) AS value_label FROM entries WHERE event_date BETWEEN DATE '1997-03-01' AND DATE '1998-09-30'")
def features_in_range(spark, sf_dir):
    df = entries(spark, sf_dir).withColumns(
        {"win": C.within("outcome", 1), "top2": C.within("outcome", 2), "in3": C.within("outcome", 3), "value_label": C.value_label("outcome", "odds")}
    )
    return tables.load_features(df, "event_date", "1997-03-01", "1998-09-30", [*KEY, "event_date", "win", "top2", "in3", "value_label"], "win")


@query("entries_of_events", "S5",
       ENTRIES + "SELECT event, entity, outcome FROM entries WHERE event IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000)")
def entries_of_events(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_orderkey").alias("event"))
    return tables.load_for_events(entries(spark, sf_dir), keys).select(*KEY, "outcome")


@query("candidates_csv", "S6 S10", "SELECT p_name AS feature, p_retailprice AS gain, p_size AS rank, p_type AS safety_label FROM part")
def candidates_csv(spark, sf_dir):
    path = f"{work_dir(spark)}/candidates-{zlib.crc32(sf_dir.encode()):08x}"
    src = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("feature"), F.col("p_retailprice").alias("gain"), F.col("p_size").alias("rank"), F.col("p_type").alias("safety_label")
    )
    reports.save_report(src, path, "csv")
    return tables.read_csv(spark, path, "feature string, gain double, rank int, safety_label string")


@query("report_json", "S10", "SELECT p_brand AS brand, count(*) AS n, round(avg(p_retailprice),6) AS price FROM part GROUP BY 1")
def report_json(spark, sf_dir):
    path = f"{work_dir(spark)}/report-{zlib.crc32(sf_dir.encode()):08x}"
    src = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p_retailprice")).alias("price"))
    reports.save_report(src, path, "json")
    return spark.read.schema("brand string, n bigint, price double").json(path)


_PAYLOAD = """WITH x AS (SELECT o_orderkey AS event, o_orderdate AS observed_at, o_orderkey % 3 AS layout,
  [CAST(1 + o_custkey % 7 AS VARCHAR) || '.5', '1,' || CAST(200 + o_custkey % 50 AS VARCHAR) || '.25', CAST(1 + o_orderkey % 7 AS VARCHAR) || '.5', '0.5'] AS o,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(1 + o_custkey % 3 AS INTEGER) END AS given FROM orders),
l AS (SELECT event, observed_at, given, i AS horse_no, CAST(replace(o[i],',','') AS DOUBLE) AS win_odds FROM x, range(1,5) t(i))
SELECT event, observed_at, CAST(horse_no AS INTEGER) AS horse_no, win_odds, CAST(CASE WHEN horse_no = 1 AND given IS NOT NULL THEN given ELSE rank() OVER (PARTITION BY event ORDER BY win_odds) END AS INTEGER) AS popularity
FROM l WHERE win_odds BETWEEN 1.0 AND 9999.0"""


@query("odds_payloads", "S7", _PAYLOAD)
def odds_payloads(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    values = [
        F.concat((1 + F.col("o_custkey") % 7).cast("string"), F.lit(".5")),
        F.concat(F.lit("1,"), (200 + F.col("o_custkey") % 50).cast("string"), F.lit(".25")),
        F.concat((1 + F.col("o_orderkey") % 7).cast("string"), F.lit(".5")), F.lit("0.5"),
    ]
    popular = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(',"popular":"'), (1 + F.col("o_custkey") % 3).cast("string"), F.lit('"'))).otherwise("")
    parts = [F.concat(F.lit(f'"{i}":{{"odds":"'), v, F.lit('"'), popular if i == 1 else F.lit(""), F.lit("}")) for i, v in enumerate(values, 1)]
    body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    layout = F.col("o_orderkey") % 3
    text = (
        F.when(layout == 0, F.concat(F.lit('{"data":{"odds":'), body, F.lit("}}")))
        .when(layout == 1, F.concat(F.lit('{"data":'), body, F.lit("}"))).otherwise(F.concat(F.lit('{"odds":'), body, F.lit("}")))
    )
    src = o.select(F.col("o_orderkey").alias("event"), F.col("o_orderdate").alias("observed_at"), text.alias("payload"))
    return odds_source.parse_odds_json(src, "payload")


_UP = """WITH t AS (SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal, s_nationkey AS nation FROM supplier),
n AS (SELECT k, nullif(name,'x') AS name, bal FROM (SELECT c_custkey * 3 AS k, CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE c_name END AS name, c_acctbal AS bal FROM customer))
"""


@query("upsert_replace", "S8", _UP + "SELECT coalesce(t.k,n.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.name ELSE t.name END AS name, CASE WHEN n.k IS NOT NULL THEN n.bal ELSE t.bal END AS bal, t.nation FROM t FULL JOIN n ON t.k = n.k")
def upsert_replace(spark, sf_dir):
    return upsert.upsert(*_upsert_sides(spark, sf_dir), ["k"])


@query("upsert_skip_null", "S8", _UP + "SELECT coalesce(t.k,n.k) AS k, coalesce(n.name,t.name) AS name, coalesce(CASE WHEN t.k IS NOT NULL THEN t.bal ELSE n.bal END) AS bal, t.nation FROM t FULL JOIN n ON t.k = n.k")
def upsert_skip_null(spark, sf_dir):
    target, src = _upsert_sides(spark, sf_dir)
    return upsert.upsert(target, src, ["k"], skip_null=True, keep=["bal"])


def _upsert_sides(spark, sf_dir):
    target = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("nation")
    )
    src = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") * 3).alias("k"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("name"), F.col("c_acctbal").alias("bal")
    )
    return target, src


@query("last_per_key", "S8 A6 W25", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def last_per_key(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return upsert.last_per_key(ev, ["user_id", "event_type"], ["event_id"])


@query("created_table", "S9", "SELECT p_partkey, p_brand, p_size FROM part")
def created_table(spark, sf_dir):
    path = f"{work_dir(spark)}/part-table-{zlib.crc32(sf_dir.encode()):08x}"
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    upsert.create_table(part, path, ["p_partkey"], "replace", ["p_brand"])
    return spark.read.parquet(path).select("p_partkey", F.col("p_brand").cast("string").alias("p_brand"), "p_size")


@query("event_documents", "S11 T6")
def event_documents(spark, sf_dir):
    df = reports.ranked_entries(entries(spark, sf_dir).withColumn("p", F.round("p", 6)), "p", "field_size")
    return reports.event_documents(df, ["event_date", "place", "distance"], [*KEY[1:], "post", "actor", "owner", "p"], "rank")


@query("event_document_days", "S11", ENTRIES + "SELECT event_date, count(DISTINCT event) AS n_events, count(DISTINCT event) AS n_documents, count(*) AS n_entries FROM entries GROUP BY 1")
def event_document_days(spark, sf_dir):
    df = reports.ranked_entries(entries(spark, sf_dir), "p", "field_size")
    return reports.day_summary(reports.event_documents(df, ["event_date"], ["entity", "p"], "rank"), "event_date")


_LINES = "event_date date, event long, rank long, place string, distance int, entity long, post long, actor long, owner string, p double"


@query("event_document_files", "S11 T6", ENTRIES + """, r AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY round(p, 6) DESC, entity) AS rank FROM entries)
SELECT event_date, event, 0::BIGINT AS rank, place, distance, NULL::BIGINT AS entity, NULL::BIGINT AS post, NULL::BIGINT AS actor, NULL AS owner, NULL::DOUBLE AS p FROM r WHERE rank = 1
UNION ALL SELECT event_date, event, rank, NULL, NULL, entity, post, actor, owner, round(p, 6) FROM r""")
def event_document_files(spark, sf_dir):
    """Every event written as a document in the folder of its date, and parsed back."""
    path = f"{work_dir(spark)}/event-documents-{zlib.crc32(sf_dir.encode()):08x}"
    df = reports.ranked_entries(entries(spark, sf_dir).withColumn("p", F.round("p", 6)), "p", "field_size")
    reports.write_event_documents(df, path, "event_date", ["place", "distance"], ["entity", "post", "actor", "owner", "p"], "rank")
    return reports.read_event_documents(spark, path, StructType.fromDDL(_LINES))


# --- parsing and encoding ------------------------------------------------------------------


@query("dates_normalized", "P1 P2 P3 P4",
       """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS id_date,
 CAST(CASE WHEN o_orderkey % 7 = 0 THEN 9999 ELSE year(o_orderdate) END AS INTEGER) AS id_year, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday FROM orders""")
def dates_normalized(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(d, "yyyy/MM/dd")).when(k % 4 == 2, F.date_format(d, "yyyyMMdd")).otherwise("1999.1.x")
    rid = F.concat(F.when(k % 7 == 0, "99999999").otherwise(F.date_format(d, "yyyyMMdd")), k.cast("string"))
    return o.select(
        "o_orderkey", C.normalize_date(text).alias("date"), C.date_from_event_id(rid).alias("id_date"), C.event_year(rid).alias("id_year"),
        *[c.alias(n) for n, c in C.date_parts(d).items()],
    )


@query("distance_classes", "P6 P7",
       ENTRIES + """SELECT DISTINCT distance, surface, race_class, CASE WHEN surface = '障' THEN CASE WHEN distance < 3000 THEN 9000 WHEN distance < 3500 THEN 9300 ELSE 9600 END
  WHEN distance = 1000 THEN 1000 WHEN distance BETWEEN 1100 AND 1200 THEN 1200 WHEN distance BETWEEN 1300 AND 1400 THEN 1400 WHEN distance BETWEEN 1500 AND 1600 THEN 1600 WHEN distance BETWEEN 1700 AND 1800 THEN 1800 WHEN distance BETWEEN 1900 AND 2000 THEN 2000
  WHEN distance BETWEEN 2100 AND 2200 THEN 2200 WHEN distance BETWEEN 2300 AND 2400 THEN 2400 WHEN distance = 2500 THEN 2500 ELSE 3000 END AS dist_range,
 CASE WHEN distance < 1400 THEN 'short' WHEN distance < 1800 THEN 'mile' WHEN distance < 2200 THEN 'middle' ELSE 'long' END AS dist_name,
 CASE race_class WHEN '新馬' THEN 1 WHEN '未勝利' THEN 2 WHEN '1勝クラス' THEN 3 WHEN '2勝クラス' THEN 4 WHEN '3勝クラス' THEN 5 WHEN 'オープン' THEN 6 WHEN 'G3' THEN 8 WHEN 'G1' THEN 10 ELSE 0 END AS class_rank FROM entries""")
def distance_classes(spark, sf_dir):
    df = entries(spark, sf_dir).select("distance", "surface", "race_class").distinct()
    return df.withColumns({"dist_range": C.distance_range("distance", "surface"), "dist_name": C.distance_name("distance"), "class_rank": C.class_rank("race_class")})


_STAT = "CASE tax WHEN 7 THEN '中' WHEN 6 THEN '除' WHEN 5 THEN '3(降)' ELSE '正常' END"


def _with_status(df):
    t = F.col("tax")
    st = F.when(t == 7, "中").when(t == 6, "除").when(t == 5, "3(降)").otherwise("正常")
    return df.withColumns({"finish_status": st, "finish": F.when(~t.isin(6, 7), F.col("outcome"))})


@query("invalid_results", "P8 A3",
       ENTRIES + ", x AS (SELECT " + _STAT + """ AS st, CASE WHEN tax IN (6,7) THEN NULL ELSE outcome END AS o FROM entries),
k AS (SELECT '(all)' AS status FROM x UNION ALL SELECT st FROM x WHERE st <> '正常' UNION ALL SELECT '(NULL finish_order)' FROM x WHERE o IS NULL UNION ALL SELECT '(invalid)' FROM x WHERE o IS NULL OR st <> '正常')
SELECT status, count(*) AS n, round(count(*) / (SELECT count(*) FROM x),6) AS rate FROM k GROUP BY 1""")
def invalid_results(spark, sf_dir):
    return round_doubles(quality.invalid_breakdown(_with_status(entries(spark, sf_dir)), "finish", "finish_status"))


@query("valid_targets", "P8", ENTRIES + "SELECT event, entity FROM entries WHERE tax NOT IN (5,6,7)")
def valid_targets(spark, sf_dir):
    return quality.valid_targets(_with_status(entries(spark, sf_dir)), "finish", "finish_status").select(*KEY)


@query("corner_orders", "P10",
       """WITH x AS (SELECT o_orderkey AS event, [o_orderkey % 9 + 1, o_custkey % 9 + 10, o_orderkey % 5 + 20, o_custkey % 5 + 30] AS a FROM orders)
SELECT event, CAST(unnest(a) AS INTEGER) AS "no", unnest([1,2,3,3]) AS pos FROM x""")
def corner_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(F.lit("("), (k % 9 + 1).cast("string"), F.lit(","), (c % 9 + 10).cast("string"), F.lit("),"), (k % 5 + 20).cast("string"), F.lit("="), (c % 5 + 30).cast("string"))
    return o.select(k.alias("event"), F.explode(C.corner_order(text)).alias("x")).select("event", "x.no", "x.pos")


@query("packed_numbers", "P11",
       """SELECT l_orderkey, l_partkey, l_suppkey, CAST(400 + l_quantity AS INTEGER) AS weight, CAST(l_linenumber - 5 AS INTEGER) AS change, round(60 + l_quantity + 0.5,6) AS seconds, CAST(1000 + l_quantity AS BIGINT) AS amount FROM lineitem""")
def packed_numbers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    weight = F.format_string("%d(%+d)", 400 + q, n - 5)
    time = F.concat(F.lit("1:"), F.format_string("%02d", q), F.lit(".5"))
    amount = F.format_number(1000 + q, 0)
    return li.select("l_orderkey", "l_partkey", "l_suppkey", C.weight_of(weight).alias("weight"), C.weight_change_of(weight).alias("change"), r6(C.seconds_of(time)).alias("seconds"), C.amount_of(amount).alias("amount"))


@query("course_texts", "P12",
       """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'turf' WHEN 1 THEN 'dirt' ELSE 'steeple' END AS surface, CASE o_custkey % 2 WHEN 0 THEN 'right' ELSE 'left' END AS turn, CAST(1000 + 100 * (o_orderkey % 25) AS INTEGER) AS distance,
 CASE WHEN o_orderkey % 5 = 0 THEN 'outer' END AS inout, '晴' AS weather, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE CASE o_custkey % 3 WHEN 0 THEN '良' WHEN 1 THEN '稍重' ELSE '不良' END END AS going, CAST(10 + o_orderkey % 6 AS VARCHAR) || ':40' AS start,
 CAST(o_orderdate AS DATE) AS date, CAST(1 + o_custkey % 5 AS INTEGER) AS meeting, '中山' AS place, CAST(1 + o_orderkey % 8 AS INTEGER) AS meeting_day, CASE o_orderkey % 2 WHEN 0 THEN 'オープン' ELSE '未勝利' END AS race_class FROM orders""")
def course_texts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, c, d = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    s = F.when(k % 3 == 0, "芝").when(k % 3 == 1, "ダート").otherwise("障")
    going = F.when(c % 3 == 0, "良").when(c % 3 == 1, "稍").otherwise("不")
    text = F.concat(s, F.when(c % 2 == 0, "右").otherwise("左"), (1000 + 100 * (k % 25)).cast("string"), F.lit("m"), F.when(k % 5 == 0, "外").otherwise(""),
                    F.lit(" / 天候 : 晴 / "), s, F.lit(" : "), going, F.lit(" / 発走 : "), (10 + k % 6).cast("string"), F.lit(":40"))
    meet = F.concat(F.year(d).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.day(d).cast("string"), F.lit("日 "), (1 + c % 5).cast("string"), F.lit("回中山"), (1 + k % 8).cast("string"), F.lit("日目 3歳以上"),
                    F.when(k % 2 == 0, "オープン").otherwise("未勝利"))
    return o.select("o_orderkey", *[x.alias(n) for n, x in C.course_text(text).items()], *[x.alias(n) for n, x in C.meeting_text(meet).items()])


@query("gate_and_odds", "P16 P17",
       ENTRIES + """, g AS (SELECT *, CASE WHEN tax = 3 THEN NULL ELSE post END AS g, CASE WHEN tax = 2 THEN 0 ELSE odds END AS o FROM entries)
SELECT event, entity, round(coalesce(g/field_size,0.5),6) AS ax5_waku_pct, round(post/field_size,6) AS ax5_umaban_pct, CAST(coalesce(g/field_size <= 0.5,FALSE) AS INTEGER) AS ax5_is_inner, CAST(coalesce(g/field_size > 0.5,FALSE) AS INTEGER) AS ax5_is_outer,
 round(least(coalesce(g,1)-1, field_size-coalesce(g,1))/greatest(field_size-1,1),6) AS ax5_gate_distance_to_edge_norm, round(CASE WHEN o > 0 THEN o ELSE 999 END,6) AS odds_raw, round(ln(CASE WHEN o > 0 THEN o ELSE 999 END),6) AS odds_log, round(1/CASE WHEN o > 0 THEN o ELSE 999 END,6) AS odds_implied_prob FROM g""")
def gate_and_odds(spark, sf_dir):
    df = entries(spark, sf_dir).withColumns({"gate": F.when(F.col("tax") != 3, F.col("post")), "o": F.when(F.col("tax") == 2, 0.0).otherwise(F.col("odds"))})
    cols = C.gate_position("gate", "post", "field_size") | C.odds_features("o")
    return round_doubles(df.select(*KEY, *[c.alias(n) for n, c in cols.items()]))


@query("one_hot_codes", "P19 P25",
       ENTRIES + """SELECT event, entity, CAST(surface='芝' AS DOUBLE) AS "s_芝", CAST(surface='ダ' AS DOUBLE) AS "s_ダ", CASE WHEN going IS NULL OR going='不良' THEN round(1/3,6) ELSE CAST(going='良' AS DOUBLE) END AS "g_良", CASE WHEN going IS NULL OR going='不良' THEN round(1/3,6) ELSE CAST(going='稍重' AS DOUBLE) END AS "g_稍重",
  CASE WHEN going IS NULL OR going='不良' THEN round(1/3,6) ELSE CAST(going='重' AS DOUBLE) END AS "g_重", CAST(place='東京' OR place='小倉' AS DOUBLE) AS "p_東京", CAST(place='中山' AS DOUBLE) AS "p_中山", CAST(place='京都' AS DOUBLE) AS "p_京都", CAST(place='阪神' AS DOUBLE) AS "p_阪神", coalesce(weight,-999) AS weight FROM entries""")
def one_hot_codes(spark, sf_dir):
    df = entries(spark, sf_dir)
    cols = C.one_hot("surface", ["芝", "ダ"], "zeros", "s_") | C.one_hot("going", ["良", "稍重", "重"], "uniform", "g_") | C.one_hot("place", ["東京", "中山", "京都", "阪神"], "first", "p_")
    return round_doubles(df.fillna({"weight": -999}).select(*KEY, *[c.alias(n) for n, c in cols.items()], "weight"))


_ANC = """, anc AS (SELECT p_partkey AS entity, 1 AS generation, 's' AS position, p_brand AS ancestor_id, p_name AS ancestor_name FROM part UNION ALL SELECT p_partkey, 1, 'd', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END, p_name FROM part
 UNION ALL SELECT p_partkey, 2, 'ss', CAST(p_size AS VARCHAR), p_name FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 3, 'sds', p_brand || p_type, p_name FROM part WHERE p_partkey % 5 = 0)"""


def _ancestors(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = F.array_compact(
        F.array(
            F.struct(F.lit(1).alias("generation"), F.lit("s").alias("position"), F.col("p_brand").alias("ancestor_id")),
            F.struct(F.lit(1).alias("generation"), F.lit("d").alias("position"), F.when(k % 3 == 0, "").otherwise(F.col("p_type")).alias("ancestor_id")),
            F.when(k % 2 == 0, F.struct(F.lit(2).alias("generation"), F.lit("ss").alias("position"), F.col("p_size").cast("string").alias("ancestor_id"))),
            F.when(k % 5 == 0, F.struct(F.lit(3).alias("generation"), F.lit("sds").alias("position"), F.concat("p_brand", "p_type").alias("ancestor_id"))),
        )
    )
    return p.select(k.alias("entity"), F.explode(rows).alias("a"), F.col("p_name").alias("ancestor_name")).select("entity", "a.*", "ancestor_name")


def _hash_sql(tokens, bits):
    n = 1 << bits
    return tokens + f""", h AS (SELECT entity, w, CAST('0x' || substr(sha256(token),14,3) AS INTEGER) AS v FROM tok), c AS (SELECT entity, v % {n} AS idx, sum(CASE WHEN (v >> {bits}) & 1 = 0 THEN w ELSE -w END) AS w FROM h GROUP BY 1,2)
SELECT entity, CAST(idx AS INTEGER) AS idx, round(CASE WHEN sqrt(sum(w*w) OVER (PARTITION BY entity)) > 0 THEN w / sqrt(sum(w*w) OVER (PARTITION BY entity)) ELSE 0 END,6) + 0.0 AS value FROM c"""


@query("pedigree_hash", "P20", _hash_sql("WITH x AS (SELECT 1)" + _ANC + ", tok AS (SELECT entity, 1/sqrt(generation) AS w, 'gen' || CAST(generation AS VARCHAR) || ':' || position || ':' || CASE WHEN ancestor_id <> '' THEN ancestor_id ELSE ancestor_name END AS token FROM anc)", 9))
def pedigree_hash(spark, sf_dir):
    out = pedigree.hash_ancestors(_ancestors(spark, sf_dir))
    return out.select("entity", "idx", (r6("value") + 0.0).alias("value"))


@query("pedigree_hash_direct", "P20", _hash_sql("WITH tok AS (SELECT p_partkey AS entity, CAST(1.0 AS DOUBLE) AS w, 'sire:' || p_brand AS token FROM part UNION ALL SELECT p_partkey, 1.0, 'dam:' || p_type FROM part UNION ALL SELECT p_partkey, 1.0, 'bms:' || p_name FROM part)", 7))
def pedigree_hash_direct(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("name")) for r, c in (("sire", "p_brand"), ("dam", "p_type"), ("bms", "p_name"))])
    rows = p.select(F.col("p_partkey").alias("entity"), F.explode(roles).alias("r")).select("entity", "r.*")
    return pedigree.hash_direct(rows).select("entity", "idx", (r6("value") + 0.0).alias("value"))


@query("pedigree_vectors", "P20", "SELECT entity, 512::BIGINT AS n, round(sqrt(sum(value*value)),4) AS length FROM (" + _hash_sql("WITH x AS (SELECT 1)" + _ANC + ", tok AS (SELECT entity, 1/sqrt(generation) AS w, 'gen' || CAST(generation AS VARCHAR) || ':' || position || ':' || CASE WHEN ancestor_id <> '' THEN ancestor_id ELSE ancestor_name END AS token FROM anc)", 9) + ") GROUP BY entity")
def pedigree_vectors(spark, sf_dir):
    out = pedigree.dense(pedigree.hash_ancestors(_ancestors(spark, sf_dir)), 9)
    square = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return out.select("entity", F.size("vector").cast("long").alias("n"), F.round(F.sqrt(square), 4).alias("length"))


@query("generation_coverage", "A4", "WITH x AS (SELECT 1)" + _ANC + " SELECT generation, count(*) AS n, CAST((SELECT count(DISTINCT entity) FROM anc) * pow(2, generation) AS BIGINT) AS expected, round(count(*) / ((SELECT count(DISTINCT entity) FROM anc) * pow(2, generation)),6) AS coverage FROM anc GROUP BY 1")
def generation_coverage(spark, sf_dir):
    return round_doubles(quality.generation_coverage(_ancestors(spark, sf_dir)))


# --- quality --------------------------------------------------------------------------------


def _prof_sql(cols, types, src):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) AS n_rows, round((count(*)-count({c}))/count(*),6) AS null_rate, count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM {src}"
        for c, t in zip(cols, types)
    )


@query("table_profile", "A1", ENTRIES + _prof_sql(["entity", "going", "weight", "race_class", "event_date", "outcome"], ["bigint", "string", "int", "string", "date", "bigint"], "entries"))
def table_profile(spark, sf_dir):
    cols = ["entity", "going", "weight", "race_class", "event_date", "outcome"]
    return round_doubles(quality.table_profile(entries(spark, sf_dir), cols, exact=True))


@query("table_profile_sketch", "A1")
def table_profile_sketch(spark, sf_dir):
    return quality.table_profile(entries(spark, sf_dir))


@query("year_coverage", "A2", ENTRIES + "SELECT CAST(year(event_date) AS INTEGER) AS year, count(*) AS n_entries, count(DISTINCT event) AS n_events, count(DISTINCT entity) AS n_entities, count(DISTINCT actor) AS n_actors, count(DISTINCT owner) AS n_owners FROM entries GROUP BY 1")
def year_coverage(spark, sf_dir):
    return quality.year_coverage(entries(spark, sf_dir))


_COV = ENTRIES + """, c AS (SELECT event, count(*) AS expected, count(*) FILTER (WHERE tax < 4) AS present FROM entries GROUP BY 1), s AS (SELECT *, CASE WHEN present = 0 THEN 'missing' WHEN present < expected THEN 'partial' ELSE 'full' END AS state FROM c) """


@query("child_coverage", "A5", _COV + "SELECT event, expected, present, state FROM s")
def child_coverage(spark, sf_dir):
    df = entries(spark, sf_dir)
    return quality.child_coverage(df, df.filter("tax < 4"), "event")


@query("child_coverage_summary", "A5", _COV + "SELECT count(*) AS n_keys, count(*) FILTER (WHERE state='full') AS n_full, count(*) FILTER (WHERE state='partial') AS n_partial, count(*) FILTER (WHERE state='missing') AS n_missing, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(present) AS BIGINT) AS present, round(sum(present)/sum(expected),6) AS rate FROM s")
def child_coverage_summary(spark, sf_dir):
    df = entries(spark, sf_dir)
    return round_doubles(quality.coverage_summary(quality.child_coverage(df, df.filter("tax < 4"), "event")))


@query("duplicate_keys", "A6", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1,2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return quality.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query("kept_rows", "A6", "SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC, l_suppkey DESC, l_quantity DESC) AS k FROM lineitem) WHERE k = 1")
def kept_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity")
    return quality.keep_one(li, ["l_orderkey", "l_partkey"], ["l_linenumber", "l_suppkey", "l_quantity"])


@query("activity", "A7", ENTRIES + "SELECT entity, count(*) AS n, max(event_date) AS last_date FROM entries GROUP BY 1")
def activity(spark, sf_dir):
    return quality.activity(entries(spark, sf_dir), "entity", "event_date")


@query("ids_in_years", "A7 U2", ENTRIES + "SELECT DISTINCT entity FROM entries WHERE year(event_date) BETWEEN 1995 AND 1996 UNION SELECT DISTINCT entity FROM entries WHERE year(event_date) = 2000")
def ids_in_years(spark, sf_dir):
    df = entries(spark, sf_dir)
    return quality.ids_between(df, "entity", "event_date", 1995, 1996).union(quality.ids_between(df, "entity", "event_date", 2000, 2000)).distinct()


@query("progress_by_status", "A8", """SELECT o_orderpriority AS entity_type, count(*) AS total, count(*) FILTER (WHERE o_orderstatus='F') AS success, count(*) FILTER (WHERE o_orderstatus='P') AS failed, count(*) FILTER (WHERE o_orderstatus='O') AS pending, 0::BIGINT AS skipped, round(count(*) FILTER (WHERE o_orderstatus='F')/count(*)*100,6) AS progress_pct FROM orders GROUP BY 1""")
def progress_by_status(spark, sf_dir):
    s = F.col("o_orderstatus")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("entity_type"), F.when(s == "F", "success").when(s == "P", "failed").otherwise("pending").alias("status"))
    return round_doubles(quality.progress(o, "entity_type", "status"))


@query("value_counts", "A9", ENTRIES + "SELECT 'surface' AS \"column\", surface AS value, count(*) AS n FROM entries GROUP BY 2 UNION ALL SELECT 'going', going, count(*) FROM entries GROUP BY 2 UNION ALL SELECT 'field_size', CAST(field_size AS VARCHAR), count(*) FROM entries GROUP BY 2")
def value_counts(spark, sf_dir):
    return quality.value_counts(entries(spark, sf_dir), ["surface", "going", "field_size"])


_MSG = "CASE WHEN event_type = 'error' THEN CASE event_id % 6 WHEN 0 THEN 'Read timed out' WHEN 1 THEN 'HTTP ' || CAST(398 + event_id % 8 AS VARCHAR) WHEN 2 THEN 'HTTP ' || CAST(498 + event_id % 8 AS VARCHAR) WHEN 3 THEN 'Parse failed' WHEN 4 THEN 'Connection refused' ELSE 'other' END END"


@query("failure_categories", "P28",
       f"""WITH m AS (SELECT lower({_MSG}) AS m FROM events) SELECT CASE WHEN m LIKE '%timeout%' OR m LIKE '%timed out%' THEN 'timeout' WHEN regexp_matches(m,'400|401|403|429') THEN 'http_4xx' WHEN regexp_matches(m,'500|502|503|504') THEN 'http_5xx'
 WHEN regexp_matches(m,'parse|attribute|keyerror|indexerror') THEN 'parse' WHEN regexp_matches(m,'connection|refused|reset|broken pipe') THEN 'network' ELSE 'unknown' END AS category, count(*) AS n FROM m WHERE m IS NOT NULL GROUP BY 1""")
def failure_categories(spark, sf_dir):
    e = F.col("event_id")
    text = (
        F.when(e % 6 == 0, "Read timed out").when(e % 6 == 1, F.concat(F.lit("HTTP "), (398 + e % 8).cast("string")))
        .when(e % 6 == 2, F.concat(F.lit("HTTP "), (498 + e % 8).cast("string"))).when(e % 6 == 3, "Parse failed").when(e % 6 == 4, "Connection refused").otherwise("other")
    )
    ev = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", text).alias("message"))
    return quality.failure_counts(ev, "message")


@query("missing_keys", "J9 U1", "SELECT DISTINCT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def missing_keys(spark, sf_dir):
    known = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return quality.missing_keys(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), known, "id")


@query("entities_without_laps", "U1", ENTRIES + "SELECT DISTINCT entity FROM entries EXCEPT SELECT entity FROM entries WHERE tax = 1 AND surface = '芝'")
def entities_without_laps(spark, sf_dir):
    df = entries(spark, sf_dir)
    return df.select("entity").subtract(df.filter("tax = 1 AND surface = '芝'").select("entity"))


@query("incomplete_events", "J9", "SELECT o_orderkey AS event, 4 AS expected, count(l_orderkey) AS present FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(l_orderkey) < 4")
def incomplete_events(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), F.lit(4).alias("expected"))
    return quality.incomplete(parents, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event")), "event", "expected")


@query("referential_integrity", "J10",
       """SELECT 'entry_event' AS link, count(*) AS n_keys, count(o_orderkey) AS n_matched, round(count(o_orderkey)/count(*),6) AS match_rate FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON k = o_orderkey
UNION ALL SELECT 'event_customer', count(*), count(c_custkey), round(count(c_custkey)/count(*),6) FROM (SELECT DISTINCT o_custkey AS k FROM orders) LEFT JOIN customer ON k = c_custkey""")
def referential_integrity(spark, sf_dir):
    li, o, c = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    return round_doubles(quality.referential_integrity({"entry_event": (li, "l_orderkey", o.filter("o_orderstatus <> 'P'"), "o_orderkey"), "event_customer": (o, "o_custkey", c, "c_custkey")}))


@query("number_report", "E13 P26", ENTRIES + """, x AS (SELECT CASE WHEN tax = 1 THEN NULL WHEN tax = 2 THEN 'nan'::DOUBLE ELSE odds END AS a, CASE WHEN tax = 3 THEN 'inf'::DOUBLE ELSE p END AS b FROM entries)
SELECT 'a' AS "column", count(*) FILTER (WHERE a IS NULL OR isnan(a)) AS n_nan, count(*) FILTER (WHERE isinf(a)) AS n_inf FROM x UNION ALL SELECT 'b', count(*) FILTER (WHERE b IS NULL OR isnan(b)), count(*) FILTER (WHERE isinf(b)) FROM x
UNION ALL SELECT 'b_clean', count(*) FILTER (WHERE isinf(b)), 0 FROM x""")
def number_report(spark, sf_dir):
    t = F.col("tax")
    df = entries(spark, sf_dir).select(F.when(t == 1, None).when(t == 2, float("nan")).otherwise(F.col("odds")).alias("a"), F.when(t == 3, float("inf")).otherwise(F.col("p")).alias("b"))
    return quality.number_report(df.withColumn("b_clean", C.sanitize("b")), ["a", "b", "b_clean"])


@query("bridged_features", "J2 J3 J11", ENTRIES + """, v3 AS (SELECT l_orderkey AS event, l_partkey AS entity, max(l_quantity) AS q, max(l_discount) AS d FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1,2)
SELECT event, entity, outcome, q AS v4_bridge_l_quantity, d AS v4_bridge_l_discount FROM entries LEFT JOIN v3 USING (event, entity)""")
def bridged_features(spark, sf_dir):
    other = table(spark, sf_dir, "lineitem").filter("l_linenumber <> 3").withColumnsRenamed({"l_orderkey": "event", "l_partkey": "entity"})
    return tables.bridge(entries(spark, sf_dir).select(*KEY, "outcome"), other, KEY, ["l_quantity", "l_discount"], K.BRIDGE_PREFIX)


@query("profile_sample", "T7", ENTRIES + "SELECT event, entity, outcome, qty FROM entries ORDER BY sha256(CAST(event AS VARCHAR) || '|' || CAST(entity AS VARCHAR) || '|7') LIMIT 1000")
def profile_sample(spark, sf_dir):
    key = F.sha2(F.concat_ws("|", F.col("event").cast("string"), F.col("entity").cast("string"), F.lit("7")), 256)
    return entries(spark, sf_dir).select(*KEY, "outcome", "qty").orderBy(key).limit(1000)


@query("partitioned_scan", "S4", ENTRIES + "SELECT event, entity, CAST(year(event_date) AS INTEGER) AS event_year, last3f FROM entries WHERE year(event_date) IN (1996, 1999)")
def partitioned_scan(spark, sf_dir):
    """A feature table written by year; the year filter prunes folders and the scan reads three columns."""
    def build(s, d):
        return entries(s, d).withColumn("event_year", F.year("event_date"))

    df = stored(spark, sf_dir, "entries-by-year", build, ["event_year"])
    return df.filter(F.col("event_year").isin(1996, 1999)).select(*KEY, "event_year", "last3f")
