"""Queries over cleaning, projection and filter operators (2.B), and joins (2.C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagweave.functions.dates import compose_datetime
from lagweave.operators import clean as C
from lagweave.operators import joins as J
from lagweave.operators.series import hours_between

from .base import ADMISSIONS, GAPS, MEASURES, SERIES, STAYS, admissions, gaps, measures, query, series, stays, table


def sensors(spark, d):
    """The series as a sensor table with named columns."""
    return series(spark, d).select("subject", "i", (F.col("y") % 5).alias("activity_id"), F.col("x1").alias("temp_hand"), F.col("x2").alias("gyro_x_chest"), (F.col("x1") + F.col("x2")).alias("orient_w_ankle"), F.col("x1").alias("heart_rate"))


SENSORS = SERIES + ", sensors AS (SELECT subject, i, y % 5 AS activity_id, x1 AS temp_hand, x2 AS gyro_x_chest, x1 + x2 AS orient_w_ankle, x1 AS heart_rate FROM series)"


@query(SENSORS + " SELECT subject, i, activity_id, temp_hand, gyro_x_chest, heart_rate FROM sensors")
def select_sensors(spark, d):
    return C.select_sensors(sensors(spark, d))


@query(SENSORS + " SELECT subject, i, activity_id, temp_hand FROM sensors WHERE activity_id <> 0")
def drop_transient(spark, d):
    return C.drop_transient(sensors(spark, d)).select("subject", "i", "activity_id", "temp_hand")


@query(GAPS + " SELECT event_id, subject, i, x1, x2 FROM gaps WHERE x1 IS NOT NULL AND x2 IS NOT NULL")
def drop_null_any(spark, d):
    return C.drop_null_any(gaps(spark, d), ["x1", "x2"]).select("event_id", "subject", "i", "x1", "x2")


@query(GAPS + " SELECT 'x1' AS \"column\", CAST(count(*) FILTER (x1 IS NULL) AS BIGINT) AS missing FROM gaps UNION ALL SELECT 'x2', CAST(count(*) FILTER (x2 IS NULL) AS BIGINT) FROM gaps")
def null_counts(spark, d):
    return C.null_counts(gaps(spark, d), ["x1", "x2"])


@query("SELECT event_id, CAST(trunc(value) AS BIGINT) AS whole, TRY_CAST(event_type AS DOUBLE) AS number, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def cast_types(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("value").alias("whole"), F.col("event_type").alias("number"), F.get_json_object("props", "$.k").alias("k"))
    return C.cast_types(e, {"whole": "long", "number": "double", "k": "long"})


@query("""WITH names AS (SELECT DISTINCT concat(event_type, '_', ['hand', 'chest', 'ankle', 'heart_rate', 'other'][CAST(user_id % 5 AS INTEGER) + 1]) AS "column" FROM events)
SELECT "column", CASE WHEN contains("column", 'heart') OR "column" = 'hr' THEN 'heart_rate' WHEN contains("column", 'chest') THEN 'chest' WHEN contains("column", 'hand') THEN 'hand' WHEN contains("column", 'ankle') THEN 'ankle' END AS modality FROM names""")
def categorize_columns(spark, d):
    parts = F.array(*[F.lit(x) for x in ("hand", "chest", "ankle", "heart_rate", "other")])
    names = table(spark, d, "events").select(F.concat_ws("_", "event_type", F.element_at(parts, (F.col("user_id") % 5 + 1).cast("int"))).alias("column")).distinct()
    return C.categorize_columns(names)


@query(SERIES + " SELECT event_id, x1 AS hand_1, x2 AS hand_2, CAST(0 AS DOUBLE) AS chest_1 FROM series")
def modality_vectors(spark, d):
    packed = C.modality_vectors(series(spark, d), {"hand": ["x1", "x2"], "chest": []})
    return packed.select("event_id", F.get("hand", F.lit(0)).alias("hand_1"), F.get("hand", F.lit(1)).alias("hand_2"), F.get("chest", F.lit(0)).alias("chest_1"))


@query(SERIES + " SELECT event_id, event_type, y FROM series")
def label_index(spark, d):
    return C.label_index(table(spark, d, "events").select("event_id", "event_type"), "event_type", "y")


HOURS = SERIES + ", timed AS (SELECT event_id, subject, date_diff('microsecond', min(ts) OVER (PARTITION BY subject), ts) / 3.6e9 AS hours FROM series)"


def timed(spark, d):
    from pyspark.sql import Window

    return series(spark, d).select("event_id", "subject", hours_between(F.min("ts").over(Window.partitionBy("subject")), F.col("ts")).alias("hours"))


@query(HOURS + " SELECT event_id, subject, round(hours, 6) AS hours FROM timed WHERE hours BETWEEN 0 AND 48")
def time_filter(spark, d):
    return C.time_filter(timed(spark, d), "hours", 48).withColumn("hours", F.round("hours", 6))


LOS = "WITH " + STAYS + ", los AS (SELECT stay_id, date_diff('microsecond', intime, outtime) / 8.64e10 * (1 + stay_id % 4) AS los FROM stays)"


@query(LOS + " SELECT stay_id, round(los, 6) AS los FROM los WHERE los >= 48 / 24.0")
def min_los_filter(spark, d):
    s = stays(spark, d).select("stay_id", (hours_between(F.col("intime"), F.col("outtime")) / 24 * (1 + F.col("stay_id") % 4)).alias("los"))
    return s.where(F.col("los") >= 48 / 24).withColumn("los", F.round("los", 6))


@query(GAPS + " SELECT event_id, CAST(x1 IS NOT NULL AS BIGINT) AS m1, CAST(x2 IS NOT NULL AS BIGINT) AS m2, coalesce(x1, 0) AS v1, coalesce(x2, 0) AS v2 FROM gaps")
def mask_and_zero_fill(spark, d):
    g = gaps(spark, d).select("event_id", C.observed_mask(["x1", "x2"]).alias("m"), C.zero_filled(["x1", "x2"]).alias("v"))
    return g.select("event_id", F.get("m", F.lit(0)).cast("long").alias("m1"), F.get("m", F.lit(1)).cast("long").alias("m2"), F.get("v", F.lit(0)).alias("v1"), F.get("v", F.lit(1)).alias("v2"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'looked' WHEN 'click' THEN 'pressed' ELSE event_type END AS event FROM events")
def rename_values(spark, d):
    return C.rename_values(table(spark, d, "events").select("event_id", F.col("event_type").alias("event")), "event", {"view": "looked", "click": "pressed"})


@query("SELECT o_orderkey AS stay, o_orderstatus AS died FROM orders")
def rename_columns(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").withColumnsRenamed({"o_orderkey": "stay", "o_orderstatus": "died"})


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL ELSE value END AS value FROM events")
def replace_inf(spark, d):
    v = F.when(F.col("event_id") % 11 == 0, float("inf")).when(F.col("event_id") % 13 == 0, float("nan")).otherwise(F.col("value"))
    return C.replace_inf(table(spark, d, "events").select("event_id", v.alias("value")), ["value"])


@query(SERIES + " SELECT subject, CAST(count(*) AS BIGINT) AS rows_a, CAST(count(x1) AS BIGINT) AS rows_b FROM series GROUP BY subject")
def assert_same_features(spark, d):
    a, b = series(spark, d), gaps(spark, d)
    C.assert_same_features(a, b, ["event_id", "subject"])
    return a.groupBy("subject").agg(F.count("*").alias("rows_a"), F.count("x1").alias("rows_b"))


@query(SERIES + " SELECT event_id, subject, i FROM series WHERE n > 66")
def min_length_filter(spark, d):
    return C.min_length(series(spark, d), ["subject"], 66).select("event_id", "subject", "i")


@query(SERIES + " SELECT min(y) AS lowest, max(y) AS highest, CAST(count(DISTINCT y) AS BIGINT) AS seen, min(y) >= 0 AND max(y) < 5 AS in_range, count(DISTINCT y) < 2 AS single FROM series")
def validate_labels(spark, d):
    return C.validate_labels(series(spark, d), "y", 5)


@query("SELECT event_id, user_id FROM events WHERE user_id BETWEEN 1 AND 6 OR user_id = 9 OR user_id BETWEEN 20 AND 40")
def parse_id_list(spark, d):
    return table(spark, d, "events").where(F.col("user_id").isin(C.parse_id_list("1-6,9,20-40"))).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events WHERE user_id % 3 <> 0")
def drop_null_key(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("user_id")).na.drop(subset=["user_id"])


@query(SERIES + " SELECT subject, i, event_id, x1, x2 FROM series")
def reorder_drop_columns(spark, d):
    return C.keys_first(series(spark, d).drop("event_type", "y", "n"), ["subject", "i"], ["ts"])


@query("""WITH parts AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN '20241301' ELSE strftime(ts, '%Y%m%d') END AS day,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat(CAST(CAST(strftime(ts, '%H%M%S') AS BIGINT) AS VARCHAR), '.250') END AS time FROM events)
SELECT event_id, CAST(epoch(try_strptime(concat(lpad(day, 8, '0'), lpad(coalesce(split_part(time, '.', 1), '0'), 6, '0')), '%Y%m%d%H%M%S')) AS BIGINT) AS at FROM parts
WHERE try_strptime(concat(lpad(day, 8, '0'), lpad(coalesce(split_part(time, '.', 1), '0'), 6, '0')), '%Y%m%d%H%M%S') IS NOT NULL""", "compose_datetime")
def composed(spark, d):
    day = F.when(F.col("event_id") % 17 == 0, "20241301").otherwise(F.date_format("ts", "yyyyMMdd"))
    time = F.when(F.col("event_id") % 5 != 0, F.concat(F.date_format("ts", "HHmmss").cast("long").cast("string"), F.lit(".250")))
    at = compose_datetime(day, time)
    return table(spark, d, "events").select("event_id", F.unix_timestamp(at).alias("at")).where("at is not null")


# joins

ITEMS = "items AS (SELECT p_partkey AS itemid, p_brand AS label FROM part)"


@query("WITH " + ITEMS + ", names AS (SELECT label, min(itemid) AS itemid FROM items WHERE label IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22', 'Brand#1', 'Brand#2', 'Brand#3') GROUP BY label) SELECT itemid, l_orderkey, l_quantity, label FROM lineitem JOIN names ON l_partkey = itemid")
def dictionary_join(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").alias("itemid"), F.col("p_brand").alias("label"))
    names = J.dictionary(items, ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22", "Brand#1", "Brand#2", "Brand#3", "Brand#1"], "label", "itemid", "itemid")
    return J.dictionary_join(table(spark, d, "lineitem").select(F.col("l_partkey").alias("itemid"), "l_orderkey", "l_quantity"), names, "itemid")


@query("WITH " + ADMISSIONS + " SELECT e.event_id, a.hadm_id, round(date_diff('microsecond', a.admittime, e.ts) / 3.6e9, 6) AS hours FROM events e LEFT JOIN admissions a ON e.user_id = a.subject AND e.event_id = a.hadm_id")
def equi_left_join(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("subject"), "ts")
    a = admissions(spark, d).withColumn("event_id", F.col("hadm_id"))
    return e.join(a, ["subject", "event_id"], "left").select("event_id", "hadm_id", F.round(hours_between(F.col("admittime"), F.col("ts")), 6).alias("hours"))


FIRST = "(SELECT arg_min({id}, ({s}, {id})) FROM {t} s WHERE s.subject = e.user_id AND e.ts BETWEEN s.{s} AND s.{e})"
STAY_OF = FIRST.format(id="stay_id", s="intime", t="stays", e="outtime")
MATCHED = "matched AS (SELECT e.event_id, s.{id} AS {id}, row_number() OVER (PARTITION BY e.event_id ORDER BY s.{a}, s.{id}) AS r FROM events e JOIN {t} s ON s.subject = e.user_id AND e.ts BETWEEN s.{a} AND s.{b})"
MATCHED_STAY = MATCHED.format(id="stay_id", a="intime", b="outtime", t="stays")


@query("WITH " + STAYS + ", " + MATCHED_STAY + " SELECT e.event_id, m.stay_id FROM events e LEFT JOIN (SELECT * FROM matched WHERE r = 1) m USING (event_id)")
def interval_join_first(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("subject"), "ts")
    return J.interval_join_first(e, stays(spark, d), ["subject"], "event_id", "ts", "stay_id", "intime", "outtime").select("event_id", "stay_id")


def two_level(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("subject"), "ts")
    one = J.interval_join_first(e, admissions(spark, d), ["subject"], "event_id", "ts", "hadm_id", "admittime", "dischtime")
    return J.interval_join_first(one, stays(spark, d), ["subject"], "event_id", "ts", "stay_id", "intime", "outtime")


TWO = "WITH " + STAYS + ", " + ADMISSIONS + ", " + MATCHED_STAY + ", " + MATCHED.format(id="hadm_id", a="admittime", b="dischtime", t="admissions").replace("matched AS", "within_adm AS") + ", two AS (SELECT e.event_id, e.user_id AS subject, e.ts, w.hadm_id, m.stay_id FROM events e LEFT JOIN (SELECT * FROM within_adm WHERE r = 1) w USING (event_id) LEFT JOIN (SELECT * FROM matched WHERE r = 1) m USING (event_id))"


@query(TWO + " SELECT event_id, hadm_id, stay_id FROM two")
def interval_join_two_level(spark, d):
    return two_level(spark, d).select("event_id", "hadm_id", "stay_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def semi_join_ids(spark, d):
    good = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return J.keep_valid(table(spark, d, "orders").select("o_orderkey", "o_custkey"), good, "o_custkey")


@query("WITH " + STAYS + ", held AS (SELECT stay_id, count(*) AS notes FROM stays JOIN events ON user_id = subject AND ts BETWEEN intime AND outtime WHERE event_type = 'error' GROUP BY 1) SELECT stay_id, CAST(coalesce(notes, 0) AS BIGINT) AS notes, CAST(notes IS NULL AS BIGINT) AS missing FROM stays LEFT JOIN held USING (stay_id)")
def anti_join_missing(spark, d):
    """Each stay's notes, and a flag where it has none: errors inside a stay stand for notes."""
    e = table(spark, d, "events").where("event_type = 'error'").select("event_id", F.col("user_id").alias("subject"), "ts")
    held = J.interval_pairs(e, stays(spark, d), ["subject"], "ts", "intime", "outtime").groupBy("stay_id").agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    return J.with_missing_flag(stays(spark, d), held, "stay_id", "ids").select("stay_id", F.size("ids").cast("long").alias("notes"), F.col("missing").cast("long").alias("missing"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id HAVING count(*) >= 65")
def min_obs_filter(spark, d):
    return J.min_observations(table(spark, d, "events"), "user_id", 65)


@query("WITH keys AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type <> 'view'), sums AS (SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 6) AS total FROM events WHERE event_type <> 'click' GROUP BY ALL) SELECT user_id, CAST(day AS VARCHAR) AS day, total FROM keys JOIN sums USING (user_id, day)")
def join_back_keys(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    sums = e.where("event_type <> 'click'").groupBy("user_id", "day").agg(F.round(F.sum("value"), 6).alias("total"))
    return e.where("event_type <> 'view'").select("user_id", "day").distinct().join(sums, ["user_id", "day"]).withColumn("day", F.col("day").cast("string"))


LABELLED = "WITH " + ADMISSIONS + ", died AS (SELECT a.hadm_id, max(CASE WHEN e.event_type = 'error' AND e.ts BETWEEN a.admittime AND a.dischtime THEN 1 ELSE 0 END) AS died FROM admissions a LEFT JOIN events e ON e.user_id = a.subject GROUP BY 1)"


def died(spark, d):
    """hadm_id and whether an error falls in the admission."""
    e = table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("subject"), "ts")
    a = admissions(spark, d)
    inside = J.interval_pairs(e, a, ["subject"], "ts", "admittime", "dischtime", 5).select("hadm_id").distinct().withColumn("died", F.lit(1).cast("long"))
    return a.join(inside, "hadm_id", "left").withColumn("died", F.coalesce("died", F.lit(0).cast("long")))


@query(LABELLED + " SELECT hadm_id, CAST(died AS BIGINT) AS mortality, CAST(CASE WHEN 12 * (1 + hadm_id % 12) < 96 AND died = 0 THEN 1 ELSE 0 END AS BIGINT) AS los_label FROM died")
def label_join(spark, d):
    stay = F.lit(12) * (1 + F.col("hadm_id") % 12)
    return died(spark, d).select("hadm_id", F.col("died").alias("mortality"), F.when((stay < 96) & (F.col("died") == 0), 1).otherwise(0).cast("long").alias("los_label"))


@query("SELECT a.event_type AS mod1, b.event_type AS mod2 FROM (SELECT DISTINCT event_type FROM events) a JOIN (SELECT DISTINCT event_type FROM events) b ON a.event_type < b.event_type")
def pair_generate(spark, d):
    return J.pair_generate(table(spark, d, "events").select("event_type"), "event_type")


@query("WITH per AS (SELECT user_id, round(avg(value), 6) AS mean FROM events GROUP BY 1) SELECT event_id, user_id, mean FROM events JOIN per USING (user_id)")
def attach_rus(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "user_id").join(e.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean")), "user_id").select("event_id", "user_id", "mean")


@query("WITH " + MEASURES + " SELECT DISTINCT event, CAST(floor(valuenum / 50) AS BIGINT) AS item FROM measures")
def distinct_map(spark, d):
    return measures(spark, d).select("event", F.floor(F.col("valuenum") / 50).cast("long").alias("item")).distinct()
