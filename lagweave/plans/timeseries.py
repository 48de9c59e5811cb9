"""Queries over aggregations (2.D), time series (2.E), sampling (2.F), sets (2.G) and functions (2.H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagweave.functions import arrays as A
from lagweave.functions.text import chunk_lines as chunks
from lagweave.operators import aggregate as G
from lagweave.operators import clean as C
from lagweave.operators import joins as J
from lagweave.operators import ranges as R
from lagweave.operators import sampling as P
from lagweave.operators import series as S

from .base import ADMISSIONS, GAPS, HALVES, MEASURES, ROUTING, SERIES, STAYS, admissions, gaps, halves, measures, query, routing, series, stays, table
from .cleaning import died

EVENTS = ("click", "error", "purchase", "signup", "view")
HOURLY = "hourly AS (SELECT user_id AS subject, event_id, event_type AS event, value, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 3.6e9 AS hours FROM events)"


def hourly(spark, d):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, d, "events").select(F.col("user_id").alias("subject"), "event_id", F.col("event_type").alias("event"), "value", S.hours_between(start, F.col("ts")).alias("hours"))


@query("WITH " + MEASURES + ", days AS (SELECT *, CAST(CAST(charttime AS DATE) AS VARCHAR) AS day FROM measures) SELECT subject, day, " + ", ".join(f"arg_min(valuenum, event_id) FILTER (event = '{e}') AS \"{e}\"" for e in EVENTS) + " FROM days GROUP BY ALL")
def pivot_first(spark, d):
    m = measures(spark, d).withColumn("day", F.to_date("charttime").cast("string"))
    return G.pivot_first(m, ["subject", "day"], "event", "valuenum", "event_id", EVENTS)


@query("WITH " + HOURLY + " SELECT subject, CAST(trunc(hours / 6) AS BIGINT) AS t, round(avg(value), 6) AS value FROM hourly WHERE trunc(hours / 6) >= 0 GROUP BY ALL")
def bucket_mean(spark, d):
    return S.bucket_mean(hourly(spark, d), ["subject"], "hours", ["value"], 6.0).withColumn("value", F.round("value", 6))


@query("WITH " + HALVES + ", flat AS (SELECT y, t, unnest(range(1, 33)) AS p, unnest(a) AS v FROM halves) SELECT y, t, CAST(p - 1 AS BIGINT) AS pos, round(avg(v), 6) AS v FROM flat GROUP BY ALL")
def vector_bucket_mean(spark, d):
    means = S.vector_bucket_mean(halves(spark, d), ["y", "t"], "a")
    return means.select("y", "t", F.posexplode("a").alias("pos", "v")).select("y", "t", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("v"))


@query("WITH " + HALVES + ", flat AS (SELECT seq, unnest(range(1, 33)) AS p, unnest(b) AS v FROM halves) SELECT seq, CAST(p - 1 AS BIGINT) AS pos, round(avg(v), 6) AS v FROM flat GROUP BY ALL")
def mean_pool_chunks(spark, d):
    means = S.vector_bucket_mean(halves(spark, d), ["seq"], "b")
    return means.select("seq", F.posexplode("b").alias("pos", "v")).select("seq", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("v"))


@query("WITH " + HALVES + ", fa AS (SELECT seq, unnest(range(1, 33)) AS p, unnest(a) AS v FROM halves WHERE mask), fb AS (SELECT seq, unnest(range(1, 33)) AS p, unnest(b) AS v FROM halves WHERE mask AND vec_id % 2 = 0) SELECT seq, CAST(p - 1 AS BIGINT) AS pos, round(x.v, 6) AS a, round(z.v, 6) AS b FROM (SELECT seq, p, avg(v) AS v FROM fa GROUP BY ALL) x JOIN (SELECT seq, p, avg(v) AS v FROM fb GROUP BY ALL) z USING (seq, p)")
def masked_mean_pool(spark, d):
    h = halves(spark, d).where("mask")
    pooled = S.vector_bucket_mean(h, ["seq"], "a").join(S.vector_bucket_mean(h.where("vec_id % 2 = 0"), ["seq"], "b"), "seq")
    flat = pooled.select("seq", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "v"))
    return flat.select("seq", F.col("pos").cast("long").alias("pos"), F.round("v.a", 6).alias("a"), F.round("v.b", 6).alias("b"))


@query("WITH " + HALVES + " SELECT seq, t, y, round(a[1], 6) AS a1 FROM (SELECT *, count(*) OVER (PARTITION BY seq) AS n FROM halves) WHERE t < n - 2")
def timestep_pool(spark, d):
    from pyspark.sql import Window

    h = halves(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("seq")))
    return S.lag_trim(h, F.lit(2)).select("seq", "t", "y", F.round(F.get("a", F.lit(0)), 6).alias("a1"))


@query(GAPS + " SELECT round(avg(x1), 6) AS x1, round(avg(x2), 6) AS x2 FROM gaps")
def global_means(spark, d):
    return gaps(spark, d).agg(F.round(F.avg("x1"), 6).alias("x1"), F.round(F.avg("x2"), 6).alias("x2"))


FITTED = GAPS + ", fitted AS (SELECT 'x1' AS \"column\", avg(x1) AS mean, stddev_pop(x1) AS std FROM gaps WHERE i < floor(0.8::DOUBLE * n) UNION ALL SELECT 'x2', avg(x2), stddev_pop(x2) FROM gaps WHERE i < floor(0.8::DOUBLE * n))"


def fitted(spark, d):
    return G.fit_standardizer(P.split_temporal(gaps(spark, d)).where("split = 'train'"), ["x1", "x2"])


@query(FITTED + " SELECT \"column\", round(mean, 6) AS mean, round(std, 6) AS std FROM fitted")
def fit_standardizer(spark, d):
    return fitted(spark, d).select("column", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(FITTED + " SELECT event_id, round((x1 - (SELECT mean FROM fitted WHERE \"column\" = 'x1')) / (SELECT std FROM fitted WHERE \"column\" = 'x1'), 6) AS x1, round((x2 - (SELECT mean FROM fitted WHERE \"column\" = 'x2')) / (SELECT std FROM fitted WHERE \"column\" = 'x2'), 6) AS x2 FROM gaps")
def apply_standardizer(spark, d):
    g = G.apply_standardizer(gaps(spark, d), fitted(spark, d), ["x1", "x2"])
    return g.select("event_id", F.round("x1", 6).alias("x1"), F.round("x2", 6).alias("x2"))


@query(SERIES + " SELECT y, CAST(count(*) AS BIGINT) AS n, round(count(*) / (SELECT count(*) FROM series), 9) AS share FROM series GROUP BY y")
def class_prior(spark, d):
    return G.shares(series(spark, d), "y").withColumn("share", F.round("share", 9))


@query(SERIES + " SELECT round(max(n) / sum(n), 9) AS accuracy, CAST(sum(n) AS BIGINT) AS rows_seen FROM (SELECT y, count(*) AS n FROM series GROUP BY y)")
def majority_baseline(spark, d):
    return series(spark, d).groupBy("y").agg(F.count("*").alias("n")).agg(F.round(F.max("n") / F.sum("n"), 9).alias("accuracy"), F.sum("n").alias("rows_seen"))


LENGTHS = "WITH lengths AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)"


@query(LENGTHS + " SELECT CAST(min(n) AS BIGINT) AS shortest, CAST(max(n) AS BIGINT) AS longest, round(avg(n), 6) AS mean, CAST(count(*) FILTER (n > 66) AS BIGINT) AS truncated, CAST(count(*) FILTER (n < 66) AS BIGINT) AS padded, CAST(count(*) FILTER (n = 66) AS BIGINT) AS unchanged FROM lengths")
def sequence_length_stats(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("shortest"), F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("mean"), F.count_if(F.col("n") > 66).alias("truncated"), F.count_if(F.col("n") < 66).alias("padded"), F.count_if(F.col("n") == 66).alias("unchanged"))


@query("SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS subjects, CAST(count(DISTINCT event_type) AS BIGINT) AS activities FROM events")
def distinct_count(spark, d):
    return table(spark, d, "events").agg(F.count_distinct("user_id").alias("subjects"), F.count_distinct("event_type").alias("activities"))


# time series


@query(SERIES + " SELECT event_id, subject, i, n FROM series")
def series_index(spark, d):
    return series(spark, d).select("event_id", "subject", "i", "n")


@query(SERIES + " SELECT a.subject, a.i, CAST(l.lag AS BIGINT) AS lag, a.x1, b.y FROM series a JOIN range(0, 6) l(lag) ON true JOIN series b ON b.subject = a.subject AND b.i = a.i + l.lag")
def lag_align(spark, d):
    return S.lag_align(series(spark, d), ["subject"], ["x1"], "y", 5).select("subject", "i", F.col("lag").cast("long").alias("lag"), "x1", "y")


@query("WITH " + HALVES + " SELECT vec_id, seq, t FROM (SELECT *, count(*) OVER (PARTITION BY seq) AS n FROM halves) WHERE t < n - 3")
def lag_trim_sequence(spark, d):
    from pyspark.sql import Window

    return S.lag_trim(halves(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("seq"))), F.lit(3)).select("vec_id", "seq", "t")


@query(LENGTHS + ", shortest AS (SELECT (min(n) // 5) * 5 AS m FROM lengths) SELECT CAST(k AS BIGINT) AS k, CAST(k * m // 5 AS BIGINT) AS lag FROM shortest, range(0, 5) r(k)")
def lag_grid(spark, d):
    m = table(spark, d, "events").groupBy("user_id").count().agg(F.min("count")).first()[0] // 5 * 5
    return spark.createDataFrame(list(enumerate(S.lag_grid(m, 5))), "k long, lag long")


INTERPOLATED = GAPS + """, known AS (SELECT *, last_value(x1 IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN x1 IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0,
 first_value(x1 IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN x1 IS NOT NULL THEN i END IGNORE NULLS) OVER f AS i1 FROM gaps
 WINDOW b AS (PARTITION BY subject ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY subject ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
FILLED = "CASE WHEN x1 IS NOT NULL THEN x1 WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (i - i0) / (i1 - i0) END"


@query(INTERPOLATED + f" SELECT event_id, subject, i, round({FILLED}, 6) AS x1 FROM known")
def interpolate_linear(spark, d):
    return S.interpolate_linear(gaps(spark, d), ["subject"], "i", ["x1"]).select("event_id", "subject", "i", F.round("x1", 6).alias("x1"))


def ranged(spark, d):
    """The sensor series numbered by days: no task sorts a whole series."""
    rows = series(spark, d).drop("i", "n")
    return R.series_index(rows, ["subject"], ["ts", "event_id"], F.unix_date(F.to_date("ts")))


@query(SERIES + " SELECT event_id, subject, i, n FROM series")
def series_index_ranges(spark, d):
    return ranged(spark, d).select("event_id", "subject", "i", "n")


@query(SERIES + " SELECT a.subject, a.i, CAST(l.lag AS BIGINT) AS lag, a.x1, b.y FROM series a JOIN range(0, 6) l(lag) ON true JOIN series b ON b.subject = a.subject AND b.i = a.i + l.lag")
def lag_align_ranges(spark, d):
    return R.lag_align(ranged(spark, d), ["subject"], ["x1"], "y", 5, 16).select("subject", "i", F.col("lag").cast("long").alias("lag"), "x1", "y")


@query(INTERPOLATED + f" SELECT event_id, subject, i, round({FILLED}, 6) AS x1 FROM known")
def interpolate_linear_ranges(spark, d):
    return R.interpolate_linear(gaps(spark, d), ["subject"], "i", ["x1"], 16).select("event_id", "subject", "i", F.round("x1", 6).alias("x1"))


BUCKETS = "WITH " + HOURLY + ", b AS (SELECT subject, CAST(trunc(hours / 6) AS BIGINT) AS t, avg(value) FILTER (event_id % 7 <> 0) AS value FROM hourly WHERE trunc(hours / 6) >= 0 GROUP BY ALL), grid AS (SELECT subject, CAST(unnest(range(0, max(t) + 1)) AS BIGINT) AS t FROM b GROUP BY subject), g AS (SELECT subject, t, value FROM grid LEFT JOIN b USING (subject, t))"


def buckets(spark, d):
    h = hourly(spark, d).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return S.bucket_mean(h, ["subject"], "hours", ["value"], 6.0)


@query(BUCKETS + " SELECT subject, t, round(value, 6) AS value FROM g")
def regular_grid(spark, d):
    return S.regular_grid(buckets(spark, d), ["subject"]).withColumn("value", F.round("value", 6))


IMPUTED = BUCKETS + ", k AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER b AS i0, first_value(value IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER f AS i1 FROM g WINDOW b AS (PARTITION BY subject ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY subject ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


@query(IMPUTED + " SELECT subject, t, round(coalesce(CASE WHEN value IS NOT NULL THEN value WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - i0) / (i1 - i0) END, (SELECT avg(value) FILTER (event_id % 7 <> 0) FROM hourly)), 6) AS value FROM k")
def impute_series(spark, d):
    h = hourly(spark, d).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return S.impute(h, ["subject"], "hours", ["value"], 6.0).withColumn("value", F.round("value", 6))


WINDOWS = SERIES + ", windows AS (SELECT event_id, subject, y, x1, i, CAST(unnest(range(greatest(0, CAST(ceil((i - 16 + 1) / 8.0) AS BIGINT)), least(i // 8, (n - 16) // 8) + 1)) AS BIGINT) AS w FROM series WHERE n >= 16)"


@query(WINDOWS + " SELECT event_id, subject, w, CAST(i - w * 8 AS BIGINT) AS pos FROM windows")
def sliding_windows(spark, d):
    return S.sliding_windows(series(spark, d), ["subject"], 16, 8).select("event_id", "subject", "w", F.col("pos").cast("long").alias("pos"))


@query(WINDOWS + " SELECT subject, w, y AS label FROM (SELECT subject, w, y, row_number() OVER (PARTITION BY subject, w ORDER BY count(*) DESC, y) AS r FROM windows GROUP BY subject, w, y) WHERE r = 1")
def window_majority_label(spark, d):
    return S.sliding_windows(series(spark, d), ["subject"], 16, 8).groupBy("subject", "w").agg(F.mode("y", True).alias("label"))


@query("WITH v AS (SELECT user_id, list(value ORDER BY ts, event_id) AS a FROM events GROUP BY 1), f AS (SELECT user_id, list_concat(a[1:66], list_transform(range(0, greatest(0, 66 - len(a))), lambda x: 0.0::DOUBLE)) AS first, list_concat(a[greatest(1, len(a) - 65):], list_transform(range(0, greatest(0, 66 - len(a))), lambda x: 0.0::DOUBLE)) AS last FROM v) SELECT user_id, CAST(unnest(range(0, 66)) AS BIGINT) AS pos, unnest(first) AS first, unnest(last) AS last FROM f")
def truncate_pad(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda s: s["value"]).alias("a"))
    both = e.select("user_id", F.arrays_zip(S.truncate_pad(F.col("a"), 66, F.lit(0.0)).alias("first"), S.truncate_pad(F.col("a"), 66, F.lit(0.0), True).alias("last")).alias("z"))
    return both.select("user_id", F.posexplode("z").alias("pos", "v")).select("user_id", F.col("pos").cast("long").alias("pos"), "v.first", "v.last")


RUS = """, rus AS (SELECT a.event_type AS mod1, b.event_type AS mod2, k, avg(a.value) FILTER (a.event_id % 4 = k) AS r FROM events a JOIN (SELECT DISTINCT event_type FROM events) b ON a.event_type < b.event_type JOIN range(0, 4) q(k) ON true GROUP BY ALL)"""


def rus_rows(spark, d):
    """Result rows of pairs and four lags, from sums over the events."""
    from lagweave.operators.joins import pair_generate

    e = table(spark, d, "events").groupBy(F.col("event_type").alias("mod1"), (F.col("event_id") % 4).cast("int").alias("k")).agg(F.avg("value").alias("r"))
    return pair_generate(table(spark, d, "events").select("event_type"), "event_type").join(e, "mod1")


@query("WITH z AS (SELECT 1)" + RUS + ", t AS (SELECT mod1, mod2, CAST(t AS BIGINT) AS t, r FROM rus JOIN range(0, 10) s(t) ON least(t // 2, 3) = k) SELECT mod1 AS m1, mod2 AS m2, t, round(r, 6) AS r FROM t UNION ALL SELECT mod2, mod1, t, round(r, 6) FROM t")
def rus_timeline_segments(spark, d):
    return S.timeline_symmetric(S.timeline_segments(rus_rows(spark, d), 10, 4).withColumn("r", F.round("r", 6)), "r")


@query("WITH z AS (SELECT 1)" + RUS + ", t AS (SELECT mod1, mod2, CAST(t AS BIGINT) AS t, r FROM rus JOIN range(0, 10) s(t) ON least(t // 2, 3) = k) SELECT m, t, round(greatest(0, max(u)), 6) AS u FROM (SELECT mod1 AS m, t, r AS u FROM t UNION ALL SELECT mod2, t, r / 2 FROM t) GROUP BY ALL")
def rus_timeline_unique(spark, d):
    t = S.timeline_segments(rus_rows(spark, d).withColumn("half", F.col("r") / 2), 10, 4)
    return S.timeline_unique(t, "r", "half").withColumn("u", F.round("u", 6))


@query("WITH z AS (SELECT 1)" + RUS + """, grid AS (SELECT mod1, mod2, CAST(t AS BIGINT) AS t FROM (SELECT DISTINCT mod1, mod2 FROM rus), range(0, 10) s(t)),
p AS (SELECT g.mod1, g.mod2, g.t, a.r AS v0, b.r AS v1, least(g.t // 3, 3) * 3 AS i0 FROM grid g JOIN rus a ON a.mod1 = g.mod1 AND a.mod2 = g.mod2 AND a.k = least(g.t // 3, 3) LEFT JOIN rus b ON b.mod1 = g.mod1 AND b.mod2 = g.mod2 AND b.k = least(g.t // 3, 3) + 1)
SELECT mod1, mod2, t, round(CASE WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - i0) / 3.0 END, 6) AS r FROM p""")
def rus_timeline_interp(spark, d):
    knots = rus_rows(spark, d).withColumn("lag", F.col("k") * 3)
    return S.timeline_interp(knots, ["mod1", "mod2"], 10, "r").select("mod1", "mod2", "t", F.round("r", 6).alias("r"))


@query("WITH " + HOURLY + " SELECT event_id, round(hours, 6) AS hours FROM hourly")
def hour_delta(spark, d):
    return hourly(spark, d).select("event_id", F.round("hours", 6).alias("hours"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def dedupe_first(spark, d):
    return S.dedupe_first(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


# sorting, samples, splits, sets


@query("SELECT user_id, event_id, value FROM events ORDER BY user_id, ts, event_id")
def sort_events(spark, d):
    return table(spark, d, "events").orderBy("user_id", "ts", "event_id").select("user_id", "event_id", "value")


@query("SELECT o_orderkey FROM orders ORDER BY md5(concat('7:', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 100")
def sample_n(spark, d):
    return P.sample_n(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100, 7)


RANKED = "WITH ranked AS (SELECT o_orderkey, CAST(row_number() OVER (ORDER BY md5(concat('3:', CAST(o_orderkey AS VARCHAR))), o_orderkey) - 1 AS BIGINT) AS rank, count(*) OVER () AS n FROM orders)"


@query(RANKED + " SELECT o_orderkey, rank, CASE WHEN rank < trunc(0.7::DOUBLE * n) THEN 'train' WHEN rank < trunc(0.7::DOUBLE * n) + trunc(0.15::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM ranked")
def split_random(spark, d):
    return P.split_random(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 3).select("o_orderkey", "rank", "split")


@query(SERIES + " SELECT event_id, CASE WHEN i < floor(0.8::DOUBLE * n) THEN 'train' ELSE 'test' END AS split FROM series")
def split_temporal(spark, d):
    return P.split_temporal(series(spark, d)).select("event_id", "split")


@query("SELECT event_id, CASE WHEN user_id <= 8 THEN 'train' WHEN user_id <= 11 THEN 'val' ELSE 'test' END AS split FROM events WHERE user_id BETWEEN 1 AND 14")
def split_by_subject(spark, d):
    return P.split_by_subject(table(spark, d, "events").select("event_id", "user_id"), "user_id", {"train": range(1, 9), "val": range(9, 12), "test": range(12, 15)}).select("event_id", "split")


@query(RANKED + " SELECT o_orderkey, rank // 64 AS batch_id FROM ranked")
def make_minibatches(spark, d):
    return P.minibatches(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 64, 3).select("o_orderkey", "batch_id")


TOP = ROUTING + ", flat AS (SELECT event_id, unnest(range(0, 8)) AS expert, unnest(logits) AS l FROM routing), top AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY l DESC, expert) AS r, max(l) OVER (PARTITION BY event_id) AS m FROM flat)"


@query(TOP + " SELECT event_id, CAST(expert AS BIGINT) AS expert, round(exp(l - m) / sum(exp(l - m)) OVER (PARTITION BY event_id), 6) AS weight FROM top WHERE r <= 2")
def topk_routing(spark, d):
    return routing(spark, d).select("event_id", F.inline(P.topk(F.col("logits"), 2))).select("event_id", "expert", F.round("weight", 6).alias("weight"))


KINDS = "WITH " + STAYS + ", kinds AS (SELECT DISTINCT stay_id, event_type FROM stays JOIN events ON user_id = subject AND ts BETWEEN intime AND outtime)"


def stay_kinds(spark, d):
    """stay_id and event_type of what falls into each stay, ends included: the modalities that a stay has."""
    e = table(spark, d, "events").select(F.col("user_id").alias("subject"), "event_type", "ts")
    return J.interval_pairs(e, stays(spark, d), ["subject"], "ts", "intime", "outtime").select("stay_id", "event_type").distinct()


@query(KINDS + " SELECT stay_id FROM kinds WHERE event_type = 'error' INTERSECT SELECT stay_id FROM kinds WHERE event_type = 'click' INTERSECT SELECT stay_id FROM kinds WHERE event_type = 'view'")
def intersect_stays(spark, d):
    k = stay_kinds(spark, d)
    one = lambda kind: k.where(F.col("event_type") == kind).select("stay_id")
    return one("error").intersect(one("click")).intersect(one("view"))


@query(KINDS + " SELECT DISTINCT stay_id FROM kinds WHERE event_type IN ('error', 'purchase')")
def union_stays(spark, d):
    k = stay_kinds(spark, d)
    return k.where("event_type = 'error'").select("stay_id").union(k.where("event_type = 'purchase'").select("stay_id")).distinct()


@query("SELECT event_id, value, NULL::VARCHAR AS kind FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, NULL, event_type FROM events WHERE event_type <> 'view'")
def union_all_events(spark, d):
    e = table(spark, d, "events")
    return e.where("event_type = 'view'").select("event_id", "value").unionByName(e.where("event_type <> 'view'").select("event_id", F.col("event_type").alias("kind")), True)


@query("SELECT DISTINCT event_type AS label FROM events WHERE user_id <= 3 UNION SELECT DISTINCT event_type FROM events WHERE user_id > 3")
def union_label_sets(spark, d):
    e = table(spark, d, "events")
    return e.where("user_id <= 3").select(F.col("event_type").alias("label")).union(e.where("user_id > 3").select("event_type")).distinct()


# functions


@query("""WITH RECURSIVE l AS (SELECT event_id, event_id % (SELECT count(*) FROM documents) AS doc FROM events WHERE event_type = 'signup'),
lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k, line, len(regexp_extract_all(line, '[^ \\t]+')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS p FROM documents) WHERE len(regexp_extract_all(line, '[^ \\t]+')) > 0),
walk AS (SELECT doc_id, k, 0 AS c, n AS held FROM lines WHERE k = 1 UNION ALL SELECT w.doc_id, l.k, CASE WHEN w.held + l.n <= 120 THEN w.c ELSE w.c + 1 END, CASE WHEN w.held + l.n <= 120 THEN w.held + l.n ELSE l.n END FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.k = w.k + 1)
SELECT doc_id, CAST(c AS BIGINT) AS chunk_id, CAST(sum(n) AS BIGINT) AS tokens, md5(string_agg(line, ' ' ORDER BY k)) AS digest FROM walk JOIN lines USING (doc_id, k) GROUP BY doc_id, c""")
def chunk_lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(chunks(F.col("text"), 120)).alias("chunk_id", "c"))
    return docs.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.col("c.tokens").alias("tokens"), F.md5("c.chunk").alias("digest"))


def bin_sql(x: str, low: str, high: str, bins: int) -> str:
    """The same arithmetic as equal_width_bin."""
    width = f"(({high} - {low}) / {float(bins)}::DOUBLE)"
    return "(" + " + ".join(f"CAST({x} >= {low} + {float(k)}::DOUBLE * {width} AS BIGINT)" for k in range(1, bins)) + ")"


@query(SERIES + ", e AS (SELECT *, min(x1) OVER (PARTITION BY subject) AS lo, max(x1) OVER (PARTITION BY subject) AS hi FROM series) SELECT event_id, " + bin_sql("x1", "lo", "hi", 5) + " AS bin FROM e")
def equal_width_bin(spark, d):
    s = series(spark, d)
    e = s.groupBy("subject").agg(F.min("x1").alias("lo"), F.max("x1").alias("hi"))
    return s.join(e, "subject").select("event_id", A.equal_width_bin(F.col("x1"), F.col("lo"), F.col("hi"), 5).alias("bin"))


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY CAST(json_extract_string(props, '$.k') AS BIGINT)) - 1 AS BIGINT) AS code FROM events")
def dense_rank_code(spark, d):
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return C.label_index(e, "k", "code").select("event_id", "code")


@query("WITH " + HALVES + " SELECT vec_id, round(list_avg(a), 6) AS mean FROM halves")
def row_mean(spark, d):
    return halves(spark, d).select("vec_id", F.round(A.row_mean(F.col("a")), 6).alias("mean"))


SOFT = ROUTING + ", flat AS (SELECT event_id, unnest(range(0, 8)) AS expert, unnest(logits) AS l FROM routing), soft AS (SELECT event_id, expert, l, exp(l - max(l) OVER w) / sum(exp(l)) OVER w * exp(max(l) OVER w) AS p FROM flat WINDOW w AS (PARTITION BY event_id))"


@query(SOFT + " SELECT event_id, CAST(expert AS BIGINT) AS expert, round(p, 6) AS p, round(ln(p), 6) AS logp FROM soft")
def softmax(spark, d):
    r = routing(spark, d).select("event_id", F.posexplode(F.arrays_zip(A.softmax(F.col("logits")).alias("p"), A.log_softmax(F.col("logits")).alias("logp"))).alias("expert", "v"))
    return r.select("event_id", F.col("expert").cast("long").alias("expert"), F.round("v.p", 6).alias("p"), F.round("v.logp", 6).alias("logp"))


@query(SOFT + " SELECT event_id, CAST(arg_min(expert, (-l, expert)) AS BIGINT) AS best FROM soft GROUP BY event_id")
def argmax(spark, d):
    return routing(spark, d).select("event_id", A.argmax(F.col("logits")).alias("best"))


@query(SOFT + " SELECT event_id, round(sum(p * ln(p / (1 / 8.0::DOUBLE))), 6) AS kl, round(sum(p * ln(p / ((p + 0.125::DOUBLE) / 2)) + 0.125::DOUBLE * ln(0.125::DOUBLE / ((p + 0.125::DOUBLE) / 2))) / 2, 6) AS jsd FROM soft GROUP BY event_id")
def divergences(spark, d):
    p, u = A.softmax(F.col("logits")), F.array_repeat(F.lit(0.125), 8)
    return routing(spark, d).select("event_id", F.round(A.kl(p, u), 6).alias("kl"), F.round(A.jsd(p, u), 6).alias("jsd"))


@query(SOFT + " SELECT event_id, round(sum(ln(p)), 6) AS total FROM soft GROUP BY event_id")
def log_softmax(spark, d):
    return routing(spark, d).select("event_id", F.round(A.total(A.log_softmax(F.col("logits"))), 6).alias("total"))


PARTS = SOFT + ", two AS (SELECT a.event_id, a.expert, a.p, b.p AS q FROM soft a JOIN soft b ON b.event_id = a.event_id AND b.expert = 7 - a.expert)"


@query(PARTS + " SELECT event_id, round(sum(p * ln(p / q)), 6) AS kl FROM two GROUP BY event_id")
def kl(spark, d):
    p = A.softmax(F.col("logits"))
    return routing(spark, d).select("event_id", F.round(A.kl(p, F.reverse(p)), 6).alias("kl"))


@query(PARTS + " SELECT event_id, round(sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2, 6) AS jsd FROM two GROUP BY event_id")
def jsd(spark, d):
    p = A.softmax(F.col("logits"))
    return routing(spark, d).select("event_id", F.round(A.jsd(p, F.reverse(p)), 6).alias("jsd"))


@query("WITH rows AS (SELECT event_id, value AS r, value * 2 AS mi FROM events) SELECT event_id, round(CASE WHEN mi > 1e-9 THEN r / mi ELSE 0 END, 6) AS \"R_norm\" FROM rows")
def normalize_terms(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("value").alias("R"), F.lit(0.0).alias("U1"), F.lit(0.0).alias("U2"), F.lit(0.0).alias("S"), (F.col("value") * 2).alias("MI"))
    return G.normalize_terms(rows).select("event_id", F.round("R_norm", 6).alias("R_norm"))


@query(LENGTHS + ", m AS (SELECT max(n) AS m FROM lengths) SELECT CAST(t AS BIGINT) AS t, CAST(j AS BIGINT) AS dim, round(CASE WHEN j % 2 = 0 THEN sin(t / pow(10000, (j // 2 * 2) / 16.0)) ELSE cos(t / pow(10000, (j // 2 * 2) / 16.0)) END, 6) AS value FROM m, range(0, m) a(t), range(0, 16) b(j)")
def positional_encoding(spark, d):
    m = table(spark, d, "events").groupBy("user_id").count().agg(F.max("count").alias("m"))
    grid = m.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("t")).select("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("dim"))
    angle = F.col("t") / F.pow(F.lit(10000.0), F.floor(F.col("dim") / 2) * 2 / 16.0)
    return grid.select("t", "dim", F.round(F.when(F.col("dim") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)), 6).alias("value"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
