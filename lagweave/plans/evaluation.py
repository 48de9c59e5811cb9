"""Queries over sources and sinks (2.A), cohort tasks and metrics (2.L), routing diagnostics (2.M) and extension points (2.N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagweave.operators import cohort as H
from lagweave.operators import joins as J
from lagweave.operators import metrics as M
from lagweave.operators import routing as R
from lagweave.operators import sampling as P
from lagweave.operators import series as S
from lagweave.operators.aggregate import TERMS, average_over_lags
from lagweave.operators.aggregate import apply_standardizer as standardized
from lagweave.operators.aggregate import fit_standardizer as fit_scaler
from lagweave.functions import arrays as A
from lagweave.functions.dates import compose_datetime
from lagweave.operators.joins import interval_join_first
from lagweave.sources import readers as X
from lagweave.sources.storage import new_path as scratch

from .base import MEASURES, ROUTING, SCORES, SERIES, STAYS, measures, query, routing, scores, series, stays, table
from .cleaning import LABELLED, TWO, died, two_level
from .information import RUS, term_rows
from .timeseries import SOFT, TOP, WINDOWS


@query("SELECT user_id AS subject_id, CAST(event_id AS DOUBLE) AS timestamp, CASE WHEN event_id % 7 <> 0 THEN value END AS heart_rate FROM events")
def scan_sensor_text(spark, d):
    """Written as sensor files, one folder a subject, and read back by the fixed layout."""
    path = scratch(spark, "sensor")
    e = table(spark, d, "events")
    line = F.concat_ws(" ", F.col("event_id").cast("string"), F.when(F.col("event_id") % 7 != 0, F.col("value").cast("string")).otherwise("NaN"), F.col("user_id").cast("string"))
    e.select(line.alias("value")).write.text(path)
    got = X.read_sensor_text(spark, path, ["timestamp", "heart_rate", "subject"])
    return got.select(F.col("subject").cast("long").alias("subject_id"), "timestamp", "heart_rate")


@query("SELECT o_orderkey, o_totalprice, CAST(epoch(o_orderdate) AS BIGINT) AS at FROM orders")
def scan_csv_gz(spark, d):
    path = scratch(spark, "csv")
    table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate").write.option("header", True).option("compression", "gzip").csv(path)
    got = X.read_csv_gz(spark, path, "o_orderkey long, o_totalprice double, o_orderdate timestamp_ntz", 8)
    return got.select("o_orderkey", "o_totalprice", F.unix_timestamp("o_orderdate").alias("at"))


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '1%'")
def scan_parquet(spark, d):
    path = scratch(spark, "stage")
    table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").write.partitionBy("o_orderpriority").parquet(path)
    return spark.read.parquet(path).where("o_orderpriority like '1%'").select("o_orderkey", "o_custkey", "o_orderpriority")


@query("SELECT doc_id, concat('p', substr(CAST(10000 + doc_id AS VARCHAR), 1, 2), '/p', CAST(10000 + doc_id AS VARCHAR), '/s', CAST(doc_id % 7 AS VARCHAR), '/', lang, '.jpg') AS path FROM documents WHERE doc_id % 3 <> 0")
def scan_binary_assets(spark, d):
    """Rows whose asset is there: two thirds of the files are written, a listing tells which."""
    root = scratch(spark, "assets")
    rows = table(spark, d, "documents").select("doc_id", "source", X.asset_path(F.col("doc_id") + 10000, F.col("doc_id") % 7, F.col("lang")).alias("path"))
    X.write_assets(rows.where("doc_id % 3 <> 0"), "path", "source", root)
    return X.existing_assets(spark, rows.select("doc_id", "path"), root, "path", "*.jpg")


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS DOUBLE) AS words FROM documents")
def batch_map(spark, d):
    coded = X.batch_map(table(spark, d, "documents").select("doc_id", "text"), "text", "v", X.hashing_encoder(8))
    return coded.select("doc_id", A.total(F.col("v")).alias("words"))


@query("WITH z AS (SELECT 1)" + RUS + " SELECT cohort, mod1, lag, round(r, 6) AS r, round(s, 6) AS s FROM t")
def write_results_nested(spark, d):
    """Nested, written by cohort, read back flat."""
    path = scratch(spark, "results")
    X.write_results(X.nest_results(term_rows(spark, d), ["cohort", "mod1"]), path, "cohort")
    return X.read_results_flat(spark, path).select(F.col("cohort").cast("long").alias("cohort"), "mod1", "lag", F.round("R", 6).alias("r"), F.round("S", 6).alias("s"))


@query("SELECT CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total FROM (SELECT count(*) AS n, CAST(round(sum(n_chars)) AS BIGINT) AS total FROM documents)")
def write_metrics_json(spark, d):
    path = scratch(spark, "metrics")
    X.write_metrics_json(table(spark, d, "documents").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total")), path)
    return spark.read.schema("n long, total long").json(path)


@query(SCORES + ", p AS (SELECT doc_id, y, CAST(score >= 0.5 AS BIGINT) AS predicted FROM scores) SELECT * FROM p")
def write_predictions(spark, d):
    path = scratch(spark, "predictions")
    scores(spark, d).select("doc_id", "y", (F.col("score") >= 0.5).cast("long").alias("predicted")).write.parquet(path)
    return spark.read.parquet(path)


@query("SELECT doc_id, CAST(length(coalesce(text, '')) AS DOUBLE) AS size, CAST(len(string_split(coalesce(text, ''), chr(10))) AS DOUBLE) AS lines FROM documents")
def udf_encoder(spark, d):
    """An encoder given by the user: here, length and number of lines."""
    coded = X.batch_map(table(spark, d, "documents").select("doc_id", "text"), "text", "v", lambda: lambda texts: [[float(len(t or "")), float((t or "").count("\n") + 1)] for t in texts])
    return coded.select("doc_id", F.get("v", F.lit(0)).alias("size"), F.get("v", F.lit(1)).alias("lines"))


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def write_parquet(spark, d):
    path = scratch(spark, "written")
    table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("WITH z AS (SELECT 1)" + RUS + " SELECT mod1, CAST(count(*) AS BIGINT) AS lags, round(max(r), 6) AS most FROM t GROUP BY mod1")
def read_results_flat(spark, d):
    path = scratch(spark, "results")
    X.write_results(X.nest_results(term_rows(spark, d), ["cohort", "mod1"]), path, "cohort")
    return X.read_results_flat(spark, path).groupBy("mod1").agg(F.count("*").alias("lags"), F.round(F.max("R"), 6).alias("most"))


@query("SELECT event_type AS method, CAST(user_id % 8 AS BIGINT) AS run_id, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'view' GROUP BY ALL")
def run_tag(spark, d):
    """Runs are partition columns, so one run's results are found by pruning."""
    path = scratch(spark, "runs")
    table(spark, d, "events").select("event_id", F.col("event_type").alias("method"), (F.col("user_id") % 8).alias("run_id")).write.partitionBy("method", "run_id").parquet(path)
    return spark.read.parquet(path).where("method = 'view'").groupBy("method", F.col("run_id").cast("long").alias("run_id")).agg(F.count("*").alias("n"))


# cohort tasks


TASK = LABELLED + ", held AS (SELECT a.hadm_id, any_value(died) AS died, count(e.event_id) AS n FROM died JOIN admissions a USING (hadm_id) JOIN events e ON e.user_id = a.subject AND e.ts BETWEEN a.admittime AND a.admittime + INTERVAL 48 HOUR GROUP BY 1 HAVING count(e.event_id) >= 2), r AS (SELECT *, row_number() OVER (ORDER BY md5(concat('5:', CAST(hadm_id AS VARCHAR))), hadm_id) - 1 AS rank, count(*) OVER () AS total FROM held), cut AS (SELECT *, CASE WHEN rank < trunc(0.7::DOUBLE * total) THEN 'train' WHEN rank < trunc(0.7::DOUBLE * total) + trunc(0.15::DOUBLE * total) THEN 'val' ELSE 'test' END AS split FROM r)"


def first_hours(events, stays):
    """Events in the first 48 hours of each admission."""
    return J.interval_pairs(events, stays.withColumn("until", F.col("admittime") + F.expr("interval 48 hours")), ["subject"], "ts", "admittime", "until", 2)


def task_rows(spark, d):
    """Admissions with at least two events in 48 hours, their label and split."""
    e = table(spark, d, "events").select(F.col("user_id").alias("subject"), "ts", "value")
    a = died(spark, d)
    rows = first_hours(e, a)
    held = rows.groupBy("hadm_id").agg(F.first("died").alias("died"), F.count("*").alias("n"), F.avg("value").alias("value")).where("n >= 2")
    return P.split_random(held, "hadm_id", 5)


@query(TASK + " SELECT split, CAST(count(*) AS BIGINT) AS stays, CAST(sum(n) AS BIGINT) AS rows_seen FROM cut GROUP BY split")
def write_stays(spark, d):
    """Nested stays by split, with the scaler's parameters beside them, written and read back."""
    path = scratch(spark, "stays")
    t = task_rows(spark, d)
    e = table(spark, d, "events").select(F.col("user_id").alias("subject"), "ts", "event_id", "value")
    rows = first_hours(e, died(spark, d))
    nested = H.ordered(rows, "hadm_id", "ts", ["event_id", "value"], "series")
    t.select("hadm_id", "died", "split").join(nested, "hadm_id").write.partitionBy("split").parquet(f"{path}/stays")
    fit_scaler(t.where("split = 'train'"), ["value"]).write.parquet(f"{path}/scaler")
    return spark.read.parquet(f"{path}/stays").groupBy("split").agg(F.count("*").alias("stays"), F.sum(F.size("series")).alias("rows_seen"))


IMAGES = TWO + ", shot AS (SELECT event_id, user_id, date_trunc('second', ts) AS at FROM events WHERE event_id % 17 <> 0), inside AS (SELECT x.event_id, s.stay_id, row_number() OVER (PARTITION BY x.event_id ORDER BY s.intime, s.stay_id) AS r FROM shot x JOIN stays s ON s.subject = x.user_id AND x.at BETWEEN s.intime AND s.outtime)"


@query(IMAGES + " SELECT x.event_id, CAST(epoch(x.at) AS BIGINT) AS at, i.stay_id, round(date_diff('microsecond', s.intime, x.at) / 3.6e9, 6) AS icu FROM shot x LEFT JOIN (SELECT * FROM inside WHERE r = 1) i USING (event_id) LEFT JOIN stays s USING (stay_id)")
def build_images(spark, d):
    """Image metadata whose date and time come as numbers, invalid ones dropped, with the stay they fall in."""
    day = F.when(F.col("event_id") % 17 == 0, "20241301").otherwise(F.date_format("ts", "yyyyMMdd"))
    time = F.concat(F.date_format("ts", "HHmmss").cast("long").cast("string"), F.lit(".5"))
    shots = table(spark, d, "events").select("event_id", F.col("user_id").alias("subject"), compose_datetime(day, time).cast("timestamp_ntz").alias("at")).where("at is not null")
    found = interval_join_first(shots, stays(spark, d), ["subject"], "event_id", "at", "stay_id", "intime", "outtime")
    return found.select("event_id", F.unix_timestamp(F.col("at").cast("timestamp")).alias("at"), "stay_id", F.round(S.hours_between(F.col("intime"), F.col("at")), 6).alias("icu"))


@query(TWO + " SELECT t.event_id, t.hadm_id, t.stay_id, round(date_diff('microsecond', a.admittime, t.ts) / 3.6e9, 6) AS hosp, round(date_diff('microsecond', s.intime, t.ts) / 3.6e9, 6) AS icu, CAST(length(doc.text) AS BIGINT) AS size FROM two t LEFT JOIN admissions a USING (hadm_id) LEFT JOIN stays s USING (stay_id) JOIN documents doc ON doc.doc_id = t.event_id % (SELECT count(*) FROM documents)")
def build_notes(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("_d"), F.length("text").cast("long").alias("size"))
    t = two_level(spark, d).withColumn("_d", F.col("event_id") % F.lit(docs.count()))
    h = lambda c: F.round(S.hours_between(F.col(c), F.col("ts")), 6)
    return t.join(docs, "_d").select("event_id", "hadm_id", "stay_id", h("admittime").alias("hosp"), h("intime").alias("icu"), "size")


@query(WINDOWS + ", labels2 AS (SELECT subject, w, y, row_number() OVER (PARTITION BY subject, w ORDER BY count(*) DESC, y) AS r FROM windows GROUP BY subject, w, y) SELECT w.subject, w.w, l.y AS label, CAST(count(*) AS BIGINT) AS n, round(sum(x1), 6) AS total FROM windows w JOIN labels2 l ON l.subject = w.subject AND l.w = w.w AND l.r = 1 GROUP BY ALL")
def windows_dataset(spark, d):
    w = H.windows_dataset(series(spark, d), ["subject"], 16, 8, ["x1"], "y")
    return w.select("subject", "w", "label", F.size("rows").cast("long").alias("n"), F.round(F.aggregate("rows", F.lit(0.0), lambda s, x: s + x["x1"]), 6).alias("total"))


@query(WINDOWS + RUS + ", a AS (SELECT cohort, avg(r) AS r, avg(u1) AS u1, avg(u2) AS u2, avg(s) AS s FROM t WHERE mi > 1e-9 GROUP BY cohort), n AS (SELECT subject, w, count(*) AS n FROM windows GROUP BY ALL) SELECT subject, w, CAST(n AS BIGINT) AS n, round(r, 6) AS \"R\", round(u1, 6) AS \"U1\", round(u2, 6) AS \"U2\", round(s, 6) AS \"S\" FROM n LEFT JOIN a ON a.cohort = n.subject % 8")
def attach_rus_terms(spark, d):
    """Each window of a subject with the mean terms of its cohort; Spark's size check decides how the terms travel."""
    means = average_over_lags(term_rows(spark, d), ["cohort"]).select("cohort", *[F.round(t, 6).alias(t) for t in TERMS])
    w = H.windows_dataset(series(spark, d), ["subject"], 16, 8, ["x1"], "y").select("subject", "w", F.size("rows").cast("long").alias("n"), (F.col("subject") % 8).alias("cohort"))
    return w.join(means, "cohort", "left").drop("cohort")


PREDICTED = SCORES + ", p AS (SELECT doc_id, y, score, CAST(score >= 0.5 AS BIGINT) AS predicted FROM scores), l AS (SELECT y AS label FROM p UNION SELECT predicted FROM p), m AS (SELECT a.label AS actual, b.label AS predicted, CAST((SELECT count(*) FROM p WHERE y = a.label AND predicted = b.label) AS BIGINT) AS n FROM l a, l b)"


def matrix(spark, d):
    return M.confusion_matrix(scores(spark, d).withColumn("predicted", (F.col("score") >= 0.5).cast("long")), "y", "predicted")


@query(PREDICTED + " SELECT * FROM m")
def confusion_matrix(spark, d):
    return matrix(spark, d)


PER_CLASS = PREDICTED + ", c AS (SELECT label, (SELECT n FROM m WHERE actual = label AND predicted = label) AS hit, (SELECT sum(n) FROM m WHERE actual = label) AS support, (SELECT sum(n) FROM m WHERE predicted = label) AS named FROM l), pc AS (SELECT label, coalesce(hit / nullif(named, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, support FROM c), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pc)"


@query(PER_CLASS + " SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f")
def class_metrics(spark, d):
    c = M.class_metrics(matrix(spark, d))
    return c.withColumns({x: F.round(x, 6) for x in ("precision", "recall", "f1")})


@query(PER_CLASS + " SELECT round((SELECT sum(n) FROM m WHERE actual = predicted) / (SELECT sum(n) FROM m), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM f")
def classification_metrics(spark, d):
    c = M.overall_metrics(matrix(spark, d))
    return c.select(*[F.round(x, 6).alias(x) for x in c.columns])


@query(SCORES + " SELECT DISTINCT round(score, 9) AS score, CAST(sum(CAST(y = 1 AS BIGINT)) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(CAST(y <> 1 AS BIGINT)) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM scores")
def roc_curve(spark, d):
    return M.roc_curve(scores(spark, d), "y", "score").select(F.round("score", 9).alias("score"), "tp", "fp")


@query(SCORES + ", r AS (SELECT y, avg(k) OVER (PARTITION BY score) AS k FROM (SELECT y, score, row_number() OVER (ORDER BY score) AS k FROM scores)) SELECT round((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y <> 1)), 6) AS auc FROM r")
def roc_auc(spark, d):
    return M.roc_auc(scores(spark, d), "y", "score").select(F.round("auc", 6).alias("auc"))


@query(SCORES + " SELECT round(avg(-ln(CASE WHEN y = 1 THEN least(greatest(score, 1e-12), 1 - 1e-12) ELSE 1 - least(greatest(score, 1e-12), 1 - 1e-12) END)), 6) AS loss FROM scores")
def log_loss(spark, d):
    return M.log_loss(scores(spark, d), "y", "score").select(F.round("loss", 6).alias("loss"))


CLASSED = ROUTING + ", p AS (SELECT event_id, y, k, exp(logits[k + 1]) / sum(exp(logits[k + 1])) OVER (PARTITION BY event_id) AS p FROM routing JOIN (SELECT event_id, y FROM series) USING (event_id), range(0, 5) r(k))"


def classed(spark, d):
    """Predictions of five classes: the event's type is the truth, the first five logits of the routing log give the shares."""
    y = series(spark, d).select("event_id", "y")
    return routing(spark, d).select("event_id", A.softmax(F.slice("logits", 1, 5)).alias("p")).join(y, "event_id")


@query(CLASSED + " SELECT event_id, max(y) AS y, arg_max(k, p) AS predicted, CAST(count(*) AS BIGINT) AS classes, round(max(p), 6) AS most FROM p GROUP BY event_id")
def write_class_predictions(spark, d):
    """Truth, prediction and the array of class probabilities, written and read back."""
    path = scratch(spark, "predictions")
    classed(spark, d).select("event_id", "y", A.argmax(F.col("p")).alias("predicted"), "p").write.parquet(path)
    return spark.read.parquet(path).select("event_id", "y", "predicted", F.size("p").cast("long").alias("classes"), F.round(F.array_max("p"), 6).alias("most"))


@query(CLASSED + ", r AS (SELECT k, y = k AS pos, avg(i) OVER (PARTITION BY k, p) AS i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p) AS i FROM p)), a AS (SELECT k, count(*) FILTER (pos) AS n, (sum(i) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS auc FROM r GROUP BY k) SELECT round(sum(auc * n) / sum(n), 6) AS auc FROM a")
def roc_auc_classes(spark, d):
    return M.roc_auc_classes(classed(spark, d), "y", "p", 5).select(F.round("auc", 6).alias("auc"))


@query(CLASSED + " SELECT round(avg(-ln(p)), 6) AS loss FROM p WHERE k = y")
def log_loss_classes(spark, d):
    return M.log_loss_classes(classed(spark, d), "y", "p").select(F.round("loss", 6).alias("loss"))


@query("WITH e AS (SELECT user_id AS epoch, round(avg(value), 6) AS metric FROM events GROUP BY 1) SELECT epoch, metric FROM e ORDER BY metric DESC, epoch LIMIT 1")
def best_epoch(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("metric"))
    return M.best_epoch(e, "epoch", "metric")


# routing


def chosen(spark, d):
    r = routing(spark, d)
    return r.select("sample", "modality", "event_id", "t", A.softmax(F.col("logits")).alias("probs"), P.top_indices(F.col("logits"), 2).alias("experts"))


CHOSEN = TOP + ", chosen AS (SELECT event_id, modality, CAST(expert AS BIGINT) AS expert FROM top JOIN routing USING (event_id) WHERE r <= 2), ratios AS (SELECT g.modality, g.expert, CAST(count(c.event_id) AS BIGINT) AS n FROM (SELECT DISTINCT modality, CAST(k AS BIGINT) AS expert FROM routing, range(0, 8) x(k)) g LEFT JOIN chosen c ON c.modality = g.modality AND c.expert = g.expert GROUP BY ALL)"


@query(CHOSEN + " SELECT modality, expert, n, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY modality), 6) AS ratio FROM ratios")
def expert_activation_ratio(spark, d):
    return R.activation_ratio(chosen(spark, d), 8).withColumn("ratio", F.round("ratio", 6))


@query(CHOSEN + ", q AS (SELECT modality, expert, n / sum(n) OVER (PARTITION BY modality) AS ratio FROM ratios) SELECT modality, expert, round(CASE WHEN sum(ratio) OVER (PARTITION BY expert) = 0 THEN 0 ELSE ratio / sum(ratio) OVER (PARTITION BY expert) END, 6) AS share FROM q")
def expert_modality_composition(spark, d):
    return R.expert_composition(R.activation_ratio(chosen(spark, d), 8)).select("modality", "expert", F.round("share", 6).alias("share"))


LOGITS = SOFT.split(", soft AS")[1]


@query(CHOSEN + ", soft AS" + LOGITS + ", p AS (SELECT CAST(expert AS BIGINT) AS expert, avg(p) AS p FROM soft GROUP BY 1), n AS (SELECT expert, sum(n) AS n FROM ratios GROUP BY 1) SELECT round(8 * sum(p * n) / sum(n), 6) AS loss FROM p JOIN n USING (expert)")
def load_balance(spark, d):
    return R.load_balance(chosen(spark, d), 8).select(F.round("loss", 6).alias("loss"))


def token_pairs(spark, d):
    """Tokens of a sample's day stand for time steps: the first token of each modality."""
    c = chosen(spark, d).join(table(spark, d, "events").select("event_id", F.to_date("ts").cast("string").alias("day")), "event_id")
    first = S.dedupe_first(c.select("sample", "day", "modality", "event_id", "probs"), ["sample", "day", "modality"], ["event_id"])
    return R.modality_pairs(first.select("sample", "day", "modality", "probs"), ["sample", "day"])


PAIRED = SOFT + ", day AS (SELECT user_id AS sample, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS modality, min(event_id) AS event_id FROM events GROUP BY ALL), pairs AS (SELECT a.sample, a.day, a.modality AS m1, b.modality AS m2, x.expert, x.p AS p1, z.p AS p2 FROM day a JOIN day b ON a.sample = b.sample AND a.day = b.day AND a.modality < b.modality JOIN soft x ON x.event_id = a.event_id JOIN soft z ON z.event_id = b.event_id AND z.expert = x.expert), jsd AS (SELECT sample, day, m1, m2, sum(p1 * ln(p1 / ((p1 + p2) / 2)) + p2 * ln(p2 / ((p1 + p2) / 2))) / 2 AS j, 1 - sum(p1 + p2) FILTER (expert IN (6, 7)) / 2 AS u FROM pairs GROUP BY ALL)"


GATED = PAIRED + RUS + """, tn AS (SELECT cohort, lag, mod1 AS m, mi, u1 / mi AS u, r / mi AS r, s / mi AS s FROM t WHERE mi > 0), g AS (SELECT j.*, a.u AS ua, b.u AS ub, CASE WHEN a.mi > 0 AND b.mi > 0 THEN least(a.r, b.r) END AS r, CASE WHEN a.mi > 0 AND b.mi > 0 THEN least(a.s, b.s) END AS s
FROM jsd j LEFT JOIN tn a ON a.cohort = j.sample % 8 AND a.lag = day(CAST(j.day AS DATE)) % 6 AND a.m = j.m1 LEFT JOIN tn b ON b.cohort = j.sample % 8 AND b.lag = day(CAST(j.day AS DATE)) % 6 AND b.m = j.m2)"""


LIMITS = {"U": 0.22, "R": 0.2, "S": 0.2}


def gated(spark, d):
    """Pairs with the terms of their time: each modality's shares of a cohort stand for its timeline, a pair has the lesser ones."""
    t = term_rows(spark, d).where("MI > 0").select("cohort", F.col("lag").alias("step"), F.col("mod1").alias("m"), (F.col("U1") / F.col("MI")).alias("u"), (F.col("R") / F.col("MI")).alias("r"), (F.col("S") / F.col("MI")).alias("s"))
    one, two = (t.select("cohort", "step", F.col("m").alias(f"m{k}"), F.col("r").alias(f"r{k}"), F.col("s").alias(f"s{k}")) for k in (1, 2))
    shared = one.join(two, ["cohort", "step"]).where("m1 < m2").select("cohort", "step", "m1", "m2", F.least("r1", "r2").alias("r"), F.least("s1", "s2").alias("s"))
    pairs = token_pairs(spark, d).withColumns({"cohort": F.col("sample") % 8, "step": F.dayofmonth(F.to_date("day")).cast("long") % 6})
    return R.gate(pairs, t, shared, ["cohort", "step"])


@query(GATED + " SELECT CAST(count(*) AS BIGINT) AS n, round(coalesce(-avg(j), 0), 6) AS loss FROM g WHERE ua > 0.22 AND ub > 0.22")
def uniqueness_divergence(spark, d):
    return R.divergence_where(gated(spark, d), R.counts_for("U", LIMITS["U"]), -1.0).select("n", F.round("loss", 6).alias("loss"))


@query(GATED + " SELECT CAST(count(*) AS BIGINT) AS n, round(coalesce(avg(j), 0), 6) AS loss FROM g WHERE r > 0.2")
def redundancy_divergence(spark, d):
    return R.divergence_where(gated(spark, d), R.counts_for("R", LIMITS["R"])).select("n", F.round("loss", 6).alias("loss"))


@query(GATED + " SELECT CAST(count(*) AS BIGINT) AS n, round(coalesce(avg(u), 0), 6) AS loss FROM g WHERE s > 0.2")
def synergy_assignment(spark, d):
    return R.synergy_assignment(gated(spark, d), R.counts_for("S", LIMITS["S"]), [6, 7]).select("n", F.round("loss", 6).alias("loss"))


@query(GATED + " SELECT 'U' AS term, CAST(count(*) AS BIGINT) AS n, round(coalesce(-avg(j), 0), 6) AS loss FROM g WHERE ua > 0.22 AND ub > 0.22 UNION ALL SELECT 'R', CAST(count(*) AS BIGINT), round(coalesce(avg(j), 0), 6) FROM g WHERE r > 0.2 UNION ALL SELECT 'S', CAST(count(*) AS BIGINT), round(coalesce(avg(u), 0), 6) FROM g WHERE s > 0.2")
def rus_gated_losses(spark, d):
    """The three losses in one pass over the pairs."""
    return R.gated_losses(gated(spark, d), LIMITS, [6, 7]).select("term", "n", F.round("loss", 6).alias("loss"))


@query(TOP + ", w AS (SELECT event_id, expert, exp(l - m) / sum(exp(l - m)) OVER (PARTITION BY event_id) AS weight FROM top WHERE r <= 2), o AS (SELECT vec_id AS expert, unnest(range(1, 9)) AS p, unnest(embedding[1:8]) AS v FROM embeddings WHERE vec_id < 8) SELECT event_id, CAST(p - 1 AS BIGINT) AS pos, round(sum(weight * CAST(v AS DOUBLE)), 6) AS v FROM w JOIN o USING (expert) GROUP BY ALL")
def weighted_expert_mix(spark, d):
    w = routing(spark, d).select("event_id", F.inline(P.topk(F.col("logits"), 2)))
    o = table(spark, d, "embeddings").where("vec_id < 8").select(F.col("vec_id").alias("expert"), F.posexplode(F.slice("embedding", 1, 8)).alias("pos", "v"))
    mixed = R.weighted_mix(w, o.withColumn("v", F.col("v").cast("double")), ["event_id"])
    return mixed.select("event_id", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("v"))


# extension points


@query("SELECT doc_id, CAST(sum(len(regexp_extract_all(line, '[^ \\t]'))) AS BIGINT) AS tokens FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def udf_tokenizer(spark, d):
    """A token counter given by the user: here, characters that are no blanks."""
    from lagweave.functions.text import chunk_lines

    count = lambda t: F.regexp_count(t, F.lit(r"[^ \t]")).cast("long")
    c = table(spark, d, "documents").select("doc_id", chunk_lines(F.col("text"), 2000, count).alias("c"))
    return c.select("doc_id", F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x["tokens"]).alias("tokens"))


@query(SERIES + " SELECT a.subject, a.i, CAST(l.lag AS BIGINT) AS lag, a.x1 AS x, b.y FROM series a JOIN range(0, 4) l(lag) ON true JOIN series b ON b.subject = a.subject AND b.i = a.i + l.lag")
def udtf_lags(spark, d):
    """A table function, called in SQL for each series."""
    from lagweave.functions.udtf import register

    register(spark)
    series(spark, d).select("subject", "i", "x1", "y").createOrReplaceTempView("lagged_pairs_input")
    return spark.sql("SELECT key AS subject, i, lag, x, y FROM lagged_pairs(TABLE(lagged_pairs_input) PARTITION BY subject ORDER BY (i), 3)")
