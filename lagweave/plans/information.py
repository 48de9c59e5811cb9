"""Queries over information-theory operators (2.J) and learned decompositions (2.K)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagweave.functions import arrays as A
from lagweave.operators import aggregate as G
from lagweave.operators import info as I
from lagweave.operators import learned as L
from lagweave.operators import resampled as Q
from lagweave.operators import sampling as P
from lagweave.operators import series as S
from lagweave.sources.storage import written

from .base import GAPS, HALVES, SERIES, gaps, halves, query, series, table
from .timeseries import bin_sql

K = ["subject", "lag"]
LAGS, BINS = 5, 4


def lagged_sql(lags: int = LAGS, extra: str = "") -> str:
    bins = ", ".join(f"{bin_sql(c, f'min({c}) OVER w', f'max({c}) OVER w', BINS)} AS {b}" for c, b in (("x1", "b1"), ("x2", "b2"), ("y", "yb")))
    return SERIES + f""", lagged AS (SELECT a.subject, CAST(l.lag AS BIGINT) AS lag, a.x1, a.x2, CAST(b.y AS DOUBLE) AS y FROM series a JOIN range(0, {lags + 1}) l(lag) ON true JOIN series b ON b.subject = a.subject AND b.i = a.i + l.lag),
binned AS (SELECT subject, lag, {bins} FROM lagged WINDOW w AS (PARTITION BY subject, lag)),
hist AS (SELECT subject, lag, b1, b2, yb, CAST(count(*) AS BIGINT) AS n FROM binned GROUP BY ALL){extra}"""


HIST = lagged_sql()


def mi_sql(a: str, b: str, source: str = "hist", keys: str = "subject, lag") -> str:
    return f"(SELECT {keys}, greatest(0, sum(c / t * ln(c * t / (ca * cb)))) AS mi FROM (SELECT *, sum(c) OVER (PARTITION BY {keys}, {a}) AS ca, sum(c) OVER (PARTITION BY {keys}, {b}) AS cb, sum(c) OVER (PARTITION BY {keys}) AS t FROM (SELECT {keys}, {a}, {b}, CAST(sum(n) AS DOUBLE) AS c FROM {source} GROUP BY {keys}, {a}, {b})) GROUP BY {keys})"


def hist(spark, d, lags: int = LAGS):
    h = I.joint_hist_multilag(series(spark, d), ["subject"], [("x1", "x2")], "y", lags, BINS)
    return h.withColumn("lag", F.col("lag").cast("long")).drop("mod1", "mod2")


def rounded(df, *columns: str):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(HIST + " SELECT subject, b1, b2, yb, n, round(n / sum(n) OVER (PARTITION BY subject), 9) AS p FROM hist WHERE lag = 0")
def joint_hist(spark, d):
    h = hist(spark, d, 0).drop("lag")
    return G.share_of_total(h, "n", ["subject"], "p").withColumn("p", F.round("p", 9))


@query(HIST + " SELECT * FROM hist")
def joint_hist_multilag(spark, d):
    return hist(spark, d)


MULTI = "WITH " + HALVES + ", means AS (SELECT label AS y, list_avg(CAST(embedding[1:32] AS DOUBLE[])) AS m1, list_avg(CAST(embedding[33:64] AS DOUBLE[])) AS m2, list_min(embedding[1:32])::DOUBLE AS l1, list_max(embedding[1:32])::DOUBLE AS h1, list_min(embedding[33:64])::DOUBLE AS l2, list_max(embedding[33:64])::DOUBLE AS h2 FROM embeddings WHERE len(embedding) = 64), e AS (SELECT *, min(l1) OVER () AS a1, max(h1) OVER () AS z1, min(l2) OVER () AS a2, max(h2) OVER () AS z2 FROM means)"


@query(MULTI + f" SELECT b1, b2, yb, CAST(count(*) AS BIGINT) AS n FROM (SELECT {bin_sql('m1', 'a1', 'z1', 16)} AS b1, {bin_sql('m2', 'a2', 'z2', 16)} AS b2, CAST(y AS BIGINT) AS yb FROM e) GROUP BY ALL")
def joint_hist_multivariate(spark, d):
    """Edges from all numbers of a modality, the binned value is the row's mean."""
    return I.joint_hist_vectors(halves(spark, d), "a", "b", "y", 16)


@query(HIST + " SELECT subject, lag, b1, b2, yb, CAST(sum(n) AS BIGINT) AS n FROM hist GROUP BY GROUPING SETS ((subject, lag, b1), (subject, lag, b2), (subject, lag, yb), (subject, lag, b1, yb), (subject, lag, b2, yb), (subject, lag, b1, b2))")
def marginals(spark, d):
    return I.marginals(hist(spark, d), K)


@query(HIST + " SELECT subject, lag, round(mi, 6) AS mi FROM " + mi_sql("b1", "yb"))
def mutual_information(spark, d):
    return rounded(I.mutual_information(hist(spark, d), K, ["b1"], ["yb"]), "mi")


@query(HIST + " SELECT subject, round(mi / ln(2), 6) AS mi FROM " + mi_sql("b1", "b2") + " WHERE lag = 0")
def mi_static(spark, d):
    return rounded(I.mutual_information(hist(spark, d, 0), ["subject"], ["b1"], ["b2"], unit="bits"), "mi")


@query(HIST + " SELECT subject, lag, round(mi, 6) AS mi FROM " + mi_sql("b1, b2", "yb"))
def total_information(spark, d):
    return rounded(I.mutual_information(hist(spark, d), K, ["b1", "b2"], ["yb"]), "mi")


INFO = HIST + ", i1 AS " + mi_sql("b1", "yb") + ", i2 AS " + mi_sql("b2", "yb") + ", i12 AS " + mi_sql("b1, b2", "yb")


@query(INFO + " SELECT subject, lag, round(i1.mi + i2.mi - i12.mi, 6) AS co FROM i1 JOIN i2 USING (subject, lag) JOIN i12 USING (subject, lag)")
def co_information(spark, d):
    return rounded(I.information(hist(spark, d), K), "co").select("subject", "lag", "co")


@query(INFO + " SELECT subject, lag, round(i12.mi - i1.mi, 6) AS cmi FROM i1 JOIN i12 USING (subject, lag)")
def conditional_mi(spark, d):
    return rounded(I.conditional_mi(hist(spark, d), K, "b1", "b2"), "cmi")


@query(HIST + " SELECT DISTINCT subject, lag, true AS same_margins, true AS whole, true AS feasible, true AS least FROM hist")
def pid_coupling(spark, d):
    """Whether every coupling adds up to 1, has the counts' (x1, y) and (x2, y) margins, and is proven the least: the dual's numbers are
    feasible, and their value is within 1e-7 nats of the coupling's. All of it is counted by Spark from the solver's rows."""
    h = written(hist(spark, d), "counts")
    p = G.share_of_total(h, "n", K, "p").select(*K, "b1", "b2", "yb", "p", F.lit(0.0).alias("q"))
    rows = written(I.pid_coupling(h, K), "coupling")
    q = rows.where("b1 is not null and b2 is not null").withColumnRenamed("v", "q")
    both = p.union(q.select(*K, "b1", "b2", "yb", F.lit(0.0).alias("p"), "q"))
    off = lambda x: both.groupBy(*K, x, "yb").agg(F.abs(F.sum("p") - F.sum("q")).alias("off")).groupBy(*K).agg(F.max("off").alias("off"))
    margins = off("b1").union(off("b2")).groupBy(*K).agg((F.max("off") < 1e-8).alias("same_margins"))
    mass = both.groupBy(*K).agg((F.abs(F.sum("q") - 1) < 1e-8).alias("whole"))
    a, b = (rows.where(f"{none} is null").select(*K, x, "yb", F.col("v").alias(to)) for none, x, to in (("b2", "b1", "a"), ("b1", "b2", "b")))
    tops = a.join(b, [*K, "yb"]).groupBy(*K, "b1", "b2").agg(F.sum(F.exp(F.col("a") + F.col("b"))).alias("top")).groupBy(*K).agg((F.max("top") <= 1 + 1e-9).alias("feasible"))
    held = lambda x, df, to: p.groupBy(*K, x, "yb").agg(F.sum("p").alias("m")).join(df, [*K, x, "yb"]).select(*K, (F.col("m") * F.col(to)).alias("v"))
    bound = held("b1", a, "a").union(held("b2", b, "b")).groupBy(*K).agg(F.sum("v").alias("bound"))
    pooled = q.withColumn("s", F.sum("q").over(Window.partitionBy(*K, "b1", "b2")))
    value = pooled.groupBy(*K).agg(F.sum(F.col("q") * F.log(F.col("q") / F.col("s"))).alias("value"))
    least = value.join(bound, K).select(*K, (F.abs(F.col("value") - F.col("bound")) < 1e-7).alias("least"))
    return margins.join(mass, K).join(tops, K).join(least, K).select(*K, "same_margins", "whole", "feasible", "least")


IDENTITY = " SELECT subject, lag, round(i1.mi, 6) AS r_u1, round(i2.mi, 6) AS r_u2, round(i12.mi, 6) AS total FROM i1 JOIN i2 USING (subject, lag) JOIN i12 USING (subject, lag)"
INFO0 = lagged_sql(0) + ", i1 AS " + mi_sql("b1", "yb") + ", i2 AS " + mi_sql("b2", "yb") + ", i12 AS " + mi_sql("b1, b2", "yb")
INFO2 = lagged_sql(2) + ", i1 AS " + mi_sql("b1", "yb") + ", i2 AS " + mi_sql("b2", "yb") + ", i12 AS " + mi_sql("b1, b2", "yb")


def identities(df):
    """What the terms must add up to, whatever the solver."""
    s = df.select(*[c for c in df.columns if c in K], (F.col("R") + F.col("U1")).alias("r_u1"), (F.col("R") + F.col("U2")).alias("r_u2"), (F.col("R") + F.col("U1") + F.col("U2") + F.col("S")).alias("total"))
    return s.withColumns({c: F.round(F.greatest(F.lit(0.0), F.col(c)), 6) for c in ("r_u1", "r_u2", "total")})


@query(INFO0 + IDENTITY)
def temporal_pid(spark, d):
    return identities(I.pid(hist(spark, d, 0), K))


@query(INFO2 + IDENTITY)
def multi_lag_pid(spark, d):
    return identities(I.pid(hist(spark, d, 2), K))


@query(INFO + f" SELECT g.subject, g.lag, round(i1.mi, 6) AS r_u1, round(i2.mi, 6) AS r_u2, round(i12.mi, 6) AS total, CASE WHEN i12.mi IS NULL THEN 'failed' ELSE 'joint' END AS method FROM (SELECT DISTINCT subject, CAST(k AS BIGINT) AS lag FROM series, range(0, {LAGS + 1}) r(k)) g LEFT JOIN i1 USING (subject, lag) LEFT JOIN i2 USING (subject, lag) LEFT JOIN i12 USING (subject, lag)")
def multi_lag_pid_rows(spark, d):
    """Every subject at every lag up to 5, those without a pair of rows as failed; terms that are no number are null here."""
    s = series(spark, d)
    found = I.with_failed_lags(I.pid(hist(spark, d), K), s, ["subject"], range(LAGS + 1))
    sums = {"r_u1": F.col("R") + F.col("U1"), "r_u2": F.col("R") + F.col("U2"), "total": F.col("R") + F.col("U1") + F.col("U2") + F.col("S")}
    return found.select("subject", "lag", *[F.when(~F.isnan(v), F.round(F.greatest(F.lit(0.0), v), 6)).alias(k) for k, v in sums.items()], "method")


@query(SERIES + ", hist AS (SELECT event_type, CAST(x2 % 4 AS BIGINT) AS b1, CAST(floor(x1 / 40) AS BIGINT) % 3 AS b2, CAST(event_id % 2 AS BIGINT) AS yb, count(*) AS n FROM series GROUP BY ALL), i1 AS " + mi_sql("b1", "yb", keys="event_type") + ", i2 AS " + mi_sql("b2", "yb", keys="event_type") + ", i12 AS " + mi_sql("b1, b2", "yb", keys="event_type") + " SELECT event_type, round(i1.mi, 6) AS r_u1, round(i2.mi, 6) AS r_u2, round(i12.mi, 6) AS total FROM i1 JOIN i2 USING (event_type) JOIN i12 USING (event_type)")
def udf_pid_solver(spark, d):
    """The solver over any grouped cells a user brings."""
    s = series(spark, d).select("event_type", (F.col("x2") % 4).cast("long").alias("b1"), (F.floor(F.col("x1") / 40) % 3).cast("long").alias("b2"), (F.col("event_id") % 2).alias("yb"))
    found = I.pid(s.groupBy("event_type", "b1", "b2", "yb").agg(F.count("*").alias("n")), ["event_type"])
    return identities(found.withColumnRenamed("event_type", "subject")).withColumnRenamed("subject", "event_type")


@query(INFO0 + " SELECT subject, round(i12.mi, 6) AS total, round(least(i12.mi - i1.mi, i12.mi - i2.mi), 6) AS most, true AS gap_ok FROM i12 JOIN i1 USING (subject) JOIN i2 USING (subject)")
def synergy_gap(spark, d):
    """The gap is at least 0 and at most what the weaker input leaves of the total."""
    t = I.pid(hist(spark, d, 0), ["subject"]).withColumn("most", F.col("S") + F.least("U1", "U2"))
    ok = (F.col("S") >= -1e-7) & (F.col("S") <= F.col("most") + 1e-7) & (F.col("gap") < 1e-7)
    return t.select("subject", F.round("MI", 6).alias("total"), F.round(F.abs("most"), 6).alias("most"), ok.alias("gap_ok"))


@query()
def multi_lag_pid_terms(spark, d):
    """What multi_lag_pid, and at lag 0 temporal_pid and synergy_gap, are checked on: all terms, in nats."""
    return I.pid(hist(spark, d, 2), K)


@query(MULTI + ", hist AS (SELECT b1, b2, yb, 1 AS one, count(*) AS n FROM (SELECT " + bin_sql("m1", "a1", "z1", 16) + " AS b1, " + bin_sql("m2", "a2", "z2", 16) + " AS b2, CAST(y AS BIGINT) AS yb FROM e) GROUP BY ALL) SELECT round(i1.mi, 6) AS r_u1, round(i2.mi, 6) AS r_u2, round(i12.mi, 6) AS total FROM " + mi_sql("b1", "yb", keys="one") + " i1, " + mi_sql("b2", "yb", keys="one") + " i2, " + mi_sql("b1, b2", "yb", keys="one") + " i12")
def temporal_pid_multivariate(spark, d):
    h = joint_hist_multivariate(spark, d).withColumn("lag", F.lit(0).cast("long"))
    return identities(I.pid(h, ["lag"])).drop("lag")


SENSORS = ("x1", "x2", "x3", "x4", "x5")
PAIRS = [(a, b) for k, a in enumerate(SENSORS) for b in SENSORS[k + 1 :]]
GROUP = ["cohort", "mod1", "mod2", "lag"]


def sensors(spark, d):
    """A wide sensor table: the two signals, the hour, the day of the month, and the first signal's change."""
    s = series(spark, d).withColumns({"x3": F.hour("ts") + F.minute("ts") / 60, "x4": F.dayofmonth("ts").cast("double")})
    w = Window.partitionBy("subject").orderBy("i")
    return s.withColumns({"x5": F.coalesce(F.col("x1") - F.lag("x1").over(w), F.lit(0.0)), "cohort": F.col("subject") % 8})


def cohort_hist(spark, d, pairs, lags: int = LAGS):
    """Counts pooled over the users of eight cohorts; lags and edges stay within a user's series."""
    h = I.joint_hist_multilag(sensors(spark, d), ["cohort", "subject"], pairs, "y", lags, BINS, by=["cohort"])
    return h.withColumn("lag", F.col("lag").cast("long"))


def sensors_sql(pairs, lags: int) -> str:
    bins = ", ".join(f"{bin_sql(c, f'min({c}) OVER w', f'max({c}) OVER w', BINS)} AS {c}" for c in (*SENSORS, "y"))
    each = " UNION ALL ".join(f"SELECT cohort, '{a}' AS mod1, '{b}' AS mod2, lag, {a} AS b1, {b} AS b2, y AS yb, CAST(count(*) AS BIGINT) AS n FROM binned GROUP BY ALL" for a, b in pairs)
    return SERIES + f""", wide AS (SELECT subject, i, x1, x2, hour(ts) + minute(ts) / 60.0::DOUBLE AS x3, CAST(day(ts) AS DOUBLE) AS x4, coalesce(x1 - lag(x1) OVER (PARTITION BY subject ORDER BY i), 0) AS x5, y FROM series),
lagged AS (SELECT a.subject, a.subject % 8 AS cohort, CAST(l.lag AS BIGINT) AS lag, {', '.join(f'a.{c}' for c in SENSORS)}, CAST(b.y AS DOUBLE) AS y FROM wide a JOIN range(0, {lags + 1}) l(lag) ON true JOIN wide b ON b.subject = a.subject AND b.i = a.i + l.lag),
binned AS (SELECT cohort, lag, {bins} FROM lagged WINDOW w AS (PARTITION BY subject, lag)),
hist AS ({each}), """ + ", ".join(f"{name} AS " + mi_sql(by, "yb", keys=", ".join(GROUP)) for name, by in (("i1", "b1"), ("i2", "b2"), ("i12", "b1, b2"))) + f", parts AS (SELECT {', '.join(GROUP)}, i1.mi AS r_u1, i2.mi AS r_u2, i12.mi AS total FROM i1 JOIN i2 USING ({', '.join(GROUP)}) JOIN i12 USING ({', '.join(GROUP)}))"


THREE = [("x1", "x2"), ("x1", "x3"), ("x2", "x3")]


def cohort_pid(spark, d):
    return I.pid(cohort_hist(spark, d, THREE), GROUP)


@query()
def rus_modalities(spark, d):
    """The whole analysis: terms of all pairs and lags, their means, and the dominant term of each pair."""
    keys = ["cohort", "mod1", "mod2"]
    terms = written(cohort_pid(spark, d), "terms")  # both summaries read them
    return G.average_over_lags(terms, keys).drop("lags").join(G.dominant_terms(terms, keys), keys)


@query(sensors_sql(THREE, LAGS) + " SELECT cohort, mod1, mod2, CAST(count(*) AS BIGINT) AS lags, round(avg(total), 5) AS total, round(avg(r_u1), 5) AS r_u1, round(avg(r_u2), 5) AS r_u2, true AS led FROM parts WHERE total > 1e-9 GROUP BY ALL")
def rus_modalities_sums(spark, d):
    """What the means of rus_modalities add up to, and that a dominant term is one of the four or none."""
    t = rus_modalities(spark, d)
    sums = {"total": F.col("MI"), "r_u1": F.col("R") + F.col("U1"), "r_u2": F.col("R") + F.col("U2")}
    led = F.coalesce(F.col("dominant").isin(*G.TERMS), F.lit(True))
    return t.select("cohort", "mod1", "mod2", "lags", *[F.round(v, 5).alias(k) for k, v in sums.items()], led.alias("led"))


@query()
def rus_all_sensor_pairs_terms(spark, d):
    """Terms of every pair at every lag from 0 to 10, in bits, with the solver's rounds and duality gap."""
    return I.pid(cohort_hist(spark, d, PAIRS, 10), GROUP, unit="bits")


@query(sensors_sql(PAIRS, 10) + f" SELECT {', '.join(GROUP)}, round(r_u1 / ln(2), 5) AS r_u1, round(r_u2 / ln(2), 5) AS r_u2, round(total / ln(2), 5) AS total FROM parts")
def rus_all_sensor_pairs(spark, d):
    """What the terms of every pair of sensors add up to at every lag, in bits."""
    t = rus_all_sensor_pairs_terms(spark, d)
    sums = {"r_u1": F.col("R") + F.col("U1"), "r_u2": F.col("R") + F.col("U2"), "total": F.col("R") + F.col("U1") + F.col("U2") + F.col("S")}
    return t.select(*GROUP, *[F.round(F.greatest(F.lit(0.0), v), 5).alias(k) for k, v in sums.items()])


@query(sensors_sql(PAIRS, 10) + " SELECT CAST(count(*) AS BIGINT) AS groups, CAST(0 AS BIGINT) AS open, true AS few_rounds FROM parts")
def rus_all_sensor_pairs_gaps(spark, d):
    """How many decompositions there are, and how many have a duality gap of 1e-7 nats or more."""
    t = rus_all_sensor_pairs_terms(spark, d)
    return t.agg(F.count("*").alias("groups"), F.count_if(F.isnan("gap") | (F.col("gap") >= 1e-7)).alias("open"), (F.max("rounds") < 100).alias("few_rounds"))


RUS = """, terms AS (SELECT user_id % 8 AS cohort, event_type AS mod1, event_id % 6 AS lag, sum(value) FILTER (event_id % 4 = 0) AS r, sum(value) FILTER (event_id % 4 = 1) AS u1, sum(value) FILTER (event_id % 4 = 2) AS u2, sum(value) FILTER (event_id % 4 = 3) AS s FROM events GROUP BY ALL), t AS (SELECT cohort, mod1, lag, coalesce(r, 0) AS r, coalesce(u1, 0) AS u1, coalesce(u2, 0) AS u2, coalesce(s, 0) AS s, coalesce(r, 0) + coalesce(u1, 0) + coalesce(u2, 0) + coalesce(s, 0) AS mi FROM terms)"""


def term_rows(spark, d):
    """Result rows made from sums over events: a decomposition with known terms."""
    e = table(spark, d, "events").groupBy((F.col("user_id") % 8).alias("cohort"), F.col("event_type").alias("mod1"), (F.col("event_id") % 6).alias("lag"))
    t = e.agg(*[F.coalesce(F.sum(F.when(F.col("event_id") % 4 == k, F.col("value"))), F.lit(0.0)).alias(c) for k, c in enumerate(G.TERMS)])
    return t.withColumn("MI", F.col("R") + F.col("U1") + F.col("U2") + F.col("S"))


@query("WITH z AS (SELECT 1)" + RUS + " SELECT cohort, mod1, round(avg(r), 6) AS \"R\", round(avg(mi), 6) AS \"MI\", round(avg(s / mi), 6) AS \"S_norm\", CAST(count(*) AS BIGINT) AS lags FROM t WHERE mi > 1e-9 GROUP BY cohort, mod1")
def rus_avg_over_lags(spark, d):
    return rounded(G.average_over_lags(term_rows(spark, d), ["cohort", "mod1"]), "R", "MI", "S_norm").select("cohort", "mod1", "R", "MI", "S_norm", "lags")


DOMINANT = RUS + ", led AS (SELECT cohort, mod1, CASE WHEN greatest(r, u1, u2, s) / mi > 0.3 THEN CASE greatest(r, u1, u2, s) WHEN r THEN 'R' WHEN u1 THEN 'U1' WHEN u2 THEN 'U2' ELSE 'S' END END AS led FROM t WHERE mi > 1e-9), c AS (SELECT cohort, mod1, count(*) AS lags, count(*) FILTER (led = 'R') AS r, count(*) FILTER (led = 'U1') AS u1, count(*) FILTER (led = 'U2') AS u2, count(*) FILTER (led = 'S') AS s FROM led GROUP BY ALL), dom AS (SELECT cohort, mod1, CASE WHEN r / lags >= 0.3 THEN 'R' WHEN u1 / lags >= 0.3 THEN 'U1' WHEN u2 / lags >= 0.3 THEN 'U2' WHEN s / lags >= 0.3 THEN 'S' END AS dominant FROM c)"


def dominant(spark, d):
    return G.dominant_terms(term_rows(spark, d), ["cohort", "mod1"], 0.3, 0.3)


@query("WITH z AS (SELECT 1)" + DOMINANT + " SELECT cohort, mod1, dominant FROM dom")
def rus_dominant_term(spark, d):
    return dominant(spark, d).select("cohort", "mod1", "dominant")


@query("WITH z AS (SELECT 1)" + DOMINANT + " SELECT term, CAST(count(mod1) AS BIGINT) AS pairs FROM (VALUES ('R'), ('U1'), ('U2'), ('S')) v(term) LEFT JOIN dom ON dominant = term GROUP BY term")
def rus_dominance_summary(spark, d):
    return G.dominance_summary(dominant(spark, d))


@query("WITH z AS (SELECT 1)" + RUS + " SELECT mod1, round(avg(r), 4) AS r, round(avg(u1), 4) AS u1, round(100 * sum(s) / sum(mi), 4) AS s_percent FROM t GROUP BY mod1")
def rus_summary_table(spark, d):
    return term_rows(spark, d).groupBy("mod1").agg(F.round(F.avg("R"), 4).alias("r"), F.round(F.avg("U1"), 4).alias("u1"), F.round(100 * F.sum("S") / F.sum("MI"), 4).alias("s_percent"))


TE = SERIES + ", e AS (SELECT subject, i, " + ", ".join(f"{bin_sql(c, f'min({c}) OVER w', f'max({c}) OVER w', BINS)} AS {c}" for c in ("x1", "x2")) + " FROM series WINDOW w AS (PARTITION BY subject)), hist AS (SELECT a.subject, {lag} AS lag, a.x1 AS b1, a.x2 AS b2, b.x1 AS yb, CAST(count(*) AS BIGINT) AS n FROM e a JOIN e b ON b.subject = a.subject AND b.i = a.i + {lag} GROUP BY ALL), i1 AS " + mi_sql("b1", "yb") + ", i12 AS " + mi_sql("b1, b2", "yb")


@query(TE.format(lag=1) + " SELECT subject, round((i12.mi - i1.mi) / ln(2), 6) AS te FROM i1 JOIN i12 USING (subject, lag)")
def transfer_entropy(spark, d):
    return rounded(I.transfer_entropy(series(spark, d), ["subject"], "x2", "x1", 1, BINS), "te")


BACK = TE.replace("a.x1 AS b1, a.x2 AS b2, b.x1 AS yb", "a.x2 AS b1, a.x1 AS b2, b.x2 AS yb")
DIRECTIONS = [("x1", "x2"), ("x2", "x1")]


def te_sql(extra: str, value: str, lags: int = 3) -> str:
    return " UNION ALL ".join("SELECT * FROM (" + (TE if source == "x2" else BACK).format(lag=lag) + extra + f" SELECT subject, '{source}' AS source, CAST({lag} AS BIGINT) AS lag, {value})" for source in ("x1", "x2") for lag in range(1, lags + 1))


STATIC = ", h0 AS (SELECT subject, x1 AS b1, x2 AS b2, count(*) AS n FROM e GROUP BY ALL)"


@query(te_sql(STATIC, "round(m.mi / ln(2), 6) AS mi, round((i12.mi - i1.mi) / ln(2), 6) AS te FROM i1 JOIN i12 USING (subject, lag) JOIN " + mi_sql("b1", "b2", "h0", "subject") + " m USING (subject)"))
def mi_vs_te(spark, d):
    """Static information beside what either signal tells about the other's next steps, at lags 1 to 3."""
    s = series(spark, d)
    static = I.mutual_information(hist(spark, d, 0), ["subject"], ["b1"], ["b2"], unit="bits")
    te = I.transfer_entropies(s, ["subject"], DIRECTIONS, [1, 2, 3], BINS).select("subject", "source", "lag", "te")
    return rounded(te.join(static, "subject"), "mi", "te")


@query(te_sql("", "round((i12.mi - i1.mi) / ln(2), 6) AS te FROM i1 JOIN i12 USING (subject, lag)"))
def te_by_source_and_lag(spark, d):
    """What either signal tells about the other's next steps, at lags 1 to 3: one pass for all."""
    return rounded(I.transfer_entropies(series(spark, d), ["subject"], DIRECTIONS, [1, 2, 3], BINS), "te").select("subject", "source", "lag", "te")


@query(te_sql(", w AS (SELECT subject, n / sum(n) OVER (PARTITION BY subject) AS p, n / sum(n) OVER (PARTITION BY subject, b1, b2) AS c, sum(n) OVER (PARTITION BY subject, b1, yb) / sum(n) OVER (PARTITION BY subject, b1) AS t FROM hist), v AS (SELECT subject, greatest(0, sum(p * c * ln(c / t)) / ln(2)) AS te FROM w GROUP BY subject)", "round(te, 6) AS te FROM v"))
def te_weighted(spark, d):
    """The same with each term weighted once more by its conditional share."""
    return rounded(I.transfer_entropies(series(spark, d), ["subject"], DIRECTIONS, [1, 2, 3], BINS, "weighted"), "te").select("subject", "source", "lag", "te")


AUTO = [("x1", "x2"), ("x2", "x4"), ("x1", "x4")]


def auto_sql() -> str:
    names = ("x1", "x2", "x4", "y")
    base = sensors_sql(PAIRS[:1], 2).split("binned AS (")[0]
    codes = ", ".join(f"bool_and({c} = floor({c})) OVER w AS {c}_w, dense_rank() OVER (PARTITION BY subject, lag ORDER BY {c}) - 1 AS {c}_r, {bin_sql(c, f'min({c}) OVER w', f'max({c}) OVER w', BINS)} AS {c}_b" for c in names)
    pick = lambda a, b, c: f"CASE WHEN {a}_w AND {b}_w AND y_w THEN {c}_r ELSE {c}_b END"
    each = " UNION ALL ".join(f"SELECT subject, '{a}' AS mod1, '{b}' AS mod2, lag, CAST({pick(a, b, a)} AS BIGINT) AS b1, CAST({pick(a, b, b)} AS BIGINT) AS b2, CAST({pick(a, b, 'y')} AS BIGINT) AS yb, CAST(count(*) AS BIGINT) AS n FROM coded GROUP BY ALL" for a, b in AUTO)
    return base.replace("SELECT a.subject, a.subject % 8 AS cohort,", "SELECT a.subject,") + f"coded AS (SELECT subject, lag, {codes} FROM lagged WINDOW w AS (PARTITION BY subject, lag)) " + each


@query(auto_sql())
def joint_hist_auto(spark, d):
    """Counts of mixed pairs at lags 0 to 2: whole numbers by their ranks where all three slices are whole, equal widths elsewhere."""
    h = I.joint_hist_multilag(sensors(spark, d), ["subject"], AUTO, "y", 2, BINS, "auto")
    return h.select("subject", "mod1", "mod2", F.col("lag").cast("long").alias("lag"), F.col("b1").cast("long").alias("b1"), F.col("b2").cast("long").alias("b2"), F.col("yb").cast("long").alias("yb"), "n")


@query("WITH " + HALVES + " SELECT CAST(count(*) AS BIGINT) AS rows_seen, CAST(4 AS BIGINT) AS width, true AS ordered FROM halves")
def reduce_dims(spark, d):
    """Four components whose variances fall."""
    r = L.reduce_dims(halves(spark, d), "a", 4)
    v = r.agg(F.count("*").alias("rows_seen"), F.max(F.size("reduced")).cast("long").alias("width"), *[F.var_pop(F.get("reduced", F.lit(k))).alias(f"v{k}") for k in range(4)])
    return v.select("rows_seen", "width", ((F.col("v0") >= F.col("v1")) & (F.col("v1") >= F.col("v2")) & (F.col("v2") >= F.col("v3"))).alias("ordered"))


WIDTHS = {"none": (4, 4), "pca": (4, 12), "cluster": (32, 32)}


@query()
def temporal_pid_reduced_terms(spark, d):
    """Vectors of 8, 16 and 64 numbers, unreduced, by components and by clusters as their width asks, at lags 0 to 2: terms in nats, the
    informations that Spark counts from the same states, and the rows and states there are."""
    h = halves(spark, d).select("vec_id", "a", "b", "y", F.floor(F.col("vec_id") / 100).alias("part"))
    s = written(S.series_index(h, ["part"], ["vec_id"]), "parts")
    each = [L.reduced_hist(s.withColumns({"a": F.slice("a", 1, p), "b": F.slice("b", 1, q)}), ["part"], "a", "b", "y", 2) for p, q in WIDTHS.values()]
    counts = written(reduce(DataFrame.union, each), "counts")
    keys = ["method", "lag"]
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("rows_seen"), F.countDistinct("b1").alias("states1"), F.countDistinct("b2").alias("states2"))
    return I.pid(counts, keys).join(I.information(counts, keys), keys).join(sizes, keys)


@query("WITH " + HALVES + ", s AS (SELECT floor(vec_id / 100) AS part, count(*) AS n FROM halves GROUP BY 1) SELECT method, CAST(k AS BIGINT) AS lag, CAST(sum(greatest(0, n - k)) AS BIGINT) AS rows_seen, true AS few_states, true AS adds_up, true AS proven FROM s JOIN range(0, 3) r(k) ON true JOIN (VALUES ('none'), ('pca'), ('cluster')) m(method) ON true GROUP BY ALL")
def temporal_pid_reduced(spark, d):
    """The rows counted by method and lag, states within their bounds, sums of the terms that are the counted informations, closed gaps."""
    t = temporal_pid_reduced_terms(spark, d)
    near = lambda a, b: F.abs(a - F.col(b)) < 1e-9
    adds = near(F.col("R") + F.col("U1"), "i1") & near(F.col("R") + F.col("U2"), "i2") & near(F.col("MI"), "total")
    few = F.greatest("states1", "states2") <= F.when(F.col("method") == "cluster", 5).otherwise(16)
    return t.select("method", "lag", "rows_seen", few.alias("few_states"), adds.alias("adds_up"), (F.col("gap") < 1e-7).alias("proven"))


# learned decompositions

CLASSES = 5
STATES = lagged_sql(0) + ", s AS (SELECT subject, i, y, " + ", ".join(f"{bin_sql(c, f'min({c}) OVER ()', f'max({c}) OVER ()', BINS)} AS b{k}" for k, c in ((1, "x1"), (2, "x2"))) + " FROM series)"


def states(spark, d):
    s = series(spark, d)
    e = s.agg(*[f(c).alias(f"{c}{n}") for c in ("x1", "x2") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    b = lambda c: A.equal_width_bin(F.col(c), F.lit(e[f"{c}lo"]), F.lit(e[f"{c}hi"]), BINS)
    return s.select("event_id", "subject", "i", "n", "y", "x1", "x2", b("x1").alias("b1"), b("x2").alias("b2"))


@query(STATES + ", c AS (SELECT b1, b2, y, count(*) AS n FROM s GROUP BY ALL), g AS (SELECT DISTINCT b1, b2 FROM s) SELECT g.b1, g.b2, CAST(k AS BIGINT) AS y, round((coalesce(c.n, 0) + 1e-8) / (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.b1, g.b2) + 5e-8), 6) AS p FROM g JOIN range(0, 5) r(k) ON true LEFT JOIN c ON c.b1 = g.b1 AND c.b2 = g.b2 AND c.y = k")
def hist_posterior(spark, d):
    p = L.hist_posterior(states(spark, d), ["b1", "b2"], "y", CLASSES)
    return p.select("b1", "b2", F.posexplode("posterior").alias("y", "p")).select("b1", "b2", F.col("y").cast("long").alias("y"), F.round("p", 6).alias("p"))


def posteriors(df, keys=()):
    """Rows with counted posteriors p1, p2 and p12."""
    for to, by in (("p1", ["b1"]), ("p2", ["b2"]), ("p12", ["b1", "b2"])):
        df = df.join(L.hist_posterior(df, [*keys, *by], "y", CLASSES, to), [*keys, *by])
    return df


@query(STATES + ", one AS (SELECT 1 AS k, b1, y AS yb, count(*) AS n FROM s GROUP BY ALL) SELECT round(mi / ln(2), 5) AS mi FROM " + mi_sql("b1", "yb", "one", "k"))
def mi_from_posterior(spark, d):
    s = L.with_prior(posteriors(states(spark, d)), "y", CLASSES)
    return L.mi_from_posterior(s, [], "p1").select(F.round("mi", 5).alias("mi"))


@query(STATES + ", c AS (SELECT b1, y, count(*) AS n FROM s GROUP BY ALL), p AS (SELECT b1, y, n, n / sum(n) OVER (PARTITION BY b1) AS p FROM c) SELECT round(sum(-n * ln(p)) / sum(n), 5) AS loss FROM p")
def cross_entropy_eval(spark, d):
    return L.cross_entropy(posteriors(states(spark, d)), [], "p1", "y").select(F.round("loss", 5).alias("loss"))


def batches(spark, d):
    return P.minibatches(posteriors(states(spark, d)), "event_id", 64, 1)


@query("SELECT CAST((count(*) + 63) // 64 AS BIGINT) AS batches, CAST(count(*) AS BIGINT) AS rows_seen, true AS margins, true AS least FROM events")
def sinkhorn_coupling(spark, d):
    q = L.batch_couplings(batches(spark, d), [])
    return q.agg(F.count("*").alias("batches"), F.sum("rows").alias("rows_seen"), (F.max("off") < 1e-8).alias("margins"), (F.max("gap") < 1e-7).alias("least"))


@query("SELECT CAST(r // 64 AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS rows, true AS fell, true AS least FROM (SELECT row_number() OVER () - 1 AS r FROM events) GROUP BY 1")
def coupling_objective(spark, d):
    return L.batch_couplings(batches(spark, d), []).select("batch_id", "rows", (F.col("i_q") <= F.col("i_start")).alias("fell"), (F.col("gap") < 1e-7).alias("least"))


@query()
def coupling_objective_values(spark, d):
    """Each minibatch's information before and after, and the duality gap."""
    return L.batch_couplings(batches(spark, d), []).select("batch_id", "rows", "i_start", "i_q", "gap", "rounds", "off")


@query()
def mi_q(spark, d):
    q = L.batch_couplings(batches(spark, d), [])
    return q.agg((F.sum(F.col("i_q") * F.col("rows")) / F.sum("rows") / math.log(2)).alias("iq"))


COARSER = (
    STATES
    + ", c AS (SELECT subject % 8 AS cohort, b1, CAST(floor(b1 / 2) AS BIGINT) AS b2, y AS yb, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT cohort, b2, yb, sum(n) AS n FROM c GROUP BY ALL), k AS (SELECT cohort, yb, sum(n) AS n FROM c GROUP BY ALL)"
    + ", cells AS (SELECT cohort, c.b1, m.b2, yb, CAST(c.n AS DOUBLE) * m.n / k.n AS n FROM c JOIN m USING (cohort, yb) JOIN k USING (cohort, yb)), "
    + ", ".join(f"{i} AS {mi_sql(b, 'yb', 'cells', 'cohort')}" for i, b in (("i1", "b1"), ("i2", "b2"), ("i12", "b1, b2")))
)


@query(COARSER + ' SELECT cohort, round(i2.mi, 5) AS "R", round(i1.mi - i2.mi, 5) AS "U1", 0.0::DOUBLE AS "U2", round(i12.mi - i1.mi, 5) AS "S" FROM i1 JOIN i2 USING (cohort) JOIN i12 USING (cohort)')
def pid_coarser(spark, d):
    """All four terms where they are known: the second input has the margins of a coarser view of the first, but is paired
    with it at random within a class. What it tells the first tells too, so nothing is unique to it, and the pairing alone is synergy."""
    s = states(spark, d).select((F.col("subject") % 8).alias("cohort"), "b1", F.floor(F.col("b1") / 2).cast("long").alias("b2"), F.col("y").alias("yb"))
    one = s.groupBy("cohort", "b1", "b2", "yb").agg(F.count("*").cast("double").alias("n1"))
    two, of = one.groupBy("cohort", "b2", "yb").agg(F.sum("n1").alias("n2")), one.groupBy("cohort", "yb").agg(F.sum("n1").alias("n"))
    cells = one.drop("b2").join(two, ["cohort", "yb"]).join(of, ["cohort", "yb"]).select("cohort", "b1", "b2", "yb", (F.col("n1") * F.col("n2") / F.col("n")).alias("n"))
    t = I.pid(cells, ["cohort"])
    return t.select("cohort", *[(F.round(c, 5) + 0.0).alias(c) for c in ("R", "U1", "U2", "S")])


DEALT = STATES.replace("SELECT subject, i, y, ", "SELECT event_id, subject, i, y, ") + (
    ", c AS (SELECT b1, y, count(*) AS n FROM s GROUP BY ALL), p AS (SELECT g.b1, k, (coalesce(n, 0) + 1e-8) / (sum(coalesce(n, 0)) OVER (PARTITION BY g.b1) + 5e-8) AS p FROM (SELECT DISTINCT b1 FROM s) g JOIN range(0, 5) r(k) ON true LEFT JOIN c ON c.b1 = g.b1 AND c.y = k)"
    ", o AS (SELECT b1, CAST((row_number() OVER (ORDER BY md5(concat('1:', CAST(event_id AS VARCHAR))), event_id) - 1) // 64 AS BIGINT) AS batch_id FROM s)"
    ", w AS (SELECT batch_id, p, avg(p) OVER (PARTITION BY batch_id, k) AS a, count(*) OVER (PARTITION BY batch_id) / 5 AS size FROM o JOIN p USING (b1))"
)


@query(DEALT + " SELECT batch_id, CAST(any_value(size) AS BIGINT) AS rows, round(sum(p * ln(p / a)) / any_value(size), 5) AS iq FROM w GROUP BY batch_id")
def mi_q_coarser(spark, d):
    """Each minibatch's least information where it is known: the second posteriors are means of the first ones over two bins, so it is the first input's own."""
    from pyspark.sql import Window

    pair = Window.partitionBy("batch_id", F.floor(F.col("b1") / 2))
    coarse = F.array(*[F.avg(F.get("p1", F.lit(k))).over(pair) for k in range(CLASSES)])
    return L.batch_couplings(batches(spark, d).withColumn("p2", coarse), [], stop=1e-10).select("batch_id", "rows", F.round("i_q", 5).alias("iq"))


@query("WITH z AS (SELECT 1)" + RUS + ", c AS (SELECT cohort, mod1, lag, r AS i1, u1 AS i2, r + u1 + s AS i12, greatest(r, u1) AS iq FROM t) SELECT cohort, mod1, lag, round(greatest(0, i1 + i2 - iq), 6) AS \"R\", round(greatest(0, iq - i2), 6) AS \"U1\", round(greatest(0, iq - i1), 6) AS \"U2\", round(greatest(0, i12 - iq), 6) AS \"S\" FROM c")
def decompose_learned(spark, d):
    c = term_rows(spark, d).select("cohort", "mod1", "lag", F.col("R").alias("i1"), F.col("U1").alias("i2"), (F.col("R") + F.col("U1") + F.col("S")).alias("i12"), F.greatest("R", "U1").alias("iq"))
    return rounded(L.decompose_learned(c), "R", "U1", "U2", "S").select("cohort", "mod1", "lag", "R", "U1", "U2", "S")


@query()
def fit_posterior(spark, d):
    """A nonlinear posterior of the label from 32 numbers: its mass, and what it gives the true label."""
    h = halves(spark, d)
    p = L.fit_posterior(h, "a", "y", (h.agg(F.max("y")).first()[0] or 0) + 1)
    return p.select("vec_id", "y", F.round(A.total(F.col("posterior")), 6).alias("mass"), F.get("posterior", F.col("y").cast("int")).alias("p"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows_seen, true AS whole, true AS learned FROM embeddings WHERE len(embedding) = 64")
def fit_posterior_quality(spark, d):
    """That every row's posterior adds up to 1, and that its mean loss is not above the class shares' by more than 0.01 nats."""
    p = written(fit_posterior(spark, d), "posterior")
    shares = p.groupBy("y").agg(F.count("*").alias("n")).agg((-F.sum(F.col("n") * F.log(F.col("n") / F.lit(1.0))) / F.sum("n") + F.log(F.sum("n"))).alias("h")).scalar()
    return p.agg(F.count("*").alias("rows_seen"), (F.max(F.abs(F.col("mass") - 1)) < 1e-5).alias("whole"), F.avg(-F.log("p")).alias("loss")).select("rows_seen", "whole", (F.col("loss") < shares + 0.01).alias("learned"))


def lagged_states(spark, d, lags: int):
    s = states(spark, d)
    return S.lag_align(s, ["subject"], ["b1", "b2", "x1", "x2"], "y", lags, others=["event_id"])


MULTISCALE = [("x1", "x2"), ("x1", "x3"), ("x2", "x3")]


def multiscale(spark, d):
    """One model a posterior for all lags 0 to 5, near lags weighing more, from all rows of the first four fifths of each series."""
    return Q.temporal_batch(vector_series(spark, d), ["subject"], "event_id", MULTISCALE, "y", range(LAGS + 1), CLASSES, weights=[1 / (1 + k) for k in range(LAGS + 1)], resamples=3)


@query()
def multiscale_posterior(spark, d):
    """One model for all lags, told the lag: its mean loss by lag on the rows held out."""
    return multiscale(spark, d).select("mod1", "mod2", "lag", "loss", "test_rows")


def by_lag(spark, d, lags: int):
    rows = posteriors(lagged_states(spark, d, lags), ["lag"]).withColumn("key", F.col("event_id") * 16 + F.col("lag"))
    return P.minibatches(rows, "key", 64 * (lags + 1), 1)


def parts_sql(keys: str) -> str:
    return ", ".join(f"{name} AS " + mi_sql(by, "yb", keys=keys) for name, by in (("i1", "b1"), ("i2", "b2"), ("i12", "b1, b2"))) + f" SELECT {keys}, round(i1.mi / ln(2), 4) AS i1, round(i2.mi / ln(2), 4) AS i2, round(i12.mi / ln(2), 4) AS i12 FROM i1 JOIN i2 USING ({keys}) JOIN i12 USING ({keys})"


def parts(df, *keys: str):
    """The informations that the terms are made of."""
    return df.select(*keys, *[F.round(c, 4).alias(c) for c in ("i1", "i2", "i12")])


@query(STATES + ", hist AS (SELECT CAST(l.lag AS BIGINT) AS lag, a.b1, a.b2, b.y AS yb, CAST(count(*) AS BIGINT) AS n FROM s a JOIN range(0, 3) l(lag) ON true JOIN s b ON b.subject = a.subject AND b.i = a.i + l.lag GROUP BY ALL), ".replace("hist AS", "counted AS") + parts_sql("lag").replace("FROM hist", "FROM counted"))
def temporal_pid_batch(spark, d):
    """Informations by lag from counted posteriors; temporal_pid_batch_terms has the terms."""
    return parts(L.learned_terms(by_lag(spark, d, 2), ["lag"], CLASSES).withColumn("lag", F.col("lag").cast("long")), "lag")


@query()
def temporal_pid_batch_terms(spark, d):
    return L.learned_terms(by_lag(spark, d, 2), ["lag"], CLASSES)


@query()
def temporal_pid_multiscale_terms(spark, d):
    """Terms by pair and lag from one lag-conditioned model a posterior, scored on held-out rows."""
    return multiscale(spark, d)


@query(SERIES + f", p AS (SELECT subject, CAST(k AS BIGINT) AS lag, n - k AS n FROM (SELECT DISTINCT subject, n FROM series), range(0, {LAGS + 1}) r(k) WHERE n > k), c AS (SELECT lag, CAST(sum(floor(n * 0.8::DOUBLE)) AS BIGINT) AS train_rows, CAST(sum(n - floor(n * 0.8::DOUBLE)) AS BIGINT) AS test_rows FROM p GROUP BY lag) SELECT m.mod1, m.mod2, c.*, true AS solved, true AS in_order FROM c JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in MULTISCALE) + ") m(mod1, mod2) ON true")
def temporal_pid_multiscale(spark, d):
    """The rows that fit and that are scored by pair and lag, that the couplings' gaps are closed, and that the least information lies in its bounds."""
    t = multiscale(spark, d)
    in_order = (F.col("iq") >= F.greatest("i1", "i2") - 1e-6) & (F.col("iq") <= F.col("i1") + F.col("i2") + 1e-6) & (F.col("loss") < math.log(CLASSES) + 0.05)
    return t.select("mod1", "mod2", "lag", "train_rows", "test_rows", (F.col("gap") < 2e-7).alias("solved"), in_order.alias("in_order"))


def pooled(spark, d):
    """Labelled sequences: masked means of both modalities, with quantised row means as states."""
    h = halves(spark, d).where("mask")
    label = h.groupBy("seq").agg(F.min_by("y", "t").alias("y"))
    m = S.vector_bucket_mean(h, ["seq"], "a").join(S.vector_bucket_mean(h, ["seq"], "b"), "seq").join(label, "seq")
    return m.withColumn("b1", F.floor(A.row_mean(F.col("a")) * 20).cast("long")).withColumn("b2", F.floor(A.row_mean(F.col("b")) * 20).cast("long"))


def sequence_terms(spark, d):
    rows = pooled(spark, d)
    classes = (rows.agg(F.max("y")).first()[0] or 0) + 1
    for to, by in (("p1", ["b1"]), ("p2", ["b2"]), ("p12", ["b1", "b2"])):
        rows = rows.join(L.hist_posterior(rows, by, "y", classes, to), by)
    return L.learned_terms(P.minibatches(rows, "seq", 32, 2), [], classes)


@query("WITH " + HALVES + ", m AS (SELECT seq, CAST(floor(avg(list_avg(a)) * 20) AS BIGINT) AS b1, CAST(floor(avg(list_avg(b)) * 20) AS BIGINT) AS b2, arg_min(y, t) AS yb FROM halves WHERE mask GROUP BY seq), hist AS (SELECT 0 AS one, b1, b2, yb, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY ALL), " + parts_sql("one").replace("SELECT one, round", "SELECT round"))
def pid_multi_sequence(spark, d):
    """Informations of masked mean sequences; pid_multi_sequence_terms has the terms."""
    return parts(sequence_terms(spark, d))


@query()
def pid_multi_sequence_terms(spark, d):
    return sequence_terms(spark, d)


def vector_series(spark, d):
    """The five sensors of each series as vectors of one number."""
    return sensors(spark, d).select("event_id", "subject", "i", "n", *[F.array(c).alias(c) for c in SENSORS], "y")


@query()
def temporal_pid_resampled_terms(spark, d):
    """Ten pairs of sensors at lags 0 to 5, fitted on the first four fifths of each series, scored on the rest, over ten resamples."""
    return Q.temporal_batch(vector_series(spark, d), ["subject"], "event_id", PAIRS, "y", range(LAGS + 1), CLASSES)


@query(SERIES + f", p AS (SELECT subject, CAST(k AS BIGINT) AS lag, n - k AS n FROM (SELECT DISTINCT subject, n FROM series), range(0, {LAGS + 1}) r(k) WHERE n > k), c AS (SELECT lag, CAST(sum(floor(n * 0.8::DOUBLE)) AS BIGINT) AS train_rows, CAST(sum(n - floor(n * 0.8::DOUBLE)) AS BIGINT) AS test_rows FROM p GROUP BY lag) SELECT m.mod1, m.mod2, c.*, 'batch' AS method, true AS solved, true AS in_order FROM c JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ") m(mod1, mod2) ON true")
def temporal_pid_resampled(spark, d):
    """The rows that fit and that are scored for each pair and lag, that the couplings' gaps are closed, and that the least information
    is at least either input's own and not above what both states together can tell."""
    t = temporal_pid_resampled_terms(spark, d)
    in_order = (F.col("iq") >= F.greatest("i1", "i2") - 1e-6) & (F.col("iq") <= F.col("i1") + F.col("i2") + 1e-6)
    return t.select("mod1", "mod2", "lag", "train_rows", "test_rows", "method", (F.col("gap") < 2e-7).alias("solved"), in_order.alias("in_order"))


def sequences(spark, d):
    """Masked sequences of three modalities, thirds of the vectors, labelled by their first step; n is the number of steps."""
    h = halves(spark, d).withColumn("_v", F.concat("a", "b"))
    label = h.groupBy("seq").agg(F.min_by("y", "t").alias("y"), F.max(F.col("t") + 1).alias("n"))
    return h.select("seq", "t", "mask", *[F.slice("_v", at, 21).alias(c) for c, at in (("a", 1), ("b", 22), ("c", 43))]).join(label, "seq")


def sequence_lags(spark, d, pooling: str):
    rows = sequences(spark, d)
    classes = (rows.agg(F.max("y")).first()[0] or 0) + 1
    return Q.sequence_batch(rows, "seq", [("a", "b"), ("a", "c"), ("b", "c")], "y", S.lag_grid(10, 5), classes, "mask", pooling)


@query()
def pid_multi_sequence_lag_terms(spark, d):
    """Terms of all pairs by both poolings at the five lags of the grid."""
    return sequence_lags(spark, d, "mean").withColumn("pooling", F.lit("mean")).union(sequence_lags(spark, d, "timestep").withColumn("pooling", F.lit("timestep")))


@query("WITH " + HALVES + ", n AS (SELECT seq, max(t) + 1 AS n FROM halves GROUP BY seq), s AS (SELECT seq, mask, CAST(lag AS BIGINT) AS lag FROM halves JOIN n USING (seq), (VALUES (0), (2), (4), (6), (8)) v(lag) WHERE t < n - lag), c AS (SELECT 'mean' AS pooling, lag, count(DISTINCT seq) AS n FROM s WHERE mask GROUP BY lag UNION ALL SELECT 'timestep', lag, count(*) FROM s GROUP BY lag) SELECT pooling, lag, CAST(trunc(n * 0.8::DOUBLE) AS BIGINT) AS train_rows, CAST(n - trunc(n * 0.8::DOUBLE) AS BIGINT) AS test_rows, mod1, mod2, 'batch' AS method FROM c JOIN (VALUES ('a', 'b'), ('a', 'c'), ('b', 'c')) m(mod1, mod2) ON true")
def pid_multi_sequence_lags(spark, d):
    """The rows that fit and that are scored, by pooling, pair and lag."""
    return pid_multi_sequence_lag_terms(spark, d).select("pooling", "mod1", "mod2", "lag", "train_rows", "test_rows", "method")


PARTS = {"m2": (1, 2), "m4": (3, 4), "m6": (7, 6), "m24": (13, 24), "m28": (37, 28)}
VECTOR_PAIRS = [(a, b) for k, a in enumerate(PARTS) for b in list(PARTS)[k + 1 :]]


def vector_modalities(spark, d):
    """Five modalities of 2 to 28 numbers, parts of the vectors, as series of a hundred steps each."""
    v = table(spark, d, "embeddings").where("embedding is not null and size(embedding) = 64")
    e = F.col("embedding").cast("array<double>")
    rows = v.select("vec_id", F.floor(F.col("vec_id") / 100).cast("long").alias("subject"), F.col("label").cast("long").alias("y"), *[F.slice(e, at, n).alias(m) for m, (at, n) in PARTS.items()])
    return S.series_index(rows, ["subject"], ["vec_id"])


@query()
def rus_vector_modalities_terms(spark, d):
    """The whole analysis of vector modalities: each subject, pair and lag 0 to 2, counted or fitted as the pair's width asks, failed ones kept."""
    v = vector_modalities(spark, d)
    classes = (v.agg(F.max("y")).first()[0] or 0) + 1
    return Q.vector_terms(v, ["subject"], "vec_id", VECTOR_PAIRS, "y", classes, range(3), by=["subject"], size=8)


VECTORS = (
    "WITH e AS (SELECT *, CAST(floor(vec_id / 100) AS BIGINT) AS subject FROM embeddings WHERE len(embedding) = 64), s AS (SELECT subject, CAST(label AS BIGINT) AS y, row_number() OVER (PARTITION BY subject ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY subject) AS n, "
    + ", ".join(f"CAST(embedding[{at}:{at + n - 1}] AS DOUBLE[]) AS {m}" for m, (at, n) in PARTS.items())
    + " FROM e), f AS (SELECT subject, y, i, n, "
    + ", ".join(f"list_avg({m}) AS {m}, list_min({m}) AS {m}_lo, list_max({m}) AS {m}_hi" for m in PARTS)
    + " FROM s), l AS (SELECT a.* EXCLUDE (y), CAST(k AS BIGINT) AS lag, b.y AS yb FROM f a JOIN range(0, 3) r(k) ON true JOIN f b ON b.subject = a.subject AND b.i = a.i + k), b AS (SELECT subject, lag, yb, "
    + ", ".join(f"{bin_sql(m, f'min({m}_lo) OVER w', f'max({m}_hi) OVER w', 16)} AS {m}" for m in PARTS)
    + " FROM l WINDOW w AS (PARTITION BY subject, lag)), hist AS ("
    + " UNION ALL ".join(f"SELECT subject, lag, '{a}' AS mod1, '{b}' AS mod2, {a} AS b1, {b} AS b2, yb, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY ALL" for a, b in VECTOR_PAIRS if PARTS[a][1] + PARTS[b][1] <= 50)
    + "), "
    + ", ".join(f"{name} AS " + mi_sql(by, "yb", keys="subject, mod1, mod2, lag") for name, by in (("i1", "b1"), ("i2", "b2"), ("i12", "b1, b2")))
)


@query(VECTORS + " SELECT subject, mod1, mod2, lag, 'joint' AS method, round(i1.mi / ln(2), 5) AS r_u1, round(i2.mi / ln(2), 5) AS r_u2, round(i12.mi / ln(2), 5) AS total FROM i1 JOIN i2 USING (subject, mod1, mod2, lag) JOIN i12 USING (subject, mod1, mod2, lag) UNION ALL SELECT DISTINCT l.subject, 'm24', 'm28', l.lag, CASE WHEN floor((n - lag) * 0.8::DOUBLE) BETWEEN 1 AND n - lag - 1 THEN 'batch' ELSE 'failed' END, NULL, NULL, NULL FROM l")
def rus_vector_modalities(spark, d):
    """Every subject, pair and lag with its method; of the counted pairs what the terms add up to, which no fit can tell for the others."""
    t = rus_vector_modalities_terms(spark, d)
    sums = {"r_u1": F.col("R") + F.col("U1"), "r_u2": F.col("R") + F.col("U2"), "total": F.col("MI")}
    return t.select("subject", "mod1", "mod2", "lag", "method", *[F.when(F.col("method") == "joint", F.round(F.greatest(F.lit(0.0), v), 5)).alias(k) for k, v in sums.items()])


@query()
def temporal_pid_auto(spark, d):
    """Narrow, wide and very wide vectors, each by the method their width asks for."""
    h = halves(spark, d).select("vec_id", *[F.slice(c, 1, w).alias(f"{c}{w}") for c in ("a", "b") for w in (5, 16, 32)], "y", F.floor(F.col("vec_id") / 1000).alias("part"))
    classes = (h.agg(F.max("y")).first()[0] or 0) + 1
    pairs = [(f"a{w}", f"b{w}") for w in (5, 16, 32)]
    return Q.vector_terms(S.series_index(h, ["part"], ["vec_id"]), ["part"], "vec_id", pairs, "y", classes)


@query()
def pid_standalone(spark, d):
    return L.learned_terms(batches(spark, d), [], CLASSES)


@query("WITH s AS (SELECT event_id FROM events) SELECT CAST(1 AS BIGINT) AS best1, CAST(2 AS BIGINT) AS best2")
def synthetic_causal_series(spark, d):
    """A label that follows one signal by one step and another by two: where the information peaks. As long as the events table."""
    from pyspark.sql import Window

    from lagweave.sources.synthetic import causal_series

    s = causal_series(table(spark, d, "events").select("event_id"), "event_id", 400)
    h = I.joint_hist_multilag(s, ["subject"], [("x1", "x2")], "y", 4, 3).groupBy("lag", "b1", "b2", "yb").agg(F.sum("n").alias("n"))
    found = I.information(h, ["lag"])
    return found.agg(F.max_by("lag", "i1").cast("long").alias("best1"), F.max_by("lag", "i2").cast("long").alias("best2"))
