"""Cohort tasks end to end: raw events to wide series, stay records, splits, aligned modalities and datasets (2.L, 2.E8, 2.E9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lagweave.functions import arrays as A
from lagweave.operators import aggregate as G
from lagweave.operators import cohort as H
from lagweave.operators import joins as J
from lagweave.operators import resampled as Q
from lagweave.operators import series as S
from lagweave.sources.storage import new_path, written

from .base import ADMISSIONS, admissions, measures, query, table
from .cleaning import MATCHED, died

KINDS = ["click", "error", "purchase", "signup", "view"]
LABS, VITALS = ["click", "view", "view_1"], ["purchase", "signup"]
NAMES = [*LABS, *VITALS]
DIMS = {"images": 4, "notes": 4}

ITEM = "10 * list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) + event_id % 3"
QUOTED = ", ".join(f"'{n}'" for n in NAMES)
VECTOR = "(SELECT stay_id, icu, event_id, CAST(unnest(range(0, 4)) AS BIGINT) AS pos, CAST(unnest(embedding[{a}:{b}]) AS DOUBLE) AS v FROM located JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings) WHERE stay_id IS NOT NULL AND {kind})"
BASE = (
    "WITH los AS (SELECT event_id AS stay_id, user_id AS subject, ts AS intime, ts + to_hours(12 * (1 + event_id % 12)) AS outtime FROM events WHERE event_type = 'signup'), "
    + ADMISSIONS
    + ", "
    + MATCHED.format(id="stay_id", a="intime", b="outtime", t="los")
    + ", "
    + MATCHED.format(id="hadm_id", a="admittime", b="dischtime", t="admissions").replace("matched AS", "admitted AS")
    + """, located AS (SELECT e.event_id, e.event_type, e.user_id AS subject, e.ts, e.value, w.hadm_id, m.stay_id, date_diff('microsecond', a.admittime, e.ts) / 3.6e9 AS hosp, date_diff('microsecond', s.intime, e.ts) / 3.6e9 AS icu
  FROM events e LEFT JOIN (SELECT * FROM admitted WHERE r = 1) w USING (event_id) LEFT JOIN (SELECT * FROM matched WHERE r = 1) m USING (event_id) LEFT JOIN admissions a USING (hadm_id) LEFT JOIN los s USING (stay_id)),
items AS (SELECT DISTINCT """
    + ITEM
    + """ AS itemid, CASE WHEN event_id % 3 = 0 THEN event_type ELSE concat(event_type, '_', event_id % 3) END AS label FROM events),
names AS (SELECT label, min(itemid) AS itemid FROM items WHERE label IN ("""
    + QUOTED
    + """) GROUP BY label),
wide AS (SELECT subject, hadm_id, stay_id, hosp, icu, """
    + ", ".join(f"arg_min(value, event_id) FILTER (label = '{n}') AS {n}" for n in NAMES)
    + f" FROM located JOIN names ON itemid = {ITEM} WHERE hadm_id IS NOT NULL AND value IS NOT NULL GROUP BY ALL)"
)


def long_stays(spark, d):
    """Stays of half a day to six days."""
    e = table(spark, d, "events").where("event_type = 'signup'")
    hours = F.make_dt_interval(hours=(F.lit(12) * (1 + F.col("event_id") % 12)).cast("int"))
    return e.select(F.col("event_id").alias("stay_id"), F.col("user_id").alias("subject"), F.col("ts").alias("intime"), (F.col("ts") + hours).alias("outtime"))


def measured(spark, d):
    """Measurements with item numbers and units."""
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event"))
    return measures(spark, d).select("*", (10 * place + F.col("event_id") % 3).alias("itemid"), F.concat(F.lit("u"), (F.col("event_id") % 2).cast("string")).alias("unit"))


def located(spark, d):
    """All measurements with the admission and the stay they fall in, written once for the sources that are made of them."""
    n = table(spark, d, "events").count()
    return written(H.inside_stays(measured(spark, d), admissions(spark, d), long_stays(spark, d), ["subject"], "event_id", "charttime", rows=n), "located")


def dictionary(spark, d, wanted):
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type"))
    k = F.col("event_id") % 3
    items = table(spark, d, "events").select((10 * place + k).alias("itemid"), F.when(k == 0, F.col("event_type")).otherwise(F.concat_ws("_", "event_type", k.cast("string"))).alias("label")).distinct()
    return J.dictionary(items, wanted, "label", "itemid", "itemid")


def named(spark, d, rows):
    """Laboratory and bedside events, each looked up in its own dictionary."""
    labs, vitals = rows.where("event in ('click', 'view')"), rows.where("event in ('purchase', 'signup')")
    return H.named_events([(labs, dictionary(spark, d, LABS)), (vitals, dictionary(spark, d, VITALS))], "itemid")


def wide(spark, d, rows):
    return H.irregular_series(named(spark, d, rows), ["subject"], "label", "valuenum", "event_id", NAMES)


def vectors(spark, d, rows, condition, first):
    """Events that stand for notes or images: four numbers of a vector, inside stays."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("_v"), F.slice(F.col("embedding").cast("array<double>"), first, 4).alias("v"))
    n = v.count()
    return rows.where("stay_id is not null").where(condition).withColumn("_v", F.col("event_id") % n).join(v, "_v").select("stay_id", "icu", "event_id", "v")


@query(BASE + " SELECT subject, hadm_id, stay_id, round(hosp, 6) AS hosp, round(icu, 6) AS icu, " + ", ".join(NAMES) + " FROM wide")
def build_irregular_series(spark, d):
    """Dictionary, admission and stay, union of the sources, first value of a time, one column a name."""
    return wide(spark, d, located(spark, d)).withColumns({"hosp": F.round("hosp", 6), "icu": F.round("icu", 6)})


@query(BASE + f" SELECT DISTINCT n.label, n.itemid, concat('u', event_id % 2) AS unit FROM events JOIN names n ON n.itemid = {ITEM}")
def unit_map(spark, d):
    return named(spark, d, measured(spark, d)).select("label", "itemid", "unit").distinct()


MODALITIES = (
    BASE
    + ", irregular AS (SELECT * FROM wide WHERE stay_id IS NOT NULL), flat AS (UNPIVOT irregular ON "
    + ", ".join(NAMES)
    + """ INTO NAME c VALUE v), b AS (SELECT stay_id, c, CAST(trunc(icu) AS BIGINT) AS t, avg(v) AS v FROM flat GROUP BY ALL),
grid AS (SELECT stay_id, CAST(unnest(range(0, max(CAST(trunc(icu) AS BIGINT)) + 1)) AS BIGINT) AS t FROM irregular GROUP BY stay_id), every AS (SELECT DISTINCT c, avg(v) OVER (PARTITION BY c) AS mean FROM flat),
k AS (SELECT stay_id, c, t, mean, v, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS i0, first_value(v IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER f AS i1
  FROM grid CROSS JOIN every LEFT JOIN b USING (stay_id, c, t) WINDOW b AS (PARTITION BY stay_id, c ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY stay_id, c ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
regular AS (SELECT stay_id, t, c, coalesce(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - i0) / (i1 - i0) END, mean) AS v FROM k),
notes AS """
    + VECTOR.format(a=1, b=4, kind="event_type = 'error'")
    + ", images AS "
    + VECTOR.format(a=5, b=8, kind="event_type = 'click' AND event_id % 3 = 1")
)


def modalities(spark, d, hours=None, valid=None):
    """The four modalities of stays, and the column that holds each one's time. The series are written, as several steps read them; the
    regular one is made of the first `hours` of the valid stays."""
    rows = located(spark, d)
    irregular = written(wide(spark, d, rows).where("stay_id is not null"), "irregular")
    regular = written(S.impute(irregular, ["stay_id"], "icu", NAMES, 1.0, hours, valid), "regular")
    return {"irregular": irregular, "regular": regular, "notes": vectors(spark, d, rows, "event = 'error'", 1), "images": vectors(spark, d, rows, "event = 'click' and event_id % 3 = 1", 5)}


TIMES = {"irregular": "icu", "regular": "t", "notes": "icu", "images": "icu"}


def task(spark, d, hours, least_days, min_rows, include_missing):
    valid = long_stays(spark, d).where(S.hours_between(F.col("intime"), F.col("outtime")) >= 24 * least_days)
    rows = H.task_window(modalities(spark, d, hours, valid), TIMES, valid, "stay_id", hours, least_days, min_rows, ("notes", "images"))
    needed = {m: df for m, df in rows.items() if m != "regular"}
    return H.split_and_standardize(rows, H.task_stays(needed, "stay_id", include_missing), "stay_id", 5, ("irregular", "regular"), NAMES)


#: Stays of a part that holds whole records.
STAYS = 5000


def stay_rows(spark, d, rows, ids):
    """One nested row a stay: its ids and label, and each modality's steps in time order."""
    stays = ids.count()
    dealt = lambda df: S.spread(df, ["stay_id"], stays, STAYS)
    nested = {m: H.ordered(dealt(df).select("stay_id", TIMES[m], *[c.alias(n) for n, c in (H.series_steps(NAMES) if m in ("irregular", "regular") else {"v": F.col("v"), "event_id": F.col("event_id")}).items()]), "stay_id", TIMES[m], ["v", "observed"] if m in ("irregular", "regular") else ["event_id", "v"], m) for m, df in rows.items()}
    heads = rows["irregular"].groupBy("stay_id").agg(F.min("hadm_id").alias("hadm_id"))
    labels = died(spark, d).select("hadm_id", "died")
    spans = long_stays(spark, d).withColumn("hours", S.hours_between(F.col("intime"), F.col("outtime"))).select("stay_id", "subject", "hours")
    base = dealt(dealt(ids).join(heads, "stay_id").join(spans, "stay_id").join(labels, "hadm_id"))
    return H.stay_records(base, "stay_id", nested, ["irregular"])


CUT = """, died AS (SELECT a.hadm_id, max(CASE WHEN e.event_type = 'error' AND e.ts BETWEEN a.admittime AND a.dischtime THEN 1 ELSE 0 END) AS died FROM admissions a LEFT JOIN events e ON e.user_id = a.subject GROUP BY 1),
valid AS (SELECT stay_id, subject, date_diff('microsecond', intime, outtime) / 3.6e9 AS hours FROM los WHERE date_diff('microsecond', intime, outtime) / 3.6e9 >= {least} * 24),
ir AS (SELECT * FROM irregular JOIN valid USING (stay_id) WHERE icu BETWEEN 0 AND {hours}), re AS (SELECT * FROM regular JOIN valid USING (stay_id) WHERE t BETWEEN 0 AND {hours}),
no AS (SELECT * FROM notes JOIN valid USING (stay_id) WHERE icu BETWEEN 0 AND {hours} QUALIFY count(DISTINCT event_id) OVER (PARTITION BY stay_id) >= {rows}), im AS (SELECT * FROM images JOIN valid USING (stay_id) WHERE icu BETWEEN 0 AND {hours} QUALIFY count(DISTINCT event_id) OVER (PARTITION BY stay_id) >= {rows}),
ids AS (SELECT DISTINCT stay_id FROM ir {op} SELECT DISTINCT stay_id FROM no {op} SELECT DISTINCT stay_id FROM im),
ranks AS (SELECT stay_id, row_number() OVER (ORDER BY md5(concat('5:', CAST(stay_id AS VARCHAR))), stay_id) - 1 AS rank, count(*) OVER () AS total FROM ids),
split AS (SELECT stay_id, CASE WHEN rank < trunc(0.7::DOUBLE * total) THEN 'train' WHEN rank < trunc(0.7::DOUBLE * total) + trunc(0.15::DOUBLE * total) THEN 'val' ELSE 'test' END AS split FROM ranks),
irf AS (SELECT * FROM (UNPIVOT ir ON {names} INTO NAME c VALUE v)),
si AS (SELECT c, avg(v) AS m, stddev_pop(v) AS s FROM irf JOIN split USING (stay_id) WHERE split = 'train' GROUP BY c), sr AS (SELECT c, avg(v) AS m, stddev_pop(v) AS s FROM re JOIN split USING (stay_id) WHERE split = 'train' GROUP BY c),
per AS (SELECT stay_id, min(hadm_id) AS hadm_id, count(*) AS irregular_n FROM ir GROUP BY stay_id),
vi AS (SELECT stay_id, count(*) AS observed_n, sum(abs((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END)) AS irregular_size FROM irf JOIN si USING (c) GROUP BY stay_id),
vr AS (SELECT stay_id, count(DISTINCT t) AS regular_n, sum(abs((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END)) AS regular_size FROM re JOIN sr USING (c) GROUP BY stay_id),
vn AS (SELECT stay_id, count(DISTINCT event_id) AS notes_n, sum(v) AS notes_sum FROM no GROUP BY stay_id), vm AS (SELECT stay_id, count(DISTINCT event_id) AS images_n, sum(v) AS images_sum FROM im GROUP BY stay_id),
records AS (SELECT stay_id, subject, hadm_id, split, hours, CAST(died AS BIGINT) AS died, CAST(CASE WHEN hours < 96 AND died = 0 THEN 1 ELSE 0 END AS BIGINT) AS short, CAST(irregular_n AS BIGINT) AS irregular_n, CAST(observed_n AS BIGINT) AS observed_n, irregular_size, CAST(coalesce(regular_n, 0) AS BIGINT) AS regular_n, coalesce(regular_size, 0) AS regular_size,
  CAST(coalesce(notes_n, 0) AS BIGINT) AS notes_n, coalesce(notes_sum, 0) AS notes_sum, CAST(notes_n IS NULL AS BIGINT) AS notes_missing, CAST(coalesce(images_n, 0) AS BIGINT) AS images_n, coalesce(images_sum, 0) AS images_sum, CAST(images_n IS NULL AS BIGINT) AS images_missing
  FROM per JOIN split USING (stay_id) JOIN valid USING (stay_id) JOIN died USING (hadm_id) LEFT JOIN vi USING (stay_id) LEFT JOIN vr USING (stay_id) LEFT JOIN vn USING (stay_id) LEFT JOIN vm USING (stay_id))"""


def cut(hours, least, rows, op):
    return MODALITIES + CUT.format(hours=hours, least=least, rows=rows, op=op, names=", ".join(NAMES))


def digests(records):
    """Counts and sums of a stay's arrays."""
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + A.total(F.transform(x["v"], F.abs)))
    plain = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + A.total(x["v"]))
    seen = F.aggregate("irregular", F.lit(0).cast("long"), lambda s, x: s + F.aggregate(x["observed"], F.lit(0).cast("long"), lambda p, q: p + q))
    n = {f"{m}_n": F.size(m).cast("long") for m in TIMES}
    return records.withColumns(n | {"observed_n": seen, "irregular_size": size("irregular"), "regular_size": size("regular"), "notes_sum": plain("notes"), "images_sum": plain("images"), "short": H.los_label(F.col("hours"), F.col("died"))})


@query(cut(48, 0, 0, "UNION") + " SELECT stay_id, subject, hadm_id, split, died, irregular_n, observed_n, round(irregular_size, 4) AS irregular_size, regular_n, round(regular_size, 4) AS regular_size, notes_n, round(notes_sum, 4) AS notes_sum, notes_missing, images_n, round(images_sum, 4) AS images_sum, images_missing FROM records")
def build_stay_records(spark, d):
    """Nested stays of four modalities, missing ones flagged, series standardised."""
    split, rows, _ = task(spark, d, 48, 0, 0, True)
    rounded = {c: F.round(c, 4) for c in ("irregular_size", "regular_size", "notes_sum", "images_sum")}
    return digests(stay_rows(spark, d, rows, split)).withColumns(rounded).select("stay_id", "subject", "hadm_id", "split", "died", "irregular_n", "observed_n", "irregular_size", "regular_n", "regular_size", "notes_n", "notes_sum", "notes_missing", "images_n", "images_sum", "images_missing")


BY_SPLIT = " SELECT split, CAST(count(*) AS BIGINT) AS stays, CAST(sum({label}) AS BIGINT) AS positive, CAST(sum(irregular_n) AS BIGINT) AS irregular_n, CAST(sum(observed_n) AS BIGINT) AS observed_n, round(sum(irregular_size), 4) AS irregular_size, CAST(sum(regular_n) AS BIGINT) AS regular_n, round(sum(regular_size), 4) AS regular_size, CAST(sum(notes_n) AS BIGINT) AS notes_n, CAST(sum(images_n) AS BIGINT) AS images_n FROM records GROUP BY split"


def task_summary(spark, d, hours, least_days, min_rows, include_missing, label):
    """The task's nested stays written by split beside their scalers, read back and counted."""
    split, rows, scalers = task(spark, d, hours, least_days, min_rows, include_missing)
    path = new_path(spark, "task")
    stay_rows(spark, d, rows, split).write.partitionBy("split").parquet(f"{path}/stays")
    for name, fitted in scalers.items():
        fitted.write.parquet(f"{path}/scaler-{name}")
    r = digests(spark.read.parquet(f"{path}/stays"))
    sums = [F.sum(c).alias(c) for c in ("irregular_n", "observed_n", "regular_n", "notes_n", "images_n")]
    return r.groupBy("split").agg(F.count("*").alias("stays"), F.sum(label).alias("positive"), *sums, *[F.round(F.sum(c), 4).alias(c) for c in ("irregular_size", "regular_size")])


@query(cut(48, 2, 1, "INTERSECT") + BY_SPLIT.format(label="died"))
def task_mortality(spark, d):
    """The first 48 hours of stays of two days or more that have every modality."""
    return task_summary(spark, d, 48, 2, 1, False, "died")


@query(cut(48, 2, 2, "UNION") + BY_SPLIT.format(label="short"))
def task_los(spark, d):
    """The same window with missing modalities allowed and at least two notes or images; the label is a stay under 96 hours that was survived."""
    return task_summary(spark, d, 48, 2, 2, True, "short")


ALIGNED = MODALITIES + """, steps AS (SELECT stay_id, CAST(max(t) + 1 AS BIGINT) AS n FROM regular GROUP BY stay_id), many AS (SELECT stay_id FROM irregular GROUP BY stay_id HAVING count(*) > 2),
every_step AS (SELECT stay_id, t, modality, pos FROM grid SEMI JOIN many USING (stay_id) CROSS JOIN (VALUES ('notes'), ('images')) m(modality) CROSS JOIN (SELECT CAST(unnest(range(0, 4)) AS BIGINT) AS pos)),
placed AS (SELECT 'notes' AS modality, * FROM notes UNION ALL SELECT 'images', * FROM images), bucketed AS (SELECT modality, stay_id, CAST(trunc(icu) AS BIGINT) AS t, pos, avg(v) AS v FROM placed GROUP BY ALL),
known AS (SELECT modality, stay_id, t, pos, v, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS i0, first_value(v IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER f AS i1
  FROM every_step LEFT JOIN bucketed USING (modality, stay_id, t, pos) WINDOW b AS (PARTITION BY modality, stay_id, pos ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY modality, stay_id, pos ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lines AS (SELECT modality, stay_id, t, pos, v, CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - i0) / (i1 - i0) END AS w FROM known),
aligned AS (SELECT modality, stay_id, t, coalesce(sum(v), 0) AS zeroed, count(v) > 0 AS mask, coalesce(sum(w), 0) AS filled, count(w) > 0 AS filled_mask FROM lines GROUP BY ALL)"""


def busy(rows, more_than=2):
    """Stays with more than `more_than` irregular rows."""
    return rows["irregular"].groupBy("stay_id").count().where(F.col("count") > more_than)


def aligned(spark, d, interpolate, rows=None, more_than=2):
    """Notes and images on the steps of the stays' regular series, for stays with more than `more_than` irregular rows."""
    rows = rows or modalities(spark, d)
    steps = written(J.keep_valid(rows["regular"].groupBy("stay_id").agg((F.max("t") + 1).alias("n")), busy(rows, more_than), "stay_id"), "steps")  # both modalities read it
    each = [S.align_vectors(rows[m], steps, "stay_id", "icu", "v", k, 1.0, interpolate).withColumn("modality", F.lit(m)) for m, k in DIMS.items()]
    return each[0].unionByName(each[1])


@query(ALIGNED + " SELECT modality, stay_id, t, round(zeroed, 6) AS zeroed, mask, round(filled, 6) AS filled, filled_mask FROM aligned")
def align_irregular(spark, d):
    """Vectors on a grid of hours, once with zeros and a mask, once with lines between them."""
    rows = modalities(spark, d)
    keys = ["modality", "stay_id", "t"]
    zeroed = aligned(spark, d, False, rows).select(*keys, F.round(A.total(F.col("v")), 6).alias("zeroed"), "mask")
    return zeroed.join(aligned(spark, d, True, rows).select(*keys, F.round(A.total(F.col("v")), 6).alias("filled"), F.col("mask").alias("filled_mask")), keys)


WITH_REGULAR = ALIGNED + """, died AS (SELECT a.hadm_id, max(CASE WHEN e.event_type = 'error' AND e.ts BETWEEN a.admittime AND a.dischtime THEN 1 ELSE 0 END) AS died FROM admissions a LEFT JOIN events e ON e.user_id = a.subject GROUP BY 1),
labels_of AS (SELECT stay_id, CAST(died AS BIGINT) AS label FROM (SELECT stay_id, min(hadm_id) AS hadm_id FROM irregular GROUP BY stay_id) JOIN died USING (hadm_id)),
everything AS (SELECT modality, stay_id, t, filled AS total, filled_mask AS mask FROM aligned UNION ALL SELECT 'series', stay_id, t, sum(v), true FROM regular SEMI JOIN many USING (stay_id) GROUP BY stay_id, t)"""


def all_modalities(spark, d, standardized=False):
    """Every step of the three modalities, the regular one's mask full, and the stays' labels."""
    rows = modalities(spark, d)
    if standardized:
        rows["regular"] = G.apply_standardizer(rows["regular"], written(G.fit_standardizer(rows["regular"], NAMES), "scaler"), NAMES)
    vectors_of = aligned(spark, d, True, rows)
    values = H.series_steps(NAMES)["v"]
    # the stays of vectors_of, without aligning vectors for their ids
    regular = J.keep_valid(rows["regular"], busy(rows), "stay_id").select("stay_id", "t", values.alias("v"), F.lit(True).alias("mask"), F.lit("series").alias("modality"))
    labels = rows["irregular"].groupBy("stay_id").agg(F.min("hadm_id").alias("hadm_id")).join(died(spark, d).select("hadm_id", F.col("died").alias("label")), "hadm_id").select("stay_id", "label")
    return vectors_of.unionByName(regular), labels


@query(WITH_REGULAR + " SELECT modality, stay_id, t, label, mask, round(total, 6) AS total FROM everything JOIN labels_of USING (stay_id)")
def align_all_modalities(spark, d):
    steps, labels = all_modalities(spark, d)
    return steps.join(labels, "stay_id").select("modality", "stay_id", "t", "label", "mask", F.round(A.total(F.col("v")), 6).alias("total"))


@query(WITH_REGULAR + " SELECT stay_id, label, CAST(24 AS BIGINT) AS n, " + ", ".join(f"CAST(count(*) FILTER (modality = '{m}' AND mask AND t < 24) AS BIGINT) AS {m}_mask, round(coalesce(sum(total) FILTER (modality = '{m}' AND t < 24), 0), 6) AS {m}" for m in ("images", "notes", "series")) + " FROM everything JOIN labels_of USING (stay_id) GROUP BY stay_id, label")
def sequence_dataset(spark, d):
    """The first 24 steps of the modalities in name order, filled up with zeros and a false mask."""
    steps, labels = all_modalities(spark, d)
    rows = H.sequence_dataset(steps, "stay_id", "modality", 24, DIMS | {"series": len(NAMES)}).join(labels, "stay_id")
    total = lambda m: F.round(F.aggregate(m, F.lit(0.0), lambda s, x: s + A.total(x["v"])), 6)
    seen = lambda m: F.size(F.filter(m, lambda x: x["mask"])).cast("long")
    return rows.select("stay_id", "label", F.size("series").cast("long").alias("n"), *[c for m in ("images", "notes", "series") for c in (seen(m).alias(f"{m}_mask"), total(m).alias(m))])


LEAD = """, n_of AS (SELECT stay_id, label, least(48, max(t) + 1) AS n FROM everything JOIN labels_of USING (stay_id) GROUP BY stay_id, label),
held AS (SELECT DISTINCT lag, stay_id FROM everything JOIN n_of USING (stay_id), (VALUES (0), (6), (12), (18), (24), (30), (36), (42)) v(lag) WHERE mask AND t < n - lag),
c AS (SELECT CAST(lag AS BIGINT) AS lag, count(*) AS n FROM held GROUP BY lag)"""
STAY_PAIRS = [("images", "notes"), ("images", "series"), ("notes", "series")]


def stay_steps(spark, d):
    """The first 48 hourly steps of every stay: a vector and a mask of each of its three modalities, the series standardised, and its label."""
    steps, labels = all_modalities(spark, d, True)
    each = [F.first(F.when(F.col("modality") == m, F.col(c)), True).alias(to) for m in ("images", "notes", "series") for c, to in (("v", m), ("mask", f"{m}_mask"))]
    wide_steps = written(steps.where("t < 48").groupBy("stay_id", "t").agg(*each), "steps")
    return wide_steps.withColumn("n", F.count("*").over(Window.partitionBy("stay_id"))).join(labels.withColumnRenamed("label", "y"), "stay_id")


def stay_terms(spark, d):
    masks = {m: f"{m}_mask" for m in ("images", "notes", "series")}
    return Q.sequence_batch(stay_steps(spark, d), "stay_id", STAY_PAIRS, "y", S.lag_grid(48, 8), 2, masks, "mean", size=256, resamples=10)


@query()
def rus_stays_terms(spark, d):
    """Every pair of the stays' three aligned modalities over 48 steps at eight lags: masked means of the steps that a lag leaves, fitted on 80 % of the stays, scored on the rest."""
    return stay_terms(spark, d)


@query(WITH_REGULAR + LEAD + " SELECT mod1, mod2, c.lag, CAST(trunc(n * 0.8::DOUBLE) AS BIGINT) AS train_rows, CAST(n - trunc(n * 0.8::DOUBLE) AS BIGINT) AS test_rows, true AS solved FROM c JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in STAY_PAIRS) + ") m(mod1, mod2) ON true")
def rus_stays_lags(spark, d):
    """The stays that fit and that are scored for each pair and lag, and that their couplings' gaps are closed."""
    return stay_terms(spark, d).select("mod1", "mod2", "lag", "train_rows", "test_rows", (F.col("gap") < 2e-7).alias("solved"))


@query()
def rus_stays(spark, d):
    """The whole analysis of stays: each pair's mean terms over the lags and the dominant term."""
    terms, keys = written(stay_terms(spark, d), "terms"), ["mod1", "mod2"]
    return G.average_over_lags(terms, keys).drop("lags").join(G.dominant_terms(terms, keys), keys)
