"""Model, classification, recurring-expense and file source/sink queries."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from ..operators import categorize as K
from ..operators import clean as C
from ..operators import forecast as M
from ..operators import models as T
from ..operators.evaluate import classification_report
from ..operators.recurring import MISSED, PERIODS, SHIFTED, recurring_expenses, recurring_patterns
from ..operators.sharded import ShardedModel, fit_sharded
from ..functions import half_even
from ..schema import EXPENSES, FORECAST_HISTORY, MIN_HISTORY
from ..sources import files as IO
from ..sources.synthetic import synthetic_expenses, synthetic_sql
from ..sources.tables import (exp_daily, exp_monthly, note_labels, raw_a, raw_b,
                              subscriptions, uploads, users)
from .q_clean import STAGES
from .q_forecast import M2_SQL, m2
from .q_reports import heven, msum, pyround
from .q_series import monthly
from ..session import discard, ensure_checkpoint_dir, materialize
from .registry import register

# --- fitted models are saved in shared storage and reloaded --------------

# raise it when the code of a fit changes its result
FIT_VERSION = 1


def _fitted(spark, kind, data, fit, **params):
    """The saved model for exactly these training rows and parameters,
    fitted and saved if there is none.  Its name holds the rows' number and
    the sum of their hashes, and a hash of the parameters, the fit's version
    and Spark's."""
    mark = data.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*data.columns).cast("decimal(38,0)"))).first()
    how = hashlib.sha256(json.dumps([FIT_VERSION, spark.version, params], sort_keys=True).encode()).hexdigest()[:16]
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{kind}-{mark[0]}-{mark[1]}-{how}"
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata/_SUCCESS")
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        T.save_model(fit(data, **params), path)
    return T.load_model(path)


def _monthly_model(spark, sf):
    train, test = T.monthly_split(monthly(spark, sf))
    return _fitted(spark, "monthly_trees", train, T.fit_monthly, params=T.MONTHLY_GBT), test


# --- boosted trees (rows-only: model training) ------------------------------

@register("boosted_tree_forecast")
def q_boosted_tree_forecast(spark, sf):
    return T.boosted_tree_forecast(exp_daily(spark, sf))


@register("boosted_tree_monthly")
def q_boosted_tree_monthly(spark, sf):
    return T.predict_monthly(*_monthly_model(spark, sf))


@register("feature_importance")
def q_feature_importance(spark, sf):
    return T.feature_importance(_monthly_model(spark, sf)[0])


@register("monthly_recursive_forecast")
def q_monthly_recursive_forecast(spark, sf):
    model = _monthly_model(spark, sf)[0]
    return T.monthly_recursion(monthly(spark, sf), T.tree_predictor(model, T.MONTHLY_FEATURES), 6)


# --- the recursions with a fixed predictor in the trees' place, held against SQL

def daily_stand_in(f):
    """Uses every feature, so that each one's value shows in the result."""
    return (0.5 * f["lag_1"] + 0.02 * f["lag_2"] + 0.03 * f["lag_3"] + 0.2 * f["lag_7"] + 0.1 * f["lag_14"]
            + 0.1 * f["rolling_mean_7"] + 0.05 * f["rolling_mean_14"] + 0.2 * f["rolling_std_7"] - 30.0 * f["is_weekend"]
            + 0.1 * f["day"] + 0.2 * f["month"] + 0.3 * f["quarter"] + 0.04 * f["weekofyear"] + 0.01 * f["dayofyear"]
            + 0.5 * f["dayofweek"] - 5.0)


_NEXT = "(last_ds + CAST(k + 1 AS INTEGER))"
_M6 = "(list_sum(v[-6:]) / 6)"
DAILY_STEP = f"""greatest(0.5 * v[-1] + 0.02 * v[-2] + 0.03 * v[-3] + 0.2 * v[-7] + 0.1 * v[-14]
  + 0.1 * {_M6} + 0.05 * (list_sum(v[-13:]) / 13)
  + 0.2 * sqrt(list_sum(list_transform(v[-6:], lambda x: (x - {_M6}) * (x - {_M6}))) / 5)
  - 30.0 * (isodow({_NEXT}) >= 6)::INT + 0.1 * day({_NEXT}) + 0.2 * month({_NEXT}) + 0.3 * quarter({_NEXT})
  + 0.04 * weekofyear({_NEXT}) + 0.01 * dayofyear({_NEXT}) + 0.5 * (isodow({_NEXT}) - 1) - 5.0, 0.0)"""


@register("daily_recursion", f"""
WITH RECURSIVE d AS (SELECT user_id, date AS ds, {msum('amount')} AS y FROM exp_daily WHERE date IS NOT NULL GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ds DESC) AS r,
             COUNT(*) OVER (PARTITION BY user_id) AS n FROM d),
s AS (SELECT user_id, MAX(ds) AS last_ds, list(y ORDER BY ds) AS v FROM l WHERE r <= 14 AND n >= {MIN_HISTORY['trees']} GROUP BY 1),
w AS (SELECT user_id, last_ds, 0 AS k, v FROM s
      UNION ALL SELECT user_id, last_ds, k + 1, list_append(v, {DAILY_STEP}) FROM w WHERE k < 30),
f AS (SELECT user_id, last_ds + CAST(k AS INTEGER) AS ds, v[-1] AS p FROM w WHERE k > 0)
SELECT user_id, ds, {heven('p', 6)} AS yhat, {heven('(p * 0.8)', 6)} AS yhat_lower, {heven('(p * 1.2)', 6)} AS yhat_upper FROM f""",
          ("exp_daily",))
def q_daily_recursion(spark, sf):
    """M3's rows, features, state, clipping and band."""
    fc = T.boosted_tree_forecast(exp_daily(spark, sf), predict=daily_stand_in)
    return fc.select("user_id", "ds", *[half_even(c, 6).alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")])


def monthly_stand_in(f):
    return (0.6 * f["lag_1"] + 0.1 * f["lag_2"] + 0.1 * f["lag_3"] + 0.1 * f["rolling_3"] + 0.1 * f["rolling_6"]
            + 100.0 * f["month_num"] + 10.0 * f["quarter"] + 1.0 * f["year_num"])


_NEXT_M = "CAST(last_ds + to_months(CAST(k + 1 AS INTEGER)) AS DATE)"


@register("monthly_recursion", f"""
WITH RECURSIVE ms AS (SELECT CAST(date_trunc('month', date) AS DATE) AS ds, {msum('amount')} AS y FROM exp_monthly
  WHERE date IS NOT NULL AND amount > 0 AND amount <= 100000.0 GROUP BY 1),
l6 AS (SELECT ds, y FROM ms ORDER BY ds DESC LIMIT 6),
s AS (SELECT MAX(ds) AS last_ds, list(y ORDER BY ds) AS v FROM l6),
w AS (SELECT last_ds, 0 AS k, v, CAST(NULL AS DOUBLE[]) AS old FROM s
      UNION ALL SELECT last_ds, k + 1, list_append(v, 0.6 * v[-1] + 0.1 * v[-2] + 0.1 * v[-3] + 0.1 * (list_sum(v[-3:]) / 3)
        + 0.1 * (list_sum(v[-6:]) / 6) + 100.0 * month({_NEXT_M}) + 10.0 * quarter({_NEXT_M}) + 1.0 * year({_NEXT_M})), v
      FROM w WHERE k < 6),
f AS (SELECT CAST(last_ds + to_months(CAST(k AS INTEGER)) AS DATE) AS ds, old AS v, v[-1] AS p FROM w WHERE k > 0)
SELECT ds, CAST(month(ds) AS INTEGER) AS month_num, CAST(year(ds) AS INTEGER) AS year_num, CAST(quarter(ds) AS INTEGER) AS quarter,
       {heven('v[-1]', 3)} AS lag_1, {heven('v[-2]', 3)} AS lag_2, {heven('v[-3]', 3)} AS lag_3,
       {heven('(list_sum(v[-3:]) / 3)', 3)} AS rolling_3, {heven('(list_sum(v[-6:]) / 6)', 3)} AS rolling_6,
       {heven('p', 3)} AS predicted FROM f""", ("exp_monthly",))
def q_monthly_recursion(spark, sf):
    """M5's rows, features and state."""
    out = T.monthly_recursion(monthly(spark, sf), monthly_stand_in, 6)
    return out.select("ds", "month_num", "year_num", "quarter",
                      *[half_even(c, 3).alias(c) for c in ("lag_1", "lag_2", "lag_3", "rolling_3", "rolling_6", "predicted")])


# --- classification -----------------------------------------------------------

@register("train_test_split", """
SELECT *, CASE WHEN substr(md5('42|' || clean_notes || '|' || CAST(doc_id AS VARCHAR)), 1, 8) < '33333333'
          THEN 'test' ELSE 'train' END AS split FROM note_labels""", ("note_labels",))
def q_train_test_split(spark, sf):
    return K.train_test_split(note_labels(spark, sf), key=("clean_notes", "doc_id"))


@register("tfidf_features", """
WITH tok AS (SELECT doc_id, unnest(string_split(clean_notes, ' ')) AS token FROM note_labels),
tf AS (SELECT doc_id, token, COUNT(*) AS tf FROM tok WHERE length(token) >= 2 GROUP BY 1, 2),
dfq AS (SELECT token, COUNT(*) AS df FROM tf GROUP BY 1),
idf AS (SELECT token, ln((1.0 + (SELECT CAST(COUNT(*) AS DOUBLE) FROM note_labels)) / (1.0 + df)) + 1.0 AS idf
        FROM dfq),
w AS (SELECT tf.doc_id, tf.token, tf.tf * idf.idf AS w FROM tf JOIN idf USING (token)),
nrm AS (SELECT doc_id, sqrt(SUM(w * w)) AS norm FROM w GROUP BY 1)
SELECT doc_id, token, round_even(w / norm * 1000000000.0, 0) / 1000000000.0 AS tfidf
FROM w JOIN nrm USING (doc_id)""", ("note_labels",))
def q_tfidf_features(spark, sf):
    return K.tfidf_features(note_labels(spark, sf))


@register("keep_frequent_categories", f"""WITH {STAGES}
SELECT * FROM final WHERE category IN (SELECT category FROM final GROUP BY 1 HAVING COUNT(*) >= 20)""",
          ("raw_a", "raw_b"))
def q_keep_frequent_categories(spark, sf):
    # the cleaned rows are read twice (count, filter): written once
    return K.keep_frequent_categories(
        materialize(C.clean_transactions(raw_a(spark, sf), raw_b(spark, sf)), "cleaned"))


def _split(notes):
    return K.train_test_split(K.keep_frequent_categories(notes), key=("clean_notes", "doc_id"))


def _category_model(spark, split):
    return _fitted(spark, "category", split.filter(F.col("split") == "train"), K.train_category_model,
                   max_iter=1000, tol=1e-4)


def _predicted(model, table, rows):
    """The predictions; a table model has laid out the rows by then, and
    nothing reads their table any more."""
    out = K.predict_category(model, rows)
    if isinstance(model, ShardedModel):
        discard(table)
    return out


@register("train_category_model")
def q_train_category_model(spark, sf):
    # read for the model's name, the fit and the test rows: the texts are cleaned once
    split = materialize(_split(note_labels(spark, sf)), "split")
    return _predicted(_category_model(spark, split), split, split.filter(F.col("split") == "test"))


@register("train_category_model_sharded")
def q_train_category_model_sharded(spark, sf):
    """K3 with its coefficients in a table, on the same rows."""
    split = materialize(_split(note_labels(spark, sf)), "split")
    model = fit_sharded(split.filter(F.col("split") == "train"))
    return _predicted(model, split, split.filter(F.col("split") == "test"))


@register("predict_category")
def q_predict_category(spark, sf):
    notes = materialize(note_labels(spark, sf), "notes")  # cleaned once, as above
    return _predicted(_category_model(spark, _split(notes)), notes, notes)


def counted_model(notes) -> ShardedModel:
    """A model in table form without a fit: a token's weight for a category
    is the log of how often the category's notes hold it."""
    labels = [r[0] for r in notes.filter("category IS NOT NULL").select("category").distinct().orderBy("category").collect()]
    # a note's tokens are counted in its row; only notes that share an id meet by it
    ids = notes.filter("doc_id IS NOT NULL")
    shared = materialize(ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "shared")
    words = F.array_distinct(F.filter(F.split("clean_notes", " "), lambda t: F.length(t) >= K.TOKEN_MIN))
    single = ids.join(shared, "doc_id", "left_anti").select("category", F.explode(words).alias("token"))
    double = ids.join(shared, "doc_id", "left_semi")
    several = K.tokens(double, "clean_notes", "doc_id").join(double.select("doc_id", "category"), "doc_id").distinct()
    seen = single.unionByName(several.select("category", "token"))
    n = notes.count()
    w = F.array(*[F.log((1.0 + F.count_if(F.col("category") == c)) / (1.0 + F.count(F.lit(1)))) for c in labels])
    table = seen.groupBy("token").agg((F.log(F.lit(1.0 + n) / (1.0 + F.count(F.lit(1)))) + 1.0).alias("idf"), w.alias("w"))
    return ShardedModel(materialize(table, "counted"), labels, [0.1 * i for i in range(len(labels))], [])


@register("predict_category_table", f"""
WITH tok AS (SELECT doc_id, unnest(string_split(clean_notes, ' ')) AS token FROM note_labels),
tf AS (SELECT doc_id, token, COUNT(*) AS tf FROM tok WHERE length(token) >= 2 GROUP BY 1, 2),
cats AS (SELECT category AS c, row_number() OVER (ORDER BY category) - 1 AS i
         FROM (SELECT DISTINCT category FROM note_labels WHERE category IS NOT NULL)),
idf AS (SELECT token, COUNT(*) AS df, ln((1.0 + (SELECT CAST(COUNT(*) AS DOUBLE) FROM note_labels)) / (1.0 + COUNT(*))) + 1.0 AS idf
        FROM tf GROUP BY 1),
nc AS (SELECT token, category AS c, COUNT(*) AS n FROM tf JOIN note_labels USING (doc_id) GROUP BY 1, 2),
w AS (SELECT idf.token, cats.c, ln((1.0 + COALESCE(n, 0)) / (1.0 + df)) AS w
      FROM idf CROSS JOIN cats LEFT JOIN nc ON nc.token = idf.token AND nc.c = cats.c),
x AS (SELECT doc_id, token, tf * idf / sqrt(SUM(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS v FROM tf JOIN idf USING (token)),
m AS (SELECT doc_id, c, SUM(v * w) AS m FROM x JOIN w USING (token) GROUP BY 1, 2),
z AS (SELECT nl.doc_id, cats.c, COALESCE(m, 0.0) + 0.1 * i AS z
      FROM note_labels nl CROSS JOIN cats LEFT JOIN m ON m.doc_id = nl.doc_id AND m.c = cats.c),
p AS (SELECT doc_id, c, exp(z - MAX(z) OVER q) / SUM(exp(z)) OVER q * exp(MAX(z) OVER q) AS p FROM z WINDOW q AS (PARTITION BY doc_id)),
b AS (SELECT doc_id, arg_max(c, p) AS predicted_category, MAX(p) AS pm FROM p GROUP BY 1)
SELECT nl.*, predicted_category, {pyround('pm', 3)} AS confidence FROM note_labels nl JOIN b USING (doc_id)""", ("note_labels",))
def q_predict_category_table(spark, sf):
    """K4's rows, weighting, probabilities and rounding with a model that SQL
    can make as well."""
    notes = note_labels(spark, sf)
    return K.predict_category(counted_model(notes), notes)


_REPORT = f"""WITH {STAGES},
pr AS (SELECT m.category AS label, d.dominant_category AS prediction FROM mapped m JOIN dom d ON d.notes = m.notes),
conf AS (SELECT label, prediction, COUNT(*) AS n FROM pr GROUP BY 1, 2),
tp AS (SELECT label AS cls, n AS tp FROM conf WHERE label = prediction),
sup AS (SELECT label AS cls, SUM(n) AS support FROM conf GROUP BY 1),
prd AS (SELECT prediction AS cls, SUM(n) AS predicted FROM conf GROUP BY 1),
per0 AS (SELECT COALESCE(sup.cls, prd.cls) AS cls, COALESCE(support, 0) AS support,
                COALESCE(predicted, 0) AS predicted FROM sup FULL OUTER JOIN prd ON sup.cls = prd.cls),
per1 AS (SELECT per0.*, COALESCE(tp.tp, 0) AS tp FROM per0 LEFT JOIN tp ON tp.cls = per0.cls),
per2 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
                CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per1),
per AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                  ELSE 0.0 END AS f1 FROM per2),
tot AS (SELECT SUM(support) AS N, SUM(tp) AS TP, AVG(precision) AS mp, AVG(recall) AS mr, AVG(f1) AS mf,
               SUM(precision * support) AS wp, SUM(recall * support) AS wr, SUM(f1 * support) AS wf FROM per),
rep AS (SELECT cls AS "row", precision, recall, f1, support FROM per
        UNION ALL SELECT 'accuracy', TP / N, TP / N, TP / N, N FROM tot
        UNION ALL SELECT 'macro avg', mp, mr, mf, N FROM tot
        UNION ALL SELECT 'weighted avg', wp / N, wr / N, wf / N, N FROM tot)
SELECT "row", {heven('precision', 6)} AS precision, {heven('recall', 6)} AS recall, {heven('f1', 6)} AS f1,
       CAST(support AS BIGINT) AS support FROM rep"""


@register("classification_report", _REPORT, ("raw_a", "raw_b"))
def q_classification_report(spark, sf):
    from ..operators.reports import dominant_category, note_category_counts
    # everything follows from the (note, category, n) counts: no raw-row join
    counts = materialize(note_category_counts(C.mapped(raw_a(spark, sf), raw_b(spark, sf))), "note_counts")
    dom = dominant_category(None, counts).select("notes", "dominant_category")
    pr = counts.join(dom, "notes").select(F.col("category").alias("label"),
                                          F.col("dominant_category").alias("prediction"), "n")
    return classification_report(pr, weight="n")


# --- recurring expenses -------------------------------------------------------

@register("recurring_expenses", f"""
WITH d AS (SELECT user_id, category, COALESCE(notes, '') AS note, date, {msum('amount')} AS day_amount,
                  COUNT(*) AS n FROM subscriptions WHERE date IS NOT NULL GROUP BY 1, 2, 3, 4),
g0 AS (SELECT *, CAST(date_diff('day', lag(date) OVER (PARTITION BY user_id, category, note ORDER BY date), date)
                      AS INTEGER) AS gap FROM d),
g AS (SELECT user_id, category, note, CAST(SUM(n) AS BIGINT) AS occurrences, COUNT(*) AS n_dates,
             MIN(date) AS first_date, MAX(date) AS last_date, MIN(gap) AS min_gap, MAX(gap) AS max_gap,
             CAST(SUM(CAST(day_amount AS DECIMAL(28,6))) AS DOUBLE) / SUM(n) AS avg_amount
      FROM g0 GROUP BY 1, 2, 3)
SELECT * FROM g WHERE n_dates >= 3 AND min_gap >= 28 AND max_gap <= 31""", ("subscriptions",))
def q_recurring_expenses(spark, sf):
    return recurring_expenses(subscriptions(spark, sf))


def _patterns_sql() -> str:
    """SQL of ``recurring_patterns``: one branch for each period."""
    def frame(lo, hi):
        return (f"COUNT(*) OVER (PARTITION BY user_id, category, note ORDER BY day "
                f"RANGE BETWEEN {lo} FOLLOWING AND {hi} FOLLOWING) > 0")

    kinds, sums, scored = [], [], []
    for i, p in enumerate(PERIODS):
        lo, hi = p.lo - p.slack, p.hi + p.slack
        kinds.append(f"CASE WHEN day + {lo} > last THEN NULL WHEN {frame(p.lo, p.hi)} THEN 1 WHEN {frame(lo, hi)} THEN 2 "
                     f"WHEN {frame(2 * lo, 2 * hi)} THEN 3 ELSE 0 END AS k{i}")
        sums.append(", ".join(f"COUNT(CASE WHEN k{i} = {k} THEN 1 END) AS c{i}_{k}" for k in (1, 2, 3))
                    + f", COUNT(k{i}) AS due{i}")
        step = {"monthly": "INTERVAL 1 MONTH", "quarterly": "INTERVAL 3 MONTH",
                "yearly": "INTERVAL 12 MONTH"}.get(p.name, f"INTERVAL {p.days} DAY")
        chance = f"((n_dates - 1) * {hi - lo + 1} / date_diff('day', first_date, last_date)::DOUBLE)"
        credit = f"((c{i}_1 + c{i}_2 * {SHIFTED}::DOUBLE + c{i}_3 * {MISSED}::DOUBLE) / due{i})"
        scored.append(f"SELECT *, '{p.name}' AS period, {i} AS nth, due{i} AS n_due, c{i}_1 AS n_on_time, c{i}_2 AS n_shifted, "
                      f"c{i}_3 AS n_missed, ({credit} - {chance}) / (1 - {chance}) AS score, "
                      f"CAST(last_date + {step} AS DATE) AS next_date FROM g WHERE due{i} >= 2 AND {chance} < 1")
    return f"""
WITH d AS (SELECT user_id, category, COALESCE(notes, '') AS note, date, date_diff('day', DATE '1970-01-01', date) AS day,
                  {msum('amount')} AS day_amount, COUNT(*) AS n FROM subscriptions WHERE date IS NOT NULL GROUP BY 1, 2, 3, 4),
l AS (SELECT *, MAX(day) OVER (PARTITION BY user_id, category, note) AS last FROM d),
k AS (SELECT *, {', '.join(kinds)} FROM l),
g AS (SELECT user_id, category, note, CAST(SUM(n) AS BIGINT) AS occurrences, COUNT(*) AS n_dates, MIN(date) AS first_date,
             MAX(date) AS last_date, CAST(SUM(CAST(day_amount AS DECIMAL(28,6))) AS DOUBLE) / SUM(n) AS avg_amount,
             {', '.join(sums)} FROM k GROUP BY 1, 2, 3 HAVING COUNT(*) >= 3),
s AS ({' UNION ALL '.join(scored)}),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, category, note ORDER BY nth) AS rn FROM s WHERE score >= 0.6)
SELECT user_id, category, note, occurrences, n_dates, first_date, last_date, avg_amount, period, score, n_due, n_on_time,
       n_shifted, n_missed, next_date FROM r WHERE rn = 1"""


@register("recurring_patterns", _patterns_sql(), ("subscriptions",))
def q_recurring_patterns(spark, sf):
    return recurring_patterns(subscriptions(spark, sf))


# --- file sources and sinks (written under the shared checkpoint folder) ----

@register("csv_transactions", f"WITH {STAGES} SELECT * FROM u", ("raw_a", "raw_b"))
def q_csv_transactions(spark, sf):
    pa = IO.write_csv(raw_a(spark, sf), IO.scratch_path(spark, "raw_a"))
    pb = IO.write_csv(raw_b(spark, sf), IO.scratch_path(spark, "raw_b"))
    a = IO.read_transactions_csv(spark, pa, ["date", "category", "amount", "notes",
                                             "transaction_type", "payment_mode"])
    b = IO.read_transactions_csv(spark, pb, list(C.RENAME_B))
    return C.union_datasets(a, C.rename_columns(b))


_IMPORT = """p AS (SELECT user_id,
  CAST(COALESCE(try_strptime("Date", '%Y-%m-%d'), try_strptime("Date", '%m/%d/%Y'),
                try_strptime("Date", '%d/%m/%Y')) AS DATE) AS d_parsed,
  COALESCE("Category", 'nan') AS c_txt, TRY_CAST("Amount" AS DOUBLE) AS a_parsed,
  COALESCE("Payment_Mode", 'nan') AS p_txt, COALESCE("Notes", 'nan') AS n_txt FROM uploads),
t AS (SELECT *, CASE WHEN d_parsed IS NULL THEN 'bad_date' WHEN a_parsed IS NULL THEN 'bad_amount' END AS reason
      FROM p)"""


def _uploaded(spark, sf):
    """The uploads as CSV files, read back as text."""
    up = uploads(spark, sf)
    path = IO.write_csv(up, IO.scratch_path(spark, "uploads"))
    back = IO.read_transactions_csv(spark, path, up.columns)
    return back.withColumn("user_id", F.col("user_id").cast("long"))


@register("csv_import", f"""WITH {_IMPORT}
SELECT user_id, d_parsed AS date, c_txt AS category, a_parsed AS amount, p_txt AS payment_mode,
       n_txt AS notes FROM t WHERE reason IS NULL""", ("uploads",))
def q_csv_import(spark, sf):
    return IO.import_expenses(_uploaded(spark, sf), as_of="2024-02-01")[0]


@register("csv_reject_report", f"""WITH {_IMPORT}
SELECT user_id, reason, COUNT(*) AS n FROM t WHERE reason IS NOT NULL GROUP BY 1, 2""", ("uploads",))
def q_csv_reject_report(spark, sf):
    return IO.reject_report(IO.import_expenses(_uploaded(spark, sf), as_of="2024-02-01")[1])


@register("export_expenses_csv", "SELECT * FROM exp_daily", ("exp_daily",))
def q_export_expenses_csv(spark, sf):
    e = exp_daily(spark, sf)
    path = IO.export_expenses_csv(e, IO.scratch_path(spark, "export"))
    return IO.csv_reader(spark).schema(EXPENSES).csv(path).select(*e.columns)


@register("write_clean_csv", f"WITH {STAGES} SELECT * FROM final", ("raw_a", "raw_b"))
def q_write_clean_csv(spark, sf):
    df = C.clean_transactions(raw_a(spark, sf), raw_b(spark, sf))
    path = IO.write_table(df, IO.scratch_path(spark, "clean"))
    return spark.read.parquet(path)


@register("append_forecast_history", M2_SQL + """,
tot AS (SELECT user_id, SUM(yhat) AS s FROM fc GROUP BY 1)
SELECT user_id, DATE '2024-01-31' AS forecast_date, 'trailing_mean' AS model_used, CAST(30 AS INTEGER) AS forecast_period,
       """ + pyround("s") + """ AS total_predicted FROM tot, range(2) AS r(i)""", ("exp_daily",))
def q_append_forecast_history(spark, sf):
    totals = M.forecast_summary(m2(spark, sf)).select("user_id", "total_predicted")
    path = IO.scratch_path(spark, "forecast_history")
    for _ in range(2):  # two runs append two rows per user
        IO.append_forecast_history(totals, path, "2024-01-31", "trailing_mean", 30)
    return spark.read.schema(FORECAST_HISTORY).parquet(path)


@register("synthetic_expenses", synthetic_sql("2024-06-30"), ("users",))
def q_synthetic_expenses(spark, sf):
    return synthetic_expenses(users(spark, sf), as_of="2024-06-30")


@register("monthly_forecast_seed", """
WITH ms AS (SELECT date_trunc('month', date) AS ds,
  CAST(SUM(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) AS y FROM exp_monthly
  WHERE date IS NOT NULL AND amount > 0 AND amount <= 100000.0 GROUP BY 1),
l6 AS (SELECT CAST(ds AS DATE) AS ds, y FROM ms ORDER BY ds DESC LIMIT 6),
s AS (SELECT MAX(ds) AS last_ds, list(y ORDER BY ds) AS v FROM l6),
n AS (SELECT CAST(last_ds + INTERVAL 1 MONTH AS DATE) AS ds, v FROM s)
SELECT ds, CAST(month(ds) AS INTEGER) AS month_num, CAST(year(ds) AS INTEGER) AS year_num,
       CAST(quarter(ds) AS INTEGER) AS quarter, v[-1] AS lag_1, v[-2] AS lag_2, v[-3] AS lag_3,
       ((v[-3] + v[-2]) + v[-1]) / 3 AS rolling_3,
       (((((v[-6] + v[-5]) + v[-4]) + v[-3]) + v[-2]) + v[-1]) / 6 AS rolling_6
FROM n""", ("exp_monthly",))
def q_monthly_forecast_seed(spark, sf):
    """M5 seed: the first future month's features from the last six actual
    months (the part of the recursion that needs no model)."""
    state = T.series_state(monthly(spark, sf).withColumn("_g", F.lit(0)), ["_g"], 6)
    return T.monthly_step_features(state).select("ds", *T.MONTHLY_FEATURES)
