"""Cleaning-chain queries over the dirty raw sources (raw_a / raw_b)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.date_text import coerce_date_by_source
from ..operators import clean as C
from ..operators import reports as R
from ..schema import (CATEGORY_MAP, INVALID_NOTES, INVESTMENT, INVESTMENT_MODES, MANUAL_CATEGORY,
                      MERGED_CATEGORIES, PAYMENT_MAP)
from ..sources.tables import exp_monthly, raw_a, raw_all, raw_b, uploads
from .registry import register


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case_map(col: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in mapping.items())
    return f"CASE {col} {whens} ELSE {col} END"


_PAY = dict(PAYMENT_MAP)
_PAY.update({m: INVESTMENT for m in INVESTMENT_MODES})
_INVALID = ", ".join(_q(x) for x in INVALID_NOTES)
_CLEAN = ("trim(regexp_replace(regexp_replace(lower(notes), '[^a-zA-Z0-9\\s]', '', 'g'), "
          "'\\s+', ' ', 'g'))")
_DATE = "CAST(COALESCE(try_strptime(date, '%Y-%m-%d'), try_strptime(date, '%d/%m/%Y')) AS DATE)"

# stage CTEs of the chain, shared by several oracle queries
STAGES = f"""
u AS (SELECT date, category, amount, notes, transaction_type, payment_mode FROM raw_a
      UNION ALL
      SELECT "Date", "Category", "Amount", "Note", "Income/Expense", "Mode" FROM raw_b),
filled AS (SELECT date, COALESCE(category, 'unknown') AS category, amount,
                  COALESCE(notes, 'unknown') AS notes, transaction_type,
                  COALESCE(payment_mode, 'unknown') AS payment_mode FROM u),
loaded AS (SELECT date, lower(category) AS category, TRY_CAST(amount AS DOUBLE) AS amount, notes,
                  transaction_type, payment_mode FROM filled
           WHERE amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NOT NULL AND date IS NOT NULL),
mapped AS (SELECT date, {case_map('category', CATEGORY_MAP)} AS category, amount, notes,
                  transaction_type, {case_map('payment_mode', _PAY)} AS payment_mode FROM loaded),
nc AS (SELECT notes, category, COUNT(*) AS n FROM mapped GROUP BY 1, 2),
dom AS (SELECT notes, category AS dominant_category, n FROM (
          SELECT *, row_number() OVER (PARTITION BY notes ORDER BY n DESC, category ASC) AS rn FROM nc)
        WHERE rn = 1),
resolved AS (SELECT m.date, COALESCE(d.dominant_category, m.category) AS category, m.amount, m.notes,
                    m.transaction_type, m.payment_mode
             FROM mapped m LEFT JOIN dom d ON d.notes = m.notes),
overridden AS (SELECT date, {case_map('notes', MANUAL_CATEGORY).replace('ELSE notes', 'ELSE category')} AS category,
                      amount, notes, transaction_type, payment_mode FROM resolved),
valid AS (SELECT * FROM overridden WHERE notes IS NOT NULL AND notes NOT IN ({_INVALID})),
merged AS (SELECT date, {case_map('category', MERGED_CATEGORIES)} AS category, amount, notes,
                  transaction_type, payment_mode, {_CLEAN} AS clean_notes FROM valid),
dated AS (SELECT {_DATE} AS date, category, amount, notes, transaction_type, payment_mode, clean_notes
          FROM merged),
parts AS (SELECT *, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
                 CAST(day(date) AS INTEGER) AS day, dayname(date) AS weekday FROM dated),
final AS (SELECT * FROM parts WHERE amount > 0 AND amount <= 100000.0)
"""
RAW = ("raw_a", "raw_b")


def _chain(spark, sf):
    return raw_a(spark, sf), raw_b(spark, sf)


@register("rename_columns", """
SELECT date_s AS date, category_s AS category, amount_s AS amount, notes_s AS notes,
       type_s AS transaction_type, payment_s AS payment_mode FROM raw""", ("raw",))
def q_rename_columns(spark, sf):
    return C.rename_columns(raw_all(spark, sf))


@register("union_datasets", f"WITH {STAGES} SELECT * FROM u", RAW)
def q_union_datasets(spark, sf):
    a, b = _chain(spark, sf)
    return C.union_datasets(a, C.rename_columns(b))


@register("fill_missing", f"WITH {STAGES} SELECT * FROM filled", RAW)
def q_fill_missing(spark, sf):
    a, b = _chain(spark, sf)
    return C.fill_missing(C.union_datasets(a, C.rename_columns(b)))


@register("coerce_amount", f"""WITH {STAGES}
SELECT date, category, TRY_CAST(amount AS DOUBLE) AS amount, notes, transaction_type, payment_mode FROM u""",
          RAW)
def q_coerce_amount(spark, sf):
    a, b = _chain(spark, sf)
    return C.coerce_amount(C.union_datasets(a, C.rename_columns(b)))


@register("drop_missing", f"""WITH {STAGES}
SELECT * FROM (SELECT date, category, TRY_CAST(amount AS DOUBLE) AS amount, notes, transaction_type,
                      payment_mode FROM u) WHERE amount IS NOT NULL AND date IS NOT NULL""", RAW)
def q_drop_missing(spark, sf):
    a, b = _chain(spark, sf)
    return C.drop_missing(C.coerce_amount(C.union_datasets(a, C.rename_columns(b))),
                          ["amount", "date"])


@register("coerce_date", f"""WITH {STAGES}
SELECT {_DATE} AS date, category, amount, notes, transaction_type, payment_mode FROM u""", RAW)
def q_coerce_date(spark, sf):
    a, b = _chain(spark, sf)
    return C.coerce_date(C.union_datasets(a, C.rename_columns(b)))


def mixed_sources(spark, sf):
    """The uploads, each user's file in one of three date orders (but for the
    rows that were dirty already)."""
    iso = r"^(\d{4})-(\d{2})-(\d{2})$"
    d = F.col("Date")
    text = (F.when(F.col("user_id") % 3 == 1, F.regexp_replace(d, iso, "$2/$3/$1"))
            .when(F.col("user_id") % 3 == 2, F.regexp_replace(d, iso, "$3/$2/$1")).otherwise(d))
    return uploads(spark, sf).select("user_id", text.alias("date"), F.col("Amount").alias("amount"))


@register("coerce_date_by_source", r"""
WITH s AS (SELECT user_id, CASE user_id % 3
    WHEN 1 THEN regexp_replace("Date", '^(\d{4})-(\d{2})-(\d{2})$', '\2/\3/\1')
    WHEN 2 THEN regexp_replace("Date", '^(\d{4})-(\d{2})-(\d{2})$', '\3/\2/\1') ELSE "Date" END AS x, "Amount" AS amount FROM uploads),
v AS (SELECT user_id, COUNT(*) FILTER (WHERE regexp_matches(x, '^\d{4}-\d{1,2}-\d{1,2}$')) AS a,
             COUNT(*) FILTER (WHERE regexp_matches(x, '^(0?[1-9]|1[0-2])/\d{1,2}/\d{4}$')) AS b,
             COUNT(*) FILTER (WHERE regexp_matches(x, '^\d{1,2}/(0?[1-9]|1[0-2])/\d{4}$')) AS c FROM s GROUP BY 1)
SELECT user_id, CAST(CASE WHEN a >= b AND a >= c AND a > 0 THEN try_strptime(x, '%Y-%m-%d')
                     WHEN b >= c AND b > 0 THEN try_strptime(x, '%m/%d/%Y') WHEN c > 0 THEN try_strptime(x, '%d/%m/%Y') END AS DATE) AS date,
       amount FROM s JOIN v USING (user_id)""", ("uploads",))
def q_coerce_date_by_source(spark, sf):
    return coerce_date_by_source(mixed_sources(spark, sf), ["user_id"])


@register("normalise_payment_mode", f"""WITH {STAGES}
SELECT date, category, amount, notes, transaction_type, {case_map('payment_mode', _PAY)} AS payment_mode
FROM loaded""", RAW)
def q_normalise_payment_mode(spark, sf):
    return C.normalise_payment_mode(C.combine_sources(*_chain(spark, sf)))


@register("normalise_category", f"""WITH {STAGES}
SELECT date, {case_map('category', CATEGORY_MAP)} AS category, amount, notes, transaction_type,
       payment_mode FROM loaded""", RAW)
def q_normalise_category(spark, sf):
    return C.normalise_category(C.combine_sources(*_chain(spark, sf)))


@register("value_counts", f"""WITH {STAGES},
vc AS (SELECT 'category' AS "column", category AS value, COUNT(*) AS n FROM filled GROUP BY 2
       UNION ALL SELECT 'transaction_type', transaction_type, COUNT(*) FROM filled GROUP BY 2
       UNION ALL SELECT 'payment_mode', payment_mode, COUNT(*) FROM filled GROUP BY 2
       UNION ALL SELECT 'notes', notes, COUNT(*) FROM filled GROUP BY 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC NULLS LAST) AS INTEGER) AS rank
               FROM vc) WHERE rank <= 20""", RAW)
def q_value_counts(spark, sf):
    a, b = _chain(spark, sf)
    f = C.fill_missing(C.union_datasets(a, C.rename_columns(b)))
    return R.value_counts(f, ["category", "transaction_type", "payment_mode", "notes"], top=20)


@register("note_category_counts", f"WITH {STAGES} SELECT * FROM nc", RAW)
def q_note_category_counts(spark, sf):
    return R.note_category_counts(C.mapped(*_chain(spark, sf)))


@register("note_conflicts", f"""WITH {STAGES}
SELECT notes, COUNT(DISTINCT category) AS n_categories FROM mapped GROUP BY 1
HAVING COUNT(DISTINCT category) > 1""", RAW)
def q_note_conflicts(spark, sf):
    return R.note_conflicts(C.mapped(*_chain(spark, sf)))


@register("dominant_category", f"WITH {STAGES} SELECT * FROM dom", RAW)
def q_dominant_category(spark, sf):
    return R.dominant_category(C.mapped(*_chain(spark, sf)))


@register("resolve_note_category", f"WITH {STAGES} SELECT * FROM resolved", RAW)
def q_resolve_note_category(spark, sf):
    return C.resolve_note_category(C.mapped(*_chain(spark, sf)))


@register("manual_category_override", f"WITH {STAGES} SELECT * FROM overridden", RAW)
def q_manual_category_override(spark, sf):
    return C.manual_category_override(C.resolve_note_category(C.mapped(*_chain(spark, sf))))


@register("drop_invalid_notes", f"WITH {STAGES} SELECT * FROM valid", RAW)
def q_drop_invalid_notes(spark, sf):
    return C.drop_invalid_notes(C.manual_category_override(
        C.resolve_note_category(C.mapped(*_chain(spark, sf)))))


@register("clean_text", f"""WITH {STAGES}
SELECT notes, {_CLEAN} AS clean_notes FROM valid""", RAW)
def q_clean_text(spark, sf):
    df = C.drop_invalid_notes(C.manual_category_override(
        C.resolve_note_category(C.mapped(*_chain(spark, sf)))))
    return C.add_clean_notes(df).select("notes", "clean_notes")


@register("merge_rare_categories", f"WITH {STAGES} SELECT * FROM merged", RAW)
def q_merge_rare_categories(spark, sf):
    df = C.drop_invalid_notes(C.manual_category_override(
        C.resolve_note_category(C.mapped(*_chain(spark, sf)))))
    return C.merge_rare_categories(C.add_clean_notes(df))


@register("date_parts", f"WITH {STAGES} SELECT * FROM parts", RAW)
def q_date_parts(spark, sf):
    df = C.drop_invalid_notes(C.manual_category_override(
        C.resolve_note_category(C.mapped(*_chain(spark, sf)))))
    return C.date_parts(C.coerce_date(C.merge_rare_categories(C.add_clean_notes(df))))


@register("clean_transactions", f"WITH {STAGES} SELECT * FROM final", RAW)
def q_clean_transactions(spark, sf):
    return C.clean_transactions(*_chain(spark, sf))


@register("distinct_note_category", f"WITH {STAGES} SELECT DISTINCT clean_notes, category FROM final", RAW)
def q_distinct_note_category(spark, sf):
    return C.distinct_note_category(C.clean_transactions(*_chain(spark, sf)))


@register("outlier_audit", f"""WITH {STAGES}
SELECT CAST(count_if(amount = 999999999.0) AS BIGINT) AS n_sentinel_999999999, CAST(count_if(amount = 999999.0) AS BIGINT) AS n_sentinel_999999,
       CAST(count_if(amount < 0) AS BIGINT) AS n_negative, CAST(count_if(amount > 100000.0) AS BIGINT) AS n_over_cap,
       CAST(count_if(amount = 0) AS BIGINT) AS n_zero, COUNT(*) AS n_rows FROM loaded""", RAW)
def q_outlier_audit(spark, sf):
    return C.outlier_audit(C.combine_sources(*_chain(spark, sf)))


@register("drop_amount_outliers", """
SELECT * FROM exp_monthly WHERE amount > 0 AND amount <= 100000.0""", ("exp_monthly",))
def q_drop_amount_outliers(spark, sf):
    return C.drop_amount_outliers(exp_monthly(spark, sf))

