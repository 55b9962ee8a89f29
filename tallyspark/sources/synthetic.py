"""Demo expense generator (S9), reproducible from hashes.

For every user and each of ``days`` days ending at ``as_of``: 1-5 draws of
a category; rent only on the 1st of a month (other days the draw is
dropped), amounts uniform in the category's range, rounded to 2 decimals.
Uniforms come from the md5 of (user, day, draw, purpose) so the rows
do not depend on partitioning or retries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import half_even
from ..schema import CATEGORIES, PAYMENT_MODES

RENT = "Rent/Housing"
# amount ranges by category (fixed values)
RANGES = {
    "Rent/Housing": (8000.0, 25000.0),
    "Utilities": (500.0, 3000.0),
    "Insurance": (500.0, 3000.0),
    "Food & Dining": (100.0, 2000.0),
    "Groceries": (100.0, 2000.0),
}
DEFAULT_RANGE = (200.0, 5000.0)


def _h(*parts) -> F.Column:
    """Uniform integer in [0, 2^28) from an md5 of the parts (any engine can
    compute the same)."""
    text = F.concat_ws("-", *[p.cast("string") if isinstance(p, F.Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def synthetic_expenses(users: DataFrame, as_of: str, days: int = 180, seed: int = 42) -> DataFrame:
    # a user makes hundreds of rows: the few bytes of the users are dealt to
    # all tasks, not by the size of their file
    parts = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    u = users.select(F.col("id").alias("user_id")).repartition(parts)
    start = F.date_sub(F.lit(as_of).cast("date"), days)
    d = u.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("i"))
    # the text of (user, day) is made once for all hashes of the day
    d = d.select("user_id", F.date_add(start, F.col("i")).alias("date"), "i",
                 F.concat_ws("-", F.col("user_id").cast("string"), F.col("i").cast("string")).alias("at"))
    at = F.col("at")
    cats = F.array(*[F.lit(c) for c in CATEGORIES])
    modes = F.array(*[F.lit(m) for m in PAYMENT_MODES])
    n = (F.pmod(_h(at, seed, "n"), F.lit(5)) + 1).cast("int")

    def draw(k: F.Column) -> F.Column:
        # hashed where it is drawn: the filter below would hash the category again
        return F.struct(k.alias("k"), (F.pmod(_h(at, k, seed, "c"), F.lit(len(CATEGORIES))) + 1).cast("int").alias("c"))

    d = d.select("user_id", "date", "i", "at", F.inline(F.transform(F.sequence(F.lit(1), n), draw)))
    d = d.withColumn("category", F.element_at(cats, F.col("c"))).filter((F.col("category") != RENT) | (F.dayofmonth("date") == 1))
    lo = F.lit(DEFAULT_RANGE[0])
    hi = F.lit(DEFAULT_RANGE[1])
    for c, (a, b) in RANGES.items():
        lo = F.when(F.col("category") == c, F.lit(a)).otherwise(lo)
        hi = F.when(F.col("category") == c, F.lit(b)).otherwise(hi)
    u01 = _h(at, F.col("k"), seed, "a").cast("double") / float(1 << 28)
    amount = half_even(lo + (hi - lo) * u01, 2)
    mode = F.element_at(modes, (F.pmod(_h(at, F.col("k"), seed, "p"), F.lit(len(PAYMENT_MODES))) + 1).cast("int"))
    return d.select(
        (F.col("user_id") * 1000000 + F.col("i") * 10 + F.col("k")).alias("id"), "user_id", "date",
        "category", amount.alias("amount"), mode.alias("payment_mode"),
        F.concat(F.lit("Sample "), F.col("category"), F.lit(" expense")).alias("notes"))


def synthetic_sql(as_of: str, days: int = 180, seed: int = 42) -> str:
    """The same rows as DuckDB SQL over the view ``users``."""
    def h(*parts: str) -> str:
        text = " || '-' || ".join(f"CAST({p} AS VARCHAR)" if p in ("user_id", "i", "k") else f"'{p}'" for p in parts)
        return f"CAST('0x' || substr(md5({text}), 1, 7) AS BIGINT)"

    def pick(values: list[str], *parts: str) -> str:
        items = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
        return f"list_extract([{items}], {h(*parts)} % {len(values)} + 1)"

    def bound(k: int) -> str:
        whens = " ".join(f"WHEN '{c}' THEN {r[k]}::DOUBLE" for c, r in RANGES.items())
        return f"CASE category {whens} ELSE {DEFAULT_RANGE[k]}::DOUBLE END"

    s = str(seed)
    u01 = f"CAST({h('user_id', 'i', 'k', s, 'a')} AS DOUBLE) / {float(1 << 28)}::DOUBLE"
    return f"""
WITH d AS (SELECT u.id AS user_id, r.i, CAST(DATE '{as_of}' - {days} + CAST(r.i AS INTEGER) AS DATE) AS date
           FROM users u CROSS JOIN range({days}) AS r(i)),
n AS (SELECT *, {h('user_id', 'i', s, 'n')} % 5 + 1 AS n FROM d),
k AS (SELECT user_id, i, date, unnest(range(1, n + 1)) AS k FROM n),
c AS (SELECT *, {pick(CATEGORIES, 'user_id', 'i', 'k', s, 'c')} AS category FROM k),
a AS (SELECT *, {bound(0)} AS lo, {bound(1)} AS hi, {u01} AS u FROM c)
SELECT user_id * 1000000 + i * 10 + k AS id, user_id, date, category,
       round_even((lo + (hi - lo) * u) * 100.0, 0) / 100.0 AS amount,
       {pick(PAYMENT_MODES, 'user_id', 'i', 'k', s, 'p')} AS payment_mode,
       'Sample ' || category || ' expense' AS notes
FROM a WHERE category <> '{RENT}' OR day(date) = 1"""
