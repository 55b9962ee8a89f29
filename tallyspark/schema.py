"""Table schemas and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

EXPENSES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("amount", T.DoubleType(), False),
    T.StructField("payment_mode", T.StringType(), True),
    T.StructField("notes", T.StringType(), True),
])

FORECAST_HISTORY = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("forecast_date", T.DateType(), False),
    T.StructField("model_used", T.StringType(), False),
    T.StructField("forecast_period", T.IntegerType(), False),
    T.StructField("total_predicted", T.DoubleType(), True),
])

RAW_COLUMNS = ["date", "category", "amount", "notes", "transaction_type", "payment_mode"]

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the reference's for identical results.
# Kept as plain text, in the reference's natural order.
# ---------------------------------------------------------------------------

# Expense categories and payment modes of the application.
CATEGORIES = [
    "Food & Dining", "Transportation", "Shopping", "Entertainment",
    "Healthcare", "Utilities", "Rent/Housing", "Education",
    "Travel", "Personal Care", "Groceries", "Insurance",
    "Investments", "Subscriptions", "Gifts", "Other",
]
PAYMENT_MODES = ["Cash", "UPI", "Credit Card", "Debit Card", "EMI"]

# Pseudo-category holding a whole-month budget; wildcard meaning "no filter".
OVERALL = "Overall"
ALL = "All"

# Raw payment-mode spellings -> canonical mode (exact, case-sensitive match).
PAYMENT_MAP = {
    "cash": "Cash",
    "CASH": "Cash",
    "csh": "Cash",
    "Csh": "Cash",
    "upi": "UPI",
    "Upi": "UPI",
    "UPi": "UPI",
    "card": "Card",
    "CARD": "Card",
    "CRD": "Card",
    "Crd": "Card",
    "Credit Card": "Card",
    "Debit Card": "Card",
    "bank transfer": "Bank Transfer",
    "BankTransfer": "Bank Transfer",
    "Bank_Transfer": "Bank Transfer",
    "Bank Transfr": "Bank Transfer",
    "Saving Bank account 1": "Bank Account",
    "Saving Bank account 2": "Bank Account",
}
INVESTMENT_MODES = [
    "Equity Mutual Fund A",
    "Equity Mutual Fund B",
    "Equity Mutual Fund C",
    "Equity Mutual Fund D",
    "Share Market Trading",
    "Recurring Deposit",
    "Fixed Deposit",
]
INVESTMENT = "Investment"

# Lower-cased category typos -> canonical category.
CATEGORY_MAP = {
    "foods": "food",
    "foodd": "food",
    "fod": "food",
    "rentt": "rent",
    "rnt": "rent",
    "traval": "travel",
    "travl": "travel",
    "entertain": "entertainment",
    "entrtnmnt": "entertainment",
    "utlities": "utility",
    "utilties": "utility",
    "edu": "education",
    "educaton": "education",
    "helth": "health",
    "other": "others",
    "saving": "savings",
}

# Exact notes that force a category.
MANUAL_CATEGORY = {
    "Movie tickets": "entertainment",
    "Electricity bill": "utility",
    "Petrol": "transportation",
    "Coffee": "food",
    "Doctor consultation": "health",
    "Medicine": "health",
    "Monthly rent payment": "rent",
    "Internet bill": "utility",
    "Online course": "education",
    "Train ticket": "travel",
    "Uber ride": "travel",
    "Gym membership": "health",
    "Restaurant dinner": "food",
}

# Junk note values that are dropped.
INVALID_NOTES = ["!!!", "...", "unknown", "asdfgh", "test", "xyz123", "misc"]

# Rare categories merged into travel.
MERGED_CATEGORIES = {"transportation": "travel", "tourism": "travel"}

# Fill value for missing notes / category / payment mode.
MISSING = "unknown"

# Outlier rules of the cleaning notebook.
SENTINEL_AMOUNTS = [999999999.0, 999999.0]
AMOUNT_CAP = 100000.0

# Minimum category size kept for the second classifier.
MIN_CATEGORY_ROWS = 20

# Data points that a forecast needs: the service's limits and the page's; the
# page's trees also need one training row beyond lag 14 of the filled calendar.
MIN_HISTORY = {"seasonal": 10, "trees": 15}
PAGE_MIN_HISTORY = {"seasonal": 5, "trees": 10}
PAGE_TREE_DAYS = 15
BAND = 0.20
INTERVAL_Z80 = 1.2815515655446004  # two-sided 80 % normal interval

# Budget page thresholds (percent of limit) and alert share.
BAND_OK, BAND_WARN = 70.0, 90.0
ALERT_SHARE = 0.9

# Value-to-maximum ratio thresholds of the colour helper.
RATIO_OK, RATIO_WARN = 0.5, 0.8

# Default currency symbol of the amount labels.
CURRENCY = "₹"
