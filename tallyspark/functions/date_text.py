"""Dates from free text: the text's shape names its order, one cast parses it.

A text is stripped of a weekday and a time of day, its month's name becomes a
number, and the first shape that it has writes it as year-month-day.  Every
step is a regular expression in the JVM; a failed parse is tried once, not
once for every accepted format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linalg import let

_ZONE = r"(?:\s*(?:z|utc|gmt|[+-]\d{2}:?\d{2}))?"
_CLOCK = r"(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?"
#: a valid time of day at the end (an invalid one stays, and the text has no shape)
_TIME = (rf"(?:(?<=\d)t\s*|[ ,]\s*)(?:{_CLOCK}|(?:0?\d|1[0-2])(?::[0-5]\d(?::[0-5]\d(?:\.\d+)?)?)?\s*[ap]m){_ZONE}$"
         rf"|(?<=\d)t(?:[01]\d|2[0-3])(?:[0-5]\d(?:[0-5]\d)?)?{_ZONE}$")
_WEEKDAY = r"^(?:mon(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:r(?:s(?:day)?)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)[.,]?\s+"
_MONTH = (r"(?<![a-z])(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
          r"|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?![a-z])")
_NAMES = "janfebmaraprmayjunjulaugsepoctnovdec"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
#: (shape, year-month-day); # is a month's name.  Numeric dates are month
#: first, day first where the first number is no month.
SHAPES = [
    (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$", "$1-$3-$4"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    (r"^(0?[1-9]|1[0-2])([-/.])(\d{1,2})\2(\d{4}|\d{2})$", "$4-$1-$3"),
    (r"^(1[3-9]|2\d|3[01])([-/.])(\d{1,2})\2(\d{4}|\d{2})$", "$4-$3-$1"),
    (rf"^{_DAY}[-/ .,]*#\.?[-/ ,.]*(\d{{4}}|\d{{2}})$", "$2-#-$1"),
    (rf"^#\.?[-/ ]*{_DAY}[-/, ]+(\d{{4}}|\d{{2}})$", "$2-#-$1"),
    (rf"^(\d{{4}})[-/ ,]*#\.?[-/ ]*{_DAY}$", "$1-#-$2"),
    (r"^#\.?[-/ ,]*(\d{4})$", "$1-#-1"),
    (r"^(\d{4})[-/](\d{1,2})$", "$1-$2-1"),
    (r"^(\d{1,2})/(\d{4})$", "$2-$1-1"),
    (r"^(\d{4})$", "$1-1-1"),
]


def parse_date(col: Column, as_of_year: int = 2024) -> Column:
    """Date of a text in any accepted form, else NULL; a time of day, a zone
    and a weekday are passed over.  Two-digit years fall within 50 years of
    ``as_of_year``; years before 1900 or after 2200 (mistyped) don't count.

    Plain ISO dates are cast at once; steps of the others are bound to lambda
    variables, so each regular expression runs once on a text."""
    bare = F.regexp_replace(F.lower(F.trim(col)), _TIME, "")
    day = F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}$"), col.try_cast("date")).otherwise(let(bare, lambda text: _parsed(text, as_of_year)))
    return let(day, lambda d: F.when(F.year(d).between(1900, 2200), d))


def _parsed(text: Column, as_of_year: int) -> Column:
    """The date of a lower-case text without a time of day."""
    def worded(words: Column) -> Column:
        name = F.regexp_extract(words, _MONTH, 0)
        month = F.floor((F.instr(F.lit(_NAMES), F.substring(name, 1, 3)) + 2) / 3)
        return F.replace(let(F.regexp_replace(words, _MONTH, "#"), lambda t: _shaped(t, [s for s in SHAPES if "#" in s[0]])),
                         F.lit("#"), month.cast("string"))

    plain = _shaped(text, [s for s in SHAPES if "#" not in s[0]])
    shaped = F.when(text.rlike("[a-z]"), let(F.regexp_replace(text, _WEEKDAY, ""), lambda w: F.when(w.rlike("[a-z]"), worded(w)).otherwise(
        _shaped(w, [s for s in SHAPES if "#" not in s[0]])))).otherwise(plain)

    def cast(parts: Column) -> Column:
        short = F.get(parts, 0)
        year = F.when(F.length(short) == 2, _century(short.try_cast("int"), as_of_year)).otherwise(short.try_cast("int"))
        return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.get(parts, 1), F.get(parts, 2)).try_cast("date")

    return let(F.split(shaped, "-"), cast)


def _shaped(text: Column, shapes: list[tuple[str, str]]) -> Column:
    """``text`` rewritten by the first shape that it has, else NULL."""
    out = None
    for shape, order in shapes:
        new = F.regexp_replace(text, shape, order)
        out = F.when(text.rlike(shape), new) if out is None else out.when(text.rlike(shape), new)
    return out


def _century(yy: Column, as_of_year: int) -> Column:
    y = yy + as_of_year // 100 * 100
    return F.when(y >= as_of_year + 50, y - 100).when(y < as_of_year - 50, y + 100).otherwise(y)


# -- one format for a source ------------------------------------------------

#: (name, whole shape, year-month-day) of the formats that a source may have
SOURCE_FORMATS = [
    ("yyyy-MM-dd", r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "$1-$2-$3"),
    ("MM/dd/yyyy", r"^(0?[1-9]|1[0-2])/(\d{1,2})/(\d{4})$", "$3-$1-$2"),
    ("dd/MM/yyyy", r"^(\d{1,2})/(0?[1-9]|1[0-2])/(\d{4})$", "$3-$2-$1"),
    ("yyyyMMdd", r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    ("MM-dd-yyyy", r"^(0?[1-9]|1[0-2])-(\d{1,2})-(\d{4})$", "$3-$1-$2"),
    ("dd-MM-yyyy", r"^(\d{1,2})-(0?[1-9]|1[0-2])-(\d{4})$", "$3-$2-$1"),
    ("dd.MM.yyyy", r"^(\d{1,2})\.(0?[1-9]|1[0-2])\.(\d{4})$", "$3-$2-$1"),
]


def source_formats(df: DataFrame, source: list[str], col: str = "date") -> DataFrame:
    """(source..., format): the format that most of a source's texts have
    (ties: the first listed), null if none has any.  One aggregation with a
    count for each format, made map-side, so a source with very many rows is
    a row for each task."""
    text = F.trim(F.col(col))
    counts = df.groupBy(*source).agg(*[F.count_if(text.rlike(shape)).alias(f"_{i}") for i, (_, shape, _) in enumerate(SOURCE_FORMATS)])
    votes = F.array(*[F.struct(F.col(f"_{i}").alias("n"), F.lit(-i).alias("first"), F.lit(name).alias("format"))
                      for i, (name, _, _) in enumerate(SOURCE_FORMATS)])
    top = F.array_max(votes)
    return counts.select(*source, F.when(top["n"] > 0, top["format"]).alias("format"))


def coerce_date_by_source(df: DataFrame, source: list[str], col: str = "date") -> DataFrame:
    """C3 as the reference's library does it: a source has one format, and
    texts of another are NULL.  The format is voted over the whole source
    instead of read off its first row, which has no meaning in a distributed
    table.  The second pass parses each text once, in its source's format."""
    voted = df.join(source_formats(df, source, col).select(*[F.col(s).alias(f"_s_{s}") for s in source], F.col("format").alias("_format")),
                    _all([F.col(s).eqNullSafe(F.col(f"_s_{s}")) for s in source]), "left")
    text, shaped = F.trim(F.col(col)), None
    for name, shape, order in SOURCE_FORMATS:
        hit = (F.col("_format") == name) & text.rlike(shape)
        out = F.regexp_replace(text, shape, order)
        shaped = F.when(hit, out) if shaped is None else shaped.when(hit, out)
    return voted.withColumn(col, shaped.try_cast("date")).select(*df.columns)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
