"""Lenient readers of single values; null in ``ok`` terms means a reject.

Each function takes the text of a JSON or TSV value and returns
``struct(value, ok)``: ``ok`` false means the record has to be rejected.
"""

from pyspark.sql import Column, functions as F

from flowguard import constants as K

NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
ZONED = r"(?i)(Z|[+-][0-9]{2}:?[0-9]{2}(:?[0-9]{2})?)$"
ISO = r"^[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T ][0-9]{2}(:?[0-9]{2}(:?[0-9]{2}([.,][0-9]+)?)?)?"


def parse_ts(text: Column, quoted: Column | None = None) -> Column:
    """Epoch seconds (number or numeric text) or zoned ISO text; null if neither."""
    numeric = text.rlike(NUMBER)
    seconds = F.when(numeric, F.trim(text)).try_cast("double")
    bounded = seconds.between(-62135596800.0, 253402300799.0)
    micros = F.when(bounded, F.rint(seconds * 1_000_000)).cast("long")
    iso = F.when(~numeric & text.rlike(ISO) & text.rlike(ZONED), text)
    iso = F.regexp_replace(F.regexp_replace(iso, "^(.{10}) ", "$1T"), ",", ".")
    return F.coalesce(F.timestamp_micros(micros), F.try_to_timestamp(iso))


def to_int(text: Column, is_text: Column, default: int | None = 0) -> Column:
    """Whole number. Null, '-' and '' give the default; fractions are rejects.

    ``is_text`` tells whether the value was a quoted text: a quoted '1.0' is no
    whole number while a bare 1.0 is.
    """
    absent = text.isNull() | text.isin("-", "")
    whole = text.rlike(r"^\s*[+-]?[0-9]+\s*$")
    bare = F.when(~is_text & ~whole & text.rlike(NUMBER), text).try_cast("double")
    value = F.coalesce(F.when(whole, F.trim(text)).try_cast("long"),
                       F.when((bare == F.floor(bare)) & (F.abs(bare) < 9.2e18), bare)
                       .cast("long"))
    return F.struct(F.when(absent, F.lit(default)).otherwise(value).cast("long").alias("value"),
                    (absent | value.isNotNull()).alias("ok"))


def to_float(text: Column, default: float = 0.0) -> Column:
    """Finite number. Null, '-' and '' give the default."""
    absent = text.isNull() | text.isin("-", "")
    value = F.when(text.rlike(NUMBER), F.trim(text)).try_cast("double")
    finite = F.abs(value) <= F.lit(1.7976931348623157e308)
    return F.struct(F.when(absent, F.lit(default)).otherwise(value).alias("value"),
                    (absent | F.coalesce(finite, F.lit(False))).alias("ok"))


def half_even(c: Column) -> Column:
    """Nearest whole number, ties to the even one."""
    return F.rint(c).cast("long")
