"""Column expressions used by several operators. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from colsmith.functions import constants as K

ARITHMETIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def is_number(type_name: str) -> bool:
    return type_name in ARITHMETIC or type_name.startswith("decimal")


def as_double(c: Column, type_name: str) -> Column:
    """Numbers and booleans as double."""
    return c.cast("int").cast("double") if type_name == "boolean" else c.cast("double")


def is_text_type(type_name: str) -> bool:
    return type_name == "string" or type_name.startswith(("varchar", "char"))


def is_time_type(type_name: str) -> bool:
    return type_name in ("timestamp", "timestamp_ntz", "date")


# Parts of patterns that a backtracking matcher tries again at every length, and equivalents that it tries once. The possessive forms
# give nothing back, which is the same where what follows cannot match what they hold.
_ONCE = (
    (r"\d+[,\d]*\.?\d*", r"\d[,\d]*+\.?\d*+"), (r"[\d,]+\.?\d*", r"[\d,]++\.?\d*+"), (r"\d+\.?\d*", r"\d++\.?\d*+"),
    (r"\d+\.\d+", r"(?<!\d)\d++\.\d"), (r"[a-zA-Z0-9._%+-]+@", r"(?<![a-zA-Z0-9._%+-])[a-zA-Z0-9._%+-]++@"), (r"(?:,\d{3})*", r"(?:,\d{3})*+"),
)


def once(pattern: str) -> str:
    """A pattern that finds the same values in time linear in their length; a search starts a run of digits or mail characters at its first only."""
    for part, equal in _ONCE:
        if part in pattern:
            return pattern.replace(part, equal)
    return pattern


def has_pattern(c: Column, pattern: str) -> Column:
    """True when the pattern is found anywhere."""
    return c.rlike(once(pattern))


def starts_with_pattern(c: Column, pattern: str) -> Column:
    """True when the pattern matches from the first character."""
    return c.rlike(f"^(?:{once(pattern)})")


def share(condition: Column) -> Column:
    """Share of the non-null evaluations that are true."""
    return F.avg(condition.cast("int"))


def clean_number(c: Column) -> Column:
    """Number inside text such as ``$1,234.50`` or ``45%``; null when there is none."""
    return F.regexp_replace(c.cast("string"), r"[%$€£¥₹,\s]", "").try_cast("double")


def clean_currency(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), K.CURRENCY_NOISE, "").try_cast("double")


def percent_to_fraction(c: Column) -> Column:
    return F.trim(F.regexp_replace(c.cast("string"), "%", "")).try_cast("double") / 100


def to_flag(c: Column) -> Column:
    """1 for yes-words, 0 for no-words, otherwise null."""
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(*K.TRUE_WORDS), 1.0).when(word.isin(*K.FALSE_WORDS), 0.0)


def to_time(c: Column) -> Column:
    """First of the known formats that parses; null when none does."""
    text = F.trim(c.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in K.DATETIME_FORMATS])


def json_text(c: Column) -> Column:
    """Compact text of a JSON object, plain text of a scalar; text that is no JSON stays."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(c), "$", "string"), c)


def is_json(c: Column) -> Column:
    """Whether the text is JSON; only what starts like JSON is parsed, as a failed parse costs far more than a look."""
    return F.when(c.rlike(r'^[ \t\r\n]*+[\[{"0-9tfn-]'), F.try_parse_json(c)).isNotNull()


def strip_punctuation(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c.cast("string"), r"[^\w\s]", ""), r"\s+", " "))


def squeeze_text(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(c.cast("string"))), r"\s+", " ")


def phone_digits(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"[^\d+]", "")


def valid_email(c: Column) -> Column:
    text = F.trim(F.lower(c.cast("string")))
    return F.when(text.rlike(K.EMAIL), text)


def url_location(c: Column) -> Column:
    """Host (with port and user) of a URL, or the text itself when it has none."""
    host = F.regexp_extract(c, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.when(host != "", host).otherwise(c)


def hash_bucket(c: Column, buckets: int) -> Column:
    """Bucket from the leading 32 bits of md5; nulls go to bucket 0."""
    head = F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.coalesce(head % buckets, F.lit(0).cast("bigint"))


def sample_skewness(population: Column, n: Column) -> Column:
    """Bias-adjusted skewness from the population value; null below three values."""
    n = n.cast("double")
    return F.when(n >= 3, F.coalesce(population, F.lit(0.0)) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(population: Column, n: Column) -> Column:
    """Bias-adjusted excess kurtosis; null below four values.

    A constant column has no population value and counts as 0.
    """
    n = n.cast("double")
    adjusted = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * population + 6)
    return F.when(n >= 4, F.coalesce(adjusted, F.lit(0.0)))


def stable_bucket(key: Column, buckets: int) -> Column:
    """A bucket from 0 that depends on the text of the key alone (first 32 bits of its MD5)."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % buckets


def safe_ratio(top: Column, bottom: Column, default: float = 0.0) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(default))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def first_match(cases: list[tuple[Column, object]], default=None) -> Column:
    """Ordered ``when`` chain from (condition, value) pairs."""
    def value(v):
        return v if isinstance(v, Column) else F.lit(v)

    chain = F.when(cases[0][0], value(cases[0][1]))
    for condition, result in cases[1:]:
        chain = chain.when(condition, value(result))
    return chain.otherwise(value(default))
