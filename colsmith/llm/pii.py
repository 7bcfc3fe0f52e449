"""Format-preserving pseudonyms for personal data, in SQL functions only.

E-mail addresses, IPv4 addresses, payment cards, national numbers (ddd-dd-dddd), phone numbers and dates are
found by one pattern, validated (Luhn sum, octets, calendar), and replaced by a keyed permutation within their own format:

* digits and letters of a value go through a Feistel network whose two halves are the even and the odd
  places; each round adds a keyed SHA-256 number of the other half to each place, modulo 10 or 26. Separators, country codes, the first card digit
  and e-mail domains stay; the card's check digit is computed anew.
* the four octets of an address are places modulo 256;
* a date's day within its 400-year cycle is a pair of numbers below 27 and 5411, so it stays a date of the calendar.

The permutation depends on the key, the kind and the format alone, so equal values get equal pseudonyms in all documents, and
different values of one format get different ones. ``reveal=True`` runs the rounds backwards. Values that fail validation stay.
An e-mail domain has up to 128 labels; of a longer one the first labels are read, which changes nothing, as domains stay. Dates with slashes have the day first: one that is a date only with
the month first stays as it is. Patterns repeat groups a bounded number of times only, so texts of any length need a bounded stack.
A phone number has 15 digits at most and ends where another format begins. After +1 it has ten more digits; the length of other countries' numbers
isn't known here, so a plain number of two digits or more behind one is read as its last group as long as both have 15 digits at most.
Null texts stay null, empty ones empty. Rows are independent and all other columns pass through; existing columns ``pii_counts`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
CYCLE_DAYS = 146_097  # days of 400 years, 27 * 5411
KINDS = ("email", "ip", "date", "card", "national", "phone")

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,126}\.[A-Za-z]{2,}"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
DATE = r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"
NATIONAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
DASHED = r"[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
OTHER = "|".join((EMAIL, IP, DATE, CARD + "(?![ -][0-9]{4}(?![0-9]))", NATIONAL, DASHED + "(?![0-9A-Za-z])"))  # of five groups of four, the last four are a card


def _international() -> str:
    """Numbers with a country code: complete shapes first, then any groups of two digits or more, 7 to 15 digits in all.

    From the seventh digit on, a group is not taken where another format begins. Only shapes and country codes decide,
    which pseudonyms keep, so a pseudonym is matched like its value.
    """
    whole = (r"\+(?:1(?:[ .-]?\([0-9]{3}\)[ .-]?|[ .-][0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}|[0-9]{1,3}[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[.-][0-9]{4}"
             r"|[0-9]{11,15})(?![.-][0-9])")
    digit, late = r"(?:[ .-](?=[0-9]{2}))?[0-9]", rf"(?:[ .-](?!{OTHER})(?=[0-9]{{2}}))?[0-9]"
    shapes = [whole, rf"\+[0-9](?:{digit}){{6}}(?:{late}){{0,8}}"]
    for n in range(2, 8):  # digits of country and area code together
        heads = "|".join(rf"[0-9]{{{n - a}}}[ .-]?\([0-9]{{{a}}}\)" for a in range(1, 5) if 1 <= n - a <= 3)
        least = max(7 - n, 4)
        shapes.append(rf"\+(?:{heads})[ .-]?(?=[0-9]{{2}})[0-9](?:{digit}){{{least - 1}}}(?:{late}){{0,{15 - n - least}}}")
    return "|".join(shapes)


PHONE = rf"(?<![0-9A-Za-z])(?:{_international()}|\([0-9]{{3}}\)[ .-]?[0-9]{{3}}[ .-][0-9]{{4}}|{DASHED})(?![0-9A-Za-z])"
PATTERN = "|".join((EMAIL, IP, DATE, CARD, NATIONAL, PHONE))


def feistel(values: Column, radix: Column, key: Column, tweak: Column, reveal: bool = False) -> Column:
    """Permute an array of numbers, each below its radix; a radix of 1 fixes a place."""

    def one_round(state: Column, k: Column) -> Column:
        odd = k % 2
        others = F.array_join(F.transform(state, lambda v, j: F.when(j % 2 == odd, F.lit("")).otherwise(v.cast("string"))), ",")
        seed = F.concat_ws("|", key, tweak, k.cast("string"), others)

        def place(v, j):
            size = F.element_at(radix, j + 1)
            number = F.conv(F.substring(F.sha2(F.concat_ws("|", seed, j.cast("string")), 256), 1, 12), 16, 10).cast("long")
            return F.when(j % 2 == odd, F.pmod((v - number) if reveal else (v + number), size)).otherwise(v)

        return F.transform(state, place)

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if reveal else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, values, one_round)


def _characters(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def permute_text(text: Column, key: Column, tweak: Column, reveal: bool = False) -> Column:
    """Digits become digits, and letters letters of their case; all other characters stay."""
    points = F.transform(_characters(text), lambda c: F.ascii(c).cast("long"))
    base = F.transform(points, lambda p: F.when(p.between(48, 57), 48).when(p.between(65, 90), 65).when(p.between(97, 122), 97).otherwise(p).cast("long"))
    radix = F.transform(points, lambda p: F.when(p.between(48, 57), 10).when(p.between(65, 90) | p.between(97, 122), 26).otherwise(1).cast("long"))
    moved = feistel(F.zip_with(points, base, lambda p, b: p - b), radix, key, tweak, reveal)
    return F.array_join(F.zip_with(moved, base, lambda v, b: F.char(v + b)), "")


def _digits(text: Column) -> Column:
    return F.transform(_characters(F.regexp_replace(text, "[^0-9]", "")), lambda c: c.cast("int"))


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum with every second digit doubled, counted from the right; ``doubled`` is the place of the first doubled one."""
    parts = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 != doubled, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(parts, F.lit(0), lambda a, d: a + d)


def _card(value: Column, key: Column, reveal: bool) -> Column:
    middle = permute_text(F.substring(value, F.lit(2), F.length(value) - 2), key, F.concat(F.lit("card"), F.substring(value, 1, 1)), reveal)
    body = F.concat(F.substring(value, 1, 1), middle)
    check = F.pmod(10 - luhn_sum(_digits(body), 0) % 10, F.lit(10))
    return F.concat(body, check.cast("string"))


def _ip(value: Column, key: Column, reveal: bool) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("long"))
    return F.array_join(F.transform(feistel(octets, F.transform(octets, lambda o: F.lit(256).cast("long")), key, F.lit("ip"), reveal), lambda o: o.cast("string")), ".")


def _to_date(value: Column) -> Column:
    iso = F.when(value.contains("/"), F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2))).otherwise(value)
    return F.when(F.substring(iso, 1, 4) >= "0001", F.try_to_date(iso, "yyyy-MM-dd"))


def _date(value: Column, key: Column, reveal: bool) -> Column:
    start = F.lit("0001-01-01").cast("date")
    day = F.datediff(_to_date(value), start).cast("long")
    cycle, rest = F.floor(day / CYCLE_DAYS), F.pmod(day, F.lit(CYCLE_DAYS))
    moved = feistel(F.array(F.floor(rest / 5411), rest % 5411), F.array(F.lit(27).cast("long"), F.lit(5411).cast("long")), key, F.concat(F.lit("date"), cycle.cast("string")), reveal)
    new = F.date_add(start, (cycle * CYCLE_DAYS + F.element_at(moved, 1) * 5411 + F.element_at(moved, 2)).cast("int"))
    return F.when(value.contains("/"), F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "yyyy-MM-dd"))


def kind_of(value: Column) -> Column:
    """The kind of a match of PATTERN, null when it is not valid."""
    whole = lambda p: value.rlike("^(?:" + p + ")$")
    octets = F.forall(F.split(value, r"\."), lambda o: o.cast("int") <= 255)
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return (F.when(value.contains("@"), "email")
            .when(whole(IP), F.when(octets, "ip"))
            .when(whole(DATE), F.when(_to_date(value).isNotNull(), "date"))
            .when(whole(CARD), F.when(luhn_sum(_digits(value), 1) % 10 == 0, "card"))
            .when(whole(NATIONAL), "national")
            .when(digits.between(7, 15), "phone"))


def pseudonym(value: Column, kind: Column, key: Column, reveal: bool = False) -> Column:
    """The value permuted within its format; unchanged for a null kind."""
    code = F.regexp_extract(value, r"^(\+[0-9]{1,3}(?=[^0-9])|)", 1)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    name = F.substring_index(value, "@", 1)
    return (F.when(kind == "email", F.concat(permute_text(name, key, F.lit("email"), reveal), F.substring(value, F.length(name) + 1, F.length(value))))
            .when(kind == "ip", _ip(value, key, reveal))
            .when(kind == "date", _date(value, key, reveal))
            .when(kind == "card", _card(value, key, reveal))
            .when(kind == "national", permute_text(value, key, F.lit("national"), reveal))
            .when(kind == "phone", F.concat(code, permute_text(rest, key, F.concat(F.lit("phone"), code), reveal)))
            .otherwise(value))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", reveal: bool = False) -> DataFrame:
    """The rows with personal data of the text replaced, and ``pii_counts``, how many values of each kind were.

    Texts without @ or a digit are not searched.
    """
    some = F.col(text).rlike("[@0-9]")
    rows = docs.drop("pii_counts").select("*", F.when(some, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("_pii"))
    rows = rows.withColumn("_pii", F.when(F.size("_pii") > 0, F.transform("_pii", lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind")))))
    new = F.transform("_pii", lambda m: pseudonym(m["value"], m["kind"], F.lit(key), reveal))
    pieces = F.split(text, PATTERN, -1)
    joined = F.array_join(F.zip_with(pieces, new, lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    found = F.coalesce("_pii", F.array().cast("array<struct<value:string,kind:string>>"))

    def count(kind):
        return F.size(F.filter(found, lambda m: m["kind"] == kind)).cast("long").alias(kind)

    counts = F.struct(*[count(k) for k in KINDS])
    return rows.withColumn(text, F.when(F.col("_pii").isNull(), F.col(text)).otherwise(joined)).withColumn("pii_counts", counts).drop("_pii")
