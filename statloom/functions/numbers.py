"""Column expressions for amounts: parsing, rounding, masking, comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x evaluated once, however often it stands in the result: lambdas share no parts of expressions."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def canonical(x: Column | str, digits: int = 4) -> Column:
    """Half-even rounding of the shortest decimal form; NaN and infinities become null, -0 becomes 0."""
    x = col(x)
    finite = F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
    return F.bround(finite.cast("string").cast("decimal(38,18)"), digits).cast("double") + F.lit(0.0)


def valid_value(x: Column | str) -> Column:
    """Not null, no whole number from 1900 to 2100 (a year), at most 1e13 in size, not 0."""
    x = col(x)
    year = (x == F.floor(x)) & x.between(1900, 2100)
    return F.coalesce(~year & (F.abs(x) <= 1e13) & (x != 0), F.lit(False))


def materially_differs(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return F.abs(a - b) > F.greatest(F.lit(1000.0), 0.01 * F.greatest(F.abs(a), F.abs(b)))


def grouped_digits(right: Column, left: Column) -> Column:
    """Whether a single separator stands between thousands: three digits after it, digits before it."""
    return right.rlike("^[0-9]{3}$") & F.translate(left, "-(", "").rlike("^[0-9]+$")


def parse_amount(raw: Column | str) -> Column:
    """A number as statements print it: thousands by blank, comma or dot; parentheses or a minus sign negative; more than
    16 digits is no amount."""
    raw = col(raw)
    # Cheap tests go before patterns, which most numbers then never meet.
    negative = (raw.contains("(") & raw.contains(")")) | ((raw.contains("-") | raw.contains("−")) & (raw.rlike(r"^\s*[−-]") | raw.rlike(r"−\s*$")))
    bare = let(F.translate(raw, "−\u00a0 \t", "-"), lambda x: F.when(x.rlike(r"\s"), F.regexp_replace(x, r"^\s+|\s+$", "")).otherwise(x))
    value = let(bare, lambda s: let(F.regexp_replace(ungrouped(s), r"[^0-9.\-]", ""), plain_amount))
    return F.when(negative, -F.abs(value)).otherwise(value)


def plain_amount(clean: Column) -> Column:
    digits = F.length(F.translate(clean, ".-", ""))  # there is nothing else in it
    return F.when((digits <= 16) & (digits > 0) & clean.rlike(r"^-?[0-9]*\.?[0-9]*$"), clean.try_cast("double"))


def ungrouped(s: Column) -> Column:
    """A printed number without separators of thousands, its decimal sign a dot."""
    commas, dots = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit(""))), F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
    no_comma, no_dot = F.replace(s, F.lit(","), F.lit("")), F.replace(s, F.lit("."), F.lit(""))
    last = lambda sep: F.length(s) - F.length(F.substring_index(s, sep, -1))
    right = lambda sep: F.when(s.contains(")"), F.regexp_replace(F.substring_index(s, sep, -1), r"\)+$", "")).otherwise(F.substring_index(s, sep, -1))
    return (
        F.when((commas > 0) & (dots > 0), F.when(last(".") > last(","), no_comma).otherwise(F.replace(no_dot, F.lit(","), F.lit("."))))
        .when(commas > 1, no_comma)
        .when(dots > 1, no_dot)
        .when(commas == 1, F.when(grouped_digits(right(","), F.substring_index(s, ",", 1)), F.concat(F.substring_index(s, ",", 1), right(","))).otherwise(F.replace(s, F.lit(","), F.lit("."))))
        .when((dots == 1) & grouped_digits(right("."), F.substring_index(s, ".", 1)), F.concat(F.substring_index(s, ".", 1), right(".")))
        .otherwise(s)
    )


#: A number within a text, grouped by comma, blank or dot, or plain.
NUMBER = r"[-(]?\$?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?\)?|[-(]?\$?[0-9]{1,3}(?:[ \t\xa0][0-9]{3})+(?:[.,][0-9]+)?\)?|[-(]?\$?[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]+)?\)?|[-(]?\$?[0-9]+(?:[.,][0-9]+)?\)?"


def numbers_in(text: Column | str) -> Column:
    """The numbers of a text as printed, in their order."""
    return F.regexp_extract_all(col(text), F.lit(NUMBER), F.lit(0))


def last_amount(text: Column | str) -> Column:
    return parse_amount(F.try_element_at(numbers_in(text), F.lit(-1)))


def first_period(raw: Column) -> Column:
    """Of a run of four groups of digits that prints two periods' amounts, the first amount."""
    groups = F.regexp_extract_all(raw, F.lit("[0-9]+"), F.lit(0))
    two = raw.rlike(r"^\D*([0-9]{3}(\D+[0-9]{3}){3}|[0-9]{1,2}\D+[0-9]{3}\D+[0-9]{1,2}\D+[0-9]{3})\D*$")
    return F.when((F.length(raw) >= 11) & two, F.array_join(F.slice(groups, 1, 2), " ")).otherwise(raw)


def preferred_amount(text: Column | str) -> Column:
    """The first amount of a text that is no year; references of up to three digits and form numbers (07...) are taken only
    if there is nothing else, and then the last. Null or no number: null."""
    read = F.transform(F.transform(numbers_in(text), first_period), lambda r: F.struct(F.regexp_replace(r, "[^0-9]", "").alias("digits"), parse_amount(r).alias("value")))
    year = lambda v: (v == F.floor(v)) & v.between(1900, 2100)
    form = lambda d: d.startswith("07") & (F.length(d) >= 6)

    def chosen(found: Column) -> Column:
        better = F.filter(found, lambda x: ~((F.length(x["digits"]) <= 3) & (F.size(found) > 1)) & ~form(x["digits"]))
        return F.coalesce(F.try_element_at(better, F.lit(1))["value"], F.try_element_at(found, F.lit(-1))["value"])

    return let(F.filter(read, lambda x: x["value"].isNotNull() & ~year(x["value"])), chosen)


#: Words for scales.
SCALES = {"миллиардов": 1e9, "миллионов": 1e6, "миллиард": 1e9, "миллион": 1e6, "тысяч": 1e3, "млрд.": 1e9, "тыс.": 1e3, "млн.": 1e6, "млрд": 1e9, "тыс": 1e3, "млн": 1e6}


def parse_scaled(raw: Column | str) -> Column:
    """A number with an optional scale word and currency sign; a single comma is a decimal one."""
    text = F.regexp_replace(col(raw), r"^\s+|\s+$", "")
    low = F.lower(text)
    scale, body = F.lit(1.0), text
    for word, factor in reversed(SCALES.items()):
        ends, inside = low.endswith(word), low.rlike(rf"\s{word.replace('.', chr(92) + '.')}(\s|$)")
        scale = F.when(ends | inside, F.lit(factor)).otherwise(scale)
        before = F.regexp_extract(text, rf"(?is)^(.*?)\s+{word.replace('.', chr(92) + '.')}(\s.*|$)", 1)
        body = F.when(ends, F.substring(text, F.lit(1), F.length(text) - F.lit(len(word)))).when(inside, before).otherwise(body)
    body = F.regexp_replace(body, "[₽$€£¥]", "")
    dot, comma = body.contains("."), body.contains(",")
    commas = F.length(body) - F.length(F.replace(body, F.lit(","), F.lit("")))
    dots = F.length(body) - F.length(F.replace(body, F.lit("."), F.lit("")))
    after = lambda sep: F.length(F.substring_index(body, sep, -1))
    plain = (
        F.when(dot & comma & (after(",") < after(".")), F.replace(F.replace(body, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(dot & comma, F.replace(body, F.lit(","), F.lit("")))
        .when(comma & (commas == 1), F.replace(body, F.lit(","), F.lit(".")))
        .when(comma, F.replace(body, F.lit(","), F.lit("")))
        .when(dots > 1, F.replace(body, F.lit("."), F.lit("")))
        .otherwise(body)
    )
    plain = F.regexp_replace(plain, "[   ]", "")
    return F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), plain.try_cast("double")) * scale


def masked(x: Column | str) -> Column:
    """An amount with X for each digit, grouped by thousands, sign kept; zero is X."""
    x = col(x)
    digits = F.format_number(F.abs(x), 0)
    return F.when(x.isNull(), None).when(x == 0, "X").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), F.regexp_replace(digits, "[0-9]", "X")))


# --- numbers of scanned forms ---------------------------------------------------------------------------------------

#: A run of groups of digits, and a number of a scanned form (its first group may have four digits).
RUN = r"[-(]?\$?[0-9]+(?:[ \t\xa0]+[0-9]+)+(?:[.,][0-9]+)?\)?"
SCANNED = r"[-(]?\$?[0-9]{1,4}(?:[ \t\xa0][0-9]{3})+(?:[.,][0-9]+)?\)?|[-(]?\$?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?\)?|[-(]?\$?[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]+)?\)?|[-(]?\$?[0-9]+(?:[.,][0-9]+)?\)?"


def is_year(v: Column) -> Column:
    return (v == F.floor(v)) & v.between(1900, 2100)


def first_of_periods(raw: Column) -> Column:
    """Of a run of 4, 6, 8, 9 or 12 groups of digits, which a scan made of two or three periods' amounts, the first amount:
    as many groups as its period has. Six groups are two amounts of three groups, or three of two where the first group
    has four digits."""

    def cut(groups: Column) -> Column:
        n = F.size(groups)
        take = F.when(n == 4, 2).when(n == 6, F.when(F.length(groups[0]) == 4, 2).otherwise(3)).when(n == 8, 4).when(n == 9, 3).when(n == 12, 4)
        sign = F.when(raw.rlike(r"^\s*[(−-]"), "-").otherwise("")
        return F.when(take.isNotNull() & ~raw.contains("\n"), F.concat(sign, F.array_join(F.slice(groups, F.lit(1), F.coalesce(take, F.lit(1))), " "))).otherwise(raw)

    return F.when(F.length(raw) < 7, raw).otherwise(let(F.regexp_extract_all(raw, F.lit("[0-9]+"), F.lit(0)), cut))


def scanned_amounts(text: Column | str) -> Column:
    """The different numbers of a scanned text, runs of groups first: an array of (digits, value), years left out."""
    text = col(text)
    raw = F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), F.regexp_extract_all(text, F.lit(SCANNED), F.lit(0))))
    each = F.transform(raw, lambda r: F.struct(F.regexp_replace(r, "[^0-9]", "").alias("digits"), parse_amount(first_of_periods(r)).alias("value")))
    return F.filter(each, lambda x: x["value"].isNotNull() & ~is_year(x["value"]))


def preferred_scanned_amount(text: Column | str) -> Column:
    """The first amount of a scanned text: neither a reference of up to three digits, nor a line code of four beside longer
    numbers, nor a form number (07...), unless there is nothing else; then the last."""

    def chosen(found: Column) -> Column:
        n, long = F.length, F.exists(found, lambda x: F.length(x["digits"]) >= 6)
        several = F.size(found) > 1
        bad = lambda x: (several & (n(x["digits"]) <= 3)) | (several & long & (n(x["digits"]) == 4) & (F.abs(x["value"]) < 10000)) | (x["digits"].startswith("07") & (n(x["digits"]) >= 6))
        return F.coalesce(F.try_element_at(F.filter(found, lambda x: ~bad(x)), F.lit(1))["value"], F.try_element_at(found, F.lit(-1))["value"])

    return let(scanned_amounts(text), chosen)


def amount_after_code(text: Column | str) -> Column:
    """The first amount of five digits or more behind a line code; beside others none above 1e10, which are joined columns."""

    def chosen(found: Column) -> Column:
        fit = F.filter(found, lambda x: (F.length(x["digits"]) >= 5) & ((F.size(found) == 1) | (F.abs(x["value"]) <= 1e10)))
        return F.try_element_at(fit, F.lit(1))["value"]

    return let(scanned_amounts(text), chosen)


def valid(x: Column) -> Column:
    """x where it may be a metric's value, else null."""
    return let(x, lambda v: F.when(valid_value(v), v))
