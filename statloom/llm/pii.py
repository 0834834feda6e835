"""Format-preserving pseudonyms: validated numbers and dates go through a keyed Feistel permutation of their format.

A value is found by form and kept as it is unless its content proves valid: cards by the Luhn sum, account numbers (IBAN)
by the rest modulo 97, dates by the calendar, IPv4 addresses by their parts, US social security numbers by their issue
rules, phone numbers and mail addresses by form. A valid value's free part is a pair (l, r) of two ranges; rounds add a
keyed hash of one to the other, modulo its range, which is a permutation. Check digits are computed anew, and separators
stay. So equal values get equal pseudonyms in every document, different ones stay different, pseudonyms are valid values
of the same form, and whoever holds the key can turn them back (``inverse``). All of it is SQL: no code outside Spark's
own functions, no shuffle, and each value depends on the key and itself alone.

A date with slashes is read with the day first, and with the month first where it is no date otherwise; such dates are
permuted among themselves (the permutation is repeated until the day is above 12, so that the way back reads them alike).

The name of a mail address is matched from the first sign of its run only, and each form's length is bounded, so finding
values takes time in proportion to the text.

Defined cases: a null text stays null with no values; an empty text stays empty; a very long text is read whole; rows are
treated one by one, so repeated rows give repeated results; an empty table gives none; further columns of any name stay,
and columns named as the counts are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import fresh

ROUNDS = 10
#: Forms by kind, tried in this order at each place.
FORMS = {
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "email": r"(?<![A-Za-z0-9._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]{1,63}\.){1,60}[A-Za-z]{2,63}",
    "date": r"(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\.\d)",
    "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}|\d{3}(?:-\d{3}-|\.\d{3}\.| \d{3} )\d{4}",
    "card": r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}",
}
KINDS = list(FORMS)
#: 400 years of days: 1800-01-01 to 2199-12-31 are 189 * 773 days.
FIRST_DAY, DAYS = "date'1800-01-01'", (189, 773)
#: How often a date with the month first is permuted at most; 3 of 5 times its day is above 12, so 64 times are enough.
WALK = 64


def quoted(regex: str) -> str:
    return "'" + regex.replace("\\", "\\\\").replace("'", "\\'") + "'"


def whole_form() -> str:
    forms = "|".join(f.replace("([ -])", "(?<sep>[ -])").replace(r"\1", r"\k<sep>") for f in FORMS.values())
    return rf"(?<![0-9A-Za-z])(?<![0-9]\.)(?:{forms})(?![0-9A-Za-z])"


# --- the permutation ------------------------------------------------------------------------------------------------


def let(name: str, value: str, body: str) -> str:
    """SQL that names a value."""
    return f"transform(array({value}), {name} -> {body})[0]"


def feistel(key: str, kind: str, left: str, right: str, a: str, b: str, inverse: bool) -> str:
    """SQL for a struct (l, r), from l in [0, a) and r in [0, b). The ranges are part of the hash."""
    step = "-" if inverse else "+"
    hashed = lambda x, m: f"pmod(CAST(conv(substr(sha2(concat_ws('|', {key}, '{kind}', {a}, {b}, i, {x}), 256), 1, 15), 16, 10) AS BIGINT), {m})"
    l_turn = f"named_struct('l', pmod(s.l {step} {hashed('s.r', a)}, {a}), 'r', s.r)"
    r_turn = f"named_struct('l', s.l, 'r', pmod(s.r {step} {hashed('s.l', b)}, {b}))"
    order = f"sequence({ROUNDS - 1}, 0, -1)" if inverse else f"sequence(0, {ROUNDS - 1})"
    return f"aggregate({order}, named_struct('l', CAST({left} AS BIGINT), 'r', CAST({right} AS BIGINT)), (s, i) -> CASE WHEN i % 2 = 0 THEN {l_turn} ELSE {r_turn} END)"


def permuted(key: str, kind: str, s: str, radix: int, inverse: bool) -> str:
    """SQL for a string of 2 to 24 signs of the radix (10 or 36), permuted among those of its length."""
    number = lambda x: f"CAST(conv({x}, {radix}, 10) AS BIGINT)"
    back = lambda x, n: f"lpad(lower(conv(CAST({x} AS STRING), 10, {radix})), {n}, '0')"
    h, n = f"(length({s}) DIV 2)", f"length({s})"
    size = lambda k: f"CAST(CAST(pow({radix}, {k}) AS DECIMAL(38,0)) AS BIGINT)"
    halves = feistel(key, kind, number(f"substr({s}, 1, {h})"), number(f"substr({s}, {h} + 1)"), size(h), size(f"({n} - {h})"), inverse)
    return let("p", halves, f"concat({back('p.l', h)}, {back('p.r', f'({n} - {h})')})")


def permuted_sign(key: str, kind: str, s: str, inverse: bool, radix: int = 36) -> str:
    """SQL for one sign (of radix 36, or a capital letter for 26): the next one in a keyed cycle of all, so that none stays."""
    a, b = (6, 6) if radix == 36 else (2, 13)
    number = f"CAST(conv({s}, 36, 10) AS BIGINT)" if radix == 36 else f"CAST(ascii({s}) - 65 AS BIGINT)"
    sign = (lambda x: f"lower(conv(CAST({x} AS STRING), 10, 36))") if radix == 36 else (lambda x: f"chr(65 + {x})")
    turn = lambda x, back: feistel(key, kind, f"{x} DIV {b}", f"{x} % {b}", str(a), str(b), back)
    step = radix - 1 if inverse else 1
    place = let("sp", turn(number, False), f"(sp.l * {b} + sp.r + {step}) % {radix}")
    return let("st", place, let("su", turn("st", True), sign(f"(su.l * {b} + su.r)")))


def permuted_letters(key: str, kind: str, s: str, inverse: bool) -> str:
    """SQL for a string of up to 24 capital letters, permuted among those of its length."""
    number = lambda x: f"aggregate(split({x}, ''), 0L, (u, c) -> CASE WHEN c = '' THEN u ELSE u * 26 + ascii(c) - 65 END)"
    power = lambda k: f"CAST(CAST(pow(26, {k}) AS DECIMAL(38,0)) AS BIGINT)"
    back = lambda x, n: f"array_join(transform(sequence({n} - 1, 0, -1), e -> chr(65 + ({x} DIV {power('e')}) % 26)), '')"
    h, n = f"(length({s}) DIV 2)", f"length({s})"
    halves = feistel(key, kind, number(f"substr({s}, 1, {h})"), number(f"substr({s}, {h} + 1)"), power(h), power(f"({n} - {h})"), inverse)
    many = let("pl", halves, f"concat({back('pl.l', h)}, {back('pl.r', f'({n} - {h})')})")
    return f"CASE {n} WHEN 0 THEN {s} WHEN 1 THEN {permuted_sign(key, kind, s, inverse, 26)} ELSE {many} END"


def refill(form: str, signs: str, fill: str) -> str:
    """SQL that puts the signs of fill where form has signs, and keeps what is between them. Signs and the rest are numbered
    by their places and sorted together, which takes time in proportion to their number (and its logarithm)."""
    chars = lambda x: f"filter(split({x}, ''), c -> c <> '')"
    places = lambda test: f"filter(sequence(0, size(o) - 1), k -> {test})"
    filled = f"zip_with({places(f'o[k] rlike {quoted(signs)}')}, {chars(fill)}, (k, c) -> struct(k, c))"
    kept = f"transform({places(f'NOT o[k] rlike {quoted(signs)}')}, k -> struct(k, o[k] AS c))"
    whole = f"array_join(transform(array_sort(concat({filled}, {kept})), x -> x.c), '')"
    return let("o", chars(form), f"CASE WHEN size(o) = 0 THEN '' ELSE {whole} END")


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


# --- kinds: what is valid, and its pseudonym ------------------------------------------------------------------------


def luhn(d: str) -> str:
    """SQL for the sum of a string of digits, from the right, every second one doubled."""
    each = f"CAST(substr(reverse({d}), k, 1) AS INT)"
    return f"aggregate(transform(sequence(1, length({d})), k -> CASE WHEN k % 2 = 1 THEN {each} WHEN {each} > 4 THEN 2 * {each} - 9 ELSE 2 * {each} END), 0, (x, y) -> x + y)"


def rest97(x: str) -> str:
    value = "CASE WHEN c rlike '[0-9]' THEN (a * 10 + CAST(c AS INT)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END"
    return f"aggregate(split({x}, ''), 0, (a, c) -> CASE WHEN c = '' THEN a ELSE {value} END)"


def iban_rest(x: str) -> str:
    return let("w", f"replace({x}, ' ', '')", rest97("concat(substr(w, 5), substr(w, 1, 4))"))


def day(m: str) -> str:
    return f"coalesce(try_to_date({m}, 'yyyy-MM-dd'), try_to_date({m}, 'dd.MM.yyyy'), try_to_date({m}, 'dd/MM/yyyy'), try_to_date({m}, 'MM/dd/yyyy'))"


def valid(m: str) -> str:
    """SQL for the kind of a match, or null if its content is not valid. m stands for a name."""
    form = lambda kind: f"{m} rlike {quoted('^(?:' + FORMS[kind] + ')$')}"
    tests = {
        "iban": f"{iban_rest(m)} = 1 AND length({digits(f'substr({m}, 5)')}) BETWEEN 2 AND 24",
        "email": "true",
        "date": f"year({day(m)}) BETWEEN 1800 AND 2199",
        "ip": f"forall(split({m}, '\\\\.'), x -> CAST(x AS INT) < 256 AND (x = '0' OR x NOT LIKE '0%'))",
        "ssn": rf"{m} rlike '^(?!000|666|9)\\d{{3}}-(?!00)\\d{{2}}-(?!0000)\\d{{4}}$'",
        "phone": f"length({digits(m)}) BETWEEN 8 AND 15",
        "card": f"{luhn(digits(m))} % 10 = 0",
    }
    return "CASE " + " ".join(f"WHEN {form(k)} THEN CASE WHEN {t} THEN '{k}' END" for k, t in tests.items()) + " END"


def pseudonym(m: str, kind: str, key: str, inverse: bool) -> str:
    """SQL for the pseudonym of a valid match; m and kind stand for names."""
    d = digits(m)
    payload = let("q", f"substr({d}, 1, length({d}) - 1)", permuted(key, "card", "q", 10, inverse))
    check = f"CAST(pmod(10 - {luhn('concat(f, 0)')} % 10, 10) AS STRING)"
    card = refill(m, "[0-9]", let("f", payload, f"concat(f, {check})"))
    free = f"substr({d}, CASE WHEN {m} rlike '^[0-9]' THEN 1 ELSE greatest(length({d}) - 10, 2) END)"  # the country code stays
    phone = let("z", free, refill(m, "[0-9]", f"concat(substr({d}, 1, length({d}) - length(z)), {permuted(key, 'phone', 'z', 10, inverse)})"))
    part = lambda k: f"CAST(split({m}, '\\\\.')[{k}] AS BIGINT)"
    octets = feistel(key, "ip", f"{part(0)} * 256 + {part(1)}", f"{part(2)} * 256 + {part(3)}", "65536", "65536", inverse)
    ip = let("p", octets, "concat_ws('.', p.l DIV 256, p.l % 256, p.r DIV 256, p.r % 256)")
    turned = lambda n: let("p", feistel(key, "date", f"{n} DIV {DAYS[1]}", f"{n} % {DAYS[1]}", str(DAYS[0]), str(DAYS[1]), inverse), f"date_add({FIRST_DAY}, CAST(p.l * {DAYS[1]} + p.r AS INT))")
    moved = turned(f"datediff({day(m)}, {FIRST_DAY})")
    date = f"date_format({moved}, CASE WHEN {m} LIKE '%-%' THEN 'yyyy-MM-dd' WHEN {m} LIKE '%/%' THEN 'dd/MM/yyyy' ELSE 'dd.MM.yyyy' END)"
    walk = f"aggregate(sequence(1, {WALK}), {day(m)}, (e, j) -> CASE WHEN j > 1 AND day(e) > 12 THEN e ELSE {turned(f'datediff(e, {FIRST_DAY})')} END)"
    date = f"CASE WHEN {m} LIKE '%/%' AND try_to_date({m}, 'dd/MM/yyyy') IS NULL THEN date_format({walk}, 'MM/dd/yyyy') ELSE {date} END"
    area = f"CAST(substr({m}, 1, 3) AS INT)"
    l, r = f"(({area} - CASE WHEN {area} > 666 THEN 2 ELSE 1 END) * 99 + CAST(substr({m}, 5, 2) AS INT) - 1)", f"(CAST(substr({m}, 8) AS INT) - 1)"
    new_area = "(p.l DIV 99 + CASE WHEN p.l DIV 99 >= 665 THEN 2 ELSE 1 END)"
    ssn = let("p", feistel(key, "ssn", l, r, "88902", "9999", inverse), f"concat_ws('-', lpad(CAST({new_area} AS STRING), 3, '0'), lpad(CAST(p.l % 99 + 1 AS STRING), 2, '0'), lpad(CAST(p.r + 1 AS STRING), 4, '0'))")
    own = digits(f"substr({m}, 5)")
    bank = f"regexp_replace(substr({m}, 5), '[^A-Z]', '')"  # the letters of the bank code
    account = let("g", let("z", own, permuted(key, "iban", "z", 10, inverse)), refill(f"substr({m}, 5)", "[0-9]", "g"))
    account = let("t0", account, let("gl", let("zl", bank, permuted_letters(key, "iban letters", "zl", inverse)), refill("t0", "[A-Z]", "gl")))
    iban = let("t", account, f"concat(substr({m}, 1, 2), lpad(CAST(98 - {iban_rest(f'concat(substr({m}, 1, 2), 0, 0, t)')} AS STRING), 2, '0'), t)")
    local, signs = f"substring_index({m}, '@', 1)", f"lower(regexp_replace(substring_index({m}, '@', 1), '[^A-Za-z0-9]', ''))"
    blocks = f"array_join(transform(regexp_extract_all(v, '.{{1,24}}', 0), y -> {let('z', 'y', f"CASE WHEN length(z) = 0 THEN z WHEN length(z) = 1 THEN {permuted_sign(key, 'email', 'z', inverse)} ELSE " + permuted(key, 'email', 'z', 36, inverse) + ' END')}), '')"
    email = let("g", let("v", signs, blocks), f"concat({refill(local, '[A-Za-z0-9]', 'g')}, '@', substring_index({m}, '@', -1))")
    by = {"iban": iban, "email": email, "date": date, "ip": ip, "ssn": ssn, "phone": phone, "card": card}
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in by.items()) + f" ELSE {m} END"


def pseudonymise(docs: DataFrame, key: str, text: str = "text", inverse: bool = False) -> DataFrame:
    """docs with the text's valid values replaced, and n_<kind> for each kind (long)."""
    key = quoted(key)
    form = quoted(whole_form())
    found, kinds, new = fresh([*docs.columns, *(f"n_{k}" for k in KINDS)], "found", "kinds", "new")
    plan = docs.withColumn(found, F.expr(f"regexp_extract_all({text}, {form}, 0)"))
    plan = plan.withColumn(kinds, F.expr(f"transform({found}, m -> {valid('m')})"))
    plan = plan.withColumn(new, F.expr(f"zip_with({found}, {kinds}, (m, kind) -> {pseudonym('m', 'kind', key, inverse)})"))
    joined = f"array_join(zip_with(split({text}, {form}, -1), {new}, (x, y) -> concat(x, coalesce(y, ''))), '')"
    counts = {f"n_{k}": F.expr(f"CAST(coalesce(size(filter({kinds}, k -> k = '{k}')), 0) AS BIGINT)") for k in KINDS}
    plan = plan.withColumns({text: F.expr(f"CASE WHEN size({found}) > 0 THEN {joined} ELSE {text} END"), **counts})
    return plan.drop(found, kinds, new)
