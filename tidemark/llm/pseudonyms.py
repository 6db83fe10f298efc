"""Format-preserving pseudonyms of personal data, with DataFrame functions only.

Values are found with a bounded pattern for each kind, validated, and permuted under a key by a Feistel network within their own
format: digits stay digits, letters letters, dates dates, card and account numbers keep valid check digits. Equal values
become equal pseudonyms in every document, and different values of a format stay different.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Spark hides settings with "secret" in their name from its pages and logs.
KEY_SETTING = "spark.tidemark.pseudonym.secret"
ROUNDS = 10

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
SECRET = r"\bAKIA[0-9A-Z]{16}\b|(?i:password|passwd|pwd|token|secret|api_?key)(?:\s?[=:]\s?)\"?[0-9A-Za-z_+/-]{8,}\"?"
# around values of digits
_FREE, _END = r"(?<![\w.+-])", r"(?![\w-]|\.\d)"
IP = r"\d{1,3}(?:\.\d{1,3}){3}"
# colons beside one would make it part of a longer one
IP6 = r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::(?:[0-9A-Fa-f]{1,4}:){1,6}[0-9A-Fa-f]{1,4})(?![\w:])"
_MONTHS = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
NAMED = rf"(?:\d{{1,2}} {_MONTHS} \d{{4}}|{_MONTHS} \d{{1,2}}, \d{{4}})"
DATE = rf"(?:\d{{4}}(?:-\d\d-|/\d\d/|\.\d\d\.)\d\d|\d\d(?:/\d\d/|\.\d\d\.|-\d\d-)\d{{4}}|{NAMED})"
SSN = r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}"
#: Country codes by the digits that follow, where all numbers of a country have as many.
_NATIONAL = {8: "45|47|65", 9: "3[134]|351|380|4[18]|61|971", 10: "[17]|44|52|9[01]", 11: "86"}
_GROUPS = r"\d{2,4}(?:[ .-]?\d{2,4})"
PHONES = [
    *[rf"\+(?:{codes})(?:[ .()-]{{0,2}}\d){{{n}}}" for n, codes in _NATIONAL.items()],
    r"\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}",
    r"\d{3}[ .-]\d{3}[ .-]\d{4}",
    # other groupings: all that follow up to 15 digits, else the first few
    rf"(?!\+?\(?\d(?:[ .()-]{{0,2}}\d){{15}})(?:\+\d{{1,3}}[ .-]?(?:\(\d{{2,4}}\)[ .-]?)?|\(\d{{2,4}}\)[ .-]?){_GROUPS}{{1,4}}",
    rf"(?:\+\d{{1,3}}[ .-]?|\(\d{{2,4}}\)[ .-]?){_GROUPS}{{1,2}}",
    rf"\+\d{{1,3}}[ .-]?\(\d{{2,4}}\)[ .-]?{_GROUPS}",
]
DATED = f"{IP6}|{_FREE}{IP}{_END}|{_FREE}{DATE}(?:{_END}|(?=T\\d\\d))|{_FREE}{SSN}{_END}"
PHONE = f"{_FREE}(?:{'|'.join(PHONES)}){_END}"
#: Values with check digits are candidates at every place where one may begin, and count once their check holds.
#: Cards as they are printed; then any other grouping of their digits.
CARDS = [
    r"\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5}",
    r"\d{4}(?:[ -]\d{4}){3}[ -]\d{1,3}",
]
OTHER_CARDS = [rf"\d{{3,12}}(?:[ -]{{1,2}}\d{{1,12}}){{{n}}}" for n in range(5, 0, -1)]
#: Lengths of account numbers by country; countries without one take all groups that follow.
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|CR|HR|LI|LV", 22: "BG|BH|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV",
    29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC",
}
IBANS = [
    "|".join(rf"(?:{codes})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in _LENGTHS.items()),
    r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
]
ACCOUNT = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2}"
LONG = rf"{_FREE}\d(?:[ -]{{0,2}}\d){{12}}"
FOUND = f"{EMAIL}|{SECRET}|{ACCOUNT}|{DATED}|{PHONE}|{LONG}"

KINDS = ("email", "phone", "card", "ip", "date", "ssn", "iban", "secret")
#: Forms of dates in the order of trial. A date with slashes is the day's first, and the month's first where that is none.
_DATES = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"), (r"^\d{4}\.\d{2}\.\d{2}$", "yyyy.MM.dd"), (r"^\d{2}\.\d{2}\.\d{4}$", "dd.MM.yyyy"), (r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"),
    (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"), (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
    (r"^\d", "d MMMM yyyy"), (r"^\d", "d MMM yyyy"), (r"^[A-Z]", "MMMM d, yyyy"), (r"^[A-Z]", "MMM d, yyyy"),
)
US = "MM/dd/yyyy"
#: A cycle of the calendar, 400 years from this day, has 27 x 5411 days.
_DAY_ZERO, _DAYS = "1800-01-01", (27, 5411)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _mac(key: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, *[p.cast("string") for p in parts]), 256)


def _number(mac: Column, at: Column | int = 1) -> Column:
    """A number below 2^48 from twelve hex digits of a hash."""
    return F.conv(F.substr(mac, F.lit(at), F.lit(12)), 16, 10).cast("long")


def permute_number(value: Column, radix: tuple[int, int], key: Column) -> Column:
    """A permutation of 0 .. a*b-1 for radix (a, b): Feistel rounds on the quotient and the rest by b."""
    a, b = radix

    def turn(x: Column, r: Column) -> Column:
        left = F.pmod(x["left"] + _number(_mac(key, r, x["right"])), F.lit(a))
        right = F.pmod(x["right"] + _number(_mac(key, r, x["left"])), F.lit(b))
        even = r % 2 == 0
        return F.struct(F.when(even, left).otherwise(x["left"]).alias("left"), F.when(even, x["right"]).otherwise(right).alias("right"))

    begin = F.struct(F.floor(value / b).cast("long").alias("left"), F.pmod(value, F.lit(b)).cast("long").alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, turn, lambda x: x["left"] * b + x["right"])


def _shift(half: Column, mac: Column, hexadecimal: bool) -> Column:
    """Moves each character within its alphabet, by amounts from a hash."""
    alphabets = ["0123456789abcdef"] if hexadecimal else ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]

    def move(c: Column, i: Column) -> Column:
        amount = F.conv(F.substr(mac, (i % 56 + 1).cast("int"), F.lit(8)), 16, 10).cast("long")
        out = c
        for letters in alphabets:
            at = F.position(c, F.lit(letters))
            out = F.when(at > 0, F.substr(F.lit(letters), (F.pmod(at - 1 + amount, F.lit(len(letters))) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(half, ""), move), "")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once; a lambda would work out what it names again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def permute_text(s: Column, key: Column, hexadecimal: bool = False) -> Column:
    """A permutation of the strings of a format: rounds that move the characters of one half by a hash of the other."""
    cut = F.floor(F.length(s) / 2).cast("int")

    def turn(x: Column, r: Column) -> Column:
        even = r % 2 == 0
        left = _bound(_mac(key, r, x["right"]), lambda m: _shift(x["left"], m, hexadecimal))
        right = _bound(_mac(key, r, x["left"]), lambda m: _shift(x["right"], m, hexadecimal))
        return F.struct(F.when(even, left).otherwise(x["left"]).alias("left"), F.when(even, x["right"]).otherwise(right).alias("right"))

    begin = F.struct(F.substr(s, F.lit(1), cut).alias("left"), F.substr(s, cut + 1, F.length(s)).alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, turn, lambda x: F.concat(x["left"], x["right"]))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, modulo 10, its last digit counting once."""
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10


def _mod97(s: Column) -> Column:
    """An account number, letters as 10 to 35, modulo 97."""

    def step(a: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[A-Z]"), (a * 100 + letter) % 97).otherwise((a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97)

    return F.aggregate(F.split(s, ""), F.lit(0), lambda a, c: step(a, c).cast("int"))


def _refill(template: Column, fresh: Column, places: str) -> Column:
    """``template`` with its characters that match ``places`` replaced, in order, by those of ``fresh``."""
    begin = lambda f: F.struct(F.lit("").alias("out"), F.lit(1).alias("at"), f.alias("fresh"))

    def step(x: Column, c: Column) -> Column:
        here = c.rlike(places)
        return F.struct(F.concat(x["out"], F.when(here, F.substr(x["fresh"], x["at"], F.lit(1))).otherwise(c)).alias("out"), (x["at"] + F.when(here, 1).otherwise(0)).alias("at"), x["fresh"].alias("fresh"))

    return F.aggregate(F.split(template, ""), begin(fresh), step, lambda x: x["out"])


def kind_of(s: Column) -> Column:
    """The kind of a matched value, null if it is not valid as any."""
    digits = _digits(s)
    octets = F.split(s, r"\.")
    compact = F.replace(s, F.lit(" "), F.lit(""))
    return (
        F.when(s.contains("@"), "email")
        .when(s.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), F.when(_full_ip6(s), "ip"))
        .when(s.rlike(r"^AKIA|[=:]"), "secret")
        .when(s.rlike(r"^[A-Z]{2}\d{2}"), F.when((F.length(compact).between(15, 34)) & (_mod97(F.concat(F.substr(compact, F.lit(5), F.lit(40)), F.substr(compact, F.lit(1), F.lit(4)))) == 1), "iban"))
        .when(s.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), "ip"))
        .when(date_form(s).isNotNull(), "date")
        .when(s.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$"), "ssn")
        .when(s.rlike(r"^\d[\d -]*$") & F.length(digits).between(13, 19) & (_luhn(digits) == 0), "card")
        .when(s.rlike(r"^(\+\d{1,3}[ .-]?)?(\(\d{2,4}\)[ .-]?)?\d{2,4}([ .-]?\d{2,4}){1,4}$") & s.rlike(r"^[+(]|^\d{3}[ .-]\d{3}[ .-]\d{4}$") & F.length(digits).between(8, 15), "phone")
    )


def _full_ip6(s: Column) -> Column:
    """Eight groups, or fewer with one gap, a digit among them."""
    groups = F.size(F.array_remove(F.split(s, ":"), ""))
    return F.when(s.contains("::"), groups < 8).otherwise(groups == 8) & s.rlike(r"\d")


def date_form(s: Column) -> Column:
    """The number of the first form of which ``s`` is a date within the cycle of the calendar, null if none."""
    tries = [F.when(s.rlike(pattern) & _day(s, form).between(0, _DAYS[0] * _DAYS[1] - 1), k) for k, (pattern, form) in enumerate(_DATES)]
    return F.when(s.rlike(r"^[\dA-Z][\dA-Za-z]*[-/. ]"), F.coalesce(*tries))


def _moved_date(s: Column, key: Column) -> Column:
    """A date permuted within its form. A date of the month's first form goes on until its day is no month, as its own is."""
    out = F.lit(None).cast("string")
    turn = lambda n: permute_number(n, _DAYS, key)
    day = lambda n: F.date_add(F.lit(_DAY_ZERO).cast("date"), n.cast("int"))
    number = date_form(s)
    for k, (_, form) in enumerate(_DATES):
        start = _day(s, form).cast("long")
        if form == US:  # a step in 0.61 ends it
            moved = F.aggregate(F.sequence(F.lit(0), F.lit(99)), F.struct(start.alias("n"), F.lit(False).alias("done")), lambda x, _: F.when(x["done"], x).otherwise(_bound(turn(x["n"]), lambda n: F.struct(n.alias("n"), (F.dayofmonth(day(n)) > 12).alias("done")))), lambda x: x["n"])
        else:
            moved = turn(start)
        out = F.when(number == k, F.date_format(day(moved), form)).otherwise(out)
    return out


def _day(s: Column, form: str) -> Column:
    return F.datediff(F.try_to_timestamp(s, F.lit(form)).cast("date"), F.lit(_DAY_ZERO).cast("date"))


def pseudonym(s: Column, kind: Column, key: Column) -> Column:
    """The pseudonym of a valid value of ``kind``."""
    digits = _digits(s)
    tag = lambda name: F.concat(key, F.lit("|" + name))
    email = F.concat(permute_text(F.substring_index(s, "@", 1), tag("email")), F.lit("@"), F.substring_index(s, "@", -1))
    octets = F.split(s, r"\.")
    value = F.aggregate(octets, F.lit(0).cast("long"), lambda a, o: a * 256 + o.cast("long"))
    ip = permute_number(value, (65536, 65536), tag("ip"))
    dotted = F.concat_ws(".", *[F.pmod(F.shiftright(ip, k), F.lit(256)).cast("string") for k in (24, 16, 8, 0)])
    six = F.regexp_replace(F.lower(s), ":", "")
    hexed = _bound(permute_text(six, tag("ip6"), True), lambda f: _refill(s, F.when(s.rlike("[A-F]"), F.upper(f)).otherwise(f), "[^:]"))
    date = _moved_date(s, tag("date"))
    area = F.substr(digits, F.lit(1), F.lit(3)).try_cast("long")
    rest = F.substr(digits, F.lit(4), F.lit(2)).try_cast("long") * 9999 + F.substr(digits, F.lit(6), F.lit(4)).try_cast("long") - 10000
    ssn = permute_number((area - 1 - F.when(area > 666, 1).otherwise(0)) * 989901 + rest, (898, 989901), tag("ssn"))
    new_area, new_rest = F.floor(ssn / 989901), F.pmod(ssn, F.lit(989901))
    new_area = new_area + 1 + F.when(new_area >= 665, 1).otherwise(0)
    ssn = F.format_string("%03d-%02d-%04d", new_area, F.floor(new_rest / 9999) + 1, F.pmod(new_rest, F.lit(9999)) + 1)
    body = permute_text(F.substr(digits, F.lit(1), F.length(digits) - 1), tag("card"))
    check = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    card = _refill(s, F.concat(body, check), r"\d")
    prefix = F.regexp_extract(s, r"^\+\d{1,3}(?=[ .(-])|", 0)
    phone = F.concat(prefix, _refill(F.substr(s, F.length(prefix) + 1, F.length(s)), permute_text(_digits(F.substr(s, F.length(prefix) + 1, F.length(s))), tag("phone")), r"\d"))
    compact = F.replace(s, F.lit(" "), F.lit(""))
    country, account = F.substr(compact, F.lit(1), F.lit(2)), permute_text(F.substr(compact, F.lit(5), F.lit(40)), tag("iban"))
    iban = _refill(s, F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account), "[A-Z0-9]")
    lead = F.regexp_extract(s, r"^(AKIA|[A-Za-z_]+\s?[=:]\s?\"?)", 1)
    tail = F.substr(s, F.length(lead) + 1, F.length(s))
    secret = F.concat(lead, F.when(tail.rlike(r"^[0-9a-f]+\"?$"), permute_text(tail, tag("hex"), True)).otherwise(permute_text(tail, tag("secret"))))
    found = {"email": email, "ip": F.when(s.contains(":"), hexed).otherwise(dotted), "date": date, "ssn": ssn, "card": card, "phone": phone, "iban": iban, "secret": secret}
    out = s
    for name, value in found.items():
        out = F.when(kind == name, value).otherwise(out)
    return F.coalesce(out, s)


def _checked(body: Column, may: str, forms: list[str], good: Callable[[Column], Column]) -> Column:
    """The values of ``forms`` in a text, overlapping or not, that pass their check, as alternatives of a pattern; null without any."""
    begin, end = (r"\b", r"\b") if may == ACCOUNT else (_FREE, _END)
    every = F.concat(*[F.regexp_extract_all(body, F.lit(f"{begin}(?=((?:{form}){end}))"), F.lit(1)) for form in forms])
    held = F.when(body.rlike(may), F.filter(F.array_distinct(every), lambda v: F.coalesce(good(v), F.lit(False))))
    return F.when(F.size(held) > 0, F.concat(F.lit(f"{begin}(?:"), F.array_join(held, "|"), F.lit(f"){end}")))


def _pattern(body: Column) -> Column:
    """The pattern of all values of a text: those that a pattern can tell, and its own values whose check digits hold."""
    compact = lambda v: F.replace(v, F.lit(" "), F.lit(""))
    account = lambda v: _mod97(F.concat(F.substr(compact(v), F.lit(5), F.lit(40)), F.substr(compact(v), F.lit(1), F.lit(4)))) == 1
    card = lambda v: F.length(_digits(v)).between(13, 19) & (_luhn(_digits(v)) == 0)
    cards, others = _checked(body, LONG, CARDS, card), _checked(body, LONG, OTHER_CARDS, card)
    return F.concat_ws("|", F.lit(EMAIL), F.lit(SECRET), _checked(body, ACCOUNT, IBANS, account), F.lit(DATED), cards, F.lit(PHONE), others)


def session_key(spark: SparkSession) -> str:
    """The key named by the setting; where it is unset, a random one that the session keeps.

    Name a key of your own to get the same pseudonyms in every session, and keep it to invert them.
    """
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymise(docs: DataFrame, key: str, text: str = "text", out: str = "found", swap: Callable[[Column, Column, Column], Column] = pseudonym) -> DataFrame:
    """``docs`` with the valid values in ``text`` replaced, and the array ``out`` of their kinds, in order.

    Values that fail their check stay as they are, as do texts without any; a null text stays null with no kinds. Whole
    texts are read. A column named as ``out`` is replaced; repeated rows stay, changed alike; an empty table gives no rows.
    The key is a row that is joined to every document, so that no plan or log holds it.
    """
    body = F.col(text)
    none = F.array().cast("array<string>")
    held = docs.sparkSession.createDataFrame([(key,)], "_tidemark_key string")
    marked = docs.drop(out).crossJoin(F.broadcast(held))  # one row
    marked = marked.withColumn("_tidemark_pattern", F.when(body.rlike(FOUND), _pattern(body)))
    pattern = F.col("_tidemark_pattern")
    marked = marked.withColumn("_tidemark_values", F.coalesce(F.when(pattern.isNotNull(), F.regexp_extract_all(body, pattern, F.lit(0))), none))
    # each distinct value of a text is judged and permuted once
    marked = marked.withColumn("_tidemark_once", F.transform(F.array_distinct("_tidemark_values"), lambda v: F.struct(v.alias("v"), kind_of(v).alias("k"))))
    marked = marked.withColumn("_tidemark_new", F.transform("_tidemark_once", lambda x: F.when(x["k"].isNull(), x["v"]).otherwise(swap(x["v"], x["k"], F.col("_tidemark_key")))))
    marked = marked.withColumn("_tidemark_at", F.transform("_tidemark_values", lambda v: F.array_position(F.col("_tidemark_once.v"), v).cast("int") - 1))
    marked = marked.withColumn(out, F.transform("_tidemark_at", lambda i: F.get(F.col("_tidemark_once.k"), i)))
    fresh = F.transform("_tidemark_at", lambda i: F.get(F.col("_tidemark_new"), i))
    joined = F.array_join(F.zip_with(F.split(body, pattern, -1), fresh, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.when(F.exists(F.col(out), lambda k: k.isNotNull()), joined).otherwise(body)
    columns = [c for c in docs.columns if c != out]
    return marked.withColumn(text, changed).withColumn(out, F.filter(out, lambda k: k.isNotNull())).select(*columns, out)


def replace_private(docs: DataFrame) -> DataFrame:
    """``docs`` with pseudonyms in their texts and n_chars as long as those; other columns stay."""
    done = pseudonymise(docs, session_key(docs.sparkSession), out="_tidemark_found").drop("_tidemark_found")
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def op6(spark, sf_dir: str) -> DataFrame:
    done = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    count = lambda name: F.size(F.filter("found", lambda k: k == name)).cast("long").alias(f"n_{name}")
    return done.select("doc_id", "text", *[count(name) for name in KINDS])
