"""Format-preserving pseudonyms of personal data by keyed Feistel networks.

Payment cards (Luhn), bank account numbers (remainder 97), social security numbers, telephone numbers, network
addresses, calendar dates and the local parts of mail addresses are validated and permuted within their own format, so
the result is of the same kind and valid again, and equal values, in whatever document, get equal pseudonyms under one
key. Everything is column arithmetic in one projection: no shuffle, no table of values, no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

# The forms that are looked for. Each is tried at a place in this order; what a form matches but does not
# validate stays as it is, but for account numbers: they may end at an earlier blank, and what remains is searched for the other forms.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Lengths that the countries of the account number register fix; other countries' numbers are looked for by the general form.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _fixed_account(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


_ACCOUNTS = "|".join(_fixed_account(*x) for x in IBAN_LENGTHS.items())
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": rf"(?<![A-Za-z0-9])(?:(?:{_ACCOUNTS})(?![A-Za-z0-9])|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+(])(?:\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}|(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z])",
}
ANY_FORM = "|".join(FORMS.values())
NOT_IBAN = "|".join(form for name, form in FORMS.items() if name != "iban")
#: First and last year of the dates that are permuted, and the two moduli whose product is just above their number of days.
YEARS, DATE_MODULI = (1900, 2099), (271, 270)
_FIRST_DAY, _DAYS = "1900-01-01", 73049
_WALK = 12
#: Dates as day/month have a day above 12, as 3 of 5 do.
_WALK_DAY_FIRST = 60


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _number(key: str, label: str, *parts: Column) -> Column:
    """A keyed pseudo-random number of 44 bits."""
    inner = F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(F.sha2(F.concat(F.lit(key), inner), 256), 1, 11), 16, 10).cast("long")


def _shifted(c: Column, by: Column) -> Column:
    """A letter or digit moved within its class; other characters stay."""
    def within(first: int, n: int) -> Column:
        return F.char(F.lit(first) + F.pmod(F.ascii(c) - first + by, F.lit(n)))

    return F.when(c.rlike("^[0-9]$"), within(48, 10)).when(c.rlike("^[a-z]$"), within(97, 26)).when(c.rlike("^[A-Z]$"), within(65, 26)).otherwise(c)


def permuted_text(value: Column, key: str, label: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the strings with the same character class at each place."""
    half = F.floor(F.length(value) / 2).cast("int")
    begin = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))

    def moved(half: Column, other: Column, r: Column) -> Column:
        return F.array_join(F.transform(F.split(half, ""), lambda c, i: _shifted(c, _number(key, label, r, i, other))), "")

    def step(a: Column, r: Column) -> Column:
        left = r % 2 == 0
        return F.struct(F.when(left, moved(a["l"], a["r"], r)).otherwise(a["l"]).alias("l"), F.when(left, a["r"]).otherwise(moved(a["r"], a["l"], r)).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), begin, step, lambda a: F.concat(a["l"], a["r"]))


def permuted_pair(x: Column, y: Column, a: int, b: int, key: str, label: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the pairs below (a, b), as a struct (x, y)."""
    begin = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))

    def step(s: Column, r: Column) -> Column:
        left = r % 2 == 0
        return F.struct(F.when(left, F.pmod(s["x"] + _number(key, label, r, s["y"]), F.lit(a))).otherwise(s["x"]).alias("x"),
                        F.when(left, s["y"]).otherwise(F.pmod(s["y"] + _number(key, label, r, s["x"]), F.lit(b))).alias("y"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), begin, step)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in order."""
    begin = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    return F.aggregate(F.split(value, ""), begin, lambda a, c: F.when(
        c.rlike("^[0-9]$"), F.struct((a["at"] + 1).alias("at"), F.concat(a["out"], F.substring(digits, a["at"], F.lit(1))).alias("out"))).otherwise(
        F.struct(a["at"].alias("at"), F.concat(a["out"], c).alias("out"))), lambda a: a["out"])


def _luhn(payload: Column) -> Column:
    """The check digit of a payload."""
    doubled = F.zip_with(F.split(F.reverse(payload), ""), F.sequence(F.lit(0), F.length(payload) - 1), lambda c, i: F.struct((c.cast("int") * (F.lit(2) - i % 2)).alias("d")))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x["d"] - F.when(x["d"] > 9, 9).otherwise(0))
    return F.pmod(-total, F.lit(10)).cast("string")


def _remainder97(account: Column) -> Column:
    """Remainder of an account number, country and check digits moved to the end and letters read as two digits."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _valid_account(account: Column) -> Column:
    return F.length(account).between(15, 34) & (_remainder97(account) == 1)


def _account_head(match: Column) -> Column:
    """The longest valid account number that a match begins with and that ends at a blank or with it; '' if there is none."""
    tokens = F.split(match, " ")
    heads = F.transform(F.sequence(F.size(tokens), F.lit(1)), lambda n: F.array_join(F.slice(tokens, F.lit(1), n), " "))
    valid = F.filter(heads, lambda h: h.rlike(f"^(?:{FORMS['iban']})$") & _valid_account(F.regexp_replace(h, " ", "")))
    return F.coalesce(F.try_element_at(valid, F.lit(1)), F.lit(""))


def _pieces(text: Column, form: str) -> Column:
    """``text`` as an array of (gap, match), in order; the last match is NULL."""
    return F.zip_with(F.split(text, form, -1), F.regexp_extract_all(text, F.lit(form), F.lit(0)), lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))


def _parted(piece: Column) -> Column:
    """A (gap, match) as an array of them: a match of the form of account numbers is its valid head and the other forms behind it."""
    parted = lambda head: F.concat(F.array(F.struct(piece["gap"].alias("gap"), head.alias("match"))), _pieces(F.substring(piece["match"], F.length(head) + 1, F.length(piece["match"])), NOT_IBAN))
    return F.when(piece["match"].rlike(f"^(?:{FORMS['iban']})$"), _bound(_account_head(piece["match"]), parted)).otherwise(F.array(piece))


def _day_first(value: Column) -> Column:
    """Whether a date with slashes can only be day/month: its first number is no month."""
    return (F.substring(value, 3, 1) == "/") & (F.substring(value, 1, 2).cast("int") > 12)


def _date_parts(value: Column) -> Column:
    def part(iso: int, us: int, eu: int, n: int) -> Column:
        at = F.when(F.substring(value, 5, 1) == "-", iso).when((F.substring(value, 3, 1) == "/") & ~_day_first(value), us).otherwise(eu)
        return F.substring(value, at, F.lit(n)).cast("int")

    return F.struct(part(1, 7, 7, 4).alias("y"), part(6, 1, 4, 2).alias("m"), part(9, 4, 1, 2).alias("d"))


def _valid_date(value: Column) -> Column:
    def fine(p: Column) -> Column:
        leap = (p["y"] % 4 == 0) & ((p["y"] % 100 != 0) | (p["y"] % 400 == 0))
        longest = F.when(p["m"] == 2, F.when(leap, 29).otherwise(28)).when(p["m"].isin(4, 6, 9, 11), 30).otherwise(31)
        return p["y"].between(*YEARS) & p["m"].between(1, 12) & (p["d"] >= 1) & (p["d"] <= longest)

    return _bound(_date_parts(value), fine)


def _moved_date(value: Column, key: str) -> Column:
    a, b = DATE_MODULI
    day = _bound(_date_parts(value), lambda p: F.datediff(F.make_date(p["y"], p["m"], p["d"]), F.lit(_FIRST_DAY).cast("date")))
    once = lambda v: _bound(permuted_pair(F.floor(v / b), v % b, a, b, key, "date"), lambda s: s["x"] * b + s["y"])
    day_first = _day_first(value)
    outside = lambda v: (v >= _DAYS) | (day_first & (F.dayofmonth(F.date_add(F.lit(_FIRST_DAY).cast("date"), v.cast("int"))) <= 12))
    # Days beyond the last are walked on from until one lies inside: 1 in 600 each time, so the bound is never met. Dates
    # that are day/month stay among those that can only be read so, which keeps the map one to one: 2 in 5 are walked on from.
    steps = F.sequence(F.lit(1), F.when(day_first, _WALK_DAY_FIRST).otherwise(_WALK))
    moved = F.aggregate(steps, day.cast("long") + 2 * _DAYS, lambda v, i: F.when(i == 1, once(v - 2 * _DAYS)).when(outside(v), once(v)).otherwise(v))
    shape = F.when(F.substring(value, 5, 1) == "-", "yyyy-MM-dd").when(day_first, "dd/MM/yyyy").when(F.substring(value, 3, 1) == "/", "MM/dd/yyyy").otherwise("dd.MM.yyyy")
    at = F.date_add(F.lit(_FIRST_DAY).cast("date"), moved.cast("int"))
    return F.when(shape == "yyyy-MM-dd", F.date_format(at, "yyyy-MM-dd")).when(shape == "MM/dd/yyyy", F.date_format(at, "MM/dd/yyyy")).when(shape == "dd/MM/yyyy", F.date_format(at, "dd/MM/yyyy")).otherwise(F.date_format(at, "dd.MM.yyyy"))


def kind_of(value: Column) -> Column:
    """Kind of a match, NULL if it is not valid as one."""
    digits = _digits(value)
    is_form = lambda name: value.rlike(f"^(?:{FORMS[name]})$")
    account = F.regexp_replace(value, " ", "")
    valid = {
        "email": F.lit(True),
        "iban": _valid_account(account),
        "card": F.right(digits, F.lit(1)) == _luhn(F.substring(digits, F.lit(1), F.length(digits) - 1)),
        "ssn": ~digits.rlike("^(000|666|9)") & ~digits.rlike("^...00") & ~digits.rlike("0000$"),
        "date": _valid_date(value),
        "ip": F.lit(True),
        "phone": F.length(digits).between(8, 15),
    }
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in FORMS:
        out = out.when(is_form(name), F.when(valid[name], F.lit(name)))
    return out


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a valid match of that kind; any other value stays."""
    digits = _digits(value)
    local = F.substring_index(value, "@", 1)
    email = F.concat(permuted_text(local, key, "email"), F.lit("@"), F.substring_index(value, "@", -1))

    def account(plain: Column) -> Column:
        own = F.concat(F.substring(plain, 1, 2), F.lit("00"), _refilled(F.substring(plain, F.lit(5), F.length(plain)), permuted_text(_digits(F.substring(plain, F.lit(5), F.length(plain))), key, "iban")))
        return _bound(own, lambda o: F.concat(F.substring(o, 1, 2), F.lpad((F.lit(98) - _remainder97(o)).cast("string"), 2, "0"), F.substring(o, F.lit(5), F.length(o))))

    card = _bound(permuted_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card"), lambda p: F.concat(p, _luhn(p)))
    area = F.substring(digits, 1, 3).cast("int")
    rest = (F.substring(digits, 4, 2).cast("int") - 1) * 9999 + F.substring(digits, 6, 4).cast("int") - 1
    ssn = _bound(permuted_pair(area - 1 - F.when(area > 666, 1).otherwise(0), rest, 898, 99 * 9999, key, "ssn"), lambda s: F.concat_ws(
        "-", F.lpad((s["x"] + 1 + F.when(s["x"] >= 665, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((F.floor(s["y"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["y"] % 9999 + 1).cast("string"), 4, "0")))
    octet = lambda n: F.split(value, r"\.")[n].cast("int")
    ip = _bound(permuted_pair(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), 65536, 65536, key, "ip"), lambda s: F.concat_ws(
        ".", F.floor(s["x"] / 256).cast("string"), (s["x"] % 256).cast("string"), F.floor(s["y"] / 256).cast("string"), (s["y"] % 256).cast("string")))
    kept = F.when(F.length(digits) > 10, F.length(digits) - 10).when(F.length(digits) == 10, 0).otherwise(1)
    phone = _refilled(value, F.concat(F.substring(digits, F.lit(1), kept), permuted_text(F.substring(digits, kept + 1, F.length(digits)), key, "phone")))
    iban = _bound(F.regexp_replace(value, " ", ""), account)
    iban = _bound(iban, lambda plain: F.aggregate(F.split(value, ""), F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), lambda a, c: F.when(
        c == " ", F.struct(a["at"].alias("at"), F.concat(a["out"], c).alias("out"))).otherwise(
        F.struct((a["at"] + 1).alias("at"), F.concat(a["out"], F.substring(plain, a["at"], F.lit(1))).alias("out"))), lambda a: a["out"]))
    return F.when(kind == "email", email).when(kind == "iban", iban).when(kind == "card", _refilled(value, card)).when(kind == "ssn", ssn).when(
        kind == "date", _moved_date(value, key)).when(kind == "ip", ip).when(kind == "phone", phone).otherwise(value)


def pseudonymized(docs: DataFrame, key: str, text_column: str = "text", kinds_column: str = "pii_kinds") -> DataFrame:
    """``docs`` with the personal data of a text replaced, and a column with the kinds replaced, in order.

    ``key`` should come from a store of secrets; without it pseudonyms can't be traced back, with it they can. A NULL
    text stays NULL with no kinds; texts without valid matches stay as they are. Every column of ``docs`` is kept;
    ``kinds_column`` may be renamed where it clashes. Texts of any length are read whole, repeated rows come out equal.
    """
    text = F.col(text_column)
    pieces = F.when(text.rlike("[0-9@]"), F.flatten(F.transform(_pieces(text, ANY_FORM), _parted)))
    made = F.transform(pieces, lambda p: _bound(kind_of(p["match"]), lambda k: F.struct(k.alias("kind"), F.concat(p["gap"], F.coalesce(pseudonym(p["match"], k, key), F.lit(""))).alias("value"))))
    named = "_pii_found"
    while named in docs.columns:
        named = "_" + named
    found = F.col(named)
    joined = F.array_join(F.transform(found, lambda x: x["value"]), "")
    kinds = F.transform(F.filter(found, lambda x: x["kind"].isNotNull()), lambda x: x["kind"])
    return docs.withColumn(named, made).withColumn(kinds_column, F.coalesce(kinds, F.array().cast("array<string>"))).withColumn(
        text_column, F.when(F.size(found) > 0, joined).otherwise(text)).drop(named)
