import datetime
import hashlib
import random
import re

from corpus_cases import awkward, nothing

from probita.llm import pii
from probita.llm.queries import QUERIES


def check_digit(payload):
    total = 0
    for at, c in enumerate(reversed(payload)):
        d = int(c) * (2 - at % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def values():
    some = random.Random(1)
    out = [("card", p + check_digit(p)) for p in ("".join(some.choices("0123456789", k=15)) for _ in range(60))]
    out += [("date", str(datetime.date(1900, 1, 1) + datetime.timedelta(some.randrange(73049)))) for _ in range(60)]
    out += [("card", "4111 1111 1111 1111"), ("card", "378282246310005"), ("ssn", "123-45-6789"), ("ssn", "899-99-9999"), ("ssn", "001-01-0001"), ("ssn", "667-01-0001"),
            ("date", "2020-02-29"), ("date", "12/31/1999"), ("date", "31.12.1999"), ("ip", "10.0.0.1"), ("ip", "255.255.255.255"), ("phone", "+1 (017) 555-7713"),
            ("phone", "555-123-4567"), ("phone", "+49 30 1234567"), ("iban", "DE89370400440532013000"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("email", "a.bc@x.org")]
    return out


NOT_VALID = ["4111111111111112", "2021-02-29", "666-12-3456", "1.2.3.4.5", "DE88370400440532013000", "12345", "99/99/2020", "a@b"]


def shape(value):
    return re.sub("[0-9]", "9", re.sub("[A-Z]", "X", re.sub("[a-z]", "x", value)))


def test_formats_validity_links_and_permutation(spark):
    rows = [(i, f"Foo {v}, bar {v}.") for i, (_, v) in enumerate(values())]
    got = {r.doc_id: r for r in pii.pseudonymized(awkward(spark, rows), "key").collect()}
    new = {}
    for i, (kind, value) in enumerate(values()):
        made = re.fullmatch(r"Foo (.*), bar (.*)\.", got[i].text)
        assert made[1] == made[2] != value and got[i].pii_kinds == [kind, kind]
        assert kind == "ip" or shape(made[1]) == shape(value)
        new.setdefault((kind, shape(value)), {}).setdefault(value, made[1])
    assert all(len(set(m.values())) == len(m) for m in new.values())
    again = pii.pseudonymized(awkward(spark, [(i, r.text) for i, r in got.items()]), "key").collect()
    assert {r.doc_id: r.pii_kinds for r in again} == {i: r.pii_kinds for i, r in got.items()}  # still valid
    other = {r.doc_id: r.text for r in pii.pseudonymized(awkward(spark, rows), "other key").collect()}
    assert sum(other[i] != got[i].text for i in got) > 0.95 * len(got)


def test_what_is_not_valid_stays(spark):
    rows = [(i, f"a {v} b") for i, v in enumerate(NOT_VALID)]
    assert {r.doc_id: (r.text, r.pii_kinds) for r in pii.pseudonymized(awkward(spark, rows), "key").collect()} == {i: (t, []) for i, t in rows}


def test_all_of_a_small_domain_is_permuted(spark):
    rows = spark.range(1000).selectExpr("id", "lpad(cast(id as string), 3, '0') as v", "cast(id div 40 as int) as x", "cast(id % 40 as int) as y")
    assert rows.select(pii.permuted_text(pii.F.col("v"), "k", "t").alias("p")).distinct().where("p rlike '^[0-9]{3}$'").count() == 1000
    assert rows.select(pii.permuted_pair(pii.F.col("x"), pii.F.col("y"), 25, 40, "k", "t").alias("p")).distinct().where("p.x between 0 and 24 and p.y between 0 and 39").count() == 1000


def test_query_over_all_documents(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op10_pseudonyms"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        old = texts[r.doc_id]
        cards = [c for c in re.findall(r"(?<![0-9A-Za-z])[0-9]{16}(?![0-9A-Za-z])", old) if check_digit(c[:-1]) == c[-1]]
        mails = re.findall(r"[a-zß-ÿ]+\.[0-9]{2}@mail[0-9]\.example\.com", old)
        assert r.n_card == len(cards) and not any(c in r.text for c in cards + mails)
        if not sum(getattr(r, f"n_{k}") for k in pii.FORMS):
            assert r.text == old


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = pii.pseudonymized(docs, "key")
    assert got.columns == [*docs.columns, "pii_kinds"] and sorted(map(str, got.drop("pii_kinds").collect())) == sorted(map(str, docs.collect()))
    assert pii.pseudonymized(nothing(spark), "key").count() == 0


def test_accounts_before_other_words_and_dates_by_day(spark):
    account, card = "ES9121000418450200051332", "4111 1111 1111 1111"
    rows = [(1, f"{account} 5 May"), (2, f"{account} 2024"), (3, f"pay {account} {card} now"), (4, f"AB12 {card}"), (5, "on 25/12/2020."), (6, "on 12/11/2020."),
            (7, "on 30/02/2020, 13/13/2020."), (8, "BE68 5390 0754 7034 12 EUR"), (9, "ZZ57123412341234 2024")]
    got = {r.doc_id: r for r in pii.pseudonymized(awkward(spark, rows), "key").collect()}
    assert {i: r.pii_kinds for i, r in got.items()} == {
        1: ["iban"], 2: ["iban"], 3: ["iban", "card"], 4: ["card"], 5: ["date"], 6: ["date"], 7: [], 8: ["iban"], 9: ["iban"]}
    assert all(account not in r.text and card not in r.text for r in got.values())
    assert got[1].text.endswith(" 5 May") and got[2].text.endswith(" 2024") and got[8].text.endswith(" 12 EUR") and got[7].text == rows[6][1]
    assert got[1].text[:24] == got[2].text[:24] == got[3].text[4:28]
    assert all(pii_remainder(got[i].text[:n].replace(" ", "")) == 1 for i, n in ((1, 24), (2, 24), (8, 19)))


def pii_remainder(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def test_dates_by_day_are_permuted_among_themselves(spark):
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(n) for n in range(0, 366, 2)]
    values = [d.strftime("%d/%m/%Y") for d in days if d.day > 12] + [d.strftime("%m/%d/%Y") for d in days]
    got = [r.text for r in pii.pseudonymized(awkward(spark, list(enumerate(values))), "key").orderBy("doc_id").collect()]
    assert len(set(got)) == len(got)
    assert all((int(a[:2]) > 12) == (int(b[:2]) > 12) for a, b in zip(values, got, strict=True))
    assert all(datetime.datetime.strptime(b, "%d/%m/%Y" if int(b[:2]) > 12 else "%m/%d/%Y") for b in got)


class Plain:
    """The same networks, a value at a time."""

    def __init__(self, key):
        self.key = key

    def number(self, label, *parts):
        inner = hashlib.sha256("|".join([self.key, label, *map(str, parts)]).encode()).hexdigest()
        return int(hashlib.sha256((self.key + inner).encode()).hexdigest()[:11], 16)

    def text(self, value, label):
        halves = [value[:len(value) // 2], value[len(value) // 2:]]
        for r in range(pii.ROUNDS):
            other, out = halves[1 - r % 2], ""
            for i, c in enumerate(halves[r % 2]):
                first, n = (48, 10) if c in "0123456789" else (97, 26) if "a" <= c <= "z" else (65, 26)
                out += chr(first + (ord(c) - first + self.number(label, r, i, other)) % n) if c.isascii() and c.isalnum() else c
            halves[r % 2] = out
        return "".join(halves)

    def pair(self, x, y, a, b, label):
        for r in range(pii.ROUNDS):
            if r % 2 == 0:
                x = (x + self.number(label, r, y)) % a
            else:
                y = (y + self.number(label, r, x)) % b
        return x, y

    def date(self, value):
        shape = "%Y-%m-%d" if value[4] == "-" else "%d.%m.%Y" if value[2] == "." else "%d/%m/%Y" if int(value[:2]) > 12 else "%m/%d/%Y"
        first, (a, b) = datetime.date(1900, 1, 1), pii.DATE_MODULI
        v = (datetime.datetime.strptime(value, shape).date() - first).days
        while True:
            x, y = self.pair(v // b, v % b, a, b, "date")
            v = x * b + y
            if v < 73049 and (shape != "%d/%m/%Y" or (first + datetime.timedelta(v)).day > 12):
                return (first + datetime.timedelta(v)).strftime(shape)

    def of(self, kind, value):
        digits = "".join(c for c in value if c.isdigit())
        fill = lambda new, old=value: "".join((next(it) if c.isdigit() else c) for it in [iter(new)] for c in old)
        if kind == "email":
            local, host = value.split("@")
            return f"{self.text(local, 'email')}@{host}"
        if kind == "card":
            payload = self.text(digits[:-1], "card")
            return fill(payload + check_digit(payload))
        if kind == "ssn":
            area = int(digits[:3])
            x, y = self.pair(area - 1 - (area > 666), (int(digits[3:5]) - 1) * 9999 + int(digits[5:]) - 1, 898, 99 * 9999, "ssn")
            return f"{x + 1 + (x >= 665):03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"
        if kind == "ip":
            o = [int(n) for n in value.split(".")]
            x, y = self.pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
            return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
        if kind == "phone":
            kept = len(digits) - 10 if len(digits) >= 10 else 1
            return fill(digits[:kept] + self.text(digits[kept:], "phone"))
        if kind == "iban":
            plain = value.replace(" ", "")
            rest = fill(self.text("".join(c for c in plain[4:] if c.isdigit()), "iban"), plain[4:])
            turned = int("".join(str(int(c, 36)) for c in rest + plain[:2] + "00"))
            made = iter(plain[:2] + f"{98 - turned % 97:02d}" + rest)
            return "".join(c if c == " " else next(made) for c in value)
        return self.date(value)


def test_pseudonyms_against_plain_networks(spark):
    more = [("date", "25/12/2020"), ("date", "31/01/1900"), ("ssn", "665-12-0001"), ("phone", "(555) 123-4567"), ("iban", "NO9386011117947"), ("email", "A-z.9@mail.example.com")]
    wanted = [*values(), *more]
    got = {r.doc_id: r for r in pii.pseudonymized(awkward(spark, [(i, f"see {v} now") for i, (_, v) in enumerate(wanted)]), "some key").collect()}
    plain = Plain("some key")
    assert {i: (r.text, r.pii_kinds) for i, r in got.items()} == {i: (f"see {plain.of(k, v)} now", [k]) for i, (k, v) in enumerate(wanted)}
