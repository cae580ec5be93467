"""Pseudonyms of every format against a plain version, and long runs of each pattern."""

import datetime
import hashlib
import re

from edge import documents
from pyspark.sql import functions as F

from sortdesk.llm import pseudonyms as P
from sortdesk.llm.queries import PSEUDONYM_KEY, QUERIES

KEY = "k"


# --- a plain version -----------------------------------------------------------------------
def feistel(symbols, radix, tweak, key=KEY):
    x, half = list(symbols), len(symbols) // 2
    for turn in range(8):
        left = turn % 2 == 0
        fixed = x[half:] if left else x[:half]
        digest = hashlib.sha512("|".join(
            [key, tweak, str(turn), str(len(x)), ",".join(map(str, fixed))]).encode()).hexdigest()
        for i in range(half) if left else range(half, len(x)):
            at = 4 * (i % 32)
            x[i] = (x[i] + int(digest[at:at + 4], 16)) % radix[i]
    return x


def fill(text, new, kind="[0-9]"):
    rest = iter(new)
    return re.sub(kind, lambda _: next(rest), text)


def same_kinds(text, tweak):
    number = lambda c: int(c) if c.isdigit() else ord(c.lower()) - 97 if c.isalpha() else 0
    radix = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in text]
    shape = re.sub("[0-9]", "0", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", text)))
    moved = feistel([number(c) for c in text], radix, tweak + shape)
    letter = lambda c, x: chr(x + (65 if c.isupper() else 97))
    return "".join(str(x) if c.isdigit() else letter(c, x) if c.isalpha() else c
                   for c, x in zip(text, moved))


def in_alphabet(text, alphabet, tweak):
    moved = feistel([alphabet.index(c) for c in text], [len(alphabet)] * len(text), tweak)
    return "".join(alphabet[x] for x in moved)


def modulo_97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def luhn_digit(payload):
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c)
                for i, c in enumerate(reversed(payload)))
    return str((10 - total % 10) % 10)


def card(text):
    payload = in_alphabet(re.sub(r"\D", "", text)[:-1], "0123456789", "card")
    return fill(text, payload + luhn_digit(payload))


def iban(text):
    bare = re.sub("[ -]", "", text)
    account = same_kinds(bare[4:], "iban")
    return fill(text, f"{bare[:2]}{98 - modulo_97(account + bare[:2] + '00'):02d}{account}", "[A-Z0-9]")


def nir_key(bare):
    return f"{97 - int(bare[:13].replace('2A', '19').replace('2B', '18')) % 97:02d}"


def nir(text):
    b = text.replace(" ", "")
    inland = b[5:7].isdigit() and 1 <= int(b[5:7]) <= 95
    x = feistel([int(b[0]) - 1, int(b[1:3]), int(b[3:5]) - 1, int(b[5:7]) - 1 if inland else 0,
                 int(b[7:10]) - 1, int(b[10:13]) - 1],
                [2, 100, 12, 95 if inland else 1, 999, 999], "nir" + ("" if inland else b[5:7]))
    place = f"{x[3] + 1:02d}" if inland else b[5:7]
    new = f"{x[0] + 1}{x[1]:02d}{x[2] + 1:02d}{place}{x[4] + 1:03d}{x[5] + 1:03d}"
    return fill(text, new + nir_key(new), "[0-9AB]")


def moved_day(day):
    start = datetime.date(1930, 1, 1)
    cycle, at = divmod((day - start).days, 36525)
    a, b = feistel([at // 487, at % 487], [75, 487], f"date{cycle}")
    return start + datetime.timedelta(cycle * 36525 + a * 487 + b)


def national(text):
    digits = [int(c) for c in re.sub(r"\D", "", text)]
    x = feistel([digits[1] - 1, *digits[2:]], [9] + [10] * 8, "national")
    return fill(text, "0" + str(x[0] + 1) + "".join(map(str, x[1:])))


def ssn(text):
    a = int(text[:3])
    x = feistel([a - 2 if a > 666 else a - 1, int(text[4:6]) - 1, int(text[7:]) - 1], [898, 99, 9999], "ssn")
    return f"{x[0] + 2 if x[0] + 1 >= 666 else x[0] + 1:03d}-{x[1] + 1:02d}-{x[2] + 1:04d}"


def ipv6(text):
    new = fill(text, in_alphabet(text.replace(":", "").lower(), "0123456789abcdef", "ipv6"), "[0-9A-Fa-f]")
    return new.upper() if re.search("[A-F]", text) else new


PLAIN = {
    "4785380592391139": card, "4785-3805-9239-1139": card,
    "FR7630006000011234567890189": iban, "DE89 3704 0044 0532 0130 00": iban,
    "GB82WEST12345698765432": iban, "GB82-WEST-1234-5698-7654-32": iban,
    "1 85 05 78 006 084 91": nir, "185057800608491": nir, "2 99 12 2A 123 456 88": nir,
    "06 12 34 56 78": national, "0612345678": national, "01.99.00.11.22": national,
    "555-123-4567": lambda v: fill(v, in_alphabet("5551234567", "0123456789", "phone")),
    "+1 743 555 3824": lambda v: "+1" + fill(v[2:], in_alphabet("7435553824", "0123456789", "phone")),
    "123-45-6789": ssn, "899-01-0001": ssn,
    "70.23.22.57": lambda v: ".".join(map(str, feistel([70, 23, 22, 57], [256] * 4, "ipv4"))),
    "2001:db8:85a3:0:0:8a2e:370:7334": ipv6, "2001:0DB8:85A3:0000:0000:8A2E:0370:7334": ipv6,
    "2024-01-31": lambda v: moved_day(datetime.date(2024, 1, 31)).isoformat(),
    "2024/01/31": lambda v: f"{moved_day(datetime.date(2024, 1, 31)):%Y/%m/%d}",
    "1/2/2024": lambda v: "{0.day}/{0.month}/{0.year}".format(moved_day(datetime.date(2024, 2, 1))),
    "2/13/2024": lambda v: "{0.month}/{0.day}/{0.year}".format(moved_day(datetime.date(2024, 2, 13))),
    "31/12/1999": lambda v: f"{moved_day(datetime.date(1999, 12, 31)):%d/%m/%Y}",
    "12/31/1999": lambda v: f"{moved_day(datetime.date(1999, 12, 31)):%m/%d/%Y}",
    "01.02.2003": lambda v: f"{moved_day(datetime.date(2003, 2, 1)):%d.%m.%Y}",
    "a.b-C9@mail5.example.com": lambda v: same_kinds("a.b-C9", "mailbox") + "@mail5.example.com",
    "24be64439e3e49cf46b2d7c90f3602a3d0b907ff": lambda v: in_alphabet(v, "0123456789abcdef", "secret"),
    "24BE64439E3E49CF46B2D7C90F3602A3D0B907FF": lambda v: in_alphabet(
        v.lower(), "0123456789abcdef", "secret").upper(),
}
KEPT = ["FR7630006000011234567890188", "DE89 3704 0044 0532 0130 01", "1 85 05 78 006 084 92",
        "2 99 12 2A 123 456 89", "4785380592391138", "185137800608491", "2024/02/30", "31/13/2024",
        "12:34:56:78:9a:bc", "000-12-1234", "999.1.1.1"]


def valid(value, new):
    if PLAIN[value] is iban:
        bare = re.sub("[ -]", "", new)
        return modulo_97(bare[4:] + bare[:4]) == 1 and bare[:2] == value[:2]
    if PLAIN[value] is nir:
        return nir_key(new.replace(" ", "")) == new.replace(" ", "")[13:]
    return True


def key_of(nir_number):
    return nir_key(nir_number.replace(" ", ""))


def test_the_fixtures_pass_their_checks():
    assert key_of("1 85 05 78 006 084") == "91" and key_of("2 99 12 2A 123 456") == "88"
    assert modulo_97("30006000011234567890189FR76") == modulo_97("WEST12345698765432GB82") == 1


def test_every_format_matches_the_plain_version(spark):
    rows = [(i, f"say {v}, or ({v}) and {v}") for i, v in enumerate(PLAIN)]
    rows += [(100 + i, f"say {v}, or ({v}) and {v}") for i, v in enumerate(KEPT)]
    got = {r.doc_id: r for r in P.pseudonymise(documents(spark, rows, extra=False), KEY).collect()}
    for i, (v, plain) in enumerate(PLAIN.items()):
        new = plain(v)
        assert got[i].text == f"say {new}, or ({new}) and {new}", v
        assert got[i].pseudonyms.n_replaced == 3 and valid(v, new)
    for i, v in enumerate(KEPT):
        assert got[100 + i].text == rows[len(PLAIN) + i][1] and got[100 + i].pseudonyms.n_replaced == 0, v


def test_registered_query_against_the_plain_version(spark, tmp_path, monkeypatch):
    texts = [(i, f"{v} then {v}") for i, v in enumerate(PLAIN)] + [(99, None), (98, "nothing 12")]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op5_feistel_pseudonyms"](spark, str(tmp_path)).collect()}
    monkeypatch.setitem(globals(), "KEY", PSEUDONYM_KEY)
    monkeypatch.setattr(feistel, "__defaults__", (PSEUDONYM_KEY,))
    for i, (v, plain) in enumerate(PLAIN.items()):
        assert (got[i].text, got[i].n_found, got[i].n_replaced) == (f"{plain(v)} then {plain(v)}", 2, 2)
    assert (got[99].text, got[99].n_found) == (None, 0) and got[98].text == "nothing 12"


def test_new_formats_are_one_to_one(spark):
    numbers = spark.range(2000).select(F.format_string("1850578%06d", F.col("id") + 1001).alias("n"))
    nirs = numbers.select(F.concat("n", P._nir_key(F.col("n"))).alias("v")).where(P.is_nir(F.col("v")))
    phones = spark.range(3000).select(F.format_string("0%d", F.lit(612340000) + F.col("id")).alias("v"))
    for rows in (nirs, phones):
        moved = rows.select(P.pseudonym(F.col("v"), KEY).alias("p"))
        assert rows.count() > 1000 and moved.distinct().count() == rows.count()
    assert nirs.where(~P.is_nir(P.pseudonym(F.col("v"), KEY))).count() == 0


RUNS = {
    "labels": "x@" + "a." * 500_000 + "com", "labels again": ("x@" + "a." * 2000 + "com ") * 250,
    "local parts": "a." * 500_000 + "@b.example", "boxes": "a@b.cc" * 170_000, "ats": "@" * 1_000_000,
    "digits": "1" * 1_000_000, "spaced digits": "1 " * 500_000, "hyphens": "12-" * 330_000,
    "dotted digits": "1." * 500_000, "slashed digits": "1/" * 500_000, "groups": "1234 " * 200_000,
    "hexadecimal": "a1" * 500_000, "groups of capitals": "AB12 " * 200_000, "colons": "a:" * 500_000,
    "plus": "+1 " * 330_000, "brackets": "(123) " * 160_000, "short": "x@" + "a." * 2000 + "com",
}


def test_runs_of_a_megabyte(spark):
    """Neither the stack nor the time of a pattern follows the length of a run."""
    rows = [(i, t) for i, text in enumerate(RUNS.values()) for t in (text, f"{text} b@c.example")]
    got = P.pseudonymise(documents(spark, rows, extra=False).repartition(8), KEY).select(
        "doc_id", F.length("text").alias("n")).collect()
    assert sorted((r.doc_id, r.n) for r in got) == sorted((i, len(t)) for i, t in rows)
