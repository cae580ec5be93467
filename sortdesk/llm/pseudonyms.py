"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame operations only.

Every value that passes its check is replaced by another of its format, by a keyed Feistel
permutation: two halves take turns in shifting each other by a keyed hash, each symbol within
its own alphabet. So the map is one to one within a format and layout, needs no table, and equal values
become equal pseudonyms in all documents and on all executors.

Formats and checks: payment cards (13 to 19 digits, single blanks or hyphens between, Luhn; the
last digit is computed anew, so pseudonyms pass Luhn too), account numbers (IBAN in capitals, single
blanks or hyphens between, remainder 1 modulo 97; country kept, check digits computed anew), French
social security numbers (NIR of 15 digits, or with 2A or 2B, key modulo 97; sex, year, month,
department, commune and order permuted within their ranges, other departments than 01 to 95 kept),
phone numbers with a country code or a bracketed area code (digits permuted, the country code
kept), in the national forms 0d dd dd dd dd and ddd-ddd-dddd, US social security numbers (ddd-dd-dddd
with a valid area, group and serial), IPv4 addresses (octets up to 255), IPv6 addresses written out
in eight groups, calendar dates (yyyy-mm-dd, yyyy/mm/dd, dd/mm/yyyy, mm/dd/yyyy, dd.mm.yyyy, slashed
ones also without leading zeros; days are permuted within 36,525-day centuries counted from
1930-01-01, so pseudonyms are calendar dates of the same layout), mailboxes (the part before @;
letters stay letters, digits digits, the domain stays) and hexadecimal secrets of 32 to 64
characters in one case. What fails its check stays as it is.

Every repeated group of the patterns has an upper bound (a domain has 126 labels at most), so a run
of any length takes a bounded stack and bounded steps for each place in the text.

Defined results. Null text: null, no values. Values that touch letters or digits are not values,
but for dates before T and a time.
Repeated rows: equal results. Texts are taken whole. An empty table gives no rows. All columns
are kept; added columns get underscores while the input has columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import free_name

ROUNDS = 8
_CENTURY, _LEFT, _RIGHT = 36525, 75, 487
_EPOCH = "1930-01-01"

CARD = r"\d(?:[ -]?\d){12,18}"
IBAN = r"[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?"
NIR = r"[12] ?\d{2} ?\d{2} ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3} ?\d{2}"
PHONE = (r"(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}(?:[ .-]?\d{1,4}){3,5}"
         r"|0[1-9](?:[ .-]?\d{2}){4}|\d{3}[.-]\d{3}[.-]\d{4}")
SSN = r"\d{3}-\d{2}-\d{4}"
IPV4 = r"\d{1,3}(?:\.\d{1,3}){3}"
IPV6 = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}"
DATE = r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{2}\.\d{2}\.\d{4}"
MAILBOX = (r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9-]{1,63}\.){1,126}"
           r"[A-Za-z]{2,24}")
SECRET = r"[0-9a-f]{32,64}|[0-9A-F]{32,64}"
#: A date may be followed by T and a time.
_TIME = r"(?=T\d{2}(?::?\d{2}|Z?(?![A-Za-z0-9])))"
VALUE = (rf"(?<![A-Za-z0-9+@._%-]){MAILBOX}(?![A-Za-z0-9@])"
         rf"|(?<![A-Za-z0-9.+-])(?:{DATE}){_TIME}"
         rf"|(?<![A-Za-z0-9.+:-]){IPV6}(?![A-Za-z0-9:-])"
         rf"|(?<![A-Za-z0-9.+-])(?:{DATE}|{IPV4}|{SSN}|{NIR}|{CARD}|{IBAN}|{PHONE}|{SECRET})"
         r"(?![A-Za-z0-9-]|[./]\d)"
         rf"|(?<![A-Za-z0-9.-])(?:{PHONE})(?![A-Za-z0-9-]|[./]\d)")


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _keyed(key: str, parts: list[Column]) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 512)


def _number(digest: Column, at: Column | int, size: int) -> Column:
    start = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.substring(digest, start, F.lit(size)), 16, 10).cast("long")


def permute_symbols(symbols: Column, radix: Column, key: str, tweak: Column) -> Column:
    """Feistel network on arrays: symbols[i] moves within 0 .. radix[i] - 1."""
    def network(whole: Column) -> Column:
        half = F.floor(F.size(whole["s"]) / 2).cast("int")
        size = F.size(whole["s"])

        def turn(state: Column, round_no: Column) -> Column:
            on_left = round_no % 2 == 0
            fixed = F.when(on_left, F.slice(state, half + 1, size)).otherwise(
                F.slice(state, F.lit(1), half))
            digest = _keyed(key, [whole["tweak"], round_no.cast("string"), size.cast("string"),
                                  F.array_join(fixed, ",")])

            def shifted(drawn: Column) -> Column:
                def shift(x: Column, i: Column) -> Column:
                    moved = (x + _number(drawn, 1 + 4 * (i % 32), 4)) % F.get(whole["radix"], i)
                    return F.when((i < half) == on_left, moved.cast("int")).otherwise(x)
                return F.transform(state, shift)
            return _let(digest, shifted)

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), whole["s"], turn)

    return _let(F.struct(symbols.cast("array<int>").alias("s"), radix.alias("radix"),
                         tweak.alias("tweak")), network)


DIGITS = "0123456789"
HEXADECIMAL = "0123456789abcdef"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def _permuted_in(text: Column, alphabet: str, key: str, tweak: str) -> Column:
    """text over one alphabet, permuted."""
    def moved(symbols: Column) -> Column:
        radix = F.transform(symbols, lambda _: F.lit(len(alphabet)))
        return F.array_join(F.transform(permute_symbols(symbols, radix, key, F.lit(tweak)),
                                        lambda i: F.substring(F.lit(alphabet), i + 1, F.lit(1))), "")
    return _let(F.transform(F.split(text, ""), lambda c: F.position(c, F.lit(alphabet)) - 1), moved)


def _digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _into_places(text: Column, new: Column, kind: str = "[0-9]") -> Column:
    """text with its characters of a kind replaced by those of new, one after the other."""
    def placed(both: Column) -> Column:
        done = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

        def step(a: Column, c: Column) -> Column:
            hit = c.rlike(f"^{kind}$")
            return F.struct(
                F.concat(a["out"], F.when(hit, F.substring(both["new"], a["n"] + 1, F.lit(1))).otherwise(c))
                .alias("out"), F.when(hit, a["n"] + 1).otherwise(a["n"]).alias("n"))
        return F.aggregate(F.split(both["text"], ""), done, step, lambda a: a["out"])
    return _let(F.struct(text.alias("text"), new.alias("new")), placed)


def luhn_digit(payload: Column) -> Column:
    """The check digit that makes payload + digit pass Luhn."""
    doubled = F.transform(F.split(F.reverse(payload), ""), lambda c, i: F.when(
        i % 2 == 0, F.pmod(2 * c.cast("int"), F.lit(10)) + F.floor(2 * c.cast("int") / 10)
    ).otherwise(c.cast("int")).cast("int"))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def _payload(text: Column) -> Column:
    digits = _digits_only(text)
    return F.substring(digits, F.lit(1), F.length(digits) - 1)


def is_card(text: Column) -> Column:
    digits = _digits_only(text)
    return text.rlike(f"^(?:{CARD})$") & (
        F.substring(digits, F.length(digits), F.lit(1)) == luhn_digit(_payload(text)))


def card(text: Column, key: str) -> Column:
    payload = _permuted_in(_payload(text), DIGITS, key, "card")
    return _into_places(text, _let(payload, lambda p: F.concat(p, luhn_digit(p))))


def phone(text: Column, key: str) -> Column:
    """Digits after the country code."""
    code = F.regexp_extract(text, r"^(\+\d{1,3}(?=[^\d]))?", 0)
    rest = F.substring(text, F.length(code) + 1, F.length(text))
    return F.concat(code, _into_places(rest, _permuted_in(_digits_only(rest), DIGITS, key, "phone")))


def is_ssn(text: Column) -> Column:
    return text.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")


def ssn(text: Column, key: str) -> Column:
    """Serial and group as symbols from 1, the area as one number, so results stay valid."""
    area = F.substring(text, 1, 3).cast("int")
    area = F.when(area > 666, area - 2).otherwise(area - 1)   # 0 .. 897, without 000 and 666
    symbols = F.array(area, F.substring(text, 5, 2).cast("int") - 1,
                      F.substring(text, 8, 4).cast("int") - 1)

    def shown(moved: Column) -> Column:
        new = F.get(moved, 0)
        return F.format_string("%03d-%02d-%04d", F.when(new + 1 >= 666, new + 2).otherwise(new + 1),
                               F.get(moved, 1) + 1, F.get(moved, 2) + 1)
    return _let(permute_symbols(symbols, F.array(F.lit(898), F.lit(99), F.lit(9999)), key,
                                F.lit("ssn")), shown)


def is_ipv4(text: Column) -> Column:
    return text.rlike(f"^(?:{IPV4})$") & F.forall(
        F.split(text, r"\."), lambda o: o.rlike(r"^(?:0|[1-9]\d*)$") & (o.cast("int") < 256))


def ipv4(text: Column, key: str) -> Column:
    octets = F.transform(F.split(text, r"\."), lambda o: o.cast("int"))
    radix = F.transform(F.split(text, r"\."), lambda _: F.lit(256))
    return F.array_join(permute_symbols(octets, radix, key, F.lit("ipv4")).cast("array<string>"), ".")


def _moved_day(day: Column, key: str) -> Column:
    days = F.datediff(day, F.lit(_EPOCH).cast("date"))
    cycle, at = F.floor(days / _CENTURY).cast("int"), F.pmod(days, F.lit(_CENTURY))
    symbols = F.array(F.floor(at / _RIGHT).cast("int"), (at % _RIGHT).cast("int"))
    moved = permute_symbols(symbols, F.array(F.lit(_LEFT), F.lit(_RIGHT)), key,
                            F.concat(F.lit("date"), cycle.cast("string")))
    return _let(moved, lambda m: F.date_add(
        F.lit(_EPOCH).cast("date"), cycle * _CENTURY + F.get(m, 0) * _RIGHT + F.get(m, 1)))


def _fields(text: Column) -> Column:
    """<year, month, day as texts, whether the month comes first> of a date; of a slashed one, a
    second part over 12 settles mm/dd against dd/mm."""
    def named(parts: Column) -> Column:
        one, two, three = (F.get(parts, i) for i in range(3))
        year_first = F.length(one) == 4
        month_first = text.contains("/") & ~year_first & (two.cast("int") > 12)
        return F.struct(
            F.when(year_first, one).otherwise(three).alias("y"),
            F.when(month_first, one).otherwise(two).alias("m"),
            F.when(year_first, three).when(month_first, two).otherwise(one).alias("d"),
            month_first.alias("month_first"), year_first.alias("year_first"))
    return _let(F.split(text, r"[-/.]"), named)


def _day(fields: Column) -> Column:
    """Calendar day, or null."""
    return F.try_to_date(F.concat_ws("-", fields["y"], F.lpad(fields["m"], 2, "0"),
                                     F.lpad(fields["d"], 2, "0")), "yyyy-MM-dd")


def is_date(text: Column) -> Column:
    return text.rlike(f"^(?:{DATE})$") & F.coalesce(
        _let(_fields(text), lambda f: F.year(_day(f)).between(1700, 9800)), F.lit(False))


def date(text: Column, key: str) -> Column:
    """In the layout of text: month first where it was, leading zeros where it had them."""
    mark = F.regexp_extract(text, r"\D", 0)

    def shown(both: Column) -> Column:
        f = both["f"]
        width = F.when((F.length(f["m"]) < 2) | (F.length(f["d"]) < 2), 1).otherwise(2)
        pad = lambda x: F.when(
            (width == 2) & (x < 10), F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
        y = F.lpad(F.year(both["new"]).cast("string"), 4, "0")
        m, d = pad(F.month(both["new"])), pad(F.day(both["new"]))
        return F.when(f["year_first"], F.concat(y, mark, m, mark, d)).when(
            f["month_first"], F.concat(m, mark, d, mark, y)).otherwise(F.concat(d, mark, m, mark, y))
    return _let(_fields(text), lambda f: _let(
        F.struct(f.alias("f"), _moved_day(_day(f), key).alias("new")), shown))


def _same_kinds(text: Column, key: str, tweak: str) -> Column:
    """text with its letters and digits permuted, each within its own alphabet."""
    digit, letter = lambda c: c.rlike("^[0-9]$"), lambda c: c.rlike("^[A-Za-z]$")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        text, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")

    def permuted(chars: Column) -> Column:
        inner = F.transform(chars, lambda c: F.when(digit(c), F.position(c, F.lit(DIGITS)) - 1).when(
            letter(c), F.position(F.lower(c), F.lit(LOWER)) - 1).otherwise(F.lit(0)))
        radix = F.transform(chars, lambda c: F.when(digit(c), 10).when(letter(c), 26).otherwise(1))
        moved = permute_symbols(inner, radix, key, F.concat(F.lit(tweak), shape))
        shown = lambda c, x: F.when(digit(c), x.cast("string")).when(
            c.rlike("^[a-z]$"), F.substring(F.lit(LOWER), x + 1, F.lit(1))).when(
            c.rlike("^[A-Z]$"), F.substring(F.lit(LOWER.upper()), x + 1, F.lit(1))).otherwise(c)
        return F.array_join(F.zip_with(chars, moved, shown), "")
    return _let(F.split(text, ""), permuted)


def mailbox(text: Column, key: str) -> Column:
    """Letters and digits before @, each within its own alphabet."""
    return F.concat(_same_kinds(F.substring_index(text, "@", 1), key, "mailbox"), F.lit("@"),
                    F.substring_index(text, "@", -1))


def _modulo_97(text: Column) -> Column:
    """Of the number that digits, and letters as 10 to 35, form."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(
        c.rlike("^[0-9]$"), (a * 10 + c.cast("int")) % 97).otherwise(
        (a * 100 + F.ascii(c) - 55) % 97))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, "[ -]", "")


def is_iban(text: Column) -> Column:
    bare = _bare(text)
    return text.rlike(f"^(?:{IBAN})$") & F.length(bare).between(15, 34) & (_modulo_97(F.concat(
        F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1)


def iban(text: Column, key: str) -> Column:
    country = F.substring(text, 1, 2)

    def whole(account: Column) -> Column:
        check = F.lpad((98 - _modulo_97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(country, check, account)
    account = F.substring(_bare(text), F.lit(5), F.length(text))
    return _into_places(text, _let(_same_kinds(account, key, "iban"), whole), "[A-Z0-9]")


def _nir_key(bare: Column) -> Column:
    """The two digits after the first 13; 2A and 2B count as 19 and 18."""
    number = F.regexp_replace(F.regexp_replace(F.substring(bare, 1, 13), "2A", "19"), "2B", "18")
    return F.lpad((97 - _modulo_97(number)).cast("string"), 2, "0")


def is_nir(text: Column) -> Column:
    bare = _bare(text)
    return text.rlike(f"^(?:{NIR})$") & bare.rlike(
        r"^[12]\d{2}(?:0[1-9]|1[0-2])(?:\d{2}|2[AB])(?!000)\d{3}(?!000)\d{3}\d{2}$") & (
        F.substring(bare, 14, 2) == _nir_key(bare))


def nir(text: Column, key: str) -> Column:
    def moved(bare: Column) -> Column:
        place = F.substring(bare, 6, 2)
        inland = place.rlike("^(?:0[1-9]|[1-8][0-9]|9[0-5])$")
        at = lambda start, n: F.substring(bare, start, n).cast("int")
        symbols = F.array(at(1, 1) - 1, at(2, 2), at(4, 2) - 1,
                          F.when(inland, place.try_cast("int") - 1).otherwise(0),
                          at(8, 3) - 1, at(11, 3) - 1)
        radix = F.array(F.lit(2), F.lit(100), F.lit(12), F.when(inland, 95).otherwise(1), F.lit(999),
                        F.lit(999))
        new = permute_symbols(symbols, radix, key, F.concat(
            F.lit("nir"), F.when(inland, "").otherwise(place)))
        return _let(new, lambda x: F.concat(
            F.format_string("%d%02d%02d", F.get(x, 0) + 1, F.get(x, 1), F.get(x, 2) + 1),
            F.when(inland, F.format_string("%02d", F.get(x, 3) + 1)).otherwise(place),
            F.format_string("%03d%03d", F.get(x, 4) + 1, F.get(x, 5) + 1)))
    new = _let(_let(_bare(text), moved), lambda x: F.concat(x, _nir_key(x)))
    return _into_places(text, new, "[0-9AB]")


def ipv6(text: Column, key: str) -> Column:
    """Hexadecimal digits; groups keep their lengths, and the address its case."""
    moved = _permuted_in(F.lower(F.replace(text, F.lit(":"))), HEXADECIMAL, key, "ipv6")
    upper = text.rlike("[A-F]")
    return _let(_into_places(text, moved, "[0-9A-Fa-f]"),
                lambda out: F.when(upper, F.upper(out)).otherwise(out))


def national_phone(text: Column, key: str) -> Column:
    """0d dd dd dd dd: the 0 stays, the next digit is none."""
    digits = F.slice(F.split(_digits_only(text), ""), F.lit(2), F.lit(9))
    symbols = F.transform(digits, lambda c, i: F.when(i == 0, c.cast("int") - 1).otherwise(c.cast("int")))
    radix = F.transform(digits, lambda _, i: F.when(i == 0, 9).otherwise(10))
    moved = permute_symbols(symbols, radix, key, F.lit("national"))
    new = F.transform(moved, lambda x, i: F.when(i == 0, x + 1).otherwise(x).cast("string"))
    return _into_places(text, F.concat(F.lit("0"), F.array_join(new, "")))


def secret(text: Column, key: str) -> Column:
    upper = text.rlike("[A-F]")
    return _let(_permuted_in(F.lower(text), HEXADECIMAL, key, "secret"),
                lambda out: F.when(upper, F.upper(out)).otherwise(out))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value; null where it fails its check."""
    return (F.when(value.contains("@"), mailbox(value, key))
            .when(value.contains(":"), ipv6(value, key))
            .when(value.rlike("^(?=.*[a-fA-F])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})$"), secret(value, key))
            .when(value.rlike("^[A-Z]"), F.when(is_iban(value), iban(value, key)))
            .when(is_date(value), date(value, key))
            .when(is_ipv4(value), ipv4(value, key))
            .when(is_ssn(value), ssn(value, key))
            .when(is_nir(value), nir(value, key))
            .when(is_card(value), card(value, key))
            .when(value.rlike(r"^0[1-9](?:[ .-]?\d{2}){4}$"), national_phone(value, key))
            .when(value.rlike(f"^(?:{PHONE})$"), phone(value, key)))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text",
                 result: str = "pseudonyms") -> DataFrame:
    """docs with pseudonyms in its text, and a column <n_found, n_replaced> beside.

    The text is cut at the found values, and gaps and replaced values are joined again, so no
    replacement is ever read a second time.
    """
    result = free_name(docs, result)
    found, gaps, new = (free_name(docs, n) for n in ("_found", "_gaps", "_new"))
    text = F.col(f"`{text_col}`")
    # most texts hold no digit and no @: they skip the patterns
    some = text.rlike(r"\d|@")
    out = docs.withColumn(found, F.when(some, F.regexp_extract_all(text, F.lit(f"({VALUE})"), F.lit(1)))
                          .otherwise(F.array().cast("array<string>")))
    out = out.withColumn(gaps, F.when(F.size(found) > 0, F.split(text, VALUE, -1)))
    out = out.withColumn(new, F.transform(found, lambda v: pseudonym(v, key)))
    joined = F.concat(F.array_join(F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)),
        F.zip_with(new, found, lambda n, v: F.coalesce(n, v)), lambda g, v: F.concat(g, v)), ""),
        F.element_at(gaps, -1))
    counts = F.struct(F.coalesce(F.size(found), F.lit(0)).cast("long").alias("n_found"),
                      F.coalesce(F.size(F.filter(new, lambda n: n.isNotNull())), F.lit(0))
                      .cast("long").alias("n_replaced"))
    columns = [F.when(F.size(found) > 0, joined).otherwise(text).alias(c) if c == text_col
               else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, counts.alias(result))
