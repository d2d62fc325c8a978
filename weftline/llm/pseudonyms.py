"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Numbers and dates are looked for by pattern and validated: card numbers by
their check digit, account numbers by theirs, addresses and dates by their
ranges. What is valid is replaced by another value of the same format, under a
keyed permutation: a Feistel network over two numbers, Z_a x Z_b, whose rounds
add a keyed hash of the one to the other. It is a bijection of the format's
whole range, so equal values stay equal in all documents and different ones
stay different. E-mail addresses and secrets have no such range; they get keyed
digests in their format.

A text is cut at its matches (``split`` and ``regexp_extract_all`` with one
pattern), the matches are rewritten, and the parts are joined again.
"""

from __future__ import annotations

import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fresh_name

ROUNDS = 8
# Formats of personal data.
EMAIL = r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}"
HEX_SECRET = r"(?i:token|secret|password|passwd|api_?key|access_?key)\s{0,2}[=:]\s{0,2}[\"']?[0-9a-fA-F]{12,128}(?![0-9a-zA-Z])"
#: Any value after such a word that has a letter and a digit.
SECRET = r"(?i:token|secret|password|passwd|api_?key|access_?key)\s{0,2}[=:]\s{0,2}[\"']?(?=[^\s\"'<>,;]{0,127}[0-9])(?=[^\s\"'<>,;]{0,127}[A-Za-z])[A-Za-z0-9_./+=!#$%^&*~-]{7,127}[A-Za-z0-9_=+/-](?![0-9a-zA-Z])"
CLOUD_KEY = r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
#: Account numbers' lengths by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_STATED = f"(?:{'|'.join(' '.join(IBAN_LENGTHS.values()).split())})[0-9]{{2}}"


def _account(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{{groups}}}" + (f" ?[0-9A-Z]{{{rest}}}" if rest else "")


#: Of the country's length; of any where the country isn't listed.
IBAN = rf"(?<![0-9A-Za-z])(?:{'|'.join(_account(*x) for x in IBAN_LENGTHS.items())}|(?!{_STATED})[A-Z]{{2}}[0-9]{{2}}(?: ?(?!{_STATED})[0-9A-Z]{{4}}){{2,7}}(?: ?[0-9A-Z]{{1,3}})?)(?![0-9A-Za-z])"
#: Not after a word that a version number follows.
IP = r"(?<![0-9.vV])(?<!(?:ersion|elease) )[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
#: Eight groups, or fewer around a double colon; at least three and one digit, so no names of programs.
IPV6 = r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{0,38}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[0-9A-Fa-f]{1,4}:{1,2}){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:]))[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})(?![0-9A-Za-z:])"
ISO_DATE = r"(?<![0-9])[0-9]{4}(?:[-/][0-9]{2}[-/][0-9]{2}(?![0-9])|\.[0-9]{2}\.[0-9]{2}(?![0-9]|\.[0-9]))"
SHORT_DATE = r"(?<![0-9./-])(?:[0-9]{2}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{2})(?![0-9]|[./-][0-9])"
DAY_DATE = r"(?<![0-9])[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])(?:1[-. ])?[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9-])"
#: National numbers: with a leading 0, or three groups of 3, 3 and 4 digits; not within longer rows of numbers.
LOCAL_PHONE = r"(?<![0-9.,/-])(?<![0-9][ -])(?:\(0[0-9]{1,4}\) ?[0-9]{3,8}(?:[ -][0-9]{2,5}){0,3}|0[1-9](?:[ .-][0-9]{2}){4}|0[1-9][0-9]{1,3}[ /-][0-9]{3,8}(?:[ -][0-9]{2,5}){0,2}|[2-9][0-9]{2} [0-9]{3} [0-9]{4})(?![0-9]|[ -][0-9]|[.,][0-9])"
#: A whole run of groups of digits, up to a value of another kind; cards are looked for inside.
CARD = rf"(?<![0-9.])[0-9](?:[0-9]|[ -](?!{IP}|{ISO_DATE}|{DAY_DATE}|{SSN}|{PHONE})[0-9]){{12,}}+"
#: How digits are printed on cards; among stretches that overlap these come first, and common lengths before others.
CARD_SHAPES = r"^(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}(?: [0-9]{1,3})?|[0-9]{4} [0-9]{6} [0-9]{4,5})$"
CARD_LENGTHS = (16, 15, 19, 14, 13, 18, 17)
KINDS = {
    "email": EMAIL, "hex_secret": HEX_SECRET, "secret": SECRET, "cloud_key": CLOUD_KEY, "iban": IBAN, "ipv6": IPV6, "ip": IP, "iso_date": ISO_DATE, "day_date": DAY_DATE, "ssn": SSN, "phone": PHONE, "card": CARD, "short_date": SHORT_DATE, "local_phone": LOCAL_PHONE,
}
ANY = "|".join(KINDS.values())
#: Texts without any of these hold nothing to look for.
HINT = r"[0-9@]|(?i:token|secret|passw|key)"
#: A whole cycle of the calendar: 400 years, 146,097 = 189 * 773 days.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
#: The century of years of two digits, 36,525 = 25 * 1461 days.
SHORT_FIRST, SHORT_DAYS = "2000-01-01", (25, 1461)
#: Steps to a date of the same reading. A fifth of all dates has it, whichever it is, so all steps miss with odds of 10 ** -25; that would be an error.
WALK = 256
#: What derived keys look like in plans, for Spark's redaction settings.
KEY_MARK, KEY_PATTERN = "weftkey-", "weftkey-[0-9a-f]{64}"


def derived(key: str) -> str:
    """The key that the plan carries: a digest from which the owner's key can't be had back."""
    return KEY_MARK + hmac.new(key.encode(), b"pseudonyms", "sha256").hexdigest()


def _draw(key: str, kind: str, step: Column, value: Column, size) -> Column:
    """A keyed number below ``size`` that depends on the round and on the other half."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), value.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), size)


def feistel(left: Column, right: Column, a, b, key: str, kind: str) -> Column:
    """The permuted pair (l, r) of left < a and right < b."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def turn(pair: Column, step: Column) -> Column:
        even = step % 2 == 0
        return F.struct(
            F.when(even, (pair["l"] + _draw(key, kind, step, pair["r"], a)) % a).otherwise(pair["l"]).alias("l"),
            F.when(even, pair["r"]).otherwise((pair["r"] + _draw(key, kind, step, pair["l"], b)) % b).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A permutation of the digit strings of each length from 2 to 36; shorter and longer ones stay."""
    n = F.length(digits)
    half = (n / 2).cast("int")
    powers = F.array(*(F.lit(10**i).cast("long") for i in range(19)))
    size = lambda k: F.element_at(powers, k + 1)
    pair = feistel(F.substr(digits, F.lit(1), half), F.substr(digits, half + 1, n - half), size(half), size(n - half), key, kind)
    joined = F.transform(F.array(pair), lambda p: F.concat(F.lpad(p["l"].cast("string"), half, F.lit("0")), F.lpad(p["r"].cast("string"), n - half, F.lit("0"))))
    return F.when((n < 2) | (n > 36), digits).otherwise(F.element_at(joined, 1))


def _refill(text: Column, digits: Column) -> Column:
    """The text with its digits, in turn, replaced by others of the same number."""
    return F.array_join(F.zip_with(F.split(text, "[0-9]", -1), F.split(digits, ""), lambda x, d: F.concat(x, F.coalesce(d, F.lit("")))), "")


def _luhn_sum(digits: Column) -> Column:
    """The check sum over a digit string whose last digit counts twice, as all digits but the check digit do from the right."""
    n = F.length(digits)
    doubled = F.transform(F.split(digits, ""), lambda d, i: F.when((n - 1 - i) % 2 == 0, F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _valid_card(d: Column) -> Column:
    payload = F.substr(d, F.lit(1), F.length(d) - 1)
    return d.rlike("^(.).*(?!\\1).") & (F.pmod(10 - F.pmod(_luhn_sum(payload), F.lit(10)), F.lit(10)) == F.substring(d, -1, 1).cast("int"))


def _fresh_card(d: Column, key: str) -> Column:
    fresh = F.concat(F.substring(d, 1, 1), permute_digits(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
    return _let(fresh, lambda p: F.concat(p, F.pmod(10 - F.pmod(_luhn_sum(p), F.lit(10)), F.lit(10)).cast("string")))


def _cards(m: Column, key: str) -> Column:
    """(new, n): the text with each valid stretch of 13 to 19 digits between group boundaries replaced, and their number; null where there is none."""

    def stretches(groups: Column, i: Column) -> Column:
        """(n, d, shaped) of the valid stretches of n groups from the i-th on, best first."""
        counts = F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - i + 1))
        each = F.transform(counts, lambda n: F.struct(n.alias("n"), F.array_join(F.slice(groups, i, n), "").alias("d"), F.array_join(F.slice(groups, i, n), " ").rlike(CARD_SHAPES).alias("shaped")))
        valid = F.filter(F.filter(each, lambda x: x["d"].rlike("^[0-9]{13,19}$")), lambda x: _valid_card(x["d"]))
        rank = F.transform(valid, lambda x: F.struct((~x["shaped"]).alias("other"), F.array_position(F.array(*map(F.lit, CARD_LENGTHS)), F.length(x["d"])).alias("place"), x["n"].alias("n"), x["d"].alias("d")))
        return F.array_sort(rank)

    def scan(groups: Column, found: Column) -> Column:
        """Left to right; a stretch of another shape gives way to a shaped one that begins inside it."""

        def turn(at: Column, i: Column) -> Column:
            free = F.filter(F.element_at(found, i), lambda x: ~x["other"] | ~F.exists(F.slice(found, i + 1, x["n"] - 1), lambda later: F.exists(later, lambda y: ~y["other"])))

            def step(best: Column) -> Column:
                hit, gone = best.isNotNull(), i < at["next"]
                return F.struct(
                    F.when(gone, at["next"]).when(hit, i + best["n"]).otherwise(i + 1).alias("next"),
                    F.when(gone, at["text"]).when(hit, F.concat(at["text"], _fresh_card(best["d"], key))).otherwise(F.concat(at["text"], _digits(F.element_at(groups, i)))).alias("text"),
                    F.when(~gone & hit, at["n"] + 1).otherwise(at["n"]).alias("n"),
                )

            return _let(F.get(free, F.lit(0)), step)

        start = F.struct(F.lit(1).alias("next"), F.lit("").alias("text"), F.lit(0).alias("n"))
        return F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, turn)

    def renew(groups: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda i: stretches(groups, i))
        return _let(found, lambda f: _let(scan(groups, f), lambda x: F.when(x["n"] > 0, F.struct(_refill(m, x["text"]).alias("new"), x["n"].alias("n")))))

    return _let(F.split(m, "[ -]"), renew)


def _mod97(text: Column) -> Column:
    """A string of digits and capitals, letters counting 10 to 35, modulo 97."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: (s * F.when(c.rlike("[0-9]"), F.lit(10)).otherwise(F.lit(100)) + F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)) % 97)


def _iban(m: Column, key: str) -> Column:
    def renew(plain: Column) -> Column:
        country, account = F.substring(plain, 1, 2), F.substr(plain, F.lit(5), F.length(plain) - 4)
        valid = _mod97(F.concat(account, country, F.substring(plain, 3, 2))) == 1
        fresh = _refill(account, permute_digits(_digits(account), key, "iban"))
        checked = _let(fresh, lambda a: F.concat(F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), _digits(a)))
        return F.when(valid, checked)

    return _let(F.regexp_replace(m, " ", ""), lambda p: _let(renew(p), lambda d: F.when(d.isNotNull(), _refill(m, d))))


def _ip(m: Column, key: str) -> Column:
    def renew(o: Column) -> Column:
        octet = lambda i: F.element_at(o, i).cast("int")
        valid = F.forall(o, lambda x: (x.cast("int") < 256) & ~x.rlike("^0[0-9]"))
        pair = feistel(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), 65536, 65536, key, "ip")
        dotted = _let(pair, lambda p: F.concat_ws(".", *(x.cast("long").cast("string") for x in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256))))
        return F.when(valid, dotted)

    return _let(F.split(m, "\\."), renew)


def _reading(m: Column, forms: Column, first: str, days: tuple[int, int]) -> Column:
    """The first of the formats in which the text, exactly, writes a date of the cycle; null where none does."""
    start = F.lit(first).cast("date")

    def writes(form: Column) -> Column:
        date = F.call_function("try_to_date", m, form)
        return (F.call_function("date_format", date, form) == m) & F.datediff(date, start).between(0, days[0] * days[1] - 1)

    return F.get(F.filter(forms, lambda f: F.coalesce(writes(f), F.lit(False))), F.lit(0))


def _date(m: Column, formats: list[str], key: str, first: str = FIRST_DAY, days: tuple[int, int] = DAYS) -> Column:
    """Another date in the format that the text reads in.

    A text has one reading, the first that fits. The permutation of all dates
    is applied again until the new text has the same reading, so it permutes
    the texts of each reading and no two readings share an output.
    """
    start, forms, kind = F.lit(first).cast("date"), F.array(*map(F.lit, formats)), "date" if first == FIRST_DAY else "short date"

    def renewed(form: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            pair = feistel(F.floor(at["d"] / days[1]), at["d"] % days[1], *days, key, kind)
            after = _let(pair, lambda p: (p["l"] * days[1] + p["r"]).cast("int"))
            moved = _let(after, lambda d: _let(F.call_function("date_format", F.date_add(start, d), form), lambda t: F.struct(d.alias("d"), F.when(_reading(t, forms, first, days) == form, t).alias("text"))))
            return F.when(at["text"].isNotNull(), at).otherwise(moved)

        begin = F.struct(F.datediff(F.call_function("try_to_date", m, form), start).alias("d"), F.lit(None).cast("string").alias("text"))
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), begin, step)
        return _let(walked["text"], lambda t: F.coalesce(t, F.raise_error(F.lit("no date of the same reading in reach")).cast("string")))

    return _let(_reading(m, forms, first, days), lambda f: F.when(f.isNotNull(), renewed(f)))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-665 and 667-899, groups 01-99, serials 0001-9999."""

    def renew(p: Column) -> Column:
        area, group, serial = (F.element_at(p, i).cast("int") for i in (1, 2, 3))
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        index = F.when(area > 666, area - 2).otherwise(area - 1)
        pair = feistel(index * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")

        def write(x: Column) -> Column:
            i = F.floor(x["l"] / 99)
            pad = lambda n, w: F.lpad(n.cast("long").cast("string"), w, "0")
            return F.concat_ws("-", pad(F.when(i >= 665, i + 2).otherwise(i + 1), 3), pad(x["l"] % 99 + 1, 2), pad(x["r"] + 1, 4))

        return F.when(valid, _let(pair, write))

    return _let(F.split(m, "-"), renew)


def _phone(m: Column, key: str) -> Column:
    """The country code, or the 0 or 1 before the area's, stays; all other digits are permuted together."""

    def renew(d: Column) -> Column:
        code = F.length(F.regexp_extract(m, r"^\+([0-9]{1,3})(?=[ .(-])", 1)) + F.length(F.regexp_extract(m, r"^\(?(0|1(?=[-. ][0-9]{3}[-.]))", 1))
        rest = F.substr(d, code + 1, F.length(d) - code)
        valid = (F.length(d) >= 7) & (F.length(d) <= 15)
        return F.when(valid, F.concat(F.substr(d, F.lit(1), code), permute_digits(rest, key, "phone")))

    return _let(_digits(m), lambda d: _let(renew(d), lambda x: F.when(x.isNotNull(), _refill(m, x))))


def _digest(m: Column, key: str, kind: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), m), 256)


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(_digest(F.lower(m), key, "email"), 1, 16), F.lit("@example.invalid"))


def _ipv6(m: Column, key: str) -> Column:
    """An address of the private range by a digest of the whole one, so it is the same however zeros are left out; null where there are too many groups."""

    def renew(halves: Column) -> Column:
        groups = lambda i: F.filter(F.split(F.lower(F.element_at(halves, i)), ":"), lambda g: g != "")
        right = F.when(F.size(halves) > 1, groups(-1)).otherwise(F.array().cast("array<string>"))
        gap = 8 - F.size(groups(1)) - F.size(right)
        whole = F.transform(F.concat(groups(1), F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right), lambda g: F.lpad(g, 4, "0"))
        fresh = lambda d: F.concat_ws(":", F.concat(F.lit("fd"), F.substring(d, 1, 2)), *(F.substring(d, 4 * k - 1, 4) for k in range(1, 8)))
        return F.when(F.when(F.size(halves) > 1, gap > 0).otherwise(gap == 0), _let(_digest(F.array_join(whole, ":"), key, "ipv6"), fresh))

    return _let(F.split(m, "::"), renew)


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"""[=:]\s{0,2}["']?(\S+)$""", 1)
    kept = F.substr(m, F.lit(1), F.length(m) - F.length(value))
    return F.concat(kept, F.substr(F.repeat(_digest(value, key, "secret"), 2), F.lit(1), F.length(value)))


def _cloud_key(m: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), F.translate(F.substring(_digest(m, key, "cloud"), 1, 16), "0123456789abcdef", "ABCDEFGHJKLMNPQR"))


def replacement(m: Column, key: str) -> Column:
    """(new, n): what stands for one match, and how many values it held; null where none is valid and it stays."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    iso = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd"]
    short = ["dd.MM.yy", "dd/MM/yy", "MM/dd/yy"]
    day = ["dd.MM.yyyy", "d.M.yyyy", "dd.M.yyyy", "d.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy", "d/M/yyyy", "M/d/yyyy", "dd/M/yyyy", "d/MM/yyyy", "M/dd/yyyy", "MM/d/yyyy"]
    single = (
        F.when(whole(EMAIL), _email(m, key))
        .when(whole(HEX_SECRET) | whole(SECRET), _secret(m, key))
        .when(whole(CLOUD_KEY), _cloud_key(m, key))
        .when(whole(IBAN), _iban(m, key))
        .when(whole(IPV6), _ipv6(m, key))
        .when(whole(IP), _ip(m, key))
        .when(whole(ISO_DATE), _date(m, iso, key))
        .when(whole(DAY_DATE), _date(m, day, key))
        .when(whole(SSN), _ssn(m, key))
        .when(whole(SHORT_DATE), _date(m, short, key, SHORT_FIRST, SHORT_DAYS))
        .when(whole(PHONE) | whole(LOCAL_PHONE), _phone(m, key))
    )
    # an account number that fails its check may hold a card
    digits = F.when(~whole(EMAIL) & (whole(CARD) | whole(IBAN)), _cards(m, key))
    return _let(single, lambda x: F.when(x.isNotNull(), F.struct(x.alias("new"), F.lit(1).alias("n"))).otherwise(digits))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_private") -> DataFrame:
    """The documents with the personal data of ``text_col`` replaced, and how many values were.

    A null text stays null, with none; an empty one stays empty; repeated rows have the same result, and an
    empty table none. ``key`` is a secret of the owner: the
    same key gives the same pseudonyms. Texts are never split, so length and
    repetition of rows make no difference.

    The plan, and so event logs and the UI, hold a digest derived from the key,
    never the key. The digest is enough to compute pseudonyms; clusters whose
    plans others read set ``spark.sql.redaction.string.regex`` and
    ``spark.redaction.string.regex`` to ``KEY_PATTERN``, which hides it there.
    """
    key = derived(key)
    text = F.col(text_col)
    look = text.rlike(HINT)
    found = F.when(look, F.regexp_extract_all(text, F.lit(ANY), 0))
    matches = fresh_name(docs, "_found")
    work = docs.withColumn(matches, F.transform(found, lambda m: F.struct(m.alias("m"), replacement(m, key).alias("by"))))
    parts = F.zip_with(F.split(text, ANY, -1), F.col(matches), lambda p, x: F.concat(p, F.coalesce(x["by"]["new"], x["m"], F.lit(""))))
    fresh = F.when(F.size(matches) > 0, F.array_join(parts, "")).otherwise(text)
    names = [c for c in docs.columns if c.lower() != (count_col or "").lower()]
    out = [fresh.alias(c) if c == text_col else F.col(c) for c in names]
    if count_col:
        out.append(F.coalesce(F.aggregate(matches, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x["by"]["n"], F.lit(0))), F.lit(0).cast("long")).alias(count_col))
    return work.select(*out)
