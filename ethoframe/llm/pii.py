"""Format-preserving pseudonyms for personal numbers, dates and addresses.

One pattern finds candidates; each is validated by its kind's own rule (check
digits, ranges, calendar) and, if valid, put through a keyed Feistel permutation of
the values of its format. Equal values get equal pseudonyms in all documents, unlike
values unlike ones, and a pseudonym is again a valid value that reads like the
original. A candidate that fails is cut at its spaces and hyphens: from the left, the
longest run of its groups that is valid in one of the usual groupings of any kind is
taken, but only cards and ibans where the whole is grouped like a card. What is left
stays. All of it is one projection of Spark functions: no shuffle, no join,
no table of values.

=========  ==========================================  =============================
kind       valid if                                    permuted
=========  ==========================================  =============================
email      name@domain.tld                             letters and digits of the name
iban       remainder of 97 is 1                        digits but the check digits
card       13-19 digits, Luhn                          digits but the check digit
ssn        area, group and serial in use               all valid (area, group, serial)
nanp       +1, 001, 1 or national, area, exchange      all valid numbers
           >= 200
phone      +, 00 or 0 and 7-15 digits                  digits after the country code
ip         four octets                                 all addresses
date       a day in the 104,976 from 1850-01-01        those days
=========  ==========================================  =============================

A date with slashes is day first; one that is none is month first, and such dates
are permuted among themselves. A phone number has one pseudonym in all its spellings:
after + or 00, with or without separators, and if it is nanp with or without its 1. The
country code is told by the list of codes and stays; national numbers of other countries
are not linked to their international form, as their country is not known.

Defined results: null text stays null and has none; equal rows get equal results;
other columns stay, but ``n_found`` and ``kinds`` are replaced.

The key is part of the query's plan: whoever sees plans or event logs can undo the
pseudonyms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, row_of

ROUNDS = 8
_FIRST_DAY, _SIDE = "1850-01-01", 324

#: Candidates, in the order in which they are tried at a place.
_EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_PHONE = r"(?<![0-9+])\+[0-9]{1,3}[ .\-]?\(?[0-9]{1,4}\)?(?:[ .\-]?[0-9]{2,4})+(?![0-9])"
_IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
_DATE = r"(?<![0-9./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/\-])"
_SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
_NANP = r"(?<![0-9+\-])(?:1[ .\-])?(?:\([0-9]{3}\) ?|[0-9]{3}[\-.])[0-9]{3}[\-.][0-9]{4}(?![0-9\-])"
_TRUNK = r"(?<![0-9.,/+\-])(?:00[1-9][0-9]{0,2}[ \-]\(?[0-9]{1,4}\)?(?:[ \-]?[0-9]{2,4}){2,}|\(?0[1-9][0-9]{1,4}(?:\) ?|[ /\-])[0-9]{3,8}(?:[ \-][0-9]{2,4})*)(?![0-9]|[.,/\-][0-9])"
_CARD = r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,}+"
PATTERN = "|".join((_EMAIL, _IBAN, _PHONE, _IP, _DATE, _SSN, _NANP, _TRUNK, _CARD))
_ANY = r"[0-9]{2}|@|[0-9]\.[0-9]"
#: Usual groupings of card numbers, by which parts of a longer candidate are told.
_GROUPED = r"^(?:[0-9]{13,19}|[2-9][0-9]{3}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|3[0-9]{3}([ \-])[0-9]{6}\2[0-9]{4,5})$"
# The country codes of one and of two digits; all others have three.
_CODES_1 = ("1", "7")
_CODES_2 = tuple("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Groups of the longest candidate that is written in groups: an IBAN of 34.
_MOST_GROUPS = 9


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: lambdas share no subexpressions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def feistel(key: str, kind: str, left: Column, right: Column, lefts: int, rights: int) -> Column:
    """Permutes pairs of numbers below ``lefts`` and ``rights``: a struct (a, b)."""

    def turn(s: Column, r: Column) -> Column:
        other = F.when(r % 2 == 0, s["b"]).otherwise(s["a"])
        f = _number(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), other.cast("string")), 256), 1, 15))
        a = F.when(r % 2 == 0, (s["a"] + f) % lefts).otherwise(s["a"])
        b = F.when(r % 2 == 0, s["b"]).otherwise((s["b"] + f) % rights)
        return F.struct(a.alias("a"), b.alias("b"))

    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def feistel_string(key: str, kind: str, value: Column) -> Column:
    """Permutes strings of one shape: each half in turn is moved, letter by letter
    and digit by digit within its case, by a hash of the other half."""
    half = F.floor(F.length(value) / 2).cast("int")

    def moved(text: Column, other: Column, r: Column) -> Column:
        hashed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), other), 256)

        def move(c: Column, i: Column) -> Column:
            # four hex digits a character: 16 characters a hash, then anew from its start
            by = _number(F.substr(hashed, F.pmod(i, F.lit(16)) * 4 + 1, F.lit(4)))
            at = F.ascii(c)

            def within(low: int, n: int) -> Column:
                return F.char(F.lit(low) + F.pmod(at - low + by, F.lit(n)))

            return (
                F.when(at.between(48, 57), within(48, 10)).when(at.between(65, 90), within(65, 26)).when(at.between(97, 122), within(97, 26)).otherwise(c)
            )

        return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), move), "")

    def turn(s: Column, r: Column) -> Column:
        a = F.when(r % 2 == 0, moved(s["a"], s["b"], r)).otherwise(s["a"])
        b = F.when(r % 2 == 0, s["b"]).otherwise(moved(s["b"], s["a"], r))
        return F.struct(a.alias("a"), b.alias("b"))

    start = F.struct(F.substr(value, F.lit(1), half).alias("a"), F.substr(value, half + 1, F.length(value)).alias("b"))
    s = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return F.concat(s["a"], s["b"])


def _refill(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced, in order, by those of ``digits``."""

    def put(s: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        return F.struct(
            F.concat(s["t"], F.when(is_digit, F.substr(digits, s["k"] + 1, F.lit(1))).otherwise(c)).alias("t"),
            F.when(is_digit, s["k"] + 1).otherwise(s["k"]).alias("k"),
        )

    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("t"), F.lit(0).alias("k")), put)["t"]


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of all digits, the last one counting once."""
    reversed_ = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    each = F.transform(reversed_, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def mod97(text: Column) -> Column:
    """The remainder of 97 of an IBAN's characters, letters counting from 10."""

    def add(a: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        return F.when(letter, (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _part(m: Column, i: int) -> Column:
    return F.regexp_extract(m, r"([0-9]+)[^0-9]+([0-9]+)[^0-9]+([0-9]+)(?:[^0-9]+([0-9]+))?", i).cast("int")


def _email(key: str, m: Column) -> tuple[Column, Column]:
    name = F.substring_index(m, "@", 1)
    return F.lit(True), F.concat(feistel_string(key, "email", name), F.substr(m, F.length(name) + 1, F.length(m)))


def _iban(key: str, m: Column) -> tuple[Column, Column]:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    valid = F.length(plain).between(15, 34) & (mod97(F.concat(F.substr(plain, F.lit(5), F.lit(40)), F.substr(plain, F.lit(1), F.lit(4)))) == 1)
    body = F.substr(plain, F.lit(5), F.lit(40))
    # only digits move, so that letters keep their place in the country's format
    new = _refill(body, feistel_string(key, "iban", _digits(body)))
    check = F.lpad((F.lit(98) - mod97(F.concat(new, F.substr(plain, F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), 2, "0")
    return valid, _refill(m, F.concat(check, _digits(new)))


def _card(key: str, m: Column) -> tuple[Column, Column]:
    digits = _digits(m)
    new = feistel_string(key, "card", F.substr(digits, F.lit(1), F.length(digits) - 1))
    check = F.pmod(F.lit(10) - luhn_sum(F.concat(new, F.lit("0"))) % 10, F.lit(10)).cast("string")
    return luhn_sum(digits) % 10 == 0, _refill(m, F.concat(new, check))


def _ssn(key: str, m: Column) -> tuple[Column, Column]:
    area, group, serial = _part(m, 1), _part(m, 2), _part(m, 3)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    # 898 areas, 99 groups, 9999 serials
    at = F.when(area > 666, area - 2).otherwise(area - 1)
    s = feistel(key, "ssn", at * 99 + group - 1, serial - 1, 898 * 99, 9999)
    new = F.floor(s["a"] / 99)
    return valid, F.format_string("%03d-%02d-%04d", F.when(new > 664, new + 2).otherwise(new + 1), s["a"] % 99 + 1, s["b"] + 1)


def _ten(key: str, ten: Column) -> tuple[Column, Column]:
    """A nanp number's ten digits: whether they are valid, and others."""
    area, exchange, line = (F.substr(ten, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (4, 3), (7, 4)))
    s = feistel(key, "nanp", (area - 200) * 800 + exchange - 200, line, 640_000, 10_000)
    new = F.format_string("%03d%03d%04d", F.floor(s["a"] / 800) + 200, s["a"] % 800 + 200, s["b"])
    return (area >= 200) & (exchange >= 200), new


def _nanp(key: str, m: Column) -> tuple[Column, Column]:
    digits = _digits(m)
    before = F.substr(digits, F.lit(1), F.length(digits) - 10)
    valid, new = _ten(key, F.substr(digits, F.length(digits) - 9, F.lit(10)))
    # +1, 001, 1 or nothing; eleven digits without a separator after the 1 are no number
    ours = (before == "") & ~m.startswith("+") | (before == "001") | (before == "1") & m.rlike(r"^\+|^1[^0-9]")
    return ours & valid, _refill(m, F.concat(before, new))


def _phone(key: str, m: Column) -> tuple[Column, Column]:
    zeros = F.when(m.startswith("00"), "00").otherwise("")
    digits = F.regexp_replace(_digits(m), "^00", "")
    short, long = F.substr(digits, F.lit(1), F.lit(1)), F.substr(digits, F.lit(1), F.lit(2))
    n = F.when(short.isin(*_CODES_1), 1).when(long.isin(*_CODES_2), 2).otherwise(3)
    new = feistel_string(key, "phone", F.substr(digits, n + 1, F.lit(20)))
    return F.length(digits).between(7, 15), _refill(m, F.concat(zeros, F.substr(digits, F.lit(1), n), new))


def _trunk(key: str, m: Column) -> tuple[Column, Column]:
    """A national number: the 0 and the digit after it stay."""
    digits = _digits(m)
    new = F.concat(F.substr(digits, F.lit(1), F.lit(2)), feistel_string(key, "trunk", F.substr(digits, F.lit(3), F.lit(20))))
    return F.length(digits).between(8, 14), _refill(m, new)


def _ip(key: str, m: Column) -> tuple[Column, Column]:
    octets = [_part(m, i) for i in range(1, 5)]
    s = feistel(key, "ip", octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65536, 65536)
    new = F.concat_ws(".", *[x.cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)])
    valid = m.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")
    for x in octets:
        valid = valid & (x <= 255)
    return valid, new


def _days(key: str, day: Column) -> Column:
    """The number of another day, one for each."""
    s = feistel(key, "date", F.floor(day / _SIDE), day % _SIDE, _SIDE, _SIDE)
    return _let(s, lambda x: x["a"] * _SIDE + x["b"])


def _date(key: str, m: Column) -> tuple[Column, Column]:
    """Year first, or day and month first; what is no date with the day first but one
    with the month first (12/31/1999) goes on until it is again such a date: all days
    but those up to the twelfth of a month."""
    first = F.lit(_FIRST_DAY).cast("date")
    forms = ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy")
    shapes = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$", r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$")

    def parsed(form: str, shape: str) -> Column:
        return F.when(m.rlike(shape), F.try_to_timestamp(m, F.lit(form)).cast("date"))

    tried = [parsed(form, shape) for form, shape in zip(forms, shapes)]
    plain = F.date_diff(F.coalesce(*tried), first)
    american = F.date_diff(parsed("MM/dd/yyyy", shapes[1]), first)

    def later(day: Column) -> Column:
        return F.dayofmonth(F.date_add(first, day.cast("int"))) > 12

    def on(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(_let(_days(key, s["day"]), lambda d: F.struct(d.alias("day"), later(d).alias("done"))))

    start = F.struct(american.cast("long").alias("day"), F.lit(False).alias("done"))
    # three days of five end it, so 64 steps are never all taken
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, on)["day"]
    inside = [F.coalesce(d.between(0, _SIDE * _SIDE - 1), F.lit(False)) for d in (plain, american)]
    out = F.when(inside[1], F.date_format(F.date_add(first, walked.cast("int")), "MM/dd/yyyy"))
    new = F.date_add(first, _days(key, plain.cast("long")).cast("int"))
    for form, own in zip(forms, tried):
        out = F.when(own.isNotNull(), F.date_format(new, form)).otherwise(out)
    return F.when(F.coalesce(*tried).isNotNull(), inside[0]).otherwise(inside[1]), out


#: Kinds in the order in which a candidate is tried, each with the shape it must have.
KINDS: dict[str, tuple[str, Callable]] = {
    "email": ("@", _email),
    "iban": ("^[A-Z]{2}[0-9]{2}", _iban),
    "ip": (r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$", _ip),
    "date": (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{2}([./])[0-9]{2}\1[0-9]{4}$", _date),
    "ssn": (r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", _ssn),
    "nanp": (r"^(?:(?:\+|00)?1[ .\-]?)?\(?[0-9]{3}\)?[ .\-]?[0-9]{3}[\-. ]?[0-9]{4}$", _nanp),
    "phone": (r"^(?:\+|00[1-9][0-9]{0,2}[ \-])[0-9 .()\-]+$", _phone),
    "trunk": (r"^\(?0[1-9][0-9]{1,4}(?:\) ?|[ /\-])[0-9 \-]+$", _trunk),
    "card": (r"^[0-9](?:[ \-]?[0-9]){12,18}$", _card),
}
#: The shapes that parts of a candidate must have.
_IN_PARTS = {
    "iban": r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "nanp": r"^(?:(?:\+|00)1[ \-]\(?[0-9]{3}\)?[ \-]?[0-9]{3}[ \-]?[0-9]{4}|(?:1[ \-])?(?:\([0-9]{3}\) |[0-9]{3}-)[0-9]{3}-[0-9]{4})$",
    "phone": r"^(?:\+[0-9]{1,3}[ \-]?\(?[0-9]{1,4}\)?(?:[ \-]?[0-9]{2,4}){1,4}|00[1-9][0-9]{0,2}[ \-]\(?[0-9]{1,4}\)?(?:[ \-]?[0-9]{2,4}){2,4})$",
    "trunk": r"^\(?0[1-9][0-9]{1,4}(?:\) |[ \-])[0-9]{3,8}(?:[ \-][0-9]{2,4}){0,3}$",
    "card": _GROUPED,
}


def _kind(key: str, m: Column, shapes: dict[str, str], cards_only: Column | None = None) -> Column:
    """The first kind of which a candidate is, or null; with ``cards_only`` true no
    other than card and iban."""
    out = None
    for kind, shape in shapes.items():
        hit = m.rlike(shape) & F.coalesce(KINDS[kind][1](key, m)[0], F.lit(False))
        if cards_only is not None and kind not in ("card", "iban"):
            hit = ~cards_only & hit
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def _new(key: str, kind: Column, m: Column) -> Column:
    """The pseudonym of a value of this kind; only that kind's is worked out."""
    out = None
    for k, (_, make) in KINDS.items():
        new = make(key, m)[1]
        out = F.when(kind == k, new) if out is None else out.when(kind == k, new)
    return out.otherwise(m)


def _told(kind: Column) -> Column:
    """A national number is a phone number too."""
    return F.when(kind == "trunk", "phone").otherwise(kind)


def _in_parts(key: str, m: Column) -> Column:
    """A candidate that isn't valid as a whole: struct (kinds, text)."""
    ends = F.regexp_extract_all(m, F.lit("([ \\-])"), F.lit(1))
    parts = F.zip_with(F.split(m, "[ \\-]"), ends, lambda g, e: F.concat(g, F.coalesce(e, F.lit(""))))
    none = F.array().cast("array<struct<g:int,h:int,kind:string,bare:string,end:string>>")

    def longest(parts: Column, g: Column) -> Column:
        """The longest valid span from group ``g`` on."""

        def span(h: Column) -> Column:
            whole = F.array_join(F.slice(parts, g + 1, h - g + 1), "")
            # the separator after it isn't part of it
            bare = F.regexp_replace(whole, "[ \\-]$", "")
            return _let(
                F.struct(bare.alias("bare"), F.substr(whole, F.length(bare) + 1, F.lit(1)).alias("end")),
                lambda x: F.struct(g.alias("g"), h.alias("h"), _kind(key, x["bare"], _IN_PARTS, m.rlike(_GROUPED)).alias("kind"), x["bare"].alias("bare"), x["end"].alias("end")),
            )

        to = F.least(F.size(parts) - 1, g + _MOST_GROUPS - 1)
        return F.get(F.filter(F.transform(F.sequence(to, g, F.lit(-1)), span), lambda x: x["kind"].isNotNull()), 0)

    def choose(s: Column, x: Column) -> Column:
        fits = x.isNotNull() & (x["g"] >= s["at"])
        return F.when(fits, F.struct((x["h"] + 1).alias("at"), F.array_append(s["taken"], x).alias("taken"))).otherwise(s)

    def shown(taken: Column, p: Column, i: Column) -> Column:
        over = F.filter(taken, lambda x: (x["g"] <= i) & (x["h"] >= i))
        return _let(F.get(over, 0), lambda x: F.when(x.isNull(), p).when(x["g"] == i, F.concat(_new(key, x["kind"], x["bare"]), x["end"])).otherwise(""))

    def with_taken(parts: Column, taken: Column) -> Column:
        text = F.array_join(F.transform(parts, lambda p, i: shown(taken, p, i)), "")
        return F.struct(F.transform(taken, lambda x: _told(x["kind"])).alias("kinds"), text.alias("text"))

    def with_parts(parts: Column) -> Column:
        taken = F.aggregate(F.transform(parts, lambda _, g: longest(parts, g)), F.struct(F.lit(0).alias("at"), none.alias("taken")), choose)["taken"]
        return _let(taken, lambda t: with_taken(parts, t))

    return _let(parts, with_parts)


def _found(key: str, m: Column) -> Column:
    """A candidate's struct (kinds, text)."""

    def settled(kind: Column) -> Column:
        whole = F.struct(F.array_compact(F.array(_told(kind))).alias("kinds"), _new(key, kind, m).alias("text"))
        cut = kind.isNull() & m.rlike("^[^@]*[ \\-][^@]*$")
        return F.when(cut, _in_parts(key, m)).otherwise(whole)

    return _let(_kind(key, m, {k: shape for k, (shape, _) in KINDS.items()}), settled)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, n_found and kinds (one for each)."""
    if not key:
        raise ValueError("a key is needed")
    body = F.col("_body")
    df = docs.select(row_of(docs), F.col(text).alias("_body"))
    df = df.withColumn("_found", F.when(body.rlike(_ANY), F.regexp_extract_all(body, F.lit(f"({PATTERN})"), F.lit(1))))
    df = df.withColumn("_new", F.when(F.size("_found") > 0, F.transform("_found", lambda m: _found(key, m))))
    df = df.withColumn("_gaps", F.when(F.size("_found") > 0, F.split(body, PATTERN)))
    filled = F.array_join(F.transform("_gaps", lambda g, i: F.concat(g, F.coalesce(F.get(F.col("_new"), i)["text"], F.lit("")))), "")
    kinds = F.coalesce(F.flatten(F.transform("_new", lambda x: x["kinds"])), F.array().cast("array<string>"))
    shown = F.when(F.col("_new").isNull(), body).otherwise(filled)
    return df.select(*columns_of(docs, {text: shown}, ("n_found", "kinds")), F.size(kinds).cast("long").alias("n_found"), kinds.alias("kinds"))
