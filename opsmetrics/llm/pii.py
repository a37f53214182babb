"""Pseudonyms for personal data that keep the format and stay linked across documents.

Validated values are moved by a keyed permutation of all values of their format:
an alternating Feistel network over two number parts, with rounds from a keyed
SHA-256. A permutation never maps two values to one, and equal values get equal
pseudonyms in all documents. Only SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmetrics.llm.common import let

_ROUNDS = 10
#: Days from 1700-01-01 to 2099-12-31. Those that a two-digit year can write, 1969 to 2068, move among
#: themselves (36,525 days as 75 * 487), and so do all others (109,572 days as 276 * 397).
_FIRST_DAY, _SHORT_FIRST_DAY = "1700-01-01", "1969-01-01"
_SHORT_A, _SHORT_B, _LONG_A, _LONG_B = 75, 487, 276, 397
#: An IPv6 address keeps its first group; the other 112 bits move as two halves.
_HALF_ADDRESS = 1 << 56
#: Valid social security numbers: areas 001-899 but 666, groups 01-99, serials 0001-9999.
_AREAS, _GROUPS, _SERIALS = 898, 99, 9999

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
_HAS_DIGIT = r"(?=[A-Za-z+/_=.~-]{0,200}[0-9])"
#: A name and a sign; spoken names and bearers only before a value with a digit, so that plain sentences stay.
_SECRET_NAME = (
    r"(?i:(?<![A-Za-z0-9_])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)"
    rf"(?:[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?|\s{{1,3}}(?:is|was):?\s{{1,3}}[\"']?{_HAS_DIGIT})"
    rf"|(?<![A-Za-z0-9_])bearer\s{{1,3}}{_HAS_DIGIT})"
    r"|(?<![A-Za-z0-9])(?:AKIA|ASIA)(?=[0-9A-Z]{16}(?![A-Za-z0-9]))"
)
#: Of any length; a dot at the end belongs to the sentence.
_SECRET_VALUE = r"[A-Za-z0-9+/_=.-]{7,}[A-Za-z0-9+/_=-]"
_SECRET = f"(?:{_SECRET_NAME}){_SECRET_VALUE}"
_PEM_HEAD, _PEM_TAIL = (rf"-----{word} (?:[A-Z0-9]{{1,9}} ){{0,3}}PRIVATE KEY-----" for word in ("BEGIN", "END"))
_PEM = _PEM_HEAD + r"[^-]+(?:-[^-]+){0,8}" + _PEM_TAIL
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_ISO_DATE = r"(?<![0-9./-])[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}(?![0-9]|[./-][0-9])"
_DATE = r"(?<![0-9./-])[0-9]{1,2}([-/.])[0-9]{1,2}\1[0-9]{4}(?![0-9]|[./-][0-9])"
_SHORT_DATE = (
    r"(?<![0-9./-])(?:[0-9]{1,2}([-/])[0-9]{1,2}\1[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{2})(?![0-9]|[./-][0-9])"
)
_MONTHS = "january february march april may june july august september october november december".split()
_MONTH = "(?:" + "|".join(_MONTHS) + "|sept|" + "|".join(m[:3] for m in _MONTHS if m != "may") + ")"
_NAMED_DATE = (
    rf"(?i:(?<![A-Za-z0-9])[0-9]{{1,2}}(?:st|nd|rd|th)?(?: of)?[ -]?{_MONTH}\.?,?[ -]?[0-9]{{4}}(?![A-Za-z0-9])"
    rf"|(?<![A-Za-z0-9])[0-9]{{1,2}}-{_MONTH}-[0-9]{{2}}(?![A-Za-z0-9])"
    rf"|(?<![A-Za-z0-9]){_MONTH}\.? [0-9]{{1,2}}(?:st|nd|rd|th)?,? [0-9]{{4}}(?![A-Za-z0-9]))"
)
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Not after a word that makes it a version.
_IP = r"(?<![0-9.])(?<!\b(?i:version|release|build|ver|v)[ .:]{0,2})(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
_IP6 = (
    r"(?<![0-9A-Za-z:.])(?:[23][0-9A-Fa-f]{3}|[fF][c-dC-D][0-9A-Fa-f]{2}|[fF][eE][89abAB][0-9A-Fa-f])"
    r":(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:]|\.[0-9])"
)
_PHONE = (
    r"(?<![0-9+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|(?<![0-9+])\+[2-9][0-9]{0,2}(?:[ .-]?[0-9]{1,4}){2,5}(?![0-9])"
    r"|(?<![0-9(])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
)
#: Three, three and four digits, also after a 1; between blanks only as North American numbers go. Not after "pages".
_NATIONAL = (
    r"(?<![0-9+(])(?<![0-9][.-])(?<!\b(?i:pages?|pp?)[. ]{1,2})(?:1([-.])[0-9]{3}\1[0-9]{3}\1[0-9]{4}|(?:1 )?[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}"
    r"|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}|(?:1[ -])?[0-9]{3}[ ./][0-9]{3}-[0-9]{4})(?![0-9]|[-.][0-9])"
)
#: A trunk 0 and ten or eleven digits in all.
_TRUNK = (
    r"(?<![0-9+(])(?<![0-9][./-])(?=0(?:[ ./-]?[0-9]){9,10}(?![0-9]|[./-][0-9]))"
    r"(?:0[1-9][0-9]{0,4}([ ./-])[0-9]{2,4}(?:\1[0-9]{2,4}){1,3}|0[1-9][0-9]{0,4}[ /-][0-9]{5,8})(?![0-9]|[./-][0-9])"
    r"|(?<![0-9(])\(0[1-9][0-9]{0,3}\) ?(?:[0-9]{3,4}[ -]?[0-9]{3,4}|[0-9]{5,8})(?![0-9])"
)
_CARD = r"(?<![0-9])(?<!(?i:isbn(?:-1[03])?)[: ]{0,2})[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"

KINDS = ("email", "secret", "iban", "date", "ssn", "ip", "phone", "card")


def _capture_free(pattern: str, group: int) -> str:
    """The pattern with its back reference numbered for its place in the alternation."""
    return pattern.replace(r"\1", rf"\{group}")


#: Everything that may be personal; what follows validates it.
CANDIDATE = "|".join(
    [
        _EMAIL,
        _PEM,
        _SECRET,
        _IBAN,
        _capture_free(_ISO_DATE, 1),
        _capture_free(_DATE, 2),
        _capture_free(_SHORT_DATE, 3),
        _NAMED_DATE,
        _SSN,
        _IP,
        _IP6,
        _PHONE,
        _capture_free(_NATIONAL, 4),
        _capture_free(_TRUNK, 5),
        _CARD,
    ]
)
#: A text without any of these cannot hold a candidate.
_QUICK = r"[0-9@]|(?i:token|secret|password|passwd|key|f[c-e][0-9a-f]{2}:)|AKIA|ASIA"


def _noise(key: Column, kind: str, step: Column, part: Column, modulus: Column) -> Column:
    """A keyed hash of the other part, from 0 to modulus - 1."""
    digest = F.sha2(F.concat_ws("|", key, F.lit(kind), step, modulus, part, key), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: Column, kind: str) -> Column:
    """A keyed permutation of the pairs below (size_a, size_b): a struct (a, b)."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(state: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        left, right = state["a"], state["b"]
        moved_a = F.pmod(left + _noise(key, kind, i, right, size_a), size_a)
        moved_b = F.pmod(right + _noise(key, kind, i, left, size_b), size_b)
        return F.struct(F.when(even, moved_a).otherwise(left).alias("a"), F.when(even, right).otherwise(moved_b).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(_ROUNDS - 1)), start, step)


def _permuted_digits(digits: Column, key: Column, kind: str) -> Column:
    """Digits of the same number, at least two and at most 36, moved by the key."""
    power = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")

    def halves(d: Column) -> Column:
        size = F.length(d)
        half = F.floor(size / 2).cast("int")
        a, b = F.substring(d, F.lit(1), half), F.substring(d, half + 1, size - half)
        moved = feistel(a.cast("long"), b.cast("long"), power(half), power(size - half), key, kind)
        shown = lambda m: F.concat(
            F.lpad(m["a"].cast("string"), half, "0"), F.lpad(m["b"].cast("string"), size - half, "0")
        )
        return let(moved, shown)

    return let(digits, halves)


def _digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _in_layout(text: Column, digits: Column) -> Column:
    """The text with its digits replaced one by one."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def laid(fresh: Column) -> Column:
        def step(state: Column, char: Column) -> Column:
            digit = char.rlike("^[0-9]$")
            new = F.when(digit, F.substring(fresh, state["next"], F.lit(1))).otherwise(char)
            return F.struct(
                F.concat(state["out"], new).alias("out"), (state["next"] + F.when(digit, 1).otherwise(0)).alias("next")
            )

        return F.aggregate(chars, start, step, lambda s: s["out"])

    return let(digits, laid)


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    """The Luhn sum, doubling every second digit from the right."""
    backwards = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    parity = 0 if double_last else 1
    values = F.transform(
        backwards,
        lambda c, i: let(c.cast("int") * F.when(F.pmod(i, F.lit(2)) == parity, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)),
    )
    return F.aggregate(values, F.lit(0), lambda total, v: total + v)


def _card(text: Column, key: Column) -> Column:
    def moved(digits: Column) -> Column:
        size = F.length(digits)
        book = (size == 13) & digits.rlike("^97[89]")
        valid = size.between(13, 19) & ~digits.startswith("0") & ~book & (F.pmod(_luhn_sum(digits, False), F.lit(10)) == 0)
        body = _permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
        check = lambda p: F.pmod(10 - F.pmod(_luhn_sum(p, True), F.lit(10)), F.lit(10)).cast("string")
        return F.when(valid, _in_layout(text, let(body, lambda p: F.concat(p, check(p)))))

    return let(_digits_of(text), moved)


def _phone(text: Column, key: Column) -> Column:
    """The last ten digits move (or all, without a country code); the country code and a trunk 0 stay."""

    def moved(digits: Column) -> Column:
        size = F.length(digits)
        kept = F.greatest(size - 10, F.when(text.rlike("^(?:[+]|[(]?0)"), 1).otherwise(0))
        fresh = F.concat(
            F.substring(digits, F.lit(1), kept), _permuted_digits(F.substring(digits, kept + 1, size - kept), key, "phone")
        )
        return F.when(size.between(8, 15), _in_layout(text, fresh))

    return let(_digits_of(text), moved)


def _ip(text: Column, key: Column) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda p: p.cast("int"))
    valid = F.forall(parts, lambda p: p <= 255)
    moved = feistel(
        parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "ip"
    )
    high = lambda v: F.floor(v / 256).cast("string")
    low = lambda v: F.pmod(v, F.lit(256)).cast("string")
    return F.when(valid, let(moved, lambda m: F.concat_ws(".", high(m["a"]), low(m["a"]), high(m["b"]), low(m["b"]))))


def _ip6(text: Column, key: Column) -> Column:
    """All groups but the first move; written whole, in lower case, so all ways to write an address get one pseudonym."""
    low = F.lower(text)
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    left, right = groups(F.substring_index(low, "::", 1)), groups(F.substring_index(low, "::", -1))
    short = low.contains("::")
    written = F.size(groups(low))
    gaps = F.size(F.filter(F.split(low, ":"), lambda g: g == ""))
    valid = F.when(short, (gaps == 1) & (written <= 7)).otherwise((gaps == 0) & (written == 8))
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - written, F.lit(0)))
    whole = F.when(short, F.concat(left, zeros, right)).otherwise(left)
    digits = F.concat_ws("", F.transform(whole, lambda g: F.lpad(g, 4, "0")))

    def moved(d: Column) -> Column:
        half = lambda at: F.conv(F.substring(d, at, 14), 16, 10).cast("long")
        size = F.lit(_HALF_ADDRESS).cast("long")
        return let(feistel(half(5), half(19), size, size, key, "ip6"), lambda m: shown(d, m))

    def shown(d: Column, m: Column) -> Column:
        hexed = lambda v: F.lpad(F.lower(F.hex(v)), 14, "0")
        all_ = F.concat(F.substring(d, 1, 4), hexed(m["a"]), hexed(m["b"]))
        parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(all_, i * 4 + 1, F.lit(4)))
        return F.concat_ws(":", F.transform(parts, lambda g: F.regexp_replace(g, "^0{1,3}", "")))

    return F.when(valid, let(digits, moved))


def _ssn(text: Column, key: Column) -> Column:
    area, group, serial = (F.substring(text, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)
    size_a, size_b = F.lit(_AREAS * _GROUPS).cast("long"), F.lit(_SERIALS).cast("long")
    moved = feistel(rank * _GROUPS + group - 1, serial - 1, size_a, size_b, key, "ssn")

    def show(m: Column) -> Column:
        rank_ = F.floor(m["a"] / _GROUPS)
        area_ = rank_ + 1 + F.when(rank_ >= 665, 1).otherwise(0)
        two = F.lpad((F.pmod(m["a"], F.lit(_GROUPS)) + 1).cast("string"), 2, "0")
        return F.concat_ws("-", F.lpad(area_.cast("string"), 3, "0"), two, F.lpad((m["b"] + 1).cast("string"), 4, "0"))

    return F.when(valid, let(moved, show))


def _moved_day(day: Column, key: Column, show) -> Column:
    """What ``show`` makes of the day that a day moves to; null for days outside 1700 to 2099.

    One permutation for all ways to write a day, so a day has one pseudonym, and one
    that a two-digit year can write moves to another such day.
    """
    start, short_size = F.lit(_FIRST_DAY).cast("date"), _SHORT_A * _SHORT_B
    before = F.datediff(F.lit(_SHORT_FIRST_DAY).cast("date"), start)

    def moved(number: Column) -> Column:
        short = number.between(before, before + short_size - 1)
        rank = F.when(short, number - before).when(number < before, number).otherwise(number - short_size)
        size_a = F.when(short, _SHORT_A).otherwise(_LONG_A).cast("long")
        size_b = F.when(short, _SHORT_B).otherwise(_LONG_B).cast("long")

        def back(m: Column) -> Column:
            to = m["a"] * size_b + m["b"]
            return F.date_add(start, (to + F.when(short, before).when(to < before, 0).otherwise(short_size)).cast("int"))

        to = feistel(F.floor(rank / size_b), F.pmod(rank, size_b), size_a, size_b, key, "date")
        valid = number.between(0, short_size + _LONG_A * _LONG_B - 1)
        return F.when(valid, let(let(to, back), show))

    return let(F.datediff(day, start), moved)


def _two(value: Column, like: Column) -> Column:
    """The number, with a leading zero if it was written with two digits."""
    return F.when(F.length(like) == 2, F.lpad(value.cast("string"), 2, "0")).otherwise(value.cast("string"))


def _date(text: Column, key: Column) -> Column:
    """Year first, or day first and, where that is no date, month first; written as it was."""
    parts = F.split(text, "[-/.]")
    sign = F.substring(F.regexp_replace(text, "[0-9]", ""), 1, 1)
    year_first = F.length(parts[0]) == 4
    as_date = lambda y, m, d: F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), m, d), "yyyy-M-d")
    day_first = as_date(parts[2], parts[1], parts[0])
    day = F.when(year_first, as_date(parts[0], parts[1], parts[2])).otherwise(
        F.coalesce(day_first, as_date(parts[2], parts[0], parts[1]))
    )

    def show(fresh: Column) -> Column:
        y = F.lpad(F.year(fresh).cast("string"), 4, "0")
        month, dom = F.month(fresh), F.dayofmonth(fresh)
        return (
            F.when(year_first, F.concat(y, sign, _two(month, parts[1]), sign, _two(dom, parts[2])))
            .when(day_first.isNotNull(), F.concat(_two(dom, parts[0]), sign, _two(month, parts[1]), sign, y))
            .otherwise(F.concat(_two(month, parts[0]), sign, _two(dom, parts[1]), sign, y))
        )

    return _moved_day(day, key, show)


def _short_date(text: Column, key: Column) -> Column:
    """Day, month or year first, whichever is a date first; years from 1969 to 2068."""
    parts = F.split(text, "[-/.]")
    sign = F.substring(F.regexp_replace(text, "[0-9]", ""), 1, 1)

    def as_date(y: int, m: int, d: int) -> Column:
        year = parts[y].cast("int")
        full = (year + F.when(year < 69, 2000).otherwise(1900)).cast("string")
        return F.when(F.length(parts[y]) == 2, F.try_to_date(F.concat_ws("-", full, parts[m], parts[d]), "yyyy-M-d"))

    orders = [(2, 1, 0), (2, 0, 1), (0, 1, 2)]

    def written(y: int, m: int, d: int):
        def show(fresh: Column) -> Column:
            value = {y: F.pmod(F.year(fresh), F.lit(100)), m: F.month(fresh), d: F.dayofmonth(fresh)}
            return F.concat(_two(value[0], parts[0]), sign, _two(value[1], parts[1]), sign, _two(value[2], parts[2]))

        return show

    return F.coalesce(*(_moved_day(as_date(*o), key, written(*o)) for o in orders))


def _named_date(text: Column, key: Column) -> Column:
    """The day, the month's name (whole or short, in its case) and the year move; all else stays but the ordinal's end."""
    lead = F.regexp_extract(text, "^[^0-9]*", 0)
    number = r"^[^0-9]*([0-9]{1,2})((?i:st|nd|rd|th)?)"
    dom, end = F.regexp_extract(text, number, 1), F.regexp_extract(text, number, 2)
    between = F.regexp_extract(text, number + "(.*?)[0-9]+$", 3)
    year = F.regexp_extract(text, "[0-9]+$", 0)
    name = F.regexp_extract(text, f"(?i){_MONTH}", 0)
    low = F.lower(name)
    month = F.array_position(F.array(*(F.lit(m[:3]) for m in _MONTHS)), F.substring(low, 1, 3)).cast("int")
    short_year = F.length(year) == 2
    century = F.when(short_year, F.when(year.cast("int") < 69, 2000).otherwise(1900)).otherwise(0)
    day = F.try_to_date(F.concat_ws("-", F.lpad((year.cast("int") + century).cast("string"), 4, "0"), month.cast("string"), dom), "yyyy-M-d")

    def show(fresh: Column) -> Column:
        own = F.element_at(F.array(*map(F.lit, _MONTHS)), F.month(fresh))
        own = F.when(low.isin("sept", *(m[:3] for m in _MONTHS if m != "may")), F.substring(own, 1, 3)).otherwise(own)
        own = F.when(name == F.upper(name), F.upper(own)).when(name == low, own).otherwise(F.initcap(own))
        d = F.dayofmonth(fresh)
        ends = F.when(d.isin(1, 21, 31), "st").when(d.isin(2, 22), "nd").when(d.isin(3, 23), "rd").otherwise("th")
        ends = F.when(end == "", "").when(end == F.upper(end), F.upper(ends)).otherwise(ends)
        day_ = F.when(dom.startswith("0"), F.lpad(d.cast("string"), 2, "0")).otherwise(d.cast("string"))
        year_ = F.when(short_year, F.lpad(F.pmod(F.year(fresh), F.lit(100)).cast("string"), 2, "0")).otherwise(
            F.lpad(F.year(fresh).cast("string"), 4, "0")
        )
        named = lambda part: F.regexp_replace(part, F.lit(f"(?i){_MONTH}"), own)
        return F.concat(named(lead), day_, ends, named(between), year_)

    return _moved_day(day, key, show)


def _mod97(text: Column) -> Column:
    """The text as a number, letters from A = 10, modulo 97."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda acc, c: F.pmod(acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))


def _iban(text: Column, key: Column) -> Column:
    """The digits of the account move, its letters stay, the check digits are made anew."""
    plain = F.regexp_replace(text, " ", "")
    country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain) - 4)
    valid = F.length(plain).between(15, 34) & (_mod97(F.concat(account, F.substring(plain, 1, 4))) == 1)
    digits = _digits_of(account)
    moved = _in_layout(account, F.when(F.length(digits) >= 2, _permuted_digits(digits, key, "iban")).otherwise(digits))

    def show(fresh: Column) -> Column:
        check = F.lpad((98 - _mod97(F.concat(fresh, country, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(country, check, fresh)

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def spaced(state: Column, char: Column, full: Column) -> Column:
        blank = char == " "
        return F.struct(
            F.concat(state["out"], F.when(blank, " ").otherwise(F.substring(full, state["next"], F.lit(1)))).alias("out"),
            (state["next"] + F.when(blank, 0).otherwise(1)).alias("next"),
        )

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    laid = let(let(moved, show), lambda full: F.aggregate(chars, start, lambda s, c: spaced(s, c, full), lambda s: s["out"]))
    return F.when(valid, laid)


def _keyed_hex(text: Column, key: Column, kind: str) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(kind), text, key), 256)


def _email(text: Column, key: Column) -> Column:
    """An address has no number format: its name becomes a keyed token, its domain stays."""
    low = F.lower(text)
    return F.concat(F.lit("u"), F.substring(_keyed_hex(low, key, "email"), 1, 16), F.lit("@"), F.substring_index(text, "@", -1))


def _secret(text: Column, key: Column) -> Column:
    """The name and sign stay, the value becomes a keyed token of its length."""
    name = F.regexp_extract(text, f"^(?:{_SECRET_NAME})", 0)

    def shown(value: Column) -> Column:
        times = F.ceil(F.length(value) / 64).cast("int")
        return F.concat(name, F.substring(F.repeat(_keyed_hex(value, key, "secret"), times), F.lit(1), F.length(value)))

    return let(F.substring(text, F.length(name) + 1, F.length(text)), shown)


def _pem(text: Column, key: Column) -> Column:
    """The first and last line stay, what is between becomes a keyed token."""
    head, tail = F.regexp_extract(text, "^" + _PEM_HEAD, 0), F.regexp_extract(text, _PEM_TAIL + "$", 0)
    return F.concat_ws("\n", head, _keyed_hex(F.regexp_replace(text, r"\s", ""), key, "secret"), tail)


def _full(pattern: str) -> str:
    return f"^(?:{pattern})$"


def pseudonym(value: Column, key: Column) -> Column:
    """A struct (kind, value) for one candidate; kind is null and the value as it was if it is not valid."""
    tries = [
        ("email", _EMAIL, _email),
        ("secret", _PEM, _pem),
        ("secret", _SECRET, _secret),
        ("iban", _IBAN, _iban),
        ("date", _ISO_DATE, _date),
        ("date", _DATE, _date),
        ("date", _SHORT_DATE, _short_date),
        ("date", _NAMED_DATE, _named_date),
        ("ssn", _SSN, _ssn),
        ("ip", _IP, _ip),
        ("ip", _IP6, _ip6),
        ("phone", f"{_PHONE}|{_NATIONAL}|{_capture_free(_TRUNK, 2)}", _phone),
        ("card", _CARD, _card),
    ]
    def named(kind: str):
        return lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    none = F.struct(F.lit(None).cast("string").alias("kind"), value.alias("value"))
    out = [F.when(value.rlike(_full(pattern)), let(move(value, key), named(kind))) for kind, pattern, move in tries]
    return F.coalesce(*out, none)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``doc_id``, ``text`` with pseudonyms, and how many of each kind (``n_card`` ...).

    Cards (Luhn, 13 to 19 digits), IBANs (modulo 97), social security numbers,
    IPv4 and IPv6 addresses and dates from 1700 to 2099 are validated and stay valid. A day has one
    pseudonym however it is written: with a two-digit year (1969 to 2068, which move
    among themselves) or an English month name too. Phone numbers keep their country
    code, a trunk 0 and their layout: with +country, with a bracketed area code,
    3-3-4 digits with ``-``, ``.`` or blanks (between blanks only if area and
    exchange begin with 2 to 9), or 10 to 11 digits in groups after a 0. IPv6 addresses
    (global, local and link-local) keep their first group. E-mail names and secrets have no number format and
    become keyed tokens; secrets are values after a name with ``=`` or ``:``, after
    ``password is`` or ``Bearer`` if they hold a digit, access keys (AKIA, ASIA) and
    private keys in PEM. What does not validate as anything stays as it is: numbers that fail
    their check, ISBNs, four numbers after ``version`` or ``release``, ``pages 100-200-3000``.
    Whole texts are read.

    Left out, and so left in clear: phone numbers without any separator or area
    code (2125551234, 555-1234), with a 00 prefix, with extensions (the extension
    alone stays), and national layouts without a trunk 0 other than 3-3-4; dates
    without a day or a year, with month names of other languages or with a
    two-digit year after a blank (3 March 24), and d.m.yy with a one-digit day or
    month, which is how versions are written; e-mail names over 64 characters; secrets
    under 8 characters; bearer tokens and spoken passwords without a digit; PEM keys
    without their last line; IPv6 addresses that end in ``::`` or an IPv4 address.

    A null text stays null, an empty one empty, both with zero counts; rows that
    repeat an id are rewritten each, alike for equal texts; other columns are not
    read; an empty table gives no rows.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    pattern = F.lit(CANDIDATE)
    secret = F.lit(key)
    quick = F.col("text").rlike(_QUICK)
    found = F.when(quick, F.regexp_extract_all("text", pattern, F.lit(0)))
    moved = own.withColumn("found", F.transform(found, lambda v: pseudonym(v, secret)))
    between = F.split("text", CANDIDATE, -1)
    text = F.when(
        F.size("found") > 0,
        F.concat_ws(
            "", F.transform(between, lambda part, i: F.concat(part, F.coalesce(F.get(F.col("found"), i)["value"], F.lit(""))))
        ),
    ).otherwise(F.col("text"))

    def of(kind: str):
        return lambda v: v["kind"] == kind

    counts = [F.size(F.coalesce(F.filter("found", of(k)), F.array())).cast("long").alias(f"n_{k}") for k in KINDS]
    return moved.select("doc_id", text.alias("text"), *counts)
