"""Format-preserving pseudonyms for numbers and dates in text, in SQL functions only.

Found values are checked (Luhn, mod 97, octets, calendar), then permuted inside
their own format by a keyed Feistel network, so a value gets the same pseudonym
in every document and two values never share one:

* characters: each half of the letters and digits is shifted, character by
  character, by SHA-512 digests of the key, the round and the other half (one for
  each 64 characters); a digit stays a digit and a letter a letter of its case;
* pairs of numbers (a 4-byte address as two 16-bit halves, a day count as
  residues of 17 and 4297): each half is shifted by the digest modulo its size.

A card number keeps its length and separators and ends in a right Luhn digit, an
IBAN gets right check digits, a date becomes another date of 1900-2099 in the
same layout, an address another address, a social security number another of
the numbers that can be issued (898 areas, 99 groups, 9999 serials as a pair of
numbers).  So a pseudonym is itself a value of its format.  Everything runs
inside the scan's stage: no shuffle, no Python, no state.

Formats, not limits, end a value: a card number has 13 to 19 digits, an IBAN at
most 34 characters, a host name at most 127 labels of 63 characters.  Local parts
of addresses and hexadecimal secrets (32 characters or more) are of any length; work
grows with a value's length (times its logarithm, where marks stand between the characters).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31 are 73049 = 17 * 4297.
DAY_A, DAY_B = 17, 4297

#: Fixed patterns, tried in this order at each place of a text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "iso_date": r"(?<![0-9A-Za-z./-])(?:19|20)[0-9]{2}[-/.](?:0[1-9]|1[0-2])[-/.](?:0[1-9]|[12][0-9]|3[01])(?![0-9A-Za-z]|[-/.][0-9])",
    "day_date": r"(?<![0-9A-Za-z./-])(?:0[1-9]|[12][0-9]|3[01])[-/.](?:0[1-9]|1[0-2])[-/.](?:19|20)[0-9]{2}(?![0-9A-Za-z]|[-/.][0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[-.][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z.])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?=[a-f]*+[0-9])[0-9a-f]{32,}+(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once (a lambda's argument is a variable, an expression is copied)."""
    return F.transform(F.array(value), f)[0]


def _digest(key: str, kind: Column, i: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(key), kind, i.cast("string"), other), 512)


def _digests(digest: Column, length: Column) -> Column:
    """The digests for a half of some length: of its first 64 characters the digest itself, of each further 64 that of it and their number."""
    blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((length - 1) / 64).cast("int")))
    return F.transform(blocks, lambda b: F.when(b == 0, digest).otherwise(F.sha2(F.concat_ws(":", digest, b.cast("string")), 512)))


def _byte(digests: Column, place: Column) -> Column:
    """The byte for a 0-based place."""
    own = F.get(digests, F.floor(place / 64).cast("int"))
    return F.conv(F.substring(own, (place % 64) * 2 + 1, 2), 16, 10).cast("int")


def _chars(text: Column) -> Column:
    """The characters of a text, split once: reading one by its place in a text takes as long as the text."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def _shift(text: Column, digest: Column, kind: Column) -> Column:
    """Each character moved on within its class by the digests' byte; of a secret within the hexadecimal digits."""
    hexadecimal = "0123456789abcdef"

    def moved(c: Column, by: Column) -> Column:
        turn = lambda first, n: F.char(F.lit(first) + (F.ascii(c) - first + by) % n)
        in_hex = F.substring(F.lit(hexadecimal), (F.instr(F.lit(hexadecimal), c) - 1 + by) % 16 + 1, F.lit(1))
        return F.when(kind == "secret", in_hex).when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).otherwise(c)

    return _let(
        _digests(digest, F.length(text)),
        lambda d: F.array_join(F.transform(_chars(text), lambda c, j: moved(c, _byte(d, j))), "")
    )


def permute_chars(text: Column, kind: Column, key: str) -> Column:
    """A keyed permutation of a text of letters and digits within its character classes."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))

    def step(a: Column, i: Column) -> Column:
        return F.struct(a["r"].alias("l"), _let(_digest(key, kind, i, a["r"]), lambda d: _shift(a["l"], d, kind)).alias("r"))

    return _let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step), lambda p: F.concat(p["l"], p["r"]))


def permute_pair(pair: Column, kind: Column, key: str) -> Column:
    """A keyed permutation of the pair (l, r) in [0, a) x [0, b); ``pair`` is a struct (l, r, a, b) of longs."""
    def step(p: Column, i: Column) -> Column:
        n = F.conv(F.substring(_digest(key, kind, i, p["r"].cast("string")), 1, 13), 16, 10).cast("bigint")
        return F.struct(p["r"].alias("l"), ((p["l"] + n) % p["a"]).alias("r"), p["b"].alias("a"), p["a"].alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair, step)


def _plain(text: Column, drop: str) -> Column:
    return F.regexp_replace(text, drop, "")


def _fill(layout: Column, chars: Column, keep: str) -> Column:
    """``layout`` with its characters of the class ``keep`` replaced in turn by ``chars``.

    The places of these characters meet the new ones in order; with the other characters at their
    places they are sorted by place.
    """
    at = lambda c, j: F.struct(j.alias("j"), c.alias("c"))
    fits = lambda p: p["c"].rlike(f"^[{keep}]$")

    def put(places: Column) -> Column:
        new = F.zip_with(F.filter(places, fits), _chars(chars), lambda p, c: at(c, p["j"]))
        return F.array_join(F.transform(F.array_sort(F.concat(new, F.filter(places, lambda p: ~fits(p)))), lambda p: p["c"]), "")

    return _let(F.transform(_chars(layout), at), put)


def _luhn_sum(digits: Column, last_doubled: bool) -> Column:
    """The Luhn sum; ``last_doubled``: of digits that still lack their check digit."""
    places = F.sequence(F.lit(1), F.length(digits))
    def add(s: Column, j: Column) -> Column:
        d = F.substring(digits, j, F.lit(1)).cast("int")
        twice = (F.length(digits) - j) % 2 == (0 if last_doubled else 1)
        return s + F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(places, F.lit(0), add)


def _mod97(text: Column) -> Column:
    """A text of digits and capitals (A = 10 ... Z = 35) as a number, modulo 97."""
    def add(s: Column, j: Column) -> Column:
        c = F.substring(text, j, F.lit(1))
        return F.when(c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _kind(t: Column) -> Column:
    """Which pattern found ``t``, and null where the value fails its check."""
    whole = lambda *kinds: t.rlike("^(?:" + "|".join(PATTERNS[k] for k in kinds) + ")$")
    iban = _plain(t, "[^0-9A-Z]")
    return (
        F.when(t.contains("@"), "email").when(whole("ip"), "ip").when(whole("iso_date"), "iso_date").when(whole("day_date"), "day_date").when(whole("phone"), "phone").when(whole("ssn"), "ssn")
        .when(
            whole("iban") & F.substring(iban, 3, 2).between("02", "98") & (
                _mod97(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))) == 1
            ),
            "iban"
        )
        .when(whole("card") & (_luhn_sum(_plain(t, "[^0-9]"), False) % 10 == 0), "card").when(whole("secret"), "secret")
    )


def _permuted_part(t: Column, kind: Column) -> Column:
    """The characters of ``t`` that are permuted; empty for pairs of numbers."""
    digits, plain = _plain(t, "[^0-9]"), _plain(t, "[^0-9A-Z]")
    return (
        F.when(kind == "email", _plain(F.substring_index(t, "@", 1), "[^0-9A-Za-z]")).when(kind == "phone", digits).when(kind == "secret", t)
        .when(
            kind == "card", F.substring(digits, F.lit(1), F.length(digits) - 1)
        ).when(kind == "iban", F.substring(plain, F.lit(5), F.length(plain))).otherwise("")
    )


FIRST_DAY = "1900-01-01"
#: Social security numbers: areas 001-899 but 666, and groups 01-99 with serials 0001-9999.
AREAS, GROUPED = 898, 99 * 9999


def _pair(t: Column, kind: Column) -> Column:
    """An address, a date or a social security number as two numbers below a and b; null for the rest and for days that don't exist."""
    o = F.transform(F.split(t, r"\."), lambda x: F.expr("bigint(0)") + x.try_cast("bigint"))
    place = lambda iso, day, n: F.when(kind == "iso_date", F.substring(t, iso, n)).otherwise(F.substring(t, day, n))
    days = F.datediff(
        F.try_to_date(F.concat_ws("-", place(1, 7, 4), place(6, 4, 2), place(9, 1, 2)), "yyyy-MM-dd"),
        F.lit(FIRST_DAY).cast("date")
    ).cast("bigint")
    struct = lambda l, r, a, b: F.struct(l.alias("l"), r.alias("r"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b"))
    dated = _let(days, lambda d: F.when(d.isNotNull(), struct(d % DAY_A, F.floor(d / DAY_A), DAY_A, DAY_B)))
    number = lambda first, n: F.substring(t, first, n).cast("bigint")
    area = number(1, 3)
    ssn = struct(area - F.when(area > 666, 2).otherwise(1), (number(5, 2) - 1) * 9999 + number(8, 4) - 1, AREAS, GROUPED)
    return F.when(kind == "ssn", ssn).when(
        kind == "ip", _let(o, lambda o: struct(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536))
    ).when(kind.isin("iso_date", "day_date"), dated)


def _written(t: Column, kind: Column, chars: Column, pair: Column) -> Column:
    """The permuted parts in the layout of ``t``, with fresh check digits."""
    div = lambda x: F.floor(x / 256).cast("string")
    country = F.substring(t, 1, 2)
    moved = F.date_add(F.lit(FIRST_DAY).cast("date"), (pair["r"] * DAY_A + pair["l"]).cast("int"))
    new = (
        F.when(kind == "card", F.concat(chars, ((10 - _luhn_sum(chars, True) % 10) % 10).cast("string")))
        .when(kind == "iban", F.concat(country, F.lpad((98 - _mod97(F.concat(chars, country, F.lit("00")))).cast("string"), 2, "0"), chars))
        .when(kind == "iso_date", F.date_format(moved, "yyyyMMdd")).when(kind == "day_date", F.date_format(moved, "ddMMyyyy")).otherwise(chars)
    )
    area = pair["l"] + F.when(pair["l"] >= 665, 2).otherwise(1)
    ssn = F.concat_ws(
        "-", F.lpad(area.cast("string"), 3, "0"), F.lpad((F.floor(pair["r"] / 9999) + 1).cast("string"), 2, "0"),
        F.lpad((pair["r"] % 9999 + 1).cast("string"), 4, "0")
    )
    address = F.concat_ws(".", div(pair["l"]), (pair["l"] % 256).cast("string"), div(pair["r"]), (pair["r"] % 256).cast("string"))
    tail = F.when(kind == "email", F.concat(F.lit("@"), F.substring_index(t, "@", -1))).otherwise("")
    layout = F.when(kind == "email", F.substring_index(t, "@", 1)).otherwise(t)
    return F.when(kind == "ip", address).when(kind == "ssn", ssn).when(new.isNull(), t).otherwise(
        F.concat(_let(new, lambda n: _fill(layout, n, "0-9A-Za-z")), tail)
    )


def pseudonym(t: Column, key: str) -> Column:
    """The pseudonym of one found value; a value that fails its check is returned as it is."""
    tweak = lambda kind: F.when(kind.isin("iso_date", "day_date"), "date").otherwise(kind)
    parts = lambda kind: F.struct(
        kind.alias("kind"), permute_chars(_permuted_part(t, kind), kind, key).alias("chars"),
        permute_pair(_pair(t, kind), tweak(kind), key).alias("pair")
    )
    return _let(_let(_kind(t), parts), lambda p: F.when(p["kind"].isNull(), t).otherwise(_written(t, p["kind"], p["chars"], p["pair"])))


def pseudonymize(docs: DataFrame, key: str, *, text_col: str = "text", keep_columns: bool = True, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with every found value of ``text_col`` replaced, and n_values, how many were.

    Null text: null, 0 values.  Values that fail their check (a wrong Luhn
    digit, 30 February, an IBAN whose check digits aren't 02 to 98) stay.
    Repeated rows are changed alike and stay as many; very long texts count whole;
    an empty table gives an empty table.  A column named n_values is replaced.
    """
    text = F.col(text_col)
    own = [c for c in docs.columns if c not in ("n_values", "__old", "__new")] if keep_columns else [id_col, text_col]
    # every pattern holds a digit or @: texts without either skip the long expression
    some = docs.select(*(f"`{c}`" for c in own)).withColumn("__old", F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), 0)))
    some = some.withColumn("__new", F.when(F.size("__old") > 0, F.transform("__old", lambda t: pseudonym(t, key))))
    gaps = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(gaps, F.col("__new"), lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with("__old", "__new", lambda a, b: a != b), lambda x: x))
    return some.withColumns(
        {text_col: F.when(F.size("__old") > 0, joined).otherwise(text), "n_values": F.when(F.size("__old") > 0, changed).otherwise(0).cast("bigint")}
    ).drop("__old", "__new")
