"""Personal data: format-preserving pseudonyms by keyed Feistel networks.

Patterns find stretches of text that may hold personal data. In a stretch every
place is tried with every format, the longest first; checks keep the valid ones
(Luhn for cards, mod 97 for account numbers, ranges for addresses, calendars for
dates), so a value that a longer one swallowed is tried on its own. A Feistel
network permutes each value within its own format under a key: the same value
gets the same pseudonym in every document, different values get different ones,
and a valid number stays valid. All of it is column expressions in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfvoice.llm.common import col, located

ROUNDS = 8
_SYMBOL = "^[0-9A-Za-z]$"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_YEAR = r"(?:1[89]|2[01])\d\d"
#: Patterns by kind, which say where a stretch begins.
KINDS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z]{2,24}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ipv4": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "date": rf"\b{_YEAR}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b",
    "day_first": rf"\b(?:0[1-9]|[12]\d|3[01])[./](?:0[1-9]|1[0-2])[./]{_YEAR}\b",
    "ssn": r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d\d-(?!0000)\d{4}\b",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]?\d)",
    "phone": r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}\b|(?<![\w-])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}\b",
}
#: Groups of card numbers, the longest first.
_CARDS = (r"\d{4}(?<by>[ -]?)\d{4}(?:\k<by>\d{4}){2}\k<by>\d{3}(?!-\d)", r"\d{13,19}", r"\d{4}(?:[ -]?\d{4}){3}", r"\d{4}[ -]?\d{6}[ -]?\d{5}", r"\d{4}[ -]?\d{6}[ -]?\d{4}", r"\d{6}[ -]\d{13}")
#: A stretch goes on over digits, capitals and separators, and ends beside no word that it holds a part of.
PATTERN = "(?:" + "|".join(f"(?:{p})" for p in (*KINDS.values(), rf"(?<!\d)(?:{'|'.join(_CARDS)})(?!\d)")) + r")(?:[A-Z0-9 .+()/-]*(?:(?<=[ /])|(?![\w.%+@-])))?"
#: Characters of an account number by country.
_IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE IL IQ TL SO OM", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV NI",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban(countries: str, size: int) -> str:
    rest = rf" ?[A-Z0-9]{{{size % 4}}}" if size % 4 else ""
    return rf"\b(?:{countries})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{size // 4 - 1}}}{rest}\b"


_OTHERS = rf"(?!{'|'.join(' '.join(_IBAN_SIZES.values()).split())})[A-Z]{{2}}"
#: What a phone number's next group must not begin.
_NEXT = "|".join([KINDS["ipv4"].replace(r"(?<![\d.])", ""), *(KINDS[k].replace(r"\b", "") for k in ("date", "day_first", "ssn")), r"\d{4}(?:[ -]\d{4}){3}(?![ -]?\d)"])
_GROUP = rf"(?:(?![ .-]?(?:{_NEXT}))[ .-]?\(?\d{{1,4}}\)?)"
#: ``(kind, pattern)`` of each format; of those that fit at a place the first valid one counts.
FORMATS = (
    ("email", KINDS["email"]),
    *(("iban", _iban("|".join(names.split()), size)) for size, names in _IBAN_SIZES.items()),
    *(("iban", _iban(_OTHERS, size)) for size in range(34, 11, -1)),
    *((kind, KINDS[kind]) for kind in ("ipv4", "date", "day_first", "ssn")),
    *(("card", rf"(?<!\d){p}(?!\d)") for p in _CARDS),
    ("card", KINDS["card"]),
    ("phone", r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)"),
    *(("phone", rf"(?<![\w+])\+\d{{1,3}}{_GROUP}{{{n}}}(?!\w)") for n in (5, 4, 3, 2)),
    ("phone", KINDS["phone"].split("|")[-1]),
)


def _let(value: Column, then) -> Column:
    return F.transform(F.array(value), then)[0]


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _noise(key: str, tweak: str, turn: Column, other: Column) -> Column:
    """Keyed digest of one half, as hexadecimal."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), turn.cast("string"), other).cast("binary"), 256)


def _number(digest: Column, at, n: int) -> Column:
    return F.conv(F.substr(digest, at if isinstance(at, Column) else F.lit(at), F.lit(n)), 16, 10).cast("long")


def permute_pair(left: Column, right: Column, sizes: tuple[int, int], key: str, tweak: str) -> Column:
    """Feistel network on ``(left, right)``, numbers below the two sizes; a struct ``l, r``."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(s: Column, k: Column) -> Column:
        l = F.pmod(s["l"] + _number(_noise(key, tweak, k * 2, s["r"].cast("string")), 1, 14), F.lit(sizes[0]))  # noqa: E741
        return _let(l, lambda l: F.struct(l.alias("l"), F.pmod(s["r"] + _number(_noise(key, tweak, k * 2 + 1, l.cast("string")), 1, 14), F.lit(sizes[1])).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS // 2 - 1)), start, turn)


def permute_text(text: Column, key: str, tweak: str) -> Column:
    """Feistel network on the letters and digits: digits stay digits, letters keep their case, other characters stay.

    The two halves are the symbols of even and of odd rank, separators not
    counted, so a value has the same image in each of its spellings and both
    halves hold a symbol whenever two are there. A half is shifted, each symbol
    within its class, by a digest of the other half.
    """

    def shifted(own: Column, other: Column, turn: Column) -> Column:
        digest = _noise(key, tweak, turn, F.array_join(other, ""))
        return _let(digest, lambda d: F.transform(own, lambda c, j: _shift(c, _number(d, (j % 32) * 2 + 1, 2))))

    def turn(s: Column, k: Column) -> Column:
        even = shifted(s["l"], s["r"], k * 2)
        return _let(even, lambda e: F.struct(e.alias("l"), shifted(s["r"], e, k * 2 + 1).alias("r")))

    def written(chars: Column, done: Column) -> Column:
        """The text with its symbols replaced one after the other."""

        def step(s: Column, c: Column) -> Column:
            half = F.floor(s["n"] / 2).cast("int")
            new = F.when(s["n"] % 2 == 0, F.get(done["l"], half)).otherwise(F.get(done["r"], half))
            is_symbol = c.rlike(_SYMBOL)
            return F.struct(F.concat(s["out"], F.when(is_symbol, new).otherwise(c)).alias("out"), (s["n"] + is_symbol.cast("int")).alias("n"))

        return F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step)["out"]

    def run(chars: Column) -> Column:
        symbols = F.filter(chars, lambda c: c.rlike(_SYMBOL))
        start = _let(symbols, lambda a: F.struct(F.filter(a, lambda c, i: i % 2 == 0).alias("l"), F.filter(a, lambda c, i: i % 2 == 1).alias("r")))
        done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS // 2 - 1)), start, turn)
        return _let(done, lambda s: written(chars, s))

    return _let(_chars(text), run)


def _shift(c: Column, by: Column) -> Column:
    code = F.ascii(c)
    moved = lambda first, size: F.char((code - first + by) % size + first)
    return F.when(c.rlike("^[0-9]$"), moved(48, 10)).when(c.rlike("^[a-z]$"), moved(97, 26)).when(c.rlike("^[A-Z]$"), moved(65, 26)).otherwise(c)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a text of digits whose last one is the check digit."""
    values = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
    return _sum(values)


def mod97(text: Column) -> Column:
    """Remainder of the number that the text spells, letters being 10 to 35."""
    return F.aggregate(_chars(text), F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _compact(text: Column) -> Column:
    return F.regexp_replace(text, " ", "")


def _date(value: Column, kind: Column) -> Column:
    return F.when(kind == "date", F.try_to_date(value, "yyyy-MM-dd")).otherwise(F.try_to_date(F.translate(value, "/", "."), "dd.MM.yyyy"))


def valid(value: Column, kind: Column) -> Column:
    iban = _compact(value)
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    return F.coalesce(
        F.when(kind == "card", (luhn_sum(_digits(value)) % 10 == 0) & ~_digits(value).rlike(r"^(\d)\1*$"))
        .when(kind == "iban", mod97(turned) == 1)
        .when(kind.isin("date", "day_first"), _date(value, kind).isNotNull())
        .when(kind == "phone", F.length(_digits(value)).between(8, 15))
        .otherwise(F.lit(True)),
        F.lit(False),
    )


def canonical(value: Column, kind: Column) -> Column:
    """One spelling for all spellings of a value: numbers without separators, dates year first."""
    return (
        F.when(kind.isin("card", "phone"), F.regexp_replace(value, "[^0-9+]", ""))
        .when(kind == "iban", _compact(value))
        .when(kind == "day_first", F.date_format(_date(value, kind), "yyyy-MM-dd"))
        .otherwise(value)
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The value's image in its own format. Cards, account numbers, addresses and dates stay valid."""
    part = lambda sep, k: F.element_at(F.split(value, sep), k).cast("long")
    # Four octets: two halves of 16 bits.
    octets = permute_pair(part("[.]", 1) * 256 + part("[.]", 2), part("[.]", 3) * 256 + part("[.]", 4), (65_536, 65_536), key, "ipv4")
    address = _let(octets, lambda s: F.concat_ws(".", F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256))
    # The calendar's cycle of 400 years has 189 x 773 days.
    day = F.datediff(_date(value, kind), F.lit("1800-01-01").cast("date"))
    moved = _let(permute_pair(F.floor(day / 773), day % 773, (189, 773), key, "date"), lambda s: F.date_add(F.lit("1800-01-01").cast("date"), (s["l"] * 773 + s["r"]).cast("int")))
    sep = F.substring(value, 3, 1)
    day_first = _let(moved, lambda d: F.concat(F.date_format(d, "dd"), sep, F.date_format(d, "MM"), sep, F.date_format(d, "yyyy")))
    # Areas 001 to 899 without 666; groups from 01, serials from 0001.
    area = part("-", 1)
    ssn = permute_pair(area - 1 - (area > 666).cast("int"), (part("-", 2) - 1) * 9_999 + part("-", 3) - 1, (898, 99 * 9_999), key, "ssn")
    number = _let(ssn, lambda s: F.concat_ws("-", F.lpad(s["l"] + 1 + (s["l"] >= 665).cast("int"), 3, "0"), F.lpad(F.floor(s["r"] / 9_999) + 1, 2, "0"), F.lpad(s["r"] % 9_999 + 1, 4, "0")))
    head = permute_text(F.substr(value, F.lit(1), F.length(value) - 1), key, "card")
    card = _let(head, lambda h: F.concat(h, (F.pmod(10 - luhn_sum(F.concat(_digits(h), F.lit("0"))) % 10, F.lit(10))).cast("string")))
    body = permute_text(F.substr(value, F.lit(5)), key, "iban")
    country = F.substring(value, 1, 2)
    iban = _let(body, lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(_compact(b), country, F.lit("00")))).cast("string"), 2, "0"), b))
    top = F.regexp_extract(value, r"(\.[A-Za-z]+)$", 1)
    email = F.concat(permute_text(F.substr(value, F.lit(1), F.length(value) - F.length(top)), key, "email"), top)
    # A country's code stays: one digit for +1 and +7, else two.
    code = F.when(value.rlike(r"^[+][17]"), 2).when(F.startswith(value, F.lit("+")), 3).otherwise(0)
    phone = _let(code, lambda n: F.concat(F.substr(value, F.lit(1), n), permute_text(F.substr(value, n + 1), key, "phone")))
    choices = {"email": email, "iban": iban, "ipv4": address, "date": F.date_format(moved, "yyyy-MM-dd"), "day_first": day_first, "ssn": number, "card": card, "phone": phone}
    out = F.lit(None).cast("string")
    for name, made in choices.items():
        out = F.when(kind == name, made).otherwise(out)
    return out


def _pieces(gap: Column, hit: Column, start: Column) -> Column:
    """A stretch and the gap before it as ``(gap, value, start, kind)`` end to end; what is no valid value has no kind."""

    def at_places(rank: int, kind: str, pattern: str) -> Column:
        fits = F.regexp_extract_all(hit, F.lit(f"(?s)(?:(?=({pattern})))?."), F.lit(1))
        placed = F.transform(fits, lambda v, i: F.struct(i.alias("at"), F.lit(rank).alias("rank"), v.alias("value"), F.lit(kind).alias("kind")))
        none = F.filter(placed, lambda c: c["value"] != "")
        return F.when(hit.rlike(pattern), none).otherwise(F.array().cast("array<struct<at:int,rank:int,value:string,kind:string>>"))

    tried = F.array_sort(F.flatten(F.array(*(at_places(k, *f) for k, f in enumerate(FORMATS)))))
    fit = F.filter(tried, lambda c: valid(c["value"], c["kind"]))
    kinds = "array<struct<gap:string,value:string,start:bigint,kind:string>>"
    none = F.struct(F.array().cast(kinds).alias("made"), F.lit(0).alias("end"))

    def taken(s: Column, c: Column) -> Column:
        before = F.substr(hit, s["end"] + 1, c["at"] - s["end"])
        lead = F.when(s["end"] == 0, F.concat(gap, before)).otherwise(before)
        made = F.struct(lead.alias("gap"), c["value"].alias("value"), (start + c["at"]).cast("long").alias("start"), c["kind"].alias("kind"))
        longer = F.struct(F.concat(s["made"], F.array(made)).alias("made"), (c["at"] + F.length(c["value"])).cast("int").alias("end"))
        return F.when(c["at"] >= s["end"], longer).otherwise(s)

    def ended(s: Column) -> Column:
        rest = F.struct(F.when(s["end"] == 0, gap).otherwise(F.lit("")).alias("gap"), F.substr(hit, s["end"] + 1).alias("value"), (start + s["end"]).cast("long").alias("start"), F.lit(None).cast("string").alias("kind"))
        return F.when(s["end"] < F.length(hit), F.concat(s["made"], F.array(rest))).otherwise(s["made"])

    return _let(F.aggregate(fit, none, taken), ended)


def found(text: Column, key: str) -> Column:
    """Array of ``(gap, value, start, kind, pseudonym)`` end to end; what is no valid value has no pseudonym."""

    def made(r: Column) -> Column:
        image = F.when(r["kind"].isNotNull(), pseudonym(r["value"], r["kind"], key))
        return F.struct(*(r[k].alias(k) for k in ("gap", "value", "start", "kind")), image.alias("pseudonym"))

    return F.transform(F.flatten(F.transform(located(text, PATTERN), lambda r: _pieces(r["gap"], r["hit"], r["start"]))), made)


def scan(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, kind, start, length, value_hmac, pseudonym)``, a row for each valid value in each row.

    ``start`` and ``length`` are code points; ``value_hmac`` is a keyed digest,
    equal for equal values in any of their spellings (see ``canonical``). Null and empty texts have none; null and repeated
    ids pass through; other columns are not read.
    """
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.explode(found(col(text_col).cast("string"), key)).alias("f")).filter("f.pseudonym IS NOT NULL")
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("value"), canonical(F.col("f.value"), F.col("f.kind"))).cast("binary"), 256)
    return rows.select("doc_id", "f.kind", "f.start", F.length("f.value").cast("long").alias("length"), digest.alias("value_hmac"), "f.pseudonym")


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The same rows and columns with each valid value replaced by its pseudonym; other texts stay, null ones too."""
    text = col(text_col).cast("string")

    def written(cs: Column) -> Column:
        last = F.element_at(cs, -1)
        parts = F.transform(cs, lambda c: F.concat(c["gap"], F.coalesce(c["pseudonym"], c["value"])))
        return F.concat(F.array_join(parts, ""), F.substr(text, (last["start"] + F.length(last["value"]) + 1).cast("int")))

    new = _let(found(text, key), lambda cs: F.when(F.size(cs) > 0, written(cs)).otherwise(text))
    return docs.withColumn(text_col, F.when(text.rlike(PATTERN), new).otherwise(text))
