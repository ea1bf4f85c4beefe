"""PII: format-preserving Feistel pseudonyms.

Numbers are found by one pattern, validated, and permuted with a key within their own format, so a
value becomes the same pseudonym in every document and two values of a kind never become one:

* card numbers that pass the Luhn check: one group of 13 to 19 digits; four groups of four, or 4, 6 and 4 or 5, with one
  separator, where four groups of four begin as an issuer's numbers do and no further group of four stands beside them (so a table of numbers isn't taken for cards); two or
  three cards of four groups in a row; and in runs of few groups, where an issuer's prefix tells, four groups of four beside
  others and other groupings of a whole run. All digits but the last are permuted, the last is the new check digit; spaces and hyphens stay;
* North American phone numbers, but groups joined by spaces only with a number beside them: area, exchange and line within their valid ranges; other phone
  numbers after a + : all digits but the country code's first;
* social security numbers, within the valid areas, groups and serials;
* IPv4 addresses, within 32 bits;
* dates (year-month-day, day/month/year, day.month.year) that exist, from 1900-01-01 to 2099-12-31;
* e-mail addresses: letters and digits of the local part, which are taken in lower case, as mail systems
  hold Bob and bob for one; the domain stays;
* access keys (AKIA and 16 of A-Z0-9): the 16, likewise; tokens that begin with ghp_ or sk-: the rest of
  them, by letters of either case and digits.

A domain is m * n values; eight rounds add a keyed digest of one side to the other, which permutes it
for any m and n. Letters are permuted as two halves of digits of base 36 or 62, each digit moved by one of
the digest. Everything is built-in SQL; texts without a digit, an @ or one of the marks are passed through.
Not covered: month/day/year, IBANs, names and postal addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .quality import let

ROUNDS = 8
#: The patterns, tried in this order at each place. What repeats without bound is possessive: it takes no stack, however long the text.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
TOKEN = r"(?<![A-Za-z0-9_-])(?:ghp_|sk-)[A-Za-z0-9]{20,64}(?![A-Za-z0-9_-])"
IPV4 = r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d)"
ISO_DATE = r"(?<![\w-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\w-])"
DAY_DATE = r"(?<![\w./])(?:0[1-9]|[12]\d|3[01])([./])(?:0[1-9]|1[0-2])\1(?:19|20)\d\d(?![\w/]|\.\d)"
SSN = r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])"
#: With spaces only, and a number before or after it, three groups of digits are cells of a table.
_CELLS = r"(?:1 ?)?[2-9]\d\d [2-9]\d\d \d{4}"
PHONE = rf"(?<![\w+])(?!(?:(?<=\d )|(?={_CELLS} \d)){_CELLS})" + r"(?:\+?1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}(?!\w|-\d)"
WORLD_PHONE = r"(?<![\w+])\+[1-9](?:[ .()-]{0,2}\d){7,14}(?!\w)"
#: The date pattern's group would shift with others before it, so it is written out for the joined pattern.
_DAY_DATE = DAY_DATE.replace(r"([./])", "[./]").replace(r"\1", "[./]")
OTHER = "|".join(f"(?:{p})" for p in (EMAIL, ACCESS_KEY, TOKEN, IPV4, ISO_DATE, _DAY_DATE, SSN, PHONE, WORLD_PHONE))
#: What starts with a group of digits and goes on with other characters; a run of digits ends before it.
_MIXED = rf"{EMAIL}|{IPV4}|{ISO_DATE}|{_DAY_DATE}|(?:1[ .-])?[2-9]\d\d(?:\.[2-9]\d\d[ .-]|[ -][2-9]\d\d\.)\d{{4}}(?!\w|-\d)"
#: All groups of digits that one space or hyphen joins, 13 digits or more; possessive, as its length has no bound.
RUN = rf"(?<![\w-])(?=\d(?:[ -]?\d){{12}})\d++(?!\w)(?:[ -](?!{_MIXED})\d++(?!\w))*+"
#: First digits of cards by their length.
_ISSUED = r"(?:4|5[1-5]|2[2-7]|3[0-9]|6[0-9])"
_GROUPS = r"\d{4}(?<SEP>[ -])\d{4}\k<SEP>\d{4}\k<SEP>\d{4}(?!\d)"
#: The shapes of cards in a run of digits.
CARD_SHAPES = "|".join((
    r"(?<!\d)\d{13,19}(?!\d)",
    rf"(?<!\d)(?<!(?<!\d)\d{{4}}[ -])(?={_ISSUED})" + _GROUPS.replace("SEP", "a") + r"(?:[ -]\d{4}\k<a>\d{4}\k<a>\d{4}\k<a>\d{4}(?!\d)){0,2}+(?![ -]\d{4}(?!\d))",
    r"(?<!\d)\d{4}(?<b>[ -])\d{6}\k<b>\d{4,5}(?!\d)",
    rf"(?<=^|^\d{{1,6}}[ -])(?={_ISSUED})" + _GROUPS.replace("SEP", "c") + r"(?=(?:[ -]\d{1,6}){0,2}$)",
    rf"^(?={_ISSUED})(?=(?:\d[ -]?){{13,19}}$)\d+(?:[ -]\d+){{1,4}}$",
))
ANY = f"{OTHER}|(?:{RUN})"
#: Days from 1900-01-01 to 2099-12-31, the product of two numbers.
DATE_SIDES = (4297, 17)
DATE_DAYS = 73_049


def keyed(key: str, kind: str, i: Column, value: Column, modulus: Column) -> Column:
    """A keyed digest below ``modulus`` (at most 10**17)."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), value.cast("string"), modulus.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).try_cast("long") % modulus


def feistel(left: Column, right: Column, m: Column, n: Column, key: str, kind: str) -> Column:
    """A struct (l, r) of the permuted value; ``left`` is below m, ``right`` below n."""

    def step(v: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(((v["l"] + keyed(key, kind, i, v["r"], m)) % m).alias("l"), v["r"].alias("r"))).otherwise(F.struct(v["l"].alias("l"), ((v["r"] + keyed(key, kind, i, v["l"], n)) % n).alias("r")))

    start = F.struct(left.try_cast("long").alias("l"), right.try_cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _padded(number: Column, width: Column) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 34 digits, permuted within its length."""

    def halves(d: Column) -> Column:
        h = F.floor(F.length(d) / 2).cast("int")
        rest = F.length(d) - h
        ten = lambda x: F.rpad(F.lit("1"), x + 1, "0").try_cast("long")
        out = feistel(F.substr(d, F.lit(1), h), F.substr(d, h + 1, rest), ten(h), ten(rest), key, kind)
        return let(out, lambda v: F.concat(_padded(v["l"], h), _padded(v["r"], rest)))

    return let(digits, halves)


#: The digits of base 36 and of base 62.
BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def permuted_letters(text: Column, alphabet: str, key: str, kind: str) -> Column:
    """A string over ``alphabet``, permuted within its length: each half's characters move by a keyed digest of the other half."""
    digits, base = F.lit(alphabet), len(alphabet)

    def moved(half: Column, other: Column, i: Column) -> Column:
        def by(digest: Column) -> Column:
            shift = lambda k: F.conv(F.substr(digest, (k * 2) % 64 + 1, F.lit(2)), 16, 10).try_cast("int")
            char = lambda c, k: F.substr(digits, (F.call_function("instr", digits, c) - 1 + shift(k)) % base + 1, F.lit(1))
            return F.array_join(F.transform(F.split(half, ""), char), "")

        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), F.length(half).cast("string"), other), 256)
        return F.when(F.length(half) == 0, half).otherwise(let(digest, by))

    def step(v: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(moved(v["l"], v["r"], i).alias("l"), v["r"].alias("r"))).otherwise(F.struct(v["l"].alias("l"), moved(v["r"], v["l"], i).alias("r")))

    def halves(d: Column) -> Column:
        h = F.floor(F.length(d) / 2).cast("int")
        start = F.struct(F.substr(d, F.lit(1), h).alias("l"), F.substr(d, h + 1, F.length(d) - h).alias("r"))
        return let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step), lambda v: F.concat(v["l"], v["r"]))

    return let(text, halves)


def write_back(text: Column, taken: str, new: Column) -> Column:
    """``text`` with its characters of the class ``taken`` replaced in order by those of ``new``."""

    def put(t: Column, s: Column) -> Column:
        nth = lambda i: F.length(F.regexp_replace(F.substr(t, F.lit(1), i), f"[^{taken}]", ""))
        chars = F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.when(F.substr(t, i, F.lit(1)).rlike(f"[{taken}]"), F.substr(s, nth(i), F.lit(1))).otherwise(F.substr(t, i, F.lit(1))))
        return F.array_join(chars, "")

    return let(F.struct(text.alias("t"), new.alias("s")), lambda x: put(x["t"], x["s"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_digit(digits: Column) -> Column:
    """The check digit that makes ``digits`` followed by it pass the Luhn check."""

    def summed(d: Column) -> Column:
        doubled = lambda x: F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)
        digit = lambda i: F.substr(d, F.length(d) - i, F.lit(1)).try_cast("int")
        total = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i)))
        return ((10 - total % 10) % 10).cast("string")

    return let(digits, summed)


def _chunks(digits: Column) -> Column:
    """The digits of each card of a match: 16 of several in a row, else all."""
    many = (F.length(digits) > 19) & (F.length(digits) % 16 == 0)
    size = F.when(many, F.lit(16)).otherwise(F.length(digits))
    return F.transform(F.sequence(F.lit(0), F.when(many, F.floor(F.length(digits) / 16)).otherwise(F.lit(1)) - 1), lambda i: F.substr(digits, (i * size + 1).cast("int"), size.cast("int")))


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        return let(permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card"), lambda b: F.concat(b, luhn_digit(b)))

    return let(_digits(m), lambda d: write_back(m, "0-9", F.array_join(F.transform(_chunks(d), new), "")))


def _passes_luhn(digits: Column) -> Column:
    return luhn_digit(F.substr(digits, F.lit(1), F.length(digits) - 1)) == F.substr(digits, F.length(digits), F.lit(1))


def card_pieces(run: Column) -> Column:
    """The pieces (t, kind) of a run of digits in order: its cards have the kind card, the text between them none. One pass over the run, however long it is."""
    valid = lambda m: let(_digits(m), lambda d: F.forall(_chunks(d), _passes_luhn))
    return pieces_of(run, CARD_SHAPES, lambda m: F.when(valid(m), F.lit("card")))


def pieces_of(text: Column, pattern: str, kind) -> Column:
    """The pieces (t, kind) of ``text`` in order: matches of ``pattern`` have the kind that ``kind`` gives, the text between them none."""

    def put(x: Column) -> Column:
        gaps = F.transform(x["gaps"], lambda g: F.struct(g.alias("t"), F.lit(None).cast("string").alias("kind")))
        matches = F.array_append(F.transform(x["ms"], lambda m: F.struct(m.alias("t"), kind(m).alias("kind"))), F.struct(F.lit("").alias("t"), F.lit(None).cast("string").alias("kind")))
        return F.flatten(F.zip_with(gaps, matches, lambda a, b: F.array(a, b)))

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("ms")), put)


def _phone(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        ten = F.substr(d, F.length(d) - 9, F.lit(10))
        code = F.substr(d, F.lit(1), F.length(d) - 10)
        part = lambda at, n: F.substr(ten, F.lit(at), F.lit(n)).try_cast("long")
        v = feistel((part(1, 3) - 200) * 800 + part(4, 3) - 200, part(7, 4), F.lit(640_000), F.lit(10_000), key, "phone")
        new = let(v, lambda x: F.concat(code, F.floor(x["l"] / 800 + 200).cast("string"), (x["l"] % 800 + 200).cast("string"), _padded(x["r"], F.lit(4))))
        return write_back(m, "0-9", new)

    return let(_digits(m), of)


def _world_phone(m: Column, key: str) -> Column:
    return let(_digits(m), lambda d: write_back(m, "0-9", F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted_digits(F.substr(d, F.lit(2), F.length(d) - 1), key, "world"))))


def _ssn(m: Column, key: str) -> Column:
    part = lambda i: F.split_part(m, F.lit("-"), F.lit(i)).try_cast("long")
    area = F.when(part(1) > 666, part(1) - 2).otherwise(part(1) - 1)
    v = feistel(area * 99 + part(2) - 1, part(3) - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def out(x: Column) -> Column:
        a = F.floor(x["l"] / 99)
        return F.concat_ws("-", _padded(F.when(a >= 665, a + 2).otherwise(a + 1), F.lit(3)), _padded(x["l"] % 99 + 1, F.lit(2)), _padded(x["r"] + 1, F.lit(4)))

    return let(v, out)


def _ipv4(m: Column, key: str) -> Column:
    part = lambda i: F.split_part(m, F.lit("."), F.lit(i)).try_cast("long")
    v = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536), F.lit(65536), key, "ipv4")
    return let(v, lambda x: F.concat_ws(".", F.floor(x["l"] / 256).cast("string"), (x["l"] % 256).cast("string"), F.floor(x["r"] / 256).cast("string"), (x["r"] % 256).cast("string")))


def _date(m: Column, pattern: str, key: str) -> Column:
    origin = F.lit("1900-01-01").cast("date")

    def of(d: Column) -> Column:
        days = F.date_diff(d, origin)
        high, low = DATE_SIDES
        v = feistel(F.floor(days / low), days % low, F.lit(high), F.lit(low), key, "date")
        new = let(v, lambda x: F.date_format(F.date_add(origin, (x["l"] * low + x["r"]).cast("int")), pattern))
        return F.when(d.isNull() | ~days.between(0, DATE_DAYS - 1), m).otherwise(new)

    return let(F.try_to_date(m, pattern) if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(m, F.lit(pattern))), of)


def _email(m: Column, key: str) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    taken = F.lower(F.regexp_replace(local, "[^A-Za-z0-9]", ""))
    return F.when(F.length(taken) == 0, m).otherwise(F.concat(write_back(local, "A-Za-z0-9", permuted_letters(taken, BASE36, key, "email")), F.lit("@"), domain))


def _access_key(m: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), F.upper(permuted_letters(F.lower(F.substr(m, F.lit(5), F.lit(16))), BASE36, key, "access")))


def _token(m: Column, key: str) -> Column:
    mark = F.regexp_extract(m, "^(?:ghp_|sk-)", 0)
    return F.concat(mark, permuted_letters(F.substr(m, F.length(mark) + 1, F.length(m)), BASE62, key, "token"))


def kind_of(m: Column) -> Column:
    """The kind of a match, by the first pattern that it is a match of as a whole; run for a run of digits."""
    out = F.lit("run")
    for name, pattern in (("world_phone", WORLD_PHONE), ("phone", PHONE), ("ssn", SSN), ("date", DAY_DATE), ("iso_date", ISO_DATE), ("ipv4", IPV4), ("token", TOKEN), ("access_key", ACCESS_KEY), ("email", EMAIL)):
        out = F.when(m.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """What a match becomes; itself if it isn't valid."""
    slashed = F.when(m.contains("/"), _date(m, "dd/MM/yyyy", key)).otherwise(_date(m, "dd.MM.yyyy", key))
    return (
        F.when(kind == "email", _email(m, key)).when(kind == "access_key", _access_key(m, key)).when(kind == "token", _token(m, key)).when(kind == "ipv4", _ipv4(m, key)).when(kind == "iso_date", _date(m, "yyyy-MM-dd", key))
        .when(kind == "date", slashed).when(kind == "ssn", _ssn(m, key)).when(kind == "phone", _phone(m, key)).when(kind == "world_phone", _world_phone(m, key)).otherwise(_card(m, key))
    )


def pseudonymize(docs: DataFrame, key: str, text: str = "text", found: str | None = "pseudonyms") -> DataFrame:
    """``docs`` with ``text`` pseudonymised and, if ``found`` is a name, an array of (kind, pseudonym) in order.

    All other columns stay, whatever their names, but for one named ``found``, whose place is taken. A null text stays null with no pseudonyms; so does an empty one. Rows are
    independent: repeated rows stay equal, and an empty table gives an empty one.
    """
    t = F.col(f"`{text}`")
    none = F.array().cast("array<struct<kind: string, pseudonym: string>>")

    def changed(s: Column) -> Column:
        def parts(p: Column) -> Column:
            between = lambda q: F.when(q["kind"].isNull() & (q["t"] != ""), pieces_of(q["t"], OTHER, kind_of)).otherwise(F.array(q))
            alone = F.struct(p["t"].alias("t"), F.lit(None).cast("string").alias("kind"))  # a run without a card
            cards = let(card_pieces(p["t"]), lambda c: F.flatten(F.transform(F.when(F.exists(c, lambda q: q["kind"].isNotNull()), c).otherwise(F.array(alone)), between)))
            return F.when(p["kind"] == "run", cards).otherwise(F.array(p))

        def joined(rows: Column) -> Column:
            whole = F.array_join(F.transform(rows, lambda r: r["pseudonym"]), "")
            kept = F.transform(F.filter(rows, lambda r: r["kind"].isNotNull() & (r["pseudonym"] != r["was"])), lambda r: F.struct(r["kind"].alias("kind"), r["pseudonym"].alias("pseudonym")))
            return F.struct(whole.alias("t"), kept.alias("p"))

        pieces = F.flatten(F.transform(pieces_of(s, ANY, kind_of), parts))
        return let(F.transform(pieces, lambda p: F.struct(p["kind"].alias("kind"), F.when(p["kind"].isNull(), p["t"]).otherwise(pseudonym(p["t"], p["kind"], key)).alias("pseudonym"), p["t"].alias("was"))), joined)

    asked = t.isNotNull() & t.rlike("[0-9@]|AKIA|ghp_|sk-")
    out = F.when(asked, changed(t)).otherwise(F.struct(t.alias("t"), none.alias("p")))
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    done = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in inner.items()], out.alias("pii"))
    columns = [F.col("pii.t" if c == text else i).alias(c) for c, i in inner.items() if c != found]
    return done.select(*columns, *([F.col("pii.p").alias(found)] if found else []))
