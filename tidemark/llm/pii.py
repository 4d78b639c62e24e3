"""PII: format-preserving Feistel pseudonyms for validated numbers and dates.

Candidates are found by one pattern, validated by kind, and replaced by a keyed
permutation of the values of their own format.  The same value gets the same
pseudonym in every document, so records stay linked; with the key a pseudonym can be
turned back.  Two Feistel forms are used, both with SHA-256 rounds: over strings,
adding modulo 10 or 26 to the characters of one half a hash of the other, and over
the numbers of a domain A * B, adding to one half modulo its size.

Kinds, what validates them, and what stays as it is:
  card    13 to 19 digits (single spaces or hyphens between) with a right Luhn digit;
          the first digit stays, the Luhn digit is worked out anew
  phone   + and 8 to 15 digits; the first three stay, or for 1 and ten digits whose area
          begins with 2 to 9 the first digits of area and exchange, however it is written
  ssn     ddd-dd-dddd with an area other than 000, 666, 9xx and no zero parts; area stays
  iban    two letters, two digits, 11 to 30 letters or digits with a right mod-97 remainder,
          all capitals or all small, in one piece or in groups of four; of groups the longest
          right run counts, what follows stays; the country stays, check digits are worked
          out anew, blanks stay where they are
  ipv4    four parts to 255, the first not 0
  date    yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy or dd/mm/yyyy of a real day from 1900 on;
          mm/dd/yyyy where only that is a real day, which stays such a one
  email   name@host; letters and digits of the name, of any length, host stays; letters
          beyond ASCII, of scripts that part words by spaces, move within their block
Candidates that aren't valid stay as they are.  No UDF is used anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.columns import fold_add

ROUNDS = 8
#: Characters that one SHA-256 digest moves, by 16 bits each.
BLOCK = 16
#: The registered query's key, for the test tables only; ``replace`` has no default.
QUERY_KEY = "key of the test tables"

#: Letters and marks beyond ASCII: Latin to Sinhala, and the additions to Latin and Greek.
WIDE = r"\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u0DFF\u1E00-\u1FFF"
# a name begins where the run of its characters does, so a long run is read once
EMAIL = rf"(?<![A-Za-z0-9{WIDE}._%+-])[A-Za-z0-9{WIDE}._%+-]++@[A-Za-z0-9{WIDE}-]++(?:\.[A-Za-z0-9{WIDE}-]++)++"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
_IBAN = "{0}{{2}}[0-9]{{2}}(?:[{1}0-9]{{11,30}}|(?: [{1}0-9]{{4}}){{2,7}}(?: [{1}0-9]{{1,4}})?)"
IBAN = f"(?<![A-Za-z0-9])(?:{_IBAN.format('[A-Z]', 'A-Z')}|{_IBAN.format('[a-z]', 'a-z')})(?![A-Za-z0-9])"
CARD = r"(?<![0-9.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]|-[0-9])"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, IPV4, DATE, SSN, PHONE, IBAN, CARD))

#: 200 years of 365 days from 1900-01-01; later days are left alone.
DAYS, YEARS = 365, 200


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def _digest(key: Column | str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key) if isinstance(key, str) else key, *[p.cast("string") for p in parts]), 256)


def _hex(digest: Column, at: Column) -> Column:
    """16 bits of a digest, as a number; ``at`` from 0 to 15."""
    return F.conv(F.substr(digest, at * 4 + 1, F.lit(4)), 16, 10).cast("int")


#: First code point and size of the classes of digits and letters; beyond them, blocks of 64 of WIDE.
CLASSES = [(48, 10), (65, 26), (97, 26), (0xC0, 23), (0xD8, 7), (0xDF, 24), (0xF8, 8)]
WIDE_BLOCK = 64


def _shift(c: Column, by: Column) -> Column:
    """A digit or letter moved within its own class, or block; others stay."""
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 4, "0")), "UTF-16BE")

    def moved(at: Column) -> Column:
        low = F.lit(None)
        for first, size in CLASSES:
            new = F.pmod(at - first + by, F.lit(size)) + first
            low = F.when(at.between(first, first + size - 1), F.chr(new) if first < 128 else char(new)).otherwise(low)
        block = at - at % WIDE_BLOCK
        wide = at.between(0x100, 0xDFF) | at.between(0x1E00, 0x1FFF)
        return F.coalesce(low, F.when(wide, char(block + F.pmod(at - block + by, F.lit(WIDE_BLOCK)))).otherwise(c))

    return let(F.ascii(c), moved)


def permuted_string(s: Column, key: str, back: bool = False) -> Column:
    """Feistel permutation of the strings with the same class at each place.

    Rounds take turns: even ones change the left half by a hash of the right, odd ones
    the right half by a hash of the left, with a digest of its own for every BLOCK
    characters.  One character alone has no other half: it moves by a step that only the
    key decides, never by none.
    """
    half = lambda x: F.floor(F.length(x) / 2).cast("int")

    def one(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        changed, other = F.when(even, acc["a"]).otherwise(acc["b"]), F.when(even, acc["b"]).otherwise(acc["a"])

        def add(digests: Column) -> Column:
            by = lambda i: _hex(F.get(digests, F.floor(i / BLOCK).cast("int")), i % BLOCK)
            move = lambda c, i: _shift(c, -by(i) if back else by(i))
            return F.array_join(F.transform(F.regexp_extract_all(changed, F.lit("(?s)."), F.lit(0)), move), "")

        blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.length(changed) - 1, F.lit(0)) / BLOCK).cast("int"))
        new = let(F.transform(blocks, lambda b: _digest(key, F.lit("s"), F.length(acc["a"]), r, b, other)), add)
        return F.struct(F.when(even, new).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(new).alias("b"))

    rounds = F.array(*[F.lit(r) for r in (range(ROUNDS - 1, -1, -1) if back else range(ROUNDS))])
    start = F.struct(F.substr(s, F.lit(1), half(s)).alias("a"), F.substr(s, half(s) + 1).alias("b"))
    out = F.aggregate(rounds, start, one, lambda x: F.concat(x["a"], x["b"]))

    def alone(h: Column) -> Column:
        step = lambda size: (1 + h % (size - 1)) * (-1 if back else 1)
        return F.when(s.rlike("^[0-9]$"), _shift(s, step(10))).otherwise(_shift(s, step(26)))

    return F.when(F.length(s) > 1, out).when(F.length(s) == 1, let(_hex(_digest(key, F.lit("one")), F.lit(0)), alone)).otherwise(s)


def permuted_number(n: Column, a: int, b: int, key: str, tweak: str, back: bool = False) -> Column:
    """Feistel permutation of 0 to a * b - 1."""

    def one(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        h = F.conv(F.substr(_digest(key, F.lit(tweak), r, F.when(even, acc["y"]).otherwise(acc["x"])), F.lit(1), F.lit(12)), 16, 10).cast("long")
        h = -h if back else h
        return F.struct(F.when(even, F.pmod(acc["x"] + h, F.lit(a).cast("long"))).otherwise(acc["x"]).alias("x"), F.when(even, acc["y"]).otherwise(F.pmod(acc["y"] + h, F.lit(b).cast("long"))).alias("y"))

    rounds = F.array(*[F.lit(r) for r in (range(ROUNDS - 1, -1, -1) if back else range(ROUNDS))])
    whole = n.cast("long")
    start = F.struct(F.floor(whole / b).cast("long").alias("x"), F.pmod(whole, F.lit(b).cast("long")).alias("y"))
    return F.aggregate(rounds, start, one, lambda x: x["x"] * b + x["y"])


def _only(s: Column, drop: str = "[^0-9]+") -> Column:
    return F.regexp_replace(s, drop, "")


def _luhn(digits: Column, doubled: int) -> Column:
    """Luhn sum; places are counted from the right, those of the parity ``doubled`` count twice."""
    each = F.transform(
        F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)),
        lambda c, i: F.when(i % 2 == doubled, F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int")),
    )
    return F.aggregate(each, F.lit(0), fold_add)


def _filled(form: Column, digits: Column) -> Column:
    """The digits of ``form`` replaced in order by ``digits``; all else stays."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    step = lambda a, c: F.when(
        c.rlike("^[0-9]$"), F.struct(F.concat(a["out"], F.substr(digits, a["n"] + 1, F.lit(1))).alias("out"), (a["n"] + 1).alias("n"))
    ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["n"].alias("n")))
    return F.aggregate(F.regexp_extract_all(form, F.lit("(?s)."), F.lit(0)), start, step, lambda a: a["out"])


def _card(m: Column, key: str, back: bool) -> Column:
    def digits_of(d: Column) -> Column:
        body = let(F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted_string(F.substr(d, F.lit(2), F.length(d) - 2), key + "card", back)), lambda b: F.concat(b, F.pmod(-_luhn(b, 0), F.lit(10)).cast("string")))
        return F.when(_luhn(d, 1) % 10 == 0, let(body, lambda x: _filled(m, x))).otherwise(m)

    return let(_only(m), digits_of)


def _phone(m: Column, key: str, back: bool) -> Column:
    def digits_of(d: Column) -> Column:
        part = lambda a, n: F.substr(d, F.lit(a), F.lit(n))
        free = permuted_string(F.concat(part(3, 2), part(6, 6)), key + "phone", back)
        nanp = let(free, lambda f: F.concat(part(1, 2), F.substr(f, F.lit(1), F.lit(2)), part(5, 1), F.substr(f, F.lit(3))))
        other = F.concat(part(1, 3), permuted_string(F.substr(d, F.lit(4)), key + "phone", back))
        new = F.when((F.length(d) == 11) & d.rlike("^1[2-9]"), nanp).when(F.length(d).between(8, 15), other).otherwise(d)
        return let(new, lambda x: _filled(m, x))

    return let(_only(m), digits_of)


def _ssn(m: Column, key: str, back: bool) -> Column:
    n = (F.substr(m, F.lit(5), F.lit(2)).cast("int") - 1) * 9999 + F.substr(m, F.lit(8), F.lit(4)).cast("int") - 1
    new = let(permuted_number(n, 99, 9999, key, "ssn", back), lambda x: F.concat(F.substr(m, F.lit(1), F.lit(4)), F.lpad((F.floor(x / 9999) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((x % 9999 + 1).cast("string"), 4, "0")))
    return F.when(m.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), new).otherwise(m)


def _mod97(s: Column) -> Column:
    """Remainder of capitals and digits read as a number, letters as 10 to 35."""
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.regexp_extract_all(s, F.lit("."), F.lit(0)), F.lit(0), lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97))


def _iban(m: Column, key: str, back: bool) -> Column:
    def valid(x: Column) -> Column:
        return (F.length(x) >= 15) & (_mod97(F.upper(F.concat(F.substr(x, F.lit(5)), F.substr(x, F.lit(1), F.lit(4))))) == 1)

    def bare(x: Column) -> Column:
        country, body = F.substr(x, F.lit(1), F.lit(2)), F.substr(x, F.lit(5))
        return let(permuted_string(body, key + "iban", back), lambda b: F.concat(country, F.lpad((98 - _mod97(F.upper(F.concat(b, country, F.lit("00"))))).cast("string"), 2, "0"), b))

    # the longest run of groups that is valid, and its pseudonym in groups again
    groups = F.split(m, " ")
    joined = lambda n: F.array_join(F.slice(groups, F.lit(1), n), "")
    longest = F.array_max(F.filter(F.sequence(F.lit(3), F.size(groups)), lambda n: valid(joined(n))))
    spaced = lambda n: F.concat(F.trim(F.regexp_replace(bare(joined(n)), "(.{4})", "$1 ")), F.substr(m, F.length(F.array_join(F.slice(groups, F.lit(1), n), " ")) + 1))
    grouped = F.when(F.size(groups) >= 3, let(longest, lambda n: F.when(n.isNotNull(), spaced(n)).otherwise(m))).otherwise(m)
    return F.when(m.contains(" "), grouped).when(valid(m), bare(m)).otherwise(m)


def _ipv4(m: Column, key: str, back: bool) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("long"))
    valid = F.forall(parts, lambda p: p <= 255) & (parts[0] >= 1) & ~m.rlike(r"(^|\.)0[0-9]")
    n = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p) - (1 << 24)
    new = let(permuted_number(n, 255 * 256, 65536, key, "ipv4", back), lambda x: let(x + (1 << 24), lambda y: F.concat_ws(".", *[F.pmod(F.floor(y / 256**k).cast("long"), F.lit(256).cast("long")).cast("string") for k in (3, 2, 1, 0)])))
    return F.when(valid, new).otherwise(m)


def _date(m: Column, key: str, back: bool) -> Column:
    form = F.when(m.rlike("^[0-9]{4}-"), "yyyy-MM-dd").when(m.rlike("^[0-9]{4}/"), "yyyy/MM/dd").when(m.rlike(r"^[0-9]{2}\."), "dd.MM.yyyy").otherwise("dd/MM/yyyy")
    year_first = m.rlike("^[0-9]{4}")
    iso = F.when(year_first, F.concat_ws("-", F.substr(m, F.lit(1), F.lit(4)), F.substr(m, F.lit(6), F.lit(2)), F.substr(m, F.lit(9), F.lit(2)))).otherwise(F.concat_ws("-", F.substr(m, F.lit(7), F.lit(4)), F.substr(m, F.lit(4), F.lit(2)), F.substr(m, F.lit(1), F.lit(2))))
    day = F.datediff(iso.try_cast("date"), F.lit("1900-01-01").cast("date"))
    new = lambda d: let(permuted_number(d, YEARS, DAYS, key, "date", back), lambda x: F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), x.cast("int")), "yyyy-MM-dd"))

    def written(i: Column) -> Column:
        y, mo, d = F.substr(i, F.lit(1), F.lit(4)), F.substr(i, F.lit(6), F.lit(2)), F.substr(i, F.lit(9), F.lit(2))
        return F.when(form == "yyyy-MM-dd", i).when(form == "yyyy/MM/dd", F.concat_ws("/", y, mo, d)).when(form == "dd.MM.yyyy", F.concat_ws(".", d, mo, y)).otherwise(F.concat_ws("/", d, mo, y))

    other = F.when(m.rlike("^[0-9]{2}/"), _month_first(m, key, back)).otherwise(m)
    return let(day, lambda d: F.when(d.between(0, YEARS * DAYS - 1), let(new(d), written)).otherwise(F.when(d.isNull(), other).otherwise(m)))


#: Days after the 12th before each month, and in a year, the 29th of February apart.
LATE_DAYS = [0, 19, 35, 54, 72, 91, 109, 128, 147, 165, 184, 202]
LATE_IN_YEAR = 221
#: Leap years from 1904 to 2096.
LEAP_YEARS = 49


def _month_first(m: Column, key: str, back: bool) -> Column:
    """A real day written as mm/dd/yyyy that can't be read as dd/mm/yyyy; it is moved among those."""
    part = lambda at, n: F.substr(m, F.lit(at), F.lit(n)).cast("int")
    month, day, year = part(1, 2), part(4, 2), part(7, 4)
    real = F.concat_ws("-", F.substr(m, F.lit(7), F.lit(4)), F.substr(m, F.lit(1), F.lit(2)), F.substr(m, F.lit(4), F.lit(2))).try_cast("date").isNotNull()
    before = F.array(*[F.lit(n) for n in LATE_DAYS])
    two = lambda n: F.lpad(n.cast("string"), 2, "0")

    def written(n: Column) -> Column:
        in_year, mo = F.pmod(n, F.lit(LATE_IN_YEAR)).cast("int"), lambda d: F.size(F.filter(before, lambda b: b <= d))
        return F.concat_ws("/", two(mo(in_year)), two(in_year - F.get(before, mo(in_year) - 1) + 13), (F.floor(n / LATE_IN_YEAR) + 1900).cast("string"))

    late = permuted_number((year - 1900) * LATE_IN_YEAR + F.get(before, month - 1) + day - 13, YEARS, LATE_IN_YEAR, key, "late", back)
    leap = permuted_number(F.floor(year / 4) - 476, 7, 7, key, "leap", back)
    leap_day = let(leap, lambda n: F.concat(F.lit("02/29/"), (n * 4 + 1904).cast("string")))
    return F.when(~real | (day < 13) | ~year.between(1900, 1900 + YEARS - 1), m).when((month == 2) & (day == 29), leap_day).otherwise(let(late, written))


def _email(m: Column, key: str, back: bool) -> Column:
    return F.concat(permuted_string(F.substring_index(m, "@", 1), key + "email", back), F.lit("@"), F.substring_index(m, "@", -1))


def pseudonym(m: Column, key: str, back: bool = False) -> Column:
    """Pseudonym of one matched value; unchanged if it isn't valid."""
    kind = lambda p: m.rlike(f"^(?:{p})$")
    chosen = F.when(m.contains("@"), _email(m, key, back)).when(m.startswith("+"), _phone(m, key, back)).when(kind(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), _ipv4(m, key, back))
    chosen = chosen.when(kind(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), _ssn(m, key, back)).when(m.rlike("^[A-Za-z]"), _iban(m, key, back))
    return chosen.when(F.length(m) == 10, _date(m, key, back)).otherwise(_card(m, key, back))


def replace(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """doc_id, text, n_found, n_replaced; one row for each input row, equal rows alike.

    text: the text with its valid values replaced; a text without any, an empty or a
    null one is unchanged.  n_found: candidates; n_replaced: those whose text changed
    (a pseudonym may equal its value).  Texts are read whole, however long, one pass a
    pattern; a null doc_id stays null.  Other columns are ignored, whatever their names.
    The key is the caller's to keep: who has it can turn pseudonyms back.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    found = F.when(F.col("text").rlike(ANY), F.regexp_extract_all(F.col("text"), F.lit(ANY), F.lit(0)))
    between = F.split(F.col("text"), ANY, -1)
    df = docs.select("doc_id", "text").withColumn("found", found)
    df = df.withColumn("new", F.transform("found", lambda m: pseudonym(m, key, back)))
    joined = F.array_join(F.zip_with(between, F.col("new"), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with("found", "new", lambda a, b: a != b), lambda x: x))
    return df.select(
        "doc_id", F.when(F.col("found").isNotNull(), joined).otherwise(F.col("text")).alias("text"),
        F.when(F.col("found").isNotNull(), F.size("found")).otherwise(0).cast("long").alias("n_found"),
        F.when(F.col("found").isNotNull(), changed).otherwise(0).cast("long").alias("n_replaced"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY_KEY)
