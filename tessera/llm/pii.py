"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Values are found by pattern, validated (card numbers by their check digit, addresses by their octets, dates by the
calendar) and replaced by the image under a keyed Feistel permutation of their own format: same length, punctuation and
validity, and equal values get equal pseudonyms in every document. Rounds are SHA-256 of key, kind, length, round and
the other half. What fails validation stays as it is.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import free_name, table

ROUNDS = 8
#: Dates stay within their span of this many years.
YEARS = 200
#: Walks after which a permutation that left the valid values gives up; each ends with a chance of 0.97 or more.
WALKS = 16

#: Kinds in the order in which they are tried at a position.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "key": r"(?<![0-9A-Za-z_-])(?:sk-[0-9A-Za-z_-]{20,}+|gh[opsur]_[0-9A-Za-z]{36,}+|AKIA[0-9A-Z]{16}|xox[abprs]-[0-9A-Za-z-]{10,}+)(?![0-9A-Za-z_-])",
    "secret": r"(?<=\")[0-9A-Fa-f]{16,64}(?=\")|(?<=[\"'])(?<=(?i:password|passwd|pwd|secret|token|api_?key)[ \t]{0,4}[=:][ \t]{0,4}[\"'])[^\"'\s]{6,128}(?=[\"'])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[23Ff][0-9A-Fa-f]{3}:(?:[0-9A-Fa-f]{1,4}:){0,5}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:.])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "iso_date": r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z]|-[0-9])",
    "date": r"(?<![0-9A-Za-z./])[0-9]{1,2}(?:\.[0-9]{1,2}\.|/[0-9]{1,2}/)[0-9]{4}(?![0-9A-Za-z/]|\.[0-9])",
    "phone": r"\+[0-9]{1,3}[^0-9A-Za-z\n+()]{0,5}(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[^0-9A-Za-z\n+()]{0,5}[0-9]{2,4}){2,3}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
DIGITS, LETTERS, AS_BASE_26 = "[0-9]", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"


def _mix(key: str, kind: Column | str, n: Column, i: Column, x: Column, mod: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, n.cast("string"), i.cast("string"), x.cast("string")).cast("binary"), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), mod)


def feistel(key: str, kind: str, n: Column, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """struct(a, b): the image of the pair (a below size_a, b below size_b) under a keyed permutation."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, F.pmod(s["a"] + _mix(key, kind, n, i, s["b"], size_a), size_a)).otherwise(s["a"])
        right = F.when(i % 2 == 1, F.pmod(s["b"] + _mix(key, kind, n, i, s["a"], size_b), size_b)).otherwise(s["b"])
        return F.struct(left.alias("a"), right.alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _power(radix: int, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(radix**i) for i in range(11 if radix == 10 else 9)]), n + 1).cast("long")


def permute(key: str, kind: str, s: Column, radix: int) -> Column:
    """The image of a string of radix symbols (0-9, a-z) among the strings of its length, piece by piece."""
    half = 10 if radix == 10 else 8
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(s) / (2 * half)).cast("int") - 1, F.lit(0))), lambda i: F.substr(s, i * (2 * half) + 1, F.lit(2 * half)))

    def one(x: Column) -> Column:
        n = F.length(x)
        la = (n / 2).cast("int")
        number = lambda t: F.coalesce(F.conv(F.when(t == "", "0").otherwise(t), radix, 10).cast("long"), F.lit(0).cast("long"))
        out = feistel(key, kind, F.length(s), number(F.substr(x, F.lit(1), la)), number(F.substr(x, la + 1)), _power(radix, la), _power(radix, n - la))
        text = lambda v, w: F.when(w > 0, F.lpad(F.lower(F.conv(v.cast("string"), 10, radix)), w, F.lit("0"))).otherwise("")
        # the image is computed once, as the only element of an array
        return F.element_at(F.transform(F.array(out), lambda o: F.concat(text(o["a"], la), text(o["b"], n - la))), 1)

    return F.when(s == "", s).otherwise(F.array_join(F.transform(parts, one), ""))


def refill(shape: Column, symbols: Column, which: str) -> Column:
    """shape with its characters that match `which` replaced by the symbols in turn; capitals stay capitals."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        hit = c.rlike(which)
        x = F.substr(symbols, s["k"], F.lit(1))
        x = F.when(c != F.lower(c), F.upper(x)).otherwise(x)
        return F.struct(F.concat(s["out"], F.when(hit, x).otherwise(c)).alias("out"), (s["k"] + hit.cast("int")).alias("k"))

    return F.aggregate(F.split(shape, ""), start, step)["out"]


def luhn_sum(digits: Column, shift: int = 0) -> Column:
    """The Luhn sum of a digit string whose last digit stands `shift` places from the right."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return s + F.when((i + shift) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def by_class(key: str, kind: str, s: Column) -> Column:
    """The image of s where digits turn into digits, small letters into small and capitals into capital letters."""

    def letters(which: str) -> Column:
        own = F.translate(F.lower(F.regexp_replace(s, f"[^{which}]", "")), LETTERS, AS_BASE_26)
        return F.translate(permute(key, f"{kind}{which}", own, 26), AS_BASE_26, LETTERS)

    out = refill(s, permute(key, kind, F.regexp_replace(s, "[^0-9]", ""), 10), DIGITS)
    return refill(refill(out, letters("a-z"), "[a-z]"), letters("A-Z"), "[A-Z]")


def _bind(value: Column, f) -> Column:
    """f(value), with the value computed once (as the only element of an array) however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _month_days(y: Column, m: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    days = F.get(F.array(*[F.lit(d) for d in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)]), m.cast("int") - 1)
    return days + F.when((m == 2) & leap, 1).otherwise(0)


def _date(key: str, m: Column) -> Column:
    """Pseudonym of a calendar date among the dates of its form (separator, order, digits of day and month), else null.

    A day before its month is told from a month before its day by a first number above 12.
    """
    part = F.split(m, "[-./]")
    iso, dot = m.rlike("^[0-9]{4}-"), m.contains(".")
    day_first = dot | (~iso & (F.get(part, F.lit(0)).cast("int") > 12))
    pick = lambda i, d, u: F.when(iso, F.get(part, F.lit(i))).when(day_first, F.get(part, F.lit(d))).otherwise(F.get(part, F.lit(u)))
    shape = F.struct(pick(0, 2, 2).alias("y"), pick(1, 1, 0).alias("m"), pick(2, 0, 1).alias("d"))

    def of(t: Column) -> Column:
        y, mo, d = (t[x].cast("long") for x in "ymd")
        months = F.when(F.length(t["m"]) == 1, 9).otherwise(12).cast("long")
        late = day_first & ~dot
        low = F.when(late, 13).otherwise(1).cast("long")
        days = F.when(late, 19).when(F.length(t["d"]) == 1, 9).otherwise(31).cast("long")
        form = F.when(iso, 0).when(dot, 1).when(late, 2).otherwise(3) * 100 + F.length(t["m"]) * 10 + F.length(t["d"])
        base = y - y % YEARS

        def valid(a: Column, b: Column) -> Column:
            year, month, day = base + a, F.floor(b / days) + 1, b % days + low
            return (year >= 1) & (day <= _month_days(year, month))

        def walk(s: Column, i: Column) -> Column:
            turned = feistel(key, "date", form, s["a"], s["b"], F.lit(YEARS).cast("long"), months * days)
            return F.when(s["ok"], s).otherwise(_bind(turned, lambda o: F.struct(o["a"].alias("a"), o["b"].alias("b"), valid(o["a"], o["b"]).alias("ok"))))

        start = F.struct((y - base).alias("a"), ((mo - 1) * days + d - low).alias("b"), F.lit(False).alias("ok"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), start, walk)

        def written(s: Column) -> Column:
            pad = lambda v, n: F.lpad(v.cast("long").cast("string"), n, F.lit("0"))
            year, month, day = pad(base + s["a"], F.lit(4)), pad(F.floor(s["b"] / days) + 1, F.length(t["m"])), pad(s["b"] % days + low, F.length(t["d"]))
            slash = F.lit("/")
            return F.when(iso, F.concat(year, F.lit("-"), month, F.lit("-"), day)).when(dot, F.concat(day, F.lit("."), month, F.lit("."), year)).when(day_first, F.concat(day, slash, month, slash, year)).otherwise(F.concat(month, slash, day, slash, year))

        real = (y >= 1) & mo.between(1, 12) & (d >= 1) & (d <= _month_days(y, F.least(mo, F.lit(12))))
        return F.when(real, _bind(end, written))

    return _bind(shape, of)


def _ssn(key: str, digits: Column) -> Column:
    """Image of nine digits among the valid numbers: 898 areas (not 000, 666, 9xx), 99 groups, 9,999 serials."""
    n = lambda i, k: F.substr(digits, F.lit(i), F.lit(k)).cast("long")
    area = n(1, 3) - 1 - F.when(n(1, 3) > 666, 1).otherwise(0)
    out = feistel(key, "ssn", F.lit(9), area * 99 + n(4, 2) - 1, n(6, 4) - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"))

    def written(o: Column) -> Column:
        a = F.floor(o["a"] / 99) + 1
        pad = lambda v, k: F.lpad(v.cast("long").cast("string"), k, F.lit("0"))
        return F.concat(pad(a + F.when(a >= 666, 1).otherwise(0), 3), pad(o["a"] % 99 + 1, 2), pad(o["b"] + 1, 4))

    return _bind(out, written)


def _mod97(s: Column) -> Column:
    """The number that s (0-9, A-Z as 10 to 35) spells, modulo 97."""

    def add(r: Column, c: Column) -> Column:
        v = F.conv(c, 36, 10).cast("long")
        return (r * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.split(s, ""), F.lit(0).cast("long"), add)


def _iban(key: str, m: Column) -> Column:
    """Country and form stay, the account is permuted by class and the check digits are made anew."""
    account = by_class(key, "iban", F.substr(m, F.lit(5)))

    def written(x: Column) -> Column:
        country = F.substr(m, F.lit(1), F.lit(2))
        check = 98 - _mod97(F.concat(F.replace(x, F.lit(" "), F.lit("")), country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, F.lit("0")), x)

    return _bind(account, written)


def kind_of(m: Column) -> Column:
    """The kind of a found value, or null if it is not valid. A quoted secret in the form of another kind counts as that."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    octets = F.forall(F.split(m, r"\."), lambda o: F.when(o.rlike("^[0-9]{1,3}$"), o.cast("int") < 256).otherwise(False))
    bare = F.replace(m, F.lit(" "), F.lit(""))
    return (
        F.when(m.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"), "email")
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.when(octets, "ip"))
        .when(m.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})$"), "date")
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(~m.rlike("^(000|666|9)|-00-|-0000$"), "ssn"))
        .when(m.rlike(r"^(\+[0-9][^A-Za-z]*|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})$"), F.when(F.length(digits).between(7, 15), "phone"))
        .when(m.rlike("^[0-9](?:[ -]?[0-9]){12,18}$"), F.when(luhn_sum(digits) % 10 == 0, "card"))
        .when(m.rlike("^(sk-|gh[opsur]_|AKIA|xox[abprs]-)"), "key")
        .when(m.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z ]{8,}$"), F.when(_mod97(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))) == 1, "iban"))
        .when(m.rlike("^[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]+$"), "ipv6")
        .otherwise("secret")
    )


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a found value; the value itself if it is not valid."""
    kind, digits = kind_of(m), F.regexp_replace(m, "[^0-9]", "")
    octet = lambda i: F.split(m, r"\.")[i].cast("long")
    ip = feistel(key, "ip", F.lit(32), octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536))
    ip = F.element_at(F.transform(F.array(ip), lambda o: F.concat_ws(".", *[x.cast("string") for x in (F.shiftright(o["a"], 8), o["a"] % 256, F.shiftright(o["b"], 8), o["b"] % 256)])), 1)
    # a card keeps a valid check digit: all digits before it are permuted, then it is computed anew
    body = permute(key, "card", F.substr(digits, F.lit(1), F.length(digits) - 1), 10)
    card = F.element_at(F.transform(F.array(body), lambda b: F.concat(b, ((10 - luhn_sum(b, 1) % 10) % 10).cast("string"))), 1)
    # a leading country code stays
    code = F.when(m.startswith("+"), F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[^0-9])", 0)).otherwise("")
    rest = F.substr(m, F.length(code) + 1)
    phone = F.concat(code, refill(rest, permute(key, "phone", F.regexp_replace(rest, "[^0-9]", ""), 10), "[0-9]"))
    local = F.substring_index(m, "@", 1)
    email = F.concat(refill(local, permute(key, "email", F.lower(F.regexp_replace(local, "[^A-Za-z0-9]", "")), 36), "[A-Za-z0-9]"), F.lit("@"), F.substring_index(m, "@", -1))
    hexed = lambda name: refill(m, permute(key, name, F.lower(F.regexp_replace(m, "[^0-9A-Fa-f]", "")), 16), "[0-9A-Fa-f]")
    secret = F.when(m.rlike("^[0-9A-Fa-f]+$"), hexed("secret")).otherwise(by_class(key, "secret", m))
    mark = F.regexp_extract(m, "^(sk-|gh[opsur]_|AKIA|xox[abprs]-)", 0)
    api = F.concat(mark, by_class(key, "key", F.substr(m, F.length(mark) + 1)))
    made = {"email": email, "ip": ip, "date": _date(key, m), "ssn": refill(m, _ssn(key, digits), DIGITS), "phone": phone, "card": refill(m, card, DIGITS), "secret": secret, "key": api, "iban": _iban(key, m), "ipv6": hexed("ipv6")}
    out = F.lit(None).cast("string")
    for name, value in made.items():
        out = F.when(kind == name, value).otherwise(out)
    return F.coalesce(out, m)


def holds_any(text: Column) -> Column:
    """Whether a text holds a match of ANY. Kind by kind, each behind a character that it needs, this takes a fraction of
    the time of the alternation, which then only reads texts with a hit."""
    digit = text.rlike("[0-9]")
    has = lambda *parts: reduce(or_, [text.contains(p) for p in parts])
    needs = {"email": has("@"), "key": has("sk-", "gh", "AKIA", "xox"), "secret": has('"', "'"), "ipv6": has(":")}
    return reduce(or_, [needs.get(kind, digit) & text.rlike(p) for kind, p in PATTERNS.items()])


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs (text, more) with a last struct column `pii`: text (values replaced), n_found, n_replaced, kinds (sorted).

    Under one key equal values of a kind get equal pseudonyms in all rows, different ones different (e-mail addresses and
    hexadecimal digits are equal whatever their case); another key gives other pseudonyms, and who has the key can undo
    them. A value found but not valid (a failed check digit, no such day) stays and counts in n_found only.
    A null text stays null with counts 0, an empty one empty. Whole texts of any length are searched. Repeated rows get
    equal results. All columns stay as they are; the struct's name gets underscores on a clash. Empty table: no rows.
    """
    r = free_name(docs, "row")
    text = F.col(f"{r}.text")
    row = docs.select(F.struct("*").alias(r)).withColumn("hits", F.when(holds_any(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    row = row.withColumn("made", F.transform("hits", lambda m: pseudonym(m, key)))
    row = row.withColumn("kinds", F.sort_array(F.array_distinct(F.filter(F.transform("hits", kind_of), lambda k: k.isNotNull()))))
    # the text between the values, and after each piece its value's replacement (nothing after the last)
    whole = F.array_join(F.transform(F.split(text, ANY), lambda piece, i: F.concat(piece, F.coalesce(F.get("made", i), F.lit("")))), "")
    changed = F.size(F.filter(F.arrays_zip("hits", "made"), lambda z: z["hits"] != z["made"]))
    none = F.col("hits").isNull()
    made = F.struct(
        F.when(none, text).otherwise(whole).alias("text"),
        F.when(none, 0).otherwise(F.size("hits")).cast("long").alias("n_found"),
        F.when(none, 0).otherwise(changed).cast("long").alias("n_replaced"),
        F.when(none, F.array().cast("array<string>")).otherwise(F.col("kinds")).alias("kinds"),
    )
    # the result before the star: an expanded column would take the place of one of the same name here
    name = free_name(docs, "pii")
    return row.select(r, made.alias(name)).select(f"{r}.*", name)


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's spark.tessera.pii.key; without one, a fixed key that protects nothing (tests, checks)."""
    key = spark.conf.get("spark.tessera.pii.key", "not secret: for tests and checks")
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    return out.select("doc_id", "pii.n_found", "pii.n_replaced", F.array_join("pii.kinds", ",").alias("kinds"), "pii.text")
