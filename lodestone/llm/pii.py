"""Format-preserving pseudonyms for personal numbers, dates and addresses, by keyed Feistel permutations.

Found and validated: payment cards (Luhn), IBANs (mod 97), social security numbers (assigned ranges), telephone
numbers (7 to 15 digits), IPv4 addresses (octets), calendar dates from 1900 to 2099 and e-mail addresses.
A value is permuted inside its own format: a card stays a valid card of the same length, a date a date
written the same way, separators stay where they are. The permutation depends only on key, kind and
value, so equal values stay equal in every document and different ones stay different. Of an e-mail
address the local part is replaced by a keyed digest of its lower-case form. Built-in expressions only.

Defined results: text that fails validation stays as it is; a null text stays null, an empty one empty;
null ids and repeated rows pass through row by row; the text column and the count columns are set, all
other columns are kept (a column with the name of a count is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import let

ROUNDS = 10
KINDS = ("email", "ip", "date", "iban", "card", "ssn", "phone")

EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?!\d|[./-]\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!\d|-\d)"
#: A telephone number ends before a space and an address, a date or a social security number, and keeps its separator.
_NEXT = rf"(?! (?:\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?!\d|\.\d)|\d{{4}}[-/]\d{{2}}[-/]\d{{2}}|\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}}|\d{{3}}-\d{{2}}-\d{{4}}))"
PHONE = (
    r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    rf"|(?<![\w+])\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)|\d{{1,4}}){_NEXT}[ .-]?\d{{2,4}}(?:{_NEXT}(?<sep>[ .-]?)\d{{2,4}}(?:{_NEXT}\k<sep>\d{{2,4}}){{0,2}})?(?!\d)"
    r"|(?<![\w+-])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w+.-])(?:1(?=[.-]))?(?:(?<=1)[.-])?\d{3}(?<dot>[.-])\d{3}\k<dot>\d{4}(?!\d|[.-]\d)"
)
#: Groups that may hold cards and IBANs, one after the other; what in them is one is decided by their checksums.
_END = r"(?!\w|[./-]\d|[A-Za-z0-9._%+-]*@)"
RUN = (
    r"(?<![\w+-])(?=(?: ?\d){13}|[A-Z]{2}\d{2} ?[A-Z0-9])[A-Z0-9]+(?: [A-Z0-9]+)*" + _END
    + r"|(?<![\w+-])(?=(?:-?\d){13})\d+(?:-\d+)+" + _END
)
#: Tried in this order at every place; named groups are only used inside PHONE.
PATTERN = "|".join([EMAIL, IP, DATE, SSN, RUN, PHONE])

FIRST_DAY, DAYS = "1900-01-01", 73_049
#: 271 * 270 is just above the number of days, so hardly any value has to walk on.
DAY_SIDES = (271, 270)
POWERS = [10**i for i in range(19)]


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p).cast("long") for p in POWERS]), n.cast("int") + 1)


def keyed(key: str, *parts: Column) -> Column:
    """60 pseudo-random bits."""
    digest = F.sha2(F.concat_ws(":", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, a_size: Column, b_size: Column, tag: Column, key: str) -> Column:
    """struct(a, b): the pair (a < a_size, b < b_size) after an even number of alternating rounds."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(s, i):
        even = i % 2 == 0
        new_a = F.pmod(s["a"] + F.pmod(keyed(key, tag, i, s["b"]), a_size), a_size)
        new_b = F.pmod(s["b"] + F.pmod(keyed(key, tag, i, s["a"]), b_size), b_size)
        return F.struct(
            F.when(even, new_a).otherwise(s["a"]).cast("long").alias("a"),
            F.when(even, s["b"]).otherwise(new_b).cast("long").alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permuted_digits(digits: Column, kind: str, key: str) -> Column:
    """A digit string of 2 to 36 digits under the permutation of its kind and length."""

    def halves(d):
        n = F.length(d)
        left = F.floor(n / 2).cast("int")
        right = n - left
        got = feistel(
            F.left(d, left).cast("long"), F.right(d, right).cast("long"), power(left), power(right), F.concat_ws("-", F.lit(kind), n), key
        )
        return let(got, lambda s: F.concat(F.lpad(s["a"].cast("string"), left, "0"), F.lpad(s["b"].cast("string"), right, "0")))

    return let(digits, halves)


def put_digits(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order by ``digits``."""

    def fill(p):
        parts, d = p["parts"], p["d"]
        step = F.aggregate(
            parts,
            F.struct(F.lit("").alias("s"), F.lit(0).alias("i")),
            lambda s, c: F.when(
                c.between("0", "9"), F.struct(F.concat(s["s"], F.substr(d, s["i"] + 1, F.lit(1))).alias("s"), (s["i"] + 1).alias("i"))
            ).otherwise(F.struct(F.concat(s["s"], c).alias("s"), s["i"].alias("i"))),
        )
        return step["s"]

    chars = F.regexp_extract_all(shape, F.lit("(?s)."), F.lit(0))
    return let(F.struct(chars.alias("parts"), digits.alias("d")), fill)


def card(x: Column, key: str) -> Column:
    """All digits but the last are permuted; the last is the new check digit."""

    def renewed(d):
        body = permuted_digits(F.left(d, F.length(d) - 1), "card", key)
        return let(
            body,
            lambda b: F.concat(
                b, F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: F.call_function("luhn_check", F.concat(b, c.cast("string"))))[0].cast("string")
            ),
        )

    return let(digits_of(x), lambda d: F.when(F.call_function("luhn_check", d), put_digits(x, renewed(d))).otherwise(x))


def mod97(rearranged: Column) -> Column:
    """Remainder of letters-and-digits text read as a number, A being 10."""
    chars = F.regexp_extract_all(rearranged, F.lit("."), F.lit(0))
    return F.aggregate(
        chars,
        F.lit(0).cast("long"),
        lambda r, c: F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97).cast("long"),
    )


def iban(x: Column, key: str) -> Column:
    """The account part's digits are permuted and the check digits follow."""

    def renewed(c):
        country, account = F.left(c, F.lit(2)), F.substr(c, F.lit(5))
        body = let(F.struct(account.alias("c"), digits_of(account).alias("d")), lambda p: F.when(F.length(p["d"]) >= 2, put_digits(p["c"], permuted_digits(p["d"], "iban", key))).otherwise(p["c"]))
        return let(body, lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))

    def spaced(p):
        # Spaces go back to where they were.
        return F.aggregate(
            F.regexp_extract_all(p["x"], F.lit("."), F.lit(0)),
            F.struct(F.lit("").alias("s"), F.lit(0).alias("i")),
            lambda s, c: F.when(c == " ", F.struct(F.concat(s["s"], c).alias("s"), s["i"].alias("i"))).otherwise(
                F.struct(F.concat(s["s"], F.substr(p["y"], s["i"] + 1, F.lit(1))).alias("s"), (s["i"] + 1).alias("i"))
            ),
        )["s"]

    def whole(c):
        valid = mod97(F.concat(F.substr(c, F.lit(5)), F.left(c, F.lit(4)))) == 1
        return F.when(valid, let(F.struct(x.alias("x"), renewed(c).alias("y")), spaced)).otherwise(x)

    return let(F.replace(x, F.lit(" ")), whole)


def ssn(x: Column, key: str) -> Column:
    """Area, group and serial are permuted within the assigned ranges."""

    def renewed(d):
        area, group, serial = (F.substr(d, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
        valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        slot = F.when(area > 666, area - 2).otherwise(area - 1)  # 0 to 897
        got = feistel(slot * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), F.lit("ssn"), key)

        def written(s):
            low = F.floor(s["a"] / 99) + 1
            number = F.when(low >= 666, low + 1).otherwise(low)
            return F.concat(
                F.lpad(number.cast("string"), 3, "0"), F.lit("-"), F.lpad((s["a"] % 99 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((s["b"] + 1).cast("string"), 4, "0")
            )

        return F.when(valid, let(got, written)).otherwise(x)

    return let(digits_of(x), renewed)


def ip(x: Column, key: str) -> Column:
    def renewed(o):
        a, b = o[0] * 256 + o[1], o[2] * 256 + o[3]
        size = F.lit(65_536).cast("long")

        def written(s):
            return F.concat_ws(".", F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)

        return F.when(F.array_max(o) <= 255, let(feistel(a, b, size, size, F.lit("ip"), key), written)).otherwise(x)

    return let(F.transform(F.split(x, r"\."), lambda p: p.cast("long")), renewed)


def date(x: Column, key: str) -> Column:
    """The day's number is permuted; ambiguous day and month are read day first where that is a date."""
    parts = F.split(x, "[-./]")

    def read(p):
        year_first = F.length(p[0]) == 4
        y = F.when(year_first, p[0]).otherwise(p[2])
        lead, other = F.when(year_first, p[2]).otherwise(p[0]), p[1]

        def made(month, day):
            return F.try_to_date(F.concat_ws("-", y, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")

        day_first = made(other, lead)
        return F.struct(
            p.alias("p"),
            year_first.alias("yf"),
            F.coalesce(day_first, F.when(F.contains(x, F.lit("/")) & ~year_first, made(lead, other))).alias("date"),
            day_first.isNull().alias("md"),
        )

    def renewed(r):
        number = F.datediff(r["date"], F.lit(FIRST_DAY).cast("date")).cast("long")
        a_size, b_size = (F.lit(s).cast("long") for s in DAY_SIDES)

        def once(n):
            return let(
                feistel(F.floor(n / DAY_SIDES[1]), n % DAY_SIDES[1], a_size, b_size, F.lit("date"), key),
                lambda s: s["a"] * DAY_SIDES[1] + s["b"],
            )

        # Walk on from the few numbers beyond the last day; no walk is longer than their count.
        walk = F.aggregate(
            F.sequence(F.lit(1), F.lit(DAY_SIDES[0] * DAY_SIDES[1] - DAYS)),
            once(number),
            lambda n, _: F.when(n >= DAYS, once(n)).otherwise(n),
        )

        def written(day):
            sep = F.regexp_extract(x, "[-./]", 0)
            yy, mm, dd = F.date_format(day, "yyyy"), F.date_format(day, "MM"), F.date_format(day, "dd")
            lead = F.when(r["md"], mm).otherwise(dd)
            other = F.when(r["md"], dd).otherwise(mm)
            return F.when(r["yf"], F.concat(yy, sep, mm, sep, dd)).otherwise(F.concat(lead, sep, other, sep, yy))

        inside = r["date"].isNotNull() & F.year(r["date"]).between(1900, 2099)
        new_day = F.date_add(F.lit(FIRST_DAY).cast("date"), walk.cast("int"))
        return F.when(inside, let(new_day, written)).otherwise(x)

    return let(let(parts, read), renewed)


def phone(x: Column, key: str) -> Column:
    """Digits after the country code are permuted."""
    code = F.regexp_extract(x, r"^((?:\+\d{1,3}|1)(?=[ .(-]))?", 0)

    def renewed(p):
        rest = F.substr(x, F.length(p["code"]) + 1)
        n = F.length(p["d"])
        fits = n.between(4, 15) & (n + F.length(digits_of(p["code"]))).between(7, 15)
        return F.when(fits, F.concat(p["code"], put_digits(rest, permuted_digits(p["d"], "phone", key)))).otherwise(x)

    return let(code, lambda c: let(F.struct(c.alias("code"), digits_of(F.substr(x, F.length(c) + 1)).alias("d")), renewed))


def email(x: Column, key: str) -> Column:
    """The local part becomes a digest of 16 letters and digits; the domain stays."""
    local, domain = F.split_part(x, F.lit("@"), F.lit(1)), F.split_part(x, F.lit("@"), F.lit(2))
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(local), F.lower(domain)), 256)
    return F.concat(F.lit("u"), F.left(digest, F.lit(15)), F.lit("@"), domain)


def kind_of(x: Column) -> Column:
    """Which pattern matched."""
    case = F.when(F.contains(x, F.lit("@")), "email")
    for name, pattern in (("ip", r"^\d{1,3}(\.\d{1,3}){3}$"), ("date", r"^(\d{4}[-/]\d{2}[-/]\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})$"), ("ssn", r"^\d{3}-\d{2}-\d{4}$"), ("phone", r"^[+(]|^(1[.-])?\d{3}[.-]\d{3}[.-]\d{4}$")):
        case = case.when(F.rlike(x, F.lit(pattern)), name)
    return case.otherwise("run")


def run(x: Column, key: str) -> Column:
    """struct(new, kinds) of groups: at each one a card of its own, else the longest card or IBAN that starts there."""

    def renewed(p):
        g, sep, m = p["g"], p["sep"], F.size(p["g"])

        def is_card(y):
            return F.rlike(y, F.lit(r"^\d{13,19}$")) & F.call_function("luhn_check", y)

        def is_iban(y):
            whole = F.when(F.rlike(y, F.lit(r"^[A-Z]{2}\d{2}[A-Z0-9]{8,30}$")), mod97(F.concat(F.substr(y, F.lit(5)), F.left(y, F.lit(4)))) == 1)
            return F.coalesce(whole, F.lit(False))

        def step(s, i):
            sizes = F.filter(
                F.sequence(F.lit(1), F.least(m - i, F.lit(19))),
                lambda k: let(F.array_join(F.slice(g, i + 1, k), ""), lambda y: is_card(y) | is_iban(y)),
            )
            best = F.when(F.get(sizes, F.lit(0)) == 1, 1).otherwise(F.coalesce(F.array_max(sizes), F.lit(0)))

            def taken(k):
                old = F.call_function("array_join", F.slice(g, i + 1, F.greatest(k, F.lit(1))), sep)
                kind = F.when(F.rlike(old, F.lit("^[A-Z]")), "iban").otherwise("card")
                new = F.when(k == 0, old).when(kind == "iban", iban(old, key)).otherwise(card(old, key))
                return let(
                    F.struct(old.alias("o"), new.alias("n")),
                    lambda v: F.struct(
                        F.concat(s["s"], F.when(i > 0, sep).otherwise(F.lit("")), v["n"]).alias("s"),
                        (i + F.greatest(k, F.lit(1))).cast("int").alias("next"),
                        F.when(v["o"] != v["n"], F.array_append(s["kinds"], kind)).otherwise(s["kinds"]).alias("kinds"),
                    ),
                )

            return F.when(i < s["next"], s).otherwise(let(best, taken))

        start = F.struct(F.lit("").alias("s"), F.lit(0).alias("next"), F.array().cast("array<string>").alias("kinds"))
        done = F.aggregate(F.sequence(F.lit(0), m - 1), start, step)
        return let(done, lambda s: F.struct(s["s"].alias("new"), s["kinds"].alias("kinds")))

    sep = F.when(F.contains(x, F.lit("-")), "-").otherwise(" ")
    return let(F.struct(F.split(x, "[ -]").alias("g"), sep.alias("sep")), renewed)


def pseudonym(x: Column, kind: Column, key: str) -> Column:
    """struct(new, kinds of the values replaced)."""
    case = None
    for name, made in (("email", email), ("ip", ip), ("date", date), ("ssn", ssn), ("phone", phone)):
        case = F.when(kind == name, made(x, key)) if case is None else case.when(kind == name, made(x, key))
    one = let(case, lambda n: F.struct(n.alias("new"), F.when(n != x, F.array(kind)).otherwise(F.array().cast("array<string>")).alias("kinds")))
    return F.when(kind == "run", run(x, key)).otherwise(one)


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the text rewritten and n_<kind>, the number of values replaced, for every kind."""
    t = F.col(text)
    found = F.when(
        F.rlike(t, F.lit("[0-9@]")),
        F.transform(F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)), lambda x: let(kind_of(x), lambda k: pseudonym(x, k, key))),
    ).otherwise(F.array().cast("array<struct<new:string,kinds:array<string>>>"))

    def rebuilt(f):
        rest = F.split(t, PATTERN, -1)
        return F.array_join(F.transform(rest, lambda r, i: F.concat(r, F.coalesce(F.get(f, i)["new"], F.lit("")))), "")

    def outcome(f):
        return F.struct(
            F.when(F.size(f) == 0, t).otherwise(rebuilt(f)).alias("text"),
            F.flatten(F.transform(f, lambda v: v["kinds"])).alias("kinds"),
        )

    done = docs.withColumn("_pii", let(found, outcome))

    def number(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("_pii.kinds", lambda k: k == kind)), F.lit(0)).cast("long")

    return done.withColumns({text: F.col("_pii.text")} | {f"n_{k}": number(k) for k in KINDS}).drop("_pii")
