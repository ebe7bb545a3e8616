"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Candidates are found by one pattern and validated by kind: card numbers by their check digit (of a longer run of digit groups, the part that has one), US social security
numbers by the ranges in use, IPv4 addresses by their octets, dates by the calendar, telephone numbers by
their form. The value is a number of a finite domain and goes through a keyed Feistel network:

    (left, right) -> (right, (left + F(key, kind, round, right)) mod size of left's half)

with F from SHA-256. Such a network is a permutation of its domain whatever F is, so equal values get equal pseudonyms
in all documents and different values different ones. Where only a part of the domain is valid, the
permutation is applied again until the value is valid (cycle walking), which is a permutation of the
valid values. The pseudonym is put back digit by digit: separators, length and a card's check digit fit.

E-mail and IPv6 addresses, credentials and tokens have no small number to permute; they get a keyed digest, which links equal values as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Cycle walking: the share of valid values is over two thirds in each domain, so so many steps without one are
#: less likely than 1e-30; such a value is masked.
WALK = 64

NUMBER_EDGE, NUMBER_END = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"
MONTHS = [f"{x[:3]}(?:{x[3:]})?" for x in "January February March April May June July August September October November December".split()]
#: One of these, in this order, at each place.
PATTERNS = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\\.[A-Za-z0-9-]{1,63}+){1,8}+",
    "secret": "(?<![A-Za-z0-9_])(?i:(?:api|access|secret|auth|private)[_-]?(?:key|token|secret)|password|passwd|token)[\\t ]{0,3}[=:][\\t ]{0,3}[\"']?[A-Za-z0-9_/+.=-]{7,}[A-Za-z0-9_/+=-][\"']?",
    "token": "(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{16,}|(?i:bearer) [A-Za-z0-9._~+/=-]{15,}[A-Za-z0-9_~+/=-])",
    "ipv6": "(?<![0-9A-Za-z:.])(?=[0-9a-fA-F:]*[0-9])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![0-9A-Za-z:])",
    "ipv4": "(?<![0-9A-Za-z.])[0-9]{1,3}(?:\\.[0-9]{1,3}){3}(?!\\.?[0-9A-Za-z])",
    "date": NUMBER_EDGE + "[0-9]{4}-[0-9]{2}-[0-9]{2}(?:" + NUMBER_END + "|(?=T[0-9]{2}:))|(?<![0-9A-Za-z/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9A-Za-z/])|" + NUMBER_EDGE + "(?:" + "|".join(MONTHS) + ") [0-9]{1,2}, [0-9]{4}" + NUMBER_END,
    "ssn": NUMBER_EDGE + "[0-9]{3}-[0-9]{2}-[0-9]{4}" + NUMBER_END,
    "phone": "(?<![0-9A-Za-z+])(?:(?:\\+[0-9]{1,3}[ .-]?)?\\([0-9]{3}\\) ?[0-9]{3}[ .-][0-9]{4}|\\+[0-9]{1,3}[ .-][0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|\\+[0-9]{11,14})" + NUMBER_END
    + "|(?<![0-9A-Za-z+.-])(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\\.[0-9]{3}\\.[0-9]{4})(?![0-9A-Za-z]|[.-][0-9])",
    "card": NUMBER_EDGE + "[0-9](?:[ -]?[0-9]){12,}+" + NUMBER_END,
}
ANY = "|".join(f"(?:{x})" for x in PATTERNS.values())
KINDS = tuple(PATTERNS)

FIRST_DAY, DAYS, DAY_SIDE = "1900-01-01", 73049, 271  # to 2099-12-31; 271 * 271 >= 73049


Key = str | Column


def _digest_number(key: Key, kind: str, *parts: Column) -> Column:
    """60 bits of a keyed digest."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def feistel(value: Column, left_size: int, right_size: int, key: Key, kind: str) -> Column:
    """A keyed permutation of 0 .. left_size * right_size - 1; both sizes change places every round, so ROUNDS is even."""
    start = F.struct(F.floor(value / right_size).cast("bigint").alias("a"), F.pmod(value, F.lit(right_size)).cast("bigint").alias("b"))
    end = feistel_pair(start, left_size, right_size, key, kind)
    return end["a"] * right_size + end["b"]


def feistel_pair(start: Column, left_size: int, right_size: int, key: Key, kind: str) -> Column:
    """As feistel(), of a struct (a, b) with a under left_size and b under right_size."""

    def step(s: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, F.lit(left_size)).otherwise(F.lit(right_size)).cast("bigint")
        moved = F.pmod(s["a"] + F.pmod(_digest_number(key, kind, i, s["b"]), size), size)
        return F.struct(s["b"].alias("a"), moved.cast("bigint").alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _walk(value: Column, left: int, right: int, key: Key, kind: str, valid) -> Column:
    """The first valid value of permuting again and again; null if there is none in WALK steps."""
    start = F.struct(value.cast("bigint").alias("v"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        again = F.struct(F.when(s["done"], s["v"]).otherwise(feistel(s["v"], left, right, key, kind)).alias("v"))
        return F.struct(again["v"].alias("v"), (s["done"] | valid(again["v"])).alias("done"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, step)
    return F.when(end["done"], end["v"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _fill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced by ``digits``, of which there are as many."""
    place = lambda p: F.char_length(_digits(F.substring(form, F.lit(1), p)))
    char = lambda p: F.substring(form, p, F.lit(1))
    new = F.transform(F.sequence(F.lit(1), F.char_length(form)), lambda p: F.when(char(p).rlike("[0-9]"), F.substring(digits, place(p), F.lit(1))).otherwise(char(p)))
    return F.array_join(new, "")


def check_digit(payload: Column) -> Column:
    """The Luhn check digit of a string of digits."""
    n = F.char_length(payload)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(payload, i, F.lit(1)).cast("int")
        d = F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return s + d

    return F.pmod(10 - F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10, F.lit(10))


def is_card(digits: Column) -> Column:
    n = F.char_length(digits)
    payload = F.substring(digits, F.lit(1), n - 1)
    return (check_digit(payload) == F.substring(digits, n, F.lit(1)).cast("int")) & ~digits.rlike("^(.)\\1*$")


def _whole_card(x: Column, key: Key) -> Column:
    """Payload halves of fixed size by length; the check digit is made anew."""
    digits = _digits(x)

    def of(n: int) -> Column:
        left, right = (n - 1) // 2, n - 1 - (n - 1) // 2
        start = F.struct(F.substring(digits, 1, left).cast("bigint").alias("a"), F.substring(digits, left + 1, right).cast("bigint").alias("b"))
        end = feistel_pair(start, 10**left, 10**right, key, f"card{n}")
        payload = F.concat(F.lpad(end["a"].cast("string"), left, "0"), F.lpad(end["b"].cast("string"), right, "0"))
        return F.concat(payload, check_digit(payload).cast("string"))

    new = F.when(F.char_length(digits) == 13, of(13))
    for n in range(14, 20):
        new = new.when(F.char_length(digits) == n, of(n))
    return _fill(x, new)


def _runs(x: Column) -> Column:
    """(rank, at, part): the runs of whole groups of digits in ``x`` that are cards, the longest and then the first at the head."""
    groups = F.split(x, "[ -]")
    ends = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda n: F.aggregate(F.slice(groups, F.lit(1), n), n - 1, lambda s, g: s + F.char_length(g)))
    run = lambda i, j: (F.element_at(ends, i) - F.char_length(F.element_at(groups, i)) + 1, F.element_at(ends, j))

    def part(i: Column, j: Column) -> Column:
        at, to = run(i, j)
        return F.struct((at - to).alias("rank"), at.alias("at"), F.substring(x, at, to - at + 1).alias("part"))

    n = F.size(groups)
    every = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, F.least(n, i + 18)), lambda j: part(i, j))))
    fits = F.filter(every, lambda r: F.char_length(_digits(r["part"])).between(13, 19))
    return F.array_sort(F.filter(fits, lambda r: is_card(_digits(r["part"]))))


def _card(x: Column, key: Key) -> Column:
    """The longest run of groups of digits that is a valid card number; what stands beside it (a code, another number) stays."""
    head = F.element_at(_runs(x), 1)
    found = F.transform(F.array(F.when(F.size(_runs(x)) > 0, head)), lambda r: F.concat(F.substring(x, F.lit(1), r["at"] - 1), _whole_card(r["part"], key), F.substring(x, r["at"] + F.char_length(r["part"]), F.char_length(x))))
    return F.element_at(found, 1)


def _masked(x: Column) -> Column:
    return F.regexp_replace(x, "[0-9]", "*")


def _ssn(x: Column, key: Key) -> Column:
    value = lambda d: d.cast("bigint")

    def valid(v: Column) -> Column:
        area, group, serial = F.floor(v / 1_000_000), F.floor(v / 10_000) % 100, v % 10_000
        return (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)

    v = value(_digits(x))
    new = _walk(v, 30_000, 33_334, key, "ssn", lambda y: valid(y) & (y < 1_000_000_000))
    return F.when(valid(v), F.coalesce(_fill(x, F.lpad(new.cast("string"), 9, "0")), _masked(x)))


def _phone(x: Column, key: Key) -> Column:
    """The last ten digits; the country code stays."""
    digits = _digits(x)
    n = F.char_length(digits)
    new = feistel(F.substring(digits, n - 9, F.lit(10)).cast("bigint"), 100_000, 100_000, key, "phone")
    return _fill(x, F.concat(F.substring(digits, F.lit(1), n - 10), F.lpad(new.cast("string"), 10, "0")))


def _ipv4(x: Column, key: Key) -> Column:
    octets = F.transform(F.split(x, "\\."), lambda o: o.cast("bigint"))
    value = F.aggregate(octets, F.lit(0).cast("bigint"), lambda s, o: s * 256 + o)
    new = feistel(value, 65_536, 65_536, key, "ipv4")
    parts = [F.floor(new / 256**i).cast("bigint") % 256 for i in (3, 2, 1, 0)]
    return F.when(~F.exists(octets, lambda o: o > 255), F.concat_ws(".", *[p.cast("string") for p in parts]))


def _date(x: Column, key: Key) -> Column:
    """ISO dates, numbers with strokes (month first, unless the first one is over 12) and English month names; a day has one pseudonym in all forms."""
    first = F.substring_index(x, "/", 1).try_cast("int")
    wide = x.rlike("^[0-9]{2}/[0-9]{2}/")
    forms = {
        "yyyy-MM-dd": x.rlike("^[0-9]{4}-"), "dd/MM/yyyy": wide & (first > 12), "MM/dd/yyyy": wide, "d/M/yyyy": x.contains("/") & (first > 12), "M/d/yyyy": x.contains("/"),
        "MMM d, yyyy": x.rlike("^[A-Za-z]{3} "), "MMMM d, yyyy": F.lit(True),
    }
    base = F.lit(FIRST_DAY).cast("date")
    read = F.coalesce(*[F.when(is_, F.struct(F.lit(i).alias("form"), F.try_to_timestamp(x, F.lit(form)).cast("date").alias("day"))) for i, (form, is_) in enumerate(forms.items())])
    day = F.datediff(read["day"], base)
    new = F.date_add(base, _walk(day, DAY_SIDE, DAY_SIDE, key, "date", lambda v: v < DAYS).cast("int"))
    told = F.coalesce(*[F.when(read["form"] == i, F.date_format(new, form)) for i, form in enumerate(forms)])
    return F.when((day >= 0) & (day < DAYS), F.coalesce(told, _masked(x)))


def _digest(key: Key, kind: str, x: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), x), 256)


def _token(x: Column, key: Key) -> Column:
    """The mark before it stays."""
    mark = F.regexp_extract(x, "^(AKIA|ASIA|gh[pousr]_|(?i:bearer) )", 1)
    new = _digest(key, "token", F.substring(x, F.char_length(mark) + 1, F.char_length(x)))
    return F.concat(mark, F.when(mark.isin("AKIA", "ASIA"), F.upper(F.substring(new, 1, 16))).otherwise(F.substring(new, 1, 32)))


def _ipv6(x: Column, key: Key) -> Column:
    """An address of the private range fd00::/8."""
    new = _digest(key, "ipv6", F.lower(x))
    return F.concat(F.lit("fd"), F.substring(new, 1, 2), *[F.concat(F.lit(":"), F.substring(new, 4 * i - 1, 4)) for i in range(1, 8)])


def _email(x: Column, key: Key) -> Column:
    return F.concat(F.lit("p"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(x)), 256), 1, 16), F.lit("@mail.invalid"))


def _secret(x: Column, key: Key) -> Column:
    """The name and the marks stay, the value becomes a digest."""
    value = F.regexp_extract(x, "[=:][\\t ]{0,3}[\"']?([A-Za-z0-9_/+.=-]*)", 1)
    name = F.regexp_extract(x, "^([^=:]*[=:][\\t ]{0,3}[\"']?)", 1)
    return F.concat(name, F.lit("s"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), value), 256), 1, 24), F.regexp_extract(x, "([\"']?)$", 1))


_MAKERS = {"email": _email, "secret": _secret, "token": _token, "ipv6": _ipv6, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _kind(x: Column) -> Column:
    """The first pattern that the whole match fits, edges left out."""
    bare = PATTERNS  # what must not stand beside a match doesn't stand there
    found = F.when(x.rlike(f"^(?:{bare[KINDS[0]]})$"), KINDS[0])
    for k in KINDS[1:]:
        found = found.when(x.rlike(f"^(?:{bare[k]})$"), k)
    return found


def pseudonym(x: Column, kind: Column, key: Key) -> Column:
    """What stands for a match; null if it isn't valid."""
    found = F.when(kind == KINDS[0], _MAKERS[KINDS[0]](x, key))
    for k in KINDS[1:]:
        found = found.when(kind == k, _MAKERS[k](x, key))
    return found


def pseudonymised(docs: DataFrame, key: str | DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, n_found, kinds and found (kind, pseudonym) of every row of ``docs``.

    ``key`` is the secret, or a table of one row and column that holds it, so that it stands in no plan. A null text stays null with nothing found; an
    empty one stays empty; a very long one is read whole. Repeated rows give equal rows, an empty table an
    empty one; other columns are not read. No shuffle: the work is a projection.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    if isinstance(key, DataFrame):  # one row
        rows = rows.crossJoin(F.broadcast(key.toDF("secret_key").limit(1)))
        key = F.col("secret_key")
    may = F.col("text").rlike("[0-9@]|(?i:password|passwd|token|secret|key|bearer)|gh[pousr]_|A[KS]IA")
    rows = rows.withColumn("matches", F.when(may, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    kinds = F.transform("matches", lambda m: F.struct(m.alias("match"), _kind(m).alias("kind")))
    rows = rows.withColumn("typed", kinds)
    new = F.transform("typed", lambda m: F.struct(m["match"].alias("match"), m["kind"].alias("kind"), pseudonym(m["match"], m["kind"], key).alias("new")))
    rows = rows.withColumn("done", new)
    gaps = F.split("text", ANY, -1)
    text = F.when(
        F.size("done") > 0,
        F.array_join(F.zip_with(gaps, "done", lambda gap, m: F.concat(gap, F.coalesce(m["new"], m["match"], F.lit("")))), ""),
    ).otherwise(F.col("text"))
    sure = F.filter("done", lambda m: m["new"].isNotNull())
    return rows.select(
        "doc_id",
        text.alias("text"),
        F.size(sure).cast("bigint").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda m: m["kind"]))), ",").alias("kinds"),
        F.transform(sure, lambda m: F.struct(m["kind"].alias("kind"), m["new"].alias("pseudonym"))).alias("found"),
    )
