"""Format-preserving pseudonyms of personal data, in DataFrame functions alone.

Values are found by one pattern, validated by kind, and permuted by a keyed Feistel network within
their format. The same value gets the same pseudonym wherever it stands, so records stay linked
across documents, and different values of a kind never share one.

    card    13 to 19 digits with a right check digit: all but the check digit are permuted, and the check digit is computed anew
    phone   international or national numbers: the digits are permuted, a country code stays
    ssn     3-2-4 digits
    ip      IPv4 addresses with bytes up to 255: permuted among all addresses
    date    real dates of the years 1800 to 2199: permuted among the days of these 400 years. Between
            slashes the month comes first where that gives a date, and else the day; the latter dates
            are permuted among themselves, so that no two texts of a date become one
    email   letters and digits before the last dot
    secret  what follows a word such as password or token, and cloud access keys: digits among digits,
            small letters among small ones, capitals among capitals

A network splits a value into two parts and adds to each, in turn and place by place, a keyed hash
of the other, modulo the size of the alphabet: any such round can be undone, whatever the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import fresh

ROUNDS = 8
DIGITS = "0123456789"
LOWER = "0123456789abcdefghijklmnopqrstuvwxyz"
UPPER = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIRST_DAY = "1800-01-01"
DAYS = (189, 773)  # their product is the days of 400 years
LATE_DAYS = (9, 9833)  # their product is those days of the 400 years that are beyond the 12th of a month

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
SECRET = r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?)[A-Za-z0-9+/_=-](?:\.?[A-Za-z0-9+/_=-]){7,}+"
CLOUD_KEY = r"\bAKIA[0-9A-Z]{16}\b"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[/.-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
#: A whole run of digit groups; cards are looked for at the borders of its groups.
RUN = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}+"
#: Beginnings and lengths of the common cards; they go before other numbers with a right check digit.
COMMON_CARD = r"^(?:4(?:[0-9]{15}|[0-9]{18})|(?:5[1-5]|2[2-7])[0-9]{14}|3[47][0-9]{13}|3[068][0-9]{12}|35[0-9]{14}|6[0-9]{15,18})$"
PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9+])\+[0-9]{8,15}(?![0-9])"
#: Earlier kinds win where several could begin at a place.
PATTERN = "|".join((EMAIL, SECRET, CLOUD_KEY, IP, DATE, SSN, RUN, PHONE))
#: What may stand in a run of digits that is no card, and around it.
REST = "|".join((EMAIL, SECRET, CLOUD_KEY, IP, DATE, SSN, PHONE))
KINDS = ("email", "secret", "ip", "date", "ssn", "card", "phone")


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _pick(text: Column, at: Column) -> Column:
    return F.substring(text, at, F.lit(1))


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def _stream(key: str, label: str, turn: Column, text: Column, size: Column) -> Column:
    """256 hash bytes, in hexadecimal, that depend on the key, the round, and one part of the value."""
    seed = F.concat(F.lit(f"{key}|{label}|"), turn.cast("string"), F.lit("|"), size.cast("string"), F.lit("|"), text, F.lit("|"))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.sha2(F.concat(seed, k.cast("string")), 512)), "")


def _as_column(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def _shift(text: Column, stream: Column, alphabet: Column) -> Column:
    """Add the stream to the text, place by place, in the alphabet."""

    def one(s: Column, i: Column) -> Column:
        # Beyond the stream's 256 bytes it repeats; a round stays reversible.
        add = F.conv(F.substring(s, F.pmod(i - 1, F.lit(256)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        place = F.position(_pick(text, i), alphabet) - 1
        return _pick(alphabet, F.pmod(place + add, F.char_length(alphabet)) + 1)

    places = F.sequence(F.lit(1), F.char_length(text))
    shifted = _bind(stream, lambda s: F.array_join(F.transform(places, lambda i: one(s, i)), ""))
    return F.when(F.char_length(text) > 0, shifted).otherwise(F.lit(""))


def permute(value: Column, alphabet: Column | str, key: str, label: str) -> Column:
    """A keyed permutation of the strings of each length over ``alphabet``.

    A round turns the parts (a, b) to (b, a shifted by a hash of b); after an even number of rounds
    the parts have their first lengths again.
    """
    size, alphabet = F.char_length(value), _as_column(alphabet)
    half = F.floor(size / 2).cast("int")
    pair = F.struct(F.substring(value, F.lit(1), half).alias("a"), F.substring(value, half + 1, size).alias("b"), size.alias("n"))

    def turn(p: Column, t: Column) -> Column:
        return F.struct(p["b"].alias("a"), _shift(p["a"], _stream(key, label, t, p["b"], p["n"]), alphabet).alias("b"), p["n"].alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), pair, turn, lambda p: F.concat(p["a"], p["b"]))


def _refill(template: Column, characters: Column | str, filling: Column) -> Column:
    """``template`` with its characters of the class replaced, in order, by those of ``filling``."""
    inside, outside = (F.concat(F.lit(x), _as_column(characters), F.lit("]")) for x in ("[", "[^"))

    def one(filling: Column, i: Column) -> Column:
        char = _pick(template, i)
        rank = F.char_length(F.regexp_replace(F.substring(template, F.lit(1), i), outside, F.lit("")))
        return F.when(F.rlike(char, inside), _pick(filling, rank)).otherwise(char)

    places = F.sequence(F.lit(1), F.char_length(template))
    return _bind(filling, lambda f: F.array_join(F.transform(places, lambda i: one(f, i)), ""))


def _only(text: Column, characters: Column | str) -> Column:
    return F.regexp_replace(text, F.concat(F.lit("[^"), _as_column(characters), F.lit("]")), F.lit(""))


def _luhn_sum(digits: Column, skip: int) -> Column:
    """Sum of the check-digit rule; ``skip`` 0 doubles every second digit from the right, 1 the last too."""
    n = F.char_length(digits)

    def term(i: Column) -> Column:
        d = _pick(digits, i).cast("int")
        double = F.pmod(n - i + skip, F.lit(2)) == 1
        return F.when(double, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), term), F.lit(0), lambda a, x: a + x)


def luhn_valid(digits: Column) -> Column:
    return F.pmod(_luhn_sum(digits, 0), F.lit(10)) == 0


def _card(match: Column, key: str) -> Column:
    digits = _only(match, "0-9")
    payload = permute(F.substring(digits, F.lit(1), F.char_length(digits) - 1), DIGITS, key, "card")
    checked = _bind(payload, lambda p: F.concat(p, F.pmod(10 - F.pmod(_luhn_sum(p, 1), F.lit(10)), F.lit(10)).cast("string")))
    return F.when(luhn_valid(digits), _refill(match, "0-9", checked))


def _digits(match: Column, key: str, label: str) -> Column:
    return _refill(match, "0-9", permute(_only(match, "0-9"), DIGITS, key, label))


def _phone(match: Column, key: str) -> Column:
    code = F.regexp_extract(match, r"^\+[0-9]{1,3}(?=[ .-])", 0)
    rest = F.substring(match, F.char_length(code) + 1, F.char_length(match))
    return F.concat(code, _digits(rest, key, "phone"))


def _number(value: Column, sizes: tuple[int | Column, int | Column], key: str, label: str, last) -> Column:
    """A keyed permutation of 0 to the product of ``sizes``, and ``last`` of its result."""
    m, n = ((F.lit(x) if isinstance(x, int) else x).cast("bigint") for x in sizes)
    pair = F.struct(F.floor(value / n).cast("bigint").alias("a"), F.pmod(value, n).alias("b"), m.alias("m"), n.alias("n"))

    def turn(p: Column, t: Column) -> Column:
        seed = F.concat(F.lit(f"{key}|{label}|"), t.cast("string"), F.lit("|"), p["b"].cast("string"))
        add = F.conv(F.substring(F.sha2(seed, 256), 1, 12), 16, 10).cast("bigint")
        return F.struct(p["b"].alias("a"), F.pmod(p["a"] + add, p["m"]).alias("b"), p["n"].alias("m"), p["m"].alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), pair, turn, lambda p: last(p["a"] * p["n"] + p["b"]))


def _ip(match: Column, key: str) -> Column:
    bytes_ = F.transform(F.split(match, r"\."), lambda x: x.cast("bigint"))
    value = F.aggregate(bytes_, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
    written = lambda v: F.concat_ws(".", *(F.pmod(F.shiftright(v, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)))
    return F.when(~F.exists(bytes_, lambda x: x > 255), _number(value, (1 << 16, 1 << 16), key, "ip", written))


def _day(days: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), days.cast("int"))


def _late_rank(day: Column, days: Column) -> Column:
    """The place of a date beyond the 12th among all such dates: each month before it has twelve others."""
    return days - 12 * ((F.year(day) - int(FIRST_DAY[:4])) * 12 + F.month(day))


def _late_day(rank: Column) -> Column:
    """The date of a place. A month has 18.4 such days on average, and no month's first place is far from that."""
    first = F.lit(FIRST_DAY).cast("date")

    def start(month: Column) -> Column:
        return F.datediff(F.add_months(first, month), first) - 12 * month

    near = F.floor(rank * (12 * 400) / (LATE_DAYS[0] * LATE_DAYS[1])).cast("int")
    month = F.array_max(F.filter(F.sequence(F.greatest(near - 1, F.lit(0)), near + 1), lambda m: start(m) <= rank))
    return _bind(month, lambda m: F.date_add(F.add_months(first, m), (rank - start(m) + 12).cast("int")))


def _date(match: Column, key: str) -> Column:
    """ISO dates, dates with dots and those with slashes and the month first are permuted alike, so equal days stay linked."""

    month_first = F.try_to_timestamp(match, F.lit("MM/dd/yyyy")).isNotNull()
    notation = F.when(F.contains(match, F.lit("-")), "yyyy-MM-dd").when(F.contains(match, F.lit(".")), "dd.MM.yyyy").when(month_first, "MM/dd/yyyy").otherwise("dd/MM/yyyy")

    def new(v: Column) -> Column:
        late, days = v["notation"] == "dd/MM/yyyy", F.datediff(v["day"], F.lit(FIRST_DAY).cast("date")).cast("bigint")
        sizes = tuple(F.when(late, a).otherwise(b) for a, b in zip(LATE_DAYS, DAYS))
        seed = F.struct(days.alias("days"), F.when(late, _late_rank(v["day"], days)).otherwise(days).alias("value"), *(x.alias(k) for x, k in zip(sizes, "mn")))
        written = lambda r: F.call_function("date_format", F.when(late, _late_day(r)).otherwise(_day(r)), v["notation"])
        return _bind(seed, lambda x: F.when(x["days"].between(0, DAYS[0] * DAYS[1] - 1), _number(x["value"], (x["m"], x["n"]), key, "date", written)))

    return _bind(notation, lambda n: _bind(F.struct(n.alias("notation"), F.try_to_timestamp(match, n).cast("date").alias("day")), new))


def _email(match: Column, key: str) -> Column:
    dot = F.char_length(match) - F.char_length(F.substring_index(match, ".", -1))
    front = F.lower(F.substring(match, F.lit(1), dot))
    return F.concat(_refill(front, "0-9a-z", permute(_only(front, "0-9a-z"), LOWER, key, "email")), F.substring(match, dot + 1, F.char_length(match)))


def _secret(match: Column, key: str) -> Column:
    """The value alone is changed, the word before it stays. Letters keep their case and digits stay digits."""
    head = F.regexp_extract(match, r"^(?:AKIA|(?i:[a-z_-]+[ \t]{0,3}[=:][ \t]{0,3}[\"']?))", 0)
    value = F.substring(match, F.char_length(head) + 1, F.char_length(match))

    classes = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(x).alias("alphabet")) for c, x in (("0-9", DIGITS), ("a-z", LOWER[10:]), ("A-Z", UPPER[10:]))))

    def one(v: Column, k: Column) -> Column:
        own = _bind(_only(v, k["c"]), lambda w: permute(w, k["alphabet"], key, "secret"))
        return F.when(F.rlike(v, F.concat(F.lit("["), k["c"], F.lit("]"))), _refill(v, k["c"], own)).otherwise(v)

    def part(v: Column) -> Column:
        return F.aggregate(classes, v, one)

    # Longer values go part by part, as a permutation's cost is the square of the length.
    return F.concat(head, F.array_join(F.transform(F.regexp_extract_all(value, F.lit(".{1,512}"), F.lit(0)), part), ""))


def pseudonym(match: Column, key: str) -> Column:
    """struct(kind, new) of one found value; ``kind`` is null where validation fails and nothing changes."""

    def case(kind: str, new: Column) -> Column:
        return F.struct(F.when(new.isNotNull(), F.lit(kind)).alias("kind"), F.coalesce(new, match).alias("new"))

    # A digit run that is no card is looked through by ``_look_again``.
    return (
        F.when(match.rlike(_whole(EMAIL)), case("email", _email(match, key)))
        .when(match.rlike(_whole(f"{SECRET}|{CLOUD_KEY}")), case("secret", _secret(match, key)))
        .when(match.rlike(_whole(IP)), case("ip", _ip(match, key)))
        .when(match.rlike(_whole(DATE)), case("date", _date(match, key)))
        .when(match.rlike(_whole(SSN)), case("ssn", _digits(match, key, "ssn")))
        .when(match.rlike(_whole(CARD)) & luhn_valid(_only(match, "0-9")), case("card", _card(match, key)))
        .when(match.rlike(_whole(PHONE)), case("phone", _phone(match, key)))
        .otherwise(F.struct(F.lit(None).cast("string").alias("kind"), match.alias("new")))
    )


def _plain(text: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("kind"), text.alias("new"))


def _cards(run: Column, key: str, common: bool) -> Column:
    """Pieces struct(kind, new) of a run of digit groups, in order: valid cards from border to border, and what is between.

    From the left, the shortest common card at a border wins, and of others the longest.
    """

    def pieces(tokens: Column) -> Column:
        n = F.size(tokens)

        def span(first: Column, last: Column) -> Column:
            return F.array_join(F.slice(tokens, first, last - first + 1), "")

        def card(digits: Column) -> Column:
            right = F.char_length(digits).between(13, 19) & luhn_valid(digits)
            return digits.rlike(COMMON_CARD) & right if common else right

        def last_of(first: Column) -> Column:
            ends = F.sequence(first, F.least(first + 18, n))
            right = F.filter(ends, lambda e: card(_only(span(first, e), "0-9")))
            return F.array_min(right) if common else F.array_max(right)

        found = F.filter(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("a"), last_of(i).alias("z"))), lambda x: x["z"].isNotNull())
        empty = F.array().cast("array<struct<a: int, z: int>>")
        apart = F.aggregate(found, empty, lambda held, x: F.when(F.coalesce(F.try_element_at(held, F.lit(-1))["z"], F.lit(0)) < x["a"], F.concat(held, F.array(x))).otherwise(held))

        def cut(cards: Column) -> Column:
            def at(k: Column) -> Column:
                before = F.coalesce(F.get(cards, k - 1)["z"], F.lit(0)) + 1
                here = F.get(cards, k)
                between = _plain(F.when(before <= F.coalesce(here["a"] - 1, n), span(before, F.coalesce(here["a"] - 1, n))).otherwise(F.lit("")))
                raw = span(here["a"], here["z"])
                value = F.regexp_replace(raw, "[ -]$", "")
                new = F.struct(F.lit("card").alias("kind"), _card(value, key).alias("new"))
                return F.when(here.isNull(), F.array(between)).otherwise(F.array(between, new, _plain(F.substring(raw, F.char_length(value) + 1, F.lit(1)))))

            return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cards)), at))

        return _bind(apart, cut)

    return _bind(F.regexp_extract_all(run, F.lit("[0-9]+[ -]?"), F.lit(0)), pieces)


def _each_plain(pieces: Column, use) -> Column:
    return F.flatten(F.transform(pieces, lambda p: F.when(p["kind"].isNull() & (F.char_length(p["new"]) > 0), use(p["new"])).otherwise(F.array(p))))


def _is_run(v: Column) -> Column:
    return v["kind"].isNull() & v["new"].rlike(_whole(RUN))


def _joined(pieces: Column, ends: Column) -> Column:
    """``pieces`` with neighbours without a kind as one text; ``ends`` are the places of those with one."""

    def at(k: Column) -> Column:
        first = F.coalesce(F.get(ends, k - 1), F.lit(0)) + 1
        last = F.coalesce(F.get(ends, k) - 1, F.size(pieces))
        text = _plain(F.array_join(F.transform(F.slice(pieces, first, last - first + 1), lambda p: p["new"]), ""))
        return F.when(F.get(ends, k).isNull(), F.array(text)).otherwise(F.array(text, F.get(pieces, F.get(ends, k) - 1)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(ends)), at))


def _rest(text: Column, key: str) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(REST), F.lit(0)), lambda m: pseudonym(m, key))
    return F.flatten(F.zip_with(F.split(text, REST, -1), found, _with_before))


def _with_before(before: Column, value: Column) -> Column:
    return F.filter(F.array(_plain(before), value), lambda p: p["new"].isNotNull())


def _with_pieces(before: Column, pieces: Column) -> Column:
    return F.concat(F.array(_plain(before)), F.coalesce(pieces, F.array().cast("array<struct<kind: string, new: string>>")))


def _other_cards(text: Column, key: str) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda r: _cards(r, key, False))
    return F.flatten(F.zip_with(F.split(text, RUN, -1), found, _with_pieces))


def _look_again(docs: DataFrame, held: str, between: Column, key: str) -> tuple[DataFrame, str]:
    """A column of pieces struct(kind, new) that make up a text whose runs of digits are no cards as a whole; else null.

    Common cards in the runs go first. What is left joins the text around it, and the other kinds
    are looked for there, so that a run that ends within a value does not hide it; other numbers
    with a right check digit come last, as parts of two phone numbers may have one. The steps are columns of their own, as nested functions are slow to resolve.
    """
    (name, ends) = fresh(docs, "pieces", "ends")
    again = F.exists(held, _is_run)
    looked = F.transform(held, lambda v: F.when(_is_run(v), _cards(v["new"], key, True)).otherwise(F.array(v)))
    docs = docs.withColumn(name, F.when(again, looked))
    docs = docs.withColumn(name, F.when(F.col(name).isNotNull(), F.flatten(F.zip_with(between, F.col(name), _with_pieces))))
    docs = docs.withColumn(ends, F.filter(F.sequence(F.lit(1), F.size(name)), lambda i: F.element_at(name, i)["kind"].isNotNull()))
    docs = docs.withColumn(name, F.when(F.col(name).isNotNull(), _joined(F.col(name), F.col(ends)))).drop(ends)
    docs = docs.withColumn(name, _each_plain(F.col(name), lambda t: _rest(t, key)))
    return docs.withColumn(name, _each_plain(F.col(name), lambda t: _other_cards(t, key))), name


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found: str = "pii") -> DataFrame:
    """``docs`` with the values in its texts replaced, and a column of the kinds found, in order.

    Null texts stay null, with no kinds; an empty table gives an empty one. Everything between the
    values stays byte for byte, in texts and values of any length. Other columns and repeated rows
    stay as they are; a column named ``found`` is replaced. The key is a secret: who knows it can
    turn pseudonyms back.
    """
    if not key:
        raise ValueError("a key is needed")
    text = F.col(text_col)
    # Texts without a digit, @, = or : have no value of any kind.
    maybe = text.rlike("[0-9@=:]")
    none = F.array().cast("array<struct<kind: string, new: string>>")
    new = F.when(maybe, F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda m: pseudonym(m, key))).otherwise(none)
    (held,) = fresh(docs, "pseudonyms")
    out = docs.withColumn(held, new)
    between = F.split(text, PATTERN, -1)
    # Only texts with a run of digits that is no card are looked through again.
    out, again = _look_again(out, held, between, key)
    (pieces,) = fresh(out, "text")
    out = out.withColumn(pieces, F.coalesce(again, F.when(F.size(held) > 0, F.flatten(F.zip_with(between, F.col(held), _with_before)))))
    whole = F.array_join(F.col(f"{pieces}.new"), "")
    kinds = F.filter(F.coalesce(F.col(f"{pieces}.kind"), F.array().cast("array<string>")), lambda k: k.isNotNull())
    return out.withColumn(text_col, F.when(F.size(held) > 0, whole).otherwise(text)).withColumn(found, kinds).drop(held, again, pieces)
