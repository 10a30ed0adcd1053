"""PII pseudonyms: what is found and validated is replaced by a keyed permutation of its own format.

One pattern finds candidates of all kinds; the text between them is kept. A candidate is validated (check digits, octets,
calendar, numbers that are never given out) and then permuted by a Feistel network within its format, so equal values give
equal pseudonyms in all documents, different values of a kind different ones, and who has the key can undo it. A pseudonym
that validation would refuse is permuted again until it is valid (cycle walking). Round functions are SHA-256 of key, kind,
round and the other half.

The key comes to the plan as the value of a one-row subquery, so that neither explain nor the event log shows it. Only DataFrame functions: no Python runs on executors. Every row stands alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizing import free_names, replace_columns

ROUNDS = 8

#: Candidates by kind; none holds a capturing group. (?<!) and (?!) keep them from starting or ending inside others.
KINDS: dict[str, str] = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*+\.)++[A-Za-z]{2,}(?![A-Za-z0-9])",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-]|\([0-9]{3}\) ?[0-9]{3}[ .-]|[0-9]{3}[.-][0-9]{3}[.-])[0-9]{4}(?![0-9-])",
}
#: A run of 13 or more digits, up to a space before a candidate of another kind: cards, with what stands beside them.
KINDS["card"] = rf"(?<![0-9])[0-9](?:(?:-| (?!{'|'.join(KINDS.values())}))?[0-9]){{12,}}+"
#: Digits and spaces alone are a phone where they are no card.
_SPACED = r"(?<![0-9+])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"
_ANY = "|".join([*KINDS.values(), _SPACED])
#: What every candidate holds, cheap to look for.
_HINT = r"@|[0-9][0-9.) -]{6}"
#: How cards are written in a run with neighbours, longest first: unseparated, or these groups with one separator.
_GROUPS = ((4, 4, 4, 4, 3), (6, 13), (4, 4, 4, 4), (4, 6, 5), (4, 5, 6), (4, 6, 4), (4, 4, 4, 1), (4, 3, 3, 3))
_LAYOUTS = [sep.join(f"[0-9]{{{n}}}" for n in groups) for groups in _GROUPS for sep in "- "]
_CARD_AT = [rf"^({x})(?![0-9])" for x in ["[0-9]{13,19}", *_LAYOUTS]]
_PHONE_AT = r"^((?!000)[0-9]{3}[ -](?!000)[0-9]{3}[ -][0-9]{4})(?![0-9-])"
#: From each group of a run on, as much as a card may take and the character after it.
_VIEWS = r"(?=([0-9 -]{1,39}))[0-9]+[ -]?"
#: So often a run is permuted at most until it reads the same way: each time fails for about one in ten.
_WALK = 40
#: First and last day that dates are permuted among: 17 * 4297 days.
_FIRST_DAY, _DAYS = "1900-01-01", (17, 4297)


def _digest(key: Column, kind: str, r: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(kind), r.cast("string"), half.cast("string")).cast("binary"), 256)


def _number(key: Column, kind: str, r: Column, half: Column) -> Column:
    """56 bits of the round function."""
    return F.conv(F.substring(_digest(key, kind, r, half), 1, 14), 16, 10).cast("long")


def permute_number(x: Column, high: int, low: int, key: Column, kind: str, undo: bool = False) -> Column:
    """A permutation of 0..high*low-1: alternating Feistel on x div low and x mod low."""

    def step(acc: Column, r: Column) -> Column:
        sign = -1 if undo else 1
        a = F.pmod(acc["a"] + sign * F.pmod(_number(key, kind, r, acc["b"]), F.lit(high)), F.lit(high))
        b = F.pmod(acc["b"] + sign * F.pmod(_number(key, kind, r, acc["a"]), F.lit(low)), F.lit(low))
        even = r % 2 == 0
        return F.struct(F.when(even, a).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(b).alias("b"))

    x = x.cast("long")
    start = F.struct(F.floor(x / F.lit(low)).cast("long").alias("a"), F.pmod(x, F.lit(low)).cast("long").alias("b"))
    rounds = range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS)
    return F.aggregate(F.array(*[F.lit(r) for r in rounds]), start, step, lambda acc: acc["a"] * F.lit(low) + acc["b"])


def _shifted(half: Column, stream: Column, sign: int) -> Column:
    """Each letter and digit moved within its own class by the stream's bytes; anything else stays."""

    def move(c: Column, i: Column) -> Column:
        block = F.substring(F.sha2(F.concat(stream, F.floor(i / 32).cast("string")).cast("binary"), 256), 1, 64)
        by = F.conv(F.substr(block, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int") * sign
        code = F.ascii(c)

        def turn(first: str, n: int) -> Column:
            return F.char(F.pmod(code - ord(first) + by, F.lit(n)) + ord(first))

        return F.when(c.between("0", "9"), turn("0", 10)).when(c.between("a", "z"), turn("a", 26)).when(c.between("A", "Z"), turn("A", 26)).otherwise(c)

    return F.array_join(F.transform(F.split(half, ""), move), "")


def permute_text(x: Column, key: Column, kind: str, undo: bool = False) -> Column:
    """A permutation of the texts with x's pattern of letters, capitals, digits and other characters."""
    half = F.greatest(F.floor(F.char_length(x) / 2), F.lit(1)).cast("int")
    start = F.struct(F.substr(x, F.lit(1), half).alias("a"), F.substr(x, half + 1).alias("b"))

    def step(acc: Column, r: Column) -> Column:
        sign = -1 if undo else 1
        even = r % 2 == 0
        a = _shifted(acc["a"], _digest(key, kind, r, acc["b"]), sign)
        b = _shifted(acc["b"], _digest(key, kind, r, acc["a"]), sign)
        return F.struct(F.when(even, a).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(b).alias("b"))

    rounds = range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS)
    return F.aggregate(F.array(*[F.lit(r) for r in rounds]), start, step, lambda acc: F.concat(acc["a"], acc["b"]))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a text of digits."""

    def add(acc: Column, d: Column) -> Column:
        n = F.ascii(d) - 48
        doubled = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.struct((~acc["odd"]).alias("odd"), (acc["s"] + F.when(acc["odd"], doubled).otherwise(n)).alias("s"))

    start = F.struct(F.lit(False).alias("odd"), F.lit(0).alias("s"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, add, lambda acc: acc["s"])


def _into_format(x: Column, digits: Column) -> Column:
    """x with its digits replaced, in order, by `digits`."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(acc: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(
            F.concat(acc["out"], F.when(digit, F.substr(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"),
            (acc["at"] + F.when(digit, 1).otherwise(0)).alias("at"),
        )

    return F.aggregate(F.split(x, ""), start, put, lambda acc: acc["out"])


def _card(x: Column, key: Column, undo: bool) -> Column:
    """All digits but the last are permuted; the last is the check digit that makes the Luhn sum right."""
    body = F.substr(_digits(x), F.lit(1), F.char_length(_digits(x)) - 1)
    new = permute_text(body, key, "card", undo)
    check = F.pmod(-luhn_sum(F.concat(new, F.lit("0"))), F.lit(10)).cast("string")
    return _into_format(x, F.concat(new, check))


def _right_sum(x: Column) -> Column:
    return F.pmod(luhn_sum(_digits(x)), F.lit(10)) == 0


def _parts(x: Column) -> Column:
    """(at, n, kind) of the cards and phones in a run of digits: the whole run if it is a card, else at each group, from
    the left, the longest layout whose check digit is right, or a phone."""

    def found(view: Column) -> Column:
        cards = F.filter(F.array(*[F.regexp_extract(view, layout, 1) for layout in _CARD_AT]), lambda m: (m != "") & _right_sum(m))
        cards = F.transform(cards, lambda m: F.struct(F.char_length(m).alias("n"), F.lit("card").alias("kind")))
        phone = F.when(view.rlike(_PHONE_AT), F.struct(F.char_length(F.regexp_extract(view, _PHONE_AT, 1)).alias("n"), F.lit("phone").alias("kind")))
        return F.coalesce(F.when(view.rlike("|".join(_CARD_AT)), F.get(cards, F.lit(0))), phone)

    def step(acc: Column, g: Column) -> Column:
        hit = F.when(acc["at"] >= acc["free"], g["hit"])
        return F.struct(
            (acc["at"] + g["n"]).alias("at"),
            F.when(hit.isNotNull(), acc["at"] + hit["n"]).otherwise(acc["free"]).alias("free"),
            F.when(hit.isNotNull(), F.concat(acc["parts"], F.array(F.struct(acc["at"].alias("at"), hit["n"].alias("n"), hit["kind"].alias("kind"))))).otherwise(acc["parts"]).alias("parts"),
        )

    groups = F.zip_with(
        F.regexp_extract_all(x, F.lit(_VIEWS), F.lit(1)), F.regexp_extract_all(x, F.lit(_VIEWS), F.lit(0)),
        lambda view, group: F.struct(found(view).alias("hit"), F.char_length(group).alias("n")),
    )
    none = F.array().cast("array<struct<at:int,n:int,kind:string>>")
    start = F.struct(F.lit(1).alias("at"), F.lit(1).alias("free"), none.alias("parts"))
    whole = F.array(F.struct(F.lit(1).alias("at"), F.char_length(x).alias("n"), F.lit("card").alias("kind")))
    is_card = (F.char_length(_digits(x)) <= 19) & _right_sum(x)
    return F.when(is_card, whole).otherwise(F.aggregate(groups, start, step, lambda acc: acc["parts"]))


def _run(x: Column, key: Column, undo: bool) -> Column:
    """(y, pii) of a run of digits: y with its parts replaced (null if it has none), and each part's kind and pseudonym.

    The parts must be found again to be undone. Where a neighbour would by chance be read as part of a card, all parts are
    permuted again until the run reads as before (so the number's pseudonym is then another one than elsewhere)."""

    def replaced(v: Column, parts: Column) -> Column:
        def put(acc: Column, p: Column) -> Column:
            old = F.substr(v, p["at"], p["n"])
            new = F.when(p["kind"] == "card", _card(old, key, undo)).otherwise(_phone(old, key, undo))
            return F.struct(F.concat(acc["out"], F.substr(v, acc["at"], p["at"] - acc["at"]), new).alias("out"), (p["at"] + p["n"]).alias("at"))

        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
        return F.aggregate(parts, start, put, lambda acc: F.concat(acc["out"], F.substr(v, acc["at"])))

    def walk(acc: Column, _: Column) -> Column:
        same = F.coalesce(acc["found"] == acc["parts"], F.lit(False))
        y = F.when(same, acc["y"]).otherwise(replaced(acc["y"], acc["parts"]))
        return F.transform(F.array(y), lambda y: F.struct(y.alias("y"), acc["parts"].alias("parts"), F.when(same, acc["found"]).otherwise(_parts(y)).alias("found")))[0]

    def told(acc: Column) -> Column:
        each = F.transform(acc["parts"], lambda p: F.struct(p["kind"].alias("kind"), F.substr(acc["y"], p["at"], p["n"]).alias("pseudonym")))
        return F.when(F.size(acc["parts"]) > 0, F.struct(acc["y"].alias("y"), each.alias("pii")))

    unknown = F.lit(None).cast("array<struct<at:int,n:int,kind:string>>")
    return F.transform(F.array(_parts(x)), lambda parts: F.when(F.size(parts) > 0, F.aggregate(
        F.sequence(F.lit(1), F.lit(_WALK)), F.struct(x.alias("y"), parts.alias("parts"), unknown.alias("found")), walk, told)))[0]


def _walk(x: Column, valid: Callable[[Column], Column], step: Callable[[Column], Column]) -> Column:
    """x permuted by `step` until it is valid again; null if x isn't valid. Undoing walks back to x, the first valid one."""
    again = F.aggregate(F.sequence(F.lit(2), F.lit(_WALK)), step(x), lambda v, _: F.when(valid(v), v).otherwise(step(v)))
    return F.when(valid(x), again)


def _ipv4(x: Column, key: Column, undo: bool) -> Column:
    """Octets of 0 to 255, written without leading zeros."""
    octets = F.transform(F.split(x, r"\."), lambda o: o.cast("int"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, o: acc * 256 + o)
    new = permute_number(number, 1 << 16, 1 << 16, key, "ipv4", undo)
    parts = [F.pmod(F.shiftright(new, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]
    return F.when(F.forall(octets, lambda o: o < 256) & ~x.rlike(r"(^|\.)0[0-9]"), F.concat_ws(".", *parts))


def _date(x: Column, key: Column, undo: bool) -> Column:
    day = F.datediff(F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date"), F.lit(_FIRST_DAY).cast("date"))
    new = permute_number(day, *_DAYS, key, "date", undo)
    real = (day >= 0) & (day < _DAYS[0] * _DAYS[1])
    return F.when(real, F.date_format(F.date_add(F.lit(_FIRST_DAY).cast("date"), new.cast("int")), "yyyy-MM-dd"))


def _phone(x: Column, key: Column, undo: bool) -> Column:
    """The country code stays; the ten national digits are permuted. Area and exchange are not 000; other rules of the
    numbering plan are not asked for, since a number that breaks them may still be somebody's."""
    digits = _digits(x)
    national = F.substr(digits, F.char_length(digits) - 9)
    lead = F.substr(digits, F.lit(1), F.char_length(digits) - 10)
    new = _walk(national, lambda v: ~v.rlike("^(000|...000)"), lambda v: permute_text(v, key, "phone", undo))
    return F.when(new.isNotNull(), _into_format(x, F.concat(lead, new)))


def _ssn(x: Column, key: Column, undo: bool) -> Column:
    """Permuted among the numbers that can be issued."""
    return _walk(x, lambda v: ~v.rlike("^(000|666|9)|-00-|-0000$"), lambda v: permute_text(v, key, "ssn", undo))


def _email(x: Column, key: Column, undo: bool) -> Column:
    """Local part and host are permuted together; the top-level domain stays."""
    top = F.regexp_extract(x, r"\.[A-Za-z]+$", 0)
    rest = F.substr(x, F.lit(1), F.char_length(x) - F.char_length(top))
    return F.concat(permute_text(rest, key, "email", undo), top)


_FORMS: dict[str, Callable[[Column, Column, bool], Column]] = {
    "email": _email, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "phone": _phone,
}


def kind_of(x: Column) -> Column:
    """The kind whose pattern a candidate is, by its look; null for none."""
    look = {
        "email": F.contains(x, F.lit("@")),
        "ipv4": x.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"),
        "date": x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
        "ssn": x.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
        "phone": x.rlike(r"^(\+1[ .-]?)?(\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$"),
        "card": x.rlike(r"^[0-9]([ -]?[0-9]){12,}+$"),
    }
    return F.coalesce(*[F.when(test, F.lit(kind)) for kind, test in look.items()])


def pseudonym(x: Column, key: Column, undo: bool = False) -> Column:
    """(y, pii) of a candidate: what replaces it, and the kind and pseudonym of each value in it; null if none is valid."""

    def alone(k: str, y: Column) -> Column:
        return F.transform(F.array(y), lambda y: F.when(y.isNotNull(), F.struct(y.alias("y"), F.array(F.struct(F.lit(k).alias("kind"), y.alias("pseudonym"))).alias("pii"))))[0]

    return F.transform(F.array(kind_of(x)), lambda kind: F.coalesce(
        F.when(kind == "card", _run(x, key, undo)), *[F.when(kind == k, alone(k, form(x, key, undo))) for k, form in _FORMS.items()]))[0]


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", undo: bool = False) -> DataFrame:
    """Every row of docs with its text's PII replaced, and pii: for each replaced value, in order, (kind, pseudonym).

    Kinds: e-mail addresses, IPv4 addresses, dates (1900 to 2099), US social security numbers, North American phone
    numbers, and card numbers of 13 to 19 digits with a right check digit (beside other digits: those written unseparated
    or in the groups of a known layout). Candidates that fail validation stay as they are. With undo the same key gives
    the values back exactly: formats and validity are kept, so what was changed is found again and nothing else is.

    Null texts stay null, with no pii; empty and repeated rows are no special case, and an empty table stays empty. An
    input column named pii is replaced; all others keep their names.
    """
    rows = replace_columns(docs, "pii")
    kept, text = rows.columns, F.col(text_col)
    secret, held = free_names(rows, "secret", "found")
    rows = rows.withColumn(secret, docs.sparkSession.createDataFrame([(key,)], "key string").scalar())
    found = F.transform(F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)), lambda x: F.struct(x.alias("x"), pseudonym(x, F.col(secret), undo).alias("new")))
    rows = rows.withColumn(held, F.when(text.rlike(_HINT), F.when(text.rlike(_ANY), found)))
    between = F.split(text, _ANY, -1)
    pieces = F.zip_with(between, F.col(held), lambda a, f: F.concat(a, F.coalesce(f["new"]["y"], f["x"], F.lit(""))))
    replaced = F.filter(held, lambda f: f["new"].isNotNull())
    pii = F.flatten(F.transform(replaced, lambda f: f["new"]["pii"]))
    empty = F.array().cast("array<struct<kind:string,pseudonym:string>>")
    new_text = F.when(F.col(held).isNull(), text).otherwise(F.array_join(pieces, ""))
    out = [new_text.alias(c) if c == text_col else F.col(c) for c in kept]
    return rows.select(*out, F.coalesce(pii, empty).alias("pii"))
