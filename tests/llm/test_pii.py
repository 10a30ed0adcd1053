"""PII pseudonyms against a second implementation, undoing on random texts, validity and what plans show."""

import contextlib
import datetime as dt
import hashlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from tamarack.llm import pii
from tamarack.llm.queries import PII_KEY, QUERIES
from tests.conftest import DATA


def digest(key, kind, r, half):
    return hashlib.sha256(f"{key}|{kind}|{r}|{half}".encode()).hexdigest()


def permuted_number(x, high, low, key, kind):
    a, b = divmod(x, low)
    for r in range(8):
        if r % 2 == 0:
            a = (a + int(digest(key, kind, r, b)[:14], 16)) % high
        else:
            b = (b + int(digest(key, kind, r, a)[:14], 16)) % low
    return a * low + b


def moved(half, stream):
    out = []
    for i, c in enumerate(half):
        by = int(hashlib.sha256(f"{stream}{i // 32}".encode()).hexdigest()[i % 32 * 2 : i % 32 * 2 + 2], 16)
        for first, n in (("0", 10), ("a", 26), ("A", 26)):
            if ord(first) <= ord(c) < ord(first) + n:
                c = chr((ord(c) - ord(first) + by) % n + ord(first))
                break
        out.append(c)
    return "".join(out)


def permuted_text(x, key, kind):
    n = max(len(x) // 2, 1)
    a, b = x[:n], x[n:]
    for r in range(8):
        if r % 2 == 0:
            a = moved(a, digest(key, kind, r, b))
        else:
            b = moved(b, digest(key, kind, r, a))
    return a + b


def walked(x, valid, key, kind):
    x = permuted_text(x, key, kind)
    while not valid(x):
        x = permuted_text(x, key, kind)
    return x


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def put(x, digits):
    digits = iter(digits)
    return re.sub("[0-9]", lambda _: next(digits), x)


def phone_ok(d):
    return d[:3] != "000" and d[3:6] != "000"


def ssn_ok(s):
    return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"


def expected(x, key):
    """What a value that stands alone becomes (itself, if it isn't valid)."""
    digits = re.sub("[^0-9]", "", x)
    if "@" in x:
        rest, top = re.fullmatch(r"(.*)(\.[A-Za-z]+)", x).groups()
        return permuted_text(rest, key, "email") + top
    if re.fullmatch(r"\d+(\.\d+){3}", x):
        octets = x.split(".")
        if any(int(o) > 255 or str(int(o)) != o for o in octets):
            return x
        n = permuted_number(int.from_bytes(bytes(map(int, octets))), 1 << 16, 1 << 16, key, "ipv4")
        return ".".join(map(str, n.to_bytes(4)))
    if re.fullmatch(r"\d{4}-\d\d-\d\d", x):
        try:
            day = (dt.date.fromisoformat(x) - dt.date(1900, 1, 1)).days
        except ValueError:
            return x
        return str(dt.date(1900, 1, 1) + dt.timedelta(permuted_number(day, 17, 4297, key, "date"))) if 0 <= day < 17 * 4297 else x
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", x):
        return walked(x, ssn_ok, key, "ssn") if ssn_ok(x) else x
    if len(digits) in (10, 11):
        return put(x, digits[:-10] + walked(digits[-10:], phone_ok, key, "phone")) if phone_ok(digits[-10:]) else x
    if not luhn(digits):
        return x
    body = permuted_text(digits[:-1], key, "card")
    return put(x, body + next(c for c in "0123456789" if luhn(body + c)))


ALONE = re.compile(
    r"[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|(?<![\d-])\d{4}-\d\d-\d\d(?![\d-])|(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])"
    r"|(?<![\d+])\+1 \(\d{3}\) \d{3}-\d{4}(?!\d)|(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])",
    re.A,
)


def test_query_equals_second_implementation(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    n = 0
    for r in QUERIES["op4_pii_pseudonyms"](spark, f"{DATA}/sf0.01").collect():
        want = ALONE.sub(lambda m: expected(m[0], PII_KEY), docs[r.doc_id])
        assert r.text == want, r.doc_id
        n += r.n_replaced
    assert n > 20


@pytest.fixture(scope="module")
def values():
    r = random.Random(7)
    out = []
    for _ in range(120):
        body = "".join(r.choices("0123456789", k=r.randint(12, 18)))
        out += [body + next(c for c in "0123456789" if luhn(body + c)), "".join(r.choices("0123456789", k=16))]
        out += ["{:03}-{:02}-{:04}".format(r.randint(0, 999), r.randint(0, 30), r.randint(0, 40)), f"({r.randint(0, 999):03}) {r.choice([0, 555]):03}-{r.randint(0, 9999):04}"]
        out += [".".join(str(r.randint(0, 300)) for _ in range(4)), f"{r.randint(1850, 2150)}-{r.randint(1, 13):02}-{r.randint(1, 31):02}", f"ab{r.randint(0, 99)}.Cd@x{r.randint(0, 9)}-y.Org"]
    return [*out, "000-000-0000", "000-12-3456", "192.168.001.001"]


def test_values_alone_equal_second_implementation(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(df, "key").collect()}
    assert got == {i: expected(x, "key") for i, x in enumerate(values)}


def test_pseudonyms_are_valid_and_differ(spark):
    ssns = [f"{a:03}-{g:02}-{s:04}" for a in range(1, 400, 7) for g in range(1, 100, 9) for s in (1, 42, 9999)]
    df = spark.createDataFrame([(x,) for x in ssns], "text string")
    out = [r.text for r in pii.pseudonymise(df, "k").collect()]
    assert all(map(ssn_ok, out)) and len(set(out)) == len(ssns)


def test_probes(spark):
    texts = ["see 3 2024-02-29 078-05-1120 end", "ids 1 2 3 4 4012888888881881", "ssn 000-12-3456 x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pii.pseudonymise(df, "k")
    got = {r.doc_id: r for r in out.collect()}
    assert [[p.kind for p in got[i].pii] for i in range(3)] == [["date", "ssn"], ["card"], []]
    assert "2024-02-29" not in got[0].text and "4012888888881881" not in got[1].text and got[2].text == texts[2]
    assert [r.text for r in pii.pseudonymise(out.drop("pii"), "k", undo=True).orderBy("doc_id").collect()] == texts


def test_undo_is_the_identity_on_random_texts(spark, values):
    r = random.Random(11)
    bits = [*values, "4111 1111 1111 1111", "4111-1111-1111-1111", "555 123 4567", "+1 555 123 4567"]
    texts = ["".join(r.choice([r.choice(bits), "".join(r.choices("0123456789 -.()+@aZ,\n", k=r.randint(1, 25)))]) + r.choice(["", " ", "-", ", "]) for _ in range(r.randint(1, 7))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = pii.pseudonymise(pii.pseudonymise(df, "k").drop("pii"), "k", undo=True)
    wrong = [(t, x.text) for t, x in zip(texts, back.orderBy("doc_id").collect(), strict=True) if t != x.text]
    assert not wrong, wrong[:5]


def test_key_is_not_in_the_plan_and_names_stay(spark):
    df = spark.createDataFrame([(1, None, 2, 3), (2, "", 2, 3)], "doc_id long, text string, secret int, found int")
    out, shown = pii.pseudonymise(df, "very-secret-key"), io.StringIO()
    with contextlib.redirect_stdout(shown):
        out.explain(True)
    assert "very-secret-key" not in shown.getvalue()
    assert out.columns == ["doc_id", "text", "secret", "found", "pii"] and {r.doc_id: r.text for r in out.collect()} == {1: None, 2: ""}
    assert pii.pseudonymise(df.limit(0), "k").count() == 0 and out.where(F.size("pii") > 0).count() == 0
