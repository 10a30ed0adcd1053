"""Secret scan: candidates and features against plain Python, and findings of shapes that the forest was not trained on."""

import random
import re
import string

import pytest

from tamarack.llm import secret_scan as S
from tests.conftest import DATA


@pytest.fixture(scope="module")
def model(spark):
    return S.train(S.labelled_findings(spark))


def plain_candidates(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]+", text or ""):
        run = m[0]
        tail = re.match(r"={0,2}", text[m.end() :])[0]
        if len(run) >= 16 and re.search("[0-9]", run) and re.search("[A-Za-z]", run):
            found.append((run + tail, text[: m.start()], text[m.end() + len(tail) :]))
    return found


def test_candidates_and_features(spark):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("text").collect()]
    texts += [None, "", "x" * 30, "1" * 30, "abc12", 'key = "A1b2C3d4E5f6G7h8I9" and a_1/b-2+c3d4e5f6g==', "token: Passw0rd-for-admin-user-2024 example", "a1" * 400]
    df = spark.createDataFrame([(i, "tests/unit" if i % 2 else "src", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    rows = S.with_features(S.candidates(df), "path").collect()
    want = {}
    for i, t in enumerate(texts):
        for n, (c, before, after) in enumerate(plain_candidates(t), 1):
            want[i, n] = (c, before, after)
    assert {(r.doc_id, r.n): r.candidate for r in rows} == {k: v[0] for k, v in want.items()} and len(want) > 5
    scores = S.transition_scores(S.DICTIONARY)
    kind = lambda x: ord(x) - 97 if "a" <= x <= "z" else 26 if x.isdigit() else 27
    for r in rows:
        c, n = r.candidate, len(r.candidate)
        k = [kind(x) for x in c.lower()]
        left = re.sub("|".join(sorted(S.DICTIONARY, key=lambda w: (-len(w), w))), "", c.lower())
        assert r.f_transitions == pytest.approx(sum(scores[a * 28 + b] for a, b in zip(k, k[1:], strict=False)) / (n - 1), abs=1e-5)
        assert r.f_dictionary == pytest.approx((n - len(left)) / n) and r.f_length == min(n, 200)
        assert (r.f_digits, r.f_upper) == pytest.approx((sum(map(str.isdigit, c)) / n, sum(map(str.isupper, c)) / n))
        assert r.f_distinct == pytest.approx(len(set(c)) / min(n, 64)) and r.f_path == r.doc_id % 2


def independent(seed):
    """Findings in shapes of their own: provider keys, tokens and passwords in configuration against digests, names,
    addresses and numbers in logs, locks and pages."""
    r = random.Random(seed)
    some = lambda letters, n: "".join(r.choices(letters, k=n - 2)) + "q7"
    b62, b36 = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits
    secrets = [
        ("config/app.env", 'AWS_SECRET_ACCESS_KEY="{}"', lambda: some(b62 + "/+", 40)), ("src/pay", "stripe secret: {}", lambda: "sk_live_" + some(b62, 24)), ("deploy", "export GITHUB_TOKEN={}", lambda: "ghp_" + some(b62, 36)),
        ("src/chat", "slack_token = '{}'", lambda: "xoxb-" + some(string.digits, 12) + "-" + some(b62, 24)), ("app", "Authorization: Bearer {}", lambda: some(b62 + "-_", 43)), ("ops", "db password={} host=db1", lambda: some(b62 + "_-", 22)),
    ]
    words = ["user", "order", "table", "image", "market", "window", "report", "season", "garden", "yellow", "simple"]
    harmless = [
        ("package-lock", 'integrity "sha512-{}"', lambda: some(b62 + "/+", 60)), ("notes", "merged commit {} into main", lambda: some("0123456789abcdef", 40)), ("docs", "see https://x.example/{} there", lambda: "/".join(r.choices(words, k=3)) + f"/{r.randint(1, 99)}"),
        ("web", '<img class="{}">', lambda: "-".join(r.choices(words, k=3)) + f"-{r.randint(1, 999)}"), ("log", "request id 8f{} done", lambda: some("0123456789abcdef", 8) + "-4e1a-9c1d-" + some("0123456789abcdef", 12)), ("src", "def {}():", lambda: "_".join(r.choices(words, k=3)) + "_v2"),
        ("docs/howto", "api_key: {}", lambda: r.choice(["your_api_key_goes_here_1", "xxxxxxxxxxxxxxxxxxxx1a", "example_secret_token_1234"])),
    ]
    return [(path, line.format(make()), label) for label, kinds in ((1, secrets), (0, harmless)) for path, line, make in kinds for _ in range(40)]


def test_probabilities_are_the_models(spark, model):
    from pyspark.ml.linalg import Vectors

    found = S.with_features(S.candidates(spark.createDataFrame([(i, *x) for i, x in enumerate(independent(5))], "doc_id long, path string, text string, label int")), "path")
    told = found.select(*S.FEATURES, S.forest_probability(model).alias("p")).collect()
    want = [model.predictProbability(Vectors.dense([r[f] for f in S.FEATURES]))[1] for r in told]
    assert len(told) > 200 and [r.p for r in told] == pytest.approx(want, abs=1e-9) and len({round(x, 3) for x in want}) > 8


def test_shapes_not_trained_on(spark, model):
    rows = [(i, *x) for i, x in enumerate(independent(21))]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string, label int")
    found = {r.doc_id for r in S.scan(df.drop("label"), model, path_col="path").collect()}
    caught = [i in found for i, _, _, label in rows if label]
    wrong = [i in found for i, _, _, label in rows if not label]
    assert sum(caught) >= 0.7 * len(caught) and sum(wrong) <= 0.2 * len(wrong), (sum(caught) / len(caught), sum(wrong) / len(wrong))


def test_edges(spark, model):
    df = spark.createDataFrame([(1, None, None, 5), (2, "", None, 5), (3, 'token = "d4e71e33b54f40bc277a32011430a66d5e984911"', None, 5)] * 2, "doc_id long, text string, path string, n int")
    out = S.scan(df, model, path_col="path")
    assert [(r.doc_id, r.n) for r in out.collect()] == [(3, 1)] * 2 and "f_length" not in out.columns
    assert S.scan(df.limit(0), model, path_col="path").count() == 0
