"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 16 or more key characters (A-Z a-z 0-9 + / _ -) with a letter and a digit. What is shorter, has no
digit or no letter, or lies between other characters (pass phrases, PEM blocks, whose lines of base64 are candidates each)
is not looked at. The forest sees a candidate's length, how likely the transitions between its characters are in words, how
much of it dictionary words cover, its path, and the words next to it; it is trained from labelled findings that the caller
gives (labelled_findings makes some to start with). Everything runs in the JVM: DataFrame functions and Spark ML, no
Python on executors. Every row stands alone.
"""

from __future__ import annotations

import random
from math import log

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sizing import replace_columns

#: A run of 16 or more key characters that has a letter and a digit.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}"
#: Characters kept on either side as neighbouring words.
BEFORE, AFTER = 48, 32

#: Words whose letters do not look random.
DICTIONARY = (
    "access account admin adult alpha android apache apple application article asset async backup base batch beta bucket "
    "buffer build button cache channel class client cloud cluster code color column commit common config connect console "
    "content control convert core count country create current data database date debug default delete demo deploy design "
    "detail device digest document domain download driver dummy email enable encode engine entity error event example export "
    "factory feature field file filter first folder format frame from function gateway global google graph group handler "
    "hash header hello helper history home host html http icon image import index info input install instance item java "
    "json kernel label language last layer layout level library license light link list local locale login main manager "
    "master message method metrics mobile model module month mouse name native network node null number object office "
    "online option order output package page parent parser part pass path payment person phone photo place placeholder "
    "player plugin point policy post power print private process product profile program project property protocol proxy "
    "public python query queue random record region release remote report request resource response result return role "
    "root sample schema score screen script search section select sequence server service session setting share simple "
    "site size source space spring start state static status stock storage store stream string style submit summary "
    "support system table target task team template test text theme thread time title tools topic track transfer type "
    "update upload user utils value version video view virtual visit week widget window work world write your"
).split()
#: Kinds of characters in transitions: a letter each, digits, anything else.
_KINDS = 28


def transition_scores(words: list[str]) -> list[float]:
    """Log likelihoods of a kind of character after another, row by row, from the transitions in words; half an
    occurrence is added to each."""
    counts = [[0.5] * _KINDS for _ in range(_KINDS)]
    for w in words:
        kinds = [ord(c) - 97 if "a" <= c <= "z" else 26 if c.isdigit() else 27 for c in f" {w.lower()} "]
        for a, b in zip(kinds, kinds[1:], strict=False):
            counts[a][b] += 1
    return [round(log(n / sum(row)), 6) for row in counts for n in row]


_KEY_WORD = r"(?i)(token|secret|passw|pwd|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|bearer)\W*(\w+\W*)?$"
_ASSIGNED = r"[=:]\s*[\"'`]?$|(?i)bearer\s$"
_OTHER_WORD = r"(?i)(commit|sha-?[0-9]*|md5|checksum|digest|hash|uuid|guid|revision|etag|example|sample|dummy|fixture|version|build|image|href|url|path|file|class|import)\W*(\w+\W*)?$"
_OTHER_AFTER = r"(?i)^\W{0,3}\s*(\.\.\.|example|sample|placeholder|in test|\.(java|py|js|png|jpg|html))"
_PATH = r"(?i)(^|[/_.-])(tests?|examples?|fixtures?|samples?|docs?|mocks?|lock|sum|min)([/_.-]|$)"

FEATURES = [f"f_{name}" for name in ("length", "transitions", "distinct", "digits", "upper", "hex", "separators", "dictionary", "placeholder", "path", "key_word", "assigned", "other_word", "other_after")]


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row for each candidate of each row, without the text: n (from 1), candidate, before, after."""
    rows = replace_columns(docs, "n", "candidate", "before", "after")
    text = F.col(text_col)
    kept = [c for c in rows.columns if c != text_col]
    rows = rows.where(text.rlike(CANDIDATE)).select(*kept, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("_found"), F.split(text, CANDIDATE, -1).alias("_between"))
    met = F.transform(
        "_found",
        lambda x, i: F.struct(
            (i + 1).alias("n"),
            x.alias("candidate"),
            F.right(F.get("_between", i), F.lit(BEFORE)).alias("before"),
            F.left(F.get("_between", i + 1), F.lit(AFTER)).alias("after"),
        ),
    )
    return rows.select(*kept, F.explode(met).alias("_c")).select(*kept, "_c.*")


def _likeliness(c: Column, words: list[str]) -> Column:
    """Mean score of the transitions in c."""
    scores = F.array(*[F.lit(x) for x in transition_scores(words)])
    kind = lambda x: F.when(x.between("a", "z"), F.ascii(x) - 97).when(x.between("0", "9"), 26).otherwise(27)
    kinds = F.transform(F.split(F.lower(c), ""), kind)

    def mean(k: Column) -> Column:
        found = F.zip_with(F.slice(k, 1, F.size(k) - 1), F.slice(k, 2, F.size(k) - 1), lambda a, b: F.get(scores, a * _KINDS + b))
        return F.aggregate(found, F.lit(0.0), lambda total, x: total + x) / F.size(found)

    return F.transform(F.array(kinds), mean)[0]


def with_features(findings: DataFrame, path_col: str | None = None, words: list[str] = DICTIONARY) -> DataFrame:
    """findings (candidate, before, after) with one column for each feature; words: the dictionary, in lower case."""
    c = F.col("candidate")
    n = F.char_length(c).cast("double")
    dictionary = "|".join(sorted(words, key=lambda w: (-len(w), w)))

    def share(pattern: str, x: Column = c) -> Column:
        return F.regexp_count(x, F.lit(pattern)) / n

    cover = (n - F.char_length(F.regexp_replace(F.lower(c), dictionary, ""))) / n

    def flag(test: Column) -> Column:
        return F.coalesce(test.cast("double"), F.lit(0.0))

    return findings.withColumns(
        {
            "f_length": F.least(n, F.lit(200.0)),
            "f_transitions": F.round(_likeliness(c, words), 6),
            "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64.0)),
            "f_digits": share("[0-9]"),
            "f_upper": share("[A-Z]"),
            "f_hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
            "f_separators": share("[+/_=-]"),
            "f_dictionary": cover,
            "f_placeholder": flag(c.rlike(r"(?i)x{4}|(.)\1{4}|01234|12345|abcde|your|here|todo|changeme|example")),
            "f_path": flag(F.col(path_col).rlike(_PATH)) if path_col else F.lit(0.0),
            "f_key_word": flag(F.col("before").rlike(_KEY_WORD)),
            "f_assigned": flag(F.col("before").rlike(_ASSIGNED)),
            "f_other_word": flag(F.col("before").rlike(_OTHER_WORD)),
            "f_other_after": flag(F.col("after").rlike(_OTHER_AFTER)),
        }
    )


def labelled_findings(spark: SparkSession, n: int = 600, seed: int = 11) -> DataFrame:
    """n labelled findings (candidate, before, after, path, label), drawn from the shapes that reviewers meet: random
    keys under telling names (1), and hashes, identifiers, paths, placeholders and ids (0). A bounded training set."""
    r = random.Random(seed)
    hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def some(letters: str, low: int, high: int) -> str:
        while True:
            s = "".join(r.choices(letters, k=r.randint(low, high)))
            if any(x.isdigit() for x in s) and any(x.isalpha() for x in s):
                return s

    def words(k: int) -> list[str]:
        return r.choices(DICTIONARY, k=k)

    def secret() -> tuple:
        name = r.choice(["token", "api_key", "secret", "password", "TOKEN", "auth_token", "access-key", "client_secret", "SECRET_KEY", "credentials"])
        value = r.choice([some(hexes, 32, 64), some(hexes, 40, 40), some(hexes, 40, 40).upper(), some(mixed, 20, 48), some(mixed + "+/", 36, 44), some(mixed + "_-", 24, 40)])
        before = " ".join(words(r.randint(0, 4))) + " " + name + r.choice([' = "', "=", ": ", ' : "', " = '", ":", '="'])
        return value, before, r.choice(['" ', "'\n", "\n", " ", '";', "&&& "]) + " ".join(words(2)), r.choice(["src/app", "config/prod.env", "notes", "src3"]), 1.0

    def harmless() -> tuple:
        kind = r.randrange(8)
        before, after, path = " ".join(words(3)) + " ", " " + " ".join(words(2)), r.choice(["src/app", "docs/guide.md", "tests/unit", "package.lock", "notes", "src3"])
        if kind == 0:
            value, before = some(hexes, 40, 40), before + r.choice(["commit ", "sha1: ", "revision ", "git sha "])
        elif kind == 1:
            value, before = some(hexes, 32, 64), before + r.choice(["md5 = ", "checksum: ", "sha256:", "digest ", "etag: "])
        elif kind == 2:
            x = some(hexes, 32, 32)
            value = "-".join([x[:8], x[8:12], x[12:16], x[16:20], x[20:]])
            before += r.choice(["uuid ", "id: ", "guid = ", "request "])
        elif kind == 3:
            value = "".join(w.title() for w in words(3)) + str(r.randint(0, 99)) + words(1)[0].title()
        elif kind == 4:
            value = "/".join(words(4)) + str(r.randint(0, 9))
        elif kind == 5:
            value = r.choice(["your_api_key_here_123", "xxxxxxxxxxxxxxxx1", "0123456789abcdef", "example_token_12345", "CHANGEME1234567890", "a1aaaaaaaaaaaaaaaa"])
            before += r.choice(["token = ", "api_key: ", "password = "])
        elif kind == 6:
            value = "_".join(words(3)) + "_" + str(r.randint(1, 2025))
            before += r.choice(["token_type = ", "auth: ", "", ""])
        else:
            value = words(1)[0] + "-" + words(1)[0] + "-" + str(r.randint(10**6, 10**9))
        return value, before, after, path, 0.0

    rows = [secret() if i % 2 else harmless() for i in range(n)]
    return spark.createDataFrame(rows, "candidate string, before string, after string, path string, label double")


def train(findings: DataFrame, trees: int = 20, depth: int = 6, seed: int = 3) -> RandomForestClassificationModel:
    """A forest from labelled findings (candidate, before, after, path, label)."""
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(findings, "path"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(vectors.select("features", "label"))


def forest_probability(model: RandomForestClassificationModel) -> Column:
    """The forest's probability of a secret from the columns FEATURES: the mean over trees of the share of secrets in the
    leaf that a row falls into. The trees' nodes are constant arrays (what is compared, with what, where either side goes on,
    the share); a row walks down from each root in as many steps as the deepest tree has. So the plan holds expressions
    only, no functions of a fitted model, whatever session or thread has used that before."""
    feature, threshold, left, right, share, roots = [], [], [], [], [], []

    def add(node) -> int:
        """Appends a node and what is below it; its place."""
        at = len(feature)
        for x in (feature, threshold, left, right, share):
            x.append(0)
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            feature[at], left[at], right[at], share[at] = -1, at, at, stats[1] / sum(stats)
        else:
            feature[at], threshold[at] = node.split().featureIndex(), node.split().threshold()
            left[at], right[at] = add(node.leftChild()), add(node.rightChild())
        return at

    trees = [tree._java_obj.rootNode() for tree in model.trees]
    roots = [add(root) for root in trees]

    def constant(values: list, kind: str) -> Column:
        return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")

    feature, left, right, threshold, share = (constant(x, k) for x, k in ((feature, "int"), (left, "int"), (right, "int"), (threshold, "double"), (share, "double")))
    row = F.array(*[F.col(f) for f in FEATURES])

    def down(node: Column, _: Column) -> Column:
        what = F.get(feature, node)
        return F.when(what < 0, node).when(F.get(row, what) <= F.get(threshold, node), F.get(left, node)).otherwise(F.get(right, node))

    steps = F.sequence(F.lit(1), F.lit(max([1, *[r.subtreeDepth() for r in trees]])))
    leaves = F.transform(constant(roots, "int"), lambda root: F.get(share, F.aggregate(steps, root, down)))
    return F.aggregate(leaves, F.lit(0.0), lambda total, x: total + x) / len(roots)


def scan(docs: DataFrame, model: RandomForestClassificationModel, text_col: str = "text", path_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """The findings of docs that the forest holds for secrets: the other columns of docs, n, candidate, before, after,
    probability (4 places).

    Null and empty texts have none; repeated rows report theirs each, with equal probabilities; a null path reads as no test
    path. Very long texts are read whole: their candidates are cut out before anything else, so only these, with BEFORE and
    AFTER characters, go on. Input columns named like an output are replaced. An empty table gives an empty table.
    """
    found = with_features(candidates(replace_columns(docs, "probability", *FEATURES), text_col), path_col)
    out = found.withColumn("probability", F.round(forest_probability(model), 4))
    return out.where(F.col("probability") >= threshold).drop(*FEATURES)
