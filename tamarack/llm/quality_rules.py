"""Quality rules as weak supervision.

Each rule looks at a few counts of a text and votes good (1) or bad (-1), or abstains (0). No rule alone decides: a label
model of two hidden classes, fitted by expectation-maximisation over all documents' votes, estimates how often each rule
votes good on good and on bad texts, and the posterior probability of the good class decides. Bad texts are bad in
different ways, so a rule may pass most of them; what it may not do is to pass more bad than good ones.

EM needs only how many documents have each pattern of votes. There are at most 3 ** len(rules) patterns, however many
documents; the driver gets no more than these counts, and the fitted model is len(rules) pairs of numbers in the plan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written
from .sizing import replace_columns
from .wordbytes import pieces, spaced

#: Words are runs of anything but ASCII white space.
_WORDS = spaced(b"\t\n\x0b\x0c\r")
#: What counts as a symbol.
SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
#: Bytes that go on with a code point; letters are ASCII ones and all of what lies outside ASCII.
_LATER = bytes(range(0x80, 0xC0))
_LETTERS = bytes(range(0x80, 0x100)) + _UPPER + _LOWER
_NO_LETTERS = bytes(b for b in range(0x21, 0x80) if b not in _LETTERS) + bytes(range(9)) + bytes(range(0x0E, 0x20))
#: What prose is written with; a word with any other byte is odd.
_PROSE = _LETTERS + b"0123456789" + b".,;:!?'\"()-"
_SPEECH = spaced(_NO_LETTERS + b"\t\n\x0b\x0c\r", fold=True)
#: Common insults of four languages, lower-case (only A-Z are folded); features() takes another list.
INSULTS = [
    "idiot", "idiots", "idiotic", "moron", "morons", "moronic", "imbecile", "stupid", "dumbass", "scum", "scumbag", "bastard", "bitch", "asshole", "disgusting", "pathetic", "retard", "retarded", "loser",
    "idiote", "imbécile", "connard", "salaud", "crétin", "abruti", "dummkopf", "arschloch", "trottel", "blödmann", "drecksau", "estúpido", "estúpida", "idiota", "imbécil", "cabrón", "gilipollas",
]

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [*COUNTS, "n_lines", "n_distinct", "n_lettered", "n_odd", "n_upper", "n_ascii_letters", "n_marks", "n_stutter", "n_insults"]
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Votes by a measure: good where it lies in [good[0], good[1]], bad outside of [fair[0], fair[1]], else it abstains; it
    abstains where the measure is null too."""

    name: str
    measure: str
    good: tuple[float, float]
    fair: tuple[float, float]

    def vote(self) -> Column:
        x = F.expr(self.measure)
        votes = F.when(x.between(*self.good), 1).when((x < self.fair[0]) | (x > self.fair[1]), -1)
        return F.coalesce(votes.otherwise(0), F.lit(0)).cast("byte").alias(self.name)


INF = math.inf
#: Bounds in the spirit of published web-text filters; shares are of words unless they say otherwise.
RULES = [
    Rule("length", "n_words", (50, INF), (20, INF)),
    Rule("word_length", "try_divide(word_chars, n_words)", (3, 10), (2.5, 15)),
    Rule("symbols", "try_divide(n_symbols, n_words)", (0, 0.05), (0, 0.1)),
    Rule("repeated_lines", "if(n_lines > 1, n_dup_lines / n_lines, null)", (0, 0.1), (0, 0.3)),
    Rule("repeated_windows", "try_divide(n_repeat_words, n_words)", (0, 0.05), (0, 0.15)),
    Rule("distinct_words", "if(n_words >= 50, n_distinct / n_words, null)", (0.25, 1), (0.1, 1)),
    Rule("lettered_words", "try_divide(n_lettered, n_words)", (0.9, 1), (0.7, 1)),
    Rule("odd_words", "try_divide(n_odd, n_words)", (0, 0.2), (0, 0.4)),
    Rule("upper_case", "try_divide(n_upper, n_ascii_letters)", (0, 0.2), (0, 0.5)),
    Rule("marks", "try_divide(n_marks, n_words)", (0, 0.1), (0, 0.5)),
    Rule("stutter", "try_divide(n_stutter, n_words)", (0, 0.02), (0, 0.1)),
    Rule("insults", "try_divide(n_insults, n_words)", (0, 0), (0, 0)),
]


def repeat_words(words: np.ndarray, size: int = WINDOW) -> int:
    """How many words lie in windows of `size` words that stand twice or more in the text. Words are numbers; windows are
    ranked exactly, by sorting pairs of what shorter windows were ranked to."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    rank, length = words.astype(np.int64), 1
    while length < size:
        step = min(length, size - length)  # a window of length + step from two of `length` that may overlap
        m = len(words) - length - step + 1
        pair = (rank[:m] << 32) | rank[step : step + m]
        order = np.argsort(pair)
        ordered = pair[order]
        rank, length = np.empty(m, np.int64), length + step
        rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        if rank[order[-1]] == m - 1:
            return 0  # all differ, and so do longer ones
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += again
    edge[size : size + n] -= again
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def counts(data: bytes, insults: frozenset[bytes]) -> tuple[int, ...]:
    """FEATURES of a text."""
    spread, code, parts, n = data.translate(_WORDS), {}, [], 0
    for part in pieces(spread):
        parts.append(np.fromiter(map(code.setdefault, part, range(n, n + len(part))), np.int64, len(part)))  # a word's number is its first place
        n += len(part)
    words = np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def having(less: bytes) -> int:
        """Words that are more than bytes of `less`."""
        return sum(map(len, pieces(spread.translate(None, less))))

    def bytes_in(kind: bytes) -> int:
        return len(data) - len(data.translate(None, kind))

    seen, dup, n_lines = set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            n_lines += 1
            dup += line in seen
            seen.add(line)
    return (
        n,
        len(spread.translate(None, b" " + _LATER)),
        bytes_in(SYMBOLS),
        dup,
        repeat_words(words),
        n_lines,
        len(code),
        having(_NO_LETTERS),
        having(_PROSE),
        bytes_in(_UPPER),
        bytes_in(_UPPER + _LOWER),
        bytes_in(b"!?"),
        int(np.count_nonzero(words[1:] == words[:-1])),
        sum(sum(map(insults.__contains__, part)) for part in pieces(data.translate(_SPEECH))),
    )


def features(docs: DataFrame, text_col: str = "text", keep_text: bool = False, insults: list[str] = INSULTS) -> DataFrame:
    """Every row of docs with FEATURES of its text (long), and without the text unless it is kept."""
    rows = replace_columns(docs, *FEATURES)
    at = rows.columns.index(text_col)
    kept = [k for k in range(len(rows.columns)) if keep_text or k != at]
    schema = T.StructType([rows.schema.fields[k] for k in kept])
    for name in FEATURES:
        schema = schema.add(name, "long")
    words = frozenset(w.encode() for w in insults)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(x.as_buffer().to_pybytes() if x.is_valid else b"", words) for x in batch.column(at).cast(pa.large_binary())]
            new = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *new], names=schema.names)

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Model:
    """Share of good texts; for each rule, how often it votes good on good and on bad texts where it votes."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def evidence(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of the good class for rows of votes."""
        good, bad = np.array(self.on_good), np.array(self.on_bad)
        for_good, for_bad = np.log(good / bad), np.log((1 - good) / (1 - bad))
        return math.log(self.prior / (1 - self.prior)) + (votes == 1) @ for_good + (votes == -1) @ for_bad


#: What the model believes before it has seen votes (share of good texts, how often a rule votes good on good and on bad
#: ones), and what share of the documents that belief weighs as much as.
PRIOR, ON_GOOD, ON_BAD, BELIEF = 0.8, 0.95, 0.6, 0.05
ROUNDS, TOLERANCE = 500, 1e-10


def fit(votes: np.ndarray, weights: np.ndarray) -> Model:
    """The label model of patterns of votes (-1, 0, 1) and how many documents have each, by EM.

    Rules may be right more often on one class than on the other; on good texts none is worse than chance, and none votes
    good more often on bad texts than on good ones, so the classes keep their meaning.
    """
    n_rules = votes.shape[1]
    good, bad = votes == 1, votes == -1
    model = Model(PRIOR, (ON_GOOD,) * n_rules, (ON_BAD,) * n_rules)
    seen = BELIEF * weights.sum() + 1
    for _ in range(ROUNDS):
        p = weights / (1 + np.exp(-np.clip(model.evidence(votes), -700, 700)))
        q = weights - p

        def share(x: np.ndarray, before: float) -> np.ndarray:
            yes, no = x @ good, x @ bad
            return (yes + seen * before) / (yes + no + seen)

        prior = float((p.sum() + seen * PRIOR) / (weights.sum() + seen))
        on_good = np.clip(share(p, ON_GOOD), 0.5, 0.999)
        on_bad = np.minimum(np.clip(share(q, ON_BAD), 0.001, 0.999), on_good)
        new = Model(prior, tuple(on_good.tolist()), tuple(on_bad.tolist()))
        moved = max(map(abs, np.subtract((new.prior, *new.on_good, *new.on_bad), (model.prior, *model.on_good, *model.on_bad))))
        model = new
        if moved < TOLERANCE:
            break
    return model


def patterns(rows: DataFrame, rules: list[Rule]) -> tuple[np.ndarray, np.ndarray]:
    """The patterns of votes in rows, in order, and how many rows have each: 3 ** len(rules) at most."""
    names = [r.name for r in rules]
    found = rows.groupBy(*names).count().collect()
    found.sort(key=lambda r: tuple(r)[: len(names)])
    votes = np.array([tuple(r)[: len(names)] for r in found], np.int64).reshape(len(found), len(names))
    return votes, np.array([r["count"] for r in found], np.float64)


def probability(model: Model, rules: list[Rule]) -> Column:
    """The posterior of the good class from the rules' votes."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for rule, good, bad in zip(rules, model.on_good, model.on_bad, strict=True):
        odds = odds + F.when(F.col(rule.name) == 1, math.log(good / bad)).when(F.col(rule.name) == -1, math.log((1 - good) / (1 - bad))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES, least: float = 0.5, keep_text: bool = True) -> DataFrame:
    """Every row of docs with FEATURES, a column of votes for each rule (named as it is), base_failed, probability (of being
    good, 6 places) and kept; without its text unless keep_text.

    base_failed: fewer than 10 words, or more than 20 % of the words lie in 5-word windows that the text has twice. kept:
    not base_failed and a probability of at least `least`. The model is fitted on all rows that have words.

    Null and empty texts have no words, so they fail. Very long texts are read whole, a few MB of words at a time. Repeated
    rows count as often as they stand there and get equal results; ties don't occur. Input columns named like an output
    are replaced, others stay, whatever their names. An empty table gives an empty table. Rows are written once with their
    counts to the shared folder.
    """
    names = [r.name for r in rules]
    clean = replace_columns(docs, *names, "base_failed", "probability", "kept")
    rows = written(features(clean, text_col, keep_text).select("*", *[r.vote() for r in rules]), "votes")
    model = fit(*patterns(rows.where("n_words > 0"), rules))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = rows.select("*", failed.alias("base_failed"), F.round(probability(model, rules), 6).alias("probability"))
    return out.select("*", (~F.col("base_failed") & (F.col("probability") >= least)).alias("kept"))
