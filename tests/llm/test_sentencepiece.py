"""Runs of spaces, long words and the bounded memory of the SentencePiece codec."""

import random
import time

import pytest

from tamarack.llm import sentencepiece_codec as S
from tamarack.llm.queries import TOKENIZERS

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return S.read_vocabulary(MODEL)


def leftmost_best(text, scores):
    """Merging as it is defined: the best pair of all, the leftmost of equals, again and again."""
    parts = list(text)
    while True:
        found = [(-scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in scores]
        if not found:
            return parts
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merge_is_leftmost_best(vocabulary):
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choices("▁▁▁abethnio", k=r.randint(0, 40)))
        assert S.merge(text, vocabulary["scores"]) == leftmost_best(text, vocabulary["scores"])


def test_long_runs_of_spaces(model, vocabulary):
    codec = S.Codec(vocabulary)
    for text in (" " * 3000 + "ab", "x" + " " * 2999, " \n" * 500 + " " * 777 + "end"):
        assert codec.encode([text])[0].tolist() == model.encode(text)
    began = time.process_time()
    text = "a" + " " * 200_000 + "b" + "c" * 200_000
    assert codec.decode(codec.encode([text])[0].tolist()) == text
    assert time.process_time() - began < 30


def test_known_pairs_are_bounded(model, vocabulary, monkeypatch):
    monkeypatch.setattr(S, "_KEPT_PAIRS", 10)
    codec, r = S.Codec(vocabulary), random.Random(4)
    for _ in range(60):
        text = "".join(r.choices(["the", "tion", "un", " ", "a", "é", "Z", "99", "ing"], k=30))
        assert codec.encode([text])[0].tolist() == model.encode(text)
        assert sum(map(len, codec.follow.values())) <= 10
