"""SentencePiece encoding and decoding by a Viterbi pass over shared prefixes.

A text is cut into marked words: a run of U+2581 (spaces) and what follows it up to the next space or line feed. No
piece crosses such a cut, so each distinct word is encoded once a pass. Distinct words are sorted, which lays them out
as a trie in depth-first order; the forward column of a prefix (the last piece of its best segmentation) is kept on the
way down and used again by every word that shares the prefix.

The vocabulary is byte-fallback BPE, whose pieces have ranks, not probabilities: a plain best-sum path would not give
the model's segmentation. The forward step therefore takes the one piece that ends here and may follow the best
segmentation of the rest: two neighbours may stand together if merging their joined text by rank gives just those two.
That is the model's own result, prefix by prefix. Runs of two or more spaces, whose pieces share one rank, are merged
directly, from a heap.

Every row stands alone: no shuffle; the vocabulary (32,000 pieces, a fixed size) is broadcast. New words are gathered over
a few MB of texts before they are sorted, as larger tries share more.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .sizing import replace_columns

MARK = "▁"
#: Characters of text whose new words are sorted together.
_PASS_CHARS = 6_000_000
#: Characters of text split and mapped at once.
_STEP_CHARS = 500_000
#: Pairs of pieces whose neighbourhood a worker remembers.
_KEPT_PAIRS = 1 << 20
_RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def merge(text: str, scores: dict[str, float]) -> list[str]:
    """Pieces of a text by merging the best-ranked neighbours, leftmost first.

    Possible merges wait in a heap and neighbours are a linked list, so a text of n characters takes n log n steps
    (pieces are short). An entry is out of date when the parts it joins are no longer as long as they were.
    """
    n = len(text)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at each place; -1: no part starts there
    heap: list[tuple[float, int, int, int]] = []

    def offer(a: int) -> None:
        b = end[a]
        if b < n:
            s = scores.get(text[a : end[b]])
            if s is not None:
                heappush(heap, (-s, a, b, end[b]))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, b, c = heappop(heap)
        if end[a] != b or end[b] != c:
            continue
        end[a], end[b] = c, -1
        if c < n:
            before[c] = a
        if before[a] >= 0:
            offer(before[a])
        offer(a)
    parts, a = [], 0
    while a < n:
        parts.append(text[a : end[a]])
        a = end[a]
    return parts


_read: dict[str, dict] = {}


def read_vocabulary(model_file: str) -> dict:
    """Pieces with ids and scores, those that merging arrives at, the ids of bytes, and the bytes of each id. Runs on
    the driver."""
    if model_file in _read:
        return _read[model_file]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    if model.get_piece_size() >= 0xD800:
        raise ValueError("ids are held as 16-bit characters below the surrogates")
    pieces, scores, byte_ids, texts = {}, {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            texts.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            texts.append(b"")
        else:
            pieces[piece], scores[piece] = i, model.get_score(i)
            texts.append(piece.encode())
    sound = {p for p in pieces if merge(p, scores) == [p]}
    _read[model_file] = {"pieces": pieces, "scores": scores, "sound": sound, "bytes": byte_ids, "texts": texts}
    return _read[model_file]


class Codec:
    """Encodes words with one vocabulary; keeps what it has learnt about pieces and words.

    Ids are held as characters of a str (their code points), so that a text's ids are one join.
    """

    def __init__(self, vocabulary: dict):
        self.pieces, self.scores = vocabulary["pieces"], vocabulary["scores"]
        self.byte_ids, self.texts = vocabulary["bytes"], vocabulary["texts"]
        self.automaton = ahocorasick.Automaton()
        for p in vocabulary["sound"]:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.char = {p: chr(i) for p, i in self.pieces.items()}
        self.follow: dict[str, dict[str, bool]] = {}
        self.n_follow = 0
        self.marked: dict[str, str] = {}
        self.bare: dict[str, str] = {}

    def _may_follow(self, left: str, right: str) -> bool:
        row = self.follow.setdefault(left, {})
        known = row.get(right)
        if known is None:
            if self.n_follow >= _KEPT_PAIRS:
                self.follow.clear()
                row, self.n_follow = self.follow.setdefault(left, {}), 0
            self.n_follow += 1
            known = row[right] = left not in self.pieces or right not in self.pieces or merge(left + right, self.scores) == [left, right]
        return known

    def _ids(self, parts: Iterable[str]) -> str:
        return "".join(self.char.get(p) or "".join(chr(self.byte_ids[b]) for b in p.encode()) for p in parts)

    def encode_sorted(self, words: list[str]) -> Iterator[str]:
        """Ids of sorted words; forward columns of the prefix shared with the word before are used again."""
        column, before = [""], ""
        follow, char, iter_pieces = self.follow, self.char, self.automaton.iter
        nothing: dict[str, bool] = {}
        for word in words:
            if MARK + MARK in word:
                yield self._ids(merge(word, self.scores))
                continue
            n, same = len(word), 0
            most = min(n, len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del column[same + 1 :]
            at = same  # columns are there up to `at`
            for last, piece in iter_pieces(word):  # by end, longest first
                if last < at:
                    continue
                begin = last + 1 - len(piece)
                while at < last:  # nothing ended there: a character of its own
                    column.append(word[at])
                    at += 1
                if begin:
                    known = follow.get(column[begin], nothing).get(piece)
                    if not known and (known is not None or not self._may_follow(column[begin], piece)):
                        continue
                column.append(piece)
                at += 1
            column.extend(word[at:])
            before, parts, end = word, [], n
            while end:
                piece = column[end]
                parts.append(piece)
                end -= len(piece)
            parts.reverse()
            try:
                yield "".join([char[p] for p in parts])
            except KeyError:
                yield self._ids(parts)

    @staticmethod
    def _lines(text: str) -> Iterator[tuple[str, list[str]]]:
        """A text's lines as (first word, words that have a mark before them); empty ones tell of runs of spaces."""
        for k, line in enumerate(text.replace(" ", MARK).split("\n")):
            words = (MARK + line if k == 0 else line).split(MARK)
            yield words[0], words[1:]

    def learn(self, texts: Iterable[str]) -> None:
        """Makes the words of the texts the known ones."""
        marked, bare = set(), set()
        for text in texts:
            for first, rest in self._lines(text) if text else ():
                if "" in rest:
                    bare.update(_RUNS.findall(MARK.join([first, *rest])))
                else:
                    bare.add(first)
                    marked.update(rest)
        self.marked = self._learnt(marked, self.marked, MARK)
        self.bare = self._learnt(bare, self.bare, "")

    def _learnt(self, words: set[str], before: dict[str, str], mark: str) -> dict[str, str]:
        """Ids of words: those of the pass before are taken over."""
        out = {w: before[w] for w in words if w in before}
        new = sorted(words.difference(out))
        out.update(zip(new, self.encode_sorted([mark + w for w in new]), strict=True))
        return out

    def known(self, text: str) -> str:
        """Ids of a text whose words are all known."""
        if not text:
            return ""
        marked, bare, lines = self.marked.__getitem__, self.bare.__getitem__, []
        for first, rest in self._lines(text):
            if "" in rest:
                lines.append("".join(map(bare, _RUNS.findall(MARK.join([first, *rest])))))
            else:
                lines.append(bare(first) + "".join(map(marked, rest)))
        return chr(self.byte_ids[10]).join(lines)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        self.learn(texts)
        return [np.frombuffer(self.known(t).encode("utf-16-le"), np.uint16) for t in texts]

    def decode(self, ids: Iterable[int]) -> str:
        raw = b"".join(map(self.texts.__getitem__, ids))
        return raw.decode("utf-8", "replace").replace(MARK, " ")[1:]


_codecs: dict[int, Codec] = {}


def _codec(vocabulary) -> Codec:
    """The worker's codec of a broadcast vocabulary."""
    if vocabulary.id not in _codecs:
        _codecs.clear()
        _codecs[vocabulary.id] = Codec(vocabulary.value)
    return _codecs[vocabulary.id]


class _Shared:
    """A broadcast with a number that workers can keep things by."""

    def __init__(self, spark, vocabulary: dict):
        self.broadcast = spark.sparkContext.broadcast(vocabulary)
        self.id = self.broadcast._jbroadcast.id() if hasattr(self.broadcast, "_jbroadcast") else id(vocabulary)

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self) -> dict:
        return self.broadcast.value


def _spans(lengths: list[int], most: int, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges with at most `most` characters each (one row at least)."""
    a, total, end = begin, 0, len(lengths) if end is None else end
    for i in range(begin, end):
        if total + lengths[i] > most and i > a:
            yield a, i
            a, total = i, 0
        total += lengths[i]
    if a < end:
        yield a, end


def encode(docs: DataFrame, model_file: str, text_col: str = "text", keep_text: bool = True, decoded_col: str | None = None) -> DataFrame:
    """Every row of docs with `ids` (array of int) and, if asked for, the text decoded from them in the same pass.

    Null and empty texts have no ids. U+2581 in a text reads as a space, as the model has it. Texts of any length are
    encoded whole; words without end too, in time linear in their length (runs of n spaces: n log n). An input column named ids is replaced.
    """
    shared = _Shared(docs.sparkSession, read_vocabulary(model_file))
    extra = [decoded_col] if decoded_col else []
    rows = replace_columns(docs, "ids", *[c for c in extra if c != text_col])
    at = rows.columns.index(text_col)
    kept = [f for f in rows.schema.fields if keep_text or f.name != text_col]

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            texts = batch.column(at)
            lengths = [n or 0 for n in pc.utf8_length(texts).to_pylist()]
            for a, b in _spans(lengths, _PASS_CHARS):
                steps = list(_spans(lengths, _STEP_CHARS, a, b))
                codec.learn(t.as_py() or "" for i, j in steps for t in texts.slice(i, j - i))
                for i, j in steps:
                    part = batch.slice(i, j - i)
                    ids = [codec.known(t or "").encode("utf-16-le") for t in part.column(at).to_pylist()]
                    flat = np.frombuffer(b"".join(ids), np.uint16)
                    offsets = np.append(0, np.cumsum([len(x) // 2 for x in ids])).astype(np.int32)
                    column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
                    columns = [c for k, c in enumerate(part.columns) if keep_text or k != at]
                    decoded = [pa.array([codec.decode(np.frombuffer(x, np.uint16).tolist()) for x in ids], pa.string())] if extra else []
                    yield pa.RecordBatch.from_arrays([*columns, column, *decoded], names=[*[f.name for f in kept], "ids", *extra])

    schema = T.StructType(list(kept)).add("ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(run, schema.add(decoded_col, "string") if extra else schema)


def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids") -> DataFrame:
    """Every row of encoded with `decoded`, the text of its ids. Null ids give an empty text; control ids give no
    text. An input column named decoded is replaced."""
    shared = _Shared(encoded.sparkSession, read_vocabulary(model_file))
    rows = replace_columns(encoded, "decoded")
    at = rows.columns.index(ids_col)

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            for i, j in _spans([n or 0 for n in pc.list_value_length(batch.column(at)).to_pylist()], _STEP_CHARS):
                part = batch.slice(i, j - i)
                texts = [codec.decode(x or ()) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType(list(rows.schema.fields)).add("decoded", "string"))
