"""Token counts that follow edits: a segment tree of pre-tokens per document.

A document is split into pre-tokens by the encoder's pattern; leaves of its tree hold runs of them with their lengths
and token counts, inner nodes the sums. An edit finds its place by character sums, splits anew only from a few
pre-tokens before it until a boundary behind it falls on an old one, encodes the pre-tokens in between, and updates
the sums on the paths above the touched leaves. A leaf that edits have made longer than twice LEAF is split and the
tree above is built anew, so many edits at one place leave no long leaf (an edit still copies the document's text once).

Every row stands alone: no shuffle; the rank table (a fixed size) is broadcast.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .sizing import replace_columns

#: Pre-tokens a leaf holds at first; pre-tokens split anew before an edit (the pattern's reach is shorter).
LEAF, CONTEXT = 64, 4
_SLICE_BYTES, _KEPT = 2 << 20, 500_000


def read_ranks(rank_file: str) -> dict[bytes, int]:
    """A tiktoken rank file. Runs on the driver."""
    with open(rank_file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Counter:
    """Counts tokens of pre-tokens; each distinct one is encoded once a worker while kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) > _KEPT:
                self.known.clear()
            n = self.known[piece] = len(self.encoding._encode_single_piece(piece))
        return n


class Document:
    """A text with the segment tree of its pre-tokens."""

    def __init__(self, counter: Counter, text: str):
        self.counter, self.text, self.encoded = counter, text, 0
        pieces = counter.pattern.findall(text)
        lengths, counts = list(map(len, pieces)), list(map(counter.count, pieces))
        self.leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF)] or [([], [])]
        self._build([(sum(a), sum(b)) for a, b in self.leaves])

    def _build(self, sums: list[tuple[int, int]]) -> None:
        """The tree above the leaves, whose sums are given."""
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = [(0, 0)] * (2 * self.size)
        self.sums[self.size : self.size + len(sums)] = sums
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _split(self) -> None:
        """Cuts long leaves into ones of LEAF pre-tokens and drops empty ones."""
        leaves, sums = [], []
        for (a, b), total in zip(self.leaves, self.sums[self.size :], strict=False):
            if len(a) > 2 * LEAF:
                parts = [(a[i : i + LEAF], b[i : i + LEAF]) for i in range(0, len(a), LEAF)]
                leaves += parts
                sums += [(sum(x), sum(y)) for x, y in parts]
            elif a:
                leaves.append((a, b))
                sums.append(total)
        self.leaves = leaves
        self._build(sums)

    def _sum(self, i: int) -> None:
        a, b = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a[0] + b[0], a[1] + b[1])

    @property
    def n_tokens(self) -> int:
        return self.sums[1][1]

    def _find(self, char: int) -> tuple[int, int]:
        """The leaf whose characters include `char`, and where the leaf begins."""
        i, begin = 1, 0
        while i < self.size:
            left = self.sums[2 * i][0]
            i = 2 * i
            if char >= begin + left and self.sums[i + 1][0]:
                begin += left
                i += 1
        return i - self.size, begin

    def _back(self, start: int) -> tuple[int, int, int]:
        """CONTEXT pre-tokens before the one at `start`: its leaf, index there, and first character."""
        leaf, begin = self._find(max(0, start - 1))
        k, lengths = 0, self.leaves[leaf][0]
        while k < len(lengths) and begin + lengths[k] < start:
            begin += lengths[k]
            k += 1
        for _ in range(CONTEXT):
            while k == 0 and leaf > 0:
                leaf -= 1
                k = len(self.leaves[leaf][0])
            if k == 0:
                break
            k -= 1
            begin -= self.leaves[leaf][0][k]
        return leaf, k, begin

    def edit(self, start: int, delete: int, insert: str) -> None:
        """Replace `delete` characters from `start` by `insert`; both are cut to the text."""
        start = min(max(0, start), len(self.text))
        delete = min(max(0, delete), len(self.text) - start)
        self.text = self.text[:start] + insert + self.text[start + delete :]
        moved, safe = len(insert) - delete, start + delete
        leaf, k, begin = self._back(start)
        last, j, old = leaf, k, begin  # the first old pre-token not yet replaced, and its first character
        lengths, counts, now = [], [], begin
        for m in self.counter.pattern.finditer(self.text, begin):
            while old < min(now - moved, len(self.text) - moved) or old < safe:
                while last < len(self.leaves) and j == len(self.leaves[last][0]):
                    last, j = last + 1, 0
                if last == len(self.leaves):
                    break
                old += self.leaves[last][0][j]
                j += 1
            if now - moved == old and old >= safe and now >= start + len(insert):
                break
            lengths.append(m.end() - m.start())
            counts.append(self.counter.count(m.group()))
            now = m.end()
        else:
            last, j = len(self.leaves), 0
        self.encoded += len(counts)
        self._replace(leaf, k, last, j, lengths, counts)

    def _replace(self, leaf: int, k: int, last: int, j: int, lengths: list[int], counts: list[int]) -> None:
        tail = self.leaves[last] if last < len(self.leaves) else ([], [])
        if leaf == last:
            new = (self.leaves[leaf][0][:k] + lengths + tail[0][j:], self.leaves[leaf][1][:k] + counts + tail[1][j:])
            self.leaves[leaf] = new
        else:
            self.leaves[leaf] = (self.leaves[leaf][0][:k] + lengths, self.leaves[leaf][1][:k] + counts)
            for i in range(leaf + 1, min(last, len(self.leaves))):
                self.leaves[i] = ([], [])
            if last < len(self.leaves):
                self.leaves[last] = (tail[0][j:], tail[1][j:])
        touched = range(leaf, min(last, len(self.leaves) - 1) + 1)
        for i in touched:
            self.sums[self.size + i] = (sum(self.leaves[i][0]), sum(self.leaves[i][1]))
        if len(self.leaves[leaf][0]) > 2 * LEAF:
            self._split()
            return
        above = {(self.size + i) // 2 for i in touched}
        while above and above != {0}:
            for i in above:
                self._sum(i)
            above = {i // 2 for i in above}


_counters: dict[tuple, Counter] = {}


def _counter(broadcast, pattern: str) -> Counter:
    key = (len(broadcast.value), pattern, broadcast.value.get(b" the"))
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(broadcast.value, pattern)
    return _counters[key]


def count_tokens(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Every row of docs, without text and edits, with n_tokens, n_tokens_after, n_encoded, n_edits and edited_text.

    edits is an array of (start, delete, insert), applied in order, each to the text the one before left; positions
    are code points and are cut to the text. n_encoded counts pre-tokens encoded again for all edits.

    Null texts read as empty, null edit lists as none, null members of an edit as 0 or "". Input columns named like an
    output are replaced.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    rows = replace_columns(docs, "n_tokens", "n_tokens_after", "n_encoded", "n_edits", "edited_text")
    text, edits = rows.columns.index(text_col), rows.columns.index(edits_col)
    kept = [i for i in range(len(rows.columns)) if i not in (text, edits)]
    schema = T.StructType([rows.schema.fields[i] for i in kept])
    for name, kind in (("n_tokens", "long"), ("n_tokens_after", "long"), ("n_encoded", "long"), ("n_edits", "integer"), ("edited_text", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks, pattern)
        for batch in batches:
            size = max(1, int(batch.num_rows * _SLICE_BYTES / max(1, batch.column(text).nbytes)))
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                out: list[list] = [[] for _ in range(5)]
                for t, es in zip(part.column(text).to_pylist(), part.column(edits).to_pylist(), strict=True):
                    doc = Document(counter, t or "")
                    before = doc.n_tokens
                    for e in es or ():
                        if e is not None:
                            doc.edit(e["start"] or 0, e["delete"] or 0, e["insert"] or "")
                    for column, v in zip(out, (before, doc.n_tokens, doc.encoded, len(es or ()), doc.text), strict=True):
                        column.append(v)
                new = [pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], *new], names=schema.names)

    return rows.mapInArrow(run, schema)
