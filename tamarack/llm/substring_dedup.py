"""Removal of repeated word windows by fixed-block anchors.

A window of `window` words that occurs twice covers, in each place, one whole block of that place's document when
documents are cut into blocks of (window+1)//2 words. So:

1. index: every document's non-overlapping blocks; probe: the rolling block-sized window at every word. Probes and
   blocks meet in hash buckets; a block whose words also occur anywhere else is an anchor;
2. extend: around each anchor of a document all windows that contain it are fingerprinted (96 bits, made of 64-bit hashes of their words) and counted;
   the union of the windows counted twice or more is the union of the maximal exact repeats of that length;
3. words in that union are dropped.

Skew: a hash goes out once for each document group however often the group holds it, so a passage shared by a third
of all rows costs one entry a group. Groups are hashes of whole rows and of the input partition that they lie in, sized
in bytes, and buckets are hash ranges, so neither depends on sources or copies: rows repeated whole are together only as
far as they lie in one partition. Nothing is collected on the driver except one byte count.

Probes travel as five-byte hash rests, answers as one bit for each entry in the order in which it was sent; a group
finds the order again from its own text, so no positions are shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import Words, buffers, chunks
from .sizing import free_names, group_count, replace_columns

#: UTF-8 bytes of text in a group: bounds a task's memory at any input size.
GROUP_BYTES = 16 << 20
#: Small tables have so many groups, of so many bytes at least, so that several tasks share them.
LEAST_GROUPS, LEAST_BYTES = 48, 1 << 20
_MESSAGE = "bucket int, g int, n_blocks int, body binary"


def _slices(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of sorted hashes (monotone in the hash), and where each of those present begins."""
    b = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    present, begin = np.unique(b, return_index=True)
    return present, np.append(begin, len(h))


def _block_hashes(words: Words, block: int, window: int):
    """Hashes of all rolling windows in rows long enough to hold a window, and of those the blocks' positions."""
    h, begin, limit = words.windows(block), words.begin(), words.limit()
    at = np.flatnonzero(words.inside(block) & ((limit - begin) >= window)[: len(h)])
    return h[at], at, (at - begin[at]) % block == 0


def _probe(table: pa.Table, block: int, window: int, buckets: int) -> pa.Table:
    data, offsets = buffers(table.column(table.num_columns - 2))
    hashes, blocks = [], []
    for a, b in chunks(offsets):
        h, _, aligned = _block_hashes(Words(data, offsets, a, b), block, window)
        hashes.append(h)
        blocks.append(h[aligned])
    h = np.sort(np.concatenate(hashes or [np.zeros(0, np.uint64)]))
    first = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
    many = np.append(h[1:] == h[:-1], False)[first] if len(h) else np.zeros(0, bool)
    h = h[first]
    is_block = np.zeros(len(h), bool)
    is_block[np.searchsorted(h, np.unique(np.concatenate(blocks or [h])))] = True
    rests = h.view(np.uint8).reshape(-1, 8)[:, :5]
    present, begin = _slices(h, buckets)
    counts, bodies = [], []
    for i in range(len(present)):
        s = slice(begin[i], begin[i + 1])
        mine = is_block[s]
        counts.append(int(mine.sum()))
        bodies.append(np.packbits(many[s][mine]).tobytes() + rests[s][mine].tobytes() + rests[s][~mine].tobytes())
    return _messages(present, table.column(table.num_columns - 1)[0].as_py(), counts, bodies)


def _messages(present, g, counts, bodies) -> pa.Table:
    n = len(bodies)
    return pa.table(
        [pa.array(np.asarray(present, np.int32)), pa.array([g] * n, pa.int32()), pa.array(counts, pa.int32()), pa.array(bodies, pa.binary())],
        names=["bucket", "g", "n_blocks", "body"],
    )


def _split_probe(body: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(body, np.uint8)
    bits = (n + 7) // 8
    many = np.unpackbits(raw[:bits], count=n).astype(bool)
    rest = raw[bits:].reshape(-1, 5)
    out = np.zeros((len(rest), 8), np.uint8)
    out[:, :5] = rest
    return many, out.view(np.uint64).ravel()


def _meet_probes(table: pa.Table) -> pa.Table:
    """One bit for each block a group sent: whether its words occur at another place too."""
    got = [_split_probe(x.as_py(), n.as_py()) for x, n in zip(table["body"], table["n_blocks"], strict=True)]
    every = np.sort(np.concatenate([k for _, k in got]))
    bodies = []
    for (many, keys), n in zip(got, table["n_blocks"].to_pylist(), strict=True):
        mine = keys[:n]
        at = np.searchsorted(every, mine)
        twice = every[np.minimum(at + 1, len(every) - 1)] == mine
        twice &= at + 1 < len(every)
        bodies.append(np.packbits(many | twice).tobytes())
    return pa.table([table["bucket"], table["g"], table["n_blocks"], pa.array(bodies, pa.binary())], names=["bucket", "g", "n_blocks", "body"])


def _bits(rows: pa.Table) -> np.ndarray:
    """The answers to a group in the order in which it sent its entries."""
    rows = rows.sort_by("bucket")
    parts = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(rows["body"].to_pylist(), rows["n_blocks"].to_pylist(), strict=True)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _candidates(docs: pa.Table, answers: np.ndarray, block: int, window: int):
    """For each chunk of rows: its words, the windows around its anchors, and their two hashes."""
    data, offsets = buffers(docs.column(docs.num_columns - 2))
    spans = list(chunks(offsets))
    blocks = []
    for a, b in spans:
        h, _, aligned = _block_hashes(Words(data, offsets, a, b), block, window)
        blocks.append(h[aligned])
    known = np.unique(np.concatenate(blocks or [np.zeros(0, np.uint64)]))
    if len(known) != len(answers):
        raise ValueError(f"{len(known)} blocks, {len(answers)} answers")
    for a, b in spans:
        words = Words(data, offsets, a, b)
        h, at, aligned = _block_hashes(words, block, window)
        anchors = at[aligned][answers[np.searchsorted(known, h[aligned])]] if len(known) else at[:0]
        cover = np.zeros(len(words.hashes) + 1, np.int32)
        np.add.at(cover, np.maximum(anchors - (window - block), words.begin()[anchors]), 1)
        np.add.at(cover, anchors + 1, -1)
        fits = words.inside(window)
        starts = np.flatnonzero((np.cumsum(cover)[: len(fits)] > 0) & fits)
        yield a, b, words, starts, words.windows(window)[starts], words.windows(window, 1)[starts].astype(np.uint32)


def _distinct(h: np.ndarray, k: np.ndarray):
    """Sorted distinct (h, k), whether each came more than once, and each input's place among them."""
    order = np.argsort(h, kind="stable")
    tied = h[order][1:] == h[order][:-1]
    if (k[order][1:][tied] != k[order][:-1][tied]).any():  # equal in 64 bits, different in the other 32
        order = np.lexsort((k, h))
    h, k = h[order], k[order]
    first = np.append(True, (h[1:] != h[:-1]) | (k[1:] != k[:-1])) if len(h) else np.zeros(0, bool)
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(first) - 1
    count = np.bincount(np.cumsum(first) - 1, minlength=int(first.sum()))
    return h[first], k[first], count > 1, place


def _group_windows(docs: pa.Table, answers: np.ndarray, block: int, window: int):
    found = list(_candidates(docs, answers, block, window))
    h = np.concatenate([x[4] for x in found] or [np.zeros(0, np.uint64)])
    k = np.concatenate([x[5] for x in found] or [np.zeros(0, np.uint32)])
    return found, *_distinct(h, k)


def _extend(docs: pa.Table, rows: pa.Table, block: int, window: int, buckets: int) -> pa.Table:
    """Fingerprints of the windows around anchors, and a note of the anchors for the last step (bucket -1 - g)."""
    if docs.num_rows == 0:
        return _messages([], 0, [], [])
    answers, g = _bits(rows), docs.column(docs.num_columns - 1)[0].as_py()
    _, h, k, many, _ = _group_windows(docs, answers, block, window)
    present, begin = _slices(h, buckets)
    bodies = [
        np.packbits(many[s]).tobytes() + h[s].tobytes() + k[s].tobytes()
        for s in (slice(begin[i], begin[i + 1]) for i in range(len(present)))
    ]
    counts = np.diff(begin).tolist() if len(present) else []
    return _messages([*present, -1 - g], g, [*counts, len(answers)], [*bodies, np.packbits(answers).tobytes()])


def _meet_windows(table: pa.Table) -> pa.Table:
    """One bit for each window a group sent: whether it starts at two places or more."""
    if table["bucket"][0].as_py() < 0:
        return table.select(["bucket", "g", "n_blocks", "body"])
    hs, ks, ms = [], [], []
    counts = table["n_blocks"].to_pylist()
    for body, n in zip(table["body"].to_pylist(), counts, strict=True):
        raw, bits = np.frombuffer(body, np.uint8), (n + 7) // 8
        ms.append(np.unpackbits(raw[:bits], count=n).astype(bool))
        hs.append(raw[bits : bits + 8 * n].copy().view(np.uint64))
        ks.append(raw[bits + 8 * n :].copy().view(np.uint32))
    _, _, many, place = _distinct(np.concatenate(hs), np.concatenate(ks))
    hit = many[place] | np.concatenate(ms)
    ends = np.cumsum(counts)
    bodies = [np.packbits(hit[e - n : e]).tobytes() for e, n in zip(ends, counts, strict=True)]
    return pa.table([table["bucket"], table["g"], table["n_blocks"], pa.array(bodies, pa.binary())], names=["bucket", "g", "n_blocks", "body"])


def _remove(docs: pa.Table, rows: pa.Table, block: int, window: int) -> pa.Table:
    keep_columns = docs.column_names[:-2]
    note = np.asarray(rows["bucket"].to_numpy()) < 0
    answers = _bits(rows.filter(pa.array(note)))
    found, _, _, _, place = _group_windows(docs, answers, block, window)
    repeated = _bits(rows.filter(pa.array(~note)))[place] if len(place) else np.zeros(0, bool)
    data, offsets = buffers(docs.column(docs.num_columns - 2))
    n_words, n_removed, kept, done = [], [], [], 0
    for a, b, words, starts, _, _ in found:
        hit = starts[repeated[done : done + len(starts)]]
        done += len(starts)
        cover = np.zeros(len(words.hashes) + 1, np.int32)
        cover[hit] += 1
        np.subtract.at(cover, hit + window, 1)
        stay = np.cumsum(cover)[:-1] == 0
        for i in range(a, b):
            one = data[offsets[i] : offsets[i + 1]].tobytes().split()
            mask = stay[words.first[i - a] : words.first[i - a + 1]]
            left = int(mask.sum())
            n_words.append(len(one))
            n_removed.append(len(one) - left)
            kept.append(b" ".join(one if left == len(one) else [w for w, m in zip(one, mask.tolist(), strict=True) if m]))
    out = docs.select(keep_columns)
    out = out.append_column("n_words", pa.array(n_words, pa.int64()))
    out = out.append_column("n_removed", pa.array(n_removed, pa.int64()))
    return out.append_column("kept_text", pa.array(kept, pa.binary()).cast(pa.string()))


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = 35) -> DataFrame:
    """Every row of docs with n_words, n_removed and kept_text (kept words joined by one space) for its text column.

    Words are runs of anything but space and U+0009-000D. A word goes if any window of `window` words over it also
    starts at another place in any row, the same row included; windows are those of the input.

    Null and empty texts have no words (kept_text is empty). Repeated rows are repeats of each other: both lose all
    words if they have `window` words or more. Rows shorter than a window lose nothing. An empty table gives an empty
    table. Input columns named like an output are replaced, all others keep their names.
    """
    block = (window + 1) // 2
    size = group_count(docs, text_col, 1)
    groups = max(-(-size // GROUP_BYTES), min(LEAST_GROUPS, -(-size // LEAST_BYTES)))
    extra = replace_columns(docs, "n_words", "n_removed", "kept_text", text_col).columns
    text, g = free_names(docs, "text", "g")
    salt = [F.col(c) for c in extra if not re.search("map<|variant", docs.schema[c].dataType.simpleString())]  # these have no hash
    spread = F.pmod(F.xxhash64(F.col(text_col), *salt, F.spark_partition_id()), F.lit(groups))
    rows = docs.select(*extra, F.col(text_col).alias(text), spread.cast("int").alias(g))
    by_group = rows.groupBy(g)
    probes = by_group.applyInArrow(lambda t: _probe(t, block, window, groups), _MESSAGE)
    anchors = probes.groupBy("bucket").applyInArrow(_meet_probes, _MESSAGE)
    windows = by_group.cogroup(anchors.groupBy("g")).applyInArrow(lambda d, r: _extend(d, r, block, window, groups), _MESSAGE)
    answers = windows.groupBy("bucket").applyInArrow(_meet_windows, _MESSAGE)
    out = T.StructType(rows.schema.fields[:-2]).add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return by_group.cogroup(answers.groupBy("g")).applyInArrow(lambda d, r: _remove(d, r, block, window), out)
