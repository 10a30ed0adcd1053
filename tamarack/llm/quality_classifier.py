"""Quality classifier by importance resampling.

Hashed n-gram models of target text (labelled good rows) and of raw text (all rows) give each document the log of its
importance weight; documents are then drawn without replacement in proportion to their weights, by Gumbel top-k.

An n-gram counts once a document. It has a bucket in each of two tables, and the weaker evidence of the two is its own, so
it does not answer for what shares one bucket with it. Evidence: a bucket's log ratio counts only where the target lacks what raw text has by a factor of LEAST_FACTOR and by
Z_LIMIT standard errors; other ratios are sampling noise that long texts would add up, and count as zero. So ordinary
documents have weight one, and k, the sum of all weights, is the number of documents that the target accounts for.

The counts cover all documents. The model is BUCKETS numbers, a fixed size, and is broadcast. Target rows are a bounded
sample (TARGET_ROWS) of the labelled ones, so flags are a broadcast join of fixed size and texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import NON_ALNUM, Words, buffers, chunks, separators
from .shared import written
from .sizing import free_names, replace_columns

#: Buckets of each of a model's two hash tables, and of both; blocks in which partitions hand on their counts.
BITS = 20
BUCKETS, BLOCK = 2 << BITS, 1 << 14
#: Counts of a block that a task adds up at once, and how often that is done before the rows that are left are counted.
FAN_IN, LEVELS = 128, 3
#: Bytes of text in the slices that rows are handed on in.
SLICE_BYTES = 4 << 20
#: Lengths of word beginnings (bytes) that count as n-grams: they carry what inflected words share.
PREFIXES = (4, 5, 6, 7, 8)
#: Labelled rows that the target model is fitted on, at most.
TARGET_ROWS = 20_000
LEAST_FACTOR, Z_LIMIT = 6.0, 3.0
#: Runs of ASCII punctuation are words of a second kind.
_NOT_PUNCTUATION = separators((0x00, 0x20), (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x7F, 0xFF))
#: A word said so many times in a row counts as one n-gram, whichever word it is.
STUTTER = 5
_STUTTER = 0


def _features(data, offsets, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (from 0) and buckets in either table of what rows [a, b) hold, each once a row: words, their first
    bytes, pairs of words, runs of punctuation and their pairs, and stutters."""
    width = 2 * BITS
    mask, found = np.uint64((1 << width) - 1), []
    for sep, fold in ((NON_ALNUM, True), (_NOT_PUNCTUATION, False)):
        words = Words(data, offsets, a, b, sep, fold)
        h = words.hashes
        row = np.repeat(np.arange(b - a), np.diff(words.first)) << width
        found.append(row + (h & mask).astype(np.int64))
        if fold:
            found.extend(row + (words.prefixes(n) + np.uint64(n) & mask).astype(np.int64) for n in PREFIXES)
        at = np.flatnonzero(words.inside(2))
        found.append(row[at] + (words.windows(2)[at] & mask).astype(np.int64))
        if fold and len(h) >= STUTTER:
            same = np.cumsum(np.append(0, h[1:] == h[:-1]))
            at = np.flatnonzero(words.inside(STUTTER))
            found.append(row[at[same[at + STUTTER - 1] - same[at] == STUTTER - 1]] + _STUTTER)
    keys = np.sort(np.concatenate(found))
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    low, row = (1 << BITS) - 1, keys >> width
    stutter = keys == row << width
    one, two = (np.where(stutter, 0, np.maximum(x & low, 1)) for x in (keys, keys >> BITS))  # bucket 0 is its own
    return row, one, two + (1 << BITS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's bucket counts for all rows and for target rows, in blocks, with the partition's number. Only buckets that
    rows have are sent (at: their places in the block, of two bytes), with counts of four bytes: a bucket counts a row twice at
    most, and a partition has fewer than 2 ** 31 rows."""
    part = TaskContext.get().partitionId()
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for a, b in chunks(offsets):
            row, *buckets = _features(data, offsets, a, b)
            for bucket in buckets:
                np.add.at(raw, bucket, 1)
                np.add.at(target, bucket[good[a:b][row]], 1)
    at = np.flatnonzero(raw)
    blocks, first = np.unique(at // BLOCK, return_index=True)
    ends = np.append(first, len(at))[1:].tolist()
    for block, a, b in zip(blocks.tolist(), first.tolist(), ends, strict=True):
        here = at[a:b]
        yield pa.RecordBatch.from_pylist([{"block": block * BLOCK, "part": part, **_sparse(here - block * BLOCK, raw[here], target[here], np.uint32)}], schema=_COUNTED)


#: What is known of a block: at, raw and target are arrays of 2-byte places and of counts (4 bytes of a partition, 8 of a sum).
_COUNTED = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("at", pa.binary()), ("raw", pa.binary()), ("target", pa.binary())])
_COUNTED_DDL = "block int, part int, at binary, raw binary, target binary"


def _sparse(at: np.ndarray, raw: np.ndarray, target: np.ndarray, kind: type) -> dict[str, bytes]:
    return {"at": at.astype(np.uint16).tobytes(), "raw": raw.astype(kind).tobytes(), "target": target.astype(kind).tobytes()}


def _dense(at: bytes, raw: bytes, target: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a block and their counts."""
    kind = np.uint32 if len(raw) == 2 * len(at) else np.int64
    return np.frombuffer(at, np.uint16), np.frombuffer(raw, kind), np.frombuffer(target, kind)


def _summed(table: pa.Table, fan_in: int) -> pa.Table:
    """The sums of a group's counts of one block, as one row (part: what its first row's leads to a level up)."""
    raw, target = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
    for counts in zip(*[table[name] for name in ("at", "raw", "target")], strict=True):
        at, x, y = _dense(*[c.as_py() for c in counts])
        raw[at] += x
        target[at] += y
    at = np.flatnonzero(raw)
    row = {"block": table["block"][0].as_py(), "part": table["part"][0].as_py() // fan_in, **_sparse(at, raw[at], target[at], np.int64)}
    return pa.Table.from_pylist([{**row, "n_raw": int(raw.sum()), "n_target": int(target.sum())}], schema=_COUNTED.append(pa.field("n_raw", pa.int64())).append(pa.field("n_target", pa.int64())))


def _level(counted: DataFrame, fan_in: int) -> DataFrame:
    groups = counted.select(*_COUNTED.names).groupBy("block", F.floor(F.col("part") / fan_in))
    return groups.applyInArrow(lambda t: _summed(t, fan_in), f"{_COUNTED_DDL}, n_raw long, n_target long").select(*_COUNTED.names, "n_raw", "n_target")


def sum_blocks(counted: DataFrame, fan_in: int = FAN_IN, levels: int = LEVELS) -> tuple[DataFrame, int, int]:
    """The counts of all partitions, one row a block, and the sums of raw and target counts. Partitions are added up fan_in
    at a time, so no task holds more than so many blocks, and levels are added until each block has one row, whatever the
    number of partitions. Blocks without counts have no row."""
    out, more = counted, levels
    while True:
        for _ in range(more):
            out = _level(out, fan_in)
        out, more = written(out, "counts"), 1
        n_rows, n_blocks, n_raw, n_target = out.agg(F.count("*"), F.count_distinct("block"), F.sum("n_raw"), F.sum("n_target")).first()
        if n_rows == n_blocks:
            return out, n_raw or 0, n_target or 0


def evidence(raw: np.ndarray, target: np.ndarray, share: float) -> np.ndarray:
    """Log ratios of target to raw model by bucket, zero where the difference is small or may be chance. share: counts of
    the target to those of raw text, in all buckets."""
    expected = raw * share
    ratio = np.log((target + 1) / (expected + 1))
    sure = (ratio <= -np.log(LEAST_FACTOR)) & (expected - target >= Z_LIMIT * np.sqrt(expected + 1))
    return np.where(sure, ratio, 0).astype(np.float32)


def fit(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_rows: int = TARGET_ROWS) -> np.ndarray:
    """Evidence by bucket from all texts of docs and those whose id is among good (a one-column table of ids; at most
    target_rows of them, chosen by hash). Tasks weigh the buckets; the driver gets BUCKETS numbers of four bytes."""
    ids = good.select(F.col(good.columns[0]).alias("id")).where("id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(target_rows)
    flagged = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    flagged = flagged.join(F.broadcast(ids.withColumn("good", F.lit(True))), "id", "left")
    flagged = flagged.select("text", F.coalesce("good", F.lit(False)).alias("good"))
    blocks, n_raw, n_target = sum_blocks(flagged.mapInArrow(_count, _COUNTED_DDL))
    share = n_target / max(1, n_raw)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                at, raw, target = _dense(*counts)
                ratios = np.zeros(BLOCK, np.float32)
                ratios[at] = evidence(raw, target, share)
                out = ratios.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([out], pa.binary())], names=["block", "evidence"])

    model = np.zeros(BUCKETS, np.float32)
    for r in blocks.select("block", "at", "raw", "target").mapInArrow(weigh, "block int, evidence binary").collect():
        model[r.block : r.block + BLOCK] = np.frombuffer(r.evidence, np.float32)
    return model


def log_weights(docs: DataFrame, model: np.ndarray, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Every row of docs with log_weight (zero or less; zero for null and empty texts), and its text if that is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = replace_columns(docs, "log_weight")
    at = rows.columns.index(text_col)
    kept = [k for k in range(len(rows.columns)) if keep_text or k != at]
    schema = T.StructType([rows.schema.fields[k] for k in kept]).add("log_weight", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            for i, j in chunks(offsets, SLICE_BYTES):  # handed on in slices, so that no whole batch is held twice
                score = np.zeros(j - i)
                for a, b in chunks(offsets[i : j + 1]):
                    row, one, two = _features(data, offsets, i + a, i + b)
                    score[a:b] = np.bincount(row, np.maximum(ratios[one], ratios[two]), b - a)
                part = batch.slice(i, j - i)
                columns = [part.column(k) for k in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.round(score, 4))], names=schema.names)

    return rows.mapInArrow(run, schema)


def gumbel(seed: int, *cols) -> F.Column:
    """Standard Gumbel noise from a hash of the row: the same on every attempt."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of a table of one double column, by refining histograms of `bins` counts; None if the
    table has fewer than k rows or k is 0."""
    name = keys.columns[0]
    n, low, high = keys.agg(F.count(name), F.min(name), F.max(name)).first()
    if k < 1 or n < k:
        return None
    while low < high:
        width = (high - low) / bins
        inside = keys.where((F.col(name) >= low) & (F.col(name) <= high))
        place = F.least(F.floor((F.col(name) - low) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        found = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(name).alias("low"), F.max(name).alias("high")).collect()
        for r in sorted(found, key=lambda r: -r.bin):
            if k <= r.n:
                low, high = r.low, r.high
                break
            k -= r.n
    return low


def resample(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, seed: int = 17, sharpness: float = 4.0, target_rows: int = TARGET_ROWS, keep_text: bool = True) -> DataFrame:
    """The rows of docs that a Gumbel top-k draw by importance weight takes, with log_weight and sample_key (and without
    their text unless keep_text).

    Weights are raised to the power `sharpness`: the higher it is, the less is left to chance between rows with evidence
    against them and rows without. k defaults to the sum of the weights (each at most one), rounded. Rows with equal sample_key at the limit are all
    taken, so repeated rows share their fate. Null and empty texts carry no evidence and have weight one; a null id is no
    good id. Texts of any length are read whole, in pieces of bounded size where many are read at once. With no good ids nothing speaks against any row and all are taken. An empty table stays empty. Input columns
    named log_weight or sample_key are replaced; all others keep their names.

    All rows are written once with their keys to the shared folder; those drawn are read from there.
    """
    rows = replace_columns(docs, "log_weight", "sample_key")
    if good.limit(1).count() == 0:
        model = np.zeros(BUCKETS, np.float32)
    else:
        model = fit(rows, good, id_col, text_col, target_rows)
    (noise,) = free_names(rows, "noise")
    keyed = log_weights(rows.withColumn(noise, gumbel(seed, F.col(id_col), F.col(text_col))), model, text_col, keep_text)
    keyed = written(keyed.withColumn("sample_key", F.col("log_weight") * sharpness + F.col(noise)).drop(noise), "weights")
    if k is None:
        # rounded before summing: the sum is then the same in any order
        total = keyed.select(F.sum(F.round(F.exp(F.col("log_weight") * sharpness), 6).cast("decimal(20,6)")).alias("w")).first().w
        k = int(round(total or 0))
    limit = kth_largest(keyed.select("sample_key"), k)
    return keyed.where(F.col("sample_key") >= F.lit(limit)) if limit is not None else keyed.where(F.lit(k > 0))
