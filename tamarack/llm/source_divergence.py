"""Divergence of sources: how far the smoothed term shares of each source lie from those of the others of its language.

The sum over all terms of |p - q| for every pair of sources is a sparse matrix product in all but name, and is computed by
Gustavson's row accumulation: for one source after the other, its terms are looked up in a term-major index, and what
stands there for the other sources is scattered into one dense accumulator over all of them. No (source, source, term)
triple is ever a row. Terms that one or both sources lack count with the zero baseline b = p of count 0:

    sum over all terms of |p_g - p_h|
      = V * |b_g - b_h|
      + sum over g's terms of (|p_g - b_h| - |b_g - b_h|)   [and the same with g and h exchanged]
      + sum over common terms of (|p_g - p_h| - |p_g - b_h| - |b_g - p_h| + |b_g - b_h|)

The second line takes one search in a source's sorted shares for each other source; only the third needs the index.
Terms are dealt over blocks of bounded size, and blocks' sums are added up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written
from .wordbytes import pieces, spaced

#: Terms are runs of ASCII letters and of what lies outside ASCII; A-Z are lower-cased.
_TABLE = spaced(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), fold=True)
#: Counts that a task holds before it hands them on, entries of a block's index, and cells of the accumulators of its rows.
HELD, POSTINGS, CELLS = 200_000, 1 << 20, 1 << 22
UNIT = 1_000_000_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, n_docs) of a partition's (text, lang, source), summed as far as memory allows."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> pa.RecordBatch:
        flat = [(*group, term, k, docs[term]) for group, (words, docs) in counts.items() for term, k in words.items()]
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        columns = [pa.array([x[i] for x in flat], kind) for i, kind in enumerate(kinds)]
        columns[2] = columns[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "n_docs"])

    held = 0
    for batch in batches:
        for text, *group in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words, docs = counts.setdefault(tuple(group), (Counter(), Counter()))
            before, seen = len(words), set()
            for part in pieces(text.translate(_TABLE)):
                words.update(part)
                seen.update(part)
            docs.update(seen)
            held += len(words) - before
            if held >= HELD:
                yield out()
                counts, held = {}, 0
    if counts:
        yield out()


def _spread(shares: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each number of `at`, the sum of its distances to all shares."""
    shares = np.sort(shares)
    total = np.concatenate([[0], np.cumsum(shares)])
    k, n = np.searchsorted(shares, at), len(shares)
    return at * k - total[k] + (total[n] - total[k]) - at * (n - k)


def _rows(left: pa.Table, right: pa.Table) -> pa.Table:
    """Twice the part of every pair's distance that a block of terms gives to the rows of this tile: left has the block's
    (source, term, p), right all sources of the language with b, V and whether they are rows of this tile."""
    names = ["lang", "low", "high", "twice"]
    right = right.sort_by("source")  # by bytes
    sources, b, mine = right["source"].combine_chunks(), right["b"].to_numpy(), right["mine"].to_numpy(zero_copy_only=False)
    n = len(sources)
    owner = pc.index_in(left["source"], value_set=sources).to_numpy().astype(np.int64) if left.num_rows else np.zeros(0, np.int64)
    if left.num_rows:
        terms = pc.dictionary_encode(left["term"].combine_chunks())
        term = (terms.chunk(0) if isinstance(terms, pa.ChunkedArray) else terms).indices.to_numpy().astype(np.int64)
    else:
        term = np.zeros(0, np.int64)
    p = left["p"].to_numpy().astype(np.int64)
    major = np.argsort(term, kind="stable")  # the term-major index
    peer, share = owner[major], p[major]
    begin = np.searchsorted(term[major], np.arange(term.max(initial=-1) + 2))
    by_row = np.argsort(owner, kind="stable")
    ends = np.searchsorted(owner[by_row], np.arange(n + 1))
    whole = right["whole"][0].as_py()  # the language's V, told to one block only
    lows, highs, values = [], [], []
    for g in np.flatnonzero(mine):
        own = by_row[ends[g] : ends[g + 1]]
        apart = np.abs(b[g] - b)
        twice = 2 * (_spread(p[own], b) - len(own) * apart)
        lengths = begin[term[own] + 1] - begin[term[own]]
        at = np.repeat(begin[term[own]] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        h, here, there = peer[at], np.repeat(p[own], lengths), share[at]
        common = np.abs(here - there) - np.abs(here - b[h]) - np.abs(b[g] - there) + apart[h]
        twice += np.bincount(h, common, n).astype(np.int64)  # sums stay far below 2**53
        twice[g + 1 :] += 2 * whole * apart[g + 1 :]
        others = np.delete(np.arange(n), g)
        lows.append(np.minimum(others, g))
        highs.append(np.maximum(others, g))
        values.append(twice[others])
    if not lows:
        return pa.table([pa.array([], pa.string())] * 3 + [pa.array([], pa.int64())], names=names)
    low, high = (sources.take(pa.array(np.concatenate(x))) for x in (lows, highs))
    lang = pa.array([right["lang"][0].as_py()] * len(low), pa.string())
    return pa.table([lang, low, high, pa.array(np.concatenate(values), pa.int64())], names=names)


def _share(count: Column, total: Column, v: Column, smoothing: int) -> Column:
    """1 + floor(10**9 * (count + smoothing) / (total + smoothing * v)), null where nothing is kept; in decimals, as 10**9
    times a large count leaves the range of a long."""
    over = (count + F.lit(smoothing).cast("long")).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    under = F.nullif(total + v * F.lit(smoothing).cast("long"), F.lit(0).cast("long")).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", over, under)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, smoothing: int = 5, ranks: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) group of docs.

    Part `pair`: each other source of the language and the summed distance of the two sources' shares over all kept terms
    (0 if none is kept), all ranks. Part `term`: the kept terms of the group whose share is above the language's, and by how
    much, the first `ranks`. Shares are 1 + floor(10**9 * (count + smoothing) / (N + smoothing * V)); a term is kept in a
    language if least_docs of its documents have it. Ranks go by value descending, then by the item's UTF-8 bytes; all
    arithmetic is exact.

    Null text, lang or source reads as ''. Empty texts have no terms, but their group takes part; repeated rows count as
    often as they stand there. Long texts are split a few MB at a time. An empty table gives an empty table, a language of
    one source no pairs. Other columns, whatever their names, are not looked at.
    """
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for n, c in (("text", text_col), ("lang", lang_col), ("source", source_col))])
    found = rows.mapInArrow(_count, "lang string, source string, term string, n long, n_docs long")
    per_group = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    over = Window.partitionBy("lang", "term")
    kept = per_group.withColumns({"lang_n": F.sum("n").over(over), "lang_docs": F.sum("n_docs").over(over)}).where(F.col("lang_docs") >= least_docs)
    counts = written(kept.select("lang", "source", "term", "n", "lang_n"), "term-counts")

    langs = counts.groupBy("lang", "term").agg(F.first("lang_n").alias("k")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("k").alias("lang_total"))
    groups = rows.select("lang", "source").distinct().join(langs, "lang", "left").join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    zero = F.lit(0).cast("long")

    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("v", "lang_total", "total")])
    groups = written(groups.withColumn("b", F.coalesce(_share(zero, F.col("total"), F.col("v"), smoothing), zero)), "groups")
    shares = counts.join(groups, ["lang", "source"])
    shares = shares.select("lang", "source", "term", *[_share(c, t, F.col("v"), smoothing).alias(n) for n, c, t in (("p", F.col("n"), F.col("total")), ("q", F.col("lang_n"), F.col("lang_total")))])

    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= ranks)

    n_blocks = max(1, -(-counts.count() // POSTINGS))
    tiles = groups.groupBy("lang").agg(F.count("*").alias("s")).select("lang", F.ceil(F.col("s") / F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.col("s")))).cast("int").alias("n_tiles"))
    spread = F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1))
    left = shares.join(tiles, "lang").select("lang", F.pmod(F.xxhash64("term"), F.lit(n_blocks)).cast("int").alias("block"), spread.alias("tile"), "source", "term", "p")
    right = groups.join(tiles, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = right.withColumn("home", F.pmod(F.xxhash64("source"), F.col("n_tiles")).cast("int")).withColumn("tile", spread)
    right = right.select("lang", "block", "tile", "source", "b", (F.col("home") == F.col("tile")).alias("mine"), F.when(F.col("block") == 0, F.col("v")).otherwise(zero).alias("whole"))
    key = ["lang", "block", "tile"]
    parts = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_rows, "lang string, low string, high string, twice long")
    sums = written(parts.groupBy("lang", "low", "high").agg(F.expr("sum(twice) div 2").alias("value")), "pairs")
    one, two = (sums.select("lang", F.col(a).alias("source"), F.lit("pair").alias("part"), F.col(c).alias("item"), "value") for a, c in (("low", "high"), ("high", "low")))
    pairs = one.union(two).withColumn("rank", F.row_number().over(first))
    return pairs.union(terms)
