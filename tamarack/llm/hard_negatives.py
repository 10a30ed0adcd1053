"""Hard negatives by Fagin's threshold algorithm.

Anchors are a stated set of rows; each meets all rows in blocks. In a block every dimension has its candidates sorted by
their component. For an anchor, all lists are read at once from their better end (the upper one where the anchor's
component is positive, the lower one where it is negative); each row met for the first time is scored by random access.
What has not been met can score no more than the anchor gets from the components where the lists stand: the threshold.
Reading stops once that is strictly below the last score that each window needs (equal scores may still win by their id)
or below the window itself.

Components are floor(scale * x), so scores are exact integers: they are computed in floats as long as those are exact and
in Python's integers beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

#: Components of the rows of a block, and anchors that a task takes to it: they bound a task's memory.
BLOCK_CELLS, BATCH_ANCHORS = 1 << 19, 8192
#: Depth of the first sorted access, and by what the depth grows with each further one.
FIRST, GROWTH = 16, 1.5


class Lists:
    """The sorted candidate lists of a block, one for each dimension."""

    def __init__(self, matrix: np.ndarray) -> None:
        self.matrix = matrix
        self.order = np.argsort(matrix, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.take_along_axis(matrix.T, self.order, axis=1)

    def scan(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Rows met for the first time, their scores, and what no row still unmet can exceed; until all are met."""
        n, depth = len(self.matrix), 0
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(up) and not len(down):
            up = np.zeros(1, np.int64)  # every row scores zero: any list leads to all of them
        met = np.zeros(n, bool)
        while depth < n:
            to = min(n, max(depth + FIRST, int(depth * GROWTH)))
            new = np.zeros(n, bool)
            new[self.order[up, n - to : n - depth]] = True
            new[self.order[down, depth:to]] = True
            new &= ~met
            met |= new
            rows, depth = np.flatnonzero(new), to
            threshold = anchor[up] @ self.values[up, n - to] + anchor[down] @ self.values[down, to - 1]
            yield rows, self.matrix[rows] @ anchor, threshold


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores with their ids, ties by smaller id."""
    if len(scores) > 4 * k:  # a tie at the limit stays
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= least
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def top(lists: Lists, ids: np.ndarray, anchor: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the anchor's k best rows; the row `without` takes no part."""
    scores, found = np.zeros(0, lists.matrix.dtype), np.zeros(0, np.int64)
    for rows, new, threshold in lists.scan(anchor):
        if without >= 0:
            keep = rows != without
            rows, new = rows[keep], new[keep]
        scores, found = best(np.concatenate([scores, new]), np.concatenate([found, ids[rows]]), k)
        if len(scores) == k and threshold < scores[-1]:
            break
    return scores, found


def within(lists: Lists, ids: np.ndarray, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (least, most) of scores, the k best allowed rows in it; windows may be empty (least > most)."""
    nothing = np.zeros(0, lists.matrix.dtype), np.zeros(0, np.int64)
    out, going = [nothing] * len(windows), [w for w, (low, high) in enumerate(windows) if low <= high]
    if not going:
        return out
    for rows, scores, threshold in lists.scan(anchor):
        keep = allowed[rows]
        rows, scores = rows[keep], scores[keep]
        for w in going:
            low, high = windows[w]
            at = np.flatnonzero((scores >= low) & (scores <= high))
            if len(at):
                out[w] = best(np.concatenate([out[w][0], scores[at]]), np.concatenate([out[w][1], ids[rows[at]]]), k)
        going = [w for w in going if threshold >= windows[w][0] and (len(out[w][0]) < k or threshold >= out[w][0][-1])]
        if not going:
            break
    return out


def _matrix(column: pa.ChunkedArray, scale: float, width: int) -> np.ndarray:
    """floor(scale * x) of vectors as doubles; shorter vectors are filled up with zeros."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    cells = np.arange(width) < sizes[:, None]
    out[cells] = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    return out


def _exact(rows: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the smallest type in which all of their inner products are exact."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * rows.shape[1]
    if most < 1 << 24:
        return rows.astype(np.float32), anchors.astype(np.float32)
    if most < 1 << 53:
        return rows, anchors
    return tuple(np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (rows, anchors))


def _column(values) -> pa.Array:
    return pa.array([int(x) for x in values], pa.int64())


def _tiles(rows: DataFrame, anchors: DataFrame, n_blocks: int, n_batches: int):
    """Rows and anchors cogrouped so that each block of rows meets each batch of anchors once."""
    left = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks))).withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1))))
    right = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    right = right.withColumn("batch", F.pmod(F.xxhash64("a_row"), F.lit(n_batches)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    return left.groupBy("block", "batch").cogroup(right.groupBy("block", "batch"))


def mine(
    vectors: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
) -> DataFrame:
    """For each row where `anchor` holds: its first `positives` other rows of the same label by score, and for each of them
    the first `negatives` rows of other labels whose score lies between low and high per cent of the positive's, as
    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are integer inner products of floor(scale * x); higher come first, ties by smaller id. Rows with a null id, a null label, a null
    vector or a null or non-finite component take no part. Vectors of fewer components are filled up with zeros. Rows
    repeated whole are rows of their own, so a copy of an anchor can be its positive, and a repeated anchor is mined as
    often as it stands there. Positives of negative score have an empty window and give nothing. Vectors that are very
    long only make blocks of fewer rows. An empty table gives an empty table; other columns are not looked at. Scores
    beyond a long raise OverflowError.

    Takes 2 passes, each of every anchor over every row, in blocks of bounded size; labels do not decide where rows go, so
    a label of a third of all rows is spread like any other.
    """
    used = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    used = used.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    rows = written(used.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, n_anchors, width = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("vector"))).first()
    width = max(1, width or 0)
    n_blocks, n_batches = max(1, -(-n * width // BLOCK_CELLS)), max(1, -(-n_anchors // BATCH_ANCHORS))

    def tile(left: pa.Table, right: pa.Table):
        return (*_exact(_matrix(left["vector"], scale, width), _matrix(right["a_vector"], scale, width)), left["id"].to_numpy(), left["row"].to_numpy())

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            matrix, queries, ids, keys = tile(left, right)
            labels = left["label"].combine_chunks().dictionary_encode() if left["label"].num_chunks != 1 else left["label"].chunk(0).dictionary_encode()
            code = {x: i for i, x in enumerate(labels.dictionary.to_pylist())}
            codes, place = labels.indices.to_numpy(), {int(k): i for i, k in enumerate(keys)}
            own, wanted = right["a_row"].to_pylist(), [code.get(x, -1) for x in right["a_label"].to_pylist()]
            for c in sorted(set(wanted) - {-1}):
                members = np.flatnonzero(codes == c)
                lists, at = Lists(matrix[members]), {int(m): i for i, m in enumerate(members)}
                for q in (i for i, x in enumerate(wanted) if x == c):
                    scores, found = top(lists, ids[members], queries[q], positives, at.get(place.get(own[q], -1), -1))
                    for x, y in zip(out, ([own[q]] * len(found), found, scores), strict=True):
                        x.extend(y)
        return pa.table([_column(x) for x in out], names=["row", "positive_id", "positive_score"])

    anchors = rows.where("anchor").select("row", "id", "label", "vector")
    data = rows.select("row", "id", "label", "vector")
    found = _tiles(data, anchors.select("row", "label", "vector"), n_blocks, n_batches).applyInArrow(find_positives, "row long, positive_id long, positive_score long")
    first = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    chosen = written(found.withColumn("j", F.row_number().over(first)).where(F.col("j") <= positives), "positives")
    wanted = chosen.groupBy("row").agg(F.collect_list(F.struct("j", "positive_id", "positive_score")).alias("positives"))  # at most `positives` of them

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if left.num_rows and right.num_rows:
            matrix, queries, ids, _ = tile(left, right)
            lists, labels = Lists(matrix), left["label"].to_numpy(zero_copy_only=False)
            for q, (row, label, asked) in enumerate(zip(right["a_row"].to_pylist(), right["a_label"].to_pylist(), right["a_positives"].to_pylist(), strict=True)):
                # low * p <= 100 * s <= high * p in integers
                windows = [(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in asked]
                for p, (scores, found) in zip(asked, within(lists, ids, queries[q], labels != label, windows, negatives), strict=True):
                    for x, y in zip(out, ([row] * len(found), [p["j"]] * len(found), found, scores), strict=True):
                        x.extend(y)
        return pa.table([_column(x) for x in out], names=["row", "j", "negative_id", "negative_score"])

    mined = _tiles(data, anchors.select("row", "label", "vector").join(wanted, "row"), n_blocks, n_batches).applyInArrow(find_negatives, "row long, j long, negative_id long, negative_score long")
    order = Window.partitionBy("row", "j").orderBy(F.desc("negative_score"), "negative_id")
    ranked = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    out = ranked.join(chosen.withColumn("j", F.col("j").cast("long")), ["row", "j"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
