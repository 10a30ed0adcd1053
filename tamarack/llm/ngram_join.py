"""Near-duplicate join on word n-grams: a MinHash LSH forest, then exact Jaccard similarity.

1. A row's text becomes its set of word n-grams. Equal sets are one node (a digest), so copies are never paired.
2. Each node has `trees` signatures of `depth` one-byte minima. All (tree, signature, node) entries are range-sorted:
   entries with a common prefix are a subtree of that tree's trie, and neighbours in the order match on the longest
   prefix that either shares with any other. Matches are counted by tree and length, and prefixes are shortened from
   `depth` on, one tree at a time, each time where the recall gained costs the fewest new matches, until the expected
   recall at the similarity asked for reaches the target. Matches of at least their tree's length are candidate links.
3. Connected candidates form groups. Each text meets the text of its group's first node once and is from then on what
   differs: the n-grams that it lacks and those that it adds. Similarities of all pairs of a group follow exactly from
   these. Groups above a size are cut into blocks, and each pair of blocks is a task.
4. Links give degrees (weighted by copies) and, as trees of links, the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import ceil, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import NON_ALNUM, Words, buffers, chunks
from .components import components
from .shared import written
from .sizing import row_digest

#: Nodes and bytes of differing n-grams in a block of a group that is verified in parts.
BLOCK_NODES, BLOCK_BYTES = 4096, 8 << 20
#: n-gram postings counted at once.
_POSTINGS = 1 << 21
#: Row keys (16 bytes each) that are broadcast at most; more of them take a shuffled join.
BROADCAST_KEYS = 200_000


def recall(similarity: float, prefix: int, trees: int) -> float:
    """Chance that a pair of that similarity shares a prefix of that length in a tree or more."""
    return 1 - (1 - similarity**prefix) ** trees


def shortest_needed(similarity: float, depth: int, trees: int, target: float) -> int:
    """Shortens the prefix from `depth` until the target recall is reached."""
    prefix = depth
    while prefix > 1 and recall(similarity, prefix, trees) < target:
        prefix -= 1
    return prefix


def prefix_lengths(matches: dict[tuple[int, int], int], similarity: float, depth: int, trees: int, target: float) -> list[int]:
    """A prefix length for each tree. matches: how many matches a (tree, length) has, by their whole length.

    All trees start at `depth`. The one whose next step down raises the recall most for each match that it adds goes
    first, until the chance that a pair of that similarity shares a prefix in some tree reaches the target.
    """
    lowest = shortest_needed(similarity, depth, trees, target)
    lengths, missed = [depth] * trees, trees * log1p(-(similarity**depth))
    while missed > log1p(-target) and max(lengths) > lowest:
        worth = []
        for t, n in enumerate(lengths):
            if n > lowest:
                gain = log1p(-(similarity**n)) - log1p(-(similarity ** (n - 1)))
                worth.append((-gain / (1 + matches.get((t, n - 1), 0)), t, gain))
        _, t, gain = min(worth)
        lengths[t] -= 1
        missed -= gain
    return lengths


def _permutations(n: int) -> np.ndarray:
    """n pairs (odd factor, addend) of 32 bits, from a fixed seed."""
    random = np.random.default_rng(5)
    pairs = random.integers(0, 1 << 32, (n, 2), np.uint32)
    pairs[:, 0] |= 1
    return pairs


def _signatures(batches: Iterator[pa.RecordBatch], text: int, size: int, hashes: int) -> Iterator[pa.RecordBatch]:
    permutations = _permutations(hashes)
    for batch in batches:
        data, offsets = buffers(batch.column(text))
        digests, signatures, sizes = [], [], []
        for a, b in chunks(offsets, 1 << 19):
            grams, first = Words(data, offsets, a, b, NON_ALNUM, fold=True).grams(size)
            some = np.flatnonzero(np.diff(first))
            out = np.zeros((len(some), hashes), np.uint8)
            if len(some):
                short, begin = (grams >> np.uint64(32)).astype(np.uint32), first[some]
                for j, (factor, add) in enumerate(permutations):
                    out[:, j] = (np.minimum.reduceat(short * factor + add, begin) * np.uint32(0x9E3779B1)) >> np.uint32(24)
            row = dict(zip(some.tolist(), range(len(some)), strict=True))
            for i in range(b - a):
                k = row.get(i)
                if k is None:
                    digests.append(None), signatures.append(None), sizes.append(0)
                else:
                    own = np.unique(grams[first[i] : first[i + 1]])
                    digests.append(blake2b(own.tobytes(), digest_size=16).digest())
                    signatures.append(out[k].tobytes())
                    sizes.append(len(own))
        kept = [(c, n) for i, (c, n) in enumerate(zip(batch.columns, batch.schema.names, strict=True)) if i != text]
        new = [pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays([*[c for c, _ in kept], *new], names=[*[n for _, n in kept], "set", "signature", "n_grams"])


def _matches(batches: Iterator[pa.RecordBatch], low: int) -> Iterator[pa.RecordBatch]:
    """Matches of neighbours among sorted (entry, node) rows: (tree, length, u, v, null) where their entries of a tree
    share `length` >= low bytes. Of the first and the last entry also (tree, length, node, null, prefix) for each length,
    as their prefixes may go on in another partition."""
    before = None

    def ends(entry: bytes, node: bytes) -> list[tuple]:
        return [(int.from_bytes(entry[:2]), n, node, None, entry[: n + 2]) for n in range(low, len(entry) - 1)]

    for batch in batches:
        if not batch.num_rows:
            continue
        entries, nodes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out = ends(entries[0], nodes[0]) if before is None else []
        if before is not None:
            entries, nodes = [before[0], *entries], [before[1], *nodes]
        at = np.frombuffer(b"".join(entries), np.uint8).reshape(len(entries), -1)
        length = np.cumprod(at[1:] == at[:-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64) - 2
        for i in np.flatnonzero(length >= low).tolist():
            out.append((int.from_bytes(entries[i][:2]), int(length[i]), nodes[i + 1], nodes[i], None))
        before = (entries[-1], nodes[-1])
        if out:
            yield _match_batch(out)
    if before is not None:
        yield _match_batch(ends(*before))


def _match_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["tree", "length", "u", "v", "open"])


def forest_links(nodes: DataFrame, trees: int, depth: int, similarity: float, target: float) -> DataFrame:
    """Candidate links (u, v) between nodes (node, signature)."""
    t = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("t")
    entries = nodes.select("node", "signature", t).select(
        F.concat(F.unhex(F.lpad(F.hex("t"), 4, "0")), F.expr(f"substring(signature, t * {depth} + 1, {depth})")).alias("entry"), "node"
    )
    low = shortest_needed(similarity, depth, trees, target)
    runs = entries.repartitionByRange("entry").sortWithinPartitions("entry").mapInArrow(lambda b: _matches(b, low), "tree int, length int, u binary, v binary, open binary")
    runs = written(runs, "runs")
    counts = runs.where("open is null").groupBy("tree", "length").count().collect()  # trees * (depth - low + 1) numbers
    lengths = prefix_lengths({(r.tree, r.length): r["count"] for r in counts}, similarity, depth, trees, target)
    fits = F.col("length") >= F.element_at(F.array(*map(F.lit, lengths)), F.col("tree") + 1)
    tied = runs.where(fits & F.col("open").isNotNull())
    least = tied.groupBy("open").agg(F.min("u").alias("v"))
    ties = tied.select("open", "u").join(least, "open").where("u <> v").select("u", "v")
    return runs.where(fits & F.col("open").isNull()).select("u", "v").union(ties).distinct()


def _differences(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(label, node, copies, n_first, n_lacking, differing) from (label, node, copies, text, first_text): the n-grams of
    the first text that a text lacks, and those that only the text has."""

    def sets(texts) -> Iterator[np.ndarray]:
        data, offsets = buffers(texts)
        for a, b in chunks(offsets):
            grams, first = Words(data, offsets, a, b, NON_ALNUM, fold=True).grams(size)
            yield from (np.unique(grams[first[i] : first[i + 1]]) for i in range(b - a))

    for batch in batches:
        n_first, n_lacking, differing = [], [], []
        last, head = None, None
        firsts = batch.column(4).to_pylist()
        for own, text in zip(sets(batch.column(3)), firsts, strict=True):
            if head is None or text != last:
                last, head = text, next(sets(pa.array([text], pa.string())))
            lacking, added = np.setdiff1d(head, own, True), np.setdiff1d(own, head, True)
            n_first.append(len(head)), n_lacking.append(len(lacking))
            differing.append(np.concatenate([lacking, added]).tobytes())
        new = [pa.array(n_first, pa.int64()), pa.array(n_lacking, pa.int64()), pa.array(differing, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *new], names=["label", "node", "copies", "n_first", "n_lacking", "differing"])


def _similar_pairs(differing: list[np.ndarray], lacking: np.ndarray, n_first: int, similarity: float, split: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each i the j > i of at least that Jaccard similarity; with a split only pairs across it. Two texts share what
    the first text has, less what either lacks, plus what they differ in alike."""
    amounts = np.array([len(s) for s in differing], np.int64)
    sizes = n_first - 2 * lacking + amounts
    _, ids, often = np.unique(np.concatenate(differing), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(differing)), amounts)
    order = np.argsort(ids, kind="stable")
    postings, start = owner[order], np.cumsum(often) - often
    bounds = np.append(0, np.cumsum(amounts))
    for i in range(split if split else len(differing) - 1):
        mine = ids[bounds[i] : bounds[i + 1]]
        mine = mine[often[mine] > 1]
        alike = np.zeros(len(differing), np.int64)
        ends = np.cumsum(often[mine])
        a = 0
        while a < len(mine):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _POSTINGS, "right")))
            n = often[mine[a:b]]
            at = np.repeat(start[mine[a:b]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            alike += np.bincount(postings[at], minlength=len(differing))
            a = b
        low = split if split else i + 1
        both = n_first - lacking[i] - lacking[low:] + alike[low:]
        yield i, low + np.flatnonzero((both > 0) & (both >= similarity * (sizes[i] + sizes[low:] - both) - 1e-9))


def _verify(table: pa.Table, similarity: float) -> pa.Table:
    """For each node of a group (or of two of its blocks): a node it is linked to, by a tree of links (itself at a
    root), and the number of rows that its links in this task lead to."""
    left, right = table["left"][0].as_py(), table["right"][0].as_py()
    table = table.sort_by([("block", "ascending"), ("node", "ascending")])
    nodes, copies, lacking = table["node"].to_pylist(), table["copies"].to_numpy(), table["n_lacking"].to_numpy()
    split = int((table["block"].to_numpy() == left).sum()) if left != right else 0
    differing = [np.frombuffer(x, np.uint64) for x in table["differing"].to_pylist()]
    root, degree = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
    if left == right or 0 < split < len(nodes):
        for i, others in _similar_pairs(differing, lacking, table["n_first"][0].as_py(), similarity, split):
            degree[i] += copies[others].sum()
            degree[others] += copies[i]
            joined = np.append(root[others], root[i])
            least = joined.min()
            if (joined != least).any():
                root[np.isin(root, joined)] = least
    roots = [nodes[k] for k in root.tolist()]
    return pa.table([pa.array(nodes, pa.binary()), pa.array(roots, pa.binary()), pa.array(degree)], names=["node", "to", "degree"])


def _verified(slim: DataFrame, members: DataFrame, size: int, similarity: float) -> DataFrame:
    """(node, to, degree) for members (node, label, copies, row_key), each group's pairs compared once.

    Repeated rows have one row_key and are one before texts move; a text is shuffled once, however large its group, and
    so is its group's first text for it. What differs goes out once for each block of the group.
    """
    texts, keys = slim.select("row_key", "text"), members.select("row_key")
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        texts = texts.join(F.broadcast(keys), "row_key", "left_semi")
    texts = texts.groupBy("row_key").agg(F.min("text").alias("text"))
    told = written(members.join(texts, "row_key").select("label", "node", "copies", "text"), "texts")
    firsts = told.where("node = label").select("label", F.col("text").alias("first_text"))
    met = told.join(firsts, "label").select("label", "node", "copies", "text", "first_text")
    schema = "label binary, node binary, copies long, n_first long, n_lacking long, differing binary"
    told = written(met.mapInArrow(lambda b: _differences(b, size), schema), "differences")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum(F.octet_length("differing").cast("long")) / BLOCK_BYTES)).cast("int")
    placed = told.join(told.groupBy("label").agg(blocks.alias("blocks")), "label")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("label", F.least("block", "o").alias("left"), F.greatest("block", "o").alias("right"), "node", "copies", "block", "n_first", "n_lacking", "differing")
    return placed.groupBy("label", "left", "right").applyInArrow(lambda t: _verify(t, similarity), "node binary, to binary, degree long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    similarity: float = 0.8,
    trees: int = 44,
    depth: int = 12,
    target: float = 0.999,
) -> DataFrame:
    """One row for each row of docs: its id, class_id (least id of its class), n_links, and row_key, class_key.

    Words are runs of ASCII letters and digits (A-Z as a-z) and of everything outside ASCII. Links join rows whose sets
    of `size`-word n-grams (all words, if there are fewer) have Jaccard similarity `similarity` or more; copies are
    linked too. A class is what links connect. n_links counts the other rows linked to a row.

    Texts without words (null, empty, punctuation) link to nothing: class_id is their own id. Repeated rows are copies.
    A null id takes part; class_id is null only where no row of the class has one. row_key is a digest of all columns of
    docs, the same for rows repeated whole only; class_key is the row_key of the one row that stands for the class (least
    id, then least key). An empty table gives an empty table.

    A set of fewer than similarity / (1 - similarity) n-grams is similar enough to no other set, so it is not searched.
    """
    slim = docs.select(F.col(id_col).alias("id"), row_digest(docs).alias("row_key"), F.col(text_col).alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, row_key binary, set binary, signature binary, n_grams long"
    rows = written(slim.mapInArrow(lambda b: _signatures(b, 2, size, trees * depth), schema), "signatures")
    nodes = rows.where("set is not null").groupBy(F.col("set").alias("node"))
    nodes = written(
        nodes.agg(
            F.count("*").alias("copies"),
            F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row_key")).alias("first"),
            F.min("row_key").alias("at"),
            F.min("n_grams").alias("n_grams"),
            F.min("signature").alias("signature"),
        ),
        "nodes",
    )
    least = ceil(similarity / (1 - similarity) - 1e-9) if similarity < 1 else 1 << 62
    groups = components(forest_links(nodes.where(F.col("n_grams") >= least), trees, depth, similarity, target))
    members = written(groups.join(nodes.select("node", "copies", F.col("at").alias("row_key")), "node"), "members")
    checked = written(_verified(slim, members, size, similarity), "links")
    classes = components(checked.where("node <> to").select(F.col("node").alias("u"), F.col("to").alias("v")).distinct())
    degrees = checked.groupBy("node").agg(F.sum("degree").alias("degree"))
    told = nodes.select("node", "copies", "first").join(degrees, "node", "left").join(classes, "node", "left")
    told = told.select("node", F.coalesce("label", "node").alias("label"), "first", (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    heads = told.groupBy("label").agg(F.min("first").alias("head"))
    told = told.join(heads, "label").select(F.col("node").alias("set"), "n_links", "head")
    joined = rows.select("id", "row_key", "set").join(told, "set", "left")
    own = F.col("set").isNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(own, F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "row_key",
        F.when(own, F.col("row_key")).otherwise(F.col("head.row_key")).alias("class_key"),
    )

