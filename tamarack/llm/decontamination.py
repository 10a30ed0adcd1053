"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Each benchmark item is cut into windows of `window` words (a shorter item is one window). For exact containment of a
window's words the necessary prefix, in order of rarity, is one word: the rarest. So documents are probed for the
rarest word of every window only; where it stands, length and position bounds and then the words around it decide.

Rarity is the number of documents that hold a word, counted over all documents for the benchmark's words. The probe
writes each row once, without its text, with the few words around its probed places; only places leave their rows, and
hits come back to all rows of a text by a digest of it. The rarest words are matched as a literal set, and windows are
broadcast, while both are few (their number is counted first); beyond that the same places come from shuffled joins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .sizing import free_names, replace_columns

#: Words matched as a literal set, and words and item ids of all windows that are broadcast; a larger benchmark takes
#: the joins.
MAX_LITERALS, MAX_ENTRIES = 50_000, 2_000_000
#: Everything between words: ASCII other than letters and digits.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_OUTPUTS = ("n_words", "n_hit", "n_items", "item_ids", "contaminated")


def words_of(text: Column) -> Column:
    """Words in their own case; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN, -1), "")


def lower_ascii(word: Column) -> Column:
    return F.translate(word, string.ascii_uppercase, string.ascii_lowercase)


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """One row for each different window: words, and the ids (strings) of the items that hold it."""
    words = F.transform(words_of(F.col(text_col)), lower_ascii)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return (
        items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words.alias("w"))
        .where(F.size("w") > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words"))
        .groupBy("words")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def _document_counts(rows: DataFrame, vocabulary: DataFrame, listed: list[str] | None) -> DataFrame:
    """For each folded word of the vocabulary the number of documents with it."""
    folded = F.transform("w", F.lower)
    if listed is not None:
        held = rows.select(F.explode(F.array_distinct(F.filter(folded, lambda x: x.isin(listed)))).alias("fold"))
    else:
        held = rows.select(F.explode(F.array_distinct(folded)).alias("fold")).join(vocabulary, "fold", "left_semi")
    return held.groupBy("fold").agg(F.count("*").alias("n_docs"))


def _anchors(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """For each rarest word (folded) its windows, with the word's place in them. One row a window."""
    placed = windows.select("words", "items", F.posexplode("words").alias("place", "word")).withColumn("fold", F.lower("word"))
    ranked = placed.join(counts, "fold", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    rarest = ranked.groupBy("words", "items").agg(F.min(F.struct("n_docs", "fold", "place")).alias("a"))
    return rarest.select(F.col("a.fold").alias("fold"), "words", "items", F.col("a.place").alias("place"))


def _contexts(places: Column, words: Column, window: int) -> Column:
    """For each place (at): where its context begins and the folded words from window - 1 before to window - 1 after."""

    def context(i: Column) -> Column:
        low = F.greatest(i - (window - 1), F.lit(0))
        return F.struct(i.alias("at"), low.alias("low"), F.transform(F.slice(words, low + 1, i - low + window), lower_ascii).alias("around"))

    return F.transform(places, context)


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    max_literals: int = MAX_LITERALS,
    max_entries: int = MAX_ENTRIES,
) -> DataFrame:
    """Every row of docs, without its text, with n_words, n_hit, n_items, item_ids (sorted strings), contaminated.

    Words are runs of ASCII letters and digits and of everything outside ASCII; A-Z compare as a-z. A document word
    counts as hit inside any occurrence of a window. Null or empty texts have no words and no hits, as items they have
    no windows; a null item id reads as ''. Repeated rows come back as often as they came in. Without items nothing
    is contaminated. Input columns named like an output are replaced, all others keep their names and may be of any type.
    """
    kept = replace_columns(docs, *_OUTPUTS, text_col).columns
    key, places, found = free_names(docs, "key", "places", "found")
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(words_of(text).alias("w"))
    windows = written(item_windows(items, item_id, item_text, window), "windows")
    entries = windows.agg(F.sum(F.size("words") + F.size("items")).alias("n")).first().n or 0
    vocabulary = windows.select(F.explode("words").alias("word")).select(F.lower("word").alias("fold")).distinct()
    listed = [r.fold for r in vocabulary.limit(max_literals + 1).collect()]
    inline = len(listed) <= max_literals and entries <= max_entries
    counts = _document_counts(plain, vocabulary, listed if inline else None)
    anchors = written(_anchors(windows, F.broadcast(counts) if inline else counts), "anchors")  # inline: max_literals rows

    digest = F.unhex(F.md5(text.cast("binary"))).alias(key)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], digest, words_of(text).alias(found))
    n_words = F.size(found).cast("long")
    if inline:
        folds = [r.fold for r in anchors.select("fold").distinct().collect()]  # some of those listed
        at = F.filter(F.transform(found, lambda w, i: F.when(F.lower(w).isin(folds), i)), lambda i: i.isNotNull())
        at = _contexts(at, F.col(found), window) if folds else F.array().cast("array<struct<at:int,low:int,around:array<string>>>")
        rows = written(rows.select(*kept, key, n_words.alias("n_words"), at.alias(places)), "probed")
        probes = rows.where(F.size(places) > 0).select(F.col(key).alias("key"), "n_words", F.explode(places).alias("c"))
        anchors = F.broadcast(anchors)  # max_entries words and ids
    else:
        told = rows.select(F.col(key).alias("key"), F.posexplode(F.transform(found, F.lower)).alias("at", "fold"))
        told = told.join(anchors.select("fold").distinct(), "fold", "left_semi").groupBy("key").agg(F.collect_set("at").alias("at"))
        texts = rows.select(F.col(key).alias("key"), n_words.alias("n_words"), F.col(found).alias("w")).join(told, "key")
        probes = texts.select("key", "n_words", F.explode(_contexts(F.col("at"), F.col("w"), window)).alias("c"))
        rows = rows.select(*kept, key, n_words.alias("n_words"))
    probes = probes.withColumn("fold", F.lower(F.element_at("c.around", F.col("c.at") - F.col("c.low") + 1)))
    start = F.col("c.at") - F.col("place")
    inside = (start >= 0) & (start + F.size("words") <= F.col("n_words"))
    same = F.slice("c.around", F.when(inside, start - F.col("c.low") + 1).otherwise(1), F.size("words")) == F.col("words")
    hits = probes.join(anchors, "fold").where(inside & same).select("key", start.alias("start"), F.size("words").alias("size"), F.explode("items").alias("item"))
    spans = F.array_sort(F.collect_set(F.struct("start", "size")))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["start"] + s["size"]).alias("end"),
            (acc["n"] + F.greatest(s["start"] + s["size"] - F.greatest(acc["end"], s["start"]), F.lit(0))).alias("n"),
        ),
    )["n"]
    met = hits.groupBy(F.col("key").alias(key)).agg(covered.alias("n_hit"), F.array_sort(F.collect_set("item")).alias("item_ids"))
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("item_ids", F.array().cast("array<string>"))
    return rows.join(met, key, "left").select(*kept, "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))
