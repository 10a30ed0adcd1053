"""The registered queries of the training-data operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import find_contamination
from .hard_negatives import mine
from .html_extraction import extract
from .media_columns import load, store
from .ngram_join import near_duplicates
from .pii import pseudonymise
from .quality_classifier import resample
from .quality_rules import COUNTS, judge
from .secret_scan import labelled_findings, scan, train
from .sentencepiece_codec import encode
from .source_divergence import audit
from .substring_dedup import remove_repeats
from .token_counts import count_tokens

#: Where the vocabularies of public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pre-token pattern of the byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = scan(docs, train(labelled_findings(spark)), path_col="source")
    return found.select("doc_id", "source", "n", F.col("candidate").alias("secret"), "probability")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def example_edits(text: F.Column) -> F.Column:
    """Three edits spread over a text: an insertion at a quarter, a deletion at the middle, a replacement at three
    quarters (by the text's own first characters)."""
    n = F.char_length(text)

    def edit(start, delete, insert):
        return F.struct(start.cast("int").alias("start"), F.lit(delete).alias("delete"), insert.alias("insert"))

    head = F.substring(text, 1, 12)
    return F.array(edit(n / 4, 0, F.concat(F.lit(" "), head)), edit(n / 2, 7, F.lit("")), edit(n * 3 / 4, 9, head))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", example_edits(F.col("text")).alias("edits"))
    out = count_tokens(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", PATTERN)
    return out.select("doc_id", "n_tokens", "n_tokens_after", "n_encoded", "n_edits", F.char_length("edited_text").cast("long").alias("n_chars_after"))


#: The key that the registered queries permute with; a deployment passes its own secret.
PII_KEY = "tamarack-demo-key"


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymise(docs, PII_KEY)
    kinds = F.array_join(F.transform("pii", lambda p: p["kind"]), ",")
    return out.select("doc_id", "text", F.size("pii").alias("n_replaced"), kinds.alias("kinds"))


def good_labels(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and toxic = 0").select("doc_id")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = resample(docs, good_labels(table(spark, sf_dir, "labels")), keep_text=False)
    return kept.select("doc_id", "log_weight", F.round("sample_key", 6).alias("sample_key"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs, "text", window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, size=5, similarity=0.8).select("doc_id", "class_id", "n_links")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    read = load(store(docs, "text"))
    payload = F.col("payload")
    return read.select(
        "doc_id",
        F.coalesce("n_bytes", F.lit(0).cast("long")).alias("n_bytes"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    out = find_contamination(docs, items, window=10)
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = f"{TOKENIZERS}/piece_bpe_32k.model"
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), "text")
    read = encode(docs, model, keep_text=False, decoded_col="decoded")
    digest = F.sha2(F.col("decoded").cast("binary"), 256)
    return read.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", digest.alias("decoded_sha256"), (digest == F.col("text_sha256")).alias("same_text"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return mine(vectors, F.col("vec_id") % 50 == 0)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "probability")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_html_extraction": op2_html_extraction,
    "op3_token_counts": op3_token_counts,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_media_columns": op8_media_columns,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_source_divergence": op12_source_divergence,
    "op13_quality_rules": op13_quality_rules,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE: dict[str, str] = {
    "op6_substring_dedup": """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
pos AS (SELECT rid, s, array_to_string(list_slice(w, s, s + 34), ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
rep AS (SELECT rid, s FROM pos WHERE win IN (SELECT win FROM pos GROUP BY win HAVING count(*) > 1)),
gone AS (SELECT DISTINCT rid, unnest(range(s, s + 35)) AS p FROM rep),
word AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN n USING (rid)""",
    "op9_benchmark_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(list_slice(w, s, s + 9), ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
pos AS (SELECT rid, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT rid, s, n, item FROM pos JOIN win USING (win, n)),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hits) GROUP BY rid),
names AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN names USING (rid)""",
    "op11_hard_negatives": """
WITH e AS (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.id % 50 = 0 AND a.r <> b.r),
p AS (SELECT * FROM (SELECT r, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS j FROM s WHERE same) WHERE j <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.j ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op12_source_divergence": """
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
words AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS k FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS v, sum(k) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS k FROM words JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT g.lang, source, v, v.n AS lang_n, coalesce(sum(k), 0) AS n FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, t.term, coalesce(c.k, 0) AS k, (1 + (1000000000::HUGEINT * (coalesce(c.k, 0) + 5)) // (n + 5 * v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (t.k + 5)) // (lang_n + 5 * v))::BIGINT AS q
  FROM gn JOIN kept t USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = t.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
    ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE k > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50""",
}
