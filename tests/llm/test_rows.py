"""Operators that work row by row: codecs, counts, pseudonyms, secrets, pages, the classifier, and the pipeline."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tamarack.llm import html_extraction as H
from tamarack.llm import jpeg, media_columns, pii, quality_classifier, secret_scan
from tamarack.llm import sentencepiece_codec as S
from tamarack.llm import token_counts as C
from tamarack.llm.queries import PATTERN, QUERIES, TOKENIZERS
from tamarack.llm.shared import written
from tests.conftest import DATA

SF = str(DATA / "sf0.001")
ODD = [None, "", " ", "  two  spaces ", "a\n\n b\n", "x▁y", "日本語 テキスト 😀", "\t\r\n", "        indent", "<s> </s> <0x0A>", "ab" * 3000, "ıİß… é", "word " * 4000]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ODD


# Media columns


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 385, 5000, 70_000])
def test_jpeg_round_trip(size):
    payload = media_columns.padded(os.urandom(size))
    assert len(payload) % 64 == 0 and len(payload) >= max(64, size)
    back, rgb = media_columns.from_jpeg(media_columns.to_jpeg(payload))
    assert back == payload and rgb.ndim == 3 and rgb.dtype == np.uint8


def test_jpeg_bit_reader_agrees(monkeypatch):
    file = media_columns.to_jpeg(media_columns.padded(os.urandom(1500)))
    fast = jpeg.Picture(file)
    monkeypatch.setattr(jpeg, "_uniform", lambda *a: None)
    slow = jpeg.Picture(file)
    assert all((a == b).all() for a, b in zip(fast.planes, slow.planes, strict=True))


def test_inverse_transform():
    planes = [np.zeros((2, 2, 64), np.int16), np.zeros((1, 1, 64), np.int16), np.zeros((1, 1, 64), np.int16)]
    planes[0][:, :, 0], planes[0][0, 0, 1] = 80, 40
    picture = jpeg.Picture(media_columns.to_jpeg(bytes(384)))
    picture.planes = planes
    y = picture.rgb()[:, :, 0].astype(int)
    assert (y[8:, 8:] == 138).all()  # 80 / 8 + 128
    want = [round(138 + 40 / 4 * np.cos((2 * x + 1) * np.pi / 16) * np.sqrt(0.5)) for x in range(8)]
    assert (y[0, :8] == want).all() and (y[7, :8] == want).all()


def test_media_query(spark, texts):
    out = media_columns.load(media_columns.store(docs_of(spark, texts)))
    for r in out.collect():
        payload = media_columns.padded((texts[r.doc_id] or "").encode())
        assert bytes(r.payload) == payload and len(r.rgb) == r.height * r.width * 3
    q = {r.doc_id: r for r in QUERIES["op8_media_columns"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        p = media_columns.padded(r.text.encode())
        got = q[r.doc_id]
        assert (got.n_bytes, got.payload_bytes, got.payload_sha256, got.tail_crc32) == (len(r.text.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_another_decoder_reads_the_files(spark):
    """The JVM's own JPEG reader sees the same picture: its luminance samples are ours."""
    jvm, r = spark._jvm, random.Random(3)
    for size in (64, 5000):
        file = media_columns.to_jpeg(media_columns.padded(bytes(r.choices(b"abcdefgh ", k=size))))
        stream = jvm.javax.imageio.ImageIO.createImageInputStream(jvm.java.io.ByteArrayInputStream(file))
        reader = jvm.javax.imageio.ImageIO.getImageReadersByFormatName("jpeg").next()
        reader.setInput(stream)
        raster = reader.readRaster(0, None)
        picture = jpeg.Picture(file)
        h, w, _ = picture.rgb().shape
        assert (raster.getWidth(), raster.getHeight()) == (w, h)
        seen = np.array(list(raster.getSamples(0, 0, min(w, 64), 16, 0, spark.sparkContext._gateway.new_array(jvm.int, min(w, 64) * 16)))).reshape(16, -1)
        ours = luminance(picture)[:16, : min(w, 64)]
        assert np.abs(seen - ours).max() <= 2 and seen.std() > 5


def luminance(picture):
    """The Y plane by the transform's definition, in floating point."""
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(0.5), 1.0)[None, :] / 2
    natural = np.zeros(picture.planes[0].shape)
    natural[..., jpeg.ZIGZAG] = picture.planes[0]  # coefficients are kept in the order of the scans
    blocks = natural.reshape(*natural.shape[:2], 8, 8)
    pixels = np.einsum("yv,rcvu,xu->rycx", basis, blocks, basis) + 128
    return np.clip(np.round(pixels.reshape(pixels.shape[0] * 8, -1)), 0, 255)


def test_media_names_and_features(spark):
    df = spark.createDataFrame([(1, "x", 3, 4), (2, None, 3, 4)], "doc_id long, text string, _text int, feature int")
    out = media_columns.load(media_columns.store(df))
    assert out.columns == ["doc_id", "_text", "media", "payload", "rgb", "height", "width", "feature"]
    for row in out.collect():
        small = media_columns.thumbnail(np.frombuffer(row.rgb, np.uint8).reshape(row.height, row.width, 3))
        plain = [[np.frombuffer(row.rgb, np.uint8).reshape(row.height, row.width, 3)[y * row.height // 8 : (y + 1) * row.height // 8, x * row.width // 8 : (x + 1) * row.width // 8].reshape(-1, 3).mean(axis=0) for x in range(8)] for y in range(8)]
        assert (small == np.floor(np.array(plain) + 1e-9)).all() and row.feature.startswith(f"{row.height}x{row.width}:") and len(row.feature.split(":")[1]) == 16
    assert media_columns.load(media_columns.store(df.limit(0))).count() == 0


# SentencePiece


def test_encoding_is_the_models(spark, texts):
    import sentencepiece

    model = f"{TOKENIZERS}/piece_bpe_32k.model"
    reference = sentencepiece.SentencePieceProcessor(model_file=model)
    got = S.decode(S.encode(docs_of(spark, texts), model), model)
    for r in got.collect():
        assert list(r.ids) == reference.encode(r.text or "")
        assert r.decoded == (r.text or "").replace(S.MARK, " ")
    both = S.encode(docs_of(spark, texts).withColumn("ids", F.lit(1)), model, keep_text=False, decoded_col="decoded")
    assert both.columns == ["doc_id", "ids", "decoded"]
    assert {r.doc_id: r.decoded for r in both.collect()} == {r.doc_id: r.decoded for r in got.collect()}


def test_encoding_random():
    import sentencepiece

    model = f"{TOKENIZERS}/piece_bpe_32k.model"
    reference, codec, r = sentencepiece.SentencePieceProcessor(model_file=model), S.Codec(S.read_vocabulary(model)), random.Random(2)
    for _ in range(300):
        text = "".join(r.choice(["the", "tion", "un", " ", "  ", "a", "é", "\n", ".", "Z", "99", "▁", "ß", "ing"]) for _ in range(r.randint(0, 40)))
        assert codec.encode([text])[0].tolist() == reference.encode(text)


def test_sentencepiece_query(spark):
    assert QUERIES["op10_sentencepiece"](spark, SF).where("not same_text").count() == 0


# Token counts


@pytest.fixture(scope="module")
def counter():
    return C.Counter(C.read_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), PATTERN)


def test_counts_follow_edits(counter, texts):
    r = random.Random(5)
    bits = ["'", "l", " ", "  ", "\n", "a", "Z", "9", ".", "é", "'ll", "hello world", "😀", "\t\t x"]
    for k in range(400):
        text = (r.choice(texts) or "")[:4000] if k % 2 else "".join(r.choices(bits, k=r.randint(0, 300)))
        doc = C.Document(counter, text)
        assert doc.n_tokens == len(counter.encoding.encode_ordinary(text))
        for _ in range(r.randint(1, 5)):
            start, delete, insert = r.randint(0, len(text) + 2), r.choice([0, 1, 2, 5, 40, 1000]), "".join(r.choices(bits, k=r.choice([0, 1, 6, 30])))
            doc.edit(start, delete, insert)
            start = min(start, len(text))
            text = text[:start] + insert + text[start + delete :]
            assert doc.text == text and doc.n_tokens == len(counter.encoding.encode_ordinary(text))


def test_edits_touch_little(counter):
    doc = C.Document(counter, "some ordinary words in a row " * 2000)
    doc.edit(20_000, 3, "xyz")
    assert doc.encoded < 20


def test_many_edits_at_one_place(counter):
    """No leaf grows without bound, wherever the insertions fall, and edits after splits still count right."""
    text = "some ordinary words in a row " * 100
    doc, r = C.Document(counter, text), random.Random(6)
    for k in range(10_000):
        doc.edit(1000, 0, f" w{k}" if k % 3 else "x")
    assert max(len(a) for a, _ in doc.leaves) <= 2 * C.LEAF and len(doc.leaves) > 100
    assert doc.n_tokens == len(counter.encoding.encode_ordinary(doc.text))
    for _ in range(60):
        start = r.randint(0, len(doc.text))
        text = doc.text
        delete, insert = r.choice([0, 3, 2000]), r.choice(["", "  a", "no 1 " * 300])
        doc.edit(start, delete, insert)
        assert doc.text == text[:start] + insert + text[start + delete :]
        assert doc.n_tokens == len(counter.encoding.encode_ordinary(doc.text))
        assert max(len(a) for a, _ in doc.leaves) <= 2 * C.LEAF
    doc.edit(0, len(doc.text), "")
    assert doc.n_tokens == 0
    doc.edit(0, 0, "again")
    assert doc.n_tokens == len(counter.encoding.encode_ordinary("again"))


def test_count_table(spark, counter):
    rows = [(0, None, None), (1, "", [(0, 0, "new text")]), (2, "a b c", [None, (1, 99, None)]), (2, "a b c", [None, (1, 99, None)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,delete:int,insert:string>>").withColumn("n_tokens", F.lit("x"))
    got = sorted(map(tuple, C.count_tokens(df, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", PATTERN).select("doc_id", "n_tokens", "n_tokens_after", "edited_text").collect()))
    assert got == [(0, 0, 0, ""), (1, 0, 2, "new text"), (2, 3, 1, "a"), (2, 3, 1, "a")]


def test_count_query(spark, counter):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op3_token_counts"](spark, SF).collect():
        t = docs[r.doc_id]
        assert r.n_tokens == len(counter.encoding.encode_ordinary(t))
        n, head = len(t), t[:12]
        for start, delete, insert in ((n // 4, 0, " " + head), (n // 2, 7, ""), (n * 3 // 4, 9, head)):
            t = t[:start] + insert + t[start + delete :]
        assert (r.n_tokens_after, r.n_chars_after) == (len(counter.encoding.encode_ordinary(t)), len(t))


# PII


def test_pseudonyms(spark):
    text = "a.b9@mail7.example.com, +1 (843) 555-4223, 192.202.71.219, 4012888888881881, 2024-02-29, 078-05-1120, 4012-8888-8888-1881."
    keep = "1234567890123456 999.1.2.3 2023-02-30 000-12-3456 words"
    df = docs_of(spark, [text, keep, None, "", text, LONG_PII])
    out = {r.doc_id: r for r in pii.pseudonymise(df.withColumn("pii", F.lit(1)), "k").collect()}
    assert out[1].text == keep and out[1].pii == [] and out[2].text is None and out[3].text == ""
    assert out[0].text == out[4].text != text and [p.kind for p in out[0].pii] == ["email", "phone", "ipv4", "card", "date", "ssn", "card"]
    for secret in re.findall(r"[^ ,]+", text)[:1] + ["192.202.71.219", "4012888888881881", "2024-02-29"]:
        assert secret not in out[0].text
    cards = [re.sub(r"\D", "", p.pseudonym) for p in out[0].pii if p.kind == "card"]
    assert cards[0] == cards[1]  # one number, two ways of writing it

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    assert luhn(cards[0])
    assert re.sub("[0-9]", "9", re.sub("[a-z]", "a", out[0].text)).replace("aaa.aaa", "") != ""
    back = pii.pseudonymise(pii.pseudonymise(df, "k"), "k", undo=True)
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate([text, keep, None, "", text, LONG_PII]))
    assert pii.pseudonymise(df, "other").where("doc_id = 0").first().text != out[0].text


LONG_PII = "x y.z@example.org " * 2000


def test_cards_and_phones_beside_other_digits(spark):
    card, dashed = "4111 1111 1111 1111", "4111-1111-1111-1111"
    texts = [f"{card} 12/27", f"123 {card}", f"{dashed} 737", f"{card} 737", f"1234 {card}", f"{card} 2024-02-29", f"{card} 5500 0000 0000 0004 99", "12345 3782 822463 10005", f"{card} 555.123.4567"]
    phones = ["555 123 4567", "+1 555 123 4567", "(555) 123 4567", "123 555-123-4567"]
    keep = ["1 2 3 " * 2000, "1" * 50000, "1234 5678 9012 3456 12/27"]
    kinds = [["card"]] * 5 + [["card", "date"], ["card", "card"], ["card"], ["card", "phone"]] + [["phone"]] * 4 + [[]] * 3
    df = docs_of(spark, texts + phones + keep)
    out = written(pii.pseudonymise(df, "k"), "pii")
    rows = {r.doc_id: r for r in out.collect()}
    assert [[p.kind for p in rows[i].pii] for i in range(len(kinds))] == kinds
    for i, t in enumerate(texts + phones):
        assert not any(secret in rows[i].text for secret in (card, dashed, "5500 0000 0000 0004", "3782 822463 10005", "123 4567", "123-4567")), t
        assert re.sub("[0-9]", "9", rows[i].text) == re.sub("[0-9]", "9", t)
        assert all(p.pseudonym in rows[i].text for p in rows[i].pii)
    assert [rows[i].text for i in range(len(texts + phones), len(kinds))] == keep
    back = pii.pseudonymise(out, "k", undo=True)
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(texts + phones + keep))
    many = docs_of(spark, [f"{i:03} {card} {i:04} {i * 7919 % 10000:04}" for i in range(100)])  # some neighbours make cards by chance
    there = written(pii.pseudonymise(many, "k"), "pii")
    assert there.where("size(pii) = 0 or contains(text, '1111 1111 1111')").count() == 0
    assert pii.pseudonymise(there, "k", undo=True).select("doc_id", "text").exceptAll(many).count() == 0


def test_number_permutation(spark):
    n = 17 * 4297
    x = spark.range(n).select("id", pii.permute_number(F.col("id"), 17, 4297, F.lit("k"), "date").alias("y"))
    assert x.agg(F.countDistinct("y"), F.min("y"), F.max("y")).first()[:] == (n, 0, n - 1)


# Secrets


def test_forest_on_held_out_findings(spark):
    model = secret_scan.train(secret_scan.labelled_findings(spark))
    held = secret_scan.labelled_findings(spark, 400, seed=99)
    lines = [(i, f"{r.before}{r.candidate}{r.after}", r.path, r.label) for i, r in enumerate(held.collect())]
    df = spark.createDataFrame(lines, "doc_id long, text string, path string, label double")
    found = {r.doc_id for r in secret_scan.scan(df, model, path_col="path").collect()}
    right = sum((i in found) == (label == 1) for i, _, _, label in lines)
    assert right >= 0.95 * len(lines)
    odd = docs_of(spark, [None, "", "no candidates", 'x token = "d4e71e33b54f40bc277a32011430a66d5e984911" y' + " z" * 9000])
    assert [(r.doc_id, r.n) for r in secret_scan.scan(odd.withColumn("probability", F.lit(1)), model).collect()] == [(3, 1)]


def test_secret_query(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()
    want = {(r.doc_id, m) for r in docs for m in re.findall(r'(?i)token = "([0-9a-f]{40})"', r.text)}
    got = {(r.doc_id, r.secret) for r in QUERIES["op1_secret_scan"](spark, f"{DATA}/sf0.01").collect()}
    assert got == want


# Pages


PAGE = (
    '<html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></ul></nav>'
    '<div class="cookie-notice">We use cookies</div><div class="ad">Buy {0}</div><article><h1>Head {0}&amp;co</h1><p>First <b>bold</b>\n  text&nbsp;{0}.<p>Second'
    '<form><input name=a>Mail</form><aside>Side</aside><!-- no --></article><section id="comments"><p>Nice post {0}</p></section><footer>&copy; Host</footer></body></html>'
)


def test_main_text():
    assert H.main_text(PAGE.format(1), frozenset()) == "Head 1&co\nFirst bold text 1.\nSecond"
    assert H.main_text("", frozenset()) == "" and H.main_text("plain <b>text", frozenset()) == "plain text"
    assert H.main_text("<p>a &lt;b&gt; &am &#233;", frozenset()) == "a <b> &am é"


def test_template_without_semantics(spark):
    def page(i):
        return f"<body><div><span>Home</span> <span>About us</span></div><div><div>Story {i} tells of {i * 7} things at length, in words.</div><div>More of story {i}.</div></div><div>All rights of the host</div></body>"

    rows = [(i, "http://h.example/" + str(i), page(i)) for i in range(8)] + [(8, None, None), (9, "http://one.example/", PAGE.format(9)), (9, "http://one.example/", PAGE.format(9))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = sorted((r.page_id, r.text) for r in H.extract(df).collect())
    assert got[:8] == [(i, f"Story {i} tells of {i * 7} things at length, in words.\nMore of story {i}.") for i in range(8)]
    assert got[8] == (8, "") and got[9] == got[10]
    assert H.extract(df.limit(0)).count() == 0


def test_pages_query(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op2_html_extraction"](spark, SF).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# Classifier


def test_classifier(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    good = labels.where("quality = 1 and toxic = 0").select("doc_id")
    half = good.where("pmod(xxhash64(doc_id), 2) = 0")  # fitted on one half of the labelled rows, judged on the other
    rest = labels.where("pmod(xxhash64(doc_id), 2) = 1")
    kept = quality_classifier.resample(docs.select("doc_id", "text"), half).select("doc_id")
    judged = rest.join(kept.withColumn("kept", F.lit(1)), "doc_id", "left").fillna(0, ["kept"]).groupBy("quality", "toxic").agg(F.avg("kept").alias("share"))
    share = {(r.quality, r.toxic): r.share for r in judged.collect()}
    # half of this small table has few of each language's toxic words; whole tables of the check's size miss none
    assert share[1, 0] > 0.98 and share[1, 1] < 0.45 and share[0, 0] < 0.15


def test_classifier_edges(spark):
    docs = docs_of(spark, [None, "", "plain words here", "x" * 5000, "plain words here"]).withColumn("log_weight", F.lit("a"))
    none = spark.createDataFrame([], "doc_id long")
    assert quality_classifier.resample(docs, none).count() == 5
    assert quality_classifier.resample(docs.limit(0), none).count() == 0
    assert quality_classifier.resample(docs, none, k=2).count() >= 2 and quality_classifier.resample(docs, none, k=0).count() == 0


def test_kth_largest(spark):
    r = random.Random(6)
    xs = [r.choice([r.gauss(0, 1), 0.5]) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for k in (1, 7, 1500, 3000):
        assert quality_classifier.kth_largest(df, k, bins=8) == sorted(xs, reverse=True)[k - 1]
    assert quality_classifier.kth_largest(df, 3001) is None


# Pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, stage(spark, at, f"{DATA}/sf0.01").cache()
        seen[name] = at
        assert at.join(before, "doc_id", "left_anti").count() == 0
        if name != "sentencepiece":
            assert at.columns == docs.columns
    from tests.llm.test_windows_and_joins import brute_contamination, brute_links

    rows = seen["quality_classifier"].select("doc_id", "text").orderBy("doc_id").collect()
    links = brute_links([r.text for r in rows])
    assert {r.doc_id for r in seen["ngram_jaccard_join"].collect()} == {rows[c].doc_id for c, _ in links.values()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.01/benchmark.parquet").collect()]
    rows = seen["ngram_jaccard_join"].collect()
    clean = {r.doc_id for r, (_, n, _) in zip(rows, brute_contamination([r.text for r in rows], items), strict=True) if not n}
    assert {r.doc_id for r in seen["benchmark_decontamination"].collect()} == clean
    from tests.llm.test_pii import ALONE, PII_KEY, expected

    before = {r.doc_id: r.text for r in seen["benchmark_decontamination"].collect()}
    after = {r.doc_id: r for r in seen["pii"].collect()}
    assert all(r.text == ALONE.sub(lambda m: expected(m[0], PII_KEY), before[i]) and r.n_chars == len(r.text) for i, r in after.items())
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    assert {r.doc_id: (r.n_tokens, list(r.ids)) for r in seen["sentencepiece"].collect()} == {i: (len(x), x) for i, x in ((i, model.encode(r.text)) for i, r in after.items())}
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{DATA}/sf0.01").collect()} == clean


def test_stages_of_strange_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, clashing names, maps, and empty tables."""
    rows = [(1, "plain words of a text here", "s", {"a": 1}, "x"), (1, "plain words of a text here", "s", {"a": 1}, "x"), (1, "plain words of a text here", None, None, None), (None, None, None, None, None), (None, "", None, None, "y"), (2, "", None, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key map<string,int>, secret string").withColumn("n_chars", F.char_length("text").cast("long"))
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    counts = []
    for table in (docs, docs.limit(0)):
        at = table
        for name, stage in corpus_pipeline.STAGES:
            at = written(stage(spark, at, str(tmp_path)), name)
            counts.append(at.count())
            assert name == "sentencepiece" or at.columns == docs.columns
    assert counts == [6, 4, 4, 4, 4] + [0] * 5  # of the three equal texts one stays; texts without words are no copies


def test_names_of_whole_pages_and_headers():
    page = '<body class="with-sidebar"><div class="site-header">Site</div><main class="has-ads"><article><div class="post-header"><h1>Title</h1></div><p>Text</p><div class="share-bar">Share</div></article></main></body>'
    assert H.main_text(page, frozenset()) == "Title\nText"
    assert H.main_text("<p>a<b>&nbsp;b</b>&#32;<i>c</i>", frozenset()) == "a b c"


def test_names_do_not_drop_articles():
    article = "<article{}><h1>Title</h1><p>Text of it</p></article>"
    for wrapper in ("layout with-sidebar", "no-sidebar", "related work", "has-ads page"):
        assert H.main_text(f'<div class="{wrapper}">{article.format("")}</div>', frozenset()) == "Title\nText of it"
    assert H.main_text('<div id="related-work">' + article.format(' class="post comments-open"') + "</div>", frozenset()) == "Title\nText of it"
    assert H.main_text(article.format(' class="post related"') * 3, frozenset()) == "\n".join(["Title\nText of it"] * 3)
    assert H.main_text(f'<div class="notice page"><h1>Title</h1><p>{"Text " * 50}</p></div><div class="ad">Buy</div>', frozenset()).startswith("Title\nText")
    page = '<div id="comments"><article><p>Nice</p></article></div><div class="menu">Home</div>' + article.format("")
    assert H.main_text(page, frozenset()) == "Title\nText of it"  # readers' comments stay out, also as articles
    assert H.main_text('<main><article><p>Text</p><div class="comments"><article>Nice</article></div></article></main>', frozenset()) == "Text"


def test_uniform_headings_of_articles_stay(spark):
    page = "<body><div>Home of host</div><article><h2>Summary</h2><p>Story {0}</p><b>Note:</b> {0}<div class=ad>Buy</div></article><div>All rights</div></body>"
    df = spark.createDataFrame([(i, f"http://h.example/{i}", page.format(i)) for i in range(6)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in H.extract(df).collect()} == {i: f"Summary\nStory {i}\nNote: {i}" for i in range(6)}


def test_counts_of_many_partitions(spark, monkeypatch):
    """Counts added up in levels are those of one partition."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    good = docs.where("doc_id % 2 = 0").select("doc_id")
    one = quality_classifier.fit(docs.coalesce(1), good)
    assert (quality_classifier.fit(docs.repartition(40), good) == one).all() and (one < 0).any()
    assert not quality_classifier.fit(docs.limit(0), good).any()
