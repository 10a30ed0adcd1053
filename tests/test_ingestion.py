"""Ingestion of whole tables against plain Python; repaired answers; strange items."""

import hashlib
import json
import re

from pyspark.sql import functions as F

from tamarack.functions import kernels as N
from tamarack.functions import legal_text as L
from tamarack.plans import ingestion as I
from tamarack.plans import registry
from tests.conftest import DATA
from tests.test_text import plain_artifact, plain_chunks, plain_form, plain_quality

SF = str(DATA / "sf0.001")


def plain_pdf_form(text):
    lines = plain_form(text).split("\n")
    lines = [" ".join(x.split()) for x in lines]
    return re.sub("\n\n\n+", "\n\n", "\n".join(x for x in lines if not plain_artifact(x))).strip()


def plain_item(r):
    """(method, text, quality) of the best extracted text, warnings and status."""
    best = None
    for e in r.extracted:
        text = plain_pdf_form(e.text) if r.kind == "pdf" else plain_form(e.text)
        if text:
            q = plain_quality(text)
            key = (q[0], len(re.findall(L.LAO_MARKERS, text[:12000])), len(text))
            if best is None or key > best[0]:
                best = (key, e.method, text, q)
    _, method, text, q = best or (None, None, "", None)
    known = r.kind in I.KINDS
    ok = known and (len(text) >= 20 or r.allow_short)
    notes = list(q[3]) if ok and q else []
    notes += [I.UNSUPPORTED] * (not known) + [I.TOO_SHORT] * (known and not ok) + [I.SHORT] * (ok and len(text) < 20) + [I.REVIEW] * bool(ok and q and q[2] >= 80 and q[0] < 0.78)
    return method, text, q, ok, list(dict.fromkeys(notes))


def test_ingestion_is_the_plain_one(spark):
    items = {r.id: r for r in I.example_items(spark, SF).collect()}
    methods, chunks = set(), {}
    for r in registry.QUERIES["ingest_documents"](spark, SF).collect():
        method, text, q, ok, notes = plain_item(items[r.id])
        assert (r.method, r.text_length, r.text_sha256) == (method, len(text), hashlib.sha256(text.encode()).hexdigest()), r.id
        assert (r.status, r.review_status, r.warnings) == ("indexed" if ok else "failed", "pending_review" if ok else "failed", " / ".join(notes)), r.id
        assert abs((r.score or 0) - (q[0] if q else 0)) < 1e-6
        chunks[r.id] = plain_chunks(text, 2600, 350) if ok else []
        assert r.n_chunks == len(chunks[r.id])
        methods.add((method, ok))
    assert len(methods) >= 3
    got = {(r.source_id, r.chunk_index): (r.content_sha256, r.section_ref, r.token_count) for r in registry.QUERIES["ingest_chunks"](spark, SF).collect()}
    assert got == {(i, k): (hashlib.sha256(c.encode()).hexdigest(), s, n) for i, cs in chunks.items() for k, (c, s, n) in enumerate(cs)}


def test_strange_items(spark):
    schema = "id long, file_name string, kind string, document_type string, title string, jurisdiction string, review_status string, allow_short boolean, extracted array<struct<method:string,text:string>>"
    rows = [
        (1, "a/b_c.pdf", "pdf", None, None, "laos", "approved", False, []), (2, "x.docx", "docx", "case", "T", None, None, True, [("m", None)]), (3, None, None, None, None, None, None, None, None),
        (4, "y.txt", "text", "template", None, "laos", "approved", False, [("m", ""), ("n", "Article 1 long enough text of a law")]),
    ]
    out = {r.id: r for r in I.ingest(spark.createDataFrame(rows, schema)).collect()}
    assert {i: (r.status, r.source_table, r.title, r.method, len(r.chunks)) for i, r in out.items() if i != 3} == {
        1: ("failed", "laws", "b c", None, 0), 2: ("indexed", "cases", "T", None, 0), 4: ("indexed", "legal_forms", "y", "n", 1)
    }
    assert out[3].status == "failed" and out[3].text == "" and out[1].warnings == [I.TOO_SHORT] and out[2].warnings == [I.SHORT]
    assert I.ingest(spark.createDataFrame(rows, schema).limit(0)).count() == 0
    best = spark.createDataFrame([([("a", "same text"), ("b", "same text"), ("c", "")],)], "c array<struct<method:string,text:string>>").select(L.best_candidate(F.col("c")).alias("b")).first().b
    assert best.method == "a"


def test_repaired_answers(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = set()
    for r in registry.QUERIES["repaired_answers"](spark, SF).collect():
        text = re.sub('[\x00-\x1f"\\\\]', " ", docs[r.doc_id])
        whole = {"id": r.doc_id, "parts": [{"text": text}, [1, 2], {"x": "y"}]}
        got = json.loads(r.json) if r.json else None
        seen.add(type(got))
        if r.doc_id % 7 == 0:
            assert got is None
        elif r.doc_id % 41 < 5:
            assert got == whole
        else:
            assert got is None or (got["id"] == r.doc_id and len(got["parts"]) <= 3)
    assert seen == {dict, type(None)}


def test_chunks_are_computed_once(spark):
    """The form, the sections and the chunks each stand once in the plan, however often they are named."""
    from tamarack.plans.corpus import chunk_overlap

    plan = chunk_overlap(spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("regexp_replace(") <= 15 and plan.toString().count("ArrowEvalPython") == 2


def test_extracted_texts_are_not_moved(spark):
    """A document's extracted texts stay in its row: no shuffle and no join chooses between them, and each is normalised once."""
    plan = I.ingest(I.example_items(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Repartition" not in plan and plan.count("ArrowEvalPython") == 3


def test_characters_are_counted_as_in_the_jvm(spark):
    import random

    r = random.Random(5)
    texts = ["".join(r.choice("aZ é�À‚−ກຽ่๑1½_-.,\n\t\u00a0\u2028𝐀😀") for _ in range(r.randint(0, 90))) for _ in range(200)] + ["", None, "x" * 12_050 + "ກ", " ", "ກ" * 12_000 + "."]
    df = spark.createDataFrame([(i, texts[i : i + 3]) for i in range(0, len(texts), 3)] + [(-1, None), (-2, [])], "id int, t array<string>").withColumn("c", N.character_counts("t"))
    both = df.select(F.explode(F.arrays_zip("t", "c")).alias("e")).select(L.quality_report(F.col("e.t")).alias("a"), L.quality_report(F.col("e.t"), F.col("e.c")).alias("b")).collect()
    assert len(both) == len(texts) and all(x.a == x.b for x in both)


def test_artifact_lines_with_allowed_and_odd_words(spark):
    lines = ["Article law", "Article lawx", "lawx Articley", "Lawx ກຂຄງຈຊຍດ lawy", "Lawx ກຂຄງຈຊຍ lawy", "law_x y_law abc", "PDF no page", "(ab)", "ab ກ", "12 | 3", ". . . . . . 4", "......... ກຂຄງຈຊຍດກຂຄງຈຊຍດກຂຄງຈຊຍດກຂຄງຈຊຍດກຂຄງຈຊຍດ x", "", "éab cd"]
    got = spark.createDataFrame(list(enumerate(lines)), "id int, t string").select("id", N.artifact_line(F.col("t")).alias("a")).collect()
    assert {lines[x.id]: x.a for x in got} == {x: plain_artifact(x) for x in lines}
