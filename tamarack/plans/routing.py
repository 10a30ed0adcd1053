"""Questions routed in three languages, with a match of plain keywords before the router; stored case memory in one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import table
from .assistant import MARKERS, any_of, route
from .registry import query

# Keywords that settle what a question is before anything else is looked at, in the order in which they are tried.
KEYWORDS = {
    "document_review": ["สัญญา", "contract", "clause", "agreement", "ข้อสัญญา", "ตรวจสัญญา", "เอกสาร", "document review", "หนังสือบริคณห์", "lease agreement", "ข้อตกลง"],
    "evidence_analysis": ["หลักฐาน", "evidence", "รูปภาพ", "เสียง", "audio", "video", "วิดีโอ", "screenshot", "อีเมล", "email", "พยาน", "witness", "ภาพถ่าย"],
    "case_strategy": ["กลยุทธ์", "strategy", "ชนะคดี", "win probability", "โอกาสชนะ", "ควรฟ้อง", "should i sue", "เจรจา", "settle", "ประนีประนอม", "แนวทาง", "approach", "วางแผน", "plan case"],
    "draft_document": ["ร่าง", "draft", "เขียน", "write", "หนังสือ", "notice", "จดหมาย", "letter", "สัญญาเช่า", "ใบมอบอำนาจ", "power of attorney", "บันทึกข้อตกลง", "mou", "สัญญาจ้าง"],
}
# What a legal question holds, what talk holds, and answers that are talk by themselves.
LEGAL_WORDS = [
    "ກົດໝາຍ", "ມາດຕາ", "ສິດ", "ທີ່ດິນ", "ດິນ", "ນໍາໃຊ້ດິນ", "ນຳໃຊ້ດິນ", "ສັນຍາ", "ຄະດີ", "ຟ້ອງ", "ຫຼັກຖານ", "ເອກະສານ", "ໂກງ", "ເສຍຫາຍ",
    "กฎหมาย", "มาตรา", "สิทธิ", "ที่ดิน", "สัญญา", "คดี", "ฟ้อง", "หลักฐาน", "เอกสาร", "โกง", "เสียหาย", "นายจ้าง", "ลูกจ้าง",
    "law", "legal", "article", "section", "right", "rights", "land", "contract", "case", "sue", "evidence", "document", "fraud", "damage", "employer", "employee",
]
TALK_WORDS = [
    "ສະບາຍດີ", "ສະບາຍດີບໍ", "ຂອບໃຈ", "ເຈົ້າແມ່ນໃຜ", "ຈື່ໄດ້ບໍ", "ສາມາດຊ່ວຍ", "สวัสดี", "สบายดี", "ขอบคุณ", "คุณคือใคร", "จำได้ไหม", "ทำอะไรได้บ้าง",
    "hello", "hi", "hey", "good morning", "good afternoon", "good evening", "how are you", "thanks", "thank you", "who are you", "what can you do", "remember",
]
SHORT_REPLIES = ["ok", "okay", "alright", "hi", "hey", "hello", "โอเค", "ครับ", "ค่ะ", "จ้า", "ໂອເຄ"]
WORDS = MARKERS | {"legal": LEGAL_WORDS, "conversation": TALK_WORDS}


def keyword_match(text: Column) -> Column:
    """The kind of question that the first keyword found settles; NULL for none."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.coalesce(*[F.when(any_of(low, words), F.lit(kind)) for kind, words in KEYWORDS.items()])


def routed(questions: DataFrame, text: str = "text", mode: str | None = None, markers: dict[str, list[str]] = WORDS) -> DataFrame:
    """questions with issue_type, query_type, use_rag and reason: the mode first, then keywords, then short answers, then the
    router's own rules over the markers of all languages."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    told = route(questions, text, mode, markers)
    forced = keyword_match(F.col(text))
    by_mode = F.col(mode).isin("evidence", "document") if mode else F.lit(False)
    short = low.isin(SHORT_REPLIES)
    told = told.withColumn("reason", F.when(by_mode, "mode").when(forced.isNotNull(), "keyword").when((low == "") | short, "short_reply").otherwise("markers"))
    kind = F.when(by_mode, F.col("query_type")).when(forced.isNotNull(), forced).when(short, "conversation").otherwise(F.col("query_type"))
    return told.withColumn("query_type", kind).withColumn("use_rag", ~F.col("query_type").isin("conversation", "clarification"))


def _truthy(item: Column, *paths: str) -> Column:
    """The first field of a JSON object that is neither absent, null nor empty, false or zero."""
    values = [F.get_json_object(item, f"$.{p}") for p in paths]
    return F.coalesce(*[F.when(~v.isin("", "false", "0", "0.0", "[]", "{}"), v) for v in values])


def irac_history(cases: DataFrame, key: str, history: str) -> DataFrame:
    """(key, place, id, query, conclusion, confidence, created_at) of stored analyses: history is a JSON array of objects in
    any of the shapes in use. The conclusion is the recommendation of `conclusion` if that is an object, else that of
    `irac_conclusion`, else what stands in `conclusion` itself or in `recommendation`. What isn't an object is left out,
    its place is not used again; what is no array holds nothing."""
    rows = cases.select(key, F.posexplode(F.from_json(history, "array<string>")).alias("place", "item"))
    rows = rows.where(F.startswith(F.trim("item"), F.lit("{")))
    item = F.col("item")
    own = F.get_json_object(item, "$.conclusion")
    plain = F.when(~F.startswith(F.coalesce(own, F.lit("")), F.lit("{")), own)
    told = F.when(F.startswith(F.coalesce(own, F.lit("")), F.lit("{")), _truthy(item, "conclusion.recommendation")).otherwise(_truthy(item, "irac_conclusion.recommendation"))
    none = F.lit("")
    return rows.select(
        key, "place", F.coalesce(_truthy(item, "id", "session_id"), F.concat(F.lit("irac-"), F.col("place").cast("string"))).alias("id"), F.coalesce(_truthy(item, "query", "question"), none).alias("query"),
        F.coalesce(told, F.nullif(plain, none), _truthy(item, "recommendation"), none).alias("conclusion"), F.get_json_object(item, "$.confidence").try_cast("double").alias("confidence"), _truthy(item, "created_at", "date", "ts").alias("created_at"),
    )


def timeline_type(value: Column) -> Column:
    """Kind of an event of a case."""
    low = F.lower(F.coalesce(F.nullif(value, F.lit("")), F.lit("query")))
    return F.when(F.contains(low, F.lit("evidence")), "evidence").when(F.contains(low, F.lit("document")) | F.contains(low, F.lit("draft")), "document").when(low.isin("milestone", "deadline", "hearing"), "milestone").otherwise("query")


def timeline(cases: DataFrame, key: str, events: str, sessions: DataFrame, history: DataFrame) -> DataFrame:
    """(key, id, event, date, type): the stored events of a case (a JSON array), its sessions (key, id, title, query_type,
    date), and of its history (irac_history) what neither of them has under its id."""
    stored = cases.select(key, F.posexplode(F.from_json(events, "array<string>")).alias("place", "item")).where(F.startswith(F.trim("item"), F.lit("{")))
    item = F.col("item")
    stored = stored.select(
        key, F.coalesce(_truthy(item, "id"), F.concat(F.lit("timeline-"), F.col("place").cast("string"))).alias("id"), F.coalesce(_truthy(item, "event", "title", "question"), F.lit("Case event")).alias("event"),
        _truthy(item, "date", "created_at", "ts").alias("date"), timeline_type(F.get_json_object(item, "$.type")).alias("type"),
    )
    talks = sessions.select(key, F.col("id").cast("string").alias("id"), F.coalesce(F.nullif("title", F.lit("")), F.lit("Legal chat")).alias("event"), F.col("date").cast("string").alias("date"), timeline_type(F.col("query_type")).alias("type"))
    known = stored.unionByName(talks)
    more = history.join(known.select(key, "id").distinct(), [key, "id"], "left_anti")
    return known.unionByName(more.select(key, "id", F.coalesce(F.nullif("query", F.lit("")), F.lit("IRAC analysis")).alias("event"), F.col("created_at").alias("date"), F.lit("query").alias("type")))


_ANY = lambda words: "regexp_matches(t, '" + "|".join(words) + "')"
_HAS = {k: _ANY(v) for k, v in WORDS.items()}


@query(f"""
WITH q AS (SELECT conv_id, turn, turn % 7 AS m, lower(trim(CASE (conv_id + turn) % 8 WHEN 0 THEN 'ສະບາຍດີ ' WHEN 1 THEN 'ร่างหนังสือ ' WHEN 2 THEN 'what should i do, i was cheated ' WHEN 3 THEN 'ທີ່ດິນ ' WHEN 4 THEN 'ok' WHEN 5 THEN 'should i sue ' WHEN 6 THEN 'สวัสดี hello ' ELSE '' END
  || CASE WHEN (conv_id + turn) % 8 = 4 THEN '' ELSE text END)) AS t FROM conversations WHERE role = 'user'),
i AS (SELECT *, CASE WHEN {_HAS["statute"]} THEN 'statute_lookup' WHEN {_HAS["rights"]} THEN 'rights_explanation' WHEN {_HAS["draft"]} THEN 'draft_document' WHEN {_HAS["evidence"]} THEN 'evidence_analysis' WHEN {_HAS["document"]} THEN 'document_review'
  WHEN {_HAS["strategy"]} THEN 'case_strategy' WHEN {_HAS["procedure"]} THEN 'procedure' END AS issue_type,
  CASE WHEN {_ANY(KEYWORDS["document_review"])} THEN 'document_review' WHEN {_ANY(KEYWORDS["evidence_analysis"])} THEN 'evidence_analysis' WHEN {_ANY(KEYWORDS["case_strategy"])} THEN 'case_strategy' WHEN {_ANY(KEYWORDS["draft_document"])} THEN 'draft_document' END AS forced FROM q),
r AS (SELECT *, CASE WHEN m = 1 THEN 'evidence_analysis' WHEN m = 2 THEN 'document_review' WHEN forced IS NOT NULL THEN forced WHEN t IN ({", ".join(f"'{x}'" for x in SHORT_REPLIES)}, '') THEN 'conversation'
  WHEN {_HAS["conversation"]} AND NOT {_HAS["legal"]} AND issue_type IS NULL THEN 'conversation'
  WHEN ({_HAS["personal"]} OR {_HAS["harm"]}) AND (coalesce(issue_type, '') IN ('procedure', 'case_strategy') OR {_HAS["procedure"]}) AND length(t) < 120 AND NOT regexp_matches(t, '[0-9]') AND NOT {_HAS["statute"]} THEN 'clarification'
  WHEN issue_type IN ('document_review', 'evidence_analysis', 'draft_document', 'case_strategy') THEN issue_type ELSE 'legal_question' END AS query_type FROM i)
SELECT conv_id, turn, issue_type, query_type, query_type NOT IN ('conversation', 'clarification') AS use_rag,
  CASE WHEN m IN (1, 2) THEN 'mode' WHEN forced IS NOT NULL THEN 'keyword' WHEN t IN ({", ".join(f"'{x}'" for x in SHORT_REPLIES)}, '') THEN 'short_reply' ELSE 'markers' END AS reason FROM r""")
def routed_questions(spark, sf_dir):
    """Modes, keywords and markers in Lao, Thai and English."""
    n = (F.col("conv_id") + F.col("turn")) % 8
    lead = {0: "ສະບາຍດີ ", 1: "ร่างหนังสือ ", 2: "what should i do, i was cheated ", 3: "ທີ່ດິນ ", 4: "ok", 5: "should i sue ", 6: "สวัสดี hello ", 7: ""}
    text = F.concat(F.coalesce(*[F.when(n == k, F.lit(v)) for k, v in lead.items()]), F.when(n == 4, "").otherwise(F.col("text")))
    mode = F.when(F.col("turn") % 7 == 1, "evidence").when(F.col("turn") % 7 == 2, "document").otherwise("general")
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", text.alias("text"), mode.alias("mode"))
    return routed(rows, "text", "mode").select("conv_id", "turn", "issue_type", "query_type", "use_rag", "reason")


def _memory(spark, sf_dir) -> DataFrame:
    """Conversations as case memory: their assistant's turns as analyses in the shapes in use, as JSON."""
    n, turn, text = F.col("turn") % 4, F.col("turn").cast("string"), F.col("text")
    none = F.lit(None).cast("string")
    say = lambda k, v: F.when(n == k, v)
    item = F.struct(
        say(0, F.concat(F.lit("h"), turn)).alias("id"), say(1, F.concat(F.lit("s"), turn)).alias("session_id"), F.when(n < 2, F.left(text, F.lit(20))).otherwise("").alias("query"), say(2, text).alias("question"),
        F.when(n == 0, F.struct(F.concat(F.lit("do "), turn).alias("recommendation"))).alias("irac_conclusion"), say(1, F.lit("plain")).alias("conclusion"), say(2, F.lit("else")).alias("recommendation"),
        (F.col("turn") / 10).alias("confidence"), say(3, F.lit("2024-01-03")).alias("ts"), F.when(n != 3, "2024-01-02").alias("date"), none.alias("created_at"),
    )
    a = table(spark, sf_dir, "conversations").where("role = 'assistant' and text is not null")
    return a.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))), lambda x: x["item"])).alias("history"))


@query("""
WITH a AS (SELECT conv_id, turn, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS place FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)
SELECT conv_id, place, CASE turn % 4 WHEN 0 THEN 'h' || turn WHEN 1 THEN 's' || turn ELSE 'irac-' || place END AS id, CASE WHEN turn % 4 < 2 THEN left(text, 20) WHEN turn % 4 = 2 THEN text ELSE '' END AS query,
  CASE turn % 4 WHEN 0 THEN 'do ' || turn WHEN 1 THEN 'plain' WHEN 2 THEN 'else' ELSE '' END AS conclusion, turn / 10.0::DOUBLE AS confidence, CASE WHEN turn % 4 = 3 THEN '2024-01-03' ELSE '2024-01-02' END AS created_at FROM a""")
def irac_histories(spark, sf_dir):
    """Stored analyses of a case in one shape."""
    return irac_history(_memory(spark, sf_dir), "conv_id", "history")


@query("""
WITH a AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
h AS (SELECT conv_id, CASE turn % 4 WHEN 0 THEN 'h' || turn WHEN 1 THEN 's' || turn ELSE 'irac-' || place END AS id, CASE WHEN turn % 4 < 2 THEN left(text, 20) WHEN turn % 4 = 2 THEN text ELSE '' END AS q, CASE WHEN turn % 4 = 3 THEN '2024-01-03' ELSE '2024-01-02' END AS d FROM a),
c AS (SELECT DISTINCT conv_id FROM a),
e AS (SELECT conv_id, 'h4' AS id, 'Filed' AS event, '2024-01-01' AS date, 'document' AS type FROM c UNION ALL SELECT conv_id, 'timeline-2', 'Case event', '2024-02-01', 'milestone' FROM c),
s AS (SELECT conv_id, 's' || min(turn) AS id, 'Legal chat' AS event, '2024-03-01' AS date, 'evidence' AS type FROM conversations GROUP BY conv_id)
SELECT * FROM e UNION ALL SELECT * FROM s UNION ALL
SELECT h.conv_id, h.id, CASE WHEN q = '' THEN 'IRAC analysis' ELSE q END, d, 'query' FROM h WHERE NOT EXISTS (SELECT 1 FROM (SELECT conv_id, id FROM e UNION ALL SELECT conv_id, id FROM s) k WHERE k.conv_id = h.conv_id AND k.id = h.id)""")
def case_timelines(spark, sf_dir):
    """R23 over stored JSON: events, sessions, and what the history adds."""
    cases = _memory(spark, sf_dir)
    events = F.lit('[{"id": "h4", "event": "Filed", "date": "2024-01-01", "type": "Draft document"}, "no object", {"id": "", "title": null, "ts": "2024-02-01", "type": "Hearing"}]')
    sessions = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit("s"), F.min("turn").cast("string")).alias("id"))
    sessions = sessions.select("conv_id", "id", F.lit("").alias("title"), F.lit("evidence_analysis").alias("query_type"), F.lit("2024-03-01").alias("date"))
    return timeline(cases.withColumn("events", events), "conv_id", "events", sessions, irac_history(cases, "conv_id", "history"))
