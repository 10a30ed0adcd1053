"""Upkeep of records: statuses and types as the rest of the system has them, probing updates, append-only logs, touched
rows, citations of answers, and memories merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import legal_text as L
from ..operators.scans import insert_missing
from ..tables import table
from .registry import query

# What is normalised to what. MEMBERS: by the whole value; HOLDING: by a part of it, the first that fits.
CASE_STATUS = {"active": ["open", "active"], "settled": ["settled", "resolved"], "closed": ["closed", "archived", "dismissed"]}
UI_STATUS = {"indexed": ["active", "indexed"], "archived": ["repealed", "archived"], "processing": ["processing"]}
CATEGORIES = ["case_law", "statute", "regulation", "form", "contract", "evidence"]
OUTCOMES = {"defendant_won": ["defendant"], "dismissed": ["dismiss"], "settled": ["settle"], "partial": ["partial"], "plaintiff_won": ["plaintiff"]}
EVIDENCE_TYPES = {"audio": ["audio"], "video": ["video"], "email": ["email"], "image": ["image", ".png", ".jpg", ".jpeg"], "document_word": ["word", ".doc"], "contract": ["contract"]}
FILE_CLASSES = {"image": ["image", "jpeg", "png", "webp", "gif"], "audio": ["audio", "mpeg", "wav", "mp4", "ogg", "m4a"]}
MIME_BY_SUFFIX = {
    "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain", "csv": "text/csv",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "mp3": "audio/mpeg", "wav": "audio/wav", "mp4": "video/mp4", "zip": "application/zip",
}
MIME_ALIASES = {"audio/x-wav": "audio/wav", "application/x-zip-compressed": "application/zip"}
ESCALATION_PREFIX = "Escalated for expert review:"


def by_member(value: Column, sets: dict[str, list[str]], otherwise: str) -> Column:
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.coalesce(*[F.when(low.isin(members), F.lit(label)) for label, members in sets.items()], F.lit(otherwise))


def by_part(value: Column, parts: dict[str, list[str]], otherwise: str) -> Column:
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.coalesce(*[F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(label)) for label, words in parts.items()], F.lit(otherwise))


def case_status(value: Column) -> Column:
    return by_member(value, CASE_STATUS, "active")


def document_category(value: Column) -> Column:
    return by_member(value, {c: [c] for c in CATEGORIES}, "contract")


def timeline_type(value: Column) -> Column:
    milestone = F.when(F.lower(value).isin("milestone", "deadline", "hearing"), "milestone")
    return F.coalesce(F.nullif(by_part(value, {"evidence": ["evidence"], "document": ["document", "draft"]}, ""), F.lit("")), milestone, F.lit("query"))


def upload_mime(content_type: Column, file_name: Column) -> Column:
    """The content type without parameters; by the file's suffix where it is missing or says nothing."""
    mime = F.lower(F.trim(F.element_at(F.split(F.coalesce(content_type, F.lit("")), ";"), 1)))
    vague = mime.isin("", "application/octet-stream")
    suffix = F.regexp_extract(F.lower(file_name), r"\.([^.]*)$", 1)
    told = F.coalesce(*[F.when(suffix == s, F.lit(m)) for s, m in MIME_BY_SUFFIX.items()], F.when(mime == "", "application/octet-stream").otherwise(mime))
    out = F.when(vague, told).otherwise(mime)
    return F.coalesce(*[F.when(out == a, F.lit(m)) for a, m in MIME_ALIASES.items()], out)


def internal_message(role: Column, reason: Column, content: Column) -> Column:
    """Whether a message only tells the experts that an answer was escalated."""
    return F.coalesce((role == "assistant") & (reason != "") & content.startswith(ESCALATION_PREFIX), F.lit(False))


def probed_update(tables: dict[str, DataFrame], changes: DataFrame, key: str) -> DataFrame:
    """For each change the table that its key is found in first (tables in their order) and its status: updated, or
    not_found with no table."""
    places = None
    for i, (name, rows) in enumerate(tables.items()):
        own = rows.select(key, F.lit(i).alias("place"), F.lit(name).alias("source_table"))
        places = own if places is None else places.union(own)
    hits = places.join(changes.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.min(F.struct("place", "source_table")).alias("first"))
    return changes.join(hits, key, "left").select(*changes.columns, F.col("first.source_table").alias("source_table"), F.when(F.col("first").isNull(), "not_found").otherwise("updated").alias("status"))


def appended(log: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """An append-only log with new rows: what is in the log stays as it is, rows with a key that it has are refused."""
    return log.unionByName(insert_missing(log, rows, [key]))


def touched(df: DataFrame, changes: DataFrame, key: str, fields: list[str], now: Column, stamp: str = "updated_at") -> DataFrame:
    """df with changes (key and fields; NULL: no change) written, and `stamp` set on the rows that have one."""
    told = df.join(changes.select(key, F.lit(True).alias("_hit"), *[F.col(f).alias(f"_{f}") for f in fields]), key, "left")
    out = told.withColumns({**{f: F.coalesce(f"_{f}", f) for f in fields}, stamp: F.when(F.col("_hit"), now).otherwise(F.col(stamp))})
    return out.select(*df.columns)


def answer_citations(answers: DataFrame, id: str = "id") -> DataFrame:
    """(id, place, ref, status, year, note) of answers (id, explicit, statutes, precedents): the explicit ones if there
    are any, else statutes by name and section, then precedents by case number; of equal ones (letter case aside) the
    first."""
    made = F.concat(
        F.transform("statutes", lambda s: F.struct(F.trim(F.concat_ws(" ", F.nullif(F.trim(s["name"]), F.lit("")), F.nullif(F.trim(s["section"]), F.lit("")))).alias("ref"), s["year"].alias("year"), F.lit(None).cast("string").alias("note"))),
        F.transform("precedents", lambda p: F.struct(F.trim(F.coalesce(p["case_no"], F.lit(""))).alias("ref"), F.lit(None).cast("int").alias("year"), p["court"].alias("note"))),
    )
    made = F.filter(F.coalesce(made, F.array().cast("array<struct<ref:string,year:int,note:string>>")), lambda c: c["ref"] != "")
    once = F.filter(made, lambda c, i: ~F.exists(F.slice(made, 1, i), lambda b: F.lower(b["ref"]) == F.lower(c["ref"])))
    made = F.transform(once, lambda c: F.struct(c["ref"].alias("ref"), F.lit("UNVERIFIED").alias("status"), c["year"].alias("year"), c["note"].alias("note")))
    given = F.transform("explicit", lambda r: F.struct(r.alias("ref"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("note")))
    return answers.select(id, F.posexplode(F.when(F.size("explicit") > 0, given).otherwise(made)).alias("place", "c")).select(id, F.col("place").cast("long").alias("place"), "c.*")


def merged_memory(cases: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """Case memory (key, facts_summary, key_citations) with session memory (key, summary, message_count): the session's
    summary stands in where there are no facts, and a hash tells whether anything changed."""
    both = cases.join(sessions, key, "full")
    facts = F.coalesce(F.nullif("facts_summary", F.lit("")), "summary")
    out = both.select(key, facts.alias("facts_summary"), F.col("summary").alias("conversation_summary"), "key_citations", F.col("message_count").alias("session_message_count"))
    told = F.to_json(F.struct("conversation_summary", "facts_summary", "key_citations", "session_message_count"), {"ignoreNullFields": "false"})
    return out.withColumn("memory_hash", F.sha2(told.cast("binary"), 256))


def contextual_question(question: Column, summary: Column) -> Column:
    """A question with what was said before, for retrieval only."""
    before = F.trim(F.coalesce(summary, F.lit("")))
    told = F.concat(F.lit("Conversation context for retrieval only:\n"), F.substring(before, 1, 1800), F.lit("\n\nCurrent user question:\n"), question)
    return F.when(before == "", question).otherwise(told)


_WORD = "CASE (event_id % 9) WHEN 0 THEN 'OPEN' WHEN 1 THEN 'Resolved' WHEN 2 THEN 'dismissed' WHEN 3 THEN 'Defendant settled' WHEN 4 THEN 'partial, plaintiff' WHEN 5 THEN 'case_law' WHEN 6 THEN 'Draft email .png' WHEN 7 THEN 'hearing' END"


@query(f"""
WITH e AS (SELECT event_id, {_WORD} AS w, lower(coalesce({_WORD}, '')) AS l FROM events)
SELECT event_id, CASE WHEN l IN ('open', 'active') THEN 'active' WHEN l IN ('settled', 'resolved') THEN 'settled' WHEN l IN ('closed', 'archived', 'dismissed') THEN 'closed' ELSE 'active' END AS case_status,
  CASE WHEN contains(l, 'defendant') THEN 'defendant_won' WHEN contains(l, 'dismiss') THEN 'dismissed' WHEN contains(l, 'settle') THEN 'settled' WHEN contains(l, 'partial') THEN 'partial' WHEN contains(l, 'plaintiff') THEN 'plaintiff_won' ELSE 'unknown' END AS outcome,
  CASE WHEN l IN ('case_law', 'statute', 'regulation', 'form', 'contract', 'evidence') THEN l ELSE 'contract' END AS category,
  CASE WHEN contains(l, 'audio') THEN 'audio' WHEN contains(l, 'video') THEN 'video' WHEN contains(l, 'email') THEN 'email' WHEN contains(l, 'image') OR contains(l, '.png') OR contains(l, '.jpg') OR contains(l, '.jpeg') THEN 'image'
    WHEN contains(l, 'word') OR contains(l, '.doc') THEN 'document_word' WHEN contains(l, 'contract') THEN 'contract' ELSE 'document_pdf' END AS evidence_type,
  CASE WHEN contains(l, 'evidence') THEN 'evidence' WHEN contains(l, 'document') OR contains(l, 'draft') THEN 'document' WHEN l IN ('milestone', 'deadline', 'hearing') THEN 'milestone' ELSE 'query' END AS timeline_type,
  CASE WHEN l IN ('active', 'indexed') THEN 'indexed' WHEN l IN ('repealed', 'archived') THEN 'archived' WHEN l = 'processing' THEN 'processing' ELSE 'draft' END AS ui_status FROM e""")
def normalised_labels(spark, sf_dir):
    """Statuses, outcomes, categories and types from free words."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_WORD).alias("w"))
    w = F.col("w")
    return e.select(
        "event_id", case_status(w).alias("case_status"), by_part(w, OUTCOMES, "unknown").alias("outcome"), document_category(w).alias("category"),
        by_part(w, EVIDENCE_TYPES, "document_pdf").alias("evidence_type"), timeline_type(w).alias("timeline_type"), by_member(w, UI_STATUS, "draft").alias("ui_status"),
    )


@query(r"""
WITH m AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Application/PDF; charset=x' WHEN 1 THEN 'application/octet-stream' WHEN 2 THEN 'audio/x-wav' END AS t, 'x.' || ['pdf', 'WAV', 'odd', 'docx', 'jpeg'][page_id % 5 + 1] AS f FROM pages),
b AS (SELECT page_id, lower(trim(split_part(coalesce(t, ''), ';', 1))) AS m, lower(split_part(f, '.', 2)) AS s FROM m),
u AS (SELECT page_id, CASE WHEN m IN ('', 'application/octet-stream') THEN CASE s WHEN 'pdf' THEN 'application/pdf' WHEN 'wav' THEN 'audio/wav' WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 'jpeg' THEN 'image/jpeg' ELSE 'application/octet-stream' END
  WHEN m = 'audio/x-wav' THEN 'audio/wav' ELSE m END AS mime FROM b)
SELECT page_id, mime, CASE WHEN regexp_matches(mime, 'image|jpeg|png|webp|gif') THEN 'image' WHEN regexp_matches(mime, 'audio|mpeg|wav|mp4|ogg|m4a') THEN 'audio' ELSE 'text' END AS file_class FROM u""")
def upload_mimes(spark, sf_dir):
    """Content types of uploads and the class that analyses them."""
    n = F.col("page_id")
    declared = F.when(n % 4 == 0, "Application/PDF; charset=x").when(n % 4 == 1, "application/octet-stream").when(n % 4 == 2, "audio/x-wav")
    name = F.concat(F.lit("x."), F.get(F.array(*map(F.lit, ["pdf", "WAV", "odd", "docx", "jpeg"])), (n % 5).cast("int")))
    out = table(spark, sf_dir, "pages").select("page_id", upload_mime(declared, name).alias("mime"))
    return out.withColumn("file_class", by_part(F.col("mime"), FILE_CLASSES, "text"))


@query("""
SELECT conv_id, turn FROM conversations WHERE NOT (role = 'assistant' AND turn % 3 <> 0 AND turn % 2 = 1)""")
def shown_messages(spark, sf_dir):
    """Messages without those for experts only."""
    n = F.col("turn")
    m = table(spark, sf_dir, "conversations").withColumns({"reason": F.when(n % 3 != 0, "low confidence").otherwise(""), "content": F.when(n % 2 == 1, F.concat(F.lit(ESCALATION_PREFIX + " "), "text")).otherwise(F.col("text"))})
    return m.where(~internal_message(F.col("role"), F.col("reason"), F.col("content"))).select("conv_id", "turn")


@query("""
WITH c AS (SELECT DISTINCT user_id AS id FROM events),
p AS (SELECT id, min(place) AS place FROM (SELECT n_nationkey AS id, 0 AS place FROM nation UNION ALL SELECT s_suppkey, 1 FROM supplier UNION ALL SELECT item_id, 2 FROM benchmark) GROUP BY id)
SELECT c.id, CASE place WHEN 0 THEN 'laws' WHEN 1 THEN 'cases' WHEN 2 THEN 'legal_forms' END AS source_table, CASE WHEN place IS NULL THEN 'not_found' ELSE 'updated' END AS status FROM c LEFT JOIN p ON p.id = c.id""")
def probing_update(spark, sf_dir):
    """The same id tried in three tables, the first that has it is updated."""
    tables = {"laws": table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")), "cases": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), "legal_forms": table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))}
    return probed_update(tables, table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct(), "id")


@query("""
SELECT event_id, event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'new' FROM events WHERE event_id % 3 = 0 AND event_id % 2 <> 0""")
def append_only_log(spark, sf_dir):
    """K4: a log takes new rows only; what it has can't be overwritten."""
    e = table(spark, sf_dir, "events")
    log, rows = e.where("event_id % 2 = 0").select("event_id", "event_type"), e.where("event_id % 3 = 0").select("event_id", F.lit("new").alias("event_type"))
    return appended(log, rows, "event_id")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment, strftime(CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END, '%Y-%m-%d') AS updated_at FROM customer""")
def touched_rows(spark, sf_dir):
    """K5: written rows carry the time of writing."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lit("2024-01-01").cast("date").alias("updated_at"))
    changes = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "MOVED").alias("c_mktsegment"))
    out = touched(c, changes, "c_custkey", ["c_mktsegment"], F.lit("2024-02-01").cast("date"))
    return out.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd"))


@query("""
WITH s AS (SELECT o_orderkey AS id, [{'ref': trim('Law ' || o_orderstatus || ' Art. ' || (o_orderkey % 5)), 'year': 2000 + o_orderkey % 20, 'note': NULL}, {'ref': 'LAW ' || o_orderstatus || ' art. ' || (o_orderkey % 2), 'year': NULL, 'note': NULL}] || CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE [{'ref': 'Case ' || (o_orderkey % 7), 'year': NULL, 'note': 'Supreme'}] END AS c FROM orders WHERE o_orderkey % 10 <> 0),
u AS (SELECT id, unnest(c, recursive := true), generate_subscripts(c, 1) AS i FROM s),
d AS (SELECT *, row_number() OVER (PARTITION BY id, lower(ref) ORDER BY i) AS rn FROM u)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS place, ref, 'UNVERIFIED' AS status, year::INT AS year, note FROM d WHERE rn = 1
UNION ALL SELECT o_orderkey, 0, 'ref ' || o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderkey % 10 = 0""")
def citations_of_answers(spark, sf_dir):
    """Citations of structured answers, once each."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    none = F.lit(None).cast("int")
    statutes = F.array(
        F.struct(F.concat(F.lit("Law "), status).alias("name"), F.concat(F.lit(" Art. "), (k % 5).cast("string")).alias("section"), (k % 20 + 2000).cast("int").alias("year")),
        F.struct(F.concat(F.lit("LAW "), status, F.lit(" ")).alias("name"), F.concat(F.lit("art. "), (k % 2).cast("string")).alias("section"), none.alias("year")),
    )
    precedents = F.array(F.struct(F.when(k % 3 != 0, F.concat(F.lit("Case "), (k % 7).cast("string"))).alias("case_no"), F.lit("Supreme").alias("court")))
    explicit = F.when(k % 10 == 0, F.array(F.concat(F.lit("ref "), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    return answer_citations(table(spark, sf_dir, "orders").select(k.alias("id"), explicit.alias("explicit"), statutes.alias("statutes"), precedents.alias("precedents")))


@query("""
WITH c AS (SELECT DISTINCT user_id AS id, CASE WHEN user_id % 2 = 0 THEN 'facts ' || user_id ELSE '' END AS facts FROM events),
s AS (SELECT conv_id AS id, 'talk of ' || count(*) AS summary, count(*) AS n FROM conversations GROUP BY 1)
SELECT coalesce(c.id, s.id) AS id, coalesce(nullif(facts, ''), summary) AS facts_summary, n AS session_message_count,
  CASE WHEN summary IS NULL THEN 'Why?' ELSE 'Conversation context for retrieval only:' || chr(10) || summary || chr(10) || chr(10) || 'Current user question:' || chr(10) || 'Why?' END AS question FROM c FULL JOIN s ON c.id = s.id""")
def merged_memories(spark, sf_dir):
    """Case memory and session memory as one, and the question that they give context to."""
    user = F.col("user_id")
    cases = table(spark, sf_dir, "events").select(user.alias("id"), F.when(user % 2 == 0, F.concat(F.lit("facts "), user.cast("string"))).otherwise("").alias("facts_summary"), F.array(F.lit("ref")).alias("key_citations")).distinct()
    talks = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.concat(F.lit("talk of "), F.count("*").cast("string")).alias("summary"), F.count("*").alias("message_count"))
    out = merged_memory(cases, talks, "id")
    return out.select("id", "facts_summary", "session_message_count", contextual_question(F.lit("Why?"), F.col("conversation_summary")).alias("question"))


@query("""
WITH s AS (SELECT l_orderkey AS id, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_returnflag = 'N') AS v FROM lineitem GROUP BY 1)
SELECT id, round(r / n, 6) AS rejection_rate, v = n AS all_verified, round(greatest(0, 1 - 2 * r / n), 6) AS confidence FROM s""")
def verification_summary(spark, sf_dir):
    """Rejection rate, whether all is verified, confidence."""
    flag = F.col("l_returnflag")
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.avg((flag == "R").cast("double")).alias("rate"), F.every(flag == "N").alias("all_verified"))
    return s.select("id", F.round("rate", 6).alias("rejection_rate"), "all_verified", F.round(F.greatest(F.lit(0.0), 1 - F.col("rate") * 2), 6).alias("confidence"))


@query("""
WITH r AS (SELECT length(text) % 100 / 100.0::DOUBLE AS confidence, contains(text, 'the') AS cited, length(text) % 3 < 2 AS grounded FROM conversations WHERE role = 'assistant'),
s AS (SELECT *, cited AND grounded AND CASE WHEN cited THEN confidence >= 0.55 ELSE confidence <= 0.5 END AS passed FROM r)
SELECT count(*) AS cases, count(*) FILTER (WHERE passed) AS passed, round(count(*) FILTER (WHERE cited) / count(*), 4) AS citation_pass_rate, round(avg(confidence), 3) AS avg_confidence FROM s""")
def qa_run(spark, sf_dir):
    """An evaluation run in one row."""
    from .corpus import qa_score

    n = F.char_length("text")
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").agg(F.count("*").alias("cases"), F.round(F.avg(n % 100 / 100), 3).alias("avg_confidence"))
    passed = qa_score(spark, sf_dir).agg(F.count_if("passed").alias("passed"), F.round(F.count_if("cited") / F.count("*"), 4).alias("citation_pass_rate"))
    return rows.crossJoin(passed)  # one row by one row


@query("""
WITH v AS (SELECT event_id, user_id, CASE WHEN value > 50 THEN value / 500 END AS d FROM events),
r AS (SELECT *, row_number() OVER (ORDER BY coalesce(d, 1.0), event_id) AS rk FROM v ORDER BY coalesce(d, 1.0), event_id LIMIT 50)
SELECT event_id, rk FROM r""")
def distance_or_one(spark, sf_dir):
    """The older branch's order: by distance, rows without an embedding at distance 1; fifty rows."""
    from ..operators.windows import ranked_top

    e = table(spark, sf_dir, "events").select("event_id", F.coalesce(F.when(F.col("value") > 50, F.col("value") / 500), F.lit(1.0)).alias("d"))
    return ranked_top(e, [F.col("d"), F.col("event_id")], 50, "rk").select("event_id", "rk")


@query("""
WITH r AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rk FROM documents)
SELECT source, min(rk) FILTER (WHERE lang = 'de' AND rk <= 10) AS rank FROM r GROUP BY source""")
def first_match_in_results(spark, sf_dir):
    """Rank of the first match among the ten first results of each question (here: source)."""
    d = table(spark, sf_dir, "documents").select("source", "lang", "n_chars", "doc_id")
    top = d.withColumn("rk", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).cast("long")).where("rk <= 10")
    return top.groupBy("source").agg(F.min(F.when(F.col("lang") == "de", F.col("rk"))).alias("rank"))


@query("""
WITH s AS (SELECT unnest(['research', 'reasoning', 'verification']) AS agent, unnest([['click', 'search'], ['purchase'], ['error', 'signup']]) AS tokens),
m AS (SELECT agent, event_id, ts, value, event_type = 'error' AS failed FROM events JOIN s ON list_contains(tokens, event_type))
SELECT agent, count(event_id) AS calls, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30') AS last_day, count(*) FILTER (WHERE failed) AS errors, round(100 * (1 - count(*) FILTER (WHERE failed) / count(event_id)), 1) AS success FROM m GROUP BY agent""")
def agent_status_by_tokens(spark, sf_dir):
    """Calls of each agent, rows matched by the agent's token set."""
    specs = spark.createDataFrame([("research", ["click", "search"]), ("reasoning", ["purchase"]), ("verification", ["error", "signup"])], "agent string, tokens array<string>")
    spec = specs.select("agent", F.explode("tokens").alias("event_type"))
    m = table(spark, sf_dir, "events").join(F.broadcast(spec), "event_type")  # five rows
    failed = F.count_if(F.col("event_type") == "error")
    return m.groupBy("agent").agg(
        F.count("*").alias("calls"), F.count_if(F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz")).alias("last_day"), failed.alias("errors"),
        F.round((1 - failed / F.count("*")) * 100, 1).alias("success"),
    )


# Paths that share one rate scope, limits a minute by path, the usual limit, and the least of admins and of
# their uploads.
RATE_SCOPES = {"/api/v1/legal/sessions": "/api/v1/legal/sessions", "/api/v1/memory/case/": "/api/v1/memory/case", "/api/v1/admin/": "/api/v1/admin"}
RATE_LIMITS = {"/api/v1/legal/query": 20, "/api/v1/legal/query/stream": 10, "/api/v1/documents/analyze": 5, "/api/v1/evidence/analyze": 5}
USUAL_LIMIT, ADMIN_LIMIT, UPLOAD_LIMIT = 30, 120, 30


def rate_scope(path: Column) -> Column:
    return F.coalesce(*[F.when(path.startswith(start), F.lit(scope)) for start, scope in RATE_SCOPES.items()], path)


def rate_limit(path: Column) -> Column:
    """Requests a minute for a path."""
    limit = F.coalesce(*[F.when(path == p, F.lit(n)) for p, n in RATE_LIMITS.items()], F.lit(USUAL_LIMIT))
    admin = F.greatest(limit, F.when(path.endswith("/upload"), UPLOAD_LIMIT).otherwise(ADMIN_LIMIT))
    return F.when(path.startswith("/api/v1/admin/"), admin).otherwise(limit)


def allowed_record(tenant_id, client_id) -> Column:
    """Whether a record of case memory may be read: of the reader's tenant and client or of none; what the reader has not
    is not asked for."""
    own = lambda column, value: F.lit(True) if value is None else F.col(column).isNull() | (F.col(column) == F.lit(value))
    return own("tenant_id", tenant_id) & own("client_id", client_id)


def metadata_value(metadata: Column, *names: str) -> Column:
    """The first of the names that a JSON object has a value for."""
    return F.coalesce(*[F.get_json_object(metadata, f"$.{n}") for n in names])


_PATHS = ["/api/v1/legal/query", "/api/v1/legal/sessions/77/messages", "/api/v1/admin/documents/upload", "/api/v1/admin/kpis", "/api/v1/memory/case/9", "/api/v1/evidence/analyze", "/health2"]


@query(f"""
WITH e AS (SELECT user_id, date_trunc('hour', ts) AS h, {_PATHS}[event_id % 7 + 1] AS p FROM events),
s AS (SELECT *, CASE WHEN starts_with(p, '/api/v1/legal/sessions') THEN '/api/v1/legal/sessions' WHEN starts_with(p, '/api/v1/memory/case/') THEN '/api/v1/memory/case' WHEN starts_with(p, '/api/v1/admin/') THEN '/api/v1/admin' ELSE p END AS scope,
  CASE WHEN starts_with(p, '/api/v1/admin/') THEN CASE WHEN ends_with(p, '/upload') THEN 30 ELSE 120 END WHEN p = '/api/v1/legal/query' THEN 20 WHEN p = '/api/v1/evidence/analyze' THEN 5 ELSE 30 END AS l FROM e)
SELECT user_id, strftime(h, '%Y-%m-%d %H') AS hour, scope, count(*) AS n, min(l) AS least_limit, count(*) > min(l) AS over FROM s GROUP BY 1, 2, 3""")
def rate_scopes(spark, sf_dir):
    """K9: requests by client, scope and window against the limits of their paths."""
    path = F.get(F.array(*map(F.lit, _PATHS)), (F.col("event_id") % 7).cast("int"))
    e = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), rate_scope(path).alias("scope"), rate_limit(path).alias("limit"))
    out = e.groupBy("user_id", "hour", "scope").agg(F.count("*").alias("n"), F.min("limit").alias("least_limit"))
    return out.withColumn("over", F.col("n") > F.col("least_limit"))


@query("""
SELECT event_id FROM (SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN user_id % 3 END AS t, CASE WHEN event_id % 4 <> 0 THEN event_id % 4 END AS c FROM events) WHERE (t IS NULL OR t = 1) AND (c IS NULL OR c = 2)""")
def allowed_records(spark, sf_dir):
    """P20: records of one's tenant and client or of none."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 3).alias("tenant_id"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 4).alias("client_id"))
    return e.where(allowed_record(1, 2)).select("event_id")


@query("""
SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, json_extract_string(props, '$.article'), json_extract_string(props, '$.k')) AS section, coalesce(json_extract_string(props, '$.review_status'), 'approved') AS review_status FROM events""")
def fallback_chain(spark, sf_dir):
    """A column, else fields of its metadata, else a default."""
    section = F.coalesce(F.when(F.col("event_id") % 3 == 0, F.col("event_type")), metadata_value(F.col("props"), "article", "k"))
    return table(spark, sf_dir, "events").select("event_id", section.alias("section"), F.coalesce(metadata_value(F.col("props"), "review_status"), F.lit("approved")).alias("review_status"))


@query("""
SELECT doc_id, regexp_matches(lower(concat_ws(' ', CASE WHEN doc_id % 4 = 0 THEN 'laws' WHEN doc_id % 4 = 1 THEN 'cases' END, source, CASE doc_id % 3 WHEN 0 THEN 'ມາດຕາ ' || doc_id WHEN 1 THEN 'Art. 5' END)), 'law|statute|regulation|decree|article|ກົດໝາຍ|ມາດຕາ|ດຳລັດ|กฎหมาย|มาตรา') AS covers,
  regexp_matches(lower(concat_ws(' ', source, CASE doc_id % 3 WHEN 0 THEN 'ມາດຕາ ' || doc_id WHEN 1 THEN 'Art. 5' END)), 'law|statute|act|code|decree|regulation|article|ມາດຕາ|มาตรา|ກົດໝາຍ') AS title_like FROM documents""")
def statute_tests(spark, sf_dir):
    """Both tests of statutes: coverage's over all labels, retrieval's over title and section."""
    n = F.col("doc_id")
    kind, section = F.when(n % 4 == 0, "laws").when(n % 4 == 1, "cases"), F.when(n % 3 == 0, F.concat(F.lit("ມາດຕາ "), n.cast("string"))).when(n % 3 == 1, "Art. 5")
    return table(spark, sf_dir, "documents").select("doc_id", L.covers_statute(kind, F.col("source"), section).alias("covers"), L.statute_like(F.col("source"), section).alias("title_like"))
