"""Around an answer: routing and agent plans of questions, keyword relevance, citations, timelines, notices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import legal_text as L
from ..tables import CHUNKS_SQL, chunks, table
from .registry import query

# Agents by type of question (research, reasoning, verification, document, evidence, risk), names of
# agents, traces of prompts, and types of timeline events.
AGENT_PLANS = {
    "conversation": (False, False, False, False, False, False),
    "clarification": (False, False, False, False, False, False),
    "legal_question": (True, True, True, False, False, False),
    "document_review": (True, True, True, True, False, False),
    "case_strategy": (True, True, True, False, False, True),
    "evidence_analysis": (True, True, True, False, True, False),
    "draft_document": (True, True, True, True, False, False),
}
AGENT_NAMES = {
    "research": "legal_research", "legal_research": "legal_research", "reasoning": "irac_reasoning", "irac": "irac_reasoning",
    "irac_reasoning": "irac_reasoning", "verification": "citation_verification", "citation": "citation_verification",
    "citation_verification": "citation_verification", "document": "document_analysis", "document_analysis": "document_analysis",
    "evidence": "evidence_analyzer", "evidence_analyzer": "evidence_analyzer", "risk": "risk_strategy", "risk_strategy": "risk_strategy",
    "classifier": "query_classifier", "query_classifier": "query_classifier", "conversation": "conversation", "intent_router": "intent_router",
}
PROMPT_TRACES = [
    "context block", "retrieved legal context", "strict generation rules", "output format", "legal question analysis",
    "conversation memory", "response mode", "return compact json", "only use information from the context",
]
#: English markers of the router; other languages' lists are passed in.
MARKERS = {
    "statute": ["article", "section", "law on", "statute", "decree"],
    "rights": ["right to", "rights of", "am i entitled"],
    "draft": ["draft", "write a contract", "prepare a letter"],
    "evidence": ["evidence", "photo", "recording"],
    "document": ["this contract", "this document", "review the"],
    "strategy": ["strategy", "win the case", "chances"],
    "procedure": ["what should i do", "how do i", "procedure", "file a"],
    "harm": ["fraud", "damage", "cheated"],
    "personal": ["my ", " me ", "i was", "i have"],
    "conversation": ["hello", "thank", "good morning", "how are you"],
    "legal": ["law", "court", "legal", "contract", "land", "sue"],
}


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def route(questions: DataFrame, text: str = "text", mode: str | None = None, markers: dict[str, list[str]] = MARKERS) -> DataFrame:
    """questions with issue_type, query_type and use_rag: documents and evidence by mode first, then talk without any
    legal marker, then cases too thin to answer, then the issue's own type, else a legal question."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    has = {k: any_of(t, w) for k, w in markers.items()}
    kinds = {"statute": "statute_lookup", "rights": "rights_explanation", "draft": "draft_document", "evidence": "evidence_analysis", "document": "document_review", "strategy": "case_strategy", "procedure": "procedure"}
    issue = F.coalesce(*[F.when(has[k], F.lit(v)) for k, v in kinds.items()])
    rows = questions.withColumn("issue_type", issue)
    i = F.coalesce("issue_type", F.lit(""))
    thin = (has["personal"] | has["harm"]) & (i.isin("procedure", "case_strategy") | has["procedure"]) & (F.char_length(t) < 120) & ~t.rlike("[0-9]") & ~has["statute"]
    m = F.col(mode) if mode else F.lit("general")
    kind = (
        F.when(m == "evidence", "evidence_analysis").when(m == "document", "document_review").when(t == "", "conversation")
        .when(has["conversation"] & ~has["legal"] & (i == ""), "conversation").when(thin, "clarification")
        .when(i.isin("document_review", "evidence_analysis", "draft_document", "case_strategy"), i).otherwise("legal_question")
    )
    return rows.withColumn("query_type", kind).withColumn("use_rag", ~F.col("query_type").isin("conversation", "clarification"))


def with_agents(routed: DataFrame, force: dict[str, Column] | None = None) -> DataFrame:
    """routed with use_<agent> flags of its query_type; forced flags are or-ed in."""
    names = ["research", "reasoning", "verification", "document", "evidence", "risk"]
    plans = routed.sparkSession.createDataFrame([(k, *v) for k, v in AGENT_PLANS.items()], "query_type string, " + ", ".join(f"use_{n} boolean" for n in names))
    out = routed.join(F.broadcast(plans), "query_type", "left")  # seven rows
    return out.withColumns({f"use_{k}": F.col(f"use_{k}") | v for k, v in (force or {}).items()})


def keyword_relevance_score(terms: list[tuple[str, float]], articles: list[str]) -> Column:
    """Relevance of rows (title, section_ref, content, source_url) for ASCII terms with weights."""
    hay = F.lower(F.concat_ws(" ", "title", "content", "section_ref"))
    head = F.lower(F.concat_ws(" ", "title", "section_ref", F.substring("content", 1, 280)))
    score = F.lit(0.0)
    for a in articles:
        score = score + F.when(L.matches_article(F.concat_ws("\n", "section_ref", "content"), a), 4.0).otherwise(0.0)
    for term, weight in terms:
        here = rf"(?<![\p{{L}}\p{{N}}_]){term}(?![\p{{L}}\p{{N}}_])"
        score = score + F.when(hay.rlike(here), F.lit(weight) + F.when(head.rlike(here), min(0.75, 0.55 * weight)).otherwise(0.0)).otherwise(0.0)
    statute = F.when(L.statute_like(F.col("title"), F.col("section_ref")), 0.35).otherwise(0.0)
    official = F.when(L.official_source(F.col("source_url")), 0.45).otherwise(0.0)
    return score + statute + official - L.toc_penalty(hay)


def verify(citations: DataFrame, chunk_rows: DataFrame, laws: DataFrame, cases: DataFrame) -> DataFrame:
    """citations (citation_id, ref, chunk_id) with status: by chunk (chunk_id, status, review_status), else by law
    (ref, status), else by case (ref); empty references are REJECTED, unknown ones UNVERIFIED."""
    c = chunk_rows.select("chunk_id", ((F.col("status") == "active") & (F.col("review_status") == "approved")).alias("_chunk"))
    law = laws.select("ref", F.upper("status").isin("ACTIVE", "INDEXED").alias("_law")).groupBy("ref").agg(F.max("_law").alias("_law"))
    case = cases.select("ref").distinct().withColumn("_case", F.lit(True))
    out = citations.join(c, "chunk_id", "left").join(law, "ref", "left").join(case, "ref", "left")
    status = (
        F.when(F.coalesce("ref", F.lit("")) == "", "REJECTED")
        .when(F.col("_chunk").isNotNull(), F.when(F.col("_chunk"), "VERIFIED").otherwise("UNVERIFIED"))
        .when(F.col("_law").isNotNull(), F.when(F.col("_law"), "VERIFIED").otherwise("OUTDATED"))
        .when(F.col("_case"), "VERIFIED").otherwise("UNVERIFIED")
    )
    return out.select("citation_id", "ref", status.alias("status"))


def timeline(events: DataFrame, sessions: DataFrame, history: DataFrame) -> DataFrame:
    """Events (id, event, date, type): memory events, sessions, and history whose id is in neither."""
    seen = events.select("id").union(sessions.select("id"))
    return events.unionByName(sessions).unionByName(history.join(seen, "id", "left_anti"))


def agent_names(names: Column) -> Column:
    """Known agents among names, in order, once each."""
    known = F.transform(names, lambda n: F.coalesce(*[F.when(F.lower(F.trim(n)) == k, F.lit(v)) for k, v in AGENT_NAMES.items()]))
    return F.array_distinct(F.array_compact(known))


def mask_secret(value: Column) -> Column:
    v = F.trim(value)
    return F.when(F.coalesce(value, F.lit("")) == "", "Not configured").when(F.char_length(v) <= 8, "Configured").otherwise(F.concat(F.substring(v, 1, 3), F.lit("****"), F.right(v, F.lit(4))))


def time_ago(ts: Column, as_of: Column) -> Column:
    s = F.unix_timestamp(as_of) - F.unix_timestamp(ts)
    return (
        F.when(ts.isNull(), "-").when(s < 60, "just now").when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d ago")))
    )


def key_facts(text: Column, most: int = 5) -> Column:
    """The first lines that hold more than spaces and dashes, without those at their ends; a text of one such line is one
    fact as it is."""
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    lines = F.transform(F.split(F.replace(whole, F.lit("\r"), F.lit("\n")), "\n"), lambda x: F.regexp_replace(x, "^[ -]+|[ -]+$", ""))
    found = F.filter(lines, lambda x: x != "")
    return F.when(whole == "", F.array().cast("array<string>")).when(F.size(found) > 1, F.slice(found, 1, most)).otherwise(F.array(whole))


#: Words that make a question a fact.
FACT_WORDS = ["because", "after", "signed", "paid", "received", "own", "rent"]


def material_facts(text: Column, most: int = 6) -> Column:
    """The first sentences of 12 characters or more that tell something, each cut at 260: parts between sentence ends,
    semicolons and dashes, without mere questions."""
    parts = F.transform(F.split(text, r"(?U)(?<=[.!?])\s+|;|\s+-\s+"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    tells = lambda x: (F.char_length(x) >= 12) & (~x.endswith("?") | any_of(F.lower(x), FACT_WORDS))
    return F.transform(F.slice(F.filter(parts, tells), 1, most), lambda x: F.substring(x, 1, 260))


def without_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"```(?:json)?\s*|\s*```", ""))


def prompt_leak(text: Column) -> Column:
    return any_of(F.lower(text), PROMPT_TRACES)


def _conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


_HAS = "regexp_matches(t, '{}')"


@query("""
WITH q AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'hello ' WHEN 1 THEN 'please draft ' WHEN 2 THEN 'what should i do, i was cheated ' WHEN 3 THEN 'article 5 ' ELSE '' END || text AS text FROM conversations WHERE role = 'user'),
t AS (SELECT *, lower(trim(text)) AS t FROM q),
i AS (SELECT *, CASE WHEN regexp_matches(t, 'article|section|law on|statute|decree') THEN 'statute_lookup' WHEN regexp_matches(t, 'right to|rights of|am i entitled') THEN 'rights_explanation'
  WHEN regexp_matches(t, 'draft|write a contract|prepare a letter') THEN 'draft_document' WHEN regexp_matches(t, 'evidence|photo|recording') THEN 'evidence_analysis' WHEN regexp_matches(t, 'this contract|this document|review the') THEN 'document_review'
  WHEN regexp_matches(t, 'strategy|win the case|chances') THEN 'case_strategy' WHEN regexp_matches(t, 'what should i do|how do i|procedure|file a') THEN 'procedure' END AS issue_type FROM t),
r AS (SELECT conv_id, turn, issue_type, CASE WHEN t = '' THEN 'conversation' WHEN regexp_matches(t, 'hello|thank|good morning|how are you') AND NOT regexp_matches(t, 'law|court|legal|contract|land|sue') AND issue_type IS NULL THEN 'conversation'
  WHEN (regexp_matches(t, 'my | me |i was|i have') OR regexp_matches(t, 'fraud|damage|cheated')) AND (coalesce(issue_type, '') IN ('procedure', 'case_strategy') OR regexp_matches(t, 'what should i do|how do i|procedure|file a')) AND length(t) < 120
    AND NOT regexp_matches(t, '[0-9]') AND NOT regexp_matches(t, 'article|section|law on|statute|decree') THEN 'clarification'
  WHEN issue_type IN ('document_review', 'evidence_analysis', 'draft_document', 'case_strategy') THEN issue_type ELSE 'legal_question' END AS query_type FROM i)
SELECT conv_id, turn, issue_type, query_type, query_type NOT IN ('conversation', 'clarification') AS use_rag, query_type NOT IN ('conversation', 'clarification') AS use_research,
  query_type IN ('document_review', 'draft_document') AS use_document, query_type = 'evidence_analysis' AS use_evidence, query_type = 'case_strategy' OR turn > 5 AS use_risk FROM r""")
def plan_routing(spark, sf_dir):
    """A question table routed and given its agents."""
    lead = F.when(F.col("turn") % 5 == 0, "hello ").when(F.col("turn") % 5 == 1, "please draft ").when(F.col("turn") % 5 == 2, "what should i do, i was cheated ").when(F.col("turn") % 5 == 3, "article 5 ").otherwise("")
    text = F.concat(lead, "text")
    rows = _conversations(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", text.alias("text"))
    out = with_agents(route(rows), {"risk": F.col("turn") > 5})
    return out.select("conv_id", "turn", "issue_type", "query_type", "use_rag", "use_research", "use_document", "use_evidence", "use_risk")


@query(r"""
WITH r AS (SELECT doc_id, source AS title, CASE WHEN doc_id % 5 = 0 THEN 'Article ' || doc_id ELSE '' END AS section_ref, text AS content, CASE WHEN lang = 'fr' THEN 'https://official.example' END AS url FROM documents),
f AS (SELECT *, lower(concat_ws(' ', title, content, section_ref)) AS hay, lower(concat_ws(' ', title, section_ref, substr(content, 1, 280))) AS head FROM r),
c AS (SELECT *, len(regexp_extract_all(substr(hay, 1, 2500), '(?:\.|-|_){6,}')) AS l, len(regexp_extract_all(substr(hay, 1, 2500), '(?i)(?:ມາດຕາ|มาตรา|article|section)\s*[0-9]{1,4}')) AS a FROM f)
SELECT doc_id, round(CASE WHEN regexp_matches(section_ref || chr(10) || content, '(?im)(?:(?:ມາດຕາ|มาตรา|article|art\.?|section|sec\.?)\s*0*25(?:[^0-9]|$)|^\s*0*25(?:\.|\s))') THEN 4.0 ELSE 0 END
  + CASE WHEN regexp_matches(hay, '(^|[^\p{L}\p{N}_])there($|[^\p{L}\p{N}_])') THEN 0.7 + CASE WHEN regexp_matches(head, '(^|[^\p{L}\p{N}_])there($|[^\p{L}\p{N}_])') THEN 0.385 ELSE 0 END ELSE 0 END
  + CASE WHEN regexp_matches(hay, '(^|[^\p{L}\p{N}_])land($|[^\p{L}\p{N}_])') THEN 0.35 + CASE WHEN regexp_matches(head, '(^|[^\p{L}\p{N}_])land($|[^\p{L}\p{N}_])') THEN 0.1925 ELSE 0 END ELSE 0 END
  + CASE WHEN regexp_matches(lower(title || ' ' || section_ref), 'law|statute|act|code|decree|regulation|article') THEN 0.35 ELSE 0 END + CASE WHEN url IS NOT NULL THEN 0.45 ELSE 0 END
  - CASE WHEN l >= 5 AND a >= 4 THEN 1.25 WHEN l >= 3 THEN 0.85 WHEN a >= 8 THEN 0.45 ELSE 0 END, 6) AS relevance FROM c""")
def keyword_relevance(spark, sf_dir):
    """The scores of the direct keyword search, in one scan."""
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.col("source").alias("title"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Article "), "doc_id")).otherwise("").alias("section_ref"), F.col("text").alias("content"), F.when(F.col("lang") == "fr", "https://official.example").alias("source_url"))
    return rows.select("doc_id", F.round(keyword_relevance_score([("there", 0.7), ("land", 0.35)], ["25"]), 6).alias("relevance"))


@query(f"""
WITH {CHUNKS_SQL.strip()},
c AS (SELECT event_id AS citation_id, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'ref' || (user_id % 40) END AS ref, CASE WHEN event_id % 3 = 0 THEN event_id % 400 END AS chunk_id FROM events)
SELECT citation_id, c.ref, CASE WHEN c.ref = '' THEN 'REJECTED' WHEN k.chunk_id IS NOT NULL THEN CASE WHEN k.status = 'active' AND k.review_status = 'approved' THEN 'VERIFIED' ELSE 'UNVERIFIED' END
  WHEN n.n_nationkey IS NOT NULL THEN CASE WHEN n.n_nationkey % 2 = 0 THEN 'VERIFIED' ELSE 'OUTDATED' END WHEN s.s_suppkey IS NOT NULL THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS status
FROM c LEFT JOIN chunks k ON k.chunk_id = c.chunk_id LEFT JOIN nation n ON 'ref' || n.n_nationkey = c.ref LEFT JOIN supplier s ON s.s_suppkey >= 25 AND 'ref' || s.s_suppkey = c.ref""")
def citation_verification(spark, sf_dir):
    """R18."""
    e = table(spark, sf_dir, "events")
    ref = F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("ref"), (F.col("user_id") % 40).cast("string")))
    cited = e.select(F.col("event_id").alias("citation_id"), ref.alias("ref"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 400).alias("chunk_id"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("ref"), F.col("n_nationkey").cast("string")).alias("ref"), F.when(F.col("n_nationkey") % 2 == 0, "active").otherwise("repealed").alias("status"))
    cases = table(spark, sf_dir, "supplier").where("s_suppkey >= 25").select(F.concat(F.lit("ref"), F.col("s_suppkey").cast("string")).alias("ref"))
    return verify(cited, chunks(spark, sf_dir), nation, cases)


@query("""
SELECT id, event, strftime(day, '%Y-%m-%d') AS day, type FROM (SELECT 'e' || event_id AS id, event_type AS event, ts::DATE AS day, 'event' AS type FROM events WHERE event_type <> 'view'
  UNION ALL SELECT 'o' || o_orderkey, o_orderstatus, o_orderdate::DATE, 'session' FROM orders
  UNION ALL SELECT 'e' || event_id, 'IRAC analysis', ts::DATE, 'query' FROM events WHERE event_type = 'view')""")
def case_timeline(spark, sf_dir):
    """Union of three histories, the last without what the others have."""
    e, o = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    shape = lambda df, id_, event, day, kind: df.select(id_.alias("id"), event.alias("event"), day.cast("date").alias("day"), F.lit(kind).alias("type"))
    key = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    events = shape(e.where("event_type <> 'view'"), key, F.col("event_type"), F.col("ts"), "event")
    sessions = shape(o, F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.col("o_orderstatus"), F.col("o_orderdate"), "session")
    out = timeline(events, sessions, shape(e, key, F.lit("IRAC analysis"), F.col("ts"), "query"))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""
WITH n AS (SELECT user_id, list(event_type ORDER BY event_id) AS t FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN list_position(t, 'click') IS NULL THEN (CASE WHEN list_contains(t, 'error') THEN 'irac_reasoning' ELSE '' END)
  WHEN NOT list_contains(t, 'error') THEN 'legal_research' WHEN list_position(t, 'click') < list_position(t, 'error') THEN 'legal_research,irac_reasoning' ELSE 'irac_reasoning,legal_research' END AS agents FROM n""")
def agent_name_union(spark, sf_dir):
    """Agent names through the synonym map (clicks as Research, errors as irac; others unknown)."""
    name = F.when(F.col("event_type") == "click", " Research ").when(F.col("event_type") == "error", "irac").otherwise("other")
    first = table(spark, sf_dir, "events").groupBy("user_id", name.alias("n")).agg(F.min("event_id").alias("event_id"))  # a name's first place
    sets = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "n"))).alias("s"))
    return sets.select("user_id", F.array_join(agent_names(F.transform("s", lambda x: x["n"])), ",").alias("agents"))


@query("""
WITH s AS (SELECT count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS n, avg(value) AS v FROM events)
SELECT kind, level FROM (SELECT 'error_rate' AS kind, 'warning' AS level, errors / n > 0.02 AS on_ FROM s UNION ALL SELECT 'latency', 'info', v > 100 FROM s UNION ALL SELECT 'queue', 'critical', errors > 100000 FROM s) WHERE on_""")
def notifications(spark, sf_dir):
    """Notices by rules over aggregates."""
    s = table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n"), F.avg("value").alias("v"))
    rules = [("error_rate", "warning", F.col("errors") / F.col("n") > 0.02), ("latency", "info", F.col("v") > 100), ("queue", "critical", F.col("errors") > 100000)]
    notes = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"))) for kind, level, test in rules]))
    return s.select(F.inline(notes))


@query("""
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS ago
FROM (SELECT event_id, date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-01-31') AS s FROM events)""")
def time_ago_labels(spark, sf_dir):
    """Date functions: relative times."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.select("event_id", time_ago(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("ago"))


@query("""
SELECT event_id, CASE WHEN length(k) <= 8 THEN 'Configured' ELSE substr(k, 1, 3) || '****' || right(k, 4) END AS masked FROM (SELECT event_id, event_type || event_id AS k FROM events)""")
def masked_secrets(spark, sf_dir):
    """F24."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", mask_secret(F.concat("event_type", F.col("event_id").cast("string"))).alias("masked"))


@query("""
SELECT doc_id, list_bool_or([contains(lower(text), 'context block'), contains(lower(text), 'output format')]) AS leak, doc_id % 2 = 0 AND contains(target, '5') AS on_target, row_number() OVER (PARTITION BY source ORDER BY (doc_id % 2 = 0 AND contains(target, '5')) DESC, n_chars DESC, doc_id) AS place
FROM (SELECT *, 'Article ' || (doc_id % 10) AS target FROM documents) QUALIFY place <= 50""")
def target_first(spark, sf_dir):
    """Of each source the fifty first rows, those with the target section before others, then by score; traces
    of prompts. A task hands on fifty rows of a source at most."""
    on = (F.col("doc_id") % 2 == 0) & F.contains(F.concat(F.lit("Article "), (F.col("doc_id") % 10).cast("string")), F.lit("5"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "text", on.alias("on_target"))
    place = F.row_number().over(W.partitionBy("source").orderBy(F.desc("on_target"), F.desc("n_chars"), "doc_id"))
    return rows.withColumn("place", place.cast("long")).where("place <= 50").select("doc_id", prompt_leak(F.col("text")).alias("leak"), "on_target", "place")


@query(None)
def fact_splits(spark, sf_dir):
    """key facts (lines) and material facts (sentences; look-behind, which RE2 lacks)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(key_facts(F.col("text"))).alias("key_facts"), F.array_join(material_facts(without_fences(F.col("text"))), " / ").alias("material_facts"))
