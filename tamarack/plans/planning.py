"""Jurisdictions of questions, the rest of their analysis, and retrieval plans with queries by country.

A plan is an array of planned queries made by column expressions, so a table of questions is planned in one pass without a
shuffle. What differs between countries is data (EXPANSIONS): templates that are filled with the question and with terms of
its area.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import legal_text as L
from ..tables import table
from .questions import analysed, in_plan_order
from .registry import query

# Names of jurisdictions, words that tell one, their short forms, languages by name.
JURISDICTIONS = {"la": "laos", "lao": "laos", "laos": "laos", "lao pdr": "laos", "ລາວ": "laos", "th": "thailand", "thai": "thailand", "thailand": "thailand", "ไทย": "thailand", "intl": "international", "international": "international", "asean": "asean"}
LAO_WORDS = ["lao", "laos", "lao pdr", "ລາວ", "ສປປ", "ສປປ ລາວ", "กฎหมายลาว", "ประเทศลาว"]
THAI_WORDS = ["thai", "thailand", "ไทย", "กฎหมายไทย"]
SHORT = {"laos": "LA", "thailand": "TH", "international": "INTL"}
LANGUAGES = {"lo": ["lo", "la", "lao", "laos", "lao-pdr"], "th": ["th", "thai", "thailand"], "en": ["en", "eng", "english"]}
LAO_SCRIPT, THAI_SCRIPT = "[຀-໿]", "[฀-๿]"

# What an area's issue is called, and the words by which a question asks how land-use rights are protected.
ISSUE_LABELS = {
    "land": "land ownership/use-right issue", "lease": "lease and contractual obligation issue", "labor": "employment/labour rights issue", "company": "enterprise/company governance issue",
    "tax": "tax compliance or assessment issue", "family": "family or inheritance issue", "criminal": "criminal liability or procedure issue", "contract": "contract validity/breach issue", "general": "general Lao legal issue",
}
LAND_WORDS = ["ທີ່ດິນ", "ດິນ", "ນໍາໃຊ້ດິນ", "ນຳໃຊ້ດິນ", "ນາໍໃຊ້ດິນ", "land"]
RIGHT_WORDS = ["ສິດ", "right"]
PROTECTION_WORDS = ["ປົກປ້ອງ", "ປົກປັກ", "ໄດ້ຮັບການປົກ", "ສິດໃດ", "ໃດແດ່", "protected", "protection", "which rights"]

# Terms that plans add to a question, by country and area.
LAO_LAW, THAI_LAW = "ກົດໝາຍ ມາດຕາ ດຳລັດ ຄຳສັ່ງ", "กฎหมาย มาตรา พระราชบัญญัติ"
LAO_OFFICIAL = "Lao PDR law article decree regulation official gazette"
LAO_TERMS = {"land": "ທີ່ດິນ ກຳມະສິດ ສິດນຳໃຊ້ ອະສັງຫາ", "lease": "ສັນຍາ ເຊົ່າ ຄ່າເຊົ່າ ຜູ້ເຊົ່າ", "labor": "ແຮງງານ ຄ່າແຮງ ສັນຍາແຮງງານ"}
THAI_TERMS = {"land": "ที่ดิน กรรมสิทธิ์ อสังหา", "lease": "สัญญาเช่า ค่าเช่า ผู้เช่า"}
ENGLISH_TERMS = {
    "land": "land ownership land use right immovable property concession title deed", "lease": "lease contract rent tenant landlord immovable property", "company": "enterprise company shareholder director investment license",
    "labor": "labour employment termination wage severance work permit", "tax": "tax VAT income customs excise declaration", "family": "family marriage divorce child inheritance succession", "criminal": "criminal offence penalty detention police prosecutor",
}
OTHER_ENGLISH = "civil code obligation contract right duty"
SECTION_WORDS = ["article", "art", "section", "sec", "ມາດຕາ", "มาตรา"]

#: For each country: purpose, text (filled with question, sections and the terms of the area), whether it is required, and
#: in which passes it is asked. Queries that name {sections} are left out where a question has none.
EXPANSIONS = {
    "laos": [
        ("lao_{area}_statutory_terms", f"{{question}} {LAO_LAW} {{lao}}", True, (1, 2)),
        ("lao_{area}_english_authority_terms", f"{{question}} {LAO_OFFICIAL} {{english}}", False, (1, 2)),
        ("lao_specific_article_lookup", f"{{sections}} {LAO_LAW} {LAO_OFFICIAL} {{english}}", True, (1, 2)),
        ("lao_{area}_authority_second_pass", "{english} Lao PDR ministry decree decision instruction regulation", False, (2,)),
    ],
    "thailand": [
        ("thai_{area}_statutory_terms", f"{{question}} {THAI_LAW} {{thai}}", True, (1, 2)),
        ("thai_{area}_english_second_pass", "{question} Thai law section regulation {english}", False, (2,)),
    ],
    None: [
        ("generic_{area}_legal_terms", "{question} law article statute regulation legal test {english}", False, (1,)),
        ("generic_{area}_legal_terms", "{question} law article statute regulation legal test official source primary authority {english}", False, (2,)),
    ],
}
PLAN_TYPE = "array<struct<query:string,purpose:string,jurisdiction:string,priority:int,required:boolean>>"


def _holds(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _one_of(value: Column, names: dict[str, str], otherwise: Column) -> Column:
    return F.coalesce(*[F.when(value == k, F.lit(v)) for k, v in names.items()], otherwise)


def canonical_jurisdiction(value: Column) -> Column:
    """The name of a jurisdiction in any spelling; unknown ones in lower case; NULL for none."""
    form = F.regexp_replace(F.lower(F.trim(value)), "[_-]", " ")
    return F.when(value != "", _one_of(form, JURISDICTIONS, form))


def inferred_jurisdiction(text: Column, explicit: Column | None = None) -> Column:
    """The given jurisdiction, else what the text's script or words tell, else NULL."""
    low = F.lower(text)
    told = F.when(text.rlike(LAO_SCRIPT) | _holds(low, LAO_WORDS), "laos").when(_holds(low, THAI_WORDS), "thailand")
    return told if explicit is None else F.when(explicit != "", canonical_jurisdiction(explicit)).otherwise(told)


def short_jurisdiction(value: Column) -> Column:
    name = canonical_jurisdiction(value)
    return F.when(name != "", _one_of(name, SHORT, F.upper(name)))


def response_language(text: Column, explicit: Column) -> Column:
    """The language that is asked for, if it is known, else that of the text's script."""
    form = F.replace(F.lower(F.trim(explicit)), F.lit("_"), F.lit("-"))
    return F.coalesce(*[F.when(form.isin(names), F.lit(code)) for code, names in LANGUAGES.items()], L.response_language(text))


def needs_multilingual(text: Column, jurisdiction: Column) -> Column:
    """Whether a text is embedded by the multilingual model."""
    return F.coalesce(canonical_jurisdiction(jurisdiction).isin("laos", "thailand"), F.lit(False)) | text.rlike(f"{LAO_SCRIPT}|{THAI_SCRIPT}")


def land_protection(text: Column) -> Column:
    """Whether a question asks how rights to land are protected."""
    low = F.lower(text)
    return _holds(low, LAND_WORDS) & _holds(low, RIGHT_WORDS) & _holds(low, PROTECTION_WORDS)


def _by_area(terms: dict[str, str], otherwise: str) -> Column:
    return F.coalesce(*[F.when(F.col("area") == a, F.lit(t)) for a, t in terms.items()], F.lit(otherwise))


def _spaced(*parts: Column) -> Column:
    """The parts that are neither null nor empty, with single spaces between them."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), " ")


def section_terms(text: Column) -> Column:
    """The words of a text that name sections, each with the two after it; NULL for none."""

    def told(words: Column) -> Column:
        bare = lambda w: F.regexp_replace(F.lower(F.regexp_replace(w, r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$", "")), r"\.+$", "")
        picked = F.transform(words, lambda w, i: F.when(bare(w).isin(SECTION_WORDS), F.slice(words, i + 1, 3)).otherwise(F.array().cast("array<string>")))
        return F.nullif(F.array_join(F.flatten(picked), " "), F.lit(""))

    return L.bound(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""), told)


def briefed(questions: DataFrame, text: str, jurisdiction: str | None = None) -> DataFrame:
    """analysed() with canonical (the jurisdiction; laos unless told otherwise), language, legal_issues, and hints and
    search_phrases for that jurisdiction: outside of Lao law the one hint is the relevant primary legislation."""
    told = analysed(questions, text)
    explicit = F.col(jurisdiction) if jurisdiction else None
    told = told.withColumn("canonical", F.coalesce(inferred_jurisdiction(F.col("asked"), explicit), F.lit("laos")))
    told = told.withColumn("language", L.response_language(F.coalesce(text, F.lit(""))))
    issues = F.array_compact(F.array(
        _by_area(ISSUE_LABELS, "legal issue"), F.when(F.col("issue") != "analysis", F.concat("issue", F.lit(" question"))), F.when(land_protection(F.col("asked")), "land-use-right protection issue"),
        F.concat(F.lit("requested outcome: "), "outcome"), F.when(F.size("articles") > 0, F.concat(F.lit("specific article lookup: "), F.array_join("articles", ", "))),
    ))
    elsewhere = F.array(F.struct(F.lit("Relevant primary legislation").alias("law"), F.lit(None).cast("string").alias("article"), F.array(F.col("asked"), F.lit("law"), F.lit("article"), F.col("area"), F.col("issue")).alias("terms"), F.lit(1).alias("priority")))
    told = told.withColumns({"legal_issues": F.slice(issues, 1, 5), "hints": F.when(F.col("canonical") == "laos", F.col("hints")).otherwise(elsewhere)})
    area, issue = F.col("area"), F.col("issue")
    phrase = lambda h: F.array_join(F.filter(F.concat(F.array(h["law"], h["article"]), F.slice(h["terms"], 1, 4), F.array(area, issue)), lambda x: x.isNotNull() & (x != "")), " ")
    phrases = F.array_distinct(F.concat(F.array("asked"), F.transform("hints", phrase)))
    return told.withColumn("search_phrases", F.slice(phrases, 1, 8))


def planned_by_country(brief: DataFrame, text: str, turn: int = 1) -> DataFrame:
    """brief (of briefed) with plan: the queries of the first or the second pass in plan order. First: the question, a query
    for each hint, three search phrases and the country's expansions; second: hints and expansions, later in line."""
    asked, where = F.coalesce(text, F.lit("")), F.col("canonical")
    country = F.when(where.isin([c for c in EXPANSIONS if c]), where)

    def one(q: Column, purpose: Column, jurisdiction: Column, priority: Column, required: Column) -> Column:
        return F.struct(q.alias("query"), purpose.alias("purpose"), jurisdiction.alias("jurisdiction"), priority.cast("int").alias("priority"), required.alias("required"))

    def hint(h: Column, i: Column) -> Column:
        terms = F.filter(F.transform(F.slice(h["terms"], 1, 6), F.trim), lambda t: t != "")
        q = F.regexp_replace(_spaced(asked, h["law"], h["article"], F.array_join(terms, " ")), r"(?U)^\s+|\s+$", "")
        return one(q, F.concat(F.lit("authority_hint_"), (i + 1).cast("string")), where, h["priority"] + (0 if turn == 1 else 2), (i == 0) | h["article"].isNotNull())

    filled = {"question": asked, "sections": section_terms(F.col(text)), "lao": _by_area(LAO_TERMS, ""), "thai": _by_area(THAI_TERMS, ""), "english": _by_area(ENGLISH_TERMS, OTHER_ENGLISH), "area": F.col("area")}

    def fill(template: str) -> Column:
        """The template's columns put in; NULL if one of them is."""
        out = F.lit(template)
        for name, value in filled.items():
            if f"{{{name}}}" in template:
                out = F.replace(out, F.lit(f"{{{name}}}"), value)
        return out

    def expansions(name: str | None) -> Column:
        ends = {"laos": r"(?U)\s+$", None: r"(?U)^\s+|\s+$"}.get(name, "(?!)")  # white space that a country's queries go without
        own = [one(F.regexp_replace(fill(q), ends, ""), fill(purpose), F.lit(name).cast("string"), F.lit(turn), F.lit(must)) for purpose, q, must, turns in EXPANSIONS[name] if turn in turns]
        return F.filter(F.array(*own), lambda x: x["query"].isNotNull())

    more = F.coalesce(*[F.when(country == c, expansions(c)) for c in EXPANSIONS if c], expansions(None))
    hints = F.transform("hints", hint)
    if turn == 1:
        first = F.array(one(asked, F.lit("original_user_question"), where, F.lit(1), F.lit(True)))
        phrases = F.transform(F.slice("search_phrases", 2, 3), lambda p, i: one(p, F.concat(F.lit("legal_issue_search_phrase_"), (i + 1).cast("string")), where, F.lit(1), F.lit(False)))
        whole = F.concat(first, hints, phrases, more)
    else:
        whole = F.concat(hints, more)
    return brief.withColumn("plan", L.bound(whole.cast(PLAN_TYPE), in_plan_order))


def structured_payload(text: Column) -> Column:
    """Whether an answer is JSON that was meant for a program."""
    return F.startswith(F.trim(text), F.lit("{")) | F.contains(F.lower(text), F.lit("```json")) | F.contains(text, F.lit('"irac"'))


def whole_questions(spark, sf_dir) -> DataFrame:
    """The users' messages, whole, some with markers of areas and countries, and a jurisdiction for a few."""
    n = F.col("conv_id") + F.col("turn")
    extra = {0: " Article 012 and section 5; is the lease void?", 1: " ສິດນຳໃຊ້ທີ່ດິນ ໄດ້ຮັບການປົກປ້ອງ ມາດຕາ 14", 2: " company tax LAND in Thailand", 3: " which rights to land are protected?", 4: ""}
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    tail = F.coalesce(*[F.when(n % 5 == k, F.lit(v)) for k, v in extra.items()])
    given = F.when(n % 7 == 0, "Lao-PDR").when(n % 7 == 1, "th").when(n % 7 == 2, "INTL")
    return asked.select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), tail).alias("question"), given.alias("jurisdiction"))


@query(None)
def question_brief(spark, sf_dir):
    """Issues, hints, search phrases and jurisdiction of whole messages."""
    out = briefed(whole_questions(spark, sf_dir), "question", "jurisdiction")
    hints = F.transform("hints", lambda h: F.concat_ws("#", h["law"], h["article"]))
    return out.select(
        "conv_id", "turn", "canonical", short_jurisdiction(F.col("canonical")).alias("short"), "language", needs_multilingual(F.col("question"), F.col("canonical")).alias("multilingual"), "area", "issue", "outcome",
        *[F.array_join(x, " | ").alias(n) for n, x in (("legal_issues", F.col("legal_issues")), ("parties", F.col("parties")), ("missing_facts", F.col("missing_facts")), ("hints", hints), ("search_phrases", F.col("search_phrases")))], "confidence",
    )


@query(None)
def country_plans(spark, sf_dir):
    """The planned queries of both passes, with the expansions of each country."""
    brief = briefed(whole_questions(spark, sf_dir), "question", "jurisdiction").select("conv_id", "turn", "question", "asked", "area", "issue", "hints", "search_phrases", "canonical")
    told = lambda turn: planned_by_country(brief, "question", turn).select("conv_id", "turn", F.lit(turn).alias("pass"), F.inline(F.transform("plan", lambda q, i: F.struct(i.alias("place"), q["query"].alias("query"), q["purpose"].alias("purpose"), q["jurisdiction"].alias("jurisdiction"), q["priority"].alias("priority"), q["required"].alias("required")))))
    return told(1).union(told(2))


@query("""
WITH j AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ' Lao-PDR ' WHEN 1 THEN 'TH' WHEN 2 THEN 'asean' WHEN 3 THEN 'Viet_Nam' WHEN 4 THEN '' END AS given, lower(text) AS low FROM documents),
c AS (SELECT doc_id, CASE WHEN given <> '' THEN CASE given WHEN ' Lao-PDR ' THEN 'laos' WHEN 'TH' THEN 'thailand' WHEN 'asean' THEN 'asean' ELSE 'viet nam' END
  WHEN regexp_matches(low, 'lao|ລາວ|ສປປ|กฎหมายลาว|ประเทศลาว') OR regexp_matches(low, '[\\x{0E80}-\\x{0EFF}]') THEN 'laos' WHEN regexp_matches(low, 'thai|ไทย') THEN 'thailand' END AS canonical FROM j)
SELECT doc_id, canonical, CASE canonical WHEN 'laos' THEN 'LA' WHEN 'thailand' THEN 'TH' ELSE upper(canonical) END AS short FROM c""")
def jurisdictions(spark, sf_dir):
    """canonical, inferred and short jurisdictions."""
    n = F.col("doc_id") % 6
    given = F.when(n == 0, " Lao-PDR ").when(n == 1, "TH").when(n == 2, "asean").when(n == 3, "Viet_Nam").when(n == 4, "")
    rows = table(spark, sf_dir, "documents").select("doc_id", inferred_jurisdiction(F.col("text"), given).alias("canonical"))
    return rows.withColumn("short", short_jurisdiction(F.col("canonical")))


@query("""
SELECT doc_id, doc_id % 4 = 0 OR doc_id % 4 = 1 OR contains(text, '"irac"') OR starts_with(trim(text), '{') OR contains(lower(text), '```json') AS structured FROM documents""")
def structured_payloads(spark, sf_dir):
    """answers that are JSON meant for a program."""
    n = F.col("doc_id") % 4
    answer = F.when(n == 0, F.concat(F.lit('  {"a": 1} '), "text")).when(n == 1, F.concat("text", F.lit(" ```JSON x"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", structured_payload(answer).alias("structured"))
