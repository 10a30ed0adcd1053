"""Jurisdictions, briefs and plans of whole messages against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from tamarack.plans import planning as P
from tamarack.plans import questions as Q
from tests.conftest import DATA

ARTICLE = "(?<![^\\W])(?:article|art\\.?|section|sec\\.?)|ມາດຕາ|มาตรา"


def plain_jurisdiction(text, given):
    if given:
        form = given.strip(" ").lower().replace("_", " ").replace("-", " ")
        return P.JURISDICTIONS.get(form, form)
    low = text.lower()
    if re.search("[຀-໿]", text) or any(w in low for w in P.LAO_WORDS):
        return "laos"
    return "thailand" if any(w in low for w in P.THAI_WORDS) else None


def first(text, markers, otherwise):
    return next((k for k, words in markers.items() if any(w in text for w in words)), otherwise)


def plain_brief(question, given, n_facts):
    q = " ".join((question or "").split())
    low, b = q.lower(), {}
    b["canonical"] = plain_jurisdiction(q, given) or "laos"
    b["area"], b["issue"] = first(low, Q.AREAS, "general"), first(low, Q.ISSUES, "analysis")
    found = [m[1].strip(".,;:()[]{}") for m in re.finditer(rf"(?i)(?:{ARTICLE})\s*([0-9A-Za-z./-]+)", q)]
    b["articles"] = list(dict.fromkeys(x for x in found if x))[:5]
    b["outcome"] = first(low, Q.OUTCOMES, {"rights": "rights explanation", "remedy": "available remedies"}.get(b["issue"]))
    b["parties"] = [p for p, words in Q.PARTIES.items() if any(w in low for w in words)]
    missing = ["timeline and key dates", "documents or notices already received"] * (len(q) < 120) + Q.ASKED_FACTS[b["area"]] + ["current procedural stage"] * (b["issue"] == "procedure")
    b["missing_facts"] = list(dict.fromkeys(missing))[:7]
    has = lambda words: any(w in low for w in words)
    issues = [P.ISSUE_LABELS[b["area"]]] + [f"{b['issue']} question"] * (b["issue"] != "analysis")
    issues += ["land-use-right protection issue"] * (has(P.LAND_WORDS) and has(P.RIGHT_WORDS) and has(P.PROTECTION_WORDS))
    issues += [f"requested outcome: {b['outcome']}"] * bool(b["outcome"]) + ["specific article lookup: " + ", ".join(b["articles"])] * bool(b["articles"])
    b["legal_issues"] = issues[:5]
    if b["canonical"] == "laos":
        laws = Q.AUTHORITIES[b["area"]]
        hints = [(law, None, words, 2 if b["area"] == "general" else i + 1) for i, (law, words) in enumerate(laws)]
        for a in b["articles"]:
            hints.insert(0, (laws[0][0], a, [f"ມາດຕາ {a}", f"Article {a}", q], 0))
        b["hints"] = hints[:5]
    else:
        b["hints"] = [("Relevant primary legislation", None, [q, "law", "article", b["area"], b["issue"]], 1)]
    phrases = [q] + [" ".join(x for x in [law, a, *terms[:4], b["area"], b["issue"]] if x) for law, a, terms, _ in b["hints"]]
    b["search_phrases"] = list(dict.fromkeys(phrases))[:8]
    sure = 0.45 + 0.2 * (b["area"] != "general") + 0.1 * (b["issue"] != "analysis") + 0.1 * (n_facts > 0) + 0.1 * bool(b["articles"])
    return b | {"confidence": round(min(0.9, sure), 4)}


def plain_plan(question, b, turn):
    where, area = b["canonical"], b["area"]
    words = question.split()
    at = [i for i, w in enumerate(words) if w.strip(".,;:()[]{}").lower().rstrip(".") in P.SECTION_WORDS]
    sections = " ".join(x for i in at for x in words[i : i + 3])
    english = P.ENGLISH_TERMS.get(area, P.OTHER_ENGLISH)
    queries = [(question, "original_user_question", where, 1, True)] if turn == 1 else []
    for i, (law, a, terms, priority) in enumerate(b["hints"]):
        text = " ".join(x for x in (question, law, a, " ".join(t.strip() for t in terms[:6] if t.strip())) if x).strip()
        queries.append((text, f"authority_hint_{i + 1}", where, priority + 2 * (turn == 2), i == 0 or bool(a)))
    if turn == 1:
        queries += [(p, f"legal_issue_search_phrase_{i + 1}", where, 1, False) for i, p in enumerate(b["search_phrases"][1:4])]
    if where == "laos":
        queries += [(f"{question} {f'{P.LAO_LAW} {P.LAO_TERMS.get(area, str())}'.strip()}", f"lao_{area}_statutory_terms", "laos", turn, True), (f"{question} {P.LAO_OFFICIAL} {english}", f"lao_{area}_english_authority_terms", "laos", turn, False)]
        if sections:
            queries.append((f"{sections} {P.LAO_LAW} {P.LAO_OFFICIAL} {english}", "lao_specific_article_lookup", "laos", turn, True))
        if turn == 2:
            queries.append((f"{english} Lao PDR ministry decree decision instruction regulation", f"lao_{area}_authority_second_pass", "laos", 2, False))
    elif where == "thailand":
        queries.append((f"{question} {P.THAI_LAW} {P.THAI_TERMS.get(area, '')}", f"thai_{area}_statutory_terms", "thailand", turn, True))
        if turn == 2:
            queries.append((f"{question} Thai law section regulation {english}", f"thai_{area}_english_second_pass", "thailand", 2, False))
    else:
        more = " official source primary authority" * (turn == 2)
        queries.append((f"{question} law article statute regulation legal test{more} {english}".strip(), f"generic_{area}_legal_terms", None, turn, False))
    seen, out = set(), []
    for q in sorted(queries, key=lambda q: (q[3], not q[4])):
        if (q[0].lower().strip(), q[2]) not in seen:
            seen.add((q[0].lower().strip(), q[2]))
            out.append(q)
    return out


EXTRA = [
    ("Is my lease valid? See Article 77 and Section 5b, sec. 9 (art. 3).", None), ("", None), (None, "th"), ("ສິດນຳໃຊ້ທີ່ດິນ ໄດ້ຮັບການປົກປ້ອງ ມາດຕາ 14", ""), ("การเช่าที่ดินในประเทศไทย", None), ("company tax in Thailand", None),
    ("which rights to land are protected?", "Singapore"), ("tax", "INTL"), ("  How do I appeal\n a tax assessment?  ", " lao_pdr"),
]


@pytest.fixture(scope="module")
def questions(spark):
    given = P.whole_questions(spark, f"{DATA}/sf0.01").select("question", "jurisdiction").collect()
    rows = [(i, *map(lambda x: x, r)) for i, r in enumerate([*map(tuple, given), *EXTRA])]
    return rows, P.briefed(spark.createDataFrame(rows, "id int, question string, jurisdiction string"), "question", "jurisdiction")


def test_briefs_of_whole_messages(questions):
    rows, brief = questions
    got = {r.id: r for r in brief.collect()}
    assert len(rows) > 250 and {r.canonical for r in got.values()} >= {"laos", "thailand", "international", "singapore"}
    for i, question, given in rows:
        r, want = got[i], plain_brief(question, given, len(got[i].facts))
        assert [tuple(h) for h in r.hints] == want.pop("hints"), question
        assert {k: r[k] for k in want} == want, question


@pytest.mark.parametrize("turn", [1, 2])
def test_plans_of_whole_messages(questions, turn):
    rows, brief = questions
    got = {r.id: [tuple(q) for q in r.plan] for r in P.planned_by_country(brief, "question", turn).select("id", "plan").collect()}
    for i, question, given in rows:
        assert got[i] == plain_plan(question or "", plain_brief(question, given, 0), turn), question
    purposes = {q[1] for plan in got.values() for q in plan}
    assert "lao_specific_article_lookup" in purposes and all(any(p.startswith(c) for p in purposes) for c in ("thai_", "generic_"))


def test_languages_and_short_names(spark):
    rows = [("ກົດໝາຍ", None, "LA"), ("สิทธิ", "EN", "thai"), ("law", "lao_pdr", "intl"), ("law", "klingon", "asean"), ("", "th", None)]
    df = spark.createDataFrame(rows, "text string, language string, jurisdiction string")
    out = df.select(P.response_language(F.col("text"), F.col("language")), P.short_jurisdiction(F.col("jurisdiction")), P.needs_multilingual(F.col("text"), F.col("jurisdiction"))).collect()
    assert [tuple(r) for r in out] == [("lo", "LA", True), ("en", "TH", True), ("lo", "INTL", False), ("en", "ASEAN", False), ("th", None, False)]
