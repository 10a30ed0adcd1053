"""Search terms of legal questions: lexicons, and expressions that find, order and match terms."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as N
from . import legal_text as L

# Phrases that are terms of their own, and what a marker adds.
PHRASES = [
    "ຜູ້ໄດ້ຮັບ", "ໄດ້ຮັບ", "ສິດນຳໃຊ້", "ສິດນໍາໃຊ້", "ສິດນາໍໃຊ້", "ປົກປ້ອງ", "ປົກປັກຮັກສາ", "ຜົນປະໂຫຍດ", "ສິດໃຊ້", "ສິດໄດ້ຮັບ", "ສິດໂອນ", "ສິດສືບທອດ", "ພົນລະເມືອງ",
    "ພົນລະເມືອງລາວ", "ເຊົ່າ", "ເຊົາ", "ຂອງລັດ", "ສູງສຸດ", "ຈັກປີ", "ບໍ່ເກີນ", "ແບ່ງ", "ຈັດແບ່ງ", "ແບ່ງເປັນ", "ເຂດ", "ປະເພດ", "ເຂດແລະປະເພດ", "ການນຳໃຊ້", "ບໍລິເວນນ້ຳ",
    "ບໍລິເວນນໍ້າ", "ຫ້າມ", "ສິ່ງໃດ", "ການປ່ຽນ", "ປ່ຽນປະເພດ", "ເງື່ອນໄຂ", "ອະນຸມັດ",
]
EXPANSIONS = {
    "ເຊົ່າ": ["ເຊົ່າ", "ເຊົາ", "ຄ່າເຊົ່າ", "lease", "rent", "tenant"],
    "ປົກປ້ອງ": ["ປົກປ້ອງ", "ປົກປັກຮັກສາ", "ຜົນປະໂຫຍດ", "ສິດໃຊ້", "ສິດໂອນ", "ສິດສືບທອດ"],
    "ແບ່ງ": ["ແບ່ງ", "ຈັດແບ່ງ", "ເຂດ", "ປະເພດ", "zone", "category"],
    "ປະເພດ": ["ປະເພດ", "ເຂດ", "ຈັດແບ່ງ", "category", "land type"],
    "ນ້ຳ": ["ນ້ຳ", "ນໍ້າ", "ນາໍ", "ນາ້", "water", "water area"],
    "ປ່ຽນ": ["ປ່ຽນ", "ປຽນ", "ອະນຸມັດ", "ເງື່ອນໄຂ", "approval", "change"],
}
#: Markers that count only as they are written, not in their folded form.
AS_WRITTEN = ("ນ້ຳ", "ນໍ້າ")
LAO_TERMS, THAI_TERMS = ["ກົດໝາຍ", "ມາດຕາ", "ດຳລັດ", "ຄຳສັ່ງ"], ["กฎหมาย", "มาตรา", "พระราชบัญญัติ"]
LAND_MARKERS = (
    "ທີ່ດິນ", "ດິນ", "ນໍາໃຊ້ດິນ", "ນຳໃຊ້ດິນ", "ນາໍໃຊ້ດິນ", "ກຳມະສິດ", "ສິດນຳໃຊ້", "ສິດນໍາໃຊ້", "ສິດນາໍໃຊ້", "ອະສັງຫາ", "ที่ดิน", "กรรมสิทธิ์",
    "land", "property", "ownership", "usufruct", "immovable",
)
LAND_TERMS = [
    "ທີ່ດິນ", "ດິນ", "ກຳມະສິດ", "ສິດນຳໃຊ້", "ສິດນໍາໃຊ້", "ສິດນາໍໃຊ້", "ກົດໝາຍທີ່ດິນ", "ที่ดิน",
    "land", "property", "ownership", "usufruct", "land use right", "immovable property",
]
SYNONYMS = {
    "ນ້ຳ": ["ນ້ຳ", "ນໍ້າ", "lease", "rent", "tenant"],
    "rent": ["rent", "lease", "tenant", "ค่าเช่า", "เช่า", "ເຊົ່າ"],
    "lease": ["lease", "rent", "tenant", "ค่าเช่า", "เช่า", "ເຊົ່າ"],
    "company": ["company", "enterprise", "shareholder", "director", "investment"],
    "labor": ["labor", "labour", "employment", "termination", "wage", "severance"],
    "tax": ["tax", "vat", "customs", "income", "declaration"],
}
#: Terms that say little, as written and (for weights) folded.
GENERIC = ["ກົດໝາຍ", "ມາດຕາ", "ດຳລັດ", "ຄຳສັ່ງ", "ທີ່ດິນ", "land", "property", "ownership"]
GENERIC_FOLDED = ["ກົດໝາຍ", "ມາດຕາ", "ດຳລັດ", "ຄຳສັ່ງ", "ທີດິນ", "law", "land", "property", "ownership"]
MOST_TERMS = 18
_EDGES = r"""[.,;:()\[\]{}"'!?]+"""


def folded(texts: Column) -> Column:
    """The search forms of an array of texts."""

    def each(values: pd.Series) -> pd.Series:
        return values.map(lambda xs: [N.fold_for_search(x) for x in xs])

    return F.pandas_udf(each, "array<string>")(texts)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _when_any(text: Column, markers, terms) -> Column:
    hit = reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers])
    return F.when(hit, _strings(terms)).otherwise(F.array().cast("array<string>"))


def found_terms(text: Column, low: Column, form: Column) -> Column:
    """All terms of a question in the order in which they are found, repeats included: its words, phrases and their
    expansions, articles in four ways of naming them, terms of its script, of land law, and synonyms.

    low is the text in lower case, form its search form.
    """
    words = F.transform(F.split(low, r"(?U)\s+"), lambda w: F.regexp_replace(w, f"^{_EDGES}|{_EDGES}$", ""))
    phrases = [_when_any(low, [p], [p]) if N.fold_for_search(p) == "" else F.when(F.contains(low, F.lit(p)) | F.contains(form, F.lit(N.fold_for_search(p))), _strings([p])).otherwise(_strings([])) for p in PHRASES]
    more = []
    for marker, terms in EXPANSIONS.items():
        hit = F.contains(low, F.lit(marker))
        if marker not in AS_WRITTEN:
            hit = hit | F.contains(form, F.lit(N.fold_for_search(marker)))
        more.append(F.when(hit, _strings(terms)).otherwise(_strings([])))
    articles = F.flatten(F.transform(L.article_targets(low), lambda a: F.array(*[F.concat(F.lit(f"{name} "), a) for name in (L.LAO_ARTICLE, L.THAI_ARTICLE, "Article", "Section")])))
    scripts = [F.when(text.rlike(pattern), _strings(terms)).otherwise(_strings([])) for pattern, terms in (("[຀-໿]", LAO_TERMS), ("[฀-๿]", THAI_TERMS))]
    synonyms = [_when_any(low, [marker], terms) for marker, terms in SYNONYMS.items()]
    return F.concat(F.filter(words, lambda w: F.char_length(w) >= 2), *phrases, *more, articles, *scripts, _when_any(low, LAND_MARKERS, LAND_TERMS), *synonyms)


def first_of_each(terms: Column, forms: Column) -> Column:
    """The first of the terms with each search form, in order, as (term, form); empty terms go."""
    pairs = F.zip_with(terms, forms, lambda t, f: F.struct(F.trim(t).alias("term"), f.alias("form")))
    none = F.array().cast("array<struct<term:string,form:string>>")

    def add(seen: Column, p: Column) -> Column:
        new = (p["term"] != "") & ~F.exists(seen, lambda s: s["form"] == p["form"])
        return F.when(new, F.concat(seen, F.array(p))).otherwise(seen)

    return F.aggregate(pairs, none, add)


def article_term(term: Column, number: Column) -> Column:
    """Whether a term names the article of that number."""
    named = F.regexp_extract(term, rf"(?i)(?:{L.LAO_ARTICLE}|{L.THAI_ARTICLE}|article|art\.?|section|sec\.?)\s*0*([0-9]+)(?:[^0-9]|$)", 1)
    return named == number


def in_order_of_use(pairs: Column) -> Column:
    """Terms by what they tell: articles, longer words of other scripts, shorter ones, ASCII words, generic words; longer
    ones first in each class, ties as they came. pairs: of first_of_each."""

    def placed(numbers: Column) -> Column:
        def key(p: Column, i: Column) -> Column:
            low = F.lower(p["term"])
            own = ~low.rlike(r"^[\x00-\x7F]*$")
            kind = (
                F.when(F.exists(numbers, lambda n: article_term(low, n)), 0).when(low.isin(GENERIC), 4)
                .when(own & (F.char_length(low) >= 4), 1).when(own, 2).otherwise(3)
            )
            return F.struct(kind.alias("kind"), (-F.char_length(low)).alias("length"), i.alias("at"), p["term"].alias("term"))

        return F.transform(F.array_sort(F.transform(pairs, key)), lambda k: k["term"])

    numbers = F.array_distinct(F.flatten(F.transform(pairs, lambda p: L.article_targets(F.lower(p["term"])))))
    return L.bound(numbers, placed)


def with_keyword_terms(questions: DataFrame, text: str, out: str, most: int | None = MOST_TERMS) -> DataFrame:
    """questions with `out`: the terms of a text column in order of use, `most` of them (None: all). Null has none."""
    low, terms, forms = f"{out}_low", f"{out}_terms", f"{out}_forms"
    df = questions.withColumn(low, F.lower(F.coalesce(text, F.lit("")))).withColumn(forms, N.search_form(F.col(low)))
    df = df.withColumn(terms, found_terms(F.coalesce(text, F.lit("")), F.col(low), F.col(forms))).withColumn(forms, folded(F.col(terms)))
    df = df.withColumn(terms, first_of_each(F.col(terms), F.col(forms)))
    ordered = in_order_of_use(F.col(terms))
    return df.withColumn(out, ordered if most is None else F.slice(ordered, 1, most)).drop(low, terms, forms)


def term_matches(term: str, low: Column, form: Column) -> Column:
    """Whether a text holds a term: ASCII terms as words, others anywhere, in lower case or else in search form."""
    value = " ".join(term.split()).lower() if term.isascii() else term.casefold().strip()
    fold = N.fold_for_search(value)
    if not value:
        return F.lit(False)
    if value.isascii():
        hit = low.rlike(rf"(?<![\p{{L}}\p{{N}}_])\Q{value}\E(?![\p{{L}}\p{{N}}_])")
        again = form.rlike(rf"(?<![\p{{L}}\p{{N}}_])\Q{fold}\E(?![\p{{L}}\p{{N}}_])")
    else:
        hit, again = F.contains(low, F.lit(value)), F.contains(form, F.lit(fold))
    return hit | again if len(fold) >= 2 else hit


def section_number(ref: Column) -> Column:
    """The number or name that follows an article or section word; NULL for none."""
    return F.nullif(F.regexp_extract(ref, rf"(?i)(?:{L.LAO_ARTICLE}|{L.THAI_ARTICLE}|article|art\.?|section|sec\.?)\s*([0-9A-Za-z/.-]+)", 1), F.lit(""))
