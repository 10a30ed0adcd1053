"""Main text of web pages by template deduction over the pages of a host.

Tokens are tags (with their path from the root) and texts (with their path). The occurrence vector of a token is how often
each different page of a host has it; tokens with equal vectors form an equivalence class. A class nests in the class of
the element around it: whatever has a token also has the element that it lies in, so the pages of the outer class cover
those of the inner one. Classes that are large and frequent enough are the host's template, those of only some of a host's
pages inside the others; a text is template where it stands on most of the pages that have its element at all.

What the template leaves over are its slots: texts by the innermost template element around them. The article is where they
are: the innermost template element whose slots hold most of what is left. Tags only tell how far it reaches: up to the
<article> or <main> around that element, or, if the element is wider than one, down to the ones in it that hold most. All
texts of a content slot's article stay, those that other pages of the host have too. Asides in it are told by tag and name.

Vectors are never built: a class is known by the XOR of hashes of (page, count), combined before the shuffle, so a host
with a third of all pages is no single task. Templates go to the pages by a broadcast while their number, which is counted,
allows it; beyond that each page gets those of its own tokens that are in its host's template, by a join on (host, token).
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written
from .sizing import free_names, replace_columns

#: A class needs so many tokens and so many different pages; a text also such a share of the pages with its element.
CLASS_TOKENS, CLASS_PAGES, CLASS_SHARE = 2, 4, 0.8
#: Template tokens that are broadcast at most (8 bytes each), and hosts whose templates a worker keeps at hand.
BROADCAST_TOKENS, KEPT_HOSTS = 1_000_000, 64

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|iframe|svg|object|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"\shidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a new block closes when they are left open, and what they are closed up to.
_CLOSES_P = BLOCKS - {"html", "body", "head"}
_ASIDE_TAGS = frozenset("nav aside footer form head menu dialog button fieldset".split())
_ASIDE_NAMES = (
    "nav|navbar|navigation|menu|breadcrumbs?|masthead|topbar|footer|foot|sidebar|aside|rail|ads?|adverts?|advertisement|advertising|adbox|"
    "adslot|banner|promo|promotion|sponsor|sponsored|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|comments?|respond|replies|reply|disqus|"
    "discussion|related|recommended|share|sharing|social|subscribe|subscription|newsletter|signup|login|search|widget|pagination|pager|skip|toolbar|disclaimer"
)
_BOX_NAMES = "area|bars?|block|body|box|button|buttons|card|cards|container|content|group|holder|icons?|inner|items?|label|left|links?|list|main|panel|posts?|right|row|section|slot|stories|text|tools?|top|unit|wrap|wrapper"
#: Around an article a part of a name tells an aside. In it all parts have to: a box named share-bar is one for sharing, one
#: named share-price is none.
_ASIDE_WORDS = re.compile(rf"(?:^|[\s_-])(?:{_ASIDE_NAMES})(?:$|[\s_-])", re.I)
_ASIDE_IN_ARTICLE = re.compile(rf"(?<!\S)(?:(?:{_ASIDE_NAMES}|{_BOX_NAMES})[_-]+)*(?:{_ASIDE_NAMES})(?:[_-]+(?:{_ASIDE_NAMES}|{_BOX_NAMES}))*(?!\S)", re.I)
#: Headers are left out around an article, not in it; what holds the whole page is judged by no name.
_HEADER_WORDS = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
_WHOLE = frozenset(("html", "body", "main"))
#: Names that tell of a page's state, not of what an element is.
_STATES = re.compile(r"(?<!\S)(?:(?:with|without|no|has)[_-]\S+|\S+[_-](?:open|closed))(?!\S)", re.I)
#: A name excludes no element with paragraphs that holds such a share of a page's text.
NAMED_SHARE = 0.9


class Page:
    """Texts of a page: (path, text, block number, aside?, in article?), and how often each tag path occurs."""

    def __init__(self, source: str):
        self.texts: list[tuple[str, str, int, bool, bool]] = []
        self.tags: Counter[str] = Counter()
        # of each element: tag, path, aside by tag?, in article?, the elements around it whose names say aside
        stack: list[tuple[str, str, bool, bool, tuple[int, ...]]] = [("", "", False, False, ())]
        chains: list[tuple[int, ...]] = []
        n_named, with_article, with_paragraph = 0, set(), set()
        block, at = 0, 0

        def text(raw: str) -> None:
            if raw:
                decoded = html.unescape(raw)
                words = " ".join(decoded.split())
                edges = (" " if decoded[:1].isspace() else "") + words + (" " if decoded[-1:].isspace() and words else "")
                _, path, aside, article, chain = stack[-1]
                self.texts.append((path, edges or " ", block, aside, article))
                chains.append(chain)

        for m in _PIECE.finditer(source):
            text(source[at : m.start()])
            at = m.end()
            if m.group(3) is None:
                continue
            name, closing = m.group(3).lower(), m.group(2)
            if name in BLOCKS:
                block += 1
            elif name == "br":
                self.texts.append((stack[-1][1], " ", block, stack[-1][2], stack[-1][3]))
                chains.append(stack[-1][4])
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                continue
            if name in _CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] in BLOCKS:
                        break
            attributes = m.group(4)
            names = " ".join("".join(x) for x in _NAMES.findall(attributes))
            path = f"{stack[-1][1]}/{name}" + (f".{names}" if names else "")
            self.tags[path] += 1
            inside = stack[-1][3]
            said = _STATES.sub(" ", names)
            named = said and name not in _WHOLE and (_ASIDE_IN_ARTICLE.search(said) if inside else _ASIDE_WORDS.search(said) or _HEADER_WORDS.search(said))
            aside = stack[-1][2] or name in _ASIDE_TAGS or (name == "header" and not inside) or bool(_HIDDEN.search(attributes))
            if name not in VOID and not attributes.endswith("/"):
                chain = (*stack[-1][4], n_named) if named else stack[-1][4]
                n_named += bool(named)
                if name in ("article", "main") and not inside and not aside:
                    with_article.update(chain)
                elif name in ("p", "h1"):
                    with_paragraph.update(chain)
                stack.append((name, path, aside, inside or name in ("article", "main"), chain))
        text(source[at:])
        if n_named:
            kept = self._kept(chains, with_article, with_paragraph)
            self.texts = [(p, t, b, aside or not kept.issuperset(chain), inside) for (p, t, b, aside, inside), chain in zip(self.texts, chains, strict=True)]

    def _kept(self, chains: list[tuple[int, ...]], with_article: set[int], with_paragraph: set[int]) -> set[int]:
        """The elements that are kept though their names say aside: those with nearly all text, and those around or on
        articles with half of the articles' text, or all of these if no other article is left."""
        total = articles = free = 0
        weight, in_articles = Counter(), Counter()
        for (_, t, _, aside, inside), chain in zip(self.texts, chains, strict=True):
            n = 0 if aside else len(t.strip())
            total += n
            weight.update(dict.fromkeys(chain, n))
            if inside:
                articles += n
                in_articles.update(dict.fromkeys(chain, n))
                free += 0 if chain else n
        kept = {i for i in with_paragraph if weight[i] and weight[i] >= NAMED_SHARE * total}
        return kept | {i for i in with_article if not free or 2 * in_articles[i] >= articles}


def token(*parts: str) -> int:
    """A 64-bit number for a token."""
    return int.from_bytes(blake2b("\x00".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _host_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, token, around, count) for all tokens of pages (host, html): around is the token of the element that a
    token lies in (null at the root and for texts outside of all), page a hash of the page."""
    for batch in batches:
        hosts, pages, tokens, arounds, counts = [], [], [], [], []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = Page(source)
            tags = {p: token("tag", p) for p in page.tags}
            found = {(tags[p], tags.get(p.rpartition("/")[0]), True): n for p, n in page.tags.items()}
            texts = Counter((token("text", p, t.strip()), tags.get(p), False) for p, t, *_ in page.texts if t != " ")
            for (own, around, _), n in (found | texts).items():
                tokens.append(own), arounds.append(around), counts.append(n)
            hosts.extend([host] * (len(tokens) - len(hosts)))
            pages.extend([token("page", source)] * (len(tokens) - len(pages)))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        columns = (hosts, pages, tokens, arounds, counts)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["host", "page", "token", "around", "count"])


def classes(pages: DataFrame) -> DataFrame:
    """(host, token, around, vector, n, outer_vector, n_outer): each token of pages (host, html) with its equivalence
    class and pages, and the class and pages of the element around it (at the root: no class, and all of the host's
    pages). Copies of a page are one page."""
    seen = written(pages.mapInArrow(_host_tokens, "host string, page long, token long, around long, count int").distinct(), "tokens")
    each = seen.groupBy("host", "token", "around").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("page", "count")).alias("vector"))
    each = written(each.where(F.col("n") >= CLASS_PAGES), "vectors")  # whatever is on fewer pages is in no template
    every = seen.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    outer = each.select("host", F.col("token").alias("around"), F.col("vector").alias("outer_vector"), F.col("n").alias("n_outer"))
    nested = each.join(outer, ["host", "around"], "left").join(every, "host")
    return nested.select("host", "token", "around", "vector", "n", "outer_vector", F.coalesce("n_outer", "pages").alias("n_outer"), F.col("n_outer").isNull().alias("outermost"))


def templates(pages: DataFrame, texts_share: float = CLASS_SHARE) -> DataFrame:
    """(host, token): the template of each host, from pages (host, html).

    A class is in it if it has CLASS_TOKENS tokens, and CLASS_PAGES pages. Its texts are if they stand on texts_share of
    the pages that have their element.
    """
    every = classes(pages)
    large = every.groupBy("host", "vector", "n").agg(F.count("*").alias("size")).where(F.col("size") >= CLASS_TOKENS)
    kept = every.join(large.select("host", "vector", "n"), ["host", "vector", "n"])
    # elements that others lie in are tags; a token around none is template like a text, by its share of the pages
    tags = kept.select("host", F.col("around").alias("token")).where("token is not null").distinct().withColumn("tag", F.lit(True))
    judged = kept.join(tags, ["host", "token"], "left")
    return judged.where(F.coalesce("tag", F.lit(False)) | (F.col("n") >= texts_share * F.col("n_outer"))).select("host", "token").distinct()


#: An element holds the article if it has such a share of what the template leaves; tags narrow it down to no less than
#: such a share of that.
SLOT_SHARE, TAG_SHARE = 2 / 3, 1 / 2
_ARTICLES = ("article", "main")


def main_text(source: str, template: frozenset[int]) -> str:
    """The article of a page, one line a block, by its host's template (tokens). Without a template, or where it leaves
    nothing, tags alone tell: the texts of <article> and <main>, else those of the innermost element with most of them."""
    page = Page(source)
    texts = [(p, t, b, inside) for p, t, b, aside, inside in page.texts if not aside]
    left = [x for x in texts if x[1] == " " or token("text", x[0], x[1].strip()) not in template]
    slots = _slots(left, template)
    blocks: dict[int, list[str]] = {}
    for _, t, b, *_ in _article(texts, left, slots):
        blocks.setdefault(b, []).append(t)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def _weights(texts: list) -> Counter[str]:
    """How much text lies in each element."""
    weight: Counter[str] = Counter()
    for p, t, *_ in texts:
        steps, n = p.split("/"), len(t.strip())
        for i in range(1, len(steps) + 1):
            weight["/".join(steps[:i])] += n
    return weight


def _slots(left: list, template: frozenset[int]) -> str | None:
    """The innermost template element whose slots hold SLOT_SHARE of the texts that are left; None if none tells more
    than the body."""
    weight = _weights(left)
    heavy = [p for p, n in weight.items() if p and n and n >= SLOT_SHARE * weight[""] and token("tag", p) in template]
    best = max(heavy, key=lambda p: (p.count("/"), weight[p]), default="")
    return best if best.rsplit("/", 1)[-1].split(".")[0] not in ("", "html", "body") else None


def _below(texts: list, element: str) -> list:
    return [x for x in texts if x[0] == element or x[0].startswith(element + "/")]


def _article(texts: list, left: list, slots: str | None) -> list:
    """The texts of the article, of all texts and of those that the template leaves."""
    tagged = [x for x in texts if x[3]]
    if slots is None:
        return tagged if any(t.strip() for _, t, *_ in tagged) else _densest(left)
    steps = slots.split("/")
    around = [i for i in range(len(steps), 0, -1) if steps[i - 1].split(".")[0] in _ARTICLES]
    if around:  # the slots lie in an article: it reaches as far as its tag
        return _below(texts, "/".join(steps[: around[0]]))
    inner = _below(left, slots)
    size = lambda found: sum(len(t.strip()) for _, t, *_ in found)
    if (own := size([x for x in inner if x[3]])) and own >= TAG_SHARE * size(inner):  # they are wider than the articles in them
        return [x for x in _below(texts, slots) if x[3]]
    return _below(texts, _wider(slots))


#: Elements that hold blocks of an article; running text and its parts lie in one of them.
_HOLDERS = frozenset("div section td body html center table tr tbody article main".split())


def _wider(element: str) -> str:
    """The innermost holder on or around an element."""
    while element and element.rsplit("/", 1)[-1].split(".")[0] not in _HOLDERS:
        element = element.rpartition("/")[0]
    return element


def _densest(left: list) -> list:
    """The texts of the innermost element with SLOT_SHARE of them."""
    weight = _weights(left)
    if not weight:
        return []
    best = max((p for p, n in weight.items() if n >= SLOT_SHARE * weight[""]), key=lambda p: (p.count("/"), weight[p]))
    return _below(left, _wider(best)) if best else left


def own_tokens(source: str) -> list[int]:
    """The tokens of a page that a template may have."""
    page = Page(source)
    return list({token("tag", p) for p in page.tags} | {token("text", p, t.strip()) for p, t, *_ in page.texts if t != " "})


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every row of pages, without html, with text: its main text ("" if none).

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments of readers and what lies outside of
    the article are left out. Character references are decoded, white space in a block is one space, blocks are
    joined by line feeds.

    Null html reads as empty. A null or hostless url is a host of its own kind (""). Hosts with fewer than CLASS_PAGES
    different pages have no template. Repeated rows come back each. An input column named text is replaced.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    source = F.coalesce(F.col(html_col), F.lit(""))
    kept = [c for c in replace_columns(pages, "text").columns if c != html_col]
    own, body, told, key = free_names(pages, "host", "html", "template", "key")
    frame = written(templates(pages.select(host.alias("host"), source.alias("html"))), "templates")
    small = frame.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS
    rows = pages.select(*kept, source.alias(body), host.alias(own))
    schema = T.StructType(rows.schema.fields[:-2]).add("text", "string")
    if small:
        at_hand: dict[str, set[int]] = {}
        for r in frame.collect():  # BROADCAST_TOKENS numbers
            at_hand.setdefault(r.host, set()).add(r.token)
        shared = pages.sparkSession.sparkContext.broadcast({h: np.array(sorted(x), np.int64) for h, x in at_hand.items()})
    else:
        rows = written(rows.withColumn(key, F.monotonically_increasing_id()), "pages")
        rows = rows.join(_in_template(rows, frame, own, body, key, told), key, "left").select(*kept, body, told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=KEPT_HOSTS)
        def of_host(name: str) -> frozenset[int]:
            return frozenset(shared.value.get(name, np.zeros(0, np.int64)).tolist())

        for batch in batches:
            n = batch.num_columns
            last = batch.column(n - 1).to_pylist()
            texts = [main_text(s, of_host(t) if small else frozenset(t or ())) for s, t in zip(batch.column(n - 2).to_pylist(), last, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _in_template(rows: DataFrame, frame: DataFrame, own: str, body: str, key: str, told: str) -> DataFrame:
    """(key, told): for each of rows those of its own tokens that are in its host's template (host, token). What a host's
    pages have in common is joined token by token, so no row or task gets a host's whole template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, h, s in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = own_tokens(s)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int64()), pa.array([h] * len(found), pa.string()), pa.array(found, pa.int64())], names=["page", "host", "token"])

    each = rows.select(key, own, body).mapInArrow(run, "page long, host string, token long")
    met = each.join(frame, ["host", "token"])
    return met.groupBy(F.col("page").alias(key)).agg(F.collect_list("token").alias(told))  # a page's own tokens at most
