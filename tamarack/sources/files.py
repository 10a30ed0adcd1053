"""Files as tables: texts, DOCX, benchmark cases; links of HTML pages."""

from __future__ import annotations

import html
import io
import re
import zipfile
from urllib.parse import unquote, urljoin, urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = (
    "id string, question string, jurisdiction string, language string, category string, difficulty string, "
    "expected_law string, expected_articles array<string>, must_contain_any array<string>"
)
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(content: bytes | None) -> str:
    """Paragraphs of a DOCX file, blank lines between; "" for what isn't one."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    lines = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p"))
    return "\n\n".join(x for x in lines if x.strip())


def _text_udf(f):
    def each(files: pd.Series) -> pd.Series:
        return files.map(f)

    return F.pandas_udf(each, "string")


def docx_text(content: Column | str) -> Column:
    return _text_udf(docx_paragraphs)(content)


def utf8_text(content: Column | str) -> Column:
    return _text_udf(lambda b: (b or b"").decode("utf-8", "replace"))(content)


def mime_of(path: Column) -> Column:
    """Kind of a file by its suffix."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kinds = {"docx": "docx", "doc": "text", "txt": "text", "md": "text", "csv": "text", "html": "html", "htm": "html", "pdf": "pdf"}
    return F.coalesce(*[F.when(suffix == s, F.lit(k)) for s, k in kinds.items()], F.lit("unsupported"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, checksum, text) of a folder's files; text is NULL where a kind has no extractor here."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = mime_of(F.col("path"))
    text = F.when(kind == "docx", docx_text("content")).when(kind.isin("text", "html"), utf8_text("content"))
    return files.select("path", kind.alias("kind"), F.sha2("content", 256).alias("checksum"), text.alias("text"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Retrieval benchmark cases from a JSON array, with defaults."""
    cases = spark.read.schema(CASES).json(path, multiLine=True)
    defaults = {"jurisdiction": "laos", "language": "lo", "category": "general", "difficulty": "medium"}
    return cases.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


# What makes a link a document's.
DOCUMENT_PATHS, SEARCH_PATH, DOCUMENT_ENDINGS = ("/document/view/", "/storage/document/"), "/documents.search", ("pdf", "docx", "doc", "txt", "md")
_LINK_PARTS = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)a(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!/?a-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S | re.I)
_HREF = re.compile(r"(?:^|\s|/)href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def page_links(source: str | None, url: str | None) -> list[tuple[str, str]]:
    """(address, title) of a page's links in order: hrefs decoded and resolved against the page's address, the title is
    the text up to the link's end. A link that no end follows, or another begins before it, is none."""
    source, found, open_link, at = source or "", [], None, 0
    for m in _LINK_PARTS.finditer(source):
        if open_link is not None:
            open_link[1].append(html.unescape(source[at : m.start()]))
        at = m.end()
        if m.group(3) is None:
            continue
        if not m.group(2):
            href = next((html.unescape("".join(g or "" for g in h.groups())) for h in _HREF.finditer(m.group(3))), "")
            if href:
                try:
                    open_link = (urljoin(url or "", href), [])
                except ValueError:  # an address that can't be resolved
                    open_link = None
        elif open_link is not None:
            found.append((open_link[0], " ".join(" ".join(open_link[1]).split())))
            open_link = None
    return found


def leads_to_document(address: str, title: str) -> bool:
    """Whether a link's path says document, or its path or title names a document's ending."""
    try:
        path = unquote(urlsplit(address).path).casefold()
    except ValueError:
        return False
    if SEARCH_PATH in path:
        return False
    told = f"{path} {title.casefold()}"
    return any(p in path for p in DOCUMENT_PATHS) or told.endswith(DOCUMENT_ENDINGS) or any(f".{e}" in told for e in DOCUMENT_ENDINGS)


def document_links(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", limit: int = 50) -> DataFrame:
    """(page_id, ord, link, title): the first `limit` different document links of each page (letter case aside), in order."""

    def links(urls: pd.Series, sources: pd.Series) -> pd.Series:
        out = []
        for u, s in zip(urls, sources, strict=True):
            first: dict[str, tuple[str, str]] = {}
            for link, title in page_links(s, u):
                if leads_to_document(link, title):
                    first.setdefault(link.casefold(), (link, title))
            out.append([{"link": link, "title": title} for link, title in list(first.values())[:limit]])
        return pd.Series(out)

    found = F.pandas_udf(links, "array<struct<link:string,title:string>>")(url, html)
    return pages.select(page_id, F.posexplode(found).alias("ord", "x")).select(page_id, F.col("ord").cast("long").alias("ord"), "x.link", "x.title")


def file_name(url: Column, fallback: str = "remote-document") -> Column:
    """The last part of an address's path, decoded; the fallback if there is none."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    name = F.trim(F.coalesce(F.try_url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B"))), F.lit("")))
    return F.when(name == "", F.lit(fallback)).otherwise(name)
