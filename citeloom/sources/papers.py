"""Metadata of papers in HTML, journal XML, TEI and DOCX files, read by real parsers.

Every reader takes a column (text, or binary for packages) and gives a struct with the same fields:
title, authors, abstract, year, doi, venue. What a file doesn't say is null (authors: empty); a file that
can't be parsed, is empty or null gives a struct without anything. Rows are parsed one by one
in Arrow batches; nothing is kept between them.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from citeloom.operators.batches import cuts

FIELDS = T.StructType([T.StructField(c, T.ArrayType(T.StringType()) if c == "authors" else T.StringType()) for c in ("title", "authors", "abstract", "year", "doi", "venue")])
_NOTHING = {"title": None, "authors": [], "abstract": None, "year": None, "doi": None, "venue": None}


def _reader(parse: Callable[[str | bytes], dict]) -> Callable[[Column], Column]:
    @F.pandas_udf(FIELDS)
    def read(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_NOTHING | parse(x) if x is not None and len(x) else _NOTHING for x in files], columns=list(_NOTHING))

    return read


# --- XML -----------------------------------------------------------------------------------------


def _root(xml: str | bytes) -> ElementTree.Element | None:
    """A document's root; a declaration of an encoding in decoded text says nothing."""
    try:
        return ElementTree.fromstring(re.sub(r"\A\ufeff?\s*<\?xml[^>]*\?>", "", xml) if isinstance(xml, str) else xml)
    except (ElementTree.ParseError, ValueError, LookupError):
        return None


def _all_text(element: ElementTree.Element | None) -> str | None:
    return "".join(element.itertext()).strip() or None if element is not None else None


def _first(root: ElementTree.Element, *paths: str) -> str | None:
    """All text of the first element on a path; the next path where that is empty."""
    return next((t for p in paths if (t := _all_text(root.find(p)))), None)


def parse_article(xml: str | bytes) -> dict:
    """Of journal XML, in any namespace. Only contributors marked as authors count, or, where there are none, author elements."""
    root = _root(xml)
    if root is None:
        return {}
    people = root.findall(".//{*}contrib[@contrib-type='author']") or root.findall(".//{*}author")
    names = [" ".join(filter(None, (_first(p, ".//{*}given-names"), _first(p, ".//{*}surname")))) for p in people]
    abstract = root.find(".//{*}abstract")
    return {
        "title": _first(root, ".//{*}article-title"),
        "authors": [n for n in names if n],
        "abstract": " ".join(t.strip() for t in abstract.itertext() if t.strip()) or None if abstract is not None else None,
        "year": _first(root, ".//{*}pub-date/{*}year", ".//{*}year"),
        "doi": _first(root, ".//{*}article-id[@pub-id-type='doi']", ".//{*}id[@pub-id-type='doi']"),
        "venue": _first(root, ".//{*}journal-title"),
    }


_TEI = "{http://www.tei-c.org/ns/1.0}"


def _tei(path: str) -> str:
    return re.sub(r"(?<![\w@'.])(?=[A-Za-z])", lambda _: _TEI, path)


def _own_text(elements: list[ElementTree.Element]) -> list[str]:
    """What stands in elements before any child."""
    return [e.text.strip() for e in elements if e.text and e.text.strip()]


def _year_of(dates: list[ElementTree.Element]) -> str | None:
    for d in dates:
        when = d.get("when")
        if when and when[:4].isdigit() and len(when) >= 4:
            return when[:4]
        if not when and (found := re.search(r"\b(?:19|20)\d{2}\b", d.text or "")):
            return found[0]
    return None


def _tei_name(author: ElementTree.Element) -> str | None:
    person = author.find(_tei(".//persName"))
    if person is not None:
        first, last = person.find(_tei("forename")), person.find(_tei("surname"))
        if first is not None and last is not None:
            name = " ".join(_own_text([first, last]))
            if name:
                return name
        elif own := _own_text([person]):
            return own[0]
    return next(iter(_own_text([author])), None)


def parse_tei(xml: str | bytes) -> dict:
    """Of a header in TEI. Authors are those of the file's own description, so cited ones don't count."""
    root = _root(xml)
    if root is None:
        return {}
    every = lambda *paths: [e for p in paths for e in root.findall(_tei(p))]
    title = root.find(_tei(".//titleStmt/title"))
    names = [n for a in every(".//fileDesc//author") if (n := _tei_name(a))] or _own_text(every(".//titleStmt//author"))
    venues = _own_text(every(".//monogr/title[@level='j']", ".//monogr/title[@level='m']", ".//monogr/title", ".//publisher"))
    dois = _own_text([e for e in every(".//idno") if e.get("type") == "DOI"])
    years = (_year_of(every(p)) for p in (".//publicationStmt/date", ".//biblStruct//date", ".//date"))
    return {"title": next(iter(_own_text([title] if title is not None else [])), None), "authors": names, "year": next(filter(None, years), None), "doi": next(iter(dois), None), "venue": next(iter(venues), None)}


def author_line(names: Column) -> Column:
    """Names in a row with 'and' before the last; null without any."""
    n = F.size(names)
    return F.when(n == 1, F.get(names, F.lit(0))).when(n > 1, F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(" and "), F.get(names, n - 1)))


# --- HTML ----------------------------------------------------------------------------------------

#: Elements without content, and elements whose content is no text of the page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset(("script", "style", "template"))


class _Page(HTMLParser):
    """Meta tags by name, and the texts of the title, the first heading and the first elements marked as the abstract."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, list[str]] = {}
        self.open: list[tuple[str, str | None]] = []
        self.texts: dict[str, list[str]] = {}
        self.parts: dict[str, int] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in attrs}
        if tag == "meta" and "name" in given:
            self.meta.setdefault(given["name"], []).append(given.get("content", "").strip())
        if tag in _VOID:
            return
        found = []
        if tag in ("title", "h1") and tag not in self.texts:
            found.append(tag)
        if given.get("id") == "abstract" and "id" not in self.texts:
            found.append("id")
        if "abstract" in given.get("class", "").split() and "class" not in self.texts:
            found.append("class")
        for kind in found:
            self.texts[kind] = []
        self.open.append((tag, ",".join(found)))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in reversed(range(len(self.open))) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        if not any(tag in _SILENT for tag, _ in self.open):
            for _, kinds in self.open:
                for kind in filter(None, kinds.split(",")):
                    self.texts[kind].append(data)


def parse_html(html: str | bytes) -> dict:
    """Of a page's citation tags; else the title from its title or first heading, and the abstract from what is marked as such."""
    page = _Page()
    page.feed(html.decode("utf-8", "ignore") if isinstance(html, bytes) else html)
    page.close()
    tag = lambda name: next(iter(page.meta.get(f"citation_{name}", [])), None) or None
    text = lambda kind, by: by.join(t.strip() for t in page.texts.get(kind, []) if t.strip()) or None
    title = "".join(page.texts.get("title", [])).strip()
    marked = "id" if "id" in page.texts else "class"
    return {"title": tag("title") or title or text("h1", ""), "authors": [a for a in page.meta.get("citation_author", []) if a], "abstract": tag("abstract") or text(marked, " "), "year": tag("publication_date"), "doi": tag("doi"), "venue": tag("journal_title")}


# --- DOCX ----------------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BODY = "word/document.xml"


def _line(paragraph: ElementTree.Element) -> str:
    """A paragraph's text; tabs and breaks are characters."""
    out = []
    for e in paragraph.iter():
        if e.tag == f"{_W}t":
            out.append(e.text or "")
        elif e.tag == f"{_W}tab" and not e.attrib:  # with attributes it is a tab stop of the paragraph's style
            out.append("\t")
        elif e.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out).strip()


def docx_lines(package: bytes) -> list[str] | None:
    """The paragraphs of a package, then the cells of its tables (a cell that spans columns once for each), without empty ones; null if it is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(package)) as z:
            body = ElementTree.fromstring(z.read(_BODY)).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error, OSError, NotImplementedError, RuntimeError, EOFError, ValueError):
        return None
    if body is None:
        return []
    lines = [_line(p) for p in body.findall(f"{_W}p")]
    for cell in body.findall(f"{_W}tbl/{_W}tr/{_W}tc"):
        span = cell.find(f"{_W}tcPr/{_W}gridSpan")
        lines += ["\n".join(_line(p) for p in cell.findall(f"{_W}p")).strip()] * int(span.get(f"{_W}val", "1") if span is not None else 1)
    return [x for x in lines if x]


def _people(text: str) -> list[str]:
    return [x.strip() for x in re.split(r",|;|\\\\|\band\b|\n", text, flags=re.I) if x.strip()]


def _after(lines: list[str], test: Callable[[str], bool]) -> str | None:
    """The line after the first that passes."""
    return next((lines[i + 1] for i in range(len(lines) - 1) if test(lines[i])), None)


def fields_of_lines(lines: list[str]) -> dict:
    """Of a manuscript's lines: the title first; authors, abstract and year where a line names them, else where they usually stand."""
    if not lines:
        return {}
    year = re.compile(r"\d{4}\Z")
    named = next((m for x in lines if (m := re.match(r"(?i)authors?(?:\(s\))?(?:\s*[:\-–—]\s*|(?<!\))\s+)(.+)\Z", x))), None)
    if named:
        authors = _people(named[1])
    else:
        below = _after(lines, lambda x: x.lower() == "authors")
        authors = _people(below) if below else _people(lines[1]) if len(lines) > 1 and re.search(r"[A-Za-z]+\s+[A-Za-z]+", lines[1]) else []
    abstract = None
    for i, x in enumerate(lines):
        if x.lower().startswith("abstract"):
            abstract = x.partition(":")[2].strip() or (lines[i + 1] if i + 1 < len(lines) else None)
            if abstract:
                break
    if abstract is None and len(lines) > 2 and not year.match(lines[2]):
        abstract = lines[2]
    said = (x.partition(":")[2].strip() if ":" in x else x for x in lines if x.lower().startswith("year"))
    below = (lines[i + 1] for i in range(len(lines) - 1) if lines[i].lower() == "year")
    when = next((y for y in (*said, *below, *lines) if year.match(y)), None)
    doi = re.search(r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+", "\n".join(lines))
    return {"title": lines[0], "authors": authors, "abstract": abstract, "year": when, "doi": doi[0] if doi else None}


def parse_docx(package: bytes) -> dict:
    return fields_of_lines(docx_lines(bytes(package)) or [])


def pack_docx(lines: list[str]) -> bytes:
    """A package with a paragraph for each line; the same lines give the same bytes."""
    from xml.sax.saxutils import escape

    clean = lambda x: escape(re.sub("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", " ", x))
    said = "".join(f'<w:p><w:r><w:t xml:space="preserve">{clean(x)}</w:t></w:r></w:p>' for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("[Content_Types].xml"), '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr(zipfile.ZipInfo(_BODY), f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{said}</w:body></w:document>', zipfile.ZIP_DEFLATED)
    return out.getvalue()


article, tei, page, docx = (_reader(f) for f in (parse_article, parse_tei, parse_html, parse_docx))


@F.arrow_udf(T.BinaryType())
def packed(lines: pa.Array) -> pa.Array:
    """Each array of lines as a package. Of a batch only few bytes are strings of Python at a time."""
    pack = lambda x: pack_docx([y or "" for y in x]) if x is not None else None
    pieces = [pa.array([pack(x) for x in lines.slice(a, b - a).to_pylist()], pa.binary()) for a, b in cuts(lines)]
    return pa.concat_arrays(pieces) if pieces else pa.array([], pa.binary())


_PARSERS = {"html": parse_html, "xml": parse_article, "tei": parse_tei, "docx": parse_docx}


@F.arrow_udf(FIELDS)
def by_kind(kinds: pa.Array, files: pa.Array) -> pa.Array:
    """Each file (binary) read as its kind says; nothing of kinds without a reader. Files become objects of Python one at a time."""
    told = (_NOTHING | (_PARSERS[k](x) if k in _PARSERS and x else {}) for k, x in ((k.as_py(), f.as_py()) for k, f in zip(kinds, files)))
    return pa.array(told, to_arrow_type(FIELDS))


def ended(html: Column) -> Column:
    """HTML without the leniency that reads a character's name where its semicolon is missing, as after a cut: such names, other than
    that of the ampersand itself, become text."""
    return F.regexp_replace(html, "&(?!amp)(?=#?[A-Za-z0-9]++(?!;))", "&amp;")


# --- what a file is ------------------------------------------------------------------------------


def kind_of_bytes(head: Column, path: Column) -> Column:
    """Which reader a file is for, by its first bytes; where these say nothing, by its extension."""
    text = F.lower(F.regexp_replace(F.decode(F.substring(head, 1, 512), "ISO-8859-1"), "^(\u00EF\u00BB\u00BF)?\\s*", ""))
    ext = F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))
    # A long name of a package's first members doesn't matter: a member is looked for in all bytes.
    office = F.instr(F.decode(head, "ISO-8859-1"), _BODY) > 0
    by_name = F.when(ext.isin("tex"), "latex").when(ext == "docx", "docx").when(ext.isin("xml", "nxml", "jats"), "xml").otherwise("unknown")
    return (
        F.when(F.startswith(text, F.lit("%pdf-")), "pdf")
        .when(F.hex(F.substring(head, 1, 4)) == "504B0304", F.when(office, "docx").otherwise("unknown"))
        .when(text.rlike("^(<!doctype html|<html)|^<\\?xml[^>]*>\\s*(<!doctype html|<html)"), "html")
        .when(text.rlike("^<\\?xml"), F.when(text.rlike("<tei[\\s>]"), "tei").otherwise("xml"))
        .when(text.rlike("^(%[^\\n]*\\n\\s*)*\\\\documentclass"), "latex")
        .when(F.startswith(text, F.lit("---")), "note")
        .otherwise(by_name)
    )
