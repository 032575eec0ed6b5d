"""Readers: folders of marked text, plain text, chunks, JSON and YAML, and the XML and Word formats, as DataFrames.

Folders are read by Spark's binaryFile source, so that any store that Spark reaches will do; what follows is columns and
Arrow-batched functions. Every reader gives a path, so that order between files is by path.
"""

from __future__ import annotations

import codecs
import io
import json
import re
import xml.sax
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as tx
from ..operators import tokens as tk


def folder(spark: SparkSession, path: str, suffix: str = "sfm", case_sensitive: bool = False, recursive: bool = True) -> DataFrame:
    """(path, name, raw) of the files below a folder whose names end in a suffix; hidden files and folders are left out."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*")
    names = F.regexp_extract("path", r"([^/]+)$", 1)
    flag = "" if case_sensitive else "(?i)"
    files = read.load(path).select("path", names.alias("name"), F.col("content").alias("raw"))
    return files.where(F.col("name").rlike(f"{flag}{re.escape(suffix)}$") & ~F.col("path").rlike(HIDDEN))


HIDDEN = r"/\.[^/]+"


def count_files(files: DataFrame, pattern: str) -> DataFrame:
    """(n): of files (path) those whose name in lower case begins with a pattern; hidden ones and those in hidden folders don't count."""
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    return files.where(~F.col("path").rlike(HIDDEN) & name.rlike(f"^(?:{pattern})")).agg(F.count("*").alias("n"))


def count_folders(files: DataFrame, pattern: str) -> DataFrame:
    """(n): of the folders that files (path) lie in the outermost ones whose path has a pattern in it; what is in them doesn't count again."""
    parts = F.split(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    found = files.where(~F.col("path").rlike(HIDDEN)).select(F.try_element_at(F.filter(above, lambda x: x.rlike(pattern)), F.lit(1)).alias("folder"))
    return found.where("folder is not null").agg(F.count_distinct("folder").alias("n"))


def decoded(files: DataFrame) -> DataFrame:
    """files with content (UTF-8, no byte order mark, line feeds) and is_utf8; other bytes become replacement marks."""
    return files.withColumn("is_utf8", F.is_valid_utf8("raw")).withColumn("content", tx.normalize_newlines(F.make_valid_utf8(F.col("raw").cast("string")))).drop("raw")


def usfm(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, name, is_utf8, content) of a folder of books."""
    return decoded(folder(spark, path, **options))


def lines(books: DataFrame, content: str = "content") -> DataFrame:
    """(path, idx, line) without line ends; a last empty line isn't one."""
    parts = F.split(F.col(content), "\n")
    own = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return books.where(F.col(content).isNotNull() & (F.col(content) != "")).select("path", F.posexplode(own).alias("idx", "line"))


def joined(rows: DataFrame) -> DataFrame:
    """Inverse of lines: (path, content)."""
    got = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("idx", "line"))).alias("l"))
    return got.select("path", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"))


def by_bom(files: DataFrame) -> DataFrame:
    """files with content decoded by the byte order mark in front: UTF-8, -16 or -32; UTF-8 without one."""
    marks = [(codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
    read = lambda raw: raw.decode(next((e for m, e in marks if raw.startswith(m)), "utf-8"), "replace")
    return files.withColumn("content", rules.column(lambda raw: read(bytes(raw)))("raw")).drop("raw")


def has_bom(raw) -> Column:
    """Whether bytes start with a byte order mark."""
    return F.hex(F.substring(raw, 1, 4)).rlike("^(EFBBBF|FFFE|FEFF|0000FEFF)")


# chunked text: book/chapter/chunk.txt


def chunk_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, book, chapter, start, text): text files named by chunk in folders named by chapter, chapter 00 apart."""
    place = lambda k: F.regexp_extract("path", r"([^/]+)/(\d{2,3})/(\d{2,3})\.txt$", k)
    files = usfm(spark, path, suffix=".txt").where(F.col("path").rlike(r"/(?!00/)\d{2,3}/\d{2,3}\.txt$"))
    return files.select("path", place(1).alias("book"), place(2).cast("int").alias("chapter"), place(3).cast("int").alias("start"), F.col("content").alias("text"))


def chunk_titles(spark: SparkSession, path: str) -> DataFrame:
    """(book, title): first lines of front/title.txt or 00/title.txt, in title case; front wins."""
    files = usfm(spark, path, suffix="title.txt").where(F.col("path").rlike(r"/(front|00)/title\.txt$"))
    first = rules.column(lambda s: (s.splitlines() or [""])[0].strip().title())
    got = files.select(F.regexp_extract("path", r"([^/]+)/(front|00)/title\.txt$", 1).alias("book"), F.col("path").contains("/00/").alias("late"), first("content").alias("title"))
    return got.groupBy("book").agg(F.min_by("title", "late").alias("title"))


def plain_books(spark: SparkSession, path: str) -> DataFrame:
    """(path, book, content) of plain text books named XXX.txt or NN-XXX.txt; issue lists are left out."""
    files = usfm(spark, path, suffix=".txt").where(~F.lower("name").startswith("issues"))
    return files.select("path", F.upper(F.regexp_extract("name", r"(?i)^(?:\d+-)?([1-3]?[A-Z]{2,3})\.txt$", 1)).alias("book"), "content").where("book <> ''")


# Fixed value: how book ids stand in the names of one editor's files.
NAMED_BOOK = r"0?[0-6][0-9]-?([123AC-EG-JL-PR-TZ][A-Z][A-Z])"


def book_of_name(name) -> Column:
    """The book id in a file name such as 41MATxyz.SFM, empty if there is none."""
    return F.regexp_extract(F.upper(tx.lit_or_col(name)), NAMED_BOOK, 1)


def match_names(files: DataFrame, books: DataFrame) -> DataFrame:
    """files (name) with the book whose English name, or number and name, the file name holds; the longest wins."""
    plain = lambda c: F.regexp_replace(F.lower(tx.roman_to_arabic(c)), "[^a-z0-9]", "")
    named = F.broadcast(books.select(F.col("id").alias("book"), "en_name", plain(F.col("en_name")).alias("key")))  # 70 rows
    hits = files.join(named, plain(F.col("name")).contains(F.col("key")), "left")
    best = hits.groupBy(*files.columns).agg(F.max_by("book", F.struct(F.length("key"), F.col("key"))).alias("book"))
    return best


# JSON and YAML


def json_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, translators, sources) of manifest.json files; translators may be names or records with a name."""
    schema = "struct<project:struct<id:string>,translators:array<string>,source_translations:array<struct<language_id:string,resource_id:string,version:string>>>"
    files = usfm(spark, path, suffix="manifest.json")
    got = files.select("path", F.from_json("content", schema).alias("m"))
    name = lambda t: F.coalesce(F.get_json_object(t, "$.name"), t)
    return got.select("path", F.col("m.project.id").alias("id"), F.transform("m.translators", name).alias("translators"), F.col("m.source_translations").alias("sources"))


def yaml_as_json(raw: bytes) -> str:
    """A YAML document as JSON; a syntax error as {"error": message with the line}."""
    import yaml

    try:
        return json.dumps(yaml.safe_load(raw.decode("utf-8-sig")), default=str, ensure_ascii=False)
    except (yaml.YAMLError, UnicodeDecodeError) as e:
        mark = getattr(e, "problem_mark", None)
        return json.dumps({"error": f"YAML syntax error at or before line {mark.line if mark else 0}"})


def yaml_files(spark: SparkSession, path: str, name: str = "manifest.yaml") -> DataFrame:
    """(path, has_bom, json) of YAML files."""
    return folder(spark, path, suffix=name).select("path", has_bom("raw").alias("has_bom"), rules.column(lambda r: yaml_as_json(bytes(r)))("raw").alias("json"))


def title_lines(books: DataFrame, first: int = 16) -> DataFrame:
    """(path, titles): the titles in the first lines of books."""
    top = lines(books).where(F.col("idx") < first)
    title = F.regexp_extract(F.trim("line"), r"^\\(?:h|mt|mt1|toc1|toc2) (.+)", 1)
    return top.groupBy("path").agg(F.collect_set(F.when(title != "", title)).alias("titles"))


# XML with mixed content

# Character styles whose text stays, and paragraph styles that go with what is in them.
KEPT_STYLES = frozenset("add k nd pn qac qs qt sig sls tl wj".split())


class _Usx(xml.sax.ContentHandler):
    """Tokens of the one-file-a-book XML format; the subtree of an element that isn't known is skipped."""

    def __init__(self):
        super().__init__()
        self.out: list[tuple[str, str | None]] = []
        self.ignored: list[str] = []
        self.stack: list[str] = []
        self.skip = 0
        self.text = ""

    def flush(self):
        if self.text.strip():
            self.out.append(("text", " ".join(self.text.split())))
        self.text = ""

    def startElement(self, name, attrs):
        self.flush()
        self.stack.append(name)
        if self.skip:
            return
        style = attrs.get("style", "")
        if name == "book":
            self.out.append(("id", attrs.get("code")))
        elif name in ("verse", "chapter"):
            if "number" in attrs:  # one without is the end of a verse or chapter
                self.out.append((style or name[0], attrs["number"]))
        elif name == "para" and not ((style.startswith("i") and style not in ("it", "id")) or style in ("mr", "r")):
            self.out.append((style, None))
        elif name not in ("usx",) and not (name == "char" and style in KEPT_STYLES):
            self.skip = len(self.stack)
            self.ignored.append(f"{name} {style}".strip())

    def endElement(self, name):
        if self.skip:
            self.text = ""
        else:
            self.flush()
        if self.skip == len(self.stack):
            self.skip = 0
        self.stack.pop()
        if name == "book" and not self.skip:
            self.out.append(("ide", "UTF-8"))

    def characters(self, content):
        if not self.skip:
            self.text += content


class _Usfx(xml.sax.ContentHandler):
    """Tokens of the many-books-a-file XML format; text counts inside words, additions and verses."""

    def __init__(self):
        super().__init__()
        self.out: list[tuple[str, str | None]] = []
        self.ignored: list[str] = []
        self.attrs: dict = {}
        self.text = ""
        self.name = ""

    def startElement(self, name, attrs):
        self.name, self.text = name, ""
        self.attrs[name] = dict(attrs)
        if name == "p" and not attrs.get("sfm"):
            self.out.append(("p", None))

    def endElement(self, name):
        a, text = self.attrs.get(name, {}), " ".join(self.text.split())
        if name == "id":
            self.out += [("id", f"{a.get('id', '')} {text}".strip()), ("ide", "UTF-8")]
        elif name == "h" and text:
            self.out.append(("h", text))
        elif name == "toc" and text and a.get("level"):
            self.out.append((f"toc{a['level']}", text))
        elif name == "p" and a.get("sfm") and text:
            self.out.append(("mt", text))
        elif name in ("c", "v"):
            self.out.append((name, a.get("id")))
        elif name in ("w", "add") and text:
            self.out.append(("text", text))
        elif name not in ("w", "ve", "add", "usfx", "languageCode", "book", "p", "h", "toc"):
            self.ignored.append(name)
        self.text = ""
        if name == "v":
            self.name = "v"

    def characters(self, content):
        if self.name == "v" and "v" in self.attrs and content.strip() and self.out and self.out[-1][0] in ("v", "text"):
            self.out.append(("text", " ".join(content.split())))
        else:
            self.text += content


def xml_tokens(files: DataFrame, kind: str = "usx") -> DataFrame:
    """(path, idx, type, value) of XML books (path, raw), kind usx or usfx; a syntax error is an ``error`` token, what is left out ``ignored`` ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                handler = _Usx() if kind == "usx" else _Usfx()
                try:
                    xml.sax.parseString(bytes(r.raw), handler)
                    found = handler.out + [("ignored", x) for x in dict.fromkeys(handler.ignored)]
                except xml.sax.SAXException as e:
                    found = [*handler.out, ("error", str(e))]
                rows += [(r.path, k, *t) for k, t in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "idx", "type", "value"])

    return files.select("path", "raw").mapInPandas(run, "path string, idx int, type string, value string")


def xml_books(files: DataFrame, kind: str = "usx") -> DataFrame:
    """(path, content): marked text of XML books."""
    return tk.written(xml_tokens(files, kind).where(~F.col("type").isin("ignored", "error")))


def docx_text(raw: bytes) -> str:
    """Paragraphs of a Word document, stripped, blanks collapsed, one to a line."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" if t.tag == ns + "t" else "\n" if t.tag == ns + "br" else "\t" for t in p.iter() if t.tag in (ns + "t", ns + "br", ns + "tab")) for p in root.iter(ns + "p"))
    return "\n".join(re.sub(" +", " ", p.strip()) for p in paragraphs)


def docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content) of Word documents, with a remark of where they come from in front."""
    files = folder(spark, path, suffix=".docx")
    return files.select("path", "name", F.concat(F.lit("\\rem Converted from "), "name", F.lit("\n"), rules.column(lambda r: docx_text(bytes(r)))("raw")).alias("content"))


def pdf(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content) of PDF files; needs the optional pdfminer library."""
    try:
        from pdfminer.high_level import extract_text
    except ImportError as e:
        raise RuntimeError("reading PDF needs pdfminer") from e
    files = folder(spark, path, suffix=".pdf")
    return files.select("path", "name", rules.column(lambda r: extract_text(io.BytesIO(bytes(r))))("raw").alias("content"))


def audio_urls(books: DataFrame, pattern: str) -> DataFrame:
    """(book, chapter, url): names of chapter recordings by a pattern of printf style over book and chapter. Nothing is fetched."""
    return books.where("chapters > 0").select(F.col("id").alias("book"), F.explode(F.sequence(F.lit(1), "chapters")).alias("chapter")).withColumn("url", F.format_string(pattern, "book", "chapter"))
