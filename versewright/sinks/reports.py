"""Writers: reports as ordered DataFrames and single text files, project lists, books, and chunked XML containers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def file_name(books: DataFrame) -> DataFrame:
    """books with the file name that a marked book has: its number and id."""
    return books.withColumn("file_name", F.format_string("%s-%s.usfm", "usfm_number", "id"))


def issue_lines(issues: DataFrame, summary: DataFrame) -> DataFrame:
    """(part, ord, line): reported issues in order, then the summary, most frequent first."""
    listed = issues.where("reported").select(F.lit(1).alias("part"), F.struct("path", F.coalesce("idx", F.lit(-1)).alias("idx"), F.col("error_id").cast("string").alias("id"), "msg").alias("ord"), "msg")
    top = summary.select(F.lit(2).alias("part"), F.struct(F.lit("").alias("path"), (-F.col("n")).cast("int").alias("idx"), F.coalesce(F.col("error_id").cast("string"), F.lit("~")).alias("id"), "msg").alias("ord"), F.concat("msg", F.lit(" --- "), F.col("n").cast("string")).alias("msg"))
    return listed.unionByName(top).select("part", "ord", F.col("msg").alias("line")).orderBy("part", "ord")


def word_lines(words: DataFrame) -> DataFrame:
    """(line): words in order of their lower case without leading apostrophes, counts, and the reference of single ones."""
    return words.orderBy(F.lower(F.regexp_replace("word", "^'+", "")), "word").select(F.concat_ws("\t", "word", F.col("n").cast("string"), "ref").alias("line"))


def project_entries(projects: DataFrame) -> DataFrame:
    """(sort, line): YAML entries of (title, id, sort, path), in order; titles with an apostrophe are quoted doubly."""
    title = F.when(F.col("title").contains("'"), F.concat(F.lit('"'), "title", F.lit('"'))).otherwise(F.concat(F.lit("'"), "title", F.lit("'")))
    kind = F.when(F.col("sort") < 40, "bible-ot").otherwise("bible-nt")
    text = F.concat(F.lit("  -\n    title: "), title, F.lit("\n    versification: ufw\n    identifier: '"), F.lower("id"), F.lit("'\n    sort: "), F.col("sort").cast("string"), F.lit("\n    path: './"), "path", F.lit("'\n    categories: [ '"), kind, F.lit("' ]"))
    return projects.select("sort", text.alias("line")).orderBy("sort")


def contributors(manifests: DataFrame) -> DataFrame:
    """(name): distinct contributors in order."""
    return manifests.select(F.explode("translators").alias("name")).where("trim(name) <> ''").distinct().orderBy("name")


def sources_used(manifests: DataFrame) -> DataFrame:
    """Distinct source texts by language, resource and version."""
    return manifests.select(F.explode("sources").alias("s")).select("s.*").dropDuplicates(["language_id", "resource_id", "version"])


def paragraph_counts(books: DataFrame) -> DataFrame:
    """(path, paragraphs, poetry, chapters, low): marks counted by their beginnings, and whether there are few per chapter."""
    n = lambda p: F.regexp_count("content", F.lit(p))
    p, q, c = n(r"\\p"), n(r"\\q"), n(r"\\c ")
    return books.select("path", p.alias("paragraphs"), q.alias("poetry"), c.alias("chapters"), F.coalesce((F.try_divide(p, c) <= 2.5) & (F.try_divide(q, c) <= 15), F.lit(False)).alias("low"))


def label_inventory(context: DataFrame) -> DataFrame:
    """(label, n): chapter labels without their numbers, most frequent first."""
    label = F.trim(F.regexp_replace("value", r"\p{Nd}+", ""))
    return context.where("type = 'cl'").groupBy(label.alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def footnoted_json(refs: DataFrame) -> DataFrame:
    """(json): one list of references in the order of their first occurrence; a corpus has some hundred."""
    return refs.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("first", "ref"))), lambda x: x["ref"])).alias("json"))


def write_lines(lines: DataFrame, path: str, column: str = "line", one_file: bool = True) -> None:
    """Text in the order of the rows: one file, as reports are small, or as many as there are partitions, named in order."""
    rows = lines.select(column)
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").text(path)


def write_books(books: DataFrame, path: str) -> None:
    """(file_name, content) as text files in a folder a book; inputs are never overwritten. A book's last line feed is the file's."""
    books.select(F.regexp_replace("content", r"\n\z", "").alias("value"), "file_name").write.mode("overwrite").partitionBy("file_name").text(path)


def usx_chunks(context: DataFrame) -> DataFrame:
    """(path, book, file, content): XML chunk files of books, NN/VV.usx, and titles of chapters and books.

    A file starts at each chapter (01) and at the first verse after a chunk mark. Paragraph and section marks are left
    out, footnotes become notes.
    """
    w = Window.partitionBy("path").orderBy("idx")
    kind, value = F.col("type"), F.col("value")
    fresh = kind.isin("c", "s5").cast("int")
    rows = context.where(F.col("chapter") > 0).withColumn("part", F.sum(fresh).over(w))
    piece = (
        F.when(kind == "v", F.concat(F.lit('<verse number="'), value, F.lit('" style="v" />')))
        .when((kind == "text") & (F.col("verse") > 0), F.concat(_escaped(value), F.lit("\n\n")))
        .when(kind == "f", F.lit('<note style="f" caller="+"> '))
        .when(kind.isin("ft", "fqa"), F.concat(F.lit('<char style="'), kind, F.lit('">\n'), _escaped(F.coalesce(value, F.lit(""))), F.lit(" </char>\n")))
        .when(kind == "f*", F.lit("</note>\n"))
    )
    first = F.min(F.when(kind == "v", F.split("value", "-")[0].try_cast("int")))
    files = rows.groupBy("path", "book", "chapter", "part").agg(first.alias("v"), F.max((kind == "c").cast("int")).alias("opens"), F.sort_array(F.collect_list(F.struct("idx", piece.alias("t")))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: F.coalesce(x["t"], F.lit(""))), "")
    wide = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    number = F.when(F.col("opens") == 1, F.lit("01")).otherwise(wide(F.col("v")))
    chunks = files.where("v is not null or opens = 1").select("path", "book", F.concat(wide(F.col("chapter")), F.lit("/"), number, F.lit(".usx")).alias("file"), body.alias("content"))
    chunks = chunks.where("content <> ''")
    label = F.coalesce(F.max(F.when(kind == "cl", value)), F.first("chapter").cast("string"))
    titles = context.where(F.col("chapter") > 0).groupBy("path", "book", "chapter").agg(label.alias("content")).select("path", "book", F.concat(wide(F.col("chapter")), F.lit("/title.usx")).alias("file"), "content")
    named = context.where(kind.isin("h", "toc1", "toc2", "mt")).groupBy("path", "book").agg(F.max_by("value", F.struct(~F.col("value").rlike(r"^[\x00-\x7F]*$"), kind == "mt", -F.col("idx"))).alias("content"))
    front = named.select("path", "book", F.lit("front/title.usx").alias("file"), "content")
    return chunks.unionByName(titles).unionByName(front)


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@dataclass(frozen=True)
class Container:
    """What is said of all containers of a translation. chunks_url: where chunk lists are, with {book} for the book's id."""

    language: str
    day: int
    language_name: str | None = None
    direction: str | None = None
    bible: str = "bible"
    bible_name: str | None = None
    pub_date: str | None = None
    license: str | None = None
    version: str | None = None
    chunks_url: str | None = None


def package_json(template: str, language: str, book: str, title: str, day: int, sort: int | None = None, about: Container | None = None) -> str:
    """A container's package file from a template: language, book, title and date (yyyymmdd) in place of the template's, and what else is known."""
    p, about = json.loads(template), about or Container(language, day)
    testament = None if sort is None else "bible-ot" if sort < 40 else "bible-nt"
    new = {
        "language": {"slug": language, "name": about.language_name, "direction": about.direction},
        "project": {"slug": book.lower(), "name": title, "sort": sort, "chunks_url": about.chunks_url and about.chunks_url.format(book=book.lower()), "category_slug": testament, "categories": testament and [testament]},
        "resource": {"slug": about.bible if sort is not None else None, "name": about.bible_name},
    }
    status = {"pub_date": about.pub_date, "license": about.license, "version": about.version}
    for part, values in [*new.items(), ("status", status)]:
        known = {k: v for k, v in values.items() if v is not None}
        if known:
            (p.setdefault("resource", {}) if part == "status" else p).setdefault(part, {}).update(known)
    p["modified_at"] = day
    return json.dumps(p, ensure_ascii=False, indent=2, sort_keys=True)


# What a container takes over from the one of another language.
TAKEN = ("LICENSE.md", "content/config.yml", "content/toc.yml")


def container_files(context: DataFrame, books: DataFrame, templates: DataFrame, about: Container) -> DataFrame:
    """(folder, file, content): the containers of books: chunk files and titles, package.json, and what the templates give as it is.

    templates: files (book, file, content) of containers of another language; books without a package.json there have none.
    """
    chunks = usx_chunks(context)
    folder = F.concat(F.lit(f"{about.language}_"), F.lower("book"), F.lit(f"_{about.bible}")).alias("folder")
    titles = chunks.where("file = 'front/title.usx'").select("book", F.col("content").alias("title"))
    known = templates.join(chunks.select("book").distinct(), "book", "left_semi")

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for contents, ids, names, sorts in batches:
            yield pd.Series([package_json(c, about.language, b, t, about.day, int(n), about) for c, b, t, n in zip(contents, ids, names, sorts, strict=True)], dtype=object)

    named = known.where("file = 'package.json'").join(titles, "book", "left").join(F.broadcast(books.select(F.col("id").alias("book"), "sort")), "book")  # 70 rows
    package = named.select(folder, "file", F.pandas_udf(run, "string")("content", "book", F.coalesce("title", F.lit("")), "sort").alias("content"))
    return chunks.select(folder, F.concat(F.lit("content/"), "file").alias("file"), "content").unionByName(known.where(F.col("file").isin(*TAKEN)).select(folder, "file", "content")).unionByName(package)


def settings_xml(text: str, suffix: str) -> str:
    """Naming attributes of a settings file set to the usual form, the rest as it is."""
    import re

    values = {"PrePart": "", "PostPart": suffix, "BookNameForm": "41-MAT"}
    for name, value in values.items():
        text = re.sub(rf'({name}=)"[^"]*"', rf'\1"{escape(value)}"', text)
    return text

