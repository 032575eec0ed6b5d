"""Validation of marked text: numbered checks as filters that yield issues.

An issue is (path, ref, idx, error_id DECIMAL(4,1), msg, reported). Checks of one level are conditions over the same rows
and come out of one pass: each row makes an array of its issues, which is exploded. Options switch checks off, or keep
them in the summary only (reported = false).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import cleanup as cl
from ..functions import dims, rules
from ..functions import text as tx
from . import tokens as tk

ISSUE = "error_id decimal(4,1), msg string, reported boolean"


@dataclass(frozen=True)
class Options:
    """What to leave out. summary_only: checks that count but aren't reported."""

    numbers: bool = True
    punctuation: bool = True
    paragraph_order: bool = True
    verse_counts: bool = True
    straight_quotes: bool = True
    upper_titles: bool = True
    ascii_text: bool = True
    mixed_case: bool = True
    summary_only: frozenset = field(default_factory=frozenset)  # of check numbers as strings, such as "44"
    aligned: bool = False
    version: int = 2
    standard_titles: tuple = ()


def issue(number: str, when: Column, *msg, options: Options = Options()) -> Column:
    """An issue where the condition holds, else null. msg: strings are themselves, columns are columns."""
    parts = [m if isinstance(m, Column) else F.lit(m) for m in msg]
    body = F.struct(F.lit(number).cast("decimal(4,1)").alias("error_id"), F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).alias("msg"), F.lit(number not in options.summary_only).alias("reported"))
    return F.when(F.coalesce(when, F.lit(False)), body)


def found(rows: DataFrame, issues: list[Column], ref: str = "ref") -> DataFrame:
    """The issues of each row, in the order given."""
    arr = F.filter(F.array(*issues), lambda i: i.isNotNull())
    idx = F.col("idx") if "idx" in rows.columns else F.lit(None).cast("int")
    made = rows.select("path", F.col(ref).alias("ref"), idx.alias("idx"), arr.alias("found"))
    return made.select("path", "ref", "idx", F.explode("found").alias("i")).select("path", "ref", "idx", "i.*")


def context_of(s: Column, pattern: str) -> Column:
    """The match of a pattern with the rest of the words it touches."""
    return F.regexp_extract(s, rf"(\S*(?:{pattern})\S*)", 1)


def text_issues(s: Column, ref: Column, o: Options) -> list[Column]:
    """Checks of punctuation and stray characters in one text."""
    W, S = tx.WORD, r"\s"
    i = lambda n, c, *m: issue(n, c, *m, options=o)
    mark = F.regexp_extract(s, r"([.?!;:,][^\s\u200b\)\]'\"’”»›])", 1)
    ellipsis = F.regexp_extract(s, r"(?s)[.?!;:,][^\s\u200b\)\]'\"’”»›].{0,2}", 0)
    suspicious = (mark != "") & ((F.substring(ellipsis, 1, 3) != "...") | (F.substring(ellipsis, 1, 4) == "....")) & ~mark.rlike("^[,.][0-9]")
    colon_number = mark.rlike("^:[0-9]")
    floating = s.rlike(rf"{S}[\[\]\('\"«“‘’”»›]{S}") | s.rlike(rf"^[\('\"«“‘’”»›]{S}") | s.rlike(rf"{S}[\('\"«“‘’”»›]$")
    medial = F.regexp_extract(s, rf"({W}[.?!;:,()\[\]\"«“‘”»›][.?!;:,()\[\]'\"«“‘”»›]*{W})", 1)
    out = [
        i("55", s.contains("<") & ~s.contains(">") & s.contains("<< HEAD"), "Unresolved translation conflict near ", ref),
        i("56", s.contains("<") & ~s.contains(">") & ~s.contains("<< HEAD"), "Angle bracket not closed at ", ref),
        i("57", s.contains("Conflict Parsing Error"), "Editor artifact in ", ref),
        i("58", s.rlike(r"(?s)^\s*[.,;:!?].?$"), "Orphaned punctuation at ", ref),
        i("58.1", s.rlike(r"(?s)^\s*[.,;:!?]") & ~s.rlike(r"(?s)^\s*[.,;:!?].?$"), "Text begins with phrase-ending punctuation in ", ref),
    ]
    if o.punctuation and not o.aligned:
        outside = F.regexp_extract(s, r"(['\"’”»›][.!])", 1)
        out += [
            i("45", suspicious & ~colon_number, "Check the punctuation at ", ref, ": ", mark),
            i("46", suspicious & colon_number & ~F.col("in_footnote") & ~F.coalesce(F.col("prev_type").rlike("^(io|ip)"), F.lit(False)), "Untagged footnote (probable) at ", ref, ": ", context_of(s, r":[0-9]")),
            i("48", s.rlike(rf"{S}[.?!;:,)’”»›]"), "Space before phrase ending mark at ", ref, ": ", F.regexp_extract(s, rf"{S}([.?!;:,)’”»›])", 1)),
            i("49", floating, "Free floating mark at ", ref),
            i("50", (outside != "") & ~s.rlike(r"['\"’”»›]\.\.\."), "Punctuation after quote mark at ", ref, ": ", outside),
            i("51", s.contains("''") | s.contains('""'), "Repeated quotes at ", ref),
            i("52", (medial != "") & ~medial.rlike("[0-9]$"), "Word medial punctuation in ", ref, ": ", context_of(s, rf"{W}[.?!;:,()\[\]\"«“‘”»›]+{W}")),
            i("52.1", s.contains("/"), "Forward slash in ", ref),
            i("52.2", s.contains("\\"), "Backslash in ", ref),
            i("52.3", s.contains("="), "Equals sign (=) in ", ref),
        ]
    return out


def number_issues(s: Column, o: Options) -> list[Column]:
    """Checks of numbers in one text: verse numbers, references, digits that touch letters, spaces and zeros."""
    if not o.numbers:
        return []
    ref, verse = F.col("ref"), F.col("verse").cast("string")
    i = lambda n, c, *m: issue(n, c, *m, options=o)
    live = (F.col("chapter") > 0) & ~F.col("in_footnote") & ~F.coalesce(F.col("type").isin("ft", "fr", "fq", "fqa", "fk"), F.lit(False))
    starts = live & s.startswith(F.concat(verse, F.lit(" ")))
    loose = F.regexp_extract_all(s, F.lit(r"(?<=[^\p{Nd}(])(\p{Nd}+)(?=[^\p{Nd},])"))
    possible = F.filter(loose, lambda n: (n == verse) | (n == (F.col("verse") + 1).cast("string")))
    numbered = starts | (live & (F.size(possible) > 0))
    pairs = F.regexp_extract_all(s, F.lit(r"(\p{Nd}+[:\-]\p{Nd}+)"))
    likely = F.filter(pairs, lambda p: p.contains(":") | (F.element_at(F.split(p, "-"), -1).try_cast("int") > F.split(p, "[:-]")[0].try_cast("int")))
    referred = live & ~numbered & (F.size(likely) > 0)
    flagged = numbered | referred
    embed = F.regexp_extract(s, r"([^\s,:.\p{Nd}(\[\-]+\p{Nd}+[^\s,;.\p{Nd})\]]+)", 1)
    suffix = F.regexp_extract(s, r"(\p{Nd}+[^\s,;:.\-?!\"\p{Nd})\]])", 1)
    prefix = F.regexp_extract(s, r"([^\s,.\p{Nd}(\[]\p{Nd}+)", 1)
    long_ = F.regexp_extract(s, r"(\p{Nd}{4,})", 1)
    apart = F.regexp_extract(s, r"(\p{Nd}+[.,]?\s[.,]?\p{Nd}+)", 1)
    zero = F.regexp_extract(s, r"(\s0[0-9,]*)", 1)
    return [
        i("59", starts, "Verse number in text (probable): ", ref),
        i("59.1", live & ~starts & (F.size(possible) > 0), "Possible verse number (", F.try_element_at(possible, F.lit(1)), ") in text at ", ref),
        i("59.2", referred, "Likely verse reference (", F.try_element_at(likely, F.lit(1)), ") in text at ", ref),
        i("60", embed != "", "Embedded number in word: ", embed, " at ", ref),
        i("60.2", (embed == "") & ~flagged & (suffix != "") & live, "Invalid number suffix: ", suffix, " at ", ref),
        i("60.1", (embed == "") & ~flagged & (prefix != "") & (live | ~prefix.rlike("^[:-]")), "Invalid number prefix: ", prefix, " at ", ref),
        i("61", F.length(long_) > 4, "Unsegmented number: ", long_, " at ", ref),
        i("61.1", apart != "", "Space between digits ", apart, " at ", ref),
        i("61.2", (apart == "") & (zero != ""), "Invalid leading zero: ", zero, " at ", ref),
    ]


def token_issues(context: DataFrame, books: DataFrame, footnoted: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """Checks of single tokens with the state before them."""
    o, kind, value, ref, prev = options, F.col("type"), F.col("value"), F.col("ref"), F.col("prev_category")
    i = lambda n, c, *m: issue(n, c, *m, options=o)
    fam, is_in = tk.in_family, lambda names: F.col("ref").isin(names)
    rows = context.join(F.broadcast(books.select(F.col("id").alias("book"), F.col("chapters").alias("n_chapters"))), "book", "left")  # 70 rows
    if footnoted is not None:
        rows = rows.join(footnoted.select("ref", F.lit(True).alias("often")), "ref", "left")
    else:
        rows = rows.withColumn("often", F.lit(False))
    often = F.coalesce(F.col("often"), F.lit(False)) | is_in(dims.OPTIONAL)
    text = kind == "text"
    spoken = F.when(text, value).when(fam("footnote") & (value != "+"), value)
    paragraphs = fam("paragraph", "poetry", "descriptive")
    own = F.when(fam("paragraph"), "PP").when(fam("poetry") | (kind == "qa"), "QQ").when(kind == "b", "B").when(kind == "c", "C")
    chapter, before = F.col("chapter"), F.coalesce(F.col("prev_chapter"), F.lit(0))
    after_verse = text & (F.col("prev_type") == "v")
    plain_parens = F.regexp_count(value, F.lit(r"\([\p{Nd}, ]{0,11}\)"))
    bracket = F.regexp_extract(value, r"\[ *([^\]]+) *\]", 1)
    first = tx.first_word(value)
    caps = F.col("sentence_end") & (F.substring(first, 1, 1) != F.upper(F.substring(first, 1, 1)))
    in_title = fam("title")
    seen = Window.partitionBy("path").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    first_upper = F.coalesce(F.max((in_title & tx.is_upper("value")).cast("int")).over(seen), F.lit(0)) == 0
    carrier = F.coalesce(F.col("prev_type").isin([m for f in ("special", "crossref", "poetry", "intro", "footnote", "acrostic", "blank") for m in dims.FAMILIES[f].split()] + ["m"]), F.lit(False))
    checks = [
        i("62", own.isNotNull() & (own == prev), "Back to back markers of type ", kind, " at ", ref),
        i("13.1", (kind == "c") & ((chapter < 1) | (chapter > F.coalesce("n_chapters", F.lit(0)))), "Invalid chapter number (", value, ") is found"),
        i("13", (kind == "c") & F.col("book").isNull(), "Missing ID before chapter: ", value),
        i("14", (kind == "c") & (chapter < before), "Chapter out of order: ", ref),
        i("15", (kind == "c") & (chapter == before), "Duplicate chapter: ", ref),
        i("16", (kind == "c") & (chapter > before + 2), "Missing chapters before: ", ref),
        i("17", (kind == "c") & (chapter == before + 2), "Missing chapter(s) before ", ref),
        i("18", kind.isin("f", "rq") & F.col("in_note"), "Footnote starts before previous one is terminated at ", ref),
        i("19", (kind == "fe") & F.col("in_endnote"), "Endnote starts before previous one is terminated at ", ref),
        i("20", kind == "fe", "Warning: endnote \\fe ... \\fe* at ", ref, " may break other converters."),
        i("21", kind.isin("fr", "fk", "ft", "fq", "fqa", "fqa*", "fp", "fv", "fv*", "fdc", "fdc*") & ~F.col("in_footnote"), "Footnote marker (", kind, ") not between \\f ... \\f* pair at ", ref),
        i("22", (kind == "id") & (F.length(F.coalesce(value, F.lit(""))) < 3), "Invalid ID: ", value),
        i("29.5", fam("section") & (prev == "S"), "Back to back section markers after ", ref),
        i("30", kind.isin("mt", "mt1") & tx.is_ascii("value") & F.lit(o.ascii_text), "mt token has ASCII value in ", ref),
        i("31", in_title & tx.is_upper("value") & first_upper & F.lit(o.upper_titles), "Upper case book title in ", ref),
        i("31.1", in_title & value.startswith("Ii"), "Mixed case roman numerals in \\", kind, " field"),
        i("32", in_title & (prev == "B"), "\\b may not be used before or after titles or headings. ", ref),
        i("33", (kind == "v") & (prev == "B"), "\\b should be used only between paragraphs. ", ref),
        i("34", (kind == "v") & value.rlike("^.+-") & ~value.rlike("^[0-9]+-[0-9]+"), "Problem in verse range near ", ref),
        i("35", (kind == "v") & F.col("book").isNull(), "Missing ID before verse: ", value),
        i("36", (kind == "v") & (F.coalesce(chapter, F.lit(0)) == 0), "Missing chapter tag: ", ref),
        i("37", (kind == "v") & value.rlike("^1(-|$)") & F.col("need_paragraph"), "Need paragraph marker before: ", ref),
        i("38", (kind == "v") & F.col("need_poetry"), "Need \\q or \\p after acrostic heading before: ", ref),
        i("38.5", (kind == "v") & (prev == "S"), "Section heading should be followed by paragraph marker at ", ref),
        i("43", after_verse & value.rlike(r"\p{Nd}+\s*:\s*\p{Nd}+"), "Probable chapter:verse reference at ", ref, " belongs in a footnote"),
        i("43.1", after_verse & ~value.rlike(r"\p{Nd}+\s*:\s*\p{Nd}+") & often & value.rlike(r"[()\[]") & (F.regexp_count(value, F.lit(r"\(")) > plain_parens), "Bracket or parens found in ", ref, ", a verse that is often footnoted"),
        i("43.2", after_verse & ~value.rlike(r"\p{Nd}+\s*:\s*\p{Nd}+") & ~(often & value.rlike(r"[()\[]")) & value.contains("[") & ((bracket == "") | bracket.contains(" ")), "Optional text or untagged footnote at ", ref),
        i("44", text & ~F.col("in_footnote") & caps & (prev == "PP"), "First word of paragraph not capitalized near ", ref),
        i("44.1", text & ~F.col("in_footnote") & caps & (prev != "PP"), 'First word in sentence is not capitalized: "', first, '" at ', ref),
        i("53", text & ~F.col("text_okay") & ~carrier & value.startswith("\\"), "Uncommon or invalid marker near ", ref),
        i("54", text & ~F.col("text_okay") & ~carrier & ~value.startswith("\\"), "Missing verse marker or extra text near ", ref),
        i("54.1", text & F.col("text_okay") & (F.col("verse") == 0) & (chapter > 0), "Unmarked text before ", ref, ":1"),
        i("62.1", (kind == "c") & F.col("book").isNull(), "Missing book ID. Cannot check this file."),
        i("65", (kind == "unknown") & (value == "p"), "Orphaned paragraph marker after ", ref),
        i("66", (kind == "unknown") & (value == "v"), "Unnumbered verse after ", ref),
        i("67", (kind == "unknown") & ~value.isin("p", "v") & F.lit(o.version == 2), "Invalid USFM token (\\", value, ") near ", ref),
    ]
    if o.standard_titles:
        label = F.trim(F.regexp_replace(value, r"\p{Nd}+", ""))
        checks.append(i("42", (kind == "cl") & ~label.isin(*o.standard_titles), "Non-standard chapter label at ", ref, ": ", value))
    if o.paragraph_order:
        checks += [
            i("24", paragraphs & prev.isin("QQ", "PP"), "Warning: back to back paragraph/poetry markers near: ", ref),
            i("27", (fam("section") & (kind != "s5") | (kind == "d")) & (prev == "PP"), "Warning: useless paragraph (p,m,nb) marker before \\", kind, " marker at: ", ref),
            i("28", (fam("section") & (kind != "s5") | (kind == "d")) & (prev == "QQ"), "Warning: useless \\q before \\", kind, " marker at: ", ref),
            i("29", (fam("section") & (kind != "s5") | (kind == "d")) & (prev == "B"), "\\b may not be used before or after section heading. ", ref),
        ]
    checks += [
        i("25", (kind == "p") & (F.col("prev_type") == "v") & ~is_in(dims.OPTIONAL), "Paragraph marker after verse marker, or empty verse: ", ref),
        i("25.1", (kind == "nb") & (prev != "C"), "\\nb marker should follow chapter marker: ", ref),
    ]
    if o.punctuation and not o.aligned:
        checks += [
            i("26", fam("paragraph") & ~F.col("sentence_end") & (F.col("verse") > 0), "Check paragraph-ending punctuation at: ", ref),
            i("26.1", fam("paragraph") & ~F.col("sentence_end") & (F.col("verse") == 0) & (ref != "ACT 22"), "Punctuation missing at end of chapter before ", ref),
        ]
    spoken_rows = [F.when(spoken.isNotNull(), c) for c in [*text_issues(spoken, ref, o), *number_issues(spoken, o)]]
    return found(rows, checks + spoken_rows)


def verse_number_issues(context: DataFrame) -> DataFrame:
    """Verses out of order, twice, or missing: each number of each range against the one before it in the chapter."""
    lo, hi = F.split("value", "-")[0].try_cast("int"), F.element_at(F.split("value", "-"), -1).try_cast("int")
    marks = context.where((F.col("type") == "v") & lo.isNotNull() & hi.isNotNull())
    each = marks.select("path", "book", "chapter", "idx", F.coalesce("prev_verse", F.lit(0)).alias("prev_verse"), F.posexplode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array(hi))).alias("k", "verse"))
    last = F.when(F.col("k") > 0, F.col("verse") - 1).otherwise(F.col("prev_verse"))
    place = lambda v: F.concat(F.coalesce("book", F.lit("")), F.lit(" "), "chapter", F.when(v > 0, F.concat(F.lit(":"), v.cast("string"))).otherwise(F.lit("")))
    each = each.withColumn("last", last).withColumn("ref", place(F.col("verse"))).withColumn("last_ref", place(last))
    v, late = F.col("verse"), F.col("last")
    kind = F.when(v < late, "39").when(v == late, "40").when((v == late + 2) & ~F.col("ref").isin(dims.AFTER_OPTIONAL), "41").when(v > late + 2, "41.1")
    each = each.withColumn("kind", kind).where("kind is not null")
    # a reference is blamed once for what comes after it
    first = F.row_number().over(Window.partitionBy("path", "last_ref", F.col("kind") == "40").orderBy("idx", "k"))
    each = each.withColumn("nth", first).where("nth = 1 or kind = '40'")
    said = F.when(F.col("kind") == "39", F.concat(F.lit("Verse out of order: "), "ref", F.lit(" after "), "last_ref")).when(F.col("kind") == "40", F.concat(F.lit("Duplicated verse number: "), "ref")).otherwise(F.concat(F.when(F.col("kind") == "41", "Missing verse between: ").otherwise("Missing verses between: "), "last_ref", F.lit(" and "), "ref"))
    return each.select("path", "ref", "idx", F.col("kind").cast("decimal(4,1)").alias("error_id"), said.alias("msg"), F.lit(True).alias("reported"))


def verse_issues(verses: DataFrame, source: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """Empty, short, ASCII and untranslated verses. source: (ref, source_text) of the language translated from."""
    ref, n = F.col("ref"), F.col("length")
    i = lambda k, c, *m: issue(k, c, *m, options=options)
    must = ~ref.isin(dims.OPTIONAL)
    checks = [
        i("1", must & (n == 0), "Empty verse: ", ref),
        i("2", must & (n > 0) & (n < 11) & ~ref.isin(dims.SHORT), "Verse fragment: ", ref),
        i("3", F.col("is_ascii") & (n > 0) & F.lit(options.ascii_text), "Verse is entirely ASCII: ", ref),
    ]
    if source is not None:
        verses = verses.join(source, "ref", "left")
        checks.append(i("3.5", tx.shared_words("source_text", "text") > 0.4, "Verse may be untranslated (based on words in common): ", ref))
    return found(verses, checks)


def book_issues(context: DataFrame, books: DataFrame, lengths: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """Titles, labels, footnote pairs, chapter and verse counts of whole books; ids that several books have."""
    i = lambda k, c, *m: issue(k, c, *m, options=options)
    kind, value = F.col("type"), F.col("value")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    titles = F.collect_set(F.when(tk.in_family("title") & (kind != "toc3"), value))
    label = F.when(kind == "cl", F.trim(F.regexp_replace(value, r"\p{Nd}+", "")))
    b = context.groupBy("path").agg(
        F.max("book").alias("book"), F.max("chapter").alias("top"), F.max_by("chapter", "idx").alias("last_chapter"), titles.alias("titles"), F.count_distinct(label).alias("labels"), count(kind == "cl").alias("n_labels"),
        count(kind.isin("f", "rq")).alias("f1"), count(kind.isin("f*", "rq*")).alias("f2"), count(kind == "fe").alias("e1"), count(kind == "fe*").alias("e2"), count(kind == "toc3").alias("toc3"), F.max(F.when((kind == "c") & (value == "1"), True)).alias("one"),
        count(tk.in_family("paragraph", "poetry") & (kind != "nb")).alias("n_p"), count(tk.in_family("poetry")).alias("n_q"),
    )
    b = b.join(F.broadcast(books.select(F.col("id").alias("book"), "en_name", "chapters")), "book", "left").withColumn("ref", F.col("book"))  # 70 rows
    good_title = F.exists("titles", lambda t: (t != "") & (t != F.coalesce("en_name", F.lit(""))))
    checks = [
        i("5", F.col("one") & ~good_title, "Book title matches English: ", F.col("en_name")),
        i("6", F.col("labels") > 1, "Inconsistent chapter titling in ", F.col("book")),
        i("7", (F.col("n_labels") > 1) & (F.col("n_labels") < F.col("last_chapter")), "Some chapters do not have chapter labels but ", F.col("n_labels"), " do."),
        i("9", F.col("f1") != F.col("f2"), "Mismatched footnote tags (", F.col("f1"), " started and ", F.col("f2"), " ended) in ", F.col("book")),
        i("10", F.col("e1") != F.col("e2"), "Mismatched endnote tags (", F.col("e1"), " started and ", F.col("e2"), " ended) in ", F.col("book")),
        i("11", (F.col("book").isNull() | (F.coalesce("top", F.lit(0)) == 0)) & ~F.coalesce(F.col("book").isin("FRT", "BAK"), F.lit(False)), "File may be empty, or open in another program: ", F.col("path")),
        i("12", (F.col("chapters") > 0) & (F.col("last_chapter") != F.col("chapters")), "There should be ", F.col("chapters"), " chapters in ", F.col("book"), " but ", F.col("last_chapter"), " chapters are found."),
        i("73.5", (F.try_divide("n_p", "top") <= 2.5) & (F.try_divide("n_q", "top") <= 15), "Low paragraph count in ", F.col("book")),
        i("81", F.col("toc3") == 0, "No \\toc3 tag in ", F.col("path")),
    ]
    out = found(b, checks)
    ids = context.where(kind == "id").select("path", "idx", F.upper(F.substring(value, 1, 3)).alias("ref"))
    first = ids.groupBy("ref").agg(F.min(F.struct("path", "idx")).alias("first"))  # some 70 ids, and what is none
    again = ids.join(first, "ref").where(F.struct("path", "idx") != F.col("first"))
    out = out.unionByName(found(again, [i("23", F.lit(True), "Duplicate ID: ", F.col("ref"))]))
    if lengths is not None and options.verse_counts:
        ends = context.where((kind.isin("v", "c")) & (F.col("chapter") > 0)).groupBy("path", "book", "chapter").agg(F.max_by("verse", "idx").alias("verse"), F.max_by("ref", "idx").alias("ref")).join(lengths, ["book", "chapter"], "left")
        out = out.unionByName(found(ends, [i("8", (F.col("verse") != F.coalesce("n_verses", F.lit(0))) & ~F.col("ref").isin(dims.COUNT_MAY_DIFFER), "Chapter usually has ", F.coalesce("n_verses", F.lit(0)), " verses: ", F.col("ref"))]))
    return out


def file_issues(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Checks of whole files (path, content[, is_utf8]): marker slips, straight quotes, stray bytes, size."""
    c = F.col("content")
    i = lambda k, w, *m: issue(k, w, *m, options=options)
    doubles, singles = tx.straight_quotes("content")
    null_bytes = F.regexp_count(c, F.lit("\\x00"))
    checks = [
        i("74.1", ~c.startswith("\\id "), "File does not start with \\id"),
        i("75", (doubles + singles > 0) & F.lit(options.straight_quotes), "Straight quotes found: ", doubles, " double, ", singles, " single"),
        i("77", c.rlike(r"\\wj\s+\\wj\*"), "Empty \\wj pair"),
        i("78", c.rlike(r"(?m)\\$"), "Stranded backslash at the end of a line"),
        i("79", (null_bytes > 0) & (null_bytes < F.length(c)), "Null bytes in file"),
        i("79.1", (null_bytes > 0) & (null_bytes == F.length(c)), "File holds null bytes only"),
        i("80", F.length(c) < 100, "File has less than 100 characters"),
    ]
    if "is_utf8" in files.columns:
        checks.append(i("79.2", ~F.col("is_utf8"), "File isn't UTF-8"))
    files = files.withColumn("ref", F.lit(None).cast("string"))
    return found(files, checks).unionByName(slip_issues(files, options)).unionByName(orphan_issues(files, options))


# What keeps a text from being rewritten, or only looks odd: (pattern, what is said of it, whether it stops).
UNPARSEABLE = [(r"\\\s", "stranded backslash(es) followed by space or newline", False), (r"\\v +[-0-9]+[^-\s0-9]", "verse number(s) not followed by space", False), (r"\\[^a-z+]", "foreign usfm code(s)", True)]


def parse_problems(files: DataFrame, least: int = 1000) -> DataFrame:
    """(path, msg, stops) of files (path, content) that can't be rewritten, or look odd; one with fewer than ``least`` bytes is incomplete."""
    c = F.col("content")
    said = [F.when(c.rlike(p), F.struct(F.concat("path", F.lit(f" contains {m}: "), F.regexp_extract(c, f"({p})", 1)).alias("msg"), F.lit(stops).alias("stops"))) for p, m, stops in UNPARSEABLE]
    said.append(F.when(F.octet_length(c) < least, F.struct(F.concat("path", F.lit(" is incomplete, too small")).alias("msg"), F.lit(True).alias("stops"))))
    return files.select("path", F.explode(F.filter(F.array(*said), lambda x: x.isNotNull())).alias("p")).select("path", "p.*")


def parseable(files: DataFrame, least: int = 1000) -> DataFrame:
    """The files that nothing stops from being rewritten; null contents aren't among them."""
    return files.where("content is not null").join(parse_problems(files, least).where("stops").select("path"), "path", "left_anti")


# Numbers of the checks for slips in chapter and verse marks, what they look like, and what is said of them.
SLIPS = [
    ("69", r"[^\n](\\c\s*\p{Nd}+)", "Missing newline before chapter marker: "), ("70", r"(\\c[0-9]+)", "Missing space before chapter number: "), ("71", r"(\\c\s*\p{Nd}+)[^\p{Nd}\s]+[\n\r]", "Missing space after chapter number: "),
    ("72", r"([^\n\r\s]\\v\s*\p{Nd}+)", "Missing white space before verse marker: "), ("73", r"(\\v[0-9]+)", "Missing space before verse number: "), ("74", r"(\\v\s*[-0-9]+[^-\p{Nd}\s])", "Missing space after verse number: "),
]


def slip_issues(files: DataFrame, options: Options = Options()) -> DataFrame:
    """An issue for each slip of a chapter or verse mark in files (path, ref, content)."""
    of = lambda n, p: F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(1)), lambda h: F.struct(F.lit(n).alias("n"), h.alias("hit")))
    hits = F.flatten(F.array(*[of(n, p) for n, p, _ in SLIPS]))
    rows = files.select("path", "ref", F.explode(hits).alias("h")).select("path", "ref", "h.n", F.when(F.col("h.n") == "72", F.regexp_replace("h.hit", r"^[^ -~]", "")).otherwise(F.col("h.hit")).alias("hit"))
    return found(rows, [issue(n, F.col("n") == n, said, F.col("hit"), " in ", F.col("path"), options=options) for n, _, said in SLIPS])


def orphan_issues(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Lines without a mark that look like section titles, in files where such a line follows an empty one."""
    suspect = files.where(F.col("content").rlike(r"\n\n[^\\]"))
    lines = suspect.select("path", "ref", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    plain = lines.where(F.col("line").rlike(r"^[^\\]") & ~F.col("line").rlike(r"^<+ HEAD"))
    titled = rules.column(lambda s: s.istitle() or s.isupper() or rules.titlecase_share(s) > 0.5, "boolean")("line")
    return found(plain.where(titled), [issue("76", F.lit(True), "Possible section title at line ", F.col("at") + 1, " in ", F.col("path"), options=options)])


STRIP = ".,:;!?+-[]{}()<>\"“‘’”*/"


def word_list(context: DataFrame, strip: str = STRIP) -> DataFrame:
    """(word, n, ref): words of all texts without outer marks and without numbers; the reference of those that occur once."""
    words = context.where(F.col("type") == "text").select("ref", F.explode(tx.words("value")).alias("w"))
    words = words.select("ref", F.btrim("w", F.lit(strip)).alias("word")).where((F.col("word") != "") & ~F.col("word").rlike(r"\p{N}"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.min("ref").alias("ref")).withColumn("ref", F.when(F.col("n") == 1, F.col("ref")))


def mixed_case_issues(words: DataFrame, limit: int = 20) -> DataFrame:
    """Mixed-case words: single ones with their reference; rarer than five as one list, or a word that there are too many."""
    mixed = words.where("n < 5").where(rules.column(rules.is_mixed_case, "boolean")("word"))
    single = mixed.where("n = 1").select(F.lit(None).cast("string").alias("path"), "ref", F.lit(None).cast("int").alias("idx"), F.lit("0.1").cast("decimal(4,1)").alias("error_id"), F.concat(F.lit("Mixed case word in "), F.coalesce("ref", F.lit("")), F.lit(": "), "word").alias("msg"), F.lit(True).alias("reported"))
    several = mixed.where("n > 1").orderBy("word").limit(limit + 1).agg(F.sort_array(F.collect_list("word")).alias("w")).where(F.size("w") > 0)  # a top-k list by definition
    many = F.size("w") >= limit
    listed = several.select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("idx"), F.when(many, F.lit("0.3")).otherwise(F.lit("0.2")).cast("decimal(4,1)").alias("error_id"),
                            F.when(many, "Too many mixed case words; reporting cancelled").otherwise(F.concat(F.lit("Mixed case words occur more than once each: "), F.array_join("w", ", "))).alias("msg"), F.lit(True).alias("reported"))
    return single.unionByName(listed)


def summary(issues: DataFrame) -> DataFrame:
    """(error_id, msg, n): issues of each number by what their messages begin with, most frequent first, and the total."""
    each = issues.groupBy("error_id").agg(tx.longest_common_prefix("msg").alias("msg"), F.count("*").alias("n"))
    total = issues.agg(F.count("*").alias("n")).select(F.lit(None).cast(T.DecimalType(4, 1)).alias("error_id"), F.lit("TOTAL").alias("msg"), "n")
    return each.unionByName(total).orderBy(F.col("error_id").isNull(), F.desc("n"), "error_id")


def verify(files: DataFrame, books: DataFrame, lengths: DataFrame | None = None, footnoted: DataFrame | None = None, source: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """All issues of a folder of books (path, content). source: books of the language translated from.

    Whole-file checks see the text as it is, the others that of aligned books without its alignment. A book without an
    id isn't checked past its first chapter mark.
    """
    text = F.when(cl.is_aligned("content"), rules.column(cl.unalign)(F.when(cl.is_aligned("content"), F.col("content")))).otherwise(F.col("content"))
    context = tk.with_context(tk.tokens(files.select("path", text.alias("content"))))
    lost = F.max((F.col("type") == "c") & F.col("book").isNull()).over(Window.partitionBy("path").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    context = context.withColumn("lost", F.coalesce(lost, F.lit(False))).where("not lost").drop("lost").persist()
    other = None
    if source is not None:
        other = tk.verses(tk.with_context(tk.tokens(source.select("path", "content")))).groupBy("ref").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("source_text"))
    parts = [token_issues(context, books, footnoted, options), verse_number_issues(context), verse_issues(tk.verses(context), other, options), book_issues(context, books, lengths, options), file_issues(files, options)]
    if options.mixed_case:
        parts.append(mixed_case_issues(word_list(context)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.context = context  # kept, as most checks read it: context.unpersist() lets it go
    return out
