"""Small static dimensions: markers by family, books, and references with exceptions. Verse counts are read from a file."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The markers of the grammar by the shape of their tokens.
# followed by white space and an optional value up to the line's end
VALUED = "id ide usfm h toc1 toc2 toc3 mt mt1 mt2 mt3 mte ms ms1 ms2 mr s s1 s2 s3 s4 s5 sr sts r cl cp fr fk ft fq fqa fv fdc xo xq xt +xt d sp rq rem is is1 is2 is3 imt imt1 imt2 imt3 periph".split()
# followed by white space
PLAIN = """p pc pi pi1 pi2 cls b ca va vp k q q1 q2 q3 q4 qa qac qc qm qm1 qm2 qm3 qr qs qt nb m mi fp xdc wj tl sc it bd bdit li li1 li2 li3 li4 add nd pn w
tr th1 th2 th3 th4 th5 th6 thr1 thr2 thr3 thr4 thr5 thr6 tc1 tc2 tc3 tc4 tc5 tc6 tcr1 tcr2 tcr3 tcr4 tcr5 tcr6 ip ipi im imi iot io io1 io2 ior ie bk pm pmo pmc pmr""".split()
# followed by white space and an optional plus sign
CALLERS = "f fe x".split()
# followed by white space, a number or range, and white space
NUMBERED = "c v".split()
# that end with a star
ENDED = "ca va vp k qs qt f fe fqa fv fdc x xdc xt +xt wj tl sc it bd bdit add nd pn rq w ior bk".split()

# Families that the checks tell apart.
FAMILIES = {
    "text": "text",
    "verse": "v",
    "chapter": "c",
    "label": "cl",
    "id": "id",
    "paragraph": "p pi pc nb m",
    "poetry": "q q1 q2 q3 qr qc",
    "acrostic": "qa",
    "section": "s s1 mr ms ms1 sp s5",
    "descriptive": "d",
    "blank": "b",
    "title": "h toc1 toc2 toc3 mt mt1 imt imt1",
    "footnote": "f f* fe fe* fr fk ft fq fqa fqa* fv fv* fdc fdc* fp rq rq*",
    "special": "wj add nd pn qt k",
    "crossref": "x x* xo xt +xt",
    "intro": "is is1 ip ipi iot io io1 im",
    "version": "usfm",
    "unknown": "unknown",
}
#: Category that each family sets: what stands directly before a token.
CATEGORY = {"paragraph": "PP", "descriptive": "PP", "poetry": "QQ", "section": "S", "blank": "B", "chapter": "C", "verse": "OTHER", "text": "OTHER", "title": "OTHER"}

# The books, in order: id, English name, chapters. The canonical number of a book is its place, plus one from the fortieth on.
BOOKS = """GEN Genesis 50|EXO Exodus 40|LEV Leviticus 27|NUM Numbers 36|DEU Deuteronomy 34|JOS Joshua 24|JDG Judges 21|RUT Ruth 4|1SA 1 Samuel 31|2SA 2 Samuel 24|1KI 1 Kings 22|2KI 2 Kings 25|1CH 1 Chronicles 29|2CH 2 Chronicles 36|EZR Ezra 10|NEH Nehemiah 13|EST Esther 10|JOB Job 42|PSA Psalms 150|PRO Proverbs 31|ECC Ecclesiastes 12|SNG Song of Solomon 8|ISA Isaiah 66|JER Jeremiah 52|LAM Lamentations 5|EZK Ezekiel 48|DAN Daniel 12|HOS Hosea 14|JOL Joel 3|AMO Amos 9|OBA Obadiah 1|JON Jonah 4|MIC Micah 7|NAM Nahum 3|HAB Habakkuk 3|ZEP Zephaniah 3|HAG Haggai 2|ZEC Zechariah 14|MAL Malachi 4
MAT Matthew 28|MRK Mark 16|LUK Luke 24|JHN John 21|ACT Acts 28|ROM Romans 16|1CO 1 Corinthians 16|2CO 2 Corinthians 13|GAL Galatians 6|EPH Ephesians 6|PHP Philippians 4|COL Colossians 4|1TH 1 Thessalonians 5|2TH 2 Thessalonians 3|1TI 1 Timothy 6|2TI 2 Timothy 4|TIT Titus 3|PHM Philemon 1|HEB Hebrews 13|JAS James 5|1PE 1 Peter 5|2PE 2 Peter 3|1JN 1 John 5|2JN 2 John 1|3JN 3 John 1|JUD Jude 1|REV Revelation 22"""
PERIPHERALS = "FRT BAK OTH INT".split()

# References that some manuscripts lack, those that follow them, and very short verses.
OPTIONAL = "MAT 17:21|MAT 18:11|MAT 23:14|MRK 7:16|MRK 9:44|MRK 9:46|MRK 16:9|MRK 16:10|MRK 16:11|MRK 16:12|MRK 16:13|MRK 16:14|MRK 16:15|MRK 16:16|MRK 16:17|MRK 16:18|MRK 16:19|MRK 16:20|MRK 11:26|MRK 15:28|LUK 17:36|LUK 23:17|JHN 5:4|JHN 7:53|JHN 8:1|ACT 8:37|ACT 15:34|ACT 24:7|ACT 28:29|ROM 16:24|REV 12:18".split("|")
AFTER_OPTIONAL = "MAT 17:22|MAT 18:12|MAT 23:15|MRK 7:17|MRK 9:45|MRK 9:47|MRK 11:27|MRK 15:29|LUK 17:37|LUK 23:18|JHN 5:5|ACT 8:38|ACT 15:35|ACT 24:8|ACT 28:30|ROM 16:25".split("|")
SHORT = "LEV 11:15|EXO 20:13|EXO 20:14|EXO 20:15|DEU 5:17|DEU 5:18|DEU 5:19|JOB 3:2|JOB 9:1|JOB 12:1|JOB 16:1|JOB 19:1|JOB 21:1|JOB 27:1|JOB 29:1|LUK 20:30".split("|")
COUNT_MAY_DIFFER = "REV 12:18|3JN 1:15|2CO 13:13|ACT 19:40".split("|")


def book_rows() -> list[tuple[str, str, int, str, int]]:
    rows = []
    for k, item in enumerate(re.split(r"[|\n]", BOOKS), 1):
        book, rest = item.split(" ", 1)
        name, chapters = rest.rsplit(" ", 1)
        rows.append((book, name, int(chapters), f"{k if k < 40 else k + 1:02d}", k))
    return rows + [(p, p, 0, f"{k:02d}", k) for k, p in zip(("A0", "A1", "A2", "A7"), PERIPHERALS, strict=True) for k in [100 + PERIPHERALS.index(p)]]


def books(spark: SparkSession) -> DataFrame:
    """(id, en_name, chapters, usfm_number, sort): 70 rows."""
    return spark.createDataFrame(book_rows(), "id string, en_name string, chapters int, usfm_number string, sort int")


def chapter_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(book, chapter, n_verses) from a versification file: lines of a book id and ``chapter:verses`` pairs; # starts a comment."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    pairs = lines.select(F.regexp_extract("value", r"^\s*(\w{3})\s", 1).alias("book"), F.explode(F.regexp_extract_all("value", F.lit(r"(\d+:\d+)"))).alias("p"))
    return pairs.where("book <> ''").select("book", F.split("p", ":")[0].cast("int").alias("chapter"), F.split("p", ":")[1].cast("int").alias("n_verses"))


def references(spark: SparkSession, path: str) -> DataFrame:
    """(ref) from a text file of one reference a line, as of the verses that are often footnoted."""
    return spark.read.text(path).select(F.trim("value").alias("ref")).where("ref <> ''").distinct()


def markers(spark: SparkSession) -> DataFrame:
    """(type, family, category, is_end, has_value): a row for each marker of the grammar."""
    family = {m: f for f, ms in FAMILIES.items() for m in ms.split()}
    rows = [(m, family.get(m, "other"), CATEGORY.get(family.get(m)), m.endswith("*"), m in VALUED) for m in [*VALUED, *PLAIN, *CALLERS, *NUMBERED, *(e + "*" for e in ENDED), "text", "unknown", "\\\\"]]
    return spark.createDataFrame(rows, "type string, family string, category string, is_end boolean, has_value boolean")
