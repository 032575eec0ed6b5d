"""Tokens, state, checks and transforms over small hand-made books."""

import json

import pytest
from pyspark.sql import functions as F

from versewright.functions import dims
from versewright.operators import checks, manifests, transforms
from versewright.operators import tokens as tk
from versewright.sinks import reports
from versewright.sources import files as fl

BOOK = "\\id GEN Genesis\n\\h Genesis\n\\toc3 gen\n\\mt Genesis\n\\c 1\n\\p\n\\v 1 In the beginning \\f + \\ft a note.\\f* it was\n\\v 2-3 And then , said 12345 x4y\n\\q1\n\\p\n\\v 5 more text [a b]. 1:2\n\\zz odd\n\\s Head\n\\v 5 again\n\\c 4\n\\v 1 no\n"


def books(spark, *contents):
    return spark.createDataFrame([(chr(97 + k), c) for k, c in enumerate(contents)], "path string, content string")


def context(spark, *contents):
    return tk.with_context(tk.tokens(books(spark, *contents)))


def test_tokens():
    assert [t[1:] for t in tk.tokenize("\\c 1\n\\v 2-3 Text \\f + \\ft n.\\f*\n\\q\n\\xyz a\\v 9")] == [
        ("c", "1"), ("v", "2-3"), ("text", "Text "), ("f", "+"), ("ft", "n."), ("f*", None), ("q", None), ("unknown", "xyz"), ("text", "a"), ("unknown", "v"), ("text", "9"),
    ]


def test_empty_and_null_books(spark):
    assert tk.tokens(books(spark, "", None)).count() == 0
    assert tk.with_context(tk.tokens(books(spark, None))).count() == 0


@pytest.mark.parametrize("s", ["\\id GEN\n\\c 1\n\\p\n\\v 1 One. \\wj Two\\wj* three\n\\q1\n\\v 2 Four\n", BOOK])
def test_writing_tokens_is_stable(s):
    once = tk.write_tokens([t[1:] for t in tk.tokenize(s)])
    assert tk.write_tokens([t[1:] for t in tk.tokenize(once)]) == once


def test_state_equals_a_fold(spark):
    got = context(spark, BOOK).orderBy("idx").collect()
    chapter = verse = 0
    notes = 0
    for r in got:
        assert r["in_footnote"] == (notes > 0)
        if r["type"] == "c":
            chapter, verse = int(r["value"]), 0
        elif r["type"] == "v":
            verse = int(r["value"].split("-")[-1])
        notes += (r["type"] == "f") - (r["type"] == "f*")
        assert (r["chapter"], r["verse"]) == (chapter, verse)


def test_issues(spark):
    found = checks.verify(books(spark, BOOK, BOOK), dims.books(spark), options=checks.Options(summary_only=frozenset({"26"})))
    ids = {(r["path"], str(r["error_id"])) for r in found.collect()}
    for e in "2.0 3.0 5.0 12.0 16.0 24.0 26.0 30.0 37.0 38.5 40.0 41.0 43.0 44.1 48.0 59.1 60.0 61.0 67.0".split():
        assert ("a", e) in ids, e
    assert ("b", "23.0") in ids and ("a", "23.0") not in ids
    assert {r["reported"] for r in found.where("error_id = 26").collect()} == {False}
    total = checks.summary(found).where("error_id is null").first()["n"]
    assert total == found.count()


def test_clean_book_has_few_issues(spark):
    s = "\\id RUT\n\\h Rut\n\\toc1 Rut\n\\toc3 rut\n\\mt1 Rút\n" + "".join(f"\\c {c}\n\\p\n\\v 1 Ünderway it was long ago.\n\\p\n\\v 2 Äfter that it went on.\n\\p\n\\v 3 Över and out at last.\n" for c in range(1, 5))
    found = checks.verify(books(spark, s), dims.books(spark)).collect()
    assert found == []


def test_verse_counts_and_source(spark, tmp_path):
    (tmp_path / "v.vrs").write_text("# counts\nGEN 1:3 2:2\nEXO 1:1\n")
    lengths = dims.chapter_lengths(spark, str(tmp_path / "v.vrs"))
    assert sorted(map(tuple, lengths.collect())) == [("EXO", 1, 1), ("GEN", 1, 3), ("GEN", 2, 2)]
    c = context(spark, "\\id GEN\n\\c 1\n\\p\n\\v 1 the same words here\n\\v 2 x\n")
    assert checks.book_issues(c, dims.books(spark), lengths).where("error_id = 8").count() == 1
    source = spark.createDataFrame([("GEN 1:1", "the same words here")], "ref string, source_text string")
    assert checks.verse_issues(tk.verses(c), source).where("error_id = 3.5").count() == 1


def test_file_checks(spark):
    files = spark.createDataFrame([("a", "no id \x00 \\c1 x\\v 2 \"q\" it's 'q'", True), ("b", "\x00" * 5, False)], "path string, content string, is_utf8 boolean")
    ids = {(r["path"], str(r["error_id"])) for r in checks.file_issues(files).collect()}
    assert {("a", "69.0"), ("a", "70.0"), ("a", "72.0"), ("a", "74.1"), ("a", "75.0"), ("a", "79.0"), ("a", "80.0"), ("b", "79.1"), ("b", "79.2")} <= ids


def test_each_slip_and_orphan_is_said(spark):
    content = "\\id GEN\n\\c1\n\\c 2a\n\\p x\\v 1 a\\v2 b\n\\v3\n\\v 4c\n\nThe Great Flood\nand it rained\nALL CAPS\n<<<<<<< HEAD\n"
    rows = checks.file_issues(spark.createDataFrame([("f", content), ("g", "The Great Flood")], "path string, content string")).where("error_id between 69 and 74 or error_id = 76").collect()
    assert sorted((r["path"], str(r["error_id"]), r["msg"]) for r in rows) == sorted(
        [("f", "70.0", "Missing space before chapter number: \\c1 in f"), ("f", "71.0", "Missing space after chapter number: \\c 2 in f"), ("f", "72.0", "Missing white space before verse marker: x\\v 1 in f"), ("f", "72.0", "Missing white space before verse marker: a\\v2 in f"),
         ("f", "73.0", "Missing space before verse number: \\v2 in f"), ("f", "73.0", "Missing space before verse number: \\v3 in f"), ("f", "74.0", "Missing space after verse number: \\v 4c in f"), ("f", "76.0", "Possible section title at line 8 in f"), ("f", "76.0", "Possible section title at line 10 in f")]
    )


def test_parseable(spark):
    files = spark.createDataFrame([("a", "x" * 1000), ("b", "x" * 999), ("c", "\\v 1x" * 300), ("d", "\\1" * 600), ("e", None), ("f", "é" * 500)], "path string, content string")
    assert sorted(r["path"] for r in checks.parseable(files).collect()) == ["a", "c", "f"]
    assert {r["path"] for r in checks.parse_problems(files).collect()} == {"b", "c", "d"}


def test_file_and_folder_counts(spark):
    paths = ["/r/en_ulb/01.usfm", "/r/en_ulb/sub/X.USFM", "/r/en_ulb/a.txt", "/r/.git/1.usfm", "/r/fr_ulb/.x.usfm", "/r/fr_ulb/2.usfm", "/r/other/3.usfm"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    assert fl.count_files(files, r".*\.usfm$").first()["n"] == 4
    assert fl.count_folders(files, "_ulb").first()["n"] == 2 and fl.count_folders(files, "nowhere").first()["n"] == 0


def test_notes_that_nest(spark):
    c = context(spark, "\\id GEN\n\\c 1\n\\p\n\\v 1 a \\fe + \\ft b \\fe + \\ft c\\fe* d\\fe* \\f + \\ft e \\f + \\ft g\\f*\\f*\n")
    found = checks.token_issues(c, dims.books(spark)).where("error_id in (18, 19)").groupBy("error_id").count().collect()
    assert {str(r["error_id"]): r["count"] for r in found} == {"18.0": 1, "19.0": 1}


def test_books_without_an_id_and_aligned_ones(spark):
    lost = "\\h x\n\\c 1\n\\c 9\n\\v 3 x\n"
    ids = [str(r["error_id"]) for r in checks.verify(books(spark, lost), dims.books(spark)).collect()]
    assert ids.count("62.1") == 1 and "35.0" not in ids and "16.0" not in ids
    plain = "\\id RUT\n\\h Rut\n\\toc3 rut\n\\mt1 Rút\n\\c 1\n\\p\n\\v 1 {}\n"
    aligned = plain.format('\\zaln-s |x-lemma="y"\\*\\w Ünder|lemma="u" x-occurrences="1"\\w*\\zaln-e\\* \\w way|lemma="w"\\w*.')
    text = lambda s: {(str(r["error_id"]), r["msg"]) for r in checks.verify(books(spark, s), dims.books(spark)).where("error_id not in (74.1, 75, 80)").collect()}
    assert text(aligned) == text(plain.format("Ünder way."))


def test_word_list(spark):
    c = context(spark, "\\id GEN\n\\c 1\n\\p\n\\v 1 One, two one. (Two) x2\n")
    assert sorted(map(tuple, checks.word_list(c).select("word", "n").collect())) == [("One", 1), ("Two", 1), ("one", 1), ("two", 1)]
    assert checks.mixed_case_issues(spark.createDataFrame([("aBc", 1, "GEN 1:1"), ("dEf", 3, None)], "word string, n long, ref string")).count() == 2


MODEL = "\\id GEN\n\\c 1\n\\s Start\n\\p\n\\v 1 One.\n\\q1\n\\v 2 Two.\n\\s5\n\\v 3 Three.\n\\p\n\\v 4 Four.\n"
TARGET = "\\id GEN Genesis\n\\h Genesis\n\\c 1\n\\v 1 Uno.\n\\v 2 Dos.\n\\v 3 Tres\n\\v 4 cuatro.\n"


def test_mark_paragraphs(spark):
    model = transforms.paragraph_model(context(spark, MODEL))
    out = transforms.mark_paragraphs(context(spark, TARGET), model).first()
    assert out["content"] == "\\id GEN Genesis\n\\h Genesis\n\\c 1\n\\p\n\\v 1 Uno.\n\\q1\n\\v 2 Dos.\n\\v 3 Tres\n\\v 4 cuatro.\n"
    assert out["changed"]
    loose = transforms.mark_paragraphs(context(spark, TARGET), model, sentence_sensitive=False).first()
    assert "\\p\n\\v 4" in loose["content"]


def test_chunks(spark):
    starts = transforms.chunk_starts(context(spark, MODEL))
    assert starts.first()["starts"] == [1, 3, 5]
    text = transforms.resource_container(context(spark, TARGET), starts).first()["content"]
    assert "\\s5\n\\v 3" in text and text.index("\\s5\n\\c 1") < text.index("\\v 1")
    a = spark.createDataFrame([("a", "GEN", 1, [1, 15, 20])], "path string, book string, chapter int, starts array<int>")
    m = spark.createDataFrame([("GEN", 1, [1, 5, 9, 16])], "book string, chapter int, starts array<int>")
    assert transforms.settle_chunks(a, m).first()["starts"] == [1, 5, 9, 15, 20]


def lines(spark, *ls):
    return spark.createDataFrame([("a", k, x) for k, x in enumerate(ls)], "path string, idx int, line string")


def test_footnotes(spark):
    out = transforms.integrate_footnotes(lines(spark, "\\c 1", "\\v 1 In the xa beginning", "\\footnote xa1:1 1:1 a note", "\\v 2 Next", "\\footnote Z2:1 end note", "\\footnote q9:9 lost")).orderBy("idx").collect()
    assert [r["line"] for r in out] == ["\\c 1", "\\v 1 In the  \\f + \\ft a note \\f*  beginning", "\\v 2 Next \\f + \\ft end note \\f* ", "\\footnote q9:9 lost"]
    assert [r[0] for r in transforms.footnote_references(context(spark, BOOK)).select("ref").collect()] == ["GEN 1:1"]


def test_line_filters(spark):
    rows = lines(spark, "\\v 1", "\\v 1 text", "\\v 2-4 range", "\\v 3", "\\v 7 ", "\\v 8 x")
    assert [r["idx"] for r in transforms.remove_duplicate_verses(rows).orderBy("idx").collect()] == [1, 2, 4, 5]
    assert [r["idx"] for r in transforms.remove_lines(rows).orderBy("idx").collect()] == [1, 2, 5]


def test_verse_marks():
    assert transforms.fix_verse_marks("/v 1 abc. \\v2 def\n\\v 3ghi v 4 .jkl") == "\\v 1 abc. \n\\v 2 def\n\\v 3 ghi.\n\\v 4 jkl"
    assert transforms.ensure_marks("1 abc 2 def", "1", [1, 2]) == "\\c 1\n\\v 1 abc\n\\v 2 def"
    assert transforms.fix_spacing("a , b.c 1.5") == "a, b. c 1.5"


def test_missing(spark):
    df = spark.createDataFrame([("\\v 1 a \\v 2-3 b 5", [1, 2, 3, 4, 5])], "t string, e array<int>")
    assert list(df.select(transforms.missing_verses("t", "e"), transforms.missing_marks("t", "e")).first()) == [[4], [4, 5]]


def test_plain_text(spark):
    text, notes = transforms.plain_book("GEN", ["Genesis", "Chapter 1", "1 In the beginning 2 and then", "3 more", "Chapter 2", "1 Again 3 third"], [3, 4])
    assert text.endswith("\\c 1\n\\cl Chapter 1\n\\p\n\\v 1 In the beginning\n\\v 2 and then\n\\v 3 more\n\\c 2\n\\cl Chapter 2\n\\p\n\\v 1 Again\n\\v 3 third\n")
    assert notes == ["Can't find GEN 2:2."]
    files = spark.createDataFrame([("a", "GEN", "Genesis\n1\n1 x"), ("b", "EXO", None)], "path string, book string, content string")
    assert transforms.plain_text(files, spark.createDataFrame([("GEN", 1, 1)], "book string, chapter int, n_verses int")).count() == 2


def test_clean_books(spark):
    out = transforms.clean_books(books(spark, '\\id GEN\n\\h GENESIS.\n\\c 1\n\\p\n\\s Head Line\n\\v 1 "hello there," he said .and went(away)\n')).first()
    assert out["changed"] and out["content"] == '\\id GEN\n\\h Genesis\n\\c 1\n\\s Head Line\n\\p\n\\v 1 “Hello there,” he said . And went (away)\n'


def test_assembly(spark):
    chunks = spark.createDataFrame([("GEN", 1, 3, "\\v 3 c"), ("GEN", 1, 1, "\\c 1 \\v 1 a \\v 2 b")], "book string, chapter int, start int, text string")
    out = transforms.assemble(chunks, dims.books(spark), spark.createDataFrame([], "book string, title string")).first()["content"]
    assert out.startswith("\\id GEN\n") and out.index("\\v 1") < out.index("\\v 3")
    lengths = spark.createDataFrame([("GEN", 1, 4)], "book string, chapter int, n_verses int")
    assert {r["start"]: r["expected"] for r in transforms.verse_ranges(chunks, lengths).collect()} == {1: [1, 2], 3: [3, 4]}


def test_assembly_of_whole_trees(spark):
    chunks = spark.createDataFrame([("GEN", 1, 1, "1 In the\tbeginning ,it\nwas 2 dark"), ("GEN", 1, 3, "/v 3 and   light\n\ncame"), ("GEN", 2, 1, "\\c2 \\v 1 x \\v 2 .y")], "book string, chapter int, start int, text string")
    lengths = spark.createDataFrame([("GEN", 1, 4), ("GEN", 2, 2)], "book string, chapter int, n_verses int")
    labels = spark.createDataFrame([("GEN", 1, "Chapter One"), ("GEN", 2, "2")], "book string, chapter int, title string")
    out = transforms.assemble(chunks, dims.books(spark), spark.createDataFrame([("GEN", "Kejadian")], "book string, title string"), lengths, labels, mark_chunks=True).first()["content"]
    head = "".join(f"\\{k} {v}\n" for k, v in (("id", "GEN"), ("ide", "UTF-8"), ("h", "Kejadian"), ("toc1", "Kejadian"), ("toc2", "Kejadian"), ("toc3", "gen"), ("mt", "Kejadian")))
    assert out.startswith(head) and out[len(head):].split("\n") == ["\\s5", "\\c 1", "\\cl Chapter One", "\\p", "\\v 1 In the beginning, it was", "\\v 2 dark", "\\s5", "\\v 3 and light", "came", "\\s5", "\\c 2", "\\p", "\\v 1 x.", "\\v 2 y", ""]


def test_sources(spark, tmp_path):
    (tmp_path / "b" / "01").mkdir(parents=True)
    (tmp_path / "b" / "front").mkdir()
    (tmp_path / "01-GEN.SFM").write_bytes(b"\xef\xbb\xbf\\id GEN\r\n\\c 1\r\\p\n")
    (tmp_path / "bad.sfm").write_bytes(b"\\id \x92")
    (tmp_path / "b" / "01" / "03.txt").write_text("three")
    (tmp_path / "b" / "front" / "title.txt").write_text("the book\nx")
    (tmp_path / "GEN.txt").write_text("Genesis")
    got = {r["name"]: (r["content"], r["is_utf8"]) for r in fl.usfm(spark, str(tmp_path)).collect()}
    assert got["01-GEN.SFM"] == ("\\id GEN\n\\c 1\n\\p\n", True) and not got["bad.sfm"][1]
    assert fl.usfm(spark, str(tmp_path), case_sensitive=True).count() == 1
    assert [(r["book"], r["chapter"], r["start"], r["text"]) for r in fl.chunk_tree(spark, str(tmp_path)).collect()] == [("b", 1, 3, "three")]
    assert fl.chunk_titles(spark, str(tmp_path)).first()["title"] == "The Book"
    assert fl.plain_books(spark, str(tmp_path)).first()["book"] == "GEN"
    back = fl.joined(fl.lines(fl.usfm(spark, str(tmp_path)).where("is_utf8"))).first()["content"]
    assert back == "\\id GEN\n\\c 1\n\\p\n"
    names = spark.createDataFrame([("41MATxyz.SFM",), ("readme.SFM",)], "name string")
    assert [r[0] for r in names.select(fl.book_of_name("name")).collect()] == ["MAT", ""]
    found = {r["name"]: r["book"] for r in fl.match_names(spark.createDataFrame([("I John.docx",), ("John 2.docx",)], "name string"), dims.books(spark)).collect()}
    assert found == {"I John.docx": "1JN", "John 2.docx": "JHN"}


USX = b'<usx version="2.5"><book code="GEN" style="id">x</book><para style="mt1">Genesis</para><para style="ip">intro</para><chapter number="1" style="c"/><para style="p"><verse number="1" style="v"/>In <char style="wj">the</char> text<note style="f">gone</note> on</para></usx>'


def test_xml(spark):
    files = spark.createDataFrame([("a", bytearray(USX)), ("b", bytearray(b"<usx>"))], "path string, raw binary")
    kinds = [r["type"] for r in fl.xml_tokens(files).where("path = 'a'").orderBy("idx").collect()]
    assert kinds.count("ignored") == 2 and "v" in kinds
    assert fl.xml_books(files).where("path = 'a'").first()["content"] == "\\id GEN x\n\\ide UTF-8\n\\mt1 Genesis\n\\c 1\n\\p\n\\v 1 In the text on\n"
    assert fl.xml_tokens(files).where("path = 'b' and type = 'error'").count() == 1
    usfx = b'<usfx><book id="GEN"><id id="GEN">Gen</id><h>Genesis</h><c id="1"/><p><v id="1"/><w>In</w> <w>all</w></p></book></usfx>'
    out = fl.xml_books(spark.createDataFrame([("a", bytearray(usfx))], "path string, raw binary"), "usfx").first()["content"]
    assert out.startswith("\\id GEN Gen\n\\ide UTF-8\n\\h Genesis\n") and "\\v 1 In all" in out


def test_sinks(spark):
    c = context(spark, "\\id GEN\n\\h Genesis\n\\c 1\n\\cl Chapter 1\n\\p\n\\v 1 One & two.\n\\s5\n\\v 2 Three \\f + \\ft n\\f*\n")
    files = {r["file"]: r["content"] for r in reports.usx_chunks(c).collect()}
    assert set(files) == {"01/01.usx", "01/02.usx", "01/title.usx", "front/title.usx"}
    assert '<verse number="1" style="v" />One &amp; two.' in files["01/01.usx"] and "</note>" in files["01/02.usx"]
    p = spark.createDataFrame([("Job's", "JOB", 18, "18-JOB.usfm"), ("Mat", "MAT", 40, "41-MAT.usfm")], "title string, id string, sort int, path string")
    entries = [r["line"] for r in reports.project_entries(p).collect()]
    assert '"Job\'s"' in entries[0] and "bible-ot" in entries[0] and "bible-nt" in entries[1]
    counts = reports.paragraph_counts(books(spark, "\\c 1\n\\p \\pi \\q", "none")).orderBy("path").collect()
    assert [tuple(r)[1:] for r in counts] == [(2, 1, 1, True), (0, 0, 0, False)]
    assert json.loads(reports.package_json('{"project": {"slug": "x"}}', "id", "GEN", "Kejadian", 20260101))["project"] == {"slug": "gen", "name": "Kejadian"}
    assert reports.settings_xml('<S PrePart="a" PostPart="b"/>', "ID.SFM") == '<S PrePart="" PostPart="ID.SFM"/>'
    assert [r["line"] for r in reports.word_lines(spark.createDataFrame([("b", 1, "R"), ("'A", 2, None)], "word string, n long, ref string")).collect()] == ["'A\t2", "b\t1\tR"]


def test_whole_containers(spark):
    c = context(spark, "\\id RUT\n\\h Rüt\n\\c 1\n\\p\n\\v 1 One.\n")
    templates = spark.createDataFrame([(b, f, t) for b in ("RUT", "GEN") for f, t in (("package.json", '{"language": {"slug": "en", "x": 1}, "resource": {"status": {"level": "3"}}}'), ("LICENSE.md", "free"), ("content/toc.yml", "- x"), ("content/01/01.usx", "no"))], "book string, file string, content string")
    about = reports.Container("xx", 20260101, "Exish", "rtl", "reg", "Regular", "2026-01-01", "CC", "2", "https://example.org/{book}.json")
    files = {(r["folder"], r["file"]): r["content"] for r in reports.container_files(c, dims.books(spark), templates, about).collect()}
    assert {f for _, f in files} == {"content/01/01.usx", "content/01/title.usx", "content/front/title.usx", "package.json", "LICENSE.md", "content/toc.yml"} and {d for d, _ in files} == {"xx_rut_reg"}
    assert files["xx_rut_reg", "LICENSE.md"] == "free" and "One." in files["xx_rut_reg", "content/01/01.usx"]
    p = json.loads(files["xx_rut_reg", "package.json"])
    assert p["language"] == {"slug": "xx", "name": "Exish", "direction": "rtl", "x": 1} and p["modified_at"] == 20260101
    assert p["project"] == {"slug": "rut", "name": "Rüt", "sort": 8, "chunks_url": "https://example.org/rut.json", "category_slug": "bible-ot", "categories": ["bible-ot"]}
    assert p["resource"] == {"slug": "reg", "name": "Regular", "status": {"level": "3", "pub_date": "2026-01-01", "license": "CC", "version": "2"}}


GOOD = {
    "dublin_core": {"conformsto": "rc0.2", "contributor": ["Some One"], "creator": "Some", "description": "d", "format": "text/usfm", "identifier": "ulb", "issued": "2026-01-01", "modified": "2026-01-02", "language": {"direction": "ltr", "identifier": "xx", "title": "Bähasa"},
                    "publisher": "Pub", "relation": [], "rights": "CC BY-SA 4.0", "source": [{"language": "en", "identifier": "ulb", "version": "1"}], "subject": "Bible", "title": "Some Bible", "type": "bundle", "version": "1"},
    "checking": {"checking_entity": ["Some"], "checking_level": "3"},
    "projects": [{"title": "Rüt", "versification": "ufw", "identifier": "rut", "sort": 8, "path": "./08-RUT.usfm", "categories": ["bible-ot"]}],
}


def test_manifests(spark):
    assert manifests.manifest_issues(json.dumps(GOOD), "xx_ulb", "2026-01-02") == ["Possible error: number of projects listed: 1"]
    bad = json.loads(json.dumps(GOOD))
    bad["dublin_core"] |= {"rights": "x", "type": "help", "extra": 1}
    bad["projects"][0]["sort"] = 9
    found = manifests.manifest_issues(json.dumps(bad), "yy_reg", "2026-01-03")
    for part in ("rights", "Invalid type", "Extra field", "project:sort", "Modified date", "directory name"):
        assert any(part in f for f in found), part
    m = spark.createDataFrame([("/f/xx_ulb/manifest.yaml", json.dumps(GOOD), True)], "path string, json string, has_bom boolean")
    assert manifests.verify(m, "2026-01-02").count() == 2
    files = spark.createDataFrame([("/f/xx_ulb/08-rut.usfm",), ("/f/xx_ulb/x.tmp",), ("/f/xx_ulb/README.md",)], "path string")
    titles = spark.createDataFrame([("/f/xx_ulb/08-RUT.usfm", ["Other"])], "path string, titles array<string>")
    msgs = [r["msg"] for r in manifests.file_issues(m, files, titles).collect()]
    assert sum("Case mismatch" in x for x in msgs) == 1 and any("LICENSE" in x for x in msgs) and not any("README" in x for x in msgs) and any("does not match any" in x for x in msgs)
    assert manifests.pair_issues([{"identifier": "1sa", "title": "1 Samuel"}, {"identifier": "2sa", "title": "2 Samwel"}])
    assert manifests.toc_issues({"title": "T", "sections": []}, "x")
    assert manifests.media_issues({"projects": [{"identifier": "obs", "media": []}]}) == ["No media are defined in media.yaml"]
    assert fl.yaml_as_json(b"a: [1") .startswith('{"error"')


def test_static_tables(spark):
    b = dims.books(spark)
    assert b.count() == 70 and b.agg(F.sum("chapters")).first()[0] == 1189
    assert {r["id"]: r["usfm_number"] for r in b.where("id in ('GEN','MAL','MAT','REV')").collect()} == {"GEN": "01", "MAL": "39", "MAT": "41", "REV": "67"}
    assert dims.markers(spark).where("category = 'PP'").count() == 6


def test_aligned_books():
    out = transforms.aligned_book("\\id GEN x\n\\usfm 2\n\\toc3 genesis\n\\h Genesis\n\\sts 1\n\\c 1\n\\v 1 a\n\\p\n\\v 2 b")
    assert out == "\\id GEN x\n\\usfm 3.0\n\\ide UTF-8\n\\h Genesis\n\\toc1 Genesis\n\\toc2 Genesis\n\\toc3 gen\n\\mt1 Genesis\n\\sts 1\n\\c 1\n\\p\n\\v 1 a\n\\p\n\\v 2 b\n"
    assert transforms.aligned_book("\\id GEN") == "\\id GEN"
