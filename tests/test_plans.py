"""Pipelines, streams, and the driver's contract."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from versewright import catalog
from versewright.functions import dims
from versewright.operators import checks, transforms
from versewright.plans import config, pipeline
from versewright.sources import files as sources
from versewright.streaming import files

ROOT = Path(__file__).resolve().parents[1]


def test_pipeline(spark):
    books = spark.createDataFrame([("a", "\\id GEN\n\\h GENESIS\n\\c 1\n\\v 1 one,two.\n")], "path string, content string")
    model = spark.createDataFrame([("m", "\\id GEN\n\\c 1\n\\q1\n\\v 1 x\n")], "path string, content string")
    steps = pipeline.Pipeline((("cleanup", pipeline.cleanup(sections=False)),)).then("paragraphs", pipeline.paragraphs(model))
    assert steps.run(books).first()["content"] == "\\id GEN\n\\h Genesis\n\\c 1\n\\q1\n\\v 1 One, two.\n"
    assert pipeline.next_step("verify") == "cleanup" and pipeline.next_step("manifest") is None
    assert pipeline.interlocked({"remove_s5": True, "s5_only": True, "all_quotes": True}) == {"remove_s5": True, "s5_only": False, "all_quotes": True, "double_quotes": True, "label": None}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.SFM").write_text("\\id GEN\n\\c 1\n\\v 1 x\n")
    (tmp_path / "in" / "b.txt").write_text("no book")
    query = files.verify(files.books(spark, str(tmp_path / "in")), dims.books(spark), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("error_id = 2").count() == 1
    query = files.word_counts(files.books(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("counted").where("word = 'x'").first()["n"] == 1


def test_event_windows(spark, tmp_path):
    spark.sql("SELECT timestamp'2026-01-01 00:10:00' AS ts, 'a' AS event_type UNION ALL SELECT timestamp'2026-01-01 00:20:00', 'a'").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "e"))
    query = files.events_by_window(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("windows").first()["n"] == 2


def test_entry():
    found = __spark_entry__.queries()
    assert set(catalog.QUERIES) <= set(found) and set(__spark_entry__.oracle_sql()) <= set(found)


def test_entry_without_the_optional_part(tmp_path):
    """The rest imports where the optional folders and the corpus pipeline are gone."""
    for name in ("versewright", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "versewright" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert 'word_list' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_queries_run(spark):
    for name in ("word_list", "verse_sequence_issues", "usfm_issue_counts", "chunk_containers"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_long_headings_count(spark, tmp_path):
    from versewright import catalog

    lines = ["THE BEGINNING" + " " * 120, "it was a small line, of prose."]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r["idx"] for r in catalog.headings(spark, str(tmp_path)).collect()) == [0]


def test_settings_from_ini_files(spark, tmp_path):
    (tmp_path / "tools.ini").write_text("[verify]\nnumbers = no\nsummary_only = 44, 26\nversion: 3\nstandard_titles = Chapter,Pasal 100%\n[cleanup]\nlabel = Pasal\nsections = off\n")
    text = config.read(spark, str(tmp_path / "tools.ini"))
    got = config.settings(checks.Options, text, "verify")
    assert got == checks.Options(numbers=False, summary_only=frozenset({"44", "26"}), version=3, standard_titles=("Chapter", "Pasal 100%"))
    assert config.settings(transforms.Cleaner, text, "cleanup") == transforms.Cleaner(label="Pasal", sections=False)
    assert config.settings(transforms.Cleaner, text, "other") == transforms.Cleaner()
    for one in (got, transforms.Cleaner(), checks.Options()):
        assert config.settings(type(one), config.written(one, "x"), "x") == one
    for bad in ("[verify]\nnumbrs = no", "[verify]\nnumbers = maybe"):
        with pytest.raises(ValueError, match="numb|maybe"):
            config.settings(checks.Options, bad, "verify")


def test_rewriting_with_the_originals_kept(spark, tmp_path):
    rows = [("/in/1", "01-GEN.usfm", "\\id GEN\n\\c 1\n\\p\n\\v 1 one,two.\n"), ("/in/2", "02-EXO.usfm", "\\id EXO\n\\c 1\n\\p\n\\v 1 One, two.\n"), ("/in/3", "08-RUT.usfm", "\\id RUT\n\\c 1\n\\p\n\\v 1 a(b).\n")]
    books = spark.createDataFrame(rows, "path string, name string, content string")
    done = pipeline.rewrite(books, pipeline.cleanup(sections=False), str(tmp_path / "out"))
    assert sorted(r["name"] for r in done.collect()) == ["01-GEN.usfm", "08-RUT.usfm"]
    read = lambda kind: {r["path"].split("file_name=")[1].split("/")[0]: r["content"] for r in sources.usfm(spark, str(tmp_path / "out" / kind), suffix=".txt").collect()}
    assert read("original") == {n: c for _, n, c in rows if n != "02-EXO.usfm"}
    assert read("changed") == {"01-GEN.usfm": "\\id GEN\n\\c 1\n\\p\n\\v 1 One, two.\n", "08-RUT.usfm": "\\id RUT\n\\c 1\n\\p\n\\v 1 A (b).\n"}
    assert pipeline.rewrite(books, pipeline.cleanup(sections=False), str(tmp_path / "one"), most=1).count() == 1
