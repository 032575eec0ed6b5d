"""Scalar rules: Python functions and their native equals."""

import time

import pytest
from pyspark.sql import functions as F

from versewright.functions import cleanup as cl
from versewright.functions import rules
from versewright.functions import text as tx

TEXTS = ["", "One.", "One. two", "He said, “Go!”", "Why?— he said", "এক দুই।", "አንድ።", "a-b c", "«Oui»", "it's", '"open', "close”", "no end", "x.\n", "Ends (here).", "12 abc", "!!", "He “said” it", "'tis true", "A “b"]


def native(spark, texts, *columns):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [tuple(r) for r in df.orderBy("k").select(*columns).collect()]


def test_native_equals_python(spark):
    got = native(spark, TEXTS, tx.ends_sentence("t"), tx.ends_sentence("t", True), tx.first_word("t"), tx.quote_position("t"), tx.partial_quote("t"), tx.is_ascii("t"))
    want = [(rules.ends_sentence(t), rules.ends_sentence(t, True), rules.first_word(t), rules.quote_position(t), rules.partial_quote(t), t.isascii()) for t in TEXTS]
    assert got == want


def test_native_nulls(spark):
    df = spark.createDataFrame([(None,)], "t string")
    row = df.select(tx.ends_sentence("t"), tx.first_word("t"), tx.quote_position("t"), tx.partial_quote("t"), tx.decimal_value("t"), rules.column(rules.capitalize)("t")).first()
    assert all(x is None for x in row)


@pytest.mark.parametrize(
    "s, starts",
    [("", []), ("Hello there. How are you?", [0, 13]), ("No words: !?", [0]), ("“Why?” he said. Then went.", [1, 7, 16]), ("One?—two. Three", [0, 10])],
)
def test_sentence_starts(s, starts):
    assert rules.sentence_starts(s) == starts


@pytest.mark.parametrize("s, out", [("hello. there", "Hello. There"), ("a? “b” c. d", "A? “B” c. D"), ("x?—y", "X?—y"), ("", "")])
def test_capitalize(s, out):
    assert rules.capitalize(s) == out


def test_capitalize_inside_a_sentence():
    assert rules.capitalize("and then. so", False) == "and then. So"


@pytest.mark.parametrize(
    "s, yes",
    [("The Great Flood", True), ("THE FLOOD", True), ("then he went away", False), ("God", False), ("The Flood. It Came", False), ("(The Ark)", True), ("“The Flood", False), ("\\s Heading Here", False), ("Amen Amen Amen", False), ("The Flood Came,", False)],
)
def test_is_heading(s, yes):
    assert rules.is_heading(s) is yes


def test_parenthesized_heading():
    assert rules.parenthesized_heading("He left. (The Flood)") == "(The Flood)"
    assert rules.parenthesized_heading("He left (and went)") is None


@pytest.mark.parametrize(
    "s, out",
    [("He said, 'go' now", "He said, ‘go’ now"), ('(“a”) "Come," he said.', "(“a”) “Come,” he said."), ('He went: "now!"\n', "He went: “now!”\n"), ("plain", "plain")],
)
def test_promote_quotes(s, out):
    assert rules.promote_quotes(s) == out


def test_promote_double_quotes_leaves_single_ones():
    assert rules.promote_double_quotes("He said: \"it's\" and 'x'\n").count("'") == 3


@pytest.mark.parametrize("s, out", [("a,b", "a, b"), ("1,000", "1,000"), ("x(y)", "x (y)"), ("end.Next", "end. Next"), ("a:1", "a: 1"), ("3:16", "3:16")])
def test_add_spaces(s, out):
    assert cl.add_spaces(s) == out


def test_punctuation_at_hand_equals_the_native_one(spark):
    texts = ["a.. b... c(d ,, x", "\\v 1 ( x ) y", "\\v 12 “\nx", "¹²,,;; ?.\n .! x[y", "'" * 5 + "a" + "'" * 3 + " <<b>> : c", "a\u00a0(b", "", "\\f+ x +\\f"]
    assert [r[0] for r in native(spark, texts, cl.fix_punctuation("t"))] == [cl.punctuated(t) for t in texts]


def test_paragraph_marks_at_hand_equal_the_native_ones(spark):
    texts = ["\\p\n\\s Head\n\\v 1 x\n\\s5\n\\q1 \n\n\\s2 More\n\n\\v 2 y", "\\pi1\n\\c 2\n\\m \\v 1", "\\s a\u2028b\n\\v 3", ""]
    steps = lambda c: cl.add_paragraph_marks(cl.remove_paragraph_marks(cl.move_paragraph_marks(cl.remove_s5(c))))

    def at_hand(s):
        for pattern, new in [cl.S5_LINE, *cl.PARAGRAPH_MARKS]:
            s = pattern.sub(new, s)
        return s

    assert [r[0] for r in native(spark, texts, steps("t"))] == [at_hand(t) for t in texts]


def test_rewrites_take_time_in_proportion():
    began = time.process_time()
    for s in ("a.b(c" * 40_000, "\"a b\" 'c' " * 20_000, "x \"" * 50_000, " “ x ”" * 30_000, "a,“b,”c " * 30_000):
        cl.add_spaces(s), rules.promote_quotes(s), rules.promote_double_quotes(s), cl.join_floating_quotes(s), cl.space_medial_quotes(s, "all")
    assert time.process_time() - began < 10


def test_book_titles():
    assert cl.fix_book_titles("\\h II  KINGS.\n\\toc1 the book of iii\n\\mt1 Fine Title\n") == "\\h II Kings\n\\toc1 The Book Of III\n\\mt1 Fine Title\n"


def test_quote_mates():
    assert cl.sides_of_quotes("x “abc” d “e", [2, 6, 10]) == ["opens", "", "closes"]
    assert cl.space_medial_quotes("He said,“go” now") == "He said, “go” now"
    assert cl.join_floating_quotes("He “ went ” off").count(" ”") + cl.join_floating_quotes("He “ went ” off").count("“ ") <= 1


@pytest.mark.parametrize("label, out", [("Chapter 3", "Pasal 4"), ("3", "4"), ("3 Chapter", "4 Pasal"), ("Title", "Title")])
def test_chapter_label(label, out):
    assert cl.fix_chapter_label(label, "4", "Pasal") == out


def test_native_rewrites(spark):
    s = "\\c 1\n\\p\n\\s Head\n\\v 1 x\n\\s5\n\\v 2 y"
    [(moved, chunked, stripped, s5)] = native(spark, [s], cl.move_paragraph_marks("t"), cl.mark_chunk("t"), cl.strip_initial_marks(F.lit("\\c 1 \\v 2 text")), cl.remove_s5("t"))
    assert moved == "\\c 1\n\\s Head\n\\p\n\\v 1 x\n\\s5\n\\v 2 y"
    assert chunked.startswith("\\s5\n\\c 1")
    assert stripped == "text"
    assert "\\s5" not in s5
    [(added, lost, fixed)] = native(spark, ["\\s Head\n\\v 1 a\n\\p\n\\q1 b ( c"], cl.add_paragraph_marks("t"), cl.remove_paragraph_marks("t"), cl.fix_punctuation(F.lit("a.. b... c(d ,, x")))
    assert "\\s Head\n\\p\n\\v 1" in added
    assert "\\p" not in lost and "\\q1" in lost
    assert fixed == "a. b... c (d, x"


def test_published_numbers(spark):
    [(out,)] = native(spark, ["\\c 12\n\\v 3 x \\v 4 \\vp ۴\\vp* y"], cl.published_numbers("t"))
    assert out == "\\c 12\n\\cp ۱۲\n\\v 3 \\vp ۳\\vp* x \\v 4 \\vp ۴\\vp* y"


def test_values(spark):
    rows = native(spark, ["१२", "x1", "7", ""], tx.decimal_value("t"))
    assert [r[0] for r in rows] == [12, 0, 7, 0]
    [(n, place)] = native(spark, ["ab 12 3"], tx.has_number("t", F.lit(3)), tx.has_number("t", F.lit(1)))
    assert (n, place) == (6, -1)


def test_similarity_of_nothing_is_null(spark):
    assert native(spark, [""], tx.character_similarity("t", "t"), tx.shared_words("t", "t")) == [(None, None)]


def test_longest_common_prefix(spark):
    df = spark.createDataFrame([("a", "Empty verse: A"), ("a", "Empty verse: B"), ("b", "Same"), ("b", "Same")], "g string, m string")
    assert dict(df.groupBy("g").agg(tx.longest_common_prefix("m")).collect()) == {"a": "Empty verse: ", "b": "Same"}


def test_unalign():
    s = '\\c 1\n\\v 1 \\zaln-s |x="y"\\*\\w In|lemma="in"\\w*\\zaln-e\\*\n\\w truth|lemma="t"\\w* .'
    assert cl.unalign(s) == "\\c 1\n\\v 1 In truth."


@pytest.mark.parametrize(
    "s, out",
    [
        ("\\c 2 The Great Flood\n\\v 1 x", "\\c 2\\s The Great Flood\n\\v 1 x"),
        ("\\v 1 It came. The Great Flood", "\\v 1 It came. \\s The Great Flood"),
        ("\\v 1 x y.\nThe Great Flood\n\\v 2 and", "\\v 1 x y.\n\\s The Great Flood\n\\v 2 and"),
        ("\\v 1 nothing here", "\\v 1 nothing here"),
    ],
)
def test_mark_heading(s, out):
    assert cl.mark_heading(s) == out


def test_augment_chapter(spark):
    [(a, b, c)] = native(spark, ["\\c 3 \\v 1 x"], cl.augment_chapter("t", F.lit("Chapter 3")), cl.augment_chapter("t", F.lit("3")), cl.augment_chapter(F.lit("\\v 1"), F.lit("x")))
    assert (a, b, c) == ("\\c 3\n\\cl Chapter 3\n\\p\n\\v 1 x", "\\c 3\n\\p\n\\v 1 x", "\\v 1")
