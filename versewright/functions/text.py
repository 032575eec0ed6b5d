"""Native scalar functions over text columns, and the Unicode contract that all patterns of the engine keep.

Words are runs of letters, numbers and underscores of any script without combining marks; digits are decimal digits of
any script. The JVM, RE2 and Python agree on the classes below, so that every expression has an equal in SQL.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and marks.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\s\p{Z}\x{85}\x{1C}-\x{1F}]"
SENTENCE_ENDS = ".?!\u0964\u1361\u1362"  # full stop, question and exclamation mark, danda, two Ethiopic stops
QUOTE_FOLLOWS = "«“‘\\-\u2014\u2013"
OPEN_QUOTES, CLOSE_QUOTES = "\"'“‘‹«", "\"'’”›»"
ANY_QUOTE = "[“‘‹«'\"’”›»]"


def lit_or_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c) -> Column:
    """White-space separated parts, none of them empty."""
    return F.filter(F.split(lit_or_col(c), rf"{SPACE}+"), lambda w: w != "")


def is_ascii(c) -> Column:
    return lit_or_col(c).rlike(r"^[\x00-\x7F]*$") & ~lit_or_col(c).rlike(r"[^\x00-\x7F]")


def is_upper(c) -> Column:
    """There are cased characters and all of them are upper case."""
    c = lit_or_col(c)
    return (F.upper(c) == c) & (F.lower(c) != c)


def is_lower(c) -> Column:
    c = lit_or_col(c)
    return (F.lower(c) == c) & (F.upper(c) != c)


def ends_sentence(c, check_quotes: bool = False) -> Column:
    """Only non-word characters follow the last sentence mark; with check_quotes, no quote or dash directly after it."""
    c = lit_or_col(c)
    ends = c.rlike(rf"[{SENTENCE_ENDS}]{NOT_WORD}*$")
    if not check_quotes:
        return ends
    tail = F.regexp_extract(c, rf"([{SENTENCE_ENDS}]{NOT_WORD}*)$", 1)
    return ends & ~F.substring(tail, 1, 3).rlike(rf"^[?!\u1361\u1362]+[{QUOTE_FOLLOWS}]")


def first_word(c) -> Column:
    """The first word, or two joined by a hyphen; empty if none."""
    return F.regexp_extract(lit_or_col(c), rf"({WORD}+-{WORD}+|{WORD}+)", 1)


def quote_position(c) -> Column:
    """Characters before the first quote mark of any kind, -1 if none."""
    c = lit_or_col(c)
    return F.when(c.rlike(ANY_QUOTE), F.length(F.regexp_extract(c, rf"(?s)^([^“‘‹«'\"’”›»]*)", 1))).otherwise(F.when(c.isNotNull(), F.lit(-1)))


def partial_quote(c) -> Column:
    """A quotation starts, ends or breaks in the middle, but not in pairs of these."""
    c = lit_or_col(c)
    starts = c.rlike(rf"(?d)^{NOT_WORD}*[{OPEN_QUOTES}]+.*{WORD}")
    ends = c.rlike(rf"(?d){WORD}.*[{CLOSE_QUOTES}]+{NOT_WORD}*$")
    inside = c.rlike(rf"(?d){WORD}.*[\"“‘‹«”›»]+.*{WORD}")
    return (starts.cast("int") + ends.cast("int") + inside.cast("int")) % 2 == 1


def decimal_value(c) -> Column:
    """A whole number in the digits of any script, 0 if anything else is in it."""
    c = lit_or_col(c)
    plain = F.translate(c, *digit_tables())
    return F.when(plain.rlike(r"^[0-9]+$"), plain.try_cast("long")).otherwise(F.when(c.isNotNull(), F.lit(0).cast("long")))


@functools.cache
def digit_tables() -> tuple[str, str]:
    """All decimal digits but the ASCII ones, and their values."""
    import unicodedata

    found = [(chr(c), str(unicodedata.decimal(chr(c)))) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def straight_quotes(c) -> tuple[Column, Column]:
    """Counts of straight double quotes, and of single ones that don't stand between word characters."""
    c = lit_or_col(c)
    return F.regexp_count(c, F.lit('"')), F.regexp_count(c, F.lit("'")) - F.regexp_count(c, F.lit(rf"(?<={WORD})'(?={WORD})"))


def character_set(c) -> Column:
    """The distinct characters of a string in upper case, made once a row so that pairs are cheap: ASCII as bits, others as an array."""
    x = F.filter(F.array_distinct(F.split(F.upper(lit_or_col(c)), "")), lambda s: s != "")

    def bits(least: int) -> Column:
        ours = F.filter(x, lambda s: (F.ascii(s) >= least) & (F.ascii(s) < least + 64))
        return F.aggregate(ours, F.lit(0).cast("long"), lambda m, s: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(s) - least)))

    return F.struct(bits(0).alias("low"), bits(64).alias("high"), F.filter(x, lambda s: F.ascii(s) > 127).alias("others"), F.size(x).alias("n"))


def common_characters(x: Column, y: Column) -> tuple[Column, Column]:
    """How many characters two sets of ``character_set`` share, and how many they have together."""
    others = F.when((F.size(x["others"]) > 0) & (F.size(y["others"]) > 0), F.size(F.array_intersect(x["others"], y["others"]))).otherwise(F.when(x["n"].isNotNull() & y["n"].isNotNull(), 0))
    common = F.bit_count(x["low"].bitwiseAND(y["low"])) + F.bit_count(x["high"].bitwiseAND(y["high"])) + others
    return common, x["n"] + y["n"] - common


def character_similarity(a, b) -> Column:
    """Share of common characters among all characters of two strings in upper case."""
    return F.try_divide(*common_characters(character_set(a), character_set(b)))


def rounded_share(part, whole, digits: int) -> Column:
    """part / whole of whole numbers, rounded half up by whole numbers, as rounding a double makes a decimal number of each; null for 0."""
    part, whole = (lit_or_col(c).cast("long") for c in (part, whole))
    return F.call_function("div", part * (2 * 10**digits) + whole, F.nullif(whole * 2, F.lit(0).cast("long"))) / F.lit(float(10**digits))


def shared_words(a, b) -> Column:
    """Common lower-case words of three letters or more, over all words of both texts."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    both = F.filter(F.array_intersect(x, y), lambda w: (F.length(w) > 2) & is_lower(w))
    return F.try_divide(F.size(both), F.size(F.array_union(x, y)))


def roman_to_arabic(c) -> Column:
    """Leading-style book numerals: ``III ``, ``II `` and ``I `` become 3, 2 and 1."""
    return replace_all(c, [("III ", "3 "), ("II ", "2 "), ("I ", "1 ")])


def replace_all(c, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other over the whole text."""
    return functools.reduce(lambda col, p: F.replace(col, F.lit(p[0]), F.lit(p[1])), pairs, lit_or_col(c))


def last_word(c) -> Column:
    return F.coalesce(F.try_element_at(words(c), F.lit(-1)), F.lit(""))


def has_number(c, n) -> Column:
    """Place of a whole number among the digits of a text, -1 if it isn't there as a number of its own."""
    only = F.concat(F.lit(" "), F.regexp_replace(lit_or_col(c), "[^0-9]", " "), F.lit(" "))
    return F.instr(only, F.concat(F.lit(" "), lit_or_col(n).cast("string"), F.lit(" "))) - 1


def normalize_newlines(c) -> Column:
    """Without a byte order mark, all line ends as line feeds."""
    return F.regexp_replace(F.regexp_replace(lit_or_col(c), "^\ufeff", ""), "\r\n?", "\n")


def longest_common_prefix(c) -> Column:
    """Aggregate: what all strings of a group start with. The smallest and the largest decide."""
    low, high = F.min(lit_or_col(c)), F.max(lit_or_col(c))
    n = F.least(F.length(low), F.length(high))
    same = F.filter(F.sequence(F.lit(0), n), lambda k: F.substring(low, 1, k) == F.substring(high, 1, k))
    return F.substring(low, 1, F.array_max(same))
