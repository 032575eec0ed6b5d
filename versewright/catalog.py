"""Registry of the queries over the driver's tables and their DuckDB SQL.

The tables hold plain prose, so queries that need markup make it in both engines: each document is a book whose lines are
verses, twenty to a chapter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import cleanup as cl
from .functions import dims, rules
from .functions import text as tx
from .operators import checks, joins, manifests, transforms
from .operators import tokens as tk
from .sinks import reports
from .sources import files as fl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# documents as lines and as marked books, in both engines

W, NW = tx.WORD, tx.NOT_WORD
SQL_SPLIT = r"list_filter(regexp_split_to_array({0}, '[ \t\n\r\f\x0B\p{{Z}}\x{{85}}\x{{1C}}-\x{{1F}}]+'), lambda w: w <> '')"
SQL_LINES = "(SELECT doc_id, i - 1 AS idx, string_split(coalesce(text, ''), chr(10))[i] AS line FROM documents, range(1, len(string_split(coalesce(text, ''), chr(10))) + 1) AS r(i))"


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("idx", "line"))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): documents as books; line k is verse k % 20 + 1 of chapter k / 20 + 1."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    verse = lambda x, i: F.concat(F.when(i % 20 == 0, F.concat(F.lit("\\c "), (i / 20 + 1).cast("int").cast("string"), F.lit("\n\\p\n"))).otherwise(""), F.lit("\\v "), (i % 20 + 1).cast("string"), F.lit(" "), x, F.lit("\n"))
    body = F.array_join(F.transform(lines, verse), "")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("\\id GEN\n\\h "), "source", F.lit("\n"), body).alias("content"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as text tokens (type, value, ref) whose reference is the document."""
    return table(spark, sf_dir, "documents").select(F.lit("text").alias("type"), F.col("text").alias("value"), F.format_string("DOC %08d", "doc_id").alias("ref"))


STRIP_SQL = "'.,:;!?+-[]{}()<>\"“‘’”*/'"


@query(f"""
WITH w AS (SELECT doc_id, trim(unnest({SQL_SPLIT.format('text')}), {STRIP_SQL}) AS word FROM documents)
SELECT word, count(*) AS n, CASE WHEN count(*) = 1 THEN printf('DOC %08d', min(doc_id)) END AS ref FROM w WHERE word <> '' AND NOT regexp_matches(word, '\\p{{N}}') GROUP BY word""")
def word_list(spark, sf_dir):
    return checks.word_list(texts(spark, sf_dir))


ENDS_SQL = r"regexp_matches({0}, '[.?!।፡።][^\p{{L}}\p{{N}}_]*$')"


@query(f"SELECT doc_id, coalesce({ENDS_SQL.format('text')}, false) AS ends FROM documents UNION ALL SELECT conv_id * 1000 + turn + 10000000, coalesce({ENDS_SQL.format('text')}, false) FROM conversations")
def sentence_ends(spark, sf_dir):
    ends = F.coalesce(tx.ends_sentence("text"), F.lit(False)).alias("ends")
    return table(spark, sf_dir, "documents").select("doc_id", ends).unionByName(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 10000000).alias("doc_id"), ends))


@query(rf"SELECT doc_id, regexp_extract(text, '([\p{{L}}\p{{N}}_]+-[\p{{L}}\p{{N}}_]+|[\p{{L}}\p{{N}}_]+)', 1) AS word FROM documents")
def first_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.first_word("text").alias("word"))


# A sentence starts at the first word, and at the first one after each mark that no quotation or dash follows directly.
_AFTER_MARK = r"([.।]|[?!፡።]+)[^\p{L}\p{N}_]*[\p{L}\p{N}_]"


@query(rf"""
WITH t AS (SELECT doc_id, regexp_replace(text, '^[^\p{{L}}\p{{N}}_]+', '') AS t FROM documents), u AS (SELECT doc_id, t, regexp_replace(t, '[?!፡።]+[«“‘\-—–]', '-', 'g') AS u FROM t)
SELECT doc_id, CASE WHEN t IS NULL THEN NULL WHEN t = '' THEN 0 ELSE 1 + len(regexp_extract_all(u, '{_AFTER_MARK}')) END AS n, CASE WHEN t IS NULL THEN NULL WHEN t = '' THEN 0 ELSE 1 + len(regexp_extract_all(u, '{_AFTER_MARK}')) END AS starts FROM u""")
def sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rules.column(rules.sentence_count, "int")("text").alias("n"), F.size(rules.column(rules.sentence_starts, "array<int>")("text")).alias("starts"))


TITLE_SQL = r"regexp_matches(replace(replace(w, '''', ''), '’', ''), '^[^\p{Lu}\p{Ll}\p{Lt}]*([\p{Lu}\p{Lt}]\p{Ll}*([^\p{Lu}\p{Ll}\p{Lt}]+|$))+$')"


@query(f"SELECT doc_id, idx, round(CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda w: {TITLE_SQL})) / len(ws)::DOUBLE ELSE 0 END, 6) AS share FROM (SELECT doc_id, idx, {SQL_SPLIT.format('line')} AS ws FROM {SQL_LINES})")
def titlecase_fraction(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("doc_id", "idx", F.round(rules.column(rules.titlecase_share, "double")("line"), 6).alias("share"))


def _plain_sql(word: str) -> str:
    title = TITLE_SQL.removeprefix("regexp_matches(replace(replace(w, \'\'\'\', \'\'), \'’\', \'\'), ").removesuffix(")")
    return rf"(regexp_matches({word}, '\p{{Ll}}') AND NOT regexp_matches({word}, '[\p{{Lu}}\p{{Lt}}]') OR regexp_matches({word}, '\p{{Lu}}') AND NOT regexp_matches({word}, '[\p{{Ll}}\p{{Lt}}]') OR regexp_matches({word}, {title}))"


@query(rf"""
WITH l AS ({ORACLE_SQL["word_list"]}), b AS (SELECT *, translate(word, chr(39) || '’"-_()–&', '') AS bare FROM l WHERE n < 5), m AS (SELECT * FROM b WHERE bare <> '' AND NOT {_plain_sql("word")} AND NOT {_plain_sql("bare")}),
s AS (SELECT list_sort(list(word)) AS w FROM m WHERE n > 1)
SELECT 0.1::DOUBLE AS error_id, ref, 'Mixed case word in ' || ref || ': ' || word AS msg FROM m WHERE n = 1
UNION ALL SELECT CASE WHEN len(w) >= 20 THEN 0.3 ELSE 0.2 END, NULL, CASE WHEN len(w) >= 20 THEN 'Too many mixed case words; reporting cancelled' ELSE 'Mixed case words occur more than once each: ' || array_to_string(w, ', ') END FROM s WHERE len(w) > 0""")
def mixed_case_words(spark, sf_dir):
    return checks.mixed_case_issues(word_list(spark, sf_dir)).select(F.col("error_id").cast("double").alias("error_id"), "ref", "msg")


@query("""
SELECT doc_id AS id, length(text) - length(replace(text, '"', '')) AS doubles, length(text) - length(replace(text, '''', '')) - len(regexp_extract_all(regexp_replace(text, '([\\p{L}\\p{N}_])''([\\p{L}\\p{N}_])', '\\1<''>\\2', 'g'), '<''>')) AS singles FROM documents
UNION ALL SELECT page_id + 1000000000, length(html) - length(replace(html, '"', '')), NULL FROM pages""")
def straight_quote_counts(spark, sf_dir):
    doubles, singles = tx.straight_quotes("text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), doubles.cast("long").alias("doubles"), singles.cast("long").alias("singles"))
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") + 1000000000).alias("id"), tx.straight_quotes("html")[0].cast("long").alias("doubles"), F.lit(None).cast("long").alias("singles"))
    return docs.unionByName(pages)


QUOTE_SQL = r"""
SELECT conv_id, turn, ((regexp_matches(t, '^[^\p{L}\p{N}_]*["''“‘‹«]+[^\n]*[\p{L}\p{N}_]')::INT + regexp_matches(t, '[\p{L}\p{N}_][^\n]*["''’”›»]+[^\p{L}\p{N}_]*$')::INT + regexp_matches(t, '[\p{L}\p{N}_][^\n]*["“‘‹«”›»]+[^\n]*[\p{L}\p{N}_]')::INT) % 2) = 1 AS partial
FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '"' || text WHEN 1 THEN text || '”' WHEN 2 THEN '“' || text || '”' ELSE text END AS t FROM conversations)"""


@query(QUOTE_SQL)
def quote_state(spark, sf_dir):
    t = F.when(F.col("turn") % 4 == 0, F.concat(F.lit('"'), "text")).when(F.col("turn") % 4 == 1, F.concat("text", F.lit("”"))).when(F.col("turn") % 4 == 2, F.concat(F.lit("“"), "text", F.lit("”"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").withColumn("t", t).select("conv_id", "turn", tx.partial_quote("t").alias("partial"))


def _nested_replace(start: str) -> str:
    out = start
    for a, b in cl.SUBSTITUTIONS:
        q = lambda s: "'" + s.replace("'", "''") + "'"
        out = f"replace({out}, {q(a)}, {q(b)})"
    return out


@query("SELECT doc_id, md5(" + _nested_replace("replace(replace(text, ', ', ' ,, '), '. ', ' .? ( ')") + ") AS digest FROM documents")
def substitution_chain(spark, sf_dir):
    noisy = F.replace(F.replace(F.col("text"), F.lit(", "), F.lit(" ,, ")), F.lit(". "), F.lit(" .? ( "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cl.substitute(noisy)).alias("digest"))


@query(f"""
WITH l AS {SQL_LINES}, t AS (
SELECT doc_id, 'v' AS type, count(*) AS n FROM l GROUP BY 1 UNION ALL SELECT doc_id, 'c', count(*) FROM l WHERE idx % 20 = 0 GROUP BY 1 UNION ALL SELECT doc_id, 'p', count(*) FROM l WHERE idx % 20 = 0 GROUP BY 1
UNION ALL SELECT doc_id, 'text', count(*) FROM l WHERE trim(line, ' \t') <> '' GROUP BY 1 UNION ALL SELECT doc_id, unnest(['id', 'h']), 1 FROM documents)
SELECT doc_id::VARCHAR AS path, type, n FROM t""".replace("\\t", "' || chr(9) || '"))
def verse_tokens(spark, sf_dir):
    return tk.tokens(marked(spark, sf_dir)).groupBy("path", "type").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id::VARCHAR AS path, idx // 20 + 1 AS chapter, idx % 20 + 1 AS verse, 'GEN ' || (idx // 20 + 1) || ':' || (idx % 20 + 1) AS ref, length(line) AS length FROM (SELECT doc_id, idx, regexp_replace(line, '^[ ]+', '') AS line FROM {SQL_LINES})")
def verse_text(spark, sf_dir):
    verses = tk.verses(tk.with_context(tk.tokens(marked(spark, sf_dir))))
    return verses.select("path", F.col("chapter").cast("long").alias("chapter"), F.col("verse").cast("long").alias("verse"), "ref", F.col("length").cast("long").alias("length"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber AS idx, CAST(sum(l_quantity) AS BIGINT) % 9 + 1 AS verse FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, coalesce(lag(verse) OVER (PARTITION BY l_orderkey ORDER BY idx), 0) AS last FROM l),
k AS (SELECT *, CASE WHEN verse < last THEN 39.0 WHEN verse = last THEN 40.0 WHEN verse = last + 2 THEN 41.0 WHEN verse > last + 2 THEN 41.1 END AS error_id, 'GEN 1:' || verse AS ref, 'GEN 1' || CASE WHEN last > 0 THEN ':' || last ELSE '' END AS last_ref FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, last_ref, error_id = 40 ORDER BY idx) AS nth FROM k WHERE error_id IS NOT NULL)
SELECT l_orderkey::VARCHAR AS path, ref, idx, error_id::DOUBLE AS error_id, CASE error_id WHEN 39 THEN 'Verse out of order: ' || ref || ' after ' || last_ref WHEN 40 THEN 'Duplicated verse number: ' || ref WHEN 41 THEN 'Missing verse between: ' || last_ref || ' and ' || ref ELSE 'Missing verses between: ' || last_ref || ' and ' || ref END AS msg
FROM n WHERE nth = 1 OR error_id = 40""")
def verse_sequence_issues(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("idx")).agg((F.sum("l_quantity").cast("long") % 9 + 1).cast("string").alias("value"))
    heads = rows.select("path").distinct().select("path", F.explode(F.array(*[F.struct(F.lit(k).alias("idx"), F.lit(t).alias("type"), F.lit(v).alias("value")) for k, t, v in ((-2, "id", "GEN"), (-1, "c", "1"))])).alias("h")).select("path", "h.*")
    context = tk.with_context(heads.unionByName(rows.select("path", "idx", F.lit("v").alias("type"), "value")))
    return checks.verse_number_issues(context).select("path", "ref", "idx", F.col("error_id").cast("double").alias("error_id"), "msg")


@query("""
WITH v AS (SELECT l_orderkey, max(l_linenumber) AS verse FROM lineitem GROUP BY 1), o AS (SELECT DISTINCT o_orderkey FROM orders),
c AS (SELECT o_orderkey, coalesce(verse, 0) AS verse, o_orderkey % 7 + 1 AS usual FROM o LEFT JOIN v ON l_orderkey = o_orderkey)
SELECT o_orderkey::VARCHAR AS path, ref, 'Chapter usually has ' || usual || ' verses: ' || ref AS msg FROM (SELECT *, 'GEN ' || (o_orderkey + 1) || CASE WHEN verse > 0 THEN ':' || verse ELSE '' END AS ref FROM c) WHERE verse <> usual""")
def chapter_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).distinct()
    path, number = F.col("k").cast("string").alias("path"), (F.col("k") + 1).cast("string")
    heads = orders.select(path, F.explode(F.array(F.struct(F.lit(-2).alias("idx"), F.lit("id").alias("type"), F.lit("GEN").alias("value")), F.struct(F.lit(-1).alias("idx"), F.lit("c").alias("type"), number.alias("value")))).alias("h")).select("path", "h.*")
    verses = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("idx")).distinct().join(orders, "k", "left_semi")
    context = tk.with_context(heads.unionByName(verses.select(path, "idx", F.lit("v").alias("type"), F.col("idx").cast("string").alias("value"))))
    lengths = orders.select(F.lit("GEN").alias("book"), (F.col("k") + 1).cast("int").alias("chapter"), (F.col("k") % 7 + 1).cast("int").alias("n_verses"))
    return checks.book_issues(context, dims.books(spark), lengths).where("error_id = 8").select("path", "ref", "msg")


@query(f"""
WITH b AS (SELECT item_id, list_distinct({SQL_SPLIT.format('text')}) AS ws FROM benchmark), d AS (SELECT doc_id, list_distinct({SQL_SPLIT.format('text')}) AS ws FROM documents),
c AS (SELECT doc_id, item_id, d.ws AS x, b.ws AS y FROM d JOIN b ON item_id = doc_id % 40)
SELECT doc_id, item_id, round(len(list_filter(list_intersect(x, y), lambda w: length(w) > 2 AND lower(w) = w AND upper(w) <> w)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 6) AS similarity FROM c""")
def untranslated_similarity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("item_id"))
    source = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("source"))
    return docs.join(source, "item_id").select("doc_id", "item_id", F.round(tx.shared_words("text", "source"), 6).alias("similarity"))


@query("""
WITH c AS (SELECT p_partkey, s_suppkey, list_distinct(string_split(upper(p_name), '')) AS x, list_distinct(string_split(upper(s_name), '')) AS y FROM part JOIN supplier ON s_suppkey % 50 = p_partkey % 50)
SELECT p_partkey, s_suppkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 6) AS similarity FROM c""")
def char_jaccard(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", tx.character_set("p_name").alias("x"), (F.col("p_partkey") % 50).alias("k"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", tx.character_set("s_name").alias("y"), (F.col("s_suppkey") % 50).alias("k"))
    common, together = tx.common_characters(F.col("x"), F.col("y"))
    return joins.in_blocks(part, supplier, "k").select("p_partkey", "s_suppkey", tx.rounded_share(common, together, 6).alias("similarity"))


PLAIN_SQL = "regexp_replace(lower(replace(replace(replace({0}, 'III ', '3 '), 'II ', '2 '), 'I ', '1 ')), '[^a-z0-9]', '', 'g')"


@query(f"""
WITH f AS (SELECT c_custkey, c_mktsegment || ' of ' || n_name || ' III ' || lower(n_name) || '.docx' AS name FROM customer JOIN nation ON n_nationkey = c_nationkey),
b AS (SELECT n_name AS book, {PLAIN_SQL.format("CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '3 ' || n_name END")} AS key FROM nation),
g AS (SELECT c_custkey, name, book, row_number() OVER (PARTITION BY c_custkey ORDER BY length(key) DESC, key DESC) AS k FROM f LEFT JOIN b ON contains({PLAIN_SQL.format('name')}, key)) SELECT c_custkey, name, book FROM g WHERE k = 1""")
def longest_name_match(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    books = nations.select(F.col("n_name").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("3 "), "n_name")).alias("en_name"))
    named = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 rows
    return fl.match_names(named.select("c_custkey", F.concat("c_mktsegment", F.lit(" of "), "n_name", F.lit(" III "), F.lower("n_name"), F.lit(".docx")).alias("name")), books)


@query("""
WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderkey)) AS st FROM orders GROUP BY 1), m AS (SELECT o_custkey % 400 + 1 AS ch, list(DISTINCT o_orderkey) AS ot FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
x AS (SELECT o_custkey, st, list_filter(coalesce(ot, []), lambda v: len(list_filter(range(1, len(st)), lambda i: st[i + 1] - st[i] > 8 AND v > st[i] AND v < st[i + 1])) > 0) AS inside FROM s LEFT JOIN m ON ch = o_custkey % 400 + 1)
SELECT o_custkey::VARCHAR AS path, len(list_distinct(list_concat(st, inside))) AS n, md5(array_to_string(list_sort(list_distinct(list_concat(st, inside))), ',')) AS starts FROM x""")
def chunk_range_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.lit("GEN").alias("book"), (F.col("o_custkey") % 400 + 1).cast("int").alias("chapter"), F.col("o_orderkey").cast("int").alias("v"), "o_orderpriority")
    starts = orders.groupBy("path", "book", "chapter").agg(F.sort_array(F.collect_set("v")).alias("starts"))
    model = orders.where("o_orderpriority = '1-URGENT'").groupBy("book", "chapter").agg(F.collect_set("v").alias("starts"))
    settled = transforms.settle_chunks(starts, model)
    return settled.select("path", F.size("starts").cast("long").alias("n"), F.md5(F.array_join(F.col("starts").cast("array<string>"), ",")).alias("starts"))


@query("SELECT doc_id, array_to_string(list_sort(list_filter(range(1, 11), lambda k: NOT list_contains(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]+'), lambda n: TRY_CAST(n AS INTEGER)), k))), ',') AS missing FROM documents")
def missing_numbers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.sequence(F.lit(1), F.lit(10)).alias("expected"))
    return docs.select("doc_id", F.array_join(F.array_sort(transforms.missing_verses("text", "expected")), ",").alias("missing"))


REFS = [*dims.OPTIONAL, *dims.SHORT, *(f"GEN 1:{k}" for k in range(1, 40))]


@query(f"""
WITH v AS (SELECT o_orderkey, ({REFS!r})[(o_orderkey % {len(REFS)} + 1)::INT] AS ref, o_custkey % 15 AS length, o_orderpriority = '5-LOW' AS is_ascii FROM orders),
e AS (SELECT o_orderkey, ref, unnest([CASE WHEN ref NOT IN ({", ".join(map(repr, dims.OPTIONAL))}) AND length = 0 THEN 'Empty verse: ' || ref END, CASE WHEN ref NOT IN ({", ".join(map(repr, [*dims.OPTIONAL, *dims.SHORT]))}) AND length > 0 AND length < 11 THEN 'Verse fragment: ' || ref END,
  CASE WHEN is_ascii AND length > 0 THEN 'Verse is entirely ASCII: ' || ref END]) AS msg FROM v)
SELECT o_orderkey::VARCHAR AS path, ref, msg FROM e WHERE msg IS NOT NULL""")
def verse_exemptions(spark, sf_dir):
    ref = F.element_at(F.array(*map(F.lit, REFS)), (F.col("o_orderkey") % len(REFS) + 1).cast("int"))
    verses = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), ref.alias("ref"), F.lit(0).alias("idx"), (F.col("o_custkey") % 15).alias("length"), (F.col("o_orderpriority") == "5-LOW").alias("is_ascii"))
    return checks.verse_issues(verses).select("path", "ref", "msg")


@query("SELECT trim(regexp_replace(value, '\\p{Nd}+', '', 'g')) AS label, count(*) AS n FROM (SELECT event_type || ' ' || event_id % 50 AS value FROM events) GROUP BY 1")
def label_inventory(spark, sf_dir):
    return reports.label_inventory(table(spark, sf_dir, "events").select(F.lit("cl").alias("type"), F.concat("event_type", F.lit(" "), (F.col("event_id") % 50).cast("string")).alias("value")))


@query("SELECT DISTINCT name FROM (SELECT unnest([source, lang, ' ']) AS name FROM documents) WHERE trim(name) <> ''")
def distinct_contributors(spark, sf_dir):
    return reports.contributors(table(spark, sf_dir, "documents").select(F.array("source", "lang", F.lit(" ")).alias("translators")))


@query(r"""
WITH d AS (SELECT text AS c, length(text) - length(replace(text, '"', '')) AS doubles, length(text) - length(replace(text, chr(39), '')) - len(regexp_extract_all(regexp_replace(text, '([\p{L}\p{N}_])''([\p{L}\p{N}_])', '\1<''>\2', 'g'), '<''>')) AS singles FROM documents),
e AS (SELECT unnest([CASE WHEN NOT starts_with(c, '\id ') THEN struct_pack(id := 74.1, msg := 'File does not start with \id') END, CASE WHEN doubles + singles > 0 THEN struct_pack(id := 75.0, msg := 'Straight quotes found: ' || doubles || ' double, ' || singles || ' single') END, CASE WHEN length(c) < 100 THEN struct_pack(id := 80.0, msg := 'File has less than 100 characters') END]) AS e FROM d),
g AS (SELECT e.id AS error_id, min(e.msg) AS lo, max(e.msg) AS hi, count(*) AS n FROM e WHERE e IS NOT NULL GROUP BY 1)
SELECT error_id::DOUBLE AS error_id, lo[1:list_max(list_filter(range(0, least(length(lo), length(hi)) + 1), lambda k: lo[1:k] = hi[1:k]))] AS msg, n FROM g UNION ALL SELECT NULL, 'TOTAL', sum(n)::BIGINT FROM g""")
def issue_summary(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    issues = checks.file_issues(files).where("error_id in (74.1, 75, 80)")  # what plain prose can have
    return checks.summary(issues).select(F.col("error_id").cast("double").alias("error_id"), "msg", "n")


@query("""
WITH i AS (SELECT doc_id::VARCHAR AS path, upper(substr(md5(text), 1, 3)) AS ref FROM documents)
SELECT path, ref, 'Duplicate ID: ' || ref AS msg FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY path) AS nth FROM i) WHERE nth > 1""")
def dup_ids(spark, sf_dir):
    heads = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("idx"), F.lit("id").alias("type"), F.upper(F.substring(F.md5("text"), 1, 3)).alias("value"))
    return checks.book_issues(tk.with_context(heads), dims.books(spark)).where("error_id = 23").select("path", "ref", "msg")


@query("SELECT doc_id, NOT regexp_matches(text, '[^\\x00-\\x7F]') AS is_ascii FROM documents")
def ascii_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.is_ascii("text").alias("is_ascii"))


@query(rf"""
SELECT doc_id::VARCHAR AS path, md5('\id GEN' || chr(10) || '\h ' || source || chr(10) || string_agg(CASE WHEN idx % 20 = 0 THEN '\c ' || (idx // 20 + 1) || chr(10) || '\cp ' || translate((idx // 20 + 1)::VARCHAR, '0123456789', '{cl.URDU_DIGITS}') || chr(10) || '\p' || chr(10) ELSE '' END
  || '\v ' || (idx % 20 + 1) || ' \vp ' || translate((idx % 20 + 1)::VARCHAR, '0123456789', '{cl.URDU_DIGITS}') || '\vp* ' || line || chr(10), '' ORDER BY idx)) AS digest FROM {SQL_LINES} JOIN documents USING (doc_id) GROUP BY doc_id, source""")
def published_numbers(spark, sf_dir):
    return marked(spark, sf_dir).select("path", F.md5(cl.published_numbers("content")).alias("digest"))


@query(f"""
WITH l AS (SELECT doc_id, idx, '\\v ' || (idx % 3 + 1) || CASE WHEN idx % 4 = 0 THEN '' ELSE ' ' || line END AS line FROM {SQL_LINES}),
s AS (SELECT doc_id, idx, line, CAST(regexp_extract(line, '^\\\\v ([0-9]+)', 1) AS INT) AS v, lead(line) OVER (PARTITION BY doc_id ORDER BY idx) AS nxt, lag(CAST(regexp_extract(line, '^\\\\v ([0-9]+)', 1) AS INT)) OVER (PARTITION BY doc_id ORDER BY idx) AS last FROM l)
SELECT doc_id, count(*) AS kept, sum(idx) AS places FROM s WHERE NOT (regexp_matches(line, '^\\\\v [0-9]+ *$') AND (coalesce(starts_with(nxt, rtrim(line)), false) OR coalesce(v = last, false))) GROUP BY doc_id""")
def line_filter_widow(spark, sf_dir):
    lines = doc_lines(spark, sf_dir).select(F.col("doc_id").alias("path"), "idx", F.concat(F.lit("\\v "), (F.col("idx") % 3 + 1).cast("string"), F.when(F.col("idx") % 4 == 0, "").otherwise(F.concat(F.lit(" "), "line"))).alias("line"))
    return transforms.remove_duplicate_verses(lines).groupBy(F.col("path").alias("doc_id")).agg(F.count("*").alias("kept"), F.sum("idx").alias("places"))


@query("SELECT doc_id, CASE WHEN regexp_matches(t, '^[0-9]+$') THEN TRY_CAST(t AS BIGINT) ELSE 0 END AS value FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN translate(doc_id::VARCHAR, '0123456789', '०१२३४५६७८९') ELSE 'x' || doc_id END AS s, CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE 'x' || doc_id END AS t FROM documents)")
def decimal_values(spark, sf_dir):
    s = F.when(F.col("doc_id") % 2 == 0, F.translate(F.col("doc_id").cast("string"), "0123456789", "०१२३४५६७८९")).otherwise(F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").withColumn("s", s).select("doc_id", tx.decimal_value("s").alias("value"))


@query(f"SELECT doc_id, idx, length(regexp_extract(line, '^([^“‘‹«''\"’”›»]*)', 1)) AS at FROM {SQL_LINES} WHERE regexp_matches(line, '[“‘‹«''\"’”›»]') UNION ALL SELECT doc_id, idx, -1 FROM {SQL_LINES} WHERE NOT regexp_matches(line, '[“‘‹«''\"’”›»]')")
def quote_positions(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("doc_id", F.col("idx").cast("long").alias("idx"), tx.quote_position("line").cast("long").alias("at"))


@query("SELECT doc_id, instr(' ' || regexp_replace(text, '[^0-9]', ' ', 'g') || ' ', ' 2 ') - 1 AS at FROM documents")
def number_places(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.has_number("text", F.lit(2)).cast("long").alias("at"))


@query(f"SELECT doc_id, md5('\\c 1' || chr(10) || string_agg(CASE WHEN idx % 5 = 0 THEN '\\s ' || idx || chr(10) || '\\p' || chr(10) ELSE '' END || '\\v ' || (idx + 1) || ' x', chr(10) ORDER BY idx)) AS digest FROM {SQL_LINES} GROUP BY doc_id")
def paragraph_marks_added(spark, sf_dir):
    line = F.concat(F.when(F.col("idx") % 5 == 0, F.concat(F.lit("\\s "), F.col("idx").cast("string"), F.lit("\n"))).otherwise(""), F.lit("\\v "), (F.col("idx") + 1).cast("string"), F.lit(" x"))
    books = doc_lines(spark, sf_dir).select("doc_id", "idx", line.alias("l")).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "l"))), lambda x: x["l"]), "\n").alias("b"))
    return books.select("doc_id", F.md5(cl.add_paragraph_marks(F.concat(F.lit("\\c 1\n"), "b"))).alias("digest"))


def _twice(sql: str, pattern: str, new: str) -> str:
    """A replacement in SQL, again for matches that lie over one another."""
    return f"regexp_replace(regexp_replace({sql}, '{pattern}', '{new}', 'g'), '{pattern}', '{new}', 'g')"


NOISY_SQL = "replace(replace(replace(text, '. ', '.. (('), ', ', ' , ['), ' a', '... a')"


@query(f"SELECT doc_id, md5({_twice(_twice(_nested_replace(NOISY_SQL), '(^|[^.])[.][.]([^.]|$)', chr(92) + '1.' + chr(92) + '2'), '([^ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r' + chr(92) + 'f])([(' + chr(92) + '[])', chr(92) + '1 ' + chr(92) + '2')}) AS digest FROM documents")
def punctuation_spacing(spark, sf_dir):
    noisy = F.replace(F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".. ((")), F.lit(", "), F.lit(" , [")), F.lit(" a"), F.lit("... a"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cl.fix_punctuation(noisy)).alias("digest"))


@query(f"SELECT CAST(l.doc_id AS VARCHAR) AS path, l.paragraphs, l.poetry, l.chapters, l.paragraphs <= 2.5 * l.chapters AND l.poetry <= 15 * l.chapters AS low FROM (SELECT doc_id, (max(idx) // 20 + 1) + coalesce(sum(len(regexp_extract_all(line, '\\\\p'))), 0)::BIGINT AS paragraphs, coalesce(sum(len(regexp_extract_all(line, '\\\\q'))), 0)::BIGINT AS poetry, max(idx) // 20 + 1 AS chapters FROM {SQL_LINES} GROUP BY doc_id) l")
def paragraph_counts(spark, sf_dir):
    counts = reports.paragraph_counts(marked(spark, sf_dir))
    return counts.select("path", *(F.col(c).cast("long").alias(c) for c in ("paragraphs", "poetry", "chapters")), "low")


@query("""
WITH c AS (SELECT DISTINCT l_orderkey, l_linenumber AS start FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT l_orderkey, max(l_linenumber) AS n_verses FROM lineitem GROUP BY 1),
e AS (SELECT l_orderkey, start, coalesce(lead(start) OVER (PARTITION BY l_orderkey ORDER BY start) - 1, n_verses) AS "end" FROM c JOIN n USING (l_orderkey))
SELECT l_orderkey, start, "end", array_to_string(CASE WHEN "end" >= start THEN range(start, "end" + 1) ELSE [start] END, ',') AS expected FROM e""")
def verse_ranges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book"), F.lit(1).alias("chapter"), F.col("l_linenumber").alias("start"), "l_returnflag")
    chunks = lines.where("l_returnflag = 'R'").drop("l_returnflag").distinct()
    lengths = lines.groupBy("book", "chapter").agg(F.max("start").alias("n_verses"))
    found = transforms.verse_ranges(chunks, lengths)
    return found.select(F.col("book").alias("l_orderkey"), "start", "end", F.array_join(F.col("expected").cast("array<string>"), ",").alias("expected"))


# checks of tokens, of punctuation and of numbers, each with the state around it, in both engines

# Fixed values of the queries: marks dealt over the events of a user, and texts of the text tokens.
DEALT = "c v v p q nb b s d qa text text text f f* m s5 fe ft fe* pi r q1 sp cl mt unknown cl b mt".split()
SAID, TITLES, LABELS, UNKNOWN = ["Alpha beta.", "gamma delta", "Epsilon", "zeta? Eta"], ["Genesis", "ALPHA", "Iii Beta", "Gämma"], ["Chapter 3", "Pasal 12", "4 Chapter"], ["p", "v", "zz"]


def dealt_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the tokens (path, idx, type, value) of one book for each user; every tenth book has no id."""
    draw = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 7), 16, 10).cast("long")  # the same in both engines
    events = table(spark, sf_dir, "events").select("user_id", "event_id", draw.alias("draw"))
    kind = F.element_at(F.array(*map(F.lit, DEALT)), (F.col("draw") % len(DEALT) + 1).cast("int"))
    rest = F.floor(F.col("draw") / len(DEALT))
    one_of = lambda values: F.element_at(F.array(*map(F.lit, values)), (rest % len(values) + 1).cast("int"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = events.select(F.col("user_id").cast("string").alias("path"), place.alias("idx"), kind.alias("type"), "draw")
    value = F.when(F.col("type") == "c", (rest % 6).cast("string")).when(F.col("type") == "v", (rest % 5 + 1).cast("string")).when(F.col("type").isin("text", "ft", "s", "sp"), one_of(SAID))
    value = value.when(F.col("type") == "mt", one_of(TITLES)).when(F.col("type") == "cl", one_of(LABELS)).when(F.col("type") == "unknown", one_of(UNKNOWN))
    heads = events.where("user_id % 10 <> 0").select(F.col("user_id").cast("string").alias("path")).distinct().select("path", F.lit(0).alias("idx"), F.lit("id").alias("type"), F.lit("GEN").alias("value"))
    return heads.unionByName(rows.select("path", "idx", "type", value.alias("value")))


def _in(families: str, *more: str) -> str:
    """SQL: the type is in these families or one of these marks."""
    return "type IN (" + ", ".join(repr(m) for f in families.split() for m in dims.FAMILIES[f].split()) + "".join(f", {m!r}" for m in more) + ")"


PAR, BOTH, SEC, CARRY = _in("paragraph"), _in("paragraph poetry"), _in("section"), _in("special crossref poetry intro footnote acrostic blank", "m").replace("type", "prev_type", 1)
TOKEN_STATE_SQL = f"""
e AS (SELECT user_id::VARCHAR AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx, ({DEALT!r})[(draw % {len(DEALT)} + 1)::INT] AS type, rest, {", ".join(f"({x!r})[(rest % {len(x)} + 1)::INT] AS {n}" for x, n in ((SAID, "said"), (TITLES, "title"), (LABELS, "named"), (UNKNOWN, "odd")))} FROM (SELECT *, draw // {len(DEALT)} AS rest FROM (SELECT *, ('0x' || md5(event_id::VARCHAR)[1:7])::BIGINT AS draw FROM events))),
t AS (SELECT DISTINCT user_id::VARCHAR AS path, 0 AS idx, 'id' AS type, 'GEN' AS value FROM events WHERE user_id % 10 <> 0 UNION ALL
  SELECT path, idx, type, CASE WHEN type = 'c' THEN (rest % 6)::VARCHAR WHEN type = 'v' THEN (rest % 5 + 1)::VARCHAR WHEN type IN ('text', 'ft', 's', 'sp') THEN said WHEN type = 'mt' THEN title WHEN type = 'cl' THEN named WHEN type = 'unknown' THEN odd END FROM e),
a AS (SELECT *, last_value(CASE WHEN type = 'id' THEN value END IGNORE NULLS) OVER u AS book, last_value(CASE WHEN type = 'c' THEN value::INT WHEN type = 'id' THEN 0 END IGNORE NULLS) OVER u AS chapter,
  last_value(CASE WHEN type = 'v' THEN value::INT WHEN type IN ('c', 'id') THEN 0 END IGNORE NULLS) OVER u AS verse, last_value(CASE WHEN type = 'c' THEN value::INT WHEN type = 'id' THEN 0 END IGNORE NULLS) OVER b AS prev_chapter,
  coalesce(last_value(CASE WHEN type IN ('f', 'fe', 'rq') THEN 'OTHER' WHEN {PAR} OR type = 'd' THEN 'PP' WHEN {_in("poetry")} THEN 'QQ' WHEN {SEC} THEN 'S' WHEN type = 'b' THEN 'B' WHEN type = 'c' THEN 'C' WHEN type IN ('v', 'text', 'mt') THEN 'OTHER' END IGNORE NULLS) OVER b, 'OTHER') AS prev,
  lag(type) OVER (PARTITION BY path ORDER BY idx) AS prev_type, coalesce(sum((type IN ('f', 'rq'))::INT - (type IN ('f*', 'rq*'))::INT) OVER b, 0) AS note, coalesce(sum((type = 'fe')::INT - (type = 'fe*')::INT) OVER b, 0) AS endnote,
  coalesce(last_value(CASE WHEN type = 'c' THEN true WHEN {_in("paragraph poetry descriptive", "id")} THEN false END IGNORE NULLS) OVER b, false) AS need_p,
  coalesce(last_value(CASE WHEN type = 'qa' THEN true WHEN {BOTH} AND type <> 'nb' OR type IN ('v', 'id') THEN false END IGNORE NULLS) OVER b, false) AS need_q,
  coalesce(last_value(CASE WHEN {_in("paragraph poetry descriptive", "v", "f", "f*", "fe", "fe*", "rq", "rq*", "text", "qa")} THEN true WHEN type IN ('c', 'id') THEN false END IGNORE NULLS) OVER b, false) AS okay
, coalesce(bool_or(type = 'mt' AND value = 'ALPHA') OVER b, false) AS shouted, CASE WHEN type = 'cl' THEN trim(regexp_replace(value, '\\p{{Nd}}+', '', 'g')) END AS label
  FROM t WINDOW u AS (PARTITION BY path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, note > 0 OR endnote > 0 AS inside, coalesce(last_value(CASE WHEN type = 'text' AND NOT (note > 0 OR endnote > 0) THEN regexp_matches(value, '[.?!][^\\p{{L}}\\p{{N}}_]*$') WHEN {PAR} AND type <> 'nb' OR type = 'id' THEN true END IGNORE NULLS) OVER (PARTITION BY path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ended,
  CASE WHEN chapter > 0 THEN CASE WHEN verse > 0 THEN concat_ws('', book, ' ', chapter, ':', verse) ELSE concat_ws(' ', book, chapter) END ELSE coalesce(book, '') || ' header/intro' END AS ref, coalesce(prev_chapter, 0) AS was, substr(value, 1, 1) <> upper(substr(value, 1, 1)) AS small,
  CASE WHEN {PAR} THEN 'PP' WHEN {_in("poetry", "qa")} THEN 'QQ' WHEN type = 'b' THEN 'B' WHEN type = 'c' THEN 'C' END AS own FROM a)"""
TOKEN_CHECKS = {
    "62": "own = prev", "13.1": "type = 'c' AND (chapter < 1 OR chapter > CASE WHEN book = 'GEN' THEN 50 ELSE 0 END)", "13": "type = 'c' AND book IS NULL", "14": "type = 'c' AND chapter < was", "15": "type = 'c' AND chapter = was", "16": "type = 'c' AND chapter > was + 2", "17": "type = 'c' AND chapter = was + 2",
    "18": "type = 'f' AND note <> 0", "19": "type = 'fe' AND endnote <> 0", "20": "type = 'fe'", "21": "type = 'ft' AND NOT inside", "29.5": f"{SEC} AND prev = 'S'", "33": "type = 'v' AND prev = 'B'", "35": "type = 'v' AND book IS NULL", "36": "type = 'v' AND coalesce(chapter, 0) = 0", "37": "type = 'v' AND value = '1' AND need_p",
    "38": "type = 'v' AND need_q", "38.5": "type = 'v' AND prev = 'S'", "44": "type = 'text' AND NOT inside AND ended AND small AND prev = 'PP'", "44.1": "type = 'text' AND NOT inside AND ended AND small AND prev <> 'PP'", "54": f"type = 'text' AND NOT okay AND NOT coalesce({CARRY}, false)", "54.1": "type = 'text' AND okay AND verse = 0 AND chapter > 0",
    "62.1": "type = 'c' AND book IS NULL", "24": f"{_in('paragraph poetry descriptive')} AND prev IN ('QQ', 'PP')", "27": f"({SEC} AND type <> 's5' OR type = 'd') AND prev = 'PP'", "28": f"({SEC} AND type <> 's5' OR type = 'd') AND prev = 'QQ'", "29": f"({SEC} AND type <> 's5' OR type = 'd') AND prev = 'B'",
    "30": "type = 'mt' AND value <> 'Gämma'", "31": "type = 'mt' AND value = 'ALPHA' AND NOT shouted", "31.1": "type = 'mt' AND starts_with(value, 'Ii')", "32": "type = 'mt' AND prev = 'B'", "42": "label <> 'Chapter'", "65": "type = 'unknown' AND value = 'p'", "66": "type = 'unknown' AND value = 'v'", "67": "type = 'unknown' AND value = 'zz'",
    "25": "type = 'p' AND prev_type = 'v'", "25.1": "type = 'nb' AND prev <> 'C'", "26": f"{PAR} AND NOT ended AND verse > 0", "26.1": f"{PAR} AND NOT ended AND verse = 0",
}


@query(f"WITH {TOKEN_STATE_SQL} SELECT * FROM (SELECT path, ref, idx, unnest([{', '.join(f'CASE WHEN {c} THEN {n}::DOUBLE END' for n, c in TOKEN_CHECKS.items())}]) AS error_id FROM s) WHERE error_id IS NOT NULL")
def token_order_issues(spark, sf_dir):
    found = checks.token_issues(tk.with_context(dealt_tokens(spark, sf_dir)), dims.books(spark), options=checks.Options(numbers=False, standard_titles=("Chapter",)))
    return found.select("path", "ref", "idx", F.col("error_id").cast("double").alias("error_id"))


@query(f"""
WITH {TOKEN_STATE_SQL}, g AS (SELECT path, max(book) AS book, max(chapter) AS top, arg_max(chapter, idx) AS last, count(*) FILTER (type = 'f') AS f1, count(*) FILTER (type = 'f*') AS f2, count(*) FILTER (type = 'fe') AS e1, count(*) FILTER (type = 'fe*') AS e2,
  count(*) FILTER ({BOTH} AND type <> 'nb') AS n_p, count(*) FILTER ({_in("poetry")}) AS n_q, bool_or(type = 'c' AND value = '1') AS one, coalesce(bool_or(type = 'mt' AND value <> CASE WHEN book = 'GEN' THEN 'Genesis' ELSE '' END), false) AS titled, count(DISTINCT label) AS labels, count(label) AS n_labels FROM s GROUP BY path)
SELECT * FROM (SELECT path, book AS ref, unnest([CASE WHEN one AND NOT titled THEN 5.0 END, CASE WHEN labels > 1 THEN 6.0 END, CASE WHEN n_labels > 1 AND n_labels < last THEN 7.0 END, CASE WHEN f1 <> f2 THEN 9.0 END, CASE WHEN e1 <> e2 THEN 10.0 END, CASE WHEN book IS NULL OR coalesce(top, 0) = 0 THEN 11.0 END, CASE WHEN book = 'GEN' AND last <> 50 THEN 12.0 END, CASE WHEN top > 0 AND n_p / top <= 2.5 AND n_q / top <= 15 THEN 73.5 END, 81.0])::DOUBLE AS error_id FROM g) WHERE error_id IS NOT NULL""")
def whole_book_issues(spark, sf_dir):
    found = checks.book_issues(tk.with_context(dealt_tokens(spark, sf_dir)), dims.books(spark)).where("error_id <> 23")  # see dup_ids
    return found.select("path", "ref", F.col("error_id").cast("double").alias("error_id"))


# texts with stray marks, so that the checks of punctuation have what to find
STRAY = [(". ", " ."), (", ", " ,x/y "), (" a", "?\" b"), ("e t", "e ''t"), (" d", " ( d"), (" c", " 12,345:6 c=d"), ("er ", "er;er ")]


STRAY_SQL = "line"
for _old, _new in STRAY:
    STRAY_SQL = "replace({}, {!s}, {!s})".format(STRAY_SQL, *("'" + x.replace("'", "''") + "'" for x in (_old, _new)))
_S, _B = r"[ \t\n\x0B\f\r]", r"[^ \t\n\x0B\f\r]"
_Q = "''"
_MARK, _MEDIAL = r"([.?!;:,][^ \t\n\x0B\f\r\x{200B}\)\]''\"’”»›])", r"([\p{L}\p{N}_][.?!;:,()\[\]\"«“‘”»›][.?!;:,()\[\]''\"«“‘”»›]*[\p{L}\p{N}_])"


@query(rf"""
WITH l AS (SELECT doc_id::VARCHAR AS path, idx, {STRAY_SQL} AS s FROM {SQL_LINES}),
m AS (SELECT *, regexp_extract(s, '{_MARK}', 1) AS mark, regexp_extract(s, '(?s)[.?!;:,][^ \t\n\x0B\f\r\x{{200B}}\)\]''\"’”»›].{{0,2}}') AS dots, regexp_extract(s, '([''\"’”»›][.!])', 1) AS outside, regexp_extract(s, '{_MEDIAL}', 1) AS medial FROM l),
n AS (SELECT *, mark <> '' AND (dots[1:3] <> '...' OR dots[1:4] = '....') AND NOT regexp_matches(mark, '^[,.][0-9]') AS suspicious, regexp_matches(mark, '^:[0-9]') AS colon FROM m),
i AS (SELECT path, idx, unnest([CASE WHEN suspicious AND NOT colon THEN struct_pack(id := 45.0, msg := 'Check the punctuation at x: ' || mark) END, CASE WHEN suspicious AND colon THEN struct_pack(id := 46.0, msg := 'Untagged footnote (probable) at x: ' || regexp_extract(s, '({_B}*(?::[0-9]){_B}*)', 1)) END,
  CASE WHEN regexp_matches(s, '{_S}[.?!;:,)’”»›]') THEN struct_pack(id := 48.0, msg := 'Space before phrase ending mark at x: ' || regexp_extract(s, '{_S}([.?!;:,)’”»›])', 1)) END, CASE WHEN regexp_matches(s, '{_S}[\[\]\(''\"«“‘’”»›]{_S}') OR regexp_matches(s, '^[\(''\"«“‘’”»›]{_S}') OR regexp_matches(s, '{_S}[\(''\"«“‘’”»›]$') THEN struct_pack(id := 49.0, msg := 'Free floating mark at x') END,
  CASE WHEN outside <> '' AND NOT regexp_matches(s, '[''\"’”»›]\.\.\.') THEN struct_pack(id := 50.0, msg := 'Punctuation after quote mark at x: ' || outside) END, CASE WHEN contains(s, chr(39) || chr(39)) OR contains(s, '""') THEN struct_pack(id := 51.0, msg := 'Repeated quotes at x') END,
  CASE WHEN medial <> '' AND NOT regexp_matches(medial, '[0-9]$') THEN struct_pack(id := 52.0, msg := 'Word medial punctuation in x: ' || regexp_extract(s, '({_B}*(?:[\p{{L}}\p{{N}}_][.?!;:,()\[\]\"«“‘”»›]+[\p{{L}}\p{{N}}_]){_B}*)', 1)) END, CASE WHEN contains(s, '/') THEN struct_pack(id := 52.1, msg := 'Forward slash in x') END,
  CASE WHEN contains(s, '\') THEN struct_pack(id := 52.2, msg := 'Backslash in x') END, CASE WHEN contains(s, '=') THEN struct_pack(id := 52.3, msg := 'Equals sign (=) in x') END,
  CASE WHEN regexp_matches(s, '(?s)^{_S}*[.,;:!?].?$') THEN struct_pack(id := 58.0, msg := 'Orphaned punctuation at x') END, CASE WHEN regexp_matches(s, '(?s)^{_S}*[.,;:!?]') AND NOT regexp_matches(s, '(?s)^{_S}*[.,;:!?].?$') THEN struct_pack(id := 58.1, msg := 'Text begins with phrase-ending punctuation in x') END]) AS i FROM n)
SELECT path, idx, i.id::DOUBLE AS error_id, i.msg AS msg FROM i WHERE i IS NOT NULL""")
def punctuation_issues(spark, sf_dir):
    rows = doc_lines(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), "idx", F.lit("x").alias("ref"), replaced(F.col("line"), STRAY).alias("s"), F.lit(False).alias("in_footnote"), F.lit("v").alias("prev_type"))
    found = checks.found(rows, checks.text_issues(F.col("s"), F.col("ref"), checks.Options()))
    return found.select("path", F.col("idx").cast("long").alias("idx"), F.col("error_id").cast("double").alias("error_id"), "msg")


# texts with stray numbers and with slips of marks
NUMBERED = [(", ", " 3, "), (". ", ". 12345 x. "), (" e", " x4y e"), (" d", " 7 8 d"), ("s ", "s 05 "), (" l", " 3:16 l"), (" p", " 9-4 2nd p"), (" q", " 14 q"), (" a", " (6) a"), (" b", " -11 b")]
SLIPPED = [(", ", "\\c1 "), (". ", ".\n\\c 2x\n"), (" a", " é\\v 3b "), (" e", "\n\\v4 "), (" d", "\n\\v 5-6. "), (" l", "\\c 7 ")]


def replaced(c, pairs):
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _replaced_sql(column: str, pairs) -> str:
    for old, new in pairs:
        column = f"replace({column}, '{old}', '{new}')"
    return column


@query(rf"""
WITH l AS (SELECT doc_id::VARCHAR AS path, idx, idx % 20 + 1 AS v, {_replaced_sql('line', NUMBERED)} AS s FROM {SQL_LINES}),
n AS (SELECT *, starts_with(s, v || ' ') AS starts, list_filter(regexp_extract_all(regexp_replace(s, '([^\p{{Nd}}])', '\1\1', 'g'), '[^\p{{Nd}}(](\p{{Nd}}+)[^\p{{Nd}},]', 1), lambda k: k = v::VARCHAR OR k = (v + 1)::VARCHAR) AS possible,
  list_filter(regexp_extract_all(s, '(\p{{Nd}}+[:\-]\p{{Nd}}+)', 1), lambda p: contains(p, ':') OR coalesce(TRY_CAST(string_split(p, '-')[-1] AS INT) > TRY_CAST(regexp_split_to_array(p, '[:-]')[1] AS INT), false)) AS likely,
  regexp_extract(s, '([^{_S[1:-1]},:.\p{{Nd}}(\[\-]+\p{{Nd}}+[^{_S[1:-1]},;.\p{{Nd}})\]]+)', 1) AS embed, regexp_extract(s, '(\p{{Nd}}+[^{_S[1:-1]},;:.\-?!"\p{{Nd}})\]])', 1) AS suffix, regexp_extract(s, '([^{_S[1:-1]},.\p{{Nd}}(\[]\p{{Nd}}+)', 1) AS prefix,
  regexp_extract(s, '(\p{{Nd}}{{4,}})', 1) AS long, regexp_extract(s, '(\p{{Nd}}+[.,]?{_S}[.,]?\p{{Nd}}+)', 1) AS apart, regexp_extract(s, '({_S}0[0-9,]*)', 1) AS zero FROM l),
f AS (SELECT *, starts OR len(possible) > 0 AS numbered, starts OR len(possible) > 0 OR len(likely) > 0 AS flagged FROM n),
i AS (SELECT path, idx, unnest([CASE WHEN starts THEN struct_pack(id := 59.0, msg := 'Verse number in text (probable): x') END, CASE WHEN NOT starts AND len(possible) > 0 THEN struct_pack(id := 59.1, msg := 'Possible verse number (' || possible[1] || ') in text at x') END,
  CASE WHEN NOT numbered AND len(likely) > 0 THEN struct_pack(id := 59.2, msg := 'Likely verse reference (' || likely[1] || ') in text at x') END, CASE WHEN embed <> '' THEN struct_pack(id := 60.0, msg := 'Embedded number in word: ' || embed || ' at x') END,
  CASE WHEN embed = '' AND NOT flagged AND suffix <> '' THEN struct_pack(id := 60.2, msg := 'Invalid number suffix: ' || suffix || ' at x') END, CASE WHEN embed = '' AND NOT flagged AND prefix <> '' THEN struct_pack(id := 60.1, msg := 'Invalid number prefix: ' || prefix || ' at x') END,
  CASE WHEN length(long) > 4 THEN struct_pack(id := 61.0, msg := 'Unsegmented number: ' || long || ' at x') END, CASE WHEN apart <> '' THEN struct_pack(id := 61.1, msg := 'Space between digits ' || apart || ' at x') END,
  CASE WHEN apart = '' AND zero <> '' THEN struct_pack(id := 61.2, msg := 'Invalid leading zero: ' || zero || ' at x') END]) AS i FROM f)
SELECT path, idx, i.id::DOUBLE AS error_id, i.msg AS msg FROM i WHERE i IS NOT NULL""")
def number_issues(spark, sf_dir):
    lines = doc_lines(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), "idx", F.lit("x").alias("ref"), replaced(F.col("line"), NUMBERED).alias("s"))
    rows = lines.select("*", F.lit(1).alias("chapter"), (F.col("idx") % 20 + 1).alias("verse"), F.lit(False).alias("in_footnote"), F.lit("text").alias("type"))
    found = checks.found(rows, checks.number_issues(F.col("s"), checks.Options()))
    return found.select("path", F.col("idx").cast("long").alias("idx"), F.col("error_id").cast("double").alias("error_id"), "msg")


@query(rf"""
WITH d AS (SELECT doc_id::VARCHAR AS path, {_replaced_sql('text', [(a, b.replace(chr(10), "' || chr(10) || '")) for a, b in SLIPPED])} AS c FROM documents),
i AS ({" UNION ALL ".join(f"SELECT path, {n}::DOUBLE AS error_id, '{said}' || unnest(regexp_extract_all(c, '{p}', 1)) || ' in ' || path AS msg FROM d" for n, p, said in checks.SLIPS)})
SELECT path, error_id, CASE WHEN error_id = 72 THEN regexp_replace(msg, '(marker: )[^ -~]', '\1') ELSE msg END AS msg FROM i""")
def marker_slips(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(None).cast("string").alias("ref"), replaced(F.col("text"), SLIPPED).alias("content"))
    return checks.slip_issues(files).select("path", F.col("error_id").cast("double").alias("error_id"), "msg")


# rewrites of marks, footnotes, filters and reports
MARKED = [(", ", "\n\\p\n\\s Head x\n"), (". ", "\n\\s5\n"), (" a", "\n\\q1 \n\\c3\n"), (" d", "\n\\v 4 "), (" e", "\n\\s2 On \n\\v 7 ")]
_MARKED_SQL = _replaced_sql("'\\c 1 \\v 2 ' || text", [(a, b.replace("\n", "' || chr(10) || '")) for a, b in MARKED])


@query(rf"""
WITH d AS (SELECT doc_id, replace({_MARKED_SQL}, chr(92) || chr(92), chr(92)) AS c FROM documents)
SELECT doc_id, md5(regexp_replace(c, '\n\\s5 *?\n', chr(10), 'g')) AS s5, md5(regexp_replace(c, '(?s)\n(\\[pqm][i1-4]? *)\n+(\\s[1-5]? .*?)\n', chr(10) || '\2' || chr(10) || '\1' || chr(10), 'g')) AS moved, md5(regexp_replace(c, '\\[pqm][i1-9]? *\n*(\\[^v])', '\1', 'g')) AS useless,
  md5(regexp_replace(c, '\\c([0-9])', chr(92) || chr(92) || 'c \1', 'g')) AS chapters, md5(regexp_replace(c, '(?s)^(.*?)(\\[cv] +[0-9]+)', '\1' || chr(92) || chr(92) || 's5' || chr(10) || '\2')) AS chunk, md5(regexp_replace(c, '^(\s*\\[cv] *[0-9\-]*\s*)+', '')) AS bare, md5(regexp_replace(c, '(Head) x', '\1', 'g')) AS edited,
  md5(replace(replace(replace(c, 'III ', '3 '), 'II ', '2 '), 'I ', '1 ')) AS arabic, md5('\c 1' || chr(10) || '\cl Chapter One' || chr(10) || '\p' || chr(10) || regexp_replace(c, '^\\c 1\s+', '')) AS labelled FROM d""")
def marks_tidied(spark, sf_dir):
    c = replaced(F.concat(F.lit("\\c 1 \\v 2 "), "text"), MARKED).alias("c")
    steps = {"s5": cl.remove_s5, "moved": cl.move_paragraph_marks, "useless": cl.remove_paragraph_marks, "chapters": cl.fix_chapter_marks, "chunk": cl.mark_chunk, "bare": cl.strip_initial_marks, "edited": lambda x: cl.stream_edit(x, "(Head) x", "$1"), "arabic": tx.roman_to_arabic, "labelled": lambda x: cl.augment_chapter(x, F.lit("Chapter One"))}
    return table(spark, sf_dir, "documents").select("doc_id", c).select("doc_id", *(F.md5(f(F.col("c"))).alias(k) for k, f in steps.items()))


@query(f"""
WITH l AS (SELECT doc_id, idx, '\\footnote ' || CASE idx % 3 WHEN 0 THEN 'xa' || (idx % 9 + 1) || ':' || (idx + 1) || ' 3:4' WHEN 1 THEN 'Z' || (idx % 9 + 1) || ':' || (idx + 1) ELSE 'none' END || ' ' || line AS line FROM {SQL_LINES})
SELECT doc_id::VARCHAR AS path, idx, CASE idx % 3 WHEN 0 THEN 'xa' ELSE 'Z' END AS spot, CASE idx % 3 WHEN 0 THEN idx % 9 + 1 ELSE idx + 1 END AS chapter, CASE idx % 3 WHEN 0 THEN idx + 1 ELSE idx % 9 + 1 END AS verse, length(trim(regexp_extract(line, CASE idx % 3 WHEN 0 THEN '^\\\\footnote +[a-z]+[0-9]+:[0-9]+ +[0-9:]* *(.+)' ELSE '^\\\\footnote +Z[0-9]+:[0-9]+ +(.+)' END, 1))) AS n FROM l
WHERE regexp_matches(line, '^\\\\footnote +([a-z]+)([0-9]+):([0-9]+) +[0-9:]* *(.+)') OR regexp_matches(line, '^\\\\footnote +Z([0-9]+):([0-9]+) +(.+)')""")
def footnote_lines(spark, sf_dir):
    k = F.col("idx")
    lead = F.when(k % 3 == 0, F.concat(F.lit("xa"), (k % 9 + 1).cast("string"), F.lit(":"), (k + 1).cast("string"), F.lit(" 3:4"))).when(k % 3 == 1, F.concat(F.lit("Z"), (k % 9 + 1).cast("string"), F.lit(":"), (k + 1).cast("string"))).otherwise("none")
    lines = doc_lines(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), "idx", F.concat(F.lit("\\footnote "), lead, F.lit(" "), "line").alias("line"))
    return transforms.parse_footnotes(lines).select("path", F.col("idx").cast("long").alias("idx"), "spot", F.col("chapter").cast("long").alias("chapter"), F.col("verse").cast("long").alias("verse"), F.length("text").cast("long").alias("n"))


@query(f"SELECT doc_id, count(*) AS kept, sum(idx) AS places FROM (SELECT doc_id, idx, '\\v ' || (idx % 30 + 1) || ' ' || CASE WHEN idx % 4 = 0 THEN '' ELSE line END AS line FROM {SQL_LINES}) WHERE NOT regexp_matches(line, '^\\\\v [0-9 ]+$') GROUP BY doc_id")
def blank_verses(spark, sf_dir):
    line = F.concat(F.lit("\\v "), (F.col("idx") % 30 + 1).cast("string"), F.lit(" "), F.when(F.col("idx") % 4 == 0, "").otherwise(F.col("line")))
    return transforms.remove_lines(doc_lines(spark, sf_dir).select("doc_id", "idx", line.alias("line"))).groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("idx").alias("places"))


@query(f"SELECT word || chr(9) || n || CASE WHEN ref IS NULL THEN '' ELSE chr(9) || ref END AS line FROM ({ORACLE_SQL['word_list']})")
def word_report(spark, sf_dir):
    return reports.word_lines(word_list(spark, sf_dir))


@query("""
SELECT c_custkey AS sort, '  -' || chr(10) || '    title: ' || CASE WHEN c_custkey % 3 = 0 THEN '"' || n_name || chr(39) || 's"' ELSE chr(39) || n_name || chr(39) END || chr(10) || '    versification: ufw' || chr(10) || '    identifier: ' || chr(39) || lower(c_name) || chr(39) || chr(10) || '    sort: ' || c_custkey || chr(10)
  || '    path: ' || chr(39) || './' || c_mktsegment || chr(39) || chr(10) || '    categories: [ ' || chr(39) || CASE WHEN c_custkey < 40 THEN 'bible-ot' ELSE 'bible-nt' END || chr(39) || ' ]' AS line FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def project_report(spark, sf_dir):
    named = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 rows
    title = F.when(F.col("c_custkey") % 3 == 0, F.concat("n_name", F.lit("'s"))).otherwise(F.col("n_name"))
    return reports.project_entries(named.select(title.alias("title"), F.col("c_name").alias("id"), F.col("c_custkey").alias("sort"), F.col("c_mktsegment").alias("path")))


@query("SELECT to_json(list(ref ORDER BY first, ref))::VARCHAR AS json FROM (SELECT 'GEN ' || o_custkey AS ref, min(o_orderkey) AS first FROM orders GROUP BY o_custkey)")
def footnoted_report(spark, sf_dir):
    refs = table(spark, sf_dir, "orders").groupBy(F.format_string("GEN %d", "o_custkey").alias("ref")).agg(F.min("o_orderkey").alias("first"))
    return reports.footnoted_json(refs)


@query("SELECT DISTINCT lang AS language_id, source AS resource_id, (doc_id % 3)::VARCHAR AS version FROM documents")
def sources_report(spark, sf_dir):
    one = F.struct(F.col("lang").alias("language_id"), F.col("source").alias("resource_id"), (F.col("doc_id") % 3).cast("string").alias("version"))
    return reports.sources_used(table(spark, sf_dir, "documents").select(F.array(one, one).alias("sources")))



@query("SELECT 'files' AS what, count(*) AS n FROM pages WHERE NOT regexp_matches(url, '/\\.[^/]+') AND regexp_matches(lower(regexp_extract(url, '([^/]+)$', 1)), '^(?:[a-m])') UNION ALL SELECT 'folders', count(DISTINCT f) FROM (SELECT regexp_extract(regexp_extract(url, '^(.*)/[^/]*$', 1), '^([^/]*//[^/]*e[^/]*|[^/]*//[^/]*/.*?e[^/]*)(?:/|$)', 1) AS f FROM pages WHERE NOT regexp_matches(url, '/\\.[^/]+')) WHERE f <> ''")
def file_counts(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    return fl.count_files(files, "[a-m]").select(F.lit("files").alias("what"), "n").unionByName(fl.count_folders(files, "//.*e").select(F.lit("folders").alias("what"), "n"))


@query(rf"""
WITH d AS (SELECT doc_id::VARCHAR AS path, {_replaced_sql('text', [(a, b.replace(chr(10), "' || chr(10) || '")) for a, b in [(" f", " \\\\ f"), (" g", " \\v 3g"), (" h", " \\1 h")]])} AS c FROM documents)
SELECT * FROM (SELECT path, unnest([CASE WHEN regexp_matches(c, '\\\s') THEN path || ' contains stranded backslash(es) followed by space or newline: ' || regexp_extract(c, '(\\\s)', 1) END, CASE WHEN regexp_matches(c, '\\v +[-0-9]+[^-\s0-9]') THEN path || ' contains verse number(s) not followed by space: ' || regexp_extract(c, '(\\v +[-0-9]+[^-\s0-9])', 1) END,
  CASE WHEN regexp_matches(c, '\\[^a-z+]') THEN path || ' contains foreign usfm code(s): ' || regexp_extract(c, '(\\[^a-z+])', 1) END, CASE WHEN strlen(c) < 1000 THEN path || ' is incomplete, too small' END]) AS msg FROM d) WHERE msg IS NOT NULL""")
def unparseable_files(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), replaced(F.col("text"), [(" f", " \\\\ f"), (" g", " \\v 3g"), (" h", " \\1 h")]).alias("content"))
    return checks.parse_problems(files).select("path", "msg")



@query(f"""
WITH d AS (SELECT doc_id, text, list_distinct({SQL_SPLIT.format('text')}) AS ws FROM documents), p AS (SELECT a.doc_id, a.ws AS x, b.ws AS y FROM d a JOIN d b ON b.doc_id = a.doc_id - a.doc_id % 2)
SELECT doc_id::VARCHAR AS path, 'DOC ' || doc_id AS ref, 'Verse may be untranslated (based on words in common): DOC ' || doc_id AS msg FROM p WHERE len(list_filter(list_intersect(x, y), lambda w: length(w) > 2 AND lower(w) = w AND upper(w) <> w)) / nullif(len(list_distinct(list_concat(x, y))), 0)::DOUBLE > 0.4""")
def untranslated_issues(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ref = F.concat(F.lit("DOC "), F.col("doc_id").cast("string"))
    verses = docs.select(F.col("doc_id").cast("string").alias("path"), ref.alias("ref"), F.lit(0).alias("idx"), "text", F.lit(99).alias("length"), F.lit(False).alias("is_ascii"))
    pairs = docs.select(ref.alias("ref"), (F.col("doc_id") - F.col("doc_id") % 2).alias("other")).join(docs.select(F.col("doc_id").alias("other"), F.col("text").alias("source_text")), "other")
    return checks.verse_issues(verses, pairs.select("ref", "source_text")).where("error_id = 3.5").select("path", "ref", "msg")



@query("""
WITH c AS (SELECT c_custkey AS k, n_name AS t, c_custkey || '-Book.usfm' AS f, '/f/' || c_custkey AS d FROM customer JOIN nation ON n_nationkey = c_nationkey),
i AS (SELECT CASE k % 4 WHEN 2 THEN 'Invalid path: ' || f ELSE 'Case mismatch in file name. Use ' || f || ', as in manifest file.' END AS msg, d || '/manifest.yaml' AS path FROM c WHERE k % 4 IN (1, 2) UNION ALL SELECT 'project:title ' || t || ' does not match any of the titles in ' || f || '.', d || '/manifest.yaml' FROM c WHERE k % 2 = 1
  UNION ALL SELECT 'Extraneous or misnamed file', d || '/x.tmp' FROM c WHERE k % 4 = 3 UNION ALL SELECT 'LICENSE file is missing', d || '/manifest.yaml' FROM c WHERE k % 3 <> 0 UNION ALL SELECT 'No README file is found', d || '/manifest.yaml' FROM c WHERE k % 5 <> 0)
SELECT path, msg FROM i""")
def manifest_file_issues(spark, sf_dir):
    k, book = F.col("c_custkey"), F.concat(F.col("c_custkey").cast("string"), F.lit("-Book.usfm"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 rows
    rows = rows.select("c_custkey", "n_name", F.concat(F.lit("/f/"), k.cast("string")).alias("d"), book.alias("f"))
    project = F.struct(F.col("n_name").alias("title"), k.cast("string").alias("identifier"), F.concat(F.lit("./"), "f").alias("path"))
    listed = rows.select(F.concat("d", F.lit("/manifest.yaml")).alias("path"), F.to_json(F.struct(F.array(project).alias("projects"))).alias("json"))
    there = F.array(F.when(k % 4 != 2, F.when(k % 4 == 1, F.lower("f")).otherwise(F.col("f"))), F.when(k % 4 == 3, F.lit("x.tmp")), F.when(k % 3 == 0, F.lit("License.md")), F.when(k % 5 == 0, F.lit("README.md")))
    files = rows.select("d", F.explode(F.filter(there, lambda n: n.isNotNull())).alias("n")).select(F.concat_ws("/", "d", "n").alias("path"))
    titles = rows.select(F.concat_ws("/", "d", "f").alias("path"), F.array(F.lit("Other"), F.when(k % 2 == 0, F.col("n_name")).otherwise("x")).alias("titles"))
    return manifests.file_issues(listed, files, titles)


@query(f"""
WITH l AS (SELECT DISTINCT lower(({[r[0] for r in dims.book_rows()]!r})[(l_partkey % 66 + 1)::INT]) || CASE WHEN l_partkey % 66 = 20 THEN 'X' ELSE '' END AS book, (l_suppkey % 12 + 1)::VARCHAR AS chapter, CASE WHEN l_linenumber = 7 THEN 'intro.md' WHEN l_linenumber = 6 THEN 'notes.md' ELSE '0' || l_linenumber || '.md' END AS name FROM lineitem),
f AS (SELECT *, '/t/' || book || '/' || chapter || '/' || name AS path FROM l), b AS (SELECT * FROM (VALUES {', '.join(f"('{r[0].lower()}', {r[2]})" for r in dims.book_rows())}) AS b(id, chapters)),
n AS (SELECT book, count(DISTINCT chapter) AS n, min(path) AS path FROM f GROUP BY book)
SELECT path, 'Invalid file name: ' || name AS msg FROM f WHERE name = 'notes.md' OR name <> 'intro.md' AND book = 'psa' UNION ALL SELECT path, CASE WHEN chapters IS NULL THEN 'Invalid(?) file or folder: ' || book ELSE 'Missing chapters in: ' || book END FROM n LEFT JOIN b ON id = lower(book) WHERE chapters IS NULL OR n < chapters""")
def chapter_file_issues(spark, sf_dir):
    k = (F.col("l_partkey") % 66).cast("int")
    book = F.concat(F.lower(F.element_at(F.array(*[F.lit(r[0]) for r in dims.book_rows()]), k + 1)), F.when(k == 20, "X").otherwise(""))
    name = F.when(F.col("l_linenumber") == 7, "intro.md").when(F.col("l_linenumber") == 6, "notes.md").otherwise(F.concat(F.lit("0"), F.col("l_linenumber").cast("string"), F.lit(".md")))
    files = table(spark, sf_dir, "lineitem").select(F.concat_ws("/", F.lit("/t"), book, (F.col("l_suppkey") % 12 + 1).cast("string"), name).alias("path")).distinct()
    return manifests.chapter_files(files, dims.books(spark), "tn")


@query("""
WITH f AS (SELECT DISTINCT '/a/' || l_orderkey AS article, (['01.md', 'title.md', 'sub-title.md', 'x.md'])[(l_partkey % 4 + 1)::INT] AS name FROM lineitem), g AS (SELECT article, list(name) AS names FROM f GROUP BY article),
m AS (SELECT article, unnest(list_filter(['01.md', 'title.md', 'sub-title.md'], lambda w: NOT list_contains(names, w))) AS name FROM g WHERE len(list_intersect(names, ['01.md', 'title.md', 'sub-title.md'])) > 0)
SELECT article, 'Missing file: ' || name AS msg FROM m""")
def article_file_issues(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("01.md", "title.md", "sub-title.md", "x.md"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    return manifests.article_files(table(spark, sf_dir, "lineitem").select(F.concat_ws("/", F.lit("/a"), F.col("l_orderkey").cast("string"), name).alias("path")))



# Fixed values of the query: a manifest without faults, changes that make one, and what is to be said of each.
MANIFEST = (
    '{"dublin_core":{"conformsto":"rc0.2","contributor":["Some One"],"creator":"Some","description":"d","format":"text/usfm","identifier":"ulb","issued":"2026-01-01","modified":"2026-01-02","language":{"direction":"ltr","identifier":"xx","title":"Bähasa"},"publisher":"Pub","relation":[],"rights":"CC BY-SA 4.0",'
    '"source":[{"language":"en","identifier":"ulb","version":"1"}],"subject":"Bible","title":"Some Bible","type":"bundle","version":"1"},"checking":{"checking_entity":["Some"],"checking_level":"3"},"projects":[{"title":"Rüt","versification":"ufw","identifier":"rut","sort":8,"path":"./08-RUT.usfm","categories":["bible-ot"]}]}'
)
SAMUEL = ',{"title":"1 Sämuel","versification":"ufw","identifier":"1sa","sort":9,"path":"./09-1SA.usfm","categories":["bible-ot"]},{"title":"2 Sämwel","versification":"ufw","identifier":"2sa","sort":10,"path":"./10-2SA.usfm","categories":["bible-ot"]}]'
FAULTS = [
    ("", "", []), ('"rc0.2"', '"rc9"', ["Invalid value for conformsto: rc9"]), ('"CC BY-SA 4.0"', '"free"', ["Invalid value for rights: free"]), ('["Some One"]', "[]", ["Missing contributors!"]), ('["Some One"]', '["ab"]', ["Invalid contributor name: ab"]), ('"creator":"Some"', '"creator":"S"', ["Invalid value for creator: S"]),
    ('"creator":"Some"', '"creator":7', ["Value must be a string: creator: 7"]), ('"2026-01-01"', '"2026-1-1"', ["Invalid date: 2026-1-1", "Dates wrong - issued: 2026-1-1, modified: 2026-01-02"]), ('"2026-01-02"', '"2026-01-05"', ["Modified date is not today: 2026-01-05"]), ('"text/usfm"', '"text/markdown"', ["Invalid format: text/markdown"]),
    ('"ltr"', '"up"', ["Incorrect language direction: up"]), ('"identifier":"xx"', '"identifier":"yy"', ["Language identifier (yy) does not match first part of directory name: xx_ulb"]), ('"Bähasa"', '"Bahasa"', ["Possible error: remember to localize language title: Bahasa"]), ('"relation":[]', '"relation":["xx/tn","xx/tn"]', ["There are duplicates in the relations list"]),
    ('"relation":[]', '"relation":["yy/zz","xx","xx/a/b"]', ["Possible error: non-matching language code for relation element: yy/zz", "Invalid project code in relation element: yy/zz", "Invalid value for relation element: xx", "Invalid format for relation element: xx/a/b"]),
    ('{"language":"en","identifier":"ulb","version":"1"}', "", ["Invalid source spec: should be an array of records of three fields."]), ('"language":"en"', '"language":"English"', ["Use a language code in source:language, not 'English'"]), ('"language":"en"', '"language":"xx"', ["Possible error: source:language matches target language"]),
    ('"subject":"Bible"', '"subject":"Book"', ["Invalid subject: Book"]), ('"Some Bible"', '"Easy Bible"', ["Title contradicts project type: Easy Bible"]), ('"bundle"', '"help"', ["Invalid type: help"]), ('"checking_level":"3"', '"checking_level":"2"', ["Invalid value for checking_level: 2"]), ('"checking_entity":["Some"]', '"checking_entity":[]', ["Missing checking_entity."]),
    ('"sort":8', '"sort":9', ["Incorrect project:sort: 9"]), ('"ufw"', '"x"', ["Invalid project:versification: x. Should be 'ufw'"]), ('["bible-ot"]', '["ot"]', ["Invalid project:categories: ['ot']"]), ('"Rüt"', '"Rut."', ["ASCII project:title: Rut.", "project:title has punctuation: Rut."]), ("08-RUT", "08-rut", ["Incorrect case in project:path: ./08-rut.usfm. Use ./08-RUT.usfm"]),
    (',"version":"1"},"checking"', '},"checking"', ["Missing field: dublin_core:version"]), ('"checking":{', '"extra":1,"checking":{', ["Extra field: :extra"]), ('["bible-ot"]}]', '["bible-ot"]}' + SAMUEL, ["Inconsistent book names (Sämuel for 1SA vs. Sämwel for 2SA)"]),
]


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"""
WITH f AS (SELECT * FROM (VALUES {', '.join(f'({k}, {_sql_text(m)})' for k, (_, _, said) in enumerate(FAULTS) for m in [*said, f'Possible error: number of projects listed: {3 if k == len(FAULTS) - 1 else 1}'])}) AS f(k, msg))
SELECT '/f/xx_ulb/' || c_custkey || '.json' AS path, msg FROM customer JOIN f ON k = c_custkey % {len(FAULTS)}""")
def manifest_issues(spark, sf_dir):
    made = F.element_at(F.array(*[F.lit(MANIFEST.replace(old, new) if old else MANIFEST) for old, new, _ in FAULTS]), (F.col("c_custkey") % len(FAULTS) + 1).cast("int"))
    return manifests.verify(table(spark, sf_dir, "customer").select(F.concat(F.lit("/f/xx_ulb/"), F.col("c_custkey").cast("string"), F.lit(".json")).alias("path"), made.alias("json")), "2026-01-02")


# rows only: state machines, and functions that SQL lacks


@query()
def usfm_issues(spark, sf_dir):
    return checks.verify(marked(spark, sf_dir), dims.books(spark))


@query()
def usfm_issue_counts(spark, sf_dir):
    return checks.summary(checks.verify(marked(spark, sf_dir), dims.books(spark)))


@query(rf"SELECT doc_id::VARCHAR AS path, md5('\id GEN' || chr(10) || '\h ' || source || chr(10) || string_agg(CASE WHEN idx % 20 = 0 THEN '\c ' || (idx // 20 + 1) || chr(10) || '\p' || chr(10) ELSE '' END || '\v ' || (idx % 20 + 1) || ' ' || ltrim(line, ' ' || chr(9) || chr(13)) || chr(10), '' ORDER BY idx)) AS digest FROM {SQL_LINES} JOIN documents USING (doc_id) GROUP BY doc_id, source")
def books_rewritten(spark, sf_dir):
    return tk.written(tk.tokens(marked(spark, sf_dir))).select("path", F.md5("content").alias("digest"))


@query()
def books_cleaned(spark, sf_dir):
    return transforms.clean_books(marked(spark, sf_dir)).select("path", F.md5("content").alias("digest"), "changed")


# Quotes open after commas and close after full stops and at the text's end; the first one opens without a sign of it.
@query(rf"""
WITH q AS (SELECT doc_id, replace(translate(coalesce(text, ''), '"' || chr(39), ''), ', ', ', "') AS t FROM documents), o AS (SELECT doc_id, replace(regexp_replace(t, ', "([\p{{L}}\p{{N}}_])', ', “\1', 'g'), '. ', '.” ') AS t FROM q)
SELECT doc_id, md5('"' || t || CASE WHEN regexp_matches(t, '[.!?\p{{L}}\p{{N}}_]$') OR regexp_matches(t, '“[^“‘’”\n\\]+[^\s“‘’”\n\\]$') THEN '”' ELSE '"' END || chr(10)) AS digest FROM o""")
def quotes_promoted(spark, sf_dir):
    quoted = F.concat(F.lit('"'), replaced(F.translate(F.coalesce("text", F.lit("")), "\"'", ""), [(", ", ', "'), (". ", '." ')]), F.lit('"\n'))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(rules.column(rules.promote_quotes)(quoted)).alias("digest"))


# The letters that the texts' languages start words with.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"


def _capitals_sql(column: str) -> str:
    """A capital for each letter that starts the text's first word, or the first one after a mark that no quotation or dash follows directly."""
    start = r"(^[^\p{L}\p{N}_]*|[.।][^\p{L}\p{N}_]*|[?!፡።](?:[^\p{L}\p{N}_«“‘\-—–][^\p{L}\p{N}_]*)?)"
    for letter in LETTERS:
        column = f"regexp_replace({column}, '{start}{letter}', '\\1{letter.upper()}', 'g')"
    return column


@query(f"SELECT doc_id, md5({_capitals_sql('lower(text)')}) AS digest FROM documents")
def capitalized(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(rules.column(rules.capitalize)(F.lower("text"))).alias("digest"))


@query()
def headings(spark, sf_dir):
    return doc_lines(spark, sf_dir).where(rules.column(rules.is_heading, "boolean")("line"))


@query(f"SELECT *, true AS changed FROM ({ORACLE_SQL['books_rewritten']})")
def paragraphs_by_model(spark, sf_dir):
    """Books that lost their paragraph marks get them back from a model of all books."""
    books = marked(spark, sf_dir)
    bare = books.withColumn("content", F.replace(F.col("content"), F.lit("\n\\p\n"), F.lit("\n")))
    model = transforms.paragraph_model(tk.with_context(tk.tokens(books)))
    return transforms.mark_paragraphs(tk.with_context(tk.tokens(bare)), model).select("path", F.md5("content").alias("digest"), "changed")


SQL_TRIMMED = "ltrim(line, ' ' || chr(9) || chr(13))"


@query(rf"""
WITH b AS (SELECT doc_id, source, string_agg(CASE WHEN idx % 20 = 0 THEN chr(10) || chr(10) || '\s5' || chr(10) || '\c ' || (idx // 20 + 1) || chr(10) || '\p' ELSE '' END || chr(10) || '\v ' || (idx % 20 + 1) || CASE WHEN {SQL_TRIMMED} = '' THEN '' ELSE ' ' || {SQL_TRIMMED} END, '' ORDER BY idx) AS body FROM {SQL_LINES} JOIN documents USING (doc_id) GROUP BY doc_id, source)
SELECT doc_id::VARCHAR AS path, md5(array_to_string(['\id GEN', '\ide UTF-8', '\h ' || source, '\toc1 ' || source, '\toc2 ' || source, '\toc3 gen', '\mt1 ' || source], chr(10)) || regexp_replace(body, '\s+$', '') || chr(10)) AS digest FROM b""")
def chunk_containers(spark, sf_dir):
    context = tk.with_context(tk.tokens(marked(spark, sf_dir)))
    return transforms.resource_container(context, transforms.chunk_starts(context)).select("path", F.md5("content").alias("digest"))


@query(rf"""
WITH l AS (SELECT doc_id, idx, idx // 20 + 1 AS chapter, {SQL_TRIMMED} AS t FROM {SQL_LINES}), n AS (SELECT *, CASE WHEN chapter < 10 THEN '0' ELSE '' END || chapter AS wide FROM l),
v AS (SELECT doc_id, wide, string_agg('<verse number="' || (idx % 20 + 1) || '" style="v" />' || CASE WHEN t = '' THEN '' ELSE replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(10) || chr(10) END, '' ORDER BY idx) AS content FROM n GROUP BY ALL)
SELECT doc_id::VARCHAR AS path, wide || '/01.usx' AS file, md5(content) AS digest FROM v UNION ALL SELECT DISTINCT doc_id::VARCHAR, wide || '/title.usx', md5(chapter::VARCHAR) FROM n UNION ALL SELECT doc_id::VARCHAR, 'front/title.usx', md5(source) FROM documents""")
def usx_chunk_files(spark, sf_dir):
    return reports.usx_chunks(tk.with_context(tk.tokens(marked(spark, sf_dir)))).select("path", "file", F.md5("content").alias("digest"))


@query(f"SELECT book, unnest(range(1, n + 1)) AS chapter, printf('https://example.org/%s/%02d.mp3', book, unnest(range(1, n + 1))) AS url FROM (VALUES {', '.join(f'({r[0]!r}, {r[2]})' for r in dims.book_rows())}) AS b(book, n)")
def chapter_audio(spark, sf_dir):
    return fl.audio_urls(dims.books(spark), "https://example.org/%s/%02d.mp3")
