"""Quality rules, near duplicates, repeated passages and the pipeline against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from versewright.llm import common, graph, jaccard, passages, quality, queries, suffixes

SF = "/root/testdata/sf0.01"

SCHEMA = "doc_id long, text string, kept string, component_id int, n_words int"  # with names that clash with results


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(n))


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = prose(rng, 1) + "x"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies in a large group and in small ones, a very common line, shared passages, junk and odd texts."""
    rng = random.Random(5)
    base, passage, line = prose(rng, 90), prose(rng, 110), prose(rng, 14)
    out = [prose(rng, rng.randint(3, 120)) for _ in range(60)]
    out += [edited(rng, base, rng.randint(0, 7)) for _ in range(70)]
    out += [f"{prose(rng, 40)} {passage} {prose(rng, 30)}" for _ in range(12)]
    out += [f"{line}\n{prose(rng, rng.randint(5, 60))}" for _ in range(40)]
    out += [edited(rng, out[k], 1) for k in range(0, 40, 3)]
    out += ["One Two Three four five six"] * 9 + ["one two three FOUR five six", "same line here\n" * 40, "### $$$ %%% " * 20, "", None, " \n", "a", "a b", "ö" * 3000]
    rng.shuffle(out)
    return out


def frame(spark, texts, n=5):
    return spark.createDataFrame([(k, t, "x", 1, 2) for k, t in enumerate(texts)], SCHEMA).repartition(n)


def test_quality(spark, corpus):
    got = {r["doc_id"]: r for r in quality.judge(frame(spark, corpus)).collect()}
    assert len(got) == len(corpus)
    for k, t in enumerate(corpus):
        n, chars, symbols, dup, repeated = brute.quality(t or "")
        assert tuple(got[k][c] for c in quality.COUNTS) == (n, chars, symbols, dup, repeated)
        assert got[k]["base_failed"] == (n < 20 or 100 * repeated > 30 * n)
    kept = {r["doc_id"] for r in quality.keep(frame(spark, corpus)).collect()}
    assert kept == {k for k, r in got.items() if r["kept"]} == {r["doc_id"] for r in quality.judge(frame(spark, corpus), counts=False).where("kept").collect()}
    assert not any(got[k]["kept"] for k in got if got[k]["base_failed"])
    assert quality.judge(frame(spark, corpus).limit(0)).count() == 0


def test_order_never_changes_the_verdict(corpus):
    import itertools

    import pyarrow as pa

    from versewright.llm import common

    data, at = common.buffers(pa.array(corpus, pa.string()))
    verdicts = {tuple(quality.cascade(quality.Features(data, at), quality.RULES, order).tolist()) for order in itertools.permutations(range(len(quality.RULES)))}
    assert len(verdicts) == 1


def test_rules_are_ordered_by_rejections_per_second(spark, corpus):
    order, stats = quality.order_rules(frame(spark, corpus))
    worth = {s["at"]: s["rejected"] / s["seconds"] for s in stats}
    assert [worth[k] for k in order] == sorted(worth.values(), reverse=True) and all(s["rows"] == len(corpus) for s in stats)


@pytest.mark.parametrize("n, num, crowd, sample", [(4, 85, 16, 8000), (5, 80, 2, 60), (3, 60, 3, 40)])
def test_near_duplicates(spark, corpus, monkeypatch, n, num, crowd, sample):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "SAMPLE", sample)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(frame(spark, corpus), n, num, 100).collect()}
    assert got == {k: (len(brute.shingles(t, n)), c) for k, (t, c) in enumerate(zip(corpus, brute.jaccard(corpus, n, num, 100), strict=True))}


@pytest.mark.parametrize("rows", [1, 7, 4096])
def test_columns_that_go_on_over_batches(spark, monkeypatch, rows):
    monkeypatch.setattr(jaccard, "CROWD", 5)
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, str(rows))
    rng = random.Random(rows)
    lists = [sorted(rng.sample(range(40), rng.randint(0, 6)) + [100] * (k % 3 == 0) + [200 + k]) for k in range(90)]
    nodes = common.materialize(spark.createDataFrame([(k, len(x) + 3, False, x) for k, x in enumerate(lists)], "node long, n long, hot boolean, first array<long>").repartition(3), "nodes")
    got = Counter((r["s"], r["node"], r["i"], r["crowded"]) for r in jaccard.shared_rows(nodes).collect())
    spark.conf.set(key, before)
    count = Counter(g for x in lists for g in x)
    assert got == Counter((g, k, i, count[g] > 5) for k, x in enumerate(lists) for i, g in enumerate(x) if count[g] > 1)


def test_near_duplicates_edges(spark):
    text = "one two three four five six"
    rows = [(7, text, "", 0, 0), (7, text, "", 0, 0), (None, text.upper(), "", 0, 0), (3, text, "", 0, 0), (None, "else", "", 0, 0), (9, None, "", 0, 0), (9, "", "", 0, 0)]
    got = [(r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(7, 3), (7, 3), (None, 3), (3, 3), (None, None), (9, 9), (9, 9)], key=str)
    assert jaccard.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("crowd", [2, 2000])
def test_repeated_passages(spark, corpus, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    texts = [*corpus, "ab" * 400, "x" * 1000, corpus[0]]
    want = brute.without_repeats([(t or "").encode() for t in texts], 100)
    got = {r["doc_id"]: r for r in suffixes.remove(frame(spark, texts), 100).collect()}
    assert len(got) == len(texts)
    for k, (left, gone, runs) in enumerate(want):
        assert (bytes(got[k]["kept"]), got[k]["n_removed"], len(got[k]["removed"])) == (left, gone, runs), k


def thue_morse(n):
    """A word of n letters and its complement: polynomial hashes modulo a power of two can't tell them apart."""
    word = "".join("ab"[k.bit_count() % 2] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_texts_that_collide_in_rolling_hashes(spark, n):
    rng = random.Random(n)
    texts = [f"{prose(rng, 30)} {w} {prose(rng, 30)}" for w in thue_morse(n)] + list(thue_morse(n))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(frame(spark, texts), 4, 85, 100).collect()}
    assert got == dict(enumerate(brute.jaccard(texts, 4, 85, 100)))
    left = {r["doc_id"]: bytes(r["kept"]) for r in suffixes.remove(frame(spark, texts), 400).collect()}
    assert left == {k: x[0] for k, x in enumerate(brute.without_repeats([t.encode() for t in texts], 400))}


def test_ties_are_decided_by_bytes(monkeypatch):
    monkeypatch.setattr(suffixes.RollingHash, "of", lambda self, starts, ends: np.zeros(len(starts), np.uint64))
    rng = random.Random(1)
    head = bytes(rng.randrange(97, 101) for _ in range(60))
    data = np.frombuffer(b"".join(head + bytes(rng.randrange(97, 99) for _ in range(4)) for _ in range(60)), np.uint8)
    place = np.arange(0, len(data), 64)
    strings = [data[p : p + 64].tobytes() for p in place]
    assert suffixes.repeated_windows(data, place, 64).tolist() == [strings.count(x) > 1 for x in strings]


@pytest.mark.parametrize("bucket", [3, 50, 100_000])
def test_equal_suffixes_meet_across_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    rng = random.Random(bucket)
    rows = [(k, rng.randrange(6), rng.randrange(8), rng.randrange(3)) for k in range(150)] + [(k, 9, 9, 9) for k in range(150, 300)]  # half of all are one string
    table = common.materialize(spark.createDataFrame(rows, "at long, x long, y long, z long").repartition(3), "rows")
    found, _ = suffixes.in_order(table, ["x", "y", "z"], ["at", "x", "y", "z"], group=2)
    got = found.collect()
    count, kinds = Counter(r[1:] for r in rows), {}
    for r in rows:
        kinds.setdefault(r[1:3], set()).add(r[1:])
    copies = [r["at"] for r in got if r["copy"]]
    assert sorted(copies) == [r[0] for r in rows if count[r[1:]] > 1]
    # of a group in which a string stands alone among others all kinds are there
    need = {k for group in kinds.values() if len(group) > 1 and any(count[k] == 1 for k in group) for k in group}
    assert need <= {(r["x"], r["y"], r["z"]) for r in got if not r["copy"]}
    assert suffixes.in_order(common.materialize(table.limit(0), "none"), ["x", "y"], ["at"], group=1)[0].count() == 0


def digest_repeats(texts, length):
    """What suffixes.remove() should say of each text, by a digest of the string at every place."""
    seen = Counter(hashlib.blake2b(t[p : p + length], digest_size=12).digest() for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        edge = np.zeros(len(t) + 1, np.int64)
        for p in range(len(t) - length + 1):
            if seen[hashlib.blake2b(t[p : p + length], digest_size=12).digest()] > 1:
                edge[p] += 1
                edge[p + length] -= 1
        gone = np.append(False, np.cumsum(edge)[:-1] > 0)
        out.append((len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone[1:]])).hexdigest()))
    return out


def test_query_of_repeats_on_the_whole_table(spark):
    got = {r["doc_id"]: tuple(r)[1:5] for r in queries.QUERIES["op7_suffix_dedup"](spark, SF).collect()}
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    assert got == dict(zip(table["doc_id"], digest_repeats([(t or "").encode() for t in table["text"]], 400), strict=True))


def test_query_of_repeats_returns_what_is_left_as_text(spark, tmp_path):
    rng = random.Random(12)
    passage = prose(rng, 150)
    texts = [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(4)] + [prose(rng, 90), "é" * 150 + "x" + "é" * 260, "é" * 260, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_suffix_dedup"](spark, str(tmp_path)).collect()}
    want = brute.without_repeats([(t or "").encode() for t in texts], 400)
    for k, (left, gone, runs) in enumerate(want):
        assert got[k]["text"] == left.decode("utf-8", "ignore"), k
        # the length is that of the input, whatever was removed
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"]) == (len((texts[k] or "").encode()), gone, runs), k
    assert all(passage not in got[k]["text"] and got[k]["n_removed"] >= len(passage.encode()) for k in range(4)) and got[4]["text"] == texts[4]
    assert got[5]["n_removed"] and got[6]["n_removed"]


def test_query_of_near_copies_on_the_whole_table(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op9_ngram_jaccard"](spark, SF).collect()}
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    ids, texts = zip(*sorted(zip(table["doc_id"], table["text"], strict=True)), strict=True)
    assert got == {k: (len(brute.shingles(t, 4)), ids[c]) for k, t, c in zip(ids, texts, brute.jaccard(list(texts), 4, 85, 100), strict=True)}


def test_quality_of_very_long_texts_and_null_ids(spark):
    long = "a few words that go on and on, line by line\n" * 60_000
    rows = [(None, long, "x", 1, 2), (None, None, "x", 1, 2), (1, "x" * 3_000_000, "x", 1, 2), (1, "x" * 3_000_000, "x", 1, 2)]
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["base_failed"]) for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == [(0, 0, True), (0, 660_000, True), (1, 1, True), (1, 1, True)]


def test_long_texts_go_in_parts(spark, corpus, monkeypatch):
    monkeypatch.setattr(suffixes, "STRETCH", 300)
    texts = [t for t in corpus if t][:60]
    texts += [texts[3] + " " + texts[4] + " " + texts[3]]
    import pyarrow as pa

    from versewright.llm import common

    data, at = common.buffers(pa.array(texts))
    seen = [(i, shift + int(offs[0]), shift + int(offs[-1])) for i, _, offs, shift in suffixes.stretches(data, at, 100) if len(offs) == 2]
    assert any(a for _, a, _ in seen)
    # the parts of a row hold all its windows
    whole = {i: max(b for j, _, b in seen if j == i) for i, _, _ in seen}
    assert all(whole[i] == len(texts[i].encode()) for i in whole if any(j == i and a for j, a, _ in seen))


def test_repeated_rows_count_as_places(spark):
    t = "".join(chr(97 + k * k % 26) for k in range(150))
    rows = spark.createDataFrame([(1, t, "", 0, 0), (1, t, "", 0, 0), (None, None, "", 0, 0), (2, "z" * 99, "", 0, 0)], SCHEMA)
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffixes.remove(rows, 100).collect())
    assert got == [(0, 0), (1, 150), (1, 150), (2, 0)]
    assert suffixes.remove(rows.limit(0), 100).count() == 0
    odd = spark.createDataFrame([(1, "aéb", [(1, 1)])], "id int, text string, spans array<struct<lo long, hi long>>")
    assert suffixes.cut_out(odd, 1, as_text=True).first()["kept"] == "ab" and bytes(suffixes.cut_out(odd, 1).first()["kept"]) == b"a\xa9b"


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 480)] + [(5, 5), (None, 1)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == brute.components({x for p in real for x in p}, real)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, corpus, tmp_path):
    import corpus_pipeline

    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(corpus)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    alive = {r["doc_id"] for r in quality.judge(frame(spark, corpus)).where("kept").collect()}
    first = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in first.collect()} == alive and first.columns == docs.columns
    ids = sorted(alive)
    firsts = sorted({ids[c] for c in brute.jaccard([corpus[k] for k in ids], 5, 80, 100)})
    second = corpus_pipeline.near_duplicates(spark, first, str(tmp_path))
    assert sorted(r["doc_id"] for r in second.collect()) == firsts and second.columns == docs.columns
    left = [x[0].decode("utf-8", "ignore") for x in brute.without_repeats([corpus[k].encode() for k in firsts], 400)]
    third = corpus_pipeline.repeated_passages(spark, second, str(tmp_path))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in third.collect()} == {k: (t, len(t)) for k, t in zip(firsts, left, strict=True)} and third.columns == docs.columns
    fourth = corpus_pipeline.all_repeated_passages(spark, second, str(tmp_path)).collect()
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = packed.collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: [*library.encode(r["text"], add_special_tokens=False).ids, 0] for r in fourth}
    assert set(ids) == set(firsts) and sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    for (s, at, n), (s2, at2, _) in zip(places, places[1:], strict=False):
        assert at2 == (at + n if s == s2 else 0) and at + n <= corpus_pipeline.CAPACITY
    assert len({s for s, _, _ in places}) == -(-sum(map(len, ids.values())) // corpus_pipeline.CAPACITY)


def test_pipeline_with_columns_of_any_name(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, d string, spans string, component_id int, _k1 string, kept string"
    rows = [(k, t, "en", "s", len(t), k, "d", "x", 1, "k", "y") for k, t in enumerate(["one two three four five six " * 3 + "seven eight nine"] * 2 + ["other words here " + "x y z a b c d e f g h i j k l m n o p q r"])]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == [f.split()[0] for f in schema.split(", ")]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_pipeline_edges(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, None, "en", "s", 0), (1, "a b", None, "s", 1), (None, "a b", "x", None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() >= 0
        assert stage(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 2


@pytest.mark.parametrize("n", [13, 51])
def test_repeated_runs_of_words(spark, corpus, n):
    texts = [*corpus, corpus[0], "a\tb  " * 40]
    words = [list(brute.WORD.finditer(t or "")) for t in texts]
    runs = [[tuple(m.group() for m in ws[k : k + n]) for k in range(len(ws) - n + 1)] for ws in words]
    count = Counter(r for rs in runs for r in rs)
    want = {}
    for k, (ws, rs) in enumerate(zip(words, runs, strict=True)):
        chars = {c for i, r in enumerate(rs) if count[r] > 1 for c in range(ws[i].start(), ws[i + n - 1].end())}
        if chars:
            want[k] = "".join(c for i, c in enumerate(texts[k]) if i not in chars)
    docs = spark.createDataFrame([(k, 0, t or "") for k, t in enumerate(texts)], "_k1 long, _k2 long, text string").repartition(5)
    got = {}
    for r in passages.repeated(docs, n).collect():
        data = texts[r["_k1"]].encode()
        gone = {b for a, e in r["spans"] for b in range(a, e)}
        got[r["_k1"]] = bytes(c for b, c in enumerate(data) if b not in gone).decode()
    assert got == want and len(want) > 50


def test_pipeline_finds_passages_of_short_words(spark):
    import corpus_pipeline

    rng = random.Random(8)
    passage = [prose(rng, 1)[:3] for _ in range(51)]
    assert len(" ".join(passage).encode()) < 400
    texts = [f"{prose(rng, 60)} {s.join(passage)} {prose(rng, 50)}" for s in (" ", " ", "\n")]
    texts += [f"{prose(rng, 60)} {' '.join(passage[:50])} {prose(rng, 50)}", prose(rng, 90)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["repeated_passages"](spark, docs, "").collect()}
    assert left == {k: t.replace(" ".join(passage), "").replace("\n".join(passage), "") for k, t in enumerate(texts)}
