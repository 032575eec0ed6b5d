"""HTML extraction, web archives and embeddings."""

import base64
import gzip
import hashlib
import io
import random
import time
from collections import Counter
from html.parser import HTMLParser

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest

from versewright.llm import embeddings, html_text, queries, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("just  text &amp; more", "just text & more"),
        ("<div>" * 3000 + "Deep text, here.", "Deep text, here."),
        ("<nav><ul><li><a>Home</a></li></ul></nav>", ""),
        ("<article><h1>T</h1><p><b>One\n two.<br><p>Three, four.</p></article><footer>&copy; x</footer>", "T\nOne two.\nThree, four."),
        ("<body><script>var t='</p>';</script><style>p{}</style><p>Text, yes.</p><!-- ad --><form><p>Name</p></form></body>", "Text, yes."),
        ("<body><div class='site-header'>Site</div><div id='main'><h2>Title</h2><p>A long text, with words. And more of it, here.</p><p>Short.</p><div class='ad'>Buy, now!</div></div><div class='comments'><p>Nice text, I like it! Really, a lot.</p></div></body>", "Title\nA long text, with words. And more of it, here.\nShort."),
        ("<article><header><h1>Kept</h1></header><p>Body, text.</p></article><aside>Other, things.</aside>", "Kept\nBody, text."),
        ("<p>a<b>b</b>c &#233;&nbsp;d</p><p></p><p hidden>gone, gone</p>", "abc é d"),
        ("<div class='post with-sidebar'><article class='post ad-free'><p>One, two.</p><article class='comment-list'><p>I like it, yes!</p></article></article></div>", "One, two."),
        ("<p title=\"a>b\">x, y</p><br/><broken", "x, y\n<broken"),
    ],
)
def test_main_text(page, text):
    assert html_text.extract(page) == text


LONG = "A long text, with words. And more of it, here."


@pytest.mark.parametrize(
    "page",
    [
        "<div id='content-sidebar-wrap'><main>{}</main></div><div class='sidebar'>Links, more.</div>",
        "<div class='layout sidebar-right'>{}<div class='sidebar'><p>Also, this.</p></div></div>",
        "<div class='article-with-comments'>{}</div><div class='post-comments'><p>I like it, yes! Really, I do. And more.</p></div>",
        "<section class='search-results'>{}</section><div class='site-footer'>All rights, reserved.</div>",
        "<div class='post ad-free'>{}<div class='ad-slot'>Buy, now!</div></div>",
        "<div class='widget'><article>{}</article></div>",
        "<div class='sidebar'><div class='search'>{}</div></div>",
        "<div class='story'>{}</div><div class='related'><article><p>Read, too.</p></article></div>",
    ],
)
def test_names_are_weak_evidence(page):
    assert html_text.extract(page.format(f"<p>{LONG}</p>")) == LONG


def test_no_content_is_given_up():
    body = f"<p>{LONG}</p>" * 20
    text = "\n".join([LONG] * 20)
    links = "<ul>" + "<li><a href='x'>Some link</a></li>" * 9 + "</ul>"
    assert html_text.extract(f"<body>{links}<div class='post'><h1>T</h1><p>Lead.</p><div class='body'>{body}</div><p>Closing.</p></div>{links}</body>") == f"T\nLead.\n{text}\nClosing."
    assert html_text.extract(f"<main><h1>T</h1><p>lead</p><article>{body}</article></main>") == f"T\nlead\n{text}"
    assert html_text.extract(f"<div>{links}<div><div>{body}</div><section><div>{LONG}</div></section></div></div>") == f"{text}\n{LONG}"


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<a '\"", "<!", "<p class='", "<div>", "<li><a>", "<script", "<b><header>"])
def test_broken_pages_take_time_in_proportion(unit):
    began = time.process_time()
    html_text.extract(unit * 100_000 + "</b>" * 50_000)
    assert time.process_time() - began < 5
    assert html_text.extract("<" + "a" * 100_000) and time.process_time() - began < 5


class Plain(HTMLParser):
    """Blocks of the one article of a page, by the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = False, [[]]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("p", "h1", "article"):
            self.parts.append([])
        if tag == "br":
            self.parts[-1].append(" ")

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        if tag in ("p", "h1", "article"):
            self.parts.append([])

    def handle_data(self, data):
        if self.inside:
            self.parts[-1].append(data)


def test_main_text_equals_a_plain_version_on_pages_with_an_article(spark):
    got = {r["page_id"]: r for r in queries.QUERIES["op3_html_text"](spark, SF).collect()}
    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    assert len(got) == len(pages) and all("<article>" in p["html"] for p in pages)
    for p in pages:
        plain = Plain()
        plain.feed(p["html"])
        plain.close()
        text = "\n".join(x for x in (" ".join("".join(b).split()) for b in plain.parts) if x)
        assert (got[p["page_id"]]["text"], got[p["page_id"]]["n_chars"]) == (text, len(text))


def test_tag_paths_select_content():
    # no name and no element says what is what: only the ratios of the paths do
    menu = "<div><ul>" + "".join(f"<li><a href='/{k}'>Link {k}</a></li>" for k in range(12)) + "</ul></div>"
    text = "".join(f"<p>{LONG}</p>" for _ in range(4))
    assert html_text.extract(f"<body>{menu}<div><div>{text}{menu}{text}</div></div>{menu}</body>") == "\n".join([LONG] * 8)


def test_main_text_table(spark):
    rows = spark.createDataFrame([(1, "u", "<p>One, two.</p>", "t"), (None, None, None, "t"), (1, "u", "<p>One, two.</p>", "t")], "page_id long, url string, html string, text string")
    got = [tuple(r) for r in html_text.main_text(rows).collect()]
    assert got.count((1, "u", "One, two.", 9)) == 2 and (None, None, "", 0) in got and len(got) == 3
    assert html_text.main_text(rows.limit(0)).count() == 0


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_archives(spark, tmp_path):
    big = bytes(random.Random(1).randrange(256) for _ in range(5000)).hex()
    html = {1: "a", 2: big, 3: "a", 4: None, 5: "", 6: "é\r\n\r\nWARC/1.1\r\n", 7: big, 8: big + "x"}
    df = spark.createDataFrame([(k, f"http://x/{k}\r\ny", v, "z") for k, v in html.items()], "page_id long, url string, html string, payload_bytes string").repartition(3)
    archives = warc.write(df, str(tmp_path / "w"), size=1000)
    assert archives.agg({"records": "sum"}).first()[0] == len(html)
    table = warc.read(spark, archives, size=1000).cache()
    assert table.where("length(chunk_bytes) > 1000").count() == 0 and table.where("record_key = '8'").count() == 11
    got = {int(r["record_key"]): (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.records(table).collect()}
    data = {k: (v or "").encode() for k, v in html.items()}
    top = {b: max(k for k in data if data[k] == b) for b in data.values()}
    assert got == {k: (len(b), digest(b), "response" if top[b] == k else "revisit", None if top[b] == k else str(top[b])) for k, b in data.items()}
    whole = {}
    for r in table.where("record_type = 'response'").orderBy("record_key", "chunk").collect():
        whole[int(r["record_key"])] = whole.get(int(r["record_key"]), b"") + bytes(r["chunk_bytes"])
        assert (r["so_far"], r["digest"]) == (len(whole[int(r["record_key"])]), digest(whole[int(r["record_key"])]))
    assert whole == {k: data[k] for k in top.values()}
    large = warc.write(df, str(tmp_path / "v"), least=2)
    kinds = {int(r["record_key"]): r["record_type"] for r in warc.records(warc.read(spark, large)).collect()}
    assert kinds[1] == kinds[4] == "response" and kinds[2] == "revisit"
    assert warc.records(warc.read(spark, warc.write(df.limit(0), str(tmp_path / "e")))).count() == 0


def test_archives_of_null_and_repeated_rows(spark, tmp_path):
    rows = [(None, "u", "a"), (None, None, "a"), (3, "u", "a"), (3, "u", "a"), (3, "v", "b"), (None, "u", "c"), (None, "u", "c"), (1, "u", "b"), (5, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in queries.QUERIES["op6_warc"](spark, str(tmp_path)).collect())
    want = [(None, 1, "revisit", 3)] * 2 + [(3, 1, "response", None), (3, 1, "revisit", 3), (3, 1, "response", None), (1, 1, "revisit", 3)]
    assert got == Counter([*want, (None, 1, "response", None), (None, 1, "revisit", None), (5, 0, "response", None)])


def test_payloads_are_written_from_their_chunks(spark, tmp_path, monkeypatch):
    seen = []
    plain = warc.chunks
    monkeypatch.setattr(warc, "chunks", lambda *a, **k: seen.append(plain(*a, **k).where("chunk <> 1")) or seen[0])
    df = spark.createDataFrame([(1, "u", "abcdefgh")], "page_id long, url string, html string")
    table = warc.read(spark, warc.write(df, str(tmp_path / "w"), size=3), size=3)
    assert len(seen) == 1
    with pytest.raises(Exception, match="damaged|cut off|no record"):  # the archive lacks the bytes of the chunk that was lost
        warc.records(table).collect()


def test_chunks(spark):
    df = spark.createDataFrame([(1, "abcdefgh", "u"), (2, None, "v"), (2, "", "v")], "page_id long, html string, chunk string")
    rows = [tuple(r) for r in warc.chunks(df, "page_id", "html", size=3).drop("record").orderBy("page_id", "chunk").collect()]
    assert [(r[0], r[1], bytes(r[2]), r[3], r[5]) for r in rows] == [(1, 0, b"abc", 3, False), (1, 1, b"def", 6, False), (1, 2, b"gh", 8, True), (2, 0, b"", 0, True), (2, 0, b"", 0, True)]
    assert rows[2][4] == digest(b"abcdefgh")


def test_damaged_archives():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [p[2] for p in warc.parse(io.BytesIO(gzip.compress(record) + gzip.compress(record)), 3)] == [b"hel", b"lo"] * 2
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(io.BytesIO(gzip.compress(record[:-8]))))
    with pytest.raises(ValueError, match="no record"):
        list(warc.parse(io.BytesIO(gzip.compress(b"x" + record))))


def vectors(seed=3, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, dims))
    x = [c + 0.12 * rng.standard_normal(dims) for c in centres for _ in range(3)]
    x += [centres[0] + 0.1 * rng.standard_normal(dims) for _ in range(120)] + [2 * centres[1]] * 5 + list(rng.standard_normal((100, dims)))
    return [v.astype(np.float32).tolist() for v in x]


@pytest.mark.parametrize("cell, block, group", [(2048, 512, 2048), (16, 8, 2048), (16, 8, 40)])
def test_embeddings(spark, monkeypatch, cell, block, group):
    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "GROUP", group)
    x = vectors()
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0], []]
    df = spark.createDataFrame([(k + 10, v, "l", 1) for k, v in enumerate(x + odd)], "vec_id long, embedding array<float>, label string, n_links int").repartition(4)
    rows = {r["vec_id"]: r for r in embeddings.near_duplicates(df, 0.9, recall=0.999).collect()}
    u = np.array(x, float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    found = sum(rows[k + 10]["n_links"] for k in range(len(x)))
    assert found >= 0.99 * close.sum() and all(rows[k + 10]["n_links"] <= close[k].sum() for k in range(len(x)))
    component = brute.components(range(len(x)), zip(*map(list, np.nonzero(close)), strict=True))
    # a lost link may part a component, never join two
    assert all(rows[k + 10]["component_id"] == rows[component[k] + 10]["component_id"] == component[k] + 10 for k in range(len(x)) if rows[k + 10]["n_links"] == close[k].sum() and close[k].any())
    assert all(component[rows[k + 10]["component_id"] - 10] == component[k] and rows[k + 10]["kept"] == (rows[k + 10]["component_id"] == k + 10) for k in range(len(x)))
    for k in range(len(x), len(x) + len(odd)):
        assert (rows[k + 10]["n_links"], rows[k + 10]["component_id"], rows[k + 10]["kept"]) == (0, k + 10, True)


def partners(rng, x, cosine):
    """For each unit vector one at just that cosine."""
    y = rng.standard_normal(x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    return cosine * x + (1 - cosine**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)


@pytest.mark.parametrize("n", [30, 300, 3000])
@pytest.mark.parametrize("cosine", [0.9005, 0.93])
def test_recall_at_the_default_setting(spark, n, cosine):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.concatenate([x, partners(rng, x, cosine)])
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    rows = {r["vec_id"]: r for r in embeddings.near_duplicates(df, 0.9).collect()}
    found = sum(rows[k]["n_links"] for k in range(n))
    assert 0.9 * n <= found <= n
    assert all(rows[k + n]["component_id"] == k for k in range(n) if rows[k]["n_links"])


def test_ties_at_the_bound_link(spark):
    # cosines of exactly 0.6 and 0.8 in doubles
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.6, 0.8, 0.0]), (3, [0.0, 0.0, 1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.6, recall=0.9999).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_a_chain_of_neighbours_is_no_group_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "GROUP", 50)
    angle = np.linspace(0, 40, 1500)  # each is close to some sixty others; the chain connects all
    x = np.stack([np.cos(angle), np.sin(angle), *(np.sin(angle * f) for f in (0.31, 0.47))], axis=1)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.995
    np.fill_diagonal(close, False)
    rows = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df, 0.995).collect()}
    assert 0.9 * close.sum() <= sum(rows.values()) <= close.sum() and all(rows[k] <= close[k].sum() for k in rows)


@pytest.mark.parametrize("kind", ["off centre", "hot cluster"])
def test_recall_where_the_mean_is_not_zero(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3200, 64)) / 8
    share = len(x) if kind == "off centre" else len(x) // 3
    x[:share, 0] += 1.3 if kind == "off centre" else 1.8
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = min(share, 600)
    x = np.concatenate([x, partners(rng, x[:pairs], 0.905)])
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    assert pairs * 2 <= close.sum() < pairs * 3 and len(x) > embeddings.CELL
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    found = sum(r["n_links"] for r in embeddings.near_duplicates(df, 0.9).collect())
    assert 0.9 * close.sum() <= found <= close.sum()


def test_embedding_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([(1, None)], schema)).first()["n_links"] == 0
    rows = embeddings.near_duplicates(spark.createDataFrame([(4, [1.0, 0.0]), (4, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [2.0, 0.1])], schema)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in rows) == [(0, 3, 3), (3, 3, 3), (4, 3, 3), (4, 3, 3)]


def test_shares_of_a_crowded_cell_all_meet(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 20)
    # a chain of codes: each is close to the next alone, so roots of shares are far apart
    class Plain:
        bits = 128

    words = [((1 << min(k, 60)) - 1, (1 << max(k - 60, 0)) - 1) for k in range(120)]
    rows = spark.createDataFrame([(7, k, a, b) for k, (a, b) in enumerate(words)], "key long, node long, c1 long, c2 long")
    monkeypatch.setattr(embeddings, "codes", lambda *_: rows)
    monkeypatch.setattr(embeddings.math, "ceil", lambda _: 1)
    got = {r["node"]: r["component"] for r in embeddings.candidates(rows, 0.9, Plain).collect()}
    assert got == dict.fromkeys(range(120), 0)


def test_recall_of_the_tables():
    tables, bits = embeddings.layout(1_000_000, 0.9)
    assert bits == 21 and tables > 30
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64))
    mean, turns = embeddings.learn(x, 2)
    signs = (x - mean) @ turns[0] > 0
    assert abs(signs.mean() - 0.5) < 0.05  # balanced bits
