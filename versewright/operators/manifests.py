"""Validation of resource manifests: rules over one parsed manifest, and joins of its projects to the files beside it.

A manifest is one small document; its rules are a Python function in an Arrow-batched UDF that returns all issues of a
row, so any number of manifests is checked in one pass. What compares manifests with files is a join.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims

# Fields, kinds of projects, and what each kind must say.
TOP = "dublin_core checking projects".split()
CORE = "conformsto contributor creator description format identifier issued modified language publisher relation rights source subject title type version".split()
PROJECT = "title versification identifier sort path categories".split()
ALIGNED = frozenset("ust ult iev irv isv glt gnt gst ocb rhb rlb rlv rob rlob rsob stv tlob trs".split())
BIBLES = ALIGNED | frozenset("ulb udb reg ayt blv cuv nav det juds opcb".split())
HELPS = frozenset("tn tq tw ta obs obs-tn obs-tq obs-sn obs-sq".split())
STORIES = frozenset("obs obs-tn obs-tq obs-sn obs-sq".split())
SUBJECTS = {"ta": "Translation Academy", "tw": "Translation Words", "tn": "Translation Notes", "tn-tsv": "TSV Translation Notes", "tq": "Translation Questions", "obs": "Open Bible Stories", "obs-tq": "OBS Translation Questions", "obs-tn": "OBS Translation Notes", "obs-sq": "OBS Study Questions", "obs-sn": "OBS Study Notes"}
TYPES = {"ta": "man", "tw": "dict", "obs": "book"} | dict.fromkeys("tn tn-tsv tq obs-tn obs-tq obs-sn obs-sq".split(), "help")
SECTIONS = {"intro": ("Introduction to Translation Academy", 0), "process": ("Process Manual", 1), "translate": ("Translation Manual", 2), "checking": ("Checking Manual", 3)}
PAIRS = "1sa 2sa|1ki 2ki|1ch 2ch|1co 2co|1th 2th|1ti 2ti|1pe 2pe|1jn 2jn|1jn 3jn|2jn 3jn"
ORDINALS = {"1": "1१১၁", "2": "2२২၂", "3": "3३৩၃"}


def is_bible(kind: str, forced: bool = False) -> bool:
    return forced or kind in BIBLES


def keys(group: str, found: dict, wanted: list[str]) -> list[str]:
    """Fields that are missing, and those that don't belong."""
    extra = [k for k in found if k not in wanted and not (k == "comment" and group == "dublin_core")]
    return [f"Missing field: {group}:{k}" for k in wanted if k not in found] + [f"Extra field: {group}:{k}" for k in extra]


def text_field(found: dict, key: str, least: int) -> list[str]:
    value = found.get(key, "x" * least)
    if not isinstance(value, str):
        return [f"Value must be a string: {key}: {value}"]
    return [f"Invalid value for {key}: {value}"] if len(value) < least else []


def kind_of(core: dict) -> str:
    kind = core.get("identifier") or ""
    return "tn-tsv" if kind == "tn" and core.get("format") == "text/tsv" else kind


def core_issues(core: dict, folder: str, today: str, ascii_ok: bool, forced: bool, source_publishers: tuple = ()) -> list[str]:
    kind, out = kind_of(core), keys("dublin_core", core, CORE)
    bible = is_bible(kind, forced)
    say = out.append
    language = core.get("language") or {}
    code, own = language.get("identifier"), folder.split("_", 1)[0]
    if kind.removesuffix("-tsv") not in HELPS and not bible:
        say(f"Invalid id: {kind}")
    last = folder.rsplit("_", 1)[-1].lower()
    if last != kind.removesuffix("-tsv").lower() and not last.startswith(kind.lower() + "."):
        say(f"Possible error: project identifier ({kind}) does not match last part of directory name: {last}")
    if core.get("conformsto", "rc0.2") != "rc0.2":
        say(f"Invalid value for conformsto: {core['conformsto']}")
    if core.get("rights", "CC BY-SA 4.0") != "CC BY-SA 4.0":
        say(f"Invalid value for rights: {core['rights']}")
    if "contributor" in core:
        people = core["contributor"] or []
        out += ["Missing contributors!"] if not people else [f"Invalid contributor name: {c}" for c in people if not isinstance(c, str) or len(c) < 3]
    out += text_field(core, "creator", 3) + text_field(core, "format", 8)
    issued, modified = str(core.get("issued", "")), str(core.get("modified", ""))
    for day in (issued, modified):
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day):
            say(f"Invalid date: {day}")
    if modified != today:
        say(f"Modified date is not today: {modified}")
    if issued > modified:
        say(f"Dates wrong - issued: {issued}, modified: {modified}")
    form = core.get("format")
    expected = {"text/markdown"} if kind in HELPS else {"text/tsv"} if kind == "tn-tsv" else {"text/usfm3"} if kind in ("ust", "irv", "glt", "gst", "rob", "rlob", "rsob") else {"text/usfm", "text/usfm3"}
    if isinstance(form, str) and form not in expected:
        say(f"Invalid format: {form}")
    out += keys("language", language, ["direction", "identifier", "title"])
    if language.get("direction", "ltr") not in ("ltr", "rtl"):
        say(f"Incorrect language direction: {language['direction']}")
    if code is not None and code != own:
        say(f"Language identifier ({code}) does not match first part of directory name: {folder}")
    out += text_field(language, "title", 3)
    if isinstance(language.get("title"), str) and language["title"].isascii() and not ascii_ok:
        say(f"Possible error: remember to localize language title: {language['title']}")
    publisher = str(core.get("publisher", ""))
    if code != "en" and any(p.lower() in publisher.lower() for p in source_publishers):
        say(f"Invalid publisher: {publisher}")
    relations = core.get("relation") or []
    if len(set(map(str, relations))) < len(relations):
        say("There are duplicates in the relations list")
    if len(relations) < 2 and not bible and kind != "obs":
        say("Possible error: the relations list seems incomplete")
    for r in relations:
        if not isinstance(r, str) or len(r) < 5:
            say(f"Invalid value for relation element: {r}")
        elif r.count("/") != 1:
            say(f"Invalid format for relation element: {r}")
        else:
            a, b = r.split("/")
            if a not in (own, "el-x-koine", "hbo"):
                say(f"Possible error: non-matching language code for relation element: {r}")
            if b not in HELPS | {"tm"} and not is_bible(b, forced) and not b.startswith(("ugnt", "uhb")):
                say(f"Invalid project code in relation element: {r}")
    if kind == "tn-tsv":
        for name, what in (("el-x-koine/ugnt?v=", "NT"), ("hbo/uhb?v=", "OT")):
            if not any(str(r).startswith(name) for r in relations):
                say(f"Must reference '{name}...' in relation if there are any {what} notes")
    sources = core.get("source") or []
    if not sources:
        say("Invalid source spec: should be an array of records of three fields.")
    for s in sources:
        out += keys("source[x]", s, ["language", "identifier", "version"])
        sid, lang = str(s.get("identifier", "")), s.get("language")
        wanted = "obs" if kind in STORIES else "tn" if kind == "tn-tsv" else kind if kind in ("tn", "tq", "tw") else sid
        if sid != wanted:
            say(f"Inappropriate source:identifier ({sid}) for project type: {kind}")
        if not re.match(r"[a-z][a-z0-9-]", sid):
            say(f"Invalid source:identifier (need lower case ascii, no spaces): {sid}")
        if lang == "English":
            say("Use a language code in source:language, not 'English'")
        elif lang == own:
            say("Possible error: source:language matches target language")
        elif lang not in ("en", "hbo", "el-x-koine"):
            say(f"Possible error: source:language: {lang}")
        out += text_field(s, "version", 1)
        if re.search(r"\s", str(s.get("version", ""))):
            say("White space in source:version")
    subject = core.get("subject")
    if bible and (subject not in ("Bible", "Aligned Bible") or (kind in ALIGNED and subject != "Aligned Bible")):
        say(f"Invalid subject: {subject}")
    elif not bible and kind in SUBJECTS and subject != SUBJECTS[kind]:
        say(f"Invalid subject: {subject} (expected '{SUBJECTS[kind]}')")
    title = core.get("title")
    if not isinstance(title, str) or len(title) < 3:
        say(f"Invalid title: {title}")
    elif (kind in ("iev", "udb", "ust", "gst") and re.search("Literal|Revised", title)) or (kind in ("irv", "isv", "ulb", "ult", "glt") and re.search("Easy|Dynamic", title)):
        say(f"Title contradicts project type: {title}")
    wanted = "bundle" if bible else TYPES.get(kind)
    if wanted and core.get("type") != wanted:
        say(f"Invalid type: {core.get('type')}")
    if re.search(r"\s", str(core.get("version", ""))):
        say("White space in version number")
    return out


def checking_issues(checking: dict, kind: str) -> list[str]:
    out = keys("checking", checking, ["checking_entity", "checking_level"])
    entities = checking.get("checking_entity", ["xxx"]) or []
    out += ["Missing checking_entity."] if not entities else [f"Invalid checking_entity: {c}" for c in entities if not isinstance(c, str) or len(c) < 3]
    level = checking.get("checking_level", "3")
    if not isinstance(level, str):
        out.append("checking_level must be a string")
    elif level != "3" and kind not in ("reg", "tq"):
        out.append(f"Invalid value for checking_level: {level}")
    return out


def title_issues(title: str, book: str, ascii_ok: bool) -> list[str]:
    out = [f"ASCII project:title: {title}"] if title.isascii() and not ascii_ok else []
    if title.endswith("."):
        out.append(f"project:title has punctuation: {title}")
    digits = re.findall(r"\d", title)
    unwanted = set(digits) - set(ORDINALS.get(book[:1], ""))
    if unwanted:
        out.append(f"Unwanted digits {sorted(unwanted)} in project:title: {title}")
    elif len(digits) > 1:
        out.append(f"Extra digits in project:title: {title}")
    return out


def project_issues(p: dict, kind: str, ascii_ok: bool, forced: bool) -> list[str]:
    out = keys("projects", p, PROJECT)
    say = out.append
    title, ident, sort, path, cats = str(p.get("title", "")), str(p.get("identifier", "")), p.get("sort"), str(p.get("path", "")), p.get("categories") or []
    root, _, ext = path.rpartition(".")
    if ext.lower() == "usfm" and (ext.isupper() or not root.isupper()):
        say(f"Incorrect case in project:path: {path}. Use {path.upper().replace('USFM', 'usfm')}")
    if not isinstance(sort, int):
        say(f"project:sort is the wrong type: {sort}")
    order = next((r[4] for r in dims.book_rows() if r[0] == ident.upper()), None)
    bible = is_bible(kind, forced)
    if kind == "ta":
        if cats != ["ta"]:
            say(f"Invalid project:categories: {cats}")
        if ident not in SECTIONS:
            say(f"Invalid project:identifier: {ident}")
        else:
            name, place = SECTIONS[ident]
            if title.isascii() and title != name:
                say(f"Invalid project:title: {title}")
            if sort != place:
                say(f"Invalid project:sort: {sort}")
    elif kind in ("tn", "tq", "tn-tsv") or bible:
        if sort != order:
            say(f"Incorrect project:sort: {sort}")
        if kind == "tn" and cats:
            say("Categories list should be empty: project:categories")
        if kind == "tn-tsv" or bible:
            if p.get("versification") != "ufw":
                say(f"Invalid project:versification: {p.get('versification')}. Should be 'ufw'")
            if cats not in (["bible-ot"], ["bible-nt"]):
                say(f"Invalid project:categories: {cats}")
        if bible:
            out += title_issues(title.strip(), ident, ascii_ok)
            if len(ident) != 3:
                say(f"Invalid project:identifier: {ident}")
    elif kind == "tw":
        if title not in ("translationWords", "Translation Words"):
            say(f"Invalid project:title: {title}. Should be translationWords or Translation Words")
    elif kind in STORIES:
        if cats:
            say("Categories list should be empty: project:categories")
        if ident != "obs":
            say(f"Invalid project:identifier: {ident}")
        ends = {"obs": "Open Bible Stories", "obs-tn": "Open Bible Stories Translation Notes", "obs-tq": "Open Bible Stories Translation Questions", "obs-sn": "Open Bible Stories Study Notes", "obs-sq": "Open Bible Stories Study Questions"}
        if ends[kind] not in title and not (kind == "obs-tn" and title == "OBS translationNotes"):
            say(f"Invalid project:title: {title}")
        if kind == "obs" and p.get("versification"):
            say("Should be blank: project:versification")
    else:
        say("Possible error: verify each project entry manually.")
    return out


def pair_issues(projects: list[dict]) -> list[str]:
    """Titles of books that come in twos and threes should differ in their number alone."""
    titles, out = {p.get("identifier"): str(p.get("title") or "") for p in projects}, []
    for pair in PAIRS.split("|"):
        a, b = (titles.get(x) for x in pair.split())
        if not a or not b:
            continue
        left, right = pair.upper().split()
        if (a[0].isdecimal(), a[-1].isdecimal()) != (b[0].isdecimal(), b[-1].isdecimal()):
            out.append(f"Inconsistent book titles ({a} for {left} vs. {b} for {right})")
        else:
            x, y = (" ".join(w for w in t.split() if not w.isdecimal()) for t in (a, b))
            if re.search(r"\d", a + b) and x != y:
                out.append(f"Inconsistent book names ({x} for {left} vs. {y} for {right})")
    return out


def manifest_issues(text: str, folder: str, today: str, ascii_ok: bool = False, forced: bool = False, source_publishers: tuple = ()) -> list[str]:
    """All issues of one manifest, given as JSON. source_publishers: those of the source texts, who don't publish translations."""
    m = json.loads(text)
    if not isinstance(m, dict) or "error" in m:
        return [m["error"] if isinstance(m, dict) else "Syntax error in manifest"]
    core, projects = m.get("dublin_core") or {}, m.get("projects") or []
    kind = kind_of(core)
    out = keys("", m, TOP) + core_issues(core, folder, today, ascii_ok, forced, source_publishers) + checking_issues(m.get("checking") or {}, kind)
    n = len(projects)
    if not n:
        out.append("Empty projects list")
    elif kind in STORIES | {"tw"} and n != 1:
        out.append("There should be exactly 1 project listed under projects.")
    elif kind == "ta" and n != 4:
        out.append("There should be exactly 4 projects listed under projects.")
    elif (kind in ("tn", "tn-tsv", "tq") or is_bible(kind, forced)) and n not in (27, 39, 66):
        out.append(f"Possible error: number of projects listed: {n}")
    if is_bible(kind, forced):
        out += pair_issues(projects)
    for p in projects:
        out += project_issues(p, kind, ascii_ok, forced)
    return out


def verify(manifests: DataFrame, today: str, ascii_ok: bool = False, forced: bool = False, source_publishers: tuple = ()) -> DataFrame:
    """(path, msg): issues of manifests (path, json[, has_bom]); ``today`` is a date that the modified date should be."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.path, m) for r in b.itertuples() for m in manifest_issues(r.json, r.path.rsplit("/", 2)[-2] if "/" in r.path else "", today, ascii_ok, forced, source_publishers)]
            yield pd.DataFrame(rows, columns=["path", "msg"])

    out = manifests.select("path", "json").mapInPandas(run, "path string, msg string")
    if "has_bom" in manifests.columns:
        out = out.unionByName(manifests.where("has_bom").select("path", F.lit("File has a Byte Order Mark. Remove it.").alias("msg")))
    return out


def projects_of(manifests: DataFrame) -> DataFrame:
    """(path, folder, file, title, identifier): the projects of manifests."""
    schema = "struct<projects:array<struct<title:string,identifier:string,path:string>>>"
    rows = manifests.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.explode(F.from_json("json", schema)["projects"]).alias("p"))
    return rows.select("path", "folder", F.regexp_replace("p.path", r"^\./", "").alias("file"), "p.title", "p.identifier")


def file_issues(manifests: DataFrame, files: DataFrame, titles: DataFrame) -> DataFrame:
    """(path, msg): projects without a file, or with one of other case; titles that the book doesn't have; files that don't belong.

    files: (path) of everything in the folders; titles: (path, titles) of books.
    """
    p = projects_of(manifests).withColumn("full", F.concat_ws("/", "folder", "file"))
    names = files.select(F.col("path").alias("there"))
    exact = p.join(names, F.col("full") == F.col("there"), "left_anti")
    cased = exact.join(names, F.lower("full") == F.lower("there"), "left")
    missing = cased.select("path", F.when(F.col("there").isNull(), F.concat(F.lit("Invalid path: "), "file")).otherwise(F.concat(F.lit("Case mismatch in file name. Use "), "file", F.lit(", as in manifest file."))).alias("msg"))
    other = p.join(titles.withColumnRenamed("path", "full"), "full").where(~F.array_contains("titles", F.trim("title"))).select("path", F.concat(F.lit("project:title "), "title", F.lit(" does not match any of the titles in "), "file", F.lit(".")).alias("msg"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    stray = files.where(name.rlike("temp|tmp|orig|bak|Copy|txt|projects|\\.field$") & ~name.rlike(r"^issues.*\.txt$|^wordlist\.txt$|^(temple|tempt|contempt|habakkuk)\.md$|^translate-original$") | (name.contains("manifest") & (name != "manifest.yaml")) | name.rlike(r"\d{4,}.*\.md$"))
    license_ = manifests.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder")).join(files.where(F.upper(name).rlike(r"^LICENSE(\.(TXT|MD))?$")).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")), "folder", "left_anti").select("path", F.lit("LICENSE file is missing").alias("msg"))
    readme = manifests.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder")).join(files.where(name.rlike(r"^README(\.md)?$")).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")), "folder", "left_anti").select("path", F.lit("No README file is found").alias("msg"))
    return missing.unionByName(other).unionByName(stray.select("path", F.lit("Extraneous or misnamed file").alias("msg"))).unionByName(license_).unionByName(readme)


def chapter_files(files: DataFrame, books: DataFrame, kind: str) -> DataFrame:
    """(path, msg): note files book/chapter/name.md with odd names, and books with fewer chapter folders than they should have."""
    part = lambda k: F.regexp_extract("path", r"/([^/]+)/(\d+)/([^/]+)$", k)
    rows = files.select("path", part(1).alias("book"), part(2).alias("chapter"), part(3).alias("name")).where("book <> ''")
    pattern = F.when((F.lower("book") == "psa") & F.lit(kind != "tq"), F.col("name").rlike(r"^[01]\d\d\.md$")).otherwise(F.col("name").rlike(r"^[0-8]\d\.md$"))
    loose = F.lit(kind == "tq") & (F.lower("book") == "psa") & (F.col("chapter") == "119")
    odd = rows.where(~pattern & (F.col("name") != "intro.md") & ~loose).select("path", F.concat(F.lit("Invalid file name: "), "name").alias("msg"))
    n = rows.groupBy("book").agg(F.count_distinct("chapter").alias("n"), F.min("path").alias("path")).join(F.broadcast(books.select(F.lower("id").alias("b"), "chapters")), F.lower("book") == F.col("b"), "left")
    few = n.where("chapters is null or n < chapters or book <> lower(book)").select("path", F.when(F.col("chapters").isNull(), F.concat(F.lit("Invalid(?) file or folder: "), "book")).when(F.col("n") < F.col("chapters"), F.concat(F.lit("Missing chapters in: "), "book")).otherwise(F.concat(F.lit("Upper case book folder: "), "book")).alias("msg"))
    return odd.unionByName(few)


def toc_issues(contents: dict, where: str) -> list[str]:
    """Sections of a table of contents that are empty or link by other than ASCII, at any depth, and titles left in ASCII."""

    def walk(node: dict) -> tuple[int, list[str]]:
        n, out = int(str(node.get("title", "")).isascii()), []
        if "sections" in node and not node["sections"]:
            out.append(f"Empty section ({node.get('title')}) in {where}")
        for s in node.get("sections") or []:
            k, more = walk(s)
            n, out = n + k, out + more
        if not str(node.get("link", "")).isascii():
            out.append(f"Non-ASCII link ({node['link']}) in {where}")
        return n, out

    n, out = walk(contents)
    return out + ([f"Possible error: {n} likely untranslated titles in {where}"] if n else [])


def media_issues(contents: dict) -> list[str]:
    """A media list needs known projects, and each of them some media with an identifier, version and url."""
    out = keys("", contents, ["projects"])
    for p in contents.get("projects") or []:
        if p.get("identifier") not in ("obs", "obs-tn", "obs-tq"):
            out.append(f"Unknown identifier in media.yaml: {p.get('identifier')}")
        elif not p.get("media"):
            out.append("No media are defined in media.yaml")
        else:
            out += [f"Incomplete medium: {m.get('identifier')}" for m in p["media"] if not (m.get("identifier") and m.get("version") and m.get("url"))]
    return out if contents.get("projects") else [*out, "media.yaml is empty"]


def article_files(files: DataFrame) -> DataFrame:
    """(article, msg): articles of a manual without their text, title or subtitle."""
    rows = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("article"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name")).groupBy("article").agg(F.collect_set("name").alias("names"))
    wanted = F.array(*[F.lit(n) for n in ("01.md", "title.md", "sub-title.md")])
    return rows.where(F.size(F.array_intersect("names", wanted)) > 0).select("article", F.explode(F.array_except(wanted, F.col("names"))).alias("name")).select("article", F.concat(F.lit("Missing file: "), "name").alias("msg"))
