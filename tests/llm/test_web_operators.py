"""Page templates, WARC derivatives and licence scans on hand-made cases."""

import hashlib
import html
import json
import math
import re
import time
from collections import Counter

import duckdb
import pytest

from shelfkin.llm import licence_scan, template_html, warc_derive
from shelfkin.llm.queries import QUERIES, SQL

PAGES = "page_id bigint, url string, html string"


def page(k, body, extra=""):
    return f"""<!DOCTYPE html><html><head><title>T{k}</title><style>p{{margin:0}}</style><script>var t="</p><p>no";</script></head>
<body><div id="cookie-notice"><p>We use cookies.</p></div><header class="site-header"><a href="/">Site {k % 2}</a></header>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- <p>hidden</p> -->{body}
<form action="/s"><label>Find</label><input name=q><button>Go</button></form><footer>&copy; all</footer>{extra}</body></html>"""


def text_of(source, container=None, fixed=()):
    return template_html.extract(template_html.Page(source), container, set(fixed))


def test_page_parts():
    article = "<article class='post comments-open'><header><h1>Head &amp; shoulders</h1></header><p>One <b>bo</b>ld<br>two<p>three\n  four &#8212; five&nbsp;x<aside>no</aside><ul><li>x<li>y</ul>"
    article += "<div class='ad'>buy</div><table><tr><td>1<td>2<tr><td>3</table><div class=comments><p>reader</p></div></article>"
    assert text_of(page(1, article)) == "Head & shoulders One bold two three four — five x x y 1 2 3"
    assert text_of(page(2, "<div class=main><p>a > b &lt; c</p></div>")) == "a > b < c"
    assert text_of("<p>no container</p>plain") == "no container plain"
    assert text_of("<p title='a>b' class=x>t<!-- open <p>never") == "t"
    assert text_of("") == "" and text_of("<") == "<" and text_of("<script>x") == "" and text_of("a <3 b </> c") == "a <3 b c"
    assert text_of("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert text_of("<article>" + "word " * 100_000 + "</article>") == ("word " * 100_000).strip()


def test_templates_find_the_slot(spark):
    rows = []
    for k in range(20):
        body = f"<div class=wrap><div class=story><h2>Story {k}</h2><p>{'text ' * (20 + k)}{k}</p><p>more {k}</p><p class=promoted>Read it every day</p></div></div><div class=rank><p>Ranking of the week</p></div>"
        rows.append((k, f"http://news.example.org/{k}", page(k, body)))
    got = {r["page_id"]: r["text"] for r in template_html.extract_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {k: f"Story {k} {'text ' * (20 + k)}{k} more {k}" for k in range(20)}
    placed = template_html.with_site(spark.createDataFrame(rows, PAGES).withColumnRenamed("page_id", "id"))
    template = template_html.deduce_templates(placed).collect()
    assert [t["site"] for t in template] == ["news.example.org"]
    assert template[0]["container"] == "/html/body/div.wrap/div.story" and template[0]["fixed"] == [template_html._hash("/html/body/div.wrap/div.story/p.promoted\0Read it every day")]
    classes = {t["path"]: (t["class"], t["within"]) for t in template[0]["template"]}
    assert classes["/html/body"][0] == classes["/html/body/div.wrap"][0] == classes["/html/body/div.wrap/div.story/h2"][0]
    inner = classes["/html/body/!nav/ul/li"]
    assert inner[0] != classes["/html/body"][0] and inner[1] == classes["/html/body"][0]


def test_copies_on_a_host_keep_their_text(spark):
    rows = [(k, "http://same.example.org/", page(1, "<div><p>all the same words here</p></div>")) for k in range(12)]
    assert {r["text"] for r in template_html.extract_pages(spark.createDataFrame(rows, PAGES)).collect()} == {"all the same words here"}


WRAPPED = [
    "<div class='layout with-sidebar'><article>{}</article></div>",
    "<div class='has-banner no-comments'><main>{}</main></div>",
    "<form><article>{}</article></form>",
    "<article><section class='search-results-study'>{}</section></article>",
    "<div class='social-feed'><div class=story>{}</div></div>",
]


@pytest.mark.parametrize("wrapper", WRAPPED)
@pytest.mark.parametrize("pages", [1, 2, 20])
def test_names_of_wrappers_remove_nothing(spark, wrapper, pages):
    rows = []
    for k in range(pages):
        text = f"<h1>Head {k}</h1><p>{'some words ' * (15 + k)}{k}</p><div class=ad>buy now {k}</div>"
        comments = "<div class=comments><article>a reader said so</article></div>" if "<article" in wrapper else ""
        rows.append((k, f"http://w.org/{k}", page(k, wrapper.format(text) + comments)))
    got = {r["page_id"]: r["text"] for r in template_html.extract_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {k: f"Head {k} {'some words ' * (15 + k)}{k}" for k in range(pages)}


def test_fixed_blocks_in_the_path_of_the_article_are_template(spark):
    rows = []
    for k in range(20):
        own = [f"<p>{'varying ' * (3 + (k * j) % 7)}{k} {j}</p>" for j in range(4)]
        own.insert(k % 4, "<p>Sign up now for our letter</p>")
        rows.append((k, f"http://letters.org/{k}", page(k, f"<article>{''.join(own)}</article>")))
    # Copies of one page, and the same words once on another host, are no evidence.
    rows += [(100 + k, "http://letters.org/0", rows[0][2]) for k in range(30)]
    rows += [(200, "http://alone.org/", "<article><p>Sign up now for our letter</p></article>")]
    rows += [(300 + k, f"http://near.org/{k}", page(0, f"<article><p>{'the same long text ' * 20}</p><p>{k}</p></article>")) for k in range(12)]
    got = {r["page_id"]: r["text"] for r in template_html.extract_pages(spark.createDataFrame(rows, PAGES)).collect()}
    for k in range(20):
        assert got[k] == " ".join(f"{'varying ' * (3 + (k * j) % 7)}{k} {j}" for j in range(4))
    assert all(got[100 + k] == got[0] for k in range(30)) and got[200] == "Sign up now for our letter"
    assert all(got[300 + k] == f"{'the same long text ' * 20}{k}" for k in range(12))


def test_classes_equal_brute_force(spark, sf):
    """The classes of whole vectors, page by page, on the whole table."""
    pages = template_html.with_site(spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id AS id", "url", "html"))
    by_site = {}
    for r in pages.collect():
        by_site.setdefault(r["site"], {})[r["html"]] = None
    expected = set()
    for site, sources in by_site.items():
        counted = []
        for source in sources:
            parsed = template_html.Page(source)
            counted.append(Counter(parsed.elements) + Counter(f"{p}\0{t}" for p, t in parsed.blocks))
        most = max((sum(e in c for c in counted) for e in {t for c in counted for t in c if "\0" not in t}), default=0)
        vectors = {}
        for token in {t for c in counted for t in c}:
            vector = tuple(c[token] for c in counted)
            if sum(map(bool, vector)) >= max(2, 0.5 * most):
                vectors.setdefault(vector, set()).add(template_html._hash(token))
        expected |= {(site, frozenset(members)) for members in vectors.values()}
    classes = {}
    for r in template_html.equivalence_classes(pages).collect():
        classes.setdefault((r["site"], r["vector"], r["pages"]), set()).add(r["token"])
    assert {(site, frozenset(members)) for (site, _, _), members in classes.items()} == expected and expected


def test_very_long_pages_take_linear_time():
    took = []
    for n in (20_000, 80_000):
        source = "<body>" + "".join(f"<div class=note{k % 7}><article><section><p>w {k}" + "</div>" * (k % 3) + "<li>" for k in range(n))
        start = time.perf_counter()
        assert text_of(source)
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0]


def test_page_rows(spark):
    rows = [(1, None, None), (2, "no url", ""), (3, "http://x.org/", "<article>z</article>"), (3, "http://x.org/", "<article>z</article>"), (None, "HTTP://u@X.org:80/q", "<main>m</main>")]
    df = spark.createDataFrame([(*r, "t", "s") for r in rows], PAGES + ", text string, site string")
    got = sorted((tuple(r) for r in template_html.extract_pages(df).collect()), key=repr)
    assert got == sorted([(1, None, "", 0), (2, "no url", "", 0), (3, "http://x.org/", "z", 1), (3, "http://x.org/", "z", 1), (None, "HTTP://u@X.org:80/q", "m", 1)], key=repr)
    assert template_html.extract_pages(df.limit(0)).count() == 0


def test_page_query(spark):
    """In these pages the article is what stands between its tags."""
    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in QUERIES["op1_main_text"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = r["html"].split("<article>")[1].split("</article>")[0]
        text = " ".join(html.unescape(re.sub("<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)).split())
        assert got[r["page_id"]] == (text, len(text))


def parse_warc(data):
    """Records of a WARC file by their lengths, as any reader finds them."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        size = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        assert version == "WARC/1.1" and data[end + 4 + size : end + 8 + size] == b"\r\n\r\n"
        assert fields["WARC-Block-Digest"] == warc_derive.digest(block)
        out.append((fields, block.decode()))
        at = end + 8 + size
    return out


WEB = [
    (1, "http://a.org/x y\r\nInjected: z", "<title> T &amp; U </title><p>one\r\ntwo<p>WARC/1.1\r\nthree <a href='/l?a=1&amp;b'>four</a><script>no</script>"),
    (2, None, None),
    (3, "http://b.org/", "ü漢 " * 30_000),
    (4, "http://b.org/", ""),
    (4, "http://b.org/", ""),
    (None, "", "<p>x"),
]


def test_warc_files(spark, tmp_path):
    df = spark.createDataFrame([(*r, "x") for r in WEB], PAGES + ", key string")
    responses = warc_derive.responses_of_pages(df)
    path = str(tmp_path / "warc")
    warc_derive.write_warc(warc_derive.derive(responses), path)
    records = [r for f in sorted((tmp_path / "warc").glob("part-*")) for r in parse_warc(f.read_bytes())]
    assert len(records) == 2 * len(WEB)
    sources = {r["record_id"]: r for r in responses.collect()}
    by_id = {f["WARC-Record-ID"]: (f, b) for f, b in records}
    for fields, block in records:
        source = sources[fields["WARC-Refers-To"]]
        assert fields["WARC-Source-Payload-Digest"] == warc_derive.digest(source["payload"].encode())
        if fields["WARC-Type"] == "metadata":
            facts = json.loads(block)
            assert by_id[facts["conversion"]][0]["WARC-Refers-To"] == source["record_id"]
            assert dict(map(tuple, facts["http"]["headers"]))["Content-Length"] == str(len(source["payload"].encode()))
    first = [b for f, b in records if f["X-Source-Key"] == "1"]
    assert "one two\nWARC/1.1 three four" in first
    facts = json.loads(next(b for b in first if b.startswith("{")))
    assert facts["html"] == {"title": "T & U", "links": ["/l?a=1&b"]} and facts["warc"]["target_uri"] == "http://a.org/x%20y%0D%0AInjected:%20z"
    back = {(r["record_id"], r["key"], r["kind"], r["refers_to"], r["block_digest"], r["content_length"], r["block"]) for r in warc_derive.read_derivatives(spark, path).collect()}
    assert back == {(f["WARC-Record-ID"], f["X-Source-Key"], f["WARC-Type"], f["WARC-Refers-To"], f["WARC-Block-Digest"], int(f["Content-Length"]), b) for f, b in records}
    assert warc_derive.derive(responses.limit(0)).count() == 0


def test_warc_query(spark, sf):
    rows = QUERIES["op5_warc_derivatives"](spark, sf).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == 2 * len(pages)
    for r in rows:
        assert r["payload_digest"] == warc_derive.digest(pages[r["page_id"]].encode())
        if r["kind"] == "conversion":
            assert r["block_sha256"] == hashlib.sha256(warc_derive.visible_text(pages[r["page_id"]]).encode()).hexdigest()


FILES = [
    ("LICENSE", "Released under the MIT License."),
    ("readme", "hello world"),
    ("lib/a.c", "/* Licensed under the Apache License, Version 2.0. */\nint x;"),
    ("lib/b.c", "int y;"),
    ("lib/gpl/COPYING", "This work is licensed under the GNU General Public\nLicense, version 3."),
    ("lib/gpl/deep/er/c.c", "int z;\n" * 20_000),
    ("lib/gpl/deep/d.c", None),
    ("lib/gpl/deep/d.c", ""),
    ("libx/e.c", "the license of the house"),
    (None, "Released under the MIT License."),
]


def test_licences(spark):
    df = spark.createDataFrame([(*f, "x") for f in FILES], "path string, text string, licence string")
    got = {r["path"]: (r["licence"], r["how"], r["from_path"]) for r in licence_scan.scan_licences(df).collect()}
    assert got == {
        "LICENSE": ("MIT", "own", "LICENSE"),
        "readme": ("MIT", "inherited", "LICENSE"),
        "lib/a.c": ("Apache-2.0", "own", "lib/a.c"),
        "lib/b.c": ("MIT", "inherited", "LICENSE"),
        "lib/gpl/COPYING": ("GPL-3.0", "own", "lib/gpl/COPYING"),
        "lib/gpl/deep/er/c.c": ("GPL-3.0", "inherited", "lib/gpl/COPYING"),
        "lib/gpl/deep/d.c": ("GPL-3.0", "inherited", "lib/gpl/COPYING"),
        "libx/e.c": ("MIT", "inherited", "LICENSE"),
    }
    assert licence_scan.scan_licences(df.limit(0)).count() == 0
    alone = licence_scan.scan_licences(spark.createDataFrame(FILES[1:2], "path string, text string")).first()
    assert tuple(alone) == ("readme", None, None, "none", None)


def test_one_letter_words_count_in_all_files(spark):
    """'3' and '0' are in files that hold no longer template word; their frequency counts there too."""
    files = [("a/COPYING", "GNU General Public License, version 3."), ("b/x", "CC0 1.0 Universal"), ("b/y", "v 0 1")] + [(f"n/{k}", f"0 3\nvolume {k + 5} 3") for k in range(40)]
    words = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w and w not in licence_scan.STOP_WORDS]
    sets = [set(words(t)) for _, t in files]
    idf = lambda w: math.log((1 + len(files)) / (1 + sum(w in s for s in sets))) + 1
    templates = [(n, Counter(words(t))) for n, t in licence_scan.TEMPLATES]
    known = {w for _, t in templates for w in t}
    rare = math.log(1 + len(files)) + 1

    def cosine(own, notice):
        norm = math.sqrt(sum((n * (idf(w) if w in known else 0)) ** 2 for w, n in own.items()) + sum(n for w, n in own.items() if w not in known) * rare**2)
        other = math.sqrt(sum((n * idf(w)) ** 2 for w, n in notice.items()))
        return sum(n * notice[w] * idf(w) ** 2 for w, n in own.items()) / (norm * other)

    expected = {}
    for path, text in files:
        score, licence = max((max(round(cosine(Counter(words(line)), t), 6) for line in text.split("\n")), n) for n, t in templates)
        if score >= 0.1:
            expected[path] = (licence, score)
    assert {"a/COPYING", "b/x", "b/y"} <= set(expected)
    got = licence_scan.detect_licences(spark.createDataFrame(files, "path string, text string"), least=0.1).collect()
    assert {r["path"]: (r["licence"], r["score"]) for r in got} == {p: (n, pytest.approx(s, abs=2e-6)) for p, (n, s) in expected.items()}


def test_one_letter_words_count_over_all_files(spark, tmp_path):
    """CC0 1.0: its score rests on `1` and `0`, which files without any longer template word hold as well."""
    cc0 = dict(licence_scan.TEMPLATES)["CC0-1.0"].replace("copyright", "rights")
    scores = []
    for name, plain in (("rare", "nothing here"), ("common", "page 1 of 9")):
        rows = [(k, plain, "en", "s") for k in range(1, 40)] + [(0, cc0, "en", "s"), (41, "are all 1 0", "en", "s")]
        folder = tmp_path / name
        folder.mkdir()
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").toPandas().to_parquet(folder / "documents.parquet")
        got = sorted((r["doc_id"], r["licence"], r["score"], r["how"], r["from_path"]) for r in QUERIES["op4_licences"](spark, str(folder)).collect())
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        expected = con.execute(f"SELECT doc_id, licence, score, how, from_path FROM ({SQL['op4_licences']}) ORDER BY doc_id").fetchall()
        assert got == expected
        scores.append(got[0][2])
    assert scores[0] != scores[1] and min(scores) >= 0.6


def test_licence_plan_is_native(spark, sf):
    assert not re.search("Python|Arrow|Pandas|Cartesian", QUERIES["op4_licences"](spark, sf)._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    expected = con.execute(SQL[name])
    columns = [d[0] for d in expected.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(expected.fetchall(), key=repr)
