"""HTML extraction, the filter audit and periodic runs against brute force, planted cases and odd inputs."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeweave.llm import filter_audit, html_extract, period_runs, queries, sql

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.exists(SF), reason="driver tables")


# Periodic runs


def brute_runs(words, least=6, times=4):
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if size >= max(least, times * q) and not any(all(words[x] == words[x + d] for x in range(i, i + size - d)) for d in range(1, q)):
                found.append((i, size, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 9)), max_size=6))
def test_runs_equal_brute_force(parts):
    words = [w for block, times in parts for w in block * times]
    assert [tuple(r) for r in period_runs.runs_of(period_runs.numbered(words), 6, 4).tolist()] == brute_runs(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=120))
def test_runs_of_two_words_equal_brute_force(words):
    assert [tuple(r) for r in period_runs.runs_of(period_runs.numbered(words), 6, 4).tolist()] == brute_runs(words)


def test_runs_of_odd_rows(spark):
    long = "x " * 100_000 + " ".join(f"w{i}" for i in range(50_000)) + " y" * 7
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (5, "a a\na\ta  a a"), (6, long), (6, long), (None, "b c " * 4), (7, "a b a b a b a b c c c c c c"), (8, " x x é é é é é é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_id": F.lit("q"), "runs": F.lit(1), "collapsed": F.lit(None).cast("int"), "_text": F.lit("z")})
    got = period_runs.find_runs(docs).collect()
    assert len(got) == len(rows)
    of = {r["doc_id"]: r for r in got}
    plain = lambda i: [tuple(x) for x in of[i]["runs"]]
    assert all(plain(i) == [] and of[i]["collapsed"] == "" and of[i]["n_words"] == 0 for i in (1, 2, 3))
    assert plain(4) == [] and of[4]["collapsed"] == "a a a a a"
    assert plain(5) == [(0, 6, 1)] and of[5]["collapsed"] == "a"
    assert plain(6) == [(0, 100_000, 1), (150_000, 7, 1)] and of[6]["n_words"] == 150_007 and len(of[6]["collapsed"].split()) == 50_002
    assert plain(None) == [(0, 8, 2)] and of[None]["collapsed"] == "b c"
    assert plain(7) == [(0, 8, 2), (8, 6, 1)] and of[7]["collapsed"] == "a b c"
    assert plain(8) == [(1, 6, 1)]
    assert period_runs.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        period_runs.find_runs(docs, times=3)


@needs_tables
def test_run_query_equals_brute_force(spark):
    rows = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    some = 0
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        if len(words) > 2500:
            continue
        runs, r = brute_runs(words), rows[i]
        again = {k for s, n, q in runs for k in range(s + q, s + n)}
        some += len(runs)
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in again).encode()).hexdigest()
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        assert (r["start"], r["length"], r["period"]) == best and r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
    assert some > 20


def test_progressions_propose_few():
    """A long run is one proposal a length at most, and prose is done after few lengths."""
    words = np.array([5] * 4000 + list(range(10, 4000)) + [1, 2, 3] * 500)
    levels = period_runs.basic_factors(words)
    assert sum(len(period_runs.proposals(x, 1 << k)[0]) for k, x in enumerate(levels)) <= 4
    assert len(period_runs.basic_factors(np.arange(100_000))) == 0


# Filter audit


def brute_audit(docs, labels, names="ABCDE"):
    texts = [t or "" for _, t, _ in docs]
    first = {}
    for (i, _, _), t in zip(docs, texts, strict=True):
        if i is not None:
            first[t] = min(first.get(t, i), i)
    good, toxic = ({i for i, *marks in labels if marks[k] == 1} for k in (0, 1))

    def fails(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {n for n, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]), strict=True) if bad}

    by_id = defaultdict(set)
    for (i, _, _), t in zip(docs, texts, strict=True):
        by_id[i] |= fails(i, t)
    want = {}
    for part in {p or "" for _, _, p in docs}:
        rows = [(i, by_id[i]) for i, _, p in docs if (p or "") == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations(names)):
            left = list(rows)
            for k, f in enumerate(order):
                out = [(i, x) for i, x in left if f in x]
                gone = [x for i, x in rows if f in x and x & set(order[:k])]
                left = [(i, x) for i, x in left if f not in x]
                shapley[f] += len(out)
                want[part, order, k + 1] = [len(left), len(out), len(gone), sum(x == {f} for _, x in rows), sum(i in good for i, _ in out), sum(i in toxic for i, _ in out), f]
        for (p, _, _), x in want.items():
            if p == part:
                x[-1] = shapley[x[-1]] if isinstance(x[-1], str) else x[-1]
    return want


FIELDS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_rows(frame):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in FIELDS] for r in frame.collect()}


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "bb", "C", "Dd", "e#", "x|y", *[f"w{k}" for k in range(300)]])
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 5, 99, 100, 140]))), rng.choice(["en", "de", None])) for i in range(90)]
    docs += [(100 + i, docs[rng.randrange(90)][1], rng.choice(["en", "", None])) for i in range(30)]
    docs += [(200, None, "en"), (201, None, None), (202, "", "it"), (203, "A " * 20_000, "it"), (203, "A " * 20_000, "it"), (204, " ".join(f"u{k}" for k in range(120)), "de"), (204, "#", "de"), (None, "short", "en"), (None, "short", "en")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 210, 2)] + [(4, 1, None), (6, None, None), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"id": F.lit(1), "part": F.lit("q"), "mask": F.lit(None).cast("int")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got, want = audit_rows(filter_audit.audit(frame, marks)), brute_audit(docs, [x for x in labels if x[0] is not None])
    assert len(got) == 600 * len({p or "" for _, _, p in docs}) and got == want
    few = filter_audit.audit(frame, marks, {k: v for k, v in filter_audit.standard_filters().items() if k in "AD"}, None)
    assert {(r["filter_order"], r["step"]) for r in few.collect()} == {("AD", 1), ("AD", 2), ("DA", 1), ("DA", 2)}
    assert filter_audit.audit(frame.limit(0), marks).count() == 0
    assert audit_rows(filter_audit.audit(frame.where("lang = 'it'"), marks.limit(0)))["it", "ABCDE", 1][:2] == [2, 1]
    with pytest.raises(ValueError):
        filter_audit.audit(frame, marks, copies="A")


@needs_tables
def test_audit_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(sql.OP12).df()
    assert audit_rows(queries.op12_filter_audit(spark, SF)) == {(r["part"], r["filter_order"], r["step"]): [r[c] for c in FIELDS] for r in want.to_dict("records")}


# HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>t{k}</title><style>p{{margin:0}}</style></head><body class="has-sidebar"><div class="q7"><ul><li><a href="/a">Home</a><li><a href="/b">News &amp; more</a></ul></div>
<div id="cookie-consent">We use cookies {k}</div><script>var t="</p><article>no</article>";</script><div class="z1">{body}</div><div class="x9"><p>Best of the site</p><p>Read it now</p></div>
<section class="comments"><article class="comment"><p>First! {k}</p></article></section><footer>&copy; {k}</footer></body></html>"""


def page(k, body):
    return PAGE.format(k=k, body=body)


def texts_of(frame):
    return {r["page_id"]: r["text"] for r in frame.collect()}


def site(n=12):
    return [(k, f"http://a.example/{k}", page(k, f"<h1>Head {k}</h1><p>One {k} &lt;b&gt; &#228;&nbsp;x<p>Two\n <b>{k}</b>.<br>more<div class='k3'>Subscribe <i>today</i></div><ul><li>item {k}<li>Released under a license</ul>")) for k in range(n)]


def expected(k):
    return f"Head {k}\nOne {k} <b> ä x\nTwo {k}. more\nitem {k}\nReleased under a license"


def test_templates_of_a_site_go_and_the_text_stays(spark):
    pages = spark.createDataFrame(site(), "page_id long, url string, html string")
    assert texts_of(html_extract.extract(pages)) == {k: expected(k) for k in range(12)}
    assert texts_of(html_extract.extract(pages, most=0)) == {k: expected(k) for k in range(12)}  # each page by a join
    alone = texts_of(html_extract.extract(pages.where("page_id = 3")))[3]
    assert alone == "Home\nNews & more\nHead 3\nOne 3 <b> ä x\nTwo 3. more\nSubscribe today\nitem 3\nReleased under a license\nBest of the site\nRead it now"


def test_templates_are_counted_per_host_and_url(spark):
    rows = [(k, f"http://h{k}.example/", site()[0][2]) for k in range(9)]  # nine hosts
    rows += [(20 + k, "http://one.example/x", site()[0][2]) for k in range(9)]  # one url
    got = texts_of(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert all("Home" in t and "Subscribe today" in t for t in got.values())


def test_copies_of_an_article_and_shared_passages_are_no_template(spark):
    body = "<h1>Same</h1>" + "".join(f"<p>Sentence {i} of an article that many pages of the host carry.</p>" for i in range(8))
    rows = [(k, f"http://a.example/{k}", page(k, f"<div class='c1'>{body}</div>")) for k in range(40)]
    rows += [(100 + k, f"http://a.example/n{k}", f"<body><article><h1>T{k}</h1><p>Released under the MIT License.</p><p>own {k}</p></article></body>") for k in range(40)]
    got = texts_of(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))
    want = "Same\n" + "\n".join(f"Sentence {i} of an article that many pages of the host carry." for i in range(8))
    assert {got[k] for k in range(40)} == {want}
    assert all(got[100 + k] == f"T{k}\nReleased under the MIT License.\nown {k}" for k in range(40))


@pytest.mark.parametrize(
    "html, text",
    [
        ("<article><header><h1>T</h1><p>by N</p></header><p>x</p><footer>f</footer></article><p>out</p>", "T\nx"),
        ("<main><h1>T</h1><p>x</main><p>out", "T\nx"),
        ("<article><p>x<aside>s</aside><form>f<input></form><nav>n</nav><p>y</article>", "x\ny"),
        ("<article><h1>A</h1><p>x</p></article><article class=comment><p>c</p></article><div class=comments><p>d</p></div>", "A\nx"),
        ("<p>a<b>b</p><p>c</b>d", "ab\ncd"),
        ("<p><b>x.<br><p>y", "x.\ny"),
        ("a &amp;amp; b &notit; &#x41;&#0; <!-- <p>no</p> --> c", "a &amp; b ¬it; A� c"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<article><div class='ad'>ad</div><div class='shade loadable'>kept</div><div class='sideBar'>s</div><p hidden>h</p></article>", "kept"),
        ("<p>1 < 2 and 3 > 2</p></div></p>x", "1 < 2 and 3 > 2\nx"),
        ("<script>if (a</b) '<p>'</script>t<style>x", "t"),
        ("<p class=notice>n</p><p>x</p><template><p>t</p></template><!-- open", "x"),
        ("<a href='x>y'>l</a><textarea><p>q</textarea>z", "lz"),
        ('<p title="x>a</p><p>b</p>', "a\nb"),
        ("", ""),
        (None, ""),
    ],
)
def test_markup(html, text):
    assert html_extract.Page(html or "").main_text(lambda h: False) == text


def test_extraction_of_odd_rows(spark):
    deep = "<div>" * 30_000 + "core" + "</div>" * 30_000
    long = "<article>" + "".join(f"<p>word{i} w</p>" for i in range(50_000)) + "</article>"
    rows = [(1, None, None), (2, "", ""), (3, None, "<p>x</p>"), (3, None, "<p>x</p>"), (None, "no host", "<p>y"), (5, "http://d.e/", deep), (6, "http://d.e/l", long), (7, "http://d.e/", "\x00<p>퟿</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("q"), "_host": F.lit(1), "_mark": F.lit(2)})
    for most in (0, 100):
        got = sorted(html_extract.extract(frame, most=most).collect(), key=str)
        assert len(got) == len(rows) and got[0].__fields__ == ["page_id", "url", "text"]
        of = {r["page_id"]: r["text"] for r in got}
        assert (of[1], of[2], of[3], of[None], of[5]) == ("", "", "x", "y", "core") and of[6].count("\n") == 49_999 and of[6].endswith("word49999 w")
    assert html_extract.extract(frame.limit(0)).count() == 0


@needs_tables
def test_page_query_keeps_the_article(spark):
    got = texts_of(queries.op11_html_extraction(spark, SF))
    import html as entities

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search("(?s)<article>(.*?)(</article>|$)", r["html"])[1]
        lines = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
        assert got[r["page_id"]] == "\n".join(x for x in lines if x)
