"""The training-data operators against brute force, round trips, held-out accuracy and odd inputs."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeweave.llm import chat_format, embed_dedup, exact_dedup, graph, langid, mixing, ngram_join, packing, quality, queries, toxicity, url_filter

SF = "/root/testdata/sf0.001"
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("_id", T.StringType())])
FILES = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")

LONG = " ".join(f"w{i * 7919 % 5000}" for i in range(60_000))
ODD = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (3, " \t\n", "en", "a", 3, None), (4, "one two", "en", "b", 7, "y"), (5, "one  two", None, "b", 8, "y"), (6, LONG, "de", "a", len(LONG), "z"), (7, LONG.replace("w7 ", "w8 "), "de", "a", len(LONG), "z"), (8, "one two", "en", None, 7, "q"), (9, "<|endoftext|> x", "fr", None, 15, "q"), (9, "<|endoftext|> x", "fr", None, 15, "q"), (10, "123 !!", "fr", "c", 6, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def tokenizer_files():
    public = pytest.importorskip("public_tokenizers")
    return [public.path(f) for f in FILES]


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def brute_components(sets, links):
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in sets}


def brute_near(sets):
    ids = sorted(sets)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * (i := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - i)]


def near_rows(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in frame.collect()}


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates_equal_brute_force(spark, docs):
    rng = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    base = [f"b{rng.randrange(300)}" for _ in range(120)]
    rows += [(10_000 + i, edited(base, rng.randrange(5), rng)) for i in range(150)]
    rows += [(20_000 + i, edited([f"c{i // 6}-{k}" for k in range(80)], i % 6, rng)) for i in range(120)]
    sets = {i: shingles(t) for i, t in rows}
    want = brute_components(sets, brute_near(sets))
    got = near_rows(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=32))
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_near_duplicates_of_odd_rows(odd, none):
    got = near_rows(ngram_join.near_duplicates(odd))
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3)
    assert got[4] == (1, 4) and got[5] == (1, 4) and got[8] == (1, 4) and got[7][1] == 6
    assert ngram_join.near_duplicates(none).count() == 0
    twice = odd.sparkSession.createDataFrame([(1, "a b c d e f g"), (1, "p q r s t u v w x y z 1 2 3"), (2, "p q r s t u v w x y z 1 2 3"), (None, "a b c d e f g"), (3, "A b c d e f g"), (3, "A b c d e f g")], "doc_id long, text string")
    rows = sorted(ngram_join.near_duplicates(twice).collect(), key=str)
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in rows) == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 1), (3, 1)]
    assert sorted(r["doc_id"] or 0 for r in ngram_join.one_of_each(twice).collect()) == [0, 1, 1]
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(odd).collect()) == [1, 2, 3, 4, 6, 9, 9, 10]
    assert ngram_join.one_of_each(odd).columns == odd.columns


def some_sets(seed, n=120):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(n):
        own = set(rng.integers(0, 2**63, rng.integers(1, 80)).tolist())
        sets += [own, {x for x in own if rng.random() > 0.08} or own]
    return sets, {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * (i := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - i)}


def leaf_of(i, own):
    return ngram_join.Node.leaf(i, i, len(own), ngram_join.bitmap(own), own)


def test_signature_trees_find_all_groups(monkeypatch):
    sets, links = some_sets(3)
    values = [np.array(sorted(s), np.uint64) for s in sets]
    compared = []
    real = ngram_join.alike
    monkeypatch.setattr(ngram_join, "alike", lambda x, y, percent: compared.append(1) or real(x, y, percent))
    leaves = [leaf_of(i, v) for i, v in enumerate(values)]
    found = []
    ngram_join.tree_of(leaves, ngram_join.Groups(), 80, found)
    whole = brute_components(dict.fromkeys(range(len(sets))), links)
    assert {(min(e), max(e)) for e in found} <= links and brute_components(dict.fromkeys(range(len(sets))), found) == whole
    assert len(compared) < len(links) + 200
    half, groups, across = len(sets) // 2, ngram_join.Groups(), []
    sides = [ngram_join.tree_of([leaf_of(i, values[i]) for i in part], groups, 80, None) for part in (range(half), range(half, len(sets)))]
    ngram_join.walk(*sides, groups, 80, across)
    split = {(a, b) for a, b in links if a < half <= b}
    assert brute_components(dict.fromkeys(range(len(sets))), across) == brute_components(dict.fromkeys(range(len(sets))), split)


def test_trees_of_near_copies_compare_few(monkeypatch):
    """500 near copies of one set are joined by about as many comparisons, not by all pairs."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    compared = []
    real = ngram_join.alike
    monkeypatch.setattr(ngram_join, "alike", lambda x, y, percent: compared.append(1) or real(x, y, percent))
    leaves = [leaf_of(i, np.unique(np.append(base[rng.random(300) > 0.02], rng.integers(0, 2**63, 3).astype(np.uint64)))) for i in range(500)]
    found = []
    ngram_join.tree_of(leaves, ngram_join.Groups(), 80, found)
    assert len(found) == 499 and len(compared) < 600


def test_prefixes_of_linked_sets_meet():
    """Of linked sets the first common shingle is in the larger one's prefix and the smaller one's core."""
    sets, links = some_sets(9)
    common = np.random.default_rng(1).integers(0, 5, ngram_join.SLOTS).astype(np.uint8)
    first = [ngram_join.prefix(np.array(sorted(s), np.uint64), 80, common) for s in sets]
    assert links
    for a, b in links:
        a, b = sorted((a, b), key=lambda i: len(sets[i]))
        least = -(-80 * len(sets[b]) // 100)
        assert len(set(first[a][0][: first[a][1]].tolist()) & set(first[b][0].tolist())) >= 1 + ngram_join.spare(least, 80) // 4


def test_all_links_come_from_trees(spark, docs, monkeypatch):
    """Copies aside, every component is joined by links that trees returned."""
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rng = random.Random(6)
    base = [f"b{rng.randrange(300)}" for _ in range(120)]
    rows += [(10_000 + i, edited(base, rng.randrange(5), rng)) for i in range(60)]
    got, real, check = [], ngram_join.tree_links, ngram_join.verified
    keep = lambda t: got.append(ngram_join.cut(t, "kept")) or got[-1]
    monkeypatch.setattr(ngram_join, "tree_links", lambda *a, full=True: keep(real(*a)) if full else real(*a, full=False))
    monkeypatch.setattr(ngram_join, "verified", lambda *a: keep(check(*a)))
    near = near_rows(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=16))
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(shingles(t)), []).append(i)
    joined = len(sets) - (frozenset() in sets) - len({c for i, (n, c) in near.items() if n})
    assert len(got) == 3
    links = [(r["_x"], r["_y"]) for t in got for r in t.collect()]
    whole = brute_components({x: 0 for e in links for x in e}, links)
    assert joined > 0 and len(whole) - len(set(whole.values())) == joined


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)] + [(200, i) for i in range(201, 260)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(7), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100} | {i: 200 for i in range(200, 260)}


def test_chat_round_trip(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", None]), "".join(rng.choice("<|>\\turnexdé:0 \n") for _ in range(rng.randrange(30)))) for c in range(40) for t in range(rng.randrange(1, 5))] + [(99, None, "assistant", None), (None, 0, "user", "<|end|>")]
    back = chat_format.read_back(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(x) for x in r["turns"]] for r in back} == want
    assert all(r["loss_text"] == "".join(t for role, t in want[r["conv_id"]] if role == "assistant") for r in back)


def test_chat_parts(spark):
    part = "array<struct<type:string,text:string,ref:string,units:bigint>>"
    rows = [(1, 0, "user", [("text", "a<", None, None), ("image", None, "s3", 2), ("text", "|b", None, None)]), (1, 1, "assistant", [("audio", None, "x.wav", 3), (None, "ok", None, None), ("odd kind", None, None, 5)]), (2, 0, "user", None)]
    got = {r["conv_id"]: r for r in chat_format.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {part}"), parts_col="parts").collect()}
    assert got[1]["formatted"] == "<|turn|>user<|text|>a<<|image:0|>\\|b<|end|><|turn|>assistant<|text|><|audio:1|>ok<|odd_kind:2|><|end|>"
    assert [tuple(a) for a in got[1]["attachments"]] == [("image", "s3", 0, 512), ("audio", "x.wav", 1, 75), ("odd kind", None, 2, 0)]
    assert got[1]["expanded_tokens"] == 587 and got[2]["attachments"] == []
    assert got[1]["formatted"][got[1]["loss_spans"][0]["start"] :][: got[1]["loss_spans"][0]["length"]] == "<|audio:1|>ok<|odd_kind:2|>"


def test_chats_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, _row int, formatted string"
    long = "word | " * 100_000
    rows = [(1, 0, "user", long, 3, "x"), (1, 1, "assistant", long, 3, "x"), (2, 0, "assistant", "same", 1, None), (2, 0, "assistant", "same", 1, None), (3, None, None, "", None, None)]
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(spark.createDataFrame(rows, schema))).collect()}
    assert [t["text"] for t in got[1]["turns"]] == [long, long] and got[1]["loss_text"] == long
    assert got[2]["loss_text"] == "samesame" and len(got[2]["turns"]) == 2 and [tuple(t) for t in got[3]["turns"]] == [("", "")]
    assert chat_format.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_plain_text_goes_through_the_visitor(spark):
    """Plain text and the same text as a typed part are formatted alike, and numbers run over turns."""
    part = "array<struct<type:string,text:string,ref:string,units:bigint>>"
    rows = [(1, t, "user", f"a|{t}", [("text", f"a|{t}", None, None)]) for t in range(5)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts {part}")
    assert chat_format.format_chats(df).collect() == chat_format.format_chats(df, parts_col="parts").collect()
    many = spark.createDataFrame([(1, t, "user", [("image", None, f"r{t}-{k}", 1) for k in range(3)]) for t in range(40)], f"conv_id long, turn long, role string, parts {part}")
    row = chat_format.format_chats(many, parts_col="parts").first()
    assert [a["number"] for a in row["attachments"]] == list(range(120)) and row["attachments"][119]["ref"] == "r39-2" and "<|image:119|><|end|>" in row["formatted"]


RULES = queries.RULES


def brute_page(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", rest, maxsplit=1)[0])
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    fits = [(len(r), r, a) for a, r in RULES if (h := r.split("/")[0]) and (host == h or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def brute_walk(links, good, bad, damping, rounds):
    nodes = sorted({x for e in links for x in e} | set(good) | set(bad))
    links = sorted(links)
    trust = {x: good.get(x, 0.0) for x in nodes}
    distrust = {x: bad.get(x, 0.0) for x in nodes}
    out, into = {}, {}
    for a, b in links:
        out[a], into[b] = out.get(a, 0) + 1, into.get(b, 0) + 1
    for _ in range(rounds):
        t = {x: (1 - damping) * good.get(x, 0.0) for x in nodes}
        d = {x: (1 - damping) * bad.get(x, 0.0) for x in nodes}
        for a, b in links:
            t[b] += damping * trust[a] / out[a]
            d[a] += damping * distrust[b] / into[b]
        trust, distrust = t, d
    whole = sum(trust.values()) or 1.0, sum(distrust.values()) or 1.0
    return {x: (trust[x] / whole[0], distrust[x] / whole[1]) for x in nodes}


def test_long_conversations_are_read_back_in_proportion(spark):
    import time

    def took(n):
        rows = spark.range(n).selectExpr("id % 1 as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('say | ', id, repeat(' w\\\\', 20)) as text")
        began = time.time()
        row = chat_format.read_back(chat_format.format_chats(rows)).selectExpr("size(turns) as n", "loss_text", "formatted").first()
        seconds = time.time() - began
        assert row["n"] == n and row["loss_text"] == "".join(f"say | {i}" + " w\\" * 20 for i in range(1, n, 2))
        return seconds

    took(100)
    assert took(16_000) < 10


def test_urls(spark):
    urls = [None, "", "no host", "http://", "HTTP://A.Example.ORG/es/x?q", "https://example.org", "https://example.org/en/15#t", "http://x.com/fr/", "http://x.com/de/9", "http://y.net?p=/es/", "http://z.net/a", "ftp://q.net/b", "http://org/", "http://notexample.org/es/", "http://x.com/de/1"]
    html = {10: '<a href="http://x.com/de/9">', 11: "<A HREF='//z.net/q'> <a href=/own>", 7: '<a href="http://y.net">', 4: None}
    rows = [(i, u, html.get(i, "<p>")) for i, u in enumerate(urls)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES, rounds=60, tolerance=0.0).collect()}
    want = {i: brute_page(u) for i, u in enumerate(urls)}
    assert {i: (r["host"], r["path"], r["rule"]) for i, r in got.items()} == {i: w[:3] for i, w in want.items()}
    good, bad = {}, {}
    for host in {w[0] for w in want.values()} - {""}:
        a, b = (sum(1 for w in want.values() if w[0] == host and w[3] == kind) for kind in ("allow", "block"))
        good |= {host: 1.0} if a > b else {}
        bad |= {host: 1.0} if b > a else {}
    scores = brute_walk([("z.net", "x.com"), ("q.net", "z.net"), ("x.com", "y.net")], good, bad, 0.85, 60)
    for i, r in got.items():
        t, d = scores.get(r["host"], (0, 0))
        assert abs((r["trust"] or 0) - t) < 1e-9 and abs((r["distrust"] or 0) - d) < 1e-9
        assert r["verdict"] == (want[i][3] or ("block" if d > 0 and d >= 0.5 * (t + d) else "allow"))
    assert got[10]["verdict"] == got[11]["verdict"] == "block" and got[9]["verdict"] == "allow"


def test_urls_of_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: brute_page(r["url"])[:3] for r in pages.collect()}
    rows = queries.op3_url_filter(spark, SF).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in rows} == want
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


def test_urls_far_from_few_seeds_among_many(spark):
    """With the production parameters, a chain of 36 hosts up to a blocked one, and a loop, beside 10,000 seeds without links."""
    chain = [f"h{i}.net" for i in range(36)] + ["x.com"]
    links = [*zip(chain, chain[1:]), ("s0.org", "a.net"), ("a.net", "b.net"), ("b.net", "c.net"), ("c.net", "a.net"), ("c.net", "x.com")]
    html = {}
    for a, b in links:
        html[a] = html.get(a, "") + f'<a href="http://{b}/de/1">'
    hosts = [*dict.fromkeys(x for e in links for x in e), *(f"s{i}.org" for i in range(1, 10_000))]
    rows = [(i, f"http://{h}/de/1", html.get(h)) for i, h in enumerate(hosts)]
    got = {r["host"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    want = brute_walk(links, {f"s{i}.org": 1.0 for i in range(10_000)}, {"x.com": 1.0}, 0.85, 400)
    for h, (t, d) in want.items():
        assert got[h]["trust"] == pytest.approx(t, rel=1e-2) and got[h]["distrust"] == pytest.approx(d, rel=1e-2)
    assert {got[h]["verdict"] for h in chain} == {"block"} and got["s9.org"]["verdict"] == "allow"
    near = {r["host"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows[:60], "page_id long, url string, html string"), RULES, rounds=30).collect()}
    assert (near["h0.net"], near["h5.net"], near["h8.net"], near["h35.net"]) == ("allow", "allow", "block", "block")  # beyond 30 links none is reached


def page_rows(links, more=()):
    """A page per host, with all its links, under a path that the rules leave to the method but for .com hosts."""
    html = {}
    for a, b in links:
        html.setdefault(a, []).append(f'<a href="http://{b}/">')
    hosts = [*dict.fromkeys([x for e in links for x in e] + list(more))]
    return [(i, f"http://{h}/" + ("de/" if h.endswith(".com") else ""), "".join(html.get(h, []))) for i, h in enumerate(hosts)]


def test_urls_of_long_chains_and_dense_hubs(spark):
    """Chains of 5,000 hosts settle, and hubs of 300 links thin trust out below what a float holds, without raising."""
    chain = [f"c{i}.net" for i in range(5000)] + ["bad.com"]
    hubs = [f"hub{i}.net" for i in range(140)]
    links = [*zip(chain, chain[1:]), ("good.org", hubs[0]), *zip(hubs, hubs[1:]), *((h, f"{h[:-4]}-{k}.net") for h in hubs for k in range(300)), (hubs[-1], "end.net"), (hubs[-1], "worse.com")]
    rows = page_rows(links)
    frame = spark.createDataFrame([*rows, *rows[:3]], "page_id long, url string, html string").withColumns({"host": F.lit("q"), "trust": F.lit(1), "src": F.lit(2)})
    got = url_filter.judge(frame, RULES).collect()
    assert len(got) == len(rows) + 3
    verdict = {r["host"]: r["verdict"] for r in got}
    assert {verdict[h] for h in chain} == {"block"} and {verdict[h] for h in hubs[10:]} == {"block"}
    assert {verdict[x] for x in ("good.org", "end.net", "hub5-7.net", "hub139-299.net")} == {"allow"}


def test_url_scores_are_one_at_every_size(spark):
    rng = random.Random(4)
    hosts = [f"h{i}.net" for i in range(25)] + ["x.com", "y.com", "a.org", "b.org"]
    links = sorted({(a, b) for a in hosts for b in rng.sample(hosts, 3) if a != b} - {("h3.net", "a.org")})
    frame = spark.createDataFrame(links, "src string, dst string")
    seeds = spark.createDataFrame([("x.com", 0.0, 1.0), ("y.com", 0.0, 2.0), ("a.org", 1.0, 0.0), ("b.org", 3.0, 0.0), ("alone.org", 1.0, 0.0)], "host string, good double, bad double")
    want = brute_walk(links, {"a.org": 1.0, "b.org": 3.0, "alone.org": 1.0}, {"x.com": 1.0, "y.com": 2.0}, 0.85, 200)
    rows = [{r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagate(frame, seeds, rounds=8 if most == 0 else 10_000, tolerance=1e-9, most=most).collect()} for most in (10_000, 0)]
    assert set(rows[0]) == set(rows[1]) == set(want)
    for h, w in want.items():
        for mine, true in zip(rows[0][h], w, strict=True):
            assert (0.0 if mine is None else np.exp(mine)) == pytest.approx(true, rel=1e-6)
    few = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagate(frame, seeds, rounds=8, tolerance=1e-9).collect()}
    assert all((a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-9)) for h in want for a, b in zip(few[h], rows[1][h], strict=True))


def check_pack(rows, texts, capacity):
    plain = packing._tools(*tokenizer_files())[2]
    by, room = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in room.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    for i, text in texts.items():
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[i]})
        assert [x[0] for x in own] == list(range(len(own))) and sum(x[2] for x in own) == len(ids)
        assert all(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == crc for _, s, n, crc in own)
        assert len(own) == 1 or all(n == capacity for _, _, n, _ in own[1:])
    return len(room)


def test_packing(spark, docs, odd, none):
    files = tokenizer_files()
    rows = packing.pack(docs, *files).collect()
    used = check_pack(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, 1024)
    assert used <= 1.01 * -(-sum(r["length"] for r in rows) // 1024) + 1
    rows = packing.pack(odd, *files, capacity=16, keep_ids=True).collect()
    check_pack(rows, {r[0]: r[1] for r in ODD}, 16)
    assert all(len(r["ids"]) == r["length"] for r in rows) and sum(r["doc_id"] == 9 for r in rows) == 2
    assert packing.pack(none, *files).count() == 0


def test_packing_plan():
    rng = random.Random(1)

    def best(sizes, capacity):
        for n in range(-(-sum(sizes) // capacity), len(sizes) + 1):
            def fits(left, bins):
                if not left:
                    return True
                seen = set()
                for k, b in enumerate(bins):
                    if b + left[0] <= capacity and b not in seen:
                        seen.add(b)
                        if fits(left[1:], [*bins[:k], b + left[0], *bins[k + 1 :]]):
                            return True
                return False

            if fits(sorted(sizes, reverse=True), [0] * n):
                return n

    extra = 0
    for _ in range(60):
        sizes = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 10))]
        plan = packing.plan({s: sizes.count(s) for s in sizes}, 20)
        used = sorted(s for pattern, k in plan for s in pattern for _ in range(k))
        assert used == sorted(sizes) and all(sum(p) <= 20 for p, _ in plan)
        extra += sum(k for _, k in plan) - best(sizes, 20)
    assert extra <= 3
    assert packing.plan({}, 20) == []


def test_tokens_equal_the_library():
    files = tokenizer_files()
    rng = random.Random(3)
    texts = ["", None, "it's I'LL  \n\n x²½ é", " 's ''s !'s 'sabc", "a<|endoftext|>b", "日本語 １2３ 🙂🙂", " \r\n end  "] + ["".join(rng.choice(" \n\t'stmdrevl12é!日🙂 <|") for _ in range(rng.randrange(40))) for _ in range(500)]
    whole = packing._tools(*files)[2]
    assert [x.tolist() for _, x in packing.encode(pa.array(texts), *files)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    pos = order[label == 1]
    return (pos.sum() - len(pos) * (len(pos) - 1) / 2) / len(pos) / (len(label) - len(pos))


def held(spark, query, label, sf="/root/testdata/sf0.01"):
    rows = query(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    rows = rows[rows["held_out"]]
    return auc(rows["score"].to_numpy(), rows[label].to_numpy()), (rows["predicted"] == rows[label]).mean()


def test_quality_on_held_out_rows(spark, odd, none):
    score, right = held(spark, queries.op9_quality_classifier, "quality")
    assert score > 0.97 and right > 0.95
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    assert quality.scored(odd, model).count() == len(ODD)
    assert quality.keep_good(none, labels).count() == 0 and quality.keep_good(odd, labels.limit(0)).columns == odd.columns


def test_compiled_rules_equal_numpy(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    assert model[1]
    rows = quality.with_statistics(docs.select("doc_id", "text")).withColumn("s", quality.compiled(model)).toPandas()
    x = np.array([[r[k] for k in quality.STATS] for r in rows["_gw_stats"]])
    z = model[0] + sum(w * quality.holds(rule, x) for rule, w in model[1])
    assert np.allclose(rows["s"], 1 / (1 + np.exp(-z)))


def test_toxicity_on_held_out_rows(spark, odd, none):
    score, right = held(spark, queries.op5_toxicity, "toxic", "/root/testdata/sf0.1")
    assert score > 0.95 and right > 0.97
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(none, toxicity.train(none, labels)).count() == 0


@pytest.mark.parametrize("share, often", [(0.5, 0), (0.35, 0), (0.5, 12)])
def test_toxicity_of_balanced_labels(spark, share, often):
    """Toxic texts hold 3 of 6 marks; ``often``: a word of many clean texts that is in more toxic ones, so many times."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        toxic = rng.random() < share
        own = [f"w{rng.randrange(2000)}" for _ in range(60)] + rng.sample([f"mark{k}" for k in range(6)], 3) * toxic
        own += ["usual"] * (often * (rng.random() < (0.9 if toxic else 0.5)))
        rng.shuffle(own)
        rows.append((i, " ".join(own), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs)
    got = {r["doc_id"]: r["score"] >= 0.3 for r in toxicity.score(docs, model).collect()}
    assert len(model.hashes) and model.lam > 1e-3
    for kind in (0, 1):
        assert np.mean([got[i] == kind for i, _, t in rows if t == kind]) > 0.95


def test_segments_equal_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 30)
        at = sorted(rng.sample(range(n), rng.randrange(0, n + 1)))
        worth = [float(rng.randrange(1, 6)) for _ in at]
        drift = rng.choice([0.5, 1.0, 2.5, 0.7310585])
        if rng.random() < 0.5:
            worth = [w + rng.random() for w in worth]
        line = [-drift] * n
        for p, w in zip(at, worth, strict=True):
            line[p] = w

        def maximal(lo, hi, line=line):
            """All maximal segments by the definition: the best segment (shortest first), then both sides of it."""
            best = max(((sum(line[i:j]), -(j - i), -i) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            i, j = -best[2], -best[2] - best[1]
            return [*maximal(lo, i), (i, j - 1, best[0]), *maximal(j, hi)]

        got = toxicity.segments(np.array(at, int), np.array(worth), drift)
        # Equal sums leave a choice of ends: each segment's own sum fits its ends, and the number and sums agree.
        assert all(s == pytest.approx(sum(line[i : j + 1])) for i, j, s in got)
        assert sorted(s for *_, s in got) == pytest.approx(sorted(s for *_, s in maximal(0, n)))
        if len({round(sum(line[i:j]), 6) for i in range(n) for j in range(i + 1, n + 1)}) == n * (n + 1) // 2:
            assert [(i, j) for i, j, _ in got] == [(i, j) for i, j, _ in maximal(0, n)]
        assert max((s for *_, s in got), default=0) == pytest.approx(max((s for *_, s in maximal(0, n)), default=0))


def test_language_on_held_out_rows(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98
    got = {r["doc_id"]: r for r in langid.identify(odd, langid.train(odd)).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 10)] == ["und"] * 4 and got[4]["lang_pred"] != "und"
    assert langid.identify(none, langid.train(none)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.train(none)).collect()} == {"und"}


def test_more_languages_than_500(spark):
    rows = [(i * 10 + k, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}" for _ in range(5)), f"l{i}") for i in range(520) for k in range(3)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) > 500 and len({tuple(r) for r in model.code.tolist()}) == len(model.languages)


def test_repeated_labelled_ids_are_learnt_once(spark):
    rows = [(i, f"word{i % 7} good text number {i}", i % 2) for i in range(200)] + [(5, "x " * k, 1) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    assert quality.train(docs, labels) == quality.train(docs.repartition(3), labels)


def test_codewords_stay_apart():
    for n in (1, 2, 4, 5, 6, 40):
        code = langid.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code.tolist()}) == n


def test_exact_groups(spark, odd, none):
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(odd).collect()}
    for i, text, *_ in ODD:
        plain = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        same = [j for j, t, *_ in ODD if re.sub(r"[\x20\x09-\x0D]+", " ", t or "") == plain]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(same), len(same), i == min(same))
        assert got[i]["text_sha256"] == hashlib.sha256(plain.encode()).hexdigest()
    assert exact_dedup.exact_groups(none).count() == 0
    twice = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "c"), (4, "c"), (4, "c"), (None, "c")], "doc_id long, text string")
    assert sorted(r["doc_id"] or 0 for r in exact_dedup.drop_copies(twice).collect()) == [0, 1, 2, 2, 3]
    hashed = exact_dedup.suspects(spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "abc"), (4, "long one"), (5, "xyz")], "doc_id long, text string"), "doc_id", "text", 64, 10)[0]
    assert sorted(r["_id"] for r in hashed.collect()) == [1, 3]  # only shared lengths and starts are hashed in full
    small = exact_dedup.drop_copies(odd, most_ids=0)
    assert sorted(r["doc_id"] for r in small.collect()) == [1, 3, 4, 6, 7, 9, 9, 10] and small.columns == odd.columns


def test_mixing(spark, docs, odd, none):
    rows = mixing.mix_counts(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    for _, own in rows.groupby("source", dropna=False):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 2 * own["size"].max()
    assert rows["target"].groupby(rows["source"]).first().sum() == pytest.approx(1.5 * rows["size"].sum())
    assert (rows["copies"] <= 2).all()
    again = mixing.mix_counts(docs.repartition(5)).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert dict(zip(again["doc_id"], again["copies"], strict=True)) == dict(zip(rows["doc_id"], rows["copies"], strict=True))
    assert mixing.mix(docs).count() == rows["copies"].sum()
    assert mixing.mix_counts(odd).count() == len(ODD) and mixing.mix(odd).columns == odd.columns
    assert mixing.mix_counts(none).count() == 0


def brute_links(x, threshold=0.9):
    ok = [i for i, v in enumerate(x) if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = []
    for k, i in enumerate(ok):
        for j in ok[k + 1 :]:
            a, b = np.array(x[i], float), np.array(x[j], float)
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                out.append((i, j))
    return out


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    x = [v.tolist() for v in rng.standard_normal((150, 64)).astype(np.float32)]
    for i in range(150):
        a, z = np.array(x[i]), rng.standard_normal(64)
        z -= z @ a / (a @ a) * a
        c = rng.uniform(0.85, 0.99)
        x.append((c * a / np.linalg.norm(a) + (1 - c * c) ** 0.5 * z / np.linalg.norm(z)).astype(np.float32).tolist())
    x += [x[0], x[0], None, [0.0] * 64, [float("nan")] * 64, [None] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0], []]
    links = brute_links(x)
    rows = {r["vec_id"]: r for r in embed_dedup.near_vectors(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>"), block=8).collect()}
    want = [sum(i in e for e in links) for i in range(len(x))]
    got = [rows[i]["n_links"] for i in range(len(x))]
    assert sum(got) >= 0.98 * sum(want) and all(g <= w for g, w in zip(got, want, strict=True))
    if got == want:
        whole = brute_components({i: 0 for i in range(len(x))}, links)
        assert {i: r["component_id"] for i, r in rows.items()} == whole
    assert all(r["kept"] == (r["component_id"] == i) for i, r in rows.items())
    large = [[1e180] * 8, [2e180] * 8, [1e-200] * 8, [1.0] + [0.0] * 7, [0.0] * 7 + [1.0]]
    rows = [*enumerate(large), (3, large[4]), (None, large[3]), (9, large[4])]
    odd = spark.createDataFrame([(i, x, None, "a") for i, x in rows], "vec_id long, embedding array<double>, label int, component_id string")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.near_vectors(odd).collect()), key=str)
    assert got == sorted([(0, 2, 0), (1, 2, 0), (2, 2, 0), (3, 0, 3), (3, 2, 3), (4, 2, 3), (9, 2, 3), (None, 0, None)], key=str)
    assert embed_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_tight_groups_count_every_link_once(spark):
    """Groups of different vectors that meet in most buckets, over many small blocks and tasks, and a chain beside them."""
    rng = np.random.default_rng(12)
    tight = [(c + rng.standard_normal((n, 24)) * 0.02).tolist() for c, n in ((rng.standard_normal(24), 150), (rng.standard_normal(24), 40))]
    turn = np.arange(30) * np.arccos(0.97)
    chain = np.concatenate([np.cos(turn)[:, None], np.sin(turn)[:, None], np.zeros((30, 22))], axis=1).tolist()
    x = [*tight[0], *tight[1], *chain, tight[0][0], tight[1][3]]
    links = brute_links(x)
    frame = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    for options in ({"block": 16, "per_task": 500}, {}):
        rows = {r["vec_id"]: r for r in embed_dedup.near_vectors(frame, tables=24, probes=20, **options).collect()}
        assert [rows[i]["n_links"] for i in range(len(x))] == [sum(i in e for e in links) for i in range(len(x))]
        assert {i: r["component_id"] for i, r in rows.items()} == brute_components(dict.fromkeys(range(len(x))), links)


def test_links_of_chunks_join_like_a_graph(monkeypatch):
    monkeypatch.setattr(embed_dedup.Links, "CHUNK", 7)
    rng = np.random.default_rng(3)
    keys = np.arange(60, dtype=np.uint64).reshape(60, 1, 1)  # no two vectors share a bucket: every pair counts
    held = embed_dedup.Links(keys, np.full(60, 2))
    a, b = rng.integers(0, 60, 50), rng.integers(0, 60, 50)
    held.add(a[:20], b[:20], 99)
    held.add(a[20:], b[20:], 99)
    held.flush()
    pairs = [(int(p), int(q)) for p, q in zip(a, b, strict=True) if p != q]
    assert held.others.tolist() == [2 * sum(i in e for e in pairs) for i in range(60)]
    assert dict(enumerate(held.up.tolist())) == brute_components(dict.fromkeys(range(60)), set(pairs))


def test_e8_points_are_nearest():
    rng = np.random.default_rng(9)
    y = rng.standard_normal((200, 8)) * 2
    p = embed_dedup.e8(y)
    around = np.vstack([np.zeros(8), embed_dedup.e8_neighbours()])
    far = ((y[:, None] - p[:, None] - around[None]) ** 2).sum(axis=2)
    assert (far.argmin(axis=1) == 0).all() and len(around) == 241


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="driver tables")
def test_pipeline_stages_take_effect(spark):
    tokenizer_files()
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = p.good(spark, docs, SF)
    kept = {r["doc_id"]: r for r in good.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels[i] for i in labels if i in kept) >= 0.97 * sum(labels.values())
    alone = {}
    for i in sorted(kept):
        alone.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i]["text"]), i)
    distinct = p.distinct(spark, good, SF)
    assert {r["doc_id"] for r in distinct.collect()} == set(alone.values())
    sets = {i: shingles(kept[i]["text"]) for i in alone.values()}
    whole = brute_components(sets, brute_near(sets))
    far = p.dissimilar(spark, distinct, SF)
    assert {r["doc_id"] for r in far.collect()} == {i for i, c in whole.items() if i == c}
    assert good.columns == distinct.columns == far.columns == docs.columns
    rows = p.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} <= {i for i, c in whole.items() if i == c}
