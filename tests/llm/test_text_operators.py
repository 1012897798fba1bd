"""HTML extraction, URL rules, personal data, quality, packing: brute force and edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_paths, packing, pii, quality, registry, url_filter
from tidemark.llm.shared import string_buffer
from tidemark.llm.words import hash_word, word_hashes

PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>More</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, is that fine?</p></div>
<div id="wrap"><div class="col"><h1>Head &amp; line</h1><div class="txt"><p>Para one, is <b>here</b>.<p>Para&nbsp;two
  with <a href=x>link</a> text.<ul><li>item one<li>item two</ul></div></div>
<aside>side</aside><section id="comments"><p>Nice post, thanks a lot, friend!</p></section></div>
<form><p>Sign up now, please.</p></form><footer>(c) site</footer></body></html>"""


def test_extract_page():
    assert html_paths.extract(PAGE) == "Head & line\nPara one, is here.\nPara two with link text.\nitem one\nitem two"


@pytest.mark.parametrize(
    ("page", "text"),
    [(None, ""), ("", ""), ("<div class=ad>x</div>", ""), ("a &lt; b", "a < b"), ("<p>a<b>c</p><p>d", "ac\nd"),
     ("<article><p>One, two.</p><p>cut off te", "One, two.\ncut off te"), ("<p>x</p><scr", "x"), ("<p>1 < 2</p>", "1 < 2")],
)
def test_extract_edges(page, text):
    assert html_paths.extract(page) == text


ARTICLE = "<p>A long paragraph, with commas, and a full stop.</p><p>Another paragraph of the article, quite long, too.</p>"
LINES = "A long paragraph, with commas, and a full stop.\nAnother paragraph of the article, quite long, too."


@pytest.mark.parametrize(
    ("page", "text"),
    [(f'<div class="layout has-sidebar">{ARTICLE}</div>', LINES), (f'<div class="no-sidebar"><main>{ARTICLE}</main></div>', LINES),
     (f'<div id="page" class="with-header"><article>{ARTICLE}</article></div>', LINES), (f'<div id="search-results">{ARTICLE}</div>', LINES),
     (f'<article>{ARTICLE}<p>It is <span class="comment">a key word</span> here.</p></article>', LINES + "\nIt is a key word here."),
     (f"<article>{ARTICLE}<svg><p>After it, the text goes on.</p></article>", LINES + "\nAfter it, the text goes on."),
     (f"<article>{ARTICLE}<div>Buy now</div><div>Click</div></article>", LINES),
     (f"<article>{ARTICLE}<ul><li><a>ref one</a><li><a>ref two</a><li><a>ref three</a></ul></article>", LINES + "\nref one\nref two\nref three"),
     (f'<article>{ARTICLE}</article><div class="comments"><article class="comment">{ARTICLE * 9}</article></div>', LINES),
     (f'<div class="sidebar"><p>Short, here.</p></div><div class="wrap"><div class="ad"><p>Buy, now!</p></div>{ARTICLE}</div>', LINES)],
)
def test_hints_are_no_verdict(page, text):
    assert html_paths.extract(page) == text


def test_the_threshold_decides_on_neutral_elements():
    page = f"<article>{ARTICLE}<div>Some more words, at the end</div></article>"
    assert html_paths.extract(page, 0.3).endswith("at the end") and html_paths.extract(page, 5.0) == LINES


def test_path_scores_against_brute_force():
    blocks = html_paths._blocks(PAGE)
    keys = [b.element.key for b in blocks]

    def ratio(value):
        per = {k: [value(b) for b in blocks if b.element.key == k] for k in keys}
        return [sum(per[k]) / len(per[k]) for k in keys]

    text, mark = ratio(lambda b: len(b.text) - b.link), ratio(lambda b: sum(c in ".,;:!?" for c in b.text))
    smooth = lambda x: [0.25 * x[max(i - 1, 0)] + 0.5 * x[i] + 0.25 * x[min(i + 1, len(x) - 1)] for i in range(len(x))]
    fuse = lambda t, m: [math.log(1 + a) * (1 + math.log(1 + b)) for a, b in zip(t, m)]
    smoothed, alone = html_paths.path_scores(blocks)
    np.testing.assert_allclose(smoothed, fuse(smooth(text), smooth(mark)))
    np.testing.assert_allclose(alone, fuse(text, mark))


def test_extract_pages_frame(spark):
    rows = [(1, "u", PAGE, "z"), (2, None, None, "z"), (2, None, None, "z"), (None, "v", "<p>" + "word, " * 50_000 + "</p>", "z")]
    got = html_paths.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, _lm_html string")).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_paths.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_url_rules(spark):
    urls = ["http://A.Example.COM/en/x?q", "https://www.example.com/en/", "http://x.com", "http://b.net/es/1#f", "no scheme", None, "x://net/fr/", "http://notexample.com/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df, registry.URL_RULES).collect()}
    assert [got[i]["rule"] for i in range(8)] == ["example.com/en/", "www.example.com/en/", None, "net/es/", None, None, "net/fr/", "com/"]
    assert [got[i]["host"] for i in range(3)] == ["a.example.com", "www.example.com", "x.com"] and got[0]["path"] == "/en/x"
    assert (got[5]["host"], got[5]["path"]) == ("", "") and got[0]["allow"] is False and got[1]["allow"] is True


def test_url_model_separates_held_out_urls(spark):
    rng = random.Random(4)
    made = [(i, f"http://{rng.choice(['news', 'blog', 'wiki'])}{rng.randrange(99)}.org/story/{rng.randrange(999)}" if i % 2 else
             f"http://{rng.choice(['casino', 'pills', 'xxx'])}-{rng.randrange(99)}.org/win/{rng.randrange(999)}") for i in range(800)]
    rules = [url_filter.Rule(bool(i % 2), made[i][1].split("/")[2], "/") for i in range(0, 60)]
    got = url_filter.judge_urls(spark.createDataFrame(made, "page_id long, url string"), rules).where("rule IS NULL").collect()
    right = sum(r["allow"] == bool(r["page_id"] % 2) for r in got)
    assert len(got) > 100 and right / len(got) > 0.95


def test_url_model_reads_the_whole_url(spark):
    urls = ["HTTP://A.org/X?Q=1#F", "http://a.org?q", "http://A.org#F", "No Scheme?x=Y", None, "http://ä.org/é?ü", "A?u=http://B.org/C"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    want = ["http://a.org/X?Q=1#F", "http://a.org?q", "http://a.org#F", "No Scheme?x=Y", "", "http://ä.org/é?ü", "a?u=http://b.org/C"]
    assert [r["t"] for r in df.select(url_filter.model_text("url").alias("t")).collect()] == want
    made = [(i, f"http://{'good' if i % 2 else 'bad'}.org/p{i}?ref={'page' if i % 2 else 'casino-win'}{i}") for i in range(300)]
    asked = [(1000, "http://new.com/a?ref=casino-win"), (1001, "http://new.com/a?ref=page2"), (1002, "ref=casino-win"), (1003, "ref=page2")]
    rules = [url_filter.Rule(True, "good.org", "/"), url_filter.Rule(False, "bad.org", "/")]
    got = {r["page_id"]: r["score"] for r in url_filter.judge_urls(spark.createDataFrame(made + asked, "page_id long, url string"), rules).collect()}
    assert got[1000] < got[1001] and got[1002] < got[1003]


def _url_model_by_dictionaries(known, asked, order=4, prior=2.0):
    """Scores of ``asked`` by plain dictionaries over (context, symbol) tuples."""
    counts, totals = [{}, {}], [{}, {}]

    def steps(url):
        marks = [None] * order + list(url.encode()) + ["end"]
        for i in range(order, len(marks)):
            for k in range(order + 1):
                yield i, tuple(marks[i - k : i]), marks[i]

    for url, allow in known:
        for _, context, symbol in steps(url):
            key = (context, symbol)
            counts[allow][key] = counts[allow].get(key, 0) + 1
            totals[allow][context] = totals[allow].get(context, 0) + 1
    out = []
    for url in asked:
        p = [{}, {}]
        for i, context, symbol in steps(url):
            for c in (0, 1):
                p[c][i] = (counts[c].get((context, symbol), 0) + prior * p[c].get(i, 1 / 257)) / (totals[c].get(context, 0) + prior)
        out.append(sum(math.log(p[1][i]) - math.log(p[0][i]) for i in p[0]) / len(p[0]))
    return out


def test_url_model_against_dictionaries(spark):
    rng = random.Random(6)
    known = [(f"http://{rng.choice(['a', 'bé', 'cc'])}{rng.randrange(9)}.org/{rng.randrange(99)}", rng.random() < 0.5) for _ in range(120)] + [("", True)]
    asked = ["http://a1.org/5", "", "zzz", "http://bé9.org/", known[0][0]] * 2
    size = url_filter.ModelSize()
    model = url_filter.fit_model(spark.createDataFrame(known, "t string, a boolean").repartition(3), size)
    got = url_filter.url_scores(*string_buffer(pa.array(asked)), model, size)
    np.testing.assert_allclose(got, _url_model_by_dictionaries(known, asked), rtol=1e-12)


def test_url_probabilities_are_probabilities(spark):
    rng = random.Random(7)
    known = [("".join(rng.choice("abcdefghijklmnop/.-?=0123456789") for _ in range(30)), bool(i % 2)) for i in range(20_000)]
    df = spark.createDataFrame(known, "t string, a boolean")
    for size in (url_filter.ModelSize(), url_filter.ModelSize(max_entries=20_000)):
        model = url_filter.fit_model(df, size)
        assert len(model.grams) + len(model.contexts) <= size.max_entries and len(model.grams) > 10_000
        p, _ = url_filter.symbol_probabilities(*string_buffer(pa.array([u for u, _ in known[:3000]])), model, size)
        assert p.min() > 0 and p.max() <= 1
    # all symbols after a context: their probabilities add up to one
    texts = [f"ab{chr(c)}" for c in range(1, 128)]
    p, row = url_filter.symbol_probabilities(*string_buffer(pa.array(texts)), model, size)
    third = np.array([np.flatnonzero(row == i)[2] for i in range(len(texts))])
    assert (p[third].sum(0) <= 1 + 1e-9).all() and (p[third].sum(0) > 0.9).all()


def test_url_scores_do_not_depend_on_the_size_of_the_model(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop-0123456789") for _ in range(rng.randrange(1, 20)))
    texts = [f"http://{rng.choice(['good', 'bad', 'new'])}.org/{word()}?{word()}" for _ in range(600)] + ["", "x", "http://new.org/é"]
    rows = [*enumerate(texts), (None, texts[5]), (5, None)]
    rules = [url_filter.Rule(True, "good.org", "/"), url_filter.Rule(False, "bad.org", "/")]
    known = [(t or "", "good" in t) for _, t in rows if t and ".org" in t and "new.org" not in t]
    learned = [(t, a) for t, a in known if zlib.crc32(t.encode()) % 5]
    want = sorted(zip([str(i) for i, _ in rows], _url_model_by_dictionaries(learned, [t or "" for _, t in rows])))
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    runs = []
    for batch, size in ((before, url_filter.ModelSize()), ("7", url_filter.ModelSize(max_entries=500))):  # one block a task, many blocks a task
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = url_filter.judge_urls(df, rules, size=size).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert sorted(str(r["page_id"]) for r in got) == [i for i, _ in want]
        np.testing.assert_allclose([s for _, s in sorted((str(r["page_id"]), r["score"]) for r in got)], [s for _, s in want], rtol=1e-9)
        runs.append(sorted(map(str, got)))
    assert runs[0] == runs[1]


def test_url_rules_against_sql(spark):
    import duckdb

    rng = random.Random(8)
    urls = [None, "", "x", "://", "a://B.COM"] + [
        rng.choice(["http://", "HTTPS://", "", "x://"]) + rng.choice(["A.Example.com", "www.example.com", "b.net", "net", "other.org", "notexample.com", "u@h.com:80"])
        + rng.choice(["", "/", "/en/", "/es/x", "/fr", "/en/y?z=://net/es/", "?q", "#f", "/é\n/"]) for _ in range(300)]
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), registry.URL_RULES)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    con.execute("CREATE TABLE rules (host VARCHAR, path VARCHAR)")
    con.executemany("INSERT INTO rules VALUES (?, ?)", [(r.host, r.path) for r in registry.URL_RULES])
    want = con.execute("""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
        SELECT page_id, p.host, p.path,
               (SELECT arg_max(r.host || r.path, length(r.host || r.path)) FROM rules r
                WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS rule
        FROM p""").fetchall()
    assert sorted(want) == sorted((r["page_id"], r["host"], r["path"], r["rule"]) for r in got.collect())


def test_url_filter_cases(spark):
    schema = "page_id long, url string, score string, _lm_text int"
    assert url_filter.judge_urls(spark.createDataFrame([], schema), registry.URL_RULES).collect() == []
    rows = [(1, "http://a.com/" + "x" * 300_000, "s", 1), (1, "http://a.com/", "s", 1), (None, None, None, None), (2, "http://x.net/es/q", "s", 2)] * 2
    got = url_filter.judge_urls(spark.createDataFrame(rows, schema), registry.URL_RULES).collect()
    assert sorted((str(r["page_id"]), r["allow"]) for r in got if r["rule"]) == [("1", True)] * 4 + [("2", False)] * 2 and len(got) == 8


def _base_by_regex(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(?:\.[0-9]+){3}", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9](?:[\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_pii_base_spans_and_digest(spark):
    rng = random.Random(1)
    bits = ["a.b@c.de ", "x@y ", "1.2.3.4", "999.1.1.1 ", "4111 1111 1111 1111", "4111111111111112 ", "+1 (017) 555-7713", "+49 30", " é ", "foo ", "12-", "9" * 30 + " ", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(150)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.add_spans(docs.withColumn("spans_", F.lit(1)), pii.train(docs))
    got = {r["doc_id"]: r for r in registry.pii_digest(found).collect()}
    for i, text in enumerate(texts):
        want = _base_by_regex(text or "")
        assert got[i]["n_card"] == sum(k == "card" for k, _, _ in want)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest(), text
        assert set(f"{k}:{s}:{e}" for k, s, e in want) <= set(got[i]["spans"].split(","))
    masked = {r["doc_id"]: r["masked"] for r in found.collect()}
    assert masked[150] == "" and "@c.de" not in "".join(masked.values())


def test_pii_em_finds_the_unreliable_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.7
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) for p in (0.95, 0.9, 0.9, 0.85, 0.5, 0.9)], 1) * 2 - 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, rely = pii.estimate(patterns, counts.astype(float))
    accuracy = [(rely[1, j, 2] + rely[0, j, 0]) / 2 for j in range(6)]
    assert min(accuracy[:4]) > 0.8 and abs(accuracy[4] - 0.5) < 0.06


def test_quality_ranker(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    good = [" ".join(word() for _ in range(80)) + "." for _ in range(150)]
    bad = [" ".join([word() + "$$$"] * 60) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(good + bad), (None, "x"), (900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(210)] + [(None, 1), (5, None), (7, 3)], "doc_id long, quality int")
    ranker = quality.train(docs, labels.where("doc_id IS NULL OR doc_id % 2 = 0"))
    got = {r["doc_id"]: r["score"] for r in quality.add_score(docs, ranker).collect()}
    assert all((got[i] >= 0.3) == (i < 150) for i in range(210)) and 0 <= got[900] <= 1
    assert 0.0 < ranker.cut < 0.9
    assert quality.train(docs, labels.where("doc_id = -1")).probability(np.zeros((1, quality.N_FEATURES)))[0] == 0.5


def test_encoder_matches_tokenizers():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(registry.TOKENIZER)
    special = [x.content for x in t.get_added_tokens_decoder().values()]
    assert "<|endoftext|>" in special
    rng = random.Random(2)
    encode = packing.encoder(registry.TOKENIZER)
    for k in range(300):
        text = "".join(chr(rng.choice([32, 10, 9, 39, *range(48, 123), 0xE9, 0x4E2D, 0x1F600, 0xA0, 0x301])) for _ in range(rng.randrange(60)))
        text += (rng.choice(special) + " b") * (k % 3)
        assert list(encode(text)) == t.encode(text, add_special_tokens=False).ids, repr(text)
    assert t.token_to_id("<|endoftext|>") in encode("x <|endoftext|> y")


def test_packing_whole_and_gapless(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma,"]) for _ in range(rng.choice([0, 1, 5, 60, 300, 900]))) for _ in range(300)] + [None, ""]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, "x")], "doc_id long, text string").repartition(5)
    rows = packing.pack(packing.token_pieces(docs, registry.TOKENIZER, capacity=128), capacity=128, group_rows=50).collect()
    encode, by_seq, by_doc = packing.encoder(registry.TOKENIZER), {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        if r["doc_id"] not in (3, None):
            by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["ids"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    for i, text in enumerate(texts):
        if i != 3:
            parts = sorted(by_doc[i])
            ids = [x for _, _, p in parts for x in p]
            assert ids == [*encode(text or ""), 2] and [s for _, s, _ in parts] == list(np.cumsum([0] + [len(p) for _, _, p in parts])[:-1])
    total = sum(r["length"] for r in rows)
    assert len(by_seq) <= -(-total // 128) + 6


def test_plan_uses_every_piece():
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = np.zeros(65, np.int64)
        counts[rng.integers(1, 65, 12)] = rng.integers(1, 50, 12)
        used = np.zeros(65, np.int64)
        for times, chosen in packing.plan_bins(counts, 64):
            assert sum(chosen) <= 64
            np.add.at(used, chosen, times)
        assert (used == counts).all()


def test_word_hashes():
    texts = ["Ab  cD\tab\x0b", "", " ", "é\u00a0x ab", "z" * 3_000_000 + " ab"]
    h, row = word_hashes(*string_buffer(pa.array(texts)))
    assert row.tolist() == [0, 0, 0, 3, 3, 4, 4] and h[0] == h[2] == h[4] == h[6] == hash_word("AB") != h[1]
    assert h[3] == hash_word("é\u00a0x")
