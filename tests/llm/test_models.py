"""Quality rules, URL filters, HTML extraction, classifier and mixing."""

import itertools
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from ledgerlake.llm import html_text, mixing, quality_model, quality_rules, registry, url_filters

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_quality_rules_match_duckdb(spark, odd):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(odd.drop("label", "h"))
    con = duckdb.connect()
    documents = df.toArrow()  # noqa: F841  read by name
    want = con.sql("WITH documents AS (SELECT * FROM documents) " + registry.ORACLE_SQL["op3_quality_rules"].strip().replace("WITH d AS", ", d AS", 1)).fetchall()
    got = quality_rules.judge(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_quality_rules_empty_and_one_source(spark, empty):
    assert quality_rules.judge(empty).count() == 0
    clean, junk = "the quick brown fox jumps over lazy dogs and runs to its den while rain falls on every hill of this old wide land", "the### quick%%% "
    df = spark.createDataFrame([(i, f"{clean} {i} {clean[::-1]}", "en", "hot") for i in range(150)] + [(1000 + i, " ".join(f"w{i}x{j}###" for j in range(40)), "en", "hot") for i in range(30)] + [(2000, junk, "en", "hot")], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(df).collect()}
    assert all(kept[i] for i in range(150)) and not any(v for k, v in kept.items() if k >= 1000)


def test_url_parts(spark):
    rows = [("https://A.Example.COM/en/7?x=1#f", "a.example.com", "/en/7"), ("http://x.net", "x.net", ""), ("http://x.net?q://y/z", "x.net", ""), ("no scheme/at/all", "", ""), (None, "", ""), ("://h#f/p", "h", ""), ("a://É.org/ß", "É.org", "/ß"), ("a://b://c/d", "b:", "//c/d")]
    df = spark.createDataFrame([(u,) for u, _, _ in rows], "url string").select(url_filters.host_of(F.col("url")), url_filters.path_of(F.col("url")))
    assert [tuple(r) for r in df.collect()] == [(h, p) for _, h, p in rows]


def test_stated_rules_and_mined_rules_match_brute_force(spark):
    r = random.Random(3)
    hosts = ["www.cheap-pills.example.com", "news.site.org", "m.free-bets.net", "example.com", "badexample.com", "blog.example.net", None]
    urls = [None if (h := r.choice(hosts)) is None else f"http://{h}/{r.choice(['en', 'de', 'es'])}/{r.randint(1, 900)}" for _ in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([(i, ("pills" in (u or "")) or ("bets" in (u or "") and "/de/" in u)) for i, u in enumerate(urls) if i % 2] + [(0, None)], "page_id long, blocked boolean")
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/1")]
    got = {x.page_id: x for x in url_filters.filter_urls(pages, labels, rules, min_rows=5, min_confidence=0.9).collect()}
    for i, u in enumerate(urls):
        m = re.match(r".*?://([^/?#]*)([^?#]*)", u or "")
        host, path = m.groups() if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        bad = "pills" in host or ("bets" in host and path.startswith("/de/"))
        want = max(fits)[1:] if fits else (None, "block" if bad else "allow")
        assert (got[i].rule, got[i].verdict) == want, u
    none = url_filters.filter_urls(pages.where("false"), labels, rules)
    assert none.count() == 0
    assert {x.verdict for x in url_filters.filter_urls(pages, labels.where("false"), []).collect()} == {"allow"}


def test_url_rules_are_frequent_confident_and_irredundant(spark):
    rows = [(["h:a", "h:x"], True)] * 30 + [(["h:a", "h:y"], True)] * 10 + [(["h:b"], False)] * 40 + [(["h:b", "p:z"], True)] * 3
    found = {tuple(r.tokens): round(r.confidence, 3) for r in url_filters.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), min_rows=8).collect()}
    assert found == {("h:a",): 1.0, ("h:x",): 1.0, ("h:y",): 1.0}


def test_url_rules_of_rare_hosts_in_large_tables_and_of_many_tokens(spark):
    five = [f"p:{x}" for x in "abcde"]
    rows = [(["h:rare"], True)] * 25 + [(["h:few"], True)] * 19 + [(["h:big"], False)] * 30_000
    rows += [(five, True)] * 30 + [(five[:i] + five[i + 1 :], False) for i in range(5)] * 20
    found = {(tuple(r.tokens), round(r.support * len(rows))) for r in url_filters.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), min_confidence=0.8).collect()}
    assert found == {(("h:rare",), 25), (tuple(five), 30)}


def _tokens(host, path):
    labels = [x for x in host.split(".") if x]
    parts = [x for x in re.split(r"[.-]", host) if x]
    return frozenset(f"h:{x}" for x in labels + parts) | frozenset("p:" + re.sub("[0-9]+", "0", x) for x in path.split("/") if x)


def test_url_query_matches_brute_force(spark, tmp_path):
    r = random.Random(11)
    say = lambda: " ".join(r.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(r.randrange(900)) for _ in range(8))
    hosts = ["www.farm.example.org", "good.example.net", "mixed.example.com", "other.site"]
    docs, pages, labels, truth = [], [], [], {}
    for i in range(320):
        host, lang = r.choice(hosts), r.choice(["en", "de", "es"])
        bad = r.random() < {"www.farm.example.org": 0.9, "good.example.net": 0.02, "other.site": 0.1}.get(host, 0.85 if lang == "de" else 0.05)
        lines = [say() for _ in range(3)]
        docs.append((i, "\n".join([*lines, "a line that every one of the documents has"]), "en", "s", 0))
        url = r.choice([f"http://{host.upper()}/{lang}/{i}?q=1", f"https://{host}/{lang}/{i}#f"])
        html = "<html><nav>" + "".join(f"<li>{say()}</li>" for _ in range(3)) + "</nav><p>" + "<p> ".join(lines) + "</p><p>a line that every one of the documents has</html>"
        pages.append((i * 7 % 320, url, html))
        if i % 3:
            labels.append((i, int(not bad), 0))
            truth[i * 7 % 320] = bad
    pages += [(900, None, None), (900, None, None), (None, "http://www.farm.example.org/es/8" + "x" * 5000, ""), (901, "no scheme", "<p>" + docs[1][1])]
    truth[901] = not labels[0][1]
    labels += [(None, 1, 0), (5000, None, None)]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("pages", pages, "page_id long, url string, html string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    split = lambda u: (m[1].translate(str.maketrans(url_filters._UPPER, url_filters._LOWER)), m[2]) if (m := re.match(r".*?://([^/?#]*)([^?#]*)", u or "")) else ("", "")
    baskets = [(_tokens(*split(u)), truth[i]) for i, u, _ in pages if i in truth]
    least = max(0.5, 1.5 * sum(b for _, b in baskets) / len(baskets))

    def implied(t):
        for size in range(1, len(t) + 1):
            for part in itertools.combinations(sorted(t), size):
                votes = [b for x, b in baskets if x >= set(part)]
                if sum(votes) >= 20 and sum(votes) / len(votes) >= least:
                    return True
        return False

    got = sorted((x.page_id or -1, x.host, x.path, x.rule or "", x.verdict) for x in registry.op2_url_filters(spark, str(tmp_path)).collect())
    known, want = {}, []
    for i, u, _ in pages:
        host, path = split(u)
        fits = [(len(h + p), h + p, v) for v, h, p in registry.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        t = _tokens(host, path)
        if t not in known:
            known[t] = implied(t)
        want.append((i or -1, host, path, *(max(fits)[1:] if fits else ("", "block" if known[t] else "allow"))))
    assert got == sorted(want) and {"block", "allow"} == {v for *_, rule, v in got if not rule}


def test_stated_rules_of_equal_length_and_an_empty_list(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/x/1/2")], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, blocked boolean")
    for first, last in (("block", "allow"), ("allow", "block")):
        assert url_filters.filter_urls(pages, none, [(first, "b.c", "/x/"), (last, "c", "/x/1/")]).first().verdict == last
    assert url_filters.filter_urls(pages, none, []).first().verdict == "allow"


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><div id="cookie-notice">We use cookies &amp; more.</div><header class="site-header"><h2>Daily</h2></header>
<div class="content"><h1>Big   story</h1><p>The council met on Tuesday to discuss the new plan for the harbour, and many people came.<p>A&amp;B short.</p><div class="ad">Buy now cheap!</div>
<p>Another paragraph with enough text to be seen as prose, which goes on for a while, and ends.</p></div><div class="comments"><h3>Comments</h3><div class="comment"><p>I think it should have met earlier.</p></div></div>
<form><label>Name</label><button>Send</button></form><footer>&copy; 2020</footer></body></html>"""


@pytest.fixture(scope="module")
def page_model(spark):
    return html_text.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), most_pages=120)


def test_main_text_of_known_pages(spark, page_model):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages, page_model).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html_text.html.unescape(re.sub(r"<[^>]*(>|$)", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_main_text_of_another_layout(page_model):
    text = html_text.main_texts([PAGE, "", "plain words only", "<p>cut off in a t"], page_model)
    assert text[0] == "Big story\nThe council met on Tuesday to discuss the new plan for the harbour, and many people came.\nA&B short.\nAnother paragraph with enough text to be seen as prose, which goes on for a while, and ends."
    assert text[1] == ""


def test_tables_figures_and_code_of_an_article_are_kept(page_model):
    prose = "<p>The council met on Tuesday to discuss the new plan for the harbour, and many people came, who asked what it would cost.</p>"
    table = "<table><tr><td>cell one</td><td>cell two</td></tr><tr><td>cell three</td><td>cell four</td></tr></table>"
    page = f"<html><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><article><h1>T</h1>{prose}<pre>x = 1</pre>{table}{prose}<figure><img src='i'><figcaption>A caption of the picture</figcaption></figure><blockquote>They said so.</blockquote></article><footer>&copy; 2020</footer></body></html>"
    got = html_text.main_texts([page], page_model)[0].split("\n")
    said = re.sub("<[^>]*>", "", prose)
    assert got == ["T", said, "x = 1", "cell one", "cell two", "cell three", "cell four", said, "A caption of the picture", "They said so."]


def test_held_out_layouts(page_model):
    r, right, total = random.Random(99), 0, 0
    blocks = [" ".join(f"{w}{r.randrange(50)}" for w in r.choices(["ala", "bero", "cinta", "dor"], k=r.randint(4, 40))) + "." for _ in range(40)]
    for _ in range(60):
        own = r.sample(blocks, 8)
        page = html_text.Page(html_text.compose(own, r))
        p = page_model.score(html_text.measure(page))
        for n, s in zip(page.nodes, p, strict=True):
            if n.label is not None and n.own:
                right, total = right + ((s > 0.5) == (n.label == "1")), total + 1
    assert right / total > 0.95


def test_nothing_below_a_dropped_node_is_kept():
    page = html_text.Page("<div><p>a</p></div><div><p>b</p></div>")
    html_text.measure(page)
    by = {n.tag + str(i): i for i, n in enumerate(page.nodes)}
    p = np.full(len(page.nodes), 0.5)
    p[by["div1"]], p[by["p2"]], p[by["div3"]], p[by["p4"]] = 0.001, 0.9, 0.9, 0.9
    assert html_text.decode(page.nodes, p) == ["b"]


def _shown(text):
    page = html_text.Page(text)
    html_text.measure(page)
    return [t for _, t in sorted(r for n in page.nodes if not n.hidden for r in n.runs)]


@pytest.mark.parametrize("text", [
    "<html><head><title>T</title><style>p{}</style><body><p>a</p><p>b</p></body></html>",
    "<head><meta charset=x><title>T</title><link rel=y><script>var c='<p>';</script><p>a</p><p>b",
    "<head><title>T</title>a<p>b</p>",
    "<html><head><title>T<meta name=z></head><body><p>a</p><p>b</p>",
    "<head><noscript><img src=x></noscript><title>T</title><body><p>a</p><p>b</p>",
    "<head><noscript><div><img src=x></div></noscript><title>T</title></head><body><p>a<p>b",
    "<head><noscript><style>p{}</style><body><p>a</p><p>b</p></body>",
    "<title>T</title><p>a</p><p>b</p>",
])
def test_head_without_its_end_tag(text):
    assert _shown(text) == ["a", "b"]


@pytest.mark.parametrize("veil", ["<noscript>js off", "<iframe src=x>", "<object data=x><param name=y>old", "<svg><g><path d=z>", "<template>t", "<svg><g><object>o"])
def test_hidden_elements_without_their_end_tag(veil):
    assert _shown(f"<body><div><p>a</p>{veil}<p>b</p></div><p>c</p></body>") == ["a", "b", "c"]
    assert _shown(f"<body><p>a{veil}<p>b</p>" + "<noscript><p>n</p></noscript><svg><text>s</text></svg><object><div>o</div></object>" + "<p>c") == ["a", "b", "c"]


def test_texts_of_pages_without_end_tags(page_model):
    want = html_text.main_texts([PAGE], page_model)
    assert html_text.main_texts([PAGE.replace("</head>", ""), PAGE.replace("</head><body>", ""), PAGE.replace("</header>", "</header><noscript>js off")], page_model) == want * 3


def test_extraction_awkward_rows(spark, page_model):
    rows = [(1, None, None), (None, "u", "<p>x"), (2, "u", ""), (2, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (3, "u", "<script>only</script>"), (4, "u", "<p>" + "word " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(df, page_model).collect()
    assert len(got) == len(rows) and {r.n_chars for r in got if r.page_id in (1, 3)} == {0}
    assert html_text.extract(df.where("false")).count() == 0


def plain_statistics(text):
    """The statistics of one text, word by word."""
    raw = text.encode()
    ws = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    lines = [tuple(w) for x in raw.split(b"\n") if (w := re.findall(rb"[^\x20\x09-\x0D]+", x))]
    size, n = max(len(raw), 1), max(len(ws), 1)
    per = lambda chars, of: sum(raw.count(c.encode()) for c in chars) / of
    grams = [[tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)] for k in (1, 2, 4)]
    lengths = [len(w) for w in ws]
    kinds = [per("ABCDEFGHIJKLMNOPQRSTUVWXYZ", size), per("0123456789", size), *(per(c, n) for c in ("#*$%&|<>@^~=+_{}[]\\/`", "!?", ".;:", ",")), sum(b > 127 for b in raw) / size, raw.count(b"\n") / n]
    apart = [len(set(g)) / max(len(g), 1) for g in grams]
    same = sum(a == b for a, b in itertools.pairwise(ws)) / n
    return [np.log1p(len(raw)), np.log1p(len(ws)), sum(lengths) / n, np.std(lengths or [0]), np.log1p(max(lengths, default=0)), *kinds, *apart, same, len(set(lines)) / max(len(lines), 1)]


def test_statistics_match_brute_force(spark, sf, odd):
    texts = [r.text or "" for r in odd.collect()] + [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["a a\n\n a a \nb\x0bc\r\n a a", " lead", "x", "\n\n", "#1! A.B, c; 中 文 中 文", "one\ntwo\none"]
    assert len(quality_model.STATISTICS) == len(plain_statistics(""))
    assert np.allclose(quality_model.statistics(pa.array(texts)), [plain_statistics(t) for t in texts], atol=1e-6)


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.op9_quality_classifier(spark, sf)
    told = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in told) / len(told) > 0.95


def test_flattened_trees_score_like_the_model(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    r = np.random.default_rng(0)
    x = r.normal(size=(400, 5))
    rows = [(float(a[0] + a[1] * a[2] > 0), [float(v) for v in a]) for a in x]
    df = spark.createDataFrame(rows, "label double, x array<double>").withColumn("features", array_to_vector("x"))
    model = GBTClassifier(maxIter=8, maxDepth=3, seed=1).fit(df)
    want = np.array([q.p[1] for q in model.transform(df).select(vector_to_array("probability").alias("p")).collect()])
    assert np.allclose(quality_model.Trees.of(model).score(x), want)


def test_classifier_awkward_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (8, None), (4, 0)], "doc_id long, quality int")
    got = quality_model.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got) and not next(r for r in got if r.doc_id is None).held_out
    assert quality_model.classify(empty, labels).count() == 0
    assert {r.score for r in quality_model.classify(odd, labels.where("false")).collect()} == {0.5}
    x = quality_model.statistics(pa.array([r.text or "" for r in odd.collect()]))
    assert x.shape == (odd.count(), len(quality_model.STATISTICS)) and np.isfinite(x).all()


def test_rates_meet_the_targets(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.op4_mixing(spark, sf).collect()
    total = sum(r.tokens for r in got)
    for domain, weight in registry.DOMAIN_WEIGHTS.items():
        assert abs(sum(r.rate * r.tokens * r[f"p_{domain}"] for r in got) / total - weight) < 1e-3
    assert min(r.rate for r in got) >= 0 and max(r.residual for r in got) < 1e-3
    told = {r.doc_id: r.domain for r in registry.domains(spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    names = list(registry.DOMAIN_WEIGHTS)
    right = [max(names, key=lambda n: r[f"p_{n}"]) == told[r.doc_id] for r in got if r.doc_id in told]
    assert sum(right) / len(right) > 0.95


def test_rates_are_least_squares_when_targets_cannot_be_met(spark):
    p = np.array([[0.9, 0.1], [0.5, 0.5], [0.2, 0.8]])
    n = np.array([10, 20, 30])
    members = spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(n, p, strict=True)], "tokens long, p array<double>")
    target = np.array([100.0, 0.0])  # no mix of these has none of the second
    r = mixing._rates(p, (fitted := mixing.fit_rates(members, target, most_steps=400))[0])
    scale = np.linalg.pinv((p * n[:, None]).T @ p)
    loss = lambda r: (d := (r * n) @ p - target) @ scale @ d
    assert np.allclose(fitted[1], (r * n) @ p)
    assert (r >= 0).all() and all(loss(r) <= loss(np.maximum(0, r + e)) + 1e-6 for e in np.random.default_rng(0).normal(scale=0.05, size=(200, 3)))


def test_mixing_awkward_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, "clean"), (5, "low"), (8, "toxic"), (None, "low"), (7, "other")], "doc_id long, domain string")
    got = mixing.mix_to_targets(odd, labels, registry.DOMAIN_WEIGHTS, tokenizer_path=WORDS, keep=("text", "label"))
    assert got.count() == odd.count() and got.columns[:3] == ["text", "label", "doc_id"] and got.where("rate < 0 or rate is null").count() == 0
    assert mixing.mix_to_targets(empty, labels, registry.DOMAIN_WEIGHTS, tokenizer_path=WORDS).count() == 0
    assert mixing.mix_to_targets(odd, labels.where("false"), registry.DOMAIN_WEIGHTS, tokenizer_path=WORDS).count() == odd.count()


def test_page_labels_shuffle_no_texts_at_any_size(spark):
    long = "a line that is long enough to tell a page's document"
    docs = spark.createDataFrame([(1, f"{long} one\nshort\n{long} one\n{long} two"), (2, f"{long} two"), (3, None), (None, f"{long} one"), (4, f"{long} three\n")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, True), (2, False), (3, True), (4, False)], "doc_id long, blocked boolean")
    pages = spark.createDataFrame([(10, f"<p>{long} one</p>"), (11, f"<p>{long} two</p>"), (12, f"<p>{long} three</p>"), (13, None)], "page_id long, html string")
    seen = []
    keep, url_filters.materialize = url_filters.materialize, lambda df, name: seen.append(df) or keep(df, name)
    try:
        got = {r.page_id: r.blocked for r in url_filters.label_pages(pages, docs, labels).collect()}
    finally:
        url_filters.materialize = keep
    assert got == {10: True, 12: False}  # two is in documents of both kinds
    import contextlib
    import io
    import re

    with contextlib.redirect_stdout(io.StringIO()) as out:
        seen[-1].explain("formatted")
    moved = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]", out.getvalue())
    assert any("hs#" in x for x in moved) and not any("text#" in x for x in moved)
