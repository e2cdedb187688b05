"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import base64
import gzip
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import hits, left_words, line_measures, shingles
from pyspark.sql import functions as F

from fleetscope.llm import boosted_gam, common, op01_language_id, op02_bpe, op03_setsketch, op04_html_wrapper, op05_decontamination
from fleetscope.llm import op06_license_scan, op07_lm_scoring, op08_quality_gam, op09_secret_scan, op10_quality_rules
from fleetscope.llm.byte_bpe import merge
from fleetscope.llm.context_mixing import sequence
from fleetscope.llm.fm_index import FmIndex, suffix_order
from fleetscope.llm.graph import components
from fleetscope.llm.html_tree import parse
from fleetscope.llm.lexicon import Lexicon, build
from fleetscope.llm.secret_layers import redacted, secret_spans
from fleetscope.llm.wrapper import induce, main_text

LONG = " ".join(f"word{k % 977} item{k % 1009}" for k in range(60_000))
PLAIN = " ".join(f"plain{k} text{k}" for k in range(60))
CLASH = ["row", "host", "node", "comp", "kept", "n_words", "doc", "id", "words", "text_", "score", "spans", "bucket", "lang_pred"]
SCHEMA = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASH)
TEXTS = [(1, PLAIN, "en", "a"), (2, PLAIN, "en", "a"), (2, PLAIN, "en", "a"), (None, PLAIN, None, None), (3, None, None, "a"), (4, "", "en", None),
         (5, " \n\t ", None, "a"), (6, LONG, "fr", "b"), (7, LONG + " end", "fr", "b"), (8, "éé ßß 漢字 \U0001F600", "de", "b"), (9, "one two three", "en", "b"),
         (10, "ONE two\nthree", "en", "b"), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *CLASH) for r in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df, *columns):
    out = {}
    for r in df.select("doc.doc_id", *columns).collect():
        out.setdefault(r.doc_id, []).append(tuple(r)[1:] if len(columns) > 1 else r[1])
    return out


def carries_all(df, docs):
    assert df.select("doc.*").schema == docs.schema
    assert df.count() == docs.count()


def test_near_duplicates(docs, none):
    out = op03_setsketch.near_duplicates(docs)
    carries_all(out, docs)
    got = by_id(out, "n_shingles", "component_id", "kept")
    n = len(shingles(PLAIN))
    assert got[1] == [(n, 1, True)] and got[2] == [(n, 1, False)] * 2
    assert sorted(got[None], key=str) == [(0, None, True), (n, 1, False)]
    assert got[3] == [(0, 3, True)] and got[4] == [(0, 4, True)] and got[5] == [(0, 5, True)]
    assert got[7][0][1:] == (6, False) and got[10] == [(1, 9, False)]
    assert op03_setsketch.near_duplicates(none).count() == 0


def test_chains_far_from_every_pivot(spark):
    """Texts in a ring: neighbours are alike, others are not, and all have one core."""
    core = [f"core{k}" for k in range(200)]
    texts = []
    for k in range(40):
        words = list(core)
        for j in range(k, k + 4):
            words[(j * 5) % 200] = f"edit{j}"
        texts.append((k, " ".join(words)))
    from brute import classes

    out = op03_setsketch.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string"))
    assert {r.doc_id: r.component_id for r in out.select("doc.doc_id", "component_id").collect()} == classes(texts)


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.85, 0.95):
        both = rng.integers(1, 1 << 62, int(2000 * share / (2 - share) * 2 - 0)).astype(np.uint64)
        a, b = (np.concatenate([both, rng.integers(1, 1 << 62, 2000 - min(len(both), 2000)).astype(np.uint64)]) for _ in range(2))
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s = op03_setsketch.sketch([np.unique(a), np.unique(b)]).astype(int)
        assert abs(op03_setsketch.estimate(s[:1], s[1:], np.array([len(a)]), np.array([len(b)]))[0] - exact) < 0.15
        # Registers merge by maximum.
        assert (op03_setsketch.sketch([np.union1d(a, b)])[0] == s.max(0)).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {n: n for e in edges for n in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_decontamination(spark, docs, none, monkeypatch):
    items = [(1, " ".join(PLAIN.split()[20:40])), (2, "one two three"), (None, "漢字"), (3, None), (4, " !? "), (5, LONG[:200])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = op05_decontamination.contamination(docs, bench)
    carries_all(out, docs)
    got = by_id(out, "n_words", "n_hit", "items")
    for i, text, *_ in TEXTS:
        n, hit, found = hits(text, items)
        assert (n, hit, [x for x in found if x != "None"]) in got[i]
    assert op05_decontamination.contamination(none, bench).count() == 0
    assert by_id(op05_decontamination.contamination(docs, bench.limit(0)), "n_hit")[1] == [0]
    cut = out.select("doc.doc_id", "doc.text", "spans").withColumn("left", op05_decontamination.without_spans("text", "spans"))
    left = {r.doc_id: r.left for r in cut.where("doc_id is not null").collect()}
    assert left[9] == "" and left[1] == PLAIN.replace(items[0][1], "") and left[8] == "éé ßß  \U0001F600" and left[4] == ""


def test_long_texts_are_cut_into_overlapping_pieces(monkeypatch):
    monkeypatch.setattr(op05_decontamination, "SHARD_WORDS", 64)
    words = [f"w{k % 37}" for k in range(500)]
    text = " ".join(words)
    items = [(k, " ".join(words[k:k + 14])) for k in range(0, 480, 60)] + [(99, " ".join(words[3:7]))]
    query = op05_decontamination.phrases([(str(i), op05_decontamination._words(*common.text_buffers(pa.array([t])))[0]) for i, t in items])
    block = type("Block", (), {})()
    block.value = query
    shard = op05_decontamination._Shard()
    shard.add(pa.RecordBatch.from_pydict({"doc": pa.array([1]), "text": pa.array([text])}), 1)

    class Kept:
        value = query
    hit, found = shard.found([Kept()])
    n, number, want = hits(text, items)
    assert (len(hit[0]), int(hit[0].sum()), sorted(found[0])) == (n, number, want)


def test_fm_index():
    rng = np.random.default_rng(5)
    for size, kinds in ((1, 1), (50, 2), (400, 3), (3000, 40)):
        s = np.append(rng.integers(2, 2 + kinds, size), 1)
        assert suffix_order(s).tolist() == sorted(range(len(s)), key=lambda k: s[k:].tolist())
        index = FmIndex(s)
        phrases = np.array([s[k:k + 3] for k in range(0, max(len(s) - 3, 0), 7)] or [[2, 2, 2]])
        found, lo, hi = index.search(phrases)
        for f, a, b in zip(found, lo, hi, strict=True):
            want = [k for k in range(len(s) - 2) if (s[k:k + 3] == phrases[f]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_secrets(docs, none):
    out = op09_secret_scan.secrets(docs)
    carries_all(out, docs)
    assert all(not r.spans for r in out.collect())
    assert op09_secret_scan.secrets(none).count() == 0


def test_nested_secrets():
    secret = 'password = "hunter2hunter2"'
    packed = base64.b64encode(gzip.compress(secret.encode(), mtime=0)).decode()
    twice = base64.b64encode(packed.encode()).decode()
    urls = "".join(f"%{c:02X}" for c in twice.encode())
    for token in (packed, twice, urls, secret.encode().hex(), "".join(f"\\u{ord(c):04x}" for c in secret[:-1])):
        text = f"é before {token} after"
        spans = secret_spans(text)
        assert any(k == "assign" and 9 <= a and b <= 9 + len(token) for k, a, b in spans), token
        assert "after" in redacted(text, spans) and packed not in redacted(text, spans)
    assert secret_spans("%25" * 50 + "\\u0025" * 20) == []
    assert secret_spans("token=short password=longer-than-8") == [("assign", 12, 34)]


def test_line_rules(spark, docs, none):
    out = op10_quality_rules.line_rules(docs)
    carries_all(out, docs)
    got = by_id(out, "n_words", "base_failed", "kept")
    assert got[1] == [(120, False, True)] and got[3] == [(0, True, False)] and got[6] == [(120_000, False, True)]
    assert op10_quality_rules.line_rules(none).count() == 0


def test_frequent_lines_deplete(spark):
    """A document of nothing but its host's boilerplate goes; copies of one text stay."""
    boiler = " ".join(f"boiler{k}" for k in range(60))
    rng = random.Random(7)
    rows = [(k, "h", boiler + "\n" + " ".join(f"w{rng.randrange(10**6)}" for _ in range(90))) for k in range(40)]
    other = "\n".join(" ".join(f"menu{j}x{k}" for k in range(5)) for j in range(3))
    rows += [(100, "h", boiler + "\n" + other)]
    copy = "\n".join(" ".join(f"copy{j}x{k}" for k in range(30)) for j in range(4))
    rows += [(200 + k, "h", copy) for k in range(60)] + [(300 + k, "h", copy + f" edit{k}") for k in range(60)]
    out = op10_quality_rules.line_rules(spark.createDataFrame(rows, "doc_id bigint, source string, text string"))
    kept = {r.doc_id: r.kept for r in out.select("doc.doc_id", "kept").collect()}
    assert not kept[100] and all(v for k, v in kept.items() if k != 100)


def test_bpe(docs, none):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = op02_bpe.encode(docs, path)
    carries_all(out, docs)
    back = op02_bpe.decode(out.select("doc.doc_id", "doc.text", "ids"), path).select("doc.text", "decoded").collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert op02_bpe.encode(none, path).count() == 0


def test_lexicon_and_merges():
    words = {w.encode(): [k, k + 1] for k, w in enumerate(["a", "ab", "abc", "bc", "tabc", "stabc", "é", "walking", "talking"])}
    lexicon = Lexicon(build(words))
    asked = [*words, b"", b"abcd", b"tab", b"x", b"talkin"]
    assert [None if r is None else r.tolist() for r in lexicon.lookup(asked)] == [*words.values(), None, None, None, None, None]
    assert Lexicon(build({})).lookup([b"a"]) == [None]
    assert len(lexicon.final) < sum(len(w) for w in words)
    rng = random.Random(2)
    merges = {(a, b): (k, 10 + k) for k, (a, b) in enumerate([(1, 2), (2, 1), (10, 10), (1, 1), (11, 2), (13, 12)])}
    for _ in range(200):
        ids = [rng.choice([1, 2]) for _ in range(rng.randrange(41, 90))]
        plain = list(ids)
        while True:
            ranked = [(merges[p][0], k) for k, p in enumerate(zip(plain, plain[1:], strict=False)) if p in merges]
            if not ranked:
                break
            k = min(ranked)[1]
            plain[k:k + 2] = [merges[plain[k], plain[k + 1]][1]]
        assert merge(list(ids), merges) == plain


def test_language_id(docs, none):
    model = op01_language_id.fit(docs.where("lang is not null and text is not null").select("text", "lang"))
    out = op01_language_id.predict(docs, model)
    carries_all(out, docs)
    got = by_id(out, "lang_pred", "score")
    assert got[3] == got[4] == got[5] == [("und", 0.0)] and got[1][0][0] == "en" and got[6][0][0] == "fr"
    empty = op01_language_id.fit(none.select("text", "lang"))
    assert set(r.lang_pred for r in op01_language_id.predict(docs, empty).collect()) == {"und"}


def test_long_text_counts_do_not_depend_on_slices(monkeypatch):
    data, offsets = common.text_buffers(pa.array([LONG[:5000], "x", ""]))
    whole = np.concatenate([c for _, _, c in op01_language_id.counts(data, offsets)])
    monkeypatch.setattr(op01_language_id, "SLICE", 101)
    assert (np.concatenate([c for _, _, c in op01_language_id.counts(data, offsets)]) == whole).all()


def test_main_text(spark):
    pages = [(1, "http://h/1", None), (2, None, "<p>a&amp;b<p>c<br>d"), (2, None, "<p>a&amp;b<p>c<br>d"), (3, "odd", ""), (4, "http://h/4", "<div>" * 3000 + "deep"),
             (5, "http://h/5", "<article><header><h1>T</h1></header><nav>menu</nav><p>x&nbsp; y</p><div class='comments'>c</div><script>s('</p>')</script></article><footer>f</footer>")]
    out = op04_html_wrapper.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("host", F.lit("x")).withColumn("salt", F.lit("y")))
    got = {r.page_id: r.text for r in out.select("doc.page_id", "text").collect()}
    assert out.count() == len(pages)
    assert got == {1: "", 2: "a&b\nc d", 3: "", 4: "deep", 5: "T\nx y"}


def test_template_text_is_left_out():
    pages = [f"<body><div class=a>Site name</div><div class=b><p>story {k}</p><p>more of {k}</p></div><div class=c>About us</div></body>" for k in range(5)]
    constants, path = induce([parse(p) for p in pages])
    assert main_text(parse(pages[4]), frozenset(constants), path) == "story 4\nmore of 4"


def _texts_of(spark, pages):
    out = op04_html_wrapper.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    return {r.page_id: r.text for r in out.select("doc.page_id", "text").collect()}


def test_articles_keep_what_revisions_share(spark):
    """Nothing outside an article replaces it, and few or similar pages make no template of its text."""
    revision = "<body><nav>menu</nav><article><h1>T</h1><p>first shared</p><p>second shared</p><p>end {}</p></article><p>remark {}</p></body>"
    same = "<body><article><p>the article</p><p>its end</p></article><div>another remark {}</div></body>"
    pages = [(k, "http://r/", revision.format(k, k)) for k in range(4)] + [(100 + k, "http://s/", same.format(k)) for k in range(4)]
    pages += [(200 + k, "http://t/", revision.format(k, k)) for k in range(60)] + [(300 + k, "http://t/", f"<article><p>other {k}</p><p>more {k}</p></article>") for k in range(20)]
    pages += [(400, "http://u/", "<article></article><div>outside</div>")]
    got = _texts_of(spark, pages)
    for k in range(4):
        assert got[k] == f"T\nfirst shared\nsecond shared\nend {k}"
        assert got[100 + k] == "the article\nits end"
    for k in range(60):
        assert got[200 + k] == f"T\nfirst shared\nsecond shared\nend {k}"
    assert all(got[300 + k] == f"other {k}\nmore {k}" for k in range(20)) and got[400] == ""


def test_pages_without_article_and_tables_without_pages(spark):
    """Two templates on one host: what repeats goes, what varies stays, whatever the template."""
    one = "<body><div class=top>Site</div><div class=story><p>tale {k}</p><p>rest {k}</p></div><div class=end>About</div></body>"
    two = "<body><div class=top>Site</div><table><tr><td>cell {k}</td></tr></table><div class=end>About</div></body>"
    pages = [(k, "http://two/", one.format(k=k)) for k in range(20)] + [(100 + k, "http://two/", two.format(k=k)) for k in range(20)]
    got = _texts_of(spark, pages)
    for k in range(20):
        assert got[k] == f"tale {k}\nrest {k}" and got[100 + k] == f"cell {k}"
    assert _texts_of(spark, []) == {}


def test_languages_are_learned_from_distinct_texts(spark):
    """A text that is delivered often does not push out the others of its language; a small group of texts is a cluster of its own."""
    rng = np.random.default_rng(5)
    vocabularies = {"aa": ["bako", "timu", "rela", "sona", "kipu", "dara"], "bb": ["zwyx", "qorv", "fjel", "hnyg", "vexq", "wulf"]}
    texts = {lang: [" ".join(rng.choice(words, 12)) for _ in range(300)] for lang, words in vocabularies.items()}
    odd = [" ".join(rng.choice(["umlo", "chvi", "ggeo"], 12)) for _ in range(8)]
    rows = [(t, lang) for lang in texts for t in texts[lang][:250]] + [(texts["aa"][0], "aa")] * 1600 + [(t, "aa") for t in odd[:6]]
    model = op01_language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    held = [(t, lang) for lang in texts for t in texts[lang][250:]] + [(t, "aa") for t in odd[6:]]
    got = op01_language_id.predict(spark.createDataFrame(held, "text string, lang string"), model).select("doc.lang", "lang_pred").collect()
    assert len(got) == 102 and all(r.lang == r.lang_pred for r in got)


def test_language_sample_moves_hashes_not_texts(spark):
    docs = spark.createDataFrame([("a b", "en"), ("a b", "en"), ("c d", None), (None, "en")], "text string, lang string")
    plan = op01_language_id.sampled(docs)
    assert sorted((r.text, r.lang) for r in plan.collect()) == [("a b", "en")]


def test_licences(spark, docs, none):
    out = op06_license_scan.license_scan(docs)
    carries_all(out, docs)
    assert {r.labels for r in out.collect()} == {""}
    assert op06_license_scan.license_scan(none).count() == 0
    cases = {"SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3", "Licensed under the Apache License, Version 2.0": "apache-2", "mit mitte isc cc": "",
             "under the MIT licence and CC BY-NC-SA 4.0": "cc-by-nc-sa,mit", "cc by nc": "cc-by-nc", "https://creativecommons.org/licenses/by-nd/4.0/": "cc-by-nd"}
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in op06_license_scan.license_scan(rows).select("doc.doc_id", "labels", "found").collect()}
    for k, (text, labels) in enumerate(cases.items()):
        assert set(labels.split(",")) <= set(got[k].labels.split(",")), text
    # The whole phrase contains the licence's bare name, which is suppressed.
    assert [(f.start, f.end) for f in got[1].found] == [(0, 46)]


def test_language_model(docs, none):
    training = docs.where("doc_id is not null").select("text")
    out = op07_lm_scoring.scores(docs, training)
    carries_all(out, docs)
    got = by_id(out, "n_tokens", "n_known", "score")
    assert got[3][0][:2] == (1, 1) and got[9][0][:2] == (4, 4) and got[3][0][2] < 0
    fresh = by_id(op07_lm_scoring.scores(docs, none.select("text")), "n_known", "base_score")
    assert fresh[9] == [(0, 0.0)]
    assert op07_lm_scoring.scores(none, training).count() == 0
    symbols, place, sizes = sequence(*common.text_buffers(pa.array(["", " A  b\n", "c"])))
    assert symbols.tobytes() == b"\xffa b\xffc\xff" and sizes.tolist() == [1, 4, 2] and place.tolist() == [0, 0, 1, 2, 3, 0, 1]


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 0), (None, 1), (77, 1), (8, None)], "doc_id bigint, quality int")
    out = op08_quality_gam.scored(docs, op08_quality_gam.fit(docs, labels))
    carries_all(out, docs)
    assert all(0 <= r.score <= 1 for r in out.collect())
    blank = op08_quality_gam.scored(docs, op08_quality_gam.fit(none, labels))
    assert {r.score for r in blank.collect()} == {0.5}


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosted_gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_template_text_inside_articles_is_left_out(spark):
    """Tags only choose among slots: what all pages of a host repeat goes, copies of a page count once, every slot stays."""
    def page(k, tag):
        return (f"<body><{tag}><h1>Title {k}</h1><p>story {k}</p><p>Follow us for more</p><section><p>more of {k}</p></section></{tag}>"
                f"<div class=c>About us</div></body>")

    pages = [(k, "http://a/", page(k, "article")) for k in range(30)] + [(100 + k, "http://b/", page(k, "div class=post")) for k in range(30)]
    pages += [(200 + k, "http://c/", page(0, "article")) for k in range(40)] + [(300, "http://c/", page(1, "article"))]
    out = op04_html_wrapper.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    got = {r.page_id: r.text for r in out.select("doc.page_id", "text").collect()}
    for k in range(30):
        assert got[k] == got[100 + k] == f"Title {k}\nstory {k}\nmore of {k}"
    # Two pages are too few for a template, however often one is repeated.
    assert got[200] == got[239] == "Title 0\nstory 0\nFollow us for more\nmore of 0"


def test_frequent_lines_are_removed(spark):
    """The lines above the limit go from the texts, with their breaks; the rest keeps its bytes, in the pipeline too."""
    import corpus_pipeline

    rng = random.Random(11)
    rows = []
    for k in range(40):
        own = " ".join("é" + "".join(rng.choices("abcdef", k=6)) for _ in range(80))
        rows.append((k, "h", f"Accept ALL cookies {k}\n{own}\n\n  \naccept all  cookies 7\nend {own[:50]}\nAccept all cookies {k % 10}", 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, n_chars bigint")
    want = {k: "\n".join([t.split("\n")[j] for j in (1, 2, 3, 5)]) + "\n" for k, _, t, _ in rows}
    out = {r.doc_id: r.clean for r in op10_quality_rules.line_rules(docs).select("doc.doc_id", "clean").collect()}
    assert out == want
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_line_verdicts_are_those_of_the_plain_version(spark):
    """Hosts of several sizes, lines that differ in case, digits and spaces, copies, near copies, nulls."""
    def name(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return op10_quality_rules._measure(data, np.array([0, len(data)]))["document"][0].as_py()

    rng = random.Random(21)
    pool = [" ".join(rng.choices("red green blue grey pink gold".split(), k=6)) for _ in range(12)]
    rows = []
    for k in range(240):
        lines = [rng.choice(["", "  ", str(k), rng.choice(pool), rng.choice(pool).upper(), f"page {k} of 9", "x" * (k % 7)]) for _ in range(rng.randrange(9))]
        lines += [" ".join(f"own{rng.randrange(999)}" for _ in range(rng.randrange(40, 90)))] * rng.randrange(2)
        rows.append((k, rng.choice(["a", "a", "a", "b", None]), "\n".join(lines) if k % 31 else None))
    rows += [(1000 + k, "a", rows[1][2]) for k in range(40)] + [(2000 + k, "b", (rows[2][2] or "") + f"\nedit{k}") for k in range(40)]
    out = op10_quality_rules.line_rules(spark.createDataFrame(rows, "doc_id bigint, source string, text string"))
    got = {r.doc_id: (r.left_words, r.kept) for r in out.select("doc.doc_id", "left_words", "kept").collect()}
    want = left_words(rows, name)
    assert got == {i: (want[i], not line_measures(t)[5] and want[i] >= 0.3 * line_measures(t)[0]) for i, _, t in rows}
    assert any(w < line_measures(t)[0] for (_, _, t), w in zip(rows, want.values(), strict=True))


def test_one_row_of_each_class(spark, docs, none):
    """Repeated ids and unknown ids leave one row a class; other rows and columns stay as they are."""
    out = op03_setsketch.one_of_each(docs)
    assert out.schema == docs.schema
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(i for i, t in got if t and t.split() and i is not None) == [1, 6, 8, 9]
    twice = spark.createDataFrame([(5, PLAIN), (5, PLAIN), (5, PLAIN + " more"), (None, LONG), (None, LONG), (7, "other words " * 30)], "doc_id bigint, text string")
    assert sorted(str(r.doc_id) for r in op03_setsketch.one_of_each(twice).collect()) == ["5", "7", "None"]
    assert op03_setsketch.one_of_each(none).count() == 0


def test_distinct_documents_of_shared_boilerplate(spark):
    """Documents that share several template lines are distinct; copies swell neither side; many documents suffice without a share."""
    rng = random.Random(12)
    template = [" ".join(f"line{j}x{k}" for k in range(25)) for j in range(4)]
    unique = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(60)]
    rows = [(k, "h", "\n".join([*template, unique[k]])) for k in range(60)]
    copy = " ".join(f"copy{k}" for k in range(60))
    rows += [(100 + k, "h", copy) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = {r.doc_id: (r.clean, r.kept) for r in op10_quality_rules.line_rules(docs).select("doc.doc_id", "clean", "kept").collect()}
    assert all(got[k] == (unique[k], False) for k in range(60)) and got[100] == (copy, True)
    measured = spark.createDataFrame([("h", k, [(1,)] if k < 30 else []) for k in range(1000)], "host string, text_key bigint, lines array<struct<line:bigint>>")
    named = spark.range(1000).select(F.col("id").alias("text_key"), F.col("id").alias("document"))
    assert op10_quality_rules.frequent_lines(measured, named).count() == 0
    assert [r.line_docs for r in op10_quality_rules.frequent_lines(measured, named, many=20).collect()] == [30]


def test_secrets_in_layers_that_are_not_plain_text():
    """UTF-16, mixed binary, wrapped lines, glued tokens and concatenated members are read."""
    import bz2
    import io
    import tarfile
    import textwrap

    rng = random.Random(5)
    secret = 'password = "hunter2hunter2"'
    noise = bytes(rng.randrange(128, 256) for _ in range(400))
    lines = "\n".join(f"line {rng.random()}" for _ in range(40)) + "\n" + secret
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as f:
        info = tarfile.TarInfo("config")
        info.size = len(secret)
        f.addfile(info, io.BytesIO(secret.encode()))

    def packed(data):
        return base64.b64encode(data).decode()

    cases = {"utf-16-le": packed(secret.encode("utf-16")), "utf-16-be": packed(secret.encode("utf-16-be")), "mixed": packed(noise + secret.encode() + noise),
             "tar": packed(tar.getvalue()), "gzip members": packed(gzip.compress(b"nothing here" * 9) + gzip.compress(secret.encode())),
             "bz2 members": packed(bz2.compress(b"nothing here" * 9) + bz2.compress(secret.encode()))}
    for width in (64, 76):
        cases[f"text {width}"] = "\n".join(textwrap.wrap(packed(lines.encode()), width))
        cases[f"gzip {width}"] = "\r\n".join(textwrap.wrap(packed(gzip.compress(lines.encode())), width))
    for glue in ("a/", "key-", "x_", "ab/cde-"):
        cases[f"text {glue}"] = glue + packed(secret.encode())
        cases[f"gzip {glue}"] = glue + packed(gzip.compress(secret.encode()))
    for name, token in cases.items():
        text = f"before\n\n{token}\n\nafter"
        spans = secret_spans(text)
        assert any(k == "assign" and 8 <= a and b <= 8 + len(token) for k, a, b in spans), name
        assert redacted(text, spans).startswith("before") and redacted(text, spans).endswith("after"), name


def test_secrets_across_the_edges_of_pieces(monkeypatch):
    """A nested token is found wherever a piece ends in it, in one line or many, and however long it is."""
    from fleetscope.llm import secret_layers

    monkeypatch.setattr(secret_layers, "PIECE", 3000)
    monkeypatch.setattr(secret_layers, "OVERLAP", 64)
    rng = random.Random(5)
    secret = "password = 'hunter2hunter2'"
    inner = gzip.compress((" ".join(str(rng.randrange(10**9)) for _ in range(900)) + "\n" + secret).encode(), mtime=0)
    one = base64.b64encode(inner).decode()
    many = "\n".join(one[k:k + 76] for k in range(0, len(one), 76))
    assert len(one) > 2 * secret_layers.PIECE
    for token in (one, many):
        for before in range(0, 3100, 157):
            filler = "filler text, " * 300
            outer = base64.b64encode(gzip.compress((filler[:before] + " " + token + " end of it").encode(), mtime=0)).decode()
            assert ("assign", 4, 4 + len(outer)) in secret_spans("see " + outer + " there"), before


def test_data_that_repeat_themselves_take_little_memory():
    """Forty megabytes out of a short token: a few pieces are held, equal ones are read once."""
    import tracemalloc

    token = base64.b64encode(gzip.compress(b"some words of a line\n" * (2 << 20) + b"token: abcdefgh1234", mtime=0)).decode()
    tracemalloc.start()
    assert secret_spans(token) == [("assign", 0, len(token))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20


def test_every_alternative_of_a_licence_is_reached(spark):
    """Versions glued to short names, other words for one licence, and headers wrapped in comments."""
    cases = {"This is GPLv2 code": "gpl-2", "released under GPLv3": "gpl-3", "license: GPL3": "gpl-3", "under the FreeBSD license": "bsd-2-clause",
             "the Common Development and Distribution License": "cddl-1", "European Union Public Licence": "eupl-1.2", "GNU Library General Public License": "lgpl",
             "without the express prior written consent": "proprietary", "see Apache 2.0 for details": "apache-2", "Creative Commons Attribution 4.0": "cc-by",
             " * Licensed under the\n *  Apache License,\n * Version 2.0 (the": "apache-2", "// GNU General\r\n// Public   License": "gpl",
             "# Permission is hereby granted, free of\n#\n# charge, to any person\n# obtaining a copy": "mit",
             "Neither the name of the\nowner nor others may be used to\nendorse or promote": "bsd-3-clause"}
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in op06_license_scan.license_scan(rows).select("doc.doc_id", "labels", "found").collect()}
    for k, (text, label) in enumerate(cases.items()):
        assert label in got[k].labels.split(","), (text, got[k].labels)
    wrapped = list(cases)[10]
    # Places are those of the given text.
    assert (3, wrapped.index(" (the")) in [(f.start, f.end) for f in got[10].found]


def test_every_page_of_a_host_is_aligned(spark):
    """A line that a few pages of many have differently is no template, whichever pages they are; a line that all have is."""
    def page(j, k):
        line = f"edition {k}" if k in (0, 20, 40) else "the usual line"
        return f"<body><div class=a><p>Our site</p></div><div class=x{k % 3}><section><p>{line}</p></section><div><p>story {j} {k}</p></div></div></body>"

    pages = [(1000 * j + k, f"http://h{j}/", page(j, k)) for j in range(6) for k in [*range(120), 7]]
    got = _texts_of(spark, pages)
    for j in range(6):
        assert got[1000 * j + 7] == f"the usual line\nstory {j} 7" and got[1000 * j + 20] == f"edition 20\nstory {j} 20"
