"""The dealt operators over the given tables, against plain versions."""

import hashlib
import math
import os
import re
from collections import Counter

import pytest
from brute import WHITE, FOLD, article, base_licences, base_secrets, classes, crc, hits, line_measures

import __spark_entry__ as contract


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def model_dir(sf_dir):
    """A size with enough text to learn from, where there is one."""
    larger = sf_dir.replace("sf0.001", "sf0.01")
    return larger if os.path.isdir(larger) else sf_dir


def rows(spark, sf_dir, name, key="doc_id"):
    got = contract.queries()[name](spark, sf_dir).collect()
    out = {r[key]: r for r in got}
    assert len(out) == len(got)
    return out


def test_language_id(spark, sf_dir, texts):
    got = rows(spark, sf_dir, "op1_language_id")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    assert set(got) == set(texts)
    held = [i for i in got if got[i].held_out]
    assert set(held) == {i for i in texts if crc(i) % 3 == 1}
    assert sum(got[i].lang_pred == lang[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_bpe_is_the_library(spark, sf_dir, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(spark, sf_dir, "op2_bpe")
    for i, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert got[i].decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_near_duplicates(spark, sf_dir, texts):
    got = rows(spark, sf_dir, "op3_setsketch")
    want = classes(texts.items())
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) for i, r in got.items())


def test_main_text(spark, sf_dir):
    got = rows(spark, sf_dir, "op4_html_wrapper", "page_id")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == article(p.html)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def test_decontamination(spark, sf_dir, texts):
    got = rows(spark, sf_dir, "op5_decontamination")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for i, text in texts.items():
        n, hit, found = hits(text, items)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) == (n, hit, len(found), sha(",".join(found)))
        assert got[i].contaminated == (hit > 0)


def test_licences(spark, sf_dir, texts):
    got = rows(spark, sf_dir, "op6_license_rules")
    for i, text in texts.items():
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_licences(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert r.labels == ",".join(sorted(r.labels.split(","))) and 0 <= r.score <= 1


def test_language_model(spark, sf_dir, texts):
    got = rows(spark, sf_dir, "op7_context_mixing")
    tokens = {i: [*WHITE.findall((t or "").translate(FOLD)), None] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if crc(i) % 7 != 2 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i) % 7 == 2, len(ws), sum(counts[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0 and r.bits_per_byte < 8


def test_language_model_predicts_held_out_text(spark, model_dir):
    held = [r for r in rows(spark, model_dir, "op7_context_mixing").values() if r.held_out]
    assert sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held)  # the base does not spell words it does not know
    assert sum(r.bits_per_byte for r in held) < 2.6 * len(held)  # single bytes by their frequency take 4.4


def test_quality(spark, model_dir):
    got = rows(spark, model_dir, "op8_quality_gam")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{model_dir}/labels.parquet").collect()}
    held = [i for i in labels if got[i].held_out]
    assert {i for i in got if got[i].held_out} == {i for i in got if crc(i) % 5 == 0}
    assert sum(got[i].predicted == labels[i] for i in held) >= 0.9 * len(held)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_secrets(spark, sf_dir, texts):
    got = rows(spark, sf_dir, "op9_secret_scan")
    for i, text in texts.items():
        base = base_secrets(text)
        spans = [f"{k}:{a}:{b}" for k, a, b in base]
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex")]
        assert got[i].base_sha256 == sha(",".join(spans)) and set(spans) <= set(got[i].spans.split(",") if got[i].spans else [])


def test_line_rules(spark, sf_dir, texts):
    got = rows(spark, sf_dir, "op10_line_rules")
    for i, text in texts.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == line_measures(text)
        assert not (r.kept and r.base_failed)


def test_pipeline(spark, sf_dir, texts):
    got = rows(spark, sf_dir, "pipeline")
    good = {i for i, t in texts.items() if not line_measures(t)[5]}
    assert set(got) <= good
    # One document of each class among those the first stage kept stays, unless it is nothing but benchmark.
    first = {r.doc_id for r in contract.queries()["op10_line_rules"](spark, sf_dir).where("kept").collect()}
    leaders = set(classes([(i, texts[i]) for i in first]).values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(got) == {i for i in leaders if hits(texts[i], items)[1] < max(hits(texts[i], items)[0], 1)}
    for i, r in got.items():
        assert not base_secrets(r.text) and r.n_tokens == len(r.ids)
        if hits(texts[i], items)[1] == 0 and not base_secrets(texts[i]):
            assert r.text == texts[i]
        else:
            assert r.n_chars == len(r.text)
    assert not any(re.search(r"AKIA[A-Z0-9]{12}", r.text) for r in got.values())
