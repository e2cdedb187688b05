"""Spelling variants, repeated phrases and hard negatives against plain versions, and their defined cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from brute import FOLD, WHITE
from pyspark.sql import functions as F

import __spark_entry__ as contract
from fleetscope.llm.op11_spelling import RUN, near_words, slipped, spelling_variants, word_counts
from fleetscope.llm.op12_repeated_phrases import without_repeats
from fleetscope.llm.op13_hard_negatives import hard_negatives, quantised, spanning_tree
from fleetscope.llm.word_acceptor import Acceptors, one_edit_pairs


def plain_counts(rows):
    total = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            word = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            total[word if h % 199 else word[:h % len(word)] + word[h % len(word) + 1:]] += 1
    return total


def plain_variants(total):
    n = {w: k for w, k in total.items() if len(w) >= 6 and k >= 5}
    shortened = {}
    for w in n:
        for k in range(len(w)):
            shortened.setdefault((k, w[:k] + w[k + 1:]), set()).add(w)
    near = {w: set() for w in n}
    for (_, rest), group in shortened.items():
        for w in group:
            near[w] |= group - {w}
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def variants(df):
    got = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}
    assert len(out) == len(got)
    return out


def test_spelling_over_all_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = plain_variants(plain_counts(rows))
    assert sum(v[0] is not None for v in want.values()) > 0
    assert variants(contract.queries()["op11_spelling"](spark, sf_dir)) == want


@pytest.mark.parametrize("most", [3, 40])
def test_spelling_with_small_partitions(spark, most):
    """Words of few letters with one beginning, so that partitions must be cut again, down to one open letter."""
    made = random.Random(3)
    total = Counter({"common" + "".join(made.choices("abcé", k=made.randint(1, 6))): made.randint(5, 4000) for _ in range(400)})
    counts = spark.createDataFrame(list(total.items()), "word string, n bigint")
    assert variants(spelling_variants(counts, most=most)) == plain_variants(total)


def test_spelling_cases(spark):
    long_text = " ".join(f"langes wort{'x' * (k % 7)}" for k in range(300_000))
    rows = [(1, "Grösse grösse GRÖSSE"), (1, "Grösse grösse GRÖSSE"), (None, None), (2, ""), (None, "groesse-Groesse"), (3, long_text), (4, "ÿÿÿÿÿÿ " * 5)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, word string, n int")
    got = {r.word: r.n for r in word_counts(docs, change=slipped).collect()}
    assert got == dict(plain_counts(rows))
    assert variants(spelling_variants(word_counts(docs, change=slipped))) == plain_variants(plain_counts(rows))
    assert spelling_variants(word_counts(docs.limit(0))).count() == 0
    huge = "q" * 200_000
    words = spark.createDataFrame([(huge, 5), (huge + "r", 30)], "word string, n bigint")
    assert {(r.near_n, r.n) for r in near_words(words).collect()} == {(30, 5)}


def test_acceptor_is_minimal():
    accept = Acceptors()
    accept.add(sorted(["tap", "taps", "top", "tops"]))
    # The states after "ta" and "to" are one: four letters and the start, and the state that accepts nothing.
    assert len(accept.next) == 6
    assert sorted(one_edit_pairs(["abc", "abd", "bbc"], ["abcd", "xabc"], 0, True)) == [
        ("abc", "abcd"), ("abc", "abd"), ("abc", "bbc"), ("abc", "xabc"), ("abd", "abcd")]


def plain_repeats(rows):
    words = [(i, WHITE.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k:k + 13])
            first[key] = min(first.get(key, math.inf), math.inf if i is None else i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k:k + 13])] < (math.inf if i is None else i):
                gone[k:k + 13] = [True] * 13
        kept = " ".join(x for x, y in zip(w, gone, strict=True) if not y)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def repeats(df):
    return Counter(tuple(r) for r in df.select("doc.doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_repeats_over_all_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in contract.queries()["op12_repeated_phrases"](spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == plain_repeats(rows)


def test_repeat_cases(spark):
    made = random.Random(5)
    passage = [f"p{k}" for k in range(40)]
    rows = [(None, None), (1, ""), (2, " \n "), (3, " ".join(passage[:12])), (4, " ".join(passage[:13])), (4, " ".join(passage)),
            (5, "a  b\t" + "\n".join(passage) + " c"), (5, "a  b\t" + "\n".join(passage) + " c"), (None, " ".join(passage[5:30])), (0, " ".join(passage[20:33])),
            (6, "x " * 40), (7, "x " * 14), (8, " ".join([*passage[:20], "é漢", *passage[20:]])), (9, " ".join(f"w{k}" for k in range(150_000))),
            (10, " ".join(f"w{k}" for k in range(149_000, 1, -1))), (11, " ".join(f"w{k}" for k in range(70_000, 150_000)))]
    for i in range(12, 60):
        words = []
        for _ in range(made.randint(1, 5)):
            at = made.randint(0, 30)
            words += passage[at:at + made.randint(5, 20)] + ["y"] * made.randint(0, 2)
        rows.append((i, " ".join(words)))
    clash = ["row", "id", "runs", "shares", "shard", "part", "spans", "doc", "m", "at"]
    docs = spark.createDataFrame([(*r, *clash) for r in rows], "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in clash))
    out = without_repeats(docs)
    assert out.select("doc.*").schema == docs.schema
    assert repeats(out) == plain_repeats(rows)
    for r in out.collect():
        kept = [w for k, w in enumerate(WHITE.findall(r.doc.text or "")) if not any(s.start <= k < s.end for s in r.spans)]
        assert r.kept_text == " ".join(kept)
    assert without_repeats(docs.limit(0)).count() == 0


def plain_negatives(rows, step):
    vectors = {}
    for i, vec, label in rows:
        if i is None or vec is None or label is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        new = (label, [math.floor(256 * x) for x in vec])
        vectors[i] = min(vectors.get(i, new), new)
    out = set()
    for a, (label, mine) in vectors.items():
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(mine, v, strict=False)), i, other) for i, (other, v) in vectors.items() if i != a)
        for s, i, _ in [t for t in scored if t[2] == label][:5]:
            hard = [t for t in scored if t[2] != label and 80 * s >= 100 * t[0] >= 100 * s][:5]
            out |= {(a, i, k + 1, t[1], -s, -t[0]) for k, t in enumerate(hard)}
    return out


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def negatives(df):
    got = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(set(got)) == len(got)
    return set(got)


def test_negatives_of_clusters(spark):
    """Vectors near few centres, many of them equal: bounds let rows be passed over, and ties abound."""
    made = random.Random(9)
    centres = [[made.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(3000):
        centre = made.choice(centres)
        rows.append((i, [c + made.choice([0, 0, 0.01, 0.2]) * made.gauss(0, 1) for c in centre], made.randint(0, 3)))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = negatives(hard_negatives(quantised(df), F.col("vec_id") % 20 == 0))
    assert got == plain_negatives(rows, 20) and len(got) > 1000


def test_negative_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.9, 0.4], 2), (2, [0.9, 0.4], 2), (3, [0.9, 0.4], 2), (4, [nan, 1.0], 1), (5, [inf, 1.0], 2), (6, None, 1),
            (7, [None, 1.0], 1), (8, [1.0, 0.4], None), (None, [1.0, 1.0], 1), (9, [1.0], 2), (10, [], 2), (11, [-1.0, -1.0], 1), (12, [1.0, 0.5, 3.0], 2), (100, [0.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, first string, n int")
    assert negatives(hard_negatives(quantised(df), F.col("vec_id") % 100 == 0)) == plain_negatives(rows, 100)
    large = spark.createDataFrame([(0, [2.0 ** 20] * 8, 1), (1, [2.0 ** 20 - 1] * 8, 1), (2, [2.0 ** 20 - 2] * 8, 2), (3, [1e30], 2)], "vec_id bigint, embedding array<double>, label int")
    rest = [tuple(r) for r in large.where("vec_id < 3").collect()]
    assert negatives(hard_negatives(quantised(large), F.col("vec_id") == 0)) == plain_negatives(rest, 100)
    assert hard_negatives(quantised(df.limit(0)), F.col("vec_id") % 100 == 0).columns == COLUMNS
    assert hard_negatives(quantised(df), F.col("vec_id") == -1).count() == 0


def test_tree_spans_with_least_edges():
    import numpy as np

    order, parent, edge = spanning_tree(np.array([[0], [10], [1], [12], [3]]))
    assert parent[order[0]] == -1 and sorted(order) == list(range(5))
    assert sorted(edge) == [0, 1, 2, 2, 7]


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Links that are stars already are stored once; other graphs get the least node each can reach."""
    from fleetscope.llm import graph

    stored = []
    monkeypatch.setattr(graph, "store", lambda df, name, keep=graph.store: stored.append(name) or keep(df, name))
    stars = spark.createDataFrame([(1, 5), (7, 1), (2, 2), (3, 9), (9, 3)], "a bigint, b bigint")
    assert sorted(map(tuple, graph.components(stars).collect())) == [(1, 1), (3, 3), (5, 1), (7, 1), (9, 3)]
    assert len(stored) == 1
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(20)]
    least = {n: n for link in links for n in link}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {n: c for n, c in least.items() if n in got} and all(c == n for n, c in least.items() if n not in got)


def test_passages_of_a_text_by_shard():
    """Runs of phrases that touch within a shard are one passage; the places come as numbers, not as rows."""
    import numpy as np

    from fleetscope.llm import op12_repeated_phrases as phrases

    words = np.arange(1000, 1100, dtype=np.uint64)
    runs = [(0, 3), (3, 2), (40, 1), (60, 16)]
    at = np.array([first * phrases.TOGETHER + n - 1 for first, n in reversed(runs)], np.int64)
    (got,) = phrases._shares(at, np.full(4, 7, np.int64), words, 1)
    starts, sizes, held = phrases._share_arrays(got)
    assert starts.tolist() == [0, 40, 60] and sizes.tolist() == [17, 13, 28]
    assert held.tolist() == [*words[:17].tolist(), *words[40:53].tolist(), *words[60:88].tolist()]


def test_pieces_are_merged_together_as_one_by_one():
    """Rows of pieces give the ids of the single merges, whatever their length; ASCII texts are cut as others are."""
    import public_tokenizers
    import regex

    from fleetscope.llm import byte_bpe

    vocabulary = byte_bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    single = {divmod(k, 1 << 32): divmod(v, 1 << 32) for k, v in zip(vocabulary.pairs.tolist(), vocabulary.made.tolist(), strict=True)}
    rng = random.Random(3)
    pieces = [bytes(rng.choices(rng.choice([range(256), range(97, 123), b"ab e"]), k=rng.randrange(60))) for _ in range(2000)]
    assert byte_bpe.Merger(vocabulary)(pieces) == [byte_bpe.merge([vocabulary.byte_ids[b] for b in p], single) for p in pieces]
    cut = regex.compile(byte_bpe.PIECES)
    for _ in range(2000):
        text = "".join(rng.choices([chr(k) for k in range(128)] if rng.random() < 0.5 else list(" \n\t'sdmlrev ab1.\x1c\x0b"), k=rng.randrange(30)))
        assert regex.findall(byte_bpe.ASCII_PIECES, text) == cut.findall(text)
