"""Substring dedup by automata of repeated phrases.

A phrase is 13 consecutive words; a word goes if a phrase around it also starts in a document with a
smaller id. Three steps, none of which brings documents together in pairs:

* Recur. The least of the seven seven-word runs in a phrase is its seed, the same wherever the phrase
  stands. Seeds of at least two documents are found by one aggregate; only phrases with such a seed can
  recur. A seed's first document decides the shard of its phrases, so a copied passage goes to one shard in one piece.
* Confirm. Phrases of these passages are counted by document. Those of several documents are confirmed,
  and the passages made of them are taken from the first document that has them.
* Locate. Each shard compiles its passages' phrases to Aho-Corasick automata of bounded size and
  streams the passages of all documents through them; every occurrence in a later document
  removes its words. A shard with many words is dealt to several tasks, each with the automata.

Documents without a recurring seed are finished in the first step. Words are equal by 64-bit hashes.

Defined cases: null and empty texts have no words; a null id comes after all others and removes
nothing elsewhere; rows that share an id do not remove from each other; repeated rows are each returned;
further columns travel in ``doc``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetscope.llm.common import U64, WHITE, carried, chunks, hash_spans, mix, signed, small_batches, store, table, text_buffers, windows, word_spans

PHRASE = 13
SEED = 7
# Phrases that follow each other with one seed are handed on together, at most so many.
TOGETHER = 16
# Words of a shard on average, of a task at most (or one text), and of the passages in one automaton.
SHARD_WORDS = 1 << 18
TASK_WORDS = 1 << 20
AUTOMATON_WORDS = 1 << 16
# Shards at least, so that a small table is still spread.
LEAST_SHARDS = 24
LAST_ID = (1 << 63) - 1


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, starts and ends of words, words of each text, and word hashes."""
    data, offsets = text_buffers(texts)
    starts, ends, counts = word_spans(data, offsets, WHITE)
    return data, offsets, starts, ends, counts, hash_spans(data, starts, ends)


def seeds(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seed, text, first phrase and number of phrases of each run of phrases with one seed."""
    first_word = np.concatenate([[0], np.cumsum(counts)])
    n = len(words) - PHRASE + 1
    if n <= 0:
        return np.zeros(0, U64), *(np.zeros(0, np.int64),) * 3
    runs = windows(words, SEED)
    around = np.lib.stride_tricks.sliding_window_view(runs, PHRASE - SEED + 1)
    seed = around.min(1)
    text = np.repeat(np.arange(len(counts)), counts)
    inside = text[:n] == text[PHRASE - 1:]
    at = np.flatnonzero(inside)
    seed, text = seed[at], text[at]
    new = np.ones(len(at), bool)
    new[1:] = (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    # Cut runs that are too long to be handed on in one.
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    begin = np.flatnonzero(new | (place % TOGETHER == 0))
    size = np.diff(np.append(begin, len(at)))
    return seed[begin], text[begin], at[begin] - first_word[text[begin]], size


def _seed_rows(rows: DataFrame, schema: str, row_column: bool) -> DataFrame:
    """(m, doc) or (m, row, at) of every seed; ``at`` holds the first phrase and how many follow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                *_, counts, words = _words(part.column(1))
                seed, text, first, size = seeds(words, counts)
                made = {"m": pa.array(signed(seed)), "row" if row_column else "doc": part.column(0).take(pa.array(text))}
                if row_column:
                    made["at"] = pa.array(first * TOGETHER + size - 1)
                yield pa.RecordBatch.from_pydict(made)

    return rows.mapInArrow(run, schema)


def recurring(texts: DataFrame) -> DataFrame:
    """(row, runs): where the texts (doc, row, text) hold seeds of at least two documents, and the seed's first document."""
    found = (_seed_rows(texts.select("doc", "text"), "m bigint, doc bigint", False).groupBy("m")
             .agg(F.min("doc").alias("home"), F.max("doc").alias("last")).where("home < last").drop("last"))
    known = store(found, "phrases-seeds")
    places = _seed_rows(texts.select("row", "text"), "m bigint, row bigint, at bigint", True)
    # Rows repeated as a whole share their key, and their places.
    return (places.join(known, "m").groupBy("row").agg(F.collect_set(F.struct("at", "home")).alias("runs"), F.sum(F.col("at") % TOGETHER + 1).alias("n")))


_SHARE = "array<struct<shard:int,starts:binary,sizes:binary,words:binary>>"


def _shares(at: np.ndarray, home: np.ndarray, words: np.ndarray, shards: int) -> list[dict]:
    """The passages of one text by shard: first word and number of words of each, and the words."""
    shard = (mix(home.view(U64)) % U64(shards)).astype(np.int64)
    order = np.lexsort((at, shard))
    at, shard = at[order], shard[order]
    first = at // TOGETHER
    end = first + at % TOGETHER + 1
    new = np.ones(len(at), bool)
    new[1:] = (shard[1:] != shard[:-1]) | (first[1:] > end[:-1])
    begin = np.flatnonzero(new)
    starts, ends, owner = first[begin], end[np.append(begin[1:], len(at)) - 1] + PHRASE - 1, shard[begin]
    out = []
    for s in np.unique(owner):
        mine = owner == s
        a, b = starts[mine], ends[mine]
        out.append({"shard": int(s), "starts": a.astype(np.int64).tobytes(), "sizes": (b - a).astype(np.int64).tobytes(),
                    "words": np.concatenate([words[i:j] for i, j in zip(a, b, strict=True)]).tobytes()})
    return out


def _kept(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, stay: np.ndarray) -> list[bytes]:
    """The words of each text that stay, joined by one space."""
    text = np.repeat(np.arange(len(counts)), counts)[stay]
    a, b = starts[stay], ends[stay].copy()
    # Every word but a text's last takes the byte behind it along, as the space.
    follows = np.zeros(len(b), bool)
    follows[:-1] = text[1:] == text[:-1]
    b[follows] += 1
    step = np.zeros(len(data) + 2, np.int8)
    # No two words begin or end at one place.
    step[a] += 1
    step[b] -= 1
    mask = np.cumsum(step[:len(data)], dtype=np.int8) > 0
    spaced = np.where(WHITE[data], np.uint8(0x20), data)[mask]
    cut = np.concatenate([[0], np.cumsum(mask)])[offsets]
    return [spaced[cut[i]:cut[i + 1]].tobytes() for i in range(len(counts))]


def _split(texts: DataFrame, shards: int, with_text: bool) -> DataFrame:
    """Texts with recurring seeds get their passages (``shares``), the others their result."""
    names = ["doc", "id", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 3):
                data, offsets, starts, ends, counts, words = _words(part.column(3))
                first = np.concatenate([[0], np.cumsum(counts)])
                runs = part.column(4)
                at, home = (pc.struct_field(runs.flatten(), n).to_numpy() for n in ("at", "home"))
                cut = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(runs), 0).to_numpy())])
                shares = [_shares(at[a:b], home[a:b], words[first[i]:first[i + 1]], shards) if known else None
                          for i, (known, a, b) in enumerate(zip(runs.is_valid().to_pylist(), cut[:-1], cut[1:], strict=True))]
                whole = _kept(data, offsets, starts, ends, counts, np.ones(len(starts), bool))
                out = {"n_words": pa.array(counts, pa.int64()), "shares": pa.array(shares, pa.list_(pa.struct(
                    [("shard", pa.int32()), ("starts", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary())]))),
                    "kept_sha256": pa.array([hashlib.sha256(w).hexdigest() if s is None else None for w, s in zip(whole, shares, strict=True)], pa.string()),
                    # What remains to be cut, or what is finished, if it is wanted.
                    "text": pa.array([w.decode() if s is not None or with_text else None for w, s in zip(whole, shares, strict=True)], pa.string())}
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *out.values()], names=[*names, *out])

    rows = texts.select(*names, "text", "runs")
    fields = [rows.schema[n] for n in names] + StructType.fromDDL(f"n_words bigint, shares {_SHARE}, kept_sha256 string, text string").fields
    return rows.mapInArrow(run, StructType(fields))


def _share_arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["starts"], np.int64), np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["words"], U64)


def _phrases_of(sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the phrases of some passages, and the word at which each begins."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    hashes = windows(words, PHRASE)
    at = np.flatnonzero(owner[:len(hashes)] == owner[PHRASE - 1:])
    return hashes[at], at


def confirmed(shares: DataFrame) -> DataFrame:
    """(shard, doc, phrases): the phrases of several documents, with the first of these."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.frombuffer(x, np.int64) for x in batch.column("sizes").to_pylist()]
            words = [np.frombuffer(x, U64) for x in batch.column("words").to_pylist()]
            if not words:
                continue
            hashes, at = _phrases_of(np.concatenate(sizes), np.concatenate(words))
            row = pa.array(np.searchsorted(np.cumsum([len(w) for w in words]), at, "right"))
            yield pa.RecordBatch.from_pydict({"shard": batch.column("shard").take(row), "phrase": pa.array(signed(hashes)), "doc": batch.column("id").take(row)})

    rows = shares.select("shard", "id", "sizes", "words").mapInArrow(run, "shard int, phrase bigint, doc bigint")
    counted = rows.groupBy("shard", "phrase").agg(F.min("doc").alias("doc"), F.max("doc").alias("last")).where("doc < last")
    return counted.groupBy("shard", "doc").agg(F.collect_list("phrase").alias("phrases"))


def passages(shares: DataFrame, phrases: DataFrame) -> DataFrame:
    """(shard, doc, sizes, words): the maximal passages of confirmed phrases in the first document that has them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"shard": [], "doc": [], "sizes": [], "words": []}
            for r in batch.to_pylist():
                _, sizes, words = _share_arrays(r)
                hashes, at = _phrases_of(sizes, words)
                stay = at[np.isin(hashes, np.array(r["phrases"], np.int64).view(U64))]
                if len(stay):
                    begin = np.flatnonzero(np.concatenate([[True], np.diff(stay) != 1]))
                    a, b = stay[begin], stay[np.append(begin[1:], len(stay)) - 1] + PHRASE
                    cut = np.concatenate([words[i:j] for i, j in zip(a, b, strict=True)])
                    for name, value in zip(out, (r["shard"], r["id"], (b - a).tobytes(), cut.tobytes()), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict({n: pa.array(v, t) for (n, v), t in zip(out.items(), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)})

    first = shares.join(phrases.withColumnRenamed("doc", "id"), ["shard", "id"])
    return first.select("shard", "id", "starts", "sizes", "words", "phrases").mapInArrow(run, "shard int, doc bigint, sizes binary, words binary")


def _automata(found: list[dict]) -> Iterator[tuple[np.ndarray, ahocorasick.Automaton]]:
    """Vocabulary and automaton for passages of bounded size at a time; a phrase's value is its first document."""
    held, size = [], 0
    for r in [*found, None]:
        if held and (r is None or size >= AUTOMATON_WORDS):
            yield _automaton(held)
            held, size = [], 0
        if r is None:
            continue
        words, at = np.frombuffer(r["words"], U64), 0
        for n in np.frombuffer(r["sizes"], np.int64):
            # A passage longer than an automaton goes into several, which overlap by a phrase.
            for first in range(0, max(1, n - PHRASE + 1), AUTOMATON_WORDS):
                if held and size >= AUTOMATON_WORDS:
                    yield _automaton(held)
                    held, size = [], 0
                part = words[at + first:at + min(n, first + AUTOMATON_WORDS + PHRASE - 1)]
                held.append((r["doc"], part))
                size += len(part)
            at += n


def _automaton(held: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, ahocorasick.Automaton]:
    vocabulary = np.unique(np.concatenate([w for _, w in held]))
    automaton = ahocorasick.Automaton()
    letters, at = _letters(vocabulary, np.concatenate([w for _, w in held])), 0
    for doc, words in held:
        for k in range(at, at + 2 * (len(words) - PHRASE + 1), 2):
            automaton.add_word(letters[k:k + 2 * PHRASE], doc)
        at += 2 * len(words)
    automaton.make_automaton()
    return vocabulary, automaton


def _letters(vocabulary: np.ndarray, words: np.ndarray) -> str:
    """Two characters a word, of different alphabets; words outside the vocabulary, as separators, are twice character 1.

    An automaton searches the arcs of a state one by one, so both alphabets have as few letters as the vocabulary allows.
    """
    size = math.isqrt(len(vocabulary)) + 1
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    known = vocabulary[at] == words
    codes = np.empty((len(words), 2), "<u4")
    codes[:, 0] = np.where(known, 2 + at // size, 1)
    codes[:, 1] = np.where(known, 2 + size + at % size, 1)
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def _locate(found: pa.Table, shares: pa.Table) -> pa.Table:
    """The words to remove from the texts of a task."""
    rows = shares.to_pylist()
    out: dict[str, list] = {"row": [], "starts": [], "ends": []}
    parts = [_share_arrays(r) for r in rows]
    if parts and found.num_rows:
        sizes = np.concatenate([p[1] for p in parts])
        words = np.concatenate([p[2] for p in parts])
        place = np.concatenate([np.repeat(s - np.concatenate([[0], np.cumsum(n)[:-1]]), n) for s, n, _ in parts]) + np.concatenate([np.arange(len(p[2])) for p in parts])
        row = np.repeat(np.arange(len(parts)), [len(p[2]) for p in parts])
        ids = np.array([r["id"] for r in rows], np.int64)[row]
        # A separator stands behind every passage.
        stream = np.insert(words, np.cumsum(sizes), U64(0))
        origin = np.insert(np.arange(len(words)), np.cumsum(sizes), -1)
        cover = np.zeros(len(words) + 1, np.int64)
        for vocabulary, automaton in _automata(found.to_pylist()):
            hits = np.fromiter(chain.from_iterable(automaton.iter(_letters(vocabulary, stream))), np.int64).reshape(-1, 2)
            end, first = origin[hits[:, 0] // 2], hits[:, 1]
            end = end[first < ids[end]]
            np.add.at(cover, end - PHRASE + 1, 1)
            np.add.at(cover, end + 1, -1)
        gone = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        if len(gone):
            new = np.flatnonzero(np.concatenate([[True], (np.diff(gone) != 1) | (row[gone[1:]] != row[gone[:-1]]) | (place[gone[1:]] != place[gone[:-1]] + 1)]))
            last = gone[np.append(new[1:], len(gone)) - 1]
            for a, b in zip(gone[new], last, strict=True):
                out["row"].append(rows[row[a]]["row"])
                out["starts"].append(int(place[a]))
                out["ends"].append(int(place[b]) + 1)
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})


def _finished(rows: DataFrame, with_text: bool) -> DataFrame:
    """Texts without the words of their ``spans``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                data, offsets = text_buffers(part.column(1))
                starts, ends, counts = word_spans(data, offsets, WHITE)
                first = np.concatenate([[0], np.cumsum(counts)])
                gone = np.zeros(len(starts), bool)
                merged = []
                for i, spans in enumerate(part.column(2).to_pylist()):
                    mine = gone[first[i]:first[i + 1]]
                    for s in spans or ():
                        mine[s["start"]:s["end"]] = True
                    edge = np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))
                    merged.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
                kept = _kept(data, offsets, starts, ends, counts, ~gone)
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
                yield pa.RecordBatch.from_pydict({
                    "doc": part.column(0), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                    "spans": pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    "kept_text": pa.array([k.decode() if with_text else None for k in kept], pa.string())})

    return rows.mapInArrow(run, StructType([rows.schema["doc"], *StructType.fromDDL(_RESULT).fields]))


_RESULT = "n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string, kept_text string"


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """``doc`` (the carried columns), ``n_words``, ``n_removed``, the removed ``spans`` of words, and digest and text (if wanted) of the words that stay."""
    small_batches(docs.sparkSession)
    words = F.col(f"`{text}`").cast("string")
    name = F.col(f"`{doc_id}`").cast("bigint")
    texts = docs.select(carried(docs, carry), F.coalesce(name, F.lit(LAST_ID)).alias("id"), F.xxhash64(name, F.coalesce(words, F.lit(""))).alias("row"), words.alias("text"))
    runs = store(recurring(texts.select(F.col("id").alias("doc"), "row", "text")), "phrases-runs")
    total = runs.agg(F.sum("n")).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-total // SHARD_WORDS))
    split = store(_split(texts.join(runs.drop("n"), "row", "left"), shards, with_text), "phrases-texts")
    shares = split.where("shares IS NOT NULL").select("id", "row", F.explode("shares").alias("s")).select("id", "row", "s.*")
    found = store(passages(shares, confirmed(shares)), "phrases-passages")
    sizes = shares.groupBy("shard").agg(F.ceil(F.sum(F.length("words")) / (8 * TASK_WORDS)).cast("int").alias("parts"))
    dealt = shares.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int")).drop("parts")
    copies = found.join(sizes, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    located = copies.groupBy("shard", "part").cogroup(dealt.groupBy("shard", "part")).applyInArrow(_locate, "row bigint, starts bigint, ends bigint")
    spans = store(located.groupBy("row").agg(F.collect_set(F.struct(F.col("starts").alias("start"), F.col("ends").alias("end"))).alias("spans")), "phrases-spans")
    cut = _finished(split.where("shares IS NOT NULL").join(spans, "row", "left").select("doc", "text", "spans"), with_text)
    whole = split.where("shares IS NULL").select("doc", "n_words", F.lit(0).cast("bigint").alias("n_removed"),
                                                 F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), "kept_sha256", F.col("text").alias("kept_text"))
    return whole.unionByName(cut)


def op12_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    found = without_repeats(table(spark, sf_dir, "documents"), carry=["doc_id"], with_text=False)
    return found.select("doc.doc_id", "n_words", "n_removed", "kept_sha256")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
phrase AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS p FROM d, unnest(range(1, greatest(1, len(w) - 11))) AS t(i)),
origin AS (SELECT p, min(doc_id) AS origin FROM phrase GROUP BY p),
gone AS (SELECT DISTINCT doc_id, j FROM phrase JOIN origin USING (p), unnest(range(i, i + 13)) AS t(j) WHERE origin < doc_id),
removed AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(w[j], ' ' ORDER BY j) AS k FROM d, unnest(range(1, len(w) + 1)) AS t(j)
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = d.doc_id AND g.j = t.j) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
