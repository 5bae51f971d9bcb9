"""The pipeline's stages on small tables."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_text_operators import brute_groups, frame
from tierwise.llm import language_id, packing
from tierwise.llm.common import stored
from tierwise.llm.decontamination import Index, normalised


def test_stages_keep_the_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, data))
        assert docs.columns == columns
        n.append(docs.count())
    assert n[1] >= 0.98 * n[0] and n[2] < n[1] and n[3] < n[2] and n[4] == n[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert packed.select("doc_id").distinct().count() == n[4]
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0


def within(part: bytes, edits: int, raw: bytes) -> np.ndarray:
    """Where in raw a stretch ends that is at most so many edits from part: the whole table of edit distances, a row at a time."""
    data = np.frombuffer(raw, np.uint8)
    place = np.arange(len(data) + 1)
    row = np.zeros(len(data) + 1, np.int64)
    for i, c in enumerate(part, 1):
        best = np.append(i, np.minimum(row[:-1] + (data != c), row[1:] + 1))
        row = np.minimum.accumulate(best - place) + place
    return np.flatnonzero(row <= edits)


def test_run_by_brute_force(spark, data):
    """What run() returns of whole tables, against each stage done plainly on what the one before left."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = language_id.train(docs)
    least = corpus_pipeline.least_score(len(model.languages))
    rows = [r for r in language_id.identify(docs, model, "text", "found", "sure").collect() if re.search(r"[^\W\d_]", r.text or "") and r.sure >= least]
    assert len(rows) >= 0.98 * docs.count()
    # near copies: the smallest id of each group, groups by comparing all pairs of texts
    rows.sort(key=lambda r: r.doc_id)
    rows = [r for i, (r, (_, group)) in enumerate(zip(rows, brute_groups([r.text for r in rows], 5, 80, 100), strict=True)) if group == i]
    # benchmark passages: each segment against each text, all tables of edit distances in full
    items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect() if r.text is not None]
    index = Index(list(enumerate(items)))
    gap, raw, ends = b"\x00" * 16, b"", []
    for r in rows:
        own = np.frombuffer(r.text.encode(), np.uint8)
        raw += normalised(own, np.array([0, len(own)]))[0].tobytes() + gap
        ends.append(len(raw))
    leaky = set()
    for part, edits in zip(index.text, index.edits, strict=True):
        assert edits < len(gap)
        leaky |= set(np.searchsorted(ends, within(part, edits, raw)).tolist())
    clean = [r for i, r in enumerate(rows) if i not in leaky]
    assert 0 < len(clean) < len(rows)
    # secrets: the stage's own texts, which differ from these by marks in place of runs without white space
    small = docs.where(docs.doc_id.isin([r.doc_id for r in clean]))
    texts = {r.doc_id: r.text for r in corpus_pipeline.without_secrets(spark, small, data).collect()}
    assert sorted(texts) == sorted(r.doc_id for r in clean)
    for r in clean:
        parts = texts[r.doc_id].split("[SECRET]")
        assert re.fullmatch(r"\S+".join(map(re.escape, parts)), r.text) if len(parts) > 1 else texts[r.doc_id] == r.text
    # pieces: ids by the tokenizer library; places without gaps in sequences that are not too long
    tokenizer = packing.WordIds(packing.vocabulary_path(packing.VOCABULARY)).tokenizer
    expected = set()
    for doc_id, text in texts.items():
        own = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        expected |= {(doc_id, k, a, len(own[a : a + 2048]), zlib.crc32(np.array(own[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(own), 2048))}
    got = corpus_pipeline.run(spark, data).collect()
    assert len(got) == len(expected) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == expected
    held: dict = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        places.sort()
        assert [a for a, _ in places] == [0, *np.cumsum([n for _, n in places]).tolist()[:-1]] and sum(n for _, n in places) <= 2048


def test_odd_documents(spark, data):
    docs = frame(spark, [None, "", "a b c d e f g", "a b c d e f g", "a b c d e f g", "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" q", None], [1, 2, 3, 3, 4, None, 5])
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, out, data))
    rows = {(r.doc_id, r.text) for r in out.collect()}
    assert rows == {(3, "a b c d e f g"), (None, 'token = "[SECRET]" q')}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stored(stage(spark, empty, data))
    assert empty.count() == 0


def test_language_gate(spark, data):
    """Uncertain texts go with two and three languages too, letterless ones also when nothing was learned."""
    unlabelled = frame(spark, [None, "", "123 !!", "kalo mita", "kalo mita"], [1, 2, 3, 4, None], None)
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.identified(spark, unlabelled, data).collect()), key=repr) == [(4, "kalo mita"), (None, "kalo mita")]
    words = {"aa": "kalo mita", "bb": "sün ßer", "cc": "quelos ção"}
    for n in (2, 3):
        langs = list(words)[:n]
        docs = frame(spark, [words[x] for x in langs for _ in range(20)]).drop("lang").join(spark.createDataFrame([(i, langs[i // 20]) for i in range(20 * n)], "doc_id long, lang string"), "doc_id")
        odd = frame(spark, ["zzzz"], [1000], None).select(docs.columns)
        got = {r.doc_id for r in corpus_pipeline.identified(spark, docs.unionByName(odd), data).collect()}
        assert got == set(range(20 * n))
    assert corpus_pipeline.least_score(4) == pytest.approx(corpus_pipeline.LEAST_SCORE) and corpus_pipeline.least_score(1) == 1
