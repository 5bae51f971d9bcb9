"""Substring dedup by relative Lempel-Ziv parsing against blocks of the whole corpus.

Texts are cut into overlapping reference blocks whose borders depend on content alone: each window of
``window`` words is led by its smallest ``SEED``-word seed, and a block is what the successive windows led by one
seed cover. All blocks of the corpus are the reference index, keyed by seed and block; nothing is sampled. The
first place of a block (the least, in a fixed order of texts) is its reference.

* Each text is factored greedily, from left to right: a factor begins with a block that the index has at another
  place too, and goes on as long as the next block's reference is where the factor's reference goes on. So a
  factor is the longest run of blocks copied from one place, and at least a window long.
* A factor begins or ends inside a block where a seed occurs in different blocks (an edit, the border of a copied
  passage, the end of a text). There the windows are checked one by one: those that occur again become factors of
  one window. One emission for each distinct block, not for each copy.

A block found again whole has all its windows found again, and a window found again in differing blocks is checked,
so the spans are exactly the windows that occur twice. Blocks and windows are compared by 128 bits: their own
hash and that of their seed. The place where a block occurs again is known by its hash, so no text meets another text; rows
shuffled are about one for twelve words, and groups of copies of any size meet only in counts with partial
aggregation and in joins whose other side is a table with one row for each key, which Spark can split.

Defined results: a null or empty text has no words; texts shorter than the window lose nothing;
repeated rows are copies of each other (every row is judged and returned, also with a null id);
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwise.llm.common import discard, map_arrow, schema_of, stored, table, text_rows, text_tag
from tierwise.llm.wordhash import Windows, Words, chunks, mix, sliding_min

WINDOW = 35
SEED = 12
FULL, FINE = 1, 2
_POS_BITS = np.uint64(28)


def blocks(data: np.ndarray, offs: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of a chunk of texts: text, first window (a word of the text), number of windows, seed hash, block hash."""
    words = Words(data, offs)
    win = Windows(words.hashes())
    n = len(words.starts)
    if n < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    of = np.repeat(np.arange(len(offs) - 1), np.diff(words.first))
    seeds = win.every(seed)
    order = (mix(seeds) >> _POS_BITS << _POS_BITS) | np.arange(len(seeds), dtype=np.uint64)
    lead = (sliding_min(order, window - seed + 1)[: n - window + 1] & ((np.uint64(1) << _POS_BITS) - np.uint64(1))).astype(np.int64)
    starts = np.arange(n - window + 1)
    inside = starts + window <= words.first[1:][of[: n - window + 1]]
    starts, lead = starts[inside], lead[inside]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    new = np.ones(len(starts), bool)
    new[1:] = (lead[1:] != lead[:-1]) | (of[starts[1:]] != of[starts[:-1]])
    head = np.flatnonzero(new)
    lo, count, lead = starts[head], np.diff(np.append(head, len(starts))), lead[head]
    whole = mix(win.at(lo, lo + count + window - 1) + (lead - lo).astype(np.uint64))
    return of[lo], lo - words.first[of[lo]], count, seeds[lead], whole


def reference_blocks(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """rows: doc_id, tag, text. One row for each block: doc_id, tag, lo, n, h (seed), e (block)."""
    schema = schema_of(rows, ["doc_id", "tag"], "lo int, n int, h bigint, e bigint")
    names = schema.names

    def run(batch: pa.RecordBatch):
        ids, tags = batch.column("doc_id"), batch.column("tag")
        for first, _, data, offs in chunks(batch.column("text")):
            of, lo, n, h, e = blocks(data, offs, window, seed)
            if len(of):
                at = pa.array(of + first)
                yield pa.RecordBatch.from_arrays([ids.take(at), tags.take(at), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(e.view(np.int64))], names=names)

    return map_arrow(rows, run, schema)


def _spans(batch: pa.RecordBatch, row: int) -> np.ndarray:
    """(lo, n, flag, h, place) rows of a joined list column; none for a null."""
    found = batch.column("spans")[row]
    if not found.is_valid or not len(found):
        return np.zeros((0, 5), np.int64)
    flat = found.values
    return np.stack([flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)


def _fine_windows(rows: DataFrame, window: int) -> DataFrame:
    """Windows of the blocks that stand for all equal ones where a seed has several blocks."""
    schema = schema_of(rows, ["doc_id", "tag"], "lo int, known boolean, h bigint, w bigint")
    names = schema.names

    def run(batch: pa.RecordBatch):
        ids, tags = batch.column("doc_id"), batch.column("tag")
        for first, end, data, offs in chunks(batch.column("text")):
            words = Words(data, offs)
            win = Windows(words.hashes())
            parts = []
            for row in range(first, end):
                spans = _spans(batch, row)
                spans = np.unique(spans[spans[:, 2] & FINE > 0], axis=0)
                if len(spans):
                    at = np.repeat(spans[:, 0], spans[:, 1]) + np.arange(spans[:, 1].sum()) - np.repeat(np.cumsum(spans[:, 1]) - spans[:, 1], spans[:, 1])
                    base = words.first[row - first]
                    parts.append((np.full(len(at), row), at, np.repeat(spans[:, 2] & FULL > 0, spans[:, 1]), np.repeat(spans[:, 3], spans[:, 1]), win.at(base + at, base + at + window)))
            if parts:
                of, lo, known, h, w = (np.concatenate(x) for x in zip(*parts, strict=True))
                of = pa.array(of)
                yield pa.RecordBatch.from_arrays([ids.take(of), tags.take(of), pa.array(lo.astype(np.int32)), pa.array(known), pa.array(h), pa.array(w.view(np.int64))], names=names)

    return map_arrow(rows, run, schema)


def _with_spans(rows: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """Null-safe on the id: rows without one keep their spans too. Repeated rows have one set of spans."""
    lists = spans.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("lo", "n", "flag", "h", "place")).alias("spans"))
    lists = lists.withColumnsRenamed({"doc_id": "span_id", "tag": "span_tag"})
    return rows.join(lists, rows.doc_id.eqNullSafe(lists.span_id) & (rows.tag == lists.span_tag), how).drop("span_id", "span_tag")


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """The copied blocks and windows of each text with their text: doc_id, tag, text, spans (array of first window, windows, flag, seed, reference).

    Words covered are lo .. lo + n + window - 2 for each span whose flag has the bit FULL.
    """
    spark, scratch = docs.sparkSession, []
    rows = text_rows(docs, id_col, text_col).withColumn("tag", text_tag())
    index = stored(reference_blocks(rows, window, seed), scratch)
    # a place is a number of the text and the position in it; the bits left out keep sums in range
    place = F.xxhash64("doc_id", "tag").bitwiseAND(F.lit(2**62 - 1)) + F.col("lo")
    again = index.groupBy("h").agg(F.count("*").alias("places"), (F.min("e") != F.max("e")).alias("mixed"), F.min(place).alias("place")).where("places > 1").select("h", "mixed", "place")
    found = stored(index.join(stored(again, scratch), "h"), scratch)
    mixed = found.where("mixed").drop("mixed", "place").withColumn("own", place)
    kinds = stored(mixed.groupBy("h", "e").agg(F.count("*").alias("copies"), F.min("own").alias("place")), scratch)
    flag = F.when(F.col("copies") > 1, FULL).otherwise(0) + F.when(F.col("own") == F.col("place"), FINE).otherwise(0)
    span = ["doc_id", "tag", "lo", "n", "flag", "h", "place"]
    judged = mixed.join(kinds, ["h", "e"]).withColumn("flag", flag).where("flag > 0").select(*span)
    coarse = stored(found.where("not mixed").withColumn("flag", F.lit(FULL)).select(*span).unionByName(judged), scratch)
    windows = stored(_fine_windows(_with_spans(rows, coarse.where(F.col("flag") >= FINE), "inner"), window), scratch)
    twice = stored(windows.groupBy("h", "w").agg(F.count("*").alias("places"), F.min(place).alias("place")).where("places > 1").select("h", "w", "place"), scratch)
    fine = windows.where("not known").join(twice, ["h", "w"]).select("doc_id", "tag", "lo", F.lit(1).alias("n"), F.lit(FULL).alias("flag"), "h", "place")
    spans = stored(coarse.where(F.col("flag").bitwiseAND(FULL) > 0).unionByName(fine))
    discard(spark, scratch)
    return _with_spans(rows, spans, "left")


def factors(spans: np.ndarray, window: int) -> list[dict[str, int]]:
    """The greedy factors of one text: first and last word, and the place of the reference. spans: rows of _spans().

    A factor takes the next copied block as long as that goes on where the factor ends, in the text and in its reference.
    """
    out: list[dict[str, int]] = []
    end = goes_on = -1
    for lo, n, _, _, place in spans[np.lexsort((spans[:, 1], spans[:, 0]))].tolist():
        if out and lo == end and place == goes_on:
            out[-1]["last"] += n
        else:
            out.append({"first": lo, "last": lo + n + window - 2, "reference": place})
        end, goes_on = lo + n, place + n
    return out


def remove_spans(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space), factors (of the parse), of what duplicate_spans() returns."""
    schema_type = pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "last", "reference")]))
    schema = schema_of(found, ["doc_id"], "n_words bigint, n_removed bigint, kept string, factors array<struct<first:bigint,last:bigint,reference:bigint>>")

    def run(batch: pa.RecordBatch):
        for first, end, data, offs in chunks(batch.column("text")):
            words = Words(data, offs)
            raw = data.tobytes()
            n, gone, kept, ranges = [], [], [], []
            for row in range(first, end):
                a, b = int(words.first[row - first]), int(words.first[row - first + 1])
                parsed = factors(_spans(batch, row), window)
                depth = np.zeros(b - a + 1, np.int32)
                for x in parsed:
                    depth[x["first"]] += 1
                    depth[x["last"] + 1] -= 1
                out = np.cumsum(depth[:-1]) > 0
                keep = np.flatnonzero(~out) + a
                n.append(b - a)
                gone.append(int(out.sum()))
                text = raw[int(offs[row - first]) : int(offs[row - first + 1])]
                if len(keep) == b - a:
                    kept.append(b" ".join(text.split()).decode())
                else:
                    base = int(offs[row - first])
                    own = text.split()
                    kept.append(b" ".join([own[i] for i in (keep - a).tolist()]).decode())
                    assert not len(keep) or own[-1] == text[words.starts[b - 1] - base : words.ends[b - 1] - base]
                ranges.append(parsed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, end - first), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(ranges, schema_type)],
                names=schema.names,
            )

    return map_arrow(found.select("doc_id", "text", "spans"), run, schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: words, words removed, and the SHA-256 of what is kept."""
    kept = remove_spans(duplicate_spans(table(spark, sf_dir, "documents")))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
