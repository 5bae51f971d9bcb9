"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are compared without letter case of A-Z and with white space runs as one space, on
their UTF-8 bytes. Items are cut into overlapping segments of ``SEGMENT`` bytes (shorter items are one segment).
A region within ``k`` edits of a segment of length m shares at least m - q + 1 - k * q of its q-grams, all on
diagonals (text position less segment position) at most 2k apart. So:

1. q-grams of a text that no item has are passed over by a bitmap; so are stretches with too few others.
2. The rest vote for overlapping diagonal bands of each segment; bands below the lemma's count are dropped.
3. What remains, neighbouring bands as one region, is verified by a banded alignment that may begin and end anywhere in the region.

Equal segments are one in the index. Votes are counted in pieces of about ``PIECE``, which overlap by what votes for a band, and
regions are aligned in parts of ``REGION`` bytes, which overlap likewise; so texts and items that repeat a few grams over and over
take time in proportion to their length, and bounded memory.

The index goes to the executors in blocks of about ``BLOCK`` items or ``BLOCK_BYTES`` bytes of them, a pass over the texts each, so what is
sent does not grow with the benchmark; one block is the usual case.

Defined results: a null or empty text or item matches nothing; items of fewer than ``q`` bytes are no evidence and
never match; repeated items and rows are each reported; an empty table on either side gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwise.llm.common import map_arrow, schema_of, table, text_rows
from tierwise.llm.wordhash import chunks

Q, SEGMENT, STRIDE, BUDGET = 8, 64, 32, 0.06
#: Items, and bytes of items, that go to the executors at a time.
BLOCK, BLOCK_BYTES = 20_000, 16 * 2**20
#: Votes that are counted at a time, and bytes of a region that are aligned at a time.
PIECE, REGION = 1_000_000, 4096
_BITS = 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[_SPACE] = 0x20


def normalised(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with single spaces, none at a text's start, and the new offsets."""
    space = _SPACE[data]
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = True
        before[1:] = space[:-1]
        before[offs[:-1][offs[:-1] < len(data)]] = True
    keep = ~(space & before)
    return _LOWER[data[keep]], np.concatenate(([0], np.cumsum(keep)))[offs]


def gram_keys(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    two = data[:-1].astype(np.uint64) | data[1:].astype(np.uint64) << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    return four[:-4] | four[4:] << np.uint64(32)


def _slots(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)


class Index:
    """Segments of a block of items with their q-grams."""

    def __init__(self, items: list[tuple]):
        # equal segments are one, with all the places where items have it
        known: dict[bytes, int] = {}
        self.owners: list[list[tuple]] = []
        self.text, self.edits, self.least = [], [], []
        for item_id, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            whole = normalised(data, np.array([0, len(data)]))[0].tobytes().rstrip()
            last = max(0, len(whole) - SEGMENT)
            for a in sorted({*range(0, last + 1, STRIDE), last}):
                part = whole[a : a + SEGMENT]
                grams = len(part) - Q + 1
                if grams < 1:
                    continue
                if part in known:
                    self.owners[known[part]].append((item_id, a))
                    continue
                k = min(int(BUDGET * len(part)), (grams - 1) // Q)
                known[part] = len(self.text)
                self.owners.append([(item_id, a)])
                self.text.append(part)
                self.edits.append(k)
                self.least.append(grams - k * Q)
        self.least = np.array(self.least, np.int64)
        self.reach = max(self.edits, default=0)
        keys = [gram_keys(np.frombuffer(x, np.uint8)) for x in self.text]
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.segment = np.repeat(np.arange(len(keys)), [len(x) for x in keys])[order] if keys else np.zeros(0, np.int64)
        self.place = np.concatenate([np.arange(len(x)) for x in keys])[order] if keys else np.zeros(0, np.int64)
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[_slots(self.keys)] = True

    def candidates(self, data: np.ndarray, offs: np.ndarray):
        """(text, segment, first byte, last byte) of regions that the lemma leaves."""
        keys = gram_keys(data)
        hits = np.flatnonzero(self.bitmap[_slots(keys)])
        if not len(hits) or not len(self.text):
            return
        # stretches that hold as many hits as the weakest segment needs
        upto = np.searchsorted(hits, hits + SEGMENT + self.reach)
        full = np.flatnonzero(upto - np.arange(len(hits)) >= int(self.least.min()))
        depth = np.zeros(len(hits) + 1, np.int64)
        np.add.at(depth, full, 1)
        np.add.at(depth, upto[full], -1)
        hits = hits[np.cumsum(depth[:-1]) > 0]
        text = np.searchsorted(offs, hits, "right") - 1
        inside = hits + Q <= offs[text + 1]
        hits, text = hits[inside], text[inside]
        at = np.searchsorted(self.keys, keys[hits])
        at[at == len(self.keys)] = 0
        real = self.keys[at] == keys[hits] if len(self.keys) else np.zeros(len(hits), bool)
        hits, text, at = hits[real], text[real], at[real]
        if not len(hits):
            return
        width = 2 * (2 * self.reach + 1)
        half = width // 2
        # votes in pieces of bounded size: a gram may stand in many segments, and many times in a text. What votes for one band lies
        # within ``span`` bytes, so a piece also reads the hits that far after its own ones, and a band counts in the piece of its first byte
        span = SEGMENT + 2 * width + Q
        times = self.first[at + 1] - self.first[at]
        ends = np.cumsum(times)
        parts: list[np.ndarray] = []
        begin = 0
        while begin < len(hits):
            base = ends[begin - 1] if begin else 0
            stop = max(begin + 32, int(np.searchsorted(ends, base + PIECE, "right")))
            core = (hits[begin] if begin else -span, hits[stop] if stop < len(hits) else hits[-1] + span)
            high = int(np.searchsorted(hits, core[1] + span, "right"))
            n = times[begin:high]
            entry = np.repeat(self.first[at[begin:high]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            segment = self.segment[entry]
            diagonal = np.repeat(hits[begin:high], n) - self.place[entry] + SEGMENT
            doc = np.repeat(text[begin:high], n)
            bands = (int(offs[-1]) + SEGMENT + width) // width + 2
            for turn in (0, 1):
                band = (diagonal + turn * half) // width
                name, count = np.unique((doc * len(self.text) + segment) * bands + band, return_counts=True)
                d, s = np.divmod(name // bands, len(self.text))
                first = (name % bands) * width - turn * half - SEGMENT
                kept = (count >= self.least[s]) & (first >= core[0]) & (first < core[1])
                parts.append(np.stack([d[kept], s[kept], first[kept]]))
            begin = stop
        d, s, first = np.concatenate(parts, axis=1)
        order = np.lexsort((first, s, d))
        d, s, first = d[order], s[order], first[order]
        # neighbouring bands of a segment are one region, of REGION bytes at most
        edge = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (first[1:] - first[:-1] > half))))
        for a, b in zip(edge.tolist(), np.append(edge[1:], len(d)).tolist(), strict=True):
            while a < b:
                end = min(b, a + int(np.searchsorted(first[a:b], first[a] + REGION, "right")))
                k = self.edits[s[a]]
                yield int(d[a]), int(s[a]), max(int(offs[d[a]]), int(first[a]) - k), min(int(offs[d[a] + 1]), int(first[end - 1]) + width + len(self.text[s[a]]) + k)
                a = end


def alignment(segment: bytes, region: bytes, k: int) -> tuple[int, int] | None:
    """(edits, end in the region) of the best place of a segment in a region, if it takes k edits at most.

    The band is as wide as the region is longer than the segment, and k more for what is left out.
    """
    at = region.find(segment)
    if at >= 0:
        return 0, at + len(segment)
    if not k:
        return None
    s = np.frombuffer(segment, np.uint8)
    wide = len(region) - len(segment) + 2 * k + 1
    if wide <= 0:
        return None
    # column o of row i is the text place i + o - k
    text = np.concatenate([np.zeros(k, np.int16) - 1, np.frombuffer(region, np.uint8).astype(np.int16), np.zeros(wide + k, np.int16) - 1])
    steps = np.arange(wide)
    row = np.where(steps >= k, 0, k + 1)
    for i in range(len(s)):
        skip = np.append(row[1:] + 1, k + 1)
        best = np.minimum(row + (text[i : i + wide] != s[i]), skip)
        row = np.minimum.accumulate(best - steps) + steps
        if row.min() > k:
            return None
    o = int(row.argmin())
    return int(row[o]), min(len(region), len(s) + o - k)


def _blocks(items: DataFrame) -> int:
    """Blocks of about BLOCK items or BLOCK_BYTES, whichever are more."""
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()
    return max(1, -(-n // BLOCK), -(-size // BLOCK_BYTES))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_segments, edits, first, last (bytes of the normalised text) of each item found in each row."""
    rows = text_rows(docs, id_col, text_col)
    items = benchmark.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").alias("item_text")).where("item_text is not null")
    blocks = _blocks(items)
    marked = items.withColumn("block", F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)))
    found = [_pass(rows, Index([(r.item_id, r.item_text) for r in marked.where(F.col("block") == i).sort("item_id", "item_text").collect()]), items.schema["item_id"]) for i in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def _pass(rows: DataFrame, index: Index, item_field) -> DataFrame:
    schema = schema_of(rows, ["doc_id"], "n_segments int, edits int, first bigint, last bigint").add(item_field)
    kind = pa.string() if item_field.dataType.typeName() == "string" else None

    def run(batch: pa.RecordBatch):
        for first, _, data, offs in chunks(batch.column("text")):
            data, offs = normalised(data, offs)
            raw = data.tobytes()
            best: dict[tuple[int, int], list] = {}
            for d, s, a, b in index.candidates(data, offs):
                if (found := alignment(index.text[s], raw[a:b], index.edits[s])) is not None:
                    edits, end = found
                    last = a + end - int(offs[d])
                    begin = max(0, last - len(index.text[s]))
                    for item, start in index.owners[s]:
                        have = best.setdefault((d, item), [set(), edits, begin, last])
                        have[0].add(start)
                        have[1], have[2], have[3] = min(have[1], edits), min(have[2], begin), max(have[3], last)
            if best:
                at = pa.array([first + d for d, _ in best], pa.int64())
                columns = [[len(x[0]) for x in best.values()], *([x[i] for x in best.values()] for i in (1, 2, 3))]
                arrays = [pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), *arrays, pa.array([i for _, i in best], kind)], names=schema.names)

    return map_arrow(rows, run, schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in whose text no item is found."""
    items = benchmark.select(F.col(item_text_col).cast("string").alias("item_text")).where("item_text is not null").distinct()
    blocks = _blocks(items)
    marked = items.withColumn("block", F.pmod(F.xxhash64("item_text"), F.lit(blocks)))
    out = docs
    for i in range(blocks):
        index = Index(list(enumerate(r.item_text for r in marked.where(F.col("block") == i).sort("item_text").collect())))

        def run(batch: pa.RecordBatch, index=index) -> pa.RecordBatch:
            clean = np.ones(batch.num_rows, bool)
            for first, _, data, offs in chunks(batch.column(text_col)):
                data, offs = normalised(data, offs)
                raw = data.tobytes()
                for d, s, a, b in index.candidates(data, offs):
                    if clean[first + d] and alignment(index.text[s], raw[a:b], index.edits[s]) is not None:
                        clean[first + d] = False
            return batch.filter(pa.array(clean))

        out = map_arrow(out, run, out.schema)
    return out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it, whole or in passages of SEGMENT bytes."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "n_segments", "edits", "first", "last")
