"""Best-fit packing by linear grouping.

Texts are tokenized once, map-side; what travels on is one short row for each piece. The number of
pieces of each length (at most ``capacity`` rows, whatever the corpus) is all that the driver sees:

1. Large lengths are split, from the longest down, into groups of equal cardinality, and each length
   is rounded up to the longest of its group: few distinct sizes are left.
2. Configurations (multisets of sizes that fit a sequence) are optimised for these sizes by column
   generation: a linear program over configurations, priced by a knapsack, rounded down. What counts as
   large is tried at a few shares of a sequence.
3. Actual lengths take the slots of their group, longest first, which leaves more room than planned.
4. What is left, then all small lengths, go by best fit into the rooms and into new sequences.

Every step works on runs of equal lengths or equal sequences with a multiplicity, so its cost does not
depend on the number of texts. The plan says which ranks of each length go to which sequences; pieces get
their ranks within a length by salted counts, and find their places by a join on the length.

Defined results: a null text is empty (one piece: the separator alone); every piece of every row is
placed, repeated rows and rows without an id included; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierwise.llm.common import map_arrow, schema_of, stored, table, text_rows
from tierwise.llm.token_counts import vocabulary_path

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
SEPARATOR = 0
#: Lengths from a share of a sequence on are large: the shares tried, and the groups large lengths are rounded to.
SHARES, GROUPS = (0.5, 0.34, 0.25, 0.12), 64
CACHE, CACHE_CHARS = 600_000, 64
#: How the vocabulary's pre-tokenizer cuts normalised text. Fixed by the vocabulary's format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿªµº]+|[0-9²³¹¼-¾]|[^\sa-zß-öø-ÿªµº0-9²³¹¼-¾]+"
#: Characters beyond which a text goes to the library whole: it is normalised there.
PLAIN = r"[\t-\r\x20-\x7e\xa1-\xac\xae-\xff]*"


def byte_letters() -> list[str]:
    """The letter of each byte in a byte-level vocabulary: itself if it is printable, else the next one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


LETTERS = byte_letters()


class WordIds(dict):
    """Word -> its ids as little-endian unsigned 32-bit bytes, from the tokenizer; a dict that asks for what it misses."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # words are normalised and cut here, so the vocabulary's model alone is asked; it spells bytes as letters
        self.model = self.tokenizer.model
        self.plain = re.compile(PLAIN).fullmatch
        self.words = re.compile(PLAIN_PATTERN).findall
        self.marks = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        found = self.model.tokenize(word if word.isascii() else "".join(map(LETTERS.__getitem__, word.encode())))
        ids = np.array([x.id for x in found], "<u4").tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """All ids of a text. Words of plain texts are looked up one by one: the vocabulary never joins across words."""
        if self.plain(text) and not any(x in text for x in self.marks):
            return b"".join(map(self.__getitem__, self.words(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_word_ids: dict[str, WordIds] = {}


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each text."""
    path = vocabulary or vocabulary_path(VOCABULARY)
    rows = text_rows(docs, id_col, text_col)
    schema = schema_of(rows, ["doc_id"], "piece int, start bigint, length bigint, ids_crc32 bigint")
    end = SEPARATOR.to_bytes(4, "little")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if path not in _word_ids:
            _word_ids[path] = WordIds(path)
        ids_of = _word_ids[path].ids
        at, piece, start, length, crc = [], [], [], [], []
        for row, x in enumerate(batch.column("text")):
            ids = ids_of(x.as_py() or "") + end
            for i, a in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[a : a + 4 * capacity]
                at.append(row)
                piece.append(i)
                start.append(a // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=schema.names)

    return map_arrow(rows, run, schema, 10_000)


# --- the plan, over runs of equal lengths ------------------------------------------------------------


def grouped(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Lengths with counts, longest first, in groups of equal cardinality: (rounded size, [(length, count)])."""
    total = sum(counts.values())
    size = max(1, -(-total // groups))
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append((length, []))
                room = size
            take = min(left, room)
            out[-1][1].append((length, take))
            room -= take
            left -= take
    # groups of one rounded size are one size
    merged: dict[int, dict[int, int]] = {}
    for top, own in out:
        group = merged.setdefault(top, {})
        for length, n in own:
            group[length] = group.get(length, 0) + n
    return [(top, list(group.items())) for top, group in merged.items()]


def _knapsack(sizes: list[int], prices: np.ndarray, capacity: int, limits: list[int]) -> tuple[float, list[int]]:
    """The most valuable configuration: unbounded knapsack over room, best[c] from best[c - size]."""
    arr = np.array(sizes)
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for c in range(int(arr.min()), capacity + 1):
        fits = arr <= c
        value = best[c - arr[fits]] + prices[fits]
        j = int(value.argmax())
        best[c], pick[c] = best[c - 1], -1
        if value[j] > best[c] + 1e-12:
            best[c], pick[c] = value[j], int(np.flatnonzero(fits)[j])
    config, c = [0] * len(sizes), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            config[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[capacity]), config


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 600) -> list[tuple[list[int], int]]:
    """(how many of each size, how often) from the linear program by column generation, rounded down.

    The basis is square (one column for each size), kept as a matrix; each priced column enters by the ratio test.
    """
    m = len(sizes)
    basis = np.zeros((m, m))
    for i, s in enumerate(sizes):
        basis[i, i] = capacity // s
    need = np.array(demand, float)
    amount = np.linalg.solve(basis, need)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(m))
        value, config = _knapsack(sizes, prices, capacity, demand)
        if value <= 1 + 1e-7:
            break
        column = np.array(config, float)
        direction = np.linalg.solve(basis, column)
        ok = direction > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, amount / np.where(ok, direction, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        amount = np.maximum(np.linalg.solve(basis, need), 0)
    return [(basis[:, j].astype(int).tolist(), int(amount[j] + 1e-6)) for j in range(m) if amount[j] >= 1 - 1e-6]


class Bins:
    """Runs of equal sequences: contents (length, first rank, ranks in a step) with a multiplicity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        #: free room -> runs; a run is (multiplicity, [(length, first rank, per sequence)])
        self.runs: dict[int, list[tuple[int, list[tuple[int, int, int]]]]] = defaultdict(list)
        self.rooms: list[int] = []

    def add(self, free: int, times: int, held: list[tuple[int, int, int]]) -> None:
        if not self.runs[free]:
            insort(self.rooms, free)
        self.runs[free].append((times, held))

    def take(self, least: int) -> tuple[int, int, list[tuple[int, int, int]]] | None:
        """A run with the smallest room of at least so much."""
        i = bisect_left(self.rooms, least)
        if i == len(self.rooms):
            return None
        free = self.rooms[i]
        times, held = self.runs[free].pop()
        if not self.runs[free]:
            self.rooms.pop(i)
        return free, times, held


def _from(held: list[tuple[int, int, int]], skip: int) -> list[tuple[int, int, int]]:
    """The contents of a run without its first sequences."""
    return [(length, rank + skip * per, per) for length, rank, per in held]


def plan(counts: dict[int, int], capacity: int = CAPACITY, shares: tuple[float, ...] = SHARES, groups: int = GROUPS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """The plan with the fewest sequences among those of the shares; the first that needs no more than the sum of lengths does."""
    least = -(-sum(x * n for x, n in counts.items()) // capacity)
    best, fewest = None, 0
    for share in shares:
        found = plan_for(counts, capacity, share, groups)
        n = sum(times for times, _ in found)
        if best is None or n < fewest:
            best, fewest = found, n
        if fewest <= least:
            break
    return best or []


def plan_for(counts: dict[int, int], capacity: int, large: float, groups: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Runs of equal sequences for so many pieces of each length: (multiplicity, [(length, first rank, pieces per sequence)]).

    Sequence i of a run holds, of each entry, the ranks first + i * per .. first + (i + 1) * per - 1 of the length.
    """
    given: dict[int, int] = defaultdict(int)

    def ranks(length: int, n: int) -> int:
        given[length] += n
        return given[length] - n

    bins = Bins(capacity)
    big = {x: n for x, n in counts.items() if n and x >= large * capacity}
    small = {x: n for x, n in counts.items() if n and x < large * capacity}
    if big:
        parts = grouped(big, groups)
        sizes, demand = [s for s, _ in parts], [sum(n for _, n in own) for _, own in parts]
        queues = [list(own) for _, own in parts]
        for config, times in configurations(sizes, demand, capacity):
            slots = [g for g, n in enumerate(config) for _ in range(n)]
            # actual pieces for the planned sizes: as many equal sequences at once as the runs at hand allow
            while times and slots:
                left = {g: list(q) for g, q in ((g, queues[g]) for g in set(slots))}
                chosen: list[tuple[int, int]] = []
                need: dict[tuple[int, int], int] = defaultdict(int)
                for g in slots:
                    spot = next((i for i, (_, n) in enumerate(left[g]) if n > 0), None)
                    if spot is None:
                        chosen = []
                        break
                    length, n = left[g][spot]
                    left[g][spot] = (length, n - 1)
                    chosen.append((g, length))
                    need[g, length] += 1
                if not chosen:
                    break
                have = {(g, length): sum(n for x, n in queues[g] if x == length) for g, length in need}
                many = min(times, *(have[k] // need[k] for k in need))
                held: dict[int, int] = defaultdict(int)
                for (g, length), per in need.items():
                    queues[g] = [(x, n - many * per if x == length else n) for x, n in queues[g]]
                    queues[g] = [(x, n) for x, n in queues[g] if n]
                    held[length] += per
                bins.add(capacity - sum(x * per for x, per in held.items()), many, [(x, ranks(x, many * per), per) for x, per in held.items()])
                times -= many
        for q in queues:
            for x, n in q:
                small[x] = small.get(x, 0) + n
    # best fit, longest first: into the tightest rooms, else into new sequences
    for length in sorted(small, reverse=True):
        left = small[length]
        while left:
            found = bins.take(length)
            if found is None:
                per = min(capacity // length, left)
                times = left // per
                bins.add(capacity - per * length, times, [(length, ranks(length, times * per), per)])
                left -= times * per
                continue
            free, times, held = found
            per = min(free // length, left)
            many = min(times, left // per)
            if many < times:
                bins.add(free, times - many, _from(held, many))
            bins.add(free - per * length, many, [*held, (length, ranks(length, many * per), per)])
            left -= many * per
    return [run for free in sorted(bins.runs) for run in bins.runs[free]]


# --- places for the pieces -----------------------------------------------------------------------------


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut: doc_id, piece, length and more columns. Adds sequence_id and offset; cut is read three times."""
    spark = cut.sparkSession
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, sequence = [], 0
    for times, held in plan(counts, capacity):
        for slot, (length, first, per) in enumerate(held):
            rows.append((length, first, first + times * per, per, sequence, slot))
        sequence += times
    # at most a few entries for each length of 1 .. capacity: it can be broadcast whatever the corpus
    places = F.broadcast(spark.createDataFrame(rows, "length bigint, first bigint, past bigint, per bigint, base bigint, slot int"))
    # ranks within a length, without bringing a length's pieces together: salted counts, then ranks within a salt
    salts = spark.sparkContext.defaultParallelism * 8
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    heads = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    heads = heads.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(heads, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own")).drop("before", "own", "salt")
    placed = ranked.join(places, "length").where("rank >= first and rank < past")
    # the quotient of two longs, floored, is the sequence of the run
    placed = placed.withColumn("sequence_id", F.expr("base + (rank - first) div per")).withColumn("order", F.expr("(rank - first) % per")).drop("first", "past", "per", "base")
    before = Window.partitionBy("sequence_id").orderBy("slot", "order").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("rank", "slot", "order")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a sequence of at most 2048 tokens."""
    packed = pack(stored(pieces(table(spark, sf_dir, "documents"))))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
