"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

1. Equal vectors of a label are one node with a number of copies.
2. A rotation is learned on a sample of at most ``SAMPLE`` nodes (those with the smallest hashes; near copies within it count
   once): principal axes, then rotations that bring the axes nearest to balanced binary codes. The sign bits
   of a vector are its code.
3. Codes are cut into substrings, a table for each. Substrings are about as long as the binary logarithm of the largest
   label's nodes, so buckets stay small as data grow. Two nodes meet in a table if their substrings differ in one bit at most: a
   node is posted under its substring with each bit masked in turn. There are as many tables (of more rotations,
   if one has too few bits) as bring ``RECALL`` of simulated pairs together: vectors of the sample that the rotation was not
   learned on, each with a partner in a random direction at exactly the limit, the hardest pairs there are. Meetings with more differing bits than any
   simulated pair are dropped.
4. What meets is compared by the original vectors in double precision. A pair is compared only in the first bucket that
   both share, so each link is counted once.

Buckets. No list of pairs is ever made: a bucket gives each node the number of its links there, and one edge a
node that joins what is linked. A bucket of more than ``BLOCK`` nodes is cut into blocks, and each two blocks are a unit of
their own, so no task holds more than two blocks. Bucket sizes come back by a join in which the largest, at most
``HEAVY`` keys, are broadcast.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those with a null label, have no
links and stand for themselves; vectors of different lengths are not linked; rows of one id, and repeated
rows, are vectors of their own, linked with each other if similar; a row without an id counts as a link of others but
never names a component, and is kept only without links; an empty table gives an empty result; other columns are
not read. Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwise.llm.common import HEAVY, discard, looked_up, stored, table
from tierwise.llm.components import components

LIMIT = 0.98
SAMPLE, RECALL, BITS, STEPS = 4096, 0.995, 64, 30
#: Bits of a substring at least and at most; tables at most.
SHORTEST, LONGEST, TABLES = 12, 30, 64
BLOCK = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; the largest component is taken out first, so no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def distinct_sample(u: np.ndarray, limit: float) -> np.ndarray:
    """The sample without vectors that are linked with one before them: a large group of near copies counts once."""
    gone = np.zeros(len(u), bool)
    for a in range(0, len(u), 512):
        near = u[a : a + 512] @ u[: a + 512].T >= limit
        gone[a : a + 512] = np.tril(near, a - 1).any(axis=1)
    return u[~gone]


def rotation(u: np.ndarray, bits: int, rng: np.random.Generator, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(centre, axes): the signs of (x - centre) @ axes are balanced codes of the sample u, found by alternating codes and rotation."""
    d = u.shape[1]
    centre = u.mean(axis=0) if len(u) else np.zeros(d)
    _, axes = np.linalg.eigh((u - centre).T @ (u - centre)) if len(u) > 1 else (None, np.linalg.qr(rng.standard_normal((d, d)))[0])
    axes = axes[:, ::-1][:, :bits]
    turned, _ = np.linalg.qr(rng.standard_normal((axes.shape[1], axes.shape[1])))
    low = (u - centre) @ axes
    for _ in range(steps if len(u) > 1 else 0):
        left, _, right = np.linalg.svd(np.where(low @ turned >= 0, 1.0, -1.0).T @ low)
        turned = (left @ right).T
    return centre, axes @ turned


class Codes:
    """Substrings of the codes of vectors of one length."""

    def __init__(self, u: np.ndarray, d: int, width: int, limit: float):
        self.width, self.limit, self.d = width, limit, d
        self.rng = np.random.default_rng(d)
        every = distinct_sample(u, limit)
        # pairs are simulated with vectors that the rotation has not seen: partners at the limit, in a random direction
        self.sample, self.one = every[::2], every[1::2] if len(every) > 64 else unit(self.rng.standard_normal((256, d)))
        aside = self.rng.standard_normal(self.one.shape)
        aside -= (aside * self.one).sum(axis=1, keepdims=True) * self.one
        size = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
        self.two = limit * self.one + np.sqrt(1 - limit * limit) * np.divide(aside, size, out=np.zeros_like(aside), where=size > 0)
        self.rotations: list[tuple[np.ndarray, np.ndarray]] = []

    def substrings(self, u: np.ndarray, tables: int) -> np.ndarray:
        """An integer for each vector and table."""
        per = min(BITS, self.d)
        while len(self.rotations) * per < tables * self.width:
            self.rotations.append(rotation(self.sample, per, self.rng))
        bits = np.concatenate([(u - c) @ a >= 0 for c, a in self.rotations], axis=1)[:, : tables * self.width]
        return (bits.reshape(len(u), tables, self.width) << np.arange(self.width)).sum(axis=2).astype(np.int32)

    def found(self, tables: int) -> tuple[float, int]:
        """(the share of simulated pairs that meet, the most bits in which one of them differs)."""
        apart = self.substrings(self.one, tables) ^ self.substrings(self.two, tables)
        return float((apart & (apart - 1) == 0).any(axis=1).mean()), int(np.bitwise_count(apart).sum(axis=1).max())


class Index:
    """Codes of each length of vectors in the sample, with one number of tables; other lengths have random rotations."""

    def __init__(self, sample: list[list[float]], nodes: int, limit: float, recall: float):
        self.width = min(LONGEST, max(SHORTEST, int(np.ceil(np.log2(max(2, nodes))))))
        self.limit = limit
        self.of: dict[int, Codes] = {}
        by: dict[int, list[list[float]]] = {}
        for v in sample:
            by.setdefault(len(v), []).append(v)
        for d, vectors in by.items():
            self.of[d] = Codes(unit(np.array(vectors, float)), d, self.width, limit)
        self.tables = 1
        while self.tables < TABLES and any(c.found(self.tables)[0] < recall for c in self.of.values()):
            self.tables += 1
        self.most = max((c.found(self.tables)[1] for c in self.of.values()), default=self.width * self.tables)

    def substrings(self, u: np.ndarray) -> np.ndarray:
        d = u.shape[1]
        if d not in self.of:
            self.of[d] = Codes(np.zeros((0, d)), d, self.width, self.limit)
        return self.of[d].substrings(u, self.tables)


def by_length(column: pa.Array):
    """(places, matrix) of the vectors of each length in a batch."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
    size = np.diff(ends)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield at, flat[(ends[at][:, None] + np.arange(d)).ravel()].reshape(len(at), d)


def coded(nodes: DataFrame, index: Index) -> DataFrame:
    """node, lab, subs: the substrings of each node."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            subs = np.empty((batch.num_rows, index.tables), np.int32)
            for at, v in by_length(batch.column("v")):
                subs[at] = index.substrings(unit(v))
            lists = pa.ListArray.from_arrays(np.arange(0, subs.size + 1, index.tables, dtype=np.int32), subs.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("lab"), lists], names=["node", "lab", "subs"])

    return nodes.select("node", "lab", "v").mapInArrow(run, "node bigint, lab bigint, subs array<int>")


def here(x: np.ndarray, y: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Which pairs of substrings (one row each) meet first in bucket at (table * 32 + masked bit) and differ in at most so many bits."""
    apart = x ^ y
    close = apart & (apart - 1) == 0
    first = close.argmax(axis=1)
    rows = np.arange(len(apart))
    bit = apart[rows, first]
    # nodes equal in a table meet first under its lowest bit
    place = np.where(bit == 0, 0, np.log2(np.maximum(bit, 1)).astype(np.int64))
    return close[rows, first] & (first * 32 + place == at) & (np.bitwise_count(apart).sum(axis=1) <= most)


def units(codes: DataFrame, width: int, block: int, scratch: list[str]) -> DataFrame:
    """at, b, one, two, members (part, node, lab, subs) of each unit of work: a bucket, or two blocks of a large one."""
    every = F.flatten(F.transform("subs", lambda x, t: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda p: F.struct((t * 32 + p).alias("at"), x.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1), p))).alias("key")))))
    posts = codes.select("node", "lab", "subs", F.explode(every).alias("x")).select(F.xxhash64("lab", "x.at", "x.key").alias("b"), "x.at", "node", "lab", "subs")
    sizes = stored(posts.groupBy("b").agg(F.count("*").alias("n")).where("n > 1"), scratch)
    total = codes.count() * width
    placed = looked_up(posts, sizes, sizes.where(F.col("n") > total / HEAVY), ["b"], "n")
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("part", F.pmod(F.xxhash64("node", "b"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.withColumn("other", other).select("b", "at", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), F.struct("part", "node", "lab", "subs").alias("member"))
    return dealt.groupBy("b", "at", "one", "two").agg(F.collect_list("member").alias("members")).where(F.size("members") > 1)


def candidates(work: DataFrame, tables: int, most: int) -> DataFrame:
    """b, at, one, two, part, node, lab, subs of the nodes of each unit that have somebody to be compared with there."""
    schema = "b bigint, at int, one int, two int, part int, node bigint, lab bigint, subs array<int>"

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            members = batch.column("members")
            ends = np.concatenate(([0], np.cumsum(members.value_lengths().to_numpy())))
            size, flat = np.diff(ends), members.flatten()
            part, node, lab = (flat.field(x).to_numpy() for x in ("part", "node", "lab"))
            subs = flat.field("subs").flatten().to_numpy().reshape(-1, tables)
            keys = {x: batch.column(x).to_numpy() for x in ("b", "at", "one", "two")}
            wanted = np.zeros(len(node), bool)
            for n in np.unique(size):
                groups = np.flatnonzero(size == n)
                i, j = np.triu_indices(n, 1)
                # a bounded number of pairs at a time
                for g in range(0, len(groups), step := max(1, 200_000 // len(i))):
                    some = groups[g : g + step]
                    x, y = (ends[some][:, None] + i).ravel(), (ends[some][:, None] + j).ravel()
                    unit_of = np.repeat(some, len(i))
                    apart = (part[x] != part[y]) | (keys["one"][unit_of] == keys["two"][unit_of])
                    ok = here(subs[x], subs[y], keys["at"][unit_of], most) & apart & (lab[x] == lab[y]) & (node[x] != node[y])
                    wanted[x[ok]] = wanted[y[ok]] = True
            at = np.flatnonzero(wanted)
            if not len(at):
                continue
            of = np.searchsorted(ends, at, "right") - 1
            lists = pa.ListArray.from_arrays(np.arange(0, len(at) * tables + 1, tables, dtype=np.int32), subs[at].ravel())
            yield pa.RecordBatch.from_arrays([*(pa.array(keys[x][of]) for x in ("b", "at", "one", "two")), pa.array(part[at]), pa.array(node[at]), pa.array(lab[at]), lists], names=["b", "at", "one", "two", "part", "node", "lab", "subs"])

    return work.mapInArrow(run, schema)


def compared(found: DataFrame, nodes: DataFrame, tables: int, most: int, limit: float) -> DataFrame:
    """node, links (copies of others linked in a unit), root (the smallest node that it is joined with there)."""
    unit_key = ["b", "at", "one", "two"]
    rows = found.join(nodes.select("node", "copies", "v"), "node").groupBy(*unit_key).agg(F.collect_list(F.struct("part", "node", "lab", "subs", "copies", "v")).alias("members"))

    def run(batches):
        for batch in batches:
            out: list[np.ndarray] = []
            members = batch.column("members")
            flat = members.flatten()
            ends = np.concatenate(([0], np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False)))).astype(int)
            part, node, lab, copies = (flat.field(x).to_numpy() for x in ("part", "node", "lab", "copies"))
            subs = flat.field("subs").flatten().to_numpy().reshape(-1, tables)
            vectors = flat.field("v")
            at, same = batch.column("at").to_numpy(), (batch.column("one").to_numpy() == batch.column("two").to_numpy())
            for g, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                n = b - a
                similar = np.zeros((n, n), bool)
                for rows_of, v in by_length(vectors.slice(a, n)):
                    u = unit(v)
                    similar[np.ix_(rows_of, rows_of)] = u @ u.T >= limit
                i, j = np.nonzero(np.triu(similar, 1))
                ok = (lab[a + i] == lab[a + j]) & (node[a + i] != node[a + j]) & (same[g] | (part[a + i] != part[a + j]))
                ok &= here(subs[a + i], subs[a + j], np.full(len(i), at[g]), most)
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                own = node[a:b]
                links = np.bincount(i, copies[a + j], n) + np.bincount(j, copies[a + i], n)
                root, before = own.copy(), None
                while before is None or (root != before).any():
                    before = root.copy()
                    low = np.minimum(root[i], root[j])
                    np.minimum.at(root, i, low)
                    np.minimum.at(root, j, low)
                some = np.flatnonzero(links)
                out.append(np.stack([own[some], links[some].astype(np.int64), root[some]]))
            if out:
                every = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in every], names=["node", "links", "root"])

    return rows.mapInArrow(run, "node bigint, links bigint, root bigint")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", limit: float = LIMIT, sample: int = SAMPLE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row; vectors of one label are linked at a cosine of limit or more."""
    spark, scratch = vectors.sparkSession, []
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))
    # a class of equal vectors is named by 128 bits
    h1, h2 = F.xxhash64("label", "v"), F.xxhash64("v", F.lit("vector"), "label")
    rows = rows.select("vec_id", F.when(usable, h1).alias("h1"), F.when(usable, h2).alias("h2"), F.xxhash64("label", F.size("v")).alias("lab"), F.when(usable, F.col("v")).alias("v"))
    nodes = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("smallest"), F.count("*").alias("copies"), F.first("lab").alias("lab"), F.first("v").alias("v"))
    # row numbers name the nodes; they are fixed once the table is written
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), scratch)

    largest = nodes.groupBy("lab").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n
    index = Index([r.v for r in nodes.select("h1", "h2", "v").orderBy("h1", "h2").limit(sample).collect()], largest, limit, recall)
    codes = stored(coded(nodes, index), scratch)
    found = stored(candidates(units(codes, index.width, block, scratch), index.tables, index.most), scratch)
    links = stored(compared(found, nodes, index.tables, index.most, limit), scratch)
    joined = components(links.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    placed = nodes.select("node", "h1", "h2", "copies", "smallest").join(counts, "node", "left").join(joined, "node", "left").select("h1", "h2", "copies", "smallest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    placed = stored(placed, scratch)
    names = placed.groupBy("component").agg(F.min("smallest").alias("component_id"), F.count("*").alias("n"))
    named = stored(looked_up(placed, names, names.where(F.col("n") > nodes.count() / HEAVY), ["component"], "component_id") if largest else placed.withColumn("component_id", F.lit(None).cast("long")), scratch)
    named = named.select("h1", "h2", "copies", F.struct("n_links", "component_id").alias("found"))
    lean = rows.select("vec_id", "h1", "h2")
    some = looked_up(lean.where("h1 is not null"), named, named.where(F.col("copies") > rows.count() / HEAVY), ["h1", "h2"], "found")
    out = some.select("vec_id", F.col("found.n_links").alias("n_links"), F.col("found.component_id").alias("component_id"))
    alone = lean.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("vec_id").isNull() & (F.col("n_links") == 0))
    out = stored(out.unionByName(alone).withColumn("kept", kept))
    discard(spark, scratch)
    return out


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: how many others it is linked with, its component's smallest id, and whether it stands for it."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
