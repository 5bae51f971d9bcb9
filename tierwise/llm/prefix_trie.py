"""Conversation prefix trie: owned chains, found by binary search against prefix-digest minima, aggregated bottom-up.

A node of the trie is a distinct sequence of first d turns. It is named by a digest of d and its turns (128 bits: the exclusive
or of a hash of each turn with its place, so digests of prefixes are running sums) and owned by the smallest
conversation that begins with it. As the members of a node are members of the nodes above it, a conversation that
owns a node owns all its nodes further down: from its first owned depth on, a conversation owns a chain. So:

1. The minima of all prefixes, with their counts, are one grouping by digest, summed map-side.
2. Each conversation's first owned depth is found by binary search: each round looks up the middle of what is left of
   every conversation in the minima, in one batched join. Only prefixes between the bounds go to the next
   round, so all rounds together move about twice the prefixes. The last lookup that fails names the parent chain.
3. Chains hang on nodes of other chains. Sums over subtrees go up the tree of chains by doubling: in each round
   every chain adds what its descendants up to 2**k levels below have gathered, so rounds grow with the logarithm
   of the nesting. A chain's own nodes then take sums from its end, and what hangs on them.

Skew. A prefix that much of the data begins with is looked up by a broadcast join: minima (or parents) with more than a
``HEAVY``-th of all lookups behind them are at most ``HEAVY`` rows, whatever the data. Conversations are sorted and summed in
pieces of ``PIECE`` turns, so a very long one is not one task. The conversations that end in a node are
concatenated in runs of ``PIECE`` ids, and one pass over these runs, in order, feeds the hash: only a state is held.

Defined results: rows without a conv_id are left out; null roles and texts are empty; ties of turn go by role, then by a
hash of role and text; repeated rows are turns of their own; a conversation without turns after rebuilding is a
member of the root alone; an empty table gives an empty result; other columns are not read. Ids are integers; a remainder has the sign of
its id, as in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierwise.llm.common import HEAVY, discard, looked_up, stored, table

PIECE = 4096
#: Conversation c borrows from c - c % FAMILY; crc32(c) % BORROWED turns.
FAMILY, BORROWED = 5, 9
EMPTY_SHA256 = hashlib.sha256().hexdigest()


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, t1, t2 (128 bits of role and text), bytes: no text from here on."""
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.where("conv_id is not null").select("conv_id", "turn", "role", F.xxhash64("role", "text").alias("t1"), F.xxhash64("text", F.lit("turn"), "role").alias("t2"), F.octet_length("text").cast("long").alias("bytes"))


def running(rows: DataFrame, key: str, piece: Column, order: Sequence[Column], totals: dict[str, tuple[Column, str]], upward: bool = False) -> DataFrame:
    """rows with running aggregates along each key: name -> (value, 'sum' or 'bit_xor'), this row included.

    piece numbers pieces of a key that follow the order (against it with upward); each is summed by itself, and the totals of the
    pieces before, few rows, are joined back. rows is read twice.
    """
    kinds = {"sum": F.sum, "bit_xor": F.bit_xor}
    placed = rows.withColumn("__piece", piece)
    inside = Window.partitionBy(key, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = placed.select("*", *(kinds[kind](value).over(inside).alias(f"__{name}") for name, (value, kind) in totals.items()))
    several = placed.groupBy(key, "__piece").agg(*(kinds[kind](value).alias(f"__all_{name}") for name, (value, kind) in totals.items()))
    before = Window.partitionBy(key).orderBy(F.col("__piece").desc() if upward else "__piece").rowsBetween(Window.unboundedPreceding, -1)
    heads = several.select(key, "__piece", *(F.coalesce(kinds[kind](f"__all_{name}").over(before), F.lit(0)).alias(f"__all_{name}") for name, (_, kind) in totals.items()))
    add = lambda name, kind: F.col(f"__{name}").bitwiseXOR(F.col(f"__all_{name}")) if kind == "bit_xor" else F.col(f"__{name}") + F.col(f"__all_{name}")
    return own.join(heads, [key, "__piece"]).select(*rows.columns, *(add(name, kind).alias(name) for name, (_, kind) in totals.items()))


def ordered(rows: DataFrame) -> DataFrame:
    """rows of turns() with pos, from 1, in the order of turn (null first). Turns are ranked in pieces of PIECE numbers."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("t1"), F.col("t2")]
    piece = F.coalesce(F.floor(F.col("turn") / PIECE).cast("long"), F.lit(-(2**63)))
    return running(rows, "conv_id", piece, order, {"pos": (F.lit(1).cast("long"), "sum")})


def rebuilt(placed: DataFrame, scratch: list[str]) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n of every conversation, conv_id, depth, d1, d2, bytes of each of its prefixes), with borrowed turns first."""
    counts = stored(placed.groupBy("conv_id").agg(F.count("*").alias("own")), scratch)
    wanted = F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    of = counts.select(F.col("conv_id").alias("family"), F.col("own").alias("there"))
    meta = counts.select("conv_id", "own", wanted.alias("h"), family.alias("family")).join(of, "family", "left")
    meta = meta.withColumn("off", F.least("h", F.coalesce("there", F.lit(0))))
    meta = stored(meta.select("conv_id", "family", "h", "off", (F.col("off") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), scratch)
    own = placed.where(F.col("pos") > wanted).join(meta.select("conv_id", "h", "off"), "conv_id").select("conv_id", (F.col("pos") - F.col("h") + F.col("off")).alias("depth"), "t1", "t2", "bytes")
    # a family lends at most BORROWED - 1 turns to each of its FAMILY members
    lent = placed.where(F.col("pos") < BORROWED).where(F.col("conv_id") % FAMILY == 0).withColumnRenamed("conv_id", "family")
    lent = lent.join(meta.select("conv_id", "family", "off"), "family").where("pos <= off").select("conv_id", F.col("pos").alias("depth"), "t1", "t2", "bytes")
    rows = stored(own.unionByName(lent), scratch)
    digest = {"d1": (F.xxhash64("depth", "t1", "t2"), "bit_xor"), "d2": (F.xxhash64("t2", F.lit("prefix"), "t1", "depth"), "bit_xor")}
    prefixes = running(rows, "conv_id", F.floor(F.col("depth") / PIECE), [F.col("depth")], digest)
    return meta.select("conv_id", "n"), prefixes.select("conv_id", "depth", "d1", "d2", "bytes")


def chains(lengths: DataFrame, prefixes: DataFrame, minima: DataFrame, heavy: DataFrame, root: int, scratch: list[str]) -> tuple[DataFrame, DataFrame]:
    """(conv_id, first, n, parent of each chain; conv_id, depth, member of the node in which each conversation ends)."""
    key = ["depth", "d1", "d2"]
    lookup = lambda probes: looked_up(probes, minima, heavy, key, "owner")
    some = lengths.where("n > 0")
    ends = stored(lookup(prefixes.join(some, "conv_id").where("depth = n").select("conv_id", "n", *key)).select("conv_id", "n", "owner"), scratch)
    member = F.col("conv_id").alias("member")
    last = ends.select(F.col("owner").alias("conv_id"), F.col("n").alias("depth"), member).unionByName(lengths.where("n = 0").select(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), member))
    # conversations that own their last node own a chain; its first depth is in low..high
    state = ends.where("owner = conv_id").select("conv_id", "n", F.lit(1).cast("long").alias("low"), F.col("n").alias("high"), F.lit(root).cast("long").alias("parent"))
    done, left = state.where("low = high"), stored(prefixes.join(state.where("low < high"), "conv_id"), scratch)
    while not left.isEmpty():
        middle = F.expr("(low + high) div 2")
        found = lookup(left.where(F.col("depth") == middle)).select("conv_id", F.col("owner").alias("found"))
        mine = F.col("found") == F.col("conv_id")
        next_ = {"high": F.when(mine, middle).otherwise(F.col("high")), "low": F.when(mine, F.col("low")).otherwise(middle + 1), "parent": F.when(mine, F.col("parent")).otherwise(F.col("found"))}
        left = stored(left.join(found, "conv_id").select("conv_id", "n", *key, *(v.alias(k) for k, v in next_.items())).where("depth between low and high"), scratch)
        done = done.unionByName(left.where("low = high").select(*done.columns))
        left = left.where("low < high")
    owned = done.select("conv_id", F.col("low").alias("first"), "n", "parent")
    # the smallest conversation's chain begins at the root
    rooted = lengths.where(F.col("conv_id") == root).select("conv_id", F.lit(0).cast("long").alias("first"), "n", F.lit(None).cast("long").alias("parent"))
    return stored(owned.where(F.col("conv_id") != root).unionByName(rooted), scratch), last


def gathered(own: DataFrame, sums: Sequence[str], scratch: list[str]) -> DataFrame:
    """own: conv_id, parent and sums of each chain. The sums with those of all chains below it, by doubling."""
    now = own.select("conv_id", F.col("parent").alias("above"), *sums)
    while not now.where("above is not null").isEmpty():
        up = now.where("above is not null").groupBy("above").agg(F.count("*").alias("__n"), *(F.sum(x).alias(f"__{x}") for x in sums)).withColumnRenamed("above", "__of")
        added = now.join(up, F.col("conv_id") == F.col("__of"), "left").select("conv_id", "above", F.coalesce("__n", F.lit(0)).alias("__n"), *((F.col(x) + F.coalesce(f"__{x}", F.lit(0))).alias(x) for x in sums))
        added = stored(added, scratch)
        # the chain above the one above; a chain on which many hang is looked up by a broadcast
        links = added.select(F.col("conv_id").alias("above"), F.col("above").alias("next"), "__n").where("next is not null")
        many = added.where("above is not null").count() / HEAVY
        further = looked_up(added.where("above is not null").select("conv_id", "above"), links, links.where(F.col("__n") > many), ["above"], "next").select("conv_id", "next")
        now = stored(added.drop("above", "__n").join(further, "conv_id", "left").select("conv_id", F.col("next").alias("above"), *sums), scratch)
    return now.drop("above")


def ends_digests(last: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes in which conversations end: their ids in ascending order, in runs, hashed one after the other."""
    runs = last.groupBy("conv_id", "depth", F.floor(F.col("member") / PIECE).alias("run")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("member")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for conv, depth, ids in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "depth", "ids")), strict=True):
                if (conv, depth) != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["conv_id", "depth", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names=["conv_id", "depth", "ends_sha256"])

    return runs.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "run").mapInArrow(run, "conv_id bigint, depth bigint, ends_sha256 string")


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark, scratch = conversations.sparkSession, []
    lean = stored(turns(conversations, conv_col, turn_col, role_col, text_col), scratch)
    lengths, prefixes = rebuilt(stored(ordered(lean), scratch), scratch)
    prefixes = stored(prefixes, scratch)
    total = lengths.agg(F.min("conv_id").alias("root"), F.count("*").alias("n")).first()
    if total.root is None:
        return spark.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    minima = stored(prefixes.groupBy("depth", "d1", "d2").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes")), scratch)
    # no more than HEAVY nodes have more than a HEAVY-th of all prefixes
    heavy = minima.where(F.col("n_convs") > prefixes.count() / HEAVY)
    lines, last = chains(lengths, prefixes, minima, heavy, total.root, scratch)

    root = spark.createDataFrame([(total.root, 0, total.n, 0)], "conv_id bigint, depth bigint, n_convs bigint, bytes bigint")
    nodes = minima.select(F.col("owner").alias("conv_id"), "depth", "n_convs", "bytes").unionByName(root).withColumn("value", (F.col("n_convs") - 1) * F.col("bytes"))
    hung = lines.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("hung"))
    whole = nodes.groupBy("conv_id").agg(F.sum("value").alias("saved"))
    bare = hung.withColumnRenamed("depth", "n").select("conv_id", "n", "hung")
    own = lines.join(whole, "conv_id").join(bare, ["conv_id", "n"], "left").select("conv_id", "parent", F.col("hung").isNull().cast("long").alias("leaves"), "saved")
    below = gathered(stored(own, scratch), ["leaves", "saved"], scratch)

    onto = lines.where("parent is not null").join(below, "conv_id").groupBy(F.col("parent").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("hung"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    rows = nodes.join(onto, ["conv_id", "depth"], "left").join(lines, "conv_id").select(
        "conv_id", "depth", "n_convs", F.when(F.col("depth") == F.col("first"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        (F.coalesce("hung", F.lit(0)) + (F.col("depth") < F.col("n")).cast("long")).alias("n_children"),
        F.coalesce("leaves", (F.col("depth") == F.col("n")).cast("long")).alias("leaves"), (F.col("value") + F.coalesce("saved", F.lit(0))).alias("saved"),
    )
    summed = running(stored(rows, scratch), "conv_id", F.floor(F.col("depth") / PIECE), [F.col("depth").desc()], {"n_leaves": (F.col("leaves"), "sum"), "saved_tokens": (F.col("saved"), "sum")}, upward=True)
    ends = ends_digests(last)
    found = summed.join(ends, ["conv_id", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
    out = stored(found)
    discard(spark, scratch)
    return out


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    return trie(table(spark, sf_dir, "conversations"))


ORACLE = f"""
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
), c as (
  select conv_id, count(*) as own, conv_id - conv_id % {FAMILY} as family,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [3988292384::bigint, 3988292384, 3988292384, 3988292384, 3988292384, 3988292384, 3988292384, 3988292384]), lambda x, y: xor(x >> 1, y * (x & 1)))), 4294967295) % {BORROWED} as h
  from t group by conv_id
), m as (
  select c.*, least(h, coalesce(f.own, 0)) as off from c left join (select conv_id as family, own from c) f using (family)
), r as (
  select m.conv_id, t.pos as depth, role, text from m join t on t.conv_id = m.family where t.pos <= m.off
  union all select m.conv_id, t.pos - h + off, role, text from m join t on t.conv_id = m.conv_id where t.pos > h
), p as (
  select conv_id, depth, list(sha256(role || chr(0) || text)) over (partition by conv_id order by depth) as prefix, strlen(text) as bytes from r
  union all select conv_id, 0, [], 0 from m
), o as (
  select *, min(conv_id) over (partition by depth, prefix) as owner, count(*) over (partition by depth, prefix) as n_convs from p
), n as (
  select o.*, u.owner as parent from o left join o u on u.conv_id = o.conv_id and u.depth = o.depth - 1 where o.owner = o.conv_id
), k as (
  select parent as owner, depth - 1 as depth, count(*) as n_children from n where depth > 0 group by all
), s as (
  select a.owner, a.depth, count(*) filter (k.n_children is null) as n_leaves, sum((n.n_convs - 1) * n.bytes) as saved_tokens
  from n left join k on k.owner = n.conv_id and k.depth = n.depth join o a on a.conv_id = n.conv_id and a.depth <= n.depth group by all
), e as (
  select owner, depth, string_agg(conv_id::varchar, ',' order by conv_id) as ids from o where depth = (select max(depth) from p where p.conv_id = o.conv_id) group by all
)
select n.conv_id, n.depth::bigint as depth, n.parent as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, n_leaves, saved_tokens::bigint as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from n left join k on k.owner = n.conv_id and k.depth = n.depth join s on s.owner = n.conv_id and s.depth = n.depth left join e on e.owner = n.conv_id and e.depth = n.depth
"""
