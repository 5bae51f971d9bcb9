"""URL filters by a path-template tree, in DataFrame functions only.

Each host has a tree of path templates. Segments that look like identifiers (digits, long hexadecimal) are
wildcards from the start; then, from the root on, a branch with many children of few pages each has its children
generalised to a wildcard, down to the deepest. A branch of fewer than ``CHILDREN`` templates cannot hold one that is wide and is
passed over with all below it, and where all templates of a branch go the same way, it goes on where they part; so rounds are
as many as such branchings are nested, not as paths are deep. Pages decided by a rule label their
templates and all branches above. Sibling branches, at any level, whose labelled shares do not differ (a
two-proportion z-test) are merged into their parent's wildcard, which also stands for siblings without labels.

A template has evidence if ``LABELLED`` of its own pages are labelled or a merged wildcard above stands for it.
It is rejected when its share of blocked pages reaches ``PURITY``: shares are smoothed from the root on, each
branch by that of what stands above it. In a merged wildcard, pages of siblings without labels count as allowed ones by
``UNDECIDED`` each: rules that only block say little of what they leave alone, so blocked pages must outweigh it. Everything without evidence is allowed; one labelled branch alone says nothing of its siblings.

Only distinct templates with counts are grouped and compared, after map-side sums; pages meet them in one
join, whose template side has one row for each key.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and is allowed;
repeated pages are judged alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwise.llm.common import stored, table

#: Fixed values: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: What an undecided page counts as evidence of an allowed one.
UNDECIDED = 0.25
#: A branch with so many children of at most so many pages on average has variable children.
CHILDREN, PAGES_EACH = 8, 3
PRIOR, PURITY, LABELLED, Z = 2.0, 0.8, 5, 1.64


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    at = F.instr(url, "://")
    rest = F.expr("substring(__url, instr(__url, '://') + 3)")
    some = F.coalesce(at > 0, F.lit(False))
    host = F.when(some, F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), upper, upper.lower())).otherwise("")
    path = F.when(some, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one text, and its verdict; nulls if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def segments(path: str) -> Column:
    """The segments of a path, identifiers as wildcards."""
    cut = F.filter(F.split(F.col(path), "/"), lambda x: x != "")
    return F.transform(cut, lambda x: F.when(x.rlike(r"\d|^[0-9a-fA-F]{16,}$"), F.lit("*")).otherwise(x))


def _shared(lo: Column, hi: Column) -> Column:
    """How many segments two templates have in common from the root on."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("same"))
    pairs = F.zip_with(lo, hi, lambda a, b: a.eqNullSafe(b))
    return F.aggregate(pairs, start, lambda s, x: F.struct((s["n"] + (s["same"] & x).cast("int")).alias("n"), (s["same"] & x).alias("same")))["n"]


def generalised(templates: DataFrame, children: int = CHILDREN, pages_each: int = PAGES_EACH, scratch: list[str] | None = None) -> DataFrame:
    """templates: host, own (segments as found), pages. Adds tree: the segments after generalisation, level by level.

    Written tables are added to scratch.
    """
    names = templates.columns
    done, left = None, templates.withColumn("tree", F.col("own")).withColumn("above", F.array().cast("array<string>"))
    while True:
        # branches that may be wide, and where their templates part
        groups = left.groupBy("host", "above").agg(F.count("*").alias("many"), F.min("tree").alias("lo"), F.max("tree").alias("hi"))
        groups = groups.select("host", "above", "many", F.slice("lo", 1, _shared(F.col("lo"), F.col("hi"))).alias("part"))
        split = left.join(groups, ["host", "above"])
        out = split.where((F.col("many") < children) | (F.size("tree") <= F.size("part"))).select(*names, "tree")
        go = split.where((F.col("many") >= children) & (F.size("tree") > F.size("part"))).withColumn("here", F.get("tree", F.size("part")))
        nodes = go.where("here <> '*'").groupBy("host", "part", "here").agg(F.sum("pages").alias("pages"))
        wide = nodes.groupBy("host", "part").agg(F.count("*").alias("n"), F.sum("pages").alias("pages")).where((F.col("n") >= children) & (F.col("pages") <= pages_each * F.col("n")))
        star = F.concat(F.col("part"), F.array(F.lit("*")), F.slice("tree", F.size("part") + 2, F.greatest(F.size("tree") - F.size("part") - 1, F.lit(0))))
        next_ = go.join(wide.select("host", "part", F.lit(True).alias("wide")), ["host", "part"], "left").withColumn("tree", F.when(F.col("wide"), star).otherwise(F.col("tree")))
        next_ = next_.select(*names, "tree", F.slice("tree", 1, F.size("part") + 1).alias("above"), F.lit(True).alias("open"))
        both = stored(next_.unionByName(out.withColumn("open", F.lit(False)), allowMissingColumns=True), scratch)
        left, closed = both.where("open").drop("open"), both.where("not open").select(*names, "tree")
        done = closed if done is None else done.unionByName(closed)
        if left.isEmpty():
            return done


def _node(level: str) -> Column:
    """128 bits that name the first segments of a tree, with their number."""
    upto = F.expr(f"slice(tree, 1, {level})")
    return F.struct(F.xxhash64(upto).alias("x"), F.xxhash64(F.lit("node"), F.expr(level), upto).alias("y"))


def branches(leaf: DataFrame, labelled: int = LABELLED, z: float = Z, undecided: float = UNDECIDED) -> DataFrame:
    """leaf: host, tree, bad, good, free. host, node, bad, n, alike of each branch; wild_bad, wild_n of its siblings' wildcard, null if none.

    n is the number of labelled pages, null without any; wild_n also weighs undecided pages of siblings without labels.
    """
    levels = F.explode(F.sequence(F.lit(0), F.size("tree")))
    rows = leaf.select("host", "tree", "bad", "good", "free", levels.alias("level"))
    rows = rows.select("host", _node("level").alias("node"), F.when(F.col("level") > 0, _node("greatest(level - 1, 0)")).alias("parent"), "bad", "good", "free")
    nodes = rows.groupBy("host", "node").agg(F.first("parent").alias("parent"), F.sum("bad").alias("bad"), F.sum(F.col("bad") + F.col("good")).alias("marked"), F.sum("free").alias("free"))
    nodes = nodes.withColumn("n", F.col("marked").cast("double"))
    # siblings with enough labels are compared with what all of them hold together
    known = nodes.where((F.col("marked") >= labelled) & F.col("parent").isNotNull())
    pool = known.groupBy("host", "parent").agg(F.sum("bad").alias("pool_bad"), F.sum("n").alias("pool_n"))
    share = (F.col("pool_bad") + PRIOR / 2) / (F.col("pool_n") + PRIOR)
    alike = known.join(pool, ["host", "parent"]).where(F.abs(F.col("bad") / F.col("n") - share) <= z * F.sqrt(share * (1 - share) / F.col("n")))
    wild = alike.groupBy("host", "parent").agg(F.sum("bad").alias("wild_bad"), F.sum("n").alias("some_n"), F.count("*").alias("several")).where("several > 1").drop("several")
    # the wildcard also stands for siblings without labels
    rest = nodes.where((F.col("marked") == 0) & F.col("parent").isNotNull()).groupBy("host", "parent").agg(F.sum(undecided * F.col("free")).alias("rest_n"))
    wild = wild.join(rest, ["host", "parent"], "left").select("host", "parent", "wild_bad", (F.col("some_n") + F.coalesce("rest_n", F.lit(0.0))).alias("wild_n"))
    found = nodes.join(wild, ["host", "parent"], "left").join(alike.select("host", "node", F.lit(True).alias("alike")), ["host", "node"], "left")
    # a branch without labels of its own adds nothing to what stands above it
    return found.select("host", "node", "bad", F.when(F.col("marked") > 0, F.col("n")).alias("n"), (F.col("alike").isNotNull() & F.col("wild_n").isNotNull()).alias("alike"), "wild_bad", "wild_n")


def rejected(trees: DataFrame, prior: float = PRIOR, purity: float = PURITY, labelled: int = LABELLED, z: float = Z, undecided: float = UNDECIDED) -> DataFrame:
    """trees: host, own, tree, blocked, allowed, pages. host, own, template, reject of each template as found."""
    leaf = trees.groupBy("host", "tree").agg(F.sum("blocked").alias("bad"), F.sum("allowed").alias("good"), F.sum(F.col("pages") - F.col("blocked") - F.col("allowed")).alias("free"))
    above = leaf.select("host", "tree", (F.col("bad") + F.col("good")).alias("own_n"), F.explode(F.sequence(F.lit(0), F.size("tree"))).alias("level")).withColumn("node", _node("level"))
    named = above.select("host", "node", "level", "own_n", F.xxhash64("tree").alias("leaf1"), F.xxhash64(F.lit("leaf"), "tree").alias("leaf2"))
    line = named.join(branches(leaf, labelled, z, undecided), ["host", "node"]).groupBy("host", "leaf1", "leaf2", "own_n").agg(F.sort_array(F.collect_list(F.struct("level", "bad", "n", "alike", "wild_bad", "wild_n"))).alias("line"))
    line = line.join(leaf.select("host", "tree", F.xxhash64("tree").alias("leaf1"), F.xxhash64(F.lit("leaf"), "tree").alias("leaf2")), ["host", "leaf1", "leaf2"])

    def smoothed(state: Column, bad: Column, n: Column) -> Column:
        """The share and number of labels after a branch; one that holds the same labels as what is above it adds nothing."""
        n = F.coalesce(n, state["n"])
        share = F.when(n == state["n"], state["share"]).otherwise((bad + prior * state["share"]) / (n + prior))
        return F.struct(share.alias("share"), n.alias("n"))

    start = F.struct(F.lit(0.5).alias("share"), F.lit(-1.0).alias("n"))
    steps = F.flatten(F.transform("line", lambda x: F.array(F.struct(x["wild_bad"].alias("bad"), x["wild_n"].alias("n")), F.struct(x["bad"].alias("bad"), x["n"].alias("n")))))
    share = F.aggregate(steps, start, lambda state, x: smoothed(state, x["bad"], x["n"]))["share"]
    wild = F.element_at(F.transform(F.filter("line", lambda x: x["wild_n"].isNotNull()), lambda x: x["level"]), -1)
    known = F.col("own_n") >= labelled
    found = line.withColumn("wild", F.when(F.exists("line", lambda x: x["wild_n"].isNotNull()), wild)).withColumn("merged", F.element_at("line", -1)["alike"])
    template = F.when(F.col("wild").isNotNull() & (F.col("merged") | ~known), F.expr("concat(slice(tree, 1, wild - 1), array('*'))")).otherwise(F.col("tree"))
    judged = found.select("host", "tree", template.alias("template"), ((known | F.col("wild").isNotNull()) & (share >= purity)).alias("reject"))
    return trees.select("host", "own", "tree").distinct().join(judged, ["host", "tree"]).select("host", "own", "template", "reject")


def filtered(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template of each row."""
    host, path = parts(F.col("__url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("__url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("decided"), segments("path").alias("own"))
    count = lambda v: F.sum((F.col("decided") == v).cast("long"))
    templates = rows.groupBy("host", "own").agg(F.count("*").alias("pages"), F.coalesce(count("block"), F.lit(0)).alias("blocked"), F.coalesce(count("allow"), F.lit(0)).alias("allowed"))
    templates = stored(templates)
    judged = rejected(stored(generalised(templates)))
    found = rows.join(judged, ["host", "own"], "left")
    method = F.when(F.col("reject"), F.lit("block")).otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("decided", method).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: host, path, the rule that decides, and the verdict."""
    return filtered(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
