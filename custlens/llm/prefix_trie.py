"""Trie of conversation prefixes with subtree totals by centroid decomposition.

Conversations are sequences of turns; every distinct sequence of their first d
turns is a node of depth d, hung below the sequence of the first d - 1.  A node
is named by its smallest member and its depth.

Totals over subtrees are rolled up by decomposing the forest of parent edges.
Components start as whole tries.  In each round every component is cut at its
centroid: the deepest node with at least half of the component's weight at or
below it (a node weighs the conversations that pass it, so the weight below a
node is known from one group-by).  The centroid's total inside the component is
aggregated and added to the nodes on its path to the component's top; the
subtrees below it and what remains above become components of at most half the
weight.  So the rounds grow with the logarithm of the table however long a
conversation is.  Components of few nodes, many together in one bounded group,
are finished by the same recursion inside a task.

Scale: turns are numbered and prefixes hashed in stretches of a conversation, so a
long conversation is spread; nodes that hold many conversations are aggregated
in shares; ancestors are looked up by (conversation, depth), a stretch of nodes
at a time, so no key is hot.  Prefixes are told apart by 128 bits.

Defined results: turns are ordered by turn (null first), then role, then text;
a null role or text is empty; rows with a null conversation id belong to none and
are left out; equal rows are turns of their own; an empty table has no nodes;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custlens.llm.common import shuffle_partitions, written

STRETCH = 1024  # turns of a conversation that are handled together
SHARES = 64  # shares of a hot node's conversations
HASH = ["h1", "h2", "h3", "h4"]


def _kept(df: DataFrame) -> DataFrame:
    return written(df.coalesce(shuffle_partitions(df)))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv, pos, role, text): turns numbered from 1 in their order."""
    src = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv IS NOT NULL")
    # a null turn comes first, so its stretch is the lowest number there is
    src = src.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 62))))
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = src.groupBy("conv", "stretch").agg(F.count("*").alias("n")).withColumn(
        "start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("conv", "stretch").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    at = src.withColumn("at", F.row_number().over(inside))
    return at.join(starts, ["conv", "stretch"]).select("conv", (F.col("start") + F.col("at")).alias("pos"), "role", "text")


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, d, h1..h4, p1..p4, bytes, len) for every prefix of (conv, d, role,
    text): the hash of its first d turns and of its first d - 1; ``len`` is the
    conversation's number of turns.  ``convs`` lists all conversations.

    A prefix is the sum of hashes of (depth, role, text), in four parts of 32
    bits, so sums of stretches add up.
    """
    digest = F.md5(F.concat_ws("\n", "d", F.octet_length("role").cast("string"), "role", "text"))
    part = lambda i: F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")
    src = rows.select("conv", "d", F.octet_length("text").cast("long").alias("bytes"),
                      F.floor(F.col("d") / STRETCH).alias("stretch"), *(part(i).alias(f"g{i + 1}") for i in range(4)))
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = src.groupBy("conv", "stretch").agg(F.count("*").alias("n"), *(F.sum(f"g{i}").alias(f"s{i}") for i in range(1, 5)))
    starts = sums.select("conv", "stretch", *(F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)).alias(f"s{i}") for i in range(1, 5)))
    length = convs.join(sums.groupBy("conv").agg(F.sum("n").alias("n")), "conv", "left").select(
        "conv", F.coalesce("n", F.lit(0)).alias("len"))
    upto = Window.partitionBy("conv", "stretch").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    run = src.select("*", *(F.sum(f"g{i}").over(upto).alias(f"r{i}") for i in range(1, 5))).join(starts, ["conv", "stretch"])
    run = run.select("conv", "d", *((F.col(f"s{i}") + F.col(f"r{i}")).alias(f"h{i}") for i in range(1, 5)),
                     *((F.col(f"s{i}") + F.col(f"r{i}") - F.col(f"g{i}")).alias(f"p{i}") for i in range(1, 5)), "bytes")
    spread = length.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"len div {STRETCH}"))))
    run = run.withColumn("stretch", F.floor(F.col("d") / STRETCH)).join(spread, ["conv", "stretch"]).drop("stretch")
    zero = [F.lit(0).cast("long").alias(c) for c in ("d", *HASH, "p1", "p2", "p3", "p4", "bytes")]
    return run.unionByName(length.select("conv", *zero, "len"))


def nodes_of(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, owners).  nodes: (c, d, pc, n, w, bytes) with the smallest member,
    the parent's smallest member, members, weight at or below, bytes of the last
    text; owners: (conv, d, owner) names the node of every prefix."""
    share = F.pmod(F.xxhash64("conv"), F.lit(SHARES)).alias("share")
    below = (F.col("len") - F.col("d") + 1).cast("long")
    parts = found.groupBy("d", *HASH, share).agg(F.min("conv").alias("low"), F.count("*").alias("n"), F.sum(below).alias("w"),
                                                 F.first("bytes").alias("bytes"), *(F.first(f"p{i}").alias(f"p{i}") for i in range(1, 5)))
    whole = parts.groupBy("d", *HASH).agg(F.min("low").alias("c"), F.sum("n").alias("n"), F.sum("w").alias("w"),
                                          F.first("bytes").alias("bytes"), *(F.first(f"p{i}").alias(f"p{i}") for i in range(1, 5)))
    whole = _kept(whole)
    named = parts.select("d", *HASH, "share").join(whole.select("d", *HASH, "c"), ["d", *HASH])
    owners = found.select("conv", "d", *HASH, share).join(named, ["d", *HASH, "share"]).select(
        "conv", "d", F.col("c").alias("owner"))
    # a parent has its child's smallest member among its own: the parent is that member's prefix
    owners = _kept(owners)
    parent = owners.select(F.col("conv").alias("c"), (F.col("d") + 1).alias("d"), F.col("owner").alias("pc"))
    return whole.join(parent, ["c", "d"], "left").select("c", "d", "pc", "n", "w", "bytes"), owners


class Component:
    """Centroid decomposition of trees whose nodes (parents first) fit into a task."""

    def __init__(self, parent: list[int], weight: list[int], values: list[tuple[int, ...]]):
        self.parent, self.weight = parent, weight  # weight: at or below, inside the component
        self.total = [list(v) for v in values]
        self.value = values
        self.children = defaultdict(list)
        for i, p in enumerate(parent):
            if p >= 0:
                self.children[p].append(i)

    def roll_up(self) -> list[list[int]]:
        """Totals over the subtree of each node: a centroid's total, aggregated
        over its part of the component, is added on the way up to the top."""
        gone = [False] * len(self.parent)
        todo = [i for i, p in enumerate(self.parent) if p < 0]
        while todo:
            top = todo.pop()
            half, x = self.weight[top], top
            while True:  # the deepest node with half of the weight
                below = [c for c in self.children[x] if not gone[c] and 2 * self.weight[c] >= half]
                if not below:
                    break
                x = below[0] if len(below) == 1 else max(below, key=self.weight.__getitem__)
            part, stack = [0] * len(self.value[x]), [x]
            while stack:
                v = stack.pop()
                part = [a + b for a, b in zip(part, self.value[v])]
                stack += [c for c in self.children[v] if not gone[c]]
            self.total[x] = [t + a - b for t, a, b in zip(self.total[x], part, self.value[x])]
            weight, v = self.weight[x], x
            while v != top:
                v = self.parent[v]
                self.weight[v] -= weight
                self.total[v] = [a + b for a, b in zip(self.total[v], part)]
            gone[x] = True
            todo += [c for c in self.children[x] if not gone[c]]
            if x != top:
                todo.append(top)
        return self.total


def subtree_totals(nodes: DataFrame, owners: DataFrame, values: list[str], component_nodes: int = 8192) -> DataFrame:
    """(c, d, ``values``): sums of the values over the subtree of each node of
    (c, d, pc, w, values); components of at most ``component_nodes`` nodes are
    finished inside a task."""
    # tc, td: the component's top; t_*: sums so far
    state = nodes.withColumns({"td": F.lit(0).cast("long"), "done": F.lit(False),
                               **{f"t_{v}": F.col(v).cast("long") for v in values}})
    root = nodes.where("d = 0").agg(F.min("c").alias("tc"))
    state = _kept(state.crossJoin(F.broadcast(root)))
    while True:
        big = state.where("NOT done").groupBy("tc", "td").agg(F.count("*").alias("nodes"), F.max("w").alias("half")).where(
            F.col("nodes") > component_nodes)
        big = _kept(big)
        if not big.count():
            break
        state = _cut_round(state, big, owners, values)
    size = state.count()
    groups = max(1, size // (4 * component_nodes), min(shuffle_partitions(state), size // 512))
    small = state.where("NOT done").withColumn("grp", F.pmod(F.xxhash64("tc", "td"), F.lit(groups)))
    names = ["c", "d", *values]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names])

    def finish(table: pa.Table) -> pa.Table:
        t = table.sort_by("d").to_pydict()
        place = {key: i for i, key in enumerate(zip(t["c"], t["d"]))}
        parent = [-1 if (c, d) == (tc, td) else place[(p, d - 1)]
                  for c, d, p, tc, td in zip(t["c"], t["d"], t["pc"], t["tc"], t["td"])]
        own = list(zip(*(t[v] for v in values)))
        found = Component(parent, list(t["w"]), own).roll_up()
        # sums of parts cut off in earlier rounds are in t_*, beyond the node's own value
        out = [[f + s - o for f, s, o in zip(*row)] for row in zip(found, zip(*(t[f"t_{v}"] for v in values)), own)]
        return pa.table([t["c"], t["d"], *map(list, zip(*out))] if out else [[]] * len(names), schema=_arrow(names))

    cols = ["c", "d", "pc", "w", "tc", "td", *values, *(f"t_{v}" for v in values)]
    done = state.where("done").select("c", "d", *(F.col(f"t_{v}").alias(v) for v in values))
    return done.unionByName(small.select("grp", *cols).groupBy("grp").applyInArrow(finish, schema))


def _arrow(names: list[str]) -> pa.Schema:
    return pa.schema([(n, pa.int64()) for n in names])


def _cut_round(state: DataFrame, big: DataFrame, owners: DataFrame, values: list[str]) -> DataFrame:
    """Cuts every component of ``big`` (tc, td, half) at its centroid."""
    stretch = F.floor(F.col("d") / STRETCH).alias("stretch")
    # the components' numbers, in shares: a component may hold most nodes
    share = F.pmod(F.xxhash64("c", F.floor(F.col("d") / STRETCH)), F.lit(SHARES)).cast("int")
    spread = lambda t: t.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    open_ = state.where("NOT done").withColumn("share", share)
    inside = open_.join(spread(big.select("tc", "td", "half")), ["tc", "td", "share"])
    centre = inside.where(2 * F.col("w") >= F.col("half")).groupBy("tc", "td").agg(
        F.max_by(F.struct("c", "d", "w"), F.col("d")).alias("x")).select(
        "tc", "td", F.col("x.c").alias("xc"), F.col("x.d").alias("xd"), F.col("x.w").alias("xw"))
    centre = _kept(centre)
    # which stretches of a chain of nodes (c, .) lie below the centroid, and under which child
    at = open_.join(spread(centre), ["tc", "td", "share"])
    runs = at.select("c", stretch, "tc", "td", "xc", "xd").distinct()
    own = owners.select(F.col("conv").alias("c"), F.col("d").alias("xd"), F.col("owner").alias("at_x"))
    child = owners.select(F.col("conv").alias("c"), (F.col("d") - 1).alias("xd"), F.col("owner").alias("under"))
    runs = runs.join(own, ["c", "xd"]).where(F.col("at_x") == F.col("xc")).join(child, ["c", "xd"], "left").select(
        "c", "stretch", "tc", "td", "xc", "xd", "under")
    below = state.withColumn("stretch", stretch).join(runs, ["c", "stretch", "tc", "td"], "left")
    below = _kept(below.withColumn("in", ~F.col("done") & F.coalesce(F.col("d") >= F.col("xd"), F.lit(False))))
    # the centroid's total goes to the path up to the top
    part = below.where("in").groupBy("tc", "td").agg(*(F.sum(v).alias(f"a_{v}") for v in values))
    path = centre.join(part, ["tc", "td"]).withColumn("stretch", F.explode(F.sequence(
        F.floor(F.col("td") / STRETCH), F.floor(F.col("xd") / STRETCH))))
    chain = owners.select(F.col("conv").alias("xc"), "d", "owner", stretch)
    path = path.join(chain, ["xc", "stretch"]).where("d >= td AND d <= xd").select(
        F.col("owner").alias("c"), "d", F.col("xw"), F.lit(True).alias("on"), (F.col("d") == F.col("xd")).alias("is_x"),
        *(f"a_{v}" for v in values))
    step = below.join(path, ["c", "d"], "left")
    on, is_x = F.coalesce("on", F.lit(False)), F.coalesce("is_x", F.lit(False))
    # sums on the path take the whole part; the centroid's own value is in its sum already
    total = {f"t_{v}": F.when(on, F.col(f"t_{v}") + F.col(f"a_{v}") - F.when(is_x, F.col(v)).otherwise(0)).otherwise(
        F.col(f"t_{v}")) for v in values}
    return _kept(step.select(
        "c", "d", "pc", "n", *values,
        F.when(on & ~is_x, F.col("w") - F.col("xw")).otherwise(F.col("w")).alias("w"),
        F.when(F.col("in") & ~is_x, F.col("under")).otherwise(F.col("tc")).alias("tc"),
        F.when(F.col("in") & ~is_x, F.col("xd") + 1).otherwise(F.col("td")).alias("td"),
        (F.col("done") | is_x).alias("done"), *(e.alias(n) for n, e in total.items())))


def ends_digests(found: DataFrame, owners: DataFrame) -> DataFrame:
    """(c, d, ends): SHA-256 of the ids of the conversations that end at a node,
    ascending, comma-joined.  Ids are first joined in ranges of 4,096 numbers;
    a task then streams the ranges of its nodes through the digest."""
    last = found.where(F.col("d") == F.col("len")).select("conv", "d").join(owners, ["conv", "d"])
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    ranges = last.groupBy(F.col("owner").alias("c"), "d", F.floor(F.col("conv") / 4096).alias("range")).agg(ids.alias("ids"))
    ordered = ranges.repartition(shuffle_partitions(found), "c", "d").sortWithinPartitions("c", "d", "range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, out = None, None, []
        for b in batches:
            for c, d, text in zip(*(b.column(n).to_pylist() for n in ("c", "d", "ids"))):
                if node != (c, d):
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (c, d), hashlib.sha256()
                    digest.update(text.encode())
                else:
                    digest.update(b"," + text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["c", "d", "ends"])
                out = []
        if node:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip((*node, digest.hexdigest()))], names=["c", "d", "ends"])

    return ordered.mapInArrow(run, "c long, d long, ends string")


def prefix_trie(rows: DataFrame, convs: DataFrame, component_nodes: int = 8192) -> DataFrame:
    """Nodes of the trie over (conv, d, role, text), d counted from 1 without
    gaps; ``convs``: (conv) of all conversations, also those without turns.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256); ``saved_tokens`` sums (members - 1) x bytes of a
    node's last text over its subtree.
    """
    found = _kept(prefixes(rows, convs))
    nodes, owners = nodes_of(found)
    children = nodes.where("d > 0").groupBy(F.col("pc").alias("c"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    nodes = _kept(nodes.join(children, ["c", "d"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    valued = nodes.select("c", "d", "pc", "n", "w", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
                          ((F.col("n") - 1) * F.col("bytes")).alias("saved"))
    totals = subtree_totals(valued, owners, ["leaves", "saved"], component_nodes)
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(totals, ["c", "d"]).join(ends_digests(found, owners), ["c", "d"], "left").select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("pc").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(none)).alias("ends_sha256"))


def branched(turns: DataFrame, head: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, convs) for ``prefix_trie``: every conversation ``conv`` starts with
    the first ``head`` turns of conversation ``base`` (Columns over ``conv``), all
    if it has fewer and none if there is none, and goes on with its own turns
    after its first ``head``."""
    own = _kept(numbered(turns))
    lengths = own.groupBy("conv").agg(F.max("pos").alias("n"))
    convs = lengths.select("conv", base.cast("long").alias("base"), head.cast("long").alias("head"))
    convs = _kept(convs.join(lengths.select(F.col("conv").alias("base"), "n"), "base", "left").select(
        "conv", "base", "head", F.least("head", F.coalesce("n", F.lit(0))).alias("lead")))
    starts = own.select(F.col("conv").alias("base"), "pos", "role", "text")
    need = convs.where("lead > 0").select("conv", "base", F.explode(F.sequence(F.lit(1).cast("long"), F.col("lead"))).alias("pos"))
    first = need.join(starts, ["base", "pos"]).select("conv", F.col("pos").alias("d"), "role", "text")
    # the join key of own turns is (conversation, stretch), so a long one is spread
    part = lambda c: F.floor(c / STRETCH)
    wide = convs.join(lengths, "conv").withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {STRETCH}"))))
    rest = own.withColumn("stretch", part(F.col("pos"))).join(wide.select("conv", "stretch", "head", "lead"), ["conv", "stretch"])
    rest = rest.where("pos > head").select("conv", (F.col("pos") - F.col("head") + F.col("lead")).alias("d"), "role", "text")
    return first.unionByName(rest), convs.select("conv")
