"""Trie of conversation prefixes by truncation peeling.

A node of depth d is a distinct sequence of the first d turns of some conversation. Peeling starts
at the greatest depth: conversations that end there are grouped by their whole sequence; then the
last turn is stripped, the nodes that survive and the conversations that newly end at this depth are
grouped again, and so on to the top. A node is discovered and aggregated in the same step: members,
children, leaves and saved tokens of its subtree come from what merged into it.

A sequence is known by a 128-bit code of its turns and their places (exclusive or of a hash for each
turn, so codes of prefixes are running values), and conversations of equal sequences count as one
with a weight. A round of shuffles for each depth would cost as many rounds as the longest
conversation has turns, so the trie is cut first:

* a node is heavy if over ``SEQUENCES`` different sequences or over ``STEPS`` turns lie under it;
* the subtrees right under heavy nodes are bounded by that, and each is peeled in one task;
* heavy nodes, few as they are, take what their light children have summed up. They fall into
  chains (the path of one of their conversations, drawn by hash, from the first node that has no
  lower draw); sums go up one nesting level of chains at a time, with a running sum along each
  chain. Levels grow with the logarithm of the heavy nodes' number, not with depth.

Nothing is left out: every heavy and light node is a row. Defined cases: turns are ordered by number,
those without a number first and equal numbers by a hash of role and text; null role and text are
empty; rows without conversation id belong to none; a repeated row is a turn of its own; a
conversation may have no turns (it is a member of the root); without conversations there is no row.
Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.llm.stage import quoted, written

#: Sequences and turns in a subtree that one task peels, at most.
SEQUENCES, STEPS = 512, 65_536
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["d", "k1", "k2"]


def _long(hex_: Column) -> Column:
    return F.conv(hex_, 16, -10).cast("long")


def _running(df: DataFrame, key: str, order: list[str], values: dict[str, Column], join) -> DataFrame:
    """``df`` with running values in an order within each key, which may span many tasks.

    ``values``: name -> aggregate over the rows so far; ``join`` puts a value and that of the key's earlier
    ranges together. Ranges of (key, order) are numbered; only keys that go on from an earlier range get a carried value,
    one row a range at most.
    """
    columns = df.columns
    ranges = written(df.repartitionByRange(key, *[F.col(c).asc_nulls_first() for c in order]).withColumn("__part", F.spark_partition_id()), "turn-ranges")
    inner = Window.partitionBy("__part", key).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranges.groupBy(key, "__part").agg(*[v.alias(n) for n, v in values.items()], F.lit(0).alias("__0"))
    fold = {"sum": F.sum, "xor": F.bit_xor}[join]
    carried = whole.select(key, "__part", *[fold(n).over(earlier).alias(f"__{n}") for n in values], F.count("*").over(earlier).alias("__n")).filter("__n > 0")
    own = ranges.select("*", *[v.over(inner).alias(n) for n, v in values.items()]).join(F.broadcast(carried.drop("__n")), [key, "__part"], "left")
    put = (lambda a, b: a + b) if join == "sum" else (lambda a, b: a.bitwiseXOR(b))
    return own.select(*columns, *[put(F.col(n), F.coalesce(f"__{n}", F.lit(0))).alias(n) for n in values])


def steps(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, d, a, b, words): each conversation's turns numbered from 1, as a 128-bit hash and a number of words."""
    role, text = (F.coalesce(quoted(c), F.lit("")) for c in (role_col, text_col))
    code = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.select(quoted(conv_col).cast("long").alias("c"), quoted(turn_col).alias("turn"), code.alias("code"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).filter("c is not null")
    rows = written(rows.select("c", "turn", _long(F.substring("code", 1, 16)).alias("a"), _long(F.substring("code", 17, 16)).alias("b"), "words"), "turns")
    return _running(rows, "c", ["turn", "a", "b"], {"d": F.count("*")}, "sum").drop("turn")


class _Node:
    __slots__ = ("conv", "n", "children", "leaves", "saved", "ended", "at", "parent")

    def __init__(self, at: int):
        self.conv, self.n, self.children, self.leaves, self.saved, self.ended, self.at, self.parent = None, 0, 0, 0, 0, None, at, None


def peel(c, d, k1, k2, words, copies, last):
    """Nodes of one subtree, deepest first: (depth, nodes). Rows are whole paths below the subtree's parent, sorted by conversation and depth."""
    begin = np.flatnonzero(np.append(True, c[1:] != c[:-1])).tolist()
    top = int(d[0])
    ending = defaultdict(list)
    for s in begin:
        ending[int(last[s])].append(s)
    k1, k2, words, copies, c = (x.tolist() for x in (k1, k2, words, copies, c))
    alive: list[_Node] = []
    for depth in range(max(ending), top - 1, -1):
        nodes: dict[tuple[int, int], _Node] = {}
        for s in ending.get(depth, ()):
            row = s + depth - top
            node = nodes.setdefault((k1[row], k2[row]), _Node(s))
            node.n += copies[s]
            node.ended = c[s]
            node.conv = c[s] if node.conv is None else min(node.conv, c[s])
        for child in alive:
            row = child.at + depth - top
            child.parent = node = nodes.setdefault((k1[row], k2[row]), _Node(child.at))
            node.n += child.n
            node.children += 1
            node.leaves += child.leaves
            node.saved += child.saved
            node.conv = child.conv if node.conv is None else min(node.conv, child.conv)
        if alive:
            yield depth + 1, alive
        alive = list(nodes.values())
        for node in alive:
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * words[node.at + depth - top]
    yield top, alive


_ROW = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ended long, p1 long, p2 long"
_PATH = ["c", "d", "k1", "k2", "words", "copies", "last"]


def _peeled(batches):
    """Peel every subtree; its rows come together, sorted by subtree, conversation and depth."""
    names = [f.split()[0] for f in _ROW.split(", ")]

    def rows(t: pa.Table):
        path = [t.column(n).to_numpy() for n in _PATH]
        up = t.column("p1")[0].as_py(), t.column("p2")[0].as_py()
        for depth, nodes in peel(*path):
            for x in nodes:
                head = x.parent is None
                yield x.conv, depth, None if head else x.parent.conv, x.n, x.children, x.leaves, x.saved, x.ended, up[0] if head else None, up[1] if head else None

    out: list[tuple] = []
    kinds = [pa.int64()] * len(names)
    for group in _subtrees(batches):
        out += rows(group)
        if len(out) >= 8_192:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _subtrees(batches):
    held: list[pa.Table] = []
    key = None
    for b in batches:
        if not len(b):
            continue
        t = pa.Table.from_batches([b])
        r1, r2 = t.column("r1").to_numpy(), t.column("r2").to_numpy()
        cuts = [0, *(np.flatnonzero((r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])) + 1).tolist(), len(t)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            own = int(r1[x]), int(r2[x])
            if own != key and held:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            key = own
            held.append(t.slice(x, y - x))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _runs(batches):
    """Ids of one sequence that come after one another, comma-joined, with the first of them."""
    for b in batches:
        if not len(b):
            continue
        key = [b.column(k).to_numpy() for k in range(3)]
        ids = b.column(3).to_pylist()
        new = np.zeros(len(b) - 1, bool)
        for x in key:
            new |= x[1:] != x[:-1]
        cuts = np.array([0, *(np.flatnonzero(new) + 1).tolist(), len(b)])
        texts = [",".join(map(str, ids[x:y])) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array(x[cuts[:-1]]) for x in key), pa.array([ids[x] for x in cuts[:-1]], pa.int64()), pa.array(texts, pa.string())], [*KEY, "c", "ids"])


def _digests(batches):
    """SHA-256 over the pieces of each sequence, which come in order; the first id names it."""
    key = first = state = None
    for b in batches:
        done = []
        for *own, c, ids in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            if own == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                done.append((first, state.hexdigest()))
            key, first, state = own, c, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int64()), pa.array([x for _, x in done], pa.string())], ["ended", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["ended", "ends_sha256"])


def _chain_sums(heavy: DataFrame) -> DataFrame:
    """``heavy`` (key, p1, p2, chain, leaves, saved of a node's own) with leaves and saved summed over subtrees."""
    tops = heavy.groupBy("chain").agg(F.min("d").alias("d"))
    above = heavy.select((F.col("d") + 1).alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("chain").alias("up"))
    upper = heavy.select("chain", "d", "p1", "p2").join(tops, ["chain", "d"]).join(above, ["d", "p1", "p2"], "left").select("chain", "up")
    upper = written(upper, "chains")
    levels = [written(upper.filter("up is null").select("chain"), "chain-level")]
    while not levels[-1].isEmpty():
        levels.append(written(upper.join(levels[-1].withColumnRenamed("chain", "up"), "up").select("chain"), "chain-level"))
    done, parts = None, []
    down = Window.partitionBy("chain").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    for level in reversed(levels[:-1]):
        own = heavy.join(level, "chain", "left_semi")
        if done is not None:
            attached = done.join(tops, ["chain", "d"]).groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("leaves").alias("__l"), F.sum("saved").alias("__s"))
            own = own.join(attached, KEY, "left").withColumns({"leaves": F.col("leaves") + F.coalesce("__l", F.lit(0)), "saved": F.col("saved") + F.coalesce("__s", F.lit(0))}).drop("__l", "__s")
        done = written(own.withColumns({"leaves": F.sum("leaves").over(down), "saved": F.sum("saved").over(down)}), "chain-sums")
        parts.append(done)
    return reduce(DataFrame.unionByName, parts) if parts else heavy


def trie(path: DataFrame, convs: DataFrame | None = None, *, sequences: int = SEQUENCES, turns: int = STEPS) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``path``: what :func:`steps` returns, or like it; ``convs``: (c), all conversations, if some have no turns.
    """
    g1, g2 = F.xxhash64("d", "a", "b"), F.xxhash64("b", "d", "a", F.lit(1))
    coded = path.select("c", F.col("d").cast("long").alias("d"), "words", g1.alias("g1"), g2.alias("g2"))
    coded = _running(coded, "c", ["d"], {"k1": F.bit_xor("g1"), "k2": F.bit_xor("g2")}, "xor")
    coded = written(coded.select("c", *KEY, "words", F.col("k1").bitwiseXOR(F.col("g1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("g2")).alias("p2")), "paths")
    ends = coded.groupBy("c").agg(F.max(F.struct(*KEY)).alias("e")).select("c", *[F.col(f"e.{k}").alias(k) for k in KEY])
    if convs is not None:
        ends = convs.select("c").distinct().join(ends, "c", "left").fillna(0, KEY)
    ends = written(ends, "ends")
    whole = written(ends.groupBy(*KEY).agg(F.min("c").alias("c"), F.count("*").alias("copies")), "sequences")
    rows = written(coded.join(whole.select("c", "copies", F.col("d").alias("last")), "c"), "sequence-paths")
    # heavy nodes, the root first
    weight = rows.groupBy(*KEY).agg(F.count("*").alias("sequences"), F.sum(F.col("last") - F.col("d")).alias("below"))
    keys = written(weight.filter((F.col("sequences") > sequences) | (F.col("below") > turns)).select(*KEY), "heavy-keys")
    chain = F.min(F.struct(F.xxhash64("c").alias("h"), "c"))["c"]
    ended = F.max(F.when(F.col("last") == F.col("d"), F.col("c")))
    common = [F.sum("copies").alias("n"), F.min("c").alias("conv"), chain.alias("chain"), ended.alias("ended")]
    marked = rows.join(keys, KEY, "left_semi")
    nodes = marked.groupBy(*KEY).agg(*common, F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("words").alias("words"))
    root = whole.withColumn("last", F.col("d")).withColumn("d", F.lit(0).cast("long")).groupBy("d").agg(*common)
    root = root.select("d", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "n", "conv", "chain", "ended", *[F.lit(None).cast("long").alias(p) for p in ("p1", "p2")], F.lit(0).cast("long").alias("words"))
    nodes = written(root.unionByName(nodes), "heavy")
    # light subtrees: what lies under a path's last heavy node
    deep = written(marked.groupBy("c").agg(F.max("d").alias("deep")), "deep")
    light = written(rows.join(deep, "c", "left").filter(F.col("d") > F.coalesce("deep", F.lit(0))), "light")
    first = light.filter(F.col("d") == F.coalesce("deep", F.lit(0)) + 1).select("c", F.col("k1").alias("r1"), F.col("k2").alias("r2"))
    sorted_ = light.join(written(first, "subtrees"), "c").select("r1", "r2", "p1", "p2", *_PATH).repartition("r1", "r2").sortWithinPartitions("r1", "r2", "c", "d")
    peeled = written(sorted_.mapInArrow(_peeled, _ROW), "peeled")
    tops = peeled.filter("p1 is not null").withColumn("d", F.col("depth") - 1)
    gained = tops.groupBy("d", F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    inner = nodes.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("heavies"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    own = nodes.join(gained, KEY, "left").join(inner, KEY, "left").withColumn("children", zero("children") + zero("heavies")).drop("heavies")
    own = own.withColumns({"leaves": F.when(F.col("children") == 0, 1).otherwise(zero("leaves")), "saved": zero("saved") + (F.col("n") - 1) * F.col("words")})
    summed = _chain_sums(written(own, "heavy-own"))
    up = nodes.select(F.col("d").alias("ud"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ended"]
    named = summed.select("p1", "p2", (F.col("d") - 1).alias("ud"), F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ended")
    named = named.unionByName(tops.withColumnRenamed("d", "ud").select(*named.columns)).join(up, ["ud", "p1", "p2"], "left").withColumn("parent_conv_id", F.col("parent"))
    every = peeled.filter("p1 is null").select(*columns).unionByName(named.select(*columns))
    # ids of the conversations that end at a node: sorted by ranges, so that a large group's ids are joined in many tasks
    runs = ends.repartitionByRange(*KEY, "c").sortWithinPartitions(*KEY, "c").select(*KEY, "c").mapInArrow(_runs, "d long, k1 long, k2 long, c long, ids string")
    digests = written(runs.repartition(*KEY).sortWithinPartitions(*KEY, "c").mapInArrow(_digests, "ended long, ends_sha256 string"), "ends-digests")
    return every.join(digests, "ended", "left").select(*columns[:-1], F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, **names) -> DataFrame:
    """The trie of a table of turns; ``names`` as of :func:`steps`."""
    return trie(steps(turns, **names))
