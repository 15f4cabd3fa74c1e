"""Near-duplicate groups by HyperMinHash.

Each document's set of word shingles is cut into ``REGISTERS`` buckets by hash; a bucket
keeps its smallest value as a register of leading-zero count and ``MANTISSA`` bits. Empty
registers take the next full one (rotation), so short documents have whole sketches.
``ROWS`` neighbouring registers make a band; documents that share a band are candidates.
Candidates are confirmed on full shingle sets, so sketches decide what is looked at, never
what is linked. Before that, pairs of ``WHOLE`` shingles or more each have to pass on a
collision-corrected Jaccard estimate; sketches of smaller sets repeat registers, which makes
estimates far noisier than their number says, so smaller sets do without. Pairs of any size have to pass
an exact bound: shingles of two similar sets differ in few buckets, and registers show many of these.

To keep groups of copies from pairing with each other:

* documents with equal sets are one class from the start;
* first every class is confirmed against one representative, the smallest class of the
  band it shares most often; the links found so far give components;
* only bands that still hold two components are looked at pairwise, in blocks of bounded
  size; of bands with over ``HOT`` members, only those pairs that share a rare shingle of both
  prefixes: sets of s shingles as similar as wanted share one of the s - ceil(similarity * s) + 1
  that are rarest among all members of such bands. Pairs that share common shingles alone (in over
  ``COMMON`` members: a template's) meet through one representative of each set of common shingles,
  see :func:`common_members`; so a template that everyone shares brings nobody together, rows grow with
  members times sets of common shingles, not with pairs, and no pair is lost. A first look marks members that have a likely partner in another component; a
  second look, at these alone and with their texts, confirms pairs on full sets and leaves
  out those that links of the same block have joined meanwhile. A block gives at most as
  many links as it has members, and a pair is looked at in the first band it shares only.

At similarity 0.85 a pair misses all bands with probability under 1e-8. A pair of ``WHOLE`` shingles or more
each is passed over if its estimate is five standard errors too low, which befalls a pair right at the wanted similarity
with probability about 3e-7 (one far above it, less); smaller pairs are compared unless their registers rule them out for certain. Bands of up to ``HOT`` members
are compared pair by pair in blocks, larger ones by the shingles above; either way is exact.

A set with fewer words than a shingle is its whole word sequence; texts without words
(and null texts) have empty sets and are linked with nothing. Rows that repeat id and
text are one class like other copies. ``component_id`` is the smallest non-null id
reachable (null if there is none). An empty table gives an empty one. Only id and text are read: further columns may
have any name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.llm.components import components
from canopy.llm.stage import held, long_rows, quoted, released, written
from canopy.llm.text import LOWER, Prefix, blocks, mix, ngrams, spans

SHINGLE = 5
SIMILARITY = 85  # per cent
ROWS, BANDS = 6, 42
REGISTERS = ROWS * BANDS
MANTISSA = 10
#: Standard errors below the wanted similarity at which an estimate still passes.
SLACK = 5
#: Shingles from which on nearly all registers have values of their own, so that they scatter no more than as many draws.
WHOLE = 2 * REGISTERS
#: Members of a block of a band, about, and of a band from which on shingle prefixes decide who meets (below, a member is in 32 pairs of blocks at most,
#: which is less than it has prefix shingles).
BLOCK, HOT = 512, 16_384
#: Members of hot bands that a rare shingle is in, at most: its group has a few blocks.
COMMON = 2_048


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE):
    """Distinct shingle hashes by row: rows (sorted) and hashes (sorted in each row)."""
    low = LOWER[data]
    at, to, rows = spans(low, offsets)
    words = Prefix(low).of(at, to)
    n = len(offsets) - 1
    count = np.bincount(rows, minlength=n)
    grams, first = ngrams(words, rows, size)
    own = rows[first]
    for k in range(1, size):
        few = np.flatnonzero(count == k)
        if len(few):
            g, f = ngrams(words, rows, k)
            pick = count[rows[f]] == k
            grams, own = np.concatenate([grams, mix(g[pick] + np.uint64(k))]), np.concatenate([own, rows[f[pick]]])
    order = np.lexsort((grams, own))
    grams, own = grams[order], own[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (own[1:] != own[:-1])
    return own[new], grams[new]


def registers(own: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
    """n x REGISTERS of uint16: leading zeros and mantissa of each bucket's smallest value; rows without shingles are 0."""
    value = mix(grams ^ np.uint64(0xA0761D6478BD642F))
    cell = own * REGISTERS + (grams % np.uint64(REGISTERS)).astype(np.int64)
    order = np.lexsort((value, cell))
    cell, value = cell[order], value[order]
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    cell, value = cell[first], np.maximum(value[first], np.uint64(1))
    top = np.frexp(value.astype(np.float64))[1] - 1  # place of the highest bit (a carry at the very top only moves one value)
    top = np.where((np.uint64(1) << top.astype(np.uint64)) > value, top - 1, top)
    shifted = np.where(top >= MANTISSA, value >> np.maximum(top - MANTISSA, 0).astype(np.uint64), value << np.maximum(MANTISSA - top, 0).astype(np.uint64))
    code = ((63 - np.minimum(top, 63)) << MANTISSA) | (shifted & np.uint64((1 << MANTISSA) - 1)).astype(np.int64)
    table = np.full(n * REGISTERS, -1, np.int64)
    table[cell] = code
    table = table.reshape(n, REGISTERS)
    filled = table >= 0
    some = filled.any(1)
    # next full register to the right, around the end
    place = np.where(filled, np.arange(REGISTERS), 2 * REGISTERS)
    ahead = np.minimum.accumulate(np.concatenate([place, place + REGISTERS], 1)[:, ::-1], 1)[:, ::-1][:, :REGISTERS] % REGISTERS
    out = np.take_along_axis(table, ahead, 1)
    out[~some] = 0
    return out.astype(np.uint16)


#: Chance that registers of unlike buckets agree: their leading zeros match in one of three cases, then the mantissa has to.
CHANCE = 1.0 / (3 << MANTISSA)


def estimate(equal: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the number of equal registers, less the expected chance agreements."""
    return np.maximum(0.0, (equal / REGISTERS - CHANCE) / (1 - CHANCE))


def _lowest(similarity: int) -> float:
    j = similarity / 100
    return j - SLACK * (j * (1 - j) / REGISTERS) ** 0.5


def _signatures(batches):
    for b in batches:
        for lo, data, offsets in blocks(b.column(2)):
            n = len(offsets) - 1
            own, grams = shingles(data, offsets)
            count = np.bincount(own, minlength=n)
            key = np.zeros((n, 2), np.uint64)
            full = np.flatnonzero(count)
            if len(full):
                first = np.searchsorted(own, full)
                key[full, 0] = np.add.reduceat(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), first)
                key[full, 1] = np.bitwise_xor.reduceat(mix(grams + np.uint64(0x14057B7EF767814F)), first) ^ count[full].astype(np.uint64)
            sketch = registers(own, grams, n)
            fixed = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), b.column(1).slice(lo, n), pa.array(count.astype(np.int64)), fixed(key), fixed(sketch)], ["id", "th", "n", "key", "sketch"])


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def band_codes(sketch: np.ndarray) -> np.ndarray:
    """n x BANDS hashes of each band's registers."""
    x = sketch.astype(np.uint64).reshape(len(sketch), BANDS, ROWS)
    code = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sketch), BANDS)).copy()
    for k in range(ROWS):
        code = code * np.uint64(0x9E3779B97F4A7C15) + x[:, :, k]
    return mix(code).view(np.int64)


def _bands(batches):
    for b in batches:
        for lo in range(0, len(b), 4096):
            part = b.slice(lo, 4096)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), BANDS)), pa.array(band_codes(_sketches(part.column(1))).ravel())], ["c", "band"])


def _sets(packed: list[bytes]) -> list[np.ndarray]:
    texts = pa.array([zlib.decompress(z) for z in packed], pa.large_binary())
    out = []
    for _, data, offsets in blocks(texts):
        own, grams = shingles(data, offsets)
        out += np.split(grams, np.searchsorted(own, np.arange(1, len(offsets) - 1)))
    return out


def _confirmed(similarity: int):
    def run(batches):
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                left, right = _sets(part.column(2).to_pylist()), _sets(part.column(3).to_pylist())
                ok = []
                for x, y in zip(left, right, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= similarity * (len(x) + len(y) - both) and both > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ok)], ["a", "b", "ok"])

    return run


def _likely(group, band, own, diagonal, c, comp, size, sketch, similarity: int, banded: bool):
    """Pairs of rows of one group and different components that may be similar; if groups are of bands, each in the first band it shares.

    Sizes bound the similarity of any pair, and so do registers: an empty one equals the next, so one that differs from the next is its bucket's own,
    and where it also differs from the other set's, the bucket holds a shingle that only one of both sets has. Estimates are asked for pairs of large sets only. Groups of two parts hold pairs across them; pairs within a part belong to the group of that part alone.
    """
    lowest = _lowest(similarity)
    own_register = sketch != np.roll(sketch, -1, 1)
    left, right = [], []
    for d in range(1, len(c)):
        i = np.flatnonzero(group[d:] == group[:-d])
        if not len(i):
            break
        i = i[(comp[i] != comp[i + d]) & (c[i] != c[i + d]) & (diagonal[i] | (own[i] != own[i + d]))]
        i = i[100 * np.minimum(size[i], size[i + d]) >= similarity * np.maximum(size[i], size[i + d])]
        for s in range(0, len(i), 4096):
            p = i[s : s + 4096]
            q = p + d
            equal = sketch[p] == sketch[q]
            apart = (~equal & (own_register[p] | own_register[q])).sum(1)
            near = (100 + similarity) * apart <= (100 - similarity) * (size[p] + size[q])
            near &= (np.minimum(size[p], size[q]) < WHOLE) | (estimate(equal.sum(1)) >= lowest)
            p, q, equal = p[near], q[near], equal[near]
            if len(p) and not banded:
                left.append(p)
                right.append(q)
            elif len(p):
                first = equal.reshape(len(p), BANDS, ROWS).all(2).argmax(1)
                here = band_codes(sketch[p])[np.arange(len(p)), first] == band[p]
                left.append(p[here])
                right.append(q[here])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


_MEMBER = ("group", "band", "own", "diagonal", "c", "component", "size")


def _groups(batches):
    """Whole groups (rows come sorted by group): the numeric columns as arrays, the others as Arrow."""
    held = None
    for b in batches:
        if not len(b):
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        group = t.column(0).to_numpy()
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut)
    if held is not None and len(held):
        yield held


def _numbers(t: pa.Table):
    return [t.column(k).to_numpy() for k in _MEMBER]


def _marked(similarity: int, banded: bool):
    def run(batches):
        for t in _groups(batches):
            columns = _numbers(t)
            p, q = _likely(*columns, _sketches(t.column("sketch").combine_chunks()), similarity, banded)
            rows = np.unique(np.concatenate([p, q]))
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in columns], list(_MEMBER))

    return run


def _linked(similarity: int, banded: bool):
    def run(batches):
        for t in _groups(batches):
            columns = _numbers(t)
            sketch = _sketches(t.column("sketch").combine_chunks())
            p, q = _likely(*columns, sketch, similarity, banded)
            if not len(p):
                continue
            order = np.argsort(-np.array((sketch[p] == sketch[q]).sum(1)), kind="stable")
            c, comp = columns[4], columns[5]
            sets: dict[int, np.ndarray] = {}
            used = np.unique(np.concatenate([p, q]))
            packed = t.column("z").combine_chunks().take(pa.array(used)).to_pylist()
            sets = dict(zip(used.tolist(), _sets(packed), strict=True))
            parent: dict[int, int] = {}

            def root(x: int, parent=parent) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            a, b = [], []
            for i, j in zip(p[order].tolist(), q[order].tolist(), strict=True):
                # components of one band's groups meet here: what a link has joined needs no other
                u, v = root(int(comp[i])), root(int(comp[j]))
                if u == v:
                    continue
                x, y = sets[i], sets[j]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= similarity * (len(x) + len(y) - both):
                    parent[u] = v
                    a.append(int(c[i]))
                    b.append(int(c[j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _tokens(batches):
    """Every shingle of each class."""
    for b in batches:
        for lo in range(0, len(b), 64):
            part = b.slice(lo, 64)
            sets = _sets(part.column(1).to_pylist())
            own = np.repeat(part.column(0).to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], ["c", "token"])


def _dealt(members: DataFrame) -> DataFrame:
    """``members`` (group, n, c, component, ...) over the blocks of their group, each pair of blocks once."""
    sized = members.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")
    parts = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.xxhash64("band", F.least(k, own), F.greatest(k, own)).alias("group"), (k == own).alias("diagonal"))))
    return sized.select("c", "component", "band", own.alias("own"), parts.alias("g")).select("c", "component", "band", "own", "g.group", "g.diagonal")


def _dealt_across(members: DataFrame) -> DataFrame:
    """``members`` (band, c, component, side, near, far): blocks that each hold a part of a band's side 0 and a part of its side 1; near and far count a member's own and the other side."""
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("c"), parts("near"))
    block = lambda k: F.when(F.col("side") == 0, F.xxhash64("band", F.lit(-1), own, k)).otherwise(F.xxhash64("band", F.lit(-1), k, own))
    blocks_ = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), (parts("far") - 1).cast("long")), block))
    return members.select("c", "component", "band", F.col("side").alias("own"), blocks_.alias("group"), F.lit(False).alias("diagonal"))


class HotTokens:
    """Shingles of the members of hot bands: which are rare (in ``COMMON`` members or fewer), and which a prefix holds."""

    def __init__(self, hot: DataFrame, texts: DataFrame, similarity: int):
        self.similarity, self.each = similarity, written(hot.select("c", "component").distinct(), "hot-members")
        tokens = written(self.each.select("c").join(texts, "c").select("c", "z").mapInArrow(_tokens, "c bigint, token bigint"), "hot-shingles")
        counts = written(tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "hot-counts")
        rank = F.row_number().over(Window.partitionBy("c").orderBy("n", "token"))
        ranked = tokens.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("rank", rank)
        self.ranked = written(ranked, "hot-ranks")
        common = F.col("n") > COMMON
        code = lambda *x: F.bit_xor(F.when(common, F.xxhash64("token", *x)))
        shape = self.ranked.groupBy("c").agg(F.count("*").alias("size"), F.sum(common.cast("long")).alias("common"), code().alias("h1"), code(F.lit(1)).alias("h2"))
        self.shape = written(shape.withColumn("short", F.col("size") - F.ceil(F.lit(similarity) * F.col("size") / 100) + 1), "hot-shapes")

    def prefix(self, where) -> DataFrame:
        """(band, c, component) for each shingle of a member's prefix; ``band`` is the shingle."""
        held = self.ranked.join(self.shape.select("c", "short"), "c").filter((F.col("rank") <= F.col("short")) & where)
        return held.join(self.each, "c").select(F.col("token").alias("band"), "c", "component")


def prefix_members(tokens: HotTokens) -> DataFrame:
    """Members of hot bands by the rare shingles of their prefixes that two components share: band (the shingle), c, component, n."""
    prefix = written(tokens.prefix((F.col("n") > 1) & (F.col("n") <= COMMON)), "prefixes")
    shared = prefix.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    return written(prefix.join(written(shared.select("band", "n"), "shared-prefixes"), "band"), "prefix-members")


def common_members(tokens: HotTokens, confirmed) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For pairs that share common shingles only: links with representatives, and those who still have to meet others.

    Such a pair has no rare shingle in common, so each is common shingles for the most part. Members with one set of
    common shingles have a representative, the one with the fewest rare ones: whoever in the set is similar to anyone in it is
    similar to that one, and who is similar to a member of another set is similar to that set's representative.
    So a member is compared with its own representative and, only if they differ, with those of other sets; and
    representatives with one another: (links, members in groups as for _dealt, members as for _dealt_across).
    """
    j = tokens.similarity
    rare = F.col("size") - F.col("common")
    bound = tokens.shape.filter((100 * F.col("common") >= j * F.col("size")) & (rare < F.col("short"))).join(tokens.each, "c")
    bound = written(bound.withColumn("rare", rare).withColumn("top", F.floor(F.col("common") * (100 + j) / j) - F.col("size")), "common-members")
    first = written(bound.groupBy("h1", "h2", "common").agg(F.min(F.struct("rare", "c", "component", "size")).alias("m")), "common-sets")
    own = bound.join(first, ["h1", "h2", "common"]).filter("c <> m.c").filter("component <> m.component")
    checked = confirmed(own.select(F.col("c").alias("a"), F.col("m.c").alias("b")))
    heads = first.select(F.col("m.c").alias("c"), F.col("m.component").alias("component"), F.col("m.size").alias("size"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("top"))
    others = checked.filter("not ok").select(F.col("a").alias("c")).join(bound, "c").select("c", "component", "size", F.lit(1).alias("side"), "top")
    sides = written(heads.unionByName(others), "common-sides")
    groups = written(tokens.prefix(F.col("n") > COMMON).drop("component").join(sides, "c"), "common-prefixes")
    head = F.col("side") == 0
    counts = groups.groupBy("band").agg(F.sum(head.cast("long")).alias("n0"), F.min(F.when(head, F.col("size"))).alias("least"), F.min(F.when(head, F.col("component"))).alias("lo"), F.max(F.when(head, F.col("component"))).alias("hi"))
    # a member that no representative of its group is small enough for has nobody to meet
    fit = written(groups.join(written(counts, "common-groups"), "band").filter(head | (F.col("least") <= F.col("top"))), "common-fit")
    ones = written(fit.filter("side = 1").groupBy("band").agg(F.count("*").alias("n1")), "common-sizes")
    among = fit.filter(head & (F.col("lo") < F.col("hi"))).select("band", "c", "component", F.col("n0").alias("n"))
    across = fit.join(ones, "band").select("band", "c", "component", "side", F.when(head, F.col("n0")).otherwise(F.col("n1")).alias("near"), F.when(head, F.col("n1")).otherwise(F.col("n0")).alias("far"))
    return checked.filter("ok").select("a", "b"), written(among, "common-among"), written(across, "common-across")


def _zip(text: pa.Array) -> pa.Array:
    return pa.array([zlib.compress(t or b"", 1) for t in text.cast(pa.binary()).to_pylist()], pa.binary())


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """One row per document: id, th (hash of the text), n_shingles, component_id, kept, and component (class number; null for empty sets)."""
    spark = long_rows(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    th = F.xxhash64(quoted(text_col))
    signed = docs.select(quoted(id_col).alias("id"), th.alias("th"), quoted(text_col).alias("text")).mapInArrow(_signatures, f"id {kind}, th bigint, n bigint, key binary, sketch binary")
    signed = written(signed, "sketches", spark)
    full = signed.filter("n > 0")
    classes = full.groupBy("key").agg(F.min("id").alias("low"), F.min(F.struct("id", "th")).alias("rep"), F.first("n").alias("size"), F.first("sketch").alias("sketch"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes", spark)
    # one representative for each class: the smallest class of the band it shares most often
    bands = classes.select("c", "sketch").mapInArrow(_bands, "c bigint, band bigint")
    heads = written(bands.groupBy("band").agg(F.min("c").alias("head"), F.count("*").alias("n")).filter("n > 1"), "bands", spark)
    met = written(bands.join(heads, "band").select("band", "c", "head", "n"), "candidates", spark)
    stars = met.filter("c <> head").groupBy("c", "head").agg(F.count("*").alias("n"))
    stars = stars.groupBy("c").agg(F.max(F.struct("n", (-F.col("head")).alias("h"))).alias("m")).select(F.col("c").alias("a"), (-F.col("m.h")).alias("b"))
    stars = written(stars, "stars", spark)
    wanted = met.select("c").distinct().join(classes.select("c", "rep.id", "rep.th"), "c")
    texts = docs.select(quoted(id_col).alias("__id"), th.alias("__th"), F.arrow_udf(_zip, "binary")(quoted(text_col)).alias("z"))
    texts = texts.join(wanted, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__th") == F.col("th"))).groupBy("c").agg(F.first("z").alias("z"))
    texts = written(texts, "texts", spark)

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = pairs.join(texts.select(F.col("c").alias("a"), F.col("z").alias("za")), "a")
        both = left.join(texts.select(F.col("c").alias("b"), F.col("z").alias("zb")), "b").select("a", "b", "za", "zb")
        return written(both.mapInArrow(_confirmed(similarity), "a bigint, b bigint, ok boolean"), "links", spark)

    first = confirmed(stars)
    links = first.filter("ok").select("a", "b")
    joined = components(links)
    # bands that still hold several components: all their pairs of different components, in blocks
    member = written(met.join(joined.withColumnRenamed("node", "c"), "c", "left").select("band", "c", "n", F.coalesce("component", "c").alias("component")), "members", spark)
    mixed = member.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band")
    mixed = written(mixed, "mixed", spark)
    open_ = written(member.join(mixed, "band"), "open", spark)
    kind = "group bigint, band bigint, own int, diagonal boolean, c bigint, component bigint, size bigint"

    def in_groups(rows: DataFrame, *more: str) -> DataFrame:
        return rows.repartition("group").sortWithinPartitions("group", "c").select(*_MEMBER, *more)

    def linked(dealt: DataFrame, banded: bool) -> DataFrame:
        marked = in_groups(dealt.join(classes.select("c", "size", "sketch"), "c"), "sketch").mapInArrow(_marked(similarity, banded), kind)
        marked = written(marked, "marked", spark)
        second = in_groups(marked.join(classes.select("c", "sketch"), "c").join(texts, "c"), "sketch", "z").mapInArrow(_linked(similarity, banded), "a bigint, b bigint")
        return written(second, "pairs", spark)

    second = linked(_dealt(open_.filter(F.col("n") <= HOT)), True)
    hot = open_.filter(F.col("n") > HOT)
    if not hot.isEmpty():
        tokens = HotTokens(hot, texts, similarity)
        heads, among, across = common_members(tokens, confirmed)
        second = second.union(heads).union(linked(_dealt(prefix_members(tokens)), False))
        second = second.union(linked(_dealt(among), False)).union(linked(_dealt_across(across), False))
    whole = components(links.union(second))
    named = classes.select("c", "key", "low").join(whole.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    named = written(named.select("key", "component", "low"), "named", spark)
    lowest = written(named.groupBy("component").agg(F.min("low").alias("component_id")), "lowest", spark)
    ids = written(named.join(lowest, "component").select("key", "component", "component_id"), "ids", spark)
    found = full.select("id", "th", "n", "key").join(ids, "key").select("id", "th", "n", "component", "component_id")
    empty = signed.filter("n = 0").select("id", "th", "n", F.lit(None).cast("bigint").alias("component"), F.col("id").alias("component_id"))
    every = found.unionByName(empty)
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return every.select(F.col("id").alias(id_col), "th", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), "component")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest id (of repeated ids, one row). Rows without words all stay, and so do all columns."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, similarity=similarity)
    ident = lambda c: F.coalesce(c.cast("string"), F.lit("\0"))
    one = found.filter("kept and component is not null").groupBy("component").agg(F.min(F.struct(quoted(id_col).alias("id"), "th")).alias("m")).select(ident(F.col("m.id")).alias("i"), "m.th", F.lit(True).alias("once"))
    rest = found.filter("component is null").select(ident(quoted(id_col)).alias("i"), "th", F.lit(False).alias("once")).distinct()
    chosen = written(one.union(rest), "kept")
    rows = held(docs, (text_col,), i=ident(quoted(id_col)), th=F.xxhash64(quoted(text_col)), z=F.arrow_udf(_zip_null, "binary")(quoted(text_col)))
    joined = rows.join(chosen, ["i", "th"])
    single = joined.withColumn("n", F.row_number().over(Window.partitionBy("i", "th").orderBy(F.hash("z")))).filter("not once or n = 1")
    return released(single, docs.columns, **{text_col: F.arrow_udf(_unzip, "string")("z")})


def _zip_null(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else zlib.compress(t, 1) for t in text.cast(pa.binary()).to_pylist()], pa.binary())


def _unzip(packed: pa.Array) -> pa.Array:
    return pa.array([None if z is None else zlib.decompress(z) for z in packed.to_pylist()], pa.binary()).cast(pa.string())
