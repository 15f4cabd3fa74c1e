"""Exact removal of repeated byte strings by column-wise suffix ordering.

A byte goes if a string of ``LENGTH`` bytes around it also starts anywhere else.

1. Equal texts become one row with a count (bucketed table, so later joins don't move texts).
2. Every window of ``LENGTH`` bytes has an anchor, the smallest hash (its upper bits) of its
   ``GRAM``-byte substrings (ties: leftmost). The anchor depends on the window's bytes alone, so equal
   windows lie alike around equal anchors. Anchors that occur once can't repeat.
3. The bytes that the windows of a repeated anchor cover are its fragment. Equal fragments
   are counted, not kept.
4. Fragments of an anchor that differ go to one task, aligned at the anchor, and are ordered
   column by column from the right: each round inserts one symbol of every fragment, which
   updates the order of all suffixes that start in that column and their longest common
   prefixes (the column-wise construction of a Burrows-Wheeler transform, kept per aligned
   column). A suffix that shares ``LENGTH`` bytes with a neighbour starts a repeated window.
5. Anchors with more than ``FRAGMENTS`` different fragments are split by halving the range of
   window offsets: windows of a half share a longer core, so the halves fall apart into
   groups by that core. At one offset the core is the window, and counting decides.

Columns of a batch are read strictly in sequence; batches are bounded, so the columns stay
in the task's memory in place of external files, and what is passed between steps is
written to the shared folder by Spark.

Null texts are empty. Rows that repeat an id and text are copies like any others (all of a
text of ``LENGTH`` bytes or more goes if it occurs twice). An empty table gives no rows. Only id and text are
read, so further columns may have any name.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.stage import bucketed, long_rows, quoted, written
from canopy.llm.text import Prefix

LENGTH, GRAM = 400, 32
#: Different fragments of one anchor (or core) that one task orders, and of one batch of anchors.
FRAGMENTS, BATCH = 4_000, 16_000
#: Bytes of a text that are hashed at once.
SLICE = 4 << 20


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Anchor place, first and last window start of each run of windows with one anchor, and the anchor's hash (at most ``SLICE + LENGTH`` bytes)."""
    n, w = len(data) - gram + 1, length - gram + 1
    windows = len(data) - length + 1
    if windows <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    p = Prefix(data)
    raw = (p.sums[gram:] - p.sums[:n]) * p.down[:n]
    raw ^= raw >> np.uint64(29)
    raw *= np.uint64(0xBF58476D1CE4E5B9)
    raw ^= raw >> np.uint64(32)
    bits = np.uint64((SLICE + LENGTH).bit_length())  # the same for every text: where hashes tie must not hang on its length
    least = (raw >> bits << bits) | np.arange(n, dtype=np.uint64)
    size = 1
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: windows], least[w - size : w - size + windows])
    place = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    at = place[first]
    return at, first, np.append(first[1:], windows) - 1, raw[at]


def _text_runs(data: np.ndarray):
    """anchors() of a text of any length, slice by slice."""
    lo = 0
    while lo == 0 or lo + LENGTH <= len(data):
        hi = min(len(data), lo + SLICE + LENGTH - 1)
        at, first, last, code = anchors(data[lo:hi])
        if len(at):
            yield at + lo, first + lo, last + lo, code
        lo += SLICE


def _runs(batches):
    for b in batches:
        keys = b.column(0)
        for i, z in enumerate(b.column(1)):
            data = np.frombuffer(zlib.decompress(z.as_py()), np.uint8)
            for at, first, last, code in _text_runs(data):
                yield pa.RecordBatch.from_arrays([pa.array([keys[i].as_py()] * len(at), pa.binary()), pa.array(code.view(np.int64)), pa.array(at), pa.array(first), pa.array(last)], ["key", "anchor", "at", "lo", "hi"])


def _digest(part: bytes, left: int) -> bytes:
    return xxhash.xxh3_128_digest(part + left.to_bytes(4, "little"))


def _fragments(with_bytes: bool):
    """Each marked run of a text: its fragment's digest, and its bytes."""

    def run(batches):
        for b in batches:
            for key, z, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = zlib.decompress(z)
                found = marks.as_py()
                for s in range(0, len(found), 2048):
                    out = [[] for _ in range(7)]
                    for m in found[s : s + 2048]:
                        part = text[m["lo"] : m["hi"] + LENGTH]
                        row = (key, m["anchor"], m["at"], m["lo"], m["hi"], _digest(part, m["at"] - m["lo"]), part)
                        for column, v in zip(out, row, strict=True):
                            column.append(v)
                    columns = [pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
                    names = ["key", "anchor", "at", "lo", "hi", "digest", "bytes"]
                    yield pa.RecordBatch.from_arrays(columns[: 7 if with_bytes else 6], names[: 7 if with_bytes else 6])

    return run


def repeated_windows(parts: list[bytes], left: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For fragments aligned at their anchors (``left`` bytes before them): which window starts repeat.

    One boolean array per fragment, for window starts 0 to len(fragment) - length.
    """
    n = len(parts)
    size = np.array([len(p) for p in parts], np.int64)
    before, after = int(left.max()), int((size - left).max())
    outside = 256
    columns = np.full((before + after, n), outside, np.uint16)  # one sequential run of symbols for each column
    for i, p in enumerate(parts):
        a = before - left[i]
        columns[a : a + size[i], i] = np.frombuffer(p, np.uint8)
    out = [np.zeros(max(0, k - length + 1), bool) for k in size.tolist()]
    starts, counts = before - left, size - length + 1
    flags = np.zeros((before + 1, n), bool)
    order = np.arange(n)
    prefix = np.zeros(n + 1, np.int32)  # prefix[k]: common prefix of the k-th suffix and the one before it; an end mark
    for c in range(before + after - 1, -1, -1):
        symbols = columns[c][order]
        move = np.argsort(symbols, kind="stable")
        sorted_ = symbols[move]
        same = np.flatnonzero((sorted_[1:] == sorted_[:-1]) & (sorted_[1:] != outside)) + 1
        fresh = np.zeros(n + 1, np.int32)
        if len(same):
            cuts = np.empty(2 * len(same), np.int64)
            cuts[0::2], cuts[1::2] = move[same - 1] + 1, move[same] + 1
            fresh[same] = np.minimum.reduceat(prefix, cuts)[0::2] + 1
        order, prefix = order[move], fresh
        if c <= before:
            hit = (prefix[:-1] >= length) | (prefix[1:] >= length)
            flags[c, order[hit]] = True
    for i in range(n):
        out[i][:] = flags[starts[i] : starts[i] + max(0, counts[i]), i]
    return out


def _spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _ordered(batches):
    """Rows (group, digest, left, bytes, d1, d2), sorted by group: repeated window starts, from the anchor, with d1 <= anchor - start < d2."""

    def solve(rows):
        left = np.array([r[2] for r in rows], np.int64)
        got = repeated_windows([r[3] for r in rows], left)
        spans = []
        for r, flags in zip(rows, got, strict=True):
            d = r[2] - np.arange(len(flags))
            flags &= (d >= r[4]) & (d < r[5])
            spans.append([{"a": a - r[2], "b": b - r[2]} for a, b in _spans_of(flags)])
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array(spans, _SPANS)], ["group", "digest", "spans"])

    held: list = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if len(held) >= BATCH and row[0] != held[-1][0]:
                yield solve(held)
                held = []
            held.append(row)
    if held:
        yield solve(held)


def _halved(batches):
    """Both halves of each fragment's window offsets, grouped by the core that all windows of a half share."""
    for b in batches:
        out = [[] for _ in range(8)]
        for group, digest, left, part, d1, d2 in zip(*(c.to_pylist() for c in b.columns), strict=True):
            mid = (d1 + d2) // 2
            for a, z in ((d1, mid), (mid, d2)):
                first, last = max(a, left + LENGTH - len(part)), min(z, left + 1) - 1  # offsets of windows that the fragment has
                if first > last:
                    continue
                lo = left - last
                core = part[left - a : left - (z - 1) + LENGTH]
                own = part[lo : left - first + LENGTH]
                code = int.from_bytes(xxhash.xxh3_64_digest(core + a.to_bytes(4, "little") + z.to_bytes(4, "little")), "little", signed=True)
                for column, v in zip(out, (group, digest, code, _digest(own, left - lo), left - lo, own, a, z), strict=True):
                    column.append(v)
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["group0", "digest0", "group", "digest", "left", "bytes", "d1", "d2"])


_WHOLE = "array<struct<a:bigint,b:bigint>>"


def _order_groups(fragments: DataFrame, limit: int) -> DataFrame:
    """(group, digest, spans) for rows group, digest, n, left, bytes, d1, d2 (one for each digest of a group)."""
    cols = ["group", "digest", "left", "bytes", "d1", "d2"]
    sizes = written(fragments.groupBy("group").agg(F.count("*").alias("__m")), "group-sizes")
    sized = fragments.join(sizes, "group")
    few = sized.filter((F.col("__m") > 1) & (F.col("__m") <= limit)).select(*cols)
    solved = few.repartition("group").sortWithinPartitions("group").mapInArrow(_ordered, f"group bigint, digest binary, spans {_WHOLE}")
    many = written(sized.filter(F.col("__m") > limit).select(*cols, "n"), "hot-fragments")
    if many.isEmpty():
        return solved
    halves = written(many.select(*cols).mapInArrow(_halved, "group0 bigint, digest0 binary, group bigint, digest binary, left bigint, bytes binary, d1 bigint, d2 bigint"), "halves")
    counted = halves.join(many.select(F.col("group").alias("group0"), F.col("digest").alias("digest0"), "n"), ["group0", "digest0"])
    inner = written(counted.groupBy("group", "digest").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("left", "bytes", "d1", "d2"))), "inner")
    # all windows of fragments that occur twice repeat; of the others those that the ordering finds
    whole = F.array(F.struct((-F.col("left")).alias("a"), (F.octet_length("bytes") - LENGTH - F.col("left")).alias("b")))
    deeper = _order_groups(inner, limit)
    found = inner.filter("n > 1").select("group", "digest", whole.cast(_WHOLE).alias("spans")).union(deeper)
    back = halves.select("group0", "digest0", "group", "digest").join(written(found, "inner-spans"), ["group", "digest"])
    back = back.groupBy("group0", "digest0").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    # every fragment gets a row, if only an empty one
    all_ = many.select("group", "digest").join(back.select(F.col("group0").alias("group"), F.col("digest0").alias("digest"), "spans"), ["group", "digest"], "left")
    return solved.union(all_.select("group", "digest", F.coalesce("spans", F.array().cast(_WHOLE)).alias("spans")))


def merged(spans, length: int = LENGTH) -> list[tuple[int, int]]:
    """Byte ranges (start, end) that windows starting in ``spans`` cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def _result(batches):
    for b in batches:
        rows = []
        for key, z, copies, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
            text = zlib.decompress(z)
            if copies > 1 and len(text) >= LENGTH:
                gone = [(0, len(text))]
            else:
                gone = merged((s["a"], s["b"]) for s in spans or [])
            digest, at = hashlib.sha256(), 0
            for lo, hi in gone:
                digest.update(text[at:lo])
                at = hi
            digest.update(text[at:])
            rows.append((key, len(text), sum(hi - lo for lo, hi in gone), len(gone), digest.hexdigest(), [{"a": lo, "b": hi} for lo, hi in gone]))
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPANS)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def _zip(text: pa.Array) -> pa.Array:
    return pa.array([zlib.compress(t or b"", 1) for t in text.cast(pa.binary()).to_pylist()], pa.binary())


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = FRAGMENTS) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and removed (byte ranges a to b)."""
    spark = long_rows(docs.sparkSession)
    text = F.coalesce(quoted(text_col), F.lit(""))
    key = F.unhex(F.md5(text.cast("binary")))
    zipped = docs.select(key.alias("key"), F.arrow_udf(_zip, "binary")(text).alias("z"))
    texts = bucketed(zipped.groupBy("key").agg(F.first("z").alias("z"), F.count("*").alias("copies")), "key", "texts", spark)
    runs = written(texts.select("key", "z").mapInArrow(_runs, "key binary, anchor bigint, at bigint, lo bigint, hi bigint"), "anchors", spark)
    again = written(runs.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "repeated-anchors", spark)
    mark = F.collect_list(F.struct("anchor", "at", "lo", "hi")).alias("marks")

    def cut(marked: DataFrame, with_bytes: bool) -> DataFrame:
        kind = "key binary, anchor bigint, at bigint, lo bigint, hi bigint, digest binary" + ", bytes binary" * with_bytes
        lists = marked.groupBy("key").agg(mark)
        return texts.select("key", "z").join(lists.hint("merge"), "key").select("key", "z", "marks").mapInArrow(_fragments(with_bytes), kind)

    members = written(cut(runs.join(again, "anchor"), False), "fragments", spark)
    groups = members.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("key", "at", "lo", "hi")).alias("rep"))
    groups = written(groups, "fragment-groups", spark)
    mixed = written(groups.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1").select("anchor"), "mixed-anchors", spark)
    chosen = written(groups.join(mixed, "anchor"), "chosen", spark)
    with_bytes = cut(chosen.select("rep.*", "anchor"), True)
    with_bytes = with_bytes.join(chosen.select("anchor", "digest", "n"), ["anchor", "digest"])
    fragments = with_bytes.select(F.col("anchor").alias("group"), "digest", "n", (F.col("at") - F.col("lo")).alias("left"), "bytes", F.lit(0).cast("long").alias("d1"), F.lit(LENGTH - GRAM + 1).cast("long").alias("d2"))
    fragments = written(fragments, "mixed-fragments", spark)
    ordered = _order_groups(fragments, limit)
    # of a fragment that occurs once among different ones, what the ordering found; of any other, everything
    single = chosen.filter("n = 1").select(F.col("anchor").alias("group"), "digest").join(ordered, ["group", "digest"], "left")
    single = written(single.select(F.col("group").alias("anchor"), "digest", F.coalesce("spans", F.array().cast(_WHOLE)).alias("spans")), "spans", spark)
    judged = members.join(single, ["anchor", "digest"], "left")
    own = F.when(F.col("spans").isNull(), F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")))).otherwise(F.transform("spans", lambda s: F.struct((s["a"] + F.col("at")).alias("a"), (s["b"] + F.col("at")).alias("b"))))
    spans = judged.select("key", own.alias("spans")).filter(F.size("spans") > 0).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    done = texts.select("key", "z", "copies").join(spans.hint("merge"), "key", "left").select("key", "z", "copies", "spans")
    kind = "key binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<a:bigint,b:bigint>>"
    done = written(done.mapInArrow(_result, kind), "removed", spark)
    return docs.select(quoted(id_col).alias("id"), key.alias("key")).join(done, "key").withColumnRenamed("id", id_col).drop("key")
