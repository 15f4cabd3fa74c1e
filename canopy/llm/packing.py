"""Best-fit packing of tokenised documents by a linear grouping scheme.

Lengths are whole numbers up to the capacity, so the counts of each length say all that
a packing plan needs; that histogram (at most ``capacity`` entries) is the only thing
that reaches the driver. The plan works on counts:

1. large lengths are sorted and cut into groups of equal cardinality, each rounded up to
   its largest member;
2. configurations of these few sizes are chosen by repeated bounded knapsacks, each used
   as often as its sizes allow;
3. actual lengths are substituted for the rounded ones;
4. small lengths go, longest first, into the tightest room that is left.

The plan is a list of runs (so many equal sequences). Each piece then finds its place
from its rank among pieces of its length; ranks come from counts over salted cells, so a
length that most pieces share isn't ranked in one task.

Null text is empty (the end token alone). Repeated rows are packed as separate
documents. An empty table gives no rows. Only id and text are read, so further columns may have any name.
"""

from __future__ import annotations

import base64
import bisect
import functools
import json
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.llm.stage import long_rows, written

CAPACITY = 2_048
END_ID = 0
#: Lengths over capacity / SMALL are large; they are rounded within so many groups.
SMALL, GROUPS = 3, 1_024
#: Pieces ranked in one cell, about, and the most cells of a length.
CELL, CELLS = 4_096, 65_536
_ENCODERS: dict[tuple, tuple] = {}


def default_vocabulary() -> tuple[str, str]:
    """Files of the byte-level vocabulary: for the tokenizers library, and the same as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(files: tuple[str, str]):
    """text -> ids. The rank form of the vocabulary gives the same ids several times faster; texts that
    spell a special token go through the tokenizers library, which alone knows those."""
    if files not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(files[1], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(files[0]) as f:
            special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        slow = functools.cache(lambda: Tokenizer.from_file(files[0]))
        _ENCODERS[files] = (lambda text: fast.encode_to_numpy(text, disallowed_special=()), lambda text: np.array(slow().encode(text, add_special_tokens=False).ids, np.uint32), special)
    return _ENCODERS[files]


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. Only documents over ``capacity`` ids are cut; the first piece takes the odd rest."""
    long_rows(docs.sparkSession)
    files = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType

    def run(batches):
        fast, slow, special = _encoder(files)
        for b in batches:
            out = {"row": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.append((slow if any(s in (text or "") for s in special) else fast)(text or ""), np.uint32(END_ID)).astype("<u4")
                cut = len(ids) - (-(-len(ids) // capacity) - 1) * capacity
                edges = [0, *range(cut, len(ids) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    for name, v in zip(out, (i, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())), strict=True):
                        out[name].append(v)
            rows = pa.array(out.pop("row"), pa.int64())
            yield pa.RecordBatch.from_arrays([pc.take(b.column(0), rows), pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32"))], [id_col, "piece", "start", "length", "ids_crc32"])

    from pyspark.sql.types import StructType

    schema = StructType().add(id_col, kind).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return docs.select(id_col, text_col).mapInArrow(run, schema)


@dataclass
class Plan:
    """Runs of equal sequences: ``length`` pieces of rank ``first`` on go ``per`` to a sequence, from ``sequence`` and ``offset`` on."""

    length: np.ndarray
    first: np.ndarray
    per: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        span = int(self.first.max(initial=0)) + 1
        at = np.searchsorted(self.length * span + self.first, length * span + np.minimum(rank, span - 1), "right") - 1
        k = rank - self.first[at]
        return self.sequence[at] + k // self.per[at], self.offset[at] + k % self.per[at] * length


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """A packing plan from the number of pieces of each length (1 to ``capacity``)."""
    left = {int(k): int(v) for k, v in counts.items() if v}
    large = sorted((x for x in left if x > capacity // SMALL), reverse=True)
    done: list[tuple[int, list[tuple[int, int]]]] = []  # (sequences, [(length, pieces in each)])
    queues, sizes, amounts = _grouped(large, left, groups)
    for times, slots in _configurations(sizes, amounts, capacity):
        parts = [_take(queues[g], times) for g in slots]
        done += _zipped(parts)
    rooms: dict[int, list] = {}
    for times, items in done:
        rooms.setdefault(capacity - sum(a * b for a, b in items), []).append((times, items))
    keys = sorted(rooms)
    for x in sorted((x for x in left if x <= capacity // SMALL), reverse=True):
        n = left[x]
        while n:
            k = bisect.bisect_left(keys, x)
            if k == len(keys):  # new sequences
                room, times, items = capacity, -(-n // (capacity // x)), []
            else:
                room = keys[k]
                times, items = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], keys[k]
            per = min(room // x, n)
            use = min(times, n // per)
            n -= use * per
            for t, own, space in ((use, [*items, (x, per)], room - per * x), (times - use, items, room)):
                if t and (own or space < capacity):
                    if space not in rooms:
                        rooms[space] = []
                        bisect.insort(keys, space)
                    rooms[space].append((t, own))
    return _numbered([run for k in sorted(rooms) for run in rooms[k]])


def _grouped(large, left, groups):
    """Groups of equal cardinality, longest first: their queues of (length, count), rounded sizes and counts."""
    total = sum(left[x] for x in large)
    each = max(1, -(-total // groups))
    queues, room = [], 0
    for x in large:
        n = left[x]
        while n:
            if not room:
                queues.append([])
                room = each
            m = min(n, room)
            queues[-1].append([x, m])
            n, room = n - m, room - m
    return queues, [q[0][0] for q in queues], [sum(m for _, m in q) for q in queues]


def _configurations(sizes, amounts, capacity):
    """Yield (times, groups of its slots) until every group is used up: the largest size left, filled best by a bounded knapsack."""
    left = list(amounts)
    for g in range(len(sizes)):
        while left[g]:
            room, slots = capacity - sizes[g], [g]
            # best[c]: the group that last reached a fill of exactly c, and how often it was used
            reach = np.full(room + 1, -1, np.int64)
            reach[0] = len(sizes)
            trail = {}
            for h in range(g, len(sizes)):
                limit = min(left[h] - (h == g), room // sizes[h])
                fresh = []
                for _ in range(limit):
                    new = np.flatnonzero((reach[: room + 1 - sizes[h]] >= 0) & (reach[sizes[h] :] < 0)) + sizes[h] if sizes[h] <= room else []
                    if not len(new):
                        break
                    reach[new] = h
                    fresh.append(new)
                trail[h] = fresh
                if reach[room] >= 0:
                    break
            c = int(np.flatnonzero(reach >= 0)[-1])
            while c:
                h = int(reach[c])
                slots.append(h)
                c -= sizes[h]
            used = {h: slots.count(h) for h in set(slots)}
            while any(left[h] < n for h, n in used.items()):  # the trail may use a group once too often
                h = next(h for h, n in used.items() if left[h] < n)
                slots.remove(h)
                used[h] -= 1
            times = min(left[h] // n for h, n in used.items() if n)
            for h, n in used.items():
                left[h] -= n * times
            yield times, slots


def _take(queue, n):
    out = []
    while n:
        m = min(n, queue[0][1])
        out.append((queue[0][0], m))
        queue[0][1] -= m
        n -= m
        if not queue[0][1]:
            queue.pop(0)
    return out


def _zipped(parts):
    """Runs over which every slot keeps one length."""
    parts = [[list(x) for x in p] for p in parts]
    out = []
    while parts[0]:
        m = min(p[0][1] for p in parts)
        lengths = sorted(p[0][0] for p in parts)
        out.append((m, [(x, lengths.count(x)) for x in sorted(set(lengths), reverse=True)]))
        for p in parts:
            p[0][1] -= m
            if not p[0][1]:
                p.pop(0)
    return out


def _numbered(runs) -> Plan:
    rows, rank, sequence = [], {}, 0
    for times, items in runs:
        offset = 0
        for x, per in items:
            rows.append((x, rank.get(x, 0), per, sequence, offset))
            rank[x] = rank.get(x, 0) + times * per
            offset += x * per
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return Plan(*table.T, sequence)


def pack(items: DataFrame, *, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """All columns plus sequence_id and offset. ``items`` should be a written table: it is read for counts and again for places."""
    if set(items.columns) & {"sequence_id", "offset"}:
        raise ValueError("sequence_id and offset are names of results")
    counts = {r[0]: r["n"] for r in items.groupBy(length_col).agg(F.count("*").alias("n")).collect()}  # at most `capacity` lengths
    made = plan(counts, capacity)
    others = sorted(c for c in items.columns)
    deal = F.xxhash64(*others)
    cells = F.array(*[F.lit(min(CELLS, -(-counts.get(x, 0) // CELL) or 1)) for x in range(capacity + 1)])
    dealt = items.withColumn("__deal", deal).withColumn("__cell", F.pmod(F.col("__deal"), F.element_at(cells, (F.col(length_col) + 1).cast("int"))))
    sums = dealt.groupBy(length_col, "__cell").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(length_col).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(length_col, "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    seat = F.row_number().over(Window.partitionBy(length_col, "__cell").orderBy("__deal", *others))
    ranked = dealt.withColumn("__seat", seat - 1).join(starts, [length_col, "__cell"]).withColumn("__rank", F.col("__start") + F.col("__seat"))

    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, offset = made.place(length.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False).astype(np.int64))
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    udf = F.arrow_udf(place, "struct<sequence_id:bigint,offset:bigint>")
    got = ranked.withColumn("__at", udf(F.col(length_col).cast("long"), F.col("__rank").cast("long")))
    return got.select(*items.columns, "__at.sequence_id", "__at.offset")


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Tokenise, cut and pack: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(pieces(docs, id_col=id_col, text_col=text_col, capacity=capacity, vocabulary=vocabulary), "pieces"), capacity=capacity)
