"""Benchmark decontamination: rare n-gram seeds joined in Spark, then Smith-Waterman alignment of words.

Words are letter or digit runs, A-Z lower-cased. A document leaks an item if the best local
alignment of their words (match 2, mismatch and gap -1) scores ``SIMILARITY`` of a perfect
copy's score; items of one or two words have to occur as they are. Which pairs are aligned is
decided by seeds and loses none of these:

* A seed is three words of which each follows the one before at once or with one word between
  (items under :func:`long_from` words: two such words), so that it survives inserted, dropped, replaced
  and swapped words around it. Of m item words, an alignment of that score leaves neighbouring
  matches so close together at no fewer than a count of places that follows from m alone
  (:func:`least_places`): every gap between matches that breaks a seed costs two points.
* How many documents have a seed is counted over all documents. Of each item's places, the
  commonest may be left out as long as one of the count stays: places whose seeds are in more
  than ``COMMON`` of all documents go first. The others are its rare seeds; a document is a
  candidate where it has as many of them as must be left, close enough for one alignment.
* Seeds of documents are joined with the table of rare seeds; before that, most are dropped by
  a bitmap of the table (a fixed number of bits at most, false positives only). Only documents
  with a candidate stretch move, and only these stretches are aligned, in slices of bounded
  length, each longer than any alignment.

Null and empty texts, and items without words, match nothing. Repeated items each give their own
pairs; rows that repeat an id and text count once in :func:`leaks`, and all go in
:func:`without_leaks`. Extra columns, of any name, are ignored by the one and kept by the other.
Empty tables give no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.llm.stage import held, long_rows, quoted, released, written
from canopy.llm.text import LOWER, NONWORD, Prefix, blocks, mix, spans

#: Share of a perfect copy's score.
SIMILARITY = 0.6
#: Share of documents above which a seed isn't rare.
COMMON = 0.001
#: Bits of a bitmap: about so many for each entry, and at most (16 MiB).
SPARSE, BITS = 64, 1 << 27
#: Words of documents in a batch of alignments, about.
TOGETHER = 1 << 15
#: Words of a slice that is aligned at once, at least (longer for long items).
SLICE = 512
_KIND = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xD1B54A32D192ED03), np.uint64(0xABC98388FB8FAC03))
_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def long_from(similarity: float = SIMILARITY) -> int:
    """Item words from which on seeds have three words: those whose alignments surely keep one."""
    return int(2 / (2 * similarity - 1) + 1e-9) + 1 if similarity > 0.5 else 1 << 62


def least_places(words: int, similarity: float = SIMILARITY) -> int:
    """Item places at which any alignment of the wanted score has a seed of the item's kind, at least.

    With M matched words and penalty P, the score 2M - P reaches 2 * similarity * words, so P <= 2M - 2 * similarity * words.
    Between neighbouring matches a gap breaks a seed only at a penalty of two or more: at most P / 2 of M - 1 gaps.
    A three-word seed needs two good gaps in a row. Both counts are least for M = words (three) or for any M (two).
    """
    if words < 3:
        return 1
    if words < long_from(similarity):
        return max(1, int(np.ceil(similarity * words - 1 - 1e-9)))
    return max(1, int(np.ceil((2 * similarity - 1) * words - 2 - 1e-9)))


def _words(data, offsets):
    low = LOWER[data]
    at, to, rows = spans(low, offsets, NONWORD)
    return Prefix(low).of(at, to), rows


def _seeds(words: np.ndarray, rows: np.ndarray, kind: int):
    """Yield (seed hashes, first word) of every seed of ``kind`` words, variant by variant."""
    if kind == 1:
        yield mix(words + _KIND[0]), np.arange(len(words))
        return
    scaled = [words * m for m in _MUL[:kind]]
    steps = [(d,) for d in (1, 2)] if kind == 2 else [(a, a + b) for a in (1, 2) for b in (1, 2)]
    for step in steps:
        n = len(words) - step[-1]
        if n <= 0:
            continue
        value = scaled[0][:n] + _KIND[kind - 1]
        for k, d in enumerate(step, 1):
            value = value + scaled[k][d : d + n]
        same = rows[:n] == rows[step[-1] :]
        yield (mix(value[same]), np.flatnonzero(same)) if not same.all() else (mix(value), np.arange(n))


def _item_kind(m: int, similarity: float) -> int:
    return 1 if m == 1 else 2 if m < long_from(similarity) else 3


def _itemised(batches):
    """Word hashes of each item."""
    for b in batches:
        for lo, data, offsets in blocks(b.column(1)):
            words, rows = _words(data, offsets)
            edge = np.searchsorted(rows, np.arange(len(offsets)))
            n = np.diff(edge)
            full = np.flatnonzero(n)
            keys = pc.take(b.column(0), pa.array(lo + full))
            yield pa.RecordBatch.from_arrays([keys, pa.array(n[full]), pa.array([words[edge[i] : edge[i + 1]].tobytes() for i in full], pa.binary())], ["item", "m", "words"])


def _item_seeds(similarity: float):
    """(item, m, kind, place, seed, least) of each item."""

    def run(batches):
        for b in batches:
            for item, m, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words, kind = np.frombuffer(raw, np.uint64), _item_kind(m, similarity)
                found = list(_seeds(words, np.zeros(m, np.int64), kind))
                if m == 2:
                    found = found[:1]
                seed, at = (np.concatenate(x) for x in zip(*found, strict=True))
                n = len(seed)
                yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.binary()), pa.array(np.full(n, m)), pa.array(np.full(n, kind, np.int32)), pa.array(at), pa.array(seed.view(np.int64)), pa.array(np.full(n, least_places(m, similarity)))], ["item", "m", "kind", "place", "seed", "least"])

    return run


def bitmap(table: DataFrame, column: str):
    """A broadcast bitmap of a column of hashes, two bits for each (a Bloom filter). At most ``BITS`` bits, whatever the table."""
    n = table.count()
    bits = 1 << 15
    while bits < min(BITS, SPARSE * n):
        bits *= 2
    value = F.explode(F.array(F.col(column), F.shiftright(column, 32))).alias("value")
    place = F.pmod("value", F.lit(bits))
    parts = table.select(value).groupBy(F.floor(place / (1 << 15)).alias("part")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(1 << 15)).cast("long")).alias("bits")).collect()
    whole = np.zeros(bits // 8, np.uint8)
    for r in parts:
        whole[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return table.sparkSession.sparkContext.broadcast(whole)


def _set(whole: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(whole) - 1)
    return (whole[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _inside(whole: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    hit = _set(whole, hashes)
    got = np.flatnonzero(hit)
    hit[got] = _set(whole, (hashes[got].view(np.int64) >> 32).view(np.uint64))
    return hit


def _hits(whole, kinds, data, offsets):
    """Row, seed and first word (within the row) of seeds in the bitmap, and every row's first word."""
    words, rows = _words(data, offsets)
    first = np.searchsorted(rows, np.arange(len(offsets)))
    row, seed, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for kind in kinds:
        for hashes, places in _seeds(words, rows, kind):
            got = np.flatnonzero(_inside(whole, hashes))
            own = rows[places[got]]
            row.append(own)
            seed.append(hashes[got])
            at.append(places[got] - first[own])
    return np.concatenate(row), np.concatenate(seed), np.concatenate(at)


def _counter(bits, kinds):
    """Partial document counts of seeds."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            for _, data, offsets in blocks(b.column(0)):
                row, seed, _ = _hits(bits.value, kinds, data, offsets)
                order = np.lexsort((seed, row))
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(row[order]) != 0) | (np.diff(seed[order].view(np.int64)) != 0)
                held.append(seed[order][new])
                size += int(new.sum())
                if size > 1 << 20:
                    yield _summed(held)
                    held, size = [], 0
        if held:
            yield _summed(held)

    return run


def _summed(held):
    seed, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(n)], ["seed", "n"])


def _finder(bits, kinds):
    """One row for each seed of a document (of each kind): its places."""

    def run(batches):
        for b in batches:
            for lo, data, offsets in blocks(b.column(2)):
                row, seed, at = _hits(bits.value, kinds, data, offsets)
                if not len(row):
                    continue
                order = np.lexsort((at, seed, row))
                row, seed, at = row[order], seed[order], at[order]
                new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (seed[1:] != seed[:-1])))
                own = pa.array(lo + row[new])
                lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), pa.array(at))
                yield pa.RecordBatch.from_arrays([pc.take(b.column(0), own), pc.take(b.column(1), own), pa.array(seed[new].view(np.int64)), lists], ["key", "id", "seed", "at"])

    return run


def span(m: int, similarity: float = SIMILARITY) -> int:
    """Words of a document that an alignment with an item of ``m`` words covers, at most."""
    return int(np.ceil(2 * (1 - similarity) * m)) + m + 2


def _stretches(m: int, need: int, ats: list[np.ndarray], places: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Word ranges of a document in which an item's seeds suffice: (first, end), slices that overlap by an alignment's length.

    ``ats``: for each seed its places in the document; ``places``: those in the item.
    """
    every = np.unique(np.concatenate(ats))
    reach, out = span(m, similarity), []
    length = max(SLICE, 4 * reach)
    cuts = np.flatnonzero(np.diff(every) > reach) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(every)], strict=True):
        begin, end = max(0, int(every[lo]) - reach), int(every[hi - 1]) + reach
        while begin < end:
            stop = min(end, begin + length)
            here = [p for at, p in zip(ats, places, strict=True) if np.searchsorted(at, begin) < np.searchsorted(at, stop)]
            if here and len(np.unique(np.concatenate(here))) >= need:
                out.append((begin, stop))
            if stop == end:
                break
            begin = stop - 2 * reach
    return out


def _candidates(similarity: float):
    def run(batches):
        for b in batches:
            keys, items, firsts, ends = [], [], [], []
            for key, item, m, need, seeds in zip(*(c.to_pylist() for c in b.columns[:4]), b.column(4), strict=True):
                found = seeds.values
                ats, places = ([np.sort(x.values.to_numpy()) for x in found.field(c)] for c in ("at", "places"))
                for first, end in _stretches(m, need, ats, places, similarity):
                    for column, v in zip((keys, items, firsts, ends), (key, item, first, end), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(items, pa.binary()), pa.array(firsts, pa.int64()), pa.array(ends, pa.int64())], ["key", "item", "first", "end"])

    return run


def _slices(batches):
    """The word hashes of each candidate stretch of a document, in batches of a few MB."""
    for b in batches:
        for lo, data, offsets in blocks(b.column(1)):
            words, rows = _words(data, offsets)
            edge = np.searchsorted(rows, np.arange(len(offsets)))
            out, size = [[] for _ in range(4)], 0
            for i, found in enumerate(b.column(2).slice(lo, len(offsets) - 1)):
                key = b.column(0)[lo + i].as_py()
                for s in found.as_py():
                    part = words[edge[i] + s["first"] : min(edge[i + 1], edge[i] + s["end"])].tobytes()
                    for column, v in zip(out, (key, s["item"], s["first"], part), strict=True):
                        column.append(v)
                    size += len(part)
                    if size > 4 << 20:
                        yield _sliced(out)
                        out, size = [[] for _ in range(4)], 0
            if out[0]:
                yield _sliced(out)


def _sliced(out):
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["key", "item", "first", "part"])


def _scores(doc: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Best local score (match 2, mismatch and gap -1) and the end of the first alignment that has it."""
    index = np.arange(len(doc) + 1, dtype=np.int32)
    row, best, end = np.zeros(len(doc) + 1, np.int32), 0, 0
    for word in item:
        new = np.maximum(0, row - 1)
        np.maximum(new[1:], row[:-1] + np.where(doc == word, 2, -1), out=new[1:])
        row = np.maximum.accumulate(new + index) - index  # gaps along the document cost 1 each
        at = int(row.argmax())
        if row[at] > best or (row[at] == best and at < end):
            best, end = int(row[at]), at
    return best, end


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman in two rows of memory: score, first and end word in ``doc``."""
    score, end = _scores(doc, item)
    if not score:
        return 0, 0, 0
    back, length = _scores(doc[:end][::-1], item[::-1])
    return score, end - length, end


def best_scores(docs: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Best local scores of many pairs, word by word of all items at once; what is padded matches nothing."""
    width, height = max(map(len, docs)), max(map(len, items))
    doc, item = np.zeros((width, len(docs)), np.uint64), np.ones((height, len(docs)), np.uint64)
    for k, (d, i) in enumerate(zip(docs, items, strict=True)):
        doc[: len(d), k], item[: len(i), k] = d, i
    kind = np.int16 if 2 * height + width < 30_000 else np.int32
    index = np.arange(width + 1, dtype=kind)[:, None]
    row, best = np.zeros((width + 1, len(docs)), kind), np.zeros(len(docs), kind)
    for words in item:
        new = np.maximum(row - 1, 0)
        np.maximum(new[1:], row[:-1] + np.where(doc == words, kind(2), kind(-1)), out=new[1:])
        new += index
        row = np.maximum.accumulate(new, 0, out=new) - index
        np.maximum(best, row.max(0), out=best)
    return best


def _aligned(similarity: float):
    def run(batches):
        for b in batches:
            out = [[] for _ in range(5)]
            keys, names, firsts, parts, lengths, raws = (c.to_pylist() for c in b.columns)
            docs, items = ([np.frombuffer(x, np.uint64) for x in column] for column in (parts, raws))
            order = sorted((i for i in range(len(docs)) if len(docs[i])), key=lambda i: (len(items[i]), len(docs[i])))
            while order:
                n = 1
                while n < len(order) and (n + 1) * max(len(docs[order[n]]), len(docs[order[0]])) <= TOGETHER and len(items[order[n]]) <= 1.25 * len(items[order[0]]):
                    n += 1
                now, order = order[:n], order[n:]
                best = best_scores([docs[i] for i in now], [items[i] for i in now])
                for i in (i for i, s in zip(now, best.tolist(), strict=True) if s >= (1.0 if lengths[i] < 3 else similarity) * 2 * lengths[i] - 1e-9):
                    score, lo, hi = align(docs[i], items[i])
                    for column, v in zip(out, (keys[i], names[i], score, firsts[i] + lo, hi - lo), strict=True):
                        column.append(v)
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["key", "item", "score", "first_word", "words"])

    return run


def _key(id_col: str, text_col: str):
    """Identity of a document: its id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(quoted(id_col).cast("string"), F.lit("\0")), F.lit("\0"), F.coalesce(quoted(text_col), F.lit(""))).cast("binary")))


def rare_seeds(docs: DataFrame, items: DataFrame, *, text_col: str, similarity: float, n_docs: int, spark: SparkSession) -> tuple[DataFrame, list[int]]:
    """(seed, item, m, need, places) of the rare seeds of each item, and the kinds of seeds that occur."""
    seeds = written(items.mapInArrow(_item_seeds(similarity), "item binary, m bigint, kind int, place bigint, seed bigint, least bigint"), "item-seeds", spark)
    kinds = sorted(r["kind"] for r in seeds.select("kind").distinct().collect())  # three at most
    counted = docs.select(text_col).mapInArrow(_counter(bitmap(seeds, "seed"), kinds), "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n"))
    counts = written(counted, "seed-counts", spark)
    places = seeds.join(counts, "seed", "left").groupBy("item", "place", "least").agg(F.max(F.coalesce("n", F.lit(0))).alias("n"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("n").desc(), "place"))
    ranked = places.withColumn("common", (rank < F.col("least")) & (F.col("n") > max(1.0, COMMON * n_docs)))
    need = F.col("least") - F.sum(F.col("common").cast("long")).over(Window.partitionBy("item"))
    kept = written(ranked.withColumn("need", need).filter("not common").select("item", "place", "need"), "rare-places", spark)
    rare = seeds.join(kept, ["item", "place"]).groupBy("seed", "item").agg(F.first("m").alias("m"), F.first("need").alias("need"), F.collect_set("place").alias("places"))
    return written(rare, "rare-seeds", spark), kinds


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Tables (key, id, item, score, first_word, words, m) of leaks by item text, and (item, item id) of the benchmark."""
    spark = long_rows(docs.sparkSession)
    named = benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    named = written(named.withColumn("item", F.unhex(F.md5(F.col("text").cast("binary")))), "items", spark)
    items = written(named.dropDuplicates(["item"]).select("item", "text").mapInArrow(_itemised, "item binary, m bigint, words binary"), "item-words", spark)
    rare, kinds = rare_seeds(docs, items, text_col=text_col, similarity=similarity, n_docs=docs.count(), spark=spark)
    keyed = docs.select(_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    hits = keyed.mapInArrow(_finder(bitmap(rare, "seed"), kinds), f"key binary, id {kind}, seed bigint, at array<bigint>")
    met = written(hits.join(rare, "seed").select("key", "id", "item", "m", "need", "places", "at"), "seed-hits", spark)
    enough = met.groupBy("key", "item", "m", "need").agg(F.collect_set(F.struct("places", "at")).alias("seeds"), F.sum(F.size("places")).alias("n")).filter("n >= need")
    near = enough.select("key", "item", "m", "need", "seeds").mapInArrow(_candidates(similarity), "key binary, item binary, first bigint, end bigint")
    near = written(near.groupBy("key").agg(F.collect_set(F.struct("item", "first", "end")).alias("stretches")), "stretches", spark)
    texts = suspects(keyed, near).dropDuplicates(["key"]).join(near, "key").select("key", "text", "stretches")
    parts = texts.mapInArrow(_slices, "key binary, item binary, first bigint, part binary")
    pairs = parts.join(items, "item").select("key", "item", "first", "part", "m", "words").mapInArrow(_aligned(similarity), "key binary, item binary, score bigint, first_word bigint, words bigint")
    best = pairs.groupBy("key", "item").agg(F.max(F.struct("score", (-F.col("first_word")).alias("first"), "words")).alias("b"))
    best = best.select("key", "item", "b.score", (-F.col("b.first")).alias("first_word"), "b.words")
    ids = met.select("key", "id").distinct()
    return written(best.join(items.select("item", "m"), "item").join(ids, "key"), "leaks", spark), named


def suspects(docs: DataFrame, keys: DataFrame, among: bool = True) -> DataFrame:
    """Rows of ``docs`` whose binary ``key`` may be in ``keys`` (with ``among`` false: surely isn't), without a shuffle."""
    bits = bitmap(keys.select(F.xxhash64("key").alias("h")), "h")

    def may_be(hashes: pa.Array) -> pa.Array:
        return pa.array(_inside(bits.value, hashes.to_numpy(zero_copy_only=False).view(np.uint64)))

    hit = F.arrow_udf(may_be, "boolean")(F.xxhash64("key"))
    return docs.filter(hit if among else ~hit)


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and item that it leaks: their ids, similarity (share of a perfect copy's score), score, first_word, words."""
    found, named = _found(docs, benchmark, id_col, text_col, item_col, item_text_col, similarity)
    pairs = found.join(named.select("item", "item_id"), "item")
    return pairs.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), (F.col("score") / (2 * F.col("m"))).alias("similarity"), "score", "first_word", "words")


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that leak an item. Only rows that may have to go are shuffled."""
    found, _ = _found(docs, benchmark, id_col, text_col, item_col, item_text_col, similarity)
    gone = written(found.select("key").distinct(), "leaking")
    rows = held(docs, key=_key(id_col, text_col))
    rest = suspects(rows, gone).join(gone, "key", "left_anti").select("row", "key")
    return released(suspects(rows, gone, among=False).union(rest), docs.columns)
