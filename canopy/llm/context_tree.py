"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision (the bits before it in its byte) has a context
tree over the bytes that came before, ``DEPTH`` deep. A node's counts of zeros and ones give the
Krichevsky-Trofimov probability of its sequence, and its weighted probability is half of that plus
half of the product of its children's. A bit's probability mixes the estimates of all depths
along its context by these weights, as learnt from all training texts; a text's score is the sum over
its bits and those of an end mark (a byte that UTF-8 never has, as is the one before a text's start).

How it runs, whatever the model's size:

* texts are dealt to blocks of some MB. A block's distinct grams (context and next byte) and
  words are packed, by bucket of the last two context bytes or of the word's hash, with their training
  counts: a few per cent as many as bytes;
* buckets are merged in rounds, so that a task never meets more than ``FAN`` rows of a bucket; all
  contexts from depth 2 on lie within one bucket, and depths 0 and 1 have 65,280 decisions at most, which are
  added up and given to all tasks;
* each bucket scores its grams once; blocks ask for theirs (a bucket is dealt to several tasks if
  many blocks ask), and texts, bucketed by block, meet the answers of their own block.

The base score is that of single words with one added to each count. Words are known by 64-bit hashes.

Defined cases: null texts are empty; an empty text is one end mark and one end token; without training
texts every bit has probability one half and every word is unknown; repeated rows count as often as they come; an empty
table gives an empty one. Other columns may have any name and come back as they are; a column of the
name of the result's struct gives way to it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from canopy.llm.stage import bucketed, held, long_rows, quoted, released, written
from canopy.llm.text import LOWER, Prefix, blocks, buffers, mix, spans

DEPTH = 5
#: Bytes of text in a block, about; places that are worked on at once; buckets; rows of a bucket that meet in a task.
BLOCK, SLICE, BUCKETS, FAN = 16 << 20, 1 << 19, 256, 2_048
#: Logarithms are kept as whole numbers of this part of one.
UNIT = 2.0**-32
START, END = 0xFE, 0xFF
#: The key of the end token among the words' hashes.
LAST = np.uint64(0)
GRAM, TOKEN = 0, 1


def pack(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def grams(data: np.ndarray, offsets: np.ndarray, depth: int):
    """(keys, rows) of all places, in slices: the last ``depth`` bytes, latest first, then the next byte."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    rows = np.repeat(np.arange(n), size)
    out = np.full(len(data) + n * (depth + 1), START, np.uint8)
    out[np.arange(len(data)) + rows * (depth + 1) + depth] = data
    out[offsets[1:] + np.arange(1, n + 1) * (depth + 1) - 1] = END
    rows = np.repeat(np.arange(n), size + 1)
    at = np.arange(len(rows)) + (rows + 1) * depth
    for lo in range(0, len(at), SLICE):
        i = at[lo : lo + SLICE]
        key = np.zeros(len(i), np.uint64)
        for m in range(1, depth + 1):
            key = (key << np.uint64(8)) | out[i - m]
        yield (key << np.uint64(8)) | out[i], rows[lo : lo + SLICE]


def tokens(data: np.ndarray, offsets: np.ndarray):
    """(keys, rows) of all words and of the end of each text."""
    low = LOWER[data]
    at, to, rows = spans(low, offsets)
    n = len(offsets) - 1
    return np.concatenate([Prefix(low).of(at, to), np.full(n, LAST)]), np.concatenate([rows, np.arange(n)])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def _blocks(size: int):
    def run(batches):
        block, room = (TaskContext.get().partitionId() << 32) - 1, 0
        for b in batches:
            own = np.zeros(len(b), np.int64)
            for i, n in enumerate(np.diff(buffers(b.column(2))[1]).tolist()):
                if room <= 0:
                    block, room = block + 1, size
                own[i] = block
                room -= n + 16
            yield pa.RecordBatch.from_arrays([pa.array(own), *b.columns], ["block", "row", "train", "text"])

    return run


class _Counter:
    """Distinct keys of a block and how often each is in training texts."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, train: np.ndarray) -> None:
        for k, counted in ((keys[train], True), (keys[~train], False)):
            u, c = np.unique(k, return_counts=True)
            self.parts.append((u, c if counted else np.zeros(len(u), np.int64)))
        if len(self.parts) > 16:
            self.parts = [self.all()]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))


def _bucket(family: int, keys: np.ndarray, depth: int) -> np.ndarray:
    return (mix(keys >> np.uint64(8 * (depth - 1)) if family == GRAM else keys) % np.uint64(BUCKETS)).astype(np.int64)


def _counted(depth: int):
    names = ["block", "family", "bucket", "keys", "counts"]

    def rows(block, counters):
        for family, counter in counters.items():
            keys, counts = counter.all()
            bucket = _bucket(family, keys, depth)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                own = order[cuts[b] : cuts[b + 1]]
                yield block, family, b, pack_keys(keys[own]), pack(counts[own])

    def batch(block, counters):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows(block, counters), strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names)

    def run(batches):
        now, counters = None, {}
        for b in batches:
            block, train = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(b)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y:
                    continue
                if block[x] != now:
                    if counters:
                        yield batch(now, counters)
                    now, counters = int(block[x]), {GRAM: _Counter(), TOKEN: _Counter()}
                for lo, data, offsets in blocks(b.column(2).slice(x, y - x)):
                    known = train[x + lo : x + lo + len(offsets) - 1]
                    for keys, rows_ in grams(data, offsets, depth):
                        counters[GRAM].add(keys, known[rows_])
                    keys, rows_ = tokens(data, offsets)
                    counters[TOKEN].add(keys, known[rows_])
        if counters:
            yield batch(now, counters)

    return run


_MERGED = "family int, bucket int, keys binary, counts binary, kinds long, total long"


def _merged(batches):
    """One row for each run of rows of one bucket; ``kinds`` of its keys have a count, ``total`` is their sum."""
    key, parts = None, []

    def row():
        keys, counts = summed(np.concatenate([unpack_keys(k) for k, _ in parts]), np.concatenate([unpack(c, np.int64) for _, c in parts]))
        values = [key[0], key[1], pack_keys(keys), pack(counts), int((counts > 0).sum()), int(counts.sum())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["family", "bucket", "keys", "counts", "kinds", "total"])

    for b in batches:
        for family, bucket, keys, counts in zip(*(b.column(n).to_pylist() for n in ("family", "bucket", "keys", "counts")), strict=True):
            if (family, bucket) != key:
                if parts:
                    yield row()
                key, parts = (family, bucket), []
            parts.append((keys, counts))
            if len(parts) >= 64:
                k, c = summed(np.concatenate([unpack_keys(k) for k, _ in parts]), np.concatenate([unpack(c, np.int64) for _, c in parts]))
                parts = [(pack_keys(k), pack(c))]
    if parts:
        yield row()


def _merge(items: DataFrame, fan: int) -> DataFrame:
    """Items of all blocks as one row a bucket, in rounds."""
    most = items.groupBy("family", "bucket").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    source = F.col("block")
    while True:
        salts = -(-most // fan)
        dealt = items.withColumn("salt", F.pmod(F.xxhash64(source), F.lit(salts))).repartition("family", "bucket", "salt").sortWithinPartitions("family", "bucket", "salt")
        items = written(dealt.select("family", "bucket", "keys", "counts").mapInArrow(_merged, _MERGED), "lm-merged")
        if salts == 1:
            return items
        most, source = salts, F.crc32("keys")


def _lgamma(x: np.ndarray) -> np.ndarray:
    low = np.zeros_like(x)
    for k in range(8):
        low += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) - low


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the estimator's probability of any sequence of so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - np.log(np.pi)


def _mixed(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of a node's own estimate against its children's, and its weighted probability (logarithm)."""
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(below - own)), np.logaddexp(own, below) - np.log(2)


class Contexts:
    """The context trees of one bucket from depth 2 on: for each depth and bit (nodes, zeros, ones, own weight, weighted probability)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.keys, self.depth = keys, depth
        self.nodes: dict[tuple[int, int], tuple] = {}
        cells, n = keys, counts
        for k in range(depth, 1, -1):
            byte = (cells & np.uint64(255)).astype(np.int64)
            for j in range(8):
                node = (cells >> np.uint64(8) << np.uint64(8)) | ((1 << j) | (byte >> (8 - j))).astype(np.uint64)
                first = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
                one = (byte >> (7 - j)) & 1
                add = lambda x, first=first: (np.add.reduceat(x, first) if len(first) else x).astype(float)
                zeros, ones = add(n * (1 - one)), add(n * one)
                own, node = log_kt(zeros, ones), node[first]
                if k == depth:
                    self.nodes[k, j] = node, zeros, ones, None, own
                    continue
                child, *_, weighted = self.nodes[k + 1, j]
                up = np.searchsorted(node, (child >> np.uint64(16) << np.uint64(8)) | (child & np.uint64(255)))
                self.nodes[k, j] = node, zeros, ones, *_mixed(own, np.bincount(up, weighted, len(node)))
            if k > 2:
                cells, n = summed((cells >> np.uint64(16) << np.uint64(8)) | (cells & np.uint64(255)), n)

    def gathered(self) -> np.ndarray:
        """256 x 256 x 3: zeros, ones and children's weighted probability of each decision of each context of one byte."""
        out = np.zeros((65_536, 3))
        for j in range(8):
            node, zeros, ones, _, weighted = self.nodes[2, j]
            at = ((node >> np.uint64(16) << np.uint64(8)) | (node & np.uint64(255))).astype(np.int64)
            for c, v in enumerate((zeros, ones, weighted)):
                out[:, c] += np.bincount(at, v, 65_536)
        return out

    def scores(self, upper: np.ndarray) -> np.ndarray:
        """log10 of the probability of each key's last byte in its context."""
        total = np.zeros(len(self.keys))
        byte = (self.keys & np.uint64(255)).astype(np.int64)
        for j in range(8):
            heap, one = (1 << j) | (byte >> (8 - j)), ((byte >> (7 - j)) & 1).astype(bool)
            p = None
            for k in range(self.depth, 1, -1):
                node, zeros, ones, weight, _ = self.nodes[k, j]
                at = np.searchsorted(node, (self.keys >> np.uint64(8 * (self.depth - k) + 8) << np.uint64(8)) | heap.astype(np.uint64))
                kt = (np.where(one, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
                p = kt if p is None else weight[at] * kt + (1 - weight[at]) * p
            latest = (self.keys >> np.uint64(8 * self.depth)).astype(np.int64)
            for part in (upper[1 + latest, heap], upper[0, heap]):
                kt, weight = np.where(one, 1 - part[:, 0], part[:, 0]), part[:, 1]
                p = weight * kt + (1 - weight) * p
            total += np.log10(p)
        return total


def upper_levels(gathered: np.ndarray) -> np.ndarray:
    """257 x 256 x 2: estimate of a zero and own weight of each decision, without context (first) and after each byte."""
    g = gathered.reshape(256, 256, 3)
    weight, weighted = _mixed(log_kt(g[..., 0], g[..., 1]), g[..., 2])
    zeros, ones = g[..., 0].sum(0), g[..., 1].sum(0)
    top, _ = _mixed(log_kt(zeros, ones), weighted.sum(0))
    kt = lambda a, b: (a + 0.5) / (a + b + 1)
    return np.concatenate([np.stack([kt(zeros, ones), top], -1)[None], np.stack([kt(g[..., 0], g[..., 1]), weight], -1)])


def _upper(depth: int):
    def run(batches):
        out = np.zeros((65_536, 3))
        for b in batches:
            for keys, counts in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
                out += Contexts(unpack_keys(keys), unpack(counts, np.int64), depth).gathered()
        at = np.flatnonzero(out.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(out[at, c]) for c in range(3))], ["at", "zeros", "ones", "below"])

    return run


def _valued(depth: int, upper: np.ndarray):
    """Of each bucket's keys the value: a gram's log10 probability in units, or a word's count."""

    def run(batches):
        for b in batches:
            for family, bucket, keys, counts in zip(*(b.column(n).to_pylist() for n in ("family", "bucket", "keys", "counts")), strict=True):
                n = unpack(counts, np.int64)
                v = np.rint(Contexts(unpack_keys(keys), n, depth).scores(upper) / UNIT).astype(np.int64) if family == GRAM else n
                yield pa.RecordBatch.from_arrays([pa.array([family], pa.int32()), pa.array([bucket], pa.int32()), pa.array([keys], pa.binary()), pa.array([pack(v)], pa.binary())], ["family", "bucket", "keys", "values"])

    return run


def _answered(batches):
    """Values for what each block asks; the values of a bucket come before those who ask."""
    key = model = None
    for b in batches:
        out = []
        for family, bucket, block, keys, values in zip(*(b.column(n).to_pylist() for n in ("family", "bucket", "block", "keys", "values")), strict=True):
            if values is not None:
                key, model = (family, bucket), (unpack_keys(keys), unpack(values, np.int64))
                continue
            if (family, bucket) != key:
                raise ValueError("a bucket that is asked for has no values")
            out.append((block, family, keys, pack(model[1][np.searchsorted(model[0], unpack_keys(keys))])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "family", "keys", "values"])


def _scored(depth: int, known: int, total: int):
    """Sums over each text of one block, from the answers for it."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        family = answers["family"].to_numpy()
        tables = {}
        for f in (GRAM, TOKEN):
            own = answers.filter(pa.array(family == f))
            k, v = np.concatenate([unpack_keys(x) for x in own["keys"].to_pylist()]), np.concatenate([unpack(x, np.int64) for x in own["values"].to_pylist()])
            order = np.argsort(k)
            tables[f] = k[order], v[order]

        def look(f, keys, rows):
            """Values of keys, with their rows, in the order of keys, in which lookups stay near one another."""
            order = np.argsort(keys)
            return rows[order], tables[f][1][np.searchsorted(tables[f][0], keys[order])]

        parts = []
        for _, data, offsets in blocks(texts["text"]):
            n = len(offsets) - 1
            score = np.zeros(n)
            for keys, rows in grams(data, offsets, depth):
                rows, found = look(GRAM, keys, rows)
                score += np.bincount(rows, found, n)
            rows, c = look(TOKEN, *tokens(data, offsets))
            base = np.bincount(rows, np.log10((c + 1) / (total + known + 1)), n)
            parts.append((np.bincount(rows, minlength=n), np.bincount(rows[c > 0], minlength=n), np.full(n, total), base, score * UNIT))
        lm = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["n_tokens", "n_known", "train_tokens", "base_score", "score"])
        return pa.table({"row": texts["row"], "text": texts["text"], "lm": lm})

    return run


def score_texts(docs: DataFrame, train: Column, *, text_col: str = "text", name: str = "lm", depth: int = DEPTH, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """``docs`` and ``name``: a struct of n_tokens, n_known, train_tokens, base_score and score (both log10).

    ``train`` says which rows are learnt from; ``depth`` is 2 to 7 bytes.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth is 2 to 7")
    spark = long_rows(docs.sparkSession)
    rows = held(docs, (text_col, name), train=F.coalesce(train, F.lit(False)), text=quoted(text_col))
    kind = rows.schema["row"].dataType
    dealt = bucketed(rows.mapInArrow(_blocks(block), StructType().add("block", "long").add("row", kind).add("train", "boolean").add("text", "string")), "block", "lm_texts", spark, ordered=True)
    items = dealt.select("block", "train", "text").mapInArrow(_counted(depth), "block long, family int, bucket int, keys binary, counts binary")
    items = written(items, "lm-items", spark)
    model = _merge(items, fan)
    upper = np.zeros((65_536, 3))
    for r in model.filter(F.col("family") == GRAM).mapInArrow(_upper(depth), "at long, zeros double, ones double, below double").groupBy("at").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).collect():
        upper[r[0]] = r[1:]  # 65,280 rows at most
    words = model.filter(F.col("family") == TOKEN).agg(F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    values = written(model.mapInArrow(_valued(depth, upper_levels(upper)), "family int, bucket int, keys binary, values binary"), "lm-values", spark)
    most = items.groupBy("family", "bucket").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    salts = -(-most // fan)
    none = F.lit(None)
    told = values.select("family", "bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), none.cast("long").alias("block"), "keys", "values")
    asked = items.select("family", "bucket", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), "block", "keys", none.cast("binary").alias("values"))
    met = told.unionByName(asked).repartition("family", "bucket", "salt").sortWithinPartitions("family", "bucket", "salt", F.col("block").asc_nulls_first())
    answers = met.mapInArrow(_answered, "block long, family int, keys binary, values binary")
    schema = StructType().add("row", kind).add("text", "string").add("lm", StructType.fromDDL("n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    # texts are bucketed by block, so that answers alone move
    done = dealt.select("block", "row", "text").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(depth, words[0], words[1]), schema)
    return released(done, docs.columns, **{text_col: F.col("text"), name: F.col("lm")})
