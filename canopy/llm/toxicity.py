"""Toxicity by multiple-instance learning: documents are bags of sentences.

Only document labels are known. Each sentence has a score; a document's score is the
noisy-or of its sentences' scores, and the sentence weights are trained through that
noisy-or, so the model also says which sentences offend.

Words are letter or digit runs, A-Z lower-cased. Features of a sentence are hashes of its
words and of their beginnings of 4 to 7 bytes, each at most once; the ``vocabulary`` features
that separate the labels best get a weight. A further weight is for the logarithm of the
document's length, so that one odd word weighs less in a long document. Null and empty
texts have no sentence and score 0. Repeated rows score alike; a very long text is scored whole. An empty table
gives an empty one, and other columns pass whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.llm.stage import fresh, long_rows, quoted, written
from canopy.llm.text import LOWER, NONWORD, Prefix, blocks, mix, spans

#: At most so many labelled documents are used to fit (the smallest hashes of their ids).
FIT_ROWS = 20_000
#: ... with so many bytes of text in all, and none longer than this: with FIT_ROWS the bound of what the driver trains on.
FIT_BYTES, FIT_LONGEST = 64 << 20, 1 << 20
#: Words with a weight.
VOCABULARY = 2_048
THRESHOLD = 0.3
#: Steps of the fit and its quadratic penalty.
ROUNDS, PENALTY = 800, 1e-5
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True
_GOT = pa.struct([("score", pa.float64()), ("n_sentences", pa.int64()), ("worst_start", pa.int64()), ("worst_bytes", pa.int64()), ("worst_score", pa.float64())])
_GOT_DDL = "struct<score:double,n_sentences:bigint,worst_start:bigint,worst_bytes:bigint,worst_score:double>"


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    length: float


#: Lengths of words' beginnings that are features, and what tells their hashes from those of whole words.
BEGINNINGS = (4, 5, 6, 7)
_KINDS = mix(np.array(BEGINNINGS, np.uint64) * np.uint64(0x5DEECE66D1234567))


def _sentences(data: np.ndarray, offsets: np.ndarray):
    """Feature hashes with their sentence; sentences (with a word) with start, end and row; each row's log of words / 100."""
    low = LOWER[data]
    at, to, rows = spans(low, offsets, NONWORD)
    prefix = Prefix(low)
    marks = np.concatenate([[0], np.cumsum(_END[data])])
    part = marks[at] + rows  # grows with each end mark and each row
    first = np.flatnonzero(np.diff(part, prepend=-1))
    sentence = np.repeat(np.arange(len(first)), np.diff(first, append=len(at)))
    last = np.append(first[1:], len(at)) - 1
    longer = [np.flatnonzero(to - at > k) for k in BEGINNINGS]
    hashes = np.concatenate([prefix.of(at, to), *(prefix.of(at[i], at[i] + k) ^ kind for i, k, kind in zip(longer, BEGINNINGS, _KINDS, strict=True))])
    owner = np.concatenate([sentence, *(sentence[i] for i in longer)])
    size = np.log(np.maximum(1, np.bincount(rows, minlength=len(offsets) - 1)) / 100)
    return hashes, owner, at[first], to[last] if len(at) else to, rows[first], size


def _known(words: np.ndarray, hashes: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (sentence, known feature) pairs, by sentence."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    at = np.flatnonzero(words[k] == hashes)
    pairs = np.unique(sentence[at] * len(words) + k[at])
    return pairs // len(words), pairs % len(words)


def _softplus(z):
    return np.logaddexp(0, z)


def _counts(batches):
    """Partial document counts of each word, by label."""
    for b in batches:
        toxic = b.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, data, offsets in blocks(b.column("text")):
            hashes, sentence, _, _, rows, _ = _sentences(data, offsets)
            if not len(hashes):
                continue
            pairs = _distinct(hashes, rows[sentence])
            word, where = np.unique(pairs[0], return_inverse=True)
            bad = toxic[lo + pairs[1].astype(np.int64)]
            n1 = np.bincount(where, bad, len(word)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n1), pa.array(np.bincount(where, minlength=len(word)).astype(np.int64) - n1)], ["word", "n1", "n0"])


def _distinct(hashes, rows):
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new].astype(np.uint64)


def _bags(words: np.ndarray):
    """Each document as its label, the number of sentences, and (sentence, word) hits."""

    def run(batches):
        for b in batches:
            toxic = b.column("toxic").to_pylist()
            for lo, data, offsets in blocks(b.column("text")):
                hashes, sentence, start, _, row, size = _sentences(data, offsets)
                s, k = _known(words, hashes, sentence)
                n, own = len(offsets) - 1, row[s] if len(s) else np.zeros(0, np.int64)
                first = np.searchsorted(row, np.arange(n))
                cut = np.searchsorted(own, np.arange(n + 1))
                yield pa.RecordBatch.from_pylist(
                    [{"toxic": toxic[lo + i], "n": int(np.searchsorted(row, i, "right") - first[i]), "size": float(size[i]), "s": (s[cut[i] : cut[i + 1]] - first[i]).tolist(), "w": k[cut[i] : cut[i + 1]].tolist()} for i in range(n)],
                    schema=pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("size", pa.float64()), ("s", pa.list_(pa.int32())), ("w", pa.list_(pa.int32()))]),
                )

    return run


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = FIT_ROWS, vocabulary: int = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rounds: int = ROUNDS) -> Model:
    """Train on at most ``max_rows`` labelled documents and ``FIT_BYTES`` of whole texts (documented bound: a fixed-size sample by hashed id; a null or empty text isn't in it).

    ``labels`` may repeat an id (the larger label counts); null ids and labels are left out.
    Without labelled documents, or without a toxic one, the model scores everything 0.
    """
    spark = long_rows(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("toxic")).dropna().groupBy("__id").agg(F.max("toxic").alias("toxic"))
    sized = docs.select(quoted(id_col).alias("__id"), F.octet_length(quoted(text_col)).alias("size")).join(marked, "__id").filter(F.col("size") <= FIT_LONGEST)
    sized = written(sized.groupBy("__id").agg(F.sum("size").alias("size"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("__id"), "__id").limit(max_rows), "toxicity-chosen", spark)
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("__id"), "__id"))  # as many rows as the sample
    chosen = sized.withColumn("upto", upto).filter(F.col("upto") <= FIT_BYTES).select("__id", "toxic")
    sample = written(docs.select(quoted(id_col).alias("__id"), quoted(text_col).alias("text")).filter(F.octet_length("text") <= FIT_LONGEST).join(F.broadcast(chosen), "__id").select("text", "toxic"), "toxicity-fit", spark)
    counts = sample.mapInArrow(_counts, "word bigint, n1 bigint, n0 bigint").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -50.0, 0.0)
    share1, share0 = F.col("n1") / F.lit(float(bad)), F.col("n0") / F.lit(float(max(1, good)))
    spread = (share1 - share0) / F.sqrt((F.col("n1") + F.col("n0") + 4) / F.lit(float(bad + good)))
    top = counts.filter("n1 + n0 >= 3").orderBy(F.abs(spread).desc(), "word").limit(vocabulary).toPandas()
    words = np.sort(top["word"].to_numpy().astype(np.int64).view(np.uint64))
    bags = sample.mapInArrow(_bags(words), "toxic int, n bigint, size double, s array<int>, w array<int>").toArrow()
    return _train(words, bags, rounds)


def _train(words: np.ndarray, bags: pa.Table, rounds: int) -> Model:
    """Adam on the noisy-or likelihood with a small quadratic penalty."""
    bags = bags.combine_chunks()
    y = bags["toxic"].to_numpy().astype(float)
    n, size = bags["n"].to_numpy(), bags["size"].to_numpy()
    s, w = bags["s"].combine_chunks(), bags["w"].combine_chunks()
    doc = np.repeat(np.arange(len(y)), np.diff(s.offsets.to_numpy()))
    key = doc * (int(n.max(initial=0)) + 1) + s.flatten().to_numpy()
    w = w.flatten().to_numpy()
    unique, where = np.unique(key, return_inverse=True)  # sentences with a known word
    owner = np.zeros(len(unique), np.int64)
    owner[where] = doc
    plain = n - np.bincount(owner, minlength=len(y))
    theta = np.concatenate([np.zeros(len(words)), [-1.0, -5.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        base = theta[-1] + theta[-2] * size
        z = base[owner] + np.bincount(where, theta[w], len(unique))
        total = np.bincount(owner, _softplus(z), len(y)) + plain * _softplus(base) + 1e-9
        slope = np.where(y > 0, -1 / np.expm1(np.minimum(total, 50)), 1.0)
        each = slope[owner] / (1 + np.exp(-z))
        rest = slope * plain / (1 + np.exp(-base))
        grad = np.concatenate([np.bincount(w, each[where], len(words)), [(each * size[owner]).sum() + (rest * size).sum(), each.sum() + rest.sum()]])
        grad = grad / len(y) + PENALTY * np.append(theta[:-2], [0, 0])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Model(words, theta[:-2], float(theta[-1]), float(theta[-2]))


def scorer(model: Model):
    """A column function: text to struct(score, n_sentences, worst_start, worst_bytes, worst_score).

    ``worst_*`` is the sentence with the highest score as a byte range of the text (ties: the first).
    """

    def run(text: pa.Array) -> pa.Array:
        parts = []
        for _, data, offsets in blocks(text):
            hashes, sentence, start, end, row, size = _sentences(data, offsets)
            n = len(offsets) - 1
            s, k = _known(model.words, hashes, sentence)
            z = model.bias + model.length * size[row] + np.bincount(s, model.weights[k], len(start))
            score = -np.expm1(-np.bincount(row, _softplus(z), n))
            count = np.bincount(row, minlength=n)
            order = np.lexsort((np.arange(len(z)), -z, row))
            first = order[np.searchsorted(row[order], np.arange(n)[count > 0])]
            worst = np.full(n, -1)
            worst[count > 0] = first
            none, at = worst < 0, np.maximum(worst, 0)
            take = lambda x: np.where(none, 0, x[at]) if len(x) else np.zeros(n, x.dtype)
            base = take(start) - np.where(none, 0, offsets[:-1])
            columns = [np.where(count > 0, score, 0.0), count.astype(np.int64), base.astype(np.int64), (take(end) - take(start)).astype(np.int64), take(1 / (1 + np.exp(-z)))]
            parts.append(pa.StructArray.from_arrays([pa.array(c, f.type, mask=none if i in (2, 3, 4) else None) for i, (c, f) in enumerate(zip(columns, _GOT, strict=True))], fields=list(_GOT)))
        return pa.concat_arrays(parts) if parts else pa.array([], _GOT)

    return F.arrow_udf(run, _GOT_DDL)


def toxicity(docs: DataFrame, model: Model, text_col: str = "text", result: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` plus ``result``: the struct of :func:`scorer`; it takes the place of an input column of its name."""
    return docs.select(*(quoted(c) for c in docs.columns if c.lower() != result.lower()), scorer(model)(quoted(text_col)).alias(result))


def below(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents whose score is under the threshold, with the columns of ``docs``."""
    name = fresh(docs, "toxicity")
    return toxicity(docs, model, text_col, name).filter(F.col(name)["score"] < threshold).drop(name)
