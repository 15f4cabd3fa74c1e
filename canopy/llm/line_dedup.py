"""Line dedup by content-defined chunks.

A hash rolls over each two neighbouring lines that have a word. Of every two neighbouring
rolling hashes the smaller one marks a boundary, so boundaries depend on three or four lines only
and move along with inserted or deleted ones; the two lines at a boundary are a chunk. A line of
``LONG`` words or more is a chunk of its own (a paragraph; two such lines need no further chunk).
Chunks that occur more than once in the corpus are removed except for their first occurrence
(smallest id, then position; null ids last), after their bytes have been compared with it; so is
a line next to a removed chunk if it equals, byte for byte, the one next to the first occurrence.
As any three lines hold a boundary, every run of three lines or more that occurs earlier goes
whole, and of one of two lines or of one long line nothing is missed but two-line runs without a boundary.

Identity of a row is its (id, text): rows that repeat both are treated alike, so neither
of two identical rows loses a chunk to the other. Null and empty texts have no chunk; lines
without a word are never in the way of a chunk as long as they are the same, and go when the
lines on both sides go. Lines end at U+000A; a removed line goes with its line end. Within a
document, an occurrence that overlaps the chunk's first one stays. All other columns pass,
whatever their names; the result column takes the place of an input column of its name. Very long texts are taken
whole; an empty table gives an empty one.

Shuffled texts are compressed. Only hashes are counted; bytes move for repeated chunks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.stage import held, long_rows, quoted, released, written
from canopy.llm.text import Prefix, SPACE, blocks, mix

#: Words from which on a line is a chunk of its own (``long_words``; a paragraph as one line is no shorter than many passages of three lines).
LONG = 50
_CHUNK = "key binary, id string, at bigint, until bigint, hash bigint"


def _line_table(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends (line end included) and rows of all lines."""
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks[breaks < len(data)])
    return starts, np.append(starts[1:], len(data)), np.searchsorted(offsets, starts, "right") - 1


def _word_lines(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends, rows and words of the lines that have a word."""
    starts, ends, rows = _line_table(data, offsets)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] |= inside[edge]
    before = np.concatenate([[0], np.cumsum(first)])
    words = before[ends] - before[starts] if len(starts) else np.zeros(0, np.int64)
    full = np.flatnonzero(words)
    return starts[full], ends[full], rows[full], words[full]


def chunk_table(data: np.ndarray, offsets: np.ndarray, long_words: int = LONG):
    """Row, start, end (line end included) and hash (without the last line end) of every chunk."""
    starts, ends, rows, words = _word_lines(data, offsets)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    prefix = Prefix(data)
    content = ends - (data[ends - 1] == 10)
    lines = prefix.of(starts, content)
    long = words >= long_words
    one = np.flatnonzero(long)
    pair = np.flatnonzero(rows[1:] == rows[:-1])
    rolled = mix(lines[pair] * np.uint64(3) + lines[pair + 1])
    # neighbours of a pair, if they are in the same row
    after = np.append(pair[1:] == pair[:-1] + 1, False) if len(pair) else np.zeros(0, bool)
    before = np.append(False, after[:-1])[: len(pair)]
    chosen = ~(after | before)
    chosen[:-1] |= after[:-1] & (rolled[:-1] <= rolled[1:])
    chosen[1:] |= before[1:] & (rolled[1:] < rolled[:-1])
    pair = pair[chosen & ~(long[pair] & long[pair + 1])]
    first, last = np.concatenate([one, pair]), np.concatenate([one, pair + 1])
    order = np.argsort(starts[first], kind="stable")
    first, last = first[order], last[order]
    return rows[first], starts[first], ends[last], prefix.of(starts[first], content[last])


def _chunks(long_words: int):
    def run(batches):
        for b in batches:
            for lo, data, offsets in blocks(b.column(2)):
                row, start, end, code = chunk_table(data, offsets, long_words)
                own = pa.array(lo + row)
                base = offsets[row]
                columns = [start - base, end - base, code.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pc.take(b.column(0), own).cast(pa.binary()), pc.take(b.column(1), own), *(pa.array(c.astype(np.int64)) for c in columns)], ["key", "id", "at", "until", "hash"])

    return run


def _zip(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else zlib.compress(t, 1) for t in text.cast(pa.binary()).to_pylist()], pa.binary())


def _line(text: bytes, at: int, until: int) -> bytes:
    return text[at : until - 1] if text[until - 1 : until] == b"\n" else text[at:until]


_PART = pa.struct([("at", pa.int64()), ("until", pa.int64()), ("bytes", pa.binary())])
_PART_DDL = "struct<at:bigint,until:bigint,bytes:binary>"


def _cut_out(batches):
    """Bytes of the marked chunks of each document, and the lines next to them (of copies: those that no copy has)."""
    for b in batches:
        out, size = [[] for _ in range(6)], 0
        for key, z, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
            text = zlib.decompress(z)
            data = np.frombuffer(text, np.uint8)
            starts, ends, _, _ = _word_lines(data, np.array([0, len(data)]))
            firsts = {m["hash"]: m["until"] for m in found if m["first"]}
            marked = np.zeros(len(starts) + 1, np.int64)
            for m in found:
                if not m["first"]:
                    marked[np.searchsorted(starts, m["at"])] += 1
                    marked[np.searchsorted(starts, m["until"])] -= 1
            marked = np.cumsum(marked)
            for m in found:
                if not m["first"] and m["at"] < firsts.get(m["hash"], 0):
                    continue
                lo, hi = np.searchsorted(starts, (m["at"], m["until"]))
                near = [None if not 0 <= k < len(starts) or marked[k] and not m["first"] else {"at": starts[k], "until": ends[k], "bytes": _line(text, starts[k], ends[k])} for k in (lo - 1, hi)]
                part = {"at": m["at"], "until": m["until"], "bytes": _line(text, m["at"], m["until"])}
                for column, v in zip(out, (key, m["hash"], m["first"], part, *near), strict=True):
                    column.append(v)
                size += 2 * (m["until"] - m["at"])
            if size > 4 << 20:
                yield _cut(out)
                out, size = [[] for _ in range(6)], 0
        yield _cut(out)


def _cut(out):
    kinds = (pa.binary(), pa.int64(), pa.bool_(), _PART, _PART, _PART)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["key", "hash", "first", "chunk", "before", "after"])


_REMOVED = pa.list_(pa.struct([("first_line", pa.int64()), ("lines", pa.int64())]))
_CLEAN = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("removed", _REMOVED)])


def _count(text: bytes) -> int:
    return text.count(b"\n") + (len(text) > 0 and not text.endswith(b"\n"))


def cleaned(text: bytes, spans) -> dict:
    """``text`` without byte ranges of whole lines, and without lines that have no word between two of them."""
    gone: list[list[int]] = []
    for a, b in sorted(spans):
        if gone and (a <= gone[-1][1] or not text[gone[-1][1] : a].strip(b" \t\n\v\f\r")):
            gone[-1][1] = max(gone[-1][1], b)
        else:
            gone.append([a, b])
    parts, at, removed = [], 0, []
    line = 0
    for a, b in gone:
        parts.append(text[at:a])
        line += parts[-1].count(b"\n")
        removed.append({"first_line": line, "lines": _count(text[a:b])})
        line += text[a:b].count(b"\n")
        at = b
    parts.append(text[at:])
    rest = b"".join(parts)
    if gone and at == len(text) and not text.endswith(b"\n") and rest.endswith(b"\n"):
        rest = rest[:-1]
    return {"text": rest.decode(), "n_lines": _count(text), "n_removed": sum(r["lines"] for r in removed), "removed": removed}


def _cleaned(packed: pa.Array, marks: pa.Array) -> pa.Array:
    out = []
    for z, found in zip(packed.to_pylist(), marks.to_pylist(), strict=True):
        if z is None:
            out.append({"text": None, "n_lines": 0, "n_removed": 0, "removed": []})
        else:
            out.append(cleaned(zlib.decompress(z), [(m["at"], m["until"]) for m in found or []]))
    return pa.array(out, _CLEAN)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", result: str = "lines", long_words: int = LONG) -> DataFrame:
    """All columns, the text cleaned, plus ``result``: struct(n_lines, n_removed, removed spans of lines)."""
    spark = long_rows(docs.sparkSession)
    id_, text = quoted(id_col), quoted(text_col)
    id_text = F.format_string("%020d", id_) if docs.schema[id_col].dataType.typeName() in ("long", "integer", "short", "byte") else id_.cast("string")
    key = F.unhex(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("\0")), F.lit("\0"), F.coalesce(text, F.lit(""))).cast("binary")))
    # negative numbers sort after others as text; the order only has to be the same for everyone
    chunks = docs.select(key.alias("key"), id_text.alias("id"), text.alias("text")).mapInArrow(_chunks(long_words), _CHUNK)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key", "at")
    repeated = chunks.groupBy("hash").agg(F.min(place).alias("place"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = written(repeated, "line-hashes", spark)
    marked = chunks.join(repeated, "hash").withColumn("first", place == F.col("place"))
    lists = marked.groupBy("key").agg(F.collect_set(F.struct("at", "until", "hash", "first")).alias("marks"))
    packed = F.arrow_udf(_zip, "binary")(text)
    kind = f"key binary, hash bigint, first boolean, chunk {_PART_DDL}, before {_PART_DDL}, after {_PART_DDL}"
    found = docs.select(key.alias("key"), packed.alias("z")).join(lists, "key").select("key", "z", "marks").mapInArrow(_cut_out, kind)
    found = written(found, "line-chunks", spark)
    first = found.filter("first").select("hash", F.col("chunk.bytes").alias("same"), F.col("before.bytes").alias("same_before"), F.col("after.bytes").alias("same_after"))
    first = written(first.dropDuplicates(["hash"]), "line-firsts", spark)
    pairs = found.filter("not first").join(first, "hash").filter(F.col("chunk.bytes") == F.col("same"))
    span = lambda c: F.struct(F.col(f"{c}.at").alias("at"), F.col(f"{c}.until").alias("until"))
    gone = F.array(span("chunk"), *(F.when(F.col(f"{c}.bytes") == F.col(f"same_{c}"), span(c)) for c in ("before", "after")))
    removed = pairs.select("key", F.explode(gone).alias("span")).filter("span is not null").groupBy("key").agg(F.collect_set("span").alias("marks"))
    rows = held(docs, (text_col,), z=packed, key=key).join(removed, "key", "left")
    done = rows.withColumn("clean", F.arrow_udf(_cleaned, "struct<text:string,n_lines:bigint,n_removed:bigint,removed:array<struct<first_line:bigint,lines:bigint>>>")("z", "marks"))
    return released(done, docs.columns, **{text_col: F.col("clean.text"), result: F.struct("clean.n_lines", "clean.n_removed", "clean.removed")})


def remaining(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, long_words: int = LONG) -> DataFrame:
    """The columns of ``docs`` with cleaned texts, without documents that lost all their words; ``size_col`` (code points of the text) follows where a text was cut."""
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), F.struct(*(quoted(c).alias(c) for c in docs.columns if c != text_col)).alias("row"))
    done = dedup_lines(rows, id_col="id", text_col="text", result="lines", long_words=long_words)
    cut = F.col("lines.n_removed") > 0
    left = done.filter(~cut | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    given = {text_col: F.col("text")}
    if size_col in docs.columns:
        size = F.when(cut, F.length("text")).otherwise(F.col("row").getField(size_col))
        given[size_col] = size.cast(docs.schema[size_col].dataType)
    return released(left, docs.columns, **given)
