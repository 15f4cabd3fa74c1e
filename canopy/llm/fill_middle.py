"""Fill-in-middle documents, cut at line ends by a learned rank index.

A text is a row of units, lines with their ends. Two draws of the document's id say after how
many units prefix and middle end; the three parts are written with sentinels, either prefix,
suffix, middle (``psm``) or suffix, prefix, middle (``spm``).

Where a unit ends is asked of a piecewise-linear index over the ranks of all unit ends of a block
of texts: segments are fitted so that no end is further than ``BOUND`` bytes from its line, the
distance that is left (one byte an end) is stored, and a cut is the predicted place plus it. So
a cut is exact, and what is kept of the ends is a byte each.

Defined cases: a null text is an empty one and empty texts stay plain; a null id draws as an
empty one; a text that holds a sentinel stays plain, since it couldn't be taken apart again;
rows that repeat an id draw alike and all come back; an empty table gives an empty one. Further
columns may have any name and come back as they are; a column of the name of the result's struct
gives way to it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from canopy.llm.stage import held, long_rows, quoted, released
from canopy.llm.text import blocks

#: Bytes between an end and its segment, at most (with rounding they fit in one signed byte).
BOUND = 96
SENTINELS = ("<P>", "<S>", "<M>")


class RankIndex:
    """Places of an ascending sequence by rank: error-bounded segments and one byte a place."""

    def __init__(self, places: np.ndarray, bound: int = BOUND):
        first, slope = [], []
        i, n = 0, len(places)
        while i < n:
            span = 64
            while True:
                ahead = np.arange(1, min(span, n - 1 - i) + 1)
                rise = places[i + 1 : i + 1 + len(ahead)] - places[i]
                low, high = np.maximum.accumulate((rise - bound) / ahead), np.minimum.accumulate((rise + bound) / ahead)
                wrong = low > high
                if wrong.any() or len(ahead) < span:
                    break
                span *= 4
            kept = int(wrong.argmax()) if wrong.any() else len(ahead)
            first.append(i)
            slope.append((low[kept - 1] + high[kept - 1]) / 2 if kept else 0.0)
            i += kept + 1
        self.first, self.slope = np.array(first, np.int64), np.array(slope)
        self.base = places[self.first] if n else np.zeros(0, np.int64)
        off = places - self.predicted(np.arange(n))
        self.off = off.astype(np.int8)
        if not np.array_equal(self.off, off):
            raise ValueError(f"a segment is more than {bound} bytes off")

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.first, ranks, "right") - 1
        return self.base[s] + np.rint(self.slope[s] * (ranks - self.first[s])).astype(np.int64)

    def places(self, ranks: np.ndarray) -> np.ndarray:
        return self.predicted(ranks) + self.off[ranks]


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where lines end, line ends included; the last line of a text need not have one."""
    return np.union1d(np.flatnonzero(data == 10) + 1, offsets[1:][np.diff(offsets) > 0])


def _holds(data: np.ndarray, offsets: np.ndarray, words: tuple[bytes, ...]) -> np.ndarray:
    """Texts that hold one of the words."""
    found = np.zeros(len(offsets) - 1, bool)
    for w in words:
        at = np.flatnonzero(data[: max(0, len(data) - len(w) + 1)] == w[0])
        for k in range(1, len(w)):
            at = at[data[at + k] == w[k]]
        row = np.searchsorted(offsets, at, "right") - 1
        found[row[at + len(w) <= offsets[row + 1]]] = True
    return found


def _cut(sentinels: tuple[str, ...], rate: int, spm: int, bound: int):
    pre, suf, mid = marks = tuple(s.encode() for s in sentinels)

    def run(batches):
        for b in batches:
            for lo, data, offsets in blocks(b.column(1)):
                n = len(offsets) - 1
                h1, h2, h3, h4 = (b.column(2).field(k).slice(lo, n).to_numpy() for k in range(4))
                ends = unit_ends(data, offsets)
                before = np.searchsorted(ends, offsets, "right")
                units = np.diff(before)
                index = RankIndex(ends, bound)
                del ends
                x, y = h1 % (units + 1), h2 % (units + 1)
                place = lambda k: np.where(k > 0, index.places(np.maximum(before[:-1] + k - 1, 0)), offsets[:-1]) if len(index.off) else offsets[:-1]  # noqa: B023, E731
                one, two = place(np.minimum(x, y)), place(np.maximum(x, y))
                plain = (units == 0) | _holds(data, offsets, marks) | (h3 % 100 >= rate)
                turned = h4 % 100 < spm
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                texts = []
                for i in range(n):
                    a, c, d, e = (data[p:q].tobytes() for p, q in ((offsets[i], one[i]), (one[i], two[i]), (two[i], offsets[i + 1]), (offsets[i], offsets[i + 1] if plain[i] else offsets[i])))
                    texts.append(e if plain[i] else suf + d + pre + a + mid + c if turned[i] else pre + a + suf + d + mid + c)
                form = pa.array(np.where(plain, "plain", np.where(turned, "spm", "psm")).tolist(), pa.string())
                size = lambda p, q: pa.array(chars[q] - chars[p], mask=plain)  # noqa: B023, E731
                fim = pa.StructArray.from_arrays([pa.array(units.astype(np.int64)), form, size(offsets[:-1], one), size(one, two)], ["n", "form", "prefix_chars", "middle_chars"])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array(texts, pa.binary()), fim], ["row", "text", "fim"])

    return run


def draws(seed: int, ident: Column) -> Column:
    """Four whole numbers under 2**32 from the hex SHA-256 of seed and id."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.struct(*[F.conv(F.substring(code, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)])


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", name: str = "fim", seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS, bound: int = BOUND) -> DataFrame:
    """``docs`` with texts rearranged, and ``name``: a struct of n (units), form, prefix_chars and middle_chars (code points; null if plain).

    ``rate``: of a hundred documents so many are rearranged; ``spm``: of these so many suffix first.
    """
    if not all(len(s.encode()) > 1 for s in sentinels) or any(s[0] in t[1:] for s in sentinels for t in sentinels):
        raise ValueError("sentinels have two bytes at least, and what one begins with is nowhere else in one, so that outputs can be taken apart")
    long_rows(docs.sparkSession)
    rows = held(docs, (text_col, name), text=quoted(text_col), draw=draws(seed, quoted(id_col)))
    schema = StructType().add("row", rows.schema["row"].dataType).add("text", "binary").add("fim", StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long"))
    done = rows.mapInArrow(_cut(tuple(sentinels), rate, spm, bound), schema)
    return released(done, docs.columns, **{text_col: F.col("text").cast("string"), name: F.col("fim")})


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of."""
    parts = F.array(F.split(output, "|".join(re.escape(s) for s in sentinels), -1))
    whole = lambda *k: F.transform(parts, lambda p: F.concat(*[p[i] for i in k]))[0]
    return F.when(form == "psm", whole(1, 3, 2)).when(form == "spm", whole(2, 3, 1)).otherwise(output)
