"""Fill in the middle, conversation tries and context trees against plain versions, and edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import WORDS, edge, empty, prose  # noqa: F401  (fixtures)

from canopy.llm import context_tree, fill_middle, prefix_trie, queries
from canopy.llm.fill_middle import RankIndex

# ---- op 11 ---------------------------------------------------------------------------


@pytest.mark.parametrize("bound", [1, 7, 96])
def test_rank_index_gives_back_every_place(bound):
    r = random.Random(bound)
    rows = [[], [5], list(range(1000)), list(range(0, 90_000, 90)), sorted(r.sample(range(10**6), 3000)), [*range(50), 10**9, *range(10**9 + 1, 10**9 + 60)]]
    for row in rows:
        places = np.array(row, np.int64)
        index = RankIndex(places, bound)
        assert index.places(np.arange(len(places))).tolist() == row
        assert index.off.itemsize == 1
    assert len(RankIndex(np.arange(0, 90_000, 90), bound).first) == 1


def plain_middle(i, text, seed=7, rate=100, spm=50):
    t = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    s = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(s[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(u)
    p, q = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, m, z = "".join(u[:p]), "".join(u[p:q]), "".join(u[q:])
    if not t or any(x in t for x in fill_middle.SENTINELS) or h[2] % 100 >= rate:
        return n, "plain", None, None, t
    if h[3] % 100 < spm:
        return n, "spm", len(a), len(m), f"<S>{z}<P>{a}<M>{m}"
    return n, "psm", len(a), len(m), f"<P>{a}<S>{z}<M>{m}"


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 10)])
def test_fill_in_middle_against_plain(spark, rate, spm):
    r = random.Random(rate)
    texts = ["\n".join(r.choice(["", "a", "é漢字 x", prose(k, 9), "<", "<S", "S>", "\r"]) for k in range(r.randint(0, 30))) + r.choice(["", "\n", "\n\n"]) for _ in range(300)]
    texts += ["one <M> two\nthree", "<P>", "\n", "no end", None, ""]
    docs = spark.createDataFrame([*enumerate(texts), (None, "a\nb\nc"), (3, texts[3])], "doc_id long, text string").repartition(3)
    got = fill_middle.fill_in_middle(docs, rate=rate, spm=spm)
    got = got.withColumn("back", fill_middle.restored(F.col("text"), F.col("fim.form"))).collect()
    of = {(i, t or "") for i, t in enumerate(texts)}
    assert len(got) == len(texts) + 2
    for x in got:
        if x["doc_id"] is not None:
            assert (x["doc_id"], x["back"]) in of
        assert (*x["fim"], x["text"]) == plain_middle(x["doc_id"], x["back"], rate=rate, spm=spm)
    assert {"plain", "psm", "spm"} == {x["fim"]["form"] for x in got}


def test_fill_in_middle_edges(edge, empty):  # noqa: F811
    rows = edge.collect()
    got = fill_middle.fill_in_middle(edge)
    assert got.columns == [*edge.columns, "fim"] and fill_middle.fill_in_middle(edge, name="key").columns == edge.columns
    want = sorted(repr((r["doc_id"], plain_middle(r["doc_id"], r["text"]), r["lines"])) for r in rows)
    assert sorted(repr((r["doc_id"], (*r["fim"], r["text"]), r["lines"])) for r in got.collect()) == want
    assert fill_middle.fill_in_middle(empty).count() == 0
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(edge, sentinels=("<P>", "<<S>", "<M>"))


# ---- op 12 ---------------------------------------------------------------------------


def plain_trie(sequences):
    """sequences: conversation -> list of (role, text)."""
    nodes = collections.defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    words = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
    children = collections.Counter(s[:-1] for s in nodes if s)
    leaves, saved = collections.Counter(), collections.Counter()
    for s, members in nodes.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += children[s] == 0
            saved[s[:d]] += (len(members) - 1) * words(s)
    out = []
    for s, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(sequences[c]) == len(s)))
        out.append((min(members), len(s), min(nodes[s[:-1]]) if s else None, len(members), children[s], leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(seed, n=120):
    """Conversations that share beginnings, copies of one another, a long one, turns without a number, nulls."""
    r = random.Random(seed)
    says = [(r.choice(["user", "assistant", None]), r.choice([None, "", "a", "b b", "é c\td"])) for _ in range(6)]
    begin = [r.choice(says) for _ in range(12)]
    rows = []
    for c in range(n):
        own = begin[: r.randint(0, 12)] if c % 3 else []
        own = own + [r.choice(says) for _ in range(r.randint(0, 4))]
        own = own + [r.choice(says) for _ in range(150)] if c == 7 else own
        rows += [(c * 3 - 20, None if not k and c % 2 else k, *say) for k, say in enumerate(own)]
    return rows


def sequences_of(rows):
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(x[2], x[3]) for x in sorted(v, key=lambda x: x[:2])] for c, v in by.items() if c is not None}


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("sequences,turns", [(512, 65_536), (1, 65_536), (3, 40), (0, 0)])
def test_trie_against_plain(spark, sequences, turns):
    rows = talks(sequences)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = prefix_trie.trie(prefix_trie.steps(table), sequences=sequences, turns=turns)
    assert got.columns == TRIE
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(sequences_of(rows))


def test_trie_edges(spark):
    kind = "conv_id long, turn long, role string, text string, c string, d string, k1 long, words string, `a.b` string"
    rows = [(5, 1, "u", "x y"), (5, 1, "u", "x y"), (None, 0, "u", "lost"), (8, None, None, None), (9, 0, "", ""), (-3, 2**40, "u", "w " * 60_000)]
    got = prefix_trie.prefix_trie(spark.createDataFrame([(*r, "1", None, 4, None, "z") for r in rows], kind))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(sequences_of(rows))
    assert prefix_trie.prefix_trie(spark.createDataFrame([], kind)).count() == 0


def test_rebuilt_conversations(spark, tmp_path):
    """The query's rule for first turns: absent bases, bases that are shorter than asked for, conversations that lose all turns."""
    r = random.Random(4)
    rows = [(c, t, r.choice(["u", "a"]), r.choice(["x", "y z", "w"])) for c in range(0, 90) if c != 40 for t in range(r.randint(1, 5))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    own = sequences_of(rows)
    built = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + s[h:]
    assert any(not s for s in built.values())
    got = queries.op12_prefix_trie(spark, str(tmp_path))
    assert sorted(map(tuple, got.select(*TRIE).collect()), key=repr) == plain_trie(built)


# ---- op 13 ---------------------------------------------------------------------------


def plain_scores(texts, train, depth):
    counts, kids = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)

    def bits(t):
        s = [context_tree.START] * depth + list((t or "").encode()) + [context_tree.END]
        for i in range(depth, len(s)):
            context = tuple(s[i - depth : i][::-1])
            for j in range(8):
                yield context, (1 << j) | (s[i] >> (8 - j)), (s[i] >> (7 - j)) & 1

    for t, learnt in zip(texts, train, strict=True):
        for context, heap, bit in bits(t) if learnt else ():
            for k in range(depth + 1):
                counts[context[:k], heap][bit] += 1
                if k < depth:
                    kids[context[:k], heap].add(context[: k + 1])
    known = {}

    def own(node):
        a, b = counts.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(node):
        if node not in known:
            below = sum(weighted((c, node[1])) for c in kids.get(node, ()))
            known[node] = own(node) if len(node[0]) == depth else float(np.logaddexp(own(node), below)) - math.log(2)
        return known[node]

    def chance(context, heap, bit):
        p = None
        for k in range(depth, -1, -1):
            node = context[:k], heap
            n = counts.get(node, (0, 0))
            kt = (n[bit] + 0.5) / (sum(n) + 1)
            if p is None:
                p = kt
                continue
            w = math.exp(own(node) - math.log(2) - weighted(node))
            p = w * kt + (1 - w) * p
        return p

    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    seen = collections.Counter(w for t, learnt in zip(texts, train, strict=True) if learnt for w in words(t))
    total, kinds = sum(seen.values()), len(seen)
    for t in texts:
        w = words(t)
        base = sum(math.log10((seen[x] + 1) / (total + kinds + 1)) for x in w)
        yield len(w), sum(seen[x] > 0 for x in w), total, base, sum(math.log10(chance(*b)) for b in bits(t))


@pytest.mark.parametrize("depth,block,fan", [(2, 300, 2), (3, 1 << 20, 2_048), (5, 700, 3)])
def test_context_tree_against_plain(spark, depth, block, fan, monkeypatch):
    r = random.Random(depth)
    texts = [" ".join(r.choice(WORDS[:30]) for _ in range(r.randint(0, 25))) for _ in range(40)] + [None, "", "É ü 漢字 Aa\nA", "\0\1", "new words here", "w1 " * 200]
    train = [k % 4 != 1 for k in range(len(texts))]
    docs = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(zip(texts, train, strict=True))], "doc_id long, text string, train boolean").repartition(3)
    monkeypatch.setattr(context_tree, "SLICE", 64)
    got = {x["doc_id"]: x["lm"] for x in context_tree.score_texts(docs, F.col("train"), depth=depth, block=block, fan=fan).collect()}
    for k, want in enumerate(plain_scores(texts, train, depth)):
        assert tuple(got[k])[:3] == want[:3]
        assert tuple(got[k])[3:] == pytest.approx(want[3:], rel=1e-9)


def test_context_tree_sums_to_one(spark):
    """All next bytes after a context together have probability one."""
    rows = [(0, "the cat. the dog", True), *((k + 1, "the " + chr(k), False) for k in range(1, 128))]
    lm = {x["doc_id"]: x["lm"]["score"] for x in context_tree.score_texts(spark.createDataFrame(rows, "doc_id long, text string, train boolean"), F.col("train")).collect()}
    assert all(v < 0 for v in lm.values()) and lm[1 + ord("c")] > lm[1 + ord("z")]
    keys = (np.uint64(int.from_bytes(b" eht\xfe", "big")) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    counts = np.zeros(256, np.int64)
    counts[ord("c")], counts[ord("d")] = 3, 1
    trees = context_tree.Contexts(keys, counts, 5)
    assert (10 ** trees.scores(context_tree.upper_levels(trees.gathered()))).sum() == pytest.approx(1)


def test_context_tree_edges(edge, empty):  # noqa: F811
    rows = edge.collect()
    got = context_tree.score_texts(edge, F.col("doc_id") % 2 == 0)
    assert got.columns == [*edge.columns, "lm"] and context_tree.score_texts(edge, F.lit(True), name="key").columns == edge.columns
    out = got.collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1
    assert sorted(repr((r["doc_id"], r["text"], r["lines"], count(r["text"]))) for r in rows) == sorted(repr((r["doc_id"], r["text"], r["lines"], r["lm"]["n_tokens"])) for r in out)
    assert context_tree.score_texts(empty, F.lit(True)).count() == 0
    none = context_tree.score_texts(edge, F.lit(False)).filter("doc_id = 4").first()["lm"]
    assert (none["n_known"], none["train_tokens"], none["base_score"]) == (0, 0, 0.0) and none["score"] == pytest.approx(8 * math.log10(0.5))
