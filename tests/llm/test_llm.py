"""The training-data operators against plain versions on small tables, and edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from canopy.llm import decontamination, line_dedup, minhash, packing, quality, sharding, suffix_dedup, toxicity, url_filter, warc

EDGE = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, c long, stats string, score double, marks string, lines string, toxicity string, leaks string, judged string, distance string, kept string, base_failed string, row string, `a.b` string, __key string, id string, clean string"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, repeated ids, copies, clashing names."""
    long = "\n".join(prose(i, 40) for i in range(900))
    base = prose(1, 90)
    rows = [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (None, base), (None, None), (6, long), (7, long + "\ntail"), (8, "a" * 5000), (9, "one"), (10, "one"), (9, "two"), (11, base.replace("w1 ", "w2 ", 1)), (12, "line one here\nline two here\nline three here\n" + prose(2, 30)), (13, prose(3, 30) + "\nline one here\nline two here\nline three here\n"), (14, "É ü 漢字 " * 30)]
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", *[f"x{k}" if c == "lines" else None for c in StructType.fromDDL(EDGE).names[4:]]) for k, (i, t) in enumerate(rows)], EDGE).coalesce(2)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EDGE)


def as_key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0)


def corpus(spark, n=60, seed=5):
    """Documents with copies, near copies and shared passages."""
    r = random.Random(seed)
    texts = []
    passage = prose(77, 90)
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.15:
            t = r.choice(texts)
        elif texts and kind < 0.4:
            w = r.choice(texts).split(" ")
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            t = " ".join(w)
        elif kind < 0.55:
            t = prose(seed * 1000 + i, r.randint(1, 60)) + "\n" + passage + "\n" + prose(seed * 2000 + i, r.randint(1, 60))
        else:
            t = prose(seed * 3000 + i, r.randint(1, 200))
        texts.append(t)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), texts


# ---- op 1 ----------------------------------------------------------------------------


def plain_removed(texts, k=400):
    seen = collections.Counter(b[p : p + k] for b in texts for p in range(len(b) - k + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - k + 1):
            if seen[b[p : p + k]] > 1:
                gone[p : p + k] = b"\1" * k
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [50_000, 2])
def test_suffix_dedup(spark, limit):
    docs, texts = corpus(spark, 40)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(docs, limit=limit).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removed([t.encode() for t in texts])


def test_suffix_dedup_edges(edge, empty):
    rows = suffix_dedup.suffix_dedup(edge).collect()
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in edge.collect()]
    long = [t for _, t in texts if len(t) > 100_000]
    small = [(i, t) for i, t in texts if len(t) <= 100_000]
    want = collections.Counter((i, *x) for (i, _), x in zip(small, plain_removed([t for _, t in small])))
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows if r["n_bytes"] <= 100_000)
    assert got == want and len(long) == 2
    assert all(r["n_removed"] >= len(long[0]) for r in rows if r["n_bytes"] > 100_000)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_dedup_anchor_of_short_and_long_texts(spark):
    """Two grams of one passage whose hashes differ in their last 18 bits only: a text's length must not decide between them."""
    left, right = "vabqhykdjmpegvlvajhwiyocaaxpgcwy", "pgxrhwkrxhlqjofqvszrmyzgnimataiy"
    r = random.Random(0)
    filler = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=k)) for k in (112, 112, 112)]
    passage = filler[0] + left + filler[1] + right + filler[2]
    assert len(passage) == suffix_dedup.LENGTH
    texts = [passage, "".join(r.choices("abcdefgh", k=140_000)) + " " + passage]
    rows = suffix_dedup.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert [got[i] for i in range(2)] == plain_removed([t.encode() for t in texts])
    assert got[0][1] == got[1][1] == suffix_dedup.LENGTH


# ---- op 2 ----------------------------------------------------------------------------


def item_words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def plain_score(doc, item):
    """Smith-Waterman, cell by cell."""
    row, best = [0] * (len(doc) + 1), 0
    for w in item:
        new = [0]
        for j, d in enumerate(doc, 1):
            new.append(max(0, row[j - 1] + (2 if d == w else -1), row[j] - 1, new[-1] - 1))
        row, best = new, max(best, *new)
    return best


def plain_leaks(docs, items):
    """Every document against every item."""
    out = collections.Counter()
    for d, text in {(d, t) for d, t in docs}:
        words = item_words(text)
        for i, t in items:
            item = item_words(t)
            score = plain_score(words, item) if item and len(set(words) & set(item)) * 2 >= min(2, len(set(item))) else 0
            if item and score >= (1.0 if len(item) < 3 else decontamination.SIMILARITY) * 2 * len(item) - 1e-9:
                out[d, i, score] += 1
    return out


def edited(words, r, share):
    """Words replaced, dropped, inserted and swapped with a neighbour."""
    out = []
    for w in words:
        kind = r.random()
        if kind < share / 4:
            out.append(r.choice(WORDS))
        elif kind < share / 2:
            continue
        elif kind < 0.75 * share:
            out += [w, r.choice(WORDS)]
        elif kind < share and out:
            out.insert(len(out) - 1, w)
        else:
            out.append(w)
    return out


def test_decontamination_against_all_pairs(spark):
    """Copies, edited copies, insertions, short and long items, repeated words and items, seeds that are everywhere."""
    r = random.Random(8)
    items = [(k, prose(900 + k, r.choice([1, 2, 3, 4, 5, 8, 10, 11, 12, 20, 35, 60]))) for k in range(40)]
    items += [(40, "no no no " + prose(70, 27)), (41, prose(71, 400)), (42, "w1 " * 30), (43, items[9][1]), (44, ""), (45, None), (46, "w1 w2 w1 w2 w1 w2 w3"), (47, prose(72, 30)), (47, prose(73, 25))]
    docs = []
    for i in range(160):
        own = item_words(r.choice(items)[1])
        body = prose(i, r.randint(0, 120)).split(" ")
        share = r.choice([0, 0.1, 0.2, 0.3, 0.4, 0.5])
        docs.append((i, " ".join(body + edited(own, r, share) + prose(5000 + i, r.randint(0, 60)).split(" "))))
    every_second = " ".join(w if k % 2 else f"{w} extra{k}" for k, w in enumerate(items[47][1].split(" ")))
    docs += [(200, "no " * 200 + prose(90, 300) + " " + items[40][1].upper().replace("W", "w")), (201, every_second), (202, "w1 " * 700), (203, None), (204, ""), (205, prose(6, 2000) + " " + " ".join(edited(item_words(items[41][1]), r, 0.2)) + " " + prose(7, 50))]
    docs += [(300 + i, "w1 w2 w3 " + prose(8000 + i, 20) + " w1 w2 w1 w2") for i in range(60)] + [docs[3], docs[3]]
    want = plain_leaks(docs, items)
    got = collections.Counter((g["doc_id"], g["item_id"], g["score"]) for g in decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == want
    assert {(200, 40), (201, 47), (202, 42), (205, 41)} <= {k[:2] for k in want} and len(want) > 120


def test_decontamination_edges(spark, edge, empty):
    items = [(k, prose(900 + k, 12 + 5 * k)) for k in range(6)] + [(6, "two words"), (7, ""), (8, None), (8, prose(900, 12))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit("x"))
    docs = edge.union(spark.createDataFrame([(70, "a " + items[3][1], *[None] * (len(edge.columns) - 2)), (71, "Two, words", *[None] * (len(edge.columns) - 2))], edge.schema))
    assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()) == [(70, 3), (71, 6)]
    left = decontamination.without_leaks(docs, bench)
    assert left.columns == docs.columns
    assert sorted(map(str, left.collect())) == sorted(map(str, edge.collect()))
    assert decontamination.leaks(empty, bench).count() == 0 and decontamination.without_leaks(empty, bench).count() == 0
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0 and decontamination.without_leaks(docs, bench.limit(0)).count() == docs.count()


def test_alignment():
    import numpy as np

    r = random.Random(3)
    for _ in range(60):
        doc, item = ([r.randrange(5) for _ in range(n)] for n in (r.randint(1, 40), r.randint(1, 15)))
        score, lo, hi = decontamination.align(np.array(doc, np.uint64), np.array(item, np.uint64))
        assert score == plain_score(doc, item) == plain_score(doc[lo:hi], item)
    pairs = [([r.randrange(2, 7) for _ in range(r.randint(1, 40))], [r.randrange(2, 7) for _ in range(r.randint(1, 15))]) for _ in range(50)]
    together = decontamination.best_scores([np.array(d, np.uint64) for d, _ in pairs], [np.array(i, np.uint64) for _, i in pairs])
    assert together.tolist() == [plain_score(d, i) for d, i in pairs]


def test_every_copy_of_a_common_item_is_found(spark):
    item = prose(31, 30)
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    df = spark.createDataFrame([(i, prose(i, 20) + " " + item) for i in range(200)] + [(i, prose(i, 50)) for i in range(200, 300)], "doc_id long, text string")
    assert {r["doc_id"] for r in decontamination.leaks(df, bench).collect()} == set(range(200))


# ---- op 3 ----------------------------------------------------------------------------


def test_plan_is_exact_and_tight():
    import numpy as np

    r = random.Random(3)
    for trial in range(25):
        cap = r.choice([7, 40, 100])
        counts = collections.Counter(r.randint(1, cap) for _ in range(r.randint(0, 300)))
        made = packing.plan(dict(counts), cap)
        fill = collections.defaultdict(list)
        for x, n in counts.items():
            s, o = made.place(np.full(n, x), np.arange(n))
            for a, b in zip(s.tolist(), o.tolist()):
                fill[a].append((b, x))
        for parts in fill.values():
            at = 0
            for o, x in sorted(parts):
                assert o == at
                at += x
            assert at <= cap
        rooms, bins = [], 0
        for x in sorted(counts.elements(), reverse=True):
            fits = [v for v in rooms if v >= x]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - x)
            else:
                bins += 1
                rooms.append(cap - x)
        assert len(fill) == made.sequences <= bins + 1


def test_pack_documents(spark, edge, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary()[0])
    special = spark.createDataFrame([(100, "a <|endoftext|> b")], "doc_id long, text string")
    docs = edge.select("doc_id", "text").union(special)
    rows = packing.pack_documents(docs).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        k = -(-len(ids) // 2048)
        cut = [0] + [len(ids) - (k - 1 - i) * 2048 for i in range(k)]
        for i in range(k):
            part = ids[cut[i] : cut[i + 1]]
            want[r["doc_id"], i, cut[i], len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(empty).count() == 0


# ---- op 4 ----------------------------------------------------------------------------


def plain_components(rows, similarity=85):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= similarity * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return collections.Counter((d, len(s), low.get(root(i)), d == low.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def test_minhash_components(spark, edge, empty):
    docs, texts = corpus(spark, 120, seed=9)
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert got == plain_components(list(enumerate(texts)))
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(edge).collect())
    assert got == plain_components(rows)
    assert minhash.near_duplicates(empty).count() == 0


@pytest.fixture
def counted(monkeypatch):
    """Rows of the tables that near-duplicate search writes for hot bands, by name."""
    rows = collections.Counter()

    def write(df, name, *a, f=minhash.written):
        out = f(df, name, *a)
        if name in ("hot-shingles", "prefix-members", "common-among", "common-across", "marked"):
            rows[name] += out.count()
        return out

    monkeypatch.setattr(minhash, "written", write)
    return rows


@pytest.mark.parametrize("common", [2_048, 12])
def test_hot_bands_bring_together_only_what_shares_a_prefix(spark, monkeypatch, counted, common):
    """Texts that share four fifths of their words meet in bands; with none alike, no shingle of a prefix is shared, and what is alike is found."""
    monkeypatch.setattr(minhash, "HOT", 16)
    monkeypatch.setattr(minhash, "COMMON", common)
    base = prose(5, 240)
    texts = [base + " " + prose(50_000 + i, 60) for i in range(400)]
    texts += [texts[k].rsplit(" ", 2)[0] + " x y" for k in range(0, 400, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert got == plain_components(list(enumerate(texts)))
    assert counted["prefix-members"] < 20 * len(texts) and counted["hot-shingles"] > 0


def test_template_pages_do_not_meet_in_pairs(spark, monkeypatch, counted):
    """A template with a tenth of own words: prefixes reach into the template, and still rows grow with pages, not with pairs."""
    monkeypatch.setattr(minhash, "HOT", 100)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "COMMON", 64)
    base = prose(6, 400)
    sent = []
    for n in (150, 600):
        counted.clear()
        texts = [base + " " + prose(70_000 + i, 44) for i in range(n)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
        assert got == {(i, i) for i in range(n)}
        assert counted["hot-shingles"] > 0
        sent.append(counted["prefix-members"] + counted["common-among"] + counted["common-across"] + counted["marked"])
    assert sent[1] < 20 * 600 and sent[1] <= 6 * max(sent[0], 150)


def test_short_texts_of_a_template_are_not_marked(spark, counted):
    """Short texts of one template share bands, and registers alone tell that they are not alike; those that are alike are found."""
    base = prose(7, 200)
    texts = [base + " " + prose(80_000 + i, 60) for i in range(600)]
    texts += [texts[k].rsplit(" ", 2)[0] + " x y" for k in range(0, 600, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(i, i if i < 600 else 40 * (i - 600)) for i in range(615)}
    assert counted["marked"] < len(texts)


def test_registers_rule_out_no_similar_pair():
    """Pairs at and around the wanted similarity, of all sizes: each that is similar on full sets stays."""
    r, kept, lost = np.random.default_rng(8), 0, 0
    for _ in range(3_000):
        n = int(r.integers(1, 500))
        extra = int(r.integers(0, n // 5 + 2))
        grams = r.integers(0, 1 << 64, n + extra, dtype=np.uint64)
        both = int(r.integers(0, 2)) * int(r.integers(0, extra + 1))
        x, y = grams[: n + both], np.concatenate([grams[extra:n], grams[n:]])
        own = np.repeat([0, 1], [len(x), len(y)])
        sketch = minhash.registers(own, np.concatenate([np.sort(x), np.sort(y)]), 2)
        one, two, zero = np.array([0, 1]), np.array([len(x), len(y)]), np.zeros(2, np.int64)
        p, _ = minhash._likely(zero, zero, zero, np.ones(2, bool), one, one, two, sketch, 85, False)
        shared = len(np.intersect1d(x, y))
        if shared and 100 * shared >= 85 * (len(x) + len(y) - shared):
            kept += 1
            assert len(p) == 1
        else:
            lost += len(p) == 0
    assert kept > 300 and lost > 300


@pytest.mark.parametrize("seed", [1, 2])
def test_templates_with_variants_against_plain(spark, monkeypatch, seed):
    """Several templates with edits, own words of all lengths and copies: every link is found though bands are hot."""
    for name, value in (("HOT", 8), ("BLOCK", 4), ("COMMON", 6 * seed)):
        monkeypatch.setattr(minhash, name, value)
    r = random.Random(seed)
    bases = [prose(80 + seed, 90).split(" ")]
    for _ in range(4):
        other = list(bases[0])
        for _ in range(r.randint(1, 3)):
            other[r.randrange(len(other))] = r.choice(WORDS)
        bases.append(other)
    texts = []
    for k in range(170):
        w = list(r.choice(bases))
        if r.random() < 0.3:
            w[r.randrange(len(w))] = r.choice(WORDS)
        own = prose(90_000 + (k if r.random() < 0.8 else k // 4), r.choice([0, 1, 4, 7, 8, 9, 10, 12, 16])).split(" ")
        texts.append(" ".join(w + own if r.random() < 0.7 else own + w).strip())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.Counter((x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(docs).collect())
    assert got == plain_components(list(enumerate(texts)))


@pytest.mark.parametrize("hot", [16_384, 12])
def test_minhash_blocks(spark, monkeypatch, hot):
    """A large family of near copies over many small blocks, and by prefixes."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "HOT", hot)
    r = random.Random(2)
    base = prose(5, 120).split(" ")
    texts = []
    for _ in range(90):
        w = list(r.choice(texts).split(" ")) if texts and r.random() < 0.6 else list(base)
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert got == plain_components(list(enumerate(texts)))


def test_minhash_chains_of_short_texts(spark):
    """Chains in which only neighbours are similar: sketches of few shingles say little about a pair."""
    r = random.Random(4)
    texts = []
    for k in range(260):
        m = r.choice([6, 13, 14, 17, 20, 26, 37, 56])  # shingles
        step = max(s for s in range(9) if 100 * (m - s) >= 85 * (m + s))
        words = prose(40_000 + k, m + 4 + 4 * max(step, 1)).split(" ")
        if step:
            texts += [" ".join(words[i * step : i * step + m + 4]) for i in range(5)]
        else:
            texts += [" ".join(words[: m + 4]), " ".join(words[: m + 5]), " ".join(words[: m + 6])]
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert got == plain_components(list(enumerate(texts)))


def test_keep_one(edge, empty):
    kept = minhash.keep_one(edge)
    assert kept.columns == edge.columns
    rows = kept.collect()
    filled = [r for r in rows if (r["text"] or "").split()]
    assert len([r for r in filled if (r["text"] or "").startswith(prose(1, 90)[:20])]) == 1
    assert len(rows) - len(filled) == len([r for r in edge.collect() if not (r["text"] or "").split()])
    assert minhash.keep_one(empty).count() == 0


def test_estimate_is_unbiased():
    import numpy as np

    x = np.arange(1, 4001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = minhash.mix(x[:3000]), minhash.mix(x[1000:])
    ra, rb = (minhash.registers(np.zeros(len(v), np.int64), np.sort(v), 1) for v in (a, b))
    assert abs(minhash.estimate((ra == rb).sum(1))[0] - 0.5) < 0.12


# ---- op 5 ----------------------------------------------------------------------------


def test_toxicity(spark, edge, empty):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(1600):
        t = prose(i, r.randint(20, 300)).replace(" w7 ", ". ")
        bad = i % 5 == 0
        if bad:
            w = t.split(" ")
            w[len(w) // 2] = "vile scum."
            t = " ".join(w)
        rows.append((i, t))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame([x for x in labels if x[0] < 1500] + [(None, 1), (5, None), (3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marked)
    got = toxicity.toxicity(docs, model).filter("doc_id >= 1500").collect()
    assert sum((g["toxicity"]["score"] >= 0.3) == (g["doc_id"] % 5 == 0) for g in got) >= 98
    for g in got:
        t = g["toxicity"]
        assert 0 <= t["score"] <= 1
        if g["doc_id"] % 5 == 0:
            assert "scum" in g["text"].encode()[t["worst_start"] : t["worst_start"] + t["worst_bytes"]].decode()
    scored = toxicity.toxicity(edge, model)
    assert sorted(scored.columns) == sorted(edge.columns) and scored.count() == edge.count()
    assert toxicity.below(edge, model).columns == edge.columns
    assert all(r["toxicity"]["score"] == 0 and r["toxicity"]["worst_start"] is None for r in scored.collect() if not (r["text"] or "").strip())
    assert toxicity.toxicity(empty, model).count() == 0
    assert toxicity.toxicity(docs, toxicity.fit(docs, marked.limit(0))).agg(F.max("toxicity.score")).first()[0] < 1e-9


# ---- op 6 ----------------------------------------------------------------------------


def test_url_filter(spark):
    rules = [url_filter.Rule("net/", "block"), url_filter.Rule("example.net/en/", "allow"), url_filter.Rule("org/fr", "block")]
    cases = [
        ("http://a.example.net/en/x", "example.net/en/", "allow"), ("http://A.Example.NET/de", "net/", "block"), ("http://example.net", None, "allow"),
        ("http://notexample.net/en/", "net/", "block"), ("http://x.org/french", "org/fr", "block"), ("http://xorg/fr", None, "allow"), ("", None, "allow"), (None, None, "allow"),
        ("nothing", None, "allow"), ("https://free-bets.example.com/en/1#top", None, "block"), ("https://alphabets.example.com/", None, "allow"), ("http://net/?a://b", "net/", "block"),
        ("http://h.net/EN/", "net/", "block"), ("x://example.net/en/?q", "example.net/en/", "allow"),
    ]
    pages = spark.createDataFrame([(k, u, "x") for k, (u, _, _) in enumerate(cases)], "page_id long, url string, host string")
    for df in (pages, pages.union(pages)):
        for r in url_filter.judge_urls(df, rules).collect():
            assert (r["judged"]["rule"], r["judged"]["verdict"]) == cases[r["page_id"]][1:]
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_only_candidates_run(spark):
    rules = [url_filter.Rule(f"site{i}.com/", "block") for i in range(500)]
    pages = spark.createDataFrame([(0, "http://site3.com/")], "page_id long, url string")
    got = url_filter.judge_urls(pages, rules, ()).first()["judged"]
    assert got["rule"] == "site3.com/" and got["n_regex"] == 1
    assert url_filter.Rule("*ads*", "block", "pattern").tokens() == [] and url_filter.Rule("^ads^x", "block", "pattern").tokens() == ["ads"]


def test_thousands_of_mixed_rules(spark):
    """Host rules and patterns with literals, stars and separators, from a table: the same verdicts as by running every rule, from a few expressions a URL."""
    r = random.Random(6)
    words = [f"t{i}" for i in range(900)] + ["ads", "cdn", "shop", "news", "img"]
    pick = lambda: r.choice(words)
    rules = [(f"{pick()}.{pick()}.com/" + r.choice(["", f"{pick()}/", pick()]), r.choice(["block", "allow"]), "host") for _ in range(2500)]
    rules += [(r.choice([f"^{pick()}^{pick()}^", f"^{pick()}.*/{pick()}", f"/{pick()}/*.{pick()}^", f"*-{pick()}-*", f"^{pick()}^*^{pick()}^"]), r.choice(["block", "allow"]), "pattern") for _ in range(2500)]
    rules += [("*zz*", "block", "pattern"), (rules[0][0], rules[0][1], "host"), (None, "block", "host")]
    table = spark.createDataFrame(rules, "text string, verdict string, kind string")
    urls = [f"http://{r.choice(['', 'www.', pick() + '.'])}{r.choice(rules[:2500])[0].rstrip('/')}/{pick()}/{pick()}.{pick()}" for _ in range(300)] + [f"https://{pick()}.{pick()}.COM/{pick()}-{pick()}-x/{pick()}.{pick()}?q" for _ in range(300)] + ["http://zz", None, ""]
    found = url_filter.read_rules(table)
    assert len(found) == len(set(x for x in rules if x[0])) and found == sorted(found, key=lambda x: (x.kind, x.text, x.verdict))
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), found, ()).collect()
    compiled = [(x, re.compile(x.regex())) for x in found]
    for g in got:
        address = g["judged"]["host"] + g["judged"]["path"]
        hosts = [x for x, c in compiled if x.kind == "host" and c.match(address)]
        patterns = [x for x, c in compiled if x.kind == "pattern" and c.match(address.lower())]
        best = min(hosts, key=lambda x: (-len(x.text), x.text), default=None)
        assert (g["judged"]["rule"], g["judged"]["pattern"]) == (best and best.text, patterns[0].text if patterns else None)
        assert g["judged"]["verdict"] == (best or (patterns[0] if patterns else url_filter.Rule("", "allow"))).verdict
    assert sum(g["judged"]["n_regex"] for g in got) / len(got) < 40 and sum(g["judged"]["rule"] is not None for g in got) > 200 and sum(g["judged"]["pattern"] is not None for g in got) > 50


# ---- op 7 ----------------------------------------------------------------------------


def plain_statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = list(zip(w, w[1:], w[2:]))
    n = collections.Counter(grams)
    covered = {k + d for k, g in enumerate(grams) if n[g] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def test_quality(spark, edge, empty):
    got = quality.statistics(edge).collect()
    assert all(tuple(r["stats"]) == plain_statistics(r["text"]) for r in got)
    rows = [(i, prose(i, 80 + i % 60), "en" if i % 4 else None, "a") for i in range(300)] + [(1000 + i, " ".join(f"{w}###" for w in prose(i, 90).split()), "en", "a") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stats = quality.statistics(docs).drop("text").cache()
    keys = ["lang", "source"]
    for r in quality.judge(stats, quality.fit(stats, keys), keys).collect():
        assert r["kept"] == (r["doc_id"] < 1000)
    for df in (edge, empty):
        s = quality.statistics(df)
        judged = quality.judge(s, quality.fit(s, keys), keys)
        assert judged.count() == df.count()
        assert all(r["base_failed"] and not r["kept"] for r in judged.filter("text is null or trim(text) = ''").collect())


def test_quality_rejects_repeated_lines(spark):
    """A third to nearly half of the lines repeated, or many two-word lines (no repeated 3-word window); single repeats stay."""
    rows = [(i, "\n".join(prose(60_000 + i * 50 + k, 8) for k in range(10 + i % 20)), "en", "a") for i in range(300)]
    for i in range(30):
        lines = [prose(90_000 + i * 50 + k, 8) for k in range(12 + i)]
        share = (0.3, 0.38, 0.45)[i % 3]
        for k in range(int(share * len(lines) / (1 - share)) + (i % 3 == 0)):
            lines.insert(2 + 2 * k, lines[0])
        rows.append((1000 + i, "\n".join(lines), "en", "a"))
        short = [x for k in range(12 + i) for x in (prose(95_000 + i * 50 + k, 6), "read more")]
        rows.append((1100 + i, "\n".join(short), "en", "a"))
        single = [prose(97_000 + i * 50 + k, 8) for k in range(12 + i)]
        rows.append((500 + i, "\n".join([*single, single[3]]), "en", "a"))
    stats = quality.statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).drop("text").cache()
    keys = ["lang", "source"]
    for r in quality.judge(stats, quality.fit(stats, keys), keys).collect():
        assert not r["base_failed"] and r["kept"] == (r["doc_id"] < 1000), r


def plain_mcd(x, r, starts=60):
    """Smallest determinant over many random starts, with exact subsets."""
    import numpy as np

    floor, h, best = np.diag(np.square(quality.FLOOR)), int(np.ceil(quality.SUBSET * len(x))), None
    for _ in range(starts):
        own = x[r.choice(len(x), 8, replace=False)]
        for _ in range(50):
            mean, scatter = own.mean(0), np.cov(own.T, bias=True) + floor
            away = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(scatter), x - mean)
            own = x[np.argsort(away, kind="stable")[:h]]
        det = np.linalg.slogdet(np.cov(own.T, bias=True) + floor)[1]
        if best is None or det < best[0]:
            best = det, own.mean(0), np.cov(own.T, bias=True) + floor
    return best


def test_quality_against_plain_mcd(spark):
    """Two groups with a quarter of odd documents in a clump: the determinant is as small as by many exact starts, and the same documents go."""
    import numpy as np

    r = np.random.default_rng(4)
    rows = []
    for i in range(1200):
        n = int(r.integers(60, 400))
        odd = i % 4 == 0
        rows.append((i, "a" if i % 3 else "b", (n, int(n * (r.normal(5.0, 0.25) + odd * 1.4)), int(n * (0.01 * r.random() + odd * 0.3)), int(n * 0.04 * odd), int(0.1 * n * r.random() * (r.random() < 0.2)))))
    stats = spark.createDataFrame(rows, "doc_id long, lang string, stats struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint>").cache()
    made = quality.fit(stats, ["lang"])
    found = {k["g"]: k for k in made.collect()}
    judged = quality.judge(stats, made, ["lang"]).withColumn("x", F.array(*quality.features())).withColumn("g", F.xxhash64(F.coalesce("lang", F.lit("\0")))).collect()
    assert len(found) == 2
    for g, e in found.items():
        own = [k for k in judged if k["g"] == g]
        x = np.array([k["x"] for k in own])
        det, mean, scatter = plain_mcd(x, r)
        assert e["det"] <= det + 0.05
        away = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(scatter), x - mean)
        cut = quality.CHI2_CUT * max(1.0, np.median(away) / quality.CHI2_MEDIAN)
        clear = np.abs(np.log(away / cut)) > 0.1
        assert [bool(k["kept"]) for k, c in zip(own, clear) if c] == (away[clear] <= cut).tolist()
        assert all(k["kept"] == (k["doc_id"] % 4 > 0) for k in own)


# ---- op 8 ----------------------------------------------------------------------------


def test_sharding(spark, edge, empty):
    docs, texts = corpus(spark, 203)
    copies = docs.union(spark.createDataFrame([(1000 + i, "same text") for i in range(150)], "doc_id long, text string"))
    for df, n in ((copies, 353), (edge.select("doc_id", "text"), edge.count())):
        rows = sharding.shard_rows(df).collect()
        by = collections.defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r["slot"])
        assert len(rows) == n and set(by) <= set(range(8))
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        sizes = [len(by.get(k, [])) for k in range(8)]
        assert max(sizes) - min(sizes) <= 1
    want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in edge.collect())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    groups = collections.defaultdict(set)
    for r in sharding.shard_rows(docs).collect():
        groups[texts[r["doc_id"]]].add(r["shard"])
    assert sum(len(v) > 1 for v in groups.values()) <= 7
    assert sharding.shard_rows(empty).count() == 0


def test_propagation_cuts_fewer_edges_and_keeps_sizes(spark):
    """Two hundred groups of copies: nearly none stays cut (dealt by hash, nearly all are), while no shard's share drifts far during the rounds."""
    r = random.Random(7)
    rows = [(i, f"text {i}" if i < 2000 else f"copy {r.randrange(200)}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by_text = collections.defaultdict(collections.Counter)
    for g in sharding.shard_rows(docs).collect():
        by_text[rows[g["doc_id"]][1]][g["shard"]] += 1
    pairs = lambda groups: sum(sum(c.values()) ** 2 - sum(n * n for n in c.values()) for c in groups) / 2
    dealt = collections.defaultdict(collections.Counter)
    for i, t in rows:
        dealt[t][i % 8] += 1
    assert pairs(by_text.values()) < 0.05 * pairs(dealt.values())
    state = docs.groupBy(F.xxhash64("text").alias("group"), F.pmod(F.xxhash64("doc_id"), F.lit(8)).cast("int").alias("first")).agg(F.count("*").alias("n"))
    moved = sharding.propagate(state.withColumn("shard", F.col("first")), 8, 6000)
    sizes = [x["n"] for x in moved.groupBy("shard").agg(F.sum("n").alias("n")).collect()]
    assert sum(sizes) == 6000 and max(sizes) < 1.35 * 750 and min(sizes) > 0.65 * 750


# ---- op 9 ----------------------------------------------------------------------------


def plain_chunks(text):
    """(first line, last line, bytes) of the chunks of a text, from the rule in the module's docstring."""
    lines = text.split("\n")
    full = [k for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
    long = {k for k in full if len(re.findall(r"[^\x20\x09-\x0D]+", lines[k])) >= line_dedup.LONG}
    import numpy as np

    data = np.frombuffer(text.encode(), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(x.encode()) + 1 for x in lines])]).astype(np.int64)
    of = lambda a, b: int(line_dedup.Prefix(data).of(starts[[a]], starts[[b + 1]] - 1)[0])
    rolled = [int(line_dedup.mix(np.array([(of(a, a) * 3 + of(b, b)) % 2**64], np.uint64))[0]) for a, b in zip(full, full[1:])]
    chosen = {0} if len(rolled) == 1 else {k if rolled[k] <= rolled[k + 1] else k + 1 for k in range(len(rolled) - 1)}
    pairs = [(full[k], full[k + 1]) for k in chosen if not {full[k], full[k + 1]} <= long]
    return [(a, b, "\n".join(lines[a : b + 1])) for a, b in [*((k, k) for k in long), *pairs]], full


def plain_line_dedup(docs):
    """Lines of each document that go, by comparing all chunks in order."""
    places = []
    for d, t in docs:
        chunks, full = plain_chunks(t)
        places += [((d, a, b), part, full) for a, b, part in chunks]
    texts = {d: t.split("\n") for d, t in docs}
    first, seen = {}, collections.Counter(part for _, part, _ in places)
    for (d, a, b), part, full in sorted(places, key=lambda x: x[0]):
        first.setdefault(part, (d, a, b, full))
    near = lambda d, full, k, step: texts[d][full[full.index(k) + step]] if 0 <= full.index(k) + step < len(full) else None
    marked = collections.defaultdict(set)
    for (d, a, b), part, full in places:
        if seen[part] > 1 and (d, a, b) != first[part][:3]:
            marked[d] |= set(range(a, b + 1))
    gone = collections.defaultdict(set)
    for (d, a, b), part, full in places:
        if seen[part] < 2 or (d, a, b) == first[part][:3] or (d == first[part][0] and a <= first[part][2]):
            continue
        gone[d] |= set(range(a, b + 1))
        d0, a0, b0, full0 = first[part]
        for k, k0, step in ((a, a0, -1), (b, b0, 1)):
            if (x := near(d, full, k, step)) is not None and x == near(d0, full0, k0, step) and full[full.index(k) + step] not in marked[d]:
                gone[d].add(full[full.index(k) + step])
    for d, t in docs:
        full = plain_chunks(t)[1]
        for a, b in zip(full, full[1:]):
            if {a, b} <= gone[d]:
                gone[d] |= set(range(a, b))
    return gone


def without_lines(text, removed):
    lines = text.split("\n")
    ends = lines[-1:] == [""]
    left = [x for k, x in enumerate(lines[: len(lines) - ends]) if k not in removed]
    return "\n".join(left) + ("\n" if ends and left else "")


def test_line_dedup_against_plain(spark):
    """Shared runs of 2 to 12 lines, long lines, blank lines, repeats within a document, copies: the same lines go as by a plain version."""
    r = random.Random(12)
    shared = ["\n".join(prose(500 * k + j, r.choice([3, 8, 8, 60])) for j in range(2 + k % 11)) for k in range(20)]
    docs = []
    for i in range(150):
        parts = []
        for k in range(r.randint(1, 5)):
            parts.append(r.choice(shared) if r.random() < 0.4 else "\n".join(prose(i * 997 + k * 31 + j, r.choice([1, 7, 55])) for j in range(r.randint(1, 6))))
            if r.random() < 0.3:
                parts.append(r.choice(["", "  ", "w1\nw1\nw1\nw1\nw1"]))
        docs.append((i, "\n".join(parts) + r.choice(["", "\n"])))
    docs += [(200 + k, docs[k][1]) for k in range(5)]
    want = plain_line_dedup(docs)
    got = {g["doc_id"]: g for g in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, t in docs:
        removed = {k for s in got[d]["lines"]["removed"] for k in range(s["first_line"], s["first_line"] + s["lines"])}
        assert removed == want[d], d
        assert got[d]["text"] == without_lines(t, removed)
    assert sum(map(len, want.values())) > 300


def test_every_run_of_three_lines_goes(spark):
    """A passage of three lines or more, or a paragraph of 50 words, stays in the first document only, to its last line."""
    r = random.Random(5)
    docs = []
    for k in range(120):
        passage = [prose(70_000 + 50 * k + j, r.randint(6, 20)) for j in range(3 + k % 8)] if k % 4 else [prose(80_000 + k, 50 + k % 20)]
        for i in range(3):
            docs.append((3 * k + i, passage, [prose(90_000 + 300 * k + 10 * i + j, 8) for j in range(r.randint(1, 4))], [prose(95_000 + 300 * k + 10 * i + j, 8) for j in range(r.randint(1, 4))]))
    table = spark.createDataFrame([(i, "\n".join(a + p + b)) for i, p, a, b in docs], "doc_id long, text string")
    got = {g["doc_id"]: g["text"] for g in line_dedup.dedup_lines(table).collect()}
    for i, p, a, b in docs:
        assert got[i] == "\n".join(a + (p if i % 3 == 0 else []) + b)


def test_line_dedup_edges(spark, edge, empty):
    import numpy as np

    # chunks don't depend on what else is in a block
    parts = [("\n".join(prose(i * 50 + k, 7) for k in range(1 + i))).encode() for i in range(12)]
    whole = line_dedup.chunk_table(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
    alone = [line_dedup.chunk_table(np.frombuffer(p, np.uint8), np.array([0, len(p)])) for p in parts]
    assert whole[3].tolist() == [h for a in alone for h in a[3].tolist()]
    done = line_dedup.dedup_lines(edge)
    assert done.count() == edge.count() and done.columns == edge.columns
    rows = done.collect()
    assert all(r["text"] is None for r in rows if r["lines"]["n_lines"] == 0 and r["text"] != "") and sum(r["text"] is None for r in rows) == 2
    left = line_dedup.remaining(edge, size_col="n_chars")
    assert left.columns == edge.columns and left.filter("lines like 'x%'").count() == left.count() < edge.count()
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.remaining(empty).count() == 0


# ---- op 10 ---------------------------------------------------------------------------


def test_warc(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT", 50_000)
    big, other = "<html>" + "x" * 2000, "y" * 120_001
    rows = [(1, "http://a/\r\nX: y", big), (2, "http://b/é", big), (7, None, big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", "z" * 1500), (8, "u", other), (9, "u", other), (9, "u", other), (10, "u", "é" * 700)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, id string")
    path = str(tmp_path / "warc")
    warc.write_warc(pages, path, file_records=3)
    got = collections.Counter((r["id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], None if r["payload"] is None else bytes(r["payload"])) for r in warc.read_warc(spark, path).collect())
    want = collections.Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        same = [j for j, _, x in rows if x == h and len(p) >= 1000 and j is not None]
        top = max(same, default=i)
        revisit = len(p) >= 1000 and i is not None and i != top
        want[i, "revisit" if revisit else "response", top if revisit else None, len(p), hashlib.sha1(p).hexdigest(), None if revisit else p] += 1
    assert got == want
    import gzip
    from pathlib import Path

    for f in Path(path).glob("part-*"):
        assert gzip.open(f).read().startswith(b"WARC/1.1\r\n")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_keeps_the_records_of_a_payload_in_one_file(spark, tmp_path):
    """Payloads of three records don't part where a file ends (workers don't see patched constants, so they have to be large)."""
    n = 2 * warc.SEGMENT + 10
    pages = spark.range(5).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") == 0, "short").otherwise(F.repeat(F.col("id").cast("string"), n)).alias("html")).coalesce(1)
    path = tmp_path / "records"
    warc.write_warc(pages, str(path), file_records=2)
    got = [(r["id"], r["payload_bytes"], r["digest_ok"]) for r in warc.read_warc(spark, str(path), payload=False).collect()]
    assert sorted(got) == [(i, n if i else 5, True) for i in range(5)]
    assert len(list(path.glob("part-*"))) >= 3


def test_warc_closes_files_by_bytes(spark, tmp_path):
    rows = [(i, "u", random.Random(i).randbytes(60_000).hex()) for i in range(20)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "bytes"), file_bytes=150_000)
    got = {r["id"]: bytes(r["payload"]).decode() for r in warc.read_warc(spark, str(tmp_path / "bytes")).collect()}
    assert got == {i: h for i, _, h in rows}
    assert max(f.stat().st_size for f in (tmp_path / "bytes").glob("part-*")) <= 150_000


def test_warc_reader_rejects_damage():
    def member(block, digest=None, size=None):
        fields = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Payload-Digest", digest or warc._digest(block))]
        return warc._member(fields, warc._HTTP % len(block) + block)

    good = member(b"abc") + member(b"")
    assert [r[8] for r in warc.parse_archive(good)] == [b"abc", b""]
    assert next(iter(warc.parse_archive(member(b"abc", warc._digest(b"abd")))))[7] is False
    with pytest.raises(ValueError, match="ends within"):
        list(warc.parse_archive(good[:-12]))


# ---- pipeline ------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        if name == "near_dedup":
            assert all(k[3] for k in plain_components(rows))
    assert docs.filter("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == before
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_pipeline_against_plain(spark, sf_dir):
    """All stages by plain versions (toxicity scores by the operator's model): the same pieces of the same documents."""
    import corpus_pipeline
    import numpy as np
    from tokenizers import Tokenizer

    from canopy.llm.queries import held_out

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out()))
    rows = [(r["doc_id"], r["text"] or "") for r in toxicity.toxicity(docs, model).collect() if r["toxicity"]["score"] < toxicity.THRESHOLD]
    gone = plain_line_dedup(rows)
    rows = [(d, without_lines(t, gone[d]) if gone[d] else t) for d, t in rows]
    rows = [(d, t) for d, t in rows if not gone[d] or t.split()]
    kept = {k[0] for k in plain_components(rows, 80) if k[3] or not k[1]}
    rows = [(d, t) for d, t in rows if d in kept]
    coded = {}
    code = lambda text: np.array([coded.setdefault(w, len(coded) + 2) for w in item_words(text)], np.uint64)
    items = [code(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    words = [code(t) for _, t in rows]
    leaking = {d for (d, _), w in zip(rows, words) if len(w) and any(s >= 1.2 * len(i) - 1e-9 for s, i in zip(decontamination.best_scores([w] * len(items), items), items))}
    tok = Tokenizer.from_file(packing.default_vocabulary()[0])
    want = collections.Counter()
    for d, t in rows:
        if d not in leaking:
            ids = tok.encode(t, add_special_tokens=False).ids + [0]
            k = -(-len(ids) // 2048)
            cut = [0] + [len(ids) - (k - 1 - i) * 2048 for i in range(k)]
            for i in range(k):
                part = ids[cut[i] : cut[i + 1]]
                want[d, i, cut[i], len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    got = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want and leaking and len(gone) > 10


def test_pipeline_edges(spark, edge, sf_dir):
    import corpus_pipeline

    for table in (edge, edge.limit(0)):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
            assert docs.columns == edge.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()


def test_schema_is_stable(spark, sf_dir):
    from canopy.llm import queries

    want = {
        "op1_suffix_dedup": "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
        "op4_minhash": "doc_id long, n_shingles long, component_id long, kept boolean",
        "op6_url_filter": "page_id long, host string, path string, rule string, verdict string",
        "op10_warc": "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long",
    }
    for name, ddl in want.items():
        got = queries.QUERIES[name](spark, sf_dir)
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in StructType.fromDDL(ddl)]


def test_steps_of_a_job_do_not_pile_up(spark):
    """Only the last result of a job stays; what was written before it began isn't touched."""
    from pathlib import Path

    from canopy.llm import stage

    before = stage.written(spark.range(3), "before")
    start = stage.mark()
    a = stage.written(stage.written(spark.range(5), "own").filter("id > 1"), "first")
    stage.clean(spark, start, last=False)
    stage.bucketed(a, "id", "own_table", spark)
    b = stage.written(stage.written(a, "own").filter("id > 2"), "second")
    stage.clean(spark, start, last=False)
    assert b.count() == 2 and before.count() == 3
    left = {p.name.rsplit("-", 1)[0] for p in Path(stage.shared_dir(spark)).iterdir()}
    assert "second" in left and not left & {"own", "first"} and not any(n.startswith("own_table") for n in left)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("own_table")]


def test_site_rules(spark):
    urls = spark.createDataFrame([(f"http://x.s{k}.example.com/en/{j}",) for k in range(40) for j in range(k % 3 + 1)] + [("nothing",), (None,), ("http://é.example.com/",)], "url string")
    rules = url_filter.read_rules(url_filter.site_rules(urls))
    assert {r.kind for r in rules} == {"pattern"} and 10 < len(rules) < 30 and len({r.text.replace(re.search(r"s\d+", r.text)[0], "") for r in rules}) == 4
    assert all(r.tokens() for r in rules)
    few = url_filter.read_rules(url_filter.site_rules(urls, most=5))
    assert len(few) <= 5 and set(few) <= set(rules)
    assert url_filter.site_rules(urls.limit(0)).count() == 0


def test_long_lines_are_chunks_by_parameter(spark):
    """A long line that repeats goes, or stays where no line is long enough to be a chunk of its own."""
    line = prose(8, 60)
    docs = spark.createDataFrame([(k, prose(100 + k, 8) + "\n" + line + "\n" + prose(200 + k, 8)) for k in range(3)], "doc_id long, text string")
    kept = lambda **more: [line in r["text"] for r in line_dedup.dedup_lines(docs, **more).orderBy("doc_id").collect()]
    assert kept() == [True, False, False] and kept(long_words=61) == [True, True, True]
