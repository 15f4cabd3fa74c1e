"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import context_tree, decontamination, fill_middle, line_dedup, minhash, packing, prefix_trie, quality, sharding, suffix_dedup
from canopy.llm import toxicity as tox
from canopy.llm import url_filter as urls
from canopy.llm import warc
from canopy.llm.stage import written

URL_RULES = (urls.Rule("net/", "block"), urls.Rule("example.net/en/", "allow"), urls.Rule("example.com/de/", "block"), urls.Rule("org/fr/", "allow"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores for every document; fitted on labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").filter(~held_out())
    scored = tox.toxicity(docs.select("doc_id", "text"), tox.fit(docs, labels))
    score = F.col("toxicity.score")
    return scored.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= tox.THRESHOLD).cast("int").alias("predicted"), F.col("toxicity.worst_start").alias("worst_start"), F.col("toxicity.worst_bytes").alias("worst_bytes"), F.col("toxicity.worst_score").alias("worst_score"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's address."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.judge_urls(pages, URL_RULES, patterns=(*urls.PATTERNS, *urls.read_rules(urls.site_rules(pages))))
    return judged.select("page_id", *(F.col(f"judged.{c}").alias(c) for c in ("host", "path", "rule", "verdict")))


_OP6_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(rule, rhost, rpath, rverdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), fits AS (
  SELECT page_id, host, path, rule, rverdict FROM parts JOIN rules
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
), sites AS (
  SELECT regexp_extract(host, '([^.]+)\.[^.]+\.[^.]+$', 1) AS site, substr(md5(regexp_extract(host, '([^.]+)\.[^.]+\.[^.]+$', 1)), 1, 1) AS kind FROM parts
  GROUP BY ALL HAVING regexp_full_match(site, '[a-z0-9-]+') ORDER BY count(*) DESC, site LIMIT 2000
), best AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(rverdict, length(rule)) AS rverdict FROM fits GROUP BY ALL
)
SELECT p.page_id, p.host, p.path, b.rule,
       coalesce(CASE WHEN b.rule IS NULL AND EXISTS (
         SELECT 1 FROM sites s WHERE s.kind < '8' AND contains(lower(p.host || p.path), s.site) AND regexp_matches(lower(p.host || p.path), '(?s)(^|[^a-z0-9])' || s.site ||
           CASE WHEN s.kind < '3' THEN '([^a-z0-9]|$)' WHEN s.kind < '5' THEN '\..*/de/' WHEN s.kind < '6' THEN '[^a-z0-9].*[^a-z0-9]html([^a-z0-9]|$)' ELSE '\.example.*0' END)
       ) THEN 'block' END, b.rverdict, CASE WHEN regexp_matches(lower(p.host || p.path), '(?s)(^|[^a-z0-9])((casino|bets|poker|porn|xxx|viagra|pills)([^a-z0-9]|$)|ads\..*/banner|tracker[^a-z0-9].*[^a-z0-9]pixel([^a-z0-9]|$)|login[^a-z0-9].*[^a-z0-9]verify([^a-z0-9]|$))|/download/.*\.exe([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b ON b.page_id IS NOT DISTINCT FROM p.page_id AND b.host = p.host AND b.path = p.path
"""

QUERIES = {"op5_toxicity": op5_toxicity, "op6_url_filter": op6_url_filter}
ORACLE_SQL = {"op6_url_filter": _OP6_SQL}


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    stats = written(quality.statistics(docs).drop("text"), "quality-stats", spark)
    keys = ["lang", "source"]
    judged = quality.judge(stats, quality.fit(stats, keys), keys)
    return judged.select("doc_id", *(F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept", "distance")


QUERIES["op7_quality"] = op7_quality


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of equal counts, equal texts together."""
    return sharding.shard_rows(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("group")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    back = warc.round_trip(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS top FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT p.page_id, strlen(p.html) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN g.top > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.top > p.page_id THEN g.top END AS refers_to
FROM p LEFT JOIN g ON g.html = p.html
"""
QUERIES |= {"op8_sharding": op8_sharding, "op10_warc": op10_warc}
ORACLE_SQL["op10_warc"] = _OP10_SQL


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as 2048-token sequences."""
    return packing.pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op3_packing"] = op3_packing


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document."""
    done = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("lines.n_lines").alias("n_lines"), F.col("lines.n_removed").alias("n_removed"), F.col("lines.removed").alias("removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a test item that it holds."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.leaks(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "score", "first_word", "words")


QUERIES |= {"op9_line_dedup": op9_line_dedup, "op2_decontamination": op2_decontamination}


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES["op4_minhash"] = op4_minhash


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document when strings of 400 bytes that occur twice go."""
    done = suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES["op1_suffix_dedup"] = op1_suffix_dedup


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for filling in the middle, and rebuilt from what was written."""
    done = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    form, sha = F.col("fim.form"), lambda text: F.sha2(text.cast("binary"), 256)
    return done.select("doc_id", F.col("fim.n").alias("n"), form.alias("form"), F.col("fim.prefix_chars").alias("prefix_chars"), F.col("fim.middle_chars").alias("middle_chars"), sha(F.col("text")).alias("output_sha256"), sha(fill_middle.restored(F.col("text"), form)).alias("restored_sha256"))


_OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS p, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS q,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
x AS (SELECT doc_id, t, n, form, array_to_string(u[1:p], '') AS a, array_to_string(u[p + 1:q], '') AS m, array_to_string(u[q + 1:n], '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM x
"""
QUERIES["op11_fill_middle"] = op11_fill_middle
ORACLE_SQL["op11_fill_middle"] = _OP11_SQL


def _rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths of all conversations, each with the first few turns of the first of its twenty in place of its own; and their ids."""
    of = lambda c: F.crc32(c.cast("string").cast("binary")) % 4
    size = written(own.groupBy("c").agg(F.count("*").alias("size")), "conversation-sizes")
    convs = size.select("c", of(F.col("c")).alias("h"), (F.col("c") - F.col("c") % 20).alias("base"))
    convs = written(convs.join(size.select(F.col("c").alias("base"), "size"), "base", "left").withColumn("head", F.least("h", F.coalesce("size", F.lit(0)))).drop("size"), "conversations")
    heads = written(own.filter("d <= 3").withColumnRenamed("c", "base"), "heads")
    head = convs.filter("head > 0").join(heads, "base").filter("d <= head").select("c", "d", "a", "b", "words")
    tail = own.join(convs, "c").filter("d > h").select("c", (F.col("head") + F.col("d") - F.col("h")).alias("d"), "a", "b", "words")
    return head.unionByName(tail), convs.select("c")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    own = written(prefix_trie.steps(_table(spark, sf_dir, "conversations")), "steps", spark)
    return prefix_trie.trie(*_rebuilt(own))


_CRC = "xor(list_reduce([4294967295] || list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT), lambda s, v: list_reduce([xor(s, v)] || range(8), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"
_OP12_SQL = f"""
WITH s AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
k AS (SELECT c, l, {_CRC.format("c::VARCHAR")} % 4 AS h FROM s),
z AS (SELECT k.c, coalesce(o.l[1:k.h], []) || k.l[k.h + 1:] AS l FROM k LEFT JOIN s o ON o.c = k.c - k.c % 20),
p AS (SELECT c, len(l) AS size, l, unnest(range(0, len(l) + 1)) AS d FROM z),
q AS (SELECT c, size, d, md5(l[1:d]::VARCHAR) AS key, md5(l[1:d - 1]::VARCHAR) AS up, CASE WHEN d > 0 THEN len(regexp_extract_all(l[d].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM p),
n AS (SELECT d, key, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = d), '') AS ends FROM q GROUP BY d, key),
k2 AS (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k2 ON k2.d = n.d AND k2.key = n.key),
a AS (SELECT DISTINCT x.d, x.key, y.d AS ad, y.key AS akey FROM q x JOIN q y ON x.c = y.c AND y.d <= x.d),
t AS (SELECT ad AS d, akey AS key, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM a JOIN m USING (d, key) GROUP BY 1, 2)
SELECT m.conv_id, m.d::BIGINT AS depth, o.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children, t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN t ON t.d = m.d AND t.key = m.key LEFT JOIN n o ON o.d = m.d - 1 AND o.key = m.up
"""
QUERIES["op12_prefix_trie"] = op12_prefix_trie
ORACLE_SQL["op12_prefix_trie"] = _OP12_SQL


def op13_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths of every document; learnt from those that aren't held out."""
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    done = context_tree.score_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), ~out)
    return done.select("doc_id", out.alias("held_out"), *[F.col(f"lm.{c}").alias(c) for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score")], (-F.col("lm.score") / F.log10(F.lit(2.0)) / (F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).alias("bits_per_byte"))


QUERIES["op13_context_tree"] = op13_context_tree
