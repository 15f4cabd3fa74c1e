"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a literal token index entry plus one regular expression. The tokens of a
URL fetch candidate rules; only candidates run their expression. Which token
represents a rule is decided by token counts over all URLs (a Spark aggregation
over the tokens that occur in rules, so the counts are as small as the rule list).
Rows without an address, very long addresses and an empty table are judged like any (see :func:`judge_urls`).
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.stage import held, quoted, released

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``text`` is ``host/path`` (kind "host") or a pattern of literals, ``*`` and ``^`` (kind "pattern").

    In patterns ``*`` is any text and ``^`` one separator (or an end of the address).
    """

    text: str
    verdict: str
    kind: str = "host"

    def regex(self) -> str:
        if self.kind == "host":
            host, _, path = self.text.partition("/")
            return rf"(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}"
        body = "".join({"*": ".*", "^": r"(?:[^a-z0-9]|\Z|(?<![\s\S]))"}.get(c, re.escape(c)) for c in self.text)
        return rf"(?s).*{body}"

    def tokens(self) -> list[str]:
        """Literal tokens that any URL matching this rule has as whole tokens."""
        text, found = self.text, []
        for m in _TOKEN.finditer(text.lower()):
            before = text[m.start() - 1] if m.start() else ("/" if self.kind == "host" else "*")
            after = text[m.end()] if m.end() < len(text) else "*"
            if before != "*" and after != "*":
                found.append(m[0])
        return list(dict.fromkeys(found))


#: Rules of a list that fit into every task with their index.
MOST_RULES = 500_000


@functools.lru_cache(1 << 16)
def _compiled(regex: str) -> re.Pattern:
    return re.compile(regex)


#: Addresses that the pattern rules reject when no host rule fits.
PATTERNS = (
    Rule("^casino^", "block", "pattern"),
    Rule("^bets^", "block", "pattern"),
    Rule("^poker^", "block", "pattern"),
    Rule("^porn^", "block", "pattern"),
    Rule("^xxx^", "block", "pattern"),
    Rule("^viagra^", "block", "pattern"),
    Rule("^pills^", "block", "pattern"),
    Rule("^ads.*/banner", "block", "pattern"),
    Rule("^tracker^*^pixel^", "block", "pattern"),
    Rule("^login^*^verify^", "block", "pattern"),
    Rule("/download/*.exe^", "block", "pattern"),
)


def read_rules(table: DataFrame) -> list[Rule]:
    """Rules from a table of text, verdict and kind (host or pattern), in text order; at most ``MOST_RULES``, more is an error. Nulls and repeats go."""
    rows = table.select("text", "verdict", "kind").dropna().distinct().orderBy("kind", "text", "verdict").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return [Rule(*r) for r in rows]


#: Sites, most frequent first, that rules are made for.
MOST_SITES = 2_000
#: Patterns for a site by the first hex digit of its MD5; sites with other digits have none.
SITE_PATTERNS = ("012", "^{}^"), ("34", "^{}.*/de/"), ("5", "^{}^*^html^"), ("67", "^{}.example*0")


def site_rules(urls: DataFrame, url_col: str = "url", most: int = MOST_SITES) -> DataFrame:
    """A block list (text, verdict, kind) made from the addresses: mixed patterns for half of the ``most`` most frequent sites (third part of a host from its end; ties by name)."""
    site = F.regexp_extract(url_parts(url_col)[0], r"([^.]+)\.[^.]+\.[^.]+$", 1)
    top = urls.select(site.alias("site")).filter(F.col("site").rlike("^[a-z0-9-]+$")).groupBy("site").count().orderBy(F.desc("count"), "site").limit(most)
    digit = F.substring(F.md5(F.col("site").cast("binary")), 1, 1)
    text = F.coalesce(*[F.when(digit.isin(list(digits)), F.format_string(form.replace("{}", "%s"), "site")) for digits, form in SITE_PATTERNS])
    return top.select(text.alias("text"), F.lit("block").alias("verdict"), F.lit("pattern").alias("kind")).dropna()


def url_parts(url: str) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path after the first ``://``; both empty without one or for null."""
    url = F.coalesce(quoted(url), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _SMALL)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def token_counts(urls: DataFrame, rules, url_col: str = "url") -> dict[str, int]:
    """How many URLs have each token of the rules, over all URLs; as many entries as the rules have tokens."""
    wanted = sorted({t for r in rules for t in r.tokens()})
    if not wanted:
        return {}
    host, path = url_parts(url_col)
    tokens = F.array_distinct(F.split(F.translate(F.concat(host, path), _UPPER, _SMALL), "[^a-z0-9]+"))
    found = urls.select(F.explode(F.array_intersect(tokens, F.lit(wanted))).alias("token")).groupBy("token").count()
    return {r["token"]: r["count"] for r in found.collect()}


def rule_index(rules, counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules by their rarest token (ties by spelling); rules without a literal token apart."""
    index: dict[str, list[int]] = defaultdict(list)
    rest = []
    for i, r in enumerate(rules):
        if tokens := r.tokens():
            index[min(tokens, key=lambda t: (counts.get(t, 0), t))].append(i)
        else:
            rest.append(i)
    return dict(index), rest


def judge_urls(urls: DataFrame, rules, patterns=PATTERNS, default: str = "allow", url_col: str = "url", counts: dict | None = None) -> DataFrame:
    """All columns of ``urls`` plus ``judged``: struct(host, path, rule, verdict, pattern, n_regex).

    Host rules come first: the longest that fits decides (ties: the smaller text).
    Otherwise the first pattern rule that matches ``host + path`` (lower-cased) decides,
    else ``default``. Null and malformed URLs have an empty host and path and get the
    default unless a pattern without literals matches. Repeated rows are judged alike. Other
    columns pass; ``judged`` takes the place of an input column of its name.
    """
    rules = list(rules) + list(patterns)
    if counts is None:
        counts = token_counts(urls, rules, url_col)
    index, rest = rule_index(rules, counts)
    regexes = [r.regex() for r in rules]
    kind = pa.struct([("rule", pa.string()), ("verdict", pa.string()), ("pattern", pa.string()), ("n_regex", pa.int64())])

    def judge(address: pa.Array) -> pa.Array:
        out = {k: [] for k in ("rule", "verdict", "pattern", "n_regex")}
        for text in address.to_pylist():
            low = text.translate(_FOLD)
            found = sorted({i for t in set(_TOKEN.findall(low)) for i in index.get(t, ())} | set(rest))
            best, pattern = None, None
            for i in found:
                r = rules[i]
                if r.kind == "host":
                    if _compiled(regexes[i]).match(text) and (best is None or (-len(r.text), r.text) < (-len(best.text), best.text)):
                        best = r
                elif pattern is None and _compiled(regexes[i]).match(low):
                    pattern = r
            decided = best or pattern
            out["rule"].append(best.text if best else None)
            out["verdict"].append(decided.verdict if decided else default)
            out["pattern"].append(pattern.text if pattern else None)
            out["n_regex"].append(len(found))
        return pa.StructArray.from_arrays([pa.array(out[f.name], f.type) for f in kind], fields=list(kind))

    host, path = url_parts(url_col)
    udf = F.arrow_udf(judge, "struct<rule:string,verdict:string,pattern:string,n_regex:bigint>")
    got = held(urls, at=F.struct(host.alias("host"), path.alias("path"))).withColumn("got", udf(F.concat("at.host", "at.path")))
    return released(got, urls.columns, judged=F.struct("at.host", "at.path", "got.rule", "got.verdict", "got.pattern", "got.n_regex"))


_FOLD = str.maketrans(_UPPER, _SMALL)
