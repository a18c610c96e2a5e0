"""URL filters: allow and block rules in a trie over reversed host labels and path segments, longest match first.

A rule is a host and a path prefix. It fits its host and all subdomains if the url's path starts with the rule's. Of the
rules that fit, the one with the most host labels wins, then the one with the longest path; of equal rules with different
verdicts, block wins. Urls that no rule fits get the default verdict.

* Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#``
  or the end. Null urls and urls without ``://`` have an empty host and path, which no rule fits.
* Repeated rows and null page ids are judged like any other row.
* The trie is broadcast: at most ``MAX_RULE_BYTES`` of rules. More rules raise; ``join_rules`` does the same as a shuffled
  join on host suffixes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULE_BYTES = 16 << 20
Rule = tuple[str, str, str]  # verdict, host, path

HOST = "^[\\s\\S]*?://([^/?#]*)"
PATH = "^[\\s\\S]*?://[^/?#]*([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


class Trie:
    """Nodes by reversed host label, then by path segment; the rest of a rule's path after its last ``/`` is a prefix."""

    def __init__(self, rules: Sequence[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, {})
            if ends.get(rest, ("allow",))[0] != "block":
                ends[rest] = (verdict, host + path)
            ends[None] = sorted({len(r) for r in ends if r is not None}, reverse=True)  # the lengths worth a look

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits."""
        node, paths = self.root, []
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                paths.append(node[None])
        segments = path.split("/")
        for node in reversed(paths):
            best = None
            for k, segment in enumerate(segments):
                ends = node.get(None, {})
                rest = next((segment[:m] for m in ends.get(None, ()) if segment[:m] in ends), None)
                if rest is not None:
                    best = ends[rest]
                if segment not in node or k == len(segments) - 1:
                    break
                node = node[segment]
            if best:
                return best
        return None


def filter_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, the rule that won (null if none) and the verdict."""
    if sum(len(h) + len(p) for _, h, p in rules) > MAX_RULE_BYTES:
        raise ValueError("too many rules for a broadcast trie; use join_rules")
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [trie.value.match(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "host", "path")), pa.array([g and g[1] for g in got], pa.string()), pa.array([g[0] if g else default for g in got], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return parts.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")


def join_rules(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same for rule tables (verdict, rule_host, rule_path) of any size: a join of distinct host suffixes with the rules.

    Distinct (host, path) pairs are matched once, so a hot host adds rows only where its pages join their verdict.
    """
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    labels = F.split("host", "\\.")
    n = F.size(labels)
    suffix = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    places = parts.select("host", "path").distinct().withColumn("rule_host", F.explode(suffix))
    fits = places.join(rules, "rule_host").where(F.expr("startswith(path, rule_path)"))
    rank = F.struct(F.length("rule_host"), F.length("rule_path"), (F.col("verdict") == "block").cast("int"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), rank).alias("_best"))
    out = parts.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
