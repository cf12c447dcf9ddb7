"""Operator 3, URL filters: a trie over reversed host labels and then path segments, broadcast.

A rule is ``host/path``: it fits its host and all subdomains when the url's
path starts with the rule's path. Allow and block entries share the trie; the
longest fitting rule wins (most host labels, then longest path; block before
allow on a full tie). Without a fitting rule the verdict is ``default``.

* null url or no ``://``: host and path are empty, no rule fits;
* a url without a path (``http://x.net``) starts with no rule's ``/``;
* empty host labels (``a..net``) are labels like any other;
* duplicate rows are judged alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import ascii_lower

# A rule list is broadcast up to this many entries (about 100 bytes each in the trie).
MAX_RULES = 1_000_000


class RuleTrie:
    """Nested dicts: host labels from the right, then the path's full segments.

    ``rest`` of a node holds the last, possibly partial, segment of the rules
    that end there: a rule path ``/en/`` ends with the empty segment, which
    every url path below ``/en/`` starts with.
    """

    def __init__(self, rules: list[tuple[str, str]]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; a broadcast trie takes at most {MAX_RULES}: apply them in parts")
        self.hosts: dict = {}
        for verdict, rule in sorted(rules):  # allow first, so that block replaces it on a tie
            host, _, path = rule.partition("/")
            node = self.hosts
            for label in reversed(host.lower().split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            *segments, last = path.split("/")
            node = node.setdefault("paths", {})
            for s in segments:
                node = node.setdefault("segments", {}).setdefault(s, {})
            node.setdefault("rest", {})[last] = (rule, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, as (rule, verdict)."""
        if not path.startswith("/"):
            return None
        segments, best, node = path[1:].split("/"), None, self.hosts
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            if "paths" in node:
                best = self._below(node["paths"], segments) or best
        return best

    @staticmethod
    def _below(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for s in segments:
            fits = [r for r in node.get("rest", ()) if s.startswith(r)]
            if fits:
                best = node["rest"][max(fits, key=len)]
            node = node.get("segments", {}).get(s)
            if node is None:
                break
        return best


def url_host(url: Column) -> Column:
    """Lower-cased text between the first ``://`` and the next ``/``, ``?`` or ``#``; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """The text after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow",
                url: str = "url", id_col: str = "page_id") -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` for every row; ``rules`` are (verdict, ``host/path``)."""
    trie = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))
    data = pages.select(F.col(id_col), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for b in batches:
            found = [find(h, p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([f and f[0] for f in found], pa.string()),
                 pa.array([f[1] if f else default for f in found], pa.string())],
                names=[*b.schema.names, "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    return data.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
