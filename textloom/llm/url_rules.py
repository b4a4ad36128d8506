"""URL allow and block rules, by a sort-merge range join.

A host is keyed by its labels from last to first, so a rule's host and all its subdomains are one interval of keys:
``[com.example., com.example/)`` (a dot sorts just below a slash, and a key always ends in a dot). The paths that begin
with a rule's path are an interval of paths likewise. URLs are range-partitioned and sorted by key and path; a sweep over
each partition keeps a stack of the rule hosts whose intervals hold the current key, and for each of these a stack of its
rule paths whose intervals hold the current path. Intervals nest, so leaving and entering are pops and pushes, and the
top of a stack is the longest fit. Among the hosts' longest the longest rule (host and path together; then the longer
host) wins.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_map

#: The most rules of one sweep, which are sent to every executor. Of more rules, ranges of hosts are swept one after the
#: other over the same sorted URLs, each carrying on the best rule so far.
MOST_RULES = 1_000_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """What is between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class Nested:
    """Strings as nested intervals (all that begins with them), swept by ascending strings; a step back starts anew."""

    def __init__(self, keys: Sequence[str]):
        self.keys = sorted(keys)
        # the enclosing interval of each, as the sweep may start anywhere
        self.parent: list[int] = []
        for i, k in enumerate(self.keys):
            j = i - 1
            while j >= 0 and not k.startswith(self.keys[j]):
                j = self.parent[j]
            self.parent.append(j)
        self.stack: list[int] = []
        self.next = 0
        self.last: str | None = None

    def at(self, value: str) -> list[int]:
        """Numbers of the intervals that hold ``value``, the longest last."""
        if value == self.last:
            return self.stack
        keys, stack = self.keys, self.stack
        if self.last is None or value < self.last:
            self.next = bisect_right(keys, value)
            i = self.next - 1
            while i >= 0 and not value.startswith(keys[i]):
                i = self.parent[i]
            stack.clear()
            while i >= 0:
                stack.append(i)
                i = self.parent[i]
            stack.reverse()
        else:
            while self.next < len(keys) and keys[self.next] <= value:
                while stack and not keys[self.next].startswith(keys[stack[-1]]):
                    stack.pop()
                stack.append(self.next)
                self.next += 1
            while stack and not value.startswith(keys[stack[-1]]):
                stack.pop()
        self.last = value
        return stack


class Sweep:
    """The rules: nested hosts, and nested paths of each host."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        by_host: dict[str, dict[str, tuple[str, str]]] = {}
        for verdict, host, path in rules:
            of = by_host.setdefault(reversed_key(host), {})
            of[path] = min(of.get(path, (verdict, host + path)), (verdict, host + path))
        self.hosts = Nested(list(by_host))
        self.paths = [Nested(list(by_host[k])) for k in self.hosts.keys]
        self.rules = [[by_host[k][p] for p in n.keys] for k, n in zip(self.hosts.keys, self.paths, strict=True)]

    def best(self, key: str, path: str) -> tuple[str, str, int] | None:
        """(rule, verdict, length of the host's key) of the longest rule that fits."""
        found = None
        for i in reversed(self.hosts.at(key)):  # longer hosts first: they win ties
            fits = self.paths[i].at(path)
            if fits:
                verdict, text = self.rules[i][fits[-1]]
                if found is None or len(text) > len(found[0]):
                    found = text, verdict, len(self.hosts.keys[i])
        return found


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict``. ``rules``: (verdict, host, path), hosts in lower case.

    Null urls and urls without ``://`` have an empty host and path, fit no rule and get the default verdict. A rule given
    twice counts once; of rules with one host and path and several verdicts the alphabetically first wins. Repeated rows
    give repeated rows, an empty table gives none, further columns are ignored. Only ids and urls are shuffled; a host
    with many pages is spread over partitions, as the path and the id take part in the ranges.
    """
    url = df[url_col].cast("string")
    keyed = df.select(df[id_col].cast("long").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path")).withColumn("key", F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit(".")))
    none = (F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(0).alias("reach"))
    swept = keyed.repartitionByRange("key", "path", "page_id").sortWithinPartitions("key", "path").select("page_id", "host", "path", "key", *none)
    every = sorted({tuple(r) for r in rules}, key=lambda r: (reversed_key(r[1]), r))
    for i in range(0, len(every), MOST_RULES):
        swept = _sweep(swept, every[i : i + MOST_RULES])
    return swept.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _sweep(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Sorted urls with their best rule, over these rules and those swept before."""
    shared = urls.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(shared.value)
        for b in batches:
            path, key, rule, verdict, reach = (b.column(i).to_pylist() for i in range(2, 7))
            for i, (k, p) in enumerate(zip(key, path, strict=True)):
                found = sweep.best(k, p)
                if found and (rule[i] is None or (len(found[0]), found[2]) > (len(rule[i]), reach[i])):
                    rule[i], verdict[i], reach[i] = found
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(reach, pa.int32())], ["page_id", "host", "path", "key", "rule", "verdict", "reach"])

    return arrow_map(urls, run, "page_id long, host string, path string, key string, rule string, verdict string, reach int")
