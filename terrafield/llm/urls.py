"""URL filters as a sort-merge range join.

A host's labels, reversed and each ended by a separator, make a key under which a host and all its subdomains form one
interval. Urls are sorted by that key within their partition and swept once beside the sorted hosts of the rules; the hosts whose
interval holds the current key lie nested on a stack. Of each, the rules' paths are intervals too, sorted and nested: the
last that begins before a url's path, or one of those around it, is the longest that fits.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable
from functools import partial
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEP = "\x01"
#: Rules are sent to the tasks in sets of this many; more of them make more passes.
MAX_RULES = 100_000


def host_and_path(url) -> tuple[F.Column, F.Column]:
    """Host: after the first ://, up to /, ?, # or the end, A-Z lower-cased. Path: then up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host) -> F.Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), SEP), F.lit(SEP))


def _key(host: str) -> str:
    return SEP.join(reversed(host.split("."))) + SEP


class Host:
    """The rules of one host: paths, sorted; of each the next shorter one around it, or -1; and their verdicts."""

    def __init__(self, host: str, rules: list[tuple[str, str]]):
        self.key, self.host = _key(host), host
        self.paths, self.verdicts = zip(*sorted(rules))
        self.around, stack = [], []
        for k, path in enumerate(self.paths):
            while stack and not path.startswith(self.paths[stack[-1]]):
                stack.pop()
            self.around.append(stack[-1] if stack else -1)
            stack.append(k)

    def longest(self, path: str) -> int:
        """The number of the longest path that `path` starts with, or -1."""
        k = bisect_right(self.paths, path) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.around[k]
        return k


def _sweep(batches, hosts):
    hosts = hosts.value  # sorted by key
    nxt, stack, last = 0, [], None
    for b in batches:
        best, before = [], None
        for key, host, path, was in zip(*[b.column(c).to_pylist() for c in ("key", "host", "path", "rule")]):
            if before == (key, path, was):  # sorted, so equal urls follow one another
                best.append(best[-1])
                continue
            before = (key, path, was)
            if key != last:
                while nxt < len(hosts) and hosts[nxt].key <= key:  # intervals that begin up to here, outer ones first
                    while stack and not hosts[nxt].key.startswith(stack[-1].key):
                        stack.pop()
                    stack.append(hosts[nxt])
                    nxt += 1
                while stack and not key.startswith(stack[-1].key):  # intervals that ended
                    stack.pop()
                last = key
            found = (len(was["rule"]), len(was["host"]), was["rule"], was["verdict"], was["host"]) if was else (-1, -1, None, None, None)
            for h in stack:
                if (host == h.host or host.endswith("." + h.host)) and (k := h.longest(path)) >= 0:
                    found = max(found, (len(h.host) + len(h.paths[k]), len(h.host), h.host + h.paths[k], h.verdicts[k], h.host), key=lambda x: x[:2])
            best.append(None if found[2] is None else {"rule": found[2], "verdict": found[3], "host": found[4]})
        kind = pa.struct([("rule", pa.string()), ("verdict", pa.string()), ("host", pa.string())])
        cols = [b.column(i) if n != "rule" else pa.array(best, kind) for i, n in enumerate(b.schema.names)]
        yield pa.RecordBatch.from_arrays(cols, b.schema.names)


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_rules: int = MAX_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    rules: (`host/path`, verdict). A rule fits its host and all subdomains if the path starts with the rule's; the
    longest that fits wins, of equal lengths the one with the longer host, and of equal rules the first. Without one the
    verdict is `default`. A url that is null or has no :// has an empty host and path, which no rule fits. Nothing is
    shuffled: each task sorts and sweeps its own urls, so a host that holds most urls is as cheap as many
    small ones, and a url costs the depth of its host and a search in each host's sorted paths, however many rules a host has. Very long
    urls are judged whole. Rules beyond `max_rules` are swept in further passes that keep the better rule. Empty tables and
    repeated rows are as any; other columns aren't read.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    none = "struct<rule:string,verdict:string,host:string>"
    rows = rows.withColumns({"key": host_key(F.col("host")), "rule": F.lit(None).cast(none)})
    seen, it = {}, iter(rules)
    while some := list(islice(it, max_rules)):
        part = defaultdict(list)
        for rule, verdict in some:
            rhost, slash, rpath = rule.partition("/")
            if rhost and slash and rule not in seen:
                part[rhost].append((slash + rpath, verdict))
                seen[rule] = verdict
        shared = pages.sparkSession.sparkContext.broadcast(sorted((Host(h, r) for h, r in part.items()), key=lambda h: h.key))
        rows = rows.sortWithinPartitions("key", "path").mapInArrow(partial(_sweep, hosts=shared), f"page_id {pages.schema[id_col].dataType.simpleString()}, host string, path string, key string, rule {none}")
    return rows.select("page_id", "host", "path", F.col("rule.rule").alias("rule"), F.coalesce("rule.verdict", F.lit(default)).alias("verdict"))
