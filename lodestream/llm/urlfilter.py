"""Operator 2: URL rules by a sort-merge range join.

A host's labels are reversed and each ends in a dot (`blog.example.org` becomes
`org.example.blog.`), so a rule's host and all its subdomains are one interval of keys,
and a rule's path one interval of paths.  Urls are range-partitioned and sorted by key
and path; one sweep over a sorted partition keeps a stack of the host rules whose
interval is open, nested ones on top.  The paths of each are sorted with a link to the
path that they are nested in, so that the longest one that starts the url's path is
found from its place among them.  The longest rule of the stack wins.

Rules, rows of a table or of a list, are swept in sorted chunks of CHUNK at most, one
after the other, each pass written before the next begins; so what a task or the driver
holds is bounded whatever their number.  The range is over key, path and id together:
one host with a third of all urls is split over many partitions.

Defined results: a null url, or one without `://`, has an empty host and path.  With
equal length the longer host wins, then block.  An empty rule host fits every host; a
null host or path of a rule is empty.  A very long url is judged whole.  Repeated rules
and rows are kept as they are; null ids stay null; other columns of the table, whatever
their names, are neither read nor returned; no rules give the default everywhere."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import Stored, lower_ascii, require

CHUNK = 100_000
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

Rule = tuple[str, str, str]  # host, path, verdict


def host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def host_key(h: str) -> str:
    return ".".join(reversed(h.split("."))) + "." if h else ""


class _Paths:
    """The path rules of one host, as nested intervals."""

    def __init__(self, rules: Sequence[tuple[str, str, str, str]]):
        """rules: (key, host, path, verdict) of one host, sorted; of one path's rules block counts."""
        self.key, self.host = rules[0][0], rules[0][1]
        verdicts: dict[str, str] = {}
        for _, _, p, v in rules:
            verdicts[p] = "block" if "block" in (v, verdicts.get(p)) else v
        self.paths, self.verdicts = list(verdicts), list(verdicts.values())
        self.outer: list[int] = []  # the longest other path that starts this one
        open_: list[int] = []
        for i, p in enumerate(self.paths):
            while open_ and not p.startswith(self.paths[open_[-1]]):
                open_.pop()
            self.outer.append(open_[-1] if open_ else -1)
            open_.append(i)

    def best(self, path: str) -> int:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.outer[i]
        return i


def _sweep(rules: Sequence[tuple[str, str, str, str]]):
    """rules: (key, host, path, verdict), sorted. Urls come sorted by key."""

    def run(frames):
        stack: list[_Paths] = []
        nxt = 0
        for f in frames:
            rule, verdict = f["rule"].tolist(), f["verdict"].tolist()
            best = [tuple(x) for x in zip(f["n_rule"].tolist(), f["n_host"].tolist(), f["n_block"].tolist(), strict=True)]
            for i, (key, p) in enumerate(zip(f["key"], f["path"], strict=True)):
                while nxt < len(rules) and rules[nxt][0] <= key:  # intervals that open up to here
                    end = bisect_right(rules, rules[nxt][0], lo=nxt, key=lambda r: r[0])
                    while stack and not rules[nxt][0].startswith(stack[-1].key):
                        stack.pop()
                    if key.startswith(rules[nxt][0]):  # the others have closed before
                        stack.append(_Paths(rules[nxt:end]))
                    nxt = end
                while stack and not key.startswith(stack[-1].key):  # intervals that have closed
                    stack.pop()
                for group in stack:
                    if (j := group.best(p)) >= 0:
                        rp, v = group.paths[j], group.verdicts[j]
                        if (rank := (len(group.host) + len(rp), len(group.host), int(v == "block"))) > best[i]:
                            best[i], rule[i], verdict[i] = rank, group.host + rp, v
            f["rule"], f["verdict"] = rule, verdict
            f[["n_rule", "n_host", "n_block"]] = pd.DataFrame(best, index=f.index, columns=["n_rule", "n_host", "n_block"], dtype="int64")
            yield f

    return run


def _chunks(rules: Sequence[Rule] | DataFrame, chunk: int) -> Iterator[list[tuple[str, str, str, str]]]:
    """Rules as (key, host, path, verdict), sorted by all of them, chunk by chunk."""
    if isinstance(rules, DataFrame):
        require(rules, "host", "path", "verdict")
        h, p = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("host", "path"))
        keyed = iter(tuple(r) for r in rules.select(_key(h), h, p, "verdict").toDF("key", "host", "path", "verdict").orderBy("key", "host", "path", "verdict").toLocalIterator())
    else:
        keyed = iter(sorted((host_key(h or ""), h or "", p or "", v) for h, p, v in rules))
    while part := list(islice(keyed, chunk)):
        yield part


def _key(h: Column) -> Column:
    return F.when(h == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(h, r"\.")), "."), F.lit(".")))


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame, default: str = "allow", chunk: int = CHUNK) -> DataFrame:
    """page_id, host, path, rule, verdict of every row; rules: (host, path, verdict); default: the verdict where no rule fits."""
    require(pages, "page_id", "url")
    urls = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    swept = urls.select(
        "page_id", "host", "path", _key(F.col("host")).alias("key"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"),
        F.lit(-1).cast("long").alias("n_rule"), F.lit(-1).cast("long").alias("n_host"), F.lit(-1).cast("long").alias("n_block"),
    )
    last, several = None, False
    for part in _chunks(rules, chunk):
        several = several or len(part) == chunk
        swept = swept.repartitionByRange("key", "path", "page_id").sortWithinPartitions("key", "path", "page_id").mapInPandas(_sweep(part), swept.schema)
        if several:
            now = Stored(swept, "judged")
            if last is not None:
                last.drop()
            swept, last = now.df, now
    return swept.select("page_id", "host", "path", "rule", "verdict")
