"""URL rules by a sorted sweep over reversed-host keys."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from sizewise.llm.common import ascii_lower

#: Rules that one pass carries to the executors, at most; more rules take further passes.
RULES_PER_PASS = 500_000


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_key(host: Column) -> Column:
    """The labels in reverse, each with its dot: all subdomains of a host are the keys that begin with its key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class RuleSweep:
    """Meets keys in ascending order and keeps the stack of hosts whose interval holds the current key."""

    def __init__(self, rules: list[tuple[str, str, str, str]]):
        """``rules``: key of the host, host, path and verdict, sorted by key."""
        self.by_key: dict[str, dict[str, tuple[str, str]]] = {}
        for key, host, path, verdict in rules:
            self.by_key.setdefault(key, {}).setdefault(path, (host + path, verdict))
        self.keys = sorted(self.by_key)
        self.lengths = {k: sorted({len(p) for p in v}, reverse=True) for k, v in self.by_key.items()}
        self.stack: list[str] | None = None
        self.next = 0

    def move(self, key: str) -> None:
        if self.stack is None:  # where the sweep begins: the intervals that are open already
            self.next = bisect_left(self.keys, key)
            cuts = [i + 1 for i, c in enumerate(key) if c == "."]
            self.stack = [key[:c] for c in cuts if key[:c] in self.by_key and key[:c] < key]
        to = bisect_right(self.keys, key, lo=self.next)
        for rule in self.keys[self.next:to]:
            while self.stack and not rule.startswith(self.stack[-1]):
                self.stack.pop()
            self.stack.append(rule)
        self.next = to
        while self.stack and not key.startswith(self.stack[-1]):
            self.stack.pop()

    def best(self, key: str, path: str) -> tuple[str, str] | None:
        self.move(key)
        found = None
        for rule in reversed(self.stack):  # the deepest host first: it wins ties
            paths = self.by_key[rule]
            for n in self.lengths[rule]:
                if n <= len(path) and path[:n] in paths:
                    if found is None or len(paths[path[:n]][0]) > len(found[0]):
                        found = paths[path[:n]]
                    break
        return found


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow",
               rules_per_pass: int = RULES_PER_PASS) -> DataFrame:
    """Which rule each URL falls under, and its verdict.

    The project keeps no URLs, so the operator is general. ``rules`` has ``host``, ``path`` and ``verdict``. The host of
    a URL is what stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; its path runs on to
    ``?``, ``#`` or the end. A rule fits its host and all subdomains if the path begins with the rule's path. The longest
    rule (characters of host and path together) wins, of equally long ones that with the longer host, of rules given twice the one with the
    smaller verdict. Returns all columns of ``pages`` and ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``
    (``default`` if none fits).

    With the labels of a host in reverse, a rule is an interval of keys that holds all its subdomains, and intervals of
    different hosts are nested or apart. Each task sorts its pages by that key and sweeps pages and rules together with a
    stack of open intervals. Pages are not shuffled, so no host can be hot. Rules travel in passes of at most
    ``rules_per_pass``, each keeping the better rule; the result is the same for any number of passes.

    Null URLs and those without ``://`` have empty host and path, which only a rule with an empty host fits. Rules with a
    null host, path or verdict are left out. Repeated rows are judged alike. Clashing columns are replaced.
    """
    given = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        ascii_lower(F.col("host")).alias("host"), "path", "verdict").distinct()
    listed = sorted((r["key"], r["host"], r["path"], r["verdict"])  # the rules: configuration, not corpus data
                    for r in given.withColumn("key", host_key(F.col("host"))).collect())
    added = ["host", "path", "rule", "verdict"]
    keep = [c for c in pages.columns if c not in added]
    rows = pages.select(*keep, url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"),
                        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    rows = rows.withColumn("_key", host_key(F.col("host"))).sortWithinPartitions("_key")
    for at in range(0, len(listed), rules_per_pass):
        rows = rows.mapInArrow(_sweep(listed[at:at + rules_per_pass]), rows.schema)
    return rows.select(*keep, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _sweep(rules: list[tuple[str, str, str, str]]):
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = RuleSweep(rules)
        for batch in batches:
            rule, verdict = batch.column("rule").to_pylist(), batch.column("verdict").to_pylist()
            keys, paths = batch.column("_key").to_pylist(), batch.column("path").to_pylist()
            for i, (key, path) in enumerate(zip(keys, paths, strict=True)):
                found = state.best(key, path)
                if found and (rule[i] is None or len(found[0]) >= len(rule[i])):  # later passes hold longer hosts
                    rule[i], verdict[i] = found
            new = {"rule": pa.array(rule, pa.string()), "verdict": pa.array(verdict, pa.string())}
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)

    return sweep
