"""URL filters: a trie over reversed host labels, each node with a trie over path segments.

The trie is built once, broadcast, and walked per url inside Arrow batches; a walk takes as
many steps as the url has labels and segments, however many rules there are. Of the rules
that fit, the one with the most host labels wins, then the one with the longest path, so an
allow entry can reopen part of a blocked host and the reverse.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no
rule; urls that fit no rule get the default verdict; repeated rows each come back; of equal
rules the later one counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lectern.llm.columns import ascii_lower

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DEFAULT = "allow"
#: Rules above this many bytes are refused: the trie goes to every executor.
RULE_BYTES = 256 << 20


class Trie:
    """``nodes[label]`` chains for hosts; at a host node ``paths`` is a chain for segments."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]) -> None:
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            node = node.setdefault("/paths", {})
            whole, tail = (path[1:].split("/")[:-1], path.rpartition("/")[2]) if path.startswith("/") else ((), None)
            for segment in whole:
                node = node.setdefault(("/", segment), {})
            node.setdefault("tails", {})[tail] = (host + path, verdict)

    def _path(self, node: dict, path: str):
        """The longest rule below one host node; ``None`` as tail is a rule without a path."""
        best = node.get("tails", {}).get(None)
        if not path.startswith("/"):
            return best
        for segment in path[1:].split("/"):
            fits = [t for t in node.get("tails", ()) if t is not None and segment.startswith(t)]
            if fits:
                best = node["tails"][max(fits, key=len)]
            node = node.get(("/", segment))
            if node is None:
                break
        return best

    def find(self, host: str, path: str):
        """(rule, verdict) of the longest match, or None."""
        node, best = self.root, None
        for label in [None, *reversed(host.split("."))]:
            if label is not None:
                node = node.get(label)
                if node is None:
                    break
            if "/paths" in node:
                best = self._path(node["/paths"], path) or best
        return best


def verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """``pages`` (with ``url``) plus host, path, rule and verdict; columns of these names are replaced."""
    if sum(len(h) + len(p) for h, p, _ in rules) > RULE_BYTES:
        raise ValueError("the rules are too large to broadcast")
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def look_up(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find = trie.value.find
        for hosts, paths in batches:
            found = [find(h, p) or (None, default) for h, p in zip(hosts, paths)]
            yield pd.DataFrame({"rule": [r for r, _ in found], "verdict": [v for _, v in found]}, dtype="object")

    parts = pages.withColumn("host", F.coalesce(ascii_lower(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1)), F.lit("")))
    parts = parts.withColumn("path", F.coalesce(F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit("")))
    return parts.withColumn("_lectern_found", look_up("host", "path")).withColumns({"rule": F.col("_lectern_found.rule"), "verdict": F.col("_lectern_found.verdict")}).drop("_lectern_found")
