"""Allow and block lists for addresses, as a trie over host labels and path segments.

The rules go from the last host label to the first, then along the path. The trie of
`MAX_RULES` rules is what is sent to the tasks at once; a longer list takes a pass over
the pages for each such part of it, and the longest match of all parts decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Saved, prepared, table

#: Rules that may be broadcast: at about 300 bytes each, 30 MB per worker.
MAX_RULES = 100_000

#: The rules of the registered query (fixed values): verdict, host and path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass
class _Node:
    labels: dict[str, _Node] = field(default_factory=dict)
    segments: dict[str, _Node] = field(default_factory=dict)
    #: Beginnings of the next segment at which rules end, longest first.
    ends: list[tuple[str, str, str]] = field(default_factory=list)
    #: The rule that ends before any path, if one does.
    bare: tuple[str, str] | None = None


class Trie:
    """Rules (verdict, `host/path`). Of equal rules, a block goes before an allow."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.root = _Node()
        for verdict, rule in sorted(set(rules), key=lambda r: (r[0] != "block", r[1])):
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r}: allow or block")
            host, slash, path = rule.translate(_LOWER).partition("/")[0], *rule.partition("/")[1:]
            node = self.root
            for label in reversed(host.split(".")):
                node = node.labels.setdefault(label, _Node())
            if not slash:
                node.bare = node.bare or (rule, verdict)
                continue
            *whole, last = (slash + path).split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, _Node())
            if all(last != end for end, *_ in node.ends):
                node.ends.append((last, rule, verdict))
        todo = [self.root]
        while todo:
            node = todo.pop()
            node.ends.sort(key=lambda end: -len(end[0]))
            todo += [*node.labels.values(), *node.segments.values()]

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest rule: most host labels, then longest path."""
        node, chain = self.root, []
        for label in reversed(host.split(".")):
            if (node := node.labels.get(label)) is None:
                break
            chain.append(node)
        parts = path.split("/")
        for node in reversed(chain):
            best = node.bare
            for i, part in enumerate(parts):
                best = next(((rule, verdict) for end, rule, verdict in node.ends if part.startswith(end)), best)
                if i + 1 == len(parts) or (node := node.segments.get(part)) is None:
                    break
            if best:
                return best
        return None, None


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without a `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for end in "?#":
        rest = rest.partition(end)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def judged(url: Column, rules: Sequence[tuple[str, str]], default: str = "allow") -> Column:
    """struct(host, path, rule, verdict) of an address; `default` where no rule fits.

    A null address, or one without `://`, has empty parts, no rule and the default. The
    rules are sent to every task; `judged_pages` takes lists of any length.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules are too many for one pass; see judged_pages")
    trie = Trie(rules)

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for value in urls:
            host, path = parts(value)
            rule, verdict = trie.match(host, path)
            rows.append((host, path, rule, verdict or default))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"], dtype=object)

    return judge(url.cast("string"))


def judged_pages(
    pages: DataFrame, rules: Sequence[tuple[str, str]], url_col: str = "url", default: str = "allow", out: str = "judged"
) -> DataFrame:
    """`pages` with `out`, the struct of `judged`. Rules beyond `MAX_RULES` are judged part
    after part, each pass being written before the next; of the parts' matches the one
    with most host labels counts, then that with the longest path, then a block."""
    prepared(pages.sparkSession)
    ordered = sorted(rules, key=lambda r: r[1].translate(_LOWER))
    blocks = [ordered[i:i + MAX_RULES] for i in range(0, len(ordered), MAX_RULES)] or [[]]
    done = pages.withColumn(out, judged(F.col(url_col), blocks[0], default))
    rule = f"{out}.rule"

    def weight(name: str) -> Column:
        host, path = F.substring_index(name, "/", 1), F.length(name) - F.length(F.substring_index(name, "/", 1))
        labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
        verdict = F.col(name.replace(".rule", ".verdict")) == "block"
        return F.when(F.col(name).isNotNull(), F.struct(labels, path, verdict))

    for block in blocks[1:]:
        step = Saved(done, "judged").df
        both = step.withColumn("_quern_next", judged(F.col(url_col), block, default))
        better = F.col(rule).isNull() | (weight("_quern_next.rule") > weight(rule))
        done = both.withColumn(out, F.when(
            F.col("_quern_next.rule").isNotNull() & better, F.col("_quern_next")).otherwise(F.col(out))).drop("_quern_next")
    return done


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]], url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """`pages` whose address is allowed, all columns as they are.

    A null address, one without `://` and one that no rule fits get the default. Repeated
    pages are each kept or not; no pages give no rows; no rules leave the default to all.
    """
    prepared(pages.sparkSession)
    found = judged_pages(pages, rules, url_col, default, "_quern_judged")
    return found.where("_quern_judged.verdict = 'allow'").drop("_quern_judged")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    pages = table(prepared(spark), sf_dir, "pages")
    return pages.select("page_id", judged(F.col("url"), RULES).alias("j")).select(
        "page_id", "j.host", "j.path", "j.rule", "j.verdict")


OP3_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN ''
    ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') END AS rest
  FROM pages
), cut AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(rest, '/') = 0 THEN '' ELSE substr(rest, strpos(rest, '/')) END AS path
  FROM rest
), rules(verdict, rule, h, p) AS (
  VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
    ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
    ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
), judged AS (
  SELECT page_id, host, path,
    (SELECT max_by({'rule': rule, 'verdict': verdict}, length(h) * 1000 + length(p)) FROM rules
     WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best
  FROM cut
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
"""
