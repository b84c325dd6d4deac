"""URL rules by a sort-merge range join.

A host is turned round, label by label, and closed with a dot: the hosts under a rule's
host are one interval of such keys, and intervals of rules are nested or apart. URLs and
rules are dealt into ranges of keys and sorted; a sweep over each range keeps the rules
whose interval is open on a stack. A rule whose interval crosses a cut goes to each range
it reaches, so no range needs another's rows. Cuts come from a bounded sample and only
balance the work: a key so frequent that it fills several ranges is dealt over them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, about, of which the cuts between ranges are the quantiles.
SAMPLE_ROWS = 20_000


def host_of(url: Column) -> Column:
    """Host of a URL, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """Path of a URL, from its host's end to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """``blog.example.org`` as ``org.example.blog.``; the empty host is the empty key."""
    turned = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))
    return F.when(host == "", F.lit("")).otherwise(turned)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row for each page: id, ``host``, ``path``, ``rule`` (``host`` + ``path`` of the rule, or null), ``verdict``.

    ``rules`` has ``host``, ``path``, ``verdict``. A rule fits its host and all subdomains
    where the path starts with the rule's; the longest (host and path together) wins, at
    equal length the one with the longer host, and of equal rules ``block``. Rules with a
    null in any column are ignored; the empty host fits every URL with a host key above it.
    Without a rule the verdict is ``default``. Null ids and repeated rows stay as they are.
    """
    spark = pages.sparkSession
    id_type = pages.select(F.col(id_col).alias("id")).schema["id"].dataType
    urls = pages.select(
        F.col(id_col).cast("string").alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    ).withColumn("prefix", host_key(F.col("host")))
    ends = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        F.lit(None).cast("string").alias("id"), "host", "path", host_key(F.col("host")).alias("prefix"), "verdict"
    )
    rows = urls.withColumn("verdict", F.lit(None).cast("string")).unionByName(ends)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, SAMPLE_ROWS / max(urls.count(), 1))  # each task sends its share of the sample alone
    keys = sorted(r.key for r in urls.select(F.concat("prefix", "path").alias("key")).sample(share, seed=7).collect())
    cuts = [keys[i * len(keys) // n] for i in range(1, n)] if keys else []

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["key"] = f["prefix"].where(f["verdict"].notna(), f["prefix"] + f["path"])
            ranges = []
            for key, verdict, own in zip(f["key"], f["verdict"], f["id"]):
                low = bisect_left(cuts, key)
                if verdict is not None:  # from the interval's first key to its end
                    high = bisect_left(cuts, key[:-1] + "/") if key else len(cuts)
                    ranges.append(list(range(low, high + 1)))
                else:
                    ranges.append([low + crc32((own or "").encode()) % (bisect_right(cuts, key) - low + 1)])
            f["part"] = ranges
            yield f.explode("part").astype({"part": "int32"})[[*names, "key", "part"]]

    names = ["id", "host", "path", "prefix", "verdict"]
    schema = "id string, host string, path string, prefix string, verdict string, key string, part int"
    dealt = rows.mapInPandas(deal, schema)
    swept = dealt.repartitionById(n, "part").sortWithinPartitions("part", "key", F.col("verdict").isNull(), "path")
    out = "id string, host string, path string, rule string, verdict string"
    result = swept.mapInPandas(lambda frames: _sweep(frames, default), out)
    return result.select(F.col("id").cast(id_type).alias(id_col), "host", "path", "rule", "verdict")


def _sweep(frames: Iterator[pd.DataFrame], default: str) -> Iterator[pd.DataFrame]:
    stack: list[tuple[str, dict, list[int]]] = []  # open prefixes, each with its rules by path and their lengths
    part = None
    for f in frames:
        rules: list[str | None] = []
        verdicts: list[str | None] = []
        for p, host, path, prefix, verdict in zip(f["part"], f["host"], f["path"], f["prefix"], f["verdict"]):
            if p != part:
                stack, part = [], p
            while stack and not prefix.startswith(stack[-1][0]):
                stack.pop()
            if verdict is not None:
                if not stack or stack[-1][0] != prefix:
                    stack.append((prefix, {}, []))
                _, own, lengths = stack[-1]
                if own.get(path, ("", ""))[1] != "block":
                    own[path] = (host + path, verdict)
                if len(path) not in lengths:
                    lengths.append(len(path))
                    lengths.sort(reverse=True)
                rules.append(None)
                verdicts.append(None)
                continue
            best: tuple[int, int, str | None, str] = (-1, -1, None, default)
            for at, own, lengths in stack:
                hit = next((own[path[:n]] for n in lengths if n <= len(path) and path[:n] in own), None)
                if hit:
                    best = max(best, (len(hit[0]), len(at), *hit), key=lambda x: x[:2])
            rules.append(best[2])
            verdicts.append(best[3])
        f = f[["id", "host", "path"]].assign(rule=rules, verdict=verdicts)
        yield f[f["verdict"].notna()]


#: Rules of the query: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: DuckDB SQL of :func:`judge` with RULES.
SQL = r"""
WITH rules(host, path, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
urls AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
    row_number() OVER () AS n
  FROM pages),
fits AS (
  SELECT n, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM urls u JOIN rules r
    ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM urls LEFT JOIN (SELECT * FROM fits WHERE k = 1) f USING (n)
"""
