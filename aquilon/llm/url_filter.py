"""URL filters: a sorted sweep over reversed-host keys with a stack of active nested rules."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_parts

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_EVENT = "part int, key string, kind int, page_id long, host string, path string, rule string, verdict string"
_TOP = "\U0010ffff" * 4


def host_path(url):
    """(host, path) columns: host after the first :// up to / ? # or the end, A-Z folded; path up to ? # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url")))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UP, _LOW)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host):
    """Labels reversed, each closed by a dot: a host and its subdomains are the keys with one prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _place(batches, cuts):
    """Gives each page its part; gives each rule to all parts that its interval of keys meets."""
    for batch in batches:
        rows = batch.to_pydict()
        out: dict[str, list] = {k: [] for k in rows}
        for i, (key, kind, page) in enumerate(zip(rows["key"], rows["kind"], rows["page_id"])):
            lo = bisect_right(cuts, (key, -(2**63) if page is None or not kind else page))
            hi = lo if kind else bisect_right(cuts, (key + _TOP, 2**63))
            for p in range(lo, hi + 1):
                for k, v in rows.items():
                    out[k].append(p if k == "part" else v[i])
        yield pa.RecordBatch.from_pydict(out, schema=batch.schema)


def _sweep(batches):
    """Reads events by (part, key, rules first); the stack holds the rules of every host prefix of the
    current key, outermost first. Each level maps paths to rules."""
    part, stack = None, []
    for batch in batches:
        c = batch.to_pydict()
        out = []
        for p, key, kind, page, host, path, rule, verdict in zip(*(c[k] for k in ("part", "key", "kind", "page_id", "host", "path", "rule", "verdict"))):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, set()))
                old = stack[-1][1].get(path)
                if old is None or verdict > old[1]:  # of equal rules block wins
                    stack[-1][1][path] = (rule, verdict)
                stack[-1][2].add(len(path))
                continue
            best = None
            for _, paths, sizes in stack:
                for n in sizes:
                    if (r := paths.get(path[:n])) and len(path) >= n and (best is None or len(r[0]) >= len(best[0])):
                        best = r
            out.append((page, host, path, *(best or (None, None))))
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), *[pa.string()] * 4))], ["page_id", "host", "path", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", sample: int = 20_000) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages.

    rules: host, path, verdict. A rule fits its host and all subdomains where the url's path starts with
    its path; the longest (host and path together) wins, of equally long ones the one with the longer host, of
    repeated ones block; `default` holds where none fits. Null urls, and those without ://, have an empty host and path.

    Events are cut into parts at keys taken from a bounded sample of pages (it sets only the balance); ties
    are cut by page_id, so one frequent host fills many parts. A part gets all rules whose interval meets it, as
    shorter keys sort first. Neither table is broadcast. Repeated pages give a row each.
    """
    host, path = host_path(F.col("url"))
    nul = F.lit(None).cast("string")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    p = p.select(F.lit(-1).alias("part"), host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "page_id", "host", "path", nul.alias("rule"), nul.alias("verdict"))
    r = rules.select(F.coalesce(F.col("host"), F.lit("")).alias("host"), F.coalesce(F.col("path"), F.lit("")).alias("path"), "verdict")
    key = F.when(F.col("host") == "", F.lit("")).otherwise(host_key(F.translate("host", _UP, _LOW)))
    r = r.select(F.lit(-1).alias("part"), key.alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", F.concat("host", "path").alias("rule"), "verdict")
    n = min(n_parts(pages.select("page_id", "url")), sample // 4)
    seen = sorted((k, -(2**63) if i is None else i) for k, i in p.select("key", "page_id").orderBy(F.xxhash64("key", "page_id")).limit(sample).collect())
    cuts = [seen[len(seen) * i // n] for i in range(1, n)] if seen else []
    cuts = sorted(set(cuts))
    events = p.unionByName(r).mapInArrow(lambda it: _place(it, cuts), _EVENT)
    swept = events.repartition(n, "part").sortWithinPartitions("part", "key", "kind", "page_id", "path")
    out = swept.mapInArrow(_sweep, "page_id long, host string, path string, rule string, verdict string")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3 :] END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(rh, rp, v)),
m AS (SELECT page_id, host, path, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id AND m.k = 1
"""
