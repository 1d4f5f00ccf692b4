"""URL filters: path rules first, then host reputation by empirical Bayes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

# The rules (verdict, host and path) of the shared query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Suffixes of two names under which domains are registered; other suffixes are the last name.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "edu.au", "co.nz", "co.jp", "or.jp", "ac.jp", "co.kr", "co.in", "com.cn", "com.tw", "com.hk", "com.sg", "com.br", "com.mx", "com.ar", "com.tr", "co.za", "co.il")
MIN_GOOD, DEVIATIONS = 0.5, 2.0


def _strength(level: str) -> str:
    """The beta prior's strength at one level: the analysis-of-variance estimate of overdispersion, within bounds."""
    return f"""
  SELECT CASE WHEN j < 2 OR n <= j OR msb + (n0 - 1) * msw <= 0 OR msb <= msw THEN 1000.0
    ELSE greatest(1.0, least(1000.0, (msb + (n0 - 1) * msw) / (msb - msw) - 1)) END AS strength, CASE WHEN n > 0 THEN y / n ELSE 0.5 END AS mean
  FROM (SELECT j, n, y, CASE WHEN j > 1 THEN (yy - y * y / n) / (j - 1) END AS msb, CASE WHEN n > j THEN (y - yy) / (n - j) END AS msw, CASE WHEN j > 1 THEN (n - nn / n) / (j - 1) END AS n0
    FROM (SELECT CAST(count(*) AS DOUBLE) AS j, CAST(coalesce(sum(n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(y), 0) AS DOUBLE) AS y, round(coalesce(sum(y * y / CAST(n AS DOUBLE)), 0), 6) AS yy, CAST(coalesce(sum(n * n), 0) AS DOUBLE) AS nn FROM {level} WHERE n > 0) a) b"""


def sql(pages: str, labels: str, rules: Sequence[tuple[str, str]] = RULES, min_good: float = MIN_GOOD, deviations: float = DEVIATIONS, suffixes: Sequence[str] = SUFFIXES) -> str:
    """The whole judgement as SQL that Spark and DuckDB both run."""
    whens = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, path = rule[: rule.index("/")], rule[rule.index("/") :]
        whens.append((f"(host = '{host}' OR right(host, {len(host) + 1}) = '.{host}') AND left(path, {len(path)}) = '{path}'", rule, verdict))
    case = lambda k: "CASE " + " ".join(f"WHEN {w[0]} THEN '{w[k]}'" for w in whens) + " END"
    two = f"two IN ({', '.join(repr(s) for s in suffixes)})" if suffixes else "false"
    return f"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM {pages}),
o AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS y FROM {labels} WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, CAST(coalesce(sum(y), 0) AS BIGINT) AS y FROM u LEFT JOIN o ON u.page_id = o.doc_id GROUP BY host),
h1 AS (SELECT host, n, y, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM h0),
h2 AS (SELECT host, n, y, name, left(name, 1) = '[' OR regexp_extract(name, '^([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+)$', 1) <> '' AS address, regexp_extract(name, '([^.]+[.][^.]+)$', 1) AS two FROM h1),
h AS (SELECT host, n, y, CASE WHEN address THEN name WHEN {two} THEN coalesce(nullif(regexp_extract(name, '([^.]+[.][^.]+[.][^.]+)$', 1), ''), name) ELSE coalesce(nullif(two, ''), name) END AS domain,
  CASE WHEN address THEN '' WHEN {two} THEN two ELSE regexp_extract(name, '([^.]*)$', 1) END AS suffix FROM h2),
d AS (SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS y FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS y FROM d GROUP BY suffix),
kh AS ({_strength("h")}),
kd AS ({_strength("d")}),
ks AS ({_strength("s")}),
ms AS (SELECT suffix, (y + (SELECT strength FROM ks) * (SELECT mean FROM ks)) / (n + (SELECT strength FROM ks)) AS m FROM s),
md AS (SELECT domain, d.suffix, (y + (SELECT strength FROM kd) * m) / (n + (SELECT strength FROM kd)) AS m FROM d JOIN ms ON d.suffix = ms.suffix),
ph AS (SELECT host, (y + (SELECT strength FROM kh) * m) AS a, (n - y + (SELECT strength FROM kh) * (1 - m)) AS b FROM h JOIN md ON h.domain = md.domain AND h.suffix = md.suffix),
rep AS (SELECT host, round(a / (a + b) + {deviations} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) AS upper FROM ph)
SELECT page_id, u.host AS host, path, {case(1)} AS rule, coalesce({case(2)}, CASE WHEN upper < {min_good} THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT * FROM u) u JOIN rep ON u.host = rep.host""".replace("(host =", "(u.host =").replace("right(host", "right(u.host")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, min_good: float = MIN_GOOD, deviations: float = DEVIATIONS, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """A verdict for every page: page_id, host, path, rule and verdict, repeated rows included.

    The longest rule whose host is the page's host or a parent of it, and whose path
    starts the page's path, decides. For the others, the share of good pages of a host
    has a beta prior around its registered domain's (the suffix and the name before it),
    that one around its suffix's (one of ``suffixes``, else the last name), that one
    around the mean of all labelled pages; for these levels a user and a port are left
    out, and an address in numbers is a domain of its own, under the empty suffix; each prior's strength is estimated at its level. A page is good when its
    label has quality 1 and toxic 0; labels belong to the page of the same id. A host
    is blocked when the posterior mean plus ``deviations`` standard deviations stays
    under ``min_good``: hosts without enough bad pages pass. A null url, or one
    without ``://``, has an empty host and path.
    """
    spark = pages.sparkSession
    return spark.sql(sql("{pages}", "{labels}", rules, min_good, deviations, suffixes), pages=pages.select("page_id", "url"), labels=labels.select("doc_id", "quality", "toxic"))


SQL = sql("pages", "labels")
