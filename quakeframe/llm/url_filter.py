"""URL filter: pattern rules found through their rarest literal token (DataFrame functions only).

A rule is a regular expression over ``host`` + ``path``, an action, a rank (the larger wins)
and the literal tokens that every matching url must hold. Tokens of a url are the runs of
``[a-z0-9-]`` in host and path, with the separator before and after them kept out.

1. Count the tokens of all urls (map-side combined) and index each rule by the one of its
   literals that the fewest urls hold; a literal that no url holds retires its rule.
2. Each url's distinct tokens fetch the rules indexed under them; only those run their
   regular expression. Rules without a literal (none by default) run on every url.
3. The rule with the highest rank wins, ties by rule text.

The rule table is broadcast only below ``BROADCAST_RULES`` rows, else joined by token. Hosts
may be as skewed as they like: the token join then ships (url hash, token) rows that AQE can
split, and urls are reduced to distinct (host, path) pairs first.

Edge cases: null url, or one without ``://``, has empty host and path, matches no rule that
needs a literal and gets the default verdict; repeated rows are judged alike; page_id is only
carried along, so it may be null or repeated; very long urls are read whole, each distinct token
once; no pages give an empty result, no rules the default verdict; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm.common import ascii_lower, pick, read

BROADCAST_RULES = 200_000
TOKEN = r"[a-z0-9-]+"

# (action, host, path): fixed by the contract of the query.
HOST_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"),
              ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
# (action, literal host label parts): the method's own verdict where no host rule fits.
LABEL_RULES = [("block", label) for label in
               ("spam-farm", "cheap-pills", "casino", "viagra", "porn", "xxx", "free-money", "payday-loans",
                "replica-watches", "clickbait")]
RULE_TYPE = "rule string, action string, regex string, rank int, literals array<string>, named boolean"


def host_rule(action: str, host: str, path: str) -> tuple:
    """A rule for a host and all its subdomains whose url path starts with ``path``; longer
    rules outrank shorter ones."""
    name = host + path
    regex = r"^([^/?#]*\.)?" + re.escape(host) + "\n" + re.escape(path)
    return (name, action, regex, 1000 + len(name), re.findall(TOKEN, host.lower()) + _inner(path), True)


def _inner(path: str) -> list[str]:
    """Literal tokens of a path that are closed on both sides (a prefix may end inside one)."""
    return re.findall(r"(?<![a-z0-9-])" + TOKEN + r"(?![a-z0-9-])(?=.)", path.lower()) if path == path.lower() else []


def label_rule(action: str, label: str) -> tuple:
    """A rule for hosts with the label; below every host rule and without a name in the result."""
    return (f"label:{label}", action, r"^([^/?#]*\.)?" + re.escape(label) + r"(\.[^/?#]*)?(:[0-9]+)?" + "\n", 1, [label], False)


def default_rules() -> list[tuple]:
    return [host_rule(*r) for r in HOST_RULES] + [label_rule(*r) for r in LABEL_RULES]


def url_parts(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    none = F.lit("")
    return F.coalesce(host, none), F.coalesce(path, none)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (name of the winning named rule, else null), verdict."""
    host, path = url_parts(F.col("url"))
    urls = pick(pages, page_id=id_col, url=url_col).select("page_id", host.alias("host"), path.alias("path"))
    # Host and path are matched as "host\npath": neither part can then run into the other.
    sites = urls.select("host", "path").distinct()
    sites = sites.withColumn("site", F.concat(F.col("host"), F.lit("\n"), F.col("path")))
    # Host names are lower case; path tokens stay as they are, so a literal is lower case in both.
    tokens = sites.withColumn("token", F.explode(F.array_distinct(F.regexp_extract_all("site", F.lit(TOKEN), F.lit(0)))))
    literal = rules.select("rule", F.explode(F.array_distinct("literals")).alias("token"))
    counts = tokens.join(_small(literal.select("token").distinct()), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    held = literal.join(counts, "token", "left").groupBy("rule").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
    index = rules.join(held.select("rule", F.col("best.token").alias("token"), F.col("best.n").alias("n")), "rule")
    index = _small(index.filter(F.col("n") > 0).drop("n", "literals"))
    matched = tokens.join(index, "token").filter(F.expr("site rlike regex"))
    everywhere = rules.filter(F.size("literals") == 0).drop("literals")
    if not everywhere.isEmpty():  # a stated rule set against all sites
        matched = matched.drop("token").unionByName(sites.join(F.broadcast(everywhere), F.expr("site rlike regex")))
    best = matched.groupBy("host", "path").agg(F.max_by(F.struct("rule", "action", "named"), F.struct("rank", "rule")).alias("best"))
    judged = urls.join(best.withColumnsRenamed({"host": "bh", "path": "bp"}),
                       (F.col("host") == F.col("bh")) & (F.col("path") == F.col("bp")), "left")
    return judged.select("page_id", "host", "path", F.when(F.col("best.named"), F.col("best.rule")).alias("rule"),
                         F.coalesce("best.action", F.lit(default)).alias("verdict"))


def _small(rules: DataFrame) -> DataFrame:
    return F.broadcast(rules) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rules


def q_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), spark.createDataFrame(default_rules(), RULE_TYPE))


QUERIES = {"op4_url_filter": q_url_filter}

_HOST = "coalesce(translate(regexp_extract(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '^[^/?#]*([^?#]*)', 1), '')"
_LABELS = " OR ".join(f"regexp_matches(host, '^([^/?#]*\\.)?{re.escape(label)}(\\.[^/?#]*)?(:[0-9]+)?$')" for _, label in LABEL_RULES)
ORACLE = {"op4_url_filter": f"""
WITH u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
r(action, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT u.page_id, max_by(h || p, length(h || p)) AS rule, max_by(action, length(h || p)) AS action
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY u.page_id)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN {_LABELS} THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN m USING (page_id)"""}
