r"""URL filter rules, indexed by the rarest literal token of each rule.

A rule is a *site* rule (host and path prefix, fits the host and its
subdomains) or a *pattern* (``*`` any text, ``^`` a separator or the end,
``||`` the beginning of a host label, ``|`` the beginning or end of the URL).
Its literal tokens are the runs of letters and digits that a URL with a match
must hold as whole tokens.  Each rule is stored under the one of them that
is rarest in the URLs at hand (counted over all URLs); a URL's own tokens then
fetch the few candidate rules, and only these run their regular expressions.

Up to ``in_plan`` rules become one map in the plan, and the URLs are never
shuffled.  More rules are a table: the distinct URLs' tokens meet it in a join,
and the result comes back to the pages by the URL; the same rules are found.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATOR = r"(?:[^a-z0-9_.%-]|$)"


@dataclass(frozen=True)
class Rule:
    """``text`` is ``host/path`` for a site rule, else a pattern; ``action`` is allow or block."""

    text: str
    action: str
    site: bool = False

    def regex(self) -> str:
        """For a site rule over host + path, for a pattern over the lower-cased URL (search, not full match)."""
        if self.site:
            return r"^(?:[^/?#]*\.)?" + _escape(self.text)
        t = self.text.lower()
        head = "^" if t.startswith("|") and not t.startswith("||") else r"^[^:/?#]*://(?:[^/?#]*\.)?" if t.startswith("||") else ""
        tail = "$" if t.endswith("|") and len(t.lstrip("|")) else ""
        body = t.strip("|")
        return head + "".join(".*" if c == "*" else _SEPARATOR if c == "^" else _escape(c) for c in body) + tail

    def tokens(self) -> list[str]:
        """Runs of letters and digits that any match has as whole tokens."""
        t = self.text.lower()
        left, right = self.site or t.startswith("|"), not self.site and t.endswith("|")
        body = t.strip("|")
        out = []
        for m in re.finditer(r"[a-z0-9]+", body):
            a, b = m.span()
            if (body[a - 1] != "*" if a else left) and (body[b] != "*" if b < len(body) else right):
                out.append(m[0])
        return out


def _escape(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(lower_ascii(url), "[^a-z0-9]+"), lambda t: t != ""))


def rarest_tokens(pages: DataFrame, rules: Sequence[Rule], url_col: str) -> dict[str, list[int]]:
    """Token -> numbers of the rules stored under it; rules without a literal token are under ''."""
    known = sorted({t for r in rules for t in r.tokens()})
    counted: dict[str, int] = {}
    if known:
        tokens = pages.select(F.explode(url_tokens(F.col(url_col))).alias("t"))
        if len(known) <= 5000:
            wanted = F.array(*(F.lit(t) for t in known))
            tokens = pages.select(F.explode(F.array_intersect(url_tokens(F.col(url_col)), wanted)).alias("t"))
        else:
            tokens = tokens.join(pages.sparkSession.createDataFrame([(t,) for t in known], "t string"), "t", "left_semi")
        rows = tokens.groupBy("t").count().collect()  # as many rows as rule tokens at most
        counted = {r["t"]: r["count"] for r in rows}
    index: dict[str, list[int]] = {}
    for n, r in enumerate(rules):
        index.setdefault(min(r.tokens(), key=lambda t: (counted.get(t, 0), t), default=""), []).append(n)
    return index


_RULE = "struct<text:string,action:string,site:boolean,regex:string>"


def _fetched_in_plan(index: dict[str, list[int]], rules: Sequence[Rule], url: Column) -> Column:
    """The candidates of a URL by a map in the plan: those under its tokens, and those without a token."""
    rule = lambda r: F.struct(
        F.lit(r.text).alias("text"), F.lit(r.action).alias("action"), F.lit(r.site).alias("site"),
        F.lit(r.regex()).alias("regex")
    )
    none = F.array().cast(f"array<{_RULE}>")
    under = {t: F.array(*(rule(rules[n]) for n in ns)) for t, ns in sorted(index.items())}
    lookup = F.create_map(
        *(x for t, found in under.items() if t for x in (F.lit(t), found))
    ) if any(under) else F.expr("map()").cast(f"map<string,array<{_RULE}>>")
    fetched = F.flatten(F.transform(url_tokens(url), lambda t: F.coalesce(lookup[t], none)))
    return F.concat(fetched, under.get("", none))


def _best(c: str) -> list[Column]:
    """Of the rules that fit, an array: the longest site rule, allowing pattern, and pattern (ties: the alphabetically first)."""
    longest = lambda keep: F.array_min(
        F.transform(F.filter(c, keep), lambda x: F.struct((-F.length(x["text"])).alias("n"), x["text"].alias("text"), x["action"].alias("action")))
    )
    return [
        longest(lambda x: x["site"]).alias("__s"),
        longest(lambda x: ~x["site"] & (x["action"] == "allow")).alias("__a"),
        longest(lambda x: ~x["site"]).alias("__p")
    ]


def _fits(rule: Column, url: Column) -> Column:
    spot = F.concat(host_of(url), path_of(url))
    return F.regexp_like(F.when(rule["site"], spot).otherwise(lower_ascii(F.coalesce(url, F.lit("")))), rule["regex"])


def _judged_by_table(pages: DataFrame, index: dict[str, list[int]], rules: Sequence[Rule], url_col: str) -> DataFrame:
    """__url, __s, __a, __p of the distinct URLs that a rule fits, with the rules as a table."""
    spark = pages.sparkSession
    rows = [(t, (r.text, r.action, r.site, r.regex())) for t, ns in index.items() for r in (rules[n] for n in ns)]
    table = spark.createDataFrame(rows, f"token string, rule {_RULE}").repartition("token")
    urls = pages.select(F.col(url_col).alias("__url")).distinct()
    # rules without a token are stored under the empty one, which every URL has
    tokens = urls.select("__url", F.explode(F.concat(F.array(F.lit("")), url_tokens(F.coalesce("__url", F.lit(""))))).alias("token"))
    met = tokens.join(table, "token").where(_fits(F.col("rule"), F.col("__url")))
    order = F.struct((-F.length("rule.text")).alias("n"), F.col("rule.text").alias("text"), F.col("rule.action").alias("action"))
    least = lambda keep: F.min(F.when(keep, order))
    site, allow = F.col("rule.site"), F.col("rule.action") == "allow"
    return met.groupBy("__url").agg(least(site).alias("__s"), least(~site & allow).alias("__a"), least(~site).alias("__p"))


def judge(pages: DataFrame, rules: Sequence[Rule], *, url_col: str = "url", default: str = "allow", in_plan: int = 2000) -> DataFrame:
    """``pages`` with host, path, rule (the longest site rule that fits, else null), pattern (the longest pattern that fits, else null) and verdict.

    The verdict is the site rule's action; without one the pattern's (an
    allowing pattern before a blocking one); else ``default``.  A null URL has
    empty host and path and, where no rule fits the empty one, the default
    verdict; very long URLs count whole; repeated rows are judged alike; an empty
    table gives an empty table.  Columns so named are replaced.  Ties of length:
    the alphabetically first.
    """
    index = rarest_tokens(pages, rules, url_col)
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "pattern", "verdict")]
    out = pages.select(*(F.col(f"`{c}`") for c in own)).withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    if len(rules) <= in_plan:
        url = F.coalesce(F.col(url_col), F.lit(""))
        out = out.withColumn("__c", _fetched_in_plan(index, rules, url)).withColumn(
            "__c",
            F.filter("__c", lambda c: F.regexp_like(F.when(c["site"], F.concat("host", "path")).otherwise(lower_ascii(url)), c["regex"]))
        )
        out = out.select("*", *_best("__c")).drop("__c")
    else:
        found = _judged_by_table(pages, index, rules, url_col)
        out = out.join(found, F.col(url_col).eqNullSafe(F.col("__url")), "left").drop("__url")
    pattern = F.coalesce("__a", "__p")
    return out.withColumns(
        {"rule": F.col("__s")["text"], "pattern": pattern["text"], "verdict": F.coalesce(F.col("__s")["action"], pattern["action"], F.lit(default))}
    ).drop("__s", "__a", "__p")
