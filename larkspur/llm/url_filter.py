"""URL filter: longest-matching rules, and redirect equivalence for urls without a rule.

DataFrame operations only. Redirect and canonical-link edges join urls into classes (distributed
connected components). A url that no rule fits is blocked if its class holds a blocked url and
no explicitly allowed one: an explicit allow takes precedence over every propagated block. A
url's own rule always decides for the url itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.graph import connected_components
from larkspur.llm.storage import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to here rules are one CASE expression; a longer list is joined on host suffixes.
INLINE_RULES = 200


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(__url, locate('://', __url) + 3)")).otherwise(F.lit(""))


def with_parts(df: DataFrame, url_col: str) -> DataFrame:
    """Add host, path and node (host, path and query: a url's identity) to ``df``; empty for no url."""
    out = df.withColumn("__url", F.col(url_col)).withColumn("__rest", _rest(F.col("__url")))
    out = out.withColumn("host", F.translate(F.regexp_extract("__rest", r"^([^/?#]*)", 1), _UPPER, _LOWER))
    out = out.withColumn("path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1))
    out = out.withColumn("node", F.concat("host", "path", F.regexp_extract("__rest", r"^[^?#]*([^#]*)", 1)))
    return out.drop("__url", "__rest")


def _fits(host: str, path: str) -> Column:
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def with_rules(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Add rule (host and path of the longest fitting rule, else null) and ruled (its verdict).

    ``rules`` are (verdict, host, path). Equal lengths: the longer host, then block first.
    """
    order = sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1:], r[0] != "block"))
    if len(order) <= INLINE_RULES:
        rule = ruled = F.lit(None).cast("string")
        for verdict, host, path in reversed(order):
            rule = F.when(_fits(host, path), F.lit(host + path)).otherwise(rule)
            ruled = F.when(_fits(host, path), F.lit(verdict)).otherwise(ruled)
        return df.withColumn("rule", rule).withColumn("ruled", ruled)
    spark, names = df.sparkSession, df.columns
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(order)], "__i int, __verdict string, __host string, __rpath string")
    places = df.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    best = (
        places.withColumn("__suffix", F.explode(suffixes))
        .join(table, (F.col("__suffix") == F.col("__host")) & F.col("path").startswith(F.col("__rpath")))
        .groupBy("host", "path").agg(F.min_by(F.struct(F.concat("__host", "__rpath").alias("rule"), F.col("__verdict").alias("ruled")), "__i").alias("__best"))
    )
    return df.join(best, ["host", "path"], "left").select(*[F.col(f"`{n}`") for n in names], "__best.rule", "__best.ruled")


#: Named character references that urls in attributes use; numeric ones are decoded by rule.
_NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "amp": "&"}
_SPACE = "[ \\t\\n\\x0c\\r]"


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag's text, as it stands; empty if there is none."""
    pattern = rf"""(?is){_SPACE}{name}{_SPACE}*={_SPACE}*(?:"([^"]*)"|'([^']*)'|([^ \t\n\x0c\r"'>]+))"""
    return F.concat(*[F.coalesce(F.regexp_extract(tag, pattern, k), F.lit("")) for k in (1, 2, 3)])


def _decoded(text: Column) -> Column:
    """Trimmed, with character references replaced: numeric ones, then the named ones, once each."""

    def one(part: Column) -> Column:  # what follows a "&#"
        digits = F.regexp_extract(part, r"^([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});?", 1)
        code = F.when(digits.rlike("^[xX]"), F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(digits).cast("long")
        good = (digits != "") & (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(F.lit(32))), 8, "0")), "UTF-32")
        return F.when(good, F.concat(char, F.regexp_replace(part, r"^(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});?", ""))).otherwise(F.concat(F.lit("&#"), part))

    parts = F.split(text, "&#")
    out = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))
    for name, char in _NAMED.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.regexp_replace(F.when(F.contains(text, F.lit("&")), out).otherwise(text), rf"^{_SPACE}+|{_SPACE}+$", "")


def _without_dots(path: Column) -> Column:
    """A path with its . and .. segments resolved."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 20)
    last = F.element_at(parts, -1)
    done = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == ".", acc).otherwise(F.concat(acc, F.array(p))),
    )
    joined = F.concat(F.lit("/"), F.array_join(done, "/"), F.when(last.isin(".", "..") & (F.size(done) > 0), "/").otherwise(""))
    return F.when(path.rlike(r"/\.{1,2}(?:/|$)"), joined).otherwise(path)


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (src, dst) of node names: canonical links and refresh redirects found in the pages.

    ``rel`` is a list of words and may hold others; attribute values are decoded (numeric and
    the common named character references). A target may be absolute, start with ``//``, ``/``, ``?``
    or ``#``, or be relative to the page's folder, with ``.`` and ``..`` segments; <base> is not
    read. Null urls and pages give no edges.
    """
    html = F.col(html_col)
    marked = pages.where(html.rlike("(?i)canonical|http-equiv")).select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = with_parts(marked, "url").where("node <> ''")
    tags = F.expr(r"regexp_extract_all(html, '(?is)<(?:link|meta)[ \\t\\n\\x0c\\r/][^>]*>', 0)")
    each = found.select(F.col("node").alias("src"), "host", "path", F.regexp_extract("node", r"(\?.*)$", 1).alias("query"), F.explode(tags).alias("tag"))
    names = {"rel": "rel", "href": "href", "equiv": "http-equiv", "content": "content"}
    place = ("src", "host", "path", "query")
    # written step by step (few rows): one plan would repeat each value wherever it is read
    read = written(each.select(*place, (F.lower(F.substring("tag", 2, 4)) == "link").alias("is_link"), *[_attribute(F.col("tag"), n).alias(k) for k, n in names.items()]), "url-tags")
    clean = written(read.select(*place, "is_link", *[_decoded(F.col(k)).alias(k) for k in names]), "url-values")
    words = F.split(F.lower(F.regexp_replace("rel", _SPACE, " ")), " ")
    after = r"""(?is)^[^;,]*[;,]\s*url\s*=\s*(?:"([^"]*)|'([^']*)|([^"'].*))"""
    refresh = F.concat(*[F.coalesce(F.regexp_extract("content", after, k), F.lit("")) for k in (1, 2, 3)])
    target = F.when(F.col("is_link") & F.array_contains(words, "canonical"), F.col("href")).when(~F.col("is_link") & (F.lower("equiv") == "refresh"), F.trim(refresh))
    raw = written(clean.select(*place, target.alias("t")), "url-targets").where("t <> ''")
    t, folder = F.col("t"), F.coalesce(F.nullif(F.regexp_extract("path", r"^(.*/)", 1), F.lit("")), F.lit("/"))
    place = F.concat(F.lit("x://"), F.col("host"))
    t_path = F.regexp_extract("t", r"^([^?#]*)", 1)
    full = (
        F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when(t.startswith("//"), F.concat(F.lit("x:"), t))
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(""))  # mailto: and the like
        .when(t.startswith("?"), F.concat(place, "path", t))
        .when(t.startswith("#"), F.concat(place, "path", "query"))
        .otherwise(F.concat(place, _without_dots(F.when(t.startswith("/"), t_path).otherwise(F.concat(folder, t_path))), F.regexp_extract("t", r"^[^?#]*(.*)", 1)))
    )
    ends = with_parts(raw.select("src", full.alias("target")), "target")
    return ends.where("node <> ''").select("src", F.col("node").alias("dst")).distinct()


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame | None = None, url_col: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to the rows of ``pages`` (its other columns stay).

    Null urls and urls without ``://`` have empty host and path, no rule and verdict allow.
    ``edges`` (src, dst) are node names as :func:`link_edges` returns them; an end that is no
    page counts with its own rule. Columns of ``pages`` named like a result are replaced.
    """
    added = ("host", "path", "rule", "verdict", "node", "ruled")
    keep = [c for c in pages.columns if c not in added]
    judged = with_rules(with_parts(pages.select(*[F.col(f"`{c}`") for c in keep]), url_col), rules)
    by_class = F.lit("allow")
    if edges is not None:
        edges = written(edges, "url-edges")
        if not edges.isEmpty():
            member = connected_components(edges, "src", "dst")
            ends = with_rules(with_parts(member.withColumn("__u", F.concat(F.lit("x://"), F.col("node"))).drop("node"), "__u"), rules)
            blocked = ends.groupBy("component").agg(F.max(F.col("ruled").eqNullSafe("block")).alias("b"), F.max(F.col("ruled").eqNullSafe("allow")).alias("a")).where("b and not a")
            aliases = member.join(blocked, "component").select(F.col("node").alias("__node"), F.lit("block").alias("__class"))
            judged = judged.join(aliases, F.col("node") == F.col("__node"), "left")
            by_class = F.coalesce("__class", F.lit("allow"))
    return judged.select(*[F.col(f"`{c}`") for c in keep], "host", "path", "rule", F.coalesce("ruled", by_class).alias("verdict"))
