"""URL rules with redirect equivalence, in DataFrame operations only.

A rule is a host and a path. It fits its host and all subdomains if the url's path starts with the rule's; of
the rules that fit, the longest decides. Redirects and canonical links make urls aliases of each other: the
connected components of these edges carry a block from any member to the members that no rule fits. An explicit
allow takes precedence: it protects the url it fits, whatever its aliases are.

The host runs from after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path from
there up to ``?``, ``#`` or the end. A null url or one without ``://`` has an empty host and path, fits no rule
and is allowed. Targets of links are decoded (character references) and resolved against the page's url in any
form: absolute, or relative to its scheme, host, path or query. Links in comments, scripts, styles, templates and the like
don't count, nor does a tag with a ``<`` in it. Rows with the same url share a verdict; repeated rows are each reported. Pages of any length are searched
whole; a page without html or url has no links. Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import connected_components, cut

#: (verdict, host, path)
Rule = tuple[str, str, str]
#: Rules travel in the plan as one literal; a longer list belongs in a table.
MAX_RULES = 10_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?is)<link\b(?=[^<>]*\brel\s*=\s*[\"']?canonical\b)[^<>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^<>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^<>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"
#: What holds no links of the page: comments, scripts, styles and the like, to their end or that of the page.
_NO_LINKS = r"(?is)<!--.*?(?:-->|$)|<(script|style|template|noscript|textarea|title|xmp)\b.*?(?:</\1\b|$)"
_BASE = r"(?is)<base\b[^<>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
#: Character references as attributes have them: a name without its semicolon counts only where no = or letter follows.
_REFERENCE = r"(?s)(&#[0-9]++;?|&#[xX][0-9a-fA-F]++;?|&[a-zA-Z][a-zA-Z0-9]*+(?:;|(?![=a-zA-Z0-9]))|[^&]++|&)"
_NAMED = "\x02".join(f"&{name}\x01{text}" for name, text in html5.items())
#: Numbers from 128 to 159 mean the characters of Windows.
_C1 = [n for n in range(128, 160) if n not in (129, 141, 143, 144, 157)]
_C1_FROM, _C1_TO = "".join(map(chr, _C1)), bytes(_C1).decode("cp1252")


def host_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", ""))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", ""))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What identifies a url among aliases: host, path and query, without scheme and fragment; else null."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def decide(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits as struct(size, rule, verdict), or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    by_host: dict[str, list[Rule]] = {}
    for rule in rules:
        by_host.setdefault(rule[1], []).append(rule)
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    entry = lambda v, h, p: F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(p).alias("path"))
    table = F.create_map(*(x for h, own in by_host.items() for x in (F.lit(h), F.array(*(entry(*r) for r in own)))))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    of_host = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    fits = F.filter(of_host, lambda r: F.startswith(path, r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return best


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def decoded(value: Column) -> Column:
    """An attribute's value with its character references replaced."""
    names = F.str_to_map(F.lit(_NAMED), F.lit("\x02"), F.lit("\x01"))

    def one(piece: Column) -> Column:
        is_hex = F.lower(F.substring(piece, 3, 1)) == "x"
        digits = F.regexp_replace(piece, r"^&#[xX]?0*|;$", "")
        # eight digits are beyond any character already
        short = F.substring(F.when(digits == "", F.lit("0")).otherwise(digits), 1, 8)
        number = F.when(is_hex, F.conv(short, 16, 10)).otherwise(F.conv(short, 10, 10)).cast("long")
        valid = lambda n: (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
        code = _let(number, lambda n: F.when(valid(n), n).otherwise(F.lit(0xFFFD).cast("long")))
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(F.startswith(piece, F.lit("&#")) & (F.length(piece) > 2), F.translate(char, _C1_FROM, _C1_TO)).otherwise(
            F.coalesce(F.when(F.startswith(piece, F.lit("&")), F.try_element_at(names, piece)), piece)
        )

    pieces = F.transform(F.regexp_extract_all(value, F.lit(_REFERENCE), F.lit(1)), one)
    return F.when(F.contains(value, F.lit("&")), F.array_join(pieces, "")).otherwise(value)


def _without_dots(path: Column) -> Column:
    """A path that starts with a slash, with its segments ``.`` and ``..`` worked off."""
    none = F.array().cast("array<string>")
    step = lambda done, p: (
        F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(p == ".", done).otherwise(F.array_append(done, p))
    )

    def work(parts: Column) -> Column:
        end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
        return F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(parts, none, step), end), "/"))

    return F.when(path.rlike(r"/\.\.?(/|$)"), _let(F.split(F.substr(path, F.lit(2)), "/"), work)).otherwise(path)


def resolved(target: Column, base: Column) -> Column:
    """The full url that ``target`` means on a page at ``base``; null if it names no place (``mailto:`` and the like)."""
    base_scheme = F.coalesce(F.nullif(F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.lit("")), F.lit("http"))
    query = F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")

    def place(rest: Column) -> Column:
        own, tail = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1), F.regexp_extract(rest, r"(?s)^[^?#]*(.*)$", 1)
        whole = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), own))
        there = (
            F.when(own != "", F.concat(_let(whole, _without_dots), tail))
            .when(F.startswith(tail, F.lit("?")), F.concat(path_of(base), tail))
            .otherwise(F.concat(path_of(base), query, tail))
        )
        return F.when(F.startswith(rest, F.lit("//")), F.concat(base_scheme, F.lit(":"), rest)).when(
            host_of(base) != "", F.concat(base_scheme, F.lit("://"), host_of(base), there)
        )

    def full(target: Column) -> Column:
        scheme = F.regexp_extract(target, r"(?i)^([a-z][a-z0-9+.-]*):", 1)
        # "http:page" on a page of the same scheme is relative
        rest = F.when(scheme == "", target).when(F.lower(scheme) == F.lower(base_scheme), F.substr(target, F.length(scheme) + 2))
        return F.when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), target).otherwise(_let(rest, place))

    return _let(F.translate(F.trim(target), "\t\n\r", ""), full)


def alias_edges(pages: DataFrame) -> DataFrame:
    """Edges ``a, b`` between a page's url and the target of its canonical link or refresh, as nodes.

    Targets are decoded and resolved against the page's url, or against its ``<base>`` if it has one.
    """
    # few pages have any such element, so the others are not searched
    some = pages.select("url", "html").where(F.col("html").rlike(r"(?is)<link\b[^<>]*canonical|<meta\b[^<>]*refresh"))
    some = some.select("url", F.explode(F.array(F.regexp_replace("html", _NO_LINKS, " "))).alias("html"))
    targets = F.concat(*(F.regexp_extract_all(F.col("html"), F.lit(p), F.lit(1)) for p in (_LINK, _REFRESH)))
    found = some.select("url", F.regexp_extract("html", _BASE, 1).alias("base"), F.explode(targets).alias("target")).where(F.col("target") != "")
    url, base = F.col("url"), F.col("base")
    base = F.when(base != "", _let(base, lambda b: resolved(decoded(b), url)))
    full = _let(F.coalesce(base, url), lambda b: resolved(decoded(F.col("target")), b))
    # explode() of a one-element array makes Spark compute the target once instead of once per use
    found = found.select("url", F.explode(F.array(full)).alias("full"))
    return found.select(node_of(url).alias("a"), node_of(F.col("full")).alias("b")).where("a <> b")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], edges: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and ``alias_of``, the component's least node, for every page.

    ``edges`` (columns a, b of full urls) adds known redirects to the links found in the pages.
    """
    links = alias_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")))
    nodes = connected_components(links)
    # a node is host + path + query, so it parses as a url
    as_url = F.concat(F.lit("://"), F.col("node"))
    own = nodes.withColumn("own", decide(host_of(as_url), path_of(as_url), rules)["verdict"])
    blocked = own.groupBy("component").agg(F.max(F.coalesce(F.col("own") == "block", F.lit(False))).alias("blocked"))
    known = cut(nodes.join(cut(blocked), "component").select("node", F.col("component").alias("alias_of"), "blocked"))
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    rows = rows.withColumn("best", decide(F.col("host"), F.col("path"), rules))
    rows = rows.join(known, "node", "left")
    return rows.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(F.col("blocked"), "block"), F.lit("allow")).alias("verdict"),
        "alias_of",
    )
