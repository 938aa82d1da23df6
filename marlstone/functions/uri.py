"""URIs by RFC 3986, as expressions: parts, query items, normalisation, resolution, relative forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the pattern of RFC 3986, appendix B.
PATTERN = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#((?s:.*)))?"
PARTS = ("scheme", "authority", "path", "query", "fragment")


def parts(uri: Column) -> Column:
    """struct<scheme, authority, path, query, fragment>; what is absent is null, the path is never."""
    g = lambda i: F.regexp_extract(uri, PATTERN, i)
    opt = lambda whole, part: F.when(g(whole) != "", g(part))
    fields = [opt(1, 2), opt(3, 4), g(5), opt(6, 7), opt(8, 9)]
    return F.when(uri.isNotNull(), F.struct(*(f.alias(n) for n, f in zip(PARTS, fields, strict=True))))


def compose(scheme: Column, authority: Column, path: Column, query: Column, fragment: Column) -> Column:
    """A URI of its parts; null parts are left out."""
    lead = lambda mark, c: F.coalesce(F.concat(F.lit(mark), c), F.lit(""))
    return F.concat(F.coalesce(F.concat(scheme, F.lit(":")), F.lit("")), lead("//", authority), F.coalesce(path, F.lit("")), lead("?", query), lead("#", fragment))


def user_info(uri: Column) -> Column:
    found = F.regexp_extract(parts(uri)["authority"], r"^([^@]*)@", 1)
    return F.when(found != "", found)


def host(uri: Column) -> Column:
    found = F.regexp_extract(parts(uri)["authority"], r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1)
    return F.when(found != "", found)


def port(uri: Column) -> Column:
    return F.regexp_extract(parts(uri)["authority"], r":(\d+)\z", 1).try_cast("int")


def path_segments(uri: Column) -> Column:
    """Decoded segments of the path; a leading slash gives no empty segment."""
    path = F.regexp_replace(parts(uri)["path"], "^/", "")
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(path, "/"), percent_decode))


def query_items(uri: Column) -> Column:
    """array<struct<name, value>> of a query, in order; an item without = has a null value."""
    query = parts(uri)["query"]
    item = lambda s: F.struct(percent_decode(F.regexp_extract(s, "^([^=]*)", 1)).alias("name"), F.when(F.contains(s, F.lit("=")), percent_decode(F.regexp_extract(s, "=(.*)$", 1))).alias("value"))
    return F.when(query.isNull() | (query == ""), F.array().cast("array<struct<name:string,value:string>>")).otherwise(F.transform(F.split(query, "&"), item))


def query_item(uri: Column, name: str) -> Column:
    """Value of the first query item of a name."""
    return F.try_element_at(F.filter(query_items(uri), lambda i: i["name"] == name), F.lit(1))["value"]


def percent_encode(text: Column) -> Column:
    """Everything but unreserved characters as %XX of its UTF-8."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent_decode(text: Column) -> Column:
    """%XX decoded; a plus sign stays, and a text with a broken escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def remove_dot_segments(path: Column) -> Column:
    """RFC 3986, 5.2.4: a fold over the segments; `..` takes the one before away."""
    segments = F.split(path, "/")
    n = F.size(segments)
    absolute = path.startswith("/")
    last = F.element_at(segments, -1)
    start = F.array().cast("array<string>")
    drop = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(segments, start, lambda acc, s: F.when(s == "..", drop(acc)).when((s == ".") | (s == ""), acc).otherwise(F.array_append(acc, s)))
    folder = (n > 1) & last.isin("", ".", "..") | last.isin(".", "..")
    text = F.array_join(kept, "/")
    out = F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), text, F.when(folder & (text != ""), F.lit("/")).otherwise(F.lit("")))
    return F.when(path == "", F.lit("")).otherwise(out)


def normalized(uri: Column) -> Column:
    """Scheme and authority in lower case, dot segments and empty segments removed."""
    p = parts(uri)
    return compose(F.lower(p["scheme"]), F.lower(p["authority"]), remove_dot_segments(p["path"]), p["query"], p["fragment"])


def resolved(reference: Column, base: Column) -> Column:
    """A reference against a base, by RFC 3986, 5.2.2."""
    r, b = parts(reference), parts(base)
    own, placed, rooted, empty = r["scheme"].isNotNull(), r["authority"].isNotNull(), r["path"].startswith("/"), r["path"] == ""
    merged = F.when(b["authority"].isNotNull() & (b["path"] == ""), F.concat(F.lit("/"), r["path"])).otherwise(F.concat(F.regexp_extract(b["path"], r"^(.*/)?", 0), r["path"]))
    scheme = F.when(own, r["scheme"]).otherwise(b["scheme"])
    authority = F.when(own | placed, r["authority"]).otherwise(b["authority"])
    path = F.when(own | placed | rooted, remove_dot_segments(r["path"])).when(empty, b["path"]).otherwise(remove_dot_segments(merged))
    query = F.when(own | placed | ~empty | r["query"].isNotNull(), r["query"]).otherwise(b["query"])
    return compose(scheme, authority, path, query, r["fragment"])


def relative_to(uri: Column, base: Column) -> Column:
    """What resolves against base to uri: the rest behind their common folders, led by .. for each folder of base left over; uri itself if scheme or authority differ."""
    u, b = parts(uri), parts(base)
    same = u["scheme"].eqNullSafe(b["scheme"]) & u["authority"].eqNullSafe(b["authority"])
    ours, theirs = F.split(u["path"], "/"), F.split(b["path"], "/")
    folders = F.least(F.size(ours), F.size(theirs)) - 1
    common = F.aggregate(F.sequence(F.lit(1), F.greatest(folders, F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (i <= folders) & F.try_element_at(ours, i).eqNullSafe(F.try_element_at(theirs, i)), i).otherwise(n))
    up = F.size(theirs) - 1 - common
    rest = F.array_join(F.slice(ours, common + 1, F.greatest(F.size(ours) - common, F.lit(0))), "/")
    path = F.concat(F.repeat(F.lit("../"), up), rest)
    path = F.when(path == "", F.lit("./")).otherwise(path)
    return F.when(same, compose(F.lit(None).cast("string"), F.lit(None).cast("string"), path, u["query"], u["fragment"])).otherwise(uri)


def directory_path(uri: Column) -> Column:
    """The path up to and with its last slash."""
    return F.regexp_extract(parts(uri)["path"], r"^(.*/)?", 0)


def updating(uri: Column, **changes: Column) -> Column:
    """uri with other parts: scheme, authority, path, query or fragment."""
    p = parts(uri)
    return compose(*(changes.get(n, p[n]) for n in PARTS))


def removing(uri: Column, *names: str) -> Column:
    """uri without some of its parts."""
    return updating(uri, **{n: F.lit("" if n == "path" else None).cast("string") for n in names})


#: What may stand in a URI, and in an IRI besides.
_CHARS = r"(?:[A-Za-z0-9\-._~!$&'()*+,;=:@/?\[\]]|%[0-9A-Fa-f]{2})"
_ICHARS = r"(?:[A-Za-z0-9\-._~!$&'()*+,;=:@/?\[\]\x{A0}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFEF}\x{10000}-\x{EFFFD}]|%[0-9A-Fa-f]{2})"
_AUTHORITY = r"^(?:[^@\[\]]*@)?(?:\[(?:[0-9A-Fa-f:.]+|[vV][0-9A-Fa-f]+\.[A-Za-z0-9\-._~!$&'()*+,;=:]+)\]|[^:@\[\]]*)(?::\d*)?(?![\s\S])"


def is_reference(uri: Column, international: bool = False) -> Column:
    """Whether a text is a URI or relative reference (or IRI)."""
    chars = _ICHARS if international else _CHARS
    p = parts(uri)
    scheme = p["scheme"].isNull() | p["scheme"].rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*\z")
    authority = p["authority"].isNull() | p["authority"].rlike(_AUTHORITY)
    path = ~p["path"].rlike(r"[\[\]]") & (p["scheme"].isNotNull() | p["authority"].isNotNull() | ~F.regexp_extract(p["path"], "^[^/]*", 0).contains(":"))
    return F.coalesce(uri.rlike(rf"^{chars}*(?:#{chars}*)?\z") & scheme & authority & path & ~F.coalesce(p["query"].rlike(r"[\[\]]"), F.lit(False)), F.lit(False))


def is_uri(uri: Column, international: bool = False) -> Column:
    """Whether a text is an absolute URI (or IRI)."""
    return is_reference(uri, international) & F.coalesce(parts(uri)["scheme"].isNotNull(), F.lit(False))


def meets(uri: Column, *requirements: str) -> Column:
    """Whether a URI meets requirements: absolute, relative, fragment, no_fragment, normalized, percent_encoded."""
    p = parts(uri)
    tests = {
        "absolute": p["scheme"].isNotNull(),
        "relative": p["scheme"].isNull(),
        "fragment": p["fragment"].isNotNull(),
        "no_fragment": p["fragment"].isNull(),
        "normalized": uri == normalized(uri),
        "percent_encoded": is_reference(uri),
    }
    out = is_reference(uri, True)
    for r in requirements:
        out = out & tests[r]
    return F.coalesce(out, F.lit(False))


def diagnose(uri: Column) -> Column:
    """Why a text is no URI reference: a code, or null if it is one."""
    p = parts(uri)
    return (
        F.when(uri.isNull(), F.lit(None).cast("string"))
        .when(p["scheme"].isNotNull() & ~p["scheme"].rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*\z"), F.lit("invalid-scheme"))
        .when(uri.rlike(r"%(?![0-9A-Fa-f]{2})"), F.lit("invalid-percent-encoding"))
        .when(p["authority"].isNotNull() & ~p["authority"].rlike(_AUTHORITY), F.lit("invalid-authority"))
        .when(p["authority"].rlike(r":\d+\z") & (F.regexp_extract(p["authority"], r":(\d+)\z", 1).try_cast("bigint") > 65535), F.lit("invalid-port"))
        .when(~is_reference(uri, True), F.lit("invalid-character"))
    )
