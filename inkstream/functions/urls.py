"""URL functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings that trim takes off again and again, and canonical once (fixed values).
ENDINGS = ("index.html", "index.htm", "index.shtml", "index.jsp", "index.php", "/.", "/")
_ENDINGS = "(?i)(?:" + "|".join(e.replace(".", r"\.") for e in ENDINGS) + ")"
_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(c: Column, n: int) -> Column:
    return F.regexp_extract(c, _SPLIT, n)


def scheme(c: Column) -> Column:
    return F.lower(_part(c, 1))


def authority(c: Column) -> Column:
    return F.lower(_part(c, 2))


def host(c: Column, trim: bool = False, trim_top: bool = False) -> Column:
    """What stands before the first colon of the authority, in the case it is written in; trim takes off one www. or
    rss., trim_top the last label."""
    h = F.regexp_replace(_part(c, 2), ":.*$", "")
    h = F.regexp_replace(h, r"^(?:www|rss)\.", "") if trim else h
    return F.regexp_replace(h, r"\.[^.]*$", "") if trim_top else h


def path(c: Column) -> Column:
    return _part(c, 3)


def query(c: Column) -> Column:
    return _part(c, 4)


def fragment(c: Column) -> Column:
    return _part(c, 5)


def no_fragment(c: Column) -> Column:
    return F.regexp_replace(c, "#.*$", "")


def extension(c: Column) -> Column:
    """Lower-case extension of the path's last part, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(path(c), r"\.([A-Za-z0-9]+)$", 1))


def trim(c: Column, fragment: bool = True, query: bool = True) -> Column:
    """Without white space around it, http://, www. and then, again and again, ENDINGS; on request also without what
    follows the last # and the last ?. Null is the empty text."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), "^http://", ""), r"^www\.", "")
    bare = F.regexp_replace(bare, _ENDINGS + r"++\z", "")
    bare = bare if fragment else F.regexp_replace(bare, "#[^#]*$", "")
    bare = bare if query else F.regexp_replace(bare, r"\?[^?]*$", "")
    return F.coalesce(bare, F.lit(""))


def normal_path(c: Column) -> Column:
    """A path without empty and . steps, and .. steps taken; two opening slashes (not three) stay."""
    step = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.regexp_replace(done, "/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), x))
    walked = F.aggregate(F.split(c, "/"), F.lit(""), step)
    whole = F.when(walked == "", "/").otherwise(walked)
    # most paths are normal but for a closing slash, which takes no walk over their steps
    short = F.when(c.rlike(r"//|/\.\.?(?:/|\z)"), whole).when(c == "/", c).otherwise(F.regexp_replace(c, r"/\z", ""))
    return F.when(c.rlike("^//(?!/)"), F.concat(F.lit("/"), whole)).otherwise(short)


def canonical(c: Column, keep_fragment: bool = False) -> Column:
    """For comparisons: scheme and host in lower case, without :80, www. and parameters, with a normal path without one
    of ENDINGS, and with the query; other schemes than http and https stay as they are."""
    place = F.regexp_replace(F.regexp_replace(authority(c), ":80$", ""), r"^www\.", "")
    tidy = F.replace(normal_path(F.regexp_replace(path(c), ";[^/]*$", "")), F.lit("\\"), F.lit("/"))
    tidy = F.regexp_replace(tidy, _ENDINGS + r"\z", "")
    tidy = F.when((tidy != "") & ~tidy.startswith("/"), F.concat(F.lit("/"), tidy)).otherwise(tidy)
    asked = F.when(query(c) != "", F.concat(F.lit("?"), query(c))).otherwise("")
    parts = [scheme(c), F.lit("://"), place, tidy, asked]
    if keep_fragment:
        parts.append(F.when(fragment(c) != "", F.concat(F.lit("#"), fragment(c))).otherwise(""))
    return F.when(scheme(c).isin("http", "https"), F.concat(*parts)).otherwise(c)


def normalize(c: Column) -> Column:
    """feed: prefixes become http:, scheme and host are in lower case, :80 goes, as do a question mark and a hash with
    nothing behind them; nothing is added."""
    c = F.regexp_replace(F.regexp_replace(F.trim(c), "^feed://https?//", "http://"), "^feed:", "http:")
    c = F.regexp_replace(F.regexp_replace(c, r"#\z", ""), r"\?(#|\z)", "$1")
    head = F.regexp_extract(c, r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?)", 1)
    return F.concat(F.regexp_replace(F.lower(head), r"^([a-z0-9+.-]*:?//.*):80\z", "$1"), F.substring(c, F.length(head) + 1, F.length(c)))


def absolutise(link: Column, page: Column) -> Column:
    """The crawl's own rule, not that of the URL standard: http:// stays, a root path goes behind the page's host,
    anything else (https too) is appended to the page's URL; no link means the page itself."""
    root = F.concat(F.lit("http://"), authority(page), link)
    return F.when(link.isNull(), page).when(link.rlike("^http://"), link).when(link.rlike("^/"), root).otherwise(F.concat(page, link))


def join(base: Column, link: Column) -> Column:
    """A link as seen from a page: without scheme, host or path it takes those of the page; dots in paths are settled."""
    scheme, rest = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_replace(base, "[?#].*$", "")
    root = F.regexp_extract(rest, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    folder = F.regexp_replace(F.substring(rest, F.length(root) + 1, F.length(rest)), "[^/]*$", "")
    path, after = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    parts = F.split(F.substring(whole, F.lit(2), F.length(whole)), "/")
    last = F.element_at(parts, -1)
    none = F.array().cast("array<string>")
    walked = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), none, lambda up, x: F.when(x == ".", up).when(x == "..", F.slice(up, 1, F.greatest(F.size(up) - 1, F.lit(0)))).otherwise(F.array_append(up, x)))
    ended = F.when(last == ".", F.array_append(walked, F.lit(""))).when(last == "..", F.array_append(F.slice(walked, 1, F.greatest(F.size(walked) - 1, F.lit(0))), F.lit(""))).otherwise(F.array_append(walked, last))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link == "", base)
        .when(link.startswith("?"), F.concat(rest, link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .otherwise(F.concat(root, F.lit("/"), F.array_join(ended, "/"), after))
    )


def home(c: Column) -> Column:
    """Where a site seems to begin: at ~user, or above archives; null if the address gives nothing away."""
    root, path = F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    marked = F.transform(parts, lambda x, i: F.when(x.startswith("~"), i + 1).when(x == "archives", i))
    first = F.get(F.filter(marked, lambda x: x.isNotNull()), F.lit(0))
    return F.when(first.isNotNull(), F.concat(root, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), first), "/")))


def fingerprint(*values: Column) -> Column:
    """MD5 of canonical URLs with their fragments (and other values as they are) one after another."""
    return F.md5(F.concat(*[F.when(v.rlike("^(?i)https?://"), canonical(v, keep_fragment=True)).otherwise(v) for v in values]))


def is_quoted(c: Column) -> Column:
    return c.rlike("%[0-9a-fA-F]{2}")


def unquote(c: Column) -> Column:
    """Percent-decoded, doubly quoted percent signs first."""
    plain = F.replace(F.regexp_replace(c, "%25(?=[0-9a-fA-F]{2})", "%"), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(plain), c)


def tag_name(href: Column, text: Column | None = None) -> Column:
    """Name of a tag link: the unquoted last part of its path; else its text."""
    last = unquote(F.element_at(F.split(F.regexp_replace(no_fragment(href), "/+$", ""), "/"), -1))
    return last if text is None else F.coalesce(F.when(last != "", last), text)


#: Extensions of files that are no feeds, whatever their names say (fixed values).
NO_FEEDS = ("gif", "png", "jpg", "jpeg", "html", "htm", "shtml", "gz", "tgz", "zip", "txt", "pdf", "doc", "docx", "swf", "xls", "xlsx", "ppt", "pptx")


def is_feed_link(c: Column) -> Column:
    """Whether the last four characters are the extension of a feed."""
    return F.lower(F.right(c, F.lit(4))).isin(".rss", ".rdf", ".xml")


def is_xml_related(c: Column) -> Column:
    """Whether the last part of a link speaks of rss, rdf or xml and is no file of another kind."""
    name = F.lower(F.regexp_extract(c, "([^/]*)$", 1))
    return name.rlike("rss|rdf|xml") & ~name.rlike(rf"^\.*[^.].*\.({'|'.join(NO_FEEDS)})$")


def is_local_link(c: Column, base: Column) -> Column:
    """Whether a link lies below the base, in whatever case."""
    return F.startswith(F.lower(c), F.lower(base))


def is_burner_link(c: Column) -> Column:
    """Whether a link is one of the well-known feed proxy (fixed value)."""
    return c.startswith("http://feeds.feedburner.com/")


def query_string(parameters: dict[str, Column]) -> Column:
    """name=value pairs in order; nulls are left out and arrays come comma-joined by the caller."""
    from inkstream.functions.text import url_quote

    return F.concat_ws("&", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), url_quote(v))) for k, v in parameters.items()])
