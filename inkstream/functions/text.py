"""Text functions as Columns: template filters, slugs, tag stripping and HTML scrubbing. All run inside Catalyst."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: HTML escapes in the order they are applied (fixed values).
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;"))
#: Inline tags that scrub_html drops without a line break (fixed values).
INLINE_TAGS = "a|abbr|acronym|b|big|cite|code|em|font|i|q|s|small|span|strike|strong|sub|sup|tt|u"


def _squeeze(c: Column, mark: str) -> Column:
    joined = F.regexp_replace(c, "[^a-zA-Z0-9]+", mark)
    return F.lower(F.regexp_replace(joined, f"^{mark}+|{mark}+$", ""))


def slug(c: Column) -> Column:
    """Runs of other than letters and digits become one hyphen; none at the ends; lower case."""
    return _squeeze(c, "-")


def jslug(c: Column) -> Column:
    """As slug, with underscores, so that the result is an identifier."""
    return _squeeze(c, "_")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def capwords(c: Column) -> Column:
    """White space collapsed, every word with a capital and the rest in lower case."""
    return F.initcap(collapse_spaces(c))


def strip(c: Column, chars: str | None = None) -> Column:
    """Without leading and trailing characters of the set; white space if none is given."""
    return rstrip(lstrip(c, chars), chars)


def _char_class(chars: str | None) -> str:
    return r"\s" if chars is None else "[" + "".join("\\" + x if not x.isalnum() and ord(x) < 128 else x for x in chars) + "]"


def lstrip(c: Column, chars: str | None = None) -> Column:
    return F.regexp_replace(c, f"^{_char_class(chars)}+", "")


def rstrip(c: Column, chars: str | None = None) -> Column:
    return F.regexp_replace(c, f"{_char_class(chars)}+$", "")


def split(c: Column, sep: str | None = None) -> Column:
    """Parts between separators; without one, the words between runs of white space."""
    if sep is None:
        return F.filter(F.split(c, r"\s+"), lambda x: x != "")
    return F.split(c, "".join("\\" + x if not x.isalnum() and ord(x) < 128 else x for x in sep))


def at_index(array: Column, index: int = 0) -> Column:
    """Element by position from 0, or from the end if negative; null out of range."""
    return F.get(array, F.lit(index) if index >= 0 else F.size(array) + index)


def add(a: Column, b: Column) -> Column:
    """Sum of two integers as text."""
    return (a.try_cast("bigint") + b.try_cast("bigint")).cast("string")


def cut(c: Column, part: str) -> Column:
    """Without any occurrence of the part, also those that come to be when others go."""
    if not part:
        return c
    if len(part) == 1:
        return F.replace(c, F.lit(part), F.lit(""))
    rounds = F.sequence(F.lit(0), F.floor(F.length(c) / len(part)).cast("int"))
    return F.aggregate(rounds, c, lambda text, _: F.replace(text, F.lit(part), F.lit("")))


def default(c: Column, other: Column) -> Column:
    """The empty text stays; else what counts as false (null, 0, false) gives way to the other."""
    return F.when(c == "", c).when(c.isNull() | F.lower(c).isin("0", "false"), other).otherwise(c)


def otherwise(c: Column, other: Column) -> Column:
    """As default, where the empty text gives way too."""
    return F.when(c.isNull() | F.lower(c).isin("", "0", "false"), other).otherwise(c)


def default_if_none(c: Column, other: Column) -> Column:
    return F.coalesce(c, other)


def divisible_by(c: Column, n: int) -> Column:
    return c.cast("bigint") % n == 0


def join(array: Column, sep: str) -> Column:
    """Elements joined; null for an empty list."""
    return F.when(F.size(array) > 0, F.array_join(array, sep))


def length_is(c: Column, n: int) -> Column:
    return F.length(c) == n


def pluralize(n: Column, suffixes: str = "s") -> Column:
    """The plural suffix unless n is 1; 'y,ies' gives both, 's' only the plural."""
    one, _, many = suffixes.rpartition(",")
    return F.when(n.cast("double") == 1, F.lit(one)).otherwise(F.lit(many))


def url_quote(c: Column) -> Column:
    """Percent-encoded, blanks as %20 and slashes too."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def escape_html(c: Column) -> Column:
    for plain, escaped in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def escape_js(c: Column) -> Column:
    """The text as inside a JSON string, without the quotes."""
    whole = F.to_json(F.array(c))
    return F.substring(whole, F.lit(3), F.length(whole) - 4)


def line_breaks(c: Column) -> Column:
    """Paragraphs at blank lines, <br /> at single line breaks; escaped first."""
    paragraphs = F.regexp_replace(escape_html(c), r"\n\n+", "</p><p>")
    return F.concat(F.lit("<p>"), F.replace(paragraphs, F.lit("\n"), F.lit("<br />")), F.lit("</p>"))


def strip_tags(c: Column) -> Column:
    """Without tags that close on their own line."""
    return F.regexp_replace(c, "<.*?>", "")


def scrub_html(c: Column) -> Column:
    """Plain text: comments, scripts and event handlers go, inline tags vanish, other tags become line breaks, white
    space and blank lines collapse. Entities of the escapes are decoded last but the ampersand's."""
    c = F.regexp_replace(c, "(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, "(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", "")
    c = F.regexp_replace(c, r"\s+", " ")
    c = F.regexp_replace(c, f"(?i)</?({INLINE_TAGS})(\\s[^>]*)?/?>", "")
    c = F.regexp_replace(c, "<[^>]*>", "\n")
    for plain, escaped in reversed(ESCAPES):
        c = F.replace(c, F.lit(escaped), F.lit(plain))
    c = F.regexp_replace(c, r" *\n[ \n]*", "\n")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def unescape_html(c: Column) -> Column:
    """Character references, numeric and by the names of HTML 4, as the characters that they mean; others stay."""
    named = F.create_map(*[F.lit(x) for name, n in sorted(name2codepoint.items()) for x in (name, n)])
    # Each step binds what the next one uses more than once, so that the expression stays small.
    with_name = lambda p: F.named_struct(F.lit("text"), p, F.lit("name"), F.regexp_extract(p, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1))
    number = lambda name: F.when(name.rlike("^#[0-9]"), F.substring(name, 2, 7)).when(name.startswith("#"), F.conv(F.substring(name, 3, 6), 16, 10)).cast("int")
    with_number = lambda p: F.named_struct(F.lit("text"), p["text"], F.lit("n"), F.length(p["name"]), F.lit("code"), F.coalesce(number(p["name"]), F.try_element_at(named, p["name"])))
    fits = lambda code: F.coalesce(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.lit(False))
    letter = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    shown = lambda p: F.when(fits(p["code"]), F.concat(letter(p["code"]), F.substring(p["text"], p["n"] + 2, F.length(p["text"])))).otherwise(F.concat(F.lit("&"), p["text"]))
    pieces = F.slice(F.split(c, "&"), 2, 1 << 30)
    told = F.transform(F.transform(F.transform(pieces, with_name), with_number), shown)
    return F.when(~F.contains(c, F.lit("&")), c).otherwise(F.concat(F.substring_index(c, "&", 1), F.array_join(told, "")))


def to_entities(c: Column) -> Column:
    """Characters beyond ASCII as numeric references."""
    letters = F.split(c, "")
    return F.array_join(F.transform(letters, lambda x: F.when(F.ascii(x) > 127, F.concat(F.lit("&#"), F.ascii(x).cast("string"), F.lit(";"))).otherwise(x)), "")


def contains_all(query: Column, *fields: Column, ignore_case: bool = True) -> Column:
    """Whether every word of the query is part of some field; true for an empty query or no fields."""
    low = (lambda x: F.lower(x)) if ignore_case else (lambda x: x)
    if not fields:
        return F.lit(True)
    hay = F.array(*[F.coalesce(low(f), F.lit("")) for f in fields])
    return F.forall(split(low(F.coalesce(query, F.lit("")))), lambda word: F.exists(hay, lambda x: F.contains(x, word)))
