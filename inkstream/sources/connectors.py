"""Web connectors as data, over saved page payloads: where items and totals stand, how pages are named, what fields become.

There is no network code: payloads are a column, and page_uri gives the addresses from which they were saved.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from urllib.parse import urlencode
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkstream.sources.arrow import parse_column
from inkstream.sources.objects import READERS


@dataclass(frozen=True)
class Connector:
    """A service: payload kind, paths of items, of what holds for all of them, of totals; parameters; new names (new: old)
    and further steps over an item."""

    kind: str = "json"
    items: str | None = None
    meta: str = ""
    removes: frozenset[str] = frozenset()
    page: tuple[str, int] | None = None
    page_max: str = ""
    item_max: str = ""
    query: dict[str, object] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    renamed: dict[str, str] = field(default_factory=dict)
    steps: tuple[Callable[[dict], None], ...] = ()
    meta_steps: tuple[Callable[[dict], None], ...] = ()


def found(value: object, path: str) -> list:
    """What stands at a path, as a list; a list met on the way means its first element. The root of XML may be left out."""
    inner = next(iter(value.values())) if isinstance(value, dict) and len(value) == 1 else None
    for start in (value, inner):
        v = start
        for part in filter(None, path.split(".")):
            v = v[0] if isinstance(v, list) and v else v
            v = v.get(part) if isinstance(v, dict) else None
        if v is not None:
            return v if isinstance(v, list) else [v]
    return []


def _first(value: object, path: str) -> object:
    return next(iter(found(value, path)), None)


def point(latitude: str, longitude: str) -> Callable[[dict], None]:
    """Coordinates at two paths become georss:point, if both are numbers."""

    def step(item: dict) -> None:
        try:
            item["georss:point"] = [float(_first(item, latitude)), float(_first(item, longitude))]
        except (TypeError, ValueError):
            pass

    return step


def card(named: dict[str, str]) -> Callable[[dict], None]:
    """Values at paths become the fields of a card."""

    def step(item: dict) -> None:
        got = {new: str(v) for new, path in named.items() if (v := _first(item, path)) not in (None, "")}
        if got:
            item["hcard:hcard"] = got

    return step


def without(*keys: str) -> Callable[[dict], None]:
    def step(item: dict) -> None:
        for k in keys:
            item.pop(k, None)

    return step


def _place(item: dict) -> None:
    """A point of a geometry."""
    if _first(item, "geometry.type") == "Point" and len(found(item, "geometry.coordinates")) >= 2:
        point("lat", "lon")(at := dict(zip(("lat", "lon"), found(item, "geometry.coordinates"), strict=False)))
        item |= {k: v for k, v in at.items() if k == "georss:point"}
        item.pop("geometry")


def _posted(item: dict) -> None:
    """Time of a bookmark with its offset, words of its tag as categories."""
    if "time" in item:
        item["updated"] = str(item.pop("time")).rstrip("Z") + "+0000"
    if words := str(item.pop("tag", "")).split():
        item["category"] = [{"term": w} for w in words]


def _posts(meta: dict) -> None:
    tag = meta.pop("tag", None)
    if "user" in meta:
        meta["link"] = f"http://delicious.com/{meta['user']}/"
        meta["title"] = f"{meta.pop('user')}: {tag}"
    if "dt" in meta:
        meta["updated"] = str(meta.pop("dt")).rstrip("Z") + "+0000"


def _artist(item: dict) -> None:
    if images := [str(i).strip(">") for i in found(item, "image")]:
        item |= {"images": images, "photo": images[-1]}
    if content := _first(item, "bio.content"):
        item["content"] = content
        item.pop("bio")


def _merchant(item: dict) -> None:
    item["category"] = [{"term": t["name"]} for t in found(item, "tags.tag") if isinstance(t, dict) and "name" in t]
    if alternate := item.pop("short_url", None):
        item["links"] = [{"type": "text/html", "rel": "alternate", "href": alternate}]


def _grouped(name: str, keys: Iterable[str]) -> Callable[[dict], None]:
    def step(item: dict) -> None:
        if got := {k: item.pop(k) for k in keys if k in item}:
            item[name] = got

    return step


def _phones(item: dict) -> None:
    for phone in found(item, "phoneNumbers"):
        number, kind = _first(phone, "number"), _first(phone, "type")
        if number:
            use = "fax" if kind in ("fax", "data") else "mobile" if kind == "mobile" else "voice"
            item.setdefault("hcard:hcard", {})[f"tel.{use}" + (".work" if use != "mobile" else "")] = number


# Paths, parameters and field names of the services.
_ADDRESS = {"adr.work.country-name": "country", "adr.work.street-address": "streetAddress", "adr.work.locality": "city", "adr.work.region": "region", "photo": "staticMapUrl", "organization-name": "title", "geo.latitude": "lat", "geo.longitude": "lng"}
_MERCHANT = {
    "adr.work.country-name": "location.country.name", "adr.work.street-address": "location.streetAddress", "adr.work.locality": "location.city.name", "adr.work.region": "location.regions.province", "adr.work.postal-code": "location.postal_code",
    "tel.voice.work": "phone", "organization-name": "title", "geo.latitude": "location.latitude", "geo.longitude": "location.longitude",
}
_SEARCH_KEYS = ("ddUrl", "ddUrlFromHere", "ddUrlToHere", "addressLines", "accuracy", "listingType", "GsearchResultClass", "titleFormatted", "viewportmode")
_SEARCH = Connector(
    items="responseData.results", meta="responseData.cursor", page=("start", 8), query={"v": "1.0", "rsz": "large"}, required=("q",),
    renamed={"titleFormatted": "title", "title": "titleNoFormatting", "link": "url"}, steps=(_grouped("gsearch:gsearch", _SEARCH_KEYS),),
)
_BOOKMARKS = Connector("xml", "post", removes=frozenset(("post",)), renamed={"content": "extended", "title": "description", "link": "href", "id": "hash"}, steps=(_posted,), meta_steps=(_posts,))
_MUSIC = Connector("xml", page=("page", 1), renamed={"title": "name", "id": "mbid", "link": "url"}, steps=(_artist,))
CONNECTORS = {
    **{f"search.{kind}": _SEARCH for kind in ("web", "video", "blog", "news", "book", "image", "patentNew")},
    "search.local": replace(_SEARCH, steps=(*_SEARCH.steps, card(_ADDRESS), _phones, point("lat", "lng"), without("lat", "lng", "country", "streetAddress", "city", "region", "staticMapUrl", "phoneNumbers"))),
    **{f"bookmarks.{kind}": _BOOKMARKS for kind in ("recent", "dates", "all", "hashes", "get")},
    "bookmarks.list": replace(_BOOKMARKS, query={"count": 100}),
    **{f"music.{kind}": replace(_MUSIC, items=path, query={"method": f"artist.{method}"}) for kind, method, path in (
        ("events", "getevents", "events.event"), ("info", "getinfo", "artist"), ("similar", "getsimilar", "similarartists.artist"), ("tags", "gettags", "tags.tag"), ("albums", "gettopalbums", "topalbums.album"),
        ("fans", "gettopfans", "topfans.user"), ("toptags", "gettoptags", "toptags.tag"), ("tracks", "gettoptracks", "toptracks.track"),
    )},
    "music.search": replace(_MUSIC, items="artist", page_max="results.totalResults", query={"method": "artist.search"}),
    "products": Connector("xml", "Items.Item", "Items.Request", page=("ItemPage", 1), page_max="Items.TotalPages", item_max="Items.TotalResults", query={"Sort": "relevancerank", "Operation": "ItemSearch", "Version": "2008-08-19", "ResponseGroup": ["Small"]}),
    "merchants": Connector(
        items="community.merchants.merchant", meta="community", page=("page", 1), page_max="community.pagination.page_count", renamed={"title": "name", "id": "pid", "link": "permalink"},
        steps=(_merchant, point("location.latitude", "location.longitude"), card(_MERCHANT), without("tags", "tag_count", "location", "phone")),
    ),
    "location": Connector(items="user.location_hierarchy", meta="user.location_hierarchy", renamed={"title": "name"}, steps=(_place,), meta_steps=(_place,)),
    "subscriptions": Connector("xml", "subscription"),
    "feed_information": Connector("xml", required=("feed_hash",)),
    "user_information": Connector(items=""),
    "shortener": Connector(items="", query={"version": "2.0.1", "format": "json"}, required=("longUrl",)),
}


def _named(o: dict, c: Connector) -> dict:
    for new, old in c.renamed.items():
        if old in o:
            o[new] = o.pop(old)
    return o


def page_uri(base: str, parameters: dict[str, object], connector: str, page: int) -> str:
    """The address of a page (from 1): parameters without a value go, lists are comma-joined; the first has no number."""
    c = CONNECTORS[connector]
    given = {k: ",".join(map(str, v)) if isinstance(v, list | tuple) else v for k, v in (c.query | parameters).items() if v is not None}
    if c.page and page > 1:
        given[c.page[0]] = page * c.page[1]
    return f"{base}{'&' if '?' in base else '?'}{urlencode(given)}" if given else base


def missing(parameters: dict[str, object], connector: str) -> list[str]:
    """Parameters that a connector needs and that are not given."""
    return [k for k in CONNECTORS[connector].required if parameters.get(k) is None]


def _read(c: Connector, text: str) -> object:
    """A payload's object; None if it cannot be read. Attributes of XML have the names of fields."""
    try:
        return READERS[c.kind](text) if c.kind != "xml" else READERS["xml"](text, prefix="")
    except (ValueError, ElementTree.ParseError):
        return None


def items(payloads: DataFrame, column: str, connector: str, keys: list[str], page: str, page_limit: int = 3, item_limit: int = -1) -> DataFrame:
    """Items of saved page payloads: keys, page, index (from 0 over all pages of the keys) and the item as JSON text.
    Pages beyond the limit, or beyond the total that the first page tells, are not read; -1 is no limit."""
    c = CONNECTORS[connector]

    def parse(text: str) -> list[str]:
        whole = _read(c, text)
        listed = [] if whole is None or c.items is None else found(whole, c.items) if c.items else whole if isinstance(whole, list) else [whole]
        out = []
        for i in listed:
            if isinstance(i, dict):
                i = _named(dict(i), c)
                for step in c.steps:
                    step(i)
            if i is not None:
                out.append(json.dumps(i if isinstance(i, dict) else {"@": i}, ensure_ascii=False))
        return out

    some = payloads.select(*keys, F.col(page).alias("page"), F.col(column).alias("_payload"))
    some = some.filter(F.col("page") <= page_limit) if page_limit >= 0 else some
    if c.page_max or c.item_max:
        told = totals(payloads, column, connector, keys, page).withColumnsRenamed({k: f"_told_{k}" for k in keys})
        some = some.join(told, [F.col(k).eqNullSafe(F.col(f"_told_{k}")) for k in keys], "left").filter("coalesce(page_max, -1) < 0 or page <= greatest(page_max, 1)").select(*keys, "page", "_payload", "item_max")
    else:
        some = some.withColumn("item_max", F.lit(-1))
    flat = parse_column(some, "_payload", parse, "_items", "array<string>").select(*keys, "page", "item_max", F.posexplode("_items").alias("_pos", "item"))
    numbered = flat.withColumn("index", F.row_number().over(Window.partitionBy(*keys).orderBy("page", "_pos")) - 1)
    numbered = numbered.filter("coalesce(item_max, -1) < 0 or index < item_max")
    numbered = numbered.filter(F.col("index") < item_limit) if item_limit >= 0 else numbered
    return numbered.select(*keys, "page", "item", "index")


def totals(payloads: DataFrame, column: str, connector: str, keys: list[str], page: str) -> DataFrame:
    """What the first pages tell of the numbers of pages (else 1, where the service tells them) and items (else -1)."""
    c = CONNECTORS[connector]

    def number(whole: object, path: str, otherwise: int) -> int:
        try:
            return int(str(_first(whole, path))) if path else -1
        except ValueError:
            return otherwise

    def parse(text: str) -> list[int]:
        whole = _read(c, text)
        return [number(whole, c.page_max, 1), number(whole, c.item_max, -1)]

    first = payloads.filter(F.col(page) == 1).select(*keys, F.col(column).alias("_payload"))
    told = parse_column(first, "_payload", parse, "_n", "array<int>")
    return told.select(*keys, F.get("_n", F.lit(0)).alias("page_max"), F.get("_n", F.lit(1)).alias("item_max"))


def meta(payloads: DataFrame, column: str, connector: str, keys: list[str], page: str) -> DataFrame:
    """What the first pages say of all items, as JSON text: the part at the connector's path, without what it removes."""
    c = CONNECTORS[connector]

    def parse(text: str) -> str:
        whole = _read(c, text)
        part = _first(whole, c.meta) if c.meta else whole
        if isinstance(part, dict) and not c.meta and c.kind == "xml" and len(part) == 1 and isinstance(inner := next(iter(part.values())), dict):
            part = inner
        part = {k: v for k, v in part.items() if k not in c.removes} if isinstance(part, dict) else {}
        for step in c.meta_steps:
            step(part)
        return json.dumps(part, ensure_ascii=False)

    first = payloads.filter(F.col(page) == 1).select(*keys, F.col(column).alias("_payload"))
    return parse_column(first, "_payload", parse, "meta", "string").drop("_payload")


def with_details(listed: DataFrame, details: DataFrame, path: str, key: str) -> DataFrame:
    """Items with what a second service says of each, by the value at a JSON path of the item; details are (key, meta), and
    win. Items without the value go; items that the second service does not know stay as they are. Details have one row
    for each key."""
    keyed = listed.withColumn("_key", F.get_json_object("item", path)).filter("_key <> ''")
    joined = keyed.join(details.select(F.col(key).alias("_key"), F.col("meta").alias("_meta")), "_key", "left")
    both = joined.withColumn("_both", F.concat(F.lit("["), "item", F.lit(","), F.coalesce("_meta", F.lit("{}")), F.lit("]")))

    def merge(text: str) -> str:
        own, more = json.loads(text)
        return json.dumps(own | more, ensure_ascii=False)

    return parse_column(both.drop("item"), "_both", merge, "item", "string").select(*listed.columns)
