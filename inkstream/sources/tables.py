"""CSV with header ranges, contact tables, cards, mail, outlines, statements, and the decoding of bytes."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import json
import re
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.sources.arrow import parse_column

# cells may be as long as texts are; the module's own limit is 131,072 characters
csv.field_size_limit(1 << 31)

#: Headers of contact tables by the card field they fill (fixed values), in the order of common mail programs.
CONTACT_HEADERS = {
    "first name": "n.given-name", "given name": "n.given-name", "middle name": "n.additional-name", "additional name": "n.additional-name", "last name": "n.family-name", "family name": "n.family-name",
    "name": "fn", "display name": "fn", "nickname": "nickname", "title": "title", "job title": "title", "company": "org.organization-name", "organization": "org.organization-name", "department": "org.organization-unit",
    "e-mail": "email", "email": "email", "e-mail address": "email", "email address": "email", "primary email": "email", "e-mail 1 - value": "email", "secondary email": "email.home",
    "home phone": "tel.home", "business phone": "tel.work", "work phone": "tel.work", "mobile phone": "tel.cell", "mobile number": "tel.cell", "phone": "tel", "phone 1 - value": "tel", "fax number": "tel.fax", "business fax": "tel.work.fax",
    "home street": "adr.home.street-address", "home address": "adr.home.street-address", "home city": "adr.home.locality", "home state": "adr.home.region", "home postal code": "adr.home.postal-code", "home country": "adr.home.country-name",
    "business street": "adr.work.street-address", "work address": "adr.work.street-address", "business city": "adr.work.locality", "business state": "adr.work.region", "business postal code": "adr.work.postal-code", "business country": "adr.work.country-name",
    "web page": "url", "birthday": "bday", "notes": "note",
}


def table_rows(text: str, header: tuple[int, int] | None = (0, 0), skip: int = 0, most: int = -1) -> list[dict[str, str]]:
    """Rows of a CSV text. The header is a range of lines, of which the first non-empty cell of a column names it;
    columns without a name are C0, C1 and so on. skip counts lines after the header."""
    lines = list(csv.reader(io.StringIO(text)))
    heads = lines[header[0] : header[1] + 1] if header else []
    body = lines[(header[1] + 1 if header else 0) + skip :]
    width = max(map(len, lines), default=0)
    names = [next((h[i].strip() for h in heads if i < len(h) and h[i].strip()), f"C{i}") for i in range(width)]
    rows = [dict(zip(names, r, strict=False)) for r in body if r]
    return rows[:most] if most >= 0 else rows


def contact_rows(text: str) -> list[dict[str, str]]:
    """Contacts of a table as card fields; without a header the cell with an @ is the email, the first other the name."""
    lines = [r for r in csv.reader(io.StringIO(text)) if any(c.strip() for c in r)]
    if not lines:
        return []
    names = [CONTACT_HEADERS.get(c.strip().lower()) for c in lines[0]]
    out = []
    if any(names):
        for r in lines[1:]:
            card: dict[str, str] = {}
            for n, v in zip(names, r, strict=False):
                if n and v.strip():
                    card.setdefault(n, v.strip())
            out.append(card)
    else:
        for r in lines:
            mail = next((c.strip() for c in r if "@" in c), "")
            name = next((c.strip() for c in r if c.strip() and "@" not in c), "")
            out.append({k: v for k, v in (("fn", name), ("email", mail)) if v})
    for card in out:
        if "fn" not in card and (full := " ".join(card[k] for k in ("n.given-name", "n.additional-name", "n.family-name") if k in card)):
            card["fn"] = full
    return [c for c in out if c]


def cards(text: str) -> list[dict[str, str]]:
    """vCards of a text as card fields with dotted names; folded lines are joined, values unescaped."""
    out: list[dict[str, str]] = []
    parts = {"adr": "post-office-box extended-address street-address locality region postal-code country-name".split(), "n": "family-name given-name additional-name honorific-prefix honorific-suffix".split(), "org": "organization-name organization-unit".split()}
    card: dict[str, str] | None = None
    for line in re.sub(r"\r?\n[ \t]", "", text).splitlines():
        head, _, value = line.partition(":")
        name, *options = head.split(";")
        name = name.rsplit(".", 1)[-1].lower()
        if name == "begin" and value.strip().lower() == "vcard":
            card = {}
        elif name == "end" and card is not None:
            out.append(card)
            card = None
        elif card is not None and name != "version":
            kinds = sorted(k.lower() for o in options for k in re.sub("^type=", "", o, flags=re.I).split(",") if "=" not in k and k.lower() not in ("internet", "pref"))
            unescape = lambda v: re.sub(r"\\(.)", lambda m: "\n" if m[1] in "nN" else m[1], v)
            if name in parts:
                for p, v in zip(parts[name], re.split(r"(?<!\\);", value), strict=False):
                    if v.strip():
                        card.setdefault(".".join([name, *kinds, p]), unescape(v.strip()))
            elif value.strip():
                card.setdefault(".".join([name, *kinds]), unescape(value.strip()))
    return out


def mail(text: str) -> dict:
    """A message's headers, text, html and names of attachments."""
    m = email.message_from_string(text, policy=email.policy.default)
    body = {"plain": "", "html": ""}
    attached = []
    for part in m.walk():
        if part.get_filename():
            attached.append(part.get_filename())
        elif part.get_content_maintype() == "text" and part.get_content_subtype() in body and not body[part.get_content_subtype()]:
            try:
                body[part.get_content_subtype()] = part.get_content().strip()
            except LookupError:  # a charset that nobody knows
                body[part.get_content_subtype()] = decoded(part.get_payload(decode=True) or b"").strip()
    return {"subject": str(m["subject"] or ""), "sender": str(m["from"] or ""), "recipients": [a.strip() for a in str(m["to"] or "").split(",") if a.strip()], "sent": str(m["date"] or ""), "text": body["plain"], "html": body["html"], "attachments": attached}


def outline(text: str, leaves_only: bool = False) -> list[dict]:
    """An OPML document flattened in order: title, address, titles above as tags, depth, number of children."""
    out: list[dict] = []

    def visit(e: ElementTree.Element, above: list[str]) -> None:
        below = e.findall("outline")
        name = e.get("title") or e.get("text") or ""
        if not (leaves_only and below):
            out.append({"title": name, "uri": e.get("htmlUrl") or e.get("url") or e.get("xmlUrl") or "", "feed": e.get("xmlUrl") or "", "tags": list(above), "depth": len(above), "children": len(below)})
        for b in below:
            visit(b, [*above, name])

    try:
        body = ElementTree.fromstring(text.strip().encode()).find("body")
    except ElementTree.ParseError:
        return []
    for e in body.findall("outline") if body is not None else []:
        visit(e, [])
    return out


def statements(text: str) -> list[dict]:
    """Statements `command word:json ...;` with # comments and triple-quoted texts, as command and arguments in JSON."""
    token = re.compile(r'\s+|#[^\n]*|("""(?:.|\n)*?""")|("(?:\\.|[^"\\])*")|([\[{](?:[^;"]|"(?:\\.|[^"\\])*")*[\]}])|([^\s:;"#]+)|([:;])')
    out, command, arguments, key, waiting, at = [], "", {}, "", False, 0
    while at < len(text):
        m = token.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at : at + 20]!r}")
        at = m.end()
        triple, quoted, nested, word, mark = m.groups()
        if mark == ";":
            out.append({"command": command, "arguments": json.dumps(arguments, sort_keys=True)})
            command, arguments, key, waiting = "", {}, "", False
        elif mark == ":":
            waiting = True
        elif any((triple, quoted, nested, word)):
            if waiting:
                value = triple[3:-3] if triple else json.loads(quoted or nested) if quoted or nested else _plain(word)
                arguments[key], waiting = value, False
            elif not command:
                command = word or ""
            else:
                key = word or json.loads(quoted or '""')
    return out


def _plain(word: str) -> object:
    try:
        return json.loads(word)
    except ValueError:
        return word


def decoded(raw: bytes, said: str | None = None) -> str:
    """Text of bytes: by byte order mark, by the page's own declaration, as told, as UTF-8, else as Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    meta = re.search(rb"""<meta[^>]+charset\s*=\s*["']?([\w-]+)""", raw[:1024], re.I) or re.match(rb"""<\?xml[^>]+encoding=["']([\w-]+)""", raw)
    for name in (meta[1].decode() if meta else None, said, "utf-8"):
        if name:
            try:
                return raw.decode("windows-1252" if name.lower() in ("iso-8859-1", "latin-1", "latin1") else name)
            except (LookupError, UnicodeError):
                continue
    return raw.decode("windows-1252", "replace")


_MAP = "array<map<string,string>>"


def read_tables(df: DataFrame, column: str, header: tuple[int, int] | None = (0, 0), skip: int = 0, most: int = -1) -> DataFrame:
    """df with rows: array of maps, for small CSV texts held in a column; whole files go through Spark's own reader."""
    return parse_column(df, column, lambda t: table_rows(t, header, skip, most), "rows", _MAP)


def read_contacts(df: DataFrame, column: str) -> DataFrame:
    return parse_column(df, column, contact_rows, "contacts", _MAP)


def read_cards(df: DataFrame, column: str) -> DataFrame:
    return parse_column(df, column, cards, "cards", _MAP)


def read_mail(df: DataFrame, column: str) -> DataFrame:
    return parse_column(df, column, mail, "mail", "struct<subject:string,sender:string,recipients:array<string>,sent:string,text:string,html:string,attachments:array<string>>")


def read_outlines(df: DataFrame, column: str, leaves_only: bool = False) -> DataFrame:
    return parse_column(df, column, lambda t: outline(t, leaves_only), "outlines", "array<struct<title:string,uri:string,feed:string,tags:array<string>,depth:int,children:int>>")


def read_statements(df: DataFrame, column: str, error: str | None = None) -> DataFrame:
    """df with statements; null, and the reason in the column `error`, where a text cannot be read."""
    return parse_column(df, column, statements, "statements", "array<struct<command:string,arguments:string>>", error)


def decode_bytes(df: DataFrame, column: str, said: str | None = None) -> DataFrame:
    return parse_column(df, column, lambda b: decoded(b, said), "decoded", "string")


def read_csv_files(spark, path: str, header: bool = True, skip: int = 0, most: int = -1) -> DataFrame:
    """CSV files by Spark's reader, all columns as text, unnamed ones as C0, C1 and so on."""
    df = spark.read.option("header", header).option("skipLines", skip).csv(path)
    df = df.toDF(*[c if header and not re.fullmatch(r"_c\d+", c) else f"C{i}" for i, c in enumerate(df.columns)])
    return df.limit(most) if most >= 0 else df




def dispatch(commands: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Rows (command, arguments) given to the handler of their command, and the handlers' rows together; handlers give the
    same columns. Commands without a handler are an error of the caller's to look for, with an anti-join, and give none."""
    given = [f(commands.filter(F.col("command") == name)) for name, f in handlers.items()]
    out = given[0]
    for more in given[1:]:
        out = out.unionByName(more)
    return out
