"""Operator 13, fill-in-middle transformation by escaped marker injection, in DataFrame functions alone.

A text is cut into units (lines by default). To cut it without an array of its units, a delimiter is put behind every
unit: the delimiter and the escape character are escaped first, so that what is injected is the only one left;
regexp_replace appends it to each unit; how much longer the text became is the number of units; substring_index takes
the first units, the last ones, or those between; each part is unescaped, and the parts are assembled around markers.

The places of the cuts, whether a text is transformed at all and the order of its parts come from a digest of a seed and
the key, so that they stay the same wherever and however often a row is computed. `restore` gives the text back from the
assembled form alone.

Null texts count as empty ones, and a null key as the empty one. Empty texts and texts that hold a marker stay as they
are (`plain`). Texts of any length are cut whole. Repeated rows give repeated rows, an empty table none; further columns
may have any names. No shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.llm.common import project

#: Units: a line with its line break; a word with the blanks behind it.
LINES, WORDS = r"[^\n]*\n|[^\n]+", r"\S+\s*|\s+"
#: Markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
_ESCAPE, _DELIMITER = "\x01", "\x02"


def escape(text: Column) -> Column:
    """The text without any delimiter; unescape takes it back."""
    once = F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "e"))
    return F.replace(once, F.lit(_DELIMITER), F.lit(_ESCAPE + "d"))


def unescape(part: Column) -> Column:
    once = F.replace(part, F.lit(_DELIMITER), F.lit(""))
    return F.replace(F.replace(once, F.lit(_ESCAPE + "d"), F.lit(_DELIMITER)), F.lit(_ESCAPE + "e"), F.lit(_ESCAPE))


def _ranked(marked: Column, count: Column) -> Column:
    """The first count units, or from the end for a negative one, with their delimiters but the last."""
    return F.call_function("substring_index", marked, F.lit(_DELIMITER), count.cast("int"))


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = LINES, seed: int = 7, rate: int = 100, spm: int = 50, markers: tuple[str, str, str] = MARKERS
) -> DataFrame:
    """key, n (units), form (`psm`, `spm` or `plain`), prefix, middle, suffix (null if plain), output.

    unit: a pattern whose matches, from left to right, make up every text. rate: percent of the texts that are
    transformed, spm: percent of those whose suffix comes first.
    """
    _distinct(markers)
    rows = project(df, key=key, text=text)
    rows = rows.select("key", F.coalesce(F.col("text"), F.lit("")).alias("text"), *[d.alias(f"h{i}") for i, d in enumerate(draws(F.col("key"), seed), 1)])
    rows = rows.withColumn("clean", escape(F.col("text")))
    rows = rows.withColumn("marked", F.regexp_replace("clean", f"(?:{unit})", "$0" + _DELIMITER))
    rows = rows.withColumn("n", (F.octet_length("marked") - F.octet_length("clean")).cast("long") / F.lit(len(_DELIMITER))).withColumn("n", F.col("n").cast("long"))
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    rows = rows.withColumn("low", F.least(*cuts)).withColumn("high", F.greatest(*cuts))
    held = F.lit(False)
    for m in markers:
        held = held | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | held | (F.col("h3") % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm"))
    rows = rows.withColumn("head", _ranked(F.col("marked"), F.col("high")))
    parts = {
        "prefix": _ranked(F.col("marked"), F.col("low")),
        "middle": _ranked(F.col("head"), F.col("low") - F.col("high")),
        "suffix": _ranked(F.col("marked"), F.col("high") - F.col("n") - 1),
    }
    cut = {name: F.when(F.col("form") != "plain", unescape(part)) for name, part in parts.items()}
    rows = rows.select("key", "n", "form", "text", *[c.alias(name) for name, c in cut.items()])
    p, s, m = (F.lit(x) for x in markers)
    psm = F.concat(p, "prefix", s, "suffix", m, "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    return rows.select(F.col("key").alias(key), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that gave the output: its parts, told apart by the markers, in their first order.

    No part holds a marker, and no marker begins where another one, or a text before it, could end in it.
    """
    _distinct(markers)
    p, s, m = markers
    middle = F.substring_index(output, m, -1)
    ahead = F.substring_index(output, m, 1)
    psm = F.concat(F.substring_index(F.substring_index(ahead, s, 1), p, -1), middle, F.substring_index(ahead, s, -1))
    spm = F.concat(F.substring_index(ahead, p, -1), middle, F.substring_index(F.substring_index(ahead, p, 1), s, -1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def _distinct(markers: tuple[str, str, str]) -> None:
    """Markers must be found again: none within another, and none that can overlap what stands before it."""
    if len(set(markers)) < 3 or any(a in b for a in markers for b in markers if a != b):
        raise ValueError(f"markers {markers!r} are not told apart")
    if any(not m or set(m[0]) & set(m[1:]) or any(m[0] in other[1:] for other in markers) for m in markers):
        raise ValueError(f"markers {markers!r} overlap themselves or each other")


def digest(found: DataFrame, key: str = "doc_id", markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """key, n, form, characters of prefix and middle, digests of the output and of the text restored from it."""
    sha = lambda c: F.sha2(c, 256)
    chars = [F.char_length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return found.select(key, "n", "form", *chars, sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"), markers)).alias("restored_sha256"))
