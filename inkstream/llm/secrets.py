"""Operator 9, secret scans weighed by corpus-wide ownership.

Base spans come from three patterns. Further candidates are long opaque strings: mixed letters and digits of high
entropy that base spans do not cover from end to end. The hashes of all candidate values are counted over the corpus by distinct owners
and repositories: a value of several owners, or of more than LIVE_REPOS repositories, is a widely copied example; any
other value looks live. Live opaque
strings are added as spans of kind `live`; base spans always stay.

Null and empty texts have no spans; texts of any length are read whole. A null owner is an owner of its own, as is a null
repository. Repeated rows are rows of their own, counted once as a repository. An empty table gives no rows; further
columns may have any names. Counting is pre-aggregated by (value, owner, repository), and what is known of values that
very many rows hold is broadcast to their rows, so a value found everywhere makes no large group.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.common import BROADCAST_ROWS, column_at, map_slices, project, settle, sized, strings

KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Every access and hex match, and every opaque string, lies within such a run.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX, LEAST_OPAQUE = 12, 18, 16, 24
LEAST_ENTROPY = 3.5
#: Owners a value may have and still look live.
LIVE_OWNERS = 1
#: Repositories a value may be in and still look live, whoever owns them.
LIVE_REPOS = 100
#: Repositories of a value beyond which its rows are not brought together by the value.
HOT_REPOS = 1_000
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def entropy(value: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _opaque(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= LEAST_ENTROPY


def _covered(a: int, b: int, spans: list[tuple[int, int, int, str]]) -> bool:
    """Whether the spans together hold every place from a to b."""
    for start, stop, _, _ in sorted(spans):
        if start > a:
            break
        a = max(a, stop)
    return a >= b


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind's number, value) of base matches and opaque strings, by start, then kind."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    for run in RUN.finditer(text):
        a, b = run.span()
        found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text, a, b) if len(m[0]) >= LEAST_ACCESS]
        found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text, a, b) if len(m[0]) >= LEAST_HEX]
        if b - a >= LEAST_OPAQUE and not _covered(a, b, found) and _opaque(run[0]):
            found.append((a, b, 3, run[0]))
    return sorted(found, key=lambda x: x[:3])


_SPAN = "array<struct<start:int,stop:int,kind:int,value:binary>>"


def _spans(text: str) -> list[dict]:
    return [{"start": a, "stop": b, "kind": k, "value": hashlib.sha256(v.encode()).digest()[:16]} for a, b, k, v in candidates(text)]


def _shared(found: DataFrame, most: int) -> DataFrame:
    """value: hashes that more than `most` owners or LIVE_REPOS repositories have, with n_owners and n_repos. found: spans, owner, repo."""
    one = found.select("owner", "repo", F.explode("spans.value").alias("value")).groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = one.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos")).filter((F.col("n_owners") > most) | (F.col("n_repos") > LIVE_REPOS))


def _judged(found: DataFrame, most: int) -> DataFrame:
    """_row, judged: each row's spans with whether the value is shared. found is a settled table with column _row."""
    shared = settle(_shared(found, most), "secret-values")
    flat = found.select("_row", F.explode("spans").alias("s")).select("_row", "s.*")
    mark = F.lit(True).alias("shared")
    if shared.count() <= BROADCAST_ROWS:
        known = flat.join(F.broadcast(shared.select("value", mark)), "value", "left")
    else:
        # hot values are few: each has over HOT_REPOS rows of the input; their rows stay where they are
        hot = sized(settle(shared.filter(F.col("n_repos") > HOT_REPOS).select("value", mark), "secret-hot-values"))
        near = flat.join(hot, "value", "left")
        rest = shared.filter(F.col("n_repos") <= HOT_REPOS).select("value", mark)
        known = near.filter("shared").unionByName(near.filter("shared is null").drop("shared").join(rest, "value", "left"))
    span = F.struct("start", "kind", "stop", F.coalesce("shared", F.lit(False)).alias("shared"))
    return known.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("judged"))


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id", live_owners: int = LIVE_OWNERS) -> DataFrame:
    """key, judged: array of (start, kind, stop, shared), sorted; shared opaque strings (kind 3) are left out."""
    rows = project(df, key=key, text=text, owner=owner, repo=repo)
    kinds = dict(rows.dtypes)

    def kernel(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(c) for c in ("key", "owner", "repo")} | {"spans": [_spans(t) for t in strings(batch.column("text"))]}

    found = map_slices(rows, kernel, f"key {kinds['key']}, owner {kinds['owner']}, repo {kinds['repo']}, spans {_SPAN}")
    found = settle(found.withColumn("_row", F.monotonically_increasing_id()), "secret-spans")
    judged = _judged(found, live_owners)
    kept = F.filter("judged", lambda s: (s["kind"] < 3) | ~s["shared"])
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,shared:boolean>>")
    return found.select("_row", "key").join(judged, "_row", "left").select(F.col("key").alias(key), F.coalesce(kept, none).alias("judged"))


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the base spans, all spans as text, what their owners say of each (`live` or `copied`),
    and how many values look live or are shared."""
    name = F.array(*map(F.lit, KINDS))
    words = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["stop"])), ",")
    base = F.filter("judged", lambda s: s["kind"] < 3)
    n = lambda test: F.size(F.filter("judged", test)).cast("long")
    return scanned.select(
        key,
        *[n(_of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(words(base), 256).alias("base_sha256"),
        words(F.col("judged")).alias("spans"),
        F.array_join(F.transform("judged", lambda s: F.when(s["shared"], "copied").otherwise("live")), ",").alias("verdicts"),
        n(lambda s: ~s["shared"]).alias("n_owner_specific"),
        n(lambda s: s["shared"]).alias("n_widely_copied"),
    )


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (start, stop, kind) as [kind]; overlapping spans go together under the first one's kind."""
    out, at, until = [], 0, -1
    for a, b, k in sorted(spans):
        if a < until:
            until = max(until, b)
            at = until
            continue
        out += [text[at:a], f"[{KINDS[k]}]"]
        at = until = b
    return "".join(out) + text[at:]


def mask_secrets(df: DataFrame, text: str = "text", owner: str = "source", repo: str = "doc_id", live_owners: int = LIVE_OWNERS, length: str | None = None) -> DataFrame:
    """The rows with base spans and live strings masked in the text; columns as given. The column `length`, if one is
    named, gets the masked text's length in characters.

    Texts without candidates pass straight through; only the others are written and meet the counts.
    """
    names = df.columns
    at = {k: column_at(names, v) for k, v in (("text", text), ("owner", owner), ("repo", repo))}
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    body, inner = f"_c{at['text']}", flat.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in flat.dtypes)

    def kernel(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(c) for c in batch.schema.names} | {"spans": [_spans(t) for t in strings(batch.column(body))]}

    found = map_slices(flat, kernel, f"{schema}, spans {_SPAN}", text=body)
    held = settle(found.filter(F.size("spans") > 0).withColumn("_row", F.monotonically_increasing_id()), "secret-texts")
    counted = held.select("_row", "spans", F.col(f"_c{at['owner']}").alias("owner"), F.col(f"_c{at['repo']}").alias("repo"))
    met = held.drop("spans").join(_judged(counted, live_owners), "_row").drop("_row")

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                mask(t, [(s["start"], s["stop"], s["kind"]) for s in spans if s["kind"] < 3 or not s["shared"]])
                for t, spans in zip(strings(batch.column(body)), batch.column("judged").to_pylist(), strict=True)
            ]
            columns = [pa.array(texts, batch.schema.field(body).type) if c == body else batch.column(c) for c in inner]
            yield pa.RecordBatch.from_arrays(columns, names=inner)

    clean = found.filter(F.size("spans") == 0).drop("spans")
    hidden = met.mapInArrow(hide, flat.schema)
    if length:
        n = f"_c{column_at(names, length)}"
        hidden = hidden.withColumn(n, F.length(body).cast(dict(flat.dtypes)[n]))
    return clean.unionByName(hidden).toDF(*names)
