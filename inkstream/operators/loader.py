"""Rules of a page loader, as joins of requests with what is cached and what servers answer; nothing is fetched here.

* A cached page younger than FRESH_S is used as it is; a cached failure of that age is a failure again.
* One older than STALE_S is as if it were not there. What is between is asked for with its ETag and date.
* `Not modified` keeps the cached page and renews its time. A failure in the presence of a cached page gives the cached
  page, whose time stays.
* Other failures are tried again, in all `retries` + 2 times if retries is not 0, else once; a page that is not found is
  cached as such at once, so that it is not asked for again.
* A page longer than `most` bytes is an error that is not cached, or with `soft` is cut there.

Texts of pages may be large, so they are carried along once. Requests and answers that repeat an address are taken one by
one: requests each have a row, of answers each has a number `attempt`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkstream.streaming.crawl import FRESH_S, STALE_S

NOT_FOUND, NOT_MODIFIED, OK = 404, 304, 200


def due(requests: DataFrame, cache: DataFrame, fresh_s: int = FRESH_S, stale_s: int = STALE_S) -> DataFrame:
    """Requests (url, at) with state (`fresh`, `check`, `none`) and the validators to send.

    cache: url (unique), status, etag, modified, body, saved_at. Columns of what may be used come as cached_*.
    """
    held = cache.select("url", *[F.col(c).alias(f"cached_{c}") for c in ("status", "etag", "modified", "body", "saved_at")])
    age = F.unix_timestamp("at") - F.unix_timestamp("cached_saved_at")
    state = F.when(F.col("cached_saved_at").isNull() | (age >= stale_s), "none").when(age < fresh_s, "fresh").otherwise("check")
    rows = requests.join(held, "url", "left").withColumn("state", state)
    for c in ("status", "etag", "modified", "body", "saved_at"):
        rows = rows.withColumn(f"cached_{c}", F.when(F.col("state") != "none", F.col(f"cached_{c}")))
    send = F.col("state") == "check"
    return rows.withColumns({"if_none_match": F.when(send, F.col("cached_etag")), "if_modified_since": F.when(send, F.col("cached_modified"))})


def load(requests: DataFrame, cache: DataFrame, answers: DataFrame, retries: int = 3, most: int = 10 << 20, soft: bool = False, fresh_s: int = FRESH_S, stale_s: int = STALE_S) -> DataFrame:
    """url, at, outcome, status, body, etag, modified, saved_at (what the cache is to hold; null: nothing new) and attempts.

    answers: url, attempt (from 0), status, etag, modified, body: what the server says when it is asked for the first time,
    the second time and so on. Outcomes: `fresh`, `failed before`, `unchanged`, `loaded`, `kept` (cached page in place of a
    failure), `not found`, `too big`, `failed`.
    """
    asked = due(requests, cache, fresh_s, stale_s)
    tries = retries + 2 if retries else 1
    # The first answer that settles a request without a cached page; with one, the first answer settles it anyway.
    w = Window.partitionBy("url").orderBy("attempt")
    final = F.col("status").isin(OK, NOT_FOUND)
    last = F.min(F.when(final, F.col("attempt"))).over(Window.partitionBy("url"))
    within = answers.filter(F.col("attempt") < tries).withColumns({"_last": last, "_n": F.row_number().over(w), "_of": F.count(F.lit(1)).over(Window.partitionBy("url"))})
    told = lambda kind, where: within.filter(where).select("url", *[F.col(c).alias(f"{kind}_{c}") for c in ("status", "etag", "modified", "body")], F.col("_n").alias(f"{kind}_n"))
    first = told("a", F.col("_n") == 1)
    end = told("z", F.coalesce(F.col("attempt") == F.col("_last"), F.col("_n") == F.col("_of")))
    check = asked.filter("state = 'check'").join(first, "url", "left").withColumnsRenamed({f"a_{c}": f"r_{c}" for c in ("status", "etag", "modified", "body", "n")})
    fetch = asked.filter("state = 'none'").join(end, "url", "left").withColumnsRenamed({f"z_{c}": f"r_{c}" for c in ("status", "etag", "modified", "body", "n")})
    fresh = asked.filter("state = 'fresh'")
    rows = check.unionByName(fetch).unionByName(fresh, allowMissingColumns=True)
    return rows.select("url", "at", *_settled(most, soft))


def _settled(most: int, soft: bool) -> list:
    status, size, state = F.col("r_status"), F.length("r_body"), F.col("state")
    outcome = (
        F.when((state == "fresh") & (F.col("cached_status") == OK), "fresh")
        .when(state == "fresh", "failed before")
        .when((status == OK) & (size > most) & F.lit(not soft), "too big")
        .when(status == OK, "loaded")
        .when((state == "check") & (status == NOT_MODIFIED), "unchanged")
        .when(state == "check", "kept")
        .when(status == NOT_FOUND, "not found")
        .otherwise("failed")
    )
    is_ = lambda *names: outcome.isin(*names)
    new = lambda c: F.when(is_("loaded"), F.col(f"r_{c}")).when(is_("fresh", "unchanged", "kept"), F.col(f"cached_{c}"))
    body = F.when(is_("loaded"), F.substring("r_body", 1, most)).when(is_("fresh", "unchanged", "kept"), F.col("cached_body"))
    said = F.when(is_("fresh", "failed before", "kept", "unchanged"), F.col("cached_status")).when(is_("too big"), F.lit(None)).otherwise(F.coalesce(status, F.lit(500)))
    return [
        outcome.alias("outcome"), said.alias("status"), body.alias("body"), new("etag").alias("etag"), new("modified").alias("modified"),
        F.when(is_("loaded", "unchanged", "not found"), F.col("at")).alias("saved_at"), F.coalesce("r_n", F.lit(0)).alias("attempts"),
    ]


def cache_after(cache: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The cache with what the outcomes put there: of an address the latest; pages not found have an empty body."""
    body = F.when(F.col("outcome") == "not found", F.lit("").cast("binary")).otherwise(F.col("body"))
    put = outcomes.filter("saved_at is not null").select("url", "status", "etag", "modified", body.alias("body"), "saved_at")
    both = cache.select("url", "status", "etag", "modified", "body", "saved_at").unionByName(put)
    newest = F.max_by(F.struct("status", "etag", "modified", "body", "saved_at"), "saved_at").alias("r")
    return both.groupBy("url").agg(newest).select("url", "r.*")
