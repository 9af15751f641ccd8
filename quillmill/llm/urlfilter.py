"""URL filters over dated lists: a temporal list join.

Method. List entries are dated events: from ``since`` on, a host or a URL prefix is on a list
(action 'add') or off it (action 'remove'). Events of one list and value become validity intervals
[since, next event). Every capture is expanded to its lookup keys (its host, the parent domains, and
the prefixes of its path), and an as-of join keeps the entries whose interval holds the fetch time.
The most specific match decides; of equally specific ones an allow list wins over a block list.

The expansion gives a key for every label of the host and every segment of the path, whatever their
number. Intervals of one key are disjoint for each list, so a capture meets at most one per list and key.
The intervals are counted: up to ``BROADCAST_ROWS`` they are broadcast, and captures that match nothing never
leave their task. Beyond, captures and intervals meet in an equi-join on key and place: a key with more than
``HOT_ROWS`` captures has as many places as its measured count asks for, its intervals are copied to each.
What a capture matched is combined by one partial aggregate on its own row key.
A capture looks at all intervals of its keys, so the join's work grows with the changes of one entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmill.llm.common import BROADCAST_ROWS, measured_broadcast, settle

#: Captures of one key beyond which they are dealt to several places.
HOT_ROWS = 1_000_000

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _AUTHORITY, 1)), r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path without query and fragment, '/' if empty."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def lookup_keys(host: Column, path: Column) -> Column:
    """array<struct<key, rank>>: 'd:' domains from the host up and 'p:' host with path prefixes; a higher rank is more specific."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), n),
        lambda k: F.struct(F.concat(F.lit("d:"), F.array_join(F.slice(labels, n - k + 1, k), ".")).alias("key"), k.alias("rank")),
    )
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.when(
        F.size(parts) > 0,
        F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda k: F.struct(F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")).alias("key"), (k + n).alias("rank")),
        ),
    ).otherwise(F.array().cast("array<struct<key:string,rank:int>>"))
    return F.when(host.isNotNull(), F.concat(domains, prefixes))


def validity_intervals(events: DataFrame) -> DataFrame:
    """(list_name, verdict, key, since, until) from events (list_name, verdict, key, action, since).

    ``until`` is null for an interval that is still open. Events at one time: 'remove' is taken last.
    Events without key, action or date are ignored; repeated events change nothing.
    """
    dated = events.filter(F.col("key").isNotNull() & F.col("since").isNotNull() & F.col("action").isin("add", "remove"))
    last = dated.groupBy("list_name", "verdict", "key", "since").agg(F.max("action").alias("action"))
    nxt = F.lead("since").over(W.partitionBy("list_name", "verdict", "key").orderBy("since"))
    return last.withColumn("until", nxt).filter(F.col("action") == "add").select("list_name", "verdict", "key", "since", "until")


def _dealt(keys: DataFrame, active: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """keys and intervals with a place each, so that no key and place has many more than hot_rows keys."""
    wanted = active.select("entry").distinct()
    seen = keys.select("key").join(wanted, F.col("key") == F.col("entry"), "left_semi").groupBy("key").count()
    hot = settle(seen.filter(F.col("count") > hot_rows).select(F.col("key").alias("hot"), F.ceil(F.col("count") / hot_rows).cast("int").alias("places")), "hot-keys")
    hot = measured_broadcast(hot)
    places = F.coalesce("places", F.lit(1))
    own = F.pmod(F.xxhash64("id", "url", "fetched"), places).cast("int")
    left = keys.join(hot, F.col("key") == F.col("hot"), "left").withColumn("salt", own).drop("hot", "places")
    right = active.join(hot, F.col("entry") == F.col("hot"), "left").withColumn("place", F.explode(F.sequence(F.lit(0), places - 1))).drop("hot", "places")
    return left, right


def filter_captures(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched", broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of captures: its id, url, fetch time, decision, matched list and key, n_matches.

    decision is 'block', 'allow' or 'pass' (nothing active matched); in a tie of rank and verdict the
    list name and then the key that sort first are named. A null URL, a URL without a host and a null
    fetch time match nothing. Entries may name hosts of any number of labels and paths of any number of
    segments, URLs may have any length. Repeated rows stay (each is decided on its own row); null ids stay.
    Other columns are ignored, whatever their names; empty tables give empty results or all 'pass'.
    """
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).cast("timestamp").alias("fetched"))
    dated = rows.filter(F.col("url").isNotNull() & F.col("fetched").isNotNull())
    split = dated.select("id", "url", "fetched", F.explode(lookup_keys(host_of(F.col("url")), path_of(F.col("url")))).alias("k"))
    keys = split.select("id", "url", "fetched", F.col("k.key").alias("key"), F.col("k.rank").alias("rank"))
    active = settle(validity_intervals(events).withColumnRenamed("key", "entry"), "intervals")
    now = (F.col("key") == F.col("entry")) & (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    if active.count() <= broadcast_rows:
        hit = keys.join(F.broadcast(active), now)
    else:
        left, right = _dealt(keys, active, hot_rows)
        hit = left.join(right, now & (F.col("salt") == F.col("place")))
    # the smallest of (less specific last, allow before block, names) decides
    order = F.struct((-F.col("rank")).alias("r"), F.col("verdict").alias("v"), F.col("list_name").alias("l"), F.col("key").alias("k"))
    matches = F.count_distinct("list_name", "verdict", "key").alias("n")
    # rows that are equal in id, url and time get equal answers: each such row is decided once
    best = hit.groupBy(F.col("id").alias("i"), F.col("url").alias("u"), F.col("fetched").alias("f")).agg(F.min(order).alias("best"), matches)
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("url") == F.col("u")) & (F.col("fetched") == F.col("f"))
    return rows.join(best, same, "left").select(
        F.col("id").alias(id_col),
        F.col("url").alias(url_col),
        F.col("fetched").alias(time_col),
        F.coalesce(F.col("best.v"), F.lit("pass")).alias("decision"),
        F.col("best.l").alias("list_name"),
        F.col("best.k").alias("matched_key"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_matches"),
    )


def planned_captures(pages: DataFrame) -> DataFrame:
    """pages with a repeatable fetch time in 2024, as the table has none: a minute of the year from the id's MD5."""
    minute = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 6), 16, 10).cast("long") % 527_040
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + minute * 60).alias("fetched"))


def planned_events(pages: DataFrame) -> DataFrame:
    """Repeatable dated entries over the hosts of pages, as no list table exists.

    By the MD5 of a host: a third are blocked for a part of the year, some of them again later; some
    domains are allowed; and the path of a language below some hosts is blocked.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host"), F.substring_index(host_of(F.col("url")), ".", -2).alias("domain")).filter("host IS NOT NULL").distinct()
    h, d = F.col("host"), F.col("domain")
    first, length = _digits(h, 1) % 200, _digits(h, 4) % 120 + 1
    host_key, path_key, domain_key = F.concat(F.lit("d:"), h), F.concat(F.lit("p:"), h, F.lit("/en")), F.concat(F.lit("d:"), d)
    spells = [("add", first), ("remove", first + length), ("add", first + length + 60)]
    block = F.when(_digits(h, 7) % 3 == 0, F.array(*[_event("adult", "block", host_key, action, day) for action, day in spells]))
    path = F.when(_digits(h, 10) % 4 == 0, F.array(_event("spam", "block", path_key, "add", first + 30)))
    allow = F.when(_digits(d, 13) % 2 == 0, F.array(_event("trusted", "allow", domain_key, "add", _digits(d, 1) % 200)))
    nothing = F.array().cast("array<struct<list_name:string,verdict:string,key:string,action:string,since:timestamp>>")
    listed = F.concat(*[F.coalesce(x, nothing) for x in (block, path, allow)])
    return hosts.select(F.explode(listed).alias("e")).select("e.*").distinct()


def _digits(value: Column, at: int) -> Column:
    """A number from three hex digits of the value's MD5."""
    return F.conv(F.substring(F.md5(value), at, 3), 16, 10).cast("long")


def _event(name: str, verdict: str, key: Column, action: str, day: Column) -> Column:
    since = F.timestamp_seconds(F.lit(1_704_067_200) + day * 86_400)
    return F.struct(F.lit(name).alias("list_name"), F.lit(verdict).alias("verdict"), key.alias("key"), F.lit(action).alias("action"), since.alias("since"))
