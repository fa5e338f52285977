"""URL filters whose list entries have dates, evaluated as of each capture's fetch time, in DataFrame expressions only.

An entry says that from a day on a key (a domain, a host, or a host with the first part of a path) is listed or no
longer listed. Entries of a key become validity intervals that end where the next one starts; a capture is held against
the intervals of its host, the host's parent domains and its host with path that are valid on the day of the fetch.

The as-of join is an equality join on (key, month): intervals are dealt to the months they cover, which bounds the
intervals a capture meets by the days of a month, and a host that holds a third of all captures falls apart by month.
Captures are evaluated once for each distinct (host, path part, day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import column, others

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)"
ADDRESS = r"^(\[.*\]|[0-9]{1,3}(\.[0-9]{1,3}){3})$"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^/?#]+)"


def host_of(url: Column) -> Column:
    """The host in lower case, without the dot that may end a full name; empty for a null or unreadable URL.

    An address in brackets keeps them.
    """
    return F.lower(F.coalesce(F.regexp_replace(F.regexp_extract(url, HOST, 1), r"\.$", ""), F.lit("")))


def path_of(url: Column) -> Column:
    """The first part of the path with its slash, or empty."""
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def keys_of(host: Column, path: Column) -> Column:
    """What an entry may name for a capture: its host, the parents of at least two labels, and host with path.

    An address, in numbers or brackets, has no parents.
    """
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.when((n >= 2) & ~host.rlike(ADDRESS), F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))).otherwise(F.array(host))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.when(path == "", parents).otherwise(F.array_append(parents, F.concat(host, path))))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals (key, valid_from, valid_to) in which a key is listed, from entries (key, day, listed boolean).

    Of several entries of a key and day one that lists it wins. An interval that no later entry ends has a null end.
    Days are pre-aggregated, so the history of one key holds a row for a day at most. Null keys or days are left out.
    """
    days = entries.where(F.col("key").isNotNull() & F.col("day").isNotNull()).groupBy("key", "day").agg(F.max("listed").alias("listed"))
    return days.withColumn("valid_to", F.lead("day").over(Window.partitionBy("key").orderBy("day"))).where("listed").select("key", F.col("day").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, *, url_col="url", time_col="fetched") -> DataFrame:
    """`captures` with host, n_active, entry_key and entry_from: the longest key listed on the day of the fetch.

    All captures are kept: a null or unreadable URL has host '' and no entry, a capture without fetch time has none
    either. Repeated captures stay apart. Long URLs are read whole. An empty table of either kind gives an empty or
    entirely unlisted result. These four columns replace those of `captures` with their names; other names do not matter.
    """
    kept = others(captures, ["host", "n_active", "entry_key", "entry_from"])
    day = F.coalesce(F.to_date(column(time_col)), F.lit("0001-01-01").cast("date"))
    c = captures.select(F.struct(*map(column, kept)).alias("row"), host_of(column(url_col)).alias("host"), path_of(column(url_col)).alias("path"), day.alias("day"), column(time_col).isNotNull().alias("dated"))
    asked = c.where("host <> '' and dated").groupBy("host", "path", "day").agg(F.lit(1).alias("one")).drop("one")
    span = asked.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    first, last = F.lit(span.a), F.lit(span.b)
    # months before the first and after the last fetch are asked by no capture
    covered = validity(entries).where((F.col("valid_from") <= last) & (F.coalesce("valid_to", last) >= first))
    months = F.sequence(F.trunc(F.greatest("valid_from", first), "month"), F.trunc(F.least(F.coalesce("valid_to", last), last), "month"), F.expr("interval 1 month"))
    covered = covered.withColumn("month", F.explode(months))
    probes = asked.select("host", "path", "day", F.trunc("day", "month").alias("month"), F.explode(keys_of(F.col("host"), F.col("path"))).alias("key"))
    valid = (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    found = (
        probes.join(covered, ["key", "month"])
        .where(valid)
        .groupBy("host", "path", "day")
        .agg(F.count("*").alias("n_active"), F.max(F.struct(F.length("key"), "key", "valid_from")).alias("top"))
        .select("host", "path", "day", "n_active", F.col("top.key").alias("entry_key"), F.col("top.valid_from").alias("entry_from"))
    )
    return c.join(found, ["host", "path", "day"], "left").select("row.*", "host", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), "entry_key", "entry_from")
