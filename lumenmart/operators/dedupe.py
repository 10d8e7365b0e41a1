"""Near-duplicate listings: three match rules, transitive groups, one winner.

Rows are linked through rule keys rather than through pairs of rows, so a group
of n copies costs n memberships and never n * n pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenmart.session import broadcast_if_small, stage, stage_observed

BAND_DAYS = 30
BAND_MICROS = BAND_DAYS * 86_400 * 1_000_000


def _key(rule: str, *parts: Column) -> Column:
    # null takes part in the key: a missing price equals a missing price
    return F.unhex(F.md5(F.concat_ws("\u0001", F.lit(rule), *[
        F.coalesce(part.cast("string"), F.lit("\u0002")) for part in parts
    ])))


def _folded(column: Column) -> Column:
    return F.lower(F.trim(F.coalesce(column, F.lit(""))))


def title_key(title: Column) -> Column:
    """Lower-case letters and digits of a title, single-spaced."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))


def _rules(scope: Sequence[str]) -> dict[str, list[Column]]:
    """The parts of each rule's key; listings agree in a rule where all parts are equal, missing ones included."""
    scoped = [F.col(name) for name in scope]
    return {
        "url": [*scoped, _folded(F.col("url"))],
        "title": [*scoped, title_key(F.col("title")), F.col("price"), _folded(F.col("source"))],
        "place": [*scoped, F.col("price"), _folded(F.col("location")), _folded(F.col("seller"))],
    }


def sharing(listings: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The listings that share a rule's parts with another one, and a few more where hashes collide.

    Most listings stand alone. They are told by fixed-width hashes of the raw parts, which combine before the
    shuffle, so whole keys are built for the rest only.
    """
    short = {name: F.xxhash64(F.lit(name), *parts) for name, parts in _rules(scope).items()}
    hashes = F.array_compact(F.array(
        F.when(_folded(F.col("url")) != "", short["url"]), short["title"], F.when(F.col("observed_at").isNotNull(), short["place"])))
    columns = list(dict.fromkeys([*scope, "listing_id", "url", "title", "price", "source", "location", "seller", "observed_at"]))
    spans = listings.select(F.xxhash64("listing_id").alias("listing"), F.explode(hashes).alias("short")).groupBy("short").agg(
        F.min("listing").alias("lowest"), F.max("listing").alias("highest"))
    shared = stage(spans.where("lowest <> highest").select("short"))
    found = listings.select(*columns, F.explode(hashes).alias("short")).join(broadcast_if_small(shared), "short", "left_semi")
    return found.select(*columns).distinct()


def rule_keys(listings: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(listing_id, key, micros): every rule key a listing belongs to; micros is set for the 30-day rule only."""
    rules = _rules(scope)
    micros = F.unix_micros(F.col("observed_at").cast("timestamp"))
    timeless = lambda key: F.struct(key.alias("key"), F.lit(None).cast("long").alias("micros"))
    keys = F.array_compact(F.array(
        F.when(_folded(F.col("url")) != "", timeless(_key("url", *rules["url"]))),
        timeless(_key("title", *rules["title"])),
        F.when(micros.isNotNull(), F.struct(_key("place", *rules["place"]).alias("key"), micros.alias("micros"))),
    ))
    return listings.select("listing_id", F.explode(keys).alias("k")).select("listing_id", "k.key", "k.micros")


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows of ``rule_keys`` whose key more than one listing has.

    Most keys stand alone, so they are found by fixed-width hashes that combine before the shuffle, and only the
    rest goes on. Two keys of one hash stay as well; later steps compare whole keys.
    """
    short, listing = F.xxhash64("key").alias("short"), F.xxhash64("listing_id")
    spans = keys.groupBy(short).agg(F.min(listing).alias("lowest"), F.max(listing).alias("highest"))
    shared = stage(spans.where("lowest <> highest").select("short"))
    return keys.join(broadcast_if_small(shared), F.xxhash64("key") == F.col("short"), "left_semi")


def memberships(keys: DataFrame) -> DataFrame:
    """(listing_id, key) from ``rule_keys``, the 30-day rule cut into islands.

    Islands go over 30-day time buckets: rows of one bucket always lie within the band, and neighbouring buckets
    link when the gap between them is at most the band. Only bucket extremes meet in the window.
    """
    places = keys.where("micros is not null").withColumn("time_bucket", F.floor(F.col("micros") / F.lit(BAND_MICROS)))
    buckets = places.groupBy("key", "time_bucket").agg(F.min("micros").alias("first_micros"), F.max("micros").alias("last_micros"))
    ordered = Window.partitionBy("key").orderBy("time_bucket")
    starts = F.coalesce(
        (F.col("first_micros") - F.lag("last_micros").over(ordered)) > BAND_MICROS, F.lit(True)
    )
    islands = (
        buckets.withColumn("starts", starts.cast("int"))
        .withColumn("island", F.sum("starts").over(ordered))
        .select("key", "time_bucket", "island")
    )
    island = F.concat_ws("#", F.hex("key"), F.col("island").cast("string"))
    placed = places.join(islands, ["key", "time_bucket"]).select("listing_id", island.alias("key"))
    return keys.where("micros is null").select("listing_id", F.hex("key").alias("key")).union(placed)


def connected_keys(edges: DataFrame) -> DataFrame:
    """(key, component) for an undirected edge list (a, b).

    Alternates the large-star and small-star steps, which need a logarithmic
    number of rounds; each round is cut into the shared checkpoint folder.
    """
    current = stage(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    nodes = stage(
        current.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    )
    fingerprint = None
    while True:
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("low"))
        linked = large.join(smallest, "a")
        small = (
            linked.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(smallest.select("a", F.col("low").alias("b")))
            .distinct()
        )
        # the state is measured while it is written, not by a second job
        current, state = stage_observed(
            small, F.count(F.lit(1)).alias("edges"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("checksum"))
        if state == fingerprint:
            break
        fingerprint = state
    roots = current.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(roots, nodes["key"] == roots["a"], "left").select(
        "key", F.coalesce("component", "key").alias("component")
    )


def duplicate_groups(listings: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(listing_id, component) of every listing that has at least one duplicate."""
    candidates = stage(shared_keys(rule_keys(stage(sharing(listings, scope)), scope)))
    # a listing that is present twice is no duplicate of itself
    links = memberships(candidates).distinct()
    shared = links.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    links = stage(links.join(shared, "key", "left_semi"))
    anchors = links.groupBy("listing_id").agg(F.min("key").alias("a"))
    edges = links.join(anchors, "listing_id").select("a", F.col("key").alias("b")).distinct()
    components = connected_keys(edges)
    return (
        anchors.join(components, anchors["a"] == components["key"], "left")
        .select("listing_id", F.coalesce("component", "a").alias("component"))
    )


def winner_order() -> Column:
    """Smallest struct wins: landed cost, quality, evidence, earliest, id."""
    return F.struct(
        F.when(F.col("landed_cost_estimate").isNotNull(), 0).otherwise(1).alias("no_landed"),
        (-F.col("listing_quality")).alias("quality"),
        (-F.col("evidence_count")).alias("evidence"),
        F.col("observed_at"),
        F.col("listing_id"),
    )


def duplicates(listings: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(listing_id, component, winner_id, is_duplicate) of all grouped listings."""
    grouped = stage(duplicate_groups(listings, scope))
    members = listings.select(
        "listing_id", "landed_cost_estimate", "listing_quality", "evidence_count", "observed_at"
    ).join(broadcast_if_small(grouped), "listing_id").withColumn("preference", winner_order())
    best = members.groupBy("component").agg(F.min("preference").getField("listing_id").alias("winner_id"))
    return members.join(best, "component").select(
        "listing_id", "component", "winner_id",
        (F.col("listing_id") != F.col("winner_id")).alias("is_duplicate"),
    ).distinct()
