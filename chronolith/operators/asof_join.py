"""Attributes as known at event time: a point-in-interval join on two clocks.

Every version's validity interval is decomposed into dyadic time nodes, at most two a level.  An event
equi-joins the one node that encloses its time on each level, so no task sees all versions of an entity
at once and matches are found without a range join.  Nodes are of 2**GRAIN ms at the least, so the ends
are checked exactly (half-open) afterwards, together with what was known when; of the matches of an
event the greatest precedence wins by a partial aggregate.

A version whose closing became known at some time is two intervals: up to its end without condition, and
from its end on for events that were recorded before the closing was known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronolith.operators.dedupe import identifier

#: The finest node is 2**GRAIN ms (about 17 minutes); the root of the tree holds 2**TOP ms from 1970 on.
GRAIN, TOP = 20, 42
LEVELS = TOP - GRAIN
FOREVER = 1 << TOP


def cover(start: Column, end: Column) -> Column:
    """The dyadic nodes, as array<struct<level,node>>, that together hold [start, end) and no more than its grains.

    What lies outside the tree is held by its first or last grain.
    """
    low = F.shiftright(F.least(F.greatest(start, F.lit(0)), F.lit(FOREVER - 1)), GRAIN)
    high = F.shiftright(F.least(F.greatest(end, F.lit(1)), F.lit(FOREVER)) + ((1 << GRAIN) - 1), GRAIN)

    def at(level: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        a = F.call_function("shiftright", low + step - 1, level)
        b = F.call_function("shiftright", high, level)
        node = lambda n: F.struct(level.alias("level"), n.alias("node"))
        return F.filter(
            F.array(F.when((a < b) & (a % 2 == 1), node(a)), F.when((a < b) & (b % 2 == 1), node(b - 1))),
            lambda x: x.isNotNull(),
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at))


def enclosing(at: Column) -> Column:
    """The node of each level that encloses a time."""
    grain = F.shiftright(at, GRAIN)
    return F.transform(
        F.sequence(F.lit(0), F.lit(LEVELS)),
        lambda level: F.struct(level.alias("level"), F.call_function("shiftright", grain, level).alias("node")),
    )


#: An entity counts as hot from this many versions on, and from a thousandth of all.
HOT_VERSIONS = 5_000
_KEY = ["d0", "d1", "level", "node"]


def _digest(entity: list[str]) -> list[Column]:
    return [F.xxhash64(*[F.col(e) for e in entity]).alias("d0"), F.xxhash64(F.lit("entity"), *[F.col(e) for e in entity]).alias("d1")]


def hot_entities(rows: DataFrame, entity: list[str], least: int = HOT_VERSIONS) -> list[int]:
    """Digests of the entities with very many versions: at most a thousand."""
    counts = rows.select(*_digest(entity)).groupBy("d0", "d1").agg(F.count("*").alias("n"))
    share = rows.count() // 1000
    return sorted({r["d0"] for r in counts.filter(F.col("n") > max(least, share)).select("d0").collect()})


def _inside(at: Column) -> Column:
    """A time, or the end of the tree that is nearest to it."""
    return F.least(F.greatest(at, F.lit(0)), F.lit(FOREVER - 1))


def event_ranges(events: DataFrame, entity: list[str]) -> DataFrame:
    """d0, d1, first_in, last_in: the first and last event time of each entity, within the tree."""
    e = events.filter("at IS NOT NULL AND by IS NOT NULL").select(*_digest(entity), _inside(F.col("at")).alias("t"))
    return e.groupBy("d0", "d1").agg(F.min("t").alias("first_in"), F.max("t").alias("last_in"))


def _nodes(start: Column, end: Column) -> Column:
    """The nodes that cover what of an interval lies in the range of its entity's events."""
    low = F.greatest(_inside(start), F.col("first_in"))
    high = F.least(F.least(F.greatest(end, F.lit(1)), F.lit(FOREVER)), F.col("last_in") + 1)
    return F.when(low < high, cover(low, high))


def levels_of(versions: DataFrame, ranges: DataFrame, entity: list[str]) -> DataFrame:
    """d0, d1, levels: a bit for each level on which an entity's versions may have a node. versions: valid_from, valid_to and the entity columns.

    Events need no probe on other levels.  What is known of a version is not asked here, so this is narrow and may say too much, never too little.
    """
    never = F.lit((1 << 63) - 1)
    end = F.coalesce("valid_to", never)
    bit = lambda nodes: F.aggregate(F.coalesce(nodes, F.array()), F.lit(0), lambda acc, n: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1), n["level"])))
    both = bit(_nodes(F.col("valid_from"), end)).bitwiseOR(F.when(F.col("valid_to").isNull(), F.lit(0)).otherwise(bit(_nodes(F.greatest("valid_from", end), never))))
    rows = versions.filter("valid_from IS NOT NULL").select(*_digest(entity), "valid_from", "valid_to").join(ranges, ["d0", "d1"])
    return rows.select("d0", "d1", both.alias("levels")).groupBy("d0", "d1").agg(F.bit_or("levels").alias("levels"))


def _newest_only(v: DataFrame, e: DataFrame) -> DataFrame:
    """Versions in nodes, without those that no event of the node can get.

    If a version holds all event times of a node, also those that were moved into an edge node, was known before the first event
    there was recorded and is not seen as closed by the last, older ones can't win in it.  Nodes without events go as well.
    """
    seen = e.groupBy(*_KEY).agg(F.min("by").alias("first_by"), F.max("by").alias("last_by"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    v = v.join(seen, _KEY)
    whole = (F.col("start") <= F.col("first_at")) & (F.col("end") > F.col("last_at"))
    sure = whole & (F.col("known_at") <= F.col("first_by")) & (F.col("until") > F.col("last_by"))
    rank = F.struct("valid_from", "version")
    floor = v.filter(sure).groupBy(*_KEY).agg(F.max(rank).alias("floor"))
    v = v.join(floor, _KEY, "left").filter(F.col("floor").isNull() | (rank >= F.col("floor")))
    return v.drop("first_by", "last_by", "first_at", "last_at", "floor")


def attributes_as_known(events: DataFrame, versions: DataFrame, entity: list[str], hot: list[int] | None = None, levels: DataFrame | None = None) -> DataFrame:
    """The version of each event's entity that was valid at its time and known by then.

    events: event_id, at (event time), by (when it was recorded) and the entity columns.
    versions: version, valid_from, valid_to (null: open), known_at (null: never known), closed_known_at
    (null: the closing never became known) and the entity columns.  Of several matches the one with the
    greatest (valid_from, version) is kept.  Events with a null time, entity columns that are null on one
    side only, and events without a match give no row.  Repeated versions change nothing.
    Times before 1970 or after 2**TOP ms are matched by the edge nodes, then exactly.

    ``hot``: what ``hot_entities`` found.  In their nodes, versions that can't win are dropped before the join, so an entity
    with very many open versions does not meet each of its events with all of them.

    Versions are cut to the time in which their entity has events before they are decomposed, and events probe only the levels on which
    their entity has nodes then.  ``levels``: what ``levels_of`` said of the versions before they were joined with what is known of them, which saves that join.
    """
    digest, ranges = _digest(entity), event_ranges(events, entity)
    levels = levels_of(versions, ranges, entity) if levels is None else levels
    v = versions.filter(F.col("known_at").isNotNull() & F.col("valid_from").isNotNull())
    never = F.lit((1 << 63) - 1)
    end, until = F.coalesce("valid_to", never), F.coalesce("closed_known_at", never)
    interval = lambda a, b, u: F.struct(a.alias("start"), b.alias("end"), u.alias("until"))
    shapes = F.array(interval(F.col("valid_from"), end, never), interval(F.greatest("valid_from", end), never, until))
    v = v.select(*digest, "version", "valid_from", "known_at", shapes.alias("shapes")).join(ranges, ["d0", "d1"]).select("*", F.explode("shapes").alias("i"))
    v = v.filter("i.start < i.end").select("d0", "d1", "version", "valid_from", "known_at", "i.*", "first_in", "last_in")
    v = v.select("*", F.explode(_nodes(F.col("start"), F.col("end"))).alias("n")).select("*", "n.level", "n.node").drop("n", "first_in", "last_in")
    e = events.filter(F.col("at").isNotNull() & F.col("by").isNotNull())
    e = e.select("event_id", "at", "by", *digest, _inside(F.col("at")).alias("inside")).join(levels, ["d0", "d1"])
    nodes = F.filter(enclosing(F.col("inside")), lambda n: F.call_function("shiftright", F.col("levels"), n["level"]).bitwiseAND(F.lit(1)) == 1)
    e = e.select("event_id", "at", "by", "d0", "d1", F.explode(nodes).alias("n")).select("event_id", "at", "by", "d0", "d1", "n.level", "n.node")
    if hot:
        v = v.filter(~F.col("d0").isin(hot)).unionByName(_newest_only(v.filter(F.col("d0").isin(hot)), e.filter(F.col("d0").isin(hot))).select(*v.columns))
    hit = e.join(v, _KEY)
    hit = hit.filter((F.col("start") <= F.col("at")) & (F.col("at") < F.col("end")) & (F.col("known_at") <= F.col("by")) & (F.col("by") < F.col("until")))
    best = hit.groupBy("event_id").agg(F.max(F.struct("valid_from", "version")).alias("best"))
    return best.select("event_id", F.col("best.version").alias("version"))


def known_since(citations: DataFrame, ledger: DataFrame, key: list[Column], node: str, ingested: str) -> DataFrame:
    """node, known_at: when the first message that a node cites was first ingested.

    Both tables carry the columns that ``key`` reads.  Messages are told apart by a digest of 128 bits of the whole key, in which null parts
    equal each other, so what is shuffled of the ledger are three numbers a message; repeated citations collapse as well.
    """
    whole = identifier(key)
    keys = [F.xxhash64(whole).alias("k0"), F.xxhash64(F.lit("message"), whole).alias("k1")]
    first = ledger.select(*keys, F.col(ingested).alias("at")).groupBy("k0", "k1").agg(F.min("at").alias("at"))
    cited = citations.select(*keys, F.col(node).alias("cited_by")).distinct()
    return cited.join(first, ["k0", "k1"]).groupBy("cited_by").agg(F.min("at").alias("known_at"))
