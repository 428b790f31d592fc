"""Archived payloads as VARIANT: shapes differ from row to row, and what doesn't parse or has another type gives nothing instead of failing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.latest import latest_per_key


def opened(payloads: DataFrame, keys: list[str], order: list[str], payload: str) -> DataFrame:
    """keys and v, the latest payload of each key as VARIANT; a latest payload that isn't JSON gives a null v."""
    return latest_per_key(payloads.select(*keys, *order, payload), keys, order).select(*keys, F.try_parse_json(payload).alias("v"))


def elements(v: Column, path: str = "$") -> Column:
    """The elements of the array at a path; none where there is another thing, or nothing."""
    return F.explode(F.try_variant_get(v, path, "array<variant>"))


def fixture_stats(archive: DataFrame, keys: list[str], gw: str) -> DataFrame:
    """keys, fixture, player, identifier, side, value: the statistics of each archived fixture, home and away as rows.

    archive: keys and v, a fixture each: id, event, and stats of identifier, h and a, which list element and value. Fixtures of another
    week than gw don't count. Of several entries of a player and identifier, the first by side, then value, stays.
    """
    get = lambda c, path, kind: F.try_variant_get(F.col(c), path, kind)
    own = archive.where(get("v", "$.event", "bigint") == F.col(gw)).select(*keys, get("v", "$.id", "bigint").alias("fixture"), elements(F.col("v"), "$.stats").alias("s"))
    sides = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), get("s", f"$.{side}", "array<variant>").alias("list")) for side in ("h", "a"))))
    entries = own.select(*keys, "fixture", get("s", "$.identifier", "string").alias("identifier"), sides.alias("x")).select(*keys, "fixture", "identifier", "x.side", F.explode("x.list").alias("e"))
    flat = entries.select(*keys, "fixture", get("e", "$.element", "bigint").alias("player"), "identifier", "side", get("e", "$.value", "bigint").alias("value"))
    known = flat.where("fixture is not null and player is not null and identifier is not null and value is not null")
    return known.groupBy(*keys, "fixture", "player", "identifier").agg(F.min(F.struct("side", "value")).alias("r")).select(*keys, "fixture", "player", "identifier", "r.*")


def back_filled(results: DataFrame, found: DataFrame, keys: list[str], column: str) -> DataFrame:
    """results with a column taken from found where it has the key; rows of found without a result are left out (update from)."""
    new = found.select(*keys, F.col(column).alias("_new"))
    return results.join(new, keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


#: Where a raw post names the posts that it comes from: an array of references, an embedded post, or an id beside the text.
SHAPES = {"repost": ("$.retweeted_status.id_str", "$.retweeted_status.id"), "quote": ("$.quoted_status.id_str", "$.quoted_status_id")}
REFERENCES = {"retweeted": "repost", "quoted": "quote"}


def origins(posts: DataFrame, post_id: str, raw: str) -> DataFrame:
    """post, kind, origin: the posts that each raw post names, in whichever shape; ids that are no numbers, other kinds of reference, and
    repeated mentions of one origin give nothing more."""
    v = posts.select(F.col(post_id).alias("post"), F.try_parse_json(raw).alias("v"))
    number = lambda c: F.when(c.rlike("^[0-9]{1,18}$"), c.cast("bigint"))
    kinds = F.create_map(*[F.lit(x) for pair in REFERENCES.items() for x in pair])
    listed = v.select("post", elements(F.col("v"), "$.referenced_tweets").alias("r")).select("post", F.try_element_at(kinds, F.try_variant_get("r", "$.type", "string")).alias("kind"), number(F.try_variant_get("r", "$.id", "string")).alias("origin"))
    plain = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), number(F.try_variant_get("v", path, "string")).alias("origin")) for kind, paths in SHAPES.items() for path in paths)))
    named = v.select("post", plain.alias("x")).select("post", "x.*")
    return listed.unionByName(named).where("kind is not null and origin is not null").distinct()
