"""Counters of a social platform as a fold of its action log, with undo, once-only actions and exclusive ones; the same fold for tables and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each switching action's slot, the state that it sets (or takes back, if that is the state), and whether it sets. A slot holds one state for
#: each actor and object, so likes and dislikes exclude one another, and a repeated action changes nothing.
SWITCHES = {
    "like_post": ("post_reaction", "like", True),
    "unlike_post": ("post_reaction", "like", False),
    "dislike_post": ("post_reaction", "dislike", True),
    "undo_dislike_post": ("post_reaction", "dislike", False),
    "like_comment": ("comment_reaction", "like", True),
    "unlike_comment": ("comment_reaction", "like", False),
    "dislike_comment": ("comment_reaction", "dislike", True),
    "undo_dislike_comment": ("comment_reaction", "dislike", False),
    "repost": ("repost", "on", True),
    "flag_post": ("flag", "on", True),
    "follow": ("follow", "on", True),
    "unfollow": ("follow", "on", False),
    "mute": ("mute", "on", True),
    "unmute": ("mute", "on", False),
}

#: The counters that a slot's state raises by one: (slot, state) to (whose id, entity, counter).
RAISES = {
    ("post_reaction", "like"): (("object", "post", "likes"),),
    ("post_reaction", "dislike"): (("object", "post", "dislikes"),),
    ("comment_reaction", "like"): (("object", "comment", "likes"),),
    ("comment_reaction", "dislike"): (("object", "comment", "dislikes"),),
    ("repost", "on"): (("object", "post", "shares"),),
    ("flag", "on"): (("object", "post", "flags"),),
    ("follow", "on"): (("object", "user", "followers"), ("actor", "user", "followings")),
    ("mute", "on"): (("actor", "user", "mutes"),),
}

#: Actions that count each time: entity and counter. Purchases count their quantity.
ADDS = {"quote_post": ("post", "shares"), "create_comment": ("post", "comments"), "purchase_product": ("product", "sales")}


def by_action(column: Column, part: int) -> Column:
    return reduce(lambda out, item: out.when(column == item[0], F.lit(item[1][part])), list(SWITCHES.items())[1:], F.when(column == next(iter(SWITCHES)), F.lit(next(iter(SWITCHES.values()))[part])))


def switching(actions: DataFrame) -> DataFrame:
    """actor, object, slot, state, sets, at, event_id of the switching actions that have both ids."""
    a = F.col("action")
    known = actions.where(a.isin(*SWITCHES) & F.col("actor").isNotNull() & F.col("object").isNotNull())
    return known.select(F.col("actor").cast("long").alias("actor"), F.col("object").cast("long").alias("object"), by_action(a, 0).alias("slot"), by_action(a, 1).alias("state"), by_action(a, 2).alias("sets"), "at", F.col("event_id").cast("long").alias("event_id"))


def slots(actions: DataFrame) -> DataFrame:
    """actor, object, slot, state: what each slot holds after all ``actions`` (actor, object, action, at, event_id, quantity); empty slots are left out.

    In order of (at, event_id), the last action that sets decides, unless a later one takes that state back. All of it is maxima, so the fold is a partial
    aggregate like any other: no window, and no order of rows.
    """
    when = F.struct("at", "event_id")
    back = lambda state: F.max(F.when(~F.col("sets") & (F.col("state") == state), when))
    states = sorted({s for _, s, _ in SWITCHES.values()})
    folded = switching(actions).groupBy("actor", "object", "slot").agg(F.max_by("state", F.when(F.col("sets"), when)).alias("state"), F.max(F.when(F.col("sets"), when)).alias("last"), *[back(s).alias(f"back_{s}") for s in states])
    undone = reduce(lambda out, s: out | ((F.col("state") == s) & (F.coalesce(F.col(f"back_{s}") > F.col("last"), F.lit(False)))), states, F.lit(False))
    return folded.where(F.col("last").isNotNull() & ~undone).select("actor", "object", "slot", "state")


def raised(rows: DataFrame, amount: Column) -> DataFrame:
    """entity, id, counter, n of each counter that a row's slot and state raise; ``amount`` is 1, or -1 for states that ended."""
    one = lambda whose, entity, counter: F.struct(F.lit(entity).alias("entity"), F.col(whose).alias("id"), F.lit(counter).alias("counter"))
    what = F.lit(None)
    for (slot, state), raises in RAISES.items():
        what = F.when((F.col("slot") == slot) & (F.col("state") == state), F.array(*[one(*r) for r in raises])).otherwise(what)
    return rows.select(F.explode(what).alias("c"), amount.cast("long").alias("n")).select("c.entity", "c.id", "c.counter", "n")


def added(actions: DataFrame) -> DataFrame:
    """entity, id, counter, n of each action that counts every time; a missing quantity counts as one."""
    rows = actions.where(F.col("action").isin(*ADDS) & F.col("object").isNotNull())
    part = lambda k: reduce(lambda out, item: F.when(F.col("action") == item[0], item[1][k]).otherwise(out), ADDS.items(), F.lit(None))
    n = F.when(F.col("action") == "purchase_product", F.coalesce(F.col("quantity").cast("long"), F.lit(1))).otherwise(1)
    return rows.select(part(0).alias("entity"), F.col("object").cast("long").alias("id"), part(1).alias("counter"), n.cast("long").alias("n"))


def totals(changes: DataFrame) -> DataFrame:
    """entity, id, counter, n: sums of changes; counters at zero are left out."""
    return changes.groupBy("entity", "id", "counter").agg(F.sum("n").alias("n")).where("n != 0")


def platform_counters(actions: DataFrame) -> DataFrame:
    """entity, id, counter, n of every counter that isn't zero, after all ``actions`` (actor, object, action, at, event_id, quantity).

    post: likes, dislikes, shares (reposts, once an account, and quotes), flags (once an account), comments. comment: likes, dislikes. user: followers, followings, mutes.
    product: sales. Unknown actions, and rows without an id that they need, count nothing. Rows given twice count twice only where an action counts each time.
    """
    return totals(raised(slots(actions), F.lit(1)).unionByName(added(actions)))
