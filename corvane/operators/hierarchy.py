"""Parent-child links to full hierarchies by tree contraction (problem 3).

Every round *rakes* the leaves (nodes without children) and *compresses*
unary chains: a node with one child is spliced out when a coin falls heads for
it and tails for its child, so spliced nodes are never adjacent. Each removed
node leaves a record "v hangs ``dist`` steps below p along these names". A
tree shrinks to its root in O(log n) expected rounds, however deep it is; a
loop shrinks to one node that is its own parent, the core that exposes the
cycle. The recorded contractions are then reversed, latest round first: the
parent of a record is always removed later, so it is known by then.

A folder may hold a third of all others. Child counts are pre-aggregated before
their shuffle, and children of a folder with more than ``HOT`` of them carry a salt:
whatever is looked up at the parent is repeated for its salts, so no task gets more
than about ``HOT`` children of one folder. (A node never gains children by
contraction, so the salts stay right.) Loops carry their smallest id only; where
paths are not asked for, no row grows with the length of a chain or loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import restage, stage

MAX_ROUNDS = 400
HOT = 20_000


def first_parent(parents: str = "parent_ids"):
    """The first parent id; null, empty and blank first parents count as none."""
    p = F.get(F.col(parents), F.lit(0))
    return F.when(p.rlike(r"\S"), p)


def links(folders: DataFrame) -> DataFrame:
    """One row per folder: ``id, parent, name``; unknown parents become null.

    Repeated ids count once (smallest parent and name win if they differ); rows
    with a null id are left out, since nothing can refer to them.
    """
    return _salted(_first_rows(folders)).select("id", "parent", "name")


def _salted(nodes: DataFrame) -> DataFrame:
    """Nodes with unknown parents set to null and ``salt``, ``salts``: the row's share of its parent and its own number of shares."""
    nodes = stage(nodes)
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    known = stage(nodes.select("id").join(kids, "id").select("id", F.ceil(F.col("kids") / HOT).cast("int").alias("salts")))
    hot = stage(known.where("salts > 1"))  # at most one in HOT of all nodes
    full = nodes.join(known, "id", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    if hot.isEmpty():
        full = full.withColumn("salt", F.lit(0))
    else:
        shares = F.broadcast(hot.select(F.col("id").alias("parent"), F.col("salts").alias("_s")))
        full = full.join(shares, "parent", "left").withColumn("salt", F.when(F.col("_s").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("_s"))).cast("int")).drop("_s")
    there = known.select(F.col("id").alias("parent"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("_known"))
    full = full.join(there, ["parent", "salt"], "left")
    return full.withColumn("parent", F.when(F.col("_known"), F.col("parent"))).drop("_known")


def _coin(col):
    """Heads or tails of a node in its round. The round is a column, so every round has the same generated code."""
    return F.pmod(F.xxhash64(col, F.col("rnd")), F.lit(2)) == 1


def _contract(nodes: DataFrame, paths: bool) -> list[DataFrame]:
    """Rounds of rake and compress: per round the nodes with ``state`` record, final or alive."""
    none = F.lit(None).cast("array<string>")
    out = stage(
        nodes.select(
            "id", "parent", "salt", "salts",
            F.lit(1).cast("long").alias("dist"), F.col("id").alias("least"),
            (F.array("id") if paths else none).alias("hop_ids"),
            (F.array(F.coalesce("name", F.lit(""))) if paths else none).alias("hop_names"),
            F.lit(None).cast("string").alias("heir"),
            F.lit(0).alias("rnd"),
            F.lit("alive").alias("state"),
        )
    )
    rounds = []
    for _ in range(MAX_ROUNDS):
        alive = out.where("state = 'alive'").drop("state", "heir")
        kids = alive.where("parent is not null and parent <> id").groupBy("parent").agg(F.count("*").alias("kids"), F.min("id").alias("only"))
        seen = alive.join(kids.withColumnRenamed("parent", "id"), "id", "left")
        gone = F.coalesce((F.col("kids") == 1) & F.col("parent").isNotNull() & (F.col("parent") != F.col("id")) & _coin(F.col("id")) & ~_coin(F.col("only")), F.lit(False))
        over = seen.where(gone).select(
            F.col("only").alias("id"), F.col("parent").alias("up"), F.col("salt").alias("up_salt"), F.col("dist").alias("up_dist"), F.col("least").alias("up_least"),
            F.col("hop_ids").alias("up_ids"), F.col("hop_names").alias("up_names"),
        )
        moved = F.col("up").isNotNull()
        out = stage(
            seen.join(over, "id", "left").select(
                "id",
                F.when(moved, F.col("up")).otherwise(F.col("parent")).alias("parent"),
                F.when(moved, F.col("up_salt")).otherwise(F.col("salt")).alias("salt"), "salts",
                (F.col("dist") + F.coalesce("up_dist", F.lit(0))).alias("dist"), F.least("least", "up_least").alias("least"),
                F.when(moved, F.concat("hop_ids", "up_ids")).otherwise(F.col("hop_ids")).alias("hop_ids"),
                F.when(moved, F.concat("hop_names", "up_names")).otherwise(F.col("hop_names")).alias("hop_names"),
                F.when(gone, F.col("only")).alias("heir"),
                (F.col("rnd") + 1).alias("rnd"),
                # 'record': contracted now; 'final': a bare root or a loop's core; else it stays
                F.when(gone, "record")
                .when(F.col("kids").isNull() & (F.col("parent").isNull() | (F.col("parent") == F.col("id"))), "final")
                .when(F.col("kids").isNull(), "record")
                .otherwise("alive").alias("state"),
            )
        )
        rounds.append(out)
        if out.where("state = 'alive'").isEmpty():
            return rounds
    raise RuntimeError(f"contraction has not ended after {MAX_ROUNDS} rounds")


def _expand(rounds: list[DataFrame]) -> DataFrame:
    """Reverse the contractions: ``id, root_id, depth, path_ids, path_names, cycle_id, on_cycle`` of every node."""
    core = F.col("parent").isNotNull()
    solved = [stage(restage(rounds).where("state = 'final'").select(
        "id", "salts",
        F.when(~core, F.col("id")).alias("root_id"),
        F.when(~core, F.lit(0)).cast("long").alias("depth"),
        F.when(~core, F.col("hop_ids")).alias("path_ids"),
        F.when(~core, F.col("hop_names")).alias("path_names"),
        F.when(core, F.col("least")).alias("cycle_id"), core.alias("on_cycle"),
    ))]
    for out in reversed(rounds):
        known = restage(solved)
        parents = known.select(
            F.col("id").alias("parent"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "root_id", F.col("depth").alias("p_depth"),
            F.col("path_ids").alias("p_ids"), F.col("path_names").alias("p_names"), "cycle_id",
        )
        # A spliced node stands between its heir and its parent, so it is on a loop if its heir is (each node is one node's heir at most).
        heirs = known.where("on_cycle").select(F.col("id").alias("heir"), "on_cycle")
        solved.append(stage(out.where("state = 'record'").join(parents, ["parent", "salt"]).join(heirs, "heir", "left").select(
            "id", "salts", "root_id", (F.col("p_depth") + F.col("dist")).alias("depth"),
            F.concat("p_ids", F.reverse("hop_ids")).alias("path_ids"),
            F.concat("p_names", F.reverse("hop_names")).alias("path_names"), "cycle_id", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"),
        )))
    return restage(solved)


def _first_rows(folders: DataFrame) -> DataFrame:
    return (
        folders.select("id", first_parent().alias("parent"), "name").where(F.col("id").isNotNull())
        .groupBy("id").agg(F.min(F.struct(F.col("parent"), F.col("name"))).alias("s")).select("id", "s.parent", "s.name")
    )


def resolve_hierarchy(folders: DataFrame) -> DataFrame:
    """``id, name, parent_id, root_id, depth, path, path_ids, cycle_id, on_cycle`` per folder.

    ``path`` joins the names from the root down with `` / `` (null names count as
    empty), ``path_ids`` lists the ids likewise, ``depth`` is 0 at roots. A folder
    whose chain enters a loop has null root, depth and paths; its ``cycle_id`` is the
    smallest id on the loop and ``on_cycle`` tells the loop's members from folders
    below it. An empty table gives an empty result; extra columns are ignored.
    """
    nodes = stage(_salted(_first_rows(folders)))
    return (
        nodes.select("id", "name", F.col("parent").alias("parent_id"))
        .join(_expand(_contract(nodes, True)), "id")
        .select("id", "name", "parent_id", "root_id", "depth", F.array_join("path_names", " / ").alias("path"), "path_ids", "cycle_id", "on_cycle")
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """``ancestor_id, descendant_id, distance`` for every pair on one branch.

    Rows, not arrays: a root above a third of all folders stays spread out.
    Folders on or below a loop have neither ancestors nor descendants here: on a
    loop everything is above everything.
    """
    return resolved.where("path_ids is not null").select(
        F.col("id").alias("descendant_id"), F.col("depth"), F.posexplode("path_ids").alias("at", "ancestor_id"),
    ).where("ancestor_id <> descendant_id").select("ancestor_id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))


def all_descendants(folders: DataFrame) -> DataFrame:
    """``ancestor_id, descendant_id, distance`` of every pair on one branch, also below loops.

    Loops are cut open: each of their members becomes the top of the tree that hangs on it, so
    the folders below it have ancestors up to that member. On a loop nothing is above anything.
    """
    on_loop = loop_members(folders)
    cut = folders.join(on_loop, "id", "left").select("id", "name", F.when(F.col("on_cycle").isNull(), F.col("parent_ids")).alias("parent_ids"))
    return descendants(resolve_hierarchy(cut))


def loop_members(folders: DataFrame) -> DataFrame:
    """``id, on_cycle`` of the members of loops."""
    nodes = stage(_salted(_first_rows(folders)))
    return stage(_expand(_contract(nodes, False)).where("on_cycle").select("id", "on_cycle"))


def cycles(folders: DataFrame) -> DataFrame:
    """``folder_id, cycle_id`` of every folder on or below a loop of first parents."""
    nodes = stage(_salted(_first_rows(folders)))
    return _expand(_contract(nodes, False)).where("cycle_id is not null").select(F.col("id").alias("folder_id"), "cycle_id")
