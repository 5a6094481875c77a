"""Following references from what is kept, to a bounded depth, and up trees.

Each round joins the last round's rows with the edges and drops what is kept already. Rounds are written to the
checkpoint folder: the lineage stays short and a lost executor costs no more than its part of a round.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXEMPT_REASONS = ("parent", "menu:target")
EXEMPT_ROUNDS = 100
#: Rounds after which what is kept is written as one.
MOST_PARTS = 8


def saved(df: DataFrame) -> DataFrame:
    """`df` in the shared checkpoint folder; its own folder only where the session names none."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quarry-checkpoint-"))
    return df.checkpoint()


def is_exempt() -> Column:
    """Edges that are followed past the depth: to attachments, to parents, to menu targets, to children."""
    return F.col("to_attachment") | F.col("reason").isin(*EXEMPT_REASONS) | F.col("reason").startswith("child:")


def closure(keep: DataFrame, edges: DataFrame, depth: int = 2, exempt_rounds: int = EXEMPT_ROUNDS) -> DataFrame:
    """(site, id, depth, reason): keep (same columns, depth 0) and what edges (site, src, dst, reason, to_attachment) reach.

    A row gets the round it was first reached in and the least reason of that round. After `depth` rounds only exempt
    edges are followed, from the last round alone, as all edges of earlier rows have been followed.
    """
    exempt = edges.where(is_exempt())
    parts = [saved(keep.select("site", "id", F.col("depth").cast("int").alias("depth"), "reason"))]  # one a round: what is kept is not written again
    kept = last = parts[0]
    for number in range(1, depth + exempt_rounds + 1):
        if number == depth + 1:
            last = kept  # rows of the last full round lead on, by exempt edges
            last = last.where(F.col("depth") == depth) if depth else last
        steps = edges if number <= depth else exempt
        reached = steps.join(last.select("site", F.col("id").alias("src")), ["site", "src"]).groupBy("site", F.col("dst").alias("id")).agg(F.min("reason").alias("reason"))
        fresh = saved(reached.join(kept.select("site", "id"), ["site", "id"], "left_anti").select("site", "id", F.lit(number).alias("depth"), "reason"))
        if fresh.isEmpty():
            if number > depth:
                break
            last = fresh
            continue
        parts.append(fresh)
        if len(parts) > MOST_PARTS:
            parts = [saved(reduce(DataFrame.unionByName, parts))]
        kept, last = reduce(DataFrame.unionByName, parts), fresh
    return kept


def ancestors(base: DataFrame, tree: DataFrame) -> DataFrame:
    """base (term_id, taxonomy, parent) and all its ancestors within their taxonomy in tree. Cycles end."""
    found = saved(base.select("term_id", "taxonomy", "parent").distinct())
    last = found
    while True:
        above = last.where("parent > 0").select(F.col("parent").alias("term_id"), "taxonomy").distinct()
        fresh = saved(tree.join(above, ["term_id", "taxonomy"], "left_semi").join(found, ["term_id", "taxonomy"], "left_anti").select("term_id", "taxonomy", "parent"))
        if fresh.isEmpty():
            return found
        found, last = saved(found.unionByName(fresh)), fresh


def edges_of(entity: DataFrame, meta: DataFrame, follow: DataFrame, child_types: tuple[str, ...], attachment: str = "attachment", content: DataFrame | None = None, menu: DataFrame | None = None) -> DataFrame:
    """(site, src, dst, reason, to_attachment) of every reference whose target exists.

    meta (site, post_id, meta_key, ref_id); follow (site, meta_key, reason); content (site, post_id, ref_id, source);
    menu (site, post_id, type, object_id) with a row per menu item.
    """
    parts = [
        meta.join(follow, ["site", "meta_key"]).select("site", F.col("post_id").alias("src"), F.col("ref_id").alias("dst"), "reason"),
        entity.where((F.col("parent") > 0) & (F.col("type") != attachment)).select("site", F.col("id").alias("src"), F.col("parent").alias("dst"), F.lit("parent").alias("reason")),
        entity.where((F.col("parent") > 0) & F.col("type").isin(*child_types)).select("site", F.col("parent").alias("src"), F.col("id").alias("dst"), F.concat(F.lit("child:"), "type").alias("reason")),
    ]
    if content is not None:
        parts.append(content.select("site", F.col("post_id").alias("src"), F.col("ref_id").alias("dst"), F.concat(F.lit("content:"), "source").alias("reason")))
    if menu is not None:
        parts.append(menu.where("type = 'post_type'").select("site", F.col("post_id").alias("src"), F.col("object_id").try_cast("bigint").alias("dst"), F.lit("menu:target").alias("reason")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    target = entity.select("site", F.col("id").alias("dst"), (F.col("type") == attachment).alias("to_attachment"))
    return every.join(target, ["site", "dst"]).select("site", "src", "dst", "reason", "to_attachment")
