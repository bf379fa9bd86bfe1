"""Table changes as frames in, frame out: append, upsert, replace, delete, erase, import, diff.

The result is the new content of a table; `capsule.sources.written` writes it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsule import fixed
from capsule.functions.words import blank
from capsule.operators import value

col = F.col
#: Rows of one partition where a large table is dealt by its key. Partitions by size hold far more rows of a few compressed numbers.
PARTITION_ROWS = 250_000


def partitions(rows: int) -> int:
    """Partitions that so many rows are dealt over."""
    return max(1, -(-rows // PARTITION_ROWS))


def natural_id(prefix: str, *parts: Column) -> Column:
    """Id out of the natural key, so that writing a row twice gives the same id."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 16))


def append_rows(table: DataFrame, rows: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Rows added once; a retry that brings known ids adds nothing. With `parts` both sides meet in so many partitions."""
    known = table.select(key)
    if parts is not None:
        rows, known = rows.repartition(parts, key), known.repartition(parts, key)
    return table.unionByName(rows.join(known, key, "left_anti"), allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: str,
           update: Sequence[str] | None = None) -> DataFrame:
    """Insert rows or update `update` columns of existing ones (all by default, none with an empty list).

    Of several rows with one key the last by `order` counts.
    """
    keys = list(keys)
    newest = F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order)
    last = rows.groupBy(*keys).agg(newest.alias("_new"))
    others = [c for c in table.columns if c not in keys]
    change = others if update is None else list(update)
    joined = table.withColumn("_old", F.lit(True)).join(last, keys, "full")
    out = []
    for c in others:
        fresh = col(f"_new.{c}") if c in rows.columns else F.lit(None)
        use = col("_old").isNull() | (col("_new").isNotNull() if c in change else F.lit(False))
        out.append(F.when(use, fresh).otherwise(col(c)).alias(c))
    return joined.select(*keys, *out)


def header_and_detail(outfits: DataFrame, ids: str = "item_ids") -> tuple[DataFrame, DataFrame]:
    """Outfit headers and their members; a repeated member keeps its first position."""
    detail = (outfits.select("outfit_id", "user_id", F.posexplode(ids).alias("position", "item_id"))
              .groupBy("outfit_id", "user_id", "item_id").agg(F.min("position").alias("position")))
    return outfits.drop(ids), detail


def replace_content(table: DataFrame, fresh: DataFrame) -> DataFrame:
    """One content-addressed row per user: a user's other keys go, the fresh one comes."""
    return table.join(fresh.select("user_id").distinct(), "user_id", "left_anti").unionByName(fresh)


def delete_items(table: DataFrame, gone: DataFrame, key: str = "item_id") -> DataFrame:
    return table.join(gone.select(col("item_id").alias(key)), key, "left_anti")


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Set scores without those that have a deleted or edited item among their members (exact membership)."""
    hit = (edges.select("user_id", "outfit_key", F.explode("item_ids").alias("item_id"))
           .join(gone.select("item_id"), "item_id", "left_semi").select("user_id", "outfit_key").distinct())
    return edges.join(hit, ["user_id", "outfit_key"], "left_anti")


def erase_users(tables: Mapping[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the erased users."""
    ids = users.select("user_id").distinct()
    return {name: t.join(ids, "user_id", "left_anti") for name, t in tables.items()}


def import_missing(target: DataFrame, source: DataFrame, keys: Sequence[str], user: Column) -> DataFrame:
    """Old rows into a table: common columns only, tagged with their owner, existing keys left alone."""
    tagged = source.withColumn("user_id", user)
    common = [c for c in target.columns if c in tagged.columns]
    fresh = tagged.select(*common).dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def manifest_diff(local: DataFrame, known: DataFrame) -> DataFrame:
    """What to do per path: upload new or changed files, delete vanished ones."""
    a, b = local.alias("a"), known.alias("b")
    same = col("a.size").eqNullSafe(col("b.size")) & col("a.mtime").eqNullSafe(col("b.mtime"))
    joined = a.join(b, ["user_id", "path"], "full")
    action = F.when(col("a.size").isNull(), "delete").when(~same, "upload")
    return joined.select("user_id", "path", action.alias("action")).where(col("action").isNotNull())


def referenced_items(evaluations: DataFrame, outfit_items: DataFrame) -> DataFrame:
    return (evaluations.select("user_id", col("candidate_item_id").alias("item_id")).where(col("item_id").isNotNull())
            .unionByName(outfit_items.select("user_id", "item_id")).distinct())


def stale_suggestions(items: DataFrame, current: DataFrame, referenced: DataFrame, prefix: str) -> DataFrame:
    """Suggestion items of earlier closet versions that nothing refers to any more.

    `current` has (user_id, closet_key); items are tagged `suggestion_for` = prefix + key.
    """
    mine = items.where((col("status") == "suggestion") & col("suggestion_for").startswith(prefix))
    old = mine.join(current, "user_id").where(col("suggestion_for") != F.concat(F.lit(prefix), "closet_key"))
    return old.drop("closet_key").join(referenced.select("item_id").distinct(), "item_id", "left_anti")


def same_members(left: DataFrame, right: DataFrame, key: str, member: str) -> DataFrame:
    """Per key whether two member sets are equal (counts and digest sums; no set is collected)."""
    def digest(df: DataFrame, side: str) -> DataFrame:
        h = F.conv(F.substring(F.md5(col(member).cast("string")), 1, 12), 16, 10).cast("decimal(38,0)")
        return df.select(key, member).distinct().groupBy(key).agg(F.count("*").alias(f"n_{side}"),
                                                                  F.sum(h).alias(f"h_{side}"))
    return digest(left, "l").join(digest(right, "r"), key, "full").select(
        key, (col("n_l").eqNullSafe(col("n_r")) & col("h_l").eqNullSafe(col("h_r"))).alias("in_step"))


def refresh_needed(evaluations: DataFrame, current: int = fixed.FORMULA_VERSION) -> DataFrame:
    """Saved verdicts that an older formula made and that can be recomputed."""
    return evaluations.where(~col("formula_version").eqNullSafe(F.lit(current))
                             & (blank(col("decision")) != "UNSUPPORTED"))


def recompute(evaluations: DataFrame, bars: DataFrame) -> DataFrame:
    """Verdicts of the stale ones, made anew from their stored counts and their owners' price bars of today (`bars`:
    user_id, price_bar, price_bar_source). original_decision keeps what was saved; nothing is written."""
    stale = (refresh_needed(evaluations).withColumn("original_decision", col("decision"))
             .drop("price_bar", "price_bar_source").join(bars, "user_id", "left")
             .withColumn("price_bar_source", F.coalesce("price_bar_source", F.lit("default"))))
    return value.verdict(stale).withColumns({"recomputed_on_read": F.lit(True),
                                             "formula_version": F.lit(fixed.FORMULA_VERSION)})
