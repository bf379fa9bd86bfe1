"""Predicates and filters on items, boxes and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsule import fixed
from capsule.functions.words import blank, head_word

col = F.col
MIN_BOX_AREA = 400


def is_accessory(category: Column, subcategory: Column, label: Column, name: Column | None = None) -> Column:
    """Category is an accessory, or the last word of the type (else of the label, or of the product name) is."""
    words = fixed.ACCESSORY_WORDS
    kind = F.when(F.trim(blank(subcategory)) != "", subcategory).otherwise(label)
    out = F.lower(F.trim(blank(category))).isin(*words) | head_word(kind).isin(*words)
    return out | head_word(name).isin(*words) if name is not None else out


def is_supported(category: Column) -> Column:
    return F.coalesce(category.isin(*fixed.SUPPORTED), F.lit(False))


def accept_whole_batches(rows: DataFrame, batch: Sequence[str], refused: Column) -> DataFrame:
    """Adds `batch_refused`: one refused row refuses its batch. Counted per batch, then joined back."""
    bad = rows.where(refused).select(*batch).distinct().withColumn("batch_refused", F.lit(True))
    return rows.join(bad, list(batch), "left").withColumn("batch_refused", F.coalesce("batch_refused", F.lit(False)))


def clamp_box(box: Column) -> Column:
    return F.transform(box, lambda v: F.greatest(F.lit(0), F.least(F.lit(1000), v.cast("int"))))


def keep_boxes(boxes: DataFrame, *, pos: str = "pos", box: str = "box", first: int | None = None) -> DataFrame:
    """Boxes that are four numbers, not empty and large enough. `first` keeps those of lower `pos` (counted from 0 over
    all boxes of a photo) only."""
    b = clamp_box(col(box))
    high, wide = F.get(b, 2) - F.get(b, 0), F.get(b, 3) - F.get(b, 1)
    asked = boxes if first is None else boxes.where(col(pos) < first)
    return (asked.where(F.size(box) == 4).withColumn(box, b)
            .where((high > 0) & (wide > 0) & (high * wide >= MIN_BOX_AREA)))


def smaller_overlaps(boxes: DataFrame, *, pad: float = 0.06, ratio: float = 0.8, grid: int = 250) -> DataFrame:
    """Per box the clearly smaller boxes of its photo that reach into its padded area.

    Boxes are cut into grid cells first, so only boxes that share a cell meet; a pair is reported by the cell
    that holds the upper left corner of the common area, hence once.
    """
    y0, x0, y1, x1 = (F.get("box", i) for i in range(4))
    py, px = (y1 - y0) * pad + 4, (x1 - x0) * pad + 4

    def cells_of(ay, ax, by, bx):
        rows = F.sequence(F.floor(F.greatest(ay, F.lit(0)) / grid).cast("int"), F.floor(by / grid).cast("int"))
        cols = F.sequence(F.floor(F.greatest(ax, F.lit(0)) / grid).cast("int"), F.floor(bx / grid).cast("int"))
        return F.explode(F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(
            r.alias("r"), c.alias("c"))))))

    area = (y1 - y0) * (x1 - x0)
    big = boxes.select("photo_id", col("pos").alias("pos"), area.alias("area"), (y0 - py).alias("ay"),
                       (x0 - px).alias("ax"), (y1 + py).alias("by"), (x1 + px).alias("bx"))
    big = big.withColumn("cell", cells_of(col("ay"), col("ax"), col("by"), col("bx")))
    small = boxes.select("photo_id", col("pos").alias("other"), area.alias("o_area"), y0.alias("oy0"),
                         x0.alias("ox0"), y1.alias("oy1"), x1.alias("ox1"))
    small = small.withColumn("cell", cells_of(col("oy0"), col("ox0"), col("oy1"), col("ox1")))
    corner = F.struct(F.floor(F.greatest(col("ay"), col("oy0"), F.lit(0)) / grid).cast("int").alias("r"),
                      F.floor(F.greatest(col("ax"), col("ox0"), F.lit(0)) / grid).cast("int").alias("c"))
    return (big.join(small, ["photo_id", "cell"])
            .where((col("pos") != col("other")) & (col("o_area") < ratio * col("area")) & (col("ox1") > col("ax"))
                   & (col("ox0") < col("bx")) & (col("oy1") > col("ay")) & (col("oy0") < col("by"))
                   & (col("cell") == corner))
            .select("photo_id", "pos", "other"))


def stale_pending(status: Column, updated_at: Column, now: Column) -> Column:
    """A pending job that has not moved for ten minutes reads as failed."""
    age = F.unix_timestamp(now) - F.unix_timestamp(updated_at)
    return F.when((status == "pending") & (age > fixed.STALE_PENDING_SECONDS), "failed").otherwise(status)
