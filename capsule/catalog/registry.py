"""The registered queries: what each covers, how it runs in Spark, and the same in SQL for the check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsule.plans.evaluate import RESOLVED, WORTH, Evaluation, closet_facts, evaluate, kinds_of, with_kind
from capsule.sources import driver_tables as dt
from capsule.sources.staging import stage

CENTER = 0.05  # logistic centre for the given vectors: about a third of two-item sets pass, as with the learned one
VECTORS = {"image": "image_key", "text": "text_key", "style": "style_key"}


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[["Tables"], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, *covers: str, sql: str | None = None):
    """Register a query; the SQL must give the same columns and values."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = Query(name, covers, fn, sql)
        return fn
    return add


_kept: dict[tuple, object] = {}


class Tables:
    """The given tables and what is derived from them. Derived item tables are written once per session."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return dt.read(self.spark, self.root, name)

    def _once(self, what: str, make):
        key = (self.spark.sparkContext.applicationId, self.root, what)
        if key not in _kept:
            _kept[key] = make()
        return _kept[key]

    def parts(self) -> DataFrame:
        return dt.part_items(self.spark, self.root)

    def owned(self) -> DataFrame:
        return self._once("owned", lambda: stage(dt.owned(self.spark, self.root), "owned"))

    def part_items(self) -> DataFrame:
        return self._once("part_items", lambda: stage(self.parts(), "part-items"))

    def closet(self) -> DataFrame:
        return dt.closet(self.owned(), self.part_items())

    def kinded_parts(self) -> DataFrame:
        def make():
            parts = self.part_items()
            facts = closet_facts(with_kind(parts, kinds_of(parts)))
            return stage(facts.select(*parts.columns, *RESOLVED, *WORTH), "kinded-parts")
        return self._once("kinded_parts", make)

    def kinded_closet(self) -> DataFrame:
        """The closet with garment_type, table_price, wears, known price and estimate, resolved once a part: no closet is shuffled
        by its texts or priced item by item."""
        return dt.closet(self.owned(), self.kinded_parts())

    def referring_closet(self) -> DataFrame:
        """`kinded_closet` with references to the vectors, attached once a part: no closet is shuffled by its keys."""
        parts = self._once("referring_parts", lambda: stage(self.refs(self.kinded_parts(), **VECTORS), "referring-parts"))
        return dt.closet(self.owned(), parts)

    def candidates(self) -> DataFrame:
        return self._once("candidates", lambda: stage(dt.candidates(self.spark, self.root), "candidates"))

    def vectors(self, items: DataFrame, **columns: str) -> DataFrame:
        return dt.with_vectors(items, self.spark, self.root, **columns)

    def referable(self) -> DataFrame:
        return self._once("referable", lambda: stage(dt.referable(self.spark, self.root), "vectors"))

    def refs(self, items: DataFrame, **columns: str) -> DataFrame:
        return dt.with_refs(items, self.referable(), **columns)

    def evaluate(self, items: DataFrame, settings: DataFrame | None = None) -> Evaluation:
        """Items judged against the closets of the given tables."""
        return evaluate(self.refs(items, **VECTORS), self.referring_closet(), settings, center=CENTER, vectors=self.referable())

    def evaluation(self) -> Evaluation:
        """One evaluation run, its results written as the saved evaluations."""
        def make():
            e = self.evaluate(self.candidates())
            return Evaluation(e.candidates, e.similar, e.outfits, stage(e.results, "evaluations"))
        return self._once("evaluation", make)


def joined(c, sep: str = "|"):
    """Array column as text, for comparable output."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep, "")
