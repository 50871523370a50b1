"""Density clustering (DBSCAN) as grouped joins over a grid.

The grid cell has side eps / sqrt(d), so rows of one cell are always neighbours:

* equal rows fold into weighted points, and a cell of at least `min_samples` rows is all core -
  dense regions, however many rows they hold, need no row-by-row comparison;
* two cells are compared by their bounding boxes first: far apart, wholly within eps, or
  unsure. Only unsure pairs look at points, and only points of thin cells (fewer than
  `min_samples` rows) are counted one by one, so the work stays linear in the table;
* whether two dense cells touch is settled by halving both boxes until every piece is sure.

Components of touching core cells are the clusters, numbered by their first core row; border
rows take the lowest cluster in reach; the rest is noise (-1).

In four dimensions the neighbouring cells are found dimension by dimension, among the occupied slabs. Above `GRID_DIMS`
dimensions they are too many to list, and `halo` does the work.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .clusters import NOISE_LABEL, small_side
from .components import connected_components, dense_number
from .halo import halo_core_points, halo_dbscan

# A cell with more points than this is dealt out to several tasks.
SALT_ROWS = 20_000
# Unsure cell pairs are settled point by point once they hold at most this many pairs.
DIRECT_PAIRS = 20_000_000
GRID_DIMS = 4


def _names(prefix: str, d: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(d)]


def _sq(terms: list[Column]) -> Column:
    return reduce(add, [t * t for t in terms])


def _box_gap(a: str, b: str, d: int) -> Column:
    """Squared distance between two boxes (0 where they overlap)."""
    gaps = [
        F.greatest(
            F.lit(0.0),
            F.col(f"{b}.lo")[i] - F.col(f"{a}.hi")[i],
            F.col(f"{a}.lo")[i] - F.col(f"{b}.hi")[i],
        )
        for i in range(d)
    ]
    return _sq(gaps)


def _box_span(a: str, b: str, d: int) -> Column:
    """Squared distance between the farthest corners of two boxes."""
    spans = [
        F.greatest(
            F.col(f"{b}.hi")[i] - F.col(f"{a}.lo")[i],
            F.col(f"{a}.hi")[i] - F.col(f"{b}.lo")[i],
        )
        for i in range(d)
    ]
    return _sq(spans)


class _Grid:
    """The folded points of a table and their cells, shared by `core_points` and `dbscan`."""

    def __init__(self, df, id_col, features, eps, min_samples, salt_rows, direct_pairs):
        if eps <= 0 or min_samples < 1:
            raise ValueError("eps must be positive and min_samples at least 1")
        self.features = list(features)
        self.d = d = len(self.features)
        self.eps2, self.eps, self.min_samples = float(eps) ** 2, float(eps), int(min_samples)
        self.salt_rows, self.direct_pairs = salt_rows, direct_pairs
        self.x = _names("x", d)
        # Slightly under eps / sqrt(d), so rounding cannot push two rows of a cell apart.
        self.side = eps / math.sqrt(d) * (1 - 1e-9)

        # Adding 0.0 turns -0.0 into 0.0, which are equal but would group apart.
        self.rows = df.select(
            F.col(id_col).alias("id"),
            *[
                (F.col(c).cast("double") + F.lit(0.0)).alias(x)
                for c, x in zip(self.features, self.x, strict=True)
            ],
        )
        rows = self.rows
        if d > 3:
            # As in `halo`: a row with a missing feature has no neighbours.
            for x in self.x:
                rows = rows.where(F.col(x).isNotNull() & ~F.isnan(x))
        points = rows.groupBy(*self.x).agg(
            F.count(F.lit(1)).alias("w"), F.min("id").alias("pid")
        )
        key = F.array(*[F.floor(F.col(x) / F.lit(self.side)).cast("long") for x in self.x])
        points = points.withColumn("key", key)
        points = cut_lineage(points)
        self.cells = cut_lineage(
            points.groupBy("key").agg(
                F.min("pid").alias("cell"),
                F.sum("w").alias("weight"),
                F.count(F.lit(1)).alias("n"),
                self.box(),
            )
        )
        self.points = cut_lineage(
            points.join(small_side(self.cells.select("key", "cell", "weight", "n")), "key")
            .withColumn("salts", F.ceil(F.col("n") / F.lit(salt_rows)).cast("int"))
            .withColumn("salt", F.pmod(F.xxhash64("pid"), F.col("salts")).cast("int"))
        )
        self.pairs = cut_lineage(self._near_cells())

    def box(self) -> Column:
        return F.struct(
            F.array(*[F.min(x) for x in self.x]).alias("lo"),
            F.array(*[F.max(x) for x in self.x]).alias("hi"),
        ).alias("box")

    # Ordered pairs (a, b), a <> b, of cells whose boxes are within eps of each other.
    def _near_cells(self) -> DataFrame:
        own = self.cells.select("key", F.col("cell").alias("a"), F.col("box").alias("box_a"))
        other = self.cells.select(
            F.col("key").alias("near_key"),
            F.col("cell").alias("b"),
            F.col("box").alias("box_b"),
            F.col("weight").alias("weight_b"),
        )
        if self.d > 3:
            joined = self._by_slabs(own).join(other, "near_key").where("a <> b")
            return joined.where(_box_gap("box_a", "box_b", self.d) <= self.eps2).select(
                "a", "b", "weight_b", (_box_span("box_a", "box_b", self.d) <= self.eps2).alias("full")
            )
        # Cells o steps apart in a dimension are at least (|o| - 1) sides apart.
        reach = range(-math.floor(1 + math.sqrt(self.d)), math.floor(1 + math.sqrt(self.d)) + 1)
        offsets = [
            o
            for o in itertools.product(reach, repeat=self.d)
            if any(o) and sum(max(0, abs(i) - 1) ** 2 for i in o) <= self.d * (1 + 1e-6)
        ]
        near = F.explode(
            F.array(
                *[F.array(*[F.col("key")[i] + F.lit(s) for i, s in enumerate(o)]) for o in offsets]
            )
        )
        joined = own.withColumn("near_key", near).join(other, "near_key")
        return joined.where(_box_gap("box_a", "box_b", self.d) <= self.eps2).select(
            "a", "b", "weight_b", (_box_span("box_a", "box_b", self.d) <= self.eps2).alias("full")
        )

    # The keys that may hold cells near each cell. The offsets of all dimensions are too many to list; dimension by
    # dimension only the slabs that hold rows within eps are left, beginning where a slab has fewest of them.
    def _by_slabs(self, own: DataFrame) -> DataFrame:
        reach = math.floor(1 + math.sqrt(self.d))
        slabs = []
        for i in range(self.d):
            one = cut_lineage(
                self.cells.groupBy(F.col("key")[i].alias("k")).agg(
                    F.min(F.col("box.lo")[i]).alias("lo"), F.max(F.col("box.hi")[i]).alias("hi")
                )
            )
            steps = F.sequence(F.col("k") - reach, F.col("k") + reach)
            other = one.select(F.col("k").alias("near"), F.col("lo").alias("near_lo"), F.col("hi").alias("near_hi"))
            gap = F.greatest(F.lit(0.0), F.col("near_lo") - F.col("hi"), F.col("lo") - F.col("near_hi"))
            near = (
                one.withColumn("near", F.explode(steps)).join(other, "near")
                .select(F.col("k").alias(f"k{i}"), F.col("near").alias(f"near{i}"), (gap * gap).alias(f"gap{i}"))
                .where(F.col(f"gap{i}") <= self.eps2)
            )
            near = cut_lineage(near)
            slabs.append((near.count() / max(1, one.count()), i, near))
        found = own.withColumn("gap", F.lit(0.0))
        for _, i, near in sorted(slabs, key=lambda x: x[:2]):
            found = found.withColumn(f"k{i}", F.col("key")[i]).join(small_side(near), f"k{i}")
            found = found.withColumn("gap", F.col("gap") + F.col(f"gap{i}")).drop(f"k{i}", f"gap{i}")
            found = found.where(F.col("gap") <= self.eps2 * (1 + 1e-9))
        keys = F.array(*[F.col(f"near{i}") for i in range(self.d)])
        return found.withColumn("near_key", keys).select("a", "box_a", "near_key")

    # Points of cell b for given (a, b) pairs; a big cell b arrives in several salted shares.
    def _with_points_of_b(self, asked: DataFrame, members: DataFrame) -> DataFrame:
        sizes = self.cells.where(F.col("n") > self.salt_rows).select(
            F.col("cell").alias("b"),
            F.ceil(F.col("n") / F.lit(self.salt_rows)).cast("int").alias("b_salts"),
        )
        dealt = (
            asked.join(small_side(sizes), "b", "left")
            .withColumn("b_salts", F.coalesce("b_salts", F.lit(1)))
            .withColumn("b_salt", F.explode(F.sequence(F.lit(0), F.col("b_salts") - 1)))
        )
        other = members.select(
            F.col("cell").alias("b"),
            F.col("salt").alias("b_salt"),
            F.col("w").alias("b_w"),
            *[F.col(x).alias(f"b_{x}") for x in self.x],
        )
        return dealt.join(other, ["b", "b_salt"]).where(
            _sq([F.col(x) - F.col(f"b_{x}") for x in self.x]) <= self.eps2
        )

    def core(self) -> DataFrame:
        """The points that have at least `min_samples` rows within eps, themselves included."""
        sure = self.pairs.where("full").groupBy(F.col("a").alias("cell")).agg(
            F.sum("weight_b").alias("around")
        )
        known = self.cells.select("cell", "weight").join(sure, "cell", "left")
        known = known.withColumn("known", F.col("weight") + F.coalesce("around", F.lit(0)))
        known = known.select("cell", "known").persist()
        thick = known.where(F.col("known") >= self.min_samples).select("cell")
        thin = known.where(F.col("known") < self.min_samples)
        asked = (
            self.points.join(thin, "cell")
            .select("pid", "known", F.col("cell").alias("a"), *self.x)
            .join(self.pairs.where("not full").select("a", "b"), "a")
        )
        counted = (
            self._with_points_of_b(asked, self.points)
            .groupBy("pid", "known")
            .agg(F.sum("b_w").alias("more"))
            .where(F.col("known") + F.col("more") >= self.min_samples)
            .select("pid")
        )
        by_cell = self.points.join(thick, "cell", "left_semi")
        by_count = self.points.join(counted, "pid", "left_semi")
        return cut_lineage(by_cell.unionByName(by_count))

    def touching(self, core: DataFrame) -> DataFrame:
        """Pairs (a < b) of cells that have core points within eps of each other."""
        boxes = core.groupBy("cell").agg(self.box(), F.count(F.lit(1)).alias("n")).persist()
        left = boxes.select(F.col("cell").alias("a"), F.col("box").alias("box_a"), F.col("n").alias("n_a"))
        right = boxes.select(F.col("cell").alias("b"), F.col("box").alias("box_b"), F.col("n").alias("n_b"))
        pairs = (
            self.pairs.where("a < b").select("a", "b").join(left, "a").join(right, "b")
            .where(_box_gap("box_a", "box_b", self.d) <= self.eps2)
            .withColumn("sure", _box_span("box_a", "box_b", self.d) <= self.eps2)
        )
        pairs = cut_lineage(pairs)
        found = pairs.where("sure").select("a", "b")
        zeros = F.array(*[F.lit(0).cast("long")] * self.d)
        open_pairs = pairs.where("not sure").select(
            "a", "b", zeros.alias("key_a"), zeros.alias("key_b"), "n_a", "n_b"
        )
        halvings, level = [0] * self.d, 0
        while True:
            work = open_pairs.agg(F.sum(F.col("n_a").cast("double") * F.col("n_b"))).first()[0] or 0
            if work == 0:
                return found
            if work <= self.direct_pairs:
                return found.unionByName(self._touching_points(core, open_pairs, halvings))
            # Halve two dimensions per level: each piece falls into at most four.
            before = list(halvings)
            for i in {(2 * level) % self.d, (2 * level + 1) % self.d}:
                halvings[i] += 1
            level += 1
            pieces = (
                core.join(
                    small_side(
                        open_pairs.select(F.col("a").alias("cell"))
                        .unionByName(open_pairs.select(F.col("b").alias("cell")))
                        .distinct()
                    ),
                    "cell",
                    "left_semi",
                )
                .groupBy(
                    "cell",
                    self.piece_key(halvings).alias("piece"),
                    self.piece_key(before).alias("parent"),
                )
                .agg(self.box(), F.count(F.lit(1)).alias("n"))
            )
            pieces = cut_lineage(pieces)

            def side(s: str, pieces=pieces) -> DataFrame:
                return pieces.select(
                    F.col("cell").alias(s),
                    F.col("parent").alias(f"key_{s}"),
                    F.col("piece").alias(f"piece_{s}"),
                    F.col("box").alias(f"box_{s}"),
                    F.col("n").alias(f"n_{s}"),
                )

            finer = (
                open_pairs.drop("n_a", "n_b")
                .join(side("a"), ["a", "key_a"])
                .join(side("b"), ["b", "key_b"])
                .where(_box_gap("box_a", "box_b", self.d) <= self.eps2)
                .withColumn("sure", _box_span("box_a", "box_b", self.d) <= self.eps2)
            )
            finer = cut_lineage(finer)
            settled = finer.where("sure").select("a", "b").distinct()
            found = found.unionByName(settled)
            open_pairs = cut_lineage(
                finer.join(small_side(settled), ["a", "b"], "left_anti").select(
                    "a",
                    "b",
                    F.col("piece_a").alias("key_a"),
                    F.col("piece_b").alias("key_b"),
                    "n_a",
                    "n_b",
                )
            )

    def piece_key(self, halvings: list[int]) -> Column:
        """Position of a point inside its cell after so many halvings per dimension."""
        inside = [
            F.col(x) / F.lit(self.side) - F.col("key")[i] for i, x in enumerate(self.x)
        ]
        return F.array(
            *[F.floor(p * F.lit(float(2**h))).cast("long") for p, h in zip(inside, halvings, strict=True)]
        )

    def _touching_points(self, core: DataFrame, open_pairs: DataFrame, halvings) -> DataFrame:
        keyed = core.withColumn("piece", self.piece_key(halvings))

        def side(s: str) -> DataFrame:
            return keyed.select(
                F.col("cell").alias(s),
                F.col("piece").alias(f"key_{s}"),
                *[F.col(x).alias(f"{s}_{x}") for x in self.x],
            )

        near = _sq([F.col(f"a_{x}") - F.col(f"b_{x}") for x in self.x]) <= self.eps2
        return (
            open_pairs.drop("n_a", "n_b")
            .join(side("a"), ["a", "key_a"])
            .join(side("b"), ["b", "key_b"])
            .where(near)
            .select("a", "b")
            .distinct()
        )

    def back_to_rows(self, labelled_points: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Give every row what its point got; equal rows share a point."""
        return self.rows.join(labelled_points.select(*self.x, *columns), self.x, "left").select(
            "id", *columns
        )


def core_points(
    df: DataFrame,
    id_col: str,
    features: Sequence[str],
    eps: float = 0.5,
    min_samples: int = 5,
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """`id_col`, `is_core`: whether at least `min_samples` rows (itself included) are within eps."""
    if len(features) > GRID_DIMS:
        return halo_core_points(df, id_col, features, eps, min_samples)
    grid = _Grid(df, id_col, features, eps, min_samples, salt_rows, DIRECT_PAIRS)
    core = grid.core().withColumn("is_core", F.lit(True))
    rows = grid.back_to_rows(core, ["is_core"])
    return rows.select(
        F.col("id").alias(id_col), F.coalesce("is_core", F.lit(False)).alias("is_core")
    )


def dbscan(
    df: DataFrame,
    id_col: str,
    features: Sequence[str],
    eps: float = 0.5,
    min_samples: int = 5,
    cluster: str = "cluster",
    salt_rows: int = SALT_ROWS,
    direct_pairs: int = DIRECT_PAIRS,
) -> DataFrame:
    """The table with a cluster label per row, -1 for noise."""
    if len(features) > GRID_DIMS:
        return halo_dbscan(df, id_col, features, eps, min_samples, cluster)
    grid = _Grid(df, id_col, features, eps, min_samples, salt_rows, direct_pairs)
    core = grid.core()
    linked = connected_components(grid.touching(core).select("a", "b"))
    cells = core.groupBy("cell").agg(F.min("pid").alias("first_core"))
    # A core cell that touches no other is a component of its own.
    cells = (
        cells.join(linked, F.col("cell") == F.col("node"), "left")
        .select("cell", "first_core", F.coalesce("component", "cell").alias("component"))
        .persist()
    )
    firsts = cells.groupBy("component").agg(F.min("first_core").alias("first_core"))
    numbers = dense_number(firsts, "first_core", cluster).select("component", cluster)
    labels = cut_lineage(cells.join(small_side(numbers), "component").select("cell", cluster))

    core_labels = core.join(labels, "cell").select(*grid.x, cluster)
    rest = grid.points.join(core.select("pid"), "pid", "left_anti")
    # Border: the own cell or a wholly near cell settles it; unsure cells are looked at.
    own = rest.join(labels, "cell").select("pid", cluster)
    pairs = grid.pairs.join(labels.withColumnRenamed("cell", "b"), "b")
    rest_pairs = rest.select("pid", F.col("cell").alias("a"), *grid.x).join(pairs, "a")
    full = rest_pairs.where("full").select("pid", cluster)
    unsure = grid._with_points_of_b(rest_pairs.where("not full"), core).select("pid", cluster)
    border = (
        own.unionByName(full)
        .unionByName(unsure)
        .groupBy("pid")
        .agg(F.min(cluster).alias(cluster))
        .join(grid.points, "pid")
        .select(*grid.x, cluster)
    )
    rows = grid.back_to_rows(core_labels.unionByName(border), [cluster])
    out = rows.select(
        F.col("id").alias(id_col), F.coalesce(cluster, F.lit(NOISE_LABEL)).cast("int").alias(cluster)
    )
    return df.drop(cluster).join(out, id_col)
