"""Near-duplicate embeddings by an inverted multi-index.

Each vector is normalised and cut into halves; an independent codebook for each half, fitted on a
bounded sample, makes a grid of cells, the pairs of centroids. Every vector lives in the cell of its
nearest centroids. As a query it visits cells in the order of the sum of both halves' distances (the
multi-sequence order), as many as are needed to reach the target recall; that number is measured on
the sample, for partners that lie exactly at the threshold in random directions, which is the
hardest case. What is met in a cell is verified by the cosine in double precision.

Cells are grouped into blocks of the grid, of centroids that lie near each other, and a vector is sent
once to each block that it visits a cell of, with the list of these cells; vectors of floats are sent as
such. Blocks with more residents or visitors than a task should have are cut into chunks, and each pair of
chunks is a task of its own.

Equal vectors are one class with a weight. A pair counts for both its vectors, whichever of them
visits the other, and no pairs leave a task: a task sends the number of partners of each vector and
a spanning forest of its links.

Vectors that are null, zero, empty or hold null or non-finite components link with nothing, nor do
rows with a null id, whose component is null. Shorter vectors are padded by zeros. Rows that share an
id are vectors of their own with the same id. Cosines of exactly the threshold link. An empty table gives
no rows. Columns other than vec_id and embedding are not looked at, whatever their names. Vectors are equal
if two independent 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.components import Forest, components
from vertexloom.llm.workspace import Workspace

#: Vectors that a codebook is fitted on at most; vectors that a cell should have; most centroids.
SAMPLE, CELL_VECTORS, MAX_CENTROIDS = 16_384, 500, 512
#: Bytes of doubles of a task's residents; it has as many visitors. Bytes of costs that are held at once.
TASK_BYTES, SLICE_BYTES = 16 << 20, 64 << 20


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)


def _codebook(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's rounds from a seeded choice of rows."""
    centroids = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _squares(x, centroids).argmin(1)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def _in_order(centroids: np.ndarray) -> np.ndarray:
    """A place for each centroid, such that neighbours lie near each other: halves by the main direction, again and again."""
    place = np.empty(len(centroids), np.int64)
    todo, first = [np.arange(len(centroids))], 0
    while todo:
        some = todo.pop()
        if len(some) < 3:
            place[some] = first + np.arange(len(some))
            first += len(some)
            continue
        x = centroids[some] - centroids[some].mean(0)
        order = some[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
        todo += [order[len(some) // 2 :], order[: len(some) // 2]]
    return place


class MultiIndex:
    """Two codebooks and the number of cells that a query visits."""

    def __init__(self, sample: np.ndarray, total: int, threshold: float, recall: float, seed: int = 7):
        x = _unit(sample)
        self.half = (x.shape[1] + 1) // 2
        k = int(np.clip(np.sqrt(total / CELL_VECTORS), 1, min(MAX_CENTROIDS, len(x))))
        self.k = k
        self.books = [_codebook(h, k, seed + i) for i, h in enumerate(self._halves(x))]
        self.visits = self._calibrate(x, threshold, recall, seed)
        # Blocks of the grid, for about as many vectors as a task has.
        side = max(1, int(np.sqrt(TASK_BYTES / (8 * x.shape[1]) / max(1, total / k**2))))
        near = [_in_order(book) // side for book in self.books]
        self.block = near[0][:, None] * (k + 1) + near[1]

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def _calibrate(self, x: np.ndarray, threshold: float, recall: float, seed: int) -> int:
        """The place in the multi-sequence order, for the share ``recall`` of partners at the threshold."""
        x = x[:4096]
        noise = np.random.default_rng(seed).standard_normal(x.shape)
        noise -= (noise * x).sum(1, keepdims=True) * x
        noise /= np.maximum(np.sqrt((noise * noise).sum(1, keepdims=True)), 1e-12)
        partner = threshold * x + np.sqrt(1 - threshold**2) * noise
        home = self.home(partner)
        a, b = self._distances(x)
        rows, place = max(1, SLICE_BYTES // (9 * self.k**2)), []
        for s in range(0, len(x), rows):
            cost = (a[s : s + rows, :, None] + b[s : s + rows, None, :]).reshape(-1, self.k**2)
            own = cost[np.arange(len(cost)), home[s : s + rows]]
            place.append((cost < own[:, None]).sum(1) + 1)
        return int(np.ceil(np.quantile(np.concatenate(place), recall)))

    def _distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [_squares(h, book) for h, book in zip(self._halves(x), self.books)]

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self._distances(x)
        return a.argmin(1) * self.k + b.argmin(1)

    def nearest_cells(self, x: np.ndarray) -> np.ndarray:
        """For each row the first ``visits`` cells of the multi-sequence order. In it the pair of the
        i-th and j-th nearest centroids comes after (i + 1) * (j + 1) - 1 others, so only pairs
        with (i + 1) * (j + 1) <= visits can be among them."""
        v = self.visits
        i, j = np.divmod(np.arange(min(self.k, v) ** 2), min(self.k, v))
        early = (i + 1) * (j + 1) <= v
        i, j = i[early], j[early]
        a, b = self._distances(x)
        near_a, near_b = np.argsort(a, 1, kind="stable"), np.argsort(b, 1, kind="stable")
        cost = np.take_along_axis(a, near_a, 1)[:, i] + np.take_along_axis(b, near_b, 1)[:, j]
        cells = near_a[:, i] * self.k + near_b[:, j]
        # A home cell comes first also where sums are equal.
        order = np.argsort(cost, 1, kind="stable")[:, :v]
        return np.take_along_axis(cells, order, 1)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


ASSIGNED = "block long, rep long, weight long, vector binary, home int, lives boolean, cells array<int>, visits array<int>"


def _assign(classes: DataFrame, index: MultiIndex, width: int, kind: str) -> DataFrame:
    """For each class a row for each block that it visits: its cells there; in the block where it lives also all its cells."""
    lists = pa.list_(pa.int32())
    schema = pa.schema({"block": pa.int64(), "rep": pa.int64(), "weight": pa.int64(), "vector": pa.binary(), "home": pa.int32(), "lives": pa.bool_(), "cells": lists, "visits": lists})
    shared = classes.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        flat = x.block.ravel()
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                raw = _vectors(part.column(2), width)
                home, cells = x.home(_unit(raw)), np.sort(x.nearest_cells(_unit(raw)), 1)
                n, v = cells.shape
                block = flat[cells]
                order = np.argsort(block, 1, kind="stable")
                block, inside = np.take_along_axis(block, order, 1), np.take_along_axis(cells, order, 1).astype(np.int32).ravel()
                new = np.ones((n, v), bool)
                new[:, 1:] = block[:, 1:] != block[:, :-1]
                start = np.flatnonzero(new)
                row = start // v
                lives = block.ravel()[start] == flat[home[row]]
                whole = pa.ListArray.from_arrays(pa.array(np.arange(0, n * v + 1, v, dtype=np.int32)), pa.array(cells.astype(np.int32).ravel()))
                own = pa.array(raw.astype(kind).view(f"V{raw.astype(kind).itemsize * width}").ravel().tolist(), pa.binary())
                at = pa.array(row)
                columns = [
                    pa.array(block.ravel()[start]), part.column(0).take(at), part.column(1).take(at), own.take(at), pa.array(home[row].astype(np.int32)), pa.array(lives),
                    pa.ListArray.from_arrays(pa.array(np.append(start, n * v).astype(np.int32)), pa.array(inside)), whole.take(pa.array(row, mask=~lives)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return classes.mapInArrow(run, ASSIGNED)


def _compare(threshold: float, kind: str, n_cells: int):
    """Links between the residents and the visitors of a task: partners by vector, a spanning forest."""
    schema = pa.schema({"id": pa.int64(), "n": pa.int64(), "other": pa.int64()})

    def run(group: pa.Table) -> pa.Table:
        rep, weight, home = (group[c].to_numpy() for c in ("rep", "weight", "home"))
        lives, asks = (np.flatnonzero(group[c].to_numpy()) for c in ("lives", "asks"))
        if not len(lives) or not len(asks):
            return schema.empty_table()
        x = _unit(np.frombuffer(b"".join(group["vector"].to_pylist()), kind).reshape(len(rep), -1))
        lives = lives[np.argsort(home[lives], kind="stable")]
        here, first, count = np.unique(home[lives], return_index=True, return_counts=True)
        lists = group["cells"].combine_chunks()
        cell, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(rep)), lists.value_lengths().to_numpy())
        asked = np.zeros(len(rep), bool)
        asked[asks] = True
        some = asked[of] & np.isin(cell, here)
        cell, of = cell[some], of[some]
        order = np.argsort(cell, kind="stable")
        cell, of = cell[order], of[order]
        begin, end = np.searchsorted(cell, here), np.searchsorted(cell, here, "right")
        # The cells that residents visit, as numbers (row, cell) in ascending order.
        visits = group["visits"].combine_chunks()
        goes = np.repeat(np.flatnonzero(visits.is_valid().to_numpy(zero_copy_only=False)), visits.drop_null().value_lengths().to_numpy()) * n_cells + visits.flatten().to_numpy()
        goes.sort()
        ids, place = np.unique(rep, return_inverse=True)
        partners, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        for k in range(len(here)):
            residents = lives[first[k] : first[k] + count[k]]
            for s in range(begin[k], end[k], 1024):
                visitors = of[s : min(s + 1024, end[k])]
                i, j = np.nonzero(x[visitors] @ x[residents].T >= threshold)
                i, j = visitors[i], residents[j]
                apart = rep[i] != rep[j]
                i, j = i[apart], j[apart]
                np.add.at(partners, place[i], weight[j])
                # The resident counts the visitor here only if it does not visit the visitor's home.
                back = j * n_cells + home[i]
                at = np.searchsorted(goes, back)
                missed = goes[np.minimum(at, len(goes) - 1)] != back
                np.add.at(partners, place[j[missed]], weight[i[missed]])
                forest.unite(place[i], place[j])
        root, known = forest.roots(), np.flatnonzero(partners)
        apart = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"id": np.append(ids[known], ids[apart]), "n": np.append(partners[known], np.zeros(len(apart), np.int64)), "other": pa.array([None] * len(known) + ids[root[apart]].tolist(), pa.int64())}, schema=schema)

    return run


def dedup(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.995) -> DataFrame:
    """(vec_id, embedding) -> one row per row: vec_id, n_links, component_id, kept."""
    work = Workspace(vectors.sparkSession, "embeddings")
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    sound = F.coalesce(~bad & F.exists("v", lambda c: c != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.select("vec_id", F.when(sound, F.col("v")).alias("v")).withColumn("x", F.xxhash64("v")).withColumn("y", F.xxhash64(F.lit(1), F.col("v")))
    valid = rows.filter("v is not null")
    width = valid.agg(F.max(F.size("v"))).first()[0] or 0
    padded = F.concat("v", F.array_repeat(F.lit(0.0).cast("float" if kind == "<f4" else "double"), F.lit(width) - F.size("v")))
    classes = valid.groupBy("x", "y").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"))
    classes = work.save(classes.withColumn("v", padded), "classes")
    total = classes.count()
    rows = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.col("x")).alias("x"), F.when(F.col("v").isNotNull(), F.col("y")).alias("y"))
    if total:
        sample = classes.orderBy("x", "y").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
        index = MultiIndex(_vectors(sample, width), total, threshold, recall)
        assigned = work.save(_assign(classes.select("rep", "weight", "v"), index, width, kind), "assigned")
        most = max(64, TASK_BYTES // (8 * width))
        sizes = assigned.groupBy("block").agg(F.ceil(F.count_if("lives") / most).alias("r"), F.ceil(F.count("*") / most).alias("q")).filter("r > 0")
        rc, qc = F.pmod(F.xxhash64("rep"), F.col("r")), F.pmod(F.xxhash64("rep"), F.col("q"))
        one = lambda r, q, lives, asks: F.struct(r.alias("rc"), q.alias("qc"), lives.alias("lives"), asks.alias("asks"))
        as_visitor = F.transform(F.sequence(F.lit(0).cast("long"), F.col("r") - 1), lambda r: one(r, qc, F.col("lives") & (r == rc), F.lit(True)))
        as_resident = F.transform(F.sequence(F.lit(0).cast("long"), F.col("q") - 1), lambda q: one(rc, q, F.col("lives"), F.lit(False)))
        tasks = F.concat(as_visitor, F.filter(as_resident, lambda t: t["lives"] & (t["qc"] != qc)))
        placed = assigned.join(sizes, "block").withColumn("task", F.explode(tasks)).drop("lives").select("block", "rep", "weight", "vector", "home", "cells", "visits", "task.*")
        found = work.save(placed.groupBy("block", "rc", "qc").applyInArrow(_compare(threshold, kind, index.k**2), "id long, n long, other long"), "found")
        work.drop("assigned")
        partners = found.filter("other is null").groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("partners"))
        linked = work.save(components(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))), "linked")
        known = classes.select("x", "y", "rep", "weight").join(partners, "rep", "left").join(linked.withColumnRenamed("id", "rep"), "rep", "left")
        known = known.select(F.col("x").alias("cx"), F.col("y").alias("cy"), (F.coalesce("partners", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
        both = rows.join(known, (F.col("x") == F.col("cx")) & (F.col("y") == F.col("cy")), "left")
    else:
        both = rows.withColumn("n", F.lit(0).cast("long")).withColumn("c", F.lit(None).cast("long"))
    component = F.coalesce("c", "vec_id")
    return both.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
