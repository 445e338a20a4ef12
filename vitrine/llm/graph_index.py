"""Approximate nearest items: one hierarchical small-world graph per shard of vectors."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.scale import stored, top_per_group

SHARD_ROWS = 2048
# Neighbours of a node above the lowest layer (twice as many on it), and nodes kept while building and searching.
LINKS = 12
BUILD_BREADTH = 64
SEARCH_BREADTH = 96
QUERY_BLOCK = 512


class Graph:
    """Vectors, and per layer the neighbours of its nodes in one flat array, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS):
        self.vectors, self.links = vectors, links
        self.near = vectors.astype(np.float32)
        self.nodes: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.entry = -1
        self._seen = np.zeros(len(vectors), dtype=np.int64)
        self._turn = 0

    def add_layer(self, nodes: np.ndarray, flat: np.ndarray | None = None) -> None:
        width = self.links * (1 if self.nodes else 2)
        place = np.full(len(self.vectors), -1, dtype=np.int32)
        place[nodes] = np.arange(len(nodes))
        self.nodes.append(nodes)
        self.places.append(place)
        self.tables.append(np.full((len(nodes), width), -1, dtype=np.int32) if flat is None else flat.reshape(len(nodes), width))

    def distances(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        d = self.near[nodes] - q
        return np.einsum("ij,ij->i", d, d)

    def neighbours(self, layer: int, node: int) -> np.ndarray:
        row = self.tables[layer][self.places[layer][node]]
        return row[row >= 0]

    def search_layer(self, q: np.ndarray, starts: list[tuple[float, int]], breadth: int, layer: int) -> list[tuple[float, int]]:
        """The `breadth` nearest nodes found from `starts`, nearest first."""
        self._turn += 1
        for _, node in starts:
            self._seen[node] = self._turn
        waiting, best = list(starts), [(-d, -n) for d, n in starts]
        heapq.heapify(waiting)
        heapq.heapify(best)
        while waiting:
            d, node = heapq.heappop(waiting)
            if len(best) >= breadth and d > -best[0][0]:
                break
            new = self.neighbours(layer, node)
            new = new[self._seen[new] != self._turn]
            if not len(new):
                continue
            self._seen[new] = self._turn
            away = self.distances(q, new)
            if len(best) >= breadth:
                closer = away < -best[0][0]
                new, away = new[closer], away[closer]
            for a, n in zip(away.tolist(), new.tolist(), strict=True):
                if len(best) < breadth:
                    heapq.heappush(best, (-a, -n))
                elif a < -best[0][0]:
                    heapq.heapreplace(best, (-a, -n))
                else:
                    continue
                heapq.heappush(waiting, (a, n))
        return sorted((-d, -n) for d, n in best)

    def descend(self, q: np.ndarray, layer: int) -> list[tuple[float, int]]:
        """The nearest node greedy steps find on the layers above `layer`."""
        starts = [(float(self.distances(q, np.array([self.entry]))[0]), self.entry)]
        for above in range(len(self.nodes) - 1, layer, -1):
            if self.places[above][self.entry] >= 0:
                starts = self.search_layer(q, starts, 1, above)
        return starts

    def spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of nodes by distance, those nearer to the new one than to any chosen before; the rest fill up."""
        ids = np.array([n for _, n in found])
        points = self.near[ids]
        squares = np.einsum("ij,ij->i", points, points)
        apart = squares[:, None] + squares[None, :] - 2 * points @ points.T
        chosen: list[int] = []
        for i, (d, _) in enumerate(found):
            if len(chosen) == most:
                break
            if not chosen or apart[i, chosen].min() > d:
                chosen.append(i)
        if len(chosen) < most:
            taken = set(chosen)
            chosen += [i for i in range(len(found)) if i not in taken][: most - len(chosen)]
        return ids[chosen].tolist()

    def connect(self, node: int, found: list[tuple[float, int]], layer: int) -> None:
        table, place = self.tables[layer], self.places[layer]
        mine = self.spread(found, self.links)
        table[place[node], : len(mine)] = mine
        for other in mine:
            row = table[place[other]]
            free = int((row >= 0).sum())
            if free < len(row):
                row[free] = node
                continue
            rivals = np.append(row, node)
            away = self.distances(self.near[other], rivals)
            order = np.argsort(away, kind="stable")
            row[:] = self.spread(list(zip(away[order].tolist(), rivals[order].tolist(), strict=True)), len(row))

    def build(self, levels: np.ndarray, breadth: int) -> Graph:
        for layer in range(int(levels.max()) + 1):
            self.add_layer(np.nonzero(levels >= layer)[0].astype(np.int32))
        top = -1
        for node, level in enumerate(levels.tolist()):
            if self.entry >= 0:
                q = self.near[node]
                starts = [(float(self.distances(q, np.array([self.entry]))[0]), self.entry)]
                for layer in range(top, level, -1):
                    starts = self.search_layer(q, starts, 1, layer)
                for layer in range(min(top, level), -1, -1):
                    starts = self.search_layer(q, starts, breadth, layer)
                    self.connect(node, starts, layer)
            if level > top:
                self.entry, top = node, level
        return self

    def search(self, q: np.ndarray, breadth: int) -> np.ndarray:
        q = q.astype(np.float32)
        return np.array([n for _, n in self.search_layer(q, self.descend(q, 0), breadth, 0)], dtype=np.int64)


def levels_of(n: int, links: int, seed: int) -> np.ndarray:
    """Layer of each node: a geometric draw by a seeded generator, so a shard is built alike every time."""
    draws = np.random.default_rng(seed).random(n)
    return np.floor(-np.log(1 - draws) / math.log(links)).astype(int)


def usable(vec: Column) -> Column:
    """Not null, not empty, not zero, all components finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def live_points(points: DataFrame) -> DataFrame:
    """item_id, vec (double), one row per id: of repeated ids the smallest vector counts."""
    rows = points.select("item_id", F.col("vec").cast("array<double>").alias("vec"))
    return rows.where(F.col("item_id").isNotNull() & usable(F.col("vec"))).groupBy("item_id").agg(F.min("vec").alias("vec"))


def graph_index(
    points: DataFrame, shard_rows: int = SHARD_ROWS, links: int = LINKS, breadth: int = BUILD_BREADTH
) -> tuple[DataFrame, int]:
    """The stored index of item vectors, a row per shard and dimension, and the number of shards.

    Items are dealt to shards of about `shard_rows` by a hash of item_id. In each, equal vectors
    become one node; nodes are inserted into a layered small-world graph, whose neighbour lists
    are stored flat: `layer_sizes`, `layer_nodes`, `neighbours`, next to `vectors`, and the items
    (`members`, `member_nodes`). Every usable item is indexed.
    """
    live = stored(live_points(points))
    shards = max(1, math.ceil(live.count() / shard_rows))
    schema = (
        f"shard long, size int, entry int, members array<{dict(live.dtypes)['item_id']}>, member_nodes array<int>,"
        " vectors array<double>, layer_sizes array<int>, layer_nodes array<int>, neighbours array<int>"
    )

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item_id", kind="stable")
        vectors, first, nodes = np.unique(np.vstack(rows["vec"].to_numpy()), axis=0, return_index=True, return_inverse=True)
        # by first item, as vectors in sorted order make a poor graph
        order = np.argsort(first)
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order))
        graph = Graph(vectors[order], links)
        graph.build(levels_of(len(order), links, key[0] % (1 << 32)), breadth)
        row = {
            "shard": key[0], "size": key[1], "entry": graph.entry,
            "members": rows["item_id"].to_numpy(), "member_nodes": rank[nodes.ravel()], "vectors": graph.vectors.ravel(),
            "layer_sizes": np.array([len(n) for n in graph.nodes], dtype=np.int32),
            "layer_nodes": np.concatenate(graph.nodes), "neighbours": np.concatenate([t.ravel() for t in graph.tables]),
        }
        return pd.DataFrame({k: [v] for k, v in row.items()})

    keys = F.pmod(F.xxhash64("item_id"), F.lit(shards)).alias("shard"), F.size("vec").alias("size")
    # as many tasks as shards: their bytes are few, their work is not
    dealt = live.select("item_id", "vec", *keys).repartition(shards, "shard", "size")
    built = dealt.groupBy("shard", "size").applyInPandas(run, schema)
    return stored(built), shards


def load_graph(row, links: int) -> Graph:
    graph = Graph(np.asarray(row.vectors, dtype=float).reshape(-1, row.size_), links)
    graph.entry = int(row.entry)
    at = filled = 0
    for layer, n in enumerate(row.layer_sizes):
        width = n * links * (1 if layer else 2)
        graph.add_layer(np.asarray(row.layer_nodes[at : at + n]), np.asarray(row.neighbours[filled : filled + width]))
        at, filled = at + n, filled + width
    return graph


def near_items(
    points: DataFrame,
    queries: DataFrame,
    k: int = 10,
    shard_rows: int = SHARD_ROWS,
    links: int = LINKS,
    build_breadth: int = BUILD_BREADTH,
    search_breadth: int = SEARCH_BREADTH,
) -> DataFrame:
    """query_id, rank, item_id, distance: the k nearest items found for each item named in `queries`.

    `points` holds item_id and vec of one axis; all its usable items are candidates, a query
    itself excepted. Every query is searched in every shard's graph (`graph_index`), in blocks of
    queries, and the shards' best are merged. Distances are Euclidean, in double precision on the
    original vectors, for every node a search returns; equal ones go to the smaller item_id.
    Which items are found is approximate, how near they are is not; vectors are only compared
    with those of their own length.

    A null id and a vector that is null, empty, zero or not finite throughout take no part, as
    query or as candidate. Repeated ids count once, with their smallest vector. Items of equal
    vectors share a node and are all found. Fewer than k candidates give all of them. Other
    columns are not read.
    """
    index, shards = graph_index(points, shard_rows, links, build_breadth)
    wanted = queries.select(F.col("item_id").alias("_id")).where("_id IS NOT NULL").distinct()
    asked = stored(live_points(points.join(wanted, points.item_id == wanted["_id"], "left_semi")))
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    block = F.pmod(F.xxhash64("item_id", F.lit(1)), F.lit(blocks)).alias("block")
    left = asked.select(F.col("item_id").alias("query_id"), F.col("vec").alias("q"), block, F.size("vec").alias("size"), every(shards).alias("shard"))
    right = index.withColumnRenamed("size", "size_").withColumn("size", F.col("size_")).withColumn("block", every(blocks))
    kind = dict(points.dtypes)["item_id"]
    schema = f"query_id {kind}, item_id {kind}, distance double"

    def run(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        for row in rows.itertuples() if len(asked) else ():
            graph = load_graph(row, links)
            members, owner = np.asarray(row.members), np.asarray(row.member_nodes)
            order = np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[order], np.arange(len(graph.vectors) + 1))
            for query, q in zip(asked["query_id"], asked["q"], strict=True):
                nodes = graph.search(np.asarray(q), search_breadth)
                away = np.sqrt(((graph.vectors[nodes] - np.asarray(q)) ** 2).sum(axis=1))
                # members lie in order of id; one more than k, as the query may be among them
                parts = [order[bounds[n] : min(bounds[n + 1], bounds[n] + k + 1)] for n in nodes]
                near = [(d, m) for d, p in zip(away.tolist(), parts, strict=True) for m in members[p].tolist() if m != query]
                found += [(query, m, d) for d, m in heapq.nsmallest(k, near)]
        return pd.DataFrame(found, columns=["query_id", "item_id", "distance"])

    keys, tasks = ["block", "shard", "size"], shards * blocks
    sides = [side.repartition(tasks, *keys).groupBy(*keys) for side in (left, right)]
    merged = sides[0].cogroup(sides[1]).applyInPandas(run, schema)
    ranked = top_per_group(merged, ["query_id"], [F.asc("distance"), F.asc("item_id")], k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "item_id", "distance")
