"""Hard negatives by a tree of split points that keeps distance ranges between sibling subtrees.

A row goes to the nearest split point of a node, and on to that child's own split points, until it is in a
leaf. For every two children i and j of a node the tree knows the least and the greatest distance between
split point i and the rows below j. A search has a window of scores. As
|q - x|^2 = |q|^2 + |x|^2 - 2 * score, a window is an annulus around q; by the triangle inequality every
range bounds the distances from q to the rows below j, and a subtree whose bounds miss the annulus is not visited.
Leaves are searched exactly, by whole inner products.

Split points come from a sample of at most `SAMPLE` rows and `SAMPLE_BYTES` (those of the least id hashes);
the ranges are of all rows, and every row is in a leaf. A search takes two steps. Every query first visits its own
leaf; its k-th best score there raises the lower end of its window. Then it visits all other leaves whose bounds meet
the window. So results are exact, and the tree only saves visits. Vectors without any structure are
at about the same distance from each other, and nothing can be saved for them.

A leaf's rows are dealt into blocks and its queries into chunks of bounded size, by a hash of their
ids, so a group of copies that holds a third of all rows is searched by many tasks. Only sample, ranges and row counts of
leaves reach the driver; the tree has at most `MOST_LEAVES` leaves.

Odd rows. Rows with a null id, label or vector, with a null or non-finite component, or with one
beyond 65,536 in size (whose products leave 64 bits) take no part. Shorter vectors count as filled up with
zeros. Several rows of one id are rows of their own; the rows with the anchor's id are never its positives or
negatives. An anchor that is repeated as it is counts once; two different anchors of one id each give their rows. Equal scores go by
id. Extra columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from barscreen.llm.common import stored

FAN = 16
LEAF_ROWS = 4096
SAMPLE, SAMPLE_BYTES = 16_384, 1 << 24
MOST_LEAVES = 4096
BLOCK_ROWS, CHUNK_ROWS = 8192, 4096
CELLS = 1 << 22
LARGEST = 1 << 24
QUERY = ["anchor_id", "twin"]
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def whole_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, vec): components times `scale`, rounded down, of the rows that take part."""
    infinite = float("inf")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite) | (F.abs(x) * scale > LARGEST))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~odd).select(
        "vec_id",
        F.col("label").cast("bigint").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("vec"),
    )


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of lists as rows of `dim` numbers, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) == len(column) * dim:
        return values.reshape(len(column), dim)
    out = np.zeros((len(column), dim), np.int32)
    row = np.repeat(np.arange(len(column)), np.diff(ends))
    out[row, np.arange(len(values)) - ends[row]] = values
    return out


def exact_type(most: int, dim: int) -> type:
    """The fastest type in which every partial sum of a product is exact."""
    bound = most * most * max(dim, 1)
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


def squares(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    return np.einsum("ij,ij->i", wide, wide)


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    d = squares(x)[:, None] + squares(points)[None] - 2 * (x.astype(np.float64) @ points.T.astype(np.float64))
    return np.sqrt(np.maximum(d, 0))


class Node:
    """Split points and, for each, the child node or the number of a leaf."""

    def __init__(self, number: int, points: np.ndarray):
        self.number, self.points = number, points
        self.children: list[Node | int] = []
        #: Least and greatest distance of split point i (row) from the rows below child j (column).
        self.near = np.full((len(points), len(points)), np.inf)
        self.far = np.zeros((len(points), len(points)))


class Tree:
    """Split points fitted to a sample; `learn` adds the ranges and `norms` of all rows."""

    def __init__(self, sample: np.ndarray, rows: int, leaf_rows: int = LEAF_ROWS, fan: int = FAN):
        self.nodes: list[Node] = []
        self.leaves = 0
        self.fan, self.leaf_rows, self.each = fan, leaf_rows, rows / max(1, len(sample))
        self.root = self._grown(np.unique(sample, axis=0) if sample.shape[1] else sample[:1], sample)
        self.norms = np.zeros((self.leaves, 2))

    def _grown(self, distinct: np.ndarray, sample: np.ndarray) -> Node | int:
        enough = len(sample) * self.each > self.leaf_rows and len(sample) >= 2 * self.fan
        if not enough or len(distinct) < 2 or self.leaves + self.fan > MOST_LEAVES:
            self.leaves += 1
            return self.leaves - 1
        node = Node(len(self.nodes), self._spread(distinct))
        self.nodes.append(node)
        below, of = (np.argmin(distances(x, node.points), axis=1) for x in (distinct, sample))
        for j in range(len(node.points)):
            node.children.append(self._grown(distinct[below == j], sample[of == j]))
        return node

    def _spread(self, rows: np.ndarray) -> np.ndarray:
        """Rows far from each other: each next one is the farthest from those taken."""
        some = rows[np.linspace(0, len(rows) - 1, min(len(rows), 64 * self.fan)).astype(int)]
        taken = [int(np.argmin(distances(some, some.mean(0, keepdims=True))[:, 0]))]
        gap = distances(some, some[taken])[:, 0]
        while len(taken) < self.fan and gap.max() > 0:
            taken.append(int(np.argmax(gap)))
            gap = np.minimum(gap, distances(some, some[taken[-1:]])[:, 0])
        return some[taken]

    def leaf_of(self, x: np.ndarray, seen=None) -> np.ndarray:
        """Leaf of every row; `seen(node, child, distances)` is told of every step."""
        out = np.zeros(len(x), np.int32)
        below = [(self.root, np.arange(len(x)))]
        while below:
            node, rows = below.pop()
            if not isinstance(node, Node):
                out[rows] = node
                continue
            d = distances(x[rows], node.points)
            child = np.argmin(d, axis=1)
            for j in np.unique(child).tolist():
                mine = child == j
                if seen:
                    seen(node, j, d[mine])
                below.append((node.children[j], rows[mine]))
        return out

    def learn(self, ranges: list) -> None:
        """Take the collected (node, i, j, least, greatest); node -1 gives the squares of the vectors in leaf j."""
        for number, i, j, least, greatest in ranges:
            if number < 0:
                self.norms[j] = least, greatest
            else:
                self.nodes[number].near[i, j], self.nodes[number].far[i, j] = least, greatest

    def bounds(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) pairs whose leaf may hold a score from `low` to `high` of that query.

        The bounds of a node hold for all below it, so a subtree that misses the annulus is left at once.
        """
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        size, norms = squares(q), self.norms
        slack = 0.5 + 1e-9 * (size + (norms[:, 1].max() if len(norms) else 0))
        # Norms of a subtree are not kept apart: inner nodes take those of the whole tree, leaves their own.
        whole = np.array([norms[:, 0].min(), norms[:, 1].max()])
        below = [(self.root, np.arange(len(q)), np.zeros(len(q)), np.full(len(q), np.inf))]
        while below:
            node, rows, least, greatest = below.pop()
            norm = whole if isinstance(node, Node) else norms[node]
            best = (size[rows] + norm[1] - least**2) / 2 + slack[rows]
            worst = (size[rows] + norm[0] - greatest**2) / 2 - slack[rows]
            may = (best >= low[rows]) & (worst <= high[rows])
            rows, least, greatest = rows[may], least[may], greatest[may]
            if not len(rows):
                continue
            if not isinstance(node, Node):
                found.append((rows, np.full(len(rows), node)))
                continue
            d = distances(q[rows], node.points)
            for j, child in enumerate(node.children):
                if not np.isfinite(node.near[0, j]):
                    continue  # no row below
                close = np.maximum(node.near[:, j] - d, d - node.far[:, j]).max(axis=1)
                wide = (d + node.far[:, j]).min(axis=1)
                below.append((child, rows, np.maximum(least, close), np.minimum(greatest, wide)))
        return tuple(np.concatenate(x) for x in zip(*found))


class Index:
    """All rows with their leaves, and the tree over them."""

    def __init__(self, rows: DataFrame, leaf_rows: int = LEAF_ROWS, fan: int = FAN):
        kept = stored(rows, "vectors")
        size = F.array_max(F.transform("vec", F.abs))
        count, dim, most = kept.agg(F.count("*"), F.max(F.size("vec")), F.max(size)).first()
        self.dim, self.type = dim or 0, exact_type(most or 0, dim or 0)
        bound = max(2 * fan, min(SAMPLE, SAMPLE_BYTES // (4 * max(1, self.dim))))
        sample = kept.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(bound).select("vec").toArrow()
        self.tree = Tree(matrix(sample.column("vec"), self.dim), count, leaf_rows, fan)
        self.rows = stored(kept.mapInArrow(self._leaves(), "vec_id long, label long, vec array<int>, leaf int"), "leaves")
        ranges = self.rows.select("vec", "leaf").mapInArrow(self._ranges(), "node int, i int, j int, least double, greatest double")
        ranges = ranges.groupBy("node", "i", "j").agg(F.min("least"), F.max("greatest"))
        self.tree.learn([tuple(r) for r in ranges.collect()])

    def _leaves(self):
        tree, dim = self.tree, self.dim

        def leaves(batches):
            for batch in batches:
                leaf = tree.leaf_of(matrix(batch.column("vec"), dim))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

        return leaves

    def _ranges(self):
        tree, dim = self.tree, self.dim

        def ranges(batches):
            held: dict[tuple[int, int, int], tuple[float, float]] = {}

            def widen(key, least, greatest):
                a, b = held.get(key, (np.inf, -np.inf))
                held[key] = min(a, float(least)), max(b, float(greatest))

            def seen(node, j, d):
                for i, (least, greatest) in enumerate(zip(d.min(0), d.max(0))):
                    widen((node.number, i, j), least, greatest)

            for batch in batches:
                x = matrix(batch.column("vec"), dim)
                leaf, norm = tree.leaf_of(x, seen), squares(x)
                for j in np.unique(leaf).tolist():
                    widen((-1, 0, j), norm[leaf == j].min(), norm[leaf == j].max())
            keys = list(zip(*held)) or [[]] * 3
            limits = list(zip(*held.values())) or [[]] * 2
            columns = [pa.array(k, pa.int32()) for k in keys] + [pa.array(v, pa.float64()) for v in limits]
            yield pa.RecordBatch.from_arrays(columns, ["node", "i", "j", "least", "greatest"])

        return ranges

    def _visits(self, home: bool):
        """Queries with the leaves they visit: their own, or all others that may hold a row for a window."""
        tree, dim = self.tree, self.dim

        def visits(batches):
            for batch in batches:
                for begin in range(0, batch.num_rows, 256):
                    part = batch.slice(begin, 256)
                    q = matrix(part.column("vec"), dim)
                    own = tree.leaf_of(q)
                    query, leaf = np.arange(len(q)), own
                    if not home:
                        windows = part.column("windows")
                        lows, highs = (windows.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("low", "high"))
                        begins = np.concatenate([[0], np.cumsum(windows.value_lengths().to_numpy(zero_copy_only=False))[:-1]]).astype(np.int64)
                        low, high = np.minimum.reduceat(lows, begins), np.maximum.reduceat(highs, begins)
                        query, leaf = tree.bounds(q, low.astype(np.float64), high.astype(np.float64))
                        other = leaf != own[query]
                        query, leaf = query[other], leaf[other]
                    taken = part.take(pa.array(query))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaf, pa.int32())], [*part.schema.names, "leaf"])

        return visits

    def visits(self, queries: DataFrame, home: bool) -> DataFrame:
        return queries.mapInArrow(self._visits(home), StructType([*queries.schema.fields]).add("leaf", IntegerType()))

    def met(self, visits: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor_id, twin, tag, vec_id, score): up to `k` best of every window from each block of rows."""
        asked = visits.groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK_ROWS).alias("chunks"))
        held = self.rows.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
        parts = F.broadcast(held.join(asked, "leaf"))  # a row a leaf
        blocks = F.pmod(F.xxhash64("vec_id", "vec"), "blocks").alias("block")
        chunks = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
        rows = self.rows.join(parts, "leaf").select("vec_id", "label", "vec", "leaf", blocks, chunks)
        chunk = F.pmod(F.xxhash64(*QUERY), "chunks").alias("chunk")
        block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        queries = visits.join(parts, "leaf").select(*QUERY, "label", "vec", "windows", "leaf", chunk, block)
        tile = ["leaf", "block", "chunk"]
        met = rows.groupBy(*tile).cogroup(queries.groupBy(*tile))
        schema = "anchor_id long, twin long, tag int, vec_id long, score long"
        return met.applyInArrow(searched(self.dim, self.type, same, k), schema)

    def search(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor_id, twin, tag, vec_id, score, rank): the `k` best rows of every window.

        `queries`: (anchor_id, twin, label, vec, windows), windows an array of (tag, low, high), low
        and high scores included; `same` asks for rows of the same label, else of other labels.
        """
        first = stored(self.met(self.visits(queries, home=True), same, k), "own-leaves")
        kth = first.groupBy(*QUERY, "tag").agg(F.count("*").alias("n"), F.min("score").alias("low"))
        raised = kth.where(F.col("n") >= k).groupBy(*QUERY).agg(
            F.map_from_entries(F.collect_list(F.struct("tag", "low"))).alias("raised")
        )
        windows = F.transform(
            "windows",
            lambda w: F.struct(
                w["tag"].alias("tag"),
                F.greatest(w["low"], F.coalesce(F.element_at("raised", w["tag"]), w["low"])).alias("low"),
                w["high"].alias("high"),
            ),
        )
        narrowed = queries.join(raised, QUERY, "left").withColumn("windows", windows).drop("raised")
        narrowed = stored(self.visits(narrowed, home=False), "visits")
        every = first.unionByName(self.met(narrowed, same, k))
        best = W.partitionBy(*QUERY, "tag").orderBy(F.desc("score"), "vec_id")
        return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def searched(dim: int, kind: type, same: bool, k: int):
    """The exact search of a block of rows for a chunk of queries."""

    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["anchor_id", "twin", "tag", "vec_id", "score"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 5]
        if rows.num_rows and queries.num_rows:
            x, q = (matrix(t.column("vec"), dim).astype(kind) for t in (rows, queries))
            ids, label = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
            anchor, twin, anchor_label = (queries.column(c).to_numpy() for c in ("anchor_id", "twin", "label"))
            windows = queries.column("windows").combine_chunks()
            of = np.repeat(np.arange(len(q)), windows.value_lengths().to_numpy(zero_copy_only=False))
            tag, low, high = (windows.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("tag", "low", "high"))
            step = max(1, CELLS // len(ids))
            for begin in range(0, len(of), step):
                part = slice(begin, begin + step)
                mine = of[part]
                distinct, back = np.unique(mine, return_inverse=True)
                score = (q[distinct] @ x.T)[back]
                fits = (anchor_label[mine, None] == label) == same
                fits &= (anchor[mine, None] != ids) & (score >= low[part, None]) & (score <= high[part, None])
                many = np.flatnonzero(fits.sum(1) > k)
                if len(many):
                    worth = np.where(fits[many], score[many].astype(np.float64), -np.inf)
                    fits[many] &= worth >= np.partition(worth, len(ids) - k, axis=1)[:, len(ids) - k, None]
                r, c = np.nonzero(fits)
                s = score[r, c].astype(np.int64)
                order = np.lexsort((ids[c], -s, r))
                r, c, s = r[order], c[order], s[order]
                first = np.searchsorted(r, r, "left")
                kept = np.arange(len(r)) - first < k
                r, c, s = r[kept], c[kept], s[kept]
                found.append([anchor[mine[r]], twin[mine[r]], tag[part][r], ids[c], s])
        arrays = [pa.array(np.concatenate(x), t) for x, t in zip(zip(*found), kinds)]
        return pa.Table.from_arrays(arrays, names)

    return search


def share(score: Column, percent: int, up: bool) -> Column:
    """`percent` hundredths of a score as a whole number, rounded up or down."""
    part = score * F.lit(-percent if up else percent)
    down = F.call_function("div", part - F.pmod(part, F.lit(100)), F.lit(100))
    return -down if up else down


def mined(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
    leaf_rows: int = LEAF_ROWS,
    fan: int = FAN,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `vectors` and `anchors` as `whole_vectors` gives them; anchors are some of the rows. Of each anchor's
    `positives` best rows of its label, every one gets the `negatives` best rows of other labels with
    `least` to `most` hundredths of the positive's score.
    """
    index = Index(vectors, leaf_rows, fan)
    asked = anchors.distinct().select(
        F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "vec").alias("twin"), "label", "vec"
    )
    window = F.struct(F.lit(0).alias("tag"), F.lit(LOWEST).cast("bigint").alias("low"), F.lit(HIGHEST).cast("bigint").alias("high"))
    asked = stored(asked.withColumn("windows", F.array(window)), "anchors")
    near = index.search(asked, True, positives)
    near = stored(
        near.select(*QUERY, F.col("rank").alias("tag"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
        "positives",
    )
    bounds = F.struct(
        F.col("tag"),
        share(F.col("positive_score"), least, True).alias("low"),
        share(F.col("positive_score"), most, False).alias("high"),
    )
    windows = near.select(*QUERY, bounds.alias("window")).where("window.low <= window.high")
    windows = windows.groupBy(*QUERY).agg(F.sort_array(F.collect_list("window")).alias("windows"))
    hard = index.search(asked.drop("windows").join(windows, QUERY), False, negatives)
    return hard.join(near, [*QUERY, "tag"]).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
