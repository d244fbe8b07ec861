"""Hard-negative mining by a two-dimensional block matrix product.

Rows and dimensions are cut into blocks.  A panel of anchors and a block of rows
meet at their place in the grid with all chunks of dimensions.  The chunks'
products are partial tiles of scores, which are added where they are made, and
what is asked for is reduced inside each whole tile: the best positives first,
then, with the tiles made again, the best negatives in the window that each
positive sets.  So rows and anchors are moved, and never a score that isn't
among the best of its tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_intermediates, intermediates, materialise, plain

#: Rows of a block, anchors of a panel, anchors of a tile: a tile of int64 scores has at most 8 MB.
ROWS, PANEL, STRIPE = 32_768, 16_384, 32
#: Bytes of a block or panel as 64-bit numbers; those of very many dimensions have fewer rows.
BYTES = 16 << 20
#: Rows of a block at least, where there are fewer blocks than tasks that run together.
FEWEST = 2_048
#: Chunks that the dimensions are cut into.
CHUNKS = 2
#: Tasks that rows are dealt to at most; beyond it a task cuts several blocks.
TASKS = 10_000
#: Anchors' positives are sent to every task that joins them to their anchors up to so many bytes, and shuffled beyond.
SENT = 8 << 20

_BLOCK = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("chunk", pa.int32()), ("rows", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("places", pa.binary()), ("data", pa.binary())])
BLOCK = "kind string, part int, seq bigint, chunk int, rows int, ids binary, labels binary, places binary, data binary"
PIECE = ["part", "seq"]
BEST = "part int, seq bigint, a int, anchor_id bigint, id bigint, score bigint"
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
FOUND = "part int, seq bigint, a int, k int, negative_id bigint, negative_score bigint"


def integers(vector: Column, scale: int = 256) -> Column:
    """Components as whole numbers: floor of ``scale`` times each, as doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("long"))


def usable(vector: Column, label: Column) -> Column:
    """Whether a row takes part: a label, a vector, and no component that is null or not finite."""
    bad = F.exists(vector, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return label.isNotNull() & vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _narrow(x: np.ndarray) -> tuple[bytes, bytes]:
    """Whole numbers in as few bytes as they need: the type's size first."""
    for kind in (np.int8, np.int16, np.int32):
        if not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()
    return bytes([8]) + x.tobytes()


def _read(data: bytes, rows: int) -> np.ndarray:
    kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[data[0]]
    return np.frombuffer(data, kind, offset=1).reshape(rows, -1)


def _kind(a: list[np.ndarray], b: list[np.ndarray]) -> type:
    """The type in which the sum of all chunks' products is exact: floats for small numbers, else int64."""
    most = [max((max(-float(x.min()), float(x.max())) for x in side if x.size), default=0.0) for side in (a, b)]
    bound = most[0] * most[1] * sum(x.shape[1] for x in a)
    return np.float32 if bound < 2.0**24 else np.float64 if bound < 2.0**53 else np.int64


def scores(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """A tile: the sum of the partial tiles of the chunks, of numbers that ``_kind`` has chosen; int64 sums wrap."""
    total = a[0] @ b[0].T
    for x, y in zip(a[1:], b[1:], strict=True):
        total += x @ y.T
    return total


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times the transpose of b, in int64: through floats where every sum is exact in them; sums beyond 64 bits wrap."""
    kind = _kind([a], [b])
    return scores([a.astype(kind)], [b.astype(kind)]).astype(np.int64)


def _sizes(dims: int) -> tuple[int, int]:
    """Rows of a block and anchors of a panel at most."""
    widest = max(1, BYTES // (8 * max(1, dims)))
    return min(ROWS, widest), min(PANEL, widest)


def _blocks(rows: DataFrame, count: int, dims: int, chunks: int, every: Column) -> DataFrame:
    """Blocks of rows and panels of anchors, a row for each chunk of dimensions; ``place`` tells a row from all others."""
    width = max(1, -(-dims // chunks))
    size, panel = _sizes(dims)

    def cut(kind: str, seq: int, ids: np.ndarray, labels: np.ndarray, places: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        for chunk in range(chunks):
            part = data[:, chunk * width : (chunk + 1) * width]
            columns = [[kind], [TaskContext.get().partitionId()], [seq], [chunk], [len(ids)], [ids.tobytes()], [labels.tobytes()], [places.tobytes()], [_narrow(part)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BLOCK.types, strict=True)], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {"row": [], "anchor": []}
        made = {"row": 0, "anchor": 0}
        most = {"row": size, "anchor": panel}

        def flush(kind: str) -> Iterator[pa.RecordBatch]:
            parts, held[kind] = held[kind], []
            if parts:
                order = np.argsort(ids := np.concatenate([p[0] for p in parts]), kind="stable")  # ties by id are ties by place in a block
                yield from cut(kind, made[kind], ids[order], *(np.concatenate([p[i] for p in parts])[order] for i in (1, 2, 3)))
                made[kind] += 1

        for batch in batches:
            for lo in range(0, batch.num_rows, min(panel, 1024)):
                part = batch.slice(lo, min(panel, 1024))
                vectors = part.column("v")
                lengths = np.diff(vectors.offsets.to_numpy())
                data = np.zeros((part.num_rows, max(1, dims)), np.int64)
                flat = vectors.flatten().to_numpy()
                data[np.arange(dims or 1)[None, :] < lengths[:, None]] = flat
                columns = [part.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "place")] + [data]
                for kind, chosen in (("row", slice(None)), ("anchor", np.flatnonzero(part.column("anchor").to_numpy(zero_copy_only=False)))):
                    new = [c[chosen] for c in columns]
                    while len(new[0]):
                        room = most[kind] - sum(len(p[0]) for p in held[kind])
                        held[kind].append([c[:room] for c in new])
                        new = [c[room:] for c in new]
                        if room <= len(held[kind][-1][0]):
                            yield from flush(kind)
        for kind in held:
            yield from flush(kind)

    together = rows.sparkSession.sparkContext.defaultParallelism
    tasks = min(TASKS, max(1, -(-count // size), min(together, -(-count // FEWEST))))
    dealt = rows.withColumn("anchor", F.coalesce(every, F.lit(False))).repartition(int(tasks))
    placed = dealt.select("vec_id", "label", "anchor", "v", F.monotonically_increasing_id().alias("place"))
    return materialise(placed.mapInArrow(run, BLOCK), "negatives-blocks")


class _Part:
    """A block of rows, or a piece of a panel, with all its chunks; rows are in order of id."""

    def __init__(self, chunks: list[dict]):
        chunks.sort(key=lambda r: r["chunk"])
        r = chunks[0]
        self.key = (r["part"], r["seq"])
        self.ids, self.labels, self.places = (np.frombuffer(r[c], np.int64) for c in ("ids", "labels", "places"))
        self.data = [_read(x["data"], x["rows"]) for x in chunks]
        self.asked = r.get("asked")


def _parts(table: pa.Table) -> list[_Part]:
    found: dict[tuple, list[dict]] = {}
    for batch in table.to_batches():
        for r in batch.to_pylist():
            found.setdefault((r["part"], r["seq"]), []).append(r)
    return [_Part(found[key]) for key in sorted(found)]


class Grid:
    """Panels of anchors against blocks of rows."""

    def __init__(self, blocks: DataFrame, panel: int):
        # for each task how many rows it has of a kind, and blocks
        had = sorted(blocks.where("chunk = 0").groupBy("kind", "part").agg(F.max("seq").alias("last"), F.sum("rows").alias("rows")).collect())
        self.anchors, self.blocks = 0, 0
        before, firsts = [], []
        for r in had:
            if r.kind == "anchor":
                before.append((r.part, self.anchors))
                self.anchors += r["rows"]
            else:
                firsts.append((r.part, self.blocks))
                self.blocks += r["last"] + 1
        self.panels = -(-self.anchors // panel)
        spark = blocks.sparkSession
        of = lambda kind, table, name: blocks.where(F.col("kind") == kind).drop("kind").join(F.broadcast(spark.createDataFrame(table, f"part int, {name} bigint")), "part")
        # the tasks' pieces of anchors, of which all but the last of a task are full, are put together to panels
        self.left = of("anchor", before, "before").withColumn("panel", F.expr(f"(before + seq * {panel}L) div {panel}L")).drop("before")
        right = of("row", firsts, "first").withColumn("block", F.col("first") + F.col("seq")).drop("first")
        self.right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides are of one table: columns of their own

    def meet(self, left: DataFrame, work, ddl: str) -> DataFrame:
        """What ``work`` makes of each piece of a panel and each block, with all chunks; a task has one panel and one block at a time."""
        spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        # each panel goes along a row of the grid, each block of rows down a column
        sides = [left.withColumn("block", spread(self.blocks)), self.right.withColumn("panel", spread(self.panels))]
        n = int(min(TASKS, 2 * self.panels * self.blocks))  # places are told apart by hash
        sides = [x.repartition(n, "panel", "block").groupBy("panel", "block") for x in sides]
        schema = pa.schema([(name, {"int": pa.int32(), "bigint": pa.int64()}[kind]) for name, kind in (c.split() for c in ddl.split(", "))])

        def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
            out = [c for b in _parts(rows) for a in _parts(anchors) for c in work(a, b)]
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[] for _ in schema]
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        return sides[0].cogroup(sides[1]).applyInArrow(run, ddl)


def best(s: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` best of some places: higher scores first, then smaller ids, which is smaller places."""
    s = s[among]
    if len(among) > n:
        keep = s >= np.partition(s, -n)[-n]
        among, s = among[keep], s[keep]
    return among[np.argsort(-s.astype(np.float64) if np.abs(s).max(initial=0) < 2**53 else np.array([-int(v) for v in s], object), kind="stable")][:n]


def _rows_of(key: tuple, columns: list[list]) -> list[tuple]:
    """Columns of one piece's results as arrays, its key first."""
    size = len(columns[0])
    return [(*(np.full(size, x) for x in key), *(np.array(c, np.int64) for c in columns))] if size else []


def _positives(n: int):
    """Of each anchor's rows of its own label the ``n`` best, without its own."""

    def work(a: _Part, b: _Part) -> list[tuple]:
        kind = _kind(a.data, b.data)
        by_label, anchors = np.argsort(b.labels, kind="stable"), np.argsort(a.labels, kind="stable")  # ties by label stay in order of id
        labels = b.labels[by_label]
        order = np.argsort(b.places)
        at = np.minimum(np.searchsorted(b.places, a.places, sorter=order), len(order) - 1)
        own = np.where(b.places[order[at]] == a.places, order[at], -1)  # where in the block an anchor's own row is
        edge = np.flatnonzero(np.concatenate(([True], np.diff(a.labels[anchors]) != 0, [True])))
        out: list[list] = [[] for _ in range(4)]
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            label = a.labels[anchors[lo]]
            same = by_label[np.searchsorted(labels, label) : np.searchsorted(labels, label, "right")]
            if not len(same):
                continue
            rows = [x[same].astype(kind) for x in b.data]
            for first in range(lo, hi, STRIPE):
                stripe = anchors[first : min(first + STRIPE, hi)]
                tile = scores([x[stripe].astype(kind) for x in a.data], rows)
                for i, s in zip(stripe.tolist(), tile, strict=True):
                    found = best(s, np.flatnonzero(same != own[i]), n)
                    for c, x in zip(out, ([i] * len(found), [int(a.ids[i])] * len(found), b.ids[same[found]].tolist(), s[found].astype(np.int64).tolist()), strict=True):
                        c += x
        return _rows_of(a.key, out)

    return work


def _negatives(n: int, window: tuple[int, int]):
    """For each anchor and each of its positives the ``n`` best rows of other labels in the positive's window."""

    def work(a: _Part, b: _Part) -> list[tuple]:
        kind = _kind(a.data, b.data)
        asked: dict[int, list[tuple[int, int, int]]] = {}
        for x in a.asked:
            asked.setdefault(x["a"], []).append((x["k"], *bounds(x["score"], window)))
        anchors = np.array(sorted(asked), np.int64)
        rows = [x.astype(kind) for x in b.data]
        out: list[list] = [[] for _ in range(4)]
        for first in range(0, len(anchors), STRIPE):
            stripe = anchors[first : first + STRIPE]
            tile = scores([x[stripe].astype(kind) for x in a.data], rows)
            # a bound that the type rounds is beyond all of the tile's scores
            least = np.array([min(x[1] for x in asked[i]) for i in stripe.tolist()]).astype(kind)
            most = np.array([max(x[2] for x in asked[i]) for i in stripe.tolist()]).astype(kind)
            line, places = np.nonzero((tile >= least[:, None]) & (tile <= most[:, None]))
            other = b.labels[places] != a.labels[stripe[line]]
            line, places = line[other], places[other]
            edge = np.searchsorted(line, np.arange(len(stripe) + 1)).tolist()
            for at, (i, s) in enumerate(zip(stripe.tolist(), tile, strict=True)):
                if edge[at] == edge[at + 1]:
                    continue
                among = places[edge[at] : edge[at + 1]]
                near = s[among]
                for k, lo, hi in asked[i]:
                    found = best(s, among[(near >= kind(lo)) & (near <= kind(hi))], n)
                    for c, x in zip(out, ([i] * len(found), [k] * len(found), b.ids[found].tolist(), s[found].astype(np.int64).tolist()), strict=True):
                        c += x
        return _rows_of(a.key, out)

    return work


def bounds(score: int, window: tuple[int, int]) -> tuple[int, int]:
    """The least and the greatest negative score of a window in hundredths of a positive's score."""
    return -(-window[0] * score // 100), window[1] * score // 100


def hard_negatives(vectors: DataFrame, every: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), chunks: int = CHUNKS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and v (whole numbers); rows where ``every``
    holds are anchors.  An anchor's positives are its best other rows of the same
    label, and each one's negatives the best rows of other labels whose score is
    at least ``window[0]`` and at most ``window[1]`` hundredths of its own; higher
    scores come first, then smaller ids.

    Tiles are made twice, for the positives and then for the negatives, and are
    never written: what is moved is rows once for each panel of anchors, anchors
    once for each block of rows, and the best of each block.  Positives go with
    their anchors, sent to the tasks where they are small (``SENT``).

    Defined results: rows without an id take no part; rows that repeat are rows
    each, also as anchors, and a row is never its own positive; shorter vectors
    count as 0 beyond their end, null components as 0; anchors without a positive, and positives
    without a negative in their window, give no rows; sums beyond 64 bits wrap.
    """
    spark = vectors.sparkSession
    mark = intermediates(spark)
    rows = plain(vectors, "vec_id", "label", "v").where("vec_id is not null and label is not null and v is not null")
    whole_numbers = F.transform("v", lambda x: F.coalesce(x.cast("long"), F.lit(0).cast("long")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole_numbers.alias("v"))
    count, dims, anchors = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count_if(F.coalesce(every, F.lit(False)))).first()
    grid = Grid(_blocks(rows, count, dims, chunks, every), _sizes(dims)[1])
    if not grid.anchors:
        drop_intermediates(spark, mark)
        return spark.createDataFrame([], RESULT)
    w = Window.partitionBy(*PIECE, "a").orderBy(F.desc("score"), "id")
    each = grid.meet(grid.left, _positives(positives), BEST).withColumn("k", F.row_number().over(w)).where(F.col("k") <= positives)
    each = materialise(each, "negatives-positives")
    asked = each.groupBy(*PIECE).agg(F.array_sort(F.collect_list(F.struct("a", "k", "score"))).alias("asked"))  # at most a panel's anchors times the positives
    left = grid.left.join(F.broadcast(asked) if anchors * positives * 40 <= SENT else asked, PIECE)
    found = grid.meet(left, _negatives(negatives, window), FOUND)
    w = Window.partitionBy(*PIECE, "a", "k").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    ranked = ranked.join(each.withColumnsRenamed({"id": "positive_id", "score": "positive_score"}), [*PIECE, "a", "k"])
    out = materialise(ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives", keep=True)
    drop_intermediates(spark, mark)
    return out


def mined(embeddings: DataFrame) -> DataFrame:
    """The hard negatives of ``embeddings`` (vec_id, embedding, label) under the contract: labels of every seventh id moved on by one, components as floor(256 x), every fiftieth id an anchor."""
    own = plain(embeddings, "vec_id", "embedding", "label").where(usable(F.col("embedding"), F.col("label")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(own.select("vec_id", label.alias("label"), integers(F.col("embedding")).alias("v")), F.col("vec_id") % 50 == 0)


def oracle_sql() -> str:
    return """
        WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
          FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
        p AS (SELECT ar, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) AS k FROM s WHERE same),
        n AS (SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.ar, p.k ORDER BY s.score DESC, s.id)::INTEGER AS rank
          FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score WHERE p.k <= 5)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
    """
