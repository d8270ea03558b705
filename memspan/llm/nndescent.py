"""Embedding near-duplicates by NN-descent.

Equal vectors of a label are one class. Classes get first neighbours inside cells of
random hyperplanes; then lists are refined through neighbours of neighbours: whoever
lists, or is listed by, the same class is compared, if one of these entries is new. Lists
hold ``LIST`` neighbours. A class whose list is full of links is saturated: its list is enlarged to all saturated
classes of its label, which are compared in blocks that are counted, not listed. Blocks
are chunks of linked groups; two chunks are left out only if their centres are further
apart than their radii and the threshold's angle, so no link is between them.
A bounded sample of queries against all rows audits the recall: the mean share of its
links that a query finds, apart for queries with at most as many links as a list holds
and for those with more. More are asked, of a small table all, where few have links. While either is below the target, cells of further hyperplanes
are added and lists are refined again; where that does not reach it, all classes of a
label are compared in blocks, which is exact. ``report`` tells what was measured.

Tables of pairs and cells carry class numbers; vectors join them once, where they are
compared. Cells and hubs with many members are dealt to several groups under a salt.

Every link is a pair that was compared in double precision and reached the threshold.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components,
and those without a label, link with nothing. Vectors of unequal length do not link. Ids
are of any type with an order. Rows that repeat an id are vectors of their own; a component
is named by its smallest id that is not null. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspan.llm.common import columns, small_batches
from memspan.llm.components import connected_components
from memspan.sources.tables import checkpoint

THRESHOLD = 0.93
#: Neighbours in a list, rows of a cell, rows of a block, hyperplane tables of a pass.
LIST, CELL, BLOCK, TABLES = 10, 256, 1024, 4
#: Queries that the audit asks first, the recall to reach, and passes and refinements at most.
AUDIT, RECALL, PASSES, ROUNDS = 512, 0.98, 3, 3
#: Queries with links that the audit is meant to have, queries that it asks at most to find them (its sample's bound), and how near a listed neighbour makes a link likely.
LINKED_ASKED, MOST_ASKED, LIKELY = 64, 16_384, 0.8
CODE_BITS = 30
#: List entries of a bucket of hubs that one call refines; members of a hub that are compared at once.
BUCKET_ROWS, HUB = 8192, 64
#: Parts into which the rows of a crowded key are dealt before they meet its size.
PARTS = 32


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors, packed = batch.column(3).to_pylist(), [b""] * batch.num_rows
        for dim in {len(v) for v in vectors}:
            at = [i for i, v in enumerate(vectors) if len(v) == dim]
            for i, row in zip(at, _unit([vectors[i] for i in at]), strict=True):
                packed[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(packed, pa.binary())], names=["id", "grp", "n", "u"])


def _codes(first: int, count: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sides of random hyperplanes, for ``count`` tables."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            sizes = rows["u"].map(len)
            for size in sizes.unique():
                some = rows[sizes == size]
                x = _matrix(some["u"])
                for table in range(first, first + count):
                    planes = np.random.default_rng([table, x.shape[1]]).standard_normal((x.shape[1], CODE_BITS))
                    code = ((x @ planes) > 0) @ (1 << np.arange(CODE_BITS))
                    yield pd.DataFrame({"id": some["id"], "grp": some["grp"], "table": table, "code": code.astype(np.int64)})

    return run


def _nearest(ids: np.ndarray, x: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its ``keep`` nearest other rows: ids, neighbours, cosines."""
    s = x @ x.T
    np.fill_diagonal(s, -2.0)
    k = min(keep, len(ids) - 1)
    if k < 1:
        return ids[:0], ids[:0], s[0, :0]
    top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(ids) - 1 else np.argsort(-s, axis=1)[:, :k]
    return np.repeat(ids, k), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel()


def _cell(keep: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, s = _nearest(rows["id"].to_numpy(), _matrix(rows["u"]), keep)
        return pd.DataFrame({"id": a, "nbr": b, "sim": s})

    return run


def _local_join(keep: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Compares the members of each hub of a bucket; returns what beats a member's last neighbour."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["hub", "salt"], kind="stable")
        hub, ids, last = (rows[c].to_numpy() for c in ("hub", "id", "last"))
        salt = rows["salt"].to_numpy()
        x = _matrix(rows["u"]) if rows["u"].map(len).nunique() == 1 else None
        cuts = np.flatnonzero((hub[1:] != hub[:-1]) | (salt[1:] != salt[:-1])) + 1
        out = []
        for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True):
            if hi - lo < 2:
                continue
            a, b, s = _nearest(ids[lo:hi], x[lo:hi] if x is not None else _matrix(rows["u"].iloc[lo:hi]), keep)
            better = s > np.repeat(last[lo:hi], len(s) // (hi - lo))
            out.append((a[better], b[better], s[better]))
        a, b, s = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (ids[:0], ids[:0], last[:0])
        return pd.DataFrame({"id": a, "nbr": b, "sim": s}).drop_duplicates(["id", "nbr"])

    return run


def _heads(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and the columns of a matrix of links: the smallest row that links lead to, or the number of rows."""
    rows, none = np.arange(len(near)), len(near)
    while True:
        columns = np.where(near, rows[:, None], none).min(axis=0)
        least = np.minimum(rows, np.where(near, columns[None, :], none).min(axis=1))
        if np.array_equal(least, rows):
            return rows, columns
        rows = least


def _block(threshold: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Counts, for each row of two chunks, the vectors of the other chunk that it links with; ``head`` is a row that links lead to, or itself."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        cid = rows["cid"].to_numpy()
        a, b = rows[cid == i], rows[cid == j]
        near = _matrix(a["u"]) @ _matrix(b["u"]).T >= threshold
        ids, other = a["id"].to_numpy(), b["id"].to_numpy()
        if i == j:
            np.fill_diagonal(near, True)  # rows and columns are the same classes here
        heads, ends = _heads(near)
        if i == j:
            np.fill_diagonal(near, False)
        out = pd.DataFrame({"id": ids, "n": near @ b["n"].to_numpy(), "head": ids[heads]})
        if i == j:
            return out
        led = np.where(ends < len(ids), ids[np.minimum(ends, len(ids) - 1)], other)
        return pd.concat([out, pd.DataFrame({"id": other, "n": near.T @ a["n"].to_numpy(), "head": led})])

    return run


def _ball(rows: pd.DataFrame) -> pd.DataFrame:
    """The centre of a chunk and the angle that holds all of it."""
    x = _matrix(rows["u"])
    centre = x.mean(axis=0)
    size = np.sqrt(centre @ centre)
    centre = centre / size if size > 1e-6 else x[0]
    angle = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
    return pd.DataFrame({"cid": rows["cid"].iloc[:1], "grp": rows["grp"].iloc[:1], "u": [centre.tobytes()], "r": [angle]})


def _meeting(threshold: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Pairs of chunks, of two tiles of chunks, that are near enough to hold a link."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        tile = rows["tile"].to_numpy()
        a, b = rows[tile == i], rows[tile == j]
        if not len(a) or not len(b):
            return pd.DataFrame({"i": [], "j": []}).astype("int64")
        apart = np.arccos(np.clip(_matrix(a["u"]) @ _matrix(b["u"]).T, -1, 1))
        # Both arc cosines lose up to half the digits near zero.
        p, q = np.nonzero(apart <= a["r"].to_numpy()[:, None] + b["r"].to_numpy()[None, :] + math.acos(threshold) + 1e-6)
        x, y = a["cid"].to_numpy()[p], b["cid"].to_numpy()[q]
        some = x <= y if i == j else slice(None)
        return pd.DataFrame({"i": np.minimum(x, y)[some], "j": np.maximum(x, y)[some]})

    return run


def _reached(true: dict[int, int], got: dict[int, int], keep: int, every: bool = False) -> float | None:
    """The mean share of its links that a query finds, of queries with few links or with many, whichever is less.

    If no query has a link, it is 1 where every class was asked and so none has any, and else unknown.
    """
    shares: dict[bool, list[float]] = {}
    for i, n in true.items():
        if n:
            shares.setdefault(n > keep, []).append(min(got.get(i, 0), n) / n)
    return min((sum(x) / len(x) for x in shares.values()), default=1.0 if every else None)


def _compared(classes: DataFrame, parts: DataFrame, threshold: float, block: int) -> DataFrame:
    """``id, n, head`` of the classes ``id`` in ``parts``, for all pairs of chunks of a label that can hold a link; a chunk is of one ``part``."""
    dealt = checkpoint(_dealt(parts.select("part", "id"), ["part"], block).withColumnRenamed("salt", "chunk"))
    cids = dealt.groupBy("part", "chunk").agg(F.min("id").alias("cid"))
    dealt = checkpoint(dealt.join(cids, ["part", "chunk"]).select("id", "cid"))
    balls = checkpoint(dealt.join(classes.select("id", "grp", "u"), "id").groupBy("cid").applyInPandas(_ball, "cid long, grp long, u binary, r double"))
    tiles = balls.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("tiles"))
    tiled = balls.join(tiles, "grp").withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("grp", "cid", "u", "r", "tile", F.least("tile", "o").alias("a"), F.greatest("tile", "o").alias("b"))
    met = checkpoint(tiled.groupBy("grp", "a", "b").applyInPandas(_meeting(threshold), "i long, j long"))
    sides = met.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("cid"))
    return sides.join(dealt, "cid").join(classes.select("id", "n", "u"), "id").groupBy("i", "j").applyInPandas(_block(threshold), "id long, n long, head long")


def _audit(queries: list[tuple[int, int, bytes]], threshold: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Links of the queries among all classes, by comparing all of their label."""
    by: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
    for i, group, u in queries:
        by.setdefault((group, len(u)), []).append((i, u))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for (group, size), some in rows.groupby([rows["grp"], rows["u"].map(len)]):
                asked = by.get((group, size), [])
                for few in (asked[k : k + AUDIT] for k in range(0, len(asked), AUDIT)):
                    ids = np.array([i for i, _ in few])
                    near = _matrix(pd.Series([u for _, u in few])) @ _matrix(some["u"]).T >= threshold
                    near &= ids[:, None] != some["id"].to_numpy()[None, :]
                    yield pd.DataFrame({"id": ids, "n": near @ some["n"].to_numpy()})

    return run


def _merge(edges: DataFrame, keep: int) -> DataFrame:
    """Lists: the ``keep`` nearest of each id; an entry is ``fresh`` unless it was in a list before."""
    best = edges.groupBy("id", "nbr").agg(F.max("sim").alias("sim"), F.bool_and("fresh").alias("fresh"))
    top = F.slice(F.sort_array(F.collect_list(F.struct("sim", "nbr", "fresh")), asc=False), 1, keep)
    return best.groupBy("id").agg(top.alias("l")).select("id", F.explode("l").alias("e")).select("id", "e.nbr", "e.sim", "e.fresh")


def _dealt(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Rows with a ``salt`` by which those of a key with over ``most`` rows are dealt to groups of about as many.

    Only such keys have a size to be joined, and both sides meet in parts of a key.
    """
    held = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > most)
    sizes = held.select(*keys, "held", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
    parted = rows.withColumn("_part", F.pmod(F.xxhash64(F.lit(1), "id", *keys), F.lit(PARTS)).cast("int"))
    salt = F.pmod(F.xxhash64(F.lit(2), "id", *keys), F.ceil(F.col("held") / most))
    return parted.join(sizes, [*keys, "_part"], "left").select(*rows.columns, F.coalesce(salt, F.lit(0)).alias("salt"))


def _initial(classes: DataFrame, first: int, tables: int, keep: int, cell: int) -> DataFrame:
    """Neighbours inside cells of random hyperplanes; cells that hold more rows than meant are dealt to several."""
    coded = checkpoint(classes.select("id", "grp", "u").mapInPandas(_codes(first, tables), "id long, grp long, table int, code long"))
    sizes = coded.where(F.col("table") == first).groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    celled = coded.join(sizes, "grp").select("id", "grp", "table", F.expr("code & (shiftleft(1L, cast(greatest(0, ceil(log2(size / %d))) as int)) - 1)" % cell).alias("cell"))
    salted = checkpoint(_dealt(celled, ["grp", "table", "cell"], 2 * cell))
    return salted.join(classes.select("id", "u"), "id").groupBy("grp", "table", "cell", "salt").applyInPandas(_cell(keep), "id long, nbr long, sim double")


def _refine(classes: DataFrame, lists: DataFrame, keep: int) -> DataFrame:
    """One round of neighbours of neighbours; rows that may enter a list. Hubs without a fresh entry tell nothing new."""
    members = lists.select(F.col("id").alias("hub"), F.col("nbr").alias("id"), "fresh").unionByName(lists.select(F.col("nbr").alias("hub"), "id", "fresh"))
    members = members.groupBy("hub", "id").agg(F.bool_or("fresh").alias("fresh"))
    dealt = checkpoint(_dealt(members, ["hub"], HUB))
    live = dealt.where("fresh").select("hub", "salt").distinct()
    last = lists.groupBy("id").agg(F.min("sim").alias("last"), F.count(F.lit(1)).alias("n")).select("id", F.when(F.col("n") >= keep, F.col("last")).otherwise(-2.0).alias("last"))
    rows = checkpoint(dealt.join(live, ["hub", "salt"], "left_semi").select("hub", "id", "salt"))
    buckets = max(1, -(-rows.count() // (2 * BUCKET_ROWS)))
    rows = rows.join(last, "id", "left").withColumn("last", F.coalesce("last", F.lit(-2.0)))
    rows = rows.join(classes.select("id", "u"), "id").withColumn("bucket", F.pmod(F.xxhash64("hub", "salt"), F.lit(buckets)))
    return rows.groupBy("bucket").applyInPandas(_local_join(keep), "id long, nbr long, sim double")


def near_duplicates(
    df: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    keep: int = LIST,
    cell: int = CELL,
    tables: int = TABLES,
    rounds: int = ROUNDS,
    block: int = BLOCK,
    recall: float = RECALL,
    report: dict | None = None,
) -> DataFrame:
    """``id``, ``n_links`` (rows linked directly) and ``component_id`` (the smallest id reachable).

    ``report`` is given the audited recall of each pass and whether all was compared in the end.
    At most ``MOST_ASKED`` classes are asked at random, so of smaller tables all are, until
    ``LINKED_ASKED`` of them have links; else as many again whose lists hold a near one. If
    none of all these has a link, recall is unknown (None) and all passes are made.
    """
    spark = df.sparkSession
    small_batches(spark, 2048)
    vector = F.col("v")
    sound = F.col("label").isNotNull() & (F.size("v") > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = columns(df, id=id_col, v=vector_col, label=label_col).select("id", F.col("v").cast("array<double>").alias("v"), "label")
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    keys = [F.when(F.col("sound"), F.xxhash64(F.lit(k), "label", "v")).alias(f"k{k}") for k in (1, 2)]
    keyed = rows.select("id", F.xxhash64("label", F.size("v")).alias("grp"), "v", *keys)  # vectors of a group have one length
    classes = keyed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("grp").alias("grp"), F.first("v").alias("v"))
    # Classes have numbers of their own; those of a checkpoint's rows stay.
    named = checkpoint(classes).withColumn("id", F.monotonically_increasing_id())
    heads = named.select("k1", "k2", "id", "least", "n")
    classes = checkpoint(named.select("id", "grp", "n", "v").mapInArrow(_units, "id long, grp long, n long, u binary"))

    true, total = {}, classes.count()

    def ask(wanted: DataFrame, most: int) -> None:
        """Counts the links of up to ``most`` classes, by a hash of their id, that were not asked yet."""
        rows = wanted.orderBy(F.xxhash64("id"), "id").limit(most).select("id", "grp", "u").collect()
        fresh = [(q["id"], q["grp"], bytes(q["u"])) for q in rows if q["id"] not in true]
        true.update(dict.fromkeys((i for i, _, _ in fresh), 0))
        if fresh:
            found = classes.mapInPandas(_audit(fresh, threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
            true.update({r["id"]: r["n"] for r in found.collect()})

    linked_asked = lambda: sum(n > 0 for n in true.values())
    for most in (AUDIT, MOST_ASKED):
        if linked_asked() < LINKED_ASKED:
            # Twice as many as are asked have a hash below this, so tasks do not each send that many.
            bound = min((1 << 63) - 1, (2 * most << 64) // max(1, total) - (1 << 63))
            ask(classes.where(F.xxhash64("id") <= bound), most)

    told = {"recall": [], "exact": False} if report is None else report
    told |= {"recall": [], "exact": False}
    lists = None
    for turn in range(PASSES):
        fresh = _initial(classes, turn * tables, tables, keep, cell).withColumn("fresh", F.lit(True))
        lists = checkpoint(_merge(fresh if lists is None else fresh.unionByName(lists.withColumn("fresh", F.lit(False))), keep))
        size = lists.count()
        for _ in range(rounds):
            better = _refine(classes, lists, keep).withColumn("fresh", F.lit(True))
            lists = checkpoint(_merge(lists.withColumn("fresh", F.lit(False)).unionByName(better), keep))
            if lists.where("fresh").count() <= 0.01 * size:
                break
        edges, counts = _links(classes, lists, threshold, keep, block)
        counts = checkpoint(counts)
        if turn == 0 and len(true) < total and linked_asked() < LINKED_ASKED:
            # Links are rare: classes with a near neighbour in their list are asked too.
            likely = lists.groupBy("id").agg(F.max("sim").alias("sim")).where(F.col("sim") >= LIKELY).select("id")
            ask(classes.join(likely, "id", "left_semi"), MOST_ASKED)
        found = counts.join(F.broadcast(spark.createDataFrame([(i,) for i in true], "id long")), "id").collect() if true else []  # as many as were asked
        told["recall"].append(_reached(true, {r["id"]: r["n"] for r in found}, keep, len(true) == total))
        if told["recall"][-1] is not None and told["recall"][-1] >= recall:
            break
        if told["recall"][-1] is None and turn == PASSES - 1:  # no link was seen by anyone asked
            break
    else:
        told["exact"] = True
        counts = checkpoint(_compared(classes, classes.select("id", F.col("grp").alias("part")), threshold, block))
        edges = counts.where("id <> head").select(F.least("id", "head").alias("src"), F.greatest("id", "head").alias("dst")).distinct()
        counts = counts.groupBy("id").agg(F.sum("n").alias("n"))

    groups = connected_components(edges).select(F.col("node").alias("id"), "component")
    heads = heads.join(counts.withColumnRenamed("n", "m"), "id", "left").join(groups, "id", "left")
    heads = checkpoint(heads.select("k1", "k2", "least", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component")))
    names = heads.groupBy("component").agg(F.min("least").alias("component_id"))
    heads = checkpoint(heads.join(names, "component").select("k1", "k2", "n_links", "component_id"))
    out = keyed.select("id", "k1", "k2").join(heads, ["k1", "k2"], "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def _links(classes: DataFrame, lists: DataFrame, threshold: float, keep: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Edges ``src, dst`` that connect what links do, and for each linked class the rows it links with."""
    linked = lists.where(F.col("sim") >= threshold)
    pairs = checkpoint(linked.select(F.least("id", "nbr").alias("src"), F.greatest("id", "nbr").alias("dst")).distinct())
    full = checkpoint(linked.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= keep).select("id"))
    ends = pairs.select(F.col("src").alias("id"), F.col("dst").alias("nbr")).unionByName(pairs.select(F.col("dst").alias("id"), F.col("src").alias("nbr")))
    sizes = classes.select(F.col("id").alias("nbr"), "n")
    if full.isEmpty():
        return pairs, ends.join(sizes, "nbr").groupBy("id").agg(F.sum("n").alias("n"))
    flag = full.select("id", F.lit(True).alias("f"))
    sided = ends.join(flag, "id", "left").join(flag.select(F.col("id").alias("nbr"), F.col("f").alias("g")), "nbr", "left")
    listed = sided.where(F.coalesce("f", F.lit(False)) & F.coalesce("g", F.lit(False)) == F.lit(False)).select("id", "nbr").join(sizes, "nbr").groupBy("id").agg(F.sum("n").alias("n"))
    groups = connected_components(pairs).select(F.col("node").alias("id"), F.col("component").alias("part"))
    counted = checkpoint(_compared(classes, full.join(groups, "id"), threshold, block))
    across = counted.where("id <> head").select(F.least("id", "head").alias("src"), F.greatest("id", "head").alias("dst")).distinct()
    return pairs.unionByName(across), listed.unionByName(counted.select("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))


def kept(component: Column, vec_id: Column) -> Column:
    """Whether a row names its component."""
    return component == vec_id


def expected_recall(cosine: float, bits: int, tables: int) -> float:
    """The probability that a pair of this cosine shares a cell in one of the tables."""
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 - (1 - agree) ** tables
