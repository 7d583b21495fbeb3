"""Near duplicates by BagMinHash over multisets of word shingles.

A shingle of multiplicity w is the weight interval [0, w), cut into dyadic pieces [0,1), [1,2), [2,4), [4,8)...
Each (shingle, piece) is a Poisson process with the piece's length as rate, whose points carry a signature
component and a level inside the piece; points at levels of w or above don't count. A component's value is its
earliest point, so two documents agree in it with probability sum(min)/sum(max). All
processes are advanced together up to a time by which the components are filled, hence a signature
costs about m ln m + n steps.

Signatures are banded; texts that share a band are candidates. First every text is compared with one leader, the most
central text that it shares a band with: the one whose bands hold most. Leaders are more central than those that meet them, so
these links are a forest, and one comparison a text joins nearly all of a group of copies. Then members of different classes of a
band meet each other, in blocks of a bounded size, so that no task holds a large group; such a pair is made only
if its likeness can reach the threshold at all, by a bound from shortened hashes of both texts'
shingles. A link is a verified weighted Jaccard likeness of the whole multisets; classes are connected components.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.llm.common import Scratch, documents_of, rows_with, text_of
from gatehouse.llm.textvec import FEW_BYTES, U64, give_back, mix, shingles, text_blocks, words_of

#: Members of a band that meet each other in one task at most.
BLOCK = 1024
GOLDEN = U64(0x9E3779B97F4A7C15)


def multisets(texts: Sequence[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, multiplicity), sorted by text and shingle."""
    value, doc = shingles(words_of(texts), words)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.append(at, len(value)))


def bag_min_hash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n x m, earliest times; infinite for an empty multiset)."""
    # processes: one per element and dyadic piece that begins below its weight
    pieces = np.where(weight <= 1, 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1)
    index = np.repeat(np.arange(len(doc)), pieces)
    piece = np.arange(len(index)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    rate = np.where(piece == 0, 1, 1 << np.maximum(piece - 1, 0)).astype(np.float64)
    low = np.where(piece == 0, 0, 1 << np.maximum(piece - 1, 0))
    key = mix(element[index] + piece.astype(U64) * GOLDEN)
    owner, limit = doc[index], weight[index]
    total = np.bincount(doc, weight, n)
    # by then a component is still empty with probability e**-6 / m
    horizon = m * (np.log(m) + 6) / np.maximum(total, 1)
    best = np.full(n * m, np.inf)
    time = np.zeros(len(key))
    step, alive = 0, np.arange(len(key))
    parked = []
    while True:
        while len(alive):
            step += 1
            state = mix(key[alive] + U64(step * 0xD1342543DE82EF95 & (1 << 64) - 1))
            time[alive] += -np.log(((state >> U64(12)).astype(np.float64) + 0.5) / float(1 << 52)) / rate[alive]
            late = time[alive] > horizon[owner[alive]]
            if late.any():
                parked.append((step, alive[late]))
                alive, state = alive[~late], state[~late]
            second = mix(state + GOLDEN)
            level = low[alive] + ((second >> U64(32)).astype(np.float64) / float(1 << 32) * rate[alive]).astype(np.int64)
            counts = level < limit[alive]
            at = owner[alive] * m + (second & U64(0xFFFFFFFF)).astype(np.int64) % m
            np.minimum.at(best, at[counts], time[alive][counts])
        open_docs = np.isinf(best.reshape(n, m)).any(axis=1) & (total > 0)
        if not open_docs.any():
            return best.reshape(n, m)
        # rare: go on from the start up to twice the time, for these texts alone
        again = open_docs[owner]
        horizon[open_docs] *= 2
        alive, step, parked = np.flatnonzero(again), 0, []
        time[alive] = 0


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key per band of each signature."""
    bits = signature.view(U64).reshape(len(signature), bands, -1)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, (len(signature), 1))
    for j in range(bits.shape[2]):
        out = mix(out * U64(0xA24BAED4963EE407) + bits[:, :, j])
    return out.view(np.int64)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets as ascending arrays with repeats; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(ub, ua), len(ub) - 1)
    shared = int(np.minimum(ca, cb[at])[ub[at] == ua].sum())
    return shared / (len(a) + len(b) - shared)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, weight, bands: the band keys of each text that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_blocks(batch.column(2), 1 << 19):
                doc, element, weight = multisets(texts, words)
                keys = band_keys(bag_min_hash(doc, element, weight, b - a, bands * rows), bands)
                total = np.bincount(doc, weight, b - a).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bands, bands), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(total), lists], ["doc_id", "text_key", "weight", "bands"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id long, text_key binary, weight long, bands array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """node, shingles: the ascending shingle hashes (with repeats) as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_blocks(batch.column(1), FEW_BYTES):
                value, doc = shingles(words_of(texts), words)
                border = np.searchsorted(doc, np.arange(b - a + 1)).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([np.sort(value[i:j] >> U64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for i, j in zip(border, border[1:], strict=False)], pa.binary())], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles binary")


def _hashes(raw: bytes) -> np.ndarray:
    full = np.zeros((len(raw) // 6, 8), np.uint8)
    full[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return full.view("<u8").ravel()


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` of the pairs whose multisets are at least ``threshold`` alike; ``sets`` has node, shingles."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [weighted_jaccard(_hashes(x.as_py()), _hashes(y.as_py())) >= threshold for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(alike, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])
            give_back()

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def profiles(sets: DataFrame, limit: int = 1500) -> DataFrame:
    """``of, profile``: distinct numbers of 20 hash bits of a shingle and of which repeat it is; null for more than ``limit`` of them.

    Two multisets share at most as many shingles as their profiles have in common, which bounds their likeness;
    a text without a profile is compared with no bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(1):
                own = np.sort((_hashes(raw.as_py()) >> U64(28)).astype(np.int64))
                repeat = np.arange(len(own)) - np.searchsorted(own, own)
                rows.append(None if len(own) > limit or (repeat > 2047).any() else ((own << 11) | repeat).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["of", "profile"])
            give_back()

    return sets.select("node", "shingles").mapInArrow(run, "of long, profile array<int>")


def rooted(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """``node, class`` of the forest ``links(node, up)``: its root, by doubling how far up each node points."""
    at = links.select("node", F.col("up").alias("class"))
    for k in range(rounds):
        above = at.select(F.col("node").alias("class"), F.col("class").alias("root"))
        moved = scratch.put(f"roots-{k}", at.join(above, "class", "left").select("node", F.coalesce("root", "class").alias("class"), F.col("root").isNotNull().alias("moved")))
        at = moved.select("node", "class")
        scratch.drop(f"roots-{k - 1}")
        if moved.where("moved").isEmpty():
            return at
    raise RuntimeError(f"roots still move after {rounds} rounds")


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """``node, class`` (the least node of its component) of every node in ``edges(a, b)``, by label passing with shortcuts."""
    both = scratch.put("edges", edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = scratch.put("labels-0", both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("class")))
    for k in range(1, rounds + 1):
        near = both.join(labels.select(F.col("node").alias("b"), "class"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("via"))
        once = labels.join(near, "node").select("node", F.least("class", "via").alias("new"), F.col("class").alias("old"))
        # shortcut: the label of one's label
        far = labels.select(F.col("node").alias("new"), F.col("class").alias("root"))
        moved = scratch.put(f"labels-{k}", once.join(far, "new", "left").select("node", F.least("new", F.coalesce("root", "new")).alias("class"), "old"))
        labels = moved.select("node", "class")
        scratch.drop(f"labels-{k - 1}")
        if moved.where("class < old").isEmpty():
            scratch.drop("edges")
            return labels
    raise RuntimeError(f"components still change after {rounds} rounds")


def block_cells(open_: DataFrame) -> DataFrame:
    """``open_(band, node, class, ...)`` with ``block`` (owner, part) of each member and ``others``, the blocks of its band that it has to meet.

    A class of more than ``BLOCK`` members in a band fills blocks of its own (owner: the class), which meet those of no owner and of other classes but never each
    other; the members of smaller classes share blocks (owner -1), which meet all, themselves included. So what a band costs grows with the pairs between its classes,
    not with its square, and a task holds at most two blocks.
    """
    sizes = open_.groupBy("band", "class").agg(F.count("*").alias("own"))
    parts = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    blocks = lambda owner, n: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(owner.cast("long").alias("owner"), k.alias("part")))
    large = F.col("own") > BLOCK
    of_band = sizes.groupBy("band").agg(F.sum(F.when(large, 0).otherwise(F.col("own"))).alias("rest"), F.flatten(F.collect_list(F.when(large, blocks(F.col("class"), parts(F.col("own")))))).alias("owned"))
    shared = F.when(F.col("rest") > 0, blocks(F.lit(-1), parts(F.col("rest")))).otherwise(F.expr("cast(array() as array<struct<owner:bigint,part:int>>)"))
    of_band = of_band.select("band", "rest", F.concat(shared, "owned").alias("all"))
    known = open_.join(sizes, ["band", "class"]).join(of_band, "band")
    part = F.pmod(F.xxhash64("node"), parts(F.when(large, F.col("own")).otherwise(F.col("rest")))).cast("int")
    dealt = known.withColumn("block", F.struct(F.when(large, F.col("class")).otherwise(F.lit(-1)).cast("long").alias("owner"), part.alias("part")))
    return dealt.withColumn("others", F.filter("all", lambda o: (o["owner"] != F.col("block.owner")) | (o["owner"] == -1))).drop("own", "rest", "all")


def close_pairs(open_: DataFrame, sets: DataFrame, bands_of: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """``a, b``, each once: members of different classes in one band whose likeness may reach ``threshold``.

    ``open_`` has band, node, weight and class. Each pair of blocks (see ``block_cells``) meets in a cell of its own.
    """
    inside = open_.select("node").distinct()
    facts = profiles(sets.join(inside, "node")).join(bands_of.withColumnRenamed("node", "of"), "of")
    dealt = block_cells(open_)
    scratch.put("bounded", dealt.join(facts, F.col("node") == F.col("of")).select("band", "node", "weight", "class", "block", "others", "profile", "bands"))

    def side(name: str) -> DataFrame:
        own = scratch.spark.read.parquet(scratch.path("bounded"))
        return own.withColumn("other", F.explode("others")).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("others").alias(name)

    # a pair is made in the first band that it shares, in the one cell of its blocks, and only if the bound on its likeness reaches the threshold
    shared = "cast(size(array_intersect(x.profile, y.profile)) as double)"
    alike = f"x.profile is null or y.profile is null or {shared} * {1 + threshold}D >= {threshold}D * (x.weight + y.weight) - 1e-6D"
    meets = f"x.band = y.band and x.low = y.low and x.high = y.high and x.node < y.node and x.class <> y.class and (x.block <> y.block or x.low = x.high) and least(x.weight, y.weight) >= {threshold} * greatest(x.weight, y.weight) and x.band = element_at(array_intersect(x.bands, y.bands), 1) and ({alike})"
    return side("x").join(side("y"), F.expr(meets)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _placed(docs: DataFrame, words: int = 5, threshold: float = 0.8, bands: int = 30, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, class_id, n_verified, kept, repeats of every row; see classify."""
    scratch = Scratch(docs.sparkSession, "near")
    own = documents_of(docs, id_col, text_col).withColumn("text_key", F.unhex(F.md5(F.col("text").cast("binary"))))
    seen = scratch.put("signatures", signatures(own, words, bands, rows).withColumn("rid", F.monotonically_increasing_id()))
    # a node stands for all documents of one text; its number is that of one of them
    nodes = scratch.put("nodes", seen.groupBy("text_key").agg(F.min("rid").alias("node"), F.max("weight").alias("weight")))
    banded = seen.join(nodes.where("weight > 0").select(F.col("node").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("node"), "weight", F.explode("bands").alias("band"))
    groups = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = scratch.put("members", banded.join(groups, "band"))
    in_group = members.groupBy("node").agg(F.sum("n").alias("central"))
    ranked = scratch.put("ranked", members.join(in_group, "node"))

    # the shingles of one document of each text that has candidates; copies are spread over the join by their ids
    keys = seen.join(in_group.select(F.col("node").alias("rid")), "rid").select(F.col("rid").alias("node"), F.col("text_key").alias("key"), F.col("doc_id").alias("rep"))
    picked = own.join(keys, F.expr("text_key = key and doc_id <=> rep")).select("node", "text")
    sets = scratch.put("sets", shingle_sets(picked, words).dropDuplicates(["node"]))

    rank = F.struct("central", "node")
    leaders = ranked.groupBy("band").agg(F.max(rank).alias("leader"))
    met = ranked.join(leaders, "band").where("node <> leader.node").groupBy("node").agg(F.max("leader").alias("leader"))
    first = scratch.put("links-leaders", verified(met.select(F.col("leader.node").alias("a"), F.col("node").alias("b")), sets, threshold).select(F.col("b").alias("node"), F.col("a").alias("up")))
    classes = scratch.put("classes", rooted(first, scratch))

    state = scratch.put("state", members.select("band", "node", "weight").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")))
    split = state.groupBy("band").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("band")
    open_ = scratch.put("open", state.join(split, "band"))
    pairs = scratch.put("pairs", close_pairs(open_, sets, seen.select(F.col("rid").alias("node"), "bands"), threshold, scratch))
    second = scratch.put("links", verified(pairs, sets, threshold))
    of = classes.select("node", "class")
    ends = second.join(of.toDF("a", "ca"), "a", "left").join(of.toDF("b", "cb"), "b", "left")
    joined = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), scratch).toDF("class", "root")

    degree = first.select(F.explode(F.array("node", "up")).alias("node")).union(second.select(F.explode(F.array("a", "b")))).groupBy("node").agg(F.count("*").alias("n_verified"))
    labelled = nodes.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")).join(joined, "class", "left").join(degree, "node", "left")
    labelled = labelled.select("text_key", F.coalesce("root", "class").alias("class"), F.coalesce("n_verified", F.lit(0).cast("long")).alias("n_verified"))
    placed = scratch.put("placed", seen.select("doc_id", "rid", "text_key").join(labelled, "text_key").select("doc_id", "rid", "text_key", "class", "n_verified"))
    heads = placed.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "rid"))["rid"].alias("head"))
    out = scratch.put("result", placed.join(heads, "class").select("doc_id", "text_key", "class_id", "n_verified", (F.col("rid") == F.col("head")).alias("kept")))
    scratch.drop("signatures", "nodes", "members", "ranked", "sets", "links-leaders", "classes", "state", "open", "bounded", "pairs", "links", "placed")
    return out


def classify(docs: DataFrame, words: int = 5, threshold: float = 0.8, bands: int = 30, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate class of every document: doc_id, class_id (the least doc_id of the class), n_verified, kept.

    Equal texts are one node; links join nodes whose multisets of ``words``-word shingles have a weighted Jaccard likeness of at
    least ``threshold``; ``n_verified`` counts the links to other texts that were verified on the way to the classes (not all that a
    text may have), and one document of each class, that of the least id, is kept. Texts without words match equal texts only.
    Null texts count as empty; a null id is as a document of its own class member, never kept before another; of
    rows that repeat an id one is kept. An empty table gives no rows; further columns, whatever their names, are ignored. Whole texts of any length are
    compared; a text longer than a block is read alone.
    """
    return _placed(docs, words, threshold, bands, rows, id_col, text_col).drop("text_key")


def deduplicate(docs: DataFrame, words: int = 5, threshold: float = 0.8, bands: int = 30, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate class, all its columns as they are.

    That of the least id stays, one with an id before one without; of rows equal in id and text any one. Null and empty texts
    are one class of copies; an empty table stays empty; columns of clashing names are carried along.
    """
    placed = _placed(docs, words, threshold, bands, rows, id_col, text_col)
    kept = placed.where("kept").select("doc_id", "text_key")
    keyed = rows_with(docs, own_id=F.col(id_col).cast("long"), own_key=F.unhex(F.md5(text_of(text_col).cast("binary"))))
    found = keyed.join(kept, F.expr("own_id <=> doc_id and own_key = text_key"))
    repeats = placed.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).where("kept and n > 1")
    # rows equal in id and text are one document; without such, nothing is moved for them
    return (found if repeats.isEmpty() else found.dropDuplicates(["own_id", "own_key"])).select("row.*")
