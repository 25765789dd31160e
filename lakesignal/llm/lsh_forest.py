"""MinHash near-duplicates by an LSH forest, every link confirmed on the full shingle sets.

A document's label in a tree is a row of DEPTH minhashes, a byte each.  A tree is the order of all labels: what shares a
prefix stands side by side, and the longer the prefix, the likelier a link.  Two sets that link at 0.85 agree in the first
ROOT bytes of a given tree with probability 0.52; that they do so in none of the TREES trees has probability 2e-8.

1. Equal sets are one node.  In a few of the orders each node is compared with the node after it, its longest common
   prefix among those that follow: the depth is the region's own, deep where near copies crowd, down to ROOT where there
   are few.  Neighbours whose signatures agree enough are confirmed on full sets.  That ties nearly all groups together
   with few pairs per node, however large the group is.
2. What is left are regions (nodes of one tree with ROOT bytes in common) that hold several components.  There all pairs
   between components are compared by signatures: links need a share of equal bytes that a linked pair misses with
   probability 2e-8.  In a large region its largest component is not paired with itself, and both sides are cut into
   blocks, so no task holds a region.  A task returns a spanning forest of such pairs, not the pairs.
3. The forests' trees are clusters.  Within one, sets of different components are confirmed in blocks; a task merges
   components as it goes on and returns one link per merge.
4. Components of the confirmed links get the smallest doc_id.

Nothing is capped: regions and clusters of any size are worked off; a cluster of sets that nearly link costs the square
of its size in signature comparisons, spread over block pairs, and rows in proportion to its size.  Copies of one set are one node; they are dropped in the task that
reads them, and the last join repeats the small side, so that a hot set is spread.

Defined cases: a null text counts as empty; texts without words have no shingle, link with nothing and are their own
component; a null doc_id takes part and gets its component's smallest id (null if there is none, and is then kept);
repeated rows are in one component; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesignal.llm.common import bounded_broadcast, pinned, text_or_empty
from lakesignal.llm.ngram_join import _sliced, components, shingle_sets
from lakesignal.scale import salted_lookup

#: Fixed shape of the forest: trees, bytes of a label, bytes that a region has in common.
TREES, DEPTH, ROOT = 24, 8, 4
#: Orders in which neighbours are confirmed before regions are searched.
FIRST = 3
#: Nodes of a region that are paired in a stream; larger regions are cut into blocks of BLOCK.
SMALL, BLOCK = 128, 2048
#: Bounds of a block of sets: sets, and elements of sets.
BLOCK_SETS, BLOCK_ELEMENTS = 512, 400_000
#: Standard deviations of the share of equal bytes that a linked pair may stay behind.
LEEWAY = 5.5

_RNG = np.random.default_rng(11)
_FACTORS = _RNG.integers(1 << 31, dtype=np.uint32, size=TREES * DEPTH) * np.uint32(2) + np.uint32(1)
_TERMS = _RNG.integers(1 << 32, dtype=np.uint32, size=TREES * DEPTH)


def signature(one: np.ndarray) -> np.ndarray:
    """TREES x DEPTH minhashes of a set of 64-bit hashes, a byte each."""
    x = (one >> np.uint64(32)).astype(np.uint32)
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        part = x[None, at : at + 4096]
        for p in range(0, len(least), 16):
            least[p : p + 16] = np.minimum(least[p : p + 16], (part * _FACTORS[p : p + 16, None] + _TERMS[p : p + 16, None]).min(axis=1))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def fewest_equal(percent: int) -> int:
    """Equal bytes that a linked pair has, but for LEEWAY standard deviations."""
    j, m = percent / 100, TREES * DEPTH
    return math.floor(m * j - LEEWAY * math.sqrt(m * j * (1 - j)))


def _name(one: np.ndarray, salt: int) -> tuple[int, int]:
    """Two independent 64-bit names of a set."""
    d = hashlib.blake2b(one.tobytes(), digest_size=16, salt=salt.to_bytes(2, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def read_nodes(texts: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(keys, nodes): (_doc, _key, n, node) for each row of ``texts`` (_doc, _key, _text), and (node, n, sig) for each set."""
    kind = texts.schema["_doc"].dataType.simpleString()
    salt = 0
    while True:

        def run(batches: Iterator[pd.DataFrame], salt: int = salt) -> Iterator[pd.DataFrame]:
            seen: set[int] = set()  # a task gives the signature of copies once
            for batch in _sliced(batches):
                sets = shingle_sets(batch["_text"], size)
                names = [_name(s, salt) for s in sets]
                sigs: list[bytes | None] = []
                for one, (node, _) in zip(sets, names):
                    fresh = len(one) and node not in seen
                    sigs.append(signature(one).tobytes() if fresh else None)
                    if fresh:
                        seen.add(node)
                yield pd.DataFrame({"_doc": batch["_doc"].to_numpy(), "_key": batch["_key"].to_numpy(), "n": [len(s) for s in sets], "node": [x for x, _ in names], "check": [y for _, y in names], "sig": sigs})

        read = pinned(texts.mapInPandas(run, f"_doc {kind}, _key string, n long, node long, check long, sig binary"))
        nodes = read.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.max("sig").alias("sig"), (F.min("check") != F.max("check")).alias("clash"))
        nodes = pinned(nodes)
        if not nodes.where("clash").limit(1).count():
            return read.select("_doc", "_key", "n", "node"), nodes.drop("clash")
        salt += 1


def _fits(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return percent * np.maximum(na, nb) <= 100 * np.minimum(na, nb)


def _bytes(sigs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), TREES * DEPTH)


def neighbours(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): neighbours in the first orders with ROOT bytes in common and enough equal bytes in all.

    A pair that stands astride two partitions is left to the regions.
    """
    label = lambda t: F.substring("sig", t * DEPTH + 1, DEPTH)
    rows = nodes.select("node", "n", "sig", F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), label(t).alias("label")) for t in range(FIRST)])).alias("t"))
    rows = rows.select("t.tree", "t.label", "node", "n", "sig")
    least = fewest_equal(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            if not len(batch):
                continue
            if last is not None:
                batch = pd.concat([last, batch], ignore_index=True)
            last = batch.iloc[-1:]
            sig, n, node = _bytes(batch["sig"]), batch["n"].to_numpy(), batch["node"].to_numpy()
            head = np.frombuffer(b"".join(x[:ROOT] for x in batch["label"]), np.uint8).reshape(len(batch), ROOT)
            tree = batch["tree"].to_numpy()
            good = (tree[1:] == tree[:-1]) & (head[1:] == head[:-1]).all(axis=1) & _fits(n[1:], n[:-1], percent)
            good &= (sig[1:] == sig[:-1]).sum(axis=1) >= least
            a, b = node[:-1][good], node[1:][good]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    ordered = rows.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    return ordered.mapInPandas(run, "a long, b long").distinct()


class _Merging:
    """Union of rows by number; ``add`` tells whether two were apart."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def top(self, x: int) -> int:
        root = self.root
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    def add(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.root[a] = b
        return a != b


def _forest(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Of the pairs (a, b) those that connect what all of them connect."""
    merging = _Merging()
    keep = np.array([merging.add(x, y) for x, y in zip(a.tolist(), b.tolist())], bool)
    return pd.DataFrame({"a": a[keep], "b": b[keep]})


def _between(left: pd.DataFrame, right: pd.DataFrame, tree: int, percent: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ``left`` with ``right`` rows of another component with enough equal bytes that first meet in ``tree``."""
    ls, rs = _bytes(left["sig"]), _bytes(right["sig"])
    ln, rn, lc, rc = left["n"].to_numpy(), right["n"].to_numpy(), left["comp"].to_numpy(), right["comp"].to_numpy()
    la, ra, minor = left["node"].to_numpy(), right["node"].to_numpy(), right["minor"].to_numpy()
    for i in range(len(left)):
        j = np.flatnonzero((rc != lc[i]) & _fits(rn, ln[i], percent) & (~minor | (ra > la[i])))
        j = j[(rs[j] == ls[i]).sum(axis=1) >= least]
        j = j[_first_tree(ls[i][None, :], rs[j]) == tree]
        if len(j):
            yield np.full(len(j), la[i]), ra[j]


def _first_tree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first tree in which the labels have ROOT bytes in common."""
    same = (a.reshape(-1, TREES, DEPTH)[:, :, :ROOT] == b.reshape(-1, TREES, DEPTH)[:, :, :ROOT]).all(axis=2)
    return np.where(same.any(axis=1), same.argmax(axis=1), -1)


def between_components(nodes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that connect all pairs of a region in different components whose signatures may belong to linked sets."""
    least = fewest_equal(percent)
    roots = F.array(*[F.struct(F.lit(t).cast("byte").alias("tree"), F.substring("sig", t * DEPTH + 1, ROOT).alias("root")) for t in range(TREES)])
    comp = nodes.select("node", "sig").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("comp"), F.explode(roots).alias("r"))
    members = comp.select("r.tree", "r.root", "node", "comp")
    mixed = members.groupBy("tree", "root").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    mixed = pinned(mixed.select("tree", "root", "m"))
    held = pinned(members.join(mixed, ["tree", "root"]))  # once: regions of both kinds are read from it, large ones several times

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            end = (rows["tree"] == rows["tree"].iloc[-1]) & (rows["root"] == rows["root"].iloc[-1])
            yield pairs(rows[~end])
            held = rows[end]
        if held is not None:
            yield pairs(held)

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        """All pairs of each run of equal regions, by distance in the run."""
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(rows):
            sig, n, node, own, tree = _bytes(rows["sig"]), rows["n"].to_numpy(), rows["node"].to_numpy(), rows["comp"].to_numpy(), rows["tree"].to_numpy()
            head = np.frombuffer(b"".join(rows["root"]), "<u4")
            left = np.arange(len(rows))
            for step in range(1, SMALL):
                left = left[left < len(rows) - step]
                left = left[(tree[left] == tree[left + step]) & (head[left] == head[left + step])]
                if not len(left):
                    break
                i, j = left, left + step
                good = (own[i] != own[j]) & _fits(n[i], n[j], percent)
                i, j = i[good], j[good]
                good = (sig[i] == sig[j]).sum(axis=1) >= least
                i, j = i[good], j[good]
                good = _first_tree(sig[i], sig[j]) == tree[i]
                out_a.append(node[i[good]])
                out_b.append(node[j[good]])
        return _forest(np.concatenate(out_a), np.concatenate(out_b))

    few = held.where(F.col("m") <= SMALL).join(nodes, "node").select("tree", "root", "node", "comp", "n", "sig")
    found = few.repartition("tree", "root").sortWithinPartitions("tree", "root").mapInPandas(stream, "a long, b long")

    crowd = held.where(F.col("m") > SMALL)
    # by counts per component, pre-aggregated: the largest component and how many nodes are outside it
    sizes = crowd.groupBy("tree", "root", "m", "comp").agg(F.count(F.lit(1)).alias("c"))
    shape = sizes.groupBy("tree", "root", "m").agg(F.max(F.struct("c", "comp")).alias("top"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK)).cast("int")
    shape = pinned(shape.select("tree", "root", F.col("top.comp").alias("major"), blocks(F.col("m")).alias("nb"), blocks(F.col("m") - F.col("top.c")).alias("na")))
    by = ["tree", "root", "i", "j"]
    placed = crowd.drop("m").join(shape, ["tree", "root"]).join(nodes, "node").withColumn("minor", F.col("comp") != F.col("major"))
    block = lambda c, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(c)).cast("int")
    left = placed.where("minor").withColumn("i", block("na", 1)).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    right = placed.withColumn("j", block("nb", 2)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
    cols = ["tree", "root", "i", "j", "node", "comp", "n", "sig", "minor"]
    left, right = left.select(*cols), right.select(*[F.col(c).alias(c) for c in cols])

    def block_pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        got = list(_between(a, b, int(a["tree"].iloc[0]), percent, least)) if len(a) and len(b) else []
        return _forest(*(np.concatenate([p[side] for p in got]) if got else np.zeros(0, np.int64) for side in (0, 1)))

    left, right = left.repartition(*by), right.repartition(*by)  # else a region's blocks stay where its shape was looked up
    return found.unionByName(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(block_pair, "a long, b long"))


def sets_of(wanted: DataFrame, texts: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """(node, set): the full set of each wanted node, from one of its texts."""
    # copies may differ in case or space: the text with the smallest digest stands for the node
    chosen = pinned(keys.where("n > 0").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("_key").alias("_key")))
    few = bounded_broadcast(chosen, chosen.count(), 200_000)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _sliced(batches):
            yield pd.DataFrame({"node": batch["node"].to_numpy(), "set": [s.view(np.int64) for s in shingle_sets(batch["_text"], size)]})

    one = texts.join(few, "_key").select("node", "_text").mapInPandas(build, "node long, set array<long>")
    return pinned(one.groupBy("node").agg(F.first("set").alias("set")))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets link."""
    held = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    both = held.select("a", "b", (F.size("sa") + F.size("sb")).alias("all"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return pinned(both.where(100 * F.col("both") >= percent * (F.col("all") - F.col("both"))).select("a", "b"))


def _merges(rows: pd.DataFrame, percent: int, least: int) -> pd.DataFrame:
    """Links between sets of different components, of two blocks or inside one, that merge all that such links merge."""
    sets = [np.asarray(s, np.int64) for s in rows["set"]]
    sig, n, node, comp = _bytes(rows["sig"]), np.array([len(s) for s in sets], np.int64), rows["node"].to_numpy(), rows["comp"].to_numpy().copy()
    first, inside = rows["block"].to_numpy() == rows["bi"].iloc[0], bool((rows["bi"] == rows["bj"]).iloc[0])
    values, code, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1  # elements of one set only take no bit
    bits = np.zeros((len(sets), int((counts > 1).sum()) // 64 + 1), np.uint64)
    owner = np.repeat(np.arange(len(sets)), n)
    shared = counts[code] > 1
    at = column[code[shared]]
    np.bitwise_or.at(bits, (owner[shared], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    a, b = [], []
    for i in range(len(sets)) if inside else np.flatnonzero(first):
        j = np.arange(i + 1, len(sets)) if inside else np.flatnonzero(~first)
        j = j[(comp[j] != comp[i]) & _fits(n[j], n[i], percent)]
        j = j[(sig[j] == sig[i]).sum(axis=1) >= least]
        for part in range(0, len(j), 256):
            k = j[part : part + 256]
            both = np.bitwise_count(bits[k] & bits[i]).sum(axis=1, dtype=np.int64)
            for hit in k[100 * both >= percent * (n[k] + n[i] - both)]:
                if comp[hit] != comp[i]:
                    a.append(node[i])
                    b.append(node[hit])
                    comp[comp == comp[hit]] = comp[i]
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def confirmed_in_clusters(clusters: DataFrame, nodes: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that merge the components of ``labels`` as all links inside the clusters (node, cluster) do."""
    least = fewest_equal(percent)
    held = clusters.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label").join(nodes, "node")
    weight = held.groupBy("cluster").agg(F.count(F.lit(1)).alias("s"), F.sum("n").alias("e"))
    weight = weight.select("cluster", F.greatest(F.ceil(F.col("s") / BLOCK_SETS), F.ceil(F.col("e") / BLOCK_ELEMENTS)).cast("int").alias("blocks"))
    placed = held.join(weight, "cluster").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("cluster", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node", "comp", "sig").join(sets, "node")
    by = ["cluster", "bi", "bj"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            key = batch[by].to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for at, end in zip(cuts, cuts[1:]):
                part = batch.iloc[at:end]
                if held and (held[-1][by].iloc[0] != part[by].iloc[0]).any():
                    yield _merges(pd.concat(held, ignore_index=True), percent, least)
                    held = []
                held.append(part)
        if held:
            yield _merges(pd.concat(held, ignore_index=True), percent, least)

    return pinned(spread.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, "a long, b long"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per document."""
    texts = docs.select(F.col(doc_id).alias("_doc"), text_or_empty(text).alias("_text")).withColumn("_key", F.md5("_text"))
    keys, nodes = read_nodes(texts, size)
    near = pinned(neighbours(nodes, percent))
    edges = confirmed(near, sets_of(_ends(near), texts, keys, size), percent)
    labels = components(edges)
    clusters = components(between_components(nodes, labels, percent)).withColumnRenamed("label", "cluster")
    more = confirmed_in_clusters(clusters, nodes, labels, sets_of(clusters, texts, keys, size), percent)
    labels = components(edges.unionByName(more))

    some = keys.where("n > 0").groupBy("node").agg(F.min("_doc").alias("least"))
    labelled = some.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    table = pinned(labelled.select("node", "label").join(least, "label").select("node", "component_id"))
    full = salted_lookup(keys.where("n > 0"), table, ["node"], 16).select("_doc", "n", "component_id")
    empty = keys.where("n = 0").select("_doc", "n", F.col("_doc").alias("component_id"))
    return full.unionByName(empty).select(F.col("_doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("_doc").eqNullSafe(F.col("component_id")).alias("kept"))
