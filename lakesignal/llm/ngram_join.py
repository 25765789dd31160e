"""Exact Jaccard join of word n-gram sets by PartEnum signatures, and the classes that its links form.

Two sets link when 100 * shared >= percent * union.  Then their symmetric difference is bounded by their sizes, so sets
are put in size bands (and, near an upper border, also in the band below), and each band has a fixed partition of the
hashed feature domain: groups at the first level, PARTS parts inside a group at the second.  There are so many groups
that linked sets differ by one element at most in one of them, and then share the signature that joins all parts of
that group but the one that differs.

1. Equal sets are one node.  Signatures are shuffled as (signature, node); only shared ones stay.
2. Up to SMALL nodes with one signature are paired.  Nodes with larger signature groups form dense clusters, which are cut
   by size class and into blocks by hash, and each pair of blocks meets in one task.
3. Such pairs are first held against odd sketches: bit h(x) of a sketch is turned over by each element x, so two sketches
   differ in no more bits than the sets in elements.  The test loses no link and takes two to four bits an element.  What
   passes is returned as a spanning forest, whose trees are tight clusters.
4. Only the sets of tight clusters are built and shipped.  Inside one, all pairs of a size class are verified by bit sets
   in blocks; a task returns one row per node, not one per pair.
5. Components of the links get the smallest doc_id.

Nothing is capped: every pair that shares a signature is tested, so no link is lost.  Hot groups: copies collapse to a
node in the task that reads them; near copies are spread over the tasks of their block pairs.  Verification inside a
dense cluster is quadratic in its different sets; it has to be, as each of these pairs may link.

Defined cases: a null text counts as empty; texts without words have no shingle, link with nothing and are their own
component, copies included; a null doc_id takes part and gets its component's smallest id (null if there is none);
repeated rows are in one component; an empty table gives an empty result; ``keep_one`` keeps every column.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesignal.llm.common import bounded_broadcast, fresh_names, text_or_empty
from lakesignal.scale import pinned, salted_lookup

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: Sequence[str | None], size: int = 4) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``size`` words."""
    split = [(t or "").encode().lower().split() for t in texts]  # of bytes: ASCII letters and the contract's white space
    counts = np.array([len(w) for w in split], dtype=np.int64)
    flat = np.array([w for words in split for w in words], dtype=object)
    codes = pd.util.hash_array(flat) if len(flat) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        codes = _mix(codes.astype(np.uint64))
        rolled = np.zeros(max(len(codes) - size + 1, 0), np.uint64)
        for i in range(size):
            rolled = _mix(rolled + codes[i : i + len(rolled)] + np.uint64((_GOLD * (i + 1)) % 2**64))
        out, at = [], 0
        for n in counts:
            if n >= size:
                out.append(np.unique(rolled[at : at + n - size + 1]))
            elif n:
                short = np.uint64(n)
                for c in codes[at : at + n]:
                    short = _mix(np.array([short * np.uint64(31) + c], np.uint64))[0]
                out.append(np.array([short], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def band_starts(limit: int, ratio: float = 1.5) -> list[int]:
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return out


BANDS = band_starts(2**31)


def most_different(top: int, percent: int) -> int:
    """The largest symmetric difference of two linked sets of which the smaller has ``top`` elements at most."""
    return (100 - percent) * (top + top * 100 // percent) // (100 + percent)


def bands_of(n: int, percent: int) -> list[int]:
    """The band whose smaller sets have ``n`` elements, and lower ones whose sets may link to a larger set of ``n``."""
    own = int(np.searchsorted(BANDS, n, side="right")) - 1
    out = [own]
    while out[-1] > 0 and n * percent <= (BANDS[out[-1]] - 1) * 100:
        out.append(out[-1] - 1)
    return out


#: Parts of a group at the second level, one of which may differ.
PARTS = 3


def groups_of(band: int, percent: int) -> tuple[int, int]:
    """(groups, spare) at the first level: linked sets agree up to one element in ``spare`` + 1 groups or more."""
    k = most_different(BANDS[band + 1] - 1, percent)
    need = k // 2 + 1
    spare = max(1, need // 6) if k else 0
    return need + spare, spare


def signatures(one: np.ndarray, percent: int = 85) -> np.ndarray:
    """Signatures of one set in all its bands.

    Hashes deal the elements to groups and, inside a group, to PARTS parts.  Each signature joins all parts of a group
    but one: sets that differ in one element of a group share the signature that leaves that part out.  A signature of
    no element says nothing; it is left out by sets that have such groups no more often than groups are spare, because
    linked sets then agree in another one.
    """
    out = []
    n = len(one)
    with np.errstate(over="ignore"):
        value = _mix(one)
        for band in bands_of(n, percent):
            count, spare = groups_of(band, percent)
            if spare == 0:
                continue  # so small that linked sets are equal
            spot = (_mix(one + np.uint64((_GOLD * (band + 7)) % 2**64)) % np.uint64(count * PARTS)).astype(np.int64)
            order = np.argsort(spot, kind="stable")
            edges = np.searchsorted(spot[order], np.arange(count * PARTS + 1))
            running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[order])])
            sums = (running[edges[1:]] - running[edges[:-1]]).reshape(count, PARTS)
            number = np.diff(edges).reshape(count, PARTS)
            tag = _mix(np.arange(count, dtype=np.uint64) * np.uint64(_GOLD) + np.uint64(band * 64))
            here, full = [], []
            for left_out in range(PARTS):
                rest = [p for p in range(PARTS) if p != left_out]
                s = tag + np.uint64(left_out + 1)
                for p in rest:
                    s = _mix(s * np.uint64(31) + sums[:, p] + number[:, p].astype(np.uint64))
                here.append(s)
                full.append(number[:, rest].sum(axis=1) > 0)
            here, full = np.array(here), np.array(full)
            lacking = int((~full).any(axis=0).sum())
            out.append(here[full] if lacking <= spare else here.ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(one: np.ndarray) -> bytes:
    """Odd sketch of a set: the parity of its elements in each of a power of two of cells, at least two per element."""
    cells = 1 << max(6, (2 * len(one) - 1).bit_length())
    return np.packbits((np.bincount((one & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)).tobytes()


def folded(cell: bytes, size: int) -> np.ndarray:
    """The sketch in ``size`` bytes, at most its own number: halves are laid on each other."""
    bits = np.frombuffer(cell, np.uint64)
    while len(bits) * 8 > size:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


#: Nodes of one signature that are paired at once; larger groups meet in blocks.
SMALL = 16
#: Bounds of a block: sets, and elements of sets; the sketches of a block may have more.
BLOCK_SETS, BLOCK_ELEMENTS = 512, 400_000
SKETCH_SETS, SKETCH_ELEMENTS = 1024, 8_000_000


def _node(one: np.ndarray, salt: int) -> tuple[int, int]:
    """Two independent 64-bit names of a set."""
    d = hashlib.blake2b(one.tobytes(), digest_size=16, salt=salt.to_bytes(2, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


#: Rows and code points of texts that are taken apart at once; a longer text is taken alone.
SLICE_ROWS, SLICE_CHARS = 500, 2_000_000


def _sliced(batches: Iterator[pd.DataFrame], rows: int = SLICE_ROWS, text: str = "_text") -> Iterator[pd.DataFrame]:
    """The rows of ``batches`` in pieces with a bounded number of rows and, if they have texts, of code points."""
    for batch in batches:
        sizes = batch[text].str.len().to_numpy() if text in batch and len(batch) else np.zeros(len(batch), np.int64)
        at = 0
        while at < len(batch):
            ends = np.cumsum(sizes[at : at + rows])
            end = at + max(1, int(np.searchsorted(ends, SLICE_CHARS, side="right")))
            yield batch.iloc[at:end]
            at = end


def _read_sets(texts: DataFrame, size: int, salt: int) -> DataFrame:
    """(_doc, _key, n, node, check, sketch) for each row of ``texts`` (_doc, _key, _text)."""
    kind = texts.schema["_doc"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # copies read by one task give their sketch once
        for batch in _sliced(batches):
            sets = shingle_sets(batch["_text"], size)
            names = [_node(s, salt) for s in sets]
            fresh = [len(s) > 0 and x not in seen and not seen.add(x) for s, (x, _) in zip(sets, names)]
            yield pd.DataFrame(
                {
                    "_doc": batch["_doc"].to_numpy(),
                    "_key": batch["_key"].to_numpy(),
                    "n": [len(s) for s in sets],
                    "node": [x for x, _ in names],
                    "check": [y for _, y in names],
                    "sketch": [sketch(s) if new else None for s, new in zip(sets, fresh)],
                }
            )

    return texts.mapInPandas(run, f"_doc {kind}, _key string, n long, node long, check long, sketch binary")


def named_sets(texts: DataFrame, size: int) -> tuple[DataFrame, DataFrame, int]:
    """(keys, nodes, salt): the stored rows of ``_read_sets``, (node, n, sketch) of each set, and a salt without clashing names."""
    salt = 0
    while True:
        keys = pinned(_read_sets(texts, size, salt))
        nodes = keys.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.max("sketch").alias("sketch"), (F.min("check") != F.max("check")).alias("clash"))
        nodes = pinned(nodes)
        if not nodes.where("clash").limit(1).count():
            return keys.drop("sketch", "check"), nodes.drop("clash"), salt
        salt += 1


def shared_signatures(texts: DataFrame, size: int, percent: int, salt: int) -> DataFrame:
    """(sig, node): signatures that at least two nodes have, each once."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # copies read by one task give their signatures once
        for batch in _sliced(batches):
            sigs, nodes = [], []
            for one in shingle_sets(batch["_text"], size):
                node = _node(one, salt)[0]
                if len(one) and node not in seen:
                    seen.add(node)
                    s = signatures(one, percent)
                    sigs.append(s)
                    nodes.append(np.full(len(s), node, np.int64))
            if sigs:
                yield pd.DataFrame({"sig": np.concatenate(sigs).view(np.int64), "node": np.concatenate(nodes)})

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows whose signature the row before or after also has; the input is sorted."""
        held = None  # the last row, and whether it is known to be shared
        for batch in batches:
            sig, node = batch["sig"].to_numpy(), batch["node"].to_numpy()
            if not len(sig):
                continue
            if held is not None:
                sig, node = np.concatenate([[held[0]], sig]), np.concatenate([[held[1]], node])
            same = sig[1:] == sig[:-1]
            shared = np.zeros(len(sig), bool)
            shared[1:] |= same
            shared[:-1] |= same
            shared[0] |= held is not None and held[2]
            yield pd.DataFrame({"sig": sig[:-1][shared[:-1]], "node": node[:-1][shared[:-1]]})
            held = (sig[-1], node[-1], bool(shared[-1]))
        if held is not None and held[2]:
            yield pd.DataFrame({"sig": [held[0]], "node": [held[1]]})

    rows = texts.select("_text").mapInPandas(write, "sig long, node long")
    rows = pinned(rows.repartition("sig").sortWithinPartitions("sig").mapInPandas(keep, "sig long, node long")).distinct()
    many = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return pinned(rows.join(many, "sig"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component of the undirected ``edges`` (a, b).

    Labels spread to neighbours and then jump to their label's label, so rounds grow with the logarithm of the longest path.
    """
    both = pinned(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = pinned(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        moved = pinned(moved.join(up, "label").select("node", "old", F.least("label", "up").alias("label")))
        labels = moved.select("node", "label")
        if moved.where("old <> label").limit(1).count() == 0:
            return labels


def _hub_edges(large: DataFrame) -> DataFrame:
    """(a, b): edges that connect the nodes of each signature, few per node.

    The smallest node of a signature is its head.  A node is tied to the smallest of its heads, and that one to the
    others; the same few heads meet again and again, so there are hardly more edges than nodes.
    """
    heads = large.groupBy("sig").agg(F.min("node").alias("head"))
    tied = pinned(large.join(heads, "sig").select("node", "head").distinct())
    first = tied.groupBy("node").agg(F.min("head").alias("a"))
    between = tied.join(first, "node").select("a", F.col("head").alias("b")).distinct().where("a <> b")
    return first.select("a", F.col("node").alias("b")).unionByName(between)


def _links_in_blocks(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Verified links between two blocks (or inside one): for each node a linked one to join it with, and its number of links."""
    first = group["block"].to_numpy() == group["bi"].iloc[0]
    sets = [np.asarray(s, np.int64) for s in group["set"]]
    inside = bool((group["bi"] == group["bj"]).iloc[0])
    low = group["own"].to_numpy() == group["level"].iloc[0]
    sizes = np.array([len(s) for s in sets], np.int64)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    shared = counts > 1
    width = (int(shared.sum()) + 63) // 64 or 1
    bits = np.zeros((len(sets), width), np.uint64)
    at = 0
    for i, n in enumerate(sizes):
        own = inverse[at : at + n]
        own = column[own[shared[own]]]
        np.bitwise_or.at(bits[i], own >> 6, np.uint64(1) << (own & 63).astype(np.uint64))
        at += n
    nodes = group["node"].to_numpy()
    links = np.zeros(len(sets), np.int64)
    root = np.arange(len(sets))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    others = np.flatnonzero(~first)
    for i in range(len(sets)):
        if inside:
            rest = np.arange(i + 1, len(sets))
        elif first[i]:
            rest = others
        else:
            continue
        if not low[i]:
            rest = rest[low[rest]]  # two sets of the upper class meet in their own level
        rest = rest[(percent * np.maximum(sizes[rest], sizes[i])) <= 100 * np.minimum(sizes[rest], sizes[i])]
        if not len(rest):
            continue
        inter = np.zeros(len(rest), np.int64)
        for part in range(0, len(rest), 256):
            inter[part : part + 256] = np.bitwise_count(bits[rest[part : part + 256]] & bits[i]).sum(axis=1, dtype=np.int64)
        linked = rest[100 * inter >= percent * (sizes[rest] + sizes[i] - inter)]
        links[i] += len(linked)
        links[linked] += 1
        for j in linked:
            root[top(j)] = top(i)
    hit = np.flatnonzero(links)
    return pd.DataFrame({"a": nodes[hit], "b": nodes[[top(i) for i in hit]] if len(hit) else nodes[hit], "links": links[hit]})


def _may_link(na: np.ndarray, nb: np.ndarray, different: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes whose sketches differ in so many bits may link."""
    return ((100 + percent) * different <= (100 - percent) * (na + nb)) & (percent * np.maximum(na, nb) <= 100 * np.minimum(na, nb))


def _near_in_pairs(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Of rows (a, b, na, nb, ka, kb) the pairs that may link."""
    for batch in _sliced(batches, 5000):
        apart = np.zeros(len(batch), np.int64)
        for i, (x, y) in enumerate(zip(batch["ka"], batch["kb"])):
            size = min(len(x), len(y))
            apart[i] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()
        good = _may_link(batch["na"].to_numpy(), batch["nb"].to_numpy(), apart, percent)
        yield pd.DataFrame({"a": batch["a"].to_numpy()[good], "b": batch["b"].to_numpy()[good]})


def _near_in_blocks(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A spanning forest of the pairs of two blocks (or inside one) that may link."""
    first, inside = group["block"].to_numpy() == group["bi"].iloc[0], bool((group["bi"] == group["bj"]).iloc[0])
    low = group["own"].to_numpy() == group["level"].iloc[0]
    size = min(map(len, group["sketch"]))
    bits = np.stack([folded(k, size) for k in group["sketch"]])
    n, node = group["n"].to_numpy(), group["node"].to_numpy()
    tree = np.arange(len(n))  # rows that are connected already are not tested against each other
    out_a, out_b = [], []
    for i in range(len(n)) if inside else np.flatnonzero(first):
        j = np.arange(i + 1, len(n)) if inside else np.flatnonzero(~first)
        if not low[i]:
            j = j[low[j]]  # two sets of the upper class meet in their own level
        j = j[(tree[j] != tree[i]) & (percent * np.maximum(n[j], n[i]) <= 100 * np.minimum(n[j], n[i]))]
        if not len(j):
            continue
        apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
        j = j[_may_link(n[j], np.full(len(j), n[i]), apart, percent)]
        if len(j):
            _, at = np.unique(tree[j], return_index=True)
            out_a += [node[i]] * len(at)
            out_b += node[j[at]].tolist()
            tree[np.isin(tree, tree[j])] = tree[i]
    return pd.DataFrame({"a": np.array(out_a, np.int64), "b": np.array(out_b, np.int64)})


def _in_block_pairs(clusters: DataFrame, percent: int, sets: int, elements: int, carried: list[str]):
    """Rows (node, cluster, n, carried) grouped for each level of a cluster and pair of its blocks.

    Linked sets are in one size class or in neighbouring ones: a level holds one class and the next larger.
    """
    own = F.floor(F.log("n") / math.log(102 / percent)).cast("int")
    level = clusters.withColumn("own", own).withColumn("level", F.explode(F.array("own", F.col("own") - 1)))
    weight = level.groupBy("cluster", "level").agg(F.count(F.lit(1)).alias("s"), F.sum("n").alias("e"), F.bool_or(F.col("own") == F.col("level")).alias("low"))
    blocks = weight.where("low and s > 1").select("cluster", "level", F.greatest(F.ceil(F.col("s") / sets), F.ceil(F.col("e") / elements)).cast("int").alias("blocks"))
    placed = level.join(blocks, ["cluster", "level"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("cluster", "level", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "own", "block", "node", "n", *carried)
    by = ["cluster", "level", "bi", "bj"]
    return spread.repartition(*by).groupBy(*by)  # else all blocks of a cluster stay where the sizes were looked up


def tight_clusters(shared: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(node, cluster): the components of the pairs that share a signature and may link by their sketches."""
    large = shared.where(F.col("m") > SMALL)
    dense = pinned(components(_hub_edges(large)).withColumnRenamed("label", "cluster"))
    small = shared.where(F.col("m") <= SMALL).select("sig", "node")
    pairs = small.select("sig", F.col("node").alias("a")).join(small.select("sig", F.col("node").alias("b")), "sig").where("a < b").select("a", "b").distinct()
    # Pairs inside one dense cluster are tested there.
    of = lambda name: dense.select(F.col("node").alias(name), F.col("cluster").alias(f"c{name}"))
    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("ca is null or cb is null or ca <> cb")
    pairs = pinned(pairs.select("a", "b"))
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"k{side}")), side)
    pairs = pairs.where(percent * F.greatest("na", "nb") <= 100 * F.least("na", "nb"))
    near = pinned(pairs.mapInPandas(lambda rows: _near_in_pairs(rows, percent), "a long, b long"))
    held = _in_block_pairs(dense.join(nodes, "node"), percent, SKETCH_SETS, SKETCH_ELEMENTS, ["sketch"])
    forest = pinned(held.applyInPandas(lambda g: _near_in_blocks(g, percent), "a long, b long"))
    return components(near.unionByName(forest)).withColumnRenamed("label", "cluster")


def set_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keys, edges, counts): the set of each row, edges that connect what links connect, and the number of links per node."""
    texts = docs.select(F.col(doc_id).alias("_doc"), text_or_empty(text).alias("_text")).withColumn("_key", F.md5("_text"))
    keys, nodes, salt = named_sets(texts, size)
    clusters = tight_clusters(shared_signatures(texts, size, percent, salt), nodes, percent)

    chosen = pinned(keys.join(clusters, "node", "left_semi").groupBy("node").agg(F.min("_key").alias("_key")))
    few = bounded_broadcast(chosen, chosen.count())

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _sliced(batches):
            yield pd.DataFrame({"node": batch["node"].to_numpy(), "set": [s.view(np.int64) for s in shingle_sets(batch["_text"], size)]})

    one_text = texts.join(few, "_key").select("node", "_text").mapInPandas(build, "node long, set array<long>")
    sets = pinned(one_text.groupBy("node").agg(F.first("set").alias("set")))
    held = _in_block_pairs(clusters.join(nodes.select("node", "n"), "node").join(sets, "node"), percent, BLOCK_SETS, BLOCK_ELEMENTS, ["set"])
    dense = pinned(held.applyInPandas(lambda g: _links_in_blocks(g, percent), "a long, b long, links long"))
    edges = dense.where("a <> b").select("a", "b")
    counts = dense.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    return keys, edges, counts


def _labelled(docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """The rows of ``classes`` and ``_label``, the smallest node of the component; null for texts without words."""
    keys, edges, counts = set_links(docs, doc_id, text, size, percent)
    some = keys.where("n > 0").groupBy("node").agg(F.min("_doc").alias("least"))
    labelled = some.join(components(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    table = labelled.select("node", "label").join(least, "label").join(counts, "node", "left").select("node", "label", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    full = salted_lookup(keys.where("n > 0"), pinned(table), ["node"], 16)
    cols = [F.col("_doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "n_links", "_key", F.col("label").alias("_label")]
    empty = keys.where("n = 0").withColumn("component_id", F.col("_doc")).withColumn("n_links", F.lit(0).cast("long")).withColumn("label", F.lit(None).cast("long"))
    return full.select(*cols).unionByName(empty.select(*cols))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, _key): one row per document; links are to other sets, so copies count once."""
    return _labelled(docs, doc_id, text, size, percent).drop("_label")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest doc_id; null ids come last.  All columns are kept.

    Texts without words are kept.  Of a component's rows with that doc_id the one with the smallest text digest stays,
    once; rows of one doc_id in several components, null ids too, stay once in each.
    """
    key, first, digest = fresh_names(docs.columns, "_key", "_first", "_digest")
    found = _labelled(docs, doc_id, text, size, percent).where("n_shingles > 0")
    chosen = found.groupBy("_label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_key")).alias("c"))
    stay = pinned(chosen.select(F.col("c.doc_id").alias(first), F.col("c._key").alias(digest)))
    rows = docs.withColumn(key, F.md5(text_or_empty(text)))
    bare = F.trim(text_or_empty(text), F.lit(" \t\n\x0b\x0c\r")) == ""
    # A text is in one component, so a row meets one chosen pair at most.
    few = bounded_broadcast(stay, stay.count())
    kept = rows.where(~bare).join(few, F.col(doc_id).eqNullSafe(F.col(first)) & (F.col(key) == F.col(digest)), "left_semi")
    kept = kept.dropDuplicates([doc_id, key])
    return kept.select(*docs.columns).unionByName(rows.where(bare).select(*docs.columns))
