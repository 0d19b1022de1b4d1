"""Similarity join of documents on word shingles: T-occurrence search with DivideSkip.

Two documents link if the Jaccard similarity of their shingle sets reaches
PERCENT per cent. Per group of documents that may link, inverted lists
(shingle -> documents) are searched for each document: the short lists are
merged on a heap, documents that occur often enough there are looked up by
binary search in the long lists, and those that reach the required overlap T
link. Documents already joined by earlier links are not verified again, so a
group of copies costs links in proportion to its documents.

Groups come from a lossless partition of the sets: a linked pair differs in at
most d shingles, so of d + 1 + e hash parts of the sets 1 + e are equal; unless both
sets leave more than e parts empty (these then count too), one equal part is not
empty. Equal parts are found by a shuffle on their hashes; each set leaves out the
most frequent parts that it can spare, and what equal parts connect is a group. A group beyond BLOCK documents is refined by its own shingle
rarities (two linked sets share one of their rarest shingles), then checked
against its most typical member, and only the rest is searched against all of it,
block by block.

Copies with equal sets are one node. Set hashes of 64 bits name the nodes; a
128-bit digest verifies them and a new seed is taken if two sets collide.

Defined results: null text counts as empty; documents without words have an
empty set and link with nothing; fewer words than a shingle are one shingle;
repeated rows link with each other; null ids get the component of their
partners; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordergate.llm.common import (LOWER, bitmap, byte_slices, discard, marked, row_keys, shingle_hashes, split_words, store,
                                  translated, without, word_hashes)
from ordergate.llm.components import components

SHINGLE = 3
PERCENT = 90
BLOCK = 512                 # documents searched together
BLOCK_SHINGLES = 1_000_000  # and their shingles
RARE = 1e-4                 # share of sets that may leave more parts empty than there are spare ones
HEAP_WEIGHT = 0.0085        # DivideSkip's weight of the longest list's logarithm


def required(x, y, percent: int):
    """Least overlap of linked sets of sizes x and y."""
    return -(-percent * (x + y) // (100 + percent))


def sets_of(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text in order, first one of each text and the end)."""
    words, number, first = split_words(translated(texts, LOWER))
    flat = word_hashes(words)[number]
    h = shingle_hashes(flat, shingle)
    count = np.diff(first)
    of = np.repeat(np.arange(len(texts)), count)[:len(h)]
    ok = np.arange(len(h)) + shingle <= first[1:][of]
    of, h = of[ok], h[ok]
    few = np.flatnonzero((count > 0) & (count < shingle))
    if len(few):
        of = np.concatenate([of, few])
        h = np.concatenate([h, [shingle_hashes(flat[first[i]:first[i + 1]], count[i])[0] for i in few]])
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    of, h = of[new], h[new]
    return h, np.searchsorted(of, np.arange(len(texts) + 1))


@functools.lru_cache(maxsize=8)
def size_classes(percent: int, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower bounds, number of parts, spare parts) of set-size classes: linked sets lie in
    the same class or in neighbouring ones, and differ in less than parts - spare shingles."""
    bounds, parts, spares = [1, 2], [], []
    while bounds[-2] <= upto:
        most, least = bounds[-1] - 1, bounds[-2]
        largest = 100 * most // percent
        needed = (100 - percent) * (most + largest) // (100 + percent) + 1
        spare = 1
        while spare < needed + 4 and _above(needed + spare, least, spare) > RARE:
            spare += 1
        parts.append(needed + spare)
        spares.append(spare)
        bounds.append(max(bounds[-1] + 1, largest + 1))
    return np.array(bounds), np.array(parts), np.array(spares)


def _above(parts: int, size: int, spare: int) -> float:
    """How likely a set of ``size`` leaves more than ``spare`` of its parts empty (beyond
    64 parts by the normal distribution)."""
    if parts <= 64:
        filled = np.zeros(parts + 1)
        filled[0] = 1.0
        grow = (parts - np.arange(parts)) / parts
        for _ in range(size):
            filled[1:] = filled[1:] * np.arange(1, parts + 1) / parts + filled[:-1] * grow
            filled[0] = 0.0
        return float(filled[:parts - spare].sum())
    mean = parts * (1 - 1 / parts) ** size
    return 0.5 * math.erfc((spare + 0.5 - mean) / math.sqrt(2 * mean + 1e-9))


_ODD = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


def part_signatures(h: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """(text, signature, family, surplus) of the parts of each set, for its own size class
    (family 0) and as the larger partner of the class below (family 1). Linked sets
    have more than ``surplus`` filled parts in common within a family."""
    size = np.diff(first)
    bounds, parts, spares = size_classes(percent, 1 << max(4, int(size.max(initial=1)).bit_length()))
    columns = [[], [], [], []]
    for below in (0, 1):
        texts = np.flatnonzero(size > below)
        kind = np.searchsorted(bounds, size[texts], "right") - 1 - below
        texts, kind = texts[kind >= 0], kind[kind >= 0]
        m = parts[kind]
        base = np.concatenate([[0], np.cumsum(m)])
        mine = np.repeat(np.arange(len(texts)), size[texts])
        at = np.repeat(first[texts] - np.concatenate([[0], np.cumsum(size[texts])])[:-1], size[texts]) + np.arange(len(mine))
        x = h[at]
        part = (_mixed(x) % m[mine].astype(np.uint64)).astype(np.int64)
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, base[:-1][mine] + part, _mixed(x + _ODD))
        filled = np.bincount(base[:-1][mine] + part, minlength=base[-1]) > 0
        owner = np.repeat(np.arange(len(texts)), m)
        surplus = spares[kind] - np.bincount(owner[~filled], minlength=len(texts))
        use = filled | (surplus < 0)[owner]
        name = (kind[owner] << 32) + np.arange(base[-1]) - base[:-1][owner]
        signature = _mixed(_mixed(total) + _mixed(name.astype(np.uint64) + _ODD))
        for column, values in zip(columns, (texts[owner], signature, np.full(len(owner), below, np.int32),
                                            np.maximum(surplus, 0).astype(np.int32)[owner])):
            column.append(values[use])
    return tuple(np.concatenate(c) for c in columns)


def _node(own: np.ndarray, seed: int) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), seed) - (1 << 63)


def scan(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, node (null for empty sets), digest."""
    def run(batches):
        for batch in batches:
            for row, texts in byte_slices(batch.column(1)):
                h, first = sets_of(texts, shingle)
                sets = [h[a:b] for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, len(texts)), pa.array(np.diff(first)),
                    pa.array([_node(s, seed) if len(s) else None for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                ], ["doc_id", "n_shingles", "node", "digest"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_shingles bigint, node bigint, digest binary")


def part_rows(docs: DataFrame, text_col: str, shingle: int, percent: int, seed: int, bits=None) -> DataFrame:
    """(hash, node, family, surplus) of every part of every set, or of those that a bitmap
    marks; made anew for each use, which costs a scan but no disk."""
    def run(batches):
        for batch in batches:
            for _, texts in byte_slices(batch.column(0)):
                h, first = sets_of(texts, shingle)
                of, signature, family, surplus = part_signatures(h, first, percent)
                if bits is not None:
                    at = marked(bits.value, signature)
                    of, signature, family, surplus = of[at], signature[at], family[at], surplus[at]
                nodes = np.array([_node(h[a:b], seed) if b > a else 0 for a, b in zip(first, first[1:])], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signature.view(np.int64)), pa.array(nodes[of]), pa.array(family), pa.array(surplus)],
                                                 ["hash", "node", "family", "surplus"])
    return docs.select(text_col).mapInArrow(run, "hash bigint, node bigint, family int, surplus int")


def groups(docs: DataFrame, text_col: str, shingle: int, percent: int, seed: int) -> DataFrame:
    """(node, component): nodes connected by equal parts.

    Linked sets have more than ``surplus`` parts in common, so each set may leave out as
    many of its parts, the most frequent ones: in one order for all sets, the rarest
    common part is left out by neither. That keeps passages which many documents
    share from connecting them.
    """
    shared = store(part_rows(docs, text_col, shingle, percent, seed).groupBy("hash")
                   .agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("n")).where("a != z").select("hash", "n"), "shared")
    rows = part_rows(docs, text_col, shingle, percent, seed, bitmap(docs.sparkSession, shared)).join(shared, "hash").distinct()
    place = F.row_number().over(Window.partitionBy("node", "family").orderBy(F.desc("n"), "hash"))   # at most a set's parts
    kept = store(rows.withColumn("place", place).where("place > surplus").select("hash", "node"), "parts")
    first = kept.groupBy("hash").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z").drop("z")
    found = components(kept.join(first, "hash").select("a", F.col("node").alias("b")))
    discard(kept)
    discard(shared)
    return found


def member_sets(docs: DataFrame, text_col: str, shingle: int, seed: int, grouped: DataFrame) -> DataFrame:
    """The rows of ``grouped`` with each node's set (packed sorted hashes) and its size n."""
    bits = bitmap(docs.sparkSession, grouped.select(F.col("node").alias("hash")))

    def run(batches):
        for batch in batches:
            for _, texts in byte_slices(batch.column(0)):
                h, first = sets_of(texts, shingle)
                sets = {_node(h[a:b], seed): h[a:b] for a, b in zip(first, first[1:]) if b > a}
                nodes = np.array(list(sets), np.int64)
                nodes = nodes[marked(bits.value, nodes.view(np.uint64))].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([sets[x].astype("<u8").tobytes() for x in nodes], pa.binary()),
                                                  pa.array([len(sets[x]) for x in nodes], pa.int64())], ["node", "set", "n"])
    rows = docs.select(text_col).mapInArrow(run, "node bigint, set binary, n bigint")
    # Equal nodes have equal sets: any one will do.
    return rows.groupBy("node").agg(F.first("set").alias("set"), F.first("n").alias("n")).join(grouped, "node")


class DivideSkip:
    """Inverted lists over the sets of a block, and the T-occurrence search in them."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([*sets, np.empty(0, np.uint64)])
        of = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        flat, self.docs = flat[order], of[order]
        self.tokens, start = np.unique(flat, return_index=True)
        self.bounds = np.append(start, len(flat))
        # (list, document) as one sorted number, for binary search within a list.
        self.keys = np.repeat(np.arange(len(self.tokens)), np.diff(self.bounds)) * max(1, len(sets)) + self.docs

    def search(self, query: np.ndarray, skip) -> list[int]:
        """Documents of the block that link with ``query``; ``skip(d)`` says which need no answer."""
        n, p = len(query), self.percent
        if not n or not len(self.tokens):
            return []
        at = np.minimum(np.searchsorted(self.tokens, query), max(0, len(self.tokens) - 1))
        lists = at[self.tokens[at] == query]
        length = self.bounds[lists + 1] - self.bounds[lists]
        least = int(required(n, -(-p * n // 100), p))
        if len(lists) < least:
            return []
        lists = lists[np.argsort(-length, kind="stable")]
        long = min(least - 1, int(least / (HEAP_WEIGHT * np.log2(max(2, length.max())) + 1)))
        short = [self.docs[self.bounds[k]:self.bounds[k + 1]].tolist() for k in lists[long:]]
        probe, found = np.sort(lists[:long]) * len(self.size), []
        for d, run in itertools.groupby(heapq.merge(*short)):
            have = sum(1 for _ in run)
            need = int(required(n, self.size[d], p))
            if have + long < need or min(n, self.size[d]) < need or skip(d):
                continue
            if have < need:
                place = np.searchsorted(self.keys, probe + d)
                place = np.minimum(place, len(self.keys) - 1)
                have += int((self.keys[place] == probe + d).sum())
            if have >= need:
                found.append(d)
        return found


def search_tile(sets: list[np.ndarray], is_query: list[bool], is_index: list[bool], percent: int) -> list[tuple[int, int]]:
    """Links between queries and index that connect what is connected, at most one per document."""
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    index = [i for i, x in enumerate(is_index) if x]
    lists, links = DivideSkip([sets[i] for i in index], percent), []
    for q in (i for i, x in enumerate(is_query) if x):
        for d in lists.search(sets[q], lambda d, q=q: root(index[d]) == root(q)):
            a, b = root(q), root(index[d])
            if a != b:
                parent[b] = a
                links.append((q, index[d]))
    return links


def tile_links(tiles: DataFrame, percent: int) -> DataFrame:
    """(a, b) links of rows (tile, node, set, query, index)."""
    def run(group: pa.Table) -> pa.Table:
        nodes = group["node"].to_pylist()
        sets = [np.frombuffer(s, "<u8") for s in group["set"].to_pylist()]
        links = search_tile(sets, group["query"].to_pylist(), group["index"].to_pylist(), percent)
        return pa.table({"a": pa.array([nodes[i] for i, _ in links], pa.int64()),
                         "b": pa.array([nodes[j] for _, j in links], pa.int64())})
    return tiles.groupBy("tile").applyInArrow(run, "a bigint, b bigint")


def _blocks(members: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """(component, blocks): in how many blocks each group is searched."""
    most = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_shingles))
    return members.groupBy("component").agg(most.cast("int").alias("blocks"))


def refine(big: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, component) of members of large groups that share one of their rarest shingles
    with another (the others link with nothing), and (node, typical): how common a
    node's shingles are in its group."""
    def run(batches):
        for batch in batches:
            for c, n, s in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = np.frombuffer(s, "<u8").view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), c)), pa.array(np.full(len(own), n)), pa.array(own)],
                                                 ["component", "node", "hash"])
    rows = store(big.select("component", "node", "set").mapInArrow(run, "component bigint, node bigint, hash bigint"), "large")
    counts = rows.groupBy("component", "hash").agg(F.count("*").alias("df"))
    ranked = rows.join(counts, ["component", "hash"])
    prefix = F.size("all") - F.ceil(F.size("all") * F.lit(percent) / 100).cast("int") + 1
    own = store(ranked.groupBy("component", "node").agg(F.sort_array(F.collect_list(F.struct("df", "hash"))).alias("all"))
                .select("component", "node", F.slice("all", F.lit(1), prefix).getField("hash").alias("rarest"),
                        (F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x["df"]) / F.size("all")).alias("typical")), "rarest")
    tokens = own.select("component", "node", F.explode("rarest").alias("hash"))
    shared = store(tokens.groupBy("component", "hash").agg(F.min("node").alias("a"), F.count("*").alias("k")).where("k > 1").drop("k"), "rare")
    edges = tokens.join(shared, ["component", "hash"]).select("a", F.col("node").alias("b"))
    return components(edges), own.select("node", "typical")


def hub_links(members: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """members with the column ``linked``: whether they link with their group's hub."""
    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            linked = []
            for own, hub in zip(rows["set"], rows.pop("hub_set")):
                a, b = np.frombuffer(own, "<u8"), np.frombuffer(hub, "<u8")
                place = np.minimum(np.searchsorted(b, a), len(b) - 1)
                linked.append(int((b[place] == a).sum()) >= required(len(a), len(b), percent))
            yield pa.RecordBatch.from_pydict(rows | {"linked": linked}, out)
    joined = members.join(hubs, "component").select("component", "blocks", "node", "set", "n", "hub", "hub_set")
    out = pa.schema([("component", pa.int64()), ("blocks", pa.int32()), ("node", pa.int64()), ("set", pa.binary()),
                     ("n", pa.int64()), ("hub", pa.int64()), ("linked", pa.bool_())])
    return joined.mapInArrow(run, "component bigint, blocks int, node bigint, set binary, n bigint, hub bigint, linked boolean")


def links_of(docs: DataFrame, text_col: str, shingle: int, percent: int, seed: int, scanned: DataFrame, grouped: DataFrame,
             block: int, block_shingles: int) -> DataFrame:
    """(a, b): links that connect all that links connect."""
    sizes = scanned.where("node IS NOT NULL").select("node", F.col("n_shingles").alias("n")).distinct().join(grouped, "node")
    sized = store(grouped.join(_blocks(sizes, block, block_shingles), "component"), "sized")
    members = member_sets(docs, text_col, shingle, seed, sized)
    yes = F.lit(True)

    def whole(rows, kind):
        return rows.select(F.struct("component", F.lit(kind).alias("i"), F.lit(kind).alias("j")).alias("tile"),
                           "node", "set", yes.alias("query"), yes.alias("index"))
    if sized.where("blocks > 1").isEmpty():
        return store(tile_links(whole(members, 0), percent), "links")
    members = store(members, "members")
    small = whole(members.where("blocks = 1"), 0)
    large = members.where("blocks > 1").drop("blocks")
    finer, typical = refine(large, percent)
    again = large.drop("component").join(finer, "node")
    again = store(again.join(_blocks(again, block, block_shingles), "component"), "finer")
    small = small.unionByName(whole(again.where("blocks = 1"), 1))
    rest = again.where("blocks > 1")
    hubs = (rest.join(typical, "node").groupBy("component").agg(F.max_by(F.struct("node", "set"), F.struct("typical", "node")).alias("h"))
            .select("component", F.col("h.node").alias("hub"), F.col("h.set").alias("hub_set")))
    judged = store(hub_links(rest, hubs, percent), "hubs")
    to_hub = judged.where("linked AND node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    # What does not link with the hub is searched against the whole group, block by block.
    left = judged.where("NOT linked")
    queries = store(_blocks(left, block, block_shingles).withColumnRenamed("blocks", "rounds"), "rounds")
    place = F.pmod(F.xxhash64("node"), F.col("rounds")).cast("int")
    asking = left.join(queries, "component").select(
        "component", place.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "node", "set",
        yes.alias("query"), F.lit(False).alias("index"))
    asked = judged.join(queries, "component").select(
        "component", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("i"),
        F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("j"), "node", "set",
        F.lit(False).alias("query"), yes.alias("index"))
    name = F.struct("component", (F.col("i") + 2).alias("i"), (F.col("j") + 2).alias("j"))
    crossed = asking.unionByName(asked).select(name.alias("tile"), "node", "set", "query", "index")
    return store(tile_links(small.unionByName(crossed), percent).unionByName(to_hub), "links")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               percent: int = PERCENT, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    for seed in itertools.count():
        scanned = store(scan(docs, id_col, text_col, shingle, seed), "sets")
        collided = scanned.groupBy("node", "digest").count().groupBy("node").count().where("node IS NOT NULL AND count > 1")
        if collided.isEmpty():
            break
    grouped = groups(docs, text_col, shingle, percent, seed)
    linked = components(links_of(docs, text_col, shingle, percent, seed, scanned, grouped, block, block_shingles))
    rows = scanned.select("doc_id", "n_shingles", "node")
    named = store(rows.join(linked, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("class")), "classes")
    several = store(named.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("k"))
                    .where("k > 1").drop("k"), "several")
    return named.join(several, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component, the smallest id's (all columns).

    Decided per row: null ids come last, of rows with the smallest id one stays."""
    rows, key = row_keys(docs, id_col, nulls_first=False)
    found = ngram_join(rows, key, text_col, **options)
    return without(rows, store(found.where("doc_id != component_id").select("doc_id"), "near-copies"), key)
