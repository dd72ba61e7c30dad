"""N-gram Jaccard join by T-occurrence search.

The search itself runs over bounded pools of documents: a pool holds an inverted index from shingle to the documents that
have it; for a document the short lists are merged and the long ones are probed by binary search (DivideSkip), and a partner
stays when its overlap reaches the count that the threshold asks for.

Pools come from an exact signature step. Two sets with Jaccard >= t differ in at most H = (n1 + n2)(1 - t)/(1 + t)
shingles, so of k > H parts of the hash space at least k - H are equal in both. Every set writes a hash of each part that
is not empty; k leaves room for the expected number of empty parts, and a set with more empty parts than that divides
again below each of them, so two such sets always meet in some key. Documents with a common key fall into one candidate
block (connected components of star edges, never pairs). A block beyond the pool limit is taken apart by the prefix
principle: counts of its shingles order every set from rare to frequent, and only documents that share one of their rarest
n - ceil(t n) + 1 shingles stay together, so a passage that many documents share joins none of them. Small blocks share pools,
larger ones have one each; one that is still too large is cut into chunks of which every two meet in a cell of their own.
"""

from __future__ import annotations

import heapq
from functools import cache
from itertools import chain
from math import ceil, exp, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import mix, only, ready, saved, signed
from tallybook.llm.components import components
from tallybook.llm.word_ids import batch_rows

#: Shingles of one pool: what one search task holds.
POOL_SHINGLES = 1_000_000
#: A block of more than a pool's shingles through this number has a pool of its own: hashed among others, a few large ones could meet in one.
SHARED_PART = 16
#: Sizes of one band differ by this factor at most.
BAND = 1.2
#: Keys that one map task collects before it links and writes them.
FLUSH_KEYS = 1_000_000
#: Rows of one frame of keys that a task gives.
FRAME_ROWS = 100_000
#: Characters whose words and shingles a task holds at a time (one text at least).
SLICE_CHARS = 1_000_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(texts, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: A-Z lower-cased, words between spaces and tabs to returns."""
    words = [(t.encode("utf-8", "surrogatepass").lower().split() if t else []) for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    out = [np.empty(0, np.uint64)] * len(words)
    if not sizes.sum():
        return out
    codes, unique = pd.factorize(np.fromiter(chain.from_iterable(words), dtype=object, count=int(sizes.sum())))
    hashed = mix(pd.util.hash_array(unique, categorize=False).astype(np.uint64))
    flat = hashed[codes]
    total = np.zeros(max(0, len(flat) - width + 1), np.uint64)
    for j in range(width):
        total += mix(flat[j : j + len(total)] * _ODD[j % 5] + np.uint64(j + 1))
    total = mix(total)
    ends = np.cumsum(sizes)
    for i, (end, size) in enumerate(zip(ends, sizes)):
        if size >= width:
            out[i] = np.unique(total[end - size : end - width + 1])
        elif size:
            part = flat[end - size : end]
            places = np.arange(1, size + 1, dtype=np.uint64) * _ODD[3]
            out[i] = mix(np.array([mix(part + places).sum() + np.uint64(size)], dtype=np.uint64))
    return out


def _sliced_sets(texts, width):
    for part in batch_rows(texts, SLICE_CHARS):
        yield from shingle_sets(texts[part], width)


def set_digest(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set."""
    n = np.uint64(len(grams))
    a, b = mix(grams + _ODD[0]).sum(dtype=np.uint64) + n, mix(grams ^ _ODD[1]).sum(dtype=np.uint64) - n
    return int(np.int64(a.astype(np.int64))), int(np.int64(b.astype(np.int64)))


@cache
def _bounds() -> list[int]:
    out, x = [1], 1.0
    while out[-1] < 1 << 40:
        x *= BAND
        if ceil(x) > out[-1]:
            out.append(ceil(x))
    return out


@cache
def _parts(band: int, num: int, den: int) -> tuple[int, int]:
    """Number of parts of a band and how many of them may be empty; (0, 0) where only equal sets can link."""
    low, high = _bounds()[band], _bounds()[band + 1] - 1
    differ = 2 * high * (den - num) // (den + num)
    if not differ:
        return 0, 0
    k = differ + 1
    for _ in range(20):
        empty = k * exp(-low * num / den / k)  # the smallest set that can link with one of this band
        k = min(2 * differ + 10, differ + 1 + int(empty + 2 * sqrt(empty)))
    return k, k - differ - 1


def _part_keys(grams: np.ndarray, k: int, spare: int, path: int, depth: int) -> list[np.ndarray]:
    place = (mix(grams + np.uint64(path)) >> np.uint64(16)) % np.uint64(k)
    order = np.argsort(place, kind="stable")
    place, content = place[order], mix(grams[order] * _ODD[2] + np.uint64(path))
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    out = [mix(np.add.reduceat(content, first) + mix(place[first] + np.uint64(path)))]
    if k - len(first) > spare:
        empty = mix(np.setdiff1d(np.arange(k, dtype=np.uint64), place[first]) * _ODD[4] + np.uint64(path))
        if depth >= 3:
            return [*out, empty]
        for e in empty:
            out += _part_keys(grams, k, spare, int(e), depth + 1)
    return out


def signature_keys(grams: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of which two sets with Jaccard >= num/den share at least one, unless they are equal."""
    n, bounds, out = len(grams), _bounds(), []
    band = int(np.searchsorted(bounds, n, side="right")) - 1
    while n and bounds[band] * num <= n * den:
        k, spare = _parts(band, num, den)
        if k:
            out += _part_keys(grams, k, spare, int(mix(np.array([band + 1], np.uint64))[0]), 0)
        band += 1
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def needed(n: int, m, num: int, den: int):
    """Overlap that sets of n and m need."""
    return -(-num * (n + m) // (num + den))


def t_occurrence_links(sets: list[np.ndarray], num: int, den: int, chunk=None, copies=None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links (positions) that join all components of the sets; with `chunk`, only links between different chunks count.

    With `copies` (a number for each set) every link is found, also inside a component that is joined already, and the second
    result has for each set the sum of copies of the sets it links with; without, it is zero.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size = size[order]
    if chunk is not None:
        chunk = np.asarray(chunk)[order]
    flat = np.concatenate([sets[i] for i in order]) if len(order) else np.empty(0, np.uint64)
    # Tokens and places of a pool fit 32 bits; each array goes as soon as the next is made.
    token = np.unique(flat, return_inverse=True)[1].astype(np.int32)
    del flat
    length = np.bincount(token)
    start = np.r_[0, np.cumsum(length)]
    lists = np.repeat(np.arange(len(order), dtype=np.int32), size)[np.argsort(token, kind="stable")]
    ends = np.cumsum(size)
    label = np.arange(len(order))
    members = {i: [i] for i in range(len(order))}
    links, linked = [], np.zeros(len(order), np.int64)
    copies = None if copies is None else np.asarray(copies, np.int64)[order]
    for q in range(len(order)):
        n = int(size[q])
        if not n:
            continue
        own = token[ends[q] - n : ends[q]]
        lengths = length[own]
        own = own[np.argsort(lengths, kind="stable")]
        low = int(np.searchsorted(size, -(-num * n // den)))
        if low >= q:
            continue
        least = needed(n, int(size[low]), num, den)
        n_long = min(least - 1, int(least / (0.0085 * np.log(max(2, lengths.max())) + 1)))
        short = own[: n - n_long]
        short = short[length[short] > 1]
        long = np.sort(own[n - n_long :])
        runs = [lists[start[t] : start[t + 1]] for t in short]
        if not runs:
            continue
        if copies is not None:
            for found in _all_partners(q, low, n, n_long, runs, long, (size, token, ends, lists, start), num, den, chunk):
                linked[q] += copies[found].sum()
                linked[found] += copies[q]
                _, one = np.unique(label[found], return_index=True)
                for c in found[one]:
                    _join(q, int(c), order, label, members, links)
            continue
        if sum(map(len, runs)) <= 64:
            merged = np.fromiter(heapq.merge(*runs), np.int64)
        else:
            merged = np.sort(np.concatenate(runs), kind="stable")
        merged = merged[(merged >= low) & (merged < q)]
        merged = merged[label[merged] != label[q]]
        if chunk is not None:
            merged = merged[chunk[merged] != chunk[q]]
        if not len(merged):
            continue
        found, times = np.unique(merged, return_counts=True)
        keep = times + n_long >= needed(n, size[found], num, den)
        found, times = found[keep], times[keep]
        for i in np.argsort(-times, kind="stable"):
            c = int(found[i])
            if label[c] == label[q]:
                continue
            theirs = token[ends[c] - size[c] : ends[c]]
            if n_long:
                at = np.minimum(np.searchsorted(theirs, long), len(theirs) - 1)
                overlap = int(times[i]) + int((theirs[at] == long).sum())
            else:
                overlap = int(times[i])
            if overlap >= needed(n, int(size[c]), num, den):
                _join(q, c, order, label, members, links)
    out = np.zeros(len(order), np.int64)
    out[order] = linked
    return links, out


def _join(q, c, order, label, members, links):
    a, b = int(label[q]), int(label[c])
    if a == b:
        return
    links.append((int(order[q]), int(order[c])))
    if len(members[a]) < len(members[b]):
        a, b = b, a
    moved = members.pop(b)
    label[moved] = a
    members[a] += moved


def _occurrences(runs, low, q):
    """How often each of the sets low to q - 1 is in sorted lists."""
    cut = [r[slice(*np.searchsorted(r, (low, q)))] for r in runs]
    return np.bincount(np.concatenate(cut) - low, minlength=q - low)


def _all_partners(q, low, n, n_long, runs, long, index, num, den, chunk):
    """All sets from low to q - 1 that link with q, at most once as one array: long lists are probed or, for many candidates, counted."""
    size, token, ends, lists, start = index
    times = _occurrences(runs, low, q)
    found = low + np.flatnonzero(times)
    if chunk is not None:
        found = found[chunk[found] != chunk[q]]
    least = needed(n, size[found], num, den)
    keep = times[found - low] + n_long >= least
    found, least = found[keep], least[keep]
    if not len(found):
        return
    overlap = times[found - low]
    if n_long:
        if len(found) * (5000 + 50 * n_long) < 2 * int((start[long + 1] - start[long]).sum()) + 1500 * n_long:  # nanoseconds, roughly
            for i, c in enumerate(found):
                theirs = token[ends[c] - size[c] : ends[c]]
                at = np.minimum(np.searchsorted(theirs, long), len(theirs) - 1)
                overlap[i] += (theirs[at] == long).sum()
        else:
            overlap = overlap + _occurrences([lists[start[t] : start[t + 1]] for t in long], low, q)[found - low]
    found = found[overlap >= least]
    if len(found):
        yield found


def _heads(width):
    def heads(batches):
        for b in batches:
            rest = [[], [], []]
            for s in _sliced_sets(b["text"].to_pylist(), width):
                for column, value in zip(rest, (len(s), *set_digest(s))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["row"], *[pa.array(x, pa.int64()) for x in rest]], ["doc_id", "row", "n_shingles", "d1", "d2"])

    return heads


def _star(key, node):
    """Of rows sorted by key: the place of the first row of each key, for every row."""
    first = np.r_[True, key[1:] != key[:-1]]
    return first, node[np.flatnonzero(first)[np.cumsum(first) - 1]]


def _frames(key, node, edge):
    """Rows in frames of bounded size, as worker and JVM hold each frame whole."""
    for at in range(0, len(key), FRAME_ROWS):
        yield pd.DataFrame({"key": key[at : at + FRAME_ROWS], "node": node[at : at + FRAME_ROWS], "edge": edge})


def _signatures(width, num, den):
    def write(keys, nodes):
        key, node = signed(np.concatenate(keys)), np.concatenate(nodes)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        first, pivot = _star(key, node)
        yield from _frames(key[first], node[first], False)
        more = node != pivot
        if more.any():
            pairs = np.unique(np.c_[node[more], pivot[more]], axis=0)
            yield from _frames(pairs[:, 0], pairs[:, 1], True)

    def signatures(batches):
        keys, nodes, held = [], [], 0
        for b in batches:
            for s in _sliced_sets(b["text"].tolist(), width):
                k = signature_keys(s, num, den)
                if len(k):
                    keys.append(k)
                    nodes.append(np.full(len(k), set_digest(s)[0], np.int64))
                    held += len(k)
                if held >= FLUSH_KEYS:
                    yield from write(keys, nodes)
                    keys, nodes, held = [], [], 0
        if held:
            yield from write(keys, nodes)

    return signatures


def _candidate_edges(batches):
    """Rows come sorted by key; each is joined with the first node of its key."""
    last_key, last_pivot = None, 0
    for b in batches:
        edge = b["edge"].to_numpy()
        if edge.any():
            yield pd.DataFrame({"a": b["key"][edge].to_numpy(), "b": b["node"][edge].to_numpy()})
        key, node = b["key"].to_numpy()[~edge], b["node"].to_numpy()[~edge]
        if not len(key):
            continue
        _, pivot = _star(key, node)
        if last_key == key[0]:
            pivot[key == last_key] = last_pivot
        last_key, last_pivot = key[-1], pivot[-1]
        more = node != pivot
        if more.any():
            pairs = np.unique(np.c_[node[more], pivot[more]], axis=0)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _sets(width):
    def sets(batches):
        for b in batches:
            texts = b["text"].tolist()
            for part in batch_rows(texts, SLICE_CHARS):
                found = shingle_sets(texts[part], width)
                digests = [set_digest(s) for s in found]
                yield pd.DataFrame({"d1": [d[0] for d in digests], "d2": [d[1] for d in digests], "grams": [signed(s) for s in found]})

    return sets


def _search(num, den, count):
    def search(pool):
        pool = pool.drop_duplicates("cid").sort_values("cid")
        ids = pool["cid"].to_numpy()
        chunk = pool["chunk"].to_numpy() if pool["cross"].iloc[0] else None
        copies = pool["n_copies"].to_numpy() if count else None
        links, linked = t_occurrence_links([np.asarray(g, np.int64).view(np.uint64) for g in pool["grams"]], num, den, chunk, copies)
        some = np.flatnonzero(linked)
        a = np.r_[[ids[i] for i, _ in links], ids[some]].astype(np.int64)
        b = np.r_[[ids[j] for _, j in links], ids[some]].astype(np.int64)
        return pd.DataFrame({"a": a, "b": b, "linked": np.r_[np.zeros(len(links), np.int64), linked[some]]})

    return search


def _grams_of(docs, classes, width):
    """(d1, d2, grams) of the documents that represent the classes."""
    ids = classes.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct()
    texts = only(docs.where("doc_id is not null"), ids, "doc_id").select("doc_id", "text")
    return texts.union(docs.where("doc_id is null")).mapInPandas(_sets(width), "d1 long, d2 long, grams array<long>")


def _taken_apart(docs, inside, width, num, den, pool_shingles):
    """`inside` with blocks beyond the pool limit split by the prefix principle, and the size of every block."""
    totals = saved(inside.groupBy("block").agg(F.sum("n").alias("total")), "blocks")
    if totals.where(F.col("total") > pool_shingles).isEmpty():
        return inside, totals
    huge = totals.where(F.col("total") > pool_shingles).select("block")
    large = saved(inside.join(huge, "block"), "large")
    grams = _grams_of(docs, large, width).join(large.select("d1", "d2", "cid", "block", "n"), ["d1", "d2"]).select("cid", "block", "n", F.explode("grams").alias("gram"))
    # Grams of one set only are the rarest: they need not be moved to their set again, only their number counts.
    shared = grams.withColumn("n_sets", F.count("*").over(Window.partitionBy("block", "gram"))).where("n_sets > 1")
    ranked = shared.groupBy("cid", "block", "n").agg(F.sort_array(F.collect_set(F.struct("n_sets", "gram"))).alias("g"))
    prefix = F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1 - (F.col("n") - F.size("g"))
    keys = ranked.select("cid", "block", F.explode(F.slice("g", 1, F.greatest(prefix, F.lit(0)).cast("int"))).alias("x"))
    keys = keys.select(F.xxhash64("block", "x.gram").alias("key"), F.col("cid").alias("node"), F.lit(False).alias("edge"))
    stars = keys.repartition("key").sortWithinPartitions("key", "node").mapInPandas(_candidate_edges, "a long, b long")
    parts = components(stars).select(F.col("node").alias("cid"), F.xxhash64(F.lit("part"), "root").alias("part"))
    split = large.join(parts, "cid").withColumn("block", F.col("part")).select(*inside.columns)
    inside = saved(inside.join(huge, "block", "left_anti").select(*inside.columns).union(split), "inside")
    return inside, saved(inside.groupBy("block").agg(F.sum("n").alias("total")), "blocks")


def _cells(inside, totals, pool_shingles):
    """The sets of `inside` with the cell that searches them: a pool of small blocks, a block, or two chunks of a large one."""
    alone = F.col("total") * SHARED_PART > pool_shingles
    shared = totals.where(~alone).agg(F.sum("total")).first()[0] or 0
    pools = -(-int(shared) * 2 // pool_shingles) or 1
    inside = inside.join(totals, "block")
    chunks = F.ceil(F.col("total") * 2 / F.lit(pool_shingles)).cast("int")
    inside = inside.withColumn("chunks", F.when(F.col("total") <= pool_shingles, 1).otherwise(chunks))
    inside = inside.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    other = F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = inside.withColumn("other", other)
    pool = F.when(alone, F.concat(F.lit("block "), "block")).otherwise(F.concat(F.lit("pool "), F.pmod(F.xxhash64("block"), F.lit(pools))))
    cell = F.when(F.col("other") < 0, pool).otherwise(F.concat_ws(" ", "block", F.least("chunk", "other"), F.greatest("chunk", "other")))
    cells = cells.select("cid", "d1", "d2", "n_copies", "chunk", (F.col("other") >= 0).alias("has_chunks"), F.coalesce(F.col("other") != F.col("chunk"), F.lit(False)).alias("differs"), cell.alias("cell"))
    return cells.withColumn("cross", F.col("has_chunks") & F.col("differs")).drop("has_chunks", "differs")


def ngram_jaccard_join(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, pool_shingles: int = POOL_SHINGLES) -> DataFrame:
    """Groups of documents joined by Jaccard >= num/den over sets of `width`-word shingles.

    Returns doc_id, n_shingles, component_id (smallest doc_id of the group), n_copies (documents with the same set) and n_links
    (other documents at Jaccard >= num/den, copies included), one row per input row. A text with fewer words than `width` is one shingle; null, empty and blank texts have an empty set and
    stay alone. Equal rows count as copies; rows that share a doc_id but not a text are judged each by its own text. A null
    doc_id takes part and its group is named by the other ids (null when there is none). Other columns are not read.
    """
    heads, groups = _grouped(docs.select("doc_id", "text"), width, num, den, pool_shingles, True)
    names = groups.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = saved(groups.join(names, "root").select("d1", "d2", "n_copies", "n_links", "component_id"), "named")
    alone = F.col("n_shingles") == 0
    out = heads.join(named, ["d1", "d2"], "left")
    return out.select(
        "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("n_copies")).cast("long").alias("n_copies"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def _grouped(docs, width, num, den, pool_shingles, count):
    """(doc_id, row, n_shingles, d1, d2) of every row, row being docs' column of that name, if any, and the classes of equal sets (d1, d2, rep, n_copies, root, n_links).

    Without `count` a component is not searched further once it is joined, and n_links has copies only.
    """
    ready(docs.sparkSession)
    row = F.col("row") if "row" in docs.columns else F.lit(None).cast("long")
    heads = saved(docs.select("doc_id", "text", row.alias("row")).mapInArrow(_heads(width), "doc_id long, row long, n_shingles long, d1 long, d2 long"), "heads")
    docs = docs.select("doc_id", "text")
    classes = heads.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.count("*").alias("n_copies"))
    classes = saved(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    keys = docs.mapInPandas(_signatures(width, num, den), "key long, node long, edge boolean")
    stars = keys.repartition("key").sortWithinPartitions("key").mapInPandas(_candidate_edges, "a long, b long")
    blocks = components(stars).withColumnRenamed("node", "d1").withColumnRenamed("root", "block")
    inside = saved(classes.join(blocks, "d1").select("cid", "d1", "d2", "rep", "n", "n_copies", "block"), "inside")

    inside, totals = _taken_apart(docs, inside, width, num, den, pool_shingles)
    cells = _cells(inside, totals, pool_shingles)
    grams = _grams_of(docs, inside, width)
    links = saved(grams.join(cells, ["d1", "d2"]).groupBy("cell").applyInPandas(_search(num, den, count), "a long, b long, linked long"), "links")
    joined = components(links.select("a", "b"))
    linked = links.where("linked > 0").groupBy(F.col("a").alias("cid")).agg(F.sum("linked").alias("linked"))
    groups = classes.join(joined, classes.cid == joined.node, "left").join(linked, "cid", "left")
    groups = groups.select("d1", "d2", "rep", "n_copies", F.coalesce("root", "cid").alias("root"), (F.coalesce("linked", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    return heads, saved(groups, "groups")


def keep_one_per_group(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of each near-duplicate group: that with the smallest doc_id, nulls last, then the smallest row hash; all columns kept.

    Null and shared ids are no exception: rows are judged each by its own text. Rows that are equal in every column are kept
    once. Rows without words stay, as each is a group of its own.
    """
    columns, name = docs.columns, "__row"
    while name in columns:
        name += "_"
    maps = lambda kind: "map<" in kind
    hashed = [F.to_json(F.struct(c)) if maps(kind) else F.col(c) for c, kind in docs.dtypes]
    rows = docs.withColumn(name, F.xxhash64(*hashed, *[F.col(c).isNull() for c in columns]))
    heads, groups = _grouped(rows.select("doc_id", "text", F.col(name).alias("row")), width, num, den, POOL_SHINGLES, False)
    found = heads.where("n_shingles > 0").join(groups.select("d1", "d2", "root"), ["d1", "d2"])
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("row").alias("row"))
    stay = found.groupBy("root").agg(F.min(order).alias("m")).select(F.col("m.row").alias(name))
    stay = saved(stay.union(heads.where("n_shingles = 0").select("row")).distinct(), "stay")
    repeated = not only(heads.select(F.col("row").alias(name)), stay, name).groupBy(name).count().where("count > 1").isEmpty()
    kept = only(rows, stay, name)
    return (kept.dropDuplicates([name]) if repeated else kept).select(*columns)
