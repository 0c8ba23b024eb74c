"""N-gram Jaccard join by universe partition and the pigeonhole principle.

Two sets with Jaccard similarity t or more differ in at most H tokens, H
following from their sizes. The tokens' universe is hashed into segments, their
number set by the size band. A segment of weight one is indexed whole; one of
weight two also with its one-deletion neighbourhood and so stands for two. Of
segments of total weight H+1 one must agree, so documents that share a signature
are candidates; they are verified exactly.

Small sets take segments of weight two, larger ones segments of weight one and some
more than the H+1. What a set then looks for is allocated by measured cost: it stays
in all its buckets to be found, but does not look into its largest ones (a passage
that many documents share), as many as it has segments to spare.

Buckets of any size are dealt in blocks, each with each. First the members of a
block meet its first and last one, which ties copies together; then those that
are still in different components meet. Sizes and parity sketches reject most
pairs before a set is fetched. Equal sets are one node from the start. For the
numbers of links, the other pairs inside a component are verified block by block.

Edge cases: null and empty texts have the empty set, a component of their own
and no links; fewer words than ``n`` make one shingle of the whole sequence;
rows that share an id are one node; rows with a null id get null; repeated rows
each get their row; ids may be of any type with an order; very long texts are read
whole; other columns, whatever their names, are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spatialseg import runtime
from spatialseg.components import connected_components
from spatialseg.runtime import Scratch

BAND = 1.5  # ratio of band ends
SMALL = 64  # bands up to this size take segments of weight two
HOT = 64  # members of a bucket beyond which a document with segments to spare does not look into it
BLOCK, LINK_BLOCK = 2048, 256  # members of a bucket, and of a component, that a task compares with so many others
SKETCH_BITS = (128, 2048)  # least and most bits of a sketch; between them two for each token
BROADCAST_BYTES = 16 << 20  # most bytes of rows that are broadcast; beyond that a join is shuffled
ROWS_AT_ONCE, PAIRS_AT_ONCE = 100_000, 200_000
MEMO_WORDS = 100_000
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
ALONE = np.uint64(0xD6E8FEB86659FD93)  # keeps signatures of tokens apart from those of segments


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(33))) * M2
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct word n-grams (ASCII lower case, ASCII white space)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    x = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        x = mixed(x * M2 + h[i : len(h) - k + 1 + i])
    return np.unique(x)


@lru_cache(maxsize=None)
def band_ends(upto: int = 1 << 40) -> tuple[int, ...]:
    """Smallest size of each band."""
    ends = [1]
    while ends[-1] < upto:
        ends.append(max(ends[-1] + 1, int(ends[-1] * BAND)))
    return tuple(ends)


def differ(size: int, num: int, den: int) -> int:
    """Most tokens in which a set and a larger one can differ at similarity num/den."""
    return size * (den - num) // num


@lru_cache(maxsize=4096)
def allocation(band: int, num: int, den: int) -> tuple[int, int]:
    """(segments, weight of each) of a band, with some to spare for empty ones."""
    size = band_ends()[band + 1] - 1
    need = differ(size, num, den) + 1
    if size <= SMALL:
        return (1 if need <= 2 else -(-need // 2) + 1), 2
    empty = need * math.exp(-size / need)
    return need + math.ceil(empty + 6 * math.sqrt(empty)) + 2, 1


def bands_of(n: int, num: int, den: int) -> range:
    """Bands of a set's size and of the smaller sets that it can be linked with."""
    first, own = np.searchsorted(band_ends(), (-(-n * num // den), n), "right") - 1
    return range(int(first), int(own) + 1)


def signatures(x: np.ndarray, num: int, den: int) -> tuple[np.ndarray, list[int]]:
    """Signatures of a set, the last two bits of each telling its band, and by these bits how many segments it has to spare.

    Any two sets that are linked and not equal share a signature, also when either of
    them leaves out as many as it has to spare. A set with too few filled segments
    shares one with every partner that has enough; among such sets alone, single
    tokens are signatures too.
    """
    out, spare = [np.zeros(0, np.uint64)], [0, 0, 0, 0]
    for band in bands_of(len(x), num, den):
        need = differ(min(len(x), band_ends()[band + 1] - 1), num, den) + 1
        if need == 1:
            continue  # only equal sets are linked
        n, weight = allocation(band, num, den)
        with np.errstate(over="ignore"):
            of = (((mixed(x + np.uint64(band + 1)) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)
            count = np.bincount(of, minlength=n)
            token, sums = mixed(x), np.zeros(n, np.uint64)
            filled = np.flatnonzero(count)
            sums[filled] = np.add.reduceat(token[np.argsort(of, kind="stable")], np.cumsum(count)[filled] - count[filled])
            salt = mixed((np.arange(n, dtype=np.uint64) + np.uint64(1)) * M1 + np.uint64(band + 1))
            found = [mixed(sums[filled] + salt[filled])]
            if weight == 2:
                t = np.flatnonzero(count[of] > 1)
                found.append(mixed(sums[of[t]] - token[t] + salt[of[t]]))
        reached = int(np.minimum(count, weight).sum())
        if reached < need:
            found.append(mixed(x ^ ALONE))
        elif weight == 1:
            spare[band & 3] = reached - need
        out.append(np.concatenate(found) & ~np.uint64(3) | np.uint64(band & 3))
    return np.unique(np.concatenate(out)), spare


def sketch(x: np.ndarray) -> bytes:
    """Parities of token classes, about two for each token: two sketches differ in no more bits than their sets in tokens."""
    bits = min(max(SKETCH_BITS[0], 1 << (2 * len(x) - 1).bit_length()), SKETCH_BITS[1])
    odd = np.bincount((mixed(x ^ M2) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class Sketches:
    """Sketches of many sets, each folded to all widths up to its own."""

    def __init__(self, raw: list[bytes]):
        self.width = np.array([len(b) * 8 for b in raw], np.int64)
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        above: tuple[np.ndarray, np.ndarray] | None = None
        for bits in sorted(set(self.width.tolist()), reverse=True):
            while above is not None and above[1].shape[1] * 64 > bits:
                half = above[1].shape[1] // 2
                above = above[0], above[1][:, :half] ^ above[1][:, half:]
            rows = np.flatnonzero(self.width == bits)
            own = np.frombuffer(b"".join(raw[i] for i in rows), np.uint64).reshape(len(rows), -1)
            above = (rows, own) if above is None else (np.concatenate([above[0], rows]), np.concatenate([above[1], own]))
            self.folded[bits] = above

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of each pair differ, at the width of the narrower."""
        out = np.zeros(len(a), np.int64)
        both = np.minimum(self.width[a], self.width[b])
        for bits, (rows, words) in self.folded.items():
            at = np.flatnonzero(both == bits)
            if len(at):
                place = np.zeros(len(self.width), np.int64)
                place[rows] = np.arange(len(rows))
                out[at] = np.bitwise_count(words[place[a[at]]] ^ words[place[b[at]]]).sum(axis=1, dtype=np.int64)
        return out


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        pa.default_memory_pool().release_unused()


def set_table(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(node, n_shingles, d1, d2, sketch, spare, sigs) of (node, text) rows; d1 and d2 are the digest of a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in in_parts(batches):
            rows = []
            for t in part.column("text"):
                x = shingle_set(t.as_py(), n)
                sigs, spare = signatures(x, num, den) if len(x) else (x, [0, 0, 0, 0])
                rows.append((len(x), *np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64).tolist(), sketch(x) if len(x) else b"", spare, sigs.view(np.int64)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.record_batch([part.column("node"), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], names=["node", "n_shingles", "d1", "d2", "sketch", "spare", "sigs"])

    return docs.select("node", "text").mapInArrow(run, f"node {docs.schema['node'].dataType.simpleString()}, n_shingles long, d1 long, d2 long, sketch binary, spare array<int>, sigs array<long>")


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """(node, n_shingles, tokens) of (node, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches):
            sets = [shingle_set(t.as_py(), n).view(np.int64) for t in part.column("text")]
            yield pa.record_batch([part.column("node"), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "n_shingles", "tokens"])

    return docs.select("node", "text").mapInArrow(run, f"node {docs.schema['node'].dataType.simpleString()}, n_shingles long, tokens array<long>")


def few(df: DataFrame) -> bool:
    """Whether the rows of ``df``, all of fixed width, are few enough to be broadcast."""
    most = BROADCAST_BYTES // sum(32 if t in ("string", "binary") else 8 for _, t in df.dtypes)
    return df.limit(most + 1).count() <= most


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcasting if a count shows that it is small."""
    return F.broadcast(df) if few(df) else df


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the start of each, from batches that are sorted by ``keys``. A group is of bounded size."""
    kept: list[pa.RecordBatch] = []
    waiting = 0
    for b in batches:
        kept.append(b)
        waiting += b.num_rows
        if waiting >= ROWS_AT_ONCE:
            t = pa.Table.from_batches(kept).combine_chunks()
            starts = group_starts(t, keys)
            if starts[-1]:
                yield t.slice(0, starts[-1]), starts[:-1]
                t = t.slice(starts[-1])
            kept, waiting = t.to_batches(), t.num_rows
    if waiting:
        t = pa.Table.from_batches(kept).combine_chunks()
        yield t, group_starts(t, keys)


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        x = t.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def star_pairs(t: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a group with its first one, and with its last one."""
    sizes = np.diff(np.append(starts, t.num_rows))
    every = np.arange(t.num_rows)
    first, last = np.repeat(starts, sizes), np.repeat(starts + sizes - 1, sizes)
    yield first[every > first], every[every > first]
    inner = (every > first) & (every < last)
    yield every[inner], last[inner]


def all_pairs(t: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group: of block i with block j, or inside the one block."""
    own, i, j = (t.column(c).to_numpy() for c in ("own", "i", "j"))
    sizes = np.diff(np.append(starts, t.num_rows))
    inside = i[starts] == j[starts]
    for m in np.unique(sizes[inside]):
        a, b = np.triu_indices(m, 1)
        these = starts[inside & (sizes == m)]
        step = max(1, PAIRS_AT_ONCE // max(1, len(a)))
        for k in range(0, len(these), step):
            part = these[k : k + step, None]
            yield (part + a).ravel(), (part + b).ravel()
    for s, m in zip(starts[~inside], sizes[~inside], strict=True):
        of = own[s : s + m]
        a, b = s + np.flatnonzero(of == i[s]), s + np.flatnonzero(of == j[s])
        yield np.repeat(a, len(b)), np.tile(b, len(a))


def met_pairs(dealt: DataFrame, keys: list[str], pairs_of: Callable, num: int, den: int) -> DataFrame:
    """(a, b): pairs of a group of ``dealt`` (keys, node, component, n_shingles, sketch, probe) whose components differ and whose sizes and sketches allow a link."""
    kind = dealt.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in groups_of(batches, keys):
            node, comp = (t.column(c).combine_chunks().dictionary_encode() for c in ("node", "component"))
            code, c = (x.indices.to_numpy() for x in (node, comp))
            size, probe = t.column("n_shingles").to_numpy(), t.column("probe").to_numpy()
            marks = Sketches(t.column("sketch").to_pylist())
            found = [np.zeros(0, np.int64)]
            for a, b in pairs_of(t, starts):
                low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
                ok = (code[a] != code[b]) & (c[a] != c[b]) & (probe[a] | probe[b]) & (low * den >= high * num)
                a, b = a[ok], b[ok]
                for k in range(0, len(a), PAIRS_AT_ONCE):
                    x, y = a[k : k + PAIRS_AT_ONCE], b[k : k + PAIRS_AT_ONCE]
                    near = marks.differ(x, y) * (den + num) <= (size[x] + size[y]) * (den - num)
                    x, y = code[x[near]].astype(np.int64), code[y[near]].astype(np.int64)
                    found.append(np.unique(np.minimum(x, y) << 32 | np.maximum(x, y)))
            both = np.unique(np.concatenate(found))
            yield pa.record_batch([node.dictionary.take(pa.array(both >> 32)), node.dictionary.take(pa.array(both & 0xFFFFFFFF))], names=["a", "b"])

    rows = dealt.select(*keys, *[c for c in ("own",) if c not in keys], "node", "component", "n_shingles", "sketch", "probe").repartition(*keys).sortWithinPartitions(*keys, "node")
    met = rows.mapInArrow(run, f"a {kind}, b {kind}")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def in_blocks(rows: DataFrame, keys: list[str], sizes: DataFrame, block: int) -> DataFrame:
    """``rows`` dealt into blocks of about ``block`` rows: with own, and once for each other block, the lower and higher of both in i and j."""
    zero = F.lit(0).cast("int")
    whole = rows.join(sizes.where(F.col("n") <= block).select(*keys), keys).withColumns({"own": zero, "i": zero, "j": zero})
    blocks = sizes.where(F.col("n") > block).select(*keys, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = rows.join(small(blocks), keys).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return whole.unionByName(dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other"))


def links_inside(members: DataFrame, comp: DataFrame, links: DataFrame, sets: DataFrame, num: int, den: int, cut: Callable, as_pairs: bool) -> tuple[DataFrame, DataFrame]:
    """The links inside the components of (sig, node) ``members``, and the components that are counted.

    Pairs meet in their component, or in its signatures if these have fewer pairs; a
    bucket is dealt in blocks, each with each. Where a component is one bucket, each pair
    meets once: then a row (a, null, n) is the number of links of node a, and no pair
    leaves its block. Pairs that may meet in several signatures, or all if ``as_pairs``,
    are rows (a, b, n), each once.
    """
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    known = links.join(comp, F.col("a") == F.col("node")).groupBy("component").agg(F.count(F.lit(1)).alias("known"))
    size = small(cut(size.join(known, "component").where("m * (m - 1) / 2 > known").select("component", "m"), "component-sizes"))
    of_sig = members.select("sig", "node").distinct().join(comp, "node").join(size, "component")
    pairs = of_sig.groupBy("component", "sig").agg(F.count(F.lit(1)).alias("k")).groupBy("component").agg(F.sum(F.col("k") * F.col("k")).alias("of_sigs"))
    whole = size.join(pairs, "component", "left").where("of_sigs is null or m * m <= of_sigs or m <= 16").select("component")
    whole = small(cut(whole, "whole"))
    inside = comp.join(whole, "component").select("component", F.lit(0).cast("long").alias("bucket"), F.lit(not as_pairs).alias("counted"), "node")
    apart = of_sig.join(whole, "component", "left_anti").select("component", F.col("sig").alias("bucket"), F.lit(False).alias("counted"), "node")
    placed = inside.unionByName(apart)
    sizes = cut(placed.groupBy("component", "bucket").agg(F.count(F.lit(1)).alias("n")), "sizes")
    each = in_blocks(placed, ["component", "bucket"], sizes, LINK_BLOCK).join(sets, "node")
    kind = comp.schema["node"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        own, size = t.column("own").to_numpy(), t.column("n_shingles").to_numpy()
        node = t.column("node").combine_chunks()
        tokens = [x.values.to_numpy() for x in t.column("tokens")]
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        right, left = np.flatnonzero(own == j), np.flatnonzero(own == i)
        flat, starts = np.concatenate([tokens[r] for r in right] or [np.zeros(0, np.int64)]), np.cumsum(size[right]) - size[right]
        a, b, counted = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(t.num_rows, np.int64)
        as_counts = t.column("counted")[0].as_py()
        for x in left if len(right) else ():
            mine = tokens[x].view(np.uint64)
            at = np.minimum(np.searchsorted(mine, flat.view(np.uint64)), len(mine) - 1)
            both = np.add.reduceat((tokens[x][at] == flat).astype(np.int64), starts)
            linked = right[(both * den >= (size[x] + size[right] - both) * num) & ((right > x) if i == j else (right != x))]
            if as_counts:
                counted[x] += len(linked)
                counted[linked] += 1
            else:
                a.append(np.full(len(linked), x))
                b.append(linked)
        if as_counts:
            rows = np.flatnonzero(counted)
            return pa.table({"x": node.take(pa.array(rows)), "y": pa.nulls(len(rows), node.type), "n": pa.array(counted[rows])})
        x = np.concatenate(a)
        return pa.table({"x": node.take(pa.array(x)), "y": node.take(pa.array(np.concatenate(b))), "n": pa.array(np.ones(len(x), np.int64))})

    met = each.select("component", "bucket", "counted", "i", "j", "own", "node", "n_shingles", "tokens").groupBy("component", "bucket", "i", "j").applyInArrow(run, f"x {kind}, y {kind}, n long")
    named = met.where("y is null or x <> y").select(F.least("x", "y").alias("a"), F.when(F.col("y").isNotNull(), F.greatest("x", "y")).alias("b"), "n")
    return named.groupBy("a", "b").agg(F.sum("n").alias("n")), whole


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """(id, n_shingles, component_id, n_links): components of links with similarity num/den or more, named by their smallest id. n_links counts the different sets of other texts that are linked; it is null without ``count_links``."""
    texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession, "jaccard")
    cut = scratch.cut
    table = cut(set_table(texts, n, num, den), "sets")
    full = table.where("n_shingles > 0 and node is not null")
    ids = cut(table.select("node", "n_shingles", "d1", "d2"), "ids")
    light = ids.where("n_shingles > 0 and node is not null")
    # equal sets are one node, the smallest id; the signatures of the others are left out without shuffling any
    groups = cut(light.groupBy("d1", "d2", "n_shingles").agg(F.min("node").alias("rep")), "groups")
    copies = cut(light.join(groups, ["d1", "d2", "n_shingles"]).where("node <> rep").select("node", "rep", "d1", "d2").distinct(), "copies")
    reps = full.join(small(copies.select("node", "d1", "d2")), ["node", "d1", "d2"], "left_anti")
    nodes = cut(reps.select("node", "n_shingles", "sketch", "spare", "d1", "d2").dropDuplicates(["node", "d1", "d2"]), "nodes")
    rows = reps.select("node", F.explode("sigs").alias("sig"))
    shared = cut(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    repeats = not light.groupBy("node").count().where("count > 1").isEmpty()
    members = rows.join(small(shared.select("sig")), "sig")
    members = cut(members.distinct() if repeats else members, "members")
    scratch.drop(table)  # signatures are not read again, and take the most room
    # documents with segments to spare are found in large buckets, but do not look into them
    hot = small(shared.where(f"n > {HOT}"))
    band = F.col("sig").bitwiseAND(3).cast("int")
    spare = nodes.groupBy("node").agg(*[F.min(F.col("spare")[i]).alias(f"s{i}") for i in range(4)])
    largest = F.row_number().over(Window.partitionBy("node", "band").orderBy(F.desc("n"), "sig"))
    in_hot = members.join(hot, "sig").withColumn("band", band).withColumn("place", largest).join(spare, "node")
    in_hot = in_hot.select("sig", "node", (F.col("place") > F.element_at(F.array(*[f"s{i}" for i in range(4)]), F.col("band") + 1)).alias("probe"))
    old, members = members, cut(members.join(hot.select("sig"), "sig", "left_anti").withColumn("probe", F.lit(True)).unionByName(in_hot), "members")
    scratch.drop(old)

    def with_sketch(dealt: DataFrame) -> DataFrame:
        return dealt.join(nodes.select("node", "n_shingles", "sketch"), "node")

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("a_tokens", "b_tokens"))
        union = F.col("a_n_shingles") + F.col("b_n_shingles") - both
        side = lambda m: sets.select(*[F.col(c).alias(f"{m}_{c}") for c in ("node", "n_shingles", "tokens")])
        joined = small(pairs).join(side("a"), F.col("a") == F.col("a_node")).join(side("b"), F.col("b") == F.col("b_node"))
        return joined.where(both * den >= union * num).select("a", "b").distinct()

    def fetch(needed: DataFrame, name: str) -> DataFrame:
        sets = sets_of(texts.join(small(cut(needed, f"{name}-ids")), "node", "left_semi"), n)
        return cut(sets.distinct() if repeats else sets, name)

    ends = lambda pairs: pairs.select("a").union(pairs.select("b")).distinct().toDF("node")
    bucket = members.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.max("probe").alias("any")).where("n > 1 and any").drop("any")
    star = members.join(bucket, "sig").withColumn("own", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)).cast("int")).withColumn("component", F.col("node"))
    tested = cut(met_pairs(with_sketch(star), ["sig", "own"], star_pairs, num, den), "pairs")
    sets = fetch(ends(tested), "tokens")
    links = cut(verified(tested, sets), "links")
    comp = cut(connected_components(links, "a", "b", cut), "components")
    # what is in different components still meets
    named = members.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = named.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("probe").alias("any")).where("n > 2 and lo < hi and any").select("sig", "n")
    open_ = cut(open_, "open")
    dealt = in_blocks(named, ["sig"], open_, BLOCK)
    late = cut(met_pairs(with_sketch(dealt), ["sig", "i", "j"], all_pairs, num, den).join(tested, ["a", "b"], "left_anti"), "pairs")
    if not late.isEmpty():
        more = fetch(ends(late).join(sets, "node", "left_anti"), "tokens")
        sets = sets.unionByName(more)
        new = cut(verified(late, sets), "links")
        if not new.isEmpty():
            links = links.unionByName(new)
            tied = comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
            comp = cut(connected_components(tied.unionByName(new), "a", "b", cut), "components")
    degree = None
    if count_links:
        inside, counted = links_inside(members, comp, links, sets, num, den, cut, repeats)
        inside = cut(inside, "inside")
        apart = links if repeats else links.join(comp, F.col("a") == F.col("node")).join(counted, "component", "left_anti").select("a", "b")
        pairs = apart.unionByName(inside.where("b is not null").select("a", "b")).distinct()
        ends_of = pairs.select(F.explode(F.array("a", "b")).alias("rep"), F.lit(1).cast("long").alias("n")).unionByName(inside.where("b is null").select(F.col("a").alias("rep"), "n"))
        degree = cut(ends_of.groupBy("rep").agg(F.sum("n").alias("n_links")), "degrees")
    # rows of one id tie their sets together
    ties = copies.select("node", "rep").distinct()
    repeated = ties.groupBy("node").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    if repeats and (not repeated.isEmpty() or not nodes.groupBy("node").count().where("count > 1").join(ties, "node", "left_semi").isEmpty() or not ties.join(nodes, "node", "left_semi").isEmpty()):
        comp = cut(connected_components(ties.toDF("a", "b").union(comp.select(F.col("node").alias("a"), F.col("component").alias("b"))), "a", "b", cut), "components")
    of_group = (groups.join(degree, "rep", "left") if count_links else groups).join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("n_links", F.lit(0)) if count_links else F.lit(None).cast("long")).alias("n_links"))
    linked = light.join(of_group, ["d1", "d2", "n_shingles"]).select("node", "n_shingles", "component_id", "n_links")
    alone = ids.where("n_shingles = 0 or node is null").select("node", "n_shingles", F.col("node").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    result = runtime.cut(linked.unionByName(alone).withColumnRenamed("node", id_col), "classes")
    scratch.close()
    return result
