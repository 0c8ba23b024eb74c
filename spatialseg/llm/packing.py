"""Best-fit packing of tokenised documents by bin completion.

Every task tokenises its documents and cuts the long ones. Packing needs only
how many pieces have each length, at most ``capacity`` numbers, so the
branch-and-bound runs on that table and gives patterns (which lengths share a
sequence, and how often); pieces then find their places by their rank within
their length. Neither texts nor pieces pass through the driver.

Edge cases: a null text is the empty text and has the end token alone; repeated
rows are packed each; very long texts are read whole; an empty table gives an empty
result; ties between equal lengths are placed by id and piece; other columns, whatever
their names, are ignored. The search ends at its bound or after ``nodes`` completions,
with the best packing so far; ``bin_completion(..., exact=True)`` has no such end and
gives the fewest sequences, in time that may grow with the power of the counts.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialseg.llm.ranks import rank_within
from spatialseg.runtime import cut, shuffle_width

END_ID = 2
TEXTS_AT_ONCE = 64


class Ids:
    """Ids of a byte-level tokenizers file.

    Where the same vocabulary lies beside it as a rank file, plain Latin texts go
    through that faster encoder, which gives the same ids; texts with a special
    string or any other character always go through the tokenizers library. The
    file must be of the plain kind for that: no normaliser, the usual splitting, no
    options of the merges, merges in the order of their ids, the same vocabulary.
    """

    #: The settings of a plain byte-level file, and what its splitting is written out.
    SPLITTING = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    MERGING = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    OTHER = re.compile("[^\\t\\n\\r -~¡-ɏ‐-‧€]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.fast = self.same_ranks(path.removesuffix(".json") + ".tiktoken")

    def same_ranks(self, path: str):
        if not os.path.exists(path):
            return None
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
        vocab = {bytes(byte_of[c] for c in t): i for t, i in self.model.get_vocab(with_added_tokens=False).items() if t not in self.special}
        spec = json.loads(self.model.to_str())
        made = [vocab.get(bytes(byte_of[c] for c in a + b)) for a, b in spec["model"].get("merges", [])]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == self.SPLITTING and {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")} == self.MERGING
        if not plain or vocab != ranks or made != list(range(256, len(vocab))) or public_tokenizers.PATTERN != self.PATTERN:
            return None
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        fast = [self.fast is not None and not self.OTHER.search(t) and not any(s in t for s in self.special) for t in texts]
        rest = iter(self.model.encode_batch_fast([t for t, f in zip(texts, fast, strict=True) if not f], add_special_tokens=False))
        return [self.fast.encode_to_numpy(t) if f else np.array(next(rest).ids, np.uint32) for t, f in zip(texts, fast, strict=True)]


_IDS: dict[str, Ids] = {}


def ids_encoder(path: str) -> Ids:
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


def tokenised_pieces(docs: DataFrame, model_path: str, capacity: int = 1024, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): ids of a text and ``end_id``, cut into pieces of ``capacity`` of which only the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ids_encoder(model_path)
        for b in batches:
            for i in range(0, b.num_rows, TEXTS_AT_ONCE):
                part = b.slice(i, TEXTS_AT_ONCE)
                rows: list[list] = [[], [], [], [], [], []]
                for j, ids in enumerate(encoder.encode([t or "" for t in part.column("text").to_pylist()])):
                    ids = np.append(ids, np.uint32(end_id))
                    at, piece = 0, 0
                    while at < len(ids):
                        end = at + ((len(ids) - at) % capacity or capacity)
                        for col, v in zip(rows, (j, piece, at, end - at, zlib.crc32(ids[at:end].astype("<u4").tobytes()), ids[at:end]), strict=True):
                            col.append(v)
                        at, piece = end, piece + 1
                out = [part.column("id").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *[pa.array(c, pa.int64()) for c in rows[2:5]]]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([x.astype(np.int32) for x in rows[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(out, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on lengths with counts."""
    rooms: dict[int, list[tuple[Pattern, int]]] = {}
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            fit = min((r for r in rooms if r >= n), default=None)
            if fit is None:
                each = capacity // n
                if full := left // each:
                    rooms.setdefault(capacity - each * n, []).append((((n, each),), full))
                if left % each:
                    rooms.setdefault(capacity - left % each * n, []).append((((n, left % each),), 1))
                break
            pattern, copies = rooms[fit].pop()
            if not rooms[fit]:
                del rooms[fit]
            take = min(left, copies)
            if copies > take:
                rooms.setdefault(fit, []).append((pattern, copies - take))
            grown = (*pattern[:-1], (n, pattern[-1][1] + 1)) if pattern[-1][0] == n else (*pattern, (n, 1))
            rooms.setdefault(fit - n, []).append((grown, take))
            left -= take
    return [x for group in rooms.values() for x in group]


def fillings(lengths: list[int], counts: dict[int, int], room: int, waste: int, most: float = 6, steps: float = 400) -> list[Pattern]:
    """Undominated multisets of ``lengths`` (longest first) that leave at most ``waste`` of ``room``, least waste first, larger items first; the search ends after ``steps``, or with ``most`` found of which one leaves nothing."""
    found: list[tuple[int, int, Pattern]] = []
    stack: list[tuple[int, int, Pattern]] = [(0, room, ())]
    while stack and steps > 0 and not (len(found) >= most and found[0][0] == 0):
        steps -= 1
        i, left, chosen = stack.pop()
        while i < len(lengths) and lengths[i] > left:
            i += 1
        if i == len(lengths):
            if left <= waste and not dominated(chosen, lengths, counts, left):
                found.append((left, sum(k for _, k in chosen), chosen))
                found.sort()
            continue
        n = lengths[i]
        stack.append((i + 1, left, chosen))
        stack += [(i + 1, left - k * n, (*chosen, (n, k))) for k in range(1, min(counts[n], left // n) + 1)]
    return [x for _, _, x in (found if math.isinf(most) else found[: int(most)])]


def dominated(chosen: Pattern, lengths: list[int], counts: dict[int, int], slack: int) -> bool:
    """Whether an unused length fits in the place of one or two chosen ones: what fills more with fewer items is never worse."""
    used = dict(chosen)
    items = [n for n, k in chosen for _ in range(min(k, 2))]
    sums = {(n, n + slack) for n in items if slack} | {(a + b, a + b + slack) for i, a in enumerate(items) for b in items[i + 1 :]}
    spare = lambda y: lengths[-1] <= y <= lengths[0] and counts.get(y, 0) > used.get(y, 0)
    return any(spare(y) for lo, hi in sums for y in range(lo + (lo in items), min(hi, lengths[0]) + 1))


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """Bound L2 of Martello and Toth: for each length a, items above capacity - a stand alone, those above a half each open a bin, and the ones from a up to a half fill what these leave."""
    n = np.zeros(capacity + 1, np.int64)
    for length, c in counts.items():
        n[length] += c
    items, size = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * np.arange(capacity + 1))])
    half = capacity // 2
    a = np.arange(half + 1)
    of = lambda x, lo, hi: x[hi + 1] - x[lo]  # noqa: E731  lengths lo to hi
    middle, room = of(items, half + 1, capacity - a), of(items, half + 1, capacity - a) * capacity - of(size, half + 1, capacity - a)
    rest = np.maximum(0, of(size, a, np.full_like(a, half)) - room)
    return int((of(items, capacity - a + 1, np.full_like(a, capacity)) + middle + -(-rest // capacity)).max())


def bin_completion(counts: dict[int, int], capacity: int, nodes: float = 250, exact: bool = False) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used. Best-fit decreasing is the first incumbent; depth-first bin completion around the longest remaining length replaces it while waste bounds allow fewer bins, until the bound L2 is met, or for at most ``nodes`` completions. ``exact`` lifts all limits and takes one bin at a time."""
    limits = {"most": math.inf, "steps": math.inf} if exact else {}
    nodes = math.inf if exact else nodes
    counts = {n: c for n, c in counts.items() if c}
    total = sum(n * c for n, c in counts.items())
    best = best_fit(counts, capacity)
    bins = sum(c for _, c in best)
    least = least_bins(counts, capacity)
    left, spare = dict(counts), 0
    path: list[tuple[Pattern, int]] = []
    tries: list[list[Pattern]] = []

    def allowed() -> int:
        return (bins - 1) * capacity - total - spare  # waste that a better packing may still have

    def options() -> list[Pattern]:
        lengths = sorted((n for n, c in left.items() if c), reverse=True)
        head = lengths[0]
        left[head] -= 1
        out = [((head, 1), *f) for f in fillings(lengths if left[head] else lengths[1:], left, capacity - head, max(0, allowed()), **limits)]
        left[head] += 1
        merged = [((head, 1 + f[1][1]), *f[2:]) if len(f) > 1 and f[1][0] == head else f for f in out]
        return merged[::-1]

    def undo() -> None:
        nonlocal spare
        pattern, copies = path.pop()
        for n, k in pattern:
            left[n] += k * copies
        spare -= copies * (capacity - sum(n * k for n, k in pattern))

    while bins > least and nodes > 0 and allowed() >= 0:
        if not any(left.values()):
            best, bins = list(path), sum(c for _, c in path)
        elif len(tries) == len(path):
            tries.append(options())
        while tries and (not tries[-1] or len(path) == len(tries)):
            if len(path) == len(tries):
                undo()
            if not tries[-1]:
                tries.pop()
        if not tries:
            break
        pattern = tries[-1].pop()
        copies = 1 if exact else min(left[n] // k for n, k in pattern)
        gap = copies * (capacity - sum(n * k for n, k in pattern))
        if gap > allowed():
            copies = min(copies, max(1, allowed() // max(1, gap // copies)))
            gap = copies * (capacity - sum(n * k for n, k in pattern))
        nodes -= 1
        if gap > allowed():
            continue
        for n, k in pattern:
            left[n] -= k * copies
        spare += gap
        path.append((pattern, copies))
    return best


def slots(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, how often in a bin, first bin, offset) for each length of each pattern."""
    rows, next_rank, first_bin = [], {}, 0
    for pattern, copies in patterns:
        offset = 0
        for n, k in pattern:
            start = next_rank.get(n, 0)
            rows.append((n, start, start + k * copies, k, first_bin, offset))
            next_rank[n] = start + k * copies
            offset += n * k
        first_bin += copies
    return rows


def pack(pieces: DataFrame, capacity: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` (written, so that it is not made twice) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    plan = slots(bin_completion(counts, capacity))
    table = spark.createDataFrame(plan or [(0, 0, 0, 1, 0, 0)], "_length long, _first long, _end long, _each long, _bin long, _offset long")
    bucket = F.pmod(F.xxhash64(id_col, "piece"), F.lit(shuffle_width(spark)))
    ranked = rank_within(pieces, ["length"], bucket, [id_col, "piece"])
    at = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))
    k = F.col("_rank") - F.col("_first")
    placed = ranked.join(F.broadcast(table), at)  # a few rows for each length up to the capacity, whatever the input
    return placed.select(*pieces.columns, (F.col("_bin") + F.floor(k / F.col("_each"))).alias("sequence_id"), (F.col("_offset") + k % F.col("_each") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, model_path: str, capacity: int = 1024, id_col: str = "doc_id") -> DataFrame:
    return pack(cut(tokenised_pieces(docs, model_path, capacity, id_col=id_col), "pieces"), capacity, id_col)
