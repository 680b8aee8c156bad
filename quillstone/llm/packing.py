"""Best-fit packing of token pieces into sequences by linear grouping.

Method: pieces are counted by length (at most `capacity` counts reach the driver, whatever the input).  Large pieces,
longest first, form `groups` groups of equal cardinality and are rounded up to their group's longest; configurations
of these few sizes are chosen by dynamic programming, always the fullest one that holds the largest size left, and
used as often as the counts allow.  The real pieces then take the slots of their group's configurations, and small
pieces go, longest first, to the fullest sequence that still holds them.  Both plans are tables over ranks, not over
pieces, so every piece finds its place from its length and its rank among equal lengths, where it lies.

Defined cases: a null text is an empty one, whose only token is the end mark; only documents of more than `capacity`
tokens are cut, and only their first piece may be short; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import durable, table, text_of

CAPACITY, END = 1024, 2
PROBES = ("Hello world", "  two  spaces\n\n\ttabs", "it's 2024, don't", "ünï çödé 日本語 🙂", "<|endoftext|>", "a" * 40, "#$%&!! x==y", "")


class Tokens:
    """The ids of a byte-level BPE file.

    The file's merges run in tiktoken, about four times as fast as in tokenizers; both are compared on probe strings
    in every worker, and texts that hold an added token of the file, or that tiktoken refuses, go to tokenizers.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        self.added = {x["content"] for x in stated.get("added_tokens", [])}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(letters[c] for c in t): i for t, i in stated["model"]["vocab"].items() if t not in self.added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        if any(self.ids(x) != self.slow.encode(x, add_special_tokens=False).ids for x in PROBES):
            self.fast = None

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and not any(x in text for x in self.added):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # the Rust side panics on some extreme texts
                if not type(e).__name__ == "PanicException":
                    raise
        return self.slow.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids (little-endian unsigned 32-bit)."""

    def cut(batches):
        tokens = Tokens(tokenizer)
        for batch in batches:
            doc, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                data = array("I", tokens.ids(text) + [END]).tobytes()
                n = len(data) // 4
                start, end = 0, (n - 1) % capacity + 1
                while start < n:
                    own = data[4 * start : 4 * end]
                    doc.append(i)
                    out.append((len(out), start, end - start, zlib.crc32(own), own if with_ids else None))
                    start, end = end, end + capacity
            at = np.array(doc, np.int64)
            nth = np.arange(len(at)) - np.searchsorted(at, at)
            cols = [pa.array([x[k] for x in out], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(nth, pa.int32()), *cols], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")


def numbered(df: DataFrame, key: str, order: list[str], name: str, salts: int = 64) -> DataFrame:
    """`name`: 0-based rank among the rows of one key.

    For keys of few values, so that the (key, salt) counts are at most values times `salts` rows; a value that a third
    of all rows share is ranked by `salts` tasks.
    """
    df = df.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = df.groupBy(key, "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(key, "salt", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy(key, "salt").orderBy(*order)) - 1
    return df.withColumn("rank_in", rank).join(F.broadcast(counts), [key, "salt"]).withColumn(name, F.col("before") + F.col("rank_in")).drop("salt", "before", "rank_in")


def fullest(sizes: list[int], left: list[int], room: int) -> dict[int, int]:
    """Group -> times, of the largest sum of sizes within `room`; larger sizes are tried first."""
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    by = np.full((room + 1, 2), -1)
    for g, (w, n) in enumerate(zip(sizes, left, strict=True)):
        if reached[room] or not n or w > room:
            continue
        old = reached.copy()
        for k in range(1, min(n, room // w) + 1):
            new = np.zeros_like(reached)
            new[k * w :] = old[: room + 1 - k * w]
            new &= ~reached
            by[new] = (g, k)
            reached |= new
    at, found = int(np.flatnonzero(reached)[-1]), {}
    while at:
        g, k = map(int, by[at])
        found[g] = k
        at -= k * sizes[g]
    return found


def large_plan(counts: dict[int, int], small: int, groups: int, capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots as (first rank, ranks, first sequence, a, slot): ranks take `a` slots in each sequence; and the number of sequences.

    Ranks number the pieces longer than `small`, longest first.
    """
    lengths = sorted((n for n in counts if n > small), reverse=True)
    ends = np.cumsum([counts[n] for n in lengths]) if lengths else np.zeros(0, np.int64)
    total = int(ends[-1]) if lengths else 0
    step = max(1, -(-total // groups))
    firsts = list(range(0, total, step))
    sizes = [lengths[int(np.searchsorted(ends, r, "right"))] for r in firsts]
    left = [min(step, total - r) for r in firsts]
    at, plan, used = list(firsts), [], 0
    for g in range(len(sizes)):
        while left[g]:
            left[g] -= 1
            more = fullest(sizes[g:], left[g:], capacity - sizes[g])
            left[g] += 1
            shape = {g + i: k for i, k in more.items()}
            shape[g] = shape.get(g, 0) + 1
            times = min(left[i] // k for i, k in shape.items())
            slot = 0
            for i, k in sorted(shape.items()):
                plan.append((at[i], times * k, used, k, slot))
                at[i] += times * k
                left[i] -= times * k
                slot += k
            used += times
    return sorted(plan), used


def small_plan(counts: dict[int, int], used: dict[int, int], small: int, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, class, first rank in class, offset) for the pieces of at most `small` tokens.

    A class is the set of sequences that large pieces fill to `used` tokens; class 0 is new, empty sequences.  Each
    length goes to the least room that holds it, in runs of equal sequences at a time.
    """
    pools: dict[int, list[tuple[int, int, int]]] = {}
    for u, n in used.items():
        if u < capacity:
            pools.setdefault(capacity - u, []).append((u, 0, n))
    rooms, opened, plan = sorted(pools), 0, []
    for length in sorted((n for n in counts if n <= small), reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                per = capacity // length
                n = -(-left // per)
                insort(rooms, capacity)
                pools[capacity] = [(0, opened, n)]
                opened += n
                continue
            room = rooms[k]
            kind, first, n = pools[room].pop()
            take = min(n, left)
            if take < n:
                pools[room].append((kind, first + take, n - take))
            if not pools[room]:
                del pools[room], rooms[k]
            plan.append((length, rank, take, kind, first, capacity - room))
            rank, left, rest = rank + take, left - take, room - length
            if rest:
                if rest not in pools:
                    pools[rest] = []
                    insort(rooms, rest)
                pools[rest].append((kind, first, take))
    return plan


def packed(found: DataFrame, capacity: int = CAPACITY, small: int = 128, groups: int = 128) -> DataFrame:
    """The pieces with sequence_id and offset."""
    found = durable(found)
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most `capacity` rows
    ranked = durable(numbered(found, "length", ["doc_id", "piece", "start", "ids_crc32"], "nth"))
    plan, sequences = large_plan(counts, small, groups, capacity)
    longer, ahead = {}, 0
    for n in sorted((n for n in counts if n > small), reverse=True):
        longer[n], ahead = ahead, ahead + counts[n]
    table_ = np.array(plan, np.int64).reshape(-1, 5)
    before = np.zeros(capacity + 1, np.int64)
    before[list(longer)] = list(longer.values())

    def place(batches):
        for b in batches:
            rank = before[b.column("length").to_numpy()] + b.column("nth").to_numpy()
            p = table_[np.searchsorted(table_[:, 0], rank, "right") - 1] if len(rank) else table_[:0]
            t = rank - p[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p[:, 2] + t // p[:, 3]), pa.array(p[:, 4] + t % p[:, 3])], names=[*b.schema.names, "sequence_id", "slot"])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema)
    own = Window.partitionBy("sequence_id")
    large = ranked.where(F.col("length") > small).mapInArrow(place, f"{columns}, sequence_id long, slot long")
    large = large.withColumn("offset", F.coalesce(F.sum("length").over(own.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bins = large.groupBy("sequence_id").agg(F.sum("length").alias("used")).where(F.col("used") < capacity)
    bins = durable(numbered(bins, "used", ["sequence_id"], "place"))
    used = {r["used"]: r["count"] for r in bins.groupBy("used").count().collect()}  # at most `capacity` rows
    tiny = np.array(sorted(small_plan(counts, used, small, capacity)), np.int64).reshape(-1, 6)
    tag = tiny[:, 0] << 48 | tiny[:, 1]

    def fit(batches):
        for b in batches:
            n, nth = b.column("length").to_numpy(), b.column("nth").to_numpy()
            p = tiny[np.searchsorted(tag, n << 48 | nth, "right") - 1] if len(n) else tiny[:0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p[:, 3]), pa.array(p[:, 4] + nth - p[:, 1]), pa.array(p[:, 5])], names=[*b.schema.names, "used", "place", "offset"])

    little = ranked.where(F.col("length") <= small).mapInArrow(fit, f"{columns}, used long, place long, offset long")
    little = little.join(bins, ["used", "place"], "left").withColumn("sequence_id", F.coalesce("sequence_id", F.col("place") + sequences))
    out = [*found.columns, "sequence_id", "offset"]
    return large.select(out).unionByName(little.select(out))


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return packed(pieces(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids"))
