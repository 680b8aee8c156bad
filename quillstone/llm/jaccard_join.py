"""Exact self join of documents whose 5-word shingle sets have a Jaccard similarity of at least 0.75.

Method: universe partition.  Sets of one size band have the shingle universe hashed into m segments; a set and any one
linked with it differ in at most H shingles (H from its size), so at least m - H segments agree.  A segment's
signature hashes its shingles.  What a signature costs is the number of blocks that hold it, and since cost orders all
signatures alike, each set may leave out its c = m - H - 1 dearest (empty segments first): the cheapest signature that a
linked pair shares is always kept by both.  Sets with more than c dear segments index the one-deletion neighbourhoods of their
segments instead of the dear signatures, as long as the cheap segments of two or more shingles alone force an agreement
up to one deletion (2q > H); where they don't, the remaining signatures are kept however dear, and sets of too many
empty segments fall back on single shingles.  Sets of fewer than 32 shingles use single shingles as segments.

Sets that are equal are one class; classes meet in stars (every member with the most central member of a signature: what
a family of copies was made from is linked with most of it), each candidate pair is verified on the texts.  Only sets that
then still share a signature with another component are compared further.  To spare a family's outliers the comparison
with the whole family, candidates must also share a shingle within the few rarest that each could lack, and its places in
both bound the overlap, and so do the parities of their shingles in 1024 classes; outliers meet the most central member of each
component first, and then what is still apart.  A pair's words are compared, not hashes, and no pair is verified twice.

Defined cases: words are runs of bytes outside 0x20 and 0x09-0x0D after A-Z became a-z; fewer than five words are one
shingle; null texts and texts without words have no shingle and are linked with nothing; repeated rows are linked;
a null doc_id never names a component unless all its members are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import PACKED, U, Keys, carried, holders_of, in_blocks, in_order, judged, packed_table, prefix_bytes, table, written
from quillstone.llm.graph import components
from quillstone.llm.text import LOWERCASE, SPACE, grams, mix, slices, utf8, word_hashes, words

WIDTH, NUM, DEN = 5, 75, 100
SMALL, RATIO = 32, 16 / 9
#: Signatures held by so many blocks are dear.
DEAR = 64
#: Lower ends of the size bands: band 0 below SMALL, then steps of RATIO.
LOWER = np.array([1] + [int(np.ceil(SMALL * RATIO**k)) for k in range(60)], np.int64)
UPPER = np.append(LOWER[1:] - 1, 2**62)
#: Most shingles in which two linked sets differ, the smaller in the band: (l + s) / 7 with s at most l * 4 / 3.
DIFFER = np.array([min(2**40, (int(u) + int(u) * DEN // NUM) * (DEN - NUM) // (DEN + NUM)) for u in UPPER], np.int64)
SEGMENTS = DIFFER + 1 + (DIFFER + 1) // 4 + 4
#: Lower ends of the size classes in which open sets meet.
CLASSES = np.unique(np.ceil(1.07 ** np.arange(600)).astype(np.int64))
#: Bits of a set's mark; they tell apart sets of up to about as many shingles, larger ones seldom.
MARK = 1024


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Shingles that any linked set must share with a set of n."""
    return -(-n * NUM // DEN)


def most_differ(n: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Shingles in which a set of n and one linked with it differ at most, where both have keys of the band and one is of the band."""
    partner = np.where(n > UPPER[band], UPPER[band], n * DEN // NUM)
    return (n + partner) * (DEN - NUM) // (DEN + NUM)


class Sets:
    """The shingle sets of one block and their signatures."""

    def __init__(self, texts, lead: int):
        self.lead = lead
        buf, off = utf8(texts)
        start, end, row = words(buf, off)
        docs = len(off) - 1
        word = word_hashes(LOWERCASE[buf], start, end)
        at = np.searchsorted(row, np.arange(docs + 1))
        n_words = np.diff(at)
        i = np.flatnonzero(row[: max(0, len(row) - WIDTH + 1)] == row[WIDTH - 1 :]) if len(row) >= WIDTH else np.zeros(0, np.int64)
        few = [np.flatnonzero(n_words == n) for n in range(1, WIDTH)]
        h = np.concatenate([grams(word, WIDTH)[i], *[grams(word, n)[at[d]] for n, d in enumerate(few, 1)]])
        doc = np.concatenate([row[i], *few])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
        self.h, self.doc = h[new], doc[new]
        self.at = np.searchsorted(self.doc, np.arange(docs + 1))
        self.n = np.diff(self.at)
        total = np.concatenate([[U(0)], np.cumsum(mix(self.h ^ U(0x5DEECE66D)))])
        self.cls = mix(total[self.at[1:]] - total[self.at[:-1]] + self.n.astype(U))

    def set_of(self, doc: int) -> np.ndarray:
        return self.h[self.at[doc] : self.at[doc + 1]]

    def sign(self) -> None:
        """Every (document, band) is an instance; sig, inst and the shingles behind each signature."""
        docs = np.flatnonzero(self.n >= 3)
        band = np.searchsorted(LOWER, self.n[docs], "right") - 1
        below = (band > 0) & (least_overlap(self.n[docs]) < LOWER[band])
        self.inst_doc = np.concatenate([docs, docs[below]])
        self.inst_band = np.concatenate([band, band[below] - 1])
        size = self.n[self.inst_doc]
        inst = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size
        token = self.h[np.arange(len(inst)) - first[inst] + self.at[self.inst_doc][inst]] if len(inst) else np.zeros(0, U)
        b = self.inst_band[inst]
        # segment numbers of band 0 are the shingles themselves
        seg = np.where(b == 0, token >> U(20), mix(token ^ U(0x632BE59BD9B4E019)) % SEGMENTS[b].astype(U))
        order = np.lexsort((seg, inst))
        self.token, inst, seg = mix(token[order]), inst[order], seg[order]
        new = np.append(True, (seg[1:] != seg[:-1]) | (inst[1:] != inst[:-1])) if len(seg) else np.zeros(0, bool)
        self.group = np.flatnonzero(new)
        self.inst, self.count = inst[self.group], np.diff(np.append(self.group, len(inst)))
        with np.errstate(over="ignore"):
            self.sum = np.add.reduceat(self.token, self.group) if len(self.group) else np.zeros(0, U)
            self.place = mix(seg[self.group] * U(64) + self.inst_band[self.inst].astype(U))
            self.sig = mix(self.sum + self.place)

    def keys(self) -> Keys:
        return Keys(self.sig, self.lead)

    def classes(self) -> Keys:
        return Keys(self.cls, self.lead)

    def central(self, cost: np.ndarray) -> np.ndarray:
        """For every document how many blocks hold its signatures on the average, in thousandths: most for what a family was made from."""
        total, count = np.zeros(len(self.n)), np.zeros(len(self.n))
        np.add.at(total, self.inst_doc[self.inst], cost)
        np.add.at(count, self.inst_doc[self.inst], 1)
        return (1000 * total / np.maximum(1, count)).astype(np.int64)

    def allocate(self, cost: np.ndarray, shared: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signature, document) to index, of the documents wanted."""
        sigs, docs = [], []
        ends = np.searchsorted(self.inst, np.arange(len(self.inst_doc) + 1))
        order = np.lexsort((self.sig, cost, self.inst))  # within an instance from cheap to dear
        band, size = self.inst_band, self.n[self.inst_doc]
        filled = np.diff(ends)
        empty = np.where(band == 0, 0, SEGMENTS[band] - filled)
        differ = most_differ(size, band)
        spare = np.where(band == 0, least_overlap(size) - 1, SEGMENTS[band] - 1 - differ)
        keep = np.maximum(0, filled - np.maximum(0, spare - empty))
        rank = np.arange(len(order)) - ends[self.inst[order]]
        kept = np.zeros(len(order), bool)
        kept[order] = rank < keep[self.inst[order]]
        dear = np.bincount(self.inst[cost >= DEAR], minlength=len(band)) + empty
        crowded = (band > 0) & (dear > spare)
        cheap2 = np.bincount(self.inst[(cost < DEAR) & (self.count > 1)], minlength=len(band))
        near = crowded & (2 * cheap2 > differ)
        kept &= ~(near[self.inst] & (cost >= DEAR))
        kept &= shared & wanted[self.inst_doc[self.inst]]
        sigs.append(self.sig[kept])
        docs.append(self.inst_doc[self.inst[kept]])
        for i in np.flatnonzero(crowded & wanted[self.inst_doc]):
            g = np.arange(ends[i], ends[i + 1])
            whole = np.repeat(g, self.count[g])
            tokens = self.token[self.group[g[0]] : self.group[g[0]] + len(whole)] if len(g) else self.token[:0]
            more = [mix(self.sum[g] + self.place[g] + U(1)), mix(self.sum[whole] - tokens + self.place[whole] + U(1))]
            if not near[i] and empty[i] > spare[i]:
                more.append(mix(tokens + U(2 + band[i])))
            more = np.unique(np.concatenate(more))
            sigs.append(more)
            docs.append(np.full(len(more), self.inst_doc[i]))
        return np.concatenate(sigs), np.concatenate(docs)


def profiles(docs: DataFrame, text: str) -> DataFrame:
    """One row per document: row, rest, cls, n_shingles, central, and for the first holder of a class with something to meet also sigs and text."""
    blocks, total = in_blocks(docs, text)
    lead = prefix_bytes(total)

    def first(block: pa.Table) -> pa.Table:
        block = in_order(block)
        s = Sets(block["text"], lead)
        s.sign()
        blk = block["blk"][0].as_py()
        return packed_table(s.keys().rows(blk, 1, 4) + s.classes().rows(blk, 2, 8 - lead))

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        block = in_order(left)
        s = Sets(block["text"], lead)
        s.sign()
        keys = s.keys()
        one = right.filter(pc.equal(right["stage"], 1))
        _, leads = s.classes().flags(right.filter(pc.equal(right["stage"], 2)))
        cost = holders_of(keys, one)
        sig, doc = s.allocate(cost, (cost > 1) | (keys.count > 1)[keys.back], leads & (s.n > 0))
        order = np.argsort(doc, kind="stable")
        sig, edge = sig[order].view(np.int64), np.searchsorted(doc[order], np.arange(len(block) + 1))
        has = np.diff(edge) > 0
        sigs = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(sig))
        texts = block["text"].combine_chunks()
        return pa.table({
            "row": block["row"], "rest": carried(block["rest"]), "cls": pa.array(s.cls.view(np.int64)), "n_shingles": pa.array(s.n, pa.int64()), "central": pa.array(s.central(cost)),
            "sigs": sigs, "text": pc.if_else(pa.array(has), texts, pa.scalar(None, texts.type)),
        })

    dealt = blocks.groupBy("blk")
    answers = judged(dealt.applyInArrow(first, PACKED), holders=True)
    schema = f"row long, rest {blocks.schema['rest'].dataType.simpleString()}, cls long, n_shingles long, central long, sigs array<long>, text string"
    return written(dealt.cogroup(answers.groupBy("blk")).applyInArrow(last, schema), "profiles")


def exact_sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """(text number and shingle number in one, sorted; sizes): the shingle sets of some texts, told apart by their words and not by hashes."""
    buf, off = utf8(texts)
    start, end, row = words(buf, off)
    solid = LOWERCASE[buf[~SPACE[buf]]]
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    each = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(solid)])
    word = np.asarray(each.dictionary_encode().indices, np.int64) + 1
    at = np.searchsorted(row, np.arange(len(off)))
    n_words = np.diff(at)
    whole = np.repeat(n_words >= WIDTH, n_words) & (np.arange(len(row)) + WIDTH <= at[1:][row])
    first = np.concatenate([np.flatnonzero(whole), at[:-1][(n_words > 0) & (n_words < WIDTH)]]).astype(np.int64)
    doc = row[first]
    padded = np.append(word, np.zeros(WIDTH, np.int64))
    number = padded[first]
    for k in range(1, WIDTH):  # a shorter text has zeros behind its words
        more = np.where(first + k < at[1:][doc], padded[first + k], 0)
        number = np.asarray(pa.array(number << 32 | more).dictionary_encode().indices, np.int64)
    held = np.unique(doc.astype(np.int64) << 32 | number)
    return held, np.bincount(held >> 32, minlength=len(off) - 1)


def linked_pairs(left: pa.Array, right: pa.Array) -> np.ndarray:
    """For every two texts that stand in the same place, whether they are linked."""
    both = pa.concat_arrays([left, right]).dictionary_encode()
    held, n = exact_sets(both.dictionary)
    a, b = np.split(np.asarray(both.indices, np.int64), 2)
    at = np.searchsorted(held >> 32, np.arange(len(n) + 1))
    pair = np.repeat(np.arange(len(b)), n[b])
    place = np.arange(len(pair)) - np.repeat(np.cumsum(n[b]) - n[b], n[b]) + at[b][pair]
    want = a[pair] << 32 | held[place] & 0xFFFFFFFF
    found = np.minimum(np.searchsorted(held, want), max(0, len(held) - 1))
    same = np.bincount(pair[held[found] == want], minlength=len(b))
    return DEN * same >= NUM * (n[a] + n[b] - same)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are linked; each pair's texts meet in one row, and their words are compared."""
    near = (F.col("n_a") * NUM <= F.col("n_b") * DEN) & (F.col("n_b") * NUM <= F.col("n_a") * DEN)
    side = lambda c: texts.select(F.col("cls").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("text").alias(f"text_{c}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a").where(near)

    def check(batches):
        for batch in batches:
            a, b = batch.column("text_a"), batch.column("text_b")
            size = np.asarray(pc.add(pc.binary_length(a), pc.binary_length(b)), np.int64)
            for lo, hi in slices(np.concatenate([[0], np.cumsum(size)]), rows=256):
                part = batch.slice(lo, hi - lo)
                good = linked_pairs(a.slice(lo, hi - lo).cast(pa.large_string()), b.slice(lo, hi - lo).cast(pa.large_string()))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(good))

    return met.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def stars(members: DataFrame) -> DataFrame:
    """Pairs of every member of a signature with the signature's most central member."""
    by = F.struct("central", F.col("cls").alias("a"))
    # a reread table has no partitioning, so that both sides are dealt anew and a signature of many members can be split
    lead = written(members.groupBy("sig").agg(F.max(by)["a"].alias("a")), "leads")
    return members.join(lead, "sig").where("a <> cls").select(F.least("a", "cls").alias("a"), F.greatest("a", "cls").alias("b")).distinct()


def still_open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The classes that share a signature with a class of another component."""
    rooted = written(members.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")).select("sig", "cls", "root"), "rooted")
    mixed = rooted.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return rooted.join(written(mixed.select("sig"), "mixed"), "sig").select("cls").distinct()


def marks(s: Sets) -> pa.ListArray:
    """For every set MARK bits: bit i is the parity of the number of its shingles of class i.

    Two sets differ at least in as many shingles as their marks have different bits, whatever the classes are.
    """
    bit = mix(s.h ^ U(0x3C79AC492BA7B653)) % U(MARK)
    out = np.zeros((len(s.n), MARK // 64), U)
    np.bitwise_xor.at(out, (s.doc, (bit >> U(6)).astype(np.int64)), U(1) << (bit & U(63)))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(s.n) + 1, dtype=np.int32) * (MARK // 64)), pa.array(out.ravel().view(np.int64)))


def rare_first(docs: DataFrame) -> DataFrame:
    """key, probe, cls, central, n, pos: what each open set must share with a linked set, its rarest shingles first.

    One more row a set, without a key, holds its `mark`: for each of MARK classes of shingles, whether it has an odd number of them.

    A set of n and a smaller one of at least l, if linked, share at least 3/7 (n + l) shingles, so they meet in the first
    n + 1 - 3/7 (n + l) of the one and in the first n / 7 + 1 of the other, in any order common to both.  Sizes
    fall in classes of ratio 1.07; a set is found under its own class and looks for those of its own and smaller classes.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = docs.withColumn("blk", F.pmod(F.xxhash64("cls"), F.lit(max(255, size // 2_000_000 + 1))))
    lead = prefix_bytes(size)

    def first(block: pa.Table) -> pa.Table:
        s = Sets(block["text"], lead)
        return packed_table(Keys(s.h, lead).rows(block["blk"][0].as_py(), 1, 8 - lead))

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        s = Sets(left["text"], lead)
        keys = Keys(s.h, lead)
        cost = holders_of(keys, right)
        order = np.lexsort((s.h, cost, s.doc))
        pos, n, h = np.arange(len(order)) - s.at[s.doc], s.n[s.doc], s.h[order]
        met = ((cost > 1) | (keys.count > 1)[keys.back])[order]
        least = least_overlap(n)
        low, own = np.searchsorted(CLASSES, least, "right") - 1, np.searchsorted(CLASSES, n, "right") - 1
        found = []
        for step in range(-1, int((own - low).max(initial=-1)) + 1):
            k = own if step < 0 else low + step
            partner = n if step < 0 else np.maximum(least, CLASSES[np.minimum(k, own)])
            at = np.flatnonzero(met & (k <= own) & (pos <= n - -(-(n + partner) * NUM // (DEN + NUM))))
            found.append((mix(h[at] + U(0x9E3779B97F4A7C15) * k[at].astype(U)).view(np.int64), np.full(len(at), step >= 0), at))
        at = np.concatenate([f[2] for f in found])
        row = pa.array(s.doc[at])
        keyed = pa.table({
            "key": np.concatenate([f[0] for f in found]), "probe": np.concatenate([f[1] for f in found]), "cls": left["cls"].take(row),
            "central": left["central"].take(row), "n": n[at], "pos": pos[at],
        })
        return pa.concat_tables([keyed, pa.table({"cls": left["cls"], "mark": marks(s)})], promote_options="default")

    dealt = blocks.groupBy("blk")
    answers = judged(dealt.applyInArrow(first, PACKED), holders=True)
    schema = "key long, probe boolean, cls long, central long, n long, pos long, mark array<long>"
    return dealt.cogroup(answers.groupBy("blk")).applyInArrow(last, schema)


def rooted_rare(rare: DataFrame, roots: DataFrame) -> DataFrame:
    """The keyed rows of `rare` whose key several components hold, with their `root`, their `mark` and the component of most members, `main`."""
    rows = rare.where("key is not null").drop("mark").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    parts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    kinds = parts.groupBy("key").agg(F.max(F.struct("m", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return written(rows.join(kinds.drop("k"), "key").join(rare.where("mark is not null").select("cls", "mark"), "cls"), "crossing")


def crossing(rare: DataFrame, roots: DataFrame, leads_only: bool, rows: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of different components that neither the places of a shared shingle nor the marks rule out.

    `rows`: what `rooted_rare` has made of `rare` and `roots`, if it has been asked before.
    Of the components that share a shingle, the one of most members is not paired with itself; with `leads_only`, members
    of the others meet only the most central member of each component.  Marks decide in the condition of the join, so what
    they rule out is never a row.
    """
    rows = rows or rooted_rare(rare, roots)
    strays, others = rows.where("root <> main"), rows.where("root = main")
    if leads_only:
        best = F.max(F.struct("central", "cls", "n", "pos", "mark")).alias("r")
        others = rows.groupBy("key", "probe", "root").agg(best).select("key", "probe", "root", "r.cls", "r.n", "r.pos", "r.mark")
    side = lambda df, probe, c: df.where(F.col("probe") == probe).select("key", *[F.col(x).alias(f"{x}_{c}") for x in ("cls", "root", "n", "pos", "mark")])
    # of two linked sets, the first shared shingle has the rest of the overlap behind it in both
    may = f"root_a <> root_b and (n_a < n_b or (n_a = n_b and cls_a < cls_b)) and {DEN + NUM} * least(n_a - pos_a, n_b - pos_b) >= {NUM} * (n_a + n_b)"
    apart = " + ".join(f"bit_count(mark_a[{i}] ^ mark_b[{i}])" for i in range(MARK // 64))
    may += f" and {DEN + NUM} * ({apart}) <= {DEN - NUM} * (n_a + n_b)"
    pair = [F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")]
    meet = lambda x, y: side(x, False, "a").join(side(y, True, "b"), "key").where(may).select(*pair)
    return meet(strays, others if leads_only else rows).union(meet(others, strays)).distinct()


def linked_classes(profile: DataFrame) -> DataFrame:
    """(cls, root) of the classes that have a link, and nothing of others.  No pair is verified twice.

    Components are made anew only after a pass that found links.
    """
    texts = profile.where("text is not null").select("cls", "n_shingles", "central", "text")
    members = profile.where(F.size("sigs") > 0).select(F.explode("sigs").alias("sig"), "cls", "central")
    tried = written(stars(members), "tried")
    links = written(verified(tried, texts), "links")
    rooted = lambda: components(links).withColumnRenamed("node", "cls")
    roots, rows = rooted(), None
    texts = written(texts.join(still_open(members, roots), "cls"), "open")
    rare = written(rare_first(texts), "rare")
    for leads_only in (True, False):
        rows = rows or rooted_rare(rare, roots)
        pairs = written(crossing(rare, roots, leads_only, rows).join(tried, ["a", "b"], "left_anti"), "pairs")
        found = written(verified(pairs, texts), "links")
        tried = tried.union(pairs)
        if not found.isEmpty():
            links = links.union(found)
            roots, rows = rooted(), None
    return roots


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", root: bool = False) -> DataFrame:
    """row, doc_id, cls, n_shingles, component_id: one row per document; if asked for, the component's root class."""
    profile = profiles(docs, text)
    roots = linked_classes(profile)
    member = profile.select("row", F.col(f"rest.`{doc_id}`").alias("doc_id"), "cls", "n_shingles")
    lone = member.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    classes = member.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("first"))
    classes = written(classes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "classes")
    names = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(classes.join(names, "root").select("cls", "component_id", *["root"] * root), "named")
    return member.where("n_shingles > 0").join(named, "cls").unionByName(lone, allowMissingColumns=root)


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents without all but one row of each group: of the rows with its least doc_id (nulls last) the least by `row`.

    Of rows that repeat whole one stays, also where their text has no words.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    found = groups(docs, text, doc_id, root=True).where("root is not null")
    stays = found.where("doc_id is not distinct from component_id").groupBy("root").agg(F.min("row").alias("stays"))
    gone = found.select(F.col("row").alias("gone")).distinct().join(stays, F.col("gone") == F.col("stays"), "left_anti")
    kept = docs.select(row.alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")).join(gone, F.col("row") == F.col("gone"), "left_anti")
    return kept.dropDuplicates(["row"]).select(*[F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
