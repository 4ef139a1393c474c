"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least a bound.

Keys are put in one order for all documents, those in few documents first. Of a set of n keys the last
ceil(bound * n) - 1 are its long lists and the others, its prefix, the short ones: as a similar document
shares at least ceil(bound * n) keys, it shares one of the prefix.

1. Every task names the set of each document and counts the documents of each key; the counts are added up by key ranges. The most
   frequent keys, at most ``FREQUENT`` of them, go to every task with their counts (a fixed size); all
   other keys come first in the order. The order decides how much work is done, never what is found.
2. Every document gives its prefix keys. Inverted lists are built by key range, after each task has
   already merged its own entries: of a long list only chains of documents with compatible sizes remain, each
   as one entry with its range of sizes. So a list that holds a third of all documents comes down to a
   few entries for each task, and gives links only, not pairs. A chain of up to ``LIST`` documents gives its pairs, and
   those whose sketches differ in more bits than similar sets can in keys are left out: the more documents
   there are, the more keys that no table holds lie in a few unrelated ones by chance.
3. The components of what is left are blocks: no similar pair lies in two of them. Large blocks go through
   steps 1 and 2 again by themselves, as counts within them tell more keys apart. Whole sets of the
   documents in blocks of two or more go to their block. A block that is still large is cut into slices: they are joined
   by themselves, then by representatives, and pairs of slices meet only where more than one class is left.
4. Within a block, T-occurrence search finds for every document those of the block that share the
   required number of keys: its short lists are merged with a heap and counted, and documents that can still
   reach the number are probed in the long lists by binary search, as in DivideSkip; documents that are already
   in the same class are left out. More than ``HEAP`` entries are sorted and counted by numpy instead.
5. Components of the links found are the classes.

Documents with equal sets are one throughout (by 127 bits of a hash of the set), so copies cost no pairs.
Keys are 64-bit hashes of shingles, in step 2 their upper 48 bits; sets have names of 63 bits there, and sets
that share one by chance only meet in a block.

Defined cases: null or empty texts have no shingle and are classes of their own; rows that repeat a
doc_id give a row each, whose texts are joined each by itself; a null doc_id belongs to its class without naming
it, and classes of such rows only are null; an empty table gives no row; texts of any length are whole sets; documents exactly
at the bound are similar. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components, stars
from ..plans.shared import Stored, hash_partitions, release, store
from .batches import give_back, parts_of
from .shingles import least_overlap, prefix_size, set_digest, shingle_sets, sketch, sketches_allow

WIDTH, PERCENT = 5, 80
#: Keys that are ordered by their number of documents, at most (8 bytes each in every task); others count as rare.
FREQUENT = 4_000_000
#: Keys that a task collects before it sorts and sends them.
FLUSH = 800_000
#: The same for entries of lists, which take more.
ENTRIES_FLUSH = 400_000
#: Keys in the sets of one task of step 4, about.
BLOCK_KEYS = 2_000_000
#: Times that large blocks are blocked again.
DEPTH = 3
#: Keys of all documents for each key range.
RANGE_KEYS = 1_000_000
#: Bytes of texts that are shingled at once, or one text.
AT_ONCE = 3 << 20
#: Bits that tell which texts may be asked for (8 MB in every task), and the parts they are set in.
BITS, BIT_PARTS = 1 << 26, 64
#: Documents of a chain whose pairs are looked at one by one; longer chains give links.
LIST = 32
#: Marks the end of a chain's range of sizes, if the chain was longer than that.
MERGED = 1 << 31
#: Entries of short lists that are merged with a heap; numpy sorts and counts more of them faster than Python's heap merges them.
HEAP = 400


def texts_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in batches:
        column = batch.schema.get_field_index("text")
        for part in parts_of(batch, column, AT_ONCE):
            yield part, part.column(column)
    give_back()


def split_by_range(slots: np.ndarray, ranges: int) -> np.ndarray:
    """Bounds of the key ranges in ascending 32-bit slots."""
    edges = (np.arange(1, ranges, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges)
    return np.concatenate([[0], np.searchsorted(slots, edges), [len(slots)]]).astype(np.int64)


def packed_gaps(values: np.ndarray) -> bytes:
    """Ascending integers as the first one and gaps, in the narrowest of 2, 4 and 8 bytes that holds these all."""
    gaps = np.diff(values)
    for width in (2, 4, 8):
        if width == 8 or not len(gaps) or int(gaps.max()) < 1 << 8 * width:
            return bytes([width]) + values[:1].astype("<u8").tobytes() + gaps.astype(f"<u{width}").tobytes()


def unpacked_gaps(data: bytes) -> np.ndarray:
    first = np.frombuffer(data, dtype="<u8", offset=1, count=1)
    gaps = np.frombuffer(data, dtype=f"<u{data[0]}", offset=9).astype(np.uint64)
    return np.cumsum(np.concatenate([first, gaps]), dtype=np.uint64)


MEASURED = "doc_id long, n_shingles long, set long, check long, at long, sketch binary, range int, slots binary, many binary, counts binary"


def measure(docs: DataFrame, ranges: int, width: int) -> DataFrame:
    """In one pass over the texts (doc_id, text, at), rows of two kinds.

    doc_id, n_shingles, set, check and sketch (null without shingles) and at of every row; and, with a range, for each key range and
    task the slots (upper 32 bits of keys) met, and the counts of those met more than once.
    """
    names = [f.strip().split(" ")[0] for f in MEASURED.split(",")]
    kinds = dict(zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary())))

    def batch_of(**columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[n], k) if n in columns else pa.nulls(size, k) for n, k in kinds.items()], names=names)

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        slots, counts = np.unique(np.concatenate(held), return_counts=True)
        bounds = split_by_range(slots, ranges)
        rows = []
        for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if b > a:
                many = np.flatnonzero(counts[a:b] > 1)
                rows.append((n, packed_gaps(slots[a:b]), many.astype("<u4").tobytes(), counts[a:b][many].astype("<u4").tobytes()))
        yield batch_of(**dict(zip(("range", "slots", "many", "counts"), zip(*rows))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part, texts in texts_of(batches):
            keys, sizes = shingle_sets(texts, width)
            ends = np.cumsum(sizes).tolist()
            own = [keys[b - n : b] for b, n in zip(ends, sizes.tolist())]
            ids = [set_digest(k) if len(k) else (None, None) for k in own]
            yield batch_of(doc_id=part.column("doc_id"), n_shingles=sizes, set=[i for i, _ in ids], check=[c for _, c in ids], at=part.column("at"), sketch=[sketch(k) if len(k) else None for k in own])
            held.append(keys >> np.uint64(32))
            size += len(keys)
            if size >= FLUSH:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    return docs.select("doc_id", "text", "at").mapInArrow(run, MEASURED)


def ranges_of(keys: int) -> int:
    return max(1, -(-keys // RANGE_KEYS))


def groups_of(batches: Iterable[pd.DataFrame], *by: str) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of consecutive rows, of rows sorted by the columns ``by``."""
    held, at = [], None
    for batch in batches:
        if not len(batch):
            continue
        change = (batch[list(by)] != batch[list(by)].shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(change)
        for a, b in zip(starts, [*starts[1:], len(batch)]):
            part = batch.iloc[a:b]
            key = tuple(part[c].iloc[0] for c in by)
            if key != at and held:
                yield at, pd.concat(held)
                held = []
            at = key
            held.append(part)
    if held:
        yield at, pd.concat(held)


def frequent_keys(measured: DataFrame, ranges: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """From what ``measure`` gives, slots in most documents, ascending, and their numbers of documents: at most ``most``, all above one count."""
    most = FREQUENT if most is None else most

    def add_up(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (n,), rows in groups_of(batches, "range"):
            slots, counts = [], []
            for packed, many, more in zip(rows["slots"], rows["many"], rows["counts"]):
                own = unpacked_gaps(packed)
                number = np.ones(len(own), dtype=np.int64)
                number[np.frombuffer(many, dtype="<u4")] = np.frombuffer(more, dtype="<u4")
                slots.append(own)
                counts.append(number)
            slots, counts = np.concatenate(slots), np.concatenate(counts)
            order = np.argsort(slots, kind="stable")
            slots, counts = slots[order], counts[order]
            starts = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
            slots, counts = slots[starts], np.add.reduceat(counts, starts)
            keep = counts > 2
            yield pd.DataFrame({"range": [n], "slots": [slots[keep].astype("<u4").tobytes()], "counts": [np.minimum(counts[keep], 2**32 - 1).astype("<u4").tobytes()]})

    def levels(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for counts in batch["counts"]:
                level, n = np.unique(np.frombuffer(counts, dtype="<u4"), return_counts=True)
                yield pd.DataFrame({"level": level.astype(np.int64), "n": n})

    counted = Stored(
        measured.filter("range IS NOT NULL").select("range", "slots", "many", "counts").repartition(ranges, "range").sortWithinPartitions("range").mapInPandas(add_up, "range int, slots binary, counts binary"), "key-counts"
    )
    # the number of keys at each power of a fine step of the count decides which counts are kept
    step = F.floor(F.log("level") * 16)
    table = sorted(((r.step, r.n) for r in counted.df.mapInPandas(levels, "level long, n long").groupBy(step.alias("step")).agg(F.sum("n").alias("n")).collect()), reverse=True)
    kept, least = 0, None
    for level, n in table:
        if kept + n > most:
            break
        kept, least = kept + n, level
    if least is None:
        counted.drop()
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint32)

    def above(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for slots, counts in zip(batch["slots"], batch["counts"]):
                counts = np.frombuffer(counts, dtype="<u4")
                keep = np.floor(np.log(counts) * 16) >= least
                yield pd.DataFrame({"slots": [np.frombuffer(slots, dtype="<u4")[keep].tobytes()], "counts": [counts[keep].tobytes()]})

    rows = counted.df.mapInPandas(above, "slots binary, counts binary").collect()
    counted.drop()
    slots = np.frombuffer(b"".join(r.slots for r in rows), dtype="<u4")
    counts = np.frombuffer(b"".join(r.counts for r in rows), dtype="<u4")
    order = np.argsort(slots)
    return slots[order], counts[order]


def merge_lists(key: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Chains of compatible sizes in each key's list. Those of up to LIST entries stay; longer ones, and those that hold one that was merged, become one entry with its smallest document, range of sizes and the mark MERGED, and links of the others to it.

    Also begins and lengths of the chains that stay, in the entries as they were sorted (key, doc, low), for ``pairs_of``.
    """
    order = np.lexsort((doc, high, low, key))
    columns = [c[order] for c in (key, doc, low, high)]
    other = np.ones(len(order), dtype=bool)
    other[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    key, doc, low, high = (c[other] for c in columns)
    merged, high = high >= MERGED, high & (MERGED - 1)
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    base = np.cumsum(first) << 40
    reach = np.maximum.accumulate(high + base)
    starts = first.copy()
    starts[1:] |= 100 * (reach[:-1] - base[1:]) < percent * low[1:]
    run, at = np.cumsum(starts) - 1, np.flatnonzero(starts)
    length = np.diff(np.append(at, len(key)))
    long = (length > LIST) | np.logical_or.reduceat(merged, at)
    least, most = np.minimum.reduceat(doc, at), np.maximum.reduceat(high, at) + MERGED
    linked = long[run] & (doc != least[run])
    src, dst = distinct_pairs(doc[linked], least[run[linked]])
    stay = ~long[run]
    stay[at[long]] = True
    entries = (key[stay], np.where(long[run], least[run], doc)[stay], low[stay], np.where(long[run], most[run], high)[stay])
    return entries, src, dst, (doc, low, at[~long], length[~long])


def distinct_pairs(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((dst, src))
    src, dst = src[order], dst[order]
    new = np.ones(len(src), dtype=bool)
    new[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
    return src[new], dst[new]


def pairs_of(chains: tuple[np.ndarray, ...], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (larger, smaller document) of compatible sizes in each chain that stayed."""
    doc, size, at, length = chains
    found = [(np.zeros(0, dtype=np.int64),) * 2]
    for n in np.unique(length[length > 1]).tolist():
        i, j = np.triu_indices(n, 1)
        begins = at[length == n]
        for few in np.array_split(begins, max(1, len(begins) * len(i) >> 18)):
            a, b = (few[:, None] + i).ravel(), (few[:, None] + j).ravel()
            # sizes ascend in a chain
            may = (100 * size[a] >= percent * size[b]) & (doc[a] != doc[b])
            a, b = doc[a[may]], doc[b[may]]
            found.append(distinct_pairs(np.maximum(a, b), np.minimum(a, b)))
    return distinct_pairs(*(np.concatenate(side) for side in zip(*found)))


ENTRIES = "range int, keys binary, docs binary, low binary, high binary"


def entry_rows(entries: tuple[np.ndarray, ...], links: tuple[np.ndarray, np.ndarray], ranges: int | None) -> Iterator[pa.RecordBatch]:
    """Lists by key range, if ranges are given, and links as a row of range -1."""
    rows = []
    if ranges:
        key, doc, low, high = entries
        bounds = split_by_range(key >> np.uint64(16), ranges)
        rows.extend(
            (n, packed_gaps(key[a:b]), doc[a:b].astype("<i8").tobytes(), low[a:b].astype("<u4").tobytes(), b"" if (high[a:b] == low[a:b]).all() else high[a:b].astype("<u4").tobytes())
            for n, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a
        )
    if len(links[0]):
        rows.append((-1, b"", np.stack(links, axis=1).astype("<i8").tobytes(), b"", b""))
    if rows:
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["range", "keys", "docs", "low", "high"])


def prefix_entries(docs: DataFrame, frequent, ranges: int, width: int, percent: int) -> DataFrame:
    """Step 2, in the task: lists of the prefix keys by key range, and links within the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, counts = frequent.value
        held, size = [], 0
        for _, texts in texts_of(batches):
            keys, sizes = shingle_sets(texts, width)
            ends = np.cumsum(sizes)
            number = np.zeros(len(keys), dtype=np.int64)
            if len(slots):
                own_slots = (keys >> np.uint64(32)).astype(np.uint32)
                at = np.minimum(np.searchsorted(slots, own_slots), len(slots) - 1)
                number = np.where(slots[at] == own_slots, counts[at], 0)
            for a, n in zip((ends - sizes).tolist(), sizes.tolist()):
                if n:
                    own = keys[a : a + n]
                    short = own[: (p := prefix_size(n, percent))]
                    if number[a : a + n].any():
                        short = own[np.argsort(number[a : a + n], kind="stable")[:p]]
                    held.append((short >> np.uint64(16), set_digest(own)[0], n))
                    size += p
            if size >= ENTRIES_FLUSH:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        lengths = [len(k) for k, _, _ in held]
        key = np.concatenate([k for k, _, _ in held])
        doc = np.repeat(np.array([d for _, d, _ in held], dtype=np.int64), lengths)
        size = np.repeat(np.array([n for _, _, n in held], dtype=np.int64), lengths)
        entries, *links, _ = merge_lists(key, doc, size, size, percent)
        yield from entry_rows(entries, links, ranges)

    return docs.select("text").mapInArrow(run, ENTRIES)


def block_links(entries: DataFrame, ranges: int, percent: int) -> DataFrame:
    """Step 2, by key range: src, dst and sure: links between the documents of each long chain, and pairs of the others, which are not sure."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (n,), rows in groups_of(batches, "range"):
            if n < 0:
                for links in rows["docs"]:
                    yield pd.DataFrame(np.frombuffer(links, dtype="<i8").reshape(-1, 2), columns=["src", "dst"]).assign(sure=True)
                continue
            key = np.concatenate([unpacked_gaps(k) for k in rows["keys"]])
            doc = np.frombuffer(b"".join(rows["docs"]), dtype="<i8")
            low = np.frombuffer(b"".join(rows["low"]), dtype="<u4").astype(np.int64)
            high = np.frombuffer(b"".join(h or l for h, l in zip(rows["high"], rows["low"])), dtype="<u4").astype(np.int64)
            _, src, dst, chains = merge_lists(key, doc, low, high, percent)
            yield pd.DataFrame({"src": src, "dst": dst, "sure": True})
            src, dst = pairs_of(chains, percent)
            for a in range(0, len(src), 100_000):
                yield pd.DataFrame({"src": src[a : a + 100_000], "dst": dst[a : a + 100_000], "sure": False})

    # links within tasks are dealt out evenly, by a number that is no key range
    dealt = entries.withColumn("to", F.when(F.col("range") >= 0, F.col("range")).otherwise(F.pmod(F.xxhash64("docs"), F.lit(ranges)).cast("int")))
    return dealt.repartition(ranges, "to").drop("to").sortWithinPartitions("range").mapInPandas(run, "src long, dst long, sure boolean")


def checked(links: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Step 2, what is left of the links: those that are sure, and pairs that may be similar by their sketches, as stars; sketches: set, n, sketch, of which one name may have several."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            may = batch["sure"].to_numpy(dtype=bool, copy=True)
            asked = np.flatnonzero(~may)
            some = batch.iloc[asked]
            may[asked] = sketches_allow(some["a"].tolist(), some["b"].tolist(), some["n"].to_numpy(), some["m"].to_numpy(), percent)
            src, dst = stars(batch["src"].to_numpy()[may], batch["dst"].to_numpy()[may])
            yield pd.DataFrame({"src": src, "dst": dst})

    # dealt by one end, equal pairs lie together as well; sure links ask for no sketch, and are not dealt to hubs
    pairs = hash_partitions(links, "src").distinct()
    a = sketches.select(F.col("set").alias("src"), "n", F.col("sketch").alias("a"))
    b = sketches.select(F.col("set").alias("of"), F.col("n").alias("m"), F.col("sketch").alias("b"))
    left = pairs.join(a.hint("shuffle_hash"), "src").withColumns({"of": F.when(F.col("sure"), F.xxhash64("src", "dst")).otherwise(F.col("dst")), "a": F.when(~F.col("sure"), F.col("a"))})
    both = left.join(b.hint("shuffle_hash"), "of", "left")
    return both.select("src", "dst", "sure", "n", "m", "a", "b").mapInPandas(run, "src long, dst long")


def merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The documents of ascending lists, and in how many lists each is: merged with a heap, or, if they are long together, counted after a sort."""
    if sum(map(len, lists)) > HEAP:
        return np.unique(np.concatenate(lists), return_counts=True)
    found, count = [], []
    for doc in heapq.merge(*(own.tolist() for own in lists)):
        if found and found[-1] == doc:
            count[-1] += 1
        else:
            found.append(doc)
            count.append(1)
    return np.array(found, dtype=np.int64), np.array(count, dtype=np.int64)


class Block:
    """Sets of documents with their inverted lists, for T-occurrence search."""

    def __init__(self, sets: list[np.ndarray], percent: int, classes: np.ndarray | None = None):
        self.percent, self.sizes = percent, np.array([len(s) for s in sets], dtype=np.int64)
        keys = np.concatenate(sets)
        _, key = np.unique(keys, return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.key = key.astype(np.int64)
        doc = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((doc, key))
        self.lists = doc[order]
        self.lengths = np.bincount(key)
        self.ends = np.cumsum(self.lengths)
        #: (document, key) in ascending order, for binary probes.
        self.width = int(key.max()) + 1
        self.pairs = np.sort(doc * self.width + key)
        #: The class of each document, and the documents of each class.
        self.root = np.arange(len(sets)) if classes is None else np.unique(classes, return_inverse=True)[1]
        by_class = np.argsort(self.root, kind="stable")
        self.members = dict(enumerate(part.tolist() for part in np.split(by_class, np.flatnonzero(np.diff(self.root[by_class])) + 1)))

    def similar(self, n: int, others: np.ndarray | None = None) -> Iterator[int]:
        """Documents similar to document n, until n is linked to their class; others: only look among these."""
        size, percent = int(self.sizes[n]), self.percent
        keys = self.key[self.starts[n] : self.starts[n + 1]]
        keys = keys[np.argsort(self.lengths[keys], kind="stable")]
        short, long = keys[: prefix_size(size, percent)], keys[prefix_size(size, percent) :]
        short = short[self.lengths[short] > 1]
        if not len(short):
            return
        found, count = merged([self.lists[self.ends[k] - self.lengths[k] : self.ends[k]] for k in short.tolist()])
        need = least_overlap(size, self.sizes[found], percent)
        may = (count + len(long) >= need) & (100 * np.minimum(size, self.sizes[found]) >= percent * np.maximum(size, self.sizes[found]))
        may &= self.root[found] != self.root[n]
        if others is not None:
            may &= others[found]
        found, count, need = found[may], count[may], need[may]
        order = np.argsort(need - count, kind="stable")
        found, count, need = found[order], count[order], need[order]
        step = 4
        while len(found):
            part, found = found[:step], found[step:]
            probes = part[:, None] * self.width + long[None, :]
            at = np.minimum(np.searchsorted(self.pairs, probes), len(self.pairs) - 1)
            total = count[:step] + (self.pairs[at] == probes).sum(axis=1)
            hits = part[total >= need[:step]]
            count, need = count[step:], need[step:]
            for hit in hits.tolist():
                if self.root[hit] != self.root[n]:
                    yield hit
            keep = self.root[found] != self.root[n]
            found, count, need = found[keep], count[keep], need[keep]
            step = min(256, step * 2)

    def join(self, a: int, b: int) -> None:
        """The smaller class takes the name of the larger one."""
        few, many = sorted((int(self.root[a]), int(self.root[b])), key=lambda r: len(self.members[r]))
        moved = self.members.pop(few)
        self.root[moved] = many
        self.members[many].extend(moved)


def block_classes(docs: list[int], sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, classes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the similar documents of a block into classes; side: only pairs of different sides; classes: those known already."""
    block, links = Block(sets, percent, classes), []
    for n in range(len(docs)):
        for other in block.similar(n, None if side is None else side != side[n]):
            links.append((docs[n], docs[other]))
            block.join(n, other)
    return links


def search_tiles(sets: DataFrame, percent: int, partitions: int) -> DataFrame:
    """Step 4: links (src, dst) between similar documents; sets: block, a, b (slices; a = b: one slice), slice, doc, keys, class (null: itself)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for (_, a, b), rows in groups_of(batches, "block", "a", "b"):
            rows = rows.drop_duplicates("doc")
            if len(rows) > 1:
                side = None if a == b else rows["slice"].to_numpy()
                known = rows["class"].notna().to_numpy()
                classes = rows["doc"].to_numpy().copy()
                classes[known] = rows["class"][known].astype("int64")
                out.extend(block_classes(rows["doc"].tolist(), [np.frombuffer(k, dtype="<u8") for k in rows["keys"]], percent, side, classes))
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["src", "dst"])
                out = []
        yield pd.DataFrame(out, columns=["src", "dst"]).astype("int64")

    rows = sets.select("block", "a", "b", "slice", "doc", "keys", F.col("class").cast("string").alias("class"))
    return rows.repartition(partitions, "block", "a", "b").sortWithinPartitions("block", "a", "b").mapInPandas(run, "src long, dst long")


def sliced(sets: DataFrame, salt: int) -> DataFrame:
    """With the slice of each document of a block, and s, the number of slices (1 if the block is small)."""
    sizes = sets.groupBy("block").agg(F.sum(F.octet_length("keys") / 8).alias("keys"))
    slices = sizes.select("block", F.when(F.col("keys") <= BLOCK_KEYS, 1).otherwise(F.ceil(2 * F.col("keys") / BLOCK_KEYS)).cast("long").alias("s"))
    return sets.join(slices, "block").withColumn("slice", F.pmod(F.xxhash64("doc", F.lit(salt)), F.col("s")))


def search_large(sets: DataFrame, percent: int, partitions: int) -> DataFrame:
    """Links of blocks too large for one task; sets: block, doc, keys.

    Documents of a slice are joined first, then one of each class in slices dealt anew, until classes no longer become
    fewer: each round sends a set once. Blocks that are one class by then are done. In the others each pair of
    slices is compared, leaving out documents of one class, so nothing rests on the rounds but the work that is left.
    """
    now, before, found = sets, sets.count(), None
    for salt in range(DEPTH):
        alone = sliced(now, salt).select("block", F.col("slice").alias("a"), F.col("slice").alias("b"), "slice", "doc", "keys", F.lit(None).alias("class"))
        links = Stored(search_tiles(alone, percent, partitions), "links").df
        found = links if found is None else found.union(links)
        labels = Stored(connected_components(found, reduced=True), "labels").df
        classes = sets.join(labels, F.col("doc") == F.col("vertex"), "left").select("block", "doc", "keys", F.coalesce("component", "doc").alias("class"))
        now = classes.filter("doc = class").drop("class")
        left = now.count()
        if left > 0.7 * before:
            break
        before = left
    several = classes.groupBy("block").agg(F.min("class").alias("least"), F.max("class").alias("most")).filter("least <> most").select("block")
    rest = sliced(classes.join(several, "block", "left_semi"), DEPTH)
    # each pair of slices meets once: a set goes to its own slice and to every pair with another
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1))
    tiles = rest.withColumn("other", other).withColumns({"a": F.least("slice", "other"), "b": F.greatest("slice", "other")})
    return found.union(search_tiles(tiles, percent, partitions))


def address() -> Column:
    """A hash of doc_id and text, by which texts are found again; rows that share one by chance are told apart by their sets."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text").alias("at")


def may_hold(spark: SparkSession, places: DataFrame) -> Column:
    """Whether ``at`` may be one of places: true for all that are, and for the more others the more places there are."""
    part = BITS // BIT_PARTS

    def mark(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (n,), rows in groups_of(batches, "part"):
            bits = np.zeros(part, dtype=bool)
            bits[rows["slot"].to_numpy() - n * part] = True
            yield pd.DataFrame({"part": [n], "bits": [np.packbits(bits).tobytes()]})

    slots = places.select(F.pmod("at", F.lit(BITS)).alias("slot")).distinct().withColumn("part", F.floor(F.col("slot") / part))
    found = {r.part: r.bits for r in slots.repartition(BIT_PARTS, "part").sortWithinPartitions("part").mapInPandas(mark, "part long, bits binary").collect()}
    table = spark.sparkContext.broadcast(b"".join(found.get(n, bytes(part // 8)) for n in range(BIT_PARTS)))

    def may(at: pd.Series) -> pd.Series:
        slot = at.to_numpy() % BITS
        return pd.Series((np.frombuffer(table.value, dtype=np.uint8)[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1)

    return F.pandas_udf(may, "boolean")("at")


def holding(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of docs whose ``at`` may be one of places; others are left out before a join deals texts out. More places than bits let rows pass in vain, but none is lost."""
    return docs.filter(may_hold(docs.sparkSession, places))


def whole_sets(docs: DataFrame, width: int) -> DataFrame:
    """The columns of docs other than text, the keys of the text and the set that they make (null: none), with its check."""
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in others), "keys binary", "set long", "check long"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_of(batches):
            keys, sizes = shingle_sets(texts, width)
            ends = np.cumsum(sizes).tolist()
            own = [keys[b - n : b] for b, n in zip(ends, sizes.tolist())]
            ids = [set_digest(k) if len(k) else (None, None) for k in own]
            made = [pa.array([k.tobytes() for k in own], pa.binary()), *(pa.array(column, pa.int64()) for column in zip(*ids))]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in others), *made], names=[*(f.name for f in others), "keys", "set", "check"])

    return docs.mapInArrow(run, schema)


def block_members(docs: DataFrame, measured: Stored, counted: int, keys: int, stands: DataFrame, sketches: DataFrame, width: int, percent: int, depth: int = DEPTH) -> DataFrame:
    """Steps 1 to 3: at, doc, set, check, block and n of the documents in blocks of two or more; docs: doc_id, at, text; measured: with counts in ``counted`` ranges, dropped when they are added up; keys: of all docs; sketches: set, n and sketch of all sets.

    Where more keys are shared than the table of frequent ones holds, chance links make blocks large. These are
    blocked again by themselves, in an order by the counts within them, until that no longer helps.
    """
    spark = docs.sparkSession
    ranges = ranges_of(keys)
    frequent = spark.sparkContext.broadcast(frequent_keys(measured.df, counted))
    measured.drop()
    release(spark)
    links = checked(block_links(prefix_entries(docs, frequent, ranges, width, percent), ranges, percent), sketches, percent)
    blocks = Stored(connected_components(links, reduced=True), "blocks").df
    frequent.unpersist()
    del links
    release(spark)
    members = store(blocks.join(stands, F.col("vertex") == F.col("set")).select("at", "doc", "set", "check", F.col("component").alias("block"), "n"), "members")
    large = members.groupBy("block").agg(F.sum("n").alias("keys")).filter(F.col("keys") > BLOCK_KEYS)
    held = large.agg(F.sum("keys")).first()[0] or 0
    if not depth or not held or held > 0.7 * keys:
        return members
    again = members.join(large.select("block"), "block", "left_semi").select("at").distinct()
    texts = Stored(holding(docs, again).join(again.hint("shuffle_hash"), "at", "left_semi"), "large-blocks")
    release(spark)
    finer = block_members(texts.df, Stored(measure(texts.df, ranges_of(held), width), "sets"), ranges_of(held), held, stands, sketches, width, percent, depth - 1)
    texts.drop()
    # a text that stands elsewhere may come along with the same address; it keeps its own block
    kept = members.join(large.select("block"), "block", "left_anti").select("at", "doc", "set", "check", "block", "n")
    return kept.union(finer.join(kept.select("doc"), "doc", "left_anti").select(*kept.columns))


def jaccard_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id of the class) of every row of docs (doc_id, text)."""
    sets, named = set_classes(docs, width, percent)
    least = named.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    by_set = named.join(least, "class").select("set", "check", "component_id")
    return sets.join(by_set, ["set", "check"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def set_classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles, set, check and at of every row, and set, check, class, doc_id and at of the row that stands for each set."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), address(), "text")
    # the number of ranges has to be known before the keys are: a word takes six bytes, about
    counted = ranges_of((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6)
    measured = Stored(measure(texts, counted, width), "sets")
    # the counts are most of what was measured, and go before the texts are dealt out
    sets = store(measured.df.filter("range IS NULL").select("doc_id", "n_shingles", "set", "check", "at"), "names")
    sketches = Stored(measured.df.filter("set IS NOT NULL").select("set", "check", F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["set", "check"]).drop("check"), "sketches")
    # one document stands for each set, one with a doc_id if there is any; partial minima are taken before the shuffle
    stands = sets.filter("set IS NOT NULL").groupBy("set", "check").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "at")).alias("one"), F.max("n_shingles").alias("n"))
    # doc is a number of its own: two sets of one name may come to one block, but they are never one document
    stands = store(stands.select("set", "check", "one.doc_id", "one.at", "n", F.monotonically_increasing_id().alias("doc")), "stands")
    members = block_members(texts, measured, counted, sets.agg(F.sum("n_shingles")).first()[0] or 0, stands, sketches.df, width, percent)
    sketches.drop()
    release(spark)
    large = store(members.groupBy("block").agg(F.sum("n").alias("keys")).filter(F.col("keys") > BLOCK_KEYS).select("block"), "large")

    def sets_of(some: DataFrame) -> DataFrame:
        # the places are the hashed side at any size, so the texts are not sorted
        places = some.select("at", "doc", "block", F.col("set").alias("of_set"), F.col("check").alias("of_check"))
        text = holding(texts, places).drop("doc_id").join(places.hint("shuffle_hash"), "at").drop("at")
        return whole_sets(text, width).filter("set = of_set AND check = of_check").select("block", "doc", "keys")

    partitions, zero = int(spark.conf.get("spark.sql.shuffle.partitions")), F.lit(0).cast("long")
    several = not large.isEmpty()
    small = members.join(large, "block", "left_anti") if several else members
    keyed = sets_of(small).select("block", zero.alias("a"), zero.alias("b"), zero.alias("slice"), "doc", "keys", F.lit(None).alias("class"))
    links = search_tiles(keyed, percent, partitions)
    if several:
        links = links.union(search_large(store(sets_of(members.join(large, "block", "left_semi")), "large-sets"), percent, partitions))
    classes = connected_components(links, reduced=True)
    del keyed, links
    release(spark)

    return sets, stands.join(classes, F.col("doc") == F.col("vertex"), "left").select("set", "check", F.coalesce("component", "doc").alias("class"), "doc_id", "at")


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each class, one with its smallest doc_id, with all columns of docs; a doc_id on several classes stays on each.

    Rows without a word resemble nothing, so they all stay.
    """
    sets, named = set_classes(docs, width, percent)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "set", "check", "at")).alias("one")
    kept = store(named.groupBy("class").agg(one).select("class", F.col("one.doc_id").alias("id"), "one.at"), "kept")
    # only rows that go, and those that share a place, are dealt out: of the others each is the one that its class keeps
    places = sets.filter("set IS NOT NULL").groupBy("at").agg(F.count("*").alias("n")).join(kept.select("at", "id"), "at", "left").filter("n > 1 OR id IS NULL").select("at")
    release(docs.sparkSession)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), address())
    worded = F.coalesce(F.col("row.text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    told = rows.withColumn("dealt", worded & may_hold(docs.sparkSession, places))

    with_words = told.filter("dealt").join(kept.hint("shuffle_hash"), "at").filter(F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")))
    # rows that share doc_id and text (a hash of these, in rare cases) are left here, and already lie together
    one = with_words.withColumn("n", F.row_number().over(Window.partitionBy("at", "class").orderBy("row.text"))).filter("n = 1")
    return one.select("row.*").union(told.filter("NOT dealt").select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.r = links.x)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c ON s.doc_id = c.doc_id
"""
