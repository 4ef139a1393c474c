"""Token counts at every prefix of a text, by dynamic programming over prefixes.

Of a piece of the pre-tokenizer, let open(k) be the encoding of its first k bytes when the word goes on
behind them, and closed(k) when it ends there. A leading part of an encoding is the encoding of the bytes
it stands for, so the last token of open(k) or closed(k) begins at some j < k, and what stands before it
is open(j): the counts are those at j plus one. The right last token is the one that is compatible with
the last token of open(j): no merge across the border would come before those that make the two. So
each prefix costs a few look-ups, and closed(k) is the exact count of the piece cut off after k bytes.

Blanks and line feeds are certain cuts, so counts of a text are those of its fragments, added up. A
text's array of counts answers how many tokens any prefix has, and where to cut for a budget, without
encoding again.

Contractions, special tokens and clusters of composed characters are one only as a whole: cuts within one
are counted from the states before it, so the work stays in proportion to the text, whatever its length and script.

Defined cases: a null text has the counts of an empty one (0 bytes, 0 tokens); rows that repeat stay
repeated; an empty table gives no row; a text of any length is counted whole. Other columns are not read, so their
names cannot clash.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .batches import joined
from .bpe import TOKENIZER, map_rows
from .fragments import END, TABLE_BYTES, FragmentEncoder, IdTable, gathered, without_file

LIMIT = 2048
#: Pairs of tokens whose compatibility one Python process keeps.
PAIRS = 400_000
#: Clusters of characters whose normal forms it keeps.
CLUSTERS = 100_000
#: Characters of a piece that are counted anew for a cut within a cluster; longer ones go on from the piece's states.
SHORT = 32


@lru_cache(maxsize=1)
def composing() -> frozenset[str]:
    """Characters that can be the second of a composed one, and the vowels and finals of Hangul."""
    pairs = (unicodedata.decomposition(chr(n)).split() for n in range(0xC0, 0x2FFFF))
    return frozenset(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<") | frozenset(map(chr, range(0x1160, 0x1200)))


def joins(character: str) -> bool:
    """Whether a normal form may reach over the border before the character."""
    return character > "\u02ff" and (unicodedata.combining(character) > 0 or character in composing())


class PrefixCounter(FragmentEncoder):
    def __init__(self, path: str):
        super().__init__(path)
        model = self.spec["model"]
        vocabulary, suffix = model["vocab"], self.suffix
        if not suffix:
            raise ValueError("a vocabulary with an end of word is needed")
        self.halves: dict[int, tuple[int, int, int]] = {}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole, left, right = vocabulary[a + b], vocabulary[a], vocabulary[b]
            self.merged.setdefault((left, right), (rank, whole))
            self.halves.setdefault(whole, (rank, left, right))
        #: By text: the token for it inside a word and the one at the end of a word (-1: none that is its own encoding), for all beginnings of tokens.
        self.nodes: dict[str, tuple[int, int]] = {}
        for token, i in vocabulary.items():
            ends = token.endswith(suffix) and token != suffix
            plain = token.removesuffix(suffix) if ends else token
            for n in range(1, len(plain)):
                self.nodes.setdefault(plain[:n], (-1, -1))
            if [t.id for t in (self.closed if ends else self.open).tokenize(plain)] == [i]:
                inside, at_end = self.nodes.get(plain, (-1, -1))
                self.nodes[plain] = (inside, i) if ends else (i, at_end)
        self.longest = max(map(len, self.nodes))
        self.pairs: dict[int, bool] = {}
        self.normals: dict[str, str] = {}
        #: Prefix counts of fragments and of pieces.
        self.rows, self.prefixes = IdTable(self.encode_rows, 2 * TABLE_BYTES), IdTable(self.encode_prefixes, 2 * TABLE_BYTES)

    def edges(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at the token's left (1) or right (2) border while it is built, with the rank at which that is merged away."""
        out, gone = [], float("inf")
        while True:
            out.append((token, gone))
            if token not in self.halves:
                return out
            gone, token = self.halves[token][0], self.halves[token][side]

    def compatible(self, before: int, after: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens."""
        known = self.pairs.get(key := before << 32 | after)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = not any(
                (found := self.merged.get((x, y))) is not None
                # among equal merges the one further left comes first
                and found[0] < x_gone and found[0] <= y_gone and found[0] > self.formed(x) and found[0] > self.formed(y)
                for x, x_gone in self.edges(before, 2)
                for y, y_gone in self.edges(after, 1)
            )
        return known

    def formed(self, token: int) -> int:
        return self.halves[token][0] if token in self.halves else -1

    def counts(self, piece: str) -> list[int]:
        """Counts of a normalised piece cut off behind each of its characters."""
        if piece[0] == "'" and piece[-1].isalpha():  # a contraction is one piece only as a whole
            return [*(sum(map(self.total, self.pattern.findall(piece[:n]))) for n in range(1, len(piece))), self.states(piece)[2][-1]]
        if piece.isascii() and piece.isprintable():
            return self.states(piece)[2][1:]
        out = self.states(self.mapped(piece))[2]
        return [out[end] for end in accumulate(len(c.encode()) for c in piece)]

    def total(self, piece: str) -> int:
        return self.counts(piece)[-1]

    def encode_prefixes(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes, counts and order of pieces without a zero byte; the empty one has the count 0."""
        sizes, counts = [], []
        for piece in joined(pieces, END).split(END):
            own = self.counts(piece) if piece else [0]
            sizes.append(len(own))
            counts += own
        return np.array(sizes, dtype=np.int64), np.array(counts, dtype="<u4"), np.arange(len(pieces))

    def encode_rows(self, fragments: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes, counts and order of fragments: of each cut off behind each of its characters, and behind the white space that follows."""
        simple = pc.and_not(pc.match_substring_regex(fragments, self.SIMPLE), pc.match_substring(fragments, "<|")).to_numpy(zero_copy_only=False)
        first, others = np.flatnonzero(simple), np.flatnonzero(~simple)
        marked = pc.replace_substring_regex(pc.utf8_lower(fragments.take(pa.array(first))), self.SIMPLE_PATTERN, "\\0" + END)
        lists = pc.split_pattern(marked, END)
        coded, bounds = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()
        at, (starts, sizes, counts) = coded.indices.to_numpy(), self.prefixes.look_up(coded.dictionary)
        starts, sizes = starts[at], sizes[at]
        # a fragment's pieces go on from the counts of those before; the nothing behind the last mark gives the whole count again
        ends = np.concatenate([[0], np.cumsum(counts[starts + sizes - 1], dtype=np.int64)])
        before = ends[:-1] - np.repeat(ends[bounds[:-1]], np.diff(bounds))
        rows = gathered(counts, starts, sizes) + np.repeat(before, sizes)
        own = [self.fragment_row(f) for f in fragments.take(pa.array(others)).to_pylist()]
        places = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        return (
            np.concatenate([np.diff(places), np.fromiter(map(len, own), dtype=np.int64, count=len(own))]),
            np.concatenate([rows.astype("<u4"), np.array([n for row in own for n in row], dtype="<u4")]),
            np.concatenate([first, others]),
        )

    def states(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Of a piece in the vocabulary's alphabet, at each of its places: the last token and the count of open, the count of closed."""
        size, nodes, known, compatible = len(text), self.nodes, self.pairs.get, self.compatible
        last, count, out = [-1] * (size + 1), [0] * (size + 1), [0] * (size + 1)
        for j in range(size):
            before, here = last[j] << 32, count[j] + 1
            for k in range(j + 1, size + 1):
                node = nodes.get(text[j:k])
                if node is None:
                    break
                inside, at_end = node
                if inside >= 0 and last[k] < 0:
                    if not j or (ok := known(before | inside)) or ok is None and compatible(last[j], inside):
                        last[k], count[k] = inside, here
                if at_end >= 0 and not out[k]:
                    if not j or (ok := known(before | at_end)) or ok is None and compatible(last[j], at_end):
                        out[k] = here
        return last, count, out

    def closed_behind(self, text: str, last: list[int], count: list[int], at: int, more: str) -> int:
        """The count of closed for the first ``at`` places of a piece with these states and ``more`` behind them."""
        start, end = max(0, at - self.longest), at + len(more)
        window, last, count = text[start:at] + more, last[start : at + 1] + [-1] * len(more), count[start : at + 1] + [0] * len(more)
        size, at = end - start, at - start
        for j in range(size):
            for k in range(j + 1, size + 1):
                node = self.nodes.get(window[j:k])
                if node is None:
                    break
                if k > at and node[0] >= 0 and last[k] < 0 and (not j + start or self.compatible(last[j], node[0])):
                    last[k], count[k] = node[0], count[j] + 1
                if k == size and node[1] >= 0 and (not j + start or self.compatible(last[j], node[1])):
                    return count[j] + 1
        return 0

    def fragment_row(self, fragment: str) -> list[int]:
        """Counts of a fragment cut off behind each of its characters, and behind the white space that follows."""
        if not fragment:
            return [0]
        row = self.special_row(fragment) if self.has_special(fragment) else self.composed_row(fragment)
        return [*row, row[-1]]

    def special_row(self, fragment: str) -> list[int]:
        """Special tokens cut the text before all else; cut off itself, one is plain text."""
        row, before, at = [], 0, 0
        while found := [(n, s) for s in self.special if (n := fragment.find(s, at)) >= 0]:
            start, token = min(found)
            own = self.fragment_row(fragment[at : start + len(token) - 1])
            row.extend(before + n for n in own[:-1])
            before += (own[start - at - 1] if start > at else 0) + 1
            row.append(before)
            at = start + len(token)
        return row + [before + n for n in self.fragment_row(fragment[at:])[:-1]]

    def composed_row(self, fragment: str) -> list[int]:
        """For any characters: no normal form reaches over the borders of clusters, so each is normalised by itself, and only cuts within one are looked at one by one."""
        starts = [n for n, c in enumerate(fragment) if not n or not joins(c)]
        clusters = list(zip(starts, [*starts[1:], len(fragment)]))
        parts = [self.normal(fragment[a:b]) for a, b in clusters]
        normal = "".join(parts)
        if re.sub(" +", " ", normal) != self.tokenizer.normalizer.normalize_str(fragment):
            # the library knows other clusters
            return [len(self.library_ids(fragment[:n])) for n in range(1, len(fragment) + 1)]
        spans = [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        counts, at = [0], 0
        for a, b in spans:
            counts.extend(counts[-1] for _ in range(a - at))
            before = counts[-1]
            counts.extend(before + n for n in self.counts(normal[a:b]))
            at = b
        counts.extend(counts[-1] for _ in range(len(normal) - at))
        row, end, piece, held = [], 0, 0, None
        for (a, b), part in zip(clusters, parts):
            start, end = end, end + len(part)
            if b - a > 1:
                while piece < len(spans) and spans[piece][1] < start:
                    piece, held = piece + 1, None
                begin = spans[piece][0] if piece < len(spans) and spans[piece][0] < start else start
                if start - begin < 3 and piece and spans[piece - 1] == (begin - 1, begin) and normal[begin - 1] == "'":
                    begin -= 1  # a cut may leave a contraction
                if start - begin > SHORT and held is None:
                    text = normal[begin : spans[piece][1]]
                    mapped = self.mapped(text)
                    held = mapped, *self.states(mapped)[:2], np.cumsum([0, *(len(c.encode()) for c in text)]).tolist()
                row.extend(counts[begin] + self.tail_count(normal, begin, start, self.normal(fragment[a:n]), held) for n in range(a + 1, b))
            row.append(counts[end])
        return row

    def tail_count(self, normal: str, begin: int, start: int, part: str, held: tuple | None) -> int:
        """Tokens of the normalised text from a piece's begin to a start, and a part of a cluster behind."""
        near = begin if start - begin <= SHORT else start - 2
        text = normal[near:start] + part
        spans = [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        if near == begin:
            return sum(self.total(text[a:b]) for a, b in spans)
        # the piece is a run of one class; the part goes on with it as far as its characters are of this class
        mapped, last, count, places = held
        own = self.closed_behind(mapped, last, count, places[start - begin], self.mapped(text[2 : spans[0][1]]))
        return own + sum(self.total(text[a:b]) for a, b in spans[1:])

    def normal(self, cluster: str) -> str:
        found = self.normals.get(cluster)
        if found is None:
            if len(self.normals) >= CLUSTERS:
                self.normals.clear()
            found = self.tokenizer.normalizer.normalize_str(cluster)
            if len(cluster) < SHORT:
                self.normals[cluster] = found
        return found

    def of_fragments(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Of the fragments of all texts, where the rows of counts begin, their sizes and the counts; and the bounds of each text's fragments."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        starts, sizes, counts = self.rows.look_up(coded.dictionary)
        at = coded.indices.to_numpy()
        return starts[at], sizes[at], counts, lists.offsets.to_numpy().astype(np.int64)

    def prefix_tables(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text, entry n: tokens of the first n characters; the last entry: of the whole text."""
        starts, sizes, counts, bounds = self.of_fragments(texts)
        before = np.concatenate([[0], np.cumsum(counts[starts + sizes - 1], dtype=np.int64)])
        rows = gathered(counts, starts, sizes) + np.repeat(before[:-1] - np.repeat(before[bounds[:-1]], np.diff(bounds)), sizes)
        places = np.concatenate([[0], np.cumsum(sizes)])[bounds].tolist()
        return [np.concatenate([[0], rows[a : b - 1]]) for a, b in zip(places, places[1:])]

    def totals(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text, from the ends of its fragments' rows."""
        starts, sizes, counts, bounds = self.of_fragments(texts)
        return np.diff(np.concatenate([[0], np.cumsum(counts[starts + sizes - 1], dtype=np.int64)])[bounds])

    def prefix_counts(self, text: str | None) -> np.ndarray:
        return self.prefix_tables(pa.array([text], pa.string()))[0]

    @staticmethod
    def longest_prefix(counts: np.ndarray, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        return int(np.flatnonzero(counts <= budget)[-1])


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One for each Python process, kept over tasks."""
    return without_file(PrefixCounter(path))


def store_prefix_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and counts: 32-bit little-endian integers, one for each prefix of the text."""

    def work(texts: pa.Array) -> list:
        return [[t.astype("<i4").tobytes() for t in counter(tokenizer).prefix_tables(texts)]]

    return map_rows(docs, "text", work, {"counts": ("binary", pa.binary())})


def truncate(docs: DataFrame, tokenizer: str, budget: int) -> DataFrame:
    """doc_id, text cut to the longest prefix of at most ``budget`` tokens, and its count."""

    def work(texts: pa.Array) -> list:
        c, out = counter(tokenizer), ([], [])
        for text, counts in zip(texts.to_pylist(), c.prefix_tables(texts)):
            end = c.longest_prefix(counts, budget)
            out[0].append((text or "")[:end])
            out[1].append(int(counts[end]))
        return list(out)

    return map_rows(docs, "text", work, {"text": ("string", pa.string()), "n_tokens": ("long", pa.int64())})


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the limit is exceeded."""

    def work(texts: pa.Array) -> list:
        totals = counter(tokenizer).totals(texts)
        return [pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), totals, totals > limit]

    kinds = {"n_bytes": ("long", pa.int64()), "n_tokens": ("long", pa.int64()), "over_limit": ("boolean", pa.bool_())}
    return map_rows(docs, "text", work, kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))
