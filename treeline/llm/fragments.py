"""BPE by forced-boundary splitting.

A pair of bytes that occurs inside no vocabulary token can never be merged across, so a cut between
the two is certain: the fragments on both sides are encoded independently and concatenated. White
space is such a byte for a vocabulary whose pre-tokenizer drops it, so texts are first cut at blanks
and line feeds. A fragment not met before is cut into the pre-tokenizer's pieces, each piece at the
certain cuts of the pair table, and the parts go through the tokenizers library's own model. Results
are kept under fixed bounds, so memory does not grow with the input.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer
from tokenizers.models import BPE

from .batches import joined

#: Stands behind pieces that are cut or encoded together.
END = "\0"
#: Bytes of a table of ids; each look-up goes once over its keys.
TABLE_BYTES = 12 << 20
#: Letters and signs below U+0250 without blanks: here lower-casing, NFC and the classes of letters and digits need no context.
PLAIN = regex.compile("[!-~¡-ɏ]*+")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class IdTable:
    """Ids by text in Arrow and numpy arrays; when they take more than ``most`` bytes, the half that was used last stays."""

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]], most: int = TABLE_BYTES):
        self.encode, self.most, self.now = encode, most, 0
        self.clear()

    def clear(self) -> None:
        self.keys, self.ids = pa.array([], pa.string()), np.zeros(0, dtype="<u4")
        self.starts, self.sizes, self.used = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, keys: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.keys = pa.concat_arrays([self.keys, keys])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used = np.concatenate([self.used, np.full(len(sizes), self.now)])
        self.ids = np.concatenate([self.ids, ids])

    def look_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct texts, where in the third array their ids begin, and how many they are."""
        self.now += 1
        if self.keys.nbytes + self.ids.nbytes + 3 * self.starts.nbytes > self.most:
            self.shrink()
        found = pc.index_in(texts, value_set=self.keys)
        new = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        at = found.fill_null(0).to_numpy().astype(np.int64)
        if len(new):
            sizes, ids, order = self.encode(texts.take(pa.array(new)))
            at[new[order]] = len(self.keys) + np.arange(len(new))
            self.add(texts.take(pa.array(new[order])), sizes, ids)
        self.used[at] = self.now
        return self.starts[at], self.sizes[at], self.ids

    def shrink(self) -> None:
        keep = np.flatnonzero(self.used > np.median(self.used))
        keys, sizes, ids = self.keys.take(pa.array(keep)), self.sizes[keep], gathered(self.ids, self.starts[keep], self.sizes[keep])
        self.clear()
        if keys.nbytes + ids.nbytes < self.most // 2:
            self.add(keys, sizes, ids)


def gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ids, one after another."""
    ends = np.cumsum(sizes)
    return ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class PieceModel:
    """Encodes pieces of the pre-tokenizer: cut at certain cuts, the parts by the library's model."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        with open(path) as f:
            self.spec = json.load(f)
        model = self.spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.closed = self.tokenizer.model
        #: The same merges without the end of a word, for parts that a word goes on behind.
        self.open = BPE(model["vocab"], merges) if self.suffix else self.closed
        to_byte = byte_alphabet()
        self.alphabet = {b: c for c, b in to_byte.items()}
        self.to_byte = {ord(c): b for c, b in to_byte.items()}
        joined = bytearray(65536)
        for token in model["vocab"]:
            raw = [to_byte[c] for c in token.removesuffix(self.suffix)]
            for a, b in zip(raw, raw[1:]):
                joined[a << 8 | b] = 1
        #: 1 at a << 8 | b if some token holds byte a before byte b.
        self.joined = bytes(joined)
        self.special = [t["content"] for t in self.spec["added_tokens"]]
        low = range(97, 123)
        after = {a: "".join(chr(b) for b in low if not joined[a << 8 | b]) for a in low}
        #: A certain cut in a text of ASCII lower-case letters.
        self.cut_letters = re.compile("|".join(f"{chr(a)}[{x}]" for a, x in after.items() if x) or "(?!)")
        self.table = IdTable(self.encode_pieces)

    def mapped(self, text: str) -> str:
        """The text's bytes in the vocabulary's alphabet."""
        return text.encode().decode("latin1").translate(self.alphabet)

    def certain_cuts(self, raw: bytes) -> list[bytes]:
        joined, cuts = self.joined, [0]
        cuts.extend(n for n, (a, b) in enumerate(zip(raw, raw[1:]), 1) if not joined[a << 8 | b])
        if len(cuts) == 1:
            return [raw]
        return [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)])]

    def raw_ids(self, raw: bytes) -> list[int]:
        parts, ids = self.certain_cuts(raw), []
        for n, part in enumerate(parts, 1):
            model = self.closed if n == len(parts) else self.open
            ids.extend(t.id for t in model.tokenize(part.decode("latin1").translate(self.alphabet)))
        return ids

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one piece, given as plain text."""
        if piece.isascii() and piece.isalpha() and piece.islower() and not self.cut_letters.search(piece):
            return [t.id for t in self.closed.tokenize(piece)]
        return self.raw_ids(piece.encode())

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes, ids and order of pieces without a zero byte."""
        sizes, ids = [], []
        for piece in joined(pieces, END).split(END):
            own = self.piece_ids(piece) if piece else []
            sizes.append(len(own))
            ids += own
        return np.array(sizes, dtype=np.int64), np.array(ids, dtype="<u4"), np.arange(len(pieces))

    def encode_marked(self, words: pa.Array, simple: pa.Array, mark: Callable[[pa.Array], pa.Array], other: Callable[[str], list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes, ids and order of words: simple ones together, with a mark behind each of their pieces, then the others one by one."""
        simple = simple.to_numpy(zero_copy_only=False)
        first, others = np.flatnonzero(simple), np.flatnonzero(~simple)
        # the nothing behind a word's last mark is a piece without ids
        lists = pc.split_pattern(mark(words.take(pa.array(first))), END)
        coded = lists.flatten().dictionary_encode()
        at, (starts, sizes, ids) = coded.indices.to_numpy(), self.table.look_up(coded.dictionary)
        ends = np.concatenate([[0], np.cumsum(sizes[at])])[lists.offsets.to_numpy()]
        own = [other(w) for w in words.take(pa.array(others)).to_pylist()]
        return (
            np.concatenate([np.diff(ends), np.fromiter(map(len, own), dtype=np.int64, count=len(own))]),
            np.concatenate([gathered(ids, starts[at], sizes[at]), np.array([i for ids_of in own for i in ids_of], dtype="<u4")]),
            np.concatenate([first, others]),
        )

    def library_ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def has_special(self, text: str) -> bool:
        return "<|" in text and any(s in text for s in self.special)


class FragmentEncoder(PieceModel):
    """Encodes and decodes as the tokenizers library does with a lower-casing BPE file whose pre-tokenizer drops white space."""

    #: Fragments in which lower-casing, NFC and the classes of characters need no context, and the pre-tokenizer's pattern for these.
    SIMPLE = r"^[!-~\x{A1}-\x{12F}\x{131}-\x{24F}]+$"
    SIMPLE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^\s\pL\pN]+"

    def __init__(self, path: str):
        super().__init__(path)
        if any(self.joined[c << 8 | b] or self.joined[b << 8 | c] for b in range(256) for c in (0x20, 0x0A)):
            raise ValueError("tokens of this vocabulary hold white space")
        self.pattern = regex.compile(self.spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.numbers = [str(i) for i in range(size)]
        self.fragments = IdTable(self.encode_fragments)
        self.as_bytes = [pa.array([x.encode() for x in of], pa.binary()) for of in (self.tokens, self.numbers)]

    def pieces(self, fragment: str) -> list[str]:
        """The normalised pieces of a fragment without special tokens, as plain text."""
        if fragment.isascii() and fragment.isprintable() or PLAIN.fullmatch(fragment):
            return self.pattern.findall(fragment.lower())
        normal = self.tokenizer.normalizer.normalize_str(fragment)
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(map(self.to_byte.__getitem__, map(ord, p))).decode() for p, _ in found]

    def fragment_ids(self, fragment: str) -> list[int]:
        if self.has_special(fragment):
            return self.library_ids(fragment)
        return [i for piece in self.pieces(fragment) for i in self.piece_ids(piece)]

    def encode_fragments(self, fragments: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        simple = pc.and_not(pc.match_substring_regex(fragments, self.SIMPLE), pc.match_substring(fragments, "<|"))
        mark = lambda some: pc.replace_substring_regex(pc.utf8_lower(some), self.SIMPLE_PATTERN, "\\0" + END)
        return self.encode_marked(fragments, simple, mark, self.fragment_ids)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), one text after another, and the bounds of each text's."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        starts, sizes, ids = self.fragments.look_up(coded.dictionary)
        at = coded.indices.to_numpy()
        sizes = sizes[at]
        return gathered(ids, starts[at], sizes), np.concatenate([[0], np.cumsum(sizes)])[lists.offsets.to_numpy()]

    def ids(self, text: str | None) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        return self.batch(pa.array([text], pa.string()))[0].astype("<u4").tobytes()

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """As the library decodes without a decoder: tokens joined by blanks, special ones kept; in UTF-8."""
        return self.spelled(self.as_bytes[0], ids, bounds)

    def numbered(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The ids in decimal, joined by blanks."""
        return self.spelled(self.as_bytes[1], ids, bounds)

    @staticmethod
    def spelled(table: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), table.take(pa.array(ids))), b" ")

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class ByteLevelEncoder(PieceModel):
    """Encodes as the tokenizers library does with a byte-level BPE file whose tokens may begin with a blank.

    Before a blank that follows no white space the pre-tokenizer always begins a new piece, so texts are
    cut there first. Arrow numbers the words of many texts and looks distinct ones up in a table; those not
    met before are cut into the pre-tokenizer's pieces, and only new pieces go through the library's model.
    """

    #: A blank behind white space (of these characters or fewer).
    SPACED = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "
    BLANKS = regex.compile(r"(?<=\S)(?= )")
    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    PLAIN = regex.compile("[\n -~¡-ɏ]*+")
    #: Words whose only white space is single line feeds, and the same pattern for these and a blank before them.
    SIMPLE = r"^[!-~\x{A1}-\x{24F}]+(?:\n[!-~\x{A1}-\x{24F}]+)*\n?$"
    SIMPLE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\pL+| ?\pN+| ?[^\s\pL\pN]+|\n"

    def __init__(self, path: str):
        super().__init__(path)
        pre = self.spec["pre_tokenizer"]
        if self.suffix or self.spec["normalizer"] or (pre["type"], pre["add_prefix_space"], pre["use_regex"]) != ("ByteLevel", False, True):
            raise ValueError("not a plain byte-level file")
        #: Words with a blank before them, and without.
        self.words, self.firsts = IdTable(lambda words: self.encode_words(words, " ")), IdTable(lambda words: self.encode_words(words, ""))

    def piece_ids(self, piece: str) -> list[int]:
        return [t.id for t in self.closed.tokenize(self.mapped(piece))]

    def chunk_ids(self, chunk: str) -> list[int]:
        if self.has_special(chunk) or not self.PLAIN.fullmatch(chunk):
            return self.library_ids(chunk)
        return [i for piece in self.PATTERN.findall(chunk) for i in self.piece_ids(piece)]

    def encode_words(self, words: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes, ids and order of words with ``before`` in front."""
        simple = pc.and_not(pc.match_substring_regex(words, self.SIMPLE), pc.match_substring(words, "<|"))
        mark = lambda some: pc.replace_substring_regex(pc.binary_join_element_wise(before, some, ""), self.SIMPLE_PATTERN, "\\0" + END)
        return self.encode_marked(words, simple, mark, lambda word: self.chunk_ids(before + word))

    def ids_of_words(self, words: pa.Array, bounds: np.ndarray) -> list[np.ndarray]:
        """Ids of texts; words: those of all texts; bounds: where each text's words begin, and the end."""
        coded, first = words.dictionary_encode(), bounds[:-1]
        at = coded.indices.to_numpy().copy()
        # a text's first word stands behind no blank
        leading, back = np.unique(at[first], return_inverse=True)
        (starts, sizes, ids), (more, lengths, others) = self.words.look_up(coded.dictionary), self.firsts.look_up(coded.dictionary.take(pa.array(leading)))
        starts, sizes = np.concatenate([starts, len(ids) + more]), np.concatenate([sizes, lengths])
        at[first] = len(coded.dictionary) + back
        starts, sizes = starts[at], sizes[at]
        flat = gathered(np.concatenate([ids, others]), starts, sizes)
        cuts = np.concatenate([[0], np.cumsum(sizes)])[bounds].tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (null: empty)."""
        texts = pc.fill_null(texts, "")
        spaced = pc.match_substring_regex(texts, self.SPACED)
        lists = pc.split_pattern(pc.if_else(spaced, "", texts), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        out = self.ids_of_words(lists.flatten(), bounds - bounds[0])
        rest = np.flatnonzero(spaced.to_numpy(zero_copy_only=False)).tolist()
        if rest:
            cut = [self.BLANKS.split(texts[n].as_py()) for n in rest]
            words = pa.array([w[1:] if n else w for words in cut for n, w in enumerate(words)], pa.string())
            for n, ids in zip(rest, self.ids_of_words(words, np.cumsum([0, *map(len, cut)]))):
                out[n] = ids
        return out

    def ids(self, text: str | None) -> bytes:
        """All ids of a text (null: empty) as little-endian unsigned 32-bit integers."""
        return self.batch(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


def without_file(model: PieceModel) -> PieceModel:
    """The file's content is not needed any more."""
    model.spec.clear()
    return model


@lru_cache(maxsize=2)
def encoder(path: str) -> FragmentEncoder:
    """One for each Python process, kept over tasks."""
    return without_file(FragmentEncoder(path))


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteLevelEncoder:
    return without_file(ByteLevelEncoder(path))
