"""Word-level use of the BPE automata: encoding, decoding and counting whole texts with the files of public tokenizers.

Defined results: a null text is an empty text, which has no tokens. Repeated rows give repeated results. A text of any
length is handled whole; memory grows with the longest single text only. Null ids pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from . import common
from .bpe_automaton import SymbolTransducer, Vocabulary

#: Code points from here on may have other classes or lower-case forms in another version of Unicode, so the library is asked.
ASK_FROM = 0x250
STOPS = frozenset(".,;:!?")


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``starts``, one run after another."""
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    at += np.arange(len(at))
    return at


def gathered(flat: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The wanted runs of ``flat``, which holds runs of so many values, one after another, and their lengths."""
    each = counts[wanted]
    return flat[runs((np.cumsum(counts) - counts)[wanted], each)], each


def buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array."""
    _, offsets, data = words.cast(pa.large_string()).buffers()
    places = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), places


def special_split(vocab: Vocabulary):
    """A function that cuts a text at the strings of special tokens: texts at even places, specials at odd ones."""
    if not vocab.special:
        return lambda text: [text]
    longest = sorted(vocab.special, key=len, reverse=True)
    pattern = re.compile("(" + "|".join(map(re.escape, longest)) + ")")
    return lambda text: pattern.split(text) if any(s in text for s in longest) else [text]


class WordCodec:
    """Encoder and decoder of a lower-casing vocabulary with word ends.

    Words are found as the file's normaliser and pre-tokenizer say (NFC, lower case, then its pattern). No word holds white
    space, so that texts are first split at ASCII blanks. Each distinct part of a batch is cut into words once, and
    each distinct word runs through the automaton once, together with all others.
    """

    def __init__(self, path: str):
        vocab = Vocabulary(path)
        if not vocab.suffix or vocab.spec["normalizer"] is None:
            raise ValueError(f"{path} is no lower-casing vocabulary with word ends")
        pattern = next(p["pattern"]["Regex"] for p in vocab.spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        self.special, self.split, self.run = vocab.special, special_split(vocab), SymbolTransducer(vocab)
        self.library = Tokenizer.from_file(path)
        names = vocab.names | {i: s for s, i in vocab.special.items()}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)])

    def words_in(self, part: str) -> list[str]:
        """Words of a part. Letters alone are one, with a stop behind them two; the pattern is for the rest."""
        # below ASK_FROM there is nothing to compose
        if part.isascii() or ord(max(part)) < ASK_FROM:
            low = part.lower()
            if low.isalpha():
                return [low]
            if low[-1:] in STOPS and low[:-1].isalpha():
                return [low[:-1], low[-1]]
            return self.words(low)
        text = self.library.normalizer.normalize_str(part)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def with_specials(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold a special token's string."""
        found = np.zeros(len(texts), bool)
        for s in self.special:
            found |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32-bit) of all texts, one after another, and the number of each text's."""
        special = self.with_specials(texts)
        if special.any():
            return self.encode_specials(texts, special)
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        number: dict[str, int] = {}
        at, n_words = [], []
        for part in coded.dictionary.to_pylist():
            words = self.words_in(part) if part else ()
            n_words.append(len(words))
            for w in words:
                at.append(number.setdefault(w, len(number)))
        flat, counts = self.run.encode(*buffers(pa.array(number, pa.string())))
        n_words, at = np.array(n_words, np.int64), np.array(at, np.int64)
        # from words to parts, from parts to texts
        flat, each = gathered(flat.astype(np.uint32), counts, at)
        edges = np.concatenate([[0], np.cumsum(n_words)])
        flat, each = gathered(flat, np.diff(np.concatenate([[0], np.cumsum(each)])[edges]), coded.indices.to_numpy())
        return flat, np.diff(np.concatenate([[0], np.cumsum(each)])[parts.offsets.to_numpy() - parts.offsets[0].as_py()])

    def encode_specials(self, texts: pa.Array, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with texts cut at special tokens, which have ids of their own."""
        pieces, between, n_pieces = [], [], []
        for text, cut in zip(texts.to_pylist(), special.tolist(), strict=True):
            got = self.split(text) if cut else [text]
            pieces += got[::2]
            between += [[self.special[s]] for s in got[1::2]] + [[]]  # nothing after the last piece
            n_pieces.append(len(got[::2]))
        flat, counts = self.encode(pa.array(pieces, pa.string()))
        ends = np.cumsum(counts)
        after = np.fromiter(map(len, between), np.int64, len(between))
        flat = np.insert(flat, ends[after > 0], np.array([x[0] for x in between if x], np.uint32)) if after.any() else flat
        edges = np.concatenate([[0], np.cumsum(n_pieces)]).astype(np.int64)
        return flat, np.diff(np.concatenate([[0], np.cumsum(counts + after)])[edges])

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The labels of the arcs taken, as the library joins them for a file without decoder."""
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(ends, self.names.take(pa.array(flat))), " ")


def binary_of(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Each text's ids as little-endian 32-bit integers."""
    edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(np.ascontiguousarray(flat, "<u4").tobytes())])


def encode_decode(df: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) and the decoded text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = common.loaded(WordCodec, tokenizer)
        for batch in batches:
            flat, counts = codec.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), binary_of(flat, counts).cast(pa.binary()), codec.decode(flat, counts)],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return common.map_arrow(common.texts(df), run, "doc_id long, n_tokens long, ids binary, decoded string")


# -- counting by transducers -------------------------------------------------------------------------------------------

#: Classes of characters that the byte-level pattern tells apart; E also ends 're and 've, MID are s t m d.
#: EDGE stands behind each text, PAD only behind an edge.
SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE, MID, R, V, E, LL, EDGE, PAD = range(13)
#: States: after an edge or a full contraction, in a run, after white space (one or more, ending in a space or not), and in a possible contraction.
(FREE, IN_L, IN_N, IN_O, ONE_S, ONE_X, MANY_S, MANY_X, APOS, APOS_R, APOS_V, APOS_L) = range(12)
#: Annotations: a word begins at this character, or at the one before it.
HERE, BEFORE = 1, 2
#: No position.
NOWHERE = -1


def word_transducer() -> tuple[np.ndarray, np.ndarray]:
    """Arcs of the byte-level word pattern: the next state and the annotation, by class and state."""
    to, says = np.full((13, 12), FREE, np.uint8), np.zeros((13, 12), np.uint8)
    fresh = {SPACE: ONE_S, WHITE: ONE_X, LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O, QUOTE: APOS, MID: IN_L, R: IN_L, V: IN_L, E: IN_L, LL: IN_L, EDGE: FREE}
    letters = (LETTER, MID, R, V, E, LL)

    def arc(state, c, target, said):
        to[c, state], says[c, state] = target, said

    for c, target in fresh.items():
        for state in range(12):
            arc(state, c, target, HERE)
    for c in letters:
        arc(IN_L, c, IN_L, 0)
        arc(ONE_S, c, IN_L, 0)
        arc(MANY_S, c, IN_L, BEFORE)
        arc(MANY_X, c, IN_L, BEFORE | HERE)
    for state, said in ((IN_N, 0), (ONE_S, 0), (MANY_S, BEFORE), (MANY_X, BEFORE | HERE)):
        arc(state, NUMBER, IN_N, said)
    for c in (OTHER, QUOTE):
        for state, said in ((IN_O, 0), (ONE_S, 0), (MANY_S, BEFORE), (APOS, 0)):
            arc(state, c, IN_O, said)
    arc(MANY_X, OTHER, IN_O, BEFORE | HERE)
    arc(MANY_X, QUOTE, APOS, BEFORE | HERE)
    for state in (ONE_S, ONE_X, MANY_S, MANY_X):
        arc(state, SPACE, MANY_S, 0)
        arc(state, WHITE, MANY_X, 0)
    arc(APOS, MID, FREE, 0)
    for c, pending in ((R, APOS_R), (V, APOS_V), (LL, APOS_L)):
        arc(APOS, c, pending, 0)
    for pending in (APOS_R, APOS_V, APOS_L):  # no contraction after all: its letter began a word
        for c, target in fresh.items():
            arc(pending, c, target, BEFORE | HERE)
        for c in letters:
            arc(pending, c, IN_L, BEFORE)
    arc(APOS_R, E, FREE, 0)
    arc(APOS_V, E, FREE, 0)
    arc(APOS_L, LL, FREE, 0)
    return to, says


UNKNOWN = 255


class CharacterClasses:
    """Class of each code point, as the library's pre-tokenizer tells it when a point first comes up."""

    def __init__(self, library: Tokenizer):
        self.words = library.pre_tokenizer.pre_tokenize_str
        self.table = np.full(0x110000, UNKNOWN, np.uint8)
        for text, c in ((" ", SPACE), ("'", QUOTE), ("stmd", MID), ("r", R), ("v", V), ("e", E), ("l", LL)):
            for x in text:
                self.table[ord(x)] = c

    def ask(self, x: str) -> int:
        for before, c in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if len(self.words(before + x)) == 1:
                return c
        return WHITE

    def of(self, points: np.ndarray) -> np.ndarray:
        got = self.table[points]
        unknown = got == UNKNOWN
        if unknown.any():
            for p in np.unique(points[unknown]).tolist():
                self.table[p] = self.ask(chr(p))
            got = self.table[points]
        return got


class TokenCounter:
    """Counts byte-level tokens with state maps that carry counts.

    The characters of many texts are cut into chunks of ``width``. All chunks run through the word transducer at the same
    time, from every state. A chunk's map tells for each state before it: the state after it, the tokens of the words that
    begin and end inside, and where the first and the last word begin. Maps are composed by a parallel prefix scan: counts
    add up, and the word over the seam, which begins last on the left and ends where the first one on the right
    begins, is counted. Token counts of words are sums of the annotations of the byte transducer's arcs.
    """

    def __init__(self, path: str, width: int = 512):
        vocab = Vocabulary(path)
        if vocab.suffix or vocab.spec["normalizer"] is not None:
            raise ValueError(f"{path} is no byte-level vocabulary")
        self.width, self.split, self.run = width, special_split(vocab), SymbolTransducer(vocab)
        self.to, self.says = word_transducer()
        self.classes = CharacterClasses(Tokenizer.from_file(path))

    def tokens_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Tokens of the words from the character positions a to b; an edge has none."""
        x, n = self.at[a], np.where(self.kinds[a] == EDGE, 0, self.at[b] - self.at[a])
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.data[runs(x, n)].tobytes())).dictionary_encode()
        return self.run.counts(*buffers(words.dictionary))[words.indices.to_numpy()]

    def tokens_between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same in any shape and with repeats; none where b isn't behind a."""
        out, some = np.zeros(a.shape, np.int64), b > a
        pairs, which = np.unique(a[some] << 32 | b[some], return_inverse=True)
        out[some] = self.tokens_of(pairs >> 32, pairs & 0xFFFFFFFF)[which]
        return out

    def maps(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """chunks: width x n classes. For each chunk and state before it: the state after it, the tokens inside, the first and the last beginning (NOWHERE if none)."""
        w, n = chunks.shape
        k = self.to.shape[1]
        state = np.broadcast_to(np.arange(k, dtype=np.uint8), (n, k)).copy()
        first, last, inside = np.full((n, k), NOWHERE), np.full((n, k), NOWHERE), np.zeros((n, k), np.int64)
        to, says = self.to.ravel(), self.says.ravel()
        origin = np.arange(n) * w
        every, one = np.arange(n), None
        apart = every  # chunks whose states still differ by the state before them
        begins = np.zeros((w + 1, n), bool)  # of the common path; row i is position i - 1
        for i, row in enumerate(chunks):
            if len(apart):
                at = row[apart].astype(np.int64)[:, None] * k + state[apart]
                for mark, place in ((BEFORE, i - 1), (HERE, i)):
                    here = (says[at] & mark) > 0
                    if here.any():
                        x, y = np.nonzero(here)
                        c = apart[x]
                        where = origin[c] + place
                        old = last[c, y]
                        more = old >= 0
                        inside[c[more], y[more]] += self.tokens_between(old[more], where[more])
                        first[c[~more], y[~more]] = where[~more]
                        last[c, y] = where
                state[apart] = to[at]
            if one is None or len(one) + len(apart) < n:
                one = np.setdiff1d(every, apart, assume_unique=True)
            if len(one):
                at = row[one].astype(np.int64) * k + state[one, 0]
                said = says[at]
                begins[i, one] |= (said & BEFORE) > 0
                begins[i + 1, one] |= (said & HERE) > 0
                state[one, 0] = to[at]
            if len(apart):
                apart = apart[(state[apart] != state[apart, :1]).any(axis=1)]
        # the states of a common path are kept in the first column only
        settled = np.setdiff1d(every, apart, assume_unique=True)
        state[settled] = state[settled, :1]
        # words of the common paths, and those that lead into them
        chunk, row = np.nonzero(begins.T)
        if len(chunk):
            where = origin[chunk] + row - 1
            new = np.ones(len(chunk), bool)
            new[1:] = chunk[1:] != chunk[:-1]
            counts = np.zeros(len(chunk), np.int64)
            inner = np.flatnonzero(~new)
            counts[inner] = self.tokens_of(where[inner - 1], where[inner])
            starts = np.flatnonzero(new)
            c, lead = chunk[starts], where[starts][:, None]
            old = last[c]
            inside[c] += np.add.reduceat(counts, starts)[:, None] + np.where(old >= 0, self.tokens_between(np.where(old >= 0, old, lead), np.broadcast_to(lead, old.shape)), 0)
            first[c] = np.where(old >= 0, first[c], lead)
            ends = np.append(starts[1:], len(chunk)) - 1
            last[c] = where[ends][:, None]
        return state, inside, first, last

    def composed(self, left: tuple, right: tuple) -> tuple:
        """The maps of pairs of neighbours."""
        after = left[0].astype(np.int64)
        state, inside, first, last = (np.take_along_axis(x, after, axis=1) for x in right)
        seam = (left[3] >= 0) & (first >= 0)
        over = self.tokens_between(np.where(seam, left[3], 0), np.where(seam, first, 0))
        return state, left[1] + inside + over, np.where(left[2] >= 0, left[2], first), np.where(last >= 0, last, left[3])

    def scan(self, maps: tuple) -> tuple:
        """Inclusive prefix composition, by doubling steps."""
        done, step = tuple(x.copy() for x in maps), 1
        while step < len(done[0]):
            new = self.composed(tuple(x[:-step] for x in done), tuple(x[step:] for x in done))
            for x, y in zip(done, new, strict=True):
                x[step:] = y
            step *= 2
        return done

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Each begins a chunk."""
        if not texts:
            return []
        parts, owner, extra = [], [], [0] * len(texts)
        for i, text in enumerate(texts):
            cut = self.split(text)
            extra[i] = len(cut) // 2
            parts += cut[::2]
            owner += [i] * len(cut[::2])
        # an edge behind each part, then blanks to the end of its last chunk
        w, sizes = self.width, np.fromiter(map(len, parts), np.int64, len(parts))
        n_chunks = (sizes + w) // w
        joined = "".join(x for p, n, c in zip(parts, sizes.tolist(), n_chunks.tolist(), strict=True) for x in (p, "\n" * (c * w - n)))
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        bytes_of = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        self.at, self.data = np.concatenate([[0], np.cumsum(bytes_of)]), np.frombuffer(joined.encode(), np.uint8)
        self.kinds, ends = self.classes.of(points), np.cumsum(n_chunks)
        edges = (ends - n_chunks) * w + sizes
        self.kinds[runs(edges, ends * w - edges)] = PAD
        self.kinds[edges] = EDGE
        _, inside, _, _ = self.scan(self.maps(np.ascontiguousarray(self.kinds.reshape(-1, w).T)))
        upto = inside[ends - 1, FREE]
        for i, n in zip(owner, np.diff(np.concatenate([[0], upto])).tolist(), strict=True):
            extra[i] += n
        return extra


def count_tokens(df: DataFrame, tokenizer: str, group_chars: int = 1_000_000) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row; ``group_chars`` characters are counted at a time, or one whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = common.loaded(TokenCounter, tokenizer)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts: list[int] = []
            for a, b in common.groups_by_size(texts, group_chars):
                counts += counter.count(texts[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    return common.map_arrow(common.texts(df), run, "doc_id long, n_bytes long, n_tokens long")
