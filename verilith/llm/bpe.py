"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece exactly one last token is possible in a valid
encoding.  The encoder stores that token for every byte prefix:

    last[p] = the token t that ends at p such that the pair
              (last[p - len(t)], t) is one that merging would leave apart

The encoding is read off backwards.  As last[p] depends on bytes before p
only, bytes can be appended with no other entry changed, and after an edit
entries are recomputed from the edit's piece up to the first piece boundary
that falls on an old one.

Pieces come from the usual pattern for this kind of vocabulary
(contractions, words, numbers, other signs, white space), found here with
array operations over whole batches instead of a regular expression.  Pieces
are encoded once per worker: a cache of bounded size maps them to their
tokens, and those it lacks are encoded together, array-wise.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilith.llm.common import BLOCK_CHARS, VOCABULARY, blocks, fresh, quoted

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: Pieces kept in a worker's cache; when it is full it is emptied.
CACHE_PIECES = 600_000
PIECES_AT_ONCE = 16_000
#: Longer pieces are encoded one by one.
LONG_PIECE = 48
#: Pairs of tokens whose answer is kept for long pieces.
KNOWN_PAIRS = 1 << 20
SEPARATOR = 0x10FFFF
#: Sizes, as powers of two, of the table that tells most spans that are no token and of the table of known pairs.
FILTER_BITS, PAIR_BITS = 20, 20


def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for first in range(0, 0x110000, 0x8000):
        points = [p for p in range(first, first + 0x8000) if not 0xD800 <= p < 0xE000]
        text = "".join(map(chr, points))
        for pattern, value in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", SPACE)):
            table[[ord(c) for c in regex.findall(pattern, text)]] = value
    return table


_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


class Vocabulary:
    """Ranks of byte strings, with the pair each token is merged from.

    ``split`` gives each token's two parts (itself twice for single bytes);
    ``pairs`` is the reverse.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for piece, token in ranks.items():
            self.bytes[token] = piece
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.longest = int(self.lengths.max())
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.left = list(range(self.size))
        self.right = list(range(self.size))
        self.pairs: dict[tuple[int, int], int] = {}
        for piece, token in sorted(ranks.items(), key=lambda x: x[1]):
            for at in range(1, len(piece)):
                a, b = ranks.get(piece[:at], -1), ranks.get(piece[at:], -1)
                if 0 <= a < token and 0 <= b < token and self.apart(a, b):
                    self.left[token], self.right[token] = a, b
                    self.pairs[a, b] = token
                    break
        self._arrays()
        self.automaton = None
        self.known: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.classes = _classes()

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves the adjacent tokens ``a`` and ``b`` apart."""
        pairs, left, right = self.pairs, self.left, self.right
        limit = 1 << 60
        while True:
            if pairs.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def last_tokens(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """The last token of each prefix of one piece; ``last`` is continued in place."""
        last = [-1] if last is None else last
        get, apart = self.ranks.get, self.apart
        for end in range(len(last), len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                token = get(data[start:end])
                if token is not None and (start == 0 or apart(last[start], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return last

    def long_piece(self, data: bytes) -> list[int]:
        """``last_tokens`` of a piece of any length, in time linear in it.

        An automaton gives the tokens that end at each byte, the longest
        first, and answers about pairs of tokens are kept.
        """
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for token, piece in enumerate(self.bytes):
                if piece:
                    self.automaton.add_word(piece.decode("latin-1"), token)
            self.automaton.make_automaton()
        lengths, known, done = self.lengths.tolist(), self.known, 0
        last = [-1] * (len(data) + 1)
        for at, token in self.automaton.iter(data.decode("latin-1")):
            end = at + 1
            if end == done:  # this prefix has its token
                continue
            before = last[end - lengths[token]]
            if before >= 0:
                apart = known.get((before, token))
                if apart is None:
                    if len(known) >= KNOWN_PAIRS:
                        known.clear()
                    apart = known[before, token] = self.apart(before, token)
                if not apart:
                    continue
            elif end != lengths[token]:
                continue
            last[end] = token
            done = end
        if len(data) and (done != len(data) or -1 in last[1:]):
            raise ValueError("the vocabulary lacks single bytes")
        return last

    def read_off(self, last: list[int]) -> list[int]:
        out, at = [], len(last) - 1
        while at > 0:
            out.append(last[at])
            at -= int(self.lengths[last[at]])
        return out[::-1]

    # -- the same over many pieces at once -------------------------------------------

    def _arrays(self) -> None:
        self.np_left, self.np_right = np.array(self.left), np.array(self.right)
        keys = np.array([a * self.size + b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_tokens = np.array(list(self.pairs.values()), np.int64)[order]
        rng = np.random.default_rng(1)
        self.byte_values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)
        self._power(1 << 16)
        short = [t for b, t in self.ranks.items() if len(b) <= LONG_PIECE]
        flat = np.frombuffer(b"".join(self.bytes[t] for t in short), np.uint8)
        ends = np.cumsum(self.lengths[short])
        hashes = self._spans(self._sums(flat), ends - self.lengths[short], ends)
        order = np.argsort(hashes)
        self.token_hashes, self.token_of = np.append(hashes[order], np.uint64(0)), np.append(np.array(short, np.int64)[order], -1)
        slot = hashes[order] >> np.uint64(64 - FILTER_BITS)
        self.token_slot = np.full(1 << FILTER_BITS, -1, np.int32)
        self.token_slot[slot[::-1]] = np.arange(len(short))[::-1]
        self.token_probes = int(np.bincount(slot.astype(np.int64)).max())
        #: Token pairs whose answer is known: the pair, twice, plus whether they stay apart.
        self.known_pairs = np.full(1 << PAIR_BITS, -1, np.int64)

    def _power(self, n: int) -> None:
        if len(self.powers) <= n:
            inverse = pow(_MULTIPLIER, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.r_[1, np.full(2 * n, _MULTIPLIER, np.uint64)], dtype=np.uint64)
                self.inverses = np.cumprod(np.r_[1, np.full(2 * n, inverse, np.uint64)], dtype=np.uint64)

    def _sums(self, flat: np.ndarray) -> np.ndarray:
        self._power(len(flat))
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.byte_values[flat] * self.powers[: len(flat)], dtype=np.uint64)))

    def _spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes between two positions that doesn't depend on where they lie."""
        x = (sums[end] - sums[start]) * self.inverses[start]
        x ^= x >> np.uint64(29)
        return x * np.uint64(0xD6E8FEB86659FD93)

    def _tokens(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are those of tokens, and the tokens."""
        slot = self.token_slot[hashes >> np.uint64(64 - FILTER_BITS)]
        open_ = np.flatnonzero(slot >= 0)
        k, wanted = slot[open_], hashes[open_]
        found = self.token_hashes[k] == wanted
        for _ in range(self.token_probes - 1):
            more = np.flatnonzero(~found & (k + 1 < len(self.token_hashes)))
            k[more] += 1
            found[more] = self.token_hashes[k[more]] == wanted[more]
        return open_[found], self.token_of[k[found]]

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``apart`` of many pairs; answers are kept in a table of fixed size."""
        key = a * self.size + b
        slot = ((key.astype(np.uint64) * np.uint64(_MULTIPLIER)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        kept = self.known_pairs[slot]
        new = np.flatnonzero(kept >> 1 != key)
        if len(new):
            answer = self._work_out(a[new], b[new])
            kept[new] = key[new] * 2 + answer
            self.known_pairs[slot[new]] = kept[new]
        return (kept & 1).astype(bool)

    def _work_out(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), 1 << 60, np.int64)
        while len(at):
            key = a * self.size + b
            k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            merged = (self.pair_keys[k] == key) & (self.pair_tokens[k] < limit)
            right, left = self.np_right[a], self.np_left[b]
            a_whole, b_whole = right == a, left == b
            step_a = ((a > b) & ~a_whole) | ((a <= b) & b_whole)  # which side is taken apart
            done = a_whole & b_whole & ~merged
            out[at[done]] = True
            limit = np.where(step_a, a, b + 1)
            a, b = np.where(step_a, right, a), np.where(step_a, b, left)
            go = ~(merged | done)
            at, limit, a, b = at[go], limit[go], a[go], b[go]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Token arrays, as bytes, of pieces of up to LONG_PIECE bytes each.

        All pieces lie in one buffer.  First every span that is a token is
        found, length by length; then the prefixes are filled in, all pieces
        in step, the longest token that ends there first.
        """
        if not pieces:
            return []
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stops = np.cumsum(lengths)
        begins = stops - lengths
        sums = self._sums(flat)
        room = np.repeat(stops, lengths) - np.arange(len(flat))  # bytes from here to the piece's end
        offset = np.arange(len(flat)) - np.repeat(begins, lengths)
        at = np.arange(len(flat))
        starts, sizes, tokens = [], [], []
        for size in range(1, min(self.longest, int(lengths.max())) + 1):
            if size > 1:
                at = at[room[at] >= size]
            hashes = self._spans(sums, at, at + size)
            hit, token = self._tokens(hashes)
            starts.append(at[hit])
            sizes.append(np.full(len(hit), size, np.int64))
            tokens.append(token)
        start, size, token = (np.concatenate(x[::-1]) for x in (starts, sizes, tokens))
        order = np.argsort(start + size, kind="stable")  # each length's spans are a sorted run
        end_in_piece = (offset[start] + size).astype(np.uint8)
        order = order[np.argsort(end_in_piece[order], kind="stable")]
        start, size, token, end_in_piece = start[order], size[order], token[order], end_in_piece[order]
        end = start + size  # the entry of a prefix lies at its end
        first = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
        many = np.diff(np.r_[first, len(end)])
        steps = np.searchsorted(end_in_piece[first], np.arange(1, int(lengths.max()) + 2))
        last = np.full(len(flat) + 1, -1, np.int64)
        for low, high in zip(steps, steps[1:]):
            k, left = first[low:high], many[low:high]
            while len(k):
                fits = offset[start[k]] == 0
                inner = np.flatnonzero(~fits)
                if len(inner):
                    fits[inner] = self._apart(last[start[k[inner]]], token[k[inner]])
                good = k[fits]
                last[end[good]] = token[good]
                k, left = k[~fits] + 1, left[~fits] - 1
                if (left <= 0).any():
                    raise ValueError("the vocabulary lacks single bytes")
        # read off backwards, all pieces in step
        width = int(lengths.max())
        out = np.zeros((len(pieces), width), self.dtype)
        at, count, rows = stops.copy(), np.zeros(len(pieces), np.int64), np.arange(len(pieces))
        while len(rows):
            token = last[at[rows]]
            count[rows] += 1
            out[rows, width - count[rows]] = token
            at[rows] -= self.lengths[token]
            rows = rows[at[rows] > begins[rows]]
        whole, each = out.tobytes(), self.dtype.itemsize
        return [whole[stop - n * each : stop] for stop, n in zip(range(width * each, len(whole) + 1, width * each), count.tolist())]

    def boundaries(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where pieces begin, in texts that lie one behind the other and begin at ``starts``."""
        n = len(points)
        cls = self.classes[points]
        first = np.zeros(n, bool)
        first[starts] = True
        space = cls == SPACE
        after = np.empty(n, np.uint8)  # the class before each character
        after[0], after[1:] = OTHER, cls[:-1]
        was_space = after == SPACE
        was_blank = np.empty(n, bool)
        was_blank[0], was_blank[1:] = False, points[:-1] == 0x20
        ends_run = np.zeros(n, bool)  # white space before another character of the same text
        ends_run[:-1] = ~space[1:] & ~first[1:]
        out = np.where(space, ~was_space | ends_run, np.where(was_space, ~was_blank, cls != after))
        out |= first
        marks = np.flatnonzero((points == 0x27) & out)
        if len(marks):
            stop = np.append(starts[1:], n)
            end = stop[np.searchsorted(starts, marks, side="right") - 1]
            at = lambda k: np.where(marks + k < end, points[np.minimum(marks + k, n - 1)], 0)
            one, two = at(1), at(2)
            single = np.isin(one, [ord(c) for c in "stmd"])
            double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for hit, k in ((single, 2), (double & ~single, 3)):
                m, e = marks[hit], end[hit]
                out[m + 1] = False
                nxt = (m + k)[m + k < e]
                out[nxt[cls[nxt] == LETTER]] = True
        return out

    def pieces(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The pieces of all texts in one list, and the number of each text's."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return [], np.zeros(len(texts), np.int64)
        ends = np.cumsum(lengths)
        begin = self.boundaries(points, (ends - lengths)[lengths > 0])
        so_far = np.cumsum(begin)
        counts = np.diff(np.concatenate(([0], so_far)).take(np.concatenate(([0], ends))))
        if (points == SEPARATOR).any():
            whole, at = "".join(texts), [*np.flatnonzero(begin).tolist(), len(points)]
            return [whole[a:b] for a, b in zip(at, at[1:])], counts
        out = np.full(len(points) + int(so_far[-1]), SEPARATOR, np.uint32)
        out[np.arange(len(points)) + so_far] = points
        return out.tobytes().decode("utf-32-le", "surrogatepass").split(chr(SEPARATOR))[1:], counts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's tokens as the bytes of an array of ``dtype``."""
        pieces, counts = self.pieces(texts)
        found = list(map(self.cache.get, pieces))
        missing = [k for k, tokens in enumerate(found) if tokens is None]
        if missing:
            if len(self.cache) > CACHE_PIECES:
                self.cache.clear()
            new = list(dict.fromkeys([pieces[k] for k in missing]))
            raw = [p.encode("utf-8", "surrogatepass") for p in new]
            long = {p: np.array(self.read_off(self.long_piece(r)), self.dtype).tobytes() for p, r in zip(new, raw) if len(r) > LONG_PIECE}
            short = [(p, r) for p, r in zip(new, raw) if len(r) <= LONG_PIECE]
            for i in range(0, len(short), PIECES_AT_ONCE):
                some = short[i : i + PIECES_AT_ONCE]
                self.cache.update(zip([p for p, _ in some], self.encode_pieces([r for _, r in some])))
            for k in missing:
                found[k] = self.cache.get(pieces[k]) or long[pieces[k]]
        ends = np.cumsum(counts).tolist()
        return [b"".join(found[a:b]) for a, b in zip([0, *ends], ends)]

    def decode(self, tokens: np.ndarray) -> bytes:
        """The bytes of ids; those that the vocabulary lacks are an error."""
        if len(tokens) and (int(tokens.min()) < 0 or int(tokens.max()) >= self.size or not self.lengths[tokens].all()):
            raise ValueError("an id that the vocabulary lacks")
        return b"".join(map(self.bytes.__getitem__, tokens.tolist()))


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """The vocabulary of a file of lines ``base64 rank``; read once per process."""
    if path not in _LOADED:
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        _LOADED[path] = Vocabulary({base64.b64decode(a): int(b) for a, b in pairs})
    return _LOADED[path]


def encode_column(texts: pa.Array, vocab: Vocabulary) -> tuple[list[bytes | None], np.ndarray]:
    """Token bytes of each text of an Arrow column (None where null) and which are null."""
    values = texts.to_pylist()
    null = np.array([v is None for v in values], bool)
    out = []
    for group in blocks(["" if v is None else v for v in values]):
        out += vocab.encode(group)
    return out, null


def encode_documents(docs: DataFrame, path: str = VOCABULARY, text: str = "text", output: str = "token_ids", check: bool = True) -> DataFrame:
    """All columns of ``docs`` with the array column ``output`` of token ids.

    With ``check`` each document is decoded again and compared byte by byte; a
    difference raises an error.  Null texts give null, empty texts an empty
    array; texts of any length, and pieces of any length within them, are
    encoded whole, in linear time.  Repeated rows are encoded alike; an empty
    table gives an empty one.  A column already called like ``output`` is
    replaced.
    """

    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(path)
        for column in columns:
            tokens, null = encode_column(column, vocab)
            if check:
                for value, ids in zip(column.to_pylist(), tokens):
                    if value is not None and vocab.decode(np.frombuffer(ids, vocab.dtype)) != value.encode("utf-8", "surrogatepass"):
                        raise ValueError("decoding doesn't give the text back")
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) // vocab.dtype.itemsize
            flat = np.frombuffer(b"".join(tokens), vocab.dtype).astype(np.int32)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.append(null, False))
            yield pa.ListArray.from_arrays(offsets, pa.array(flat))

    udf = F.arrow_udf(encode, "array<int>").asNondeterministic()
    encode.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(output, udf(quoted(text)))


def decode_tokens(df: DataFrame, path: str = VOCABULARY, tokens: str = "token_ids", output: str = "decoded") -> DataFrame:
    """The text of each array of token ids in column ``output``.

    Null arrays give null and empty ones empty text; null, negative, unused or
    too large ids inside an array raise an error; bytes that are not UTF-8
    become U+FFFD; an empty table gives an empty one; a column already called
    like ``output`` is replaced.
    """

    def decode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(path)
        for column in columns:
            out = []
            for value in column.to_pylist():
                if value is not None and None in value:
                    raise ValueError("a null among the ids")
                out.append(None if value is None else vocab.decode(np.array(value, np.int64)).decode("utf-8", "replace"))
            yield pa.array(out, pa.string())

    return df.withColumn(output, F.arrow_udf(decode, "string").asNondeterministic()(quoted(tokens)))


class PrefixEncoder:
    """An encoded text that takes appends and edits.

    ``pieces`` are the boundaries; ``last`` has the last token of each byte
    prefix of each piece.  Pieces are found from left to right and a match
    looks at most one character beyond its end, but two pieces before it can
    still become a contraction; so an edit begins three pieces earlier and
    ends at the first boundary behind it that was one before.
    """

    BACK = 3

    def __init__(self, text: str = "", vocab: Vocabulary | None = None):
        self.vocab = vocab or vocabulary()
        self.pattern = regex.compile(PATTERN.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.text, self.at, self.last = "", [], []
        self.computed = 0
        self.replace(0, 0, text)

    def _last(self, piece: str) -> list[int]:
        self.computed += 1
        return self.vocab.last_tokens(piece.encode("utf-8", "surrogatepass"))

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of the characters from ``start`` to before ``end``."""
        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        k = max(0, int(np.searchsorted(self.at, start, side="right")) - self.BACK) if self.at else 0
        begin = self.at[k] if k < len(self.at) else 0
        old = {at + shift: j for j, at in enumerate(self.at) if at >= end}
        at, last, tail = [], [], len(self.at)
        for match in self.pattern.finditer(text, begin):
            if match.start() in old and match.start() >= start + len(new):
                tail = old[match.start()]
                break
            before = self.last[k + len(at)] if k + len(at) < len(self.at) else None
            piece = match.group()
            if before and match.start() == self.at[k + len(at)] and self._piece(k + len(at)) == piece[: len(self._piece(k + len(at)))]:
                known = before[: len(piece.encode("utf-8", "surrogatepass")) + 1]  # the prefix's entries stay
                if len(known) <= len(piece.encode("utf-8", "surrogatepass")):
                    self.computed += 1
                last.append(self.vocab.last_tokens(piece.encode("utf-8", "surrogatepass"), list(known)))
            else:
                last.append(self._last(piece))
            at.append(match.start())
        self.at = self.at[:k] + at + [x + shift for x in self.at[tail:]]
        self.last = self.last[:k] + last + self.last[tail:]
        self.text = text

    def _piece(self, k: int) -> str:
        return self.text[self.at[k] : self.at[k + 1] if k + 1 < len(self.at) else len(self.text)]

    def tokens(self) -> list[int]:
        return [t for last in self.last for t in self.vocab.read_off(last)]
