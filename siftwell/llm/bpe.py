"""Byte-level BPE as a lazily determinised transducer; streaming UTF-8 decoding.

A token sequence is the encoding of its bytes exactly when each adjacent pair is
*compatible*: encoding the two tokens' bytes gives the same two tokens. So a
nondeterministic transducer guesses tokens along a byte trie and may begin a token
only after a compatible one; the encoding is its one accepting path. ``Transducer``
determinises it while it runs: a state is the set of open guesses, each a trie node
with the tokens that are not yet emitted, and a token is emitted once all open guesses
agree on it, which a token's length bounds.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import arrays as A
from .common import default_tokenizer, kept, trim

#: Determinised states, and cached pieces, kept by a worker before it lets the deeper states, and the older pieces, go.
MAX_STATES = 80_000
MAX_PIECES = 1_000_000
#: Known pairs of tokens kept by a worker.
MAX_FITS = 60_000
#: Bytes of text that are split and told apart at once.
SLICE = 1_000_000


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from a file of base64 tokens and ranks."""
    out: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                a, b = line.split()
                out[int(b)] = base64.b64decode(a)
    if sorted(out) != list(range(len(out))):
        raise ValueError("token ids must be 0 .. n-1 in order of merging")
    return [out[i] for i in range(len(out))]


class Merges:
    """The vocabulary: token bytes, the byte trie and each token's two merged halves."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        missing = [b for b in range(256) if bytes([b]) not in self.ids]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        self.left = list(range(len(tokens)))
        self.right = list(range(len(tokens)))
        self.pairs: dict[tuple[int, int], int] = {}
        self.reachable = [True] * len(tokens)
        for i, t in enumerate(tokens):
            if len(t) > 1:
                parts = self._merge(t, i)
                if len(parts) == 2:
                    self.left[i], self.right[i] = parts
                    self.pairs[parts[0], parts[1]] = i
                else:
                    self.reachable[i] = False  # no pair of earlier tokens gives it
        self.next: list[dict[int, int]] = [{}]
        self.at: list[int] = [-1]
        for i, t in enumerate(tokens):
            if not self.reachable[i]:
                continue
            n = 0
            for b in t:
                m = self.next[n].get(b)
                if m is None:
                    m = self.next[n][b] = len(self.next)
                    self.next.append({})
                    self.at.append(-1)
                n = m
            self.at[n] = i
        self._fits: dict[int, bool] = {}

    def _merge(self, piece: bytes, below: int) -> list[int]:
        """Plain merging, lowest rank first, with tokens under ``below``."""
        ids, parts = self.ids, [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            best, where = below, -1
            for k in range(len(parts) - 1):
                r = ids.get(parts[k] + parts[k + 1], below)
                if r < best:
                    best, where = r, k
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return [ids[p] for p in parts]

    def brute(self, piece: bytes) -> list[int]:
        """The definition, for tests."""
        return self._merge(piece, len(self.tokens))

    def fits(self, a: int, b: int) -> bool:
        """Whether token ``b`` may stand right after token ``a``."""
        k = a << 32 | b
        known = self._fits.get(k)
        if known is None:
            if len(self._fits) > MAX_FITS:
                self._fits.clear()
            known = self._fits[k] = self._fits_now(a, b)
        return known

    def _fits_now(self, a: int, b: int) -> bool:
        # Undo the two tokens' merges, latest first, looking at the halves that touch. A merge
        # across the border spoils the pair if it comes before the merge that hides its halves.
        hidden = len(self.tokens)
        while True:
            over = self.pairs.get((a, b))
            if over is not None and over < hidden:
                return False
            split_a, split_b = self.left[a] != a, self.left[b] != b
            if not split_a and not split_b:
                return True
            # at equal ranks the left one is merged first, so the right one is undone first
            if split_a and (a > b or not split_b):
                hidden, a = a, self.right[a]
            else:
                # its merge ranks after an equal merge at the border, which stands further left
                hidden, b = b + 1, self.left[b]


class Transducer:
    """The determinised transducer of one vocabulary; states appear as texts need them."""

    def __init__(self, merges: Merges, max_states: int = MAX_STATES):
        self.m, self.max_states = merges, max_states
        self._reset()

    def _reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.state: list[tuple] = []
        self.arcs: dict[int, int | tuple[int, tuple[int, ...]]] = {}
        self.shared: dict[tuple, tuple] = {}  # equal parts of states are one object
        self.start = self._intern((-1, ((), 0), ()))

    def _shrink(self) -> None:
        """Keep the states nearest to the start, a third of what is allowed: most texts pass through these."""
        state, arcs = self.state, self.arcs
        out: dict[int, list[int]] = {}
        for k in arcs:
            out.setdefault(k >> 8, []).append(k)
        new, order = {self.start: 0}, [self.start]
        for n in order:  # grows while it is read
            for k in out.get(n, ()):
                to = arcs[k] if arcs[k].__class__ is int else arcs[k][0]
                if to not in new and len(order) < self.max_states // 3:
                    new[to] = len(order)
                    order.append(to)
        self._reset()
        for n in order:
            last, done, opened = state[n]
            self._intern((last, self._pair(done), tuple(map(self._pair, opened))))
        for k, arc in arcs.items():
            to = arc if arc.__class__ is int else arc[0]
            if k >> 8 in new and to in new:
                self.arcs[new[k >> 8] << 8 | k & 255] = new[to] if arc.__class__ is int else (new[to], arc[1])

    def _pair(self, x: tuple) -> tuple:
        """An equal (tokens, node) that states share."""
        one = self.shared.setdefault
        x = (one(x[0], x[0]), x[1])
        return one(x, x)

    def _intern(self, s: tuple) -> int:
        n = self.number.get(s)
        if n is None:
            n = self.number[s] = len(self.state)
            self.state.append(s)
        return n

    def _step(self, n: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, done, opened = self.state[n]
        m, new_open, new_done = self.m, [], None
        for rest, node in (done, *opened):
            child = m.next[node].get(byte)
            if child is None:
                continue
            tok = m.at[child]
            if m.next[child]:
                new_open.append((rest, child))
            if tok >= 0:
                before = rest[-1] if rest else last
                if before < 0 or m.fits(before, tok):
                    new_done = ((*rest, tok), 0)
        out = new_done[0]
        if not new_open:
            return self._intern((out[-1] if out else last, ((), 0), ())), out
        # what all guesses share is certain
        k = 0
        for k, t in enumerate(out):
            if not all(len(r) > k and r[k] == t for r, _ in new_open):
                break
        else:
            k = len(out)
        out, rest = out[:k], out[k:]
        if k:
            last = out[-1]
            new_open = [(r[k:], node) for r, node in new_open]
        # the last token matters only where a guess has no token of its own
        if rest and () not in [r for r, _ in new_open]:
            last = -2
        one = self.shared.setdefault
        return self._intern((last, self._pair((rest, 0)), tuple(map(self._pair, sorted(new_open))))), one(out, out)

    def encode(self, piece: bytes) -> list[int]:
        n, out, arcs = self.start, [], self.arcs
        for b in piece[:-1]:
            k = n << 8 | b
            arc = arcs.get(k)
            if arc is None:
                if len(self.state) > self.max_states:  # also within a piece
                    here = self.state[n]
                    self._shrink()
                    n, arcs = self._intern(here), self.arcs
                    k = n << 8 | b
                arc = self._step(n, b)
                arcs[k] = arc = arc if arc[1] else arc[0]
            if arc.__class__ is int:  # nothing is emitted
                n = arc
            else:
                n, emitted = arc
                out += emitted
        if piece:
            out += self._end(n, piece[-1])
        return out

    def _end(self, n: int, byte: int) -> tuple[int, ...]:
        """What is emitted with the last byte: the guess that ends there, without a state of its own."""
        last, done, opened = self.state[n]
        m = self.m
        for rest, node in (done, *opened):
            child = m.next[node].get(byte)
            if child is not None:
                tok = m.at[child]
                if tok >= 0:
                    before = rest[-1] if rest else last
                    if before < 0 or m.fits(before, tok):
                        return (*rest, tok)
        raise AssertionError("every byte is a token")


def piece_bounds(cps: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces begin: the split of texts before merging, for whole batches.

    The published pattern: contractions, runs of letters, of digits and of other signs, each
    with one space before it, and runs of white space without the last one before a word.
    """
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    kind = A.class_table()[cps]
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    first = np.zeros(n, bool)
    first[off[:-1][off[:-1] < off[1:]]] = True
    new |= first
    begin = new.copy()
    run = np.flatnonzero(new & (kind != A.SPACE) & ~first)
    run = run[kind[run - 1] == A.SPACE]
    begin[run - 1] = True
    begin[run[cps[run - 1] == 32]] = False
    quote = np.flatnonzero((cps == 39) & begin)  # at its run's start with no space taken in
    if len(quote):
        end = off[np.searchsorted(off, quote, "right")]
        a = cps[np.minimum(quote + 1, n - 1)]
        b = cps[np.minimum(quote + 2, n - 1)]
        one = (quote + 1 < end) & np.isin(a, [ord(c) for c in "sdmt"])
        two = (quote + 2 < end) & ~one & (((a == 108) & (b == 108)) | (((a == 118) | (a == 114)) & (b == 101)))
        for hit, size in ((one, 2), (two, 3)):
            q = quote[hit]
            begin[q + 1] = False
            after = q + size
            begin[after[after < n]] = True
    return np.flatnonzero(begin)


class Pieces:
    """Known pieces and their ids in flat arrays, found by hash and compared byte by byte."""

    def __init__(self, dtype: type, most: int):
        self.dtype, self.most = dtype, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.n = 0
        self.used = np.zeros(0, bool)
        self.text, self.ids = np.zeros(0, np.uint8), np.zeros(0, self.dtype)
        self.text_at, self.ids_at = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def find(self, h: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The slot of each span of ``raw`` with the hash ``h``, -1 where it isn't known."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        slot = np.where(self.keys[at] == h, self.slot[at], -1)
        hit = np.flatnonzero(slot >= 0)
        begin = self.text_at[slot[hit]]
        hit, begin = (x[self.text_at[slot[hit] + 1] - begin == size[hit]] for x in (hit, begin))
        out = np.full(len(h), -1)
        hit = hit[equal(raw, start[hit], self.text, begin, size[hit])]
        out[hit] = slot[hit]
        self.used[out[hit]] = True
        return out

    def add(self, h: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray, ids: list) -> None:
        """Remember new pieces; a hash that is known already keeps its piece."""
        if self.n + len(h) > self.most:
            self._shrink()
        self.text = np.concatenate([self.text, raw[A.expand(start, size)]])
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), self.dtype, int(lens.sum()))])
        self.text_at = np.concatenate([self.text_at, self.text_at[-1] + np.cumsum(size)])
        self.ids_at = np.concatenate([self.ids_at, self.ids_at[-1] + np.cumsum(lens)])
        self.used = np.append(self.used, np.zeros(len(h), bool))
        self._index(h, np.arange(self.n, self.n + len(h)))
        self.n += len(h)

    def _index(self, h: np.ndarray, slot: np.ndarray) -> None:
        keys, slot = np.concatenate([self.keys, h]), np.concatenate([self.slot, slot])
        order = np.argsort(keys, kind="stable")  # merges two sorted runs
        keys, slot = keys[order], slot[order]
        new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        self.keys, self.slot = keys[new], slot[new]

    def _shrink(self) -> None:
        """Only pieces that were asked for again stay, if these are less than half of what is allowed."""
        keep = self.used[self.slot]
        if keep.sum() > self.most // 2:
            keep[:] = False
        keys, old = self.keys[keep], self.slot[keep]
        size, lens = np.diff(self.text_at)[old], np.diff(self.ids_at)[old]
        text, ids = self.text[A.expand(self.text_at[old], size)], self.ids[A.expand(self.ids_at[old], lens)]
        self.clear()
        self.text, self.ids, self.n, self.used = text, ids, len(old), np.zeros(len(old), bool)
        self.text_at, self.ids_at = np.append(0, np.cumsum(size)), np.append(0, np.cumsum(lens))
        self.keys, self.slot = keys, np.arange(len(old))


def equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[at : at + size] and b[bt : bt + size] are the same, span by span."""
    differ = a[A.expand(at, size)] != b[A.expand(bt, size)]
    if not differ.any():
        return np.ones(len(size), bool)
    total = np.append(0, np.cumsum(differ))
    end = np.cumsum(size)
    return total[end] == total[end - size]


class Encoder:
    """Batch encoding: pieces of a slice are told apart by hash and bytes, each different one is merged once.

    ``by`` says what merges a piece: "transducer", or "tiktoken" for that library's code on the
    same vocabulary, which operators use that only need ids.
    """

    def __init__(self, path: str | None = None, by: str = "transducer"):
        tokens = load_ranks(path or default_tokenizer())
        if by == "transducer":
            self.merges = Merges(tokens)
            self.fst = Transducer(self.merges)
            self.merge = self.fst.encode
        elif by == "tiktoken":
            import tiktoken

            # a piece is one match of the pattern already
            one = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
            self.merge = lambda piece: one.encode_ordinary(piece.decode())
        else:
            raise ValueError(f"unknown encoder {by!r}")
        self.tokens = tokens
        self.dtype = np.uint16 if len(tokens) < 65_000 else np.int32
        self.known = Pieces(self.dtype, MAX_PIECES)

    def merged(self, data: bytes, start: np.ndarray, size: np.ndarray) -> list:
        gc.disable()  # nothing here has cycles, and a collection visits every state
        out = [self.merge(data[a:b]) for a, b in zip(start.tolist(), (start + size).tolist())]
        gc.enable()
        return out

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the texts' offsets. ``col``: from as_strings."""
        ids, ends, base = [], [np.zeros(1, np.int64)], 0
        for _, part in A.slices(col, SLICE):
            raw, off = A.string_parts(part)
            cps, char_off, at = A.codepoints(raw, off)
            begin = piece_bounds(cps, char_off)
            start = at[begin].astype(np.int64)
            size = np.diff(np.append(start, len(raw)))
            piece, lens = self.ids_of(raw, start, size)
            ids.append(piece)
            tok_end = np.concatenate(([0], np.cumsum(lens)))
            ends.append(tok_end[np.searchsorted(begin, char_off[1:])] + base)
            base += int(tok_end[-1])
        return (np.concatenate(ids) if ids else np.zeros(0, self.dtype)), np.concatenate(ends)

    def ids_of(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        if not len(start):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        u, first, code = np.unique(A.SpanHash(raw)(start, start + size), return_index=True, return_inverse=True)
        if not (size == size[first][code]).all() or not equal(raw, start, raw, start[first][code], size).all():  # two pieces have one hash
            got = self.merged(raw.tobytes(), start, size)
            return np.fromiter(chain.from_iterable(got), self.dtype), np.fromiter(map(len, got), np.int64, len(got))
        start, size = start[first], size[first]
        slot = self.known.find(u, raw, start, size)
        new = np.flatnonzero(slot < 0)
        k = self.known
        known_ids, at, lens = k.ids, k.ids_at[slot], np.diff(k.ids_at)[slot] if k.n else np.zeros(len(u), np.int64)
        if len(new):
            got = self.merged(raw.tobytes(), start[new], size[new])
            lens[new] = np.fromiter(map(len, got), np.int64, len(got))
            at[new] = len(known_ids) + np.cumsum(lens[new]) - lens[new]
            known_ids = np.concatenate([known_ids, np.fromiter(chain.from_iterable(got), self.dtype, int(lens[new].sum()))])
            k.add(u[new], raw, start[new], size[new], got)
        lens = lens[code]
        return known_ids[A.expand(at[code], lens)], lens


#: UTF-8 automaton. States: 0 between characters; 1-3 that many continuation bytes to come; 4-7 the
#: first continuation byte is restricted (after E0, ED, F0, F4); 8 malformed.
def _utf8_table() -> list[bytes]:
    rows = []
    for s in range(8):
        row = [8] * 256
        if s == 0:
            for b in range(0x80):
                row[b] = 0
            for b in range(0xC2, 0xE0):
                row[b] = 1
            for b in range(0xE1, 0xF0):
                row[b] = 2
            for b in range(0xF1, 0xF4):
                row[b] = 3
            row[0xE0], row[0xED], row[0xF0], row[0xF4] = 4, 5, 6, 7
        else:
            low, high, to = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}[s]
            for b in range(low, high + 1):
                row[b] = to
        rows.append(bytes(row))
    return rows


_UTF8 = _utf8_table()


class StreamDecoder:
    """Token ids to text, chunk by chunk: characters come out as soon as their last byte is there.

    Between chunks it holds the automaton's state and the bytes (three at most) of the open
    character. Malformed bytes give U+FFFD, one for each maximal part of a character.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.held, self.state = tokens, b"", 0

    def push(self, ids: Iterable[int]) -> str:
        return self.push_bytes(b"".join(map(self.tokens.__getitem__, ids)))

    def push_bytes(self, data: bytes) -> str:
        data = self.held + data
        # Only the end can be open: go back to the last byte that can begin a character, and run the automaton.
        cut, state = len(data), 0
        for k in range(1, min(3, len(data)) + 1):
            if data[-k] & 0xC0 != 0x80:
                for b in data[-k:]:
                    state = _UTF8[state][b]
                    if state in (0, 8):
                        break
                if state not in (0, 8):
                    cut = len(data) - k
                break
        self.held, self.state = data[cut:], state if cut < len(data) else 0
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        left, self.held, self.state = self.held, b"", 0
        return left.decode("utf-8", "replace")


def encoder(path: str | None = None, by: str = "transducer") -> Encoder:
    """This worker's encoder; kept between batches and tasks."""
    key = (path or default_tokenizer(), by)
    return kept(("encoder", *key), lambda: Encoder(*key))


def decode_all(enc: Encoder, ids: np.ndarray, off: np.ndarray, chunk: int = 1 << 14) -> list[str]:
    """Stream every text's ids through the decoder."""
    out, tokens = [], enc.tokens
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        d, parts = StreamDecoder(tokens), []
        for k in range(a, b, chunk):
            parts.append(d.push(ids[k : min(b, k + chunk)].tolist()))
        parts.append(d.finish())
        out.append(parts[0] + parts[1] if len(parts) == 2 else "".join(parts))
    return out


def encode_documents(df: DataFrame, text: str = "text", path: str | None = None, verify: bool = True, ids_col: str = "token_ids", n_col: str = "n_tokens", ok_col: str = "roundtrip") -> DataFrame:
    """All columns of ``df`` with ``token_ids``, ``n_tokens`` and, with ``verify``, ``roundtrip``.

    ``roundtrip`` says whether streaming decoding gives the text again. A null text has null
    in all three; an empty one has no ids. Input columns named like a result are replaced.
    Texts of any length are encoded whole. Narrow: no shuffle.
    """
    new = [ids_col, n_col] + [ok_col] * verify
    low = {c.lower() for c in new}
    keep = [c for c in df.columns if c.lower() not in low or c == text]
    src = df.select([df[f"`{c}`"] for c in keep])
    schema = T.StructType([*(f for f in src.schema.fields if f.name.lower() not in low), T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(n_col, T.IntegerType())] + [T.StructField(ok_col, T.BooleanType())] * verify)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            given = b.column(keep.index(text))
            for lo, part in A.slices(A.as_strings(given), SLICE):
                ids, off = enc.encode(part)
                null = np.asarray(given.slice(lo, len(part)).is_null())
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
                lists = pa.ListArray.from_buffers(lists.type, len(lists), [pa.array(~null).buffers()[1], lists.buffers()[1]], children=[lists.values])
                cols = [c for c, k in zip(b.slice(lo, len(part)).columns, keep) if k.lower() not in low]
                cols += [lists, pa.array(np.diff(off).astype(np.int32), mask=null)]
                if verify:
                    back = decode_all(enc, ids, off)
                    cols.append(pa.array(np.array([x == y for x, y in zip(back, part.to_pylist())], bool), mask=null))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
                del ids, off, lists, cols
                trim()

    return src.mapInArrow(run, schema)
