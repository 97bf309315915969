"""SentencePiece BPE with byte fallback as vectorised merge rounds.

The model file gives pieces and scores.  A text is cut into words before
every run of blanks (no piece has a blank after another character, which is
checked on load, so no merge can cross such a cut).  All distinct words of a
slice are encoded together on flat arrays: each round looks up the rank of
every adjacent pair, takes the smallest rank per word by a segmented minimum,
merges its occurrences from the left without overlap, and compacts, until no
pair remains.

The library merges one pair at a time, best score first, leftmost on ties.
A round does the same as long as no merge of the round makes a pair of equal
or better rank; words where one does are redone by a heap, one merge at a
time, so ids are exact for every text.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from sentencepiece import sentencepiece_model_pb2 as spm

from .text import binary, spans

BLANK = "▁"
_NONE = np.iinfo(np.int32).max
NORMAL, BYTE = 1, 6

#: Words kept encoded between slices of a task.
CACHE_WORDS = 500_000


class PieceModel:
    """Piece tables of a ``.model`` file."""

    def __init__(self, blob: bytes):
        proto = spm.ModelProto.FromString(blob)
        norm = proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if (
            proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or norm.precompiled_charsmap
            or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces
            or proto.trainer_spec.treat_whitespace_as_suffix or kinds - {1, 2, 3, 6}
        ):
            raise ValueError("only BPE models with byte fallback, identity normalisation and a blank prefix are read")
        self.pieces = [p.piece.replace(BLANK, " ") for p in proto.pieces]
        normal = {p: i for i, p in enumerate(self.pieces) if proto.pieces[i].type == NORMAL}
        if any(" " in p.lstrip(" ") for p in normal):
            raise ValueError("a piece has a blank after another character")
        self.byte_id = np.zeros(256, np.int32)
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.byte_id[int(p.piece[3:-1], 16)] = i
        self.end_id = next(i for i, p in enumerate(proto.pieces) if p.piece == "</s>")
        # Symbols are piece ids; a character that is no piece but starts or ends one gets an id above them.
        self.symbol = dict(normal)
        for p in normal:
            for c in p:
                self.symbol.setdefault(c, len(self.pieces) + len(self.symbol))
        self.n_symbols = max(self.symbol.values(), default=0) + 2
        self.other = self.n_symbols - 1  # any other character: it joins no pair
        scores = sorted({-proto.pieces[i].score for i in normal.values()})
        order = {s: k for k, s in enumerate(scores)}
        keys, made, rank = [], [], []
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.n_symbols + b)
                    made.append(i)
                    rank.append(order[-proto.pieces[i].score])
        self._table(np.array(keys, np.int64), np.array(made, np.int32), np.array(rank, np.int32))
        self.char = np.full(0x110000, self.other, np.int32)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        # What a piece decodes to, as bytes; a byte piece is one raw byte.
        texts = [bytes([int(p.piece[3:-1], 16)]) if p.type == BYTE else b"" if p.type == 3 else self.pieces[i].encode() for i, p in enumerate(proto.pieces)]
        self.surface = texts

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _table(self, keys: np.ndarray, made: np.ndarray, rank: np.ndarray) -> None:
        """Pair table with linear probing; ``probes`` is its longest chain."""
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.made, self.rank = np.full((1 << bits) + 64, -1, np.int64), np.zeros((1 << bits) + 64, np.int32), np.full((1 << bits) + 64, _NONE, np.int32)
        left, at, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(left):
            free = np.flatnonzero(self.keys[at] == -1)
            _, one = np.unique(at[free], return_index=True)
            one = free[one]
            self.keys[at[one]], self.made[at[one]], self.rank[at[one]] = keys[left[one]], made[left[one]], rank[left[one]]
            rest = np.setdiff1d(np.arange(len(left)), one)
            left, at, self.probes = left[rest], at[rest] + 1, self.probes + 1

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of symbol pairs; rank ``_NONE`` where they don't merge."""
        key = left.astype(np.int64) * self.n_symbols + right
        at = self._slot(key)
        open_ = np.flatnonzero(self.keys[at] != key)
        for _ in range(self.probes):
            open_ = open_[self.keys[at[open_]] != -1]
            if not len(open_):
                break
            at[open_] += 1
            open_ = open_[self.keys[at[open_]] != key[open_]]
        return np.where(self.keys[at] == key, self.rank[at], _NONE), self.made[at]

    def encode_words(self, joined: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per word) of words given as one string and their lengths."""
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int32)
        word = np.repeat(np.arange(len(lengths)), lengths)
        sym, word, cps = self._merge(self.char[cps], word, cps, len(lengths))
        # A character that is no piece becomes its UTF-8 bytes.
        raw = sym >= len(self.pieces)
        if raw.any():
            each = np.ones(len(sym), np.int64)
            parts = [chr(c).encode() for c in cps[raw].tolist()]
            each[raw] = [len(p) for p in parts]
            out = np.repeat(sym, each)
            out[np.repeat(raw, each)] = self.byte_id[np.frombuffer(b"".join(parts), np.uint8)]
            sym, word = out, np.repeat(word, each)
        return sym.astype(np.int32), np.bincount(word, minlength=len(lengths))

    def _merge(self, sym: np.ndarray, word: np.ndarray, cps: np.ndarray, n_words: int) -> tuple[np.ndarray, ...]:
        done, odd = [], []
        first = np.searchsorted(word, np.arange(n_words + 1))
        whole = cps
        before = np.full(n_words, -1, np.int64)  # rank of the last merge of each word
        rank, made = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int32)
        fresh = np.ones(len(sym), dtype=bool)  # symbols whose pair with the next one is new
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            look = np.flatnonzero(fresh[:-1] & (word[1:] == word[:-1]))
            rank[fresh] = _NONE
            rank[look], made[look] = self.pair(sym[look], sym[look + 1])
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(sym)])
            own = word[starts]
            wrong = (best != _NONE) & (best <= before[own])
            best_of = np.repeat(best, size)
            at = (rank == best_of) & (rank != _NONE)
            # Leftmost first without overlap: every second one of a run of neighbours.
            pos = np.arange(len(sym))
            run = np.maximum.accumulate(np.where(at & ~np.r_[False, at[:-1]], pos, -1))
            take = at & ((pos - run) % 2 == 0)
            # Between two merges that touch, the first one's symbol stands beside the second's left part.
            touch = np.flatnonzero(take[:-2] & take[2:]) if len(sym) > 2 else np.empty(0, np.int64)
            if len(touch):
                between, _ = self.pair(made[touch], sym[touch + 2])
                bad = touch[(between <= rank[touch]) & (word[touch] == word[touch + 2])]
                wrong[np.searchsorted(starts, bad, side="right") - 1] = True
            before[own] = best
            odd.extend(own[wrong].tolist())
            ended = np.repeat((best == _NONE) & ~wrong, size)
            if ended.any():
                done.append((sym[ended], word[ended], cps[ended]))
            sym = np.where(take, made, sym)
            fresh = take.copy()
            fresh[:-2] |= take[2:]  # symbol before a merge, itself merged away or not
            fresh[:-1] |= take[1:]
            keep = ~np.r_[False, take[:-1]] & ~ended & ~np.repeat(wrong, size)
            sym, word, cps, rank, made, fresh = (x[keep] for x in (sym, word, cps, rank, made, fresh))
        for w in odd:
            s, c = self._one_by_one(whole[first[w] : first[w + 1]])
            done.append((s, np.full(len(s), w), c))
        if not done:
            return sym, word, cps
        sym, word, cps = (np.concatenate(x) for x in zip(*done))
        by = np.argsort(word, kind="stable")
        return sym[by], word[by], cps[by]

    def _one_by_one(self, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word merged pair by pair from a heap: best rank first, leftmost on ties."""
        sym = self.char[cps].tolist()
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        rank, made = self.pair(np.array(sym[:-1], np.int64), np.array(sym[1:], np.int64))
        heap = [(r, i, i + 1, m, sym[i], sym[i + 1]) for i, (r, m) in enumerate(zip(rank.tolist(), made.tolist())) if r != _NONE]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            if i < 0 or j >= len(sym):
                return
            r, m = self.pair(np.array([sym[i]]), np.array([sym[j]]))
            if r[0] != _NONE:
                heapq.heappush(heap, (int(r[0]), i, j, int(m[0]), sym[i], sym[j]))

        while heap:
            _, i, j, m, a, b = heapq.heappop(heap)
            if sym[i] != a or nxt[i] != j or sym[j] != b:
                continue
            sym[i], sym[j] = m, -1
            nxt[i] = nxt[j]
            if nxt[j] < len(sym):
                prv[nxt[j]] = i
            push(prv[i], i)
            push(i, nxt[i])
        keep = [i for i, s in enumerate(sym) if s >= 0]
        return np.array([sym[i] for i in keep], np.int32), cps[keep]


class Codec:
    """Encodes and decodes slices of texts; keeps encoded words between slices."""

    def __init__(self, model: PieceModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.begin = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _words(self, distinct: pa.Array) -> np.ndarray:
        """Place of each distinct word: its ids are ``flat[begin[p]:begin[p + 1]]``."""
        words = distinct.to_pylist()
        if len(self.known) + len(words) > CACHE_WORDS:
            self._forget()
        new = [w for w in words if w not in self.known]
        if new:
            flat, each = self.model.encode_words(b"".join(new).decode(), pc.utf8_length(pa.array(new, pa.string())).to_numpy())
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.begin = np.r_[self.begin, self.begin[-1] + np.cumsum(each)]
            self.flat = np.r_[self.flat, flat]
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids with an end id after each text, offsets) of a string array."""
        raw, offsets, cut, first = self._cut(texts)
        if len(cut) == 0:
            return np.full(len(texts), self.model.end_id, np.int32), np.arange(len(texts) + 1)
        ends = np.r_[cut[1:], len(raw)]
        coded = binary(raw, ends - cut).dictionary_encode()
        place = self._words(coded.dictionary)
        at = place[coded.indices.to_numpy(zero_copy_only=False)]
        flat, begin = self.flat, self.begin[at]
        size = self.begin[at + 1] - begin
        # Lay the words out in order, one free place after each text for the end id.
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        n = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.bincount(doc, size, len(texts)).astype(np.int64) + 1, out=n[1:])
        out = np.full(n[-1], self.model.end_id, np.int32)
        ahead = np.cumsum(size) - size
        step = np.arange(int(size.sum()))
        out[np.repeat(doc, size) + step] = flat[np.repeat(begin - ahead, size) + step]
        return out, n

    @staticmethod
    def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with the blank prefix, text offsets, word starts, first word of each text."""
        texts = pc.replace_substring(texts, BLANK, " ")
        filled = pc.greater(pc.binary_length(texts), 0)
        raw, offsets = spans(pc.if_else(filled, pc.binary_join_element_wise(" ", texts, ""), ""))
        blank = raw == 0x20
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        cut = np.flatnonzero(begins)
        return raw, offsets, cut, np.searchsorted(cut, offsets, side="left")

    def decode(self, ids: np.ndarray) -> str:
        """The text of one id list: byte pieces joined to UTF-8, the blank prefix dropped."""
        surface = self.model.surface
        raw = b"".join([surface[i] for i in ids.tolist()])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")
