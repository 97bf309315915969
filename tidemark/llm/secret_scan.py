"""Secret spans: base patterns, and a linear-chain conditional random field.

1. Base spans come from three patterns and always stay.
2. Tokens are runs of letters, digits and ``+ / _ -``, and single other signs.
   A token is tagged as begin (B), inside (I) or outside (O) of a secret, from
   its shape, its neighbours' words and shapes, and features of the file.
3. The field is trained on a bounded sample of token windows, labelled by the
   values of the base spans, by full-batch gradient steps on the exact
   conditional likelihood (forward-backward over all windows at once).  The
   word of a token itself is no feature, so that values never seen are judged
   by how they look and where they stand.
4. Decoding is Viterbi over whole texts.  Where outside beats begin and inside
   by more than transitions can make up for, every best path is outside; the
   text is cut there and only what lies between is walked.
5. Tagged spans that touch no base span are added as kind ``field``.

Cases: null and empty texts have no token and no span; with no base span in
the sample nothing is tagged; texts are read whole, however long; ties in a
path go to outside, then begin; repeated rows get equal results; an empty
table gives an empty result; only the id and the text are read, so other
columns can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import Words, binary, hash_strings, lower_ascii, mix, slices, spans, strings

#: The base patterns, the group that has a least length, and that length: fixed values.
BASE = [
    ("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]
#: What a text must hold for a pattern to match; wider than the patterns, checked on whole batches.
MAY_MATCH = [r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", r"AKIA[A-Z0-9]{12}", r"[0-9a-f]{32}"]

OUT, BEGIN, INSIDE = 0, 1, 2
#: Places of a feature table; every feature is hashed into one of them.
DIMS = 1 << 14

#: Tasks that choose the training windows of one kind.
SALTS = 16

_RUN = np.zeros(256, dtype=bool)
_RUN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100), *b"+/_-"]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, begin, end, begin of the value) of the base spans, by begin, then in the order of ``BASE``."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(BASE):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, kind, m.end(), m.start(group)))
    return [(kind, begin, end, value) for begin, _, kind, end, value in sorted(found)]


def found_in(texts: pa.Array) -> dict[int, list[tuple[str, int, int, int]]]:
    """Base spans of the texts of an array that have any."""
    may = None
    for pattern in MAY_MATCH:
        hit = pc.match_substring_regex(texts, pattern)
        may = hit if may is None else pc.or_(may, hit)
    out = {}
    for row in np.flatnonzero(may.to_numpy(zero_copy_only=False)) if len(texts) else ():
        if got := base_spans(texts[int(row)].as_py()):
            out[int(row)] = got
    return out


class Tokens(Words):
    """Tokens of a slice of texts: runs of letters and digits, and single other signs."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        super().__init__(raw, offsets, _RUN)
        signs = np.flatnonzero(~_RUN[raw] & ~_BLANK[raw])
        start = np.concatenate([self.start, signs])
        order = np.argsort(start, kind="stable")
        self.start, self.end = start[order], np.concatenate([self.end, signs + 1])[order]
        self.mask = ~_BLANK[raw]
        self.first = np.searchsorted(self.start, offsets, side="left")
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))


def _count(table: np.ndarray, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.add.reduceat(table[raw].astype(np.int64), off[:-1])


def _table(*codes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for c in codes:
        out[c] = True
    return out


_DIGIT, _UPPER, _LOWER = _table(np.arange(0x30, 0x3A)), _table(np.arange(0x41, 0x5B)), _table(np.arange(0x61, 0x7B))
_HEX, _JOIN = _table(np.arange(0x30, 0x3A), np.arange(0x61, 0x67)), _table(list(b"+/_-"))


def token_features(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(own features, context features) of distinct tokens, as hashed places: a token's shape, and its word for its neighbours."""
    raw, off = spans(distinct)
    if not len(distinct):
        return np.empty((0, 5), np.int64), np.empty((0, 2), np.int64)
    size = np.diff(off)
    digits, upper, lower, hexes, joins = (_count(t, raw, off) for t in (_DIGIT, _UPPER, _LOWER, _HEX, _JOIN))
    kind = np.where(_DIGIT[raw], 1, np.where(_UPPER[raw], 2, np.where(_LOWER[raw], 3, 0)))
    inner = np.ones(len(raw), dtype=bool)
    inner[off[:-1]] = False
    change = np.zeros(len(raw), dtype=np.int64)
    change[1:] = kind[1:] != kind[:-1]
    changes = np.minimum(np.add.reduceat(change * inner, off[:-1]), 15)
    long = np.searchsorted([2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64], size, side="right")
    share = lambda n: np.minimum(4 * n // np.maximum(size, 1), 4)
    classes = (digits > 0) * 1 + (upper > 0) * 2 + (lower > 0) * 4 + (joins > 0) * 8 + (hexes == size) * 16 + ((digits + upper) == size) * 32
    capital = (upper == 1) & _UPPER[raw[off[:-1]]]
    shape = classes * 2 + capital
    sign = np.where(size == 1, raw[off[:-1]], 0)
    own = [shape * 16 + long, changes * 32 + share(digits) * 5 + 1 + (digits > 0), long * 16 + changes, shape * 16 + changes, sign.astype(np.int64)]
    lowered = pc.binary_length(distinct)  # words keep their sizes when lowered
    word = hash_strings(binary(lower_ascii(raw), lowered.to_numpy(zero_copy_only=False))).astype(np.int64) & 0x7FFFFFFF
    # Words of long or numbered tokens are rare: their shape stands for them.
    context = np.where((size <= 16) & (digits == 0), word, shape * 16 + long)
    return np.stack(own, axis=1).astype(np.int64), np.stack([context, shape * 16 + long], axis=1).astype(np.int64)


#: Neighbours whose words and shapes are features.
AROUND = (-3, -2, -1, 1, 2)


def _place(field: int, value: np.ndarray) -> np.ndarray:
    return (mix(value.astype(np.uint64) + (np.uint64(field + 1) << np.uint64(40))) >> np.uint64(50)).astype(np.int64)


def file_features(tokens: Tokens) -> np.ndarray:
    """Two features of each text: its share of digits, and of signs."""
    n = np.maximum(np.diff(tokens.offsets), 1)
    share = lambda table: np.diff(np.r_[0, np.cumsum(table[tokens.raw])][tokens.offsets]) / n
    return np.stack([np.searchsorted([0.002, 0.01, 0.05, 0.2], share(t)) for t in (_DIGIT, ~_RUN & ~_BLANK)], axis=1)


#: Value of a neighbour beyond the text's ends.
_NONE = np.array([0x7FFFFFFF])


class Features:
    """Feature places of the tokens of a slice, held once per distinct token."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.ids, distinct = tokens.ids()
        own, context = token_features(distinct)
        fields = lambda first, x: np.stack([_place(first + f, x[:, f]) for f in range(x.shape[1])], axis=1)
        self.own = fields(0, own)
        # The last row stands for a neighbour beyond the text.
        context = np.vstack([context, np.repeat(_NONE, context.shape[1])])
        self.around = [fields(16 + 2 * k, context) for k in range(len(AROUND))]
        self.file = fields(40, file_features(tokens))

    def _neighbours(self, at: np.ndarray, d: int) -> np.ndarray:
        """Distinct token ``d`` places after each token ``at``, within its text."""
        doc, first = self.tokens.doc[at], self.tokens.first
        to = at + d
        there = (to >= first[doc]) & (to < first[doc + 1])
        return np.where(there, self.ids[np.where(there, to, at)], len(self.own))

    def places(self, at: np.ndarray) -> np.ndarray:
        """The places of the tokens ``at``, a row each."""
        return np.hstack([self.own[self.ids[at]], *(x[self._neighbours(at, d)] for d, x in zip(AROUND, self.around)), self.file[self.tokens.doc[at]]]).astype(np.uint16)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Score of each tag for every token, less that of outside."""
        total = lambda places: (weights[places].sum(axis=1) - weights[places, :1].sum(axis=1)).astype(np.float32)
        at = np.arange(len(self.tokens))
        out = total(self.own)[self.ids] + total(self.file)[self.tokens.doc]
        for d, x in zip(AROUND, self.around):
            out += total(x)[self._neighbours(at, d)]
        return out


@dataclass
class Field:
    """Weights of a fitted field: feature place x tag, and tag x next tag."""

    weights: np.ndarray
    moves: np.ndarray


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(unary: np.ndarray, moves: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(tag probabilities, summed move probabilities, summed log normaliser) of padded windows (window, place, tag)."""
    n, t, _ = unary.shape
    ahead, back = np.zeros((n, t, 3)), np.zeros((n, t, 3))
    ahead[:, 0] = unary[:, 0]
    for i in range(1, t):
        step = log_sum(ahead[:, i - 1, :, None] + moves, 1) + unary[:, i]
        ahead[:, i] = np.where(mask[:, i, None], step, ahead[:, i - 1])
    for i in range(t - 2, -1, -1):
        step = log_sum(moves + (unary[:, i + 1] + back[:, i + 1])[:, None, :], 2)
        back[:, i] = np.where(mask[:, i + 1, None], step, 0.0)
    norm = log_sum(ahead[:, -1], 1)
    tags = np.exp(ahead + back - norm[:, None, None]) * mask[:, :, None]
    total = np.zeros((3, 3))
    for i in range(t - 1):
        pair = ahead[:, i, :, None] + moves + (unary[:, i + 1] + back[:, i + 1])[:, None, :] - norm[:, None, None]
        total += (np.exp(pair) * mask[:, i + 1, None, None]).sum(axis=0)
    return tags, total, float(norm.sum())


def fit_field(places: np.ndarray, tags: np.ndarray, mask: np.ndarray, steps: int = 150, l2: float = 0.1) -> Field:
    """Weights of the largest penalised likelihood of the tags of padded windows.

    Accelerated gradient steps from zero, each weight's step scaled by how often its feature occurs.
    """
    n, t, k = places.shape
    flat, on = places[mask], mask.reshape(-1)
    hot = np.eye(3)[tags][mask]
    both = mask[:, 1:] & mask[:, :-1]
    real = np.zeros((3, 3))
    np.add.at(real, (tags[:, :-1][both], tags[:, 1:][both]), 1.0)
    often = np.bincount(flat.reshape(-1), minlength=DIMS).astype(float)[:, None]
    # A token has k features and two moves; half bounds the curvature of a tag's share.
    step_w, step_m = 1.0 / (0.5 * (k + 2) * often + l2), 1.0 / (0.5 * (k + 2) * max(int(both.sum()), 1) / 3 + l2)
    w, moves = np.zeros((DIMS, 3)), np.zeros((3, 3))
    last_w, last_m = w, moves
    for i in range(steps):
        go = i / (i + 3)
        at_w, at_m = w + go * (w - last_w), moves + go * (moves - last_m)
        unary = np.zeros((n * t, 3))
        unary[on] = at_w[flat].sum(axis=1)
        probability, pairs, _ = marginals(unary.reshape(n, t, 3), at_m, mask)
        rest = hot - probability[mask]
        g = np.stack([np.bincount(flat.reshape(-1), np.repeat(rest[:, c], k), DIMS) for c in range(3)], axis=1)
        last_w, last_m = w, moves
        w = at_w + step_w * (g - l2 * at_w)
        moves = at_m + step_m * (real - pairs - l2 * at_m)
    return Field(w, moves)


def viterbi(unary: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best tags of every sequence ``first[i]:first[i + 1]`` of tokens."""
    tags = np.zeros(len(unary), np.int8)
    if not len(unary):
        return tags
    # Another tag in place of outside changes at most the moves around it.
    slack = 2 * (moves.max() - moves.min())
    open_ = (unary[:, 1:] - unary[:, :1]).max(axis=1) >= -slack
    # Open stretches, cut at ends of sequences; outside stands before and after inner ones.
    begins_doc = np.zeros(len(unary) + 1, dtype=bool)
    begins_doc[first] = True
    start = np.flatnonzero(open_ & (np.r_[True, ~open_[:-1]] | begins_doc[:-1]))
    stop = np.flatnonzero(open_ & (np.r_[~open_[1:], True] | begins_doc[1:])) + 1
    for s, e in zip(start.tolist(), stop.tolist()):
        score = unary[s] + (0.0 if begins_doc[s] else moves[OUT])
        came = np.zeros((e - s, 3), np.int8)
        for i in range(s + 1, e):
            step = score[:, None] + moves
            came[i - s] = step.argmax(axis=0)
            score = step.max(axis=0) + unary[i]
        tag = int((score + (0.0 if begins_doc[e] else moves[:, OUT])).argmax())
        for i in range(e - 1, s - 1, -1):
            tags[i] = tag
            tag = int(came[i - s, tag])
    return tags


def tagged_spans(tags: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first token, last token) of the tagged spans; an inside tag after none begins one."""
    at = np.flatnonzero(tags != OUT)
    if not len(at):
        return
    new = np.r_[True, (np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]]) | (tags[at[1:]] == BEGIN)]
    firsts = np.flatnonzero(new)
    for a, b in zip(firsts.tolist(), np.r_[firsts[1:], len(at)].tolist()):
        yield int(at[a]), int(at[b - 1])


def _in_points(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points before each byte place of one text."""
    return np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][at]


def label_tokens(tokens: Tokens, found: dict[int, list[tuple[str, int, int, int]]]) -> np.ndarray:
    """B, I and O of the tokens by the values of the base spans."""
    tags = np.zeros(len(tokens), np.int8)
    for row, got in found.items():
        a, b = int(tokens.first[row]), int(tokens.first[row + 1])
        lo = int(tokens.offsets[row])
        raw = tokens.raw[lo : int(tokens.offsets[row + 1])]
        begin, end = (_in_points(raw, x[a:b] - lo) for x in (tokens.start, tokens.end))
        for _, _, stop, value in got:
            inside = np.flatnonzero((begin < stop) & (end > value)) + a
            tags[inside] = np.where(tags[inside] == OUT, INSIDE, tags[inside])
            if len(inside):
                tags[inside[0]] = BEGIN
    return tags


def training_windows(df: DataFrame, train: Column | None, rows: int, window: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, tags, mask) of at most ``rows`` windows with a secret and as many without, chosen by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(strings(batch.column(1))):
                tokens = Tokens(*spans(part))
                if not len(tokens):
                    continue
                tags = label_tokens(tokens, found_in(part))
                # Windows begin anew with each text; features look beyond their ends.
                inside = np.arange(len(tokens)) - tokens.first[tokens.doc]
                at = np.flatnonzero(inside % window == 0)
                end = np.minimum(np.r_[at[1:], len(tokens)], tokens.first[1:][tokens.doc[at]])
                secret = np.add.reduceat(tags != OUT, at) > 0
                h = mix(tokens.hashes())
                chance = mix(np.add.reduceat(h, at) + np.diff(np.r_[at, len(tokens)]).astype(np.uint64))
                # Most windows have no secret: one in 64 of them stands for all, by its hash.
                keep = np.flatnonzero(secret | (chance % np.uint64(64) == 0))
                if not len(keep):
                    continue
                features = Features(tokens)
                places = [features.places(np.arange(at[i], end[i])).tobytes() for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((chance[keep] >> np.uint64(1)).astype(np.int64)), pa.array(secret[keep]),
                        pa.array(places, pa.binary()), pa.array([tags[at[i] : end[i]].tobytes() for i in keep], pa.binary()),
                    ],
                    names=["chance", "secret", "places", "tags"],
                )

    texts = df.where(train) if train is not None else df
    found = texts.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "chance bigint, secret boolean, places binary, tags binary")
    # Equal windows of copies count once, and the smallest hashes of either kind stay.
    found = found.groupBy("chance", "secret").agg(F.min("places").alias("places"), F.min("tags").alias("tags"))
    # The low bits of the chances of windows without a secret are all zero.
    few = found.withColumn("salt", F.pmod(F.xxhash64("chance"), F.lit(SALTS)))
    # First windows of each salt, then of the kind: the last task of a kind reads SALTS * rows at most.
    for keys in (["secret", "salt"], ["secret"]):
        few = few.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("chance"))).where(F.col("rank") <= rows)
    got = sorted(few.select("secret", "chance", "places", "tags").collect())
    if not any(r.secret for r in got):
        got = []
    longest = max((len(r.tags) for r in got), default=0)
    width = len(got[0].places) // 2 // len(got[0].tags) if got else 0
    places, tags, mask = np.zeros((len(got), longest, width), np.int32), np.zeros((len(got), longest), np.int64), np.zeros((len(got), longest), dtype=bool)
    for i, r in enumerate(got):
        n = len(r.tags)
        places[i, :n] = np.frombuffer(r.places, np.uint16).reshape(n, width)
        tags[i, :n], mask[i, :n] = np.frombuffer(r.tags, np.int8), True
    return places, tags, mask


def fit_secrets(
    df: DataFrame, train: Column | None = None, sample_windows: int = 800, window: int = 24, steps: int = 150, id_col: str = "doc_id", text_col: str = "text"
) -> Field | None:
    """The field, fitted on at most twice ``sample_windows`` windows; none when no sampled window has a secret."""
    places, tags, mask = training_windows(df, train, sample_windows, window, id_col, text_col)
    return fit_field(places, tags, mask, steps) if len(places) else None


def tag_texts(texts: pa.Array, field: Field | None, found: dict[int, list[tuple[str, int, int, int]]]) -> dict[int, list[tuple[int, int]]]:
    """(begin, end) in code points of the tagged spans of a slice that touch no base span, by text."""
    out: dict[int, list[tuple[int, int]]] = {}
    if field is None:
        return out
    tokens = Tokens(*spans(texts))
    if not len(tokens):
        return out
    tags = viterbi(Features(tokens).scores(field.weights), field.moves, tokens.first)
    for a, b in tagged_spans(tags, tokens.doc):
        row = int(tokens.doc[a])
        lo = int(tokens.offsets[row])
        begin, end = _in_points(tokens.raw[lo : int(tokens.end[b])], np.array([tokens.start[a] - lo, tokens.end[b] - lo])).tolist()
        if all(end <= s or begin >= e for _, s, e, _ in found.get(row, [])):
            out.setdefault(row, []).append((begin, end))
    return out


def scan(df: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``found``: the spans (kind, begin, end) of every text by begin; code points, end exclusive."""
    shared = df.sparkSession.sparkContext.broadcast(field)
    span = pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(strings(batch.column(1))):
                found = found_in(part)
                more = tag_texts(part, shared.value, found)
                rows: list[list[dict]] = [[] for _ in range(len(part))]
                for row in found.keys() | more.keys():
                    own = [{"kind": k, "begin": b, "end": e} for k, b, e, _ in found.get(row, [])] + [{"kind": "field", "begin": b, "end": e} for b, e in more.get(row, [])]
                    rows[row] = sorted(own, key=lambda s: s["begin"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(rows, pa.list_(span))], names=[id_col, "found"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, found array<struct<kind:string,begin:bigint,end:bigint>>")


def joined(found: Column) -> Column:
    """``kind:begin:end`` of spans, parted by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def digests(df: DataFrame, field: Field | None, id_col: str = "doc_id") -> DataFrame:
    """id, counts of the base kinds, the digest of the base spans, and all spans."""
    rows = scan(df, field, id_col)
    of = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    base = of(*(kind for kind, *_ in BASE))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind, *_ in BASE]
    return rows.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def digest_of(spans_: list[tuple[str, int, int]]) -> str:
    """The digest of base spans, as the query gives it."""
    return hashlib.sha256(",".join(f"{k}:{b}:{e}" for k, b, e in spans_).encode()).hexdigest()
