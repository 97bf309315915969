"""Phrase collocations by prefix-free parsing.

1. Parsing.  A window of ``max_words - 1`` words slides over each text; where
   its hash is a multiple of ``modulus`` a chunk ends and the next one begins,
   and the window belongs to both.  Equal passages are cut alike wherever they
   stand, so copies end up as equal chunks.  No chunk is a prefix of another
   but the last ones of texts.
2. Dictionary.  Equal chunks of a language are one row with their parse
   frequency.  A chunk owns its words up to the next chunk's beginning: an
   n-gram is counted in the chunk that owns its first word, so the overlap is
   counted once, and every n-gram lies whole in that chunk.
3. Counts.  N-grams are counted inside distinct chunks only, times the parse
   frequency, one length after the other.  Every part of a phrase is at least
   as frequent as the phrase, so grams below the least count are left out at
   once, and longer grams are counted only where both their parts may be
   frequent.
4. Scores.  For every cut of a phrase into two parts the share of its squared
   count in the product of theirs; the lowest cut counts.  Phrases that mostly
   occur inside a longer one are dropped.

Scale: chunks and grams are spread by their content, partly summed before the
shuffle.  A frequent word meets the phrases that it begins or ends in
``SALTS`` tasks.  Lists are cut to their first rows before languages meet.
Frequent grams reach the tasks as a bitmap of ``FILTER_BITS`` bits whatever
their number: a bit set by another gram lets some grams be counted in vain,
none is lost.

Cases: a null text is empty; a null language is ``und``; punctuation and line
ends part pieces, words are everything else between blanks and tabs, so signs
and numbers are words; texts are read whole, a text without a trigger is one
chunk; ties go by count, then by the phrase's bytes; repeated rows count
again; an empty table gives no row; only the text and the language are read,
so other columns can't clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import cut_lineage, remove_scratch, scratch_path

from .text import Words, hash_strings, lower_ascii, mix, slices, spans, strings

#: Bytes that part pieces, and bytes of words: fixed values.
PARTS = np.zeros(256, dtype=bool)
PARTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD_BYTES = ~PARTS
WORD_BYTES[[0x20, 0x09]] = False

#: Bytes of chunks whose n-grams are counted together inside a task.
COUNT_BYTES = 4 << 20

#: Bits of the filter of frequent grams; bounds what tasks are sent (8 MB).
FILTER_BITS = 1 << 26

#: Tasks that share the phrases of one part.
SALTS = 8


def parse(texts: pa.Array, overlap: int, modulus: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(text, chunk, words it owns) of the chunks of a slice of texts.

    Words of a chunk are parted by a blank, or by a line end where a piece ends.
    """
    raw, offsets = spans(texts)
    raw = lower_ascii(raw)
    words = Words(raw, offsets, WORD_BYTES)
    n = len(words)
    if not n:
        return np.empty(0, np.int64), pa.array([], pa.string()), np.empty(0, np.int64)
    piece = np.cumsum(PARTS[raw])[words.start]
    same = words.doc[1:] == words.doc[:-1]
    goes_on = np.r_[same & (piece[1:] == piece[:-1]), False]

    # A window whose hash is a multiple of the modulus begins a chunk.
    h, rolled = words.hashes(), np.zeros(max(n - overlap + 1, 0), np.uint64)
    for k in range(overlap):
        rolled = (rolled + h[k : k + len(rolled)]) * np.uint64(0x9E3779B97F4A7C15)
    last = words.first[1:][words.doc]
    at = np.arange(len(rolled))
    trigger = (mix(rolled) % np.uint64(modulus) == 0) & (at + overlap <= last[: len(rolled)])
    begins = np.zeros(n, dtype=bool)
    begins[words.first[:-1][np.diff(words.first) > 0]] = True
    begins[at[trigger]] = True
    begin = np.flatnonzero(begins)
    doc = words.doc[begin]
    stop = np.minimum(np.r_[begin[1:], n], last[begin])
    own, end = stop - begin, np.minimum(stop + overlap, last[begin])

    # All words with one parting byte each; a chunk is a range of these bytes.
    size = words.end - words.start
    place = np.r_[0, np.cumsum(size + 1)]
    flat = np.empty(int(place[-1]), np.uint8)
    flat[np.arange(int(size.sum())) + np.repeat(np.arange(n), size)] = raw[words.mask]
    flat[place[1:] - 1] = np.where(goes_on, 0x20, 0x0A)
    length = place[end] - 1 - place[begin]
    out = np.r_[0, np.cumsum(length)]
    data = flat[np.arange(int(out[-1])) + np.repeat(place[begin] - out[:-1], length)]
    chunk = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(out.astype(np.int32)), pa.py_buffer(data)])
    return doc, chunk, own


def dictionary(df: DataFrame, overlap: int, modulus: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, chunk, own, n): the distinct chunks with their parse frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(strings(batch.column(1))):
                doc, chunk, own = parse(part, overlap, modulus)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + first)), chunk, pa.array(own.astype(np.int32))], names=["lang", "chunk", "own"])

    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "lang string, chunk string, own int").groupBy("lang", "chunk", "own").agg(F.count("*").alias("n"))


def _sums(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first of each key, its summed weight), exact in 64 bits."""
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
    return order[new], np.add.reduceat(weight[order], new)


class GramFilter:
    """A bitmap of frequent grams; it may take others for frequent, never the reverse."""

    def __init__(self, slots: np.ndarray, bits: np.ndarray, size: int):
        self.bits = np.zeros(size >> 6, np.uint64)
        self.bits[slots] = bits.view(np.uint64)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h % np.uint64(len(self.bits) << 6)
        return self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1


def gram_hashes(lang: np.ndarray, words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the grams of ``k`` words at the places ``at``, from hashes of their languages and of all words."""
    h = lang.copy()
    for i in range(k):
        h = (h + words[at + i]) * np.uint64(0x9E3779B97F4A7C15)
    return mix(h)


def gram_filter(counts: DataFrame, k: int, size: int = FILTER_BITS) -> GramFilter:
    """The filter of the grams of ``k`` words in ``counts``; at most ``size`` / 64 short rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(*spans(strings(batch.column(1))), WORD_BYTES)
            at = (hash_strings(strings(batch.column(0)).cast(pa.binary())), words.hashes(), words.first[:-1])
            bit = gram_hashes(*at, k) % np.uint64(size)
            mask = np.uint64(1) << (bit & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int32)), pa.array(mask.view(np.int64))], names=["slot", "bits"])

    own = counts.where((F.col("gram") != "") & (F.size(F.split("gram", " ", -1)) == k)).select("lang", "gram")
    slots = own.mapInArrow(run, "slot int, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    return GramFilter(slots["slot"].to_numpy(), slots["bits"].to_numpy(), size)


def count_grams(lang: pa.Array, chunks: pa.Array, own: np.ndarray, often: np.ndarray, k: int, known: GramFilter | None = None) -> Iterator[pa.RecordBatch]:
    """(lang, gram, f) of the grams of ``k`` words that the chunks own, both of whose parts are ``known``.

    With ``k`` = 1 the empty gram counts all words.
    """
    raw, offsets = spans(chunks)
    words = Words(raw, offsets, WORD_BYTES)
    ids, distinct = words.ids()
    coded = lang.dictionary_encode()
    langs, lang_of = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if k == 1:
        at, total = _sums(lang_of, own * often)
        yield _grams(langs.take(pa.array(lang_of[at])), pa.array([""] * len(at), pa.string()), total)
    at = np.flatnonzero(np.arange(len(words)) - words.first[words.doc] < own[words.doc])
    if k > 1:
        # goes_on[i]: word i + 1 follows word i in its piece.
        goes_on = np.zeros(len(words), dtype=bool)
        inner = np.flatnonzero(words.doc[1:] == words.doc[:-1])
        goes_on[inner] = raw[words.end[inner]] == 0x20
        for i in range(k - 1):
            at = at[goes_on[at + i]]
    if known is not None and len(at):
        h, h_lang = hash_strings(distinct)[ids], hash_strings(langs.cast(pa.binary()))[lang_of][words.doc]
        for i in (0, 1):
            at = at[known.has(gram_hashes(h_lang[at], h, at + i, k - 1))]
    # ``key`` names a gram: its rank among those of its length, language included.
    key = lang_of[words.doc[at]]
    for i in range(k):
        key = key * max(len(distinct), 1) + ids[at + i]
        if i < k - 1:
            key = np.unique(key, return_inverse=True)[1]
    first, f = _sums(key, often[words.doc[at]])
    where = at[first]
    parts = [distinct.take(pa.array(ids[where + i])) for i in range(k)]
    gram = pc.binary_join_element_wise(*parts, b" ") if k > 1 else parts[0]
    yield _grams(langs.take(pa.array(lang_of[words.doc[where]])), gram.cast(pa.string()), f)


def _grams(lang: pa.Array, gram: pa.Array, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, gram, pa.array(f.astype(np.int64))], names=["lang", "gram", "f"])


def gram_counts(chunks: DataFrame, k: int, least: int, known: GramFilter | None = None) -> DataFrame:
    """(lang, gram, f) of the grams of ``k`` words with f >= ``least``; with ``k`` = 1 also of the empty gram."""
    shared = chunks.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            lang, chunk, own, n = (table.column(c).combine_chunks() for c in range(4))
            yield from count_grams(lang, chunk, own.to_numpy().astype(np.int64), n.to_numpy(), k, shared.value)

    found = chunks.select("lang", "chunk", "own", "n").mapInArrow(run, "lang string, gram string, f bigint")
    return found.groupBy("lang", "gram").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("gram") == ""))


def all_counts(chunks: DataFrame, max_words: int, least: int, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, gram, f) of the grams of 1 to ``max_words`` words with f >= ``least``, and of the empty gram."""
    out = level = cut_lineage(gram_counts(chunks, 1, least))
    for k in range(2, max_words + 1):
        level = cut_lineage(gram_counts(chunks, k, least, gram_filter(level, k - 1, filter_bits)))
        out = out.unionByName(level)
    return out


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined up to ``COUNT_BYTES``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= COUNT_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _slices(words: Column, n: Column, length: int, max_words: int) -> list[Column]:
    """The phrases of ``length`` words inside a longer one; null where it ends before."""
    return [F.when((n > length) & (n >= i + length), F.concat_ws(" ", F.slice(words, i + 1, length))) for i in range(max_words - length + 1)]


def _looked_up(df: DataFrame, parts: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the count ``out`` of the part in ``column``; a hot part is met in ``SALTS`` tasks."""
    salted = parts.select("lang", F.col("gram").alias(column), F.col("f").alias(out), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = df.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["lang", column, "salt"]).drop("salt")


def score_phrases(counts: DataFrame, max_words: int, inside: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases that are not mostly (``inside`` percent) part of a longer one."""
    words = F.split("gram", " ", -1)
    grams = counts.where("gram <> ''").withColumn("words", words).withColumn("k", F.size("words"))
    phrases = grams.where("k > 1").select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), "words", "k")
    cuts = phrases.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)"))).select(
        "lang", "phrase", "a", "cut", F.expr("concat_ws(' ', slice(words, 1, cut))").alias("head"), F.expr("concat_ws(' ', slice(words, cut + 1, k - cut))").alias("tail")
    )
    parts = grams.where(F.col("k") < max_words)
    cuts = _looked_up(_looked_up(cuts, parts, "head", "l"), parts, "tail", "r")
    # Exact for counts up to 10 ** 14: products take at most 37 digits.
    ratio = "cast(1000000 as decimal(7)) * cast(a as decimal(14)) * cast(a as decimal(14)) div (cast(l as decimal(14)) * cast(r as decimal(14)))"
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr(ratio).alias("score"), "cut", "l", "r")).alias("low"))
    inner = [p for length in range(2, max_words) for p in _slices(F.col("words"), F.col("k"), length, max_words)]
    scored = lowest.select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    if not inner:
        return scored
    longer = phrases.where("k > 2").select("lang", F.explode(F.array(*inner)).alias("phrase"), "a").where("phrase is not null")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.expr(f"longer is null or 100 * longer < {inside} * a"))
    return kept.drop("longer")


def collocations(
    df: DataFrame,
    max_words: int = 3,
    least: int = 10,
    inside: int = 50,
    top: int = 2000,
    modulus: int = 24,
    filter_bits: int = FILTER_BITS,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` collocations of 2 to ``max_words`` words of each language."""
    if max_words < 2:
        raise ValueError("a phrase has two words or more")
    spark = df.sparkSession
    # Texts are parsed once; the stored dictionary is read once for each length, and the few counts four times below.
    place = scratch_path(spark, f"chunks-{uuid.uuid4().hex}")
    dictionary(df, max_words - 1, modulus, text_col, lang_col).write.option("compression", "zstd").parquet(place)
    counts = all_counts(spark.read.parquet(place), max_words, least, filter_bits)
    remove_scratch(spark, place)
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    # First rows of each salt, then of the language: the last task of a language reads SALTS * top rows at most.
    ranked = score_phrases(counts, max_words, inside).withColumn("salt", salt)
    for keys in (["lang", "salt"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= top)
    words = counts.where("gram = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
