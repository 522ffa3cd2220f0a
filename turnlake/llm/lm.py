"""Language-model scores from a log-frequency Bloom filter.

A model of words and word pairs is learned from all training texts and applied
to all texts. The filter holds a quantised count q of a pair as q nested members
(pair, 1) to (pair, q); scoring probes level after level until one is missing,
so that an error only ever raises a count, and with quickly falling odds. Every
pair is held from one occurrence on. Single words are counted exactly, since the
base score needs their counts anyway.

The filter grows with the corpus, so only a part of bounded size is broadcast:
the most frequent pairs, ``FREQUENT`` at most, as one filter, with as many words
and their counts. All other pairs lie in a segment for each bucket of hashes and
are probed there. Texts are taken in homes of consecutive rows. A home sends its
distinct words and pairs with their training counts once; each bucket adds the
counts up, builds its segment, and answers every home in the order of its keys,
so that an answer needs no keys. Then the texts meet the answers of their home.
One exchange of keys so serves counting and probing; nothing that grows with the
corpus reaches the driver, and a bucket or a home is as bounded as a task.

Tokens are words with A-Z lower-cased and one end for every text; the end is
counted like a word. Probability: weight * c(v,w)/c(v) + (1-weight) * p(w) with
p(w) = (c(w)+0.5)/(N+0.5(V+1)) and c(v,w) of the filter, the middle of its
quantised range; p(w) alone where v is unknown.

Defined results: null and empty texts have the end only; a very long text is a
home's or more by itself and is scored whole. Without training texts N and V are
0 and all tokens are unknown. Repeated rows are scored each on its own. An empty
table gives an empty result. Only the named columns are read. ``docs`` must give
its rows in the same order when it is read again, as tables do; this is checked,
and scoring fails where it does not hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm import text as tx
from turnlake.llm.shared import stored

#: Most words, and most pairs, that are broadcast.
FREQUENT = 1 << 18
#: Bytes of text in a home, and of all text for each bucket.
HOME_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
#: Bits of the filter for each member, and probes for each.
BITS, PROBES = 10, 4
#: Weight of the pair estimate against the single word's.
WEIGHT = 0.6
_U = np.uint64
START, END = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)
_WORD, _PAIR = 0, 1
_ASKED = "bucket int, home long, words binary, word_counts binary, pairs binary, pair_counts binary"
_ANSWERED = "home long, bucket int, words binary, word_counts binary, pairs binary, pair_counts binary, tokens long, known long, texts long"


class Tokens(NamedTuple):
    word: np.ndarray  # hash of every token
    pair: np.ndarray  # hash of (token before, token)
    before: np.ndarray  # index of the token before, -1 at a text's start
    doc: np.ndarray


def _chunk_tokens(chunk: tx.Chunk) -> Tokens:
    w = tx.words(chunk, fold=True)
    n = len(chunk.offsets) - 1
    some = np.diff(w.first) > 0
    before = np.arange(-1, len(w.hash) - 1)
    before[w.first[:-1][some]] = -1
    last = np.full(n, -1)
    last[some] = w.first[1:][some] - 1
    word = np.concatenate((w.hash, np.full(n, END)))
    before = np.concatenate((before, last))
    context = np.where(before < 0, START, word[before])
    pair = tx.mix(context * _U(tx.GRAM_BASE) + word)
    return Tokens(word, pair, before, np.concatenate((w.doc, np.arange(n))))


def tokens_of(texts: pa.Array | pa.ChunkedArray) -> Tokens:
    """Tokens of whole texts, in any order."""
    parts, size = [], 0
    for chunk in tx.chunks(texts):
        t = _chunk_tokens(chunk)
        parts.append(t._replace(before=np.where(t.before < 0, -1, t.before + size), doc=t.doc + chunk.first))
        size += len(t.word)
    return Tokens(*map(np.concatenate, zip(*parts, strict=True)))


def levels_of(count: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 for one, then one more for every doubling."""
    return 1 + np.floor(np.log2(count)).astype(np.int64)


def middle(level: np.ndarray) -> np.ndarray:
    """Middle of a quantised count's range; 0 if not held."""
    return np.where(level > 0, 1.5 * 2.0 ** (level - 1.0) - 0.5, 0.0)


def _bits_of(key: np.ndarray, level: int, size: int) -> Iterator[np.ndarray]:
    h = tx.mix(key + _U(level * 0xD1342543DE82EF95 % (1 << 64)))
    step = (h >> _U(32)) | _U(1)
    for k in range(PROBES):
        yield (((h & _U(0xFFFFFFFF)) + _U(k) * step) % _U(size)).astype(np.int64)


class Filter(NamedTuple):
    """A log-frequency Bloom filter."""

    bits: np.ndarray  # packed
    size: int

    def level(self, key: np.ndarray) -> np.ndarray:
        """Quantised counts by repeated membership probes."""
        found, left, level = np.zeros(len(key), np.int64), np.arange(len(key)), 1
        while len(left):
            kept = np.ones(len(left), bool)
            for bit in _bits_of(key[left], level, self.size):
                kept &= (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            left = left[kept]
            found[left] = level
            level += 1
        return found


def build_filter(key: np.ndarray, count: np.ndarray, bits_each: int) -> Filter:
    """A filter of keys with counts of one and more, at so many bits for each member."""
    level = levels_of(count)
    size = max(64, bits_each * int(level.sum()))
    bits = np.zeros(-(-size // 8) * 8, bool)
    for step in range(1, int(level.max(initial=0)) + 1):
        for at in _bits_of(key[level >= step], step, size):
            bits[at] = True
    return Filter(np.packbits(bits, bitorder="little"), size)


def _looked_up(keys: np.ndarray, values: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Values of sorted keys, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(key), np.int64)
    at = np.searchsorted(keys, key)
    at[at == len(keys)] = 0
    return np.where(keys[at] == key, values[at], 0)


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return key[new], np.add.reduceat(count[order], np.flatnonzero(new)) if len(key) else count


def _batch(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _ask(buckets: int):
    """The distinct keys of each home with their training counts, as one packed row for each bucket."""

    def packed(home: int, parts: list[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        tokens = [(tokens_of(texts), learn) for texts, learn in parts]
        learned = np.concatenate([learn[t.doc] for t, learn in tokens])
        cells: dict[int, list] = {}
        for kind in (_WORD, _PAIR):
            key, at = np.unique(np.concatenate([t[kind] for t, _ in tokens]), return_inverse=True)
            count = np.bincount(at, learned, minlength=len(key)).astype(np.int32)
            bucket = tx.bucket_of(key, buckets)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(key)]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                cells.setdefault(int(bucket[a]), [b""] * 4)[2 * kind : 2 * kind + 2] = tx.planes(key[a:b]), tx.planes(count[a:b])
        yield _batch(_ASKED, [(bucket, home, *cell) for bucket, cell in cells.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, parts = None, []
        for batch in batches:
            homes, learn = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(homes)) + 1, [len(homes)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b > a:
                    if homes[a] != home and parts:
                        yield from packed(home, parts)
                        parts = []
                    home = int(homes[a])
                    parts.append((batch.column(2).slice(a, b - a), learn[a:b]))
        if parts:
            yield from packed(home, parts)

    return run


def _counted(keys: list[np.ndarray], counts: list[bytes], most: int) -> tuple[tuple, tuple]:
    """(key, count) of the ``most`` most frequent keys of a bucket, and of the others, each sorted."""
    key, count = _summed(np.concatenate(keys), np.concatenate([tx.from_planes(c, np.int32) for c in counts]).astype(np.int64))
    key, count = key[count > 0], count[count > 0]
    often = np.zeros(len(key), bool)
    if most and len(key):
        often[np.argpartition(-count, min(most, len(key)) - 1)[:most]] = True
    return (key[often], count[often]), (key[~often], count[~often])


def _answer(most: int, bits_each: int):
    """Sums the counts of each bucket and answers its homes: words' counts, and pairs' levels by the bucket's segment.

    The ``most`` most frequent keys are told apart (with home null) and answered by 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for bucket, own in groupby(rows, key=lambda r: r[0]):
            _, homes, words, word_counts, pairs, pair_counts = zip(*own, strict=True)
            words = [tx.from_planes(x, np.uint64) for x in words]
            often, (key, count) = _counted(words, word_counts, most)
            replies = [tx.planes(_looked_up(key, count, asked)) for asked in words]
            sums = int(often[1].sum() + count.sum()), len(often[0]) + len(key), int(count[key == END].sum() + often[1][often[0] == END].sum())
            pairs = [tx.from_planes(x, np.uint64) for x in pairs]
            often_pairs, rest = _counted(pairs, pair_counts, most)
            segment = build_filter(*rest, bits_each)
            yield _batch(_ANSWERED, [(None, bucket, *(x.tobytes() for x in (*often, *often_pairs)), *sums)])
            for home, reply, asked in zip(homes, replies, pairs, strict=True):
                yield _batch(_ANSWERED, [(home, bucket, reply, None, segment.level(asked).astype(np.uint8).tobytes(), None, 0, 0, 0)])

    return run


class Model(NamedTuple):
    """What all tasks know; of bounded size."""

    tokens: int  # N
    known: int  # V
    texts: int  # of the training
    word: np.ndarray  # sorted keys of the most frequent words
    count: np.ndarray
    pairs: Filter  # of the most frequent pairs


def _model(answered: DataFrame) -> Model:
    told = answered.filter("home is null")
    zero = F.lit(0).cast("long")
    sums = told.agg(*[F.coalesce(F.sum(c), zero) for c in ("tokens", "known", "texts")]).first()
    names = ("words", "word_counts", "pairs", "pair_counts")
    often = told.filter("octet_length(words) + octet_length(pairs) > 0").select(*names).toArrow()
    word, count, pair, times = (
        np.frombuffer(b"".join(often.column(c).to_pylist()), form) for c, form in zip(names, (np.uint64, np.int64) * 2, strict=True)
    )
    order = np.argsort(word)
    return Model(*map(int, sums), word[order], count[order], build_filter(pair, times, BITS))


def _scores(shared):
    """Texts of a home scored beside its answers."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        m: Model = shared.value
        t, n = tokens_of(texts.column("_text")), texts.num_rows
        word, at_word = np.unique(t.word, return_inverse=True)
        pair, at_pair = np.unique(t.pair, return_inverse=True)
        got = sorted(zip(*(answers.column(c).to_pylist() for c in ("bucket", "words", "pairs")), strict=True))
        count = np.concatenate([tx.from_planes(words) for _, words, _ in got])
        level = np.concatenate([np.frombuffer(pairs, np.uint8) for _, _, pairs in got]).astype(np.int64)
        if len(count) != len(word) or len(level) != len(pair):
            raise RuntimeError("the rows came in another order than before; store docs first")
        count = count + _looked_up(m.word, m.count, word)
        blank = level == 0
        level[blank] = m.pairs.level(pair[blank])
        c, both = count[at_word].astype(float), middle(level)[at_pair]
        total = m.tokens + 0.5 * (m.known + 1)
        single = (c + 0.5) / total
        context = np.where(t.before < 0, float(m.texts), c[t.before])
        share = np.divide(np.minimum(both, context), context, out=np.zeros(len(both)), where=context > 0)
        p = np.where(context > 0, WEIGHT * share + (1 - WEIGHT) * single, single)
        summed = lambda x: np.bincount(t.doc, x, minlength=n)
        return pa.table({
            "_id": texts.column("_id"), "n_tokens": pa.array(np.bincount(t.doc, minlength=n), pa.int64()), "n_known": pa.array(summed(c > 0).astype(np.int64)),
            "base_score": pa.array(summed(np.log10(single))), "score": pa.array(summed(np.log10(p))),
        })

    return run


def score(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, Model]:
    """(id, n_tokens, n_known, base_score, score) of every row, and the model learned where training holds."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(text_col).cast("string")
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    # consecutive rows; several homes for each partition that they are dealt to
    each = max(1, min(rows * HOME_BYTES // max(size, 1), rows // (2 * parts)))
    buckets = max(parts, size // BUCKET_BYTES)
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    texts = docs.select(
        F.monotonically_increasing_id().alias("_at"), F.col(id_col).alias("_id"), F.coalesce(training, F.lit(False)).alias("learn"), text.alias("_text")
    ).withColumn("home", F.col("_at") - F.pmod(place, F.lit(each)))
    asked = texts.select("home", "learn", "_text").mapInArrow(_ask(buckets), _ASKED).repartitionById(parts, "bucket").sortWithinPartitions("bucket")
    answered = stored(asked.mapInArrow(_answer(FREQUENT // buckets, BITS), _ANSWERED))
    model = _model(answered)
    kind = texts.schema["_id"].dataType.simpleString()
    answers = answered.filter("home is not null").select("home", "bucket", "words", "pairs")
    scored = (
        texts.select("home", "_id", "_text").groupBy("home").cogroup(answers.groupBy("home"))
        .applyInArrow(_scores(spark.sparkContext.broadcast(model)), f"_id {kind}, n_tokens long, n_known long, base_score double, score double")
    )
    return scored.withColumnRenamed("_id", id_col), model
