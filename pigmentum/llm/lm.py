"""Language-model scoring: exact smoothed unigram counts, and a gated recurrent model (`gru`).

Everything the models know comes from the training documents (crc32 of the id, modulo 10, not 0):

* counts of every token, summed per partition, then by a shuffle, into a checkpointed table;
* the model's vocabulary, classes and output biases: the most frequent tokens of that table;
* the recurrent weights. A second pass over the texts turns each document into the numbers of its
  words, two bytes a word, in a checkpointed table that training and scoring read instead. The
  training documents are dealt into ROUNDS rounds by crc32, so each is trained on once, and within a
  round into shards by a hash of the row. In a round every shard trains from the same weights on its
  own documents in their order, and the weights are averaged by words seen, in two shuffled steps.
  The number of shards follows from the number of training tokens, so weights don't depend on how
  the table is partitioned.

A token outside the model's vocabulary is scored as the unknown word times its smoothed share of
all such tokens, so the score is the log-probability of the whole text over an open vocabulary.

The end token's count and the HEAD most frequent words' (bounded in number and length) are broadcast;
documents send only their other words to be joined with the table of counts.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import bucket, cut_lineage, map_batches

#: The end token's name; no word holds a space.
END = " "
HELD_OUT, HELD_OUT_MOD = 0, 10
HEAD, HEAD_CHARS = 400_000, 64
ROUNDS = 4
#: Training tokens of a shard, and the number of a round's shards from which it grows as a square root only.
SHARD_TOKENS, SHARDS = 300_000, 256
#: Parameters are averaged in so many blocks, first among shards of the same salt.
BLOCKS, SALT = 8, 64
#: Tokens of the documents that run side by side.
CHUNK_TOKENS = 3_000_000
#: Bytes of the texts whose words are told apart at a time (a longer text by itself).
SLICE_BYTES = 2 << 20
#: How the model's numbers of words are stored.
ID = np.dtype("<i2")


def words_of(batch: pa.RecordBatch, i: int):
    """(at, end, names, word, start) for some rows of the texts in column i after another.

    at, end: which rows; names: the different words of theirs; word: the number in names of each
    word, text after text; start: where each text's words start there, and their end.
    """
    texts = pc.ascii_lower(pc.fill_null(batch.column(i), ""))
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE_BYTES
    edges = [*np.flatnonzero(np.diff(size, prepend=-1)).tolist(), len(texts)] if len(texts) else []
    for at, end in zip(edges, edges[1:], strict=False):
        split = pc.ascii_split_whitespace(texts.slice(at, end - at))
        coded = split.flatten().dictionary_encode()
        word, names = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        start = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        if "" in names:  # beside whitespace at a text's ends
            kept = word != names.index("")
            start = np.append(0, np.cumsum(kept))[start]
            word = word[kept]
        yield at, end, names, word, start


def count_tokens(train: DataFrame) -> DataFrame:
    """(token, c) over all rows of `train`, each with its end token."""

    def run(batches):
        held: dict[str, int] = {}

        def rows():
            names = list(held)
            for at in range(0, len(names), 50_000):
                some = names[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([held[x] for x in some], pa.int64())], ["token", "c"])

        for b in batches:
            for at, end, names, word, _ in words_of(b, 0):
                get = held.get
                for x, n in zip(names, np.bincount(word, minlength=len(names)).tolist(), strict=True):
                    if n:
                        held[x] = get(x, 0) + n
                held[END] = get(END, 0) + end - at
                if len(held) > 400_000:
                    yield from rows()
                    held = {}
        yield from rows()

    return map_batches(train, ["text"], run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def head_of(counts: DataFrame, most: int = HEAD) -> tuple[list[str], list[int]]:
    """Names and counts of the commonest words, most frequent first: all from some count on, `most` at most.

    The count is read off a histogram of counts in steps of a twelfth of their size, so no task
    ever sorts the table. Tokens that just miss it are joined like all others, so nothing is lost.
    """
    short = counts.where((F.col("token") != END) & (F.length("token") <= HEAD_CHARS))
    step = F.floor(F.log2("c") * 8).cast("int")
    held, least = 0, None
    for r in sorted(short.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).collect(), reverse=True):
        if held + r.n > most:
            break
        held, least = held + r.n, r.c
    if least is None:
        return [], []
    got = short.where(F.col("c") >= least).toArrow()
    both = sorted(zip(got["token"].to_pylist(), got["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    return [t for t, _ in both], [c for _, c in both]


class Words:
    """The end token's count and the head of the table of counts, and how its first words are numbered for the recurrent model."""

    def __init__(self, names: list[str], counts: list[int], ends: int, total: int, kinds: int):
        self.total, self.kinds, self.ends = total, kinds, ends
        self.count = np.array(counts, np.float64)
        self.number = {x: i for i, x in enumerate(names)}
        known = min(len(names), gru.VOCAB - 2)
        self.of = np.full(len(names) + 1, gru.UNK, np.int32)  # number in the head -> in the model; the last: not in the head
        self.of[:known] = np.arange(2, known + 2)
        rest = total - ends - int(sum(counts[:known]))
        self.inside = np.zeros(gru.VOCAB)
        self.inside[gru.UNK], self.inside[gru.END], self.inside[2 : known + 2] = rest + 1, ends + 1, counts[:known]
        #: log10 of what a count plus 0.1 is divided by: among all tokens, and among unknown ones
        self.log_all = math.log10(total + 0.1 * (kinds + 1))
        self.log_rest = math.log10(rest + 0.1 * (kinds - (ends > 0) - known + 1))

    def in_head(self, names: list[str]) -> np.ndarray:
        """The words' numbers in the head (one past its end: not there)."""
        return np.fromiter(map(self.number.get, names, repeat(len(self.count))), np.int64, len(names))


def _mean(pdf: pd.DataFrame) -> np.ndarray:
    total, weight = 0.0, pdf["n"].to_numpy(np.float64)
    for v, n in zip(pdf["vec"], weight, strict=True):
        total = total + np.frombuffer(v, np.float32).astype(np.float64) * n
    return (total / weight.sum()).astype(np.float32)


def shards(tokens: int, rounds: int = ROUNDS) -> int:
    """A round's shards for so many training tokens."""
    x = tokens / rounds / SHARD_TOKENS
    return max(1, math.ceil(min(x, math.sqrt(SHARDS * x))))


def train(lessons: DataFrame, words, rounds: int = ROUNDS) -> np.ndarray:
    """The recurrent model's weights. `lessons` has doc_id, ids and `deal` (its round, from 0); `words` is a broadcast Words."""
    sc = lessons.sparkSession.sparkContext
    flat, n_shards = gru.pack(gru.start(words.value.inside)), shards(words.value.total, rounds)
    for r in range(rounds):
        given = sc.broadcast(flat)

        def run(batches, given=given):
            p, n, held, size = gru.unpack(given.value), 0, [], 0
            for b in batches:
                for x in b.column(0):
                    held.append(np.frombuffer(x.as_buffer(), ID))
                    size += len(held[-1])
                    if size > CHUNK_TOKENS:
                        n += gru.train(p, held)
                        held, size = [], 0
            n += gru.train(p, held)
            if n:
                part = TaskContext.get().partitionId()
                vecs = np.array_split(gru.pack(p).astype(np.float32), BLOCKS)
                yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([part // SALT] * BLOCKS, pa.int32()), pa.array([part] * BLOCKS, pa.int32()), pa.array([n] * BLOCKS, pa.int64()), pa.array([v.tobytes() for v in vecs], pa.binary())], ["block", "salt", "part", "n", "vec"])

        def some(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part")
            return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": pdf["salt"].iloc[:1], "n": [pdf["n"].sum()], "vec": [_mean(pdf).tobytes()]})

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part")
            return pd.DataFrame({"block": pdf["block"].iloc[:1], "vec": [_mean(pdf).tobytes()]})

        shard = F.pmod(F.xxhash64("doc_id", "ids"), F.lit(n_shards)).cast("int")
        dealt = lessons.where(F.col("deal") == r).select("doc_id", "ids").repartitionById(n_shards, shard).sortWithinPartitions("doc_id", "ids")
        sent = map_batches(dealt, ["ids"], run, "block int, salt int, part int, n long, vec binary")
        got = sent.groupBy("block", "salt").applyInPandas(some, "block int, part int, n long, vec binary").groupBy("block").applyInPandas(whole, "block int, vec binary").collect()
        if got:
            flat = np.concatenate([np.frombuffer(x.vec, np.float32) for x in sorted(got, key=lambda x: x.block)])
    return flat


def numbered(docs: DataFrame, words) -> DataFrame:
    """The documents (doc_id, text, held_out, deal) as numbers of words, in one pass over the texts.

    A row with `ids` per document, also with n_tokens, and n_known, base (its base score) and rest
    (the shares of its unknown words) as far as the head knows; and a row (row, token, tf) for
    every other token of a document.
    """

    def run(batches):
        w, part, seen = words.value, TaskContext.get().partitionId(), 0
        none = len(w.count)
        log_count = np.append(np.log10(w.count + 0.1), 0.0)  # the last: not in the head
        log_end = math.log10(w.ends + 0.1)
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.string(), pa.int64()]
        names = ["row", "doc_id", "held_out", "deal", "n_tokens", "n_known", "base", "rest", "ids", "token", "tf"]

        def rows(*cols):
            return pa.RecordBatch.from_arrays([*cols, *(pa.nulls(len(cols[0]), k) for k in kinds[len(cols) :])], names)

        for b in batches:
            for at, end, own, word, start in words_of(b, 1):
                n, length = end - at, np.diff(start)
                row, seen = (part << 40) + np.arange(seen, seen + n), seen + n
                number = w.in_head(own)
                head = number[word]
                doc = np.repeat(np.arange(n), length)
                total = lambda x, doc=doc, n=n: np.bincount(doc, weights=x, minlength=n)
                known, logs, model = head < none, log_count[head], w.of[head]
                unknown = model == gru.UNK
                ids = np.full(len(word) + n, gru.END, ID)
                ids[np.arange(len(word)) + doc] = model
                edges = (start + np.arange(n + 1)) * ID.itemsize
                yield rows(
                    pa.array(row),
                    b.column(0).slice(at, n).cast(pa.int64()),
                    *(b.column(i).slice(at, n) for i in (2, 3)),
                    pa.array(length + 1),
                    pa.array(total(known).astype(np.int64) + (w.ends > 0)),
                    pa.array(total(logs) + log_end - (length + 1) * w.log_all),
                    pa.array(total(np.where(unknown, logs - w.log_rest, 0))),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(ids)]),
                )
                away = np.flatnonzero(~known)
                pairs, tf = np.unique(doc[away] * len(own) + word[away], return_counts=True)
                for i in range(0, len(pairs), 50_000):
                    some = pairs[i : i + 50_000]
                    got = pa.array([own[x] for x in (some % len(own)).tolist()], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(row[some // len(own)]), *(pa.nulls(len(some), k) for k in kinds[1:-2]), got, pa.array(tf[i : i + 50_000])], names)

    return map_batches(docs, ["doc_id", "text", "held_out", "deal"], run, "row long, doc_id long, held_out boolean, deal int, n_tokens long, n_known long, base double, rest double, ids binary, token string, tf long")


def score(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    base_score: the smoothed unigram log10 probability; score: the recurrent model's. A null or
    empty text is its end token alone; a null doc_id counts as the empty id, so it is held out.
    Repeated rows are learnt from and scored each on its own. Without training documents every
    count is zero. An empty table gives no rows; other columns aren't read. How the table is
    partitioned changes a score by rounding only (the model's numbers are 32-bit floats). The size
    of the head changes where a word's count is looked up, and no base score.
    """
    spark = docs.sparkSession
    key = bucket(F.col("doc_id"), HELD_OUT_MOD * ROUNDS)
    own = docs.select("doc_id", "text").withColumn("held_out", key % HELD_OUT_MOD == HELD_OUT).withColumn("deal", F.floor(key / HELD_OUT_MOD).cast("int"))
    counts = cut_lineage(count_tokens(own.where(~F.col("held_out"))))
    ends = F.sum(F.when(F.col("token") == END, F.col("c")))
    ends, total, kinds = counts.agg(F.coalesce(ends, F.lit(0)), F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    words = spark.sparkContext.broadcast(Words(*head_of(counts, head), ends, total, kinds))
    parts = cut_lineage(numbered(own, words))
    texts = parts.where("token is null")
    weights = spark.sparkContext.broadcast(train(texts.where(~F.col("held_out")), words))

    def run(batches):
        p = gru.unpack(weights.value)
        kept = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base"]

        def flush(held):
            b = pa.Table.from_batches(held)
            likely = gru.log_likelihoods(p, [np.frombuffer(x.as_buffer(), ID) for x in b.column("ids")]) / math.log(10)
            score = pa.array(likely + b.column("rest").to_numpy(), pa.float64())
            return b.select(kept).append_column("score", score).to_batches()

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column(b.schema.get_field_index("ids")).nbytes // 2
            if size > CHUNK_TOKENS:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    whole = map_batches(texts, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "rest", "ids"], run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    c = F.coalesce(F.col("c"), F.lit(0))
    tail = parts.where("token is not null").select("row", "token", "tf").join(counts, "token", "left")
    tail = tail.select("row", F.when(c > 0, F.col("tf")).otherwise(0).alias("n_known"), (F.col("tf") * F.log10(c + 0.1)).alias("base"))
    none = {x: F.lit(None) for x in ("doc_id", "held_out", "n_tokens")}
    both = whole.unionByName(tail.withColumns(none).withColumn("score", F.col("base")))
    out = both.groupBy("row").agg(*(F.max(x).alias(x) for x in none), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
