"""Problem 6: encoding a corpus with a public byte-level BPE by replaying its merges over the corpus's words.

1. Texts are cut into words and written as dictionary batches: for some thousand texts, the different
   words and, for each text, the numbers of its words.
2. The words of all batches are made distinct over the corpus. The merge list is replayed over them: an
   inverted index leads from each pair of adjacent symbols to the positions where it stands; a heap
   gives the pairs in rank order; a merge touches only the positions of its pair and their two
   neighbours. Merges never cross words, so the distinct words are spread over tasks by hash, and each
   word of the corpus is replayed once.
3. The words' ids are joined back to the batches (one row for each different word of a batch, not for
   each word of a text). Tasks read each batch as a sorted stream, first its words' ids and then its texts
   in pieces, and put the texts' ids together; no row holds a whole batch.

Shuffled are the distinct words of the batches and the numbers of the words. The only thing sent to the
executors is the vocabulary, whose size is fixed.

Defined results: a null or empty text gives an empty list. Strings that look like special tokens are
ordinary text. Repeated rows give repeated results. Extra columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.common import stage
from threadloom.llm.batches import parts

#: Fixed value: the public pattern that splits text into words before any merge.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern where a text holds ASCII only, for the faster standard library engine.
ASCII_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"

TOKENIZER_DIR = "/opt/tokenizers"
#: Texts of a dictionary batch at most, and bytes of text, about; words replayed together; texts put out together; batches of one task, on average. Memory only.
BATCH_ROWS, BATCH_BYTES, REPLAY_WORDS, OUT_ROWS, TASK_BATCHES = 4096, 6_000_000, 20_000, 1024, 2
#: Words of the texts in a piece of a batch, about (a longer text is a piece of its own); pieces in a file. A reader of such files takes all rows of one at once. Memory only.
PIECE_WORDS, FILE_PIECES = 50_000, 64
#: The number of a row that holds texts: after those of all words.
TEXTS = (1 << 31) - 1


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in public byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load_merges(name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Ids of the 256 bytes, and for each pair of ids (packed into one int) its rank and the merged id."""
    with open(f"{tokenizer_dir}/{name}.json", encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    symbol = byte_symbols()
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])
    return [vocab[symbol[b]] for b in range(256)], merges


def replay(words: list[str], byte_ids: list[int], merges: dict[int, tuple[int, int]]) -> list[tuple[int, ...]]:
    """The ids of each word, by applying the merges to all words together in rank order."""
    sym: list[int] = []
    ends: list[int] = []
    for w in words:
        sym.extend(map(byte_ids.__getitem__, w.encode("utf-8", "surrogatepass")))
        sym.append(-1)
        ends.append(len(sym))
    n = len(sym)
    nxt = list(range(1, n + 1))
    prv = list(range(-1, n - 1))
    index: dict[int, list[int]] = {}
    known = merges.get
    a = -1
    for i, b in enumerate(sym):
        if a >= 0 and b >= 0:
            k = a << 20 | b
            if k in index:
                index[k].append(i - 1)
            elif k in merges:
                index[k] = [i - 1]
        a = b
    heap = [(merges[k][0], k) for k in index]
    heapq.heapify(heap)
    while heap:
        _, k = heapq.heappop(heap)
        left, right, new = k >> 20, k & 0xFFFFF, known(k)[1]
        at = index.pop(k)
        if len(at) > 1:
            at.sort()
        for i in at:
            if sym[i] != left:
                continue
            j = nxt[i]
            if sym[j] != right:
                continue
            sym[i], sym[j] = new, -2
            q = nxt[j]
            nxt[i] = q
            prv[q] = i  # each word ends in a mark, so q is a position
            p = prv[i]
            if p >= 0 and (s := sym[p]) >= 0:
                t = s << 20 | new
                if t in index:
                    index[t].append(p)
                elif m := known(t):
                    index[t] = [p]
                    heapq.heappush(heap, (m[0], t))
            if (s := sym[q]) >= 0:
                t = new << 20 | s
                if t in index:
                    index[t].append(i)
                elif m := known(t):
                    index[t] = [i]
                    heapq.heappush(heap, (m[0], t))
    out, start = [], 0
    for end in ends:
        out.append(tuple(s for s in sym[start : end - 1] if s >= 0))
        start = end
    return out


def cut(texts: list[str | None], any_pattern=regex.compile(WORD_PATTERN), ascii_pattern=re.compile(ASCII_PATTERN)) -> list[list[str]]:
    """The words of each text."""
    return [(ascii_pattern if t.isascii() else any_pattern).findall(t) if t else [] for t in texts]


def dictionary(words: list[list[str]]) -> tuple[list[str], np.ndarray]:
    """The different words, and the number of each word of all texts in turn."""
    number: dict[str, int] = {}
    for w in words:
        number.update(dict.fromkeys(w))
    for i, w in enumerate(number):
        number[w] = i
    return list(number), np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int32)


def unfold(flat: np.ndarray, sizes: np.ndarray, ids: np.ndarray, ends: np.ndarray, counts_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each text, ids of all texts in turn) from the words' numbers, words of each text, and the words' ids (ids, ends)."""
    n_ids = np.diff(ends, prepend=0)
    per_word = n_ids[flat]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    tokens = np.bincount(owner, per_word, len(sizes)).astype(np.int32)
    if counts_only:
        return tokens, np.empty(0, np.int32)
    step = np.arange(per_word.sum()) - np.repeat(np.cumsum(per_word) - per_word, per_word)
    return tokens, ids[np.repeat((ends - n_ids)[flat], per_word) + step].astype(np.int32)


def _strings(words: list[str]) -> pa.Array:
    return pa.array([w.encode("utf-8", "surrogatepass") for w in words], pa.binary())


def narrow(most: int) -> type:
    """The narrower type for numbers from 0 to `most`."""
    return np.uint16 if most < 1 << 16 else np.int32


def values_of(column: pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(how many numbers each value has, the numbers of all values in turn) of a column of their bytes without nulls."""
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    numbers = np.frombuffer(data, kind, (edges[-1] - edges[0]) // kind().itemsize, edges[0]) if data and edges[-1] > edges[0] else np.empty(0, kind)
    return np.diff(edges).astype(np.int64) // kind().itemsize, numbers


def dictionary_batches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(batch, ids, sizes, flat, words): some thousand texts a batch, a piece of them a row; the first row of a batch has its words.

    flat are the numbers of the texts' words as bytes, two or four each: whole they are copied where a list is by element.
    """
    id_type, rows, size, piece = docs.schema[id_col].dataType.simpleString(), BATCH_ROWS, BATCH_BYTES, PIECE_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        for whole in batches:
            for batch in parts(whole, [1], rows, size):
                words = cut(batch.column(1).to_pylist())
                distinct, flat = dictionary(words)
                sizes = np.fromiter(map(len, words), np.int32, len(words))
                ends = np.cumsum(sizes, dtype=np.int64)
                key, start = pa.array([uuid.uuid4().int & (1 << 63) - 1], pa.int64()), 0
                while start < len(sizes):
                    before = ends[start - 1] if start else 0
                    end = max(start + 1, int(np.searchsorted(ends, before + piece, side="right")))
                    ids, mine = batch.column(0).slice(start, end - start), flat[before : ends[end - 1]].astype(narrow(len(distinct)))
                    yield pa.RecordBatch.from_arrays([key, one(ids), one(pa.array(sizes[start:end])), pa.array([mine.tobytes()], pa.binary()), one(_strings([] if start else distinct))], names=["batch", "ids", "sizes", "flat", "words"])
                    start = end

    out = f"batch long, ids array<{id_type}>, sizes array<int>, flat binary, words array<binary>"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, out)


def id_kind(model: tuple[list[int], dict[int, tuple[int, int]]]) -> type:
    """The type of all ids of load_merges()."""
    return narrow(max(chain(model[0], (i for _, i in model[1].values()))))


def replay_words(words: DataFrame, name: str, tokenizer_dir: str) -> DataFrame:
    """(word, tokens: bytes of its ids, each of kind()) of distinct words (word)."""
    model, most = load_merges(name, tokenizer_dir), REPLAY_WORDS
    shared, kind = words.sparkSession.sparkContext.broadcast(model), id_kind(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, [0], most):
                got = replay([w.decode("utf-8", "surrogatepass") for w in batch.column(0).to_pylist()], *shared.value)
                offsets = (np.cumsum([0, *map(len, got)]) * kind().itemsize).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(got), kind)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.BinaryArray.from_buffers(pa.binary(), len(got), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])], names=["word", "tokens"])

    return words.mapInArrow(run, "word binary, tokens binary")


def encode_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR, counts_only: bool = False) -> DataFrame:
    """(id_col, ids array<int>) of each row; with counts_only (id_col, n_tokens int)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = stage(dictionary_batches(docs, id_col, text_col), "token-batches", maxRecordsPerFile=FILE_PIECES)
    words = stage(replay_words(texts.select(F.explode("words").alias("word")).distinct(), name, tokenizer_dir), "token-words")
    # one row for each different word of a batch meets the words of the corpus
    # as many tasks as batches ask for, so that a task holds some of them at any size of the corpus
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-texts.select("batch").distinct().count() // TASK_BATCHES))
    kind = id_kind(load_merges(name, tokenizer_dir))
    ids_of = F.expr(f"cast(octet_length(tokens) div {kind().itemsize} as int)") if counts_only else F.col("tokens")
    met = texts.select("batch", F.posexplode("words").alias("number", "word")).join(words.select("word", ids_of.alias("tokens")), "word").select("batch", "number", "tokens")
    rows = met.unionByName(texts.select("batch", F.lit(TEXTS).alias("number"), "ids", "sizes", "flat"), allowMissingColumns=True)
    rows = rows.repartition(tasks, "batch").sortWithinPartitions("batch", "number")

    together = OUT_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, met, known, ends = None, [], None, None
        for batch in batches:
            keys, is_text = batch.column(0).to_numpy(), batch.column(1).to_numpy() == TEXTS
            tokens, texts = batch.column(2), batch.columns[3:]
            edges = np.flatnonzero((np.diff(keys) != 0) | (np.diff(is_text.view(np.int8)) != 0)) + 1
            for start, stop in zip([0, *edges], [*edges, len(keys)]):
                if start == stop:
                    continue
                if keys[start] != key:
                    key, met, known = keys[start], [], None
                if not is_text[start]:
                    met.append(tokens.slice(start, stop - start))
                    continue
                if known is None:  # all words of the batch were before
                    got = [(t.to_numpy(), np.empty(0, kind)) if counts_only else values_of(t, kind) for t in met]
                    ends, known, met = np.cumsum(np.concatenate([np.empty(0, np.int64), *(n for n, _ in got)])), np.concatenate([np.empty(0, kind), *(x for _, x in got)]), []
                for ids, sizes, flat in zip(*(c.slice(start, stop - start) for c in texts)):
                    n, out = unfold(np.frombuffer(flat.as_buffer(), narrow(len(ends))), sizes.values.to_numpy(), known, ends, counts_only)
                    if counts_only:
                        yield pa.RecordBatch.from_arrays([ids.values, pa.array(n)], names=[id_col, "n_tokens"])
                        continue
                    at = np.concatenate([[0], np.cumsum(n)])
                    for a in range(0, len(n), together):
                        b = min(len(n), a + together)
                        lists = pa.ListArray.from_arrays(pa.array((at[a : b + 1] - at[a]).astype(np.int32)), pa.array(out[at[a] : at[b]]))
                        yield pa.RecordBatch.from_arrays([ids.values.slice(a, b - a), lists], names=[id_col, "ids"])

    out = f"`{id_col}` {id_type}, " + ("n_tokens int" if counts_only else "ids array<int>")
    return rows.mapInArrow(run, out)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the byte_bpe_50k ids of every document."""
    return encode_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(id_col, text) of (id_col, ids): the bytes of the ids, one after the other."""
    with open(f"{tokenizer_dir}/{name}.json", encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    byte = {c: bytes([b]) for b, c in byte_symbols().items()}
    shared = encoded.sparkSession.sparkContext.broadcast({i: b"".join(map(byte.__getitem__, t)) for t, i in vocab.items() if all(c in byte for c in t)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.__getitem__
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(map(known, ids)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return encoded.mapInArrow(run, f"`{id_col}` {dict(encoded.dtypes)[id_col]}, text string")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the digest of the text that the ids of every document decode to."""
    return decode_ids(p6_ids(spark, sf_dir)).select("doc_id", F.sha2("text", 256).alias("sha"))


SQL = {"p6_decoded": "SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents"}
