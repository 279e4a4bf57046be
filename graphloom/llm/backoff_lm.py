"""Language-model scores by a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing: the probability of a word
after a history h is (c(h w) + mu * p(w | shorter h)) / (c(h) + mu), down to
single words with add-0.1 counts. As an automaton, its states are the histories
seen; a seen n-gram is an arc with its log-probability, and a state's failure
arc, of weight log(mu / (c(h) + mu)), leads to the shorter history. One
left-to-right traversal of a text carries the state and adds up the weights of
the arcs and failure arcs it takes.

The whole automaton grows with the corpus, so it is never in one place. Texts
are held in blocks of bounded size. Each block lists its distinct n-grams (as
64-bit hashes, sorted) with its own counts and sends them, packed, to buckets of
hash ranges of bounded size; a bucket adds up the counts and answers every block
in the order in which it asked. A block then has the counts of just the states
and arcs that its texts can visit, however large the corpus, and a frequent
n-gram is one entry a block: no key is hot.

Defined results: a null text counts as empty and is scored for its end alone;
rows that repeat are counted and scored each; rows where ``training`` is null (as
for a null doc_id) are scored and not learnt from; an empty table gives an empty table; a corpus without training rows
gives every token the same probability; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import get, materialise, put, scratch

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))
FOLD = bytes(SPACES[LOWER[b]] for b in range(256))
END, START = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MIX = np.uint64(0xFF51AFD7ED558CCD)

ASK = "bucket bigint, block bigint, seq bigint, n bigint, hashes binary, counts binary"
TELL = "block bigint, bucket bigint, seq bigint, totals binary, n_types bigint, n_tokens bigint"


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def tokens(text: str | None) -> list[bytes]:
    """Words, lower-cased over A-Z and cut at ASCII white space."""
    return [w for w in (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split(b" ") if w]


class Block:
    """Hashes of every n-gram that ends at a token of the texts, by order.

    A document is START, its words, END; histories don't reach over START.
    """

    def __init__(self, texts: list[str | None], order: int, hashes: Hashes):
        flat: list[int] = []
        ends = []
        for t in texts:
            flat.append(START)
            flat.extend(map(hashes.__getitem__, tokens(t)))
            flat.append(END)
            ends.append(len(flat))
        h = np.array(flat, np.uint64)
        self.order, self.stop = order, np.array(ends, np.int64)
        begin = np.concatenate([[0], self.stop[:-1]]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(ends)), self.stop - begin)
        self.is_start = np.zeros(len(h), bool)
        self.is_start[begin] = True
        # depth: how many tokens of the document are at or before this one
        depth = np.arange(len(h)) - begin[self.doc] + 1 if len(h) else np.empty(0, np.int64)
        self.grams = [h]
        for n in range(2, order + 1):
            g = np.zeros(len(h), np.uint64)
            prev = self.grams[-1]
            x = prev[:-1] * _MIX + h[1:] if len(h) else h
            x ^= x >> np.uint64(29)
            g[1:] = x * _MIX + np.uint64(n)
            self.grams.append(g)
        self.valid = [depth >= n for n in range(1, order + 1)]

    def distinct(self, n: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct hashes of order n, their weighted counts, and where each position's is."""
        keys, at = np.unique(self.grams[n - 1][self.valid[n - 1]], return_inverse=True)
        counts = np.bincount(at, weights=weights[self.valid[n - 1]], minlength=len(keys)).astype(np.int64)
        return keys, counts, at


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    edges = ((np.arange(1, buckets, dtype=object) * 2**64) // buckets).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def score_texts(docs: DataFrame, training: Column, order: int = 2, mu: float = 4.0, block_chars: int = 8_000_000, bucket_entries: int = 2_000_000) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document.

    ``training`` is a condition on the columns of ``docs`` that marks the rows to learn from.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(training, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8)).first()[0] or 0
    # A token takes two bytes at least, so a bucket has bucket_entries a unit on average, mostly far fewer.
    buckets = max(1, -(-order * size // (3 * bucket_entries)))
    store = scratch(spark, "lm-blocks")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, hashes = TaskContext.get().partitionId(), 0, Hashes()
        held: list[tuple] = []
        chars = 0

        def close() -> Iterator[pd.DataFrame]:
            nonlocal held, chars, seq
            number = (part << 24) + seq
            ids, texts, train = zip(*held)
            frame = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "text": texts, "train": train})
            put(f"{store}/{number}", zstandard.compress(_pack(frame), 3))
            b = Block(list(texts), order, hashes)
            weights = np.array(train, np.float64)[b.doc]
            for n in range(1, order + 1):
                keys, counts, _ = b.distinct(n, weights)
                cuts, out = _cuts(keys, buckets), []
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    s = slice(cuts[k], cuts[k + 1])
                    out.append((n * buckets + k, number, n, cuts[k + 1] - cuts[k], keys[s].tobytes(), _pack_counts(counts[s])))
                    if len(out) >= 64:
                        yield pd.DataFrame(out, columns=["bucket", "block", "seq", "n", "hashes", "counts"])
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=["bucket", "block", "seq", "n", "hashes", "counts"])
            held, chars, seq = [], 0, seq + 1

        for b in batches:
            for doc_id, null, text, train in zip(b["doc_id"], b["doc_id"].isna(), b["text"], b["train"]):
                held.append((None if null else int(doc_id), text, bool(train)))
                chars += len(text or "") + 8
                if chars >= block_chars:
                    yield from close()
        if held:
            yield from close()

    def add_up(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        hashes = np.concatenate([np.frombuffer(v, np.uint64) for v in x["hashes"]])
        counts = np.concatenate([_raw_counts(v) for v in x["counts"]])
        keys, at = np.unique(hashes, return_inverse=True)
        totals = np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)
        single = int(x["seq"].iloc[0]) == 1
        real = keys != np.uint64(START)
        n_types, n_tokens = (int((totals[real] > 0).sum()), int(totals[real].sum())) if single else (0, 0)
        out, start = [], 0
        every = totals[at]
        for j, (block, n, seq) in enumerate(zip(x["block"], x["n"], x["seq"])):
            part = every[start : start + n]
            start += n
            out.append((block, key[0], seq, _pack_counts(part), n_types if j == 0 else 0, n_tokens if j == 0 else 0))
        return pd.DataFrame(out, columns=["block", "bucket", "seq", "totals", "n_types", "n_tokens"])

    asked = rows.mapInPandas(ask, ASK)
    told = materialise(asked.groupBy("bucket").applyInPandas(add_up, TELL), "lm-counts")
    sums = told.agg(F.sum("n_types").alias("v"), F.sum("n_tokens").alias("n")).first()
    n_types, n_tokens = int(sums["v"] or 0), int(sums["n"] or 0)

    def answer(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        frame = _unpack(zstandard.decompress(get(f"{store}/{key[0]}")))
        b = Block(frame["text"].tolist(), order, Hashes())
        by = {}
        for n, part in x.sort_values("bucket").groupby("seq"):
            keys, _, at = b.distinct(int(n), np.zeros(len(b.doc)))
            totals = np.concatenate([_raw_counts(v) for v in part["totals"]])
            assert len(totals) == len(keys)
            full = np.zeros(len(b.doc), np.int64)
            full[b.valid[int(n) - 1]] = totals[at]
            by[int(n)] = full
        return traverse(frame, b, by, n_types, n_tokens, mu)

    return told.groupBy("block").applyInPandas(answer, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def traverse(frame: pd.DataFrame, b: Block, counts: dict[int, np.ndarray], n_types: int, n_tokens: int, mu: float) -> pd.DataFrame:
    """The traversal of all texts of a block, position by position and order by order.

    At each position the automaton is in the state of the longest seen history.
    If that state has no arc for the token, the failure arc's weight is added and
    the next shorter history is tried; at the root every token has an arc.
    """
    real = ~b.is_start
    c1 = counts[1]
    base = np.log10((c1 + 0.1) / (n_tokens + 0.1 * (n_types + 1)))
    arc = base.copy()
    for n in range(2, b.order + 1):
        # The state's count is that of the history: the n-gram of one order less that ends a token earlier.
        state = np.zeros(len(c1), np.int64)
        state[1:] = counts[n - 1][:-1]
        state = np.where(b.valid[n - 1], state, 0)
        seen = np.where(b.valid[n - 1], counts[n], 0)
        fail = np.log10(mu / (state + mu))
        # A seen n-gram's arc has the smoothed weight; without one: failure arc, then what the shorter history gives.
        arc = np.where(seen > 0, np.log10((seen + mu * 10.0**arc) / (state + mu)), fail + arc)
    known = (c1 > 0) & real
    n = len(frame)
    total = lambda v: np.bincount(b.doc[real], weights=v[real], minlength=n)
    return pd.DataFrame({
        "doc_id": frame["doc_id"], "n_tokens": total(np.ones(len(c1))).astype(np.int64), "n_known": total(known.astype(float)).astype(np.int64),
        "train_tokens": n_tokens, "base_score": total(base), "score": total(arc),
    })


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts in as few bytes as they need; the first byte tells their width."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or counts.max(initial=0) < 256**w)
    return bytes([width]) + zlib.compress(counts.astype(f"<u{width}").tobytes(), 1)


def _raw_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


def _pack(frame: pd.DataFrame) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    t = pa.Table.from_pandas(frame, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.large_string()), ("train", pa.bool_())]), preserve_index=False)
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    import pyarrow as pa

    t = pa.ipc.open_stream(data).read_all()
    return pd.DataFrame({"doc_id": pd.array(t["doc_id"].to_pylist(), "Int64"), "text": pd.Series(t["text"].to_pylist(), dtype=object)})
