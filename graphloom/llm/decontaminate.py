"""Benchmark decontamination: a hash set of test n-grams against every window.

Texts are lower-cased over A-Z and cut into words of digits, letters and any
character beyond ASCII. A window is ``width`` consecutive words of a benchmark
item; an item of fewer words, but not none, is one window. Each window of a
document is hashed (a rolling sum over word hashes), looked up, and verified
word by word; every word inside a verified occurrence is hit.

The window set is broadcast only while it holds at most ``max_broadcast``
windows. Beyond that, windows are exchanged by hash instead: documents emit
the hashes of their windows, which join the benchmark's on two 64-bit hashes.
Both ways give the same rows.

Defined results: a null or empty text has no words and is clean; repeated rows
each get their row; repeated benchmark items count by item_id; a null item_id
is named ``null``; empty tables give no hits or no rows. ``report`` ignores
other columns, ``clean`` keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import lean, materialise

_FOLD = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8. In bytes, since all that separates is ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Hashes(dict):
    """Word to 64-bit hash; starts anew at a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def roll(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * _BASE + h[j : j + m]
    return out


class Windows:
    """The benchmark's windows by length: sorted hashes for the scan, words and items to verify."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.of: dict[tuple[bytes, ...], set[str]] = {}
        for item, w in items:
            for i in range(max(1, len(w) - width + 1) if w else 0):
                self.of.setdefault(tuple(w[i : i + width]), set()).add(item)
        hashes, by = Hashes(), {}
        for window in self.of:
            by.setdefault(len(window), []).append(roll(np.array([hashes[w] for w in window], np.uint64), len(window))[0])
        self.by = {n: np.unique(np.array(v, np.uint64)) for n, v in by.items()}
        # A bit a low hash value: most windows of a document need one look at it.
        self.bits = {n: self._bits(v) for n, v in self.by.items()}

    @staticmethod
    def _bits(v: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << min(22, max(12, (256 * len(v)).bit_length())), bool)
        bits[(v & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        return bits

    def scan(self, w: list[bytes], h: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items whose windows occur."""
        hit, items = np.zeros(len(w), bool), set()
        for n, known in self.by.items():
            x = roll(h, n)
            if not len(x):
                continue
            bits = self.bits[n]
            at = np.flatnonzero(bits[(x & np.uint64(len(bits) - 1)).astype(np.int64)])
            for i in at[np.isin(x[at], known)].tolist() if len(at) else ():
                found = self.of.get(tuple(w[i : i + n]))
                if found:
                    hit[i : i + n] = True
                    items |= found
        return hit, items


def item_windows(benchmark: DataFrame, width: int = 13, max_broadcast: int = 1_000_000) -> Windows | None:
    """The window set, or None if the benchmark has too many words to be broadcast.

    Its number of windows is at most its number of words, which is counted first,
    along with its bytes.
    """
    size = benchmark.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b")).first()
    if size["n"] > max_broadcast or (size["b"] or 0) > 8 * max_broadcast:
        return None
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text").collect()
    return Windows([(r["i"], words(r["text"])) for r in rows], width)


def items_digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


REPORT = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>"


def _hashed(w: list[bytes], hashes: Hashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))


def report(docs: DataFrame, benchmark: DataFrame, width: int = 13, max_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, n_hit and the sorted items that occur, a row a document."""
    known = item_windows(benchmark, width, max_broadcast)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if known is None:
        return _exchanged(docs, benchmark, width)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows, hashes = shared.value, Hashes()
        for b in batches:
            out = []
            for text in b["text"]:
                w = words(text)
                hit, items = windows.scan(w, _hashed(w, hashes))
                out.append((len(w), int(hit.sum()), sorted(items)))
            yield pd.concat([b[["doc_id"]].astype("Int64").reset_index(drop=True), pd.DataFrame(out, columns=["n_words", "n_hit", "items"])], axis=1)

    return docs.mapInPandas(lean(scan), REPORT)


def _spans(rows: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """rid, items and spans (first word, word after the last) of the rows with hits: windows meet by hash in a shuffle."""

    def item_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for b in batches:
            out = set()
            for item, text in zip(b["i"], b["text"]):
                w = words(text)
                h = _hashed(w, hashes)
                n = min(len(w), width)
                for i, x in enumerate(roll(h, n)) if n else ():
                    out.add((n, int(x.astype(np.int64)), xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 7) - 2**63, item))
            yield pd.DataFrame(list(out), columns=["width", "h", "check", "item"])

    names = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text")
    items = names.mapInPandas(item_hashes, "width int, h bigint, check bigint, item string").distinct()
    items = materialise(items, "item-windows")
    widths = [r[0] for r in items.select("width").distinct().collect()]  # 1 to width: bounded

    def doc_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for b in batches:
            for rid, text in zip(b["rid"], b["text"]):
                w = words(text)
                h = _hashed(w, hashes)
                for n in widths:
                    x = roll(h, n)
                    if len(x):
                        joined = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 7) - 2**63 for i in range(len(x))]
                        yield pd.DataFrame({"rid": rid, "at": np.arange(len(x)), "width": n, "h": x.astype(np.int64), "check": joined})

    seen = rows.select("rid", "text").mapInPandas(doc_hashes, "rid bigint, at bigint, width int, h bigint, check bigint")
    # Windows that many documents share meet few items: the side of the items is spread over salts.
    salted = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    found = seen.withColumn("salt", F.pmod("rid", F.lit(16)).cast("int")).join(salted, ["width", "h", "check", "salt"])
    return found.groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"), F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("width")).alias("to")))).alias("spans"))


def _exchanged(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """The same report for a benchmark of any size."""
    rows = materialise(docs.withColumn("rid", F.monotonically_increasing_id()), "docs")
    spans = _spans(rows, benchmark, width)
    # Words covered by the spans, in order of their start.
    step = "aggregate(spans, named_struct('n', 0L, 'to', 0L), (a, s) -> named_struct('n', a.n + greatest(s.to - greatest(s.at, a.to), 0L), 'to', greatest(a.to, s.to)), a -> a.n)"
    counts = spans.select("rid", "items", F.expr(step).alias("n_hit"))
    folded = F.regexp_extract_all("text", F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"))
    sizes = rows.select("rid", "doc_id", F.coalesce(F.size(folded), F.lit(0)).cast("long").alias("n_words"))
    sizes = sizes.withColumn("n_words", F.greatest("n_words", F.lit(0).cast("long")))
    out = sizes.join(counts, "rid", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 13, max_broadcast: int = 1_000_000) -> DataFrame:
    """Documents without contamination; all columns are kept.

    A document is dropped if at least one word in 20 is hit. From the others, the
    hit words go, with the text between words of one hit run; the rest of the
    text stays as it is, and so does a document without hits.
    """
    at, schema = docs.columns.index("text"), docs.schema
    known = item_windows(benchmark, width, max_broadcast)
    if known is None:
        rows = materialise(docs.withColumn("_gl_rid", F.monotonically_increasing_id()), "docs")
        spans = _spans(rows.select(F.col("_gl_rid").alias("rid"), "text"), benchmark, width)
        docs = rows.join(spans.select(F.col("rid").alias("_gl_rid"), F.col("spans").alias("_gl_spans")), "_gl_rid", "left").select(*docs.columns, "_gl_spans")
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        windows, hashes = shared.value, Hashes()
        for b in batches:
            spans = b["_gl_spans"].to_pylist() if windows is None else None
            keep, texts = [], []
            for i, text in enumerate(b.column(at)):
                text = text.as_py()
                w = words(text)
                if windows is None:
                    hit = np.zeros(len(w), bool)
                    for s in spans[i] or ():
                        hit[s["at"] : s["to"]] = True
                else:
                    hit, _ = windows.scan(w, _hashed(w, hashes))
                n = int(hit.sum())
                keep.append(not (n and 20 * n >= len(w)))
                texts.append(without(text, hit) if n and keep[-1] else text)
            if windows is None:
                b = b.select([f.name for f in b.schema][:-1])
            b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(scan), schema)


def without(text: str, hit: np.ndarray) -> str:
    """A text without its hit words."""
    data = text.encode("utf-8", "surrogatepass")
    folded, out, last, k = data.translate(_FOLD), [], 0, 0
    spans = [m.span() for m in re.finditer(rb"[^ ]+", folded)]
    while k < len(spans):
        if not hit[k]:
            k += 1
            continue
        end = k
        while end + 1 < len(spans) and hit[end + 1]:
            end += 1
        out.append(data[last : spans[k][0]])
        last, k = spans[end][1], end + 1
    return b"".join([*out, data[last:]]).decode("utf-8", "surrogatepass")
