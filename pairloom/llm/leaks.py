"""Evaluation texts inside a corpus: multi-pattern search by block shifts over words (Wu and Manber 1994).

Every run of `min_words` words of an item is a pattern; all patterns have that length. A symbol is a word and a block
is two words. The shift table tells how far the search may move on when a block ends the window; a block that ends
some pattern has shift 0. A window that stops there, and whose first block begins some pattern, is taken to the patterns
with its hash, and direct comparison of the words confirms it.

The corpus is scanned once, where it lies, whatever the number of items: the tables are all that a task is sent, two
bytes for each of 2^bits blocks, 32 MB at most; patterns stay a DataFrame. With more patterns than the tables can tell
apart, more windows are looked up, and the rows found are the same. Only windows that stopped are moved, to be joined.

Defined cases: null and empty texts on either side give no row; items with fewer than `min_words` words have no
pattern; the same passage in several items gives a row for each of them; repeats within a document give one row, and so do
equal ids. Columns other than those named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.words import CODES, blocks, folded_words, mix
from pairloom.session import materialize, small

BLOCK = 2
FEWEST_BITS, MOST_BITS = 16, 24


def word_codes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(CODES.__getitem__, words), np.uint64, len(words))


def block_codes(code: np.ndarray, bits: int) -> np.ndarray:
    """A number of `bits` bits for each two adjacent words."""
    return (mix(code[:-1] + mix(code[1:])) >> np.uint64(64 - bits)).astype(np.int64)


def run_codes(code: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """A digest of the `length` words from each start."""
    out = np.full(len(start), length, np.uint64)
    for k in range(length):
        out = mix(out ^ code[start + k])
    return out.view(np.int64)


def patterns(items: DataFrame, item_id: str, text: str, min_words: int) -> DataFrame:
    """run (digest), words (as one text), item_id: every run of an item once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, str, int]] = []
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = folded_words(t)
                n = max(0, len(words) - min_words + 1)
                runs = run_codes(word_codes(words), np.arange(n), min_words).tolist()
                rows += {(r, " ".join(words[i : i + min_words]), item) for i, r in enumerate(runs)}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], ["run", "words", "item_id"])

    held = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(text).alias("t"))
    return materialize(held.mapInArrow(scan, "run bigint, words string, item_id bigint"), "patterns")


def tables(runs: DataFrame, min_words: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The shift of each block, and whether it begins a pattern."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if not texts:
                continue
            words = word_codes([w for t in texts for w in t.split(" ")]).reshape(len(texts), min_words)
            keys = np.stack([block_codes(words[:, j : j + 2].ravel(), bits)[::2] for j in range(min_words - BLOCK + 1)], axis=1)
            shift = np.broadcast_to(np.arange(min_words - BLOCK, -1, -1), keys.shape)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(shift.ravel())], ["block", "shift"])

    found = runs.select("words").mapInArrow(scan, "block bigint, shift bigint").groupBy("block").agg(F.min("shift").alias("shift"), F.max("shift").alias("most"))
    told = found.select("block", F.col("shift").cast("tinyint"), F.col("most").cast("tinyint")).toArrow()  # at most 2^bits rows of 10 bytes
    shift, begins = np.full(1 << bits, min_words - BLOCK + 1, np.int8), np.zeros(1 << bits, bool)
    at = told.column("block").to_numpy()
    shift[at] = told.column("shift").to_numpy()
    begins[at] = told.column("most").to_numpy() == min_words - BLOCK
    return shift, begins


def search(code: np.ndarray, ends: np.ndarray, shift: np.ndarray, begins: np.ndarray, min_words: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place of the first word) of the windows to look up, over the words of some texts; all texts move on together."""
    if len(code) < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = block_codes(code, bits)
    at = np.concatenate([[0], ends[:-1]]) + min_words - BLOCK  # where each text's window has its last block
    text = np.arange(len(ends))
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        inside = at + BLOCK <= ends[text]
        at, text = at[inside], text[inside]
        if not len(at):
            break
        move = shift[keys[at]]
        stop = np.flatnonzero(move == 0)
        stop = stop[begins[keys[at[stop] - (min_words - BLOCK)]]]
        if len(stop):
            hits.append((text[stop], at[stop] - (min_words - BLOCK)))
        at = at + np.maximum(move, 1)
    return tuple(np.concatenate([h[k] for h in hits]) if hits else np.zeros(0, np.int64) for k in (0, 1))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = 12, bits: int | None = None, block_chars: int = 1 << 22) -> DataFrame:
    """doc_id, item_id of each document that contains at least `min_words` consecutive words of an item. `bits` is the size
    of the tables, by default some 32 blocks a pattern."""
    runs = patterns(items, item_id, item_text, min_words)
    if bits is None:
        bits = min(MOST_BITS, max(FEWEST_BITS, math.ceil(math.log2(32 * (runs.count() + 1)))))
    sent = docs.sparkSession.sparkContext.broadcast(tables(runs, min_words, bits))
    kind = dict(docs.dtypes)[doc_id]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, begins = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in blocks(texts, block_chars):
                words: list[str] = []
                ends = []
                for t in texts[lo:hi]:
                    words += folded_words(t)
                    ends.append(len(words))
                code = word_codes(words)
                where, start = search(code, np.array(ends), shift, begins, min_words, bits)
                run = run_codes(code, start, min_words)
                first = np.unique(np.stack([where, run]), axis=1, return_index=True)[1] if len(run) else np.zeros(0, np.int64)
                told = [" ".join(words[i : i + min_words]) for i in start[first].tolist()]
                ids = batch.column(0).take(pa.array(lo + where[first]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(run[first]), pa.array(told, pa.string())], ["doc_id", "run", "told"])

    stopped = docs.select(doc_id, text).mapInArrow(scan, f"doc_id {kind}, run bigint, told string")
    return stopped.join(small(runs), "run").filter("told = words").select("doc_id", "item_id").distinct()


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Of each item, how many documents contain it; items that leaked nowhere count 0."""
    counts = found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc_id"))
    return items.select("item_id", "category").join(counts, "item_id", "left").fillna(0, ["n_docs"])
