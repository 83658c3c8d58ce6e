"""Suffix-array dedup: difference-cover suffix sorting of the text under shared anchors, adjacent prefixes compared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Layout, covered, numbered, parts_of, repeated_ranges
from .shingles import mix

U = np.uint64
_BYTES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of s (integers from 1, under 2^21 of them and of their values) in order, by the cover {1, 2} mod 3.

    Triples at sampled places are sorted and named; names that repeat are sorted as a text of their own; the
    remaining suffixes are sorted by first symbol and the rank behind it, and merged in by two binary searches.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(U), np.zeros(3, U)])
    at1, at2 = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # with a sentinel place at n if n is 1 mod 3
    at = np.concatenate([at1, at2])
    t = np.concatenate([t, np.zeros(3, U)])
    triple = (t[at] << U(42)) | (t[at + 1] << U(21)) | t[at + 2]
    order = np.argsort(triple, kind="stable")
    put = triple[order]
    name = np.cumsum(np.concatenate([[1], put[1:] != put[:-1]]))
    names = np.empty(len(at), np.int64)
    names[order] = name
    if name[-1] < len(at):
        order = suffix_array(names)
        names[order] = np.arange(1, len(at) + 1)
    rank = np.zeros(n + 4, U)
    rank[at] = names
    sampled = at[order]
    at0 = np.arange(0, n, 3)
    key0 = (t[at0] << U(21)) | rank[at0 + 1]
    order0 = np.argsort(key0, kind="stable")
    at0, key0 = at0[order0], key0[order0]
    sampled = sampled[sampled < n]
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    key1 = (t[ones] << U(21)) | rank[ones + 1]
    key2 = (t[twos] << U(42)) | (t[twos + 1] << U(21)) | rank[twos + 2]
    key02 = (t[at0] << U(42)) | (t[at0 + 1] << U(21)) | rank[at0 + 2]
    place = np.arange(len(at0)) + np.searchsorted(key1, key0) + np.searchsorted(key2, key02)
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[place] = False
    out[place] = at0
    out[free] = sampled
    return out


def repeated_windows(rows: list[tuple], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, lo, hi) of windows in rows of (h, uid, lo, data) that equal one that starts earlier, by uid and place."""
    lengths = np.array([len(r[3]) for r in rows])
    text = np.frombuffer(b"\0".join(r[3] for r in rows) + b"\0" * (window + 8), np.uint8)
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    n = int(first[-1] + lengths[-1])
    symbols = text[:n].astype(np.int64) + 2
    symbols[first[1:] - 1] = 1
    counts = np.maximum(lengths - window + 1, 0)
    starts = np.zeros(n, bool)
    where = np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)
    starts[where] = True
    order = suffix_array(symbols)
    order = order[starts[order]]
    eights = np.lib.stride_tricks.sliding_window_view(text, 8)
    word = np.ascontiguousarray(eights[:, 0]).astype(U)
    for i in range(1, 8):
        word |= eights[:, i].astype(U) << U(8 * i)
    same = np.ones(max(0, len(order) - 1), bool)
    for d in [*range(0, window - 8, 8), window - 8]:
        same &= word[order[1:] + d] == word[order[:-1] + d]
    group = np.cumsum(np.concatenate([[0], ~same]))
    row = np.searchsorted(first, order, side="right") - 1
    uid = np.array([r[1] for r in rows], np.int64)[row]
    lo = np.array([r[2] for r in rows], np.int64)[row] + order - first[row]
    by = np.lexsort((lo, uid, group))
    group, uid, lo = group[by], uid[by], lo[by]
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))[group]
    again = (uid > uid[head]) | ((uid == uid[head]) & (lo > lo[head]))
    return uid[again], lo[again], lo[again]


def remove_repeated_bytes(docs: DataFrame, window: int = 100, gram: int = 32, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of docs.

    A byte is removed if a string of `window` bytes covers it that also starts earlier: in a document with a smaller
    id, or before in the same. Strings never cross documents; all are judged on the input. n_spans: maximal removed
    runs. kept: the bytes left (a cut may fall within a character).

    Sorting every suffix of the corpus would move several times the input at each level of the recursion, so only
    text that can repeat is sorted: see repeats. That step overlooks no repeat; runs it finds repeated as a whole are
    told by 128 bits of hashes. What it passes on is sorted by difference cover, a chunk of anchors at a time, and
    neighbours are compared over the whole window.

    A null text is empty. Rows with the same id and text are one document; with the same id and other text they are
    ordered by the text's hash; a null id comes before all others. Other columns are ignored. An empty table gives an
    empty result.
    """
    lay = Layout(window=window, gram=gram, within=True)

    def symbols():
        return lambda text: _BYTES[np.frombuffer(text, np.uint8)]

    def cut(text: bytes, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
        return [text[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]

    def engine(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return repeated_windows(rows, window)

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for i, text, lo, hi in parts_of(batch):
                if len(lo):
                    gone = covered(lo, hi, window, len(text))
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                else:
                    kept, spans = text, 0
                out.append((i, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            if out:
                columns = list(zip(*out, strict=True))[: 6 if with_text else 5]
                types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns)])

    found = repeated_ranges(numbered(docs, id_col, text_col), lay, symbols, cut, engine)
    return found.select("uid", "doc_id", "text", "parts").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
