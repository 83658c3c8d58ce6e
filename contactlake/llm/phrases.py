"""Substring dedup by repeated-phrase automata: recurring passages confirmed, compiled, and looked for in all documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Layout, covered, numbered, parts_of, repeated_ranges
from .shingles import WordHashes, mix


def confirmed(documents: list[list[list[str]]], window: int) -> set[str]:
    """Phrases of `window` words that two of the documents have; a document is a list of passages of words."""
    once: set[str] = set()
    recurring: set[str] = set()
    for passages in documents:
        own = {" ".join(words[i : i + window]) for words in passages for i in range(len(words) - window + 1)}
        recurring |= once & own
        once |= own
    return recurring


def occurrences(rows: list[tuple], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, lo, hi) of windows in rows of (h, uid, lo, data) whose words also occur in a document with a smaller uid.

    Phrases of `window` words that two documents have are confirmed and compiled into one automaton. All rows stream
    through it by ascending uid: the document in which it first meets a phrase keeps it, all later places are reported.
    """
    rows = sorted(rows, key=itemgetter(1))
    texts = [(uid, lo, data.decode("latin-1").split(" ")) for _, uid, lo, data in rows]
    recurring = confirmed([[words for _, _, words in same] for _, same in groupby(texts, itemgetter(0))], window)
    if not recurring:
        return (np.empty(0, np.int64),) * 3
    automaton = ahocorasick.Automaton()
    for number, phrase in enumerate(recurring):
        automaton.add_word(f" {phrase} ", (number, len(phrase)))
    automaton.make_automaton()
    keeper: dict[int, int] = {}
    out = []
    for uid, lo, words in texts:
        line = " " + " ".join(words) + " "
        hits = [end - size - 1 for end, (number, size) in automaton.iter(line) if keeper.setdefault(number, uid) < uid]
        if hits:
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = {int(e - len(w)): i for i, (e, w) in enumerate(zip(ends, words, strict=True))}
            out += [(uid, lo + starts[h + 1]) for h in hits]
    found = np.array(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1], found[:, 1]


def remove_repeated_phrases(docs: DataFrame, window: int = 13, gram: int = 5, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) for every row of docs.

    Words are what ASCII blanks separate, unchanged. A word is removed if a window of `window` words covers it whose
    words also start in a document with a smaller id; windows are judged on the input. kept: words left, joined by
    one space.

    Documents' passages are dealt to automata by anchor (see repeats): text without an anchor that another document
    has can hold no recurring phrase, so each passage meets the one automaton that can match it. Runs of
    windows with one anchor that recur as a whole are told by 128 bits of hashes before that.

    A null text has no words. Rows with the same id and text are one document; with the same id and other text they
    are ordered by the text's hash, as if ids differed; a null id comes before all others. Other columns are ignored.
    An empty table gives an empty result.
    """
    lay = Layout(window=window, gram=gram, within=False)

    def symbols():
        hashes = WordHashes()
        return lambda text: mix(hashes.of(text.split()))

    def cut(text: bytes, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
        words = text.split()
        return [b" ".join(words[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]

    def engine(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return occurrences(rows, window)

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for i, text, lo, hi in parts_of(batch):
                words = text.split()
                left = words
                if len(lo):
                    left = [w for w, g in zip(words, covered(lo, hi, window, len(words)).tolist(), strict=True) if not g]
                kept = b" ".join(left)
                out.append((i, len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            if out:
                columns = list(zip(*out, strict=True))[: 5 if with_text else 4]
                types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(columns)])

    found = repeated_ranges(numbered(docs, id_col, text_col), lay, symbols, cut, engine)
    return found.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept binary" * with_text)
