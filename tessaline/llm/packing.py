"""Sum-of-squares online packing of tokenised documents into windows.

The open windows of a task are counted by fill level in an array. Each document goes to the level that leaves the least sum
of squared counts, a new window being level 0. Documents longer than a window first fill whole windows. When a task ends, the pieces
of the windows still open are placed anew by the same rule, the longest first, as long as that fills windows; what is open then is re-cut
into full ones, so that a task pads at most its last window.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import keyed

WINDOW = 1024
#: The split before the merges of the byte-level vocabulary: a fixed value of its format.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 0


#: Characters that every regular expression engine sorts alike: ASCII, Latin, Greek, Cyrillic, kana, Han and Hangul.
PLAIN = r"[^\t\n\x20-\x7e\u00a1-\u024f\u0391-\u03c9\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"
_loaded: dict[str, tuple] = {}


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Ranks by bytes of a byte-level vocabulary, whose tokens write each byte as a printable character.

    Printable Latin-1 bytes stand for themselves, and the others for the characters from 256 on, in order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    return {bytes(of[c] for c in token): i for token, i in vocabulary.items() if all(c in of for c in token)}


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Ids of the tokenizers library's file at ``path``, as little-endian unsigned 32-bit bytes.

    The vocabulary is loaded by tokenizers and its merges are run by tiktoken, which gives the same ids in a quarter of the time.
    Texts with characters about which the two libraries' splits may differ go to tokenizers itself, and so does the first text of
    every batch: should it ever differ, the process uses tokenizers alone.
    """
    import os
    import re
    from array import array

    import tiktoken
    from tokenizers import Tokenizer

    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already gives each core a task
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True  # their strings in a text are ordinary text
        special = {t.content for t in tok.get_added_tokens_decoder().values()}
        ranks = byte_ranks({t: i for t, i in tok.get_vocab().items() if t not in special})
        _loaded[path] = tok, tiktoken.Encoding("from file", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})
    tok, fast = _loaded[path]
    odd = re.compile(PLAIN).search

    def exact(text: str) -> bytes:
        return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(texts: list[str]) -> list[bytes]:
        nonlocal fast
        out = []
        for i, t in enumerate(texts):
            if fast is None or odd(t):
                out.append(exact(t))
                continue
            out.append(np.array(array("I", fast.encode_ordinary(t)), "<u4").tobytes())
            if i == 0 and out[0] != exact(t):
                fast, out[0] = None, exact(t)
        return out

    return encode


class Levels:
    """Open windows by fill level, and the pieces they hold."""

    def __init__(self, window: int = WINDOW):
        self.window, self.counts, self.open, self.made = window, np.zeros(window + 1, np.int64), [[] for _ in range(window + 1)], 0

    def best(self, size: int) -> int:
        """The level whose choice adds least to the sum of squares; ties go to the fullest."""
        n, top = self.counts, self.window - size
        cost = 2 * n[size:] + 1  # the level reached gains a window,
        cost[top] = 0  # unless that one is then full
        cost[1:] += 1 - 2 * n[1 : top + 1]  # and the level left loses one
        usable = n[: top + 1] > 0
        usable[0] = True
        return top - int(np.where(usable, cost, np.iinfo(np.int64).max)[::-1].argmin())

    def place(self, piece: tuple, size: int) -> list | None:
        """Adds a piece of at most one window; the pieces of its window if that is now full."""
        level = self.best(size)
        pieces = self.open[level].pop() if level else []
        self.counts[level] -= level > 0
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.counts[level + size] += 1
        self.open[level + size].append(pieces)
        return None

    def leftovers(self) -> list[list]:
        """The open windows: their pieces placed anew as long as that fills some, then those at a power of two as they are, the others re-cut."""
        done, last = [], self
        while True:
            pieces = sorted((p for windows in last.open for w in windows for p in w), key=lambda p: -len(p[2]))
            again = Levels(self.window)
            filled = [full for p in pieces if (full := again.place(p, len(p[2]) // 4)) is not None]
            if not filled:
                break
            done, last = done + filled, again
        self.replaced, loose = len(done), []
        for level in range(1, self.window):
            if level & (level - 1) == 0:
                done += last.open[level]
            else:
                loose += [p for pieces in last.open[level] for p in pieces]
        fill, cur = 0, []
        for row, start, ids in loose:
            while ids:
                cut = ids[: 4 * (self.window - fill)]
                cur.append((row, start, cut))
                fill, start, ids = fill + len(cut) // 4, start + len(cut) // 4, ids[len(cut) :]
                if fill == self.window:
                    done.append(cur)
                    fill, cur = 0, []
        return done + ([cur] if cur else [])


def _packer(path: str, window: int, end_id: int):
    import pyarrow as pa

    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = pa.schema([(n, pa.int64()) for n in names])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode, levels, sequence = encoder(path), Levels(window), TaskContext.get().partitionId() << 36

        def rows(windows: list[list]) -> pa.RecordBatch:
            nonlocal sequence
            out: list[list] = [[] for _ in names]
            for pieces in windows:
                at = 0
                for (doc_id, tokens), start, ids in pieces:
                    for column, value in zip(out, (doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, at), strict=True):
                        column.append(value)
                    at += len(ids) // 4
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

        for batch in batches:
            full = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                ids += end
                row, whole = (doc_id, len(ids) // 4), len(ids) // (4 * window)
                full += [[(row, k * window, ids[4 * k * window : 4 * (k + 1) * window])] for k in range(whole)]
                if rest := ids[4 * whole * window :]:
                    if (pieces := levels.place((row, whole * window, rest), len(rest) // 4)) is not None:
                        full.append(pieces)
            yield rows(full)
        yield rows(levels.leftovers())

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A null or empty text is its end id alone. Repeated rows are packed each for itself, a null id stays null, other columns
    are ignored and an empty table gives no pieces. A text of any length is encoded whole and cut into windows. Windows never span tasks: what a task holds in memory is its open
    windows, whose number the sum of squares keeps far below the number of documents.
    """
    from .common import bounded_batches

    bounded_batches(docs.sparkSession)
    return keyed(docs, "doc_id", "text", doc_id="long").mapInArrow(_packer(tokenizer, window, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
