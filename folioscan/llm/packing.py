"""Sum-of-squares online packing of tokenised documents into windows."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 2048
END_ID = 1
#: Windows left open at the end are cut at powers of two down to this length.
SHORTEST = 64

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Characters below this code point are tokenised by the short way.
LATIN = 0x180


def _byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class LatinIds:
    """Ids of texts of the first code points, by the tokenizer file's own vocabulary and merges on a plain merge engine.

    A word's end mark is a byte of its own here, which merges with the byte before it ahead of all other merges; ranks are
    the file's order of merges. Words are split and lower-cased as the file says, which is easy for these characters: none is
    changed by normalisation, and their classes are fixed.
    """

    def __init__(self, tokenizer_path: str):
        import tiktoken

        with open(tokenizer_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, suffix, byte_of = model["vocab"], model["end_of_word_suffix"], _byte_characters()
        tokens = [*byte_of, *(c + suffix for c in byte_of)]
        tokens += ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ranks: dict[bytes, int] = {b"\0": 0}
        ids = [0]
        for token in tokens:
            ends = token.endswith(suffix) and token != suffix
            raw = bytes(byte_of[c] for c in (token[: -len(suffix)] if ends else token)) + b"\0" * ends
            if ranks.setdefault(raw, len(ids)) == len(ids):
                ids.append(vocabulary[token])
        self.ids = np.asarray(ids, "<u4")
        self.engine = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        kinds: dict[str, list[str]] = {}
        for c in map(chr, range(LATIN)):
            kinds.setdefault(unicodedata.category(c)[0], []).append(re.escape(c))
        letters, numbers = "".join(kinds["L"]), "".join(kinds["N"])
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\t-\r \x85\xa0{letters}{numbers}]+")
        self.odd = re.compile(f"[^\x01-{chr(LATIN - 1)}]|<\\|")

    def of(self, text: str) -> bytes | None:
        """The ids as little-endian unsigned 32-bit bytes; None for a text with other characters or special tokens."""
        if self.odd.search(text):
            return None
        words = self.words.findall(text.lower())
        return self.ids[self.engine.encode_to_numpy("\0".join(words) + "\0")].tobytes() if words else b""


class ChunkIds:
    """Texts' ids as little-endian unsigned 32-bit bytes.

    Texts that LatinIds can't tokenise are split at white space: the tokenizer collapses it and never joins pieces across it, so a
    text's ids are those of its chunks in order. Chunks that aren't Latin and not met before are encoded together, in one text
    with spaces between, and told apart by the places of their ids. The memo is emptied when full, which changes speed only.
    """

    def __init__(self, tokenizer_path: str, most: int = 50_000):
        self.path, self.tokenizer = tokenizer_path, None
        self.latin = LatinIds(tokenizer_path)
        self.memo: dict[bytes, bytes] = {}
        self.most = most

    def _learn(self, chunks: list[bytes]) -> None:
        if self.tokenizer is None:  # most tasks need it for no text
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        texts = [c.decode() for c in chunks]
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.asarray(found.ids, "<u4")
        at = np.fromiter((o[0] for o in found.offsets), np.int64, len(ids))
        cuts = np.searchsorted(at, starts)
        whole = ids.tobytes()
        self.memo.update((c, whole[4 * i : 4 * j]) for c, i, j in zip(chunks, cuts[:-1].tolist(), cuts[1:].tolist()))

    def of_all(self, texts: list[str | None]) -> Iterator[bytes]:
        found = [self.latin.of(t or "") for t in texts]
        split = {i: (t or "").encode("utf-8", "replace").split() for i, t in enumerate(texts) if found[i] is None}
        if len(self.memo) >= self.most:
            self.memo.clear()
        missing = list(set().union(*split.values()).difference(self.memo))
        for at in range(0, len(missing), 300):
            self._learn(missing[at : at + 300])
        get = self.memo.__getitem__
        for i, ids in enumerate(found):
            yield b"".join(map(get, split[i])) if ids is None else ids


class SumOfSquares:
    """Windows by fill level: counts[h] windows hold h ids, 0 < h < window.

    A piece of s ids goes to the level h (0: a new window) for which the sum of squared counts over all levels
    grows least; of equal levels the fullest. A window that becomes full leaves the array.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.at: list[list] = [[] for _ in range(window)]

    def place(self, size: int) -> int:
        """The level that a piece of this size goes to; size < window."""
        room = self.window - size
        # Moving a window from level h to h + s changes the sum by 2 * (N[h + s] - N[h]) + 2; from or to an
        # end of the array (new or full) one of both terms is missing.
        change = 2 * (self.counts[size : self.window + 1] - self.counts[: room + 1]) + 2
        change[0] = 2 * self.counts[size] + 1
        change[room] = 1 - 2 * self.counts[room] if room else change[room]
        open_levels = self.counts[: room + 1] > 0
        open_levels[0] = True
        change[~open_levels] = np.iinfo(np.int64).max
        return room - int(np.argmin(change[::-1]))

    def add(self, size: int, item) -> list | None:
        """Put the item in; the items of its window if that is now full, else None."""
        level = self.place(size)
        if level:
            self.counts[level] -= 1
            held = self.at[level].pop()
        else:
            held = []
        held.append(item)
        if level + size == self.window:
            return held
        self.counts[level + size] += 1
        self.at[level + size].append(held)
        return None

    def open_windows(self) -> Iterator[list]:
        """Items of the windows left, fullest first."""
        for level in range(self.window - 1, 0, -1):
            yield from self.at[level]


class Packer:
    """Packs one stream of documents; rows() gives the pieces of the sequences that are complete so far."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.window, self.next_sequence = window, first_sequence
        self.fill = SumOfSquares(window)
        self.out: list[tuple] = []
        #: Ids in whole windows of their own, in windows where the sum of squares put them, and in sequences of rests.
        self.whole = self.placed = self.joined = 0

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, zlib.crc32(ids), total, self.next_sequence, offset))
            offset += n
        self.next_sequence += 1

    def add(self, doc_id, ids: bytes) -> None:
        """Whole windows of a long document leave at once; what remains is placed by its size."""
        total, step = len(ids) // 4, 4 * self.window
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            self._emit([(doc_id, at // 4, ids[at : at + step], total)])
            self.whole += self.window
        if whole < len(ids):
            rest = ids[whole:]
            full = self.fill.add(len(rest) // 4, (doc_id, whole // 4, rest, total))
            if full:
                self._emit(full)
                self.placed += self.window

    def close(self) -> None:
        """Cut the windows still open at powers of two; what is left of each below SHORTEST joins others' rests.

        So each piece stays with those it was placed with, sequences need no padding, and only the rests are put together anew.
        """
        rests: list[tuple] = []
        for held in self.fill.open_windows():
            pieces = held[::-1]
            left = sum(len(p[2]) for p in pieces) // 4
            self.placed += left
            while left >= SHORTEST:
                left -= self._cut(pieces, 1 << (left.bit_length() - 1))
            rests += pieces
        left = sum(len(p[2]) for p in rests) // 4
        self.placed -= left
        self.joined += left
        rests.reverse()
        while left:
            left -= self._cut(rests, self.window if left >= self.window else 1 << (left.bit_length() - 1))
        self.fill = SumOfSquares(self.window)

    def _cut(self, pieces: list[tuple], size: int) -> int:
        """Emit the first `size` ids of a stack of pieces as a sequence; what remains of the last one goes back."""
        held, room = [], size
        while room:
            doc_id, start, ids, total = pieces.pop()
            n = min(room, len(ids) // 4)
            held.append((doc_id, start, ids[: 4 * n], total))
            if 4 * n < len(ids):
                pieces.append((doc_id, start + n, ids[4 * n :], total))
            room -= n
        self._emit(held)
        return size

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _batches(rows: list[tuple], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PIECES.split(", ")]
    for at in range(0, len(rows), 50_000):
        columns = list(zip(*rows[at : at + 50_000]))
        arrays = [pa.array(columns[0], id_type)] + [pa.array(c, pa.int64()) for c in columns[1:]]
        yield pa.RecordBatch.from_arrays(arrays, names)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each task packs the rows of its own partition, so nothing is shuffled and a lost task repeats exactly: the
    state is one count and the open windows' pieces per fill level. Sequences are full windows; windows
    that a partition leaves open are cut at powers of two, so no sequence needs padding. A
    document's ids end with end_id; null and empty text give that id alone. Repeated rows are packed as often as
    they occur, null ids stay null, an empty table gives no rows and other columns are not read.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer((context.partitionId() if context else 0) << 36, window)
        memo = ChunkIds(tokenizer_path)
        id_type = pa.int64()
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                for doc_id, ids in zip(batch.column(0).to_pylist(), memo.of_all(batch.column(1).to_pylist())):
                    packer.add(doc_id, ids + end)
            yield from _batches(packer.rows(), id_type)
        packer.close()
        yield from _batches(packer.rows(), id_type)

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(run, PIECES)
