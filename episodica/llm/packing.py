"""Hierarchical multi-length packing.

Every document is cut into whole long windows and one remainder; the remainder goes to the tier with the
smallest context that holds it. Long windows are opened by their own tier's remainders and their gaps are
filled from the shorter tiers, then the shorter tiers are packed the same way. What is left at the end of
a chunk is cut into powers of two. Sequences are then dealt to step groups of near equal tokens.

Each task packs its own rows in chunks of bounded size while it streams, so there is no shuffle, nothing
is gathered, and a lost task is done again from its file split alone.
"""

from __future__ import annotations

import heapq
import os
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Memo, freed, kept_by_worker, laid_out, pick, slices, struct, text_or_empty

CONTEXT = 4096
TIERS = (512, 1024, 2048)
EOS = 2
#: A chunk ends when it holds so many tokens, 16 MB of ids, or so many documents.
CHUNK_TOKENS, CHUNK_ROWS = 1 << 22, 1 << 16
#: Runs that a worker remembers in each of two generations (some 60 MB in all), and the longest.
MEMO_RUNS, MEMO_LETTERS = 150_000, 40
#: Rows and bytes of text whose new words are encoded together.
SLICE = 1024, 4 << 20

Piece = tuple[int, int, int]


class WordIds:
    """Ids of texts as unsigned 32-bit integers.

    The tokenizer drops white space before it splits, and nothing it does looks across white space, so a
    text's ids are its words' ids one after the other. It lower-cases words and splits them into runs of
    letters, single digits and runs of the rest; for words of plain Latin letters and ASCII that is done here.
    Arrow splits and numbers the distinct words and runs, so Python sees each distinct run of a slice once; what
    it does not remember is encoded by the library. Every other word goes to the library as it is.
    """

    #: Words for which lower-casing and the pattern below do what the library does.
    PLAIN = "^[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
    #: Fixed value: how this vocabulary splits lower-case words.
    RUNS = "('s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+)"
    #: Fixed value: what the last token of a run ends in.
    SUFFIX = "</w>"
    #: Runs and words that the library gets at once.
    TOGETHER = 128

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(tokenizer_path), Memo(MEMO_RUNS)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(self.SUFFIX)]] = True

    def library(self, parts: list[str]) -> Iterator[bytes]:
        for k in range(0, len(parts), self.TOGETHER):
            for e in self.tokenizer.encode_batch_fast(parts[k : k + self.TOGETHER], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()

    def together(self, runs: list[str]) -> Iterator[bytes]:
        """Ids of runs, which are encoded as one text, with spaces between: each ends at a token that ends a run."""
        for k in range(0, len(runs), self.TOGETHER):
            part = runs[k : k + self.TOGETHER]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
            if len(ends) == len(part):
                raw, at = ids.tobytes(), 0
                for end in ends.tolist():
                    yield raw[at:end]
                    at = end
            else:
                yield from self.library(part)

    def learn(self, runs: list[str]) -> list[bytes]:
        """Ids of distinct runs."""
        out = list(map(self.memo.known, runs))
        new = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(new, self.together([runs[k] for k in new]), strict=True):
            out[k] = ids
            if len(runs[k]) <= MEMO_LETTERS:
                self.memo.put(runs[k], ids)
        return out

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, and where each word's begin and how many they are."""
        plain = pc.and_(pc.match_substring_regex(words, self.PLAIN), pc.invert(pc.match_substring(words, "<|")))
        split = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(pc.replace_substring_regex(pc.utf8_lower(words.filter(plain)), self.RUNS, "\\1 ")))
        runs = split.flatten().dictionary_encode()
        own = self.learn(runs.dictionary.to_pylist())
        sizes = np.fromiter((len(x) // 4 for x in own), np.int64, len(own))
        ids, ends = laid_out(np.frombuffer(b"".join(own), "<u4"), np.cumsum(sizes) - sizes, sizes, runs.indices.to_numpy())
        borders = ends[split.offsets.to_numpy() - (split.offsets[0].as_py() if len(split) else 0)]
        odd = list(self.library(words.filter(pc.invert(plain)).to_pylist()))
        length = np.empty(len(words), np.int64)
        is_plain = plain.to_numpy(zero_copy_only=False)
        length[is_plain], length[~is_plain] = np.diff(borders), [len(x) // 4 for x in odd]
        start = np.empty(len(words), np.int64)
        start[is_plain], start[~is_plain] = borders[:-1], len(ids) + np.cumsum(length[~is_plain]) - length[~is_plain]
        return np.concatenate((ids, np.frombuffer(b"".join(odd), "<u4"))), start, length

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one after the other, and where each text begins among them and where the last ends."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids, ends = laid_out(*self.of_words(words.dictionary), words.indices.to_numpy())
        return ids, ends[split.offsets.to_numpy() - split.offsets[0].as_py()]


class Pool:
    """Remainders of one tier by length."""

    def __init__(self) -> None:
        self.mask, self.items = 0, {}  # bit n: something of length n is there

    def add(self, length: int, doc: int, start: int) -> None:
        self.items.setdefault(length, []).append((doc, start))
        self.mask |= 1 << length

    def take(self, length: int) -> tuple[int, int, int]:
        items = self.items[length]
        doc, start = items.pop()
        if not items:
            self.mask ^= 1 << length
        return length, doc, start

    def at_most(self, length: int) -> tuple[int, int, int] | None:
        mask = self.mask & ((2 << length) - 1)
        return self.take(mask.bit_length() - 1) if mask else None

    def longest(self) -> tuple[int, int, int]:
        return self.take(self.mask.bit_length() - 1)


def plan(lengths: list[int], context: int = CONTEXT, tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences of (document, start, length); each token is in exactly one piece."""
    sizes = sorted({*tiers, context})
    pools = {size: Pool() for size in sizes}
    out: list[list[Piece]] = []

    def route(doc: int, start: int, length: int) -> None:
        pools[sizes[bisect_left(sizes, length)]].add(length, doc, start)

    for doc, n in enumerate(lengths):
        whole = n - n % context
        out += [[(doc, start, context)] for start in range(0, whole, context)]
        if n > whole:
            route(doc, whole, n - whole)
    rest: list[list[Piece]] = []
    for k in range(len(sizes) - 1, -1, -1):
        size, own = sizes[k], pools[sizes[k]]
        while own.mask:
            length, doc, start = own.longest()
            window, gap = [(doc, start, length)], size - length
            while gap:
                fits = next((x for s in reversed(sizes[: k + 1]) if (x := pools[s].at_most(gap))), None)
                if fits:
                    length, doc, start = fits
                    window.append((doc, start, length))
                    gap -= length
                    continue
                donor = next((pools[s] for s in sizes[: k + 1] if pools[s].mask), None)
                if donor is None:
                    break
                length, doc, start = donor.longest()
                window.append((doc, start, gap))
                route(doc, start + gap, length - gap)
                gap = 0
            (rest if gap else out).append(window)
    for window in rest:
        out += powers(window)
    return out


def powers(window: list[Piece]) -> list[list[Piece]]:
    """Cut an unfilled window into sequences whose lengths are powers of two, the longest first."""
    out, queue = [], window[::-1]
    left = sum(x[2] for x in window)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        sequence: list[Piece] = []
        while room:
            doc, start, length = queue.pop()
            take = min(room, length)
            sequence.append((doc, start, take))
            if take < length:
                queue.append((doc, start + take, length - take))
            room -= take
        out.append(sequence)
    return out


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """Deal sequences to steps, the longest first, each to the step with the fewest tokens so far."""
    if not sizes:
        return []
    heap = [(0, k) for k in range(max(1, -(-sum(sizes) // step_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, k = heap[0]
        out[i] = k
        heapq.heapreplace(heap, (load + sizes[i], k))
    return out


def pack(docs: DataFrame, tokenizer_path: str, context: int = CONTEXT, tiers: tuple[int, ...] = TIERS, eos: int = EOS, steps_of: int = 8, with_ids: bool = False, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most ``context`` tokens, a row for each piece.

    ``start``: ids of its document before the piece; ``offset``: ids before it in its sequence;
    ``sequence_length`` and ``padded_length`` (a power of two stays as it is, anything else goes to
    ``context``); ``step_group``: sequences of one step, ``steps_of`` x ``context`` tokens or near it.
    ``with_ids`` adds the ids themselves (little-endian unsigned 32-bit).

    Null and empty texts are documents of the end id alone. A null doc_id is kept. Repeated rows are packed
    each by itself. An empty table gives no rows. Very long texts are cut into windows like any other. Other columns, also of clashing names, are not read.
    """
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, padded_length long, tier long, step_group long" + ", ids binary" * with_ids
    schema = struct(ddl)
    key = ("packing", tokenizer_path)
    arrow, end, step_tokens = to_arrow_schema(schema), eos.to_bytes(4, "little"), steps_of * context

    def run(batches):
        freed(key)
        words = kept_by_worker(key, lambda: WordIds(tokenizer_path))
        task = TaskContext.get().partitionId() << 36
        sequences = steps = held = 0
        ids: list[int | None] = []
        tokens: list[bytes] = []

        def emit():
            nonlocal sequences, steps
            lengths = [len(t) // 4 for t in tokens]
            packed = plan(lengths, context, tiers)
            sizes = [sum(p[2] for p in s) for s in packed]
            group = step_groups(sizes, step_tokens)
            rows = []
            for s, (pieces, size) in enumerate(zip(packed, sizes, strict=True)):
                offset = 0
                for doc, start, length in pieces:
                    part = memoryview(tokens[doc])[4 * start : 4 * (start + length)]
                    row = (ids[doc], start, length, zlib.crc32(part), lengths[doc], task + sequences + s, offset, size, size if size & (size - 1) == 0 else context, 1 << (size - 1).bit_length(), task + steps + group[s])
                    rows.append((*row, bytes(part)) if with_ids else row)
                    offset += length
            sequences += len(packed)
            steps += max(group, default=-1) + 1
            for k in range(0, len(rows), 8192):
                yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, map(list, zip(*rows[k : k + 8192], strict=True)), strict=True)), schema=arrow)

        for batch in batches:
            for part in slices(batch, *SLICE):
                found, bounds = words.of(part.column(1))
                raw, bounds = memoryview(found.tobytes()), (4 * bounds).tolist()
                for doc, at, to in zip(part.column(0).to_pylist(), bounds, bounds[1:]):
                    ids.append(doc)
                    tokens.append(bytes(raw[at:to]) + end)
                    held += len(tokens[-1]) // 4
                    if held >= chunk_tokens or len(ids) >= CHUNK_ROWS:
                        yield from emit()
                        ids, tokens, held = [], [], 0
        yield from emit()

    rows = pick(docs, "doc_id", "text")
    return rows.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)
