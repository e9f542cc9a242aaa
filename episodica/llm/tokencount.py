"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair tokens.

Of all tokens that end at byte i of a word, exactly one can be the last token of that prefix's encoding:
the one that is compatible with the last token of the prefix before it. So count[i] = count[i - len] + 1,
and a word's counts at all its prefixes cost one pass. Words that recur are looked up. Counts at a
text's prefixes are sums of words' counts, with care for white space and contractions, which split
differently when the text ends inside them.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import Memo, kept_by_worker, laid_out, map_slices, pick, text_or_empty

#: Fixed value: the pattern by which this family of byte-level vocabularies splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 1024
#: Words, and pieces from one space to the next, that a worker remembers in each of two generations, and the longest.
MEMO_WORDS, MEMO_BYTES = 100_000, 40
#: Pairs of tokens, and steps of the automaton, that a worker remembers.
MOST_KNOWN = 400_000
#: Rows and bytes of text that are counted together.
SLICE = 4096, 4 << 20
#: White space side by side; separators that only some engines call white space.
RUNS, ODD = re.compile(r"\s{2,}"), re.compile("[\x1c-\x1f]")
#: The same for Arrow's engine. A single space always begins a word, but not between white space or at the end of it.
WHITE = r"[\t-\r \x{85}\p{Z}]"
SIDE_BY_SIDE, UNCUT = WHITE + "{2}", rf"[\x00\x1c-\x1f]|{WHITE} (?:{WHITE}|\z)"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class PrefixCounter:
    def __init__(self, tokenizer_path: str):
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ids: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for left, right in merges:
            a, b = self.ids[raw(left)], self.ids[raw(right)]
            self.ids[raw(left) + raw(right)] = self.joined[a, b] = len(self.parts)
            self.parts.append((a, b))
        self.specials = [t["content"] for t in spec.get("added_tokens", ())]
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.words = regex.compile(PATTERN)
        self.size = [0] * len(self.parts)
        for token, t in self.ids.items():
            self.size[t] = len(token)
        self.automaton()
        self.pairs: dict[int, bool] = {}
        self.memo = Memo(MEMO_WORDS, self.piece)
        self.word_memo = Memo(MEMO_WORDS, self.whole)
        self.point_memo, self.piece_memo = Memo(MEMO_WORDS, self.points), Memo(MEMO_WORDS)

    def automaton(self) -> None:
        """Which tokens end at a byte: ``step`` leads from node to node (node * 256 + byte), and on from a node that has no such
        child by its ``fail`` node, the longest end of its bytes that is a node too. ``longest``: the longest token that
        a node's bytes end in; ``shorter``: the longest one that a token ends in, itself aside."""
        self.step: dict[int, int] = {}
        self.jump: dict[int, int] = {}
        own, above, depth = [-1], [0], [0]
        for token, t in self.ids.items():
            node = 0
            for b in token:
                nxt = self.step.get(node << 8 | b)
                if nxt is None:
                    nxt = self.step[node << 8 | b] = len(own)
                    own.append(-1)
                    above.append(node << 8 | b)
                    depth.append(depth[node] + 1)
                node = nxt
            own[node] = t
        self.fail, self.longest, self.shorter = [0] * len(own), list(own), [-1] * len(self.parts)
        for v in sorted(range(1, len(own)), key=depth.__getitem__):
            parent, b = above[v] >> 8, above[v] & 255
            self.fail[v] = self.after(self.fail[parent] << 8 | b) if parent else 0
            shorter = self.longest[self.fail[v]]
            if own[v] >= 0:
                self.shorter[own[v]] = shorter
            else:
                self.longest[v] = shorter
        self.jump.clear()

    def after(self, key: int) -> int:
        """The node after a node and a byte."""
        found = self.step.get(key)
        if found is None and (found := self.jump.get(key)) is None:
            node, b = key >> 8, key & 255
            found = self.after(self.fail[node] << 8 | b) if node else 0
            if len(self.jump) > MOST_KNOWN:
                self.jump.clear()
            self.jump[key] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of tokens a and b together gives a and b: undo both tokens' merges, the
        latest first; no merge across the border may come before one that is still to be done."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        joined, parts, limit = self.joined, self.parts, 1 << 60
        while True:
            across = joined.get((a, b))
            if across is not None and across < limit:
                ok = False
                break
            if a > b:
                if a < 256:
                    ok = True
                    break
                limit, a = a, parts[a][1]
            else:
                if b < 256:
                    if a < 256:
                        ok = True
                        break
                    limit, a = a, parts[a][1]
                    continue
                limit, b = b + 1, parts[b][0]
        if len(self.pairs) > MOST_KNOWN:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def word(self, word: bytes) -> list[int]:
        """Counts at byte prefixes 0 to len of one word, which no pattern splits further."""
        nodes, last, count = [0], [-1], [0]
        self.extend(word, nodes, last, count)
        return count

    def extend(self, word: bytes, nodes: list[int], last: list[int], count: list[int]) -> None:
        """Carry nodes, last tokens and counts on from the prefix that they hold to the whole word."""
        step, longest, shorter, size, pairs = self.step, self.longest, self.shorter, self.size, self.pairs
        node = nodes[-1]
        for i in range(len(count), len(word) + 1):
            key = node << 8 | word[i - 1]
            node = step.get(key)
            if node is None:
                node = self.after(key)
            nodes.append(node)
            t = longest[node]
            while before := i - size[t]:
                ok = pairs.get(last[before] << 20 | t)
                if ok is None:
                    ok = self.compatible(last[before], t)
                if ok:
                    break
                t = shorter[t]
            last.append(t)
            count.append(count[before] + 1)

    def learn(self, words: list[str]) -> dict[str, int]:
        """Counts of many words."""
        return {w: count[-1] for w, _, count in self.sweep(words)}

    def sweep(self, words: list[str]) -> Iterator[tuple[str, bytes, list[int]]]:
        """Each word with its counts at byte prefixes, which hold until the next one. In sorted order a word shares
        its first bytes' counts with the one before."""
        before, nodes, last, count = b"", [0], [-1], [0]
        for raw, w in sorted((w.encode(), w) for w in words):
            same, most = 0, min(len(raw), len(before))
            while same < most and raw[same] == before[same]:
                same += 1
            del nodes[same + 1 :], last[same + 1 :], count[same + 1 :]
            self.extend(raw, nodes, last, count)
            yield w, raw, count
            before = raw

    def prepare(self, texts: list[str]) -> None:
        """Learn together what is new in the texts, for their prefixes."""
        self.words_points({w for t in texts for w in self.words.findall(t) if len(w) <= MEMO_BYTES})

    def words_points(self, words: set[str]) -> dict[str, bytes | list[int]]:
        """Words' counts at their code points; what is new is learnt together."""
        out = {w: known for w in words if (known := self.point_memo.known(w)) is not None}
        for w, raw, counts in self.sweep(words - out.keys()):
            out[w] = found = self.of_points(w, raw, counts)
            if len(w) <= MEMO_BYTES:
                self.point_memo.put(w, found)
        return out

    def pieces_points(self, pieces: list[str]) -> list[bytes | None]:
        """Counts at the code points of distinct pieces, from each piece's own beginning; None if a byte is too small."""
        out = list(map(self.piece_memo.known, pieces))
        new = [(k, self.words.findall(pieces[k])) for k, known in enumerate(out) if known is None]
        points = self.words_points({w for _, words in new for w in words})
        for k, words in new:
            if len(words) == 1:
                found = points[words[0]]
                found = found if type(found) is bytes else None
            else:
                own = [points[w] for w in words]
                found = None
                if sum(x[-1] for x in own) < 256 and all(type(x) is bytes for x in own):
                    base, parts = 0, []
                    for x in own:
                        parts.append(bytes([base + c for c in x]) if base else x)
                        base += x[-1]
                    found = b"".join(parts)
            out[k] = found
            if found is not None and len(pieces[k]) <= MEMO_BYTES:
                self.piece_memo.put(pieces[k], found)
        return out

    def stored_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``stored`` of all texts, one after the other, and where each begins and the last ends.

        Texts are cut before single spaces, where a word always begins, and Arrow numbers the distinct pieces; a
        text's counts are its pieces' counts, each on top of what is before it. Texts that cannot be cut so, with
        white space on both sides of a space, special strings, or pieces of 256 tokens, are counted one by one.
        """
        plain = pc.invert(pc.match_substring_regex(texts, UNCUT))
        for special in self.specials:
            plain = pc.and_(plain, pc.invert(pc.match_substring(texts, special)))
        cut = pc.split_pattern(pc.replace_substring(texts, " ", "\x00 "), "\x00")
        coded = cut.flatten().dictionary_encode()
        points = self.pieces_points(coded.dictionary.to_pylist())
        wide = np.fromiter((x is None for x in points), bool, len(points))
        own = [x or b"" for x in points]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        totals = np.fromiter((x[-1] if x else 0 for x in own), np.int64, len(own))
        at, borders = coded.indices.to_numpy(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
        flat, ends = laid_out(np.frombuffer(b"".join(own), np.uint8), np.cumsum(sizes) - sizes, sizes, at)
        upto = np.concatenate(([0], np.cumsum(totals[at])))
        base = upto[:-1] - np.repeat(upto[borders[:-1]], np.diff(borders))
        counts = flat + np.repeat(base, sizes[at])
        good = plain.to_numpy(zero_copy_only=False) & (np.add.reduceat(np.append(wide[at], False), borders[:-1]) == 0)
        together = pc.match_substring_regex(texts, SIDE_BY_SIDE).to_numpy(zero_copy_only=False)
        out, n = [], ends[borders]
        for k in range(len(texts)):
            if not good[k]:
                out.append(self.stored(texts[k].as_py()))
                continue
            x = np.zeros(n[k + 1] - n[k] + 1, "<u4")
            x[1:] = counts[n[k] : n[k + 1]]
            if together[k]:
                for m in RUNS.finditer(texts[k].as_py()):
                    x[m.start() + 1 : m.end() + 1] = x[m.start()] + np.array(list(self.at_points(m[0])), "<u4")
            out.append(x)
        return np.concatenate(out), np.concatenate(([0], np.cumsum([len(x) for x in out])))

    def plain(self, text: str) -> list[int]:
        """Counts at all code point prefixes of a text without special strings."""
        out, base = [0], 0
        for m in self.words.finditer(text):
            w, start, end = m[0], m.start(), m.end()
            own = self.at_points(w)
            if w.isspace():
                # A text that ends inside a run of white space has the whole run so far as one word.
                run = start
                while run and text[run - 1].isspace():
                    run -= 1
                if run == start:
                    out += [base + c for c in own]
                else:
                    before = out[run]
                    out += [before + c for c in self.at_points(text[run:end])[start - run :]]
            else:
                at = len(out)
                out += [base + c for c in own]
                if w[0] == " " and start and text[start - 1].isspace():
                    run = start
                    while run and text[run - 1].isspace():
                        run -= 1
                    out[at] = out[run] + self.at_points(text[run : start + 1])[-1]
            base += own[-1]
        return out

    def stored(self, text: str) -> np.ndarray:
        """``prefixes``, put together from the words' counts at once; white space that stands side by side is one
        word of its own in the prefixes that end in it."""
        memo = self.point_memo
        own = [memo[w] if len(w) <= MEMO_BYTES else self.points(w) for w in self.words.findall(text)]
        if not own or ODD.search(text) or self.special and self.special.search(text) or not all(type(x) is bytes for x in own):
            return np.array(self.prefixes(text), "<u4")
        flat, sizes = np.frombuffer(b"".join(own), np.uint8), np.fromiter(map(len, own), np.int64, len(own))
        totals = flat[np.cumsum(sizes) - 1].astype("<u4")
        out = np.zeros(len(flat) + 1, "<u4")
        out[1:] = np.repeat(np.cumsum(totals, dtype="<u4") - totals, sizes)
        out[1:] += flat
        for m in RUNS.finditer(text):
            out[m.start() + 1 : m.end() + 1] = out[m.start()] + np.array(list(self.at_points(m[0])), "<u4")
        return out

    def whole(self, word: str) -> int:
        return self.word(word.encode())[-1]

    def at_points(self, word: str) -> bytes | list[int]:
        """A word's counts at its code points, from the first."""
        return self.point_memo[word] if len(word) <= MEMO_BYTES else self.points(word)

    def points(self, word: str) -> bytes | list[int]:
        raw = word.encode()
        return self.of_points(word, raw, self.word(raw))

    @staticmethod
    def of_points(word: str, raw: bytes, counts: list[int]) -> bytes | list[int]:
        if len(word) == 3 and word[0] == "'" and word[1].isalpha():  # a contraction; before its end these are two words
            return bytes((1, 2, counts[-1]))
        found = counts[1:] if len(raw) == len(word) else [counts[end] for end in accumulate(len(c.encode()) for c in word)]
        return bytes(found) if len(raw) < 256 else found

    def prefixes(self, text: str) -> list[int]:
        """Counts at all code point prefixes, special strings included: a special string counts as text
        until its last code point, from which on it is one token."""
        out, start = [0], 0
        for m in self.special.finditer(text) if self.special else ():
            base = out[start]
            counts = self.plain(text[start : m.end()])
            full = self.plain(text[start : m.start()])
            out += [base + c for c in counts[1:-1]]
            out.append(base + full[-1] + 1)
            start = m.end()
        return out + [out[start] + c for c in self.plain(text[start:])[1:]]

    def pieces(self, text: str) -> list[str]:
        """The text from one space to the next. A single space always starts a word, so texts are cut before
        single spaces; where spaces stand side by side, the pattern cuts. Special strings stand alone."""
        out: list[str] = []
        start = 0
        for m in [*(self.special.finditer(text) if self.special else ()), None]:
            part = text[start : m.start() if m else len(text)] if start or m else text
            if "  " in part:
                out += self.words.findall(part)
            elif part:
                first, *others = part.split(" ")
                if first:
                    out.append(first)
                out += [" " + x for x in others]
            if m:
                out.append(m[0])
                start = m.end()
        return out

    def counts(self, texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
        """Each text's pieces and their tokens; what is new in the texts is learnt together."""
        split = [self.pieces(t) for t in texts]
        special = set(self.specials)
        new = [(p, [] if p in special else self.words.findall(p)) for p in self.memo.unknown({p for pieces in split for p in pieces})]
        unknown = self.word_memo.unknown({w for _, words in new for w in words})
        now = self.learn(unknown)
        for w, c in now.items():
            if len(w) <= MEMO_BYTES:
                self.word_memo.put(w, c)
        long: dict[str, int] = {}
        for p, words in new:
            c = sum(now[w] if w in now else self.word_memo[w] for w in words) if words else 1
            if len(p) <= MEMO_BYTES:
                self.memo.put(p, c)
            else:
                long[p] = c
        for pieces in split:
            yield pieces, [long[p] if p in long else self.memo[p] for p in pieces] if long else list(map(self.memo.__getitem__, pieces))

    def piece(self, piece: str) -> int:
        return 1 if piece in self.specials else sum(map(self.whole, self.words.findall(piece)))

    def count(self, text: str) -> int:
        return sum(next(self.counts([text]))[1])

    def fits(self, pieces: list[str], counts: list[int], limit: int) -> int:
        """The longest prefix, in code points, that has at most ``limit`` tokens. Only what lies between the
        last border before the limit and the limit is counted prefix by prefix."""
        sums = list(accumulate(counts, initial=0))
        if sums[-1] <= limit:
            return sum(map(len, pieces))
        end = bisect_right(sums, limit)
        k = end - 1
        while k and not (pieces[k][0] == " " and pieces[k][1:2].strip() and not pieces[k - 1][-1].isspace()):
            k -= 1
        tail = self.prefixes("".join(pieces[k:end]))
        return sum(map(len, pieces[:k])) + max(i for i, c in enumerate(tail) if sums[k] + c <= limit)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, with_prefixes: bool = False) -> DataFrame:
    """Tokens of every whole text and the longest prefix within ``limit`` tokens (``fit_chars``).

    ``with_prefixes`` adds ``prefix_counts``: the count at each code point prefix, 0 to n, as little-endian
    unsigned 32-bit integers; any truncation or budget is then answered by a lookup. They take four bytes a code
    point, so a text of 2^29 code points is too long for one value.

    Null and empty texts have 0 bytes and 0 tokens. Special strings inside texts are single tokens, as in the
    library by default. A null doc_id is kept; repeated rows give repeated rows; an empty table gives none. Very long
    texts are counted whole, each by itself. Other columns, also of clashing names, are not read.
    """

    key = ("tokencount", tokenizer_path)

    def make():
        counter = kept_by_worker(key, lambda: PrefixCounter(tokenizer_path))

        def f(batch):
            ids, texts = batch.column(0), batch.column(1)
            size = pc.binary_length(texts)
            if with_prefixes:
                return {"doc_id": ids, "n_bytes": pc.cast(size, "int64")} | from_prefixes(texts)
            texts = texts.to_pylist()
            found = list(counter.counts(texts))
            tokens = [sum(c) for _, c in found]
            return {"doc_id": ids, "n_bytes": pc.cast(size, "int64"), "n_tokens": tokens, "over_limit": [n > limit for n in tokens], "fit_chars": [counter.fits(*x, limit) if n > limit else len(t) for t, n, x in zip(texts, tokens, found, strict=True)]}

        def from_prefixes(texts):
            """All columns from the stored counts; no text is encoded again."""
            counts, at = counter.stored_all(texts)
            tokens = counts[at[1:] - 1].astype(np.int64)
            fit = [int(b - a - 1) if n <= limit else int(np.flatnonzero(counts[a:b] <= limit)[-1]) for a, b, n in zip(at, at[1:], tokens)]
            binary = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(counts)])
            return {"n_tokens": tokens, "over_limit": tokens > limit, "fit_chars": fit, "prefix_counts": binary}

        return f

    rows = pick(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    return map_slices(rows, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_counts binary" * with_prefixes, SLICE[0], keeps=key, most=SLICE[1])
