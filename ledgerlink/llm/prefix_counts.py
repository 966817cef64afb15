"""Exact token counts of every prefix of a text, by dynamic programming.

For a byte-pair vocabulary, the encoding of a word's prefix is the encoding of
a shorter prefix plus one last token: the only token that ends there and is
*compatible* with the last token before it (their joint text encodes to just
these two).  So one pass over a word fills the count and last token of every
prefix, each from an earlier entry, and no prefix is encoded by itself.  Words
do not influence each other, so the counts of a text are those of its words,
added up.

A text's store is one signed byte a code point: by how much the count changes
there.  It answers ``count_at`` and ``truncate`` without encoding again.
Chunks (white space, then other characters) repeat; their bytes are kept in a
bounded dictionary: the first ``limit`` that a worker meets.

Defined cases: a null text counts as empty, with no token; special strings
inside a text are one token each, as the library has it by default, and a
prefix that ends inside one counts its characters as ordinary text; rows that
repeat a doc_id are counted each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.common import WORD_BPE, per_worker, text_of, vocabulary

#: White space, then other characters; a run of Latin letters before a full stop or comma is a chunk of its own.
_CHUNK = re.compile("[ \n\t\r\f\v]*[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+(?=[.,\n \t\r]|\\Z)|[ \n\t\r\f\v]*[^ \n\t\r\f\v]+|[ \n\t\r\f\v]+")


def _byte_symbols() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    others for the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: Below this code point lower-casing keeps lengths and NFC changes nothing, and
#: character classes are the same in every Unicode version.
_LATIN = 0x130
_LATIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+|[\d²³¹¼-¾]|(?:[^\s\w]|[_\x1c-\x1f])+")
_OTHER_LATIN_SPACE = re.compile("[\x85\xa0]")
#: Characters that stand for themselves in the byte-level alphabet.
_PLAIN = re.compile(r"[!-~]+\Z")
#: Longer chunks are cut before their prefixes are counted.
_PIECE = 256


_BYTES = _byte_symbols()


class PrefixCounter:
    """Prefix counts for a vocabulary file of the ``tokenizers`` library (BPE with
    word ends).  The library normalises text and cuts it into words, but for
    Latin text, where a pattern does the same; the counts are made here."""

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        model = json.load(open(path, encoding="utf-8"))
        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer, library.pre_tokenizer
        self.end = end = model["model"]["end_of_word_suffix"]
        tokens = model["model"]["vocab"]
        self.inner = {t for t in tokens if not t.endswith(end)}
        self.closed = {t.removesuffix(end): t for t in tokens if t.endswith(end)}
        #: last two symbols -> symbols of the longest token that ends in them
        self.reach: dict[str, int] = {}
        for t in [*self.inner, *self.closed]:
            if len(t) > self.reach.get(t[-2:], 0):
                self.reach[t[-2:]] = len(t)
        self.longest = max(self.reach.values())
        self.rank: dict[tuple[str, str], int] = {}
        self.made: dict[str, tuple[int, str, str]] = {}
        for i, m in enumerate(model["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[a, b] = i
            self.made.setdefault(a + b, (i, a, b))
        special = [t["content"] for t in model["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.symbol = {chr(c): "".join(_BYTES[b] for b in chr(c).encode()) for c in range(_LATIN)}
        self.limit = limit
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.kinds: dict[str, str] = {}

    def compatible(self, a: str, b: str) -> bool:
        """Does the text of tokens ``a``, ``b`` encode to just these two?

        Their merges are undone from the last one on; at each step the symbols
        beside the seam must not have a merge of their own that comes before
        the next one of either side (of equal merges the left one is first).
        """
        rank, made, after_a, after_b = self.rank.get, self.made.get, 1 << 60, 1 << 60
        while True:
            joint = rank((a, b))
            if joint is not None and joint < after_a and joint <= after_b:
                return False
            x, y = made(a), made(b)
            if x is None and y is None:
                return True
            if y is None or (x is not None and x[0] > y[0]):
                after_a, a = x[0], x[2]
            else:
                after_b, b = y[0], y[1]

    def _fits(self, a: str, b: str) -> bool:
        if len(self.fits) > 400_000:
            self.fits.clear()
        out = self.fits[a, b] = self.compatible(a, b)
        return out

    def _run(self, w: str, count: list[int], last: list[str | None], out: list[int]) -> None:
        """Fills the places of ``w`` beyond ``count``: tokens and last token of each prefix
        (without the word's end), and to ``out`` its tokens as a whole word.  ``last``
        is None where the word begins."""
        inner, closed, fits, reach = self.inner, self.closed, self.fits, self.reach
        for k in range(len(count), len(w) + 1):
            here = done = 0
            tail = ""
            far = k - reach.get(w[k - 2 if k > 1 else 0 : k], 1)
            for j in range(far if far > 0 else 0, k):
                t, before = w[j:k], last[j]
                if not here and t in inner:
                    if before is None or ((ok := fits.get((before, t))) is None and self._fits(before, t)) or ok:
                        here = count[j] + 1
                        tail = t
                        if done:
                            break
                if not done and t in closed:
                    t = closed[t]
                    if before is None or ((ok := fits.get((before, t))) is None and self._fits(before, t)) or ok:
                        done = count[j] + 1
                        if here:
                            break
            count.append(here)
            last.append(tail)
            out.append(done)

    def word(self, w: str) -> list[int] | bytes:
        """Token counts of w[:1], w[:2], ..., w, each as a word of its own (with its word end)."""
        known = self.words.get(w)
        if known is not None:
            return known
        out: list[int] = []
        self._run(w, [0], [None], out)
        if len(w) <= 64:
            out = bytes(out)
            if len(self.words) < self.limit:
                self.words[w] = out
        return out

    def _pieces(self, s: str) -> list[str]:
        """The words of a piece of text without special strings, in the byte-level alphabet."""
        if s.isascii() or max(s) < chr(_LATIN):
            symbol = self.symbol
            return ["".join([symbol[c] for c in w]) for w in _LATIN_WORD.findall(_OTHER_LATIN_SPACE.sub(" ", s).lower())]
        return [w for w, _ in self.split.pre_tokenize_str(self.normal.normalize_str(s))]

    def _total(self, s: str) -> int:
        """Tokens of a piece of text without special strings, from the words' last entries."""
        return sum(self.word(w)[-1] for w in self._pieces(s))

    def _prefixes(self, s: str) -> list[int]:
        """Counts of s[:1], ..., s for a chunk."""
        out, before, at = [], 0, 0
        for m in self.special.finditer(s):
            plain = s[at : m.start()]
            counts, rest = self._plain(plain)
            out += [before + n for n in counts]
            # a prefix may end inside the special string, whose characters then go on with what can't be cut off
            end = before + (counts[-1] if counts else 0)
            if rest and self._ends(rest[-1], m.group()[0]):
                rest = ""
            base = end - self._total(rest)
            out += [base + self._total(rest + m.group()[:k]) for k in range(1, len(m.group()))]
            out.append(end + 1)
            before, at = end + 1, m.end()
        return out + [before + n for n in self._plain(s[at:])[0]]

    def _kind(self, c: str) -> str:
        """What the library takes a character for: l(etter), n(umber), o(ther), s(pace); or
        x if it may combine with the one before it or is normalised to more than one."""
        got = self.kinds.get(c)
        if got is None:
            normal = self.normal.normalize_str(c)
            if unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff" or len(normal) != 1:
                got = "x"
            else:
                beside = len(self.split.pre_tokenize_str("a" + normal))
                got = "s" if not self.split.pre_tokenize_str(normal) else "l" if beside == 1 else "n" if len(self.split.pre_tokenize_str(normal + normal)) == 2 else "o"
            self.kinds[c] = got
        return got

    def _ends(self, before: str, c: str) -> bool:
        """Does a word end between these characters, whatever stands beside them?"""
        a, b = self._kind(before), self._kind(c)
        return "x" not in (a, b) and (a != b or a == "n") and not (b == "l" and before == "'")

    def _plain(self, s: str) -> tuple[list[int], str]:
        """As ``_prefixes``, without special strings, and what stands after the last cut.

        A long chunk is cut where words end whatever follows: where the kind of
        character changes (but between an apostrophe and a letter) and after a number,
        before a character that doesn't combine.  So the work stays linear.
        """
        if not s:
            return [], s
        kinds = [self._kind(c) for c in s] if len(s) > _PIECE else []
        out, before, at = [], 0, 0
        for k in range(1, len(kinds)):
            if k - at >= 64 and (kinds[k - 1] != kinds[k] or kinds[k] == "n") and self._ends(s[k - 1], s[k]):
                out += [before + n for n in self._piece(s[at:k])]
                before, at = out[-1], k
        rest = s[at:]
        return out + [before + n for n in self._piece(rest)], rest if kinds else s

    def _piece(self, s: str) -> list[int]:
        """As ``_plain``, word by word."""
        if not (s.isascii() or max(s) < chr(_LATIN)):
            return self._any_script(s)
        out, before, at = [], 0, 0
        lower, symbol = _OTHER_LATIN_SPACE.sub(" ", s).lower(), self.symbol
        for m in _LATIN_WORD.finditer(lower):
            a, b = m.span()
            if a > at:
                out += [before] * (a - at)
            w = m.group()
            if w[0] == "'" and len(w) > 1 and w[1].isalpha():  # a contraction: its prefixes are other words
                out += [before + self._total(w[:k]) for k in range(1, len(w) + 1)]
            elif _PLAIN.match(w):
                out += [before + n for n in self.word(w)]
            else:
                counts, k = self.word("".join([symbol[c] for c in w])), 0
                for c in w:
                    k += len(symbol[c])
                    out.append(before + counts[k - 1])
            before, at = out[-1], b
        return out + [before] * (len(s) - at)

    def _by_word(self, text: str) -> list[int]:
        """Counts of the prefixes of a normalised text."""
        out, before, at = [], 0, 0
        for w, (a, b) in self.split.pre_tokenize_str(text):
            out += [before] * (a - at)
            if text[a] == "'" and b - a > 1 and text[a + 1].isalpha():  # a contraction
                out += [before + sum(self.word(v)[-1] for v, _ in self.split.pre_tokenize_str(text[a : a + k])) for k in range(1, b - a + 1)]
            else:
                counts, k = self.word(w), 0
                for c in text[a:b]:
                    k += len(c.encode())
                    out.append(before + counts[k - 1])
            before, at = out[-1], b
        return out + [before] * (len(text) - at)

    def _any_script(self, s: str) -> list[int]:
        """As ``_piece``, for any characters.  Where each character is normalised by
        itself, a prefix's words are prefixes of the piece's words; else (it has
        characters that combine) the prefixes that end before a character that doesn't
        combine are such, and the others end in a tail that is worked out anew."""
        normal = self.normal.normalize_str
        whole = normal(s)
        own = {c: normal(c) for c in set(s)}
        if "".join([own[c] for c in s]) == whole:
            counts, ends = self._by_word(whole), np.cumsum([len(own[c]) for c in s])
            return [counts[e - 1] if e else 0 for e in ends.tolist()]
        if len(s) <= _PIECE:
            return [self._total(s[:k]) for k in range(1, len(s) + 1)]
        starts = [k for k, c in enumerate(s) if k == 0 or self._kind(c) != "x"]
        clusters = [normal(s[a:b]) for a, b in zip(starts, [*starts[1:], len(s)], strict=True)]
        if "".join(clusters) != whole:
            return [self._total(s[:k]) for k in range(1, len(s) + 1)]
        counts, words = self._by_word(whole), self.split.pre_tokenize_str(whole)
        out, place, w = [], 0, 0  # place: in the normalised piece
        states: tuple[int, list, list] = (-1, [], [])
        for a, b, cluster in zip(starts, [*starts[1:], len(s)], clusters, strict=True):
            while w + 1 < len(words) and words[w + 1][1][0] < place:
                w += 1
            for k in range(a + 1, b):  # inside the cluster
                tail = normal(s[a:k])
                if not words or not words[w][1][0] < place <= words[w][1][1]:
                    before = counts[place - 1] if place else 0
                    out.append(before + sum(self.word(v)[-1] for v, _ in self.split.pre_tokenize_str(tail)))
                    continue
                if states[0] != w:
                    states = (w, [0], [None])
                    self._run(words[w][0], states[1], states[2], [])
                out.append(self._tail(whole, words[w], states, place, tail, counts))
            place += len(cluster)
            out.append(counts[place - 1] if place else 0)
        return out

    def _tail(self, whole: str, word: tuple, states: tuple, place: int, tail: str, counts: list[int]) -> int:
        """Tokens of whole[:place] + tail, where ``place`` is inside or at the end of ``word``."""
        symbols, (a, _) = word
        before = counts[a - 1] if a else 0
        begun = len(whole[a:place].encode())
        first, *more = self.split.pre_tokenize_str(whole[place - 1] + tail) or [("", (0, 0))]
        joined = len(whole[place - 1].encode())
        if whole[a] == "'" or len(first[0]) < joined:  # may be a contraction: the word is short
            return before + self._total(whole[a:place] + tail) if place - a <= _PIECE else counts[place - 1] + self._total(tail)
        low = max(0, begun - self.longest)
        count, last, out = states[1][low : begun + 1], states[2][low : begun + 1], []
        self._run(symbols[low:begun] + first[0][joined:], count, last, out)
        here = out[-1] if out else counts[place - 1] - before
        return before + here + sum(self.word(v)[-1] for v, _ in more)

    def deltas(self, text: str) -> bytes:
        """Change of the count at each code point of the text, a signed byte each."""
        known, chunks = self.chunks, _CHUNK.findall(text)
        parts = list(map(known.get, chunks))
        if None in parts:
            new: dict[str, bytes] = {}
            for k, (c, p) in enumerate(zip(chunks, parts, strict=True)):
                if p is None:
                    if c not in new:
                        counts = self._prefixes(c)
                        new[c] = bytes([(n - m) & 255 for n, m in zip(counts, [0, *counts])])
                    parts[k] = new[c]
            if len(known) < self.limit:
                known.update((c, p) for c, p in new.items() if len(c) <= 64)
        return b"".join(parts)


def count_at(deltas: bytes, prefix: int) -> int:
    """Tokens of the text's first ``prefix`` code points."""
    return int(np.frombuffer(deltas, np.int8)[:prefix].sum(dtype=np.int64))


def truncate(deltas: bytes, budget: int) -> int:
    """Code points of the longest prefix with at most ``budget`` tokens."""
    fit = np.flatnonzero(np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64) <= budget)
    return int(fit[-1]) + 1 if len(fit) else 0


def counter(path: str) -> PrefixCounter:
    return per_worker(("prefix counts", path), lambda: PrefixCounter(path))


def prefix_counts(docs: DataFrame, budget: int = 2048, path: str | None = None, with_store: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cut (code points of the longest prefix
    within ``budget``), and the store ``prefix_deltas`` if asked for.

    A narrow pass: nothing is exchanged, and every answer comes from the stored
    prefix counts.
    """
    path = path or vocabulary(WORD_BPE)
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut long" + ", prefix_deltas binary" * with_store

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = counter(path)
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), *[pa.binary()] * with_store]
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = text.as_py()
                store = c.deltas(s)
                n = count_at(store, len(s))
                rows.append((doc_id, len(s.encode()), n, n > budget, truncate(store, budget) if n > budget else len(s), *[store] * with_store))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, schema)
