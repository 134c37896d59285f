"""Exact tokenisation with a public vocabulary, remembering words.

The ids equal those of ``Tokenizer.encode(text, add_special_tokens=False)`` on
the whole text.  Texts are cut only where no token can span: a byte-level
pre-tokeniser takes a space only at the front of a token, so before a space
that stands between non-space characters; a word vocabulary that drops white
space and marks the ends of words by ``</w>``, at every space.  The pieces' ids are remembered per Python worker (a
bounded table), so that the library is asked once per distinct word.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words remembered per worker (in two halves, of which the elder is dropped),
#: the longest one (characters), and words encoded in one call.
KEPT_WORDS, KEPT_CHARS, TOGETHER = 1_600_000, 48, 64
_CUT = re.compile(r"(?<=\S)(?= )")


class Encoder:
    """``style``: "byte" (byte-level, spaces lead tokens), "word" (white space
    dropped) or "whole" (no cutting; for any other vocabulary)."""

    def __init__(self, path: str, style: str, kept_words: int | None = None):
        from tokenizers import Tokenizer

        if style not in ("byte", "word", "whole"):
            raise ValueError(f"unknown style {style!r}")
        self.tok, self.style = Tokenizer.from_file(path), style
        self.kept_words = KEPT_WORDS if kept_words is None else kept_words
        self.code = "H" if self.tok.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.words: dict[str, bytes | None] = {}
        self.elder: dict[str, bytes | None] = {}
        self.heads: dict[str, bytes] = {}
        known = self.tok.get_vocab()
        self.edge = np.zeros(max(known.values(), default=0) + 1, bool)
        for t, i in known.items():
            self.edge[i] = t.startswith("\u0120") if style == "byte" else t.endswith("</w>")
        # A special token divides a text before anything else is done to it,
        # so words joined by one are encoded each for itself.
        self.mark, self.mark_id = next(((t.content, i) for i, t in self.tok.get_added_tokens_decoder().items()
                                        if t.special and not (t.lstrip or t.rstrip or t.normalized)), (None, -1))

    def _each(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.mark is None or len(texts) == 1:
            return self._each(texts)
        out: list[bytes] = []
        groups = [texts[i:i + TOGETHER] for i in range(0, len(texts), TOGETHER)]
        for g in groups:
            (e,) = self.tok.encode_batch_fast([self.mark.join(g)], add_special_tokens=False)
            ids = np.array(e.ids, f"<u{self.width}")
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) != len(g) - 1:  # a text holds the mark itself
                out += self._each(g)
                continue
            raw, at = ids.tobytes(), 0
            for c in (cuts * self.width).tolist():
                out.append(raw[at:c])
                at = c + self.width
            out.append(raw[at:])
        return out

    def _runs(self, words: list[str]) -> list[bytes]:
        """Ids of words encoded together, with a space between them: told apart
        by the tokens that open a word after a space, or that end one."""
        byte, out = self.style == "byte", []
        for i in range(0, len(words), TOGETHER):
            g = words[i:i + TOGETHER]
            (e,) = self.tok.encode_batch_fast([" " * byte + " ".join(g)], add_special_tokens=False)
            ids = np.array(e.ids, f"<u{self.width}")
            cuts = np.flatnonzero(self.edge[ids]) + (not byte)
            if len(cuts) != len(g):  # not one token of that kind for each word
                out += self._each([" " * byte + w for w in g])
                continue
            ends = [*cuts[1:], len(ids)] if byte else cuts
            raw, at = ids.tobytes(), 0
            for c in (np.array(ends) * self.width).tolist():
                out.append(raw[at:c])
                at = c
        return out

    def _learn(self, table: dict, keys: list[str], lead: str) -> None:
        if lead or self.style == "word":
            # In a word vocabulary only letters are sure to make one word.
            plain, others = (keys, []) if lead else ([], [])
            for k in [] if lead else keys:
                (plain if k.isalpha() else others).append(k)
            table.update(zip(plain, self._runs(plain), strict=True))
            keys = others
        table.update(zip(keys, self._encode([lead + k for k in keys]), strict=True))

    def _turn(self) -> None:
        if len(self.words) > self.kept_words // 2:
            self.elder, self.words = self.words, {}
        if len(self.heads) > self.kept_words // 4:
            self.heads = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``width`` bytes."""
        if self.style == "whole":
            return self._each(texts)
        self._turn()
        byte, heads = self.style == "byte", self.heads
        rest: list[str | None] = list(texts)
        if byte:
            opened = [t.partition(" ") for t in texts]
            rest = [after if space else None for _, space, after in opened]
            first = {h for h, _, _ in opened} - heads.keys()
            self._learn(heads, list(first), "")
        # Words are told apart by Arrow, so that a table is asked once per distinct word of the call.
        split = pc.split_pattern(pa.array(rest, pa.large_string()), " ")
        found = split.flatten().dictionary_encode()
        ids = pa.array(self._known(found.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(found.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset:ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = memoryview(ids.buffers()[2] or b"")
        bounds = split.offsets.to_numpy()
        at = ends[bounds].tolist()
        out = [bytes(data[i:j]) for i, j in zip(at, at[1:], strict=False)]
        if byte:
            out = [heads[h] + raw for (h, _, _), raw in zip(opened, out, strict=True)]
            if ids.null_count:
                odd = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False))
                for i in set((np.searchsorted(bounds, odd, side="right") - 1).tolist()):
                    out[i] = self._ragged(texts[i])
            for w in [w for w in first if len(w) > KEPT_CHARS]:
                del heads[w]
        return out

    def _known(self, asked: list[str]) -> list[bytes | None]:
        """Ids of distinct words; None for those that must not be cut out of
        their text."""
        words, byte = self.words, self.style == "byte"
        new = set(filterfalse(words.__contains__, asked))
        known = new & self.elder.keys()
        words.update((w, self.elder[w]) for w in known)
        new -= known
        if byte:
            # An empty word, or one with white space at an end, is part of a
            # run of white space that must not be cut here.
            odd = {w for w in new if not w or w[0].isspace() or w[-1].isspace()}
            words.update(dict.fromkeys(odd))
            new -= odd
        self._learn(words, list(new), " " if byte else "")
        ids = list(map(words.__getitem__, asked))
        for w in [w for w in new if len(w) > KEPT_CHARS]:
            del words[w]
        return ids

    def _ragged(self, text: str) -> bytes:
        """A text with runs of white space: cut before the first space of each."""
        pieces = _CUT.split(text)
        return b"".join(self._encode(pieces))


@lru_cache(maxsize=1)
def encoder(path: str, style: str, kept_words: int | None = None) -> Encoder:
    """The encoder of this Python worker, one at a time."""
    return Encoder(path, style, kept_words)


def chunks(items: list, texts: list[str], chars: int = 6_000_000):
    """(items, texts) in runs of bounded size, whole texts only."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars or i - at >= 2000:
            yield items[at:i + 1], texts[at:i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield items[at:], texts[at:]
