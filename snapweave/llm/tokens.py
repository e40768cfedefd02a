"""Token ids by a public tokenizer's file, remembered word by word.

A byte-pair tokenizer never merges across its pre-tokens, so a text's ids are its words' ids in a row
as long as the text is cut where pre-tokens end anyway. Two families of files are recognised from
their JSON: byte-level BPE, whose words carry their leading blank and whose lone line breaks stand
alone, and BPE that drops white space. Texts where the cut would not be safe (runs of white space,
other blanks than space and line break, special tokens' marks), and every text of any other file, go to
the library whole; so the ids always are the library's.
"""

from __future__ import annotations

import itertools
import json
import os
import string

import numpy as np

#: Signs that a text is not words with one blank or line break between them, or may hold a special token.
_RUNS = ("  ", "\n\n", " \n", "\n ", "<|", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
_BLANKS = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

PUNCTUATION = frozenset(string.punctuation)


def unsafe(text: str) -> bool:
    """Whether a non-empty text must be encoded whole. Plain searches: a regex would cost more than the ids."""
    return text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _RUNS) or not text.isascii() and any(x in text for x in _BLANKS)


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes; remembers between `limit` and twice as many words, the latest met."""

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre, norm = kind.get("pre_tokenizer") or {}, kind.get("normalizer")
        self.leading = not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        drops = [x.get("behavior") == "Removed" and x.get("invert") for x in pre.get("pretokenizers", [])[:1]]
        self.bare = bool(norm and drops and drops[0] and kind["model"].get("end_of_word_suffix"))
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.suffixes: dict[str, bytes] = {}
        self.newline = self.whole(["\n"])[0] if self.leading else b""
        mark = "\n" if self.leading else " | "
        self.mark = (mark, self.whole([mark])[0])

    def whole(self, texts: list[str]) -> list[bytes]:
        """By the library alone."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.cumsum([0, *map(len, ids)]) * 4
        joined = np.fromiter(itertools.chain.from_iterable(ids), "<u4", ends[-1] // 4).tobytes()
        return [joined[a:b] for a, b in itertools.pairwise(ends.tolist())]

    def many(self, words: list[str]) -> list[bytes]:
        """The ids of words without blanks but one in front, as one text cut at a mark that none of them holds."""
        mark, own = self.mark
        if len(own) != 4 or mark.strip(" ") in "".join(words):
            return self.whole(words)
        ids = np.array(self.tokenizer.encode_batch_fast([mark.join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ids == np.frombuffer(own, "<u4")[0])
        if len(cuts) != len(words) - 1:
            return self.whole(words)
        joined, cuts = ids.tobytes(), (4 * cuts).tolist()
        return [joined[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(joined)], strict=True)]

    def _learn(self, words: list[str]) -> None:
        """Words not met yet. ASCII punctuation after a letter or digit is a pre-token of its own."""
        if len(self.known) > self.limit:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        parts, new = [], set(words).difference(known)
        if before:
            again = {w: before[w] for w in new if w in before}
            known.update(again)
            new.difference_update(again)
        for w in [w for w in new if w[-1:] in PUNCTUATION]:
            base = w.rstrip(string.punctuation)
            if len(base) < len(w) and base and base[-1].lower().isalnum() and len(base[-1].lower()) == 1:
                parts.append((w, base, w[len(base) :]))
                new.discard(w)
                if base in before:
                    known[base] = before[base]
                elif base not in known:
                    new.add(base)
        for starts in (False, True) if self.leading else (False,):
            own = [w for w in new if w.startswith("\n") == starts] if self.leading else list(new)
            for low in range(0, len(own), 1000):
                some = own[low : low + 1000]
                if starts:
                    known.update(zip(some, [self.newline + ids for ids in self.many([w[1:] for w in some])], strict=True))
                else:
                    known.update(zip(some, self.many([" " + w for w in some] if self.leading else some), strict=True))
        for w, base, rest in parts:
            if rest not in self.suffixes:
                if len(self.suffixes) > 10_000:
                    self.suffixes.clear()
                self.suffixes[rest] = self.whole([rest])[0]
            known[w] = known[base] + self.suffixes[rest]

    def encode(self, text: str | None) -> bytes:
        """The ids of one text; none for null."""
        if not text:
            return b""
        if not (self.leading or self.bare) or unsafe(text):
            return self.whole([text])[0]
        # with leading blanks, a line's first word is remembered with the line break before it
        words = f"\n{text}".replace("\n", " \n")[1:].split(" ") if self.leading else text.split()
        try:
            ids = list(map(self.known.__getitem__, words))
        except KeyError:
            self._learn(words)
            ids = list(map(self.known.__getitem__, words))
        return b"".join(ids)[len(self.newline) if self.leading else 0 :]


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per file and worker process."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
