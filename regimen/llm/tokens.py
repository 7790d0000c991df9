"""Token ids of texts by a public byte-level BPE vocabulary, with a bounded cache of words.

A pre-token of this vocabulary's pattern never crosses a place before a single space that a
non-space follows, so a text's ids are those of its first word and of " " + word for the others,
joined. Texts with other white space next to a space are encoded in one piece. The ranks file holds
the same vocabulary as the ``tokenizers`` file ``byte_bpe_50k.json``, but not its added tokens: a text
is split at their contents, which get their own ids, as ``tokenizers`` does. Tests compare the ids.
"""

from __future__ import annotations

import array
import base64
import functools
import json
import re

import tiktoken

_OTHER_SPACE = re.compile(r" (?:\s|$)")
#: words kept in a worker at once
CACHE = 300_000


def _added_tokens(vocabulary: str) -> dict[str, bytes]:
    """Content and packed id of the added tokens of a ``tokenizers`` file."""
    with open(vocabulary, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{vocabulary}: added tokens that are more than their content")
    longest_first = sorted(added, key=lambda t: -len(t["content"]))
    return {t["content"]: array.array("I", [t["id"]]).tobytes() for t in longest_first}


class Encoder(dict):
    """Maps a word that follows a space to its ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: str, pattern: str, vocabulary: str | None = None):
        super().__init__()
        self.added = _added_tokens(vocabulary) if vocabulary else {}
        self.split = re.compile("|".join(map(re.escape, self.added))) if self.added else None
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def _packed(self, text: str) -> bytes:
        return array.array("I", self.encoding.encode_ordinary(text)).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = self._packed(" " + word)
        return out

    def ids(self, text: str | None) -> bytes:
        """All ids of ``text``, four bytes each; null counts as empty."""
        if not text:
            return b""
        if self.split is None or not self.split.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [self._plain(text[at:m.start()]), self.added[m.group()]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if not text:
            return b""
        if _OTHER_SPACE.search(text):
            return self._packed(text)
        words = text.split(" ")
        return self._packed(words[0]) + b"".join(map(self.__getitem__, words[1:]))


@functools.cache
def encoder(ranks: str, pattern: str, vocabulary: str | None = None) -> Encoder:
    """One per Python worker."""
    return Encoder(ranks, pattern, vocabulary)
