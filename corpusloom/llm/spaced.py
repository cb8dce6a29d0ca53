"""Ids of chunks that follow a space, by a byte-level tokenizer of the tokenizers library.

The library's own two steps, without its bookkeeping: the chunk is cut into pieces as its
pre-tokenizer cuts it, and each piece, in the characters that stand for bytes, is given to its
model. The cut is stated here for characters below U+0180, whose letters, numbers and white
space are the same in all Unicode versions; a chunk with others goes to the library whole.
"""

from __future__ import annotations

import array
import re

LONGEST_KEPT = 64
# Letters, numbers and white space below U+0180, and the order of pieces of byte-level pre-tokenizers.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def char_of_byte() -> dict[int, str]:
    """The character that byte-level tokenizers write for each byte: printable Latin-1 stands for
    itself, the others for 256 and on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class SpacedIds(dict):
    """chunk -> the ids of a space and the chunk, as bytes of the kind (an array type code)."""

    def __init__(self, tok, kind: str):
        super().__init__()
        self.tok, self.kind, self.model = tok, kind, tok.model.tokenize
        self.tails: dict[str, bytes] = {}  # of pieces that follow no space
        self.chars = char_of_byte()

    def ids(self, text: str) -> bytes:
        """Of a text, by the library as a whole."""
        return array.array(self.kind, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def head(self, chunk: str) -> bytes:
        """Of a chunk that follows nothing."""
        return self._of(chunk) if chunk.isascii() and chunk.isalpha() else self.ids(chunk)

    def _of(self, mapped: str) -> bytes:
        return array.array(self.kind, [t.id for t in self.model(mapped)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        word = piece[1:]
        after_space = piece[0] == " " and word.isalpha()
        found = self.get(word) if after_space else self.tails.get(piece)
        if found is None:
            found = self._of(piece.encode().decode("latin-1").translate(self.chars))
            if len(piece) <= LONGEST_KEPT:
                if after_space:
                    self[word] = found
                else:
                    self.tails[piece] = found
        return found

    def of(self, chunk: str) -> bytes:
        """Without keeping what is not a word."""
        found = self.get(chunk)
        if found is not None:
            return found
        if chunk.isascii() and chunk.isalpha():
            return self._piece(" " + chunk)
        if chunk and max(chunk) < "ƀ":
            return b"".join(map(self._piece, _PIECES.findall(" " + chunk)))
        return self.ids(" " + chunk)

    def __missing__(self, chunk: str) -> bytes:
        found = self._of("Ġ" + chunk) if chunk.isascii() and chunk.isalpha() else self.of(chunk)
        if len(chunk) <= LONGEST_KEPT:
            self[chunk] = found
        return found

    def bound(self, entries: int) -> None:
        """Start anew where there are more entries, which changes no result."""
        if len(self) > entries or len(self.tails) > entries:
            self.clear()
            self.tails.clear()
