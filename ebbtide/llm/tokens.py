"""Token ids of whole texts as little-endian unsigned 32-bit bytes, by the tokenizers library.

A tokenizer of this kind never joins letters across certain blanks, so a text is cut there, and
the library is asked once for each different piece that a worker meets. For a Latin word with
punctuation behind it the pre-tokens are plain, and the library's model is asked for them directly.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

#: White space other than blanks and line breaks, and runs that are not one character long.
_ODD = [chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n"] + ["  ", " \n", "\n ", "\n\n"]
_SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_PLAIN = re.compile(rf"(\n?)([{_LATIN}]+)([!-&(-/:-@\[-`{{-~]*)")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def public_path(name: str) -> str:
    """Where the public vocabulary file `name` lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words(dict):
    """Ids of pre-tokens, by the library's model."""

    def __init__(self, model):
        self.tokenize = model.tokenize

    def __missing__(self, pre_token: str) -> bytes:
        letters = pre_token.encode().decode("latin-1").translate(_LETTERS)
        found = self[pre_token] = array("I", [t.id for t in self.tokenize(letters)]).tobytes()
        return found


class _Pieces(dict):
    """Ids of pieces that stand behind `blank`; forgets all when it has met `most`."""

    def __init__(self, tokenizer, words: _Words, blank: str, lower: bool, most: int):
        self.encode, self.words = tokenizer.encode, words
        self.blank, self.lower, self.most = blank, lower, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
            self.words.clear()
        plain = _PLAIN.fullmatch(piece)
        if plain:
            line, word, marks = plain.groups()
            words = self.words
            if self.lower:
                found = words[word.lower()]
            elif line:
                found = words[line] + words[word]
            else:
                found = words[self.blank + word]
            if marks:
                found += words[marks]
        else:
            whole = piece if piece[:1] == "\n" else self.blank + piece
            found = array("I", self.encode(whole, add_special_tokens=False).ids).tobytes()
        self[piece] = found
        return found


class TextIds:
    """Encoder of one tokenizer file. `drops_blanks`: the tokenizer ignores white space, else it
    keeps a blank with the word behind it and a line break by itself."""

    def __init__(self, path: str, drops_blanks: bool, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_blanks = drops_blanks
        words = _Words(self.tokenizer.model)
        self.first = _Pieces(self.tokenizer, words, "", drops_blanks, most // 4)
        self.known = _Pieces(self.tokenizer, words, "" if drops_blanks else " ", drops_blanks, most)

    def _pieces(self, text: str) -> list[str]:
        """Pieces whose ids, one after another, are the ids of the text; before each but the first
        stood a blank, or a line break that the piece keeps."""
        if self.drops_blanks:
            return text.replace("\n", " ").split(" ")
        if text[:1].isspace() or text[-1:].isspace() or any(odd in text for odd in _ODD):
            return _SAFE_BLANK.split(text)
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        ids_of = self.known.__getitem__
        out = []
        for text in texts:
            first, *rest = self._pieces(text or "")
            out.append(self.first[first] + b"".join(map(ids_of, rest)))
        return out


@functools.cache
def shared_encoder(path: str, drops_blanks: bool) -> TextIds:
    """One encoder a worker process, so that tasks share what it has met."""
    return TextIds(path, drops_blanks)
