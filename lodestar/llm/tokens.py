"""Token ids with a bounded memo of text pieces.

The byte-level and the word vocabularies never merge across the border between white space and what follows, save for
one leading space. So a text's ids are the ids of its pieces, one after the other, and each distinct piece goes through
the tokenizers library once while it stays in the memo. ``tests/llm`` holds this against whole-text encoding.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from lodestar.llm.common import kept

#: White space as Unicode has it; Python's ``\s`` also takes U+001C to U+001F, which the tokenizers' pattern does not.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACED = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_BLANK = {c for c in map(chr, range(0x3001)) if re.match(f"[{_WS}]", c)}


#: A space before more white space or the end: such a text is split by the pattern above, others at every space.
_RUN = re.compile(rb" (?:[\t-\r ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\Z)")
#: Pieces that fall into one run of letters and perhaps one of marks whatever stands around them.
_PLAIN = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?*$%&#|)]*)")


class Encoder:
    """Ids of whole texts by one vocabulary file of the tokenizers library, as its ``encode`` gives them without added ones.

    A special string that stands in a text is one id, as in the library; what stands around it is encoded by itself.
    """

    def __init__(self, path: str, memo_pieces: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        pre, self.kind = spec["pre_tokenizer"], None  # an unknown kind of vocabulary is encoded text by text
        if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"]:
            self.kind = "spaced"
        elif pre["type"] == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed" and spec["model"].get("end_of_word_suffix"):
            self.kind = "words"
        added = spec.get("added_tokens") or []
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            self.kind = None  # such strings take in what stands around them
        self.special = {t["content"].encode(): array("I", [t["id"]]).tobytes() for t in added}
        by_length = sorted(self.special, key=len, reverse=True)
        self.marked = re.compile(b"(" + b"|".join(map(re.escape, by_length)) + b")") if by_length else None
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        as_bytes = lambda c: level.pre_tokenize_str(c)[0][0]
        self.table = {c: as_bytes(chr(c)) for c in range(0xC0, 0x100)}
        self.space = as_bytes(" ") if self.kind == "spaced" else ""
        self.limit, self.young, self.old, self.marks = memo_pieces, {}, {}, {"": b""}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _model_ids(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        """Ids of one piece, in spaced vocabularies with a space before it."""
        text = piece.decode()
        if m := _PLAIN.fullmatch(text):
            letters, marks = m.groups()
            letters = letters.lower() if self.kind == "words" else letters
            if marks not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks = {"": b""}
                self.marks[marks] = self._model_ids(marks)
            return self._model_ids(self.space + (letters if letters.isascii() else letters.translate(self.table))) + self.marks[marks]
        return self.whole(" " + text if self.space else text)

    def encode(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a text in UTF-8."""
        if not text:
            return b""
        if self.kind is None:
            return self.whole(text.decode())
        if any(map(text.__contains__, self.special)):
            parts = self.marked.split(text)  # texts and special strings by turns
            return b"".join(self.special[p] if i % 2 else self._plain(p) for i, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: bytes) -> bytes:
        """A text without special strings."""
        if not text:
            return b""
        if self.kind == "words":
            out, pieces = [], text.split()
        elif _RUN.search(text):
            if not (parts := _SPACED.findall(text.decode())):
                return b""
            out, pieces = [], None
            for p in parts:
                out.append(self._lookup([p[1:].encode()]) if len(p) > 1 and p[0] == " " and p[1] not in _BLANK else self.whole(p))
        else:
            pieces = text.split(b" ")
            out = [self.whole(pieces[0].decode())] if pieces[0] else []
            del pieces[0]
        for at in range(0, len(pieces or ()), 65_536):
            out.append(self._lookup(pieces[at : at + 65_536]))
        return b"".join(out)

    def _lookup(self, part: list[bytes]) -> bytes:
        try:
            return b"".join(map(self.young.__getitem__, part))
        except KeyError:
            pass
        young, old = self.young, self.old
        for p in set(part).difference(young):
            v = old.get(p)
            young[p] = self._piece(p) if v is None else v
        out = b"".join(map(young.__getitem__, part))
        if len(young) > self.limit:  # two generations: what is in use survives
            self.old, self.young = young, {}
        return out


def encoder(path: str, memo_pieces: int = 600_000) -> Encoder:
    """One encoder a process and file, so that the memo outlives a task, until a task of another operator comes."""
    held = kept("tokens")
    if (path, memo_pieces) not in held:
        held[path, memo_pieces] = Encoder(path, memo_pieces)
    return held[path, memo_pieces]
