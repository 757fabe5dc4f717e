"""Word-level BPE ids of whole texts, fast enough for a corpus.

The tokenizer file drops white space and encodes each word on its own, so a text's ids are those of its white-space-separated chunks in
order. Each task keeps the ids of chunks it has met (a bounded memo, emptied when full). A new chunk in Latin-1 is cut into
words by the file's own split pattern, lower-cased, and its words are merged by the file's merges; any other chunk, and any text with
control characters that the two libraries class differently, goes through the tokenizer itself. The merges run on a rank table: each
word ends with a byte that no word contains, which joins the word's last byte first because those tokens have the lowest ranks. That gives
the tokenizer's ids because merges only ever join tokens of lower rank, so both apply them in the same order; tests compare the two.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

#: Chunks that a task remembers at most.
MEMO = 400_000
END = b"\x00"
#: Classes of the split pattern for the first 256 characters, in lower case.
LETTER, NUMBER, BLANK = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\x09-\x0d \x85\xa0"
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{BLANK}{LETTER}{NUMBER}]+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters on which chunks cannot be relied: the end mark, and what only one of the libraries takes for white space.
ODD = re.compile("[\x00\x1c-\x1f]")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the file: itself, or for the others one from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Words(dict):
    """Chunk to the bytes of its ids (little-endian unsigned 32 bits)."""

    def __init__(self, path: str):
        super().__init__()
        self.rest: dict[str, bytes] = {}
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as text:
            model = json.load(text)
        rules = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.known = rules == PATTERN and model["model"]["end_of_word_suffix"] == "</w>"
        letters, ranks = byte_letters(), {}
        special = {x["content"] for x in model["added_tokens"]}
        for token, rank in model["model"]["vocab"].items():
            if token not in special:
                end = token.endswith("</w>")
                ranks[bytes(letters[c] for c in (token[:-4] if end else token)) + END * end] = rank
        self.specials = tuple(special)
        # The lone end byte stands for nothing: its own rank is never given out.
        spare = max(model["model"]["vocab"].values()) + 1
        zero = ranks.pop(END, None)
        self.known &= zero is not None and ranks.get(END + END) is not None
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks={**ranks, END: spare}, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, chunk: str) -> bytes:
        """The ids of a lower-case chunk in Latin-1."""
        if len(self) >= MEMO:
            self.clear()
        found: list[int] = []
        for word in PIECE.findall(chunk):
            found += self.merge(word.encode() + END)
        ids = self[chunk] = array("I", found).tobytes()
        return ids

    def plain(self, text: str) -> bool:
        """Whether a text keeps to Latin-1 and holds no special token."""
        return self.known and (text.isascii() or max(text) <= "\xff") and not any(x in text for x in self.specials)

    def ids(self, text: str) -> bytes:
        """The ids of a whole text."""
        if ODD.search(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if self.plain(text):
            return b"".join(map(self.__getitem__, text.lower().split()))
        return b"".join(map(self.chunk, text.split()))

    def chunk(self, chunk: str) -> bytes:
        """The ids of one chunk of a text that goes beyond Latin-1."""
        if self.plain(chunk):
            return self[chunk.lower()]
        ids = self.rest.get(chunk)
        if ids is None:
            if len(self.rest) >= MEMO:
                self.rest.clear()
            ids = self.rest[chunk] = array("I", self.whole.encode(chunk, add_special_tokens=False).ids).tobytes()
        return ids


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)
