"""Byte-pair token ids of whole texts, fast enough for corpora.

The vocabulary file is a ``tokenizers`` JSON of a byte-level BPE. Its pre-tokenizer never
joins characters across white space, except for one space in front of a word; so a text is
cut into chunks (a word with its leading space, or white space of its own), every distinct
chunk is encoded once per task, and a text's ids are the joined ids of its chunks. Tests
hold the ids against ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

#: White space as the pre-tokenizer's pattern has it (Unicode White_Space).
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word with its space; a run of white space up to the character that may lead a word; one
#: white-space character that leads none.
_CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")
_RUN = re.compile(r"\s\s")
#: Chunks that one task remembers; beyond it the memory starts anew, results are the same.
REMEMBERED = 250_000


class _Spaced(dict):
    """Word -> the ids of the word with a space before it."""

    def __init__(self, chunks: ChunkEncoder):
        super().__init__()
        self.chunks = chunks

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = self.chunks.encode(" " + word)
        return out


class ChunkEncoder(dict):
    """Chunk -> its ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ranked = _as_ranks(path)
        self.spaced = _Spaced(self)

    def encode(self, chunk: str) -> bytes:
        if self.ranked is not None:
            ids = self.ranked.encode_ordinary(chunk)
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[chunk] = out = self.encode(chunk)
        return out

    def ids(self, text: str) -> bytes:
        """The ids of a whole text, 4 bytes each."""
        if _RUN.search(text):
            return b"".join(map(self.__getitem__, _CHUNK.findall(text)))
        # white space stands alone: a line break is a chunk, a space belongs to its word
        return self["\n"].join([self._line(x) for x in text.split("\n")]) if text else b""

    def _line(self, line: str) -> bytes:
        first, *words = line.split(" ")
        return b"".join([self[first] if first else b"", *map(self.spaced.__getitem__, words)])


def _as_ranks(path: str):
    """The same vocabulary for ``tiktoken``, whose pieces merge in the order of their ids;
    None where the file's merges are in another order or its pieces are cut otherwise."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    pre, bpe = model.get("pre_tokenizer") or {}, model["model"]
    if bpe.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model.get("normalizer"):
        return None
    # printable bytes stand for themselves, the others for code points from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {t["content"] for t in model.get("added_tokens", [])}
    vocab = bpe["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
    order = [vocab[a + b] for a, b in merges]
    if any(x >= y for x, y in zip(order, order[1:])):
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)
