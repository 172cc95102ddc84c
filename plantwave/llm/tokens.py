"""Token ids of whole texts by the public byte-level vocabularies, as little-endian unsigned 32-bit integers."""

from __future__ import annotations

import base64
import re
from array import array
from functools import cached_property, lru_cache


class Ranks:
    """Byte-level BPE by ranks, each match of the pattern separately; decoding joins raw bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, pattern

    @cached_property
    def raw(self) -> dict[int, bytes]:
        return {i: b for b, i in self.ranks.items()}

    @cached_property
    def encoding(self):
        """Made where something is encoded: it is large."""
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, array("I", ids)))


@lru_cache(maxsize=4)
def rank_file(path: str, pattern: str) -> Ranks:
    """A file of lines: base64 of a token's bytes, its rank."""
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


#: Fixed value: the pattern that byte-level files of the `tokenizers` library split texts by.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBE = "It's  a probe:\n\n\tÉtè 123,45 ist größer — 'tis　naïve 東京 🙂 <|endoftext|> x  \n"


class Added:
    """Ids of a `tokenizers` file: strings of its added tokens become their ids, what lies between is encoded by ranks."""

    def __init__(self, ranks: Ranks, added: dict[str, int]) -> None:
        self.ranks, self.added = ranks, added
        self.strings = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    def ids(self, text: str) -> bytes:
        if self.strings is None or not any(a in text for a in self.added):
            return self.ranks.ids(text)
        parts = self.strings.split(text)
        return b"".join(array("I", [self.added[x]]).tobytes() if i % 2 else self.ranks.ids(x) for i, x in enumerate(parts))


@lru_cache(maxsize=4)
def tokenizers_file(path: str) -> Added:
    """A byte-level BPE file of the `tokenizers` library whose ids are its merges' ranks.

    The library reads the vocabulary and tells the ids of a probe text; the merges run in the rank encoder, which
    gives the same ids several times as fast. Strings of added tokens in a text are those tokens, as in the library."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = tokenizer.get_added_tokens_decoder()
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
        raise ValueError(f"{path}: added tokens that take more than their own string")
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    vocabulary = {t: i for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if i not in added}
    ids = Added(Ranks({bytes(map(byte.__getitem__, t)): i for t, i in vocabulary.items() if all(c in byte for c in t)}, BYTE_LEVEL), {t.content: i for i, t in added.items()})
    if ids.ids(PROBE) != array("I", tokenizer.encode(PROBE, add_special_tokens=False).ids).tobytes():
        raise ValueError(f"{path}: not a byte-level BPE whose ids are ranks")
    return ids
