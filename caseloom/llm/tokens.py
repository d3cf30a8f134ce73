"""Byte-level BPE ids and counts for the tokenizers-library file at a given path.

The file's vocabulary is read as ranks (checked: merge *i* makes the token whose id is the i-th
after the bytes, so merge order equals id order) and merged by tiktoken, several times faster than
per-text calls of the library itself; tests hold both against each other on random texts. tiktoken
returns a vocabulary entry without running its merges; so the library proves, entry by entry, which
ones its merges reach. If one is out of reach (``strict``), the library encodes everything.
Strings of special tokens inside a text become their id, as is the library's default.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import regex
import tiktoken
from tokenizers import Tokenizer

PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pre-tokens where no two white-space characters meet: without look-ahead a faster engine serves it.
PRE_TOKEN_SINGLE_SPACES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_SPACE_RUN = re.compile(r"\s\s")
WHITE = r"\p{White_Space}"


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenEncoder:
    def __init__(self, path: str, strict: bool = False):
        self.path, self.strict = path, strict
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        to_byte = _byte_of_char()
        vocab = spec["model"]["vocab"]
        self.ranks = {bytes(to_byte[c] for c in k): v for k, v in vocab.items() if k not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        if made != sorted(made) or spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path}: not a byte-level BPE whose merges are in the order of their ids")
        self.n_ids = max([*vocab.values(), *self.special.values()]) + 1
        self.typecode = "H" if self.n_ids <= 1 << 16 else "I"
        self._any = tiktoken.Encoding("any", pat_str=PRE_TOKEN, mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        self._single = tiktoken.Encoding("single", pat_str=PRE_TOKEN_SINGLE_SPACES, mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        self._cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pattern = PRE_TOKEN.replace(r"(?!\S)", f"(?![^{WHITE}])").replace(r"\s", WHITE)
        self._pieces = regex.compile(pattern).findall
        self._library = Tokenizer.from_file(path) if strict else None

    def _plain(self, text: str) -> list[int]:
        if self._library is not None:
            return self._library.encode(text, add_special_tokens=False).ids
        return (self._any if _SPACE_RUN.search(text) else self._single).encode_ordinary(text)

    def ids(self, text: str) -> list[int]:
        if self._cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        out: list[int] = []
        for part in self._cut.split(text):
            out += [self.special[part]] if part in self.special else self._plain(part)
        return out

    def packed(self, text: str) -> bytes:
        """The ids as native unsigned integers, of two bytes where the vocabulary allows it."""
        return array(self.typecode, self.ids(text)).tobytes()

    def prove_whole_tokens(self) -> tuple[frozenset[str], bool]:
        """(vocabulary strings that are one pre-token and that the library's merges turn into exactly their own id, whether these are all such strings)."""
        alone = []
        for raw, rank in self.ranks.items():
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if self._pieces(text) == [text]:
                alone.append((text, rank))
        said = Tokenizer.from_file(self.path).encode_batch([t for t, _ in alone], add_special_tokens=False)
        whole = frozenset(t for (t, rank), e in zip(alone, said) if e.ids == [rank])
        return whole, len(whole) == len(alone)


@lru_cache(maxsize=4)
def encoder(path: str, strict: bool = False) -> TokenEncoder:
    """One encoder for each path and Python process."""
    return TokenEncoder(path, strict)


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> tuple[frozenset[str], bool]:
    """The proof, once for each path; for the driver, which tells the tasks whether they must be strict."""
    return encoder(path).prove_whole_tokens()


class PieceCounts(dict):
    """Pre-token -> number of tokens. Whole tokens count 1 from the start; the others are merged when first seen.

    At most ``most`` merged pre-tokens are remembered; beyond that the memory starts anew (counts stay exact).
    """

    def __init__(self, enc: TokenEncoder, whole: frozenset[str], most: int = 300_000):
        super().__init__(dict.fromkeys(whole, 1))
        self._whole, self._most = whole, most + len(whole)
        self._merge = enc._plain if enc.strict else enc._any.encode_ordinary

    def __missing__(self, piece: str) -> int:
        if len(self) >= self._most:
            self.clear()
            self.update(dict.fromkeys(self._whole, 1))
        n = self[piece] = len(self._merge(piece))
        return n
