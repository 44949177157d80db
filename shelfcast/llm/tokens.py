"""Token ids of many texts at once, for the vocabularies of public tokenizer libraries."""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

from shelfcast.llm import held

# Letters and numbers of ASCII, Latin-1 and Latin Extended-A, for patterns written with \p{L} and \p{N}.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ž", "0-9²³¹¼-¾"
#: Any character beyond white space in ASCII and the printable ones of these blocks. U+0130 is left out:
#: lower-casing splits it.
_OTHER = re.compile("[^\t-\r -~\xa1-įı-ž‐-‧‰-›€]")


def is_plain(text: str) -> bool:
    """Whether all characters are of the blocks that ``plain_pattern`` knows; lower-casing and
    normalisation change none of them but one for one."""
    return _OTHER.search(text) is None


def plain_pattern(pattern: str) -> re.Pattern:
    """The pattern for plain texts, with its letter and number classes written out."""
    pattern = pattern.replace(r"\s\p{L}\p{N}", r"\s" + _LETTERS + _NUMBERS)
    return re.compile(pattern.replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_NUMBERS}]"))


class _Numbers(dict):
    """Numbers of pieces in the order in which they are first asked for; ``new`` lists those just added."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        number = self[piece] = len(self)
        return number


class PieceStore:
    """Ids of pieces of text, each learnt once: the last ``most`` different ones at most are held, flat.

    ``encode`` gives the ids of a list of pieces, flat, and the number of ids of
    each. The store starts anew when it holds ``most`` pieces or ``most_chars`` characters.
    """

    def __init__(
        self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 250_000, most_chars: int = 1 << 23
    ):
        self.encode, self.most, self.most_chars = encode, most, most_chars
        self._clear()

    def _clear(self) -> None:
        self.number, self.chars = _Numbers(), 0
        self.flat, self.stop = array("i"), array("q", [0])

    def column(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, given as lists of pieces, and the n + 1 bounds of each text's ids."""
        if len(self.number) > self.most or self.chars > self.most_chars:
            self._clear()
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parts)), np.int64)
        if new := self.number.new:
            ids, lengths = self.encode(new)
            self.stop.frombytes((self.stop[-1] + np.cumsum(lengths)).astype(np.int64).tobytes())
            self.flat.frombytes(ids.astype(np.int32).tobytes())
            self.chars += sum(map(len, new))
            self.number.new = []
        stop = np.array(self.stop, np.int64)
        take = stop[at + 1] - stop[at]
        ends = np.cumsum(take)
        out = np.array(self.flat, np.int32)[np.repeat(stop[at] - (ends - take), take) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.concatenate([[0], ends])[np.cumsum([0, *map(len, parts)])]


def flat_ids(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all lists, flat, and the length of each."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(lengths.sum())), lengths


class WordEncoder:
    """Ids of a file of the tokenizers library, without special tokens, for a vocabulary that
    lower-cases, normalises, drops white space and splits by ``SPLIT``.

    Plain texts are lower-cased and split here, and each piece is encoded once; any other is encoded whole.
    """

    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.split = plain_pattern(self.SPLIT)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.store = PieceStore(self._ids)

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain pieces are encoded as one text: each of them ends with the next token that ends a word."""
        if not all(map(is_plain, pieces)):
            return flat_ids([self._encode(p) for p in pieces])
        parts = [self._encode(" ".join(pieces[k : k + 4096])) for k in range(0, len(pieces), 4096)]
        ids = np.concatenate([np.array(p, np.int32) for p in parts])
        return ids, np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null as empty), and the n + 1 bounds of each text's ids."""
        given = [t or "" for t in texts.to_pylist()]
        if all(map(is_plain, given)):
            return self.store.column([self.split.findall(t.lower()) for t in given])
        lists = []
        for t in given:
            if is_plain(t):
                lists.append(self.store.column([self.split.findall(t.lower())])[0])
            else:
                lists.append(np.array(self._encode(t), np.int32))
        return np.concatenate([np.empty(0, np.int32), *lists]), np.cumsum([0, *map(len, lists)])


class RankEncoder:
    """Ids of a file of ranks, by the tiktoken library."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null as empty), and the n + 1 bounds of each text's ids."""
        ids = [np.array(self.model.encode_ordinary(t or ""), np.int32) for t in texts.to_pylist()]
        return np.concatenate([np.empty(0, np.int32), *ids]), np.cumsum([0, *map(len, ids)])


def cached_encoder(make: Callable, *args: str) -> WordEncoder | RankEncoder:
    """One encoder in a Python worker."""
    return held.model((make.__name__, *args), lambda: make(*args))
