"""Whole texts to ids of the word vocabulary, for the packing and the binary output."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from reachflow.llm import common
from reachflow.llm.transducer import Merges, Table, Transducer

#: Texts without other characters change by no normalisation but lower-casing, one character at a time, and the
#: first byte of a character tells a letter from a sign. An apostrophe before a letter may be a contraction.
ODD = re.compile("[^\t\n\r -~¡-©«¬®-±´¶-¸»¿À-ÖØ-öø-įı-ňŊ-ž‐-‧‰-⁞€]")
CONTRACTION = re.compile("'[A-Za-zÀ-ž]")
END, SHIFT = "</w>", 0x1000
#: The memory of words is emptied beyond so many.
MOST_WORDS = 1 << 18
SPACE, LETTER, DIGIT, SIGN = range(4)
KINDS = np.full(256, SIGN, np.uint8)
KINDS[[9, 10, 13, 32]] = SPACE
KINDS[48:58] = DIGIT
KINDS[[*range(65, 91), *range(97, 123), 0xC3, 0xC4, 0xC5]] = LETTER


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def symbols(token: str) -> str:
    """A vocabulary's token as symbols: the one that ends a word is shifted instead of marked."""
    return token[: -len(END) - 1] + chr(ord(token[-len(END) - 1]) + SHIFT) if token.endswith(END) and len(token) > len(END) else token


class WordEncoder:
    """Encodes texts as the tokenizers library does with the vocabulary file.

    The vocabulary drops white space, lower-cases, and takes runs of letters, runs of signs and single digits as words.
    Texts of plain characters are cut into words by whole arrays, and the transducer of the merges encodes the words
    that the memory of word hashes lacks; the memory is emptied when full. Other texts go through the library.
    """

    def __init__(self, path: str):
        self.path, self.tokenizer = path, None
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        vocab, special = said["model"]["vocab"], {t["content"] for t in said["added_tokens"]}
        made = [vocab[a + b if not a.endswith(END) else a[: -len(END)] + b] for a, b in said["model"]["merges"]]
        if len(set(made)) != len(made):
            raise ValueError("a token has two merges")
        merges = Merges([(vocab[a], vocab[b]) for a, b in said["model"]["merges"]], made)
        self.transducer = Transducer({symbols(t): i for t, i in vocab.items() if t not in special}, merges.get, merges.parts)
        self.letters = np.array([ord(x) for x in byte_letters()], np.uint32)
        self.forget()

    def forget(self) -> None:
        self.known = Table()
        self.first, self.many, self.store, self.at, self.size = (np.zeros(0, np.int32) for _ in range(5))
        self.text = np.zeros(0, np.uint8)

    def library(self, texts: list[str]) -> list[bytes]:
        """The ids as the library gives them; it is loaded for the first text."""
        if not texts:
            return []
        if self.tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.encode_special_tokens = True
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def remember(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Encodes the words and gives their places in memory."""
        where = common.run_positions(starts, sizes)
        symbols = self.letters[data[where]]
        symbols[np.cumsum(sizes) - 1] += SHIFT
        ids, counts = self.transducer.encode_runs(symbols, sizes)
        numbers = np.arange(len(self.first), len(self.first) + len(starts), dtype=np.int32)
        for name, ends, begin in (("first", counts, len(self.store)), ("at", sizes, len(self.text))):
            setattr(self, name, np.concatenate((getattr(self, name), (begin + np.cumsum(ends) - ends).astype(np.int32))))
        self.many, self.size = (np.concatenate((old, new.astype(np.int32))) for old, new in ((self.many, counts), (self.size, sizes)))
        self.store, self.text = np.concatenate((self.store, ids)), np.concatenate((self.text, data[where]))
        return numbers

    def numbers(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The place in memory of each word of data; unknown words are encoded first.

        A hash only proposes a place: the word's bytes are compared with those that stand there.
        """
        keys = common.run_hashes(data, starts, sizes)
        found = self.known.get(keys)
        lack = np.flatnonzero(found < 0)
        if len(lack):
            new, at, inverse = np.unique(keys[lack], return_index=True, return_inverse=True)
            if self.known.used + len(new) > MOST_WORDS and self.known.used:
                self.forget()
                return self.numbers(data, starts, sizes)
            numbers = self.remember(data, starts[lack[at]], sizes[lack[at]])
            self.known.put(new, numbers)
            found[lack] = numbers[inverse]
        alike = self.size[found] == sizes
        alike[alike] = common.same_runs(data, starts[alike], self.text, self.at[found[alike]], sizes[alike])
        if not alike.all():  # words of equal hashes
            other = np.flatnonzero(~alike)
            found[other] = self.remember(data, starts[other], sizes[other])
        return found

    def plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts of plain characters."""
        if not texts:
            return []
        data, begins = common.joined([t.lower().encode() for t in texts])
        kinds = KINDS[data]
        if data.size and data.max() >= 0x80:
            after = np.flatnonzero((data & 0xC0) == 0x80)  # a character's later bytes are of the kind of its first
            kinds[after] = kinds[after - 1]
            kinds[after] = kinds[after - 1]
        cut = np.concatenate(([True], (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)))
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(data)))
        words = kinds[starts] != SPACE
        starts, sizes = starts[words], sizes[words]
        numbers = self.numbers(data, starts, sizes)
        counts = self.many[numbers]
        ids = self.store[common.run_positions(self.first[numbers], counts)].astype("<u4").tobytes()
        ends = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, begins)] * 4
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        plain = [not (ODD.search(t) or CONTRACTION.search(t)) for t in texts]
        fast = iter(self.plain([t for t, p in zip(texts, plain, strict=True) if p]))
        slow = iter(self.library([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [next(fast if p else slow) for p in plain]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder of the vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
