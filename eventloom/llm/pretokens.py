"""Pre-tokens of the word-level BPE vocabulary, and their ids, each distinct one encoded once.

The tokenizer encodes each pre-token alone, so a text's ids are its pre-tokens' ids one after
the other. Texts of plain Latin characters are split here; whatever else could normalise
differently (other scripts, combining or control characters, special strings) goes through
the library's own normalizer and pre-tokenizer. No pre-token crosses white space, so the ids of
a word, whatever stands between white space, are kept too, and only distinct words are split.
"""

from __future__ import annotations

import json
import os
import re
import threading
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
#: Distinct words and pre-tokens whose ids a worker keeps, but for the pre-tokens of the last texts.
KEPT = 1_000_000
#: Seconds without a task after which a worker lets its ids and tokenizers go.
IDLE_S = 3.0
#: Pre-tokens that are encoded as one text: much faster than one by one.
JOINED = 50

# Characters below U+0250 are their own canonical composition, but for U+0130 lower-casing is one to one.
_LATIN = [chr(c) for c in range(0xA1, 0x250) if c != 0x130]
# 23 capitals (Ə, Ɔ, Ɛ ...) lower-case to letters beyond U+024F: texts with them go to the library.
_CLOSED = [c for c in _LATIN if c.lower() in _LATIN or c.lower().isascii()]
_PLAIN = re.compile(f"[\t\n\r\x20-\x7e{''.join(_CLOSED)}–-…]*")
_LETTERS = "a-z" + "".join(c for c in _LATIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "0-9" + "".join(c for c in _LATIN if unicodedata.category(c)[0] == "N")
_PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def plain_tokenizer(path: str):
    """The same without its normalizer, for texts that went through it: lower-casing is not the same twice over (U+0130
    before some combining marks)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        return Tokenizer.from_str(json.dumps(json.load(f) | {"normalizer": None}))


@cache
def _special(path: str) -> re.Pattern[str] | None:
    added = tokenizer(path).get_added_tokens_decoder().values()
    return re.compile("(" + "|".join(re.escape(t.content) for t in added) + ")") if added else None


def is_plain(text: str) -> bool:
    return _PLAIN.fullmatch(text) is not None and "<|" not in text


def pretokens(text: str, path: str) -> list[str]:
    if is_plain(text):
        return _PRETOKEN.findall(text.lower())
    out: list[str] = []
    special, tok = _special(path), tokenizer(path)
    for i, part in enumerate(special.split(text) if special else [text]):
        if i % 2:
            out.append(part)
        elif part:
            part = tok.normalizer.normalize_str(part)
            out += [part[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(part)]
    return out


def encode_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct pre-tokens, normal already, one after the other, and how many each has."""
    tok = plain_tokenizer(path)
    groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
    ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for group, found in zip(groups, tok.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
        which = found.word_ids
        if None not in which and len(n := np.bincount(np.array(which, np.int64))) == len(group) and n.all():
            ids.append(np.array(found.ids, np.uint32))
            counts.append(n)
        else:
            # Special strings, or pre-tokens that split anew beside others.
            each = [e.ids for e in tok.encode_batch(group, add_special_tokens=False)]
            ids.append(np.array([i for x in each for i in x], np.uint32))
            counts.append(np.array([len(x) for x in each], np.int64))
    return np.concatenate(ids), np.concatenate(counts)


class Pieces:
    """Ids of words and pre-tokens; a bounded number of distinct ones is kept."""

    def __init__(self, path: str):
        self.path = path
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.n_ids = 0

    def _add(self, words: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        need, k = self.n_ids + len(ids), len(self.at)
        while need > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while k + len(words) + 1 > len(self.start):
            self.start = np.resize(self.start, 2 * len(self.start))
        self.ids[self.n_ids : need] = ids
        self.start[k : k + len(words) + 1] = self.n_ids + np.concatenate(([0], np.cumsum(lens)))
        self.at.update(zip(words, range(k, k + len(words)), strict=True))
        self.n_ids = need

    def _add_words(self, new: list[str]) -> None:
        """Pre-tokens are encoded; the ids of other words are their pre-tokens' ids."""
        own, made, parts, n_parts = [], [], [], []
        for word in new:
            split = _PRETOKEN.findall(word) if is_plain(word) else [word]
            if len(split) == 1:
                own.append(word)
            else:
                made.append(word)
                parts += split
                n_parts.append(len(split))
        own += [p for p in set(parts).difference(own) if p not in self.at]
        if own:
            self._add(own, *encode_words(own, self.path))
        if made:
            ids, ends = self._ids_of(self._places(parts))
            self._add(made, ids, np.diff(ends[np.cumsum(n_parts)], prepend=0))

    def _places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def _ids_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids at places, in order, and where each place's begin, with the end of the last."""
        start = self.start[places]
        lens = self.start[places + 1] - start
        ends = np.concatenate(([0], np.cumsum(lens)))
        return self.ids[np.repeat(start - ends[:-1], lens) + np.arange(ends[-1])], ends

    def _learnt(self, words: list[str]) -> np.ndarray:
        """Places of distinct words; new ones are learnt."""
        places = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(places < 0)
        if not len(new):
            return places
        if self.at and len(self.at) + len(new) > KEPT:
            self._clear()
            return self._learnt(words)
        unknown = [words[i] for i in new.tolist()]
        self._add_words(unknown)
        places[new] = self._places(unknown)
        return places

    def learn(self, words: set[str]) -> None:
        self._learnt(list(words))

    def encode(self, words: list[str]) -> np.ndarray:
        """Ids of learnt words, in order."""
        return self._ids_of(self._places(words))[0]

    def encode_texts(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text. Each distinct word of the texts is looked up once."""
        whole = texts.to_pylist()
        plain = np.array([is_plain(t) for t in whole], bool)
        words = pc.ascii_split_whitespace(pc.utf8_lower(texts.filter(pa.array(plain))))
        order = np.flatnonzero(plain).tolist()
        if others := np.flatnonzero(~plain).tolist():
            words = pa.concat_arrays([words, pa.array([pretokens(whole[i], self.path) for i in others], words.type)])
            order += others
        each = words.flatten().dictionary_encode()
        places = self._learnt(each.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, ends = self._ids_of(places[each.indices.to_numpy()])
        edges = ends[words.offsets.to_numpy()].tolist()
        out = [ids[:0]] * len(whole)
        for i, a, b in zip(order, edges[:-1], edges[1:], strict=True):
            out[i] = ids[a:b]
        return out


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


_forgets: threading.Timer | None = None


def forget() -> None:
    """Lets ids and tokenizers go; a task at work keeps its own."""
    for kept in (pieces, tokenizer, plain_tokenizer, _special):
        kept.cache_clear()


@contextmanager
def lent_pieces(path: str) -> Iterator[Pieces]:
    """A worker's ids for one task. Tasks that follow at once find them again; then they go, as idle workers
    stand beside the stages that come after."""
    global _forgets
    if _forgets is not None:
        _forgets.cancel()
    try:
        yield pieces(path)
    finally:
        _forgets = threading.Timer(IDLE_S, forget)
        _forgets.daemon = True
        _forgets.start()


def token_counts(words: list[str], path: str) -> list[int]:
    return encode_words(words, path)[1].tolist()
