"""Tokenizer loading by file kind, one instance per Python worker."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import itertools
import os
import re
import struct
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Token appended to each document by the binary writer and the packer.
END_ID = 2
#: Bytes of remembered words, and what one takes beside its characters and ids.
MEMO_BYTES = 200 << 20
ENTRY_BYTES = 170
LONG_WORD = 64
#: A space after white space (U+001C to U+001F are taken for that, too).
SPACE_AFTER_SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
)


@functools.lru_cache(maxsize=4)
def hf_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def sentencepiece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode_ids(path: str, texts: list[str]) -> list[list[int]]:
    """Ids by the library of the file's kind, without begin, end or added special tokens."""
    if path.endswith(".model"):
        return sentencepiece_model(path).encode(texts, num_threads=1)
    return [e.ids for e in hf_tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def _class(member: Callable[[str], bool]) -> str:
    """The characters of the basic plane that are members, as ranges of a regular expression's class."""
    inside = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and member(chr(c))]
    starts = [c for c, before in zip(inside, [-2, *inside], strict=False) if c != before + 1]
    ends = [c for c, after in zip(inside, [*inside[1:], -2], strict=True) if after != c + 1]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends, strict=True))


@functools.lru_cache(maxsize=1)
def _word_pattern() -> re.Pattern[str]:
    """The byte-level pre-tokenizer's words, for the basic plane; explicit classes make it twice as fast."""
    blank = regex.compile(r"\p{White_Space}")
    letter = _class(lambda c: unicodedata.category(c)[0] == "L")
    number = _class(lambda c: unicodedata.category(c)[0] == "N")
    space = _class(lambda c: blank.match(c) is not None)
    return re.compile(
        f"'(?:[stmd]|re|ve|ll)| ?[{letter}]++| ?[{number}]++| ?[^{space}{letter}{number}]++"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    )


class _Memo(dict):
    """word -> its ids' bytes, encoded when first asked for; words asked for before `turn` are taken over when asked for again."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.encode, self.encode_all = tokenizer.encode, tokenizer.encode_batch_fast
        self.held = 0
        self.older: dict[str, bytes] = {}
        vocabulary = tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # tokens that begin with a space
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def __missing__(self, word: str) -> bytes:
        if (raw := self.older.pop(word, None)) is None:
            ids = self.encode(word, add_special_tokens=False).ids
            raw = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) > LONG_WORD:
                return raw
        self._keep(word, raw)
        return raw

    def _keep(self, word: str, raw: bytes) -> None:
        self[word] = raw
        self.held += ENTRY_BYTES + 2 * len(word) + len(raw)

    def learn(self, words: set[str]) -> None:
        """Encodes those of the words that consist of a space and no further white space as one text.

        Each of them is a word of the pre-tokenizer in that text, too, and tokens begin with a space where one of them
        begins and nowhere else. The library takes half the time that it takes for one after the other.
        """
        row = []
        for word in words:
            if (raw := self.older.pop(word, None)) is not None:
                self._keep(word, raw)
            elif 1 < len(word) <= LONG_WORD and word[0] == " " and not word[1].isspace():
                row.append(word)
        if not row:
            return
        ids = np.array(self.encode_all(["".join(row)], add_special_tokens=False)[0].ids, "<u4")
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) == len(row):
            raw, at = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            for word, (i, j) in zip(row, itertools.pairwise(at), strict=True):
                self._keep(word, raw[i:j])

    def turn(self) -> None:
        """Forgets the words that weren't asked for since the last turn."""
        self.older = dict(self)
        super().clear()
        self.held = 0

    def clear(self) -> None:
        super().clear()
        self.older = {}
        self.held = 0


#: tokenizer's path -> the characters of WordMemo._odd_characters, which take longer to find than to keep.
_ODD: dict[str, str] = {}


class WordMemo:
    """Byte-level BPE by words: each distinct word is encoded by the library once and then remembered.

    Merges never reach across the words of the pre-tokenizer, so ids of a text are those of its words in a
    row. A text goes whole to the library if it holds a special token or a character at which the words
    found here and the library's own have not been seen to agree (all of the basic plane is compared at
    the start), and so does every text if the tokenizer isn't plain byte-level BPE.
    """

    def __init__(self, path: str) -> None:
        import json

        self.tokenizer = hf_tokenizer(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        self.words = _word_pattern()
        self.plain = (
            spec["model"]["type"] == "BPE"
            and spec["normalizer"] is None
            and spec["truncation"] is None
            and spec["padding"] is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
        )
        if path not in _ODD:
            _ODD[path] = self._odd_characters() if self.plain else ""
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.odd = re.compile(f"[{_ODD[path]}\U00010000-\U0010ffff]")
        self.memo = _Memo(self.tokenizer)

    def _odd_characters(self) -> str:
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        odd = []
        for code in [*range(0x80), *range(0x80, 0xD800), *range(0xE000, 0x10000)]:
            c = chr(code)
            probe = f"a{c}a 1{c}1 !{c}! {c}{c}a"
            if [span for _, span in cut(probe)] != [m.span() for m in self.words.finditer(probe)]:
                odd.append(re.escape(c))
        return "".join(odd)

    def _safe(self, text: str) -> bool:
        return not any(s in text for s in self.special) and (text.isascii() or not self.odd.search(text))

    def raw(self, texts: list[str], memo_bytes: int) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers.

        Beyond memo_bytes, words are forgotten that weren't asked for lately; words of more than LONG_WORD characters
        go unremembered.
        """
        if self.memo.held > memo_bytes // 2:  # the other half is for the words before the last turn
            self.memo.turn()
        fast = [self.plain and self._safe(t) for t in texts]
        parted = iter(self._by_spaces([t for t, f in zip(texts, fast, strict=True) if f]))
        whole = [t for t, f in zip(texts, fast, strict=True) if not f]
        rest = iter(self.tokenizer.encode_batch_fast(whole, add_special_tokens=False))
        return [next(parted) if f else np.array(next(rest).ids, "<u4").tobytes() for f in fast]

    def _by_spaces(self, texts: list[str]) -> list[bytes]:
        """Ids of safe texts, cut before each space; of those with a space after white space, by the pre-tokenizer's words.

        A word with a space begins with it or is white space alone, so a space behind anything but white space begins
        a word, and what comes before it doesn't look beyond it. Each distinct piece of all texts is looked up once.
        """
        column = pa.array(texts, pa.large_string())
        runs = pc.match_substring_regex(column, SPACE_AFTER_SPACE).to_pylist()
        pieces = pc.split_pattern(column.filter(pa.array([not r for r in runs], pa.bool_())), " ")
        ends = pieces.offsets.to_numpy()
        coded = pieces.values.dictionary_encode()
        at = coded.indices.to_numpy().copy()
        distinct = [" " + p for p in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        firsts = pieces.values.take(pa.array(ends[:-1])).to_pylist()
        count = len(distinct) + len(firsts)
        at[ends[:-1]] = np.arange(len(distinct), count)  # no space precedes a text's first piece
        asked = distinct + firsts + [t for t, r in zip(texts, runs, strict=True) if r]
        memo = self.memo
        raw = list(map(memo.get, asked))
        left = [i for i, own in enumerate(raw) if own is None]
        parted = [self.words.findall(asked[i]) for i in left]
        memo.learn({w for words in parted for w in words if w not in memo})
        for i, words in zip(left, parted, strict=True):
            raw[i] = memo[words[0]] if len(words) == 1 else b"".join(map(memo.__getitem__, words))
        ids = pa.array(raw[:count], pa.large_binary()).take(pa.array(at))
        bounds = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[ends].tolist()
        held = memoryview(ids.buffers()[2] or b"")
        cut, rest = (held[i:j].tobytes() for i, j in itertools.pairwise(bounds)), iter(raw[count:])
        return [next(rest) if r else next(cut) for r in runs]


@functools.lru_cache(maxsize=4)
def word_memo(path: str) -> WordMemo:
    return WordMemo(path)


def release_words() -> None:
    """Gives back what earlier tasks of this Python worker left: remembered words, tokenizers, freed Arrow buffers.

    Workers go from operator to operator, and an executor's memory is shared by several of them.
    """
    word_memo.cache_clear()
    hf_tokenizer.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library can, freed memory goes back to the system
        ctypes.CDLL(None).malloc_trim(0)


def tidy(task: Callable) -> Callable:
    """A task that leaves its Python worker small: idle workers keep what they hold, and an executor has several."""

    @functools.wraps(task)
    def run(*args, **kwargs):
        if word_memo.cache_info().currsize:
            release_words()
        try:
            yield from task(*args, **kwargs)
        finally:
            release_words()

    return run


def encode_raw(path: str, texts: list[str], memo_bytes: int = MEMO_BYTES) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers; about memo_bytes of words are remembered in between."""
    if path.endswith(".json"):
        return word_memo(path).raw(texts, memo_bytes)
    return [np.array(ids, "<u4").tobytes() for ids in encode_ids(path, texts)]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
