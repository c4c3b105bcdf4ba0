"""Whole-text token ids from public vocabulary files, at a few microseconds a new word.

Both kinds of vocabulary split a text into words before merging, and no merge crosses a word, so the ids of a text are
those of its words in order. Byte-level vocabularies run in the tiktoken library, built from the same file; word-level
ones run the tokenizers library's own model on each new word and remember the ids. Whatever the short cuts do not
cover (special tokens' strings, rare control characters, letters outside Latin-1) goes to the tokenizers library whole.
Ids are returned as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable

import numpy as np

#: Words remembered per process; once half as many are new, those not used since the half before are forgotten.
CACHE_WORDS = 400_000
#: Longer words are encoded each time they occur.
CACHE_CHARS = 64

#: The splitting pattern of the byte-level vocabulary, in its equivalent possessive form.
BYTE_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: The splitting pattern of the word-level vocabulary, for lower-cased Latin-1 words.
_WORD_SPLIT = re.compile(r"[a-zà-öø-ÿ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\sa-zà-öø-ÿ0-9]+")
_LATIN_WORD = re.compile(r"[!-~À-ÖØ-Þà-öø-ÿ]+")  # without the sharp s, which the library splits off
#: What may need the library even in a word of ASCII alone.
_ASCII_ODD = re.compile(r"<\||[\x00-\x08\x0e-\x1f\x7f]")
_MARKED_SPLIT = re.compile(_WORD_SPLIT.pattern + r"|\n")
_MARK = 0xFFFFFFFF
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")

_encoders: dict[str, Callable[[str], bytes]] = {}
_by_words: dict[str, Callable[[list[str]], tuple[np.ndarray, np.ndarray]]] = {}


def byte_symbols() -> dict[int, str]:
    """The printable symbol that stands for each byte in byte-level vocabulary files: printable Latin-1 bytes stand
    for themselves, the others follow in order from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(printable))
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class _Memory(dict):
    """Word to ids, filled on first use."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS // 2:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def library_encoder(path: str) -> Callable[[str], bytes]:
    """The tokenizers library on the whole text: the definition that the faster encoders must equal."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return lambda text: _packed(library.encode(text, add_special_tokens=False).ids)


def _byte_encoder(path: str, spec: dict) -> Callable[[str], bytes]:
    import tiktoken

    special = {x["content"] for x in spec["added_tokens"]}
    byte_of = {symbol: b for b, symbol in byte_symbols().items()}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=BYTE_SPLIT, mergeable_ranks=ranks, special_tokens={})
    whole = library_encoder(path)

    def encode(text: str) -> bytes:
        if "<|" in text:
            return whole(text)
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    return encode


def _word_encoder(path: str, spec: dict) -> Callable[[str], bytes]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    model = library.model
    symbol = byte_symbols()
    whole = lambda text: _packed(library.encode(text, add_special_tokens=False).ids)

    def part(lowered: str) -> bytes:
        if lowered == "\n":
            return _packed([_MARK])
        symbols = lowered if lowered.isascii() else lowered.encode().decode("latin-1").translate(symbol)
        return _packed([t.id for t in model.tokenize(symbols)])

    parts = _Memory(part)

    def word(text: str) -> bytes:
        if "<|" in text or not _LATIN_WORD.fullmatch(text):
            return whole(text)
        return b"".join(map(parts.__getitem__, _WORD_SPLIT.findall(text.lower())))

    words = _Memory(word)

    def encode(text: str) -> bytes:
        if any(c in text for c in _SEPARATORS):
            return whole(text)
        return b"".join(map(words.__getitem__, text.split()))

    def of_words(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids of all. The parts of plain words are looked up together, with a mark
        after each word."""
        strange = _ASCII_ODD.search("\n".join(distinct))
        if strange is None:
            odd = np.array([not (w.isascii() or _LATIN_WORD.fullmatch(w)) for w in distinct], bool)
        else:
            odd = np.array(["<|" in w or not _LATIN_WORD.fullmatch(w) for w in distinct], bool)
        plain = [w for w, is_odd in zip(distinct, odd.tolist(), strict=True) if not is_odd]
        found = np.frombuffer(b"".join(map(parts.__getitem__, _MARKED_SPLIT.findall("\n".join([*plain, ""]).lower()))), "<u4")
        marks = np.flatnonzero(found == _MARK)
        others = [words[w] for w, is_odd in zip(distinct, odd.tolist(), strict=True) if is_odd]
        counts = np.empty(len(distinct), np.int64)
        counts[~odd] = np.diff(marks, prepend=-1) - 1
        counts[odd] = [len(x) // 4 for x in others]
        ids = np.empty(int(counts.sum()), "<u4")
        from_odd = np.repeat(odd, counts)
        ids[~from_odd] = found[found != _MARK]
        ids[from_odd] = np.frombuffer(b"".join(others), "<u4")
        return counts, ids

    _by_words[path] = of_words
    return encode


def encoder(path: str) -> Callable[[str], bytes]:
    """An encoder for the vocabulary file at path, kept for the life of the process."""
    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        first = (spec.get("pre_tokenizer") or {}).get("type")
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if first == "ByteLevel" and not spec.get("normalizer"):
            _encoders[path] = _byte_encoder(path, spec)
        elif first == "Sequence" and kinds == ["NFC", "Replace", "Lowercase"]:
            _encoders[path] = _word_encoder(path, spec)
        else:
            _encoders[path] = library_encoder(path)
    return _encoders[path]


def encode_batch(path: str, texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an Arrow array of texts: how many ids each has, and all ids, end_id after each text. Null is as empty.

    A word-level vocabulary sees each distinct word of the array once; Arrow splits the texts and lays the ids out.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    ids_of = encoder(path)
    texts = pc.fill_null(texts, "")
    if path not in _by_words or pc.any(pc.match_substring_regex(texts, f"[{''.join(_SEPARATORS)}]")).as_py():
        end = _packed([end_id])
        data = [(ids_of(t) if t else b"") + end for t in texts.to_pylist()]
        return np.array([len(x) // 4 for x in data], np.int64), np.frombuffer(b"".join(data), "<u4")
    split = pc.utf8_split_whitespace(texts)
    coded = split.values.dictionary_encode()
    counts, ids = _by_words[path](coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    last = split.offsets.to_numpy()[1:]
    order = np.insert(coded.indices.to_numpy(), last, len(counts))  # the end id counts as one more word
    counts = np.append(counts, 1)
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    words = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.append(ids, np.uint32(end_id))))
    ends = np.cumsum(counts[order])[last + np.arange(len(last))]
    return np.diff(ends, prepend=0), words.take(pa.array(order)).flatten().to_numpy()
