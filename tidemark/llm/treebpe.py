"""Exact encoding with a word-level BPE tokenizer by tree concatenation, and decoding.

The tokenizer never joins anything across ASCII white space, so a text is a sequence of chunks; it cuts a
normalised chunk into units (runs of letters, single digits, runs of other signs) and applies its merges
inside each. A long text is encoded as a tree: both halves are encoded on their own, then a window round the
join is encoded again, and grows until it holds white space on either side. What the halves made of their
parts of the window must be just what those parts give alone; then the window's own encoding takes their
place. A single unit of more than LEAF_BYTES bytes is handled in the same way one level down, on tokens: the
window grows until it shares neighbouring tokens with both halves; every pair of neighbours in the splice
then stands in one of the three encodings, which is what makes a sequence the encoding of its text.

Chunks and units repeat, so each worker keeps bounded caches from them to whatever form of their ids is
wanted; forms of a text are joins of those of its chunks. The halves of a long unit are encoded by THREADS threads. Chunks
with signs outside ASCII and Latin-1 are normalised and cut into units by the tokenizers library, long units are encoded
as trees too; only chunks with the tokenizer's special strings go to the library whole.

Cases: null text counts as empty and has no ids; a text of white space has none either; texts of any length
are handled in memory proportional to one text. Rows repeat as they do in the input. Other columns aren't read.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import quoted

LEAF_CHARS = 8192
LEAF_BYTES = 2048
WINDOW = 32
THREADS = 2
CACHE = 250_000  # entries of each generation of a cache; there are two

#: The tokenizer's unit pattern for lower-cased ASCII and Latin-1: contractions, letters, a digit, other signs.
_UNITS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
_CHUNKS = re.compile(r"[^\t-\r ]+")
_WHITE = re.compile(r"[\t-\r ]")
#: Latin-1 bytes that need no normalisation beyond lower case, and that lower case.
_SAFE = bytes([*range(9, 14), *range(32, 127), *range(161, 256)])
_LOWER = "".join(map(chr, range(256))).lower().encode("latin-1")
_SPECIAL = "<|"


def _byte_signs() -> list[str]:
    """The sign that byte-level tokenizers write for each byte: itself if printable, else the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Encoder:
    """The tokenizer in one file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.signs = _byte_signs()
        self.names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}

    # chunks

    def chunks(self, text: str) -> list[bytes | str]:
        """The white-space delimited chunks of a text: lower-cased Latin-1 bytes, or a string that the library is to encode."""
        if len(text) <= LEAF_CHARS:
            return self._split(text)
        return self._tree(text, 0, len(text))

    def _split(self, text: str) -> list[bytes | str]:
        if _SPECIAL not in text:
            try:
                raw = text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                if not raw.translate(None, _SAFE):
                    return raw.translate(_LOWER).split()
        return [self._chunk(c) for c in _CHUNKS.findall(text)]

    @staticmethod
    def _chunk(chunk: str) -> bytes | str:
        if _SPECIAL not in chunk:
            try:
                raw = chunk.encode("latin-1")
            except UnicodeEncodeError:
                return chunk
            if not raw.translate(None, _SAFE):
                return raw.translate(_LOWER)
        return chunk

    def _tree(self, text: str, a: int, b: int) -> list[bytes | str]:
        if b - a <= LEAF_CHARS:
            return self._split(text[a:b])
        mid = (a + b) // 2
        left, right = self._tree(text, a, mid), self._tree(text, mid, b)
        w = WINDOW
        while mid - w > a or mid + w < b:
            lo, hi = max(a, mid - w), min(b, mid + w)
            before = [lo + m.start() for m in _WHITE.finditer(text[lo:mid])][-1:] or [a - 1] * (lo == a)
            after = _WHITE.search(text, mid, hi)
            q = after.start() if after else b if hi == b else None
            if before and q is not None:
                p = before[0] + 1
                ends, starts = self._split(text[p:mid]), self._split(text[mid:q])
                if left[len(left) - len(ends) :] == ends and right[: len(starts)] == starts:
                    del left[len(left) - len(ends) :]
                    return left + self._split(text[p:q]) + right[len(starts) :]
            w *= 2
        return self._split(text[a:b])

    # ids

    def units(self, chunk: bytes | str) -> list[str]:
        return _UNITS.findall(chunk.decode("latin-1"))

    def library(self, chunk: str) -> list[int]:
        """A chunk of any script: normalised and cut into units by the library; long units are encoded as trees."""
        if len(chunk) <= LEAF_BYTES or _SPECIAL in chunk:
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(chunk))
        return [i for mapped, _ in cut for i in self._unit(mapped)]

    def ids(self, unit: str) -> list[int]:
        return self._unit(unit if unit.isascii() else "".join(map(self.signs.__getitem__, unit.encode())))

    def _unit(self, mapped: str) -> list[int]:
        if len(mapped) <= LEAF_BYTES:
            return [t.id for t in self.tokenizer.model.tokenize(mapped)]
        leaves = list(_leaves(0, len(mapped)))
        with ThreadPoolExecutor(THREADS) as pool:  # all halves of the lowest level at once
            made = dict(zip(leaves, pool.map(lambda ab: self._merged(mapped, *ab), leaves)))
        return [t for _, t in self._merge_tree(mapped, 0, len(mapped), made)]

    def _merged(self, mapped: str, a: int, b: int) -> list[tuple[int, int]]:
        found, at = [], a
        for t in self.tokenizer.model.tokenize(mapped[a:b]):
            found.append((at, t.id))
            at += len(t.value)  # the last one's word end isn't text, but nothing follows it
        return found

    def _merge_tree(self, mapped: str, a: int, b: int, leaves: dict[tuple[int, int], list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """(start, id) of mapped[a:b], for a unit that is encoded as if it ended at b, from its encoded leaves."""
        if (a, b) in leaves:
            return leaves[a, b]
        mid = (a + b) // 2
        left, right = self._merge_tree(mapped, a, mid, leaves), self._merge_tree(mapped, mid, b, leaves)
        w = WINDOW
        while mid - w > a or mid + w < b:
            lo, hi = max(a, mid - w), min(b, mid + w)
            window = self._merged(mapped, lo, hi)
            if hi < b:
                window.pop()  # it took the end of the window for the end of the unit
            at = {t: i for i, t in enumerate(window)}
            p = next((i for i in range(len(left) - 2, max(-1, len(left) - 2 - 2 * w), -1) if left[i] in at and left[i + 1] in at and at[left[i + 1]] == at[left[i]] + 1), None)
            q = next((i for i in range(min(len(right) - 1, 2 * w)) if right[i] in at and right[i + 1] in at and at[right[i + 1]] == at[right[i]] + 1), None)
            if p is not None and q is not None and left[p + 1][0] < right[q][0]:
                return left[:p] + window[at[left[p]] : at[right[q]]] + right[q:]
            w *= 2
        return self._merged(mapped, a, b)


def _leaves(a: int, b: int) -> Iterator[tuple[int, int]]:
    if b - a <= LEAF_BYTES:
        yield a, b
    else:
        yield from _leaves(a, (a + b) // 2)
        yield from _leaves((a + b) // 2, b)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    return Encoder(path)


class Cache(dict):
    """A bounded cache in two generations: what is asked for again moves to the young one, and what
    hasn't been by the time that the young one is full is forgotten."""

    def __init__(self) -> None:
        super().__init__()
        self.old: dict = {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Units(Cache):
    """From units to their ids."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.make = encoder(path).ids


class Forms(Cache):
    """From chunks to a form of their ids."""

    def __init__(self, path: str, form: Callable[[Encoder, list[int]], object]) -> None:
        super().__init__()
        self.encoder, self.form, self.units = encoder(path), form, Units(path)

    def make(self, chunk: bytes | str):
        if isinstance(chunk, str):
            return self.form(self.encoder, self.encoder.library(chunk))
        return self.form(self.encoder, [i for u in self.encoder.units(chunk) for i in self.units[u]])

    def of(self, text: str | None) -> list:
        return list(map(self.__getitem__, self.encoder.chunks(text or "")))


def packed(_: Encoder, ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def written(e: Encoder, ids: list[int]) -> tuple[bytes, bytes]:
    """Decimal ids, and the decoded tokens, each followed by a space."""
    return "".join([f"{i} " for i in ids]).encode(), "".join([e.names[i] + " " for i in ids]).encode()


@functools.lru_cache(maxsize=4)
def forms(path: str, kind: str) -> Forms:
    return Forms(path, {"packed": packed, "written": written, "plain": lambda _, ids: ids}[kind])


def encode(path: str, text: str | None) -> list[int]:
    return [i for part in forms(path, "plain").of(text) for i in part]


def decode(path: str, ids: list[int]) -> str:
    """As the tokenizer decodes: it has no decoder of its own, so its tokens are joined by spaces."""
    e = encoder(path)
    return " ".join(e.names[i] for i in ids)


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids, written in decimals, and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = forms(path, "written")
        for batch in batches:
            n, ids, texts = [], [], []
            for t in batch.column(1):
                found = cache.of(t.as_py())
                decimal = b"".join([x[0] for x in found])
                n.append(decimal.count(b" "))
                ids.append(hashlib.sha256(decimal[:-1]).hexdigest())
                texts.append(hashlib.sha256(b"".join([x[1] for x in found])[:-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
