"""Byte-level BPE with content-defined chunk reuse.

Texts are cut into chunks where a rolling hash of the last 16 bytes says so, so
equal passages in different documents give equal chunks. A task encodes each
distinct chunk once and keeps the result in a bounded cache (a chunk that has
left the cache is encoded again: the bound costs time, never exactness).

Chunks are then joined. Text breaks between a visible ASCII character and a space or
newline whatever surrounds it: no alternative of the split pattern runs
across such a place, so encoding piece by piece is exact there. At each join the
text from the last break of the left chunk to the second break of the right one
is encoded again. If what it gives between the first two breaks of the right chunk is
exactly what the chunk has there, the new tokens replace both chunks' tokens up to that place. Else, and where a chunk's
own tokens don't end at its breaks, the window grows over the
whole chunk, and on, until a chunk agrees or the text ends.

The vocabulary is read from a tokenizers JSON file on the driver and broadcast
(a file of fixed size). Its merges are applied as ranks; a file whose merges
aren't in the order of their ids is refused.

Defined cases: a null text counts as empty and has no tokens; the special token's
string in a text becomes the special token, as in the library; unpaired
surrogates can't occur in Spark strings; repeated rows stay apart.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from bisect import bisect_left
from collections import OrderedDict
from itertools import accumulate

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import slices

#: One chunk in 2**CUT_BITS bytes, about.
CUT_BITS = 9
#: Tokens that a task's cache of chunks holds at most.
CACHE_TOKENS = 2_000_000
#: The split pattern of byte-level BPE files. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BREAK = re.compile(rb"[\x21-\x7e](?=[ \n])")
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file: itself if it is visible, else the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Chunk:
    """A chunk's tokens, and where they can be cut: (bytes, tokens) before its first, second and last break."""

    __slots__ = ("first", "ids", "last", "second")

    def __init__(self, ids: list[int], first=None, second=None, last=None):
        self.ids = array("i", ids)
        #: All of them or none.
        self.first, self.second, self.last = (first, second, last) if first and second and last else (None, None, None)


class Codec:
    """Encodes and decodes as the tokenizers library does with the same file."""

    def __init__(self, file: bytes, cut_bits: int = CUT_BITS, cache_tokens: int = CACHE_TOKENS):
        spec = json.loads(file)
        model, split = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("not a plain byte-level BPE file")
        of = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        if made != sorted(made):
            raise ValueError("merges aren't in the order of their ids")
        self.bpe = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (1 + max([*ranks.values(), *self.special.values()]))
        for token, i in [*ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes_of[i] = token
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.sizes = [len(b) for b in self.bytes_of]
        self.mask, self.most = np.uint64(((1 << cut_bits) - 1) << 20), cache_tokens
        self.cache: OrderedDict[bytes, Chunk] = OrderedDict()
        self.held = self.asked = self.encoded = 0
        self.around = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def plain(self, text: bytes) -> list[int]:
        return self.bpe.encode_ordinary(text.decode()) if text else []

    def cuts(self, text: bytes) -> list[int]:
        """Where chunks end: after bytes at which the hash of the last 16 bytes has its chosen bits zero, at character starts."""
        data = np.frombuffer(text, np.uint8)
        h = _GEAR[data]
        for step in (1, 2, 4, 8):
            h[step:] = h[step:] + (h[:-step] << np.uint64(step))
        at = np.nonzero((h & self.mask) == 0)[0] + 1
        at = at[at < len(data)]
        return [*at[(data[at] & 0xC0) != 0x80].tolist(), len(data)]

    def chunk(self, text: bytes) -> Chunk:
        self.asked += 1
        found = self.cache.get(text)
        if found is not None:
            self.cache.move_to_end(text)
            return found
        self.encoded += 1
        ids = self.plain(text)
        out = Chunk(ids)
        first, last = _BREAK.search(text), max(text.rfind(b" "), text.rfind(b"\n"))
        second = _BREAK.search(text, first.end()) if first else None
        while last > 0 and not 0x21 <= text[last - 1] <= 0x7E:
            last = max(text.rfind(b" ", 0, last), text.rfind(b"\n", 0, last))
        if second:
            ends = list(accumulate(map(self.sizes.__getitem__, ids)))
            out = Chunk(ids, *(self._tokens(ends, at) for at in (first.end(), second.end(), last)))
        self.cache[text] = out
        self.held += len(ids)
        while self.held > self.most:
            self.held -= len(self.cache.popitem(last=False)[1].ids)
        return out

    @staticmethod
    def _tokens(ends: list[int], at: int) -> tuple[int, int] | None:
        """(at, tokens before it), if a token ends there."""
        k = bisect_left(ends, at)
        return (at, k + 1) if k < len(ends) and ends[k] == at else None

    def segment(self, text: bytes) -> list[int]:
        """The tokens of a text without special tokens."""
        cuts = self.cuts(text)
        if len(cuts) == 1:
            return self.chunk(text).ids.tolist()
        out: list[int] = []
        open_, begin = None, 0
        for end in cuts:
            part = text[begin:end]
            c = self.chunk(part)
            if c.first:
                if open_ is None:
                    out += c.ids[: c.last[1]]
                    open_ = begin + c.last[0]
                else:
                    again, both = self.plain(text[open_ : begin + c.second[0]]), c.ids[c.first[1] : c.second[1]].tolist()
                    if again[-len(both) :] == both:
                        out += again
                        out += c.ids[c.second[1] : c.last[1]]
                        open_ = begin + c.last[0]
            elif open_ is None:
                open_ = begin
            begin = end
        return out + self.plain(text[open_:])

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if self.around is None or not any(s in text for s in self.special):
            return self.segment(text.encode())
        out: list[int] = []
        for part in self.around.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.segment(part.encode())
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def ids_digest(self, ids: list[int]) -> str:
        return hashlib.sha256(",".join(map(self.text_of.__getitem__, ids)).encode()).hexdigest()


#: The codec that a Python worker keeps from one task to the next.
_KEPT: dict[bytes, Codec] = {}


def kept_codec(file: bytes) -> Codec:
    """The codec of a file, without chunks: idle workers hold its tables only."""
    key = hashlib.sha256(file).digest()
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Codec(file)
    return _KEPT[key]


def forget_chunks(codec: Codec) -> None:
    codec.cache.clear()
    codec.held = 0


#: What `coded` can return for each text.
OUTPUTS = {
    "ids": ("array<int>", pa.list_(pa.int32()), lambda codec, ids: ids),
    "decoded": ("string", pa.string(), lambda codec, ids: codec.decode(ids)),
    "n_tokens": ("bigint", pa.int64(), lambda codec, ids: len(ids)),
    "ids_sha256": ("string", pa.string(), lambda codec, ids: codec.ids_digest(ids)),
    "decoded_sha256": ("string", pa.string(), lambda codec, ids: hashlib.sha256(codec.decode(ids).encode()).hexdigest()),
}


def coded(docs: DataFrame, file: str, want: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """doc_id and the outputs in `want` of each text, encoded and decoded with the vocabulary `file`."""
    with open(file, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    outputs = [OUTPUTS[name] for name in want]
    names = ["doc_id", *want]

    def run(batches):
        codec = kept_codec(held.value)
        try:
            for batch in slices(batches):
                texts, out = batch.column("text"), [[] for _ in want]
                for t in texts:
                    ids = codec.encode(t.as_py() or "")
                    for column, (_, _, f) in zip(out, outputs, strict=True):
                        column.append(f(codec, ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(c, o[1]) for c, o in zip(out, outputs, strict=True))], names
                )
        finally:
            forget_chunks(codec)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{name} {o[0]}" for name, o in zip(want, outputs, strict=True))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_query(docs: DataFrame, file: str | None = None) -> DataFrame:
    return coded(docs, file or vocabulary(), ("n_tokens", "ids_sha256", "decoded_sha256"))
