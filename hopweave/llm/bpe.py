"""BPE encoding and decoding that reuses content-defined chunks.

A text is cut where a rolling hash of its bytes, taken at white space, hits a fixed pattern, so that passages which
documents share give the same chunks wherever they stand. A chunk is encoded once in a task and found again by its
bytes; within a new chunk the pre-tokens, which documents share far more, are found the same way. Both stores are bounded and start anew when full, so memory doesn't grow with the input.

Joins: the tokenizer's patterns never match across white space and drop it, and ASCII characters don't compose, so a
cut before ASCII white space between ASCII characters can't change a token. Where a join has another character beside
it, the words beside the join are encoded together and compared; if they disagree, the two chunks are joined and
encoded anew, with the next one too, until they agree.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hopweave.llm.common import as_bytes, map_batches, text_or_empty

#: The rolling hash covers so many bytes; one cut in so many white spaces.
WINDOW, CUT_ONE_IN = 8, 48
#: Bytes that a task's store of chunks holds, and pre-tokens in its other store.
CHUNK_BYTES, WORDS = 64_000_000, 400_000
_GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(29))).astype(np.uint64)


def cuts(text: bytes) -> list[int]:
    """Positions of ASCII white space before which the text is cut, from the hash of the WINDOW bytes before each."""
    if len(text) < 64:
        return []
    b = np.frombuffer(text, np.uint8)
    at = np.flatnonzero((b == 32) | ((b >= 9) & (b <= 13)))
    at = at[at >= WINDOW]
    if not len(at):
        return []
    h = np.zeros(len(at), np.uint64)
    for back in range(1, WINDOW + 1):
        h = (h << np.uint64(1)) + _GEAR[b[at - back]]
    return at[(h >> np.uint64(40)) % np.uint64(CUT_ONE_IN) == 0].tolist()


class Encoder:
    """Ids and decoded text exactly as the tokenizers library gives them for whole texts, special tokens not added.

    Chunks whose characters are all below U+0250 and that can't hold a special token follow the tokenizer's rules
    directly: such characters are their own NFC form and lower-case one by one, whatever stands beside them. Their
    pre-tokens are merged by a byte-pair engine to which a word's end is one more byte, 0xFF, that UTF-8 never has.
    Any other chunk goes to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.strings = [t for t, _ in sorted(vocabulary.items(), key=lambda x: x[1])]
        byte = _byte_letters()
        ranks = {}
        for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            whole = t.endswith("</w>") and t != "</w>"
            letters = t[:-4] if whole else t
            if all(c in byte for c in letters):
                ranks[bytes(byte[c] for c in letters) + b"\xff" * whole] = i
        merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                found = self[word] = array("I", merge(word.encode() + b"\xff")).tobytes()
                return found

        self.words = Words()
        # the tokenizer's own pattern, with its classes below U+0250 spelled out: letters, digits, white space
        letters, digits = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
        self.split = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{letters}]+|[{digits}]|[^\t-\r \x85\xa0{letters}{digits}]+").findall
        self.plain = re.compile("[\x00-\u024f]*+").fullmatch
        self.chunks: dict[bytes, bytes] = {}
        self.room = CHUNK_BYTES

    def direct(self, text: str) -> bytes:
        """Little-endian 32-bit ids by the library."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        names = self.strings
        return " ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if b"<|" in chunk or not self.plain(text):
            return self.direct(text)
        if len(self.words) > WORDS:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, self.split(text.lower())))

    def _same(self, left: bytes, right: bytes) -> bool:
        """Whether the words beside a join encode together as they do apart."""
        a, b = left.split()[-1:], right.split()[:1]
        if not a or not b or (a[0][-1] < 128 and b[0][0] < 128):
            return True
        return self._chunk(a[0] + b" " + b[0]) == self._chunk(a[0]) + self._chunk(b[0])

    def encode(self, text: bytes) -> bytes:
        at = cuts(text)
        parts = [text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)]
        joined = parts[:1]
        for part in parts[1:]:
            if self._same(joined[-1], part):
                joined.append(part)
            else:
                joined[-1] += part
        got = []
        for part in joined:
            found = self.chunks.get(part)
            if found is None:
                found = self._chunk(part)
                if self.room < 0:
                    self.chunks, self.room = {}, CHUNK_BYTES
                self.chunks[part] = found
                self.room -= len(part) + len(found)
            got.append(found)
        return b"".join(got)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str | None) -> str:
    """A path that every executor has: that given, or the public word_bpe_49k.json."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) of each row of docs.

    Null and empty texts, and those of white space alone, have no ids and decode to an empty text. Repeated rows and null doc_ids keep
    their rows; an empty table gives an empty table. Other columns are ignored.
    """

    def make():
        encoder = Encoder(vocabulary(path))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [encoder.encode(t) for t in as_bytes(batch.column(1))]
            ids = pa.array([np.frombuffer(g, "<i4") for g in got], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([*map(encoder.decode, got)], pa.string())], ["doc_id", "ids", "decoded"])

        return step

    return map_batches(text_or_empty(docs), make, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs; the cases are those of encode()."""

    def make():
        encoder = Encoder(vocabulary(path))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [encoder.encode(t) for t in as_bytes(batch.column(1))]
            cols = [
                batch.column(0),
                pa.array([len(g) // 4 for g in got], pa.int64()),
                pa.array([hashlib.sha256(g).hexdigest() for g in got], pa.string()),
                pa.array([hashlib.sha256(encoder.decode(g).encode()).hexdigest() for g in got], pa.string()),
            ]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return map_batches(text_or_empty(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
