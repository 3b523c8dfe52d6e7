"""BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that occurs inside no token of the vocabulary can never be
merged over, so a text may be cut there, the fragments encoded on their own and
the ids put together. Two things besides merges look across a cut, and cuts are
left out where they would matter:

* the pre-tokenizer joins a blank to the word after it and treats the last
  blank of a run apart, so no cut is made after white space unless white space
  follows (all white space of Unicode counts, by its last byte);
* a fragment that began with an apostrophe could be read as a contraction, so
  no cut is made before one unless an ASCII letter or digit stands before it.

Strings of added tokens are taken out first, as the library does. As nearly
every word end is a cut, fragments repeat, and a memo per worker keeps the ids of
those already seen; only new fragments are encoded. Most of them are one word of
letters or digits, so one piece to the pre-tokenizer; where the vocabulary's ids
follow its merges and every token encodes to itself, merging by the least id
that two neighbours make gives the same ids as the list of merges, and such a
piece goes to a plain merge loop over bytes. All others go to the library. The memo is bounded in
bytes: fragments above ``MEMO_FRAGMENT`` bytes are encoded and not kept, and when
those kept reach ``MEMO_BYTES`` they become the past generation, which is dropped
at the next turn. A long text is worked through in pieces of about ``PIECE``
bytes that end at a cut.

Defined results: null encodes as the empty text, which has no ids; texts of any
length are whole; a repeated row gives a repeated result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

TOKENIZER = "byte_bpe_50k.json"
#: Bytes that a generation of remembered fragments takes; a worker keeps two.
MEMO_BYTES = 64 << 20
#: Longest fragment that is remembered, in bytes.
MEMO_FRAGMENT = 64
#: What a remembered fragment takes besides its bytes and its ids' bytes.
_ENTRY = 200
#: Bytes of a text whose fragments are objects at a time, as far as cuts allow.
PIECE = 1 << 20
#: Letters below it have been letters in every edition of Unicode that an engine may know.
LATIN = "\u0250"
#: Ids that are digested at a time.
DIGEST = 1 << 16

_BLANK = [*range(9, 14), 32]
#: ASCII bytes that some engine takes for white space, and last bytes of the other white space of Unicode.
_MAYBE_BLANK = [*_BLANK, *range(28, 32), 0x85, 0xA0, *range(0x80, 0x8C), 0x8E, 0xA8, 0xA9, 0xAF, 0x9F, 0xBF]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def forced_cuts(tokens: list[bytes]) -> np.ndarray:
    """[a, b]: a text may be cut between the bytes a and b."""
    cut = np.ones((256, 256), bool)
    for t in tokens:
        at = np.frombuffer(t, np.uint8)
        cut[at[:-1], at[1:]] = False
    cut[:, 0x80:0xC0] = False  # inside a character
    blank = np.zeros(256, bool)
    blank[_BLANK] = True
    maybe = np.zeros(256, bool)
    maybe[_MAYBE_BLANK] = True
    cut[np.ix_(maybe, ~blank)] = False
    alnum = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
    cut[~alnum, ord("'")] = False
    return cut


def one_word(fragment: bytes) -> bool:
    """ASCII digits or Latin letters alone, behind one blank at most."""
    body = fragment[1:] if fragment[0] == 32 else fragment
    if body.isalpha() or body.isdigit():
        return True
    if body.isascii():
        return False
    text = body.decode()
    return text.isalpha() and max(text) < LATIN


def plain_merges(spec: dict, tokenize) -> bool:
    """The tokenizer's pieces are blank and word, and its ids say in which order it merges."""
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["normalizer"]
    if not usual or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    vocab, added = model["vocab"], {t["content"] for t in spec["added_tokens"]}
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    return all(a < b for a, b in zip(made, made[1:])) and all([x.id for x in tokenize(t)] == [i] for t, i in vocab.items() if t not in added)


class Memo(dict):
    """Ids of fragments; those not yet known are encoded, and kept while there is room."""

    def __init__(self, encode, merge=None):
        super().__init__()
        self.encode, self.merge, self.past, self.held = encode, merge, {}, 0

    def __missing__(self, fragment: bytes) -> bytes:
        ids = self.past.get(fragment)
        if ids is None:
            if self.merge and len(fragment) <= MEMO_FRAGMENT and one_word(fragment):
                ids = array("I", self.merge(fragment)).tobytes()
            else:
                ids = array("I", self.encode(fragment.decode(), add_special_tokens=False).ids).tobytes()
            if len(fragment) > MEMO_FRAGMENT:
                return ids
        size = len(fragment) + len(ids) + _ENTRY
        if self.held + size > MEMO_BYTES:
            self.past, self.held = dict(self), 0
            self.clear()
        self.held += size
        self[fragment] = ids
        return ids


class Codec:
    """Encodes and decodes with one tokenizer file; not shared between processes."""

    _own: dict[tuple, Codec] = {}

    def __init__(self, path: str, specials: bool = True):
        import json
        import re

        from tiktoken._tiktoken import CoreBPE
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = not specials
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *added.values()]) + 1
        as_bytes = lambda t: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
        self.bytes_of = [b""] * self.size
        for t, i in {**vocab, **added}.items():
            self.bytes_of[i] = as_bytes(t)
        self.decimal = [b"%d," % i for i in range(self.size)]
        self.cut = forced_cuts([self.bytes_of[i] for t, i in vocab.items() if t not in added]).reshape(-1)
        self.added = {t.encode(): np.array([i], "<u4").tobytes() for t, i in added.items()} if specials else {}
        self.split = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")") if self.added else None
        ranks = {self.bytes_of[i]: i for t, i in vocab.items() if t not in added}
        fast = len(ranks) == len(vocab.keys() - added.keys()) and plain_merges(spec, self.tokenizer.model.tokenize)
        self.memo = Memo(self.tokenizer.encode, CoreBPE(ranks, {}, r"[\s\S]+").encode_single_piece if fast else None)

    @classmethod
    def of(cls, path: str, specials: bool = True) -> Codec:
        """The worker's codec for this file."""
        key = (path, specials)
        if key not in cls._own:
            cls._own[key] = cls(path, specials)
        return cls._own[key]

    def parts(self, text: bytes) -> list[bytes]:
        """The text parted at the strings of added tokens, which stand at odd places."""
        if self.split is not None and any(t in text for t in self.added):
            return self.split.split(text)
        return [text]

    def pieces(self, text: bytes) -> Iterator[bytes]:
        """The text in runs of about ``PIECE`` bytes that end at a cut; a run without cuts stays whole."""
        start, at = 0, PIECE
        while at < len(text):
            near = np.frombuffer(text, np.uint8, min(PIECE, len(text) - at) + 1, at - 1)
            ends = np.flatnonzero(self.cut[(near[:-1].astype(np.uint16) << 8) | near[1:]])
            if len(ends):
                end = at + int(ends[0])
                yield text[start:end]
                start, at = end, end + PIECE
            else:
                at += PIECE
        if start < len(text):
            yield text[start:] if start else text

    def fragments(self, text: bytes) -> list[bytes]:
        """The text, free of added tokens, at all its cuts: the ids of the fragments put together are the text's."""
        if not text:
            return []
        at = np.frombuffer(text, np.uint8)
        pairs = at[:-1].astype(np.uint16) << 8
        pairs |= at[1:]
        ends = (np.flatnonzero(self.cut[pairs]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]

    def encode_one(self, text: bytes) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        known = self.memo.__getitem__
        out = []
        for k, part in enumerate(self.parts(text)):
            if k % 2:
                out.append(self.added[part])
            elif len(part) <= PIECE:
                out += map(known, self.fragments(part))
            else:
                out += (b"".join(map(known, self.fragments(piece))) for piece in self.pieces(part))
        return b"".join(out)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text."""
        return map(self.encode_one, texts)

    def decode_bytes(self, ids: list[int]) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def digests(self, ids: np.ndarray) -> tuple[str, str]:
        """SHA-256 of the decimal ids joined by commas, and of the decoded text."""
        if len(ids) <= DIGEST:
            few, dec = ids.tolist(), self.decimal
            return hashlib.sha256(b"".join([dec[i] for i in few])[:-1]).hexdigest(), hashlib.sha256(self.decode(few).encode()).hexdigest()
        own, text, dec = hashlib.sha256(), [], self.decimal
        for k in range(0, len(ids), DIGEST):
            few = ids[k : k + DIGEST].tolist()
            joined = b"".join([dec[i] for i in few])
            own.update(joined if k + DIGEST < len(ids) else joined[:-1])
            text.append(self.decode_bytes(few))
        return own.hexdigest(), hashlib.sha256(b"".join(text).decode("utf-8", "replace").encode()).hexdigest()


def binary_texts(column: pa.Array) -> list[bytes]:
    """Values of a binary column, null as empty."""
    return [x if x is not None else b"" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in small pieces, so that few texts are Python objects at a time."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def round_trip(path: str):
    """Function for mapInArrow over (doc_id, text as binary): ids and decoded text, as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for whole in batches:
            for batch in slices(whole):
                counts, ids_sha, text_sha = [], [], []
                for raw in codec.encode(binary_texts(batch.column(1))):
                    ids = np.frombuffer(raw, "<u4")
                    counts.append(len(ids))
                    for out, digest in zip((ids_sha, text_sha), codec.digests(ids)):
                        out.append(digest)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_decode(docs, path: str | None = None):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document.

    Map-only: one pass over the texts, no exchange. ``docs`` needs doc_id and
    text; other columns are not read.
    """
    from pyspark.sql import functions as F

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return docs.mapInArrow(round_trip(path or tokenizer_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
