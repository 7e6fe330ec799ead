"""Token ids and counts by the tokenizers library, with a memory for the chunks that texts are made of.

Both vocabularies used here cut a text into chunks before anything else, and what
becomes of a chunk does not depend on its neighbours. So ids of a chunk are asked
of the library once and remembered. Texts with characters for which that is not
plain (rare scripts, combining marks, odd white space, strings of special tokens)
go through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters outside these make a text go through the library whole.
_UNCOMMON = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ɏ‐-‧‰-⁞₠-₿]|<\\|")
#: Latin-1 bytes of the characters that are plain.
_PLAIN = bytes([9, 10, 13, *range(32, 127), *range(0xA1, 0xAD), *range(0xAE, 256)])
#: Byte-level vocabulary: a run of non-spaces with the one space before it, or spaces.
_CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s")


def _byte_letters() -> str:
    """Letters of the byte-level alphabet, by byte: printable Latin-1 characters stand for themselves, the others for characters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(other)) for b in range(256))


_LETTERS = _byte_letters()
_MARKS = {",", ".", ";", ":", "!", "?"}


#: What the two vocabularies' files say of normalisation and pre-tokens (fixed values).
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORD_PATTERN}, "behavior": "Removed", "invert": True}, BYTE_LEVEL]}


def uncommon(text: str) -> bool:
    try:
        return bool(text.encode("latin-1").translate(None, _PLAIN)) or "<|" in text
    except UnicodeEncodeError:
        return bool(_UNCOMMON.search(text))


def _strings(words: pa.Array) -> list[str]:
    """What to_pylist() gives for words without zero bytes, faster."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\0")[0].as_py().split("\0") if len(words) else []


def _chunks_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """What _CHUNKS finds in plain texts, one after another, and where each text's begin (and the last one's end)."""
    whole = pa.array(texts, pa.string())
    upto = np.frombuffer(whole.buffers()[1], np.int32, len(texts) + 1)
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8, upto[-1])
    white = (data == 32) | (data == 9) | (data == 10) | (data == 13)
    edge = np.zeros(len(data) + 1, bool)
    edge[upto] = True
    after_white = np.zeros(len(data), bool)
    after_white[1:] = white[:-1] & ~edge[1:-1]
    before_word = np.zeros(len(data), bool)
    before_word[:-1] = ~white[1:] & ~edge[1:-1]
    # white space begins a chunk at its first character, and at its last before a word; a word begins one but after a space, which goes with it
    starts = white & (before_word | ~after_white)
    starts[1:] |= ~white[1:] & after_white[1:] & (data[:-1] != 32)
    starts |= edge[:-1]
    at = np.append(np.flatnonzero(starts), len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), whole.buffers()[2] or pa.py_buffer(b"")), np.searchsorted(at, upto)


def _gather(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of flat (of these sizes) named by which, one after another, and the size of each."""
    n = sizes.take(which)
    at = np.repeat((np.cumsum(sizes) - sizes).take(which) - np.cumsum(n) + n, n)
    at += np.arange(len(at))
    return flat.take(at), n


class Encoder:
    """Ids of texts for a tokenizer file, without special tokens added; remembers up to limit chunks and as many pre-tokens."""

    #: The two vocabularies' own patterns for pre-tokens (fixed values).
    WORDS = regex.compile(_WORD_PATTERN)
    BYTES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, path: str, limit: int = 250_000) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        self.by_words = form["normalizer"] is not None
        steps = (form["normalizer"], form["pre_tokenizer"])
        # any other kind of file goes through the library whole
        self.plain = steps in ((NORMAL, SPLIT), (None, BYTE_LEVEL | {"use_regex": True})) and all(t["content"].startswith("<|") for t in form["added_tokens"])
        self.cut = str.split if self.by_words else _CHUNKS.findall
        self.pre_tokens = (self.WORDS if self.by_words else self.BYTES).findall
        self.merge = self.tok.model.tokenize
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.limit = limit

    def chunks(self, text: str) -> list[str] | None:
        return self.cut(text) if self.plain and not uncommon(text) else None

    def pre_token(self, p: str) -> bytes:
        letters = p if p.isascii() and p.isalpha() else p.encode().decode("latin-1").translate(_LETTERS)
        return array("I", [t.id for t in self.merge(letters)]).tobytes()

    def cut_chunk(self, c: str) -> list[str] | tuple[str, ...]:
        """The chunk's pre-tokens; letters alone, or before one mark, need no pattern."""
        body = c[1:] if c[0] == " " else c
        if body.isalpha():
            return (c,)
        if body[-1:] in _MARKS and body[:-1].isalpha():
            return c[:-1], c[-1]
        return self.pre_tokens(c)

    def learn(self, chunks: list[str]) -> None:
        parts, known = self.parts, self.known
        if len(parts) > self.limit:
            parts.clear()
        for c in chunks:
            if c in known:
                continue
            found = []
            for p in self.cut_chunk(c.lower() if self.by_words else c):
                x = parts.get(p)
                if x is None:
                    x = parts[p] = self.pre_token(p)
                found.append(x)
            known[c] = found[0] if len(found) == 1 else b"".join(found)

    def encode_one(self, text: str) -> bytes:
        chunks = self.chunks(text)
        if chunks is None:
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.known) > self.limit:
            self.known.clear()
        ids = list(map(self.known.get, chunks))
        new = [i for i, x in enumerate(ids) if x is None]
        if new:
            self.learn([chunks[i] for i in new])
            for i in new:
                ids[i] = self.known[chunks[i]]
        return b"".join(ids)

    def merge_all(self, parts: list[str]) -> None:
        """Remembers the ids of pre-tokens that are not known yet."""
        letters = "\0".join(parts).encode().decode("latin-1").translate(_LETTERS).split(_LETTERS[0])
        ids, ends, merge = [], [], self.merge
        for x in letters[: len(parts)]:
            ids += [t.id for t in merge(x)]
            ends.append(4 * len(ids))
        raw, at = array("I", ids).tobytes(), 0
        for p, end in zip(parts, ends):
            self.parts[p] = raw[at:end]
            at = end

    def letters_alone(self, chunks: pa.Array) -> pa.Array:
        """Whether chunks are letters and nothing else but the space before them."""
        return pc.utf8_is_alpha(chunks if self.by_words else pc.utf8_ltrim(chunks, " "))

    def stem_ids(self, stems: pa.Array) -> list[bytes]:
        """The ids of distinct chunks (words: in lower case); what is not known is cut and merged once."""
        known = self.parts
        if len(known) > self.limit:
            known.clear()
        names = _strings(stems)
        found = list(map(known.get, names))
        new = [i for i, x in enumerate(found) if x is None]
        letters = self.letters_alone(stems).to_numpy(zero_copy_only=False)
        cut = {i: self.pre_tokens(names[i]) for i in new if not letters[i]}
        self.merge_all([names[i] for i in new if letters[i]])
        self.merge_all([p for p in {p for c in cut.values() for p in c} if p not in known])
        for i, c in cut.items():
            known[names[i]] = b"".join([known[p] for p in c])
        for i in new:
            found[i] = known[names[i]]
        return found

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has. Each distinct chunk of the texts is looked up once."""
        rare = [i for i, t in enumerate(texts) if uncommon(t)] if self.plain else range(len(texts))
        low = [t.lower() for t in texts] if self.by_words else list(texts)
        for i in rare:
            low[i] = ""
        if self.by_words:
            cut = pc.ascii_split_whitespace(pa.array(low, pa.string()))
            chunks, at = cut.flatten(), cut.offsets.to_numpy()
        else:
            chunks, at = _chunks_of(low)
        words = chunks.dictionary_encode()
        # letters alone, or before one mark, need no pattern
        body = pc.utf8_slice_codeunits(words.dictionary, 0, -1)
        mark = pc.index_in(pc.utf8_slice_codeunits(words.dictionary, -1), pa.array(sorted(_MARKS)))
        mark = pc.if_else(self.letters_alone(body), mark, None)
        stems = pc.if_else(pc.is_valid(mark), body, words.dictionary).dictionary_encode()
        found = self.stem_ids(stems.dictionary)
        last = [self.pre_token(m) for m in sorted(_MARKS)] + [b""]
        ends = pc.fill_null(mark, len(_MARKS)).to_numpy() + len(found)
        pieces = found + last
        flat, sizes = np.frombuffer(b"".join(pieces), np.uint32), np.array(list(map(len, pieces)), np.int64) >> 2
        flat, sizes = _gather(flat, sizes, np.stack([stems.indices.to_numpy(), ends], axis=1).ravel())
        ids, sizes = _gather(flat, sizes.reshape(-1, 2).sum(axis=1), words.indices.to_numpy())
        n = np.diff(np.concatenate([[0], np.cumsum(sizes)]).take(at))
        if rare:  # these go through the library whole
            own = {i: np.frombuffer(self.encode_one(texts[i]), np.uint32) for i in rare}
            parts = np.split(ids, np.cumsum(n)[:-1])
            ids = np.concatenate([own.get(i, x) for i, x in enumerate(parts)])
            for i, x in own.items():
                n[i] = len(x)
        return ids, n

    def forget(self) -> None:
        """Frees what is remembered: workers outlive their tasks."""
        self.known.clear()
        self.parts.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return list(map(self.encode_one, texts))


class WholeTokenCounter:
    """Token counts for the vocabulary with word ends.

    prove() finds, before any text is seen, the vocabulary strings that alone encode
    as one token. A pre-token among them counts one without any merging; only the
    others are merged by the library's model. Counts of words are remembered.
    """

    def __init__(self, path: str, limit: int = 250_000) -> None:
        self.encoder = Encoder(path)
        self.parts: dict[str, int] = dict.fromkeys(prove(path), 1)
        self.whole = len(self.parts)
        self.counts: dict[str, int] = {}
        self.limit = limit

    def learn(self, words: list[str]) -> None:
        counts, parts, e = self.counts, self.parts, self.encoder
        if len(parts) > self.limit + self.whole:
            self.parts = parts = dict(list(parts.items())[: self.whole])
        for w in words:
            if w in counts:
                continue
            low = w.lower()
            n = parts.get(low, 0)
            if not n:
                for p in e.cut_chunk(low):
                    k = parts.get(p)
                    if k is None:
                        k = parts[p] = len(e.pre_token(p)) // 4
                    n += k
            counts[w] = n

    def count_one(self, text: str) -> int:
        words = self.encoder.chunks(text)
        if words is None:
            return len(self.encoder.tok.encode(text, add_special_tokens=False).ids)
        if len(self.counts) > self.limit:
            self.counts.clear()
        n = list(map(self.counts.get, words))
        new = [i for i, x in enumerate(n) if x is None]
        if new:
            self.learn([words[i] for i in new])
            for i in new:
                n[i] = self.counts[words[i]]
        return sum(n)

    def forget(self) -> None:
        """Frees what is remembered besides the proven words."""
        self.counts.clear()
        self.parts = dict(list(self.parts.items())[: self.whole])

    def count(self, texts: list[str]) -> list[int]:
        return list(map(self.count_one, texts))


@lru_cache(2)
def prove(path: str) -> frozenset[str]:
    """Strings of the vocabulary that alone are one pre-token and one token."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    found = []
    names = sorted({t.removesuffix("</w>") for t in tok.get_vocab() if t.endswith("</w>")})
    # ASCII only: there the vocabulary's byte alphabet and the text's characters are the same
    names = [t for t in names if t and t.isascii() and Encoder.WORDS.fullmatch(t) and Encoder.WORDS.findall(t) == [t]]
    for i in range(0, len(names), 4096):
        part = names[i : i + 4096]
        e = tok.encode(part, is_pretokenized=True, add_special_tokens=False)
        n = np.bincount(np.array(e.word_ids, np.int64), minlength=len(part))
        found += [t for t, k in zip(part, n.tolist()) if k == 1]
    return frozenset(found)


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(2)
def counter(path: str) -> WholeTokenCounter:
    return WholeTokenCounter(path)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
