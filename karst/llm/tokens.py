"""Exact token ids of many texts at once, by their distinct pieces."""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts of up to so many bytes are merged together, in rows of these widths; longer ones go to the library.
WIDTHS = (4, 8, 12, 16, 24, 40)
#: Parts merged at once: their tables stay near the processor.
BLOCK = 32_768

_NONE = np.iinfo(np.int32).max
_FREE = np.iinfo(np.uint64).max
_BITS = 18
_LETTER, _DIGIT, _SYMBOL, _OTHER = range(4)
#: Kinds of ASCII bytes. Controls, the apostrophe (English endings) and all beyond ASCII are left to the library.
_KIND = np.array([_LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SYMBOL if 0x21 <= b < 0x7F and b != 0x27 else _OTHER for b in range(128)] + [_OTHER] * 128, np.uint8)


def byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, others for 256 and up, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Byte-pair merges of many short parts side by side: in each round every part makes its earliest-learnt merge,
    the leftmost of several, as the library does for one part."""

    def __init__(self, model: dict):
        vocab, suffix, letters = model["vocab"], model.get("end_of_word_suffix") or "", byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32)
        self.pad = max(vocab.values()) + 1
        pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            pairs[vocab[a] * (self.pad + 1) + vocab[b]] = (rank, vocab[a + b])
        self.made = np.zeros(len(model["merges"]), np.int32)
        self.made[[r for r, _ in pairs.values()]] = [i for _, i in pairs.values()]
        self.bits = max(_BITS, (4 * len(pairs)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, _FREE, np.uint64), np.full(1 << self.bits, _NONE, np.int32)
        keys, ranks = np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter((r for r, _ in pairs.values()), np.int32, len(pairs))
        slots = self._slots(keys)
        while len(keys):  # open addressing: of those that want the same free slot one gets it
            won = np.zeros(len(keys), bool)
            won[np.unique(slots, return_index=True)[1]] = True
            won &= self.keys[slots] == _FREE
            self.keys[slots[won]], self.ranks[slots[won]] = keys[won], ranks[won]
            keys, ranks, slots = keys[~won], ranks[~won], (slots[~won] + 1) % len(self.keys)

    @classmethod
    def of(cls, tokenizer) -> Merges | None:
        """None for models that don't merge bytes in this way."""
        model = json.loads(tokenizer.to_str())["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            return None
        try:
            return cls(model)
        except KeyError:  # a byte or a merged piece without an id
            return None

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each a with each b, _NONE where there is none."""
        keys = (a.astype(np.uint64) * np.uint64(self.pad + 1) + b.astype(np.uint64)).ravel()
        slots = self._slots(keys)
        found = self.keys[slots]
        ranks = np.where(found == keys, self.ranks[slots], _NONE)
        more = np.flatnonzero((found != keys) & (found != _FREE))
        slots = slots[more]
        while len(more):
            slots = (slots + 1) % len(self.keys)
            found = self.keys[slots]
            hit = found == keys[more]
            ranks[more[hit]] = self.ranks[slots[hit]]
            on = ~hit & (found != _FREE)
            more, slots = more[on], slots[on]
        return ranks.reshape(a.shape)

    def ids(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """(parts, width) ids of the parts data[at : at + size], none longer than width, then `pad`."""
        cols, n = np.arange(width), len(at)
        s = self.inner[data[at[:, None] + np.minimum(cols, size[:, None] - 1)]]
        s[np.arange(n), size - 1] = self.last[data[at + size - 1]]
        s[cols >= size[:, None]] = self.pad
        out, live, r = np.empty_like(s), np.arange(n), self.rank(s[:, :-1], s[:, 1:])
        while len(live):
            pos, rows = r.argmin(1), np.arange(len(live))
            best = r[rows, pos]
            go = best < _NONE
            if not go.all():
                out[live[~go]] = s[~go]
                s, r, pos, best, live, rows = s[go], r[go], pos[go], best[go], live[go], rows[: go.sum()]
            s[rows, pos] = self.made[best]
            later = cols[:-1] > pos[:, None]
            s[:, :-1] = np.where(later, s[:, 1:], s[:, :-1])
            s[:, -1] = self.pad
            r[:, :-1] = np.where(later[:, :-1], r[:, 1:], r[:, :-1])
            r[:, -1] = _NONE
            r[rows, pos] = self.rank(s[rows, pos], s[rows, pos + 1])
            left = np.flatnonzero(pos)
            r[left, pos[left] - 1] = self.rank(s[left, pos[left] - 1], s[left, pos[left]])
        return out


def _offsets(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array."""
    _, at, data = strings.buffers()
    at = np.frombuffer(at, np.int32)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int32)
    return at, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def _strings(kind: pa.DataType, at: np.ndarray, data) -> pa.Array:
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int32)), pa.py_buffer(data)])


class ChunkIds:
    """Ids of texts as little-endian unsigned 16- or 32-bit bytes.

    The tokenizer lower-cases, removes white space and merges only within matches of a pattern that hold no white
    space, so the ids of a text are those of its chunks in a row. Chunks are cut at ASCII white space, and each distinct
    one of a call is looked at once. One of ASCII without apostrophes and of Latin-1 letters, which NFC keeps and which
    have one lower-case letter of their own, is cut into the pattern's matches (runs of letters, single digits, runs of
    symbols); these are lower-cased and, each distinct one once, merged side by side. Every other chunk, long parts and
    those that hold an added token are encoded by the library as they are. Nothing is kept from one call to the next.
    """

    def __init__(self, path: str, wide: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = Merges.of(self.tokenizer)
        self.kind = np.dtype("<u4" if wide or self.tokenizer.get_vocab_size() > 65_535 else "<u2")

    def _encode(self, chunk: str) -> list[int]:
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def of(self, text: str) -> bytes:
        return self.all(pa.array([text], pa.string()))[0].as_py()

    def all(self, texts: pa.Array, end_id: int | None = None) -> pa.Array:
        """The ids of each text, null as empty, with end_id after them where it is given."""
        chunks = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        words = chunks.values.dictionary_encode()
        at, which = chunks.offsets.to_numpy().astype(np.int64), words.indices.to_numpy()
        known, flat = self._distinct(words.dictionary)
        if end_id is not None:  # one more chunk, at the end of every text
            known, flat = np.append(known, known[-1] + 1), np.append(flat, np.array([end_id], self.kind))
            which = np.insert(which, at[1:], len(words.dictionary))
            at = at + np.arange(len(at))
        whole = _strings(pa.binary(), known * self.kind.itemsize, flat).take(pa.array(which))
        ends, data = _offsets(whole)
        return _strings(pa.binary(), ends[at], data)

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of chunks in their ids, and these."""
        at, data = _offsets(chunks)
        data = data[at[0] : at[-1]]
        at = at.astype(np.int64) - at[0]
        kind = _KIND[data]
        accented = np.zeros(len(data), bool)  # second bytes of À to ÿ, but × and ÷
        accented[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        kind[accented] = _LETTER
        kind[:-1][accented[1:]] = _LETTER
        others = np.append(0, np.cumsum(kind == _OTHER, dtype=np.int32))
        odd = others[at[1:]] > others[at[:-1]] if self.merges else np.ones(len(chunks), bool)
        for token in self.added:
            odd |= pc.match_substring(chunks, token, ignore_case=True).to_numpy(zero_copy_only=False)
        whole = np.repeat(odd, np.diff(at))
        starts = np.ones(len(data), bool)
        starts[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) & ~whole[1:]
        starts[at[:-1][np.diff(at) > 0]] = True
        upper = ((data >= 0x41) & (data <= 0x5A) | accented & (data <= 0x9E)) & ~whole
        cuts = np.flatnonzero(starts)
        parts = _strings(pa.string(), np.append(cuts, len(data)), data + np.where(upper, np.uint8(0x20), np.uint8(0))).dictionary_encode()
        which = parts.indices.to_numpy()
        library = np.zeros(len(parts.dictionary), bool)
        library[which[whole[cuts]]] = True
        known, flat = self._merged(parts.dictionary, library)
        found = _strings(pa.binary(), known * self.kind.itemsize, flat).take(parts.indices)
        ends, ids = _offsets(found)
        return ends[np.append(0, np.cumsum(starts, dtype=np.int32))[at]].astype(np.int64) // self.kind.itemsize, ids[: ends[-1]].view(self.kind)

    def _merged(self, parts: pa.Array, library: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of distinct parts in their ids, and these; those marked and long ones by the library."""
        at, data = _offsets(parts)
        size = np.diff(at)
        counts, made = np.zeros(len(parts), np.int64), []
        alone = np.flatnonzero(library | (size > WIDTHS[-1]))
        for lo in range(0, len(alone), BLOCK):
            rows = alone[lo : lo + BLOCK]
            ids = [self._encode(t) for t in parts.take(pa.array(rows)).to_pylist()]
            counts[rows] = [len(x) for x in ids]
            made.append((rows, np.array([i for x in ids for i in x], self.kind)))
        for least, width in zip((0, *WIDTHS), WIDTHS):
            short = np.flatnonzero(~library & (size > least) & (size <= width))
            for lo in range(0, len(short), BLOCK):
                rows = short[lo : lo + BLOCK]
                ids = self.merges.ids(data, at[rows].astype(np.int64), size[rows], width)
                there = ids != self.merges.pad
                counts[rows] = there.sum(1)
                made.append((rows, ids[there].astype(self.kind)))
        ends = np.append(0, np.cumsum(counts))
        flat = np.empty(ends[-1], self.kind)
        for rows, ids in made:
            n = counts[rows]
            flat[np.repeat(ends[rows] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(len(ids))] = ids
        return ends, flat


#: One of each tokenizer in a worker: it holds the model's tables, nothing of the texts.
chunk_ids = functools.lru_cache(maxsize=4)(ChunkIds)

#: Texts in which tokenizers differ: case, accents apart from their letters, scripts, digits, marks, kinds of space.
_PROBES = (
    "The Quick brown fox's  tail,\tÉtÉ Ångström.\n", "e\u0301 ﬁ Ⅷ İ ſ 漢字かな Привет مرحبا 👩‍👩‍👧 \u00a0x\u3000y", "3.14 1,000 a_b #c [d] <e> don't!?\r\n ... --x", " \x0b\x0c ", "",
    "(Well-known) x1Y22z $5.00% http://a.b/C?d=e&f_g=~1 \"q\" Ünïcödé×÷ÀÞß 'tis it's.", " ".join(map(chr, range(0x21, 0x7F))) + "".join(map(chr, range(0x20, 0x7F))), "Aa" * 40 + " antidisestablishmentarianism internationalisation 1a" + "!?" * 30,
)


def check_chunks(path: str) -> None:
    """Refuse a tokenizer whose ids of a text are not those of its chunks in a row, told by _PROBES and its added tokens."""
    lookup = ChunkIds(path, wide=True)
    for text in (*_PROBES, *lookup.added, *(f"x{t}y" for t in lookup.added)):
        if np.frombuffer(lookup.of(text), "<u4").tolist() != lookup._encode(text):
            raise ValueError(f"{path}: this tokenizer's ids of a text are not those of its chunks in a row ({text!r})")
