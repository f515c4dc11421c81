"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols are the leaves' left partners: leaf ``i`` holds the rank of the
pair that starts at symbol ``i``, with its position in the low digits, and every
inner node the minimum of its children. The root therefore names the leftmost
pair of lowest rank. A merge changes three leaves; each is updated on its path
to the root. The word is done when the root holds no rank.

Many words are merged side by side: words of one length class are the rows of an
array, so a step is a few numpy operations over all rows still open; a word that
is longer than ``LONG`` has a tree of its own in plain arrays (28 bytes a
symbol), where a step costs a path to the root and no more. A text is cut at
blanks first, and results of short pieces are kept in a bounded table, for
natural text repeats its pieces.

The tokenizers library takes its letters, its lower case and its normal form
from three versions of Unicode, none of which is Python's. Where they differ,
the fixed ranges below say what the library does; a test compares every code
point.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: Pieces kept per worker, of at most CACHE_CHARS characters each; when full, the table starts anew.
CACHE_PIECES = 300_000
CACHE_CHARS = 64
#: Words of more bytes have a tree of their own.
LONG = 2048
#: Symbols in one array of words.
ROOM = 1 << 19
_NONE = np.iinfo(np.int64).max
# Where the library's Unicode tables differ from those of Python and of the regex module.
#: Letters and numbers (first and last) that the library's splitting pattern doesn't count as such.
NO_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)
#: Marks, and parts of one composed letter, that the library's normal form leaves where they stand.
NO_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA),
    (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B),
    (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x11938, 0x11938), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34),
    (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F),
    (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
#: Capitals whose small letters Python doesn't know.
SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def _of_ranges(ranges) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


_NO_LETTERS = regex.compile(f"[{_of_ranges(NO_LETTERS)}]")
_NO_MARKS = regex.compile(f"([{_of_ranges(NO_MARKS)}])")
_SMALL = regex.compile(f"[{''.join(map(chr, SMALL))}]")
#: Neither blank nor letter nor number, whatever the version.
_OTHER = "\uffff"
#: Python splits at these too, the vocabulary's white space doesn't have them.
_ODD_BLANK = regex.compile(r"[\x1c-\x1f]")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    a visible Latin-1 character is itself, the others follow from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def _latin(text: str) -> bool:
    """Whether a text is in normal form and known to every version of Unicode: Latin-1 only."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordBpe:
    """A vocabulary file of the kind "BPE with word ends" (lower case, white
    space dropped): normalizer, splitting pattern, ranks and pieces."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for piece, number in [*vocab.items(), *self.special.items()]:
            self.pieces[number] = piece
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self._at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        chars = byte_characters()
        self._first = np.array([vocab[c] for c in chars], np.int64)
        self._last = np.array([vocab[c + self.suffix] for c in chars], np.int64)
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._made, self._made_list = made, made.tolist()
        self._rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self._fill(keys)
        self._known: dict[str, bytes] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray) -> None:
        """Hash table from pair to rank with linear probing, a quarter full at most."""
        self._bits = max(4, len(keys).bit_length() + 2)
        self._table = np.full((1 << self._bits) + len(keys), -1, np.int64)
        self._rank_at = np.full(len(self._table), _NONE, np.int64)
        waiting, slot = np.arange(len(keys)), self._slot(keys)
        self._probes = 0
        while len(waiting):
            free = self._table[slot] == -1
            _, first = np.unique(slot[free], return_index=True)
            winners = np.flatnonzero(free)[first]
            self._table[slot[winners]], self._rank_at[slot[winners]] = keys[waiting[winners]], waiting[winners]
            rest = np.ones(len(waiting), bool)
            rest[winners] = False
            waiting, slot = waiting[rest], slot[rest] + 1
            self._probes += 1

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; no rank for an unknown pair or a right of -1."""
        key = (left << 32) | (right & 0xFFFFFFFF)
        flat = key.ravel()
        slot = self._slot(flat)
        out = np.full(len(flat), _NONE, np.int64)
        seek = np.arange(len(flat))
        for _ in range(self._probes):
            there = self._table[slot]
            hit = there == flat[seek]
            out[seek[hit]] = self._rank_at[slot[hit]]
            on = ~hit & (there != -1)
            seek, slot = seek[on], slot[on] + 1
            if not len(seek):
                break
        return out.reshape(key.shape)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (UTF-8, not empty), as little-endian unsigned 32-bit."""
        out = [b""] * len(words)
        classes: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if len(word) > LONG:
                out[i] = self._merge_long(word)
                continue
            classes.setdefault(max(1, (len(word) - 1).bit_length()), []).append(i)
        for bits, members in classes.items():
            step = max(1, ROOM >> bits)
            for start in range(0, len(members), step):
                part = members[start : start + step]
                for i, ids in zip(part, self._merge_rows([words[i] for i in part], 1 << bits), strict=True):
                    out[i] = ids
        return out

    def _merge_long(self, word: bytes) -> bytes:
        """The same for one long word."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        raw = np.frombuffer(word, np.uint8)
        start = self._first[raw]
        start[-1] = self._last[raw[-1]]
        ranks = np.full(width, _NONE, np.int64)
        for a in range(0, n - 1, ROOM):
            b = min(n - 1, a + ROOM)
            ranks[a:b] = self._rank(start[a:b], start[a + 1 : b + 1])
        shift = width.bit_length()
        tree = np.empty(2 * width, np.int64)
        tree[width:] = np.where(ranks == _NONE, _NONE, (ranks << shift) | np.arange(width))
        level = width
        while level > 1:
            level //= 2
            np.minimum(tree[2 * level : 4 * level : 2], tree[2 * level + 1 : 4 * level : 2], out=tree[level : 2 * level])
        tree, symbol = array("q", tree.tobytes()), array("i", start.astype(np.int32).tobytes())
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        made, known, low = self._made_list, self._rank_of, (1 << shift) - 1

        def put(at: int, value: int) -> None:
            node = width + at
            tree[node] = value
            while node > 1:
                node >>= 1
                left, right = tree[2 * node], tree[2 * node + 1]
                least = left if left < right else right
                if tree[node] == least:
                    return
                tree[node] = least

        def leaf(at: int, right: int) -> int:
            rank = known.get((symbol[at] << 32) | symbol[right]) if right < n else None
            return _NONE if rank is None else (rank << shift) | at

        while (root := tree[1]) != _NONE:
            at = root & low
            gone = after[at]
            right, left = after[gone], before[at]
            symbol[at], symbol[gone], after[at] = made[root >> shift], -1, right
            if right < n:
                before[right] = at
            put(gone, _NONE)
            put(at, leaf(at, right))
            if left >= 0:
                put(left, leaf(left, at))
        return np.array([x for x in symbol if x >= 0], "<u4").tobytes()

    def _merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        place = np.arange(width)
        symbol = np.where(place < lengths[:, None], self._first[raw], -1)
        rows = np.arange(n)
        symbol[rows, lengths - 1] = self._last[raw[rows, lengths - 1]]
        after = np.tile(place + 1, (n, 1))
        before = np.tile(place - 1, (n, 1))
        shift = width.bit_length()
        tree = np.full((n, 2 * width), _NONE, np.int64)
        ranks = np.full((n, width), _NONE, np.int64)
        if width > 1:
            ranks[:, :-1] = self._rank(symbol[:, :-1], symbol[:, 1:])
        tree[:, width:] = np.where(ranks == _NONE, _NONE, (ranks << shift) | place)
        level = width
        while level > 1:
            level //= 2
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
        symbol, before, after, tree = symbol.ravel(), before.ravel(), after.ravel(), tree.ravel()
        live = rows
        while True:
            root = tree[live * (2 * width) + 1]
            open_rows = root != _NONE
            live, root = live[open_rows], root[open_rows]
            if not len(live):
                break
            line = live * width
            at = root & ((1 << shift) - 1)
            gone = after[line + at]
            right = after[line + gone]
            left = before[line + at]
            symbol[line + at] = self._made[root >> shift]
            symbol[line + gone] = -1
            after[line + at] = right
            inner = right < width
            before[(line + right)[inner]] = at[inner]
            has = left >= 0
            changed = np.concatenate((gone, at, left[has]))
            owner = np.concatenate((live, live, live[has]))
            value = np.concatenate((np.full(len(live), _NONE), self._leaf(symbol, line, at, right, width, shift), self._leaf(symbol, line[has], left[has], at[has], width, shift)))
            node = owner * (2 * width) + width + changed
            tree[node] = value
            depth, place_in = width, width + changed
            while depth > 1:
                place_in >>= 1
                node = owner * (2 * width) + place_in
                child = owner * (2 * width) + 2 * place_in
                tree[node] = np.minimum(tree[child], tree[child + 1])
                depth >>= 1
        symbol = symbol.reshape(n, width)
        kept = symbol >= 0
        ends = np.cumsum(kept.sum(axis=1)) * 4
        ids = symbol[kept].astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _leaf(self, symbol, line, at, following, width, shift) -> np.ndarray:
        other = np.where(following < width, symbol[line + np.minimum(following, width - 1)], -1)
        rank = self._rank(symbol[line + at], other)
        return np.where(rank == _NONE, _NONE, (rank << shift) | at)

    def _blank_pieces(self, text: str) -> list[str]:
        if not _latin(text):
            if _NO_MARKS.search(text):
                text = "".join(unicodedata.normalize("NFC", part) for part in _NO_MARKS.split(text))
            elif not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if _SMALL.search(text):
                text = text.translate(SMALL)
            text = text.replace("Σ", "σ")  # each character alone: no final form of sigma
        text = text.lower()
        return [p for p in regex.split(r"\s+", text) if p] if _ODD_BLANK.search(text) else text.split()

    def _words(self, piece: str) -> list[bytes]:
        if _latin(piece) or not _NO_LETTERS.search(piece):
            return list(map(str.encode, self.pattern.findall(piece)))
        shown = _NO_LETTERS.sub(_OTHER, piece)
        return [piece[m.start() : m.end()].encode() for m in self.pattern.finditer(shown)]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, as the tokenizers library gives them without
        special tokens of its own; those written in a text count."""
        cut: list[list[str]] = []
        for text in texts:
            parts: list[str] = []
            for section in self._at_special.split(text) if any(map(text.__contains__, self.special)) else [text]:
                # a piece holds no blank, so this key is free
                parts += [f" {section}"] if section in self.special else self._blank_pieces(section)
            cut.append(parts)
        known = self._known
        if len(known) > CACHE_PIECES:
            known.clear()
        if not known:
            known |= {f" {content}": number.to_bytes(4, "little") for content, number in self.special.items()}
        found = [list(map(known.get, parts)) for parts in cut]
        new = list({p for parts, ids in zip(cut, found, strict=True) if None in ids for p, i in zip(parts, ids, strict=True) if i is None})
        if new:
            words = [self._words(p) for p in new]
            distinct = list(set().union(*words))
            made = dict(zip(distinct, self.merge(distinct), strict=True))
            now = dict(zip(new, [made[ws[0]] if len(ws) == 1 else b"".join(map(made.__getitem__, ws)) for ws in words], strict=True))
            known |= {p: ids for p, ids in now.items() if len(p) <= CACHE_CHARS}
            for parts, ids in zip(cut, found, strict=True):
                if None in ids:
                    ids[:] = [now[p] if i is None else i for p, i in zip(parts, ids, strict=True)]
        return [np.frombuffer(b"".join(ids), "<u4") for ids in found]

    def decode(self, ids) -> str:
        """The pieces with a space between them: this vocabulary names no decoder."""
        return " ".join(map(self.pieces.__getitem__, ids))


#: What encode_documents can return of a text, with its Spark and Arrow types.
OUTPUTS = {
    "ids": ("array<long>", pa.list_(pa.int64()), lambda ids, text: ids.astype(np.int64)),
    "decoded": ("string", pa.string(), lambda ids, text: text),
    "ids_sha256": ("string", pa.string(), lambda ids, text: hashlib.sha256(ids.tobytes()).hexdigest()),
    "decoded_sha256": ("string", pa.string(), lambda ids, text: hashlib.sha256(text.encode()).hexdigest()),
}


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Per row: id, ``n_tokens`` and the named outputs; the digests are of the
    ids as little-endian unsigned 32-bit numbers and of the decoded text's UTF-8.

    Null and empty text: no tokens. Texts and words of any length are encoded
    whole. Null ids stay null; repeated rows give repeated results; an empty table
    gives an empty one; other columns are ignored. The vocabulary file is read on
    the driver and sent to the executors by Spark.
    """
    with open(vocabulary, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(content.value)
        for batch in sliced(batches, "text", 4 << 20):
            rows = bpe.encode_batch([t or "" for t in batch.column("text").to_pylist()])
            texts = [bpe.decode(ids.tolist()) for ids in rows]
            columns = [pa.array([make(i, t) for i, t in zip(rows, texts, strict=True)], kind) for _, kind, make in map(OUTPUTS.__getitem__, outputs)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(len, rows), pa.int64()), *columns], names=["id", "n_tokens", *outputs])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {id_type}, n_tokens long" + "".join(f", {o} {OUTPUTS[o][0]}" for o in outputs))
    return out.withColumnRenamed("id", id_col)


_LOADED: dict[str, WordBpe] = {}


def _loaded(content: str) -> WordBpe:
    """One vocabulary per worker process."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = WordBpe(content)
    return _LOADED[key]
