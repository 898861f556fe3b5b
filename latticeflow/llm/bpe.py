"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a partition are laid out in one array of symbols.  An index maps each mergeable pair,
by its rank, to all its positions in the partition; a heap holds the active ranks.  The lowest rank is applied
to all its positions at once and the lists of the neighbouring pairs are updated, until no active rank is
left.  This equals merging word by word, lowest rank first, because no rule of the vocabulary uses a symbol
that a later rule makes (checked when the tokenizer is loaded).  A partition's texts wait, as numbers of their
words, until its index has been worked off; a partition of more than ``CHUNK`` characters is indexed in parts of
that size, so that memory is bounded.

Defined cases: null text encodes like the empty text (no ids, empty decoded text); a text of any length is
encoded whole; repeated rows give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.llm.common import session

#: White space of the tokenizer's patterns.
SPACES = "\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Code points that the tokenizer's character tables do not know yet (they are symbols there),
#: though newer tables call them letters or numbers.
UNKNOWN_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 "
    "16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 "
    "1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 "
    "1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: First and last capital, first small letter, that Python's character tables do not know yet.
NEW_CAPITALS = "1C89-1C89:1C8A A7CB-A7CB:0264 A7CC-A7CC:A7CD A7CE-A7CE:A7CF A7D2-A7D2:A7D3 A7D4-A7D4:A7D5 A7DA-A7DA:A7DB A7DC-A7DC:019B 10D50-10D65:10D70 16EA0-16EB8:16EBB"
#: Characters of text whose words are indexed together; whole texts, so one longer text makes a part of its own.
CHUNK = 16_000_000
#: Rows of one output batch.
ROWS = 200


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself if Latin-1 shows it, else the next letter from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A lower-casing BPE tokenizer with word ends, from a tokenizers JSON file's content."""

    def __init__(self, content: bytes):
        import regex

        spec = json.loads(content)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + end] for c in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.shown = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.shown[i] = token.encode()
        #: (left id << 32 | right id) -> (rank, id of the merged symbol)
        self.rules: dict[int, tuple[int, int]] = {}
        made: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            new = vocab[a + b]
            if max(made.get(vocab[a], -1), made.get(vocab[b], -1)) >= rank:
                raise ValueError("a merge uses a symbol of a later merge")
            self.rules[vocab[a] << 32 | vocab[b]] = (rank, new)
            made[new] = rank
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACES}\p{{L}}\p{{N}}]+")
        spans = [x.partition("-")[::2] for x in UNKNOWN_LETTERS.split()]
        self.unknown = regex.compile("[" + "".join(f"\\U{a:0>8}" + f"-\\U{b:0>8}" * bool(b) for a, b in spans) + "]")
        self.capitals: dict[int, int] = {}
        for x in NEW_CAPITALS.split():
            first, last, small = (int(y, 16) for y in x.replace(":", "-").split("-"))
            self.capitals |= {c: small + c - first for c in range(first, last + 1)}

    def pieces_of(self, text: str) -> list[str]:
        """Normalise (NFC, lower case character by character) and cut into words."""
        if text.isascii():
            return self.pieces.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if any(unicodedata.category(c) == "Cn" for c in set(text) if c > "\u02ff"):
            text = text.translate(self.capitals)
            plain = self.unknown.sub("\uffff", text)
            return [text[m.start() : m.end()] for m in self.pieces.finditer(plain)]
        return self.pieces.findall(text)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words (little-endian unsigned 32-bit) by one index over all of them."""
        sym: list[int] = []
        starts: list[int] = []
        inner, final = self.inner, self.final
        for w in words:
            raw = w.encode()
            starts.append(len(sym))
            sym.extend(map(inner.__getitem__, raw[:-1]))
            sym.append(final[raw[-1]])
        n = len(sym)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        for s in starts:
            before[s] = -1
            if s:
                after[s - 1] = n
        sym.append(-1)
        index: dict[int, list[int]] = {}
        rules = self.rules
        for p in range(n):
            q = after[p]
            if q < n and (rule := rules.get(sym[p] << 32 | sym[q])):
                index.setdefault(rule[0], []).append(p)
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            for p in sorted(index.pop(rank)):
                left = sym[p]
                if left < 0 or (q := after[p]) >= n:
                    continue
                rule = rules.get(left << 32 | sym[q])
                if rule is None or rule[0] != rank:
                    continue  # an overlapping merge took one of the two
                sym[p] = new = rule[1]
                sym[q] = -1
                after[p] = r = after[q]
                if r < n:
                    before[r] = p
                    if (rule := rules.get(new << 32 | sym[r])) is not None:
                        if rule[0] not in index:
                            index[rule[0]] = []
                            heapq.heappush(active, rule[0])
                        index[rule[0]].append(p)
                if (o := before[p]) >= 0 and (rule := rules.get(sym[o] << 32 | new)) is not None:
                    if rule[0] not in index:
                        index[rule[0]] = []
                        heapq.heappush(active, rule[0])
                    index[rule[0]].append(o)
        left_over = np.array(sym[:n], dtype="<i8")
        alive = left_over >= 0
        raw = left_over[alive].astype("<u4").tobytes()
        at = (4 * np.r_[0, np.cumsum(alive)][[*starts, n]]).tolist()
        return [raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]

    def decode(self, ids: bytes) -> bytes:
        """The tokens' strings, joined by a space (the tokenizer file names no decoder), in UTF-8."""
        return b" ".join(map(self.shown.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class _Numbers(dict):
    """Word -> a number, given as words are met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Chunk:
    """Texts of a partition as numbers of their distinct words, until all are encoded together."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.numbers = _Numbers()
        self.texts: list[np.ndarray] = []

    def add(self, text: str | None) -> None:
        """Numbers of the text's words; special strings are -1 less their id."""
        number, bpe = self.numbers.__getitem__, self.bpe
        found: list[int] = []
        text = text or ""
        parts = bpe.split_special.split(text) if bpe.split_special is not None and any(s in text for s in bpe.special) else [text]
        for part in parts:
            if part in bpe.special:
                found.append(-1 - bpe.special[part])
            elif part:
                found += map(number, bpe.pieces_of(part))
        self.texts.append(np.array(found, np.int32))

    def encoded(self) -> Iterator[bytes]:
        """Ids of each text in order, as little-endian unsigned 32-bit integers."""
        words = self.bpe.encode_words(list(self.numbers))
        words += [i.to_bytes(4, "little") for i in reversed(range(len(self.bpe.shown)))]  # found from the end by -1 less the id
        for numbers in self.texts:
            yield b"".join(map(words.__getitem__, numbers.tolist()))


#: Tokenizers of this Python worker by their files' content.
_loaded: dict[bytes, WordBpe] = {}


def encode(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK) -> DataFrame:
    """Encode and decode whole texts.

    Returns the ``keep`` columns and ``n_tokens`` long, ``ids`` binary (little-endian unsigned 32-bit
    integers, special strings in a text as their ids, none added) and ``decoded`` string.  ``tokenizer`` is
    the path of the JSON file on the driver; its content, of fixed size, is broadcast.
    """
    file = session(docs).sparkContext.broadcast(Path(tokenizer).read_bytes())
    kept = [c for c in keep if c != text]
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if file.value not in _loaded:
            _loaded[file.value] = WordBpe(file.value)
        bpe = _loaded[file.value]
        rows: list[pa.RecordBatch] = []
        held, size = Chunk(bpe), 0

        def out() -> Iterator[pa.RecordBatch]:
            ids = held.encoded()
            for part in rows:
                found = [next(ids) for _ in range(part.num_rows)]
                decoded = pa.array([bpe.decode(x) for x in found], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(found, pa.binary()), decoded], [*kept, "n_tokens", "ids", "decoded"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for t in part.column(len(kept)).to_pylist():
                    held.add(t)
                    size += len(t or "")
                rows.append(pa.RecordBatch.from_arrays([pa.concat_arrays([part.column(i)]) for i in range(len(kept))], kept))
                if size >= chunk:
                    yield from out()
                    rows, held, size = [], Chunk(bpe), 0
        if rows:
            yield from out()

    schema = ", ".join(f"`{c}` {types[c]}" for c in kept)
    slim = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string"))
    return slim.mapInArrow(run, f"{schema}, n_tokens long, ids binary, decoded string")


def ids_as_array(encoded: DataFrame) -> DataFrame:
    """``ids`` of :func:`encode` as ``array<long>`` (for consumers that want numbers)."""
    hexes = F.hex("ids")
    at = lambda i, k: F.substr(hexes, i * 8 + 1 + 2 * k, F.lit(2))
    number = lambda i: F.conv(F.concat(at(i, 3), at(i, 2), at(i, 1), at(i, 0)), 16, 10).cast("long")
    return encoded.withColumn("ids", F.when(F.col("n_tokens") == 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1), lambda i: number(i.cast("int")))))
