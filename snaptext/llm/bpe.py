"""Byte-level BPE encoding and decoding with the vocabulary of a given tokenizer file.

A text is cut at added tokens, then by the pattern of the byte-level pre-tokenizer; each piece is merged
by rank. Encodings of what stands between two single spaces are remembered: there a piece always ends. The
pieces of words not remembered are merged together, all words of a batch in one array. A long unsplit piece is encoded by tree concatenation: its halves are encoded on their own, and
around the join a growing window is encoded again until its first and last token agree with those of
the two sides. Then all neighbouring tokens are as in the encoding of their own bytes, which for merges
by rank makes the whole sequence the encoding of the whole piece.

Texts longer than ``PART`` code points are dealt out: parts end where a piece of the pattern ends, so they
can be encoded apart, and a single piece beyond ``PART`` is halved into parts of its own that are joined
the same way. Only encoded parts, not texts, of those documents come together again.

The vocabulary file is read by the driver and sent to the tasks as its text.
"""

from __future__ import annotations

import importlib.util
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Code points of a text that one task encodes in one go.
PART = 65_536
#: Bytes of a piece that are merged directly; longer ones are halved.
DIRECT = 256
#: Words whose encoding a task remembers; as many older ones are kept until the next change. About 200 bytes each.
REMEMBERED = 1 << 17
_LONGEST_WORD = 48
#: Code points of the texts that are encoded together.
TOGETHER = 1 << 20

#: The pattern of the byte-level pre-tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# A space with other white space beside it, and one without.
_ODD_SPACE = re.compile(r" (?:\s|(?<=\s ))")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def byte_characters() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: visible Latin-1 as itself, the others from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    """Where pairs are looked for first in a table of ``size`` slots, a power of two."""
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _hashed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash table of distinct pairs and their numbers: a pair is in its slot or in one after it without a gap; empty slots hold -1."""
    size = 1 << max(4, (4 * keys.size).bit_length())
    slot_keys, slot_ranks = np.full(size, -1, np.int64), np.zeros(size, np.int32)
    for rank, (at, key) in enumerate(zip(_slots(keys, size).tolist(), keys.tolist())):
        while slot_keys[at] != -1:
            at = (at + 1) % size
        slot_keys[at], slot_ranks[at] = key, rank
    return slot_keys, slot_ranks


class Bpe:
    """Encoder and decoder of one tokenizer file, given as its JSON text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        to_byte = byte_characters()
        raw = {token: bytes(to_byte[c] for c in token) for token in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        self.bytes_of = {i: raw[token] for token, i in ids.items()}
        self.single = {raw[token][0]: i for token, i in ids.items() if len(raw[token]) == 1}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.ranks = {(a, b): rank for rank, (a, b, _) in enumerate(merges)}
        self.result = [ab for _, _, ab in merges]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        self.pattern = regex.compile(PATTERN)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        # The same merges as arrays hashed by their pair, and the ids of single bytes.
        self.slot_keys, self.slot_ranks = _hashed(np.fromiter(((a << 32) | b for a, b, _ in merges), np.int64, len(merges)))
        self.merged_ids = np.array([*self.result, 0], np.int32)
        self.byte_ids = np.array([self.single.get(b, 0) for b in range(256)], np.int32)
        self.decimal = [b"%d" % i for i in range(len(self.table))]
        # Remembered encodings are packed as 32-bit ids.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[int]:
        """Merge by rank, leftmost first among equals."""
        ids = [self.single[b] for b in data]
        rank_of, none, result = self.ranks.get, len(self.result), self.result
        ranks = [rank_of(pair, none) for pair in zip(ids, ids[1:])]
        if len(ids) > DIRECT:
            return self._merged_by_passes(ids, ranks)
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            new = ids[i] = result[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], new), none)
            if i < len(ranks):
                ranks[i] = rank_of((new, ids[i + 1]), none)
        return ids

    def _merged_by_passes(self, ids: list[int], ranks: list[int]) -> list[int]:
        """The same for long data: all pairs of the best rank in one pass."""
        rank_of, none = self.ranks.get, len(self.result)
        while ranks and (best := min(ranks)) < none:
            new, out, i = self.result[best], [], 0
            while i < len(ranks):
                if ranks[i] == best:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            if i == len(ranks):
                out.append(ids[i])
            ids = out
            ranks = [rank_of(pair, none) for pair in zip(ids, ids[1:])]
        return ids

    def merged_together(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces, merged side by side: in each round every piece merges all pairs of its best rank."""
        none, done = len(self.result), [b""] * len(pieces)
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        of = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, pieces), np.int64, len(pieces)))
        while ids.size:
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            ranks = np.full(ids.size, none, np.int32)
            inner = np.flatnonzero(of[1:] == of[:-1])
            keys = (ids[inner].astype(np.int64) << 32) | ids[inner + 1]
            at = _slots(keys, self.slot_keys.size)
            there = self.slot_keys[at]
            ranks[inner] = np.where(there == keys, self.slot_ranks[at], none)
            others = np.flatnonzero((there != keys) & (there != -1))
            while others.size:
                at[others] = (at[others] + 1) % self.slot_keys.size
                there = self.slot_keys[at[others]]
                found = there == keys[others]
                ranks[inner[others[found]]] = self.slot_ranks[at[others[found]]]
                others = others[~found & (there != -1)]
            best = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.append(starts, ids.size))
            ended = best == none
            if ended.any():
                packed = ids.tobytes()
                for i, s, n in zip(of[starts[ended]].tolist(), (starts[ended] * 4).tolist(), (sizes[ended] * 4).tolist()):
                    done[i] = packed[s : s + n]
                left = np.repeat(~ended, sizes)
                ids, of, ranks, best = ids[left], of[left], ranks[left], np.repeat(best[~ended], sizes[~ended])
                if not ids.size:
                    break
            else:
                best = np.repeat(best, sizes)
            chosen = ranks == best
            # Of pairs that overlap, every other one from the left.
            i = np.flatnonzero(chosen)
            first = np.append(True, np.diff(i) > 1)
            run = np.maximum.accumulate(np.where(first, np.arange(i.size), 0))
            i = i[(np.arange(i.size) - run) % 2 == 0]
            ids[i] = self.merged_ids[ranks[i]]
            keep = np.ones(ids.size, bool)
            keep[i + 1] = False
            ids, of = ids[keep], of[keep]
        return done

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Encodings of words after a space."""
        single, cut = [], {}
        for w in words:
            if w.isalpha():
                single.append(w)
            else:
                cut[w] = self.pattern.findall(f" {w}")
        pieces = list({*chain.from_iterable(cut.values()), *(f" {w}" for w in single)})
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        ids = dict(zip(pieces, self.merged_together([d if len(d) <= DIRECT else b"" for d in data])))
        for p, d in zip(pieces, data):
            if len(d) > DIRECT:
                ids[p] = array("i", self.piece(d)).tobytes()
        return {w: ids[f" {w}"] for w in single} | {w: b"".join([ids[p] for p in ps]) for w, ps in cut.items()}

    def piece(self, data: bytes) -> list[int]:
        """Encoding of one piece; halves of a long one are joined."""
        if len(data) <= DIRECT:
            return self.merged(data)
        middle = len(data) // 2
        return self.join(self.piece(data[:middle]), self.piece(data[middle:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the concatenation of what two sequences of one piece encode.

        The window mostly ends after a few tokens; in a text that repeats one letter it grows to the end.
        """
        if not left or not right:
            return left or right
        reach = 4
        while True:
            l, r = max(0, len(left) - reach), min(len(right), reach)
            window = self.merged(b"".join(self.bytes_of[i] for i in chain(left[l:], right[:r])))
            if (l == 0 or window[0] == left[l]) and (r == len(right) or window[-1] == right[r - 1]):
                return [*left[:l], *window, *right[r:]]
            reach *= 2

    def pieces(self, text: str) -> Iterator[str | int]:
        """Pieces of the pattern, and ids of added tokens, in order."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield from self.pattern.findall(text[at : m.start()])
            yield self.added[m[0]]
            at = m.end()
        yield from self.pattern.findall(text[at:] if at else text)

    def _plain(self, text: str) -> bytes:
        """Encoding of a text without regard to added tokens."""
        out: list[int] = []
        for p in self.pattern.findall(text):
            out += self.piece(p.encode("utf-8", "surrogatepass"))
        return array("i", out).tobytes()

    def encode_together(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed 32-bit numbers."""
        whole: list[list[list[str] | bytes]] = []
        for text in texts:
            segments: list[list[str] | bytes] = []
            at = 0
            if any(a in text for a in self.added):
                for m in self.cut.finditer(text):
                    segments += [self._words(text[at : m.start()]), array("i", [self.added[m[0]]]).tobytes()]
                    at = m.end()
            segments.append(self._words(text[at:] if at else text))
            whole.append(segments)
        needed = set().union(*(s[1:] for segments in whole for s in segments if isinstance(s, list)))
        found = {w: self.known[w] for w in needed & self.known.keys()}
        missing = needed - found.keys()
        found |= {w: self.older[w] for w in missing & self.older.keys()}
        found |= self.learn(needed - found.keys())
        for w in missing:
            if len(w) <= _LONGEST_WORD:
                if len(self.known) >= REMEMBERED:
                    self.older, self.known = self.known, {}
                self.known[w] = found[w]
        ids_of = found.__getitem__
        return [
            b"".join(x for s in segments for x in ([s] if isinstance(s, bytes) else chain([self._plain(s[0])], map(ids_of, s[1:]))))
            for segments in whole
        ]

    @cached_property
    def native(self):
        """A compiled encoder that merges whatever makes a token, or None if it isn't at hand or would not be the same.

        It is the same if every token is the encoding of its own bytes. For then, whenever two neighbours make up a token,
        merges of lower rank have left those bytes as they would alone, and there the last merge is that of these two.
        """
        ids = [i for i in range(len(self.table)) if i not in self.added.values() and self.table[i]]
        if importlib.util.find_spec("tiktoken") is None or len({self.table[i] for i in ids}) < len(ids):
            return None
        alone = self.merged_together([self.table[i] for i in ids])
        if any(packed != i.to_bytes(4, "little") for i, packed in zip(ids, alone)):
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={self.table[i]: i for i in ids}, special_tokens=self.added)

    def encode_natively(self, texts: Iterable[str]) -> Iterator[bytes]:
        """As ``encode_all``, by the compiled encoder if there is one."""
        if self.native is None:
            return self.encode_all(texts)
        return (self.native.encode_to_numpy(t, allowed_special="all").astype("<u4").tobytes() for t in texts)

    def _words(self, text: str) -> list[str]:
        """What stands before the first single space, and the words after single spaces."""
        return _SINGLE_SPACE.split(text) if _ODD_SPACE.search(text) else text.split(" ")

    def encode_packed(self, text: str) -> bytes:
        return self.encode_together([text])[0]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """As ``encode_together``, some texts at a time."""
        some, length = [], 0
        for text in texts:
            some.append(text)
            length += len(text)
            if length >= TOGETHER:
                yield from self.encode_together(some)
                some, length = [], 0
        if some:
            yield from self.encode_together(some)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype=np.int32).tolist()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def parts(self, text: str, size: int) -> Iterator[tuple[str, str | int]]:
        """Parts of a long text: "text", an "added" token's id, "first" and "next" ones of a single piece.

        A text part is cut into the same pieces again if it doesn't end in white space (whose pieces
        depend on what follows); such an end is given as pieces of their own.
        """
        held: list[str] = []
        length = 0

        def flush() -> Iterator[tuple[str, str | int]]:
            at = len(held)
            while at and held[at - 1].isspace():
                at -= 1
            if at:
                yield "text", "".join(held[:at])
            yield from (("first", p) for p in held[at:])
            held.clear()

        for p in self.pieces(text):
            fits = isinstance(p, str) and len(p) <= size
            if held and (not fits or length + len(p) > size):
                yield from flush()
                length = 0
            if fits:
                held.append(p)
                length += len(p)
            elif isinstance(p, int):
                yield "added", p
            else:
                for i in range(0, len(p), size):
                    yield "next" if i else "first", p[i : i + size]
        yield from flush()


@lru_cache(maxsize=1)
def _bpe(text: str) -> Bpe:
    return Bpe(text)


def _lists(rows: list[bytes]) -> pa.Array:
    """List array of packed ids."""
    ends = np.cumsum([0, *(len(r) // 4 for r in rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))


def _rows(lists: pa.Array) -> Iterator[list[int] | None]:
    """Python lists of a list array, null for null."""
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for i, valid in enumerate(lists.is_valid()):
        yield flat[ends[i] : ends[i + 1]].tolist() if valid.as_py() else None


def _vocabulary(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _encoded(
    docs: DataFrame, path: str, part: int, outputs: str, finish: Callable[[Bpe, list[bytes]], list[pa.Array]], natively: bool = False
) -> DataFrame:
    """(``doc_id``, ``text_key``, *outputs*) for every row of (``doc_id``, ``text``); ``finish`` makes the outputs of packed
    ids in the task that has encoded them, so that they need not go through another one. ``natively``: by the compiled encoder.
    """
    made = [field.split()[0] for field in outputs.split(", ")]
    vocabulary = _vocabulary(docs.sparkSession, path)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocabulary.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                packed = list((bpe.encode_natively if natively else bpe.encode_all)(t.as_py() for t in some.column("text")))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text_key"), *finish(bpe, packed)], names=["doc_id", "text_key", *made])

    schema = f"doc_id {id_type}, text_key long, {outputs}"
    direct = rows.filter(F.length("text") <= part).mapInArrow(short, schema)

    names = ["doc_id", "text_key", "copies", "n", "kind"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocabulary.value)
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                for n, (kind, p) in enumerate(bpe.parts(text.as_py(), part)):
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).slice(i, 1) for c in names[:3]), pa.array([n], pa.int64()), pa.array([kind]), pa.array([str(p)])],
                        names=[*names, "part"],
                    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocabulary.value)
        for batch in batches:
            for i, (kind, p) in enumerate(zip(batch.column("kind"), batch.column("part"))):
                kind, p = kind.as_py(), p.as_py()
                ids = [int(p)] if kind == "added" else bpe.encode(p) if kind == "text" else bpe.piece(p.encode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, 1) for c in names), pa.array([ids], pa.list_(pa.int32()))], names=[*names, "ids"]
                )

    def joined(table: pa.Table) -> pa.Table:
        bpe = _bpe(vocabulary.value)
        table = table.sort_by("n")
        runs: list[list[list[int]]] = []
        for kind, ids in zip(table.column("kind"), _rows(table.column("ids").combine_chunks())):
            if kind.as_py() == "next":
                runs[-1].append(ids)
            else:
                runs.append([ids])
        ids: list[int] = []
        for level in runs:
            while len(level) > 1:
                level = [bpe.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            ids += level[0]
        first = table.slice(0, 1)
        copies = first.column("copies")[0].as_py()
        return pa.table(
            {c: pa.array([first.column(c)[0].as_py()] * copies, first.schema.field(c).type) for c in ("doc_id", "text_key")}
            | dict(zip(made, finish(bpe, [array("i", ids).tobytes()] * copies)))
        )

    long_ones = (
        rows.filter(F.length("text") > part)
        .groupBy(F.xxhash64("doc_id").alias("id_key"), "text_key")
        .agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
        .select("doc_id", "text_key", "copies", "text")
    )
    part_schema = f"doc_id {id_type}, text_key long, copies long, n long, kind string"
    parts = long_ones.mapInArrow(cut, f"{part_schema}, part string").repartition(F.xxhash64("doc_id", "text_key", "n"))
    sequences = parts.mapInArrow(encoded, f"{part_schema}, ids array<int>")
    long_encoded = sequences.groupBy(F.xxhash64("doc_id").alias("id_key"), "text_key").applyInArrow(joined, schema)
    return direct.unionByName(long_encoded)


def encode(docs: DataFrame, path: str, part: int = PART) -> DataFrame:
    """(``doc_id``, ``text_key``, ``ids``: array of int) for every row of (``doc_id``, ``text``).

    Null texts are empty and have no ids. The string of an added token in a text is that token. Rows
    equal in id and text are repeated in the result.
    """
    return _encoded(docs, path, part, "ids array<int>", lambda bpe, packed: [_lists(packed)])


def encode_packed(docs: DataFrame, path: str, part: int = PART) -> DataFrame:
    """As ``encode``, with the ids of a row as one binary of little-endian 32-bit numbers, by the compiled encoder where it is the same."""
    return _encoded(docs, path, part, "ids binary", lambda bpe, packed: [pa.array(packed, pa.binary())], natively=True)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``text`` in place of ``ids``; bytes that are no UTF-8 become U+FFFD. Null ids give a null text."""
    vocabulary = _vocabulary(encoded.sparkSession, path)
    kept = [f for f in encoded.schema if f.name != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocabulary.value)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids) for ids in _rows(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], names=[*(f.name for f in kept), "text"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return encoded.mapInArrow(run, f"{schema}text string")


def digests(docs: DataFrame, path: str, part: int = PART) -> DataFrame:
    """(``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``) of every row of (``doc_id``, ``text``): its ids, in decimal
    and joined by commas, and what they decode to. Encoded and decoded in one task.
    """

    def finish(bpe: Bpe, packed: list[bytes]) -> list[pa.Array]:
        decimal, hashed, decoded = bpe.decimal.__getitem__, [], []
        for p in packed:
            ids = np.frombuffer(p, np.int32).tolist()
            hashed.append(sha256(b",".join(map(decimal, ids))).hexdigest())
            decoded.append(sha256(bpe.decode(ids).encode()).hexdigest())
        return [pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(hashed), pa.array(decoded)]

    outputs = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _encoded(docs, path, part, outputs, finish).drop("text_key")
