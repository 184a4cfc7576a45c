"""Tokenizing whole texts by the tokenizers library, with a bounded cache of pieces.

Both vocabularies in use never merge across the cuts made here, so a text's ids are its pieces' ids in a row:
``words`` cuts at ASCII blanks, for tokenizers that lower-case and drop white space; ``spaces`` keeps every character
and cuts as the byte-level split does, one blank leading a word. In both, punctuation without apostrophes that ends a
word of Latin letters is a piece of its own. Cutting and counting distinct pieces is Arrow's; the library encodes each
new piece once for a worker process.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # Unicode White_Space
LATIN, TAIL = "A-Za-zÀ-ÖØ-öø-ɏ", ".,;:!?$%&*#|()"
WORD = f"^(?P<core>[{LATIN}]+)(?P<tail>[{TAIL}]*)$"
EDGE = f"^[{WHITE}]|[{WHITE}]$|^$"
SPACES = re.compile(f" [^{WHITE}]+|[^{WHITE}]+|[{WHITE}]+(?=[{WHITE}][^{WHITE}])|[{WHITE}]+")
#: For each cut: bytes of text encoded at once, pieces and characters cached. Byte-level pieces are more, as they keep
#: case and blanks, and each costs the library more.
ROOM = {"words": (2 << 20, 400_000, 6 << 20), "spaces": (8 << 20, 1_200_000, 16 << 20)}


def _split_words(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Core and tail of each word; '' as the tail of one that isn't Latin letters and punctuation."""
    found = pc.extract_regex(words, WORD)
    ok = pc.is_valid(found)
    none = pa.scalar("", words.type)
    return pc.if_else(ok, pc.struct_field(found, "core"), words), pc.if_else(ok, pc.struct_field(found, "tail"), none)


class Encoder:
    """``encode`` gives the ids of texts; at most ``limit`` pieces or ``chars`` characters stay cached between slices:
    beyond, the pieces that were used in one slice only go, and if that is not half of them the less used ones too.

    A text that holds the string of an added token (``<|endoftext|>``) goes to the library whole, which gives that
    token's id; all others are cut."""

    def __init__(self, path: str, cut: str, limit: int | None = None, chars: int | None = None, slice_bytes: int | None = None):
        from tokenizers import Tokenizer

        if cut not in ("words", "spaces"):
            raise ValueError(cut)
        self.tokenizer = Tokenizer.from_file(path)
        # those that stand for themselves in a raw text; others are looked for in a normalised one, so in any case
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [(t.content, t.normalized) for t in added]
        room = ROOM[cut]
        self.cut, self.slice_bytes, self.limit, self.chars = cut, slice_bytes or room[0], limit or room[1], chars or room[2]
        self._clear()

    def _clear(self):
        self.pieces, self.held, self.used = {"": 0}, 0, 0
        self.flat, self.starts, self.lengths, self.uses = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _shrink(self):
        names, n = list(self.pieces), len(self.pieces)  # in the order of their places
        order = np.argsort(-self.uses[:n], kind="stable")
        order = order[(self.uses[order] > 1) & (order > 0)][: self.limit // 2]
        order = order[np.cumsum([len(names[k]) for k in order.tolist()]) <= self.chars // 2] if len(order) else order
        lengths, starts, flat = self.lengths[order], self.starts[order], self.flat
        self._clear()
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        self.flat = flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)] if total else self.flat
        self.flat = np.concatenate([self.flat, np.zeros(1 << 16, np.uint32)])
        self.starts, self.lengths, self.uses = (np.concatenate([[0], x, np.zeros(1 << 14, np.int64)]) for x in (ends - lengths, lengths, np.ones(len(order), np.int64)))
        self.pieces.update((names[k], i + 1) for i, k in enumerate(order.tolist()))
        self.held, self.used = sum(map(len, self.pieces)), total

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Where distinct pieces stand in the store; new ones are encoded."""
        known = self.pieces
        places = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        fresh = np.flatnonzero(places < 0)
        if len(fresh):
            first, new = len(known), [pieces[k] for k in fresh.tolist()]
            places[fresh] = np.arange(first, first + len(new))
            known.update(zip(new, range(first, first + len(new)), strict=True))
            for lo in range(0, len(new), 10_000):
                some = new[lo : lo + 10_000]
                ids = [x.ids for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                lengths = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
                while self.used + len(flat) > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
                while first + len(new) > len(self.starts):
                    self.starts, self.lengths, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.uses))
                self.flat[self.used : self.used + len(flat)] = flat
                here = slice(first + lo, first + lo + len(some))
                self.lengths[here], self.starts[here] = lengths, self.used + np.cumsum(lengths) - lengths
                self.used += len(flat)
            self.held += sum(map(len, new))
        self.uses[places] += 1
        return places

    def _table(self, *columns: pa.Array) -> list[np.ndarray]:
        """The places of each column's pieces."""
        every = pa.concat_arrays(columns).dictionary_encode()
        places = self._places(every.dictionary.to_numpy(zero_copy_only=False).tolist())[every.indices.to_numpy()]
        return np.split(places, np.cumsum([len(c) for c in columns])[:-1])

    def _gather(self, places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in a row, and their number for each text; counts: pieces a text."""
        lengths = self.lengths[places]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[places] - (ends - lengths), lengths) + np.arange(total)]
        return ids, np.diff(np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))])

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words = pc.list_flatten(lists).dictionary_encode()
        core, tail = self._table(*_split_words(words.dictionary))
        at = words.indices.to_numpy()
        return self._gather(np.stack([core[at], tail[at]], 1).ravel(), 2 * pc.list_value_length(lists).to_numpy())

    def _spaces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        words = pc.list_flatten(lists).dictionary_encode()
        at, size = words.indices.to_numpy(), pc.list_value_length(lists).to_numpy()
        first = np.cumsum(size) - size
        line = pc.starts_with(words.dictionary, "\n")
        body = pc.if_else(line, pc.utf8_slice_codeunits(words.dictionary, 1), words.dictionary)
        odd = pc.match_substring_regex(body, EDGE).to_numpy(zero_copy_only=False)
        core, tail = _split_words(body)
        none, blank = pa.scalar("", body.type), pa.scalar(" ", body.type)
        leads = np.zeros(len(body), bool)
        leads[at[first]] = True
        oddly = pa.array(odd)
        lead, plain, tails, lines = self._table(
            pc.if_else(oddly, none, pc.if_else(line, core, pc.binary_join_element_wise(blank, core, none))), pc.if_else(pc.and_(pa.array(leads), pc.invert(oddly)), core, none),
            pc.if_else(oddly, none, tail), pc.if_else(line, pa.scalar("\n", body.type), none),
        )
        places = np.stack([lines[at], lead[at], tails[at]], 1)
        places[first, 1] = plain[at[first]]
        # white space beyond single blanks and newlines between words: these texts are cut by the pattern
        rough = np.flatnonzero(np.add.reduceat(odd[at], first)) if len(at) else []
        if not len(rough):
            return self._gather(places.ravel(), 3 * size)
        found = [SPACES.findall(t) for t in texts.take(pa.array(rough)).to_pylist()]
        own = self._table(*(pa.array(f, pa.large_string()) for f in found))
        parts = np.split(places.reshape(-1), 3 * first[1:])
        for k, o in zip(rough, own, strict=True):
            parts[k] = o
        return self._gather(np.concatenate(parts), np.array([len(p) for p in parts]))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text, in order; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.zeros(len(texts), bool)
        for content, folded in self.added:
            whole |= pc.match_substring(texts, content, ignore_case=folded).to_numpy(zero_copy_only=False)
        if whole.any():
            own = iter(texts.filter(pa.array(whole)).to_pylist())
            texts = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts)
            for ids, special in zip(self._cut_texts(texts), whole, strict=True):
                yield np.array(self.tokenizer.encode(next(own), add_special_tokens=False).ids, np.uint32) if special else ids
        else:
            yield from self._cut_texts(texts)

    def _cut_texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        slot = np.cumsum(pc.binary_length(texts).to_numpy()) // self.slice_bytes
        for lo, hi in zip(first := np.flatnonzero(np.diff(slot, prepend=-1)), [*first[1:], len(slot)]):
            if len(self.pieces) > self.limit or self.held > self.chars:
                self._shrink()
            ids, counts = (self._words if self.cut == "words" else self._spaces)(pa.concat_arrays([texts.slice(lo, hi - lo)]))  # some string kernels misread arrays with an offset
            yield from np.split(ids, np.cumsum(counts)[:-1])


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, cut: str) -> Encoder:
    """One encoder for each file and worker process; its cache serves later tasks too."""
    if (path, cut) not in _ENCODERS:
        _ENCODERS[path, cut] = Encoder(path, cut)
    return _ENCODERS[path, cut]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_table(docs, id_col: str, text_col: str, path: str, cut: str, end_id: int, release_each: bool = False):
    """(id, ids, n, part, before): each document's ids and the end id, as little-endian 16-bit or 32-bit integers, and
    the ids that its partition holds before it. Rows keep their order; null text is empty. Only the two
    columns are read, whatever others are called; an empty table gives no row. ``release_each``: see ``workers.tidy``."""
    from pyspark import TaskContext

    from .workers import tidy

    def run(batches):
        enc, part, before = encoder(path, cut), TaskContext.get().partitionId(), 0
        wide = enc.tokenizer.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        for b in batches:
            ids, n, ahead = [], [], []
            for x in enc.encode(b.column(text_col)):
                ids.append(np.append(x, np.uint32(end_id)).astype("<u4" if wide else "<u2").tobytes())
                n.append(len(x) + 1)
                ahead.append(before)
                before += len(x) + 1
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array([part] * len(n), pa.int32()), pa.array(ahead, pa.int64()), pa.array([wide] * len(n), pa.bool_())], names=[id_col, "ids", "n", "part", "before", "wide"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run, release_each), f"`{id_col}` {kind}, ids binary, n long, part int, before long, wide boolean")


def unpack(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if wide else "<u2").astype(np.uint32)


def part_bases(table) -> dict[int, int]:
    """Prefix sums over the partitions' totals: ids before each partition. One row a partition reaches the driver."""
    from pyspark.sql import functions as F

    bases, before = {}, 0
    for part, total in sorted(table.groupBy("part").agg(F.sum("n")).collect()):
        bases[part] = before
        before += total
    bases[-1] = before
    return bases
