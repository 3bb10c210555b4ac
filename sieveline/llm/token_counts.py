"""Token counts from a compiled finite-state tokenizer.

The tokenizer's splitting pattern is compiled into a deterministic transducer over classes of code points (space, letter,
number, apostrophe, other; the letters of contractions have their own). A transition says where a piece begins. Every
piece goes through the same merges whatever stands beside it, so the transition that closes a piece emits the number of
tokens of that piece. The merges are compiled into a table of symbol pairs with their rank and product; a new piece is
rewritten by that table, all new pieces of a batch at once, and its count is kept in a lexicon of arcs by each worker up
to a bound. (An automaton of all merges would have a state for each way in which a symbol can still be taken apart; the
table and the lexicon give the same counts.)

Classes, lower case and normal form are those of the tokenizer's library: its tables are read off once a worker, over all
code points. The library splits and counts nothing.

A text is read in parts that end at a space, and a part in blocks. For each block all states are run at once, which gives
the block's map from state to state; the maps are composed by a prefix scan; then every block is replayed from its true
state. All of it is vectorised.

Edge cases: a null or empty text has 0 tokens. Strings of special tokens inside a text count as one token each, as the
library does by default. Texts of any length are read whole. Extra columns are ignored; rows stay as they are.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernels as kn
from .common import prepare, table

U = np.uint64
#: Most arcs that a worker's lexicon keeps.
ARCS = 2_000_000
#: Classes of code points: the pattern's contractions are 's 't 'm 'd 're 've 'll.
SPACE, LETTER, NUMBER, OTHER, APOSTROPHE, ONE, R, V, L, E = range(10)
#: States: after a whole piece or a space; inside letters; inside other signs; after an apostrophe that begins a piece,
#: and after it and r, v or l; inside a contraction that is now whole is FREE again.
FREE, WORD, SIGNS, APO, APO_R, APO_V, APO_L, AFTER = range(8)
#: What a transition does: nothing; a piece begins here; a piece began one code point ago (the apostrophe stood alone).
NONE, BEGIN, BEGIN_BEFORE = range(3)
BLOCK = 256
#: Code points that are read at once, about.
PART = 1 << 20
#: Fixed value: the splitting pattern that is compiled here.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """to[state, class] and does[state, class]. AFTER is the state behind a number or a contraction: the next begins anew."""
    to, does = np.zeros((8, 10), np.uint8), np.zeros((8, 10), np.uint8)
    letters = (LETTER, ONE, R, V, L, E)
    for state in range(8):
        to[state, SPACE], does[state, SPACE] = FREE, NONE
        for c in letters:
            to[state, c], does[state, c] = WORD, NONE if state == WORD else BEGIN
        to[state, NUMBER], does[state, NUMBER] = AFTER, BEGIN
        to[state, OTHER], does[state, OTHER] = SIGNS, NONE if state in (SIGNS, APO) else BEGIN
        to[state, APOSTROPHE], does[state, APOSTROPHE] = (SIGNS, NONE) if state in (SIGNS, APO) else (APO, BEGIN)
    to[APO, ONE], does[APO, ONE] = AFTER, NONE
    for c, state, end in ((R, APO_R, E), (V, APO_V, E), (L, APO_L, L)):
        to[APO, c], does[APO, c] = state, BEGIN  # taken back where the contraction turns out to be whole
        for x in letters:
            does[state, x] = NONE  # the r, v or l began a word
        to[state, end] = AFTER
    return to, does


TO, DOES = transitions()


@lru_cache(maxsize=1)
def classes() -> tuple[np.ndarray, np.ndarray, dict[str, str]]:
    """For every code point its class and its lower case, as the library has them; and the lower case of code points that
    have several."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    kind, low, longer = np.full(0x110000, OTHER, np.uint8), np.arange(0x110000, dtype=np.uint32), {}
    lower = normalizers.Lowercase()
    for begin in range(0, 0x110000, 1 << 14):
        points = [c for c in range(begin, begin + (1 << 14)) if not 0xD800 <= c < 0xE000 and c != 10]
        every = "".join(map(chr, points))
        for pattern, k in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            found = np.ones(len(points), bool)
            for _, (i, j) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(every):
                found[i:j] = False
            kind[np.array(points, int)[found]] = k
        for c, x in zip(points, lower.normalize_str("\n".join(every)).split("\n")):
            if len(x) == 1:
                low[c] = ord(x)
            else:
                longer[chr(c)] = x
    kind[10] = SPACE
    for x in "stmd":
        kind[ord(x)] = ONE
    kind[ord("r")], kind[ord("v")], kind[ord("l")], kind[ord("e")], kind[ord("'")] = R, V, L, E, APOSTROPHE
    return kind, low, longer


class Merges:
    """The symbols of bytes, and the merges as a table of pairs."""

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        # Bytes are spelled by printable code points: themselves where they are printable, else from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelled = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}
        self.byte = np.array([vocab[spelled[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[spelled[b] + end] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = np.array([(vocab[x], vocab[y], vocab[x + y]) for x, y in pairs], np.int64)
        keys, order = np.unique(ids[:, 0] << 32 | ids[:, 1], return_index=True)
        self.keys, self.rank, self.product = keys, order, ids[order, 2]
        first = np.full(len(vocab) + 1, len(ids))
        np.minimum.at(first, ids[:, 0], np.arange(len(ids)))
        np.minimum.at(first, ids[:, 1], np.arange(len(ids)))
        # Whether no merge of the product comes before this one: then all its places in a piece can be merged at once.
        self.safe = first[self.product] > self.rank

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """The number of symbols of each piece, none of them empty, after all merges."""
        out, size = np.zeros(len(pieces), np.int64), np.array([len(x) for x in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.byte[data]
        ends = np.cumsum(size)
        ids[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(pieces)), size)
        none = len(self.keys)
        while len(ids):
            at = np.searchsorted(self.keys, key := ids[:-1] << 32 | ids[1:])
            at[at == none] = 0
            fits = (self.keys[at] == key) & (owner[1:] == owner[:-1])
            where = np.flatnonzero(fits)
            best = np.full(len(pieces), none)
            np.minimum.at(best, owner[where], self.rank[at[where]])
            # Pieces without a pair to merge are done.
            done = best[owner] == none
            out += np.bincount(owner[done], minlength=len(pieces))
            where = where[self.rank[at[where]] == best[owner[where]]]
            # Of places that overlap every other one is merged, from the left; of unsafe ones the first of the piece.
            begin = np.r_[True, (where[1:] != where[:-1] + 1) | (owner[where[1:]] != owner[where[:-1]])]
            nth = np.arange(len(where)) - np.maximum.accumulate(np.where(begin, np.arange(len(where)), 0))
            leads = np.r_[True, owner[where[1:]] != owner[where[:-1]]]
            where = where[(nth % 2 == 0) & (self.safe[at[where]] | leads)]
            ids[where] = self.product[at[where]]
            done[where + 1] = True
            ids, owner = ids[~done], owner[~done]
        return out


def scan(kind: np.ndarray) -> np.ndarray:
    """The state before every code point, from the start FREE."""
    n = len(kind)
    blocks = max(1, -(-n // BLOCK))
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[:n] = kind
    rows = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    step = np.ascontiguousarray(TO.T)  # by class, then state
    flat, wide = step.ravel(), np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for row in rows:  # every block's map, all blocks at once
        wide = flat[(row.astype(np.int16) * 8)[:, None] + wide]
    maps, far = wide, 1
    while far < blocks:  # inclusive prefix scan by composition of maps
        nxt = maps.copy()
        nxt[far:] = np.take_along_axis(maps[far:], maps[:-far].astype(np.int64), axis=1)
        maps, far = nxt, far * 2
    state = np.full(blocks, FREE, np.uint8)
    state[1:] = maps[:-1, FREE]
    out = np.empty_like(rows)
    for i, row in enumerate(rows):
        out[i] = state
        state = flat[row.astype(np.int16) * 8 + state]
    return np.ascontiguousarray(out.T).ravel()[:n]


class Transducer:
    """Counts the tokens of many texts at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex")
        if split != PATTERN:
            raise ValueError(f"the splitting pattern {split!r} isn't the one that is compiled")
        self.merges = Merges(spec["model"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(re.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None
        self.keys, self.counts = np.zeros(0, U), np.zeros(0, np.int64)

    def lexicon(self, keys: np.ndarray, spell) -> np.ndarray:
        """The emitted counts of pieces with these distinct sorted hashes; spell gives the pieces at some of them."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        out = np.zeros(len(keys), np.int64)
        out[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self.merges.counts([x.encode() for x in spell(new)])
            if len(self.keys) + len(new) > ARCS:
                self.keys, self.counts = keys, out
            else:
                every, counts = np.concatenate([self.keys, keys[new]]), np.concatenate([self.counts, out[new]])
                order = np.argsort(every)
                self.keys, self.counts = every[order], counts[order]
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """The numbers of tokens of the texts: of short ones together, of long ones in parts."""
        out, held, size = np.zeros(len(texts), np.int64), [], 0
        if self.special and any("<|" in t for t in texts):
            texts = list(texts)
            for i, t in enumerate(texts):
                texts[i], out[i] = self.special.subn(" ", t)
        for i, t in enumerate(texts):
            at = 0
            while len(t) - at > PART and (cut := WHITE.search(t, at + PART)):
                held.append((i, t[at : cut.start()]))
                at = cut.start()
                self.flush(held, out)
                size = 0
            held.append((i, t[at:] if at else t))
            size += len(t) - at
            if size > PART:
                self.flush(held, out)
                size = 0
        self.flush(held, out)
        return out

    def flush(self, held: list[tuple[int, str]], out: np.ndarray) -> None:
        if held:
            np.add.at(out, [i for i, _ in held], self.part([t for _, t in held]))
            held.clear()

    def part(self, texts: list[str]) -> np.ndarray:
        from tokenizers import normalizers

        kind_of, low, longer = classes()
        whole = "\n".join(texts) + "\n"
        if not whole.isascii():
            form = normalizers.NFC()
            texts = [t if t.isascii() else form.normalize_str(t) for t in texts]
            for x, y in longer.items():
                if x in whole:
                    texts = [t.replace(x, y) for t in texts]
            whole = "\n".join(texts) + "\n"
        points = low[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
        ends = np.cumsum([len(t) + 1 for t in texts])
        del whole
        kind = kind_of[points]
        state = scan(kind)
        does = DOES[state, kind]
        begin = does == BEGIN
        # r, v and l behind an apostrophe begin a word unless the contraction becomes whole
        for mid, end in ((APO_R, E), (APO_V, E), (APO_L, L)):
            whole_one = np.flatnonzero((state == mid) & (kind == end))
            begin[whole_one - 1] = False
        starts = np.flatnonzero(begin)
        solid = kind != SPACE
        solid_next = np.r_[solid[1:], False]
        begin_next = np.r_[begin[1:], False]
        finish = np.flatnonzero(solid & (~solid_next | begin_next)) + 1
        del state, does
        hashes = point_hashes(points, starts, finish)
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        spell = lambda idx: ["".join(map(chr, points[starts[i] : finish[i]])) for i in first[idx]]
        counts = np.concatenate([[0], np.cumsum(self.lexicon(keys, spell)[back])])
        upto = counts[np.searchsorted(starts, ends)]
        return np.diff(np.r_[0, upto])


#: Where a text can be cut: no piece goes over such a sign, nor does any composition of code points.
WHITE = re.compile("[ \n]")


def point_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = kn.powers(len(points))
    sums = np.zeros(len(points) + 1, U)
    np.cumsum((points.astype(U) + U(1)) * up[: len(points)], out=sums[1:])
    return kn.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def counter(path: str):
    def run(batches):
        machine = transducer(path)
        for whole in batches:
            for batch in kn.slices(whole, 1):
                _, offsets = kn.utf8(batch.column(1))
                texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(machine.count(texts))], schema=SCHEMA)

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every text, for a vocabulary file whose splitting pattern is the one above."""
    prepare(docs.sparkSession)
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(counter(path), "doc_id long, n_bytes long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.selectExpr("*", "n_tokens > 2048 AS over_limit")
