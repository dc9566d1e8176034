"""SentencePiece segmentations sampled by forward filtering and backward sampling over the piece lattice; decoding is lossless.

The vocabulary holds merge ranks, not probabilities, so a piece of rank r weighs (r + 1) ** -`sharpness`, a Zipf law; higher values
favour frequent, long pieces less strongly varied; the runs of word starts, whose scores are no ranks, weigh as the last rank. No piece
of the vocabulary has a word start after another character, so the lattice of a text is a chain of word lattices, a word having all spaces
before it: forward filtering runs once for each different word of a block of texts, and backward sampling runs for all occurrences at
once, each step drawing the last piece before a place. A draw depends on the row's key, the word's place in the row and the step
alone, so it is the same wherever and however often a row is processed.

Characters without a piece, and a literal word-start mark in the text, go as their bytes; every text decodes to itself.

Cases: null text is empty and has no pieces besides the word start that encoding puts in front; repeated rows are sampled
alike; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, keyed, kind_of, mix, steps, task_caches, tidy

MARK = "▁"
#: Texts of about so many bytes share the lattices of their different words.
SAMPLE_BYTES = 12 << 20
#: A word with the spaces before it, but for the first, which every word has.
WORDS = re.compile(" ( *[^ ]*)")


class Lattice:
    """The vocabulary as a trie of arrays, and the lattices of many words at once."""

    def __init__(self, model: str, sharpness: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.vocab_size()
        self.bytes = [0] * 256
        self.text: list[bytes] = [b""] * n
        weight: dict[str, tuple[int, float]] = {}
        for i, p in enumerate(sp.id_to_piece(i) for i in range(n)):
            if sp.is_byte(i):
                self.bytes[int(p[3:-1], 16)] = i
                self.text[i] = bytes([int(p[3:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if MARK in p.lstrip(MARK):
                    raise ValueError(f"piece {p!r} has a word start after another character")
                weight[p] = (i, -sharpness * float(np.log(min(n, -sp.get_score(i)) + 1.0)))
                self.text[i] = p.replace(MARK, " ").encode()
        self.weight = weight
        self.byte_weight = -sharpness * float(np.log(n + 1.0))
        states = {"": 0}
        for p in sorted(weight):
            for j in range(1, len(p) + 1):
                states.setdefault(p[:j], len(states))
        moves = sorted((states[p[:-1]] << 21 | ord(p[-1]), states[p]) for p in states if p)
        self.moves, self.goal = (np.array(x, np.int64) for x in zip(*moves, strict=True))
        self.begin = np.zeros(1 + max(ord(p) for p in states if len(p) == 1), np.int64)  # the state after a first character
        for p, i in states.items():
            if len(p) == 1:
                self.begin[ord(p)] = i
        self.piece = np.full(len(states), -1, np.int32)
        self.value = np.full(len(states), -np.inf)
        for p, (i, v) in weight.items():
            self.piece[states[p]], self.value[states[p]] = i, v

    def edges(self, code: np.ndarray, word: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[tuple[np.ndarray, ...], list[int]]:
        """For characters of words one after another: each edge's first and last character, piece (-1: bytes) and log weight; and how many edges
        there are of each length (those of bytes, of one character, last). Edges of one length are in the order of their characters."""
        at = np.arange(len(code), dtype=np.int32)
        end = stop.astype(np.int32)[word]
        out: list[tuple[np.ndarray, ...]] = []
        plain = np.ones(len(code), bool)
        step = 0
        while len(at):
            if step:
                key = state << 21 | code[at + step]
                i = np.minimum(np.searchsorted(self.moves, key), len(self.moves) - 1)
                ok = self.moves[i] == key
                at, state = at[ok], self.goal[i[ok]]
            else:  # all characters take their first move
                state = np.where(code < len(self.begin), self.begin[np.minimum(code, len(self.begin) - 1)], 0)
                at, state = at[state > 0], state[state > 0]
            got = self.piece[state] >= 0
            out.append((at[got], at[got] + np.int32(step), self.piece[state[got]], self.value[state[got]]))
            if step == 0:
                plain[at[got]] = False
            step += 1
            more = at + step < end[at]
            at, state = at[more], state[more]
        alone = np.flatnonzero(plain).astype(np.int32)  # no piece of this one character
        out.append((alone, alone, np.full(len(alone), -1, np.int32), np.full(len(alone), self.byte_weight)))
        return tuple(np.concatenate([x[i] for x in out]) for i in range(4)), [len(x[0]) for x in out]

    def filtered(self, words: list[str], at_once: int = 1 << 15) -> tuple[np.ndarray, ...]:
        """Forward filtering of different words: each word's first character and end, and for edges in the order of their last
        character: "drawn" (the last character's number plus the cumulative share among the edges that end there), first character, piece.
        `at_once` words are worked on at a time; their characters and edges are numbered on."""
        parts, chars = [], 0
        for i in range(0, len(words), at_once):
            parts.append(self._filtered(words[i : i + at_once], chars))
            chars = int(parts[-1][1][-1])
        return tuple(np.concatenate([p[j] for p in parts]) for j in range(5))

    def _filtered(self, words: list[str], offset: int) -> tuple[np.ndarray, ...]:
        marked = [MARK + (w.replace(MARK, "\0") if MARK in w else w).replace(" ", MARK) for w in words]
        code = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.int64)
        size = np.array([len(w) for w in marked])
        stop = np.cumsum(size)
        start = stop - size
        word = np.repeat(np.arange(len(words)), size)
        (first, last, piece, value), lengths = self.edges(code, word, start, stop)
        # alpha is kept relative to the place before the edge's word character by character: log domain, one level of first characters at a time
        alpha = np.full(len(code) + 1, -np.inf)
        before = np.where(np.arange(len(code)) == start[word], -1, np.arange(len(code)) - 1)
        depth = first - start[word[first]]
        deepest = int(depth.max())
        order = np.argsort(depth.astype(np.uint16) if deepest < 1 << 16 else depth, kind="stable")  # by digits where 16 bits hold it
        bounds = np.concatenate([[0], np.cumsum(np.bincount(depth, minlength=deepest + 1))])
        weight = np.empty(len(first))
        for d in range(len(bounds) - 1):
            e = order[bounds[d] : bounds[d + 1]]
            come = before[first[e]]
            w = np.where(come < 0, 0.0, alpha[come]) + value[e]
            weight[e] = w
            alpha[last[e]] = np.logaddexp(alpha[last[e]], w)  # edges of one depth of one word end at different characters
        # By last character, then by first: of the edges that end at a character each length has one, and the longest begins first.
        begins = np.cumsum(np.bincount(last, minlength=len(code)))
        free = np.concatenate([[0], begins[:-1]])
        order = np.empty(len(last), np.int64)
        ends = np.cumsum(lengths)
        for n, stop_at in sorted(zip(lengths, ends.tolist(), strict=True), key=lambda x: -x[1] if x[1] < ends[-1] else 0):
            e = np.arange(stop_at - n, stop_at)
            order[free[last[e]]] = e
            free[last[e]] += 1
        first, last, piece = first[order], last[order], piece[order]
        share = np.exp(weight[order] - alpha[last])
        run = np.cumsum(share)
        head = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        before_node = np.concatenate([[0.0], run])[head]
        n_edges = np.diff(np.append(head, len(last)))
        last = last + np.int32(offset)
        drawn = last + np.minimum(run - np.repeat(before_node, n_edges), 1.0)
        drawn[np.append(head[1:], len(last)) - 1] = last[np.append(head[1:], len(last)) - 1] + 1.0
        return start + offset, stop + offset, drawn, first + np.int32(offset), piece

    def sample(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """Ids of one sampled segmentation of each text; `seeds` are the rows' keys."""
        if not texts:
            return []
        split = [WORDS.findall(" " + t) for t in texts]
        sizes = np.array([len(s) for s in split])
        coded = pa.array([w for s in split for w in s], pa.large_string()).dictionary_encode()
        which, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        del split, coded
        start, stop, drawn, first, piece = self.filtered(words)
        row = np.repeat(np.arange(len(texts)), sizes)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = mix(seeds[row] + mix(nth.astype(U64)))
        near = which >> max(0, len(words).bit_length() - 16)
        occ = np.argsort(near.astype(np.uint16), kind="stable")  # neighbours in memory are looked up together
        at, head = stop[which[occ]], start[which[occ]]
        n_taken = np.zeros(len(which), np.int64)
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        step = 0
        while len(occ):
            u = (mix(key[occ] + U64(0x9E3779B97F4A7C15 * (step + 1) % 2**64)) >> U64(11)).astype(np.float64) * 2.0**-53
            edge = np.searchsorted(drawn, at - 1 + u * (1 - 1e-9), "right")
            taken.append((occ, edge))
            n_taken[occ] += 1
            left = first[edge] > head
            occ, at, head = occ[left], first[edge[left]], head[left]
            step += 1
        stops = np.cumsum(n_taken)
        e = np.empty(stops[-1], np.int64)
        for s, (o, edge) in enumerate(taken):
            e[stops[o] - 1 - s] = edge
        ids = piece[e]
        ends = stops[np.cumsum(sizes) - 1]
        back = np.flatnonzero(ids < 0)
        if len(back):  # characters that go as bytes
            code = [MARK + w for w in words]
            owner = np.repeat(which, n_taken)
            parts = [[self.bytes[x] for x in code[owner[i]][first[e[i]] - start[owner[i]]].encode()] for i in back.tolist()]
            n = np.ones(len(ids), np.int64)
            n[back] = [len(p) for p in parts]
            ids = np.repeat(ids, n)
            ids[ids < 0] = [x for p in parts for x in p]
            ends = np.cumsum(n)[ends - 1]
        return np.split(ids, ends[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        """The text: the word start that encoding put in front is taken away."""
        return b"".join(map(self.text.__getitem__, ids.tolist()))[1:]


def lattice(model: str, sharpness: float) -> Lattice:
    """One lattice a Python worker, kept from task to task."""
    if (model, sharpness) not in task_caches:
        task_caches[model, sharpness] = Lattice(model, sharpness)
    return task_caches[model, sharpness]


@tidy
def _sampled(batches: Iterator[pa.RecordBatch], model: str, sharpness: float, seed: int) -> Iterator[pa.RecordBatch]:
    lat = lattice(model, sharpness)
    for batch in batches:
        for b in steps(batch, "text", SAMPLE_BYTES):
            texts = b.column("text").to_pylist()
            seeds = mix(b.column("row_key").to_numpy(zero_copy_only=False).view(U64) + U64(seed))
            ids = lat.sample(texts, seeds)
            back = [lat.decode(x) for x in ids]
            wide = [x.astype("<u4").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in wide], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()), pa.array([x == t.encode() for x, t in zip(back, texts, strict=True)], pa.bool_()), pa.array(wide, pa.binary())],
                ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless", "ids"],
            )


def encode(docs: DataFrame, model: str, sharpness: float = 1.0, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_pieces, ids_crc32, decoded_sha256 (of the text decoded again), lossless, ids (32-bit little-endian)."""
    rows = keyed(docs, id_col, text_col)
    rows = rows.select("doc_id", (F.col("k") if kind_of(rows) == "bigint" else F.xxhash64("k")).alias("row_key"), "text")
    return rows.mapInArrow(lambda it: _sampled(it, model, sharpness, seed), f"doc_id {kind_of(docs, id_col)}, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean, ids binary")


@tidy
def _decoded(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    lat = lattice(model, 1.0)
    for b in batches:
        texts = [lat.decode(np.frombuffer(x, "<u4")).decode() for x in b.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text from rows of doc_id and ids, as `encode` returns them."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _decoded(it, model), f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")
