"""Operator 4, SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Scores are log probabilities. The public 32,000-piece model lists merge ranks instead; `log_scores` reads a rank as a frequency rank under the
Zipf-Mandelbrot law, log p = -log(rank + 2.7) - log(sum over all pieces), so nothing is fitted to any corpus. Text is taken as it is (no normalisation); blanks become the marker U+2581 and one marker comes before a text. Of all
ways to write the text in pieces, the one of the largest sum of scores is taken; among equals the one whose last pieces begin first.
A character that no piece spells is written as its UTF-8 bytes; so is the marker where the text itself holds it, so that decoding is exact.

No piece holds a marker behind another character, so no best path can cross the place before a run of markers, nor a
character that no piece holds: the path of a text is that of its chunks, one after the other. Each batch's new chunks are walked through the
trie together, all starting places at once; paths of chunks are kept by worker up to a fixed number.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from statutegrid.functions.ship import map_arrow
from statutegrid.llm.common import column, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Offset of the Zipf-Mandelbrot law, and the grain of scores: sums of multiples of it are exact, so equal paths tie whatever the order of their pieces.
ZIPF_OFFSET, GRAIN = 2.7, 2.0**-16
#: Scores of unknown characters lie this far below the lowest piece.
UNKNOWN_PENALTY = 10.0
KEPT_CHUNKS = 200_000
CHUNKS_AT_ONCE = 4096
#: Longer chunks are walked one character after the other, in memory that a few bytes a character bound.
LONG_CHUNK = 50_000
LIST_AT_ONCE = 128


@dataclass
class DoubleArray:
    """Trie in two arrays: the child of state s by code c is base[s] + c if check holds s there; piece is its id or -1."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray

    @classmethod
    def build(cls, words: dict[tuple[int, ...], int], codes: int) -> DoubleArray:
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for word, id_ in words.items():
            at = 0
            for c in word:
                if (to := tree[at].get(c)) is None:
                    to = tree[at][c] = len(tree)
                    tree.append({})
                at = to
            ends[at] = id_
        size = len(tree) + 2 * codes + 2
        base, check, piece = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        taken = np.zeros(size, bool)
        taken[0] = True
        place, free, crowded = {0: 0}, 1, 1  # crowded: below it, families found little room
        for node, children in enumerate(tree):  # parents come before their children
            if not children:
                continue
            want = np.array(sorted(children))
            while taken[free]:
                free += 1
            start, windows = max(1, (free if len(want) == 1 else max(free, crowded)) - int(want[0])), 0
            window, low, high = (1 if len(want) == 1 else 32), int(want[0]), int(want[-1])
            while True:
                while start + high + 4096 >= len(base):
                    more = len(base)
                    base, piece = np.concatenate([base, np.zeros(more, np.int64)]), np.concatenate([piece, np.full(more, -1, np.int64)])
                    check, taken = np.concatenate([check, np.full(more, -1, np.int64)]), np.concatenate([taken, np.zeros(more, bool)])
                clash = taken[start + low : start + low + window].copy()
                for c in want[1:].tolist():
                    clash |= taken[start + c : start + c + window]
                if not clash.all():
                    start += int(clash.argmin())
                    break
                start, windows, window = start + window, windows + 1, 512
            if windows > 4:
                crowded = start
            base[place[node]] = start
            for c, child in children.items():
                at = start + c
                taken[at], check[at], place[child] = True, place[node], at
                piece[at] = ends.get(child, -1)
        # absent codes (0) and childless states must lead nowhere
        return cls(base, check, piece)


def log_scores(scores: list[float], kinds: list[str]) -> list[float]:
    """Log probabilities of the normal pieces by their rank, the highest score first, ties by id; other pieces' scores stay.

    Only scores that are whole numbers are ranks; others are log probabilities already and stay as they are.
    """
    order = sorted((i for i, k in enumerate(kinds) if k == "normal"), key=lambda i: (-scores[i], i))
    if not order or any(scores[i] != int(scores[i]) for i in order):
        return scores
    places = np.arange(1, len(order) + 1) + ZIPF_OFFSET
    logs = -np.log(places) - np.log((1 / places).sum())
    out = np.array(scores, np.float64)
    out[order] = np.round(logs / GRAIN) * GRAIN
    return out.tolist()


def _read(path: str) -> tuple[list[str], list[float], list[str]]:
    """Names, scores and kinds of a model file's pieces."""
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    kinds = ["byte" if m.is_byte(i) else "unknown" if m.is_unknown(i) else "control" if m.is_control(i) or m.is_unused(i) else "normal" for i in range(n)]
    return [m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)], kinds


@dataclass
class Pieces:
    """A unigram model: pieces with scores, byte pieces, and their trie over character codes."""

    names: list[str]
    scores: list[float]
    kinds: list[str]  # normal, byte, control, unknown
    trie: DoubleArray = field(init=False)

    def __post_init__(self) -> None:
        normal = [i for i, k in enumerate(self.kinds) if k == "normal" and self.names[i]]
        letters = sorted({c for i in normal for c in self.names[i]})
        self.code = {c: n for n, c in enumerate(letters, 1)}
        words: dict[tuple[int, ...], int] = {}
        for i in normal:
            words.setdefault(tuple(self.code[c] for c in self.names[i]), i)
        self.trie = DoubleArray.build(words, len(letters) + 1)
        self.longest = max(map(len, words), default=1)
        self.score = np.array(self.scores, np.float64)
        self.unknown_score = min((self.scores[i] for i in normal), default=0.0) - UNKNOWN_PENALTY
        self.byte_id = {int(self.names[i][1:-1], 16): i for i, k in enumerate(self.kinds) if k == "byte"}
        self.surface = [
            bytes([int(n[1:-1], 16)]) if k == "byte" else n.replace(MARK, " ").encode() if k == "normal" else b""
            for n, k in zip(self.names, self.kinds, strict=True)
        ]
        self.table = np.zeros(max(map(ord, letters), default=0) + 2, np.int64)
        for c, n in self.code.items():
            self.table[ord(c)] = n
        own = "".join(re.escape(c) for c in letters if c != MARK)
        inner = any(MARK in self.names[i].lstrip(MARK) for i in normal)
        known = f"[{own}{MARK}]+" if inner else f"{MARK}+[{own}]*|[{own}]+" if own else f"{MARK}+"
        self.cutter = re.compile(f"{known}|[^{own}{MARK}]+")
        self.paths: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("paths", "cutter")} | {"pattern": self.cutter.pattern}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"paths": {}, "cutter": re.compile(state["pattern"])}

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        """The model with the scores that its file lists."""
        return cls(*_read(path))

    @classmethod
    def unigram(cls, path: str = MODEL) -> Pieces:
        """The model with log probabilities for scores, also where its file lists ranks."""
        names, scores, kinds = _read(path)
        return cls(names, log_scores(scores, kinds), kinds)

    def spelled(self, text: str) -> list[int]:
        """A text in byte pieces; the unknown piece where the model has no byte pieces."""
        if len(self.byte_id) < 256:
            return [self.kinds.index("unknown")] * len(text)
        return [self.byte_id[b] for b in text.encode()]

    def best_paths(self, chunks: list[str]) -> list[bytes]:
        """Ids (int32) of each chunk's best path; chunks are not empty."""
        order = sorted(range(len(chunks)), key=lambda i: -len(chunks[i]))
        lengths = np.array([len(chunks[i]) for i in order])
        points = np.frombuffer("".join(chunks[i] for i in order).encode("utf-32-le"), np.uint32)
        codes = self.table[np.minimum(points, len(self.table) - 1)]
        n = len(codes)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        left = np.repeat(starts + lengths, lengths) - np.arange(n)  # characters from here to the chunk's end
        longest = min(self.longest, int(lengths[0]))
        ids = np.full((longest, n), -1, np.int64)
        state, at = np.zeros(n, np.int64), np.arange(n)
        for k in range(longest):
            keep = left[at] > k
            state, at = state[keep], at[keep]
            c = codes[at + k]
            to = self.trie.base[state] + c
            keep = (c > 0) & (self.trie.check[to] == state) & (to > 0)
            state, at = to[keep], at[keep]
            if not len(at):
                break
            ids[k, at] = self.trie.piece[state]
        gain = np.where(ids >= 0, self.score[ids], -np.inf)
        gain[0, ids[0] < 0] = self.unknown_score
        # nodes: one before each character and one at the end of each chunk
        first = starts + np.arange(len(lengths))
        best, back = np.full(n + len(lengths), -np.inf), np.zeros(n + len(lengths), np.int64)
        best[first] = 0.0
        for t in range(int(lengths[0])):
            alive = int(np.searchsorted(-lengths, -t, "left"))
            node, char = first[:alive] + t, starts[:alive] + t
            here = best[node]
            for k in range(longest):
                got = here + gain[k, char]
                use = got > -np.inf
                if not use.any():
                    continue
                to, got = node[use] + k + 1, got[use]
                better = got > best[to]
                best[to[better]] = got[better]
                back[to[better]] = k + 1
        steps, where = [], []
        at, who = first + lengths, np.arange(len(lengths))
        while len(who):
            size = back[at]
            char = at - size - who
            steps.append(ids[size - 1, char])
            where.append(who)
            at = at - size
            keep = at > first[who]
            at, who = at[keep], who[keep]
        path, who = np.concatenate(steps), np.concatenate(where)
        turn = np.lexsort((-np.arange(len(path)), who))
        path = path[turn].astype(np.int32)
        edges = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(lengths)))])
        raw, out = path.tobytes(), [b""] * len(chunks)
        for k, i in enumerate(order):
            out[i] = raw[4 * edges[k] : 4 * edges[k + 1]]
        for k in np.unique(np.searchsorted(edges, np.flatnonzero(path < 0), "right") - 1).tolist():
            full, at = [], 0
            for id_ in path[edges[k] : edges[k + 1]].tolist():
                size = 1 if id_ < 0 else len(self.names[id_])
                full += self.spelled(chunks[order[k]][at : at + size]) if id_ < 0 else [id_]
                at += size
            out[order[k]] = np.array(full, np.int32).tobytes()
        return out

    def long_path(self, chunk: str) -> bytes:
        """Ids (int32) of one chunk's best path, found as best_paths finds it, without the table of all starts and lengths."""
        base, check, piece = self.trie.base, self.trie.check, self.trie.piece
        n = len(chunk)
        best, ids, back = np.full(n + 1, -np.inf), np.full(n + 1, -1, np.int32), np.ones(n + 1, np.int32)
        best[0] = 0.0
        for i, letter in enumerate(chunk):
            here, state, single = best[i], 0, False
            for k in range(min(self.longest, n - i)):
                code = self.code.get(chunk[i + k] if k else letter, 0)
                to = int(base[state]) + code
                if not code or check[to] != state or to == 0:
                    break
                state = to
                if (id_ := int(piece[state])) >= 0:
                    single |= k == 0
                    if (got := here + self.score[id_]) > best[i + k + 1]:
                        best[i + k + 1], ids[i + k + 1], back[i + k + 1] = got, id_, k + 1
            if not single and (got := here + self.unknown_score) > best[i + 1]:
                best[i + 1], ids[i + 1], back[i + 1] = got, -1, 1
        path, at = [], n
        while at:
            path.append(self.spelled(chunk[at - 1 : at])[::-1] if ids[at] < 0 else [int(ids[at])])
            at -= int(back[at])
        return np.array([x for part in path for x in part][::-1], np.int32).tobytes()

    def _chunks(self, text: str) -> list[str]:
        """Chunks of a text; a marker of the text itself stands as a chunk of a NUL and the marker."""
        parts = text.split(MARK)
        found = self.cutter.findall((MARK + parts[0] if text else "").replace(" ", MARK))
        for part in parts[1:]:
            found.append("\0" + MARK)
            found += self.cutter.findall(part.replace(" ", MARK))
        return found

    def encode_batch(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids (int32) of each text; null and empty texts have none."""
        cut = [self._chunks(t or "") for t in texts]
        new = list(dict.fromkeys(c for chunks in cut for c in chunks if c not in self.paths))
        if len(self.paths) + len(new) > KEPT_CHUNKS:
            self.paths.clear()
            new = list(dict.fromkeys(c for chunks in cut for c in chunks))
        plain = []
        for c in new:
            if len(c) > LONG_CHUNK and c[0] in self.code:
                self.paths[c] = self.long_path(c)
            elif c == "\0" + MARK:
                self.paths[c] = np.array(self.spelled(MARK), np.int32).tobytes()
            elif c[0] not in self.code:
                self.paths[c] = np.array(self.spelled(c), np.int32).tobytes()
            else:
                plain.append(c)
        plain.sort(key=len)
        at = 0
        while at < len(plain):  # a long chunk is walked alone
            end = at + max(1, min(CHUNKS_AT_ONCE, 200_000 // len(plain[min(at + CHUNKS_AT_ONCE, len(plain)) - 1])))
            self.paths.update(zip(plain[at:end], self.best_paths(plain[at:end]), strict=True))
            at = end
        return [b"".join(map(self.paths.__getitem__, chunks)) for chunks in cut]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: bytes that are no UTF-8 become U+FFFD, the first blank goes."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, pieces: Pieces, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs, without the columns in drop, with pieces array<int>, n_pieces, n_byte_pieces and round_trip (decoding gives the text back).

    Null and empty texts have no pieces and come back as the empty text; input columns of these four names give way; rows are
    independent, repeated rows stay; no rows, no result.
    """
    own = ("pieces", "n_pieces", "n_byte_pieces", "round_trip")
    names = [c for c in docs.columns if c not in (*own, *drop)]
    byte_ids = sorted(pieces.byte_id.values())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_byte = np.zeros(len(pieces.names), bool)
        is_byte[byte_ids] = True
        for batch in batches:
            for s in range(0, batch.num_rows, LIST_AT_ONCE):
                part = batch.slice(s, LIST_AT_ONCE)
                texts = [t or "" for t in part.column("text").to_pylist()]
                found = [np.frombuffer(x, np.int32) for x in pieces.encode_batch(texts)]
                counts = np.array([len(x) for x in found], np.int64)
                flat = np.concatenate(found)
                edges = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                fallback = [int(is_byte[x].sum()) for x in found]
                same = [pieces.decode(x.tolist()) == t for x, t in zip(found, texts, strict=True)]
                columns = [pa.ListArray.from_arrays(edges, pa.array(flat)), pa.array(counts), pa.array(fallback, pa.int64()), pa.array(same)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *columns], [*names, *own])

    schema = docs.select(*map(column, names)).schema.add("pieces", T.ArrayType(T.IntegerType())).add("n_pieces", "long").add("n_byte_pieces", "long").add("round_trip", "boolean")
    return map_arrow(docs, encoded, schema)


def decode(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """rows with decoded, the text of their pieces; null pieces decode to null; a column decoded gives way."""
    names = [c for c in rows.columns if c != "decoded"]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, LIST_AT_ONCE):
                part = batch.slice(s, LIST_AT_ONCE)
                texts = [None if x is None else pieces.decode(x) for x in part.column("pieces").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(texts, pa.string())], [*names, "decoded"])

    return map_arrow(rows, decoded, rows.select(*map(column, names)).schema.add("decoded", "string"))


def op4_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, Pieces.unigram(), drop=("text",)).select("doc_id", "n_pieces", "n_byte_pieces", "round_trip", "pieces")


QUERIES = {"op4_unigram_pieces": op4_unigram_pieces}
ORACLES: dict[str, str] = {}
