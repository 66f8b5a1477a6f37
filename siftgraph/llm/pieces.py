"""SentencePiece encoding and decoding with N-best segmentations.

The vocabulary (pieces and scores of a .model file, never trained here) spans a
lattice over a text: a character stands for each place, a piece for an edge.
Spaces are written as U+2581 with one more in front; characters that no piece
holds, and U+2581 itself, fall back to byte pieces, so decoding gives back every
text exactly. A segmentation's score is the sum of its pieces' scores.

Forward Viterbi scores give each place the best score of a path from the start.
They are the exact heuristic of a backward A* search from the end: the n-th
complete path that the search takes from its queue is the n-th best.

No piece spans two units: texts are cut at spaces and lines where the vocabulary
allows it, and words of over LONG characters wherever no piece holds the two
characters around a place. So the lattice of a text is a chain of the units'
lattices. The forward pass gives each unit's best path and the loss of its second
best; only the N - 1 words with the least such losses can differ from the best
path of a text, so only these are searched backward, and the N best of the text
follow exactly from their alternatives. Words are kept, up to CACHE of them.

Ties go to the segmentation with fewer pieces, then to that found first by a
fixed order of edges. Null and empty texts have no pieces and decode to an empty
text; very long texts go whole, unit by unit, and memory is bounded by the longest
unit (some 300 bytes a character; only a run of letters that pieces join everywhere
is one); repeated rows each get their result; other columns are passed over.
"""

from __future__ import annotations

import heapq
import itertools
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, session

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 3
CACHE = 400_000
#: Characters of a word from which on it is cut into units.
LONG = 48
SPACE = "▁"


def read_model(path: str = MODEL) -> tuple[list[str], list[float]]:
    """Pieces and scores of a model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    return [model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)]


class Vocabulary:
    """Pieces, scores, and the exact N best segmentations by them."""

    def __init__(self, pieces: list[str], scores: list[float], nbest: int = NBEST):
        self.pieces, self.scores, self.nbest = pieces, scores, max(1, nbest)
        self.ids: dict[str, int] = {}
        self.byte = [0] * 256
        self.raw: list[bytes] = []
        for i, p in enumerate(pieces):
            if m := re.fullmatch(r"<0x([0-9A-F]{2})>", p):
                self.byte[int(m[1], 16)] = i
                self.raw.append(bytes([int(m[1], 16)]))
            elif re.fullmatch(r"<unk>|</?s>", p):
                self.raw.append(b"")
            else:
                self.ids.setdefault(p, i)
                self.raw.append(p.replace(SPACE, " ").encode())
        usual = [scores[i] for i in self.ids.values() if scores[i] > -1e8]
        self.byte_score = min(usual, default=0.0) - 10.0
        self.longest = max(map(len, self.ids), default=1)
        # Pieces with id and score, and what only begins one with None.
        self.table: dict[str, tuple[int, float, bytes] | None] = {p[:k]: None for p in self.ids for k in range(1, len(p))}
        self.table |= {p: (i, scores[i], i.to_bytes(4, "little")) for p, i in self.ids.items()}
        self.ends = {p[k:]: None for p in self.ids for k in range(1, len(p))} | {p: self.table[p] for p in self.ids}
        split = not any(b == SPACE != a for p in self.ids for a, b in zip(p, p[1:]))  # else a text is one word
        lines = not any("\n" in p for p in self.ids)
        self.word = re.compile((r" *[^ \n]+| +|\n" if lines else r"(?s) *[^ ]+| +") if split else "(?s).+")
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self._matrices()
        self.found: dict[str, list] = {}
        self.forget()

    def __reduce__(self):
        return _restored, (self.pieces, self.scores, self.nbest)

    def search(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of one lattice, best first."""
        size = len(text)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(-1e300, 0)] * size  # score, minus pieces
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
        for i in range(size):
            score, count = best[i]
            known = False
            for j in range(i + 1, min(size, i + self.longest) + 1):
                entry = self.table.get(text[i:j], False)
                if entry is False:
                    break
                if entry is not None:
                    k, own, _ = entry
                    known |= j == i + 1
                    into[j].append((i, own, (k,)))
                    if (new := (score + own, count - 1)) > best[j]:
                        best[j] = new
            if not known:
                raw = text[i].encode()
                own = self.byte_score * len(raw)
                into[i + 1].append((i, own, tuple(self.byte[b] for b in raw)))
                if (new := (score + own, count - len(raw))) > best[i + 1]:
                    best[i + 1] = new
        out: list[tuple[float, tuple[int, ...]]] = []
        if not size:
            return [(0.0, ())]
        # An entry takes one edge into a place, the edges of a place best first: minus score and pieces of the whole
        # path, order, place, edge, score and pieces behind the place, their ids.
        ranked: list = [None] * (size + 1)
        serial = 0

        def edges(at: int) -> list:
            if ranked[at] is None:
                ranked[at] = sorted([(-(best[i][0] + s), len(own) - best[i][1], i, s, own) for i, s, own in into[at]])
            return ranked[at]

        first = edges(size)[0]
        queue = [(first[0], first[1], 0, size, 0, 0.0, 0, ())]
        while queue:
            _, _, _, at, rank, done, number, ids = heapq.heappop(queue)
            here = ranked[at]
            _, _, i, score, own = here[rank]
            if rank + 1 < len(here):
                serial += 1
                heapq.heappush(queue, (here[rank + 1][0] - done, here[rank + 1][1] + number, serial, at, rank + 1, done, number, ids))
            done, number, ids = done + score, number + len(own), own + ids
            if not i:
                out.append((done, ids))
                if len(out) == n:
                    break
                continue
            first = edges(i)[0]
            serial += 1
            heapq.heappush(queue, (first[0] - done, first[1] + number, serial, i, 0, done, number, ids))
        return out

    def forward(self, text: str) -> tuple[float, bytes, float]:
        """Score and ids (four bytes each) of the best segmentation, and what the second best loses.

        The second best leaves the best path, seen from its end, at one place and
        is the best into there by another edge, so its loss is the least difference
        between the two best edges into a place of the best path.
        """
        size = len(text)
        best, loss, _, back = self._places(text)
        ids, at, least = [], size, float("inf")
        while at:
            if loss[at] < least:
                least = loss[at]
            at, own = back[at]
            ids.append(own)
        ids.reverse()
        return best[size], b"".join(ids), least

    def _places(self, text: str) -> tuple[list, list, list, list]:
        """For each place the best score, the loss of the second best edge, pieces, and the best edge."""
        best, loss, count, back = [0.0], [0.0], [0], [(0, b"")]
        get, longest, low = self.ends.get, self.longest, -1e300
        for j in range(1, len(text) + 1):
            i = j - 1
            entry = get(text[i:j], False)
            if entry:
                top, number, edge = best[i] + entry[1], count[i] + 1, (i, entry[2])
            else:
                raw = text[i].encode()
                top, number = best[i] + self.byte_score * len(raw), count[i] + len(raw)
                edge = i, b"".join([self.byte[b].to_bytes(4, "little") for b in raw])
            second, stop = low, j - longest
            while entry is not False and i > 0 and i > stop:
                i -= 1
                entry = get(text[i:j], False)
                if entry:
                    new = best[i] + entry[1]
                    if new > top:
                        second, top, number, edge = top, new, count[i] + 1, (i, entry[2])
                    elif new > second:
                        second = new
                        if new == top and count[i] < number:
                            number, edge = count[i] + 1, (i, entry[2])
            best.append(top)
            loss.append(top - second)
            count.append(number)
            back.append(edge)
        return best, loss, count, back

    def _matrices(self) -> None:
        """The pieces read backwards as a trie: classes of characters, moves in a hash table, pieces of states."""
        letters = sorted({c for p in self.ids for c in p})
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        state = {"": 0} | {e: i for i, e in enumerate(sorted(self.ends, key=len), 1)}
        self.width = len(letters) + 1
        self.of_state = np.full(len(state), -1, np.int32)
        self.of_state[[state[p] for p in self.ids]] = list(self.ids.values())
        keys = np.array([state[e[1:]] * self.width + self.classes[ord(e[0])] for e in state if e], np.int64)
        goals = np.array([i for e, i in state.items() if e], np.int32)
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.slots, self.goals = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # all that find their slot free take it, one for each slot
            free = self.slots[at[left]] < 0
            _, first = np.unique(at[left[free]], return_index=True)
            won = left[free][first]
            self.slots[at[won]], self.goals[at[won]] = keys[won], goals[won]
            left = np.setdiff1d(left, won)
            at[left] = np.where(self.slots[at[left]] >= 0, at[left] + 1, at[left]) & ((1 << bits) - 1)
        self.score_of = np.array([*self.scores, 0.0])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _moves(self, keys: np.ndarray) -> np.ndarray:
        """The states that keys (state, class) lead to, or -1."""
        at = self._slot(keys)
        found = self.slots[at]
        out = np.where(found == keys, self.goals[at], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            found = self.slots[at[left]]
            out[left] = np.where(found == keys[left], self.goals[at[left]], -1)
            left = left[(found != keys[left]) & (found >= 0)]
        return out

    def forward_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As forward, of short words, the longest first, at once: scores, losses, numbers of ids, all ids.

        It goes place by place, and for each place over the pieces that end there by length.
        """
        sizes = np.array([len(w) for w in words])
        n, width = len(words), int(sizes[0])
        codes = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        grid = np.zeros((width, n), np.uint32)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for j in range(width):
            k = int(np.searchsorted(-sizes, -j, "left"))  # words longer than j come first
            grid[j, :k] = codes[starts[:k] + j]
        classes = self.classes[grid]
        best, count = np.zeros((width + 1, n)), np.zeros((width + 1, n), np.int32)
        loss, step, piece = np.full((width + 1, n), np.inf), np.zeros((width + 1, n), np.int8), np.zeros((width + 1, n), np.int64)
        for j in range(1, width + 1):
            k = int(np.searchsorted(-sizes, -j, "right"))
            own = classes[j - 1, :k]
            state = self._moves(own.astype(np.int64))
            single = np.where(state >= 0, self.of_state[state], -1)
            raw = grid[j - 1, :k]
            bytes_ = 1 + (raw >= 0x80).astype(np.int32) + (raw >= 0x800) + (raw >= 0x10000)
            plain = single >= 0
            top = best[j - 1, :k] + np.where(plain, self.score_of[single], self.byte_score * bytes_)
            number = count[j - 1, :k] + np.where(plain, 1, bytes_)
            second = np.full(k, -1e300)
            length, edge = np.ones(k, np.int8), np.where(plain, single.astype(np.int64), -1 - raw.astype(np.int64))
            live = np.flatnonzero(state >= 0)
            state = state[live]
            for size in range(2, min(j, self.longest) + 1):
                if not len(live):
                    break
                state = self._moves(state.astype(np.int64) * self.width + classes[j - size, live])
                going = state >= 0
                live, state = live[going], state[going]
                ids = self.of_state[state]
                hit = ids >= 0
                at, ids = live[hit], ids[hit]
                new, parts = best[j - size, at] + self.score_of[ids], count[j - size, at] + 1
                old, older = top[at], second[at]
                wins = new > old
                ties = (new == old) & (parts <= number[at])  # the longer piece of equals
                second[at] = np.where(wins, old, np.maximum(older, new))
                take = wins | ties
                at, ids = at[take], ids[take]
                top[at], number[at], length[at], edge[at] = new[take], parts[take], size, ids
            best[j, :k], count[j, :k], loss[j, :k], step[j, :k], piece[j, :k] = top, number, top - second, length, edge
        columns = np.arange(n)
        score = best[sizes, columns]
        least, at, path = np.full(n, np.inf), sizes.copy(), []
        while (live := at > 0).any():
            least = np.where(live, np.minimum(least, loss[at, columns]), least)
            path.append(np.where(live, piece[at, columns], np.iinfo(np.int64).max))
            at = at - np.where(live, step[at, columns], 0)
        least[least > 1e299] = np.inf
        path = np.stack(path[::-1], 1)
        there = path != np.iinfo(np.int64).max
        flat, ends = path[there], np.cumsum(there.sum(1))
        if (flat < 0).any():  # characters as bytes
            pieces = [[i] if i >= 0 else [self.byte[b] for b in chr(-1 - i).encode()] for i in flat.tolist()]
            longer = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
            flat, ends = np.array(list(itertools.chain.from_iterable(pieces))), longer[ends]
        return score, least, np.diff(ends, prepend=0), flat.astype(np.int32)

    def forget(self) -> None:
        """Frees what was kept of words; a worker that decodes has no need of it."""
        mark = [self.byte[b] for b in SPACE.encode()]
        self.index: dict[str | None, int] = {None: 0}  # None stands for a U+2581 of a text itself
        self.best, self.loss = np.array([self.byte_score * len(mark)]), np.array([np.inf])
        self.size, self.start, self.pool = np.array([len(mark)]), np.array([0]), np.array(mark, np.int32)
        self.found = {}

    def learn(self, words: set[str | None]) -> list[str]:
        """Makes sure that all of words are kept; returns the new ones that are too long to stay."""
        if len(self.index) >= CACHE or len(self.pool) >= 16 * CACHE:
            self.forget()
        new = words.difference(self.index)
        if not new:
            return []
        short = sorted([w for w in new if len(w) <= LONG], key=len, reverse=True)
        long = [w for w in new if len(w) > LONG] if len(short) < len(new) else []
        parts = [self.forward_many(short[i : i + (1 << 14)]) for i in range(0, len(short), 1 << 14)]
        for w in long:
            score, ids, loss = self.forward(w.replace(" ", SPACE))
            parts.append((np.array([score]), np.array([loss]), np.array([len(ids) // 4]), np.frombuffer(ids, "<i4")))
        self.index |= zip(short + long, range(len(self.best), len(self.best) + len(new)))
        best, loss, size, pool = (np.concatenate(x) for x in zip(*parts))
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
        self.best, self.loss = np.concatenate([self.best, best]), np.concatenate([self.loss, loss])
        self.size, self.pool = np.concatenate([self.size, size]), np.concatenate([self.pool, pool])
        return long

    def alternatives(self, text: str) -> list[tuple[float, tuple[int, ...]]]:
        """(loss, ids) of the N best segmentations of a word, by the backward search; the forward pass's best is the first."""
        found = self.found.get(text)
        if found is None:
            if len(self.found) >= CACHE // 4:
                self.found.clear()
            paths = self.search(text.replace(" ", SPACE), self.nbest)
            k = self.index[text]
            best = tuple(self.pool[self.start[k] : self.start[k] + self.size[k]].tolist())
            found = [(0.0, best), *[(paths[0][0] - s, ids) for s, ids in paths if ids != best]][: self.nbest]
            if len(text) <= 64:
                self.found[text] = found
        return found

    def _combined(self, words: list[str | None], losses: np.ndarray, sizes: np.ndarray) -> list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]:
        """The N least losses over a chain of words, each with the slices (start, stop, ids) of the best ids that change."""
        few = min(self.nbest - 1, len(words))
        if not few:
            return [(0.0, [])]
        # Only the words with the least losses can differ; the first of equal losses stay.
        near = np.flatnonzero(losses <= np.partition(losses, few - 1)[few - 1])
        near = sorted(near[np.argsort(losses[near], kind="stable")][:few].tolist())
        near = [u for u in near if losses[u] < np.inf]
        choices = [self.alternatives(words[u]) for u in near]
        combos = sorted(itertools.product(*(range(len(c)) for c in choices)), key=lambda c: sum([x[k][0] for x, k in zip(choices, c)]))[: self.nbest]
        spans = [(a, a + int(sizes[u])) for u in near for a in [int(sizes[:u].sum())]]
        return [(sum([x[k][0] for x, k in zip(choices, c)]), [(*ab, x[k][1]) for ab, x, k in zip(spans, choices, c) if k]) for c in combos]

    def units(self, text: str) -> list[str]:
        """The units of a text without U+2581."""
        words = self.word.findall(text)
        if not words or max(map(len, words)) <= LONG:
            return words
        out = []
        for w in words:
            if len(w) <= LONG:
                out.append(w)
                continue
            marked, start = w.replace(" ", SPACE), 0
            for i in range(1, len(w)):
                if marked[i - 1 : i + 1] not in self.pairs:
                    out.append(w[start:i])
                    start = i
            out.append(w[start:])
        return out

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]]:
        """Offsets and ids of the texts' best segmentations, and for each text's N best the score and the slices (start, stop, ids) of the best that it replaces."""
        chains: list[list[str | None]] = []
        for t in texts:
            first, *more = t.split(SPACE)
            words = self.units(" " + first) if t else []
            for part in more:
                words += [None, *self.units(part)]
            chains.append(words)
        long = self.learn(set().union(*chains))
        at = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(chains)), np.int64)
        sizes, starts, losses = self.size[at], self.start[at], self.loss[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
        cuts = np.concatenate([[0], np.cumsum([len(c) for c in chains])])
        nbest = []
        for words, a, b in zip(chains, cuts.tolist(), cuts[1:].tolist()):
            score = float(self.best[at[a:b]].sum())
            nbest.append([(score - loss, changes) for loss, changes in self._combined(words, losses[a:b], sizes[a:b])] if words else [])
        for w in long:
            del self.index[w]
        return ends[cuts], ids, nbest

    def encode(self, text: str) -> tuple[list[int], list]:
        """The best ids and the N best of one text."""
        _, ids, nbest = self.encode_many([text])
        return ids.tolist(), nbest[0]

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids])[1:].decode("utf-8", "replace")


def _restored(pieces: list[str], scores: list[float], nbest: int) -> Vocabulary:
    """A worker process builds a vocabulary once and keeps it, with what it has searched, from task to task."""
    holder = sys.modules.setdefault("_siftgraph_worker", types.ModuleType("_siftgraph_worker"))
    key = nbest, zlib.crc32("\0".join(pieces).encode()), zlib.crc32(np.array(scores).tobytes())
    if getattr(holder, "key", None) != key:
        holder.vocabulary, holder.key = Vocabulary(pieces, scores, nbest), key
    return holder.vocabulary


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, text, ids and nbest (score, and the slices of ids that it replaces) of each row."""
    session(docs)
    change = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("ids", pa.list_(pa.int32()))])
    best = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(change))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, flat, found = vocabulary.encode_many([t or "" for t in batch.column("text").to_pylist()])
            nbest = [[{"score": s, "changes": [{"start": a, "stop": b, "ids": list(c)} for a, b, c in changes]} for s, changes in x] for x in found]
            yield batch_of(doc_id=batch.column("doc_id"), text=batch.column("text"), ids=pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)), nbest=pa.array(nbest, best))

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, ids array<int>, nbest array<struct<score: double, changes: array<struct<start: int, stop: int, ids: array<int>>>>>")


def decode(encoded: DataFrame, vocabulary: Vocabulary, others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns others, and decoded, the text of ids, of each row."""
    session(encoded)
    columns = ("doc_id", *others)
    kinds = {f.name: f.dataType.simpleString() for f in encoded.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary.forget()
        for batch in batches:
            ids = batch.column("ids")
            rows = [x.values.to_numpy().tolist() if x.is_valid else [] for x in ids]
            yield batch_of(**{c: batch.column(c) for c in columns}, decoded=pa.array([vocabulary.decode(x) for x in rows], pa.string()))

    return encoded.select(*dict.fromkeys((*columns, "ids"))).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", decoded string")


def coded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids, n_pieces, nbest_scores and whether decoding the ids gives the text back, of each row.

    As encode and decode in turn, but a task needs one worker process with a vocabulary, not two.
    """
    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            offsets, flat, found = vocabulary.encode_many(texts)
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            back = [vocabulary.decode(x.values.to_numpy().tolist()) == t for x, t in zip(ids, texts)]
            yield batch_of(doc_id=batch.column("doc_id"), ids=ids, n_pieces=np.diff(offsets).astype(np.int64), nbest_scores=pa.array([[s for s, _ in x] for x in found], pa.list_(pa.float64())), round_trip=pa.array(back, pa.bool_()))

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, n_pieces long, nbest_scores array<double>, round_trip boolean")


def digest(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_pieces, ids_sha256, nbest_scores and whether decoding gives the text back, of each row."""
    encoded = encode(docs, vocabulary)
    joined = F.sha2(F.array_join("ids", " "), 256)
    encoded = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), joined.alias("ids_sha256"), F.transform("nbest", lambda x: x["score"]).alias("nbest_scores"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    back = decode(encoded, vocabulary, ("n_pieces", "ids_sha256", "nbest_scores", "text_sha256"))
    return back.select("doc_id", "n_pieces", "ids_sha256", "nbest_scores", "text_sha256", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))
