"""Suffix-array removal of repeated byte strings, exact over a whole corpus.

A suffix array orders the suffixes of a text; strings of L bytes that repeat
stand next to each other in it. The array of a whole corpus would not fit one
machine, so the corpus is first cut down, without loss, to the passages whose
windows can repeat at all, and these are dealt out so that equal windows meet:

1.  Every window of L bytes owns an anchor: its smallest hashed K-gram. Equal
    windows own equal anchors, so a window whose anchor is unique in the corpus
    repeats nowhere. Consecutive windows with one anchor are a run; a row for
    each run (anchor hash, hash of the bytes under the run, document, start) is
    dealt out by the anchor; anchors that a sample shows in very many documents
    are dealt out by the bytes' hash as well.
2.  Runs over equal bytes collapse to their first occurrence: later ones are
    repeats as a whole. Their hashes only propose that. Runs of one Arrow batch are
    compared by their bytes before the shuffle, which keeps very common passages
    small; every other one names the run before it among its equals, neighbouring runs
    are joined to passages, and the bytes of the passage named are sent to the
    document and compared there. Anchors that occur over different bytes leave one
    piece for each distinct run and half of it; only windows of a piece can repeat
    in part.
3.  The pieces' bytes are dealt out by the anchor with the bytes on its left or
    on its right (half of what a window holds beside the anchor), whichever all
    the windows contain, so a common line with different surroundings splits.
    Keys of anchors with over HOT runs take half of the bytes left beside them as
    well, and so on, up to whole windows; a task does the same by itself where the
    pieces of a key are over MOST symbols, which bounds its suffix arrays. Equal
    pieces collapse to the first, by their bytes. Each task concatenates the others
    and builds their suffix array; windows that are equal stand together there, and
    all but the first occurrence are repeats. The bytes of the key, which all windows
    of a piece contain, are one symbol in it.
4.  The repeats' spans are joined to the documents and cut out.

The suffix array is built by linear grouping: suffixes start in groups by their
first symbol; groups are processed in descending order; each member finds the
previous position of a smaller group by following previous-smaller pointers, and
parents found so are split off upwards by their number of children. Afterwards
the groups hold suffixes of equal Lyndon prefix, and one pass from the smallest
suffix emits every group's order. No names are given anew and no recursion runs.

Defined results: null texts are empty; a null doc_id orders after all others by
a hash of its text; rows alike in doc_id and text are one document (repeats of a
row do not count against each other, and each gets the same result); texts under a
reused doc_id are documents of their own, ordered by a hash; texts shorter than L
bytes keep everything; very long texts go in overlapping slices; other columns are
passed over.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, checkpoint, each_text, longs, session, shuffle_partitions, text_bytes

#: Bytes of a repeated string, of an anchor, and of an anchor's side in a key.
LENGTH, GRAM = 100, 32
#: Runs of an anchor over different bytes from which on its keys are made longer before they are dealt out.
HOT = 8000
#: Documents that are sampled for anchors of very many documents, and how many of them make an anchor common.
SAMPLE, COMMON = 4096, 20
#: Hot anchors up to which their sizes are broadcast (some MB); beyond, they are joined.
FEW = 100_000
#: Bytes that the anchor step and a suffix array take at once; longer texts go in overlapping slices. Of a slice some 100 times its bytes are held.
SLICE, PART = 1 << 17, 1 << 17
#: Symbols that the suffix array of one key takes at most; a task makes the keys of more of them longer by itself.
MOST = 1 << 17
_SPAN, _WHOLE, _DEALT = 16, 1 << 15, 1 << 14


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of a sequence of small non-negative integers, by linear grouping."""
    n = len(text)
    if not n:
        return []
    symbols = sorted(set(text))
    name = {c: g for g, c in enumerate(symbols)}
    group = [name[c] for c in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(symbols) - 1))  # the next smaller group
    above = list(range(1, len(symbols) + 1))
    above[-1] = -1
    done = bytearray(n)
    previous = [-1] * n
    g = len(symbols) - 1
    while g >= 0:
        live = [i for i in members[g] if group[i] == g]
        members[g] = live
        counted: dict[int, int] = {}
        for i in live:
            p = i - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[i] = p
            done[i] = 1
            counted[p] = counted.get(p, 0) + 1
        counted.pop(-1, None)
        if counted:
            split: dict[tuple[int, int], list[int]] = {}
            for p, k in counted.items():
                split.setdefault((group[p], k), []).append(p)
            for old, k in sorted(split, reverse=True):  # each goes right above what is left, so the largest count first
                new = len(members)
                moved = split[old, k]
                for p in moved:
                    group[p] = new
                members.append(moved)
                up = above[old]
                above.append(up)
                below.append(old)
                above[old] = new
                if up >= 0:
                    below[up] = new
        g = below[g]
    place = [0] * len(members)
    g, at = 0, 0
    while g >= 0:  # group 0 stays the smallest: new groups go above
        place[g] = at
        at += len(members[g])
        g = above[g]
    out = [-1] * n
    put = bytearray(n)
    j = n - 1
    for i in range(-1, n):
        if i >= 0:
            j = out[i] - 1
        while j >= 0 and not put[j]:
            g = group[j]
            out[place[g]] = j
            place[g] += 1
            put[j] = 1
            j = previous[j]
    return out


def repeats(pieces: list[np.ndarray], length: int) -> np.ndarray:
    """(first, later) pairs of window starts in the joined pieces: each later window equals an earlier listed first one.

    Pieces are arrays of positive integers. Positions count over the pieces with
    one separator behind each. Pieces come in order of occurrence, so the first
    of equal windows is the smallest position.
    """
    sizes = np.array([len(p) for p in pieces])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    data = np.zeros(int((sizes + 1).sum()), np.int32)
    valid = np.zeros(len(data), bool)
    for s, p in zip(starts, pieces):
        data[s : s + len(p)] = p
        valid[s : s + max(0, len(p) - length + 1)] = True
    order = np.array(suffix_array(data.tolist()), np.int64)
    order = order[valid[order]]
    if len(order) < 2:
        return np.zeros((0, 2), np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    left, right = order[:-1], order[1:]
    same = np.concatenate([(windows[left[i : i + 20000]] == windows[right[i : i + 20000]]).all(1) for i in range(0, len(left), 20000)])
    heads = np.concatenate([[0], np.flatnonzero(~same) + 1])
    first = np.minimum.reduceat(order, heads)
    first = np.repeat(first, np.diff(np.concatenate([heads, [len(order)]])))
    late = order != first
    return np.stack([first[late], order[late]], 1)


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, 256, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class _Hashes:
    """Rolling hashes of all substrings of one buffer, from prefix sums of symbol * base ** place, modulo 2 ** 64."""

    def __init__(self, data: np.ndarray, which: int, powers: dict):
        n = len(data)
        if which not in powers or len(powers[which][0]) < n + 1:
            size = max(n + 1, SLICE + 4 * LENGTH)
            powers[which] = (_powers(_BASE[which], size), _powers(pow(_BASE[which], -1, 2**64), size), _table(which))
        up, self.down, table = powers[which]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * up[:n], out=self.sums[1:], dtype=np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _owners(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of width grams the place of its smallest one, the last of equals."""
    n = len(grams)
    bits = np.uint64(22)  # places within a slice
    low = ((grams >> bits) << bits) | (np.uint64((1 << 22) - 1) - np.arange(n, dtype=np.uint64))
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    return ((1 << 22) - 1 - (low & np.uint64((1 << 22) - 1)).astype(np.int64))


def _runs(data: np.ndarray, off: np.ndarray, ids: np.ndarray, powers: dict, length: int, gram: int) -> np.ndarray:
    """Rows h, r, doc, span, place of the runs of a buffer of documents; span is start << 16 | windows."""
    width = length - gram + 1
    if len(data) < length:
        return np.zeros((0, 5), np.int64)
    one, two = _Hashes(data, 0, powers), _Hashes(data, 1, powers)
    at = np.arange(len(data) - gram + 1)
    grams = one.of(at, at + gram)
    owner = _owners(grams, width)
    sizes = np.diff(off)
    doc = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - length + 1))
    skip = np.cumsum(np.maximum(0, sizes - length + 1)) - np.maximum(0, sizes - length + 1)
    start = np.arange(len(doc)) - skip[doc] + off[doc]  # all windows within one document
    if not len(start):
        return np.zeros((0, 5), np.int64)
    own = owner[start]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])]))
    windows = np.diff(np.concatenate([new, [len(start)]]))
    s, d, o = start[new], doc[new], own[new]
    out = np.empty((len(new), 5), np.int64)
    out[:, 0] = grams[o].view(np.int64)
    out[:, 1] = _mixed(two.of(s, s + windows - 1 + length) + (o - s).astype(np.uint64)).view(np.int64)
    out[:, 2] = ids[d]
    out[:, 3] = ((s - off[d]) << _SPAN) | windows
    out[:, 4] = s
    return out


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc").to_numpy(zero_copy_only=False).astype(np.int64)


def _batch_runs(batch: pa.RecordBatch, powers: dict, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the runs of a batch's texts, places counted in the batch's bytes, and these bytes."""
    ids = _ids(batch)
    data, off = text_bytes(batch.column("text"))
    rows, i, n = [], 0, len(ids)
    while i < n:
        if off[i + 1] - off[i] > SLICE:  # one long text, by slices that share length - 1 bytes
            for a in range(int(off[i]), int(off[i + 1]) - length + 1, SLICE):
                part = _runs(data[a : min(a + SLICE + length - 1, off[i + 1])], np.array([0, min(SLICE + length - 1, off[i + 1] - a)]), ids[i : i + 1], powers, length, gram)
                part[:, 3] += (a - int(off[i])) << _SPAN
                part[:, 4] += a
                rows.append(part)
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE, "right")) - 1)
        j = min(j, n)
        part = _runs(data[off[i] : off[j]], off[i : j + 1] - off[i], ids[i:j], powers, length, gram)
        part[:, 4] += off[i]
        rows.append(part)
        i = j
    return np.concatenate(rows) if rows else np.zeros((0, 5), np.int64), data


def _map_runs(length: int, gram: int, common: np.ndarray):
    """common: sorted anchors that are dealt out by the bytes' hash too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: dict = {}
        for batch in batches:
            rows, data = _batch_runs(batch, powers, length, gram)
            if not len(rows):
                continue
            rows = _collapsed(rows, data, length)
            if len(common):
                at = np.minimum(np.searchsorted(common, rows[:, 0]), len(common) - 1)
                at = (common[at] == rows[:, 0]) & ((rows[:, 3] & _WHOLE) == 0)
                rows[at, 0] ^= _mixed(rows[at, 1].view(np.uint64)).view(np.int64)
                rows[at, 3] |= _DEALT
            yield _columns(rows)

    return run


def _anchors(length: int, gram: int):
    """The distinct anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: dict = {}
        for batch in batches:
            rows, _ = _batch_runs(batch, powers, length, gram)
            yield batch_of(h=np.unique(rows[:, [2, 0]], axis=0)[:, 1].copy())

    return run


def _columns(rows: np.ndarray) -> pa.RecordBatch:
    return batch_of(h=rows[:, 0].copy(), r=rows[:, 1].copy(), doc=rows[:, 2].copy(), span=rows[:, 3].copy())


def _equal(data: np.ndarray, one: np.ndarray, two: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether so many bytes at two places are the same."""
    out = np.zeros(len(one), bool)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        step = np.arange(size)
        for i in range(0, len(at), 8192):
            k = at[i : i + 8192]
            out[k] = (data[one[k, None] + step] == data[two[k, None] + step]).all(1)
    return out


def _collapsed(rows: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """Marks all but the first of equal runs as whole repeats, spread over the tasks by document; their bytes are compared."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    same = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1])
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(rows)), 0))
    again = (rows[:, 2] == rows[first, 2]) & (rows[:, 3] == rows[first, 3])  # a row of documents that repeats
    late = np.flatnonzero(~again)
    differ = late[~_equal(data, rows[late, 4], rows[first[late], 4], (rows[late, 3] & (_WHOLE - 1)) - 1 + length)]
    rows[differ, 1] = _mixed(rows[differ, 4].view(np.uint64)).view(np.int64)  # a collision: a run of its own
    late = np.zeros(len(rows), bool)
    late[~again] = True
    late[differ] = False
    keep = late | (first == np.arange(len(rows)))
    keep[differ] = True
    out, late = rows[keep].copy(), late[keep]
    out[late, 0] = _mixed(out[late, 2].view(np.uint64) + out[late, 3].view(np.uint64)).view(np.int64)
    out[late, 3] |= _WHOLE
    return out


_FOUND = "doc long, start long, windows long, h long, other long, at long"


def _reduce_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h, r, doc, span to those of _FOUND: h is null for whole repeats, which name the run before them (other, at) unless their bytes are known."""
    held = None  # of the last anchor: its last row, and whether its first run was told
    for batch in batches:
        rows = np.stack([longs(batch, c) for c in ("h", "r", "doc", "span")], 1)
        whole = (rows[:, 3] & _WHOLE) != 0
        spans, rows = rows[whole], rows[~whole]
        told = named = np.zeros((0, 4), np.int64)
        before = np.zeros((0, 4), np.int64)
        if len(rows):
            lead = 0
            if held is not None:
                rows = np.concatenate([held[0][None], rows])
                lead = 1
            new_h = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
            new_r = new_h | np.concatenate([[True], rows[1:, 1] != rows[:-1, 1]])
            again = np.concatenate([[False], (rows[1:, 2] == rows[:-1, 2]) & (rows[1:, 3] == rows[:-1, 3])])
            late = np.flatnonzero(~new_r & ~again)
            named, before = rows[late], rows[late - 1]
            head = np.flatnonzero(new_h)
            of = np.cumsum(new_h) - 1
            many = (np.add.reduceat(new_r.astype(np.int64), head) > 1)[of]
            if lead and held[1]:  # the held anchor had many runs already
                many = many | (of == 0)
            dealt = (rows[:, 3] & _DEALT) != 0  # a part of an anchor's runs: each is told
            tell = new_r & (many | dealt)
            if lead and held[1]:
                tell[0] = False
            told = rows[tell].copy()
            mixed = (told[:, 3] & _DEALT) != 0
            told[mixed, 0] ^= _mixed(told[mixed, 1].view(np.uint64)).view(np.int64)
            held = (rows[-1], bool(many[-1] or dealt[-1]))
        k, n, m = len(spans), len(named), len(told)
        if k + n + m:
            all_rows = np.concatenate([spans, named, told])
            place = np.arange(k + n + m)
            asked = (place >= k) & (place < k + n)
            other, at = np.zeros(k + n + m, np.int64), np.zeros(k + n + m, np.int64)
            other[asked], at[asked] = before[:, 2], before[:, 3] >> _SPAN
            yield batch_of(
                doc=all_rows[:, 2].copy(),
                start=all_rows[:, 3] >> _SPAN,
                windows=all_rows[:, 3] & (_DEALT - 1),
                h=pa.array(np.where(place < k + n, 0, all_rows[:, 0]), mask=place < k + n),
                other=pa.array(other, mask=~asked),
                at=pa.array(at, mask=~asked),
            )


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, start, windows, other, at) sorted by doc, start: those that go on in both documents are joined."""
    for batch in batches:
        rows = np.stack([longs(batch, c) for c in ("doc", "start", "windows", "other", "at")], 1)
        if not len(rows):
            continue
        a, b = rows[:-1], rows[1:]
        on = (a[:, 0] == b[:, 0]) & (a[:, 3] == b[:, 3]) & (a[:, 1] + a[:, 2] == b[:, 1]) & (a[:, 4] + a[:, 2] == b[:, 4])
        head = np.flatnonzero(np.concatenate([[True], ~on]))
        out = rows[head]
        yield batch_of(doc=out[:, 0].copy(), start=out[:, 1].copy(), windows=np.add.reduceat(rows[:, 2], head), other=out[:, 3].copy(), at=out[:, 4].copy())


def _sent(length: int):
    """Documents and the passages asked of them to the passages' bytes, for the documents that asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, asked in zip(each_text(batch.column("text")), batch.column("asked")):
                rows += [(x["doc"], x["start"], x["windows"], text[x["at"] : x["at"] + x["windows"] - 1 + length]) for x in asked.as_py()]
            if rows:
                doc, start, windows, piece = zip(*rows)
                yield batch_of(doc=np.array(doc, np.int64), start=np.array(start, np.int64), windows=np.array(windows, np.int64), piece=pa.array(piece, pa.binary()))

    return run


def _pieces(length: int, gram: int):
    """Documents with their unsettled runs to pieces: key, doc, start, how many bytes lie left of the key's, these, and those beside them."""
    half = (length - gram) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: dict = {}
        for batch in batches:
            ids, rows = _ids(batch), []
            for doc, text, runs in zip(ids.tolist(), each_text(batch.column("text")), batch.column("runs")):
                for x in runs.as_py():
                    s, k = x["start"], x["windows"]
                    piece = text[s : s + k - 1 + length]
                    if len(piece) < length:
                        continue
                    data = np.frombuffer(piece, np.uint8)
                    hashes = _Hashes(data, 0, powers)
                    at = np.arange(len(piece) - gram + 1)
                    found = np.flatnonzero(hashes.of(at, at + gram).view(np.int64) == x["h"])
                    a = int(found[found <= length - gram][-1]) if len(found) else 0
                    cut = min(max(a - half + 1, 0), k)  # windows before it contain the half on the left
                    own = []
                    for lo, hi, left, right in ((0, cut, a - half, a + gram), (cut, k, a, a + gram + half)):
                        if hi > lo:
                            key = _key(piece[left:right])
                            own.append((key, doc, s + lo, left - lo, piece[left:right], piece[lo:left] + piece[right : hi - 1 + length]))
                    rows += _longer_keys(own, length, x["times"]) if x["times"] else own
            if rows:
                keys, docs, starts, lefts, centers, parts = zip(*rows)
                yield batch_of(key=np.frombuffer(b"".join(keys), np.int64), doc=np.array(docs, np.int64), start=np.array(starts, np.int64), left=np.array(lefts, np.int64), center=pa.array(centers, pa.binary()), piece=pa.array(parts, pa.binary()))

    return run


def _longer_keys(rows: list[tuple], length: int, times: int) -> list[tuple]:
    """Pieces (key, doc, start, left, center, bytes beside) under keys that hold half of the bytes left beside them more, so many times.

    The center is the key's bytes. A window holds `length - len(center)` bytes beside
    it; it holds half of them on the left, or more than the other half on the right,
    so it has one longer key. In the end keys hold whole windows.
    """
    for _ in range(times):
        out = []
        for key, doc, start, left, center, piece in rows:
            core = len(center)
            half, windows = (length - core + 1) // 2, len(piece) + core - length + 1
            if core >= length:
                out.append((key, doc, start, left, center, piece))
                continue
            right = length - core - half + 1  # what a window without the left half holds on the right at least
            cut = min(max(left - half + 1, 0), windows)  # windows before it hold the half on the left
            if cut > 0:
                longer = piece[left - half : left] + center
                out.append((_key(longer), doc, start, left - half, longer, piece[: left - half] + piece[left : cut - 1 + length - core]))
            if windows > cut:
                longer = center + piece[left : left + right]
                out.append((_key(longer), doc, start + cut, left - cut, longer, piece[cut:left] + piece[left + right : windows - 1 + length - core]))
        rows = out
    return rows


def _key(center: bytes) -> bytes:
    return hashlib.blake2b(center, digest_size=8).digest()


def _sorted_pieces(length: int):
    """Pieces sorted by key, doc, start to spans of repeats: doc, start, windows.

    The center, which all windows of a piece hold, stands for one symbol, its own,
    so the suffix array takes only what is beside it.
    """

    def settle(core: int, rows: list) -> pa.RecordBatch | None:
        names: dict = {}
        rows.sort(key=lambda x: (x[1], x[2]))
        pieces = []
        for _, _, _, left, center, piece in rows:
            piece = np.frombuffer(piece, np.uint8).astype(np.int32) + 1
            pieces.append(np.concatenate([piece[:left], [names.setdefault(center, 257 + len(names))], piece[left:]]))
        pairs = repeats(pieces, length - core + 1)
        if not len(pairs):
            return None
        starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])[:-1]])
        docs, at = np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
        pairs = pairs[np.argsort(pairs[:, 1])]
        late, first = pairs[:, 1], pairs[:, 0]
        k, k0 = np.searchsorted(starts, late, "right") - 1, np.searchsorted(starts, first, "right") - 1
        where, where0 = at[k] + late - starts[k], at[k0] + first - starts[k0]
        other = (docs[k] != docs[k0]) | (where != where0)
        k, where = k[other], where[other]
        if not len(k):
            return None
        new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (where[1:] != where[:-1] + 1)]))
        return batch_of(doc=docs[k[new]], start=where[new], windows=np.diff(np.concatenate([new, [len(k)]])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # the distinct pieces of the last key
        known: dict = {}
        ready: dict[int, list] = {}  # by bytes of the key
        size: dict[int, int] = {}
        whole: list = []

        def take(row: tuple, held: list, known: dict) -> None:
            if (first := known.setdefault(row[3:], row)) is row:
                held.append(row)
            elif first[1:3] != row[1:3]:  # the same bytes again: a repeat as a whole
                whole.append((row[1], row[2], len(row[5]) + len(row[4]) - length + 1))

        def close(held: list) -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            if len(centers := {x[4] for x in held}) > 1:  # keys that agree by chance
                for c in sorted(centers):
                    yield from close([x for x in held if x[4] == c])
                return
            core, own = len(held[0][4]), sum(len(x[5]) + 2 for x in held)
            if own > MOST and core < length:  # longer keys, so that no suffix array is too large
                rows = sorted(_longer_keys(held, length, 1), key=lambda x: x[:3])
                for _, group in itertools.groupby(rows, key=lambda x: x[0]):
                    part: list = []
                    seen: dict = {}
                    for row in group:
                        take(row, part, seen)
                    yield from close(part)
                return
            ready.setdefault(core, []).extend(held)
            size[core] = size.get(core, 0) + own
            if size[core] >= PART and (out := settle(core, ready.pop(core))) is not None:
                yield out
            size[core] = size[core] % PART if core in ready else 0

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "start", "left", "center", "piece"))):
                if held and held[0][0] != row[0]:
                    yield from close(held)
                    held, known = [], {}
                take(row, held, known)
            if whole:
                yield batch_of(**dict(zip(("doc", "start", "windows"), map(np.array, zip(*whole)))))
                whole.clear()
        yield from close(held)
        if whole:
            yield batch_of(**dict(zip(("doc", "start", "windows"), map(np.array, zip(*whole)))))
        for core, rows in ready.items():
            if (out := settle(core, rows)) is not None:
                yield out

    return run


def _cut(length: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [[] for _ in range(4)]
            for text, spans in zip(each_text(batch.column("text")), batch.column("spans")):
                spans = spans.as_py() or []
                for x in spans:
                    if x["piece"] is not None and x["piece"] != text[x["start"] : x["start"] + x["windows"] - 1 + length]:
                        raise RuntimeError("two runs of different bytes have the same hashes: run again with another gram")
                kept, end, count, removed = [], 0, 0, 0
                for s, k in sorted((x["start"], x["windows"]) for x in spans):
                    e = min(s + k - 1 + length, len(text))
                    if e <= end:
                        continue
                    if s > end or not count:
                        kept.append(text[end:s])
                        count += 1
                        removed += e - s
                    else:
                        removed += e - end
                    end = e
                kept = b"".join([*kept, text[end:]])
                for x, v in zip(out, (len(text), removed, count, kept)):
                    x.append(v)
            columns = {c[1:]: batch.column(c) for c in batch.schema.names if c[0] == "_"}
            columns |= {"n_bytes": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()), "n_spans": pa.array(out[2], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in out[3]])}
            if keep_text:
                columns["kept_text"] = pa.array([x.decode("utf-8", "ignore") for x in out[3]], pa.string())
            yield batch_of(**columns)

    return run


_PIECES = "key long, doc long, start long, left long, center binary, piece binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False, others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns others, n_bytes, n_removed, n_spans and kept_sha256 of each document (see the module).

    With keep_text also kept_text: the remaining bytes as text; parts of characters that a cut left are dropped.
    """
    if not 2 <= gram < length:
        raise ValueError("gram must be shorter than length")
    spark = session(docs)
    docs, doc = _ordered(docs)
    base = docs.select(doc.alias("doc"), "text")
    n = shuffle_partitions(spark)
    # A bounded sample, by a hash, only finds anchors of very many documents; results do not depend on it.
    few = base.select("doc", "text", F.xxhash64("doc", F.lit(3)).alias("u"))
    share = min(1.0, SAMPLE / max(1, docs.count()))
    few = few.where(F.pmod(F.col("u"), F.lit(1 << 40)) < int(share * (1 << 40))).select("doc", "text")
    often = few.mapInArrow(_anchors(length, gram), "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    common = np.array(sorted(r["h"] for r in often.orderBy(F.desc("n"), "h").limit(FEW).select("h").collect()), np.int64)
    runs = base.mapInArrow(_map_runs(length, gram, common), "h long, r long, doc long, span long").repartition(n, "h").sortWithinPartitions("h", "r", "doc", "span")
    found = checkpoint(runs.mapInArrow(_reduce_runs, _FOUND))
    kinds = dict(docs.dtypes)
    columns = ["doc_id", *others]
    # The joins below read one and the same exchange of the texts.
    whole = docs.select(doc.alias("doc"), F.col("text").alias("text"), *(F.col(f"`{c}`").alias(f"_{c}") for c in columns))
    runs = found.where("h is not null")
    sizes = checkpoint(runs.groupBy("h").count().where(F.col("count") > HOT))
    if sizes.limit(FEW + 1).count() <= FEW:  # so a hot anchor's runs stay where they are
        sizes = F.broadcast(sizes)
    runs = runs.join(sizes, "h", "left").withColumn("times", F.when(F.col("count") > 8 * HOT, length.bit_length()).when(F.col("count") > HOT, 3).otherwise(0))
    unsettled = runs.groupBy("doc").agg(F.collect_list(F.struct("start", "windows", "h", "times")).alias("runs"))
    pieces = whole.join(unsettled.hint("shuffle_hash"), "doc").mapInArrow(_pieces(length, gram), _PIECES)
    more = pieces.repartition(n, "key").sortWithinPartitions("key", "doc", "start").mapInArrow(_sorted_pieces(length), "doc long, start long, windows long")
    asked = found.where("other is not null").select("doc", "start", "windows", "other", "at").repartition(n, "doc").sortWithinPartitions("doc", "start")
    asked = asked.mapInArrow(_passages, "doc long, start long, windows long, other long, at long")
    asked = asked.groupBy(F.col("other").alias("doc")).agg(F.collect_list(F.struct("doc", "start", "windows", "at")).alias("asked"))
    sent = whole.join(asked.hint("shuffle_hash"), "doc").mapInArrow(_sent(length), "doc long, start long, windows long, piece binary")
    none = F.lit(None).cast("binary").alias("piece")
    spans = found.where("h is null and other is null").select("doc", "start", "windows", none).union(more.select("doc", "start", "windows", none)).union(sent)
    spans = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "windows", "piece")).alias("spans"))
    whole = whole.join(spans.hint("shuffle_hash"), "doc", "left").select(*(f"_{c}" for c in columns), "text", "spans")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text
    return whole.mapInArrow(_cut(length, keep_text), schema)


def _ordered(docs: DataFrame) -> tuple[DataFrame, Column]:
    """docs and a number that orders its documents; never null, so no join filters.

    That is the doc_id. Only where texts differ under one doc_id, documents are
    numbered by doc_id and a hash of the text, in the order of a range partitioning.
    """
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    least = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1) - F.pmod(own, F.lit(2**61)), F.lit(0))
    reused = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo != hi")
    if reused.isEmpty():
        return docs, least
    keys = docs.select(least.alias("__d"), own.alias("__h")).distinct()
    keys = keys.repartitionByRange(shuffle_partitions(docs.sparkSession), "__d", "__h").sortWithinPartitions("__d", "__h")
    keys = checkpoint(keys.select("__d", "__h", F.monotonically_increasing_id().alias("__doc")))
    rows = docs.withColumn("__d", least).withColumn("__h", own).join(keys, ["__d", "__h"])
    return checkpoint(rows.drop("__d", "__h")), F.coalesce("__doc", F.lit(0))
