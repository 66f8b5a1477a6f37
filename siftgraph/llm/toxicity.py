"""Toxicity scores from a lexicon matched by Levenshtein automata.

The lexicon is learned from labelled rows: words that toxic documents hold far
more often than others, and word beginnings (stems) that tell more than any whole
word. It is kept as a trie. The trie and the Levenshtein automata of its entries
(0, 1 or 2 edits by length; a stem's beginning of a token may differ by as many)
are intersected: a state is the set of (trie node, edits used) that a token's
characters so far allow, transitions are made on demand and kept, so a token
costs one lookup a character and most tokens leave the automaton after a few.

An entry has a weight for exact hits and one for misspelled hits. The second
takes MISSPELLED of its toxic documents as misspelled, against the clean documents
that hold a near spelling by chance; an entry whose near spellings are common
words (a ratio under LEAST_RATIO) has none, and such hits do not count.

Each hit is weighed by its context window: a hit between quotation marks, or
after words that report speech, counts as quoted; a hit near another hit or near
a second person counts as abuse. A logistic regression over a document's direct,
misspelled, quoted and densest hits gives the score; weights of abuse are not
negative. It is also shown the toxic documents of the fit with their hits
misspelled (still toxic) and with their hits in quotation marks (not toxic), each
at a weight of VARIANT.

Fitting reads a sample of FIT_ROWS labelled rows at most (in the order of a hash);
scoring takes every whole text, however long, and nothing else. Null and empty
texts have no hits and get the score of a text without hits; without labels of
both kinds the lexicon is empty and the score is the share of toxic labels (0
without labels); a document with labels of both kinds is toxic. Ties: of entries
that match, that of fewest edits counts, then of the larger weight, then the first.
Repeated rows each get their score; other columns are passed over.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, checkpoint, session

#: Labelled rows that the fit takes at most.
FIT_ROWS = 8000
#: Least evidence for an entry: toxic documents with it, log-likelihood ratio, and ratio of shares.
LEAST_DOCS, LEAST_EVIDENCE, LEAST_RATIO = 5, 30.0, 3.0
STEM = range(3, 10)
#: A stem needs as much evidence more than its best whole word.
STEM_GAIN = 1.1
DENSE = 0.004
#: Share of an entry's toxic documents that is taken as misspelled, and weight of made variants in the fit.
MISSPELLED, VARIANT = 0.1, 0.1
_COUNTS = ("clean", "toxic", "clean_dense", "toxic_dense")
WINDOW = 6
CUT = 0.3
_MEMO = 200_000

_TOKEN = re.compile(r"[^\W_]+")
_MARKED = re.compile(r"[^\W_]+|[\"“”„«»‹›]")
#: Words that report speech, and second persons.
REPORTS = frozenset("said says say wrote writes called calls quote quoted quotes word term sagte schrieb wort dit écrit mot dijo escribió palabra".split())
PERSONS = frozenset("you your yours you're u ur du dich dein deine ihr tu toi ton vous votre tú te tus usted".split())


def edits_of(length: int) -> int:
    """Edits that a word of this length allows."""
    return 0 if length < 5 else 1 if length < 10 else 2


class Lexicon:
    """Entries (text, is a stem, weight, weight of misspelled hits) as the intersection automaton of their trie and Levenshtein automata."""

    def __init__(self, entries: list[tuple[str, bool, float, float]]):
        self.entries = entries
        self.child: list[dict[str, int]] = [{}]
        self.word: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        self.budget = [0]
        for k, (text, stem, *_) in enumerate(entries):
            node, allowed = 0, edits_of(len(text))
            self.budget[0] = max(self.budget[0], allowed)
            for c in text:
                nxt = self.child[node].get(c)
                if nxt is None:
                    nxt = self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.budget.append(0)
                node = nxt
                self.budget[node] = max(self.budget[node], allowed)
            (self.stem if stem else self.word)[node] = k
        self.reset()

    def reset(self) -> None:
        self.names: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.memo: dict[str, tuple[int, int] | None] = {}
        self.start = self._state(self._closed({(0, 0)}))

    def __getstate__(self):
        return self.entries

    def __setstate__(self, entries):
        self.__init__(entries)

    def _closed(self, states: set) -> frozenset:
        """With missing characters of the token skipped and stems told (-1 - entry, for any rest); a node is kept with its fewest edits."""
        best: dict[int, int] = {}
        stack = list(states)
        while stack:
            node, e = stack.pop()
            if best.get(node, 9) <= e:
                continue
            best[node] = e
            if node >= 0:
                stack += [(x, e + 1) for x in self.child[node].values() if e < self.budget[x]]
                k = self.stem.get(node)
                if k is not None and e <= edits_of(len(self.entries[k][0])):
                    stack.append((-k - 1, e))
        return frozenset(best.items())

    def _state(self, states: frozenset) -> int:
        name = self.names.get(states)
        if name is None:
            name = self.names[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            found = []
            for node, e in states:
                if node < 0:
                    found.append((e, -node - 1))
                elif (k := self.word.get(node)) is not None and e <= edits_of(len(self.entries[k][0])):
                    found.append((e, k))
            best = min(found, default=None, key=lambda x: (x[0], -self.weight(x[1], x[0]), x[1]))
            self.accepts.append(best and (best[1], best[0]))
        return name

    def weight(self, entry: int, edits: int) -> float:
        return self.entries[entry][3] / edits if edits else self.entries[entry][2]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            if node < 0:  # a stem was found: the rest of the token is free
                out.add((node, e))
                continue
            if e < self.budget[node]:
                out.add((node, e + 1))
            for label, x in self.child[node].items():
                if label == c:
                    out.add((x, e))
                elif e < self.budget[x]:
                    out.add((x, e + 1))
        nxt = self._state(self._closed(out)) if out else -1
        self.moves[state][c] = nxt
        return nxt

    def match(self, token: str) -> tuple[int, int] | None:
        """The best entry and its edits."""
        state = self.start
        moves = self.moves
        for c in token:
            nxt = moves[state].get(c)
            if nxt is None:
                nxt = self._move(state, c)
            if nxt < 0:
                return None
            state = nxt
        return self.accepts[state]

    def hits(self, tokens: set[str]) -> dict[str, tuple[int, int]]:
        memo, out = self.memo, {}
        for t in tokens:
            m = memo.get(t, 0)
            if m == 0:
                if len(memo) > _MEMO:
                    self.reset()
                    memo = self.memo
                m = memo[t] = self.match(t)
            if m is not None:
                out[t] = m
        return out


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Exact and misspelled weight, the heaviest hit, the most weight in a window, weight a token, and quoted weight."""
    text = text.lower()
    hits = {t: (w, m[1]) for t, m in lexicon.hits(set(_TOKEN.findall(text))).items() if (w := lexicon.weight(*m)) > 0}
    if not hits:
        return [0.0] * 6
    marked = _MARKED.findall(text)
    exact = fuzzy = quoted = heaviest = densest = 0.0
    inside, opened, recent, tokens = False, 0, [], 0
    for i, t in enumerate(marked):
        if not (t[0].isalnum()):
            inside = not inside if t == '"' else t in "“„«‹"
            opened = i
            continue
        tokens += 1
        m = hits.get(t)
        if m is None:
            continue
        weight, edits = m
        around = marked[max(0, i - WINDOW) : i + WINDOW + 1]
        closes = any(x in '"”»›' for x in marked[i + 1 : i + 1 + WINDOW])
        if inside and (i - opened <= WINDOW or closes) or any(x in REPORTS for x in marked[max(0, i - 3) : i]):
            quoted += weight
            continue
        if any(x in PERSONS for x in around):
            weight *= 1.25
        if edits:
            fuzzy += weight
        else:
            exact += weight
        heaviest = max(heaviest, weight)
        recent = [x for x in recent if i - x[0] <= WINDOW] + [(i, weight)]
        densest = max(densest, sum(x[1] for x in recent))
    return [math.log1p(exact), math.log1p(fuzzy), heaviest, densest, math.log1p(100 * (exact + fuzzy) / max(20, tokens)), math.log1p(quoted)]


#: Features of abuse, whose weights are not negative; the last feature is that of quotation.
_ABUSE = 5


def misspelled(token: str) -> str:
    """The token with one edit, chosen by its letters: a letter doubled, left out or exchanged for its neighbour."""
    h = zlib.crc32(token.encode())
    k = 1 + h % max(1, len(token) - 2)
    c = token[k : k + 1]
    return token[:k] + (c + c, "", token[k - 1 : k])[h // 64 % 3] + token[k + 1 :]


def variants(text: str, lexicon: Lexicon) -> list[tuple[str, int]]:
    """The text with its exact hits misspelled (1), and in quotation marks (0); none without exact hits."""
    text = text.lower()
    hits = {t: m[0] for t, m in lexicon.hits(set(_TOKEN.findall(text))).items() if not m[1]}
    if not hits:
        return []
    swap = lambda to: _TOKEN.sub(lambda m: to(m[0]) if m[0] in hits else m[0], text)
    out = [(swap(lambda t: f'"{t}"'), 0)]
    if any(lexicon.entries[k][3] > 0 for k in hits.values()):
        out.append((swap(lambda t: misspelled(t) if lexicon.entries[hits[t]][3] > 0 else t), 1))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last is the constant) by Newton's method, rows weighed by share; the ridge leaves the constant free.

    Weights of abuse that would be negative are 0: they leave one by one, the most negative first.
    """
    x = np.column_stack([x, np.ones(len(x))])
    free = np.ones(x.shape[1], bool)
    while True:
        at = np.flatnonzero(free)
        z = x[:, at]
        w = np.zeros(len(at))
        penalty = np.diag([ridge] * (len(at) - 1) + [1e-6])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
            step = np.linalg.solve((z * (share * p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (share * (y - p)) - penalty @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        full = np.zeros(x.shape[1])
        full[at] = w
        if full[:_ABUSE].min() >= 0:
            return full
        free[int(full[:_ABUSE].argmin())] = False


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either kind that hold an entry at all, and that hold it among DENSE of their tokens."""
    counts = [Counter() for _ in range(4)]
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = Counter(_TOKEN.findall((text or "").lower()))
            least = DENSE * sum(words.values())
            held = Counter({f"{w}$": n for w, n in words.items()})
            for w, n in words.items():
                for k in STEM:
                    if len(w) > k:
                        held[w[:k]] += n
            counts[toxic].update(held.keys())
            counts[2 + toxic].update(x for x, n in held.items() if n >= least)
    names = list(counts[0].keys() | counts[1].keys())
    for i in range(0, len(names), 100_000):
        part = names[i : i + 100_000]
        yield batch_of(entry=pa.array(part, pa.string()), **{c: pa.array([x[e] for e in part], pa.int64()) for c, x in zip(_COUNTS, counts)})


def _choose(found: list, clean: int, toxic: int) -> list[tuple[str, bool, float, float, int]]:
    """Entries (text, is a stem, weight, misspelled weight, toxic documents): whole words by evidence, then stems that tell more than their best word."""
    found = sorted(found, key=lambda x: (-x[3], -len(x[0]), x[0]))
    weight = lambda c, t: min(8.0, math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)))
    chosen: list[tuple[str, bool, float, float, int]] = []
    best: dict[str, float] = {}  # of each beginning the evidence of its best word
    for entry, c, t, evidence in found:
        if entry[-1] == "$":
            chosen.append((entry[:-1], False, weight(c, t), 0.0, t))
            for k in STEM:
                best.setdefault(entry[:-1][:k], evidence)
    beginnings: set[str] = set()  # of chosen stems
    stems: set[str] = set()
    for entry, c, t, evidence in found:
        if entry[-1] == "$" or evidence <= STEM_GAIN * best.get(entry, 0.0) or entry in beginnings or any(entry[:k] in stems for k in STEM):
            continue
        stems.add(entry)
        beginnings.update(entry[:k] for k in STEM)
        chosen.append((entry, True, weight(c, t), 0.0, t))
    return chosen


def _near(lexicon: Lexicon):
    """Documents of either kind that hold a near spelling of an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter(), Counter()]
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                counts[toxic].update({k for k, edits in lexicon.hits(set(_TOKEN.findall((text or "").lower()))).values() if edits})
        names = sorted(counts[0].keys() | counts[1].keys())
        yield batch_of(entry=pa.array(names, pa.int64()), clean=pa.array([counts[0][k] for k in names], pa.int64()), toxic=pa.array([counts[1][k] for k in names], pa.int64()))

    return run


class Model:
    def __init__(self, lexicon: Lexicon, weights: list[float]):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str) -> float:
        z = sum(w * x for w, x in zip(self.weights, [*features(text, self.lexicon), 1.0]))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def held_out(doc_id) -> F.Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labels of documents that are not held out."""
    session(docs)
    train = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    train = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    sample = checkpoint(docs.select("doc_id", "text").join(F.broadcast(train), "doc_id").select("text", "toxic"))
    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = total.get(0, 0), total.get(1, 0)
    if not clean or not toxic:
        share = toxic / max(1, clean + toxic)
        return Model(Lexicon([]), [0.0] * 6 + [math.log(max(share, 1e-15)) - math.log(max(1 - share, 1e-15))])
    counts = sample.mapInArrow(_count, "entry string, " + ", ".join(f"{c} long" for c in _COUNTS)).groupBy("entry").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    n = float(clean + toxic)

    def part(k, of, total_of):  # k log(k / expected)
        return F.when(k > 0, k * F.log(k * n / (of * float(total_of)))).otherwise(0.0)

    def evidence(t, c):
        both, without_t, without_c = t + c, F.lit(toxic) - t, F.lit(clean) - c
        ratio = (t / toxic) / ((c + 0.5) / clean)
        found = 2 * (part(t, both, toxic) + part(c, both, clean) + part(without_t, n - both, toxic) + part(without_c, n - both, clean))
        return F.when((t >= LEAST_DOCS) & (ratio >= LEAST_RATIO), found).otherwise(0.0)

    counts = counts.where(F.col("toxic") >= LEAST_DOCS).withColumn("any", evidence(F.col("toxic"), F.col("clean"))).withColumn("dense", evidence(F.col("toxic_dense"), F.col("clean_dense")))
    found = counts.withColumn("evidence", F.greatest("any", "dense")).where(F.col("evidence") >= LEAST_EVIDENCE)
    better = [F.when(F.col("dense") > F.col("any"), F.col(f"{c}_dense")).otherwise(F.col(c)).alias(c) for c in ("clean", "toxic")]
    # LEAST_DOCS of the sample's toxic documents hold each of these, with LEAST_EVIDENCE; nothing else bounds the lexicon.
    found = found.select("entry", *better, "evidence").collect()
    chosen = _choose([(r["entry"], r["clean"], r["toxic"], r["evidence"]) for r in found], clean, toxic)
    exact = Lexicon([x[:4] for x in chosen])
    near = {r["entry"]: r for r in sample.mapInArrow(_near(exact), "entry long, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()}
    entries = []
    for k, (text, stem, weight, _, docs_with) in enumerate(chosen):
        c, t = (near[k]["clean"], near[k]["toxic"]) if k in near else (0, 0)
        fuzzy = math.log((MISSPELLED * docs_with + t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        entries.append((text, stem, weight, min(weight, fuzzy) if edits_of(len(text)) and fuzzy >= math.log(LEAST_RATIO) else 0.0))
    lexicon = Lexicon(entries)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                out.append((features(text or "", lexicon), label, 1.0))
                out += [(features(x, lexicon), y, VARIANT) for x, y in (variants(text or "", lexicon) if label else ())]
            x, y, share = zip(*out) if out else ((), (), ())
            yield batch_of(x=pa.array(x, pa.list_(pa.float64())), toxic=pa.array(y, pa.int32()), share=pa.array(share, pa.float64()))

    fitted = sample.mapInArrow(rows, "x array<double>, toxic int, share double").toPandas()  # three rows of each of FIT_ROWS at most
    return Model(lexicon, _logistic(np.stack(fitted["x"].to_numpy()), fitted["toxic"].to_numpy(float), fitted["share"].to_numpy()).tolist())


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score): each row as a struct, so none of its columns can clash."""
    session(docs)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.score(t or "") for t in batch.column("text").to_pylist()]
            yield batch_of(row=batch.column("row"), score=pa.array(out, pa.float64()))

    return rows.mapInArrow(run, rows.select("row", F.lit(0.0).alias("score")).schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row."""
    return _scored(docs.select("doc_id", "text"), model).select("row.doc_id", "score")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document, fitted on the labels that are not held out."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score stays under the cut."""
    return _scored(docs, fit(docs, labels)).where(F.col("score") < CUT).select("row.*")
