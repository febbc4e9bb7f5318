"""Language ID by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its labelled text. A text is parsed greedily
into the longest phrases that occur in that sample (Ziv and Merhav 1993); the fewer phrases, the closer the language.
Phrases are normalised to the bits that name them, phrases * log2(sample length), so that samples of different length
compare; a text's own length is the same for all languages and changes no order. The least wins; ties go to the language that
sorts first. Score: the winner's share of 2**-bits over all languages, from 0 to 1: how likely the whole text is the winner's
if it is one of them, near 1 for all but very short texts.

Texts are lower-cased; runs of anything but letters become one space; letters that no sample has break a phrase. Whole
texts are parsed; segments of SEGMENT symbols are worked on side by side, which doesn't change the phrases.

The automata are the only thing that is sampled (TRAIN_CHARS characters a language, TOTAL_CHARS in all, from up to
BUCKETS documents a language, spread by hash; the LANGUAGES labels of most documents): their size is bounded, so they are
broadcast.

Defined cases: null text, or one without a letter: `und`, score 0; no labelled text at all: every text is `und`; rows
without lang are predicted like others and never learned from; a null id counts as the empty id; repeated rows are
predicted alike; an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import in_parts, parts_of, release, table

TRAIN_CHARS, TOTAL_CHARS, BUCKETS, LANGUAGES, SEGMENT = 48_000, 480_000, 256, 400, 512
#: Characters of a document that go into its language's sample, and letters of a language whose transitions stand in a
#: table; those of its other letters stand in a sorted list.
SLICE, LETTERS = 1024, 60
UND = "und"


def folded(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text with runs of non-letters as one space (0), none at the ends."""
    if not text:
        return np.zeros(0, np.uint32)
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    seen = np.unique(x)
    other = np.array([c for c in seen.tolist() if not chr(c).isalpha()], np.uint32)
    x = np.where(np.isin(x, other), np.uint32(0), x) if len(other) else x
    x = x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]
    return x[(1 if len(x) and x[0] == 0 else 0) : (-1 if len(x) > 1 and x[-1] == 0 else None)] if x.any() else np.zeros(0, np.uint32)


def automaton(symbols: list[int]) -> list[dict[int, int] | None]:
    """Transitions of the suffix automaton by state; state 1 is the start, 0 has none."""
    nexts, link, length = [None, {}], [0, 0], [0, 0]
    last = 1
    for c in symbols:
        now = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p and c not in nexts[p]:
            nexts[p][c] = now
            p = link[p]
        if not p:
            link[now] = 1
        else:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return nexts


class Automaton:
    """The suffix automaton of a sample. Symbol 0 is the space, 1 stands for letters that no sample has.

    The transitions of the space and of the LETTERS commonest letters are a table of states x columns; all others, at
    most three a symbol of the sample, are keys state * symbols + symbol in order, so that any alphabet stays small.
    """

    def __init__(self, sample: np.ndarray, symbols: int):
        nexts, self.symbols = automaton(sample.tolist()), symbols
        counts = np.bincount(sample, minlength=symbols)
        own = sorted((c for c in np.flatnonzero(counts).tolist() if c > 1), key=lambda c: (-int(counts[c]), c))
        self.column = np.ones(symbols, np.int32)  # column 1 has no transition
        self.column[0] = 0
        self.column[own[:LETTERS]] = np.arange(2, 2 + len(own[:LETTERS]))
        self.columns = 2 + len(own[:LETTERS])
        self.rare = np.zeros(symbols, bool)
        self.rare[own[LETTERS:]] = True
        self.first = np.zeros(symbols, np.int32)  # from the start
        self.first[list(nexts[1])] = list(nexts[1].values())
        self.table = np.zeros((len(nexts), self.columns), np.int32)
        more = []
        column, rare = self.column.tolist(), self.rare.tolist()
        for s, to in enumerate(nexts):
            for c, t in (to or {}).items():
                if rare[c]:
                    more.append((s * symbols + c, t))
                else:
                    self.table[s, column[c]] = t
        more.sort()
        self.flat, self.wide = self.table.ravel(), np.int32(self.columns)
        self.keys, self.to = np.array([k for k, _ in more], np.int64), np.array([t for _, t in more], np.int32)

    def step(self, state: np.ndarray, symbol: np.ndarray, rare: bool) -> tuple[np.ndarray, np.ndarray]:
        """The states after a symbol each, and whether a new phrase began. rare: whether the text has symbols outside the table."""
        to = self.flat[state * self.wide + self.column[symbol]]
        if rare and len(some := np.flatnonzero(self.rare[symbol])):
            to[some] = self.listed(state[some], symbol[some])
        miss = to == 0
        return np.where(miss, self.first[symbol], to), miss

    def listed(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where rare symbols lead."""
        key = state.astype(np.int64) * self.symbols + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], 0)


class Model:
    """Automata by language, over one common alphabet of all letters of all samples."""

    def __init__(self, samples: dict[str, list[str]]):
        texts = {k: np.concatenate([np.append(folded(t), np.uint32(0)) for t in v]) for k, v in sorted(samples.items()) if v}
        texts = {k: v for k, v in texts.items() if v.any()}
        self.langs = sorted(texts)
        seen = np.unique(np.concatenate(list(texts.values()))) if texts else np.zeros(0, np.uint32)
        self.letters = seen[seen > 0].astype(np.uint32)
        self.automata = [Automaton(self.encode(texts[k]), len(self.letters) + 2) for k in self.langs]
        self.bits = np.log2([max(2, len(texts[k])) for k in self.langs])

    def encode(self, points: np.ndarray) -> np.ndarray:
        if not len(self.letters):
            return np.where(points == 0, 0, 1).astype(np.int32)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(points == 0, 0, np.where(self.letters[at] == points, at + 2, 1)).astype(np.int32)

    def phrases(self, docs: list[np.ndarray]) -> np.ndarray:
        """Phrases of each encoded text by language.

        All segments of all texts are parsed side by side, each as if a text began there. Then each one but a text's first
        is parsed on from where the one before ended, beside the parse from its own start, until both are in the same
        state; what the two counted differently so far is put right. So the phrases are those of the whole text.
        """
        out = np.zeros((len(docs), len(self.langs)), np.int64)
        owner, start, size, at = [], [], [], 0
        for i, d in enumerate(docs):
            n = -(-len(d) // SEGMENT)
            owner.append(np.full(n, i))
            s = np.arange(n) * SEGMENT
            start.append(at + s)
            size.append(np.minimum(SEGMENT, len(d) - s))
            at += len(d)
        if not at:
            return out
        owner, start, size = map(np.concatenate, (owner, start, size))
        flat = np.concatenate(docs)
        order = np.argsort(-size, kind="stable")
        place = np.argsort(order)
        follows = np.flatnonzero(np.concatenate(([False], owner[1:] == owner[:-1])))
        before = np.full(len(size), -1)  # the segment before, and the one after, by place in the order
        before[place[follows]] = place[follows - 1]
        after = np.full(len(size), -1)
        after[place[follows - 1]] = place[follows]
        owner, start, size = owner[order], start[order], size[order]
        active = len(size) - np.searchsorted(size[::-1], np.arange(1, size[0] + 1))  # lanes that are longer than t
        for k, a in enumerate(self.automata):
            rare = bool(len(a.keys)) and bool(a.rare[flat].any())
            state, count = np.zeros(len(size), np.int32), np.zeros(len(size), np.int64)  # from state 0 nothing leads on
            for t in range(int(size[0])):
                n = int(active[t])
                state[:n], miss = a.step(state[:n], flat[start[:n] + t], rare)
                count[:n] += miss
            alone, more = state.copy(), np.zeros(len(size), np.int64)
            lanes = np.flatnonzero(before >= 0)
            while len(lanes):
                own, fresh, changed, t = state[before[lanes]], np.zeros(len(lanes), np.int32), [], 0
                more[lanes] = 0
                while len(lanes):  # some ten symbols, as a rule
                    c = flat[start[lanes] + t]
                    (own, miss), (fresh, other) = a.step(own, c, rare), a.step(fresh, c, rare)
                    more[lanes] += miss.astype(np.int64) - other
                    apart = own != fresh
                    t += 1
                    left = apart & (size[lanes] > t)
                    if not left.all():
                        end = np.where(apart, own, alone[lanes])
                        if (late := ~left & (end != state[lanes])).any():  # the next segment begins elsewhere than thought
                            state[lanes[late]] = end[late]
                            changed.append(after[lanes[late]])
                        lanes, own, fresh = lanes[left], own[left], fresh[left]
                lanes = np.concatenate(changed) if changed else lanes
                lanes = lanes[lanes >= 0]
            np.add.at(out[:, k], owner, count + more)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UND] * len(texts), np.zeros(len(texts))
        part = [self.encode(folded(t)) for t in texts]
        if any(map(len, part)) and self.langs:
            bits = self.phrases(part) * self.bits
            best = bits.argmin(axis=1)
            share = 1.0 / np.exp2(np.minimum(0, bits[np.arange(len(part)), best][:, None] - bits)).sum(axis=1)
            for i, p in enumerate(part):
                if len(p):
                    names[i], scores[i] = self.langs[best[i]], share[i]
        return names, scores


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame) -> Model:
    """A model of the labelled documents that are not held out; what reaches the driver is bounded by the parameters."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    common = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang")
    known = known.join(F.broadcast(common), "lang")
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # Of each bucket the document of least hash: a pre-aggregated minimum, whatever a language's share. The slice starts
    # at a hashed place, so that samples don't favour openings.
    cut = F.substring("text", (F.pmod(F.shiftright(key, 20), F.greatest(F.lit(1), F.length("text") - SLICE)) + 1).cast("int"), F.lit(SLICE))
    rows = (
        known.select("lang", F.pmod(key, F.lit(BUCKETS)).alias("b"), key.alias("k"), cut.alias("part"))
        .groupBy("lang", "b").agg(F.min(F.struct("k", "part")).alias("least"))
        .select("lang", "least.*").orderBy("lang", "k").collect()
    )
    langs = {r["lang"] for r in rows}
    most = min(TRAIN_CHARS, TOTAL_CHARS // max(1, len(langs)))
    samples: dict[str, list[str]] = {}
    used: dict[str, int] = {}
    for r in rows:
        left = most - used.get(r["lang"], 0)
        if left > 0 and r["part"]:
            samples.setdefault(r["lang"], []).append(r["part"][:left])
            used[r["lang"]] = used.get(r["lang"], 0) + min(left, len(r["part"]))
    return Model(samples)


def predicted(docs: DataFrame, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of docs, then the language and its score under these names. Learns from text, lang and doc_id (for the fold alone)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    src = in_parts(docs.select(*dict.fromkeys(["text", *keep])))
    kept = [src.columns.index(c) for c in keep]

    def run(batches):
        m = model.value
        for b in batches:
            langs, scores = [], []
            for at, end in parts_of(b.column(0)):
                more, shares = m.predict(b.column(0).slice(at, end - at).to_pylist())
                langs += more
                scores.append(shares)
                release()
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *names])
        release()

    fields = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"{fields}, `{names[0]}` string, `{names[1]}` double")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
