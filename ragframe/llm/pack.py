"""Best-fit packing by a grouping genetic algorithm (Falkenauer 1996) on islands.

A document's tokens are the ids of a public tokenizer and an end id. Documents longer than a sequence are cut into
full sequences and a last piece; what is not a full sequence is packed. Pieces are dealt by number into cells of about
CELL pieces; ISLANDS populations evolve each cell. A crossover injects the best filled sequences of one parent into a
copy of the other, drops the sequences that hold the same pieces, and places the displaced pieces: first by
replacement, where a displaced piece takes the place of smaller ones if the sequence is then fuller, then by best fit,
decreasing. Between epochs every island's elite moves to the next island of its cell (a ring). The best packing of a
cell wins; one that reaches the lower bound (all tokens by sequence length) ends the search of its cell. Cells are bounded, so memory and work per task are, whatever the number of documents; sequences that the
cells leave ill-filled are packed once more together.

Defined cases: null text counts as empty (one token, the end id); a null id is returned as it is; repeated rows are
packed each; an empty table gives no rows; other columns are neither read nor returned. A piece never spans sequences.
"""

from __future__ import annotations

import json
import os
import random
import unicodedata
import zlib
from bisect import bisect_left, insort
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import in_parts, parts_of, release, saved, table

LENGTH, END, VOCABULARY = 2048, 0, "word_bpe_49k.json"
CELL, ISLANDS, EPOCHS, GENERATIONS, POPULATION, SEED = 2000, 2, 2, 40, 4, 11
#: Largest share of sequences that a crossover chooses from, and that a mutation dissolves.
INJECTED, DISSOLVED = 0.5, 0.04
#: Sequences filled less than this are packed once more, together with those of other cells.
WELL_FILLED = 0.97
#: Words whose ids a worker remembers: those that two parts of a batch in a row had.
CACHE = 150_000

def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones stand for themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Encoder:
    """Texts to ids as little-endian bytes, word by word.

    The tokenizer takes white space as a border and drops it, so a text's ids are those of its words in order; distinct
    words are encoded once and remembered. Words of known letters are cut by the vocabulary's own pattern and merged all
    together by its own ranks; the merge that marks a word's last byte comes before all others, which gives the
    vocabulary's word-end symbols. Any other word (odd letters, special tokens, the mark's byte) goes to the tokenizer
    itself.
    """

    #: White space for Python's split but not for the tokenizer: such texts go to the tokenizer whole.
    _ODD = "\x1c\x1d\x1e\x1f"
    _MARK, _GAP = "\x01", " "

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.recent = Tokenizer.from_file(path), {}, {}
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        model, (split, _) = rules["model"], rules["pre_tokenizer"]["pretokenizers"]
        self.special = [t["content"] for t in rules["added_tokens"]]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        byte = {c: b for b, c in _byte_letters().items()}
        end, mark = model["end_of_word_suffix"], self._MARK.encode()
        ranks, ids = {}, []
        merged = [*byte, *(c + end for c in byte), *("".join(m) for m in model["merges"])]
        for t in merged:
            ranks[bytes(byte[c] for c in t.removesuffix(end)) + (mark if t.endswith(end) else b"")] = len(ids)
            ids.append(model["vocab"][t])
        self.ids_of = np.array(ids, "<u4")
        self.merges = tiktoken.Encoding("words", pat_str=f"[^{self._GAP}{self._MARK}]+{self._MARK}|{self._GAP}", mergeable_ranks=ranks, special_tokens={})
        self.gap = ranks[self._GAP.encode()]
        self.letters: dict[str, bool] = {c: c != self._MARK for c in map(chr, range(128))}

    def _plain(self, c: str) -> bool:
        """Whether this library's rules for a letter are the tokenizer's."""
        cut = lambda s: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(s))
        own = [len(self.pattern.findall(x + c)) for x in "a!"]
        return (
            c != "\u03a3"  # its lower case depends on its neighbours here, not there
            and unicodedata.category(c) != "Cn"
            and (unicodedata.category(c)[0] != "M" or "\u0300" <= c < "\u0370")  # how others combine depends on the Unicode version
            and self.tokenizer.normalizer.normalize_str(c) == unicodedata.normalize("NFC", c).lower()
            and own == [cut(x + c) for x in "a!"]
            and c.isalpha() == (own[0] == 1)
        )

    def _odd(self, words: list[str]) -> list[str]:
        """The words that the tokenizer itself must encode."""
        found = set().union(*words)
        for c in found.difference(self.letters):
            self.letters[c] = self._plain(c)
        odd = {c for c in found if not self.letters[c]}
        if odd or {"<", "|"} <= found:  # special tokens begin with these two
            return [w for w in words if "<|" in w or not odd.isdisjoint(w)]
        return []

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of the words that are not remembered, which are known from now on; those that the last texts had too are remembered."""
        known, recent = self.known, self.recent
        for w in recent.keys() & words:
            known[w] = recent[w]
        new, fresh = list(words.difference(known)), {}
        if odd := self._odd(new):
            for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
                fresh[w] = np.array(e.ids, "<u4").tobytes()
            new = [w for w in new if w not in fresh]
        if not new:
            return fresh
        mark, gap = self._MARK, self._GAP
        low = unicodedata.normalize("NFC", gap.join(new)).lower().split(gap)
        alone = [w.isalpha() for w in low]  # one letter run
        whole = [w + mark for w, one in zip(low, alone) if one]
        parts = [w for w, one in zip(low, alone) if not one]
        new = [w for w, one in zip(new, alone) if one] + [w for w, one in zip(new, alone) if not one]
        found = np.array(self.merges.encode_ordinary(gap.join(whole + ([self.pattern.sub(r"\g<0>" + mark, gap.join(parts))] if parts else []))), np.int64)
        gaps = 4 * np.flatnonzero(found == self.gap)
        ids = self.ids_of[found].tobytes()
        for w, a, b in zip(new, [0, *(gaps + 4).tolist()], [*gaps.tolist(), len(ids)]):
            fresh[w] = ids[a:b]
        return fresh

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text. Some megabytes of texts at a time: their unknown words are encoded together."""
        texts = [t or "" for t in texts]
        odd = [any(c in t for c in self._ODD) for t in texts]
        split = [[] if o else t.split() for t, o in zip(texts, odd)]
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        fresh = self.learn(set().union(*split).difference(known))
        known.update(fresh)
        out = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if o else b"".join(map(known.__getitem__, ws)) for t, o, ws in zip(texts, odd, split)]
        for w in fresh:
            del known[w]
        self.recent = fresh
        return out

    def ids(self, text: str) -> bytes:
        return self.encode([text])[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, name: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece. The vocabulary is found on the machine that uses it."""

    def run(batches):
        enc, end = encoder(vocabulary_path(name)), np.array([END], "<u4").tobytes()
        for b in batches:
            row, piece, start, size, crc = [], [], [], [], []
            for first, last in parts_of(b.column(1)):
                for i, ids in enumerate(enc.encode(b.column(1).slice(first, last - first).to_pylist()), first):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[at : at + 4 * length]
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        size.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            release()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, size, crc)]], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        release()

    src = in_parts(docs.select("doc_id", "text"))
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


Bins = list[list[int]]


def best_fit(bins: Bins, fill: list[int], displaced: list[int], size: list[int], length: int = LENGTH) -> None:
    """Put the displaced pieces, longest first, each into the fullest sequence that takes it, or into a new one."""
    room = sorted((length - f, i) for i, f in enumerate(fill) if f < length)
    for p in sorted(displaced, key=lambda p: (-size[p], p)):
        at = bisect_left(room, (size[p], -1))
        if at < len(room):
            left, i = room.pop(at)
        else:
            left, i = length, len(bins)
            bins.append([])
            fill.append(0)
        bins[i].append(p)
        fill[i] += size[p]
        if left > size[p]:
            insort(room, (left - size[p], i))


def _fitness(fill: list[int], length: int) -> tuple[int, int]:
    """Fewer sequences, then squares of fill: full ones and one empty one beat two half full ones."""
    return -len(fill), sum(f * f for f in fill)


def _crossover(a: tuple[Bins, list[int]], b: tuple[Bins, list[int]], size, rng: random.Random, length: int) -> tuple[Bins, list[int]]:
    """a with some of b's best filled sequences: a's sequences that hold the same pieces go, their other pieces are placed anew."""
    order = sorted(range(len(b[0])), key=lambda i: -b[1][i])
    share = order[: max(1, int(len(order) * rng.uniform(0.0, INJECTED)))]
    chosen = rng.sample(share, max(1, len(share) // 2))
    taken = {p for i in chosen for p in b[0][i]}
    bins, fill, displaced = [b[0][i][:] for i in chosen], [b[1][i] for i in chosen], []
    for own, f in zip(*a):
        if taken.isdisjoint(own):
            bins.append(own[:])
            fill.append(f)
        else:
            displaced += [p for p in own if p not in taken]
    return _repack(bins, fill, displaced, size, rng, length)


def _two(left: list[tuple[int, int]], most: int, least: int) -> tuple[int, tuple[int, ...]]:
    """Of the displaced pieces (size, piece), in order: two that together come nearest to most, not above, and above least; their sum and places."""
    i, j, total, at = 0, bisect_left(left, (most + 1, -1)) - 1, least, ()
    while i < j and total < most:
        both = left[i][0] + left[j][0]
        if both > most:
            j -= 1
        else:
            if both > total:
                total, at = both, (i, j)
            i += 1
    return total, at


def _replace(bins: Bins, fill: list[int], displaced: list[int], size: list[int], rng: random.Random, length: int) -> list[int]:
    """Falkenauer's replacement: a sequence with room takes what fills it most, one displaced piece in place of up to two of its own, or two in place of two. Returns what is displaced now."""
    left = sorted((size[p], p) for p in displaced)
    open_ = [i for i, f in enumerate(fill) if f < length]
    rng.shuffle(open_)
    for i in open_:
        own, room = bins[i], length - fill[i]
        groups = [(), *combinations(range(len(own)), 1), *combinations(range(len(own)), 2)]
        gain, out, at = 0, (), ()
        for g in groups:
            have = sum(size[own[k]] for k in g)
            k = bisect_left(left, (have + room + 1, -1)) - 1
            if k >= 0 and left[k][0] - have > gain:
                gain, out, at = left[k][0] - have, g, (k,)
        for g in groups if gain < room else ():
            if len(g) == 2 and gain < room:
                have = sum(size[own[k]] for k in g)
                total, two = _two(left, have + room, have + gain)
                if two:
                    gain, out, at = total - have, g, two
        if gain:
            new = [left.pop(k)[1] for k in reversed(at)]
            for k in out:
                insort(left, (size[own[k]], own[k]))
            bins[i] = [p for k, p in enumerate(own) if k not in out] + new
            fill[i] += gain
    return [p for _, p in left]


def _repack(bins, fill, displaced, size, rng, length):
    """Mutation: the emptiest sequences and some others go too; then replacement, and best fit for the rest."""
    if len(bins) > 2:
        some = max(2, int(len(bins) * rng.uniform(0.0, DISSOLVED)))
        worst = sorted(range(len(bins)), key=fill.__getitem__)[: max(1, some // 4)]
        gone = {*worst, *rng.sample(range(len(bins)), some)}
        displaced = displaced + [p for i in gone for p in bins[i]]
        bins, fill = [x for i, x in enumerate(bins) if i not in gone], [x for i, x in enumerate(fill) if i not in gone]
    best_fit(bins, fill, _replace(bins, fill, displaced, size, rng, length), size, length)
    return bins, fill


def evolve(size: list[int], seed: int, elites: list[Bins], length: int = LENGTH, generations: int = GENERATIONS) -> Bins:
    """Best packing after some generations of one island; elites that came to it join the first population."""
    rng = random.Random(seed)
    lower = -(-sum(size) // length)
    population = []
    for e in elites:
        population.append((e, [sum(size[p] for p in x) for x in e]))
    while len(population) < POPULATION:
        bins, fill = [], []
        pieces_ = list(range(len(size)))
        if population:  # beside best fit decreasing: some pieces first, in a random order, the others by best fit
            rng.shuffle(pieces_)
            for p in pieces_[: len(pieces_) // 8]:
                best_fit(bins, fill, [p], size, length) if not bins or fill[-1] + size[p] > length else (bins[-1].append(p), fill.__setitem__(-1, fill[-1] + size[p]))
            pieces_ = pieces_[len(pieces_) // 8 :]
        best_fit(bins, fill, pieces_, size, length)
        population.append((bins, fill))
        if len(bins) == lower:
            return bins  # no packing has fewer
    key = lambda x: _fitness(x[1], length)
    for _ in range(generations):
        population.sort(key=key, reverse=True)
        if len(population[0][0]) == lower:
            break
        children = []
        for _ in range(POPULATION // 2):
            a, b = rng.sample(population, 2)
            children.append(_crossover(a, b, size, rng, length))
        population = sorted([*population, *children], key=key, reverse=True)[:POPULATION]
    return max(population, key=key)[0]


def _islands(cells: DataFrame, elites: DataFrame | None, epoch: int, length: int) -> DataFrame:
    """One epoch: (cell, island, bin of every piece in order of n). cells: cell, n, length of the pieces."""

    def run(key, mine):
        items = mine[0].sort_values("n")
        size = items["length"].tolist()
        came = []
        for bins in mine[1]["bins"] if len(mine) > 1 else []:
            by: dict[int, list[int]] = {}
            for p, b in enumerate(bins):
                by.setdefault(int(b), []).append(p)
            came.append(list(by.values()))
        cell, island = key
        got = evolve(size, hash((SEED, int(cell), int(island), epoch)), came, length)
        of = np.zeros(len(size), np.int32)
        for b, x in enumerate(got):
            of[x] = b
        return pd.DataFrame({"cell": [cell], "island": [island], "n_bins": [len(got)], "bins": [of]})

    import pandas as pd

    schema = "cell long, island int, n_bins int, bins array<int>"
    dealt = cells.select("cell", "n", "length", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island")).groupBy("cell", "island")
    if elites is None:
        return dealt.applyInPandas(lambda key, pdf: run(key, [pdf]), schema)
    moved = elites.select("cell", F.explode(F.array("island", (F.col("island") + 1) % ISLANDS)).alias("island"), "bins").groupBy("cell", "island")
    return dealt.cogroup(moved).applyInPandas(lambda key, a, b: run(key, [a, b]), schema)


def packed(items: DataFrame, length: int = LENGTH, cell: int = CELL) -> DataFrame:
    """(n unique, length) -> (n, cell, bin): the cell's packing of fewest sequences."""
    count = items.count()
    parts = max(1, -(-count // cell))
    cells = saved(items.select(F.pmod(F.xxhash64("n"), F.lit(parts)).alias("cell"), "n", F.col("length").cast("int").alias("length")), "pack-cells")
    elites = None
    for epoch in range(EPOCHS):
        elites = saved(_islands(cells, elites, epoch, length), "pack-elites")
    best = elites.groupBy("cell").agg(F.min(F.struct("n_bins", "island", "bins")).alias("x")).select("cell", F.posexplode("x.bins").alias("i", "bin"))
    from pyspark.sql import Window

    placed = cells.withColumn("i", F.row_number().over(Window.partitionBy("cell").orderBy("n")) - 1)
    return placed.join(best, ["cell", "i"]).select("n", "length", "cell", "bin")


def sequences(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """pieces, saved, with a unique n -> with sequence_id and offset."""
    from pyspark.sql import Window

    full = found.where(F.col("length") == length).select("n", (F.col("n") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first = saved(packed(found.where(F.col("length") < length).select("n", "length"), length), "pack-first")
    fill = first.groupBy("cell", "bin").agg(F.sum("length").alias("fill"), F.min("n").alias("m"))
    good = first.join(fill, ["cell", "bin"])
    kept = good.where(F.col("fill") >= WELL_FILLED * length).select("n", "length", (F.col("m") * 4 + 1).alias("sequence_id"))
    again = packed(good.where(F.col("fill") < WELL_FILLED * length).select("n", "length"), length, 2 * CELL)
    w = Window.partitionBy("cell", "bin")
    again = again.withColumn("sequence_id", F.min("n").over(w) * 4 + 2).select("n", "length", "sequence_id")
    at = Window.partitionBy("sequence_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    short = kept.unionByName(again).withColumn("offset", F.coalesce(F.sum("length").over(at), F.lit(0)).cast("long")).select("n", "sequence_id", "offset")
    return found.join(full.unionByName(short), "n")


def packed_documents(docs: DataFrame) -> DataFrame:
    found = saved(pieces(docs).withColumn("n", F.monotonically_increasing_id()), "pack-pieces")
    return sequences(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
