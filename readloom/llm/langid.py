"""Language ID by cross-parsing: how few phrases of a language's labelled text a document is made of."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import batches

#: Learning uses, of each language, at most one document for each value of the hashed id modulo this, ...
SAMPLE_DOCS = 256
#: ... and of their letters and separators together at most so many a language ...
SAMPLE_SYMBOLS = 1 << 14
#: ... and so many over all languages.
SAMPLE_TOTAL = 1 << 19
#: Preferred length in characters of a sample document.
SAMPLE_LENGTH = (200, 5000)
#: Symbols: the separator, those that spell letters, one for letters not seen and one that pads.
ALPHABET = 256
#: A phrase does not cross the end of a stretch of so many symbols, so that stretches can be parsed side by side.
STRETCH = 512
UNKNOWN = "und"


def spellings(n: int, room: int = ALPHABET - 3) -> list[tuple[int, ...]]:
    """Symbols, from 1 to room, that spell the most frequent letter to the n-th; no two letters are spelled alike.

    With more letters than symbols the most frequent have one each, and a rarer one is a number whose digits are each of an
    own range of symbols, so that no letter is found inside another one or across two.
    """
    if n <= room:
        return [(1 + i,) for i in range(n)]
    digits, base = 2, 2
    while room - digits * base + base**digits < n:
        base += 1
        if digits * base > room:
            digits, base = digits + 1, 2
        if digits * base > room:
            raise ValueError(f"{room} symbols cannot spell {n} letters")
    single = room - digits * base
    rare = [tuple(1 + single + d * base + i // base ** (digits - 1 - d) % base for d in range(digits)) for i in range(n - single)]
    return [(1 + i,) for i in range(single)] + rare


class SuffixAutomaton:
    """All substrings of a sequence of symbols; state 0 is the start."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            state = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[state] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[state] = clone
            last = state

    def table(self, width: int) -> np.ndarray:
        """Transitions of the greedy parse, flat: entry [state * width + symbol] is twice the next state's offset, plus
        one if the longest match ended before the symbol and a new phrase starts with it. The last symbol, which pads, starts none."""
        out = np.empty((len(self.next), width), np.int32)
        start = np.ones(width, np.int32)
        for c, to in self.next[0].items():
            start[c] = 2 * to * width + 1
        out[:] = start
        for state, arcs in enumerate(self.next):
            for c, to in arcs.items():
                out[state, c] = 2 * to * width
        for c, to in self.next[0].items():  # at the start, too, a symbol begins a phrase
            out[0, c] = 2 * to * width + 1
        out[:, width - 1] = 0
        return out.reshape(-1)


class LanguageModel:
    """Suffix automata of each language over one alphabet."""

    def __init__(self, samples: dict[str, str], limit: int = SAMPLE_SYMBOLS):
        letters = Counter(c for text in samples.values() for c in text.lower() if c.isalpha())
        ranked = sorted(letters, key=lambda c: (-letters[c], c))
        self.width = min(ALPHABET, len(ranked) + 3)
        self.symbols = dict(zip(map(ord, ranked), spellings(len(ranked)), strict=True))
        self.languages = sorted(samples)
        table = self._codes()
        self.sizes, self.tables = [], []
        for name in self.languages:
            symbols, _ = encode([samples[name]], table)
            symbols = symbols[:limit]
            self.sizes.append(max(2, len(symbols)))
            self.tables.append(SuffixAutomaton(symbols.tolist()).table(self.width))

    def _codes(self) -> np.ndarray:
        """Symbols of each code point (rows), -1 after the last: 0 for all that are not letters, the last but one for letters not seen."""
        codes = np.full((0x110000, max(map(len, self.symbols.values()), default=1)), -1, np.int16)
        codes[:, 0] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000).astype(np.int16) * (self.width - 2)
        for code, spelled in self.symbols.items():
            codes[code, : len(spelled)] = spelled
        return codes

    def phrases(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        counts = -(-lengths // STRETCH)
        owner = np.repeat(np.arange(len(lengths)), counts)
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = first[owner] + within * STRETCH
        size = np.minimum(STRETCH, first[owner] + lengths[owner] - begin)
        at = begin + np.arange(int(size.max(initial=0)))[:, None]
        inside = np.arange(at.shape[0])[:, None] < size
        grid = np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], self.width - 1).astype(np.int32) if len(owner) else at
        out = np.zeros((len(lengths), len(self.languages)), np.int64)
        for k, table in enumerate(self.tables):
            state = np.zeros(len(owner), np.int32)
            total = np.zeros(len(owner), np.int32)
            for row in grid:
                step = table[(state >> 1) + row]
                total += step & 1
                state = step
            out[:, k] = np.bincount(owner, total, minlength=len(lengths))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text. A phrase costs the logarithm of the sample it points into; the language
        of least cost wins, and the score is the share of the second least in the two together."""
        if not hasattr(self, "codes"):
            self.codes = self._codes()
        symbols, lengths = encode([x or "" for x in texts], self.codes)
        letters = np.bincount(np.repeat(np.arange(len(lengths)), lengths), symbols > 0, minlength=len(lengths))
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        cost = self.phrases(symbols, lengths) * np.log2(self.sizes)
        best = cost.argmin(axis=1)
        least = np.take_along_axis(cost, best[:, None], 1)[:, 0]
        rest = np.partition(cost, 1, axis=1)[:, 1] if len(self.languages) > 1 else np.full(len(texts), np.inf)
        score = np.where(np.isinf(rest), 1.0, rest / np.maximum(least + rest, 1e-9))
        known = letters > 0
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)], np.where(known, score, 0.0).tolist()


def encode(texts: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in one array and the number of each; a run of characters that are not letters is one separator."""
    lowered = [x.lower() for x in texts]
    sizes = np.array([len(x) for x in lowered], np.int64)
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = codes[:, 0][points]
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] > 0) | (symbols[:-1] > 0)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    keep[starts] = True
    ends = np.cumsum(sizes)
    if codes.shape[1] == 1:
        kept = np.concatenate([[0], np.cumsum(keep)])
        return symbols[keep], kept[ends] - kept[ends - sizes]
    spelled = codes[points]
    there = (spelled >= 0) & keep[:, None]
    kept = np.concatenate([[0], np.cumsum(there.sum(axis=1))])
    return spelled[there], kept[ends] - kept[ends - sizes]


def training_sample(docs: DataFrame, learns: Column) -> dict[str, str]:
    """Labelled text of each language. Of each language and each value of the hashed id modulo SAMPLE_DOCS one document
    is taken, of a usual length if there is one, so the sample is spread over the corpus and bounded."""
    low, high = SAMPLE_LENGTH
    ranked = (
        docs.where(learns & F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), F.length("text").alias("n"))
        .withColumn("odd", ~F.col("n").between(low, high))
        .groupBy("lang", F.pmod("h", F.lit(SAMPLE_DOCS)).alias("slot"))
        .agg(F.min(F.struct("odd", "h", "doc_id")).alias("first"))
        .select(F.col("first.h").alias("rank"), F.col("first.doc_id").alias("doc_id"), F.col("lang").alias("of"))
    )
    chosen = F.broadcast(ranked)  # at most SAMPLE_DOCS ids a language
    texts = (
        docs.select("doc_id", "text", "lang")
        .join(chosen, ["doc_id"])
        .where(F.col("lang") == F.col("of"))
        .groupBy("lang", "rank")
        .agg(F.min(F.substring("text", 1, 2 * SAMPLE_SYMBOLS)).alias("text"))  # a document longer than a whole sample adds no more
        .orderBy("lang", "rank")
    )
    # one language after the other, so the driver holds the texts of a bounded number of documents
    out: dict[str, list[str]] = {}
    size: Counter[str] = Counter()
    for row in texts.toLocalIterator():
        if size[row.lang] < 2 * SAMPLE_SYMBOLS:
            out.setdefault(row.lang, []).append(row.text)
            size[row.lang] += len(row.text)
    return {k: "\n".join(v) for k, v in out.items()}


def held_out() -> Column:
    """Documents that take no part in learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify_language(docs: DataFrame) -> DataFrame:
    """`docs` with held_out, lang_pred and score.

    Learns from text and lang of a bounded sample of the documents that are not held out; predicts from the whole text
    alone. Null texts and texts without a letter are `und` with score 0, and so is all if nothing is labelled. Repeated
    rows get equal predictions; a null doc_id is not held out; columns of the added names are replaced. Of equally cheap
    languages the first by name wins; a very long text is parsed whole, stretch by stretch.
    """
    docs = docs.drop("held_out", "lang_pred", "score")
    samples = training_sample(docs, ~held_out())
    model = LanguageModel(samples, max(1024, min(SAMPLE_SYMBOLS, SAMPLE_TOTAL // max(1, len(samples)))))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a bounded number of symbols
    names = docs.columns

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 1000):
            languages, scores = shared.value.predict(batch.column("text").to_pylist())
            columns = [*(batch.column(c) for c in names), pa.array(languages, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.mapInArrow(run, f"{schema}, lang_pred string, score double")
    return out.withColumn("held_out", held_out())
