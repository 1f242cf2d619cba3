"""Lexical retrieval packing: a BM25 index of the whole corpus gives each seed its nearest unused neighbours, which fill its window."""

from __future__ import annotations

import functools
import os
import string
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from readloom.llm.common import batches, hash_bits, materialize, mix, pack, pack_counts, shard_bounds, shared_path, side, summed, unpack, unpack_counts, utf8

#: Ids in a sequence.
WINDOW = 2048
#: Stands after the last id of each document.
END_ID = 1
#: A term is so many ids in a row; each run of a document is one, however common (at most one document in COMMON: all).
TERM_IDS, COMMON = 3, 1
#: Terms of a seed's query: all that it has. Neighbours that a seed gets at a time; it asks again when they are used up.
QUERY_TERMS, ASKED = None, 24
#: BM25.
K1, B = 1.2, 0.75
#: The two parts of a term's gain, that of the term and that of the document, are multiples of the first, a gain of the second,
#: so that sums are exact in any order.
FACTOR_STEP, STEP = 2.0**-13, 2.0**-26
#: Ids of documents in a block of the index and of those that are ordered for blocks, ids of the corpus for each group of seeds that
#: meets it, pairs of a term's seed and document, and of a seed and a document, at a time.
BLOCK_IDS, ORDERED_IDS, GROUP_IDS, MOST_PAIRS, MOST_CELLS = 1 << 21, 1 << 23, 1 << 22, 1 << 13, 1 << 21
#: Documents in a block at most: a posting is a document's place and a factor of 16 bits each.
BLOCK_DOCS = 1 << 16
#: Ids of the corpus for each wave of seeds that ask, and waves at most.
WAVE_IDS, MOST_WAVES = 1 << 24, 6
#: A term that more than this share of the pairs of a seed and a document at hand have is multiplied as a row of a matrix.
DENSE_SHARE = 1 / 300
#: Ids in the profile by which like documents are brought together, and documents that are not told apart.
PROFILE, ALIKE = 512, 100
#: Ids whose terms are sorted at a time to be counted, and distinct terms that a task sends at a time.
COUNTED_IDS, SENT_TERMS = 1 << 21, 1 << 22
#: Seeds among equally long rests of which fewer than this are drawn exactly.
EXACT_LOTS = 1000
#: Positions in a bin in which what is left over meets the room that is left.
BIN = 512
#: Batches of documents whose rows are looked up at a time.
LISTED = 64
#: Text bytes that are encoded at a time.
TEXT_BYTES = 8 << 20
#: ASCII punctuation, and words in a line for the tokenizer. Letters whose lower case depends on their place or is not one letter, and
#: those that may not be normalized.
PUNCTUATION, LINE_WORDS = string.punctuation, 256
ODD_LETTERS, UNSURE_LETTERS = "[\u0130\u03a3\u03c2\u03c3]", r"[^\x{0}-\x{2ff}]"


class Encoder:
    """Ids of texts. The tokenizer treats the stretches between ASCII white space one by one, so each distinct stretch of the texts
    that are given at a time is encoded once; the ids are those of the whole text. Words of letters alone, the usual case, are
    encoded in long lines: such a word's ids end with its only one that stands for the end of a word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side already
        self.tokenizer = Tokenizer.from_file(path)
        # words of letters, lower-cased and normalized before, need none of that and are only split at blanks
        self.of_words = Tokenizer(self.tokenizer.model)
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), self.tokenizer.pre_tokenizer[1]])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.small = max(vocabulary.values()) < 1 << 16
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _ids(self, texts: list[str], tokenizer: Tokenizer | None = None) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, one after the other, and where each word's end."""
        lines = [words[i : i + LINE_WORDS] for i in range(0, len(words), LINE_WORDS)]
        ids = np.concatenate([np.zeros(0, np.uint32), *self._ids([" ".join(x) for x in lines], self.of_words)])
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            raise ValueError("the tokenizer splits a word of letters")
        return ids, cuts

    def _stretches(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct stretches, one after the other, and how many each has."""
        # a word of letters, and punctuation after it, which is a token of its own for the tokenizer
        core = pc.ascii_rtrim(stretches, characters=PUNCTUATION)
        is_plain = pc.and_not(pc.utf8_is_alpha(core), pc.match_substring_regex(core, ODD_LETTERS)).to_numpy(zero_copy_only=False).copy()
        unsure = pc.match_substring_regex(core, UNSURE_LETTERS)
        is_plain[unsure.to_numpy(zero_copy_only=False)] &= np.array([unicodedata.is_normalized("NFC", x) for x in core.filter(unsure).to_pylist()], bool)
        plain = pa.array(is_plain)
        words = pc.utf8_lower(core.filter(plain)).dictionary_encode()
        ids, ends = self._words(words.dictionary.to_pylist())
        n_core = pc.binary_length(core)
        marked = pc.and_(plain, pc.less(n_core, pc.binary_length(stretches)))
        marks = pa.array([x[n:] for x, n in zip(utf8(stretches.filter(marked)), n_core.filter(marked).to_pylist(), strict=True)], pa.binary()).dictionary_encode()
        others = self._ids([x.decode() for x in [*marks.dictionary.to_pylist(), *utf8(stretches.filter(pc.invert(plain)))]])
        sizes = np.concatenate([np.diff(ends, prepend=0), np.array([len(x) for x in others], np.int64)]).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        # each stretch is two parts of these: its word and mark, or itself and nothing
        first, second = np.zeros(len(stretches), np.int64), np.full(len(stretches), len(sizes))
        n_words, n_marks = len(words.dictionary), len(marks.dictionary)
        first[is_plain] = words.indices.to_numpy()
        second[marked.to_numpy(zero_copy_only=False)] = marks.indices.to_numpy() + n_words
        first[~is_plain] = np.arange(n_words + n_marks, len(sizes))
        sizes, begins = np.append(sizes, 0), np.append(begins, 0)
        parts = np.stack([first, second], 1).reshape(-1)
        return gathered(np.concatenate([ids, *others]), begins[parts], sizes[parts]), sizes[first] + sizes[second]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a null text has only the one at the end."""
        texts = pc.fill_null(texts, "")
        # the tokenizer lower-cases; of A to Z that is done here, for fewer distinct stretches
        parts = pc.ascii_split_whitespace(pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts))
        found = parts.flatten().dictionary_encode()
        ids, sizes = self._stretches(found.dictionary)
        sizes = np.append(sizes, 1)  # the end is one more stretch
        begins, ids = np.cumsum(sizes) - sizes, np.append(ids, np.uint32(END_ID))
        ends = np.cumsum(pc.list_value_length(parts).to_numpy())
        order = np.insert(found.indices.to_numpy(), ends, len(sizes) - 1)
        flat = gathered(ids, begins[order], sizes[order])
        total = np.cumsum(sizes[order])
        return np.split(flat, total[ends + np.arange(len(ends))][:-1]) if len(ends) else []


def gathered(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of an array, one after the other."""
    shift = begins - (np.cumsum(sizes) - sizes)
    kind = np.int32 if max(len(values), int(sizes.sum())) < 1 << 31 else np.int64
    at = np.repeat(shift.astype(kind), sizes)
    at += np.arange(len(at), dtype=kind)
    return values.take(at)


def by_bytes(batched: Iterator[pa.RecordBatch], column: int, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about so many bytes of a text column, which are encoded at a time."""
    held, size, limit = [], 0, limit or TEXT_BYTES
    for batch in batches(batched, 256):
        if not batch.num_rows:
            continue
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    """The encoder of this Python worker, which the tasks that follow one another in it share."""
    return Encoder(path)


def forget_encoder() -> None:
    """Frees the encoder and what Arrow keeps for it: a Python worker stays, and the memory is needed by what follows."""
    encoder.cache_clear()
    pa.default_memory_pool().release_unused()


@dataclass(frozen=True)
class Corpus:
    """What a score needs to know of the whole corpus: documents, ids, and who is a seed: documents whose rest is longer than
    `longer`, and of those with just that a share."""

    n: int
    ids: int
    longer: int
    share: float

    def is_seed(self, tie: np.ndarray, rest: np.ndarray) -> np.ndarray:
        return (rest > self.longer) | ((rest == self.longer) & (rest > 0) & (lots(tie) < self.share))

    def factor(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The part of a term's gain that depends on the document, in multiples of FACTOR_STEP."""
        value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length * self.n / self.ids))
        return np.round(value / FACTOR_STEP).astype(np.int64)

    def weight(self, df: np.ndarray) -> np.ndarray:
        """The part that depends on the term, in multiples of FACTOR_STEP."""
        return np.round(np.log(1 + (self.n - df + 0.5) / (df + 0.5)) / FACTOR_STEP).astype(np.int64)


def lots(tie: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each row, by the hash of its id and text."""
    return mix(tie.view(np.uint64), 0x5EED).astype(np.float64) / 2.0**64


def seeds_by_length(rests: np.ndarray, window: int) -> tuple[int, int]:
    """Corpus.longer, and how many of the rests of just that length are seeds: the longest rests are, as many as the windows
    that all rests fill. rests[n] is the number of rests of n ids."""
    windows = int((rests * np.arange(len(rests))).sum()) // window
    above = np.append(np.cumsum(rests[::-1])[::-1][1:], 0)  # rests longer than n
    longer = int(np.argmax(above <= windows))
    return longer, min(windows - int(above[longer]), int(rests[longer])) if longer else 0


def share_of(docs: DataFrame, longer: int, missing: int, n: int, window: int) -> float:
    """Lots below this are drawn among the n rests of `longer` ids: `missing` of them. Where that is a small number it is
    exact; a large one is aimed at from below, so that chance does not make more seeds than windows."""
    if missing >= EXACT_LOTS:
        return 0.8 * missing / n

    def draw(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched:
            yield pa.record_batch({"lot": lots(batch.column(0).to_numpy())})

    least = docs.where(F.col("n") % window == longer).select("tie").mapInArrow(draw, "lot double").orderBy("lot").limit(missing)
    return float(np.nextafter(max((r["lot"] for r in least.collect()), default=0.0), 2.0))


def terms(docs: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, times) of each distinct term of each document, sorted by both."""
    sizes = np.array([len(x) for x in docs], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint32), *docs])
    own = np.repeat(np.arange(len(docs)), sizes)
    last = max(0, len(flat) - TERM_IDS + 1)
    at = np.flatnonzero(own[:last] == own[len(flat) - last :])
    hashes = functools.reduce(mix, (flat[at + k].astype(np.uint64) for k in range(TERM_IDS))) >> np.uint64(64 - bits)
    order = np.argsort(hashes)  # in any order of equal ones, which is much faster than a stable one
    hashes = hashes[order]
    number = np.cumsum(np.append(False, hashes[1:] != hashes[:-1])[: len(hashes)])
    both = np.sort(number << 32 | own[at[order]])
    first, times = runs(both)
    return hashes[first], both[first] & 0xFFFFFFFF, times


def stretches(batched: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(row, ids) of documents, of about so many ids at a time."""
    texts, size = [], 0
    for batch in batches(batched, 256):
        for row, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            texts.append((row, as_ids(blob)))
            size += len(texts[-1][1])
            if size >= most:
                yield texts
                texts, size = [], 0
    if texts:
        yield texts


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each run of equal values."""
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))
    return begin, np.diff(np.append(begin, len(values)))


def as_ids(blob: bytes) -> np.ndarray:
    """A document's ids."""
    return np.frombuffer(zstandard.decompress(blob[1:]), "<u2" if blob[:1] == b"2" else "<u4").astype(np.uint32)


def as_blob(ids: np.ndarray, small: bool) -> bytes:
    """Ids compressed, two bytes each if `small`; the first byte tells."""
    return (b"2" if small else b"4") + zstandard.compress(ids.astype("<u2" if small else "<u4").tobytes(), 1)


def by_likeness(docs: list[np.ndarray]) -> np.ndarray:
    """An order in which documents of like ids (of a language, say) are near each other: halves along the main direction of their
    profiles, again and again. What is computed does not depend on it, only how many terms fill a matrix."""
    profiles = np.zeros((len(docs), PROFILE), np.float32)
    for profile, ids in zip(profiles, docs, strict=True):
        profile[:] = np.sqrt(np.bincount((mix(ids.astype(np.uint64), 7) % np.uint64(PROFILE)).astype(np.int64), minlength=PROFILE))
    profiles /= np.linalg.norm(profiles, axis=1, keepdims=True) + 1e-9
    todo, out = [np.arange(len(docs))], []
    while todo:
        part = todo.pop()
        if len(part) <= ALIKE:
            out.append(part)
            continue
        x = profiles[part] - profiles[part].mean(0)
        direction = x[int(np.argmax((x * x).sum(1)))]
        for _ in range(6):
            direction = (x @ direction) @ x
            direction /= np.linalg.norm(direction) + 1e-30
        part = part[np.argsort(x @ direction, kind="stable")]
        todo += [part[len(part) // 2 :], part[: len(part) // 2]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Block:
    """A block of the index: its documents' rows, and of each term the documents, by their place in the block, and factors."""

    NAMES = ("rows", "lengths", "counts", "often", "times")

    def __init__(self, row: dict[str, bytes], corpus: Corpus):
        self.hashes = unpack(row["hashes"])
        self.rows, lengths, self.n, often, times = (unpack_counts(row[k]) for k in self.NAMES)
        docs = np.ascontiguousarray(np.frombuffer(zstandard.decompress(row["docs"]), np.uint8).reshape(2, -1).T).view("<u2").reshape(-1).astype(np.uint32)
        factor = (corpus.factor(np.ones(len(lengths)), lengths) << 16).astype(np.uint32)
        self.postings = docs | factor.take(docs)  # a document's place and its factor
        self.postings[often] = docs[often] | (corpus.factor(times, lengths[docs[often]]) << 16).astype(np.uint32)
        self.begin = np.cumsum(self.n) - self.n

    @classmethod
    def of(cls, texts: list[np.ndarray], rows: list[int], bits: int) -> dict[str, bytes]:
        if len(rows) > BLOCK_DOCS:
            raise ValueError("a block has too many documents")
        order = np.argsort(rows)
        texts = [texts[k] for k in order]
        hashes, own, tf = terms(texts, bits)
        begin, n = runs(hashes)
        often = np.flatnonzero(tf > 1)
        columns = (np.array(rows, np.int64)[order], np.array([len(x) for x in texts], np.int64), n, often, tf[often])
        docs = zstandard.compress(np.ascontiguousarray(own.astype("<u2").view(np.uint8).reshape(-1, 2).T).tobytes(), 1)
        return {"hashes": pack(hashes[begin]), "docs": docs} | dict(zip(cls.NAMES, map(pack_counts, columns), strict=True))


class Group:
    """Seeds that meet the index together: their terms and weights, and the nearest documents so far."""

    def __init__(self, seeds: np.ndarray, texts: list[np.ndarray], corpus: Corpus, bits: int, frequencies: Iterator[tuple[np.ndarray, np.ndarray]]):
        order = by_likeness(texts)
        self.seeds = seeds[order]
        hashes, own, _ = terms([texts[k] for k in order], bits)
        begin, n = runs(hashes)
        known, df = hashes[begin], np.zeros(len(begin), np.int64)
        for h, counts in frequencies:
            low, high = np.searchsorted(known, h[0]), np.searchsorted(known, h[-1], side="right")
            at = np.searchsorted(h, known[low:high])
            df[low:high] = np.where(h[at] == known[low:high], counts[at], df[low:high])
        there = df > 1  # what one document has alone finds no other
        entries = np.flatnonzero(np.repeat(there, n))
        term = np.repeat(np.cumsum(there) - 1, n)[entries].astype(np.int32)
        own = own[entries].astype(np.int32)
        order = np.argsort(own, kind="stable")
        self.known, self.weights, self.term, self.own = known[there], corpus.weight(df[there]), term[order], own[order]
        self.ends = np.searchsorted(self.own, np.arange(len(seeds)), side="right")
        self.least = np.ones(len(seeds))  # what a document has to score
        self.best = tuple(np.zeros(0, np.int64) for _ in range(3))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def meet(self, block: Block) -> None:
        """Scores of all documents of a block for all seeds; those that are not among a seed's ASKED nearest so far are left out."""
        at = np.searchsorted(self.known, block.hashes)
        same = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] == block.hashes) if len(self.known) else at[:0]
        place = np.full(len(self.known), -1, np.int32)
        place[at[same]] = same
        weight = np.zeros(len(block.hashes))
        weight[same] = self.weights[at[same]]
        entries, n_docs = np.append(0, self.ends), len(block.rows)
        step = max(1, MOST_CELLS // n_docs)
        for first in range(0, len(self.seeds), step):
            last = min(first + step, len(self.seeds))
            e = slice(entries[first], entries[last])
            found = place.take(self.term[e])
            hit = np.flatnonzero(found >= 0)
            if not len(hit):
                continue
            score = self.scores(block, weight, found.take(hit), self.own[e].take(hit) - first, last - first)
            least = self.least[first:last].copy()
            unknown = np.flatnonzero(least == 1)
            if n_docs > ASKED and len(unknown):
                least[unknown] = np.maximum(1, np.partition(score[unknown], n_docs - ASKED, axis=1)[:, n_docs - ASKED])
            cell = np.flatnonzero(score >= least[:, None])
            seed, doc = np.divmod(cell, n_docs)
            self.new.append((seed + first, block.rows[doc], score.reshape(-1)[cell].astype(np.int64)))
        if sum(len(x[0]) for x in self.new) > len(self.best[0]) // 2:
            self.settle()

    @staticmethod
    def scores(block: Block, weight: np.ndarray, found: np.ndarray, own: np.ndarray, n_seeds: int) -> np.ndarray:
        """Scores of some seeds, which have the terms `found` of the block: own[k] has found[k], in the order of seeds. Terms that many
        of the pairs of a seed and a document have are a product of matrices, the others are added seed by seed. Gains are whole
        numbers below 2 ** 32, so that sums are exact."""
        n_docs = len(block.rows)
        dense = np.bincount(found, minlength=len(block.n)) * block.n > n_seeds * n_docs * DENSE_SHARE
        often = np.flatnonzero(dense)
        column = np.zeros(len(block.n), np.int32)
        column[often] = np.arange(len(often))
        is_dense = dense.take(found)
        at = np.flatnonzero(is_dense)
        left = np.zeros((n_seeds, len(often)))
        left[own.take(at), column.take(found.take(at))] = 1
        right = np.zeros((len(often), n_docs))
        m = block.n[often]
        posting = gathered(block.postings, block.begin[often], m)
        right[np.repeat(np.arange(len(often)), m), posting & 0xFFFF] = np.repeat(weight[often], m) * (posting >> 16)
        score = left @ right
        at = np.flatnonzero(~is_dense)
        found, own = found.take(at), own.take(at)
        m, weights = block.n.take(found), weight.take(found)
        pairs = np.append(0, np.cumsum(m))
        shift = block.begin.take(found) - pairs[:-1]
        entries = np.searchsorted(own, np.arange(n_seeds + 1))
        pairs_to, first = pairs[entries], 0
        while first < n_seeds:
            last = min(max(first + 1, int(np.searchsorted(pairs_to, pairs_to[first] + MOST_PAIRS, side="right")) - 1), n_seeds)
            e, start, to = slice(entries[first], entries[last]), pairs_to[first], pairs_to[last]
            if to > start:
                at = np.repeat(shift[e], m[e])
                at += np.arange(start, to)
                posting = block.postings.take(at)
                gain = np.repeat(weights[e], m[e])
                gain *= posting >> 16
                posting &= 0xFFFF
                doc = posting.astype(np.int64)
                for seed in range(first, last):
                    own_pairs = slice(pairs_to[seed] - start, pairs_to[seed + 1] - start)
                    if own_pairs.start < own_pairs.stop:
                        score[seed] += np.bincount(doc[own_pairs], gain[own_pairs], minlength=n_docs)
            first = last
        return score

    def settle(self) -> None:
        """Takes what is new among the nearest."""
        seed, doc, score = map(np.concatenate, zip(self.best, *self.new, strict=True))
        order = np.lexsort((doc, -score, seed))
        start, n = runs(seed[order])
        rank = np.arange(len(order)) - np.repeat(start, n)
        order, rank = order[rank < ASKED], rank[rank < ASKED]
        self.best, self.new = (seed[order], doc[order], score[order]), []
        full = order[rank == ASKED - 1]
        self.least[seed[full]] = score[full]

    def nearest(self) -> pa.Table:
        self.settle()
        seed, doc, score = self.best
        return pa.table({"seed": self.seeds[seed], "doc": doc, "score": score})


def stored(folder: str) -> Iterator[dict[str, bytes]]:
    """The rows of a table of the shared folder, one after the other."""
    store, top = fs.FileSystem.from_uri(folder)
    for file in store.get_file_info(fs.FileSelector(top)):
        if file.path.endswith(".parquet"):
            with store.open_input_file(file.path) as f:
                for batch in pq.ParquetFile(f, pre_buffer=False).iter_batches(batch_size=1):
                    yield from batch.to_pylist()


def others_of(batch: pa.RecordBatch, corpus: Corpus, window: int, seeds: bool = False) -> pa.RecordBatch:
    """(row, ids) of the documents (row, ids, tie, n) that are no seeds, or of the seeds."""
    chosen = corpus.is_seed(batch.column(2).to_numpy(), batch.column(3).to_numpy() % window) == seeds
    return batch.select(["row", "ids"]).filter(pa.array(chosen))


def rows_table(rows: DataFrame) -> str:
    """The folder of a sorted table of rows, from which tasks read those of their documents."""
    folder = shared_path(rows.sparkSession, "packing-rows")
    rows.select("row").repartitionByRange("row").sortWithinPartitions("row").write.parquet(folder)
    return folder


def listed(batched: Iterator[pa.RecordBatch], folder: str | None) -> Iterator[pa.RecordBatch]:
    """The documents (row first) whose rows are in a table of rows, if there is one. Only the range of rows at hand is read."""
    if folder is None:
        yield from batched
        return
    store, top = fs.FileSystem.from_uri(folder)
    files = [x.path for x in store.get_file_info(fs.FileSelector(top)) if x.path.endswith(".parquet")]
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        low, high = (f([x(b.column(0)).as_py() for b in held]) for f, x in ((min, pc.min), (max, pc.max)))
        rows = pq.read_table(files, filesystem=store, columns=["row"], filters=[("row", ">=", low), ("row", "<=", high)])["row"] if files else pa.array([], pa.int64())
        for b in held:
            yield b.filter(pc.is_in(b.column(0), value_set=rows))
        held.clear()

    for batch in batched:
        if batch.num_rows:
            held.append(batch)
        if len(held) == LISTED:
            yield from flush()
    if held:
        yield from flush()


def removed(folder: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    store, top = fs.FileSystem.from_uri(folder)
    store.delete_dir(top)


class Index:
    """A BM25 index of all documents that are no seeds, in blocks, and its answers to seeds.

    A seed asks with all terms that it has, and is answered with the ASKED documents of the highest score; ties go to the lower
    row. How many documents hold a term is counted over the corpus: tasks sum up the terms of their documents, shards of the
    hashes sum these, and what more than one document has is stored. A group of seeds meets one block after the other and
    holds its nearest documents meanwhile, so that no scores but those of the answers leave a task. No list is cut and no pair left
    out: the work grows with the pairs of a seed and a document that share a term, which is with the square of the corpus.
    """

    def __init__(self, corpus: Corpus, window: int):
        self.corpus, self.window = corpus, window
        self.n_shards, self.bits = side(4 * corpus.ids), hash_bits(4 * corpus.ids)
        self.n_waves = min(max(1, corpus.ids // WAVE_IDS), MOST_WAVES)

    def frequencies(self, docs: DataFrame) -> str:
        """The folder of (hashes, counts): terms of more than one document, and how many have them."""
        bits, bounds = self.bits, shard_bounds(self.n_shards, self.bits)
        most = max(SENT_TERMS, self.corpus.ids // self.n_shards)

        def cut(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            hashes, counts = summed(parts)
            cuts = np.searchsorted(hashes, bounds)
            for shard, (h, c) in enumerate(zip(np.split(hashes, cuts), np.split(counts, cuts), strict=True)):
                if len(h):
                    yield from pa.table({"shard": pa.array([shard], pa.int32()), "hashes": [pack(h)], "counts": [pack_counts(c)]}).to_batches()

        def count(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget_encoder()
            parts: list[tuple[np.ndarray, np.ndarray]] = []
            for texts in stretches(batched, COUNTED_IDS):
                hashes = terms([x for _, x in texts], bits)[0]
                begin, df = runs(hashes)
                parts.append((hashes[begin], df))
                if len(parts) > 1 and sum(len(h) for h, _ in parts) > most:
                    yield from cut(parts)
                    parts = []
            if parts:
                yield from cut(parts)

        def add(table: pa.Table) -> pa.Table:
            hashes, counts = summed([(unpack(h), unpack_counts(c)) for h, c in zip(table["hashes"].to_pylist(), table["counts"].to_pylist(), strict=True)])
            often = counts > 1
            return pa.table({"hashes": [pack(hashes[often])], "counts": [pack_counts(counts[often])]}).slice(0, int(often.any()))

        folder = shared_path(docs.sparkSession, "packing-frequencies")
        sent = docs.select("row", "ids").mapInArrow(count, "shard int, hashes binary, counts binary")
        sent.groupBy("shard").applyInArrow(add, "hashes binary, counts binary").write.parquet(folder)
        return folder

    def seeds(self, docs: DataFrame, rows: str | None = None) -> DataFrame:
        """(row, ids) of the documents that are seeds, or of those of a table of rows."""
        corpus, window = self.corpus, self.window

        def choose(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget_encoder()
            for batch in listed((others_of(x, corpus, window, seeds=True) for x in batched), rows):
                yield batch

        return docs.select("row", "ids", "tie", "n").mapInArrow(choose, "row long, ids binary")

    def blocks(self, docs: DataFrame, rows: str | None = None) -> DataFrame:
        """Blocks of the documents that are no seeds, or of those of a table of rows. Few tasks make them, so that each has like documents."""
        corpus, window, bits = self.corpus, self.window, self.bits

        def scan(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget_encoder()
            for texts in stretches(listed((others_of(x, corpus, window) for x in batched), rows), max(ORDERED_IDS, BLOCK_IDS)):
                order = by_likeness([x for _, x in texts])
                ends = np.cumsum([len(texts[k][1]) for k in order])
                n_blocks = -(-int(ends[-1]) // BLOCK_IDS)
                for part in np.split(order, np.searchsorted(ends, np.arange(1, n_blocks) * (ends[-1] / n_blocks))):
                    for i in range(0, len(part), BLOCK_DOCS):
                        own = part[i : i + BLOCK_DOCS]
                        yield from pa.Table.from_pylist([Block.of([texts[k][1] for k in own], [texts[k][0] for k in own], bits)]).select(names).to_batches()

        names = ["hashes", "docs", *Block.NAMES]
        n_tasks = max(docs.sparkSession.sparkContext.defaultParallelism, self.corpus.ids // ORDERED_IDS)
        return docs.select("row", "ids", "tie", "n").coalesce(n_tasks).mapInArrow(scan, ", ".join(f"{x} binary" for x in names))

    def nearest(self, docs: DataFrame, seeds: DataFrame, frequencies: str, rows: str | None = None) -> DataFrame:
        """(seed, doc, score): of the documents that are no seeds, or of those of a table of rows, the nearest to each of `seeds` (row, ids)."""
        corpus, bits = self.corpus, self.bits
        folder = self.folder = shared_path(docs.sparkSession, "packing-index")
        self.blocks(docs, rows).write.parquet(folder)

        def match(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget_encoder()
            rows, texts = [], []
            for batch in batched:
                rows.append(batch.column(0).to_numpy())
                texts += map(as_ids, batch.column(1).to_pylist())
            if not texts:
                return
            counted = ((unpack(r["hashes"]), unpack_counts(r["counts"])) for r in stored(frequencies))
            group = Group(np.concatenate(rows), texts, corpus, bits, counted)
            del texts
            for row in stored(folder):
                group.meet(Block(row, corpus))
            yield from group.nearest().to_batches(max_chunksize=10_000)

        slots = docs.sparkSession.sparkContext.defaultParallelism
        n_groups = slots * max(1, round(self.corpus.ids / self.n_waves / GROUP_IDS / slots))
        return seeds.repartition(n_groups).mapInArrow(match, "seed long, doc long, score long")  # equally many seeds for each task

    def neighbours(self, docs: DataFrame) -> DataFrame:
        """(seed, doc, score): documents that are no seeds, by BM25. `docs` has row, tie, n and ids of each document."""
        return self.nearest(docs, self.seeds(docs), self.frequencies(docs))


def corpus_of(docs: DataFrame, window: int) -> Corpus:
    """Corpus-wide counts. What reaches the driver is a row for each length of a rest."""
    found = docs.groupBy((F.col("n") % window).alias("rest")).agg(F.count("*").alias("k"), F.sum("n").alias("ids")).collect()
    rests = np.zeros(window, np.int64)
    for r in found:
        rests[r["rest"]] = r["k"]
    longer, missing = seeds_by_length(rests, window)
    share = share_of(docs, longer, missing, int(rests[longer]), window) if missing else 0.0
    return Corpus(int(rests.sum()), sum(r["ids"] for r in found), longer, share)


def take_neighbours(near: DataFrame, rests: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Pieces (row, start, length, sequence, offset) that windows take of their seeds' neighbours, and (seed, tie, room) of the windows
    that are not full then. `rests` is (row, tie, start, rest, seed).

    In a round, each unused document goes to the one of its seeds for which it scores highest, and a window takes those that
    come to it in the order of scores while it has room; the last is cut there. Windows choose in parallel, and a window that
    loses documents to others has its next ones in the next round, until none is left to take.
    """
    free = near.join(rests.where("not seed").select(F.col("row").alias("doc"), "start", "rest"), "doc")
    free = materialize(free.where("rest > 0"), "packing-free")
    windows = materialize(rests.where("seed").select(F.col("row").alias("seed"), "tie", (F.lit(window) - F.col("rest")).alias("room")), "packing-room")
    first = Window.partitionBy("seed").orderBy(F.desc("score"), "doc").rowsBetween(Window.unboundedPreceding, -1)
    parts = []
    while True:
        best = free.join(windows.where("room > 0").drop("tie"), "seed").groupBy("doc").agg(F.max_by(F.struct("seed", "score", "start", "rest", "room"), F.struct("score", -F.col("seed"))).alias("b"))
        come = best.select("doc", "b.*").withColumn("before", F.coalesce(F.sum("rest").over(first), F.lit(0)))  # at most ASKED a seed
        took = come.where("before < room").select("doc", "start", F.expr("least(rest, room - before)").alias("length"), "seed", (window - F.col("room") + F.col("before")).alias("offset"))
        took = materialize(took, "packing-took")
        if took.isEmpty():
            break
        parts.append(took.select(F.col("doc").alias("row"), "start", "length", (F.col("seed") * 4).alias("sequence"), "offset"))
        used = took.groupBy("seed").agg(F.sum("length").alias("used"))
        windows = materialize(windows.join(used, "seed", "left").select("seed", "tie", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room")), "packing-room")
        free = materialize(free.join(took.select("doc"), "doc", "left_anti").join(windows.where("room > 0"), "seed", "left_semi"), "packing-free")
    none = rests.limit(0).select("row", "start", F.col("rest").alias("length"), F.col("row").alias("sequence"), F.col("rest").alias("offset"))
    return functools.reduce(DataFrame.unionByName, parts, none), windows


def retrieved(index: Index, docs: DataFrame, rests: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The pieces and windows of take_neighbours, when no window with room has any document left that shares a term with its seed.

    Seeds ask in waves, by a hash: each among all documents that are unused then, so that those in windows already are not scored
    again. A window that has used up a full answer asks again in the next wave, or in one more."""
    frequencies, n_waves = index.frequencies(docs), index.n_waves
    wave = F.pmod(F.xxhash64("tie", "row"), F.lit(n_waves)) if n_waves > 1 else F.lit(0)
    parts, room, k, again = [], rests, 0, None
    while True:
        asking = rests.where("seed").where(wave == k).select("row") if k < n_waves else None
        asking = again if asking is None else asking if again is None else asking.unionByName(again)
        unused = rows_table(room.where("not seed"))
        near = materialize(index.nearest(docs, index.seeds(docs, rows_table(asking)), frequencies, unused), "packing-near")
        removed(index.folder)
        taken, windows = take_neighbours(near, room, window)
        taken, windows = materialize(taken, "packing-taken"), materialize(windows, "packing-windows")
        parts.append(taken)
        cut = near.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= ASKED)
        again = materialize(windows.where("room > 0").join(cut, "seed", "left_semi").select(F.col("seed").alias("row")), "packing-again")
        k += 1
        if k >= n_waves and again.isEmpty():
            return functools.reduce(DataFrame.unionByName, parts), windows
        left = room.where("not seed").join(taken.select("row"), "row", "left_anti")
        filled = windows.select(F.col("seed").alias("row"), "tie", F.lit(0).cast("long").alias("start"), (F.lit(window) - F.col("room")).alias("rest"), F.lit(True).alias("seed"))
        room = materialize(left.unionByName(filled), "packing-rests")


def laid_out(df: DataFrame, size: str, order: list[str]) -> DataFrame:
    """Adds `begin`: the sum of `size` over all rows before, in an order. Rows are sorted by range; a task's sum is added to
    those of the tasks before it."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "packing-order")
    sums = ranged.groupBy("_part").agg(F.sum(size).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("_part", before.alias("_before"))  # a row for each task
    own = F.coalesce(F.sum(size).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn("begin", F.col("_before") + F.col("_own")).drop("_part", "_at", "_before", "_own")


def fill_rest(left: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """Pieces of what no window has taken: laid end to end it is cut where the room that is left, laid end to end too, ends.
    Then new windows follow, of which the last alone may be short. `left` is (row, tie, start, rest)."""
    left = laid_out(left, "rest", ["tie", "row"])
    rooms = laid_out(windows.where("room > 0"), "room", ["tie", "seed"]).select((F.col("seed") * 4).alias("sequence"), (F.lit(window) - F.col("room")).alias("offset"), "room", "begin")
    total, room = left.agg(F.coalesce(F.sum("rest"), F.lit(0))).first()[0], rooms.agg(F.coalesce(F.sum("room"), F.lit(0))).first()[0]
    more = left.sparkSession.range(max(0, -(-(total - room) // window)))
    more = more.select((F.col("id") * 4 + 2).alias("sequence"), F.lit(0).cast("long").alias("offset"), F.lit(window).cast("long").alias("room"), (F.lit(room) + F.col("id") * window).cast("long").alias("begin"))
    bins = lambda begin, size: F.explode(F.sequence(F.floor(begin / BIN), F.floor((begin + size - 1) / BIN))).alias("bin")
    a = left.select("row", "start", "rest", F.col("begin").alias("a"), bins(F.col("begin"), F.col("rest")))
    b = rooms.unionByName(more).select("sequence", "offset", "room", F.col("begin").alias("b"), bins(F.col("begin"), F.col("room")))
    low, high = F.greatest("a", "b"), F.least(F.col("a") + F.col("rest"), F.col("b") + F.col("room"))
    met = a.join(b, "bin").where((low < high) & (F.floor(low / BIN) == F.col("bin")))  # a pair is kept in one bin
    return met.select("row", (F.col("start") + low - F.col("a")).alias("start"), (high - low).alias("length"), "sequence", (F.col("offset") + low - F.col("b")).alias("offset"))


def packed_rests(docs: DataFrame, window: int) -> DataFrame:
    """Pieces (row, start, length, sequence, offset) of what is left of each document beyond its full windows."""
    corpus = corpus_of(docs, window)

    def flag(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched:
            row, n, tie = (batch.column(k).to_numpy() for k in range(3))
            yield pa.record_batch({"row": row, "tie": tie, "start": n - n % window, "rest": n % window, "seed": corpus.is_seed(tie, n % window)})

    rests = materialize(docs.select("row", "n", "tie").mapInArrow(flag, "row long, tie long, start long, rest long, seed boolean"), "packing-rests")
    taken, windows = retrieved(Index(corpus, window), docs, rests, window)
    seeds = rests.where("seed").select("row", "start", F.col("rest").alias("length"), (F.col("row") * 4).alias("sequence"), F.lit(0).cast("long").alias("offset"))
    used = taken.select("row", F.col("length").alias("used"))  # a document is taken once
    left = rests.where("not seed and rest > 0").join(used, "row", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    left = left.where("rest > used").select("row", "tie", (F.col("start") + F.col("used")).alias("start"), (F.col("rest") - F.col("used")).alias("rest"))
    return seeds.unionByName(taken).unionByName(fill_rest(left, windows, window))


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    A document's ids are the tokenizer's and END_ID; a null text has only that. Each full window of a long document is a
    sequence of its own. Of the rests, the longest are seeds of the other sequences, and their nearest unused neighbours of
    the whole corpus, whatever file or task they come from, follow them; see Index and take_neighbours. What is left then
    fills the rest of the windows. Every id is in one piece; pieces of one sequence lie gapless from offset 0; only the last
    sequence is short. Repeated rows are packed one by one; a null doc_id is a document; equal scores go to the row
    that is read first; other columns are left out; a very long text is encoded as one, in the memory of a task; an empty table
    gives no rows. `tokenizer` is the name of a file of the public tokenizers.
    """
    path = public_tokenizers.path(tokenizer)
    task = 1 << 33  # rows of a task are numbered from a multiple of this

    def encode(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = encoder(path)
        full = None
        for batch in by_bytes(batched, 2):
            found = shared.encode(batch.column(2))
            n = np.array([len(x) for x in found], np.int64)
            if full is None:
                full = batch.column(0)[0].as_py() // task * task
            ends = full + np.cumsum(n // window)
            yield pa.record_batch(
                {
                    "row": batch.column(0),
                    "doc_id": batch.column(1).cast(pa.int64()),
                    "tie": batch.column(3),
                    "n": n,
                    "full": ends - n // window,
                    "ids": pa.array([as_blob(x, shared.small) for x in found], pa.binary()),
                }
            )
            full = int(ends[-1])
        pa.default_memory_pool().release_unused()

    def cut(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoder()
        for batch in batches(batched, 64):
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            for doc, n, full, blob, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = as_ids(blob)
                whole = [{"start": k * window, "length": window, "sequence": 4 * (full + k) + 1, "offset": 0} for k in range(n // window)]
                for p in [*whole, *(pieces or ())]:
                    own = ids[p["start"] : p["start"] + p["length"]]
                    values = (doc, p["start"], p["length"], zlib.crc32(own.astype("<u4").tobytes()), n, p["sequence"], p["offset"], own.astype(np.int32) if with_ids else None)
                    for column, value in zip(out.values(), values, strict=True):
                        column.append(value)
            kinds = {k: pa.int64() for k in out} | {"ids": pa.list_(pa.int32())}
            yield pa.record_batch({k: pa.array(v, kinds[k]) for k, v in out.items() if k != "ids" or with_ids})

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.xxhash64("doc_id", "text").alias("tie"))
    encoded = materialize(numbered.mapInArrow(encode, "row long, doc_id long, tie long, n long, full long, ids binary"), "packing-ids")
    pieces = packed_rests(encoded, window).groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence", "offset")).alias("pieces"))
    joined = encoded.join(pieces, "row", "left").select("doc_id", "n", "full", "ids", "pieces")  # ids move once, whatever the pieces
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return joined.mapInArrow(cut, schema + (", ids array<int>" if with_ids else ""))
