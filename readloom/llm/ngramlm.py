"""LM scoring: smoothed n-grams as a weighted backoff automaton with failure arcs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import (
    TokenHashes,
    answered,
    batches,
    corpus_counts,
    hash_bits,
    mix,
    side,
    steps,
    summed,
    text_bytes,
    unpack_counts,
    utf8,
    with_block,
)

#: Words in the longest n-gram.
ORDER = 3
#: Without fitted weights, an n-gram's relative frequency has at most this weight against its suffix, ...
TRUST = 0.3
#: ... and half of it at so many occurrences of its context.
HALF = 4.0
#: Added to each token's count in the unigram estimate.
ADDED = 0.1
#: The last three bits of a hash tell the n-gram's order: 0 and 1 single tokens, then 2, 4 and, for all longer ones, 6.
KINDS, BUCKETS = 4, 48
#: Text bytes that a task puts together by block at a time.
DEALT_BYTES = 32 << 20
#: What stands before the first and after the last word; no word has a white-space character.
START, END = b" start", b" end"


@dataclass
class Grams:
    """n-grams of a block of texts, each a start mark, the words and an end mark.

    hashes[n - 1][i] is the hash of the n tokens that end at i; valid[n - 1][i] tells whether they are of one text.
    Hashes of single predicted tokens are odd, all others even; see KINDS.
    """

    hashes: list[np.ndarray]
    valid: list[np.ndarray]
    lengths: np.ndarray


def grams(texts: list[bytes], order: int = ORDER, bits: int = 64) -> Grams:
    tokens = TokenHashes()
    parts, lengths = [], []
    for text in texts:
        words = [START, *text.lower().split(), END]
        parts.append(tokens.of(words))
        lengths.append(len(words))
    sizes = np.array(lengths, np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *parts])
    depth = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = ~np.uint64(7)
    last, hashes, valid = mix(flat, 1), [], []
    for n in range(1, order + 1):
        if n > 1:
            last = mix(np.concatenate([last[:1], last[:-1]]), flat)
        hashes.append(((last >> np.uint64(64 - bits)) & kept) | ((depth > 0).astype(np.uint64) if n == 1 else np.uint64(2 * min(n - 1, KINDS - 1))))
        valid.append(depth >= n - 1)
    return Grams(hashes, valid, sizes)


def numbered(found: Grams) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct n-grams' hashes, sorted, and for each place the number of its n-gram (0 where it is not valid)."""
    flat = np.concatenate([h[v] for h, v in zip(found.hashes, found.valid, strict=True)])
    order = np.argsort(flat)
    ranked = flat[order]
    first = np.concatenate([np.ones(min(1, len(flat)), bool), ranked[1:] != ranked[:-1]])
    number = np.empty(len(flat), np.int64)
    number[order] = np.cumsum(first) - 1
    ids, at = [], 0
    for v in found.valid:
        own = np.zeros(len(v), np.int64)
        n = np.count_nonzero(v)
        own[v] = number[at : at + n]
        ids.append(own)
        at += n
    return ranked[first], ids


def trust(context: np.ndarray, half: np.ndarray | None = None) -> np.ndarray:
    """Weight of the relative frequency after a context that occurs so often; 0 for an unknown context. With a fitted
    half it nears 1 as the context's count grows."""
    return TRUST * context / (context + HALF) if half is None else context / (context + half)


def tally(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each order, how many n-grams occur once, and by the logarithm of the count how many there are and their
    occurrences. The start mark is left out: it occurs as often as the end mark, which is no context. All rows have the
    same sums at any split of the hashes, so tallies add up."""
    out = np.zeros((KINDS, 1 + 2 * BUCKETS), np.int64)
    kind = (hashes & np.uint64(7)).astype(np.int64)
    for row in range(KINDS):
        own = counts[(kind == max(1, 2 * row)) & (counts > 0)]
        bucket = np.frexp(own.astype(np.float64))[1] - 1
        out[row, 0] = np.count_nonzero(own == 1)
        out[row, 1 : 1 + BUCKETS] = np.bincount(bucket, minlength=BUCKETS)
        np.add.at(out[row, 1 + BUCKETS :], bucket, own)
    return out.reshape(-1)


def fitted_halves(tallies: np.ndarray, order: int) -> np.ndarray:
    """For contexts of 0 to order - 1 tokens, the count at which their relative frequencies have half of the weight.

    After a context of count c, c / (c + half) goes to the frequencies. half is chosen so that over the training text what
    is left to the suffixes is the Turing estimate of what is new: the share of n-grams that occur once. (n-grams that
    end in the end mark count as contexts too, one a document.)
    """
    rows = tallies.reshape(KINDS, 1 + 2 * BUCKETS)
    halves = np.full(order, HALF)
    for n in range(2, order + 1):
        below, own = rows[min(n - 2, KINDS - 1)], rows[min(n - 1, KINDS - 1)]
        number, mass = below[1 : 1 + BUCKETS], below[1 + BUCKETS :]
        count = np.divide(mass, number, out=np.ones(BUCKETS), where=number > 0)
        total = own[1 + BUCKETS :].sum()
        if not total or not mass.sum():
            continue
        new = own[0] / total
        low, high = np.log(1e-3), np.log(1e9)
        for _ in range(80):
            half = np.exp((low + high) / 2)
            if (mass * half / (count + half)).sum() < new * mass.sum():
                low = np.log(half)
            else:
                high = np.log(half)
        halves[n - 1] = np.exp((low + high) / 2)
    return halves


@dataclass
class Automaton:
    """States are the n-grams, shorter than the longest, that occur in training, and the root (0).

    An arc is an n-gram that occurs in training: from the state of its first words, over its last word, at its smoothed
    log10 probability, to the state of its longest suffix that is one. A state without an arc for a word fails to the
    state of its own longest suffix, at the logarithm of what it leaves to it. The root has an arc for any word.
    """

    arc_weight: list[float]
    arc_next: list[int]
    fail_weight: list[float]
    fail_next: list[int]
    depth: list[int]
    unknown: float

    def score(self, arcs: list[tuple[int, ...]], start: int) -> float:
        """Sum of log10 probabilities over one text. arcs has, for each token, the n-grams that end there, longest first,
        -1 for those that training lacks; start is the state of the start mark."""
        state, total, top = start, 0.0, len(arcs[0]) - 1 if arcs else 0
        weight, following, fall, below, depth = self.arc_weight, self.arc_next, self.fail_weight, self.fail_next, self.depth
        for row in arcs:
            at = depth[state]
            while at and row[top - at] < 0:
                total += fall[state]
                state = below[state]
                at = depth[state]
            arc = row[top - at]
            if arc < 0:
                total += self.unknown
                state = 0
            else:
                total += weight[arc]
                state = following[arc]
        return total


def build(found: Grams, ids: list[np.ndarray], counts: np.ndarray, n_tokens: int, n_types: int, halves: np.ndarray | None = None) -> Automaton:
    """The part of the automaton that a block's texts can reach. ids[n - 1][i] is the number, in `counts`, of the n-gram
    that ends at i (any number where it is not valid); n_tokens and n_types are the training totals;
    halves[m] is the fitted half of contexts of m tokens."""
    order, size = len(ids), len(counts)
    denominator = n_tokens + ADDED * (n_types + 1)
    prob = (counts + ADDED) / denominator
    order_of = np.zeros(size, np.int64)
    suffix = np.full(size, -1, np.int64)
    for n in range(1, order + 1):
        places = np.full(size, -1, np.int64)
        at = np.flatnonzero(found.valid[n - 1])
        places[ids[n - 1][at]] = at  # any place of an n-gram does: it has the same context and suffix in all
        own = np.flatnonzero(places >= 0)
        order_of[own] = n
        if n == 1:
            continue
        place = places[own]
        context, shorter = ids[n - 2][place - 1], ids[n - 2][place]
        weight = trust(counts[context], None if halves is None else halves[n - 1])
        seen = counts[own] > 0
        share = np.divide(counts[own], counts[context], out=np.zeros(len(own)), where=seen)
        prob[own] = weight * share + (1 - weight) * prob[shorter]
        suffix[own] = shorter
    # state of an n-gram: one more than its number; n-grams of the full order, and unknown ones, are no states
    known = counts > 0
    state = np.where(known & (order_of < order), np.arange(size) + 1, 0)
    after = np.where(order_of < order, state, np.where(suffix >= 0, state[suffix], 0))
    fail_to = np.concatenate([[0], np.where(suffix >= 0, state[suffix], 0)])
    fall = np.concatenate([[0.0], np.log10(1 - trust(counts, None if halves is None else halves[np.minimum(order_of, order - 1)]))])
    depth = np.concatenate([[0], np.where(state > 0, order_of, 0)])
    return Automaton(
        np.log10(prob).tolist(), after.tolist(), fall.tolist(), fail_to.tolist(), depth.tolist(), float(np.log10(ADDED / denominator))
    )


def held_out() -> Column:
    """Documents that take no part in training; a null id does."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))


@dataclass
class Block:
    """Documents of a block: ids (None for null), texts (null as empty) and which are held out."""

    ids: list[int | None]
    texts: list[bytes]
    held: np.ndarray

    @staticmethod
    def read(table: pa.Table) -> Block:
        """A block from its rows, each some documents of one task; see deal."""
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = []
        for row in table.to_pylist():
            own, sizes, flags = (np.frombuffer(row[k], t) for k, t in (("ids", "<i8"), ("sizes", "<i8"), ("flags", "u1")))
            data, ends = zstandard.decompress(row["texts"]), np.cumsum(sizes)
            ids += [None if f & 2 else i for i, f in zip(own.tolist(), flags.tolist(), strict=True)]
            texts += [data[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            held.append((flags & 1) > 0)
        return Block(ids, texts, np.concatenate(held) if held else np.zeros(0, bool))


def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (block, doc_id, text, held_out) of a task put together by block and compressed, DEALT_BYTES at a time."""
    held: dict[int, list[tuple[int | None, bytes, bool]]] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        out: dict[str, list] = {"block": list(held), "ids": [], "sizes": [], "flags": [], "texts": []}
        for own in held.values():
            out["ids"].append(np.array([i or 0 for i, _, _ in own], "<i8").tobytes())
            out["sizes"].append(np.array([len(x) for _, x, _ in own], "<i8").tobytes())
            out["flags"].append(np.array([h + 2 * (i is None) for i, _, h in own], "u1").tobytes())
            out["texts"].append(zstandard.compress(b"".join(x for _, x, _ in own), 1))
        return pa.record_batch({k: pa.array(v, pa.int32() if k == "block" else pa.binary()) for k, v in out.items()})

    for batch in batches(rows):
        for block, doc, text, held_out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            held.setdefault(block, []).append((doc, text, held_out))
            size += len(text)
        if size >= DEALT_BYTES:
            yield flush()
            held, size = {}, 0
    yield flush()


def ask(block: Block, order: int = ORDER, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct n-grams, and how often its training documents have each."""
    texts, held = block.texts, block.held
    parts = []
    for begin, end in steps(texts):
        found = grams(texts[begin:end], order, bits)
        trains = np.repeat(~held[begin:end], found.lengths)
        hashes, ids = numbered(found)
        counts = np.zeros(len(hashes), np.int64)
        for own, v in zip(ids, found.valid, strict=True):
            counts += np.bincount(own[v & trains], minlength=len(hashes))
        parts.append((hashes, counts))
    return summed(parts)


def score_block(block: Block, answers: pa.Table, order: int = ORDER, bits: int = 64, fitted: bool = True) -> dict[str, list]:
    """Scores of a block's texts, from the corpus counts of its n-grams."""
    texts, counts = block.texts, answered(answers)
    tallies = sum(unpack_counts(x) for x in answers["tally"].to_pylist())
    single = tallies.reshape(KINDS, 1 + 2 * BUCKETS)[0]
    n_types, n_tokens = int(single[1 : 1 + BUCKETS].sum()), int(single[1 + BUCKETS :].sum())
    halves = fitted_halves(tallies, order) if fitted else None
    stretches = list(steps(texts))
    known = ask(block, order, bits)[0] if len(stretches) > 1 else None
    out: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
    for begin, end in stretches:
        found = grams(texts[begin:end], order, bits)
        hashes, ids = numbered(found)
        own = counts if known is None else counts[np.searchsorted(known, hashes)]
        score_texts(found, ids, own, n_tokens, n_types, halves, out)
    out["train_tokens"] = [n_tokens] * len(texts)
    return out


def score_texts(found: Grams, ids: list[np.ndarray], counts: np.ndarray, n_tokens: int, n_types: int, halves: np.ndarray | None, out: dict[str, list]) -> None:
    """Adds the scores of some texts to `out`."""
    automaton = build(found, ids, counts, n_tokens, n_types, halves)
    usable = [np.where(v & (counts[i] > 0), i, -1) for i, v in zip(ids, found.valid, strict=True)]
    single = counts[ids[0]]
    base = np.log10((single + ADDED) / (n_tokens + ADDED * (n_types + 1)))
    ends = np.cumsum(found.lengths)
    for begin, end in zip(ends - found.lengths, ends, strict=True):
        start = int(usable[0][begin]) + 1
        arcs = list(zip(*(u[begin + 1 : end].tolist() for u in reversed(usable)), strict=True))
        out["n_tokens"].append(int(end - begin - 1))
        out["n_known"].append(int(np.count_nonzero(single[begin + 1 : end])))
        out["base_score"].append(float(base[begin + 1 : end].sum()))
        out["score"].append(automaton.score(arcs, start))


def score_documents(docs: DataFrame, order: int = ORDER, fitted: bool = True) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of `docs`.

    Tokens are the words, A-Z lower-cased, and one end mark; a null text has just that. Counts are of all rows that are
    not held out, repeated rows included. p(w | h) = t(h) c(h w) / c(h) + (1 - t(h)) p(w | shorter h), down to the
    unigram estimate of base_score, so the words and one unknown share a probability of 1 after any context. t(h) follows
    from c(h), by fixed values or, `fitted`, by values that the corpus counts give for each order. Rows of one doc_id are
    scored one by one; a null doc_id is not held out; other columns are left out; a very long text is one text of its block,
    whose memory it takes; an empty table gives no rows.

    Documents are dealt into blocks by hash. Blocks ask the shards of the corpus counter for their n-grams, build the
    part of the automaton that their texts can reach, and score; no task or driver has the whole model.
    """
    size = text_bytes(docs)
    n, bits = side(size), hash_bits(size)
    rows = with_block(docs.select("doc_id", "text", held_out().alias("held_out")), "doc_id", n)
    blocked = rows.select("block", F.col("doc_id").cast("long"), "text", "held_out").mapInArrow(deal, "block int, ids binary, sizes binary, flags binary, texts binary")
    answers = corpus_counts(blocked, lambda table: ask(Block.read(table), order, bits), n, bits, tally)

    def score(_: tuple, own: pa.Table, counts: pa.Table) -> pa.Table:
        block = Block.read(own)
        found = score_block(block, counts, order, bits, fitted)
        return pa.table(
            {"doc_id": pa.array(block.ids, pa.int64()), "held_out": pa.array(block.held)}
            | {k: pa.array(found[k], pa.int64()) for k in ("n_tokens", "n_known", "train_tokens")}
            | {k: pa.array(found[k], pa.float64()) for k in ("base_score", "score")}
        )

    return (
        blocked.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
