"""MD, XD and NM of a batch of reads in one pass over their bases, in numpy: the same as md_tag, xd_from_md and nm_tag of alignment."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions.alignment import ALIGNED, ON_READ, ON_REFERENCE

#: Bases that are compared at a time; a read may have more.
BASES_AT_ONCE = 1 << 18
TAGS = pa.struct([("md", pa.string()), ("xd", pa.string()), ("nm", pa.int64())])
_MATCH, _GONE = ord("="), 0
_TENS = 10 ** np.arange(18)


def compared(ops: Column, seq: Column, ref: Column) -> Column:
    """struct<md, xd, nm>; null where one of the three is. Not deterministic to Spark, so that a filter on what it gives has it made once."""
    return F.arrow_udf(_tags_of, "struct<md:string,xd:string,nm:bigint>").asNondeterministic()(ops, seq, ref)


def _tags_of(ops: pa.Array, seq: pa.Array, ref: pa.Array) -> pa.Array:
    known = pc.and_(pc.and_(pc.is_valid(ops), pc.is_valid(seq)), pc.is_valid(ref)).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(known)
    ops, seq, ref = (x.take(pa.array(at)) for x in (ops, seq, ref))
    size = np.cumsum((pc.binary_length(seq).to_numpy(zero_copy_only=False) + pc.binary_length(ref).to_numpy(zero_copy_only=False)).astype(np.int64))
    made, done = [], 0
    while done < len(at):
        stop = max(done + 1, int(np.searchsorted(size, (size[done - 1] if done else 0) + BASES_AT_ONCE, "right")))
        made.append(_compare(*(x.slice(done, stop - done) for x in (ops, seq, ref))))
        done = stop
    whole = pa.concat_arrays(made) if made else pa.array([], TAGS)
    back = np.cumsum(known) - 1
    return whole.take(pa.array(np.where(known, back, 0), mask=~known))


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A value for each character of texts, and the number of these in each."""
    if pc.all(pc.equal(pc.binary_length(column), pc.utf8_length(column))).as_py() is not False:
        text = "".join(column.to_pylist()).encode()
        return np.frombuffer(text, np.uint8), pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32), pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _before(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def _taken(flat: np.ndarray, at: np.ndarray, size: np.ndarray, offset: np.ndarray, n: np.ndarray, none: int) -> np.ndarray:
    """n characters from an offset on, of texts that begin at `at` and have a size, one stretch behind the other; `none` behind a text's end."""
    held = np.clip(size - offset, 0, n)
    if (held == n).all():
        return flat[_spread(at + offset, n)]
    out = np.full(int(n.sum()), none, flat.dtype)
    out[_spread(_before(n), held)] = flat[_spread(at + np.minimum(offset, size), held)]
    return out


def _compare(ops: pa.Array, seq: pa.Array, ref: pa.Array) -> pa.Array:
    rows = len(ops)
    (read, n_read), (base, n_base) = _letters(seq), _letters(ref)
    read_at, base_at = _before(n_read), _before(n_base)
    n_ops = pc.list_value_length(ops).to_numpy(zero_copy_only=False).astype(np.int64)
    held = ops.flatten()
    row, length = np.repeat(np.arange(rows), n_ops), pc.struct_field(held, "len").to_numpy(zero_copy_only=False).astype(np.int64)
    op = pc.struct_field(held, "op").dictionary_encode()
    names, kind = op.dictionary.to_pylist(), op.indices.to_numpy(zero_copy_only=False)
    among = lambda which: np.array([o in which for o in names], bool)[kind]

    def passed(which: str) -> np.ndarray:
        """What operations use of a read or the reference before each of a row's operations."""
        used = np.where(among(which), length, 0)
        total = _before(used)
        first = np.minimum(_before(n_ops), max(len(total) - 1, 0))
        return total - np.repeat(total[first], n_ops) if len(total) else total

    on_ref, on_read = passed(ON_REFERENCE), passed(ON_READ)
    aligned, gone = among(ALIGNED), among("D")
    n_events = np.where(aligned, length, np.where(gone, 1, 0))
    event_at, n = _before(n_events), np.where(aligned, length, 0)
    there = _taken(base, base_at[row], n_base[row], on_ref, n, ord("N"))
    here = _taken(read, read_at[row], n_read[row], on_read, n, 0)
    matched = np.where(there == here, np.array(_MATCH, base.dtype), there)
    if gone.any():
        events = np.zeros(int(n_events.sum()), base.dtype)  # `=`, the reference base, or _GONE for a deletion
        events[_spread(event_at, n)] = matched
        events[event_at[gone]] = _GONE
    else:
        events = matched
    is_gone = np.zeros(len(events), bool)
    is_gone[event_at[gone]] = True
    # a token for each event that is no match, of the matches before it and what it is, and one for the matches at a row's end
    row_events = np.bincount(row, n_events, rows).astype(np.int64)
    row_at = _before(row_events)
    at = np.flatnonzero((events != _MATCH) | is_gone)
    per_row = np.diff(np.searchsorted(at, np.append(row_at, len(events))))
    at_row = np.repeat(np.arange(rows), per_row)
    last = np.concatenate([[-1], at])  # the event before each, of any row
    run = at - np.maximum(last[:-1] + 1, row_at[at_row])
    end_run = row_at + row_events - np.maximum(last[np.cumsum(per_row)] + 1, row_at)
    token, end_token = np.arange(len(at)) + at_row, np.cumsum(per_row) + np.arange(rows)
    runs = np.empty(len(at) + rows, np.int64)
    runs[token], runs[end_token] = run, end_run
    # what deletions take from the reference, as far as it goes
    lost_row = row[gone]
    lost = np.clip(n_base[lost_row] - on_ref[gone], 0, length[gone])
    lost_bases = base[_spread(base_at[lost_row] + np.minimum(on_ref[gone], n_base[lost_row]), lost)]
    gone_token, other_token, others = token[is_gone[at]], token[~is_gone[at]], events[at[~is_gone[at]]]
    odd = bool(len(base)) and bool((((base >= 48) & (base <= 57)) | (base == ord("^"))).any())

    most, long_runs = int(runs.max(initial=0)), np.flatnonzero(runs > 9)

    def text(zeros: bool, close: bool) -> pa.Array:
        width = np.ones(len(runs), np.int64) if zeros else (runs > 0).astype(np.int64)
        for least in _TENS[1:]:
            if least > most:
                break
            width[long_runs] += runs[long_runs] >= least
        shown = width > 0
        digits = width.copy()
        width[other_token] += 1
        width[gone_token] += 1 + lost + int(close)
        ends = np.cumsum(width)
        behind = ends - width + digits
        out = np.zeros(int(ends[-1]) if len(ends) else 0, base.dtype)
        out[behind[shown] - 1] = runs[shown] % 10 + 48
        at_digit, rest = behind[long_runs] - 2, runs[long_runs] // 10
        while len(rest):
            out[at_digit] = rest % 10 + 48
            more = rest > 9
            at_digit, rest = at_digit[more] - 1, rest[more] // 10
        out[behind[other_token]] = others
        out[behind[gone_token]] = ord("^")
        out[_spread(behind[gone_token] + 1, lost)] = lost_bases
        if close:
            out[behind[gone_token] + 1 + lost] = ord("$")
        cuts = [0, *ends[end_token].tolist()]
        if out.dtype == np.uint32:
            cuts, whole = [4 * c for c in cuts], out.tobytes()
            return pa.array([whole[a:b].decode("utf-32-le") for a, b in zip(cuts, cuts[1:], strict=False)], pa.string())
        return pa.StringArray.from_buffers(rows, pa.py_buffer(np.array(cuts, np.int32)), pa.py_buffer(out))

    md = text(True, False)
    xd = pa.array([_xd(m) for m in md.to_pylist()], pa.string()) if odd else text(False, True)
    changed = np.bincount(at_row[~is_gone[at]][others != ord("^")], minlength=rows)
    nm = changed + np.bincount(row, np.where(among("ID"), length, 0), rows).astype(np.int64)
    return pa.StructArray.from_arrays([md, xd, pa.array(nm.astype(np.int64))], fields=list(TAGS))


def _xd(md: str) -> str:
    closed = re.sub(r"(\^[^0-9]*)(?=[0-9])", r"\1$", md)
    return re.sub(r"(?<![0-9])0(?![0-9])", "", closed)
