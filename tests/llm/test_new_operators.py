"""Vector codes, conversation repair and token files against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from readloom.llm import packing, queries, tokenfile, turnrepair, vectorcodes
from readloom.llm.common import shared_path

VECTORS = "vec_id long, embedding array<double>, label int"
TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"


# --- vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """Codes by comparing every part with every entry."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // parts)
    ints = [[math.floor(1024 * x) for x in r[1]] + [0] * (width * parts - len(r[1])) for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, [*kept[i][1]]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(book))
    books = [[cut(ints[i], p) for i in order[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            members: dict[int, list] = {}
            for v in ints:
                members.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, own in members.items():
                books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out, labels = [], {}
    for r, v in zip(kept, ints, strict=True):
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        labels[r[2]] = labels.get(r[2], 0) + error
        out.append((r[0], "".join(f"{k:02x}" for _, k in found), error, r[2]))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, labels[x]) for i, c, e, x in out), key=str), sha


def coded(df, **more):
    found = vectorcodes.compress_vectors(df, **more)
    return sorted(((r[0], r[1], r[2], r[3]) for r in found.rows.select("vec_id", "code", "error", "label_error").collect()), key=str), found.sha256


def test_codes_equal_plain(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.01, 3)).tolist(), int(rng.integers(3)) if i % 5 else None) for i in range(60)]
    rows += [(7, rows[7][1], 1), (7, rows[8][1], 1), (None, rows[9][1], 2), (90, rows[3][1], None)]  # repeated ids and vectors
    rows += [(100, None, 1), (101, [0.0] * 7 + [None], 1), (102, [math.nan] + [0.0] * 7, 1), (103, [math.inf] * 8, 2)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("code", F.lit("x")).withColumn("_id", F.lit(1)).repartition(5)
    assert coded(df, entries=16) == plain_codes(rows, entries=16)
    assert coded(df) == plain_codes(rows)


def test_codes_of_odd_vectors(spark):
    rows = [(1, [1.0, 2.0, 3.0], 1), (2, [], 1), (3, [0.5] * 6, None), (4, [-1e9, 1e9], 2), (5, [3e5] * 5, 2)]
    assert coded(spark.createDataFrame(rows, VECTORS)) == plain_codes(rows)
    assert coded(spark.createDataFrame([], VECTORS)) == ([], hashlib.sha256(b"").hexdigest())
    assert coded(spark.createDataFrame([(1, None, 1)], VECTORS))[0] == []


@pytest.mark.parametrize("spread", [1, 100])
def test_annuli_hold_the_nearest(spread):
    rng = np.random.default_rng(spread)
    entries = (rng.normal(size=(200, 4)) * rng.uniform(1, 1000, (200, 1)) * spread).astype(np.int64)
    entries[50] = entries[20]  # a tie
    parts = np.concatenate([entries[::3], -entries[::3], (rng.normal(size=(500, 4)) * 500 * spread).astype(np.int64)])
    looked: list[int] = []
    code, error = vectorcodes.Codebook.of(entries).nearest(parts, looked)
    squares = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
    assert (code == squares.argmin(1)).all() and (error == squares.min(1)).all()
    assert sum(looked) < 0.7 * squares.size  # the pruning prunes


def test_decoded_vectors(spark, sf_dir):
    df = queries.table(spark, sf_dir, "embeddings")
    found = vectorcodes.compress_vectors(df)
    for r in found.rows.join(df, "vec_id").limit(20).collect():
        ints = [math.floor(1024 * x) for x in r["embedding"]]
        assert sum((a - b) ** 2 for a, b in zip(ints, found.decode(r["code"]), strict=True)) == r["error"]


# --- conversation repair


def plain_faults(turns):
    """(role, text, fault) of sorted turns."""
    seen, out = set(), []
    for role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain_repair(turns):
    """(cost, audit, repaired) by trying all edits."""
    turns = plain_faults(turns)
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    best = None
    for edits in itertools.product("KDua", repeat=len(turns)):
        if any(f in ("blank", "duplicate") and e != "D" for e, (_, _, f) in zip(edits, turns, strict=True)):
            continue
        for added in itertools.product(inserts, repeat=len(turns) + 1):
            cost, audit, out = 0, "", []
            for k in range(len(turns) + 1):
                cost, audit, out = cost + 3 * len(added[k]), audit + "I" * len(added[k]), out + [(r, "") for r in added[k]]
                if k == len(turns):
                    break
                role, text, fault = turns[k]
                if edits[k] == "D":
                    cost, audit = cost + 4, audit + "D"
                    continue
                cost += 3 * (fault == "truncated") + 3 * (edits[k] != "K")
                audit += "K" if edits[k] == "K" else "R"
                out = out + [({"K": role, "u": "user", "a": "assistant"}[edits[k]], text)]
            initials = "".join((r[:1] or "-") for r, _ in out)
            if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, out
    return best


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_summary(rows, original=None):
    """What the query returns for turns after damage, by conversation; costs by a fold over whole conversations in Python."""
    out = {}
    for conv in {r[0] for r in original or rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        turns = plain_faults([(r[2], r[3]) for r in own])
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        ways = {"e": (0, "", [])}

        def widen(ways):
            for y, froms in (("u", "esa"), ("a", "u")):
                found = [(ways[x][0] + 3, ways[x][1] + "I", ways[x][2] + [({"u": "user", "a": "assistant"}[y], "")]) for x in froms if x in ways]
                if found + ([ways[y]] if y in ways else []):
                    ways[y] = min(found + ([ways[y]] if y in ways else []), key=lambda w: w[:2])
            return ways

        for role, text, fault in turns:
            widen(ways)
            new = {x: [(c + 4, a + "D", o)] for x, (c, a, o) in ways.items()}
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                for y, froms in (("s", "e"), ("u", "esa"), ("a", "u")):
                    for x in froms:
                        if x in ways and (role[:1] == y or y != "s"):
                            c, a, o = ways[x]
                            kept = role[:1] == y
                            shown = role if kept else {"u": "user", "a": "assistant"}[y]
                            new.setdefault(y, []).append((c + more + (0 if kept else 3), a + ("K" if kept else "R"), o + [(shown, text)]))
            ways = {x: min(w, key=lambda v: v[:2]) for x, w in new.items()}
        widen(ways)
        cost, audit, repaired = min((ways[x] for x in "ea" if x in ways), key=lambda w: w[:2])
        faults = [sum(t[2] == f for t in turns) for f in ("blank", "duplicate", "truncated")]
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (gaps, *faults, illegal, cost, audit, sha)
    return out


def summary_of(found):
    return {r["conv_id"]: tuple(r)[1:] for r in found.select(turnrepair.COLUMNS).collect()}


POOL = [("user", "Hi."), ("assistant", "Yes."), ("system", "Be kind."), ("user", "cut"), ("assistant", "off"), ("tool", "x!"), ("", "?"), ("assistant", " "), ("user", "More?"), ("usher", "So!")]


def test_cheapest_edits_equal_all_edits(spark):
    rng = np.random.default_rng(3)
    chosen = [[POOL[k] for k in rng.integers(len(POOL), size=rng.integers(0, 4))] for _ in range(60)]
    rows = [(c, t, role, text) for c, turns in enumerate(chosen) for t, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, TURNS)
    repairs = turnrepair.repair_conversations(df)
    found = {r["conv_id"]: (r["cost"], r["audit"]) for r in repairs.summary.collect()}
    out: dict[int, list] = {}
    for r in repairs.turns.orderBy("conv_id", "segment", "n").collect():
        out.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for c, turns in enumerate(chosen):
        if turns:
            cost, audit, repaired = plain_repair(turns)
            assert (found[c], out.get(c, [])) == ((cost, audit), repaired), turns


@pytest.mark.parametrize("long", [1, 3, turnrepair.LONG])
def test_summaries_equal_plain(spark, long):
    """Null ids and numbers, repeated numbers and turns, empty and long texts; by segments of few turns as in one piece."""
    rng = np.random.default_rng(long)
    rows = [(int(c) if c < 9 else None, int(t) if t < 9 else None, *POOL[k]) for c, t, k in rng.integers(0, 10, (160, 3))]
    rows += [(20, t, *POOL[t % 3]) for t in range(40)] + [(21, 0, "user", "word " * 20_000), (22, 5, "system", "Only."), (23, None, "user", "")]
    rows += [(24, t, "user", "Same.") for t in range(9)]  # one text, again and again
    df = spark.createDataFrame(rows, TURNS).withColumn("cost", F.lit(1)).withColumn("n", F.lit("x")).repartition(4)
    repairs = turnrepair.repair_conversations(df, long)
    assert summary_of(repairs.summary) == plain_summary(rows)
    lines: dict = {}
    for r in repairs.turns.orderBy("segment", "n").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    shas = {r["conv_id"]: r["repaired_sha256"] for r in repairs.summary.collect()}
    assert {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in shas} == shas


def test_repair_query(spark, sf_dir):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert summary_of(queries.op12_turn_repair(spark, sf_dir)) == plain_summary(plain_damage(rows), rows)


def test_damage_of_nulls_and_empty_table(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2) for t in (None, *range(30)) for r, x in ((None, None), ("user", "A. B!"))]
    found = turnrepair.damage(spark.createDataFrame(rows, TURNS)).where("not gone").collect()
    assert sorted((tuple(r)[:4] for r in found), key=str) == sorted(plain_damage(rows), key=str)
    assert turnrepair.repair_conversations(turnrepair.damage(spark.createDataFrame([], TURNS))).summary.collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    out = turnrepair.repair_conversations(turnrepair.damage(spark.createDataFrame([(5, gone, "user", "Hi.")], TURNS))).summary
    assert summary_of(out) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# --- token files


def plain_crc32c(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    assert tokenfile.crc32c([b"123456789"]).tolist() == [0xE3069283]
    rng = np.random.default_rng(0)
    parts = [rng.bytes(n) for n in (0, 1, 63, 64, 65, 128, 700, 5000, 0, 4096, 64 * 63)]
    assert tokenfile.crc32c(parts).tolist() == [plain_crc32c(x) for x in parts]
    assert tokenfile.crc32c([]).tolist() == []


def plain_records(data):
    """Records of a file, one after the other, by its framing alone."""
    at = 0
    while at < len(data):
        n, a = struct.unpack_from("<QI", data, at)
        part = data[at + 12 : at + 12 + n]
        (b,) = struct.unpack_from("<I", data, at + 12 + n)
        mask = lambda x: (((plain_crc32c(x) >> 15) | (plain_crc32c(x) << 17)) + 0xA282EAD8) & 0xFFFFFFFF
        assert (a, b) == (mask(data[at : at + 8]), mask(part))
        yield part
        at += 16 + n


ROWS = [(3, "The end."), (1, None), (2, ""), (None, "no id"), (9, "café 你好 123 " * 40), (1, "again"), (9, "b"), (9, "b"), (-4, "negative id")]


def plain_tokens(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [(d, [*tokenizer.encode(x or "", add_special_tokens=False).ids, 1]) for d, x in rows]


def test_files_round_trip(spark):
    df = spark.createDataFrame(ROWS, DOCS).withColumn("start", F.lit("x")).withColumn("tie", F.lit(0)).repartition(3)
    folder = shared_path(spark, "tokens-test")
    files = tokenfile.write_files(df, folder, file_bytes=1)
    listed = files.orderBy("start").collect()
    held = []
    for f in listed:
        with open(f["path"], "rb") as a, open(f["path"] + ".index", "rb") as b:
            data, index = a.read(), b.read()
        held += [tokenfile.parse_sequence(x) for x in plain_records(data)]
        with open(f["path"], "rb") as a:
            by_number = tokenfile.RecordFile(a, index)
            backwards = [by_number[k] for k in reversed(range(len(by_number)))]
        assert [(d, x.tolist()) for d, x in backwards[::-1]] == [(d, x.tolist()) for d, x in held[-len(backwards) :]]
    want = plain_tokens(ROWS)
    assert sorted(((d, x.tolist()) for d, x in held), key=str) == sorted(want, key=str)
    ids = [d for d, _ in held]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    out = tokenfile.read_files(files, folder).orderBy("start").collect()
    assert [(r["doc_id"], r["ids"]) for r in out] == [(d, x.tolist()) for d, x in held]
    assert [r["start"] for r in out] == [sum(len(x) for _, x in held[:k]) for k in range(len(held))]
    for seed in (0, 1):
        other = tokenfile.read_shuffled(files, folder, seed)
        assert sorted(map(str, other.collect())) == sorted(map(str, out))
        place = [r["start"] for r in other.collect()]
        assert place == [r["start"] for r in tokenfile.read_shuffled(files, folder, seed).collect()] and place != sorted(place)


def test_broken_records_are_errors():
    good = tokenfile.framed([tokenfile.sequence(1, np.arange(5, dtype=np.uint32), 2)])[0]
    assert tokenfile.parse_sequence(tokenfile.unframed([good])[0])[1].tolist() == [0, 1, 2, 3, 4]
    for k in (0, 9, 14, len(good) - 1):
        with pytest.raises(ValueError):
            tokenfile.unframed([good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :]])
    wide = tokenfile.sequence(None, np.array([1 << 20], np.uint32), 4)
    assert tokenfile.parse_sequence(wide)[0] is None and tokenfile.parse_sequence(wide)[1].tolist() == [1 << 20]


def test_token_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    want, start = [], 0
    for d, ids in plain_tokens(sorted(rows)):
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op13_token_files(spark, sf_dir).collect()) == want


def test_ids_of_odd_texts():
    """The encoder gives the tokenizer's ids, whatever the letters, case, punctuation and white space, and however they are dealt."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, shared = Tokenizer.from_file(path), packing.encoder(path)
    signs = [*"abcXYZ'.,!?-_ \t\n\x0b\r\x1c\x85\u00a0\u2003\u0130\u03a3\u03c3\u03c2\u00e9\u00c4\u00df\u1e9e\u01c5J\u030c\u0301中文\u1100\u1161१5\u00b2\x00\u212b\u0345#\"\\|", "'s", "</w>", "<|endoftext|>", "the ", "Word, ", "ΑΣ "]
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 50)))) for _ in range(2000)] + ["", None]
    want = [[*tokenizer.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]
    assert [x.tolist() for x in shared.encode(pa.array(texts, pa.string()))] == want
    assert shared.encode(pa.array([], pa.string())) == []
    rows = pa.record_batch({"n": range(len(texts)), "text": texts})
    for limit in (1, 3000):
        dealt = list(packing.by_bytes(iter([rows.slice(0, 7), rows.slice(7)]), 1, limit))
        assert len(dealt) > 1 and pa.Table.from_batches(dealt).equals(pa.Table.from_batches([rows]))


def test_no_documents(spark):
    assert tokenfile.encode_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_empty_tables(spark, tmp_path):
    """Operators and the pipeline over tables without rows: no rows, and the columns that they have else."""
    for name, schema in {
        "documents": "doc_id long, text string, lang string, source string, n_chars long",
        "labels": "doc_id long, quality int, toxic int",
        "pages": "page_id long, url string, html string",
        "benchmark": "item_id long, text string",
        "embeddings": "vec_id long, embedding array<float>, label int",
        "conversations": "conv_id long, turn long, role string, text string",
    }.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in queries.QUERIES.items():
        found = query(spark, str(tmp_path))
        assert found.collect() == [] and len(found.columns) >= 3, name
