"""Text operators against plain versions of their contracts, on small and on odd inputs."""

from __future__ import annotations

import hashlib
import re
import time
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from readloom.llm import common, decontam, htmltext, langid, licenses, linededup, neardup, ngramlm, packing, quality, queries, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = "\x20\x09-\x0d"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SAME = "the very same line in three documents"

ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \t\n ", "en", "s", 4),
    (4, "word", "en", "s", 4),
    (5, f"{SAME}\nown line of five alone", "en", "s", 1),
    (6, f"  {SAME.upper()}  \nanother line of six alone\n{SAME}", "en", "s", 1),
    (7, f"{SAME}\n{SAME}\nlast of them", None, "s", 1),
    (8, "öä ß É K ﬁ  nbsp Σας\r\nİstanbul I'm don't 42, <|endoftext|>", "de", "s", 1),
    (9, "a b c d e f g h " * 40, "en", "s", 1),
    (10, " ".join(f"w{i}" for i in range(30_000)), "en", "s", 1),
    (11, " ".join(f"w{i}" for i in range(30_000)), "en", "s", 1),
    (None, "no id here but some words in it", "en", "s", 1),
    (12, "12345 !!! 678", "en", "s", 1),
    (12, "12345 !!! 678", "en", "s", 1),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


def split_words(text):
    return re.findall(f"[^{SPACE}]+", text or "")


# --- op1


def base(text):
    words = split_words(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if split_words(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_quality_base(request, spark, which):
    df = request.getfixturevalue(which)
    labels = spark.createDataFrame([(4, 1, 0), (9, 1, 0), (10, 1, 0), (None, 1, 0)], "doc_id long, quality long, toxic long")
    got = rows(quality.quality_rules(df, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
    want = Counter((r.doc_id, *base(r.text)) for r in df.collect())
    assert Counter(r[:6] for r in got) == want
    for r in got:
        assert r[6] == (r[1] < 20 or 100 * r[5] > 30 * r[1])
        assert not (r[6] and r[7])


def test_quality_verdict(spark, sf_dir):
    got = queries.op1_quality_rules(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rates = {r.quality: r.kept for r in got.join(labels, "doc_id").where("n_words >= 20").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rates[1] > 0.9 and rates.get(0, 0) < 0.5


def test_quality_ratio_is_that_of_plain_counts(spark):
    texts = ["good words are good words indeed " * 5, "bad!! words!! are!! bad!! " * 6, "good things are words " * 6]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (2, 1, 0)], "doc_id long, quality long, toxic long")
    learns = [r.doc_id for r in quality.trusted_sample(labels).where("not calibrates").collect()]
    tokens = quality.TokenHashes()
    found = [quality.buckets(tokens.of(t.encode().split())) for t in texts]
    size = 1 << quality.BITS
    raw = np.log(np.bincount(np.concatenate(found), minlength=size) + 1.0)
    raw -= np.log(np.exp(raw).sum())
    own = np.concatenate([np.zeros(0, np.int64), *(found[i] for i in learns)])
    target = np.log(np.bincount(own, minlength=size) + 1.0)
    target -= np.log(np.exp(target).sum())
    got = {r.doc_id: r.llr for r in quality.quality_rules(df, labels).collect()}
    for i, f in enumerate(found):
        assert got[i] == pytest.approx((target - raw)[f].mean())


def test_quality_learns_from_all_trusted_labels(spark):
    n = 20_050
    df = spark.range(n).selectExpr("id as doc_id", "concat(repeat('same words ', 12), 'own', id) as text")
    labels = spark.range(n).selectExpr("id as doc_id", "1L as quality", "0L as toxic")
    trusted = quality.trusted_labels(labels)
    assert trusted.count() == n
    teach = trusted.where("not calibrates").count()
    tokens = quality.TokenHashes()
    common = [quality.buckets(tokens.of(b"same words".split() * 12))]
    got = {r.bucket: r.n for r in quality.bucket_counts(df.join(trusted.where("not calibrates"), "doc_id")).collect()}
    assert all(got[b] >= 11 * teach for b in common[0].tolist())
    out = quality.quality_rules(df, labels).join(trusted.where("calibrates"), "doc_id").select("llr", "threshold").toPandas()
    assert len(out) == n - teach and out["threshold"].nunique() == 1
    assert out["threshold"][0] == pytest.approx(np.quantile(out["llr"], quality.LOSS), abs=1e-12)


@pytest.mark.parametrize("share", [0.0, 0.002, 0.37, 0.5, 1.0])
def test_percentile_is_exact(spark, share):
    rng = np.random.default_rng(2)
    for values in ([], [3.5], [2.0] * 50, [-1.0, 4.0], np.round(rng.normal(size=700), 2).tolist(), (rng.normal(size=501) ** 9).tolist()):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        assert quality.percentile(df, "v", share, 8) == df.agg(F.percentile("v", share)).first()[0]


# --- op2


def test_license_scan_finds_templates_and_nothing_else(spark):
    mit = licenses.TEMPLATES["MIT"]
    noise = "some invented prose that has nothing to do with any of this and goes on for a while"
    data = [
        (1, f"{noise}\nReleased under the MIT License.\n{noise}"),
        (2, f"{noise} {mit} {noise}"),
        (3, mit.replace("free of charge", "gratis").upper()),
        (4, noise),
        (5, None),
        (6, "License"),
    ]
    got = {r.doc_id: {m.license: m.dice for m in r.matches} for r in licenses.scan_licenses(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[1] == {"MIT-line": 1.0}
    assert got[2]["MIT"] == 1.0
    assert 0.9 < got[3]["MIT"] < 1.0
    assert got[4] == got[5] == got[6] == {}


def test_license_scan_is_exhaustive(docs):
    """No stretch of at most 40 words reaches the threshold in a text that the scan leaves out."""
    scanner = licenses.LicenseScanner(licenses.TEMPLATES)
    short = {n: b for n, b in zip(scanner.names, scanner.bags, strict=True) if len(b) < 20}
    tokens = licenses.TokenHashes()
    for r in docs.where("length(text) < 700").limit(60).collect():
        grams = licenses.bigrams(licenses.normalised(r.text), tokens)
        found = {m[0] for m in scanner.scan(grams)}
        for name, bag in short.items():
            least = max(
                (licenses.dice(grams[i:j], bag) for i in range(len(grams)) for j in range(i + 1, min(len(grams), i + 2 * len(bag)) + 1) if grams[i] in bag),
                default=0.0,
            )
            assert (name in found) == (least >= scanner.threshold)


@pytest.mark.parametrize("name", ["MIT", "Apache-2.0-notice", "GPL-3.0"])
def test_license_scan_finds_a_text_that_stands_twice(name):
    scanner = licenses.LicenseScanner(licenses.TEMPLATES)
    text = licenses.normalised(licenses.TEMPLATES[name])
    for gap in range(0, 301, 50):
        words = [b"before", *text, *(b"w%d" % i for i in range(gap)), *text, b"after"]
        found = {m[0]: m for m in scanner.scan(licenses.bigrams(words, licenses.TokenHashes()))}
        assert found[name] == (name, 1.0, 1, len(text))


def test_license_stretch_is_the_best_of_all():
    rng = np.random.default_rng(11)
    for _ in range(40):
        bag = rng.integers(0, 8, rng.integers(1, 12)).astype(np.uint64)
        grams = rng.integers(0, 12, 50).astype(np.uint64)
        want = max(licenses.dice(grams[i:j], bag) for i in range(50) for j in range(i + 1, 51))
        got = licenses.best_stretch(bag, grams, np.flatnonzero(np.isin(grams, bag)), 0.7)
        assert (got[2] if got else 0.0) == pytest.approx(want if want >= 0.7 else 0.0)
        assert not got or licenses.dice(grams[got[0] : got[1]], bag) == pytest.approx(got[2])


def test_license_full_texts():
    names = ["Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"]
    scanner = licenses.LicenseScanner(licenses.TEMPLATES)
    for name in names:
        found = {m[0] for m in scanner.scan(licenses.bigrams(licenses.normalised(licenses.TEMPLATES[name]), licenses.TokenHashes()))}
        assert name in found


# --- op3

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Side</aside>%s<section id="comments"><article><p>I disagree with this long and
well written text</p></article></section><form><label>Mail</label><input></form><footer>&copy; X</footer>"""
BODY = "<h1>Title &amp; more</h1><p>First  <b>bold</b>\n text.<br><p>Be.</p><div class='ad'>Buy</div><p>Second &eacute;t&#233; paragraph of text.</p>"
TEXT = "Title & more\n\nFirst bold text.\n\nBe.\n\nSecond été paragraph of text."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<main><article>%s</article></main>", "<div>%s</div>"])
def test_html_main_text(wrap):
    assert htmltext.extract(PAGE % (wrap % BODY)) == TEXT


def test_html_names_that_only_speak_of_boilerplate():
    wrapped = f'<div class="layout has-sidebar elementor-widget-text"><div class="sidebar-left">S</div>{BODY}</div>'
    assert htmltext.extract(PAGE % wrapped) == TEXT
    assert htmltext.extract(PAGE % f'<div class="banner"><main>{BODY}</main></div>') == TEXT


@pytest.mark.parametrize("html", [None, "", "<", "<p", "plain & simple", "<!-- x", "</p></p>", "<script>alert(1)", "&#xFFFFFFFF;", "<b>" * 5000 + "x"])
def test_html_odd_pages(html):
    assert isinstance(htmltext.extract(html), str)


def test_html_unmatched_ends_take_linear_time():
    took = []
    for n in (20_000, 80_000):
        page = "<b>" * n + "text" + "</i>" * n
        begin = time.process_time()
        assert htmltext.extract(page) == "text"
        took.append(time.process_time() - begin)
    assert took[1] < 10 * took[0]


def test_html_nested_and_multiple_regions():
    """A story may stand in a main and in several articles; lists of links in it that no name tells are dropped."""
    long = [f"Paragraph {i} of the story goes on for a good while, with enough words to be told from a list of links." for i in range(6)]
    body = [f"<p>{x}</p>" for x in long]
    nested = f"<main><h1>The title of the story</h1><p>{long[0]}</p><article>{body[1]}{body[2]}</article>{body[3]}</main>"
    assert htmltext.extract(PAGE % nested) == "\n\n".join(["The title of the story", *long[:4]])
    parts = f"<article>{body[0]}{body[1]}</article><div>Short</div><article>{body[2]}</article><article>{body[3]}</article>"
    assert htmltext.extract(PAGE % parts).replace("\n\nShort", "") == "\n\n".join(long[:4])
    links = "".join(f"<li><a href='/{i}'><b>L{i}</b></a></li>" for i in range(12))
    mixed = f"<article>{body[0]}{body[1]}<div class='zz'><ul>{links}</ul></div>{body[2]}<p>Be.</p>{body[3]}</article>"
    assert htmltext.extract(PAGE % mixed) == "\n\n".join([*long[:3], "Be.", long[3]])


def test_html_query(spark, sf_dir):
    got = queries.op3_html_extraction(spark, sf_dir).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        assert r.n_chars == len(r.text) and "<p>" not in r.text and "track(" not in r.text
        inside = pages[r.page_id].html.split("<article>")[1].split("</article>")[0]
        plain = [" ".join(htmltext.extract(f"<div>{x}</div>").split()) for x in re.split(r"</?(?:p|h1|b|br)>", inside)]
        assert r.text.split("\n\n") == [x for x in plain if x]


# --- op4


def plain_kept_lines(data):
    """(doc_id, lines, lines that are kept) of each row."""
    holders = defaultdict(set)
    key = lambda x: x.translate(LOWER).strip(" \t\n\x0b\x0c\r")
    for doc, text in data:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = []
    for doc, text in data:
        lines = (text or "").split("\n")
        heavy = lambda k: len(k) >= 20 and len(holders[k]) >= 3
        kept = [x for x in lines if not heavy(key(x)) or max(holders[key(x)]) == doc]
        out.append((doc, lines, kept))
    return out


def plain_line_dedup(data):
    return Counter((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()) for doc, lines, kept in plain_kept_lines(data))


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_line_dedup(request, which):
    df = request.getfixturevalue(which).where("doc_id is not null")
    got = linededup.dedup_lines(df).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got) == plain_line_dedup(
        [(r.doc_id, r.text) for r in df.collect()]
    )


def test_line_dedup_keeps_null_ids_and_clashing_columns(spark, odd):
    got = linededup.dedup_lines(odd.withColumn("n_lines", F.lit("x")).withColumn("lost", F.lit(1))).collect()
    assert len(got) == len(ODD) and {r.lost for r in got} == {1}


def test_line_index_counts_documents():
    """Arrays over all distinct lines, rare ones too: distinct documents up to the bound, and the last."""
    rng = np.random.default_rng(2)
    lo, hi, doc = rng.integers(0, 9, 4000).astype(np.uint64), rng.integers(0, 60, 4000).astype(np.uint64), rng.integers(-5, 400, 4000)
    index = linededup.LineIndex(lo, hi, doc, 3)
    held = defaultdict(set)
    for key in zip(lo.tolist(), hi.tolist(), doc.tolist(), strict=True):
        held[key[:2]].add(key[2])
    keys = [(a, b) for a in range(12) for b in range(70) if a > 8 or (a, b) in held]  # the fingerprint is the first half
    counts, last = index.probe(*(np.array(x, np.uint64) for x in zip(*keys, strict=True)))
    for key, n, top in zip(keys, counts.tolist(), last.tolist(), strict=True):
        assert n == min(3, len(held[key])) and (not n or top == max(held[key])), key
    none = linededup.LineIndex(lo[:0], hi[:0], doc[:0], 3)
    assert none.probe(lo[:2], hi[:2])[0].tolist() == [0, 0]


def test_line_dedup_counts_ids_not_rows(spark):
    line = "a line that is long enough to count"
    of = lambda ids: {(r.doc_id, r.n_dropped) for r in linededup.dedup_lines(spark.createDataFrame([(i, f"{line}\nown {i}") for i in ids], "doc_id long, text string").repartition(3)).collect()}
    assert of([1, 1, 2]) == {(1, 0), (2, 0)}
    assert of([1, 1, 2, 3, 3]) == {(1, 1), (2, 1), (3, 0)}
    assert of([None, None, 5, 6]) == {(None, 1), (5, 1), (6, 0)}


CLASHES = ("words", "_block", "_lost", "holder", "block", "text_hash", "occurrences", "n_words", "items", "kept", "score", "held_out", "rep", "digest", "class", "start", "matches", "shard", "of_id")


def test_clashing_columns(spark, sf_dir, odd):
    """Extra columns, whatever their names, change no result; those that an operator adds are replaced."""
    more = odd
    for name in CLASHES:
        more = more.withColumn(name, F.lit("mine"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    labels = spark.createDataFrame([(9, 1, 0)], "doc_id long, quality long, toxic long")
    forms = {
        "quality": lambda d: quality.quality_rules(d, labels).drop("threshold"),
        "licenses": licenses.scan_licenses,
        "lines": lambda d: linededup.dedup_lines(d).select("doc_id", "kept_text", "n_dropped"),
        "decontam": lambda d: decontam.decontaminate(d, items).select("doc_id", "n_words", "n_hit", "contaminated"),
        "lm": lambda d: ngramlm.score_documents(d).select("doc_id", "n_tokens", F.round("score", 6)),
        "language": lambda d: langid.identify_language(d).select("doc_id", "lang_pred", "held_out"),
        "packing": lambda d: packing.pack_documents(d, with_ids=False).groupBy("doc_id").agg(F.sum("length")),
        "near": neardup.near_duplicates,
        "stays": lambda d: neardup.drop_near_duplicates(d).select("doc_id", "text"),
    }
    for name, form in forms.items():
        assert Counter(map(str, form(more).collect())) == Counter(map(str, form(odd).collect())), name
    kept = decontam.decontaminate(more, items)
    assert {r.words for r in kept.collect()} == {"mine"}


def test_perfect_hash():
    values = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64))
    for some in (values, values[:1], values[:0]):
        built = linededup.PerfectHash.build(some)
        assert sorted(built.index(some).tolist()) == list(range(len(some)))


# --- op5


def plain_decontamination(data, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 10, 0) + 1) if w else ():
            windows[tuple(w[i : i + 10])].add(str(item))
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in data:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[x]
        out.append((doc, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return Counter(out)


ITEMS = [(1, "Own LINE of five alone"), (20, "w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20 w21"), (3, None), (4, "..."), (5, "É"), (6, "a b c d e f g h a b c")]


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_decontamination(request, spark, sf_dir, which):
    df = request.getfixturevalue(which)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet") if which == "docs" else spark.createDataFrame(ITEMS, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in decontam.decontaminate(df, items).collect())
    assert got == plain_decontamination([(r.doc_id, r.text) for r in df.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_decontamination_without_items(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontam.decontaminate(odd, none).collect())


def test_proximity(spark):
    df = spark.createDataFrame([(1, "alpha x beta y z gamma alpha beta gamma"), (2, "gamma beta alpha")], "doc_id long, text string")
    ask = spark.createDataFrame([(7, "Alpha beta gamma")], "query_id long, text string")
    assert sorted(rows(decontam.proximity_matches(df, ask, 2))) == [(1, 7, 0, 5), (1, 7, 6, 8)]
    assert sorted(rows(decontam.proximity_matches(df, ask, 0))) == [(1, 7, 6, 8)]


def plain_proximity(data, asked, slop):
    out = set()
    for doc, text in data:
        words = [w.translate(LOWER) for w in re.findall(decontam.WORD, text or "")]
        for query, wanted in asked:
            terms = [w.translate(LOWER) for w in re.findall(decontam.WORD, wanted or "")]
            for start in (i for i, w in enumerate(words) if terms and w == terms[0]):
                end = start
                for term in terms[1:]:
                    end = next((i for i in range(end + 1, min(len(words), end + slop + 2)) if words[i] == term), None)
                    if end is None:
                        break
                if end is not None:
                    out.add((doc, query, start, end))
    return out


def test_words_are_cut_by_a_split(spark):
    texts = ["", "  ", "a", " \u00e91!\u03c3\U0001f600 b\n", "\x7f\x01Ab-c\u00a0d", "--x--", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(decontam.raw_words(F.col("text")).alias("w"))
    assert [r.w for r in df.collect()] == [re.findall(decontam.WORD, t or "") for t in texts]
    assert "regexp_extract_all" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, -1])
def test_proximity_equals_walk(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
    words = ["the", "The", "of", "rare", "cat", "sat"]
    rng = np.random.default_rng(5)
    data = [(i, " ".join(rng.choice(words, 30, p=[0.4, 0.2, 0.2, 0.02, 0.1, 0.08]))) for i in range(60)]
    data += [(None, "the cat sat"), (61, None), (62, ""), (5, data[5][1])]
    asked = [(1, "the of"), (2, "cat rare"), (3, "the the cat"), (4, "absent the"), (5, None), (6, "sat")]
    df, ask = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    got = rows(decontam.proximity_matches(df, ask, 3))
    assert len(got) == len(set(got)) and set(got) == plain_proximity(data, asked, 3)


def test_decontamination_without_broadcast(spark, sf_dir, odd, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").unionByName(
        spark.createDataFrame([(-1, "don't 42"), (-2, "a b c d e f g h a b c")], "item_id long, text string").selectExpr("cast(item_id as string) as item_id", "text")
    )
    whole = rows(decontam.decontaminate(odd, items))
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", -1)
    assert Counter(map(str, whole)) == Counter(map(str, rows(decontam.decontaminate(odd, items))))


def test_lines_of_equal_mixed_hashes():
    """Two lines whose 128-bit hashes differ, but not the 64-bit values that the perfect hash takes."""
    k, top = 0x9E3779B97F4A7C15, 1 << 64
    lo = np.array([3, 9, 3, 9, 9, 70], np.uint64)
    hi = np.array([5, (3 * k + 5 - 9 * k) % top, 5, 0, 0, 1], np.uint64)
    hi[[3, 4]] = hi[1]
    doc = np.array([1, 1, 2, 4, 4, 8], np.int64)
    index = linededup.LineIndex(lo, hi, doc, 3)
    counts, last = index.probe(np.append(lo[[0, 1, 5]], np.uint64(4)), np.append(hi[[0, 1, 5]], np.uint64(4)))
    assert counts.tolist() == [2, 2, 1, 0] and last[:3].tolist() == [2, 4, 8]



# --- op6

HTML = "<p>" + "x" * 1200
PAGES = [(1, "u1", HTML), (2, None, HTML), (3, "u3", HTML), (4, "u4", "short"), (5, "u5", "short"), (6, "u6", None), (7, "u\r\n7", ""), (None, "u8", HTML), (3, "u3", HTML)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    got = warc.archive_pages(pages).collect()
    want = Counter()
    for page, _, html in PAGES:
        data = (html or "").encode()
        revisit = len(data) >= 1000 and page != 3
        want[page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {bytes(r.payload) for r in got if r.page_id == 3} == {HTML.encode()}
    assert rows(warc.archive_pages(pages.limit(0))) == []


@pytest.mark.parametrize("wide", [False, True])
def test_zip_reader(tmp_path, wide):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.comment = b"PK\x05 a note"
        with z.open("a/stored.bin", "w", force_zip64=wide) as f:
            f.write(b"0123456789" * 100)
        z.writestr("packed.txt", b"y" * 1000, zipfile.ZIP_DEFLATED)
        z.writestr("é.txt", b"name")
    with path.open("rb") as f:
        reader = warc.ZipReader(f, path.stat().st_size)
        assert reader.read("a/stored.bin", 995, 5) == b"56789" and reader.read("é.txt") == b"name"
        with pytest.raises(ValueError, match="compressed"):
            reader.read("packed.txt")
        with pytest.raises(ValueError, match="bytes"):
            reader.read("é.txt", 2, 9)


def test_zip64_directory(tmp_path, monkeypatch):
    """The 64-bit end records and fields, forced by a low limit of the writer."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "b.zip"
    with zipfile.ZipFile(path, "w") as z:
        for name in ("one", "two"):
            with z.open(name, "w", force_zip64=True) as f:
                f.write(name.encode() * 100)
    assert b"PK\x06\x06" in path.read_bytes()
    with path.open("rb") as f:
        assert warc.ZipReader(f, path.stat().st_size).read("two", 297) == b"two"


# --- op7


def plain_lm(data):
    """Interpolated bigrams straight from counts."""
    seqs = [(doc, [*(text or "").translate(LOWER).encode().split(), "END"]) for doc, text in data]
    one, two, start = Counter(), Counter(), 0
    for doc, w in seqs:
        if doc is None or zlib.crc32(str(doc).encode()) % 10:
            one.update(w)
            two.update(zip(["START", *w[:-1]], w, strict=True))
            start += 1
    n, v = sum(one.values()), len(one)
    unigram = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    out = []
    for doc, w in seqs:
        base = total = 0.0
        for h, x in zip(["START", *w[:-1]], w, strict=True):
            c = start if h == "START" else one[h]
            t = ngramlm.TRUST * c / (c + ngramlm.HALF)
            base += np.log10(unigram(x))
            total += np.log10(t * two[h, x] / max(c, 1) + (1 - t) * unigram(x))
        out.append((doc, len(w), sum(one[x] > 0 for x in w), n, round(base, 6), round(total, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_lm_scores(request, which):
    df = request.getfixturevalue(which)
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in ngramlm.score_documents(df, 2, fitted=False).collect()]
    want = plain_lm([(r.doc_id, r.text) for r in df.collect()])
    for g, w in zip(sorted(got, key=str), want, strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], abs=2e-6)


def test_lm_blocks_do_not_matter(docs, monkeypatch):
    want = {r.doc_id: r.score for r in ngramlm.score_documents(docs).collect()}
    monkeypatch.setattr(ngramlm, "side", lambda n: 7)
    got = {r.doc_id: r.score for r in ngramlm.score_documents(docs).collect()}
    assert got == pytest.approx(want, rel=1e-3)  # n-grams that share a hash may be in one block or not


def test_lm_stretches_do_not_matter(docs, monkeypatch):
    """A block and a shard that are worked on in many stretches give what they give in one."""
    rows = docs.limit(60).collect()
    block = ngramlm.Block([r.doc_id for r in rows], [(r.text or "").encode() for r in rows], np.arange(len(rows)) % 9 == 0)

    def run(step):
        hashes, counts = ngramlm.ask(block, 3, 40)
        cuts = np.searchsorted(hashes, common.shard_bounds(3, 40))
        replies = []
        for shard, (h, c) in enumerate(zip(np.split(hashes, cuts), np.split(counts, cuts), strict=True)):
            asked = pa.table({"shard": pa.array([shard] * 2, pa.int32()), "from": pa.array([0, 1], pa.int32()), "hashes": [common.pack(h), common.pack(h[::2].copy())], "counts": [common.pack_counts(c), common.pack_counts(c[::2])]})
            replies.append(common.answer_shard(asked, 3, 40, ngramlm.tally, step))
        both = pa.concat_tables(replies)
        return ngramlm.score_block(block, both.filter(pc.equal(both["block"], 0)), 3, 40)

    want = run(1 << 20)
    monkeypatch.setattr(ngramlm, "steps", lambda texts: common.steps(texts, 5000))
    assert len(list(ngramlm.steps([b"x" * 900] * 60))) > 5
    got = run(100)
    assert got["score"] == pytest.approx(want["score"]) and got["n_known"] == want["n_known"] and got["train_tokens"] == want["train_tokens"]


def test_messages_of_the_counter_grow_with_the_text():
    for size in (10**8, 10**9, 10**12, 10**14):
        assert 7 <= common.side(8 * size) ** 2 / common.side(size) ** 2 <= 9
    assert common.side(0) == common.side(1) == 1 and common.hash_bits(1 << 50) == 64 and common.hash_bits(1 << 30) == 53


def test_counts_are_those_of_all_blocks(spark):
    """Rows between ask and answer, and counts, of a corpus and of one eight times as large."""
    rows = []
    for times in (1, 8):
        table = spark.range(400 * times).select((F.col("id") % (5 * times)).cast("int").alias("block"), (F.col("id") % 37).alias("x"))

        def features(own):
            values, counts = np.unique(own["x"].to_numpy(), return_counts=True)
            return values.astype(np.uint64) << np.uint64(4), counts.astype(np.int64)

        n = common.side(400 * times * common.MESSAGE_BYTES)
        blocked = table.withColumn("block", F.pmod(F.xxhash64("x", "block"), F.lit(n)).cast("int"))
        answers = common.corpus_counts(blocked, features, n, 10).collect()
        rows.append(len(answers))
        total = Counter()
        for r in table.collect():
            total[r.x] += 1
        of = defaultdict(list)
        for r in sorted(answers, key=lambda r: r.shard):
            of[r.block] += common.unpack_counts(r.counts).tolist()
        asked = defaultdict(set)
        for r in blocked.collect():
            asked[r.block].add(r.x)
        assert {b: [total[x] for x in sorted(v)] for b, v in asked.items()} == dict(of)
    assert rows[1] <= 9 * rows[0]


def test_join_on_hot_keys(spark):
    left = spark.createDataFrame([(i % 7 if i % 2 else 1, i) for i in range(200)] + [(None, -1)], "k long, v long")
    right = spark.createDataFrame([(k, 10 * k) for k in range(5)], "k long, w long")
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert want == sorted(map(tuple, common.join_hot(left, right, "k", common.hot_keys(left, "k", 201, 4)).select("k", "v", "w").collect()))


def test_lm_probabilities_sum_to_one():
    """After any context, the known tokens, one unknown and the end share 1."""
    train = [b"a b a b c", b"b c a", b"a a a"]
    hashes, counts = ngramlm.ask(ngramlm.Block([1, 2, 3], train, np.zeros(3, bool)))
    known = dict(zip(hashes.tolist(), counts.tolist(), strict=True))
    tallies = ngramlm.tally(hashes, counts)
    single = tallies.reshape(ngramlm.KINDS, -1)[0]
    n_types, n_tokens = int(single[1 : 1 + ngramlm.BUCKETS].sum()), int(single[1 + ngramlm.BUCKETS :].sum())
    assert (n_types, n_tokens) == (4, 14)

    def log_prob(text, with_end):
        found = ngramlm.grams([text.encode()])
        own, ids = ngramlm.numbered(found)
        c = np.array([known.get(h, 0) for h in own.tolist()])
        automaton = ngramlm.build(found, ids, c, n_tokens, n_types, ngramlm.fitted_halves(tallies, 3))
        usable = [np.where(v & (c[k] > 0), k, -1) for k, v in zip(ids, found.valid, strict=True)]
        arcs = list(zip(*(u[1:].tolist() for u in reversed(usable)), strict=True))
        arcs = arcs if with_end else arcs[:-1]
        return automaton.score(arcs, int(usable[0][0]) + 1) if arcs else 0.0

    for prefix in ("", "a", "a b", "c a", "zz"):
        before = log_prob(prefix, False)
        after = [log_prob(f"{prefix} {word}", False) for word in ("a", "b", "c", "new")] + [log_prob(prefix, True)]
        assert sum(10 ** (x - before) for x in after) == pytest.approx(1.0)


def test_lm_query_has_trigrams_with_fitted_weights(spark, sf_dir, docs):
    """The query's scores are those of interpolated trigrams straight from counts; more training text raises the weights."""
    data = [(r.doc_id, ["S", *(r.text or "").translate(LOWER).encode().split(), "E"]) for r in docs.collect()]
    counts = [Counter(), Counter(), Counter()]
    for doc, w in data:
        if doc is None or zlib.crc32(str(doc).encode()) % 10:
            for n in range(3):
                counts[n].update(tuple(w[i : i + n + 1]) for i in range(len(w) - n))
    single = Counter({k: c for k, c in counts[0].items() if k != ("S",)})
    n, v = single.total(), len(single)
    halves = {}
    for m, below in ((1, single), (2, counts[1])):
        own = counts[m]
        groups = defaultdict(list)
        for c in below.values():
            groups[c.bit_length()].append(c)
        new, low, high = sum(c == 1 for c in own.values()) / own.total(), 1e-3, 1e9
        for _ in range(200):
            half = (low * high) ** 0.5
            left = sum(sum(g) * half / (sum(g) / len(g) + half) for g in groups.values()) / below.total()
            low, high = (half, high) if left < new else (low, half)
        halves[m] = half

    def p(h, x):
        if not h:
            return (single[x,] + 0.1) / (n + 0.1 * (v + 1))
        c = counts[len(h) - 1][h]
        t = c / (c + halves[len(h)])
        return t * counts[len(h)][*h, x] / max(c, 1) + (1 - t) * p(h[1:], x)

    want = {doc: sum(np.log10(p(tuple(w[max(0, i - 2) : i]), w[i])) for i in range(1, len(w))) for doc, w in data}
    got = {r.doc_id: r.score for r in queries.op7_lm_scoring(spark, sf_dir).collect()}
    assert got == pytest.approx(want, rel=1e-6)
    assert ngramlm.trust(np.array([10**6]), halves[1])[0] > 0.9


# --- op8


def plain_phrases(text, sample):
    """Greedy longest matches of a string in another."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        n, i = n + 1, j
    return n


def test_phrases_are_greedy_matches():
    rng = np.random.default_rng(3)
    samples = {"x": "".join(rng.choice(list("abc "), 300)), "y": "".join(rng.choice(list("abd"), 200))}
    model = langid.LanguageModel(samples)
    texts = ["", "q", "abc", *("".join(rng.choice(list("abcdq"), n)) for n in (5, 50, 400, 511, 512, 513, 1500))]
    symbols, lengths = langid.encode(texts, model._codes())
    got = model.phrases(symbols, lengths)
    clean = lambda t: "".join(c for i, c in enumerate(t) if c != " " or not i or t[i - 1] != " ")
    for row, text in zip(got, texts, strict=True):
        for k, name in enumerate(model.languages):
            parts = [text[i : i + langid.STRETCH] for i in range(0, len(text), langid.STRETCH)]
            assert row[k] == sum(plain_phrases(p, clean(samples[name])) for p in parts)


@pytest.mark.parametrize(("n", "room"), [(0, 5), (5, 5), (7, 6), (253, 253), (254, 253), (3000, 253), (15_876, 253), (20_000, 253)])
def test_letters_are_spelled_apart(n, room):
    got = langid.spellings(n, room)
    assert len(got) == len(set(got)) == n and all(1 <= x <= room for s in got for x in s)
    if n <= 3000:  # the places of a symbol: always the same digit, so none is found inside another
        places = defaultdict(set)
        for s in got:
            for k, x in enumerate(s):
                places[x].add((k, len(s)))
        assert all(len(x) == 1 for x in places.values())


def test_too_few_symbols():
    with pytest.raises(ValueError, match="5 symbols cannot spell 6 letters"):
        langid.spellings(6, 5)


def test_many_letters_do_not_alias():
    """With thousands of letters, phrases are those of the spelled texts, and letters of one script match no other."""
    rng = np.random.default_rng(5)
    han, latin = [chr(0x4E00 + i) for i in range(2500)], list("abcdefghijklmnopqrstuvwxyz")
    drawn = lambda letters, n: "".join(letters[k] for k in rng.zipf(1.2, n) % len(letters))
    samples = {"han": drawn(han, 6000), "latin": drawn(latin, 3000), "mixed": drawn(latin + han, 3000)}
    model = langid.LanguageModel(samples)
    assert model.width == langid.ALPHABET
    spell = lambda t: "".join(chr(x) for c in t for x in model.symbols.get(ord(c), (model.width - 2,)))
    texts = [drawn(han, 150), drawn(latin, 150), "".join(sorted(samples["han"], key=samples["han"].count)[:100])]
    symbols, lengths = langid.encode(texts, model._codes())
    assert lengths.tolist() == [len(spell(t)) for t in texts]
    for row, text in zip(model.phrases(symbols, lengths).tolist(), texts, strict=True):
        assert row == [plain_phrases(spell(text), spell(samples[k])[: langid.SAMPLE_SYMBOLS]) for k in model.languages]
    assert model.phrases(symbols, lengths)[2, 1] == lengths[2]  # no letter of the rare ones is in the Latin sample
    assert model.predict(texts)[0][:2] == ["han", "latin"] and model.predict([texts[2], None, "12"])[0] == ["han", "und", "und"]


def test_language_accuracy_and_held_out(spark, docs):
    got = langid.identify_language(docs).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_language_odd(spark, odd, empty):
    got = {r.doc_id: r.lang_pred for r in langid.identify_language(odd).collect()}
    assert [got[i] for i in (1, 2, 3, 12)] == ["und"] * 4 and got[4] in ("en", "de")
    assert rows(langid.identify_language(empty)) == []
    unlabelled = langid.identify_language(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


# --- op9


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_packing(request, which):
    df = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    ids_of = defaultdict(list)
    for r in df.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[r.doc_id] += len(ids)
        ids_of[r.doc_id].append(ids)
    got = packing.pack_documents(df).collect()
    total, sequences = Counter(), defaultdict(list)
    for r in got:
        total[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        own = next(x for x in ids_of[r.doc_id] if len(x) == r.doc_tokens)
        assert own[r.start : r.start + r.length] == r.ids and r.length == len(r.ids) > 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert total == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert sum(sum(n for _, n in parts) < packing.WINDOW for parts in sequences.values()) <= 1


def plain_neighbours(docs, window):
    """BM25 of every document that is no seed for each seed's rarest terms, by the definitions."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    held = Counter(i for x in docs for i in set(x))
    pairs = [Counter(p for p in zip(x, x[1:], x[2:]) if min(map(held.get, p)) * packing.COMMON <= n) for x in docs]
    rests = [len(x) % window for x in docs]
    lots = packing.lots(np.arange(n))
    seeds = sorted(range(n), key=lambda i: (-rests[i], lots[i]))[: sum(rests) // window]
    df = Counter(p for x in pairs for p in x)
    others = Counter(p for i, x in enumerate(pairs) if i not in seeds for p in x)
    out = {}
    for s in seeds:
        known = [p for p in pairs[s] if others[p]]
        last = sorted(df[p] for p in known)[: packing.QUERY_TERMS]
        sure = [p for p in known if last and df[p] < last[-1]]
        out[s] = (sure, [p for p in known if last and df[p] == last[-1]], len(last) - len(sure))
    gain = lambda p, i: np.log(1 + (n - df[p] + 0.5) / (df[p] + 0.5)) * pairs[i][p] * 2.2 / (pairs[i][p] + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean))
    return seeds, out, gain, pairs


def test_neighbours_are_those_of_brute_force(spark, monkeypatch):
    """The index gives each seed the documents of the whole corpus that score highest, however it is sharded."""
    rng = np.random.default_rng(8)
    passages = [(rng.zipf(1.1, int(rng.integers(5, 40))) % 40_000 + 2).tolist() for _ in range(600)]
    docs = [sum((passages[k] for k in rng.integers(0, 600, int(rng.integers(0, 12)))), []) + [1] for _ in range(300)]
    docs += [docs[i][3:-2] + [1] for i in range(0, 40, 2)] + [[1], [1]]
    window = 256
    seeds, asked, gain, pairs = plain_neighbours(docs, window)
    frame = spark.createDataFrame([(i, i, len(x), bytearray(packing.as_blob(np.array(x), i % 2 == 0))) for i, x in enumerate(docs)], "row long, tie long, n long, ids binary")
    corpus = packing.corpus_of(frame.repartition(5), window)
    assert [i for i, x in enumerate(docs) if corpus.is_seed(np.array([i]), np.array([len(x) % window]))[0]] == sorted(seeds) and len(seeds) > 50
    results = []
    for sides, parts in ((1, 1), (6, 5)):
        monkeypatch.setattr(packing, "side", lambda n, k=sides: k)
        got = defaultdict(dict)
        for r in packing.Index(corpus, window).neighbours(frame.repartition(parts)).collect():
            got[r.seed][r.doc] = r.score * packing.STEP
        results.append(got)
    assert results[0] == results[1] and sum(map(len, results[0].values())) > 300
    for s in seeds:
        sure, tied, n_tied = asked[s]
        found = results[0][s]
        assert not set(found) & set(seeds) and len(found) <= packing.ASKED
        plain = {i: sum(gain(p, i) for p in sure if pairs[i][p]) for i in range(len(docs)) if i not in seeds}
        if n_tied == len(tied):  # no tie at the last term: the query is the same
            plain = {i: sum(gain(p, i) for p in [*sure, *tied] if pairs[i][p]) for i in plain}
            want = sorted((v for v in plain.values() if v), reverse=True)[: packing.ASKED]
            assert sorted(found.values(), reverse=True) == pytest.approx(want, rel=2e-3)
            assert all(v == pytest.approx(plain[i], rel=2e-3) for i, v in found.items())
        else:
            most = {i: v + sum(gain(p, i) for p in tied if pairs[i][p]) for i, v in plain.items()}
            assert all(plain[i] * 0.998 <= v <= most[i] * 1.002 for i, v in found.items())


def test_windows_are_filled_with_neighbours(spark):
    """Parts of a text share its window, however the input is split."""
    rng = np.random.default_rng(6)
    vocabulary = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).get_vocab()
    words = np.array(sorted(t[:-4] for t in vocabulary if t.endswith("</w>") and t[:-4].isascii() and t[:-4].isalpha() and t.islower() and len(t) > 8))
    data = []
    for i in range(60):
        whole = rng.choice(words, 1420).tolist()
        data.append((i, " ".join(whole)))
        data += [(100 * i + 100 + k, " ".join(whole[200 * k : 200 * k + 190])) for k in range(3)]
    results = []
    for parts in (1, 7):
        got = packing.pack_documents(spark.createDataFrame(data, "doc_id long, text string").repartition(parts), with_ids=False).collect()
        assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())
        by = defaultdict(set)
        for r in got:
            by[r.doc_id].add(r.sequence_id)
        with_source = [bool(by[d] & by[d // 100 - 1]) for d in by if d >= 100]
        assert sum(with_source) >= 0.95 * len(with_source)
        filled = Counter()
        for r in got:
            filled[r.sequence_id] += r.length
        assert sum(v < packing.WINDOW for v in filled.values()) == 1
        groups = defaultdict(set)
        for r in got:
            groups[r.sequence_id].add((r.doc_id, r.start, r.length))
        results.append(Counter(map(frozenset, groups.values())))
    assert results[0] == results[1]


def test_common_terms_find_neighbours(spark, monkeypatch):
    """Plain BM25 over all runs of three ids, of ids that every document has: nothing is too common to be asked for."""
    rng = np.random.default_rng(3)
    docs = [(rng.zipf(1.3, int(rng.integers(4, 120))) % 9 + 2).tolist() + [1] for _ in range(50)]
    window, n = 128, len(docs)
    grams = [Counter(zip(x, x[1:], x[2:])) for x in docs]
    df, mean = Counter(g for x in grams for g in x), sum(map(len, docs)) / n
    frame = spark.createDataFrame([(i, i, len(x), bytearray(packing.as_blob(np.array(x), True))) for i, x in enumerate(docs)], "row long, tie long, n long, ids binary")
    corpus = packing.corpus_of(frame, window)
    seeds = [i for i, x in enumerate(docs) if corpus.is_seed(np.array([i]), np.array([len(x)]))[0]]
    monkeypatch.setattr(packing, "BLOCK_IDS", 300)
    monkeypatch.setattr(packing, "MOST_PAIRS", 500)
    got = defaultdict(dict)
    for r in packing.Index(corpus, window).neighbours(frame.repartition(3)).collect():
        got[r.seed][r.doc] = r.score * packing.STEP
    assert len(seeds) > 10 and max(df.values()) > n / 2
    for s in seeds:
        want = {}
        for i in set(range(n)) - set(seeds):
            gains = [np.log(1 + (n - df[g] + 0.5) / (df[g] + 0.5)) * grams[i][g] * 2.2 / (grams[i][g] + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean)) for g in grams[s] if grams[i][g]]
            if gains:
                want[i] = sum(gains)
        assert sorted(got[s].values(), reverse=True) == pytest.approx(sorted(want.values(), reverse=True)[:24], rel=2e-3)
        assert all(v == pytest.approx(want[i], rel=2e-3) for i, v in got[s].items())


@pytest.mark.parametrize("sent", [1, 1 << 20])
def test_frequencies_of_terms_are_summed_before_they_are_sent(spark, monkeypatch, sent):
    """Terms of more than one document and how many have them, whatever is counted and sent at a time; no text is shuffled for it."""
    rng = np.random.default_rng(4)
    docs = [(rng.zipf(1.3, int(rng.integers(0, 90))) % 30 + 2).tolist() + [1] for _ in range(80)]
    frame = spark.createDataFrame([(i, i, len(x), bytearray(packing.as_blob(np.array(x), True))) for i, x in enumerate(docs)], "row long, tie long, n long, ids binary")
    monkeypatch.setattr(packing, "COUNTED_IDS", 200)
    monkeypatch.setattr(packing, "SENT_TERMS", sent)
    monkeypatch.setattr(packing, "side", lambda n: 5)
    index = packing.Index(packing.corpus_of(frame, 128), 128)
    got = {}
    for r in packing.stored(index.frequencies(frame.repartition(3))):
        got |= dict(zip(common.unpack(r["hashes"]).tolist(), common.unpack_counts(r["counts"]).tolist(), strict=True))
    want = Counter(h for x in docs for h in packing.terms([np.array(x, np.uint32)], index.bits)[0].tolist())
    assert got == {h: n for h, n in want.items() if n > 1} and len(got) > 100
    assert len(want) == len({g for x in docs for g in zip(x, x[1:], x[2:])})


def test_answers_do_not_depend_on_how_scores_are_added(monkeypatch):
    """Terms as rows of a matrix or pair by pair, in steps of any size, over documents in any order: the same documents and scores."""
    rng = np.random.default_rng(12)
    docs = [(rng.zipf(1.3, int(rng.integers(3, 150))) % 30 + 2 + 40 * (i % 2)).astype(np.uint32) for i in range(260)]
    hashes, _, _ = packing.terms(docs, 40)
    begin, df = packing.runs(hashes)
    corpus = packing.Corpus(len(docs), sum(map(len, docs)), 0, 0.0)
    answers = []
    for share, pairs, cells, order in ((0, 1 << 13, 1 << 19, np.arange(200)), (2, 1 << 13, 1 << 19, np.arange(200)), (1 / 50, 40, 900, 60 + packing.by_likeness(docs[60:]) - 60)):
        monkeypatch.setattr(packing, "DENSE_SHARE", share)
        monkeypatch.setattr(packing, "MOST_PAIRS", pairs)
        monkeypatch.setattr(packing, "MOST_CELLS", cells)
        group = packing.Group(np.arange(60), docs[:60], corpus, 40, iter([(hashes[begin][df > 1], df[df > 1])]))
        for part in np.split(order + 60, 4):
            group.meet(packing.Block(packing.Block.of([docs[k] for k in part], part.tolist(), 40), corpus))
        answers.append(sorted(zip(*group.nearest().to_pydict().values(), strict=True)))
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) > 1000
    near = packing.by_likeness(docs) % 2  # two kinds of documents, which have no id in common
    assert sorted(packing.by_likeness(docs).tolist()) == list(range(260)) and (near[1:] != near[:-1]).sum() < 5
    assert packing.by_likeness([]).tolist() == []


def test_a_window_asks_again(spark):
    """A window takes more documents that are near its seed than one answer has."""
    vocabulary = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).get_vocab()
    words = sorted(t[:-4] for t in vocabulary if t.endswith("</w>") and t[:-4].isascii() and t[:-4].isalpha() and t.islower() and len(t) > 8)
    whole = [words[:404], words[1000:1405]]
    data = [(i, " ".join(x)) for i, x in enumerate(whole)]
    data += [(100 * i + 100 + k, " ".join(x[14 * k : 14 * k + 3])) for i, x in enumerate(whole) for k in range(27)]
    by = defaultdict(set)
    for r in packing.pack_documents(spark.createDataFrame(data, "doc_id long, text string"), window=512, with_ids=False).collect():
        by[r.doc_id].add(r.sequence_id)
    for i in range(2):
        assert sum(bool(by[100 * i + 100 + k] & by[i]) for k in range(27)) >= 26


def test_seeds_ask_in_waves(spark, monkeypatch):
    """A seed asks in one wave, among the documents that no window has taken before; all ids are packed gapless."""
    rng = np.random.default_rng(21)
    words = np.array([f"{a}{b}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "sa", "to")])
    data = [(i, " ".join(rng.choice(words, int(rng.integers(1, 90))))) for i in range(150)]
    monkeypatch.setattr(packing, "WAVE_IDS", 2000)
    asks, nearest = [], packing.Index.nearest

    def noted(self, docs, seeds, frequencies, rows):
        asks.append((self.n_waves, {r.row for r in seeds.collect()}, {r.row for r in spark.read.parquet(rows).collect()}))
        return nearest(self, docs, seeds, frequencies, rows)

    monkeypatch.setattr(packing.Index, "nearest", noted)
    got = packing.pack_documents(spark.createDataFrame(data, "doc_id long, text string").repartition(4), window=256, with_ids=False).collect()
    waves = asks[0][0]
    assert waves > 1 and len(asks) >= waves and all(b[2] < a[2] for a, b in zip(asks, asks[1:]))
    assert len(set.union(*(x[1] for x in asks))) > max(len(x[1]) for x in asks) and not any(x[1] & x[2] for x in asks)
    total, filled = Counter(), defaultdict(list)
    for r in got:
        total[r.doc_id] += r.length
        filled[r.sequence_id].append((r.offset, r.length))
    assert total == {r.doc_id: r.doc_tokens for r in got} and len(total) == len(data)
    for parts in filled.values():
        assert [offset for offset, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist()
    assert sum(sum(n for _, n in parts) < 256 for parts in filled.values()) <= 1


def test_seeds_of_equally_long_documents(spark):
    rests = np.zeros(64, np.int64)
    rests[40], rests[50] = 10_000, 10
    assert packing.seeds_by_length(rests, 64) == (40, (10_000 * 40 + 500) // 64 - 10)
    assert packing.seeds_by_length(np.zeros(64, np.int64), 64) == (0, 0)
    docs = spark.range(5000).select(F.col("id").alias("tie"), F.lit(104).cast("long").alias("n"))
    for missing in (1, 7, 999, 3000):
        drawn = int((packing.lots(np.arange(5000)) < packing.share_of(docs, 40, missing, 5000, 64)).sum())
        assert drawn == missing if missing < packing.EXACT_LOTS else 0.7 * missing < drawn < missing


# --- op10


def plain_classes(data):
    texts = sorted({t for _, t in data if t is not None})
    owner, hashes, times = neardup.shingles(texts)
    copies = Counter(t for _, t in data if t is not None)
    df = Counter()
    for o, h in zip(owner.tolist(), hashes.tolist(), strict=True):
        df[h] += copies[texts[o]]
    weight = times * neardup.idf(np.array([df[h] for h in hashes.tolist()]), sum(copies.values())) if len(hashes) else times
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    sets = [(hashes[a:b], weight[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
    least = {t: min((-(1 << 63) if i is None else i) for i, x in data if x == t) for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a][0]) and len(sets[b][0]) and neardup.weighted_jaccard(sets[a], sets[b]) >= neardup.SIMILARITY:
                root[find(texts[a])] = find(texts[b])
    label = defaultdict(list)
    for t in texts:
        label[find(t)].append(least[t])
    return Counter((i, i if t is None else min(label[find(t)])) for i, t in data)


def near_copies():
    rng = np.random.default_rng(7)
    words = [f"v{i}" for i in range(5000)]
    out = []
    for group in range(6):
        text = list(rng.choice(words, 300))
        for copy in range(8):
            own = list(text)
            for at in rng.integers(0, 300, copy):
                own[at] = str(rng.choice(words))
            out.append((100 * group + copy, " ".join(own)))
        out.append((100 * group + 50, " ".join(text)))
    return out


@pytest.mark.parametrize("chunk", [256, 3])
def test_near_duplicates_of_edited_copies(spark, chunk, monkeypatch):
    monkeypatch.setattr(neardup.similar_pairs, "__defaults__", (chunk,))
    data = near_copies()
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert Counter((r.doc_id, r.class_id) for r in neardup.near_duplicates(df).collect()) == plain_classes(data)
    kept = neardup.drop_near_duplicates(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in plain_classes(data)})


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_near_duplicates(request, which):
    df = request.getfixturevalue(which).where("doc_id is not null")
    data = [(r.doc_id, r.text) for r in df.collect()]
    assert Counter((r.doc_id, r.class_id) for r in neardup.near_duplicates(df).collect()) == plain_classes(data)


def test_null_ids_stay(odd):
    assert neardup.near_duplicates(odd).count() == len(ODD)
    assert neardup.drop_near_duplicates(odd).where("doc_id is null or doc_id = 12").count() == 2


def test_weighted_samples_agree_as_often_as_similar():
    rng = np.random.default_rng(11)
    hashes = np.unique(rng.integers(1, 2**56, 400).astype(np.uint64))
    weights = rng.uniform(1, 3, len(hashes))
    a, b = (hashes[:300], weights[:300]), (hashes[50:], weights[50:] * 1.1)
    got = (neardup.sample(*a, n=3000) == neardup.sample(*b, n=3000)).mean()
    assert got == pytest.approx(neardup.weighted_jaccard(a, b), abs=0.04)


def test_shards_get_equal_shares_of_shingles(docs):
    from readloom.llm.common import shard_bounds

    _, hashes, _ = neardup.shingles([r.text for r in docs.collect()])
    share = np.bincount(np.searchsorted(shard_bounds(8, neardup.HASH_BITS), hashes, "right"), minlength=8) / len(hashes)
    assert share.max() < 0.2


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in neardup.connected(pairs).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


@pytest.mark.parametrize("wrapper", ["<form id=aspnetForm>{}</form>", "<div class='page-with-sidebar'>{}</div>", "<div class='social-science'>{}</div>", "<form><div id=main-widgets>{}</div></form>"])
def test_wrappers_of_whole_pages(wrapper):
    """What wraps all of a page is not what its name says; what is in it still is."""
    story = "".join(f"<p>Paragraph {i} of a story that goes on for a good while, in plain words.</p>" for i in range(6))
    inner = f"<nav><a>Home</a></nav><div class=comments><p>First comment, which is long enough to look like a paragraph.</p></div><h1>Title</h1>{story}<form class=login>Name</form>"
    text = htmltext.extract(f"<html><body><a href=#c>Skip</a>{wrapper.format(inner)}<footer>Imprint</footer></body></html>")
    assert all(f"Paragraph {i} of" in text for i in range(6)) and "Home" not in text and "comment" not in text and "Imprint" not in text


def test_doubtful_parts_beside_a_story_stay_hidden():
    side = "".join(f"<p>Related story number {i}, with a teaser that is rather long.</p>" for i in range(9))
    text = htmltext.extract(f"<body><p>A short but real story, of one paragraph.</p><div class='sidebar-box'>{side}</div></body>")
    assert text == "A short but real story, of one paragraph."
    assert htmltext.extract(f"<body><article><p>Real.</p></article><div class='sidebar-box'>{side}</div></body>") == "Real."


@pytest.mark.parametrize("wrapper", ["<form id=aspnetForm>{}</form>", "<div class='page-with-sidebar'>{}</div>", "<div class='social-science'>{}</div>", "<form><div id=main-widgets>{}</div></form>"])
def test_wrappers_of_whole_pages(wrapper):
    """What wraps all of a page is not what its name says; what is in it still is."""
    story = "".join(f"<p>Paragraph {i} of a story that goes on for a good while, in plain words.</p>" for i in range(6))
    inner = f"<nav><a>Home</a></nav><div class=comments><p>First comment, which is long enough to look like a paragraph.</p></div><h1>Title</h1>{story}<form class=login>Name</form>"
    text = htmltext.extract(f"<html><body><a href=#c>Skip</a>{wrapper.format(inner)}<footer>Imprint</footer></body></html>")
    assert all(f"Paragraph {i} of" in text for i in range(6)) and "Home" not in text and "comment" not in text and "Imprint" not in text


def test_doubtful_parts_beside_a_story_stay_hidden():
    side = "".join(f"<p>Related story number {i}, with a teaser that is rather long.</p>" for i in range(9))
    text = htmltext.extract(f"<body><p>A short but real story, of one paragraph.</p><div class='sidebar-box'>{side}</div></body>")
    assert text == "A short but real story, of one paragraph."
    assert htmltext.extract(f"<body><article><p>Real.</p></article><div class='sidebar-box'>{side}</div></body>") == "Real."
