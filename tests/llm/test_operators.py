"""The corpus operators on odd rows and against brute-force versions."""

import base64
import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingualake.llm import components, exact_dedup, imatch, licenses, line_dedup, near_dedup, packing, pieces, quality, toxicity, warc
from lingualake.llm.shingles import shingle_set

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
#: Extra columns clash with names that operators use inside.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(n, T.StringType()) for n in ("id", "n", "len", "head", "key", "_text", "score", "label", "length", "piece"))])
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
ODD = [(5, None), (3, ""), (9, " \t\n"), (1, "a b c"), (1, "a b c"), (7, "A  b\tc"), (2, LONG), (4, LONG + " end"), (None, "a b c"), (None, None), (8, "x" * 50_000), (6, "idiot & moron!")]


def docs(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 10) for r in rows], SCHEMA)


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


OPERATORS = {
    "imatch": lambda d: imatch.fingerprints(d),
    "exact": lambda d: exact_dedup.exact_groups(d),
    "lines": lambda d: line_dedup.dedup_lines(d, carry=("key", "label")),
    "near": lambda d: near_dedup.near_duplicates(d),
    "pieces": lambda d: pieces.digests(d, PIECES),
    "licenses": lambda d: licenses.scan(d),
    "packing": lambda d: packing.pack_documents(d, WORDS),
    "quality": lambda d: quality.scored(d, quality.Model(0.0)),
    "toxicity": lambda d: toxicity.scored(d, toxicity.Model((), (), 0.0, 0.0, -1.0)),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows_and_empty_tables(spark, name):
    found = OPERATORS[name](docs(spark, ODD))
    rows = found.collect()
    if name not in ("licenses", "packing"):
        assert len(rows) == len(ODD)
    empty = OPERATORS[name](docs(spark, []))
    assert empty.collect() == [] and empty.dtypes == found.dtypes


@pytest.mark.parametrize("n, more", [(20_000, 20_000), (8190, 8200)])
def test_fingerprints_of_very_long_texts(spark, n, more):
    words = [f"t{i}" for i in range(more)]
    edit = [w if i % 100 else f"e{i}" for i, w in enumerate(words)]
    found = table(imatch.fingerprints(docs(spark, [(2, " ".join(words[:n])), (1, " ".join(edit))])), "id")
    assert found[2]["near_next"] >= 0.75 and found[2]["near_edited"] > 0.1
    assert len({len(found[k][c]) for k in (1, 2) for c in ("fingerprint", "edited_fingerprint")}) == 1


def test_fingerprints_follow_the_next_document(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(3 * i, " ".join(rng.choices(words, k=80))) for i in range(600)] + [(1, None), (2, "w1 w2")]
    found = table(imatch.fingerprints(docs(spark, rows)), "id")
    order = sorted(rows, reverse=True)
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text)
        assert found[i]["n_chars"] == n and found[i]["edited"] == text[: n - n // 3] + after[: n // 3]
    near = [r["near_edited"] for r in found.values() if r["n_chars"] > 50]
    other = [r["near_next"] for r in found.values() if r["n_chars"] > 50]
    assert np.median(near) > 3 * np.median(other)
    again = table(imatch.fingerprints(docs(spark, [*rows, (5000, rows[0][1])])), "id")
    assert again[5000]["fingerprint"] == again[0]["fingerprint"]


def _fingerprint(text, lexicon):
    """(hash over all terms, hash beginnings for each scale, None for a scale that isn't populated) by hand."""
    own = {t for t in re.split(r"[^a-z0-9]+", text.lower()) if t}
    kept = sorted(own & lexicon or own)
    md5 = lambda words: hashlib.md5(" ".join(words).encode()).hexdigest()
    scales = []
    for s, (every, subsets) in enumerate(imatch.SCALES):
        served = len(kept) <= imatch.DENSE * every if s < len(imatch.SCALES) - 1 else True
        served = served and (s < imatch.LARGE or len(kept) * imatch.SPARSE >= every)
        at = [[t for t in kept if (int(hashlib.md5(t.encode()).hexdigest()[:15], 16) >> 5 * s) % every == i] for i in range(subsets)]
        scales.append([md5(x)[:4] for x in at] if served and any(at) else None)
    return md5(kept), scales


def _like(a, b):
    if a[0] == b[0]:
        return 1.0
    out = None
    for x, y, (_, subsets) in zip(a[1], b[1], imatch.SCALES):
        pairs = list(zip(x or ["d41d"] * subsets, y or ["d41d"] * subsets))
        used = sum(p != ("d41d", "d41d") for p in pairs)
        if out is None or used >= imatch.POPULATED:
            out = sum(p == q != "d41d" for p, q in pairs) / max(1, used)
    return out


def test_fingerprints_by_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows = [(7 * i, " ".join(rng.choices(words, k=rng.choice([3, 40, 300])))) for i in range(120)]
    rows += [(1, None), (2, "..."), (-(2**63), "a w1"), (2**63 - 1, "w1 w2 w3"), (10**15, " ".join(words))]
    counts = collections.Counter(t for _, text in rows for t in set((text or "").split()) - {"..."})
    lexicon = {t for t, n in counts.items() if max(2, imatch.LOW * len(rows)) <= n <= imatch.HIGH * len(rows)}
    found = table(imatch.fingerprints(docs(spark, rows)), "id")
    order = [(i, t or "") for i, t in sorted(rows, reverse=True)]
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        own, new, other = (_fingerprint(t, lexicon) for t in (text, edited, after))
        text_of = lambda f: f[0] + "".join("".join(x or ["d41d"] * n) for x, (_, n) in zip(f[1], imatch.SCALES))
        assert (found[i]["edited"], found[i]["fingerprint"], found[i]["edited_fingerprint"]) == (edited, text_of(own), text_of(new))
        assert (found[i]["near_edited"], found[i]["near_next"]) == (pytest.approx(_like(own, new)), pytest.approx(_like(own, other)))


def test_fingerprint_blocks_stay_small_beside_far_ids(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BLOCK_ROWS", 50)
    monkeypatch.setattr(imatch, "FAN", 8)
    ids = [*range(2000), 2**62, -(2**63), 2**63 - 1]
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "id bigint, text string")
    blocked = imatch._in_blocks(rows, len(ids)).cache()
    assert blocked.filter("not copy").count() == len(ids)
    assert max(r["count"] for r in blocked.groupBy("block").count().collect()) <= 3 * len(ids) / 64
    firsts = {r["block"]: r["id"] for r in blocked.filter("copy").collect()}
    owns = collections.defaultdict(list)
    for r in blocked.filter("not copy").collect():
        owns[r["block"]].append(r["id"])
    down = sorted(ids, reverse=True)
    for block, own in owns.items():
        at = down.index(min(own))
        assert sorted(own, reverse=True) == down[at - len(own) + 1 : at + 1] and firsts[block] == down[(at + 1) % len(down)]


def test_fingerprints_can_be_filtered(spark):
    rows = [(i, f"a b c d{i % 7} e{i % 5}") for i in range(200)]
    found = imatch.fingerprints(docs(spark, rows))
    every = found.collect()
    start = time.monotonic()
    assert found.filter("near_edited < 0.5").count() == sum(r["near_edited"] < 0.5 for r in every)
    assert time.monotonic() - start < 60


def test_exact_groups(spark):
    rows = [(1, "a b"), (2, "ab"), (3, " a\nb "), (4, ""), (5, None), (6, "ba"), (7, "y" * 100 + "1"), (8, "y" * 100 + "2")]
    found = table(exact_dedup.exact_groups(docs(spark, rows), hash_all=True), "id")
    assert [found[i]["keep_id"] for i in range(1, 9)] == [3, 3, 3, 4, 4, 6, 7, 8]
    assert [found[i]["group_size"] for i in range(1, 9)] == [3, 3, 3, 2, 2, 1, 1, 1]
    assert found[2]["sha256"] == hashlib.sha256(b"ab").hexdigest()


def test_lines_by_brute_force(spark):
    rng = random.Random(2)
    lines = [f"line number {i} of the pool" for i in range(40)] + ["short", "", "  LINE number 3 of the pool\t"]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 12)))) for i in range(300)]
    owners = collections.defaultdict(set)
    key = lambda x: x.strip(" \t\n\r\v\f").translate({c: c + 32 for c in range(65, 91)})
    for i, text in rows:
        for line in text.split("\n"):
            owners[key(line)].add(i)
    found = table(line_dedup.dedup_lines(docs(spark, rows)))
    for i, text in rows:
        kept = [x for x in text.split("\n") if len(key(x)) < 20 or len(owners[key(x)]) < 3 or i == max(owners[key(x)])]
        assert (found[i]["kept_text"], found[i]["n_lines"], found[i]["n_dropped"]) == ("\n".join(kept), text.count("\n") + 1, text.count("\n") + 1 - len(kept))


def _near_rows(seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for size in (60, 12, 3):
        base = [f"b{seed}{size}{i}" for i in range(100)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(100)] = f"e{rng.random()}"
            rows.append((n, " ".join(own)))
            n += 1
    rows += [(n + k, " ".join(f"u{k}_{i}" for i in range(30))) for k in range(20)]
    return rows + [(n + 20, rows[0][1].upper()), (n + 21, "four words at most"), (n + 22, "Four  words at MOST"), (n + 23, "")]


def _components(rows):
    sets = {i: shingle_set((t or "").encode()) for i, t in rows}
    label = {i: i for i in sets}
    change = True
    while change:
        change = False
        for i in sets:
            for j in sets:
                if i < j and label[i] != label[j] and len(sets[i]) and len(sets[j]) and near_dedup._linked(sets[i], sets[j]):
                    low, high = sorted((label[i], label[j]))
                    label = {k: low if v == high else v for k, v in label.items()}
                    change = True
    return sets, label


@pytest.mark.parametrize("chunk", [1000, 8])
def test_near_duplicates_by_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    rows = _near_rows(chunk)
    sets, label = _components(rows)
    found = table(near_dedup.near_duplicates(docs(spark, rows)), "id")
    assert {i: r["component_id"] for i, r in found.items()} == label
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (label[i] == i) for i, r in found.items())


def test_likelihood_finds_the_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for shared in (900, 500, 100):
        a, b = np.unique(pool[:1000]), np.unique(pool[1000 - shared : 2000 - shared])
        x, y = near_dedup.sketches([a, b])
        found = near_dedup.likely_similarity(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([1000.0]), np.array([1000.0]))[0]
        assert abs(found - shared / (2000 - shared)) < 0.15


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 102), (102, 100)]
    found = dict(components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 104)}}


def test_pieces_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own = pieces.PieceTable(PIECES)
    rng = random.Random(3)
    texts = ["".join(rng.choice("  \n\tabtheinongéß▁0129.,日😀") for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    for text in [*texts, LONG[:5000], "<s>", "a\x00b"]:
        ids = model.encode(text)
        assert own.encode(text) == ids and own.decode(ids) == model.decode(ids)
    frame = docs(spark, list(enumerate(texts[:50])))
    encoded = pieces.encode(frame, PIECES)
    assert {r["id"]: r["ids"] for r in encoded.collect()} == {i: model.encode(t) for i, t in enumerate(texts[:50])}
    assert {r["id"]: r["text"] for r in pieces.decode(encoded, PIECES).collect()} == {i: model.decode(model.encode(t)) for i, t in enumerate(texts[:50])}


def test_packing_cuts_and_fills(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["alpha", "Beta's", "γ", "1,5", "…"], k=rng.randint(0, 400)))) for i in range(120)] + [(500, LONG[:40_000]), (501, None)]
    found = packing.pack_documents(docs(spark, rows), WORDS).collect()
    by_piece = {(r["doc_id"], r["piece"]): r for r in found}
    total = 0
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            r = by_piece.pop((i, k))
            assert (r["start"], r["length"], r["ids_crc32"]) == (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            total += len(part)
    assert not by_piece
    bins = collections.defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 2


def test_plan_swaps_one_for_two():
    # 6 leaves 4, the greedy 3 leaves 1; 2 and 2 together fill it.
    assert (1, [6, 2, 2]) in packing.plan({6: 1, 3: 1, 2: 2}, 10)


def test_warc_round_trip_in_chunks(spark):
    rows = [(1, "http://a\n.b", "x" * 25), (2, None, "x" * 25), (3, "u", None), (4, "u", ""), (5, "u", "é" * 7), (None, "u", "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    chunks = warc.archive(pages, chunk_bytes=10)
    found = {r["page_id"]: r for r in warc.read_archive(chunks).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert found[i]["valid"] and found[i]["payload_bytes"] == len(data) and found[i]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert {i: r["refers_to"] for i, r in found.items()} == {1: None, 2: 1, 3: None, 4: 3, 5: None, None: None}
    assert chunks.filter("chunks > 1").count() == 5 and chunks.agg(F.max(F.length("data"))).first()[0] <= 14
    assert warc.sound(warc.read_archive(chunks)).count() == len(rows)
    broken = chunks.withColumn("data", F.when(F.col("chunk") == 1, F.lit(b"0123456789")).otherwise(F.col("data")))
    assert not all(r["valid"] for r in warc.read_archive(broken).collect())
    with pytest.raises(Exception, match="damaged record of page"):
        warc.sound(warc.read_archive(broken)).count()
    one = chunks.filter("chunks = 1 and length(data) = 5").select(F.concat("head", "data")).first()
    assert one is None or bytes(one[0]).startswith(b"WARC/1.1\r\nWARC-Type: ")
    assert warc.read_archive(warc.archive(pages.limit(0))).count() == 0


def test_licenses_with_changed_words(spark):
    notice = licenses.TEMPLATES["MIT notice"]
    changed = notice.split()
    changed[20] = "thing"
    rows = [(1, "intro text here " + notice + " and more"), (2, "so " * 300 + " ".join(changed)), (3, " ".join(notice.split()[:20])), (4, "released under the MIT license"), (5, "the mit license")]
    found = {(r["id"], r["license"]): r["containment"] for r in licenses.scan(docs(spark, rows)).collect()}
    assert found[1, "MIT notice"] == 1.0 and 0.75 <= found[2, "MIT notice"] < 1 and (3, "MIT notice") not in found
    assert found[4, "MIT"] == 1.0 and not any(i == 5 for i, _ in found)


def test_kernel_by_brute_force():
    def slow(s, t, p, decay):
        total = 0.0
        from itertools import combinations

        for i in combinations(range(len(s)), p):
            for j in combinations(range(len(t)), p):
                if [s[x] for x in i] == [t[x] for x in j]:
                    total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
        return total

    words = ["idiot", "idxiot", "moron", "toidi", "abc"]
    codes = toxicity._codes(words)
    for k, s in enumerate(words):
        for m, t in enumerate(words):
            assert toxicity.kernel(codes[k : k + 1], codes[m : m + 1])[0] == pytest.approx(slow(s, t, 3, toxicity.DECAY), rel=1e-4)


def test_toxicity_tolerates_insertions(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("aeioulmnrst", k=rng.randint(3, 8))) for _ in range(500)]
    insults = ["gromlik", "blatfen"]
    rows, labels = [], []
    for i in range(400):
        own = rng.choices(words, k=40)
        if bad := i % 5 == 0:
            own[rng.randrange(40)] = rng.choice(insults)
        rows.append((i, " ".join(own) + "."))
        labels.append((i, int(bad)))
    frame = docs(spark, rows)
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    clean = " ".join(rng.choices(words, k=30))
    tests = [(1, clean), (2, clean + " gromlik"), (3, clean + " gro.mlik now"), (4, clean + " g r o m l i k now"), (5, clean + " BLAT-FEN!"), (6, None)]
    found = table(toxicity.scored(docs(spark, tests), model))
    assert [found[i]["score"] >= 0.7 for i in range(1, 7)] == [False, True, True, True, True, False]


def test_models_without_labels(spark):
    frame = docs(spark, ODD)
    none = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    assert all(0 <= r["score"] < 0.7 for r in toxicity.scored(frame, toxicity.fit(frame, none)).collect())
    assert all(r["score"] == pytest.approx(0.5) for r in quality.scored(frame, quality.fit(frame, none)).collect())


SF, SMALL = "/root/testdata/sf0.1", "/root/testdata/sf0.001"


def _auc(score, label):
    rank = pd.Series(score).rank()
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def _labelled(spark, sf, parts, part):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), labels.filter(~held), labels.filter(held)


def test_held_out_quality(spark):
    documents, known, held = _labelled(spark, SF, 5, 0)
    found = quality.scored(documents.join(held, "doc_id"), quality.fit(documents, known)).select("quality", "score").toPandas()
    kept, label = found["score"] >= 0.3, found["quality"] == 1
    assert _auc(found["score"], found["quality"]) >= 0.99
    assert (kept & label).sum() / label.sum() >= 0.98 and (kept & label).sum() / kept.sum() >= 0.97  # 0.85 of the rows are label 1


def test_held_out_toxicity(spark):
    documents, known, held = _labelled(spark, SF, 3, 1)
    found = toxicity.scored(documents.join(held, "doc_id"), toxicity.fit(documents, known)).select("toxic", "score").toPandas()
    told, label = found["score"] >= 0.7, found["toxic"] == 1
    assert _auc(found["score"], found["toxic"]) >= 0.85
    assert (told & label).sum() / label.sum() >= 0.65 and (told & label).sum() / told.sum() >= 0.85  # 0.11 of the rows are toxic


def _statistics(text):
    import regex

    words, lines, chars = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w], text.split("\n"), len(text)
    of = lambda pattern: len(regex.findall(pattern, text)) / (chars + 1)
    n = len(words)
    return {
        "chars": chars, "words": n, "word_chars": chars / (n + 1), "distinct_words": len(set(words)) / (n + 1), "capitals": of(r"\p{Lu}"), "digits": of("[0-9]"), "symbols": of(r"[^\p{L}\p{N}\s.,;:!?'\"|()-]"), "bars": of(r"\|"), "bangs": of("!"), "stops": of("[.,;:?]"),
        "short_words": sum(len(w) <= 3 for w in words) / (n + 1), "long_words": sum(len(w) >= 14 for w in words) / (n + 1), "lines": len(lines), "distinct_lines": len(set(lines)) / len(lines), "line_chars": chars / len(lines),
    }


def test_quality_scores_by_brute_force(spark):
    documents, known, _ = _labelled(spark, SMALL, 5, 0)
    model = quality.fit(documents, known)
    for r in quality.scored(documents, model).collect():
        own = _statistics(r["text"])
        total = model.intercept + sum(w for rule, w in model.rules if all(low < own[name] <= high for name, low, high in rule.bounds))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


def test_toxicity_scores_by_brute_force(spark):
    documents, known, _ = _labelled(spark, SMALL, 3, 1)
    landmarks = ("idiot", "stupid", "moron")
    model = toxicity.Model(landmarks, (2.0, 1.5, -0.5), -1.0, 3.0, 0.2)

    def bits(word, gaps):
        pairs = [(word[i], word[i + g]) for g in range(1, gaps + 1) for i in range(len(word) - g)]
        return {((ord(a) * 0x9E3779B97F4A7C15 + ord(b) * 0xC2B2AE3D27D4EB4F) % 2**64) >> 58 for a, b in pairs}

    def near(token):
        found = np.zeros(len(landmarks))
        for w in toxicity.windows(token.strip(toxicity._PUNCTUATION)):
            for j, mark in enumerate(landmarks):
                own = bits(mark, 1)
                value = toxicity.similarities([w], [mark])[0, 0]
                if len(bits(w, 3) & own) >= np.ceil(0.7 * len(own)) and value >= toxicity.NEAR:
                    found[j] = max(found[j], value)
        return found

    tests = [(k, f"{a} wordy {b}{c} rest.") for k, (a, b, c) in enumerate((x, y, z) for x in ("Fine", "mor-on", "i d i o t") for y in ("stupid", "stxupid", "clever", "idiotic") for z in ("!", ". And then", ""))]
    for r in toxicity.scored(docs(spark, tests), model).collect():
        best, row = 0.0, np.zeros(len(landmarks))
        for word in toxicity.tokens(r["text"].lower()):
            row = np.maximum(row, near(word))
            if word[-1] in ".!?":
                best, row = max(best, float(np.dot(model.weights, row))), np.zeros(len(landmarks))
        best = max(best, float(np.dot(model.weights, row)))
        assert r["score"] == pytest.approx(model.likelihood(model.bias + best), abs=1e-5)


def test_fitted_models_on_odd_rows(spark):
    for module, parts, part in ((quality, 5, 0), (toxicity, 3, 1)):
        documents, known, _ = _labelled(spark, SMALL, parts, part)
        model = module.fit(documents, known)
        found = module.scored(docs(spark, ODD), model).collect()
        assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)
        score = lambda i, text: {round(r["score"], 12) for r in found if r["doc_id"] == i and r["text"] == text}
        assert score(5, None) == score(3, "") == score(None, None) and len(score(1, "a b c")) == 1 and score(1, "a b c") == score(None, "a b c")


def test_piece_digests_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = pieces.digests(docs(spark, ODD), PIECES).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = collections.Counter((i, len(ids := model.encode(t or "")), sha(",".join(map(str, ids))), sha(model.decode(ids))) for i, t in ODD)
    assert collections.Counter(map(tuple, found)) == want


def test_defined_results_on_odd_rows(spark):
    packed = packing.pack_documents(docs(spark, ODD), WORDS).collect()
    assert sorted((r["length"] for r in packed if r["doc_id"] in (5, 3, 9)), reverse=True) == [1, 1, 1]
    assert sum(r["doc_id"] == 1 for r in packed) == 2 and sum(r["doc_id"] is None for r in packed) == 2
    assert licenses.scan(docs(spark, [*ODD, (10, licenses.TEMPLATES["MIT"]), (10, licenses.TEMPLATES["MIT"])])).count() == 2
    near = near_dedup.near_duplicates(docs(spark, ODD)).collect()
    assert {(r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near if r["id"] in (None, 1, 5, 9)} == {(None, 1, None, True), (None, 0, None, True), (1, 1, 1, True), (5, 0, 5, True), (9, 0, 9, True)}
    prints = [r for r in imatch.fingerprints(docs(spark, ODD)).collect() if r["id"] is None]
    assert len(prints) == 2 and all(r["near_next"] is None for r in prints)


def test_rules_compile_to_columns(spark):
    rule = quality.Rule((("chars", 2.0, float("inf")), ("words", float("-inf"), 3.0)))
    model = quality.Model(-1.0, ((rule, 3.0),))
    found = table(quality.scored(docs(spark, [(1, "a"), (2, "a b c"), (3, "a b c d")]), model))
    assert [round(found[i]["score"], 3) for i in (1, 2, 3)] == [0.269, 0.881, 0.269]


def test_words_split_like_the_regular_expression():
    words = packing.Words(WORDS)
    rng = random.Random(8)
    parts = ["'s", "'re", "'", "a", "B", "É", "÷", "1", "22", "#", " ", "\n", "<|endoftext|>", "…", "日本", "é", "İ", "\x85", "Σ", "\x1c"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 8))) for _ in range(3000)]
    for text, ids in zip(texts, words.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert pd.Series(texts).map(lambda t: re.sub(r"\s", "", t) == "").any()


def test_toxicity_reads_through_inserted_and_repeated_characters():
    from lingualake.llm import toxicity

    hits = toxicity._Hits(["idiot", "moron", "stupid", "trash"])
    words = {"idxioxt": 0, "moxroxn": 1, "iiidiiiooott": 0, "ssttuuppiidd": 2, "stxupxidly": 2, "i*d*i*o*t": 0, "idi0t": 0}
    hits.learn({*words, "mormon", "thrash", "idixxxxot", "", "i"})
    assert all(dict(hits.known[w]).get(mark, 0) > 0.99 for w, mark in words.items())
    assert all(max(dict(hits.known[w] or ()).values(), default=0) < 0.9 for w in ("mormon", "thrash", "idixxxxot", "", "i"))
