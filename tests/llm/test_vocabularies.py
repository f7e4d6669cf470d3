"""Byte-level encoding against the tokenizer library."""

import hashlib
import random

import public_tokenizers
import tiktoken

from lingualake.llm import byte_bpe, queries

from .test_operators import LONG, ODD, docs, table

SF = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.Ranks(RANKS, PATTERN).ranks, special_tokens={})


def test_chunks_and_merges_are_the_librarys():
    rng, chunks, other = random.Random(1), byte_bpe._Chunks(RANKS, PATTERN, {}), library()
    texts = ["".join(rng.choices("abcdeABC 012  \n\t'stre.,!é一Ж \x1c\x85\0\U0001f600٣", k=rng.randint(0, 60))) for _ in range(5000)]
    texts += ["".join(rng.choices("ab", k=rng.randint(0, 300))) for _ in range(100)] + ["x" * 50_000, " " * 5000, " " * 777 + "a", "a\n\n\nb \n", " ", "\n", "\n\nab\n\ncd\n\n", "-" * 3000, " \0a", "\0a b"]
    for first in range(0, len(texts), 500):
        block = texts[first : first + 500]
        for text, found in zip(block, chunks.forms(block), strict=True):
            assert [int(i) for x, _ in found for i in x.split(",")] == other.encode_ordinary(text)
            assert b"".join(x for _, x in found) == text.encode()


def test_merges_of_tables_whose_ranks_fall():
    rng = random.Random(3)
    for _ in range(200):
        ranks = {bytes([b]): b for b in range(256)}
        own = byte_bpe.Ranks(RANKS, PATTERN)
        for _ in range(rng.randint(1, 25)):
            ranks.setdefault("".join(rng.choices("abc", k=rng.randint(2, 5))).encode(), 256 + rng.randrange(1000))
        ranks = dict(zip(ranks, [*range(256), *rng.sample(range(256, 300), len(ranks) - 256)], strict=True))
        own.ranks, own.tokens = ranks, {r: t for t, r in ranks.items()}
        own.bytes, own.unions = list(range(256)), byte_bpe._Unions(ranks, own.tokens)
        other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        texts = ["".join(rng.choices("abc", k=rng.randint(1, 30))) for _ in range(20)]
        found = own.encode_all([f"\0{t}" for t in texts])
        assert [found[f"\0{t}"] for t in texts] == [other.encode_ordinary(t) for t in texts]


def test_query_against_the_library(spark):
    other = library()
    found = table(queries.op11_byte_bpe(spark, SF))
    for row in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = other.encode_ordinary(row["text"] or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[row["doc_id"]][1:] == (len(ids), digest, hashlib.sha256((row["text"] or "").encode()).hexdigest())


def test_odd_rows_round_trip(spark):
    rows = byte_bpe.encode(docs(spark, ODD), RANKS, PATTERN)
    texts = byte_bpe.decode(rows, RANKS, PATTERN).collect()
    assert sorted((r["id"] or -1, r["text"]) for r in texts) == sorted((i or -1, t or "") for i, t in ODD)
    found = byte_bpe.digests(docs(spark, ODD), RANKS, PATTERN).collect()
    assert len(found) == len(ODD) and sum(r["n_tokens"] == 0 for r in found) == 3
    assert byte_bpe.digests(docs(spark, []), RANKS, PATTERN).collect() == []


def test_few_frequent_chunks_change_nothing(spark, monkeypatch):
    table = docs(spark, [(1, LONG), (2, "word1 word1 word1 word2"), (3, None)])
    before = byte_bpe.encode(table, RANKS, PATTERN).collect()
    monkeypatch.setattr(byte_bpe, "FREQUENT", 5)
    assert len(byte_bpe.frequent_chunks(table, RANKS, PATTERN)) <= 5
    assert byte_bpe.encode(table, RANKS, PATTERN).collect() == before


def test_short_words_are_not_merged_by_the_index_of_places(monkeypatch):
    own, other, rng, seen = byte_bpe.Ranks(RANKS, PATTERN), library(), random.Random(5), []
    monkeypatch.setattr(own, "_replay_long", lambda words, f=own._replay_long: (seen.extend(words), f(words))[1])
    words = ["".join(rng.choices("abcdestrinéЖ一", k=rng.randint(1, 40))) for _ in range(2000)]
    assert own.replay([w.encode() for w in words]) == [other.encode_ordinary(w) for w in words]
    assert seen and min(map(len, seen)) > byte_bpe.SHORT
