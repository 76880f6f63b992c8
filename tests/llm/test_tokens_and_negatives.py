"""Token files, tokenizer alignment and hard negatives against plain versions, on small frames."""

import bisect
import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.sql_compare import same
from weftlab.llm import align, hard_negatives, pieces, queries, token_files
from weftlab.session import new_path

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["'", "'s", "'re", "'ll", "'ve", "'d", "'t", "t", "re", " ", "  ", "\n", "\t", "a", "word", "é", "漢", "字", "😀", "1", "23", "_", "-", "<|endoftext|>", "<s>", " ", "\x00", "It's", "<0x0A>"]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def odd_texts(n, seed=1, most=14, more=()):
    rng = random.Random(seed)
    return ["".join(rng.choice([*PARTS, *more]) for _ in range(rng.randrange(most))) for _ in range(n)]


def frame(spark, rows):
    """Documents with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "x", 1, 2.0, "y") for i, t in rows], "doc_id long, text string, shard string, n_tokens int, start double, ids_crc32 string")


def test_pieces_encode_as_the_libraries_do():
    texts = odd_texts(3000)
    byte, piece = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    assert [x.tolist() for x in pieces.byte_level(A).encode(texts)] == [byte.encode(t, add_special_tokens=False).ids for t in texts]
    byte.encode_special_tokens = True
    assert [x.tolist() for x in pieces.byte_level(A, True).encode([*texts, None])] == [*(byte.encode(t, add_special_tokens=False).ids for t in texts), []]
    assert [x.tolist() for x in pieces.blank_led(B).encode([" " + t if t else "" for t in texts])] == [piece.encode(t) for t in texts]


def test_every_code_point_encodes_as_the_library_does():
    texts = ["".join(map(chr, range(lo, lo + 64))) for lo in range(0, 0x3000, 64)] + [f"a{chr(c)}'s {chr(c)} b" for c in range(1, 0x3000, 7)]
    tokenizer = Tokenizer.from_file(A)
    assert [x.tolist() for x in pieces.byte_level(A).encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def plain_token_rows(rows):
    tokenizer, at, out = Tokenizer.from_file(A), 0, []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


def test_token_files_round_trip(spark):
    rows = [(i * 7 % 307, t) for i, t in enumerate(odd_texts(300))] + [(400, None), (401, ""), (402, "<|endoftext|>"), (403, "long text " * 20_000), (404, "x" * 50_000)]
    path = new_path(spark, "tokens")
    token_files.write_tokens(frame(spark, rows).repartition(5), path, shards=7)
    got = token_files.read_tokens(spark, path, with_ids=True)
    assert got.columns == ["doc_id", "place", "start", "n_tokens", "ids_crc32", "ids"]
    found = sorted(map(tuple, got.collect()), key=lambda r: r[1])
    want = plain_token_rows(sorted(rows, key=lambda r: r[0]))
    assert [(r[0], *r[2:]) for r in found] == want and [r[1] for r in found] == list(range(len(rows)))
    shards = token_files.manifest(spark, path).orderBy("shard").collect()
    assert len(shards) > 3 and {s["bits"] for s in shards} == {16} and sum(s["n_docs"] for s in shards) == len(rows)


def test_token_files_of_repeated_and_null_ids(spark):
    rows = [(None, "first"), (None, None), (5, "b"), (5, "a"), (5, "a"), *[(7, f"hot {i}") for i in range(60)], (9, "last")]
    path = new_path(spark, "tokens")
    token_files.write_tokens(frame(spark, rows), path, shards=6)
    found = sorted(map(tuple, token_files.read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None, None, 5, 5, 5, *[7] * 60, 9]
    assert [r[2] for r in found] == np.cumsum([0, *(r[3] for r in found)])[:-1].tolist()
    assert sorted((str(r[0]), r[3], r[4]) for r in found) == sorted((str(r[0]), r[2], r[3]) for r in plain_token_rows(rows))
    assert token_files.manifest(spark, path).filter("n_docs > 40").count() == 0  # the hot id lies in several shards
    none = new_path(spark, "tokens")
    assert token_files.write_tokens(frame(spark, rows).filter("false"), none).count() == 0 and token_files.read_tokens(spark, none).count() == 0


@needs_data
def test_op11_against_the_library(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    got = queries.op11_token_files(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == [r[:4] for r in plain_token_rows(rows)]


def plain_alignment(rows):
    byte, piece, values = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), pieces.byte_values()
    byte.encode_special_tokens = True
    docs = []
    for i, t in rows:
        found = None
        if t:
            a, b = byte.encode(" " + t, add_special_tokens=False).ids, piece.encode(t)
            spelt_a = [bytes(values[c] for c in byte.id_to_token(x)) for x in a]
            spelt_b = [bytes([int(piece.id_to_piece(x)[3:5], 16)]) if piece.is_byte(x) else piece.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if b"".join(spelt_a) == b"".join(spelt_b) == (" " + t).encode():
                ends = [np.cumsum([len(x) for x in s]).tolist() for s in (spelt_a, spelt_b)]
                cuts = sorted(set(ends[0]) & set(ends[1]))
                groups = [([], []) for _ in cuts]
                for side, ids in enumerate((a, b)):
                    for x, e in zip(ids, ends[side], strict=True):
                        groups[bisect.bisect_left(cuts, e)][side].append(x)
                found = a, b, groups
        docs.append((i, found))
    count, best = Counter(), defaultdict(int)
    for _, d in docs:
        count.update({(x, y) for p, q in d[2] for x in p for y in q} if d else ())
    for (x, _), c in count.items():
        best[x] = max(best[x], c)
    out = []
    for i, d in docs:
        if not d:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for p, q in d[2] for x in p for y in q]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in d[2])
        out.append((i, len(d[0]), len(d[1]), len(d[2]), len(links), sum(count[z] == best[z[0]] for z in links), sum(count[z] for z in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("fan", [64, 3])
def test_alignment_against_a_plain_version(spark, monkeypatch, fan):
    monkeypatch.setattr(align, "FAN", fan)  # 3: several levels of both trees
    rows = [*enumerate(odd_texts(150, 2, more=["▁"])), (500, None), (501, ""), (None, "hi there"), (7, "again"), (7, "again"), (502, "aa " * 2000), (503, "x" * 4000 + "yxz" * 500), (504, "漢字" * 900)]
    got = align.align_documents(frame(spark, rows).repartition(20))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_alignment(rows)))


def test_alignment_of_nothing(spark):
    assert align.align_documents(frame(spark, []).filter("false")).count() == 0
    assert [tuple(r)[1:] for r in align.align_documents(frame(spark, [(1, None), (2, "▁")])).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


@needs_data
def test_op12_against_a_plain_version(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op12_tokenizer_alignment(spark, SF).collect())) == sorted(plain_alignment(rows))


def test_large_groups_and_parts_of_links(monkeypatch):
    """One group of many tokens, its links listed in parts, equals the plain product."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, 200), rng.integers(0, 7, 150)
    monkeypatch.setattr(align, "MOST_LINKS", 20)
    found = align.Aligned(a, np.array([0, 200]), b, np.array([0, 150]), np.where(np.arange(9) > -1, 3, 0), np.full(7, 4))
    links = Counter()
    for doc, pair, times in found.links(100):
        assert set(doc.tolist()) <= {0}
        for p, t in zip(pair.tolist(), times.tolist(), strict=True):
            links[p] += t
    ends = [np.cumsum(np.full(len(a), 3)), np.cumsum(np.full(len(b), 4))]
    cuts = np.intersect1d(*ends)
    want = Counter(int(x) * 100 + int(y) for x, i in zip(a, np.searchsorted(cuts, ends[0]), strict=True) for y, j in zip(b, np.searchsorted(cuts, ends[1]), strict=True) if i == j)
    assert links == want


@pytest.mark.parametrize("n", [0, 1, 63, 5000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.int64)
    table = align.PerfectHash(align.PerfectHash.build(keys))
    at, known = table.find(keys)
    assert known.all() and sorted(at.tolist()) == list(range(n)) and table.n == n
    assert not table.find(np.setdiff1d(np.arange(2000), keys))[1].any()


def plain_negatives(rows, positives=5, negatives=3, low=50, high=95):
    once = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        mine = (label, [math.floor(256 * x) for x in v])
        once[i] = min(once.get(i, mine), mine)
    out = []
    for a in sorted(i for i in once if i % 50 == 0):
        label, u = once[a]
        scored = sorted((-sum(x * y for x, y in zip(u, v, strict=True)), i, own == label) for i, (own, v) in once.items() if i != a and len(v) == len(u))
        for s, p, _ in [r for r in scored if r[2]][:positives]:
            fit = [(i, -t) for t, i, alike in scored if not alike and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(fit)]
    return out


VECTORS = "vec_id long, embedding array<double>, label long, rank string, negative_id double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 0.0) for i, v, label in rows], VECTORS)


@pytest.mark.parametrize("clustered", [False, True])
def test_hard_negatives_against_a_plain_version(spark, monkeypatch, clustered):
    monkeypatch.setattr(hard_negatives, "FIRST_RANGE", 40)  # several rounds
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 8))
    rows = [(i, ((centres[i % 6] + 0.2 * rng.standard_normal(8)) if clustered else rng.standard_normal(8)).round(1).tolist(), int(rng.integers(0, 3))) for i in range(900)]
    rows += [(i, rows[7][1], 1) for i in range(1000, 1100)]  # copies: ties
    rows += [(1200, [0.0] * 8, 1), (1250, [math.nan] * 8, 1), (1251, None, 1), (None, [1.0] * 8, 1), (1300, [1.0] * 8, None), (1350, [None] * 8, 1), (1400, [1.0, 2.0], 1), (1401, [1.0, 2.5], 1), (1402, [1.0, 1.5], 0), (1450, [], 1)]
    rows += [rows[50], (100, [5.0] * 8, 2), (1500, [-9.0] * 8, 5)]
    df = vectors(spark, rows)
    got = hard_negatives.hard_negatives(df, df.filter("vec_id % 50 = 0"), clusters=4)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_negatives(rows))


def test_hard_negatives_of_nothing(spark):
    df = vectors(spark, [(0, [1.0], 1)])
    assert hard_negatives.hard_negatives(df.filter("false"), df.filter("false")).count() == 0
    assert hard_negatives.hard_negatives(df, df).count() == 0


def test_lists_end_early_where_anchors_lie_close():
    """A member of a tight cluster leaves the list long before its end."""
    rng = np.random.default_rng(5)
    block = hard_negatives.Block(np.array([0]), np.array([1]), np.array([[100.0] * 16]), 2, 2)
    rows = rng.integers(-100, 100, (500, 16)).astype(np.float64)
    rows[:5] += 300
    block.meet(np.arange(1, 501), np.ones(500, np.int64), rows, False, 50, 95)
    bound = np.sqrt((rows[5:] ** 2).sum(axis=1)) * np.cos(np.maximum(0, hard_negatives._angles(rows[5:], np.full((1, 16), 0.25))[:, 0] - 1e-6))
    assert not block.on_the_way(float(bound.max()), False, 50, 95).any() and block.on_the_way(float(np.inf), False, 50, 95).all()


@needs_data
def test_op13_same_as_sql(spark):
    same(spark, queries.op13_hard_negatives, queries.ORACLE_SQL["op13_hard_negatives"], SF)
