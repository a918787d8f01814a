import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pageloom.llm import bpe, matrices, packing, queries
from pageloom.llm.packing import SumOfSquares

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return lambda t: [*found.encode(t or "", add_special_tokens=False).ids, 1]


@pytest.fixture(scope="module")
def model():
    return queries.byte_bpe()


def texts_of(spark, corpus):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()}


def test_segment_tree_merges_as_the_library():
    with open(MULTI, "rb") as f:
        own = bpe.SegmentTreeBpe(f.read())
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    random.seed(1)
    hard = ["ab" * 2000, "日本語" * 700, "", " ", "  x", *("".join(random.choice("ab \n\t's1é.　!") for _ in range(50)) for _ in range(500))]
    for text, ids in zip(hard, own.cache(public_tokenizers.PATTERN).encode(hard), strict=True):
        found = np.frombuffer(ids, dtype="<u4").tolist()
        assert found == encoding.encode_ordinary(text)
        assert own.decode(found) == text.encode()


def test_op1_digests(spark, corpus):
    with open(MULTI, "rb") as f:
        ranks = bpe.SegmentTreeBpe(f.read()).ranks
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = texts_of(spark, corpus)
    for r in queries.op1_byte_bpe(spark, corpus).collect():
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_texts_round_trip(documents, odd):
    found = {r.doc_id: r for r in bpe.encode(documents(*odd).withColumn("ids", F.lit(7)), MULTI, public_tokenizers.PATTERN).collect()}
    assert [bytes(found[i].decoded).decode() for i in range(len(odd))] == [t or "" for t in odd]
    assert bpe.encode(documents(), MULTI, public_tokenizers.PATTERN).count() == 0


def check_pieces(rows, ids_of, capacity):
    """Every id in one piece, sequences gapless and not too long."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            part = np.array(ids[at : at + r.length], dtype="<u4").tobytes()
            assert (r.ids_crc32 if "ids_crc32" in r else zlib.crc32(bytes(r.ids))) == zlib.crc32(part)
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return by_sequence


def test_op2_is_lossless_and_tight(spark, corpus, library):
    rows = queries.op2_packing(spark, corpus).collect()
    found = check_pieces(rows, {k: library(t) for k, t in texts_of(spark, corpus).items()}, 2048)
    parts = spark.read.parquet(f"{corpus}/documents.parquet").rdd.getNumPartitions()
    assert sum(sum(r.length for r in s) < 2048 for s in found.values()) <= parts


def test_packing_odd_texts(documents, odd, library, model):
    rows = packing.pack(documents(*odd).withColumn("start", F.lit("x")), model, capacity=64).collect()
    check_pieces(rows, {i: library(t) for i, t in enumerate(odd)}, 64)
    assert packing.pack(documents(), model).count() == 0


def test_sum_of_squares_chooses_the_level_of_the_smallest_sum():
    random.seed(3)
    packer, counts = SumOfSquares(20), {}
    for n in range(400):
        size = random.randint(1, 19)
        def after(level):
            new = dict(counts)
            if level:
                new[level] -= 1
            if level + size < 20:
                new[level + size] = new.get(level + size, 0) + 1
            return sum(v * v for v in new.values()), -level, new
        best = min((after(h) for h in [0, *(h for h, v in counts.items() if v and h + size <= 20)]), key=lambda x: x[:2])
        packer.place((n, 0, size, bytes(4 * size)))
        counts = best[2]
        assert {h: int(v) for h, v in enumerate(packer.count) if v} == {h: v for h, v in counts.items() if v}


def test_open_windows_are_bounded():
    packer = SumOfSquares(20, most_open=8)
    for n in range(200):
        packer.add(n, bytes(4 * 11))
    packer.close()
    lengths = [sum(len(p[3]) // 4 for p in w) for _, w in packer.full]
    assert sum(lengths) == 2200 and sum(x < 20 for x in lengths) <= 1


def test_best_fit_decreasing_against_a_plain_search():
    random.seed(4)
    pieces = [(n, 0, bytes(4 * random.randint(1, 50))) for n in range(500)]
    plain = []
    for p in sorted(pieces, key=lambda p: -len(p[2])):
        fits = [b for b in plain if sum(len(x[2]) for x in b) + len(p[2]) <= 200]
        if fits:
            max(fits, key=lambda b: sum(len(x[2]) for x in b)).append(p)
        else:
            plain.append([p])
    found = matrices.best_fit_decreasing(pieces, 50)
    assert sorted(sum(len(x[2]) for x in b) for b in found) == sorted(sum(len(x[2]) for x in b) for b in plain)


def test_matrices_hold_every_document(documents, odd, library, model):
    parts = {}
    for r in matrices.matrices(documents(*odd).withColumn("ids", F.lit(1)), model, capacity=64, block_tokens=200).collect():
        ids, positions = np.frombuffer(r.ids, dtype="<u4"), np.frombuffer(r.position_ids, dtype="<u4")
        assert len(ids) == len(positions) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for doc_id, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert positions[a:b].tolist() == list(range(start, start + b - a))
            parts.setdefault(doc_id, {})[start] = ids[a:b].tolist()
    assert {k: sum((v[s] for s in sorted(v)), []) for k, v in parts.items()} == {i: library(t) for i, t in enumerate(odd)}
    assert matrices.matrices(documents(), model).count() == 0


def test_a_model_that_ranks_cannot_replace_goes_through_the_library(model, odd):
    import json

    parsed = json.loads(model.model)
    parsed["model"]["ignore_merges"] = True
    from pageloom.llm.tokens import LibraryEncoder, byte_ranks
    assert byte_ranks(json.dumps(parsed)) is None
    assert list(LibraryEncoder(model.model).encode(odd)) == list(model.encoder().encode(odd))
