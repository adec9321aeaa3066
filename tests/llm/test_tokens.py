"""Tokenisers against their libraries, block files by round trip, packing against its rules."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from conftest_tables import TABLES, text_rows
from strandline.llm import packing, pfor, pieces, tokens

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = " \n\t\r \u0085\x1c.,!?'sdtmlrev$%abAB12éß²½٣漢字😀<|_-▁\0the"


def texts_of(seed, count=3000):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(count)] + [
        "", None, " ", "  ", "a  b", "x <|endoftext|> y", "word.\n\n", "don't 's", "a" * 3000, "lorem ipsum " * 400]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


@pytest.mark.parametrize("limit", [0, 20_000, tokens.MEMO_BYTES])
def test_byte_pairs_as_the_library(library, limit):
    coder, texts = tokens.ChunkEncoder(BPE, limit), texts_of(1)
    for start in range(0, len(texts), 100):
        part = texts[start:start + 100]
        expected = [library.encode(t or "", add_special_tokens=False).ids for t in part]
        assert [ids.tolist() for ids in coder.encode(part)] == expected


def test_generations_stay_within_their_bytes():
    coder = tokens.ChunkEncoder(BPE, 400_000)
    rng = random.Random(4)
    most = 0
    for _ in range(300):
        words = [f"w{rng.randint(0, 10 ** 6):x}" for _ in range(100)] + ["often", "again"]
        coder.encode([" ".join(words)])
        most = max(most, coder.young.bytes, coder.old.bytes)
    assert 0 < most < 800_000 and coder.old.count and coder.young.find(tokens.digests(["often", "never"])).tolist()[1] == -1
    assert coder.missing(["often", "again", "never"]) == ["never"]


def test_pieces_as_the_library():
    coder, texts = pieces.PieceEncoder(PIECES), texts_of(2)
    got = coder.encode(texts)
    assert [ids.tolist() for ids in got] == [coder.model.encode(t or "") for t in texts]
    plain = [i for i, t in enumerate(texts) if t and "▁" not in t]
    assert all(coder.decode(got[i]) == texts[i] for i in plain)


def test_suffix_array_finds_all_occurrences():
    coder = pieces.PieceEncoder(PIECES)
    text = "▁the▁other\0▁mother\0éther"
    found = sorted(zip(*(x.tolist() for x in coder.occurrences(text))))
    assert found == sorted((i, n) for name, n in coder.id_of.items() for i in range(len(text)) if text.startswith(name, i))


def test_pieces_of_a_table(spark, shared):
    rows = pieces.encode_documents(text_rows(spark, ["a b", None, "", "漢 x"], extra=True), PIECES).orderBy("doc_id").collect()
    assert [(r.n_ids, r.restored) for r in rows] == [(2, True), (0, True), (0, True), (5, True)]
    assert pieces.encode_documents(text_rows(spark, []), PIECES).collect() == []


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for _ in range(200):
        values = rng.integers(0, 2 ** int(rng.integers(1, 33)), int(rng.integers(1, 5000))).astype(np.uint32)
        if rng.random() < 0.3:
            values[:] = values[0]
        assert (pfor.decode_block(pfor.encode_block(values, rng.random())) == values).all()
    steady = np.full(4096, 7, np.uint32)
    steady[5] = 2 ** 31
    assert len(pfor.encode_block(steady)) == 11 + 6     # all but one id in no bits, one exception


def expected_documents(library, rows):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_stored_tokens(spark, shared, library):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(texts_of(3, 300))] + [(None, "no key"), (7, "again"), (7, "again"), (-4, "first")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(7)
    got = pfor.store_tokens(docs, BPE, parts=5).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected_documents(library, rows)
    assert pfor.store_tokens(docs.limit(0), BPE, parts=3).collect() == []


def test_reading_from_a_block_on(tmp_path):
    ids = np.random.default_rng(1).integers(0, 50_000, 100_000).astype(np.uint32)
    with open(tmp_path / "x", "wb") as out:
        writer = pfor.Writer(out, block=512)
        for i, part in enumerate(np.array_split(ids, 37)):
            writer.add(None if i == 3 else i, part)
        writer.close()
    import pyarrow as pa

    reader = pfor.Reader(pa.OSFile(str(tmp_path / "x")))
    assert (np.concatenate(list(reader.blocks(10, 150))) == ids[5120:76_800]).all() and reader.nulls[3]
    assert os.path.getsize(tmp_path / "x") < 2.1 * len(ids)


def check_places(rows, limit):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences)


def test_packing(spark, shared, library):
    rows = [(i, t) for i, t in enumerate(texts_of(5, 400))] + [(None, "no key"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, length int").repartition(6)
    got = packing.pack_documents(docs, BPE, limit=64).collect()
    cut = []
    for doc_id, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % 64 or 64
        bounds = [0, *range(first, len(ids) + 1, 64)]
        cut += [(doc_id, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(cut, key=repr)
    least = -(-sum(c[3] for c in cut) // 64)
    assert check_places(got, 64) <= 1.05 * least + 1
    assert packing.pack_documents(docs.limit(0), BPE).collect() == []


def test_packing_of_the_table(spark, shared):
    docs = spark.read.parquet(str(TABLES / "documents.parquet"))
    got = packing.pack_documents(docs, BPE).collect()
    assert check_places(got, 2048) <= 1.02 * sum(r["length"] for r in got) / 2048 + 1


def test_pack_lengths():
    rng = random.Random(7)
    for _ in range(150):
        limit = rng.choice([8, 16, 50])
        counts = {rng.randint(1, limit): rng.randint(1, 40) for _ in range(rng.randint(0, 20))}
        seen, fill = {}, {}
        for length, first, count, sequence, offset in packing.pack_lengths(counts, limit, groups=rng.randint(1, 20)):
            seen.setdefault(length, []).append((first, count))
            for k in range(count):
                fill.setdefault(sequence + k, []).append({"sequence_id": sequence + k, "offset": offset, "length": length})
        for length, runs in seen.items():
            at = 0
            for first, count in sorted(runs):
                assert first == at
                at += count
            assert at == counts[length]
        assert set(seen) == set(counts)
        check_places([p for places in fill.values() for p in places], limit)
