import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from plumbline.llm import bpe, packing, rans
from plumbline.session import work_path
from tests.llm.rows import documents, none


@pytest.fixture(scope="module")
def plain():
    out = Tokenizer.from_file(bpe.VOCABULARY)
    out.encode_special_tokens = True
    return out


def ids_by_hand(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_give_the_ids_of_the_whole_text(plain):
    rng = random.Random(1)
    letters = "ab \n\té.,'s1²  日ʼnǆA!?"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += ["", " ", "  ", "a.\nB c", "a\n\n  b", "<|endoftext|> a<|endoftext|>", "x\x0by \x85z", "don't  it's 3x²", "Wort,\nWort. ǅ"]
    ids, counts = bpe.encode(pa.array([*texts, None]))
    ends = np.cumsum(counts)
    for text, n, end in zip(texts, counts, ends):
        assert ids[end - n : end].tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert counts[-1] == 0


def test_memory_is_dropped_when_full(monkeypatch, plain):
    monkeypatch.setattr(bpe, "MOST_PIECES", 2)
    for text in ("one two three four", "five six seven one"):
        assert bpe.encode(pa.array([text]))[0].tolist() == plain.encode(text).ids


@pytest.mark.parametrize("count", [0, 1, 31, 33, 20_000, 70_001])
def test_segment_round_trip(count):
    rng = np.random.default_rng(count)
    ids = np.minimum(rng.geometric(0.002, count), 60_000).astype(np.uint32)
    symbols, counts = np.unique(np.append(ids, [3, 60_001]), return_counts=True)
    table = rans.Table(symbols, counts)
    assert table.parts.sum() == 1 << table.bits and table.parts.min() >= 1
    keys, sizes = ["a", None, "", "ü"], np.array([count // 2, 0, 0, count - count // 2])
    data = rans.pack_segment(keys, sizes, ids, table)
    again = rans.read_table(table.data)
    got = rans.unpack_segment(data, again)
    assert got[0] == keys and got[1].tolist() == sizes.tolist() and np.array_equal(got[2], ids)
    low, high = count // 3, count // 2
    assert np.array_equal(rans.unpack_segment(data, again, low, high)[2], ids[low:high])


def test_damage_and_foreign_tables_are_errors():
    ids = np.arange(5000, dtype=np.uint32) % 50
    table = rans.Table(np.arange(50), np.full(50, 100))
    data = bytearray(rans.pack_segment(["k"], np.array([5000]), ids, table))
    with pytest.raises(ValueError, match="another"):
        rans.unpack_segment(bytes(data), rans.Table(np.arange(51), np.full(51, 100)))
    data[-3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.unpack_segment(bytes(data), table)


@pytest.mark.parametrize("counts", [[1], [1, 1], [1, 10**9], [1] * 5000 + [10**7], [7] * 3])
def test_tables_are_whole(counts):
    table = rans.Table(np.arange(len(counts)), np.array(counts))
    assert table.parts.sum() == 1 << table.bits and table.parts.min() >= 1


def test_files_hold_every_document(spark, plain, monkeypatch):
    df = documents(spark)
    folder = work_path(spark, "ids")
    index = rans.write_ids(df, folder)
    got = rans.read_ids(index, folder, ids=True).orderBy("start").collect()
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in df.collect()), key=lambda x: x[:2])
    start = 0
    assert [r["id"] for r in got] == [k if known else None for known, k, _ in rows]
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    want = sorted(ids_by_hand(plain, t) for *_, t in rows)
    assert sorted(r["ids"] for r in got) == want


def test_no_documents(spark):
    assert rans.round_trip(none(spark)).count() == 0
    assert packing.pack(none(spark)).count() == 0


def check_plan(lengths, **options):
    sizes, counts = np.unique(lengths, return_counts=True)
    rows = packing.plan(dict(zip(sizes.tolist(), counts.tolist())), **options)
    fill, pieces, seen = {}, {}, {}
    for length, first, n, sequence, per, offset in rows:
        assert seen.get(length, 0) == first
        seen[length] = first + n
        for r in range(n):
            at = sequence + r // per
            assert fill.get(at, 0) == offset + length * (r % per)
            fill[at] = fill.get(at, 0) + length
            pieces[at] = pieces.get(at, 0) + 1
    assert seen == dict(zip(sizes.tolist(), counts.tolist()))
    return fill, pieces


@pytest.mark.parametrize("rule", packing.RULES)
def test_plans_keep_every_capacity(rule):
    rng = np.random.default_rng(0)
    for top in (2048, 300, 20):
        lengths = rng.integers(1, top + 1, 3000)
        fill, pieces = check_plan(lengths, rule=rule)
        assert max(fill.values()) <= 2048 and max(pieces.values()) <= packing.MOST_PIECES
        assert len(fill) <= 1.04 * lengths.sum() / 2048 + 2
    fill, pieces = check_plan(rng.integers(1, 60, 500), rule=rule, most_pieces=7, most_cost=9000.0, weights=(1.0, 1.0, 1.0))
    assert max(pieces.values()) <= 7
    with pytest.raises(ValueError):
        packing.plan({100: 1}, most_cost=10.0)


def test_cuts():
    owner, number, start, length = packing.cut(np.array([1, 2048, 2049, 5000]), 2048)
    assert owner.tolist() == [0, 1, 2, 2, 3, 3, 3]
    assert length.tolist() == [1, 2048, 1, 2048, 904, 2048, 2048]
    assert start.tolist() == [0, 0, 0, 1, 0, 904, 2952] and number.tolist() == [0, 0, 0, 1, 0, 1, 2]


def test_packed_pieces_hold_all_ids(spark, plain):
    df = documents(spark)
    rows = packing.pack(df, ids=True).collect()
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
        assert len(r["ids"]) == r["length"] <= 2048
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    texts = {str(r["doc_id"]): ids_by_hand(plain, r["text"]) for r in df.collect()}
    for r in rows:
        if str(r["doc_id"]) != "11":  # two texts share this id
            assert r["ids"] == texts[str(r["doc_id"])][r["start"] : r["start"] + r["length"]]
    assert sum(fill.values()) == sum(len(ids_by_hand(plain, r["text"])) for r in df.collect())
    whole = {r["sequence_id"]: len(r["ids"]) for r in packing.sequences(packing.pack(df, ids=True)).collect()}
    assert sorted(whole.values()) == sorted(fill.values())


def test_operators_give_the_ids_of_the_library_as_it_is(spark):
    library = Tokenizer.from_file(bpe.VOCABULARY)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y z", "plain words here", "<|endoftext| >", ""]
    want = {i: library.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert 50256 in want[0] and 50256 not in want[3]
    bpe.encode(pa.array(texts))  # pieces remembered as ordinary text stay apart
    for n in (0, 4):
        assert bpe.encode(pa.array([texts[n]]), names_as_text=False)[0].tolist() == want[n][:-1]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    folder = work_path(spark, "ids")
    assert {r["id"]: r["ids"] for r in rans.read_ids(rans.write_ids(df, folder), folder, ids=True).collect()} == want
    assert {r["doc_id"]: r["ids"] for r in packing.pack(df, ids=True).collect()} == want


def test_tiny_texts_share_sequences_and_every_capacity_binds(spark):
    df = spark.createDataFrame([(i, "") for i in range(4096)], "doc_id bigint, text string")
    by_tokens = packing.pack(df, most_pieces=packing.SIZE).select("sequence_id").distinct().count()
    by_pieces = packing.pack(df, most_pieces=1000).select("sequence_id").distinct().count()
    by_cost = packing.pack(df, most_pieces=packing.SIZE, most_cost=512.0).select("sequence_id").distinct().count()
    assert (by_tokens, by_pieces, by_cost) == (2, 5, 8)
