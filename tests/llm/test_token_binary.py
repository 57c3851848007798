import io
import random
import zlib

import numpy as np
import pytest
from common_docs import no_docs, odd_docs, odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import range_coder as R
from lexloom.llm import token_binary as B
from lexloom.llm import word_ids as W
from lexloom.llm.common import fresh_dir

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
TOKENIZER = tokenizers.Tokenizer.from_file(PATH)
MERGER = B.PieceMerger(PATH)


def whole(texts):
    """Ids by the library's own encoding of whole texts."""
    return [TOKENIZER.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_words_give_the_ids_of_whole_texts(sf_dir):
    import pyarrow.parquet as pq

    rng = random.Random(4)
    pieces = ["don't", "I'M", "it's", "'s", "a1b2", "№5", "x²", "½", "ﬁ", "İ", "ǅ", "e\u0301", "\u00a0", "\u2028", "\x0b", "\x0c", "\x1c", "\x85", "\u200b", "\ufeff", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "#$%", "漢字", "\U0001f600\U0001f3fd", "ß", "ΑΣ", "Σ", "_", "__x", "3.14", "o'clock", "'LL", "''re", "\u3000", "—", "…", "ａ"]
    texts = [None, "", "  ", *("".join(rng.choice(pieces) + rng.choice(["", "", " ", "\n", "\t", "\r\n"]) for _ in range(30)) for _ in range(300))]
    texts += [t for t in pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()]
    got = B.WordEncoder(PATH, True).encode(texts)
    for text, a, b in zip(texts, got, whole(texts)):
        assert a.tolist() == b, text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" '\n<|>sSdDlL1tm")), max_size=40))
def test_any_text_gives_the_ids_of_the_whole(text):
    assert B.encoder(PATH, True).encode([text])[0].tolist() == whole([text])[0]


def test_chunks_and_forgetting_change_no_id(monkeypatch):
    rng = random.Random(12)
    texts = [prose(rng, rng.choice([0, 3, 200])) + rng.choice(["", " ", "\n\u00e9\u0301x "]) for _ in range(60)] + ["a" * 5000 + " b" * 2000]
    want = whole(texts)
    monkeypatch.setattr(W, "CHUNK", 300)
    monkeypatch.setattr(W, "ENTRIES", 200)
    got = B.WordEncoder(PATH, True).encode(texts)
    assert [x.tolist() for x in got] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abcdefghilnorstxyz'", min_size=1, max_size=30), min_size=1, max_size=20))
def test_merging_in_step_is_the_tokenizer(pieces):
    pieces = [p.replace("'", "") or "a" for p in pieces]
    raw = np.frombuffer("".join(pieces).encode(), np.uint8)
    ids, counts = MERGER.merge(raw, np.array([len(p) for p in pieces]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == whole(pieces)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 65535), min_size=1, max_size=300), st.integers(1, 64))
def test_range_coder_round_trip(ids, block):
    old, R.BLOCK = R.BLOCK, block
    try:
        x = np.array(ids, np.uint16)
        table = R.start_table(x)
        assert table[1].sum() == R.TOTAL and table[1].min() > 0 and set(table[0].tolist()) == set(ids)
        assert (R.decode_blocks(len(x), table, *R.encode_blocks(x, table)) == x).all()
    finally:
        R.BLOCK = old


def coded(x):
    """Bytes of all blocks and the starting table."""
    table = R.start_table(x)
    words, crc, payload = R.encode_blocks(x, table)
    assert (R.decode_blocks(len(x), table, words, crc, payload) == x).all()
    return 2 * len(payload) + len(B._pack_table(table))


def test_blocks_stand_alone_and_are_checked():
    rng = np.random.default_rng(1)
    x = rng.zipf(1.3, 3 * R.BLOCK + 100).clip(0, 60000).astype(np.uint16)
    table = R.start_table(x)
    words, crc, payload = R.encode_blocks(x, table)
    start = int(words[0])
    one = R.decode_blocks(R.BLOCK, table, words[1:2], crc[1:2], payload[start : start + int(words[1])])
    assert (one == x[R.BLOCK : 2 * R.BLOCK]).all()
    # The same ids are coded alike wherever the block stands.
    again = R.encode_blocks(x[R.BLOCK : 2 * R.BLOCK], table)
    assert (again[2] == payload[start : start + int(words[1])]).all()
    broken = payload.copy()
    broken[start + 5] ^= 77
    with pytest.raises(ValueError, match="block 1"):
        R.decode_blocks(len(x), table, words, crc, broken)


def test_predictions_are_mixed_and_adapt():
    assert R.BLOCK >= 4096
    rng = random.Random(2)
    # Two equally likely successors of each of 64 ids: one bit an id.
    after = [(rng.randrange(64), rng.randrange(64)) for _ in range(64)]
    chain, at = [], 0
    for _ in range(20 * R.BLOCK):
        at = rng.choice(after[at])
        chain.append(at * 500)
    assert coded(np.array(chain, np.uint16)) * 8 / len(chain) < 1.5
    # Ids of one half in even blocks, of the other in odd ones: order 0 must follow the block.
    halves = np.concatenate([np.random.default_rng(i).integers(0, 100, R.BLOCK) + 100 * (i % 2) for i in range(8)]).astype(np.uint16)
    assert coded(halves) * 8 / len(halves) < np.log2(200) - 0.5
    phrase = [rng.randrange(40000) for _ in range(50)]
    x = np.array([w for _ in range(400) for w in (phrase if rng.random() < 0.7 else [rng.randrange(40000) for _ in range(20)])], np.uint16)
    share = np.bincount(x, minlength=1 << 16)[x] / len(x)
    assert 2 * R.encode_blocks(x, R.start_table(x))[0].sum() < 0.7 * -np.log2(share).sum() / 8


def test_bytes_an_id_of_supplied_texts(sf_dir):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf_dir}/../sf0.1/documents.parquet")["text"].to_pylist()[:2500]
    ids = np.concatenate([np.append(x, np.uint16(1)) for x in B.WordEncoder(PATH, True).encode(texts)])
    assert coded(ids) / len(ids) < 0.98


def test_two_words_end_a_block():
    """Five ids that all but certainly come take no word of their own; carries reach over full words."""
    words = R.encode_blocks(np.zeros(5, np.uint16), R.start_table(np.zeros(5, np.uint16)))[0]
    assert words.tolist() == [2]
    assert R._carry(np.array([7, 0xFFFF, 0xFFFF, 0x10005, 0, 0x1FFFF], np.uint32)).tolist() == [8, 0, 0, 5, 1, 0xFFFF]


def test_pieces_around_eight_bytes():
    """Pieces of up to eight bytes and longer ones that start alike are told apart."""
    words = ["abcdefgh"[:n] + "ijklmnopqrstuvwxyz"[:m] for n in (1, 7, 8) for m in (0, 1, 8, 9, 16, 17)]
    texts = [" ".join(words), " ".join(reversed(words)), *words]
    got = B.WordEncoder(PATH, True).encode(texts)
    assert [x.tolist() for x in got] == whole(texts)


def test_uniform_and_single_ids():
    for x in (np.zeros(10_000, np.uint16), np.arange(65536).astype(np.uint16), np.array([65535], np.uint16), np.array([0, 65535] * 5000, np.uint16)):
        coded(x)
    assert R.max_lanes(1 << 16) < R.max_lanes(4000) <= R.LANES


def test_file_round_trip(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(R, "STATE_BYTES", 600_000)  # few blocks in step, so several groups
    rows = [(None, [1]), (-5, [1]), *((i, [rng.randrange(50000) for _ in range(rng.choice([1, 2, 500, 9000]))]) for i in range(40))]
    out = io.BytesIO()
    file = B.TokenFile(out)
    for key, ids in rows:
        file.add(key, np.array(ids, np.uint16))
    assert file.close() == (len(rows), sum(len(r[1]) for r in rows)) and len(file.groups) > 1
    data = out.getvalue()
    assert [(k, ids.tolist()) for k, ids in B.read_file(io.BytesIO(data), len(data))] == rows
    flat = [i for _, ids in rows for i in ids]
    assert B.read_block(io.BytesIO(data), len(data), 3).tolist() == flat[3 * R.BLOCK : 4 * R.BLOCK]
    for place in (0, 1, 7, len(rows) - 1):
        key, ids = B.read_document(io.BytesIO(data), len(data), place)
        assert (key, ids.tolist()) == rows[place]
    with pytest.raises(ValueError):
        broken = bytearray(data)
        broken[len(data) - 60] ^= 1
        list(B.read_file(io.BytesIO(bytes(broken)), len(data)))


def test_files_are_rolled_and_hot_ids_are_cut(spark, monkeypatch):
    """A third of all rows with one id (or none) goes to several partitions, a partition to several files."""
    rng = random.Random(4)
    monkeypatch.setattr(B, "PARTITION_BYTES", 4000)
    monkeypatch.setattr(B, "FILE_IDS", 300)
    rows = [(None if i % 3 == 0 else i, prose(rng, 20)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = B.write_ids(docs, fresh_dir(spark, "test"), PATH, 1, True)
    assert len({m[0] for m in manifest}) > 3
    got = B.read_ids(spark, manifest, with_ids=True).collect()
    want = sorted((str(k), [*ids, 1]) for (k, _), ids in zip(rows, whole([t for _, t in rows])))
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want


def test_written_and_read_back(spark):
    docs = odd_docs(spark)
    rows = B.write_and_read(docs, PATH).collect()
    given = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [r[1] for r in given]
    want = sorted((str(r[0]), len(i) + 1, zlib.crc32(np.array([*i, 1], "<u4").tobytes())) for r, i in zip(given, whole(texts)))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert order == sorted(order)
    assert B.write_and_read(no_docs(spark), PATH).count() == 0


def test_ids_come_back_whole(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.choice([1, 10, 3000])) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    manifest = B.write_ids(docs, fresh_dir(spark, "test"), PATH, 1, True)
    got = {r["doc_id"]: r["ids"] for r in B.read_ids(spark, manifest, with_ids=True).collect()}
    assert got == {i: [*ids, 1] for i, ids in enumerate(whole(texts))}
