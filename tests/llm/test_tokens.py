"""op8, op9, op10 against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe, packed_ids, token_counts

SCHEMA = "doc_id long, text string, ids string, extra int"
HARD = ["", None, "a", " ", "  x", "a  \n\n b\t", "don't 'll !'t", "x<|endoftext|>y <|endoftext|>", "é è　漢字 ß", "word " * 9000, "\U0001f600" * 50, "a" * 5000, "\x1c\x85 \r\x0b end "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.tokenizer_path())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 3 % 40, t, "clash", None) for k, t in enumerate(HARD)] + [(5, "tie", "x", 1), (5, "tie", "x", 1), (5, "other", "x", 1), (None, "no id", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_random_texts_encode_as_the_library_does(library):
    rnd, codec = random.Random(7), bpe.Codec(bpe.tokenizer_path())
    letters = [*"ab  \n\t'sdlvret!.,<|>endoftext 019é\xa0　漢ß€​\x1c\x85\r\x0b", "<|endoftext|>", "'s", " the", "\U0001f600"]
    for _ in range(4000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30)))
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(next(codec.encode([text.encode()])), "<u4").tolist() == want, repr(text)
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_words_merge_as_the_library_does(library):
    """Random words of Latin letters and of digits, with and without a blank, and every token of the vocabulary that is one."""
    rnd, codec = random.Random(11), bpe.Codec(bpe.tokenizer_path())
    assert codec.memo.merge is not None
    letters = "etaoinshrdlucmfwypvbgkjqxzETAOINéèüßñçøæłőžßđ"
    words = ["".join(rnd.choices(letters, k=rnd.randint(1, 14))) for _ in range(20_000)] + [str(rnd.randrange(10 ** rnd.randint(1, 12))) for _ in range(5000)]
    words += [b.decode() for b in codec.bytes_of if b and b.isascii()]
    for w in words:
        for text in (w, " " + w):
            raw = text.encode()
            if bpe.one_word(raw):
                assert list(codec.memo.merge(raw)) == library.encode(text, add_special_tokens=False).ids, text
    assert [bpe.one_word(t.encode()) for t in ("a", " a", " Straße", "12", " 12", "a1", "  a", " ", "a'", "\u6f22", "x\u0301", "\u00bd", " \u0259")] == [True] * 5 + [False] * 8


def test_memo_generations_do_not_change_ids(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 900)
    monkeypatch.setattr(bpe, "PIECE", 20)
    codec = bpe.Codec(bpe.tokenizer_path())
    texts = [f"some words {k % 3} again, <|endoftext|> and {k}" + "acgt" * (k % 9) for k in range(50)]
    for text, raw in zip(texts, codec.encode([t.encode() for t in texts])):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def unbroken(seed=3, size=100_000):
    """Long runs without white space: digits, letters of DNA, base64, one letter, CJK."""
    rnd = random.Random(seed)
    sets = ["0123456789", "ACGT", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "a", "\u6f22\u5b57\u4eee\u540d"]
    return ["".join(rnd.choices(s, k=size)) for s in sets]


def test_long_fragments_leave_the_memo_small(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 1 << 20)
    codec = bpe.Codec(bpe.tokenizer_path())
    texts = [t for seed in range(3) for t in unbroken(seed)] + ["many words " + " ".join(f"w{k * 7919 % 99991}" for k in range(60_000))]
    for text in texts:
        raw = codec.encode_one(text.encode())
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == want
        assert codec.digests(np.array(want, "<u4")) == (hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest())
    for generation in (codec.memo, codec.memo.past):
        assert sum(len(f) + len(i) + bpe._ENTRY for f, i in generation.items()) <= 1 << 20
        assert max(map(len, generation), default=0) <= bpe.MEMO_FRAGMENT


def test_round_trip_query(spark, docs, library):
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.encode_decode(docs).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.encode_decode(docs.limit(0)).count() == 0


@pytest.mark.parametrize("width", [1, 7, 16, 17, 31, 32])
def test_pack_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001, dtype=np.uint64).astype("<u4")
    data = packed_ids.pack(ids, width)
    assert len(data) == (1001 * width + 7) // 8
    assert (packed_ids.unpack(data, 1001, width) == ids).all()
    assert packed_ids.width_of(50257) == 16 and packed_ids.width_of(2) == 1 and packed_ids.width_of(65537) == 17


def test_packed_files_read_back(docs, library, monkeypatch):
    got = packed_ids.write_and_read(docs).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    crc = lambda t: zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in got) == sorted((r.doc_id or -1, crc(r.text)) for r in rows)
    assert packed_ids.write_and_read(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [7, 1000, 1 << 20])
def test_counts_from_flat_files(spark, docs, block):
    from millrace.llm.common import fresh_dir

    library = Tokenizer.from_file(bpe.tokenizer_path())
    library.encode_special_tokens = True
    folder = fresh_dir(spark, "flat-test")
    files = token_counts.write_flat(docs.repartition(3), folder)
    got = token_counts.count(spark, folder, files, block=block)
    want = sorted((r.doc_id or -1, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got.collect()) == want


def test_counts_of_no_documents(docs):
    assert token_counts.write_and_count(docs.limit(0)).count() == 0


def test_many_blocks_take_a_fixed_number_of_tasks(spark, docs):
    from millrace.llm.common import fresh_dir

    folder = fresh_dir(spark, "flat-test")
    files = token_counts.write_flat(docs.repartition(2), folder)
    got = token_counts.count(spark, folder, files, block=64)
    seen = []
    spark.sparkContext.setJobGroup("blocks", "blocks")
    assert got.count() == docs.count()
    tracker = spark.sparkContext.statusTracker()
    for job in tracker.getJobIdsForGroup("blocks"):
        for stage in tracker.getJobInfo(job).stageIds:
            info = tracker.getStageInfo(stage)
            seen.append(info.numTasks if info else 0)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(n for _, n in files) // 64 > 50
    assert max(seen) <= token_counts.SCAN_TASKS * spark.sparkContext.defaultParallelism


def test_a_second_attempt_leaves_the_first_one_whole(tmp_path):
    from pyarrow import fs

    store = fs.LocalFileSystem()
    for own, text in (("a", b"first"), ("b", b"second")):
        store.create_dir(f"{tmp_path}/.{own}")
        for name in ("tok", "doc"):
            (tmp_path / f".{own}" / name).write_bytes(text)
        token_counts.commit(store, f"{tmp_path}/.{own}", f"{tmp_path}/flat")
    assert {(tmp_path / "flat" / n).read_bytes() for n in ("tok", "doc")} == {b"first"}
    assert not (tmp_path / ".b").exists()
