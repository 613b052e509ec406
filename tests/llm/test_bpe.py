import hashlib
import random

from spanloom.llm import bpe

PATH = bpe.vocabulary_path()


def want(text):
    ids = bpe.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids
    return ids, bpe.tokenizer(PATH).decode(ids, skip_special_tokens=False)


def test_words_of_random_texts():
    rnd = random.Random(5)
    pool = [chr(c) for c in [*range(0x250), 0x85, 0xA0, 0x1680, 0x2028, 0x3000, 0xFEFF, 0x4E00, 0x660, 0x1F600, 0x301, 0x2160, 0xB2, 0x1D7CE]]
    pool += [" "] * 60 + ["\n"] * 20 + ["'s", "'ll", "<|endoftext|>", "\t", " 12"] * 6
    words, table = bpe.splitter(PATH), bpe.pieces(PATH)
    for _ in range(1500):
        text = "".join(rnd.choices(pool, k=rnd.randint(0, 40)))
        ids, back = want(text)
        assert ids == [i for e in bpe.tokenizer(PATH).encode_batch(words(text), add_special_tokens=False) for i in e.ids]
        assert bpe.join_pieces(ids, table) == back


def test_ids_and_texts(spark, awkward):
    for block in (1 << 20, 2000):  # a block of many texts, and many blocks
        got = bpe.decode(bpe.encode(awkward, block_bytes=block)).collect()
        assert sorted((r.doc_id or -1, r.ids, r.decoded) for r in got) == sorted((r.doc_id or -1, *want(r.text)) for r in awkward.collect())


def test_digests(spark, small):
    got = {r.doc_id: r for r in bpe.round_trip(small).collect()}
    for r in small.collect():
        ids, back = want(r.text)
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert g.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_empty_table_and_odd_ids(spark, small):
    assert bpe.round_trip(small.limit(0)).count() == 0
    df = spark.createDataFrame([([464, None, 99_999, -3],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(df).collect()] == ["The", "", ""]


def test_a_hot_row_and_few_parts(spark, monkeypatch):
    """A third of all rows are equal, in many input partitions; there are fewer parts than blocks."""
    monkeypatch.setattr(bpe, "PARTS", 3)
    rows = [(1, "the same old text, again")] * 300 + [(i, f"another text number {i} of many") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = bpe.encode(df, block_bytes=1500).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((k, want(t)[0]) for k, t in rows)
