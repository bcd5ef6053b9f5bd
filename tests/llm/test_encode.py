import random

import pytest

from inkweave.llm.bpe import ByteBPE
from inkweave.llm.encode import TOKENIZERS, token_ids
from inkweave.llm.queries import p6_ids

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE(f"{TOKENIZERS}/byte_bpe_50k.json", cached=500)


def test_odd_texts(bpe, reference):
    rng = random.Random(3)
    odd = ["", " ", "a" * 5000, " " * 3000 + "x", "ab" * 3000, "<|endoftext|> hi", "I'LL 'll it's", "½²Ⅷ①", "🙂‍🙂", "\x1c\x1d a\x85b", "क्षि ไทย", "don't  \n\n x"]
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), rng.randrange(0x1F300, 0x1F700), 9, 10, 32, 0x200B]))
    odd += ["".join(pick() for _ in range(60)) for _ in range(300)]
    for text in odd:
        assert list(bpe.encode(text)) == reference(text), ascii(text)


def scanned(bpe, data):
    """The ids by looking through all pairs for the lowest rank, again and again."""
    ids = [bpe.first[b] for b in data]
    while True:
        pairs = [(bpe.ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in bpe.ranks]
        if not pairs:
            return ids
        i = min(pairs)[1]
        ids[i : i + 2] = [bpe.ranks[ids[i], ids[i + 1]][1]]


def test_queue_and_scan_agree(bpe):
    rng = random.Random(4)
    for _ in range(500):
        data = bytes(rng.choice(b"thecaningo \xc3\xa9") for _ in range(rng.randrange(1, 80)))
        assert bpe.merge(data) == scanned(bpe, data)


def test_merges_out_of_order(bpe):
    other = ByteBPE(f"{TOKENIZERS}/byte_bpe_50k.json")
    rng = random.Random(6)
    few = rng.sample(list(other.ranks), 4000) + [(other.first[a], other.first[b]) for a in b"abc" for b in b"abc"]
    order = rng.sample(range(len(few)), len(few))
    other.ranks = {pair: (rank, bpe.ranks[pair][1]) for rank, pair in zip(order, few) if pair in bpe.ranks}
    for _ in range(300):
        data = bytes(rng.choice(b"abctheing ") for _ in range(rng.randrange(1, 60)))
        assert other.merge(data) == scanned(other, data)


def test_nulls_repeats_and_clashing_names(spark, reference):
    rows = [(1, "Hello there", "x"), (1, "Hello there", "x"), (2, None, "y"), (3, "", None), (None, "null key", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in token_ids(df).collect()), key=str)
    assert got == sorted([(1, reference("Hello there"))] * 2 + [(2, []), (3, []), (None, reference("null key"))], key=str)
    assert token_ids(df.limit(0)).count() == 0


def test_query(spark, data, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = p6_ids(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == (reference(texts[r.doc_id]) if texts[r.doc_id] else [])


def test_other_kinds_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        token_ids(df, name="word_bpe_49k")
