import random

import pytest

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from flowguard.llm import bpe  # noqa: E402

PATH = public.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  b \n c", "x<|endoftext|>y <|endoftext|>", "a b  c", "it's we'll I'M",
       "\n\n", "a \n", "😀 a😀b", "aaaaaaaaaa aaaaaaa", "\x1c a \x85b", "１２３ ⅷ", "don't 'sfoo",
       "<|endoftext|>", "the " * 30_000]


@pytest.fixture(scope="module")
def theirs():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges.load(PATH)


def ids_of(encoder, values):
    flat, counts = encoder.encode(values)
    out, at = [], 0
    for n in counts.tolist():
        out.append(flat[at:at + n].tolist())
        at += n
    return out


def test_equals_the_library(theirs, merges):
    g = random.Random(2)
    values = ODD + ["".join(g.choice(" \n\taeiou'st😀é1２.<|>") for _ in range(g.randint(0, 40)))
                    for _ in range(500)]
    want = [e.ids for e in theirs.encode_batch(values, add_special_tokens=False)]
    encoder = bpe.PartitionEncoder(merges, remember=50)
    assert ids_of(encoder, values) == want
    assert ids_of(encoder, values[::-1]) == want[::-1]
    for ids in want:
        assert bpe.decode_ids(merges, ids) == theirs.decode(ids, skip_special_tokens=False)


def test_broken_bytes_become_replacements(theirs, merges):
    ids = theirs.encode("😀é", add_special_tokens=False).ids[:1]
    assert bpe.decode_ids(merges, ids) == theirs.decode(ids, skip_special_tokens=False)


def test_round_trip_of_tables(spark, make_docs):
    docs = make_docs([(1, "a b"), (1, "a b"), (2, None), (None, "x"), (3, "")], clash=True)
    encoded = bpe.encode_documents(docs, PATH)
    back = {(r.doc_id, r.text) for r in bpe.decode_documents(encoded, PATH).collect()}
    assert back == {(1, "a b"), (2, ""), (None, "x"), (3, "")}
    rows = bpe.round_trip_digests(docs, PATH).collect()
    assert len(rows) == 5 and {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0}
    assert bpe.round_trip_digests(docs.limit(0), PATH).collect() == []
