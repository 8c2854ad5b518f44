import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from numera.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "é", "é", "́", "'s", "'re", "1", "2", "  ", "\n", " ", "\t", "\x1c", "\xa0", " ", "<|endoftext|>", "<|endof", "text|>", "!!", "###", "ß", "İ", "你好", "The", "ing", "😀", "👩‍👧", "Übermut,", "don't"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("piece,window", [(16, 2), (40, 4), (300, 8)])
def test_tree_equals_the_unsplit_encoding(library, piece, window):
    rnd, own = random.Random(piece), bpe.TreeEncoder(PATH, piece=piece, window=window, remembered=500)
    for k in range(400):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.choice([0, 1, 30, 200, 800])))
        if k % 3 == 0:
            text = "".join(text.split())
        ids = own.encode([text])[0]
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("piece,window", [(16, 1), (64, 4), (4096, 64)])
def test_unsplit_texts_join_token_by_token(library, piece, window):
    rnd = random.Random(window)
    letters = ["a", "b", "the", "ing", "é", "ß", "х", "o", "ou", "abab"]
    for _ in range(12):
        text = "".join(rnd.choice(letters[: rnd.randrange(1, 11)]) for _ in range(rnd.choice([200, 3000, 8000])))
        own = bpe.TreeEncoder(PATH, piece=piece, window=window)
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
        mixed = text + "'s" + text[::-1] + "!!" * 40 + "İ" + text.upper()
        assert own.encode([mixed])[0].tolist() == library.encode(mixed, add_special_tokens=False).ids


def test_little_of_a_long_unsplit_text_is_encoded_again(library):
    rnd = random.Random(5)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20))
    own = bpe.TreeEncoder(PATH)
    own.encode(["warm up"])
    began = time.perf_counter()
    ids = own.encode([text])[0]
    mine = time.perf_counter() - began
    began = time.perf_counter()
    want = library.encode(text, add_special_tokens=False).ids
    theirs = time.perf_counter() - began
    assert ids.tolist() == want and own.encoded_again < 0.1 * len(text) and mine < 2 * theirs + 1


def test_encode(library, docs_of):
    texts = {1: None, 2: "", 3: "Hello, World! don't", 4: "wörd " * 9000, 5: "x" * 30_000, 6: " \n", 7: "<|endoftext|> end"}
    rows = bpe.encode(docs_of([*texts.items(), (3, texts[3]), (None, "null id")])).collect()
    assert len(rows) == 9
    for r in rows:
        text = "null id" if r.doc_id is None else texts[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids == ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty(docs_of):
    assert bpe.encode(docs_of([])).count() == 0


def test_other_steps_turn_the_plain_path_off():
    assert bpe.TreeEncoder(PATH).plain
    assert not bpe.TreeEncoder(public_tokenizers.path("byte_bpe_50k.json")).plain


@pytest.mark.parametrize("long,window", [(4, 1), (40, 2), (300, 8)])
def test_long_texts_join_at_any_code_point(library, long, window):
    rnd = random.Random(long)
    own = bpe.TreeEncoder(PATH, window=window, long=long)
    for k in range(250):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.choice([0, 1, 5, 60, 400])))
        if k % 4 == 0:
            text = "   ".join([" " * rnd.randrange(100), text, "\n" * rnd.randrange(100)])
        assert own.encode([text, "short one", text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.joins > 100


def test_joins_of_the_tables_texts(spark, library):
    """Long documents are halved and joined, and little of them is encoded again."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(f"octet_length(text) > {bpe.LONG}").select("text").collect()
    own = bpe.TreeEncoder(PATH)
    texts = [r["text"] for r in rows]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    # leaves are powers of two
    assert own.joins == sum((1 << (-(-len(t.encode()) // bpe.LONG) - 1).bit_length()) - 1 for t in texts) > 0
    assert own.encoded_again < 0.02 * sum(len(t) for t in texts)
