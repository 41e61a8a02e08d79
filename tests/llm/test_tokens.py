import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import bpe, token_count
from sparkloom.llm.word_table import WordTokenizer, distinct_words, frequent

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", None, " \n\t ", "Hello, WORLD's 12 tests!!", "É̂é ﬁ Σας ΣΑΣ İstanbul ẞ", "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>", "漢字 と かな 🙂🙂 ‍﻿\x1c\x85\xa0 ½²٣",
    "the same word " * 4000, "x" * 20_000, "don't I'LL we've 's", "a\x00b", "tail of quiteunlikelyword",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_a_file_of_another_kind_is_refused(tmp_path):
    with pytest.raises(ValueError, match="word by itself"):
        WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    kind = json.load(open(PATH))
    for change in ({"normalizer": None}, {"added_tokens": [kind["added_tokens"][0] | {"lstrip": True}]}):
        (tmp_path / "t.json").write_text(json.dumps(kind | change))
        with pytest.raises(ValueError, match="word by itself"):
            WordTokenizer(str(tmp_path / "t.json"))
    renamed = [kind["added_tokens"][0] | {"content": "[A]"}, kind["added_tokens"][1] | {"content": "##"}]
    (tmp_path / "t.json").write_text(json.dumps(kind | {"added_tokens": renamed}))
    words, own = WordTokenizer(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    for text in ("a [A]b ## c", "no special <|endoftext|>", "[a]#"):
        found = [i for w in words.words(text) for i in ([words.special[w]] if w in words.special else words.encode_word(w))]
        assert found == own.encode(text, add_special_tokens=False).ids


def test_words_give_the_librarys_ids(library):
    words, rng = WordTokenizer(PATH), random.Random(4)
    pool = [chr(c) for c in range(0x250)] + list("abcdeABCDE '.!09 \n") * 12 + ["<|endoftext|>", "Σ", "ΑΣ ", "漢", "🙂", "ſ", "K", "é", "　", "'LL"]
    for _ in range(3000):
        text = "".join(rng.choices(pool, k=rng.randint(1, 25)))
        found = [i for w in words.words(text) for i in ([words.special[w]] if w in words.special else words.encode_word(w))]
        assert found == ids(library, text), text


def test_encode_decode_and_digests(spark, documents, library, clashing):
    docs = documents([*enumerate(TEXTS), (3, TEXTS[3]), (None, "null id")], clashing)
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "null id")]
    want = sorted(repr((d, ids(library, t))) for d, t in rows)
    encoded = bpe.encode(docs, PATH)
    assert sorted(repr((r["doc_id"], r["ids"])) for r in encoded.collect()) == want
    assert encoded.columns == [*(c for c in docs.columns if c != "ids"), "ids"]
    texts = {repr(r["doc_id"]): r["decoded"] for r in bpe.decode(encoded.select("doc_id", "ids"), PATH).collect()}
    assert texts == {repr(d): library.decode(ids(library, t), skip_special_tokens=False) for d, t in rows}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    found = sorted(repr(tuple(r)) for r in bpe.digests(docs, PATH).collect())
    assert found == sorted(repr((d, len(i := ids(library, t)), sha(np.array(i, dtype="<u4").tobytes()), sha(library.decode(i, skip_special_tokens=False).encode()))) for d, t in rows)


@pytest.mark.parametrize("frequent_words", [0, 5, 1000])
def test_counts_with_many_or_few_frequent_words(documents, library, frequent_words):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, None)]
    found = token_count.token_counts(documents(rows), PATH, limit=10, frequent_words=frequent_words).collect()
    want = [(d, len((t or "").encode()), n := len(ids(library, t)), n > 10) for d, t in rows]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_bound_of_the_frequent_words(documents):
    words = distinct_words(documents([(1, "a a a a b b c d e"), (2, "a b c")]), PATH)
    assert {r["word"]: r["n"] for r in words.collect()} == {"a": 5, "b": 3, "c": 2, "d": 1, "e": 1}
    for size, want in ((0, ""), (1, "a"), (3, "abc"), (4, "abc"), (9, "abcde")):
        top, least = frequent(words, size)
        assert sorted(r["word"] for r in top.collect()) == list(want) and words.where(words.n < least).count() == 5 - len(want)


def test_rare_words_beyond_the_room_are_encoded_again(library, monkeypatch):
    monkeypatch.setattr(bpe._Ids, "ROOM", 2)
    table, split = bpe._Ids(PATH, {}), WordTokenizer(PATH).words
    for text in ("one two three four", "five six", "one seven"):
        assert np.frombuffer(table.of([split(text)])[0], "<u4").tolist() == ids(library, text)


def test_empty_table(documents):
    docs = documents([])
    assert bpe.digests(docs, PATH).collect() == [] and token_count.token_counts(docs, PATH).collect() == [] and bpe.encode(docs, PATH).collect() == []
