"""Texts that a linear hash confuses, pre-tokens of a megabyte and texts of 50 MB, against the library."""

import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from passagemill.llm.arrowtext import span_hashes
from passagemill.llm.byte_bpe import round_trip
from passagemill.llm.queries import tokenizer_path
from passagemill.llm.token_counts import count_tokens

OTHER = str.maketrans("ab", "ba")


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(OTHER)
    return word


def wanted(text):
    t = Tokenizer.from_file(tokenizer_path())
    ids = t.encode(text, add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    want = {i: wanted(x) for i, x in enumerate(texts)}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip(d, tokenizer_path()).collect()} == want
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(d, tokenizer_path()).collect()} == {i: (len(x.encode()), want[i][0]) for i, x in enumerate(texts)}


def test_patterned_words(spark):
    words = [thue_morse(n) for n in (16, 32, 64, 1024, 4096)]
    check(spark, [w + "\n" + w.translate(OTHER) for w in words] + [w.translate(OTHER) + " " + w for w in words])


def test_hashes_tell_patterned_spans_apart():
    word = thue_morse(4096)
    data = np.frombuffer((word + word.translate(OTHER)).encode(), np.uint8)
    for n in (8, 64, 65, 512, 4096):
        start = np.arange(0, len(data) - n + 1, max(1, n // 8))
        h = span_hashes(data, start, start + n)
        assert len(np.unique(h)) == len({data[a : a + n].tobytes() for a in start})


def test_a_pretoken_of_a_megabyte(spark):
    check(spark, ["ab" * (1 << 19), "x"])


@pytest.mark.parametrize("text", ["漢字かな交じり文、" * 1_900_000, "слово и дело " * 2_200_000])
def test_a_text_of_50_megabytes(spark, text):
    assert len(text.encode()) > 50_000_000
    t = Tokenizer.from_file(tokenizer_path())
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    # the library takes minutes over such a text at once; both parts begin a pre-token, so lengths add up
    cut = text[: len(text) // 100]
    one, both = (len(t.encode(x, add_special_tokens=False).ids) for x in (cut, cut * 2))
    row = count_tokens(d, tokenizer_path()).first()
    assert row.n_bytes == len(text.encode()) and row.n_tokens == one + 99 * (both - one)
    back = round_trip(d, tokenizer_path()).first()
    assert back.n_tokens == row.n_tokens and back.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
