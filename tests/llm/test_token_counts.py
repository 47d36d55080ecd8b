from itertools import pairwise

import pytest
from graphloom.llm import token_counts as T
from hypothesis import given, settings, strategies as st
from tables import LONG, docs

ENC = T.encoding()
ALPHABET = st.sampled_from([*"aAbB '’.,!?\n\t\r  0129", "é", "漢", "\x1c", "\x85", " ", "　", "\U0001f600", "'s", "'ll", "   ", "\n\n", "<|endoftext|>", "ﬁ", "²", "̈"])


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=300).map("".join), st.integers(8, 40), st.integers(2, 16))
def test_spliced_counts_are_those_of_the_whole(text, chunk, overlap):
    parts = T.chunks(text, chunk, overlap)
    assert parts[0][2] == 0 and parts[-1][3] == len(text)
    assert all(x[3] == y[2] and y[0] <= x[3] <= x[1] for x, y in pairwise(parts))
    assert T.encode(text, ENC, chunk, overlap) == ENC.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 50_000 + "x", "\n" * 5000 + " " * 5000 + "end", "ab " * 40_000, "x" * 33_000 + " y " * 20_000, "1" * 40_000 + "." * 40_000, LONG])
def test_huge_documents(text):
    assert T.count(text, ENC) == len(ENC.encode_ordinary(text))
    assert T.count(text, ENC, 1000, 16) == len(ENC.encode_ordinary(text))


def test_a_long_run_widens_the_overlap():
    text = "word " * 100 + "x" * 5000 + " word" * 100
    assert max(end - begin for begin, end, _, _ in T.chunks(text, 200, 20)) > 5000


def test_awkward_rows(spark):
    table = docs(spark)
    got = sorted(((r.doc_id or 0), -1 if r.n_tokens is None else r.n_tokens) for r in T.token_counts(table).collect())
    assert got == sorted((r.doc_id or 0, -1 if r.text is None else len(ENC.encode_ordinary(r.text))) for r in table.collect())
    assert T.token_counts(table.limit(0)).count() == 0


def test_all_given_documents(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: len(ENC.encode_ordinary(r.text)) for r in d.collect() if r.text is not None}
    assert {r.doc_id: r.n_tokens for r in T.token_counts(d, chunk=300, overlap=32).collect() if r.n_tokens is not None} == want
