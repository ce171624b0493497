import base64
import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from factloom.llm import bpe
from hypothesis import given, settings
from hypothesis import strategies as st

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="session")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="session")
def encoder():
    return bpe.Encoder(open(RANKS, "rb").read(), public_tokenizers.PATTERN)


def sha(x):
    return hashlib.sha256(x).hexdigest()


def same(docs, reference):
    got = bpe.tokenise(docs, RANKS, public_tokenizers.PATTERN).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = reference.encode_ordinary(r["text"] or "")
        want[(r["doc_id"], len(ids), sha(",".join(map(str, ids)).encode()), sha((r["text"] or "").encode()))] += 1
    assert Counter(map(tuple, got)) == want


def test_documents(documents, odd_documents, no_documents, reference):
    same(documents, reference)
    same(odd_documents, reference)
    same(no_documents, reference)


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab é ü漢字 the'll\n\t  123"), st.characters(exclude_categories=["Cs"])), max_size=400))
def test_any_text(reference, encoder, text):
    (ids,) = encoder.encode([text])
    assert ids.tolist() == reference.encode_ordinary(text)
    assert encoder.decode(ids.tolist()) == text.encode()


def test_the_two_trees_agree(encoder):
    for piece in (b"ab" * 400, bytes(range(256)), "überraschung".encode() * 9, b"\xff" * 1000, b"aa"):
        assert bpe.encode_long(piece, encoder.vocabulary) == bpe._encode_width([piece, b"x"], 1 << (len(piece) - 1).bit_length(), encoder.vocabulary)[0]
