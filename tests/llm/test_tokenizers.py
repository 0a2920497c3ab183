"""Token counts and BPE against brute force and the public library."""
import hashlib
import random

import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from replenish.llm import bpe as B
from replenish.llm import token_counts as T

WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = ["", None, " \n\t ", "Hello, WORLD's don't I'LL 42", "<|endoftext|>a<|startoftext|><|ENDOFTEXT|>", "ΑΣ Σ. İstanbul", "e\u0301 é É ﬁ ẛ", "x" * 3000, "ab" * 400 + " c",
         "한국어 テスト 😀😀 \u1c89\ua7cb \u00a0\u2003z", "a" * 70, "word " * 5000, "\x00\x01 \x7f", "½ ² Ⅷ ١٢", "don't don't"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORD_BPE)
    t.no_truncation()
    t.no_padding()
    return t


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("lexicon", [50_000, 100])
def test_bpe_table_equals_library(spark, small, make_docs, library, lexicon):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").union(
        make_docs([(10_000 + i, t) for i, t in enumerate(TEXTS)] + [(None, "null id")]).select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.encode_digests(docs.withColumn("n_tokens", F.lit("x")), WORD_BPE, lexicon).collect()}
    assert got == {i: want(library, t) for i, t in texts.items()}


def test_bpe_ids(make_docs, library):
    got = {r.doc_id: r.ids for r in B.encode_ids(make_docs(TEXTS), WORD_BPE).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}


def test_lexicon_is_exact_and_minimal():
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))).encode(): [rng.randrange(50_000) for _ in range(rng.randrange(1, 4))] for _ in range(400)}
    compiled = B.compile_lexicon(words)
    lexicon = B.Lexicon(compiled)
    for n in range(1, 7):
        for _ in range(600):
            w = "".join(rng.choice("abcd") for _ in range(n)).encode()
            assert lexicon.find(w) == words.get(w)
    assert lexicon.find(b"") is None and all(lexicon.find(w) == ids for w, ids in words.items())

    def language(w):  # right language of a prefix
        return frozenset(x[len(w):] for x in words if x.startswith(w))

    states = {language(x[:i]) for x in words for i in range(len(x) + 1)}
    assert len(lexicon.finals) == len(states)
    assert B.Lexicon(B.compile_lexicon({})).find(b"a") is None


def test_long_words_merge_alike():
    s = B.Scheme.read(WORD_BPE)
    rng = random.Random(1)
    for _ in range(20):
        w = "".join(rng.choice("thean") for _ in range(rng.randrange(100, 256)))
        parts = [s.characters[b] for b in w.encode()]
        parts[-1] += s.end
        assert [s.vocabulary[p] for p in B._merge_long(parts, s.ranks)] == s.merge(w)


def brute(cost, t):
    best = [(0, 0)]
    for d in range(1, len(t) + 1):
        best.append(min((best[j][0] + cost[t[j:d]], best[j][1] + 1) for j in range(d) if t[j:d] in cost))
    return best[-1]


@pytest.mark.parametrize("nodes", [T.NODES_MOST, 50])
def test_token_counts_against_brute_force(spark, small, make_docs, monkeypatch, nodes):
    ranks = T.read_ranks(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    cost, cut = T.costs(ranks), regex.compile(public_tokenizers.PATTERN)
    docs = spark.read.parquet(f"{small}/documents.parquet").where("n_chars < 2500").select("doc_id", "text").union(
        make_docs([(10_000 + i, t) for i, t in enumerate(TEXTS)] + [(None, "null id")]).select("doc_id", "text"))
    monkeypatch.setattr(T.PrefixTrie.__init__, "__defaults__", (nodes,))
    got = {r.doc_id: tuple(r)[1:] for r in T.token_counts(docs, ranks, public_tokenizers.PATTERN).collect()}
    memo = {}
    for r in docs.collect():
        tokens = cut.findall(r.text or "")
        found = [memo.setdefault(t, None) or memo.__setitem__(t, brute(cost, t.encode())) or memo[t] for t in tokens]
        assert got[r.doc_id] == (len(tokens), sum(n for _, n in found), sum(c for c, _ in found))


def test_trie_shares_prefixes():
    ranks = T.read_ranks(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    trie = T.PrefixTrie(T.costs(ranks))
    trie.count(" prefix")
    n = len(trie.best)
    trie.count(" prefixes")
    assert len(trie.best) == n + 2 and trie.count(" prefix") == brute(trie.cost, b" prefix")
    assert trie.insert(b"y" * 100) == brute(trie.cost, b"y" * 100)


def test_empty_tables(make_docs):
    assert B.encode_digests(make_docs([]), WORD_BPE).collect() == []
    assert T.token_counts(make_docs([]), {bytes([b]): b for b in range(256)}, public_tokenizers.PATTERN).collect() == []
