import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from riskfabric.llm import byte_bpe, token_binary, token_counts

from .conftest import make


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.bpe(byte_bpe.default_ranks())


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_recursive_query_equals_tiktoken_on_random_text(coder, reference):
    r = random.Random(1)
    odd = [0x1C, 0x1F, 0x85, 0xA0, 0x200B, 0x180E, 0x2028, 0x3000, 0x9, 0xA, 0x10EE7, 0x18E27, 0x323E7]
    for k in range(200):
        text = "".join(chr(r.choice([r.randrange(32, 127), r.choice(odd), r.randrange(0x80, 0x800), r.randrange(0x3000, 0xD000),
                                     ord("a"), ord("'"), 32])) for _ in range(r.choice([1, 3, 10, 80])))
        if k % 20 == 0:
            text += "ab" * r.randrange(600, 1500)
        ids = coder.encode([coder.cut(text).findall(text)])[0]
        assert ids.tolist() == reference.encode_ordinary(text)
        assert coder.decode([ids])[0] == text.encode()


def test_long_word_heap_equals_recursion(coder):
    r = random.Random(2)
    for n in (2, 30, 300):
        word = "".join(r.choice("abcthe ") for _ in range(n)).encode()
        assert coder.contract([word])[0].tolist() == coder.contract_long(word).tolist()


def test_round_trip_on_edges(edge_docs, edge_rows, reference):
    got = sorted(tuple(r) for r in byte_bpe.round_trip(edge_docs).fillna(-1, ["doc_id"]).collect())
    want = []
    for d, t in edge_rows:
        ids = reference.encode_ordinary(t or "")
        want.append((-1 if d is None else d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_encode_then_decode(edge_docs, edge_rows):
    back = byte_bpe.decode(byte_bpe.encode(edge_docs)).collect()
    assert sorted(bytes(r["bytes"]) for r in back) == sorted((t or "").encode() for _, t in edge_rows)


def test_a_text_in_several_rounds(shipped, reference, monkeypatch):
    text = "some words of a longer text, 123 and more. " * 3
    coder = byte_bpe.Bpe(byte_bpe.default_ranks())
    monkeypatch.setattr(byte_bpe, "SLICE_BYTES", 10)
    monkeypatch.setattr(byte_bpe, "ROUND_WORDS", 4)
    rounds = [x for _, ids in coder.rounds([text]) for x in ids]
    assert len(rounds) > 3 and np.concatenate(rounds).tolist() == reference.encode_ordinary(text)


def test_ascii_pattern_cuts_as_the_full_one(coder):
    r = random.Random(3)
    for _ in range(2000):
        text = "".join(chr(r.choice([r.randrange(128), *map(ord, " \n\t\x1c'")])) for _ in range(r.randrange(40)))
        assert coder.cut(text) is coder.plain
        assert coder.plain.findall(text) == coder.pattern.findall(text)


def test_queries_hold_a_bounded_number_of_tokens(shipped, reference, monkeypatch):
    r = random.Random(4)
    texts = ["".join(r.choice("abcdefgh  é,") for _ in range(r.randrange(60))) for _ in range(60)]
    coder = byte_bpe.Bpe(byte_bpe.default_ranks())
    sizes, own = [], coder.db

    class Recorded:
        def __getattr__(self, name):
            return getattr(own, name)

        def register(self, name, table):
            sizes.append(len(table.column("toks").combine_chunks().values) if name == "start" else table.num_rows)
            return own.register(name, table)
    coder.db = Recorded()
    monkeypatch.setattr(byte_bpe, "QUERY_POSITIONS", 100)
    ids = coder.encode([coder.cut(t).findall(t) for t in texts])
    assert [x.tolist() for x in ids] == [reference.encode_ordinary(t) for t in texts]
    assert coder.decode(ids) == [t.encode() for t in texts]
    assert len(sizes) > 6 and max(sizes) <= 300


def test_empty_tables(no_docs):
    assert byte_bpe.round_trip(no_docs).count() == 0
    assert token_counts.length_report(token_counts.length_histogram(token_counts.encoded_lengths(no_docs))).count() == 0
    assert token_binary.read_documents(token_binary.write_token_ids(no_docs)).count() == 0


def test_length_report_and_limits(edge_docs, edge_rows):
    enc = token_counts.rank_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    n = np.array([len(enc.encode_ordinary(t or "")) for _, t in edge_rows])
    hist = token_counts.length_histogram(token_counts.encoded_lengths(edge_docs))
    report = token_counts.length_report(hist, block=16)
    rows = report.collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(set(n.tolist()))
    for r in rows:
        k = r["n_tokens"]
        assert (r["n_docs"], r["docs_at_most"], r["docs_longer"]) == ((n == k).sum(), (n <= k).sum(), (n > k).sum())
        assert (r["tokens_at_most"], r["truncated_total"]) == (n[n <= k].sum(), np.minimum(n, k).sum())
        assert (r["total_tokens"], r["total_docs"]) == (n.sum(), len(n))
    limits = [0, 1, 7, 100, 10 ** 7]
    got = {r["context_limit"]: (r["truncated_total"], r["docs_longer"]) for r in token_counts.truncated_totals(hist, limits).collect()}
    assert got == {m: (np.minimum(n, m).sum(), (n > m).sum()) for m in limits}
    q = {r["share"]: r["n_tokens"] for r in token_counts.length_quantiles(report, [0.1, 0.5, 0.9, 1.0]).collect()}
    s = np.sort(n)
    assert q == {p: s[int(np.ceil(p * len(n))) - 1] for p in (0.1, 0.5, 0.9, 1.0)}


@pytest.mark.parametrize("bits", [1, 5, 11, 16, 17, 32])
def test_bit_packing_and_random_access(bits):
    r = np.random.default_rng(bits)
    docs = [r.integers(0, 2 ** bits, n).astype(np.uint32) for n in (0, 1, 9, 200, 3)]
    image = token_binary.Image(token_binary.write_image([5, None, 7, 8, 9], docs, bits, block_ids=64))
    flat = np.concatenate(docs)
    assert image.ids(0, image.n_ids).tolist() == flat.tolist() and image.known.tolist() == [1, 0, 1, 1, 1]
    for a, b in [(0, 0), (3, 4), (60, 70), (64, 128), (100, 213)]:
        assert image.ids(a, b).tolist() == flat[a:b].tolist()
    assert len(token_binary.pack(flat, bits)) == -(-len(flat) * bits // 8)


def test_word_encoder_equals_the_library():
    enc = token_binary.word_encoder(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(3)
    letters = "abcXYZàéñßÄÜÿþÐ.,!?;:|#$%&*'0123-_ÉŒıİΣς́<>中😀­"
    for _ in range(300):
        text = " ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 9))) for _ in range(5)) + r.choice(["", "\x1ca", "　b\xa0c", "<|endoftext|>"])
        assert enc.encode([text.encode()])[0].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_binary_round_trip(shipped, edge_rows):
    rows = [(d, t) for d, t in edge_rows if d is not None]
    got = [tuple(r) for r in token_binary.read_documents(token_binary.write_token_ids(make(shipped, rows).repartition(4))).orderBy("start").collect()]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for d, t in sorted(rows, key=lambda x: x[0]):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_token_binary_puts_rows_without_id_first(shipped):
    df = make(shipped, [(2, "b"), (None, "a b"), (1, "c")], extra=False)
    assert [r["doc_id"] for r in token_binary.read_documents(token_binary.write_token_ids(df)).orderBy("start").collect()] == [None, 1, 2]


def test_a_word_is_coded_once_while_it_stays_cached(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    enc = token_binary.WordEncoder(path)
    asked = []
    enc.words.make = lambda w, make=enc.words.make: asked.append(w) or make(w)
    texts = [b"Some words, some Words", "words été Ünder été! 12.5".encode(), b"", b"some words,"]
    plain = Tokenizer.from_file(path)
    want = [plain.encode(t.decode(), add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in enc.encode(texts)] == want
    assert sorted(asked) == sorted(set(b" ".join(texts).split()))  # one look-up a token makes each word once
    enc.words.limit = 1
    assert [x.tolist() for x in enc.encode(texts)] == want and len(asked) == len(set(asked))  # from the old generation
    assert [x.tolist() for x in enc.encode([b"other"])] == [plain.encode("other", add_special_tokens=False).ids]
    enc.words.begin()
    assert [x.tolist() for x in enc.encode(texts)] == want  # gone, and made again


def test_a_worker_keeps_a_bounded_number_of_words():
    coder = byte_bpe.Bpe(byte_bpe.default_ranks())
    for k in range(5):
        lot = [f"{i:06x}" for i in range(k * 60_000, (k + 1) * 60_000)]
        ids = coder.encode([lot])[0]
        assert coder.decode([ids])[0].decode() == "".join(lot)
        assert len(coder.words) + len(coder.words.old) <= 250_000  # two generations and what one slice adds
