"""Cross-tokenizer alignment against a brute-force version over whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskfabric.llm import tokenizer_alignment as T

from .conftest import make


def brute(rows):
    """Each whole text by both libraries, every token pair compared."""
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in same]
    chars = {chr(x): x for x in same} | {chr(256 + k): x for k, x in enumerate(rest)}

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()
    per_doc = []
    for doc_id, text in rows:
        whole = f" {text or ''}".encode()
        ids_a, ids_b = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        by_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
        by_b = [bytes_b(i) for i in ids_b]
        if not text or b"".join(by_a) != whole or b"".join(by_b) != whole:
            per_doc.append((doc_id, [], [], [], []))
            continue
        spans = []
        for tokens in (by_a, by_b):
            at, out = 0, []
            for t in tokens:
                out.append((at, at + len(t)))
                at += len(t)
            spans.append(out)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        place = {e: k for k, e in enumerate(ends)}
        sides = [[[] for _ in ends] for _ in spans]
        for side, ids, sp in zip(sides, (ids_a, ids_b), spans):
            k = 0
            for i, (_, e) in zip(ids, sp):
                side[k].append(str(i))
                k = place[e] + 1 if e in place else k
        groups = ["|".join(",".join(x) for x in both) for both in zip(*sides)]
        links, k = [], 0
        for i, (s, e) in zip(ids_a, spans[0]):
            while k and spans[1][k - 1][1] > s:
                k -= 1
            for j in range(k, len(ids_b)):
                if spans[1][j][0] >= e:
                    break
                if spans[1][j][1] > s:
                    links.append((i, ids_b[j]))
                k = j
        per_doc.append((doc_id, ids_a, ids_b, groups, links))
    count = Counter(p for *_, links in per_doc for p in set(links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    return [(d, len(x), len(y), len(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for d, x, y, g, links in per_doc]


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
                   .collect()), key=repr)


@pytest.fixture(scope="module")
def odd_rows():
    r = random.Random(3)
    alphabet = list("ab ,.'\n\t0123é漢字🙂 ▁́ß") + ["  ", "   ", " the", "<s>", "<|endoftext|>", "<unk>", "\r\n", "\x00", "\x1c", "　", "<0x41>"]
    return [(k, "".join(r.choice(alphabet) for _ in range(r.randrange(1, 40)))) for k in range(300)]


def test_equals_brute_force_on_edge_rows(edge_docs, edge_rows):
    assert result(T.alignment(edge_docs)) == sorted(brute(edge_rows), key=repr)


def test_equals_brute_force_on_odd_texts(shipped, odd_rows):
    rows = odd_rows + odd_rows[:20] + [(None, "a row without any id")] * 2
    got = result(T.alignment(make(shipped, rows).repartition(3), slice_bytes=200))
    assert got == sorted(brute(rows), key=repr)


def test_slices_do_not_change_the_result(edge_docs):
    assert result(T.alignment(edge_docs, slice_bytes=1)) == result(T.alignment(edge_docs, slice_bytes=1 << 30))


def test_copies_weigh_in_the_counts(shipped):
    rows = [(k, "many copies of one text") for k in range(50)] + [(99, "of one")]
    got = result(T.alignment(make(shipped, rows).repartition(4)))
    assert got == sorted(brute(rows), key=repr)
    assert {r[6] for r in got if r[0] < 50} == {sum([50, 50, 51, 51, 50])}


def test_without_rows(no_docs):
    assert T.alignment(no_docs).collect() == []


def test_a_differing_text_has_no_tokens(shipped):
    rows = [(1, "plain words"), (2, "with ▁ inside"), (3, None)]
    got = {r[0]: r[1:] for r in result(T.alignment(make(shipped, rows)))}
    assert got[2] == got[3] == (0, 0, 0, 0, 0, 0, "")
    assert got[1][0] > 0
