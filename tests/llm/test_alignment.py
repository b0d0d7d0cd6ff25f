"""Cross-tokenizer alignment against a brute-force version that uses the tokenizers on whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import example, given, settings, strategies as st
from tokenizers import Tokenizer

from quarterlens.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), alignment.ByteLevel(A).token_bytes


def tokens(text, tokenizers):
    """Both id lists and their bytes, or nothing."""
    a, b, bytes_a = tokenizers
    if not text:
        return None
    full = " " + text
    ids_a, ids_b = a.encode(full, add_special_tokens=False).ids, b.encode(text)
    own_a = [bytes_a[i] for i in ids_a]
    own_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    return (ids_a, own_a, ids_b, own_b) if b"".join(own_a) == b"".join(own_b) == full.encode() else None


def brute(rows, tokenizers):
    found, held = [], Counter()
    for doc_id, text in rows:
        got = tokens(text, tokenizers)
        if not got:
            found.append((doc_id, [], [], "", []))
            continue
        ids_a, own_a, ids_b, own_b = got
        ends_a, ends_b = np.cumsum([len(x) for x in own_a]).tolist(), np.cumsum([len(x) for x in own_b]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        side = lambda ids, ends, lo, hi: ",".join(str(i) for i, e in zip(ids, ends) if lo < e <= hi)
        text_of = ";".join(f"{side(ids_a, ends_a, lo, hi)}|{side(ids_b, ends_b, lo, hi)}" for lo, hi in zip([0, *common], common))
        links = [(i, j) for i, e, x in zip(ids_a, ends_a, own_a) for j, f, y in zip(ids_b, ends_b, own_b)
                 if e - len(x) < f and f - len(y) < e]
        held.update(set(links))
        found.append((doc_id, ids_a, ids_b, text_of, links))
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    return sorted(((d, len(a), len(b), t.count("|"), len(links), sum(held[x] == top[x[0]] for x in links),
                    sum(held[x] for x in links), hashlib.sha256(t.encode()).hexdigest() if t else "")
                   for d, a, b, t, links in found), key=str)


TEXTS = st.one_of(st.none(), st.text("abcdeXYZ09.,'!?\"- \n\t\r\x0b\x1c\x85\xa0 　éß日😀\x00<>|▁", max_size=60),
                  st.lists(st.sampled_from(["<|endoftext|>", "<s>", "<0x0A>", " don't", "  ", "\n\n", "hello", " world", ");\r\n",
                                            "１２", "123456", "'ll"]), max_size=9).map("".join))


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=4), st.sampled_from([4, 40, 1 << 18]))
@example([" ", "\n", "a\r\nb", "x" * 300 + " y", " \r", "  "], 4)
def test_ids_and_links_equal_whole_texts(tokenizers, texts, step):
    block = alignment.Block(A, B)
    got = {k: ([], [], [], b"") for k in range(len(texts))}
    for owner, part in block.align(texts, step):
        bounds = [np.append(0, np.cumsum(c)) for c in part.counts]
        for k, doc in enumerate(owner.tolist()):
            a, b, links, written = got[doc]
            at = [len(a), len(b)]
            lows = [x[k] for x in bounds]
            mine = part.links[2] == k
            links += zip((part.links[0][mine] - lows[0] + at[0]).tolist(), (part.links[1][mine] - lows[1] + at[1]).tolist())
            a += part.ids[0][bounds[0][k]:bounds[0][k + 1]].tolist()
            b += part.ids[1][bounds[1][k]:bounds[1][k + 1]].tolist()
            got[doc] = a, b, links, written + part.written(block.digits)[k]
    for k, text in enumerate(texts):
        want = tokens(text, tokenizers)
        a, b, links, written = got[k]
        if not want:
            assert not a and not b and not written
            continue
        assert (a, b) == (want[0], want[2])
        ends_a, ends_b = (np.cumsum([len(x) for x in own]) for own in (want[1], want[3]))
        assert sorted(links) == [(i, j) for i, e in enumerate(ends_a) for j, f in enumerate(ends_b)
                                 if e - len(want[1][i]) < f and f - len(want[3][j]) < e]
        assert written.count(b"|") == len(set(ends_a) & set(ends_b))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1), st.lists(st.integers(0, 400)))
def test_gallop_is_a_lower_bound(hay, needles):
    hay, needles = np.unique(hay + [501]), np.unique(np.array(needles, np.int64))
    got = alignment.ranks(needles, hay, np.zeros(len(needles), np.int64))
    assert got.tolist() == np.searchsorted(hay, needles).tolist()


def test_align_equals_brute_force(spark, tokenizers, edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect() if len(r["text"] or "") < 5000]
    rows += [(90, "a ▁ b"), (91, "<|endoftext|> <s> x"), (92, "\r\n \t z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (300, alignment.BLOCK):
        out = alignment.align(docs, A, B, block=block)
        assert out.columns == NAMES
        assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows, tokenizers)
    assert alignment.align(no_docs, A, B).count() == 0
    assert alignment.align(edge_docs, A, B).count() == edge_docs.count()


def test_a_third_of_all_rows_is_one_text(spark, tokenizers):
    rows = [(i, f"number {i} of many words") for i in range(40)] + [(i % 3, "one and the same text") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = alignment.align(docs, A, B, block=200)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows, tokenizers)
    pairs = {(r["a"], r["b"]): r["docs"] for r in alignment.linked_pairs(docs, A, B).collect()}
    assert max(pairs.values()) == 40 and all(n >= 1 for n in pairs.values())


def test_groups_cover_the_text(spark, tokenizers):
    rows = [(1, "Grüße an die Welt\n\nzweite  Zeile"), (2, None), (3, "x" * 50 + " unbelievable")]
    out = {r["doc_id"]: r["groups"] for r in alignment.groups(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()}
    assert out[2] == []
    for doc, text in rows[0], rows[2]:
        ids_a, own_a, ids_b, _ = tokens(text, tokenizers)
        assert [i for g in out[doc] for i in g["a"]] == ids_a and [i for g in out[doc] for i in g["b"]] == ids_b
        assert [g["start"] for g in out[doc]] == [0, *[g["end"] for g in out[doc]][:-1]]
        assert out[doc][-1]["end"] == len((" " + text).encode())
        first = out[doc][0]
        assert sum(map(len, own_a[:len(first["a"])])) == first["end"]
