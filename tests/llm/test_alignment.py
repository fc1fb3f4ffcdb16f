"""Alignment of two vocabularies against comparing every token with every other."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from texts import words

from muralog.llm import alignment
from muralog.llm.alignment import Closed, Tokens, compose, fragment
from muralog.llm.queries import op13_token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens_of(text, _known={}):
    """`[(id, begin, end)]` of both vocabularies over the whole text; none if they don't spell it."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    if not _known:
        _known["a"], _known["b"], _known["bytes"] = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), {}
        _known["a"].encode_special_tokens = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        _known["alphabet"] = dict(zip(map(chr, printable), printable)) | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    if not text:
        return [], []
    first = _known["a"].encode(f" {text}", add_special_tokens=False)
    spelled_a = [(i, bytes(_known["alphabet"][c] for c in t)) for i, t in zip(first.ids, first.tokens)]
    spelled_b = []
    for i in _known["b"].encode(text):
        piece = _known["b"].id_to_piece(i)
        spelled_b.append((i, bytes([int(piece[3:5], 16)]) if _known["b"].is_byte(i) else piece.replace("▁", " ").encode()))
    if any(b"".join(x for _, x in s) != f" {text}".encode() for s in (spelled_a, spelled_b)):
        return [], []
    placed = []
    for spelled in (spelled_a, spelled_b):
        at, out = 0, []
        for i, x in spelled:
            out.append((i, at, at + len(x)))
            at += len(x)
        placed.append(out)
    return placed


def plain_links(a, b):
    out, j = [], 0
    for i, begin, end in a:
        while j < len(b) and b[j][2] <= begin:
            j += 1
        k = j
        while k < len(b) and b[k][1] < end:
            out.append((i, b[k][0]))
            k += 1
    return out


def plain_groups(a, b):
    common = sorted({e for _, _, e in a} & {e for _, _, e in b})
    out, i, j = [], 0, 0
    for c in common:
        first, second = [], []
        while i < len(a) and a[i][2] <= c:
            first.append(str(a[i][0]))
            i += 1
        while j < len(b) and b[j][2] <= c:
            second.append(str(b[j][0]))
            j += 1
        out.append(f"{','.join(first)}|{','.join(second)}")
    return out


def plain_alignment(rows):
    found = [(doc, *tokens_of(text)) for doc, text in rows]
    links = [plain_links(a, b) for _, a, b in found]
    counts = Counter(x for of in links for x in of)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (doc, a, b), of in zip(found, links):
        groups = plain_groups(a, b)
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((doc, len(a), len(b), len(groups), len(of), sum(counts[x] == most[x[1]] for x in of), sum(counts[x] for x in of), sha))
    return sorted(out, key=repr)


def rows_of(df):
    assert df.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r)[:8] for r in df.collect()), key=repr)


NASTY = ["<|endoftext|> </s> <unk> <0x41>", "a ▁ b▁c", "double  blank", " begins", "ends ", "tab\tand\r\nline\n\nend", "no break   x", "日本語 テキスト 漢字", "👩‍👩‍👧 é é ﬁ ＡＢ",
         "x" * 300, "\x00\x01 \x1c y", "it's they'll we've 'S", "1234567 89 000", "der　 ​ein", "▁", " ", "\n", "\nfirst line, and. more\nof it\n", "a\nb\nc, d. e,f.g\nÉté, ×, ÷. über.", "\ue000, \ue001"]


@pytest.mark.parametrize("chunk, piece, head", [(1 << 14, 1 << 18, 2_000_000), (16, 1 << 18, 2_000_000), (5, 40, 50), (1, 10, 0)])
def test_matches_plain(docs_of, chunk, piece, head):
    """Also in byte ranges as small as a byte, texts in pieces, and few pair counts sent to every task."""
    rng = random.Random(chunk)
    rows = [(i, t) for i, t in enumerate(NASTY)] + [(100 + i, " ".join(rng.choice(NASTY) for _ in range(4))) for i in range(30)]
    rows += [(200 + i, words(i, 60)) for i in range(20)] + [(300, "the cat, " * 40), (300, "the cat, " * 40), (None, "no id at all"), (5, None), (6, "")]
    assert rows_of(alignment.align(docs_of(rows), A, B, chunk, piece, head)) == plain_alignment(rows)


def test_odd_rows(docs_of, odd_rows, no_docs):
    rows = [(r[0], r[1]) for r in odd_rows]
    assert rows_of(alignment.align(docs_of(odd_rows), A, B, piece_bytes=50_000)) == plain_alignment(rows)
    assert alignment.align(no_docs, A, B).collect() == []
    assert rows_of(alignment.align(docs_of([(1, None), (2, "")]), A, B)) == plain_alignment([(1, None), (2, "")])


def test_composition_is_associative():
    """However neighbours are put together, the same groups close."""
    rng = random.Random(4)

    def together(parts, choose):
        parts, closed = list(parts), []
        while len(parts) > 1:
            i = choose(len(parts) - 1)
            merged, more = compose(parts[i], parts[i + 1])
            closed += more
            parts[i:i + 2] = [merged]
        return parts[0], closed

    def plainly(f, closed):
        groups = sorted((c.at, c.a.ids.tolist(), c.b.ids.tolist(), c.a.ends.tolist(), c.b.ends.tolist()) for c in closed)
        return f.closes, *(x.tolist() for t in (f.prefix_a, f.prefix_b, f.suffix_a, f.suffix_b) for x in (t.ids, t.ends)), f.suffix_from, groups

    for _ in range(300):
        n = rng.randrange(1, 60)
        a, b = (Tokens(np.arange(len(e)), np.array(e, np.int64)) for e in (sorted({*rng.sample(range(1, n + 1), rng.randrange(0, n)), n}) for _ in range(2)))
        cuts = sorted({0, n, *rng.sample(range(n + 1), rng.randrange(0, min(n, 8) + 1))})
        made = [fragment(a.cut(i, j), b.cut(i, j)) for i, j in zip(cuts, cuts[1:])]
        inner = [c for _, closed in made for c in closed]
        left = together([f for f, _ in made], lambda k: 0)
        other = together([f for f, _ in made], lambda k: rng.randrange(k))
        assert plainly(left[0], inner + left[1]) == plainly(other[0], inner + other[1])
        whole, closed = left
        total = sorted([*inner, *closed, Closed(0, whole.prefix_a, whole.prefix_b)], key=lambda c: c.at)
        assert [x for c in total for x in c.a.ids.tolist()] == a.ids.tolist() and [x for c in total for x in c.b.ids.tolist()] == b.ids.tolist()
        assert sum(len(np.intersect1d(c.a.ends, c.b.ends)) for c in total) == len(np.intersect1d(a.ends, b.ends))


def test_query(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.01", "sf0.001")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(op13_token_alignment(spark, sf_dir)) == plain_alignment(rows)
