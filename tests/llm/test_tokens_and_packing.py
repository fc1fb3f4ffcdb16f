"""Token files and packing against the tokenizer applied to whole texts."""

from __future__ import annotations

import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from muralog.llm import packing, token_output, words
from muralog.llm.queries import END_ID, TOKENIZER


def whole_text_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, END_ID], "<u4") for t in texts]


TRICKY = st.lists(st.sampled_from(list("aBéÉß.,'½%<|> \n\t\x1c\x85  ſΣςİ漢😀9") + ["é", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "\r\n"]), max_size=40).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(TRICKY, min_size=1, max_size=5))
def test_memoised_words_give_the_ids_of_the_whole_text(texts):
    ids, ends = words.Encoder.of(TOKENIZER, END_ID).encode(pa.array(texts, pa.large_string()))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [x.tolist() for x in whole_text_ids(texts)]


def test_a_vocabulary_that_merges_over_blanks_gets_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, ends = words.Encoder(path, 50256).encode(pa.array([" hello  world\n", ""], pa.large_string()))
    assert ids.tolist() == [*Tokenizer.from_file(path).encode(" hello  world\n").ids, 50256, 50256] and ends.tolist()[-1] == len(ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=30), max_size=6))
def test_codes_round_trip(runs):
    n = np.array([len(r) for r in runs], np.int64)
    ranks = [x for r in runs for x in r]
    control, data = token_output.encode_ranks(np.array(ranks, np.uint32), np.cumsum(n))
    assert [len(c.as_py()) for c in control] == [-(-k // 4) for k in n]
    assert [len(d.as_py()) for d in data] == [sum(max(1, -(-x.bit_length() // 8)) for x in r) for r in runs]
    assert token_output.decode_ranks(control, data, n).tolist() == ranks
    assert token_output.decode_ranks(control[1:], data[1:], n[1:]).tolist() == [x for r in runs[1:] for x in r]


def test_memo_keeps_what_comes_again(monkeypatch):
    """Words in use are computed once, however many others pass by; what is held is bounded."""
    monkeypatch.setattr(words, "MEMO_WORDS", 60)
    computed = []
    memo = words.Memo(lambda ws: computed.extend(ws) or words.joined([[len(w), *w.encode()] for w in ws], np.uint32), np.uint32)
    for i in range(40):
        batch = ["always", f"word{i}", f"other{i}", "always", f"word{i - 1}"]
        starts, lengths, flat = memo.lookup(pa.array(batch, pa.large_string()))
        assert words.expand(starts, lengths, flat).tolist() == [x for w in batch for x in (len(w), *w.encode())]
        assert len(memo._new.slot) <= 30 and len(memo._old.slot) <= 30
    assert computed.count("always") == 1 and len(computed) < 90


def test_memo_takes_little_memory_and_holds_many_words():
    """A word takes its bytes and a few numbers; words among some hundred thousand others are not computed again."""
    computed = []

    def values(ws):
        computed.append(len(ws))
        return np.ones(len(ws), np.int64), np.full(len(ws), 7, np.uint32)

    tracemalloc.start()
    memo, held = words.Memo(values, np.uint32), pa.total_allocated_bytes()
    for begin in (0, 150_000, 300_000, 0):
        memo.lookup(pa.array([f"word{i}" for i in range(begin, begin + 150_000)], pa.large_string()))
    taken = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - held
    tracemalloc.stop()
    assert sum(computed) == 450_000
    assert taken < 90 * (len(memo._new.slot) + len(memo._old.slot))


def test_files_hold_every_text_in_order(spark, docs_of, odd_rows):
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0]))
    got = token_output.token_digests(docs_of(odd_rows), TOKENIZER, END_ID).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    start = 0
    for r, ids in zip(got, whole_text_ids([r[1] for r in rows])):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_several_files_are_in_order(spark, docs_of, monkeypatch, tmp_path):
    monkeypatch.setattr(token_output, "TOKENS_PER_FILE", 50)
    rows = [(i * 7 % 101, f"text number {i} of many") for i in range(101)]
    token_output.write_tokens(docs_of(rows).repartition(5), str(tmp_path), TOKENIZER, END_ID)
    got = token_output.read_tokens(spark, str(tmp_path)).orderBy("start").collect()
    assert [r.doc_id for r in got] == list(range(101)) and len(list((tmp_path / "tokens").glob("part-*"))) > 3
    ids = dict(zip([r[0] for r in rows], whole_text_ids([r[1] for r in rows])))
    assert all(r.ids == ids[r.doc_id].tobytes() for r in got)
    assert [r.start for r in got] == np.cumsum([0, *[len(ids[i]) for i in range(100)]]).tolist()


def test_a_hot_id_fills_several_files(spark, docs_of, monkeypatch, tmp_path):
    """One id holds a third of the rows, a sixth have none, and a text repeats: no file is much longer than others."""
    monkeypatch.setattr(token_output, "TOKENS_PER_FILE", 400)
    rows = [(50 if i % 3 == 0 else None if i % 6 == 1 else i, "one text for all" if i % 2 else f"text number {i} of many") for i in range(600)]
    token_output.write_tokens(docs_of(rows).repartition(4), str(tmp_path), TOKENIZER, END_ID)
    got = token_output.read_tokens(spark, str(tmp_path)).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    want = sorted(x.tobytes() for x in whole_text_ids([r[1] for r in rows]))
    assert sorted(r.ids for r in got) == want
    sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/tokens").groupBy("file").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 150


def test_no_documents(no_docs):
    assert token_output.token_digests(no_docs, TOKENIZER, END_ID).count() == 0
    assert packing.pack(no_docs, TOKENIZER, END_ID).count() == 0


def check_pieces(rows, pieces, window):
    """Each id in exactly one piece; sequences without gaps, all but the last full."""
    by_ids = defaultdict(int)
    for r, ids in zip(rows, whole_text_ids([r[1] for r in rows])):
        by_ids[r[0], ids.tobytes()] += 1
    taken = defaultdict(list)
    for p in pieces:
        assert p.length > 0 and p.ids and len(p.ids) == 4 * p.length
        taken[p.doc_id, p.start].append(p)
    for (doc_id, whole), times in by_ids.items():
        for _ in range(times):
            at, found = 0, b""
            while at < len(whole) // 4:
                fits = [p for p in taken[doc_id, at] if whole[4 * at:].startswith(p.ids) and p.doc_tokens == len(whole) // 4]
                assert fits
                taken[doc_id, at].remove(fits[0])
                found, at = found + fits[0].ids, at + fits[0].length
            assert found == whole
    assert not any(taken.values())
    total = sum(p.length for p in pieces)
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
    assert sorted(by_sequence) == list(range(-(-total // window)))
    for number, inside in by_sequence.items():
        inside.sort(key=lambda p: p.offset)
        at = 0
        for p in inside:
            assert p.offset == at
            at += p.length
        assert at == min(window, total - number * window)
        assert {p.pad_to for p in inside} == {packing.padded_to(at, window)}


def test_packing_odd_rows(docs_of, odd_rows):
    check_pieces(odd_rows, packing.pack(docs_of(odd_rows).repartition(3), TOKENIZER, END_ID, window=256).collect(), 256)


@pytest.mark.parametrize("shares", [None, {"a": 0.6, "b": 0.3, "c": 0.1}])
def test_windows_follow_the_mixture(docs_of, shares):
    rows = [(i, "tokens of text " * (5 + i % 13), "en", "aab c"[i % 5].replace(" ", "b")) for i in range(400)]
    pieces = packing.pack(docs_of(rows).repartition(4), TOKENIZER, END_ID, window=256, turn=16, shares=shares).collect()
    check_pieces(rows, pieces, 256)
    totals, held = defaultdict(int), defaultdict(int)
    for p in pieces:
        totals[p.source] += p.length
        held[p.sequence_id, p.source] += p.length
    whole = sum(totals.values())
    want = shares or {s: n / whole for s, n in totals.items()}
    # Until the first queue runs out every window is within a few turns of its share.
    runs_out = min(totals[s] / (want[s] * 256) for s in want)
    for window in range(int(runs_out) - 2):
        for source in want:
            assert abs(held[window, source] - 256 * want[source]) <= 4 * 16


def test_more_sources_than_queues(docs_of, monkeypatch):
    """Sources share queues by their hash; every document is packed under its own source."""
    monkeypatch.setattr(packing, "MOST_QUEUES", 7)
    rows = [(i, "tokens of text " * (1 + i % 5), "en", None if i % 40 == 0 else f"host{i % 40}") for i in range(300)]
    pieces = packing.pack(docs_of(rows).repartition(3), TOKENIZER, END_ID, window=128, turn=16).collect()
    check_pieces(rows, pieces, 128)
    assert {(p.doc_id, p.source) for p in pieces} == {(r[0], r[3]) for r in rows}
    shares = {r[3]: 1.0 + (r[0] % 3) for r in rows}
    check_pieces(rows, packing.pack(docs_of(rows), TOKENIZER, END_ID, window=128, turn=16, shares=shares).collect(), 128)


def test_queries(spark, sf_dir):
    """op1 and op2 over whole tables against whole texts."""
    from muralog.llm.queries import op1_token_output, op2_mixture_packing

    sf_dir = sf_dir.replace("sf0.01", "sf0.001")
    rows = sorted((tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()), key=lambda r: r[0])
    ids = whole_text_ids([r[1] for r in rows])
    starts = np.cumsum([0, *map(len, ids)])
    want = [(r[0], int(s), len(x), zlib.crc32(x.tobytes())) for r, s, x in zip(rows, starts, ids)]
    assert sorted(tuple(r)[:4] for r in op1_token_output(spark, sf_dir).collect()) == want
    whole = dict(zip([r[0] for r in rows], ids))
    pieces = op2_mixture_packing(spark, sf_dir).collect()
    found, places = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(whole[p.doc_id][p.start:p.start + p.length].tobytes()) and p.doc_tokens == len(whole[p.doc_id])
        found[p.doc_id].append((p.start, p.length))
        places[p.sequence_id].append((p.offset, p.length))
    for runs, ends in ((found, {i: len(x) for i, x in whole.items()}), (places, {k: min(4096, starts[-1] - 4096 * k) for k in range(-(-int(starts[-1]) // 4096))})):
        assert set(runs) == set(ends)
        for key, parts in runs.items():
            parts.sort()
            assert [a for a, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist() and sum(n for _, n in parts) == ends[key]


def test_a_source_without_share_is_refused(docs_of):
    with pytest.raises(ValueError):
        packing.pack(docs_of([(1, "x", "en", "a"), (2, "y", "en", "b")]), TOKENIZER, END_ID, shares={"a": 1.0, "b": 0.0})
