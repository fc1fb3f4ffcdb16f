"""Chat windows read back, url verdicts against a plain version."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from texts import words

from muralog.llm import chat_windows, url_trust
from muralog.llm.queries import PROBE_TURNS, TOKENIZER, URL_RULES

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(4)
    odd = ["", None, "\\", "\\b\\c\\o\\g", "</turn>\n<turn user>", "<turn", "a>b</turn", "😀 <|endoftext|>", "\n", "<", "</tur"]
    rows = [*PROBE_TURNS, (None, 0, "user", "no id"), (None, 1, "assistant", "still"), (2, None, "user", "no turn"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x")]
    rows += [(3, i, rng.choice(["user", "assistant", None, "a>\\b", "system"]), rng.choice(odd)) for i in range(40)]
    rows += [(4, 0, "system", "only the system speaks")]
    rows += [(5, i, "system" if i == 0 else "assistant" if i % 2 == 0 else "user", words(i, rng.randrange(1, 60))) for i in range(600)]
    rows += [(6, 0, "system", "short"), (6, 1, "user", words(1, 3000)), (6, 2, "assistant", words(2, 2500)), (6, 3, "user", "ok"), (6, 4, "assistant", "fine")]
    return rows


def plain(turns):
    by = defaultdict(list)
    for c, t, role, text in turns:
        by[c].append((t is not None, t, role or "", text or ""))
    return {c: [(r, x) for *_, r, x in sorted(v, key=lambda v: (v[0], v[1] or 0, v[2], v[3]))] for c, v in by.items()}


def test_everything_reads_back(spark, turns):
    frame = spark.createDataFrame(turns, SCHEMA).withColumns({c: F.lit(1) for c in ("window", "place", "piece", "key", "block")})
    windows = chat_windows.format_windows(frame, TOKENIZER, budget=300, history=60).cache()
    got = {r.conv_id: r for r in chat_windows.conversation_digests(windows).collect()}
    want = plain(turns)
    assert set(got) == set(want)
    for c, v in want.items():
        loss = "".join(x for r, x in v if r == "assistant")
        assert got[c].n_turns == len(v)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in v).encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    by_conv = defaultdict(list)
    for w in windows.collect():
        by_conv[w.conv_id].append(w)
    for c, rows in by_conv.items():
        rows.sort(key=lambda w: w.window)
        assert [w.window for w in rows] == list(range(len(rows)))
        assert got[c].formatted_chars == sum(len(w.text) for w in rows)
        system = want[c][0][0] == "system"
        for w in rows:
            pieces = w.text.split(chat_windows.END)[:-1]
            new = len(pieces) - w.repeated
            assert w.n_tokens <= 300 or new - (system and w.window == 0) <= 1  # only a turn that is too long by itself
            if system:
                assert pieces[0].startswith("<turn system>")
            for t in w.targets:
                assert w.text[:t.start].endswith("<turn assistant>") and w.text[t.start + t.length:].startswith(chat_windows.END)
    assert len(by_conv[5]) > 20 and max(w.repeated for w in by_conv[5]) >= 2
    windows.unpersist()


def test_long_conversations_fill_their_windows(spark):
    """Four hundred short turns fill the windows; one long turn among them costs no other conversation anything."""
    rng = random.Random(2)
    rows = [(c, i, "user" if i % 2 else "assistant", words(c * 1000 + i, rng.randrange(3, 18))) for c in (1, 2) for i in range(400)]
    rows += [(2, 400, "user", words(9, 2000))]
    found = defaultdict(list)
    for w in chat_windows.format_windows(spark.createDataFrame(rows, SCHEMA), TOKENIZER).select("conv_id", "window", "n_tokens").collect():
        found[w.conv_id].append((w.window, w.n_tokens))
    for windows in found.values():
        fills = [n for _, n in sorted(windows)][1:-2]
        assert len(fills) > 8 and sum(fills) / len(fills) >= 0.85 * chat_windows.BUDGET and max(fills) <= chat_windows.BUDGET


def test_chat_query(spark, sf_dir):
    from muralog.llm.queries import op5_chat_windows

    sf_dir = sf_dir.replace("sf0.01", "sf0.001")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + PROBE_TURNS
    got = {r.conv_id: r for r in op5_chat_windows(spark, sf_dir).collect()}
    want = plain(rows)
    assert set(got) == set(want)
    for c, v in want.items():
        loss = "".join(x for r, x in v if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (
            len(v), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in v).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat_windows.conversation_digests(chat_windows.format_windows(empty, TOKENIZER)).count() == 0


def test_one_conversation_in_many_ranges(spark):
    """Turns that are NULL, repeat or are equal rows are cut evenly, and still follow each other by turn, role and text."""
    n = 6000
    rows = [(1, None, "user", words(i, 8)) for i in range(n)] + [(2, 5, "user", "ok")] * n + [(3, i % 3, "assistant", words(i, 60 + i % 3)) for i in range(n)]
    rows += [(None, None, None, None)] * 50
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        counted = chat_windows.stage(chat_windows.counted_turns(spark.createDataFrame(rows, SCHEMA), TOKENIZER), "test-turns")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    ranges = counted.groupBy(F.shiftright("at", 33)).count().collect()
    assert len(ranges) >= 4 and max(r["count"] for r in ranges) < 2 * len(rows) / len(ranges)
    got = defaultdict(list)
    for r in chat_windows.numbered(counted).orderBy("place").collect():
        got[r.conv_id].append((r.place, (r.turn is not None, r.turn or 0, r.role, r.piece)))
    for c, v in got.items():
        assert [p for p, _ in v] == list(range(n if c else 50))
        assert [k for _, k in v] == sorted(k for _, k in v)
    assert len(got) == 4


def test_digests_gather_no_conversation(spark):
    """Windows stay rows of their own up to the hash; keys NULL, one and two, over several Arrow batches."""
    rows = [(c, i, "user" if i % 2 else "assistant", words(i, 40)) for c in (None, 1, 2) for i in range(1500)]
    windows = chat_windows.stage(chat_windows.format_windows(spark.createDataFrame(rows, SCHEMA), TOKENIZER, budget=300, history=60), "test-windows")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        digests = chat_windows.conversation_digests(windows)
        plan = digests._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan
        got = {r.conv_id: r for r in digests.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for c, v in plain(rows).items():
        assert got[c].n_turns == 1500 and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in v).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256("".join(x for r, x in v if r == "assistant").encode()).hexdigest()
    assert len(got) == 3


def plain_verdicts(pages, rules):
    placed = []
    for page_id, url, html in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
        path = m[2] if m else ""
        fits = []
        for text, verdict in rules:
            name, rest = text.split("/", 1)
            if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
                fits.append((len(text), text, verdict))
        placed.append((page_id, host, path, *(max(fits)[1:] if fits else (None, None)), html))
    hosts = {h for _, h, *_ in placed if h}
    share = {what: {h: sum(p[1] == h and p[4] == what for p in placed) / sum(p[1] == h for p in placed) for h in hosts} for what in ("allow", "block")}
    links = defaultdict(int)
    for _, host, _, _, _, html in placed:
        for to in re.findall(r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)""", html or "") if host else []:
            to = re.sub("[A-Z]", lambda c: c[0].lower(), to)
            if to != host:
                links[host, to] += 1

    def spread(seed, edges):
        out = defaultdict(float)
        for (a, _), n in edges.items():
            out[a] += n
        score = {h: 0.15 * s for h, s in seed.items()}
        for _ in range(url_trust.STEPS if edges else 0):
            after = defaultdict(float, {h: 0.15 * s for h, s in seed.items()})
            for (a, b), n in edges.items():
                after[b] += 0.85 * score.get(a, 0.0) * n / out[a]
            score = after
        return score

    trust, distrust = spread(share["allow"], links), spread(share["block"], {(b, a): n for (a, b), n in links.items()})
    return [(i, h, p, rule, verdict or ("block" if h and distrust.get(h, 0.0) - trust.get(h, 0.0) > url_trust.THRESHOLD else "allow"))
            for i, h, p, rule, verdict, _ in placed]


def test_urls_and_links(spark):
    pages = [(1, None, None), (2, "no scheme/x", "<a href=//a.com/>"), (3, "HTTP://WWW.Example.com/en/x?y#z", None), (4, "http://example.com/en/", ""),
             (5, "http://a.example.com/en", "x"), (6, "x://com/", "x"), (7, "x://com", "x"), (8, "x://notcom/", "x"), (9, "http://a.net/es/1", ""), (9, "http://a.net/es/1", ""),
             (10, "http://farm.org/", '<a href="http://A.net/es/2">x</a><a HREF = //a.net>y</a>'), (11, "http://mill.org/", "<a href='https://farm.org/p'>"),
             (12, "http://good.org/", '<a href="http://a.net/">'), (13, "http://b.com/", '<a href="http://good.org/x"><a href=http://good.org>'),
             (14, "http://a.net/other", ""), (15, "http://x://y.com/en/?a", ""), (16, "http://plain.org?q=http://a.net/es/", None), (17, "http://É.ORG/p\nq", "")]
    pages += [(20 + i, f"http://a.net/es/{i}", None) for i in range(8)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "path", "src", "score")})
    got = sorted((tuple(r) for r in url_trust.judge(frame, URL_RULES).collect()), key=str)
    want = plain_verdicts(pages, URL_RULES)
    assert got == sorted(want, key=str)
    verdict = {w[0]: w[4] for w in want}
    # farm.org links to a mostly blocked host; a.net itself also gets trust, from good.org.
    assert verdict[10] == "block" and verdict[12] == verdict[14] == verdict[1] == verdict[16] == "allow"
    assert url_trust.judge(frame.where("false"), URL_RULES).count() == 0
