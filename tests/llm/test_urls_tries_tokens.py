"""URL filter, prefix trie and token alignment against plain Python: nulls, blanks, ties, repeats, empty tables, clashing columns."""

import collections
import hashlib
import random
import re
import string
import tracemalloc
import zlib

import pyarrow as pa
import pyspark
import pytest
from pyspark.sql import functions as F

from armwise.llm import prefix_trie, token_alignment, url_filter
from armwise.llm.queries import LISTED_WORDS, URL_RULES, byte_bpe

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.net/en/", "http://example.net/en", "http://x.net", "http://x.net/", "http://x.net?q=/en/", "http://net/a", "http://notnet/a", "http://a.org/fr/é?x#y",
    "ftp://b.example.com/de/1", "http://example.com/DE/1", "http://spam-farm.example.com/en/1/?utm_source=f&a=1#t", "https://www.spam-farm.example.com:443/en/1?a=1&ref=x", "http://m.spam-farm.example.com/en/1?a=1",
    "http://", "http:///de/", "no scheme", "", None, "http://a..net/x", "a://b://c.net/", "http://user@h.net:80/p", "http://ads.example.org/fr/2", "http://x.example.net/en/" + "y" * 5000, "http://fr.org/fr/\nx",
]


def split_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return host.translate(LOWER), path, (re.match(r"[^?#]*\?([^#]*)", rest) or [0, ""])[1]


def canonical(url):
    host, path, query = split_url(url)
    asked = "&".join(p for p in query.split("&") if p and not re.match(url_filter.TRACKING, p))
    return re.sub(":(80|443)$", "", re.sub("^www[.]", "", host)) + re.sub("/+$", "", path) + ("?" + asked if asked else "")


def judged(urls, rules, listed):
    out = []
    for url in urls:
        host, path, _ = split_url(url)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        known = bool(host) and canonical(url) in listed
        out.append((host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "block" if known else "allow", known))
    return out


@pytest.mark.parametrize(("blocks", "rows"), [(url_filter.MOST_BLOCKS, url_filter.BROADCAST_ROWS), (2, 0)])
def test_url_filter(spark, monkeypatch, blocks, rows):
    """Also with a filter of many slices and with a list that is not broadcast."""
    monkeypatch.setattr(url_filter, "MOST_BLOCKS", blocks)
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", rows)
    pages = spark.createDataFrame([(i // 2 if i % 5 else None, u, "h", 1, 2, 3) for i, u in enumerate(URLS * 3)], "page_id int, url string, host string, row int, hits int, id int").repartition(3)
    rules = [*URL_RULES, ("example.net", "/en/1", "block"), ("", "/", "block"), ("h.net:80", "", "allow"), ("h.net:80", "/p", "block")]
    more = [f"other{i}.example/{i}" for i in range(100)]
    listed = url_filter.listed_by_words(pages, LISTED_WORDS).unionByName(spark.createDataFrame([(x,) for x in [*more, None, more[0]]], "url string"))
    words = {canonical(u) for u in URLS if u and set(re.split("[.:-]", split_url(u)[0])) & set(LISTED_WORDS)}
    assert len(words) == 3
    found = url_filter.judge(pages, spark.createDataFrame([*rules, rules[0]], "host string, path string, verdict string"), listed).drop("page_id")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(judged(URLS * 3, rules, words), key=str)


def test_url_filter_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (None, None)], "page_id bigint, url string")
    rules, listed = spark.createDataFrame([], "host string, path string, verdict string"), spark.createDataFrame([], "url string")
    assert sorted(tuple(r)[1:] for r in url_filter.judge(pages, rules, listed).collect()) == [("", "", None, "allow", False), ("a.net", "/", None, "allow", False)]
    assert url_filter.judge(pages.limit(0), rules, listed).collect() == []


def test_url_filter_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    plan = url_filter.judge(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"), url_filter.listed_by_words(pages, ["a"]))
    assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().executedPlan().toString())


def talks():
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 40), *range(100, 140), 205, 300, -7, -100]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é€", None, ""])))
    rows += [(5000 + i, t, "user", "same" if t < 6 else f"{i % 2}") for i in range(60) for t in range(7)]
    rows += [(6000 + i, t, "user", f"chain{t}") for i in range(30) for t in range(i + 1)]
    return rows + [(7000, None, "x", "first"), (7000, 1, "x", "b"), (7000, 1, "x", "b"), (7000, None, None, None), (7001, 0, "a:", "b"), (7002, 0, "a", ":b"), (None, 0, "user", "lost")]


def nodes_of(rows, forked=True):
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    turns = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    if forked:
        heads = {c: zlib.crc32(str(c).encode()) % 6 for c in turns}
        base = lambda c: c - (c % 100 if c >= 0 else -(-c % 100))
        turns = {c: turns.get(base(c), [])[: heads[c]] + v[heads[c] :] for c, v in turns.items()}
    members = collections.defaultdict(list)
    for c, v in turns.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    ends = collections.defaultdict(list)
    for c, v in turns.items():
        ends[tuple(v)].append(c)
    return [
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
        for k, m in members.items()
    ]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", b"x") for r in rows], "conv_id int, turn int, role string, text string, id int, seq string, keys binary").repartition(4)


@pytest.mark.parametrize("piece", [prefix_trie.PIECE, 5])
def test_prefix_trie(spark, monkeypatch, piece):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    found = prefix_trie.prefix_nodes(prefix_trie.forked(prefix_trie.turn_digests(table(spark, talks()))))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(nodes_of(talks()), key=str)


def test_prefix_trie_edges(spark):
    """Conversations of one turn, of none (the root's own), and no conversations."""
    one = [(i, 0, "user", "x" * (i % 3)) for i in range(9)]
    assert sorted(map(tuple, prefix_trie.prefix_nodes(prefix_trie.turn_digests(table(spark, one))).collect()), key=str) == sorted(nodes_of(one, False), key=str)
    none = spark.createDataFrame([(4, []), (2, [])], "id bigint, turns array<struct<digest:binary,size:bigint>>")
    assert [tuple(r) for r in prefix_trie.prefix_nodes(none).collect()] == [(2, 0, None, 2, 0, 1, 0, hashlib.sha256(b"2,4").hexdigest())]
    assert prefix_trie.prefix_nodes(none.limit(0)).collect() == []


def test_fattest(spark):
    pairs = [(a, b) for b in range(1, 70) for a in range(b)]
    rows = spark.createDataFrame(pairs, "a int, b int").select("a", "b", prefix_trie.fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x) for r in rows)


TEXTS = [
    None, "", " ", "a", "hello hello world", "  two  spaces  ", "a \n b\n\n  c \t d ", "héllo wörld €uro", "😀 👍🏽 𓀀 ሴa", "x▁y z", "don't  won't", "<|endoftext|> <s> </s> <unk>", "a\u00a0b c\u2003d", "a\x1cb \x1c c",
    "12345 6,789.00", "word " * 500, "日本語 テキスト", "e\u0301 \u0301x", "\x00 null", "ends with space ", "hello hello world", "a" * 3000, "\u3000wide \u3000", "ﬁ ½ Å",
]


def test_token_alignment(spark):
    """Against whole texts, encoded and cut by their decoded bytes alone."""
    import public_tokenizers

    paths = byte_bpe(), public_tokenizers.path("piece_bpe_32k.model")
    pair = token_alignment.Pair(*paths)
    assert pair.separable
    rng = random.Random(8)
    letters = ["a", "b", " ", " ", "\n", "é", "😀", "\t", "1", "'s", ".", "\u00a0", "the", "ing"]
    texts = [*TEXTS, *("".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(150))]
    want, pairs, linked = {}, collections.Counter(), {}
    for i, text in enumerate(texts):
        raw = (" " + text).encode() if text else b""
        a, b = (pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)) if text else ([], [])
        if not text or b"".join(pair.bytes_a[x] for x in a) != raw or b"".join(pair.bytes_b[x] for x in b) != raw:
            want[i], linked[i] = (0, 0, 0, 0, ""), []
            continue
        owner = [[k for k, x in enumerate(ids) for _ in of[x]] for ids, of in ((a, pair.bytes_a), (b, pair.bytes_b))]
        linked[i] = [(a[x], b[y]) for x, y in sorted(set(zip(*owner, strict=True)))]
        ends = [[p + 1 for p in range(len(raw)) if p + 1 == len(raw) or own[p] != own[p + 1]] for own in owner]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        inside = lambda ids, e, lo, hi: ",".join(str(x) for x, at in zip(ids, e, strict=True) if lo < at <= hi)
        groups = [inside(a, ends[0], lo, hi) + "|" + inside(b, ends[1], lo, hi) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        want[i] = (len(a), len(b), len(cuts), len(linked[i]), hashlib.sha256(";".join(groups).encode()).hexdigest())
        pairs.update(linked[i])
    most = collections.Counter()
    for (_, b), n in pairs.items():
        most[b] = max(most[b], n)
    full = [(i, *w[:4], sum(pairs[p] == most[p[1]] for p in linked[i]), sum(pairs[p] for p in linked[i]), w[4]) for i, w in want.items()]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id int, text string, chunk int, doc int, n int").repartition(3)
    found = token_alignment.align(docs, *paths)
    assert sorted(map(tuple, found.collect())) == sorted(full)
    assert sum(w[0] == 0 for w in want.values()) < 12
    assert token_alignment.align(docs.limit(0), *paths).collect() == []

    each = collections.defaultdict(list)
    for r in token_alignment.token_groups(docs, *paths).collect():
        each[r.doc_id].append((r.start, r.end, ",".join(map(str, r.a)) + "|" + ",".join(map(str, r.b))))
    for i, w in want.items():
        rows = sorted(each[i])
        assert hashlib.sha256(";".join(r[2] for r in rows).encode()).hexdigest() == w[4] if w[2] else not rows
        assert all(x[1] == y[0] for x, y in zip(rows, rows[1:], strict=False)) and (not rows or rows[0][0] == 0)


def test_token_alignment_ids(spark):
    """Rows that repeat an id or have none are documents of their own."""
    import public_tokenizers

    paths = byte_bpe(), public_tokenizers.path("piece_bpe_32k.model")
    named = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").coalesce(1)
    docs = named.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 1, 1).cast("bigint"))
    rows = lambda df: sorted(tuple(r)[1:] for r in token_alignment.align(df, *paths).collect())
    assert rows(docs) == rows(named)


def test_token_alignment_memory(monkeypatch):
    """Units that a worker remembers are few bytes each and no more than it may; chunks of any size give the same documents."""
    import public_tokenizers

    monkeypatch.setattr(pyspark, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c()), "partitionId": lambda self: 0}))
    paths, rng = (byte_bpe(), public_tokenizers.path("piece_bpe_32k.model")), random.Random(4)
    texts = [" ".join(f"{rng.choice('abcdefg')}{rng.randrange(10**7)}" for _ in range(1_000)) for _ in range(60)] + TEXTS
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    run = token_alignment._chunks(*paths, "doc_id", "text")
    monkeypatch.setattr(token_alignment, "_pairs", {})
    token_alignment._pair(*paths)
    of = lambda: [tuple(x) for c in run([rows]) for x in zip(*(c.column(n)[0].as_py() for n in ("docs", "n_a", "n_b", "n_groups", "n_links", "hashes")), strict=True)]

    tracemalloc.start()
    try:
        before, arrow = tracemalloc.get_traced_memory()[0], pa.total_allocated_bytes()
        collections.deque(run([rows]), 0)
        grown = tracemalloc.get_traced_memory()[0] - before + pa.total_allocated_bytes() - arrow
    finally:
        tracemalloc.stop()
    assert grown < 250 * 60_000, grown / 60_000
    want = of()
    for held, remembered, at_once in ((50_000, 500, 100), (1_000, 20, 7)):
        for name, value in (("HELD", held), ("REMEMBERED", remembered), ("AT_ONCE", at_once), ("_pairs", {})):
            monkeypatch.setattr(token_alignment, name, value)
        assert of() == want
        pair = token_alignment._pair(*paths)
        assert len(pair.known_units) == len(pair.known.good) == remembered
