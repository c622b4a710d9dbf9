import random

import numpy as np

from lockstep.llm import ann, chat, substring_dedup, url_filter


def test_urls(spark):
    rules = spark.createDataFrame(
        [("block", "com", "/en/"), ("allow", "Example.com", "/en/7"), ("block", "x.org", ""), ("block", "x.org", ""), ("allow", "org", "/a*z"), ("block", None, "/")],
        "action string, host string, path string",
    )
    urls = {
        "http://a.EXAMPLE.com/en/71?q": ("allow", "Example.com/en/7"), "http://b.com/en/7": ("block", "com/en/"), "http://com/en": ("allow", None),
        "http://notcom.net/en/": ("allow", None), "http://x.org": ("block", "x.org"), "http://x.org/abcz": ("allow", "org/a*z"), "http://x.org/abc": ("block", "x.org"), "http://yx.org/abcz": ("allow", "org/a*z"),
        "no scheme": ("allow", None), "": ("allow", None), None: ("allow", None), "://": ("allow", None), "http://x.org.uk/": ("allow", None), "http://b.com#/en/": ("allow", None),
    }
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate([*urls, *urls])], "page_id long, url string, rule string")
    got = url_filter.filter_urls(pages, rules).collect()
    assert len(got) == 2 * len(urls)
    assert {x.url: (x.verdict, x.rule) for x in got} == urls
    assert {x.url: x.host for x in got}["http://a.EXAMPLE.com/en/71?q"] == "a.example.com"
    assert url_filter.filter_urls(pages.limit(0), rules).collect() == []
    assert {x.verdict for x in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_snapshots_collapse(spark):
    talks = {1: "ab", 2: "abc", 3: "abcd", 4: "abcd", 5: "abd", 6: "b", 7: "abcdx" * 500, 9: ""}
    rows = [(c, i * 2, "user" if i % 2 else "bot", t, "x") for c, text in talks.items() for i, t in enumerate(text)]
    rows += [(None, 0, "user", "a", "x"), (8, None, None, None, "x"), (8, 1, "user", "q", "x"), (8, 1, "user", "q", "x")]
    random.Random(1).shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    got = {(x.conv_id, x.part): x for x in chat.format_chats(turns).collect()}
    assert {c for c, _ in got} == {5, 6, 7, 8}  # the others go on in 7
    assert got[5, 0].chat == "<|bot|>\na\n<|end|>\n<|user|>\nb\n<|end|>\n<|bot|>\nd\n<|end|>\n"
    assert got[7, 0].n_turns == 2500 and {p for c, p in got if c == 7} == {0, 1, 2}
    assert got[8, 0].n_turns == 3 and got[8, 0].chat.endswith("<||>\n\n<|end|>\n")
    assert chat.format_chats(turns.limit(0)).collect() == []


def test_equal_conversations_keep_the_least(spark):
    turns = spark.createDataFrame([(c, t, "user", x) for c in (5, 3, 9) for t, x in enumerate("ab")], "conv_id long, turn long, role string, text string")
    assert [x.conv_id for x in chat.format_chats(turns).collect()] == [3]


def test_one_turn_number_and_long_conversations(spark):
    texts = [f"t{i:04d}" for i in range(3000)]
    rows = [(1, None, "user", t) for t in texts] + [(2, None, "user", t) for t in texts[:1500]] + [(3, 5, "user", t) for t in texts[:-1]] + [(4, 10**9 * i, "user", texts[i]) for i in range(1100)]
    rows += [(5, 0, "user", None), (6, 0, "user", "\0"), (7, 0, None, "x"), (8, 0, "\0", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(9)
    got = {}
    for x in chat.format_chats(turns).collect():
        got.setdefault(x.conv_id, {})[x.part] = x
    assert set(got) == {1, 5, 6, 7, 8} and {k for k in got[1]} == {0, 1, 2} and got[1][0].n_turns == 3000
    assert "".join(got[1][k].chat for k in range(3)) == "".join(f"<|user|>\n{t}\n<|end|>\n" for t in texts)


def words(r, n):
    return [f"w{r.randrange(10**5)}" for _ in range(n)]


def test_passages_are_cut(spark):
    r = random.Random(2)
    passage = " ".join(words(r, 80))
    own = {i: [" ".join(words(r, 60)), " ".join(words(r, 60))] for i in range(12)}
    rows = [(i, f"{a} {passage} {b}" if i % 2 else f"{a} {b}") for i, (a, b) in own.items()]
    rows += [(20, rows[2][1]), (21, None), (22, ""), (None, rows[4][1]), (23, f"{passage} alone {passage}"), (24, "the short common words " * 3)]
    docs = spark.createDataFrame([(*x, 5, "l") for x in rows], "doc_id long, text string, removed_bytes int, lang string")
    got = {x.doc_id: x for x in substring_dedup.dedup_substrings(docs).collect()}
    texts = dict(rows)
    assert len(got) == len(rows)
    for i in range(0, 12, 2):
        assert got[i].text == texts[i] and got[i].removed_bytes == 0
    assert got[1].text == texts[1]
    for i in range(3, 12, 2):
        # A chunk at the passage's ends may have come first in a later document.
        assert 1 in got[i].first_ids and set(got[i].first_ids) < set(range(1, i, 2)) | {i}
        assert got[i].removed_bytes > 0.6 * len(passage)
        a, b = own[i]
        assert got[i].text.startswith(a[: len(a) - 60]) and got[i].text.endswith(b[60:])
    assert got[20].text == "" and got[20].first_ids == [2]
    assert got[None].text == "" and got[21].text is None and got[22].text == ""
    assert got[24].text == texts[24]
    assert substring_dedup.dedup_substrings(docs.limit(0)).collect() == []


def test_chunks_resist_insertions():
    r = random.Random(3)
    spaced = " ".join(words(r, 2000)).encode()
    unspaced = "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(6000)).encode()
    window, look = substring_dedup.measures(30)

    def of(data):
        return set(substring_dedup.chunks(substring_dedup.digests(data, substring_dedup.boundaries(data))[0], window, look)[0].tolist())

    for data, more in ((spaced, b"inserted two "), (unspaced, "一二".encode())):
        for at in (3000, 6000, 9000):
            at = data.index(b" ", at) + 1 if data is spaced else at
            a, b = of(data), of(data[:at] + more + data[at:])
            assert len(a) > 100 and len(a - b) <= 7 and len(b - a) <= 7
    for x in (b"", b" ", b"a" * 5000, "é".encode() * 3000, spaced, unspaced):
        ends = substring_dedup.boundaries(x)
        assert (list(ends[-1:]) or [0]) == [len(x)] and (np.diff(ends, prepend=0) > 0).all()
        start = 0
        for e in ends:
            x[start:e].decode()
            start = e


def test_every_window_has_a_boundary():
    r = np.random.default_rng(4)
    for n in (0, 1, 5, 16, 17, 200, 3000):
        found = r.integers(0, 1 << 63, n, np.uint64) << np.uint64(1)
        for window in (1, 2, 9):
            digest, begins, ends = substring_dedup.chunks(found, window, 8)
            assert len(digest) == len(begins) == len(set(begins.tolist())) == len(ends) and (n == 0 or begins[0] == 0)
            assert (ends > begins).all() and (ends <= n).all()
            if n >= 4 + window:
                assert np.diff(begins[1:], append=n).max(initial=0) <= window + 1


def plain_repeats(rows, k=16, least=30):
    """Texts with every run of repeated grams cut, word by word."""
    held = {i: (t or "").split() for i, t in rows}
    where = {}
    for i in sorted(held):
        for at in range(len(held[i]) - k + 1):
            where.setdefault(tuple(held[i][at : at + k]), (i, at))
    out = {}
    for i, w in held.items():
        hit = [where[tuple(w[at : at + k])] != (i, at) for at in range(len(w) - k + 1)] + [False]
        cut, start = [False] * len(w), None
        for at, x in enumerate(hit):
            if x and start is None:
                start = at
            elif not x and start is not None:
                if at - 1 + k - start >= least:
                    cut[start : at - 1 + k] = [True] * (at - 1 + k - start)
                start = None
        out[i] = [x for x, c in zip(w, cut, strict=True) if not c]
    return out


def test_same_cuts_as_comparing_every_word(spark):
    r, rows = random.Random(14), []
    for i in range(150):
        parts = [" ".join(words(r, r.randrange(5, 60)))]
        for _ in range(r.randrange(3)):
            if rows and r.random() < 0.8:
                w = r.choice(rows)[1].split()
                at, n = r.randrange(max(1, len(w) - 20)), r.choice([12, 29, 30, 31, 33, 50, 51, 52, 55, 70, 400])
                parts.append(r.choice([" ", "\n", "  "]).join(w[at : at + n]))
            parts.append(" ".join(words(r, r.randrange(1, 40))))
        rows.append((i, " ".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1] + " x"), (202, rows[5][1] * 2), (203, "one word " * 60), (204, "short text"), (205, "short text"), (206, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in substring_dedup.dedup_substrings(docs).collect()}
    want = plain_repeats(rows)
    assert {i: (x.text or "").split() for i, x in got.items()} == want
    assert sum(len(w) != len((t or "").split()) for (_, t), w in zip(rows, want.values(), strict=True)) > 40
    for i, t in rows:
        data = (t or "").encode()
        kept, at = [], 0
        for x in got[i].removed_spans:
            kept.append(data[at : x.start])
            at = x.end
        assert b"".join([*kept, data[at:]]).decode() == (got[i].text or "") and sum(x.end - x.start for x in got[i].removed_spans) == got[i].removed_bytes


def test_dedup_keeps_rows_and_columns(spark):
    r = random.Random(15)
    text = " ".join(words(r, 50))
    rows = [(1, text), (1, text), (1, text + " " + text), (None, text), (2, None), (2, text), (2, ""), (3, "long " + text * 300)]
    docs = spark.createDataFrame([(i, t, "a", [1], n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, _row string, _hash array<int>, removed_bytes int")
    got = substring_dedup.dedup_substrings(docs, into=("spans", "cut", "firsts"))
    assert got.columns == [*docs.columns, "spans", "cut", "firsts"]
    held = {x.removed_bytes: x for x in got.collect()}
    assert [held[n].text for n in range(2)] == [text, text] and held[2].text.split() == text.split() and held[3].text == "" and held[3].firsts == [1]
    assert held[4].text is None and held[5].text == "" and held[6].text == "" and len(held[7].text) < 200
    with __import__("pytest").raises(ValueError, match="at least"):
        substring_dedup.dedup_substrings(docs, min_words=4)


def test_search_over_many_blocks(spark, monkeypatch):
    r = np.random.default_rng(6)
    monkeypatch.setattr(ann, "QUERIES_AT_ONCE", 70)
    x = r.normal(0, 1, (20_000, 16))
    x[15_000:15_040] = x[7]  # ties, over several blocks' worth of ids
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(vectors, vectors.filter("vec_id % 100 = 0 or vec_id = 7")).toPandas()
    hits = 0
    for q in [*range(0, 20_000, 100), 7]:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, d[own.vec_id.to_numpy()], rtol=0, atol=1e-12)
        hits += len(set(order) & set(own.vec_id))
        if q == 7 or 15_000 <= q < 15_040:
            assert own.vec_id.tolist() == order
    assert hits >= 0.9 * 2010


def test_nearest_vectors(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(0, 1, (600, 10)), np.tile(r.normal(0, 1, (1, 10)), (50, 1))])
    rows = [(int(i), v.tolist(), "c") for i, v in enumerate(x)] + [(1000, None, "c"), (1001, [0.0] * 10, "c"), (1002, [float("nan")] * 10, "c"), (1003, [1.0, None] * 5, "c"), (None, x[0].tolist(), "c"), (1004, [1.0], "c")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    asked = [0, 100, 200, 300, 600, 649]
    got = ann.nearest(vectors, vectors.filter(vectors.vec_id.isin([*asked, 1000, 1001, 1002]))).toPandas()
    assert sorted(got.query_id.unique()) == asked
    hits = 0
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert np.allclose(own.score, d[own.vec_id.to_numpy()], rtol=0, atol=1e-12)
        hits += len(set(order) & set(own.vec_id))
        if q >= 600:
            assert own.vec_id.tolist() == order
    assert hits >= 0.9 * 10 * len(asked)
    assert ann.nearest(vectors.limit(0), vectors.limit(0)).collect() == []
    few = vectors.filter("vec_id < 3")
    assert ann.nearest(few, few).groupBy("query_id").count().filter("count <> 2").count() == 0


def test_passages_just_over_fifty_words_are_cut_whole(spark):
    rows, planted = [], {}
    for seed in range(60):
        r = random.Random(seed)
        passage = " ".join(words(r, 51 + seed % 10))
        for copy in (0, 1):
            a, b = " ".join(words(r, 40)), " ".join(words(r, 40))
            rows.append((2 * seed + copy, f"{a} {passage} {b}"))
            planted[2 * seed + copy] = f"{a} {passage} {b}" if copy == 0 else f"{a} {b}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in substring_dedup.dedup_substrings(docs).collect()}
    assert {i: x.text for i, x in got.items()} == planted
    assert all(got[i].first_ids == ([i - 1] if i % 2 else []) for i in planted)


def test_passages_without_spaces_are_cut(spark):
    r = random.Random(6)
    unspaced = lambda n: "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    passage, own = unspaced(400), [unspaced(300 + i) for i in range(4)]
    rows = [(0, own[0] + passage + own[1]), (1, own[2] + passage + own[3]), (2, own[0] + passage + own[1]), (3, own[1])]
    got = {x.doc_id: x for x in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1] and got[2].text == "" and got[2].first_ids == [0]
    assert got[1].text.startswith(own[2]) and got[1].text.endswith(own[3]) and len(got[1].text) < len(own[2]) + len(own[3]) + 60
    assert len(got[3].text) < 60


def test_passages_that_meet_are_one_cut():
    assert substring_dedup.runs([*((i, 1) for i in range(20)), *((i, 2) for i in range(35, 55)), *((i, 1) for i in range(80, 94))], 16, 30) == [(0, 70, [1, 2])]
