import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from lockstep.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(None, public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    r = random.Random(3)
    mixed = "".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 1000), r.randrange(0x3000, 0xA000), 32, 10])) for _ in range(3000))
    syllables = " ".join("".join(r.choice(["th", "er", "tion", "que", "ß", "ñ", "ing"]) for _ in range(r.randrange(1, 9))) for _ in range(2000))
    return ["", " ", "  a", "a  b", "a \n b", "\n\n x", "don't we'll", "x" * 300, "日本語テキスト  です", "tab\t x y", mixed, syllables, "ab" * 2000, "\x1c a\x1f b \x85 c", "I'  s' s", "🙂🙂 é"]


def test_same_ids_as_the_library(ranks, library):
    own = bpe.Tokenizer(ranks, public_tokenizers.PATTERN)
    for text in odd_texts():
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text)
        assert "".join(own.decode(ids)) == text


def test_the_machine_agrees_with_the_merges(ranks, monkeypatch):
    machine, r = bpe.Transducer(ranks), random.Random(4)
    pieces = ["".join(r.choice("etaoinshrdlué ßщ的") for _ in range(r.randrange(1, 40))).encode() for _ in range(600)]
    ids = [machine.encode(p) for p in pieces]
    assert [list(x) for x in ids] == [machine.merge(p) for p in pieces]
    # What is emitted while a piece goes on is what is emitted at its end, and the same after a new start.
    monkeypatch.setattr(bpe, "STRETCH", 3)
    monkeypatch.setattr(bpe, "STATES", 50)
    assert [bpe.Transducer(ranks).encode(p) for p in pieces[:50]] == ids[:50]
    assert [machine.encode(p) for p in pieces] == ids


def test_every_unknown_piece_goes_through_the_machine(ranks, monkeypatch):
    own, seen = bpe.Tokenizer(ranks, public_tokenizers.PATTERN), []
    start = own.machine.encode
    monkeypatch.setattr(own.machine, "encode", lambda piece: (seen.append(piece), start(piece))[1])
    text = "Some unheardofwords, somewhat unheardofwords\nand 数えられない lines " * 3
    own.encode(text)
    assert sorted(seen) == sorted({p.encode() for p in own.find(text)})
    assert own.machine.made >= len(own.machine.states) - 1 > 1
    made = own.machine.made
    for piece in seen:
        start(piece)
    assert own.machine.made == made  # known moves aren't made again


def test_tokens_that_merges_do_not_reach():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"xyz": 257}
    machine = bpe.Transducer(ranks)
    assert machine.encode(b"xyz") == (257,) and machine.encode(b"xyzab") == (120, 121, 122, 256) and machine.encode(b"") == ()
    del ranks[b"q"]
    with pytest.raises(ValueError, match="lacks a byte"):
        bpe.Transducer(ranks).encode(b"aq")


def test_pairs(ranks):
    machine, r = bpe.Transducer(ranks), random.Random(5)
    for _ in range(2000):
        a, b = (r.choice([r.randrange(600), r.randrange(len(ranks))]) for _ in range(2))
        assert machine.follows(a, b) == (machine.merge(machine.bytes_of[a] + machine.bytes_of[b]) == [a, b])


def test_decoder_at_any_cut():
    r = random.Random(8)
    samples = ["aé日🙂z".encode(), b"a\xe6\x97", b"\xf0\x9f\x99", b"\xe0\x80\x80z\xed\xa0\x80", b"\xf4\x90\x80\x80\xc0\xaf", b"\xe6\x97\xe6\x97\xa5"]
    samples += [bytes(r.choice(b"a\x80\xbf\xc3\xa9\xe2\x82\xac\xf0\x9f\xff\xed") for _ in range(12)) for _ in range(60)]
    for data in samples:
        for i in range(len(data)):
            for j in range(i, len(data)):
                d = bpe.Utf8Decoder()
                assert d.feed(data[:i]) + d.feed(data[i:j]) + d.feed(data[j:]) + d.close() == data.decode("utf-8", "replace")


def test_query_rows(spark, ranks, library):
    rows = [(1, "Hello there"), (2, None), (3, ""), (None, "Hello there"), (5, "long" * 20_000)]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, ids string")
    got = bpe.bpe_digests(docs, ["doc_id"], ranks, public_tokenizers.PATTERN).collect()
    for x in got:
        text = dict(rows)[x.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert x.n_tokens == len(ids)
        assert x.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    coded = bpe.encode_texts(docs, ["doc_id"], ranks, public_tokenizers.PATTERN)
    back = bpe.decode_ids(coded, ["doc_id"], ranks).collect()
    assert {(x.doc_id, x.text) for x in back} == {(k, t or "") for k, t in rows}
    assert bpe.encode_texts(docs.limit(0), ["doc_id"], ranks, public_tokenizers.PATTERN).collect() == []


def test_the_query_itself(spark, library, tmp_path):
    texts = {1: "Der Text, le texte", 2: None, 4: "", 7: "  zwei\n\nZeilen ", 8: "x" * 9000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for x in bpe.op6_bpe(spark, str(tmp_path)).collect():
        text = texts[x.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert (x.decoded_sha256, x.n_chars) == (hashlib.sha256(text.encode()).hexdigest(), len(text))


def test_a_piece_is_encoded_once_whether_alone_or_in_a_run(ranks, monkeypatch):
    own, seen = bpe.Tokenizer(ranks, public_tokenizers.PATTERN), []
    start = own.machine.encode
    monkeypatch.setattr(own.machine, "encode", lambda piece: (seen.append(piece), start(piece))[1])
    own.encode("a unheardofword b unheardofword, c (unheardofword d")
    assert seen.count(b" unheardofword") == 1 and not own.pieces.get(" unheardofword")


def test_digests_of_odd_texts(ranks, library):
    own, texts = bpe.Tokenizer(ranks, public_tokenizers.PATTERN), [*odd_texts(), "日" * 50]
    lists = [own.encode(t) for t in texts]
    assert any(bpe.Digests(own).chars[i] < 0 for x in lists for i in x)
    rows = list(zip(*bpe.Digests(own).of(lists), strict=True))
    assert rows == [(len(x := library.encode_ordinary(t)), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), len(t)) for t in texts]
    assert bpe.Digests(own).of([]) == [[], [], [], []]
