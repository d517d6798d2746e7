import hashlib
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from stratacell.llm import byte_bpe, registry, textkit, token_files
from stratacell.llm.scratch import Scratch

from .conftest import SF

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteBpe.from_file(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def noise(seed, n, alphabet="ab aaé \x1c\x85日本1２ \n\t's$#Ω😀"):
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet + chr(rng.randrange(0x20, 0xD7FF))) for _ in range(n))


def test_encoder_equals_library(coder, reference):
    for seed in range(200):
        text = noise(seed, seed)
        ids = coder.encode(text)
        assert ids == reference.encode_ordinary(text) and coder.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["", "a" * 30_000, "ab" * 9_000, "é" * 5_000, "\x00" * 999, noise(5, 6000, "abcdefghij")])
def test_long_pre_tokens(coder, reference, text):
    assert coder.encode(text) == reference.encode_ordinary(text)


def test_cache_is_bounded(coder, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 3)
    coder.cache.clear()
    text = "unusualwords followedby otherstrange zzyzxwords again followedby"
    assert coder.encode(text) == reference.encode_ordinary(text) and len(coder.cache) <= 3


def merged_one_by_one(ranks, piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1 and piece not in ranks:
        rank, i = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 30:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[piece]] if piece in ranks else [ranks[x] for x in parts]


@pytest.mark.parametrize("large", [1, 3, 10**9])
def test_shared_queue_merges_as_one_by_one(monkeypatch, large):
    monkeypatch.setattr(byte_bpe, "LARGE", large)
    rng = random.Random(17)
    for case in range(60):  # ranks in no order: a merge often brings a lower rank into use
        tokens = list({"".join(rng.choices("abc", k=rng.randrange(2, 7))) for _ in range(rng.choice([5, 40, 300]))})
        rng.shuffle(tokens)
        ranks = {bytes([i]): i for i in range(256)} | {t.encode(): 256 + i for i, t in enumerate(tokens)}
        own = byte_bpe.ByteBpe(ranks, " ?[a-z]+")
        words = ["".join(rng.choices("abc", k=rng.choice([1, 4, 9, 30]))) for _ in range(50)] + ["a" * 57, "ab" * 31, "abc" * 20]
        texts = [" ".join(rng.choices(words, k=9)) for _ in range(12)] + ["", "aaa"]
        got = list(own.encode_all(texts))
        assert got == [[x for p in own.find(t) for x in merged_one_by_one(ranks, p.encode())] for t in texts]
        assert not any(own.words)


def test_unknown_pre_tokens_share_a_queue(coder, reference, monkeypatch):
    pops, pop = [], byte_bpe.heappop
    monkeypatch.setattr(byte_bpe, "heappop", lambda bucket: pops.append(1) or pop(bucket))
    rng = random.Random(19)
    words = {"".join(rng.choices(["an", "th", "er", "in", "ou", "st", "ble", "ing"], k=5)) for _ in range(3000)}
    text = " ".join(words)
    coder.cache.clear()
    assert coder.encode(text) == reference.encode_ordinary(text)
    assert len(pops) < len(words)


def test_one_very_long_text_and_many_short_ones(coder, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "QUEUE_BYTES", 50)
    monkeypatch.setattr(byte_bpe, "CACHE_CHARS", 100)
    texts = [noise(s, 40) for s in range(40)] + [noise(7, 4000, "abcdefg"), "ab" * 5000, ""]
    coder.cache.clear()
    for _ in range(2):
        assert list(coder.encode_all(texts)) == [reference.encode_ordinary(t) for t in texts]
    assert not coder.cache


def test_bpe_query(spark, tables, reference):
    texts = {r.doc_id: r.text or "" for r in tables("documents").collect()}
    rows = registry.op3_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_tables(odd, empty, reference):
    encoded = byte_bpe.encode_documents(odd, RANKS, public_tokenizers.PATTERN)
    rows = byte_bpe.decode_documents(encoded, RANKS).collect()
    got = sorted(((r.doc_id, bytes(r.decoded)) for r in rows), key=str)
    assert got == sorted(((r.doc_id, (r.text or "").encode()) for r in odd.collect()), key=str)
    assert byte_bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN).count() == odd.count()


def word_ids(own, texts, limit=1 << 20):
    return [x.tolist() for p in textkit.pieces(pa.array(texts, pa.large_string()), limit) for x in own.encode(p)]


def test_word_tokenizer_equals_library(monkeypatch):
    library = Tokenizer.from_file(WORDS)
    texts = [noise(s, 80, "ab aaé\u0301 \x1c\x85\u3000日本1２ \n\t's$#ΩΣσIİ😀<|endoftext|>\x01") for s in range(300)]
    texts += ["x <|endoftext|>y <|startoftext|>\u0301 z <|ENDOFTEXT|>", "", "ΑΣ ΑΣ. ας", "é \u0301e", "  ", "THE The the tHe", "a\x01b c", None]
    expected = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    for entries, limit in ((10**6, 1 << 20), (40, 200)):
        monkeypatch.setattr(token_files, "CACHE_ENTRIES", entries)
        assert word_ids(token_files.WordTokenizer(open(WORDS).read()), texts, limit) == expected


def test_every_character_reads_as_in_the_library():
    own, library = token_files.WordTokenizer(open(WORDS).read()), Tokenizer.from_file(WORDS)
    texts = [f"a{chr(c)}b{chr(c)} {chr(c)}1" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    assert word_ids(own, texts) == [[*e.ids, 1] for e in library.encode_batch(texts, add_special_tokens=False)]


def test_letters_before_combining_marks_keep_their_case():
    marks = [c for c in map(chr, range(0x30000)) if unicodedata.combining(c)]
    cases = [[f"{chr(a + i)}{m} x{chr(a + i)}{m}" for m in marks for i in range(26)] for a in (65, 97)]
    library = Tokenizer.from_file(WORDS)
    assert library.encode("H\u0331", add_special_tokens=False).ids != library.encode("h\u0331", add_special_tokens=False).ids
    for texts in (cases[0] + cases[1], cases[1] + cases[0]):
        own = token_files.WordTokenizer(open(WORDS).read())
        assert word_ids(own, texts) == [[*e.ids, 1] for e in library.encode_batch(texts, add_special_tokens=False)]


def test_file_round_trip_and_random_access():
    rng = np.random.default_rng(2)
    for terminals in (50, 49408, 200_000):
        lists = [rng.integers(0, min(terminals, 40), n).astype(np.int32) for n in (0, 1, 5000, 3, 700, 0)]
        lists[2][:2000] = 7
        blob = token_files.write_file([None, 5, 5, -3, 9, 10], lists, terminals)
        f = token_files.TokenFile(blob)
        assert f.doc_ids == [None, 5, 5, -3, 9, 10] and f.n_tokens == sum(map(len, lists)) and len(f.rules) > 0
        for i, x in enumerate(lists):
            assert (f.document(i) == x).all()
        for a, b in [(0, 1), (0, 5000), (1999, 2003), (4321, 4999), (17, 17)]:
            assert (f.ids(2, a, b) == lists[2][a:b]).all()
    assert token_files.TokenFile(token_files.write_file([], [], 10)).n_tokens == 0
    with pytest.raises(ValueError):
        token_files.TokenFile(b"none")


def test_no_frequent_pair_stays():
    rng = np.random.default_rng(3)
    copied = [rng.integers(0, 49408, 1000).astype(np.int32)] * 500
    lists = [rng.integers(0, 300, 1000).astype(np.int32) for _ in range(100)] + [np.full(3000, 7, np.int32)]
    for documents, most in ((copied, 2 * 500), (lists, 10**9)):
        f = token_files.TokenFile(token_files.write_file(list(range(len(documents))), documents, 49408))
        assert all((f.document(i) == x).all() for i, x in enumerate(documents)) and len(f.symbols) <= most
        pairs = Counter()
        for a, b in zip(f.bounds[:-1], f.bounds[1:]):
            own = f.symbols[a:b].tolist()
            pairs.update(zip(own, own[1:]))
        assert not pairs or max(pairs.values()) < token_files.LEAST_COUNT


def expected(rows, library):
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def result(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


def test_token_file_query(spark, tables):
    rows = [(r.doc_id, r.text) for r in tables("documents").collect()]
    assert result(registry.op9_token_files(spark, SF)) == expected(rows, Tokenizer.from_file(WORDS))


def test_token_files_of_odd_rows(spark, odd, empty):
    scratch = Scratch(spark, "test")
    files = token_files.token_files(odd, WORDS, scratch, file_tokens=100)
    assert files.count() > 3
    assert result(token_files.read_files(files)) == expected([(r.doc_id, r.text) for r in odd.collect()], Tokenizer.from_file(WORDS))
    assert token_files.read_files(token_files.token_files(empty, WORDS, scratch)).count() == 0


def test_parts_of_words_read_as_in_the_library():
    own, library = token_files.WordTokenizer(open(WORDS).read()), Tokenizer.from_file(WORDS)
    rng = random.Random(11)
    signs = ["'", "'s", "'ll", ".", ",", "$$$", "-", "<", "=", "\u0301", "\u0338", "\u00d7", "\u00f7", "\u00bb", "\u2019", "é", "É", "e\u0301", "\u00dfa", "A", "Z", "word", "Word", "7", "42", "日", "Ω", "\u1100", "\u1161", "\x1f", " "]
    texts = ["".join(rng.choices(signs, k=rng.randrange(1, 9))) for _ in range(20_000)]
    assert word_ids(own, texts) == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_signs_beside_words_and_their_case_are_not_remembered_apart():
    own = token_files.WordTokenizer(open(WORDS).read())
    word_ids(own, ["été Été ÉTÉ, été. (été) $$$été$$$ word Word. -WORD-"])
    assert len(own.hashes) <= 10


def test_words_of_letters_go_to_the_library_without_marks(monkeypatch):
    own, library = token_files.WordTokenizer(open(WORDS).read()), Tokenizer.from_file(WORDS)
    sent, ids = [], own._ids
    monkeypatch.setattr(own, "_ids", lambda text: sent.append(text) or ids(text))
    texts = ["Etwas straße ÉTÉ naïve thinghern", "don't 42 e\u0301 日本 İstanbul ªx", "x", ""]
    assert word_ids(own, texts) == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert not any("straße" in x.lower() and own._mark in x for x in sent) and any(own._mark in x for x in sent)
    own._forget()
    own.last[:] = False  # as for a vocabulary without word ends
    assert word_ids(own, texts) == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_grouping_equals_unique():
    rng = np.random.default_rng(23)
    wide = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    near = wide[0] // np.uint64(1 << 20) * np.uint64(1 << 20) + rng.integers(0, 50, 3000).astype(np.uint64)  # told apart by low bits alone
    for values in (wide, np.append(wide, wide[:700]), near, near % np.uint64(1 << 16), np.zeros(5, np.uint64), wide[:1], wide[:0]):
        got, first, which, counts = textkit.grouped(values)
        expected = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
        assert all((a == b).all() and len(a) == len(b) for a, b in zip((got, first, which, counts), expected))
