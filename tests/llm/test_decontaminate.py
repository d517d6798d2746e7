import hashlib
import pickle
import random

from stratacell.llm import decontaminate, registry

from .conftest import ALNUM, LOWER, SF


def brute(documents, items):
    windows = {}
    for key, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        for j in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[j : j + 13]), set()).add(str(key))
    lengths = sorted({len(k) for k in windows})
    out = []
    for key, text in documents:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for p in range(len(w)):
            for n in lengths:
                own = tuple(w[p : p + n])
                if len(own) == n and own in windows:
                    hit.update(range(p, p + n))
                    found |= windows[own]
        names = sorted(found)
        sha = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, tables):
    docs = [(r.doc_id, r.text) for r in tables("documents").collect()]
    items = [(r.item_id, r.text) for r in tables("benchmark").collect()]
    expected = brute(docs, items)
    assert any(x[5] for x in expected)
    assert rows(registry.op1_decontamination(spark, SF)) == sorted(expected, key=str)


def test_odd_rows_and_short_items(spark, odd):
    items = [(1, "Three four FIVE"), (2, None), (3, ""), (None, "one two"), (4, "word"), (4, "long long"), (5, "six seven eight nine ten eleven twelve thirteen fourteen and more than that it has")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    expected = sorted(brute(docs, [x for x in items if x[0] is not None]), key=str)
    assert rows(decontaminate.contamination(odd, bench)) == expected
    kept = decontaminate.decontaminate(odd, bench)
    assert kept.columns == odd.columns
    assert kept.count() == sum(not x[5] for x in expected)


def test_a_long_document_with_a_window_goes(spark):
    item = " ".join(f"w{i}" for i in range(30))
    around = " ".join(f"x{i}" for i in range(2000))
    docs = [(1, f"{around} {item[:60]} {around}"), (2, around), (2, f"{around} {item} {around}"), (None, f"{around} short item here"), (3, None), (4, "a short item here")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "short item here")], "item_id long, text string")
    kept = [(r.doc_id, r.text) for r in decontaminate.decontaminate(df, bench).collect()]
    assert sorted(kept, key=str) == sorted([docs[1], docs[3], docs[4]], key=str)


def longest(text, items):
    """Length, start and item of the longest match that begins with a window."""
    w, best = ALNUM.findall((text or "").translate(LOWER)), (0, None, None)
    for key, other in items:
        o = ALNUM.findall((other or "").translate(LOWER))
        for j in range(max(1, len(o) - 12) if o else 0):
            need = min(13, len(o))
            for p in range(len(w) - need + 1):
                n = 0
                while p + n < len(w) and j + n < len(o) and w[p + n] == o[j + n]:
                    n += 1
                if n >= need:
                    best = min(best, (-n, p, str(key)), key=lambda x: (x[0], -1 if x[1] is None else x[1], x[2] or ""))
    return -best[0], best[1], best[2]


def test_longest_matches_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(3, 40)))) for i in range(25)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(120)))) for i in range(40)]
    docs += [(100 + i, " ".join(rng.choices(words, k=9)) + " " + items[i][1] + " " + items[i][1]) for i in range(25)]
    df, bench = (spark.createDataFrame(x, f"{k} long, text string").repartition(3) for x, k in ((docs, "doc_id"), (items, "item_id")))
    got = sorted((r.doc_id, r.longest_match, r.longest_start, r.longest_item) for r in decontaminate.contamination(df, bench).collect())
    assert got == sorted((k, *longest(t, items)) for k, t in docs)
    assert rows(decontaminate.contamination(df, bench)) == sorted(brute(docs, items), key=str)


def test_a_block_travels_in_twice_its_text():
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(300)) for _ in range(300)]
    block = decontaminate.BenchmarkBlock([(str(i), t) for i, t in enumerate(texts)])
    assert len(pickle.dumps(block)) < 2.2 * sum(map(len, texts))


def test_blocks_do_not_change_results(spark, tables, monkeypatch):
    one = rows(decontaminate.contamination(tables("documents"), tables("benchmark")))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1000)
    blocks = decontaminate.benchmark_blocks(spark, tables("benchmark"), 1000)
    assert len(blocks) > 5
    monkeypatch.setattr(decontaminate, "benchmark_blocks", lambda *a, **k: blocks)
    assert rows(decontaminate.contamination(tables("documents"), tables("benchmark"))) == one


def test_longest_match(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "before that " + item[:80] + " and after"), (2, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert (found[2].longest_match, found[2].longest_start, found[2].longest_item) == (30, 0, "7")
    assert found[1].longest_start == 2 and found[1].longest_match >= 13


def test_empty_tables(spark, empty, odd, tables):
    assert decontaminate.contamination(empty, tables("benchmark")).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(odd, tables("benchmark").limit(0)).collect())
