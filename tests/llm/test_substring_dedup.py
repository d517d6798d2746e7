import random

import pyarrow as pa

from stratacell.llm import registry, substring_dedup as sd, textkit

from .conftest import SF


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randrange(2, 9))) for _ in range(n))


def gear_ends(raw):
    """Chunk ends, byte by byte."""
    whole = lambda i: i == len(raw) or raw[i] & 0xC0 != 0x80
    natural = [i for i in range(1, len(raw) + 1) if sum(int(sd._GEAR[raw[i - 1 - k]]) << k for k in range(min(16, i))) & 0xFFFF < 1 << 16 - sd.CUT_BITS]
    cuts = [i for before, i in zip([-sd.LEAST, *natural], natural) if i - before >= sd.LEAST and whole(i) and i < len(raw)]
    ends, last = [], 0
    for c in [*cuts, len(raw)]:
        while c - last > sd.MOST:
            last += sd.MOST
            while not whole(last):
                last += 1
            if last < c:
                ends.append(last)
        if c > 0:
            ends.append(c)
        last = c
    return ends


def test_chunks_equal_a_rolling_hash():
    rng = random.Random(1)
    texts = [words(rng, 400), "", "a", "é" * 900, "x" * 3000, words(rng, 30)]
    column = pa.array(texts, pa.large_string())
    for limit in (1, 1 << 20):
        got = [e for p in textkit.pieces(column, limit) for own in [sd.chunk_ends(p)] for i in range(p.n) for e in [(own[(own > p.offs[i]) & (own <= p.offs[i + 1])] - p.offs[i]).tolist()]]
        assert got == [gear_ends(t.encode()) for t in texts]


def test_copies_are_cut_alike_soon():
    rng = random.Random(3)
    for _ in range(200):
        shared = words(rng, 51)
        cuts = []
        for _ in range(2):
            head = words(rng, rng.randrange(1, 40)) + " "
            n = len(head.encode())
            cuts.append({e - n for e in gear_ends((head + shared + " " + words(rng, 9)).encode()) if e > n})
        assert {e for e in cuts[0] if 2 * sd._REACH <= e <= len(shared.encode())} == {e for e in cuts[1] if 2 * sd._REACH <= e <= len(shared.encode())}


def test_planted_passages_are_found(spark):
    rng = random.Random(2)
    passages = [words(rng, 55) for _ in range(20)]
    docs, planted = [], {}
    for i in range(400):
        body = [words(rng, rng.randrange(30, 200))]
        if i % 4 == 0:
            k = rng.randrange(20)
            body += [passages[k], words(rng, 60)]
            planted.setdefault(k, []).append(i)
        docs.append((i, " ".join(body)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    rows = sd.repeated_passages(df).collect()
    expected = {i for ids in planted.values() for i in ids[1:]}
    assert {r.doc_id for r in rows} <= expected and len({r.doc_id for r in rows}) >= 0.98 * len(expected)
    group = {i: k for k, ids in planted.items() for i in ids}
    texts = dict(docs)
    for r in rows:
        assert group[r.first_doc_id] == group[r.doc_id] and r.first_doc_id < r.doc_id
        part = texts[r.doc_id].encode()[r.start_byte : r.end_byte]  # a few characters around may agree by chance
        assert part[16:-16] in f" {passages[group[r.doc_id]]} ".encode()
    kept = {r.doc_id: r.text for r in sd.remove_passages(df).collect()}
    assert len(kept) == 400 and all(kept[i] == t for i, t in docs if i not in {r.doc_id for r in rows})
    assert all(len(kept[r.doc_id]) < len(texts[r.doc_id]) for r in rows)


def brute(rows):
    """Each digest's first chunk by (no id, id, row, position); runs of the others."""
    chunks, first = [], {}
    for row, (key, text) in enumerate(rows):
        raw, last = (text or "").encode(), 0
        for e in gear_ends(raw):
            place, c = (key is None, key or 0, row, last), raw[last:e]
            starts = sum(textkit.NON_SPACE[raw[i]] and (i == 0 or not textkit.NON_SPACE[raw[i - 1]]) for i in range(last, e))
            chunks.append((place, c, int(starts)))
            first[c] = min(first.get(c, place), place)
            last = e
    out, run, shift = [], None, None

    def close():
        if run and (run[3] >= run[7] * sd.PASSAGE_WORDS or run[2] - run[1] >= run[7] * sd.PASSAGE_BYTES):
            out.append(tuple(run[:6]))

    for place, c, starts in sorted(chunks, key=lambda x: (x[0][2], x[0][3])):
        holder = first[c]
        if holder == place:
            continue
        inside = place[3] - holder[3] if holder[2] == place[2] else None
        follows = run and run[6] == place[2] and run[2] == place[3]
        if not follows or (inside is not None and shift is not None and inside != shift):
            close()
            run, shift = [None if place[0] else place[1], place[3], place[3], 0, 0, None if holder[0] else holder[1], place[2], 2], None
        run[2] += len(c)
        run[3] += starts
        run[4] += 1
        run[7] = 1 if inside is None else run[7]
        shift = inside if inside is not None else shift
    close()
    return sorted(out, key=str)


def found(df, **options):
    return sorted(((r.doc_id, r.start_byte, r.end_byte, r.n_words, r.n_chunks, r.first_doc_id) for r in sd.repeated_passages(df, **options).collect()), key=str)


def test_query_equals_brute_force(spark, tables):
    rows = [(r.doc_id, r.text) for r in tables("documents").limit(250).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows)
    assert len(expected) > 10 and found(df.coalesce(1)) == expected
    # Chunks settled in several tasks, and in many small blocks, give the same passages.
    for other in (found(df.repartition(7, "doc_id")), found(df.coalesce(2), block_bytes=1)):
        assert [x[:2] for x in other if x[0] != x[5]] == [x[:2] for x in expected if x[0] != x[5]]
    assert registry.op2_substring_dedup(spark, SF).count() > 0


def test_repeats_inside_a_text_and_rows_without_or_with_equal_ids(spark):
    rng = random.Random(4)
    passage, other, line = words(rng, 90), words(rng, 60), words(rng, 30)
    mixed = lambda *parts: " ".join(x for p in parts for x in (words(rng, 20), p, words(rng, 20)))
    rows = [
        (1, mixed(passage, passage, passage)),  # its second and third copy
        (2, mixed(*[line] * 30)),  # one line again and again
        (2, mixed(other)),
        (2, mixed(other)),
        (None, mixed(passage)),
        (None, mixed(line)),
        (None, mixed(other)),
        (3, mixed(words(rng, 60))),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = found(df)
    assert got == brute(rows)
    assert sorted((str(x[0]), str(x[5])) for x in got) == [("1", "1"), ("1", "1"), ("2", "2"), ("None", "1"), ("None", "2")]
    kept = [r.text for r in sd.remove_passages(df).collect()]
    assert len(kept) == len(rows) and sum(len(t.encode()) for _, t in rows) - sum(len(t.encode()) for t in kept) == sum(x[2] - x[1] for x in got)
    with_id = spark.createDataFrame([(9, t) for _, t in rows], "doc_id long, text string").coalesce(1)
    assert len(found(with_id)) == 5


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.coalesce(1).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert found(df) == brute([(k, t) for k, t in rows])
    clashing = odd.withColumnsRenamed({"sig": "row", "n_words": "spans", "lang": "_row", "source": "hi"})
    kept = sd.remove_passages(clashing)
    assert kept.count() == odd.count() and kept.columns == clashing.columns
    assert sd.repeated_passages(clashing).count() == sd.repeated_passages(odd).count()
    assert sd.repeated_passages(empty).count() == 0 and sd.remove_passages(empty).count() == 0
