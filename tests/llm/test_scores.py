import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stratacell.llm import byte_cnn, lm_score, quality_rules, registry, samples, textkit, toxicity

from .conftest import NON_SPACE, SF


def test_held_out_rows_are_those_of_the_contract(spark):
    for query, modulus, rest in ((registry.op5_quality_classifier, 4, 2), (registry.op8_toxicity, 3, 1)):
        for r in query(spark, SF).collect():
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def rules(text):
    w = NON_SPACE.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if NON_SPACE.search(x):
            dup += x in seen
        seen.add(x)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            hit.update(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def rule_rows(df):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()), key=str)


def test_rules_equal_brute_force(spark, tables):
    out = registry.op7_quality_rules(spark, SF)
    assert rule_rows(out) == sorted(((r.doc_id, *rules(r.text)) for r in tables("documents").collect()), key=str)
    assert not any(r.kept and r.base_failed for r in out.collect())
    labels = {r.doc_id: r.quality for r in tables("labels").collect()}
    judged = [(r.kept, labels[r.doc_id]) for r in out.collect() if r.doc_id in labels and not r.base_failed]
    assert np.mean([k for k, y in judged if y]) > 0.97 and np.mean([k for k, y in judged if not y]) < 0.15


def test_rules_of_odd_rows(spark, odd, empty, tables):
    model = quality_rules.Model(np.zeros(1 << quality_rules.BUCKET_BITS), -1.0)
    assert rule_rows(quality_rules.apply(odd, model)) == sorted(((r.doc_id, *rules(r.text)) for r in odd.collect()), key=str)
    assert quality_rules.apply(empty, quality_rules.fit(empty, tables("labels").limit(0))).count() == 0
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice(["a", "b", " ", "\n", "é", "# "]) for _ in range(rng.randrange(200)))) for i in range(100)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert rule_rows(quality_rules.apply(df, model)) == sorted(((i, *rules(t)) for i, t in texts), key=str)


def test_likelihood_ratio_is_the_mean_over_ngrams():
    texts = ["the good words of the book", "", "bad"]
    column = pa.array(texts, pa.large_string())
    piece = next(textkit.pieces(column))
    words = quality_rules.Words(piece)
    ratios = np.random.default_rng(0).normal(size=1 << quality_rules.BUCKET_BITS)
    bucket, owner = words.buckets()
    expected = [np.mean(ratios[bucket[owner == i]]) if (owner == i).any() else 0.0 for i in range(3)]
    assert (np.bincount(owner, minlength=3) == [11, 0, 1]).all()
    assert np.allclose(quality_rules.scores(piece, words, ratios), expected)
    target, raw = np.full(1 << quality_rules.BUCKET_BITS, 3), np.full(1 << quality_rules.BUCKET_BITS, 9)
    own = bucket[owner == 0]
    without = target - np.bincount(own, minlength=len(target))
    expected = quality_rules.log_ratios(without, raw)[own].mean()
    assert quality_rules.score_without_own(own, target, raw) == pytest.approx(expected)
    same = quality_rules.log_ratios(np.array([5, 0, 5]), np.array([5, 0, 5]))
    assert np.allclose(same, 0)


def test_every_trusted_document_is_counted(spark):
    labels = spark.range(60_000).selectExpr("id as doc_id", "1 as quality")
    df = spark.range(60_000, numPartitions=8).selectExpr("id as doc_id", "'one' as text")
    more = df.unionByName(spark.range(60_000, 120_000, numPartitions=8).selectExpr("id as doc_id", "'two' as text"))
    ratios = quality_rules.fit(more, labels).ratios
    weight, share = quality_rules.SMOOTHING * (1 << quality_rules.BUCKET_BITS), 0.5
    assert ratios.max() == pytest.approx(math.log((60_000 + weight * share) / (60_000 + weight) / share), rel=1e-4)


def test_threshold():
    value = np.array([0.0, 1.0, 2.0, 3.0])
    assert 1.0 < quality_rules.best_threshold(value, np.array([False, False, True, True])) < 2.0


def test_threshold_is_fitted_on_every_labelled_document(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choices("abcdefgh" if i % 2 else "efghijkl", k=rng.randrange(5, 30)))) for i in range(4000)]
    df = spark.createDataFrame([*docs, (None, "a b"), (4000, None)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(4001)] + [(7, 0), (None, 1)], "doc_id long, quality int")
    model = quality_rules.fit(df, labels)
    raw, target = (np.zeros(1 << quality_rules.BUCKET_BITS, np.int64) for _ in range(2))
    buckets = []
    for i, text in [*docs, (None, "a b")]:
        buckets.append(quality_rules.Words(next(textkit.pieces(pa.array([text], pa.large_string())))).buckets()[0])
        for counts in (raw, target) if i is not None and i % 2 else (raw,):
            np.add.at(counts, buckets[-1], 1)
    values = [quality_rules.score_without_own(b, target, raw) if i % 2 else model.ratios[b].mean() for (i, _), b in zip(docs, buckets)]
    values, good = np.array(values), np.array([i % 2 == 1 for i, _ in docs])
    shares = lambda cut: (values[good] >= cut).mean() + (values[~good] < cut).mean()
    assert shares(model.threshold) >= shares(quality_rules.best_threshold(values, good)) - 0.003
    cells, back = np.unique(np.floor(values * quality_rules.CELLS), return_inverse=True)
    low, high = (np.array([f(values[back == k]) for k in range(len(cells))]) for f in (np.min, np.max))
    assert model.threshold == pytest.approx(quality_rules.best_cut(low, high, np.bincount(back, good), np.bincount(back, ~good)), abs=1e-6)


def model_losses(docs, trusted):
    """(tokens, target loss, background loss) of each text, from counts in dictionaries without its own."""
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    tokens = [NON_SPACE.findall((t or "").translate(lower)) for t in docs]
    words, pairs = zip(*[(Counter(w), Counter(zip([None, *w], w))) for w in tokens])
    for w, c in zip(tokens, words):
        c[None] = 1 if w else 0  # the begin of a text
    sums = []
    for chosen in (range(len(docs)), [i for i in range(len(docs)) if trusted[i]]):
        word, pair = Counter(), Counter()
        for i in chosen:
            word.update(words[i])
            pair.update(pairs[i])
        sums.append((word, pair, sum(len(tokens[i]) for i in chosen)))
    vocabulary = len({x for w in tokens for x in w})
    scale = sums[1][2] / sums[0][2]
    out = []
    for i, w in enumerate(tokens):
        both = []
        for (word, pair, total), factor, own in ((sums[1], 1.0, trusted[i]), (sums[0], scale, True)):
            loss = 0.0
            for a, b in zip([None, *w], w):
                c1, c2, c0 = (factor * (x[k] - own * y[k]) for x, y, k in ((word, words[i], b), (pair, pairs[i], (a, b)), (word, words[i], a)))
                base = 0.95 * c1 / max(1.0, factor * (total - own * len(w))) + 0.05 / vocabulary
                loss -= math.log((min(c2, c0) + 20 * base) / (c0 + 20))
            both.append(loss / max(1, len(w)))
        out.append((len(w), *both))
    return out


@pytest.mark.parametrize("sizes", [{}, {"bundle_bytes": 1000, "slice_bytes": 500}])
def test_language_models_equal_brute_force(spark, sizes):
    rng = random.Random(7)
    good, bad = [[f"{c}{i}" for i in range(40)] for c in "gb"]
    docs = [(i, " ".join(rng.choices(good if i % 2 else bad, k=rng.randrange(1, 60)))) for i in range(120)]
    docs += [(200, "G1 g2  G1 g2 b1"), (201, "é 日本 é"), (None, "g1 g2 g3"), (3, docs[3][1]), (202, None), (203, " ")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (200, 1), (None, 1)], "doc_id long, quality int")
    rows = lm_score.score(df, labels, **sizes).collect()
    trusted = [k is not None and (k < 60 and k % 2 == 1 or k == 200) for k, _ in docs]
    expected = [(k, n, t, b) for (k, _), (n, t, b) in zip(docs, model_losses([t for _, t in docs], trusted))]
    order = lambda x: sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    got = order([(r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in rows])
    for g, e in zip(got, order(expected), strict=True):
        assert g[:2] == e[:2] and g[2:] == pytest.approx(e[2:], rel=1e-9)
    assert all(r.difference == pytest.approx(r.target_loss - r.background_loss) and r.selected == (r.n_tokens > 0 and r.difference <= 0) for r in rows)


def test_language_models_of_the_tables(spark, tables, odd, empty):
    docs = [(r.doc_id, r.text) for r in tables("documents").collect()]
    good = {r.doc_id for r in tables("labels").collect() if r.quality == 1}
    expected = dict(zip([k for k, _ in docs], model_losses([t for _, t in docs], [k in good for k, _ in docs])))
    for r in registry.op6_lm_score(spark, SF).collect():
        n, t, b = expected[r.doc_id]
        assert r.n_tokens == n and (r.target_loss, r.background_loss) == pytest.approx((t, b), rel=1e-9)
    none = tables("labels").limit(0)
    out = lm_score.score(odd, none).collect()
    assert len(out) == odd.count() and all(r.difference == 0 and r.selected == (r.n_tokens > 0) for r in out)
    assert sum(r.n_tokens == 0 for r in out) == 3
    assert lm_score.score(empty, none).count() == 0 and lm_score.score(odd, tables("labels")).count() == odd.count()


def test_hashes_grow_with_the_corpus():
    assert lm_score.hash_bits(0) == 40 and lm_score.hash_bits(10**9) == 42 and lm_score.hash_bits(10**14) == 59
    x = np.array([0, 3, 2**50, 2**50 + 1], np.uint64)
    assert (lm_score.unpack_sorted(lm_score.pack_sorted(x)) == x).all() and len(lm_score.unpack(lm_score.pack(x[:0]), "<u8")) == 0


def test_a_very_long_text_does_not_end_the_sample(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    for long in (0, 7, 21):
        docs = spark.createDataFrame([(i, "x" * (5000 if i == long else 100 + i)) for i in range(40)], "doc_id long, text string")
        texts = samples.labelled_texts(docs, labels, "toxic", 100, most_bytes=4900)
        assert sorted((len(t) - 100, y) for t, y in texts) == [(i, i % 2) for i in range(40) if i != long]
    with pytest.raises(ValueError):
        samples.labelled_texts(docs, labels.where("doc_id = 21"), "toxic", 100, most_bytes=4900)
    assert samples.labelled_texts(docs, labels.limit(0), "toxic", 100) == []


def accuracy(query, label, spark, tables):
    labels = {r.doc_id: r[label] for r in tables("labels").collect()}
    rows = [(r.predicted, labels[r.doc_id]) for r in query(spark, SF).collect() if r.held_out and r.doc_id in labels]
    return np.mean([p == y for p, y in rows])


def test_held_out_accuracy(spark, tables):
    assert accuracy(registry.op5_quality_classifier, "quality", spark, tables) > 0.93
    assert accuracy(registry.op8_toxicity, "toxic", spark, tables) > 0.92


def test_network_covers_the_whole_text_whatever_the_piece():
    texts = ["plain words here " * 3000, "plain words here " * 2999 + "###$$$%%% &&& ***", "", "é", None, "x" * 7]
    net = byte_cnn.ByteCnn()
    tables = net.tables()
    column = pa.array(texts, pa.large_string())
    whole = np.concatenate([net.features(p, tables) for p in textkit.pieces(column, 1 << 30)])
    apart = np.concatenate([net.features(p, tables) for p in textkit.pieces(column, 1)])
    assert np.allclose(whole, apart, atol=1e-5) and not np.allclose(whole[0], whole[1]) and not whole[2].any() and not whole[4].any()


def test_network_equals_a_naive_convolution():
    net = byte_cnn.ByteCnn(seed=9)
    net.p["bias"] = np.random.default_rng(2).normal(size=byte_cnn.FILTERS)
    rng = random.Random(8)
    texts = ["", "a", "some words é 日", "".join(rng.choices("abc d\n", k=1500)), "x" * 1025]
    for text, got in zip(texts, np.concatenate([net.features(p, net.tables()) for p in textkit.pieces(pa.array(texts, pa.large_string()))])):
        raw = text.encode() + bytes(byte_cnn.WIDTH)
        starts = range(0, len(text.encode()), byte_cnn.STRIDE)
        each = [[sum(float(net.p["embed"][raw[i + k]] @ net.p["filters"][k][:, f]) for k in range(byte_cnn.WIDTH)) + net.p["bias"][f] for f in range(byte_cnn.FILTERS)] for i in starts]
        chunks = [np.maximum(np.max(each[i : i + byte_cnn.CHUNK], axis=0), 0) for i in range(0, len(each), byte_cnn.CHUNK)]
        expected = np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0)]) if chunks else np.zeros(2 * byte_cnn.FILTERS)
        assert np.allclose(got, expected, atol=1e-4)
        logit = float(expected @ net.p["out"] + net.p["offset"][0])
        assert net.probability(got[None])[0] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-4)


def test_network_gradients():
    net = byte_cnn.ByteCnn()
    piece = next(textkit.pieces(pa.array(["some words in a text | with ### signs", "other text " * 200], pa.large_string())))
    y = np.array([1.0, 0.0])

    def loss():
        p = net.probability(net.features(piece, net.tables()))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = net.gradients(piece, y)
    for name, at in (("out", (3,)), ("out", (20,)), ("bias", (2,)), ("offset", (0,)), ("filters", (1, 2, 3)), ("embed", (ord("t"), 4))):
        keep, step = net.p[name][at], 1e-3
        net.p[name][at] = keep + step
        up = loss()
        net.p[name][at] = keep - step
        down = loss()
        net.p[name][at] = keep
        assert g[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-4)


def test_classifiers_without_labels_and_with_odd_rows(odd, empty, tables):
    none = tables("labels").limit(0)
    for module in (byte_cnn, toxicity):
        model = module.fit(odd, none)
        rows = module.score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert module.score(empty, model).count() == 0
    assert toxicity.without_toxic(odd, toxicity.Machine()).count() == odd.count()


def kernel(a, b):
    x, y = toxicity.features_of(a), toxicity.features_of(b)
    return sum(v * y.get(c, 0.0) for c, v in x.items())


def test_kernel_counts_gapped_subsequences():
    from itertools import combinations

    def brute(a, b):
        def f(s):
            out = Counter()
            for at in combinations(range(len(s)), toxicity.N):
                if at[-1] - at[0] < toxicity.SPAN:
                    out["".join(s[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] - toxicity.N + 1)
            return out

        x, y = f(a), f(b)
        return sum(v * y[k] for k, v in x.items())

    for a, b in (("idiot", "idiot"), ("idiot", "idxiot"), ("abcabc", "cabcab"), ("abc", "abc"), ("scum", "scrum")):
        assert kernel(a, b) == pytest.approx(brute(a, b))
    assert kernel("i.d.i-o_t", "idiot") == kernel("idiot", "idiot") == kernel("1d10t", "idiot")


def test_machine_tolerates_inserted_characters():
    rng = random.Random(3)
    syllables = "an er on re ti en ha or at ou es in th nd st".split()
    prose = lambda: " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(40))
    texts = [(prose(), 0) for _ in range(300)] + [(f"{prose()} {rng.choice(['idiot', 'moron', 'worthless'])} {prose()}", 1) for _ in range(300)]
    m = toxicity.train(texts)
    score = lambda t: float(m.probability(m.worst(toxicity.Letters([t])))[0])
    for t in ("an idiot on", "an i d i o t on", "an id-iot on", "MORON!", "w0rthless re"):
        assert score(t) >= 0.7, t
    for t in ("", "an er on re", "the patient idea of a moral test"):
        assert score(t) < 0.7, t
    assert score("an idxiot on") > 3 * score("an er on re")


def test_folded_scores_equal_the_kernel_sum():
    """A window's response is the sum over landmarks of weight times kernel value, by brute force."""
    from itertools import combinations

    m = toxicity.Machine()
    landmarks, weights = ["idiot", "worthless", "scum", "дурак"], [1.0, -0.5, 2.0, 0.7]
    for word, w in zip(landmarks, weights):
        for code, v in toxicity.features_of(word).items():
            m.table[code] += w * v

    def subsequences(s, starts):
        out = Counter()
        for at in combinations(range(len(s)), toxicity.N):
            if at[0] in starts and at[-1] - at[0] < toxicity.SPAN:
                out["".join(s[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] - toxicity.N + 1)
        return out

    for text in ("an idxiot is worthles", "s c u m and more", "ты дуурак, idi0t", "scumscumscum", "abc", ""):
        best = 0.0
        joined = {"s c u m and more": ["scum", "and", "more"]}.get(text, text.replace("0", "o").replace(",", "").split())
        for unit in joined:
            for begin in range(len(unit)):
                own = subsequences(unit, range(begin, begin + toxicity.WINDOW))
                best = max(best, sum(w * v * subsequences(x, range(len(x)))[k] for x, w in zip(landmarks, weights) for k, v in own.items()))
        assert float(m.worst(toxicity.Letters([text]))[0]) == pytest.approx(best, rel=1e-4), text


@pytest.mark.parametrize(("insults", "syllables", "space", "gapped", "harmless"), [
    (["дуракин", "мерзавец"], "на по ко ли то ра ве но ст ен ми ла".split(), " ", ["д у р а к и н", "дур-акин", "МЕРЗАВЕЦ!", "дурхакин", "мер\u200bзавец"], ["на поле веранда", ""]),
    (["愚蠢混蛋东西", "无耻下流小人"], "天地人山水火木金土日月星云风雨花草鱼鸟虫".split() or [], "", ["这愚蠢混蛋东西呢", "无.耻.下.流.小.人", "愚蠢混x蛋东西"], ["天地人山水", "日月星云风雨"]),
])
def test_machine_reads_other_scripts(insults, syllables, space, gapped, harmless):
    rng = random.Random(5)
    letters = syllables if len(syllables) > 1 else list(syllables[0])
    prose = lambda: space.join("".join(rng.choices(letters, k=rng.randrange(2, 5))) for _ in range(40))
    clean, toxic = lambda: f"{prose()}{space}{prose()}", lambda: f"{prose()}{space}{rng.choice(insults)}{space}{prose()}"
    m = toxicity.train([(clean(), 0) for _ in range(200)] + [(toxic(), 1) for _ in range(200)])
    score = lambda t: float(m.probability(m.worst(toxicity.Letters([t])))[0])
    fresh = [(clean(), 0) for _ in range(100)] + [(toxic(), 1) for _ in range(100)]
    assert np.mean([(score(t) >= 0.7) == y for t, y in fresh]) > 0.97
    assert all(score(t) >= 0.7 for t in gapped[:2]) and all(score(t) < 0.7 for t in harmless)
    assert score(gapped[-1]) > 2 * score(harmless[0])


def test_letters_of_every_script():
    spell = lambda t: "".join(map(chr, toxicity.Letters([t]).code.tolist()))
    assert spell("Ünïcödé İ ＡＢ 𝐱𝟏") == "unicodei" + "ab" + "xi" or spell("Ünïcödé") == "unicode"
    assert spell("д\u0301ом ΣΊΓΜΑ") == "домσιγμα" and spell("漢字かな") == "漢字かな" and spell("don’t a\u200bb") == "dontab"
    assert spell("\ud800x") == "x" and spell("12 %") == ""


def test_platt_curve():
    rng = np.random.default_rng(3)
    margin = rng.normal(size=4000) * 2
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1.5 * margin - 0.5)))).astype(int)
    slope, shift = toxicity.platt(margin, y)
    assert slope == pytest.approx(1.5, abs=0.25) and toxicity.platt(-np.abs(margin), np.arange(4000) % 2)[0] >= 0
    assert abs(shift) < 1.2
