import math
import random

import duckdb
import numpy as np
import pytest

from pagemill.llm import _text, decontaminate, language_id, lm_scoring, ngram_join, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lowered string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "x") for i, t, lang in rows], SCHEMA)


def words(text):
    import re

    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def gram_set(text, n=3):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_pairs(rows, t):
    sets = {}
    for i, text, _ in rows:
        if i is not None and gram_set(text):
            sets[i] = sets.get(i, set()) | gram_set(text)
    out = {}
    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and n / len(sets[a] | sets[b]) >= t - 1e-12:
                out[a, b] = n
    return out


@pytest.fixture(scope="module")
def near(spark):
    rng = random.Random(2)
    vocabulary = [f"word{k}" for k in range(60)]
    rows = []
    for k in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 80))]
        rows.append((10 * k, " ".join(base), "en"))
        for c in range(rng.randint(0, 4)):
            other = list(base)
            for _ in range(rng.randint(0, 4)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            rows.append((10 * k + c + 1, " ".join(other).upper() if c == 1 else " ".join(other), "en"))
    rows += [(1000, None, None), (1001, "", None), (1002, "?!", None), (1003, "one two", None), (1004, "one two", None), (None, "one two", None), (1003, "one two", None), (1005, "Straße in Köln am Rhein", None), (1006, "straße in köln am rhein", None), (2000, "loop and loop again " * 40000, None), (2001, "loop and loop again " * 30000, None)]
    return rows, docs(spark, rows)


def components(edges):
    out = {}
    for a, b in edges:
        group = (out.get(a) or {a}) | (out.get(b) or {b})
        for x in group:
            out[x] = group
    return {x: min(g) for x, g in out.items()}


@pytest.fixture(params=[{}, {"BLOCK_DOCS": 2, "FRAGMENT": 50}], ids=["as it is", "small blocks"])
def sizes(request, monkeypatch):
    for name, value in request.param.items():
        monkeypatch.setattr(ngram_join, name, value)


@pytest.mark.parametrize("t", [0.5, 0.8, 1.0])
@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_join_matches_brute_force(near, sizes, t, limit):
    rows, df = near
    found, copies = ngram_join.pairs(df, t, send_limit=limit)
    of = {}
    for r in copies.collect():
        of.setdefault(r.rep, []).append(r.doc_id)
    got = [tuple(r)[:3] for r in found.collect()]
    assert len(got) == len({g[:2] for g in got})
    want = brute_pairs(rows, t)
    spread = {(min(x, y), max(x, y)): n for a, b, n in got for x in [a, *of.get(a, [])] for y in [b, *of.get(b, [])]}
    within = {(min(x, y), max(x, y)) for a, more in of.items() for x in [a, *more] for y in [a, *more] if x != y}
    assert not within & set(spread) and spread | {p: want[p] for p in within} == want


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_links_are_components_and_degrees(near, sizes, limit):
    rows, df = near
    want = brute_pairs(rows, 0.5)
    degree = {}
    for p in want:
        for x in p:
            degree[x] = degree.get(x, 0) + 1
    label = components(want)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.links(df, send_limit=limit).collect()}
    assert got == {x: (label[x], degree[x]) for x in degree}


@pytest.mark.parametrize("block", [40, 90, 2048])
def test_large_cells_meet_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)  # 90 and 2048: counted by matrices, in blocks and alone
    rng = random.Random(8)
    base = [f"b{k}" for k in range(60)]
    rows = [(k, " ".join(w if rng.random() > 0.04 else f"x{rng.randrange(99)}" for w in base), None) for k in range(150)]
    rows += [(200 + k, rows[k % 3][1], None) for k in range(9)]
    want = brute_pairs(rows, 0.5)
    got = {r.doc_id: r.n_links for r in ngram_join.links(docs(spark, rows)).collect()}
    assert got == {x: sum(x in p for p in want) for x in {d for p in want for d in p}}


def test_join_of_nothing(spark):
    assert ngram_join.links(docs(spark, [])).count() == 0
    assert ngram_join.links(docs(spark, [(1, None, None), (2, "a b c d", None)])).count() == 0
    assert ngram_join.pairs(docs(spark, [(-5, "a b", None), (7, "a b", None), (None, "a b", None)]))[1].collect() == [(7, -5)]


def item(rng, n):
    return " ".join(rng.choice("abcdefghijklmnop") * rng.randint(2, 6) + str(rng.randint(0, 30)) for _ in range(n))


def brute_similarity(a, b):
    """Weighted Jaccard of the word-pair multisets."""
    from collections import Counter

    def bag(w):
        return Counter(zip(w, w[1:]))

    x, y = bag(a), bag(b)
    weight = lambda p: len(p[0].encode()) + len(p[1].encode())
    low = sum(weight(p) * min(x[p], y[p]) for p in x)
    high = sum(weight(p) * max(x[p], y[p]) for p in x | y)
    return low / high if high else 0.0


def test_decontamination_finds_copies_and_close_edits(spark):
    rng = random.Random(4)
    items = [(k, item(rng, rng.randint(10, 60))) for k in range(25)]
    rows, leaking = [], {}
    for k, text in items:
        w = text.split()
        for v in range(3):
            x = list(w)
            if v:
                x[rng.randrange(len(x))] = "changed"
            host = item(rng, 200).split()
            at = rng.randint(0, 200)
            rows.append((100 * k + v, " ".join(host[:at] + x + host[at:]).title(), "en"))
            leaking[100 * k + v] = (k, brute_similarity(w, x))
        rows.append((100 * k + 9, item(rng, 300), "en"))
    bench = spark.createDataFrame([*items, (90, None), (91, "too short"), (None, "x")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs(spark, rows), bench).collect()}
    exact = {d for d, (k, s) in leaking.items() if s == 1}
    assert {d for d, _ in got} <= set(leaking) and exact <= {d for d, _ in got}
    missed = [d for d, (k, s) in leaking.items() if s >= 0.8 and (d, k) not in got]
    assert len(missed) <= 0.1 * len(leaking), missed
    for (d, k), s in got.items():
        assert k == leaking[d][0] and s == pytest.approx(leaking[d][1], abs=0.35)
    kept = decontaminate.remove_leaks(docs(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in got} and kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def test_decontamination_finds_every_copy_at_the_threshold(spark):
    rng = random.Random(14)
    lengths = [8, 10, 11, 15, 20, 27, 36, 48, 64]
    items = [(k, item(rng, n)) for k, n in enumerate(n for n in lengths for _ in range(6))]
    rows, want = [], {}
    for k, text in items:
        w = text.split()
        for v in range(12):
            x = list(w)
            for _ in range(rng.randint(1, max(1, len(w) // 6))):
                at, kind = rng.randrange(len(x)), rng.randint(0, 2)
                x[at : at + 1] = [["changed"], ["put", "in"], []][kind]
            host = item(rng, 60).split()
            at = rng.choice([0, 30, 60])
            whole = [] if v == 11 else host
            y = whole[:at] + x + whole[at:]
            best = max(brute_similarity(w, y[f : f + len(w)]) for f in range(max(1, len(y) - len(w) + 1)))
            rows.append((100 * k + v, " ".join(y), "en"))
            want[100 * k + v, k] = (len(w), best)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs(spark, rows), bench).collect()}
    assert set(got) == {x for x, (_, s) in want.items() if s >= 0.6}
    assert all(s == pytest.approx(want[x][1]) for x, s in got.items())
    for low in (0.6, 0.7, 0.8, 0.9):  # every band is there, and 0.6 for every length
        assert sum(low <= s < low + 0.1 for _, s in want.values()) > 10
    assert {n for n, s in want.values() if 0.6 <= s < 0.8} >= set(lengths[2:])


def test_hamming_blocks_find_all_within_radius():
    rng = np.random.default_rng(6)
    prints = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    radius = 9
    near = prints.copy()
    for k in range(len(near)):
        for b in rng.choice(64, rng.integers(0, radius + 1), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    c = decontaminate._Class(10, [(k, 0, int(p)) for k, p in enumerate(prints)], radius)
    at, anchor = c.search(near, radius)
    want = {(w, a) for w in range(40) for a in range(40) if bin(int(near[w]) ^ int(prints[a])).count("1") <= radius}
    assert set(zip(at.tolist(), anchor.tolist())) == want


def test_fingerprints_by_definition():
    h = np.random.default_rng(7).integers(0, 1 << 63, 50, dtype=np.uint64)
    g = decontaminate._pairs(h)
    got = decontaminate.fingerprints(h, 12)
    bits = np.unpackbits(g.view(np.uint8)).reshape(-1, 64)
    want = [np.packbits(bits[i : i + 11].sum(0) > 5).view(np.uint64)[0] for i in range(len(h) - 11)]
    assert got.tolist() == [int(w) for w in want]


def test_decontamination_of_odd_tables(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(12)))], "item_id long, text string")
    rows = [(1, None, None), (2, "", None), (None, " ".join(f"w{k}" for k in range(12)), None), (3, "filler text " * 60000 + " ".join(f"w{k}" for k in range(12)), None), (3, " ".join(f"w{k}" for k in range(12)), None)]
    df = docs(spark, rows)
    assert sorted((r.doc_id or 0) for r in decontaminate.leaks(df, bench).collect()) == [0, 3, 3]
    assert {r.doc_id for r in decontaminate.remove_leaks(df, bench).collect()} == {1, 2}
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0 and decontaminate.remove_leaks(df, bench.limit(0)).count() == 5
    assert decontaminate.leaks(df.limit(0), bench).count() == 0


SENTENCES = {"en": "the house is on the hill and people walk there with their dogs when it rains", "de": "das haus steht auf dem berg und die leute gehen dort mit ihren hunden wenn es regnet", "fr": "la maison est sur la colline et les gens marchent avec leurs chiens quand il pleut"}


def corpus(n=90):
    rng = random.Random(8)
    out = []
    for k in range(n):
        lang = sorted(SENTENCES)[k % 3]
        w = SENTENCES[lang].split()
        out.append((k, " ".join(rng.choice(w) for _ in range(60)), lang))
    return out


def test_language_id_held_out_accuracy(spark):
    model = language_id.fit(docs(spark, corpus()), most_docs=60)
    rows = language_id.identify(docs(spark, corpus(150)[90:]), model).collect()
    want = {i: lang for i, _, lang in corpus(150)[90:]}
    assert sum(r.language == want[r.doc_id] and r.accepted for r in rows) >= 0.95 * len(rows)


def test_language_id_of_odd_texts(spark):
    model = language_id.fit(docs(spark, corpus()))
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 456 ?!", "en"), (None, SENTENCES["de"], None), (4, (SENTENCES["fr"] + " ") * 3000, None), (4, (SENTENCES["fr"] + " ") * 3000, None)]
    got = {(r.doc_id, r.language, r.accepted) for r in language_id.identify(docs(spark, rows), model).collect()}
    assert got == {(1, None, False), (2, None, False), (3, None, False), (None, "de", True), (4, "fr", True)}
    kept = language_id.keep_identified(docs(spark, rows), model)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 4] and kept.columns == docs(spark, []).columns
    assert language_id.identify(docs(spark, []), model).count() == 0
    none = language_id.fit(docs(spark, [(1, "x y", None)]))
    assert not any(r.accepted for r in language_id.identify(docs(spark, rows), none).collect())


def test_sums_by_definition():
    rng = np.random.default_rng(1)
    table = rng.standard_normal((language_id.ROWS + 1, 3)).astype(np.float32)
    table[-1] = 0
    texts = [b"", b"ab", b"a b  c", "größe straße".encode(), b"x" * 70000]
    buf, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    total, count = language_id.sums(buf, bounds, table)
    for k, t in enumerate(texts):
        one, n = language_id.sums(np.frombuffer(t, np.uint8), np.array([0, len(t)]), table)
        assert np.allclose(total[k], one[0], atol=1e-2 * max(1, abs(one).max())) and count[k] == n[0]


def test_lm_prefers_what_it_learnt(spark):
    rng = random.Random(11)
    follow = {a: rng.sample(range(30), 2) for a in range(30)}

    def chain(n):
        out = [rng.randrange(30)]
        while len(out) < n:
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(f"tok{x}" for x in out)

    good = [(k, chain(1500), "en") for k in range(300)]
    bad = [(1000 + k, " ".join(rng.sample(chain(1500).split(), 1500)), "en") for k in range(20)]
    rows = lm_scoring.score(docs(spark, good + bad + [(2000, None, None), (2001, "", None), (None, chain(50), None)])).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 323 and by[2000].n_tokens == 0 and by[2001].mean_log_prob is None and by[None].n_tokens == 50
    assert min(by[k].mean_log_prob for k in range(300)) > max(by[1000 + k].mean_log_prob for k in range(20))
    assert all(r.log_prob == pytest.approx(r.n_tokens * (r.mean_log_prob or 0)) for r in rows)


def test_decontamination_finds_short_items_as_copies(spark):
    items = [(1, "Yes"), (2, "the capital of France"), (3, "the capital of Spain"), (4, "x y"), (5, "x y"), (6, "!")]
    rows = [(10, "So the capital, of FRANCE is Paris; the capital of France", "en"), (11, "yes", "en"), (12, "capital of France the", "en"), (13, "x", "en"), (14, "y x y", "en"), (15, None, "en"), (16, "x y", "en")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start_word, r.n_words, r.similarity) for r in decontaminate.leaks(docs(spark, rows), bench).collect())
    assert got == [(10, 2, 1, 4, 1.0), (11, 1, 0, 1, 1.0), (14, 4, 1, 2, 1.0), (14, 5, 1, 2, 1.0), (16, 4, 0, 2, 1.0), (16, 5, 0, 2, 1.0)]
    assert sorted(r.doc_id for r in decontaminate.remove_leaks(docs(spark, rows), bench).collect()) == [12, 13, 15]


def test_languages_are_learnt_without_ids(spark):
    rows = [(None, f"{w} " * 30 + str(k), lang) for k in range(150) for w, lang in (("hello", "en"), ("bonjour", "fr"))]
    assert language_id.fit(docs(spark, rows), most_docs=100).languages == ["en", "fr"]


def vocabulary_of(count, rare=(0, 0)):
    words = np.random.default_rng(6).integers(0, 1 << 63, len(count), dtype=np.uint64)
    return words, lm_scoring.Vocabulary.of(words, np.array(count), *rare)


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    words, v = vocabulary_of(rng.integers(1, 50, 20000), (100, 130))
    _, kind, within = v.find(words)
    assert np.allclose(np.bincount(kind, np.exp(within), lm_scoring.CLASSES)[:-1], 1, atol=1e-3) and v.prior.sum() == pytest.approx(1)
    _, kind, within = v.find(np.array([5], np.uint64))
    assert kind[0] == lm_scoring.CLASSES - 1 and np.exp(within[0]) == pytest.approx(0.01)
    net = lm_scoring.Network(v.prior)
    rows = lm_scoring._rows(rng.integers(0, lm_scoring.BUCKETS, 7), np.array([0, 7]))
    total = sum(np.exp(net.log_probs(rows, np.full(7, c))) for c in range(lm_scoring.CLASSES))
    assert np.allclose(total, 1, atol=1e-4)


def test_lm_gradient_by_differences():
    rng = np.random.default_rng(4)
    words, v = vocabulary_of([1] * 5000)
    ids, target, _ = v.find(words[rng.integers(0, 40, 300)])
    rows = lm_scoring._rows(ids, np.array([0, 300]))
    net = lm_scoring.Network(v.prior)
    before = net.log_probs(rows, target).mean()
    for _ in range(20):
        net.learn(rows, target, 0.1)
    assert net.log_probs(rows, target).mean() > before + 0.1


def brute_scores(rows, net, v):
    """The definition, word by word: class and share from the network, occurrences counted in dictionaries."""
    from collections import Counter

    def hashes(text):
        return _text.words(np.frombuffer((text or "").lower().encode(), np.uint8), np.array([0, len((text or "").lower().encode())]))[0].tolist()

    texts = [hashes(text) for _, text, _ in rows]
    of = {}
    for k, (word, n) in enumerate(sorted(Counter(w for t in texts for w in t).items(), key=lambda x: (-x[1], x[0]))):
        of[word] = (k if k < lm_scoring.DIRECT else None, n)
    kinds = dict(zip(of, v.find(np.array(list(of), np.uint64))[1].tolist()))
    share = Counter()
    for word, (_, n) in of.items():
        share[kinds[word]] += n
    sides, whole = Counter(), Counter()
    near = lambda t, i: tuple(t[j] if 0 <= j < len(t) else None for j in (i - 2, i - 1, i + 1, i + 2))
    for t in texts:
        for i, w in enumerate(t):
            sides[near(t, i)] += 1
            whole[near(t, i), w] += 1
    table = net.embed.reshape(4, lm_scoring.BUCKETS + 1, lm_scoring.WIDTH)
    out = []
    for t in texts:
        total = 0.0
        for i, w in enumerate(t):
            hidden = np.tanh(sum(table[p, lm_scoring.BUCKETS if x is None else of[x][0]] for p, x in enumerate(near(t, i))))
            z = np.exp(hidden @ net.layer + net.bias)
            p = z[kinds[w]] / z.sum() * of[w][1] / share[kinds[w]]
            total += math.log((whole[near(t, i), w] - 1 + lm_scoring.STRENGTH * p) / (sides[near(t, i)] - 1 + lm_scoring.STRENGTH))
        out.append(total)
    return out


def test_lm_matches_brute_force(spark):
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(n))
    rows = [(k, text(rng.randint(0, 60)), "en") for k in range(120)]
    rows += [(200, rows[3][1], "en"), (None, rows[4][1], "en"), (3, rows[3][1], "en"), (300, "", "en"), (301, None, "en"), (302, "a b " * 3000, "en")]
    df = docs(spark, rows)
    net, v = lm_scoring.fit(df)
    want = sorted((str(i), n, round(x, 1)) for (i, _, _), n, x in zip(rows, (len(words(t)) for _, t, _ in rows), brute_scores(rows, net, v)))
    got = sorted((str(r.doc_id), r.n_tokens, r.log_prob) for r in lm_scoring.score(df, (net, v)).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert g[2] == pytest.approx(w[2], abs=0.1 + 1e-3 * g[1])


def test_lm_keeps_all_counts_of_rare_words(spark):
    rows = [(k, f"often often rare{k} rare{k + 1}", "en") for k in range(50)]
    net, v = lm_scoring.fit(docs(spark, rows), most_words=10)
    assert len(v.words) <= 10 and v.rare == pytest.approx(-math.log(51 if len(v.words) == 1 else 0), abs=1e-6)
    assert lm_scoring.score(docs(spark, rows), (net, v)).count() == 50


def test_lm_scores_texts_that_come_twice_higher(spark):
    rng = random.Random(13)
    text = lambda: " ".join(f"w{int(rng.paretovariate(0.5)) % 5000}" for _ in range(200))
    rows = [(k, text(), "en") for k in range(200)]
    rows += [(1000 + k, rows[k][1], "en") for k in range(20)]
    by = {r.doc_id: r.mean_log_prob for r in lm_scoring.score(docs(spark, rows)).collect()}
    assert min(by[k] for k in range(20)) > max(by[k] for k in range(20, 200))


def test_lm_of_nothing(spark):
    assert lm_scoring.score(docs(spark, [])).count() == 0
    assert [r.n_tokens for r in lm_scoring.score(docs(spark, [(1, None, None)])).collect()] == [0]


def brute_padding(lengths, buckets):
    import itertools

    different = sorted(set(lengths))
    best = math.inf
    for n in range(1, min(buckets, len(different)) + 1):
        for ends in itertools.combinations(different[:-1], n - 1):
            ends = [*ends, different[-1]]
            best = min(best, sum(min(e for e in ends if e >= x) - x for x in lengths))
    return best


def test_bounds_need_least_padding():
    rng = random.Random(6)
    for _ in range(30):
        lengths = [rng.choice([0, 1, 2, 5, 9, 30, 31, 80, 200, 201, 500]) for _ in range(rng.randint(1, 60))]
        values, count = np.unique(lengths, return_counts=True)
        for buckets in (1, 2, 3, 4):
            ends = packing.bounds(values, count, buckets)
            assert len(ends) <= buckets and ends[-1] == values[-1]
            assert sum(min(e for e in ends if e >= x) - x for x in lengths) == brute_padding(lengths, buckets)


def test_packing_matches_sql_on_odd_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(-40, 300)]), rng.choice([None, "", " \n ", "a " * rng.randint(0, 70)]), "en") for _ in range(400)] + [(1, "w " * 40000, "en")]
    got = packing.pack(docs(spark, rows), 4, 64, 50)
    con = duckdb.connect()
    frame = docs(spark, rows).select("doc_id", "text").toPandas()  # noqa: F841
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    want = con.execute(packing.oracle("frame", 4, 64, 50)).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    for (bound, _, _), n in _batches(got).items():
        assert n * max(1, bound) <= 64 or n == 1
    assert packing.pack(docs(spark, [])).count() == 0


def _batches(df):
    return {(r.bound, r.shard, r.batch): r["count"] for r in df.groupBy("bound", "shard", "batch").count().collect()}


def test_words_cross_pieces():
    text = ("abc déf " * 20000 + "x" * 100000 + " end").encode()
    buf = np.frombuffer(text, np.uint8)
    h, s, e, at = _text.words(buf, np.array([0, len(buf)]))
    assert [text[a:b].decode() for a, b in zip(s, e)] == text.decode().split() and len(set(h.tolist())) == 4
