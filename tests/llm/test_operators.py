import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import cases
from lexquarry.llm import htmltext, imatch, langid, license, mixing, neardup, quality, textnum, urlfilter
from lexquarry.llm.decontam import decontaminate
from lexquarry.llm.graph import components
from lexquarry.llm.neardup import near_duplicates
from lexquarry.llm.substring import intervals, least_of_runs, repeated_substrings
from lexquarry.llm.urlfilter import Trie, filter_urls, split_url


@pytest.fixture(scope="module")
def rows():
    return cases.texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return cases.documents(spark, rows).cache()


def by_id(df, name="doc_id"):
    return {r[name]: r for r in df.collect()}


def test_words_match_the_patterns(rows):
    import pyarrow as pa

    for kind, plain in ((textnum.SPACED, cases.spaced), (textnum.ALNUM_LOWER, cases.alnum), (textnum.SPACED_LOWER, lambda t: cases.spaced(cases.low(t)))):
        seen = {}
        for i, j, data, offsets in textnum.slices(pa.array(rows, pa.string())):
            words = textnum.Words(data, offsets, kind)
            for t, a, b in zip(rows[i:j], words.bounds[:-1], words.bounds[1:], strict=True):
                want = plain(t)
                assert b - a == len(want)
                for h, w in zip(words.hash[a:b].tolist(), want, strict=True):
                    assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_rolling_hash_depends_on_the_window_only():
    h = np.random.default_rng(1).integers(0, 1 << 63, 40, dtype=np.uint64)
    for k in (1, 2, 3, 5, 13, 40):
        whole = textnum.rolling(h, k)
        assert len(whole) == 41 - k
        for i in range(len(whole)):
            assert textnum.rolling(h[i : i + k].copy(), k)[0] == whole[i]
    assert len(textnum.rolling(h, 41)) == 0


def test_window_hashes_are_rabin_karp():
    h = np.random.default_rng(3).integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2)
    prime, base = int(textnum.PRIME), textnum._BASE
    for k in (1, 7, 50, 200, 201):
        plain = [sum(int(x) * pow(base, j, prime) for j, x in enumerate(h[i : i + k])) % prime for i in range(201 - k)]
        assert textnum.rabin_karp(h, k).tolist() == plain
        assert [textnum.check_hash(h[i : i + k].copy(), k)[0] for i in range(201 - k)] == textnum.check_hash(h, k).tolist()


def test_thue_morse_texts_are_told_apart(spark):
    """Words, and sequences of words, that hashes modulo 2**64 of powers of one base can't tell apart."""
    x, y = cases.thue_morse()
    rest = [f"w{i}" for i in range(59)]
    rows = [" ".join([x, *rest]), " ".join([y, *rest]), f"{x} b c", f"{y} b c", f"{y} z"]
    out = by_id(repeated_substrings(cases.documents(spark, rows), carry=("doc_id",), texts=True))
    for i, left in enumerate(cases.cut_repeats(rows, 50)):
        assert out[i]._kept == " ".join(left)
    sizes, least_id = cases.linked(rows, 3, 85, 100)
    out = by_id(near_duplicates(cases.documents(spark, rows), k=3, at_least=(85, 100)))
    assert [(out[i].n_shingles, out[i].component_id) for i in range(len(rows))] == list(zip(sizes, least_id, strict=True))
    items = [("1", x), ("2", f"{x} b c")]
    bench = spark.createDataFrame([(int(a), b) for a, b in items], "item_id long, text string")
    out = by_id(decontaminate(cases.documents(spark, rows), bench, carry=("doc_id",)))
    for i, (n, hit, names) in enumerate(cases.hits(rows, items, 13)):
        assert (out[i]._n_words, out[i]._n_hit, out[i]._n_items) == (n, hit, len(names))
    rows = [" ".join(r.split()) for r in cases.thue_morse("one ", "two ")]
    out = by_id(repeated_substrings(cases.documents(spark, rows), carry=("doc_id",), texts=True))
    for i, left in enumerate(cases.cut_repeats(rows, 50)):
        assert out[i]._kept == " ".join(left)


def test_anchors_are_in_every_run():
    x = np.random.default_rng(2).integers(0, 5, 300).astype(np.uint64)
    at = set(least_of_runs(x, 7).tolist())
    want = {i for s in range(294) for i in range(s, s + 7) if x[i] == x[s : s + 7].min()}
    assert at == want
    a, b = intervals(np.array([3, 4, 20, 70, 9]), 10)
    assert list(zip(a.tolist(), b.tolist())) == [(3, 19), (20, 30), (70, 80)]


@pytest.mark.parametrize(("k", "least"), [(3, (85, 100)), (5, (80, 100))])
def test_near_duplicates_match_all_pairs(docs, rows, k, least):
    out = by_id(near_duplicates(docs, k=k, at_least=least))
    sizes, least_id = cases.linked(rows, k, *least)
    assert len(out) == len(rows)
    for i in range(len(rows)):
        assert (out[i].n_shingles, out[i].component_id, out[i].kept) == (sizes[i], least_id[i], least_id[i] == i), i


def test_shuffled_joins_give_the_same(spark, docs, monkeypatch):
    """The way beyond the broadcast's size, of near-duplicates, substrings and the language sample."""
    from lexquarry.llm import spark as own

    take = lambda: [sorted(near_duplicates(docs, k=3, at_least=(85, 100)).collect()), sorted(repeated_substrings(docs, carry=("doc_id",)).collect()), langid.train(docs).weights.tobytes()]
    one = take()
    monkeypatch.setattr(own, "BROADCAST_BYTES", -1)
    assert take() == one


def test_near_duplicates_of_many_variants(spark):
    """Variants of one text that are alike to its start but less so to each other: buckets of several components."""
    rng = random.Random(8)
    base = cases.sentence(rng, 100).split()
    rows = []
    for _ in range(120):
        v = list(base)
        for _ in range(rng.randint(1, 12)):
            v[rng.randrange(100)] = cases.word(rng)
        rows.append(" ".join(v))
    out = by_id(near_duplicates(cases.documents(spark, rows), k=3, at_least=(85, 100)))
    _, least_id = cases.linked(rows, 3, 85, 100)
    assert len(set(least_id)) > 1
    assert [out[i].component_id for i in range(len(rows))] == least_id


def test_near_duplicates_of_repeated_ids(spark):
    """Rows that share an id and nothing else weld no groups together."""
    rng = random.Random(9)
    a, b = cases.sentence(rng, 60), cases.sentence(rng, 60)
    rows = [f"{a} zz", a, b, f"{b} yy", a, b, a]
    ids = [3, 5, 5, 7, 9, 5, 3]
    out = near_duplicates(cases.documents(spark, rows, ids), k=3, at_least=(85, 100)).collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out)
    sizes, group = cases.linked(rows, 3, 85, 100)
    least = {g: min(i for i, h in zip(ids, group, strict=True) if h == g) for g in group}
    assert got == sorted((i, n, least[g], i == least[g]) for i, n, g in zip(ids, sizes, group, strict=True))


def test_a_bucket_of_many_dissimilar_members(spark, monkeypatch):
    """One band for all: 20,000 texts that share a third of their words meet in one bucket (200 million pairs, if all were compared)."""
    rng = random.Random(10)
    common = cases.sentence(rng, 14)
    rows = [" ".join(f"{rng.randrange(1 << 40):x}" for _ in range(30)) + f" {common}" for _ in range(20000)]
    rows += [f"{rows[i]} {cases.word(rng)}" for i in range(0, 20000, 2000)] * 2
    signed = neardup._signed

    def in_one_band(k, bands, rows):
        plain = signed(k, bands, rows)

        def run(batches):
            for b in plain(batches):
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array([[7]] * b.num_rows, pa.list_(pa.int64()))], b.schema.names)

        return run

    monkeypatch.setattr(neardup, "_signed", in_one_band)
    out = by_id(near_duplicates(cases.documents(spark, rows), k=3, at_least=(85, 100)))
    assert all(out[i].component_id == (i if i < 20000 else (i - 20000) % 10 * 2000) for i in range(len(rows)))


def test_null_and_repeated_ids(spark):
    text = "a b c d e f g h"
    df = cases.documents(spark, [text, text, text, "z y x w v"], [5, None, 5, 9])
    out = near_duplicates(df, k=3).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in out) == [("5", 6, "5", True), ("5", 6, "5", True), ("9", 3, "9", True), ("None", 6, "None", True)]
    long = " ".join(str(i) for i in range(60))
    df = cases.documents(spark, [long, long, long, long], [5, None, 5, 6])
    out = repeated_substrings(df, carry=("doc_id",)).collect()
    assert sorted((str(r.doc_id), r._n_removed) for r in out) == [("5", 0), ("5", 0), ("6", 60), ("None", 0)]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 120)] + [(50, 60), (60, 50), (70, 70)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(1, 31)) and all(out[i] == 100 for i in range(101, 120)) and out[60] == 50 and 70 not in out


def test_substrings_match_brute_force(docs, rows):
    out = by_id(repeated_substrings(docs, carry=("doc_id",), texts=True))
    for i, (t, left) in enumerate(zip(rows, cases.cut_repeats(rows, 50), strict=True)):
        joined = " ".join(left)
        r = out[i]
        assert (r._n_words, r._n_removed, r._kept, r._kept_sha256) == (len(cases.spaced(t)), len(cases.spaced(t)) - len(left), joined, hashlib.sha256(joined.encode()).hexdigest())


def test_contamination_matches_brute_force(spark, docs, rows):
    w = cases.alnum(rows[0])
    items = [("1", " ".join(w[3:40])), ("2", " ".join(w[30:35])), ("3", rows[0].upper()), ("4", ""), ("5", None), ("6", "no such words at all"), ("7", "one"), ("8", " ".join(w[3:40])), ("9", "x x x x x")]
    bench = spark.createDataFrame([(int(a), b, "t") for a, b in items], "item_id long, text string, label string")
    out = by_id(decontaminate(docs, bench, window=13, carry=("doc_id",)))
    for i, (n, hit, names) in enumerate(cases.hits(rows, items, 13)):
        r = out[i]
        assert (r._n_words, r._n_hit, r._n_items, r._items_sha256) == (n, hit, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()), i
        assert r._contaminated == (hit > 0 and 20 * hit >= n)


def test_contamination_is_the_same_however_much_passes(spark, docs, rows, monkeypatch):
    """A bitmap that lets nearly everything pass, and a shuffle instead of the broadcast."""
    from lexquarry.llm import decontam
    from lexquarry.llm import spark as own

    items = [(i, t) for i, t in enumerate(rows) if t][:30]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(decontaminate(docs, bench, carry=("doc_id", "words")).collect())
    for t, (n, hit, names) in zip(rows, cases.hits(rows, [(str(i), t) for i, t in items], 13), strict=True):
        assert any(r._n_words == n and r._n_hit == hit and r._n_items == len(names) for r in one)
    monkeypatch.setattr(decontam, "LEAST_BITS", 6)
    monkeypatch.setattr(decontam, "MOST_BITS", 6)
    monkeypatch.setattr(own, "BROADCAST_BYTES", -1)
    assert sorted(decontaminate(docs, bench, carry=("doc_id", "words")).collect()) == one


def test_contamination_of_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (None, "other"), (5, text), (5, text), (5, "w1 w2"), (6, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, text), (7, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    out = sorted(str(tuple(r)[:4]) for r in decontaminate(df, bench, carry=("doc_id",)).collect())
    assert out == sorted(str(x) for x in [(None, 30, 30, 2), (None, 1, 0, 0), (5, 30, 30, 2), (5, 30, 30, 2), (5, 2, 0, 0), (6, 0, 0, 0)])


URLS = [None, "", "no scheme/x", "http://A.Example.com/en/7/x?q", "https://example.com/en/70", "http://example.net/de/8#f", "http://example.net/de", "http://x.net/de/", "ftp://org/es/", "http://myorg/es/", "http://a.org", "http://", "http://com/en/://x", "http://EXAMPLE.com:80/en/", "x\n://com/en/y", "http://netx.com/en/a/b"]


def test_url_filter_matches_plain_rules(spark, monkeypatch):
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"), ("allow", "org/es/"), ("block", "x.net")]
    trie = Trie(rules)
    for url in URLS:
        host, path = split_url(url)
        fits = [(len(r), r, a) for a, r in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p if "/" in r else "")]
        want = max(fits, key=lambda x: (x[0], x[2] == "block"))[1:] if fits else None
        got = trie.find(host, path)
        assert (got and got[::-1]) == want, url
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    out = by_id(filter_urls(df, rules, carry=("page_id",)), "page_id")
    assert [out[i]._host for i in range(4)] == ["", "", "", "a.example.com"] and out[3]._verdict == "allow" and out[0]._rule is None
    one = sorted(filter_urls(df, rules, carry=("host", "page_id")).collect(), key=str)
    listed = spark.createDataFrame(rules, "action string, rule string")
    assert sorted(filter_urls(df, listed, carry=("host", "page_id")).collect(), key=str) == one
    monkeypatch.setattr(urlfilter, "MAX_RULES", 3)
    for more in (rules, listed):
        assert sorted(filter_urls(df.repartition(3), more, carry=("host", "page_id")).collect(), key=str) == one
    deep = [("block", "x.org/" + "a/" * 3000 + "b")]
    far = spark.createDataFrame([(1, "http://x.org/" + "a/" * 3000 + "bc")], "page_id long, url string")
    assert filter_urls(far, deep).first()._verdict == "block"


def test_quality_sample_is_bounded_by_rows(spark, monkeypatch):
    """Ids that repeat don't bring more rows to the driver than `sample`."""
    seen = []
    fit = quality.Trees.fit
    monkeypatch.setattr(quality.Trees, "fit", staticmethod(lambda x, y: (seen.append(len(x)), fit(x, y))[1]))
    free = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 4 != 2)
    df = spark.range(3000).selectExpr(f"{free}L as doc_id", "concat('some text number ', id) as text")
    marks = spark.createDataFrame([(free, 1), (free, 0), (free, 1)], "doc_id long, quality int")
    quality.train(df, marks, sample=10)
    quality.train(df.limit(7), marks.limit(1), sample=10)
    assert seen == [10, 7]


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(4)
    good = [cases.sentence(rng, rng.randint(20, 80)).capitalize() + "." for _ in range(150)]
    bad = [" | ".join(cases.word(rng) for _ in range(rng.randint(20, 80))) if i % 2 else cases.word(rng) + " " + "spam " * rng.randint(20, 60) for i in range(60)]
    rows = [x for pair in zip(good, bad + bad + bad, strict=False) for x in pair] + [None, "", "a"]
    df = cases.documents(spark, rows)
    marks = spark.createDataFrame([(i, i % 2 == 0 and 1 or 0, None) for i in range(len(rows) - 3)] + [(None, 1, None), (3, None, None)], "doc_id long, quality int, text string")
    model = quality.train(df, marks)
    out = by_id(quality.score_quality(df, model, carry=("doc_id",)))
    held = [i for i in range(len(rows) - 3) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(out[i]._score >= 0.7) == (i % 2 == 0) for i in held]) > 0.95
    assert all(0 <= out[i]._score <= 1 for i in out) and len(out) == len(rows)
    assert quality.train(df, marks.limit(0)).score(np.zeros((2, len(quality.NAMES)))).tolist() == [0.5, 0.5]


def test_languages_are_told_apart(spark):
    rng = random.Random(5)
    names = list(cases.LETTERS)
    rows = [cases.sentence(rng, rng.randint(30, 60), names[i % 4]) for i in range(240)]
    data = [(i, t, names[i % 4] if i % 7 else None) for i, t in enumerate(rows)] + [(900, None, "en"), (901, "", "en"), (902, "12 %", "en")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.train(df)
    out = by_id(langid.identify(df, model, carry=("doc_id",)))
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([out[i]._lang == names[i % 4] for i in held]) > 0.97
    assert [out[i]._lang for i in (900, 901, 902)] == ["und"] * 3
    assert langid.train(df.limit(0)) is None
    assert {r._lang for r in langid.identify(df, None).collect()} == {"und"}
    assert {r._lang for r in langid.identify(df.where("doc_id < 9"), langid.train(df.where("lang = 'de'")), carry=()).collect()} == {"de"}
    for n in (1, 2, 4, 5, 12):
        code = langid.codewords(n)
        assert len({tuple(c) for c in code}) == n


def test_every_language_is_learned(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid.Model, "fit", lambda x, labels: seen.append(labels))
    data = [(i, f"text {i} of its language", f"l{i % 230}") for i in range(2300)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    langid.train(df)
    langid.train(df, rows=690)
    assert len(set(seen[0])) == len(set(seen[1])) == 230 and len(seen[1]) <= 690 < len(seen[0])
    code = langid.codewords(700)
    assert len({tuple(c) for c in code}) == 700


def test_languages_of_null_and_repeated_ids(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid.Model, "fit", lambda x, labels: seen.append((labels, x)))
    data = [(None, f"satz {i} hier", "de") for i in range(30)] + [(8, f"text {i} of it", "en") for i in range(40)] + [(8, "le même texte", "fr")] * 50 + [(None, "uno", "es")] * 3 + [(i, f"words {i}", "it") for i in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    for rows in (df.repartition(5), df.repartition(2)):
        langid.train(rows, per_language=10)
        langid.train(rows)
    assert [{k: v.count(k) for k in set(v)} for v, _ in seen] == [{"de": 10, "en": 10, "fr": 10, "es": 3, "it": 10}, {"de": 30, "en": 40, "fr": 50, "es": 3, "it": sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(20))}] * 2
    assert np.array_equal(seen[0][1], seen[2][1])


def test_the_sample_is_the_least_hashes_of_each_language(spark, monkeypatch):
    """Whatever the level that rows are first held against, and of frequent and rare languages alike."""
    seen = []
    monkeypatch.setattr(langid.Model, "fit", lambda x, labels: seen.append((labels, x)))
    data = [(i % 900, f"text {i} of it", "en" if i % 50 else "de") for i in range(4000)] + [(1, "seul", "fr")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    langid.train(df, per_language=30)
    labels, x = seen[0]
    held_in = df.where(~langid.is_held_out("doc_id")).withColumn("t", langid.F.xxhash64("text")).withColumn("h", langid.F.xxhash64("doc_id", "t", langid.F.lit(3))).collect()
    for lang in ("en", "de", "fr"):
        want = sorted((r for r in held_in if r.lang == lang), key=lambda r: (r.h, r.t))[:30]
        texts = pa.array([r.text for r in want])
        _, _, data, offsets = next(textnum.slices(texts))
        rows = langid.features(data, offsets).astype(np.float16).astype(np.float32)
        got = np.array([row for label, row in zip(labels, x, strict=True) if label == lang])
        assert sorted(map(bytes, got)) == sorted(map(bytes, rows)), lang


def test_decoding_matches_every_codeword():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 12):
        code = langid.codewords(n)
        bits = code.shape[1]
        model = langid.Model([f"l{i}" for i in range(n)], code, rng.normal(size=(20, bits)).astype(np.float32), rng.normal(size=bits), rng.uniform(0.1, 1, bits))
        x = rng.normal(size=(50, 20)).astype(np.float32)
        best, score, flag = model.decode(x, 0.7)
        for row, b, s, f in zip(x, best, score, flag, strict=True):
            loss = [sum(model.trust[j] * np.log1p(np.exp(-c[j] * (float(row @ model.weights[:, j]) + model.bias[j]))) for j in range(bits)) for c in code]
            assert loss[b] == pytest.approx(min(loss)) and s == pytest.approx(1 / sum(np.exp(min(loss) - v) for v in loss), rel=1e-4)
            assert f == (n > 1 and sorted(loss)[1] - min(loss) < 0.7)


def test_twelve_languages_are_told_apart(spark):
    rng = random.Random(12)
    letters = {f"l{i}": "".join(rng.sample("abcdefghijklmnopqrstuvwxyzäöüßéèñç", 9)) for i in range(12)}
    make = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 7))) for _ in range(40))
    data = [(i, make(f"l{i % 12}"), f"l{i % 12}") for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    out = by_id(langid.identify(df, langid.train(df), carry=("doc_id",)))
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([out[i]._lang == f"l{i % 12}" for i in held]) > 0.97


def test_trees_match_exhaustive_search():
    """The first tree's splits against all splits tried one by one; flat scoring against walking down each tree."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 6, (200, 3)).astype(np.float64)
    y = ((x[:, 1] > 2) ^ (rng.random(200) < 0.1)).astype(np.float64)
    model = quality.Trees.fit(x, y, trees=5, depth=3)
    share = y.mean()
    g, h = y - share, np.full(200, share * (1 - share))

    def best(rows):
        found = (1e-9, None, None)
        for f in range(3):
            for cut in sorted(set(x[:, f]))[:-1]:
                go = rows & (x[:, f] > cut)
                stay = rows & ~go
                if h[go].sum() < 2 or h[stay].sum() < 2:
                    continue
                gain = sum(g[part].sum() ** 2 / (h[part].sum() + 2) for part in (go, stay)) - g[rows].sum() ** 2 / (h[rows].sum() + 2)
                if gain > found[0] + 1e-12:
                    found = (gain, f, cut)
        return found

    node = [np.ones(200, bool)]
    for level in range(3):
        below = []
        for i, rows in enumerate(node):
            at = (1 << level) - 1 + i
            gain, f, cut = best(rows)
            own, limit = model.feature[0][at], model.threshold[0][at]
            go = rows & (x[:, own] > limit)
            if f is None:
                assert not go.any()
            else:
                stay = rows & ~go
                mine = sum(g[part].sum() ** 2 / (h[part].sum() + 2) for part in (go, stay)) - g[rows].sum() ** 2 / (h[rows].sum() + 2)
                assert mine == pytest.approx(gain)
            below += [rows & ~go, go]
        node = below
    for i, rows in enumerate(node):
        assert model.leaf[0][i] == pytest.approx(0.1 * g[rows].sum() / (h[rows].sum() + 2))

    def walk(row, t, at=0, level=0):
        if level == model.depth:
            return model.leaf[t][at - (1 << level) + 1]
        right = row[model.feature[t][at]] > model.threshold[t][at]
        return walk(row, t, 2 * at + 1 + right, level + 1)

    plain = [1 / (1 + np.exp(-(model.base + sum(walk(row, t) for t in range(5))))) for row in x]
    assert model.score(x) == pytest.approx(plain)


def test_statistics_match_plain_counts(rows):
    texts = [t for t in rows if t is not None]
    got = np.concatenate([quality.statistics(data, offsets) for _, _, data, offsets in textnum.slices(pa.array(texts))])
    at = {n: i for i, n in enumerate(quality.NAMES)}
    for t, row in zip(texts, got, strict=True):
        w = cases.spaced(cases.low(t))
        assert row[at["log_bytes"]] == pytest.approx(np.log1p(len(t.encode())), rel=1e-5) and row[at["log_words"]] == pytest.approx(np.log1p(len(w)), rel=1e-5)
        if w:
            assert row[at["distinct_words"]] == pytest.approx(len(set(w)) / len(w), rel=1e-5)
            assert row[at["top_word"]] == pytest.approx(max(cases.Counter(w).values()) / len(w), rel=1e-5)
            assert row[at["word_length"]] == pytest.approx(np.mean([len(x.encode()) for x in w]), rel=1e-5)
            lines = t.split("\n")
            assert row[at["same_lines"]] == pytest.approx(1 - len(set(lines)) / len(lines), abs=1e-5)


def test_licenses_match_brute_force(spark):
    rows = ["Licensed under the MIT License.", "x UNDER THE MIT\nLICENSE under the mit license", "Apache License, Version 2.0", "cc-by-nc CC BY NC", None, "", "under the mit", "under the mit lİcense", "under the mit licen\u017fe \u212a",
            "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated docs files", "This program is free software; you may redistribute it and/or modify it under terms of the GNU General Public License"]
    df = cases.documents(spark, rows)
    out = by_id(license.scan_licenses(df, carry=("doc_id",)))
    for i, t in enumerate(rows):
        w, places, labels = cases.alnum(t), [], set()
        for phrase, label in license.PHRASES.items():
            p = phrase.split()
            for s in range(len(w) - len(p) + 1):
                if w[s : s + len(p)] == p:
                    places.append(s)
                    labels.add(label)
        r = out[i]
        assert (r._n_words, r._n_base, r._first_word, r._last_word, r._base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))), i
        assert 0 <= r._score <= 1 and set(filter(None, r._base_labels.split(","))) <= set(filter(None, r._labels.split(",")))
    assert out[9]._labels == "mit" and out[9]._base_labels == "" and "gpl" in out[10]._labels and out[4]._score == 0


def scanned(words, templates, k, drift, enough):
    """Votes, diagonals, islands and spans of each template, one by one."""
    found = []
    for text, label, base in templates:
        t = license.template_words(text)
        ats = {}
        for p in range(len(words) - k + 1):
            for at in range(len(t) - k + 1):
                if words[p : p + k] == t[at : at + k]:
                    ats.setdefault(p - at, []).append((at, p))
        grams = len(t) - k + 1
        islands, last = [], None
        for d in sorted(ats):
            if not base and len({at for at, _ in ats[d]}) < min(license.LEAST_VOTES, grams):
                continue
            if last is None or base or d - last > drift:
                islands.append([])
            islands[-1] += ats[d]
            last = d
        for own in islands:
            share = len({at for at, _ in own}) / grams
            low, high = min(p for _, p in own), max(p for _, p in own)
            found.append((share, label if (share == 1 if base else share >= enough and high - low + k <= 1.5 * len(t)) else None))
    return ",".join(sorted({label for _, label in found if label})), min(1.0, max((s for s, _ in found), default=0.0))


def test_merged_diagonals_match_brute_force(spark):
    """Texts of licenses with words left out, put in and changed, alone and within others."""
    rng = random.Random(11)
    templates = [*((t, v, True) for t, v in license.PHRASES.items()), *((t, v, False) for t, v in (license.NOTICES | license.TEXTS).items())]
    rows = []
    for n in range(60):
        w = []
        for _ in range(rng.randint(1, 2)):
            t = license.template_words(rng.choice(templates)[0])
            w += [f"x{rng.randrange(99)}" for _ in range(rng.randint(0, 20))]
            often = rng.choice((0, 0.03, 0.1, 0.3))
            for x in t:
                edit = rng.random()
                w += [] if edit < often / 3 else [x, "put"] if edit < 2 * often / 3 else ["changed"] if edit < often else [x]
        rows.append(" ".join(w))
    out = by_id(license.scan_licenses(cases.documents(spark, rows), carry=("doc_id",)))
    for i, t in enumerate(rows):
        labels, score = scanned(t.split(), templates, license.K, 4, 0.6)
        assert out[i]._labels == labels and out[i]._score == pytest.approx(score), i
    whole = " ".join(license.template_words(next(iter(license.TEXTS))))
    assert scanned(whole.replace("without restriction", "with no restriction at all").split(), templates, license.K, 4, 0.6)[0] == "mit"


def test_fingerprints_of_edits(spark, rows):
    ids = [3 * i - 50 for i in range(len(rows))]
    out = by_id(imatch.fingerprints_of_edits(cases.documents(spark, rows, ids)))
    order = sorted(range(len(rows)), key=lambda i: -ids[i])
    for k, i in enumerate(order):
        t, after = rows[i] or "", rows[order[(k + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = out[ids[i]]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == t:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
    same = {}
    for i, t in zip(ids, rows, strict=True):
        assert same.setdefault(t or "", out[i].fingerprint) == out[i].fingerprint
    assert np.mean([r.near_edited for r in out.values()]) > np.mean([r.near_next for r in out.values()]) + 0.1


def test_next_rows_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(imatch, "QUANTILES", 5)
    rng = random.Random(1)
    ids = sorted({rng.randrange(-(10**9), 10**9) for _ in range(300)} | set(range(40)))
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.after for r in imatch.with_next(df, {"text": "after"}, id_col="doc_id").collect()}
    assert got == {i: f"t{ids[k - 1]}" for k, i in enumerate(ids)}


def test_mixture_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(["a", "a", "a", "B", "é", None])) for i in range(3000)] + [(9000, None, "a"), (9001, "", "z"), (None, "w w", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(df, carry=("doc_id", "source")).collect()
    again = mixing.mix_sources(df.repartition(9), carry=("doc_id", "source")).collect()
    key = lambda r: str(tuple(r))
    assert sorted(out, key=key) == sorted(again, key=key)
    sizes, taken, target = {}, {}, {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r._size
        taken[r.source] = taken.get(r.source, 0) + r._taken
        target[r.source] = r._target
        assert 0 <= r._taken <= 3 * r._size
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    assert order == ["B", "a", "z", "é", None]
    fixed, total = {}, sum(sizes.values())
    while True:  # the rule, step by step
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order) if s not in fixed}
        left = total - sum(fixed.values())
        want = {s: left * w / sum(weight.values()) for s, w in weight.items()}
        over = [s for s in want if want[s] > 3 * sizes[s]]
        if not over:
            break
        fixed |= {s: 3 * sizes[s] for s in over}
    want |= fixed
    for s in order:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= max(30, 0.002 * want[s]), s


def test_rates_are_optimal_and_rounded_as_stated(spark):
    """Constraints and the optimum's conditions over documents in plain numpy, then the rounding, document by document."""
    rng = random.Random(7)
    rows = [(i, " ".join("w" for _ in range(int(rng.lognormvariate(3 + (i % 4) / 2, 0.8)))), "abcd"[i % 4] if i % 3 else "a") for i in range(2000)] + [(9000, "", "e"), (9001, "w", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in mixing.mix_sources(df, carry=("doc_id", "source")).collect()}
    size = np.array([len(t.split()) for _, t, _ in rows], float)
    source = np.array([s for _, _, s in rows])
    rate = np.array([out[i]._rate for i, _, _ in rows])
    some = size > 0
    log = np.log(size[some])
    w = size[some]
    centre = (w @ log) / w.sum()
    z = (log - centre) / np.sqrt(w @ (log - centre) ** 2 / w.sum())
    moments = np.stack([z, z * z - 1], axis=1)
    inner, full = np.zeros(len(w), bool), np.zeros(len(w), bool)
    for s in "abcdf":
        own = source[some] == s
        target = out[rows[np.flatnonzero(source == s)[0]][0]]._target
        assert (w * rate[some])[own].sum() == pytest.approx(target, rel=1e-4)
        full |= own & (target >= 3 * w[own].sum() * (1 - 1e-9))
    inner = (rate[some] < 3) & ~full
    # log rate is a multiplier of the source plus a tilt along the moments ...
    dummies = np.stack([source[some] == s for s in "abcdf"], axis=1).astype(float)
    fit, *_ = np.linalg.lstsq(np.hstack([dummies, moments])[inner], np.log(rate[some])[inner], rcond=None)
    assert np.hstack([dummies, moments])[inner] @ fit == pytest.approx(np.log(rate[some])[inner], abs=1e-5)
    # ... and the tilt is where the moments' pull and the penalty balance
    tilt = fit[-2:]
    total = sum({s: out[rows[np.flatnonzero(source == s)[0]][0]]._target for s in "abcdf"}.values())
    assert moments.T @ (w * rate[some]) / total + mixing.PENALTY * tilt == pytest.approx(np.zeros(2), abs=1e-4)
    assert np.abs(tilt).max() > 0.01
    spots = {r.doc_id: r.s for r in df.select("doc_id", (mixing.F.pmod(mixing.F.xxhash64("doc_id", mixing.F.lit(5)), mixing.F.lit(1 << 20)) / float(1 << 20)).alias("s")).collect()}
    for s in "abcdf":
        carried = 0.0
        by_class = {}
        for i, t, own in rows:
            if own == s and t:
                n, r = len(t.split()), out[i]._rate
                whole = int(r + 1e-9)
                rest = max(r - whole, 0.0)
                by_class.setdefault(int(np.floor(np.log2(n + 0.5))), []).append((int((spots[i] - rest + 1) * (mixing.SLOTS // 2)), n, rest, i, whole))
        for c in sorted(by_class, reverse=True):
            wanted = sum(round(x[2] * x[1] * mixing.PARTS) for x in by_class[c]) / mixing.PARTS + carried
            slots = sorted({x[0] for x in by_class[c]})
            ends = [(abs(wanted), 0.0, 0)] + [(abs(upto - wanted), upto, q + 1) for q in slots for upto in [float(sum(x[1] for x in by_class[c] if x[0] <= q))]]
            _, got, until = min(ends)
            carried = wanted - got
            for q, n, _, i, whole in by_class[c]:
                assert out[i]._copies == min(whole + (q < until), 3) and out[i]._taken == n * out[i]._copies


def test_ranks_across_ranges(spark):
    names = [None, "B", "a", "é", "z", "ab", "", "\uffff", "\U0001F600"] + [f"s{i}" for i in range(500)]
    got = {r.source: r.place for r in mixing.ranked(spark.createDataFrame([(n,) for n in names], "source string").repartition(5)).collect()}
    order = sorted((n for n in names if n is not None), key=lambda n: n.encode()) + [None]
    assert got == {n: i for i, n in enumerate(order)}


def test_mixture_by_shuffled_plans_is_the_same(spark, monkeypatch):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, "w " * rng.randint(0, 50), f"s{i % 7}") for i in range(700)], "doc_id long, text string, source string")
    one = sorted(mixing.mix_sources(df, carry=("doc_id",)).collect())
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(mixing.mix_sources(df.repartition(5), carry=("doc_id",)).collect()) == one


PAGES = {
    "<html><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>A title here</h1><p>First &amp; fore&shy;most   text\nof the page, long enough to be read.<p>Second <b>bold<br>line</b> of it, also long enough.</article><footer>&copy; 2020 someone</footer></body></html>": "A title here\n\nFirst & fore\xadmost text of the page, long enough to be read.\n\nSecond bold line of it, also long enough.",
    None: "",
    "": "",
    "<p": "",
    "<script>var a = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> -->": "",
    "<nav><a href=x>a</a></nav>": "",
    '<body><header><h1>My Site</h1><nav><a href=/>Home</a></nav></header><div class="cookie-banner"><p>We use cookies to improve. Accept?</p><button>OK</button></div><main><article><h1>Real headline</h1><p>First paragraph of the text, which is of decent length.</p><div class="ad"><p>Buy our stuff now and save money</p></div><p>Second one with a <a href=x>link</a> in it.</p><ul><li>point one</li><li>point two</li></ul></article><section id="comments"><h2>Comments</h2><div class="comment"><p>I think this is a great article, thanks for sharing it with us.</p></div></section></main><aside><h3>Related</h3><ul><li><a href=y>Other story</a></li></ul></aside><form><input><p>Subscribe to the newsletter today</p></form><footer><p>Copyright 2020 all rights reserved</p></footer></body>': "Real headline\n\nFirst paragraph of the text, which is of decent length.\n\nSecond one with a link in it.\n\npoint one\n\npoint two",
    '<body><article><h1>A</h1><p>Text one is here.</p></article><div class="comments"><h3>2 replies</h3><article><p>Reader says something long enough for a comment.</p></article></div></body>': "A\n\nText one is here.",
    "<p>Just a plain page with one paragraph.</p><p>And another one.</p>": "Just a plain page with one paragraph.\n\nAnd another one.",
}


def test_pages(spark):
    df = spark.createDataFrame([(i, None, h, "x") for i, h in enumerate(PAGES)], "page_id long, url string, html string, text string")
    out = by_id(htmltext.extract_pages(df, htmltext.train(), carry=("page_id", "url")), "page_id")
    for i, want in enumerate(PAGES.values()):
        assert out[i]._text == want and out[i]._n_chars == len(want)


def test_pages_keep_what_follows_unclosed_elements():
    article = "<article><h1>A title here</h1><p>First text of the page, long enough to be read.</p>{}<p>Second line of it, also long enough.</p></article>"
    parts = ["A title here", "First text of the page, long enough to be read.", "Second line of it, also long enough."]
    model, text = htmltext.train(), article.format("")
    page = lambda between: htmltext.extract("<body>" + article.format(between) + "<p><svg></svg></body>", model).split("\n\n")
    head = "<html><head><meta charset=utf-8><title>Name of page</title><style>p{}</style>"
    for start in (head, head + "<body>", head + "</head><body>", "<head><title>Name of page<body>", "<head><title>Name<meta charset=x></head><body>"):
        assert htmltext.extract(start + text, model).split("\n\n") == parts, start
    for between in ("<svg/>", "<svg viewBox='0 0 1 1' />", "<svg><svg><title>no</title><style>no</style></svg><path d=x /></svg>", "<svg>", "<iframe src=x>", "<template>", "<noscript>", "<math/>", "<select><option></select>", "<title>no</title>"):
        assert page(between) == parts, between
    assert page("<p>Let the number <math><mi>x</mi><mo>=</mo><mn>2</mn><mspace/><mtext>units</mtext></math> be as long as it was.</p>") == [*parts[:2], "Let the number x=2 units be as long as it was.", parts[2]]
    assert page("<object data=x><p>What readers without the plug-in see, long enough.</p></object>") == [*parts[:2], "What readers without the plug-in see, long enough.", parts[2]]
    assert page("<script>var a") == parts[:2] and page("<style>p{") == parts[:2]
    assert isinstance(htmltext.extract("<svg><svg></svg><select><template>" * 5000, model), str)


def test_utility_classes_do_not_hide_what_a_node_stands_in():
    utility = " ".join("flex items center px py mt mb gap grow shrink basis order truncate rounded shadow border".split())
    inner = f'<div class="{utility}">' * 3 + "<p>Some text of the inner part, long enough to be read.</p>" + "</div>" * 3
    pages = [htmltext.Page(f'<body><div class="sidebar comments">{c}{inner}</div>') for c in ("", '<div class="one two three four five six seven eight nine ten eleven twelve">')]
    for page in pages:
        for own in (htmltext.node_features(page)[-1], htmltext.node_features(page, {"^~sidebar", "^~comments"})[-1]):
            assert {"^~sidebar", "^~comments"} <= set(own) and len(own) == len(set(own))
    deep = "".join(f"<div class=w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}>" for i in range(17000))
    assert isinstance(htmltext.extract(deep + "text", htmltext.train(40)), str)


TOLD = "Some more text that belongs to the page and is long enough to be read."
SAID = "I think this is a great article, thanks for sharing it with us all."


@pytest.mark.parametrize(("inside", "around", "kept", "gone"), [
    ("", ("", '<div class="comments"><h2>Comments</h2>' + '<div class="foo bar">' * 20 + f"<p>{SAID}</p>" + "</div>" * 21), "", SAID),
    ('<div class="comments"><h2>Comments</h2>' + '<div class="foo bar">' * 20 + f"<p>{SAID}</p>" + "</div>" * 21, ("", ""), "", SAID),
    (f'<div class="ad-hoc-networks"><p>{TOLD}</p></div>', ("", ""), TOLD, "-"),
    (f'<div class="alert-info"><p>{TOLD}</p></div>', ("", ""), TOLD, "-"),
    ('<div class="ad"><p>Buy our stuff now and save money</p></div>', ("", ""), "", "Buy our stuff"),
    ("<h2>Further reading</h2><ul><li><a href=x>A book about it</a></li><li><a href=y>Another book</a></li></ul>", ("", ""), "A book about it\n\nAnother book", "-"),
    ("<p>Let <math><mi>x</mi></math> be a number that is large.</p>", ("", ""), "Let x be a number", "-"),
    ("", ('<div class="kopfzeile"><div>Meine Seite</div><a href=/>Start</a> <a href=/k>Kontakt</a></div>', '<div class="fusszeile">Impressum und Datenschutz</div>'), "", "Meine Seite|Start|Impressum"),
    ("", ("<div><h1>Mi sitio</h1></div>", "<div><p>Aviso legal del sitio</p></div>"), "", "Mi sitio|Aviso"),
    ("", ("", f"<div><p>{SAID}</p></div>"), "", SAID),
    ("", ("", "<div class=wxqz><div><p>" + f"</p></div><div><p>".join([SAID] * 4) + "</p></div></div>"), "", SAID),
])
def test_pages_are_told_by_structure(inside, around, kept, gone):
    article = f"<article><h1>A title of the page</h1><p>First text of the page, long enough to be read by all.</p>{inside}<p>Second line of it, also long enough to be read.</p></article>"
    out = htmltext.extract(f"<html><body>{around[0]}{article}{around[1]}</body></html>", htmltext.train())
    assert out.startswith("A title of the page\n\nFirst text") and out.endswith("also long enough to be read.") and kept in out
    assert not any(g in out for g in gone.split("|")), out


ONE, TWO = (" ".join([t] * 5) for t in ("Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod.", "Quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo."))
BOTH = f"<article><h1>A title</h1><p>{ONE}</p><p>{TWO}</p></article>"


@pytest.mark.parametrize("page", [
    f"<html><body>{ONE}<br><br>{TWO}</body></html>", f"<html><body><h1>A title</h1>{ONE}<br><br>{TWO}</body></html>", f"<html><body><div>{ONE}<br><br>{TWO}</div></body></html>",
    f"{ONE}\n\n{TWO}", f"<b>{ONE}</b> {TWO}", f"<body><div class=page><div id=wrap>{ONE}<br>{TWO}</div></div></body>",
    f'<html><body class="has-sidebar has-banner comments-open"><div class="page">{BOTH}</div></body></html>', f'<html><body class="right-sidebar">{BOTH}</body></html>', f'<html><body class="sidebar">{BOTH}</body></html>',
    f'<html><body><nav><ul><li><a href=x>Home</a></ul></nav><div class="social">{BOTH}</div><footer>&copy; x</footer></body></html>', f'<html class="no-sidebar"><body id="popup"><div class="modal-open">{BOTH}</div></body></html>',
    f"<body><article><p>{ONE}</p><noscript><p>{TWO}</p></noscript></article></body>", f"<body><article><p>{ONE}</p><svg width=9><g><text>{TWO}</text></g></svg></article></body>",
])
def test_texts_without_blocks_and_under_names_of_the_page(page):
    """Text straight in the page, its body or plain divisions; names on what holds everything; text in drawings and noscript."""
    out = htmltext.extract(page, htmltext.train())
    assert ONE in out and TWO in out and "Home" not in out, out


def test_names_are_remembered_within_bounds():
    for i in range(6000):
        htmltext._words(f'id="post-{i}"')
    assert htmltext._words.cache_info().currsize <= 4096


def plain_article(page):
    """The text of a page of the tables' own template, by its tags."""
    import html
    import re

    blocks = re.split(r"</?(?:h1|p|li|ul|div|footer|article)\b[^>]*>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    texts = (" ".join(html.unescape(re.sub(r"</?(?:b|a)\b[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def test_every_page_of_the_table_matches_its_template(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = by_id(htmltext.extract_pages(pages, htmltext.train(), carry=("page_id",)), "page_id")
    for r in pages.collect():
        assert out[r.page_id]._text == plain_article(r.html) and out[r.page_id]._n_chars == len(out[r.page_id]._text)


def test_pages_held_out():
    """Accuracy by block on composed pages of another seed, half of which name nothing that training pages name."""
    model, right, total = htmltext.train(), 0, 0
    for page, labels in htmltext.labelled_pages(120, seed=99):
        odds = model.marginals(page)
        for node, raw, _ in page.blocks:
            if raw.strip():
                total += 1
                right += (odds[node] > 0) == bool(labels[node])
    assert right / total > 0.98


def test_marginals_match_enumeration():
    model = htmltext.train(40)
    page = htmltext.Page("<body><div><p>some text that is long enough</p><ul><li><a>x</a></ul></div><p>more")
    n = len(page.tags)
    plain = [model.bias + sum(model.weights.get(f, 0) for f in own) for own in htmltext.node_features(page)]
    mass = np.zeros((n, 2))
    for z in range(1 << n):
        label = [z >> i & 1 for i in range(n)]
        e = sum(label[i] * plain[i] for i in range(n))
        p = np.exp(e)
        for i in range(1, n):
            p *= (model.edges.get(page.tags[i]) or model.edges[""])[2 * label[i] + label[page.parents[i]]]
        for i in range(n):
            mass[i, label[i]] += p
    assert np.log(mass[:, 1] / mass[:, 0]) == pytest.approx(model.marginals(page), abs=1e-6)


def test_very_deep_and_unclosed_pages():
    model = htmltext.train(40)
    assert isinstance(htmltext.extract("<div>" * 30000 + "text", model), str)
    assert isinstance(htmltext.extract("<p a='" * 2000, model), str)
    assert isinstance(htmltext.extract("<" * 20000, model), str)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert near_duplicates(none).count() == 0
    assert repeated_substrings(none, carry=("doc_id",)).count() == 0
    assert decontaminate(none, bench).count() == 0
    assert decontaminate(docs, bench, carry=("doc_id",)).where("_n_hit > 0").count() == 0
    assert license.scan_licenses(none).count() == 0
    assert imatch.fingerprints_of_edits(none).count() == 0
    assert mixing.mix_sources(none).count() == 0
    assert langid.identify(none, langid.train(none)).count() == 0
    marks = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_quality(none, quality.train(none, marks)).count() == 0
    assert {r._score for r in quality.score_quality(docs, quality.train(docs, marks)).collect()} == {0.5}
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert filter_urls(pages, []).count() == 0
    assert htmltext.extract_pages(pages, htmltext.train(10)).count() == 0
