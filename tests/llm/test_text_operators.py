"""Operators that SQL can't express, against brute force, round trips and held-out accuracy."""

import hashlib
from collections import Counter

import pyarrow as pa
import pytest

from tarn.llm import bpe, langid, minhash, substrings, words
from tarn.llm.common import connected_components

ASCII = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def frame(spark, made, schema="doc_id long, text string"):
    return spark.createDataFrame(made, schema)


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text, k):
    w = (text or "").encode().translate(ASCII).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_brute(docs, k, num, den):
    sets = {d: shingles(t, k) for d, t in docs}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * den >= max(len(sets[a]), len(sets[b])) * num and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    top = roots(ids, links)
    return {d: (len(sets[d]), top[d], top[d] == d) for d in ids}


def as_dict(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_words_and_runs():
    import pyarrow as pa

    texts = ["the Cat\tsat", None, "", "  ", "on the mat \n the cat\x0b\x0csat", "the cat sat", "thecat sat", "a\x1cb é x"]
    w = words.words(pa.array(texts), fold=True, digest=words.QUICK)
    expected = [(t or "").encode().translate(ASCII).split() for t in texts]
    assert [int(x) for x in (w.first[1:] - w.first[:-1])] == [len(x) for x in expected]
    flat = [x for own in expected for x in own]
    assert w.tokens == flat
    for numbers in (w.hash, w.number):
        seen = {}
        assert all(seen.setdefault(a, b) == b for a, b in zip(flat, numbers.tolist())) and len(set(seen.values())) == len(seen)
    for k in range(1, 9):
        value = words.exact_runs(w.number << 18, k).tolist()  # so large that they have to be numbered anew
        assert len(set(zip(value, (tuple(flat[i : i + k]) for i in range(len(value)))))) == len(set(value)) == len({tuple(flat[i : i + k]) for i in range(len(value))})
    h, inside = words.runs(w, 3)
    good = [tuple(flat[i : i + 3]) for i in range(len(flat) - 2) if inside[i]]
    assert good.count((b"the", b"cat", b"sat")) == 3
    assert len({int(x) for x, y in zip(h, inside) if y}) == len(set(good))
    sliced = words.words(pa.array(texts).slice(4, 2), fold=True, digest=words.QUICK)
    assert sliced.hash.tolist() == w.hash[w.first[4] : w.first[6]].tolist()


def test_minhash_query_equals_brute_force(spark, data, documents):
    got = as_dict(minhash.op2_minhash(spark, data))
    assert got == near_brute([(d, t) for d, t, _, _ in documents], 3, 85, 100)


def test_minhash_chains_and_hot_groups(spark):
    base = [f"w{i}" for i in range(60)]
    made = [(1000 + i, " ".join(base)) for i in range(50)]  # exact copies
    for i in range(120):  # near copies that drift: each is like its neighbours, the ends are not alike
        own = list(base)
        for j in range(i // 2):
            own[(j * 7) % 60] = f"x{j}"
        made.append((i, " ".join(own) + (" tail" if i % 2 else "")))
    made += [(2000 + i, "a common line that many share " + " ".join(f"u{i}v{j}" for j in range(9))) for i in range(80)]
    got = as_dict(minhash.near_duplicates(frame(spark, made), 3, 85, 100))
    assert got == near_brute(made, 3, 85, 100)


def test_minhash_edges(spark):
    made = [(5, "One two"), (4, "one TWO"), (3, "two one"), (7, ""), (8, None), (9, " \n "), (2, "é É x"), (1, "é é x"), (6, "one two"), (6, "one two")]
    df = frame(spark, [(*m, "clash") for m in made] + [(None, "one two", "clash")], "doc_id long, text string, kept string")
    out = minhash.near_duplicates(df, 3, 85, 100).collect()
    assert len(out) == len(made) + 1
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out}
    assert got.pop(None) == (1, None, True)
    assert got == near_brute(made, 3, 85, 100) and got[5][1] == 4 and got[8] == (0, 8, True)
    long = "word " * 200_000 + " ".join(map(str, range(50_000)))
    assert as_dict(minhash.near_duplicates(frame(spark, [(1, long), (2, long + " more")]), 5)) == near_brute([(1, long), (2, long + " more")], 5, 80, 100)
    assert minhash.near_duplicates(frame(spark, []), 5).count() == 0


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_made_up_words_are_told_apart(spark, n):
    one, two = thue_morse(n), thue_morse(n, "b", "a")
    made = [(1, one), (2, two)] + [(3 + i, " ".join([*(f"w{j}" for j in range(20)), x, *(f"v{j}" for j in range(20))])) for i, x in enumerate((one, two))]
    assert as_dict(minhash.near_duplicates(frame(spark, made), 3, 95, 100)) == near_brute(made, 3, 95, 100)
    assert substring_found(substrings.drop_repeats(frame(spark, made), 35)) == substring_brute(made, 35)
    # Whole words in that order, too.
    made = [(1, " ".join(one)), (2, " ".join(two))]
    for length in (35, n):
        assert substring_found(substrings.drop_repeats(frame(spark, made), length)) == substring_brute(made, length)


def test_equal_hashes_of_other_words_are_other_shingles(monkeypatch):
    # With a hash of five values, nearly all shingles collide.
    real = words.runs
    monkeypatch.setattr(minhash, "runs", lambda w, k: (real(w, k)[0] % words.U(5), real(w, k)[1]))
    texts = ["a b c a b c d e f a b d " * 3, "a b", "", "x y z x y z x y z"]
    w = words.words(pa.array(texts), fold=True, digest=words.STRONG)
    assert [len(x) for x in minhash._shingles(w, 3)[0]] == [len(shingles(t, 3)) for t in texts]
    prints = [minhash._fingerprint(v, minhash._shingles(v, 3)[0][0], 3, 0) for v in (words.words(pa.array([t]), digest=words.STRONG) for t in ("a b c a b c d", "a b c d b c a b c", "c d e", "a b c a b c d a b c"))]
    assert len(set(prints)) == len({frozenset(shingles(t, 3)) for t in ("a b c a b c d", "a b c d b c a b c", "c d e", "a b c a b c d a b c")})


def test_equal_hashes_of_other_windows_are_other_windows():
    import numpy as np
    from random import Random

    r = Random(8)
    for hashes in (1, 2, 1 << 40):
        for _ in range(40):
            texts = [" ".join(r.choices("abc", k=r.randrange(12))) for _ in range(8)]
            w = words.words(pa.array(texts), digest=words.QUICK)
            h, inside = words.runs(w, 3)
            at = np.flatnonzero(inside)
            first, several = substrings._firsts(w, at, h[at] % words.U(hashes), 3)
            own = [tuple(w.tokens[i : i + 3]) for i in at]
            assert first.tolist() == [own.index(x) for x in own] and several.tolist() == [own.count(x) > 1 for x in own]


def test_minhash_of_repeated_ids(spark):
    text = lambda p: " ".join(f"{p}{i}" for i in range(80))
    made = [(5, text("x")), (5, text("y")), (6, text("x") + " z"), (7, text("y") + " z"), (9, text("q")), (8, text("r")), (9, text("r")), (8, text("q")), (10, text("s")), (10, ""), (10, None)]
    for _ in range(2):
        out = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame(spark, made), 3, 85, 100).repartition(1).collect())
        assert [x[2] for x in out if x[0] in (5, 6, 7)] == [5] * 4 and [x[2] for x in out if x[0] in (8, 9)] == [8] * 4
        assert [x for x in out if x[0] == 10] == [(10, 0, 10, True), (10, 0, 10, True), (10, 78, 10, True)]


def test_posterior_bounds():
    enough = minhash.least_matches(0.85, 180, 1e-5)
    assert enough == sorted(enough) and enough[180] < 0.85 * 180 and enough[30] < 0.85 * 30
    assert minhash.rows_per_band(0.85, 30, 7e-6) == 6 and minhash.rows_per_band(0.8, 30, 7e-6) == 5


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (300, 299), (300, 299), (7, 7), (None, 3)] + [(1000, i) for i in range(1001, 1200)]
    got = as_dict(connected_components(spark.createDataFrame(links, "a long, b long")))
    real = [x for x in links if None not in x and x[0] != x[1]]
    assert {k: v[0] for k, v in got.items()} == roots({n for x in real for n in x}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def substring_brute(docs, length):
    own = [(d, (t or "").encode().split()) for d, t in docs]
    seen = Counter(tuple(w[i : i + length]) for _, w in own for i in range(len(w) - length + 1))
    out = []
    for d, w in own:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def substring_found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("part", [4 << 20, 3000])
def test_substrings_equal_brute_force(spark, documents, monkeypatch, part):
    monkeypatch.setattr(substrings, "PART", part)  # small parts: repeats are met across them
    docs = [(d, t) for d, t, _, _ in documents]
    assert substring_found(substrings.drop_repeats(frame(spark, docs), 35)) == substring_brute(docs, 35)


@pytest.mark.parametrize("part, crowd", [(4 << 20, 1024), (400, 1024), (400, 3), (1, 20)])
def test_substring_edges(spark, monkeypatch, part, crowd):
    monkeypatch.setattr(substrings, "PART", part)
    monkeypatch.setattr(substrings, "CROWD", crowd)  # few rows make an anchor crowded, so its windows are counted one by one
    passage = " ".join(f"p{i}" for i in range(14))
    docs = [(i, f"a{i} b{i} {passage} c{i} d{i}") for i in range(90)]  # longer than the window
    docs += [(200 + i, f"e{i} " + " ".join(f"q{j}" for j in range(9)) + f" f{i} " + " ".join(f"q{j}" for j in range(9, 14))) for i in range(90)]  # shared parts are shorter
    docs += [(300, "same " * 40), (301, "same " * 9), (302, None), (303, ""), (304, "Case " * 10), (305, "case " * 10), (None, f"x {passage} y"), (400, "once only, these words"), (401, "twice " + " ".join(map(str, range(10)))), (401, "twice " + " ".join(map(str, range(10))))]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_words int")
    out = substrings.drop_repeats(df, 10)
    assert set(out.columns) == {"doc_id", "text", "n_words", "n_removed", "kept"}
    assert substring_found(out) == substring_brute(docs, 10)
    assert substrings.drop_repeats(frame(spark, []), 10).count() == 0


def test_substrings_of_single_short_documents(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PART", 1)  # each document is a part of its own
    docs = [(n, " ".join(f"w{n}_{i}" for i in range(n))) for n in range(1, 41)] + [(50, " ".join(f"w40_{i}" for i in range(40)))]
    for n in range(60):
        assert len(substrings._window_runs(pa.array([" ".join(map(str, range(n)))]), 35, 14)[1]) == max(0, n - 34)
    assert substring_found(substrings.drop_repeats(frame(spark, docs), 35)) == substring_brute(docs, 35)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks, pattern = bpe.public_vocabulary()
    return ranks, pattern, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash(library):
    keys = list(library[0])
    found = bpe.PerfectHash(keys)
    assert [found.find(k) for k in keys] == list(range(len(keys))) and sorted(found.slots) == list(range(len(keys)))
    assert found.find(b"not an entry at all") == found.find(b"") == bpe.PerfectHash([]).find(b"a") == -1


def test_bpe_equals_the_library(library, documents):
    ranks, pattern, enc = library
    coder = bpe.Coder(ranks, pattern, most=500)
    texts = [t for _, t, _, _ in documents] + ["", " ", "\n\n  x", "<|endoftext|>", "a" * 5000, "é́ 🙂🙂   \x1c\x85", "don't we'LL 'S", "ab" * 3000 + "日本語" * 50, "١٢٣ ²Ⅷ", "\ufeff\u200b", "a\U00018f2b's \u2003\x85 \U00010edd'll1"]
    for t in texts:
        ids = coder.encode(t)
        assert ids == enc.encode_ordinary(t) and coder.decode(ids) == t.encode()


def test_bpe_of_any_characters(library):
    from random import Random

    ranks, pattern, enc = library
    coder, r = bpe.Coder(ranks, pattern), Random(7)
    for _ in range(4000):
        text = "".join(r.choice(["a", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "\u2003", "é", "日", "1", "²", "'s", "'", "!", "🙂", "the", "x" * r.randrange(9), chr(r.randrange(0x250, 0xD7FF)), chr(r.randrange(0x10000, 0x40000))]) for _ in range(r.randrange(1, 25)))
        ids = coder.encode(text)
        assert ids == enc.encode_ordinary(text) and coder.decode(ids) == text.encode()


def test_workers_get_texts_once_and_keep_their_own_tables_only(spark, documents, library, monkeypatch):
    from pyspark import cloudpickle

    df = spark.createDataFrame([(d, t, x) for d, t, x, _ in documents[:40]], "doc_id long, text string, lang string")
    sent, whole = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: sent.append((self.columns, run)) or whole(self, run, schema))
    coded, found = bpe.encode(df, *library[:2]), langid.identify(df, langid.train(df))
    assert [c for c, _ in sent] == [["doc_id", "text", "lang"]] * 2
    assert {r["doc_id"]: r["text"] for r in found.collect()} == {r["doc_id"]: r["text"] for r in coded.collect()} == {d: t for d, t, _, _ in documents[:40]}
    other = bpe.encode(df, *library[:2], ids="text", decoded="lang")  # what is replaced is read all the same
    assert {(r["doc_id"], tuple(r["text"])) for r in other.collect()} == {(d, tuple(library[2].encode_ordinary(t))) for d, t, _, _ in documents[:40]}
    batch = pa.RecordBatch.from_pylist([{"doc_id": d, "text": t, "lang": x} for d, t, x, _ in documents[:40]])
    list(sent[0][1](iter([batch])))
    assert len(bpe._coders) == 1
    for name, stay in (("bpe", 1), ("langid", 0)):  # as it is copied to a worker
        assert not list(cloudpickle.loads(cloudpickle.dumps(words.alone(iter, name)))(iter([]))) and len(bpe._coders) == stay
    list(sent[0][1](iter([batch])))
    words.STRONG(b"word")
    list(sent[1][1](iter([batch])))
    assert not bpe._coders and not words._digests


def test_bpe_query_and_edges(spark, data, documents, library):
    ranks, pattern, enc = library
    digest = lambda b: hashlib.sha256(b).hexdigest()
    got = as_dict(bpe.op3_bpe(spark, data))
    for d, t, _, _ in documents:
        ids = enc.encode_ordinary(t)
        assert got[d] == (len(ids), digest(" ".join(map(str, ids)).encode()), digest(t.encode()))
    made = [(1, None, 1), (2, "", 2), (3, "word " * 100_000, 3), (3, "word", 3), (None, "x", None)]
    out = bpe.encode(spark.createDataFrame(made, "doc_id long, text string, ids int"), ranks, pattern)
    again = bpe.decode(out, ranks)
    assert sorted((str(r["doc_id"]), bytes(r["decoded"]).decode()) for r in again.collect()) == sorted((str(d), t or "") for d, t, _ in made)
    assert all(r["ids"] == enc.encode_ordinary(r["text"] or "") for r in out.collect())
    assert bpe.encode(frame(spark, []), ranks, pattern).count() == 0


def test_language_id_held_out(spark, data, documents):
    got = as_dict(langid.op7_language_id(spark, data))
    lang = {d: x for d, _, x, _ in documents}
    held = [d for d in got if got[d][0]]
    assert len(got) == len(documents) and 0.1 < len(held) / len(got) < 0.35
    assert sum(got[d][1] == lang[d] for d in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for _, _, s in got.values())


def test_language_id_edges(spark, documents):
    made = [(d, t, x) for d, t, x, _ in documents][:120] + [(10_000, None, "en"), (10_001, "", None), (10_002, "12 %% 3", "en"), (10_003, "the", None), (None, "the thing", "zz"), (10_004, "ти " * 40_000, None)]
    df = spark.createDataFrame([(*m, "clash") for m in made], "doc_id long, text string, lang string, score string")
    model = langid.train(df)
    assert set(model.languages) <= {x for _, _, x in made if x} - {"zz"}
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect()}
    assert out[10_000] == out[10_001] == out[10_002] == ("und", 0.0) and out[10_003][0] in model.languages
    assert out[10_004][1] < 0.2  # like nothing that was learned
    nothing = langid.train(df.where("lang = 'zz'"))
    assert {r["lang_pred"] for r in langid.identify(df, nothing).collect()} == {"und"}
    assert langid.identify(df.where("false"), model).count() == 0
    assert langid.fit(["abc", "abd"], ["x", "x"]).languages == ["x"]


def test_language_id_sample_is_bounded(spark, documents):
    df = spark.createDataFrame([(d, t, x) for d, t, x, _ in documents], "doc_id long, text string, lang string")
    few = langid.train(df, per_language=5, languages=2)
    assert few.weights.shape == (len(few.columns), 2) and len(few.columns) < 10 * 4 * langid.SAMPLED


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "TEXTS", 400)
    made = [(10 * i + j, f"{chr(0x4E00 + i) * 3} {chr(0x4E00 + i)}", f"l{i:03}") for i in range(130) for j in range(10 if i < 120 else 3)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    learned = {x for d, _, x in df.where(langid.remainder(df["doc_id"]) != 0).collect()}
    assert len(learned) > 100 and set(langid.train(df).languages) == learned
    monkeypatch.setattr(langid, "MOST_LANDMARKS", 110)
    with pytest.raises(ValueError):
        langid.train(df)


def test_language_id_of_long_texts(spark, documents):
    from random import Random

    r, own, natural = Random(3), {}, {}
    for d, t, x, _ in documents:
        if x and t and d % 2:
            own.setdefault(x, []).append(t)
        elif x and t:
            natural.setdefault(x, []).extend(t.split())
    df = spark.createDataFrame([(d, t, x) for d, t, x, _ in documents if d % 2], "doc_id long, text string, lang string")
    model = langid.train(df)
    # Half of the words are random letters, so nearly all n-grams occur somewhere.
    noise = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 9)))
    long = {x: " ".join(y for _ in range(60_000) for y in (r.choice(w), noise())) for x, w in natural.items()}
    out = langid.identify(spark.createDataFrame(list(long.items()), "lang string, text string"), model).collect()
    assert len(out) == len(own) and all(len(t) > 500_000 for t in long.values())
    assert all(row["lang_pred"] == row["lang"] for row in out)


def gram_set(text, order=4):
    raw = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode())
    return {raw[i : i + n] for n in range(1, order + 1) for i in range(len(raw) - n + 1)}


def test_kernel_is_the_overlap_of_ngrams():
    texts = ["abc", "ABC", "abcd", "xyz", "", "a1c", "a c"]
    found = [set(g.tolist()) for g in langid.grams(texts, 3)]
    assert [len(g) for g in found] == [len(gram_set(t, 3)) for t in texts]
    assert found[0] == found[1] and found[5] == found[6] and len(found[0] & found[2]) == 6 and not found[0] & found[3]
    assert ["".join(langid.pieces(t, 10)) == t and max(map(len, langid.pieces(t, 10))) <= 10 for t in ("", "a" * 10, "ab" * 17)] == [True] * 3


def test_scores_are_those_of_kernel_ridge_regression(documents):
    """The regression in its textbook form, with exact sets of n-grams."""
    import numpy as np

    rows = [(t[:300], x) for _, t, x, _ in documents if t and x][:60]
    sets, names, m = [gram_set(t) for t, _ in rows], sorted({x for _, x in rows}), 5
    k = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    marks = [i for i, (_, x) in enumerate(rows) if sum(y == x for _, y in rows[:i]) < m]
    nm = np.array([[k(a, sets[j]) for j in marks] for a in sets])
    y = np.array([[float(x == z) for z in names] for _, x in rows])
    n = len(rows)
    dual = np.linalg.solve(nm.T @ nm + langid.RIDGE * n * nm[marks] + 1e-9 * n * np.eye(len(marks)), nm.T @ y)
    asked = [t[300:700] for _, t, _, _ in documents if t and len(t) > 700][:20] + ["", "zzz qqq", "the"]
    expected = np.array([[k(gram_set(t), sets[j]) if t else 0 for j in marks] for t in asked]) @ dual
    model = langid.fit([t for t, _ in rows], [x for _, x in rows], m, bits=26)
    assert model.languages == names and np.allclose(model.scores(asked), expected, atol=2e-3)
    # Fewer bits hardly matter, and a long text is the mean of its pieces.
    assert np.allclose(langid.fit([t for t, _ in rows], [x for _, x in rows], m).scores(asked), expected, atol=0.03)
    long = "the piece of a text " * 3000
    assert np.allclose(model.scores([long]), model.scores(langid.pieces(long)).mean(0))
