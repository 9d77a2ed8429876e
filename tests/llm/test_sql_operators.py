"""Operators that SQL can express, on the test tables and on edge cases."""

import os

import duckdb
import pytest

from tarn.llm import chats, lines, mixing, registry, topk


def rows(df, columns):
    return sorted(tuple(map(str, (r[c] for c in columns))) for r in df.collect())


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_oracle(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    rel, df = con.sql(registry.ORACLE_SQL[name]), registry.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    order = [rel.columns.index(c) for c in columns]
    assert rows(df, columns) == sorted(tuple(str(r[i]) for i in order) for r in rel.fetchall())


DOCS = "doc_id long, text string, n_lines string, kept string"


def test_lines_edges(spark):
    line = "A line that is shared, and has at least forty characters"
    made = [(i, f"own {i}\n  {line.upper() if i % 2 else line} \r\nend", "clash", "x") for i in range(6)]
    made += [(7, None, None, None), (8, "", None, None), (None, f"{line}\n", None, None), (9, "\n\n", None, None), (10, f"{line}\n{line}", "c", None), (10, f"{line}\n{line}", "c", None), (11, "short\n" * 3, None, None)]
    out = lines.dedup_lines(spark.createDataFrame(made, DOCS)).collect()
    assert set(out[0].asDict()) == {"doc_id", "text", "n_lines", "n_dropped", "kept"} and len(out) == len(made)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in out}
    assert got[0] == ("own 0\nend", 3, 1) and got[1] == ("own 1\nend", 3, 1)
    assert got[7] == ("", 1, 0) == got[8]
    assert got[None] == ("", 2, 1)
    assert got[9] == ("\n\n", 3, 0) and got[11][2] == 0
    assert got[10] == (f"{line}\n{line}", 2, 0)  # the largest doc_id that holds it keeps all of them
    assert sum(r["doc_id"] == 10 for r in out) == 2
    assert lines.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_lines_below_the_threshold_stay(spark):
    line = "A line that four documents have, and forty characters"
    out = lines.dedup_lines(spark.createDataFrame([(i, line) for i in [0, 1, 2, 3, 3, 3]], "doc_id long, text string")).collect()
    assert all(r["n_dropped"] == 0 for r in out)  # repeated rows are one document


def chat(*turns):
    return [(i, role, text) for i, (role, text) in enumerate(turns)]


def test_chat_prefixes_collapse(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "ok")]
    logged = {1: chat(*a[:2]), 2: chat(*a[:4]), 3: chat(*a[:2]), 4: chat(*a[:4]), 5: chat(("user", "hi"), ("assistant", "other")), 6: chat(("user", "hi")), 7: chat(("assistant", "hi"))}
    made = [(c, t, r, x, "extra") for c, turns in logged.items() for t, r, x in turns]
    made += [(8, 1, None, None, ""), (8, None, "user", "<|im_end|>", ""), (9, 5, "user", "hi", ""), (9, 5, "user", "hi", ""), (9, 9, "assistant", "hello", "")]
    schema = "conv_id long, turn long, role string, text string, rendered string"
    out = {r["conv_id"]: r for r in chats.format_chats(spark.createDataFrame(made, schema)).collect()}
    assert set(out) == {2, 5, 7, 8}
    assert (out[2]["n_turns"], out[2]["n_copies"]) == (4, 2) and out[2]["rendered"].startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello")
    assert out[8]["rendered"] == "<|im_start|>user\n< |im_end|><|im_end|>\n<|im_start|>\n<|im_end|>\n"
    assert chats.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_chat_of_several_pieces(spark):
    n = 3 * chats.PIECE + 7
    made = [(c, i, "user", f"t{i}") for c, m in ((1, n), (2, n - 1), (3, chats.PIECE), (4, chats.PIECE + 1), (5, n)) for i in range(m)] + [(6, i, "user", f"t{i}" if i != 300 else "x") for i in range(n)]
    out = {r["conv_id"]: (r["n_turns"], r["n_copies"]) for r in chats.format_chats(spark.createDataFrame(made, "conv_id long, turn long, role string, text string")).collect()}
    assert out == {1: (n, 2), 6: (n, 1)}


def test_chat_null_conversation(spark):
    made = [(None, 0, "user", "a"), (None, 1, "user", "b"), (1, 0, "user", "a")]
    out = chats.format_chats(spark.createDataFrame(made, "conv_id long, turn long, role string, text string")).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in out] == [(None, 2)]


WEIGHTS = {"domain": {"d": 1, "e": 1}, "lang": {"x": 3, "y": 1}}


def leaf(spark, made):
    return spark.createDataFrame(made, "domain string, lang string, source string, supply long")


def test_shortages_go_to_siblings_before_ancestors(spark):
    made = [("d", "x", "s1", 10), ("d", "x", "s2", 500), ("d", "y", "s1", 1000), ("e", "x", "s1", 30), ("e", "y", None, 20)]
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.budgets(leaf(spark, made), 800, WEIGHTS).collect()}
    # e can give 50 of its 400; d gets 750, x 510 of its 562, and y the rest; in x, s2 gets what s1 lacks.
    assert got == {("e", "x", "s1"): 30, ("e", "y", None): 20, ("d", "x", "s1"): 10, ("d", "x", "s2"): 500, ("d", "y", "s1"): 240}


def test_budgets_of_more_than_there_is_and_epochs(spark):
    made = [("d", "x", "s", 10), ("e", "x", "s", 10)]
    assert [r["budget"] for r in mixing.budgets(leaf(spark, made), 1000, WEIGHTS).collect()] == [10, 10]
    assert [r["budget"] for r in mixing.budgets(leaf(spark, made), 1000, WEIGHTS, max_epochs=4).collect()] == [40, 40]
    assert mixing.budgets(leaf(spark, []), 10, WEIGHTS).count() == 0
    with pytest.raises(ValueError):
        mixing.budgets(leaf(spark, made), 10, {"domain": {"d": 0.5}})


def test_what_weight_0_leaves_goes_to_others(spark):
    made = [("D", "x", "A", 100), ("D", "x", "B", 10), ("E", "x", "C", 100), ("E", "z", "C", 70), ("F", "z", "C", 40)]
    weights = {"source": {"A": 0}, "lang": {"z": 0}}
    got = {(r["domain"], r["lang"], r["source"]): (r["supply"], r["budget"]) for r in mixing.budgets(leaf(spark, made), 100, weights).collect()}
    # D can use 10 of its share and F nothing, so E has the rest.
    assert got == {("D", "x", "A"): (100, 0), ("D", "x", "B"): (10, 10), ("E", "x", "C"): (100, 90), ("E", "z", "C"): (70, 0), ("F", "z", "C"): (40, 0)}


def poured(budget, children):
    """Pour by weight again and again, until nothing is left or all are full: {name: whole tokens} for {name: (weight, cap)}."""
    from fractions import Fraction

    have, left = dict.fromkeys(children, Fraction(0)), Fraction(budget)
    while left and (thirsty := {n: w for n, (w, cap) in children.items() if w and have[n] < cap}):
        # As much as goes until the next one is full.
        part = min([left / sum(thirsty.values()), *((children[n][1] - have[n]) / w for n, w in thirsty.items())])
        for n, w in thirsty.items():
            have[n] += part * w
        left -= part * sum(thirsty.values())
    return {n: int(x) for n, x in have.items()}


@pytest.mark.parametrize("seed", range(4))
def test_budgets_equal_pouring(spark, seed):
    from random import Random

    r = Random(seed)
    weights = {level: {f"{level[0]}{i}": r.choice([0, 1, 1, 2, 3, 7]) for i in range(4)} for level in mixing.LEVELS}
    made = [(d, x, s, r.choice([0, 1, 10, 100, 1000, 12_345])) for d in ("d0", "d1", "d2") for x in ("l0", "l1", "l2", None) for s in ("s0", "s1", "s2", "s3") if r.random() < 0.7]
    epochs, total = r.choice([1, 3]), r.choice([50, 3000, 20_000, 10**6])
    w = lambda level, name: weights[level].get(name, 1)
    # What a subtree can give: nothing of it passes a weight of 0.
    supply = {(d, x, s): n * epochs * (w("domain", d) > 0 < w("lang", x)) * (w("source", s) > 0) for d, x, s, n in made}
    below = lambda *key: sum(n for k, n in supply.items() if k[: len(key)] == key)
    expected = {}
    for d, b in poured(total, {d: (w("domain", d), below(d)) for d, *_ in made}).items():
        for x, c in poured(b, {x: (w("lang", x), below(d, x)) for e, x, *_ in made if e == d}).items():
            expected |= {(d, x, s): n for s, n in poured(c, {s: (w("source", s), below(d, x, s)) for e, y, s, _ in made if (e, y) == (d, x)}).items()}
    got = {(b["domain"], b["lang"], b["source"]): b["budget"] for b in mixing.budgets(leaf(spark, made), total, weights, 1, epochs).collect()}
    assert got == expected
    assert min(total, sum(supply.values())) - len(made) * 3 <= sum(got.values()) <= min(total, sum(supply.values()))


def test_mix_edges(spark):
    from pyspark.sql import functions as F

    schema = "doc_id long, text string, lang string, source string, budget string"
    made = [(i, "word " * (i % 7 + 1), "en" if i % 3 else None, f"src{i % 2}", "clash") for i in range(400)]
    made += [(1, None, "en", "src1", None), (None, "", "de", None, None), (5, "word", "en", "src1", "again"), (5, "word", "en", "src1", "again")]
    docs = spark.createDataFrame(made, schema)
    run = lambda epochs, part, seed=0: mixing.mix(docs, mixing.WEIGHTS, part, mixing.approx_tokens(), mixing.source_domain(), seed, epochs).collect()
    whole = run(1, (1, 1))
    assert len(whole) >= 400 and {r["n_copies"] for r in whole} == {1}
    half = run(1, (1, 2))
    total = sum(-(-len(m[1] or "") // 4) for m in made)
    taken = sum(r["n_tokens"] for r in half)
    assert total // 2 - 200 < taken <= total // 2 and len({(r["doc_id"], r["text"]) for r in half}) < 400
    assert {r["doc_id"] for r in half} != {r["doc_id"] for r in run(1, (1, 2), 9)}
    more = run(3, (2, 1))
    assert max(r["n_copies"] for r in more) == 3 and sum(r["n_tokens"] * r["n_copies"] for r in more) <= 2 * total
    assert run(1, (0, 1)) == []
    empty = mixing.mix(spark.createDataFrame([], schema), mixing.WEIGHTS, (1, 2), mixing.approx_tokens(), mixing.source_domain())
    assert empty.count() == 0 and F is not None


def test_top_k_edges(spark):
    made = [(i, [float(i % 5), 1.0]) for i in range(40)] + [(100, [1.0, 1.0])]
    df = spark.createDataFrame(made, "id long, v array<double>")
    for shard in (1, 7, 20, 1000):
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, df.where("id IN (0, 4, 100)"), 3, shard).collect())
        # Ties go to the smaller id, and a query is not its own neighbour.
        assert got == [(0, 1, 1, 1), (0, 2, 2, 1), (0, 3, 3, 1), (4, 1, 9, 17), (4, 2, 14, 17), (4, 3, 19, 17), (100, 1, 4, 5), (100, 2, 9, 5), (100, 3, 14, 5)]
    few = topk.top_k(df.where("id < 3"), df.where("id = 0"), 10)
    assert [r["rank"] for r in few.collect()] == [1, 2]
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0
    assert topk.top_k(df, df.where("false")).count() == 0


def brute_top_k(vectors, queries, k):
    out = []
    for q, v in queries.items():
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in vectors.items() if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_of_clusters_copies_and_lengths(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(4)
    centers = r.integers(-1000, 1000, (5, 6))
    rows = [centers[i % 5] + r.integers(-20, 20, 6) for i in range(600)] + [centers[0]] * 300 + list(r.integers(-9, 9, (40, 3))) + [np.array([7])]
    vectors = {i: [float(x) for x in v] for i, v in enumerate(rows)}
    df = spark.createDataFrame(list(vectors.items()), "id long, v array<double>")
    queries = {i: v for i, v in vectors.items() if i % 11 == 0 or i >= 938} | {5000: [1.0, 2.0], 5001: [0.0] * 6}
    asked = spark.createDataFrame(list(queries.items()), "id long, v array<double>")
    for sample, shard in ((1 << 14, 100), (40, 30)):  # a sample that may lack a length, too
        monkeypatch.setattr(topk, "SAMPLE", sample)
        got = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.top_k(df, asked, 7, shard).collect())
        assert got == brute_top_k(vectors, queries, 7)


def test_top_k_skips_regions_that_cannot_reach(spark):
    import numpy as np

    r = np.random.default_rng(5)
    # Directions far apart: the best of a cluster are in it, and no other box can reach their scores.
    corners = 1000.0 * np.array([[-1, -1, 0], [-1, 1, 0], [1, -1, 0], [1, 1, 0]])
    points = np.array([corners[i % 4] + r.integers(0, 10, 3) for i in range(4000)])
    regions = topk.Regions.of(list(points[:512]), 128)
    own = regions.find(points)
    assert len(set(own.tolist())) >= 4 and all(len(set((np.flatnonzero(own == x) % 4).tolist())) == 1 for x in set(own.tolist()))
    asked = points[:8]
    kth = np.sort(asked @ points.T, 1)[:, -10]
    reach = {(i, x) for x in set(own.tolist()) for i, q in enumerate(asked) if np.maximum(q * points[own == x].min(0), q * points[own == x].max(0)).sum() >= kth[i]}
    assert len(reach) <= len(asked) * len(set(own.tolist())) / 2


def test_top_k_of_too_large_components(spark):
    df = spark.createDataFrame([(0, [2.0**30, 1.0]), (1, [2.0**30, 0.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="2.53"):
        topk.top_k(df, df, 1).collect()


def test_top_k_query_leaves_out_what_is_no_vector(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    made = [(0, [1.0, 0.5], 1), (100, [-0.25, 0.0004], 1), (1, None, 1), (2, [nan, 1.0], 1), (3, [inf, 1.0], 1), (4, [None, 1.0], 1), (5, [0.0, 0.0], 1), (None, [1.0, 1.0], 1), (200, None, 1), (6, [], 1), (7, [5.0], 1), (300, [5.0, 5.0, 5.0], 1)]
    spark.createDataFrame(made, "vec_id long, embedding array<float>, rank int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, topk.op4_top_k(spark, str(tmp_path)).collect()))
    assert got == [(0, 1, 5, 0), (0, 2, 100, -262144), (100, 1, 5, 0), (100, 2, 0, -262144)]
