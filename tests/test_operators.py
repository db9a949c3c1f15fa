import random
from collections import defaultdict
from dataclasses import replace
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.config import Parameters
from kinfold.functions.similarity import cosine, edit_distances, matrix_kris, matrix_std, monge_elkan, token_similarity
from kinfold.functions.tokens import scoring_tokens
from kinfold.operators import blocking, evaluate, frequency, report
from kinfold.operators.components import connected_components
from kinfold.plans.resolve import resolve, run
from kinfold.sources.delimited import read_references, read_truth, rejected_lines, require_unique

P = Parameters(beta=4, sigma=9, removeDuplicateTokens=True, minBlkTokenLen=2)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def refs(spark, data):
    return spark.createDataFrame(data, "ref_id string, body string")


def test_tokenizers(spark):
    r = refs(spark, [("1", "490-46-2048, Anne-marie"), ("2", " ,, "), ("3", "été x ÉTÉ")])
    split = frequency.tokens(r, replace(P, removeDuplicateTokens=False))

    got = {(a, b): c for a, b, c in rows(split)}
    assert [got["1", i] for i in range(1, 6)] == ["490", "46", "2048", "ANNE", "MARIE"]
    assert [got["3", i] for i in (1, 2, 3)] == ["ÉTÉ", "X", "ÉTÉ"]
    packed = {(a, b): c for a, b, c in rows(frequency.tokens(r, replace(P, tokenizerType="Compress")))}
    assert packed["1", 1] == "490462048" and packed["1", 2] == "ANNEMARIE" and ("2", 1) not in packed
    assert packed["3", 2] == "X" and ("3", 3) not in packed
    with pytest.raises(ValueError):
        frequency.tokens(r, replace(P, tokenizerType="None"))


def test_statistics(spark):
    r = refs(spark, [("1", "a b b 12"), ("2", "b c"), ("3", "--")])
    s = frequency.tokenization_stats(r, P).first()
    assert (s.refs_read, s.tokens_found, s.tokens_left, s.numeric_tokens, s.duplicate_tokens, s.unique_tokens, s.refs_without_tokens) == (3, 6, 5, 1, 1, 4, 1)
    f = frequency.frequency_stats(frequency.token_frequency(frequency.tokens(r, P))).first()
    assert f.max_freq == 2 and f.mean_freq == 1.25


def _blocks_by_hand(lists, p):
    freq = defaultdict(int)
    for toks in lists.values():
        for t in toks:
            freq[t] += 1
    ok = lambda t: 2 <= freq[t] <= p.beta and len(t) >= p.minBlkTokenLen and not (p.excludeNumericBlocks and t.isdigit())
    keys = defaultdict(set)
    for r, toks in lists.items():
        b = [t for t in toks if ok(t)]
        if p.blockByPairs:
            for i in range(len(b)):
                for j in range(i + 1, len(b)):
                    keys[tuple(sorted((b[i], b[j])))].add(r)
        else:
            for t in b:
                keys[t].add(r)
    return sorted({(x, y) for ids in keys.values() for x in ids for y in ids if x < y})


@pytest.mark.parametrize("pairs", [True, False])
@pytest.mark.parametrize("dedup", [True, False])
def test_blocking_equals_keys_made_by_hand(spark, pairs, dedup):
    rng = random.Random(5)
    p = replace(P, blockByPairs=pairs, removeDuplicateTokens=dedup, beta=6)
    data = [(f"A{i}", " ".join(rng.choice(["AB", "CDE", "ABC", "DE", "FG", "12", "HI", "JK", "LM", "x"]) for _ in range(rng.randint(0, 6)))) for i in range(25)]
    made = frequency.reform(frequency.tokens(refs(spark, data), p))
    lists = {r.ref_id: [t.tok for t in r.toks] for r in made.collect()}
    assert rows(blocking.candidate_pairs(made, p)) == _blocks_by_hand(lists, p)
    stats = blocking.blocking_stats(made, p).first()
    assert stats.unique_pairs == len(_blocks_by_hand(lists, p)) and stats.refs == len(lists)
    if pairs:
        assert blocking.block_keys_pairs(made, p).count() == stats.blocking_records


def test_stop_words(spark):
    r = spark.createDataFrame([("1", [(1, "THE", 9), (2, "X", 1), (3, "123", 2), (4, "ANNA", 8), (5, "ANNA", 8)])], "ref_id string, toks array<struct<pos:int,tok:string,freq:bigint>>")
    one = lambda p: r.select(scoring_tokens(F.col("toks"), p).alias("l")).first().l
    assert one(P) == ["ANNA"]
    assert one(replace(P, removeDuplicateTokens=False)) == ["ANNA", "ANNA"]
    assert one(replace(P, removeExcludedBlkTokens=False)) == ["X", "123", "ANNA"]


def _distance(a, b):
    """The general distance by the recurrence over last occurrences."""
    inf, d = len(a) + len(b), {}
    d[-1, -1] = inf
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = inf, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = inf, j
    seen = {}
    for i in range(1, len(a) + 1):
        col = 0
        for j in range(1, len(b) + 1):
            k, c = seen.get(b[j - 1], 0), col
            cost = a[i - 1] != b[j - 1]
            col = col if cost else j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, c - 1] + (i - k - 1) + 1 + (j - c - 1))
        seen[a[i - 1]] = i
    return d[len(a), len(b)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ABC", max_size=7), st.text("ABC", max_size=7)), min_size=1, max_size=8))
def test_edit_distance(pairs):
    assert edit_distances([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [_distance(a, b) for a, b in pairs]


def test_edit_distance_forms():
    assert edit_distances(["CA", "", ""], ["ABC", "A", ""]).tolist() == [2, 1, 0]
    assert edit_distances(["CA"], ["ABC"], restricted=True).tolist() == [3]


def _greedy(sim):
    m = [list(r) for r in sim]
    out = []
    for _ in range(min(len(m), len(m[0]))):
        best, at = -1, None
        for i, r in enumerate(m):
            for j, v in enumerate(r):
                if v > best:
                    best, at = v, (i, j)
        out.append((at[0], best))
        for j in range(len(m[0])):
            m[at[0]][j] = -1
        for r in m:
            r[at[1]] = -1
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5).flatmap(lambda w: st.lists(st.lists(st.sampled_from([0.0, 0.25, 0.5, 1.0]), min_size=w, max_size=w), min_size=1, max_size=5)))
def test_matrix_scores(sim):
    import numpy as np

    x = np.array(sim)
    picks = _greedy(sim)
    assert matrix_std(x) == pytest.approx(sum(s for _, s in picks) / len(picks))
    short = sim if len(sim) <= len(sim[0]) else [list(c) for c in zip(*sim)]
    m = len(short)
    assert matrix_kris(x) == pytest.approx(sum(s * (m - r) / (m * (m + 1) / 2) for r, s in _greedy(short)))
    assert monge_elkan(x) == pytest.approx(sum(max(r) for r in sim) / len(sim))


def test_token_rules(spark):
    pairs = spark.createDataFrame([("12", "13"), ("12", "12"), ("A", "AB"), ("ABCD", "ABDC")], "a string, b string")
    score = lambda p: [r.s for r in pairs.select(token_similarity(p)(F.col("a"), F.col("b")).alias("s")).collect()]
    assert score(P) == [0.5, 1.0, 0.5, 0.75]
    assert score(replace(P, matrixNumTokenRule=True, matrixInitialRule=True)) == [0.0, 1.0, 0.0, 0.75]


def test_cosine_counts_repeats(spark):
    df = spark.createDataFrame([(["A", "A", "B"], ["A", "A", "A", "C"])], "a array<string>, b array<string>")
    assert df.select(cosine(F.col("a"), F.col("b")).alias("s")).first().s == pytest.approx(2 / 12**0.5)
    assert df.select(cosine(F.array_distinct("a"), F.array_distinct("b"), True).alias("s")).first().s == 0.5


def test_hot_tokens_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(frequency, "HOT_TOKENS", 3)
    data = [(f"{i}", "the " * (i % 2) + f"w{i % 7}") for i in range(40)]
    got = frequency.with_frequency(frequency.tokens(refs(spark, data), replace(P, removeDuplicateTokens=False)))
    count = defaultdict(int)
    for _, t in data:
        for x in t.upper().split():
            count[x] += 1
    assert rows(got.select("tok", "freq").distinct()) == sorted(count.items(), key=repr) and got.count() == sum(count.values())


def test_components_are_labelled_by_the_smallest_id(spark):
    rng = random.Random(1)
    edges = [(f"A{rng.randint(0, 60)}", f"A{rng.randint(0, 60)}") for _ in range(45)] + [(f"B{i}", f"B{i + 1}") for i in range(12)] + [("C", "C")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = rows(connected_components(spark.createDataFrame(edges, "r1 string, r2 string")))
    assert got == sorted(((x, find(x)) for x in parent), key=repr)
    assert connected_components(spark.createDataFrame([], "r1 string, r2 string")).count() == 0


def _quality(members):
    """Entropy quality by taking matching occurrences off the lists one at a time."""
    import math

    n, total, entropy = len(members), sum(map(len, members)), 0.0
    if n == 1:
        return 1.0
    left = [list(m) for m in members]
    for i in range(n):
        while left[i]:
            tok, c = left[i][0], 0
            for other in left:
                if tok in other:
                    other.remove(tok)
                    c += 1
            entropy -= c / n * math.log2(c / n)
    return 1 - entropy / (total * math.log2(n) / n)


def test_quality(spark):
    rng = random.Random(4)
    lists = {f"R{i}": [rng.choice("ABCDE") for _ in range(rng.randint(1, 5))] for i in range(12)}
    made = spark.createDataFrame([(r, [(i + 1, t, 1) for i, t in enumerate(x)]) for r, x in lists.items()], "ref_id string, toks array<struct<pos:int,tok:string,freq:bigint>>")
    members = spark.createDataFrame([(r, "R0" if i < 5 else "R5") for i, r in enumerate(lists)], "ref_id string, cluster_id string")
    got = {r.cluster_id: r.quality for r in evaluate.cluster_quality(members, made, 0.3).collect()}
    names = list(lists)
    assert got["R0"] == pytest.approx(_quality([lists[r] for r in names[:5]]))
    assert got["R5"] == pytest.approx(_quality([lists[r] for r in names[5:]]))


def test_er_matrix(spark):
    index = spark.createDataFrame([("1", "1"), ("2", "1"), ("3", "3"), ("4", "3"), ("5", "5"), ("9", "9")], "ref_id string, cluster_id string")
    truth = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "x"), ("4", "y"), ("5", "y")], "ref_id string, truth_id string")
    m = report.er_matrix(index, truth).first()
    assert (m.d, m.l, m.e, m.tp, m.fp, m.fn, m.tn) == (10, 2, 4, 1, 1, 3, 5)
    assert (m.precision, m.recall, m.f) == (0.5, 0.25, 0.3333)
    none = report.er_matrix(index, truth.where("false")).first()
    assert none.d == 0 and none.precision is None and none.f is None


PEOPLE = """RecID,fname,lname,address,city
a1,Mary,Hollister,12 Birchwood Lane,Springdale
A2,MARY,Holister,12 Birchwood  Lane,Springdale
A10,Peter,Quackenbush,77 Elderberry Road,Fairmont
A11,Peter,Quackenbush,77 Elderbery Road,Fairmont
A12,Zoe,Unmatched,1 Nowhere,Elsewhere
no delimiter here
A13,,,,
"""


@pytest.fixture
def people(tmp_path):
    (tmp_path / "people.txt").write_text(PEOPLE)
    (tmp_path / "truth.txt").write_text("RecID,idtruth\na1,1\nA2,1\nA10,2\nA11,2\nA12,3\n")
    parms = f"inputFileName={tmp_path}/people.txt\nhasHeader=True\nbeta=4\nsigma=9\nminBlkTokenLen=3\nremoveDuplicateTokens=True\nmu=0.6\nmuIterate=0.1\nepsilon=0.2\n"
    parms += f"comparator=ScoringMatrixKris\ntruthFileName={tmp_path}/truth.txt\nrunIterationProfile=True\naddRefsToLinkIndex=True\n"
    (tmp_path / "parms.txt").write_text(parms)
    return tmp_path


def test_sources(spark, people):
    p = Parameters(hasHeader=True)
    got = rows(read_references(spark, f"{people}/people.txt", p))
    assert got[0][0] == "A1" and ("A13", ",,,") in got and len(got) == 6
    assert rows(rejected_lines(spark, f"{people}/people.txt", p)) == [("no delimiter here",)]
    assert rows(read_truth(spark, f"{people}/truth.txt"))[0] == ("A1", "1")
    with pytest.raises(ValueError):
        require_unique(spark.createDataFrame([("1", ""), ("1", "")], "ref_id string, body string"))


def test_run_end_to_end(spark, people):
    out = f"{people}/out"
    result = run(spark, f"{people}/parms.txt", out)
    assert rows(result.index) == [("A1", "A1"), ("A10", "A10"), ("A11", "A10"), ("A12", "A12"), ("A2", "A1")]
    m = spark.read.parquet(f"{out}/er_matrix").first()
    assert (m.tp, m.fp, m.fn, m.f) == (2, 0, 0, 1.0) and m.d == m.tp + m.fp + m.fn + m.tn
    assert "A2 * A1" in {r.value for r in spark.read.text(f"{out}/linked_index_text").collect()}
    assert {"ref_id", "cluster_id", "body"} == set(spark.read.parquet(f"{out}/linked_index").columns)
    assert spark.read.parquet(f"{out}/frequency_stats").first().max_freq == 2
    assert ("mu", "0.6") in rows(spark.read.parquet(f"{out}/parameters"))
    assert "links: 2" in {r.value for r in spark.read.text(f"{out}/log").collect()}
    stats = [r.asDict() for r in spark.read.parquet(f"{out}/run_stats").collect()]
    assert any(s["iteration"] is None for s in stats)


def test_loop_stops_without_candidates_or_links(spark):
    p = replace(P, mu=Decimal("0.9"))
    alone = resolve(refs(spark, [("1", "ab cd"), ("2", "ef gh")]), p)
    assert rows(alone.index) == [("1", "1"), ("2", "2")] and not alone.iterations
    apart = resolve(refs(spark, [("1", "same word alpha beta gamma"), ("2", "same word delta zeta eta")]), p)
    assert rows(apart.index) == [("1", "1"), ("2", "2")] and apart.iterations[-1]["links"] == 0


def test_order_and_partitions_do_not_matter(spark):
    rng = random.Random(9)
    words = ["ALPHA", "BRAVO", "CHARLY", "DELTA", "ECHO", "FOXTROT"]
    data = [(f"{i}", " ".join(rng.sample(words, 4))) for i in range(15)]
    p = replace(P, beta=15, sigma=16, mu=Decimal("0.7"), epsilon=Decimal("0.3"))
    one = rows(resolve(refs(spark, data), p).index)
    rng.shuffle(data)
    two = resolve(refs(spark, data).repartition(3), p)
    assert rows(two.index) == one
    assert all(c == min(r for r, k in one if k == c) for _, c in one)
