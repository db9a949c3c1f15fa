"""The queries over whole raw documents against brute force."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest

import __spark_entry__
from tests.test_operators import _distance, _greedy, _quality, rows

QUERIES = __spark_entry__.queries()
P = dict(beta=8, sigma=50, length=4, mu=0.52, epsilon=0.22)
RARE = P | dict(beta=2, sigma=3)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdéßжλ") for _ in range(rng.randint(1, 7))) for _ in range(45)] + ["490-46-2048", "it's", "x,y", "2048", "naïve-été"]
    texts = [" ".join(rng.choice(vocab) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(4, 16))) for _ in range(14)]
    texts += texts[:4] + [t.replace("a", "b", 1) for t in texts[4:8]] + ["", "--", "490-46-2048,anne-marie"]
    texts += [t for k in range(5) for t in (f"öst{k}ab öst{k}cd vi{k}le mu{k}bd", f"öst{k}cd vi{k}el öst{k}ab mu{k}db")]  # rare tokens
    docs = list(enumerate(texts)) + [(len(texts), None)]
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{sf}/documents.parquet")
    return sf, docs


def _lists(docs, compress=False):
    """Distinct tokens of each document, in order."""
    out = {}
    for d, t in docs:
        t = (t or "").upper()
        toks = [re.sub(r"\W", "", x) for x in re.split(r"[ \t\r\n]+", t.replace(",", " "))] if compress else re.findall(r"\w+", t)
        out[str(d)] = list(dict.fromkeys(x for x in toks if x))
    return out


def _candidates(lists, least=2, P=P):
    freq = Counter(t for l in lists.values() for t in l)
    key = {r: {t for t in l if 2 <= freq[t] <= P["beta"] and len(t) >= P["length"] and not re.fullmatch("[0-9]+", t)} for r, l in lists.items()}
    compared = {r: [t for t in l if freq[t] < P["sigma"] and len(t) >= P["length"] and not re.fullmatch("[0-9]+", t)] for r, l in lists.items()}
    return [(a, b) for a, b in combinations(sorted(lists), 2) if len(key[a] & key[b]) >= least], compared


def _matrix(a, b):
    return [[1.0 if x == y else 1 - _distance(x, y) / max(len(x), len(y)) for y in b] for x in a]


def _score(name, a, b):
    if not a or not b:
        return 0.0
    if name == "score_cosine":
        return len(set(a) & set(b)) / (len(a) * len(b)) ** 0.5
    sim = _matrix(a, b)
    if name == "score_monge_elkan":
        return sum(map(max, sim)) / len(sim)
    if name == "score_std":
        return sum(s for _, s in _greedy(sim)) / min(len(a), len(b))
    short = sim if len(a) <= len(b) else [list(c) for c in zip(*sim)]
    m = len(short)
    return sum(s * (m - r) / (m * (m + 1) / 2) for r, s in _greedy(short))


def _components(ids, links):
    root = {r: r for r in ids}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in {r for l in links for r in l}}


@pytest.mark.parametrize("name", ["score_std", "score_kris", "score_cosine", "score_monge_elkan"])
def test_documents_are_scored(spark, corpus, name):
    pairs, compared = _candidates(_lists(corpus[1]), P=P if name == "score_cosine" else RARE)
    got = {(r.r1, r.r2): r.score for r in QUERIES[f"documents_{name}"](spark, corpus[0]).collect()}
    assert len(pairs) > 3 and sorted(got) == pairs
    assert got == {(a, b): pytest.approx(_score(name, compared[a], compared[b]), abs=1e-6) for a, b in pairs}


def test_documents_are_resolved(spark, corpus):
    sf, docs = corpus
    lists = _lists(docs)
    pairs, compared = _candidates(lists)
    links = [(a, b) for a, b in pairs if _score("score_cosine", compared[a], compared[b]) >= P["mu"]]
    member = _components(lists, links)
    assert dict(rows(QUERIES["documents_connected_components"](spark, sf))) == member
    quality = {c: _quality([lists[r] for r in member if member[r] == c]) for c in set(member.values())}
    assert {r.cluster_id: r.quality for r in QUERIES["documents_cluster_quality"](spark, sf).collect()} == {c: pytest.approx(q, abs=1e-6) for c, q in quality.items()}
    index = {r: member[r] if r in member and quality[member[r]] >= P["epsilon"] else r for r in lists if lists[r]}
    assert dict(rows(QUERIES["documents_linked_index_one_pass"](spark, sf))) == index
    text = {str(d): t or "" for d, t in docs}
    both = list(combinations(index, 2))
    linked, same = ({x for x in both if of[x[0]] == of[x[1]]} for of in (index, text))
    m = QUERIES["documents_er_matrix"](spark, sf).first()
    assert len(same) >= 4 and (m.d, m.l, m.e, m.tp) == (len(both), len(linked), len(same), len(linked & same))


def test_documents_resolution_loop(spark, corpus):
    """Copies end in one cluster, and the statistics count every iteration's links."""
    index = dict(rows(QUERIES["documents_linked_index"](spark, corpus[0])))
    lists = _lists(corpus[1])
    assert set(index) == {r for r in lists if lists[r]}
    stats = [r for r in QUERIES["documents_run_stats"](spark, corpus[0]).collect() if r.iteration]
    pairs, compared = _candidates(lists)
    assert stats[0].candidate_pairs == len(pairs) and stats[0].links == sum(_score("score_cosine", compared[a], compared[b]) >= P["mu"] for a, b in pairs)


def test_tokens_of_documents_keep_letters_outside_ascii(spark, corpus):
    sf, docs = corpus
    lists = _lists(docs)
    assert any(re.search("[^\x00-\x7f]", t) for l in lists.values() for t in l)
    toks = [(r, i, t) for r, l in lists.items() for i, t in enumerate(l, 1)]
    freq = Counter(t for _, _, t in toks)
    assert rows(QUERIES["tokenize_splitter"](spark, sf)) == sorted(toks, key=repr)
    assert dict(rows(QUERIES["token_frequency"](spark, sf))) == freq
    assert rows(QUERIES["reformed_refs"](spark, sf)) == sorted(((r, i, t, freq[t]) for r, i, t in toks), key=repr)
    named = sorted((r, t) for r, _, t in toks if 2 <= freq[t] <= P["beta"] and len(t) >= P["length"] and not re.fullmatch("[0-9]+", t))
    assert sorted((r.ref_id, r.tok) for r in QUERIES["blocking_tokens"](spark, sf).collect()) == named
    assert sorted((r.ref_id, r.t1) for r in QUERIES["block_keys_single"](spark, sf).collect()) == named
    for name, least in (("single", 1), ("by_pairs", 2)):
        assert rows(QUERIES[f"candidate_pairs_{name}"](spark, sf)) == sorted(_candidates(lists, least)[0])
    stats = QUERIES["tokenization_stats"](spark, sf).first()
    assert (stats.refs_read, stats.tokens_left, stats.unique_tokens) == (len(docs), len(toks), len(freq))
    assert QUERIES["token_frequency_stats"](spark, sf).first().max_freq == max(freq.values())
    assert QUERIES["blocking_stats"](spark, sf).first().unique_pairs == len(_candidates(lists)[0])


def test_compress_joins_parts_of_tokens_of_documents(spark, corpus):
    sf, docs = corpus
    got = rows(QUERIES["tokenize_compress"](spark, sf))
    assert got == sorted(((r, i, t) for r, l in _lists(docs, compress=True).items() for i, t in enumerate(l, 1)), key=repr)
    assert {"490462048", "ITS", "ANNEMARIE", "NAÏVEÉTÉ"} <= {t for _, _, t in got} and got != rows(QUERIES["tokenize_splitter"](spark, sf))


def test_pair_keys_and_token_pairs_of_documents(spark, corpus):
    sf, docs = corpus
    lists = _lists(docs)
    freq = Counter(t for l in lists.values() for t in l)
    key = {r: [t for t in l if 2 <= freq[t] <= P["beta"] and len(t) >= P["length"] and not re.fullmatch("[0-9]+", t)] for r, l in lists.items()}
    got = sorted((r.t1, r.t2, r.ref_id) for r in QUERIES["documents_block_keys_pairs"](spark, sf).collect())
    assert got == sorted((*sorted(c), r) for r, l in key.items() for c in combinations(l, 2))
    pairs, compared = _candidates(lists, P=RARE)
    want = {(x, y): 1 - _distance(x, y) / max(len(x), len(y)) for a, b in pairs for x in compared[a] for y in compared[b]}
    assert {(r.t1, r.t2): r.similarity for r in QUERIES["documents_token_pair_similarity"](spark, sf).collect()} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
