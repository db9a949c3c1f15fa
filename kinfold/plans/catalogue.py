"""The registered queries of the resolution engine, with their DuckDB SQL.

All see whole raw texts of whole tables. Tokenization, frequencies, blocking and
candidates run over ``documents``; scoring, links, quality, the loop and accuracy
over ``benchmark`` and, as ``documents_`` queries, over ``documents`` too, where
links come from the cosine of token lists. The queries named ``_repeats`` keep
repeated tokens, ``score_std_rules`` compares numbers and initials by equality.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.config import Parameters
from kinfold.functions.similarity import token_similarity
from kinfold.functions.tokens import scoring_tokens
from kinfold.operators import blocking, evaluate, frequency, report, scoring
from kinfold.plans.resolve import prepare, resolve, scored_candidates
from kinfold.sources.delimited import from_table

DOCS = Parameters(beta=8, sigma=50, removeDuplicateTokens=True)
ITEMS = Parameters(beta=16, sigma=20, removeDuplicateTokens=True, mu=Decimal("0.52"), muIterate=Decimal("0.04"), epsilon=Decimal("0.22"), comparator="ScoringMatrixKris")
REPEATS = replace(ITEMS, removeDuplicateTokens=False, comparator="Cosine", mu=Decimal("0.10"))
RULES = replace(ITEMS, removeExcludedBlkTokens=False, matrixNumTokenRule=True, matrixInitialRule=True, comparator="ScoringMatrixStd")
WHOLE = replace(ITEMS, beta=DOCS.beta, sigma=DOCS.sigma, comparator="Cosine")
RARE = replace(WHOLE, beta=2, sigma=3)  # what the matrix comparators see of documents: a matrix has a cell for each two tokens


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return from_table(spark.read.parquet(f"{sf}/documents.parquet"), F.col("doc_id"), F.col("text"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    return from_table(spark.read.parquet(f"{sf}/benchmark.parquet"), F.col("item_id"), F.col("text"))


def item_truth(spark: SparkSession, sf: str) -> DataFrame:
    item = F.col("item_id")
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(item.cast("string").alias("ref_id"), F.floor(item / 4).cast("string").alias("truth_id"))


def copy_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with identical texts are one, named by the smallest id."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"))
    least = docs.groupBy("text").agg(F.min("doc_id").alias("least"))
    return docs.join(least, "text").select(F.col("doc_id").cast("string").alias("ref_id"), F.col("least").cast("string").alias("truth_id"))


@dataclass(frozen=True)
class View:
    """References of a table, the parameters they are resolved with, and their truth."""

    references: Callable[[SparkSession, str], DataFrame]
    p: Parameters
    truth: Callable[[SparkSession, str], DataFrame] | None = None


DOCS_VIEW = View(documents, DOCS)
ITEMS_VIEW = View(items, ITEMS, item_truth)
REPEATS_VIEW = View(items, REPEATS, item_truth)
RULES_VIEW = View(items, RULES, item_truth)
WHOLE_VIEW = View(documents, WHOLE, copy_truth)
RARE_VIEW = View(documents, RARE, copy_truth)


def _refs(v, spark, sf):
    return prepare(v.references(spark, sf), v.p)


def tokenize(v: View, tokenizer: str) -> Callable:
    return lambda spark, sf: frequency.tokens(v.references(spark, sf), replace(v.p, tokenizerType=tokenizer))


def token_frequency(v, spark, sf):
    return frequency.token_frequency(frequency.tokens(v.references(spark, sf), v.p))


def tokenization_stats(v, spark, sf):
    return frequency.tokenization_stats(v.references(spark, sf), v.p)


def frequency_stats(v, spark, sf):
    return frequency.frequency_stats(token_frequency(v, spark, sf)).select("max_freq", F.round("mean_freq", 6).alias("mean_freq"), F.round("stdev_freq", 6).alias("stdev_freq"))


def reformed_refs(v, spark, sf):
    return _refs(v, spark, sf).select("ref_id", F.explode("toks").alias("t")).select("ref_id", "t.pos", "t.tok", "t.freq")


def blocking_tokens(v, spark, sf):
    return blocking.blocking_tokens(_refs(v, spark, sf), v.p).select("ref_id", "tok", "times")


def block_keys_single(v, spark, sf):
    return blocking.block_keys_single(_refs(v, spark, sf), v.p).select("t1", "ref_id")


def block_keys_pairs(v, spark, sf):
    return blocking.block_keys_pairs(_refs(v, spark, sf), v.p)


def candidates(v: View, pairs: bool) -> Callable:
    return lambda spark, sf: blocking.candidate_pairs(_refs(v, spark, sf), replace(v.p, blockByPairs=pairs))


def blocking_stats(v, spark, sf):
    return blocking.blocking_stats(_refs(v, spark, sf), v.p)


def stopword_filter(v, spark, sf):
    return _refs(v, spark, sf).select("ref_id", F.posexplode(scoring_tokens(F.col("toks"), v.p)).alias("at", "tok")).select("ref_id", (F.col("at") + 1).alias("pos"), "tok")


def token_pair_similarity(v, spark, sf):
    """Similarities between the distinct compared tokens of candidate pairs."""
    refs = prepare(v.references(spark, sf), v.p)
    both = scoring.pair_refs(blocking.candidate_pairs(refs, v.p), refs, v.p)
    pairs = both.select(F.explode("l1").alias("t1"), "l2").select("t1", F.explode("l2").alias("t2")).distinct()
    p = replace(v.p, matrixNumTokenRule=True, matrixInitialRule=True)
    return pairs.select("t1", "t2", F.round(token_similarity(p)(F.col("t1"), F.col("t2")), 6).alias("similarity"))


def score(v: View, comparator: str) -> Callable:
    p = replace(v.p, comparator=comparator)
    return lambda spark, sf: scored_candidates(prepare(v.references(spark, sf), p), p).withColumn("score", F.round("score", 6))


def _first_pass(v, spark, sf):
    refs = prepare(v.references(spark, sf), v.p)
    links = scoring.links(scored_candidates(refs, v.p), float(v.p.mu))
    return refs, links


def linked_pairs(v, spark, sf):
    return _first_pass(v, spark, sf)[1].select("r1", "r2", F.round("score", 6).alias("score"))


def connected_components(v, spark, sf):
    return evaluate.clusters(_first_pass(v, spark, sf)[1])


def cluster_members(v, spark, sf):
    refs, links = _first_pass(v, spark, sf)
    return evaluate.clusters(links).join(refs, "ref_id").select("ref_id", "cluster_id", F.size("toks").alias("n_tokens"))


def unprocessed_refs(v, spark, sf):
    refs, links = _first_pass(v, spark, sf)
    return evaluate.unprocessed(refs, evaluate.clusters(links)).select("ref_id", F.size("toks").alias("n_tokens"))


def _quality(v, spark, sf):
    refs, links = _first_pass(v, spark, sf)
    members = evaluate.clusters(links)
    return refs, members, evaluate.cluster_quality(members, refs, float(v.p.epsilon))


def cluster_quality(v, spark, sf):
    q = _quality(v, spark, sf)[2]
    return q.select("cluster_id", "n_refs", "n_tokens", F.round("entropy", 6).alias("entropy"), F.round("quality", 6).alias("quality"), "is_good")


def split(v: View, good: bool) -> Callable:
    def query(spark, sf):
        _, members, q = _quality(v, spark, sf)
        return evaluate.split_members(members, q, good)

    return query


def linked_index_one_pass(v, spark, sf):
    refs, members, q = _quality(v, spark, sf)
    return report.linked_index(refs, evaluate.split_members(members, q, True))


def linked_index(v, spark, sf):
    return resolve(v.references(spark, sf), v.p).index


def cluster_profile(v, spark, sf):
    return report.cluster_profile(linked_index_one_pass(v, spark, sf))


def er_matrix(v, spark, sf):
    return report.er_matrix(linked_index_one_pass(v, spark, sf), v.truth(spark, sf))


def run_stats(v, spark, sf):
    return resolve(v.references(spark, sf), v.p).run_stats(spark)


def _pair_queries(v: View) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "stopword_filter": partial(stopword_filter, v),
        "score_cosine": score(v, "Cosine"),
        "linked_pairs": partial(linked_pairs, v),
        "connected_components": partial(connected_components, v),
        "cluster_members": partial(cluster_members, v),
        "unprocessed_refs": partial(unprocessed_refs, v),
        "cluster_quality": partial(cluster_quality, v),
        "good_clusters": split(v, True),
        "bad_clusters": split(v, False),
        "linked_index_one_pass": partial(linked_index_one_pass, v),
        "linked_index": partial(linked_index, v),
        "cluster_profile": partial(cluster_profile, v),
        "er_matrix": partial(er_matrix, v),
        "run_stats": partial(run_stats, v),
    }


def _matrix_queries(v: View) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "token_pair_similarity": partial(token_pair_similarity, v),
        "score_std": score(v, "ScoringMatrixStd"),
        "score_kris": score(v, "ScoringMatrixKris"),
        "score_monge_elkan": score(v, "MongeElkan"),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    once = {
        "tokenize_splitter": tokenize(DOCS_VIEW, "Splitter"),
        "tokenize_compress": tokenize(DOCS_VIEW, "Compress"),
        "token_frequency": partial(token_frequency, DOCS_VIEW),
        "token_frequency_repeats": partial(token_frequency, View(documents, replace(DOCS, removeDuplicateTokens=False))),
        "tokenization_stats": partial(tokenization_stats, DOCS_VIEW),
        "token_frequency_stats": partial(frequency_stats, DOCS_VIEW),
        "reformed_refs": partial(reformed_refs, DOCS_VIEW),
        "blocking_tokens": partial(blocking_tokens, DOCS_VIEW),
        "block_keys_single": partial(block_keys_single, DOCS_VIEW),
        "block_keys_pairs": partial(block_keys_pairs, ITEMS_VIEW),
        "candidate_pairs_single": candidates(DOCS_VIEW, False),
        "candidate_pairs_by_pairs": candidates(DOCS_VIEW, True),
        "blocking_stats": partial(blocking_stats, DOCS_VIEW),
        "score_std_rules": score(RULES_VIEW, "ScoringMatrixStd"),
        "score_cosine_repeats": score(REPEATS_VIEW, "Cosine"),
        "candidate_pairs_repeats": candidates(REPEATS_VIEW, True),
        "cluster_quality_repeats": partial(cluster_quality, REPEATS_VIEW),
    }
    whole = _pair_queries(WHOLE_VIEW) | _matrix_queries(RARE_VIEW) | {"block_keys_pairs": partial(block_keys_pairs, WHOLE_VIEW)}
    return once | _pair_queries(ITEMS_VIEW) | _matrix_queries(ITEMS_VIEW) | {f"documents_{name}": query for name, query in whole.items()}


# --- DuckDB SQL ----------------------------------------------------------

SPLIT = "string_split(upper(regexp_replace(replace(text, 'ß', 'SS'), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' ')"
COMPRESS = "list_transform(string_split_regex(upper(replace(replace(text, 'ß', 'SS'), ',', ' ')), '[ \\t\\n\\f\\r\\v]+'), lambda x: regexp_replace(x, '[^\\p{L}\\p{N}_]+', '', 'g'))"


def _view(ref_id: str, table: str, p: Parameters, found: str = SPLIT) -> str:
    """CTEs: refs0 (all tokens found), toks (ref_id, pos, tok), freq, ref (with freq), btok (blocking tokens), shared (by pair)."""
    kept = "select ref_id, tok, min(i) as i from occ group by all" if p.removeDuplicateTokens else "select ref_id, tok, i from occ"
    return f"""with recursive
refs0 as (select cast({ref_id} as varchar) as ref_id, coalesce(list_filter({found}, lambda x: length(x) > 0), []) as found from {table}),
occ as (select ref_id, unnest(found) as tok, unnest(range(1, len(found) + 1)) as i from refs0),
firsts as ({kept}),
toks as (select ref_id, cast(row_number() over (partition by ref_id order by i) as int) as pos, tok from firsts),
freq as (select tok, count(*) as freq from toks group by tok),
ref as materialized (select ref_id, pos, tok, freq from toks join freq using (tok)),
btok as materialized (select ref_id, tok, count(*) as times from ref where freq between 2 and {p.beta} and length(tok) >= {p.minBlkTokenLen} and not regexp_full_match(tok, '[0-9]+') group by all),
shared as materialized (select a.ref_id as r1, b.ref_id as r2, sum(least(a.times, b.times))::bigint as shared from btok a join btok b on a.tok = b.tok and a.ref_id < b.ref_id group by all)"""


def _lists(p: Parameters) -> str:
    """CTEs: ids, lists (compared tokens of a reference), pairs, both_l (of a candidate)."""
    test = f"and length(tok) >= {p.minBlkTokenLen} and not regexp_full_match(tok, '[0-9]+')" if p.removeExcludedBlkTokens else ""
    return f""",
words as (select ref_id, list(tok order by pos) as l from ref where freq < {p.sigma} {test} group by ref_id),
ids as (select distinct ref_id from ref),
lists as (select ref_id, coalesce(l, []) as l from ids left join words using (ref_id)),
pairs as (select r1, r2 from shared where shared >= 2),
both_l as materialized (select r1, r2, a.l as l1, b.l as l2 from pairs join lists a on a.ref_id = r1 join lists b on b.ref_id = r2)"""


# the SQL's edit distance counts bytes: capitals of two bytes become characters that no token holds
LETTERS = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞŒŸ"
CODES = "abcdefghijklmnopqrstuvwxyz!#$%&*"
_DISTANCE = f"damerau_levenshtein(translate(t1, '{LETTERS}', '{CODES}'), translate(t2, '{LETTERS}', '{CODES}'))"


def _similarity(p: Parameters) -> str:
    number = "when regexp_full_match(t1, '[0-9]+') and regexp_full_match(t2, '[0-9]+') then 0.0::double" if p.matrixNumTokenRule else ""
    initial = "when length(t1) = 1 or length(t2) = 1 then 0.0::double" if p.matrixInitialRule else ""
    return f"case when t1 = t2 then 1.0::double {number} {initial} else 1.0::double - {_DISTANCE}::double / greatest(length(t1), length(t2)) end"


_TOKEN_PAIRS = """,
tp as (select distinct t1, t2 from (select unnest(l1) as t1, l2 from both_l) cross join lateral (select unnest(l2) as t2))"""


def _cells(p: Parameters) -> str:
    return f"""{_TOKEN_PAIRS},
sim as (select t1, t2, {_similarity(p)} as s from tp),
a1 as (select r1, r2, unnest(l1) as t1, unnest(range(1, len(l1) + 1)) as i, l2 from both_l),
grid as (select r1, r2, i, t1, unnest(l2) as t2, unnest(range(1, len(l2) + 1)) as j from a1),
cell as (select r1, r2, i, j, s from grid join sim using (t1, t2))"""


# a cell is picked if no cell before it (by similarity, row, column) that is itself picked shares its row or column; the picks are
# found by scanning the sorted cells with the rows and columns used so far
def _greedy(flip: bool) -> str:
    """CTE picks (r1, r2, m, sims, rows): the greedy matching; ``flip``: the shorter list's tokens are the rows."""
    rows = "case when len(l1) <= len(l2) then i else j end, case when len(l1) <= len(l2) then j else i end" if flip else "i, j"
    r, c = rows.split(", case") if flip else rows.split(", ")
    c = "case" + c if flip else c
    return f""",
turned as (select r1, r2, {r} as r, {c} as c, s from cell join both_l using (r1, r2)),
sorted as (select r1, r2, list({{'r': r, 'c': c, 's': s}} order by s desc, r, c) as cells from turned group by r1, r2),
scanned as (select r1, r2, list_reduce(cells, lambda acc, x: case when list_contains(acc.ur, x.r) or list_contains(acc.uc, x.c) then acc
    else {{'ur': list_append(acc.ur, x.r), 'uc': list_append(acc.uc, x.c), 'sims': list_append(acc.sims, x.s), 'r': 0::bigint, 'c': 0::bigint, 's': 0.0::double}} end,
    {{'ur': []::bigint[], 'uc': []::bigint[], 'sims': []::double[], 'r': 0::bigint, 'c': 0::bigint, 's': 0.0::double}}) as acc from (select r1, r2, list_transform(cells, lambda x: {{'ur': []::bigint[], 'uc': []::bigint[], 'sims': []::double[], 'r': x.r::bigint, 'c': x.c::bigint, 's': x.s}}) as cells from sorted)),
picks as (select r1, r2, acc.ur as rows, acc.sims as sims, len(acc.ur) as m from scanned)"""


_COSINE_SETS = """,
score as (select r1, r2, case when len(l1) > 0 and len(l2) > 0 then len(list_intersect(l1, l2)) / sqrt(len(l1)::double * len(l2)) else 0.0::double end as score from both_l)"""
_COSINE_REPEATS = """,
times as (select ref_id, tok, count(*) as n from (select ref_id, unnest(l) as tok from lists) group by all),
both_times as (select r1, r2, sum(least(a.n, b.n)) as n from pairs join times a on a.ref_id = r1 join times b on b.ref_id = r2 and a.tok = b.tok group by all),
score as (select r1, r2, case when len(l1) > 0 and len(l2) > 0 then coalesce(n, 0) / sqrt(len(l1)::double * len(l2)) else 0.0::double end as score from both_l left join both_times using (r1, r2))"""
_STD = _greedy(False) + """,
score as (select r1, r2, coalesce(list_sum(sims) / m, 0.0::double) as score from both_l left join picks using (r1, r2))"""
_KRIS = _greedy(True) + """,
score as materialized (select r1, r2, coalesce(list_sum(list_transform(range(1, m + 1), lambda k: sims[k] * (m - rows[k] + 1) / (m * (m + 1) / 2))), 0.0::double) as score from both_l left join picks using (r1, r2))"""
_MONGE_ELKAN = """,
best as (select r1, r2, i, max(s) as s from cell group by all), me as (select r1, r2, sum(s) as total from best group by all),
score as (select r1, r2, coalesce(total / len(l1), 0.0::double) as score from both_l left join me using (r1, r2))"""
_SCORES = " select r1, r2, round(score, 6) as score from score"


def _closure(k: str, links: str) -> str:
    """CTE cluster{k} (ref_id, cluster_id): the components of ``links`` (r1, r2, score)."""
    return f""",
link{k} as materialized ({links}),
edge{k} as materialized (select r1 as a, r2 as b from link{k} union select r2, r1 from link{k} union select r1, r1 from link{k} union select r2, r2 from link{k}),
reach{k} as (select a, b from edge{k} union select r.a, e.b from reach{k} r join edge{k} e on r.b = e.a),
cluster{k} as materialized (select a as ref_id, min(b) as cluster_id from reach{k} group by a)"""


def _qualities(k: str, epsilon: Decimal) -> str:
    """CTE quality{k} of the clusters: the n-th occurrences of a token in the references are matched."""
    return f""",
size{k} as (select cluster_id, count(*) as n_refs from cluster{k} group by all),
held{k} as (select cluster_id, tok, nth, count(*) as c from (select cluster_id, tok, row_number() over (partition by ref_id, tok order by pos) as nth from cluster{k} join ref using (ref_id)) group by all),
sums{k} as (select cluster_id, n_refs, sum(c)::bigint as n_tokens, sum(-(c / n_refs) * log2(c / n_refs)) as entropy from held{k} join size{k} using (cluster_id) group by all),
quality{k} as materialized (select *, q as quality, q >= {epsilon}::double as is_good from (select *, case when n_refs = 1 then 1.0::double else 1 - entropy / (n_tokens * log2(n_refs) / n_refs) end as q from sums{k}))"""


def _one_pass(p: Parameters) -> str:
    """CTEs link, cluster, quality, good, idx of the first threshold."""
    return (
        _closure("", f"select r1, r2, score from score where score >= {p.mu}::double")
        + _qualities("", p.epsilon)
        + """,
good as (select ref_id, cluster_id from cluster join quality using (cluster_id) where is_good),
idx as (select ref_id, coalesce(good.cluster_id, ref_id) as cluster_id from ids left join good using (ref_id))"""
    )


def _loop(p: Parameters) -> tuple[str, int]:
    """(CTEs live{i}, link{i}, quality{i}, good{i} of every threshold up to 1, how many there are)."""
    out = ", good0 as (select ''::varchar as ref_id, ''::varchar as cluster_id where false)"
    mu, epsilon, i = p.mu, p.epsilon, 0
    while mu <= 1:
        i += 1
        out += f""",
live{i} as materialized (select * from score where r1 not in (select ref_id from good{i - 1}) and r2 not in (select ref_id from good{i - 1}))"""
        out += _closure(str(i), f"select r1, r2, score from live{i} where score >= {mu}::double") + _qualities(str(i), epsilon)
        out += f""",
good{i} as materialized (select * from good{i - 1} union all select ref_id, cluster_id from cluster{i} join quality{i} using (cluster_id) where is_good),
step{i} as (select {i}::int as iteration, {mu}::double as mu, {epsilon}::double as epsilon, (select count(*) from live{i}) as candidate_pairs, (select count(*) from link{i}) as links, count(*) as clusters,
    coalesce(sum(n_refs), 0)::bigint as refs_in_clusters, count(*) filter (n_refs > 1) as clusters_over_one, count(*) filter (is_good) as good_clusters, coalesce(sum(n_refs) filter (is_good), 0)::bigint as refs_in_good from quality{i})"""
        mu, epsilon = mu + p.muIterate, epsilon + p.epsilonIterate
    return out, i


def _run_stats(n: int) -> str:
    """The iterations up to the first without candidates or links, and their sums."""
    steps = " union all ".join(f"select * from step{i}" for i in range(1, n + 1))
    return f""",
steps as ({steps}),
ran as (select * from steps s where candidate_pairs > 0 and not exists (select 1 from steps t where t.iteration < s.iteration and (t.links = 0 or t.candidate_pairs = 0)))
select * from ran union all select null, null, null, coalesce(sum(candidate_pairs), 0)::bigint, coalesce(sum(links), 0)::bigint, null, null, null, null, coalesce(sum(refs_in_good), 0)::bigint from ran"""


def _pair_sql(view: str, p: Parameters, scores: str, truth: str) -> dict[str, str]:
    """SQL of the queries of ``_pair_queries``; ``scores`` are the CTEs of the view's comparator, ``truth`` one named t0 (ref_id, truth_id)."""
    made = view + _lists(p)
    once = made + scores + _one_pass(p)
    loop, n = _loop(p)
    return {
        "stopword_filter": made + " select ref_id, cast(unnest(range(1, len(l) + 1)) as int) as pos, unnest(l) as tok from lists",
        "score_cosine": made + _COSINE_SETS + _SCORES,
        "linked_pairs": once + " select r1, r2, round(score, 6) as score from link",
        "connected_components": once + " select ref_id, cluster_id from cluster",
        "cluster_members": once + " select ref_id, cluster_id, cast(count(*) as int) as n_tokens from cluster join ref using (ref_id) group by all",
        "unprocessed_refs": once + " select ref_id, cast(count(*) as int) as n_tokens from ref anti join cluster using (ref_id) group by all",
        "cluster_quality": once + _QUALITY_ROWS,
        "good_clusters": once + " select ref_id, cluster_id from good",
        "bad_clusters": once + " select ref_id, cluster_id from cluster anti join good using (ref_id)",
        "linked_index_one_pass": once + " select ref_id, cluster_id from idx",
        "linked_index": made + scores + loop + f" select ref_id, coalesce(g.cluster_id, ref_id) as cluster_id from ids left join good{n} g using (ref_id)",
        "cluster_profile": once
        + """, sz as (select count(*) as cluster_size from idx group by cluster_id)
            select cluster_size, count(*) as n_clusters, sum(cluster_size)::bigint as n_refs, round(sum(cluster_size) / count(*), 4) as avg_size from sz group by rollup (cluster_size)""",
        "er_matrix": once
        + f""", t0 as ({truth}), t as (select ref_id, cluster_id, truth_id from idx join t0 using (ref_id)), cells as (select cluster_id, truth_id, count(*) as n from t group by all),
            c as (select (select sum(n) * (sum(n) - 1) / 2 from cells)::bigint as d, (select sum(n * (n - 1) / 2)::bigint from (select sum(n) as n from cells group by cluster_id)) as l,
            (select sum(n * (n - 1) / 2)::bigint from (select sum(n) as n from cells group by truth_id)) as e, (select sum(n * (n - 1) / 2)::bigint from cells) as tp),
            f as (select *, l - tp as fp, e - tp as fn, d - tp - (l - tp) - (e - tp) as tn, round(tp / nullif(l, 0), 4) as precision, round(tp / nullif(e, 0), 4) as recall from c)
            select *, round(2 * precision * recall / nullif(precision + recall, 0), 4) as f from f""",
        "run_stats": made + scores + loop + _run_stats(n),
    }


_QUALITY_ROWS = " select cluster_id, n_refs, n_tokens, round(entropy, 6) as entropy, round(quality, 6) as quality, is_good from quality"
_ITEM_TRUTH = "select cast(item_id as varchar) as ref_id, cast(item_id // 4 as varchar) as truth_id from benchmark"
_COPY_TRUTH = "select cast(doc_id as varchar) as ref_id, cast(min(doc_id) over (partition by coalesce(text, '')) as varchar) as truth_id from documents"


def oracle_sql() -> dict[str, str]:
    d, t = _view("doc_id", "documents", DOCS), _view("item_id", "benchmark", ITEMS)
    rules, repeats = _view("item_id", "benchmark", RULES), _view("item_id", "benchmark", REPEATS)
    pair_keys = " select a.tok as t1, b.tok as t2, a.ref_id from btok a join btok b on a.ref_id = b.ref_id and a.tok < b.tok"
    tokens = {
        "tokenize_splitter": d + " select ref_id, pos, tok from toks",
        "tokenize_compress": _view("doc_id", "documents", DOCS, COMPRESS) + " select ref_id, pos, tok from toks",
        "token_frequency": d + " select tok, freq from freq",
        "token_frequency_repeats": _view("doc_id", "documents", replace(DOCS, removeDuplicateTokens=False)) + " select tok, freq from freq",
        "tokenization_stats": d
        + """, n as (select (select count(*) from refs0) as refs_read, (select count(*) from occ) as tokens_found, (select count(*) from toks where regexp_full_match(tok, '[0-9]+')) as numeric_tokens,
            (select count(*) from toks) as tokens_left, (select count(*) from refs0 where len(found) = 0) as refs_without_tokens, (select count(*) from freq) as unique_tokens)
            select *, tokens_found - tokens_left as duplicate_tokens, round(unique_tokens / tokens_found, 4) as unique_ratio, round(numeric_tokens / tokens_found, 4) as numeric_ratio from n""",
        "token_frequency_stats": d + " select max(freq) as max_freq, round(avg(freq), 6) as mean_freq, round(stddev_pop(freq), 6) as stdev_freq from freq",
        "reformed_refs": d + " select ref_id, pos, tok, freq from ref",
        "blocking_tokens": d + " select ref_id, tok, times from btok",
        "block_keys_single": d + " select tok as t1, ref_id from btok",
        "block_keys_pairs": t + pair_keys,
        "candidate_pairs_single": d + " select r1, r2 from shared",
        "candidate_pairs_by_pairs": d + " select r1, r2 from shared where shared >= 2",
        "blocking_stats": d
        + """, k as (select ref_id, sum(times) as k from btok group by all), n as (select (select count(distinct ref_id) from ref) as refs, (select count(*) from k) as refs_selected, (select count(*) from k where k >= 2) as refs_left,
            (select sum(k * (k - 1) / 2)::bigint from k where k >= 2) as blocking_records, (select coalesce(sum(shared * (shared - 1) / 2), 0)::bigint from shared where shared >= 2) as pairs_by_blocks,
            (select count(*) from shared where shared >= 2) as unique_pairs)
            select *, refs - refs_selected as refs_excluded from n""",
        "token_pair_similarity": t + _lists(ITEMS) + _TOKEN_PAIRS + f" select t1, t2, round({_similarity(RULES)}, 6) as similarity from tp",
        "score_std": t + _lists(ITEMS) + _cells(ITEMS) + _STD + _SCORES,
        "score_std_rules": rules + _lists(RULES) + _cells(RULES) + _STD + _SCORES,
        "score_kris": t + _lists(ITEMS) + _cells(ITEMS) + _KRIS + _SCORES,
        "score_monge_elkan": t + _lists(ITEMS) + _cells(ITEMS) + _MONGE_ELKAN + _SCORES,
        "score_cosine_repeats": repeats + _lists(REPEATS) + _COSINE_REPEATS + _SCORES,
        "candidate_pairs_repeats": repeats + " select r1, r2 from shared where shared >= 2",
        "cluster_quality_repeats": repeats + _lists(REPEATS) + _COSINE_REPEATS + _one_pass(REPEATS) + _QUALITY_ROWS,
    }
    whole = _pair_sql(_view("doc_id", "documents", WHOLE), WHOLE, _COSINE_SETS, _COPY_TRUTH)
    return tokens | _pair_sql(t, ITEMS, _cells(ITEMS) + _KRIS, _ITEM_TRUTH) | {f"documents_{name}": sql for name, sql in whole.items()}
