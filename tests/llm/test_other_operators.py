"""Chat formatting, embedding near-dedup and the pipeline."""

import hashlib
import random

import numpy as np
import pytest

from kinfold.llm import chat_format, embedding_dedup
from kinfold.llm.chat_format import CONTROLS, TemplateError, compile_template, escape, fold, parse, unescape

CHAT = "conv_id bigint, turn bigint, role string, text string, formatted string"


def test_escape_round_trip():
    rng = random.Random(2)
    parts = ["<", "s", ">", "/", "[", "INST", "]", "\\", "ROLE", *CONTROLS, "a"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        e = escape(t)
        assert unescape(e) == t and not any(c in e for c in CONTROLS)


def test_template_language():
    render = compile_template("{% if a == 'x' %}1{% elif not b %}2{% else %}3{% endif %}{% for i in xs %}{{ i.k | upper }},{% endfor %}{% generation %}{{ a }}{% endgeneration %}")
    assert render(a="x", b=1, xs=[{"k": "q"}, {"k": None}]) == ("1Q,,x", [(4, 5)])
    assert render(a="y", b=0, xs=None)[0] == "2y" and render(a="y", b=1, xs=[])[0] == "3y"
    folded = fold(parse("{% set a = 'x' + 'y' %}{{ a }}{% if 1 == 2 %}no{% endif %}z"))
    assert len(folded) == 2 and folded[1].value.value == "xyz"
    for bad in ("{% if a %}", "{% endif %}", "{{ a | nosuch }}", "{{ a.__class__ }}", "{{ a() }}", "{% for a %}{% endfor %}", "{% else %}", "{{ }}", "{% import os %}"):
        with pytest.raises(TemplateError):
            compile_template(bad)


def test_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "RUN_CHARS", 60)
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", chat_format.PROBE, "hi é 😀", "\\"]), "x") for c in (1, 2, 3, None) for t in range(rng.randint(1, 30))]
    rows += [(9, 0, "assistant", "one", "x"), (9, 0, "assistant", "one", "x")]
    df = spark.createDataFrame(rows, CHAT)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_runs(df)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        mine = sorted(((t, role or "", text or "") for c, t, role, text, _ in rows if c == conv))
        turns = "".join(f"{role}\n{text}\n" for _, role, text in mine)
        loss = "".join(text for _, role, text in mine if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(turns.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_runs(df.limit(0))).count() == 0


def test_templates_with_texts_around_the_turns(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "RUN_CHARS", 5)
    source = "{% set who = 'A' %}BOS{{ who }} {% for m in messages %}<{{ m.role }}>{% generation %}{{ m.text | trim }}{% endgeneration %}{% endfor %}{% generation %}EOS{% endgeneration %}"
    rows = [(1, t, "user", f" t{t} ", "x") for t in range(9)] + [(2, 0, None, None, "x"), (None, 0, "system", "s", "x")]
    runs = chat_format.format_runs(spark.createDataFrame(rows, CHAT), source).collect()
    render = compile_template(source)
    for conv in (1, 2, None):
        mine = sorted((r for r in runs if r.conv_id == conv), key=lambda r: (r.part, r.run))
        text, marks = "", []
        for r in mine:
            marks += [(a + len(text), b + len(text)) for a, b in zip(r.marks[::2], r.marks[1::2])]
            text += r.formatted
        assert (text, marks) == render(messages=[{"role": role or "", "text": t or ""} for c, _, role, t, _ in rows if c == conv])
    assert chat_format.format_runs(spark.createDataFrame([], CHAT), source).count() == 0
    with pytest.raises(Exception, match="outside of turns"):
        chat_format.read_back(chat_format.format_runs(spark.createDataFrame(rows, CHAT), "BOS" + chat_format.TEMPLATE)).collect()


@pytest.mark.parametrize("source", ["no loop", "{% if messages %}x{% endif %}{% for m in messages %}{% endfor %}", "{% for m in messages %}{{ messages }}{% endfor %}",
                                    "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}", "{% if a %}{% for m in messages %}{% endfor %}{% endif %}"])
def test_templates_that_look_at_other_turns_are_refused(source):
    with pytest.raises(TemplateError):
        chat_format.split_template(source)


def _brute(rows):
    ok = [x is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x) and any(x) for _, x in rows]
    link = np.zeros((len(rows), len(rows)), dtype=bool)
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows):
            if i != j and ok[i] and ok[j] and len(a) == len(b):
                link[i, j] = np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.95
    low = [r[0] for r in rows]
    for _ in rows:
        low = [min([low[i], *(low[j] for j in np.flatnonzero(link[i]))]) for i in range(len(rows))]
    return sorted((rows[i][0], int(link[i].sum()), low[i], low[i] == rows[i][0]) for i in range(len(rows)))


@pytest.mark.parametrize("block", [2048, 7])
def test_embedding_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 24))
    rows = [(i, x.tolist()) for i, x in enumerate(base)]
    rows += [(100 + i, (base[i % 9] + rng.normal(size=24) * 0.15).tolist()) for i in range(80)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, [0.0] * 24), (304, [float("nan")] * 24), (305, [1.0, None] * 12), (306, []), (307, [1.0, 2.0]), (308, [2.0, 4.0]), (309, (base[3] * 1e-30).tolist()), (310, [float("inf")] * 24)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<double>, n int, rep int")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == _brute(rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("k", sorted(embedding_dedup.TABLES))
@pytest.mark.parametrize("cosine", [0.95, 0.97])
def test_hashes_recall_pairs_at_the_threshold(k, cosine):
    """No pair is missed, and by the share that meets in one table fewer than one in 10,000 would be."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    tables = embedding_dedup.TABLES[k]
    a, b = (embedding_dedup.codes(v, k, tables).reshape(len(x), tables, -1) for v in (x, y))
    met = (a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3))
    print(f"k {k}, cosine {cosine}: {1 - met.any(axis=1).mean():.6f} missed, {met.mean():.4f} meet in one table, {(1 - met.mean()) ** tables:.1e} missed by that")
    assert met.any(axis=1).all() and (1 - met.mean()) ** tables < 1e-4


def test_links_are_counted_along_a_chain(spark, monkeypatch):
    """Neighbours on a circle: one component, whose far pairs are never links, in buckets of many blocks."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    angle = np.arange(150) * (2 * np.pi / 150)
    rows = [(i, [np.cos(a), np.sin(a), 0.0, 0.0]) for i, a in enumerate(angle)]
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows], "vec_id bigint, embedding array<double>")
    near = sum(np.cos(2 * np.pi * d / 150) >= 0.95 for d in range(1, 150))
    assert {(r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()} == {(near, 0)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(60, 200)))) for i in range(30)]
    rows += [(100, rows[0][1]), (101, rows[1][1] + " end"), (102, "short"), (103, None), (104, rows[2][1] + " token=abcdef123456")]
    docs = spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 3}", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == docs.columns
        seen.append({r.doc_id: r for r in now.collect()})
    quality, near, secret, mixed = seen
    assert set(quality) == {d for d, t in rows if len((t or "").split()) >= 50}
    assert set(near) == set(range(30))
    assert set(secret) == set(near)
    assert set(mixed) <= set(secret)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(mixed)
