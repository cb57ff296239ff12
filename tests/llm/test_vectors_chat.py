"""Vectors, conversations, components and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from spindrift.llm import chat, itq, pii
from spindrift.llm.graph import components

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_links(rows, cosine):
    """(links, component) of every row by all pairs."""
    usable = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, group = {i: set() for i in range(len(rows))}, list(range(len(rows)))
    unit = {i: np.array(rows[i][1], np.float32).astype(float) / np.linalg.norm(np.array(rows[i][1], np.float32).astype(float)) for i in usable}
    for a in usable:
        for b in usable:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                links[a].add(b)
                links[b].add(a)
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    lowest = {}
    for i, g in enumerate(group):
        lowest[g] = min(lowest.get(g, rows[i][0]), rows[i][0])
    return [(rows[i][0], len(links[i]), lowest[group[i]]) for i in range(len(rows))]


def test_vectors_with_edge_rows(spark):
    rng = np.random.default_rng(1)
    rows, base = [], rng.normal(size=(30, 16))
    for k in range(150):
        v = base[k % 30] + rng.normal(size=16) * rng.choice([0.02, 0.2, 0.6])
        rows.append((1000 - k, v.astype(np.float32).tolist(), int(k % 3)))
    rows += [(2000 + k, rows[0][1], rows[0][2]) for k in range(5)]
    nan, inf = float("nan"), float("inf")
    rows += [(1, None, 0), (2, [], 0), (3, [0.0] * 16, 0), (4, [nan] + [1.0] * 15, 0), (5, [inf] * 16, 0), (6, [None] + [1.0] * 15, 0), (7, rows[0][1], None), (8, [1.0, 2.0], 0), (9, [2.0, 4.0], 0), (10, [1.0] * 16, 0)]
    table = spark.createDataFrame(rows, VECTORS).withColumns({"n_links": F.lit(1), "VEC": F.lit(0), "node": F.lit("x")})
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in itq.near_duplicate_vectors(table, cosine=0.93).collect())
    want = sorted((*w, w[0] == w[2]) for w in brute_links(rows, 0.93))
    # Of these few codes of 16 bits nearly all links are found, and none is invented.
    assert sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert [g for g in got if g[0] <= 10] == [w for w in want if w[0] <= 10]
    assert itq.near_duplicate_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    lone = spark.createDataFrame([(None, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (None, [9.0, -2.0], 1)], VECTORS)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in itq.near_duplicate_vectors(lone).collect()) == [("5", 1, "5"), ("None", 0, "None"), ("None", 1, "5")]


def test_recall_near_the_limit(spark):
    """Pairs with a cosine between 0.93 and 0.96: at least nine in ten are retrieved."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(600):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.9305, 0.96)
        rows += [(2 * k, a.tolist(), 0), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = itq.near_duplicate_vectors(table).where("n_links > 0").count()
    assert 0.9 * 1200 <= got <= 1200


def test_large_tiles_are_cut_without_changing_links(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=32)
    rows = [(k, (base + rng.normal(size=32) * 0.1).tolist(), 0) for k in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = sorted(map(tuple, itq.near_duplicate_vectors(table).collect()))
    monkeypatch.setattr(itq, "TILE", 16)
    assert sorted(map(tuple, itq.near_duplicate_vectors(table).collect())) == whole
    assert [w[1] for w in whole] == [119] * 120


def test_components_of_paths_and_stars(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(500, 400), (400, 300), (7, 7)]
    edges += [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(60)]
    group = {n: n for e in edges for n in e}
    for a, b in edges:
        low, high = sorted((group[a], group[b]))
        group = {n: low if g == high else g for n, g in group.items()}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges for n in (a, b) if a != b}
    assert got == {n: g for n, g in group.items() if n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


TURNS = "conv_id long, turn long, role string, text string"


def brute_digest(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: ((r[1] is not None, r[1] or 0), (r[2] is not None, r[2] or ""), r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_conversations_round_trip(spark, monkeypatch):
    rng = random.Random(6)
    bits = ["</s>", "[INST]", "[\\INST]", "[/INST]", "<|end|>", "<\\|turn|>", "<<SYS>>", "<</SYS>>", "<s>", "<", "|", "\\", "[", "é", "\U0001f600", "\n", "ok ", "<|image|>", "\\n"]
    say = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), say()) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(77, t, ("user", "assistant")[t % 2], say()) for t in range(600)]
    rows += [(50, 0, None, None), (50, None, "assistant", "x"), (None, 0, "user", "a"), (None, 1, "assistant", None), (51, 0, "us\ner\\n<|end|>", "b"), (52, 0, "user", "same"), (52, 0, "user", "same")]
    table = spark.createDataFrame(rows, TURNS).withColumns({"parts": F.lit(1), "whole": F.lit(2), "texts": F.lit(3)}).repartition(5)
    monkeypatch.setattr(chat, "PIECE_CHARS", 2000)
    pieces = chat.format_conversations(chat.turns_of(table))
    assert pieces.where("not whole").count() > 2
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(pieces).collect()}
    assert got == brute_digest(rows)
    for r in pieces.collect():
        inner = re.sub(r"<\|turn\|>|<\|end\|>", "", r.formatted)
        assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", inner)
    assert chat.read_back(chat.format_conversations(chat.turns_of(spark.createDataFrame([], TURNS)))).count() == 0


def test_escaping_is_reversible():
    rng = random.Random(8)
    for _ in range(20_000):
        text = "".join(rng.choice("<[\\|/s>INST]SY") for _ in range(rng.randint(0, 14)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", safe)


def test_attachments_become_placeholders(spark):
    kind = f"conv_id long, turn long, role string, parts array<{chat.PART}>"
    part = lambda kind, **k: {"kind": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    rows = [
        (1, 0, "user", [part("text", text="see <|image|> "), part("image", ref="a.png", width=56, height=29), part("audio", ref="b.wav", seconds=2.0), part("document", ref="c.pdf", pages=3)]),
        (1, 1, "assistant", [part("text", text="a dog"), part("image", ref=None), part("text", text=" runs")]),
        (2, 0, "user", None),
    ]
    pieces = chat.format_conversations(spark.createDataFrame(rows, kind)).orderBy("conv_id", "part", "piece").collect()
    first = [r for r in pieces if r.conv_id == 1]
    files = [(a.turn, a.place, a.kind, a.ref, a.tokens) for r in first for a in r.attachments]
    assert files == [(0, 0, "image", "a.png", 4), (0, 1, "audio", "b.wav", 50), (0, 2, "document", "c.pdf", 768), (1, 0, "image", None, 1)]
    formatted = "".join(r.formatted for r in first)
    assert sum(r.n_attached for r in first) == 823 and formatted.count("<|image|>") == 2
    assert "".join(r.formatted[s.start : s.end] for r in first for s in r.loss) == "a dog runs"
    assert list(chat.read_turns(formatted)) == [("user", "see <|image|> "), ("assistant", "a dog runs")]
    assert list(chat.read_turns(pieces[-1].formatted)) == [("user", "")]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus with junk, copies, a shared passage, personal data and labels."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(60)
    good = [prose(rng.randint(60, 160)) for _ in range(300)]
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(good)]
    rows += [(1000 + k, t, "en", "src0", len(t)) for k, t in enumerate(good[:20])]
    rows += [(2000 + k, t, "en", "src1", len(t)) for k in range(10) for t in [f"{prose(80)} {passage} {prose(80)}"]]
    rows += [(3000 + k, t, "en", "src2", len(t)) for k in range(10) for t in [f"{prose(60)} mail me at user{k}@host{k}.example {prose(10)}"]]
    rows += [(4000 + k, t, "en", "src2", len(t)) for k in range(40) for t in [" ".join(w + "&&&" for w in prose(90).split())]]
    rows += [(5000, "too short", "en", "src0", 9), (5001, None, None, None, None), (5002, "", "en", "src0", 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, 0) for k in range(0, 300, 2)] + [(4000 + k, 0, 0) for k in range(0, 40, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {r[0]: r[1] for r in rows}, passage


def test_pipeline_stages(spark, corpus, tmp_path):
    import corpus_pipeline

    folder, texts, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
    quality, single, cut, private = (kept[n] for n, _ in corpus_pipeline.STAGES[:-1])
    assert not {5000, 5001, 5002} & set(quality) and sum(k >= 4000 for k in quality) <= 2
    assert len([k for k in quality if k < 4000]) >= 335
    assert all(k in quality for k in single) and not any(1000 <= k < 1020 and k - 1000 in quality for k in single)
    assert set(single) == set(cut) == set(private)
    holders = [k for k in sorted(cut) if passage in cut[k].text]
    assert len(holders) == 1 and holders[0] == min(k for k in single if passage in texts[k])
    assert all(r.n_chars == len(r.text) for r in private.values())
    assert all("@" not in r.text for r in private.values()) and sum("[EMAIL]" in r.text for r in private.values()) >= 9
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {p.doc_id for p in pieces} == set(private)


def test_stages_on_an_empty_table(spark, corpus, tmp_path):
    import corpus_pipeline

    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_redaction_of_overlapping_spans(spark):
    rows = [(1, "call +49 170 1234567 or 4111 1111 1111 1111, 1.2.3.4@x.example é a@b.de"), (None, "x@y.de"), (1, "plain")]
    got = sorted(r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == ["[EMAIL]", "call [PHONE] or [CARD], [EMAIL] é [EMAIL]", "plain"]
