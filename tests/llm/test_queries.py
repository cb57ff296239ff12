"""The registered queries on a small folder: SQL twins in DuckDB, the others against brute force; edges of the stages."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F
from spindrift.llm import queries, simhash

import check_oracle

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

PRIVATE = [
    "mail jane.doe@example.com or j@x.org now, call +44 (0)20-7946 0958 or +1 212 555 0100",
    "cards 4111 1111 1111 1111 and 4111111111111112, host 10.0.0.255 not 10.0.0.256",
    "é+49 30 1234567 x@y.zz 192.168.1.1 5500-0000-0000-0004",
    "1.2.3.4.5 a@b.c@d.e ++123456789012",
]


@pytest.fixture(scope="module")
def folder(spark, planted_texts, tmp_path_factory):
    rng = random.Random(11)
    root = tmp_path_factory.mktemp("tables")
    texts = [t for _, t in planted_texts] + PRIVATE + [f"Released under the MIT License and CC BY-NC {i}" for i in range(3)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, i % 3 > 0, i % 4 == 0) for i in range(0, len(rows), 2)], "doc_id long, quality boolean, toxic boolean").select(
        "doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")
    ).write.parquet(f"{root}/labels.parquet")
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "<s> [INST] x", None, "a\\<s>é"])) for c in range(6) for t in range(c)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{root}/conversations.parquet")
    centre = [rng.gauss(0, 1) for _ in range(16)]
    vectors = [(i, [c + rng.gauss(0, 0.05 if i % 3 else 1) for c in centre], rng.choice([0, 1, None])) for i in range(60)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    return str(root), {r[0]: r[1] or "" for r in rows}


def rows_by_id(spark, folder, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, folder[0]).collect()}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twin(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder[0]}/{table}.parquet/*.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, folder[0])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert check_oracle.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check_oracle.rows_of(columns, cursor.fetchall())


def luhn(digits: str) -> bool:
    parts = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(p - 9 if p > 9 else p for p in parts) % 10 == 0


def private_spans(text: str) -> list[tuple[int, int, int]]:
    patterns = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    ]
    tests = [
        lambda m: True, lambda m: all(int(p) <= 255 for p in m.split(".")),
        lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d), lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15,
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(zip(patterns, tests, strict=True)) for m in re.finditer(p, text) if ok(m[0]))


def test_op4_counts_and_spans(spark, folder):
    got, kinds = rows_by_id(spark, folder, "op4_contextual_pii"), ("email", "ip", "card", "phone")
    for i, text in folder[1].items():
        spans = private_spans(text)
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(s[1] == n for s in spans) for n in range(4)]
        base = [f"{kinds[k]}:{a}:{b}" for a, k, b in spans]
        assert got[i].base_sha256 == sha(",".join(base)) and set(base) <= set(got[i].spans.split(",")) | {""}
    assert {k for r in got.values() for k in kinds if r[f"n_{k}"]} == set(kinds)


def test_op2_base_columns(spark, folder):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    got = rows_by_id(spark, folder, "op2_license_scan")
    for i, text in folder[1].items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        found = [(s, label) for p, label in phrases.items() for s in range(len(words)) if words[s : s + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(found))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in found})) and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_op7_and_op9_against_the_library(spark, folder):
    bpe = tokenizers.Tokenizer.from_file(queries.BPE)
    ids = {i: bpe.encode(t, add_special_tokens=False).ids for i, t in folder[1].items()}
    got = rows_by_id(spark, folder, "op7_bpe")
    for i, own in ids.items():
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(own), sha(",".join(map(str, own))))
        assert got[i].decoded_sha256 == sha(bpe.decode(own, skip_special_tokens=False))
    pieces, sequences = {}, {}
    for r in queries.op9_packing(spark, folder[0]).collect():
        own = [*ids[r.doc_id], 0]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held, size in [(pieces[i], len(own) + 1) for i, own in ids.items()] + [(s, None) for s in sequences.values()]:
        ends = 0
        for start, length in sorted(held):
            assert start == ends
            ends += length
        assert ends == size if size else ends <= 1024


def test_op8_fingerprints(spark, folder):
    import xxhash

    got = rows_by_id(spark, folder, "op8_simhash")
    for i, text in folder[1].items():
        words = re.findall(WORD, lower(text))
        shingles = [" ".join(words[s : s + 3]) for s in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert got[i].fingerprint == f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"
    values = {i: int(r.fingerprint, 16) for i, r in got.items()}
    for a in values:
        for b in values:
            if (values[a] ^ values[b]).bit_count() <= 3:
                assert got[a].component_id == got[b].component_id <= min(a, b)


def test_op10_base_columns(spark, folder):
    got = rows_by_id(spark, folder, "op10_quality_forest")
    for i, text in folder[1].items():
        words = re.findall(WORD, text)
        lines = [x for x in text.split("\n") if re.search(WORD, x)]
        windows = [tuple(words[s : s + 8]) for s in range(len(words) - 7)]
        repeat = {p for s, w in enumerate(windows) if windows.count(w) > 1 for p in range(s, s + 8)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 20 or 100 * len(repeat) > 30 * len(words)) and not (r.kept and r.base_failed)


def test_op11_columns(spark, folder):
    for i, r in rows_by_id(spark, folder, "op11_toxicity").items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_stages_with_clashing_names(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    extra = ["n_removed", "kept_text", "n_words", "_id", "_key", "_spans", "decoded", "spans", "fp", "score", "hash", "_c0", "kept", "component_id"]
    wide = docs.withColumns({c: F.lit(n) for n, c in enumerate(extra)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        wide = stage(spark, wide, folder[0])
        assert wide.columns == [*docs.columns, *extra], name
        assert {tuple(r[c] for c in extra) for r in wide.collect()} == {tuple(range(len(extra)))}
    assert corpus_pipeline.STAGES[-1][1](spark, wide, folder[0]).count() > 0


def test_quality_stage_judges_rows_without_id_by_their_text(spark, folder):
    good = " ".join(f"word{i}" for i in range(60))
    rows = spark.createDataFrame([(None, good), (None, "x x x"), (None, None), (7, good), (7, "y")], "doc_id long, text string")
    kept = corpus_pipeline.quality_rules(spark, rows, folder[0]).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, good), (7, good)]
    assert simhash.keep_one(rows).count() == 4
