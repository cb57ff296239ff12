"""Document operators against brute force on small planted tables."""

from __future__ import annotations

import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from spindrift.llm import anchors, buffers, licenses, packing, pii, quality, simhash, suffixes, tokens
from spindrift.llm.queries import BPE
from spindrift.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string"


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def planted(spark, planted_texts):
    """The planted rows with extra columns whose names clash with those the operators make."""
    rows = spark.createDataFrame(planted_texts, SCHEMA)
    return rows.withColumns({"slot": F.lit("x"), "n_words": F.lit(None).cast("int"), "fp": F.col("doc_id"), "rest": F.lit(1.5), "TURN": F.lit(0)}).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_repeated_words(planted, planted_texts, empty):
    seen, want = set(), {}
    for i, text in sorted(planted_texts):
        words = re.findall(WORD, text or "")
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            window = tuple(words[s : s + 20])
            if window in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(window)
        want[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    found = anchors.remove_repeats(planted.drop("n_words"))
    assert found.columns[:2] == ["doc_id", "text"] and "slot" in found.columns
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found.collect()}
    assert got == want and any(w[1] for w in want.values())
    assert anchors.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("work", [quality.text_statistics, simhash.text_fingerprints])
def test_large_batches_are_handled_in_small_slices(work):
    text = " ".join(f"w{i * 7919 % 5003}" for i in range(2000))
    batch = pa.record_batch({"text": pa.array([text] * (8_000_000 // len(text)))})
    tracemalloc.start()
    for part in buffers.slices([batch], "text"):
        work(part.column(0))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6, most


def test_difference_cover_reaches_every_residue():
    for period in range(1, 20):
        cover = anchors.difference_cover(period)
        for i in range(period):
            for j in range(period):
                assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


def test_repeated_rows_and_rows_without_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "a b"), (0, text + " z")], SCHEMA)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in anchors.remove_repeats(rows).collect())
    assert got == [(False, 0, 0), (False, 1, 30), (False, 1, 30), (True, 0, 0), (True, 0, 30)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in suffixes.remove_repeated_bytes(rows.where("doc_id is null or doc_id > 0")).collect())
    assert got == [(False, 1, 0), (False, 1, 0), (True, 0, 0), (True, 0, len(text))]


def test_repeated_bytes(planted, planted_texts, empty):
    first: dict[bytes, int] = {}
    bodies = {i: (t or "").encode() for i, t in planted_texts}
    for i in sorted(bodies):
        for s in range(len(bodies[i]) - 49):
            first.setdefault(bodies[i][s : s + 50], i)
    want = {}
    for i, body in bodies.items():
        gone = [False] * len(body)
        for s in range(len(body) - 49):
            if first[body[s : s + 50]] < i:
                gone[s : s + 50] = [True] * 50
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        want[i] = (len(body), sum(gone), spans, bytes(b for b, g in zip(body, gone, strict=True) if not g))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeated_bytes(planted).collect()}
    assert got == want and any(w[1] for w in want.values())
    assert suffixes.remove_repeated_bytes(empty).count() == 0


def test_content_hashes_depend_on_the_bytes_alone():
    rng = np.random.default_rng(6)
    seen: dict[tuple, bytes] = {}
    kept: dict[bytes, tuple] = {}
    for _ in range(30):
        body = rng.integers(97, 99, int(rng.integers(1, 90))).astype(np.uint8)
        low = rng.integers(0, len(body), 200)
        high = low + rng.integers(0, len(body) - low + 1)
        for a, b, h in zip(low.tolist(), high.tolist(), map(tuple, suffixes.content_hashes(body, low, high).tolist()), strict=True):
            piece = body[a:b].tobytes()
            assert seen.setdefault(h, piece) == piece and kept.setdefault(piece, h) == h


def test_two_stage_sort_and_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = rng.integers(0, int(rng.integers(1, 5)) + 1, int(rng.integers(1, 60)))
        order = suffixes.two_stage_sort(x, 100)
        assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
        prefix = suffixes.common_prefixes(x, order, 7)
        for k in range(1, len(x)):
            a, b = x[order[k - 1] :].tolist(), x[order[k] :].tolist()
            same = next((n for n, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
            assert prefix[k] == min(same, 7)


def test_simhash_groups(planted, planted_texts, empty):
    import xxhash

    def fingerprint(text):
        words = re.findall(WORD, lower(text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: fingerprint(t) for i, t in planted_texts}
    group = {i: i for i in prints}
    for a in sorted(prints):
        for b in sorted(prints):
            if (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(planted.drop("fp")).collect()}
    assert got == {i: (prints[i], group[i]) for i in prints} and len(set(group.values())) < len(group)
    assert {r.doc_id for r in simhash.keep_one(planted).collect()} == set(group.values())
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_one_of_each_simhash_group_stays(spark):
    rng = random.Random(12)
    text = lambda: " ".join(str(rng.randint(0, 10**6)) for _ in range(40))
    a, b, c, d, e = (text() for _ in range(5))
    near = a + "\n"
    # Rows without an id: beside one with an id, alone in a group of two, alone. One id with two different texts.
    rows = [(1, a), (None, near), (None, b), (None, b + " "), (None, c), (7, d), (7, e), (7, e), (9, d)]
    got = [(r.doc_id, r.text.strip()) for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (None, b), (None, c), (7, d), (7, e)], key=str)


def test_hamming_links_are_complete(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) for b in base for _ in range(12)}
    values = sorted(v % (1 << 64) for v in values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    group = {v: v for v in signed}
    joined = dict(group)

    def merge(g, a, b):
        low, high = sorted((g[a], g[b]))
        return {k: low if x == high else x for k, x in g.items()}

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3:
                group = merge(group, signed[i], signed[j])
    for e in edges:
        assert ((e.a ^ e.b) % (1 << 64)).bit_count() <= 64
        joined = merge(joined, e.a, e.b)
    assert joined == group


def test_tokens_match_the_library(spark, planted, planted_texts, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    rng = random.Random(1)
    marks = [" ", "  ", "\n", "\t", "'", "s", "t", "re", "ll", "d", "a", "É", "7", "½", "!", " ", "　", "日", "\U0001f389", "\x1c", "\x85", "​", "<|endoftext|>", "_", "'s"]
    odd = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    rows = planted_texts + list(zip(range(-len(odd), 0), odd, strict=True))
    encoded = tokens.encode(spark.createDataFrame(rows, SCHEMA), BPE)
    texts = dict(rows)
    for r in tokens.decode(encoded, BPE).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert tokens.encode(empty, BPE).count() == 0


def test_a_pass_over_texts_leaves_no_free_memory_behind():
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(line.split()[1]) for line in f if line.startswith("Private_Dirty")) / 1024

    kept = []

    def work(batches):
        for batch in batches:
            made = [bytes(1000) for _ in range(200_000)]
            kept.append(made[-1])
            yield batch

    batch = pa.record_batch({"text": pa.array(["x"])})
    assert list(work([batch])) == [batch]
    left = held()
    assert list(buffers.trimmed(work)([batch])) == [batch]
    assert held() < left - 100


def test_scores_between_rounds_are_not_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(pii, "cut_lineage", lambda df, *fold: written.append(df) or cut_lineage(df, *fold))
    seen = spark.createDataFrame([(f"s{i}", "p", 0) for i in range(8)] + [("new", "p", None)], "instance string, pattern string, rank int")
    assert pii.trusted_patterns(seen, 6, 5, 0.8).count() == 1 and len(written) == 2


def test_short_rows_go_to_few_files(spark):
    rows = spark.range(1000).groupBy((F.col("id") % 500).alias("k")).count()
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        few = cut_lineage(rows, 8)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(few.inputFiles()) <= 25 and few.agg(F.sum("count")).first()[0] == 1000


def test_pieces_are_merged_a_few_at_a_time():
    words, sizes = tokens.vocabulary(BPE), []
    encoder = tokens.Encoder(lambda pieces: sizes.append(len(pieces)) or words.merge_all(pieces), words.special)
    texts = [" ".join(chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676) for i in range(n, n + 3000)) for n in (0, 2000)]
    ids, offsets = encoder.encode(pa.array(texts))
    assert len(sizes) > 2 and max(sizes) <= 2048
    for text, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        assert ids[a:b].tolist() == tokens.own_encoder(BPE).encode(pa.array([text]))[0].tolist()


def test_packing_is_a_partition_of_all_ids(planted, planted_texts, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    plan = packing.pack(planted, BPE, capacity=128, grain=8)
    places, pieces = defaultdict(list), defaultdict(list)
    for r in plan.collect():
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for i, text in planted_texts:
        ids, at = library.encode(text or "", add_special_tokens=False).ids + [0], 0
        for p in sorted(pieces[i], key=lambda r: r.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    total = 0
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 128
        total += at
    assert sorted(places) == list(range(len(places))) and len(places) <= total / 128 * 1.05 + 2
    whole = packing.sequences(tokens.encode(planted, BPE), plan).collect()
    assert sum(len(r.ids) for r in whole) == total
    assert packing.pack(empty, BPE).count() == 0


def test_column_generation_reaches_the_optimum():
    rng = np.random.default_rng(0)
    histogram = {16 * k: int(rng.integers(1, 100_000)) for k in range(1, 32)} | {k: int(rng.integers(1, 100_000)) for k in range(1, 16)}
    plan = packing.plan_patterns(histogram, 512)
    used = Counter()
    for pattern, times in plan:
        assert sum(n * c for n, c in pattern.items()) <= 512
        used.update({n: c * times for n, c in pattern.items()})
    assert used == Counter(histogram)
    # The prices of the final patterns allow no better pattern, so their number bounds every packing.
    lengths = np.array(sorted(histogram, reverse=True))
    patterns, times = packing.generate_patterns(lengths, np.array([float(histogram[n]) for n in lengths]), 512)
    prices = np.linalg.solve(patterns.astype(float), np.ones(len(lengths)))
    assert packing.best_pattern(prices, lengths, 512)[0] <= 1 + 1e-6
    assert sum(t for _, t in plan) <= times.sum() + len(lengths)


def test_license_phrases_and_fuzzy_notices(spark, empty):
    notice = "Licensed under the Apache License, Version 2.0"
    rows = [
        (1, notice + ". and CC BY-NC 4.0, cc by  nc"),
        (2, "Licensed undr the Apach License, Versoin 2.0 follows"),
        (3, "cc by ncx and mit license; under the MIT-license"),
        (4, None),
        (5, "x " * 300 + "This werk is licensed under the GNU General Public Licence, version 3!"),
        (6, "nothing to see here"),
        (7, "Licensed under the"),
        (8, "Apache License, Version 2.0"),
        (9, ""),
        (10, "cc by é nc cc by nc4"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA).repartition(1)).collect()}
    for i, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        want = []
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            want += [(label, s) for s in range(len(words)) if words[s : s + len(p)] == p]
        assert got[i].n_words == len(words) and sorted((b.label, b.word) for b in got[i].base) == sorted(want)
    found = {i: {(f.label, f.first_word) for f in r.found} for i, r in got.items()}
    assert ("apache-2", 0) in found[1] and ("apache-2", 0) in found[2] and found[5] == {("gpl-3", 300)}
    assert not found[4] and not found[6] and not found[7] and not found[9]
    assert licenses.scan(empty).count() == 0


def _pii_base(text: str):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for rank, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            digits = [int(d) for d in re.sub("[^0-9]", "", m[0])]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end()))
    return sorted(out)


def test_personal_data_patterns(spark, empty):
    rng = random.Random(5)
    bits = ["a", "b.c", "@", "x@y.de", "q@w", ".", "-", " ", "+1", "(22)", "255", "256.1", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "é", "\U0001f600", "0", "77", "+49 170 1234567", "%", ".com", "\n"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(1500)]
    rows += [(2000, None), (2001, ""), (2002, "a@b.c-d%x@y.z"), (2003, "1 " * 9000), (2004, "a" * 20000), (2005, "7" * 20000), (2006, "000255.01.1.1"), (2007, "a@b" + ".c" * 9000), (2008, "+" * 500 + "1" * 12)]
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.find_spans(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    for i, text in rows:
        assert got[i] == _pii_base(text or ""), (i, text)
    assert pii.find_spans(empty).count() == 0


def test_bootstrap_finds_unseen_identifiers_only_in_trusted_contexts(spark):
    rng = random.Random(2)
    say = lambda: " ".join(rng.choice("lorem ipsum dolor sit amet".split()) for _ in range(6))
    rows = [(i, f"{say()} mailto: user{i}@host{i}.example {say()}") for i in range(40)]
    rows += [(100, f"{say()} mailto: user7@localhost1 {say()}"), (101, f"{say()} version 7 {say()}"), (102, None)]
    rows += [(200 + i, f"build {i}.{i} released") for i in range(9)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_spans(table, support=3, precision=0.6).collect()}
    at = rows[40][1].index("user7@localhost1")
    assert got[100] in ([], [(at, 0, at + 16)])
    assert all(not got[i] for i in (101, 102, *range(200, 209)))
    clean = {r.doc_id: r.text for r in pii.redact(table).collect()}
    assert all("@" not in clean[i] and "[EMAIL]" in clean[i] for i in range(40)) and clean[102] is None and clean[101] == rows[41][1]


def test_bootstrap_names_every_unseen_form_in_its_context(spark):
    rng = random.Random(3)
    say = lambda: " ".join(rng.choice("lorem ipsum dolor sit amet".split()) for _ in range(6))
    name = lambda i: "".join("abcdefghij"[int(d)] for d in str(i))
    rows = [(i, f"{say()} mailto: {name(i)}.doe@example.com {say()} tel: +1 (521) 555-{2000 + i} {say()}") for i in range(40)]
    # The word "to" holds more plain words than seeds, so it names nothing.
    rows += [(50 + i, f"go to {name(i)}.roe@example.com or to {name(300 + i)} and to {name(500 + i)}") for i in range(12)]
    unseen = [("email", "mailto:", "user7@localhost1"), ("email", "mailto:", "jane@intranet"), ("email", "mailto:", "acct_88"), ("phone", "tel:", "555-123-4567"), ("phone", "tel:", "(555) 123 4567")]
    rows += [(100 + i, f"{say()} {word} {value}, {say()}") for i, (_, word, value) in enumerate(unseen)]
    rows += [(200, f"{say()} to room-7 {say()}"), (201, f"{say()} {unseen[0][2]} {say()}")]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (kind, word, value) in enumerate(unseen):
        assert value in rows[52 + i][1] and f" {word} [{kind.upper()}], " in got[100 + i], got[100 + i]
    assert got[200] == rows[57][1] and got[201] == rows[58][1]


def test_trusted_patterns(spark):
    seen = [(f"s{i}", "p", 0) for i in range(8)] + [("new", "p", None)] + [(f"s{i}", "q", 0) for i in range(3)] + [(f"t{i}", "q", 1) for i in range(3)]
    got = pii.trusted_patterns(spark.createDataFrame(seen, "instance string, pattern string, rank int"), 3, 5, 0.8).collect()
    assert [tuple(r) for r in got] == [("p", 0)]


def test_quality_counts_and_verdicts(spark, planted, planted_texts, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(planted.drop("n_words"), labels).collect()}
    for i, text in planted_texts:
        text = text or ""
        words = re.findall(WORD, text)
        windows = [tuple(words[s : s + 8]) for s in range(len(words) - 7)]
        times = Counter(windows)
        inside = {s + j for s, w in enumerate(windows) if times[w] > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if re.search(WORD, x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 20 or 100 * len(inside) > 30 * len(words)) and r.kept == (not r.base_failed)
    assert quality.judge(empty, labels).count() == 0 and quality.keep_good(empty, labels).count() == 0


def test_forest_rejects_labelled_junk(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    good = [" ".join(rng.choice(words) for _ in range(rng.randint(40, 200))) for _ in range(600)]
    junk = [" ".join(rng.choice(words) + "&&&" for _ in range(rng.randint(40, 200))) for _ in range(60)]
    rows = list(enumerate(good + junk))
    labels = [(i, int(i < 600), 0) for i, _ in rows if i % 2 == 0] + [(None, 1, 0), (99999, 0, 0), (1, None, 0)]
    judged = quality.judge(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), loss=0.005)
    kept = {r.doc_id for r in judged.where("kept").collect()}
    held_out = [i for i, _ in rows if i % 2]
    assert sum(i in kept for i in held_out if i < 600) >= 295 and not [i for i in held_out if i >= 600 and i in kept]

