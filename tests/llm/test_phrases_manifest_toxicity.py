"""Collocations, the Merkle manifest and the toxicity classifier against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from spindrift.llm import manifest, phrases, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents() -> list[tuple]:
    """Texts over a few words, so that phrases recur, with odd rows."""
    rng = random.Random(3)
    words = ["ab", "Cd", "é", "x y", "the", "of", "#7"]
    gaps = [" ", " ", " ", "\t ", "\n", ", ", "; "]
    text = lambda n: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(n))
    rows = [(i, text(rng.randint(0, 60)), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "ä", None]), rng.choice([None, i])) for i in range(60)]
    rows += [(100, "", "en", "lone", 0), (101, None, None, "b", None), (102, "of the " * 300, "en", "a", 5), (103, "...", "xx", "", 3)]
    rows += [(104, "Of THE of the", "en", "a", 1)] * 3 + [(104, "of", "en", "a", 1), (None, "ab cd ab", "en", "a", 1), (None, None, None, None, None)]
    return rows


def test_context_order_and_intervals():
    rng = np.random.default_rng(1)
    for _ in range(60):
        symbols = rng.integers(0, int(rng.integers(2, 6)), int(rng.integers(1, 80)))
        text = np.concatenate([[0], symbols, [0]])
        for depth in (2, 5):
            index = phrases.BidirectionalIndex(text, depth)
            found = index.words()
            for n in range(1, depth + 1):
                if n > 1:
                    found = index.left(found) if (n + depth) % 2 else index.right(found)
                want = Counter(g for i in range(len(text) - n + 1) if 0 not in (g := tuple(text[i : i + n].tolist())))
                assert dict(zip(map(tuple, found.symbols.tolist()), found.count.tolist(), strict=True)) == dict(want)
                for side, name, flip in ((index.forward, "forward", 1), (index.backward, "backward", -1)):
                    # Each interval holds the suffixes that begin with the phrase.
                    source = text[::flip]
                    order = phrases.context_order(source, depth)
                    for phrase, low, count in zip(found.symbols.tolist(), getattr(found, name).tolist(), found.count.tolist(), strict=True):
                        assert all(source[p : p + n].tolist() == phrase[::flip] for p in order[low : low + count])
                    assert len(side.place) == len(text)


def brute_collocations(rows, longest, least, top):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", lower(text or "")):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        known = {p: a for p, a in counts.items() if a >= least}
        found = []
        for p, a in known.items():
            if len(p) < 2:
                continue
            longer = [q for q in known if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and known[q] >= a]
            cuts = [(math.floor(Fraction(1000 * a * n[lang], counts[p[:k]] * counts[p[k:]])), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if not longer:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def test_collocations(spark, documents):
    df = spark.createDataFrame(documents, DOCS).withColumns({"words": F.lit(1), "slot": F.lit("s"), "TOTAL": F.lit(None).cast("int")}).repartition(5)
    for longest, least, top in ((5, 5, 2000), (2, 3, 4), (4, 12, 2000)):
        got = phrases.collocations(df, longest=longest, least=least, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        want = brute_collocations(documents, longest, least, top)
        assert sorted(map(tuple, got.collect())) == want and want
    assert phrases.collocations(df.limit(0), least=2).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0)], DOCS), least=1).count() == 0


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000
    counts = spark.createDataFrame([(big, big - 1, big * 3)], "a long, l long, n long")
    wide = counts.select(*[F.col(c).cast("decimal(19,0)").alias(f"{c}_") for c in "aln"]).withColumn("r_", F.col("l_"))
    assert wide.select(F.expr("(1000BD * a_ * n_) div (l_ * r_)")).first()[0] == 1000 * big * big * 3 // (big - 1) ** 2


def brute_manifest(rows, fan):
    """(id, leaf, subroot, root, proof, folded root) of every row; texts of even ids are lower-cased in the claims."""

    def leaf(values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tree(nodes):
        """Root, and for each node the list of (place, run)."""
        paths, level = [[] for _ in nodes], list(nodes)
        at = list(range(len(nodes)))
        while len(level) > 1:
            runs = [level[i : i + fan] for i in range(0, len(level), fan)]
            for i, a in enumerate(at):
                paths[i].append((a % fan, runs[a // fan]))
            at = [a // fan for a in at]
            level = [sha("".join(run)) for run in runs]
        return level[0], paths

    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        told = lower(text) if text is not None and i is not None and i % 2 == 0 else text
        groups[source].append(((i is not None, i or 0), i, leaf((i, source, lang, n, text)), leaf((i, source, lang, n, told))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    below = {}
    for s in names:
        groups[s].sort(key=lambda g: (g[0], g[2]))
        below[s] = tree([g[2] for g in groups[s]])
    root, above = tree([below[s][0] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        for (_, i, mine, claimed), path in zip(groups[s], below[s][1], strict=True):
            proof = "".join(d for place, run in path + up for k, d in enumerate(run) if k != place)
            folded = claimed
            for place, run in path + up:
                folded = sha("".join([*run[:place], folded, *run[place + 1 :]]))
            out.append((i or -1, mine, below[s][0], root, proof, folded))
    return sorted(out)


def test_manifest(spark, documents):
    df = spark.createDataFrame(documents, DOCS).withColumns({"tree": F.lit(1), "RANK": F.lit(2), "digest": F.lit("x")}).repartition(3)
    claims = lambda v: {"text": F.when(v["doc_id"] % 2 == 0, manifest.lower_ascii(v["text"])).otherwise(v["text"])}
    for fan, levels in ((16, 3), (2, 1), (3, 2)):
        found = manifest.merkle_manifest(df, claims=claims, fan=fan, levels=levels).collect()
        got = sorted((r.id or -1, r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in found)
        assert got == brute_manifest(documents, fan)
        assert all((r.folded_root == r.root) == (r.claimed == r.leaf) for r in found)
        assert all(manifest.fold(r.leaf, r.path, r.proof) == r.root for r in found)
    assert manifest.merkle_manifest(df.limit(0)).count() == 0


def test_manifest_of_one_row(spark):
    row = [(1, "a", "en", None, 1)]
    r = manifest.merkle_manifest(spark.createDataFrame(row, DOCS)).first()
    assert (r.leaf, r.proof, r.path) == (r.root, "", "") and r.subroot == r.leaf


def test_present_features_are_those_of_each_text():
    texts = ["Idiot  idiot", "", None, "é\tä", "ab"]
    column = pa.array(texts)
    row, feature = toxicity.present(column)
    for i, text in enumerate(texts):
        plain = " " + re.sub(r"\s+", " ", (text or "").lower()) + " "
        grams = {plain[p : p + k] for k in toxicity.ORDERS for p in range(len(plain) - k + 1)}
        assert np.count_nonzero(row == i) == len(grams)
        alone = toxicity.present(pa.array([text], pa.string()))[1]
        assert alone.tolist() == feature[row == i].tolist()
    use = np.zeros(1 << toxicity.BITS, bool)
    use[feature[:3]] = True
    assert set(toxicity.present(column, use)[1].tolist()) <= set(feature[:3].tolist())


def test_log_count_ratios():
    ratio = toxicity.log_count_ratios(np.array([[1.0, 50, 10], [60, 50, 11]]), np.array([100.0, 100]))
    assert ratio[0] == pytest.approx(math.log((61 / 102) / (2 / 102))) and ratio[1] == ratio[2] == 0


def test_gradient_by_differences():
    rng = np.random.default_rng(5)
    rows = [rng.choice(6, int(rng.integers(0, 6)), replace=False) for _ in range(30)]
    number, ends = np.concatenate(rows), np.cumsum([len(r) for r in rows])
    label, scaled, weight = rng.integers(0, 2, 30), rng.normal(size=6), rng.normal(size=7)
    _, gradient = toxicity.loss_and_gradient(number, ends, label, scaled, weight)
    for i in range(7):
        step = np.zeros(7)
        step[i] = 1e-6
        up, down = (toxicity.loss_and_gradient(number, ends, label, scaled, weight + s)[0] for s in (step, -step))
        assert gradient[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_minimise_reaches_the_minimum():
    a = np.diag([1.0, 10, 100])
    best = toxicity.minimise(np.array([5.0, 5, 5]), lambda x: (float(x @ a @ x) / 2 - x.sum(), a @ x - 1), 60)
    assert best == pytest.approx([1, 0.1, 0.01], abs=1e-4)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    bad = ["frogface", "dunderhead", "blockhead"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text)))
        if i % 10 < 7:
            labels.append((i, int(toxic)))
    rows += [(2000, ""), (2001, None), (None, "frogface dunderhead"), (3, rows[3][1]), (2002, "mild words " * 20_000)]
    labels += [(None, 1), (99999, 1), (5, 0), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"label": F.lit("x"), "score": F.lit(1), "toxic": F.lit(0)})
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.toxicity(docs, marks).collect()
    assert len(found) == len(rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    held = [r for r in found if r.held_out and r.doc_id < 900]
    right = [r.predicted == int(r.doc_id % 5 == 0) for r in held]
    assert len(held) > 100 and sum(right) / len(right) > 0.97
    odd = {r.doc_id: r.score for r in found if r.doc_id is None or r.doc_id >= 2000}
    assert odd[None] > 0.5 > odd[2000] == odd[2001] and odd[2002] < 0.3
    # Labels of held-out rows have no effect.
    flipped = [(i, 1 - t if i is not None and t is not None and zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    again = toxicity.toxicity(docs, spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()
    assert sorted((r.doc_id or -1, r.score) for r in again) == sorted((r.doc_id or -1, r.score) for r in found)
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, marks.limit(0)).collect()} == {0.5}
