"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors, chat, itq, licenses, manifest, packing, phrases, pii, quality, simhash, suffixes, tokens, toxicity

BPE = public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says control strings, formatted and read back."""
    text = "</s>[INST] ok [/INST]"
    said = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = chat.turns_of(_read(spark, sf_dir, "conversations")).union(chat.turns_of(said))
    return chat.read_back(chat.format_conversations(turns))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and fuzzy notices of all documents."""
    found = licenses.scan(_read(spark, sf_dir, "documents"))
    words, labels = F.col("base.word"), F.col("base.label")
    best = F.array_max(F.transform("found", lambda m: 1 - m["edits"] / m["chars"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.col("found.label"))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


def op3_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with equal labels."""
    return itq.near_duplicate_vectors(_read(spark, sf_dir, "embeddings"))


def op4_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    found = pii.find_spans(_read(spark, sf_dir, "documents"))
    counts = [_of_rank(i).cast("long").alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


def _of_rank(rank: int) -> Column:
    """How many base spans are of one kind."""
    return F.size(F.filter("base", lambda span: span["rank"] == F.lit(rank)))


def op5_substring_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents without 20-word runs that start earlier."""
    found = anchors.remove_repeats(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents without 50-byte strings of earlier documents."""
    found = suffixes.remove_repeated_bytes(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and the texts decoded from them."""
    found = tokens.decode(tokens.encode(_read(spark, sf_dir, "documents"), BPE), BPE)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents."""
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 ids."""
    return packing.pack(_read(spark, sf_dir, "documents"), BPE)


def op10_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdicts of all documents."""
    found = quality.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", *quality.COUNTS[:5], "base_failed", "kept", "score")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each language."""
    return phrases.collocations(_read(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, proofs and roots of all documents; every fifth by a hash of its id is checked with a lower-cased text."""

    def lowered(v: dict[str, Column]) -> dict[str, Column]:
        chosen = F.crc32(v["doc_id"].cast("string")) % 5 == 0
        return {"text": F.when(chosen, manifest.lower_ascii(v["text"])).otherwise(v["text"])}

    found = manifest.merkle_manifest(_read(spark, sf_dir, "documents"), claims=lowered)
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_license_scan": op2_license_scan,
    "op3_itq_near_dedup": op3_itq_near_dedup,
    "op4_contextual_pii": op4_contextual_pii,
    "op5_substring_anchors": op5_substring_anchors,
    "op6_suffix_array": op6_suffix_array,
    "op7_bpe": op7_bpe,
    "op8_simhash": op8_simhash,
    "op9_packing": op9_packing,
    "op10_quality_forest": op10_quality_forest,
    "op11_toxicity": op11_toxicity,
    "op12_collocations": op12_collocations,
    "op13_merkle_manifest": op13_merkle_manifest,
}



def _manifest_sql(levels: int = 8) -> str:
    """Level by level; ``levels`` suffice for 16 to that power of rows."""
    framed = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))

    def leaf(text: str) -> str:
        return f"sha256({framed} || coalesce(strlen({text}) || ':' || {text}, '-'))"

    bits = "list_reduce([xor(crc, b)] || list_transform(range(8), lambda j: j::UBIGINT), lambda c, j: xor(c >> 1, (c & 1) * 3988292384))"
    digits = "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)"
    crc = f"xor(list_reduce([4294967295::UBIGINT] || {digits}, lambda crc, b: {bits}), 4294967295::UBIGINT)"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"""d AS (SELECT doc_id, coalesce('s' || source, 'n') AS s, {leaf("text")} AS leaf,
            {leaf(f"CASE WHEN {crc} % 5 = 0 THEN {lowered} ELSE text END")} AS claimed FROM documents)""",
        """r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM d)""",
        "a0 AS (SELECT s, i, n, leaf AS h FROM r)",
    ]
    for t, first in (("a", "s"), ("b", "")):
        keys = f"{first}, " if first else ""
        if t == "b":
            steps.append(f"b0 AS (SELECT s AS name, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n, h FROM a{levels})")
        for k in range(levels):
            run = f"list(h) OVER (PARTITION BY {keys}i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
            steps.append(f"{t}{k}r AS (SELECT *, i // 16 AS up, i % 16 AS p, CASE WHEN n > 1 THEN {run} END AS run FROM {t}{k})")
            steps.append(f"{t}{k + 1} AS (SELECT {keys}up AS i, (n + 15) // 16 AS n, coalesce(sha256(array_to_string(any_value(run), '')), any_value(h)) AS h FROM {t}{k}r GROUP BY {keys}up, n)")
    previous = "r"
    fields = "doc_id, s, leaf, claimed AS f, '' AS proof, i"
    for t in "ab":
        if t == "b":
            steps.append(f"fb AS (SELECT x.doc_id, x.s, x.leaf, x.f, x.proof, b0.i, b0.h AS subroot FROM {previous} x JOIN b0 ON b0.name = x.s)")
            previous, fields = "fb", "doc_id, s, leaf, subroot, f, proof, i"
        for k in range(levels):
            same = "x.s = q.s AND " if t == "a" else ""
            kept = "x.doc_id, x.s, x.leaf, " + ("x.subroot, " if t == "b" else "")
            steps.append(
                f"""f{t}{k} AS (SELECT {kept}CASE WHEN q.run IS NULL THEN x.f ELSE sha256(array_to_string(q.run[1:p], '') || x.f || array_to_string(q.run[p + 2:], '')) END AS f,
                x.proof || coalesce(array_to_string(q.run[1:p] || q.run[p + 2:], ''), '') AS proof, q.up AS i
                FROM (SELECT {fields} FROM {previous}) x JOIN {t}{k}r q ON {same}x.i = q.i)"""
            )
            previous = f"f{t}{k}"
            fields = "doc_id, s, leaf, " + ("subroot, " if t == "b" else "") + "f, proof, i"
    return f"""WITH {", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in steps)}
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
        FROM {previous}, (SELECT h AS root FROM b{levels})"""


#: DuckDB SQL where it can state the result. Fuzzy patterns, seeded XXH64, byte-level merges, the bootstrap, column
#: generation and the forest have none; those queries are tested against brute force.
ORACLES: dict[str, str] = {
    "op1_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), e AS (
            SELECT *, regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') AS escaped FROM t
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(17 + length(role) + length(escaped)) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op3_itq_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), ok AS (
            SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM v
            UNION
            SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
        ), c AS (
            SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
        ), n AS (
            SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a
        )
        SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op5_substring_anchors": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), k AS (
            SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS place
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)
        ), gone AS (
            SELECT DISTINCT doc_id, i + j AS p FROM k, (SELECT unnest(range(0, 20)) AS j) WHERE place > 1
        ), words AS (
            SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
        ), kept AS (
            SELECT w.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (g.p IS NULL) AS text
            FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p GROUP BY w.doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op6_suffix_array": """
        WITH d AS (
            SELECT doc_id, encode(coalesce(text, '')) AS body FROM documents
        ), h AS (
            SELECT doc_id, hex(body) AS x, octet_length(body) AS n FROM d
        ), p AS (
            SELECT doc_id, place, substr(x, 2 * place + 1, 1122) AS y FROM (SELECT doc_id, x, unnest(range(0, n, 512)) AS place FROM h)
        ), s AS (
            SELECT doc_id, place + i AS i, md5_number(substr(y, 2 * i + 1, 100)) AS k
            FROM (SELECT *, unnest(range(0, least(512, length(y) // 2 - 49))) AS i FROM p)
        ), f AS (
            SELECT k, min(doc_id) AS first FROM s GROUP BY k
        ), r AS (
            SELECT doc_id, i FROM s JOIN f USING (k) WHERE doc_id > first
        ), m AS (
            SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM r
        ), g AS (
            SELECT doc_id, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m
        ), spans AS (
            SELECT doc_id, run, min(i) AS low, max(i) + 50 AS high FROM g GROUP BY doc_id, run
        ), gaps AS (
            SELECT doc_id, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS a, low AS b FROM spans
            UNION ALL SELECT doc_id, max(high), NULL FROM spans GROUP BY doc_id
        ), kept AS (
            SELECT g.doc_id, string_agg(substr(x, CAST(2 * a + 1 AS BIGINT), CAST(2 * (coalesce(b, n) - a) AS BIGINT)), '' ORDER BY a) AS x FROM gaps g JOIN h USING (doc_id) GROUP BY g.doc_id
        ), counts AS (
            SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
        )
        SELECT h.doc_id, h.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
            sha256(unhex(coalesce(kept.x, h.x))) AS kept_sha256
        FROM h LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_collocations": r"""
        WITH pieces AS (
            SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)
        ), w AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
        ), grams AS (
            SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, w[i:i + k - 1] AS words
            FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k))
        ), f AS (
            SELECT lang, k, phrase, any_value(words) AS words, count(*) AS n FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100
        ), totals AS (
            SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
        ), cuts AS (
            SELECT lang, phrase, words, n AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1
        ), scored AS (
            SELECT c.lang, c.phrase, c.a, x.n AS l, y.n AS r, t.n, cut, ((1000::HUGEINT * c.a * t.n) // (x.n::HUGEINT * y.n))::BIGINT AS score
            FROM cuts c JOIN totals t USING (lang) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[:cut], ' ')
            JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[cut + 1:], ' ')
        ), best AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
        ), held AS (
            SELECT DISTINCT s.lang, s.phrase FROM f s JOIN f b ON s.lang = b.lang AND b.k > s.k AND s.k > 1 AND 100 * b.n >= 100 * s.n
            AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM best ANTI JOIN held USING (lang, phrase) QUALIFY rank <= 2000""",
    "op13_merkle_manifest": _manifest_sql(),
}
