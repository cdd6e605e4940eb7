"""The registered queries of this subpackage; each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe_replay, collocations, embedding_dedup, lattice_lm, lexical_search, mixing, packing, quality_rules, recompression, secrets, simhash, site_quality, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules.quality(_table(spark, sf_dir, "documents"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (F.col("kept") & ~base_failed).alias("kept"))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=2, length=4096)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "toxic", folds=3, held_fold=1)
    return r.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "neighbours", "cosines")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = simhash.simhash_components(_table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return r.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"), folds=5, held_fold=1)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = secrets.scan(_table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("plain", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return s.select("doc_id", *[n(k) for k in secrets.PLAIN], F.sha2(secrets.listed(F.col("plain")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = recompression.substring_dedup(_table(spark, sf_dir, "documents"), window=20)
    return r.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_replay.encode(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op9_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Documents carry no address: their source stands for the host, the language below it for the path.
    path = F.concat_ws("/", "source", "lang")
    return site_quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), F.col("source"), path, "quality", folds=3, held_fold=1)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, docs = mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), repeat=3)
    taken = mixed.groupBy("row").agg(F.sum("length").alias("taken"))
    return docs.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(_table(spark, sf_dir, "documents"))
    return lexical_search.search(index, _table(spark, sf_dir, "benchmark"), k=10)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), max_n=3, least=10, cover=50, top=2000)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_lattice_lm": op5_lattice_lm,
    "op6_secret_scans": op6_secret_scans,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_site_quality": op9_site_quality,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_mixing": op11_mixing,
    "op12_lexical_search": op12_lexical_search,
    "op13_collocations": op13_collocations,
}
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_STOPS = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))

#: The operators that SQL can express; the others are tested against brute force, round trips or held-out rows.
ORACLES: dict[str, str] = {
    "op1_quality_rules": f"""
        WITH w AS (SELECT doc_id, coalesce(text, '') t, {_WORDS} ws FROM documents),
        win AS (SELECT doc_id, s, array_to_string(list_slice(ws, s, s + 2), ' ') k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) s FROM w)),
        twice AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) n FROM win) WHERE n > 1),
        cover AS (SELECT doc_id, count(DISTINCT s + j) n FROM twice, (SELECT unnest([0, 1, 2]) j) GROUP BY 1),
        l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls FROM w),
        m AS (SELECT l.doc_id, len(ws)::BIGINT n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT word_chars,
            (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines, len(ls) n_lines,
            coalesce(cover.n, 0)::BIGINT n_repeat_words, len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) stops FROM l LEFT JOIN cover USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed,
            n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words AND word_chars / n_words BETWEEN 1.5 AND 15 AND n_symbols / n_words <= 0.1 AND stops / n_words >= 0.02 AND n_dup_lines / greatest(n_lines, 1) <= 0.3 kept FROM m
    """,
    "op7_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS} ws FROM documents),
        win AS (SELECT doc_id, s, array_to_string(list_slice(ws, s, s + 19), ' ') k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) s FROM w)),
        late AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) r FROM win) WHERE r > 1),
        gone AS (SELECT DISTINCT doc_id, s + j p FROM late, (SELECT unnest(range(0, 20)) j)),
        tok AS (SELECT doc_id, unnest(ws) word, unnest(range(1, len(ws) + 1)) p FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) t, count(*) n FROM tok ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
        SELECT w.doc_id, len(ws)::BIGINT n_words, (len(ws) - coalesce(n, 0))::BIGINT n_removed, sha256(coalesce(t, '')) kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op10_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) e FROM embeddings),
        ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id a, b.vec_id b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT vec_id id, vec_id r FROM v UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a)
        SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) n_links, c.component_id, c.component_id = v.vec_id kept FROM v JOIN (SELECT id, min(r) component_id FROM reach GROUP BY 1) c ON c.id = v.vec_id
    """,
    "op12_lexical_search": """
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term FROM documents),
        tf AS (SELECT doc_id, term, count(*) tf FROM t GROUP BY 1, 2),
        len AS (SELECT doc_id, sum(tf)::BIGINT n FROM tf GROUP BY 1),
        total AS (SELECT count(*) n_docs, sum(n)::BIGINT n_terms FROM len),
        q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term FROM benchmark),
        qn AS (SELECT item_id, term, count(*) times FROM q GROUP BY 1, 2),
        w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT w FROM (SELECT term, count(*) df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY 1), total),
        s AS (SELECT item_id, tf.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT score FROM qn JOIN w USING (term) JOIN tf USING (term) JOIN len ON len.doc_id = tf.doc_id, total GROUP BY 1, 2),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank::INTEGER rank, doc_id, score FROM r WHERE rank <= 10
    """,
    "op13_collocations": """
        WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') ws FROM p),
        g AS (SELECT lang, k, array_to_string(list_slice(ws, s, s + k - 1), ' ') phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) s FROM w, (SELECT unnest([1, 2, 3]) k))),
        f AS (SELECT lang, k, phrase, count(*) f FROM g GROUP BY ALL),
        c AS (SELECT lang, k, phrase, f a, string_split(phrase, ' ') ws FROM f WHERE k > 1 AND f >= 10),
        held AS (SELECT lang, phrase, max(a) longest FROM (SELECT lang, a, unnest([array_to_string(ws[1:k - 1], ' '), array_to_string(ws[2:k], ' ')]) phrase FROM c WHERE k > 2) GROUP BY 1, 2),
        alone AS (SELECT c.* FROM c LEFT JOIN held USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 50 * a),
        cut AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') lp, array_to_string(ws[j + 1:k], ' ') rp FROM (SELECT *, unnest(range(1, k)) j FROM alone)),
        scored AS (SELECT cut.lang, cut.phrase, a, j, l.f l, r.f r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT score FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = lp JOIN f r ON r.lang = cut.lang AND r.phrase = rp),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) rank FROM best)
        SELECT lang, rank::INTEGER rank, phrase, a, l, r, n, score FROM ranked JOIN (SELECT lang, sum(f)::BIGINT n FROM f WHERE k = 1 GROUP BY 1) USING (lang) WHERE rank <= 2000
    """,
}
