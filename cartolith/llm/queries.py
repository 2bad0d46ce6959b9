"""The operators as queries over their whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, codebooks, exact_dedup, html_text, lm_score, mixing, near_dedup, neighbours, packing, quality, sharding, target_sampling, toxicity
from .common import SPACE_CLASS, table

TOKENIZER_FILE = packing.TOKENIZER


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def op1_order_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.order_minhash_classes(table(spark, sf_dir, "documents"))


def op2_rake_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), ["doc_id"])
    return mixed.select("doc_id", "_mix.topic", "_mix.tokens", F.round("_mix.weight", 6).alias("weight"), F.round("_mix.p", 6).alias("probability"), "_mix.kept")


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op4_permutation_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest_rows(rows, rows.where(F.col("vec_id") % 100 == 0))


def op5_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "_tox.score",
        (F.col("_tox.score") >= 0.5).cast("int").alias("predicted"),
        F.size("_tox.passages").alias("passages"),
    )


def op8_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", "_main.text", F.col("_main.chars").alias("n_chars"))


def op10_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_sort_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_sort_count_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_sampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_delta_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = codebooks.coded(table(spark, sf_dir, "embeddings"))
    out = codebooks.with_label_error(codes).withColumn("codebooks_sha256", F.lit(codebooks.digest(books)))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


#: A conversation that is formatted with every table: both of its texts hold control strings.
PROBE = "</s>[INST] ok [/INST]"


def op13_reply_tree_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    read = chat_format.read_back(chat_format.formatted(chat_format.reply_paths(chat_format.chained(rows))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    trained = F.array_join("trained", "")
    return read.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.length("chat").cast("long").alias("formatted_chars"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_order_minhash_near_dedup, op2_rake_mixing, op3_stupid_backoff, op4_permutation_neighbours, op5_label_propagation_shards,
        op6_importance_resampling, op7_toxic_segments, op8_nnls_packing, op9_html_main_text, op10_content_sort_dedup,
        op11_sort_count_resampling, op12_delta_lloyd_codes, op13_reply_tree_chats, pipeline,
    )
    return {f.__name__: f for f in own}


def _rake_sql(damping: float = 0.7, rounds: int = mixing.ROUNDS) -> str:
    dims = ("source", "lang", "topic")
    parts = [
        f"""toks AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens,
  regexp_extract_all(lower(coalesce(text, '')), '{mixing.CONTENT_WORD}') AS w FROM documents),
langs AS (SELECT lang, count(*) AS c FROM toks GROUP BY lang),
held AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(list_distinct(w)) AS w FROM toks) GROUP BY lang, w),
topics AS MATERIALIZED (SELECT h.lang, w, row_number() OVER (PARTITION BY h.lang ORDER BY n DESC, w) AS i FROM held h JOIN langs l ON h.lang IS NOT DISTINCT FROM l.lang
  WHERE n * {mixing.SPREAD} <= c AND c * {mixing.LANGUAGES} >= (SELECT count(*) FROM toks) QUALIFY i <= {mixing.TOPICS}),
hits AS (SELECT r, i, count(*) AS n FROM (SELECT r, lang, unnest(w) AS w FROM toks) x JOIN topics t ON x.w = t.w AND x.lang IS NOT DISTINCT FROM t.lang GROUP BY r, i),
best AS (SELECT r, arg_max(i, n * 1000 - i)::INTEGER AS topic FROM hits GROUP BY r),
docs AS MATERIALIZED (SELECT doc_id, source, lang, tokens, topic FROM toks LEFT JOIN best USING (r)),
c0 AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens, sum(tokens)::DOUBLE AS fitted FROM docs GROUP BY ALL)"""
    ]
    for d in dims:
        parts.append(f"t_{d} AS (SELECT {d}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {damping}) ELSE 0 END AS t FROM c0 GROUP BY {d})")
        parts.append(f"g_{d} AS (SELECT {d}, t * (SELECT sum(tokens) FROM c0) / (SELECT sum(t) FROM t_{d}) AS goal FROM t_{d})")
    step = 0
    for _ in range(rounds):
        for d in dims:
            parts.append(
                f"c{step + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN now > 0 THEN fitted * goal / now ELSE 0 END AS fitted FROM "
                f"(SELECT c.*, sum(fitted) OVER (PARTITION BY c.{d}) AS now, g.goal FROM c{step} c JOIN g_{d} g ON c.{d} IS NOT DISTINCT FROM g.{d}))"
            )
            step += 1
    parts.append(f"w AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN fitted / tokens END AS weight FROM c{step})")
    return (
        "WITH " + ",\n".join(parts) + """
SELECT doc_id, d.topic AS topic, d.tokens AS tokens, round(weight, 6) AS weight,
  round(CASE WHEN d.tokens > 0 THEN weight / (SELECT max(weight) FROM w) ELSE 1 END, 6) AS probability,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
    < CASE WHEN d.tokens > 0 THEN weight / (SELECT max(weight) FROM w) ELSE 1 END AS kept
FROM docs d JOIN w ON d.source IS NOT DISTINCT FROM w.source AND d.lang IS NOT DISTINCT FROM w.lang AND d.topic IS NOT DISTINCT FROM w.topic"""
    )


def _sort_count_sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    upper, size = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", target_sampling.BUCKETS
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{word}')"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
WITH RECURSIVE bits AS (SELECT range AS b, range::BIGINT AS c, 0 AS k FROM range(256) UNION ALL SELECT b, {step}, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
said AS MATERIALIZED (SELECT r, unnest(w) AS w FROM docs),
aim AS MATERIALIZED (SELECT unnest({words}) AS w FROM benchmark),
vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM said UNION SELECT w FROM aim)),
hashed AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {size} AS b FROM vocabulary, tab),
s AS (SELECT b, count(*) AS n FROM said JOIN hashed USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM aim JOIN hashed USING (w) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + {size})
  / ((s.n::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + {size}))))::BIGINT AS g FROM s LEFT JOIN t USING (b)),
summed AS (SELECT r, sum(g)::BIGINT AS weight FROM said JOIN hashed USING (w) JOIN gain USING (b) GROUP BY r),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
  + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN summed USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed"""


def _lloyd_sql(parts: int = codebooks.PARTS, entries: int = codebooks.ENTRIES, rounds: int = codebooks.ROUNDS) -> str:
    ctes = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({codebooks.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) t(p)),
c0 AS (SELECT p, r - 1 AS e, v FROM parts WHERE r <= {entries})"""
    ]
    far = "list_sum(list_transform(list_zip(a.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for k in range(rounds + 1):
        ctes.append(f"a{k} AS MATERIALIZED (SELECT r, p, a.v, min(struct_pack(d := {far}, e := c.e)) AS best FROM parts a JOIN c{k} c USING (p) GROUP BY r, p, a.v)")
        if k < rounds:
            ctes.append(
                f"n{k} AS (SELECT p, e, list(x ORDER BY j) AS v FROM (SELECT p, e, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (SELECT p, best.e AS e, unnest(v) AS x, unnest(range(len(v))) AS j FROM a{k}) GROUP BY p, e, j) GROUP BY p, e), "
                f"c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.v, c.v) AS v FROM c{k} c LEFT JOIN n{k} n USING (p, e))"
            )
    return (
        "WITH " + ",\n".join(ctes) + f""",
coded AS (SELECT r, string_agg(lower(lpad(to_hex(best.e), 2, '0')), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS j FROM c{rounds})) AS codebooks_sha256
FROM kept JOIN coded USING (r)"""
    )


def _chat_sql() -> str:
    def out(x: str) -> str:
        return f"regexp_replace({x}, '{chat_format.ESCAPE}', '\\1\\4\\\\\\2\\5\\3\\6', 'g')"

    role = out("replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")
    order = "ORDER BY turn NULLS LAST, role, text"
    return f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
  (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}'))))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat_format.START) + len(chat_format.END) + 2} + length({role}) + length({out("text")}))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_sort_count_resampling": _sort_count_sql(),
        "op12_delta_lloyd_codes": _lloyd_sql(),
        "op13_reply_tree_chats": _chat_sql(),
        "op2_rake_mixing": _rake_sql(),
        "op10_content_sort_dedup": f"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACE_CLASS}', '', 'g') AS norm, length(coalesce(text, '')) AS cp FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY cp DESC, doc_id)""",
    }
