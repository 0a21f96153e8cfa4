"""One query for each operator of this subpackage over the test tables, with its oracle SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave.llm import centroids, decontaminate, lattice, length_buckets, licences, line_dedup, neighbours, ngram_join, pages, quality, shards, spelling, token_counts
from trialweave.llm.pieces import load_pieces

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_CRC = """list_reduce(
    list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: xor(crc_table[1 + (xor(c, b) & 255)], c >> 8))"""
_SHARD = "list_max(list_transform(range({n}), lambda j: {{'v': -1.0 / ln((('0x' || substr(md5(doc_id || ':' || j), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496), 's': j}}))['s']::INTEGER"


@query(f"""
    WITH bits AS (
        SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc_table),
    digest AS (
        SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, xor({_CRC}, 4294967295) AS text_crc32,
            {_SHARD.format(n=16)} AS shard, {_SHARD.format(n=17)} AS grown_shard
        FROM documents, bits)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
        row_number() OVER (PARTITION BY shard ORDER BY substr(md5(concat_ws(':', doc_id, size, text_crc32, grown_shard)), 1, 3), doc_id) - 1 AS slot
    FROM digest""")
def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Law `key`: 16 shards of equal weight, and a seventeenth."""
    out = shards.shard_documents(table(spark, folder, "documents"), [1.0] * 16, [1.0] * 17)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _canonical_sql(line: str) -> str:
    out = f"regexp_replace(lower({line}), '{licences.COPYRIGHT}', '')"
    out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    for pattern, replacement in licences.SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{replacement.replace('$', chr(92))}', 'g')"
    return f"trim({out})"


_KNOWN_SQL = ", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in licences.KNOWN)
_FORMS_SQL = f"list_transform(string_split_regex(text, '\\r\\n|\\r|\\n'), lambda x: {_canonical_sql('x')})"
_WHOLE_SQL = "array_to_string(list_filter(forms, lambda x: x <> ''), ' ')"


@query(f"""
    WITH known AS (
        SELECT sha256({_WHOLE_SQL}) AS digest, min(license_id) AS license_id
        FROM (SELECT license_id, {_FORMS_SQL} AS forms FROM (VALUES {_KNOWN_SQL}) AS t(license_id, text)) GROUP BY ALL),
    forms AS (SELECT doc_id, {_FORMS_SQL} AS forms FROM documents WHERE text IS NOT NULL),
    units AS (
        SELECT doc_id, 'document' AS scope, 0 AS line, {_WHOLE_SQL} AS form FROM forms
        UNION ALL SELECT doc_id, 'line', generate_subscripts(forms, 1)::INTEGER, unnest(forms) FROM forms)
    SELECT doc_id, scope, line, license_id, digest
    FROM (SELECT *, sha256(form) AS digest FROM units WHERE form <> '') JOIN known USING (digest)""")
def op7_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"), licences.known_licences(spark))


@query()
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), load_pieces(PIECES))


@query()
def op8_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all others."""
    return neighbours.search(table(spark, folder, "embeddings"), F.col("id") % 20 == 0, 20)


@query()
def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract_pages(table(spark, folder, "pages"))


@query(r"""
    WITH RECURSIVE split AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    sets AS (
        SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
        FROM split),
    sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
    shingles AS (SELECT doc_id, n, unnest(s) AS shingle FROM sized),
    links AS (
        SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND b.n * 100 >= a.n * 90 AND a.n * 100 >= b.n * 90
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
    reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
    SELECT doc_id, n AS n_shingles, min(y) AS component_id FROM sized JOIN reach ON doc_id = x GROUP BY doc_id, n""")
def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Three-word shingles, linked at nine tenths."""
    return ngram_join.join_documents(table(spark, folder, "documents"), n=3, share=(9, 10))


@query()
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, folder, "documents"), find=line_dedup.block_lines)
    return out.select("doc_id", "text", "deleted_lines")


@query()
def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the quality classifier accepts; the source is the host and the language its path."""
    site = F.col("source")
    return quality.score(docs, labels, site, F.concat_ws("/", site, F.col("lang"))).where("accepted")


@query()
def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    out = accepted_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return out.select("doc_id", "source", "lang", "p_good", "p_toxic", "host_posterior", "path_posterior", "posterior", "accepted")


@query()
def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.encode_and_decode(table(spark, folder, "documents"), load_pieces(PIECES)).withColumn("n_pieces", F.size("ids"))


_RUN_CRC = _CRC.replace("coalesce(text, '')", "doc_id || ':' || run")


@query(f"""
    WITH RECURSIVE bits AS (
        SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc_table),
    runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
    counted AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
    hashed AS (SELECT run, c, xor({_RUN_CRC}, 4294967295) AS h FROM counted, bits),
    edited AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed),
    vocabulary AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM edited WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
    cuts AS MATERIALIZED (
        SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM vocabulary)),
    near AS (
        SELECT a.word, b.word AS near, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM cuts a JOIN vocabulary b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM cuts a JOIN vocabulary b ON a.rest = b.word),
    best AS (SELECT word, count(*) AS n_near, min({{'less': -n, 'near': near}}) AS b FROM near GROUP BY word),
    forms AS MATERIALIZED (
        SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 10 * v.n THEN b.near END AS form, CASE WHEN -b.less >= 10 * v.n THEN -b.less END AS form_n
        FROM vocabulary v LEFT JOIN best USING (word)),
    steps AS (
        SELECT word, word AS root, form AS next FROM forms
        UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN forms f ON s.next = f.word)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM steps WHERE next IS NULL) USING (word)""")
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(table(spark, folder, "documents"))


_FINITE = "list_count({0}) = len({0}) AND len(list_filter({0}, lambda x: NOT isfinite(x))) = 0"
_FLOORED = "list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)"


@query(f"""
    WITH kept AS (SELECT vec_id, {_FLOORED} AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND {_FINITE.format("embedding")}),
    scores AS (
        SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * r.v[i]))::BIGINT AS score
        FROM kept q JOIN kept r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v))
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""")
def op11_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all others."""
    return length_buckets.search(table(spark, folder, "embeddings"), F.col("id") % 100 == 0, 10)


def _rounds_sql(rounds: int) -> str:
    """A pair of steps for each round: the assignment of every vector, and the centroids that follow from it."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
            SELECT row_id, min({{'d': d, 'c': c}}) AS best FROM (
                SELECT row_id, c, sum((x - y) * (x - y))::BIGINT AS d FROM parts JOIN c{r} USING (j) GROUP BY row_id, c) GROUP BY row_id)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
            SELECT c{r}.c, c{r}.j, coalesce(m.y, c{r}.y) AS y FROM c{r} LEFT JOIN (
                SELECT best.c AS c, j, floor(sum(x)::DECIMAL(38, 0) / count(*))::BIGINT AS y FROM parts JOIN a{r} USING (row_id) GROUP BY ALL) m ON c{r}.c = m.c AND c{r}.j = m.j)""")
    return ",\n    ".join(steps)


@query(f"""
    WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, {_FLOORED} AS v FROM embeddings WHERE len(embedding) = 64 AND {_FINITE.format("embedding")}),
    first AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL QUALIFY c < 8),
    parts AS MATERIALIZED (SELECT row_id, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM kept),
    c0 AS MATERIALIZED (SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS j FROM first),
    {_rounds_sql(10)},
    digests AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c10 GROUP BY c)
    SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia, centroid_sha256
    FROM a10 JOIN kept USING (row_id) JOIN digests ON digests.c = best.c""")
def op13_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, folder, "embeddings"))
