"""The registered queries of this package, each over its whole table, and their SQL where SQL can say the same."""
from pyspark.sql import functions as F

from tidemark.llm import decontam, exact, langid, linededup, mixing, packing, phrases, quality, resample, simhash, suffix, toxicity, urls
from tidemark.llm.common import table
from tidemark.runtime import pin_session


def op1_mix_sources(spark, sf_dir):
    """Sources mixed to target weights."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_simhash(spark, sf_dir):
    """Fingerprints of three-word shingles and their components within two bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    """Toxicity of the restored text."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality(spark, sf_dir):
    """Quality of the attention-weighted passages."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark, sf_dir):
    """Per document, the non-blank lines, those cut as later repeats, and a digest of what stays."""
    out = linededup.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_language(spark, sf_dir):
    """Language mixture of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark, sf_dir):
    """Groups of equal texts; a fourth of the rows come as a new batch against the snapshot of the rest."""
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_url_filter(spark, sf_dir):
    """Verdict of every page; a page's outcome is bad if the label with its id is of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0).alias("bad"))
    return urls.judge_urls(table(spark, sf_dir, "pages"), outcomes)


def op9_suffix_dedup(spark, sf_dir):
    """Bytes of every document covered by a 200-byte string that starts anywhere else."""
    return suffix.repeated_substrings(table(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    """(document, benchmark item) within the item's edit distance."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_phrases(spark, sf_dir):
    """Each language's 2000 best collocations of two to four words."""
    return phrases.collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_resample(spark, sf_dir):
    """A quarter of the documents, drawn by how much likelier their words are in the benchmark."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("drawn")


def op13_packing(spark, sf_dir):
    """Every document's tokens in sequences of at most 1024."""
    return packing.pack(table(spark, sf_dir, "documents"))


SQL = {
    "op7_exact_dedup": """
        SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) AS kept, sha256(body) AS text_sha256
        FROM (SELECT doc_id, body, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size
              FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
              WINDOW w AS (PARTITION BY body))""",
    "op8_url_filter": """
        WITH cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        rules(rule, domain, start, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
                                                       ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
        ruled AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM parts JOIN rules
                  ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start) GROUP BY page_id),
        known AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id),
        hosts AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, any_value(array_to_string(list_slice(string_split(host, '.'), -1 - labels, -1), '.')) AS domain,
                         any_value(array_to_string(list_slice(string_split(host, '.'), -labels, -1), '.')) AS suffix
                  FROM (SELECT *, CASE WHEN array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.jp', 'co.nz', 'com.br', 'co.in', 'com.cn')
                                       THEN 2 ELSE 1 END AS labels FROM parts) LEFT JOIN known ON doc_id = page_id GROUP BY host),
        total AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) AS p FROM hosts),
        s1 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(p) AS p FROM hosts, total GROUP BY suffix),
        k1 AS (SELECT CASE WHEN r > 0 THEN least(1000.0, greatest(1.0, 1 / r - 1)) ELSE 1000.0 END AS k FROM (SELECT (sum(n * (bad / n - p) ** 2) - sum(p * (1 - p))) / nullif(sum(n * p * (1 - p)) - sum(p * (1 - p)), 0) AS r FROM s1 WHERE n > 0)),
        m1 AS (SELECT suffix, (p * k + bad) / (k + n) AS p FROM s1, k1),
        s2 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(m1.p) AS p FROM hosts JOIN m1 USING (suffix) GROUP BY suffix, domain),
        k2 AS (SELECT CASE WHEN r > 0 THEN least(1000.0, greatest(1.0, 1 / r - 1)) ELSE 1000.0 END AS k FROM (SELECT (sum(n * (bad / n - p) ** 2) - sum(p * (1 - p))) / nullif(sum(n * p * (1 - p)) - sum(p * (1 - p)), 0) AS r FROM s2 WHERE n > 0)),
        m2 AS (SELECT suffix, domain, (p * k + bad) / (k + n) AS p FROM s2, k2),
        s3 AS (SELECT host, n, bad, p FROM hosts JOIN m2 USING (suffix, domain)),
        k3 AS (SELECT CASE WHEN r > 0 THEN least(1000.0, greatest(1.0, 1 / r - 1)) ELSE 1000.0 END AS k FROM (SELECT (sum(n * (bad / n - p) ** 2) - sum(p * (1 - p))) / nullif(sum(n * p * (1 - p)) - sum(p * (1 - p)), 0) AS r FROM s3 WHERE n > 0)),
        m3 AS (SELECT host, (p * k + bad) / (k + n) AS p, k + n AS w FROM s3, k3)
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN p - 1.645 * sqrt(p * (1 - p) / (w + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
        FROM parts LEFT JOIN ruled USING (page_id) LEFT JOIN m3 USING (host)""",
    "op11_phrases": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
        counted AS (SELECT lang, d, array_to_string(w[i:i + d - 1], ' ') AS phrase, count(*) AS f FROM places, (VALUES (1), (2), (3), (4)) v(d) WHERE i + d - 1 <= len(w) GROUP BY ALL),
        candidates AS (SELECT lang, d, phrase, f, string_split(phrase, ' ') AS w FROM counted WHERE d > 1 AND f >= 30),
        held AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(f) AS most FROM candidates, (VALUES (2), (3)) v(k), (VALUES (1), (2), (3)) u(i) WHERE k < d AND i + k - 1 <= d GROUP BY ALL),
        kept AS (SELECT c.* FROM candidates c LEFT JOIN held USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * f),
        cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:d], ' ') AS rest FROM kept, (VALUES (1), (2), (3)) v(k) WHERE k < d),
        scored AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS BIGINT) AS score FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = first JOIN counted y ON y.lang = c.lang AND y.phrase = rest),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        words AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE d = 1 GROUP BY lang)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best JOIN words USING (lang) QUALIFY rank <= 2000""",
    "op12_resample": r"""
        WITH RECURSIVE both_tables AS (SELECT false AS wanted, doc_id, text FROM documents UNION ALL SELECT true, NULL, text FROM benchmark),
        split AS (SELECT row_number() OVER () AS row, wanted, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM both_tables),
        places AS (SELECT row, wanted, w, unnest(range(1, len(w) + 1)) AS i FROM split),
        features AS (SELECT row, wanted, w[i] AS feature FROM places UNION ALL SELECT row, wanted, w[i] || ' ' || w[i + 1] FROM places WHERE i < len(w)),
        names AS (SELECT feature, hex(encode(feature)) AS hx FROM (SELECT DISTINCT feature FROM features)),
        crc_table AS (SELECT list(list_reduce(list_concat([x], [CAST(0 AS BIGINT) FOR b IN range(8)]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY x) AS t FROM (SELECT unnest(range(256)) AS x)),
        digits AS (SELECT feature, t, [16 * (strpos('0123456789ABCDEF', hx[2 * j - 1]) - 1) + strpos('0123456789ABCDEF', hx[2 * j]) - 1 FOR j IN range(1, len(hx) // 2 + 1)] AS bytes FROM names, crc_table),
        hashed AS (SELECT feature, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket FROM digits),
        placed AS (SELECT row, wanted, bucket, count(*) AS n FROM features JOIN hashed USING (feature) GROUP BY ALL),
        totals AS (SELECT bucket, coalesce(sum(n) FILTER (NOT wanted), 0) AS s, coalesce(sum(n) FILTER (wanted), 0) AS t FROM placed GROUP BY bucket),
        gains AS (SELECT bucket, floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE) / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS gain FROM totals),
        sums AS (SELECT row, sum(n) AS n_features, sum(n * gain) AS total FROM placed JOIN gains USING (bucket) WHERE NOT wanted GROUP BY row),
        weighed AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(total / n_features), 0) AS BIGINT) AS weight,
                           CAST('0x' || sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h FROM split LEFT JOIN sums USING (row) WHERE NOT wanted),
        scored AS (SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM weighed),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM ranked""",
}

QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_simhash, op3_toxicity, op4_quality, op5_line_dedup, op6_language, op7_exact_dedup, op8_url_filter, op9_suffix_dedup, op10_decontamination, op11_phrases, op12_resample, op13_packing)}


def _pinned(fn):
    def run(spark, sf_dir):
        return fn(pin_session(spark), str(sf_dir))
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def queries():
    return {name: _pinned(fn) for name, fn in QUERIES.items()}


def oracle_sql():
    return dict(SQL)
