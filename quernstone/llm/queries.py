"""The contract queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import grammar, html, mixing, neardup, packing, pii, quality, rules, substrings, vectors
from quernstone.llm.shared import table


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "whole", "ranges")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest_rows(table(spark, sf_dir, "documents"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.digest_rows(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_rows(table(spark, sf_dir, "documents"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.digest_rows(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op2_mix`` that SQL can express."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target")


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op5_pii`` that SQL can express."""
    return pii.digest_rows(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_mix": op2_mix,
    "op3_substrings": op3_substrings,
    "op4_neardup": op4_neardup,
    "op5_pii": op5_pii,
    "op6_repair": op6_repair,
    "op7_rules": op7_rules,
    "op8_vectors": op8_vectors,
    "op9_pack": op9_pack,
    "op10_quality": op10_quality,
    "mix_targets": mix_targets,
    "pii_counts": pii_counts,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP3 = rf"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS st FROM d),
k AS (SELECT doc_id, st, row_number() OVER (PARTITION BY list_slice(w, st + 1, st + 20) ORDER BY doc_id, st) AS n FROM i),
g AS (SELECT DISTINCT doc_id, unnest(range(st, st + 20)) AS p FROM k WHERE n > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
r AS (SELECT doc_id, count(g.p) AS gone, string_agg(word, ' ' ORDER BY p) FILTER (g.p IS NULL) AS kept FROM x LEFT JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)"""

_OP4 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE list_slice(w, i, i + 2) END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.least, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id"""

_OP7 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS st FROM d),
k AS (SELECT doc_id, st, count(*) OVER (PARTITION BY doc_id, list_slice(w, st, st + 7)) AS n FROM i),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest(range(st, st + 8)) AS p FROM k WHERE n > 1) GROUP BY doc_id),
m AS (SELECT doc_id, t, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, greatest(len(w), 1) AS n FROM l LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR n_symbols * 5 > n OR n_dup_lines * 10 > n_lines * 3 OR word_chars < 2 * n OR word_chars > 15 * n
    OR len(regexp_extract_all(t, '\p{{Lu}}{{2,}}[^\x20\x09-\x0D]*')) * 2 > n OR len(regexp_extract_all(t, '[!?]{{2,}}')) * 4 > n OR len(regexp_extract_all(t, '[0-9]')) * 3 > word_chars + 1) AS kept FROM b"""

_OP8 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(list_filter(embedding, lambda q: q IS NOT NULL AND isfinite(q))) = len(embedding) AND len(list_filter(embedding, lambda q: q <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) >= 0.9 * sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x))),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a), k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m.least, vec_id)) AS component_id, vec_id <= coalesce(m.least, vec_id) AS kept
FROM embeddings LEFT JOIN m ON m.a = vec_id LEFT JOIN k ON k.a = vec_id"""

# A target is three times all words, less twice those of the sources at their limit, by weight; the sources of least size for their weight reach theirs first.
_MIX = rf"""WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (place - 1) % 3] AS weight, sum(n) OVER () AS words FROM s),
c AS (SELECT *, sum(n) OVER before AS full_words, sum(weight) OVER after AS open_weight FROM w
    WINDOW before AS (ORDER BY n / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (ORDER BY n / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
u AS (SELECT (3 * words - 4 * coalesce(full_words, 0))::BIGINT AS wanted, (2 * open_weight)::BIGINT AS parts FROM c
    WHERE weight * (3 * words - 4 * coalesce(full_words, 0)) <= 4 * n * open_weight ORDER BY n / weight, place LIMIT 1)
SELECT doc_id, size, n AS source_size, CASE WHEN weight * wanted <= 2 * n * parts THEN (weight * wanted)::DOUBLE / parts::DOUBLE ELSE (2 * n)::DOUBLE END AS target
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source CROSS JOIN u"""

_PII = r"""WITH f AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email,
    regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip, regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+') AS card,
    regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') AS phone FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
SELECT doc_id, len(email)::BIGINT AS n_email,
    len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR lpad(ltrim(p, '0'), 3, '0') > '255')) = 0))::BIGINT AS n_ip,
    len(list_filter(list_transform(card, lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))), lambda d: length(d) BETWEEN 12 AND 19
        AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[i]::INT ELSE (2 * d[i]::INT) // 10 + (2 * d[i]::INT) % 10 END)) % 10 = 0))::BIGINT AS n_card,
    len(list_filter(phone, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15))::BIGINT AS n_phone FROM f"""

#: SQL that gives the same rows. The others need trees, tokens, checksums or a seeded order, and are tested against brute force.
ORACLES: dict[str, str] = {
    "op3_substrings": _OP3,
    "op4_neardup": _OP4,
    "op7_rules": _OP7,
    "op8_vectors": _OP8,
    "mix_targets": _MIX,
    "pii_counts": _PII,
}
