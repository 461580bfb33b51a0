"""The registered queries of this subpackage and the SQL that expresses some of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import matches, verdicts

    found = verdicts(matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_at")


def _remainder(name: str, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo ``divisor``."""
    return F.crc32(F.col(name).cast("string")) % divisor


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, score

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    fold = labels.where(_remainder("doc_id", 3) != 1).select("doc_id", F.col("toxic").alias("label"))
    model = learn(docs, fold)
    return score(docs, model).select("doc_id", (_remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brownlm import fit, score

    docs = _table(spark, sf_dir, "documents")
    model, counts = fit(docs.where(_remainder("doc_id", 7) != 2).select("text"))
    scored = score(docs, model, counts)
    return scored.select("doc_id", (_remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngramjoin import similar_groups

    return similar_groups(_table(spark, sf_dir, "documents"), size=4, percent=85)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_table

    return quality_table(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import learn, predict

    docs = _table(spark, sf_dir, "documents")
    model = learn(docs.where(_remainder("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", (_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(spark, _table(spark, sf_dir, "pages"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .veccodes import compress

    return compress(_table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    drawn = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlrules import RULES, judge, rule_table

    judged = judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark, RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_id": op8_language_id,
    "op9_warc": op9_warc,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_vector_codes": op11_vector_codes,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_url_filter": op13_url_filter,
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _lower(text: str) -> str:
    return _LOWER.format(text)


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all({_lower(f"coalesce({text}, '')")}, '{pattern}')"


#: Windows by size and text, the words they hit, and longest runs of equal words on a diagonal.
_OP1 = f"""
WITH d AS (SELECT doc_id, {_words('text', _ALNUM)} AS w FROM documents), i AS (SELECT item_id, {_words('text', _ALNUM)} AS q FROM benchmark),
iw AS (SELECT item_id, least(13, len(q)) AS n, unnest(list_transform(range(1, greatest(1, len(q) - 12) + 1), lambda a: array_to_string(q[a : a + least(13, len(q)) - 1], ' '))) AS g FROM i WHERE len(q) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS a, unnest(list_transform(range(1, len(w) - n + 2), lambda a: array_to_string(w[a : a + n - 1], ' '))) AS g FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, n, a, item_id FROM dw JOIN (SELECT DISTINCT item_id, n, g FROM iw) USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(a, a + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hits GROUP BY doc_id),
dp AS (SELECT doc_id, unnest(range(0, len(w))) AS p, unnest(w) AS x FROM d), ip AS (SELECT item_id, unnest(range(0, len(q))) AS o, unnest(q) AS x FROM i),
pairs AS (SELECT doc_id, item_id, p, p - o AS diagonal FROM dp JOIN ip USING (x)),
runs AS (SELECT doc_id, min(p) AS begin_at, count(*) AS n_run FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p) AS island FROM pairs) GROUP BY doc_id, item_id, diagonal, island HAVING count(*) > 1),
best AS (SELECT doc_id, max(n_run) AS longest, arg_min(begin_at, begin_at - n_run * 100000000) AS longest_at FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest, CAST(longest_at AS BIGINT) AS longest_at
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN best USING (doc_id)"""


def _op4() -> str:
    from .licenses import PERCENT, SHINGLE, TEMPLATES, words_of

    rows = []
    for name, text in sorted(TEMPLATES.items()):
        words = words_of(text)
        n = min(SHINGLE, len(words))
        rows += [f"('{name}', {n}, '{g}')" for g in sorted({" ".join(words[k : k + n]) for k in range(len(words) - n + 1)})]
    return f"""
WITH t(license, n, g) AS (VALUES {', '.join(rows)}), size AS (SELECT license, count(*) AS total FROM t GROUP BY license), ns AS (SELECT DISTINCT n FROM t),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '{_ALNUM}') AS w FROM documents WHERE text IS NOT NULL),
dw AS (SELECT doc_id, n, unnest(range(0, len(w) - n + 1)) AS a, unnest(list_transform(range(1, len(w) - n + 2), lambda a: array_to_string(w[a : a + n - 1], ' '))) AS g FROM d, ns WHERE len(w) >= n)
SELECT doc_id, license, count(DISTINCT g) / CAST(any_value(total) AS DOUBLE) AS containment, CAST(min(a) AS INT) AS first_word
FROM dw JOIN t USING (n, g) JOIN size USING (license) GROUP BY doc_id, license HAVING 100 * count(DISTINCT g) >= {PERCENT} * any_value(total)"""


#: Pairs of distinct sets that share a shingle, and what links reach.
_OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words('text', _SPACED)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(unnest(list_transform(range(1, greatest(1, len(w) - 3) + 1), lambda a: array_to_string(w[a : a + 3], ' ')))) AS g FROM d WHERE len(w) > 0),
k AS (SELECT doc_id, count(*) AS n, md5(string_agg(CAST(g AS VARCHAR), ',' ORDER BY g)) AS dg FROM s GROUP BY doc_id),
r AS (SELECT dg, min(doc_id) AS rep, any_value(n) AS n FROM k GROUP BY dg),
c AS (SELECT rep, n, g FROM s JOIN r ON r.rep = s.doc_id),
p AS (SELECT a.rep AS x, b.rep AS y FROM c a JOIN c b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
reach AS (SELECT rep AS node, rep AS seen FROM r UNION SELECT node, y FROM reach JOIN e ON e.x = seen),
least_of AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id FROM d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (dg) LEFT JOIN least_of ON node = rep"""

#: Five bits of the digest a letter.
_BITS = "array_to_string(list_transform(string_split(sha1(x), ''), lambda c: lpad(bin(CAST('0x' || c AS INT)), 4, '0')), '')"
_OP9 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages), b AS (SELECT page_id, x, {_BITS} AS bits FROM p), f AS (SELECT x, min(page_id) AS one FROM p GROUP BY x)
SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(CAST(('0b' || substr(bits, CAST(5 * k + 1 AS BIGINT), 5)) AS VARCHAR) AS INT)]), '') AS payload_digest,
  CASE WHEN page_id = one THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> one THEN one END AS refers_to FROM b JOIN f USING (x)"""



def _op11(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds of assignment and floored means over (vector, part, place, integer) rows."""
    near = """(SELECT v.i, v.part, w.entry, v.d FROM (SELECT i, part, min(d) AS d FROM {d} GROUP BY i, part) v JOIN (SELECT i, part, d, min(entry) AS entry FROM {d} GROUP BY i, part, d) w USING (i, part, d))"""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"d{k} AS MATERIALIZED (SELECT i, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN b{k} USING (part, place) GROUP BY i, part, entry)")
        steps.append(f"a{k} AS MATERIALIZED {near.format(d=f'd{k}')}")
        if k < rounds:
            steps.append(
                f"b{k + 1} AS MATERIALIZED (SELECT part, entry, place, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT part, entry, place, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM x JOIN a{k} USING (i, part) GROUP BY part, entry, place) m USING (part, entry, place))"
            )
    last = rounds
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, label, embedding, len(embedding) // {parts} AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT i, k // w AS part, k % w AS place, CAST(floor(4096 * CAST(y AS DOUBLE)) AS BIGINT) AS x FROM (SELECT i, w, unnest(range(0, len(embedding))) AS k, unnest(embedding) AS y FROM e)),
b0 AS MATERIALIZED (SELECT part, i AS entry, place, x AS c FROM x WHERE i < {entries}),
{", ".join(steps)},
s AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM b{last}),
t AS MATERIALIZED (SELECT i, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY i)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM t JOIN e USING (i) CROSS JOIN s"""


#: CRC-32 of a text, byte by byte, over its table.
_CRC_ROW = "list_reduce(list_prepend(CAST(k AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
_BYTES = "list_transform(range(0, strlen(g)), lambda j: CAST(('0x' || substr(hex(encode(g)), CAST(2 * j + 1 AS BIGINT), 2)) AS BIGINT))"
_OP12 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_words('text', _ALNUM)} AS w FROM documents), q AS MATERIALIZED (SELECT {_words('text', _ALNUM)} AS w FROM benchmark),
df AS MATERIALIZED (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda a: array_to_string(w[a : a + 1], ' ')), list_transform(range(1, len(w) - 1), lambda a: array_to_string(w[a : a + 2], ' ')))) AS g FROM d) GROUP BY doc_id, g),
qf AS MATERIALIZED (SELECT g, count(*) AS n FROM (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda a: array_to_string(w[a : a + 1], ' ')), list_transform(range(1, len(w) - 1), lambda a: array_to_string(w[a : a + 2], ' ')))) AS g FROM q) GROUP BY g),
crc AS MATERIALIZED (SELECT list({_CRC_ROW} ORDER BY k) AS t FROM (SELECT unnest(range(256)) AS k)),
b AS MATERIALIZED (SELECT g, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda s, x: xor(t[CAST((xor(s, x) & 255) + 1 AS BIGINT)], s >> 8)), 4294967295) % 10000 AS bucket FROM (SELECT g, {_BYTES} AS bytes FROM (SELECT g FROM df UNION SELECT g FROM qf)) CROSS JOIN crc),
s AS MATERIALIZED (SELECT bucket, sum(n) AS s FROM df JOIN b USING (g) GROUP BY bucket), t AS MATERIALIZED (SELECT bucket, sum(n) AS t FROM qf JOIN b USING (g) GROUP BY bucket),
gain AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(s), 0) FROM s) + 10000 AS DOUBLE) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM t) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
w AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM df JOIN b USING (g) JOIN gain USING (bucket) GROUP BY doc_id),
r AS (SELECT d.doc_id, len(w) >= 20 AS large, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(CAST(('0x' || substr(sha256('42:' || d.doc_id), 1, 8)) AS BIGINT) AS DOUBLE) + 5e-1) / 4294967296e0))) AS BIGINT) AS score FROM d LEFT JOIN w USING (doc_id)),
p AS (SELECT *, row_number() OVER (ORDER BY large DESC, score DESC, doc_id) AS place FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * (SELECT count(*) FROM r WHERE large) // 100 THEN CAST(place AS BIGINT) END AS rank FROM p"""


def _op13() -> str:
    from .urlrules import RULES

    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
WITH r(h, p, v) AS (VALUES {rows}), u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
a AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM a JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM a LEFT JOIN m USING (page_id)"""


ORACLE_SQL: dict[str, str] = {"op11_vector_codes": _op11(), "op12_importance_resampling": _OP12, "op13_url_filter": _op13(), "op1_decontamination": _OP1, "op4_license_scan": _op4(), "op6_ngram_jaccard_join": _OP6, "op9_warc": _OP9}
