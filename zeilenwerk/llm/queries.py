"""The registered queries of the operators here, with production parameters, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table


def vocabulary() -> str:
    """The vocabulary file of op4 and of the pipeline: ZEILENWERK_BPE, or the installed public one."""
    if at := os.environ.get("ZEILENWERK_BPE"):
        return at
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.report(spark, table(spark, sf_dir, "pages"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.dedup(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.report(table(spark, sf_dir, "documents"))


def op4_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    done = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), decoded="decoded")
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repeats

    return repeats.removed(table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neighbours

    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import merkle

    return merkle.compared(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.taken(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.report(table(spark, sf_dir, "documents"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import trie

    return trie.trie(table(spark, sf_dir, "conversations"))


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lines

    return lines.report(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import resampling

    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_neardup": op2_neardup,
    "op3_licenses": op3_licenses,
    "op4_bpe_tree": op4_bpe_tree,
    "op5_toxicity": op5_toxicity,
    "op6_repeats": op6_repeats,
    "op7_neighbours": op7_neighbours,
    "op8_merkle": op8_merkle,
    "op9_mixing": op9_mixing,
    "op10_pii": op10_pii,
    "op11_trie": op11_trie,
    "op12_lines": op12_lines,
    "op13_resampling": op13_resampling,
}
#: CRC-32 of the bytes b, a byte in eight steps.
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform({b}, lambda v: [v + 256, 0, 0, 0, 0, 0, 0, 0]))), lambda c, v: CASE WHEN v >= 256 THEN CASE WHEN xor(c, v - 256) & 1 = 1 THEN xor(xor(c, v - 256) >> 1, 3988292384) ELSE xor(c, v - 256) >> 1 END WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"
_BYTES = "list_transform(range(1, length(hex(encode({x}))), 2), lambda i: CAST(('0x' || substr(hex(encode({x})), i, 2)) AS BIGINT))"
#: op2 (a self-join over shingles), op6 (all windows) and op7 (all pairs) would be too slow as SQL on whole tables, and
#: op3, op4, op5, op9 and op10 hold what SQL lacks; tests/llm has brute-force versions of them.
SQL: dict[str, str] = {
    "op11_trie": """WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY p) AS own FROM t GROUP BY conv_id),
c AS (SELECT conv_id, own, """
    + _CRC.format(b=_BYTES.format(x="CAST(conv_id AS VARCHAR)"))
    + """ % 9 AS h FROM o),
s AS (SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS seq FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 5),
x AS (SELECT conv_id, len(seq) AS n, d, seq[1:d] AS pre, seq[d].t AS last FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM s)),
m AS (SELECT d, pre, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(any_value(last))) END AS bytes, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM x GROUP BY d, pre),
k AS (SELECT d - 1 AS d, pre[1:d - 1] AS pre, count(*) AS n_children FROM m WHERE d > 0 GROUP BY 1, 2),
y AS (SELECT m.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * bytes AS saved FROM m LEFT JOIN k ON k.d = m.d AND k.pre = m.pre),
u AS (SELECT a.d, a.pre, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(b.saved) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM y) b JOIN y a ON a.d = b.up AND a.pre = b.pre[1:b.up] GROUP BY 1, 2)
SELECT y.conv_id, y.d AS depth, q.conv_id AS parent_conv_id, y.n_convs, y.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(y.ends) AS ends_sha256
FROM y JOIN u ON u.d = y.d AND u.pre = y.pre LEFT JOIN y q ON q.d = y.d - 1 AND q.pre = y.pre[1:y.d - 1]""",
    "op12_lines": r"""WITH r AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, ls[i] AS line, i, translate(trim(ls[i], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM r)),
f AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (doc_id IS DISTINCT FROM first AND length(k) >= 10) AS n_dropped,
sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT (doc_id IS DISTINCT FROM first AND length(k) >= 10)), '')) AS kept_sha256 FROM l LEFT JOIN f USING (k) GROUP BY r""",
    "op13_resampling": r"""WITH a AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
w AS (SELECT side, r, doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM a),
g AS (SELECT side, r, unnest(list_concat(ws, list_concat(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])))) AS x FROM w),
n AS (SELECT side, r, x, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT x, """
    + _CRC.format(b=_BYTES.format(x="x"))
    + r""" % 10000 AS b FROM (SELECT DISTINCT x FROM n)),
h AS (SELECT b, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM n JOIN c USING (x) GROUP BY b),
z AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (sum(coalesce(s, 0)) OVER () + 10000)::DOUBLE / ((coalesce(s, 0)::DOUBLE + 1) * (sum(coalesce(t, 0)) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM h),
v AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM n JOIN c USING (x) JOIN z USING (b) WHERE side = 0 GROUP BY r),
d AS (SELECT w.doc_id, w.r, len(ws) AS m, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(w.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w LEFT JOIN v USING (r) WHERE w.side = 0),
e AS (SELECT *, row_number() OVER (PARTITION BY m >= 20 ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY m >= 20) AS wide FROM d)
SELECT doc_id, n_features, weight, score, CASE WHEN m >= 20 AND k <= 5 * wide // 100 THEN k END AS rank FROM e""",
    "op1_warc": """WITH q AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(encode(coalesce(html, ''))) AS d FROM pages),
f AS (SELECT d, min(page_id) AS m FROM q WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m <> page_id THEN m END AS refers_to, CAST(1 AS BIGINT) AS n_requests
FROM q LEFT JOIN f USING (d)""",
    "op8_merkle": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
n AS (SELECT doc_id, x, coalesce(lead(x) OVER w, first_value(x) OVER w) AS y FROM t WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT doc_id, 1 AS kind, x AS s FROM n UNION ALL SELECT doc_id, 2, substr(x, 1, length(x) - length(x) // 3) || substr(y, 1, length(x) // 3) FROM n UNION ALL SELECT doc_id, 3, y FROM n),
p AS (SELECT doc_id, kind, s, list_transform(list_filter(string_split_regex(s, '\n[ \t\r]*\n'), lambda a: trim(a, chr(9) || chr(10) || chr(13) || ' ') <> ''),
  lambda a: list_transform(list_filter(string_split_regex(a, '[\n\r]'), lambda b: trim(b, chr(9) || chr(10) || chr(13) || ' ') <> ''),
  lambda b: list_transform(list_filter(string_split(regexp_replace(b, '([.!?|,;:])[ \t]+', '\1' || chr(1), 'g'), chr(1)), lambda c: trim(c, chr(9) || chr(10) || chr(13) || ' ') <> ''), lambda c: sha256(trim(c, ' '))[1:8]))) AS tree FROM e),
g AS (SELECT doc_id, kind, s, list_distinct(flatten(flatten(tree))) AS leaves, array_to_string(list_transform(tree, lambda a: array_to_string(list_transform(a, lambda b: array_to_string(b, ',')), ';')), '/') AS txt FROM p),
h AS (SELECT doc_id, kind, s, leaves, sha256(sha256(s) || array_to_string(list_transform(string_split(txt, '/'), lambda a: sha256(array_to_string(list_transform(string_split(a, ';'), lambda b: sha256(b)), ''))), '')) AS root, txt FROM g),
k AS (SELECT a.doc_id, a.s, a.root || ':' || a.txt AS fp, b.s AS es, b.root || ':' || b.txt AS efp, a.root AS ra, b.root AS rb, c.root AS rc, a.leaves AS la, b.leaves AS lb, c.leaves AS lc FROM h a JOIN h b USING (doc_id) JOIN h c USING (doc_id) WHERE a.kind = 1 AND b.kind = 2 AND c.kind = 3)
SELECT doc_id, CAST(length(s) AS BIGINT) AS n_chars, sha256(es) AS edited_sha256, fp AS fingerprint, efp AS edited_fingerprint,
CASE WHEN ra = rb THEN 1.0::DOUBLE ELSE least(len(list_intersect(la, lb)) / greatest(len(la) + len(lb) - len(list_intersect(la, lb)), 1)::DOUBLE, 0.999) END AS near_edited,
CASE WHEN ra = rc THEN 1.0::DOUBLE ELSE least(len(list_intersect(la, lc)) / greatest(len(la) + len(lc) - len(list_intersect(la, lc)), 1)::DOUBLE, 0.999) END AS near_next FROM k""",
}
