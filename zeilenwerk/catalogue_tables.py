"""Queries of matching, catalogues and whole tables, with their SQL; they register beside the catalogue's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalogue import MODEL, TOTAL, greedy_sql, query
from .functions import text as tx
from .operators import bands, binding, cells, editing, fields, maintenance, merging, pages, projects, raster, reports, scans, textlayer, words
from .operators import rows as rules
from .operators import store as kept
from .sources import answers
from .sources import documents as store
from .sources import testdata as td
from .streaming.focus import carried_at_once
from .tables import buckets, scratch

NUM_SQL = "WITH num AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_seq FROM lineitem)"

# Bands of eight orders: their line items are numbered from 1 in each order, one in six is unread. Every 20th band is a
# profile, too, without its first two cells and its last one.
_BANDS = """num AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem),
b0 AS (SELECT l_orderkey // 8 AS band, row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, k) - 1 AS place, count(*) OVER (PARTITION BY l_orderkey // 8) AS n, k, CASE WHEN (l_partkey + k) % 6 > 0 THEN k END AS number FROM num),
c0 AS (SELECT *, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY band ORDER BY place) AS section FROM b0 WHERE band % 20 = 0 AND place >= 2 AND place < n - 1)"""


def _numbered(s, d):
    # dealt out once, by bands, in as many parts as the table's size asks for: an order is in one band
    items = td.table(s, d, "lineitem")
    order = W.partitionBy("band", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    n = items.withColumn("band", F.floor(F.col("l_orderkey") / 8)).repartition(buckets(items), "band").withColumn("k", F.row_number().over(order))
    band = W.partitionBy("band")
    return n.select("band", (F.row_number().over(band.orderBy("l_orderkey", "k")) - 1).alias("place"), F.count(F.lit(1)).over(band).alias("n"), "k", F.when((F.col("l_partkey") + F.col("k")) % 6 > 0, F.col("k")).alias("number"))


@query(
    "WITH "
    + _BANDS
    + """, c AS (SELECT band, list(k ORDER BY place) AS expected, list(CASE WHEN section = before THEN 0 ELSE 1 END ORDER BY place) AS bits, count(*) AS m FROM (SELECT *, lag(section) OVER (PARTITION BY band ORDER BY place) AS before FROM c0) GROUP BY band),
x AS (SELECT bits, m, arg_min(band, (-(band % 3), CAST(band AS VARCHAR))) AS exact FROM c GROUP BY bits, m), y AS (SELECT m, any_value(band) AS total FROM c GROUP BY m HAVING count(*) = 1),
w AS (SELECT band, list(number ORDER BY place) AS w FROM b0 GROUP BY band HAVING count(number) >= 6),
s AS (SELECT band, st, en, w[st + 1:en] AS r FROM (SELECT *, unnest(range(greatest(len(w) - 8, st + 8), len(w) + 1)) AS en FROM (SELECT *, unnest(range(0, least(8, len(w)))) AS st FROM w))),
f AS (SELECT band, st, en, r, list_transform(range(1, len(r) + 1), lambda i: CASE WHEN i = 1 OR r[i] = 1 OR (r[i] IS NULL AND r[i + 1] = 2) THEN 1 ELSE 0 END) AS bits FROM s),
g AS (SELECT f.*, coalesce(exact, total) AS profile FROM f LEFT JOIN x ON x.bits = f.bits AND x.m = len(f.bits) LEFT JOIN y ON y.m = len(f.bits)),
h AS (SELECT g.band, st, en, profile, len(list_filter(r, lambda v: v IS NOT NULL)) AS readable, len(list_filter(range(1, len(r) + 1), lambda i: r[i] = expected[i])) AS ok FROM g JOIN c ON c.band = g.profile),
q AS (SELECT *, ok / readable::DOUBLE AS quality FROM h WHERE readable > 0 AND ok / readable::DOUBLE >= 0.7)
SELECT band, u.st AS start, u.en AS stop, 'P' || u.profile AS profile_id, u.quality, u.readable FROM (SELECT band, arg_max({'st': st, 'en': en, 'profile': profile, 'quality': quality, 'readable': readable}, (quality, readable, -st, en)) AS u FROM q GROUP BY band)"""
)
def header_bands(s, d):
    """Which cut of each band is a profile's header."""
    n = _numbered(s, d)
    own = n.where((F.col("band") % 20 == 0) & (F.col("place") >= 2) & (F.col("place") < F.col("n") - 1))
    section = F.sum((F.col("k") == 1).cast("int")).over(W.partitionBy("band").orderBy("place"))
    known = own.select(F.concat(F.lit("P"), F.col("band").cast("string")).alias("profile_id"), (F.col("band") % 3).alias("priority"), "place", F.concat_ws(".", section.cast("string"), F.col("k").cast("string")).alias("address"))
    return bands.search(n, known, ["band"])


def _tier(x: str, y: str) -> str:
    return f"(CASE WHEN {x} = '' OR {y} = '' THEN 0::DOUBLE WHEN {x} = {y} THEN 1::DOUBLE WHEN (contains({x}, {y}) OR contains({y}, {x})) AND least(length({x}), length({y})) >= 4 THEN 0.85::DOUBLE + 0.1::DOUBLE * (least(length({x}), length({y})) / greatest(length({x}), length({y}))) ELSE 0::DOUBLE END)"


# Each brand is a table whose columns are its part names; three profiles are made of the names in use.
_NAMES = """nm AS (SELECT p_name AS name, row_number() OVER (ORDER BY p_name) - 1 AS place, lower(min(p_type)) AS type FROM part GROUP BY p_name),
h AS (SELECT p_brand AS doc, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) - 1 AS l, min(p_partkey) % 3 AS own, p_name AS name, lower(min(p_type)) AS grp, CASE WHEN min(p_partkey) % 7 = 0 THEN min(p_partkey) % 5 + 1 || '.' || (min(p_partkey) % 9 + 1) ELSE '' END AS adr FROM part GROUP BY p_brand, p_name),
c AS (SELECT profile, place AS r, 'K' || profile || '_' || place AS key, place % 5 + 1 || '.' || (place % 9 + 1) AS adr, type AS grp, split_part(name, ' ', 1) AS sub, CASE place % 3 WHEN 0 THEN split_part(name, ' ', 2) WHEN 1 THEN name ELSE name || ' komplett' END AS label, CASE WHEN place % 4 = 0 THEN split_part(name, ' ', 1) ELSE '' END AS alias FROM nm, (SELECT unnest(range(0, 3)) AS profile) WHERE (place + profile) % 4 > 0)"""


def _headers(s, d):
    p = td.table(s, d, "part").groupBy(F.col("p_brand").alias("doc"), "p_name").agg(F.min("p_partkey").alias("k"), F.lower(F.min("p_type")).alias("group_name"))
    k = F.col("k")
    address = F.when(k % 7 == 0, F.concat(F.lit(" 0"), (k % 5 + 1).cast("string"), F.lit(","), (k % 9 + 1).cast("string"))).otherwise("")
    # the profile is the document's: that of its first name
    at = F.row_number().over(W.partitionBy("doc").orderBy("p_name")) - 1
    profile = F.first(k % 3).over(W.partitionBy("doc").orderBy("p_name"))
    return p.select("doc", at.cast("int").alias("column_index"), F.concat(F.lit("profil "), profile.cast("string")).alias("profile_id"), address.alias("address"), "group_name", F.initcap(F.substring_index("p_name", " ", 1)).alias("subgroup"), F.col("p_name").alias("label"), F.lit(None).cast("string").alias("abbrev"))


def _catalogue(s, d):
    name = td.table(s, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_type").alias("group_name"))
    # some ten names, whatever the size
    at = name.withColumn("place", F.row_number().over(W.orderBy("name")) - 1).withColumn("profile", F.explode(F.sequence(F.lit(0), F.lit(2)))).where((F.col("place") + F.col("profile")) % 4 > 0)
    r, first = F.col("place"), F.substring_index("name", " ", 1)
    label: Column = F.when(r % 3 == 0, F.substring_index("name", " ", -1)).when(r % 3 == 1, F.col("name")).otherwise(F.concat("name", F.lit("  komplett")))
    text = lambda c: c.cast("string")
    return at.select(
        F.concat(F.lit("profil "), text(F.col("profile"))).alias("profile_id"), "place", F.concat(F.lit("K"), text(F.col("profile")), F.lit("_"), text(r)).alias("column_key"), F.concat_ws(".", text(r % 5 + 1), text(r % 9 + 1)).alias("address"),
        "group_name", first.alias("subgroup"), label.alias("label"), F.lit("").alias("abbrev"), F.when(r % 4 == 0, F.array(first)).otherwise(F.array().cast("array<string>")).alias("aliases"), (r % 10 == 0).alias("is_note"),
    )


_BEST = f"greatest({_tier('h.name', 'c.label')}, {_tier('h.name', 'c.alias')}, 0.95::DOUBLE * {_tier('h.whole', 'c.label')}, 0.95::DOUBLE * {_tier('h.whole', 'c.alias')})"


@query(
    "WITH RECURSIVE "
    + _NAMES
    + f""", o AS (SELECT *, first_value(own) OVER (PARTITION BY doc ORDER BY l) AS profile, grp || ' ' || split_part(name, ' ', 1) || ' ' || name AS whole FROM h),
a AS (SELECT profile, adr, min(r) AS r FROM c GROUP BY ALL), j AS (SELECT o.*, a.r AS bound FROM o LEFT JOIN a ON a.profile = o.profile AND a.adr = o.adr),
v AS (SELECT h.doc, h.l, c.r, {_BEST} AS s0, h.grp AS hg, c.grp AS cg, split_part(h.name, ' ', 1) AS hs, c.sub AS cs FROM j h JOIN c ON c.profile = h.profile WHERE h.bound IS NULL),
v1 AS (SELECT doc, l, r, hs, cs, CASE WHEN {_tier('hg', 'cg')} > 0.7 THEN least(1, s0 + 0.08::DOUBLE) ELSE s0 END AS s1 FROM v),
v2 AS (SELECT doc, l, r, CASE WHEN {_tier('hs', 'cs')} > 0.7 THEN least(1, s1 + 0.05::DOUBLE) ELSE s1 END AS score FROM v1),
p AS (SELECT doc, l, r, score FROM v2 WHERE score >= 0.78::DOUBLE UNION ALL SELECT doc, l, bound, 1.5 FROM j WHERE bound IS NOT NULL), """
    + greedy_sql("p", ["doc"], "score DESC")
    + """ SELECT o.doc, CAST(o.l AS INT) AS column_index, c.key AS column_key, CASE WHEN p.score IS NULL THEN 0 ELSE round(least(1, p.score), 3) END AS match_score, coalesce(c.r % 10 = 0, false) AS is_note
FROM o LEFT JOIN t ON t.doc = o.doc AND t.l = o.l LEFT JOIN p ON p.doc = o.doc AND p.l = o.l AND p.r = t.r LEFT JOIN c ON c.profile = o.profile AND c.r = t.r"""
)
def columns_matched(s, d):
    """Headers bound to their profile's columns, one to one; likeness by its tiers, which SQL has, too."""
    found = binding.match_columns(_headers(s, d), _catalogue(s, d), ["doc"], lambda a, b: F.coalesce(binding.tiered(a, b), F.lit(0.0)))
    return found.select("doc", "column_index", "column_key", "match_score", "is_note")


def norm_sql(x: str) -> str:
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("Ä", "ae"), ("Ö", "oe"), ("Ü", "ue")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"""WITH k AS (SELECT 'p' || item_id % 5 AS profile, {norm_sql("substr(text, 4, 24)")} AS word, CASE WHEN item_id % 7 = 0 THEN -1.5 ELSE 1 + item_id % 3 END AS weight FROM benchmark),
n AS (SELECT doc_id, {norm_sql("coalesce(text, '')")} AS x FROM documents), p AS (SELECT unnest(range(0, 5)) AS i),
h AS (SELECT doc_id, profile, sum(weight) AS score FROM n JOIN k ON contains(x, word) GROUP BY ALL),
a AS (SELECT doc_id, i, coalesce(score, 0)::DOUBLE AS score FROM n CROSS JOIN p LEFT JOIN h USING (doc_id) WHERE h.profile IS NULL OR h.profile = 'p' || i UNION SELECT n.doc_id, i, 0 FROM n CROSS JOIN p ANTI JOIN h ON h.doc_id = n.doc_id AND h.profile = 'p' || i),
b AS (SELECT doc_id, arg_max({{'i': i, 's': score}}, (score, i % 3, -i)) AS b FROM a GROUP BY doc_id)
SELECT doc_id, CASE WHEN b.s >= 1.5 THEN 'p' || b.i END AS profile_id, b.s AS score FROM b"""
)
def detected_profiles(s, d):
    """The profile of each document by pieces of the benchmark's texts, some of which count against it."""
    b = td.table(s, d, "benchmark")
    i = F.col("item_id")
    words = b.select(F.concat(F.lit("p"), (i % 5).cast("string")).alias("profile_id"), F.substring("text", 4, 24).alias("text"), F.when(i % 7 == 0, -1.5).otherwise(1.0 + i % 3).alias("weight"))
    known = s.range(5).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("profile_id"), (F.col("id") % 3).alias("priority"), F.lit(1.5).alias("min_score"))
    return binding.detect_profile(td.table(s, d, "documents").select("doc_id", "text"), words, known).drop("scores")


_EDITS = f"""{MODEL}, e AS (SELECT doc_id, row_seq, column_index, page_index, kind0 AS kind, CASE WHEN (doc_id + row_seq) % 40 = 0 AND column_index = 0 THEN cnt + 1 WHEN (doc_id + row_seq) % 40 = 0 AND column_index = 1 THEN NULL ELSE cnt END AS cnt
FROM (SELECT c.*, r.page_index, CASE WHEN doc_id % 25 = 3 AND kind = 'uebertrag' THEN 'summe' ELSE kind END AS kind0 FROM c JOIN r USING (doc_id, row_seq))),
x AS (SELECT doc_id, page_index, column_index, {TOTAL.format("CASE WHEN kind = 'daten' THEN cnt END")} AS own, {TOTAL.format("CASE WHEN kind = 'uebertrag' THEN cnt END")} AS carry, {TOTAL.format("CASE WHEN kind = 'summe' THEN cnt END")} AS reported FROM e WHERE cnt IS NOT NULL GROUP BY ALL),
y AS (SELECT *, bool_or(own IS NOT NULL) OVER w AND bool_or(reported IS NOT NULL) OVER w AS ok, round(coalesce(own, 0) + coalesce(carry, 0), 2) AS computed FROM x WINDOW w AS (PARTITION BY doc_id, page_index))
SELECT doc_id, page_index, column_index, reported, computed, reported IS NULL OR abs(reported - computed) < 1e-6 AS matches FROM y WHERE ok"""


@query(_EDITS)
def rechecked_pages(s, d):
    """A store of sum checks after edits of cells and of kinds, corrected page by page."""
    at = scratch(s, "checked")
    facts = td.rows_with_cells(s, d)
    maintenance.create(facts, at)
    changed = facts.where((F.col("doc_id") + F.col("row_seq")) % 40 == 0).select("doc_id", "row_seq", F.inline("cells")).where("column_index < 2")
    changed = changed.select("doc_id", "row_seq", "column_index", F.when(F.col("column_index") == 0, F.col("count") + 1).alias("count"))
    kinds = facts.where("doc_id % 25 = 3 and kind = 'uebertrag'").select("doc_id", "row_seq", F.lit("summe").alias("kind"))
    maintenance.edit(s, at, changed, kinds)
    return maintenance.checks(s, at)


@query("SELECT CAST(conv_id AS VARCHAR) AS doc_id, page_index, row_seq, coalesce(nullif(last_value(c IGNORE NULLS) OVER (PARTITION BY conv_id, page_index ORDER BY row_seq), '-'), '') AS focus FROM (SELECT conv_id, CAST(turn // 5 AS INT) AS page_index, CAST(turn AS INT) AS row_seq, CASE WHEN turn % 7 = 6 THEN '-' WHEN (conv_id + turn) % 3 = 0 THEN 'ASP0' || turn % 4 END AS c FROM conversations)")
def focus_carried(s, d):
    """The focus that holds at each turn; streaming.focus gives the same from micro-batches."""
    c = td.table(s, d, "conversations")
    t = F.col("turn")
    rows = c.select(F.col("conv_id").alias("doc_id"), F.floor(t / 5).alias("page_index"), t.alias("row_seq"), F.when(t % 7 == 6, "summe").otherwise("daten").alias("kind"), F.when((F.col("conv_id") + t) % 3 == 0, F.concat(F.lit("ASP0"), (t % 4).cast("string"))).alias("code"), F.lit("").alias("code_label"))
    return carried_at_once(rows).drop("focus_label")


# Orders as pages of words: a title, a head of two sections with upright labels, and a line for each line item.
_FIXED_WORDS = [(40.0 * i, 10.0, 30.0, 8.0, t) for i, t in enumerate("Liste der Funktionen eines Auftrags mit allen Teilen".split())]
_FIXED_WORDS += [(100.0, 120.0, 45.0, 8.0, "Abschnitt"), (216.0, 120.0, 8.0, 8.0, "1."), (296.0, 120.0, 8.0, 8.0, "02"), (100.0, 140.0, 30.0, 8.0, "Spalte"), (400.0, 60.0, 50.0, 8.0, "Bemerkung")]
_FIXED_WORDS += [(197.0 + 40 * i, 140.0, 6.0, 8.0, n) for i, n in enumerate("1212")]
_FIXED_WORDS += [(196.0 + 40 * i, 60.0, 8.0, 50.0, t) for i, t in enumerate(("Menge", "Preis", "Rabatt", "Steuer"))] + [(236.0, 45.0, 8.0, 12.0, "1)")]


def _pages(s, d):
    # a page is a row that holds its words, as its line items are dealt out by orders; nothing else is moved
    r = td.rows_with_cells(s, d)
    k = F.col("row_seq")
    y = 160.0 + 20.0 * k
    number = F.rint(F.element_at("cells", 1)["count"]).cast("long").cast("string")
    first = F.when(F.col("kind") == "summe", "Summe").otherwise("Teil")
    at = [(20.0, F.col("row_no")), (50.0, first), (80.0, F.substring_index("datenpunkt", " ", -1)), (196.0, number), (236.0, F.when(k % 2 == 0, "x")), (276.0, F.when(k % 3 == 0, "frei")), (316.0, F.when(k % 4 == 0, number)), (405.0, F.when(k % 5 == 0, "Plan"))]
    word = lambda n, x, v: F.struct((k * 10 + n + 100).alias("word_id"), F.lit(x).alias("x0"), y.alias("y0"), F.lit(x + 8.0).alias("x1"), (y + 8.0).alias("y1"), v.alias("text"))
    line = F.filter(F.array(*[word(n, x, v) for n, (x, v) in enumerate(at)]), lambda w: w["text"].isNotNull())
    fixed = F.array(*[F.struct(F.lit(n).alias("word_id"), F.lit(x).alias("x0"), F.lit(y0).alias("y0"), F.lit(x + w).alias("x1"), F.lit(y0 + h).alias("y1"), F.lit(t).alias("text")) for n, (x, y0, w, h, t) in enumerate(_FIXED_WORDS)])
    own = r.groupBy("doc_id").agg(F.collect_list(line).alias("lines"))
    return own.select("doc_id", F.lit(0).alias("page_index"), F.concat(fixed, F.flatten("lines")).alias("words"), F.lit(600.0).alias("width"), F.lit(None).cast("double").alias("bottom"))


@query(MODEL + "SELECT doc_id, CAST(row_seq AS INT) AS row_seq, row_no, CASE WHEN kind = 'summe' THEN replace(datenpunkt, 'Teil', 'Summe') ELSE datenpunkt END AS label, CASE WHEN row_seq % 5 = 0 THEN 'Plan' ELSE '' END AS remark, CASE WHEN kind = 'summe' THEN kind ELSE 'daten' END AS kind FROM r")
def words_to_rows(s, d):
    """Pages of words become the rows that they were made of."""
    rows = pages.tables(_pages(s, d), ("row_no", "label", "remark", "kind")).rows
    return rows.select("doc_id", (F.col("row_seq") + 1).alias("row_seq"), "row_no", "label", "remark", "kind")


@query(
    NUM_SQL
    + """, v AS (SELECT l_orderkey AS doc_id, row_seq, round_even(l_quantity, 0) AS q FROM num)
SELECT doc_id, CAST(row_seq AS INT) AS row_seq, '1.1' AS address, 'Menge' AS label, q AS count, '' AS note FROM v UNION ALL SELECT doc_id, row_seq, '1.2', 'Preis 1)', 1, '' FROM v WHERE row_seq % 2 = 0 UNION ALL SELECT doc_id, row_seq, '2.1', 'Rabatt', NULL, 'frei' FROM v WHERE row_seq % 3 = 0 UNION ALL SELECT doc_id, row_seq, '2.2', 'Steuer', q, '' FROM v WHERE row_seq % 4 = 0"""
)
def words_to_cells(s, d):
    """What stands in the columns of such pages, with the columns' addresses and upright labels."""
    cells = pages.tables(_pages(s, d), cell=("count", "note", "address", "column_label")).cells
    return cells.select("doc_id", (F.col("line") + 1).cast("int").alias("row_seq"), "address", F.col("column_label").alias("label"), "count", "note")


@query(
    """WITH c AS (SELECT *, c_custkey AS k FROM customer)
SELECT k AS doc_id, f AS field, v AS value FROM c, LATERAL (VALUES ('gewerk', c_mktsegment), ('anlage', CASE WHEN k % 3 > 0 THEN 'A' || k % 7 ELSE 'Büro Nord' END), ('datum', '01.02.2024'), ('planersteller', 'Büro Nord'), ('blatt_nr', CAST(k % 10 AS VARCHAR)), ('blatt_von', CASE WHEN k % 5 > 0 THEN '12' END), ('projekt', 'Haus ' || k)) t(f, v) WHERE v IS NOT NULL"""
)
def word_fields(s, d):
    """Fields of a page for each customer: beside labels, below them, cut off by gaps, labels, stop words and the table."""
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    at = [
        (10.0, 10, F.lit("Gewerk:")), (55.0, 10, F.col("c_mktsegment")), (107.0, 10, F.lit("Anlage:")), (F.when(k % 3 > 0, 145.0).otherwise(190.0), 10, F.concat(F.lit("A"), text(k % 7))), (240.0, 10, F.lit("Name")), (290.0, 10, F.lit("niemand")),
        (10.0, 30, F.lit("Ausgabedatum")), (100.0, 30, F.lit("Planersteller")), (12.0, 50, F.lit("01.02.2024")), (102.0, 50, F.when(k % 2 == 0, "7").otherwise("Büro")), (140.0, 50, F.when(k % 2 == 1, "Nord")), (102.0, 70, F.when(k % 2 == 0, "Büro")), (140.0, 70, F.when(k % 2 == 0, "Nord")),
        (200.0, 90, F.when(k % 5 == 0, "von")), (240.0, 90, F.when(k % 5 == 0, "3")), (10.0, 110, F.lit("Blatt")), (50.0, 110, F.lit("Nr.")), (90.0, 110, text(k % 10)), (130.0, 110, F.when(k % 5 > 0, "von")), (165.0, 110, F.when(k % 5 > 0, "12")),
        (10.0, 130, F.lit("Projekt:")), (45.0, 130, F.lit("Haus")), (80.0, 130, text(k)), (110.0, 130, F.lit("Tabelle")), (10.0, 150, F.lit("Gewerk")), (50.0, 150, F.lit("später")),
    ]
    word = lambda n, x, y, v: F.struct(F.lit(n).alias("word_id"), (F.lit(x) if isinstance(x, float) else x).alias("x0"), F.lit(float(y)).alias("y0"), ((F.lit(x) if isinstance(x, float) else x) + 30.0).alias("x1"), F.lit(y + 8.0).alias("y1"), v.alias("text"))
    w = td.table(s, d, "customer").select(k.alias("doc_id"), F.lit(0).alias("page_index"), F.inline(F.filter(F.array(*[word(n, *x) for n, x in enumerate(at)]), lambda x: x["text"].isNotNull())))
    return fields.fields(w, w.select("doc_id", "page_index").distinct().withColumn("label_left", F.lit(105.0))).drop("page_index")


@query(MODEL + "SELECT d.doc_id, d.datei, count(r.row_seq) AS n_rows, count(r.row_seq) FILTER (r.kind = 'daten') AS n_data, max(r.datenpunkt) AS last_label FROM d LEFT JOIN r USING (doc_id) WHERE d.projekt = 'MACHINERY' AND d.doc_id > 100 GROUP BY d.doc_id, d.datei")
def stored_documents(s, d):
    """Documents with their children, written to a store and read by project and number."""
    docs = td.documents(s, d).withColumn("project", F.col("projekt"))
    at = scratch(s, "documents")
    store.write(store.nested(docs, {"rows": ["row_seq"]}, rows=td.rows_with_cells(s, d)), at)
    found = store.read(s, at, "MACHINERY").where("doc_id > 100")
    return found.select("doc_id", "datei", F.size("rows").cast("long").alias("n_rows"), F.size(F.filter("rows.kind", lambda x: x == "daten")).cast("long").alias("n_data"), F.array_max("rows.datenpunkt").alias("last_label"))


_LINES_OF_NUMBERS = "WITH w AS (SELECT user_id, event_id % 4 AS line, event_id, CASE WHEN event_id % 4 = 0 THEN CAST(floor(value) AS BIGINT) % 100 ELSE (row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY event_id) - 1) % (4 + event_id % 4 * 2) + 1 END AS n FROM events), x AS (SELECT *, lead(n) OVER (PARTITION BY user_id, line ORDER BY event_id) AS after FROM w), y AS (SELECT user_id, line, count(*) AS k, max(n) AS most, count(*) FILTER (n = 1) AS ones, count(*) FILTER (after = n + 1 OR after = 1) AS up FROM x GROUP BY ALL) "


@query(_LINES_OF_NUMBERS + "SELECT user_id AS doc_id, arg_max(line, (k + 2 * ones + up, -line)) AS line, max(k + 2 * ones + up) AS score FROM y WHERE k >= 8 AND most <= 30 AND up >= 0.7 * k GROUP BY user_id")
def number_rows(s, d):
    """Four lines of numbers a user, three of which count up and start again."""
    e, i = td.table(s, d, "events"), F.col("event_id")
    at = F.row_number().over(W.partitionBy("user_id", i % 4).orderBy("event_id")) - 1
    n = F.when(i % 4 == 0, F.floor("value").cast("long") % 100).otherwise(at % (4 + i % 4 * 2) + 1)
    y = (i % 4 * 20).cast("double")
    w = e.select(F.col("user_id").alias("doc_id"), F.lit(0).alias("page_index"), i.alias("word_id"), (i * 10.0).alias("x0"), y.alias("y0"), (i * 10.0 + 6).alias("x1"), (y + 8).alias("y1"), n.cast("string").alias("text"))
    return words.number_row(w).select("doc_id", F.col("line").cast("long").alias("line"), F.col("score").cast("long").alias("score"))


@query("WITH c AS (SELECT DISTINCT p_brand, p_name, CAST(p_size % 7 AS VARCHAR) AS m FROM part), f AS (SELECT DISTINCT p_brand, CAST(i AS VARCHAR) AS m FROM part, (SELECT unnest(range(0, 9)) AS i)) SELECT f.p_brand AS doc_id, f.m AS marker, coalesce(string_agg(p_name, ',' ORDER BY p_name), '') AS columns_ FROM f LEFT JOIN c USING (p_brand, m) GROUP BY ALL")
def footnote_columns(s, d):
    """Each footnote with the columns that carry its marker."""
    p = td.table(s, d, "part")
    columns = p.groupBy(F.col("p_brand").alias("doc_id"), F.col("p_name").alias("column_key")).agg(F.collect_set((F.col("p_size") % 7).cast("string")).alias("footnote_markers"))
    notes = p.select(F.col("p_brand").alias("doc_id")).distinct().withColumn("marker", F.explode(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: i.cast("string"))))
    return binding.assign_footnotes(notes, columns).select("doc_id", "marker", F.array_join("referenced_columns", ",").alias("columns_"))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_custkey % 2 = 0 THEN 'ablage/' || o_orderkey WHEN o_custkey % 3 = 0 THEN 'herkunft/' || o_custkey END AS quelle FROM orders")
def source_files(s, d):
    """The stored copy of a document's file, else where it came from, if there."""
    o = td.table(s, d, "orders")
    docs = o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("ablage/"), F.col("o_orderkey").cast("string")).alias("stored_path"), F.concat(F.lit("herkunft/"), F.col("o_custkey").cast("string")).alias("source_path"), "o_custkey")
    there = docs.where("o_custkey % 2 = 0").select(F.col("stored_path").alias("path")).unionByName(docs.where("o_custkey % 3 = 0").select(F.col("source_path").alias("path")).distinct())
    return reports.source_file(docs, there)


@query("WITH a AS (SELECT event_id, event_type, event_id % 5 AS n FROM events) SELECT event_id, CASE WHEN n < 2 THEN event_type || n WHEN event_type IN ('click', 'error') THEN event_type ELSE '{}' END AS answer FROM a")
def replayed_answers(s, d):
    """Recorded answers by purpose and number, else by purpose, else an empty one."""
    e = td.table(s, d, "events").select("event_id", F.col("event_type").alias("purpose"), (F.col("event_id") % 5).alias("n"))
    kinds = e.select("purpose").distinct()
    known = kinds.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.concat_ws("#", "purpose", F.col("n").cast("string")).alias("name"), F.concat("purpose", F.col("n").cast("string")).alias("answer"))
    known = known.unionByName(kinds.where(F.col("purpose").isin("click", "error")).select(F.col("purpose").alias("name"), F.col("purpose").alias("answer")))
    asked = answers.replayed(e.select("purpose", "n").distinct(), known)
    return e.join(asked, ["purpose", "n"]).select("event_id", "answer")


@query(MODEL + "SELECT d.doc_id, d.datei, count(r.row_seq) AS n_rows, min(r.kind) FILTER (r.row_seq = 1) AS first_kind FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id, d.datei")
def documents_as_json(s, d):
    """Documents with their rows as JSON texts, read again."""
    j = answers.as_json(td.documents(s, d).select("doc_id", "datei"), td.rows(s, d).select("doc_id", "row_seq", "kind"))
    x = F.from_json("json", "datei string, rows array<struct<row_seq: int, kind: string>>")
    return j.select("doc_id", x["datei"].alias("datei"), F.coalesce(F.size(F.coalesce(x["rows"], F.array().cast("array<struct<row_seq:int,kind:string>>"))), F.lit(0)).cast("long").alias("n_rows"), F.get(x["rows"], 0)["kind"].alias("first_kind"))


@query("SELECT coalesce(a.k, b.k) AS spalte_key, coalesce(b.v, a.v) AS preis FROM (SELECT p_partkey AS k, p_retailprice AS v FROM part WHERE p_partkey % 4 > 0) a FULL JOIN (SELECT p_partkey AS k, p_retailprice + 1 AS v FROM part WHERE p_partkey % 3 = 0) b ON a.k = b.k")
def edited_prices(s, d):
    """Stored prices under edited ones; edits may name new columns."""
    p = td.table(s, d, "part").select(F.col("p_partkey").alias("spalte_key"), F.col("p_retailprice").alias("preis"))
    return kept.overlay(p.where("spalte_key % 4 > 0"), p.where("spalte_key % 3 = 0").withColumn("preis", F.col("preis") + 1), "spalte_key", "preis")


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, 'ohne') AS segment, 0 AS stand FROM customer")
def migrated_customers(s, d):
    """A table without a column, and with one that has nulls, at their defaults."""
    old = td.table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    return kept.migrated(old, {"segment": F.lit("ohne"), "stand": F.lit(0)})


@query("SELECT event_id, strftime(ts, '%d.%m.%Y %H:%M') AS zeit, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS genau, event_type || ', ' || props AS liste, CASE WHEN event_id % 2 = 0 THEN props ELSE '' END AS text FROM events")
def cleaned_events(s, d):
    """Times, lists and nulls as a sheet shows them."""
    e = td.table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.array("event_type", "props").alias("liste"), F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("text"))
    c = editing.cleaned(e)
    return c.select("event_id", editing.german_time(F.col("ts")).alias("zeit"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("genau"), "liste", "text")


@query("WITH e AS (SELECT p_brand, list_sort(list(DISTINCT p_size::DOUBLE)) AS x FROM part GROUP BY p_brand) SELECT p_brand, unnest(list_transform(range(1, len(x)), lambda i: (x[i] + x[i + 1]) / 2)) AS middle FROM e")
def column_middles(s, d):
    """Centres between the edges of each brand's columns."""
    e = td.table(s, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set(F.col("p_size").cast("double"))).alias("x"))
    return e.select("p_brand", F.explode(editing.midpoints(F.col("x"))).alias("middle"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size || ' ' || upper(p_name[1]) || p_name[2:] ELSE upper(p_name[1]) || p_name[2:] END AS label, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS row_no, upper(p_name[1]) || p_name[2:] AS rest, p_partkey % 5 = 0 AS footer FROM part")
def read_labels(s, d):
    """Labels with remains of lines, a stray letter and a number before them; foot lines."""
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 99))
    k = F.col("p_partkey")
    noisy = F.concat(F.when(k % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" "))).otherwise(""), F.when(k % 2 == 0, "i").otherwise(""), F.replace(name, F.lit(" "), F.lit(" | _ ")), F.when(k % 4 == 0, " ]").otherwise(""))
    label = tx.clean_ocr_label(noisy)
    n = tx.leading_number(label)
    foot = rules.is_footer(F.when(k % 5 == 0, F.concat(F.lit("Planersteller "), "p_name")).otherwise(F.col("p_name")))
    return td.table(s, d, "part").select("p_partkey", label.alias("label"), n["number"].alias("row_no"), n["rest"].alias("rest"), foot.alias("footer"))


@query("WITH x AS (SELECT l_orderkey, ascii(l_returnflag) - 65 AS page, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity FROM lineitem), y AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY page, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS n FROM x), c AS (SELECT l_orderkey, 'K' || l_linenumber % 3 AS k, min((page, l_linenumber % 3)) AS place FROM x GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY place) - 1 AS i FROM c) SELECT y.l_orderkey AS doc_id, y.n AS row_seq, d.i AS column_index, l_quantity AS count FROM y JOIN d ON d.l_orderkey = y.l_orderkey AND d.k = 'K' || y.l_linenumber % 3")
def merged_pages(s, d):
    """Pages of a document as one table: rows numbered through, columns of equal keys put together."""
    li = td.table(s, d, "lineitem")
    page = (F.ascii("l_returnflag") - 65).alias("page_index")
    at = F.row_number().over(W.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = li.select(F.col("l_orderkey").alias("doc_id"), page, at.alias("row_seq"), (F.col("l_linenumber") % 3).alias("column_index"), F.col("l_quantity").alias("count"))
    none = F.lit("")
    columns = rows.select("doc_id", "page_index", "column_index").distinct().select("*", F.concat(F.lit("K"), F.col("column_index").cast("string")).alias("column_key"), none.alias("address"), none.alias("group_name"), none.alias("subgroup"), none.alias("label"))
    _, _, cells = merging.merged(columns, rows.select("doc_id", "page_index", "row_seq"), rows)
    return cells.select("doc_id", "row_seq", "column_index", "count")


# A picture of 70 columns for each brand, a row for each size: parts are dark dots, five columns and two rows are lines.
_PIXELS = """y AS (SELECT DISTINCT p_brand AS doc_id, y FROM part, (SELECT unnest(range(0, 50)) AS y)), dots AS (SELECT DISTINCT p_brand AS doc_id, p_size % 50 AS y, p_partkey % 70 AS x FROM part),
px AS (SELECT y.doc_id, y.y, u.x, CASE WHEN u.x IN (10, 11, 30, 50, 69) AND y.y BETWEEN 5 AND 35 + u.x % 3 AND y.y <> u.x - 30 THEN 20 WHEN y.y IN (5, 7, 40) AND u.x BETWEEN 8 AND 60 AND u.x <> 25 + y.y THEN 30 WHEN d.x IS NOT NULL THEN 10 ELSE 240 END AS p FROM y CROSS JOIN (SELECT unnest(range(0, 70)) AS x) u LEFT JOIN dots d ON d.doc_id = y.doc_id AND d.y = y.y AND d.x = u.x),
th AS (SELECT doc_id, greatest(60, floor(avg(p) * 0.6)) AS t FROM px GROUP BY doc_id), ink AS (SELECT px.doc_id, y, x FROM px JOIN th USING (doc_id) WHERE p < t)"""


def _pixels(s, d):
    p = td.table(s, d, "part")
    dots = p.groupBy(F.col("p_brand").alias("doc_id"), (F.col("p_size") % 50).alias("y")).agg(F.collect_set(F.col("p_partkey") % 70).alias("dots"))
    rows = p.select(F.col("p_brand").alias("doc_id")).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(49)))).join(dots.withColumn("y", F.col("y").cast("int")), ["doc_id", "y"], "left")
    y = F.col("y")

    def grey(x):
        upright = x.isin(10, 11, 30, 50, 69) & (y >= 5) & (y <= 35 + x % 3) & (y != x - 30)
        level = y.isin(5, 7, 40) & (x >= 8) & (x <= 60) & (x != 25 + y)
        return F.when(upright, 20).when(level, 30).when(F.array_contains("dots", x.cast("bigint")), 10).otherwise(240)

    return rows.select("doc_id", F.lit(0).alias("page_index"), "y", F.transform(F.sequence(F.lit(0), F.lit(69)), grey).alias("pixels"))


@query("WITH " + _PIXELS + ", i AS (SELECT *, x - row_number() OVER (PARTITION BY doc_id, y ORDER BY x) AS g FROM ink), r AS (SELECT doc_id, y, min(x) AS start, max(x) + 1 AS stop FROM i GROUP BY doc_id, y, g) SELECT doc_id, y, start, stop FROM r WHERE stop - start >= 12")
def level_runs(s, d):
    """Dark runs along the rows of a picture."""
    return raster.level_runs(_pixels(s, d), 12).drop("page_index")


@query("WITH " + _PIXELS + ", i AS (SELECT *, y - row_number() OVER (PARTITION BY doc_id, x ORDER BY y) AS g FROM ink), r AS (SELECT doc_id, x, min(y) AS a, max(y) + 1 AS b FROM i GROUP BY doc_id, x, g HAVING count(*) >= 20), c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY x, a) AS k FROM (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id ORDER BY x, a) > 3 THEN 1 ELSE 0 END AS n FROM r)) SELECT doc_id, avg(x) AS x, min(a) AS top, max(b) AS bottom FROM c GROUP BY doc_id, k")
def upright_lines(s, d):
    """Upright lines of a picture: islands of dark rows in each column, neighbours together."""
    return raster.separators(_pixels(s, d)).drop("page_index")


@query("WITH " + _PIXELS + ", i AS (SELECT *, y - row_number() OVER (PARTITION BY doc_id, x ORDER BY y) AS g FROM ink), r AS (SELECT doc_id, x, min(y) AS a, max(y) + 1 AS b FROM i GROUP BY doc_id, x, g HAVING count(*) >= 20) SELECT doc_id, CAST(list_sort(list(b))[len(list(b)) // 2 + 1] AS DOUBLE) AS bottom FROM r WHERE x BETWEEN 0 AND 60 AND abs(a - 4) <= 8 AND b > 12 GROUP BY doc_id")
def scanned_bottoms(s, d):
    """The lower edge of a table by its upright lines."""
    p = _pixels(s, d)
    frames = p.select("doc_id", "page_index").distinct().select("*", F.lit(4.0).alias("body_top"), F.lit(10.0).alias("left"), F.lit(50.0).alias("right"), F.lit(10.0).alias("pitch"), F.lit(3.0).alias("row_pitch"))
    return raster.table_bottom(p, frames).drop("page_index")


@query(
    "WITH "
    + _PIXELS
    + """, a AS (SELECT k * 0.25::DOUBLE - 4 AS angle, radians(k * 0.25::DOUBLE - 4) AS r FROM (SELECT unnest(range(0, 33)) AS k)),
v AS (SELECT doc_id, angle, CAST(floor((y - 24.5::DOUBLE) * cos(r) - (x - 34.5::DOUBLE) * sin(r) + 25) AS INT) AS at_, sum(255 - p) AS w FROM px CROSS JOIN a GROUP BY ALL),
n AS (SELECT doc_id, angle, sum(w) / 50.0::DOUBLE AS m, sum(w * w) / 50.0::DOUBLE AS q FROM v WHERE at_ BETWEEN 0 AND 49 GROUP BY ALL)
SELECT doc_id, arg_max(angle, (round(q - m * m, 3), -angle)) AS angle FROM n GROUP BY doc_id"""
)
def page_skew(s, d):
    """The angle of each brand's picture."""
    return raster.skew(_pixels(s, d)).drop("page_index")


# Cells between the lines of these pictures: edges at 7, 18, 29, 40 and at 11, 30, 50, 69.
_CELLS = (
    _PIXELS
    + """, cols AS (SELECT * FROM (VALUES (0, 14, 28), (1, 33, 48), (2, 53, 67)) t(c, lo, hi)),
k AS (SELECT doc_id, (y - 10) // 11 AS r, c, y, x, lo, hi, CASE WHEN p < 128 THEN 1 ELSE 0 END AS i FROM px JOIN cols ON x >= lo AND x < hi WHERE y BETWEEN 10 AND 37 AND (y - 10) % 11 < 6),
byx AS (SELECT doc_id, r, c, x, sum(i) AS v, count(*) AS h, any_value(lo) AS lo, any_value(hi) AS hi FROM k GROUP BY doc_id, r, c, x), byy AS (SELECT doc_id, r, c, y, sum(i) AS v, count(*) AS w FROM k GROUP BY doc_id, r, c, y),
f AS (SELECT doc_id, r, c, sum(v) / sum(h)::DOUBLE AS share, coalesce(max(CASE WHEN x >= lo + greatest(1, (hi - lo) // 5) AND x < hi - greatest(1, (hi - lo) // 5) THEN v END) < 0.15::DOUBLE * max(h), true) OR sum(v) / sum(h)::DOUBLE > 0.75::DOUBLE AS remnant FROM byx GROUP BY doc_id, r, c HAVING sum(v) > 0.012::DOUBLE * sum(h))"""
)


def _frames(pixels):
    ys, xs = (F.array(*[F.lit(v) for v in at]) for at in ((7, 18, 29, 40), (11, 30, 50, 69)))
    return pixels.select("doc_id", "page_index").distinct().select("*", ys.alias("ys"), xs.alias("xs"))


@query("WITH " + _CELLS + " SELECT doc_id, r AS row_no, c AS column_no, share, remnant FROM f")
def filled_cells(s, d):
    """Cells of a scanned table that hold ink, and those whose ink is the frame's."""
    p = _pixels(s, d)
    return cells.filled(p, _frames(p)).select("doc_id", F.col("row").alias("row_no"), F.col("column").alias("column_no"), "share", "remnant")


@query(
    "WITH "
    + _CELLS
    + """, m AS (SELECT k.doc_id, k.r, k.c, min(k.x) AS x0, min(k.y) AS y0, max(k.x) + 1 AS x1, max(k.y) + 1 AS y1 FROM k JOIN f ON f.doc_id = k.doc_id AND f.r = k.r AND f.c = k.c AND NOT remnant
JOIN byx ON byx.doc_id = k.doc_id AND byx.r = k.r AND byx.c = k.c AND byx.x = k.x AND byx.v <= 0.8::DOUBLE * byx.h JOIN byy ON byy.doc_id = k.doc_id AND byy.r = k.r AND byy.c = k.c AND byy.y = k.y AND byy.v <= 0.8::DOUBLE * byy.w
WHERE i = 1 GROUP BY k.doc_id, k.r, k.c) SELECT doc_id, r AS row_no, c AS column_no, x0, y0, x1, y1, (x1 - x0) / (y1 - y0)::DOUBLE < 0.45::DOUBLE AS one FROM m WHERE y1 - y0 >= 4"""
)
def cell_marks(s, d):
    """Where the ink of a cell is, without what is left of its frame."""
    p = _pixels(s, d)
    return cells.marks(p, _frames(p)).select("doc_id", F.col("row").alias("row_no"), F.col("column").alias("column_no"), "x0", "y0", "x1", "y1", "one")


@query(
    "WITH "
    + _PIXELS
    + """, st AS (SELECT i AS strip, CAST(floor(greatest(5.0::DOUBLE, 5 + i * 11.25::DOUBLE - 0.9::DOUBLE)) AS INT) AS a, CAST(floor(least(50.0::DOUBLE, 5 + (i + 1) * 11.25::DOUBLE + 0.9::DOUBLE)) AS INT) AS b FROM (SELECT unnest(range(0, 4)) AS i)),
l AS (SELECT doc_id, y, sum(p) AS grey FROM px GROUP BY doc_id, y)
SELECT doc_id, strip, y, grey FROM l CROSS JOIN st WHERE y < 5 UNION ALL SELECT doc_id, strip, y - a + 5, grey FROM l JOIN st ON y >= a AND y < b"""
)
def head_strips(s, d):
    """Pictures as four strips that overlap, each below the picture's head."""
    grey = F.aggregate("pixels", F.lit(0).cast("long"), lambda a, p: a + p)
    return cells.stripped(_pixels(s, d), 4, 0.1, 0.1).select("doc_id", "strip", "y", grey.alias("grey"))


# Texts of documents as pages of lines, one character every five points. Even documents have a defective font: digits up
# to 7 stand 29 code points too low.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_INK = _WHITE.replace("[", "[^", 1)


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS span, regexp_matches(text, '[\x01-\x09\x0b-\x1f]') OR (doc_id % 2 = 0 AND regexp_matches(text, '[0-7]')) AS bad FROM documents),
w AS (SELECT *, regexp_extract_all(line, '{_INK}+') AS w FROM l)
SELECT doc_id, span, len(w) AS n_words, array_to_string(w, ' ') AS words, CASE WHEN bad THEN 5.0 * (length(line) - length(regexp_replace(line, '^{_WHITE}+', ''))) END AS x0, CASE WHEN bad THEN 5.0 * length(regexp_replace(line, '{_WHITE}+$', '')) END AS x1, CASE WHEN bad THEN 10.0 * span + CASE WHEN regexp_matches(line, '[gjpqy]') THEN 10 ELSE 8 END END AS y1 FROM w WHERE len(w) > 0"""
)
def rebuilt_words(s, d):
    """Lines' words as read where the font is sound, out of characters where it isn't (only these have boxes)."""
    lines = td.table(s, d, "documents").select("doc_id", F.lit(0).alias("page_index"), F.posexplode(F.split("text", "\n")).alias("span", "line"))
    harmed = F.when(F.col("doc_id") % 2 == 0, F.translate("line", "01234567", "".join(chr(c - 29) for c in range(48, 56)))).otherwise(F.col("line"))
    box = lambda c, i: F.struct(c.alias("c"), (i * 5.0).alias("x0"), (F.col("span") * 10.0).alias("y0"), (i * 5.0 + 5).alias("x1"), (F.col("span") * 10.0 + F.when(c.isin(*"gjpqy"), 10).otherwise(8)).alias("y1"))
    spans = lines.where("line <> ''").select("doc_id", "page_index", "span", harmed.alias("line"))
    chars = F.transform(F.split("line", ""), box)
    none = F.lit(None).cast("double")
    plain = F.regexp_extract_all("line", F.lit("[^" + textlayer.CLASS[1:] + "+"), F.lit(0))
    read = lines.select("doc_id", "page_index", "span", F.posexplode(plain).alias("n", "text")).select("*", *[none.alias(c) for c in ("x0", "y0", "x1", "y1")])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ")
    return textlayer.words(spans, read, chars).groupBy("doc_id", "span").agg(F.count(F.lit(1)).alias("n_words"), joined.alias("words"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query(f"SELECT doc_id, bool_or(length(regexp_replace(p, '^{_WHITE}+|{_WHITE}+$', '', 'g')) >= 200) AS has_text FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS p FROM documents) GROUP BY doc_id")
def text_layers(s, d):
    """Documents with a paragraph that is long enough for a text layer."""
    pages = td.table(s, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("page_index", "text"))
    return textlayer.has_text(pages)


# Centres of columns out of line items; a profile for each region, its columns are the nations, one in three without a section.
@query(
    """WITH p AS (SELECT n_regionkey AS profile_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, n_nationkey, n_name, n_nationkey % 3 AS third FROM nation),
c AS (SELECT l_orderkey, l_quantity + 100 * l_linenumber AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity + 100 * l_linenumber) AS k FROM lineitem),
e AS (SELECT l_orderkey, max(x) + (max(x) - min(x)) / greatest(1, count(*) - 1) AS note_left FROM c GROUP BY l_orderkey)
SELECT l_orderkey AS doc_id, c.k - 1 AS column_index, x AS x_center, CASE third WHEN 0 THEN CAST(n_nationkey AS VARCHAR) WHEN 1 THEN CAST(profile_id AS VARCHAR) ELSE profile_id || '.2' END AS section, CAST(n_nationkey AS VARCHAR) AS column_no, n_name AS label, note_left
FROM c JOIN e USING (l_orderkey) JOIN p ON p.k = c.k AND p.profile_id = l_orderkey % 5"""
)
def scanned_heads(s, d):
    none, third = F.lit(""), F.col("n_nationkey") % 3
    own, key = F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")
    address = F.when(third == 0, key).when(third == 1, F.concat_ws(".", own, key)).otherwise(F.concat_ws(".", own, F.lit("2"), key))
    place = F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    profile = td.table(s, d, "nation").select(F.col("n_regionkey").cast("long").alias("profile_id"), place.alias("ordinal"), address.alias("address"), F.col("n_name").alias("label"), *[none.alias(c) for c in ("group_name", "subgroup", "abbrev")])
    at = td.table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), (F.col("l_orderkey") % 5).alias("profile_id"), (F.col("l_quantity") + 100 * F.col("l_linenumber")).alias("x"))
    return scans.header_grid(at, profile).join(scans.edges(at), ["doc_id", "page_index"]).select("doc_id", "column_index", "x_center", "section", "column_no", "label", "note_left")


@query("SELECT o_orderkey AS doc_id, o_totalprice AS preis, 'kopf' AS tabelle FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT l_orderkey, l_extendedprice, 'zeile' FROM lineitem WHERE l_orderkey % 7 <> 0")
def deleted_everywhere(s, d):
    """Every seventh order goes out of both tables of a project."""
    root = scratch(s, "projekte")
    at = projects.create(s, root, "Liste: Nord/Süd")
    projects.write(td.table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("preis")), at, "kopf", 8)
    projects.write(td.table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_extendedprice").alias("preis")), at, "zeile", 8)
    projects.delete_documents(s, at, td.table(s, d, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("doc_id")), 8)
    return projects.read(s, at, "kopf").withColumn("tabelle", F.lit("kopf")).unionByName(projects.read(s, at, "zeile").withColumn("tabelle", F.lit("zeile")))
