"""The registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import binding, facts, focus, geometry, reconcile, reports, store
from .operators import rows as rules
from .sources import files
from .sources import testdata as td

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def raw(s: SparkSession, d: str) -> DataFrame:
    return facts.raw_of_rows(td.documents(s, d), td.rows_with_cells(s, d), td.columns(s))


def values(s: SparkSession, d: str) -> DataFrame:
    """doc_id, row_seq, value: the quantity of each row."""
    return td.cells(s, d).groupBy("doc_id", "row_seq").agg(facts.exact(F.col("count")).alias("value"))


def greedy_sql(pairs: str, keys: list[str], order: str) -> str:
    """Common tables that end in t: the pairs (keys, l, r) taken one after another by the order, then l, then r."""
    k = ", ".join(keys)
    same = " AND ".join(f"g.{x} = k.{x}" for x in keys)
    return f"""k AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {order}, l, r) AS n FROM {pairs}),
g AS (SELECT DISTINCT {k}, 0::BIGINT AS n, []::BIGINT[] AS ls, []::BIGINT[] AS rs FROM k UNION ALL SELECT {", ".join(f"g.{x}" for x in keys)}, k.n,
CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN ls ELSE list_append(ls, l) END, CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN rs ELSE list_append(rs, r) END FROM g JOIN k ON {same} AND k.n = g.n + 1),
z AS (SELECT {k}, arg_max(ls, n) AS ls, arg_max(rs, n) AS rs FROM g GROUP BY {k}), t AS (SELECT {k}, unnest(ls) AS l, unnest(rs) AS r FROM z)"""


# The same model in SQL. DuckDB sums decimals exactly, too.
MODEL = """WITH num AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_seq FROM lineitem),
r0 AS (SELECT l_orderkey AS doc_id, row_seq, ascii(l_returnflag) - 65 AS page_index, CASE l_linenumber WHEN 7 THEN 'summe' WHEN 6 THEN 'uebertrag' ELSE 'daten' END AS kind,
  CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE (CASE WHEN l_suppkey % 2 = 0 THEN 'ASP' ELSE 'ISP' END) || lpad(CAST(l_suppkey % 7 AS VARCHAR), 2, '0') END AS focus, 'Teil ' || l_partkey AS datenpunkt,
  CAST(row_seq AS VARCHAR) AS row_no, 'B' || (l_partkey % 10) AS bas, l_linestatus AS qualifier, CASE WHEN l_linenumber = 3 THEN 'geprüft' ELSE '' END AS remark, '0,' || row_seq || ',9,9' AS bbox FROM num),
r AS (SELECT *, CASE WHEN focus = '' THEN '' ELSE 'Anlage ' || focus[4:5] END AS focus_label, CASE WHEN kind = 'daten' THEN '' ELSE 'Zeile der Art ' || kind END AS reason FROM r0),
c AS (SELECT l_orderkey AS doc_id, row_seq, u.i AS column_index, u.v AS cnt, u.k AS spalte_key, u.a AS adresse, u.g AS gruppe, u.s AS untergruppe, u.l AS label, 'w' || u.i AS raw_value, CASE WHEN l_linenumber = 4 AND u.i = 2 THEN 'siehe Blatt' ELSE '' END AS note FROM num,
  LATERAL (VALUES (0, l_quantity, 'A_1_1', '1.1', 'Mengen', 'Stück', 'Menge'), (1, l_extendedprice, 'A_1_2', '1.2', 'Geld', 'netto', 'Preis'), (2, l_discount, 'A_2_1', '2.1', 'Sätze', 'Abzug', 'Rabatt'), (3, l_tax, 'A_2_2', '2.2', 'Sätze', 'Zuschlag', 'Steuer')) u(i, v, k, a, g, s, l)),
d AS (SELECT o_orderkey AS doc_id, 'Liste ' || o_orderkey AS datei, coalesce(nullif(c_mktsegment, ''), c_name) AS projekt, c_name AS auftraggeber, n_name AS anlage, o_orderpriority AS gewerk, o_orderstatus AS fassung, o_orderstatus AS profil,
  'Plan ' || (o_custkey % 7) AS planersteller, CAST(o_orderkey % 10 AS VARCHAR) AS blatt_nr, o_orderdate AS importiert_am, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT r.doc_id, d.datei, d.fassung, d.profil, d.projekt, d.auftraggeber, d.anlage, coalesce(nullif(r.focus, ''), 'ohne Zuordnung') AS schwerpunkt, r.focus_label AS schwerpunkt_bezeichnung, d.gewerk, d.planersteller, d.blatt_nr, r.page_index + 1 AS seite, r.row_seq, r.row_no, r.datenpunkt, r.bas, r.qualifier, r.remark,
  c.adresse, c.spalte_key, c.gruppe, c.untergruppe, c.label, coalesce(c.cnt, 0) AS wert, c.raw_value, c.note, d.importiert_am FROM c JOIN r USING (doc_id, row_seq) JOIN d USING (doc_id) WHERE r.kind = 'daten'),
v AS (SELECT doc_id, row_seq, CAST(sum(CAST(cnt AS DECIMAL(28,6))) AS DOUBLE) AS value FROM c GROUP BY ALL),
pg AS (SELECT doc_id, page_index, coalesce(min(nullif(focus, '')), '') AS focus, CASE WHEN (doc_id + page_index) % 11 = 0 THEN 'regelschema' WHEN (doc_id + page_index) % 13 = 0 THEN 'sonstiges' ELSE 'funktionsliste' END AS kind, CASE WHEN doc_id % 2 = 0 THEN 0.85 ELSE 0.5 END AS confidence FROM r GROUP BY doc_id, page_index)
"""
TOTAL = "CAST(sum(CAST({} AS DECIMAL(28,6))) AS DOUBLE)"
MENGE = TOTAL.format("wert")


@query(MODEL + "SELECT * EXCLUDE (importiert_am) FROM f")
def raw_cells(s, d):
    return raw(s, d).drop("importiert_am")


SUMMARY = f"SELECT profil, adresse, spalte_key, gruppe, untergruppe, label, {MENGE} AS menge, count(DISTINCT doc_id) AS dokumente, count(datenpunkt) AS n_cells FROM f GROUP BY ALL"


@query(MODEL + SUMMARY + " ORDER BY profil, adresse")
def column_summary(s, d):
    return facts.column_summary(raw(s, d)).orderBy("profil", "adresse")


PRICES = """p AS (SELECT u.k AS spalte_key, u.x AS preis FROM (SELECT max(p_retailprice) a, min(p_retailprice) b, round(CAST(avg(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE), 2) c FROM part), LATERAL (VALUES ('A_1_1', a), ('A_1_2', b), ('A_2_1', c)) u(k, x))"""


@query(MODEL + f", {PRICES}, m AS ({SUMMARY}) SELECT m.*, coalesce(preis, 0) AS preis, round(menge * coalesce(preis, 0), 2) AS kosten FROM m LEFT JOIN p USING (spalte_key)")
def column_summary_cost(s, d):
    return facts.with_cost(facts.column_summary(raw(s, d)), td.prices(s, d))


@query(MODEL + f", {PRICES}, q AS (SELECT spalte_key, adresse, gruppe, {MENGE} AS menge FROM f GROUP BY ALL) SELECT spalte_key, adresse, gruppe, coalesce(preis, 0) AS preis, menge FROM q LEFT JOIN p USING (spalte_key)")
def price_template(s, d):
    summary = raw(s, d).groupBy("spalte_key").agg(facts.exact(F.col("wert")).alias("menge"))
    return facts.price_template(td.columns(s), td.prices(s, d), summary)


@query(MODEL + f"SELECT fassung, gruppe, {MENGE} AS menge FROM f GROUP BY ALL")
def group_summary(s, d):
    return facts.group_summary(raw(s, d))


@query(MODEL + f"SELECT anlage, {MENGE} AS menge, count(DISTINCT (doc_id, row_seq)) AS n_rows, count(DISTINCT doc_id) AS dokumente FROM f GROUP BY ALL ORDER BY menge DESC, anlage")
def by_dimension(s, d):
    return facts.by_dimension(raw(s, d), "anlage")


@query(MODEL + f"SELECT schwerpunkt, schwerpunkt_bezeichnung AS bezeichnung, count(DISTINCT (doc_id, row_seq)) AS n_rows, {MENGE} AS menge, count(DISTINCT doc_id) AS dokumente, string_agg(DISTINCT datei, ', ' ORDER BY datei) AS dateien, CASE WHEN schwerpunkt[1:3] IN ('ASP', 'ISP') THEN schwerpunkt[1:3] ELSE '' END AS art FROM f GROUP BY schwerpunkt, schwerpunkt_bezeichnung")
def focus_summary(s, d):
    return reports.ordered_foci(facts.focus_summary(raw(s, d)))


def _each(values_: list[str], col: str) -> str:
    return ", ".join(f"coalesce({TOTAL.format(f'CASE WHEN {col} = {chr(39)}{v}{chr(39)} THEN wert END')}, 0) AS \"{v}\"" for v in values_)


@query(MODEL + f"SELECT CASE WHEN GROUPING(projekt) = 1 THEN 'Gesamt' ELSE projekt END AS projekt, CASE WHEN GROUPING(anlage) = 1 THEN 'Gesamt' ELSE anlage END AS anlage, {_each(['Geld', 'Mengen', 'Sätze'], 'gruppe')}, {MENGE} AS \"Gesamt\" FROM f GROUP BY GROUPING SETS ((projekt, anlage), ())")
def pivot_margins(s, d):
    return facts.pivot_margins(raw(s, d), ["projekt", "anlage"], "gruppe", ["Geld", "Mengen", "Sätze"])


@query(MODEL + f", m AS (SELECT doc_id, {_each(td.KEYS, 'spalte_key')}, count(DISTINCT row_seq) AS n_rows FROM f GROUP BY doc_id) SELECT d.doc_id, {', '.join(f'coalesce({k}, 0) AS {chr(34)}{k}{chr(34)}' for k in td.KEYS)}, coalesce(n_rows, 0) AS n_rows FROM d LEFT JOIN m USING (doc_id)")
def document_matrix(s, d):
    return facts.matrix(raw(s, d), ["doc_id"], td.KEYS, td.documents(s, d).select("doc_id"))


@query(MODEL + f"SELECT doc_id, schwerpunkt, {_each(td.KEYS, 'spalte_key')}, count(DISTINCT row_seq) AS n_rows FROM f GROUP BY doc_id, schwerpunkt")
def focus_matrix(s, d):
    return facts.matrix(raw(s, d), ["doc_id", "schwerpunkt"], td.KEYS)


@query(MODEL + "SELECT r.doc_id, r.row_seq, r.page_index, r.kind, r.focus, r.datenpunkt, r.row_no, " + ", ".join(f"max(CASE WHEN spalte_key = '{k}' THEN cnt END) AS \"{k}\"" for k in td.KEYS) + " FROM r JOIN c USING (doc_id, row_seq) WHERE r.kind = 'daten' GROUP BY ALL")
def layout_wide(s, d):
    rows = td.rows(s, d).select("doc_id", "row_seq", "page_index", "kind", "focus", "datenpunkt", "row_no")
    return facts.layout(rows, td.cells(s, d), td.columns(s), td.KEYS)


@query(MODEL + f"""SELECT d.doc_id, o.c_mktsegment AS projekt, d.anlage, coalesce(seiten, 0) AS seiten, coalesce(n_countable, 0) AS n_countable, coalesce(menge, 0) AS menge, coalesce(ausgeschlossen, '') AS ausgeschlossen, coalesce(schwerpunkte, '') AS schwerpunkte
FROM d JOIN (SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey) o ON o.o_orderkey = d.doc_id
LEFT JOIN (SELECT doc_id, count(DISTINCT page_index) AS seiten, count(*) FILTER (kind = 'daten' AND value IS NOT NULL) AS n_countable, coalesce({TOTAL.format("CASE WHEN kind = 'daten' THEN value END")}, 0) AS menge FROM r LEFT JOIN v USING (doc_id, row_seq) GROUP BY doc_id) a USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(kind || ': ' || n, ', ' ORDER BY kind || ': ' || n) AS ausgeschlossen FROM (SELECT doc_id, kind, count(*) AS n FROM r WHERE kind <> 'daten' GROUP BY ALL) GROUP BY doc_id) b USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(focus, ', ' ORDER BY s) AS schwerpunkte FROM (SELECT doc_id, focus, min(row_seq) AS s FROM r WHERE focus <> '' AND kind = 'daten' GROUP BY ALL) GROUP BY doc_id) e USING (doc_id)""")
def document_overview(s, d):
    return facts.overview(td.documents(s, d), td.rows(s, d), values(s, d))


@query(MODEL + f"SELECT doc_id, focus, n_rows, menge, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN focus = 'ohne Zuordnung' THEN 1 ELSE 0 END, s) AS place FROM (SELECT doc_id, coalesce(nullif(focus, ''), 'ohne Zuordnung') AS focus, count(*) AS n_rows, {TOTAL.format('value')} AS menge, min(row_seq) AS s FROM r JOIN v USING (doc_id, row_seq) WHERE kind = 'daten' GROUP BY ALL)")
def focus_split(s, d):
    return facts.focus_split(td.rows(s, d), values(s, d))


@query(MODEL + f"SELECT count(DISTINCT doc_id) AS dokumente, count(DISTINCT (doc_id, row_seq)) AS n_rows, {MENGE} AS menge, count(DISTINCT CASE WHEN schwerpunkt <> 'ohne Zuordnung' THEN schwerpunkt END) AS schwerpunkte, count(DISTINCT spalte_key) AS spalten FROM f")
def kpi_row(s, d):
    return facts.kpis(raw(s, d))


SUMS = f"""s AS (SELECT r.doc_id, {{page}} AS page_index, column_index, {TOTAL.format("CASE WHEN kind = 'daten' THEN cnt END")} AS own, {TOTAL.format("CASE WHEN kind = 'uebertrag' THEN cnt END")} AS carry, {TOTAL.format("CASE WHEN kind = 'summe' THEN cnt END")} AS reported
FROM c JOIN r USING (doc_id, row_seq) WHERE cnt IS NOT NULL GROUP BY ALL)"""
PAGE = MODEL + ", " + SUMS.format(page="page_index") + ", g AS (SELECT *, bool_or(own IS NOT NULL) OVER w AS has_own, bool_or(reported IS NOT NULL) OVER w AS has_reported FROM s WINDOW w AS (PARTITION BY doc_id, page_index)), bad AS (SELECT doc_id, page_index, column_index, 'abweichung' AS art, reported, coalesce(own, 0) AS own FROM g WHERE has_own AND reported IS NOT NULL AND abs(reported - coalesce(own, 0)) >= 1e-6) "


@query(PAGE + "SELECT doc_id, page_index, column_index, reported, round(coalesce(own, 0) + coalesce(carry, 0), 2) AS computed, reported IS NULL OR abs(reported - round(coalesce(own, 0) + coalesce(carry, 0), 2)) < 1e-6 AS matches FROM g WHERE has_own AND has_reported")
def sum_check_page(s, d):
    return reconcile.page_checks(td.rows_with_cells(s, d))


@query(PAGE + "SELECT * FROM bad")
def sum_check_findings(s, d):
    return reconcile.page_findings(td.rows_with_cells(s, d))


@query(PAGE + "SELECT doc_id, page_index, row_seq, kind, 'ausgeschlossen' AS art, value FROM r JOIN v USING (doc_id, row_seq) WHERE kind NOT IN ('daten', 'leer') AND NOT (kind = 'summe' AND (doc_id, page_index) IN (SELECT (doc_id, page_index) FROM g WHERE has_own AND has_reported) AND (doc_id, page_index) NOT IN (SELECT (doc_id, page_index) FROM bad))")
def excluded_rows(s, d):
    return reconcile.excluded_findings(td.rows_with_cells(s, d))


@query(MODEL + ", " + SUMS.format(page="0") + " SELECT doc_id, column_index, coalesce(own, 0) AS own, reported, CASE WHEN reported IS NULL THEN 'nicht in der Liste ausgewiesen' WHEN abs(reported - coalesce(own, 0)) < 1e-6 THEN 'stimmt überein' ELSE 'ABWEICHUNG' END AS verdict FROM s WHERE own IS NOT NULL OR reported IS NOT NULL")
def audit_report(s, d):
    return reconcile.audit(td.rows(s, d), td.cells(s, d))


@query("""SELECT doc_id, regexp_replace(regexp_replace(lower(strip_accents(replace(replace(replace(replace(replace(replace(replace(text, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), 'Ä', 'ae'), 'Ö', 'oe'), 'Ü', 'ue'))), '[^a-z0-9]+', ' ', 'g'), '^ | $', '', 'g') AS norm FROM documents""")
def normalize_text(s, d):
    return td.table(s, d, "documents").select("doc_id", tx.normalize(F.col("text")).alias("norm"))


# A line of a document, a name and what stands before and after it.
LABELS = """lab AS (SELECT p_partkey AS n, CASE p_partkey % 12 WHEN 0 THEN 'Summe ' WHEN 1 THEN 'Übertrag von ' WHEN 2 THEN 'Zwischensumme ' WHEN 3 THEN 'Planersteller ' WHEN 4 THEN '12345 ' WHEN 5 THEN 'Stand: Übertrag ' ELSE '' END || CASE WHEN p_partkey % 12 = 6 THEN 'Benennung' WHEN p_partkey % 12 = 7 THEN '--' ELSE p_name END AS label, p_size % 3 > 0 AS has_values, p_size FROM part)"""


def _labels(s, d):
    k = F.col("p_partkey") % 12
    before = F.when(k == 0, "Summe ").when(k == 1, "Übertrag von ").when(k == 2, "Zwischensumme ").when(k == 3, "Planersteller ").when(k == 4, "12345 ").when(k == 5, "Stand: Übertrag ").otherwise("")
    name = F.when(k == 6, "Benennung").when(k == 7, "--").otherwise(F.col("p_name"))
    return td.table(s, d, "part").select(F.col("p_partkey").alias("n"), F.concat(before, name).alias("label"), (F.col("p_size") % 3 > 0).alias("has_values"), "p_size")


@query(f"WITH {LABELS} SELECT n, kind, CASE kind WHEN 'summe' THEN 'Summenzeile - Werte sind bereits in den Einzelzeilen enthalten' WHEN 'uebertrag' THEN 'Uebertragszeile - Werte stammen von einem anderen Blatt' WHEN 'fussbereich' THEN 'Zeile des Kopf-/Fussbereichs, kein Datenpunkt' WHEN 'kopf' THEN 'Wiederholte Kopfzeile' WHEN 'leer' THEN 'Leere Zeile' ELSE '' END AS reason, kind = 'fussbereich' AS footer FROM (SELECT n, CASE n % 12 WHEN 0 THEN 'summe' WHEN 1 THEN 'uebertrag' WHEN 2 THEN 'summe' WHEN 3 THEN 'fussbereich' WHEN 4 THEN 'fussbereich' WHEN 5 THEN 'uebertrag' WHEN 6 THEN 'kopf' WHEN 7 THEN CASE WHEN has_values THEN 'daten' ELSE 'leer' END ELSE 'daten' END AS kind FROM lab)")
def row_kind_labels(s, d):
    kind = rules.row_kind(F.col("label"), F.col("has_values"))
    return _labels(s, d).select("n", kind.alias("kind"), rules.reason(kind).alias("reason"), F.when(F.col("n") % 12 == 7, False).otherwise(rules.is_footer(F.col("label"))).alias("footer"))


@query("""SELECT doc_id, CASE WHEN length(trim(text, ' ')) < 30 THEN 'unbekannt' WHEN regexp_matches(x, 'regelschema|prinzipschaltbild|anlagenschema|strangschema|funktionsschema|schaltplan|r i|rls schema') THEN 'regelschema' WHEN regexp_matches(x, 'summe funktionen|funktionsliste|datenpunktliste|verarbeitungsfunktionen|anwendungsfunktionen') THEN 'funktionsliste' ELSE 'sonstiges' END AS kind
FROM (SELECT doc_id, text, regexp_replace(lower(strip_accents(replace(replace(replace(replace(replace(replace(replace(text, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), 'Ä', 'ae'), 'Ö', 'oe'), 'Ü', 'ue'))), '[^a-z0-9]+', ' ', 'g') AS x FROM documents)""")
def page_classification(s, d):
    return td.table(s, d, "documents").select("doc_id", rules.page_kind(F.col("text"), F.lit(0), F.lit(0))["kind"].alias("kind"))


CELL = "CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN ' ' || p_size || ',5 ' WHEN 2 THEN 'x' WHEN 3 THEN '' WHEN 4 THEN 'Variante ' || p_size ELSE '-' || p_size END"


@query(f"SELECT p_partkey, {CELL} AS cell, CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size + 0.5 WHEN 2 THEN 1.0 END::DOUBLE AS value, p_partkey % 6 IN (4, 5) AS freetext FROM part")
def parse_count(s, d):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    cell = F.when(k == 0, n).when(k == 1, F.concat(F.lit(" "), n, F.lit(",5 "))).when(k == 2, "x").when(k == 3, "").when(k == 4, F.concat(F.lit("Variante "), n)).otherwise(F.concat(F.lit("-"), n))
    df = td.table(s, d, "part").select("p_partkey", cell.alias("cell"))
    return df.withColumn("value", tx.parse_count(F.col("cell"))).withColumn("freetext", tx.is_freetext(F.col("cell")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN '' ELSE CAST(p_size AS VARCHAR) || '.' || (p_partkey % 9) END AS address, CASE WHEN p_partkey % 5 = 4 THEN '' ELSE CAST(p_size AS VARCHAR) || '.' || (p_partkey % 9) || '.' END || '3' AS joined, CASE WHEN p_partkey % 5 = 4 THEN '' ELSE CAST(p_size AS VARCHAR) END AS section FROM part")
def address_normalize(s, d):
    raw_ = F.when(F.col("p_partkey") % 5 == 4, F.concat(F.lit("abc."), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit(" 0"), F.col("p_size").cast("string"), F.lit(","), (F.col("p_partkey") % 9).cast("string"), F.lit(". ")))
    p = td.table(s, d, "part").select("p_partkey", raw_.alias("a"))
    return p.select("p_partkey", tx.normalize_address(F.col("a")).alias("address"), tx.join_address(F.col("a"), F.lit("03")).alias("joined"), tx.section_of(tx.normalize_address(F.col("a"))).alias("section"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '8,' || p_size WHEN 2 THEN '2' ELSE '' END AS markers FROM part WHERE p_size <> 8")
def footnote_markers(s, d):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    tail = F.when(k == 0, F.concat(F.lit(" "), n, F.lit(")"))).when(k == 1, F.concat(F.lit(" 8) "), n, F.lit(" )"))).when(k == 2, " ²").otherwise(" 2,5)")
    p = td.table(s, d, "part").where("p_size <> 8").select("p_partkey", F.concat("p_name", tail).alias("label"))
    return p.select("p_partkey", F.array_join(tx.footnote_markers(F.col("label")), ",").alias("markers"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 6 < 4 THEN (CASE WHEN c_custkey % 6 IN (1, 3) THEN 'ISP' ELSE 'ASP' END) || lpad(CAST(c_custkey % 40 AS VARCHAR), 2, '0') END AS code, CASE WHEN c_custkey % 6 IN (0, 2, 3) THEN c_mktsegment WHEN c_custkey % 6 = 1 THEN '' END AS name FROM customer")
def focus_parse(s, d):
    n, k, seg = (F.col("c_custkey") % 40).cast("string"), F.col("c_custkey") % 6, F.col("c_mktsegment")
    label = F.when(k == 0, F.concat(F.lit("ASP"), n, F.lit(" "), seg)).when(k == 1, F.concat(F.lit("Informationsschwerpunkt: ISP"), n)).when(k == 2, F.concat(F.lit("Anlage: "), seg, F.lit(" ASP"), n)).when(k == 3, F.concat(F.lit("isp Nr. "), n, F.lit(" - "), seg)).when(k == 4, F.concat(F.lit("Rasp"), n, F.lit(" "), seg)).otherwise(seg)
    p = tx.parse_focus(label)
    return td.table(s, d, "customer").select("c_custkey", p["code"].alias("code"), p["label"].alias("name"))


@query(
    """WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'system' OR turn % 3 = 0 THEN 'F' || (turn % 7) END AS own, turn % 5 = 4 AS reset FROM conversations),
e AS (SELECT *, CASE WHEN reset THEN '-' ELSE own END AS ev FROM t)
SELECT conv_id, turn, coalesce(nullif(last_value(ev IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '-'), '') AS focus FROM e"""
)
def focus_carry_forward(s, d):
    """Turns name a focus, every fifth one resets it; nothing is a default here, as no page has one code only."""
    c = td.table(s, d, "conversations")
    own = F.when((F.col("role") == "system") | (F.col("turn") % 3 == 0), F.concat(F.lit("F"), (F.col("turn") % 7).cast("string")))
    event = F.when(F.col("turn") % 5 == 4, "-").otherwise(own)
    held = geometry.forward_fill(c, ["conv_id"], ["turn"], event, "held")
    return held.select("conv_id", "turn", F.coalesce(F.nullif("held", F.lit("-")), F.lit("")).alias("focus"))


@query(MODEL + ", k AS (SELECT doc_id, row_seq, CASE WHEN kind = 'summe' THEN 'fussbereich' WHEN kind = 'uebertrag' THEN 'leer' ELSE 'daten' END AS kind FROM r), a AS (SELECT *, max(CASE WHEN kind = 'fussbereich' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY row_seq ROWS UNBOUNDED PRECEDING) AS stop FROM k), b AS (SELECT *, max(CASE WHEN kind <> 'leer' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY row_seq DESC ROWS UNBOUNDED PRECEDING) AS full_ FROM a WHERE stop = 0) SELECT doc_id, row_seq, kind FROM b WHERE full_ = 1")
def footer_cut(s, d):
    kind = F.when(F.col("kind") == "summe", "fussbereich").when(F.col("kind") == "uebertrag", "leer").otherwise("daten")
    return rules.cut_after_footer(td.rows(s, d).select("doc_id", "row_seq", kind.alias("kind")), ["doc_id"], "row_seq")


@query("SELECT user_id, event_id, sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 3600 THEN 1 ELSE 0 END AS n FROM (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events))")
def gap_clusters(s, d):
    e = td.table(s, d, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    return geometry.gap_clusters(e, ["user_id"], "t", 3600, "event_id").select("user_id", "event_id", F.col("cluster").cast("long").alias("cluster"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_error FROM events")
def forward_fill(s, d):
    e = td.table(s, d, "events")
    return geometry.forward_fill(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "error", F.col("event_id")), "last_error").select("event_id", "last_error")


@query("WITH n AS (SELECT l_suppkey AS k, l_linenumber AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS i FROM lineitem), b AS (SELECT k, i, sum(CASE WHEN n = 1 OR i = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS b FROM n) SELECT k AS l_suppkey, string_agg(CAST(n AS VARCHAR), '-' ORDER BY b) AS sizes FROM (SELECT k, b, count(*) AS n FROM b GROUP BY ALL) GROUP BY k")
def block_fingerprint(s, d):
    li = td.table(s, d, "lineitem")
    return geometry.block_sizes(geometry.blocks(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "l_linenumber"), ["l_suppkey"])


EVENTS = "WITH a AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type <> 'error'), b AS (SELECT user_id, event_id AS error_id, epoch_us(ts) AS u FROM events WHERE event_type = 'error') "


def _sides(s, d):
    e = td.table(s, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    error = F.col("event_type") == "error"
    return e.where(~error).select("user_id", "event_id", "t"), e.where(error).select("user_id", F.col("event_id").alias("error_id"), F.col("t").alias("u"))


@query(EVENTS + "SELECT event_id, arg_min(error_id, (abs(t - u), u)) AS error_id FROM a LEFT JOIN b USING (user_id) GROUP BY event_id")
def nearest_section(s, d):
    a, b = _sides(s, d)
    return geometry.nearest(a, b, ["user_id"], "t", "u", "error_id").select("event_id", "error_id")


@query(EVENTS + "SELECT event_id, error_id FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.t >= b.u")
def asof_section(s, d):
    a, b = _sides(s, d)
    return geometry.asof(a, b, ["user_id"], "t", "u", "error_id").select("event_id", "error_id")


@query(EVENTS + "SELECT event_id, error_id FROM a JOIN b USING (user_id) WHERE abs(t - u) <= 3600000000")
def band_join(s, d):
    a, b = _sides(s, d)
    return geometry.band_join(a, b, ["user_id"], "t", "u", 3_600_000_000).select("event_id", "error_id")


BOXES = "WITH p AS (SELECT p_partkey AS id, p_brand AS page, p_size * 10.0 AS x0, p_size * 10.0 + p_retailprice % 17 + 1 AS x1, (p_partkey % 40) * 5.0 AS y0, (p_partkey % 40) * 5.0 + 6 AS y1 FROM part) "


@query(BOXES + "SELECT id FROM p a WHERE id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.id % 2 = 1 AND a.page = b.page AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= 0.5 * least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)))")
def overlap_anti(s, d):
    k = F.col("p_partkey")
    p = td.table(s, d, "part").select(k.alias("id"), F.col("p_brand").alias("page"), (F.col("p_size") * 10.0).alias("x0"), (F.col("p_size") * 10.0 + F.col("p_retailprice") % 17 + 1).alias("x1"), ((k % 40) * 5.0).alias("y0"), ((k % 40) * 5.0 + 6).alias("y1"))
    return geometry.without_overlaps(p.where("id % 2 = 0"), p.where("id % 2 = 1"), ["page"]).select("id")


@query("SELECT l_suppkey, arg_max(q, (n, q)) AS mode, any_value(m) AS upper_median FROM (SELECT l_suppkey, l_quantity AS q, count(*) AS n FROM lineitem GROUP BY ALL) JOIN (SELECT l_suppkey, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS m FROM lineitem GROUP BY ALL) USING (l_suppkey) GROUP BY l_suppkey")
def mode_upper_median(s, d):
    li = td.table(s, d, "lineitem")
    median = li.groupBy("l_suppkey").agg(geometry.upper_median(F.collect_list("l_quantity")).alias("upper_median"))
    return geometry.mode_largest(li, ["l_suppkey"], "l_quantity").join(median, "l_suppkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1")
def dedup_richest(s, d):
    li = td.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", "l_extendedprice")
    return store.richest(li, ["l_orderkey", "l_linenumber"], "l_quantity", ["l_partkey", "l_suppkey", "l_extendedprice"])


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) FILTER (event_type <> 'click') AS event_type, arg_min(props, (ts, event_id)) FILTER (props <> '') AS props FROM events GROUP BY user_id")
def first_nonempty_merge(s, d):
    e = td.table(s, d, "events").withColumn("event_type", F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")))
    return store.first_present(e, ["user_id"], ["ts", "event_id"], ["event_type", "props"])


@query(MODEL + "SELECT doc_id, row_seq, kind FROM r WHERE (doc_id, row_seq) NOT IN (SELECT (doc_id, row_seq) FROM (SELECT doc_id, row_seq, row_number() OVER (PARTITION BY doc_id ORDER BY row_seq) - 1 AS n FROM r WHERE kind = 'daten') WHERE n IN (0, 2, 999))")
def delete_by_position(s, d):
    return rules.remove_positions(td.rows(s, d).select("doc_id", "row_seq", "kind"), [0, 2, 999, -1], ["doc_id"], "row_seq")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 3 = 0")
def upsert_by_hash(s, d):
    o = td.table(s, d, "orders").select("o_orderkey", "o_totalprice")
    new = o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return store.upsert(o, new, "o_orderkey")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_answers(s, d):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return td.table(s, d, "events").select("event_id", files.tolerant_json(fenced, "k bigint")["k"].alias("k"))


@query("SELECT p_partkey, CASE WHEN p_name = 'small ring' THEN 1.0 WHEN p_name LIKE '%ring%' THEN 0.85 + 0.1 * (4.0 / length(p_name)) ELSE -1.0 END AS score FROM part")
def similarity_tiers(s, d):
    """Every part name against Ring; what no tier tells (the likeness of letters) is -1 here."""
    other = F.when(F.col("p_name") == "small ring", "Small  Ring").otherwise("Ring")
    return td.table(s, d, "part").select("p_partkey", F.coalesce(binding.tiered(F.col("p_name"), other), F.lit(-1.0)).alias("score"))


@query()
def similarity_match(s, d):
    """Part names bound to type names one to one, within each brand."""
    p = td.table(s, d, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("p_partkey"))
    words = s.createDataFrame([("Small Ring",), ("Large Bolt",), ("Ring",), ("Bolts",)], "alias string")
    pairs = p.crossJoin(F.broadcast(words)).withColumn("score", binding.similarity(F.col("p_name"), F.col("alias")))  # four fixed words
    return binding.greedy(pairs, ["p_brand"], "p_name", "alias", "score", 0.5)


@query("""WITH RECURSIVE e0 AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS row_seq, event_type, round_even(value, 0) AS v FROM events),
e AS (SELECT user_id, row_seq // 40 AS page_index, row_seq, v, row_seq % 9 = 0 AS bare, row_number() OVER p AS k, max(row_seq) OVER (PARTITION BY user_id, row_seq // 40) AS last_ FROM e0 WINDOW p AS (PARTITION BY user_id, row_seq // 40 ORDER BY row_seq)),
x AS (SELECT user_id, page_index, 0::BIGINT AS k, 0::DOUBLE AS s0, 0::DOUBLE AS s1, 0 AS n, NULL::BIGINT AS row_seq, false AS fits, false AS total FROM e WHERE k = 1
UNION ALL SELECT user_id, page_index, k, CASE WHEN total THEN 0 ELSE s0 + coalesce(v, 0) END, CASE WHEN total THEN 0 ELSE s1 + 1 END, CASE WHEN total THEN 0 ELSE n + 1 END, row_seq, fits, total
FROM (SELECT *, bare AND n >= 1 AND (fits OR (row_seq = last_ AND n >= 2)) AS total FROM (SELECT e.*, s0, s1, n, v IS NOT NULL AND s0 <> 0 AND s1 <> 0 AND abs(v - s0) < 1e-6 AND abs(1 - s1) < 1e-6 AS fits FROM x JOIN e ON e.user_id = x.user_id AND e.page_index = x.page_index AND e.k = x.k + 1)))
SELECT user_id, page_index, row_seq, CASE WHEN total THEN 'summe' ELSE 'daten' END AS kind, CASE WHEN NOT total THEN '' WHEN fits THEN '""" + rules.FITS + """' ELSE '""" + rules.LAST + """' END AS reason FROM x WHERE k > 0""")
def unlabelled_sum_rows(s, d):
    """Rows without a label on pages of 40 events a user; every row has values in one column or two."""
    e = td.table(s, d, "events").withColumn("row_seq", F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))).withColumn("page_index", F.floor(F.col("row_seq") / 40))
    v = F.map_from_arrays(F.array(F.lit(0), F.lit(1)), F.array(F.rint("value"), F.lit(1.0)))
    rows = e.select("user_id", "page_index", F.col("row_seq").cast("int").alias("row_seq"), F.lit("daten").alias("kind"), F.when(F.col("row_seq") % 9 == 0, "").otherwise(F.col("event_type")).alias("label"), v.alias("values"))
    return rules.mark_unlabelled_sums(rows, ["user_id", "page_index"]).select("user_id", "page_index", "row_seq", "kind", "reason")


def focus_sql(rows: str) -> str:
    """Foci of rows (doc_id, page_index, row_seq, kind, label, code, own, has_values): a row's focus is looked up by the
    number of the last row before it that names one or ends one."""
    return f"""r AS ({rows}), n AS (SELECT *, lead(label) OVER o AS l1, lead(code) OVER o IS NULL AND NOT lead(has_values) OVER o AS o1, lead(label, 2) OVER o AS l2, lead(code, 2) OVER o IS NULL AND NOT lead(has_values, 2) OVER o AS o2 FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY page_index, row_seq)),
w AS (SELECT doc_id, page_index, row_seq, kind, code, CASE WHEN own <> '' THEN own WHEN o1 AND trim(l1) <> '' THEN trim(l1) WHEN o1 AND o2 THEN trim(l2) ELSE '' END AS name FROM n),
one AS (SELECT doc_id, page_index, min(code) AS code, arg_min(name, row_seq) AS name FROM w WHERE code IS NOT NULL GROUP BY ALL HAVING count(DISTINCT code) = 1),
last_ AS (SELECT w.doc_id, w.page_index, w.row_seq, max(v.row_seq) AS since FROM w LEFT JOIN w v ON v.doc_id = w.doc_id AND v.page_index = w.page_index AND v.row_seq <= w.row_seq AND (v.code IS NOT NULL OR v.kind IN ('summe', 'uebertrag')) GROUP BY ALL),
h AS (SELECT last_.doc_id, last_.page_index, last_.row_seq, CASE WHEN e.code IS NOT NULL AND e.kind = 'daten' THEN e.code ELSE one.code END AS code, CASE WHEN e.code IS NOT NULL AND e.kind = 'daten' THEN e.name ELSE one.name END AS name
  FROM last_ LEFT JOIN w e ON e.doc_id = last_.doc_id AND e.page_index = last_.page_index AND e.row_seq = last_.since LEFT JOIN one ON one.doc_id = last_.doc_id AND one.page_index = last_.page_index),
fill AS (SELECT doc_id, code, arg_min(name, (page_index, row_seq)) AS name FROM h WHERE name <> '' GROUP BY ALL)"""


@query("WITH " + focus_sql("SELECT conv_id AS doc_id, turn // 10 AS page_index, turn AS row_seq, 'daten' AS kind, CASE WHEN turn % 4 = 1 THEN 'ASP0' || (conv_id % 5) ELSE text END AS label, CASE WHEN turn % 4 = 1 THEN 'ASP0' || (conv_id % 5) END AS code, CASE WHEN turn % 4 = 1 THEN '' END AS own, turn % 4 = 3 AS has_values FROM conversations") + " SELECT doc_id, row_seq, coalesce(h.code, '') AS focus, coalesce(nullif(h.name, ''), fill.name, '') AS focus_label FROM h LEFT JOIN fill USING (doc_id, code)")
def focus_assignment(s, d):
    """Conversations as documents of pages of ten turns, whose texts name foci."""
    c = td.table(s, d, "conversations")
    label = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("ASP0"), (F.col("conv_id") % 5).cast("string"))).otherwise(F.col("text"))
    rows = c.select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 10).alias("page_index"), F.col("turn").alias("row_seq"), F.lit("daten").alias("kind"), label.alias("label"), (F.col("turn") % 4 == 3).alias("has_values"))
    return focus.assign(rows.withColumn("own", focus.own_focus(F.col("label")))).select("doc_id", "row_seq", "focus", "focus_label")


@query("SELECT user_id, count(*) AS n_sessions FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new_ FROM events) WHERE new_ = 1 GROUP BY user_id")
def session_windows(s, d):
    from .streaming.ingest import sessions

    e = td.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, "30 minutes").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"))


@query("WITH num AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem), " + focus_sql("""SELECT l_orderkey // 8 AS doc_id, l_orderkey % 8 AS page_index, k AS row_seq, CASE l_linenumber WHEN 7 THEN 'summe' WHEN 6 THEN 'uebertrag' ELSE 'daten' END AS kind,
CASE l_partkey % 7 WHEN 0 THEN 'ASP0' || (l_suppkey % 3 + 1) WHEN 1 THEN 'ISP 2: Kessel' WHEN 2 THEN ' ' ELSE ' Pumpe ' || (l_suppkey % 4) END AS label, CASE l_partkey % 7 WHEN 0 THEN 'ASP0' || (l_suppkey % 3 + 1) WHEN 1 THEN 'ISP02' END AS code, CASE l_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Kessel' END AS own, l_quantity > 40 AS has_values FROM num""") + " SELECT doc_id, page_index, row_seq, coalesce(h.code, '') AS focus, coalesce(nullif(h.name, ''), fill.name, '') AS focus_label FROM h LEFT JOIN fill USING (doc_id, code)")
def foci_of_pages(s, d):
    """Eight orders a document, each order a page: foci end at sums, take the names of later rows and hold as a page's default."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    k = F.col("l_partkey") % 7
    label = F.when(k == 0, F.concat(F.lit("ASP0"), (F.col("l_suppkey") % 3 + 1).cast("string"))).when(k == 1, "ISP 2: Kessel").when(k == 2, " ").otherwise(F.concat(F.lit(" Pumpe "), (F.col("l_suppkey") % 4).cast("string")))
    kind = F.when(F.col("l_linenumber") == 7, "summe").when(F.col("l_linenumber") == 6, "uebertrag").otherwise("daten")
    rows = td.table(s, d, "lineitem").select(F.floor(F.col("l_orderkey") / 8).alias("doc_id"), (F.col("l_orderkey") % 8).alias("page_index"), F.row_number().over(order).alias("row_seq"), kind.alias("kind"), label.alias("label"), (F.col("l_quantity") > 40).alias("has_values"))
    return focus.assign(rows.withColumn("own", focus.own_focus(F.col("label")))).select("doc_id", "page_index", "row_seq", "focus", "focus_label")
