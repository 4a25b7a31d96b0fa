"""The driver's tables as function lists: an order is a document, a line item a row, its measures are the cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship
from ..tables import buckets

# Index, key, address, group, subgroup, label, column of the line item.
COLUMNS = (
    (0, "A_1_1", "1.1", "Mengen", "Stück", "Menge", "l_quantity"),
    (1, "A_1_2", "1.2", "Geld", "netto", "Preis", "l_extendedprice"),
    (2, "A_2_1", "2.1", "Sätze", "Abzug", "Rabatt", "l_discount"),
    (3, "A_2_2", "2.2", "Sätze", "Zuschlag", "Steuer", "l_tax"),
)
KEYS = [c[1] for c in COLUMNS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([c[:6] for c in COLUMNS], "column_index int, spalte_key string, adresse string, gruppe string, untergruppe string, label string").withColumn("is_note", F.lit(False))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    d = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    notes = F.filter(F.array(F.when(F.col("o_totalprice") > 200_000, "Summe über der Grenze"), F.when(F.col("o_orderpriority") == "1-URGENT", "Plansatz prüfen")), lambda x: x.isNotNull())
    return d.select(
        F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Liste "), F.col("o_orderkey").cast("string")).alias("datei"), F.col("c_mktsegment").alias("projekt"), F.col("c_name").alias("auftraggeber"), F.col("n_name").alias("anlage"), F.col("o_orderpriority").alias("gewerk"),
        F.col("o_orderstatus").alias("fassung"), F.col("o_orderstatus").alias("profil"), F.concat(F.lit("Plan "), (F.col("o_custkey") % 7).cast("string")).alias("planersteller"), (F.col("o_orderkey") % 10).cast("string").alias("blatt_nr"), F.col("o_orderdate").alias("importiert_am"), notes.alias("warnings"),
    )


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    # dealt out once, in as many parts as the table's size asks for: what follows by document moves no row again
    items = table(spark, sf_dir, "lineitem")
    return items.repartition(buckets(items), "l_orderkey").withColumn("row_seq", F.row_number().over(w))


def rows_with_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that hold their cells, in one pass over the line items."""
    kind = F.when(F.col("l_linenumber") == 7, "summe").when(F.col("l_linenumber") == 6, "uebertrag").otherwise("daten")
    focus = F.when(F.col("l_suppkey") % 5 == 0, "").otherwise(F.concat(F.when(F.col("l_suppkey") % 2 == 0, "ASP").otherwise("ISP"), F.lpad((F.col("l_suppkey") % 7).cast("string"), 2, "0")))
    note = lambda i: F.when((F.col("l_linenumber") == 4) & F.lit(i == 2), "siehe Blatt").otherwise("")
    cells_ = F.array(*[F.struct(F.lit(i).alias("column_index"), F.col(m).alias("count"), F.lit(f"w{i}").alias("raw_value"), note(i).alias("note")) for i, *_, m in COLUMNS])
    return _numbered(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc_id"), "row_seq", (F.ascii("l_returnflag") - 65).alias("page_index"), kind.alias("kind"), focus.alias("focus"),
        F.when(focus == "", "").otherwise(F.concat(F.lit("Anlage "), F.substring(focus, 4, 2))).alias("focus_label"), F.concat(F.lit("Teil "), F.col("l_partkey").cast("string")).alias("datenpunkt"),
        F.col("row_seq").cast("string").alias("row_no"), F.concat(F.lit("B"), (F.col("l_partkey") % 10).cast("string")).alias("bas"), F.col("l_linestatus").alias("qualifier"), F.when(F.col("l_linenumber") == 3, "geprüft").otherwise("").alias("remark"),
        F.when(kind == "daten", "").otherwise(F.concat(F.lit("Zeile der Art "), kind)).alias("reason"), F.concat(F.lit("0,"), F.col("row_seq").cast("string"), F.lit(",9,9")).alias("bbox"), cells_.alias("cells"),
    )


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_with_cells(spark, sf_dir).drop("cells")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_with_cells(spark, sf_dir).select("doc_id", "row_seq", F.inline("cells"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the rows, with the first focus there, and a kind by their number."""
    p = rows(spark, sf_dir).groupBy("doc_id", "page_index").agg(F.min(F.nullif("focus", F.lit(""))).alias("focus"))
    kind = F.when((F.col("doc_id") + F.col("page_index")) % 11 == 0, "regelschema").when((F.col("doc_id") + F.col("page_index")) % 13 == 0, "sonstiges").otherwise("funktionsliste")
    return p.withColumn("kind", kind).withColumn("confidence", F.when(F.col("doc_id") % 2 == 0, 0.85).otherwise(0.5)).withColumn("focus", F.coalesce("focus", F.lit("")))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price for three of the four columns: the dearest, cheapest and mean part."""
    p = table(spark, sf_dir, "part").agg(F.max("p_retailprice").alias("a"), F.min("p_retailprice").alias("b"), F.round(F.avg(F.col("p_retailprice").cast("decimal(18,2)")).cast("double"), 2).alias("c"))
    return p.select(F.explode(F.array(*[F.struct(F.lit(k).alias("spalte_key"), F.col(c).alias("preis")) for k, c in zip(KEYS, "abc", strict=False)])).alias("x")).select("x.*")
