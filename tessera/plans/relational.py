"""Scans, joins, aggregations and integrity reports on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as nm
from ..functions.scalar import code_of_year, emerged_year, level_of_year, round_half_up, sea_at_level, size_band, start_year, stretch
from ..operators import aggregates as ag
from ..operators import integrity as iq
from ..operators import joins as jn
from ..operators.alloc import nested_quota, quota_cut, shares
from .registry import ORACLES, named, query, table


@query("""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01' AND l_quantity <= 10 AND l_returnflag IN ('A', 'R')
""")
def stat_scan(spark, sf):
    """Range predicates that reach the Parquet statistics."""
    return table(spark, sf, "lineitem").where(
        "l_shipdate >= timestamp_ntz'1997-01-01' and l_shipdate < timestamp_ntz'1997-04-01' and l_quantity <= 10 and l_returnflag in ('A', 'R')"
    ).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l.* FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_totalprice > 300000 AND o_orderpriority = '1-URGENT')")
def late_rows(spark, sf):
    """A narrow scan that decides, and the wide rows it wants."""
    wanted = table(spark, sf, "orders").where("o_totalprice > 300000 and o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(wanted, "l_orderkey", "left_semi")


@query("""
WITH c AS (SELECT l_orderkey, l_suppkey, s_nationkey = c_nationkey AS own FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)
SELECT l_orderkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY own DESC, l_suppkey) AS n FROM c) WHERE n = 1
""")
def prefer_match(spark, sf):
    """One supplier for each order: of the customer's own nation if there is one, else the lowest."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    rows = l.join(s, "l_suppkey").join(o.join(c, "c_custkey"), "l_orderkey")
    return jn.prefer_match(rows, "l_orderkey", F.col("s_nationkey") == F.col("c_nationkey"), "l_suppkey", ["l_suppkey"])


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND toxic = 1 THEN 'drop' WHEN l.doc_id IS NOT NULL THEN 'keep' WHEN n_chars < 200 THEN 'drop' WHEN source IN ('src3', 'src4') THEN 'drop' ELSE 'keep' END AS verdict,
  CASE WHEN l.doc_id IS NOT NULL THEN 'reviewed' WHEN n_chars < 200 THEN 'short' WHEN source IN ('src3', 'src4') THEN 'source' ELSE '' END AS why
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def review_cascade(spark, sf):
    """Reviewed decisions first, then the rules, then keep; always with the reason."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "source")
    r = jn.last_of_list(table(spark, sf, "labels").select("doc_id", "toxic").withColumn("at", F.col("doc_id")), "doc_id", "at").withColumn("seen", F.lit(True))
    v = jn.cascade(
        (F.col("seen") & (F.col("toxic") == 1), "drop", "reviewed"), (F.col("seen"), "keep", "reviewed"), (F.col("n_chars") < 200, "drop", "short"),
        (F.col("source").isin("src3", "src4"), "drop", "source"), default=("keep", ""),
    )
    return d.join(r, "doc_id", "left").select("doc_id", v.alias("v")).select("doc_id", "v.verdict", "v.why")


@query("""
WITH a AS (SELECT p_partkey AS k, count(*) AS n FROM part GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 48 GROUP BY 1),
j AS (SELECT coalesce(a.k, b.k) AS p_partkey, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right FROM a FULL JOIN b ON a.k = b.k)
SELECT *, CASE WHEN n_right = 0 THEN 'unmatched' WHEN n_left = 0 THEN 'unused' WHEN n_left > 1 THEN 'repeated' ELSE 'matched twice' END AS problem
FROM j WHERE n_right = 0 OR n_left = 0 OR n_left > 1 OR n_right > 1
""")
def validated_join(spark, sf):
    l = table(spark, sf, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return jn.mismatches(table(spark, sf, "part").select("p_partkey"), l, "p_partkey")


@query("""
SELECT DISTINCT c_custkey, s_suppkey FROM customer JOIN supplier ON
 (c_nationkey * 100 + c_custkey % 50 = s_nationkey * 100 + s_suppkey % 50) OR (floor(c_acctbal) = floor(s_acctbal))
""")
def or_join(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") * 100 + F.col("c_custkey") % 50).alias("k1"), F.floor("c_acctbal").alias("k2"))
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") * 100 + F.col("s_suppkey") % 50).alias("j1"), F.floor("s_acctbal").alias("j2"))
    return jn.or_join(c, s, [("k1", "j1"), ("k2", "j2")], "c_custkey", "s_suppkey")


@query("""
WITH m AS (SELECT DISTINCT c_custkey, s_suppkey FROM customer JOIN supplier ON (c_nationkey * 100 + c_custkey % 50 = s_nationkey * 100 + s_suppkey % 50) OR (floor(c_acctbal) = floor(s_acctbal)))
SELECT c.c_custkey, count(s_suppkey) AS n FROM customer c LEFT JOIN m USING (c_custkey) GROUP BY 1 HAVING count(s_suppkey) <> 1
""")
def or_join_misses(spark, sf):
    """Customers that the join by any of several keys doesn't give exactly one supplier."""
    return jn.not_matched_once(or_join(spark, sf), table(spark, sf, "customer"), "c_custkey", "s_suppkey", unique=True)


@query("SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 'First' WHEN 'NATION_2' THEN 'Second' ELSE n_name END AS n_name FROM nation")
def repaired_names(spark, sf):
    fixes = spark.createDataFrame([("NATION_1", "First"), ("NATION_2", "Second"), ("NOWHERE", "x")], "wrong string, right string")
    return jn.repaired(table(spark, sf, "nation").select("n_nationkey", "n_name"), fixes, ["n_name"])


@query("SELECT * FROM (VALUES ('NOWHERE', 'x')) t(wrong, \"right\") WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = wrong)")
def unused_fixes(spark, sf):
    fixes = spark.createDataFrame([("NOWHERE", "x")], "wrong string, right string")
    return jn.unused(fixes, table(spark, sf, "nation"), "wrong", "n_name")


@query("""
WITH c AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag || l_linestatus AS plane, count(*) AS n FROM lineitem GROUP BY ALL),
f AS (SELECT *, sum(n) OVER (PARTITION BY month) AS t FROM c), g AS (SELECT *, (n * 100 // t)::BIGINT AS base, n * 100 % t AS rest FROM f),
h AS (SELECT *, 100 - sum(base) OVER (PARTITION BY month) AS spare, row_number() OVER (PARTITION BY month ORDER BY rest DESC, plane) AS k FROM g)
SELECT month, plane, n, base + CASE WHEN k <= spare THEN 1 ELSE 0 END AS percent FROM h
""")
def largest_remainder(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.concat("l_returnflag", "l_linestatus").alias("plane")).agg(F.count(F.lit(1)).alias("n"))
    return ag.largest_remainder(c, ["month"], "plane", "n")


@query("SELECT p_brand, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 4) AS slope, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def origin_regression(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity", "l_extendedprice").join(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey")
    return ag.origin_fit(l, ["p_brand"], F.col("l_quantity"), F.col("l_extendedprice")).withColumn("slope", F.round("slope", 4))


@query("""
SELECT l_returnflag, l_extendedprice FROM (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
WHERE k = least(n - 1, floor(0.9 * n))
""")
def nearest_rank(spark, sf):
    return ag.nearest_rank(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.9)


@query("""
WITH s AS (SELECT o_custkey, o_orderpriority, sum(o_orderkey % 97) AS l FROM orders GROUP BY ALL)
SELECT o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY l DESC, o_orderpriority) AS n FROM s) WHERE n = 1
""")
def longest_name(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", (F.col("o_orderkey") % 97).alias("len"))
    return ag.longest_name(o, "o_custkey", "o_orderpriority", "len")


@query("""
WITH p AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand || p_size::VARCHAR END AS g FROM part),
k AS (SELECT *, coalesce('g:' || g, 'p:' || p_partkey::VARCHAR) AS merged_key FROM p)
SELECT merged_key, round(sum(p_retailprice), 2) AS p_retailprice, count(*) AS n_pieces, arg_min(p_partkey, row(-p_retailprice, p_partkey)) AS p_partkey, arg_min(p_type, row(-p_retailprice, p_partkey)) AS p_type FROM k GROUP BY 1
""")
def merged_pieces(spark, sf):
    g = F.when(F.col("p_partkey") % 5 != 0, F.concat("p_brand", F.col("p_size").cast("string")))
    return ag.merged_pieces(table(spark, sf, "part").withColumn("g", g), "g", "p_partkey", "p_retailprice", ["p_type"])


@query("SELECT l_linestatus, round(avg(l_quantity) FILTER (l_discount > 0.05), 6) AS mean, round(stddev_pop(l_quantity) FILTER (l_discount > 0.05), 6) AS sd, count(*) FILTER (l_discount > 0.05) AS n FROM lineitem GROUP BY 1")
def masked_spread(spark, sf):
    s = ag.masked_spread(table(spark, sf, "lineitem"), ["l_linestatus"], F.col("l_quantity"), F.col("l_discount") > 0.05)
    return s.select("l_linestatus", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, s_nationkey, l_extendedprice, 0.1 + 0.02 * s_nationkey AS share, l_orderkey * 10 + l_linenumber AS id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY l_extendedprice DESC, id) AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM l)
SELECT l_orderkey, l_linenumber, s_nationkey, k <= floor(share * n + 0.5) AS chosen FROM r
""")
def quota_cut_rows(spark, sf):
    """The dearest lines of each nation's suppliers up to the nation's target share."""
    return quota_cut(_quota_rows(spark, sf), "s_nationkey", "l_extendedprice", "share", "id", "chosen").select("l_orderkey", "l_linenumber", "s_nationkey", "chosen")


def _quota_rows(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity").join(s, "l_suppkey")
    return l.withColumn("share", F.lit(0.1) + F.lit(0.02) * F.col("s_nationkey")).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, s_nationkey, l_extendedprice, 0.1 + 0.02 * s_nationkey AS share, l_orderkey * 10 + l_linenumber AS id, l_quantity > 35 AS old FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY old DESC, l_extendedprice DESC, id) AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM l)
SELECT s_nationkey, count(*) AS n, round(avg((k <= floor(share * n + 0.5))::INT), 9) AS share, sum((k <= floor(share * n + 0.5) AND old)::INT)::BIGINT AS kept FROM r GROUP BY 1
""")
def nested_quota_shares(spark, sf):
    rows = _quota_rows(spark, sf).withColumn("old", F.col("l_quantity") > 35)
    cut = nested_quota(rows, "s_nationkey", "l_extendedprice", "share", "old", "id", "chosen")
    kept = cut.groupBy("s_nationkey").agg(F.sum((F.col("chosen") & F.col("old")).cast("long")).alias("kept"))
    return shares(cut, "s_nationkey", "chosen").join(kept, "s_nationkey").select("s_nationkey", "n", F.round("share", 9).alias("share"), "kept")


ALLOWED = {"open": ("src1", "src2", "src5"), "share": ("src1", "src2", "src3", "src4", "src5", "src6")}


@query("""
WITH u AS (SELECT DISTINCT lang AS block, CASE WHEN lang IN ('en', 'de') THEN 'open' ELSE 'share' END AS bl, source FROM documents),
s(source, l) AS (VALUES ('src1', 'src1'), ('src2', 'src2'), ('src3', 'src3'), ('src5', 'src5'), ('src7', 'src7'), ('src9', 'src1'))
SELECT block, u.source, CASE WHEN l IS NULL THEN 'unknown source' ELSE 'licence ' || l END AS problem FROM u LEFT JOIN s ON s.source = u.source
WHERE l IS NULL OR NOT (CASE WHEN bl = 'open' THEN l IN ('src1', 'src2', 'src5') ELSE l IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6') END)
""")
def licence_guard(spark, sf):
    uses = table(spark, sf, "documents").select(F.col("lang").alias("block"), F.when(F.col("lang").isin("en", "de"), "open").otherwise("share").alias("block_licence"), "source")
    sources = spark.createDataFrame([("src1", "src1"), ("src2", "src2"), ("src3", "src3"), ("src5", "src5"), ("src7", "src7"), ("src9", "src1")], "source string, licence string")
    return iq.licence_problems(uses, sources, "block", "source", "licence", ALLOWED)


@query("""
SELECT s_suppkey, p AS problem FROM (SELECT s_suppkey, unnest([CASE WHEN s_acctbal < 0 THEN 'negative balance' END, CASE WHEN s_nationkey % 5 = 0 THEN 'nation' END, CASE WHEN s_name IS NULL OR s_name = '' THEN 'name' END]) AS p FROM supplier) WHERE p IS NOT NULL
""")
def constraint_report(spark, sf):
    return iq.problems(table(spark, sf, "supplier"), "s_suppkey", {"negative balance": F.col("s_acctbal") >= 0, "nation": F.col("s_nationkey") % 5 != 0, "name": F.col("s_name") != ""})


@query("SELECT doc_id, sha256('v' || doc_id::VARCHAR || chr(31) || CASE WHEN lang IS NULL THEN 'n' ELSE 'v' || lang END || chr(31) || CASE WHEN text IS NULL THEN 'n' ELSE 'v' || text END) AS hash FROM documents")
def feature_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", iq.row_hash("doc_id", "lang", "text").alias("hash"))


@query("""
WITH a AS (SELECT source, count(*)::VARCHAR AS v FROM documents GROUP BY 1), b AS (SELECT source, count(*)::VARCHAR AS v FROM documents WHERE source <> 'src2' AND n_chars > 50 GROUP BY 1)
SELECT coalesce(a.source, b.source) AS source, CASE WHEN b.v IS NULL THEN 'new' WHEN a.v IS NULL THEN 'gone' ELSE 'changed' END AS why FROM a FULL JOIN b ON a.source = b.source WHERE a.v IS DISTINCT FROM b.v
""")
def stale_inputs(spark, sf):
    d = table(spark, sf, "documents")
    of = lambda x: x.groupBy("source").agg(F.count(F.lit(1)).cast("string").alias("sha256"))
    return iq.stale(of(d), of(d.where("source <> 'src2' and n_chars > 50")), "source")


@query("""
SELECT o_orderkey, y::BIGINT AS year, CASE WHEN y <= 1219 THEN 0 ELSE least(201, ceil((y - 1219) / 4.0)) END::INT AS code, least(201, greatest(0, floor((y - 1219) / 4.0)))::INT AS level,
  CASE WHEN y <= 1219 THEN NULL ELSE 1219 + 4 * least(201, ceil((y - 1219) / 4.0)) END::INT AS emerged,
  (CASE WHEN y <= 1219 THEN 0 ELSE least(201, ceil((y - 1219) / 4.0)) END) > 100 AS sea,
  floor((o_totalprice - 250000) / 100 + 0.5)::BIGINT AS rounded, round(least(100.0, greatest(0.0, (o_totalprice - 50000) / 150000 * 100)), 6) AS stretched,
  ((o_totalprice >= 10000)::INT + (o_totalprice >= 50000)::INT + (o_totalprice >= 200000)::INT)::INT AS band
FROM (SELECT *, 1200 + o_orderkey % 900 AS y FROM orders)
""")
def scalar_rules(spark, sf):
    """Coast codes, half-up rounding, stretches and bands."""
    y = (1200 + F.col("o_orderkey") % 900).alias("year")
    o = table(spark, sf, "orders").select("o_orderkey", y, "o_totalprice").withColumn("code", code_of_year(F.col("year")))
    p = F.col("o_totalprice")
    return o.select(
        "o_orderkey", F.col("year").cast("long").alias("year"), "code", level_of_year(F.col("year")).alias("level"), emerged_year(F.col("code")).alias("emerged"),
        sea_at_level(F.col("code"), F.lit(100)).alias("sea"), round_half_up((p - 250000) / 100).cast("long").alias("rounded"),
        F.round(stretch(p, 50000.0, 200000.0), 6).alias("stretched"), size_band(p, (10000, 50000, 200000)).alias("band"),
    )


@query("""
SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\s[/–-]\\s|\\s/|/\\s|/'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS parts,
  regexp_matches(text, '\\s[–-]\\s|/') AS two, try_cast(nullif(regexp_extract(text, '\\b(\\d{3,4})\\b', 1), '') AS INT) AS year FROM documents
""")
def name_split(spark, sf):
    """Single names in the whole text, taken as a name, and the first year in it."""
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", nm.split_names(text).alias("parts"), nm.is_two_names(text).alias("two"), start_year(text).alias("year"))




NAMES = (
    ("1", "Нева", "Нева", None, None), ("2", "Плющівка", None, None, None), ("3", "Кожановское озеро", None, None, "be"), ("4", "Мядзел", None, "BY", None),
    ("5", "Дніпро", None, None, None), ("6", "Днепр", None, None, "uk"), ("7", "Случь", None, None, None), ("8", "Ўла", None, None, None), ("9", "Сож", None, None, "be"),
    ("10", "ДНЕПР", None, "RU", None), ("11", "Їжа", None, None, None), ("12", "Объезд", None, None, None), ("13", "Зграя-Ягода", None, "UA", None), ("14", "Щучье", None, None, None),
)
CHOSEN = (("1", "ru", "tag"), ("2", "uk", "letters"), ("3", "ru", "letters"), ("4", "be", "country"), ("5", "be", "guess"), ("6", "uk", "nearby"), ("7", "ru", "guess"), ("8", "be", "letters"),
          ("9", "be", "nearby"), ("10", "ru", "country"), ("11", "uk", "letters"), ("12", "ru", "letters"), ("13", "uk", "country"), ("14", "ru", "guess"))


def _names(spark, sf):
    """Every part under one of the names, in turn."""
    df = spark.createDataFrame([(k, *row[1:]) for k, row in enumerate(NAMES)], "k long, text string, ru string, country string, nearby string")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % len(NAMES)).alias("k"))
    df = parts.join(F.broadcast(df), "k")
    tags = F.when(F.col("ru").isNotNull(), F.create_map(F.lit("ru"), F.col("ru"))).otherwise(F.create_map().cast("map<string,string>"))
    return df.select("id", "text", nm.chosen_language(F.col("text"), tags, F.col("country"), F.col("nearby")).alias("c")).select("id", "text", "c.lang", "c.rule")


@query("SELECT p_partkey AS id, lang, rule FROM part JOIN (VALUES " + ", ".join(map(str, CHOSEN)) + f") t(k, lang, rule) ON k::INT - 1 = p_partkey % {len(NAMES)}")
def lang_cascade(spark, sf):
    return _names(spark, sf).select("id", "lang", "rule")


LATIN = (("1", "Neva"), ("2", "Pliushchivka"), ("3", "Kozhanovskoye ozero"), ("4", "Myadzyel"), ("5", "Dnipro"), ("6", "Dnepr"), ("7", "Sluch"), ("8", "Wla"), ("9", "Sozh"), ("10", "DNEPR"), ("11", "Yizha"),
         ("12", "Obyezd"), ("13", "Zghraia-Yahoda"), ("14", "Shchuchye"))


@query("SELECT p_partkey AS id, latin FROM part JOIN (VALUES " + ", ".join(map(str, LATIN)) + f") t(k, latin) ON k::INT - 1 = p_partkey % {len(NAMES)}")
def romanize(spark, sf):
    return _names(spark, sf).select("id", nm.romanize("text", "lang").alias("latin"))


@query("""
WITH d AS (SELECT doc_id, list_value(CASE WHEN regexp_matches(text, '(?i)password') THEN 'password' END, CASE WHEN regexp_matches(text, '(?i)license|licence') THEN 'license' END, CASE WHEN regexp_matches(text, '\\bAKIA') THEN 'key' END) AS a FROM documents)
SELECT doc_id, list_filter(a, lambda x: x IS NOT NULL) AS hits FROM d
""")
def keyword_flags(spark, sf):
    """A keyword table applied to whole texts."""
    words = (("password", "(?i)password"), ("license", "(?i)license|licence"), ("key", r"\bAKIA"))
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(w)) for w, p in words]))
    return table(spark, sf, "documents").select("doc_id", hits.alias("hits"))


@query("""
SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (l_quantity > 25 AND l_discount > 0.05) AS both,
  max(l_quantity) - min(l_quantity) AS spread FROM lineitem
""")
def build_summary(spark, sf):
    """Named counters in one pass."""
    return table(spark, sf, "lineitem").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.countDistinct("l_suppkey").alias("suppliers"),
        F.count_if((F.col("l_quantity") > 25) & (F.col("l_discount") > 0.05)).alias("both"), (F.max("l_quantity") - F.min("l_quantity")).alias("spread"),
    )


@query("""
SELECT DISTINCT k, src FROM (SELECT c_nationkey AS k, 'c' AS src FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, 'c' FROM supplier WHERE s_acctbal > 9000)
WHERE k NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)
""")
def union_minus(spark, sf):
    """Union, difference and one row per key."""
    c = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("k"))
    gone = table(spark, sf, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("k"))
    return c.unionByName(s).join(gone, "k", "left_anti").dropDuplicates(["k"]).withColumn("src", F.lit("c"))


@query("""
SELECT l_returnflag, year(l_shipdate)::INT AS y, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, y)
""")
def beyond_rollup(spark, sf):
    l = table(spark, sf, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("y"), "l_quantity")
    return l.rollup("l_returnflag", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def beyond_cube(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS q,
  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)
""")
def beyond_windows(spark, sf):
    w, t = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.ntile(4).over(t).alias("q"), F.lag("o_orderkey").over(t).alias("before"),
        F.count(F.lit(1)).over(t.rowsBetween(-2, 0)).alias("c"),
    )


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def beyond_intersect_all(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def beyond_json(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2024-01-01') AS start, count(*) AS n, sum(value) > 0 AS some FROM events GROUP BY ALL")
def beyond_tumbling(spark, sf):
    w = F.window(F.col("ts"), "6 hours")
    return table(spark, sf, "events").groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), (F.sum("value") > 0).alias("some")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "some")


@query("""
WITH m AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOURS > ts THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, k
""")
def beyond_sessions(spark, sf):
    w = F.session_window(F.col("ts"), "2 hours")
    return table(spark, sf, "events").groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


@query("""
WITH r AS (SELECT o_orderkey, o_orderdate, o_orderdate + INTERVAL 3 DAYS AS till FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)
SELECT l_orderkey, l_linenumber, o_orderkey FROM lineitem JOIN r ON l_shipdate >= o_orderdate AND l_shipdate < till WHERE l_quantity = 50
""")
def beyond_range_join(spark, sf):
    day = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    r = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 400000").select("o_orderkey", day("o_orderdate").alias("lo")).withColumn("hi", F.col("lo") + 3 * 86400)
    l = table(spark, sf, "lineitem").where("l_quantity = 50").select("l_orderkey", "l_linenumber", day("l_shipdate").alias("at"))
    return jn.range_join(l, r, "at", "lo", "hi", 3 * 86400).select("l_orderkey", "l_linenumber", "o_orderkey")
