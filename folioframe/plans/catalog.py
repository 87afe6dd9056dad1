"""The query catalogue: each operator over the given tables, beside SQL that DuckDB runs on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.functions import scalar as fn
from folioframe.operators import graph, ordered, reconcile
from folioframe.operators import relational as rel
from folioframe.sources import pdf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLES[f.__name__] = sql
        return f

    return keep


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


# Reconciliation.

@query("""SELECT lang, count(*) FILTER (quality = 1 AND n_chars >= 500) AS both_pass, count(*) FILTER (quality <> 1 AND n_chars < 500) AS both_fail,
  count(*) FILTER (quality <> 1 AND n_chars >= 500) AS missed, count(*) FILTER (quality = 1 AND n_chars < 500) AS false_alarm,
  round_even(100.0 * count(*) FILTER ((quality = 1) = (n_chars >= 500)) / count(*), 0)::INT AS agreement
  FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def confusion_matrix(t):
    df = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")
    return reconcile.confusion(df, ["lang"], F.col("quality") == 1, F.col("n_chars") >= 500)


@query("""SELECT CASE WHEN d.doc_id IS NULL THEN 'right_only' WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS side,
  coalesce(d.doc_id, l.doc_id) AS doc_id, quality FROM (SELECT doc_id FROM documents WHERE n_chars > 1000) d FULL JOIN (SELECT doc_id, quality FROM labels) l ON d.doc_id = l.doc_id""")
def verdict_reconcile(t):
    return reconcile.sides(t.documents.where("n_chars > 1000").select("doc_id"), t.labels.select("doc_id", "quality"), "doc_id").select("side", "doc_id", "quality")


@query("""SELECT l_returnflag AS clause, count(*) AS total, count(*) FILTER (l_discount > 0.05) AS matched,
  round_even(100.0 * count(*) FILTER (l_discount > 0.05) / count(*), 0)::INT AS percent,
  CASE WHEN count(*) = count(*) FILTER (l_discount > 0.05) THEN 'full' WHEN count(*) FILTER (l_discount > 0.05) = 0 THEN 'none' ELSE 'partial' END AS status
  FROM lineitem GROUP BY l_returnflag""")
def clause_coverage(t):
    return reconcile.coverage(t.lineitem.select(F.col("l_returnflag").alias("clause"), "l_discount"), "clause", F.col("l_discount") > 0.05)


_SETS = """WITH s AS (SELECT o_orderkey, ['A', 'N', 'R'] AS expected, (SELECT list(DISTINCT l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey) AS found FROM orders),
  gap AS (SELECT o_orderkey, list_filter(expected, lambda x: NOT list_contains(coalesce(found, []), x)) AS gap FROM s),
  each AS (SELECT unnest(gap) AS clause, len(gap) = 1 AS alone FROM gap)"""


def _leverage(t):
    found = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("found"))
    sets = t.orders.select("o_orderkey").join(found, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    sets = sets.select(F.array(*map(F.lit, "ANR")).alias("expected"), F.coalesce("found", F.array().cast("array<string>")).alias("found"))
    return reconcile.leverage(sets, "expected", "found")


@query(_SETS + "SELECT clause, count(*) AS appears, count(*) FILTER (alone) AS alone, row_number() OVER (ORDER BY count(*) DESC, clause)::INT AS rank FROM each GROUP BY clause")
def leverage(t):
    return _leverage(t)


@query("SELECT o_custkey, count(*) AS gap FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY o_custkey ORDER BY gap DESC, o_custkey LIMIT 10")
def coverage_gap_topk(t):
    gaps = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").groupBy("o_custkey").agg(F.count("*").alias("gap"))
    return reconcile.top_gaps(gaps, "gap", "o_custkey", 10)


# Keyed picks, distinct forms, joins.

@query("SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def newest_wins(t):
    return rel.newest_wins(t.events.select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_wins(t):
    return rel.first_wins(t.events.select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@query("""SELECT user_id, count(*) AS n_definitions, max_by(event_type, (ts, event_id)) AS event_type, bool_or(d) AS collided FROM (
  SELECT *, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS d FROM events) z GROUP BY user_id""")
def last_wins_collisions(t):
    return rel.last_wins_collisions(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")


@query("SELECT doc_id, n_same FROM (SELECT doc_id, count(*) OVER (PARTITION BY md5(text)) AS n_same FROM documents) z WHERE n_same > 1")
def duplicate_ids(t):
    return rel.duplicates(t.documents.select("doc_id", "text"), F.md5("text")).select("doc_id", "n_same")


@query("SELECT l_partkey, count(DISTINCT (l_discount, l_tax)) AS n_signatures FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT (l_discount, l_tax)) > 1")
def inconsistent_signature(t):
    return rel.inconsistent(t.lineitem, ["l_partkey"], ["l_discount", "l_tax"])


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'R') AND bool_or(l_returnflag <> 'R')")
def mixed_groups(t):
    return rel.mixed(t.lineitem, ["l_orderkey"], F.col("l_returnflag") == "R", F.col("l_returnflag") != "R")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def allowlist_anti(t):
    return rel.not_listed(t.events.select("event_id", "event_type"), "event_type", ["view", "click", "purchase"])


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('error')")
def denylist_semi(t):
    return rel.listed(t.events.select("event_id", "event_type"), "event_type", ["error"])


@query("SELECT c_custkey, count(o_orderkey) AS n_matches FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') o ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) <> 1")
def exactly_one(t):
    return rel.not_exactly_one(t.customer.select("c_custkey"), t.orders, F.col("o_custkey") == F.col("c_custkey"), "c_custkey", F.col("o_orderstatus") == "O")


@query("SELECT o_orderkey, o_custkey FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey")
def orphan_orders(t):
    return t.orders.select("o_orderkey", "o_custkey").join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")


@query("""SELECT n_nationkey, n_name, (SELECT arg_min(key, (r, key)) FROM (SELECT 0 AS r, c_custkey AS key FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 0
  UNION ALL SELECT 1, s_suppkey FROM supplier WHERE s_nationkey = n_nationkey) z) AS key FROM nation""")
def or_join_first(t):
    c = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nk"))
    s = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nk"))
    n = t.nation.select("n_nationkey", "n_name")
    return rel.first_match(n, "n_nationkey", [(c, n["n_nationkey"] == c["nk"]), (s, n["n_nationkey"] == s["nk"])], ["key"], ["key"])


_LABELS = "SELECT o_orderdate AS t, max(o_orderkey) AS label FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW' GROUP BY o_orderdate"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, label FROM lineitem ASOF LEFT JOIN ({_LABELS}) z ON l_shipdate >= t")
def asof_label(t):
    labels = t.orders.where("o_orderstatus = 'P' AND o_orderpriority = '5-LOW'").select(F.col("o_orderdate").alias("t"), F.col("o_orderkey").alias("label"))
    return rel.asof_backward(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"), labels, "l_shipdate", "t", "label")


@query("SELECT p_partkey, p_size, name FROM part JOIN (VALUES (1, 10, 'small'), (8, 30, 'medium'), (31, 50, 'large')) r(a, b, name) ON p_size BETWEEN a AND b")
def range_explode(t):
    ranges = t.spark.createDataFrame([(1, 10, "small"), (8, 30, "medium"), (31, 50, "large")], "a int, b int, name string")
    return t.part.select("p_partkey", "p_size").join(rel.explode_ranges(ranges, "a", "b", "p_size").drop("a", "b"), "p_size")


@query("""SELECT s_suppkey, p_partkey, p_name, score FROM (SELECT s_suppkey, p_partkey, p_name, (p_size + CASE WHEN p_brand LIKE '%1' THEN 7 ELSE 0 END)::INT AS score,
  row_number() OVER (PARTITION BY s_suppkey ORDER BY p_size + CASE WHEN p_brand LIKE '%1' THEN 7 ELSE 0 END DESC, p_name, p_partkey) AS r
  FROM supplier JOIN part ON s_suppkey % 25 = p_partkey % 25) z WHERE r = 1""")
def best_face(t):
    s, p = t.supplier.select("s_suppkey"), t.part
    score = (F.col("p_size") + F.when(F.col("p_brand").like("%1"), 7).otherwise(0)).cast("int")
    return rel.best_match(s, p, F.col("s_suppkey") % 25, F.col("p_partkey") % 25, "s_suppkey", score, ["p_name", "p_partkey"], ["p_partkey", "p_name"])


@query("SELECT doc_id FROM documents WHERE n_chars > 3000 UNION SELECT doc_id FROM labels WHERE quality = 1")
def set_union(t):
    return t.documents.where("n_chars > 3000").select("doc_id").union(t.labels.where("quality = 1").select("doc_id")).distinct()


@query("SELECT doc_id FROM documents WHERE n_chars > 1000 EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def set_except(t):
    return t.documents.where("n_chars > 1000").select("doc_id").subtract(t.labels.where("quality = 1").select("doc_id"))


@query("SELECT doc_id FROM documents WHERE n_chars > 1000 INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def set_intersect(t):
    return t.documents.where("n_chars > 1000").select("doc_id").intersect(t.labels.where("quality = 1").select("doc_id"))


@query("""SELECT kind, key, name, CASE WHEN nth = 1 THEN name ELSE name || '_' || nth END AS new_name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY kind, key) AS nth FROM (
  SELECT 'c' AS kind, c_custkey AS key, c_mktsegment || '-' || (c_custkey % 50)::VARCHAR AS name FROM customer UNION ALL SELECT 's', s_suppkey, 'BUILDING-' || (s_suppkey % 50)::VARCHAR FROM supplier) u) z""")
def merge_decollide(t):
    a = t.customer.select(F.lit("c").alias("kind"), F.col("c_custkey").alias("key"), F.concat("c_mktsegment", F.lit("-"), (F.col("c_custkey") % 50).cast("string")).alias("name"))
    b = t.supplier.select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("key"), F.concat(F.lit("BUILDING-"), (F.col("s_suppkey") % 50).cast("string")).alias("name"))
    return rel.merge_without_collisions(a, b, "name", ["kind", "key"])


@query("SELECT o_orderkey, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY o_orderkey) AS new_number FROM orders")
def renumber(t):
    top = t.customer.agg(F.max("c_custkey").alias("top")).first().top
    return rel.numbered(t.orders.select("o_orderkey"), "o_orderkey", "new_number", top + 1)


# Ordered folds.

@query("""SELECT conv_id, turn, level, previous FROM (SELECT *, lag(level) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM (
  SELECT conv_id, turn, (length(text) % 6 + 1)::INT AS level FROM conversations) a) z WHERE CASE WHEN previous IS NULL THEN level <> 1 ELSE level > previous + 1 END""")
def heading_sequence(t):
    return ordered.skipped_levels(t.conversations, ["conv_id"], ["turn"], (F.char_length("text") % 6 + 1).cast("int")).select("conv_id", "turn", "level", "previous")


@query("""SELECT conv_id, turn, role, previous FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations) z
  WHERE previous IS NOT NULL AND (previous, role) NOT IN (('user', 'assistant'), ('system', 'user'))""")
def role_pair_nesting(t):
    return ordered.forbidden_pairs(t.conversations, ["conv_id"], ["turn"], "role", [("user", "assistant"), ("system", "user")]).select("conv_id", "turn", "role", "previous")


@query("""SELECT user_id, event_id, gap, CASE WHEN gap > 86400 THEN chr(10) WHEN gap > 3600 THEN ' ' ELSE '' END AS separator FROM (
  SELECT user_id, event_id, (epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000 + floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS gap FROM events) z""")
def gap_separator(t):
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    df = t.events.withColumn("s", start.cast("bigint"))
    return ordered.separators(df, ["user_id"], ["ts", "event_id"], F.col("s"), F.col("s") + F.floor("value"), 3600, 86400).select("user_id", "event_id", "gap", "separator")


@query("SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM conversations")
def running_offset(t):
    return ordered.running_offset(t.conversations, ["conv_id"], ["turn"], F.char_length("text")).select("conv_id", "turn", "offset")


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS joined FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def ordered_concat(t):
    return ordered.ordered_concat(t.conversations, ["conv_id"], ["turn"], "text", "\n\n")


@query("""WITH o AS (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos,
  sum(length(text)) OVER (PARTITION BY conv_id)::BIGINT AS total FROM conversations)
  SELECT conv_id, turn, coalesce(lead(pos) OVER (PARTITION BY conv_id ORDER BY turn), total) - pos AS length FROM o""")
def next_offset_length(t):
    df = ordered.running_offset(t.conversations, ["conv_id"], ["turn"], F.char_length("text"))
    totals = t.conversations.groupBy("conv_id").agg(F.sum(F.char_length("text")).alias("total"))
    return ordered.lengths_from_offsets(df.join(totals, "conv_id"), ["conv_id"], ["turn"], "offset", F.col("total")).select("conv_id", "turn", "length")


@query("""SELECT user_id, event_id FROM (SELECT *, max((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events) z
  WHERE event_type = 'purchase' AND s = 0""")
def set_before_paint(t):
    return ordered.unset_before_use(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "purchase").select("user_id", "event_id")


@query("SELECT user_id, coalesce(min(event_id) FILTER (event_type = 'error'), -1)::BIGINT AS first_offender FROM events GROUP BY user_id")
def first_offender(t):
    return ordered.first_offender(t.events, ["user_id"], "event_id", F.col("event_type") == "error")


# Graphs: the tree region, nation, customer, order, without the nations of region 2.

def _tree(t):
    key = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    nations = t.nation.where("n_regionkey <> 2").select(key("r", F.col("n_regionkey")).alias("src"), key("n", F.col("n_nationkey")).alias("dst"))
    customers = t.customer.select(key("n", F.col("c_nationkey")).alias("src"), key("c", F.col("c_custkey")).alias("dst"))
    orders = t.orders.select(key("c", F.col("o_custkey")).alias("src"), key("o", F.col("o_orderkey")).alias("dst"))
    return nations.unionByName(customers).unionByName(orders).select(F.lit(0).alias("doc"), "src", "dst")


_TREE = """e(src, dst) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation WHERE n_regionkey <> 2 UNION ALL
  SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


@query(f"WITH RECURSIVE {_TREE}, r(node, depth) AS (SELECT 'r' || r_regionkey, 0 FROM region UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node) SELECT node, depth FROM r")
def reachable(t):
    roots = t.region.select(F.lit(0).alias("doc"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.reachable(_tree(t), roots).select("node", "depth")


@query(f"""WITH RECURSIVE {_TREE}, v(node, value) AS (SELECT 'r' || r_regionkey, r_name FROM region UNION ALL SELECT 'c' || c_custkey, c_mktsegment FROM customer WHERE c_acctbal < 0),
  p AS (SELECT dst AS node, src AS parent FROM e UNION ALL SELECT 'r' || r_regionkey, NULL FROM region),
  u(node, up, depth) AS (SELECT node, node, 0 FROM p UNION ALL SELECT u.node, p.parent, depth + 1 FROM u JOIN p ON p.node = u.up WHERE p.parent IS NOT NULL)
  SELECT u.node, arg_min(v.value, depth) AS value FROM u LEFT JOIN v ON v.node = u.up GROUP BY u.node""")
def inherited_attr(t):
    own = t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.col("r_name").alias("value"))
    own = own.unionByName(t.customer.where("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_mktsegment").alias("value")))
    nodes = _tree(t).select("doc", F.col("dst").alias("node"), F.col("src").alias("parent"))
    nodes = nodes.unionByName(t.region.select(F.lit(0).alias("doc"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit(None).cast("string").alias("parent")))
    return graph.inherited(nodes.join(own, "node", "left"), "value").select("node", "value")


# Mappings of names: each order leads to the next one of its customer; the last leads to `P` where it is open, back to
# the first where it is finished, and nowhere else.

_ROLES = """role AS (SELECT o_custkey AS doc, o_orderkey::VARCHAR AS src, coalesce(lead(o_orderkey) OVER w::VARCHAR, CASE o_orderstatus WHEN 'O' THEN 'P' WHEN 'F' THEN first_value(o_orderkey) OVER w::VARCHAR ELSE 'none' END) AS dst,
  last_value(o_orderstatus) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"""


def _roles(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    last = F.when(F.col("o_orderstatus") == "O", "P").when(F.col("o_orderstatus") == "F", F.first("o_orderkey").over(w).cast("string")).otherwise("none")
    return t.orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").cast("string").alias("src"), F.coalesce(F.lead("o_orderkey").over(w).cast("string"), last).alias("dst"))


@query(f"WITH {_ROLES} SELECT doc, src, CASE last WHEN 'O' THEN 'P' WHEN 'P' THEN 'none' END AS final FROM role")
def role_closure(t):
    return graph.closure(_roles(t), t.spark.range(1).select(F.lit("P").alias("name")))


@query(f"WITH {_ROLES} SELECT doc, src FROM role WHERE last = 'F'")
def role_cycle(t):
    return graph.on_cycles(_roles(t))


# Scalar functions.

@query("SELECT doc_id, tag FROM (SELECT doc_id, lang || CASE WHEN doc_id % 3 = 0 THEN '_' ELSE '-' END || source AS tag FROM documents) z WHERE NOT regexp_full_match(tag, '[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*')")
def lang_tag_invalid(t):
    tag = F.concat("lang", F.when(F.col("doc_id") % 3 == 0, "_").otherwise("-"), "source")
    return t.documents.select("doc_id", tag.alias("tag")).where(~fn.is_language_tag(F.col("tag")))


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages WHERE regexp_matches(html, '(?s)<title>.*?</title>')")
def page_title(t):
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return t.pages.where(F.col("html").rlike(r"(?s)<title>.*?</title>")).select("page_id", title.alias("title"))


@query("SELECT page_id, regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def page_lang(t):
    return t.pages.select("page_id", F.regexp_extract("html", '<html[^>]*lang="([^"]*)"', 1).alias("lang"))


@query("SELECT o_orderkey, 'D:' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '+00''00''' AS pdf_date, date_trunc('second', o_orderdate) AS ts, 0::INT AS offset_minutes FROM orders")
def pdf_date_roundtrip(t):
    df = t.orders.select("o_orderkey", fn.format_pdf_date(F.col("o_orderdate")).alias("pdf_date")).withColumn("d", fn.parse_pdf_date(F.col("pdf_date")))
    return df.select("o_orderkey", "pdf_date", "d.ts", "d.offset_minutes")


@query("SELECT p_partkey, p_size FROM part WHERE (p_size & 4) <> 0 AND (p_size & 34) = 34")
def bitmask_filter(t):
    return t.part.where(fn.has_flag(F.col("p_size"), 3) & fn.has_all(F.col("p_size"), 34)).select("p_partkey", "p_size")


@query("""SELECT p_partkey, (CASE WHEN p_size > 25 THEN p_size * 2.0 - 1 ELSE p_size + 0.5 END)::DOUBLE AS a, (p_size % 7)::DOUBLE AS b FROM part""")
def ps_calculator(t):
    a, b = fn.postscript("{ dup 25 gt { 2 mul 1 sub } { 0.5 add } ifelse exch 7 mod }", [F.col("p_size"), F.col("p_size")])
    return t.part.select("p_partkey", a.alias("b0"), b.alias("a0")).select("p_partkey", F.col("b0").alias("a"), F.col("a0").alias("b"))


@query("""SELECT p_partkey, lut[i] + (x - (i - 1)) * (lut[i + 1] - lut[i]) AS y FROM (SELECT *, least(floor(x), 3)::INT + 1 AS i FROM (
  SELECT p_partkey, [0.0, 8.0, 4.0, 6.0, 16.0]::DOUBLE[] AS lut, (least(greatest(p_size::DOUBLE, 2.0), 34.0) - 2.0) * 0.125 AS x FROM part) a) z""")
def sampled_interp(t):
    return t.part.select("p_partkey", fn.sampled(F.col("p_size").cast("double"), [0, 8, 4, 6, 16], (2, 34)).alias("y"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_quantity < 20 THEN 1.0 + pow(l_quantity * 0.05, 2) * 3.0 ELSE 4.0 + (l_quantity - 20) * 0.03125 * -4.0 END AS y FROM lineitem""")
def exp_stitch(t):
    one = lambda x: fn.exponential(x, [1], [4], 2)[0]
    two = lambda x: fn.exponential(x, [4], [0], 1)[0]
    y = fn.stitching(F.col("l_quantity"), (0, 52), [20], [(0, 1), (0, 1)], [one, two])
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", y.alias("y"))


@query("""SELECT doc_id, n::INT AS n_digits, (length(b) - n)::INT AS n_other, n % 2 = 1 AS is_odd FROM (SELECT *, length(regexp_replace(b, '[^0-9A-Fa-f]', '', 'g')) AS n FROM (
  SELECT doc_id, regexp_replace(text, '[ \\t\\r\\n\\f]', '', 'g') AS b FROM documents) a) z""")
def hex_facts(t):
    return t.documents.select("doc_id", fn.hex_facts(F.col("text")).alias("h")).select("doc_id", "h.*")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label ORDER BY n DESC, label LIMIT 8")
def popularity_topk(t):
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(8)


@query("""SELECT p_partkey, (SELECT arg_min(i, ((a - p_size) * (a - p_size) + (b - p_partkey % 50) * (b - p_partkey % 50), i)) FROM (VALUES (0, 5, 5), (1, 20, 40), (2, 45, 10), (3, 30, 30)) v(i, a, b))::INT AS entry FROM part""")
def nearest_color(t):
    at = fn.nearest([F.col("p_size").cast("double"), (F.col("p_partkey") % 50).cast("double")], [(5, 5), (20, 40), (45, 10), (30, 30)])
    return t.part.select("p_partkey", at.alias("entry"))


@query("""SELECT l_returnflag, max(d) AS max_delta, sum(c)::BIGINT AS sum_cents, arg_min(l_orderkey, (-d, l_orderkey)) AS at_order FROM (
  SELECT *, abs(l_quantity - 25) AS d, round(abs(l_quantity - 25) * 100) AS c FROM lineitem) z GROUP BY l_returnflag""")
def delta_stats(t):
    d = F.abs(F.col("l_quantity") - 25)
    df = t.lineitem.select("l_returnflag", "l_orderkey", d.alias("d"))
    return df.groupBy("l_returnflag").agg(F.max("d").alias("max_delta"), F.sum(F.round(F.col("d") * 100)).cast("bigint").alias("sum_cents"), F.min_by("l_orderkey", F.struct(-F.col("d"), "l_orderkey")).alias("at_order"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')")
def json_prop_resolve(t):
    return t.events.select("event_id", fn.typed_json(F.col("props"), "$.k", "bigint").alias("k")).where("k IS NOT NULL")


# The file source: texts written as files, then read back through parser, page tree, content fold and page order.

_LINES = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"


@query(f"SELECT doc_id, md5(array_to_string({_LINES}, chr(10))) AS text_md5 FROM documents WHERE len({_LINES}) > 0")
def file_text_roundtrip(t):
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    files = pdf.from_texts(t.documents.where(F.size(lines) > 0).select("doc_id", F.array_join(lines, "\n").alias("text")))
    texts = pdf.Relations(files).document_text("\n")
    return texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"))


@query(f"SELECT doc_id, ((len({_LINES}) + 59) // 60)::INT AS n_pages, len({_LINES})::BIGINT AS n_fragments FROM documents WHERE len({_LINES}) > 0")
def file_fragment_counts(t):
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    files = pdf.from_texts(t.documents.where(F.size(lines) > 0).select("doc_id", F.array_join(lines, "\n").alias("text")))
    r = pdf.Relations(files)
    shown = r.text_fragment.groupBy("doc_id").agg(F.count("*").alias("n_fragments"), (F.max("page_idx") + 1).alias("n_pages"))
    return shown.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_pages", "n_fragments")
