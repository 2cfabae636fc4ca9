"""Number grounding, ranked search, routing, rules, and keeping dimensions in step."""

from pyspark.sql import functions as F

from tablewright.operators import audit as A
from tablewright.operators import claims as P
from tablewright.operators import reconcile as R
from tablewright.operators import runs as U
from tablewright.operators import search as S
from tablewright.operators.leakage import leakage_suspects
from tablewright.operators.profile import profile
from tablewright.operators.sampling import working_set
from tablewright.operators.task import assess_imbalance
from tablewright.plans.base import LINE_KEY, SQL_LINE_GAPS, line_gaps, query, table

NAMES = ["src1", "Article 2", "RFC 26"]
STRIPPED = "replace(replace(replace(text, 'Article 2', ' '), 'RFC 26', ' '), 'src1', ' ')"
# RE2 has no look-behind, so the character in front is matched too; a percent sign is given a space, as the
# look-behind lets a number follow it directly.
TOKENS = r"(^|[^\p{L}\p{N}_.])(-?\d[\d,]*(?:\.\d+)?%?)"
SQL_CLAIMS = f"""
SELECT doc_id, spot - 1 AS position, token, try_cast(replace(replace(token, ',', ''), '%', '') AS DOUBLE) AS value,
       CASE WHEN contains(token, '.') THEN length(split_part(replace(token, '%', ''), '.', 2)) ELSE 0 END AS decimals,
       suffix(token, '%') AS percent
FROM (SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS spot FROM (
  SELECT doc_id, regexp_extract_all(replace({STRIPPED}, '%', '% '), '{TOKENS}', 2) AS toks FROM documents))"""


def number_claims_(spark, folder):
    return P.number_claims(table(spark, folder, "documents"), ["doc_id"], "text", NAMES)


@query("number_claims", f"SELECT doc_id, position::INT AS position, token, value, decimals::INT AS decimals, percent FROM ({SQL_CLAIMS})")
def number_claims(spark, folder):
    return number_claims_(spark, folder)


def facts_(spark, folder):
    """Facts: prices, sizes and counts of the parts, typed and quoted in a text."""
    parts = table(spark, folder, "part")
    note = F.concat(F.lit("brand "), "p_brand", F.lit(" has size "), F.col("p_size").cast("string"))
    return P.fact_numbers(parts.select("p_size", "p_retailprice", F.lit(True).alias("flag"), note.alias("note")))


SQL_FACTS = r"""
SELECT DISTINCT value FROM (
  SELECT p_size::DOUBLE AS value FROM part UNION ALL SELECT p_retailprice FROM part
  UNION ALL SELECT unnest(regexp_extract_all(p_brand || ' has size ' || p_size, '(^|[^\p{L}\p{N}_.])(-?\d[\d,]*(?:\.\d+)?%?)', 2))::DOUBLE FROM part)"""


@query("fact_numbers", SQL_FACTS)
def fact_numbers(spark, folder):
    return facts_(spark, folder)


SQL_UNGROUNDED = f"""
SELECT c.* FROM ({SQL_CLAIMS}) c
WHERE value IS NOT NULL AND NOT (abs(value) = floor(abs(value)) AND abs(value) <= 10)
  AND NOT EXISTS (SELECT 1 FROM (SELECT abs(value) AS f FROM ({SQL_FACTS}) UNION SELECT abs(value) * 100 FROM ({SQL_FACTS}))
                  WHERE abs(abs(c.value) - f) <= 0.5::DOUBLE * power(10.0::DOUBLE, -c.decimals) + 1e-9)"""


@query("ungrounded_numbers", f"SELECT doc_id, position::INT AS position, token FROM ({SQL_UNGROUNDED})")
def ungrounded_numbers(spark, folder):
    return P.ungrounded(number_claims_(spark, folder), facts_(spark, folder)).select("doc_id", "position", "token")


@query("verified_statements", f"""
SELECT d.doc_id, u.n IS NULL AS verified, coalesce(u.n, 0) AS unverified FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({SQL_UNGROUNDED}) GROUP BY 1) u USING (doc_id)""")
def verified_statements(spark, folder):
    return P.verified(table(spark, folder, "documents"), ["doc_id"], "text", facts_(spark, folder), NAMES)


@query("summary_row", """
WITH s AS (SELECT o_orderpriority AS name, avg((o_orderstatus = 'F')::INT) AS score, avg((o_orderstatus = 'O')::INT) AS test,
                  avg((o_orderstatus = 'P')::INT) AS base, count(*) AS used, (SELECT count(*) FROM orders) AS total FROM orders GROUP BY 1)
SELECT 'Model: ' || name || '; Measure: accuracy, larger is better; Mean over folds: ' || printf('%.4f', score)
  || '; Held-out rows: ' || printf('%.4f', test) || '; Without features: ' || printf('%.4f', base) || ' by majority class'
  || '; Rows: ' || format('{:,}', used) || ' drawn from ' || format('{:,}', total)
  || CASE WHEN score > base + 0.01::DOUBLE THEN '' ELSE '; Do not rely on it: guessing does as well' END || '.' AS summary
FROM s""")
def summary_row(spark, folder):
    def share(state):
        return F.avg((F.col("o_orderstatus") == state).cast("double"))
    orders = table(spark, folder, "orders")
    sums = orders.groupBy(F.col("o_orderpriority").alias("name")).agg(
        share("F").alias("score"), share("O").alias("test"), share("P").alias("base"), F.count(F.lit(1)).alias("used"))
    total = orders.count()
    text = P.summary_text(F.col("name"), F.lit("accuracy"), F.col("score"), F.col("test"), F.col("base"),
                          F.lit("Majority class"), F.col("score") > F.col("base") + 0.01,
                          rows_used=F.col("used"), rows_total=F.lit(total))
    return sums.select(text.alias("summary"))


@query("fact_assembly", f"""
WITH s AS (SELECT count(*) AS n, count(*) - count(l_tax) AS m FROM ({SQL_LINE_GAPS})),
d AS (SELECT sum(n) - count(*) AS d FROM (SELECT count(*) AS n FROM ({SQL_LINE_GAPS}) GROUP BY l_suppkey, l_linenumber, l_tax))
SELECT 'warning' AS severity, 'target_missing' AS "check", 'l_tax' AS "column", round(100.0 * m / n, 2) AS value FROM s WHERE m > 0
UNION ALL SELECT 'warning', 'duplicate_rows', NULL, d::DOUBLE FROM d WHERE d > 0""")
def fact_assembly(spark, folder):
    lines = line_gaps(spark, folder)
    found = A.report([
        A.target_missing(lines, "l_tax"), A.duplicate_rows(lines.select("l_suppkey", "l_linenumber", "l_tax")),
        A.high_missing(profile(lines, ["l_tax"]))])
    return P.fact_rows(found).select("severity", "check", "column", "value")


SQL_BANDS = """
SELECT *, CASE WHEN l_quantity <= 3 THEN 'few' ELSE 'many' END AS band, CASE WHEN l_quantity <= 3 THEN 'F' ELSE 'M' END AS copy FROM lineitem"""


@query("full_facts", f"""
WITH c AS (SELECT band, count(*) AS n FROM ({SQL_BANDS}) GROUP BY 1),
s AS (SELECT max(n) / min(n) AS ratio, min(n) / sum(n) AS share, sum(n)::DOUBLE AS rows, min_by(band, n) AS least FROM c)
SELECT 'critical' AS section, 'leakage_suspect' AS name, 'copy' AS about, 1.0::DOUBLE AS value
UNION ALL SELECT 'warning', 'class_imbalance', 'band', round(ratio, 2) FROM s
UNION ALL SELECT 'class_imbalance', 'ratio', least, round(ratio, 2) FROM s
UNION ALL SELECT 'class_imbalance', 'minority_share', least, round(share, 4) FROM s
UNION ALL SELECT 'sample', 'rows_used', NULL, 2000.0 UNION ALL SELECT 'sample', 'rows_total', NULL, rows FROM s
UNION ALL SELECT 'model', 'guess', 'majority', round(1 - share, 4) FROM s""")
def full_facts(spark, folder):
    """Facts with a critical finding, an imbalance, a sample and a score: a class that a copy gives away and few rows have."""
    few = F.col("l_quantity") <= 3
    lines = table(spark, folder, "lineitem").select(
        *LINE_KEY, "l_tax", F.when(few, "few").otherwise("many").alias("band"), F.when(few, "F").otherwise("M").alias("copy"))
    leaks = leakage_suspects(lines, "band", "classification", LINE_KEY, ["copy", "l_tax"])
    found = A.report([
        A.finding(leaks, "leakage_suspect", "critical", F.col("column"), F.col("score"), F.lit("tells the target")), A.class_imbalance(lines, "band")])
    imbalance = assess_imbalance(lines, "band")
    guess = 1 - imbalance.first()["minority_share"]
    _, sample = working_set(lines, "band", LINE_KEY, 2_000)
    facts = P.assemble(found, imbalance, sample, {"guess": guess, "not measured": None}, "majority")
    return facts.withColumn("value", F.round("value", 4))


# -- search ---------------------------------------------------------------------------------

WORDS = r"list_filter(string_split(regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda w: length(w) >= 3)"
DOC_WORDS = WORDS.format(t="text")


@query("bm25_stats", f"""
WITH t AS (SELECT doc_id, unnest(list_distinct({DOC_WORDS})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, df, round(ln((n.n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM (SELECT term, count(*) AS df FROM t GROUP BY 1), n""")
def bm25_stats(spark, folder):
    return S.term_statistics(table(spark, folder, "documents"), "doc_id", F.col("text"))


SQL_BM25 = f"""
WITH w AS (SELECT doc_id, {DOC_WORDS} AS ws FROM documents),
c AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS mean FROM w),
tf AS (SELECT doc_id, len AS length, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS len, unnest(ws) AS term FROM w) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS rep FROM (SELECT item_id, unnest({DOC_WORDS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT q.item_id AS query, tf.doc_id AS doc,
             sum(rep * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean))) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM s WHERE score > 0)"""


@query("bm25_topk", SQL_BM25 + " SELECT query, doc, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 3")
def bm25_topk(spark, folder):
    hits = S.bm25(table(spark, folder, "documents"), "doc_id", F.col("text"), table(spark, folder, "benchmark"), "item_id", "text")
    return hits.select("query", "doc", "rank", F.round("score", 6).alias("score"))


@query("bm25_topk_pruned", SQL_BM25 + " SELECT query, doc, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 3")
def bm25_topk_pruned(spark, folder):
    hits = S.bm25(table(spark, folder, "documents"), "doc_id", F.col("text"), table(spark, folder, "benchmark"), "item_id", "text", prune=True)
    return hits.select("query", "doc", "rank", F.round("score", 6).alias("score"))


@query("search_fields", r"""
WITH d AS (SELECT p_partkey, list_filter(string_split(regexp_replace(lower(p_name || ' ' || p_type), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), lambda w: length(w) >= 3) AS ws FROM part),
c AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS mean FROM d),
tf AS (SELECT p_partkey, length, term, count(*) AS tf FROM (SELECT p_partkey, len(ws) AS length, unnest(ws) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT p_brand AS query, unnest(['small', 'bolt', 'promo']) AS term FROM part),
s AS (SELECT query, p_partkey, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, p_partkey) AS rank FROM s)
SELECT r.query, r.rank::INT AS rank, r.p_partkey AS doc, p_name, p_type FROM r JOIN part USING (p_partkey) WHERE rank <= 3""")
def search_fields(spark, folder):
    parts = table(spark, folder, "part")
    asked = parts.select("p_brand", F.lit("small bolt, PROMO!").alias("q")).distinct()
    return S.search_fields(parts, "p_partkey", ["p_name", "p_type"], ["p_name", "p_type"], asked, "p_brand", "q")


def _domain_sql(name, source, key, text, extra, k):
    words = WORDS.format(t=text)
    return f"""SELECT '{name}' AS domain, query, rank::INT AS rank, id AS doc FROM (
  WITH d AS (SELECT {key} AS id, {words} AS ws FROM {source}),
  c AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS mean FROM d),
  tf AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(ws) AS length, unnest(ws) AS term FROM d) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  q AS (SELECT query, term, count(*) AS rep FROM (
    SELECT o_orderpriority AS query, unnest({WORDS.format(t=f"o_orderpriority || ' {extra}'")}) AS term FROM (SELECT DISTINCT o_orderpriority FROM orders))
    GROUP BY ALL),
  s AS (SELECT query, id, sum(rep * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS score
        FROM q JOIN tf USING (term) JOIN df USING (term), c GROUP BY ALL)
  SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= {k}"""


@query("multi_domain_search", _domain_sql("part", "part", "p_partkey", "(p_name || ' ' || p_type)", "promo ring", 1)
       + " UNION ALL " + _domain_sql("order", "orders", "o_orderkey", "(o_orderpriority || ' ' || o_orderstatus)", "", 3))
def multi_domain_search(spark, folder):
    """Every order priority as a query, in parts (with that domain's priority words) and in orders."""
    orders = table(spark, folder, "orders")
    asked = orders.select(F.col("o_orderpriority").alias("id"), F.col("o_orderpriority").alias("q")).distinct()
    domains = {
        "part": {"table": table(spark, folder, "part"), "key": "p_partkey", "columns": ["p_name", "p_type"], "k": 1},
        "order": {"table": orders, "key": "o_orderkey", "columns": ["o_orderpriority", "o_orderstatus"], "k": 3},
    }
    found = S.multi_search(domains, asked, "id", "q", {"part": ["promo", "ring", "unused"]})
    return found.select("domain", "query", "rank", "doc")


# Keyword routing: a few domains with words that the invented prose and the part names hold.
DOMAINS = {
    "fastener": ["bolt", "ring", "hot gear"], "size": ["small", "large", "medium"], "tool": ["widget", "gear", "gizmo"],
    "code": ["c++", "#1"],
}


def _hits(words):
    return " + ".join(f"regexp_matches(lower(t), '\\b{w.replace('+', chr(92) + '+')}\\b')::INT" for w in words)


@query("keyword_route", "SELECT p_partkey, CASE WHEN greatest(a, b, c, d) = 0 THEN 'other' WHEN a >= greatest(b, c, d) THEN 'fastener' "
       "WHEN b >= greatest(c, d) THEN 'size' WHEN c >= d THEN 'tool' ELSE 'code' END AS domain FROM (SELECT p_partkey, "
       + ", ".join(f"{_hits(w)} AS {n}" for n, w in zip("abcd", DOMAINS.values()))
       + " FROM (SELECT p_partkey, p_name || ' ' || p_type AS t FROM part))")
def keyword_route(spark, folder):
    text = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, folder, "part").select("p_partkey", S.route(text, DOMAINS, "other").alias("domain"))


RULES = """SELECT rule, row_number() OVER (ORDER BY rule) AS no FROM (
  SELECT DISTINCT p_type AS rule FROM part UNION SELECT DISTINCT p_brand || '/' || p_name FROM part UNION SELECT DISTINCT p_name FROM part)"""
CATEGORIES = """SELECT DISTINCT c FROM (SELECT p_type || ' ' || p_name AS c FROM part UNION ALL SELECT upper(p_name) FROM part
  UNION ALL SELECT p_brand FROM part UNION ALL SELECT 'blue-' || c_mktsegment FROM customer UNION ALL SELECT n_name FROM nation)"""


@query("rule_lookup", f"""
WITH rules AS ({RULES}), cats AS ({CATEGORIES}), pairs AS (
  SELECT c, rule, no, lower(c) AS lc, lower(rule) AS lr FROM cats CROSS JOIN rules),
hit AS (SELECT c, rule, no, CASE WHEN lc = lr THEN 1 WHEN contains(lc, lr) OR contains(lr, lc) THEN 2
  WHEN len(list_filter(string_split(replace(replace(lr, '/', ' '), '-', ' '), ' '), lambda k: k <> '' AND contains(lc, k))) > 0 THEN 3 END AS tier FROM pairs)
SELECT c AS category, b.rule AS rule, b.tier AS tier FROM cats LEFT JOIN (
  SELECT c, first(rule ORDER BY tier, no) AS rule, min(tier) AS tier FROM hit WHERE tier IS NOT NULL GROUP BY c) b USING (c)""")
def rule_lookup(spark, folder):
    parts = table(spark, folder, "part")
    names = parts.select(F.col("p_type").alias("rule")).union(
        parts.select(F.concat("p_brand", F.lit("/"), "p_name"))).union(parts.select("p_name")).distinct()
    categories = (
        parts.select(F.concat("p_type", F.lit(" "), "p_name").alias("c")).union(parts.select(F.upper("p_name")))
        .union(parts.select("p_brand"))
        .union(table(spark, folder, "customer").select(F.concat(F.lit("blue-"), "c_mktsegment")))
        .union(table(spark, folder, "nation").select("n_name")))
    from tablewright.operators.ordering import position
    return S.rule_lookup(categories, position(names, [F.col("rule")], "no"), "c", "rule", "no")


@query("best_match", """
WITH r AS (SELECT p_brand, p_partkey, lower(p_type) AS label, lower(p_name) AS words, p_size::VARCHAR AS size,
                  lower(p_type || ' ' || p_name || ' ' || p_size) AS everything FROM part),
s AS (SELECT *, CASE WHEN contains(label, 'jumbo') OR contains('jumbo', label) THEN 0 WHEN contains(label, 'bolt') OR contains('bolt', label) THEN 1 ELSE 2 END AS hit,
             CASE WHEN contains(label, 'jumbo') THEN 10 WHEN contains(words, 'jumbo') THEN 3 WHEN contains(everything, 'jumbo') THEN 1 ELSE 0 END
           + CASE WHEN contains(label, 'bolt') THEN 10 WHEN contains(words, 'bolt') THEN 3 WHEN contains(everything, 'bolt') THEN 1 ELSE 0 END AS points FROM r)
SELECT p_brand, p_partkey, points FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY hit, points DESC, p_partkey) AS n FROM s) WHERE n = 1""")
def best_match(spark, folder):
    parts = table(spark, folder, "part")
    best = S.best_match(parts, "p_brand", "p_partkey", "p_type", "p_name", ["p_type", "p_name", "p_size"], ["Jumbo ", "bolt"])
    return best.select("p_brand", "p_partkey", "points")


@query("reconcile_dimension", """
WITH renamed AS (SELECT CASE trim(p_brand) WHEN 'Brand#4' THEN 'Brand#40' ELSE trim(p_brand) END AS b, p_partkey, p_type, p_size FROM part
                 WHERE trim(p_brand) <> '' AND trim(p_brand) NOT IN ('Brand#3', 'Brand#7')),
last AS (SELECT b, arg_max(p_type, p_partkey) AS p_type, arg_max(p_size, p_partkey) AS p_size FROM renamed GROUP BY b),
spine AS (SELECT p_brand, min(p_partkey) AS spot FROM (SELECT p_brand, p_partkey FROM part UNION ALL SELECT 'Brand#40', -1) GROUP BY 1)
SELECT row_number() OVER (ORDER BY spot) AS no, p_brand, coalesce(last.p_type, CASE p_brand WHEN 'Brand#3' THEN 'RARE' ELSE 'STANDARD' END) AS p_type,
       coalesce(last.p_size, CASE p_brand WHEN 'Brand#3' THEN 9 ELSE 1 END) AS p_size, last.b IS NULL AS added
FROM spine LEFT JOIN last ON p_brand = b""")
def reconcile_dimension(spark, folder):
    parts = table(spark, folder, "part")
    extra = spark.createDataFrame([("Brand#40", -1)], "p_brand string, p_partkey bigint")
    spine = parts.select("p_brand", "p_partkey").union(extra).groupBy("p_brand").agg(F.min("p_partkey").alias("at"))
    overrides = spark.createDataFrame([("Brand#3", "RARE", 9)], "p_brand string, p_type string, p_size int")
    return R.reconcile(spine, parts, "p_brand", "at", "p_partkey", ["p_type", "p_size"], ["Brand#3", "Brand#7"],
                       {"Brand#4": "Brand#40"}, overrides, {"p_type": "STANDARD", "p_size": 1})


@query("rule_labels", """
SELECT p_partkey, CASE WHEN contains(lower(p_name), 'bolt') THEN 'Fixed' WHEN contains(lower(p_name), 'small') THEN 'Light' ELSE 'Plain' END AS mood,
  CASE WHEN contains(lower(p_type), 'promo') OR contains(lower(p_name), 'ring') OR contains(lower(p_name), 'hot') THEN
    '{' || array_to_string(list_filter([
      CASE WHEN contains(lower(p_type), 'promo') THEN '"if_promo":"show-price"' END,
      CASE WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'hot') THEN '"if_ring":"show-size"' END], lambda x: x IS NOT NULL), ',') || '}'
    ELSE '{"if_any":"show-name"}' END AS rules,
  CASE WHEN contains(lower(p_name), 'blue') OR contains(lower(p_name), 'red') OR contains(lower(p_name), 'gear') OR contains(lower(p_name || ' ' || p_type), 'large') THEN
    array_to_string(list_filter([CASE WHEN contains(lower(p_name || ' ' || p_type), 'blue') OR contains(lower(p_name || ' ' || p_type), 'red') THEN 'Colour' END,
      CASE WHEN contains(lower(p_name || ' ' || p_type), 'gear') THEN 'Moving' END,
      CASE WHEN contains(lower(p_name || ' ' || p_type), 'large') THEN 'Bulky' END], lambda x: x IS NOT NULL)[1:2], ' + ')
    ELSE 'Any + Plain' END AS tags FROM part""")
def rule_labels(spark, folder):
    both = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, folder, "part").select(
        "p_partkey", R.first_rule(F.col("p_name"), {"Bolt": "Fixed", "Small": "Light"}, "Plain").alias("mood"),
        R.matching_rules([(F.col("p_type"), ["promo"], "if_promo", "show-price"),
                          (F.col("p_name"), ["ring", "hot"], "if_ring", "show-size")], {"if_any": "show-name"}).alias("rules"),
        R.first_tags(both, [(["blue", "red"], "Colour"), (["gear"], "Moving"), (["large"], "Bulky")], ["Any", "Plain", "None"]).alias("tags"))


# -- runs --------------------------------------------------------------------------------------


@query("run_history", """
WITH newest AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100)
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS added, o_orderstatus AS status,
       CASE WHEN o_orderstatus = 'F' THEN lines END AS lines, CASE WHEN o_orderstatus = 'F' THEN score END AS score
FROM newest LEFT JOIN (SELECT l_orderkey, count(*) AS lines, round(avg(l_discount), 6) AS score FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def run_history(spark, folder):
    orders = table(spark, folder, "orders")
    measures = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.avg("l_discount"), 6).alias("score"))
    runs, status = orders.select("o_orderkey", "o_orderdate"), orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    found = U.run_history(runs, status, measures, "o_orderkey", "o_orderdate", "status", ["lines", "score"], "F")
    return found.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("added"), "status", "lines", "score")


@query("latest_state", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS value
FROM events GROUP BY user_id""")
def latest_state(spark, folder):
    updates = table(spark, folder, "events").select(
        "user_id", "ts", "event_id", F.col("event_type").alias("status"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"))
    return U.latest_state(updates, "user_id", ["ts", "event_id"], ["status", "value"])
