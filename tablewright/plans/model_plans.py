"""Baselines, neighbours, and Spark ML candidates."""

import statistics
import uuid

from pyspark.sql import functions as F

from tablewright.functions.hashing import row_hash
from tablewright.operators import boosting, ordered, scoring, task, tuning
from tablewright.operators import cleaning as C
from tablewright.operators import models as L
from tablewright.operators import neighbours as K
from tablewright.operators import sampling as S
from tablewright.operators.features import engineer
from tablewright.operators.training import sweep
from tablewright.plans.base import LINE_KEY, SQL_LINE_TOTAL, labelled_documents, line_total, query, sql_fold, sql_hash, table
from tablewright.plans.sampling_plans import DOC_FOLDS
from tablewright.session import shared_folder, spread


@query("baseline_cv", f"""
WITH f AS ({DOC_FOLDS}), cells AS (SELECT k.fold, c.label, count(f.doc_id) FILTER (f.fold = k.fold) AS own,
    count(f.doc_id) FILTER (f.fold <> k.fold) AS train
  FROM (SELECT unnest([0, 1, 2, 3, 4]) AS fold) k CROSS JOIN (SELECT DISTINCT quality AS label FROM f) c
  JOIN f ON f.quality = c.label GROUP BY ALL),
g AS (SELECT fold, first(label ORDER BY train DESC, label) AS usual, first(own ORDER BY train DESC, label) AS hits, sum(own) AS rows,
             count(*) FILTER (own > 0) AS present FROM cells GROUP BY fold)
SELECT fold, usual, round(hits / rows, 6) AS score,
       round(2 * hits / (hits + rows) / (present + (hits = 0)::INT), 6) AS f1_macro FROM g""")
def baseline_cv(spark, folder):
    folds = S.with_folds(labelled_documents(spark, folder), "quality", ["doc_id"], folds=5)
    return L.baseline_cv(folds, "quality", "classification")


@query("baseline_cv_reg", f"""
WITH f AS (SELECT l_extendedprice AS y, ((r > n // 5)::INT + (r > n * 2 // 5)::INT + (r > n * 3 // 5)::INT + (r > n * 4 // 5)::INT) AS fold
  FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY {sql_hash(43, LINE_KEY)}, {', '.join(LINE_KEY)}) AS r FROM lineitem)),
g AS (SELECT k.fold, avg(y) AS mu FROM f JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS fold) k ON f.fold <> k.fold GROUP BY 1)
SELECT fold, round(1 - sum((y - mu) ** 2) / (var_pop(y) * count(*)), 6) AS score FROM f JOIN g USING (fold) GROUP BY fold""")
def baseline_cv_reg(spark, folder):
    folds = S.with_folds(table(spark, folder, "lineitem"), "l_extendedprice", LINE_KEY, classification=False)
    return L.baseline_cv(folds, "l_extendedprice", "regression")


@query("knn_vote", f"""
WITH e AS (SELECT vec_id, label, embedding, {sql_fold(7, ['vec_id'], 5)} AS part FROM embeddings),
d AS (SELECT q.vec_id, t.vec_id AS n, t.label,
             sqrt(list_sum(list_transform(list_zip(q.embedding, t.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))) AS dist
      FROM e q JOIN e t ON q.part = 0 AND t.part <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, n) AS r FROM d),
w AS (SELECT vec_id, label, sum(CASE WHEN z > 0 THEN (dist = 0)::INT ELSE 1 / dist END) AS w
      FROM (SELECT *, max((dist = 0)::INT) OVER (PARTITION BY vec_id) AS z FROM k WHERE r <= 15) GROUP BY ALL)
SELECT vec_id, first(label ORDER BY round(w, 9) DESC, label) AS prediction, round(max(w) / sum(w), 6) AS share FROM w GROUP BY vec_id""")
def knn_vote(spark, folder):
    from tablewright.functions.hashing import hash_fold
    rows = table(spark, folder, "embeddings").withColumn("part", hash_fold(["vec_id"], 7, 5))
    near = K.nearest(rows.filter("part = 0"), rows.filter("part <> 0"), "vec_id", "embedding", "label")
    return K.vote(near).select(F.col("key").alias("vec_id"), "prediction", F.round("share", 6).alias("share"))


# With one standardised column, ridge has a closed form: slope = Sxy / (Sxx + alpha).
@query("ridge_one_feature", """
WITH s AS (SELECT avg(l_discount) AS mx, stddev_pop(l_discount) AS sx, avg(total) AS my, count(*) AS n,
                  covar_pop(l_discount, total) AS c FROM (SELECT l_discount, l_quantity + 500 * l_discount AS total FROM lineitem))
SELECT round(n * c / sx / (n + 1000), 4) AS slope, round(my, 4) AS intercept FROM s""")
def ridge_one_feature(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_discount", (F.col("l_quantity") + 500 * F.col("l_discount")).alias("total"))
    fitted = L.fit("linear", "regression", {"strength": 1000.0}, lines, "total", ["l_discount"])
    slope, intercept = float(fitted.model.coefficients[0]), float(fitted.model.intercept)
    return spark.createDataFrame([(round(slope, 4), round(intercept, 4))], "slope double, intercept double")


FEATURES = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
LABELS = ["late", "on time"]

# What SQL can say of a cross-validation: how many rows each fold holds out, and that the score of a
# planted relation beats the guess of the commonest class.
SQL_FOLDS = """
WITH c AS (SELECT {target} AS y, count(*) AS n FROM ({source}) GROUP BY 1)
SELECT '{name}' AS name, fold, sum((n * (fold + 1)) // 5 - (n * fold) // 5)::BIGINT AS rows, true AS beats_guess
FROM c, (SELECT unnest([0, 1, 2, 3, 4])::INT AS fold) GROUP BY fold"""


def _late(spark, folder):
    return line_total(spark, folder).select(
        *LINE_KEY, "late", "l_quantity", "l_discount", "l_tax", "l_returnflag",
        F.col("l_discount").cast("string").alias("l_discount_text"), F.col("l_tax").cast("string").alias("l_tax_text"))


def _client(spark, folder):
    """Every customer, with a class that the balance and the segment decide."""
    rich = (F.col("c_acctbal") > 3000) & (F.col("c_mktsegment") != "BUILDING")
    return table(spark, folder, "customer").select(
        "c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey", F.when(rich, "rich").otherwise("plain").alias("y"))


SQL_CLIENT = """
SELECT *, CASE WHEN c_acctbal > 3000 AND c_mktsegment <> 'BUILDING' THEN 'rich' ELSE 'plain' END AS y FROM customer"""
CLIENT_FEATURES = ["c_acctbal", "c_mktsegment", "c_nationkey"]


FOLDED_ROWS = 20_000_000  # clients of few narrow columns compress to a file that few tasks read


def _folds(rows, target, key):
    """The table with its folds, by the rule for their number."""
    folds = S.fold_count(rows, target, True)
    return spread(S.with_folds(rows, target, key, folds=folds), rows.count(), FOLDED_ROWS).cache(), folds


def _cv(rows, target, features, labels, key, name, params=None, **how):
    """Cross-validation by the rule for the number of folds."""
    spark = rows.sparkSession
    data, folds = _folds(rows, target, key)
    try:
        found = L.cross_validate(lambda k: L.fold_score(
            name, "classification", params or L.DEFAULTS[name], data, target, features, k, "accuracy", labels, key=key, **how), folds)
        guess = {r["fold"]: r["score"] for r in L.baseline_cv(data, target, "classification").collect()}
        rows_of = {r["fold"]: r["count"] for r in data.groupBy("fold").count().collect()}
    finally:
        data.unpersist()
    return spark.createDataFrame([(name, k, rows_of[k], s > guess[k] + L.BASELINE_MARGIN) for k, s in enumerate(found)],
                                 "name string, fold int, rows bigint, beats_guess boolean")


# A class that three numbers decide but for one row in eight, whose class is turned round by the hash of its key. No
# model can foresee those, so the share of the others is the best score of a fold, and a good model comes close to it.
TURNED = sql_hash(61, LINE_KEY)
SQL_NOISY = f"""
SELECT *, CASE WHEN (late = 'late') <> turned THEN 'late' ELSE 'on time' END AS seen
FROM (SELECT *, substr({TURNED}, 1, 1) < '2' AS turned FROM ({SQL_LINE_TOTAL}))"""


def _noisy(spark, folder):
    turned = F.substring(row_hash(LINE_KEY, 61), 1, 1) < "2"
    lines = _late(spark, folder).withColumn("turned", turned)
    return lines.withColumn("seen", F.when((F.col("late") == "late") != F.col("turned"), "late").otherwise("on time"))


SQL_NOISY_FOLDS = f"""
WITH d AS ({SQL_NOISY}),
r AS (SELECT *, row_number() OVER (PARTITION BY seen ORDER BY {sql_hash(43, LINE_KEY)}, {', '.join(LINE_KEY)}) AS r, count(*) OVER (PARTITION BY seen) AS n FROM d),
f AS (SELECT *, (r > n // 5)::INT + (r > n * 2 // 5)::INT + (r > n * 3 // 5)::INT + (r > n * 4 // 5)::INT AS fold FROM r)
SELECT '{{name}}' AS name, fold, count(*)::BIGINT AS rows, round(avg((NOT turned)::INT), 6) AS best, true AS near_best FROM f GROUP BY fold"""


def _boosted_folds(spark, folder, name, params, features=FEATURES, patience=5):
    return _noisy_folds(spark, folder, name, lambda data, folds: L.boosted_cv(
        name, "classification", {**L.DEFAULTS[name], **params}, data, "seen", features, folds, "accuracy", LABELS, key=LINE_KEY, patience=patience))


def _noisy_folds(spark, folder, name, scores):
    """The scores of all folds against the share of rows that can be foreseen at all."""
    rows = _noisy(spark, folder)
    data, folds = _folds(rows, "seen", LINE_KEY)
    try:
        found = scores(data, folds)
        cells = {r["fold"]: r for r in data.groupBy("fold").agg(F.count("*").alias("rows"), F.round(F.avg((~F.col("turned")).cast("int")), 6).alias("best")).collect()}
    finally:
        data.unpersist()
    return spark.createDataFrame(
        [(name, k, cells[k]["rows"], cells[k]["best"], abs(s - cells[k]["best"]) < 0.015) for k, s in enumerate(found)],
        "name string, fold int, rows bigint, best double, near_best boolean")


@query("cv_logistic", SQL_NOISY_FOLDS.format(name="linear"))
def cv_logistic(spark, folder):
    return _noisy_folds(spark, folder, "linear", lambda data, folds: L.cross_validate(lambda k: L.fold_score(
        "linear", "classification", L.DEFAULTS["linear"], data, "seen", FEATURES, k, "accuracy", LABELS, key=LINE_KEY), folds))


@query("cv_trees", SQL_NOISY_FOLDS.format(name="boosted"))
def cv_trees(spark, folder):
    return _boosted_folds(spark, folder, "boosted", {"learning_rate": 0.5, "max_depth": 4})


@query("cv_leafwise", SQL_NOISY_FOLDS.format(name="leafwise"))
def cv_leafwise(spark, folder):
    return _boosted_folds(spark, folder, "leafwise", {"learning_rate": 0.5, "max_leaves": 12})


@query("cv_coded_trees", SQL_NOISY_FOLDS.format(name="boosted_codes"))
def cv_coded_trees(spark, folder):
    """The same with numbers as categories: each discount and tax is known by its rows' classes alone."""
    return _boosted_folds(spark, folder, "boosted_codes", {"learning_rate": 0.5, "max_depth": 4}, ["l_quantity", "l_discount_text", "l_tax_text"])


TREE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
TREE_LEAVES = 6


def _sql_first_tree() -> str:
    """Best-first growth in SQL: at every step all cuts of all leaves are weighed, and the best of all is taken."""
    parts = [f"d AS (SELECT *, row_number() OVER (ORDER BY {', '.join(LINE_KEY)}) AS id, avg(total) OVER () - total AS g FROM ({SQL_LINE_TOTAL}))",
             "a0 AS (SELECT id, 0 AS leaf FROM d)",
             "v AS (SELECT id, g, unnest([" + ", ".join(f"{{'f': '{c}', 'v': {c}::DOUBLE}}" for c in TREE_FEATURES) + "], recursive := true) FROM d)"]
    for s in range(TREE_LEAVES - 1):
        parts += [
            f"c{s} AS (SELECT leaf, f, v, sum(g) AS g, count(*) AS n FROM v JOIN a{s} USING (id) GROUP BY ALL)",
            f"""w{s} AS (SELECT *, sum(g) OVER l AS gl, sum(n) OVER l AS nl, sum(g) OVER p AS gt, sum(n) OVER p AS nt FROM c{s}
                 WINDOW p AS (PARTITION BY leaf, f), l AS (PARTITION BY leaf, f ORDER BY v))""",
            f"""s{s} AS (SELECT leaf, f, v, gl ** 2 / (nl + 1) + (gt - gl) ** 2 / (nt - nl + 1) - gt ** 2 / (nt + 1) AS gain FROM w{s}
                 WHERE nl < nt ORDER BY gain DESC LIMIT 1)""",
            f"""a{s + 1} AS (SELECT a.id, CASE WHEN a.leaf = s.leaf AND v.v > s.v THEN {s + 1} ELSE a.leaf END AS leaf
                 FROM a{s} a, s{s} s JOIN v ON v.id = a.id AND v.f = s.f)"""]
    rows = " UNION ALL ".join(f"SELECT f, v, gain FROM s{s}" for s in range(TREE_LEAVES - 1))
    return f"""WITH {', '.join(parts)}
SELECT f AS feature, v AS threshold, round(gain / (SELECT sum(g * g) FROM d), 7) AS share FROM ({rows})"""


@query("first_tree", _sql_first_tree())
def first_tree(spark, folder):
    """The splits of the first tree of best-first growth, with the part of all variation that each one explains."""
    lines = line_total(spark, folder)
    rows = lines.select(F.lit(0).alias("model"), F.xxhash64(*LINE_KEY).alias("id"), boosting.features_array(TREE_FEATURES).alias("x"),
                        F.col("total").alias("y"), F.lit(1.0).alias("w"), F.lit(False).alias("held"))
    fitted = boosting.boost(rows, len(TREE_FEATURES), boosting.Settings(leaves=TREE_LEAVES, depth=TREE_LEAVES, learning_rate=1.0), 1)[0]
    whole = lines.agg(F.var_pop("total") * F.count("*")).first()[0]
    tree = fitted.trees[0]
    return spark.createDataFrame(
        [(TREE_FEATURES[f], fitted.threshold(f, c), round(g / whole, 7)) for f, c, g in zip(tree.feature, tree.cut, tree.gain) if f >= 0],
        "feature string, threshold double, share double")


BOOST_RATE, BOOST_TREES = 0.2, 15


# With a leaf per value and no penalty, every tree closes the same share of the distance to a value's mean.
@query("boosted_means", f"""
WITH m AS (SELECT avg(total) AS mu FROM ({SQL_LINE_TOTAL}))
SELECT l_quantity, count(*)::BIGINT AS rows, round(mu + (avg(total) - mu) * (1 - (1 - {BOOST_RATE}) ** {BOOST_TREES}), 6) AS prediction
FROM ({SQL_LINE_TOTAL}), m GROUP BY l_quantity, mu""")
def boosted_means(spark, folder):
    """Fifteen trees over one feature, whose scores are written and gone on from several times."""
    lines = line_total(spark, folder)
    x = boosting.features_array(["l_quantity"]).alias("x")
    rows = lines.select(F.lit(0).alias("model"), F.xxhash64(*LINE_KEY).alias("id"), x, F.col("total").alias("y"),
                        F.lit(1.0).alias("w"), F.lit(False).alias("held"))
    settings = boosting.Settings(leaves=50, depth=50, learning_rate=BOOST_RATE, penalty=0.0)
    fitted = boosting.boost(rows, 1, settings, BOOST_TREES, trees_per_write=4)[0]
    levels = lines.groupBy("l_quantity").agg(F.count("*").alias("rows"))
    return levels.select("l_quantity", "rows", F.round(boosting.raw_scores(x, [fitted], spark)[0], 6).alias("prediction"))


@query("ordered_codes", f"""
WITH d AS (SELECT *, {sql_hash(53, LINE_KEY)} AS o FROM ({SQL_LINE_TOTAL})),
b AS (SELECT *, sum(total) OVER a AS sa, count(*) OVER a AS na, sum(total) OVER p AS sp, count(*) OVER p AS np FROM d
      WINDOW a AS (ORDER BY o, {', '.join(LINE_KEY)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             p AS (PARTITION BY l_returnflag ORDER BY o, {', '.join(LINE_KEY)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT {', '.join(LINE_KEY)}, l_returnflag, round((coalesce(sp, 0) + coalesce(sa / na, 0)) / (np + 1), 4) AS code FROM b""")
def ordered_target_codes(spark, folder):
    """Each row's flag as the mean total of the rows of that flag that stand before it."""
    lines = line_total(spark, folder).select(*LINE_KEY, "l_returnflag", "total")  # rows are written whole
    coded = ordered.ordered_codes(lines, ["l_returnflag"], ["total"], LINE_KEY)
    return coded.select(*LINE_KEY, "l_returnflag", F.round("l_returnflag__total", 4).alias("code"))


@query("cv_forest", SQL_FOLDS.format(name="forest", target="y", source=SQL_CLIENT))
def cv_forest(spark, folder):
    return _cv(_client(spark, folder), "y", CLIENT_FEATURES, ["plain", "rich"], ["c_custkey"], "forest")


@query("cv_kernel", SQL_NOISY_FOLDS.format(name="kernel"))
def cv_kernel(spark, folder):
    return _noisy_folds(spark, folder, "kernel", lambda data, folds: L.cross_validate(lambda k: L.fold_score(
        "kernel", "classification", L.DEFAULTS["kernel"], data, "seen", FEATURES[:3], k, "accuracy", LABELS, key=LINE_KEY), folds))


@query("boosted_tree_count", f"""
SELECT count(*)::BIGINT AS rows, true AS as_full_fit, true AS below_limit FROM ({SQL_NOISY})""")
def boosted_tree_count(spark, folder):
    """Growth that stops early keeps as many trees as the best moment of one that goes on further."""
    lines = _noisy(spark, folder)
    held = F.substring(row_hash(LINE_KEY, 67), 1, 1) < "2"
    rows = lines.select(F.lit(0).alias("model"), F.xxhash64(*LINE_KEY).alias("id"), boosting.features_array(TREE_FEATURES[:3]).alias("x"),
                        (F.col("seen") == "late").cast("double").alias("y"), F.lit(1.0).alias("w"), held.alias("held"))
    settings = boosting.Settings(logistic=True, depth=5, learning_rate=0.9)
    stopped = boosting.boost(rows, 3, settings, L.MAX_TREES, patience=3)[0]
    full = boosting.boost(rows, 3, settings, len(stopped.losses) + 3, patience=L.MAX_TREES)[0]
    return lines.agg(F.count("*").alias("rows")).withColumns(
        {"as_full_fit": F.lit(len(stopped.trees) == len(full.trees) or min(full.losses) == min(full.losses[len(stopped.trees) + 3:])),
         "below_limit": F.lit(0 < len(stopped.trees) < L.MAX_TREES)})


@query("feature_importance", """
SELECT 'c_nationkey' AS least, 0.0::DOUBLE AS missing_share""")
def feature_importance(spark, folder):
    """The nation has no part in the class, so it must come last; the shares sum to one."""
    fitted = L.fit("forest", "classification", L.DEFAULTS["forest"], _client(spark, folder), "y", ["c_acctbal", "c_nationkey"],
                   ["plain", "rich"], key=["c_custkey"])
    return L.importances(fitted).agg(F.min_by("feature", "importance").alias("least"), F.abs(F.round(1 - F.sum("importance"), 3)).alias("missing_share"))


def _event_bundle(spark, folder):
    events = table(spark, folder, "events").drop("props")
    spec = C.CleaningSpec(missing_codes={"event_type": ["error"]}, categorical=["user_id"],
                          date_parts={"ts": ["day_of_week", "hour"]},
                          new_columns=[C.NewColumn("twice", "value * 2")])
    target = events.withColumn("large", F.when(F.col("value") > 10, "yes").otherwise("no"))
    done = engineer(target, "large", spec, ["event_id"])
    fitted = L.fit("linear", "classification", L.DEFAULTS["linear"], done.table, "large", done.model_columns, ["no", "yes"])
    return events, scoring.Bundle(fitted, done.spec, scoring.inputs_of(events, done.input_columns))


@query("batch_score", """
SELECT event_type, count(*) AS rows, count(*) AS labelled, count(*) AS sums_to_one, count(*) AS right_way FROM events GROUP BY 1""")
def batch_score(spark, folder):
    """Every event gets a label of the target, two probabilities that sum to one, and the likelier label."""
    scored = scoring.score(*_event_bundle(spark, folder))
    yes, no = F.col("probability_yes"), F.col("probability_no")
    return scored.groupBy("event_type").agg(
        F.count("*").alias("rows"), F.count_if(F.col("prediction").isin("yes", "no")).alias("labelled"),
        F.count_if(F.abs(yes + no - 1) < 1e-6).alias("sums_to_one"), F.count_if((F.col("prediction") == "yes") == (yes >= no)).alias("right_way"))


@query("saved_bundle", "SELECT count(*) AS rows, count(*) AS alike FROM events")
def saved_bundle(spark, folder):
    """A bundle that was saved and read again scores both input shapes as before: raw tables and typed records."""
    events, bundle = _event_bundle(spark, folder)
    path = f"{shared_folder(spark).rstrip('/')}/bundle-{uuid.uuid4().hex}"
    bundle.save(path)
    again = scoring.Bundle.load(path)
    first = scoring.score(events, bundle).select("event_id", F.col("probability_yes").alias("p"))
    text = events.select(*[F.col(c).cast("string").alias(c) for c, _ in again.inputs], F.col("event_id"))
    typed = scoring.from_records(text.drop("event_id").distinct(), again)
    second = scoring.score(events, again).select("event_id", F.col("probability_yes").alias("r"))
    both = first.join(second, "event_id")
    if scoring.score(typed, again).filter("prediction IS NULL").limit(1).count():
        raise ValueError("a record has no prediction")
    return both.agg(F.count("*").alias("rows"), F.count_if(F.abs(F.col("p") - F.col("r")) < 1e-12).alias("alike"))


TUNING_BUDGET = 20  # whole cross-validations


# How many settings a search draws and where it gives them up is its own affair; the rows of a fold say by which rule.
@query("tuning_log", f"""
WITH f AS ({SQL_FOLDS.format(name="linear", target="y", source=SQL_CLIENT)}),
r AS (SELECT count(*)::INT AS folds, CASE WHEN min(rows) >= 10000 THEN 'halving' ELSE 'median' END AS rule FROM f)
SELECT trial, origin, folds, rule, true AS enough, true AS as_ruled FROM r, (VALUES (0, 'default'), (1, 'listed'), (4, 'searched')) t(trial, origin)""")
def tuning_log(spark, folder):
    """A whole search over all clients: the default cross-validated, the listed settings, then draws and guided settings until the budget or the patience is used up.

    One row per step of the log, from its first trial on: whether it has as many trials as it must, and whether all ended as the rules say.
    """
    clients, listed = _client(spark, folder), len(tuning.STARTS["linear"])
    data = spread(S.with_folds(clients, "y", ["c_custkey"], folds=5), clients.count(), FOLDED_ROWS).cache()
    try:
        rows_of = [r["count"] for r in data.groupBy("fold").count().collect()]
        with L.FoldScores("linear", "classification", data, "y", CLIENT_FEATURES, 5, "accuracy", ["plain", "rich"], key=["c_custkey"]) as score:
            default = L.cross_validate(lambda k: score(L.DEFAULTS["linear"], k), 5, 4)
            start = statistics.fmean(default)
            found = tuning.search("linear", score, 5, min(rows_of), L.DEFAULTS["linear"], start, budget=TUNING_BUDGET, seconds=3_600,
                                  min_gain=tuning.noise(default), parallelism=4, guided_after=listed)
    finally:
        data.unpersist()
    rule = tuning.rule_of(min(rows_of))
    log = found.table(spark).orderBy("trial").collect()
    whole = [t.score for t in found.trials if t.score is not None]
    ended = found.idle >= tuning.PATIENCE * 5 or found.promised >= TUNING_BUDGET * 5
    steps = [(0, "default", log[0]["origin"] == "default", log[0]["score"] == round(start, 4) and found.score == max([start, *whole]))]
    for first, origin, trials, least in ((1, "listed", found.trials[:listed], listed), (listed + 1, "searched", found.trials[listed:], tuning.PATIENCE)):
        named = all((t.origin == "listed") == (origin == "listed") for t in trials)
        steps.append((first, origin, named and len(trials) >= least and (origin == "listed" or ended), all(tuning.ended_by(t, 5, rule) for t in trials)))
    return spark.createDataFrame([(first, origin, 5, rule.__name__, enough, as_ruled) for first, origin, enough, as_ruled in steps],
                                 "trial int, origin string, folds int, rule string, enough boolean, as_ruled boolean")


@query("model_sweep", """
SELECT name, 'ok' AS status, true AS scored FROM (VALUES ('linear'), ('neighbours'), ('forest')) t(name)""")
def model_sweep(spark, folder):
    """The candidates of a sweep over an unbalanced target: class weights and macro F1."""
    rows = labelled_documents(spark, folder).select("doc_id", "toxic", "lang", "n_chars", "quality")
    found = sweep(rows, "quality", "classification", ["linear", "neighbours", "forest"], ["doc_id"])
    return found.candidates.select("name", "status", F.col("cv_mean").between(0, 1).alias("scored"))


TASKS = [("auto", "o_orderkey"), ("regression", "o_orderstatus"), ("regression", "o_totalprice"), ("classification", "o_orderkey"),
         ("classification", "o_orderpriority"), ("guess", "o_custkey"), ("auto", "nothing")]


@query("task_checks", """
WITH s AS (SELECT count(DISTINCT o_orderkey) AS keys, count(DISTINCT o_orderpriority) AS levels FROM orders)
SELECT task, target, CASE WHEN target = 'nothing' OR task = 'guess' OR (task = 'regression' AND target = 'o_orderstatus') THEN false
  WHEN task = 'classification' THEN CASE target WHEN 'o_orderkey' THEN keys ELSE levels END <= 100 ELSE true END AS accepted
FROM s, (VALUES ('auto', 'o_orderkey'), ('regression', 'o_orderstatus'), ('regression', 'o_totalprice'), ('classification', 'o_orderkey'),
  ('classification', 'o_orderpriority'), ('guess', 'o_custkey'), ('auto', 'nothing')) t(task, target)""")
def task_checks(spark, folder):
    orders = table(spark, folder, "orders")
    return spark.createDataFrame([(t, c, task.task_problem(orders, t, c) is None) for t, c in TASKS],
                                 "task string, target string, accepted boolean")
