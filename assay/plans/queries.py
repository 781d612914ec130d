"""The registered queries of the audit engine, with SQL that computes the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.arrays import unit_hash
from assay.operators import crosscheck, folds, labels, metrics, model, neighbors, noise, preparation, review, scoring
from assay.plans import audit as audits
from assay.plans import benchmark, provenance

SEED, FOLDS, NEIGHBORS = 42, 5, 5
CLASSES = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Encoded rows of embeddings, and their classes."""
    df = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "source_index")
    names = labels.class_names(df, "label")
    return labels.encode(df, "label", names), names


def with_proba(df: DataFrame) -> DataFrame:
    """Probabilities made of the first elements of the vector, for the queries on scores: the same arithmetic in every
    engine, which a fitted model has not. audit_matrix and audit_text score probabilities of a model."""
    parts = [F.get("embedding", F.lit(j)).cast("double") + 1.0 for j in range(CLASSES)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.withColumn("proba", F.array(*[p / total for p in parts]))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# --- classes, kinds, preparation -------------------------------------------------------------------------------


def class_dimension(spark, sf_dir):
    return labels.class_dimension(table(spark, sf_dir, "embeddings"), "label")


def class_counts_minority(spark, sf_dir):
    return labels.class_counts(table(spark, sf_dir, "embeddings"), "label")


def _kinds(spark, sf_dir, name):
    kinds = preparation.infer_kinds(table(spark, sf_dir, name))
    return spark.createDataFrame(list(kinds.items()), "column_name string, kind string")


def infer_kinds_documents(spark, sf_dir):
    return _kinds(spark, sf_dir, "documents")


def infer_kinds_customer(spark, sf_dir):
    return _kinds(spark, sf_dir, "customer")


def prepare_customer(spark, sf_dir):
    kinds = {"numeric": ["c_acctbal", "c_nationkey"], "categorical": ["c_mktsegment"], "text": ["c_name"]}
    return preparation.prepare(table(spark, sf_dir, "customer"), kinds, ["c_custkey"])


def prepare_documents(spark, sf_dir):
    df = preparation.prepare(table(spark, sf_dir, "documents"), {"numeric": ["n_chars"], "categorical": ["lang"], "text": ["text"]}, ["doc_id"])
    return df.select("doc_id", "n_chars", "lang", F.md5("text").alias("text_md5"))


# --- folds and neighbours --------------------------------------------------------------------------------------


def _folds(spark, sf_dir):
    df, names = vectors(spark, sf_dir)
    return folds.stratified_folds(df, folds.fold_count(df, FOLDS), SEED), names


def stratified_folds(spark, sf_dir):
    return _folds(spark, sf_dir)[0].select("source_index", "given_label", "oof_fold")


def _customer_folds(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "source_index")
    df = labels.encode(df, "c_mktsegment", labels.class_names(df, "c_mktsegment"))
    return folds.stratified_folds(df, FOLDS, SEED)


def fold_standardize(spark, sf_dir):
    """The statistics by which the preprocessor of tables fills and scales a number, from the training rows of each fold."""
    df, numbers = _customer_folds(spark, sf_dir), list(range(1, FOLDS + 1))
    sizes = {r["oof_fold"]: r["count"] for r in df.groupBy("oof_fold").count().collect()}
    found = zip(numbers, model.fold_numeric_statistics(df, ["c_acctbal"], numbers))
    stats = [(f, *x[1:], sum(sizes.values()) - sizes[f]) for f, (x,) in found]
    return rounded(spark.createDataFrame(stats, "fold int, median double, mean double, deviation double, n long"))


def standardized_fold(spark, sf_dir):
    """Every row's number, scaled by the preprocessor that was fitted without the row's fold."""
    z = F.element_at(model.vector_to_array("z"), 1)
    return rounded(_held_out(spark, sf_dir, {"numeric": ["c_acctbal"], "categorical": [], "text": []}, z.alias("z")))


def _held_out(spark, sf_dir, kinds, *columns):
    df, numbers = _customer_folds(spark, sf_dir), list(range(1, FOLDS + 1))
    transforms = zip(numbers, model.table_preprocessor(kinds).folds(df, numbers))
    return functools.reduce(DataFrame.unionByName, [t(df.where(F.col("oof_fold") == f)).select("source_index", "oof_fold", *columns) for f, t in transforms])


def one_hot_fold(spark, sf_dir):
    """The slot of each held-out row's category in the preprocessor of its fold; -1 for a category it has not seen."""
    slot = F.array_position(model.vector_to_array("z"), 1.0) - 1
    return _held_out(spark, sf_dir, {"numeric": [], "categorical": ["given_label"], "text": []}, slot.cast("int").alias("slot"))


def tfidf_terms(spark, sf_dir):
    return model.vocabulary(table(spark, sf_dir, "documents"), "text")


def tfidf_terms_all(spark, sf_dir):
    """tfidf_terms under the name that it had while that counted labelled documents only."""
    return tfidf_terms(spark, sf_dir)


def tfidf_weights(spark, sf_dir):
    """What the preprocessor makes of every document: how many terms weigh, their sum, and the largest weight."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = model.table_preprocessor({"numeric": [], "categorical": [], "text": ["text"]})(docs)(docs)
    return rounded(rows.select("doc_id", model.positive("z").alias("facts")).select("doc_id", "facts.*"))


def _near(spark, sf_dir):
    df, names = _folds(spark, sf_dir)
    x = df.select("source_index", "oof_fold", "given_label", F.col("embedding").cast("array<double>").alias("x"))
    return df, names, neighbors.nearest(x, NEIGHBORS)


def knn_neighbors(spark, sf_dir):
    near = _near(spark, sf_dir)[2]
    return near.select("source_index", F.array_join(F.col("neighbor_indices").cast("array<string>"), ",").alias("neighbors"), F.array_join("neighbor_labels", ",").alias("labels"))


def knn_disagreement(spark, sf_dir):
    df, _, near = _near(spark, sf_dir)
    joined = df.join(near, "source_index")
    return rounded(joined.select("source_index", scoring.knn_disagreement(F.col("neighbor_labels"), F.col("given_label")).alias("knn_score")))


# --- scores ----------------------------------------------------------------------------------------------------


def _scored(spark, sf_dir):
    df, names = vectors(spark, sf_dir)
    return scoring.score(with_proba(df), names), names


def score_rows(spark, sf_dir):
    rows = _scored(spark, sf_dir)[0].rows
    return rounded(rows.select("source_index", "self_confidence", "normalized_margin", "confident_pred", "predicted", "confidence", "off_diagonal", "cl_score"))


def class_thresholds(spark, sf_dir):
    return rounded(_scored(spark, sf_dir)[0].class_stats)


def confident_joint(spark, sf_dir):
    return _scored(spark, sf_dir)[0].joint


def calibrated_joint(spark, sf_dir):
    df, names = vectors(spark, sf_dir)
    label = F.array(*map(F.lit, names))
    cells = crosscheck.calibrated_joint(with_proba(df), names)
    return cells.select(F.element_at(label, F.col("y") + 1).alias("given_label"), F.element_at(label, F.col("other") + 1).alias("other_label"), "confident", "n")


def cross_check(spark, sf_dir):
    """The rows that the cross-check flags, with the class that it suggests."""
    df, names = vectors(spark, sf_dir)
    return rounded(crosscheck.label_issues(with_proba(df), names))


def _ensemble(spark, sf_dir):
    df, names, near = _near(spark, sf_dir)
    scored = scoring.score(with_proba(df), names)
    rows = scoring.with_ensemble(scored.rows.join(near, "source_index"), names)
    # scores are rounded before they are ranked, so that the last bits of a sum don't decide
    rows = rows.withColumns({"ensemble_score": F.round("ensemble_score", 6), "cl_score": F.round("cl_score", 6)})
    ranked = scoring.ranked(rows.withColumn("row_id", F.concat(F.lit("row-"), "source_index")))
    return ranked.withColumn("rank", F.col("rank").cast("int")), names


def ensemble_rank(spark, sf_dir):
    return _ensemble(spark, sf_dir)[0].select("rank", "source_index", "ensemble_score", "cl_score", "status")


def audit_summary(spark, sf_dir):
    rows, names = _ensemble(spark, sf_dir)
    return rounded(scoring.audit_summary(rows, len(names)))


# --- noise and metrics -----------------------------------------------------------------------------------------


def _noise(spark, sf_dir, kind):
    df = table(spark, sf_dir, "events").withColumnRenamed("event_id", "source_index")
    names = labels.class_names(df, "event_type")
    noisy = noise.inject_noise(labels.encode(df, "event_type", names), names, 0.1, kind, SEED)
    return noisy.select("source_index", "given_label", "noisy_label", "was_flipped")


def noise_uniform(spark, sf_dir):
    return _noise(spark, sf_dir, "uniform")


def noise_class_conditional(spark, sf_dir):
    return _noise(spark, sf_dir, "class_conditional")


def _truth(spark, sf_dir):
    """Events with a coarse score (so that there are ties) and whether they were flipped."""
    noisy = noise_class_conditional(spark, sf_dir)
    score = F.floor(unit_hash(7, F.col("source_index")) * 200 + F.col("was_flipped").cast("int") * 60).cast("double")
    return noisy.select("source_index", score.alias("score"), F.col("was_flipped").alias("truth"), F.col("noisy_label").alias("label"))


def precision_recall_at_k(spark, sf_dir):
    return rounded(metrics.precision_recall_at_k(_truth(spark, sf_dir), 100))


def auroc(spark, sf_dir):
    return rounded(metrics.auroc(_truth(spark, sf_dir)))


def ranking_report(spark, sf_dir):
    return rounded(metrics.ranking_report(_truth(spark, sf_dir)))


def review_budget(spark, sf_dir):
    df = metrics.review_budget(_truth(spark, sf_dir))
    return rounded(df.select("*", F.element_at("interval", 1).alias("low"), F.element_at("interval", 2).alias("high")).drop("interval"))


def review_by_class(spark, sf_dir):
    return rounded(metrics.review_by_class(_truth(spark, sf_dir)))


# --- review and export -----------------------------------------------------------------------------------------


def review_filter(spark, sf_dir):
    return review.filter_findings(_ensemble(spark, sf_dir)[0], given_label="3", status="Check", query=" ROW-1 ").select("rank", "source_index")


def review_page(spark, sf_dir):
    return review.page(_ensemble(spark, sf_dir)[0], 3).select("rank", "source_index")


def review_topk(spark, sf_dir):
    return review.top(_ensemble(spark, sf_dir)[0], 5).select("rank", "source_index")


def _decided(spark, sf_dir):
    df = vectors(spark, sf_dir)[0].select("source_index", "given_label")
    i = F.col("source_index")
    action = F.when(i % 10 == 0, "drop").when(i % 7 == 0, "relabel").when(i % 4 == 0, "keep")
    decisions = df.select("source_index", action.alias("action"), F.when(action == "relabel", F.lit(" 3 ")).alias("new_label")).where("action is not null")
    review.check_decisions(decisions)
    return review.decided(df, decisions)


def export_cleaned(spark, sf_dir):
    return review.cleaned(_decided(spark, sf_dir), "given_label")


def export_log(spark, sf_dir):
    return review.audit_log(_decided(spark, sf_dir), "given_label")


def export_counts(spark, sf_dir):
    return review.export_counts(_decided(spark, sf_dir))


def content_hash(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return provenance.content_hash(df, "c_custkey")


# --- whole audits ----------------------------------------------------------------------------------------------


def _findings(found: audits.Audit) -> DataFrame:
    return rounded(found.findings.drop("image_path", "oof_probabilities"))


def audit_matrix(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "source_index")
    return _findings(audits.audit_matrix(df, "label", "embedding"))


def audit_table(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "source_index")
    return _findings(audits.audit_table(df, "c_mktsegment", ["c_acctbal", "c_nationkey"]))


def audit_text(spark, sf_dir):
    df = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "source_index")
    return _findings(audits.audit_table(df, "lang", ["text"]))


def benchmark_lang(spark, sf_dir):
    """Detection of flipped languages: one run of the benchmark."""
    df = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "source_index").select("source_index", "text", "lang")
    r = benchmark.run_one(df, "lang", "table", "uniform", 0.10, SEED, ["text"])
    keys = ("n", "n_noisy", "k", "precision_at_k", "recall_at_k", "auroc")
    return spark.createDataFrame([tuple(r[k] for k in keys)], "n long, n_noisy long, k long, precision_at_k double, recall_at_k double, auroc double")


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    class_dimension, class_counts_minority, infer_kinds_documents, infer_kinds_customer, prepare_customer, prepare_documents,
    stratified_folds, fold_standardize, standardized_fold, one_hot_fold, tfidf_terms, tfidf_terms_all, tfidf_weights, knn_neighbors, knn_disagreement, score_rows, class_thresholds,
    confident_joint, calibrated_joint, cross_check, ensemble_rank, audit_summary, noise_uniform, noise_class_conditional, precision_recall_at_k, auroc, ranking_report,
    review_budget, review_by_class, review_filter, review_page, review_topk, export_cleaned, export_log, export_counts, content_hash,
    audit_matrix, audit_table, audit_text, benchmark_lang,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


# --- SQL -------------------------------------------------------------------------------------------------------

_E = "SELECT vec_id AS source_index, CAST(label AS VARCHAR) AS given_label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"
_SUM = " + ".join(f"(x[{j}] + 1.0)" for j in range(1, CLASSES + 1))
_PROBA = "[" + ", ".join(f"(x[{j}] + 1.0) / ({_SUM})" for j in range(1, CLASSES + 1)) + "]"


def _folds_sql(source: str) -> str:
    return f"""
    src AS ({source}),
    cls AS (SELECT given_label, CAST(row_number() OVER (ORDER BY given_label) - 1 AS INTEGER) AS y FROM (SELECT DISTINCT given_label FROM src)),
    enc AS (SELECT src.*, y FROM src JOIN cls USING (given_label)),
    per AS (SELECT y, min(source_index) AS f, count(*) AS n FROM enc GROUP BY y),
    st AS (SELECT y, coalesce(sum(n) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM per),
    od AS (SELECT enc.*, row_number() OVER (PARTITION BY y ORDER BY md5('{SEED}:' || source_index), source_index) - 1 AS o FROM enc),
    fold AS (SELECT od.*, CAST((s + o) % {FOLDS} + 1 AS INTEGER) AS oof_fold FROM od JOIN st USING (y))"""


_F = _folds_sql(_E)
_FC = _folds_sql("SELECT c_custkey AS source_index, c_mktsegment AS given_label, c_acctbal FROM customer")
_N = f"""{_F},
    pr AS (SELECT h.source_index, h.given_label, t.source_index AS ni, t.given_label AS nl,
             row_number() OVER (PARTITION BY h.source_index ORDER BY list_distance(h.x, t.x), t.source_index) AS r
           FROM fold h JOIN fold t ON h.oof_fold <> t.oof_fold),
    nn AS (SELECT source_index, string_agg(CAST(ni AS VARCHAR), ',' ORDER BY r) AS neighbors, string_agg(nl, ',' ORDER BY r) AS labels,
             sum(CASE WHEN nl <> given_label THEN 1 ELSE 0 END) / {NEIGHBORS}.0 AS knn FROM pr WHERE r <= {NEIGHBORS} GROUP BY source_index)"""
_S = """
    pb AS (SELECT source_index, given_label, y, """ + _PROBA + """ AS p FROM fold),
    th AS (SELECT y, avg(p[y + 1]) AS t FROM pb GROUP BY y),
    tv AS (SELECT list(t ORDER BY y) AS ts FROM th),
    sc AS (SELECT pb.*, ts, p[y + 1] AS sc, list_max(list_filter(p, lambda v, i: i <> y + 1)) AS alt,
             [CASE WHEN p[i] >= ts[i] THEN p[i] ELSE -1.0 END FOR i IN range(1, 11)] AS m FROM pb, tv),
    s2 AS (SELECT *, sc - alt AS margin, CAST(CASE WHEN list_max(m) >= 0 THEN list_position(m, list_max(m)) ELSE list_position(p, list_max(p)) END - 1 AS INTEGER) AS cp,
             CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred FROM sc),
    s3 AS (SELECT *, cp <> y AS off, 0.45 * (1 - sc) + 0.40 * (1 - margin) / 2 + 0.15 * CAST(cp <> y AS INTEGER) AS cl FROM s2)"""
# the most probable class among those that reach their threshold; counts scaled to the rows of a label by largest remainders
_X = """
    cf AS (SELECT y, CASE WHEN list_max(m) >= 0 THEN list_position(m, list_max(m)) - 1 END AS o FROM sc),
    cj AS (SELECT y, o, count(*) AS c FROM cf GROUP BY y, o),
    ct AS (SELECT y, sum(c) AS size, coalesce(sum(c) FILTER (o IS NOT NULL), 0) AS sure FROM cj GROUP BY y),
    cg AS (SELECT a.y, b.y AS other, a.given_label, b.given_label AS other_label, coalesce(c, 0) AS c, size, sure FROM cls a CROSS JOIN cls b JOIN ct ON ct.y = a.y LEFT JOIN cj ON cj.y = a.y AND cj.o = b.y),
    cw AS (SELECT *, c * size // sure AS whole, c * size % sure AS rest FROM cg),
    cx AS (SELECT *, CASE WHEN sure = 0 THEN CASE WHEN y = other THEN size ELSE 0 END
             ELSE whole + CAST(row_number() OVER (PARTITION BY y ORDER BY rest DESC, other) <= size - sum(whole) OVER (PARTITION BY y) AS INTEGER) END AS n FROM cw)"""
_R = f"""WITH {_N}, {_S},
    s4 AS (SELECT s3.*, knn, round(0.70 * cl + 0.30 * knn, 6) AS ens, round(cl, 6) AS cl6,
             CASE WHEN pred <> y OR (sc < ts[y + 1] AND knn >= 0.5) THEN 'Check' ELSE 'Clean' END AS status FROM s3 JOIN nn USING (source_index)),
    rk AS (SELECT *, row_number() OVER (ORDER BY ens DESC, cl6 DESC, source_index) AS rank FROM s4)"""


def _unit(seed: str, salt: str = "") -> str:
    return f"(CAST('0x' || substr(md5('{seed}:' || source_index{f" || ':{salt}'" if salt else ''}), 1, 8) AS BIGINT) / 4294967296.0)"


def _noise_sql(other: str) -> str:
    return f"""
    ev AS (SELECT event_id AS source_index, event_type AS given_label FROM events),
    nm AS (SELECT list(given_label ORDER BY given_label) AS names FROM (SELECT DISTINCT given_label FROM ev)),
    ns AS (SELECT source_index, given_label, {_unit(str(SEED))} < 0.1 AS was_flipped, {other} AS other FROM ev, nm),
    noisy AS (SELECT source_index, given_label, CASE WHEN was_flipped THEN other ELSE given_label END AS noisy_label, was_flipped FROM ns)"""


_CYCLE = _noise_sql("names[list_position(names, given_label) % len(names) + 1]")
_UNIFORM = _noise_sql(f"list_filter(names, lambda v: v <> given_label)[CAST(floor({_unit(str(SEED), 'to')} * (len(names) - 1)) AS BIGINT) + 1]")
_T = f"""WITH {_CYCLE},
    tr AS (SELECT source_index, floor({_unit('7')} * 200 + CAST(was_flipped AS INTEGER) * 60) AS score, was_flipped AS truth, noisy_label AS label FROM noisy),
    pl AS (SELECT *, row_number() OVER (ORDER BY score DESC, source_index) AS place, count(*) OVER () AS n, sum(CAST(truth AS BIGINT)) OVER () AS p FROM tr)"""
_AUROC = "(SELECT (sum(mid * t) - max(p) * (max(p) + 1) / 2.0) / (max(p) * (max(n) - max(p))) FROM (SELECT CAST(truth AS INTEGER) AS t, p, n, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid FROM pl))"
_B = _T + ", rv AS (SELECT *, place <= least(greatest(CAST(round_even(0.05 * n, 0) AS BIGINT), 1), n) AS reviewed FROM pl)"
_COUNTS = """count(*) AS n_rows, CAST(sum(CAST(reviewed AS BIGINT)) AS BIGINT) AS n_reviewed, CAST(sum(CAST(truth AS BIGINT)) AS BIGINT) AS n_injected_noise,
    CAST(sum(CAST(truth AND reviewed AS BIGINT)) AS BIGINT) AS true_positives, CAST(sum(CAST(reviewed AND NOT truth AS BIGINT)) AS BIGINT) AS false_positives"""
_PR = "round(CASE WHEN n_reviewed > 0 THEN true_positives / n_reviewed ELSE 0.0 END, 6) AS precision, round(CASE WHEN n_injected_noise > 0 THEN true_positives / n_injected_noise ELSE 0.0 END, 6) AS recall"
_D = f"""WITH src AS ({_E}), dc AS (SELECT source_index, given_label, CASE WHEN source_index % 10 = 0 THEN 'drop' WHEN source_index % 7 = 0 THEN 'relabel' ELSE 'keep' END AS action FROM src)"""


_TERMS = f"""d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM documents),
    t AS (SELECT doc_id, unnest(w) AS term FROM d UNION ALL SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM d),
    tc AS (SELECT term, doc_id, count(*) AS c FROM t GROUP BY ALL),
    voc AS (SELECT term, CAST(sum(c) AS BIGINT) AS n, count(*) AS df FROM tc GROUP BY term ORDER BY n DESC, term LIMIT {model.TERMS})"""


def _kind_sql(name: str, columns: dict[str, bool]) -> str:
    parts = []
    for c, text in columns.items():
        if not text:
            parts.append(f"SELECT '{c}' AS column_name, 'numeric' AS kind")
            continue
        parts.append(
            f"SELECT '{c}' AS column_name, CASE WHEN d = 0 THEN 'categorical' WHEN l >= 25 OR (w >= 0.6 AND l >= 12) OR (d > greatest(40, floor(0.5 * n)) AND l >= 8) THEN 'text' ELSE 'categorical' END AS kind "
            f"FROM (SELECT count(*) AS n, count(DISTINCT {c}) AS d, avg(length({c})) AS l, avg(CAST(regexp_matches({c}, '\\s') AS INTEGER)) AS w FROM {name})"
        )
    return " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    return {
        "class_dimension": "SELECT CAST(row_number() OVER (ORDER BY class_name) - 1 AS INTEGER) AS class_index, class_name FROM (SELECT DISTINCT CAST(label AS VARCHAR) AS class_name FROM embeddings)",
        "class_counts_minority": "SELECT class_name, n, n = min(n) OVER () AS minority FROM (SELECT CAST(label AS VARCHAR) AS class_name, count(*) AS n FROM embeddings GROUP BY 1)",
        "infer_kinds_documents": _kind_sql("documents", {"doc_id": False, "text": True, "lang": True, "source": True, "n_chars": False}),
        "infer_kinds_customer": _kind_sql("customer", {"c_custkey": False, "c_name": True, "c_nationkey": False, "c_acctbal": False, "c_mktsegment": True}),
        "prepare_customer": "SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey, coalesce(c_mktsegment, '__missing__') AS c_mktsegment, coalesce(c_name, '') AS c_name FROM customer",
        "prepare_documents": "SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, coalesce(lang, '__missing__') AS lang, md5(coalesce(text, '')) AS text_md5 FROM documents",
        "stratified_folds": f"WITH {_F} SELECT source_index, given_label, oof_fold FROM fold",
        "fold_standardize": f"WITH {_FC} SELECT CAST(k AS INTEGER) AS fold, round(median(c_acctbal), 6) AS median, round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 6) AS deviation, count(*) AS n FROM fold, range(1, {FOLDS + 1}) r(k) WHERE k <> oof_fold GROUP BY k",
        "one_hot_fold": f"WITH {_FC}, lv AS (SELECT k, list(DISTINCT given_label ORDER BY given_label) AS levels FROM fold, range(1, {FOLDS + 1}) r(k) WHERE k <> oof_fold GROUP BY k) SELECT source_index, oof_fold, CAST(coalesce(list_position(levels, given_label), 0) - 1 AS INTEGER) AS slot FROM fold JOIN lv ON k = oof_fold",
        "standardized_fold": f"WITH {_FC}, st2 AS (SELECT CAST(k AS INTEGER) AS k, avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd FROM fold, range(1, {FOLDS + 1}) r(k) WHERE k <> oof_fold GROUP BY k) SELECT source_index, oof_fold, round((c_acctbal - m) / sd, 6) AS z FROM fold JOIN st2 ON k = oof_fold",
        "tfidf_terms": f"WITH {_TERMS} SELECT term, n, df FROM voc",
        "tfidf_terms_all": f"WITH {_TERMS} SELECT term, n, df FROM voc",
        "tfidf_weights": f"""WITH {_TERMS},
            wt AS (SELECT doc_id, c * (ln((1 + nd) / (1 + df)) + 1) AS x FROM tc JOIN voc USING (term), (SELECT count(*) AS nd FROM documents)),
            nm AS (SELECT doc_id, count(*) AS k, sum(x) AS s, max(x) AS m, sqrt(sum(x * x)) AS norm FROM wt GROUP BY doc_id)
            SELECT doc_id, coalesce(k, 0) AS n_terms, round(coalesce(s / norm, 0.0), 6) AS total, round(coalesce(m / norm, 0.0), 6) AS largest FROM documents LEFT JOIN nm USING (doc_id)""",
        "knn_neighbors": f"WITH {_N} SELECT source_index, neighbors, labels FROM nn",
        "knn_disagreement": f"WITH {_N} SELECT source_index, round(knn, 6) AS knn_score FROM nn",
        "score_rows": f"WITH {_F}, {_S} SELECT source_index, round(sc, 6) AS self_confidence, round(margin, 6) AS normalized_margin, cp AS confident_pred, pred AS predicted, round(list_max(p), 6) AS confidence, off AS off_diagonal, round(cl, 6) AS cl_score FROM s3",
        "class_thresholds": f"WITH {_F}, {_S} SELECT y AS class_index, given_label AS class_name, round(ts[y + 1], 6) AS threshold, round(avg(CAST(off AS DOUBLE)), 6) AS noise_rate, count(*) AS n_rows FROM s3 GROUP BY y, given_label, ts",
        "confident_joint": f"WITH {_F}, {_S} SELECT a.given_label, b.given_label AS confident_label, count(s3.y) AS n FROM cls a CROSS JOIN cls b LEFT JOIN s3 ON s3.y = a.y AND s3.cp = b.y GROUP BY 1, 2",
        "calibrated_joint": f"WITH {_F}, {_S}, {_X} SELECT given_label, other_label, CAST(c AS BIGINT) AS confident, CAST(n AS BIGINT) AS n FROM cx",
        "cross_check": f"""WITH {_F}, {_S}, {_X},
            mg AS (SELECT source_index, sc.y, other, other_label, sc AS own, p[other + 1] - p[sc.y + 1] AS margin, n, list_position(p, list_max(p)) - 1 AS pred FROM sc JOIN cx ON cx.y = sc.y AND cx.other <> cx.y AND n > 0),
            pk AS (SELECT * FROM mg QUALIFY row_number() OVER (PARTITION BY y, other ORDER BY margin DESC, source_index) <= n)
            SELECT source_index, other_label AS suggested_label, round(margin, 6) AS margin, round(own, 6) AS self_confidence FROM pk WHERE pred <> y
            QUALIFY row_number() OVER (PARTITION BY source_index ORDER BY margin DESC, other) = 1""",
        "ensemble_rank": f"{_R} SELECT CAST(rank AS INTEGER) AS rank, source_index, ens AS ensemble_score, cl6 AS cl_score, status FROM rk",
        "audit_summary": f"{_R} SELECT count(*) AS n_rows, CAST(10 AS INTEGER) AS n_classes, count(*) FILTER (status = 'Check') AS n_flagged, round(count(*) FILTER (status = 'Check') / count(*), 6) AS flag_rate FROM rk",
        "noise_uniform": f"WITH {_UNIFORM} SELECT * FROM noisy",
        "noise_class_conditional": f"WITH {_CYCLE} SELECT * FROM noisy",
        "precision_recall_at_k": f"{_T} SELECT least(100, max(n)) AS k, round(sum(CAST(truth AND place <= 100 AS INTEGER)) / least(100, max(n)), 6) AS precision, round(sum(CAST(truth AND place <= 100 AS INTEGER)) / max(p), 6) AS recall FROM pl",
        "auroc": f"{_T} SELECT round({_AUROC}, 6) AS auroc",
        "ranking_report": f"""{_T}, k AS (SELECT max(n) AS n, CAST(max(p) AS BIGINT) AS n_noisy, least(greatest(max(p), 1), max(n)) AS k, greatest(CAST(round_even(0.10 * max(n), 0) AS BIGINT), 1) AS kf FROM pl),
            h AS (SELECT sum(CAST(truth AND place <= k AS INTEGER)) AS hk, sum(CAST(truth AND place <= kf AS INTEGER)) AS hf FROM pl, k)
            SELECT n, n_noisy, round(n_noisy / n, 6) AS prevalence, CAST(k AS BIGINT) AS k, round(hk / k, 6) AS precision_at_k, round(hk / n_noisy, 6) AS recall_at_k, kf AS k_10pct, round(hf / kf, 6) AS precision_at_10pct, round(hf / n_noisy, 6) AS recall_at_10pct, round({_AUROC}, 6) AS auroc FROM k, h""",
        "review_budget": f"""{_B}, s AS (SELECT {_COUNTS} FROM rv), w AS (SELECT *, true_positives / n_reviewed AS q, n_reviewed AS m FROM s)
            SELECT n_rows, n_reviewed, n_injected_noise, true_positives, false_positives, {_PR},
              round(greatest(0.0, ((q + 1.96 * 1.96 / (2 * m)) - 1.96 * sqrt((q * (1 - q) + 1.96 * 1.96 / (4 * m)) / m)) / (1 + 1.96 * 1.96 / m)), 6) AS low,
              round(least(1.0, ((q + 1.96 * 1.96 / (2 * m)) + 1.96 * sqrt((q * (1 - q) + 1.96 * 1.96 / (4 * m)) / m)) / (1 + 1.96 * 1.96 / m)), 6) AS high FROM w""",
        "review_by_class": f"{_B}, s AS (SELECT label, {_COUNTS} FROM rv GROUP BY label) SELECT s.*, {_PR} FROM s",
        "review_filter": f"{_R} SELECT CAST(rank AS INTEGER) AS rank, source_index FROM rk WHERE given_label = '3' AND status = 'Check' AND contains(lower('row-' || source_index), 'row-1')",
        "review_page": f"{_R} SELECT CAST(rank AS INTEGER) AS rank, source_index FROM rk WHERE rank BETWEEN 25 AND 32",
        "review_topk": f"{_R} SELECT CAST(rank AS INTEGER) AS rank, source_index FROM rk WHERE rank <= 5",
        "export_cleaned": f"{_D} SELECT source_index, CASE action WHEN 'relabel' THEN '3' ELSE given_label END AS given_label FROM dc WHERE action <> 'drop'",
        "export_log": f"{_D} SELECT source_index, given_label AS original_label, action, CASE action WHEN 'relabel' THEN '3' WHEN 'keep' THEN given_label END AS exported_label FROM dc",
        "export_counts": f"{_D} SELECT count(*) AS n_in, count(*) FILTER (action <> 'drop') AS n_out, count(*) FILTER (action = 'drop') AS n_dropped, count(*) FILTER (action = 'relabel') AS n_relabeled, count(*) FILTER (action = 'keep') AS n_kept FROM dc",
        "content_hash": """WITH r AS (SELECT c_custkey AS o, sha256(concat_ws(chr(31), coalesce('v' || c_name, 'n'), coalesce('v' || c_nationkey, 'n'), coalesce('v' || c_mktsegment, 'n'))) AS h FROM customer),
            g AS (SELECT o // 1000 AS o, sha256(string_agg(h, chr(10) ORDER BY o, h)) AS h FROM r GROUP BY 1),
            t AS (SELECT sha256(string_agg(h, chr(10) ORDER BY o)) AS h FROM g GROUP BY o // 1000)
            SELECT sha256('c_name,c_nationkey,c_mktsegment' || chr(10) || max(h)) AS content_sha256 FROM t""",
    }
