"""Queries over learned rules, similarity, text, audits and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.expr import rounded, safe_div
from panelyard.operators import audit, calendar, cross, search, similar
from panelyard.plans.signals import SIGNALS, signals
from panelyard.plans.sql import EVENTS, PANEL
from panelyard.plans.sql import rank_pct as rank_sql
from panelyard.sources.folders import scratch
from panelyard.sources.tables import panel, stream_events, table
from panelyard.streaming import watch

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


FEATURES = ["ret", "ret3", "volume"]
_SPLIT = """d AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM panel)), n AS (SELECT floor(max(idx) * 0.65)::INT + 1 AS cut FROM d),
sp AS (SELECT panel.*, CASE WHEN idx <= cut THEN 'train' ELSE 'valid' END AS part FROM panel JOIN d USING (date), n)"""
_FORMULA_SQL = ", ".join(f"('{k}', {' + '.join(f'p_{c} * {w}' for c, w in f.items())})" for k, f in search.FORMULAS.items())


@query(f"""
WITH {PANEL}, {_SPLIT}, p AS (SELECT *, coalesce({rank_sql('ret', 'date')}, 0.5) AS p_ret, coalesce({rank_sql('ret3', 'date')}, 0.5) AS p_ret3, coalesce({rank_sql('volume', 'date')}, 0.5) AS p_volume FROM sp),
l AS (SELECT code, date, part, fwd, formula, score FROM p, LATERAL (VALUES {_FORMULA_SQL}) v(formula, score) WHERE fwd IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY formula, date ORDER BY round(score, 9) DESC, code) AS rank FROM l),
c AS (SELECT formula, top, part, date, avg(fwd) AS r FROM r, (SELECT unnest([3, 5]) AS top) WHERE rank <= top GROUP BY 1, 2, 3, 4)
SELECT formula, top, part, count(*) AS n_dates, round(avg(r), 6) AS mean_ret, round(avg((r > 0)::INT), 6) AS pos_rate, round(avg(r) - 0.5 * stddev_pop(r) - 10 * avg((r <= -5)::INT), 6) AS stability FROM c GROUP BY 1, 2, 3
""")
def l_formula_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.formula_grid(calendar.split(panel(spark, sf_dir))))


#: What rules are learned of; the order decides between equal scores.
TREE_FEATURES = """total_score trend_score book_score counter_score prior_return_20d relative_strength_rank rsi14 volume_ratio20 drawdown60 ma200_slope20 atr20_pct news_net_materiality_30d news_risk_event_score_30d news_opportunity_score
news_evidence_quality news_conflict_intensity_30d peer_group_avg_return_20d peer_relative_to_group_20d peer_group_positive_breadth_20d peer_group_above_ma200_rate peer_group_news_risk_avg peer_group_news_opportunity_avg""".split()
_LEAST, _TRAIN = 80, "year(date) <= 1999"
_LONG = f"""{SIGNALS}, gr AS (SELECT row_number() OVER (ORDER BY code, date) AS r, * FROM sg WHERE return_20d IS NOT NULL AND {_TRAIN}),
gl AS MATERIALIZED (SELECT r, return_20d AS y, unnest([{', '.join(f"'{f}'" for f in TREE_FEATURES)}]) AS feature, unnest(range({len(TREE_FEATURES)})) AS place, unnest([{', '.join(f'{f}::DOUBLE' for f in TREE_FEATURES)}]) AS x FROM gr)"""


def _step(k: int, rows: str) -> str:
    """Candidates c<k> on rows, and the best of them, b<k>."""
    return f"""l{k} AS (SELECT * FROM gl WHERE x IS NOT NULL AND r IN (SELECT r FROM {rows})),
t{k} AS (SELECT feature, unnest(range(0, 5)) AS q, unnest(quantile_cont(x, [0.2, 0.35, 0.5, 0.65, 0.8])) AS threshold FROM l{k} GROUP BY feature HAVING count(DISTINCT x) >= 3),
o{k} AS (SELECT l.feature, place, q, threshold, y, unnest(list_filter([CASE WHEN x >= threshold THEN '>=' END, CASE WHEN x <= threshold THEN '<=' END], lambda o: o IS NOT NULL)) AS op FROM l{k} l JOIN t{k} t ON l.feature = t.feature),
c{k} AS (SELECT feature, place, q, threshold, op, count(*) AS n, avg(y) AS mean_fwd, avg((y > 0)::INT) AS pos_rate, stddev_pop(y) AS spread, avg(y) + 10 * avg((y > 0)::INT) + 0.3 * (avg(y) - 0.5 * stddev_pop(y) - 10 * avg((y <= -5)::INT)) - 0.05 * stddev_pop(y) AS score FROM o{k} GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= {_LEAST}),
b{k} AS (SELECT * FROM c{k} ORDER BY round(score, 9) DESC, place, q, op DESC LIMIT 1)"""


@query(f"WITH {_LONG}, {_step(1, 'gr')} SELECT feature, q::INT AS q, round(threshold, 6) AS threshold, op, n, round(mean_fwd, 6) AS mean_fwd, round(pos_rate, 6) AS pos_rate, round(spread, 6) AS spread, round(score, 6) AS score FROM c1")
def l_rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every threshold rule of the training rows, both ways."""
    out = search.candidates(signals(spark, sf_dir).where("year(date) <= 1999"), TREE_FEATURES, least=_LEAST, y="return_20d")
    return rounded(out.select("feature", "q", "threshold", "op", "n", "mean_fwd", "pos_rate", "spread", "score"))


_MET = lambda k, rows: f"m{k} AS (SELECT r FROM {rows} SEMI JOIN (SELECT l.r FROM ga l JOIN b{k} b ON l.feature = b.feature AND CASE WHEN b.op = '>=' THEN l.x >= b.threshold ELSE l.x <= b.threshold END) USING (r))"
_TREE = f"""{_LONG}, ga AS (SELECT r, feature, x FROM gl WHERE x IS NOT NULL),
{_step(1, 'gr')}, {_MET(1, 'gr')}, {_step(2, 'm1')}, {_MET(2, 'm1')}, {_step(3, 'm2')},
ru AS (SELECT 1 AS depth, feature, op, threshold, n, score FROM b1 UNION ALL SELECT 2, feature, op, threshold, n, score FROM b2 UNION ALL SELECT 3, feature, op, threshold, n, score FROM b3)"""


@query(f"WITH {_TREE} SELECT depth, feature, op, round(threshold, 6) AS threshold FROM ru")
def l_greedy_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conjunction that is learned condition by condition on the training rows."""
    rule = search.greedy(signals(spark, sf_dir).where("year(date) <= 1999"), TREE_FEATURES, least=_LEAST, y="return_20d")
    return rounded(spark.createDataFrame([(i, *c) for i, c in enumerate(rule, 1)], "depth int, feature string, op string, threshold double"))


@query(f"""
WITH {PANEL}, {_SPLIT}, tr AS (SELECT * FROM sp WHERE part = 'train' AND fwd IS NOT NULL), b AS (SELECT avg((fwd > 0)::INT) AS base FROM tr),
l AS (SELECT fwd, unnest(['ret', 'ret3', 'volume']) AS feature, unnest([ret, ret3, volume]) AS x FROM tr), t AS (SELECT feature, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS cuts FROM l WHERE x IS NOT NULL GROUP BY feature),
r AS (SELECT feature, len(list_filter(cuts, lambda c: x > c)) AS bin, count(*) AS n, sum((fwd > 0)::INT) AS k FROM l JOIN t USING (feature) WHERE x IS NOT NULL GROUP BY 1, 2),
e AS (SELECT feature, bin, (k + 20.0 * base) / (n + 20.0) - base AS edge FROM r, b), top AS (SELECT * FROM e ORDER BY round(abs(edge), 9) DESC, feature, bin LIMIT 16),
s AS (SELECT code, date, unnest(['ret', 'ret3', 'volume']) AS feature, unnest([ret, ret3, volume]) AS x FROM sp WHERE part = 'valid'),
h AS (SELECT code, date, edge FROM (SELECT code, date, feature, len(list_filter(cuts, lambda c: x > c)) AS bin FROM s JOIN t USING (feature) WHERE x IS NOT NULL) LEFT JOIN top USING (feature, bin))
SELECT code, date, round(sum(coalesce(edge, 0)), 6) AS score, count(edge) AS n_rules FROM h GROUP BY 1, 2
""")
def l_additive_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calendar.split(panel(spark, sf_dir))
    return rounded(search.additive_bins(rows.where("part = 'train'"), rows.where("part = 'valid'"), FEATURES))


@query(f"""
WITH {PANEL}, {_SPLIT}, b AS (SELECT date, part, avg(coalesce(ret > 0, FALSE)::INT) AS breadth, avg(fwd) AS pool FROM sp GROUP BY 1, 2), q AS (SELECT quantile_cont(breadth, 0.35) AS lo, quantile_cont(breadth, 0.65) AS hi FROM b WHERE part = 'train')
SELECT date, part, round(breadth, 6) AS breadth, CASE WHEN breadth >= hi THEN 1.0 WHEN breadth >= lo THEN 0.5 ELSE 0.0 END::DOUBLE AS scale, round(pool, 6) AS pool FROM b, q
""")
def l_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.functions.expr import share

    daily = calendar.split(panel(spark, sf_dir)).groupBy("date", "part").agg(share(F.col("ret") > 0).alias("breadth"), F.avg("fwd").alias("pool"))
    return rounded(search.exposure(daily.where("part = 'train'"), daily))


@query(f"""
WITH {PANEL}, {_SPLIT}, l AS (SELECT date, fwd, unnest(['ret', 'ret3', 'volume']) AS feature, unnest([ret, ret3, volume]) AS x FROM sp WHERE part = 'train' AND fwd IS NOT NULL),
r AS (SELECT feature, date, rank() OVER (PARTITION BY feature, date ORDER BY x) + (count(*) OVER (PARTITION BY feature, date, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature, date ORDER BY fwd) + (count(*) OVER (PARTITION BY feature, date, fwd) - 1) / 2.0 AS ry FROM l WHERE x IS NOT NULL),
ic AS (SELECT feature, date, corr(rx, ry) AS ic FROM r GROUP BY 1, 2 HAVING count(*) >= 5), w AS (SELECT feature, avg(ic) AS m, count(*) AS n FROM ic GROUP BY 1)
SELECT feature, n, round(m, 6) AS mean_ic, round(CASE WHEN abs(m) < 0.002 THEN 0.0 ELSE greatest(-0.2, least(0.2, m)) END, 6) AS weight, CASE WHEN m < 0 THEN -1 ELSE 1 END AS orientation FROM w
""")
def l_ic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature weights from their in-sample RankIC: clipped, small ones dropped, oriented."""
    rows = calendar.split(panel(spark, sf_dir)).where("part = 'train'")
    ic = cross.rank_ic(rows.unpivot(["date", "code", "fwd"], FEATURES, "feature", "x"), "x", "fwd", "feature", "date", least=5, distinct=1)
    out = ic.groupBy("feature").agg(F.count("*").alias("n"), F.avg("ic").alias("mean_ic"))
    weight = F.when(F.abs("mean_ic") < 0.002, 0.0).otherwise(F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.col("mean_ic"))))
    return rounded(out.select("feature", "n", "mean_ic", weight.alias("weight"), F.when(F.col("mean_ic") < 0, -1).otherwise(1).alias("orientation")))


@query(f"""
WITH {PANEL}, s AS (SELECT code, date, 1 / (1 + exp(-(coalesce(ret, 0) / 5))) AS up, 1 / (1 + exp(coalesce(ret3, 0) / 10)) AS down, tanh(coalesce(ret, 0) / 20) AS conviction, ln(1 + volume) AS size FROM panel)
SELECT code, date, round(up / (up + down), 6) AS p_up, round(down / (up + down), 6) AS p_down, round(conviction, 6) AS conviction, round(size, 6) AS size FROM s
""")
def l_channel_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ret, ret3 = F.coalesce("ret", F.lit(0.0)), F.coalesce("ret3", F.lit(0.0))
    s = panel(spark, sf_dir).select("code", "date", (1 / (1 + F.exp(-ret / 5))).alias("up"), (1 / (1 + F.exp(ret3 / 10))).alias("down"), F.tanh(ret / 20).alias("conviction"), F.log1p("volume").alias("size"))
    total = F.col("up") + F.col("down")
    return rounded(s.select("code", "date", (F.col("up") / total).alias("p_up"), (F.col("down") / total).alias("p_down"), "conviction", "size"))


def l_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calendar.split(panel(spark, sf_dir))
    return rounded(search.fitted_logistic(rows.where("part = 'train'"), rows.where("part = 'valid'"), FEATURES), 4)


def l_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calendar.split(panel(spark, sf_dir))
    return rounded(search.fitted_trees(rows.where("part = 'train'"), rows.where("part = 'valid'"), FEATURES), 4)


QUERIES |= {"l_logistic": l_logistic, "l_boosted_trees": l_boosted_trees}


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))


@query("""
WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.id AS query_id, e.id, list_cosine_similarity(q.v, e.v) AS s FROM e q JOIN e ON e.label = q.label AND e.id <> q.id WHERE q.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(-s, 9), id) AS rank FROM p)
SELECT query_id, id, rank, round(s, 6) AS value FROM r WHERE rank <= 10
""")
def t_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set (ids divisible by 50) against all vectors of the same label."""
    bank = _vectors(spark, sf_dir)
    return rounded(similar.nearest(bank.where("id % 50 = 0"), bank))


@query("""
WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.id AS query_id, e.id, list_distance(q.v, e.v) / sqrt(len(q.v)) AS d FROM e q JOIN e ON e.label = q.label AND e.id <> q.id WHERE q.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank FROM p),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT query_id, count(*) AS k, round(avg(d), 6) AS mean_distance, round(avg(d) FILTER (rank <= 5) - avg(d) FILTER (rank > 5), 6) AS near_minus_far, count(quality) AS n_labelled, round(avg(quality), 6) AS quality_rate, round(avg(toxic), 6) AS toxic_rate,
 round(avg(quality) FILTER (id >= query_id) - avg(quality) FILTER (id < query_id), 6) AS later_minus_earlier FROM r LEFT JOIN l ON doc_id = id WHERE rank <= 10 GROUP BY query_id
""")
def t_neighbour_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euclidean (root mean square) neighbours and what their documents' labels say of them, also
    of those with later ids against those with earlier ones."""
    bank = _vectors(spark, sf_dir)
    near = similar.nearest(bank.where("id % 50 = 0"), bank, metric="euclid")
    gap = F.avg(F.when(F.col("rank") <= 5, F.col("value"))) - F.avg(F.when(F.col("rank") > 5, F.col("value")))
    known = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    later = F.col("id") >= F.col("query_id")
    change = F.avg(F.when(later, F.col("quality"))) - F.avg(F.when(~later, F.col("quality")))
    return rounded(near.join(known, "id", "left").groupBy("query_id").agg(F.count("*").alias("k"), F.avg("value").alias("mean_distance"), gap.alias("near_minus_far"), F.count("quality").alias("n_labelled"), F.avg("quality").alias("quality_rate"), F.avg("toxic").alias("toxic_rate"), change.alias("later_minus_earlier")))


_TERMS = "list_distinct(regexp_extract_all(lower({0}), '([a-z0-9_]{{2,}})', 1))"


@query(f"""
WITH q AS (SELECT item_id AS query_id, unnest({_TERMS.format('text')}) AS term FROM benchmark WHERE item_id % 50 = 0), d AS (SELECT item_id AS id, {_TERMS.format('text')} AS t FROM benchmark), x AS (SELECT id, len(t) AS n, unnest(t) AS term FROM d),
s AS (SELECT query_id, id, count(*) AS matched, count(*) / sqrt(n) AS score FROM x JOIN q USING (term) GROUP BY query_id, id, n), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)
SELECT query_id, id, matched, round(score, 6) AS score, rank FROM r WHERE rank <= 3
""")
def t_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items with ids divisible by 50 as requests against all items."""
    docs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return rounded(similar.retrieved(docs.where("id % 50 = 0"), docs))


@query(f"""
WITH {EVENTS}, s AS (SELECT code, list_distinct(list(event_type)) AS tags, avg(k) AS m, code % 3 AS sector FROM ev GROUP BY code),
p AS (SELECT a.code AS code, b.code AS other, (a.sector = b.sector)::INT + 2 * len(list_intersect(a.tags, b.tags)) / (len(a.tags) + len(b.tags) - len(list_intersect(a.tags, b.tags))) - abs(a.m - b.m) / 100 AS s FROM s a JOIN s b ON a.code <> b.code AND a.sector = b.sector),
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY round(s, 9) DESC, other) AS rank FROM p) SELECT code, other, round(s, 6) AS similarity, rank FROM r WHERE rank <= 5
""")
def t_mixed_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sector, shared tags and scaled differences; the best lie beside a code in the order of m."""
    s = stream_events(spark, sf_dir).groupBy("code").agg(F.collect_set("event_type").alias("tags"), F.avg("k").alias("m")).withColumn("sector", F.col("code") % 3)
    path = scratch(spark, "tagged")
    s.write.parquet(path)
    return rounded(similar.mixed(spark.read.parquet(path)))


@query("""
SELECT conv_id, turn, role, CASE WHEN regexp_matches(lower(text), '\\b(the|and)\\b') THEN 'english' WHEN regexp_matches(lower(text), '\\b(der|die|und)\\b') THEN 'german' WHEN regexp_matches(lower(text), '\\b(les|une)\\b') THEN 'french' ELSE 'none' END AS kind,
 length(text)::BIGINT AS n_chars, coalesce(TRY_CAST(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS BIGINT), -1) AS first_number FROM conversations
""")
def t_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    kind = similar.keyword_class(text, {"english": ["the", "and"], "german": ["der", "die", "und"], "french": ["les", "une"]})
    number = F.coalesce(F.nullif(F.regexp_extract(text, "([0-9]+)", 1), F.lit("")).try_cast("long"), F.lit(-1).cast("long"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", kind.alias("kind"), F.char_length(text).cast("long").alias("n_chars"), number.alias("first_number"))


@query("""
WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<mail>', 'g'), '\\b(?:sk|key|tok)[-_][A-Za-z0-9]{8,}\\b', '<secret>', 'g'), '[-+]?\\d+(?:\\.\\d+)?\\s?%', '<percent>', 'g'), '\\b\\d{6,}\\b', '<number>', 'g') AS t FROM documents)
SELECT doc_id, md5(t) AS digest, length(t)::BIGINT AS n_chars FROM r
""")
def t_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = similar.redacted(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.cast("binary")).alias("digest"), F.char_length(t).cast("long").alias("n_chars"))


@query(f"""
WITH {EVENTS}, x AS (SELECT code, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS tags, strftime(max(ts), '%Y%m%d') AS stamp FROM ev GROUP BY code)
SELECT code, list_contains(string_split(tags, ','), 'error') AS has_error, len(string_split(tags, ','))::INT AS n_tags, strptime(stamp, '%Y%m%d')::DATE AS last_day FROM x
""")
def t_tokens_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token lists kept as text, and dates parsed from one of several formats."""
    x = stream_events(spark, sf_dir).groupBy("code").agg(F.concat_ws(",", F.array_sort(F.collect_set("event_type"))).alias("tags"), F.date_format(F.max("ts"), "yyyyMMdd").alias("stamp"))
    tags = F.array_distinct(F.split("tags", ","))
    return x.select("code", F.array_contains(tags, "error").alias("has_error"), F.size(tags).alias("n_tags"), similar.parsed_date(F.col("stamp")).alias("last_day"))


@query(f"""
WITH {PANEL}, {_SPLIT}, c AS (SELECT part, count(*) AS n, count(ret) AS ret, count(ret3) AS ret3, count(fwd) AS fwd FROM sp GROUP BY part)
SELECT part, n, "column", known, round(known / n, 6) AS rate FROM c, LATERAL (VALUES ('ret', ret), ('ret3', ret3), ('fwd', fwd)) v("column", known)
""")
def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.coverage(calendar.split(panel(spark, sf_dir)), ["ret", "ret3", "fwd"], "part"))


@query(f"""
WITH {PANEL}, {_SPLIT}, p AS (SELECT part, code, count(*) AS k, min(date) AS lo, max(date) AS hi FROM sp GROUP BY 1, 2)
SELECT part, sum(k)::BIGINT AS n, min(lo) AS first_date, max(hi) AS last_date, round(max(k) / sum(k), 6) AS top_share, max(k) / sum(k) < 0.5 AS pure FROM p GROUP BY part
""")
def q_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.purity(calendar.split(panel(spark, sf_dir)), "part"))


@query("""
SELECT 'orders' AS source, count(*) AS n_rows, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_days, CASE WHEN count(*) = 0 THEN 'missing' WHEN count(DISTINCT date_trunc('month', o_orderdate)) < 12 THEN 'under_covered' ELSE 'ready' END AS status FROM orders
UNION ALL SELECT 'events', count(*), count(DISTINCT CAST(ts AS DATE)), CASE WHEN count(*) = 0 THEN 'missing' WHEN count(DISTINCT date_trunc('month', ts)) < 12 THEN 'under_covered' ELSE 'ready' END FROM events
""")
def q_source_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(name: str, time: str) -> DataFrame:
        months = F.count_distinct(F.date_trunc("month", time))
        status = F.when(F.count("*") == 0, "missing").when(months < 12, "under_covered").otherwise("ready")
        return table(spark, sf_dir, name).agg(F.lit(name).alias("source"), F.count("*").alias("n_rows"), F.count_distinct(F.to_date(time)).alias("n_days"), status.alias("status"))

    return one("orders", "o_orderdate").unionByName(one("events", "ts"))


@query("""
SELECT event_id, concat_ws('+', CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'error', 'signup') THEN 'type' END, CASE WHEN value < 0 OR value > 1000 THEN 'range' END, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'missing_k' END, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) > 90 THEN 'large_k' END) AS violations
FROM events WHERE event_type NOT IN ('view', 'click', 'purchase', 'error', 'signup') OR value < 0 OR value > 1000 OR json_extract_string(props, '$.k') IS NULL OR CAST(json_extract_string(props, '$.k') AS INT) > 90
""")
def q_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break the contract of their fields, with the names of the broken rules."""
    from panelyard.functions.expr import named

    k = F.get_json_object("props", "$.k").cast("int")
    rules = {"type": ~F.col("event_type").isin("view", "click", "purchase", "error", "signup"), "range": (F.col("value") < 0) | (F.col("value") > 1000), "missing_k": k.isNull(), "large_k": k > 90}
    return table(spark, sf_dir, "events").select("event_id", named(rules).alias("violations")).where("violations <> ''")


@query("""
WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(DISTINCT event_id) AS n, count(DISTINCT event_id) FILTER (event_type = 'error') AS n_errors, min(value) AS low, max(value) AS high FROM events GROUP BY 1)
SELECT start, n, n_errors, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN n_errors >= 3 THEN 'alarm' WHEN high - low >= 90 THEN 'watch' ELSE 'calm' END AS grade FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)
""")
def st_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's closed windows; one still open at the end is not emitted."""
    out = watch.appended(watch.graded(watch.source(spark, sf_dir)), "watch")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id AS code, count(*) AS n, max(ts) AS last FROM events GROUP BY 1")
def st_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = watch.latest_states(watch.run_lengths(watch.source(spark, sf_dir)))
    return out.withColumn("last", F.col("last").cast("timestamp_ntz"))
