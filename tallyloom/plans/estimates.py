"""Estimates: exposure, shrinkage, regressions, matching, tests and text weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import semantics as S
from tallyloom.operators import causal, panel, regress, similarity
from tallyloom.plans import relational as R

QUERIES: dict = {}
SQL: dict[str, str] = {}
EVENT = 2014
r6 = lambda c: F.round(c, 6)


def query(sql: str | None = None, *, base: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (R.LINES + R.CLEAN + PANEL if base else "") + sql
        return f

    return add


PANEL = ", my as (select market, yr, ln(sum(spend) / sum(qty)) lp, ln(sum(spend)) ls, sum(spend) s, c.treated from cl join cats c on c.category = cl.market where yr is not null group by market, yr, c.treated having sum(qty) > 0 and sum(spend) > 0)"


def market_years(spark, d) -> DataFrame:
    g = R.clean(spark, d).filter("yr is not null").groupBy("market", "yr").agg(F.sum("spend").alias("s"), F.sum("qty").alias("q")).filter("q > 0 and s > 0")
    t = R.cats(spark, d).select(F.col("category").alias("market"), "treated")
    return g.join(t, "market").select("market", "yr", F.ln(F.col("s") / F.col("q")).alias("lp"), F.ln("s").alias("ls"), "s", "treated")


def balanced(spark, d, first=2010, last=2018) -> DataFrame:
    df = market_years(spark, d).filter(F.col("yr").between(first, last))
    full = df.groupBy("market").agg(F.count("*").alias("n")).filter(F.col("n") == last - first + 1)
    return df.join(full.select("market"), "market", "left_semi")


BAL = ", b as (select * from my where yr between 2010 and 2018 and market in (select market from my where yr between 2010 and 2018 group by 1 having count(*) = 9)), x as (select *, treated * (yr >= 2014)::int did from b)"


@query(" select market, case when count(*) > 1 then round(regr_slope(lp, yr), 6) end slope, case when count(*) > 1 then round(regr_intercept(lp, yr), 3) end intercept, count(*) n from my group by 1")
def ols_slope_by_market(spark, d):
    s = regress.slope_by(market_years(spark, d), ["market"], "lp", "yr")
    return s.select("market", F.when(F.col("n") > 1, r6("slope")).alias("slope"), F.when(F.col("n") > 1, F.round("intercept", 3)).alias("intercept"), "n")


@query(BAL + ", c as (select lp - avg(lp) over (partition by market) - avg(lp) over (partition by yr) + avg(lp) over () y, did - avg(did) over (partition by market) - avg(did) over (partition by yr) + avg(did) over () x from x) select 'did' term, round(sum(x * y) / sum(x * x), 6) b, count(*) n from c")
def twfe_did_balanced(spark, d):
    df = balanced(spark, d).withColumn("did", F.col("treated") * (F.col("yr") >= EVENT).cast("int"))
    return regress.fe_ols(df, "lp", ["did"], absorb=["market", "yr"], clusters=["market"]).frame(spark).select("term", r6("b").alias("b"), "n")


@query(BAL + ", c as (select market, lp - avg(lp) over (partition by market) - avg(lp) over (partition by yr) + avg(lp) over () y, did - avg(did) over (partition by market) - avg(did) over (partition by yr) + avg(did) over () x from x), e as (select sum(x * y) / sum(x * x) b, sum(x * x) xx, count(*) n, count(distinct market) g from c), u as (select market, sum(x * (y - b * x)) s from c, e group by 1) select 'did' term, round(sqrt(sum(s * s) / (max(xx) ** 2) * max(g) / (max(g) - 1) * (max(n) - 1) / (max(n) - 1 - (select count(distinct yr) from x))), 6) se from u, e")
def twfe_cluster_se(spark, d):
    df = balanced(spark, d).withColumn("did", F.col("treated") * (F.col("yr") >= EVENT).cast("int"))
    return regress.fe_ols(df, "lp", ["did"], absorb=["market", "yr"], clusters=["market"]).frame(spark).select("term", r6("se").alias("se"))


@query(None)
def twfe_unbalanced_weighted(spark, d):
    """Unbalanced panel, weighted by spending, clustered two ways."""
    df = market_years(spark, d).withColumn("did", F.col("treated") * (F.col("yr") >= EVENT).cast("int"))
    return regress.fe_ols(df, "lp", ["did"], absorb=["market", "yr"], clusters=["market", "yr"], weight="s", tol=1e-8).frame(spark)


@query(None)
def event_study_fe(spark, d):
    df, xs = regress.event_columns(balanced(spark, d), F.col("treated"), "yr", EVENT, range(-4, 5))
    return regress.fe_ols(df, "lp", xs, absorb=["market", "yr"], clusters=["market"]).frame(spark)


@query(None)
def ppml_fe(spark, d):
    df = balanced(spark, d).withColumn("did", F.col("treated") * (F.col("yr") >= EVENT).cast("int"))
    return regress.fe_poisson(df, "s", ["did"], absorb=["market", "yr"], clusters=["market"]).frame(spark)


@query(BAL.replace("treated * (yr >= 2014)::int did from b", "treated * (yr >= 2012)::int did from b where yr < 2014") + ", c as (select lp - avg(lp) over (partition by market) - avg(lp) over (partition by yr) + avg(lp) over () y, did - avg(did) over (partition by market) - avg(did) over (partition by yr) + avg(did) over () x from x) select 2012 fake_year, round(sum(x * y) / sum(x * x), 6) b from c")
def placebo_timing(spark, d):
    df = balanced(spark, d).filter(F.col("yr") < EVENT).withColumn("did", F.col("treated") * (F.col("yr") >= 2012).cast("int"))
    f = regress.fe_ols(df, "lp", ["did"], absorb=["market", "yr"]).frame(spark)
    return f.select(F.lit(2012).alias("fake_year"), r6("b").alias("b"))


_DID = ", pp as (select market, avg(case when yr >= 2014 then lp end) - avg(case when yr < 2014 then lp end) dlp, var_samp(case when yr >= 2014 then lp end) / nullif(count(case when yr >= 2014 then 1 end), 0) + var_samp(case when yr < 2014 then lp end) / nullif(count(case when yr < 2014 then 1 end), 0) v from my group by market), co as (select market, dlp b, sqrt(v) se from pp where dlp is not null and v > 0)"


def _coefs(spark, d) -> DataFrame:
    """Change of the mean log price at the event and its standard error, one row per market."""
    post = F.col("yr") >= EVENT
    of = lambda f, c: f(F.when(c, F.col("lp")))
    g = market_years(spark, d).groupBy("market").agg((of(F.avg, post) - of(F.avg, ~post)).alias("b"), (of(F.var_samp, post) / F.nullif(of(F.count, post), F.lit(0)) + of(F.var_samp, ~post) / F.nullif(of(F.count, ~post), F.lit(0))).alias("v"))
    return g.filter("b is not null and v > 0").select("market", "b", F.sqrt("v").alias("se"))


@query(_DID + " select market, round(b, 6) b, round(se, 6) se from co")
def per_market_change(spark, d):
    return _coefs(spark, d).select("market", r6("b").alias("b"), r6("se").alias("se"))


@query(_DID + ", m as (select greatest(0, var_samp(b) - avg(se * se)) t2, sum(b / (se * se)) / sum(1 / (se * se)) mu from co) select market, round(t2 / (t2 + se * se), 6) w_eb, round(t2 / (t2 + se * se) * b + (1 - t2 / (t2 + se * se)) * mu, 6) b_eb, round(sqrt(t2 / (t2 + se * se) * se * se), 6) se_eb from co, m")
def eb_shrink_coefs(spark, d):
    return panel.shrink(_coefs(spark, d)).select("market", r6("w_eb").alias("w_eb"), r6("b_eb").alias("b_eb"), r6("se_eb").alias("se_eb"))


def _exposure_sql(cond: str) -> str:
    return _DID + f", sp as (select uni, market, sum(spend) s from cl where yr <= 2013 and uni is not null and market in (select category from cats where {cond}) group by 1, 2), t as (select *, sum(s) over (partition by uni) t from sp) select uni, round(coalesce(sum(s / t * b), 0), 6) exposure, round(coalesce(sum(case when b is not null then s / t end), 0), 6) share_sum from t left join co using (market) where t > 0 group by 1"


def _exposure(spark, d, cond: str) -> DataFrame:
    df = R.clean(spark, d).filter("yr <= 2013 and uni is not null")
    ok = R.cats(spark, d).filter(cond).select(F.col("category").alias("market"))
    e = panel.shift_share(df.join(ok, "market", "left_semi"), "uni", "market", "spend", _coefs(spark, d), "b")
    return e.select("uni", r6("exposure").alias("exposure"), r6("share_sum").alias("share_sum"))


@query(_exposure_sql("keep = 1"))
def shift_share_exposure_hc(spark, d):
    return _exposure(spark, d, "keep = 1")


@query(_exposure_sql("keep = 1 and treated = 1"))
def shift_share_exposure_treated(spark, d):
    return _exposure(spark, d, "keep = 1 and treated = 1")


@query(_exposure_sql("true"))
def shift_share_exposure_all(spark, d):
    return _exposure(spark, d, "true")


@query(_DID + ", sp as (select uni, market, coalesce(sum(spend), 0) s from cl where uni is not null group by 1, 2), sh as (select market, s / sum(s) over (partition by uni) sh from sp), k as (select market, avg(sh) sb, any_value(b) b from sh join co using (market) group by 1) select market, round(sb * b / (select sum(sb * b) from k), 6) weight from k")
def rotemberg_weights(spark, d):
    df = R.clean(spark, d).filter("uni is not null")
    sh = panel.shares(df, ["uni"], "market", "spend")
    k = sh.join(_coefs(spark, d), "market").groupBy("market").agg((F.avg("share") * F.first("b")).alias("x"))
    return k.crossJoin(F.broadcast(k.agg(F.sum("x").alias("t")))).select("market", r6(F.col("x") / F.col("t")).alias("weight"))


@query(", sp as (select uni, market, sum(spend) s from cl where uni is not null and spend is not null group by 1, 2), t as (select uni, sum(s) t from sp group by 1 having sum(s) > 0), p as (select market, sum(s) / sum(sum(s)) over () prior from sp group by 1) select t.uni, p.market, round((coalesce(s, 0) + 1000 * prior) / (t + 1000), 6) share from t cross join p left join sp on sp.uni = t.uni and sp.market = p.market")
def eb_shrink_shares_global(spark, d):
    df = R.clean(spark, d).filter("uni is not null and spend is not null")
    return similarity.shrink_shares(df, "uni", "market", "spend", 1000.0).select("uni", "market", r6("share").alias("share"))


@query("with t as (select treated g, support v from categories), a as (select avg(v) filter (g = 0) m0, avg(v) filter (g = 1) m1, var_samp(v) filter (g = 0) / count(v) filter (g = 0) s0, var_samp(v) filter (g = 1) / count(v) filter (g = 1) s1, count(v) filter (g = 0) n0, count(v) filter (g = 1) n1 from t) select round(m0, 6) mean0, round(m1, 6) mean1, round((m1 - m0) / sqrt(s0 + s1), 6) t, round((s0 + s1) ** 2 / (s0 ** 2 / (n0 - 1) + s1 ** 2 / (n1 - 1)), 6) dof from a", base=False)
def welch_t(spark, d):
    w = causal.welch(R.cats(spark, d), "treated", "support")
    return w.select(*[r6(c).alias(c) for c in w.columns])


@query(", v as (select spend x, (yr >= 2014)::int g from cl where spend is not null and yr is not null), c as (select x, sum(1 - g) c0, sum(g) c1 from v group by 1), r as (select sum(c0) over (order by x) / sum(c0) over () f0, sum(c1) over (order by x) / sum(c1) over () f1 from c) select round(max(abs(f0 - f1)), 6) ks, (select count(*) from v where g = 0) n0, (select count(*) from v where g = 1) n1 from r")
def kolmogorov_smirnov(spark, d):
    df = R.clean(spark, d).filter("spend is not null and yr is not null").withColumn("g", (F.col("yr") >= EVENT).cast("int"))
    return causal.kolmogorov_smirnov(df, "g", "spend").select(r6("ks").alias("ks"), "n0", "n1")


@query("select cast(least(19, floor(true_exposure * 20)) as bigint) bin, count(*) n from ridge_vs_knn where true_exposure between 0 and 1 and not isnan(true_exposure) group by 1", base=False)
def histogram_bins(spark, d):
    x = F.col("true_exposure")
    return R.table(spark, d, "ridge_vs_knn").filter(x.between(0, 1) & ~F.isnan(x)).groupBy(F.least(F.lit(19), F.floor(x * 20)).alias("bin")).agg(F.count("*").alias("n"))


@query("with r as (select * from ridge_vs_knn where true_exposure between 0 and 1 and not isnan(true_exposure)), m as (select denom_version, true_exposure t, pred_knn p, 'pred_knn' model from r where pred_knn is not null union all select denom_version, true_exposure, pred_ridge, 'pred_ridge' from r where pred_ridge is not null) select denom_version, model, count(*) n, round(corr(t, p), 6) corr, round(avg((t - p) ** 2), 6) mse, round(avg(abs(t - p)), 6) mae, round(regr_slope(t, p), 6) slope, round(1 - sum((t - p) ** 2) / (var_pop(t) * count(*)), 6) r2 from m group by 1, 2", base=False)
def prediction_metrics(spark, d):
    df = R.table(spark, d, "ridge_vs_knn").filter(F.col("true_exposure").between(0, 1) & ~F.isnan("true_exposure"))
    m = causal.prediction_metrics(df, "true_exposure", ["pred_knn", "pred_ridge"], ["denom_version"])
    return m.select("denom_version", "model", "n", *[r6(c).alias(c) for c in ("corr", "mse", "mae", "slope", "r2")])


_COV = ", u as (select market, any_value(treated) treated, round(avg(lp), 9) x1, round(avg(ls), 9) x2 from my where yr < 2014 group by market)"


def _units(spark, d) -> DataFrame:
    return market_years(spark, d).filter(F.col("yr") < EVENT).groupBy("market").agg(F.first("treated").alias("treated"), F.round(F.avg("lp"), 9).alias("x1"), F.round(F.avg("ls"), 9).alias("x2"))


@query(_COV + ", c as (select covar_samp(x1, x1) a, covar_samp(x1, x2) b, covar_samp(x2, x2) c from u), d as (select t.market treated, k.market control, sqrt(greatest(0, ((t.x1 - k.x1) ** 2 * c - 2 * (t.x1 - k.x1) * (t.x2 - k.x2) * b + (t.x2 - k.x2) ** 2 * a) / (a * c - b * b))) dist from u t join u k on t.treated = 1 and k.treated = 0 cross join c) select treated, control, round(dist, 6) distance, rank from (select *, cast(row_number() over (partition by treated order by dist, control) as int) rank from d) where rank <= 2")
def mahalanobis_match(spark, d):
    return causal.nearest_controls(_units(spark, d), "market", "treated", ["x1", "x2"]).select("treated", "control", r6("distance").alias("distance"), "rank")


@query(None)
def synthetic_control(spark, d):
    """Donor weights of each treated market over all control markets."""
    kinds = R.cats(spark, d).select(F.col("category").alias("market"), "treated")
    mine = kinds.filter("treated = 1").select(F.col("market").alias("experiment"))
    donors = mine.crossJoin(F.broadcast(kinds.filter("treated = 0").select(F.col("market").alias("unit"), "treated")))
    sets = donors.unionByName(mine.select("experiment", F.col("experiment").alias("unit"), F.lit(1).alias("treated")))
    my = market_years(spark, d).select(F.col("market").alias("unit"), F.col("yr").alias("time"), F.col("lp").alias("value"))
    return causal.synthetic_controls(sets.join(my, "unit"), event=EVENT)


@query(None)
def placebo_inference(spark, d):
    """The effect at the event of 100 random sets of 46 markets taken as treated, each matched again to the other markets."""
    units = _units(spark, d).select("market", "x1", "x2")
    pairs = causal.placebo_matches(units, causal.placebo_draws(units, "market", 100, 46), "market", ["x1", "x2"])
    return causal.matched_effects(pairs, _coefs(spark, d), "market", "b")


@query(_DID + " select cl.uni, round(sum(spend * exp(-b)), 2) counterfactual, round(sum(spend * exp(-b)) - sum(spend), 2) loss from cl join co using (market) where yr >= 2014 and uni is not null group by 1")
def counterfactual_loss(spark, d):
    df = R.clean(spark, d).filter((F.col("yr") >= EVENT) & F.col("uni").isNotNull()).join(_coefs(spark, d), "market")
    cf = F.sum(F.col("spend") * F.exp(-F.col("b")))
    return df.groupBy("uni").agg(F.round(cf, 2).alias("counterfactual"), F.round(cf - F.sum("spend"), 2).alias("loss"))


@query(", f as (select market, regr_slope(lp, yr) sl, regr_intercept(lp, yr) ic from my where yr < 2014 group by 1 having count(*) > 2) select my.market, yr, round(lp - (ic + sl * yr) + (ic + sl * 2013), 6) lp from my join f using (market)")
def detrended(spark, d):
    df = market_years(spark, d)
    f = regress.slope_by(df.filter(F.col("yr") < EVENT), ["market"], "lp", "yr").filter("n > 2")
    return df.join(f, "market").select("market", "yr", r6(F.col("lp") - (F.col("intercept") + F.col("slope") * F.col("yr")) + (F.col("intercept") + F.col("slope") * 2013)).alias("lp"))


@query(", z as (select market, avg(lp) x, avg(ls) y from my group by 1), q as (select *, x - avg(x) over () xr, y - avg(y) over () yr_ from z), b as (select ntile(10) over (order by round(xr, 9), market) bin, xr, yr_ from q) select cast(bin as int) bin, count(*) n, round(avg(xr), 6) x, round(avg(yr_), 6) y from b group by 1")
def binned_scatter(spark, d):
    from pyspark.sql import Window

    z = market_years(spark, d).groupBy("market").agg(F.avg("lp").alias("x"), F.avg("ls").alias("y"))
    z = z.crossJoin(F.broadcast(z.agg(F.avg("x").alias("mx"), F.avg("y").alias("my")))).select("market", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    # one row per market
    return z.withColumn("bin", F.ntile(10).over(Window.orderBy(F.round("x", 9), "market"))).groupBy("bin").agg(F.count("*").alias("n"), r6(F.avg("x")).alias("x"), r6(F.avg("y")).alias("y"))


_TOK = "with w as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) term from documents), c as (select doc_id, term, count(*) tf from w group by 1, 2), n as (select count(distinct doc_id) n from c), f as (select term, count(*) df from c group by 1 having count(*) >= 3 and count(*) <= 0.5 * (select n from n)), x as (select doc_id, term, (1 + ln(tf)) * (1 + ln((1.0 + n) / (1 + df))) x from c join f using (term), n), t as (select doc_id, term, x / sqrt(sum(x * x) over (partition by doc_id)) weight from x)"


def _weights(spark, d) -> DataFrame:
    docs = R.table(spark, d, "documents")
    return similarity.tfidf(similarity.term_counts(docs, "doc_id", "text"), "doc_id", min_df=3, max_df=0.5)


@query(_TOK + " select term, count(*) n, round(avg(weight), 5) mean_weight from t group by 1 having count(*) >= 10", base=False)
def tfidf_term_weights(spark, d):
    return _weights(spark, d).groupBy("term").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 5).alias("mean_weight")).filter("n >= 10")


@query(_TOK.replace("group by 1 having count(*) >= 3", "group by 1 having count(*) >= 3") + ", l as (select doc_id, source from documents where source is not null), a as (select source, term, sum(weight) / any_value(k.n) m from t join l using (doc_id) join (select source, count(*) n from l group by 1) k using (source) group by 1, 2), q as (select *, m / sqrt(sum(m * m) over (partition by source)) weight from a) select source, term, round(weight, 5) weight from (select *, row_number() over (partition by source order by round(weight, 9) desc, term) r from q) where r <= 15", base=False)
def centroid_top_terms(spark, d):
    from pyspark.sql import Window

    labels = R.table(spark, d, "documents").select("doc_id", "source").filter("source is not null")
    c = similarity.centroids(_weights(spark, d), "doc_id", labels, "source")
    w = Window.partitionBy("source").orderBy(F.desc(F.round("weight", 9)), "term")
    return c.withColumn("r", F.row_number().over(w)).filter("r <= 15").select("source", "term", F.round("weight", 5).alias("weight"))


@query(None)
def nearest_centroid(spark, d):
    w = similarity.anchor_vocabulary(_weights(spark, d), "doc_id", R.table(spark, d, "documents").filter("athr_id is not null").select("doc_id").distinct())
    labels = R.table(spark, d, "documents").select("doc_id", "source").filter("source is not null")
    return similarity.nearest_label(w, "doc_id", similarity.centroids(w, "doc_id", labels, "source"), "source")


@query(None)
def contrastive_term_weights(spark, d):
    docs = R.table(spark, d, "documents").filter("source is not null")
    return similarity.contrast_weights(similarity.term_counts(docs, "doc_id", "text"), "doc_id", docs.select("doc_id", "source"), "source")


_KNN = "with a as (select vec_id, embedding e from embeddings where label <= 1), q as (select vec_id, embedding e from embeddings), s as (select q.vec_id, a.vec_id anchor, list_cosine_similarity(q.e::double[], a.e::double[]) sim from q, a), r as (select *, row_number() over (partition by vec_id order by round(sim, 7) desc, anchor) k from s), f as (select * from r where k <= 3 and sim >= 0.05), w as (select vec_id, anchor, sim, sim * sim / sum(sim * sim) over (partition by vec_id) weight from f)"


def _knn(spark, d) -> DataFrame:
    e = R.table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return similarity.knn(e.drop("label"), e.filter("label <= 1").drop("label"), "vec_id", "embedding")


@query(_KNN + " select vec_id, anchor, round(sim, 4) sim, round(weight, 4) weight from w", base=False)
def knn_cosine_weights(spark, d):
    return _knn(spark, d).select("vec_id", "anchor", F.round("sim", 4).alias("sim"), F.round("weight", 4).alias("weight"))


@query(_KNN + " select w.vec_id, round(sum(weight * label) / sum(weight), 4) label from w join embeddings e on e.vec_id = w.anchor where label is not null group by 1", base=False)
def impute_from_neighbours(spark, d):
    e = R.table(spark, d, "embeddings").select("vec_id", "label")
    return similarity.impute(_knn(spark, d), "vec_id", e, "vec_id", "label").select("vec_id", F.round("label", 4).alias("label"))


@query("with r as (select source truth, case when regexp_matches(lower(text), 'order|invoice|refund') then 'purchase_note' when regexp_matches(lower(text), 'aim|award') then 'grant_summary' else 'abstract' end pred from documents where source is not null and text is not null), c as (select distinct truth k from r union select distinct pred from r) select k label, count(*) filter (truth = k) support, count(*) filter (truth = k and pred = k) tp, round(count(*) filter (truth = k and pred = k) / nullif(count(*) filter (pred = k), 0), 6) precision_, round(count(*) filter (truth = k and pred = k) / nullif(count(*) filter (truth = k), 0), 6) recall_ from c, r group by 1", base=False)
def classification_report(spark, d):
    t = F.lower("text")
    r = R.table(spark, d, "documents").filter("source is not null and text is not null").select(F.col("source").alias("truth"), F.when(t.rlike("order|invoice|refund"), "purchase_note").when(t.rlike("aim|award"), "grant_summary").otherwise("abstract").alias("pred"))
    return report(r, "truth", "pred").select("label", "support", "tp", r6("precision_").alias("precision_"), r6("recall_").alias("recall_"))


def report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(label, support, tp, precision_, recall_, f1) from the confusion counts."""
    c = df.groupBy(truth, pred).agg(F.count("*").alias("n"))
    a = c.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("support"), F.coalesce(F.sum(F.when(F.col(truth) == F.col(pred), F.col("n"))), F.lit(0)).alias("tp"))
    b = c.groupBy(F.col(pred).alias("label")).agg(F.sum("n").alias("said"))
    j = a.join(b, "label", "full").select("label", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("tp", F.lit(0)).alias("tp"), "said")
    j = j.withColumn("precision_", F.col("tp") / F.nullif(F.col("said"), F.lit(0))).withColumn("recall_", F.col("tp") / F.nullif(F.col("support"), F.lit(0)))
    return j.withColumn("f1", 2 * F.col("precision_") * F.col("recall_") / F.nullif(F.col("precision_") + F.col("recall_"), F.lit(0.0)))


@query(None)
def interacted_slopes(spark, d):
    """Effects of the event by tier, all in one regression."""
    tier = R.cats(spark, d).select(F.col("category").alias("market"), F.when(F.col("tier1") == 1, 1).when(F.col("tier2") == 1, 2).otherwise(3).alias("tier"))
    df = balanced(spark, d).join(tier, "market")
    post = F.col("treated") * (F.col("yr") >= EVENT).cast("int")
    df = df.withColumns({f"did_t{t}": post * (F.col("tier") == t).cast("int") for t in (1, 2, 3)}).withColumn("tier_yr", F.concat_ws("#", "tier", "yr"))
    return regress.fe_ols(df, "lp", ["did_t1", "did_t2", "did_t3"], absorb=["market", "tier_yr"], clusters=["market"]).frame(spark)


@query(None)
def functional_form_table(spark, d):
    """The same effect as levels, logs and Poisson."""
    df = balanced(spark, d).withColumn("did", F.col("treated") * (F.col("yr") >= EVENT).cast("int"))
    fits = [("ols", regress.fe_ols(df, "s", ["did"], absorb=["market", "yr"], clusters=["market"])), ("log_ols", regress.fe_ols(df, "ls", ["did"], absorb=["market", "yr"], clusters=["market"])), ("poisson", regress.fe_poisson(df, "s", ["did"], absorb=["market", "yr"], clusters=["market"]))]
    return spark.createDataFrame([(n, *r) for n, f in fits for r in f.rows()], "form string, term string, b double, se double, lb double, ub double, n long")


@query(None)
def stacked_equality_test(spark, d):
    """Do two outcomes react alike: stacked, each with its own factors, and the difference of the effects."""
    df = balanced(spark, d)
    both = df.select("market", "yr", "treated", F.col("lp").alias("y"), F.lit(0).alias("o")).unionByName(df.select("market", "yr", "treated", F.col("ls").alias("y"), F.lit(1).alias("o")))
    both = both.withColumn("did", F.col("treated") * (F.col("yr") >= EVENT).cast("int")).withColumn("did_second", F.col("did") * F.col("o")).withColumn("om", F.concat_ws("#", "o", "market")).withColumn("oy", F.concat_ws("#", "o", "yr"))
    return regress.fe_ols(both, "y", ["did", "did_second"], absorb=["om", "oy"], clusters=["market"]).frame(spark)


@query(BAL + ", z as (select market, (avg(lp) - avg(avg(lp)) over ()) / stddev_samp(avg(lp)) over () zx, avg(ls) y, count(*) w from b group by market), m as (select sum(w * zx) / sum(w) mx, sum(w * y) / sum(w) my from z) select 'zx' term, round(sum(w * (zx - mx) * (y - my)) / sum(w * (zx - mx) ** 2), 6) b from z, m")
def weighted_least_squares(spark, d):
    """Weighted regression on a standardised regressor."""
    z = balanced(spark, d).groupBy("market").agg(F.avg("lp").alias("x"), F.avg("ls").alias("y"), F.count("*").cast("double").alias("w"))
    z = z.crossJoin(F.broadcast(z.agg(F.avg("x").alias("mx"), F.stddev_samp("x").alias("sx")))).withColumn("zx", (F.col("x") - F.col("mx")) / F.col("sx"))
    return regress.fe_ols(z, "y", ["zx"], weight="w").frame(spark).select("term", r6("b").alias("b"))


@query(_DID + ", sp as (select uni, market, coalesce(sum(spend), 0) s from cl where uni is not null group by 1, 2), sh as (select market, s / sum(s) over (partition by uni) sh from sp), k as (select market, avg(sh) x, any_value(b) g from sh join co using (market) group by 1), m as (select sum(x * x) / sum(x) mx, sum(x * g) / sum(x) mg from k) select 'x' term, round(sum(x * (x - mx) * (g - mg)) / sum(x * (x - mx) ** 2), 4) b from k, m")
def shock_balance(spark, d):
    """Weighted regression of the shocks on the mean shares that carry them."""
    sh = panel.shares(R.clean(spark, d).filter("uni is not null"), ["uni"], "market", "spend")
    k = sh.join(_coefs(spark, d), "market").groupBy("market").agg(F.avg("share").alias("x"), F.first("b").alias("g"))
    return regress.fe_ols(k, "g", ["x"], weight="x").frame(spark).select("term", F.round("b", 4).alias("b"))


@query(None)
def optimal_match(spark, d):
    """Each treated market with a control of its own, as many as there are, at least total distance over all controls."""
    near = causal.nearest_controls(_units(spark, d), "market", "treated", ["x1", "x2"], ratio=causal.MAX_CONTROLS).orderBy("treated", "rank").toPandas()  # treated x control markets
    return spark.createDataFrame(causal.match_all(near), "treated string, control string, distance double")


@query(None)
def ridge_by_neighbours(spark, d):
    """Ridge of the exposure on both predictions and the similarity, over all labelled rows by their moments."""
    import numpy as np

    xs = ["pred_knn", "pred_ridge", "max_sim_to_train"]
    rows = R.table(spark, d, "ridge_vs_knn").filter("true_exposure between 0 and 1 and not isnan(true_exposure)").select("true_exposure", *xs).dropna()
    n = rows.count()
    cov = causal.covariance(rows, [*xs, "true_exposure"]) * max(n - 1, 0)
    b, alpha = regress.ridge_gcv_moments(cov[:3, :3], cov[:3, 3], cov[3, 3], n) if n else (np.zeros(3), 0.0)
    return spark.createDataFrame([(x, float(v), alpha) for x, v in zip(xs, b, strict=True)], "term string, b double, alpha double")


@query("with w as (select suppliername, unnest(list_filter(regexp_split_to_array(lower(suppliername), '\\s+'), lambda x: x <> '')) w from supplier_map), p as (select suppliername, ' ' || w || ' ' p from w), g as (select suppliername, substr(p, i, n) term from (select *, unnest(generate_series(1, 60)) i from p) cross join (values (3), (4), (5)) t(n) where i + n - 1 <= length(p)) select suppliername, term, count(*) tf from g group by 1, 2", base=False)
def char_ngram_counts(spark, d):
    return similarity.char_counts(R.table(spark, d, "supplier_map"), "suppliername", "suppliername")
