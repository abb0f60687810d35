"""Relational and panel queries over the purchase lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import semantics as S
from tallyloom.operators import merges, panel, ranks

QUERIES: dict = {}
SQL: dict[str, str] = {}
LINES = """with lines as (select c.entry_id, c.purchase_id, c.agencyname uni, coalesce(m.new_suppliername, lower(c.suppliername)) supplier, c.product_desc, c.price, c.qty, c.spend, c.purchase_date dt, cast(year(c.purchase_date) as int) yr, c.category market
from category_file c left join supplier_map m on c.suppliername = m.suppliername), cats as (select * from categories)"""


def query(sql: str | None, *, base: bool = True):
    """Registers a query under its function's name, with its SQL on top of the common lines."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (LINES + ("" if sql.lstrip().startswith(",") else " ") if base else "") + sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """The purchase lines with suppliers mapped; the map is a reference list."""
    c, m = table(spark, d, "category_file"), table(spark, d, "supplier_map")
    return c.join(m, "suppliername", "left").select(
        "entry_id", "purchase_id", F.col("agencyname").alias("uni"), F.coalesce("new_suppliername", F.lower("suppliername")).alias("supplier"), "product_desc", "price", "qty", "spend",
        F.col("purchase_date").alias("dt"), F.year("purchase_date").cast("int").alias("yr"), F.col("category").alias("market"),
    )


def cats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "categories")


def clean(spark: SparkSession, d: str) -> DataFrame:
    """Lines that survive the basic rules and are in a listed market."""
    df = S.drop_if(lines(spark, d), S.le(F.col("price"), 0) | S.lt(F.col("qty"), 1) | S.le(F.col("spend"), 0))
    return df.join(cats(spark, d).select(F.col("category").alias("market")), "market", "left_semi")


CLEAN = ", cl as (select * from lines where not coalesce(price <= 0, false) and not coalesce(qty < 1, false) and not coalesce(spend <= 0, false) and market in (select category from cats))"
r7 = lambda c: F.round(c, 7)


@query("select entry_id, market, uni, supplier, yr, qty, round(case when qty <> 1 then price * qty else spend end, 7) spend, round(ln(case when price > 0 then price end), 7) log_price from lines")
def std_purchase_view(spark, d):
    df = lines(spark, d)
    return df.select("entry_id", "market", "uni", "supplier", "yr", "qty", r7(F.when(F.col("qty") != 1, F.col("price") * F.col("qty")).otherwise(F.col("spend"))).alias("spend"), r7(F.ln("price")).alias("log_price"))


@query("""select 'all' stage, count(*) n, round(coalesce(sum(spend), 0), 2) spend from lines union all select 'dated', count(*), round(coalesce(sum(spend), 0), 2) from lines where yr is not null
union all select 'positive', count(*), round(coalesce(sum(spend), 0), 2) from lines where yr is not null and not coalesce(price <= 0, false) and not coalesce(spend <= 0, false)""")
def funnel_counts(spark, d):
    dated = F.col("yr").isNotNull()
    pos = dated & ~S.le(F.col("price"), 0) & ~S.le(F.col("spend"), 0)
    marks = [("all", F.lit(True)), ("dated", dated), ("positive", pos)]
    one = lines(spark, d).agg(*[x for n, c in marks for x in (F.count(F.when(c, 1)).alias(f"{n}_n"), F.round(S.sum_if(F.col("spend"), c), 2).alias(f"{n}_s"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("stage"), F.col(f"{n}_n").alias("n"), F.col(f"{n}_s").alias("spend")) for n, _ in marks])))


WORDS = ["refill", "lot", "size m", "std grade"]


@query("select entry_id from lines where not (" + " or ".join(f"coalesce(contains(lower(product_desc), '{w}'), false)" for w in WORDS) + ")")
def keyword_blacklist_filter(spark, d):
    return lines(spark, d).filter(~S.any_substring(F.lower("product_desc"), WORDS)).select("entry_id")


SCOPED = [("gases - argon", "lot"), ("stir bars", "size"), ("cuvettes", "refill"), ("hand tools", "std")]


@query("select entry_id, market from lines l where not exists (select 1 from (values " + ", ".join(f"('{a}', '{b}')" for a, b in SCOPED) + ") v(m, k) where v.m = l.market and contains(lower(l.product_desc), v.k))")
def category_scoped_blacklist(spark, d):
    pairs = spark.createDataFrame(SCOPED, "m string, k string")
    return lines(spark, d).join(F.broadcast(pairs), (F.col("m") == F.col("market")) & F.lower("product_desc").contains(F.col("k")), "left_anti").select("entry_id", "market")


@query("select entry_id from lines l left join cats c on l.market = c.category where not coalesce(contains(lower(product_desc), 'lot') and precision_score < 0.8, false)")
def confidence_gated_blacklist(spark, d):
    df = lines(spark, d).join(cats(spark, d).select("category", "precision_score"), F.col("market") == F.col("category"), "left")
    return S.drop_if(df, F.lower("product_desc").contains("lot") & (F.col("precision_score") < 0.8)).select("entry_id")


ROLLUP = {"gases - argon": "gases", "gases - helium": "gases", "gases - carbon dioxide": "gases", "gases - liquid nitrogen": "gases", "gloves - latex": "gloves", "gloves - nitrile": "gloves"}


@query("select coalesce(v.t, market) market, count(*) n, round(coalesce(sum(spend), 0), 2) spend from lines left join (values " + ", ".join(f"('{a}', '{b}')" for a, b in ROLLUP.items()) + ") v(f, t) on v.f = market group by 1")
def taxonomy_rollup(spark, d):
    m = F.create_map(*[F.lit(x) for kv in ROLLUP.items() for x in kv])
    return lines(spark, d).groupBy(F.coalesce(F.try_element_at(m, F.coalesce("market", F.lit(""))), F.col("market")).alias("market")).agg(F.count("*").alias("n"), F.round(S.sum0(F.col("spend")), 2).alias("spend"))


@query(""", v as (select distinct lower(trim(market)) w from lines where market is not null),
p as (select a.w w, min(b.w) p from v a join v b on b.w in (a.w || 's', a.w || 'es', case when a.w like '%y' then substr(a.w, 1, length(a.w) - 1) || 'ies' end) group by 1) select w singular, p plural from p""")
def plural_folding(spark, d):
    v = lines(spark, d).filter("market is not null").select(F.lower(F.trim("market")).alias("w")).distinct()
    forms = v.select(F.col("w").alias("singular"), F.explode(F.filter(F.array(F.concat("w", F.lit("s")), F.concat("w", F.lit("es")), F.when(F.col("w").endswith("y"), F.concat(F.expr("substring(w, 1, length(w) - 1)"), F.lit("ies")))), lambda x: x.isNotNull())).alias("w"))
    return forms.join(v, "w").groupBy("singular").agg(F.min("w").alias("plural"))


BUCKETS = [("fees|services", "service"), ("gases|chemicals", "supply"), ("instrument|computing|electronics", "equipment"), ("animal|cell|antibody", "biology")]


@query("select case " + " ".join(f"when regexp_matches(lower(market), '{p}') then '{b}'" for p, b in BUCKETS) + " else 'other_misc' end bucket, count(*) n from lines group by 1")
def ordered_regex_buckets(spark, d):
    out = None
    for p, b in BUCKETS:
        c = F.lower("market").rlike(p)
        out = F.when(c, b) if out is None else out.when(c, b)
    return lines(spark, d).groupBy(out.otherwise("other_misc").alias("bucket")).agg(F.count("*").alias("n"))


@query("select category, case when contains(category, 'culture') and contains(category, 'cell') then 'culture' when contains(category, 'antibody') then 'antibody' else category end bucket from cats", base=True)
def keyword_rollup(spark, d):
    c = F.col("category")
    return cats(spark, d).select("category", F.when(c.contains("culture") & c.contains("cell"), "culture").when(c.contains("antibody"), "antibody").otherwise(c).alias("bucket"))


@query("select category, cast(coalesce(support >= 25 and precision_score >= 0.8 and recall_score >= 0.8 and bad_control = 0, false) as int) keep, case when tier1 = 1 then 1 when tier2 = 1 then 2 when tier3 = 1 then 3 else 0 end tier from cats")
def market_quality_keep(spark, d):
    ok = (F.col("support") >= 25) & (F.col("precision_score") >= 0.8) & (F.col("recall_score") >= 0.8) & (F.col("bad_control") == 0)
    return cats(spark, d).select("category", F.coalesce(ok, F.lit(False)).cast("int").alias("keep"), F.when(F.col("tier1") == 1, 1).when(F.col("tier2") == 1, 2).when(F.col("tier3") == 1, 3).otherwise(0).alias("tier"))


@query("select doc_id, coalesce(athr_id, agencyname, source) who, case when athr_id is not null then 'author' when agencyname is not null then 'agency' when source is not null then 'source' end who_source from documents", base=False)
def coalesce_with_source(spark, d):
    names = ("athr_id", "author"), ("agencyname", "agency"), ("source", "source")
    how = F.when(F.lit(False), "")
    for c, n in names:
        how = how.when(F.col(c).isNotNull(), n)
    return table(spark, d, "documents").select("doc_id", F.coalesce(*[c for c, _ in names]).alias("who"), how.alias("who_source"))


@query("select cluster_label, trim(t) term from (select cluster_label, unnest(string_split(top_terms, ',')) t from cluster_worksheet) where trim(t) <> ''", base=False)
def explode_delimited(spark, d):
    return table(spark, d, "cluster_worksheet").select("cluster_label", F.explode(F.split("top_terms", ",")).alias("t")).select("cluster_label", F.trim("t").alias("term")).filter("term <> ''")


@query("select cluster_label, cast(2009 + n as int) yr from cluster_worksheet cross join (select unnest(generate_series(1, 4)) n)", base=False)
def replicate_rows(spark, d):
    return table(spark, d, "cluster_worksheet").select("cluster_label", F.explode(F.sequence(F.lit(2010), F.lit(2013))).alias("yr"))


@query(CLEAN + """, a as (select market, yr, (percentile_disc(0.01) within group (order by price) + percentile_disc(0.99) within group (order by price desc)) / 2 lo, (percentile_disc(0.99) within group (order by price) + percentile_disc(0.01) within group (order by price desc)) / 2 hi from cl group by all),
b as (select cl.* from cl join a using (market, yr) where price >= lo and price <= hi), c as (select market, (percentile_disc(0.01) within group (order by price) + percentile_disc(0.99) within group (order by price desc)) / 2 lo, (percentile_disc(0.99) within group (order by price) + percentile_disc(0.01) within group (order by price desc)) / 2 hi from b group by all)
select market, yr, count(*) n, round(sum(spend), 2) spend from b join c using (market) where price >= lo and price <= hi group by all""")
def trim_p1_p99_two_pass(spark, d):
    df = panel.trim(panel.trim(clean(spark, d), ["market", "yr"], "price"), ["market"], "price")
    return df.groupBy("market", "yr").agg(F.count("*").alias("n"), F.round(F.sum("spend"), 2).alias("spend"))


@query(CLEAN + ", c as (select (percentile_disc(0.99) within group (order by spend) + percentile_disc(0.01) within group (order by spend desc)) / 2 p from cl where yr <= 2013) select entry_id, round(case when spend is null then null else least(spend, p) end, 7) spend from cl, c")
def cap_p99_pre_period(spark, d):
    df = clean(spark, d)
    cut = df.filter("yr <= 2013").agg(S.pctile_avg("spend", 0.99).alias("p"))
    return df.crossJoin(F.broadcast(cut)).select("entry_id", r7(F.when(F.col("spend").isNotNull(), F.least("spend", "p"))).alias("spend"))


@query(CLEAN + ", u as (select uni, supplier, coalesce(sum(case when yr <= 2013 then spend end), 0) pre from cl group by all), c as (select (percentile_disc(0.95) within group (order by pre) + percentile_disc(0.05) within group (order by pre desc)) / 2 p from u) select uni, supplier, round(pre, 2) pre from u, c where pre <= p")
def trim_top_units_by_pre_total(spark, d):
    u = clean(spark, d).groupBy("uni", "supplier").agg(S.sum_if(F.col("spend"), F.col("yr") <= 2013).alias("pre"))
    return u.crossJoin(F.broadcast(u.agg(S.pctile_avg("pre", 0.95).alias("p")))).filter("pre <= p").select("uni", "supplier", F.round("pre", 2).alias("pre"))


@query(CLEAN + ", g as (select market, min(yr) a, max(yr) b, count(distinct uni) u, count(distinct yr) y from cl group by all) select cl.market, cl.yr, count(*) n from cl join g using (market) where a <= 2013 and b >= 2015 and u >= 6 and y >= 8 group by all")
def balanced_markets(spark, d):
    df = clean(spark, d)
    g = df.groupBy("market").agg(F.min("yr").alias("a"), F.max("yr").alias("b"), F.countDistinct("uni").alias("u"), F.countDistinct("yr").alias("y")).filter("a <= 2013 and b >= 2015 and u >= 6 and y >= 8")
    return df.join(g, "market", "left_semi").groupBy("market", "yr").agg(F.count("*").alias("n"))


@query(", f as (select *, max(case when qty < 0 then 1 else 0 end) over (partition by purchase_id, product_desc) neg, count(*) over (partition by purchase_id, product_desc) n from lines) select entry_id from f where not (neg = 1 and n > 1)")
def return_cancellation(spark, d):
    df = lines(spark, d)
    # an aggregate and a join, not a window: lines without an order or text form one huge key
    k = df.groupBy("purchase_id", "product_desc").agg(F.max(F.when(F.col("qty") < 0, 1).otherwise(0)).alias("neg"), F.count("*").alias("n")).filter("neg = 1 and n > 1").select(F.col("purchase_id").alias("p"), F.col("product_desc").alias("t"))
    return df.join(k, F.col("purchase_id").eqNullSafe(F.col("p")) & F.col("product_desc").eqNullSafe(F.col("t")), "left_anti").select("entry_id")


def _panel(df, *keys):
    return df.groupBy(*keys).agg(
        F.count("*").alias("obs_cnt"), F.round(F.sum("spend"), 2).alias("raw_spend"), F.round(F.sum("qty"), 2).alias("raw_qty"), r7(F.ln(F.sum("spend") / F.nullif(F.sum("qty"), F.lit(0.0)))).alias("log_raw_price"),
        r7(F.avg(F.ln("price"))).alias("avg_log_price"), r7(F.avg("price")).alias("item_price"), F.min("price").alias("min_raw_price"), F.max("price").alias("max_raw_price"), r7(F.stddev_samp("price")).alias("sd_raw_price"),
    )


_PANEL = "count(*) obs_cnt, round(sum(spend), 2) raw_spend, round(sum(qty), 2) raw_qty, round(ln(sum(spend) / nullif(sum(qty), 0)), 7) log_raw_price, round(avg(ln(price)), 7) avg_log_price, round(avg(price), 7) item_price, min(price) min_raw_price, max(price) max_raw_price, round(stddev_samp(price), 7) sd_raw_price from cl group by all"


@query(CLEAN + " select uni, market, yr, " + _PANEL)
def buyer_market_year_panel(spark, d):
    return _panel(clean(spark, d), "uni", "market", "yr")


@query(CLEAN + " select market, yr, " + _PANEL)
def market_year_panel(spark, d):
    return _panel(clean(spark, d), "market", "yr")


_SH = CLEAN + ", s as (select market, per, supplier, coalesce(sum(spend), 0) spend from (select *, case when yr between 2011 and 2013 then 'pre' when yr between 2015 and 2017 then 'post' end per from cl) where per is not null and supplier is not null group by all), h as (select *, case when sum(spend) over (partition by market, per) > 0 then spend / sum(spend) over (partition by market, per) end share from s)"


def _shares(spark, d):
    per = F.when(F.col("yr").between(2011, 2013), "pre").when(F.col("yr").between(2015, 2017), "post")
    return panel.shares(clean(spark, d).withColumn("per", per).filter("per is not null and supplier is not null"), ["market", "per"], "supplier", "spend")


@query(_SH + " select market, per, round(sum((100 * share) ** 2), 3) hhi from h group by all")
def supplier_share_hhi(spark, d):
    return panel.concentration(_shares(spark, d), ["market", "per"]).select("market", "per", F.round("hhi", 3).alias("hhi"))


@query(_SH + " select market, round(2 * coalesce(max(case when supplier = 'velquor' then 100 * share end), 0) * coalesce(max(case when supplier = 'nastrix' then 100 * share end), 0), 3) delta_hhi from h where per = 'pre' group by all")
def simulated_delta_hhi(spark, d):
    return panel.simulated_delta(_shares(spark, d).filter("per = 'pre'"), ["market"], "supplier", "velquor", "nastrix").select("market", F.round("delta_hhi", 3).alias("delta_hhi"))


@query(_SH + ", t as (select market, per, sum((100 * share) ** 2) hhi from h group by all) select market, round(max(case when per = 'pre' then hhi end), 3) pre, round(max(case when per = 'post' then hhi end), 3) post from t group by all")
def pivot_pre_post(spark, d):
    return panel.concentration(_shares(spark, d), ["market", "per"]).groupBy("market").pivot("per", ["pre", "post"]).agg(F.round(F.first("hhi"), 3))


@query(", a as (select uni, count(*) n_lines from lines where yr = 2012 group by 1), b as (select uni, count(*) n_late from lines where yr = 2016 and qty > 90 group by 1) select coalesce(a.uni, b.uni) uni, n_lines, n_late, case when a.uni is null and n_lines is null then 2 when n_late is null then 1 else 3 end merge_code from a full join b on a.uni is not distinct from b.uni")
def merge_codes_full_outer(spark, d):
    df = lines(spark, d)
    a = df.filter("yr = 2012").groupBy("uni").agg(F.count("*").alias("n_lines"))
    b = df.filter("yr = 2016 and qty > 90").groupBy("uni").agg(F.count("*").alias("n_late"))
    return merges.merge(a, b, ["uni"])


@query(", a as (select market, uni, supplier, min(entry_id) e from lines where yr = 2012 group by all), b as (select market, uni, min(supplier) s from lines where yr = 2013 group by 1, 2) select a.market, a.uni, coalesce(a.supplier, b.s) supplier, e, case when b.uni is null then 1 when a.supplier <> b.s then 5 when a.supplier is null and b.s is not null then 4 else 3 end merge_code from a left join b on a.market = b.market and a.uni = b.uni")
def merge_update_fill(spark, d):
    df = lines(spark, d)
    a = df.filter("yr = 2012").groupBy("market", "uni", "supplier").agg(F.min("entry_id").alias("e"))
    b = df.filter("yr = 2013").groupBy("market", "uni").agg(F.min("supplier").alias("supplier"))
    return merges.update_merge(a, b, ["market", "uni"], ["supplier"])


@query("select entry_id, market from lines where market is not null and market not in (select category from cats where keep = 1)")
def anti_join_exclusion(spark, d):
    keep = cats(spark, d).filter("keep = 1").select(F.col("category").alias("market"))
    return merges.merge(lines(spark, d).filter("market is not null").select("entry_id", "market"), keep, ["market"], keep=(1,)).drop("merge_code")


@query("select market, count(*) n from lines where market in (select category from cats where treated = 1) group by 1")
def semi_join_treated(spark, d):
    return lines(spark, d).join(cats(spark, d).filter("treated = 1").select(F.col("category").alias("market")), "market", "left_semi").groupBy("market").agg(F.count("*").alias("n"))


@query("select l.entry_id, l.market, c.support, c.tier1 from lines l left join cats c on c.category = l.market")
def left_join_many_to_one(spark, d):
    c = merges.require_unique(cats(spark, d).select(F.col("category").alias("market"), "support", "tier1"), ["market"])
    return lines(spark, d).select("entry_id", "market").join(c, "market", "left")


@query(", s as (select uni, yr from (select distinct uni from lines where uni is not null), (select distinct yr from lines where yr is not null)) select s.uni, s.yr, coalesce(n, 0) n from s left join (select uni, yr, count(*) n from lines group by all) x using (uni, yr)")
def right_join_spine(spark, d):
    df = lines(spark, d)
    spine = df.select("uni").filter("uni is not null").distinct().crossJoin(F.broadcast(df.select("yr").filter("yr is not null").distinct()))
    got = df.groupBy("uni", "yr").agg(F.count("*").alias("n"))
    return merges.merge(got, spine, ["uni", "yr"], keep=(2, 3), null_safe=False).select("uni", "yr", F.coalesce("n", F.lit(0)).alias("n"))


@query(", k as (values ('lot'), ('refill'), ('column')) select k.col0 keyword, count(*) n from lines join k on contains(lower(product_desc), k.col0) group by 1")
def substring_join(spark, d):
    k = spark.createDataFrame([("lot",), ("refill",), ("column",)], "keyword string")
    return lines(spark, d).join(F.broadcast(k), F.lower("product_desc").contains(F.col("keyword"))).groupBy("keyword").agg(F.count("*").alias("n"))


@query(", a as (select distinct uni, market, yr from lines where yr = 2012 and uni is not null and market is not null), b as (select distinct uni, market, yr from lines where yr = 2013 and uni is not null and market is not null), l as (select * from a except select * from b) select l.*, 'yr' differs_in, x.n n_values, x.e example from l join (select uni, market, count(distinct yr) n, cast(min(yr) as varchar) e from b group by all) x using (uni, market) union all select l.*, 'market', x.n, x.e from l join (select uni, yr, count(distinct market) n, min(market) e from b group by all) x using (uni, yr) union all select l.*, 'uni', x.n, x.e from l join (select market, yr, count(distinct uni) n, min(uni) e from b group by all) x using (market, yr)")
def join_failure_explainer(spark, d):
    df = lines(spark, d).filter("uni is not null and market is not null").select("uni", "market", "yr").distinct()
    return merges.explain_unmatched(df.filter("yr = 2012"), df.filter("yr = 2013"), ["uni", "market", "yr"])


PAIRS = [("stir bars", "cuvettes"), ("stir bars", "hand tools"), ("gases - argon", "gases - helium"), ("gloves - latex", "gloves - nitrile")]


@query(CLEAN + ", m as (select market, yr, sum(spend) s from cl group by all), p(t, c) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + "), e as (select distinct t experiment, t market, 1 treated from p union all select t, c, 0 from p) select e.experiment, e.market, e.treated, m.yr, round(m.s, 2) spend from e join m using (market)")
def stacked_match_panel(spark, d):
    p = spark.createDataFrame(PAIRS, "t string, c string")
    e = p.select(F.col("t").alias("experiment"), F.col("t").alias("market"), F.lit(1).alias("treated")).distinct().unionByName(p.select(F.col("t").alias("experiment"), F.col("c").alias("market"), F.lit(0).alias("treated")))
    return clean(spark, d).groupBy("market", "yr").agg(F.round(F.sum("spend"), 2).alias("spend")).join(e, "market")


@query(CLEAN + " select market, round(sum(spend * qty) / sum(case when spend is not null then qty end), 7) wmean, round((sum(spend * qty) - sum(case when spend is not null then qty end) * 0) / nullif(sum(qty), 0), 7) per_qty from cl group by all")
def weighted_mean_collapse(spark, d):
    w = F.when(F.col("spend").isNotNull(), F.col("qty"))
    return clean(spark, d).groupBy("market").agg(r7(F.sum(F.col("spend") * F.col("qty")) / F.sum(w)).alias("wmean"), r7(F.sum(F.col("spend") * F.col("qty")) / F.nullif(F.sum("qty"), F.lit(0.0))).alias("per_qty"))


@query("select uni, market, count(*) freq from lines where uni is not null and market is not null group by all")
def contract_freq(spark, d):
    return lines(spark, d).filter("uni is not null and market is not null").groupBy("uni", "market").agg(F.count("*").alias("freq"))


@query("select market, count(distinct uni) n_uni, count(distinct supplier) n_supplier, count(distinct yr) n_year from lines group by all")
def distinct_counts(spark, d):
    return lines(spark, d).groupBy("market").agg(F.countDistinct("uni").alias("n_uni"), F.countDistinct("supplier").alias("n_supplier"), F.countDistinct("yr").alias("n_year"))


_P = lambda p, c="price": f"round((percentile_disc({p}) within group (order by {c}) + percentile_disc({round(1 - p, 2)}) within group (order by {c} desc)) / 2, 7)"
QS = (0.01, 0.25, 0.5, 0.75, 0.95, 0.99)


@query(CLEAN + " select market, count(price) n, round(avg(price), 7) mean, round(stddev_samp(price), 7) sd, min(price) min_price, max(price) max_price, " + ", ".join(f"{_P(p)} p{round(p * 100)}" for p in QS) + " from cl group by all")
def pctile_avg_summary(spark, d):
    return clean(spark, d).groupBy("market").agg(F.count("price").alias("n"), r7(F.avg("price")).alias("mean"), r7(F.stddev_samp("price")).alias("sd"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), *[r7(S.pctile_avg("price", p)).alias(f"p{round(p * 100)}") for p in QS])


@query("select fold, round(corr(pred_knn, pred_ridge), 7) pearson, round(sum(n_train * (pred_knn - mk) * (pred_ridge - mr)) / sqrt(sum(n_train * (pred_knn - mk) ** 2) * sum(n_train * (pred_ridge - mr) ** 2)), 7) weighted from (select *, sum(n_train * pred_knn) over (partition by fold) / sum(n_train) over (partition by fold) mk, sum(n_train * pred_ridge) over (partition by fold) / sum(n_train) over (partition by fold) mr from ridge_vs_knn where pred_knn is not null and pred_ridge is not null and n_train is not null) group by fold", base=False)
def correlations(spark, d):
    df = table(spark, d, "ridge_vs_knn").filter("pred_knn is not null and pred_ridge is not null and n_train is not null")
    w, x, y = F.col("n_train"), F.col("pred_knn"), F.col("pred_ridge")
    # weighted moments in one pass
    m = df.groupBy("fold").agg(F.corr(x, y).alias("p"), F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"), F.sum(w * x * y).alias("xy"))
    return m.select("fold", r7("p").alias("pearson"), F.expr("round((xy - x * y / w) / sqrt((xx - x * x / w) * (yy - y * y / w)), 7)").alias("weighted"))


@query("select fold, round(corr(rk, rr), 7) spearman from (select fold, rank() over (partition by fold order by pred_knn) + (count(*) over (partition by fold, pred_knn) - 1) / 2.0 rk, rank() over (partition by fold order by pred_ridge) + (count(*) over (partition by fold, pred_ridge) - 1) / 2.0 rr from ridge_vs_knn where pred_knn is not null and pred_ridge is not null) group by fold", base=False)
def spearman(spark, d):
    df = table(spark, d, "ridge_vs_knn").filter("pred_knn is not null and pred_ridge is not null")
    df = ranks.average_ranks(ranks.average_ranks(df.select("fold", "pred_knn", "pred_ridge"), ["fold"], "pred_knn", "rk"), ["fold"], "pred_ridge", "rr")
    return df.groupBy("fold").agg(r7(F.corr("rk", "rr")).alias("spearman"))


@query("select market, supplier modal_supplier, n from (select market, supplier, count(*) n, row_number() over (partition by market order by count(*) desc, supplier) r from lines where supplier is not null group by 1, 2) where r = 1")
def modal_value_by_freq(spark, d):
    c = lines(spark, d).filter("supplier is not null").groupBy("market", "supplier").agg(F.count("*").alias("n"))
    return c.groupBy("market").agg(F.min_by(F.struct("supplier", "n"), F.struct(-F.col("n"), F.col("supplier"))).alias("x")).select("market", F.col("x.supplier").alias("modal_supplier"), F.col("x.n").alias("n"))


@query("select athr_id, string_agg(source, ' ' order by doc_id, source) career from documents where athr_id is not null and source is not null group by 1", base=False)
def concat_in_order(spark, d):
    df = table(spark, d, "documents").filter("athr_id is not null and source is not null")
    return df.groupBy("athr_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "source"))), lambda s: s["source"]), " ").alias("career"))


@query("select uni, round(-sum(s * ln(s)), 7) entropy, round(max(s), 7) top_share, round(sum(case when r <= 3 then s end), 7) top3_share from (select uni, n / sum(n) over (partition by uni) s, row_number() over (partition by uni order by n desc, market) r from (select uni, market, count(*) n from lines where market is not null group by 1, 2)) group by 1")
def share_entropy(spark, d):
    c = lines(spark, d).filter("market is not null").groupBy("uni", "market").agg(F.count("*").alias("n"))
    w = Window.partitionBy("uni")
    c = c.withColumn("s", F.col("n") / F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "market")))
    return c.groupBy("uni").agg(r7(-F.sum(F.col("s") * F.ln("s"))).alias("entropy"), r7(F.max("s")).alias("top_share"), r7(F.sum(F.when(F.col("r") <= 3, F.col("s")))).alias("top3_share"))


@query("select round(sum(s) ** 2 / sum(s * s), 7) effective_n, count(*) n from (select sum(spend) s from lines where market is not null and spend > 0 group by market)")
def effective_number(spark, d):
    m = lines(spark, d).filter("market is not null and spend > 0").groupBy("market").agg(F.sum("spend").alias("s"))
    return m.agg(r7(F.sum("s") ** 2 / F.sum(F.col("s") * F.col("s"))).alias("effective_n"), F.count("*").alias("n"))


_AU = "with a as (select l_orderkey paper, l_suppkey author, min(l_linenumber) pos from lineitem group by 1, 2), b as (select *, row_number() over (partition by paper order by pos, author) p, count(*) over (partition by paper) size from a)"


def _authors(spark, d):
    """Orders stand for papers and suppliers for their authors."""
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("author")).agg(F.min("l_linenumber").alias("pos"))
    w = Window.partitionBy("paper")
    return a.withColumn("p", F.row_number().over(w.orderBy("pos", "author"))).withColumn("size", F.count("*").over(w))


@query(_AU + " select author, count(*) n_papers, count(case when size = 1 then 1 end) n_solo, count(case when p = 1 and size > 1 then 1 end) n_first, count(case when p = size then 1 end) n_last, count(case when p > 1 and p < size then 1 end) n_middle, round(avg(size), 7) avg_team, round(avg(p), 7) avg_position from b group by 1", base=False)
def author_positions(spark, d):
    p, n = F.col("p"), F.col("size")
    c = lambda x: F.count(F.when(x, 1))
    return _authors(spark, d).groupBy("author").agg(F.count("*").alias("n_papers"), c(n == 1).alias("n_solo"), c((p == 1) & (n > 1)).alias("n_first"), c(p == n).alias("n_last"), c((p > 1) & (p < n)).alias("n_middle"), r7(F.avg(n)).alias("avg_team"), r7(F.avg(p)).alias("avg_position"))


@query(_AU + " select paper, author, cast(p as int) dense_position from b", base=False)
def dense_author_rank(spark, d):
    return _authors(spark, d).select("paper", "author", F.col("p").alias("dense_position"))


@query(_AU + " select paper, author from b where p = 1 or p = size", base=False)
def first_last_author_subsample(spark, d):
    return _authors(spark, d).filter("p = 1 or p = size").select("paper", "author")


@query(_AU + ", e as (select distinct x.author a, y.author b from b x join b y using (paper) where x.author <> y.author) select a, count(*) n_coauthors from e group by 1", base=False)
def coauthor_expand_distinct(spark, d):
    # every pair of a paper is the result here; papers have a handful of authors
    a = _authors(spark, d).select("paper", "author")
    e = a.select("paper", F.col("author").alias("a")).join(a.select("paper", F.col("author").alias("b")), "paper").filter("a <> b").select("a", "b").distinct()
    return e.groupBy("a").agg(F.count("*").alias("n_coauthors"))


@query(_AU + " select author, round(sum(1.0 / size), 7) affl_wt, round(sum((o_totalprice / 10) / size), 2) cite_wt from b join orders on o_orderkey = paper group by 1", base=False)
def fractional_paper_weights(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("paper"), "o_totalprice")
    return _authors(spark, d).join(o, "paper").groupBy("author").agg(r7(F.sum(1.0 / F.col("size"))).alias("affl_wt"), F.round(F.sum(F.col("o_totalprice") / 10 / F.col("size")), 2).alias("cite_wt"))


@query(_AU + ", c as (select author, year(o_orderdate) yr, count(*) n from b join orders on o_orderkey = paper group by 1, 2) select author, yr, n, count(*) over (partition by yr) - 1 others from c", base=False)
def team_size_excluding_self(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("paper"), F.year("o_orderdate").alias("yr"))
    c = _authors(spark, d).join(o, "paper").groupBy("author", "yr").agg(F.count("*").alias("n"))
    return c.join(c.groupBy("yr").agg((F.count("*") - 1).alias("others")), "yr").select("author", "yr", "n", "others")


@query("select o_custkey, count(distinct o_orderkey) n_active, count(distinct case when o_orderstatus = 'O' then o_orderkey end) n_open, round(coalesce(sum(case when o_orderpriority not like '1%' then o_totalprice end), 0), 2) cost_main, round(sum(o_totalprice), 2) cost_all, cast(min(o_orderdate) as date) first_start, cast(max(o_orderdate) as date) last_end from orders group by 1", base=False)
def funding_rollup(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.countDistinct("o_orderkey").alias("n_active"), F.countDistinct(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("n_open"), F.round(S.sum_if(F.col("o_totalprice"), ~F.col("o_orderpriority").startswith("1")), 2).alias("cost_main"), F.round(F.sum("o_totalprice"), 2).alias("cost_all"), F.min("o_orderdate").cast("date").alias("first_start"), F.max("o_orderdate").cast("date").alias("last_end"))


_UY = CLEAN + ", u as (select uni, market, yr, sum(spend) s, count(*) n from cl where market is not null and uni is not null and yr is not null group by all)"
_FULL = ", g as (select min(yr) a, max(yr) b from u), f as (select x.uni, x.market, cast(x.yr as int) yr, n from (select uni, market, unnest(generate_series(a, b)) yr from (select distinct uni, market from u), g) x left join u using (uni, market, yr))"
UNIT = ["uni", "market"]


def _uy(spark, d):
    """Buyer and market by year, of all markets."""
    return clean(spark, d).filter("market is not null and uni is not null and yr is not null").groupBy(*UNIT, "yr").agg(F.sum("spend").alias("s"), F.count("*").alias("n"))


@query(_UY + ", g as (select uni, market, min(yr) a, max(yr) b from u group by 1, 2) select x.uni, x.market, cast(x.yr as int) yr, n from (select uni, market, unnest(generate_series(a, b)) yr from g) x left join u using (uni, market, yr)")
def panel_fill_span(spark, d):
    return panel.fill_span(_uy(spark, d), UNIT, "yr").select(*UNIT, "yr", "n")


@query(_UY + _FULL + " select * from f")
def panel_fill_full(spark, d):
    return panel.fill_span(_uy(spark, d), UNIT, "yr", full=True).select(*UNIT, "yr", "n")


@query(_UY + _FULL + " select uni, market, yr, last_value(n ignore nulls) over (partition by uni, market order by yr rows between unbounded preceding and current row) forward, first_value(n ignore nulls) over (partition by uni, market order by yr rows between current row and unbounded following) backward from f")
def locf_fill(spark, d):
    df = panel.fill_span(_uy(spark, d), UNIT, "yr", full=True)
    return df.select(*UNIT, "yr", panel.carry_forward("n", UNIT, "yr").alias("forward"), panel.carry_back("n", UNIT, "yr").alias("backward"))


@query(_UY + " select uni, market, yr, case when yr - lag(yr) over w = 1 then n - lag(n) over w end d_n from u window w as (partition by uni, market order by yr)")
def gap_checked_diff(spark, d):
    return _uy(spark, d).select(*UNIT, "yr", panel.step_change("n", UNIT, "yr").alias("d_n"))


@query(CLEAN + ", y as (select market, yr, supplier from (select market, yr, supplier, row_number() over (partition by market, yr order by count(*) desc, supplier) r from cl where supplier is not null and yr is not null group by 1, 2, 3) where r = 1), f as (select *, lag(supplier) over w b, lead(supplier) over w a from y window w as (partition by market order by yr)), g as (select *, case when a = b and supplier <> b then b end t from f) select market, yr, case when t is not null and lag(t) over (partition by market order by yr) is null then t else supplier end supplier from g")
def sandwich_repair(spark, d):
    c = clean(spark, d).filter("supplier is not null and yr is not null").groupBy("market", "yr", "supplier").agg(F.count("*").alias("n"))
    top = c.groupBy("market", "yr").agg(F.min_by("supplier", F.struct(-F.col("n"), F.col("supplier"))).alias("supplier"))
    return panel.sandwich(top, ["market"], "yr", "supplier")


@query(_UY + " select uni, market, yr, round(s, 2) s, round(max(case when yr = 2013 then s end) over w, 2) s_2013, round(s - max(case when yr = 2013 then s end) over w, 2) s_rel from u window w as (partition by uni, market)")
def base_year_normalize(spark, d):
    w = Window.partitionBy(*UNIT)
    return _uy(spark, d).select(*UNIT, "yr", F.round("s", 2).alias("s"), F.round(F.max(F.when(F.col("yr") == 2013, F.col("s"))).over(w), 2).alias("s_2013"), F.round(panel.base_year("s", UNIT, "yr", 2013), 2).alias("s_rel"))


@query(CLEAN + " select entry_id, uni, market, coalesce(price, m) price from (select *, max(price) over (partition by uni, market) m from cl)")
def group_broadcast_fill(spark, d):
    df = clean(spark, d)
    m = df.groupBy("uni", "market").agg(F.max("price").alias("m")).select(F.col("uni").alias("u"), F.col("market").alias("k"), "m")
    return df.join(m, F.col("uni").eqNullSafe(F.col("u")) & (F.col("market") == F.col("k")), "left").select("entry_id", "uni", "market", F.coalesce("price", "m").alias("price"))


@query(CLEAN + " select market, entry_id, r from (select market, entry_id, cast(row_number() over (partition by market order by spend desc, entry_id) as int) r from cl where spend is not null) where r <= 3")
def top_k_per_group(spark, d):
    w = Window.partitionBy("market").orderBy(F.desc("spend"), "entry_id")
    return clean(spark, d).filter("spend is not null").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("market", "entry_id", "r")


@query(CLEAN + ", m as (select market, round(sum(spend), 6) s, count(distinct uni) u from cl group by 1), c as (select (percentile_disc(0.5) within group (order by s) + percentile_disc(0.5) within group (order by s desc)) / 2 ps, (percentile_disc(0.5) within group (order by u) + percentile_disc(0.5) within group (order by u desc)) / 2 pu from m) select market, cast(s > ps as int) big, cast(u > pu as int) wide from m, c")
def median_split_2x2(spark, d):
    m = clean(spark, d).groupBy("market").agg(F.round(F.sum("spend"), 6).alias("s"), F.countDistinct("uni").alias("u"))
    c = m.agg(S.pctile_avg("s", 0.5).alias("ps"), S.pctile_avg("u", 0.5).alias("pu"))
    return m.crossJoin(F.broadcast(c)).select("market", (F.col("s") > F.col("ps")).cast("int").alias("big"), (F.col("u") > F.col("pu")).cast("int").alias("wide"))


@query(CLEAN + ", m as (select market, round(sum(spend), 6) s from cl group by 1), c as (select " + ", ".join(f"{_P(p, 's').replace('round(', '(').replace(', 7)', ')')} q{i}" for i, p in ((1, 0.25), (2, 0.5), (3, 0.75))) + " from m) select market, cast(1 + (s > q1)::int + (s > q2)::int + (s > q3)::int as int) bin from m, c")
def quantile_bins(spark, d):
    m = clean(spark, d).groupBy("market").agg(F.round(F.sum("spend"), 6).alias("s"))
    return panel.quantile_bins(m, "s", 4).select("market", "bin")


@query("select uni, market, round(pr, 7) pr, round(cd, 7) cd from (select uni, market, percent_rank() over (partition by uni order by n) pr, cume_dist() over (partition by uni order by n) cd from (select uni, market, count(*) n from lines where market is not null group by 1, 2))")
def percentile_rank(spark, d):
    c = lines(spark, d).filter("market is not null").groupBy("uni", "market").agg(F.count("*").alias("n"))
    w = Window.partitionBy("uni").orderBy("n")
    return c.select("uni", "market", r7(F.percent_rank().over(w)).alias("pr"), r7(F.cume_dist().over(w)).alias("cd"))


@query("select market, entry_id from lines where market is not null qualify row_number() over (partition by market, uni, supplier, yr order by dt, entry_id) = 1")
def dedup_first_by_key(spark, d):
    df = lines(spark, d).filter("market is not null").select("market", "uni", "supplier", "yr", "dt", "entry_id")
    return merges.dedup_first(df, ["market", "uni", "supplier", "yr"], [F.col("dt").isNull().cast("int"), F.col("dt"), F.col("entry_id")]).select("market", "entry_id")


@query("select cleaned_description, min(label) label, arg_min(record_id, struct_pack(a := case when data_source like 'uni%' then 0 else 1 end, b := record_id)) record_id from training_dataset where cleaned_description is not null and label is not null group by 1", base=False)
def label_conflict_downgrade(spark, d):
    df = table(spark, d, "training_dataset").filter("cleaned_description is not null and label is not null")
    rank = F.struct(F.when(F.col("data_source").startswith("uni"), 0).otherwise(1), F.col("record_id"))
    return df.groupBy("cleaned_description").agg(F.min("label").alias("label"), F.min_by("record_id", rank).alias("record_id"))


@query("select 'a' part, count(*) n from (select market, uni from lines where yr = 2012 intersect select market, uni from lines where yr = 2013) union all select 'b', count(*) from (select market, uni from lines where yr = 2012 except select market, uni from lines where yr = 2013)")
def key_set_operations(spark, d):
    df = lines(spark, d)
    a, b = df.filter("yr = 2012").select("market", "uni"), df.filter("yr = 2013").select("market", "uni")
    return a.intersect(b).agg(F.count("*").alias("n")).select(F.lit("a").alias("part"), "n").unionByName(a.subtract(b).agg(F.count("*").alias("n")).select(F.lit("b").alias("part"), "n"))


@query("select 'line' src, entry_id id, spend amount, null supplier from lines where yr = 2012 union all select 'listing', listing_id, price, suppliername from catalog_listings")
def append_by_name(spark, d):
    a = lines(spark, d).filter("yr = 2012").select(F.lit("line").alias("src"), F.col("entry_id").alias("id"), F.col("spend").alias("amount"))
    b = table(spark, d, "catalog_listings").select(F.lit("listing").alias("src"), F.col("listing_id").alias("id"), F.col("price").alias("amount"), F.col("suppliername").alias("supplier"))
    return a.unionByName(b, allowMissingColumns=True)


@query(CLEAN + ", m as (select market, round(sum(spend), 2) spend, round(sum(qty), 2) qty from cl group by 1) select market, 'spend' measure, spend v from m union all select market, 'qty', qty from m")
def unpivot_measures(spark, d):
    m = clean(spark, d).groupBy("market").agg(F.round(F.sum("spend"), 2).alias("spend"), F.round(F.sum("qty"), 2).alias("qty"))
    return m.unpivot(["market"], ["spend", "qty"], "measure", "v")


@query("select yr + 0 yr, count(*) n from (select cast(generate_series as int) yr from generate_series(2005, 2025)) x where yr not in (select yr from lines where yr is not null) group by 1")
def missing_shard_audit(spark, d):
    want = spark.range(2005, 2026).select(F.col("id").cast("int").alias("yr"))
    return want.join(lines(spark, d).select("yr").distinct(), "yr", "left_anti").groupBy("yr").agg(F.count("*").alias("n"))
