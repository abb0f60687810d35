"""Text, rules, names and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import entities, models, panel, rules
from tallyloom.plans import relational as R

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *, base: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (R.LINES if base else "") + sql
        return f

    return add


def _clean_sql(c: str) -> str:
    s = f"lower({c})"
    for name in ("urls", "money", "brackets", "signs", "spaces"):
        p, to = X.STEPS[name]
        s = f"regexp_replace({s}, '{p}', '{to}', 'g')"
    stop = ", ".join(f"'{w}'" for w in sorted(X.STOP_WORDS))
    return f"list_distinct(list_filter(string_split(trim({s}), ' '), lambda w: length(w) > 1 and w not in ({stop})))"


@query(f"select record_id, array_to_string(list_sort({_clean_sql('cleaned_description')}), ' ') words from training_dataset where cleaned_description is not null")
def clean_text(spark, d):
    df = R.table(spark, d, "training_dataset").filter("cleaned_description is not null")
    c = X.clean(F.col("cleaned_description"), ["urls", "money", "brackets", "signs", "spaces"])
    return df.select("record_id", F.array_join(F.array_sort(F.filter(F.split(c, " "), lambda w: w != "")), " ").alias("words"))


@query("select listing_id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(cleaned_description), '[0-9]+ ?(?:ml|mg|mm|cm|g)\\b'))), '; '), '') found from catalog_listings")
def unit_candidates(spark, d):
    found = X.extract_all(F.lower("cleaned_description"), [r"[0-9]+ ?(?:ml|mg|mm|cm|g)\b"])
    return R.table(spark, d, "catalog_listings").select("listing_id", F.array_join(F.array_sort(F.split(found, "; ")), "; ").alias("found"))


KEYS = ["pipette tip", "storage box", "filter unit", "*mouse*"]


@query("select doc_id from documents where regexp_matches(text, '(?i)(^|[^A-Za-z0-9])(pipette[\\s_/-]*tip(e?s)?|storage[\\s_/-]*box(e?s)?|filter[\\s_/-]*unit(e?s)?)([^A-Za-z0-9]|$)|(?i)mouse')")
def keyword_matcher(spark, d):
    return R.table(spark, d, "documents").filter(F.col("text").rlike(X.keyword_pattern(KEYS))).select("doc_id")


@query("select suppliername, 'supp_' || array_to_string(list_slice(list_filter(regexp_split_to_array(trim(regexp_replace(lower(suppliername), '[^a-z ]+', ' ', 'g')), ' +'), lambda x: length(x) >= 3 and x not in ('inc', 'ltd', 'llc', 'gmbh', 'corp', 'company', 'supply', 'scientific')), 1, 3), '_') token from supplier_map")
def supplier_tokens(spark, d):
    return R.table(spark, d, "supplier_map").select("suppliername", X.supplier_token(F.col("suppliername")).alias("token"))


@query("select category, case when contains(category, 'Models') or not contains(category, ',') then category else regexp_extract(category, '^(.*),[^,]*$', 1) end head from (select distinct category from category_file where category is not null)")
def head_terms(spark, d):
    df = R.table(spark, d, "category_file").select("category").filter("category is not null").distinct()
    return df.select("category", X.head_term(F.col("category")).alias("head"))


@query(None)
def stemmed_texts(spark, d):
    return R.table(spark, d, "documents").select("doc_id", X.stem_text(X.fold_ascii("text")).alias("stems"))


RULES = rules.RuleSet(
    (
        rules.Rule("tips - filtered", all_of=("tip", "filter")),
        rules.Rule("tips", any_of=("pipette tip", "loading tip")),
        rules.Rule("tubes", any_of=("$TUBES",), none_of=("rack",)),
        rules.Rule("enzyme - restriction", regex_any_of=(r"\b[A-Z][a-z]{2}[IVX]+\b",), case_sensitive=True),
        rules.Rule("antibody", any_of=("antibod*",)),
        rules.Rule("lots", exact_any_of=("gel box lot",), regex_none_of=(r"\d{5}",)),
        rules.Rule("glassware", any_of=("beaker", "flask", "cylinder")),
    ),
    groups={"TUBES": ["centrifuge tube", "culture tube", "tube"]},
    vetoes={"glassware": ((), (), ("plastic",))},
)


@query(None)
def rule_classes(spark, d):
    df = R.table(spark, d, "category_file").select("entry_id", "product_desc")
    return rules.classify(df.withColumn("clean", F.lower("product_desc")), RULES, "entry_id", "clean", "product_desc")


_HY = "with p as (select suppliername s, avg(case when category like 'chem%' then 1.0 else 0 end) prior, count(*) n from category_file where suppliername is not null group by 1) select entry_id, case when coalesce(contains(lower(product_desc), 'shipping'), false) then 0 when coalesce(contains(lower(product_desc), 'antibody'), false) then 1 when coalesce(n >= 20, false) and coalesce(prior <= 0.05, false) then 0 when coalesce(n >= 20, false) and coalesce(prior >= 0.99, false) then 1 when coalesce(price, 0) / 100 >= 0.5 then 1 else 0 end label from category_file c left join p on p.s = c.suppliername"


@query(_HY)
def hybrid_label(spark, d):
    c = R.table(spark, d, "category_file").select("entry_id", "suppliername", "product_desc", "price", "category")
    p = c.filter("suppliername is not null").groupBy("suppliername").agg(F.avg(F.when(F.col("category").like("chem%"), 1.0).otherwise(0.0)).alias("prior"), F.count("*").alias("n"))
    t = F.lower("product_desc")
    out = rules.hybrid(t.contains("shipping"), t.contains("antibody"), F.col("price") / 100, prior=F.col("prior"), prior_n=F.col("n"))
    return c.join(p, "suppliername", "left").select("entry_id", out.alias("label"))


@query("select entry_id, case when coalesce(contains(lower(product_desc), 'shipping'), false) then 'fees' when category in (select category from categories) then category when coalesce(price > 100, false) then 'expensive' else 'other' end market, case when coalesce(contains(lower(product_desc), 'shipping'), false) then 'veto' when category in (select category from categories) then 'typed' when coalesce(price > 100, false) then 'price' else 'default' end src from category_file")
def prediction_cascade(spark, d):
    c = R.table(spark, d, "category_file").select("entry_id", "product_desc", "category", "price")
    k = R.cats(spark, d).select("category", F.lit(True).alias("known"))
    v, s = rules.cascade([("veto", F.lower("product_desc").contains("shipping"), F.lit("fees")), ("typed", F.col("known"), F.col("category")), ("price", F.col("price") > 100, F.lit("expensive"))], F.lit("other"))
    return c.join(k, "category", "left").select("entry_id", v.alias("market"), s.alias("src"))


def _settled_sql() -> str:
    s = ", r0 as (select supplier u, yr t, uni v, sum(1) w from lines where supplier is not null and yr is not null and uni is not null group by 1, 2, 3)"
    for k in range(3):
        s += f", q{k} as (select *, case when coalesce(t - lag(t) over w <= 5, false) and coalesce(lead(t) over w - t <= 5, false) then 3 when coalesce(t - lag(t) over w <= 5, false) then 2 when coalesce(lead(t) over w - t <= 5, false) then 1 else 0 end s from r{k} window w as (partition by u, v order by t)), r{k + 1} as (select u, t, v, w from (select *, max(s) over (partition by u, t) m from q{k}) where s = m)"
    return s + ", z as (select *, sum(w) over (partition by u, v) tot from r3) select u supplier, t yr, arg_min(v, struct_pack(a := -tot, b := v)) uni from z group by 1, 2"


@query(_settled_sql(), base=True)
def settle_affiliations(spark, d):
    df = R.lines(spark, d).filter("supplier is not null and yr is not null and uni is not null").withColumn("one", F.lit(1))
    return panel.settle_values(df, "supplier", "yr", "uni", "one", tie="least")


def _names(spark, d) -> DataFrame:
    return R.table(spark, d, "catalog_listings").select("suppliername").unionByName(R.table(spark, d, "category_file").select("suppliername")).unionByName(R.table(spark, d, "supplier_map").select("suppliername"))


@query(None)
def supplier_resolution(spark, d):
    return entities.resolve_suppliers(_names(spark, d), "suppliername")


@query(None)
def institution_crosswalk(spark, d):
    return entities.crosswalk(_names(spark, d), R.table(spark, d, "supplier_map").select("new_suppliername"), "suppliername", "new_suppliername", threshold=80.0)


@query(None)
def gatekeeper_scores(spark, d):
    """Logistic regression on item texts; every labelled row is scored."""
    df = R.table(spark, d, "training_dataset").select("record_id", "cleaned_description", F.col("label").cast("double").alias("label"))
    return models.score(models.gatekeeper(df, "cleaned_description", "label", ngrams=3, min_df=5), df.filter("label is not null"), ["record_id", "label"])


@query(None)
def kmeans_clusters(spark, d):
    got = models.cluster_vectors(R.table(spark, d, "embeddings").select("vec_id", "embedding", "label"), "embedding", k=10)
    out = got.groupBy("cluster").agg(F.count("*").alias("n"), F.countDistinct("label").alias("n_labels"))
    out._model = got._model
    return out


@query(None)
def pca_kmeans_clusters(spark, d):
    got = models.cluster_vectors(R.table(spark, d, "embeddings").select("vec_id", "embedding", "label"), "embedding", k=10, components=16)
    out = got.select("vec_id", "cluster")
    out._model = got._model
    return out


def _exposure_rows(spark, d) -> DataFrame:
    return R.table(spark, d, "ridge_vs_knn").filter("true_exposure between 0 and 1 and not isnan(true_exposure)").select("true_exposure", "pred_knn", "pred_ridge", F.col("max_sim_to_train").alias("sim"), F.col("n_train").cast("double").alias("n_train")).dropna()


@query(None)
def elastic_net_coefficients(spark, d):
    _, coef = models.elastic_net(_exposure_rows(spark, d), ["pred_knn", "pred_ridge", "sim"], "true_exposure", weight="n_train")
    return spark.createDataFrame([(k, v) for k, v in coef.items()], "term string, b double")


@query(None)
def forest_importance(spark, d):
    _, imp = models.forest(_exposure_rows(spark, d), ["pred_knn", "pred_ridge", "sim"], "true_exposure")
    return spark.createDataFrame([(k, v) for k, v in imp.items()], "feature string, importance double")


_LEX = "with w as (select distinct athr_id, unnest(string_split(processed_text, ' ')) t from author_text where processed_text is not null), l(t, k) as (values ('protein', 'core'), ('genom', 'core'), ('cell', 'core'), ('climat', 'anti'), ('ocean', 'anti'), ('imag', 'adj')) select athr_id, count(*) filter (k = 'core') core_hits, count(*) filter (k = 'adj') adj_hits, count(*) filter (k = 'anti') anti_hits, (count(*) filter (k = 'core') >= 1 and count(*) filter (k = 'anti') <= 1)::int keep from w left join l using (t) group by 1"
LEXICON = [("protein", "core"), ("genom", "core"), ("cell", "core"), ("climat", "anti"), ("ocean", "anti"), ("imag", "adj")]


@query(_LEX)
def lexicon_scores(spark, d):
    """Class hits of each author's words and the keep rule."""
    lex = spark.createDataFrame(LEXICON, "t string, k string")
    w = R.table(spark, d, "author_text").filter("processed_text is not null").select("athr_id", F.explode(F.split("processed_text", " ")).alias("t")).distinct()
    n = lambda k: F.count(F.when(F.col("k") == k, 1))
    g = w.join(lex, "t", "left").groupBy("athr_id").agg(n("core").alias("core_hits"), n("adj").alias("adj_hits"), n("anti").alias("anti_hits"))
    return g.withColumn("keep", ((F.col("core_hits") >= 1) & (F.col("anti_hits") <= 1)).cast("int"))


_TOP = "with w as (select athr_id, unnest(string_split(processed_text, ' ')) t from author_text where processed_text is not null), l as (select athr_id, max(cluster_label) c from cluster_labels where cluster_label is not null group by 1), x as (select c, t, count(*) n from w join l using (athr_id) where t <> '' group by 1, 2) select c cluster_label, t term, n from x qualify row_number() over (partition by c order by n desc, t) <= 15"


@query(_TOP)
def cluster_top_terms(spark, d):
    from pyspark.sql import Window

    lab = R.table(spark, d, "cluster_labels").filter("cluster_label is not null").groupBy("athr_id").agg(F.max("cluster_label").alias("cluster_label"))
    w = R.table(spark, d, "author_text").filter("processed_text is not null").select("athr_id", F.explode(F.split("processed_text", " ")).alias("term")).filter("term <> ''")
    x = w.join(lab, "athr_id").groupBy("cluster_label", "term").agg(F.count("*").alias("n"))
    return x.withColumn("r", F.row_number().over(Window.partitionBy("cluster_label").orderBy(F.desc("n"), "term"))).filter("r <= 15").drop("r")


@query("with t as (select doc_id, source, text, regexp_extract(text, '^([^:.]{3,40}):', 1) p from documents where text is not null), c as (select source, p, count(*) n from t where p <> '' group by 1, 2) select doc_id from t left join c on c.p = t.p and c.source = t.source where not (regexp_matches(lower(text), '^(invoice|refund|returned)') or contains(text, '?') or coalesce(n > 3, false))")
def title_filters(spark, d):
    """Drops notices, questions and texts whose leading 'name:' repeats within a source."""
    t = R.table(spark, d, "documents").filter("text is not null").select("doc_id", "source", "text", F.regexp_extract("text", "^([^:.]{3,40}):", 1).alias("p"))
    c = t.filter("p <> ''").groupBy("source", "p").agg(F.count("*").alias("n"))
    return t.join(c, ["source", "p"], "left").filter(~(F.lower("text").rlike("^(invoice|refund|returned)") | F.col("text").contains("?") | F.coalesce(F.col("n") > 3, F.lit(False)))).select("doc_id")


@query("select n_nationkey, n_name, r_name parent, coalesce(n.c, 0) n_customers from nation join region on n_regionkey = r_regionkey left join (select c_nationkey k, count(*) c from customer group by 1) n on n.k = n_nationkey")
def parent_rollup(spark, d):
    c = R.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    n = R.table(spark, d, "nation").join(R.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(c, "n_nationkey", "left").select("n_nationkey", "n_name", F.col("r_name").alias("parent"), F.coalesce("c", F.lit(0)).alias("n_customers"))


@query("select event_id, cast(json_extract(props, '$.k') as int) k from events")
def json_field(spark, d):
    return R.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("select record_id, label, case when contains(lower(cleaned_description), 'steel') then 1 else 0 end pred, case when label = 1 then 'missed' else 'wrong' end kind from training_dataset where label is not null and cleaned_description is not null and label <> case when contains(lower(cleaned_description), 'steel') then 1 else 0 end")
def confusion_tail(spark, d):
    """The rows a rule gets wrong, by kind of error."""
    t = R.table(spark, d, "training_dataset").filter("label is not null and cleaned_description is not null")
    pred = F.when(F.lower("cleaned_description").contains("steel"), 1).otherwise(0)
    return t.select("record_id", "label", pred.alias("pred"), F.when(F.col("label") == 1, "missed").otherwise("wrong").alias("kind")).filter("label <> pred")


@query("select c_custkey, coalesce(case when c_name like '%9' then 'nine' end, n_name, 'world') region_name from customer left join nation on n_nationkey = c_nationkey and n_nationkey < 20")
def geography_fill(spark, d):
    """A place from the name, else from a lookup, else the world."""
    n = R.table(spark, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return R.table(spark, d, "customer").join(n, "c_nationkey", "left").select("c_custkey", F.coalesce(F.when(F.col("c_name").endswith("9"), "nine"), "n_name", F.lit("world")).alias("region_name"))


@query("select record_id, case when cleaned_description is null or regexp_matches(lower(cleaned_description), 'old') then 0 when regexp_matches(lower(cleaned_description), 'steel|glass') then 1 when data_source like '%non_lab%' then 0 when regexp_matches(lower(cleaned_description), 'valve|tube') then 1 else coalesce(label, 0) end label from training_dataset")
def label_building(spark, d):
    """Labels in order: anti-seeds, seeds, sources outside, keywords, the given label."""
    t = F.lower("cleaned_description")
    v, _ = rules.cascade([("anti", t.isNull() | t.rlike("old"), F.lit(0)), ("seed", t.rlike("steel|glass"), F.lit(1)), ("source", F.col("data_source").like("%non_lab%"), F.lit(0)), ("market", t.rlike("valve|tube"), F.lit(1))], F.coalesce("label", F.lit(0)))
    return R.table(spark, d, "training_dataset").select("record_id", v.alias("label"))
