"""The engine's operators over the driver's tables, each with its SQL twin.

Roles of the tables: orders as scans of subjects (customers), documents as records with contents and labels, events as visits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions import rules
from holdfast.operators import audits, graph, joins, metrics, splits

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_CTES = {
    "scans": "select o_orderkey as image_id, o_custkey as subject_id, cast(o_orderdate as date) as acq_date, o_orderstatus as label, o_orderpriority as stratum from orders",
    "preds": "select d.doc_id, l.toxic::bigint as y_true, ((d.n_chars % 1000)::double / 1000) as y_prob, d.doc_id % 5 as seed, d.doc_id % 3 as protocol, d.lang as subgroup, d.source as subject_id from labels l join documents d using (doc_id)",
    "points0": "select seed, protocol, doc_id, y_true, y_prob, row_number() over (partition by seed, protocol order by y_prob desc, y_true desc, doc_id) as pos, sum(y_true) over w as tp, sum(1 - y_true) over w as fp, sum(y_true) over (partition by seed, protocol) as p, sum(1 - y_true) over (partition by seed, protocol) as n from preds window w as (partition by seed, protocol order by y_prob desc, y_true desc, doc_id rows unbounded preceding)",
    "points": "select seed, protocol, pos, y_prob as threshold, tp::double / p as sensitivity, 1 - fp::double / n as specificity from points0 where p > 0 and n > 0 union all select distinct seed, protocol, 0, null, 0.0::double, 1.0::double from points0 where p > 0 and n > 0",
    "shuf": "select *, row_number() over (order by sha1('7:' || image_id)) as pos, count(*) over () as n from scans",
    "rsplit": "select image_id, subject_id, label, acq_date, case when pos <= floor(n * 0.7::double) then 'train' when pos <= floor(n * 0.7::double) + floor(n * 0.15::double) then 'val' else 'test' end as split from shuf",
    "docrec": "select doc_id, source || '|' || lang as subject, sha256(text) as content, coalesce(lang, 'unknown') as label from documents",
    "sedges": "select a.src, d.doc_id as dst, 'same_subject' as reason from docrec d join (select subject, min(doc_id) as src from docrec group by 1) a using (subject) where a.src <> d.doc_id",
    "hedges": "select a.src, d.doc_id as dst, 'same_content' as reason from docrec d join (select content, min(doc_id) as src from docrec group by 1) a using (content) where a.src <> d.doc_id",
    "hcomp": "select doc_id, min(doc_id) over (partition by content) as component from docrec",
}


def _with(*names: str) -> str:
    return "with " + ", ".join(f"{n} as ({_CTES[n]})" for n in names) + " "


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def scans(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_custkey").alias("subject_id"), F.to_date("o_orderdate").alias("acq_date"), F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("stratum"))


def records(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("|"), "lang").alias("subject"), F.sha2("text", 256).alias("content"), F.coalesce("lang", F.lit("unknown")).alias("label"))


def predictions(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", F.col("toxic").cast("long").alias("y_true"), ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("y_prob"), (F.col("doc_id") % 5).alias("seed"), (F.col("doc_id") % 3).alias("protocol"), F.col("lang").alias("subgroup"), F.col("source").alias("subject_id"))


def r9(c, name):
    return F.round(c, 9).alias(name)


SP = ["seed", "protocol"]


# --- projections and scalar rules
@query("select o_orderkey as image_id, 'img_' || substr(sha1(o_orderkey::varchar), 1, 12) as token, case o_orderstatus when 'F' then 'CN' when 'O' then 'AD' else 'MCI' end as label, strftime(cast(o_orderdate as date), '%Y-%m-%d') as day, o_custkey || '__' || strftime(cast(o_orderdate as date), '%Y-%m-%d') as session_id from orders")
def rule_ids(spark, d):
    s = scans(spark, d)
    label = rules.recode(F.when(s.label == "F", "1").when(s.label == "O", "6").otherwise("4"), rules.DIAGNOSIS_CODES)
    return s.select("image_id", F.concat(F.lit("img_"), rules.stable_token(F.col("image_id").cast("string"))).alias("token"), label.alias("label"), F.col("acq_date").cast("string").alias("day"), rules.session_id(F.col("subject_id").cast("string"), F.lit(None).cast("string"), F.col("acq_date")).alias("session_id"))


@query("select c_custkey as subject, coalesce(nullif(trim(c_mktsegment), ''), c_name) as segment, try_cast(split_part(c_name, '#', 2) as int) as number, regexp_extract(c_name, '([0-9]+)$', 1) as digits from customer")
def rule_pick(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("subject"), rules.pick(c, "absent", "c_mktsegment", "c_name").alias("segment"), F.element_at(F.split("c_name", "#"), 2).try_cast("int").alias("number"), F.regexp_extract("c_name", r"([0-9]+)$", 1).alias("digits"))


@query("""select event_id, case when event_type in ('click', 'view') then 'NonDemented' when event_type in ('purchase', 'signup') then 'Demented' else 'Unknown' end as binary_label from events""")
def rule_binary(spark, d):
    return table(spark, d, "events").select("event_id", rules.binary_label(F.col("event_type"), {"click", "view"}, {"purchase", "signup"}).alias("binary_label"))


@query("""with sized as (select p_partkey as volume, p_size::int as n from part), o as (select unnest([-20, -10, 0, 10, 20])::int as slice_offset)
select volume, slice_offset, (n // 2 + slice_offset)::int as slice_index from sized, o where n // 2 + slice_offset >= 0 and n // 2 + slice_offset < n""")
def slice_offsets(spark, d):
    volumes = table(spark, d, "part").select(F.col("p_partkey").alias("volume"), F.explode(rules.slice_indexes(F.col("p_size").cast("int"))).alias("s"))
    return volumes.select("volume", F.col("s.offset").alias("slice_offset"), F.col("s.index").alias("slice_index"))


@query("""with lim as (select vec_id, embedding, quantile_cont(x, 0.01) as lo, quantile_cont(x, 0.99) as hi from (select vec_id, embedding, unnest(embedding)::double as x from embeddings) where x > 0 group by all)
select vec_id, round(list_sum(list_transform(embedding, lambda x: least(greatest((x::double - lo) / (hi - lo), 0), 1) * 255)), 6) as total from lim""")
def intensity_normalise(spark, d):
    scaled = rules.normalise_intensity(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# --- joins





@query(_with("scans") + ", c as (select s.image_id, o.acq_date as examdate, abs(date_diff('day', s.acq_date, o.acq_date)) as gap, o.stratum as code, row_number() over (partition by s.image_id order by abs(date_diff('day', s.acq_date, o.acq_date)), o.acq_date, o.image_id) as r from scans s join scans o on o.subject_id = s.subject_id and o.image_id <> s.image_id) select s.image_id, s.subject_id, c.examdate as matched_day, c.gap::int as gap_days, c.code from scans s left join c on c.image_id = s.image_id and c.r = 1 and c.gap <= 180")
def asof_nearest_all(spark, d):
    s = scans(spark, d)
    right = s.select("subject_id", F.col("acq_date").alias("examdate"), F.col("stratum").alias("code"), F.col("image_id").alias("ord"))
    return joins.nearest(s.select("image_id", "subject_id", "acq_date"), right, "subject_id", "image_id", "acq_date", "examdate", "ord", 180, ["code"], others=True).drop("acq_date")


@query("select o.o_orderkey as image_id, coalesce(c.c_mktsegment, n.n_name, 'x') as dx, case when c.c_mktsegment is not null then 'subject' when n.n_name is not null then 'nation' else 'none' end as dx_source from orders o left join (select c_custkey, c_mktsegment from customer where c_acctbal > 0) c on c.c_custkey = o.o_custkey left join (select c2.c_custkey, n.n_name from customer c2 join nation n on n.n_nationkey = c2.c_nationkey) n on n.c_custkey = o.o_custkey")
def cascade_lookup(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    first = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("dx"))
    second = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("subject_id"), F.col("n_name").alias("dx"))
    out = joins.cascade(scans(spark, d).select("image_id", "subject_id"), [("subject", first, ["subject_id"]), ("nation", second, ["subject_id"])], "dx")
    return out.select("image_id", F.coalesce("dx", F.lit("x")).alias("dx"), "dx_source")


@query("select o_custkey as subject_id, o_orderpriority as visit, max_by(o_orderkey, (o_orderdate, o_orderkey)) as image_id, max_by(o_orderstatus, (o_orderdate, o_orderkey)) as label from orders group by all")
def last_row_wins(spark, d):
    visits = table(spark, d, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderpriority").alias("visit"), F.col("o_orderdate").alias("day"), F.col("o_orderkey").alias("image_id"), F.col("o_orderstatus").alias("label"))
    return joins.latest_per_key(visits, ["subject_id", "visit"], "day").select("subject_id", "visit", "image_id", "label")


@query("select subject_id, event_types, first_type from (select user_id as subject_id, count(distinct event_type)::bigint as event_types, min_by(event_type, event_id) as first_type from events group by 1)")
def first_non_empty(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("subject_id")).agg(F.countDistinct("event_type").alias("event_types"), F.min_by("event_type", "event_id").alias("first_type"))


_RS = _with("scans", "shuf", "rsplit")


@query(_RS + ", k as (select subject_id, bool_or(split = 'train') as tr, bool_or(split = 'val') as va, bool_or(split = 'test') as te from rsplit group by 1) select 'train' as left_split, 'val' as right_split, count(*) filter (where tr and va)::bigint as shared from k union all select 'train', 'test', count(*) filter (where tr and te) from k union all select 'val', 'test', count(*) filter (where va and te) from k")
def split_overlap(spark, d):
    return joins.split_overlap(splits.random_split(scans(spark, d), "image_id", 7), "subject_id", "split", ["train", "val", "test"])


@query(_RS + ", k as (select subject_id, bool_or(split = 'train') as tr, bool_or(split = 'test') as te from rsplit group by 1) select count(*) filter (where tr and te)::bigint as overlap, count(*) filter (where te)::bigint as test_keys, round(count(*) filter (where tr and te) * 100.0::double / count(*) filter (where te), 9) as contamination_pct from k")
def contamination(spark, d):
    out = joins.contamination(splits.random_split(scans(spark, d), "image_id", 7), "subject_id", "split")
    return out.withColumn("contamination_pct", F.round("contamination_pct", 9))


@query("select r_regionkey, seg from region cross join (select distinct c_mktsegment as seg from customer) where not exists (select 1 from customer c join nation n on n.n_nationkey = c.c_nationkey where n.n_regionkey = r_regionkey and c.c_mktsegment = seg and c.c_acctbal > 9950)")
def missing_grid_cells(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    found = c.where("c_acctbal > 9950").join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.col("n_regionkey").alias("r_regionkey"), F.col("c_mktsegment").alias("seg"))
    return joins.missing_cells(found, [table(spark, d, "region").select("r_regionkey"), c.select(F.col("c_mktsegment").alias("seg")).distinct()])


@query("with r as (select * from (values (0, 80, 1), (80, 200, 2), (150, 100000000, 3)) t(lo, hi, disc)) select o_orderkey as image_id, (select min(disc) from r where o_custkey between lo and hi)::int as disc from orders")
def range_lookup(spark, d):
    r = spark.sql("select * from values (0, 80, 1), (80, 200, 2), (150, 100000000, 3) as t(lo, hi, disc)")
    s = scans(spark, d)
    width = 1_000_000  # the widest range spans a hundred bins
    return joins.range_lookup(s.select("image_id", "subject_id"), r, "subject_id", "lo", "hi", "disc", width).select("image_id", "disc")


@query("select c_custkey, exists (select 1 from orders where o_custkey = c_custkey) as has_scan from customer")
def exists_join(spark, d):
    o = scans(spark, d).select(F.col("subject_id").alias("c_custkey"))
    return joins.exists_flag(table(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], "has_scan")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def anti_join(spark, d):
    urgent = scans(spark, d).where("stratum = '1-URGENT'").select(F.col("subject_id").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@query("select o_orderkey as image_id from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def semi_join(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("subject_id"))
    return scans(spark, d).join(c, "subject_id", "left_semi").select("image_id")


_HASH = "with h as (select vec_id, list_reduce(list_prepend(0::bigint, list_transform(range(1, len(embedding)), lambda i: (embedding[i] > embedding[i + 1])::bigint)), lambda a, b: a * 2 + b) as h from embeddings) "


#: Small images of parts: those of one kind differ in a few pixels.
_PIXELS = "list_transform(range(272), lambda i: ((p_partkey % 40 + 1) * 31 + i * 17 + i * i * (p_partkey % 40)) % 97 + case when p_partkey % 3 = 0 and i = p_partkey % 271 then 200 when p_partkey % 7 = 0 and i = (p_partkey * 5) % 271 then -200 else 0 end)"
_GRID_HASH = f"""with px as (select p_partkey as image_id, p_brand as label, p_type as subject_id, {_PIXELS} as v from part),
h as (select image_id, label, subject_id, list_transform(range(256), lambda n: (v[(n // 16) * 17 + n % 16 + 1] > v[(n // 16) * 17 + n % 16 + 2])::int) as bits from px),
c as (select bits, min(image_id) as id, count(*) as size from h group by 1),
near as (select a.id as id_a, b.id as id_b, list_sum(list_transform(list_zip(a.bits, b.bits), lambda x: (x[1] <> x[2])::int))::int as distance, a.size::bigint as size_a, b.size::bigint as size_b from c a join c b on a.id < b.id),
pairs as (select * from near where distance <= 4) """


def hashed_images(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    base = lambda i: ((k % 40 + 1) * 31 + i * 17 + i * i * (k % 40)) % 97
    spot = lambda i: F.when((k % 3 == 0) & (i == k % 271), 200).when((k % 7 == 0) & (i == (k * 5) % 271), -200).otherwise(0)
    pixels = F.transform(F.sequence(F.lit(0), F.lit(271)), lambda i: base(i) + spot(i))
    return table(spark, d, "part").select(k.alias("image_id"), F.col("p_brand").alias("label"), F.col("p_type").alias("subject_id"), rules.grid_hash(pixels).alias("words"))


@query(_GRID_HASH + "select * from pairs")
def near_hash_pairs(spark, d):
    return joins.near_hashes(hashed_images(spark, d), "image_id", "words", 4)


@query(_GRID_HASH + "select image_id as id, id as representative from h join c using (bits)")
def near_hash_classes(spark, d):
    return joins.hash_classes(hashed_images(spark, d), "image_id", "words")


@query(_GRID_HASH + "select distance, sum(n)::bigint as pairs from (select distance, size_a * size_b as n from pairs union all select 0, size * (size - 1) // 2 from c where size > 1) group by 1")
def near_hash_counts(spark, d):
    rows = hashed_images(spark, d)
    return joins.near_counts(joins.near_hashes(rows, "image_id", "words", 4), joins.hash_sizes(rows, "image_id", "words"))


@query(_GRID_HASH + "select * from pairs order by distance, id_a, id_b limit 50")
def near_hash_report(spark, d):
    return joins.capped(joins.near_hashes(hashed_images(spark, d), "image_id", "words", 4), 50)


@query(_GRID_HASH + "select pairs.*, a.subject_id = b.subject_id as same_subject, a.label = b.label as same_class, 'review_only_not_split_blocking' as policy from pairs join h a on a.image_id = id_a join h b on b.image_id = id_b")
def near_hash_flags(spark, d):
    rows = hashed_images(spark, d)
    return graph.near_flags(joins.near_hashes(rows, "image_id", "words", 4), rows, "image_id", "subject_id", "label")


@query(_HASH + "select vec_id, h as dhash from h")
def difference_hash(spark, d):
    return table(spark, d, "embeddings").select("vec_id", rules.difference_hash(F.col("embedding")).alias("dhash"))


# --- aggregations
@query("select coalesce(event_type, 'missing') as k, count(*)::bigint as n, count(distinct user_id)::bigint as subjects from events group by 1")
def count_with_missing(spark, d):
    return table(spark, d, "events").groupBy(F.coalesce("event_type", F.lit("missing")).alias("k")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("subjects"))


@query("select 'text' as name, count(*) filter (where text is null or trim(text) = '')::bigint as missing from documents union all select 'lang', count(*) filter (where lang is null or trim(lang) = '') from documents union all select 'source', count(*) filter (where source is null or trim(source) = '') from documents")
def missingness(spark, d):
    return audits.missingness(table(spark, d, "documents"), ["text", "lang", "source"])


@query("select coalesce(l_returnflag, 'total') as suffix, count(*)::bigint as files, sum(l_quantity)::double as bytes from lineitem group by rollup(l_returnflag)")
def suffix_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag").agg(F.count("*").alias("files"), F.sum("l_quantity").cast("double").alias("bytes")).select(F.coalesce("l_returnflag", F.lit("total")).alias("suffix"), "files", "bytes")


@query(_RS + "select s.split, l.label, count(r.image_id)::bigint as n, round(count(r.image_id)::double / sum(count(r.image_id)) over (partition by s.split), 9) as share from (values ('train'), ('val'), ('test')) s(split) cross join (select distinct label from scans) l left join rsplit r on r.split = s.split and r.label = l.label group by 1, 2")
def split_shares(spark, d):
    s = splits.random_split(scans(spark, d), "image_id", 7)
    grid = spark.sql("select * from values ('train'), ('val'), ('test') as t(split)").crossJoin(F.broadcast(s.select("label").distinct()))  # a few rows
    n = grid.join(s.groupBy("split", "label").agg(F.count("*").alias("n")), ["split", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("split")), 9))


@query("select c_mktsegment as grp, count(*)::bigint as subjects, round(avg(c_acctbal), 6) as mean, round(stddev_pop(c_acctbal), 6) as sd_pop, round(coalesce(stddev_samp(c_acctbal), 0), 6) as sd, round(quantile_cont(c_acctbal, 0.5), 6) as median, round(quantile_cont(c_acctbal, 0.025), 6) as low from customer group by 1")
def demographics(spark, d):
    x = F.col("c_acctbal")
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("grp")).agg(F.count("*").alias("subjects"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("sd_pop"), F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 6).alias("sd"), F.round(F.median(x), 6).alias("median"), F.round(F.percentile(x, F.lit(0.025)), 6).alias("low"))


@query(_with("scans") + ", n as (select subject_id, label, count(*) as n, min(image_id) as f from scans group by all) select subject_id, label as majority from (select *, row_number() over (partition by subject_id order by n desc, f) as r from n) where r = 1")
def majority_label(spark, d):
    return audits.majority(scans(spark, d), "subject_id", "label", "image_id")


@query("select content, count(*)::bigint as images, min(doc_id) as first_id from (select sha256(text) as content, doc_id from documents) group by 1 having count(*) > 1")
def duplicate_groups(spark, d):
    return records(spark, d).groupBy("content").agg(F.count("*").alias("images"), F.min("doc_id").alias("first_id")).where("images > 1")


@query(_with("scans") + "select subject_id, arg_min(image_id, (acq_date, image_id)) as first_image, min(acq_date) as first_day, case max(case label when 'O' then 3 when 'F' then 2 else 1 end) when 3 then 'O' when 2 then 'F' else 'P' end as worst from scans group by 1")
def earliest_and_priority(spark, d):
    rank = F.when(F.col("label") == "O", 3).when(F.col("label") == "F", 2).otherwise(1)
    return scans(spark, d).groupBy("subject_id").agg(F.min_by("image_id", F.struct("acq_date", "image_id")).alias("first_image"), F.min("acq_date").alias("first_day"), F.max_by(F.when(F.col("label").isin("O", "F"), F.col("label")).otherwise("P"), rank).alias("worst"))


@query(_with("preds") + "select seed, protocol, subject_id, round(avg(y_prob), 9) as y_prob, (sum(y_true) * 2 > count(*))::int as y_true from preds group by all")
def subject_fold(spark, d):
    return predictions(spark, d).groupBy("seed", "protocol", "subject_id").agg(r9(F.avg("y_prob"), "y_prob"), (F.sum("y_true") * 2 > F.count("*")).cast("int").alias("y_true"))


@query(_with("preds") + ", m as (select protocol, subgroup, seed, avg(y_true) as prevalence from preds group by grouping sets ((protocol, seed), (protocol, subgroup, seed))) select protocol, coalesce(subgroup, 'overall') as grp, round(avg(prevalence), 9) as prevalence, count(*)::bigint as seeds from m group by 1, 2")
def subgroup_prevalence(spark, d):
    keyed = predictions(spark, d).withColumn("grp", F.explode(F.array(F.lit("overall"), "subgroup")))
    return keyed.groupBy("protocol", "grp", "seed").agg(F.avg("y_true").alias("p")).groupBy("protocol", "grp").agg(r9(F.avg("p"), "prevalence"), F.count("*").alias("seeds"))


@query(_with("preds") + "select protocol, round(count(*) filter (where y_true = 0)::double / greatest(1, count(*) filter (where y_true = 1)), 9) as weight from preds group by 1")
def class_weight(spark, d):
    return audits.class_weight(predictions(spark, d), ["protocol"]).withColumn("weight", F.round("weight", 9))


@query("select p_brand as class, count(*)::bigint as images, count(distinct p_type)::bigint as subjects, count(*) filter (where p_size > 40)::bigint as odd, round(count(*) filter (where p_size > 40) * 100.0::double / count(*), 6) as odd_pct from part group by 1")
def class_profile(spark, d):
    return audits.class_profile(table(spark, d, "part"), "p_brand", "p_type", F.col("p_size") > 40, {"Brand#13": 0}).withColumn("odd_pct", F.round("odd_pct", 6))


# --- graph
def _edges(spark, d):
    r = records(spark, d)
    return r, graph.star_edges(r, "doc_id", ["subject"], "same_subject").unionByName(graph.star_edges(r, "doc_id", ["content"], "same_content"))


@query(_with("docrec", "sedges", "hedges") + "select * from sedges union all select * from hedges")
def star_edges(spark, d):
    return _edges(spark, d)[1]


@query(_with("docrec", "sedges", "hedges").replace("with ", "with recursive ", 1) + ", subj as (select subject, min(doc_id) as s from docrec group by 1), adj as (select distinct a.subject as x, b.subject as y from docrec a join docrec b using (content)), reach(x, y) as (select x, y from adj union select r.x, a.y from reach r join adj a on a.x = r.y), root as (select r.x as subject, min(s.s) as component from reach r join subj s on s.subject = r.y group by 1) select d.doc_id, root.component from docrec d join root using (subject)")
def connected_components(spark, d):
    r, edges = _edges(spark, d)
    return graph.components(r, "doc_id", edges)


def _content_components(spark, d):
    r = records(spark, d)
    edges = graph.star_edges(r, "doc_id", ["content"], "same_content")
    return r, graph.components(r, "doc_id", edges), edges


@query(_with("docrec", "hcomp") + "select component, count(*)::bigint as size, case when count(*) > 1 then 'same_content' else 'singleton' end as reason from hcomp group by 1")
def component_reasons(spark, d):
    _, members, edges = _content_components(spark, d)
    return graph.component_reasons(members, "doc_id", edges)


@query(_with("docrec", "hcomp") + "select component, 'comp_' || substr(sha1(string_agg(doc_id::varchar, ';' order by doc_id)), 1, 12) as component_id from hcomp group by 1")
def component_content_ids(spark, d):
    return graph.content_ids(_content_components(spark, d)[1], "doc_id")


@query(_with("docrec", "hcomp") + "select component, case when min(label) = max(label) then min(label) else 'mixed_label' end as component_label from hcomp join docrec using (doc_id) group by 1")
def component_labels(spark, d):
    r, members, _ = _content_components(spark, d)
    return graph.component_labels(members.join(r, "doc_id"), "label")


@query(_with("docrec", "hcomp") + "select size, count(*)::bigint as components from (select count(*) as size from hcomp group by component) group by 1")
def component_sizes(spark, d):
    return graph.size_histogram(_content_components(spark, d)[1])


@query(_with("docrec", "hcomp") + "select component, format('component_{:05d}', dense_rank() over (order by component) - 1) as ordinal from (select distinct component from hcomp)")
def component_ordinals(spark, d):
    return graph.ordinal_ids(_content_components(spark, d)[1])


@query(_RS + "select subject_id, count(distinct split)::bigint as splits, count(*)::bigint as rows from rsplit group by 1 having count(distinct split) > 1")
def orphan_components(spark, d):
    return graph.orphans(splits.random_split(scans(spark, d), "image_id", 7), "subject_id", "split")


@query(_with("docrec", "hedges", "hcomp") + "select 'nodes' as name, count(*)::bigint as n from hcomp union all select 'components', count(distinct component) from hcomp union all select 'edges', count(*) from hedges union all select 'edges same_content', count(*) from hedges")
def graph_summary(spark, d):
    _, members, edges = _content_components(spark, d)
    return graph.summary(members, edges)


# --- splits
@query(_RS + "select image_id, split from rsplit")
def random_split(spark, d):
    return splits.random_split(scans(spark, d), "image_id", 7).select("image_id", "split")


@query(_with("scans") + ", s as (select subject_id, row_number() over (order by sha1('7:' || subject_id)) as pos, count(*) over () as n from (select distinct subject_id from scans)) select image_id, case when pos <= floor(n * 0.7::double) then 'train' when pos <= floor(n * 0.7::double) + floor(n * 0.15::double) then 'val' else 'test' end as split from scans join s using (subject_id)")
def group_split(spark, d):
    return splits.group_split(scans(spark, d), "subject_id", 7).select("image_id", "split")


@query(_with("scans") + "select stratum, count(*)::bigint as n, round_even(count(*) * 0.7::double, 0)::bigint as train, round_even(count(*) * 0.15::double, 0)::bigint as val, (count(*) - round_even(count(*) * 0.7::double, 0) - round_even(count(*) * 0.15::double, 0))::bigint as test from scans group by 1")
def split_targets(spark, d):
    n = scans(spark, d).groupBy("stratum").agg(F.count("*").alias("n"))
    return n.select("stratum", "n", *[c.alias(x) for c, x in zip(splits.targets(F.col("n")), ("train", "val", "test"), strict=True)])


def _components(spark, d):
    per = scans(spark, d).groupBy("subject_id").agg(F.count("*").alias("size"), F.max("stratum").alias("stratum"))
    return per


_SIZED = _with("scans") + """, per as (select subject_id, count(*) as size, max(stratum) as stratum from scans group by 1), n as (select stratum, sum(size) as n, count(*) as components from per group by 1),
w as (select stratum, n, round_even(n * 0.15::double, 0) as val, n - round_even(n * 0.7::double, 0) - round_even(n * 0.15::double, 0) as test from n)"""


@query(_SIZED.replace("with ", "with recursive ", 1) + """, sz as (select stratum, size, count(*) as c, row_number() over (partition by stratum order by size) as i from per group by 1, 2),
lim as (select w.stratum, w.n, val, val + max(size) as most, max(i) as last from w join sz using (stratum) group by w.stratum, w.n, val),
reach(stratum, i, s) as (select stratum, 0::bigint, 0::bigint from lim union select r.stratum, r.i + 1, r.s + j.j * z.size from reach r join lim l using (stratum) join sz z on z.stratum = r.stratum and z.i = r.i + 1 join range(0, 5000) j(j) on j.j <= z.c and r.s + j.j * z.size <= l.most),
best as (select r.stratum, s, row_number() over (partition by r.stratum order by abs(s - val), s > val, s) as k from reach r join lim l on l.stratum = r.stratum and r.i = l.last)
select l.stratum, l.n::bigint as n, l.val::bigint as target, s::bigint as achieved from lim l join best b on b.stratum = l.stratum and k = 1""")
def component_split_optimum(spark, d):
    """What the validation part gets of its target: the best sum of whole components that there is."""
    got = splits.allocate_components(_components(spark, d), "stratum", "subject_id", "size", 7, exact=True)
    sums = got.groupBy("stratum").agg(F.sum("size").alias("n"), F.coalesce(F.sum(F.when(F.col("split") == "val", F.col("size"))), F.lit(0)).alias("achieved"))
    return sums.select("stratum", "n", splits.targets(F.col("n"))[1].alias("target"), "achieved")


@query(_SIZED + "select subject_id, size::bigint as size, stratum, 1::bigint as splits from per")
def component_split_whole(spark, d):
    """Each component is allocated once, whole and in its stratum; greedily here."""
    got = splits.allocate_components(_components(spark, d), "stratum", "subject_id", "size", 7, exact=False)
    return got.groupBy("subject_id", "size", "stratum").agg(F.countDistinct("split").alias("splits"))


@query()
def component_split_exact(spark, d):
    return splits.allocate_components(_components(spark, d), "stratum", "subject_id", "size", 7, exact=True)


@query()
def component_split_greedy(spark, d):
    return splits.allocate_components(_components(spark, d), "stratum", "subject_id", "size", 7, exact=False)


@query()
def achieved_vs_target(spark, d):
    got = splits.allocate_components(_components(spark, d), "stratum", "subject_id", "size", 7)
    n = got.groupBy("stratum").agg(F.sum("size").alias("n"))
    want = n.select("stratum", F.explode(F.array(*[F.struct(F.lit(x).alias("split"), c.alias("target")) for c, x in zip(splits.targets(F.col("n")), ("train", "val", "test"), strict=True)])).alias("w")).select("stratum", "w.*")
    return want.join(got.groupBy("stratum", "split").agg(F.sum("size").alias("achieved"), F.count("*").alias("components")), ["stratum", "split"], "left")


#: Subjects of one class each, split by subject; the injection written from its definition, share 0.3 and seed 5.
_SUBJECT_SPLIT = """, s0 as (select subject_id, row_number() over (order by sha1('7:' || subject_id)) as pos, count(*) over () as n from (select distinct subject_id from scans)),
cls as (select subject_id, min(label) as component_label from scans group by 1),
gs as (select scans.*, component_label, case when pos <= floor(n * 0.7::double) then 'train' when pos <= floor(n * 0.7::double) + floor(n * 0.15::double) then 'val' else 'test' end as split from scans join s0 using (subject_id) join cls using (subject_id))"""
_INJECTED = """, tests as (select * from gs where split = 'test' and component_label in ('F', 'O')),
usable as (select *, row_number() over (partition by subject_id order by acq_date, image_id) as k, count(*) over (partition by subject_id) as m from gs where split = 'train' and component_label in ('F', 'O') and label = component_label),
pool as (select * from usable where m >= 2),
donor as (select subject_id, component_label, row_number() over (partition by component_label order by sha1('5:' || subject_id)) - 1 as rank, count(*) over (partition by component_label) as donors from pool where k = 1),
nt as (select count(*) as n, count(*) filter (where component_label = 'F') as f from tests),
want as (select n, f, least(round_even(SHARE::double * n, 0), (select count(*) from donor)) as w from nt),
quota as (select 'F' as component_label, round_even(f::double / n * w, 0) as q from want union all select 'O', w - round_even(f::double / n * w, 0) from want),
turns as (select pool.image_id, pool.component_label, (k - 1) * donors + rank as step, row_number() over (partition by pool.component_label order by k, rank) as turn from pool join donor using (subject_id)),
moved as (select image_id from turns join quota using (component_label) where turn <= q and step < 10 * greatest(1, q)),
gone as (select image_id from (select image_id, component_label, row_number() over (partition by component_label order by sha1('6:' || image_id)) as r from tests) join quota using (component_label) where r <= q),
result as (select image_id, subject_id, component_label, case when image_id in (select image_id from moved) then 'test' else split end as split, image_id in (select image_id from moved) as injected from gs where image_id not in (select image_id from gone)) """


def subject_split(spark, d) -> DataFrame:
    rows = scans(spark, d)
    classes = rows.groupBy("subject_id").agg(F.min("label").alias("component_label"))
    return splits.group_split(rows, "subject_id", 7).join(classes, "subject_id")


def _injected(rows: DataFrame, share: float) -> DataFrame:
    return splits.inject_leakage(rows, share, 5, label="component_label", visit_label="label", classes=("F", "O"))


@query(_with("scans") + _SUBJECT_SPLIT + _INJECTED.replace("SHARE", "0.3") + "select image_id, split, injected from result")
def leakage_injection(spark, d):
    return _injected(subject_split(spark, d), 0.3).select("image_id", "split", "injected")


@query(_with("scans") + _SUBJECT_SPLIT + _INJECTED.replace("SHARE", "0.75") + """select 0.75::double as target, round(count(*) filter (where injected)::double / count(*) filter (where mine), 9) as actual, count(*) filter (where mine)::bigint as n_test, count(*) filter (where injected)::bigint as n_overlap,
count(distinct subject_id) filter (where injected)::bigint as n_donors_used, (select count(*) from tests where component_label = 'F')::bigint as before_F, (select count(*) from tests where component_label = 'O')::bigint as before_O,
count(*) filter (where mine and component_label = 'F')::bigint as after_F, count(*) filter (where mine and component_label = 'O')::bigint as after_O, count(*) filter (where split = 'train')::bigint as n_train, count(*) filter (where split = 'val')::bigint as n_val
from (select *, split = 'test' and component_label in ('F', 'O') as mine from result)""")
def injection_audit(spark, d):
    rows = subject_split(spark, d)
    audit = splits.injection_audit(rows, _injected(rows, 0.75), 0.75, label="component_label", classes=("F", "O"))
    return audit.withColumn("actual", F.round("actual", 9))


@query(_with("scans") + ", r as (select image_id, subject_id, row_number() over (partition by subject_id order by sha1('3:' || image_id)) as r, count(*) over (partition by subject_id) as n from scans) select image_id, case when r <= greatest(1, floor(n * 0.8::double)) then 'fit' else 'probe' end as fold from r where n >= 2")
def within_group_split(spark, d):
    return splits.within_group_split(scans(spark, d), "subject_id", "image_id", 3).select("image_id", "fold")


@query(_with("scans") + """, n as (select label, count(*) as n, row_number() over (order by label) - 1 as i from scans where label in ('F', 'O', 'P') group by 1),
t0 as (select least(n, greatest(1, 100 // 3)) as take from n where label = 'F'), t1 as (select least(n, greatest(1, (100 - (select take from t0)) // 2)) as take from n where label = 'O'),
t2 as (select least(n, greatest(1, 100 - (select take from t0) - (select take from t1))) as take from n where label = 'P'),
r as (select image_id, label, row_number() over (partition by label order by sha1('1:' || image_id)) as r from scans)
select image_id from r where r <= case label when 'F' then (select take from t0) when 'O' then (select take from t1) else (select take from t2) end""")
def stratified_limit(spark, d):
    return splits.stratified_limit(scans(spark, d), "label", "image_id", 100, 1, ("F", "O", "P")).select("image_id")


@query("select s.seed::int as seed, o.overlap::int as overlap from range(0, 5) s(seed) cross join (values (0), (25), (50), (75), (100)) o(overlap) where not (s.seed = 1 and o.overlap = 50)")
def experiment_grid(spark, d):
    grid = spark.range(5).select(F.col("id").cast("int").alias("seed")).crossJoin(spark.sql("select * from values (0), (25), (50), (75), (100) as t(overlap)"))
    return grid.join(spark.sql("select 1 as seed, 50 as overlap"), ["seed", "overlap"], "left_anti")


# --- metrics
@query(_with("preds") + ", r as (select seed, protocol, y_true, rank() over w + (count(*) over (partition by seed, protocol, y_prob) - 1) / 2.0::double as mid from preds window w as (partition by seed, protocol order by y_prob)), s as (select seed, protocol, sum(y_true) as p, count(*) - sum(y_true) as n, sum(mid) filter (where y_true = 1) as rs from r group by all) select seed, protocol, p::bigint as n_pos, n::bigint as n_neg, round((rs - p * (p + 1) / 2.0::double) / nullif(p * n, 0), 9) as auroc from s")
def auroc(spark, d):
    return metrics.auroc(predictions(spark, d), SP).withColumn("auroc", F.round("auroc", 9))


_PTS = _with("preds", "points0", "points")


def _points(spark, d):
    return metrics.roc_points(predictions(spark, d), SP, "doc_id")


@query(_PTS + "select seed, protocol, pos::int as pos, threshold, round(sensitivity, 9) as sensitivity, round(specificity, 9) as specificity from points")
def roc_points(spark, d):
    return _points(spark, d).withColumns({c: F.round(c, 9) for c in ("sensitivity", "specificity")})


@query(_PTS + ", xy as (select distinct seed, protocol, 1 - specificity as x, sensitivity as y from points), a as (select seed, protocol, (x - lag(x) over w) * (y + lag(y) over w) / 2 as a from xy window w as (partition by seed, protocol order by x, y)) select seed, protocol, round(sum(a), 9) as area from a group by all")
def trapezoid_area(spark, d):
    return metrics.trapezoid(_points(spark, d), SP).withColumn("area", F.round("area", 9))


@query(_PTS + "select seed, protocol, round(coalesce(max(sensitivity) filter (where specificity >= 0.9::double), 0), 9) as sensitivity from points group by all")
def sensitivity_at_specificity(spark, d):
    return metrics.sensitivity_at(_points(spark, d), SP).withColumn("sensitivity", F.round("sensitivity", 9))


@query(_PTS + "select seed, protocol, threshold, round(j, 9) as j from (select *, row_number() over (partition by seed, protocol order by j desc, pos) as r from (select *, round(sensitivity + specificity - 1, 12) as j from points)) where r = 1")
def youden(spark, d):
    return metrics.youden(_points(spark, d), SP).select(*SP, "threshold", F.round("j", 9).alias("j"))


@query(_with("preds") + """, c as (select seed, protocol, count(*) filter (where y_prob >= 0.5 and y_true = 1)::bigint as tp, count(*) filter (where y_prob >= 0.5 and y_true = 0)::bigint as fp,
count(*) filter (where y_prob < 0.5 and y_true = 1)::bigint as fn, count(*) filter (where y_prob < 0.5 and y_true = 0)::bigint as tn, avg((y_prob - y_true) ** 2) as brier from preds group by all),
r as (select *, case when tp + fn > 0 then tp::double / (tp + fn) else 0 end as sens, case when tn + fp > 0 then tn::double / (tn + fp) else 0 end as spec from c)
select seed, protocol, tp, fp, fn, tn, round((tp + tn)::double / (tp + fp + fn + tn), 9) as accuracy, round((sens + spec) / 2, 9) as balanced_accuracy, round(case when 2 * tp + fp + fn > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end, 9) as f1, round(sens, 9) as sensitivity, round(spec, 9) as specificity, round(brier, 9) as brier from r""")
def confusion(spark, d):
    found = metrics.confusion(predictions(spark, d), SP)
    return found.withColumns({c: F.round(c, 9) for c in ("accuracy", "balanced_accuracy", "f1", "sensitivity", "specificity", "brier")})


def _ece(closed: bool) -> str:
    inside = "y_prob between lo and hi" if closed else "y_prob >= lo and (y_prob < hi or i = 9)"
    return _with("preds") + f", e as (select i, i * 0.1::double as lo, (i + 1) * 0.1::double as hi from range(0, 10) t(i)), c as (select seed, protocol, i, count(*) as n, avg(((y_prob >= 0.5)::int = y_true)::int) as acc, avg(greatest(y_prob, 1 - y_prob)) as conf from preds join e on {inside} group by all), t as (select seed, protocol, count(*) as t from preds group by all) select seed, protocol, round(sum(n::double / t * abs(acc - conf)), 9) as ece from c join t using (seed, protocol) group by all"


@query(_ece(False))
def calibration_error(spark, d):
    return metrics.calibration(predictions(spark, d), SP).withColumn("ece", F.round("ece", 9))


@query(_ece(True))
def calibration_error_closed(spark, d):
    return metrics.calibration(predictions(spark, d), SP, both_closed=True).withColumn("ece", F.round("ece", 9))


def _seed_means(spark, d):
    return predictions(spark, d).groupBy("protocol", "seed").agg(F.avg("y_prob").alias("v"))


_BOOT = _with("preds") + ", v as (select protocol, seed, avg(y_prob) as v from preds group by all), pl as (select protocol, v, row_number() over (partition by protocol order by seed) - 1 as i, count(*) over (partition by protocol) as n from v), dr as (select distinct protocol, b, k, (('0x' || substr(sha1('11:' || b || ':' || k), 1, 12))::bigint % n)::int as i from pl, range(0, 200) t(b), range(0, n) u(k)), m as (select dr.protocol, b, avg(v) as mean from dr join pl on pl.protocol = dr.protocol and pl.i = dr.i group by all) "


@query(_BOOT + "select protocol, round(avg(mean), 9) as point, round(quantile_cont(mean, 0.025), 9) as low, round(quantile_cont(mean, 0.975), 9) as high from m group by 1")
def paired_bootstrap(spark, d):
    m = metrics.bootstrap_means(_seed_means(spark, d), ["protocol"], "seed", "v", 200, 11)
    return metrics.interval(m, ["protocol"]).select("protocol", *[r9(F.col(c), c) for c in ("point", "low", "high")])


@query(_BOOT + ", g as (select a.b, a.mean - c.mean as gap from m a join m c on a.b = c.b and a.protocol = 0 and c.protocol = 1) select round(avg(gap), 9) as point, round(quantile_cont(gap, 0.025), 9) as low, round(quantile_cont(gap, 0.975), 9) as high, round(avg((gap > 0)::int), 9) as positive from g")
def paired_gap(spark, d):
    m = metrics.bootstrap_means(_seed_means(spark, d), ["protocol"], "seed", "v", 200, 11)
    g = m.groupBy("b").agg((F.max(F.when(F.col("protocol") == 0, F.col("mean"))) - F.max(F.when(F.col("protocol") == 1, F.col("mean")))).alias("gap"))
    return metrics.interval(g, [], "gap").select(*[r9(F.col(c), c) for c in ("point", "low", "high")]).crossJoin(g.agg(r9(F.avg((F.col("gap") > 0).cast("int")), "positive")))


@query()
def hierarchical_bootstrap(spark, d):
    return metrics.hierarchical_auroc(predictions(spark, d), ["protocol"], 13)


@query(_with("preds") + "select protocol, round(regr_slope(y_prob, seed), 9) as slope, round(regr_intercept(y_prob, seed), 9) as intercept, round(regr_r2(y_prob, seed), 9) as r2 from preds group by 1")
def least_squares(spark, d):
    return predictions(spark, d).groupBy("protocol").agg(*[r9(F.expr(f"regr_{n}(y_prob, seed)"), n) for n in ("slope", "intercept", "r2")])


@query(_with("preds") + ", m as (select seed, protocol, avg(y_prob) as v from preds group by all) select seed, round(max(v) filter (where protocol = 0) - max(v) filter (where protocol = 1), 9) as gap from m group by 1")
def inflation_gap(spark, d):
    m = predictions(spark, d).groupBy("seed").pivot("protocol", [0, 1]).agg(F.avg("y_prob"))
    return m.select("seed", r9(F.col("0") - F.col("1"), "gap"))


_COST = _PTS + """, s as (select seed, protocol, coalesce(max(sensitivity) filter (where specificity >= 0.9::double), 0) as sens from points group by all),
k as (select seed, protocol, p.prevalence::double as prevalence, p.prevalence::double * 1000 * sens as tp, p.prevalence::double * 1000 * (1 - sens) as fn, (1000 - p.prevalence::double * 1000) * 0.9::double as tn, (1000 - p.prevalence::double * 1000) * (1 - 0.9::double) as fp from s cross join (values (0.138), (0.589)) p(prevalence)) """


@query(_COST + "select seed, protocol, prevalence, round(tp, 6) as tp, round(fn, 6) as fn, round(tn, 6) as tn, round(fp, 6) as fp from k")
def cost_per_thousand(spark, d):
    s = metrics.sensitivity_at(_points(spark, d), SP)
    return metrics.per_thousand(s, [0.138, 0.589]).select(*SP, "prevalence", *[F.round(c, 6).alias(c) for c in ("tp", "fn", "tn", "fp")])


@query(_COST + ", m as (select prevalence, avg(fn) filter (where protocol = 0) as honest, avg(fn) filter (where protocol = 1) as leaky from k group by 1) select prevalence, round(honest, 6) as honest, round(leaky, 6) as leaky, round(honest - leaky, 6) as hidden, round(case when leaky > 0 then honest / leaky end, 6) as ratio from m")
def cost_of_leakage(spark, d):
    costs = metrics.per_thousand(metrics.sensitivity_at(_points(spark, d), SP), [0.138, 0.589])
    return audits.cost_of_leakage(costs, "0", "1", ["prevalence"]).select("prevalence", *[F.round(c, 6).alias(c) for c in ("honest", "leaky", "hidden", "ratio")])


@query()
def mean_roc(spark, d):
    return metrics.mean_roc(_points(spark, d), ["protocol"], "seed").withColumn("tpr", F.round("tpr", 9))


@query()
def identity_probe(spark, d):
    e = table(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    return metrics.centroid_probe(splits.within_group_split(e, "label", "vec_id", 3), "label", "v", "fold")


# --- sorts, sets, windows
@query("select o_custkey as subject_id, count(*)::bigint as n from orders group by 1 order by n desc, 1 limit 12")
def top_subjects(spark, d):
    return scans(spark, d).groupBy("subject_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subject_id").limit(12)


@query(_with("scans") + "select subject_id, list_sort(list(image_id))[1:5] as first_ids from scans group by 1")
def first_ids(spark, d):
    w = Window.partitionBy("subject_id").orderBy("image_id")
    few = scans(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 5")
    return few.groupBy("subject_id").agg(F.array_sort(F.collect_list("image_id")).alias("first_ids"))


@query("select o_custkey as k from orders intersect select c_custkey from customer where c_acctbal > 0")
def set_intersect(spark, d):
    return scans(spark, d).select(F.col("subject_id").alias("k")).intersect(table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("select c_custkey as k from customer except select o_custkey from orders where o_orderstatus = 'P'")
def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(scans(spark, d).where("label = 'P'").select("subject_id"))


@query("select n_name as k from nation union select r_name from region")
def set_union(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("k")).union(table(spark, d, "region").select("r_name")).distinct()


@query(_with("docrec", "hcomp") + "select doc_id, count(*) over (partition by component)::bigint as component_size from hcomp")
def component_size_window(spark, d):
    members = _content_components(spark, d)[1]
    return members.select("doc_id", F.count("*").over(Window.partitionBy("component")).alias("component_size"))


@query("select n_regionkey, n_nationkey, sum(n_nationkey) over (partition by n_regionkey order by n_nationkey rows between unbounded preceding and current row)::bigint as running, lag(n_nationkey) over (partition by n_regionkey order by n_nationkey) as previous, dense_rank() over (order by n_regionkey)::int as ordinal from nation")
def running_windows(spark, d):
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    return table(spark, d, "nation").select("n_regionkey", "n_nationkey", F.sum("n_nationkey").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("running"), F.lag("n_nationkey").over(w).alias("previous"), F.dense_rank().over(Window.orderBy("n_regionkey")).alias("ordinal"))


@query(_RS + ", k as (select subject_id from rsplit group by 1 having bool_or(split = 'train') and bool_or(split = 'test')) select (select count(*) from k) = 0 as passed, (select count(*) from k)::bigint as leaking_subjects, (select count(*) from scans where label is null)::bigint as unlabelled")
def audit_gate(spark, d):
    s = splits.random_split(scans(spark, d), "image_id", 7)
    leaking = s.groupBy("subject_id").agg((F.bool_or(F.col("split") == "train") & F.bool_or(F.col("split") == "test")).alias("leak"), F.count_if(F.col("label").isNull()).alias("u"))
    return leaking.agg(F.count_if("leak").alias("leaking_subjects"), F.sum("u").alias("unlabelled")).select((F.col("leaking_subjects") == 0).alias("passed"), "leaking_subjects", "unlabelled")
