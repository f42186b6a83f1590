"""Queries of the manifest rules, of audits, and of sources and sinks on files that they write in the scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import rules
from holdfast.operators import audits, graph, joins, metrics, splits
from holdfast.plans.queries import _RS, _SUBJECT_SPLIT, _with, predictions, query, scans, subject_split, table
from holdfast.scratch import new_path
from holdfast.sources import readers, sinks

#: Visits with the columns of clinical tables, made of orders; the same expressions in both engines.
_VISIT = [
    "o_orderkey as image_id",
    "lpad((o_custkey % 1000)::string, 3, '0') || '_S_' || lpad((o_custkey % 10000)::string, 4, '0') as ptid",
    "case when o_orderkey % 9 = 0 then '' else 'm' || lpad((o_orderkey % 48)::string, 2, '0') end as viscode",
    "cast(o_orderdate as date) as acq_date",
    "case o_orderkey % 8 when 0 then '' when 1 then '  ' when 2 then 'NL' when 3 then '12' else (o_orderkey % 10)::string end as diagnosis",
    "case o_orderkey % 5 when 0 then 'lmci' when 1 then 'dementia' when 2 then null else (o_orderkey % 11)::string end as dxcurren",
    "case when o_orderkey % 3 = 0 then '1' else '0' end as dxad",
    "case when o_orderkey % 2 = 0 then '1' end as dxnorm",
    "case o_orderkey % 6 when 0 then '1' when 1 then 'Female' when 2 then 'X' when 3 then '' else 'M' end as ptgender",
    "case when o_orderkey % 4 = 0 then (50 + o_orderkey % 40)::string else '' end as age",
    "case o_orderkey % 7 when 0 then 'n/a' when 1 then null else (1920 + o_orderkey % 40)::string || '-01-01' end as ptdobyy",
    "case when o_orderkey % 10 = 0 then '1' else '0' end as motion",
    "case when o_orderkey % 15 = 1 then '1' end as malfunc",
    "o_orderkey % 3 > 0 as matched",
    "case o_orderkey % 5 when 0 then null when 1 then 'N/A' when 2 then '0.0' else '0.5' end as rating",
]
_VISITS = f"visits as (select {', '.join(_VISIT)} from orders)"


def visits(spark, d) -> DataFrame:
    return table(spark, d, "orders").selectExpr(*_VISIT)


_CODES = "case {0} when '1' then 'CN' when '7' then 'CN' when '3' then 'AD' when '5' then 'AD' when '6' then 'AD' when '2' then 'MCI' when '4' then 'MCI' when '8' then 'MCI' when '9' then 'MCI' end"
_TEXT = "case upper({0}) when 'CN' then 'CN' when 'AD' then 'AD' when 'MCI' then 'MCI' when 'LMCI' then 'MCI' when 'EMCI' then 'MCI' when 'SMC' then 'MCI' end"
_DX = f"""v as (select *, coalesce({_CODES.format('trim(diagnosis)')}, {_TEXT.format('trim(diagnosis)')}) as d1, coalesce({_CODES.format('trim(dxcurren)')}, {_TEXT.format('trim(dxcurren)')}) as d2 from visits),
dx as (select image_id, ptid, acq_date, coalesce(d1, d2, case when dxad = '1' then 'AD' when dxnorm = '1' then 'CN' else 'unknown' end) as label,
case when d1 is not null then 'DIAGNOSIS' when d2 is not null then 'DXCURREN' when dxad = '1' then 'DXAD' when dxnorm = '1' then 'DXNORM' else '' end as source,
case when coalesce(d1, d2) is not null or dxad = '1' or dxnorm = '1' then 'clinical_table' else 'missing' end as confidence from v)"""


@query(f"with {_VISITS}, {_DX} select image_id, label, source, confidence from dx")
def rule_diagnosis(spark, d):
    v = visits(spark, d)
    return v.select("image_id", rules.diagnosis(v).alias("x")).select("image_id", "x.*")


@query(f"with {_VISITS} select image_id, case when rating is null or upper(rating) = 'N/A' then 'label_missing' when rating::double = 0 then 'NonDemented' else 'Demented' end as label from visits")
def rule_rating(spark, d):
    return visits(spark, d).select("image_id", rules.label_from_rating(F.col("rating")).alias("label"))


@query(f"""with {_VISITS} select image_id, case when nullif(trim(age), '') is not null then trim(age) when regexp_matches(left(ptdobyy, 4), '^[0-9]{{4}}$') then (year(acq_date) - left(ptdobyy, 4)::int)::varchar else '' end as age,
case trim(ptgender) when '1' then 'M' when '2' then 'F' when 'Male' then 'M' when 'Female' then 'F' else coalesce(trim(ptgender), '') end as sex from visits""")
def rule_age_sex(spark, d):
    v = visits(spark, d)
    return v.select("image_id", rules.age_sex(v, F.col("acq_date")).alias("x")).select("image_id", "x.*")


@query(f"with {_VISITS} select image_id, case when motion = '1' or malfunc = '1' then 'fail' when matched then 'pass' else 'unknown' end as qc_flag from visits")
def rule_quality(spark, d):
    return visits(spark, d).select("image_id", rules.quality_flag(F.col("motion"), F.col("malfunc"), F.col("matched")).alias("qc_flag"))


@query(f"with {_VISITS} select image_id, case when viscode <> '' then ptid || '__' || viscode else ptid || '__' || strftime(acq_date, '%Y-%m-%d') end as session_id, split_part(ptid, '_', 3)::int as rid, case when ptdobyy like '____-__-__' then ptdobyy::date end as born from visits")
def rule_sessions(spark, d):
    return visits(spark, d).select("image_id", rules.session_id(F.col("ptid"), F.col("viscode"), F.col("acq_date")).alias("session_id"), rules.entity_number(F.col("ptid")).alias("rid"), rules.parse_date(F.col("ptdobyy")).alias("born"))


_NAMES = "case p_partkey % 3 when 0 then 'set/' || p_brand || '/' || (p_partkey % 30)::string || ' (' || (p_partkey % 50)::string || ').jpg' when 1 then 'set/' || p_brand || '/' || p_partkey::string || '_a.b.png' else 'set/' || p_brand || '/scan x' || p_partkey::string end as path"


@query(f"""with f as (select p_partkey as image_id, p_brand as label, {_NAMES} from part),
s as (select *, replace(regexp_replace(split_part(path, '/', 3), '^(.+)\\.[^.]*$', '\\1'), ' ', '') as stem from f), n as (select *, regexp_extract(stem, '\\(([0-9]+)\\)', 1) as num from s)
select image_id, case when num <> '' then label || '_patient' || num else label || '_unique_' || stem || '_' || substr(sha1(path), 1, 12) end as subject_id, case when num <> '' then 'high_filename_parentheses' else 'low_unparseable_unique' end as subject_id_confidence,
case when num <> '' then 'parsed_parentheses' else 'unparseable_unique' end as subject_parse_status, num as patient_number, regexp_extract(stem, '^([0-9]+)', 1) as slice_number from n""")
def rule_filenames(spark, d):
    files = table(spark, d, "part").selectExpr("p_partkey as image_id", "p_brand as label", _NAMES)
    return files.select("image_id", rules.parse_filename(F.col("path"), F.col("label")).alias("x")).select("image_id", "x.*")


_PATH = "'ADx/' || lpad((o_custkey % 1000)::string, 3, '0') || '_S_' || lpad((o_custkey % 10000)::string, 4, '0') || '/' || case o_orderkey % 3 when 0 then 'MPR__GradWarp' when 1 then 'N3m__x' else 'raw' end || '/' || substr(cast(cast(o_orderdate as date) as string), 1, 10) || '_10_11_12.0/' || case when o_orderkey % 2 = 0 then 'I' || o_orderkey::string else 'x' end || '/v_S' || (o_orderkey + 1000)::string || case when o_orderkey % 4 < 2 then '_I7.nii' else '.nii' end as path"


@query(f"""with f as (select o_orderkey as image_id, {_PATH} from orders)
select image_id, regexp_extract(path, '\\b([0-9]{{3}}_S_[0-9]{{4}})\\b', 1) as ptid, regexp_extract(path, '\\bI[0-9]+\\b', 0) as image_uid, regexp_extract(path, '(?:^|[^A-Za-z])(S[0-9]{{4,}})\\b', 1) as series_uid, regexp_extract(path, '\\b([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})(?:_[0-9]{{2}}_[0-9]{{2}}_[0-9]{{2}})?\\b', 1) as acq_date,
case when regexp_extract(path, '_S([0-9]{{4,}})_', 1) <> '' then 'S' || regexp_extract(path, '_S([0-9]{{4,}})_', 1) else '' end as slice_series, regexp_extract(path, '/(MPR-?R?|MT1|GradWarp[^/]*|N3m?[^/]*)__', 1) as acquisition_type from f""")
def rule_paths(spark, d):
    files = table(spark, d, "orders").selectExpr("o_orderkey as image_id", _PATH)
    x = files.select("image_id", rules.path_ids(F.col("path")).alias("x"), rules.slice_path_ids(F.col("path")).alias("y"))
    return x.select("image_id", "x.*", F.col("y.series_uid").alias("slice_series"), "y.acquisition_type")


#: Sessions of 457 subjects, the same text in both engines.
_SESSION = "'OAS1_' || lpad((c_custkey % 457 + 1)::string, 4, '0') || case when c_custkey % 13 = 0 or c_custkey % 457 = 79 then '_MR2' else '_MR1' end as session_id"


@query(f"""with s as (select c_custkey as id, {_SESSION} from customer), r(disc, lo, hi) as (values (1, 1, 42), (2, 43, 80), (3, 80, 115), (4, 116, 150), (5, 151, 191), (6, 192, 231), (7, 232, 272), (8, 273, 309), (9, 310, 348), (10, 349, 382), (11, 383, 419), (12, 420, 457)),
n as (select *, substr(session_id, 6, 4)::int as num, right(session_id, 3) as visit from s),
disc as (select id, session_id, case when num = 80 and visit = 'MR2' then 3 else (select min(disc) from r where num between lo and hi) end::int as disc from n)
select id, left(session_id, 9) as subject_id, disc, right(session_id, 4) = '_MR2' or id % 10 = 0 as is_reliability, 'disc' || disc || '/' || session_id || '/PROCESSED/MPRAGE/T88_111/' || session_id || '_mpr_n' || v || '_anon_111_t88_masked_gfc.hdr' as hdr from disc, range(1, 9) t(v)""")
def archive_members(spark, d):
    s = table(spark, d, "customer").selectExpr("c_custkey as id", _SESSION).withColumn("disc", joins.disc_of(F.col("session_id")))
    listed = F.when(F.col("id") % 10 == 0, True)
    return s.select("id", rules.session_subject(F.col("session_id")).alias("subject_id"), "disc", rules.is_reliability(F.col("session_id"), listed).alias("is_reliability"), F.explode(joins.member_candidates(F.col("session_id"), F.col("disc"))).alias("m")).select("id", "subject_id", "disc", "is_reliability", F.col("m.hdr").alias("hdr"))


_INVENTORY = "c_custkey as id, (c_custkey % 12 + 1)::int as disc, 'disc' || (c_custkey % 12 + 1)::string || '.tar' as archive_path, c_custkey % 12 <> 4 as archive_exists, c_acctbal > 0 as hdr_exists, c_mktsegment <> 'BUILDING' as img_exists"


@query(f"with i as (select {_INVENTORY} from customer) select disc, count(*)::bigint as sessions, coalesce(list_sort(list(distinct archive_path) filter (where not archive_exists)), []) as missing_archives, count(*) filter (where hdr_exists and img_exists)::bigint as extracted_pairs from i group by 1")
def archive_rollup(spark, d):
    return audits.archive_rollup(table(spark, d, "customer").selectExpr(*[x.strip() for x in _split_top(_INVENTORY)]))


def _split_top(text: str) -> list[str]:
    """Select items between commas outside brackets and quotes."""
    out, depth, quoted, item = [], 0, False, ""
    for c in text:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append(item)
            item = ""
        else:
            item += c
    return [*out, item]


@query(f"""with {_VISITS} select 'total' as kind, 'rows' as value, count(*)::bigint as n from visits union all select 'total', 'subjects', count(distinct ptid) from visits union all select 'total', 'sessions', count(distinct nullif(viscode, '')) from visits
union all select 'label', coalesce(nullif(trim(diagnosis), ''), 'missing'), count(*) from visits group by 2 union all select 'rating', coalesce(rating, 'missing'), count(*) from visits group by 2""")
def manifest_counts(spark, d):
    return audits.manifest_counts(visits(spark, d), "ptid", "viscode", "diagnosis", "rating")


@query(f"with {_VISITS}, k as (select * from visits) select ptid, (select min_by(trim(x.diagnosis), x.image_id) from k x where x.ptid = p.ptid and trim(x.diagnosis) <> '') as diagnosis, (select min_by(x.ptgender, x.image_id) from k x where x.ptid = p.ptid and x.ptgender <> '') as ptgender, (select min_by(x.age, x.image_id) from k x where x.ptid = p.ptid and x.age <> '') as age from (select distinct ptid from k) p")
def merged_fields(spark, d):
    return audits.first_non_empty(visits(spark, d), "ptid", "image_id", ["diagnosis", "ptgender", "age"])


@query(f"with {_VISITS} select count(distinct case when trim(diagnosis) not in ('', 'NL') then trim(diagnosis) end)::bigint as labels, count(distinct ptid)::bigint as subjects from visits")
def distinct_known(spark, d):
    return visits(spark, d).agg(audits.distinct_known("diagnosis", ("NL",)).alias("labels"), F.countDistinct("ptid").alias("subjects"))


_PROFILE = f"""with {_VISITS}, {_DX}, dem as (select image_id, ptid, acq_date, case when nullif(age, '') is not null then age::double end as years, nullif(case trim(ptgender) when '1' then 'M' when 'Female' then 'F' else trim(ptgender) end, '') as sx from visits),
sc as (select o_custkey, lpad((o_custkey % 1000)::string, 3, '0') || '_S_' || lpad((o_custkey % 10000)::string, 4, '0') as ptid, cast(o_orderdate as date) as day, (o_orderkey % 33 - 3)::int as score from orders),
base as (select ptid, min_by(score, (day, score)) as score from sc where score >= 0 group by 1),
per as (select dem.ptid, max(case label when 'AD' then 3 when 'CN' then 2 when 'MCI' then 1 else 0 end) as rank, min_by(sx, image_id) filter (where sx is not null) as sex, min_by(years, (dem.acq_date, image_id)) filter (where years is not null) as age, count(*)::bigint as scans from dem join dx using (image_id) group by 1),
prof as (select per.ptid, case rank when 3 then 'AD' when 2 then 'CN' when 1 then 'MCI' else 'unknown' end as dx, sex, age, scans, score from per left join base using (ptid)) """


def _profile(spark, d) -> DataFrame:
    v = visits(spark, d)
    scans_ = v.select("image_id", "ptid", "acq_date", rules.diagnosis(v)["label"].alias("dx"), rules.age_sex(v, F.lit(None).cast("date")).alias("x")).select("image_id", "ptid", "acq_date", "dx", "x.*")
    scores = v.select("ptid", F.col("acq_date").alias("day"), (F.col("image_id") % 33 - 3).alias("score"))
    return audits.subject_profile(scans_, scores, "ptid", "dx", "sex", "age", "acq_date", "score", "day", "image_id")


@query(_PROFILE + "select ptid, dx, sex, age, scans, score from prof")
def subject_profile(spark, d):
    return _profile(spark, d)


@query(_PROFILE + "select dx, count(*)::bigint as subjects, sum(scans)::bigint as scans, round(coalesce(avg(age), 0), 6) as age_mean, round(coalesce(stddev_samp(age), 0), 6) as age_sd, count(*) filter (where sex = 'F')::bigint as women, round(count(*) filter (where sex = 'F') * 100.0::double / count(*), 6) as women_pct, round(avg(score), 6) as score_mean, round(coalesce(stddev_samp(score), 0), 6) as score_sd from prof group by 1")
def group_demographics(spark, d):
    found = audits.group_demographics(_profile(spark, d))
    return found.withColumns({c: F.round(c, 6) for c in ("age_mean", "age_sd", "women_pct", "score_mean", "score_sd")})


_GROUPS = _with("preds").rstrip() + f""", m as (select o_orderkey as doc_id, case when o_orderkey % 4 < 3 then (50 + o_orderkey % 40)::double end as age, case o_orderkey % 5 when 0 then '' when 1 then 'F' else 'M' end as sex from orders),
med as (select median(age) as med from m where age is not null and sex <> ''), j as (select preds.*, age, sex, case when age >= (select med from med) then 'old' else 'young' end as band from preds join m using (doc_id) where age is not null),
g as (select protocol, seed, y_true, unnest(list_filter(['overall', 'age_' || band, 'sex_' || case sex when '' then 'unknown' else sex end, case when sex <> '' then 'sex_' || sex || '_age_' || band end], lambda x: x is not null)) as grp from j) """


@query(_GROUPS + "select protocol, grp, count(*)::bigint as n, round(avg(y_true), 9) as prevalence from g group by all")
def age_sex_groups(spark, d):
    o = table(spark, d, "orders")
    meta = o.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 4 < 3, (50 + F.col("o_orderkey") % 40).cast("string")).otherwise("?").alias("age"), F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 5 == 1, "F").otherwise("M").alias("sex"))
    median = meta.where("sex <> ''").agg(F.median(F.col("age").try_cast("double")).alias("median"))  # one row
    rows = joins.with_numeric(predictions(spark, d), meta, "doc_id", "age").join(meta.select("doc_id", "sex"), "doc_id").crossJoin(F.broadcast(median))
    keyed = rows.withColumn("grp", F.explode(rules.age_sex_groups(F.col("age"), F.col("sex"), F.col("median"))))
    return keyed.groupBy("protocol", "grp").agg(F.count("*").alias("n"), F.round(F.avg("y_true"), 9).alias("prevalence"))


@query(_RS + """, g as (select s.split, l.label, l.n_all from (values ('train'), ('val'), ('test')) s(split) cross join (select label, count(*) as n_all from scans group by 1) l), c as (select g.*, (select count(*) from rsplit r where r.split = g.split and r.label = g.label) as n from g)
select split, label, n::bigint as n, round(n::double / sum(n) over (partition by split), 9) as share, round(n_all::double / (select count(*) from scans), 9) as global_share, abs(n::double / sum(n) over (partition by split) - n_all::double / (select count(*) from scans)) > 0.002 as drifts from c""")
def share_drift(spark, d):
    out = splits.share_drift(splits.random_split(scans(spark, d), "image_id", 7), "split", "label", 0.002)
    return out.withColumns({c: F.round(c, 9) for c in ("share", "global_share")})


@query(_with("docrec") + ", m as (select subject from docrec group by 1 having count(distinct label) > 1), c as (select content, count(distinct label) as k, list_sort(list(distinct label)) as labels, count(*)::bigint as records, list_sort(list(doc_id)) as ids from docrec group by 1) select content as component, labels, records, ids from c where k > 1 union all select 'all', list_sort(list(distinct label)), count(*)::bigint, list_sort(list(doc_id)) from docrec where doc_id < 0 having count(*) > 0 union all select 'segment ' || (doc_id // 50), list_sort(list(distinct label)), count(*)::bigint, list_sort(list(doc_id)) from docrec group by 1 having count(distinct label) > 1")
def mixed_components(spark, d):
    from holdfast.plans.queries import records

    r = records(spark, d)
    keyed = r.withColumn("component", F.col("content")).unionByName(r.withColumn("component", F.concat(F.lit("segment "), F.floor(F.col("doc_id") / 50).cast("string"))))
    return splits.mixed_components(keyed, "component", "label", "doc_id")


_MIXED = _with("scans").rstrip() + """, c as (select subject_id, case when min(label) = max(label) then min(label) else 'mixed_label' end as component_label from scans group by 1),
v as (select subject_id, label, count(*) as n, min(image_id) as f from scans where label in ('F', 'O') group by all), b as (select subject_id, label from (select *, row_number() over (partition by subject_id order by n desc, f) as r from v) where r = 1),
rl as (select s.image_id, case when c.component_label = 'mixed_label' then coalesce(b.label, 'mixed_label') else c.component_label end as component_label from scans s join c using (subject_id) left join b using (subject_id)) """


def _relabelled(spark, d) -> DataFrame:
    rows = scans(spark, d)
    labels = graph.component_labels(rows.withColumn("component", F.col("subject_id")), "label").withColumnRenamed("component", "subject_id")
    return splits.relabel_by_majority(rows.join(labels, "subject_id"), "subject_id", "component_label", "label", "image_id", ("F", "O"))


@query(_MIXED + "select * from rl")
def relabelled_components(spark, d):
    return _relabelled(spark, d).select("image_id", "component_label")


@query(_MIXED + "select * from rl where component_label not in ('O')")
def excluded_rows(spark, d):
    return splits.excluded(_relabelled(spark, d), "component_label", ("O",)).select("image_id", "component_label")


@query(_with("scans") + _SUBJECT_SPLIT + "select split, count(*)::bigint as n from gs group by 1")
def safe_split_counts(spark, d):
    """A split by subject passes the assertion that no subject stands in two parts, and its rows are pure in their class."""
    rows = splits.require_pure(splits.require_no_overlap(subject_split(spark, d), ["subject_id"]), "subject_id", "component_label")
    return rows.groupBy("split").agg(F.count("*").alias("n"))


@query(_with("scans") + _SUBJECT_SPLIT + "select 'has_rows' as gate, true as passed union all select 'has_classes', true union all select 'no_contamination', true union all select 'all_splits', true")
def gates_of_safe_split(spark, d):
    return audits.gates(subject_split(spark, d), "split", "subject_id", "label", ("F", "O"))


@query(_RS + ", k as (select subject_id from rsplit group by 1 having bool_or(split = 'train') and bool_or(split = 'test')) select 'has_rows' as gate, true as passed union all select 'has_classes', (select count(*) from scans where label = 'Q') > 0 union all select 'no_contamination', (select count(*) from k) = 0 union all select 'all_splits', true")
def gates_of_random_split(spark, d):
    return audits.gates(splits.random_split(scans(spark, d), "image_id", 7), "split", "subject_id", "label", ("Q",))


@query(_with("preds") + ", f as (select protocol, seed, avg(y_prob) as lift from preds group by all) select protocol, count(*)::bigint as runs, round(avg(lift), 9) as mean, round(min(lift), 9) as least, round(max(lift), 9) as most from f group by 1")
def probe_rollup(spark, d):
    runs = predictions(spark, d).groupBy("protocol", "seed").agg(F.avg("y_prob").alias("lift"))
    return audits.probe_rollup(runs).withColumns({c: F.round(c, 9) for c in ("mean", "least", "most")})


@query(_with("preds") + ", f as (select protocol, seed, avg(y_prob) * 100 as pct from preds group by all) select protocol, count(*)::bigint as n, round(avg(pct), 6) as mean, round(coalesce(stddev_samp(pct), 0), 6) as sd from f group by 1")
def contamination_spread(spark, d):
    runs = predictions(spark, d).groupBy("protocol", "seed").agg((F.avg("y_prob") * 100).alias("pct"))
    runs = runs.unionByName(runs.limit(0)).unionByName(spark.createDataFrame([(0, 99, float("nan"))], "protocol long, seed long, pct double"))  # what is no number does not count
    return audits.spread(runs, ["protocol"], "pct").select("protocol", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(_with("preds") + "select protocol, printf('%.3f', avg(y_prob)) as value, printf('%+.3f', avg(y_prob) - 0.5) as gap, printf('%.2f ± %.2f', avg(y_prob), stddev_samp(y_prob)) as spread, printf('%.3f [%.3f, %.3f]', avg(y_prob), min(y_prob), max(y_prob)) as span from preds group by 1")
def formatted_numbers(spark, d):
    g = predictions(spark, d).groupBy("protocol").agg(F.avg("y_prob").alias("m"), F.stddev_samp("y_prob").alias("s"), F.min("y_prob").alias("a"), F.max("y_prob").alias("b"))
    return g.select("protocol", rules.fixed(F.col("m"), 3).alias("value"), rules.signed(F.col("m") - 0.5).alias("gap"), rules.with_spread(F.col("m"), F.col("s"), 2).alias("spread"), rules.with_interval(F.col("m"), F.col("a"), F.col("b")).alias("span"))


@query("select event_id, coalesce(case when event_id % 3 = 0 then null else (event_id % 7)::varchar end, '') as text from events")
def stringified(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", rules.text_or_blank(F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("event_id") % 7)).alias("text"))


@query(_with("scans") + _SUBJECT_SPLIT + "select image_id, split from gs where split = 'val' and component_label in ('F', 'O') order by split, subject_id, image_id")
def universe_of_part(spark, d):
    rows = subject_split(spark, d).transform(rules.in_universe("component_label", ("F", "O"))).transform(rules.split_part("split", "val"))
    return rows.orderBy("split", "subject_id", "image_id").select("image_id", "split")


@query("select o_orderpriority as value, count(*)::bigint as n from orders group by 1 order by n desc, value")
def sorted_counts(spark, d):
    return audits.group_counts(scans(spark, d), "stratum")


@query("select o_orderkey as image_id from orders order by o_orderkey limit 100")
def first_rows(spark, d):
    """The smoke run's cap: as many rows as are asked for, in order."""
    return scans(spark, d).select("image_id").orderBy("image_id").limit(100)


@query("select (select count(*) from (select distinct o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0))) = 0 as holds, (select count(*) from (select distinct o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)))::bigint as missing")
def superset_test(spark, d):
    present = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("subject_id"))
    return joins.superset(scans(spark, d).select("subject_id"), present)


_COMPOSITE = "select a.src, v.image_id as dst, '{0}' as reason from {1} v join (select {2}, min(image_id) as src from {1} where {3} group by all) a using ({2}) where a.src <> v.image_id"


@query(f"with {_VISITS}, w as (select *, strftime(acq_date, '%Y-%m') as month, 'S' || (image_id // 3) as series from visits) " + " union all ".join([_COMPOSITE.format("same_session", "w", "ptid, viscode", "viscode <> ''") .replace("where a.src", "where viscode <> '' and a.src"), _COMPOSITE.format("same_acq_date", "w", "ptid, month", "true"), _COMPOSITE.format("same_series_uid", "w", "series", "true")]))
def composite_edges(spark, d):
    v = visits(spark, d).withColumns({"viscode": F.nullif("viscode", F.lit("")), "month": F.date_format("acq_date", "yyyy-MM"), "series": F.concat(F.lit("S"), F.floor(F.col("image_id") / 3).cast("string"))})
    edges = graph.star_edges(v, "image_id", ["ptid", "viscode"], "same_session").unionByName(graph.star_edges(v, "image_id", ["ptid", "month"], "same_acq_date"))
    return edges.unionByName(graph.star_edges(v, "image_id", ["series"], "same_series_uid"))


@query("select o_orderkey as image_id, min(o_orderkey) over (partition by o_custkey) as component from orders")
def key_components(spark, d):
    return graph.key_components(scans(spark, d), "image_id", "subject_id")


_REASONS = "with e as (select l_orderkey as src, l_partkey as k, l_linenumber as j from lineitem), a as (select distinct o_orderkey as id, o_custkey as k1, o_custkey || o_orderstatus as k2 from orders), c as (select id, min(id) over (partition by k1) as component, count(*) over (partition by k1) as s1, count(*) over (partition by k2) as s2 from a) "


@query(_REASONS + "select component, count(*)::bigint as size, case when count(*) = 1 then 'singleton' when max(s2) > 1 then 'same_status+same_subject' else 'same_subject' end as reason from c group by 1")
def two_reasons(spark, d):
    s = scans(spark, d)
    edges = graph.star_edges(s, "image_id", ["subject_id"], "same_subject").unionByName(graph.star_edges(s, "image_id", ["subject_id", "label"], "same_status"))
    return graph.component_reasons(graph.components(s.select("image_id"), "image_id", edges), "image_id", edges)


_FALLBACK = f"""with {_VISITS}, dxt as (select ptid, viscode, max(age) as value from visits where image_id % 5 = 0 and age <> '' group by 1, 2), byd as (select ptid, min(image_id) as oo, acq_date as day, min_by(age, image_id) as value from visits where image_id % 3 = 1 and age <> '' group by ptid, acq_date),
s1 as (select v.image_id, v.ptid, v.acq_date, v.matched, x.value as v1 from visits v left join dxt x on x.ptid = v.ptid and x.viscode = v.viscode),
c as (select s1.image_id, b.value, row_number() over (partition by s1.image_id order by abs(date_diff('day', s1.acq_date, b.day)), b.day, b.oo) as r, abs(date_diff('day', s1.acq_date, b.day)) as gap from s1 join byd b on b.ptid = s1.ptid where s1.matched)
select s1.image_id, coalesce(v1, case when gap <= 180 then c.value end) as value, case when v1 is not null then 'visit' when gap <= 180 and c.value is not null then 'nearest_date' else 'none' end as value_source from s1 left join c on c.image_id = s1.image_id and c.r = 1"""


@query(_FALLBACK)
def cascade_with_dates(spark, d):
    v = visits(spark, d)
    by_visit = v.where("image_id % 5 = 0 and age <> ''").select("ptid", "viscode", F.col("age").alias("value"))
    by_date = v.where("image_id % 3 = 1 and age <> ''").select("ptid", F.col("acq_date").alias("day"), F.col("age").alias("value"), F.col("image_id").alias("ord"))
    left = v.select("image_id", "ptid", "viscode", "acq_date", "matched")
    return joins.cascade_or_nearest(left, [("visit", by_visit, ["ptid", "viscode"])], "value", "matched", by_date, "ptid", "image_id", "acq_date", "day", "ord").select("image_id", "value", "value_source")


@query("select o_orderkey as image_id, coalesce(c.c_mktsegment, n.n_name) as value from orders o left join customer c on c.c_custkey = o.o_custkey + 100 left join nation n on n.n_nationkey = o.o_orderkey % 40")
def either_key_lookup(spark, d):
    left = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") + 100).alias("rid"), (F.col("o_orderkey") % 40).cast("long").alias("ptid"))
    right = table(spark, d, "customer").select(F.col("c_custkey").alias("rid"), F.lit(None).cast("long").alias("ptid"), F.col("c_mktsegment").alias("value"))
    right = right.unionByName(table(spark, d, "nation").select(F.lit(None).cast("long").alias("rid"), F.col("n_nationkey").cast("long").alias("ptid"), F.col("n_name").alias("value")))
    return joins.either_key(left, right, "rid", "ptid", ["value"]).select("image_id", "value")


@query("select l_orderkey, l_linenumber, o_orderstatus as label from lineitem join orders on o_orderkey = l_orderkey")
def required_join(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return joins.required_join(rows, table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("label")), "l_orderkey")


_UNPAIRED = _with("preds").rstrip() + """, v as (select protocol, seed, avg(y_prob) as v from preds group by all), pl as (select protocol, v, row_number() over (partition by protocol order by seed) - 1 as i, count(*) over (partition by protocol) as n from v),
dr as (select distinct protocol, n, b, k, ('0x' || substr(sha1('11:' || b || ':' || protocol || ':' || k), 1, 12))::bigint % n as i from (select distinct protocol, n from pl), range(0, 1000) t(b), range(0, 100) u(k) where k < n), m as (select dr.protocol, dr.b, avg(v) as mean from dr join pl on pl.protocol = dr.protocol and pl.i = dr.i group by all)
select protocol, round(avg(mean), 9) as point, round(quantile_cont(mean, 0.025), 9) as low, round(quantile_cont(mean, 0.975), 9) as high from m group by 1"""


@query(_UNPAIRED)
def marginal_bootstrap(spark, d):
    v = predictions(spark, d).groupBy("protocol", "seed").agg(F.avg("y_prob").alias("v"))
    m = metrics.bootstrap_means(v, ["protocol"], "seed", "v", 1000, 11, paired=False)
    return metrics.interval(m, ["protocol"]).select("protocol", *[F.round(c, 9).alias(c) for c in ("point", "low", "high")])


@query(_with("scans") + "select subject_id, image_id, k::int as k from (select subject_id, image_id, row_number() over (partition by subject_id order by acq_date, image_id) as k from scans) where k <= 3")
def kth_scans(spark, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("subject_id").orderBy("acq_date", "image_id"))
    return scans(spark, d).select("subject_id", "image_id", k.alias("k")).where("k <= 3")


# --- sources and sinks, on files that the query writes first


@query("select n_nationkey::varchar as nation_key, nullif(trim(n_name), '') as name_of_it, n_regionkey::varchar as region from nation")
def csv_round_trip(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias(" Nation Key"), F.concat(F.lit(" "), "n_name", F.lit("  ")).alias("Name of it"), F.col("n_regionkey").alias("REGION "))
    path = new_path(spark, "csv")
    sinks.write_csv(n, path, n.columns)
    return readers.read_csv_safely(spark, f"{path}/*.csv")


@query("select c_custkey as k, c_mktsegment as v from customer")
def append_once(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    path = new_path(spark, "append")
    for part in (rows.where("k % 2 = 0"), rows.where("k % 3 = 0"), rows, rows):
        sinks.append_new(part, path, "k")
    return spark.read.schema(rows.schema).parquet(path)


@query(_with("preds") + "select doc_id, y_true, round(y_prob, 6) as y_prob, seed, protocol from preds")
def prediction_sink(spark, d):
    path = new_path(spark, "predictions")
    sinks.write_predictions(predictions(spark, d).select("doc_id", "y_true", "y_prob", "seed", "protocol"), path)
    return spark.read.schema("doc_id long, y_true long, y_prob double, seed long, protocol long").parquet(path)


@query("select seed::int as seed, overlap::double as overlap, n::bigint as n from (select o_orderkey % 5 as seed, (o_orderkey % 4) * 0.25 as overlap, count(*) as n from orders group by 1, 2)")
def nested_results(spark, d):
    rows = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 5).alias("s"), (F.col("o_orderkey") % 4 * 0.25).alias("p")).agg(F.count("*").alias("n"))
    path = new_path(spark, "runs")
    for r in rows.collect():  # twenty folders; one of them a second time under another spelling of its share
        one = spark.createDataFrame([(r.n,)], "n long")
        one.coalesce(1).write.option("header", True).csv(f"{path}/seed{r.s}_overlap{float(r.p):.2f}")
    spark.createDataFrame([(-1,)], "n long").coalesce(1).write.option("header", True).csv(f"{path}/seed0_overlap0.500")
    return readers.partitioned_results(spark, path, "n long").select("seed", "overlap", "n")


@query("select r_regionkey as id, r_name as name from region")
def json_results(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    path = new_path(spark, "json")
    r.write.option("ignoreNullFields", False).option("maxRecordsPerFile", 1).json(path)
    return readers.read_json(spark, path, "id long, name string").where("id is not null")


@query("select n_name as relative_path, '.txt' as suffix, (length(n_name) + 1)::bigint as bytes, sha256(n_name || chr(10)) as sha256 from nation")
def file_inventory(spark, d):
    path = new_path(spark, "files")
    n = table(spark, d, "nation").select("n_name")
    n.withColumn("f", F.col("n_name")).write.partitionBy("f").text(path)
    found = readers.inventory(spark, path).where("relative_path like 'f=%'")
    name = F.replace(F.regexp_extract("relative_path", "^f=([^/]*)/", 1), F.lit("%20"), F.lit(" "))
    return found.select(name.alias("relative_path"), "suffix", "bytes", "sha256")


@query("select k as archive, case k when 'a.zip' then 'images' when 'b.zip' then 'study_files' else 'mixed' end as kind from (values ('a.zip'), ('b.zip'), ('c.zip'), ('d.zip')) t(k)")
def archive_kinds(spark, d):
    members = [("a.zip", "x/1.dcm"), ("a.zip", "x/2.nii.gz"), ("a.zip", "x/"), ("b.zip", "t/a.CSV"), ("b.zip", "readme"), ("c.zip", "i.img"), ("c.zip", "t.xlsx"), ("d.zip", "none")]
    return readers.classify_archives(spark.createDataFrame(members, "archive string, member string"))
