"""DuckDB SQL for the queries of the same name, written from the definitions and not from the plans."""

from ..functions.labels import CLASSES, CODES
from ..operators.scoring import CANDIDATES
from .bindings import K, LEAVES, RATES, THRESHOLDS, TYPES, WEIGHTS

ORACLES: dict[str, str] = {}


def _list(xs: list, kind: str = "") -> str:
    return "[" + ", ".join(f"'{x}'" if isinstance(x, str) else repr(x) for x in xs) + "]" + (f"::{kind}[]" if kind else "")


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^[\\x09-\\x0D\\x20]+|[\\x09-\\x0D\\x20]+$', '', 'g')"


SIG = """sig as (select user_id as exam_id, row_number() over (partition by user_id order by ts, event_id) - 1 as t,
  case when event_type = 'error' then 0.0 else value end as x0,
  case when event_type = 'error' then 0.0 else cast(props->>'$.k' as double) end as x1 from events),
lng as (select exam_id, 0 as lead, t, x0::float::double as x from sig union all select exam_id, 1, t, x1::float::double from sig)"""
BOUNDS = """bnd as (select exam_id, coalesce(min(t) filter (where abs(x) > {0}), 0) as s, coalesce(max(t) filter (where abs(x) > {0}) + 1, 0) as e, max(t) + 1 as n from lng group by exam_id)"""
CELLS = f"""cells as (select event_id as rec_id, k as class_idx, (event_type = ({_list(TYPES)})[k + 1] or (event_id * 7 + k) % 11 = 0) as label,
  cast((event_id * 7919 + k * 104729) % 1000 + case when event_type = ({_list(TYPES)})[k + 1] then 400 else 0 end as double) / 1400.0 as prob
  from events cross join (select unnest(range({K})) as k))"""


def decided(thresholds: list[float], name: str = "dec") -> str:
    return f"{name} as (select *, prob >= ({_list(thresholds, 'double')})[class_idx + 1] as d from cells)"


DEC = decided(THRESHOLDS)
CONF = "conf as (select class_idx, sum((label and d)::bigint)::bigint as tp, sum((not label and d)::bigint)::bigint as fp, sum((label and not d)::bigint)::bigint as fn, sum((not label and not d)::bigint)::bigint as tn from dec group by 1)"
W = "w as (select i, j, v from (values " + ", ".join(f"({i}, {j}, {WEIGHTS[i][j]!r}::double)" for i in range(K) for j in range(K)) + ") t(i, j, v))"
REC = """un as (select rec_id, sum((label or d)::int) as u, sum(label::int) as ul, sum((label or class_idx = 0)::int) as ui from dec group by 1),
pr as (select a.rec_id, a.class_idx as i, b.class_idx as j, b.d, b.label as lb, v from dec a join dec b on a.rec_id = b.rec_id join w on w.i = a.class_idx and w.j = b.class_idx where a.label),
rec as (select un.rec_id, coalesce(sum(v / u) filter (where d), 0) as obs, coalesce(sum(v / ul) filter (where lb), 0) as cor, coalesce(sum(v / ui) filter (where j = 0), 0) as ina from un left join pr on un.rec_id = pr.rec_id group by un.rec_id)"""
AUC = """scr as (select class_idx, prob, sum(label::int) as p, count(*) as n from cells group by 1, 2),
cum as (select *, sum(p) over o as tp, sum(n) over o as seen, sum(p) over (partition by class_idx) as pp, sum(n) over (partition by class_idx) as nn from scr window o as (partition by class_idx order by prob desc)),
st as (select class_idx, p / greatest(pp, 1) as dt, (nn - pp - (seen - tp)) / greatest(nn - pp, 1) as a, (nn - pp - (seen - tp) + (n - p)) / greatest(nn - pp, 1) as b, tp / greatest(seen, 1) as ppv from cum),
auc as (select class_idx, sum(0.5 * dt * (a + b)) as auroc, sum(dt * ppv) as auprc from st group by 1)"""
INV = "inv as (select o_orderkey as exam_id, o_custkey as patient_id, o_orderpriority as source, cast(coalesce(sum(l_quantity), 0) as int) as length from orders o left join lineitem on l_orderkey = o_orderkey group by 1, 2, 3)"
IDX = "idx as (select o_orderkey as exam_id, 'a' as h5_path_src, o_orderkey * 2 as h5_idx_src from orders where o_orderkey % 7 <> 0 union all select o_orderkey, 'b', o_orderkey * 2 from orders where o_orderkey % 10 = 0)"
VEC = "vec as (select vec_id, cast(vec_id as varchar) as exam_id, cast(label as varchar) as source, t, case when vec_id % 17 = 0 and t = 5 then 'nan'::double else embedding[t + 1]::float::double end as x from embeddings cross join (select unnest(range(64)) as t))"
FLAWS = """flaws as (select cast(vec_id as varchar) as exam_id, cast(label as varchar) as source, case when vec_id % 23 = 0 then 'missing' when vec_id % 19 = 0 then 'ragged'
  when vec_id % 17 = 0 then 'nan' when vec_id % 2 = 0 and vec_id % 13 = 0 then 'no_rate' end as why from embeddings)"""
LAB = """lab as (select l.doc_id, source, case when quality = 1 then (['True', ' ' || chr(9) || 'true' || chr(9) || chr(10), '1'])[l.doc_id % 3 + 1] else 'False' end as quality, case when toxic = 1 then (['True', ' ' || chr(9) || 'true' || chr(9) || chr(10), '1'])[l.doc_id % 3 + 1] else 'False' end as toxic,
  coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 2 = 1, false) as odd from labels l join documents d on l.doc_id = d.doc_id)"""


def keyed(seed: str, *cols: str) -> str:
    return f"cast('0x' || substr(md5('{seed}' || " + " || ".join(f"'|' || coalesce(cast({c} as varchar), '')" for c in cols) + "), 1, 8) as bigint)"


SPLIT = f"""pat as (select patient_id, row_number() over (order by {keyed('42', 'patient_id')}, patient_id) - 1 as r, count(*) over () as u from (select distinct patient_id from inv where patient_id is not null)),
spl as (select inv.*, case when r < cast(floor(u * 0.8) as bigint) then 'train' when r < cast(floor(u * 0.8) as bigint) + cast(floor(u * 0.1) as bigint) then 'val' else 'test' end as split from inv left join pat on inv.patient_id = pat.patient_id)"""
BUCKETS = f"""rk as (select *, row_number() over (partition by split order by length, exam_id) - 1 as r from spl),
bl as (select split, r // 256 as block, count(*) as n from rk group by 1, 2),
bo as (select split, block, sum(n) over (partition by split order by {keyed('42', 'split', 'block')}, block) - n as start from bl),
bk as (select rk.*, bo.block, cast(start + r % 256 as bigint) as pos from rk join bo on rk.split = bo.split and r // 256 = bo.block)"""
SHARDS = "cnt as (select split, count(*) as c, ceil(count(*) / 1000.0)::bigint as m from bk group by 1), shd as (select bk.*, case when pos < (c % m) * (c // m + 1) then pos // (c // m + 1) else c % m + (pos - (c % m) * (c // m + 1)) // (c // m) end as shard_id from bk join cnt using (split))"
PLAN = f"with {INV}, {SPLIT}, {BUCKETS}, {SHARDS}"


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


def _batches(key: str) -> str:
    return f"""{PLAN}, mg as (select *, (row_number() over (partition by split, shard_id order by pos) - 1) // 512 as mega from shd),
bt as (select *, (row_number() over (partition by split, shard_id, mega order by {key}, exam_id) - 1) // 64 as batch from mg)
select split, shard_id, mega, batch, count(*) as n_rows, cast(max(length) as bigint) as width from bt group by all having count(*) > 1 and max(length) >= 50"""


MCC = "case when (tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn) > 0 then (tp::double * tn - fp::double * fn) / sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)) else 0.0 end"
CLEAN = "sm as (select exam_id, lead, t, x from lng)"
CUT = f"with {SIG}, {BOUNDS.format('1e-5')}"

ORACLES |= {
    "S1_source_pairs": "with p as (select o_orderkey as k, 'set/g' || o_orderkey % 7 || '/E.' || o_orderkey // 7 as stem from orders) select 'E.' || k // 7 as name, stem || '.dat' as signal_path, case when k % 3 <> 0 then stem || '.csv' end as meta_path, k % 3 <> 0 as has_meta from p",
    "S2_read_metadata": f"with {LAB} select doc_id, {_strip('quality')} as quality, case when not odd then {_strip('toxic')} end as toxic, case when odd then 1 else 2 end::bigint as n_classes from lab",
    "S3_read_headers": """select 'E' || c_custkey as exam_id, 'ds' || c_nationkey as dataset, '/data/ds' || c_nationkey || '/g1/E' || c_custkey || '.hea' as path,
      cast(case when c_custkey % 4 = 0 then c_custkey else c_custkey % 500 + 100 end as double) as freq, cast(case when c_custkey % 5 <> 0 then c_custkey % 90 end as double) as age,
      case when c_custkey % 3 <> 0 then c_custkey % 3 = 1 end as is_male, '1,' || c_custkey % 7 as codes from customer""",
    "S4_read_recordings": """with c as (select c_custkey as k, c_custkey % 5 as kind from customer),
      p as (select k, kind, i, i % 2 as lead, ((k * 31 + i * 97) % 2000 - 1000)::double as v from c cross join (select unnest(range(8)) as i) where k % 50 <> 7),
      y as (select k, lead, i // 2 as t, case when kind = 3 and i = 3 then null when kind = 0 then case when lead = 0 then v / 200 else (v + 5) / 100 end
        when kind = 1 then case when lead = 0 then (v - 1024) / 200 else v / 1000 end when kind = 2 then case when lead = 0 then v / 200 else (v - 7) / 50 end
        when kind = 3 then v / 200 else case when lead = 0 then v / 200 else v / 100 end end as x from p)
      select 'g' || k % 2 as folder, 'E' || k // 2 as exam_id, null::varchar as reason, lead::int as lead, t::int as t, round(x::float::double, 6) as x from y
      union all select 'g' || k % 2, 'E' || k // 2, 'a sample file is missing', null, null, null from c where k % 50 = 7""",
    "S5_to_lead_major": "select vec_id, (t % 4)::int as lead, (t // 4)::int as t, round(embedding[t + 1]::float::double, 6) as x from embeddings cross join (select unnest(range(64)) as t)",
    "S6_write_normalized": f"with {SIG} select cast(exam_id as varchar) as exam_id, cast(exam_id % 5 as varchar) as source, ({_list(RATES)})[exam_id % 5 + 1]::int as rate, count(*)::int as samples, round(sum(x0::float::double), 4) as total from sig group by exam_id",
    "S7_split_by_source": "select doc_id, source from documents where source is not null",
    "S9_read_weight_matrix": f"""with e as (select event_type as b, lag(event_type) over (partition by user_id order by ts, event_id) as a from events),
      c as (select a, b, count(*) as n from e where a is not null group by 1, 2), t as (select unnest({_list(TYPES)}) as x)
      select p.x as class_i, q.x as class_j, coalesce(n, 0)::double as w from t p cross join t q left join c on a = p.x and b = q.x""",
    "P1_normalize_id": "select cast(doc_id as varchar) as id, ' ' || source as raw, trim(source) as text from documents",
    "P3_conform_labels": "select doc_id, coalesce(trunc(case when doc_id % 5 <> 0 then quality + 0.75 end), 0)::double as quality, coalesce(toxic, 0)::double as toxic, 0.0::double as absent from labels",
    "P4_parse_true": f"with {LAB} select doc_id, (lower({_strip('quality')}) = 'true')::bigint as quality, (lower({_strip('toxic')}) = 'true')::bigint as toxic from lab",
    "P5_drop_nan_records": "select cast(vec_id as varchar) as exam_id, cast(label as varchar) as source from embeddings where vec_id % 17 <> 0",
    "P5_rejected_records": f"with {FLAWS} select exam_id, source, why, why <> 'no_rate' as dropped from flaws where why is not null",
    "P5_reject_counts": f"with {FLAWS} select 'exams' as what, count(*) as n from flaws union all select w, count(*) filter (where why = w) from flaws cross join (select unnest(['undecodable', 'missing', 'ragged', 'nan', 'no_rate']) as w) group by w",
    "P6_sigmoid_probs": f"select event_id, true as finite, k::int as class_idx, round(1 / (1 + exp(-(((event_id * 7919 + k * 104729) % 1000)::double / 100.0 - 5.0))), 6) as prob from events cross join (select unnest(range({K})) as k)",
    "P7_impute_probs": "select event_id, ([0.0, 1.0, 0.0, 0.25]::double[])[event_id % 4 + 1] as p0, 0.5::double as p1 from events",
    "P8_apply_thresholds": f"with {CELLS}, {DEC} select rec_id, class_idx::int as class_idx, d as decided from dec",
    "P9_valid_mask": f"with {INV} select exam_id, 60::bigint as width, least(length, 60)::double as valid, (length > 0)::int::double as first from inv",
    "P10_rename_normal": "select doc_id, case when doc_id % 2 = 0 then 'D2' else 'D1' end as collection, case when doc_id % 2 = 0 then coalesce(quality, toxic) else toxic end as NSR from labels",
    "G1_active_bounds": f"with {SIG}, {BOUNDS.format('1e-6')} select exam_id, s::int as start_idx, e::int as end_idx from bnd",
    "G1_active_bounds_long": f"with {SIG}, {BOUNDS.format('1e-6')} select exam_id, s::int as start_idx, e::int as end_idx from bnd",
    "G2_remove_baseline": f"""with {SIG}, {BOUNDS.format('1e-6')}, wid as (select exam_id, s, e, n, max(n) over (partition by exam_id % 5) as wide, (cast(floor(max(n) over (partition by exam_id % 5) * 0.05) as int) | 1) // 2 as h from bnd),
      c as (select *, sum(x) over (partition by exam_id, lead order by t) as cs from lng)
      select cast(a.exam_id as varchar) as exam_id, w.e::int as end_idx, a.lead, a.t::int as t, round(case when a.t >= s and a.t < e then a.x - (hi.cs - coalesce(lo.cs, 0)) / (least(a.t + h + 1, wide) - greatest(a.t - h, 0)) else 0.0 end, 6) as x
      from c a join wid w on a.exam_id = w.exam_id join c hi on hi.exam_id = a.exam_id and hi.lead = a.lead and hi.t = least(a.t + h, n - 1) left join c lo on lo.exam_id = a.exam_id and lo.lead = a.lead and lo.t = a.t - h - 1""",
    "G4_z_norm": f"""{CUT}, m as (select l.exam_id, lead, avg(x) as mu, sum(x * x) / count(*) - avg(x) ** 2 as v from lng l join bnd using (exam_id) where t >= s and t < e group by 1, 2)
      select cast(l.exam_id as varchar) as exam_id, l.lead, t::int as t, round(case when t >= s and t < e then (x - mu) / greatest(sqrt(greatest(v, 1e-8)), 1e-5) else 0.0 end, 6) as x from lng l join bnd using (exam_id) left join m on m.exam_id = l.exam_id and m.lead = l.lead""",
    "G5_length_offset": f"{CUT} select cast(exam_id as varchar) as exam_id, (e - s)::int as length, s::int as start_offset from bnd",
    "G6_trim_pad": f"{CUT}, g as (select exam_id, s, e, lead, q from bnd cross join (select unnest([0, 1]) as lead) cross join (select unnest(range(100)) as q)) select cast(g.exam_id as varchar) as exam_id, g.lead, q::int as t, round(coalesce(case when q < e - s then x end, 0.0), 6) as x from g left join lng l on l.exam_id = g.exam_id and l.lead = g.lead and l.t = q + s",
    "G7_center_pad": f"""{CUT}, g as (select exam_id, s, e, lead, q, (400 - (e - s)) // 2 as b from bnd cross join (select unnest([0, 1]) as lead) cross join (select unnest(range(400)) as q))
      select cast(g.exam_id as varchar) as exam_id, g.lead, q::int as t, round(coalesce(case when q >= b and q < b + e - s then x end, 0.0), 6) as x from g left join lng l on l.exam_id = g.exam_id and l.lead = g.lead and l.t = q - b + s""",
    "G8_segment_windows": f"""{CUT}, g as (select exam_id, lead, k, q from (select exam_id, unnest(range(cast(ceil((e - s) / 25.0) as bigint))) as k from bnd) cross join (select unnest([0, 1]) as lead) cross join (select unnest(range(25)) as q))
      select cast(g.exam_id as varchar) as exam_id, k::int as window, g.lead, q::int as t, round(coalesce(x, 0.0), 6) as x from g left join lng l on l.exam_id = g.exam_id and l.lead = g.lead and l.t = k * 25 + q""",
    "J1_build_inventory": f"with {INV}, {IDX} select exam_id, patient_id, source, length, h5_path_src, h5_idx_src from inv join idx using (exam_id)",
    "J2_align_metadata": f"with {INV}, {IDX} select idx.exam_id, h5_path_src, patient_id, source, length from idx left join (select * from inv where exam_id % 4 <> 0) i on i.exam_id = idx.exam_id",
    "J3_keep_matching": f"with {INV}, {IDX} select * from inv where exam_id in (select exam_id from idx)",
    "A2_audit_signals": f"""with {VEC} select source, count(distinct exam_id) as n, 4::int as leads, 16::int as samples, bool_or(isnan(x)) as has_nan, false as has_inf, bool_or(abs(x) > 0 and abs(x::float) < 6.1e-5) as has_underflow,
      round(min(x) filter (where not isnan(x)), 6) as min_value, round(max(x) filter (where not isnan(x)), 6) as max_value, false as has_overflow, 'ok' as status from vec group by source""",
    "A3_longest_signal": f"with {INV} select exam_id, source, ({_list(RATES)})[exam_id % 5 + 1]::int as rate, length, length / 400 as seconds from inv order by length desc, exam_id limit 1",
    "A4_confusion_per_class": f"with {CELLS}, {DEC}, {CONF} select class_idx::int as class_idx, tp, fp, fn, tn from conf",
    "A4_confusion_normalized": f"with {CELLS}, {DEC}, nl as (select *, 1.0::double / greatest(sum(label::int) over (partition by rec_id), 1) as wt from dec) select class_idx::int as class_idx, "
    + ", ".join(f"round(coalesce(sum(wt) filter (where {c}), 0), 6) as {n}" for n, c in (("tp", "label and d"), ("fp", "not label and d"), ("fn", "label and not d"), ("tn", "not label and not d"))) + " from nl group by 1",
    "A5_f_measure": f"with {CELLS}, {DEC}, {CONF} select class_idx::int as class_idx, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1 from conf",
    "A6_exact_match": f"with {CELLS}, {DEC} select round(avg(ok::int), 6) as exact_match from (select bool_and(label = d) as ok from dec group by rec_id)",
    "A7_hamming_loss": f"with {CELLS}, {DEC} select round(avg((label <> d)::int), 6) as hamming_loss from dec",
    "A8_brier": f"with {CELLS} select class_idx::int as class_idx, round(avg((prob - label::int) ** 2), 6) as brier from cells group by 1 union all select -1, round(avg((prob - label::int) ** 2), 6) from cells",
    "A9_mcc": f"with {CELLS}, {DEC}, {CONF}, t as (select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, sum(tn)::bigint as tn from conf) select round({MCC}, 6) as mcc from t",
    "A10_binary_sick": f"""with {CELLS}, {DEC}, b as (select bool_or(label) filter (where class_idx <> 0) as y, bool_or(d) filter (where class_idx <> 0) as p from dec group by rec_id),
      t as (select sum((y and p)::int)::bigint as tp, sum((not y and p)::int)::bigint as fp, sum((y and not p)::int)::bigint as fn, sum((not y and not p)::int)::bigint as tn from b)
      select tp, fp, fn, tn, round(tp / (tp + fn), 6) as sensitivity, round(tn / (tn + fp), 6) as specificity, round(2 * tp / (2 * tp + fp + fn), 6) as f1, round({MCC}, 6) as mcc, round((tp + fn) / (tp + fp + fn + tn), 6) as prevalence from t""",
    "A11_roc_pr_auc": f"with {CELLS}, {AUC} select class_idx::int as class_idx, {_r('auroc', 'auprc')} from auc",
    "A12_pair_confusion": f"with {CELLS}, {DEC}, u as (select rec_id, sum((label or d)::int) as n from dec group by 1) select a.class_idx::int as class_i, b.class_idx::int as class_j, round(sum(1.0::double / n), 6) as a from dec a join dec b on a.rec_id = b.rec_id join u on u.rec_id = a.rec_id where a.label and b.d group by 1, 2",
    "A13_challenge_score": f"with {CELLS}, {DEC}, {W}, {REC} select round((sum(obs) - sum(ina)) / (sum(cor) - sum(ina)), 6) as challenge_score from rec",
    "A15_per_class_report": f"with {CELLS}, {DEC}, {CONF}, {AUC}, br as (select class_idx, avg((prob - label::int) ** 2) as brier from cells group by 1) select class_idx::int as class_idx, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1, round(tp / (tp + fn + 1e-9), 6) as recall, round(tn / (tn + fp + 1e-9), 6) as specificity, {_r('auroc', 'auprc', 'brier')} from conf join auc using (class_idx) join br using (class_idx)",
    "A16_evaluation_summary": f"""with {CELLS}, {DEC}, {W}, {REC}, {decided([0.4] * K, 'd1')}, {decided([0.5] * K, 'd2')}, {AUC},
      f as (select avg(2 * tp / nullif(2 * tp + fp + fn, 0)) as macro_f1 from (select sum((label and d)::int) as tp, sum((not label and d)::int) as fp, sum((label and not d)::int) as fn from d1 group by class_idx)),
      m as (select sum((label and d)::int)::bigint as tp, sum((not label and d)::int)::bigint as fp, sum((label and not d)::int)::bigint as fn, sum((not label and not d)::int)::bigint as tn from d2)
      select (select round((sum(obs) - sum(ina)) / (sum(cor) - sum(ina)), 6) from rec) as challenge_score, round(macro_f1, 6) as macro_f1, (select round({MCC}, 6) from m) as mcc,
      (select round(avg(ok::int), 6) from (select bool_and(label = d) as ok from dec group by rec_id)) as exact_match, (select round(avg(auroc), 6) from auc) as mean_auroc, (select round(avg(auprc), 6) from auc) as mean_auprc, (select round(avg((prob - label::int) ** 2), 6) from cells) as brier from f""",
    "A18_macro_ap": f"with {CELLS}, {AUC} select round(avg(auprc), 6) as macro_ap from auc",
    "W1_patient_split": f"with {INV}, {SPLIT} select exam_id, patient_id, split from spl",
    "W2_assign_patient_ids": "select 'ds' || c_nationkey % 4 as dataset, 'p/' || md5(c_name) as path, row_number() over (order by 'ds' || c_nationkey % 4, 'p/' || md5(c_name)) as patient_id from customer",
    "W3_length_buckets": f"with {INV}, {SPLIT}, {BUCKETS} select exam_id, split, block, pos from bk",
    "W4_assign_shards": f"{PLAN} select exam_id, split, pos, shard_id from shd",
    "W5_shard_stats": f"{PLAN} select split, shard_id, count(*) as n_rows, max(length) as max_length from shd group by 1, 2",
    "W6_batch_plan": _batches(f"length * (1 + ({keyed('42', 'exam_id')} / 4294967296.0::double - 0.5::double) * 0.4::double)"),
    "W6_batch_plan_validation": _batches("length"),
    "W7_sample_per_source": f"with {INV}, s as (select exam_id, source, row_number() over (partition by source order by {keyed('42', 'exam_id')}, exam_id) as k from inv) select exam_id, source, row_number() over (partition by source order by exam_id)::int as sample_pos from s where k <= 20",
    "U2_probability_intervals": f"with {CELLS} select class_idx::int as class_idx, len(list_filter({_list(CANDIDATES, 'double')}, lambda c: prob >= c))::int as step, count(*) as n, sum(label::int)::bigint as positives from cells group by 1, 2",
}
ORACLES["G4_z_norm_long"] = ORACLES["G4_z_norm"]

ORACLES["U1_score_batches"] = f"""{CUT}, inv as (select exam_id, exam_id as patient_id, (e - s)::int as length from bnd), {SPLIT}, {BUCKETS}, {SHARDS},
mg as (select *, (row_number() over (partition by split, shard_id order by pos) - 1) // 128 as mega from shd),
bt as (select *, (row_number() over (partition by split, shard_id, mega order by length, exam_id) - 1) // 16 as batch from mg),
wd as (select *, count(*) over w as nr, max(length) over w as width from bt window w as (partition by split, shard_id, mega, batch)),
ok as (select exam_id, length, width from wd where nr > 1 and width >= 50 and exam_id % 31 not in (3, 7)),
st as (select exam_id, avg(x) filter (where lead = 0) as a, greatest(max(x) filter (where lead = 0), case when any_value(length < width) then 0 end) as g, avg(x) filter (where lead = 1) as c, any_value(length)::double / any_value(width) as f, any_value(width) as width
  from ok join bnd using (exam_id) join lng using (exam_id) where t >= s and t < e group by exam_id),
lg as (select exam_id, width, unnest([0, 1, 2, 3, 4]) as k, unnest([a / 50 - 1, g / 100, c / 50, f, a - c]) as z from st)
select exam_id as rec_id, k::int as class_idx, exam_id % 5 = k as label, round(1 / (1 + exp(-z)), 6) as prob, width::bigint as width from lg"""
_POINT = f"""{CUT}, g as (select exam_id, lead, k, q from (select exam_id, unnest(range(cast(ceil((e - s) / 25.0) as bigint))) as k from bnd) cross join (select unnest([0, 1]) as lead) cross join (select unnest(range(25)) as q)),
v as (select g.exam_id, k, g.lead, q, coalesce(x, 0.0) as x, max(abs(coalesce(x, 0.0))) over (partition by g.exam_id, k) as peak from g left join lng l on l.exam_id = g.exam_id and l.lead = g.lead and l.t = k * 25 + q)
select cast(exam_id as varchar) as exam_id, k::int as window, lead, q::int as t, """
ORACLES["G9_trace_coords"] = _POINT + "trunc(q * (511 / 24::double))::int as px, least(greatest(trunc(trunc(512 * 0.05::double + lead * (512 * 0.9::double)) - x * (512 * 2.7::double / 512.0)), 0), 511)::int as py from v"
ORACLES["G9_trace_coords_per_channel"] = _POINT + "trunc(q * (511 * 16 / 24::double))::int as px, trunc(least(greatest(256.0::double - x * (512 * 0.4::double / (peak + 1e-6::double)), 0), 511) * 16)::int as py from v"
ORACLES["A17_norm_quality"] = f"""with q as ({ORACLES['G4_z_norm'].replace('round(case', '(case').replace('end, 6) as x', 'end) as x')}),
o as (select exam_id, coalesce(min(t) filter (where abs(x) > 1e-5), 0) as s, coalesce(max(t) filter (where abs(x) > 1e-5) + 1, 0) as e from q group by 1),
l as (select exam_id, lead, avg(x) as mu, sqrt(greatest(avg(x * x) - avg(x) ** 2, 0)) as sd from q join o using (exam_id) where t >= s and t < e group by 1, 2),
z as (select exam_id, max(abs(mu)) as max_abs_mean, min(sd) as min_std, max(sd) as max_std from l group by 1)
select exam_id, round(max_abs_mean, 5) as max_abs_mean, round(min_std, 5) as min_std, round(max_std, 5) as max_std, true as padding_clean, max_abs_mean < 0.2 and min_std > 0.5 and max_std < 1.5 as valid from z"""
_WEIGHT = f"""with {LAB}, c as (select 'quality' as class, quality as v from lab union all select 'toxic', toxic from lab where not odd),
a as (select class, count(*) as total, sum((lower({_strip('v')}) = 'true')::int)::bigint as positives from c group by 1), b as (select *, round(case when positives = 0 then total::double else (total - positives) / positives end, 6) as pos_weight from a)"""
ORACLES["A1_class_weights"] = f"{_WEIGHT} select class, total, positives, pos_weight, round(sqrt(pos_weight), 6) as sqrt_weight from b"
ORACLES["S10_write_json_map"] = f"{_WEIGHT} select class, pos_weight from b"

_PICK = ", ".join(f"(o_orderkey * {m} + {a}) % {len(CODES) + 4}" for m, a in ((7, 0), (11, 3), (13, 8)))
_MERGE = {"IAVB": "1dAVb", "STach": "ST", "CRBBB": "RBBB", "IRBBB": "RBBB", "CLBBB": "LBBB"}
_NAMES = [_MERGE.get(c, c) for c in CODES.values()]
ORACLES["P2_derive_labels"] = f"""with p as (select o_orderkey as exam_id, unnest([{_PICK}]) as k from orders), c as (select distinct exam_id, ({_list(_NAMES)})[k + 1] as class from p where k < {len(CODES)})
select exam_id, class from c where class <> 'Brady' or exam_id not in (select exam_id from c where class = 'SB')"""
assert set(_NAMES) == set(CLASSES)

ORACLES["S8_write_shards"] = f"""with ln as (select l_orderkey as exam_id, row_number() over w as k, l_quantity as q, l_suppkey % 100 as p from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity)),
sg as (select exam_id, lead, k - 1 as t, case when k = 1 and exam_id % 3 = 0 then 0 when lead = 0 then q else p end as x from ln cross join (select unnest([0, 1]) as lead)),
ab as (select exam_id, coalesce(min(t) filter (where x <> 0), 0)::int as s, coalesce(max(t) filter (where x <> 0) + 1, 0)::int as e from sg group by 1),
inv as (select o_orderkey as exam_id, o_custkey as patient_id, o_orderpriority as source, e - s as length, s as start_offset from orders join ab on exam_id = o_orderkey),
{SPLIT}, {BUCKETS}, {SHARDS}, wd as (select split, shard_id, max(length) as width from shd group by 1, 2),
lp as (select o_orderkey as exam_id, unnest([{_PICK}]) as k from orders), lc as (select distinct exam_id, ({_list(_NAMES)})[k + 1] as class from lp where k < {len(CODES)}),
lf as (select * from lc where class <> 'Brady' or exam_id not in (select exam_id from lc where class = 'SB')),
lb as (select exam_id, string_agg(class, ',' order by list_position({_list(CLASSES)}, class)) as labels from lf group by 1)
select shd.exam_id, shd.split, shd.shard_id, pos, patient_id, source, start_offset, length, width, coalesce(labels, '') as labels, lead::int as lead, t::int as t, coalesce(x, 0)::double as x
from shd join wd using (split, shard_id) left join lb on lb.exam_id = shd.exam_id cross join (select unnest([0, 1]) as lead) cross join lateral (select unnest(range(width)) as t)
left join (select exam_id as e2, lead as l2, t as t2, x from sg) g on e2 = shd.exam_id and l2 = lead and t2 = t + start_offset and t < length"""
_CDF = "[0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]::double[]"


def _bootstrap(draws: str) -> str:
    """draws: it, rec_id, m."""
    return f"""with {CELLS}, {DEC}, {W}, {REC}, it as (select unnest(range(100)) as it), {draws},
ch as (select it, sum(m * obs) as o, sum(m * cor) as c, sum(m * ina) as n from dr join rec using (rec_id) group by it),
cf as (select it, class_idx, sum(m) as cells, sum(m * (label <> d)::int) as wrong, sum(m * (label and d)::int) as tp, sum(m * (not label and d)::int) as fp, sum(m * (label and not d)::int) as fn from dr join dec using (rec_id) group by 1, 2),
v as (select 'challenge' as metric, (o - n) / (c - n) as v from ch union all select 'macro_f1', avg(2 * tp / nullif(2 * tp + fp + fn, 0)) from cf group by it union all select 'hamming_loss', sum(wrong) / sum(cells) from cf group by it)
select metric, round(avg(v), 6) as mean, round(quantile_cont(v, 0.025), 6) as lower, round(quantile_cont(v, 0.975), 6) as upper from v group by 1"""


_STEP = "({0} * 1103515245 + 12345) % 2147483648"


def _mixed(source: str, columns: str, start: str, *then: str) -> str:
    """columns and h of source: start mixed, then with each of `then` a xor before it is mixed again ('' for none)."""
    q = f"select {columns}, {_STEP.format('(' + start + ')')} as y from {source}"
    for x in then:
        h = "xor(y, y >> 15)"
        q = f"select {columns}, {_STEP.format(f'xor({h}, {x})' if x else h)} as y from ({q})"
    return f"select {columns}, xor(y, y >> 15) as h from ({q})"


def _splits() -> str:
    """dr (it, rec_id, m): a resample's draws split by binomials down a tree of LEAVES leaves, then drawn in each leaf."""
    q = [f"lf as (select rec_id, {keyed('42', 'rec_id')} % {LEAVES} as leaf from rec), rk as (select *, row_number() over (partition by leaf order by rec_id) - 1 as k from lf)"]
    q.append(f"nb as (select leaf, count(rec_id) as c from (select unnest(range({LEAVES})) as leaf) left join lf using (leaf) group by leaf)")
    q.append("m0 as (select it, 1 as node, (select sum(c) from nb)::bigint as m from it)")
    depth = LEAVES.bit_length() - 1
    for d in range(depth):
        size = LEAVES >> d
        share = f"select leaf // {size} + {1 << d} as node, sum(c)::bigint as w, (sum(c) filter (where leaf % {size} < {size // 2}))::bigint as l from nb group by 1"
        q.append(f"s{d} as (select a.*, l / w::double as p from m{d} a join ({share}) b using (node)), u{d} as ({_mixed(f's{d}', 'it, node, m, p', 'it + 42', 'node', '')})")
        q.append(f"""r{d} as (select *, (h + 0.5::double) / 2147483648.0::double as u, greatest(floor(m * p - 12 * sqrt(m * p * (1 - p)))::bigint - 12, 0) as lo, least(ceil(m * p + 12 * sqrt(m * p * (1 - p)))::bigint + 12, m) as hi from u{d}),
c{d} as (select *, sum(exp(lgamma(m + 1.0::double) - lgamma(k + 1.0::double) - lgamma(m - k + 1.0::double) + k * ln(p) + (m - k) * ln(1 - p))) over (partition by it, node order by k) as cdf from (select *, unnest(range(lo, hi + 1)) as k from r{d})),
k{d} as (select it, node, m, least(lo + count(*) filter (where cdf < u), hi) as k from c{d} group by it, node, m, lo, hi, u)""")
        q.append(f"m{d + 1} as (select it, 2 * node as node, k as m from k{d} union all select it, 2 * node + 1, m - k from k{d})")
    bases = _mixed(f"m{depth}", "it, node, m", "it + 42", "node", "")
    q.append(f"bs as ({bases}), dd as (select it, node, h as base, unnest(range(m)) as d from bs), hs as ({_mixed('dd', 'it, node, base', 'd', 'base', '')})")
    q.append(f"dr as (select it, rec_id, count(*) as m from hs join nb on nb.leaf = node - {LEAVES} join rk on rk.leaf = node - {LEAVES} and rk.k = (h * c) >> 31 group by 1, 2)")
    return ", ".join(q)


ORACLES["A14_bootstrap_ci"] = _bootstrap(_splits())
ORACLES["A14_bootstrap_poisson"] = _bootstrap(f"dr as (select it, rec_id, len(list_filter({_CDF}, lambda c: ({keyed('42', 'it', 'rec_id')} + 0.5::double) / 4294967296.0::double > c)) as m from rec cross join it)")

_RUNS = """r as (select 'run' || c_nationkey as run_id, 'model' || c_nationkey % 3 as name, count(*) as n, min(c_acctbal) as lo, max(c_acctbal) as hi, floor(sum(cast(round(c_acctbal * 100) as bigint)) / count(*)) / 100 as mean from customer group by c_nationkey),
b as (select 'stat' as kind, run_id, name, 'macro_f1' as metric, mean, lo as lower, hi as upper, 1 as dir from r union all select 'stat', run_id, name, 'hamming_loss', hi, null, null, -1 from r union all select 'stat', run_id, name, 'mean_auprc', lo, null, null, 1 from r
 union all select 'stat', run_id, name, 'challenge_score', n, null, null, 1 from r union all select 'perf', run_id, name, 'temps_inference_sec', hi, null, null, -1 from r union all select 'perf', run_id, name, 'rate', n, null, null, 1 from r
 union all select 'bin', run_id, name, 'f1_score', mean, null, null, 1 from r union all select 'bin', run_id, name, 'loss', lo, null, null, -1 from r)"""
ORACLES["R1_leaderboard"] = f"with {_RUNS} select kind, run_id, name, metric, {_r('mean', 'lower', 'upper')}, mean * dir = max(mean * dir) over (partition by kind, metric) as best from b"
ORACLES["R2_format_metrics"] = f"""with {_RUNS}, f as (select run_id, name, metric, case when upper is not null then printf('%.3f / %.3f / %.3f', upper, mean, lower) else printf('%.3f', mean) end as s from b where kind = 'stat')
select run_id, name, """ + ", ".join(f"coalesce(max(s) filter (where metric = '{m}'), '-') as {m}" for m in ("macro_f1", "hamming_loss", "challenge_score", "mean_auprc")) + " from f group by 1, 2"

# -- resampling and spectra as plain sums --------------------------------------------------------------------------


def _i0(z: str) -> str:
    """The modified Bessel function of order 0, by its power series."""
    return f"list_sum(list_transform(range(60), lambda k: exp(2 * k * ln(({z}) / 2 + 1e-300) - 2 * lgamma(k + 1))))"


def _fourier(source: str, n: int, *keys: str) -> str:
    """re and im of source (keys, f, j, v) by frequency q."""
    by = ", ".join(keys)
    return f"""select {by}, f, q, sum(v * cos(2 * pi() * q * j / {n})) as re, sum(v * sin(2 * pi() * q * j / {n})) as im
    from {source} cross join (select unnest(range({n // 2 + 1})) as q) group by {by}, f, q"""


_RESAMPLED = f"""{SIG}, rt as (select exam_id, max(t) + 1 as n, ({_list(RATES)})[exam_id % 5 + 1] as rate from lng group by 1),
rr as (select *, rate // gcd(rate, 400) as old, 400 // gcd(rate, 400) as new from rt),
ot as (select exam_id, old, new, least(old, new) * 0.99::double as cut, unnest(range(cast(ceil(new * n / old::double) as bigint))) as m from rr),
tap as (select o.exam_id, lead, m, x, cut / old as g, (t / old::double - m / new::double) * cut as z from ot o join lng l on l.exam_id = o.exam_id and abs(t / old::double - m / new::double) * cut < 6),
ker as (select *, case when z = 0 then 1.0 else sin(pi() * z) / (pi() * z) end * ({_i0('14.769656459379492 * sqrt(greatest(1 - (z / 6) ** 2, 0))')}) / ({_i0('14.769656459379492')}) * g as h from tap),
rs as (select exam_id, lead, m, sum(x * h) as x from ker group by 1, 2, 3)"""
ORACLES["G3_resample"] = f"with {_RESAMPLED} select cast(exam_id as varchar) as exam_id, lead, m::int as t, round(x, 4) as x from rs"
def _bins(samples: str, exams: str, n: int, *keys: str) -> str:
    """bn (keys, f, q, re, im): the transforms of windowed frames, sums over samples that are not 0; bins without one are 0.

    samples: keys, f, j, v; exams: keys, frames.
    """
    by = ", ".join(keys)
    return f"""ft as ({_fourier(f"(select * from {samples} where v <> 0)", n, *keys)}),
bn as (select {by}, f, q, coalesce(re, 0) as re, coalesce(im, 0) as im from (select {by}, unnest(range(frames)) as f from {exams}) cross join (select unnest(range({n // 2 + 1})) as q) left join ft using ({by}, f, q))"""


ORACLES["G10_log_spectrogram"] = f"""with {_RESAMPLED}, nn as (select exam_id, max(m) + 1 as n from rs group by 1),
ex as (select exam_id, lead, n, n // 64 + 1 as frames from nn cross join (select unnest([0, 1]) as lead)),
fr as (select exam_id, lead, f, j, n, f * 64 + j - 64 as p from (select exam_id, lead, n, unnest(range(frames)) as f from ex) cross join (select unnest(range(128)) as j)),
sm as (select a.exam_id, a.lead, f, j, x * (0.5 - 0.5 * cos(2 * pi() * j / 128)) as v from fr a join rs on rs.exam_id = a.exam_id and rs.lead = a.lead
  and rs.m = case when n > 64 and p < 0 then -p when n > 64 and p >= n then 2 * (n - 1) - p else p end),
{_bins('sm', 'ex', 128, 'exam_id', 'lead')}, lg as (select *, ln(greatest(re * re + im * im, 1e-10)) as s from bn)
select cast(exam_id as varchar) as exam_id, lead, q::int as freq, f::int as frame,
  round((s - avg(s) over (partition by exam_id, lead)) / greatest(stddev_samp(s) over (partition by exam_id, lead), 1e-8), 4) as x from lg"""
ORACLES["G11_chunk_stft"] = f"""{CUT}, ex as (select exam_id, lead, k, 63 as frames from (select exam_id, e - s as length, unnest(range(cast(ceil(n / 4000.0) as bigint))) as k from bnd) cross join (select unnest([0, 1]) as lead) where k * 4000 < length),
fr as (select exam_id, lead, k, f, j, f * 64 + j - 128 as p from (select exam_id, lead, k, unnest(range(frames)) as f from ex) cross join (select unnest(range(256)) as j)),
sm as (select a.exam_id, a.lead, k, f, j, x * (0.5 - 0.5 * cos(2 * pi() * j / 256)) as v from fr a join lng l on l.exam_id = a.exam_id and l.lead = a.lead
  and l.t = k * 4000 + case when p < 0 then -p when p >= 4000 then 7998 - p else p end),
{_bins('sm', 'ex', 256, 'exam_id', 'lead', 'k')},
lx as (select *, ln(1 + sqrt(re * re + im * im)) as x from bn)
select cast(exam_id as varchar) as exam_id, k::int as chunk, lead, q::int as freq, count(*)::int as frames, round(sum(x), 3) as total, round(sum(x * f) / 63, 3) as by_frame, round(max(x), 4) as greatest from lx group by exam_id, k, lead, q"""
_CLEANED = ORACLES["G2_remove_baseline"].replace("round(case", "(case").replace("else 0.0 end, 6) as x", "else 0.0 end) as x")
ORACLES["normalize_signals"] = f"""with g2 as ({_CLEANED}), rt as (select distinct exam_id, end_idx as n, cast(exam_id as int) % 5 as k, ({_list(RATES)})[cast(exam_id as int) % 5 + 1] as rate from g2),
rr as (select *, rate // gcd(rate, 400) as old, 400 // gcd(rate, 400) as new from rt where k <> 4),
ot as (select exam_id, n, old, new, least(old, new) * 0.99::double as cut, unnest(range(cast(ceil(new * n / old::double) as bigint))) as m from rr),
tap as (select o.exam_id, lead, m, x, cut / old as g, (t / old::double - m / new::double) * cut as z from ot o join g2 on g2.exam_id = o.exam_id and t < n and abs(t / old::double - m / new::double) * cut < 6),
ker as (select *, case when z = 0 then 1.0 else sin(pi() * z) / (pi() * z) end * ({_i0('14.769656459379492 * sqrt(greatest(1 - (z / 6) ** 2, 0))')}) / ({_i0('14.769656459379492')}) * g as h from tap),
y as (select exam_id, lead, m as t, sum(x * h) as x from ker group by 1, 2, 3 union all select exam_id, lead, t, x from g2 where cast(exam_id as int) % 5 = 4),
sz as (select exam_id, count(*) // 2 as n, coalesce(min(t) filter (where abs(x) > 1e-5), 0) as s, coalesce(max(t) filter (where abs(x) > 1e-5) + 1, 0) as e from y group by 1),
mo as (select y.exam_id, lead, avg(x) as mu, avg(x * x) - avg(x) ** 2 as v from y join sz on sz.exam_id = y.exam_id and t >= s and t < e group by 1, 2),
z as (select y.exam_id, t, (x - mu) / greatest(sqrt(greatest(v, 1e-8)), 1e-5) as z from y join sz on sz.exam_id = y.exam_id and t >= s and t < e join mo on mo.exam_id = y.exam_id and mo.lead = y.lead),
zb as (select exam_id, min(t) as s, max(t) + 1 as e from z where abs(z) > 1e-5 group by 1)
select rt.exam_id, cast(k as varchar) as source, coalesce(zb.e - zb.s, 0)::int as length, coalesce(zb.s, 0)::int as start_offset, coalesce(sz.n, 0) || ',' || coalesce(sz.n, 0) as sizes
from rt left join sz on sz.exam_id = rt.exam_id left join zb on zb.exam_id = rt.exam_id"""


# -- test exams ------------------------------------------------------------------------------------------------------


def _stirred(source: str, *names: str) -> str:
    """source with each named whole number turned into a share between 0 and 1."""
    for _ in range(3):
        source = f"(select * replace ({', '.join(f'(({n} * 1103515245 + 12345) % 2147483648) as {n}' for n in names)}) from {source})"
        source = f"(select * replace ({', '.join(f'xor({n}, {n} >> 15) as {n}' for n in names)}) from {source})"
    return f"(select * replace ({', '.join(f'(({n} + 0.5::double) / 2147483648) as {n}' for n in names)}) from {source})"


_EXAM = "7 + key * 7919 + rate * 104729 + lead * 1299709"
_LEAD_ROWS = f"""(select *, {', '.join(f'({_EXAM} + {n} * 611953) % 2147483648 as u{n}' for n in (1, 2, 3, 4))} from (select s_suppkey::bigint as key from supplier)
  cross join (select unnest([1000, 257, 250, 500, 128]::bigint[]) as rate) cross join (select event_id % 12 as lead, round(stddev_pop(value), 6) as amplitude, round(avg(value), 6) as o from events group by 1))"""
_SAMPLE_ROWS = f"(select *, {', '.join(f'({_EXAM} + t * 15485863 + {n} * 32452843) % 2147483648 as v{n}' for n in (5, 6))} from (select *, unnest(range(rate * 2)) as t from ld))"
ORACLES["W8_synthetic_exams"] = f"""with ld as (select key, rate, lead, (2 * u1 - 1) * amplitude as a, (2 * u2 - 1) * o as o, 0.5 + 2.5 * u3 as f, 2 * pi() * u4 as p from {_stirred(_LEAD_ROWS, 'u1', 'u2', 'u3', 'u4')}),
x as (select *, round((a * sin(2 * pi() * f * (t / rate) + p) + o + sqrt(-2 * ln(v5)) * cos(2 * pi() * v6) * 0.1 * abs(a))::float::double, 6) as x from {_stirred(_SAMPLE_ROWS, 'v5', 'v6')})
select 'SYNTH_Fs' || rate || '_' || key as exam_id, rate::int as rate, lead::int as lead, count(*) as n, round(avg(x), 4) as mean, round(max(x), 3) as greatest from x group by all"""


# -- threshold search ------------------------------------------------------------------------------------------------


def _tuning(epochs: int) -> str:
    """Every step as a CTE: `b{s}` sums by candidate interval, `c{s}` the candidates' scores, `n{s + 1}` the thresholds after it."""
    wy = "[" + ", ".join(" + ".join(f"y[{a + 1}]::int * {WEIGHTS[a][j]!r}::double" for a in range(K)) for j in range(K)) + "]"
    add = lambda xs: " + ".join(xs)
    parts = [
        CELLS,
        "rc as (select rec_id, list(label order by class_idx) as y, list(prob order by class_idx) as p from cells group by 1)",
        f"""ba as materialized (select y, p, wy, ny, {add(f'y[{j + 1}]::int * wy[{j + 1}]' for j in range(K))} as cor0, wy[1] as ina0,
        list_transform(p, lambda v: len(list_filter({_list(CANDIDATES, 'double')}, lambda c: v >= c))) as st from (select *, {wy} as wy, {add(f'y[{j + 1}]::int' for j in range(K))} as ny from rc))""",
        f"n0 as (select {_list([0.5] * K, 'double')} as th)",
        f"ca as (select unnest(range({len(CANDIDATES)})) as c, unnest({_list(CANDIDATES, 'double')}) as th)",
    ]
    for s in range(epochs * K):
        i = s % K + 1
        others = [j for j in range(1, K + 1) if j != i]
        d = {j: f"(p[{j}] >= th[{j}])" for j in others}
        off = add(f"{d[j]}::int * wy[{j}]" for j in others)
        un = add(f"(y[{j}] or {d[j]})::int" for j in others)
        counts = ", ".join(f"sum((y[{j}] and {d[j]})::int) as tp{j}, sum((not y[{j}] and {d[j]})::int) as fp{j}, sum(y[{j}]::int) as p{j}" for j in others)
        parts.append(f"""b{s} as materialized (select st[{i}] as k, sum(({off} + wy[{i}]) / ({un} + 1)) as hi, sum(case when {un} + y[{i}]::int > 0 then ({off}) / ({un} + y[{i}]::int) else 0 end) as lo,
        sum(case when ny > 0 then cor0 / ny else 0 end) as cor, sum(ina0 / (ny + (not y[1])::int)) as ina, count(*) as n, sum(y[{i}]::int) as pos, {counts} from ba cross join n{s} group by 1)""")
        fixed = ", ".join(f"sum(tp{j}) as tp{j}, sum(fp{j}) as fp{j}, sum(p{j}) as p{j}" for j in others)
        parts.append(f"""s{s} as (select c, any_value(th) as cand, sum(case when k > c then hi else lo end) as obs, sum(cor) as cor, sum(ina) as ina, sum(n) * {K} as cells,
        coalesce(sum(pos) filter (where k > c), 0) as tp{i}, coalesce(sum(n - pos) filter (where k > c), 0) as fp{i}, sum(pos) as p{i}, {fixed} from ca cross join b{s} group by c)""")
        f1 = ", ".join(f"2 * tp{j}::double / nullif(tp{j} + fp{j} + p{j}, 0)" for j in range(1, K + 1))
        parts.append(f"""c{s} as materialized (select *, case when abs(cor - ina) > 1e-12 then round((obs - ina) / (cor - ina), 12) else 0.0 end as challenge_score, round(list_avg(list_filter([{f1}], lambda v: v is not null)), 12) as macro_f1,
        round(case when (a + b)::double * e * (cells - e) * (cells - a - b) > 0 then (a::double * (cells - b - e) - b::double * (e - a)) / sqrt((a + b)::double * e * (cells - e) * (cells - a - b)) else 0.0 end, 12) as mcc
        from (select *, {add(f'tp{j}' for j in range(1, K + 1))} as a, {add(f'fp{j}' for j in range(1, K + 1))} as b, {add(f'p{j}' for j in range(1, K + 1))} as e from s{s}))""")
        tried = lambda v: "[" + ", ".join(v if j == i else f"th[{j}]" for j in range(1, K + 1)) + "]"  # noqa: B023, E731
        parts.append(f"v{s} as materialized (select {s} * 1000 + c as nth, {tried('cand')} as th, challenge_score, macro_f1, mcc from c{s} cross join n{s})")
        parts.append(f"n{s + 1} as materialized (select th from v{s} order by challenge_score desc, nth limit 1)")
    parts.append("v as (" + " union all ".join(f"select * from v{s}" for s in range(epochs * K)) + ")")
    best = " union all ".join(f"(select '{m}' as metric, th, {m} as score from v where {m} is not null order by {m} desc, nth limit 1)" for m in ("challenge_score", "macro_f1", "mcc"))
    return f"with {', '.join(parts)} select metric, k::int as class_idx, round(th[k + 1], 2) as threshold, round(score, 6) as score from ({best}) cross join (select unnest(range({K})) as k)"


ORACLES["U2_tune_thresholds"] = _tuning(3)
