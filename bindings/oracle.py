"""SQL (DuckDB dialect) with the same result as each query that SQL can express."""

from __future__ import annotations

import numpy as np

from bindings.queries import ATTENTION, FOLD_IDS, FOLDS, SHRINKAGE, TOKEN_POOL, WIDTH, head_parameters
from strandline.functions.hashing import seeded_parameters
from strandline.functions.text import NOT_A_TOKEN, WHITESPACE

SPAN = "4503599627370496.0"


def _unit(text: str, slot: int = 0) -> str:
    return f"(cast('0x' || substr(md5({text}), {1 + 13 * slot}, 13) as bigint) / {SPAN})"


def _list(values) -> str:
    """Numpy array as a (nested) SQL list of doubles."""
    if np.ndim(values) == 0:
        return f"{float(values)!r}::double"
    return "[" + ", ".join(_list(v) for v in values) + "]"


LABELLED = """labelled as (
    select d.doc_id, d.lang, d.n_chars, l.quality as Label
    from documents d join labels l on d.doc_id = l.doc_id)"""

CLEANED = f"""cleaned as (
    select *, trim(text, '{WHITESPACE}') as clean_sequence,
           upper(trim(lang, '{WHITESPACE}')) as input_category
    from documents)"""

ROUTED = "case when input_category = 'EN' then 'NULL' else input_category end"

ACCEPTED = "clean_sequence is not null and input_category in ('EN', 'DE', 'FR')"

STATIC_INDEX = "case {c} when 'DE' then 0 when 'FR' then 1 when 'NULL' then 3 else 2 end"


def _vocab(source: str, column: str) -> str:
    return f"""found as (select distinct {column} as value from {source} where {column} is not null),
    vocab as (
        select value, cast(row_number() over (order by value) - 1 as int) as idx from found
        union all select '<UNK>', cast(count(*) as int) from found
        union all select 'NULL', cast(count(*) + 1 as int) from found)"""


def _kfold(source: str, key: str, stratum: str) -> str:
    """Rows laid out stratum by stratum; row j counts towards fold j mod k, in hash order."""
    return f"""ranked as (
        select *, {stratum} as s,
               row_number() over (partition by {stratum} order by md5('42|' || {key}), cast({key} as varchar)) as r
        from {source}),
    sizes as (select s, count(*) as n from ranked group by s),
    placed as (select s, n, coalesce(sum(n) over (
        order by s rows between unbounded preceding and 1 preceding), 0) as o from sizes),
    quotas as (
        select s, f, count(j) as q from (
            select s, f.f, j from placed, range(0, {FOLDS}) f(f)
            left join lateral (select unnest(range(cast(o as bigint), cast(o + n as bigint))) as j) on j % {FOLDS} = f.f)
        group by s, f),
    ends as (select s, f, sum(q) over (partition by s order by f) as e from quotas),
    folded as (
        select ranked.*, cast((select count(*) from ends where ends.s = ranked.s and ends.e < ranked.r) as int) as fold
        from ranked)"""


def _split(source: str, key: str, stratum: str) -> str:
    return f"""ranked as (
        select *, {stratum} as s,
               row_number() over (partition by {stratum} order by md5('42|' || {key}), cast({key} as varchar)) as r
        from {source}),
    sizes as (select s as stratum, count(*) as n from ranked group by s),
    pool as (
        select *, sum(n) over () as total, count(*) filter (where n = 1) over () as singles,
               case when n = 1 then 0 else n end as c
        from sizes),
    want as (select *, greatest(cast(total - ceil(total * 0.3::double) - singles as bigint), 0) as take,
                    greatest(cast(total - singles as bigint), 1) as among from pool),
    first_cut as (
        select *, (cast(c as hugeint) * take) // among as whole, (cast(c as hugeint) * take) % among as rest from want),
    trained as (
        select *, case when n = 1 then 1 else whole + case when
            row_number() over (order by rest desc, stratum) <= take - sum(whole) over () then 1 else 0 end end as train
        from first_cut),
    held as (select stratum, n, cast(train as bigint) as train, cast(n - train as bigint) as h,
                    cast(sum(n - train) over () as bigint) as hs from trained),
    want_val as (select *, cast(hs - ceil(hs * 0.5::double) as bigint) as vals, greatest(hs, 1) as hd from held),
    second_cut as (
        select *, (cast(h as hugeint) * vals) // hd as whole, (cast(h as hugeint) * vals) % hd as rest from want_val),
    quotas as (
        select stratum, cast(n as bigint) as n, train, cast(whole + case when
            row_number() over (order by rest desc, stratum) <= vals - sum(whole) over () then 1 else 0 end as bigint) as val,
            h
        from second_cut)"""


ORDER_STRATUM = "concat_ws('_', o_orderstatus, o_orderpriority)"
BIN = "case when n_chars >= 0 and n_chars < 190 then cast(floor(n_chars / 10.0) as int) end"
BIN_STRATUM = f"concat_ws(' ', Label, coalesce(cast({BIN} as varchar), 'nan'))"
SPLIT_OF = "case when r <= train then 'train' when r <= train + val then 'val' else 'test' end as split"

MIXED = f"""{LABELLED},
    mixed as (
        select doc_id, case when lang <> 'en' then upper(lang) end as category, Label,
               case when lang <> 'en' then 1.0::double else 0.0::double end as is_lipo
        from labelled)"""


def _sample(source: str, key: str, group: str) -> str:
    return f"""with groups as (
        select {group} as gname, count(*) as c, row_number() over (order by {group}) - 1 as g
        from {source} group by {group}),
    draws as (
        select i as draw, cast(floor({_unit("'42|' || i")} * (select count(*) from groups)) as bigint) as g,
               {_unit("'42|' || i", 1)} as u
        from range(0, (select count(*) from {source})) t(i)),
    placed as (
        select {key}, {group}, row_number() over (
            partition by {group} order by md5(cast({key} as varchar)), {key}) - 1 as r
        from {source})
    select p.{key}, p.{group}, d.draw
    from draws d join groups using (g)
    join placed p on p.{group} = groups.gname and p.r = cast(floor(d.u * groups.c) as bigint)"""


COUNTS = """cast(count(*) filter (where y = 1 and yhat = 1) as double) as tp,
           cast(count(*) filter (where y = 0 and yhat = 1) as double) as fp,
           cast(count(*) filter (where y = 1 and yhat = 0) as double) as fn,
           cast(count(*) filter (where y = 0 and yhat = 0) as double) as tn"""

COUNT_METRICS = """round((tp + tn) / (tp + tn + fp + fn), 6) as acc,
    round(case when tp + fp > 0 and tp + fn > 0 and tn + fp > 0 and tn + fn > 0
          then (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) else 0.0::double end, 6) as mcc,
    round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0::double end, 6) as f1,
    round(case when tp + fn > 0 then tp / (tp + fn) else 0.0::double end, 6) as recall,
    round(case when tp + fp > 0 then tp / (tp + fp) else 0.0::double end, 6) as precision"""


def _curve(rows: str) -> str:
    """CTEs after a table with g, y, score: exact AUC and average precision per g."""
    return f"""points as (
        select g, score, cast(sum(y) as double) as p, cast(sum(1 - y) as double) as n from {rows} group by g, score),
    ups as (select *, sum(p) over w as up_p, sum(n) over w as up_n from points
            window w as (partition by g order by score desc rows unbounded preceding)),
    areas as (
        select g, case when sum(p) > 0 and sum(n) > 0
                  then sum(n * (up_p - p) + 0.5::double * n * p) / (sum(p) * sum(n)) else 0.5::double end as auc,
               case when sum(p) > 0 then sum(p * up_p / (up_p + up_n)) / sum(p) else 0.0::double end as pr_auc
        from ups group by g)"""


def _bundle(rows: str, key: str) -> str:
    return f"""with scored as ({rows}),
    {_curve('scored')},
    cells as (select g, {COUNTS} from scored group by g)
    select {key} {COUNT_METRICS}, round(auc, 6) as auc, round(pr_auc, 6) as pr_auc
    from cells join areas using (g)"""


FOCAL = """(0.7::double * pow(1 - exp(-bce), 2) * bce)"""
BCE = "(greatest(z, 0.0::double) - z * y + ln(1 + exp(-abs(z))))"
PAIRED = """pairs as (select vec_id, label, case when label < 5 then 1 else 0 end as y,
    embedding[1]::double as z0, embedding[2]::double as z from embeddings)"""


def _epochs(by: str) -> str:
    return f"""epochs as (
        select *, row_number() over (partition by {by} order by ts, event_id) - 1 as epoch from events)"""


def _best(by: str, patience: int) -> str:
    return f"""{_epochs(by)},
    seen as (select *, max(value) over (partition by {by} order by epoch
        rows between unbounded preceding and 1 preceding) as before from epochs),
    better as (select *, value > greatest(coalesce(before, -1), -1) as up from seen),
    waited as (
        select *, max(case when up then epoch end) over w as last_up,
               max(case when up then value end) over w as top, min(epoch) over w as first_epoch
        from better window w as (partition by {by} order by epoch rows unbounded preceding)),
    stops as (
        select {by}, min(case when epoch - coalesce(last_up, first_epoch - 1) >= {patience} then epoch end) as stop_epoch,
               max(epoch) as end_epoch from waited group by {by}),
    best as (
        select {by}, w.last_up as best_epoch, w.top as best_value, s.stop_epoch,
               coalesce(s.stop_epoch, s.end_epoch) as last_epoch
        from stops s join waited w using ({by}) where w.epoch = coalesce(s.stop_epoch, s.end_epoch))"""


LONG = """elements as (
    select *, unnest(range(0, len(embedding))) as pos, unnest(embedding)::double as x from embeddings)"""

PROMPTED = f"""prompted as (
    select doc_id, lang, n_chars, embedding,
           case when upper(lang) = 'EN' then 'NULL' else upper(lang) end as category
    from documents join embeddings on doc_id = vec_id),
    cells as (
        select doc_id, category, n_chars, j // 8 as t, j % 8 as c, x from (
            select doc_id, category, n_chars, unnest(range(0, 64)) as j, unnest(embedding)::double as x from prompted))"""


def _rule(name: str, size: int, scale: float) -> str:
    """Seeded parameters as a table of (i, w)."""
    return (f"(select i, ({_unit(f"'{name}|' || i")} - 0.5::double) * {scale!r}::double as w "
            f"from range(0, {size}) t(i))")


def _units(source: str, key: str, weight: str) -> str:
    """Weights in whole units of the power of two that brings their sum under 2^61."""
    return f"""weighted as (select {key}, {weight} as w from {source}),
    positive as (select * from weighted where w > 0 and not isnan(w)),
    top as (select (select min(e) from range(-1080, 1026) t(e) where power(2.0::double, e) > m) as e from (select max(w) as m from positive)),
    coarse as (select sum(floor(w * power(2.0::double, 31 - e))::hugeint + 1) as c from positive, top),
    scale as (select 92 - e - (select min(k) from range(0, 120) t(k) where (1::hugeint << k) > c) as s from coarse, top),
    units as (select {key}, floor(w * power(2.0::double, s))::hugeint as q from positive, scale)"""


def _weighted(source: str, key: str, weight: str) -> str:
    """Draws over exact running sums."""
    return f"""with {_units(source, key, weight)},
    ends as (
        select {key}, sum(q) over (order by md5({key}::varchar), {key}::varchar) as hi from units where q > 0),
    draws as (
        select i as draw, (cast('0x' || substr(md5('42|' || i), 1, 13) as hugeint) * (select max(hi) from ends)) // 4503599627370496 as t
        from range(0, (select count(*) from {source})) r(i))
    select {key}, draw from draws asof join ends on t < hi"""


ORDER_WEIGHT = "case when o_orderstatus <> 'P' then o_totalprice::double * (o_orderkey % 7) end"

FOLD_SCORES = "with " + ", ".join(
    f"w{f} as (select list(w order by i) filter (where i < {WIDTH}) as a, "
    f"list(w order by i) filter (where i >= {WIDTH}) as b from {_rule(f'{f}.head.weight', 2 * WIDTH, 4.0)}), "
    f"b{f} as (select list(w order by i) as b from {_rule(f'{f}.head.bias', 2, 1.0)})"
    for f in FOLD_IDS) + ", scored as (" + " union all ".join(
    f"""select vec_id, {f} as fold_number, 1 / (1 + exp(
        list_dot_product((select a from w{f}), embedding::double[]) + (select b[1] from b{f})
        - list_dot_product((select b from w{f}), embedding::double[]) - (select b[2] from b{f}))) as p
    from embeddings""" for f in FOLD_IDS) + ")"

CENTROID_HEADS = f"""folded as (
    select e.vec_id, cast(floor({_unit("'fold|' || e.vec_id")} * {FOLDS}) as int) as fold, l.quality, e.embedding
    from embeddings e join labels l on e.vec_id = l.doc_id),
    spread as (select fold, quality, unnest(range(0, len(embedding))) as pos, unnest(embedding)::double as x from folded),
    sums as (
        select fold, pos, coalesce(sum(x) filter (where quality = 0), 0) as s0, count(*) filter (where quality = 0) as c0,
               coalesce(sum(x) filter (where quality = 1), 0) as s1, count(*) filter (where quality = 1) as c1
        from spread group by fold, pos),
    means as (
        select fold, pos, (sum(s0) over w - s0) / (sum(c0) over w - c0) as m0,
               (sum(s1) over w - s1) / (sum(c1) over w - c1) as m1
        from sums window w as (partition by pos)),
    heads as (select fold, list(m1 - m0 order by pos) as w, sum(m0 * m0 - m1 * m1) / 2 as b from means group by fold)"""


def _prompt_consistency() -> str:
    index = STATIC_INDEX.format(c="category")
    return f"""with {PROMPTED},
    indexed as (select doc_id, lang, {index} as chain_index from prompted),
    tokens as (select doc_id, n_chars, t, list(x order by c) as v from cells group by doc_id, n_chars, t),
    {_stream('a', 0)}, {_stream('b', 0, '3')},
    rows_of as (
        select i.lang, case when i.chain_index <> 3 then 1.0::double else 0.0::double end as flag,
            list_avg(list_transform(list_zip(a.v, b.v), lambda g: (g[1] - g[2]) * (g[1] - g[2]))) as mse,
            greatest(z[1], z[2]) + ln(1 + exp(-abs(z[1] - z[2]))) - case when l.quality = 1 then z[2] else z[1] end as loss
        from indexed i join labels l using (doc_id) join pooleda a using (doc_id) join pooledb b using (doc_id)
        join logitsa using (doc_id)),
    parts as (
        select lang, avg(loss) as classification, case when sum(flag) > 0
               then 3 * sum(mse * flag) / (sum(flag) + 1e-8::double) else 0.0::double end as consistency
        from rows_of group by lang)
    select lang, round(classification, 6) as classification, round(consistency, 6) as consistency,
           round(classification + consistency, 6) as total from parts"""


def _centroid_heads(train: str) -> str:
    """CTEs after a table with f, w, y, x: heads of every part f and shrinkage c."""
    grid = ", ".join(f"({c}, {v!r}::double)" for c, v in enumerate(SHRINKAGE))
    return f"""elements as (select f, y, w, unnest(range(0, len(x))) as pos, unnest(x) as v from {train}),
    sums as (select f, y, pos, sum(v * w) as s, sum(w) as c from elements group by f, y, pos),
    means as (
        select f, pos, max(case when y = 0 then s / c end) as m0, max(case when y = 1 then s / c end) as m1,
               sum(s) / sum(c) as m from sums group by f, pos),
    grid as (select * from (values {grid}) t(c, r)),
    moved as (select f, pos, c, (1 - r) * m0 + r * m as m0, (1 - r) * m1 + r * m as m1 from means, grid),
    heads as (
        select f, c, list(m1 - m0 order by pos) as h, sum(m0 * m0 - m1 * m1) / 2 as b from moved group by f, c)"""


def _judged(rows: str) -> str:
    """CTEs after a table with g, y, z: the metrics of every g."""
    return f"""scored as (
        select g, y, 1 / (1 + exp(-z)) as score, case when z > 0 then 1 else 0 end as yhat from {rows}),
    {_curve('scored')},
    cells as (select g, {COUNTS} from scored group by g),
    judged as (select g, {COUNT_METRICS}, round(auc, 6) as auc, round(pr_auc, 6) as pr_auc from cells join areas using (g))"""


def _train_kfold() -> str:
    return f"""with {LABELLED},
    base as (
        select doc_id, upper(lang) as category, lang, labelled.Label as Label, list_concat(embedding::double[], list_transform(
            range(0, 5), lambda i: case when i = case upper(lang) when 'DE' then 0 when 'ES' then 1 when 'FR' then 2
                else 3 end then 1.0::double else 0.0::double end)) as x
        from labelled join embeddings on doc_id = vec_id),
    categorised as (select * from base where lang is distinct from 'en'),
    {_kfold('categorised', 'doc_id', "category || '_' || Label")},
    rows_of as (
        select Label as y, x, fold, s as grp from folded
        union all select Label, x, null, 'Linear_' || Label from base where lang = 'en'),
    parts as (select p.f, r.* from rows_of r, range(0, {FOLDS}) p(f) where fold is null or fold <> p.f),
    weights as (select f, grp, 1 / count(*)::double as w from parts group by f, grp),
    train as (select f, y, x, w from parts join weights using (f, grp)),
    {_centroid_heads('train')},
    held as (select f * 10 + c as g, y, list_dot_product(h, x) + b as z from rows_of join heads on f = fold),
    {_judged('held')},
    best as (select g // 10 as fold, g % 10 as candidate, judged.*,
                    row_number() over (partition by g // 10 order by mcc desc, g) as r from judged)
    select cast(fold as int) as fold, cast(candidate as int) as candidate, acc, mcc, f1, auc, pr_auc, recall, precision,
           (select count(*) from rows_of) - (select count(*) from rows_of o where o.fold = best.fold) as train_rows,
           (select count(*) from rows_of o where o.fold = best.fold) as val_rows,
           round((select avg(mcc) from best where r = 1), 6) as cv_mcc
    from best where r = 1"""


def _train_holdout() -> str:
    letters = "list_transform(range(97, 123), lambda i: (length(t) - length(replace(t, chr(i::int), '')))::double)"
    return f"""with labelled as (
        select d.doc_id, d.n_chars, l.quality as Label, {letters} as x
        from (select *, lower(text) as t from documents) d join labels l on d.doc_id = l.doc_id),
    {_split('labelled', 'doc_id', BIN_STRATUM)},
    parted as (select Label as y, x, {SPLIT_OF} from ranked join quotas on s = stratum),
    train as (select 0 as f, 1.0::double as w, y, x from parted where split = 'train'),
    {_centroid_heads('train')},
    tried as (select case split when 'val' then c else 10 + c end as g, y, list_dot_product(h, x) + b as z
             from parted, heads where split in ('val', 'test')),
    {_judged('tried')}
    select acc, mcc, f1, auc, pr_auc, recall, precision from judged
    where g = 10 + (select g from judged where g < 10 order by mcc desc, g limit 1)"""


def _stream(f: str, fold: int, index: str = "indexed.chain_index") -> str:
    """CTEs of one prompted stream with list functions; erf as its power series."""
    erf = ("(1.1283791670955126::double * list_sum(list_transform(range(0, 80), lambda k: "
           "power(-1.0::double, k) * exp((2 * k + 1) * ln(greatest(abs({x}), 1e-12::double)) - lgamma(k + 1.0::double)) "
           "/ (2 * k + 1))) * sign({x}))")

    def gelu(v):
        e = erf.format(x="(x / 1.4142135623730951::double)")
        return f"list_transform({v}, lambda x: x * 0.5::double * (1 + {e}))"

    def dense(p, name, v):
        rows = _list(p[f"{name}.weight"])
        return (f"list_transform(list_zip({rows}, {_list(p[f'{name}.bias'])}), "
                f"lambda wb: list_dot_product(wb[1], {v}) + wb[2])")

    def norm(p, name, v):
        mean = f"list_avg({v})"
        var = f"list_avg(list_transform({v}, lambda x: (x - list_avg({v})) * (x - list_avg({v}))))"
        return (f"list_transform(list_zip({v}, {_list(p[name + '.gain'])}, {_list(p[name + '.shift'])}), "
                f"lambda g: (g[1] - {mean}) / sqrt({var} + 1e-5::double) * g[2] + g[3])")

    p = head_parameters(fold)
    rows = " union all ".join(
        f"select {i} as chain_index, {_list(v)} as e" for i, v in enumerate(p["category"]))
    return f"""cats{f} as ({rows}),
    pre0_{f} as (select chain_index, {dense(p, 'prefix', 'e')} as v from cats{f}),
    pre1_{f} as (select chain_index, {norm(p, 'prefix.norm', 'v')} as v from pre0_{f}),
    prefix{f} as (select chain_index, {gelu('v')} as v from pre1_{f}),
    full{f} as (
        select doc_id, -1 as t, v from indexed join prefix{f} on prefix{f}.chain_index = {index}
        union all select doc_id, t, v from tokens where t <= n_chars % 8),
    down{f} as (select doc_id, t, v, {dense(p, 'down', 'v')} as h from full{f}),
    act{f} as (select doc_id, t, v, {gelu('h')} as h from down{f}),
    up{f} as (select doc_id, t, v, {dense(p, 'up', 'h')} as h from act{f}),
    res{f} as (select doc_id, t, list_transform(list_zip(h, v), lambda g: g[1] + g[2]) as v from up{f}),
    adapted{f} as (select doc_id, t, {norm(p, 'adapter.norm', 'v')} as v from res{f}),
    score{f} as (select doc_id, v, exp(tanh(list_dot_product({_list(p['pool.weight'][0])}, v)
        + {_list(p['pool.bias'][0])})) as e from adapted{f}),
    parts{f} as (select doc_id, e, unnest(range(0, 8)) as c, unnest(v) as x from score{f}),
    sums{f} as (select doc_id, c, sum(e * x) / sum(e) as x from parts{f} group by doc_id, c),
    pooled{f} as (select doc_id, list(x order by c) as v from sums{f} group by doc_id),
    hid0_{f} as (select doc_id, {dense(p, 'hidden', 'v')} as v from pooled{f}),
    hid1_{f} as (select doc_id, {norm(p, 'hidden.norm', 'v')} as v from hid0_{f}),
    hid2_{f} as (select doc_id, {gelu('v')} as v from hid1_{f}),
    logits{f} as (select doc_id, {dense(p, 'out', 'v')} as z from hid2_{f})"""


def _dense_head() -> str:
    """The prompted head, fold by fold."""
    ctes = [_stream(str(f), f) for f in range(FOLDS)]
    picks = [f"select doc_id, 1 / (1 + exp(z[1] - z[2])) as prob from logits{f}" for f in range(FOLDS)]
    index = STATIC_INDEX.format(c="category")
    return f"""with {PROMPTED},
    indexed as (select doc_id, lang, {index} as chain_index from prompted),
    tokens as (select doc_id, n_chars, t, list(x order by c) as v from cells group by doc_id, n_chars, t),
    {", ".join(ctes)},
    probs as ({" union all ".join(picks)}),
    means as (select doc_id, avg(prob) as m from probs group by doc_id)
    select doc_id, lang, round(m, 4) as Probability, case when m >= 0.5 then 1 else 0 end as Prediction
    from means join indexed using (doc_id)"""


ORACLE = {
    "ensemble_score": f"""with {CLEANED}, {CENTROID_HEADS},
    scored as (
        select c.doc_id, c.text, c.lang, c.source, c.n_chars, (
            select avg(1 / (1 + exp(-(list_dot_product(h.w, e.embedding::double[]) + h.b)))) from heads h) as m
        from cleaned c join embeddings e on c.doc_id = e.vec_id where {ACCEPTED})
    select doc_id, text, lang, source, n_chars, round(m, 4) as Probability,
           case when m >= 0.5 then 1 else 0 end as Prediction
    from scored""",
    "score_rejects": f"""with {CLEANED}
    select c.doc_id, c.lang, case when clean_sequence is null then 'null sequence'
           when input_category is null then 'null category'
           when not ({ACCEPTED}) then 'invalid category' else 'no features' end as reason
    from cleaned c left join embeddings e on c.doc_id = e.vec_id
    where not coalesce({ACCEPTED}, false) or e.embedding is null""",
    "fold_scores": f"""{FOLD_SCORES}
    select vec_id, fold_number, round(p, 6) as probability from scored""",
    "ensemble_score_blocked": f"""{FOLD_SCORES}
    select vec_id, round(avg(p), 4) as Probability, case when avg(p) >= 0.5::double then 1 else 0 end as Prediction
    from scored group by vec_id""",
    "predict_rules": f"""with {PAIRED}, scored as (select *, 1 / (1 + exp(z0 - z)) as p from pairs)
    select vec_id, round(p, 6) as probability, case when p >= 0.5 then 1 else 0 end as by_threshold,
           case when z > z0 then 1 else 0 end as by_argmax from scored""",
    "dense_head": _dense_head(),
    "prompt_consistency": _prompt_consistency(),
    "train_kfold_centroid": _train_kfold(),
    "train_holdout_centroid": _train_holdout(),
    "clean_route": f"""with {CLEANED}
    select doc_id, text, lang, source, n_chars, clean_sequence, input_category, {ROUTED} as routed_category
    from cleaned where {ACCEPTED}""",
    "clean_rejects": f"""with {CLEANED}
    select doc_id, text, lang, source, n_chars, case when clean_sequence is null then 'null sequence'
           when input_category is null then 'null category' else 'invalid category' end as reason
    from cleaned where not coalesce({ACCEPTED}, false)""",
    "build_vocab": f"with {_vocab('part', 'p_brand')} select value, idx from vocab",
    "category_index": f"""with {_vocab('part', 'p_brand')}
    select p_partkey, p_brand, coalesce(v.idx, (select idx from vocab where value = '<UNK>')) as chain_index
    from part left join vocab v on p_brand = v.value""",
    "category_index_static": f"""with {CLEANED}, routed as (select doc_id, lang, {ROUTED} as category from cleaned)
    select *, {STATIC_INDEX.format(c='category')} as chain_index from routed""",
    "spaced_sequence": "select doc_id, array_to_string(string_split(text, ''), ' ') as spaced from documents",
    "encode_tokens": fr"""with plain as (
        select doc_id, regexp_replace(text, '[{NOT_A_TOKEN}]+', '', 'g') as body from documents),
    letters as (select distinct unnest(string_split(body, '')) as ch from plain),
    codes as (select ch, row_number() over (order by ch) - 1 + 5 as id from letters where ch <> ''),
    cut as (select doc_id, list_filter(string_split(substr(body, 1, 98), ''), lambda c: c <> '') as chars from plain),
    spread as (select doc_id, unnest(chars) as ch, unnest(range(0, len(chars))) as i from cut),
    coded as (select doc_id, list(id order by i) as ids from spread join codes using (ch) group by doc_id),
    filled as (select cut.doc_id, coalesce(ids, []) as ids from cut left join coded using (doc_id))
    select doc_id,
        array_to_string(list_concat([2], list_concat(ids, list_concat([3],
            list_transform(range(0, 98 - len(ids)), lambda x: 0)))), ' ') as input_ids,
        array_to_string(list_concat(list_transform(range(0, len(ids) + 2), lambda x: 1),
            list_transform(range(0, 98 - len(ids)), lambda x: 0)), ' ') as attention_mask
    from filled""",
    "mixed_union": f"""with {MIXED}, {_vocab('mixed', 'category')}
    select doc_id, category, Label, is_lipo, coalesce(v.idx, (
        select idx from vocab where value = case when is_lipo = 1 then '<UNK>' else 'NULL' end)) as chain_index
    from mixed left join vocab v on category = v.value""",
    "length_bin": f"""with {LABELLED} select doc_id, Label, n_chars as Length, {BIN} as Length_Bin from labelled""",
    "stratified_kfold": f"""with {LABELLED}, {_kfold('labelled', 'doc_id', "lang || '_' || Label")}
    select doc_id, s as stratum, fold from folded""",
    "fold_parts": f"""with {LABELLED}, {_kfold('labelled', 'doc_id', "lang || '_' || Label")}
    select doc_id, cast(f as int) as fold_number, case when fold = f then 'val' else 'train' end as part
    from folded, range(0, {FOLDS}) t(f)""",
    "stratified_kfold_orders": f"""with {_kfold('orders', 'o_orderkey', ORDER_STRATUM)}
    select o_orderkey, o_orderstatus, o_orderpriority, fold from folded""",
    "stratified_split": f"""with {LABELLED}, {_split('labelled', 'doc_id', BIN_STRATUM)}
    select doc_id, Label, n_chars, {SPLIT_OF} from ranked join quotas on s = stratum""",
    "stratified_split_orders": f"""with {_split('orders', 'o_orderkey', ORDER_STRATUM)}
    select o_orderkey, o_orderstatus, o_orderpriority, {SPLIT_OF} from ranked join quotas on s = stratum""",
    "split_quotas": f"""with {LABELLED}, {_split('labelled', 'doc_id', BIN_STRATUM)}
    select stratum, n, train, val, h - val as test, n < 2 or h < 2 as undersized from quotas""",
    "balance_weights": f"""with {MIXED}, grouped as (
        select doc_id, case when is_lipo = 1 then category || '_' || Label else 'Linear_' || Label end as sample_group
        from mixed)
    select doc_id, sample_group, round(1.0::double / count(*) over (partition by sample_group), 10) as weight
    from grouped""",
    "balance_weights_lineitem": """select l_orderkey, l_linenumber, l_returnflag || l_linestatus as g,
        round(1.0::double / count(*) over (partition by l_returnflag || l_linestatus), 10) as weight from lineitem""",
    "weighted_sample": _sample("documents", "doc_id", "lang"),
    "weighted_sample_orders": _sample("orders", "o_orderkey", "o_orderpriority"),
    "weighted_sample_general": _weighted("orders", "o_orderkey", ORDER_WEIGHT),
    "weight_shares": f"""with {_units("orders", "o_orderkey", ORDER_WEIGHT)}
    select o_orderkey, coalesce(q, 0)::bigint as units,
        round(coalesce(q, 0)::double / (select sum(q)::double from units), 12) as share
    from orders left join units using (o_orderkey)""",
    "shuffle_position": """select o_orderkey, row_number() over (
        order by md5('42|' || o_orderkey), o_orderkey) - 1 as position from orders""",
    "metric_bundle": _bundle("""select 0 as g, case when label < 5 then 1 else 0 end as y,
        1 / (1 + exp(-round(embedding[1]::double, 2))) as score,
        case when round(embedding[1]::double, 2) > 0 then 1 else 0 end as yhat from embeddings""", ""),
    "metric_bundle_by_lang": f"""{_bundle('''select lang as g, l.quality as y, n_chars as score,
        case when 1 / (1 + exp(1000.0::double - n_chars)) >= 0.5 then 1 else 0 end as yhat
        from documents d join labels l using (doc_id)''', 'g as lang,')}""",
    "metrics_by_group": f"""with {LABELLED}, scored as (
        select lang as g, Label as y, case when n_chars > 1000 then 1 else 0 end as yhat from labelled),
    cells as (select g, {COUNTS} from scored group by g)
    select g as lang, {COUNT_METRICS} from cells""",
    "metrics_flagged": f"""with {LABELLED}, cells as (
        select {COUNTS} from (select Label as y, case when n_chars > 1000 then 1 else 0 end as yhat
                              from labelled where lang <> 'en'))
    select {COUNT_METRICS} from cells""",
    "auc_ap": f"""with scored as (
        select l_linestatus as g, case when l_returnflag = 'R' then 1 else 0 end as y, l_extendedprice as score
        from lineitem), {_curve('scored')}
    select g as l_linestatus, round(auc, 6) as auc, round(pr_auc, 6) as pr_auc from areas""",
    "loss_focal": f"""with {PAIRED}, losses as (select label, {BCE} as bce from pairs)
    select label, round(avg({FOCAL}), 8) as loss from losses group by label""",
    "loss_cross_entropy": f"""with {PAIRED}
    select label, round(avg(-ln(exp(case when y = 1 then z else z0 end) / (exp(z0) + exp(z)))), 8) as loss
    from pairs group by label""",
    "epoch_loss": f"""with {_epochs('event_type')},
    batches as (select event_type, epoch // 32 as b, avg(value) as m, sum(value) as s, count(value) as c
                from epochs group by all)
    select event_type, count(*) as batches, round(avg(m), 6) as batch_mean, round(sum(s) / sum(c), 6) as row_mean
    from batches group by event_type""",
    "best_checkpoint": f"""with {_best('user_id', 8)} select * from best""",
    "history_report": f"""with {_epochs('user_id')}
    select user_id, epoch, event_id, value from epochs where (epoch + 1) % 5 = 0 or epoch = 0""",
    "cv_summary": f"""with {_best('user_id, event_type', 5)}
    select user_id, count(*) as folds, round(avg(coalesce(best_value, -1)), 6) as mean_best
    from best group by user_id""",
    "attention_pool": f"""with w as (select list(w order by i) as w from {_rule('attention', WIDTH, 4.0)}),
    scored as (select label, embedding,
        exp(tanh(list_dot_product((select w from w), embedding::double[]))) as e from embeddings),
    spread as (select label, e, unnest(range(0, len(embedding))) as pos, unnest(embedding)::double as x from scored)
    select label, cast(pos as int) as pos, round(sum(e * x) / sum(e), 6) as pooled from spread group by label, pos""",
    "prefix_pool": f"""with {PROMPTED},
    prefix as (select category, c, avg(x) as x from cells group by category, c),
    kept as (
        select doc_id, t, c, x from cells where t <= n_chars % 8
        union all select doc_id, -1, c, x from prompted join prefix using (category)),
    vecs as (select doc_id, t, list(x order by c) as v from kept group by doc_id, t),
    scored as (select *, exp(tanh(list_dot_product({_list(TOKEN_POOL['pool.weight'][0])}, v)
        + {_list(TOKEN_POOL['pool.bias'][0])})) as e from vecs),
    spread as (select doc_id, e, unnest(range(0, 8)) as c, unnest(v) as x from scored)
    select doc_id, cast(c as int) as pos, round(sum(e * x) / sum(e), 6) as pooled from spread group by doc_id, c""",
    "layer_norm": f"""with {LONG}
    select vec_id, cast(pos as int) as pos, round((x - avg(x) over w) / sqrt(var_pop(x) over w + 1e-5::double), 6) as normal
    from elements window w as (partition by vec_id)""",
    "noise_augment": f"""with {LONG}, hashed as (
        select *, '42|' || vec_id || '|' || pos // 2 as h from elements),
    uniforms as (select *, {_unit('h')} as u1, {_unit('h', 1)} as u2 from hashed)
    select vec_id, cast(pos as int) as pos, round(x + 0.1::double * sqrt(-2 * ln(1 - u1)) * case when pos % 2 = 0
        then cos({2 * np.pi!r}::double * u2) else sin({2 * np.pi!r}::double * u2) end, 6) as noisy from uniforms""",
    "paired_consistency": f"""with {LONG}, {PAIRED},
    centred as (select vec_id, label, power(x - avg(x) over (partition by label, pos), 2) as d from elements),
    mse as (select vec_id, avg(d) as mse from centred group by vec_id),
    losses as (select vec_id, label, {BCE} as bce from pairs),
    parts as (
        select label, avg({FOCAL}) as classification, case when label > 0
               then 3 * sum(mse) / (count(*) + 1e-8::double) else 0.0::double end as consistency
        from losses join mse using (vec_id) group by label)
    select label, round(classification, 8) as classification, round(consistency, 8) as consistency,
           round(classification + consistency, 8) as total from parts""",
}
ORACLE["score_outcomes"] = f"""
    select doc_id, Probability, Prediction, null as reason from ({ORACLE['ensemble_score']})
    union all select doc_id, null, null, reason from ({ORACLE['score_rejects']})"""
