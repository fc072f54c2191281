"""SQL for the registered queries, written on its own and run by another engine on the same tables."""

from __future__ import annotations

from covermill.plans import cover_sql as cover

_ENV = r"lower(regexp_replace(env, '[\s\p{Z}\p{Cf}]+', '', 'g'))"
_S = f"s as (select distinct struct_id item, source, {_ENV} env from struct_envs where struct_id is not null and {_ENV} <> ''), a as (select distinct item, env from s)"
_P = "pr as (select distinct item, env from s where source = 'probe'), ph as (select distinct item, env from s where source = 'phase2')"
_F = "f as (select env, count(*) n from a group by 1)"
_D = "e as (select distinct l_suppkey k, lower(p_brand || ':' || p_size) env from lineitem join part on l_partkey = p_partkey)"
_W = r"w as (select distinct doc_id item, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+')) env from documents where text is not null), a as (select item, env from w where env <> '')"
_GREEDY = f"""with recursive {_D}, cand as (select k, list(env) envs from e group by k), t as (select count(distinct env) n from e),
g as (select 0 step, null::bigint k, 0::bigint gain, 0::bigint covered, (select list(distinct env) from e) unc union all
 select step + 1, k2, gain2, covered + gain2, list_filter(unc, lambda x: not list_contains(envs, x)) from (
  select g.step, c.k k2, len(list_intersect(c.envs, g.unc)) gain2, g.covered, g.unc, c.envs,
   row_number() over (order by len(list_intersect(c.envs, g.unc)) desc, c.k) rn from g, cand c) where rn = 1 and gain2 > 0)
select k as suppkey, step::bigint as rank, gain as new_gain, covered, n - covered as uncovered, round(100.0 * covered / n, 6) as coverage_pct from g, t where step > 0"""
_PAIRS = """z as (select item, count(*) n from a group by 1),
o as (select x.item a, y.item b, count(*) k from a x join a y on x.env = y.env and x.item < y.item group by 1, 2),
j as (select o.a, o.b, k, za.n na, zb.n nb, k / (za.n + zb.n - k)::double ov from o join z za on za.item = o.a join z zb on zb.item = o.b)"""
_CELL = "c as (select frame_id, any_value(lattice) l, any_value(atoms) atoms, any_value(pbc) pbc, any_value(step) step from frames where frame_id is not null group by 1)"
_DET = "(l[1] * (l[5] * l[9] - l[6] * l[8]) - l[2] * (l[4] * l[9] - l[6] * l[7]) + l[3] * (l[4] * l[8] - l[5] * l[7]))"
_LONG = "sqrt(l[1]*l[1]+l[2]*l[2]+l[3]*l[3]) >= {0} and sqrt(l[4]*l[4]+l[5]*l[5]+l[6]*l[6]) >= {0} and sqrt(l[7]*l[7]+l[8]*l[8]+l[9]*l[9]) >= {0}"
_NEAR = f"""{_CELL}, t as (select frame_id, l, pbc, unnest(range(1, len(atoms) + 1)) i, atoms from c where len(l) = 9 and abs({_DET}) >= 1e-6 and {_LONG}),
ats as (select frame_id, l, pbc, i - 1 i, upper(trim(atoms[i].symbol)[1]) || lower(trim(atoms[i].symbol)[2:]) sym, atoms[i].pos p from t),
sh as (select x, y, z from (select unnest([-1, 0, 1]) x) cross join (select unnest([-1, 0, 1]) y) cross join (select unnest([-1, 0, 1]) z)),
im as (select a.frame_id, a.i, b.i j, a.sym si, b.sym sj,
 b.p[1] - a.p[1] + x * a.l[1] + y * a.l[4] + z * a.l[7] dx, b.p[2] - a.p[2] + x * a.l[2] + y * a.l[5] + z * a.l[8] dy, b.p[3] - a.p[3] + x * a.l[3] + y * a.l[6] + z * a.l[9] dz
 from ats a join ats b on a.frame_id = b.frame_id and a.i <> b.i cross join sh where (x = 0 or coalesce(a.pbc[1], true)) and (y = 0 or coalesce(a.pbc[2], true)) and (z = 0 or coalesce(a.pbc[3], true))),
n as (select frame_id, i, j, any_value(si) si, any_value(sj) sj, min(sqrt(dx * dx + dy * dy + dz * dz)) d, arg_min([dx, dy, dz], sqrt(dx * dx + dy * dy + dz * dz)) v from im group by 1, 2, 3)"""
_RADIUS = "case {0} when 'Fe' then 1.32 when 'C' then 0.76 else 1.0 end"
_CLOSE = f"q as (select distinct frame_id from n where i < j and d < ({_RADIUS.format('si')} + {_RADIUS.format('sj')}) * 0.8)"


def _near(rcut: float) -> str:
    return _NEAR.replace("{0}", str(rcut))


# distinct bonds of each center: its symbol, and of each neighbour the symbol and the bonds to other neighbours
_TOKENS = """r as (select * from n where d <= {0}), k as (select a.frame_id, a.i, a.j, count(*) m from r a join r b on a.frame_id = b.frame_id and a.i = b.i and a.j <> b.j join r c on c.frame_id = a.frame_id and c.i = a.j and c.j = b.j group by 1, 2, 3),
    tk as (select r.frame_id, r.i, any_value(si) c, count(*) cn, string_agg(sj || '~' || coalesce(m, 0), '|' order by sj || '~' || coalesce(m, 0)) g, string_agg(sj, '' order by sj) h from r left join k using (frame_id, i, j) where si in ('Fe', 'C') group by 1, 2),
    w as (select frame_id, i, cn, 'r{0}:' || substr(sha1(c || ':' || g), 1, 16) raw, 'r{0}:' || c || ':cn' || cn || ':' || h meta from tk)"""


def _tokens(rcut: float) -> str:
    return f"{_near(rcut)}, {_TOKENS.replace('{0}', str(rcut))}"


def _centers() -> dict[str, str]:
    first = "o as (select raw, frame_id, arg_min(meta, i) meta, arg_min(cn, i) cn from w group by 1, 2)"
    names = "p as (select distinct p_brand || ':' || p_type as name from part)"
    return {
        "raw_token_counts": " union all ".join(f"select * from (with {_tokens(c)} select raw, meta, count(*) as n_centers, count(distinct frame_id) as n_frames from w group by 1, 2)" for c in (2.7, 3.0)),
        "token_dimension": f"""with {_tokens(3.0)}, {first}, s as (select *, row_number() over (partition by raw order by frame_id) nth from o), f as (select raw, case when min(cn) = max(cn) then (min(cn) + 2)::int end n from s where nth <= 5 group by 1)
            select raw, m.meta, f.n as n_features from (select raw, arg_max(meta, frame_id) meta from o group by 1) m join f using (raw)""",
        "token_examples": f"with {_tokens(3.0)}, ct as (select raw, frame_id, least(3, count(*)) n from w group by 1, 2) select raw, sum(n)::bigint as n_examples from ct group by 1",
        "cluster_index": f"""with {_tokens(3.0)}, x as (select *, row_number() over (partition by meta order by raw, frame_id, i) nth from w), y as (select *, regexp_replace(meta || '_' || format('{{:05d}}', nth), '[^A-Za-z0-9_.=+:-]+', '_', 'g') f from x)
            select case when length(f) > 120 then substr(f, 1, 109) || '_' || substr(sha1(f), 1, 10) else f end || '.cif' as cif_file, meta as effective_fp, raw as raw_fp, frame_id as source_idx, i as center_atom_index, regexp_extract(meta, ':([A-Z][a-z]?):cn', 1) as center_symbol, 3.0 as rcut from y""",
        "radial_distribution": f"""with {_near(0)}, pr as (select frame_id, greatest(si, sj) || '-' || least(si, sj) kind, floor(d / 0.25)::int bin from n where i < j and d > 0 and d <= 5.0),
            ct as (select frame_id, kind, bin, count(*) n from pr group by 1, 2, 3), sy as (select frame_id, upper(trim(a.symbol)[1]) || lower(trim(a.symbol)[2:]) sym, any_value(abs({_DET})) v, count(*) n from (select frame_id, l, unnest(atoms) a from c) group by 1, 2),
            e as (select a.frame_id, a.sym || '-' || b.sym kind, a.v, case when a.sym = b.sym then a.n * (a.n - 1) / 2 else a.n * b.n end possible from sy a join sy b on a.frame_id = b.frame_id and a.sym >= b.sym),
            f as (select kind, count(*) n_frames from e where possible > 0 group by 1)
            select kind, bin, round(bin * 0.25 + 0.125, 6) as r, sum(ct.n)::bigint as n_pairs, round(sum(ct.n * v / (possible * 4 * pi() / 3 * (pow(bin * 0.25 + 0.25, 3) - pow(bin * 0.25, 3)))) / any_value(n_frames), 6) as g from ct join e using (frame_id, kind) join f using (kind) where possible > 0 group by 1, 2""",
        "user_correlation": """with p as (select user_id, event_type k, epoch_us(ts)::double x, avg(value) y from events where value is not null group by 1, 2, 3), k as (select distinct user_id, k from p),
            q as (select a.user_id, a.k ka, b.k kb from k a join k b on a.user_id = b.user_id and a.k < b.k), l as (select q.*, p.x, p.y from q join p on p.user_id = q.user_id and p.k = q.ka),
            lo as (select l.*, p.x x0, p.y y0 from l asof join p on p.user_id = l.user_id and p.k = l.kb and p.x <= l.x), hi as (select l.*, p.x x1, p.y y1 from l asof join p on p.user_id = l.user_id and p.k = l.kb and p.x >= l.x),
            z as (select lo.*, case when x0 = lo.x then y0 else y0 + (y1 - y0) / (x1 - x0) * (lo.x - x0) end z from lo join hi on hi.user_id = lo.user_id and hi.ka = lo.ka and hi.kb = lo.kb and hi.x = lo.x)
            select user_id, ka as kind_a, kb as kind_b, count(*) as n, round(case when count(*) > 1 then corr(y, z) end, 6) as pearson from z group by 1, 2, 3""",
        "piece_sets": f"""with {names} select name, array_to_string(list_sort(list_distinct(regexp_extract_all(name, '[A-Za-z]+|\\d+\\.\\d+|\\d+|[^\\sA-Za-z0-9]'))), ' ') as pieces, array_to_string(list_transform(range(1, length(name) - 1), lambda i: name[i:i + 2]), ' ') as trigrams from p""",
        "type_vectors": f"""with {names}, t as (select name, unnest(list_concat(regexp_extract_all(name, '[A-Za-z]+|cn\\d+|r\\d+(?:\\.\\d+)?|sim\\d+|\\d+|[A-Za-z0-9_.:-]+'), list_transform(range(1, length(regexp_replace(name, '\\s+', '', 'g')) - 1), lambda i: regexp_replace(name, '\\s+', '', 'g')[i:i + 2]))) tok from p),
            h as (select name, ('0x' || right(sha1(tok), 4))::int h from t), v as (select name, h % 128 slot, sum(case when ((h >> 8) & 1) = 1 then 1.0 else -1.0 end) value from h group by 1, 2 having sum(case when ((h >> 8) & 1) = 1 then 1.0 else -1.0 end) <> 0)
            select name as type, slot, round(value / sqrt(sum(value * value) over (partition by name)), 6) as value from v""",
        "sampled_types": f"""with {_S}, {_F}, sz as (select count(*) filter (n > 5) pri, count(*) filter (n <= 5) rest from f), r as (select env, n > 5 p, row_number() over (partition by n > 5 order by env) - 1 nth from f)
            select env as name from r, sz where case when pri + rest <= 1000 then true when pri >= 1000 then p and nth % ceil(pri / 1000.0) = 0 else p or nth % ceil(rest / (1000.0 - pri)) = 0 end""",
    }


def _axes(points: str) -> str:
    """CTE ``ax(id, x, y)`` of ``points(id, j, v)``: the matrix of covariances, squared until it projects on its first
    axis, then the same without that axis; the largest loading of an axis is positive."""

    def axis(k: int, c: str) -> str:
        return f"""m{k}(step, i, j, v) as (select 0, i, j, v / (select sum(v) from {c} where i = j) from {c} union all
         select s, i, j, v / sum(v) filter (i = j) over () from (select a.step + 1 s, a.i, b.j, sum(a.v * b.v) v from m{k} a join m{k} b on a.j = b.i where a.step < 40 group by 1, 2, 3)),
        p{k} as (select i, j, v from m{k} where step = 40), t{k} as (select arg_max(i, v) t, max(v) top from p{k} where i = j), u{k} as (select i j, v / sqrt(top) u from p{k}, t{k} where j = t),
        l{k} as (select sum({c}.v * p{k}.v) l from {c} join p{k} using (i, j))"""

    return f"""mu as (select j, avg(v) mu from {points} group by 1), ce as (select id, j, v - mu v from {points} join mu using (j)),
    c1 as (select a.j i, b.j j, sum(a.v * b.v) / (select count(distinct id) from {points}) v from ce a join ce b using (id) group by 1, 2), {axis(1, "c1")},
    c2 as (select i, j, c1.v - l * p1.v v from c1 join p1 using (i, j), l1), {axis(2, "c2")},
    ax as (select id, sum(v * u1.u) x, sum(v * u2.u) y from ce join u1 using (j) join u2 using (j) group by 1)"""


# names to hashed vectors: slots and signs of their words and trigrams, scaled to length 1
_HASHED = """tk as (select name, unnest(list_concat(regexp_extract_all(name, '[A-Za-z]+|cn\\d+|r\\d+(?:\\.\\d+)?|sim\\d+|\\d+|[A-Za-z0-9_.:-]+'), list_transform(range(1, length(regexp_replace(name, '\\s+', '', 'g')) - 1), lambda i: regexp_replace(name, '\\s+', '', 'g')[i:i + 2]))) tok from names),
    th as (select name, ('0x' || right(sha1(tok), 4))::int h from tk), hv as (select name, h % {0} slot, sum(case when ((h >> 8) & 1) = 1 then 1.0 else -1.0 end)::double v from th group by 1, 2),
    nv as (select name, slot, v / sqrt(sum(v * v) over (partition by name)) v from hv where v <> 0),
    pt as (select n.name id, s.j, coalesce(nv.v, 0.0) v from (select distinct name from nv) n cross join (select unnest(range({0})) j) s left join nv on nv.name = n.name and nv.slot = s.j)"""


def _maps() -> dict[str, str]:
    states = "i as (select distinct struct_id from structures join initial_training_manifest using (source, source_idx)), y as (select distinct env from a where item in (select struct_id from i)), z as (select env, env in (select env from pr) b, env in (select env from y) s from (select distinct env from a))"
    state = "case when s and not b then 'newly_covered' when b then 'covered_before' else 'still_uncovered' end as state"
    return {
        "type_states": f"with {_S}, {_P}, {states} select env, b as covered_before, s as covered_by_selected, b or s as covered_after, {state} from z",
        "type_axes": f"with recursive names as (select distinct p_brand || ':' || p_type as name from part), {_HASHED.replace('{0}', '64')}, {_axes('pt')} select id, round(x, 5) as x, round(y, 5) as y from ax",
        "type_embedding": f"with recursive {_S}, {_P}, {states}, names as (select env as name from z), {_HASHED.replace('{0}', '128')}, {_axes('pt')} select id as effective_type, round(x, 5) as x, round(y, 5) as y, b::int as covered_before, s::int as covered_by_selected, (b or s)::int as covered_after, {state} from ax join z on z.env = ax.id",
        "embedding_spread": f"with recursive pt as (select vec_id id, unnest(range(64)) j, unnest(embedding)::double v from embeddings where len(embedding) = 64), {_axes('pt')} select round(var_pop(x), 6) as var_x, round(var_pop(y), 6) as var_y, count(*) as n from ax",
    }


def _covers() -> dict[str, str]:
    """Covers and pipelines over structures, with envs as numbers: all, and those of each source."""
    start = f"with recursive {_S}, {_P}, {cover.numbered('n', 'a')}, np as (select item, e env from pr join n_ids using (env)), nh as (select item, e env from ph join n_ids using (env))"
    shown = "select item as struct_id, pass_name, rank, new_gain, covered, uncovered, coverage_pct from {0}"
    sized = "select item as {2}, pass_name, rank, new_gain, covered, uncovered, coverage_pct, (select count(*) from {1} z where z.item = {0}.item) as n_envs from {0}"
    both = "bt as (select 1000000000000 + item item, env from np union all select item, env from nh)"
    joint = f"{both}, {cover.greedy('g', 'bt')}, gi as (select * from bt where item in (select item from g)), go as (select item, row_number() over (order by item < 1000000000000, item) turn from g), {cover.sweep('sw', 'gi', 'go')}"
    counted = "select source, count(*) as n_in, count(*) filter (k in (select item from sw)) as n_kept from (select distinct 'probe' source, 1000000000000 + item k from np union all select distinct 'phase2', item from nh) group by 1"
    gap = f"tgt as (select distinct env from nh where env not in (select env from np)), oi as (select * from nh where env in (select env from tgt)), {cover.two_tiers('tt', 'oi', 'nh', 'tgt')}"
    gap += f", so as (select item, pass_name, row_number() over (order by turn, r) place from tt), {cover.not_similar('ns', 'oi', 'so')}, fin as (select item, 1 turn, place r, pass_name from so where item in (select item from ns)), {cover.manifest('m', 'fin', 'oi')}"
    steps = f"""{cover.greedy('g', 'nh')}, w as (select e env, count(*) n, any_value(coalesce(nullif(regexp_extract(ids.env, '(?:^|:)r(\\d+(?:\\.\\d+)?)', 1), '')::double, 3.0)) rc from nh join n_ids ids on ids.e = nh.env group by 1),
        t0 as (select env, min(rank) step from nh join g using (item) where env not in (select env from np) group by 1 union all select distinct env, 0 from np),
        ev as (select w.*, step from w left join t0 using (env)), st as (select rank step from g union all select 0),
        mx as (select max(rank) hi, greatest(1, ceil(max(rank) / 199.0)) stride from g)
        select st.step, 100.0 * sum(n) filter (ev.step <= st.step) / sum(n) as weighted_pct, 100.0 * count(*) filter (ev.step <= st.step and rc = 2.7) / count(*) filter (rc = 2.7) as rcut_2p7_pct,
         100.0 * count(*) filter (ev.step <= st.step and rc = 3) / count(*) filter (rc = 3) as rcut_3_pct from st, ev, mx where st.step % stride = 0 or st.step = hi group by st.step"""
    return {
        "cover_structures": f"{start}, {cover.greedy('g', 'n')}, t as (select count(distinct env) w from n) select item as struct_id, rank, new_gain, covered, w - covered as uncovered, round(100.0 * covered / w, 6) as coverage_pct from g, t",
        "two_tier_manifest": f"{start}, tgt as (select distinct env from n), {cover.two_tiers('tt', 'n', 'n', 'tgt')}, {cover.manifest('m', 'tt', 'n')} {shown.format('m')}",
        "similar_redundant_removed": f"{start}, so as (select distinct item, item place from nh), {cover.not_similar('ns', 'nh', 'so')} select item as struct_id from ns",
        "initial_selection": f"{start}, {cover.initial_selection('n')} {sized.format('chosen', 'n', 'struct_id')}",
        "initial_summary": f"""{start}, {cover.initial_selection('n')}, c as (select count(distinct env) c from n where item in (select item from chosen)), t as (select count(distinct env) t, count(distinct item) i from n), v as (select count(*) k from chosen)
            select 'candidate_structures_with_envs' as key, i::varchar as value from t union all select 'selected_structures', k::varchar from v union all select 'n_target', t::varchar from t union all select 'n_covered', c::varchar from c
            union all select 'n_uncovered', (t - c)::varchar from t, c union all select 'coverage_pct', (100.0 * c / t)::double::varchar from t, c""",
        "gap_supplement": f"{start}, {gap} {sized.format('m', 'nh', 'struct_id')}",
        "raw_selection": f"""with recursive {_near(0)}, {_CLOSE}, rt as (select frame_id item, raw env from (with {_tokens(2.7)} select * from w) union select frame_id, raw from (with {_tokens(3.0)} select * from w)),
            ok as (select item, env from rt where item not in (select frame_id from q)), {cover.numbered('u', 'ok')}, {cover.initial_selection('u')} {sized.format('chosen', 'u', 'frame_id')}""",
        "tier_statistics": f"""{start}, tgt as (select distinct env from n), {cover.two_tiers('tt', 'n', 'n', 'tgt')}, h as (select distinct env from n where item in (select item from tt)),
            r as (select (select count(*) from tt_rare) nr, (select count(*) from tt_common) nc, (select count(*) from tt_rare where env in (select env from h)) cr, (select count(*) from tt_common where env in (select env from h)) cc)
            select nr as n_rare_target, nc as n_common_target, cr as covered_rare, cc as covered_common, (select count(distinct item) from tt_ri) as rare_candidates_before_dedup, (select count(distinct item) from n where env in (select env from tt_common)) as common_candidates_before_dedup,
             (select count(*) from tt where turn = 1) as rare_selected, (select count(*) from tt where turn = 2) as common_selected, (select count(*) from tt) as total_selected, cr + cc as covered_total,
             round(100.0 * cr / nr, 6) as coverage_rare_pct, round(100.0 * cc / nc, 6) as coverage_common_pct, round(100.0 * (cr + cc) / (nr + nc), 6) as coverage_total_pct from r""",
        "joint_cover": f"{start}, {joint} select g.rank, case when item < 1000000000000 then 'phase2' else 'probe' end as source, item % 1000000000000 as source_idx, (select count(*) from gi where gi.item = g.item) as n_envs from g where item in (select item from sw)",
        "joint_summary": f"{start}, {joint} {counted}",
        "coverage_trajectory": f"{start}, {steps}",
    }


def oracle_sql() -> dict[str, str]:
    runs = "m as (select run_id, pick_rank, max(covered) covered from initial_training_manifest group by 1, 2)"
    return _covers() | _centers() | _maps() | {
        "cover_dense_manifest": _GREEDY,
        "cover_dense_budget": f"select * from ({_GREEDY}) where rank <= 5",
        "cover_dense_stop": f"select * from ({_GREEDY}) where 100.0 * (covered - new_gain) / (covered + uncovered) < 85",
        "cover_first_pick": f"with {_D} select k as suppkey, count(*) as gain from e group by 1 order by 2 desc, 1 limit 1",
        "prune_dense_sweep": f"""with recursive {_D}, c as (select k, list(env) envs, row_number() over (order by k) r from e group by k),
            g as (select 0::bigint r, (select list(k order by k) from c) kept union all
             select g.r + 1, case when list_has_all(coalesce((select flatten(list(o.envs)) from c o where list_contains(g.kept, o.k) and o.k <> c.k), []), c.envs) then list_filter(g.kept, lambda x: x <> c.k) else g.kept end
             from g join c on c.r = g.r + 1)
            select unnest(kept) as suppkey from g where r = (select count(*) from c)""",
        "env_frequency": f"with {_S}, {_F} select env, n as n_structures from f",
        "env_tiers": f"with {_S}, {_F} select env, case when n <= 5 then 'rare' else 'common' end as tier from f",
        "inverted_index": f"with {_D} select env, string_agg(k::varchar, ',' order by k) as suppliers from e group by 1",
        "rarity_counts": f"with {_S}, {_F} select count(*) as n_types, count(*) filter (n <= 1) as n_seldom, count(*) filter (contains(env, ':fe:cn')) as n_iron_centers, count(*) filter (contains(env, ':c:cn')) as n_carbon_centers from f",
        "tier_projection": f"with {_S}, {_F} select item as struct_id, count(*) as n_rare from a join f using (env) where n <= 5 group by 1",
        "projection_without_probe": f"with {_S}, {_P} select item as struct_id, count(*) as n_known from ph where env in (select env from pr) and item not in (select item from pr) group by 1",
        "gap_envs": f"with {_S}, {_P} select distinct env from ph where env not in (select env from pr)",
        "covered_union": f"with {_S}, i as (select distinct struct_id from structures join initial_training_manifest using (source, source_idx)) select distinct env from a where item in (select struct_id from i)",
        "heavy_tail_words": f"with {_W}, f as (select env, count(*) n from a group by 1) select n as n_items, count(*) as n_words from f group by 1",
        "types_by_cutoff": rf"with {_S} select coalesce(nullif(regexp_extract(env, '(?:^|:)r(\d+(?:\.\d+)?)', 1), '')::double, 3.0) as rcut, count(distinct env) as n_types, count(distinct item) as n_items from a group by 1",
        "coverage_by_tier": f"""with {_S}, {_P}, {_F}, r as (select case when n <= 5 then 'rare' else 'common' end tier, env, env in (select env from pr) hit from f),
            u as (select tier, hit from r union all select 'total', hit from r)
            select tier, count(*) as n_target, count(*) filter (hit) as n_covered, round(100.0 * count(*) filter (hit) / count(*), 6) as coverage_pct from u group by 1""",
        "coverage_of_probe": f"with {_S}, {_P}, {_F} select count(*) as n_target, count(*) filter (env in (select env from pr)) as n_covered, count(*) filter (env not in (select env from pr)) as n_uncovered, round(100.0 * count(*) filter (env in (select env from pr)) / count(*), 6) as coverage_pct from f",
        "weighted_coverage": f"with {_S}, {_P}, {_F} select round(100.0 * sum(n) filter (env in (select env from pr)) / sum(n), 6) as weighted_pct from f",
        "frequency_ranks": f"with {_S}, {_F} select row_number() over (order by n desc, env) as rank, env, n as n_items from f",
        "convergence_of_runs": "select pick_rank as step, new_gain, covered, uncovered, round(coverage_pct, 6) as coverage_pct, pass_name from (select distinct * from initial_training_manifest)",
        "manifest_recount": f"""with {_S}, p as (select source, source_idx, min(pick_rank) place, min(run_id) run from initial_training_manifest group by 1, 2),
            k as (select distinct struct_id, source, source_idx from structures),
            i as (select struct_id, run, place, row_number() over (order by run, place, struct_id) rank from p join k using (source, source_idx) where struct_id in (select item from a)),
            f as (select env, min(rank) rank from a join i on i.struct_id = a.item group by 1),
            g as (select i.struct_id, i.rank, count(f.env) new_gain from i left join f using (rank) group by 1, 2),
            c as (select *, sum(new_gain) over (order by rank)::bigint covered from g)
            select struct_id, rank, new_gain, covered, (select count(distinct env) from a) - covered as uncovered from c""",
        "gain_histogram": """with m as (select distinct * from initial_training_manifest), g as (select new_gain::double g from m where new_gain > 0),
            w as (select count(*) n, min(g) lo, max(g) hi, least(50, greatest(10, floor(sqrt(count(*)))))::int bins from g),
            h as (select least(floor((g - lo) / ((hi - lo) / bins)) + 1, bins)::int bin, lo, (hi - lo) / bins width from g, w)
            select bin, round(lo + (bin - 1) * width, 6) as low, round(lo + bin * width, 6) as high, count(*) as n from h group by bin, lo, width""",
        "summary_report": """with m as (select distinct * from initial_training_summary), o as (select count(distinct run_id)::varchar n_runs, coalesce(sum(selected_structures)::varchar, '') selected, coalesce(max(rare_freq_threshold)::varchar, '') rare_most, coalesce(sum(prune_redundant_removed)::varchar, '') pruned from m)
            select 'n_runs' as key, n_runs as value from o union all select 'selected', selected from o union all select 'rare_most', rare_most from o union all select 'pruned', pruned from o""",
        "source_counts": "select source, count(*) as n_in, count(*) filter (struct_id in (select struct_id from struct_envs where env is not null and struct_id is not null)) as n_kept from (select distinct struct_id, source from structures where struct_id is not null) group by 1",
        "exact_copies": f"with {_S}, l as (select item, list(env order by env) v from a group by 1) select item as struct_id, min(item) over (partition by v) as first_id from l",
        "overlap_links_band": f"with {_S}, {_PAIRS}, l as (select item, list(env order by env) v from a group by 1), u as (select min(item) item from l group by v) select a as struct_a, b as struct_b, round(ov, 6) as overlap from j where ov >= 0.7 - 1e-12 and greatest(na, nb) <= floor(least(na, nb) * 1.25::double) + 1 and a in (select item from u) and b in (select item from u)",
        "near_documents": f"""with {_W}, {_PAIRS}, l as (select item, list(env order by env) v from a group by 1), c as (select item, min(item) over (partition by v) first, count(*) over (partition by v) size from l),
            k as (select a.item, count(*) n from (select a item, b other from j where ov >= 0.85 - 1e-12 and greatest(na, nb) <= floor(least(na, nb) * 1.25::double) + 1
             union all select b, a from j where ov >= 0.85 - 1e-12 and greatest(na, nb) <= floor(least(na, nb) * 1.25::double) + 1) a join c x on x.item = a.item join c y on y.item = a.other where x.first <> y.first group by 1)
            select item as doc_id, first as class_id, size - 1 as n_copies, coalesce(n, 0)::bigint as n_links from c left join k using (item)""",
        "representatives": f"""with recursive {_S}, {_PAIRS}, l as (select a x, b y from j where ov >= 0.85 - 1e-12 and greatest(na, nb) <= floor(least(na, nb) * 1.25::double) + 1),
            b as (select x, y from l union all select y, x from l), r(item, root) as (select item, item from z union select b.y, r.root from r join b on b.x = r.item),
            m as (select item, min(root) root from r group by 1), k as (select m.*, row_number() over (partition by root order by n desc, item) rn from m join z using (item))
            select item as struct_id, root as root_id, rn = 1 as is_kept from k""",
        "match_components": """with recursive l as (select left_id a, right_id b from match_pairs where jaccard >= 0.85 and not isnan(jaccard) and left_id is not null and right_id is not null),
            b as (select a, b from l union all select b, a from l), r(item, root) as (select a, a from b union select b.b, r.root from r join b on b.a = r.item)
            select item as struct_id, min(root) as root_id from r group by 1""",
        "frozen_map_applied": """with p as (select p_brand || ':' || p_type || ':' || p_size raw, min(p_brand || ':' || p_type) meta, max(p_size) s from part group by 1)
            select raw, case when s <= 40 then meta || ':known' else meta || ':frozen_new:' || substr(sha1(raw), 1, 8) end as type, s > 40 as is_new from p""",
        "compression_stats": """with p as (select distinct p_brand || ':' || p_type || ':' || p_size raw, p_brand || ':' || p_type meta, p_brand || ':' || p_type || ':' || floor(p_size / 10)::int::varchar type from part),
            t as (select type, count(distinct raw) n, min(meta) meta from p group by 1)
            select sum(n)::bigint as n_raw, count(*) as n_effective, count(distinct meta) as n_meta, count(*) filter (n = 1) as n_singletons, max(n) as largest, round(100.0 * (1 - count(*) / sum(n)::double), 6) as reduction_pct from t""",
        "effective_layer": f"with {_S}, t as (select distinct item, regexp_extract(env, '^([^:]*:[^:]*:[^:]*)', 1) env from a) select env, count(*) as n_items from t group by 1",
        "probe_mapped": f"with {_S}, {_P}, m as (select item, env, env not in (select env from ph) only_ from pr) select only_ as is_probe_only, count(*) as n_rows, count(distinct env) as n_envs from m group by 1",
        "vector_clusters": """with recursive p as (select a.vec_id a, b.vec_id b from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id and list_distance(a.embedding::double[], b.embedding::double[]) <= 1.15),
            b as (select a, b from p union all select b, a from p), r(v, root) as (select vec_id, vec_id from embeddings union select b.b, r.root from r join b on b.a = r.v)
            select v as vec_id, min(root) as cluster from r group by 1""",
        "physical_frames": f"with {_near(0)}, {_CLOSE} select frame_id, frame_id not in (select frame_id from q) as is_physical, case when frame_id in (select frame_id from q) then 'pair_distance_below_limit' end as reason from c",
        "rejected_frames": f"with {_near(0)}, {_CLOSE} select 'phase2' as source, frame_id as source_idx, 'pair_distance_below_limit' as reason from q",
        "valid_cells": f"with {_CELL} select frame_id, coalesce(len(l) = 9 and abs({_DET}) >= 1e-6 and {_LONG.format(7.0)}, false) as is_ok from c",
        "frame_volumes": f"with {_CELL} select frame_id, round(abs({_DET}), 4) as volume from c where len(l) = 9",
        "center_metas": f"with {_near(3.0)}, m as (select frame_id, i, any_value(si) c, count(*) cn, string_agg(sj, '' order by sj) g from n where d <= 3.0 and si in ('Fe', 'C') group by 1, 2) select 'r3.0:' || c || ':cn' || cn || ':' || g as meta, cn, count(*) as n_centers from m group by 1, 2",
        "center_features": f"""with {_near(3.0)}, r as (select * from n where d <= 3.0),
            g as (select a.frame_id, a.i, degrees(acos(greatest(-1.0, least(1.0, (a.v[1]*b.v[1]+a.v[2]*b.v[2]+a.v[3]*b.v[3]) / (a.d * b.d))))) w from r a join r b on a.frame_id = b.frame_id and a.i = b.i and a.j < b.j),
            h as (select frame_id, i, avg(w) m, stddev_pop(w) s from g group by 1, 2), k as (select frame_id, i, count(*) cn, sum(d) s from r group by 1, 2)
            select frame_id, k.i as center, (cn + 2)::int as n, round(k.s + coalesce(h.m, 90) + coalesce(h.s, 0), 4) as total from k left join h using (frame_id, i)""",
        "local_clusters": f"""with {_near(0)}, r as (select * from n where d <= 3.000001), k as (select frame_id, i, count(*) + 1 na, greatest(greatest(max(v[1]), 0) - least(min(v[1]), 0), greatest(max(v[2]), 0) - least(min(v[2]), 0), greatest(max(v[3]), 0) - least(min(v[3]), 0)) span from r group by 1, 2)
            select frame_id, i as center, na as n_atoms, round(greatest(span + 8.0, 14.0, 8.0), 4) as box from k""",
        "angular_distribution": f"""with {_near(0)}, r as (select * from n where d <= 3.0),
            g as (select least(a.sj, b.sj) || '-' || a.si || '-' || greatest(a.sj, b.sj) kind, degrees(acos(greatest(-1.0, least(1.0, (a.v[1]*b.v[1]+a.v[2]*b.v[2]+a.v[3]*b.v[3]) / (a.d * b.d))))) w from r a join r b on a.frame_id = b.frame_id and a.i = b.i and a.j < b.j),
            h as (select kind, least(floor(w / 10), 17)::int bin, count(*) n from g group by 1, 2)
            select kind, bin, n, round(n / sum(n) over (partition by kind), 6) as share from h""",
        "frame_errors": """with f as (select frame_id, any_value(energy) energy, any_value(stress) stress, any_value(atoms) atoms from frames where frame_id is not null group by 1)
            select frame_id, case when not isnan(energy) then round(0.5 / greatest(1, len(atoms)), 6) end as energy_mae, 0.0 as force_mae, case when stress is not null then 0.25 end as stress_mae from f""",
        "run_comparison": f"with {runs}, k as (select * from m where run_id is not null and pick_rank is not null), x as (select pick_rank, avg(covered::double) c from k group by 1) select run_id, pick_rank, covered::double as covered_left, round(c, 6) as covered_right, round(covered - c, 6) as covered_diff from k join x using (pick_rank)",
        "run_comparisons": f"""with {_S}, {runs}, k as (select run_id, pick_rank, max(covered) covered from m where run_id is not null and pick_rank is not null group by 1, 2),
            t as (select distinct run_id, pick_rank, source, source_idx from initial_training_manifest where run_id is not null and pick_rank is not null),
            i as (select distinct t.run_id, t.pick_rank, s.struct_id from t join structures s using (source, source_idx)),
            f as (select run_id, env, min(pick_rank) pick_rank from i join a on a.item = i.struct_id group by 1, 2), g as (select run_id, pick_rank, count(*) n from f group by 1, 2),
            c as (select k.*, sum(coalesce(n, 0)) over (partition by run_id order by pick_rank)::bigint counted from k left join g using (run_id, pick_rank))
            select run_id, pick_rank, covered as covered_left, counted as covered_right, covered - counted as covered_diff from c""",
        "prune_dense_all": f"""with recursive {_D}, i as (select k item, env from e), o as (select k item, row_number() over (order by k desc) turn from (select distinct k from e)), {cover.sweep('sw', 'i', 'o')} select item as suppkey from sw""",
        "last_of_runs": f"with {runs}, w as (select *, covered - lag(covered) over (partition by run_id order by pick_rank) ch from m where pick_rank is not null) select run_id, max(pick_rank) as last_step, arg_max(covered, pick_rank) as covered, arg_max(ch, pick_rank) as change_covered from w group by 1",
        "user_displacement": """with r as (select event_type, user_id, date_trunc('hour', ts) t, avg(value) v from events where value is not null group by 1, 2, 3),
            f as (select *, v - first_value(v) over (partition by event_type, user_id order by t) dv from r), m as (select event_type, t, avg(dv * dv) msd from f group by 1, 2)
            select event_type, round(avg(msd), 4) as mean_msd, count(*) as n_times from m group by 1""",
        "structure_energies": "with e as (select struct_id, max(energy) energy, max(n_atoms) n_atoms from structures where energy is not null and not isnan(energy) group by 1) select struct_id, round(energy + 300.0 * n_atoms / 1000, 6) as inner_energy, 3 * n_atoms - 3 as n_modes, 3 * n_atoms as n_all_modes from e",
        "safe_casts": "select doc_id, round(coalesce(try_cast(title as double), -1.0), 6) as as_float, coalesce(n_chars, 0) as as_int, coalesce(try_cast(try_cast(lang as double) as bigint), -7) as lang_int from documents",
        "file_names": """with d as (select doc_id, regexp_replace(title, '[^A-Za-z0-9_.=+:-]+', '_', 'g') a, title, concat_ws('/', title, edit_note, editor) b from documents), e as (select *, regexp_replace(b, '[^A-Za-z0-9_.=+:-]+', '_', 'g') c from d)
            select doc_id, case when length(a) > 120 then substr(a, 1, 109) || '_' || substr(sha1(a), 1, 10) else a end as name, case when length(c) > 20 then substr(c, 1, 9) || '_' || substr(sha1(c), 1, 10) else c end as short_name from e""",
        "key_parts": rf"with {_S}, v as (select distinct env from a) select env, coalesce(nullif(regexp_extract(env, '(?:^|:)r(\d+(?:\.\d+)?)', 1), '')::double, 3.0) as rcut, coalesce(nullif(regexp_extract(env, ':([a-zA-Z][a-zA-Z]?):[cC][nN]', 1), ''), '?') as center, sha1(env) as sha, substr(sha1(env), 1, 8) as short_sha from v",
        "gap_states": f"with {_S}, {_P}, {_F} select case when env not in (select env from pr) and env in (select env from ph) then 'newly_covered' when env in (select env from pr) then 'covered_before' else 'still_uncovered' end as state, count(*) as n_envs from f group by 1",
        "frames_in_order": """with f as (select frame_id, min(energy) energy, any_value(atoms) atoms from frames where frame_id is not null and len(atoms) > 0 group by 1)
            select row_number() over (order by coalesce(energy, 0.0), frame_id) as rank, frame_id, len(atoms)::int as n_atoms from f""",
        "log_round_trip": "select l_linenumber::int as line, count(*) as n, sum(l_orderkey)::bigint as sum_gen, round(sum(l_quantity::double), 2) as quantity from lineitem where l_orderkey is not null group by 1",
        "spectrum_round_trip": "select hour(ts)::double as freq, round(avg(value), 5) as dos from events where value is not null group by 1",
        "bands_round_trip": "select count(*) as n_points, count(distinct user_id) as n_segments, round(sum(round(value, 8)), 2) as sum_y from events where value is not null",
        "thermal_round_trip": "select year(o_orderdate)::double as temperature, round(avg(o_totalprice::double), 4) as free_energy, count(*)::double as entropy, round(min(o_totalprice::double), 4) as heat_capacity, round(max(o_totalprice::double), 4) as energy from orders where o_orderdate is not null group by 1",
        "zero_points": """with r as (select o_orderstatus, (year(o_orderdate) * 12 + month(o_orderdate))::double t, avg(o_totalprice::double) f from orders where o_orderdate is not null group by 1, 2)
            select o_orderstatus, round(arg_min(f, t), 4) as zpe, min(t) as lowest, count(*) as n from r group by 1""",
        "errors_round_trip": """with f as (select frame_id, any_value(energy) energy, any_value(len(atoms)) n from frames where frame_id is not null group by 1)
            select count(*) as n, count(*) filter (energy is not null and not isnan(energy)) as n_energy, round(sum(0.5 / greatest(1, n)) filter (energy is not null and not isnan(energy)), 5) as sum_energy, sum(frame_id)::bigint as sum_index from f""",
        "cluster_files": f"""with {_near(0)}, r as (select * from n where d <= 3.000001), k as (select frame_id, i, count(*) + 1 na, greatest(greatest(max(v[1]), 0) - least(min(v[1]), 0), greatest(max(v[2]), 0) - least(min(v[2]), 0), greatest(max(v[3]), 0) - least(min(v[3]), 0)) span from r group by 1, 2)
            select frame_id, i as center, na as n_atoms, round(greatest(span + 8.0, 14.0, 8.0), 4) as box from k""",
        "every_tenth_frame": "select distinct frame_id, step, n_atoms from frames where frame_id is not null and step % 2000 = 0",
        "curve_points": f"with {runs}, x as (select max(pick_rank) hi, greatest(1, ceil(max(pick_rank) / 49.0)::int) stride from m) select run_id, pick_rank, covered from m, x where pick_rank % stride = 0 or pick_rank = hi",
        "stored_stage": f"with {_S}, {_F} select n as n_items, count(*) as n_envs from f group by 1",
        "streamed_intake": f"with {_S} select item as struct_id, count(*) as n_envs from a group by 1",
        "streamed_windows": "select epoch(date_trunc('hour', ts))::bigint as start, event_type, count(*) as n from events where ts is not null group by 1, 2",
        "xyz_round_trip": """with f as (select frame_id, any_value(n_atoms) n, any_value(energy) energy, any_value(stress) stress, any_value(atoms) atoms from frames where frame_id is not null and len(atoms) > 0 group by 1)
            select frame_id, len(atoms)::int as n_atoms, case when isnan(energy) then null else round(energy, 5) end as energy, len(stress)::int as n_stress, round(list_sum(list_transform(atoms, lambda a: a.pos[1])), 4) as sum_x from f""",
    }
