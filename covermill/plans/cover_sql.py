"""SQL of covers and sweeps, one pick or one decision a step, as a check of the queries that work in rounds."""

from __future__ import annotations


def numbered(name: str, inc: str, env: str = "env") -> str:
    """CTE ``name(item, env)`` of ``inc`` with envs as numbers, which keeps the steps small."""
    return f"{name}_ids as (select {env} env, row_number() over () e from (select distinct {env} from {inc})), {name} as (select item, e env from {inc} join {name}_ids using (env))"


def greedy(name: str, inc: str) -> str:
    """CTE ``name(rank, item, new_gain, covered)``: the item with the most envs left, of equals the smallest."""
    g = f"{name}_g"
    best = f"(select item bi, count(*) n from {g} where item is not null group by item order by n desc, item limit 1)"
    # one row without item goes along with the last envs, so that the last pick is told too
    return f"""{g}(step, item, env, pick, gain) as (
      select 0, item, env, null::bigint, 0::bigint from {inc} union all select 0, null, null, null, 0
      union all select {g}.step + 1, {g}.item, {g}.env, b.bi, b.n from {g}, {best} b
       where {g}.item is null or {g}.env not in (select x.env from {g} x, {best} y where x.item = y.bi)),
    {name} as (select step::bigint as rank, pick as item, gain as new_gain, sum(gain) over (order by step)::bigint as covered from {g} where item is null and step > 0)"""


def sweep(name: str, inc: str, order: str, partners: str | None = None) -> str:
    """CTE ``name(item)``: what stays of ``order(item, turn)``, turns from 1, when they are looked at one by one."""
    g = f"{name}_g"
    held = f"(select min(c) from (select count(*) c from {g} x where x.item is not null and x.env in (select y.env from {g} y, turns{name} o where y.item = o.item and o.turn = y.step + 1) group by x.env))"
    near = "true" if partners is None else f"exists (select 1 from {partners} p, turns{name} o, {g} y where p.a = o.item and o.turn = y.step + 1 and y.item = p.b)"
    return f"""turns{name} as (select item, turn from {order}), {g}(step, item, env) as (
      select 0, item, env from {inc} union all select 0, null, null
      union all select {g}.step + 1, {g}.item, {g}.env from {g}, (select {held} > 1 and {near} gone) d
       where {g}.step < (select count(*) from turns{name}) and ({g}.item is null or not coalesce(d.gone, false) or {g}.item <> (select max(o.item) from turns{name} o, {g} z where z.item is null and o.turn = z.step + 1))),
    {name} as (select distinct item from {g} where step = (select count(*) from turns{name}) and item is not null)"""


def overlaps(name: str, inc: str, least: float, band: bool) -> str:
    """CTE ``name(a, b)``, ``a < b``: pairs with that overlap, and with a size band if asked for."""
    sized = f" and greatest(x.n, y.n) <= floor(least(x.n, y.n) * 1.25::double) + 1" if band else " and least(x.n, y.n) >= 0.75 * greatest(x.n, y.n)"
    return f"""{name}_z as (select item, count(*) n from {inc} group by 1),
    {name}_o as (select x.item a, y.item b, count(*) k from {inc} x join {inc} y on x.env = y.env and x.item < y.item group by 1, 2),
    {name} as (select o.a, o.b from {name}_o o join {name}_z x on x.item = o.a join {name}_z y on y.item = o.b where k / (x.n + y.n - k)::double >= {least} - 1e-12{sized})"""


def kept_of_similar(name: str, inc: str, least: float) -> str:
    """CTE ``name(item)``: of each component of similar items the one with the most envs, of equals the smallest."""
    return f"""{overlaps(name + "_l", inc, least, True)}, {name}_b as (select a x, b y from {name}_l union all select b, a from {name}_l),
    {name}_r(item, root) as (select item, item from {name}_l_z union select b.y, r.root from {name}_r r join {name}_b b on b.x = r.item),
    {name}_m as (select item, min(root) root from {name}_r group by 1),
    {name} as (select item from (select item, row_number() over (partition by root order by n desc, item) rn from {name}_m join {name}_l_z using (item)) where rn = 1)"""


def two_tiers(name: str, inc: str, universe: str, target: str) -> str:
    """CTE ``name(item, turn, r, pass_name)`` of a two-tier cover of ``inc`` with the reference's settings."""
    n = name
    return f"""{n}_f as (select env, count(*) n from {universe} group by 1),
    {n}_rare as (select env from {n}_f where n <= 5 and env in (select env from {target})), {n}_common as (select env from {n}_f where n > 5 and env in (select env from {target})),
    {n}_ri as (select * from {inc} where env in (select env from {n}_rare)), {kept_of_similar(n + "_rk", n + "_ri", 0.85)},
    {n}_rc as (select * from {n}_ri where item in (select item from {n}_rk)), {greedy(n + "_r", n + "_rc")},
    {n}_left as (select env from {n}_common where env not in (select env from {inc} where item in (select item from {n}_r))),
    {n}_ci as (select * from {inc} where env in (select env from {n}_common) and item not in (select item from {n}_r)), {kept_of_similar(n + "_ck", n + "_ci", 0.7)},
    {n}_cc as (select * from {n}_ci where item in (select item from {n}_ck) and env in (select env from {n}_left)), {greedy(n + "_c", n + "_cc")},
    {n} as (select item, 1 turn, rank r, 'rare' pass_name from {n}_r union all select item, 2, rank, 'common' from {n}_c where 100.0 * (covered - new_gain) / (select count(*) from {n}_left) < 85)"""


def manifest(name: str, picks: str, inc: str) -> str:
    """CTE ``name`` with the manifest over all of ``inc`` for ``picks(item, turn, r, pass_name)``."""
    return f"""{name}_k as (select item, pass_name, row_number() over (order by turn, r) rank from {picks}),
    {name}_e as (select env, min(rank) rank from {inc} join {name}_k using (item) group by 1),
    {name}_n as (select k.item, k.pass_name, k.rank, count(e.env) new_gain from {name}_k k left join {name}_e e using (rank) group by 1, 2, 3),
    {name}_s as (select *, sum(new_gain) over (order by rank)::bigint covered, (select count(distinct env) from {inc}) whole from {name}_n),
    {name} as (select item, pass_name, rank, new_gain, covered, whole - covered uncovered, round(100.0 * covered / whole, 6) coverage_pct from {name}_s)"""


def not_similar(name: str, inc: str, order: str) -> str:
    """CTE ``name(item)``: what stays of ``order(item, place)`` when redundant items with a similar one that stays go."""
    n = name
    return f"""{n}_i as (select * from {inc} where item in (select item from {order})), {overlaps(n + "_l", n + "_i", 0.85, False)},
    {n}_p as (select a, b from {n}_l union all select b, a from {n}_l),
    {n}_t as (select o.item, row_number() over (order by z.n desc, o.place) turn from {order} o join {n}_l_z z using (item)), {sweep(n, n + "_i", n + "_t", n + "_p")}"""


def initial_selection(inc: str) -> str:
    """CTE ``chosen``, the manifest of the whole initial selection over ``inc(item, env)``, with steps before it."""
    return f"""tgt as (select distinct env from {inc}), {two_tiers("tt", inc, inc, "tgt")},
    pk as (select item, pass_name, row_number() over (order by turn, r) place from tt), ci as (select * from {inc} where item in (select item from pk)),
    po as (select item, place turn from pk), {sweep("sw", "ci", "po")}, so as (select * from pk where item in (select item from sw)), {not_similar("ns", "ci", "so")},
    fin as (select item, 1 turn, place r, pass_name from so where item in (select item from ns)), {manifest("chosen", "fin", inc)}"""
